"""Results that later jobs read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dataproof.sources.shared import keep_table


def keep(df: DataFrame) -> DataFrame:
    """Compute once, store durably as Parquet, cut the lineage.

    The rows go to the checkpoint folder the cluster names, so they outlive a lost
    executor, and Spark knows their size. A cluster that names no folder is refused; see ``shared_folder``.
    """
    return keep_table(df, "kept")[0]
