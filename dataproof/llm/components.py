"""Connected components of links: contracted in tasks, then by rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.sources.shared import drop_folder, keep_table

#: Links that one task contracts.
AT_ONCE = 1 << 17


def components(links: DataFrame) -> DataFrame:
    """``doc`` and ``component`` (the smallest id reachable) of every id in the links (a, b).

    Each task contracts its links first: every id with the smallest that the task's links reach. Links that fit
    one task are done with that, and no rounds of shuffles run on small tables. Else each round gives every id the
    smallest label next to it and then the label of its label, so that a component of any shape takes about as many
    rounds as the logarithm of its width. Minima are taken before the shuffle; the label table is written in every
    round, so a lost executor costs one round. Links are read twice and, like labels, stay in Spark; the driver sees
    one count a round. NULLs are ignored, loops and repeated links are harmless, and no links give no rows.
    """
    spark = links.sparkSession
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    tasks = -(-links.count() // AT_ONCE)
    stars = links.coalesce(max(1, tasks)).mapInArrow(_contracted(AT_ONCE), "doc long, component long")
    if tasks <= 1:
        return keep_table(stars, "labels")[0]
    links = stars.where("doc <> component").toDF("a", "b")
    both, both_path = keep_table(links.union(links.select("b", "a")).distinct().toDF("doc", "other"), "links")
    labels, path = keep_table(both.groupBy("doc").agg(F.least(F.min("other"), F.first("doc")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.toDF("other", "found"), "other").groupBy("doc").agg(F.min("found").alias("near"))
        )
        lower = labels.join(near, "doc").select("doc", "component", F.least("component", "near").alias("least"))
        of_label = labels.toDF("least", "further")
        stepped = lower.join(of_label, "least", "left").select(
            "doc", F.least("least", "further").alias("component"),
            (F.least("least", "further") < F.col("component")).alias("moved"),
        )
        new, new_path = keep_table(stepped, "labels")
        moved = new.where("moved").limit(1).count()
        drop_folder(spark, path)
        labels, path = new.select("doc", "component"), new_path
        if not moved:
            break
    drop_folder(spark, both_path)
    return labels


def _contracted(most: int):
    """Every id of a task's links with the smallest id that they reach; anew once there are more ids than ``most`` links have."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(most=2 * most)

        def told() -> pa.RecordBatch:
            doc, component = zip(*forest.stars(), strict=True) if forest.parent else ((), ())
            forest.parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(component, pa.int64())], names=["doc", "component"])

        for batch in batches:
            for a, b in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if len(forest.parent) > forest.most:
                    yield told()
                forest.joins(a, b)
        yield told()

    return contract


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (doc, component) after more links (a, b). Ids without a label are components of their own."""
    links = links.select("a", "b")
    return components(links if labels is None else labels.select("doc", "component").toDF("a", "b").union(links))


class Forest:
    """Links of one task, without those whose ends earlier ones join already."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parent = most, {}

    def _root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def joins(self, a: int, b: int) -> bool:
        """Adds a link; False if it joins nothing. When there are too many ids it starts anew."""
        if len(self.parent) > self.most:
            self.parent.clear()
        a, b = self._root(a), self._root(b)
        self.parent[a] = b
        return a != b

    def stars(self) -> list[tuple[int, int]]:
        """Every id with the smallest one that it is joined with."""
        least: dict[int, int] = {}
        for x in self.parent:
            root = self._root(x)
            least[root] = min(least.get(root, x), x)
        return [(x, least[self._root(x)]) for x in self.parent]
