"""URL filters from a tree of path templates per host.

Rules decide the urls they fit and so label part of each host's tree. Numbers and hexadecimal runs become
wildcards. Level by level, sibling branches are merged where each one's own labels settle it on the same side; a branch
without labels, or whose labels settle nothing, stays by itself, however large or small it and its siblings are. A
template that is bad by its smoothed share of blocked labels takes the urls down that no rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.sources.shared import drop_folder, keep_table


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains, from a path prefix on."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


@dataclass(frozen=True)
class TreeRules:
    """When branches are alike and templates bad.

    A branch is settled if the interval of its blocked share at ``deviations`` lies on one side of one
    half. Purity is (blocked + prior * weight) / (labelled + weight); from ``reject`` on a template is bad.
    """

    deviations: float = 1.96
    prior: float = 0.1
    weight: float = 5.0
    reject: float = 0.5


BLOCKED, ALLOWED = "<blocked>", "<allowed>"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Name and verdict of the longest rule that fits, of equally long ones the first; NULL if none."""
    ordered = sorted(rules, key=lambda rule: -len(rule.name))
    return F.coalesce(
        *[F.when(rule.fits(host, path), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict")))
          for rule in ordered],
        F.lit(None).cast("struct<rule:string,verdict:string>"),
    )


def general_path(path: Column) -> Column:
    """The path with numbers and long hexadecimal runs as wildcards, without empty segments."""
    plain = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    return F.regexp_replace(F.regexp_replace(plain, "[0-9a-fA-F]{8}[0-9a-fA-F-]{8,}", "{h}"), "[0-9]+", "{n}")


def _wilson(blocked: Column, labelled: Column, z: float) -> tuple[Column, Column]:
    share = blocked / labelled
    scale = F.lit(1.0) + F.lit(z * z) / labelled
    middle = (share + F.lit(z * z) / (labelled * 2)) / scale
    half = F.lit(z) * F.sqrt(share * (F.lit(1.0) - share) / labelled + F.lit(z * z) / (labelled * labelled * 4)) / scale
    return middle - half, middle + half


def path_templates(urls: DataFrame, limits: TreeRules = TreeRules()) -> DataFrame:
    """Template and purity of each (host, general path) in rows of (host, general, label).

    ``label`` is 1 for blocked, 0 for allowed, NULL for undecided. Rows are counted by general path in the
    tasks; all that follows works on these counts. A level joins them with their branches' sums. Paths leave
    when nothing can be merged with them any more: their branch has no labels, or no other path and is not settled. There
    are as many levels as the deepest of the others has segments.
    """
    spark = urls.sparkSession
    counts = urls.groupBy("host", "general").agg(
        F.count("label").alias("labelled"), F.sum(F.coalesce("label", F.lit(0))).alias("blocked")
    )
    segments = F.slice(F.split("general", "/"), 2, 1 << 20)
    paths, path = keep_table(counts.select("*", segments.alias("segments"), F.lit("").alias("template")), "paths")
    finished = paths.where(F.size("segments") == 0).drop("segments")
    active, level = paths.where(F.size("segments") > 0), 0
    while True:
        keyed = active.withColumn("segment", F.element_at("segments", F.lit(level + 1)))
        branches = keyed.groupBy("host", "template", "segment").agg(
            F.count(F.lit(1)).alias("paths"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")
        )
        low, high = _wilson(F.col("b"), F.col("l"), limits.deviations)
        settled = F.when(F.col("l") > 0, F.when(low > 0.5, BLOCKED).when(high < 0.5, ALLOWED))
        single = (F.col("l") == 0) | (F.col("paths") == 1) & settled.isNull()
        chosen = branches.select("host", "template", "segment", F.coalesce(settled, "segment").alias("name"), single.alias("single"))
        last = F.col("single") | (F.size("segments") == level + 1)
        rest = F.array_join(F.slice("segments", level + 2, 1 << 20), "/")
        whole = F.concat_ws("/", "template", "name", F.when(F.size("segments") > level + 1, rest))
        stepped = keyed.join(chosen, ["host", "template", "segment"]).select(
            "host", "general", "labelled", "blocked", "segments", last.alias("last"),
            F.when(last, whole).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"),
        )
        stepped, _ = keep_table(stepped, "paths")
        finished = finished.union(stepped.where("last").select("host", "general", "labelled", "blocked", "template"))
        active, level = stepped.where("not last").drop("last"), level + 1
        if active.isEmpty():
            break
    result, _ = keep_table(finished, "templates")
    drop_folder(spark, path)
    sums = result.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + F.lit(limits.prior * limits.weight)) / (F.col("labelled") + F.lit(limits.weight))
    return result.select("host", "general", "template").join(sums, ["host", "template"]).select(
        "host", "general", "template", "labelled", "blocked", purity.alias("purity")
    )


def judge_urls(
    df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limits: TreeRules = TreeRules()
) -> DataFrame:
    """One row per row: the id, host, path, ``rule``, ``verdict``, and the url's ``template`` and ``purity``.

    The verdict is that of the longest rule that fits, else ``block`` if the template's purity reaches the
    limit, else ``allow``. NULL urls and urls without ``://`` have an empty host and path and one template.
    Repeated urls count as often as they occur; ids may be NULL or repeat. An empty table gives an
    empty result. Other columns are not read, so their names cannot clash.

    Only counts by template are shuffled for the tree. Each url then finds its template in a join
    in which a hot path is split by Spark; the urls without a path in common are spread evenly.
    """
    found = df.select(
        df[id_col].alias("id"), host_of(df[url_col]).alias("host"), path_of(df[url_col]).alias("path")
    )
    found = found.withColumn("matched", matched_rule(rules, F.col("host"), F.col("path"))).withColumn(
        "general", general_path(F.col("path"))
    )
    label = F.when(F.col("matched")["verdict"] == "block", 1).when(F.col("matched")["verdict"] == "allow", 0)
    templates = path_templates(found.select("host", "general", label.alias("label")), limits)
    return (
        found.join(templates, ["host", "general"])
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("matched")["rule"].alias("rule"),
            F.coalesce(F.col("matched")["verdict"], F.when(F.col("purity") >= limits.reject, "block").otherwise("allow")).alias("verdict"),
            "template", "purity",
        )
    )
