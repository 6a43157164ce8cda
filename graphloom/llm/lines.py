"""Line dedup by the spread of lines over sites.

Every line hash gets a HyperLogLog sketch of the sites (sources) that show it; sketches merge by
aggregation. Lines whose estimate lies near the threshold get exact distinct counts. Lines on
``min_sites`` sites or more are boilerplate: they go everywhere but at their first place, so that
nothing is lost from the corpus as a whole. Unless given, ``min_sites`` follows the number of sites of
the whole table; its floor lies above what groups of near copies reach.

Data moves as line hashes; texts move once, to meet the numbers of the lines that go.

Defined cases: lines are compared without surrounding white space and blank lines are never
boilerplate; a null source is a site of its own; a null text stays null; rows that share id and
text are treated alike; further columns are kept by ``remove_boilerplate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: A line on this share of the table's sites is boilerplate, if these are ``LEAST_SITES`` at least.
SITE_SHARE, LEAST_SITES = 0.01, 10
#: log2 of a sketch's registers, and the standard errors around the threshold that are counted exactly.
LG_K, BAND = 12, 4
#: Characters that lines are compared without, at both ends.
WHITE = " \t\n\x0b\f\r"


def site_threshold(docs: DataFrame) -> int:
    """Sites from which on a line is boilerplate: a share of all sites with a floor."""
    sites = docs.agg(F.countDistinct(_site())).first()[0]
    return max(LEAST_SITES, math.ceil(SITE_SHARE * sites))


def _site() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, pos, h1, h2: one row per line that is not blank; 128 bits of hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _site().alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.col("line") != "")
    return rows.select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line").alias("h2"))


def boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int | None = None) -> DataFrame:
    """h1, h2, sites, first_id, first_pos of the lines on ``min_sites`` sites or more."""
    if min_sites is None:
        min_sites = site_threshold(docs)
    lines = _lines(docs)
    place = F.struct("doc_id", "pos", "text_hash")
    seen = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(place).alias("first"))
    seen = seen.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"), "first")
    margin = max(1, math.ceil(BAND * 1.04 / math.sqrt(1 << LG_K) * min_sites))
    # written out, so that the joins that follow are plain ones, which Spark splits where a line is frequent
    spread = scratch.keep(spark, seen.where(F.col("sites") >= min_sites - margin), "spread")
    clear = spread.where(F.col("sites") > min_sites + margin)
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2", "first"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"), F.first("first").alias("first"))
    both = clear.unionByName(exact.where(F.col("sites") >= min_sites))
    return scratch.keep(spark, both.select("h1", "h2", "sites", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos")), "boilerplate")


def removals(spark: SparkSession, docs: DataFrame, min_sites: int | None = None) -> DataFrame:
    """doc_id, text_hash and the numbers of the lines that go."""
    hits = _lines(docs).drop("site").join(boilerplate(spark, docs, min_sites).drop("sites"), ["h1", "h2"])
    hits = hits.where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))))
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))


def _cleaned(spark: SparkSession, docs: DataFrame, min_sites: int | None) -> tuple[DataFrame, Column]:
    gone = removals(spark, docs, min_sites).withColumnsRenamed({"doc_id": "_gone_id", "text_hash": "_gone_hash", "gone": "_gone"})
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_hash")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    return rows, F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)


def removed_lines(spark: SparkSession, docs: DataFrame, min_sites: int | None = None) -> DataFrame:
    """Per document: lines that are not blank, lines that go, and a digest of the text that stays."""
    rows, kept = _cleaned(spark, docs.select("doc_id", "text", "source"), min_sites)
    filled = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"\S"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.size(filled), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )


def remove_boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int | None = None) -> DataFrame:
    """Documents without boilerplate lines; those of which only white space is left go. Columns as in ``docs``."""
    rows, kept = _cleaned(spark, docs, min_sites)
    rows = rows.withColumn("_kept", kept).where(F.col("_gone").isNull() | F.col("_kept").rlike(r"\S"))
    kind = dict(docs.dtypes)
    new = {"text": F.col("_kept").alias("text")}
    if "n_chars" in kind:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("_kept").cast(kind["n_chars"])).alias("n_chars")
    return rows.select(*[new.get(c, docs[c]) for c in docs.columns])
