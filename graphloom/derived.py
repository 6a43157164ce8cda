"""Assembly-graph inputs derived from the plain tables, in Spark and in DuckDB SQL.

``events`` gives a graph: its vertices are events, its edges lead to the next event of the same
user and, from purchases, to the next purchase. ``documents`` give sequences: letters are
mapped to bases, and overlapping stretches are unitigs, linked in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .functions.sequence import windows
from .model import AssemblyGraph
from .operators import dbg
from .sources import stretches

#: k of the k-mers, and bases by which unitigs advance.
K, STEP = 15, 100
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
SAMPLES = ("s0", "s1", "s2", "s3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sample, bases): whole texts as bases; the sample is the language.

    A file of few row groups is read by as few tasks, which would then have all k-mers: rows of a table with
    fewer splits than cores are dealt over the cores first.
    """
    docs, cores = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    return docs.select("doc_id", F.col("lang").alias("sample"), F.regexp_replace(F.translate(F.lower("text"), LETTERS, BASES), "[^ACGT]", "").alias("bases"))


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, last, unitig, bases): stretches of STEP + K - 1 bases, each overlapping the next by K - 1."""
    stretches = windows(F.col("bases"), STEP + K - 1, STEP, K)
    each = sequences(spark, sf_dir).select("doc_id", F.floor((F.length("bases") - K) / STEP).alias("last"), F.posexplode(stretches).alias("at", "bases"))
    at = F.col("at").cast("long")
    return each.select("doc_id", at.alias("i"), "last", (F.col("doc_id") * 100000 + at).cast("string").alias("unitig"), "bases")


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(header, bases) of the unitigs with abundance fields and a link to the next one."""
    u = unitigs(spark, sf_dir)
    here = F.col("unitig").cast("long")
    links = F.concat(F.when(F.col("i") < F.col("last"), F.concat(F.lit(" L:+:"), (here + 1).cast("string"), F.lit(":+"))).otherwise(""), F.when(F.col("i") > 0, F.concat(F.lit(" L:-:"), (here - 1).cast("string"), F.lit(":-"))).otherwise(""))
    return u.select(F.concat("unitig", F.lit(" LN:i:"), F.length("bases").cast("string"), F.lit(" KC:i:1 km:f:1.0"), links).alias("header"), "bases")


def _next_in_time(rows: DataFrame, by: list[str], unit: str) -> DataFrame:
    """(src, dst) of each row and the next one by time among those with equal ``by``; no task has more than a unit's rows of a value.

    The last row of a unit (an hour, a day) is followed by the first one of the next unit that has rows; only the
    units' first rows, one each, meet in one window.
    """
    dated = rows.withColumn("unit", F.date_trunc(unit, "ts"))
    inner = dated.withColumn("dst", F.lead("event_id").over(Window.partitionBy(*by, "unit").orderBy("ts", "event_id")))
    firsts = dated.groupBy(*by, "unit").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    after = firsts.select(*by, "unit", F.lead("first.event_id").over(Window.partitionBy(*by).orderBy("unit")).alias("after"))
    return inner.join(after, [*by, "unit"]).select(F.col("event_id").alias("src"), F.coalesce("dst", "after").alias("dst"))


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """Rows with their ``rank`` by time among those with equal ``by``; a day's rows of a value are in one task, not all of them."""
    daily = rows.withColumn("day", F.date_trunc("day", "ts"))
    within = daily.withColumn("rank", F.row_number().over(Window.partitionBy(by, "day").orderBy("ts", "event_id")))
    before = daily.groupBy(by, "day").agg(F.count("*").alias("n"))
    before = before.select(by, "day", (F.sum("n").over(Window.partitionBy(by).orderBy("day")) - F.col("n")).alias("before"))
    return within.join(before, [by, "day"]).withColumn("rank", F.col("before") + F.col("rank")).drop("day", "before")


def event_graph(spark: SparkSession, sf_dir: str) -> AssemblyGraph:
    e = table(spark, sf_dir, "events")
    users = _next_in_time(e.select("user_id", "event_id", "ts"), ["user_id"], "day")
    purchases = _next_in_time(e.where("event_type = 'purchase'").select("event_id", "ts"), [], "hour")
    edges = users.union(purchases).where("dst is not null").distinct()
    depth = F.array(F.col("value"), F.col("value") * 0.5 + 1, F.abs(F.col("value") - 10), (F.col("user_id") % 10).cast("double"))
    vertices = e.select(F.col("event_id").alias("vid"), (1 + F.col("event_id") % 7).alias("length"), F.array(F.concat(F.col("event_id").cast("string"), F.lit("+"))).alias("segments"), depth.alias("depth"))
    return AssemblyGraph(vertices, edges, K, SAMPLES)


#: Ranks of a user's events that are in one window, about.
SPAN = 1024


def segment_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, length, segments, depth): an event and the user's next three as oriented segments."""
    e = table(spark, sf_dir, "events")
    seg = F.concat("event_type", F.when(F.col("value") >= 30, "+").otherwise("-"))
    ranked = _ranked(e.select("user_id", "event_id", "ts", "value", seg.alias("seg")), "user_id")
    # each event goes to its span of ranks, and the first three of a span also to the one before it
    nth = F.col("rank") - 1
    span = F.floor(nth / SPAN)
    placed = ranked.select("user_id", "rank", "event_id", "value", "seg", F.explode(F.when(nth % SPAN < 3, F.array(span, span - 1)).otherwise(F.array(span))).alias("span"))
    own = Window.partitionBy("user_id", "span").orderBy("rank")
    rows = placed.select(F.col("event_id").alias("vid"), "value", (F.col("span") == span).alias("own"), F.col("seg").alias("a"), *[F.lead("seg", i).over(own).alias(c) for i, c in enumerate("bcd", 1)])
    rows = rows.where("own and vid is not null and d is not null")
    return rows.select("vid", (1 + F.col("vid") % 7).alias("length"), F.array("a", "b", "c", "d").alias("segments"), F.array(F.col("value"), F.col("value") * 0.5 + 1).alias("depth"))


def segment_graph(spark: SparkSession, sf_dir: str) -> AssemblyGraph:
    v = scratch.keep(spark, segment_vertices(spark, sf_dir), "segment_vertices")
    e = event_graph(spark, sf_dir).edges
    ids = v.select("vid")
    edges = e.join(ids.select(F.col("vid").alias("src")), "src", "left_semi").join(ids.select(F.col("vid").alias("dst")), "dst", "left_semi").select("src", "dst")
    return AssemblyGraph(v, edges, K, SAMPLES[:2])


def kmer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kmer, n): the k-mers of all documents and how often they occur."""
    return stretches.spelled(stretches.counts(sequences(spark, sf_dir), K, None, both=False), K, "kmer")


def overlaps(spark: SparkSession, sf_dir: str) -> dbg.Overlaps:
    """The de Bruijn graph of all documents, by overlaps of k-mers as numbers."""
    return dbg.overlaps(sequences(spark, sf_dir), K)


# The same in DuckDB SQL, as common table expressions.
SQL_DNA = f"dna AS (SELECT doc_id, lang AS sample, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS bases FROM documents)"
SQL_KMERS = f"kms AS (SELECT doc_id, sample, bases[i:i + {K - 1}] AS kmer FROM (SELECT *, unnest(range(1, length(bases) - {K - 2})) AS i FROM dna WHERE length(bases) >= {K}))"
SQL_UNITIGS = f"""uni AS (SELECT doc_id, i, last, CAST(doc_id * 100000 + i AS VARCHAR) AS unitig, substring(bases, CAST(i * {STEP} + 1 AS BIGINT), {STEP + K - 1}) AS bases
 FROM (SELECT doc_id, bases, last, unnest(range(0, last + 1)) AS i FROM (SELECT *, CAST(floor((length(bases) - {K}) / {STEP}) AS BIGINT) AS last FROM dna WHERE length(bases) >= {K})))"""
SQL_EVENTS = """ed AS (SELECT event_id AS src, dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL
 UNION SELECT event_id, dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'purchase') WHERE dst IS NOT NULL),
vx AS (SELECT event_id AS vid, 1 + event_id % 7 AS length, [value, value * 0.5 + 1, abs(value - 10), CAST(user_id % 10 AS DOUBLE)] AS depth, [CAST(event_id AS VARCHAR) || '+'] AS segments FROM events),
ind AS (SELECT dst AS vid, count(*) AS n FROM ed GROUP BY dst), outd AS (SELECT src AS vid, count(*) AS n FROM ed GROUP BY src),
deg AS (SELECT vx.vid, coalesce(ind.n, 0) AS in_degree, coalesce(outd.n, 0) AS out_degree FROM vx LEFT JOIN ind ON ind.vid = vx.vid LEFT JOIN outd ON outd.vid = vx.vid)"""
SQL_SIBLING_FREE = "sf AS (SELECT src, dst FROM ed WHERE src IN (SELECT vid FROM outd WHERE n = 1) AND dst IN (SELECT vid FROM ind WHERE n = 1))"
SQL_PATHS = """paths AS (WITH RECURSIVE p AS (SELECT src AS path, 0 AS rank, src AS vid FROM sf WHERE src NOT IN (SELECT dst FROM sf)
 UNION ALL SELECT p.path, p.rank + 1, sf.dst FROM p JOIN sf ON sf.src = p.vid) SELECT * FROM p)"""
SQL_SEGMENTS = """sg AS (SELECT vid, 1 + vid % 7 AS length, [a, b, c, d] AS segments, [value, value * 0.5 + 1] AS depth FROM (
 SELECT event_id AS vid, value, seg AS a, lead(seg, 1) OVER w AS b, lead(seg, 2) OVER w AS c, lead(seg, 3) OVER w AS d
 FROM (SELECT *, event_type || CASE WHEN value >= 30 THEN '+' ELSE '-' END AS seg FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE d IS NOT NULL),
rc AS (SELECT *, list_transform(list_reverse(segments), lambda s: s[:-2] || CASE WHEN s[-1] = '+' THEN '-' ELSE '+' END) AS rev FROM sg)"""
SQL_DBG = f"""km AS (SELECT kmer, count(*) AS n FROM kms GROUP BY kmer),
ed AS (SELECT a.kmer AS src, b.kmer AS dst FROM km a JOIN km b ON a.kmer[2:] = b.kmer[:{K - 1}]),
vx AS (SELECT kmer AS vid, 1 AS length, n FROM km WHERE kmer IN (SELECT src FROM ed) OR kmer IN (SELECT dst FROM ed))"""
