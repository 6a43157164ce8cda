"""Linked FASTA: unitigs with links in their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, bases) of FASTA files, which split like any text: each record is a row by itself.

    Records begin at a ">" that begins a line. Blank lines before the first record are skipped; of several
    sequence lines the last counts, and a record without one has null bases.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s*>|\r", "").alias("value"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    found = rows.select("file", lines.alias("lines")).where(F.size("lines") > 0)
    return found.select("file", F.element_at("lines", 1).alias("header"), F.when(F.size("lines") > 1, F.element_at("lines", -1)).alias("bases"))


def records(lines: DataFrame, group: str = "file", order: str = "offset") -> DataFrame:
    """(group, header, bases) of FASTA lines that have an order of their own, in groups of bounded size.

    Blank lines before a record are skipped; of several sequence lines the last counts; no
    lines give no records. Files are read by ``read_records``, without a group for each.
    """
    in_order = Window.partitionBy(group).orderBy(order)
    is_header = F.col("line").startswith(">")
    numbered = lines.where(F.trim("line") != "").withColumn("record", F.sum(is_header.cast("int")).over(in_order)).where("record > 0")
    found = numbered.groupBy(group, "record").agg(F.max(F.when(is_header, F.substr("line", F.lit(2)))).alias("header"), F.max_by("line", F.when(~is_header, F.col(order))).alias("bases"))
    return found.select(group, "header", "bases")


def bcalm_header(header: Column) -> tuple[Column, Column, Column]:
    """Id, LN field and links of a header with two abundance fields after LN."""
    parts = F.split(header, r"\s+")
    return parts[0], parts[1], F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0)))


def ggcat_header(header: Column) -> tuple[Column, Column, Column]:
    """Id, LN field and links of a header without further fields."""
    parts = F.split(header, r"\s+")
    return parts[0], parts[1], F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))


def generic_header(header: Column) -> tuple[Column, Column]:
    """Id and the rest."""
    parts = F.split(header, r"\s+")
    return parts[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


DIALECTS = {"bcalm": bcalm_header, "ggcat": ggcat_header}


def parse(found: DataFrame, k: int, dialect: str = "bcalm") -> DataFrame:
    """unitig, length (in k-mers), links and bases of records; of equal ids the last header counts."""
    unitig, size, links = DIALECTS[dialect](F.col("header"))
    links = F.filter(links, lambda x: x != "")
    parsed = found.select(unitig.alias("unitig"), (F.element_at(F.split(size, ":"), -1).cast("long") - (k - 1)).alias("length"), links.alias("links"), "bases")
    return parsed.groupBy("unitig").agg(F.max(F.struct("length", "links", "bases")).alias("r")).select("unitig", "r.*")


def link_edges(unitigs: DataFrame) -> DataFrame:
    """Distinct (src, dst) as listed; mirrored edges are not added. A malformed link fails."""
    link = F.split("link", ":")
    good = F.col("link").rlike(r"^L:[+-]:[^:]+:[+-]$")
    each = unitigs.select("unitig", F.explode("links").alias("link"))
    checked = F.when(good, F.concat("unitig", link[1])).otherwise(F.raise_error(F.concat(F.lit("malformed link: "), F.col("link"))))
    return each.select(checked.alias("src"), F.concat(link[2], link[3]).alias("dst")).distinct()


def oriented_vertices(unitigs: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, unitig, length): ends of edges, and both strands of unitigs without links."""
    orphans = unitigs.where(F.size("links") == 0).select(F.explode(F.array(F.concat("unitig", F.lit("+")), F.concat("unitig", F.lit("-")))).alias("vertex"))
    named = edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).union(orphans).distinct()
    named = named.withColumn("unitig", F.substr("vertex", F.lit(1), F.length("vertex") - 1))
    return named.join(unitigs.select("unitig", "length"), "unitig").select("vertex", "unitig", "length")


def to_fasta(df: DataFrame, name: str = "name", bases: str = "bases") -> DataFrame:
    """One column of records, ready for ``write.text``."""
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(bases)).alias("value"))
