"""Sequences, k-mers and de Bruijn edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_pair(base: Column, strict: bool = False) -> Column:
    """The complementary base; with ``strict`` anything but A, C, G, T fails."""
    if strict:
        base = F.when(base.rlike("^[ACGT]*$"), base).otherwise(F.raise_error(F.concat(F.lit("not a base: "), base)))
    return F.translate(base, "ACGT", "TGCA")


def reverse_complement(sequence: Column) -> Column:
    return base_pair(F.reverse(sequence))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def windows(sequence: Column, size: int, step: int = 1, at_least: int | None = None) -> Column:
    """Array of the stretches of ``size`` characters that begin every ``step`` characters, in one pass.

    The last ones may be shorter, down to ``at_least`` (default: ``size``). A null or too short sequence has none.
    A match looks ahead at a stretch and takes ``step`` characters, so that no stretch is counted off from the start.
    """
    pattern = f"(?s)(?=(.{{{size if at_least is None else at_least},{size}}})).{{1,{step}}}"
    return F.coalesce(F.regexp_extract_all(sequence, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def kmers(sequence: Column, k: int, circular: bool = False) -> Column:
    """Array of all substrings of length k; a circular sequence goes on with its start."""
    return windows(F.concat(sequence, F.substring(sequence, 1, k - 1)) if circular else sequence, k)


def canonical_kmers(sequence: Column, k: int) -> Column:
    """Array of the lesser of each k-mer and its reverse complement, in order.

    The reverse complements are those of the sequence's other strand, turned round, so that no k-mer is turned by itself.
    """
    return F.zip_with(kmers(sequence, k), F.reverse(kmers(reverse_complement(sequence), k)), lambda a, b: F.least(a, b))


def dbg_overlaps(nodes: DataFrame, column: str = "kmer", letters: str = "ACGT") -> DataFrame:
    """(overlap, before, after): stretches of k-1 characters that end one k-mer and begin another.

    ``before`` has a bit for each letter that comes before the overlap in a k-mer, ``after`` for each that comes after it,
    so both roles of an overlap meet in one aggregate of two numbers. K-mers may be repeated; one that begins or ends with
    another character fails.
    """

    def bit(letter: Column) -> Column:
        known = F.when(letter == letters[0], 1)
        for i, c in enumerate(letters[1:], 1):
            known = known.when(letter == c, 1 << i)
        return known.otherwise(F.raise_error(F.concat(F.lit("no such letter: "), letter)).cast("int"))

    kmer, none = F.col(column), F.lit(0)
    role = lambda overlap, before, after: F.struct(overlap.alias("overlap"), before.alias("before"), after.alias("after"))
    roles = F.explode(F.array(role(F.substr(kmer, F.lit(2)), bit(F.left(kmer, F.lit(1))), none), role(F.substr(kmer, F.lit(1), F.length(kmer) - 1), none, bit(F.right(kmer, F.lit(1))))))
    ends = nodes.select(roles.alias("r")).select("r.*")
    return ends.groupBy("overlap").agg(F.bit_or("before").alias("before"), F.bit_or("after").alias("after")).where("before > 0 and after > 0")


def _letters(mask: str, letters: str) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(letters)]))


def overlap_edges(overlaps: DataFrame, letters: str = "ACGT") -> DataFrame:
    """(src, dst) of the overlaps' k-mers."""
    srcs = overlaps.select("overlap", "after", F.explode(_letters("before", letters)).alias("first"))
    each = srcs.select("overlap", "first", F.explode(_letters("after", letters)).alias("last"))
    return each.select(F.concat("first", "overlap").alias("src"), F.concat("overlap", "last").alias("dst"))


def overlap_kmers(overlaps: DataFrame, letters: str = "ACGT") -> DataFrame:
    """(kmer) of the k-mers that have edges, at most twice each."""
    firsts = F.transform(_letters("before", letters), lambda c: F.concat(c, F.col("overlap")))
    lasts = F.transform(_letters("after", letters), lambda c: F.concat(F.col("overlap"), c))
    return overlaps.select(F.explode(F.concat(firsts, lasts)).alias("kmer"))


def dbg_edges(nodes: DataFrame, column: str = "kmer", letters: str = "ACGT") -> DataFrame:
    """(src, dst) for distinct k-mers of which one's last k-1 characters are the other's first; k is 2 or more."""
    return overlap_edges(dbg_overlaps(nodes, column, letters), letters)


def flip(segment: Column) -> Column:
    """The same segment on the other strand."""
    return F.concat(F.substr(segment, F.lit(1), F.length(segment) - 1), F.translate(F.substr(segment, F.length(segment)), "+-", "-+"))


def reverse_complement_segments(segments: Column) -> Column:
    return F.transform(F.reverse(segments), flip)


def canonical_segments(segments: Column) -> Column:
    """The lesser, segment by segment, of a path and its reverse complement."""
    return F.least(segments, reverse_complement_segments(segments))


def random_sequences(spark, n: int, length: int, seed: int) -> DataFrame:
    """(id, bases): n random sequences over A, C, G, T, equal for equal seeds and partitions."""
    bases = F.array(*map(F.lit, "ACGT"))
    positions = spark.range(n).select(F.col("id"), F.posexplode(F.sequence(F.lit(1), F.lit(length))).alias("pos", "i"))
    drawn = positions.withColumn("base", F.element_at(bases, (F.floor(F.rand(seed) * 4) + 1).cast("int")))
    return drawn.groupBy("id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"])).alias("bases"))
