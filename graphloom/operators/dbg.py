"""De Bruijn graphs of many sequences with k-mers as numbers.

A stretch of k-1 bases, the overlap, is what joins its k-mers: all that end in it lead to all that begin with it. Overlaps are counted
where their stretches meet, with the bases before and after them, so one row has all edges through an overlap and the counts
of the k-mers that begin with it. Whether two k-mers are joined follows from their letters, so motifs need no join with the edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.sequence import reverse_complement
from ..model import AssemblyGraph
from ..sources import stretches as st

#: The overlap and two codes of a base each must fit a number.
MAX_K = 30
_COUNTS = ("n0", "n1", "n2", "n3")


def _tallied(k: int):
    """Overlaps with the mask of the bases before them and the counts of those after them."""
    five = np.uint64(5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = st.Tally()
        for _, heads, tails in st.chunks(batches, k - 1, True):
            overlaps, begins, sizes = st.expand(heads, tails, k - 1)
            if not len(overlaps):
                continue
            bits, last = tails.view(np.uint64), np.uint64(3)
            before, after = np.empty(len(overlaps), np.uint64), np.empty(len(overlaps), np.uint64)
            before[1:] = overlaps[:-1] >> np.uint64(2 * (k - 2))
            after[:-1] = overlaps[1:] & last
            before[begins] = (bits >> np.uint64(8)) & np.uint64(7)
            after[begins + sizes - 1] = (bits >> np.uint64(5)) & np.uint64(7)
            tally.add((overlaps << five) | (before * np.uint64(5) + after))
        values, n = tally.end()
        if not len(values):
            return
        keys, codes = values >> five, (values & np.uint64(31)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        mask = np.bitwise_or.reduceat(np.array([1, 2, 4, 8, 0])[codes // 5], first).astype(np.int32)
        counts = [np.add.reduceat(np.where(codes % 5 == a, n, 0), first) for a in range(4)]
        for lo in range(0, len(first), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first[part]].view(np.int64)), pa.array(mask[part]), *[pa.array(c[part]) for c in counts]], names=["overlap", "before", *_COUNTS])

    return run


@dataclass(frozen=True)
class Overlaps:
    """(overlap, before, n0, n1, n2, n3), written out: a bit for each base before the overlap, a count for each after it."""

    rows: DataFrame
    k: int

    def _firsts(self) -> Column:
        """K-mers that end in the overlap."""
        masked = [F.when(F.col("before").bitwiseAND(F.lit(1 << i)) != 0, F.col("overlap") + F.lit(i << 2 * (self.k - 1))) for i in range(4)]
        return F.array_compact(F.array(*masked))

    def _lasts(self) -> Column:
        """K-mers that begin with it."""
        return F.array_compact(F.array(*[F.when(F.col(c) > 0, F.col("overlap") * 4 + i) for i, c in enumerate(_COUNTS)]))

    def sides(self) -> DataFrame:
        """(overlap, firsts, lasts) where both are k-mers."""
        return self.rows.where(F.col("before") > 0).select("overlap", self._firsts().alias("firsts"), self._lasts().alias("lasts")).where(F.size("lasts") > 0)

    def edges(self) -> DataFrame:
        return self.sides().select(F.explode("firsts").alias("src"), "lasts").select("src", F.explode("lasts").alias("dst"))

    def vertices(self) -> DataFrame:
        """(kmer, n) of the k-mers that have edges. Those without one into them begin sequences; they alone are looked up."""
        each = F.explode(F.array(*[F.struct((F.col("overlap") * 4 + i).alias("kmer"), F.col(c).alias("n")) for i, c in enumerate(_COUNTS)]))
        every = self.rows.select("before", each.alias("r")).select("before", "r.*").where("n > 0")
        starts = every.where("before = 0").withColumn("overlap", F.col("kmer").bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1))).select("kmer", "n", "overlap")
        starts = scratch.keep(self.rows.sparkSession, starts, "starts")
        few = starts.count() <= 1 << 20
        after = self.rows.where(" or ".join(f"{c} > 0" for c in _COUNTS)).select("overlap")
        lead = after.join(F.broadcast(starts) if few else starts, "overlap").select("kmer", "n")
        return every.where("before > 0").select("kmer", "n").union(lead)

    def graph(self) -> AssemblyGraph:
        """K-mers as numbers are the ids and their counts the depths."""
        v = self.vertices().select(F.col("kmer").alias("vid"), F.lit(1).cast("long").alias("length"), F.array("kmer").alias("segments"), F.array(F.col("n").cast("double")).alias("depth"))
        return AssemblyGraph(v, self.edges(), self.k, ("all",))

    def joined(self, x: str, y: str) -> Column:
        """Whether an edge leads from one k-mer to another, if both are there."""
        return F.col(x).bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1)) == F.shiftright(F.col(y), 2)

    def boxes(self) -> DataFrame:
        """(a, b, c, d): induced 2x2 bicliques; both sources end in one overlap, with which both targets begin."""
        wide = self.sides().where((F.size("firsts") > 1) & (F.size("lasts") > 1))
        pair = lambda df, c, x, y: df.select("*", F.posexplode(c).alias("i", x)).withColumn(y, F.explode(F.expr(f"slice({c}, i + 2, size({c}))"))).drop("i", c)
        four = pair(pair(wide, "firsts", "a", "b"), "lasts", "c", "d").select("a", "b", "c", "d")
        extra = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), *[(x, x) for x in "abcd"], ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b")]
        spoilt = F.lit(False)
        for x, y in extra:
            spoilt = spoilt | self.joined(x, y)
        distinct = (F.col("a") != F.col("c")) & (F.col("a") != F.col("d")) & (F.col("b") != F.col("c")) & (F.col("b") != F.col("d"))
        return four.where(distinct & ~spoilt)

    def _boxed(self) -> DataFrame:
        """(vid) of the vertices of bicliques, a vertex at most once from either side unless the overlap repeats a base or two.

        Only where an overlap has a period of one or two bases can a target lead back; elsewhere all its k-mers are taken as they are.
        """
        k = self.k
        even = F.shiftright(F.col("overlap"), 4) == F.col("overlap").bitwiseAND(F.lit((1 << 2 * max(k - 3, 0)) - 1))
        plain = self.sides().where(~even & (F.size("firsts") > 1) & (F.size("lasts") > 1)).select(F.explode(F.concat("firsts", "lasts")).alias("vid"))
        doubtful = Overlaps(self.rows.where(even), k).boxes().select(F.explode(F.array("a", "b", "c", "d")).alias("vid"))
        return plain.union(doubtful.distinct())

    def box_vertices(self) -> DataFrame:
        return self._boxed().distinct()

    def self_loops(self) -> DataFrame:
        """(vid) of k-mers of one base: no others lead to themselves."""
        every = [sum(i << 2 * j for j in range(self.k - 1)) for i in range(4)]
        return self.rows.where(F.col("overlap").isin(every)).where(F.size(self._lasts()) > 0).select(F.explode(self._lasts()).alias("vid")).where(self.joined("vid", "vid"))

    def identifiable_junctions(self) -> DataFrame:
        """(vid) of k-mers with edges on both sides and several on one, outside of bicliques and loops: one aggregate by k-mer."""
        sides, none, no = self.sides(), F.lit(0), F.lit(False)
        out = sides.select(F.explode("firsts").alias("vid"), none.alias("i"), F.size("lasts").alias("o"), no.alias("barred"))
        into = sides.select(F.explode("lasts").alias("vid"), F.size("firsts").alias("i"), none.alias("o"), no.alias("barred"))
        barred = self._boxed().union(self.self_loops()).select("vid", none.alias("i"), none.alias("o"), F.lit(True).alias("barred"))
        each = out.union(into).union(barred).groupBy("vid").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.max("barred").alias("barred"))
        return each.where("not barred and i > 0 and o > 0 and i + o > 2").select("vid")


def overlaps(sequences: DataFrame, k: int, bases: str = "bases", both_strands: bool = False) -> Overlaps:
    """The overlaps of all sequences, and of their reverse complements if asked for."""
    if not 3 <= k <= MAX_K:
        raise ValueError(f"k must be from 3 to {MAX_K}: {k}")
    rows = sequences.select(F.lit(0).cast("long").alias("who"), F.col(bases).alias("bases"))
    if both_strands:
        rows = rows.union(rows.select("who", reverse_complement(F.col("bases"))))
    tasks = st.tasks_for(rows, st.total_bases(rows))
    met = st.met(st.stretches(rows, k - 1, False, tasks, around=True), tasks)
    found = met.mapInArrow(_tallied(k), "overlap long, before int, n0 long, n1 long, n2 long, n3 long")
    return Overlaps(scratch.keep(sequences.sparkSession, found, "overlaps"), k)
