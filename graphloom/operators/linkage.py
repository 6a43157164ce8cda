"""Average linkage of profiles by updates of the rows that a merge touches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: Profiles that can be linked: what reaches the driver and is broadcast is 40 bytes a profile and round.
MAX_PROFILES = 1 << 17
#: Profiles in a side of a tile of distances.
TILE = 512


def _tiles(spark: SparkSession, units: DataFrame, n: int) -> DataFrame:
    """(i, size, row): the cosine distances of profile i to all, itself at infinity, from tiles of TILE by TILE.

    ``units`` is (i, p) with i from 0 and p of length 1. A tile comes from two blocks of profiles by a matrix product, and a
    row is put together from its tiles' pieces.
    """
    blocks = units.groupBy(F.floor(F.col("i") / TILE).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("rows"))
    blocks = scratch.keep(spark, blocks, "blocks")
    ends = F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // TILE).cast("long"))
    pairs = blocks.select(F.col("rows").alias("mine"), F.explode(ends).alias("block")).join(blocks, "block")

    def tile(batches):
        import pyarrow as pa

        def matrix(cell) -> tuple[np.ndarray, np.ndarray]:
            rows = cell.values
            p = rows.field("p")
            return rows.field("i").to_numpy(zero_copy_only=False), p.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        for batch in batches:
            for a, block, b in zip(batch.column(0), batch.column(1), batch.column(2)):
                (i, x), (j, y) = matrix(a), matrix(b)
                # both orders of a pair must have the same bits, so the product is always taken from the lesser block
                d = 1 - (x @ y.T if i[0] <= j[0] else (y @ x.T).T)
                if i[0] == j[0]:
                    d = np.triu(d, 1) + np.triu(d, 1).T
                d[i[:, None] == j[None, :]] = np.inf
                offsets = np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), block.as_py())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))], names=["i", "block", "piece"])

    pieces = pairs.select("mine", "block", "rows").mapInArrow(tile, "i bigint, block bigint, piece array<double>")
    row = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]))
    return pieces.groupBy("i").agg(row.alias("row")).select("i", F.lit(1).cast("long").alias("size"), "row")


def _pairs(nearest: list[tuple[int, int, float]], threshold: float) -> list[tuple[int, int]]:
    """Positions that are each other's nearest below the threshold, the lesser first.

    Equal distances can differ in the last bit between a pair's two rows once they are sums; where that leaves
    no mutual pair, the least one of all is taken.
    """
    to = {i: j for i, j, d in nearest if d < threshold}
    found = sorted((i, j) for i, j in to.items() if i < j and to.get(j) == i)
    if not found and to:
        _, i, j = min((d, min(i, j), max(i, j)) for i, j, d in nearest)
        found = [(i, j)]
    return found


def average_linkage(spark: SparkSession, profiles: DataFrame, threshold: float, sizes: list[int] | None = None) -> DataFrame:
    """(cluster, merged) of profiles (cluster, p): average linkage by cosine distance, cut at ``threshold``.

    ``merged`` is the least cluster of those joined. A row of the table has one cluster's distances to all others. Each round joins
    all clusters that are each other's nearest, which average linkage would join sooner or later as well. The
    distance to a joined cluster is the mean of those to its two parts, weighted by their sizes, so columns are combined
    within each row, and only the joined clusters' own rows are shuffled. Profiles of nothing but zeros, null profiles and
    profiles with values that are not finite are joined with nothing. ``sizes`` takes the number of clusters of each round.
    """
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x))
    measured = scratch.keep(spark, profiles.select("cluster", F.col("p").cast("array<double>").alias("p")).withColumn("norm", norm), "profiles")
    sound = (F.col("norm") > 0) & (F.col("norm") < float("inf"))  # null and NaN are not sound
    sound = F.coalesce(sound & ~F.isnan("norm"), F.lit(False))
    alone = measured.where(~sound).select("cluster", F.col("cluster").alias("merged"))
    units = measured.where(sound).select("cluster", F.transform("p", lambda x: x / F.col("norm")).alias("p"))
    n = units.count()
    if n > MAX_PROFILES:
        raise ValueError(f"{n} profiles are more than {MAX_PROFILES}: precluster them into fewer")
    if n < 2:
        return alone.unionByName(units.select("cluster", F.col("cluster").alias("merged")))
    named = scratch.keep(spark, scratch.numbered(spark, units, ["cluster"], "i"), "units")
    at = np.arange(n)  # where each profile's cluster stands now
    rounds = scratch.Rounds(spark, "linkage")
    state = rounds.keep(_tiles(spark, named.select("i", "p"), n))
    weight = np.ones(n, np.int64)
    while True:
        if sizes is not None:
            sizes.append(len(weight))
        least = state.select("i", F.array_min("row").alias("d"), (F.array_position("row", F.array_min("row")) - 1).alias("j"))
        pairs = _pairs([(r["i"], r["j"], r["d"]) for r in least.collect()], threshold)
        if not pairs or len(weight) < 2:
            break
        first, second = np.array(pairs).T
        partner = np.full(len(weight), -1)
        partner[first] = second
        stays = np.ones(len(weight), bool)
        stays[second] = False
        after = np.cumsum(stays) - 1  # the lesser of a pair keeps its place among those that stay
        after[second] = after[first]
        old = np.flatnonzero(stays)
        mate = partner[old]
        total = np.where(mate < 0, weight[old], weight[old] + weight[mate])
        # one row: for each column of the next table, the columns that it comes from and the first one's weight
        plan = spark.createDataFrame([(0, [(int(a), int(b), float(w)) for a, b, w in zip(old, mate, weight[old] / total)])], "one int, columns array<struct<a:int,b:int,w:double>>")
        # for each row: its place in the next table, and whether it is joined with another
        places = spark.createDataFrame([(i, int(t), bool(not stays[i] or partner[i] >= 0)) for i, t in enumerate(after)], "i bigint, to bigint, joined boolean")
        mean = lambda x, y, w: x * w + y * (1 - w)
        column = lambda c: F.when(c["b"] < 0, F.get("row", c["a"])).otherwise(mean(F.get("row", c["a"]), F.get("row", c["b"]), c["w"]))
        moved = state.withColumn("one", F.lit(0)).join(F.broadcast(plan), "one").join(F.broadcast(places), "i").select("i", "to", "joined", "size", F.transform("columns", column).alias("row"))
        two = moved.where("joined").groupBy("to").agg(F.sort_array(F.collect_list(F.struct("i", "size", "row"))).alias("r"))
        sum_of = F.col("r")[0]["size"] + F.col("r")[1]["size"]
        joined = two.select(F.col("to").alias("i"), sum_of.alias("size"), F.zip_with(F.col("r")[0]["row"], F.col("r")[1]["row"], lambda x, y: mean(x, y, F.col("r")[0]["size"] / sum_of)).alias("row"))
        state = rounds.keep(moved.where("not joined").select(F.col("to").alias("i"), "size", "row").unionByName(joined))
        weight, at = total, after[at]
    rounds.end()
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(at)], "i bigint, group bigint")
    grouped = named.select("cluster", "i").join(F.broadcast(labels), "i")
    out = grouped.join(grouped.groupBy("group").agg(F.min("cluster").alias("merged")), "group").select("cluster", "merged")
    return scratch.keep(spark, out.unionByName(alone), "labels")
