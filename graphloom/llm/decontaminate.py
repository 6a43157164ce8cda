"""Benchmark decontamination with a generalised suffix automaton.

Items are dealt to blocks of bounded size; Spark tasks build one automaton of each block's
words, written out as arrays. Documents stream through one automaton at a time and the longest match
that ends at each word is tracked. One block, which most benchmarks are, needs no shuffle. With
more, a filter of all windows' hashes goes first: documents that it rules out, nearly all of a corpus,
meet no automaton and are not shuffled; the others are written out, stream through block after block, and
meet the hits of all by the hash of their text. So the corpus is read twice, however many blocks there are.

Defined cases: a null or empty text has no words and no hit; an item without words has no
window; an item shorter than ``window`` words is one window; rows that repeat an item's id count as
one item; an empty benchmark hits nothing; rows that repeat an id, or have none, are rows of their
own; further columns are kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from . import text as tx

#: Item words of one automaton, about (blocks are half full on average): 70 bytes each as arrays, 200 in a task that builds or scans.
BLOCK_WORDS = 250_000
#: Words of a long item that stay together; its parts overlap, so that each window is in one of them.
PART_WORDS = 20_000
#: Bits of the filter for each window at least, and in all at most (128 MB; more windows let more documents through, none is lost).
WINDOW_BITS, MAX_FILTER_BITS = 32, 30
#: Bits set for a window, and bits of a shard of the filter that one task makes.
PROBES, SHARD_BITS = 8, 20


class SuffixAutomaton:
    """Generalised suffix automaton over integer words, being built.

    ``link`` and ``length`` are the usual suffix links and longest lengths. Edges are in one table
    by state and word; each state's words are a chain.
    """

    def __init__(self) -> None:
        self.edges: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.last_edge, self.words, self.before = array("i", [-1]), array("i"), array("i")

    def _state(self, link: int, length: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.last_edge.append(-1)
        return len(self.link) - 1

    def _join(self, state: int, word: int, to: int) -> None:
        self.edges[state << 32 | word] = to
        self.before.append(self.last_edge[state])
        self.last_edge[state] = len(self.words)
        self.words.append(word)

    def extend(self, last: int, word: int) -> int:
        """The state of what ``last`` stands for and one word more."""
        edges, link, length = self.edges, self.link, self.length
        to = edges.get(last << 32 | word)
        if to is not None:
            return to if length[to] == length[last] + 1 else self._split(last, word, to)
        new = self._state(0, length[last] + 1)
        at = last
        while at >= 0 and (at << 32 | word) not in edges:
            self._join(at, word, new)
            at = link[at]
        if at >= 0:
            to = edges[at << 32 | word]
            link[new] = to if length[to] == length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: int, to: int) -> int:
        edges, link = self.edges, self.link
        copy = self._state(link[to], self.length[at] + 1)
        edge = self.last_edge[to]
        while edge >= 0:
            self._join(copy, self.words[edge], edges[to << 32 | self.words[edge]])
            edge = self.before[edge]
        link[to] = copy
        while at >= 0 and edges.get(at << 32 | word) == to:
            edges[at << 32 | word] = copy
            at = link[at]
        return copy

    def window_ends(self, words: list[int], size: int) -> Iterator[int]:
        """The state at which each window of so many words of an item ends."""
        state = got = 0
        for word in words:
            state, got = self.edges[state << 32 | word], got + 1
            while self.length[self.link[state]] >= size:
                state = self.link[state]
                got = self.length[state]
            if got >= size:
                yield state


def build(items: list[tuple[str, np.ndarray]], window: int) -> dict[str, bytes | list[str]]:
    """The automaton of some items' hashed words as sorted arrays.

    ``ends`` are states at which windows end, ``sizes`` their windows' words and ``owners`` the items;
    ``near`` leads from a state to the nearest one up the links, itself included, at which windows end.
    """
    vocabulary = np.unique(np.concatenate([*[w for _, w in items], np.zeros(0, np.uint64)]))
    coded = [(name, np.searchsorted(vocabulary, w).tolist()) for name, w in items]
    a = SuffixAutomaton()
    for _, words in coded:
        last = 0
        for word in words:
            last = a.extend(last, word)
    names = sorted({name for name, words in coded if words})
    number = {name: i for i, name in enumerate(names)}
    ends = {(state, size, number[name]) for name, words in coded if words for size in [min(window, len(words))] for state in a.window_ends(words, size)}
    table = np.array(sorted(ends), dtype=np.int32).reshape(-1, 3)
    link, length = np.array(a.link, dtype=np.int32), np.array(a.length, dtype=np.int32)
    near = np.full(len(link), -1, dtype=np.int32)
    near[table[:, 0]] = table[:, 0]
    for state in np.argsort(length, kind="stable")[1:].tolist():
        if near[state] < 0:
            near[state] = near[link[state]]
    keys = np.fromiter(a.edges.keys(), np.int64, len(a.edges))
    order = np.argsort(keys)
    to = np.fromiter(a.edges.values(), np.int32, len(a.edges))[order]
    return {
        "vocabulary": vocabulary.tobytes(), "edges": keys[order].tobytes(), "targets": to.tobytes(), "link": link.tobytes(), "length": length.tobytes(), "near": near.tobytes(),
        "ends": table[:, 0].tobytes(), "sizes": table[:, 1].tobytes(), "owners": table[:, 2].tobytes(), "names": names,
    }


AUTOMATON = "block long, vocabulary binary, edges binary, targets binary, link binary, length binary, near binary, ends binary, sizes binary, owners binary, names array<string>"


class Matcher:
    """One block's automaton, ready to scan."""

    def __init__(self, parts: dict[str, bytes | list[str]]) -> None:
        self.vocabulary = np.frombuffer(parts["vocabulary"], np.uint64)
        self.edges = dict(zip(np.frombuffer(parts["edges"], np.int64).tolist(), np.frombuffer(parts["targets"], np.int32).tolist(), strict=True))
        self.link, self.length, self.near = (array("i", parts[c]) for c in ("link", "length", "near"))
        self.sizes, self.owners = array("i", parts["sizes"]), array("i", parts["owners"])
        # for each state, its windows' sizes in ascending order and where the owners of each size begin
        self.ends: dict[int, tuple[int, ...]] = {}
        ends, own = np.frombuffer(parts["ends"], np.int32), np.frombuffer(parts["sizes"], np.int32)
        lo = np.flatnonzero(np.append(True, (ends[1:] != ends[:-1]) | (own[1:] != own[:-1]))) if len(ends) else np.zeros(0, np.int64)
        for state, size, a in zip(ends[lo].tolist(), own[lo].tolist(), lo.tolist(), strict=True):
            self.ends[state] = (*self.ends.get(state, ()), size, a)
        self.stops = np.append(lo[1:], len(ends)).astype(np.int64)  # where the owners of each run end
        self.names = parts["names"]
        self.shortest = min(self.sizes, default=0)

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows, and the items whose windows occur.

        Only runs of words of the vocabulary, long enough for a window, can match.
        """
        if len(hashes) < self.shortest or not self.ends:
            return [], set()
        ids = np.searchsorted(self.vocabulary, hashes)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == hashes
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).view(np.int8)))
        lo, hi = edges[::2], edges[1::2]
        long = hi - lo >= self.shortest
        spans: list[tuple[int, int]] = []
        seen: set[int] = set()
        for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            self._walk(ids[a:b].tolist(), a, spans, seen)
        return spans, {self.names[i] for a in seen for i in self.owners[a : self.stops[np.searchsorted(self.stops, a, "right")]]}

    def _walk(self, words: list[int], at: int, spans: list[tuple[int, int]], seen: set[int]) -> None:
        """Merge what is covered into ``spans``; ``seen`` gets where the owners of occurring windows begin.

        Windows that end at one place are nested, so the longest covers it; owners are looked up once for a text,
        however many items share a window and however often it occurs.
        """
        edges, link, length, near, ends = self.edges, self.link, self.length, self.near, self.ends
        state = matched = 0
        for i, word in enumerate(words, at + 1):
            to = edges.get(state << 32 | word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = edges.get(state << 32 | word)
            if to is None:
                continue
            state, matched = to, matched + 1
            end, longest = near[state], 0
            while end >= 0:
                runs = ends[end]
                for r in range(0, len(runs), 2):
                    if runs[r] <= matched:
                        longest = max(longest, runs[r])
                        seen.add(runs[r + 1])
                end = near[link[end]] if link[end] >= 0 else -1
            if longest:
                start = i - longest
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _item_parts(window: int):
    """Hashed words of items in parts that overlap by a window less one word; all windows are in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            raw, at = tx.utf8(batch.column("text"))
            for lo, hi in tx.slices(at):
                low, own = tx.LOWER[raw[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
                starts, ends, first = tx.spans(low, own, tx.ALNUM)
                h = tx.word_hashes(low, starts, ends)
                for name, a, b in zip(batch.column("item_id").slice(lo, hi - lo).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for part in range(a, max(b - window + 1, a + 1), PART_WORDS) if b > a else ():
                        names.append(name if name is not None else "")
                        parts.append(h[part : min(b, part + PART_WORDS + window - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(p) // 8 for p in parts], pa.int64()), pa.array(parts, pa.binary())], ["item_id", "n", "words"])

    return run


def item_parts(spark: SparkSession, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, int]:
    """Parts of items as (item_id, n, words), written out, and their words in all."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    parts = scratch.keep(spark, items.mapInArrow(_item_parts(window), "item_id string, n long, words binary"), "items")
    return parts, parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class WindowFilter:
    """Which texts may hold a window of some item: bits set by the hashes of all windows, so that no such text is missed."""

    def __init__(self, sizes: list[int], bits: int, table: np.ndarray) -> None:
        self.sizes, self.bits, self.table = sizes, bits, table

    @staticmethod
    def probe(grams: np.ndarray, number: int, bits: int) -> np.ndarray:
        return (grams + np.uint64(number) * (tx.mix(grams) | np.uint64(1))) >> np.uint64(64 - bits)

    def holds(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For texts whose words begin at ``first``, whether one of their windows may be an item's."""
        out = np.zeros(len(first) - 1, dtype=bool)
        for size in self.sizes:
            grams = tx.grams(hashes, size)
            at = np.arange(len(grams))
            for number in range(PROBES):
                place = self.probe(grams, number, self.bits)
                stay = self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                grams, at = grams[stay], at[stay]
            row = np.searchsorted(first, at, "right") - 1
            out[row[at + size <= first[row + 1]]] = True
        return out


def _set_bits(window: int, bits: int):
    """The filter's bits of a batch of parts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
            grams = np.unique(np.concatenate([*[tx.grams(w, min(window, len(w))) for w in words], np.zeros(0, np.uint64)]))
            place = np.unique(np.concatenate([WindowFilter.probe(grams, number, bits) for number in range(PROBES)]))
            shard, low = (place >> np.uint64(SHARD_BITS)).astype(np.int64), (place & np.uint64((1 << SHARD_BITS) - 1)).astype("<u4")
            lo = np.flatnonzero(np.diff(shard, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(shard[lo]), pa.array([p.tobytes() for p in np.split(low, lo[1:])] if len(lo) else [], pa.binary())], ["shard", "places"])

    return run


def _shard(table: pa.Table) -> pa.Table:
    own = np.zeros(1 << SHARD_BITS, dtype=bool)
    for places in table.column("places").to_pylist():
        own[np.frombuffer(places, "<u4")] = True
    return pa.table({"shard": table.column("shard").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})


def window_filter(parts: DataFrame, total: int, window: int = 10) -> WindowFilter:
    """The filter of all windows of items with ``total`` words, made by tasks in shards of equal size."""
    bits = min(MAX_FILTER_BITS, max(SHARD_BITS, int(WINDOW_BITS * total - 1).bit_length()))
    sizes = sorted(r[0] for r in parts.select(F.least("n", F.lit(window))).distinct().collect())  # at most ``window`` rows
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = 1 << (SHARD_BITS - 3)
    shards = parts.mapInArrow(_set_bits(window, bits), "shard long, places binary").groupBy("shard").applyInArrow(_shard, "shard long, bits binary")
    for r in shards.toLocalIterator():  # 128 MB in all at most
        table[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return WindowFilter(sizes, bits, table)


def _sieve(windows, wanted: bool):
    """The rows that may hold a window, or those that cannot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = tx.utf8(batch.column("text"))
            found = [np.zeros(0, dtype=bool)]
            for lo, hi in tx.slices(at):
                low, own = tx.LOWER[raw[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
                starts, ends, first = tx.spans(low, own, tx.ALNUM)
                found.append(windows.value.holds(tx.word_hashes(low, starts, ends), first))
            yield batch.filter(pa.array(np.concatenate(found) == wanted))

    return run


def automata(spark: SparkSession, parts: DataFrame, total: int, window: int = 10, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """A row of arrays for each block of items, written out, and how many blocks there may be."""
    blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1  # twice as many as needed, as hashing deals unevenly
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("words").to_pylist(), strict=True))
        arrays = build([(name, np.frombuffer(w, np.uint64)) for name, w in rows], window)
        return pa.table({"block": table.column("block").slice(0, 1), **{k: pa.array([v], pa.list_(pa.string()) if k == "names" else pa.binary()) for k, v in arrays.items()}})

    return scratch.keep(spark, dealt.groupBy("block").applyInArrow(one, AUTOMATON), "automata"), blocks


#: What a pass makes of a batch, its rows' numbers of words, spans and items.
Finish = Callable[[pa.RecordBatch, list[int], list[list[list[int]]], list[list[str]]], pa.RecordBatch]


def _pass(parts, finish: Finish):
    """Scan documents with one automaton (none: count words only) and add what earlier blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(parts.value) if parts is not None else None
        for batch in batches:
            raw, at = tx.utf8(batch.column("text"))
            n_words, spans, items = [], [], []
            for lo, hi in tx.slices(at):
                low, own = tx.LOWER[raw[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
                starts, ends, first = tx.spans(low, own, tx.ALNUM)
                h = tx.word_hashes(low, starts, ends) if m else None
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    got, names = m.scan(h[a:b]) if m else ([], ())
                    n_words.append(b - a)
                    spans.append([[x, y, int(starts[a + x] - own[i]), int(ends[a + y - 1] - own[i])] for x, y in got])
                    items.append(sorted(names))
            if "found_spans" in batch.schema.names:
                for i, (s, x) in enumerate(zip(batch.column("found_spans").to_pylist(), batch.column("found_items").to_pylist(), strict=True)):
                    if s:
                        spans[i] += s
                        items[i] = sorted({*items[i], *x})
            yield finish(batch, n_words, spans, items)

    return run


_SPANS, _ITEMS = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())


def _hits(batch: pa.RecordBatch, n_words: list[int], spans: list, items: list) -> pa.RecordBatch:
    some = [i for i, s in enumerate(spans) if s]
    keys = [batch.column(c).take(pa.array(some, pa.int64())) for c in ("h1", "h2")]
    return pa.RecordBatch.from_arrays([*keys, pa.array([spans[i] for i in some], _SPANS), pa.array([items[i] for i in some], _ITEMS)], ["h1", "h2", "spans", "items"])


def matched(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, finish: Finish, schema, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What ``finish`` makes of documents and their matches; it gets batches of ``docs``, which has a column ``text``.

    A span is [first word, word after, first byte, byte after]; items are the sorted ids with windows
    that occur. Only one block's automaton is broadcast at a time.
    """
    tx.small_batches(docs)
    parts, total = item_parts(spark, benchmark, window)
    table, blocks = automata(spark, parts, total, window, block_words)
    fetch = lambda i: [{k: v if k == "names" else bytes(v) for k, v in r.asDict().items() if k != "block"} for r in table.where(F.col("block") == i).collect()]  # noqa: E731  one row, bounded by block_words
    sent = lambda rows: spark.sparkContext.broadcast(rows[0]) if rows else None
    if blocks == 1:
        return docs.mapInArrow(_pass(sent(fetch(0)), finish), schema)
    windows = spark.sparkContext.broadcast(window_filter(parts, total, window))
    clean = docs.mapInArrow(_sieve(windows, False), docs.schema).mapInArrow(_pass(None, finish), schema)
    some = docs.mapInArrow(_sieve(windows, True), docs.schema).withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(7), "text")})
    some = scratch.keep(spark, some, "suspects")
    keyed = some.select("text", F.col("_h1").alias("h1"), F.col("_h2").alias("h2"))
    hits = None
    for i in range(blocks):
        block = sent(fetch(i))
        if block is not None:
            own = scratch.keep(spark, keyed.mapInArrow(_pass(block, _hits), "h1 long, h2 long, spans array<array<bigint>>, items array<string>"), "hits")
            hits = own if hits is None else hits.union(own)
            block.destroy()
    once = hits.distinct().groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("found_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("found_items"))
    once = scratch.keep(spark, once, "found").withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    return clean.union(some.join(once, ["_h1", "_h2"], "left").drop("_h1", "_h2").mapInArrow(_pass(None, finish), schema))


def _hit_words(spans: list) -> int:
    return sum(hi - lo for lo, hi in _merged([(s[0], s[1]) for s in spans]))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, words in windows of items, items, and whether any window occurs."""

    def digest(batch: pa.RecordBatch, n_words: list[int], spans: list, items: list) -> pa.RecordBatch:
        hit = [_hit_words(s) for s in spans]
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in hit], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return matched(spark, rows, benchmark, digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", window, block_words)


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without the matched spans; those covered beyond ``max_coverage`` go. Columns as in ``docs``.

    A span reaches from its first word's first byte to its last word's last byte. ``n_chars``,
    where there is one, follows a changed text.
    """

    def cut(batch: pa.RecordBatch, n_words: list[int], spans: list, items: list) -> pa.RecordBatch:
        stay = [_hit_words(s) <= max_coverage * n for n, s in zip(n_words, spans, strict=True)]
        texts = batch.column("text").to_pylist()
        for i, own in enumerate(spans):
            if own and stay[i]:
                raw, out, at = texts[i].encode(), [], 0
                for lo, hi in _merged([(s[2], s[3]) for s in own]):
                    out.append(raw[at:lo])
                    at = hi
                texts[i] = b"".join([*out, raw[at:]]).decode()
        columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array([bool(s) for s in spans], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["row", "text", "changed"]).filter(pa.array(stay, pa.bool_()))

    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    out = matched(spark, packed, benchmark, cut, schema, window, block_words)
    kind = dict(docs.dtypes)
    new = {"text": F.col("text")} | ({"n_chars": F.when(F.col("changed"), F.length("text").cast(kind["n_chars"])).otherwise(F.col("row.n_chars"))} if "n_chars" in kind else {})
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
