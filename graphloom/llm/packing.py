"""Best-fit packing of documents into sequences by linear grouping.

Lengths are bounded by the capacity, so a histogram of them describes any corpus in at most
``capacity`` numbers. The plan is made on the histogram: large lengths are sorted, cut into groups
of equal cardinality and rounded up to the largest of their group; configurations over these few
sizes are optimised; actual lengths are substituted; small lengths go best-fit into what is left.
The plan says, for ranks within a length, which sequences and offsets they get; its size depends
on the capacity and the groups, not on the number of documents. Ranks come from counts by block,
so no length is ever gathered in one task.

Defined cases: a null or empty text is the end token alone; a document longer than the capacity
is cut into pieces; repeated rows are packed each; no documents give no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from . import text as tx

CAPACITY = 2048
#: The id that ends each document.
END = 0
#: Groups of large lengths and the largest length that counts as small; the best of these is used.
PLANS = ((256, 192), (1024, 192), (1024, 64))
#: Pieces ranked together; a block of one length is at most so large on average.
BLOCK_ROWS = 4000

#: Letters and numbers below U+0250; other texts go to the tokenizer whole.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PIECE = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\t-\r -~\xa0-ɏ]|<\\|")
#: Bytes of texts that need no closer look: plain ASCII, and what code points up to U+023F are made of.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC9)])
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = True


def is_plain(raw: bytes) -> bool:
    """Whether words of the text can be encoded one by one; a fast test comes before the exact one."""
    return not raw.translate(None, _PLAIN) and b"<|" not in raw and (b"\xc2" not in raw or not _OTHER.search(raw.decode()))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, starts and ends of white-space separated words, and rows' first words.

    A comma or full stop that ends a word after an ASCII letter or digit is a word of its own, as it is
    a piece of its own for the tokenizer.
    """
    raw = tx.LOWER[raw]
    wide = np.flatnonzero(raw[:-1] == 0xC2)
    wide = wide[raw[wide + 1] == 0xA0]  # no-break space
    raw[wide] = raw[wide + 1] = 32
    starts, ends, first = tx.spans(raw, at, tx.SPACED)
    mark = raw[ends - 1]
    two = ((mark == 44) | (mark == 46)) & (ends - starts > 1) & _ALNUM[raw[ends - 2]]
    n = 1 + two
    upto = np.concatenate(([0], np.cumsum(n)))
    head = upto[:-1][two]
    starts, ends, cut = np.repeat(starts, n), np.repeat(ends, n), ends[two] - 1
    ends[head] = starts[head + 1] = cut
    return raw, starts, ends, upto[first]


class WordIds:
    """Ids of words, remembered between texts in a table of fixed size.

    The tokenizer's pre-tokenizer never joins characters across white space, so a text's ids are
    its words' ids in a row. A word's 64-bit hash names its slot, and a word that comes later takes
    the slot over; so the table never grows, and a wrong id needs two words of equal hash
    (less than one in 10**13 for a new word).
    """

    #: log2 of the slots, and ids of a word that a slot can hold: 27 bytes a slot.
    SLOT_BITS, WIDTH = 20, 8

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers

        self.path = path
        #: For words of plain texts, which are in normal form and lower case already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.whole = None
        vocabulary = self.plain.get_vocab()
        ends = [i for token, i in vocabulary.items() if token.endswith("</w>")]
        self.ends = np.zeros(max(ends) + 1, dtype=bool)
        self.ends[ends] = True
        slots = 1 << self.SLOT_BITS
        self.key = np.zeros(slots, dtype=np.uint64)
        self.count = np.zeros(slots, dtype=np.uint8)
        self.ids = np.zeros((slots, self.WIDTH), dtype=np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32)

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words in a row, and how many each word has."""
        pieces, n = [], []
        for word in new:
            if word.isalpha():
                pieces.append(word)
                n.append(1)
            else:
                own = _PIECE.findall(word)
                pieces += own
                n.append(len(own))
        ids = [np.array(self.plain.encode_batch_fast([" ".join(pieces[lo : lo + 4000])], add_special_tokens=False)[0].ids, dtype=np.uint32) for lo in range(0, len(pieces), 4000)]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        upto = np.concatenate(([0], np.flatnonzero(self.ends[flat]) + 1))
        return flat, np.diff(upto[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))])

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""
        found, example, place = np.unique(tx.word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        slot = (found >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        n = self.count[slot].astype(np.int64)
        known = (self.key[slot] == found) & (n > 0)
        old, missing = np.flatnonzero(known), np.flatnonzero(~known)
        flat = self.ids[slot[old]][np.arange(self.WIDTH) < n[old][:, None]].astype(np.uint32)
        begin = np.zeros(len(found), dtype=np.int64)
        begin[old] = np.cumsum(n[old]) - n[old]
        if len(missing):
            whole = raw.tobytes()
            own, size = self.learn([whole[a:b].decode().lower() for a, b in zip(starts[example[missing]].tolist(), ends[example[missing]].tolist(), strict=True)])
            n[missing] = size
            begin[missing] = len(flat) + np.cumsum(size) - size
            flat = np.concatenate([flat, own])
            short = missing[(size <= self.WIDTH) & (size > 0)]
            self.key[slot[short]], self.count[slot[short]] = found[short], n[short]
            self.ids[slot[short]] = flat[np.minimum(begin[short][:, None] + np.arange(self.WIDTH), len(flat) - 1)]
        each = n[place]
        return flat[np.repeat(begin[place] - (np.cumsum(each) - each), each) + np.arange(each.sum())], each

    def other(self, text: str) -> np.ndarray:
        """Ids of a text by the tokenizer as it is."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        raw, at = tx.utf8(column, self)
        for lo, hi in tx.slices(at):
            part, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            whole = part.tobytes()
            plain = [is_plain(whole[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            low, starts, ends, first = words(part, own)
            use = np.repeat(plain, np.diff(first))
            flat, n = self.of(low, starts[use], ends[use])
            upto = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(np.where(plain, np.diff(first), 0))))].tolist()
            for i, ok in enumerate(plain):
                yield flat[upto[i] : upto[i + 1]] if ok else self.other(whole[own[i] : own[i + 1]].decode())


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tx.kept(path, WordIds)  # a worker process keeps what it learned for its next tasks
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids.encode(batch.column("text")), strict=True):
                raw = np.append(own, np.uint32(END)).astype("<u4").tobytes()
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    tx.small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cut(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where each rank of each length goes; made from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = PLANS[0][0], small: int = PLANS[0][1]) -> None:
        self.capacity = capacity
        self.ranks = dict.fromkeys(histogram, 0)
        self.sequences = 0
        #: (length, first rank, items, first sequence, items per sequence, offset)
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        #: Sequences by free tokens: runs of (first sequence, sequences).
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        left = dict(histogram)
        if full := left.pop(capacity, 0):
            self._place(capacity, full, self._open(full), 1, 0)
        large = self._group(sorted(((n, c) for n, c in left.items() if n > small), reverse=True), groups)
        for config, times in self._configurations(large):
            self._substitute(large, config, times)
        for length, count in sorted(((n, c) for n, c in left.items() if n <= small), reverse=True):
            self._best_fit(length, count)

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _place(self, length: int, items: int, first: int, per: int, offset: int) -> None:
        self.segments.append((length, self.ranks[length], items, first, per, offset))
        self.ranks[length] += items

    def _leave(self, free: int, first: int, n: int) -> None:
        if free and n:
            if free not in self.free:
                self.free[free] = []
                insort(self.sizes, free)
            self.free[free].append((first, n))

    @staticmethod
    def _group(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
        """Groups of equal cardinality, each a queue of [length, count], longest first."""
        each = -(-sum(c for _, c in lengths) // groups) or 1
        out: list[list[list[int]]] = []
        room = 0
        for length, count in lengths:
            while count:
                if not room:
                    out.append([])
                    room = each
                took = min(room, count)
                out[-1].append([length, took])
                room -= took
                count -= took
        return out

    def _configurations(self, large: list[list[list[int]]]) -> Iterator[tuple[list[int], int]]:
        """Configurations of group indices and how often each is used, until no group is left.

        The largest group that is left comes first; the rest of the sequence is filled as far as a
        subset of the rounded sizes can, by a bounded subset sum over bit sets.
        """
        size = [g[0][0] for g in large]
        left = [sum(c for _, c in g) for g in large]
        for top in range(len(large)):
            while left[top]:
                room = self.capacity - size[top]
                left[top] -= 1
                live = [g for g in range(top, len(large)) if left[g] and size[g] <= room]
                mask, reach = (1 << (room + 1)) - 1, [1]
                for g in live:
                    bits = reach[-1]
                    for _ in range(min(left[g], room // size[g])):
                        more = (bits | (bits << size[g])) & mask
                        if more == bits:
                            break
                        bits = more
                    reach.append(bits)
                    if bits >> room & 1:
                        break
                total = reach[-1].bit_length() - 1
                config = [top]
                for i in range(len(reach) - 1, 0, -1):
                    g = live[i - 1]
                    while not reach[i - 1] >> total & 1:
                        config.append(g)
                        total -= size[g]
                left[top] += 1
                times = min(left[g] // config.count(g) for g in set(config))
                for g in config:
                    left[g] -= times
                yield config, times

    def _substitute(self, large: list[list[list[int]]], config: list[int], times: int) -> None:
        """Give the slots of a configuration actual lengths of their groups."""
        uses = {g: config.count(g) for g in config}
        while times:
            n = times
            for g, u in uses.items():
                n = min(n, max(1, large[g][0][1] // u))
            first, offset = self._open(n), 0
            for g in config:
                front = large[g][0]
                self._place(front[0], n, first, 1, offset)
                offset += front[0]
                front[1] -= n
                if not front[1]:
                    large[g].pop(0)
            self._leave(self.capacity - offset, first, n)
            times -= n

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.sizes, length)
            if at == len(self.sizes):
                per = self.capacity // length
                n = -(-count // per)
                self._leave(self.capacity, self._open(n), n)
                continue
            free = self.sizes[at]
            first, n = self.free[free].pop()
            if not self.free[free]:
                del self.free[free]
                self.sizes.pop(at)
            per = min(free // length, count)
            used = min(n, count // per)
            self._place(length, used * per, first, per, self.capacity - free)
            self._leave(free - per * length, first, used)
            self._leave(free, first + used, n - used)
            count -= used * per

    def table(self) -> tuple[np.ndarray, ...]:
        """Segments in order of (length, first rank), as arrays."""
        rows = np.array(sorted(self.segments), dtype=np.int64).reshape(-1, 6)
        return tuple(rows.T)


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences among a few settings."""
    return min((Plan(histogram, capacity, groups, small) for groups, small in PLANS), key=lambda p: p.sequences)


def _assign(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, per, offset = plan.value
        keys = (length << 44) + rank
        for b in batches:
            n, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (n << 44) + r, "right") - 1
            q = r - rank[at]
            columns = [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[at] + q // per[at]), pa.array(offset[at] + q % per[at] * n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    cut = scratch.keep(spark, pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_plan(histogram, capacity).table())
    blocks = max(1, -(-sum(histogram.values()) // BLOCK_ROWS))
    keyed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = keyed.groupBy("length", "block").count()
    before = before.select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = keyed.withColumn("within", within).join(before, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(_assign(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
