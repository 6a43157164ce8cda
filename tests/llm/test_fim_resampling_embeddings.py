"""Fill-in-middle, importance resampling and embedding near-duplicates against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import embeddings, fim, resampling

from .conftest import sentence, table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fim(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@given(st.integers(0, 500), st.text(alphabet="ab <PSM>\n\t é\U0001f600", max_size=60), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_units_forms_and_round_trip(doc_id, text, part):
    assert fim.unit_ends(text, part).tolist() == np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()
    got = fim.transform(doc_id, text)
    assert got == plain_fim(doc_id, text)
    assert fim.restore(got[4], got[1]) == text


def test_fim_over_a_table(spark, odd, odd_rows, varied, varied_rows, nothing):
    more = [(70 + i, f"{m} in a text", "a") for i, m in enumerate(("<P>", "<S>", "<M>"))] + [(None, "no id " * 9, "a"), (None, None, "a")]
    rows = odd_rows + varied_rows + more
    got = fim.fill_in_middle(odd.unionByName(varied).unionByName(table(spark, more))).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_fim(i, t)) for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = fim.digests(odd.unionByName(varied)).collect()
    want = [(i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), sha(t or "")) for i, t, _ in odd_rows + varied_rows]
    assert Counter(map(tuple, digests)) == Counter(want)
    assert fim.digests(nothing).collect() == []


def test_fim_of_long_texts():
    began = time.perf_counter()
    for text in ("a " * 1_500_000, "x" * 3_000_000, " " * 3_000_000, "ab\n" * 700_000 + "é" * 700_000):
        for doc_id in (3, 4, 5, 6):
            n, form, *_, output = fim.transform(doc_id, text)
            assert fim.restore(output, form) == text
        assert n == len(UNIT.findall(text))
    assert time.perf_counter() - began < 60


@given(st.lists(st.binary(min_size=1, max_size=900), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_checksums_of_spans(parts):
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert resampling.checksums(raw, starts, ends).tolist() == [zlib.crc32(p) for p in parts]


def test_checksum_of_a_long_word():
    raw = np.frombuffer(random.Random(1).randbytes(3_000_000), dtype=np.uint8)
    spans = [(0, 3_000_000), (5, 700_001), (9, 40), (100, 356), (100, 357)]
    got = resampling.checksums(raw, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in spans]


def plain_resample(docs, target, percent, min_words, buckets):
    def features(t):
        w = WORD.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= min_words)
    return Counter((r[0], *r[2:]) for r in rows), able[: math.floor(percent * len(able) / 100)]


@pytest.mark.parametrize(("percent", "buckets"), [(5, 10_000), (40, 97)])
def test_resampling_equals_plain_python(spark, odd, odd_rows, varied, varied_rows, nothing, percent, buckets):
    long = [(5000, "word " * 90_000 + "y" * 400_000 + " Final,words", "a"), (None, "no id " * 30, "a")]
    rows = [(i, t) for i, t, _ in odd_rows + varied_rows + long]
    target = [sentence(random.Random(i), 40) for i in range(5)] + [None, ""]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = resampling.resample(spark, odd.unionByName(varied).unionByName(table(spark, long)), items, percent, buckets=buckets).collect()
    all_rows, drawn = plain_resample(rows, target, percent, resampling.MIN_WORDS, buckets)
    assert Counter(r[:4] for r in map(tuple, got)) == all_rows
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn
    assert resampling.resample(spark, nothing, items).collect() == []
    empty = resampling.resample(spark, odd, items.where("false")).collect()
    assert len(empty) == len(odd_rows)


def plain_links(vectors):
    """(n_links, component) by all pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in vectors]
    n = len(vectors)
    unit = [np.array(v, float) / max(abs(c) for c in v) if k else None for k, (_, v) in zip(ok, vectors, strict=True)]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    near = [{j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and vectors[i][0] is not None and vectors[j][0] is not None and unit[i] @ unit[j] >= 0.9} for i in range(n)]
    component = [None] * n
    for i in range(n):
        if component[i] is None:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            ids = [vectors[j][0] for j in group]
            for j in group:
                component[j] = min(ids) if None not in ids else None
    return [(v, len(a), c) for (v, _), a, c in zip(vectors, near, component, strict=True)]


VECTORS = "vec_id long, embedding array<double>, label int, node long, ball long, key int"


def vector_table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in vectors], VECTORS)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    odd += [(7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0, -0.0]), (8, [1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.01]), (10, [1e308, 1e308, 0.0]), (11, [5e-324, 5e-324, 0.0]), (12, [1.0]), (13, [2.0]), (14, [-1.0])]
    odd += [(15, [1.0, 0.0]), (16, [1.0, 0.1])]
    got = embeddings.near(spark, vector_table(spark, odd)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(plain_links(odd))
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    assert embeddings.near(spark, vector_table(spark, [])).collect() == []


@pytest.mark.parametrize(("spread", "length"), [(0.15, 24), (0.3, 24), (0.5, 8), (0.2, 3)])
def test_near_vectors_against_all_pairs(spark, spread, length):
    """Copies, tight groups, loose ones beyond half the angle, a chain: no link below the threshold, nearly all found."""
    rng = np.random.default_rng(int(spread * 100))
    vectors = []
    for _ in range(25):
        base = rng.standard_normal(length)
        for _ in range(int(rng.choice([1, 2, 5, 20]))):
            vectors.append(base + rng.standard_normal(length) * spread * rng.choice([0.0, 0.3, 1.0]))
    vectors += [np.array([math.cos(a), math.sin(a), *[0.0] * (length - 2)]) for a in np.linspace(0, 3, 12)]
    order = rng.permutation(len(vectors))
    table_ = [(int(i), vectors[j].tolist()) for i, j in enumerate(order)]
    want = {v: (n, c) for v, n, c in plain_links(table_)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near(spark, vector_table(spark, table_)).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    if length > 3:  # in few dimensions all groups touch, and one bridge at the very threshold parts a component of nearly all
        assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.9


def test_large_groups_never_become_pairs(spark, monkeypatch):
    """A third of all rows are near copies; blocks are small, so every path is taken, and counts are exact."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base, loose = rng.standard_normal(16), rng.standard_normal(16)
    x = np.concatenate([base + 0.05 * rng.standard_normal((200, 16)), loose + 0.33 * rng.standard_normal((120, 16)), rng.standard_normal((280, 16))])
    vectors = [(i, v.tolist()) for i, v in enumerate(x[rng.permutation(len(x))])]
    want = {v: (n, c) for v, n, c in plain_links(vectors)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near(spark, vector_table(spark, vectors)).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
