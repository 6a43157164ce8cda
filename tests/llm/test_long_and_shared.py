"""Very long words, and windows that many benchmark items share."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import decontaminate, toxicity
from graphloom.llm import text as tx


def test_hash_of_a_word_in_slices(monkeypatch):
    raw = np.frombuffer(b"short " + b"abcdefghij" * 100 + b" " + bytes(range(97, 120)), dtype=np.uint8)
    starts, ends, _ = tx.spans(raw, np.array([0, len(raw)]), tx.SPACED)
    whole = tx.word_hashes(raw, starts, ends)
    monkeypatch.setattr(tx, "SLICE_BYTES", 64)
    assert tx.word_hashes(raw, starts, ends).tolist() == whole.tolist() and len(whole) == 3


def plain_buckets(word, hashed):
    """A word's buckets, n-gram by n-gram: the polynomial of each n-gram's bytes, mixed."""
    marked, out = b"<" + word + b">", [int(hashed)]
    for n in toxicity.NGRAMS:
        for i in range(len(marked) - n + 1):
            h = 0
            for b in marked[i : i + n]:
                h = (h * 0x100000001B3 + b + 1) % 2**64
            out.append((h + (n << 56)) % 2**64)
    return sorted((tx.mix(np.array(out, np.uint64)) & np.uint64(toxicity.BUCKETS - 1)).tolist())


@pytest.mark.parametrize("piece", [3, 16, 1 << 14])
def test_ngrams_in_pieces_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity, "PIECES", 2 * piece)
    raw, at = tx.utf8(pa.array(["a bb ccc dddd eeeee " + "xyz" * 40, "é" * 30, ""]))
    distinct, place, first, grams = toxicity.distinct_words(raw, at)
    found = [[] for _ in distinct]
    for buckets, word in grams:
        assert (np.diff(word) >= 0).all()
        for b, w in zip(buckets.tolist(), word.tolist(), strict=True):
            found[w].append(b)
    words = [w.encode() for w in ("a", "bb", "ccc", "dddd", "eeeee", "xyz" * 40, "é" * 30)]
    assert first.tolist() == [0, 6, 7, 7]
    for w, p in zip(words, place.tolist(), strict=True):
        assert sorted(found[p]) == plain_buckets(w, distinct[p])


def test_scores_equal_brute_force():
    """Each window's mean weight, word by word; the document's most toxic one into the logistic."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.25, np.array([1.5, -0.2, 0.1]))
    texts = ["one two three four five six seven", "a", "", "x" * 70_000 + " tail of words that goes on", "Ünïcode wörds HERE here"]
    raw, at = tx.utf8(pa.array(texts))
    got = model.scores(raw, at)
    for text, score in zip(texts, got.tolist(), strict=True):
        own, bounds = tx.utf8(pa.array([text]))
        low = tx.LOWER[own]
        starts, ends, _ = tx.spans(low, bounds, tx.ALNUM)
        each = [plain_buckets(low[a:b].tobytes(), h) for a, b, h in zip(starts, ends, tx.word_hashes(low, starts, ends), strict=True)] if len(starts) else []
        windows = [sum(each[i : i + toxicity.WINDOW], []) for i in range(0, len(each), toxicity.WINDOW)]
        peak = max((model.weights[w].mean() + model.bias for w in windows), default=model.bias)
        z = 1.5 * peak - 0.2 * np.log1p(len(windows)) + 0.1
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_memory_of_a_long_word():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, np.array([1.0, 0.0, 0.0]))
    raw, at = tx.utf8(pa.array(["q7z" * 4_000_000]))
    tracemalloc.start()
    assert model.scores(raw, at).tolist() == [0.5]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_windows_shared_by_many_items():
    """1000 items with one opening, which stands at 80,000 places of a text."""
    rng = np.random.default_rng(0)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    common = draw(200)
    items = [(f"i{i}", np.concatenate([common, draw(20)])) for i in range(1000)] + [("short", common[3:7]), ("other", draw(30))]
    m = decontaminate.Matcher(decontaminate.build(items, 10))
    text = np.concatenate([*[common] * 400, draw(5)])
    began = time.perf_counter()
    tracemalloc.start()
    spans, found = m.scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [(0, 80_000)] and found == {name for name, _ in items} - {"other"}
    assert time.perf_counter() - began < 5 and peak < 200e6


def test_nested_windows_of_several_sizes():
    """Items shorter than a window, nested and overlapping, against brute force."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        items = [(str(i), rng.integers(1, 4, rng.integers(1, 9)).astype(np.uint64)) for i in range(rng.integers(1, 7))]
        text = rng.integers(1, 4, 40).astype(np.uint64)
        spans, found = decontaminate.Matcher(decontaminate.build(items, 4)).scan(text)
        hit, want = set(), set()
        for name, w in items:
            size = min(4, len(w))
            for a in range(len(w) - size + 1):
                for b in range(len(text) - size + 1):
                    if (text[b : b + size] == w[a : a + size]).all():
                        hit |= set(range(b, b + size))
                        want.add(name)
        assert {p for lo, hi in spans for p in range(lo, hi)} == hit and found == want
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
