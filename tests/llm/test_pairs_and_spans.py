"""Near copies, substrings, lines, benchmark windows and fingerprints against brute force."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chunks, decontaminate, fingerprints, jaccard, lines

from .conftest import sentence, table


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows, k, percent):
    own = {i: shingles(t, k) for i, t, _ in rows}
    low = {i: i for i in own}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in combinations(sorted(own), 2):
        x, y = own[a], own[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            low[q] = p
    return {i: (len(own[i]), find(i)) for i in own}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, varied, varied_rows, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark, varied, k, percent).collect()}
    assert got == linked(varied_rows, k, percent)


def test_components_when_most_buckets_are_frequent(spark, varied, varied_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 2)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark, varied).collect()}
    assert got == {i: c for i, (_, c) in linked(varied_rows, 3, 90).items()}


def test_components_when_short_keys_tie(spark, varied, varied_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CUT_BITS", 54)  # 3 bits of hash are left
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark, varied).collect()}
    assert got == {i: c for i, (_, c) in linked(varied_rows, 3, 90).items()}


def test_components_of_odd_rows(spark, odd, odd_rows, nothing):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(spark, odd).collect())
    want = linked(odd_rows, 3, 90)
    assert got == sorted((i, *want[i]) for i, _, _ in odd_rows)
    assert jaccard.link(spark, nothing).collect() == []


def test_keep_one_keeps_columns_and_the_least(spark, varied, varied_rows, nothing):
    kept = jaccard.keep_one(spark, varied)
    assert kept.columns == varied.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in linked(varied_rows, 5, 80).values()}
    assert jaccard.keep_one(spark, nothing).collect() == []


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in jaccard.components(spark, links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeated_passages_are_found(spark, varied, varied_rows):
    got = defaultdict(list)
    for r in chunks.repeated_spans(spark, varied).collect():
        got[r["doc_id"]].append(r)
    texts = {i: t for i, t, _ in varied_rows}
    for i, found in got.items():
        for r in found:  # every span stands, chunk by chunk, in documents with lesser ids
            assert r["n_words"] >= chunks.MIN_WORDS and r["first_doc_id"] < i
            part = texts[i][r["start"] : r["end"]]
            piece = part[len(part) // 2 : len(part) // 2 + 12]
            assert any(piece in texts[j] for j in texts if j < i)
    seen = {}
    for i in sorted(texts):
        w = texts[i].split()
        grams = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
        if any(seen.get(g, i) < i for g in grams):
            assert i in got, f"document {i} repeats 50 words"
        for g in grams:
            seen.setdefault(g, i)


def test_chunks_cover_texts_and_resist_shifts(spark, odd, nothing):
    import random

    text = sentence(random.Random(5), 500)
    at = np.array([0, len(text), 2 * len(text) + 7])
    raw = np.frombuffer((text + "ab cde " + text).encode(), np.uint8)
    first, second = chunks.cuts(raw, at)
    assert first[-1] == len(text) and second[-1] == len(text) + 7
    assert max(np.diff([0, *first])) <= chunks.MOST
    assert len({e + 7 for e in first} & set(second)) > 0.9 * len(first)
    spans = chunks.repeated_spans(spark, odd).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in spans} >= {(5, 4), (6, 4)} and 4 not in {r["doc_id"] for r in spans}
    assert chunks.repeated_spans(spark, nothing).collect() == []


def test_lines_match_exact_counts(spark):
    rows = []
    for i in range(60):
        t = [f"own line {i}", "on all sites", f"on half {i % 2}", "  on all sites  ", ""]
        rows.append((i, "\n".join(t), f"s{i % 15}"))
    docs = table(spark, rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.removed_lines(spark, docs, 15).collect()}
    seen = defaultdict(set)
    for _, t, s in rows:
        for x in t.split("\n"):
            seen[x.strip()].add(s)
    bad = {x for x, s in seen.items() if x and len(s) >= 15}
    first = {}
    for i, t, _ in rows:
        for p, x in enumerate(t.split("\n")):
            first.setdefault(x.strip(), (i, p))
    for i, t, _ in rows:
        ls = t.split("\n")
        kept = [x for p, x in enumerate(ls) if x.strip() not in bad or first[x.strip()] == (i, p)]
        assert got[i] == (sum(bool(x.strip()) for x in ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_threshold_follows_the_sites(spark):
    rows = [(i, f"own {i}\n" + "eleven sites show this" * (i % 20 < 11) + "\n" + "nine sites show this" * (i % 20 < 9), f"s{i % 20}") for i in range(40)]
    kept = "\n".join(r["text"] for r in lines.remove_boilerplate(spark, table(spark, rows)).collect())
    assert kept.count("eleven sites") == 1 and kept.count("nine sites") == 18
    many = spark.range(4000).select("id", F.concat(F.lit("s"), F.col("id")).alias("source"))
    assert lines.site_threshold(many) == 40 and lines.site_threshold(table(spark, rows)) == 10


def test_lines_of_odd_rows(spark, odd, odd_rows, nothing):
    out = lines.remove_boilerplate(spark, odd, 3)
    assert out.columns == odd.columns
    assert len(lines.removed_lines(spark, odd, 3).collect()) == len(odd_rows)
    assert {r["doc_id"] for r in out.collect()} >= {1, 2, 3, 4, 7, 8, 13}
    assert lines.remove_boilerplate(spark, nothing).collect() == [] and lines.removed_lines(spark, nothing).collect() == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        size = min(window, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "alphabeta gammadelta alphabeta gammadelta alphabeta gammadelta"), (10, "one two"), (2, None), (3, ""), (11, "One, two!"), (12, "b c"), (13, "mumu")]


@pytest.mark.parametrize("block", [60, 1_000_000])
def test_windows_match_brute_force(spark, odd, odd_rows, varied_rows, nothing, monkeypatch, block):
    if block == 60:
        monkeypatch.setattr(decontaminate, "PART_WORDS", 3)  # items in many overlapping parts, parts in several blocks
    items = ITEMS + [(20 + i, " ".join(t.split()[3:20]) + " end") for i, t, _ in varied_rows[:5 if block == 1 else 12]]
    rows = odd_rows + varied_rows
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(spark, table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 6, block).collect())
    assert got == sorted((i, *hits(t, items, 6)) for i, t, _ in rows)
    assert decontaminate.contamination(spark, nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_automaton_on_repetitive_items():
    items = [("a", [1, 1, 1, 2, 1, 1, 2]), ("b", [1, 2]), ("c", [2, 1, 1])]
    found = decontaminate.Matcher(decontaminate.build([(n, np.array(w, np.uint64)) for n, w in items], 4))
    spans, names = found.scan(np.array([3, 1, 1, 2, 1, 1, 2, 3, 1, 2], np.uint64))
    assert names == {"a", "b", "c"} and spans == [(1, 7), (8, 10)]
    assert found.scan(np.array([2, 2, 3], np.uint64)) == ([], set())


def test_a_full_block_is_small():
    """The words of a full block, as arrays: the sum of what is broadcast at a time."""
    rng = np.random.default_rng(5)
    words = rng.zipf(1.2, 60_000).astype(np.uint64)
    arrays = decontaminate.build([(str(i), words[lo : lo + 200]) for i, lo in enumerate(range(0, len(words), 200))], 10)
    assert sum(len(v) for k, v in arrays.items() if k != "names") < 150 * len(words)


@pytest.mark.parametrize("sizes", [[10], [1, 4, 10]])
def test_filter_of_windows_misses_none_and_passes_few(spark, sizes):
    rng = np.random.default_rng(9)
    item = [rng.integers(0, 1 << 62, 400 if n == 10 else n, dtype=np.uint64) for n in sizes for _ in range(20)]
    parts = spark.createDataFrame([(str(i), len(w), w.tobytes()) for i, w in enumerate(item)], "item_id string, n long, words binary")
    made = decontaminate.window_filter(parts, sum(map(len, item)), 10)
    assert made.sizes == sizes
    clean = rng.integers(0, 1 << 62, (2000, 50), dtype=np.uint64)
    assert made.holds(clean.ravel(), np.arange(0, clean.size + 1, 50)).sum() < 10
    for w in item:
        size = min(10, len(w))
        cut = w[len(w) - size :]
        texts = [clean[0], np.concatenate((clean[1], cut)), cut, clean[2], np.concatenate((cut[:-1], clean[3])), np.zeros(0, np.uint64)]
        got = made.holds(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        assert got.tolist()[:4] == [False, True, True, False] and not got[5]
    # a window that reaches from one text into the next is in neither
    w = item[-1]
    assert made.holds(w[:10], np.array([0, 5, 10])).tolist() == [False, False]


def test_documents_that_the_filter_rules_out_are_not_shuffled(spark, monkeypatch):
    rows = [(i, f"clean {i} words that no item has at all", "a") for i in range(300)] + [(300, "x one two three four five six y", "a")]
    items = spark.createDataFrame([(i, f"one two three four five six {i}") for i in range(30)], "item_id long, text string")
    names = []
    keep = decontaminate.scratch.keep
    monkeypatch.setattr(decontaminate.scratch, "keep", lambda s, df, name: names.append((name, keep(s, df, name))) or names[-1][1])
    out = decontaminate.contamination(spark, table(spark, rows), items, 6, 40)
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in out.collect() if r["n_hit"]} == {300: (6, 30)}
    assert out.count() == 301
    assert [df.count() for name, df in names if name == "suspects"] == [1]
    assert sum(name == "hits" for name, _ in names) > 1


def test_removed_spans(spark, odd, nothing):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "only this")], "item_id long, text string")
    docs = table(spark, [(1, "x Alpha, beta gamma! y z w q r", "a"), (2, "Only this", "a"), (3, "clean text", "a"), (4, None, "a")])
    out = {r["doc_id"]: r for r in decontaminate.remove_spans(spark, docs, items).collect()}
    assert out[1]["text"] == "x ! y z w q r" and out[1]["n_chars"] == 13
    assert 2 not in out and out[3]["text"] == "clean text" and out[4]["text"] is None
    empty = spark.createDataFrame([], "item_id long, text string")
    kept = decontaminate.remove_spans(spark, odd, empty)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontaminate.remove_spans(spark, nothing, items).collect() == []


def test_edited_texts_and_likeness(spark, odd, odd_rows, varied, varied_rows, nothing):
    for docs, rows in ((odd, odd_rows), (varied, varied_rows)):
        order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0], r[1]))
        want = []
        for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            q = len(t) // 4
            want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + u[:q]).encode()).hexdigest()))
        got = fingerprints.compare(spark, docs).collect()
        assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        prints = {}
        text = dict(order)
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.4
    assert fingerprints.compare(spark, nothing).collect() == []
    assert fingerprints.compare(spark, table(spark, [(7, "one row only", "a")])).first()["near_next"] == 1


def test_order_over_many_buckets(spark, varied, varied_rows):
    rows = fingerprints.in_order(spark, varied, split_rows=7).collect()
    guards = [r for r in rows if r["guard"]]
    assert sorted(r["doc_id"] for r in rows if not r["guard"]) == sorted(i for i, _, _ in varied_rows)
    assert len(guards) == len({r["bucket"] for r in rows}) > 3


def test_phrases_are_lempel_ziv():
    assert len(fingerprints.phrases([1, 1, 1, 1, 1, 1])) == 3  # 1, 11, 111
    assert len(fingerprints.phrases([1, 2, 1, 2, 1, 2, 1])) == 4  # 1, 2, 12, 121
    a, b = fingerprints.sketch(set(range(1, 4000))), fingerprints.sketch(set(range(1000, 5000)))
    assert abs(fingerprints.likeness(a, b) - 3000 / 5000) < 0.2


def plain_phrases(text):
    """Lempel-Ziv phrases of the words of a text, as tuples."""
    known, phrase = set(), ()
    for w in re.findall(r"\S+", text):
        phrase += (w,)
        if phrase not in known:
            known.add(phrase)
            phrase = ()
    return known


def test_likeness_estimates_that_of_plain_phrase_sets(spark, varied, varied_rows):
    text = dict((i, t) for i, t, _ in varied_rows)
    order = sorted(text)
    off = []
    for r in fingerprints.compare(spark, varied).collect():
        i = r["doc_id"]
        t, u = text[i], text[order[(order.index(i) + 1) % len(order)]]
        q = len(t) // 4
        mine = plain_phrases(t)
        for other, near in ((t[: len(t) - q] + u[:q], r["near_edited"]), (u, r["near_next"])):
            theirs = plain_phrases(other)
            both = len(mine | theirs)
            exact = len(mine & theirs) / both
            if not 0 < exact < 1:
                assert abs(near - exact) < 0.02  # 16 bits may collide
                continue
            off.append((near - exact) / np.sqrt(exact * (1 - exact) / min(fingerprints.PLACES, both)))
    # errors of drawing that many places at random: none on the whole, about one standard deviation each
    assert abs(np.mean(off)) < 4 / np.sqrt(len(off)) and 0.5 < np.sqrt(np.mean(np.square(off))) < 1.5


def test_rows_without_an_id_have_results(spark):
    a = "one two three four five six seven eight nine ten\n" * 2
    rows = [(None, a, "a"), (None, a, "a"), (None, None, "b"), (1, a, "a"), (1, a, None), (2, "", "a")]
    docs = table(spark, rows)
    items = spark.createDataFrame([(None, a), (1, None), (2, a)], "item_id long, text string")
    for found in (jaccard.link(spark, docs), lines.removed_lines(spark, docs, 2), decontaminate.contamination(spark, docs, items), fingerprints.compare(spark, docs)):
        assert sorted(str(r["doc_id"]) for r in found.collect()) == sorted(str(i) for i, _, _ in rows)
    assert jaccard.keep_one(spark, docs).count() == len(rows)
