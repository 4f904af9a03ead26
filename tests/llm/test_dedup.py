"""Exact, near and substring deduplication against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripletlab.llm import bagminhash as B
from tripletlab.llm import common, exact, fmindex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNe"), (6, "É"), (7, "é"), (8, "one "), (9, "x " * 30_000), (10, "one"), (10, "one")]


def docs_of(spark, rows, extra=False):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("id", "rep", "bucket", "owner", "size", "hash", "key", "doc", "n", "kept", "text_sha256"):
            d = d.withColumn(c, F.lit("clash"))
    return d


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = [*EDGE, (None, "one"), (None, "alone")]
    got = exact.exact_groups(docs_of(spark, rows, True), keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        k = (max(ids) if keep == "largest" else min(ids)) if ids else None
        want[(i, k, len(groups[lower(t)]), i == k, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_trie_and_spill():
    random.seed(1)
    texts = ["".join(random.choice("ab") for _ in range(random.randrange(9))).encode() for _ in range(500)]
    t, out = exact.PatriciaTrie(), Counter()
    low = {}
    for i, x in enumerate(texts):
        t.insert(x, i)
        low.setdefault(x, i)
        if t.weight > 40:
            for text, owner, n in t.spill(20):
                out[text] += n
    for text, owner, n in t.terminals():
        out[text] += n
    assert out == Counter(texts)
    full = exact.PatriciaTrie()
    for i, x in enumerate(texts):
        full.insert(x, i)
    assert {a: b for a, b, _ in full.terminals()} == low


def test_exact_string_identifiers_and_odd_names(spark):
    rows = [("b", "One"), ("a", "oNe"), (None, "one"), ("c", None), ("d", "")]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("odd`name", F.lit(1)).withColumn("t", F.lit(2))
    got = exact.exact_groups(d, keep="largest", carry=["odd`name", "t", "text"]).collect()
    assert sorted((r.doc_id or "", r.keep_id, r.group_size, r.kept, r["odd`name"], r.t) for r in got) == [("", "b", 3, False, 1, 2), ("a", "b", 3, False, 1, 2), ("b", "b", 3, True, 1, 2), ("c", "d", 2, False, 1, 2), ("d", "d", 2, True, 1, 2)]
    assert {r.text for r in got} == {t for _, t in rows}


def test_exact_empty_table(spark):
    assert exact.exact_groups(docs_of(spark, [])).count() == 0


def test_words_split_like_the_rule():
    random.seed(2)
    texts = [None, "", " ", "\ta\n"] + ["".join(random.choice("ab \t\né \x1c") for _ in range(random.randrange(12))) for _ in range(300)]
    w = common.Words(pa.array(texts, pa.string()))
    want = [(i, x.encode()) for i, s in enumerate(texts) for x in WORD.findall(s or "")]
    assert [(int(d), w.data[a:b].tobytes()) for d, a, b in zip(w.doc, w.start, w.end)] == want
    by = {}
    for (_, x), h in zip(want, w.hash.tolist()):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    n = 300
    sh = B.mix(np.arange(1, n + 1).astype(np.uint64))
    for a, b in ((rng.integers(1, 9, n), rng.integers(1, 9, n)), (np.ones(n, int), np.where(np.arange(n) < 240, 1, 0)), (np.full(n, 5), np.full(n, 3))):
        row = np.concatenate([np.zeros(n, int), np.ones((b > 0).sum(), int)])
        o = B.signatures(row, np.concatenate([sh, sh[b > 0]]), np.concatenate([a, b[b > 0]]), 2, 4096)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((o[0] == o[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5 + 1e-9


def shingles(t, k=5):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute_components(rows, threshold=0.8):
    ms = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in ms}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(ms)):
        for y in range(x):
            a, b = ms[x][1], ms[y][1]
            o, n = sum((a & b).values()), sum(a.values()) + sum(b.values())
            if (n and o / (n - o) >= threshold) or (not n and a == b):
                p, q = find(ms[x][0]), find(ms[y][0])
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in ms}


def near_rows(n_groups=6, size=14):
    random.seed(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n_groups):
        base = [random.choice(vocab) for _ in range(80)]
        for k in range(size):
            w = list(base)
            for _ in range(random.randrange(0, 4)):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append((len(rows) * 3 + g, " ".join(w)))
    return rows + [(9001, None), (9002, ""), (9003, "few words"), (9004, "few words"), (9005, "a " * 500), (9006, "a " * 450)]


@pytest.mark.parametrize("turns", [0, 1])
def test_near_groups_match_brute_force(spark, turns):
    rows = near_rows()
    got = B.near_groups(docs_of(spark, rows, True), turns=turns).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_near_groups_edges(spark):
    assert B.near_groups(docs_of(spark, [])).count() == 0
    got = B.near_groups(docs_of(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True)]


@pytest.mark.parametrize("turns", [0, 1])
def test_near_groups_with_repeated_identifiers(spark, turns):
    """Unrelated texts under one identifier are documents of their own."""
    random.seed(11)
    base, other = (" ".join(f"{c}{random.randrange(99)}" for _ in range(60)) for c in "ab")
    rows = [(1, base), (2, base + " more"), (2, other), (3, other + " x"), (3, base), (5, "alone one two three four five"), (5, base + " end"), (2, other)]
    got = B.near_groups(docs_of(spark, rows, True), turns=turns).collect()
    want = Counter([(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (3, 1, False), (5, 5, True), (5, 1, False)])
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == want
    twice = B.near_groups(docs_of(spark, [(1, base), (1, base + " more")]), turns=turns).collect()
    assert sorted(r.kept for r in twice) == [False, True]


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, one_task):
    random.seed(3)
    e = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    want = {x: find(x) for x in up if x != find(x) or any(find(y) == x for y in up if y != x)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(e, "a long, b long"), one_task=one_task).collect()}
    assert got == want


def brute_windows(rows, span):
    first, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in rows if d is not None}
    for d in sorted(words):
        for s in range(len(words[d]) - span + 1):
            first.setdefault(tuple(words[d][s : s + span]), (d, s))
    for d, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] != (d, s):
                gone[s : s + span] = [True] * span
        out[d] = " ".join(x for x, g in zip(w, gone) if not g)
    return out


@pytest.mark.parametrize("span", [8, 20])
def test_substrings_match_brute_force(spark, span):
    random.seed(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(random.choice("ab") for _ in range(random.randrange(60)))) for i in range(50)]
    rows += [(60 + i, f"u{i} v{i} {passage} y{i}") for i in range(30)]
    rows += [(100, None), (101, ""), (102, "a " * 500), (103, "a b " * 300), (104, "x y z " * 100), (105, "é \x1c " * 50)]
    got = fmindex.remove_repeats(docs_of(spark, rows, True), span=span).collect()
    want = brute_windows(rows, span)
    assert {r.doc_id: r.kept_text for r in got} == want
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("span", [8, 20])
def test_substrings_of_every_period(spark, span):
    """Text that repeats itself at any distance, in one document and nowhere else."""
    rows = [(p, " ".join(f"w{p}x{j % p}" for j in range(3 * p + 2 * span))) for p in range(1, 31)]
    got = {r.doc_id: r.kept_text for r in fmindex.remove_repeats(docs_of(spark, rows, True), span=span).collect()}
    assert got == brute_windows(rows, span)
    assert all(len(got[p].split()) == p for p, _ in rows)


def test_substring_edges(spark):
    assert fmindex.remove_repeats(docs_of(spark, [])).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    got = fmindex.remove_repeats(docs_of(spark, [(None, t), (1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def brute_rows(rows, span=20):
    """Kept words of every row, where rows may repeat an identifier."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for k, (d, _) in enumerate(rows):
        for s in range(len(words[k]) - span + 1):
            seen.setdefault(tuple(words[k][s : s + span]), []).append((d, rows[k][1], s))
    out = []
    for k, (d, t) in enumerate(rows):
        gone = [False] * len(words[k])
        for s in range(len(words[k]) - span + 1):
            if any(e < d or (e == d and u == t and z < s) for e, u, z in seen[tuple(words[k][s : s + span])]):
                gone[s : s + span] = [True] * span
        out.append((d, " ".join(x for x, g in zip(words[k], gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("limits", [{}, {"hot_runs": 0}, {"hot_runs": 30}])
def test_substrings_with_repeated_identifiers_and_hot_keys(spark, limits):
    """Rows that repeat an identifier lose words only to smaller identifiers and
    to themselves; keys split window by window give the same answer."""
    random.seed(6)
    passage = " ".join(f"p{i}" for i in range(50))
    own = lambda i: " ".join(f"o{i}x{j}" for j in range(25))
    rows = [(0, passage), (1, passage), (1, own(1)), (2, own(2) + " " + own(2)), (2, "a " + own(2)), (2, own(2) + " b"), (3, own(2)), (3, own(2)), (-4, own(9) + " x"), (-4, own(9) + " y")]
    rows += [(10 + i // 2, f"u{i} v{i} {passage} y{i}\tz{i}" + (" " + passage.replace(" ", "\n")) * (i % 3 == 0)) for i in range(60)]
    got = fmindex.remove_repeats(docs_of(spark, rows, True), **limits).collect()
    assert Counter((r.doc_id, r.kept_text) for r in got) == brute_rows(rows)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 500)
    w = fmindex.WaveletMatrix(seq, 37)
    c, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert (w.rank(c, at) == [(seq[:a] == s).sum() for s, a in zip(c, at)]).all()
