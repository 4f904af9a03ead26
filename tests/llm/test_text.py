"""Tokenisation, personal data, quality, packing, sharding."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletlab.llm import bpe, packing, quality, sanitise, shard


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


# -- BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_matches_the_library(library):
    tok = bpe.load(bpe.tokenizer_path())
    random.seed(1)
    letters = "abcdeé ß\n\t'st  re<|endoftext|>0123 ٣中文🙂\x1c\x85​ ñA.!-"
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 3000, "x<|endoftext|>y<|endoftext|>", "the" * 2000]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 64)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert tok.encode(t) == want
        assert tok.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_query_and_round_trip(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (None, "naïve"), (3, "Hello  world"), (4, "long " * 20_000)]
    d = frame(spark, rows).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = bpe.encode(d, digests=True)
    for r in got.collect():
        t = next(t for i, t in rows if i == r.doc_id) or ""
        want = library.encode(t, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.text for r in bpe.decode(got).collect()} == {t or "" for _, t in rows}
    assert bpe.encode(frame(spark, [])).count() == 0


# -- personal data -----------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x // 10 + x % 10 for i, c in enumerate(reversed(d)) for x in [int(c) * (2 if i % 2 else 1)]) % 10 == 0


def valid(k, v):
    d = re.sub("[^0-9]", "", v)
    if k == "email":
        return True
    if k == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    return 16 <= len(d) <= 19 and luhn(d) if k == "card" else 8 <= len(d) <= 15


def plain_spans(t):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], t or "") if valid(k, m.group())]


def test_base_spans_match_plain_patterns(spark):
    random.seed(5)
    letters = "a.@-+_ 0123456789()é🙂,"
    rows = [(i, "".join(random.choice(letters) for _ in range(random.randrange(80)))) for i in range(1500)]
    rows += [(9001, "a@b.c@d.e_x@y.zz"), (9002, "4111 1111 1111 1111 x 4111-1111-1111-1111 41111111111111111"), (9003, "+1 (555) 123-4567."), (9004, "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1")]
    rows += [(9005, None), (9006, ""), (9007, "1" * 20_000), (9008, "a" * 50_000), (9009, "a@" + "b." * 5_000 + "c"), (9010, "x@y.z " * 700), (9011, "- 1" * 4_000)]
    d = frame(spark, rows).withColumn("spans", F.lit("clash")).withColumn("_key", F.lit(1))
    got = sanitise.find_spans(d).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert [(x.kind, x.s, x.e) for x in r.spans] == plain_spans(texts[r._id])


def test_disclosing_terms(spark):
    rows = [(i, f"number {i} words here and mister zorblax lives at bob@x.org near the quiet lake {i * i}") for i in range(6)]
    rows += [(100 + i, f"common plain text number {i} about the quiet lake and words here and lives near {i * 7}") for i in range(200)]
    rows += [(400, None), (401, ""), (0, rows[0][1])]
    out = {r.doc_id: r.text for r in sanitise.redact(frame(spark, rows)).collect()}
    assert "zorblax" not in out[0] and "bob@x.org" not in out[0] and "quiet lake" in out[0]
    for i, t in rows:
        if i >= 100:
            assert out[i] == t
    copies = [(i, "mister zorblax lives at bob@x.org near here") for i in range(6)] + [(100 + i, f"plain text number {i}") for i in range(50)]
    assert "zorblax" in sanitise.redact(frame(spark, copies)).where("doc_id = 1").first().text  # copies are no evidence


def plain_terms(rows, alpha):
    """Spans of kind term by brute force: df, n, PMI and IC over distinct texts."""
    texts = {t or "" for _, t in rows}
    n = len(texts)
    term = lambda t: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]+", t) if m.end() - m.start() >= 3]
    ents = {t: {(k, t[a:b].lower()) for k, a, b in plain_spans(t)} for t in texts}
    words = {t: {w for _, _, w in term(t)} for t in texts}
    df_e, df_t, both = Counter(), Counter(), Counter()
    for t in texts:
        df_e.update(ents[t])
        df_t.update(words[t])
        both.update((e, w) for e in ents[t] for w in words[t])
    told = {}
    for (e, w), k in both.items():
        if df_e[e] < n and math.log2(n * k / (df_e[e] * df_t[w])) * k / (k + 1) >= alpha * math.log2(n / df_e[e]):
            told.setdefault(e, set()).add(w)
    out = {}
    for t in texts:
        flagged = set().union(*[told.get(e, set()) for e in ents[t]])
        out[t] = [(a, b) for a, b, w in term(t) if w in flagged and not any(x < b and a < y for _, x, y in plain_spans(t))]
    return out


@pytest.mark.parametrize("alpha", [0.7, 0.3])
@pytest.mark.parametrize("few", [0, 50_000])
def test_terms_match_brute_force(spark, alpha, few):
    random.seed(9)
    vocab = ["Alpha", "beta", "Gamma", "délta", "omega", "ab", "kappa", "Sigma"]
    mails = ["bob@x.org", "Bob@X.org", "ann@y.net", "10.0.0.1", "+1 555 123 4567"]
    tells = {"bob@x.org": "Zorblax", "Bob@X.org": "zorblax", "ann@y.net": "Quimby", "10.0.0.1": "Gateway", "+1 555 123 4567": "Landline"}
    rows = [(1, None), (2, "")]
    for i in range(160):
        w = [random.choice(vocab) for _ in range(random.randrange(2, 9))] + [f"n{i}"]
        for m in random.sample(mails, random.choice([0, 0, 1, 1, 2])):
            w += [m, tells[m]] if random.random() < 0.9 else [m]
        random.shuffle(w)
        rows.append((10 + i, " ".join(w)))
    rows += [rows[k] for k in (5, 5, 9)] + [(900 + i, rows[5][1]) for i in range(20)]  # copies are no evidence
    want = plain_terms(rows, alpha)
    assert any(want.values())
    d = frame(spark, rows).withColumn("_key", F.lit("clash")).withColumn("_t", F.lit(1))
    for r in sanitise.find_spans(d, alpha=alpha, few=few).collect():
        t = dict(rows)[r._id] or ""
        assert [(x.kind, x.s, x.e) for x in r.spans] == plain_spans(t)
        assert [(x.s, x.e) for x in r.terms] == want[t], t


@pytest.mark.parametrize("form", ["Zorblax bob@x.org {}", "{} bob@x.org Zorblax", "bob@x.org, a{}@y.org, Zorblax the {}"])
def test_disclosing_terms_at_ends_and_in_lists(spark, form):
    rows = [(i, form.format(i, i)) for i in range(6)] + [(100 + i, f"common plain text number {i} about the lake") for i in range(200)]
    out = {r.doc_id: r.text for r in sanitise.redact(frame(spark, rows)).collect()}
    for i, t in rows:
        assert "Zorblax" not in out[i] and "bob@x.org" not in out[i]
        assert i < 100 or out[i] == t


def test_sanitise_empty(spark):
    assert sanitise.find_spans(frame(spark, [])).count() == 0
    assert sanitise.redact(frame(spark, [])).count() == 0


# -- quality -----------------------------------------------------------------


def quality_rows(n=900):
    random.seed(3)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "li", "mo", "ne", "pu")]
    rows, labels = [], []
    for i in range(n):
        low, toxic = i % 5 == 0, i % 7 == 0
        w = [random.choice(vocab) for _ in range(random.randrange(20, 120))]
        if low:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[random.randrange(len(w))] = random.choice(["nastyword", "awfulness"])
        rows.append((i, " ".join(w), f"h{i % 4}", "en"))
        labels.append((i, 0 if low else 1, int(toxic)))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = quality_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in ("host_low", "__low", "_e_low", "c0", "_host", "odd`name")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(d, lab.where("doc_id % 3 <> 0")).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    right = sum((got[i].low_posterior > 0.5) == (q == 0) and (got[i].toxic_posterior > 0.5) == (t == 1) for i, q, t in held)
    assert right / len(held) > 0.97
    assert all(got[i].kept == (got[i].low_posterior <= 0.5 and got[i].toxic_posterior <= 0.5) for i, _, _ in held)


def test_quality_label_bound(spark, monkeypatch):
    """The default bound takes 20,000 labelled rows; fewer are all used."""
    seen, real = [], quality._tallies
    monkeypatch.setattr(quality, "_tallies", lambda sample: seen.append(sample.count()) or real(sample))
    for n, want in ((9_000, 9_000), (21_000, 20_000)):
        docs = spark.range(n).selectExpr("id AS doc_id", "'a b' AS text", "'s' AS source", "'en' AS lang")
        quality.score(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
        assert seen[-1] == want


def plain_priors(rows, labels, folds):
    """Prior of each row by the formulas of the module, in plain Python."""
    out = {}
    for c, value in (("low", lambda q, t: None if q is None else 1 - q), ("toxic", lambda q, t: t)):
        seen = [(folds[i], h, p, value(*labels[i])) for i, h, p in rows if i in labels and value(*labels[i]) is not None]
        n, k = len(seen), sum(y for *_, y in seen)
        r = (k + 0.5) / (n + 1)
        hosts, paths = {}, {}
        for _, h, p, y in seen:
            for d, key in ((hosts, h), (paths, (h, p))):
                a, b = d.get(key, (0, 0))
                d[key] = (a + 1, b + y)
        s_host, s_path = (sum(b * b / a for a, b in d.values()) for d in (hosts, paths))
        q_path = sum(a * a / hosts[h][0] for (h, _), (a, _) in paths.items())

        def kappa(between, free, spread):
            tau = (between - free * r * (1 - r)) / spread if spread > 1e-9 else 0
            return min(1e4, max(2.0, r * (1 - r) / tau - 1)) if tau > 0 else 1e4

        over = kappa(s_host - k * k / n, len(hosts) - 1, n - sum(a * a for a, _ in hosts.values()) / n)
        within = kappa(s_path - s_host, len(paths) - len(hosts), n - q_path)
        for i, h, p in rows:
            rest = [x for x in seen if x[0] != folds[i]]
            rate = (sum(x[3] for x in rest) + 0.5) / (len(rest) + 1)
            mine = [x[3] for x in rest if x[1] == h]
            own = [x[3] for x in rest if x[1:3] == (h, p)]
            host = (sum(mine) + over * rate) / (len(mine) + over)
            out[i, c] = (sum(own) + within * host) / (len(own) + within)
    return out


@pytest.mark.parametrize("max_sites", [0, 20_000])
def test_posteriors_match_plain_python(spark, max_sites):
    """Priors by path, host and global rate, with a row's own label left out."""
    random.seed(13)
    places = [("good", "p0"), ("good", "p1"), ("bad", "p0"), ("bad", "p1"), ("mixed", "p0"), ("mixed", "p1"), (None, "p0"), ("good", None), ("unseen", "p0"), ("bad", "unseen")]
    rows, labels = [], {}
    for i in range(400):
        h, p = random.choice(places)
        rows.append((i, h, p))
        if "unseen" not in (h, p) and random.random() < 0.7:
            low = random.random() < (0.05 if h == "good" else 0.9 if h == "bad" else 0.1 if p == "p0" else 0.8)
            labels[i] = (random.choice([int(not low), int(not low), None]), int(random.random() < 0.2))
    docs = spark.createDataFrame([(i, None, h, p) for i, h, p in rows], "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(9999, 0, 1)], "doc_id long, quality int, toxic int")
    folds = {r[0]: r[1] for r in docs.select("doc_id", quality._fold(F.col("doc_id"))).collect()}
    want = plain_priors(rows, labels, folds)
    got = {r.doc_id: r for r in quality.score(docs, lab, max_sites=max_sites).collect()}
    # texts are all empty, so evidence is one number: a posterior over a prior tells it
    odds = lambda x: math.log(x / (1 - x))
    for c in ("low", "toxic"):
        gaps = [odds(got[i][f"{c}_posterior"]) - odds(want[i, c]) for i, _, _ in rows]
        assert max(gaps) - min(gaps) < 1e-9
    unseen = {h: [got[i].low_posterior for i, a, p in rows if (a, p) == (h, "unseen" if h == "bad" else "p0")] for h in ("bad", "good", "unseen")}
    assert min(unseen["bad"]) > max(unseen["unseen"]) > max(unseen["good"])  # path, then host, then all


def test_quality_edges(spark):
    kind = "doc_id long, text string, source string, lang string"
    lab = "doc_id long, quality int, toxic int"
    d = spark.createDataFrame([(1, None, None, None), (2, "", "a", None), (2, "", "a", None), (3, "x " * 50_000, "a", "en")], kind)
    assert quality.score(d, spark.createDataFrame([], lab)).count() == 4
    assert quality.score(d, spark.createDataFrame([(1, None, None), (2, 1, 0), (3, 0, 0)], lab)).count() == 4
    assert quality.score(spark.createDataFrame([], kind), spark.createDataFrame([(1, 1, 0)], lab)).count() == 0


# -- packing -----------------------------------------------------------------


def padding(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    random.seed(2)
    for _ in range(60):
        lengths = sorted(random.sample(range(60), random.randrange(1, 9)))
        counts = [random.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3, 4):
            tops = packing.best_boundaries(np.array(lengths), np.array(counts), k)
            assert len(tops) <= k and tops[-1] == lengths[-1]
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
            assert padding(lengths, counts, tops) == best


def test_packing(spark):
    random.seed(4)
    rows = [(i, " ".join("w" * random.randrange(1, 4) for _ in range(random.randrange(0, 300)))) for i in range(400)] + [(500, None), (501, "w " * 9000), (7, "w w"), (7, "w w"), (None, "w")]
    got = packing.pack(packing.word_counts(frame(spark, rows).withColumn("bucket", F.lit(1))), buckets=5, budget=2000).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.padded_to
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.place for r in b) == list(range(len(b)))
        assert len(b) * b[0].padded_to <= 2000 or len(b) == 1
    assert packing.pack(packing.word_counts(frame(spark, []))).count() == 0


def test_long_lengths_are_padded_to_lengths_that_occur(spark):
    random.seed(14)
    rows = [(i, random.choice([3, 5_000, 5_001, 9_999, 70_000, 69_990, 69_991, 131_073])) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=8).collect()
    tops = sorted({r.padded_to for r in got})
    assert tops[-1] == max(n for _, n in rows) and set(tops) <= {n for _, n in rows}
    assert all(r.padded_to == min(t for t in tops if t >= r.n_tokens) for r in got)
    assert [r for r in got if r.n_tokens == 70_000][0].padded_to == 70_000


def test_packing_ties(spark):
    got = packing.pack(spark.createDataFrame([(i % 3, 7) for i in range(30)], "doc_id long, n_tokens long"), budget=21).collect()
    assert sorted((r.batch, r.place) for r in got) == [(b, p) for b in range(10) for p in range(3)]


def test_packing_by_tokens(spark):
    rows = [(i, "abc" * 400) for i in range(20)] + [(100 + i, "a b c") for i in range(20)]
    lengths = bpe.encode(frame(spark, rows))
    sizes = {r.doc_id: r.n_tokens for r in lengths.collect()}
    batches = {}
    for r in packing.pack(lengths, buckets=2, budget=2000).collect():
        assert r.n_tokens == sizes[r.doc_id]
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert all(sum(r.n_tokens for r in b) <= 2000 for b in batches.values()) and sum(map(len, batches.values())) == 40


def test_histogram_cells(spark):
    d = spark.range(0, 40_000, 7).withColumn("top", packing.cell_top(F.col("id")))
    for r in d.collect():
        assert r.id <= r.top and (r.top == r.id if r.id <= 4096 else r.top < r.id * (1 + 1 / 1024))


# -- sharding ----------------------------------------------------------------


def test_kd_shards(spark):
    random.seed(6)
    kind = "doc_id long, text string, source string, lang string"
    rows = [(i, "é" * random.randrange(0, 60), f"s{i % 3 if i % 2 else 0}", random.choice(["a", "b", None])) for i in range(3000)]
    rows += [(5000, None, None, None), (5000, None, None, None), (None, "x", "s", "a")]
    got = shard.shard_documents(spark.createDataFrame(rows, kind).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(0)), shards=7).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _, _ in rows}
    by = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(7))
    sums = [sum(r.size for r in v) for v in by.values()]
    assert max(sums) - min(sums) <= 0.03 * sum(sums) / 7 + 400
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))


def test_kd_cuts_are_weighted_medians(spark):
    """Each split, level by level, against a sorted table of its keys."""
    random.seed(15)
    kind = "doc_id long, text string, source string, lang string"
    rows = [(i, "x" * int(random.paretovariate(1.2) * 20), f"s{int(random.expovariate(0.5))}", random.choice("abc")) for i in range(2500)]
    coords, dims = shard.coordinates(spark.createDataFrame(rows, kind), "doc_id", "text", ("source", "lang"))
    table = [r.asDict() for r in coords.collect()]
    got = {r._id: r.shard for r in shard.kd_assign(coords, dims, "size", 6, tolerance=0).collect()}
    full = [max(1, max(r[d] for r in table) - min(r[d] for r in table)) for d in dims]

    def split(part, first, n):
        if n == 1:
            assert {got[r["_id"]] for r in part} == {first}
            return
        d = max(range(len(dims)), key=lambda i: (max(r[dims[i]] for r in part) - min(r[dims[i]] for r in part)) / full[i])
        part = sorted(part, key=lambda r: (r[dims[d]], r["_low"]))
        left = [r for r in part if got[r["_id"]] < first + n // 2]
        assert left == part[: len(left)]  # a cut along the widest dimension
        wanted, at = sum(r["size"] for r in part) * (n // 2) / n, sum(r["size"] for r in left)
        leaf = sum(r["size"] for r in table) / 6
        near = {}
        for r in part:
            near[r["text_crc32"]] = near.get(r["text_crc32"], 0) + r["size"]
        edge = {part[len(left) - 1]["text_crc32"], part[min(len(left), len(part) - 1)]["text_crc32"]}
        assert abs(at - wanted) <= max(min(0.01 * leaf, max(near[c] for c in edge)), max(r["size"] for r in part if r["text_crc32"] in edge))
        split(left, first, n // 2)
        split(part[len(left) :], first + n // 2, n - n // 2)

    split(table, 0, 6)


def test_kd_keeps_equal_texts_together(spark):
    random.seed(16)
    kind = "doc_id long, text string, source string, lang string"
    rows = [(i, f"text {i % 1500} " + "y" * (i % 1500 % 70), random.choice(["s1", "s2", "s3"]), random.choice("ab")) for i in range(4500)]
    rows += [(10_000 + i, "hot copy", random.choice(["s1", "s2"]), "a") for i in range(2500)]
    got = shard.shard_documents(spark.createDataFrame(rows, kind), shards=10).collect()
    texts = {i: t for i, t, _, _ in rows}
    where, sums = {}, Counter()
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        sums[r.shard] += r.size
    assert [t for t, s in where.items() if len(s) > 1] == ["hot copy"]
    assert max(sums.values()) - min(sums.values()) <= 0.05 * sum(sums.values()) / 10


def test_kd_many_shards_and_ties(spark):
    kind = "doc_id long, text string, source string, lang string"
    d = spark.createDataFrame([(i, "same", "s", "a") for i in range(4000)], kind)
    got = shard.shard_documents(d, target_bytes=20 * 16).collect()
    sums = Counter(r.shard for r in got)
    assert len(sums) == 250 and max(sums.values()) <= 32


def test_kd_edges(spark):
    kind = "doc_id long, text string, source string, lang string"
    assert shard.shard_documents(spark.createDataFrame([], kind)).count() == 0
    same = spark.createDataFrame([(1, "same", "s", "a")] * 20, kind)
    assert shard.shard_documents(same, shards=4).count() == 20
    one = shard.shard_documents(same, target_bytes=10**9).collect()
    assert {r.shard for r in one} == {0}
