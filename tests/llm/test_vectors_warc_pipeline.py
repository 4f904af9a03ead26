"""Cosine links, WARC, the pipeline, and the SQL oracles on the small tables."""

import gzip
import hashlib
import math
import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletlab.llm import covertree, registry, warc

SF = "/root/testdata/sf0.001"


def brute_links(rows, t):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[k] = x / np.sqrt((x * x).sum())
    n = [0] * len(rows)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= t:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                if p != q:
                    lo, hi = sorted((p, q), key=lambda z: rows[z][0])
                    up[hi] = lo
    return {rows[k][0]: (n[k], rows[find(k)][0]) for k in range(len(rows))}


def test_cosine_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        c = rng.normal(size=8)
        rows += [(0, (c + rng.normal(size=8) * s).tolist()) for s in rng.choice([0.0, 0.05, 0.3], 25)]
    rows += [(0, None), (0, []), (0, [0.0] * 8), (0, [float("nan")] + [1.0] * 7), (0, [None] + [1.0] * 7), (0, [1.0] * 3), (0, [1.0] * 3), (0, [1e300] * 8), (0, [1e-300] * 8)]
    rng.shuffle(order := list(range(len(rows))))
    rows = [(int(i), rows[k][1]) for i, k in enumerate(order)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).withColumn("n_links", F.lit(0))
    for block in (16, 60, None):
        got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.cosine_links(d, block=block).collect()}
        big = [i for i, v in rows if v and v[0] in (1e300, 1e-300)]
        want = brute_links([(i, [1.0] * 8) if i in big else (i, v) for i, v in rows], 0.9)
        assert got == want


def test_cosine_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert covertree.cosine_links(spark.createDataFrame([], kind)).count() == 0
    got = covertree.cosine_links(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], kind)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def cover_points(n=700, d=6):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(n, d)), (rng.normal(size=(1, d)) + 0.01 * rng.normal(size=(n // 3, d)))])
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_cover_tree_levels():
    """Centres are points and nest, radii cover, children are apart by a level's
    radius that halves, ranges are nested, and a tree survives its bytes."""
    x = cover_points()
    t = covertree.CoverTree(x, leaf=8, reach=0.447)
    t = covertree.CoverTree.unpack(x, t.pack())
    assert sorted(t.order) == list(range(len(x)))
    split = 0
    for k in range(len(t.centre)):
        own = t.order[t.lo[k] : t.hi[k]]
        assert t.centre[k] in own
        assert (np.linalg.norm(x[own] - x[t.centre[k]], axis=1) <= t.radius[k] + 1e-6).all()
        kids = np.arange(t.kid_lo[k], t.kid_hi[k])
        if len(kids):
            split += 1
            assert t.centre[k] in t.centre[kids]
            spans = sorted((t.lo[j], t.hi[j]) for j in kids)
            assert spans[0][0] == t.lo[k] and spans[-1][1] == t.hi[k] and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
            gaps = np.linalg.norm(x[t.centre[kids]][:, None] - x[t.centre[kids]][None], axis=2)[np.triu_indices(len(kids), 1)]
            bounds = [2.0**-e for e in range(-1, 14) if gaps.min() > 2.0**-e - 1e-3 and t.radius[kids].max() <= 2.0**-e + 1e-2]
            assert bounds, (gaps.min(), t.radius[kids].max())
        else:
            assert len(own) <= 8 or t.radius[k] < 1e-2
    assert split > 5


@pytest.mark.parametrize("cosine", [0.9, 0.5, 0.9999])
def test_dual_traversal_finds_all_pairs(cosine):
    x = cover_points()
    half = len(x) // 2
    trees = [covertree.CoverTree(p, leaf=4, reach=(2 - 2 * cosine) ** 0.5) for p in (x[:half], x[half:])]
    for one, two, same in ((0, 0, True), (0, 1, False)):
        got = []
        p, q = x[:half], (x[:half] if same else x[half:])
        dual = lambda a, b: got.extend((i, j) for i, j in zip(a.tolist(), b.tolist()) if p[i] @ q[j] >= cosine)  # noqa: B023, E731
        covertree.dual(trees[one], trees[two], cosine, dual, lambda a, b: got.extend((i, j) for i in a.tolist() for j in b.tolist()), (lambda a: got.extend(combinations(a.tolist(), 2))) if same else None, tile=64)  # noqa: B023
        want = {(i, j) for i, j in zip(*np.nonzero(p @ q.T >= cosine))}
        if same:
            want, got = {(i, j) for i, j in want if i < j}, [tuple(sorted(z)) for z in got]
        assert len(got) == len(set(got)) and set(got) == want


def test_repeated_vector_identifiers(spark):
    rows = [(1, (1.0, 0.0)), (1, (0.0, 1.0)), (2, (1.0, 0.01)), (3, (0.01, 1.0)), (4, (0.02, 1.0)), (None, (1.0, 0.0))]
    d = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>")
    for block in (2, None):
        got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in covertree.cosine_links(d, block=block).collect())
        assert got == [(0, 2, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


PAGES = [(1, "http://a/\r\n1", "<p>" + "x" * 200), (5, None, "<p>" + "x" * 200), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>" + "x" * 200), (6, "http://f", "short"), (7, "http://g", "short"), (8, "http://h", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 20 + "é"), (9, "http://i", "\r\n\r\n" * 40), (2, "http://j", "\r\n\r\n" * 40)]


def test_warc_round_trip(spark, tmp_path):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("kind", F.lit("clash")).withColumn("digest", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_archives(d, path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(PAGES)
    got = warc.transactions(records).collect()
    assert len(got) == len(PAGES)
    want = {i: (u, (h or "").encode()) for i, u, h in PAGES}
    for r in got:
        i = r.metadata.fields.split("page-id: ")[1].strip()
        url, body = want[int(i) if i else None]
        assert r.response.payload_bytes == len(body) and (r.response.payload_digest or r.response.digest) == hashlib.sha256(body).hexdigest()
        assert r.target == ((url or f"urn:page:{i}").replace("\r", "%0D").replace("\n", "%0A"))
        assert r.request.http_head.startswith(f"GET {r.target} ")
        assert r.response.kind == ("revisit" if i in ("5", "9") else "response")
        if r.response.kind == "response":
            assert bytes(r.response.payload) == body
    # the files are plain WARC: members can be read without Spark
    files = [f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    raw = b"".join(gzip.open(tmp_path / "w" / f).read() for f in files)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: request\r\n") == len(PAGES)


def test_warc_concurrent_chain(spark):
    rows = [("r", "response", None, "u"), ("q", "request", "r", "u"), ("m", "metadata", "q", "u"), ("r2", "response", None, "v")]
    d = spark.createDataFrame([(a, b, c, None, t, None, "h", "f", 1, None, None) for a, b, c, t in rows], warc.RECORD_SCHEMA)
    got = {r.record_id: r for r in warc.transactions(d).collect()}
    assert got["r"].request.record_id == "q" and got["r"].metadata.record_id == "m"
    assert got["r2"].request is None and got["r2"].metadata is None


def test_warc_refers_to_and_large_pages(spark, tmp_path):
    big = "<p>" + "y" * 200_000
    rows = [(i, f"http://h/{i}", big + str(i // 2)) for i in range(6)] + [(10 + i, "http://same", "z" * 150) for i in range(4)] + [(20, "http://t", "short")] * 2
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, file_bytes=1 << 20)
    records = warc.read_records(spark, path)
    by = {r.record_id: r for r in records.where("kind = 'response'").collect()}
    page = {r.concurrent_to: int(r.fields.split(": ")[1]) for r in records.where("kind = 'metadata'").collect()}
    seen = {page[r.record_id]: page[r.refers_to] for r in records.where("kind = 'revisit'").collect() if r.refers_to in by}
    assert seen == {1: 0, 3: 2, 5: 4, 11: 10, 12: 10, 13: 10}
    assert records.where("kind = 'response'").count() == len(rows) - len(seen)
    assert warc.transactions(records).count() == len(rows)
    assert max(os.path.getsize(tmp_path / "w" / f) for f in os.listdir(tmp_path / "w")) < 1 << 20


def test_warc_empty(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.transactions(warc.read_records(spark, path)).count() == 0


def test_warc_members():
    one, two = gzip.compress(b"a" * 10), gzip.compress(b"b" * 10)
    assert warc._unpack(one + two) == b"a" * 10 + b"b" * 10
    with pytest.raises(ValueError):
        list(warc.parse(b"not a record", True))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in want.fetchall()))) == sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect())))


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {0: docs.count()}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[k + 1] = docs.count()
    assert kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] == kept[5] > 0
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]


def test_pipeline_keeps_what_plain_python_keeps(spark, monkeypatch, tmp_path):
    """run() on a fixture, stage by stage: quality against its own decisions,
    the deterministic stages against brute force, packing for whole rows."""
    import corpus_pipeline as P
    from tests.llm.test_dedup import brute_components, lower, near_rows
    from tests.llm.test_text import plain_spans

    rows = near_rows()
    rows += [(20_000 + i, t.upper() if i % 2 else t) for i, (_, t) in enumerate(rows[:9])]
    rows += [(30_000 + i, f"note {i} of {i * i} x{i} y{i} mail u{i}@a{i}.org or 10.0.0.{i} or +1 555 123 45{i:02d}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, plain = {}, P.stash

    def stash(df, name):
        out = plain(df, name)
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        return out

    monkeypatch.setattr(P, "stash", stash)
    got = P.run(spark, str(tmp_path)).collect()
    assert seen["quality"] == dict(rows)  # every label is clean
    first = {}
    for i, t in sorted(seen["quality"].items()):
        first.setdefault(lower(t), i)
    left = {i: dict(rows)[i] for i in first.values()}
    assert seen["exact_dedup"] == left and len(left) < len(rows)
    kept = set(brute_components(sorted(left.items())).values())
    assert seen["near_dedup"] == {i: left[i] for i in kept} and len(kept) < len(left)

    def masked(t):
        for k, s, e in sorted(plain_spans(t), key=lambda x: -x[1]):
            t = f"{t[:s]}[{k.upper()}]{t[e:]}"
        return t

    assert seen["personal_data"] == {i: masked(left[i]) for i in kept}
    assert {r.doc_id: r.n_tokens for r in got} == {i: len((t or "").encode().split()) for i, t in seen["personal_data"].items()} and len(got) == len(kept)


def test_pipeline_edges(spark):
    import corpus_pipeline as P

    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    random.seed(1)
    base = " ".join(f"w{random.randrange(99)}" for _ in range(60))
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, base, "en", "s", 9, "x"), (4, base.upper(), "en", "s", 9, "x"), (5, base + " more", "en", "s", 9, "x"), (6, "mail a@b.co now", "en", "s", 9, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF).select(*docs.columns)
        got = {r.doc_id: r for r in docs.collect()}
        if data:
            assert 4 not in got and 5 not in got and 3 in got
            assert got[6].text == "mail [EMAIL] now" and got[6].n_chars == 16


def test_pipeline_keeps_unrelated_rows_of_one_identifier(spark):
    import corpus_pipeline as P

    random.seed(12)
    base, other, third = (" ".join(f"{c}{random.randrange(99)}" for _ in range(60)) for c in "abc")
    kind = "doc_id long, text string, lang string, source string, n_chars long, c0 string, _key string, `__low` string, `odd``name` int, spans string"
    rows = [(i, t, "en", "s", len(t), "x", "k", "z", 1, "s") for i, t in ((1, base), (2, base + " more"), (2, other), (2, other), (3, third + " a@b.co"), (3, base.upper()), (None, third))]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), kind)
        assert docs.columns[5:] == ["c0", "_key", "__low", "odd`name", "spans"]
    left = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert left == sorted([(1, base), (2, other), (2, other), (3, third + " [EMAIL]"), (0, third)])
    assert all(tuple(r)[5:] == ("x", "k", "z", 1, "s") for r in docs.collect())
    assert P.STAGES[-1][1](spark, docs, SF).count() == 5
