r"""Op 4 [native]: personal data and terms that reveal it.

Base spans.  Four patterns (email, ip, card, phone) are matched leftmost and
without overlap per kind, then checked (octets at most 255; Luhn and 16 to 19
digits; 8 to 15 digits).  The patterns below find what the plain ones find, in
forms that neither recurse nor rescan on long runs: possessive repeats, starts
only where a run starts (or a match just ended), and card runs bounded by what
stands around them.  Places come from the pieces between the matches, by running
sums in chunks of 256 inside the row, so a text with very many matches stays linear.

Disclosing terms.  A term (a run of three letters or more, lower-cased) of a text
that holds an entity (a base span's kind and lower-cased value) is judged by how
strongly the corpus ties the two together.  Counts are over distinct texts, whole
texts at that, so copies are no evidence: with N distinct texts, df(e), df(t) and
n(e, t) of them holding the entity, the term, and both, PMI = log2(N n(e, t) /
(df(e) df(t))), IC(e) = log2(N / df(e)), and the term gives the entity away where

    PMI * n / (n + 1) >= alpha * IC(e)        (alpha = 0.7).

The factor n / (n + 1) is what few texts can prove: every entity is judged, but
since PMI <= IC, a term must share at least alpha / (1 - alpha) texts with it
(three), which is why entities and terms in fewer texts are left out of the joins
without changing the result; so are terms too frequent for any n.  Occurrences of
a flagged term in texts that hold the entity are added as spans of kind ``term``
and generalised to a placeholder.

Everything is DataFrame or SQL expressions.  Base spans are always computed from
the row's own text; only the flagged terms come by a join, on the SHA-256 of the
text.  Small tables (copies, entities, flagged terms) are broadcast only below
``few`` rows and are joined by a shuffle beyond.

Defined cases: null text is empty and has no spans; a null identifier is carried
along; repeated rows give equal results; extra columns are not used by find_spans
and are carried along unchanged, whatever their names, by redact; an empty table
gives no rows; texts may have any length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletlab.llm.common import small, stash

_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(matches: str, pieces: str) -> str:
    """SQL: array of (s, e, v) from the matches and the pieces between."""
    item = f"transform({matches}, (v, i) -> named_struct('g', cast(length({pieces}[i]) as bigint), 'l', cast(length(v) as bigint), 'v', v))"
    row = "named_struct('s', a.pos + z.g, 'e', a.pos + z.g + z.l, 'v', z.v)"
    kind = "array<struct<s: bigint, e: bigint, v: string>>"
    part = f"aggregate(slice(items, c * 256 + 1, 256), named_struct('pos', 0L, 'out', cast(array() as {kind})), (a, z) -> named_struct('pos', a.pos + z.g + z.l, 'out', concat(a.out, array({row}))))"
    parts = f"transform(array({item}), items -> transform(sequence(0, (size(items) - 1) div 256), c -> {part}))[0]"
    bases = "aggregate(parts, named_struct('pos', 0L, 'out', cast(array() as array<bigint>)), (a, q) -> named_struct('pos', a.pos + q.pos, 'out', concat(a.out, array(a.pos)))).out"
    moved = f"flatten(zip_with(parts, {bases}, (q, b) -> transform(q.out, x -> named_struct('s', x.s + b, 'e', x.e + b, 'v', x.v))))"
    return f"CASE WHEN size({matches}) > 0 THEN transform(array({parts}), parts -> {moved})[0] ELSE cast(array() as {kind}) END"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CHECKS = {
    "email": "true",
    "ip": f"x.v rlike {_lit(rf'^(?:{_OCTET}\.){{3}}{_OCTET}$')}",
    "card": f"length({_DIGITS}) between 16 and 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
HINTS = {"email": "instr(_text, '@') > 0", "ip": "instr(_text, '.') > 0", "card": "true", "phone": "instr(_text, '+') > 0"}


_SPANS = "array<struct<kind: string, s: bigint, e: bigint>>"


def _matches(kind: str) -> str:
    return f"CASE WHEN {HINTS[kind]} THEN regexp_extract_all(_text, {_lit(PATTERNS[kind])}, 0) ELSE cast(array() as array<string>) END"


def entities_of() -> str:
    """SQL: the distinct entities of ``_text``, as kind:value in lower case."""
    each = [f"transform(filter(transform({_matches(k)}, v -> named_struct('v', v)), x -> {CHECKS[k]}), x -> concat('{k}:', lower(x.v)))" for k in KINDS]
    return f"array_distinct(concat({', '.join(each)}))"


def terms_of() -> str:
    """SQL: the distinct terms of ``_text``."""
    return f"array_distinct(transform(regexp_extract_all(_text, {_lit(TERM)}, 0), v -> lower(v)))"


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds ``_spans``: array of (kind, s, e) in the order of KINDS, then by
    place.  ``rows`` holds ``_text`` without nulls."""
    for k in KINDS:
        rows = rows.withColumn(f"_m_{k}", F.expr(_matches(k)))
    for k in KINDS:
        rows = rows.withColumn(f"_p_{k}", F.expr(f"CASE WHEN size(_m_{k}) > 0 THEN split(_text, {_lit(PATTERNS[k])}, -1) END"))
    tagged = [F.expr(f"transform(filter({_places(f'_m_{k}', f'_p_{k}')}, x -> {CHECKS[k]}), x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e))") for k in KINDS]
    return rows.withColumn("_spans", F.concat(*tagged)).drop(*[f"_{c}_{k}" for c in "mp" for k in KINDS])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def disclosing(rows: DataFrame, alpha: float = 0.7, few: int = 50_000) -> DataFrame | None:
    """Flagged terms by entity: (_e, _t, _n, _df_e, _df_t), with a table of the
    texts that hold the entities: (_key, _e).  ``rows``: _id, _text, _key.  None
    where no entity is in enough texts."""
    least = max(1, math.ceil(alpha / (1 - alpha) - 1e-9)) if alpha < 1 else 1 << 40
    held = stash(rows.select("_id", "_key", F.expr(entities_of()).alias("_es")), "entities-held")
    total = held.select("_key").distinct().count()
    known = held.where("size(_es) > 0").select("_key", F.explode("_es").alias("_e")).distinct()
    entities = stash(known.groupBy("_e").agg(F.count("*").alias("_df_e")).where((F.col("_df_e") >= least) & (F.col("_df_e") < total)), "entities")
    if entities.isEmpty():
        return None
    known = stash(known.join(small(entities, few), "_e"), "known")
    # each text counts once: of copies, the rows with the smallest identifier share one vote
    per = held.groupBy("_key", "_id").agg(F.count("*").alias("_rows"))
    copies = per.groupBy("_key").agg(F.min(F.struct(F.col("_id"), F.col("_rows"))).alias("_first"), F.sum("_rows").alias("_all")).where("_all > 1")
    copies = stash(copies.select(F.col("_key").alias("_copied"), "_first"), "copies")
    once = rows.join(small(copies, few), F.col("_key") == F.col("_copied"), "left").where(F.col("_copied").isNull() | F.col("_id").eqNullSafe(F.col("_first._id")))
    votes = once.select("_key", "_text", (1.0 / F.coalesce(F.col("_first._rows"), F.lit(1))).alias("_vote"))
    sets = known.groupBy("_key").agg(F.collect_list(F.struct("_e", "_df_e")).alias("_es"))
    near = votes.join(small(sets, few), "_key").select("_key", "_es", "_vote", F.explode(F.expr(terms_of())).alias("_t"))
    near = stash(near, "near")
    # a term must share ``least`` texts with one entity
    wanted = stash(near.groupBy("_t").agg(F.round(F.sum("_vote")).alias("_n")).where(F.col("_n") >= least).select("_t"), "wanted")
    every = votes.select("_vote", F.explode(F.expr(terms_of())).alias("_t"))
    df = stash(every.join(small(wanted, few), "_t").groupBy("_t").agg(F.round(F.sum("_vote")).cast("long").alias("_df_t")), "term-counts")
    ic = F.log2(F.lit(float(total)) / F.col("_df_e"))
    able = F.filter("_es", lambda e: F.log2(F.lit(float(total)) / F.col("_df_t")) >= alpha * F.log2(F.lit(float(total)) / e["_df_e"]) - 1e-9)
    pairs = near.join(small(df, few), "_t").select("_t", "_df_t", "_vote", F.explode(able).alias("_x")).groupBy(F.col("_x._e").alias("_e"), F.col("_x._df_e").alias("_df_e"), "_t", "_df_t").agg(F.round(F.sum("_vote")).cast("long").alias("_n"))
    pmi = F.log2(F.lit(float(total)) * F.col("_n") / (F.col("_df_e") * F.col("_df_t")))
    flagged = stash(pairs.where(F.col("_n") >= least).where(pmi * F.col("_n") / (F.col("_n") + 1) >= alpha * ic), "flagged")
    return known.select("_key", "_e").join(small(flagged, few), "_e")


def with_spans(rows: DataFrame, alpha: float, few: int) -> DataFrame:
    """``rows`` (with _id and _text) plus ``_spans`` (base) and ``_terms``, which
    never overlap base spans."""
    rows = rows.withColumn("_key", F.unhex(F.sha2("_text", 256)))
    found = disclosing(rows.select("_id", "_text", "_key"), alpha, few)
    if found is None:
        return base_spans(rows).withColumn("_terms", F.expr(f"cast(array() as {_SPANS})"))
    lists = stash(found.groupBy(F.col("_key").alias("_told")).agg(F.collect_set("_t").alias("_flagged")), "lists")
    rows = rows.join(small(lists, few), F.col("_key") == F.col("_told"), "left")
    rows = rows.withColumn("_mt", F.expr(f"CASE WHEN _flagged IS NOT NULL THEN regexp_extract_all(_text, {_lit(TERM)}, 0) END"))
    rows = rows.withColumn("_pt", F.expr(f"CASE WHEN _flagged IS NOT NULL THEN split(_text, {_lit(TERM)}, -1) END"))
    marks = F.expr(f"transform(filter({_places('_mt', '_pt')}, x -> array_contains(_flagged, lower(x.v))), x -> named_struct('kind', 'term', 's', x.s, 'e', x.e))")
    rows = base_spans(rows.withColumn("_found", marks).drop("_mt", "_pt", "_told", "_flagged"))
    return rows.withColumn("_terms", F.expr("filter(_found, t -> NOT exists(_spans, b -> b.s < t.e AND t.s < b.e))")).drop("_found")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.7, few: int = 50_000) -> DataFrame:
    """One row per document: _id, spans (base) and terms, arrays of (kind, s, e)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_spans(rows, alpha, few).select("_id", F.col("_spans").alias("spans"), F.col("_terms").alias("terms"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.7, few: int = 50_000) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as
    ``[EMAIL]``; overlapping spans become one.  Other columns stay as they are."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows = with_spans(plain.withColumns({"_id": F.col(ident), "_text": F.coalesce(F.col(text), F.lit(""))}), alpha, few)
    rows = rows.withColumn("_cuts", F.expr("array_sort(transform(concat(_spans, _terms), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"))
    body = (
        "aggregate(_cuts, named_struct('at', 0L, 'out', cast(array() as array<string>)), (a, x) -> CASE WHEN x.e <= a.at THEN a "
        "WHEN x.s < a.at THEN named_struct('at', x.e, 'out', a.out) "
        "ELSE named_struct('at', x.e, 'out', concat(a.out, array(substring(_text, cast(a.at + 1 as int), cast(x.s - a.at as int)), concat('[', upper(x.kind), ']')))) END, "
        "a -> concat(array_join(a.out, ''), substring(_text, cast(a.at + 1 as int))))"
    )
    new = F.when(F.size("_cuts") == 0, F.col(text)).otherwise(F.expr(body))
    return rows.select(*[new.alias(f"c{i}") if f"c{i}" == text else F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    every = _joined("concat(spans, terms)")
    return found.select(F.col("_id").alias("doc_id"), *counts, F.expr(f"sha2({_joined('spans')}, 256)").alias("base_sha256"), F.expr(every).alias("spans"))
