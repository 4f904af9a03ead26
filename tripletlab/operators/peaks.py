"""Enrichment peaks: ratio, fill, gates, islands, edges, summary, annotation."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletlab.functions import stats
from tripletlab.functions.tables import written
from tripletlab.operators.compare import replicate_gate
from tripletlab.operators.profiles import moving_mean


def enrichment(df: DataFrame, controls: list[str], pulldowns: list[str], out: str = "ratio") -> DataFrame:
    """Mean over all pulldown/control pairs of their ratio."""
    pairs = [F.coalesce(F.try_divide(F.col(p), F.col(c)), F.lit(0.0)) for p in pulldowns for c in controls]
    return df.withColumn(out, reduce(add, pairs) / len(pairs))


def fill_empty(df: DataFrame, column: str, mode: int = -1, name: str = "name", pos: str = "pos") -> DataFrame:
    """Empty sites get the global mean (0), the gene's mean (-1) or the mean of
    the gene's first N positions (N)."""
    if mode == 0:
        mean = df.agg(F.avg(column).alias("_fill"))
        d = df.join(F.broadcast(mean))
    else:
        first = F.row_number().over(Window.partitionBy(name).orderBy(pos)) <= mode if mode > 0 else F.lit(True)
        d = df.withColumn("_in", first).withColumn("_fill", F.avg(F.when(F.col("_in"), F.col(column))).over(Window.partitionBy(name))).drop("_in")
    return d.withColumn(column, F.when(F.col(column) == 0, F.col("_fill")).otherwise(F.col(column).cast("double"))).drop("_fill")


def background_gate(df: DataFrame, pulldowns: list[str], fold: float, at: int = 30, use: str = "max", name: str = "name", pos: str = "from_tis") -> DataFrame:
    """Genes whose pulldown after codon ``at`` exceeds the one before by ``fold``
    in every sample."""
    f = F.max if use == "max" else F.avg
    cols = [x for i, p in enumerate(pulldowns) for x in (f(F.when(F.col(pos) >= at, F.col(p))).alias(f"h{i}"), f(F.when(F.col(pos) < at, F.col(p))).alias(f"l{i}"))]
    g = df.groupBy(name).agg(*cols)
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"h{i}") > F.col(f"l{i}") * fold, F.lit(False)) for i in range(len(pulldowns))])
    return g.select(name, ok.alias("ok"))


def islands(df: DataFrame, gap: int, name: str = "name", pos: str = "pos") -> DataFrame:
    """Number the runs of eligible rows that are at most ``gap`` apart."""
    w = Window.partitionBy(name).orderBy(pos)
    step = F.col(pos) - F.lag(pos).over(w)
    new = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def summarise(found: DataFrame, value: str = "ratio", name: str = "name", pos: str = "pos") -> DataFrame:
    """Start, end, covered positions, maximum, its place, and mean of each island."""
    return found.groupBy(name, "island").agg(
        F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("covered"),
        F.max(value).alias("max_value"), F.max_by(pos, F.struct(F.col(value), -F.col(pos))).alias("max_pos"), F.avg(value).alias("mean_value"),
    )


def chain(rows: list[tuple[int, int, int]], width: int, share: float, gap: int) -> list[tuple[int, int, int]]:
    """The chain of best_chain() over the islands (start, end, covered) of one
    gene in order.  A stretch i..j is covered well enough where
    share start_i - S_i >= share (end_j + 1) - S_(j+1) (S: covered before), so the
    best first island is a maximum over ranks of the left side, kept in a Fenwick
    tree: n log n steps, in whole numbers."""
    part = Fraction(share).limit_denominator(1_000_000)
    before = [0]
    for r in rows:
        before.append(before[-1] + r[2])
    side = [part.numerator * r[0] - part.denominator * before[i] for i, r in enumerate(rows)]
    best: list[tuple[int, int | None]] = [(0, None)]  # covered so far, first island of the last stretch
    low = 0
    while low < len(rows):
        high = low + 1
        while high < len(rows) and rows[high][0] - rows[high - 1][1] <= gap * width:
            high += 1
        ranks = sorted({-side[i] for i in range(low, high)})  # the largest side has rank 1
        tree: list[tuple[int, int] | None] = [None] * (len(ranks) + 1)
        put = low
        for j in range(low, high):
            while put <= j and rows[put][0] <= rows[j][1] - width + 1:
                entry, k = (best[put][0] - before[put], put), bisect_left(ranks, -side[put]) + 1
                while k < len(tree):
                    tree[k] = entry if tree[k] is None else max(tree[k], entry)
                    k += k & -k
                put += 1
            k, top = bisect_right(ranks, part.denominator * before[j + 1] - part.numerator * (rows[j][1] + 1)), None
            while k:
                top = tree[k] if top is None else top if tree[k] is None else max(top, tree[k])
                k -= k & -k
            gain = None if top is None else top[0] + before[j + 1]
            best.append((gain, top[1]) if gain is not None and gain > best[j][0] else (best[j][0], None))
        low = high
    out, j = [], len(rows)
    while j > 0:
        first = best[j][1]
        if first is not None:
            out.append((rows[first][0], rows[j - 1][1], before[j] - before[first]))
        j = j - 1 if first is None else first
    return out[::-1]


def best_chain(peaks: DataFrame, width: int, share: float, gap: int) -> DataFrame:
    """Merge neighbouring islands while the merged stretch stays covered by at
    least ``share``, and keep those of ``width`` or more: for each gene the chain
    with most covered positions, by dynamic programming over its islands.  Of
    equal chains the one with the later, shorter stretches stays.  No stretch goes
    over a gap of more than ``gap`` widths, so the runs between such gaps are solved
    by themselves, in whole batches of sorted islands: a gene costs no call of its
    own, and a task holds one batch and one run."""
    schema = f"name {peaks.schema['name'].dataType.simpleString()}, start long, end long, covered long"
    part = Fraction(share).limit_denominator(1_000_000)
    w = Window.partitionBy("name").orderBy("start")
    last = F.lag("end").over(w)
    runs = peaks.select("name", "start", "end", "covered", (last.isNull() | (F.col("start") - last > gap * width)).alias("_new"))

    def solved(held):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(held)
        start, end, covered, new = (t.column(i).to_numpy() for i in range(1, 5))
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(start))
        one = low[high - low == 1]
        size = end[one] - start[one] + 1
        one = one[(size >= width) & (part.denominator * covered[one] >= part.numerator * size)]
        at, found = one.tolist(), list(zip(start[one].tolist(), end[one].tolist(), covered[one].tolist()))
        for a, b in zip(low[high - low > 1].tolist(), high[high - low > 1].tolist()):
            got = chain(list(zip(start[a:b].tolist(), end[a:b].tolist(), covered[a:b].tolist())), width, share, gap)
            found += got
            at += [a] * len(got)
        three = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        names = t.column(0).take(pa.array(at, pa.int64()))
        return pa.table([names, *three], ["name", "start", "end", "covered"]).combine_chunks().to_batches()

    def solve(batches):
        import numpy as np

        held = []  # sorted islands from the start of a run on
        for b in batches:
            new = np.flatnonzero(b.column(4).to_numpy(zero_copy_only=False))
            if len(new) and (held or new[-1]):
                if new[-1]:
                    held.append(b.slice(0, new[-1]))
                yield from solved(held)
                held = [b.slice(new[-1])]
            else:
                held.append(b)
        if held:
            yield from solved(held)

    return runs.sortWithinPartitions("name", "start").mapInArrow(solve, schema)


def extend_edges(peaks: DataFrame, profile: DataFrame, floor: float, reach: int = 9, value: str = "smooth", name: str = "name", pos: str = "pos") -> DataFrame:
    """Move each edge out, up to ``reach`` positions, while the profile holds ``floor``."""
    near = peaks.join(profile.select(name, pos, value), name).where(F.col(pos).between(F.col("start") - reach - 1, F.col("end") + reach + 1))
    low = F.col(value) < floor
    g = near.groupBy(name, "start", "end").agg(
        F.max(F.when((F.col(pos) < F.col("start")) & low, F.col(pos))).alias("l"), F.min(F.when((F.col(pos) > F.col("end")) & low, F.col(pos))).alias("r"), F.min(pos).alias("lo"), F.max(pos).alias("hi")
    )
    left = F.greatest(F.coalesce(F.col("l") + 1, F.col("lo")), F.col("start") - reach)
    right = F.least(F.coalesce(F.col("r") - 1, F.col("hi")), F.col("end") + reach)
    return g.select(name, "start", "end", F.least(left, F.col("start")).alias("left"), F.greatest(right, F.col("end")).alias("right"))


def annotate(peaks: DataFrame, profile: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Region of the first and the last position of each peak."""
    r = profile.select(name, F.col(pos).alias("_p"), "region")
    a = peaks.join(r.withColumnRenamed("region", "start_region"), name).where("_p = start").drop("_p")
    return a.join(r.withColumnRenamed("region", "end_region"), name).where("_p = end").drop("_p")


def overlap_label(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", cell: int = 64) -> DataFrame:
    """Whether each left interval (closed) meets a right one with the same keys.
    Intervals are cut at cells of ``cell`` positions, so that the join is an
    equality on key and cell, also for a key with very many intervals."""
    span = F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))).alias("_cell")
    a = left.select("*", span)
    b = right.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), span).distinct()
    hit = a.join(b, [*keys, "_cell"]).where((F.col(start) <= F.col("_e")) & (F.col("_s") <= F.col(end))).select(*left.columns).distinct().withColumn("overlap", F.lit(True))
    return left.join(hit, left.columns, "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))


def overlap_classes(control: DataFrame, treated: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Peaks of two sides: ``overlap`` where one meets a peak of the other side,
    else the name of the side that has it alone (control or treated)."""
    sides = (("control", control, treated), ("treated", treated, control))
    each = [overlap_label(a, b, keys, start, end).select(*keys, start, end, F.lit(n).alias("side"), F.when(F.col("overlap"), "overlap").otherwise(n).alias("kind")) for n, a, b in sides]
    return each[0].unionByName(each[1])


def strong(peaks: DataFrame, alpha: float, fold: float, p: str = "bhfdr", value: str = "mean_value", width: tuple[int, int] | None = None) -> DataFrame:
    """Peaks below ``alpha`` whose enrichment reaches ``fold``, of a width within bounds."""
    ok = (F.col(p) < alpha) & (F.col(value) >= fold)
    return peaks.where(ok & (F.col("end") - F.col("start") + 1).between(*width) if width else ok)


def write_bed(peaks: DataFrame, path: str, name: str = "name", score: str = "max_value") -> None:
    """Half-open intervals with a number and a score, without header."""
    cols = [F.col(name), (F.col("start") - 1).alias("a"), F.col("end"), F.concat_ws("_", F.col(name), F.col("start")).alias("label"), F.round(score, 4)]
    peaks.select(*cols).write.option("sep", "\t").csv(path)


def eligible(df: DataFrame, controls: list[str], pulldowns: list[str], minimum: float, fold: float | None = None, at: int = 30, correlation: float | None = None) -> DataFrame:
    """Names of genes that pass every gate: counts of the pulldowns, pulldown
    after codon ``at`` over the one before, and correlation of replicates."""
    names = df.groupBy("name").agg(reduce(add, [F.sum(p) for p in pulldowns]).alias("s")).where(F.col("s") >= minimum).select("name")
    if fold is not None:
        names = names.join(background_gate(df, pulldowns, fold, at).where("ok"), "name", "left_semi")
    if correlation is not None:
        for side in (controls, pulldowns):
            if len(side) > 1:
                names = names.join(replicate_gate(df, side, correlation).where("ok"), "name", "left_semi")
    return names


def detect(df: DataFrame, controls: list[str], pulldowns: list[str], floor: float, gap: int = 2, width: int = 5, share: float = 0.6, half: int = 2, minimum: float = 0, fold: float | None = None, at: int = 30, correlation: float | None = None, edge: float | None = None, reach: int = 9) -> DataFrame:
    """The caller from counts to tested peaks.  ``df`` has name, pos, region and
    one column per sample (and from_tis for the background gate); genes that fail
    a gate of eligible() are left out.  With ``edge``, edges move out while the
    profile holds it (columns left and right); regions of both ends are added."""
    d = df.join(eligible(df, controls, pulldowns, minimum, fold, at, correlation), "name", "left_semi")
    for c in controls:
        d = fill_empty(d, c)
    smooth = moving_mean(enrichment(d, controls, pulldowns), half, value="ratio")
    found = best_chain(summarise(islands(smooth.where(F.col("smooth") >= floor), gap)), width, share, gap)
    inside = found.join(smooth, "name").where(F.col("pos").between(F.col("start"), F.col("end")))
    diff = reduce(add, [F.col(p) for p in pulldowns]) / len(pulldowns) - reduce(add, [F.col(c) for c in controls]) / len(controls)
    t = inside.withColumn("_d", diff).groupBy("name", "start", "end").agg(F.avg("_d").alias("md"), F.stddev_samp("_d").alias("sd"), F.count("*").alias("n"), F.max("smooth").alias("max_value"), F.max_by("pos", F.struct("smooth", -F.col("pos"))).alias("max_pos"), F.avg("smooth").alias("mean_value"))
    t = t.withColumn("t", F.try_divide("md", F.col("sd") / F.sqrt("n"))).withColumn("p", stats.t_two_sided("t", (F.col("n") - 1).cast("double")))
    t = stats.bh_adjust(written(t, "peaks"), "p", ["name", "start"], out="bhfdr")  # read several times
    if edge is not None:
        t = t.join(extend_edges(found, smooth, edge, reach), ["name", "start", "end"])
        t = annotate(t, d)
    return t


def pulldown_table(wide: DataFrame, controls: list[str], pulldowns: list[str], totals: DataFrame | None = None, scale: float = 1e6, background: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The caller's input from a wide density table: (name, pos, from_tis, region,
    one column of summed frames per sample), and per sample (sample, side, total,
    mean_rpm), where mean_rpm is the sum of CDS counts per ``scale`` over genes and
    ``background``.  ``totals`` (sample, total) replaces the table's own sums."""
    names = [*controls, *pulldowns]
    sums = [reduce(add, [F.coalesce(F.col(f"`{s}_f{k}`"), F.lit(0)) for k in range(3)]).cast("long").alias(s) for s in names]
    rows = wide.select("name", F.col("now_nt").alias("pos"), "from_tis", "region", *sums)
    cds = F.col("region") == "cds"
    one = rows.agg(F.count_distinct("name").alias("genes"), *[f for i, s in enumerate(names) for f in (F.sum(F.col(f"`{s}`")).alias(f"t{i}"), F.sum(F.when(cds, F.col(f"`{s}`"))).alias(f"c{i}"))])
    items = [F.struct(F.lit(s).alias("sample"), F.lit("control" if s in controls else "pulldown").alias("side"), F.col(f"t{i}").alias("own"), F.col(f"c{i}").alias("cds")) for i, s in enumerate(names)]
    per = one.select("genes", F.explode(F.array(*items)).alias("x")).select("genes", "x.*")
    per = per.withColumn("total", F.col("own")) if totals is None else per.join(totals.select("sample", F.col("total").cast("long").alias("total")), "sample")
    mean = F.coalesce(F.try_divide(F.col("cds") * F.lit(scale), F.col("total") * F.col("genes") * F.lit(background)), F.lit(0.0))
    return rows, per.select("sample", "side", "total", mean.alias("mean_rpm"))


def with_notes(df: DataFrame, notes: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``gene`` from notes (name, gene), one row a name; ``-`` if there is none."""
    return df.join(notes.select(F.col("name").alias("_n"), "gene"), F.col(name) == F.col("_n"), "left").drop("_n").withColumn("gene", F.coalesce("gene", F.lit("-")))
