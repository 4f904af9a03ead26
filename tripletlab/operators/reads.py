"""Alignments: filters, quality control, offsets, P-site density, tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletlab.functions.tables import small

SECONDARY, SUPPLEMENTARY, UNMAPPED, REVERSE = 256, 2048, 4, 16


def has(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def filter_reads(reads: DataFrame, mapq: int = 0, lengths: list[int] | None = None, secondary: bool = False, supplementary: bool = False) -> DataFrame:
    """Mapped reads of a quality and of listed lengths; secondary and
    supplementary alignments are dropped unless asked for."""
    ok = ~has(UNMAPPED) & (F.col("mapq") >= mapq)
    ok = ok if secondary else ok & ~has(SECONDARY)
    ok = ok if supplementary else ok & ~has(SUPPLEMENTARY)
    return reads.where(ok & F.col("length").isin(lengths) if lengths else ok)


def unique_reads(reads: DataFrame, aligner: str = "star", most: int = 1) -> DataFrame:
    """Uniqueness by the tags of the aligner; a missing tag is not unique."""
    tag = lambda t: F.expr(f"try_cast(tags['{t}'] AS int)")
    rule = {"star": tag("NH") <= most, "hisat2": (tag("NH") <= most) & F.col("tags")["ZS"].isNull(), "bowtie2": (tag("AS") <= most) & F.col("tags")["XS"].isNull()}[aligner]
    return reads.where(F.coalesce(rule, F.lit(False)))


def length_by_strand(reads: DataFrame) -> DataFrame:
    return reads.groupBy("length").agg(F.count_if(~has(REVERSE)).alias("plus"), F.count_if(has(REVERSE)).alias("minus"))


def ribosome_class(lengths: DataFrame) -> DataFrame:
    """The most frequent length and its class."""
    peak = lengths.agg(F.max_by("length", F.struct("plus", "minus", "length")).alias("peak"))
    return peak.withColumn("kind", F.when(F.col("peak").between(24, 34), "monosome").when(F.col("peak").between(54, 64), "disome").when(F.col("peak").between(84, 94), "trisome").otherwise("unknown"))


def end_offsets(reads: DataFrame, annotation: DataFrame, reach: int = 50) -> DataFrame:
    """Histogram of read ends around start and stop: (site, end, length, offset, n).
    A read that spans the start is counted there only."""
    a = annotation.select("name", F.col("utr5_length").alias("tis"), (F.col("utr5_length") + F.col("cds_length") - 6).alias("tts"))
    d = reads.where(~has(REVERSE)).join(small(a), reads.rname == a.name)
    at = F.when((F.col("block_start") <= F.col("tis")) & (F.col("block_end") > F.col("tis")), F.struct(F.lit("tis").alias("site"), F.col("tis").alias("p"))).when(
        (F.col("block_start") <= F.col("tts")) & (F.col("block_end") > F.col("tts")), F.struct(F.lit("tts").alias("site"), F.col("tts").alias("p"))
    )
    d = d.withColumn("at", at).where("at IS NOT NULL")
    ends = F.explode(F.array(F.struct(F.lit("5end").alias("end"), (F.col("at.p") - F.col("block_start")).alias("offset")), F.struct(F.lit("3end").alias("end"), (F.col("block_end") - 1 - F.col("at.p")).alias("offset")))).alias("x")
    return d.select(F.col("at.site").alias("site"), "length", ends).select("site", "x.end", "length", "x.offset").where(F.abs("offset") <= reach).groupBy("site", "end", "length", "offset").agg(F.count("*").alias("n"))


def frame_offsets(reads: DataFrame, annotation: DataFrame, peak: int = 30, shift: int = 2) -> DataFrame:
    """P-site offset of each read length by frame: the best frame among three
    neighbouring offsets near (length - peak) div shift + 11, its counts and
    periodicity (%)."""
    a = annotation.select("name", F.col("utr5_length").alias("cds"))
    d = reads.where(~has(REVERSE)).join(small(a), reads.rname == a.name)
    base = (11 + F.floor((F.col("length") - peak) / shift)).cast("int")
    f = F.pmod(F.col("block_start") + base - F.col("cds"), F.lit(3))
    c = d.withColumns({"base": base, "f": f}).groupBy("length", "base").agg(*[F.count_if(F.col("f") == k).alias(f"c{k}") for k in range(3)])
    top = F.greatest("c0", "c1", "c2")
    best = F.array_position(F.array("c0", "c1", "c2"), top) - 1
    p = F.col("base") + F.when(best == 0, 0).when(best == 1, -1).otherwise(1) + 1
    return c.select("length", *[F.col(f"c{k}").alias(f"rpfs{k}") for k in range(3)], p.cast("int").alias("p_site"), (F.col("c0") + F.col("c1") + F.col("c2")).alias("rpfs"), (top * 100.0 / (F.col("c0") + F.col("c1") + F.col("c2"))).alias("periodicity"))


def smooth_offsets(offsets: list[tuple[int, int]], peak: int) -> dict[int, int]:
    """Make neighbouring lengths agree, walking from the peak length both ways:
    an offset may differ from its neighbour's by one nucleotide per length, and
    is otherwise moved by whole codons.  At most a few dozen lengths."""
    out = dict(sorted(offsets))
    for step in (-1, 1):
        n = peak + step
        while n in out:
            near = out.get(n - step, out[n])
            while out[n] - near > 1:
                out[n] -= 3
            while near - out[n] > 1:
                out[n] += 3
            n += step
    return out


def psite_hits(reads: DataFrame, offsets: DataFrame) -> DataFrame:
    """(name, nt, n) of P-sites: each read hits block_start + offset for each
    offset of its length; an offset of -1 hits every position of the block.
    Nucleotides count from 1."""
    d = reads.join(small(offsets), "length")
    hits = F.flatten(F.transform("p_site", lambda o: F.when(o == -1, F.sequence(F.col("block_start"), F.col("block_end") - 1)).otherwise(F.array(F.col("block_start") + o))))
    hits = F.transform(hits, lambda x: (x + 1).cast("long"))
    return d.select(F.col("rname").alias("name"), F.explode(hits).alias("nt")).groupBy("name", "nt").agg(F.count("*").alias("n"))


def rolling_hits(reads: DataFrame, step: int = 32) -> DataFrame:
    """RNA density: a hit every ``step`` nucleotides of the block."""
    return reads.where("block_end > block_start").select(F.col("rname").alias("name"), F.explode(F.sequence((F.col("block_start") + 1).cast("long"), F.col("block_end").cast("long"), F.lit(step).cast("long"))).alias("nt")).groupBy("name", "nt").agg(F.count("*").alias("n"))


def genome_track(reads: DataFrame, offsets: DataFrame, scale: float = 1e6) -> DataFrame:
    """P-site counts per chromosome position and strand, minus strand negative,
    with RPM rounded to three places."""
    d = reads.join(small(offsets), "length")
    minus = has(REVERSE)
    at = F.explode(F.transform("p_site", lambda o: F.when(minus, F.col("block_end") - 1 - o).otherwise(F.col("block_start") + o)))
    t = d.select("rname", F.when(minus, "-").otherwise("+").alias("strand"), at.alias("start")).groupBy("rname", "strand", "start").agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("total"))
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    return t.join(F.broadcast(total)).select(F.col("rname").alias("chr"), "start", (F.col("start") + 1).alias("end"), "strand", (sign * F.col("n")).alias("density"), F.round(sign * F.col("n") * scale / F.col("total"), 3).alias("rpm"))


def digestion_frames(reads: DataFrame, annotation: DataFrame) -> DataFrame:
    """Frames of 5' and 3' ends by read length."""
    a = annotation.select("name", F.col("utr5_length").alias("u"))
    d = reads.where(~has(REVERSE)).join(small(a), reads.rname == a.name)
    five, three = F.pmod(F.col("block_start") - F.col("u"), F.lit(3)), F.pmod(F.col("block_end") - F.col("u"), F.lit(3))
    return d.groupBy("length").agg(*[F.count_if(e == k).alias(f"{n}_{k}") for n, e in (("5end", five), ("3end", three)) for k in range(3)])


def position_weights(df: DataFrame, seq: str, width: int, letters: str = "ACGT") -> DataFrame:
    """Share of each letter at each of the first ``width`` places."""
    p = df.select(F.posexplode(F.split(F.substring(seq, 1, width), "")).alias("site", "c")).where(F.col("c").isin(*letters))
    counts = p.groupBy("site").agg(*[F.count_if(F.col("c") == c).alias(c) for c in letters], F.count("*").alias("_all"))
    return counts.select("site", *[F.try_divide(F.col(c), F.col("_all")).alias(c) for c in letters])


def saturation(df: DataFrame, read: str, gene: str, steps: int = 9, step: float = 0.05) -> DataFrame:
    """Genes seen in nested samples of 5 %, 10 %, ... of the reads.  A read is in
    a sample by the first 24 bits of its MD5, so one pass counts all of them."""
    part = (F.floor(F.conv(F.substring(F.md5(F.col(read).cast("string")), 1, 6), 16, 10).cast("double") / (step * (1 << 24))) + 1).cast("int")
    first = df.groupBy(gene).agg(F.min(part).alias("part"))
    seen = first.groupBy("part").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    return grid.join(F.broadcast(seen), F.col("part") <= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("genes"))


def shuffle_counts(df: DataFrame, value: str, name: str = "name", pos: str = "pos", seed: int = 0) -> DataFrame:
    """Counts permuted within each gene by a seeded hash, the same at each run."""
    from pyspark.sql import Window

    w = Window.partitionBy(name)
    a = df.withColumn("_k", F.row_number().over(w.orderBy(pos)))
    b = df.select(F.col(name).alias("_n"), F.col(value).alias("shuffled"), F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(name), F.col(pos))), pos)).alias("_j"))
    return a.join(b, (F.col(name) == F.col("_n")) & (F.col("_k") == F.col("_j"))).drop("_n", "_j", "_k")


def candidate_offsets(ends: DataFrame, peak: int, shift: int = 2) -> DataFrame:
    """P-site of each read length from a histogram of end_offsets(): the most
    frequent 5' offset between 8 + s and 16 + s, s = (length - peak) div shift
    (ties: the smallest), with the counts of its three frames over the E, P and
    A sites.  Lengths without a 5' end near start or stop have no row."""
    h = ends.where("`end` = '5end'").groupBy("length", F.abs("offset").cast("int").alias("o")).agg(F.sum("n").alias("n"))
    seen = h.groupBy("length").agg(F.map_from_entries(F.collect_list(F.struct("o", "n"))).alias("at"))
    low = 8 + F.floor((F.col("length") - peak) / shift).cast("int")
    count = lambda o: F.coalesce(F.try_element_at("at", o), F.lit(0).cast("long"))
    best = F.array_max(F.transform(F.sequence(low, low + 8), lambda o: F.struct(count(o).alias("n"), (-o).alias("o"))))
    d = seen.withColumn("site", -best["o"])
    for k in range(3):
        d = d.withColumn(f"rpfs{k}", sum((count(F.col("site") + (k - 3 + 3 * j)) for j in range(1, 3)), count(F.col("site") + (k - 3))))
    total = F.col("rpfs0") + F.col("rpfs1") + F.col("rpfs2")
    return d.select("length", "site", "rpfs0", "rpfs1", "rpfs2", (F.col("site") + 1).alias("p_site"), total.alias("rpfs"), F.try_divide(F.greatest("rpfs0", "rpfs1", "rpfs2") * 1.0, total).alias("periodicity"))


def into_range(sites: list[tuple[int, int | None]]) -> dict[int, int | None]:
    """P-sites moved by whole codons into 7 to 19, from the shortest length on (a
    few dozen).  After the first length a move stops where the site comes within
    two of its predecessor's outside of the range, or has none; such are null."""
    out: dict[int, int | None] = {}
    for n, (length, site) in enumerate(sorted(sites)):
        last = out.get(length - 1)
        while site is not None and not 7 <= site <= 19:
            step = -3 if site > 19 else 3
            if n and (last is None or (site - last) * (1 if step < 0 else -1) <= 2):
                site = None
            else:
                site += step
        out[length] = site
    return out
