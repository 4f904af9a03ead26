"""FASTA, FASTQ, GTF and gene-prediction sources as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): one row per record, lines joined; ``.gz`` too."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r")).where("trim(r) <> ''")
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(r, length(regexp_extract(r, '^([^\\\\r\\\\n]*)', 1)) + 1)"), r"\s+", "")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), body.alias("seq"))


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, id, seq, quality); a file is read as one row, so large inputs
    should be many files (gzip, the usual form, cannot be split either)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n").alias("l"))
    n = F.floor(F.size("l") / 4).cast("int")
    rec = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("record"), F.regexp_replace(F.get("l", i * 4), "^@", "").alias("id"), F.get("l", i * 4 + 1).alias("seq"), F.get("l", i * 4 + 3).alias("quality")))
    return whole.where(n > 0).select("file", F.explode(rec).alias("x")).select("file", "x.*")


def trim_reads(reads: DataFrame, length: int) -> DataFrame:
    """Cut reads to ``length``; shorter ones go."""
    return reads.where(F.length("seq") >= length).withColumns({"seq": F.substring("seq", 1, length), "quality": F.substring("quality", 1, length)})


def length_split(df: DataFrame, low: int, high: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Rows within [low, high] and the others."""
    ok = F.length(seq).between(low, high)
    return df.where(ok), df.where(~ok)


def deinterleave(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reads.where("record % 2 = 0"), reads.where("record % 2 = 1")


def fastq_to_fasta(reads: DataFrame, renumber: bool = False) -> DataFrame:
    ids = F.concat_ws("_", F.regexp_extract("file", r"([^/]+)$", 1), (F.col("record") + 1).cast("string")) if renumber else F.col("id")
    return reads.select(ids.alias("id"), "seq")


def split_parts(df: DataFrame, parts: int, key: str = "id") -> DataFrame:
    """A part number for each record, by a hash of its id; none is lost."""
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    schema = "chrom string, source string, feature string, start int, end int, score string, strand string, phase string, attribute string"
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    items = F.filter(F.transform(F.split("attribute", ";"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^([^ =]+)", 1), F.regexp_replace(F.regexp_replace(x, r"^[^ =]+[ =]", ""), '"', "")))
    # a repeated attribute keeps its last value
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["col1"]), F.map_from_arrays(F.array(p["col1"]), F.array(p["col2"]))))
    return df.withColumn("attributes", last).drop("attribute")


def transcripts(gtf: DataFrame) -> DataFrame:
    """Gene models: exon arrays (0-based half-open) and CDS bounds per transcript.
    Transcript and gene come from transcript_id and gene_id, or else from Parent
    and ID.  A start or stop codon that begins or ends at most three nucleotides
    outside the CDS belongs to it."""
    a = lambda k: F.col("attributes")[k]
    part = F.col("feature").isin("exon", "CDS", "start_codon", "stop_codon")
    own = F.when(part, F.coalesce(a("transcript_id"), a("Parent"))).otherwise(F.coalesce(a("transcript_id"), a("ID")))
    t = gtf.where(part | F.col("feature").isin("mRNA", "transcript")).withColumns({"name": F.explode(F.split(own, ",")), "name2": F.coalesce(a("gene_id"), F.when(~part, a("Parent")))})
    exon = F.when(F.col("feature") == "exon", F.struct((F.col("start") - 1).alias("s"), F.col("end").alias("e")))
    g = t.groupBy("name").agg(
        F.min("name2").alias("name2"), F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.sort_array(F.collect_list(exon)).alias("exons"),
        F.min(F.when(F.col("feature") == "CDS", F.col("start") - 1)).alias("cdsStart"), F.max(F.when(F.col("feature") == "CDS", F.col("end"))).alias("cdsEnd"),
        F.min(F.when(F.col("feature").endswith("_codon"), F.col("start") - 1)).alias("_low"), F.max(F.when(F.col("feature").endswith("_codon"), F.col("end"))).alias("_high"),
    )
    low, high = F.col("cdsStart") - F.col("_low") <= 3, F.col("_high") - F.col("cdsEnd") <= 3
    g = g.withColumns({"cdsStart": F.when(low, F.least("cdsStart", "_low")).otherwise(F.col("cdsStart")), "cdsEnd": F.when(high, F.greatest("cdsEnd", "_high")).otherwise(F.col("cdsEnd"))})
    g = g.where(F.size("exons") > 0)
    first, last = F.get("exons", F.lit(0)), F.element_at("exons", -1)
    return g.select(
        "name", "name2", "chrom", "strand", first["s"].alias("txStart"), last["e"].alias("txEnd"), F.coalesce("cdsStart", last["e"]).alias("cdsStart"), F.coalesce("cdsEnd", last["e"]).alias("cdsEnd"),
        F.transform("exons", lambda x: x["s"]).alias("exonStarts"), F.transform("exons", lambda x: x["e"]).alias("exonEnds"),
    )


def read_genepred(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "name string, chrom string, strand string, txStart int, txEnd int, cdsStart int, cdsEnd int, exonCount int, exonStarts string, exonEnds string, "
        "score string, name2 string, cdsStartStat string, cdsEndStat string, exonFrames string"
    )
    df = spark.read.schema(schema).option("sep", "\t").csv(path)
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    return df.withColumns({"exonStarts": ints("exonStarts"), "exonEnds": ints("exonEnds")})


def region_lengths(models: DataFrame) -> DataFrame:
    """Lengths of 5' UTR, CDS and 3' UTR, by overlap of each exon with the three
    stretches, turned round on the minus strand."""

    def within(a: Column, b: Column) -> Column:
        each = F.zip_with("exonStarts", "exonEnds", lambda s, e: F.greatest(F.lit(0), F.least(e, b) - F.greatest(s, a)))
        return F.aggregate(each, F.lit(0), lambda t, x: t + x)

    left, mid, right = within(F.col("txStart"), F.col("cdsStart")), within(F.col("cdsStart"), F.col("cdsEnd")), within(F.col("cdsEnd"), F.col("txEnd"))
    coding = F.col("cdsEnd") > F.col("cdsStart")
    plus = F.col("strand") == "+"
    return models.withColumns(
        {
            "utr5_length": F.when(coding, F.when(plus, left).otherwise(right)).otherwise(0),
            "cds_length": F.when(coding, mid).otherwise(0),
            "utr3_length": F.when(coding, F.when(plus, right).otherwise(left)).otherwise(left + mid + right),
        }
    )


def representative(models: DataFrame) -> DataFrame:
    """Adds rep_transcript: the longest CDS, then gene, 5' and 3' UTR, then name."""
    w = Window.partitionBy("name2").orderBy(F.desc("cds_length"), F.desc(F.col("txEnd") - F.col("txStart")), F.desc("utr5_length"), F.desc("utr3_length"), "name")
    return models.withColumn("rep_transcript", F.row_number().over(w) == 1)


def add_utr(models: DataFrame, chromosomes: DataFrame, length: int) -> DataFrame:
    """Lengthen UTRs shorter than ``length`` to it, clamped to the chromosome;
    ``modified`` says where.  Sides follow the strand."""
    d = models.join(chromosomes.select(F.col("id").alias("chrom"), F.length("seq").alias("_size")), "chrom")
    plus = F.col("strand") == "+"
    need = lambda a, b: F.greatest(F.lit(0), length - F.when(plus, F.col(a)).otherwise(F.col(b)))
    left, right = F.least(need("utr5_length", "utr3_length"), F.col("txStart")), F.least(need("utr3_length", "utr5_length"), F.col("_size") - F.col("txEnd"))
    d = d.withColumns({"_l": left, "_r": right})
    return d.withColumns(
        {
            "exonStarts": F.transform("exonStarts", lambda x, i: F.when(i == 0, x - F.col("_l")).otherwise(x)),
            "exonEnds": F.transform("exonEnds", lambda x, i: F.when(i == F.size("exonEnds") - 1, x + F.col("_r")).otherwise(x)),
            "txStart": F.col("txStart") - F.col("_l"), "txEnd": F.col("txEnd") + F.col("_r"),
            "utr5_length": F.col("utr5_length") + F.when(plus, F.col("_l")).otherwise(F.col("_r")),
            "utr3_length": F.col("utr3_length") + F.when(plus, F.col("_r")).otherwise(F.col("_l")),
            "modified": (F.col("_l") + F.col("_r")) > 0,
        }
    ).drop("_l", "_r", "_size")


def transcript_sequences(models: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Spliced sequence of each model; chromosomes are joined by name."""
    from tripletlab.functions.sequence import splice

    return models.join(chromosomes.select(F.col("id").alias("chrom"), F.col("seq").alias("_chr")), "chrom").withColumn("seq", splice(F.col("_chr"), F.col("exonStarts"), F.col("exonEnds"), F.col("strand"))).drop("_chr")


def cds_convention(gtf: DataFrame, most: int = 2000) -> DataFrame:
    """How often CDS lengths are no multiple of three if intervals are closed,
    half-open or open, over at most ``most`` transcripts."""
    cds = gtf.where("feature = 'CDS'").groupBy(F.col("attributes")["transcript_id"].alias("t")).agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.count("*").alias("k")).orderBy("t").limit(most)
    return cds.agg(*[F.sum(F.when((F.col("n") + s * F.col("k")) % 3 != 0, 1).otherwise(0)).alias(n) for n, s in (("half_open", 0), ("closed", 1), ("open", -1))])


def gene_models_to_gtf(models: DataFrame, full: bool = False) -> DataFrame:
    """GTF exon lines of gene models; ``full`` adds a transcript line and the CDS
    part of each exon (none for a model without CDS)."""

    def line(feature: Column, start: Column, end: Column, extra: Column) -> Column:
        attr = F.concat(F.format_string('gene_id "%s"; transcript_id "%s";', F.col("name2"), F.col("name")), extra)
        return F.concat_ws("\t", "chrom", F.lit("models"), feature, (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), attr)

    x = models.select("*", F.posexplode(F.arrays_zip("exonStarts", "exonEnds")).alias("i", "x"))
    start, end, number = F.col("x.exonStarts"), F.col("x.exonEnds"), F.format_string(' exon_number "%d";', F.col("i") + 1)
    exon = line(F.lit("exon"), start, end, number)
    if not full:
        return x.select(exon.alias("value"))
    low, high = F.greatest(start, F.col("cdsStart")), F.least(end, F.col("cdsEnd"))
    whole = F.when(F.col("i") == 0, line(F.lit("transcript"), F.col("txStart"), F.col("txEnd"), F.lit("")))
    lines = F.array(whole, exon, F.when(low < high, line(F.lit("CDS"), low, high, number)))
    return x.select(F.explode(F.filter(lines, lambda v: v.isNotNull())).alias("value"))
