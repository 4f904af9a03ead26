"""Sequence functions as column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletlab.functions.codons import code_map


def revcomp(seq: Column) -> Column:
    """Reverse complement, case kept; U pairs with A."""
    return F.translate(F.reverse(seq), "ACGTUacgtu", "TGCAAtgcaa")


def triplets(seq: Column) -> Column:
    """Array of the complete codons of a sequence."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seq, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translate_nt(seq: Column, start: bool = False, stop: bool = False) -> Column:
    """Amino acids of a sequence; null unless its length is a multiple of three
    and it holds A, C, G, T only (and, if asked for, starts with ATG and ends
    with a stop codon)."""
    up = F.upper(seq)
    ok = (F.length(up) % 3 == 0) & up.rlike("^[ACGT]*$")
    if start:
        ok = ok & up.startswith("ATG")
    if stop:
        ok = ok & up.rlike("(TAA|TAG|TGA)$")
    table = code_map()
    return F.when(ok, F.array_join(F.transform(triplets(up), lambda c: table[c]), ""))


def kmers(seq: Column, width: int) -> Column:
    """All windows of ``width`` letters; the whole sequence if it is shorter."""
    last = F.greatest(F.lit(1), F.length(seq) - width + 1)
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(seq, i, F.lit(width)))


def count_of(seq: Column, letter: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))).cast("long")


def composition(df: DataFrame, id_col: str, seq_col: str, letters: str = "ACGTN") -> DataFrame:
    """Letters of each sequence, with a total row (id null); letters are counted
    row by row, so only numbers are grouped."""
    names = [f"n_{c.lower()}" for c in letters]
    each = df.select(id_col, F.length(seq_col).cast("long").alias("length"), *[count_of(F.col(seq_col), c).alias(n) for c, n in zip(letters, names)])
    return each.rollup(id_col).agg(*[F.sum(c).alias(c) for c in ("length", *names)])


def splice(seq: Column, starts: Column, ends: Column, strand: Column) -> Column:
    """Join half-open blocks of a sequence; reverse complement on the minus strand."""
    joined = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(seq, a + 1, b - a)), "")
    return F.when(strand == "-", revcomp(joined)).otherwise(joined)


def random_sequence(length: Column, seed: Column, alphabet: str = "ACGT") -> Column:
    """A sequence that depends on the seed alone, so reruns agree."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    pick = F.transform(F.sequence(F.lit(1), length), lambda i: F.element_at(letters, (F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))) + 1).cast("int")))
    return F.array_join(pick, "")


def phred_offset(df: DataFrame, quality_col: str) -> DataFrame:
    """Smallest and largest quality code and the encoding that they imply."""
    codes = F.transform(F.split(F.col(quality_col), ""), lambda c: F.ascii(c))
    span = df.select(F.array_min(codes).alias("lo"), F.array_max(codes).alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return span.withColumn("encoding", F.when(F.col("lo") < 59, "phred33").when(F.col("lo") < 64, "solexa64").otherwise("phred64"))


#: Kyte-Doolittle hydropathy (published values, fixed).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}


def gravy(protein: Column) -> Column:
    """Mean hydropathy of a protein."""
    table = F.create_map(*[F.lit(x) for kv in HYDROPATHY.items() for x in kv])
    total = F.aggregate(F.split(protein, ""), F.lit(0.0), lambda a, c: a + F.coalesce(table[c], F.lit(0.0)))
    return F.try_divide(total, F.length(protein))


def fractions(protein: Column) -> dict[str, Column]:
    """Shares of residues that favour helix, turn and sheet."""
    share = lambda letters: F.try_divide(F.length(F.regexp_replace(protein, f"[^{letters}]", "")), F.length(protein))
    return {"helix": share("VIYFWL"), "turn": share("NPGS"), "sheet": share("EMAL")}


#: pKa values of side chains and ends (published values, fixed).
PKA_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PKA_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}


def isoelectric_point(protein: Column, steps: int = 40) -> Column:
    """Bisection on the net charge, ``steps`` halvings of [0, 14], in the row."""

    def charge(ph: Column) -> Column:
        up = 1 / (1 + F.pow(F.lit(10.0), ph - 7.5))
        down = 1 / (1 + F.pow(F.lit(10.0), 3.55 - ph))
        for aa, pka in PKA_POSITIVE.items():
            up = up + count_of(protein, aa) / (1 + F.pow(F.lit(10.0), ph - pka))
        for aa, pka in PKA_NEGATIVE.items():
            down = down + count_of(protein, aa) / (1 + F.pow(F.lit(10.0), pka - ph))
        return up - down

    bounds = F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        basic = charge(mid) > 0
        return F.struct(F.when(basic, mid).otherwise(acc["lo"]).alias("lo"), F.when(basic, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bounds, halve, lambda a: (a["lo"] + a["hi"]) / 2)


#: Vihinen flexibility of residues and the weights of a window of nine (published values, fixed).
FLEXIBILITY = {
    "A": 0.984, "C": 0.906, "E": 1.094, "D": 1.068, "G": 1.031, "F": 0.915, "I": 0.927, "H": 0.950, "K": 1.102, "M": 0.952,
    "L": 0.935, "N": 1.048, "Q": 1.037, "P": 1.049, "S": 1.046, "R": 1.008, "T": 0.997, "W": 0.904, "V": 0.931, "Y": 0.929,
}
FLEXIBILITY_WEIGHTS = [0.25, 0.4375, 0.625, 0.8125, 1.0, 0.8125, 0.625, 0.4375, 0.25]


def flexibility(protein: Column) -> Column:
    """Weighted flexibility of each window of nine residues; shorter proteins
    have none, and residues that are not listed count as nothing."""
    table = F.create_map(*[F.lit(x) for kv in FLEXIBILITY.items() for x in kv])
    each = F.transform(F.split(protein, ""), lambda c: F.coalesce(table[c], F.lit(0.0)))
    window = lambda i: F.aggregate(F.zip_with(F.slice(each, i, F.lit(9)), F.array(*[F.lit(w) for w in FLEXIBILITY_WEIGHTS]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) / 5.25
    return F.when(F.length(protein) >= 9, F.transform(F.sequence(F.lit(1), F.length(protein) - 8), window)).otherwise(F.array().cast("array<double>"))
