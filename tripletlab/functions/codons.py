"""The codon dimension and its amino-acid families."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Standard genetic code, bases in the order T, C, A, G (fixed values).
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: One-letter to three-letter codes (fixed values).
ABBR = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "HIS", "I": "Ile",
    "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Stop",
}
CODE = {"".join(c): a for c, a in zip(product(BASES, repeat=3), AMINO)}
STOPS = [c for c, a in CODE.items() if a == "*"]


def codon_dimension(spark: SparkSession) -> DataFrame:
    """64 rows: codon, aa (one letter), abbr (three letters)."""
    return spark.createDataFrame([(c, a, ABBR[a]) for c, a in CODE.items()], "codon string, aa string, abbr string")


def code_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])


def family(aa: Column) -> Column:
    """Collapse split families such as ``Ser4`` and ``Ser2`` into ``Ser``."""
    return F.substring(aa, 1, 3)
