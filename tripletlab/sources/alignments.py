"""SAM text and BAM files as rows.

BAM goes through Spark's binary reader, so any file system that Spark reads
works; a file is decoded in the task that reads it, block by block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, tags map<string,string>"
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"


def with_blocks(reads: DataFrame) -> DataFrame:
    """Adds block_start, block_end (first aligned block, 0-based half-open) and
    length (read length from the sequence, or else from the CIGAR)."""
    first = F.coalesce(F.expr("try_cast(regexp_extract(cigar, '^(?:[0-9]+[SHIP])*([0-9]+)[M=X]', 1) AS int)"), F.lit(0))
    parts = F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIS=X]"), F.lit(1))
    by_cigar = F.aggregate(parts, F.lit(0), lambda t, x: t + x.cast("int"))
    return reads.withColumns({"block_start": F.col("pos"), "block_end": F.col("pos") + first, "length": F.when(F.col("seq") == "*", by_cigar).otherwise(F.length("seq"))})


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    tags = F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 20).alias("v")))
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).where("value <> ''")
    return with_blocks(
        lines.select(
            f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"),
            F.map_from_entries(tags).alias("tags"),
        )
    )


def blocks(raw: bytes) -> Iterator[bytes]:
    """Inflated blocks of a BGZF file (or of any chain of gzip members)."""
    at, piece = 0, 1 << 17  # a BGZF block is at most 64 KiB
    while at < len(raw):
        step = zlib.decompressobj(31)
        out = step.decompress(raw[at : at + piece])
        used = min(len(raw) - at, piece) - len(step.unused_data)
        while not step.eof and at + used < len(raw):
            more = raw[at + used : at + used + piece]
            out += step.decompress(more)
            used += len(more) - len(step.unused_data)
        yield out
        at += used


def _tags(data: bytes, at: int, end: int) -> list[tuple[str, str]]:
    sizes = {b"A": ("c", 1), b"c": ("b", 1), b"C": ("B", 1), b"s": ("<h", 2), b"S": ("<H", 2), b"i": ("<i", 4), b"I": ("<I", 4), b"f": ("<f", 4)}
    out = []
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode(), data[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            stop = data.index(b"\0", at)
            value, at = data[at:stop].decode("utf-8", "replace"), stop + 1
        elif kind == b"B":
            form, size = sizes[data[at : at + 1]]
            n = struct.unpack_from("<i", data, at + 1)[0]
            value = ",".join(str(struct.unpack_from(form, data, at + 5 + i * size)[0]) for i in range(n))
            at += 5 + n * size
        else:
            form, size = sizes[kind]
            v = struct.unpack_from(form, data, at)[0]
            value, at = v.decode() if isinstance(v, bytes) else str(v), at + size
        out.append((name, value))
    return out


def parse_bam(raw: bytes) -> Iterator[tuple]:
    """Records in the order of SCHEMA; bytes are kept only up to the next record."""
    stream = blocks(raw)
    data = b""

    def need(n: int) -> bytes:
        nonlocal data
        parts, have = [data], len(data)
        while have < n:
            more = next(stream, None)
            if more is None:
                raise EOFError
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        out, data = data[:n], data[n:]
        return out

    if need(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    need(struct.unpack("<i", need(4))[0])
    names = []
    for _ in range(struct.unpack("<i", need(4))[0]):
        names.append(need(struct.unpack("<i", need(4))[0])[:-1].decode())
        need(4)
    while True:
        try:
            size = struct.unpack("<i", need(4))[0]
        except EOFError:
            return
        rec = need(size)
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", rec)
        at = 32
        qname = rec[at : at + l_name - 1].decode()
        at += l_name
        cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", rec, at)) or "*"
        at += 4 * n_cigar
        packed = rec[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq] or "*"
        at += (l_seq + 1) // 2 + l_seq
        yield qname, flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, seq, _tags(rec, at, size)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows: list[tuple] = []
                for r in parse_bam(raw.as_py()):
                    rows.append(r)
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("content")
    return with_blocks(files.mapInArrow(run, SCHEMA))


def sort_reads(reads: DataFrame, parts: int) -> DataFrame:
    return reads.repartitionByRange(parts, "rname", "pos").sortWithinPartitions("rname", "pos")
