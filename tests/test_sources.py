"""File sources and sinks on small files written here."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tripletlab.sources import alignments, sequences, sinks, tables


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">t1 first\nACG\nTTT\n>t2\nGG\n\n>t3 empty\n")
    got = {r.id: (r.description, r.seq) for r in sequences.read_fasta(spark, p).collect()}
    assert got == {"t1": ("t1 first", "ACGTTT"), "t2": ("t2", "GG"), "t3": ("t3 empty", "")}
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">x\nAC\n>y\nGT\n")
    assert {r.seq for r in sequences.read_fasta(spark, f"file://{tmp_path}/b.fa.gz").collect()} == {"AC", "GT"}
    out = f"file://{tmp_path}/out"
    sequences.write_fasta(sequences.read_fasta(spark, p), out)
    assert sorted(map(tuple, sequences.read_fasta(spark, out).select("id", "seq").collect())) == [("t1", "ACGTTT"), ("t2", "GG"), ("t3", "")]


def test_fastq(spark, tmp_path):
    p = put(tmp_path / "a.fq", "@r1\nACGT\n+\nIIII\n@r2\nAC\n+\nI@\n@r3\nGGGGG\n+\n@@@@@\n")
    d = sequences.read_fastq(spark, p)
    assert [(r.record, r.id, r.seq, r.quality) for r in d.orderBy("record").collect()] == [(0, "r1", "ACGT", "IIII"), (1, "r2", "AC", "I@"), (2, "r3", "GGGGG", "@@@@@")]
    assert {r.seq for r in sequences.trim_reads(d, 3).collect()} == {"ACG", "GGG"}
    ok, rest = sequences.length_split(d, 3, 4)
    assert ok.count() == 1 and rest.count() == 2
    a, b = sequences.deinterleave(d)
    assert a.count() == 2 and b.count() == 1
    assert {r.id for r in sequences.fastq_to_fasta(d, True).collect()} == {"a.fq_1", "a.fq_2", "a.fq_3"}
    assert sequences.split_parts(d, 2).where("part in (0, 1)").count() == 3


GTF = """#c
1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t";
1\ts\texon\t31\t45\t.\t+\t.\tgene_id "g"; transcript_id "t";
1\ts\tCDS\t15\t20\t.\t+\t0\tgene_id "g"; transcript_id "t";
1\ts\tCDS\t31\t33\t.\t+\t0\tgene_id "g"; transcript_id "t";
1\ts\texon\t5\t9\t.\t-\t.\tgene_id "g"; transcript_id "u";
"""


def test_gtf_models(spark, tmp_path):
    g = sequences.read_gtf(spark, put(tmp_path / "a.gtf", GTF))
    m = sequences.region_lengths(sequences.transcripts(g))
    rows = {r.name: r for r in sequences.representative(m).collect()}
    t = rows["t"]
    assert (t.exonStarts, t.exonEnds, t.cdsStart, t.cdsEnd) == ([10, 30], [20, 45], 14, 33)
    assert (t.utr5_length, t.cds_length, t.utr3_length, t.rep_transcript) == (4, 9, 12, True)
    assert (rows["u"].cds_length, rows["u"].utr3_length, rows["u"].rep_transcript) == (0, 5, False)
    chrom = spark.createDataFrame([("1", "ACGT" * 12)], "id string, seq string")
    longer = {r.name: r for r in sequences.add_utr(m, chrom, 10).collect()}
    assert longer["t"].txStart == 4 and longer["t"].utr5_length == 10 and longer["t"].modified
    s = {r.name: r.seq for r in sequences.transcript_sequences(m, chrom).collect()}
    assert s["t"] == ("ACGT" * 12)[10:20] + ("ACGT" * 12)[30:45] and s["u"] == "ACGTA"[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert sequences.gene_models_to_gtf(m).count() == 3
    assert sequences.cds_convention(g).first().closed == 0
    line = "t\t1\t+\t10\t45\t14\t33\t2\t10,30,\t20,45,\t0\tg\tcmpl\tcmpl\t0,0,\n"
    gp = sequences.region_lengths(sequences.read_genepred(spark, put(tmp_path / "a.gp", line))).first()
    assert gp.exonStarts == [10, 30] and gp.cds_length == 9


def test_tables(spark, tmp_path):
    head = "name\tnow_nt\tfrom_tis\tfrom_tts\tregion\tcodon\ta_f0\ta_f1\ta_f2\n"
    d = tables.read_density(spark, put(tmp_path / "d.txt", head + "t\t1\t0\t-1\tcds\tATG\t1\t2\t3\n"))
    assert d.first().a_f2 == 3 and dict(d.dtypes)["a_f0"] == "bigint"
    with pytest.raises(ValueError):
        tables.read_density(spark, put(tmp_path / "bad.txt", "x\ty\n1\t2\n"))
    ann = "chromosome\tgene_id\ttranscript_id\tstart\tend\tutr5_length\tcds_length\tutr3_length\tstrand\trep_transcript\tmodified\n"
    a = put(tmp_path / "n.txt", ann + "1\tg\tt\t1\t9\t3\t6\t3\t+\tTrue\tFalse\n1\tg\tu\t1\t9\t0\t0\t3\t+\tFalse\tFalse\n")
    assert [r.transcript_id for r in tables.read_annotation(spark, a, representative=True).collect()] == ["t"]
    assert tables.read_annotation(spark, a, coding=True).first().length == 12
    assert tables.fitting_genes(tables.read_annotation(spark, a), 2, 4, 3)[0].count() == 1
    o = "length\tframe0\trpfs0\tframe1\trpfs1\tframe2\trpfs2\tp_site\trpfs\tperiodicity\tribo\n"
    off = tables.read_offsets(spark, put(tmp_path / "o.txt", o + "28\t0\t9\t1\t1\t2\t0\t13\t10\t90.0\tfirst\n29\t0\t9\t1\t9\t2\t9\t13\t27\t33.0\tfirst\n"), 50).collect()
    assert [(r.length, r.p_site) for r in off] == [(28, [12])]
    assert {r.name for r in tables.read_list(spark, put(tmp_path / "l.txt", "x\ttranscript_id\n1\tt\n2\tu\n")).collect()} == {"t", "u"}
    assert [r.codon for r in tables.read_codons(spark, put(tmp_path / "c.txt", "aug\nac\n")).collect()] == ["ATG"]
    c = tables.read_counts(spark, put(tmp_path / "m.txt", "#x\nGeneid\tChr\tStart\tEnd\tStrand\tLength\tp/a.bam\nt\t1\t1\t2\t+\t2\t5\n"))
    assert c.columns[-1] == "a" and c.first().a == 5
    assert tables.read_bedgraph(spark, put(tmp_path / "b.bg", "1\t0\t2\t1.5\n1\t2\t3\tNaN\n")).count() == 1
    pk = tables.read_peaks(spark, put(tmp_path / "p.txt", "name\tBHFDR\na\t0.01\nb\t-\n"), 0.05)
    assert [r.name for r in pk.collect()] == ["a"]
    log = tables.read_aligner_logs(spark, put(tmp_path / "x.log", "# reads processed: 10\nfoo\nReported 7 alignments\n")).first()
    assert (log.processed, log.reported) == (10, 7)
    orf = tables.read_orf_bed(spark, put(tmp_path / "o.bed", "1\t5\t9\to;g;r;uORF\t0\t+\n1\t1\t3\to;g;r;uORF\t0\t+\n")).first()
    assert orf.length == 6 and orf.exons[0].start == 1
    t = tables.read_orf_table(spark, put(tmp_path / "t.tsv", "Gid\tGenomePos\tBlocks\tTisType\tAALen\tRiboPvalue\ng\t1:5-9:+\t5-7,8-9\tuORF\t9\t0.01\ng\t1:5-9:+\t5-7\tAnnotated\t9\t0.01\n"))
    assert t.count() == 1 and t.first().blocks[1].start == 8 and t.first().strand == "+"


SAM = "@HD\tVN:1\nr1\t0\tt\t3\t30\t2S5M\t*\t0\t0\tACGTACG\tIIIIIII\tNH:i:1\tXS:Z:a:b\nr2\t16\tt\t9\t0\t4M\t*\t0\t0\tACGT\tIIII\n"


def test_sam(spark, tmp_path):
    d = alignments.read_sam(spark, put(tmp_path / "a.sam", SAM)).orderBy("qname").collect()
    assert (d[0].pos, d[0].block_start, d[0].block_end, d[0].length, d[0].tags) == (2, 2, 7, 7, {"NH": "1", "XS": "a:b"})
    assert d[1].tags == {} and d[1].flag == 16


def bam_bytes(records):
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"t\0" + struct.pack("<i", 1000)
    for name, flag, pos, cigar, seq, tags in records:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + b"\x1e" * len(seq) + tags
        out += struct.pack("<i", len(body)) + body
    return out


def bgzf(data, size=300):
    out = b""
    for i in [*range(0, len(data), size), None]:
        part = b"" if i is None else data[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    tags = b"NHC\x02" + b"XZZhey\0" + b"ABBC\x02\x00\x00\x00\x05\x06"
    recs = [(f"read{i}", 0 if i % 2 else 16, 10 + i, [(2, "S"), (20, "M")], "ACGTN" * 4 + "AC", tags) for i in range(50)]
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes(recs)))
    d = alignments.read_bam(spark, f"file://{tmp_path}")
    assert d.count() == 50
    r = d.where("qname = 'read7'").first()
    assert (r.rname, r.pos, r.cigar, r.seq, r.block_end, r.length) == ("t", 17, "2S20M", "ACGTN" * 4 + "AC", 37, 22)
    assert r.tags == {"NH": "2", "XZ": "hey", "AB": "5,6"}
    assert [x.pos for x in alignments.sort_reads(d, 2).collect()] == [10 + i for i in range(50)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.23456), ("b", 2.0)], "name string, v double")
    sinks.write_tsv(d, f"file://{tmp_path}/t", by=["name"], places=2)
    assert sorted(p.name for p in (tmp_path / "t").glob("name=*")) == ["name=a", "name=b"]
    t = spark.createDataFrame([("1", 5, 6, "+", 1, 1.5), ("1", 2, 3, "-", -1, -1.5)], "chr string, start int, end int, strand string, density long, rpm double")
    sinks.write_bedgraph(t, f"file://{tmp_path}/b")
    assert [r.start for r in tables.read_bedgraph(spark, f"file://{tmp_path}/b").collect()] == [2, 5]
    sinks.write_bedgraph(t, f"file://{tmp_path}/s", by_strand=True)
    assert len(list((tmp_path / "s").glob("strand=*"))) == 2


def test_streaming(spark, tmp_path):
    from tripletlab.streaming import windows

    src = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    table.repartition(1).write.parquet(f"file://{tmp_path}/in/e")
    stream = windows.tumbling(windows.read_stream(spark, f"file://{tmp_path}/in/e", table.schema))
    q = stream.writeStream.format("memory").outputMode("complete").queryName("tumbling_out").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("tumbling_out").agg(F.sum("n")).first()[0]
    assert got == table.count()
    assert sorted(map(str, spark.table("tumbling_out").select("start", "event_type", "n").collect())) == sorted(map(str, windows.tumbling(table).select("start", "event_type", "n").collect()))
