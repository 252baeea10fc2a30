import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import readers, writers


def test_csv_quotes_and_bom(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes('﻿id, Name,name\n1,"b,c","d""e"\n\n2,x,y\n'.encode())
    df = readers.read_table(spark, str(p))
    assert readers.header(spark, str(p)) == ["id", "Name", "name"] == df.columns
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "b,c", 'd"e'), ("2", "x", "y")]


def test_strict_width_and_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    assert readers.read_table(spark, str(tmp_path / "a.csv")).count() == 2
    for name in ("a.csv", "b.csv"):
        with pytest.raises(ValueError):
            readers.read_table(spark, str(tmp_path / name), strict=True)
    assert [r["a"] for r in readers.read_table(spark, str(tmp_path / "b.csv")).collect()] == ["2"]


def test_fasta(spark, tmp_path):
    p = tmp_path / "m.fa"
    p.write_text(">hsa-miR-1 MIMAT1 x\nugga\nAUGT\n>mmu-miR-1 MIMAT2\nACGU\n>hsa-let-7 MIMAT3\nnnn\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(p), "hsa-").collect()] == [("hsa-miR-1", "MIMAT1", "UGGAAUGU")]


def test_transposed_and_mapping(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("\ts1\ts2\ts3\nU1\t1\t2\t3\nU2\t4\tx\t6\n")
    got = readers.read_transposed(spark, str(tmp_path / "m.tsv"), 2)
    assert sorted(tuple(r) for r in got.collect() if r["value"] is not None) == [("U1", "s1", 1.0), ("U1", "s2", 2.0), ("U2", "s1", 4.0)]
    (tmp_path / "map.tsv").write_text("U1\tM\tI\t9606\tmiRNA\tx-5p\nU1\tM\tI\t9606\tmiRNA\ty-3p\nU2\tM\tI\t10090\tmiRNA\tz\nU3\tM\tI\t9606\tpre_miRNA\tp\nU4\tM\tI\t9606\tpre_miRNA\tp\nshort\tline\n")
    pre, mature = readers.read_id_mapping(spark, str(tmp_path / "map.tsv"))
    assert [tuple(r) for r in pre.collect()] == [("U3", "p")] and sorted(tuple(r) for r in mature.collect()) == [("U1", "x-5p"), ("U1", "y-3p")]


def test_zip_series_and_report(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("base_x.csv", "sample_id,classe,f\ns1,1,2.5\ns2,0,3.5\n")
        z.writestr("other.txt", "no")
    lines = readers.read_zip_entry(spark, str(tmp_path / "c.zip"), r"base_.*\.csv")
    got = readers.split_lines(lines, ["sample_id", "classe", "f"])
    assert sorted(tuple(r) for r in got.collect()) == [("s1", "1", "2.5"), ("s2", "0", "3.5")]
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write('!Sample_title\t"a"\t"b"\n!series_matrix_table_begin\n"ID_REF"\t"G1"\t"G2"\n"m1"\t1.5\t2\n!series_matrix_table_end\n')
    meta, cells = readers.read_series_matrix(spark, str(tmp_path / "s.txt.gz"))
    assert sorted(tuple(r) for r in meta.collect()) == [("Sample_title", 0, "a"), ("Sample_title", 1, "b")]
    assert sorted(tuple(r) for r in cells.collect()) == [("m1", "G1", 1.5), ("m1", "G2", 2.0)]
    (tmp_path / "r.txt").write_text("x\nAUC = 0,97\n")
    assert readers.scrape_number(spark, str(tmp_path / "r.txt"), r"AUC = ([\d,.]+)") == 0.97


def test_options():
    assert readers.external_options("log2", "mean")["scale"] == "log2"
    for bad in (("x",), ("linear", "mean"), ("log2", "none", "a b")):
        with pytest.raises(ValueError):
            readers.external_options(*bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c'), (2, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(writers.csv_cell(F.col("t"))).collect()] == ['"a""b,c"', ""]
    writers.write_csv(df, str(tmp_path / "out"), 1)
    back = readers.read_table(spark, str(tmp_path / "out"))
    assert sorted((r["i"], r["t"] or "") for r in back.collect()) == [("1", 'a"b,c'), ("2", "")]
    df.write.parquet(str(tmp_path / "p"))
    writers.replace_with_backup(spark.read.parquet(str(tmp_path / "p")).where("i = 1"), str(tmp_path / "p"), str(tmp_path / "p.bak"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and spark.read.parquet(str(tmp_path / "p.bak")).count() == 2
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert writers.file_digests(spark, str(tmp_path / "f.bin")).first()["sha256"] == "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    page = writers.dashboard("t<", {"v": df})
    assert "t&lt;" in page and "a\\\"b,c" in page


def test_dashboard_writes_whole_views(spark, tmp_path):
    df = spark.range(250).selectExpr("id", "'x' AS t")
    assert writers.dashboard("d", {"v": df}).count("<tr>") == 101
    writers.write_dashboard(spark, "d", {"all of it": df}, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/data/all_of_it")).count() == 250
    assert spark.read.text(str(tmp_path / "d/page"), wholetext=True).count() == 1


def test_fasta_and_missing_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x1 A1 a > b\nACGT\nAC\n>y2\nNN\n>x3\r\nuu\r\n")
    got = [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fa"), "x").orderBy("name").collect()]
    assert got == [("x1", "A1", "ACGUAC"), ("x3", "", "UU")]
    assert readers.read_or(spark, str(tmp_path / "none"), [("q",)], "a string").collect()[0][0] == "q"
    (tmp_path / "bad.csv").write_text("a,a\n1,2\n3\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.read_table(spark, str(tmp_path / "bad.csv"), strict=True)
    (tmp_path / "wide.csv").write_text('a,b\n1,"2,3"\nodd\n')
    with pytest.raises(ValueError, match="'odd' has 1 cells"):
        readers.read_table(spark, str(tmp_path / "wide.csv"), strict=True)


def test_training_policy(spark):
    from cohortlens.plans import pipelines

    markers = spark.createDataFrame([("a",), ("b",)], "name string")
    policy = lambda *rows: spark.createDataFrame(list(rows), "name string, training_weight string, use_in_training string")
    assert [tuple(r) for r in pipelines.apply_policy(markers, policy(("a", "2", "sim"), ("b", "1", "nao"))).collect()] == [("a", 2.0)]
    for bad in ([("a", "2", "sim")], [("a", "2", "sim"), ("b", "0", "sim")], [("a", "2", "sim"), ("b", "1", "perhaps")], [("a", "2", "sim"), ("b", "1", "sim"), ("c", "1", "sim")]):
        with pytest.raises(ValueError):
            pipelines.apply_policy(markers, policy(*bad))
