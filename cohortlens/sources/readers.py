"""Tables, transposed matrices, mappings, FASTA, JSON models, ZIP entries, series matrices and reports as frames."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names in the first line, trimmed, without a byte-order mark; one line is read."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return [c.strip() for c in next(csv.reader([line[0].lstrip(BOM)], delimiter=sep))]


def read_table(spark: SparkSession, path: str, sep: str = ",", strict: bool = False) -> DataFrame:
    """All columns as text. Blank lines go; quotes are doubled inside quoted cells.

    Lenient: short rows end in nulls. Strict: names must be unique and every row as wide as the header, which Spark
    only tests when it parses all columns, so rows of another width are looked for on the raw lines.
    """
    names = header(spark, path, sep)
    if strict:
        if not all(names) or len(set(names)) != len(names):
            raise ValueError(f"{path}: empty or repeated column names")
        bad = row_widths(spark, path, sep).where(F.col("width") != len(names)).limit(1).collect()
        if bad:
            raise ValueError(f"{path}: {bad[0]['line']!r} has {bad[0]['width']} cells, the header {len(names)}")
    # a name that repeats means its last column
    last = {n: i for i, n in enumerate(names)}
    raw = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("header", True).option("enforceSchema", True)
    raw = raw.option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(", ".join(f"_{i} string" for i in range(len(names)))).csv(path)
    return raw.select(*(F.col(f"_{i}").alias(n) for n, i in sorted(last.items(), key=lambda x: x[1])))


def row_widths(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(line, width) of every non-blank line, its beginning and its cells; separators inside quotes don't count."""
    unquoted = F.regexp_replace("value", r'"([^"]|"")*"', "")
    return spark.read.text(path).where(F.trim("value") != "").select(F.left("value", F.lit(60)).alias("line"), (F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep))) + 1).alias("width"))


def filled(df: DataFrame) -> DataFrame:
    """Missing cells as empty text."""
    return df.na.fill("")


def read_transposed(spark: SparkSession, path: str, samples: int | None = None, skip: int = 0) -> DataFrame:
    """(row, sample, value) of a tab-separated matrix with samples as columns; ``samples`` of them after ``skip``."""
    wide = read_table(spark, path, "\t")
    first, columns = wide.columns[0], wide.columns[1 + skip :][:samples]
    return wide.select(F.col(f"`{first}`").alias("row"), *(F.col(f"`{c}`") for c in columns)).unpivot(["row"], columns, "sample", "value").withColumn("value", F.col("value").try_cast("double"))


def read_id_mapping(spark: SparkSession, path: str, taxid: str = "9606") -> tuple[DataFrame, DataFrame]:
    """(precursors, mature): (urs, name) of a mapping without header: precursors keep the first id of a name, mature ones all.

    Fields: urs, database, id, taxid, type, name. Lines of fewer than six fields and of other species go.
    """
    cells = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.size(cells) >= 6)
    rows = lines.select("line", F.element_at(cells, 1).alias("urs"), F.element_at(cells, 4).alias("taxid"), F.element_at(cells, 5).alias("kind"), F.trim(F.element_at(cells, 6)).alias("name"))
    rows = rows.where(F.col("taxid") == taxid)
    w = Window.partitionBy("name").orderBy("line")
    precursors = rows.where("kind = 'pre_miRNA'").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("urs", "name")
    return precursors, rows.where("kind = 'miRNA'").select("urs", "name").distinct()


def read_fasta(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(name, accession, sequence) of records whose name starts with ``prefix`` and whose cleaned sequence is not empty.

    A record begins with ``>`` at the beginning of a line; one inside a header is a letter like any other.
    """
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    value = F.regexp_replace("value", "^>", "")  # the first of a file
    head = F.split(F.regexp_extract(value, r"^([^\r\n]*)", 1), r"\s+")
    body = F.regexp_replace(F.regexp_extract(value, r"(?s)^[^\r\n]*[\r\n]+(.*)$", 1), r"\s", "")
    out = records.select(
        F.element_at(head, 1).alias("name"), F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")).alias("accession"),
        F.regexp_replace(F.translate(F.upper(body), "T", "U"), "[^ACGU]", "").alias("sequence"),
    )
    return out.where(F.col("name").startswith(prefix) & (F.col("sequence") != ""))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row of the given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_or(spark: SparkSession, path: str, fallback: list[tuple], schema: str) -> DataFrame:
    """A table, or the given rows where the path does not exist."""
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(fallback, schema)


def read_zip_entry(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, entry, line_number, line) of the entries whose names match; archives are spread over tasks, lines stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for entry in sorted(n for n in z.namelist() if re.search(pattern, n)):
                        rows: list[str] = []
                        start = 0
                        with z.open(entry) as f:
                            for line in io.TextIOWrapper(f, "utf-8-sig"):
                                rows.append(line.rstrip("\r\n"))
                                if len(rows) == 10_000:
                                    yield _lines(name, entry, start, rows)
                                    start, rows = start + len(rows), []
                        if rows:
                            yield _lines(name, entry, start, rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, entry string, line_number long, line string")


def _lines(archive: str, entry: str, start: int, rows: list[str]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([entry] * n), pa.array(range(start, start + n), pa.int64()), pa.array(rows)], ["archive", "entry", "line_number", "line"])


def split_lines(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """Columns of unquoted lines after the header; a line of another width is an error."""
    cells = F.split("line", sep)
    ok = F.when(F.size(cells) == len(names), cells).otherwise(F.raise_error(F.concat(F.lit("width of line "), F.col("line_number").cast("string"))).cast("array<string>"))
    body = lines.where("line_number > 0 and trim(line) <> ''").withColumn("c", ok)
    return body.select(*(F.element_at("c", i + 1).alias(n) for i, n in enumerate(names)))


def read_series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, cells): (field, position, value) of the ``!Sample_`` lines, and (row, sample, value) of the table between its markers.

    A gzip-compressed file is one task's to read; everything after is distributed.
    """
    lines = spark.read.text(path).select("value")
    strip = lambda c: F.transform(F.split(c, "\t"), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    meta = lines.where(F.col("value").startswith("!Sample_")).withColumn("c", strip(F.col("value")))
    meta = meta.select(F.element_at("c", 1).substr(2, 1000).alias("field"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("position", "value"))
    body = lines.where(~F.col("value").startswith("!") & (F.trim("value") != "")).withColumn("c", strip(F.col("value")))
    names = body.where(F.element_at("c", 1) == "ID_REF").select(F.slice("c", 2, F.size("c")).alias("names"))
    cells = body.where(F.element_at("c", 1) != "ID_REF").join(F.broadcast(names))  # one header row
    pairs = F.arrays_zip("names", F.slice("c", 2, F.size("c")).alias("v"))
    out = cells.select(F.element_at("c", 1).alias("row"), F.explode(pairs).alias("p"))
    return meta, out.select("row", F.col("p.names").alias("sample"), F.col("p.v").try_cast("double").alias("value"))


def scrape_number(spark: SparkSession, path: str, pattern: str) -> float:
    """The first group of the pattern in a text report, as a number; no match is an error."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", pattern, 1).alias("x")).first()
    if found is None or not found[0]:
        raise ValueError(f"{pattern!r} is not in {path}")
    return float(found[0].replace(",", "."))


def external_options(scale: str, sample_center: str = "none", output_stem: str = "external") -> dict[str, str]:
    """Checked options of the external validation: a scale is required, linear values are not centred."""
    if scale not in ("linear", "log2"):
        raise ValueError("scale must be linear or log2")
    if sample_center not in ("none", "mean"):
        raise ValueError("sample_center must be none or mean")
    if scale == "linear" and sample_center != "none":
        raise ValueError("values on a linear scale are not centred")
    if not re.fullmatch(r"[A-Za-z0-9_-]+", output_stem):
        raise ValueError("output_stem may hold letters, digits, _ and -")
    return {"scale": scale, "sample_center": sample_center, "output_stem": output_stem}
