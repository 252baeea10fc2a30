"""Line-based CSV in two dialects of quoting, with line numbers and raw lines; every expression stays in the JVM.

Lines are split first, so no cell holds a line break. In the dialect ``start`` a quote opens a cell only as its first letter and is a letter
elsewhere; in ``anywhere`` every quote outside a quoted run opens one, so ``a"b,c"`` is one cell. In both a doubled quote
inside a quoted run is a quote, and a run that is not closed goes to the end of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

BOM = "﻿"
#: What stands inside quotes, in possessive steps that never go back.
INNER = '[^"]*+(?:""[^"]*+)*+'
CELL = {"start": f'(?:"{INNER}(?:"[^,]*+|$)|[^,]*+)', "anywhere": f'[^",]*+(?:"{INNER}(?:"|$)[^",]*+)*+'}


def cells(line: Column, dialect: str = "start") -> Column:
    """The cells of a line as an array of text."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f"\\G,({CELL[dialect]})"), F.lit(1))
    single = lambda x: F.replace(x, F.lit('""'), F.lit('"'))
    if dialect == "anywhere":
        return F.transform(raw, lambda x: single(F.regexp_replace(x, f'"({INNER})(?:"|$)', "$1")))
    inner = lambda x: F.regexp_extract(x, f'^"({INNER})', 1)
    after = lambda x: F.regexp_extract(x, f'^"{INNER}"(.*)$', 1)
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.concat(single(inner(x)), after(x))).otherwise(x))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of the lines that are not blank, numbered from 1 within their file; a byte-order mark at its beginning goes.

    A file may be read in splits by many tasks: lines are counted within each split, splits are put in order by where they begin.
    """
    place = ["_file", "_begin"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_begin"), F.regexp_replace("value", r"\r$", "").alias("line"))
    rows = materialize(rows.withColumn("line", F.regexp_replace("line", f"^{BOM}", "")).where(F.trim("line") != "").withColumn("_id", F.monotonically_increasing_id()))
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy("_id")))
    earlier = Window.partitionBy("_file").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(*place).agg(F.count("*").alias("_c"))  # a row a split
    splits = splits.select(*place, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    return own.join(splits, place).select(F.col("_file").alias("file"), (F.col("_n") + F.col("_before")).alias("line_number"), "line")


def read_dialect(spark: SparkSession, path: str, dialect: str = "start", strict: bool = False, keep_lines: bool = False) -> DataFrame:
    """A table with header, all cells as text; missing cells are empty text, surplus ones go, of repeated names the last column counts.

    ``strict``: names must not be empty or repeat, and every line must be as wide as the header; the error names the file and
    the line. ``keep_lines`` adds ``line_number`` and ``raw_line``. The first line of each file is its header; files must agree on it.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where("line_number = 1").select(F.transform(cells(F.col("line"), dialect), F.trim).alias("names")).distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"{path} is empty")
    if len(heads) > 1:
        raise ValueError(f"{path}: files differ in their header")
    names = heads[0]["names"]
    if strict and (not all(names) or len(set(names)) != len(names)):
        raise ValueError(f"{path}: empty or repeated column names")
    body = lines.where("line_number > 1").withColumn("c", cells(F.col("line"), dialect))
    if strict:
        bad = body.where(F.size("c") != len(names)).orderBy("file", "line_number").select("file", "line_number", F.size("c").alias("width")).first()
        if bad:
            raise ValueError(f"{bad['file']}: line {bad['line_number']} has {bad['width']} cells, the header {len(names)}")
    last = {n: i for i, n in enumerate(names)}
    columns = [F.coalesce(F.try_element_at("c", F.lit(i + 1)), F.lit("")).alias(n) for n, i in sorted(last.items(), key=lambda x: x[1])]
    return body.select(*columns, *([F.col("line_number"), F.col("line").alias("raw_line")] if keep_lines else []))
