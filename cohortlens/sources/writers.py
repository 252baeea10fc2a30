"""CSV, JSON, text and HTML sinks, digests, and swaps of a data set for a new one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_cell(x: Column) -> Column:
    """A cell as text: quoted only where it holds a comma, quote or line break; null is empty."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def write_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """A table with header; one file where ``files`` is 1 (a ranking), else as many as partitions."""
    out = df.coalesce(files) if files else df
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One summary row as a JSON document."""
    df.coalesce(1).write.json(path)


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def yes_no(x: Column) -> Column:
    return F.when(x, "sim").otherwise("nao")


def append_rows(cases: DataFrame, controls: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cases and then controls, with the cases' columns (or the given ones); columns that controls lack are 0."""
    columns = columns or cases.columns
    lacking = {c: F.lit("0") for c in columns if c not in controls.columns}
    return cases.select(*(f"`{c}`" for c in columns)).unionByName(controls.withColumns(lacking).select(*(f"`{c}`" for c in columns)))


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_with_backup(df: DataFrame, path: str, backup: str) -> None:
    """Put a new data set in the place of the one at ``path``, which may be what ``df`` reads; the first original stays at ``backup``."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(fresh)
    fs, old = _fs(spark, path)
    _, kept = _fs(spark, backup)
    _, new = _fs(spark, fresh)
    if fs.exists(old) and not fs.exists(kept):
        fs.rename(old, kept)
    elif fs.exists(old):
        fs.delete(old, True)
    fs.rename(new, old)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files, the digest in upper-case hex."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.upper(F.sha2("content", 256)).alias("sha256"))


def escape_html(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = x.replace(a, b)
    return x


def dashboard(title: str, views: dict[str, DataFrame], shown: int = 100) -> str:
    """A static page with each view's first rows, as a table and as JSON; :func:`write_dashboard` puts whole views beside it."""
    parts, payload = [], {}
    for name, df in views.items():
        rows = payload[name] = [r.asDict(recursive=True) for r in df.limit(shown).collect()]
        head = "".join(f"<th>{escape_html(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape_html(str(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows)
        link = f"data/{name.replace(' ', '_')}"
        parts.append(f'<h2>{escape_html(name)}</h2><p><a href="{escape_html(link)}">all rows</a></p><table><tr>{head}</tr>{body}</table>')
    data = json.dumps(payload, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{escape_html(title)}</title><h1>{escape_html(title)}</h1>{''.join(parts)}<script type=application/json id=data>{data}</script>"


def write_dashboard(spark: SparkSession, title: str, views: dict[str, DataFrame], path: str) -> None:
    """The page below ``path/page`` and every view, with all its rows, as JSON lines below ``path/data``."""
    for name, df in views.items():
        df.write.json(f"{path.rstrip('/')}/data/{name.replace(' ', '_')}")
    write_report(spark, [dashboard(title, views)], f"{path.rstrip('/')}/page")
