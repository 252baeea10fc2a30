import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables of the smallest scale are not here")

#: Queries whose Spark and SQL results are compared here; all are compared by the driver.
SAMPLE = ["feature_association", "welch_hedges", "pareto_front", "heldout_midrank", "exact_or_family_join", "motif_enrichment", "bootstrap_ci", "counter_uniforms", "transpose_aggregate", "replication_verdict", "hash_folds", "nearest_references", "feature_blocks", "series_matrix", "external_metrics"]


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, int)):
        return int(v)
    return round(float(v), 5) if isinstance(v, float) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() == 64


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(repr([plain(v) for v in r]) for r in rows)
    assert key(got.select(*columns).collect()) == key(want)
