"""Registered queries of CSV dialects, cohort preparation, external validation, audits, deliverables and dashboard views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, learning, matrix, ranking
from ..sources import dialects, writers
from ..storage import new_folder
from . import pipelines, reports
from .pipeline_queries import CROSS, VERDICTS, segment_matrix, verdict_rows
from .queries import AUC_SQL, EMB, bh_sql, big, curated, entries, inference_sql, profile_sql, query, r6, references, samples, table

# --- CSV dialects ------------------------------------------------------------------------------------


def raw_lines(lines: DataFrame, head: str, path: str) -> None:
    """Write lines as they are, each file with the header."""
    lines.toDF(head).write.option("header", True).option("sep", "\t").option("quote", "").option("lineSep", "\n").csv(path)


@query("""WITH l AS (SELECT p_partkey::VARCHAR AS k, replace(p_name, '"', '') AS n, p_brand AS b FROM part)
SELECT k AS part, 'start' AS dialect, [k, 'a"' || n, 'x"', 'q"' || b, ''] AS cells, k || ',a"' || n || ',x","q""' || b || '",' AS raw_line FROM l
UNION ALL SELECT k, 'anywhere', [k, 'a' || n || ',x', 'q"' || b, '', ''], k || ',a"' || n || ',x","q""' || b || '",' FROM l""")
def csv_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a line whose quotes the two dialects read in different ways, with the line as it was."""
    path, key = new_folder(spark), F.col("p_partkey").cast("string")
    line = F.concat(key, F.lit(',a"'), F.replace("p_name", F.lit('"'), F.lit("")), F.lit(',x","q""'), F.col("p_brand"), F.lit('",'))
    raw_lines(table(spark, d, "part").select(line), "part,a,b,c,d", path)
    out = None
    for dialect in ("start", "anywhere"):
        rows = dialects.read_dialect(spark, path, dialect, keep_lines=True)
        rows = rows.select("part", F.lit(dialect).alias("dialect"), F.array("part", "a", "b", "c", "d").alias("cells"), "raw_line")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT s_suppkey::VARCHAR AS k, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE '' END AS name, CASE WHEN s_suppkey % 3 = 2 THEN s_nationkey::VARCHAR ELSE '' END AS nation FROM supplier")
def dict_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one to three cells: cells that are missing are empty text."""
    path, k = new_folder(spark), F.col("s_suppkey")
    cells = F.array(k.cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string"))
    line = F.concat_ws(",", F.slice(cells, 1, F.pmod(k, F.lit(3)).cast("int") + 1))
    raw_lines(table(spark, d, "supplier").select(line), "k,name,nation", path)
    return dialects.read_dialect(spark, path)


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation UNION ALL SELECT s_suppkey::VARCHAR, s_name, '0' FROM supplier")
def appended_projection(spark: SparkSession, d: str) -> DataFrame:
    """Cases, cut to the wanted columns that they have, and then controls; what controls lack is 0."""
    cases = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"), F.lit("x").alias("unused"))
    controls = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))
    wanted = spark.createDataFrame([], "region string, name string, key string, absent string")
    return writers.append_rows(cases, controls, matrix.common_columns(cases, wanted))


# --- preparation -------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'c' || c_custkey AS sample_id, (c_acctbal > 5000)::INT AS classe, 'hsa-mir-1' AS feature, c_acctbal::DOUBLE AS value FROM customer
UNION ALL SELECT 'c' || c_custkey, (c_acctbal > 5000)::INT, 'hsa-mir-7-2', CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END FROM customer UNION ALL SELECT 'c' || c_custkey, (c_acctbal > 5000)::INT, 'hsa-mir-9', 1 FROM customer),
h AS (SELECT 'h' || o_orderkey % 300 AS sample, o_custkey % 8 AS u, o_totalprice AS v FROM orders), s AS (SELECT DISTINCT sample FROM h ORDER BY sample LIMIT 150)
SELECT sample_id, classe, feature, round(value, 3) AS value FROM c
UNION ALL SELECT sample, 0, CASE u WHEN 1 THEN 'hsa-mir-1' ELSE 'hsa-mir-7-2' END, round(sum(v), 3) FROM h WHERE sample IN (FROM s) AND u IN (1, 7) GROUP BY ALL""")
def balanced_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cases of three features and as many controls as asked for, whose transposed rows are summed by the feature of their name's base."""
    k, text = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    cases = table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("sample_id"), (F.col("c_acctbal") > 5000).cast("int").cast("string").alias("classe"), text("c_acctbal").alias("hsa-mir-1"),
        F.when(k % 5 == 0, "n/a").otherwise(text("c_nationkey")).alias("hsa-mir-7-2"), F.lit("1").alias("hsa-mir-9"),
    )
    o = table(spark, d, "orders")
    controls = o.select(F.concat(F.lit("U"), (F.col("o_custkey") % 8).cast("string")).alias("row"), F.concat(F.lit("h"), (F.col("o_orderkey") % 300).cast("string")).alias("sample"), F.col("o_totalprice").alias("value"))
    mapping = spark.createDataFrame([(f"U{i}", f"hsa-miR-{i}-{5 if i % 2 else 3}p") for i in range(8)], "row string, name string")
    return pipelines.build_matrix(cases, controls, mapping, 150)[0].select("sample_id", "classe", "feature", F.round("value", 3).alias("value"))


@query(f"SELECT \"row\", sample, value FROM ({CROSS} WHERE n_nationkey BETWEEN 5 AND 14)")
def unused_controls(spark: SparkSession, d: str) -> DataFrame:
    """Ten sample columns of a transposed table after the five that are used."""
    wide, path = segment_matrix(spark, d)[0], new_folder(spark)
    wide.write.option("header", True).option("sep", "\t").csv(path)
    some = reports.unused_subset(spark, path, 5, 10)
    return matrix.to_long(some.withColumnRenamed(some.columns[0], "row"), ["row"]).select("row", F.col("feature").alias("sample"), F.col("value").cast("double").alias("value"))


#: Sample titles by the remainder of the key.
TITLES = """CASE c_custkey % 4 WHEN 0 THEN 'TS_B: ' WHEN 1 THEN 'TS_N: ' WHEN 2 THEN 'XTS_B: ' ELSE 'VS_B: ' END || c_name"""


def cohort_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(matrix rows, mapping) of the customers."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("classe", (F.col("c_acctbal") > 5000).cast("int"))
    rows = c.select(k.cast("string").alias("sample_id"), "classe", F.col("c_acctbal").alias("hsa-miR-1"), F.col("c_nationkey").cast("double").alias("hsa-let-7a"))
    title = F.concat(F.when(k % 4 == 0, "TS_B: ").when(k % 4 == 1, "TS_N: ").when(k % 4 == 2, "XTS_B: ").otherwise("VS_B: "), F.col("c_name"))
    mapping = c.select(k.cast("string").alias("sample_id"), F.concat(F.lit("GSM"), k.cast("string")).alias("gsm"), "classe", title.alias("titulo_geo"), F.col("c_mktsegment").alias("diagnostico_geo"))
    return rows, mapping


@query(f"""SELECT 'GSM' || c_custkey AS sample_id, c_custkey::VARCHAR AS source_sample_id, (c_acctbal > 5000)::INT AS classe, c_acctbal AS "hsa-miR-1", substr(t, 1, 4) AS coorte_original, t AS titulo_geo, c_mktsegment AS diagnostico_geo
FROM (SELECT *, {TITLES} AS t FROM customer) WHERE c_custkey % 4 < 2""")
def prepared_cohort(spark: SparkSession, d: str) -> DataFrame:
    """The two groups of the external cohort by their titles, re-keyed by accession; a join that is not complete is an error."""
    rows, mapping = cohort_tables(spark, d)
    n = {name: mapping.where(F.col("titulo_geo").startswith(f"{name}:")).count() for name in ("TS_B", "TS_N")}
    cohort, kept = reports.prepare_external(rows, mapping, {k: v for k, v in n.items() if v})
    return kept.join(cohort.select("sample_id", "hsa-miR-1"), "sample_id")


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS v, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 0.5 ELSE 0 END END AS o FROM customer)
SELECT 2 * count(*) AS cells, sum((o IS NULL)::INT)::BIGINT AS missing, sum((abs(v - o) > 0.000051)::INT)::BIGINT AS beyond, round(max(abs(v - o)), 6) AS largest FROM c""")
def provenance_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cohort's cells against an official matrix that lacks some of them and differs in others."""
    rows, _ = cohort_tables(spark, d)
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    first = c.where("c_custkey % 7 > 0").select(F.lit("M1").alias("row"), k.cast("string").alias("sample"), (F.col("c_acctbal") + F.when(k % 10 == 0, 0.5).otherwise(0.0)).alias("value"))
    official = first.unionByName(c.select(F.lit("M2").alias("row"), k.cast("string").alias("sample"), F.col("c_nationkey").cast("double").alias("value")))
    accessions = spark.createDataFrame([("hsa-miR-1", "M1"), ("hsa-let-7a", "M2")], "feature string, row string")
    out = reports.provenance(rows, official, accessions)
    return out.select("cells", "missing", "beyond", r6("largest", "largest"))


@query(f"""WITH {EMB}, p AS {profile_sql('emb')}, m AS (SELECT sample, label, 0 AS feature, avg(value) AS value FROM emb GROUP BY sample, label)
SELECT (SELECT sum((m1 > m0)::INT) FROM p)::BIGINT AS higher, (SELECT sum((m1 < m0)::INT) FROM p)::BIGINT AS lower, round((SELECT quantile_cont(m1 - m0, 0.5) FROM p), 6) AS middle, round(auc, 6) AS auc, n1, n0 FROM {AUC_SQL.format(src='m')}""")
def shift_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether cases differ from controls in all features alike: signs and median of the differences, and the AUC of a sample's mean."""
    shift, area = reports.shift_audit(samples(spark, d))
    one = shift.select(big("higher", "higher"), big("lower", "lower"), r6(F.element_at("quantiles", 4), "middle"))
    return one.join(F.broadcast(area.select(r6("auc", "auc"), "n1", "n0")))  # one row each


# --- external validation -----------------------------------------------------------------------------

CANDIDATES = """cand AS (SELECT 'hsa-miR-' || i || '-' || arm || 'p' AS candidate, i, arm, CASE WHEN i >= 64 THEN 'absent' WHEN (i % 2 = 0) = (arm = 5) THEN 'exact' ELSE 'family' END AS method,
 CASE WHEN i % 3 = 0 AND arm = 5 THEN 'lower' ELSE 'higher' END AS direction FROM range(80) t(i), (VALUES (3), (5)) a(arm))"""


def _validated_sql(src: str, name: str) -> str:
    areas = AUC_SQL.format(src=src)
    turned = f"(SELECT feature * 2 + lower AS feature, CASE WHEN lower = 1 THEN 1 - auc ELSE auc END AS auc, n1, n0 FROM {areas} JOIN (SELECT DISTINCT i AS feature, (direction = 'lower')::INT AS lower FROM cand WHERE i < 64) USING (feature))"
    return f"""(SELECT candidate, '{name}' AS analysis, method, round(auc, 6) AS auc, round(fdr, 6) AS fdr, sharing, coalesce(n1 >= 10 AND n0 >= 10 AND auc > 0.5 AND ci_low > 0.5 AND fdr < 0.05, FALSE) AS replicated
 FROM (SELECT *, CASE WHEN i < 64 THEN count(*) OVER (PARTITION BY i, direction) END AS sharing FROM cand) c LEFT JOIN {bh_sql(inference_sql(turned))} v ON v.feature = c.i * 2 + (direction = 'lower')::INT AND c.i < 64)"""


@query(f"""WITH {EMB}, pos AS (SELECT sample, label, feature, ln(1 + abs(value)) AS value FROM emb), cen AS (SELECT sample, label, feature, value - avg(value) OVER (PARTITION BY sample) AS value FROM emb), {CANDIDATES}
SELECT * FROM {_validated_sql('pos', 'primary')} UNION ALL SELECT * FROM {_validated_sql('cen', 'centred')}""")
def external_validation(spark: SparkSession, d: str) -> DataFrame:
    """A frozen ranking of 160 candidates on another cohort, on its scale and centred by sample: exact, by family, or absent."""
    odd = F.col("feature") % 2 == 1
    long = samples(spark, d).withColumn("feature", F.concat(F.lit("hsa-mir-"), F.col("feature").cast("string"), F.when(odd, "-3p").otherwise("-5p")))
    rows = [(f"hsa-miR-{i}-{arm}p", "lower" if i % 3 == 0 and arm == 5 else "higher", 2 * i + (arm == 3)) for i in range(80) for arm in (3, 5)]
    ranked = spark.createDataFrame(rows, "candidate string, direction string, rank int")
    linear = pipelines.validate_external(long.withColumn("value", F.abs("value")), ranked, "linear").withColumn("analysis", F.lit("primary"))
    centred = pipelines.validate_external(long, ranked, "log2", center=True).withColumn("analysis", F.lit("centred"))
    return linear.unionByName(centred).select("candidate", "analysis", "method", r6("auc", "auc"), r6("fdr", "fdr"), "sharing", "replicated")


@query(f"""WITH v AS (SELECT * FROM (WITH {VERDICTS.format(cut=2000)} SELECT * FROM v)), k AS (SELECT *, row_number() OVER (ORDER BY (s_suppkey * 37 % 101) DESC, candidate) AS rank FROM v)
SELECT cut, count(*) FILTER (method = 'exact') AS found, count(*) FILTER (ok AND method = 'exact') AS replicated, count(*) FILTER (ok AND method = 'exact' AND lone) AS practical FROM k JOIN (VALUES (10), (20), (50), (100)) t(cut) ON rank <= cut GROUP BY cut""")
def reordered_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """What the external verdicts replicate of the first candidates of another order, as a variant's ranking has."""
    ranked = table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("candidate"), (F.col("s_suppkey") * 37 % 101).alias("integrated"))
    return pipelines.reordered_cutoffs(ranked, verdict_rows(spark, d, 2000), "integrated")


SUMMARY = """count(*)::VARCHAR AS candidates, count(*) FILTER (method = 'exact')::VARCHAR AS exact, count(*) FILTER (method = 'family')::VARCHAR AS proxy, count(*) FILTER (method = 'absent')::VARCHAR AS absent, count(DISTINCT hypothesis)::VARCHAR AS hypotheses,
count(*) FILTER (ok AND method = 'exact')::VARCHAR AS replicated_exact, count(*) FILTER (ok AND method = 'family')::VARCHAR AS replicated_proxy, count(*) FILTER (ok AND method = 'exact' AND lone)::VARCHAR AS practical, count(*) FILTER (ok AND method = 'exact' AND NOT lone)::VARCHAR AS unambiguous"""


@query(f"""WITH {VERDICTS.format(cut=2000)}, w AS (SELECT *, s_acctbal > 5000 AS other FROM v JOIN (SELECT s_suppkey, s_acctbal FROM supplier) USING (s_suppkey)),
a AS (SELECT {SUMMARY} FROM v), b AS (SELECT {SUMMARY} FROM (SELECT * REPLACE (other AS ok) FROM w)), c AS (SELECT count(*) FILTER (e)::VARCHAR AS replicated_exact, count(*) FILTER (e AND lone)::VARCHAR AS practical, count(*) FILTER (e AND NOT lone)::VARCHAR AS unambiguous FROM (SELECT *, ok AND other AND method = 'exact' AS e FROM w))
SELECT 'external' AS section, metric, value, 'primary' AS analysis FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'external', metric, value, 'centred' FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'external', metric, value, 'both' FROM (UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE value)""")
def deliverable_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated table of both external analyses and of what holds in both."""
    return reports.deliverables(verdict_rows(spark, d, 2000), verdict_rows(spark, d, 5000))


# --- dashboard and audit -------------------------------------------------------------------------------

INTEGRATED = """i AS (SELECT 'c' || s_suppkey AS candidate, (s_suppkey * 37 % 101) / 100.0::DOUBLE AS sequence_score, (s_suppkey * 53 % 51) / 50.0::DOUBLE AS validation_score, 0.5 + (s_suppkey % 50) / 100.0::DOUBLE AS cv_auc, (s_suppkey % 40) / 40.0::DOUBLE AS fdr,
 (s_suppkey % 80) / 80.0::DOUBLE AS p_value, s_suppkey % 9 = 0 AS pareto, 1 + s_suppkey % 2 AS sharing, s_suppkey AS k FROM supplier),
g AS (SELECT *, 0.5 * sequence_score + 0.5 * validation_score AS integrated FROM i)"""


def integrated_rows(spark: SparkSession, d: str) -> DataFrame:
    """An integrated ranking made of the suppliers."""
    k = F.col("s_suppkey")
    out = table(spark, d, "supplier").select(
        F.concat(F.lit("c"), k.cast("string")).alias("candidate"), (k * 37 % 101 / 100).alias("sequence_score"), (k * 53 % 51 / 50).alias("validation_score"), (0.5 + k % 50 / 100).alias("cv_auc"),
        (k % 40 / 40).alias("fdr"), (k % 80 / 80).alias("p_value"), (k % 9 == 0).alias("pareto"), (1 + k % 2).alias("sharing"), F.lit("higher").alias("direction"),
    )
    out = out.withColumn("integrated", 0.5 * F.col("sequence_score") + 0.5 * F.col("validation_score"))
    out = ranking.global_rank(out, [F.desc("integrated"), F.col("candidate")], "integrated_rank")
    return ranking.global_rank(out, [F.desc("validation_score"), F.col("candidate")], "validation_rank")


def external_rows(spark: SparkSession, d: str, cut: int) -> DataFrame:
    k = F.substring("candidate", 2, 20).cast("long")
    return verdict_rows(spark, d, cut).withColumns({"auc": k % 100 / 100, "fdr": k % 40 / 40})


@query(f"""WITH {INTEGRATED}, {VERDICTS.format(cut=2000)}, x AS (SELECT {SUMMARY.replace('::VARCHAR', '')} FROM v)
SELECT n AS candidates, significant, front, ambiguous, mean_auc, best, x.candidates AS external_candidates, x.* EXCLUDE (candidates)
FROM (SELECT count(*) AS n, count(*) FILTER (fdr < 0.05) AS significant, count(*) FILTER (pareto) AS front, count(*) FILTER (sharing > 1) AS ambiguous, round(avg(cv_auc), 6) AS mean_auc, round(max(integrated), 6) AS best FROM g), x""")
def dashboard_cards(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's own key figures."""
    out = reports.key_figures(integrated_rows(spark, d), external_rows(spark, d, 2000))
    return out.withColumns({"mean_auc": F.round("mean_auc", 6), "best": F.round("best", 6)})


@query(f"""WITH {INTEGRATED}, {VERDICTS.format(cut=2000)}, w AS (SELECT v.*, ok AND method = 'exact' AND s_acctbal > 5000 AS robust FROM v JOIN (SELECT s_suppkey, s_acctbal FROM supplier) USING (s_suppkey))
SELECT 'integrated' AS view, candidate, round(integrated, 4) AS value, robust AS flag FROM g JOIN w USING (candidate) UNION ALL SELECT 'validation', candidate, round(cv_auc, 4), fdr < 0.05 FROM g UNION ALL SELECT 'sequence', candidate, round(sequence_score, 4), NULL FROM g
UNION ALL SELECT 'external', candidate, s_suppkey % 100 / 100.0, ok AND method = 'exact' FROM w UNION ALL SELECT 'centred', candidate, s_suppkey % 100 / 100.0, method = 'exact' AND s_acctbal > 5000 FROM w JOIN (SELECT s_suppkey, s_acctbal FROM supplier) USING (s_suppkey)
UNION ALL SELECT 'scatter', candidate, round(sequence_score, 4), pareto FROM g UNION ALL (SELECT 'top', candidate, round(integrated, 4), NULL FROM g ORDER BY integrated DESC, candidate LIMIT 20)""")
def dashboard_views(spark: SparkSession, d: str) -> DataFrame:
    """All seven views of the dashboard, whole but for the bars, which are a report of twenty."""
    found = reports.views(integrated_rows(spark, d), external_rows(spark, d, 2000), external_rows(spark, d, 5000))
    columns = {
        "integrated": ("integrated", F.col("robust")), "validation": ("cv_auc", F.col("fdr") < 0.05), "sequence": ("sequence_score", F.lit(None).cast("boolean")), "external": ("auc", F.col("replicated_exact")),
        "centred": ("auc", F.col("replicated_exact")), "scatter": ("sequence_score", F.col("pareto")), "top": ("integrated", F.lit(None).cast("boolean")),
    }
    out = None
    for name, (value, flag) in columns.items():
        part = found[name].select(F.lit(name).alias("view"), "candidate", F.round(value, 4).alias("value"), flag.alias("flag"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {INTEGRATED}, {VERDICTS.format(cut=2000)} SELECT * FROM (SELECT 'sequence ranks are contiguous and scores descend' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'candidates are unique', 0 UNION ALL SELECT 'integrated ranks are contiguous', 0
UNION ALL SELECT 'AUC is from 0 to 1', 0 UNION ALL SELECT 'FDR is from 0 to 1', 0 UNION ALL SELECT 'FDR is not below p', (SELECT count(*) FROM g WHERE fdr < p_value - 1e-15)
UNION ALL SELECT 'one FDR for a hypothesis', (SELECT count(*) FROM (SELECT hypothesis FROM v GROUP BY 1 HAVING count(DISTINCT s_suppkey % 40) > 1)) UNION ALL SELECT 'replication is exact, proxy or absent', 0 UNION ALL SELECT 'strict replications are replications', 0
UNION ALL SELECT 'metrics are unique', 0)""")
def audit_suite(spark: SparkSession, d: str) -> DataFrame:
    """The expectation suite over what the pipelines make; two of its checks meet planted faults."""
    integrated, external = integrated_rows(spark, d), external_rows(spark, d, 2000)
    order = [F.desc("sequence_score"), F.col("candidate")]
    ranked = ranking.global_rank(integrated.select("candidate", F.col("sequence_score").alias("score")).withColumnRenamed("score", "sequence_score"), order, "rank").withColumnRenamed("sequence_score", "score")
    metrics = reports.deliverables(external, external_rows(spark, d, 5000))
    return reports.audit(spark, ranked, integrated, external, metrics).select("check", "violations")


#: Row checks by table: name and violation, in SQL that Spark and DuckDB both read.
ROW_CHECKS = {
    "region": {"has a key": "r_regionkey IS NULL", "has a name": "coalesce(r_name, '') = ''"},
    "nation": {"has a key": "n_nationkey IS NULL", "has a name": "coalesce(n_name, '') = ''", "region is not negative": "n_regionkey < 0"},
    "customer": {"has a key": "c_custkey IS NULL", "has a name": "coalesce(c_name, '') = ''", "balance is there": "c_acctbal IS NULL", "balance is not negative": "c_acctbal < 0", "segment is upper case": "c_mktsegment <> upper(c_mktsegment)"},
    "supplier": {"has a key": "s_suppkey IS NULL", "has a name": "coalesce(s_name, '') = ''", "balance is not negative": "s_acctbal < 0"},
    "part": {"has a key": "p_partkey IS NULL", "size is 1 to 50": "p_size < 1 OR p_size > 50", "price is above 0": "p_retailprice <= 0", "brand begins so": "p_brand NOT LIKE 'Brand#%'", "has a type": "coalesce(p_type, '') = ''"},
    "orders": {"has a key": "o_orderkey IS NULL", "price is above 0": "o_totalprice <= 0", "status is F, O or P": "o_orderstatus NOT IN ('F', 'O', 'P')", "has a date": "o_orderdate IS NULL", "priority begins with its number": "o_orderpriority NOT LIKE '1-%' AND o_orderpriority NOT LIKE '2-%' AND o_orderpriority NOT LIKE '3-%' AND o_orderpriority NOT LIKE '4-%' AND o_orderpriority NOT LIKE '5-%'"},
    "lineitem": {"has an order": "l_orderkey IS NULL", "line number is above 0": "l_linenumber < 1", "quantity is 1 to 50": "l_quantity < 1 OR l_quantity > 50", "price is above 0": "l_extendedprice <= 0", "discount is a share": "l_discount < 0 OR l_discount > 1", "discount is at most 5 in 100": "l_discount > 0.05",
                 "tax is a share": "l_tax < 0 OR l_tax > 1", "flag is A, N or R": "l_returnflag NOT IN ('A', 'N', 'R')", "status is F or O": "l_linestatus NOT IN ('F', 'O')", "has a date": "l_shipdate IS NULL"},
    "events": {"has a key": "event_id IS NULL", "has a time": "ts IS NULL", "has a user": "user_id IS NULL", "value is there": "value IS NULL", "value is not negative": "value < 0", "value is at most 100": "value > 100", "has a type": "coalesce(event_type, '') = ''"},
    "documents": {"has a key": "doc_id IS NULL", "has a text": "coalesce(text, '') = ''", "length is that of the text": "n_chars <> length(text)", "has a language": "lang IS NULL", "has a source": "coalesce(source, '') = ''", "is not one word": "text NOT LIKE '% %'"},
    "embeddings": {"has a key": "vec_id IS NULL", "has a vector": "embedding IS NULL", "has a label": "label IS NULL", "label is 0 to 9": "label < 0 OR label > 9"},
    "pages": {"has a key": "page_id IS NULL", "has a scheme": "url NOT LIKE '%://%'", "has a body": "coalesce(html, '') = ''"},
    "benchmark": {"has a key": "item_id IS NULL", "has a text": "coalesce(text, '') = ''"},
    "labels": {"has a key": "doc_id IS NULL", "quality is 0 or 1": "quality IS NULL OR quality NOT IN (0, 1)", "toxic is 0 or 1": "toxic IS NULL OR toxic NOT IN (0, 1)", "toxic is of low quality": "toxic = 1 AND quality = 1"},
    "conversations": {"has a key": "conv_id IS NULL", "turn is not negative": "turn < 0", "role is known": "role NOT IN ('user', 'assistant', 'system')", "has a text": "coalesce(text, '') = ''"},
}
KEY_CHECKS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"),
]


def _audit_sql() -> str:
    rows = [f"SELECT '{t}: {name}' AS \"check\", (SELECT count(*) FROM {t}) AS checked, (SELECT count(*) FROM {t} WHERE {bad}) AS violations" for t, own in ROW_CHECKS.items() for name, bad in own.items()]
    rows += [f"SELECT '{t}: key is unique', (SELECT count(*) FROM {t}), (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {t}))" for t, k in KEY_CHECKS.items()]
    rows += [f"SELECT '{a}: {x} is in {b}', (SELECT count(*) FROM {a} WHERE {x} IS NOT NULL), (SELECT count(*) FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL))" for a, x, b, y in REFERENCES]
    return " UNION ALL ".join(rows)


@query(_audit_sql())
def fused_audit(spark: SparkSession, d: str) -> DataFrame:
    """Expectations over all tables, some of which their rows break: a scan for all row checks of a table."""
    out = checks.fused_suite(
        {t: table(spark, d, t) for t in ROW_CHECKS}, {f"{t}: {name}": (t, bad) for t, own in ROW_CHECKS.items() for name, bad in own.items()},
        {f"{t}: key is unique": (t, k) for t, k in KEY_CHECKS.items()}, {f"{a}: {x} is in {b}": (a, x, b, y) for a, x, b, y in REFERENCES},
    )
    return out.select("check", "checked", "violations")


@query("""WITH v AS (SELECT DISTINCT c_nationkey AS fold, 'k' || (c_nationkey * 5 % 4) AS config, (c_nationkey * 7 % 26) / 26.0 AS inner_score FROM customer)
SELECT config, count(*) AS selected, round(avg(inner_score), 6) AS inner_score FROM v GROUP BY 1 ORDER BY 2 DESC, avg(inner_score) DESC, 1 LIMIT 1""")
def chosen_configuration(spark: SparkSession, d: str) -> DataFrame:
    """The configuration that most folds have chosen, then by inner score, then by id."""
    k = F.col("c_nationkey")
    rows = table(spark, d, "customer").select(F.lit("ensemble").alias("scorer"), k.alias("fold"), F.concat(F.lit("k"), (k * 5 % 4).cast("string")).alias("config"), (k * 7 % 26 / 26).alias("inner_score"))
    return learning.choose_configuration(rows).select("config", "selected", r6("inner_score", "inner_score"))


# --- rankings and ablation: compared with in-process versions in the tests --------------------------------


@query(None)
def one_class_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The historical one-class ranking: every document by its likeness to the references."""
    markers = references(spark, d).where(F.length("sequence") > 0).withColumn("weight", (F.col("entity") % 3 + 1).cast("double"))
    out = reports.one_class_ranking(entries(spark, d).select("entity", "sequence"), markers, [2, 3], [3])
    return out.select("entity", *(r6(c, c) for c in ("centroid", "nearest", "coverage", "seed", "score")))


@query(None)
def ablation_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The five representations of the ablation: family means with intervals, and their paired comparison with core."""
    out = learning.ablation_summary(learning.ablation_validation(curated(spark, d)))
    return out.select("blocks", "families", r6("mean_percentile", "mean_percentile"), r6("mean_delta", "mean_delta"), r6("p_value", "p_value"), r6("fdr", "fdr"))
