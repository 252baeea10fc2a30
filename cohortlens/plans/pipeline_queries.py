"""Registered queries of sources, sinks, contracts, feature blocks, views and whole pipelines, with the SQL they must agree with.

Sources and sinks write a table to the shared folder and read it back, so the SQL is that of the table.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, names, scores
from ..operators import checks, matching, matrix, sequences
from ..sources import readers, writers
from ..storage import materialize, new_folder
from . import pipelines, reports
from .queries import AUC_SQL, BAL, EMB, REF, SEQ, balanced, big, curated, kmer_sql, profile_sql, query, r6, references, reused_entries, samples, table

# --- sources and sinks: written, read back ---------------------------------------------------------


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ', \"' || n_regionkey || '\"' AS label, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS part FROM nation")
def csv_table(spark: SparkSession, d: str) -> DataFrame:
    """Quoted cells and empty ones through the CSV sink and the lenient reader."""
    n, path = table(spark, d, "nation"), new_folder(spark)
    label = F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"'))
    writers.write_csv(n.select("n_nationkey", label.alias("label"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("part")), path)
    return readers.read_table(spark, path)


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def csv_table_strict(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark)
    writers.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return readers.read_table(spark, path, strict=True)


@query("SELECT item_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE coalesce(text, '') END AS cell FROM benchmark")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", writers.csv_cell(F.col("text")).alias("cell"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'r_regionkey'), (1, 'r_name')) t(position, name)")
def csv_header(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark)
    writers.write_csv(table(spark, d, "region").select("r_regionkey", "r_name"), path, 1)
    return spark.createDataFrame(list(enumerate(readers.header(spark, path))), "position long, name string")


CROSS = """SELECT s AS "row", 'n' || n_nationkey AS sample, (SELECT count(*) FROM customer c WHERE c.c_mktsegment = s AND c.c_nationkey = n_nationkey)::DOUBLE AS value
FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), nation"""


def segment_matrix(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Customers by segment (rows) and nation (columns)."""
    keys = [f"n{r[0]}" for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"))
    return c.groupBy("id").pivot("n", keys).count().na.fill(0), keys


@query(CROSS)
def transposed_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide, path = segment_matrix(spark, d)[0], new_folder(spark)
    wide.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_transposed(spark, path)


@query(CROSS)
def series_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A gzip-compressed series matrix: sample lines, then the quoted table."""
    wide, keys = segment_matrix(spark, d)
    path = new_folder(spark)
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    head = spark.createDataFrame([(0, "!Sample_title\t" + "\t".join(f'"{k}"' for k in keys)), (1, "!series_matrix_table_begin"), (2, '"ID_REF"\t' + "\t".join(f'"{k}"' for k in keys))], "at int, value string")
    body = wide.select(F.lit(3).alias("at"), F.concat_ws("\t", quoted(F.col("id")), *(F.col(k).cast("string") for k in keys)).alias("value"))
    end = spark.createDataFrame([(4, "!series_matrix_table_end")], "at int, value string")
    head.unionByName(body).unionByName(end).coalesce(1).sortWithinPartitions("at").select("value").write.option("compression", "gzip").text(path)
    return readers.read_series_matrix(spark, path)[1]


@query("SELECT DISTINCT 'U' || p_partkey AS urs, p_brand AS name FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 2 = 1")
def id_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The mature rows of a mapping without header; other species, precursors and short lines go."""
    key, path = F.col("p_partkey"), new_folder(spark)
    kind = F.when(key % 2 == 1, "miRNA").otherwise("pre_miRNA")
    full = F.concat_ws("\t", F.concat(F.lit("U"), key.cast("string")), F.lit("DB"), F.lit("x"), F.when(key % 5 == 0, "10090").otherwise("9606"), kind, F.concat(F.lit(" "), F.col("p_brand")))
    lines = table(spark, d, "part").select(full.alias("value"))
    lines.unionByName(spark.createDataFrame([("U1\tDB",)], "value string")).write.text(path)
    return readers.read_id_mapping(spark, path)[1]


@query(f"WITH {SEQ} SELECT name, 'A' || entity AS accession, sequence FROM seq WHERE sequence <> '' AND name LIKE 'd1%'")
def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n>", "\n ")
    head = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" A"), F.col("doc_id").cast("string"), F.lit(" a > b\n"))
    table(spark, d, "documents").select(F.concat(head, text).alias("value")).write.text(path)
    return readers.read_fasta(spark, path, "d1")


@query("SELECT count(*) AS n, max(o_orderkey) AS top, min(o_orderpriority) AS first FROM orders")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark)
    writers.write_json(table(spark, d, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"), F.min("o_orderpriority").alias("first")), path)
    return readers.read_json(spark, path, "n long, top long, first string")


@query("SELECT n_nationkey::VARCHAR AS name, n_name AS value FROM nation UNION ALL SELECT 'a', '1' UNION ALL SELECT 'b', '2'")
def optional_source(spark: SparkSession, d: str) -> DataFrame:
    """A table that is there, and the given rows where one is not."""
    path, fallback, schema = new_folder(spark), [("a", "1"), ("b", "2")], "name string, value string"
    writers.write_csv(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value")), path)
    return readers.read_or(spark, path, fallback, schema).unionByName(readers.read_or(spark, new_folder(spark), fallback, schema))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def zip_entry(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an entry of a ZIP archive as columns; the archive is a small one of the driver's."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    held, path = io.BytesIO(), f"{new_folder(spark)}/a.zip"
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("base_x.csv", "n_nationkey,n_name\n" + "".join(f"{k},{n}\n" for k, n in rows))
        z.writestr("other.txt", "no")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(held.getvalue()))
    out.close()
    return readers.split_lines(readers.read_zip_entry(spark, path, r"^base_.*\.csv$"), ["n_nationkey", "n_name"])


@query("SELECT count(*)::DOUBLE AS orders FROM orders")
def scraped_number(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark)
    writers.write_report(spark, ["Report", f"Orders: {table(spark, d, 'orders').count()},0 in all"], path)
    return spark.createDataFrame([(readers.scrape_number(spark, path, r"Orders: ([\d,]+)"),)], "orders double")


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS extra FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey::VARCHAR, c_name, '0' FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def appended_controls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("extra"))
    return writers.append_rows(c.where("extra = 'BUILDING'"), c.where("extra <> 'BUILDING'").drop("extra"))


@query("SELECT 'now' AS version, r_regionkey + 10 AS r_regionkey FROM region UNION ALL SELECT 'backup', r_regionkey FROM region")
def replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A data set put in the place of the one it was made from; the original stays as a backup."""
    base = new_folder(spark)
    table(spark, d, "region").select("r_regionkey").write.parquet(f"{base}/t")
    for _ in range(2):  # the second time the first original stays the backup
        writers.replace_with_backup(spark.read.parquet(f"{base}/t").select((F.col("r_regionkey") + 5).alias("r_regionkey")), f"{base}/t", f"{base}/b")
    read = lambda p, v: spark.read.parquet(f"{base}/{p}").select(F.lit(v).alias("version"), "r_regionkey")
    return read("t", "now").unionByName(read("b", "backup"))


# --- projections, contracts, lookups ----------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def projected_columns(spark: SparkSession, d: str) -> DataFrame:
    """Required columns, then the id and two from a position."""
    kept = matrix.project(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    return matrix.slice_columns(kept, 1, 2)


@query("""SELECT * FROM (SELECT 'priorities of two orders' AS "check", (SELECT count(*) FROM (VALUES (0), (1)) t(l) WHERE (SELECT count(*) FROM labels WHERE quality = l) < 100) AS violations
UNION ALL SELECT 'reproduced by its CSV', 0 UNION ALL SELECT 'reproduced by a changed table', (SELECT count(*) FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'known segments', 1)""")
def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    labels, c = table(spark, d, "labels"), table(spark, d, "customer")
    checks.header_contract(labels, ["doc_id", "quality"])
    unknown = checks.contained(["BUILDING", "no such segment"], c, "c_mktsegment")
    path = new_folder(spark)
    writers.write_csv(c, path)
    again = readers.read_table(spark, path)
    again = again.select(*(F.col(f.name).cast(f.dataType) for f in c.schema))
    changed = c.withColumn("c_acctbal", F.abs("c_acctbal"))
    out = checks.suite(spark, {
        "priorities of two orders": checks.group_sizes(labels, "quality", 100),
        "reproduced by its CSV": spark.range(0 if checks.same_frame(c, again) else 1), "reproduced by a changed table": c.exceptAll(changed),
        "known segments": spark.createDataFrame([(u,) for u in unknown], "segment string"),
    })
    return out.select("check", "violations")


@query("""SELECT s_suppkey, l_linenumber::BIGINT AS line, coalesce(n, 0) AS n FROM supplier CROSS JOIN (SELECT DISTINCT l_linenumber FROM lineitem)
LEFT JOIN (SELECT l_suppkey AS k, l_linenumber AS j, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) ON k = s_suppkey AND j = l_linenumber""")
def compound_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by two keys with a default."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), big("l_linenumber", "line"), "l_returnflag")
    numbers = [r[0] for r in lines.select("line").distinct().collect()]
    asked = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*(F.lit(n).cast("long") for n in sorted(numbers)))).alias("line"))
    held = lines.where("l_returnflag = 'R'").groupBy("s_suppkey", "line").agg(F.count("*").alias("n"))
    return matching.with_default(asked, held, ["s_suppkey", "line"], {"n": 0}).select("s_suppkey", "line", big("n", "n"))


@query("SELECT 'm' || s_suppkey AS name, round(1 + s_suppkey % 3, 6)::DOUBLE AS evidence FROM supplier WHERE s_suppkey % 4 > 0")
def training_policy(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"), "s_suppkey")
    policy = s.select("name", (1 + F.col("s_suppkey") % 3).cast("string").alias("training_weight"), F.when(F.col("s_suppkey") % 4 > 0, "sim").otherwise("NAO ").alias("use_in_training"))
    return pipelines.apply_policy(s.select("name"), policy)


@query("""SELECT p_partkey, lower(raw) AS lowered, regexp_replace(translate(lower(trim(raw)), '_', '-'), '^hsa-', '') AS plain FROM (SELECT p_partkey, ' HSA_miR-' || p_partkey % 300 || CASE WHEN p_partkey % 2 = 0 THEN '-5p' ELSE '' END AS raw FROM part)""")
def external_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat(F.lit(" HSA_miR-"), (k % 300).cast("string"), F.when(k % 2 == 0, "-5p").otherwise(""))
    return table(spark, d, "part").select("p_partkey", names.lower_name(raw).alias("lowered"), names.external_name(raw).alias("plain"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3.0 WHEN o_orderkey % 3 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5)::DOUBLE ELSE 1.0 END AS evidence FROM orders""")
def marker_weights(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    word = F.when(k % 3 == 0, " Alta").when(k % 3 == 1, F.when(k % 2 == 0, "media").otherwise("painel_inicial"))
    return table(spark, d, "orders").select("o_orderkey", scores.marker_weight(word).alias("weight"), scores.evidence_weight((k % 5).cast("double")).alias("evidence"))


@query("SELECT n_nationkey, 'a' || n_nationkey AS marker, n_nationkey / 32.0 AS similarity FROM nation UNION ALL SELECT n_nationkey, 'b', NULL FROM nation")
def parsed_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.concat(F.lit("a"), k.cast("string"), F.lit(":"), (k / 32).cast("string"), F.lit("; b: x ;"))
    return table(spark, d, "nation").select("n_nationkey", F.inline(scores.parse_pairs(text)))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS p, (o_totalprice + 0.001) / 700000 AS share FROM orders)
SELECT o_orderkey, printf('%.2f', p) AS price, regexp_replace(printf('%.6e', share / 1000000), 'e-0', 'e-') AS p_value, printf('%.2f', 100 * share) || '%' AS share,
CASE WHEN share >= 0.4 THEN '+' ELSE '' END || printf('%.2f', 100 * (share - 0.4)) AS gain, replace(format('{:,}', o_orderkey * 1000), ',', '.') AS grouped, CASE WHEN share >= 0.4 THEN printf('%.2f', share * 25) ELSE printf('%.4f', share * 25) END AS cell FROM x""")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as reports and pages write them."""
    price = F.col("o_totalprice")
    share = (price + 0.001) / 700000
    return table(spark, d, "orders").select(
        "o_orderkey", formats.fixed(price).alias("price"), formats.exponential(share / 1000000).alias("p_value"), formats.percent(share).alias("share"), formats.points(share - 0.4).alias("gain"),
        formats.grouped(F.col("o_orderkey") * 1000).alias("grouped"), formats.display_value(share * 25).alias("cell"),
    )


# --- feature blocks -------------------------------------------------------------------------------------


@query(f"""WITH {SEQ}, k AS (SELECT entity, feature, count(*) AS n FROM ({kmer_sql('fam', (2,))}) GROUP BY ALL), v AS (SELECT entity, feature, n / sum(n) OVER (PARTITION BY entity) AS value FROM k)
SELECT feature, round(sum(value) / (SELECT count(DISTINCT entity) FROM v), 6) AS value FROM v GROUP BY feature""")
def unweighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    return sequences.centroid(sequences.kmer_vectors(reused_entries(spark, d), [2])).select("feature", r6("value", "value"))


@query(f"""WITH {SEQ}, {BAL}, f AS (SELECT DISTINCT entity, feature FROM ({kmer_sql('fam', (3,))}) UNION SELECT entity, 'seed:' || family FROM fam), p AS (SELECT feature, sum(weight) AS presence FROM f JOIN bal USING (entity) GROUP BY 1)
SELECT feature FROM p WHERE feature LIKE 'seed:%' OR round(presence, 9) >= 2""")
def learning_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    e = reused_entries(spark, d)
    found = sequences.weighted_presence(sequences.kmer_vectors(e, [3], with_seed=True), balanced(e))
    return sequences.vocabulary(found.withColumn("presence", F.round("presence", 9)))


_P = "length(regexp_replace(sequence, '[^{b}]', '', 'g')) / greatest(1, length(sequence))"


@query(f"""WITH {SEQ}, k AS (SELECT entity, feature, count(*) AS n FROM ({kmer_sql('fam', (2,))}) GROUP BY ALL UNION ALL SELECT entity, 'seed:' || family, 2 FROM fam),
o AS (SELECT entity, 'positional:' || CASE WHEN c < 1.0 / 3 THEN '5p' WHEN c < 2.0 / 3 THEN 'center' ELSE '3p' END || ':' || kmer AS feature, count(*) AS n FROM (SELECT entity, substr(sequence, i::INT, 2) AS kmer, i / length(sequence) AS c
 FROM (SELECT entity, sequence, unnest(range(1, greatest(length(sequence), 1))) AS i FROM fam)) GROUP BY ALL),
v AS (SELECT entity, feature, n / sum(n) OVER (PARTITION BY entity) AS value FROM k UNION ALL SELECT entity, feature, n / sum(n) OVER (PARTITION BY entity) FROM o
 UNION ALL SELECT entity, 'composition:length', least(1.0, length(sequence) / 30) FROM fam UNION ALL SELECT entity, 'composition:gc', {_P.format(b='GC')} FROM fam
 UNION ALL SELECT entity, 'composition:base_' || b, length(regexp_replace(sequence, '[^' || b || ']', '', 'g')) / greatest(1, length(sequence)) FROM fam, (VALUES ('A'), ('C'), ('G'), ('U')) t(b)
 UNION ALL SELECT entity, 'terminal:5p:' || k || ':' || left(sequence, k::INT), 0.25 FROM fam, (VALUES (2), (3), (4)) t(k) WHERE length(sequence) >= k
 UNION ALL SELECT entity, 'terminal:3p:' || k || ':' || right(sequence, k::INT), 0.25 FROM fam, (VALUES (2), (3), (4)) t(k) WHERE length(sequence) >= k)
SELECT feature, count(*) AS entities, round(sum(value), 5) AS total FROM v GROUP BY feature""")
def feature_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The full representation of every text, summed by feature; the entropy has its own query."""
    v = sequences.feature_vectors(reused_entries(spark, d), [2], "full").where("feature <> 'composition:entropy'")
    return v.groupBy("feature").agg(F.count("*").alias("entities"), F.round(F.sum("value"), 5).alias("total"))


@query(f"""WITH {REF}, k AS (SELECT entity, feature, count(*) AS n FROM ({kmer_sql('ref', (3,))}) GROUP BY ALL), s AS (SELECT entity, sqrt(sum(n * n)) AS s FROM k GROUP BY 1)
SELECT a.entity AS a, b.entity AS b, round(sum(a.n * b.n) / any_value(x.s * y.s), 6) AS cosine FROM k a JOIN k b ON a.feature = b.feature AND a.entity < b.entity JOIN s x ON x.entity = a.entity JOIN s y ON y.entity = b.entity
GROUP BY 1, 2 ORDER BY round(sum(a.n * b.n) / any_value(x.s * y.s), 9) DESC, 1, 2 LIMIT 20""")
def marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The most alike pairs of references, a report of twenty."""
    return reports.marker_pairs(references(spark, d), [3]).select("a", "b", r6("cosine", "cosine"))


# --- panels, summaries, views ------------------------------------------------------------------------------


@query(f"""WITH {EMB} SELECT sample, 'p' || feature % 4 AS entity, round(ln(1 + greatest(0.0, sum(value) / count(*))), 6) AS value FROM emb GROUP BY 1, 2""")
def panel_matrix(spark: SparkSession, d: str) -> DataFrame:
    long = samples(spark, d)
    panel = long.select("feature").distinct().select("feature", F.concat(F.lit("p"), (F.col("feature") % 4).cast("string")).alias("entity"))
    return pipelines.panel_matrix(long, panel).select("sample", "entity", r6("value", "value"))


@query("SELECT n_regionkey, max(abs(n_nationkey - 12))::DOUBLE AS strongest, CASE WHEN avg(n_nationkey - 12) > 0 THEN 'higher' WHEN avg(n_nationkey - 12) < 0 THEN 'lower' ELSE 'none' END AS direction FROM nation GROUP BY 1")
def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.signal_summary(table(spark, d, "nation").select("n_regionkey", (F.col("n_nationkey") - 12).cast("double").alias("weight")), "n_regionkey")


EVI = f"""pos AS (SELECT sample, label, feature, abs(value) AS value FROM emb), cand AS (SELECT 'c' || (i % 16) AS candidate, i AS feature FROM range(64) t(i)),
val AS (SELECT sample, label, candidate AS feature, sum(value) / count(*) AS value FROM pos JOIN cand USING (feature) GROUP BY 1, 2, 3)"""


@query(f"""WITH {EMB}, {EVI}, e AS (SELECT feature AS candidate, auc, log2((m1 + 1) / (m0 + 1)) AS fc, detect1 - detect0 AS gap FROM {profile_sql('val')} JOIN (SELECT feature, auc FROM {AUC_SQL.format(src='val')}) USING (feature)),
x AS (SELECT candidate, 0.6 * greatest(0.0, (greatest(auc, 1 - auc) - 0.5) * 2) + 0.3 * least(1.0, abs(fc) / 3) + 0.1 * least(1.0, abs(gap) / 50) AS expression_score, CASE WHEN fc > 0.05 THEN 'higher' WHEN fc < -0.05 THEN 'lower' ELSE 'none' END AS direction FROM e)
SELECT candidate, round(expression_score, 6) AS expression_score, direction, round(0.45 * (substr(candidate, 2)::INT / 16.0) + 0.45 * expression_score + 0.1 * ((48 + substr(candidate, 2)::INT) / 64.0), 6) AS integrated FROM x""")
def integrated_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The historical integration over sixteen candidates of four features each."""
    long = samples(spark, d).withColumn("value", F.abs("value")).withColumn("feature", F.concat(F.lit("f"), F.col("feature").cast("string")))
    candidates = spark.createDataFrame([(f"c{i}", ";".join(f"f{i + 16 * j}" for j in range(4)), i / 16) for i in range(16)], "candidate string, features string, sequence_score double")
    signals = spark.createDataFrame([(f"f{i}", -i / 64) for i in range(64)], "feature string, weight double")
    out = reports.integrate_evidence(candidates, long, signals)
    return out.select("candidate", r6("expression_score", "expression_score"), "direction", r6("integrated", "integrated"))


VERDICTS = """v AS (SELECT s_suppkey, 'c' || s_suppkey AS candidate, CASE s_suppkey % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'family' ELSE 'exact' END AS method, 'h' || s_suppkey % 7 AS hypothesis, s_acctbal > {cut} AS ok, s_suppkey % 2 = 0 AS lone FROM supplier)"""


def verdict_rows(spark: SparkSession, d: str, cut: int) -> DataFrame:
    """(candidate, method, hypothesis, replicated, ...) made of the suppliers."""
    k = F.col("s_suppkey")
    method = F.when(k % 5 == 0, "absent").when(k % 5 == 1, "family").otherwise("exact")
    out = table(spark, d, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("candidate"), method.alias("method"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("hypothesis"), (F.col("s_acctbal") > cut).alias("ok"), (k % 2 == 0).alias("lone"))
    exact = F.col("method") == "exact"
    return out.select("candidate", "method", "hypothesis", F.col("ok").alias("replicated"), (F.col("ok") & exact).alias("replicated_exact"), (F.col("ok") & exact & F.col("lone")).alias("practical"), (F.col("ok") & exact & ~F.col("lone")).alias("unambiguous"))


@query(f"""WITH {VERDICTS.format(cut=2000)}, s AS (SELECT count(*) AS candidates, count(*) FILTER (method = 'exact') AS exact, count(*) FILTER (method = 'family') AS proxy, count(*) FILTER (method = 'absent') AS absent, count(DISTINCT hypothesis) AS hypotheses,
count(*) FILTER (ok AND method = 'exact') AS replicated_exact, count(*) FILTER (ok AND method = 'family') AS replicated_proxy, count(*) FILTER (ok AND method = 'exact' AND lone) AS practical, count(*) FILTER (ok AND method = 'exact' AND NOT lone) AS unambiguous FROM v)
SELECT 'external' AS section, metric, value::VARCHAR AS value, 'primary' AS analysis FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)""")
def external_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and replication counts as rows of the consolidated table."""
    return pipelines.metric_rows("external", pipelines.external_summary(verdict_rows(spark, d, 2000)), "primary")


@query(f"""WITH {VERDICTS.format(cut=2000)} SELECT candidate, ok AND method = 'exact' AND b AS robust, ok AND method = 'exact' AND NOT lone AND b AS strict, ok AND method = 'exact' AND lone AND b AS practical_both
FROM v JOIN (SELECT s_suppkey, s_acctbal > 5000 AS b FROM supplier) USING (s_suppkey)""")
def robust_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.robust_flags(verdict_rows(spark, d, 2000), verdict_rows(spark, d, 5000)).select("candidate", "robust", "strict", "practical_both")


# --- whole pipelines: iterative fits, compared with in-process versions in the tests ---------------------------


@query(None)
def model1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Model 1: every unlabelled sequence by its out-of-bag score, with ranks and percentiles."""
    out = pipelines.rank_sequences(curated(spark, d))
    return out.select("name", big("rank", "rank"), r6("score", "score"), r6("percentile", "percentile"), "oob_models", "fallback")


@query(None)
def model2_validation(spark: SparkSession, d: str) -> DataFrame:
    """Model 2: candidates of several features each, tested one by one on cases and controls."""
    long = samples(spark, d).withColumn("value", F.abs("value")).withColumn("feature", F.concat(F.lit("f"), F.col("feature").cast("string")))
    rows = [(f"c{i}", ";".join(f"f{(i * 7 + j) % 80}" for j in range(1 + i % 3)), (i % 11) / 11) for i in range(64)]
    out = pipelines.validate_candidates(long, spark.createDataFrame(rows, "candidate string, features string, sequence_score double"))
    return out.select("candidate", "hypothesis", r6("cv_auc", "cv_auc"), r6("fdr", "fdr"), r6("integrated", "integrated"), big("integrated_rank", "integrated_rank"), big("validation_rank", "validation_rank"), "pareto", "sharing")


@query(None)
def baseline_training(spark: SparkSession, d: str) -> DataFrame:
    """The batch logistic baseline on a stratified split of the measurements, and the scores of its test rows."""
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"), F.count("*").cast("double").alias("n"))
    wide = e.join(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), (F.col("c_acctbal") > 5000).cast("int").alias("classe")), "sample_id")
    return pipelines.train_baseline(materialize(wide.select("sample_id", "classe", "mean", "top", "n")))[1]
