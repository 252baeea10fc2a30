"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, hard_negatives, langid, media, minhash, mixing, mtree, packing, range_join, suffix_repeats, toxicity, url_rules, warc
from .common import crc_of, materialize, only, prepare, settled, written

#: The rules of op4 as (action, host, path): fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Wanted token shares of ``labels.quality`` 0 and 1.
QUALITY_TARGETS = {0: 0.05, 1: 0.95}


def whole_job(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written; the tables it made on its way are deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        before = written()
        return settled(query(spark, sf_dir), before)

    return run


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = mixing.fit_domains(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    mixed = mixing.mix(documents, model, QUALITY_TARGETS, ["doc_id"])
    return mixed.select("doc_id", "tokens", "posteriors", "rate", "copies")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rules_frame(spark, RULES))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_of("doc_id") % 5 == 0
    model = toxicity.fit_toxicity(documents, labels.where(~held))
    scored = toxicity.score_toxicity(only(documents, "doc_id", "text"), model)
    score = F.col("toxic_score")
    return scored.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_of("doc_id") % 4 == 2
    profiles = langid.fit_profiles(documents.where(~held))
    found = langid.predict_language(only(documents, "doc_id", "text"), profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = only(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    vectors = rows.select("vec_id", mtree.quantize(F.col("embedding")).alias("v"))
    return mtree.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.store_images(spark.read.parquet(f"{sf_dir}/documents.parquet")))  # what follows reads the written bytes
    return media.image_features(stored)


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=200)


def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of repeated strings themselves, with all their occurrences; the operator writes its result and deletes its tables, so it is no whole_job."""
    prepare(spark)
    return suffix_repeats.repeat_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=200)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe())
    return pieces.drop("ids")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, size=64, scale=64)


def op12_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, positives=5, k=5, percent=80, scale=256, relabel=7)


def byte_bpe() -> str:
    """The tokenizer file that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: whole_job(f) for name, f in globals().items() if name.startswith("op")} | {"repeat_groups": repeat_groups}


SQL: dict[str, str] = {}

SQL["op2_warc_transactions"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS origin FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM g
"""

SQL["op4_url_rules"] = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, action,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rk
      FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE rk = 1
"""

SQL["op7_top_k"] = """
WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

SQL["op1_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, component_id) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.component_id FROM r JOIN e ON r.doc_id = e.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(component_id) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

SQL["op9_suffix_repeats"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, blk, substr(h, (400 * blk + 1)::INT, 800) AS seg FROM (SELECT r, h, unnest(range(0, (length(h) + 399) // 400)) AS blk FROM d)),
b AS (SELECT r, blk * 200 + o AS p, seg, o FROM (SELECT r, blk, seg, unnest(range(0, least(200, length(seg) // 2))) AS o FROM g)),
w AS (SELECT r, p, substr(seg, (2 * o + 1)::INT, 2) AS byte, CASE WHEN 2 * o + 400 <= length(seg) THEN md5_number(substr(seg, (2 * o + 1)::INT, 400)) END AS k FROM b),
f AS (SELECT k FROM w WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
c AS (SELECT r, p, byte, max((f.k IS NOT NULL)::INT) OVER (PARTITION BY r ORDER BY p ROWS 199 PRECEDING) AS gone FROM w LEFT JOIN f USING (k)),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY p) AS before FROM c),
s AS (SELECT r, sum(gone)::BIGINT AS n_removed, sum((gone = 1 AND before = 0)::INT)::BIGINT AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (gone = 0), '') AS kept FROM e GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""

#: A vector takes part where no component is null or not finite.
_FINITE = "embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])"


def _centroid_sql(k: int, rounds: int) -> str:
    """Assignments and moves of centroids, one after the other."""
    steps = [
        f"e AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND {_FINITE})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM e QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS (SELECT r, vec_id, e.v, c, list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, k.v) + list_inner_product(k.v, k.v) AS d FROM e CROSS JOIN c{i} k QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i)")
            steps.append(f"c{i + 1} AS (SELECT k.c, coalesce(n.v, k.v) AS v FROM c{i} k LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{i} GROUP BY c) n ON k.c = n.c)")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string([x::BIGINT FOR x IN k.v], ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c
"""


SQL["op11_centroids"] = _centroid_sql(16, 3)

SQL["op12_range_join"] = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(vec_id, component_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.component_id FROM r JOIN l ON r.vec_id = l.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = m.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(component_id) AS component_id FROM r GROUP BY vec_id) m
"""

SQL["op13_hard_negatives"] = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""
