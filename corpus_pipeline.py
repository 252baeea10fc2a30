"""The corpus pipeline: toxic documents go, near-duplicates and repeated passages go, sources are mixed, documents are packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import minhash, mixing, packing, suffix_repeats, toxicity
from cohortlens.llm.common import materialize, prepare, settled, written
from cohortlens.llm.queries import QUALITY_TARGETS, byte_bpe

#: Up to this many rows (16 bytes each) are broadcast to drop them from the documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_columns(stage: Stage) -> Stage:
    """The stage, blind to all columns but doc_id, text and n_chars: the others come back as they were, whatever their names."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        names = docs.columns
        plain = [n if n in ("doc_id", "text", "n_chars") and names.index(n) == i else f"column_{i}" for i, n in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*names)

    return run


@own_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among ``docs``."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where(F.col("toxic_score") < toxicity.THRESHOLD).select(docs.columns)


@own_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: a row with the smallest id; of rows that are wholly equal, id included, one.

    Rows are dropped by id and text, so rows that share an id and not a text are judged apart, and rows that share both but differ in
    another column stay or go together. Texts without words stay. Rows without id are left as they are, equal ones too.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = materialize(docs.where("doc_id is not null").dropDuplicates().unionByName(docs.where("doc_id is null")))
    before = written()
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = settled(found.where("not stays").select("doc_id", "text_hash").distinct(), before)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti").select(docs.columns)


@own_columns
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur more than once are cut from the texts; the documents stay."""
    out = suffix_repeats.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


@own_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    model = mixing.fit_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    mixed = mixing.mix(docs, model, QUALITY_TARGETS, docs.columns)
    return mixed.where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with their ids; ``doc_row`` tells the copies of a document apart."""
    prepare(spark)
    return packing.pack(docs, byte_bpe(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's result is written to the shared folder and read again.

    What a stage has written on its way is deleted when its result, and so all that reads it, is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = written()
        docs = settled(stage(spark, docs, sf_dir), before)
    return docs


#: SQL cannot express the classifiers, the suffix arrays or the packing.
ORACLE_SQL = None
