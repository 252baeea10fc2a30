"""K-mer profiles, vocabularies, centroids, similarities and motifs on (entity, sequence) frames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import sequence as S
from ..storage import materialize
from .learning import CODES, dense_features, feature_columns
from .ranking import global_rank


def kmer_counts(df: DataFrame, sizes: list[int], entity: str = "entity", seq: str = "sequence", keep: list[str] | None = None) -> DataFrame:
    """(entity, feature, n), and the columns ``keep``: k-mers of the sequence with their counts; a null sequence has none.

    A sequence is counted where it is, so what is shuffled is a row for each of its different k-mers, not for each letter. Rows that share
    the entity and what is kept are counted together.
    """
    keys = [entity, *(keep or [])]
    rows = df.select(*keys, seq)
    names = {k: ["".join(p) for p in product("ACGU", repeat=k)] for k in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: pa.array(n) for k, n in names.items()}
        for batch in batches:
            at, features, counts = [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for k in sizes:
                    found, n = counted_kmers(text or "", k)
                    at.append(np.full(len(n), i))
                    features.append(known[k].take(pa.array(found)) if isinstance(found, np.ndarray) else pa.array(found, pa.string()))
                    counts.append(n)
            if at:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(len(keys))), pa.concat_arrays(features), pa.array(np.concatenate(counts))], [*keys, "feature", "n"])

    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())])
    return rows.mapInArrow(run, schema).groupBy(*keys, "feature").agg(F.sum("n").alias("n"))


def counted_kmers(text: str, k: int) -> tuple[np.ndarray | list[str], np.ndarray]:
    """The different k-mers of a text and their counts: as numbers in the order of A, C, G and U, or as text where there are other letters."""
    letters = CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    if len(letters) and letters.max() > 3:
        found = Counter(text[i : i + k] for i in range(len(text) - k + 1))
        return list(found), np.array(list(found.values()), np.int64)
    codes = np.zeros(max(0, len(letters) - k + 1), np.int64)
    for j in range(k):
        codes = codes * 4 + letters[j : j + len(codes)]
    n = np.bincount(codes, minlength=1)
    found = np.flatnonzero(n)
    return found, n[found].astype(np.int64)


def kmer_vectors(df: DataFrame, sizes: list[int], entity: str = "entity", seq: str = "sequence", with_seed: bool = False) -> DataFrame:
    """(entity, feature, value): k-mer counts, and the seed with a mass of 2 if wanted, divided by their sum."""
    counts = kmer_counts(df, sizes, entity, seq)
    if with_seed:
        seeds = df.select(entity, F.concat(F.lit("seed:"), S.seed(F.col(seq))).alias("feature"), F.lit(2).cast("long").alias("n"))
        counts = counts.unionByName(seeds)
    total = F.sum("n").over(Window.partitionBy(entity))
    return counts.select(entity, "feature", (F.col("n") / total).alias("value"))


def feature_vectors(df: DataFrame, sizes: list[int], blocks: str = "core", entity: str = "entity", seq: str = "sequence") -> DataFrame:
    """(entity, feature, value) of the representation ``blocks``: core, composition, positional, terminals or full.

    Every representation has k-mers with the seed, the length (over 30, at most 1) and the GC share; full has all blocks.
    Positional k-mers have at most 4 letters and their own normalisation; terminal motifs are worth 0.25 each.
    """
    x = F.col(seq)
    out = kmer_vectors(df, sizes, entity, seq, with_seed=True)
    single: list[tuple[str, Column]] = [("composition:length", F.least(F.lit(1.0), F.length(x) / 30)), ("composition:gc", S.gc_fraction(x))]
    if blocks in ("composition", "full"):
        single += [(f"composition:base_{b}", S.base_fraction(x, b)) for b in "ACGU"] + [("composition:entropy", S.entropy(x))]
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in single))
    out = out.unionByName(df.select(entity, F.inline(pairs)))
    if blocks in ("positional", "full"):
        tags = df.select(entity, F.explode(S.positional_kmers(x, [k for k in sizes if k <= 4])).alias("feature"))
        counts = tags.groupBy(entity, "feature").agg(F.count("*").alias("n"))
        out = out.unionByName(counts.select(entity, "feature", (F.col("n") / F.sum("n").over(Window.partitionBy(entity))).alias("value")))
    if blocks in ("terminals", "full"):
        out = out.unionByName(df.select(entity, F.explode(S.terminal_motifs(x)).alias("feature"), F.lit(0.25).alias("value")))
    return out


def balanced_weights(df: DataFrame, weight: Column, family: str = "family") -> DataFrame:
    """Adds ``weight``: evidence over family size, rescaled so that the total evidence stays."""
    w = df.withColumn("_e", weight.cast("double")).withColumn("_b", F.col("_e") / F.count("*").over(Window.partitionBy(family)))
    totals = w.agg((F.sum("_e") / F.greatest(F.lit(1e-12), F.sum("_b"))).alias("_scale"))  # one row
    return w.join(F.broadcast(totals)).withColumn("weight", F.col("_b") * F.col("_scale")).drop("_e", "_b", "_scale")


def weighted_presence(features: DataFrame, weights: DataFrame, entity: str = "entity") -> DataFrame:
    """(feature, presence): the weights of the entities that have the feature, each entity once."""
    return features.select(entity, "feature").distinct().join(weights.select(entity, "weight"), entity).groupBy("feature").agg(F.sum("weight").alias("presence"))


def vocabulary(presence: DataFrame, least: float = 2.0) -> DataFrame:
    """Features to learn on: all seeds and compositions, others from a weighted presence of ``least``."""
    f = F.col("feature")
    return presence.where(f.startswith("seed:") | f.startswith("composition:") | (F.col("presence") >= least)).select("feature")


def centroid(vectors: DataFrame, weights: DataFrame | None = None, entity: str = "entity") -> DataFrame:
    """(feature, value): mean vector over entities, absent values as 0; weighted means divide by max(1, all weights)."""
    if weights is None:
        n = vectors.agg(F.count_distinct(entity).alias("_n"))
        return vectors.groupBy("feature").agg(F.sum("value").alias("_s")).join(F.broadcast(n)).select("feature", (F.col("_s") / F.greatest(F.lit(1), F.col("_n"))).alias("value"))
    total = weights.agg(F.greatest(F.lit(1.0), F.sum("weight")).alias("_n"))
    sums = vectors.join(weights.select(entity, "weight"), entity).groupBy("feature").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
    return sums.join(F.broadcast(total)).select("feature", (F.col("_s") / F.col("_n")).alias("value"))


def cosine_to(vectors: DataFrame, target: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, cosine) with one target vector (feature, value); 0 where a norm is 0."""
    norm = target.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_t"))
    met = vectors.join(target.withColumnRenamed("value", "_v"), "feature", "left")
    sums = met.groupBy(entity).agg(F.sum(F.col("value") * F.coalesce("_v", F.lit(0.0))).alias("_d"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    product = F.col("_n") * F.coalesce("_t", F.lit(0.0))
    return sums.join(F.broadcast(norm)).select(entity, F.when(product > 0, F.col("_d") / F.when(product > 0, product)).otherwise(0.0).alias("cosine"))


#: Cells (features and references) of a matrix of references that is broadcast at most.
REFERENCE_CELLS = 4_000_000


def nearest_sequences(left: DataFrame, right: DataFrame, sizes: list[int], k: int, with_seed: bool = True, places: int = 9) -> DataFrame:
    """(a, b, cosine, rank): the ``k`` references nearest to each left sequence by k-mer counts, and the seed with a mass of 2 if wanted.

    Both are (entity, sequence) of A, C, G and U; references of no common feature are left out, ties (in ``places``) go to the smaller reference.
    A sequence's vector is made where the sequence is. References go in blocks of bounded size, each one broadcast matrix that a pass over the
    left side multiplies with; a pass keeps ``k`` a sequence, and the passes' best are merged. So no pair becomes a row, whatever either side's size.
    """
    spark, kinds = left.sparkSession, tuple(sorted(sizes))
    width = len(feature_columns(kinds, "core")) - 2
    per = max(1, REFERENCE_CELLS // width)
    ranked = right.select("entity", "sequence")
    n = ranked.count()
    blocks = -(-n // per)
    if blocks > 1:  # blocks in order of the reference, so ties are the same however many there are
        ranked = materialize(global_rank(ranked, ["entity", "sequence"], "_r"))
    kind_a, kind_b = left.schema["entity"].dataType.simpleString(), right.schema["entity"].dataType.simpleString()
    b_type = to_arrow_type(right.schema["entity"].dataType)

    def made(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, mass = dense_features(texts, kinds, "core")
        x, mass = x[:, :-2], mass if with_seed else np.zeros(len(texts))
        norm = np.sqrt((x * x).sum(axis=1) + mass * mass)
        norm = np.where(norm > 0, norm, 1.0)
        return x / norm[:, None], mass / norm, [t[1:8] for t in texts]

    def best(block: list) -> DataFrame:
        names = [r["entity"] for r in block]
        unit, seed_mass, seeds = made([r["sequence"] for r in block])
        known: dict[str, list[int]] = {}
        for i, s in enumerate(seeds):
            known.setdefault(s, []).append(i)
        shared = spark.sparkContext.broadcast((names, unit, seed_mass, known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit, seed_mass, known = shared.value
            for batch in batches:
                for begin in range(0, batch.num_rows, 64):
                    part = batch.slice(begin, 64)
                    x, mass, own = made(part.column(1).to_pylist())
                    cos = x @ unit.T
                    for i, s in enumerate(own):
                        if mass[i] and s in known:
                            cos[i, known[s]] += mass[i] * seed_mass[known[s]]
                    order = np.argsort(-cos.round(places), axis=1, kind="stable")[:, :k]
                    i, rank = np.nonzero(np.take_along_axis(cos, order, axis=1) > 0)
                    j = order[i, rank]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array([names[x] for x in j.tolist()], b_type), pa.array(cos[i, j]), pa.array(rank + 1, pa.int32())], ["a", "b", "cosine", "rank"])

        return left.select("entity", "sequence").mapInArrow(run, f"a {kind_a}, b {kind_b}, cosine double, rank int")

    if blocks <= 1:
        return best(ranked.orderBy("entity", "sequence").collect())
    left = materialize(left.select("entity", "sequence"))
    found = None
    for at in range(blocks):
        part = best(ranked.where((F.col("_r") > at * per) & (F.col("_r") <= (at + 1) * per)).orderBy("_r").collect())
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", places)), F.col("b"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def motif_enrichment(positive: DataFrame, background: DataFrame, weights: DataFrame, least: float = 2.0, top: int | None = 30) -> DataFrame:
    """(motif, presence, enrichment): log2 of smoothed weighted presence in positives over that in the background; the top positive ones, or all."""
    p = weighted_presence(positive, weights)
    totals = weights.agg(F.sum("weight").alias("_w"))
    size = background.agg(F.count_distinct("entity").alias("_n"))
    b = background.select("entity", "feature").distinct().groupBy("feature").agg(F.count("*").alias("_b"))
    met = p.where(F.col("presence") >= least).join(b, "feature", "left").join(F.broadcast(totals)).join(F.broadcast(size))
    ratio = ((F.col("presence") + 0.5) / (F.col("_w") + 1)) / ((F.coalesce("_b", F.lit(0)) + 0.5) / (F.col("_n") + 1))
    found = met.select(F.col("feature").alias("motif"), "presence", F.log2(ratio).alias("enrichment")).where("enrichment > 0")
    return found if top is None else found.orderBy(F.desc("enrichment"), F.desc("presence"), "motif").limit(top)


def motif_coverage(df: DataFrame, motifs: DataFrame, sizes: list[int], entity: str = "entity", seq: str = "sequence") -> DataFrame:
    """(entity, coverage): enrichment of the motifs a sequence contains over that of all; joined on the sequence's own k-mers."""
    total = motifs.agg(F.sum("enrichment").alias("_t"))
    held = kmer_counts(df, sizes, entity, seq).select(entity, F.col("feature").alias("motif"))
    sums = held.join(motifs.select("motif", "enrichment"), "motif").groupBy(entity).agg(F.sum("enrichment").alias("_s"))
    out = df.select(entity).distinct().join(sums, entity, "left").join(F.broadcast(total))
    return out.select(entity, F.when(F.col("_t") > 0, F.coalesce("_s", F.lit(0.0)) / F.col("_t")).otherwise(0.0).alias("coverage"))
