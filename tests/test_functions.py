import math

import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions import formats, hashing, names, scores, sequence, stats


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names(spark):
    n = lambda x: F.lit(x)
    row = one(
        spark, names.external_name(n(" hsa_miR-32-3p ")), names.external_family(n("hsa-miR-32-3p")), names.external_family(n("hsa-let-7a-1-5p")),
        names.precursor_family(n("hsa-mir-574")), names.precursor_family(n("hsa-mir-19b-2")), names.precursor_base_legacy(n("hsa-mir-574")),
        names.marker_name(n(" miR-21 ")), names.mature_base(n("hsa-mir-1-12p")), names.display_name(n("let-7a")),
    )
    assert tuple(row) == ("mir-32-3p", "mir-32", "let-7a", "hsa-mir-574", "hsa-mir-19b", "hsa-mir", "hsa-mir-21", "hsa-mir-1", "let-7a")
    assert one(spark, names.precursor_family(F.lit(None).cast("string")))[0] is None


def test_sequences(spark):
    s = lambda x: F.lit(x)
    row = one(
        spark, sequence.normalize_sequence(s("acgTn-u")), sequence.kmers(s("ACG"), [2, 3, 4]), sequence.seed(s("ACGUACGUA")), sequence.gc_fraction(s("")),
        sequence.entropy(s("ACGU")), sequence.positional_kmers(s("ACGUAC"), [2]), sequence.terminal_motifs(s("ACG")), sequence.position_matches(s("ACGUACG"), s("ACGAACG")),
    )
    assert row[0] == "ACGUU" and row[1] == ["AC", "CG", "ACG"] and row[2] == "CGUACGU" and row[3] == 0 and row[4] == 1
    assert row[5] == ["positional:5p:AC", "positional:center:CG", "positional:center:GU", "positional:3p:UA", "positional:3p:AC"]
    assert row[6] == ["terminal:5p:2:AC", "terminal:3p:2:CG", "terminal:5p:3:ACG", "terminal:3p:3:ACG"] and abs(row[7] - 6 / 7) < 1e-12


def test_normal_cdf_and_auc_inference(spark):
    n = F.lit(100.0)
    row = one(
        spark, stats.normal_cdf(F.lit(0.0)), stats.normal_cdf(F.lit(1.96)), stats.auc_p_value(F.lit(0.5), n, n), stats.auc_p_value(F.lit(0.8), n, n), stats.auc_p_value(F.lit(0.6), n, n),
        stats.auc_p_value(F.lit(1.0), F.lit(1e4), F.lit(1e4)), stats.auc_standard_error(F.lit(0.75), n, n), stats.auc_standard_error(F.lit(1.0), n, n),
    )
    assert abs(row[0] - 0.5) < 1e-7 and abs(row[1] - 0.975) < 1e-4 and abs(row[2] - 0.5) < 1e-7 and row[3] < row[4]
    assert row[5] == stats.P_FLOOR and 0 < row[6] < 0.05 and row[7] > 0


def test_effects(spark):
    c = [F.lit(float(x)) for x in (5, 1, 3, 2, 1, 3)]
    g, d = one(spark, stats.hedges_g(*c), stats.cohen_d(c[0], c[1], c[3], c[4]))
    assert abs(g - (1 - 3 / 15) * 3) < 1e-12 and d == 3
    zero = F.lit(0.0)
    assert one(spark, stats.hedges_g(c[0], zero, c[2], c[3], zero, c[2]))[0] == 0


def test_lenient_numbers(spark):
    values = ["1.5", "", " 2 ", "x", None, "NaN", "1d", "-3e2", "inf"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(stats.lenient_number(F.col("v"))).collect()]
    assert got == [1.5, 0, 2, 0, 0, 0, 0, -300, 0]


def test_hashes_and_draws(spark):
    assert one(spark, hashing.fnv1a(F.lit("a")), hashing.fnv1a(F.lit("foobar"))) == (0xE40C292C, 0xBF9CF968)
    assert hashing.fnv1a_py("foobar") == 0xBF9CF968
    got = [r[0] for r in spark.range(200).select(hashing.counter_uniform(0x54C043, F.col("id"))).collect()]
    assert np.allclose(got[:2], [0.4691199727822095, 0.6582786680664867]) and np.allclose(got, hashing.counter_uniform_np(0x54C043, 200))
    draws = hashing.CongruentialDraws(1)
    assert abs(draws.draw() - (1664525 + 1013904223) / 2**32) < 1e-12
    assert sorted(hashing.CongruentialDraws(3).shuffle(list(range(9)))) == list(range(9))


def test_scores(spark):
    n = F.lit(None).cast("string")
    row = one(
        spark, scores.expression_score(F.lit(0.2), F.lit(-6.0), F.lit(25.0)), scores.direction_from_fold_change(F.lit(0.04)), scores.marker_weight(F.lit("Alta ")), scores.marker_weight(n),
        scores.evidence_weight(F.lit(-1.0)), scores.directional(F.lit(0.3), F.lit("lower"), flip_from=1.0), scores.directional(F.lit(0.3), n, flip_from=1.0), scores.parse_pairs(F.lit("a:0.8; b:x;; ")),
    )
    assert abs(row[0] - (0.6 * 0.6 + 0.3 + 0.05)) < 1e-12 and row[1] == "none" and row[2:5] == (3.0, 1.0, 1.0) and row[5] == 0.7 and row[6] == 0.3
    assert [tuple(x) for x in row[7]] == [("a", 0.8), ("b", None)]
    assert math.isclose(one(spark, stats.sigmoid(F.lit(36.0)))[0], 1.0)


def test_number_formats(spark):
    df = spark.createDataFrame([(1.5e-7, 0.0), (0.034, -0.00001), (1234.5678, 12.0), (None, None)], "x double, y double")
    got = df.select(formats.fixed(F.col("x"), 3), formats.exponential(F.col("x")), formats.percent(F.col("x")), formats.points(F.col("y")), formats.grouped(F.col("x") * 1000), formats.display_value(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [
        ("0.000", "1.500000e-7", "0.00%", "+0.00", "0", "0.0000"), ("0.034", "3.400000e-2", "3.40%", "-0.00", "34", "0.0340"),
        ("1234.568", "1.234568e+3", "123456.78%", "+1200.00", "1.234.567", "1234.57"), (None,) * 6,
    ]
