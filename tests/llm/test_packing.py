import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer

from cohortlens.llm import packing
from cohortlens.llm.queries import byte_bpe


def check(spark, texts, capacity=64, windows=4, parts=5, key="long"):
    rows = [(i if key == "long" else f"k{i}", t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"doc_id {key}, text string, start string").repartition(parts)
    got = packing.pack(df, byte_bpe(), capacity=capacity, windows=windows, with_ids=True).collect()
    plain = Tokenizer.from_file(byte_bpe())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for (d, t, _) in rows:
        want = np.array([*(plain.encode(t, add_special_tokens=False).ids if t else []), 1], "<u4")
        pieces = sorted(by[d], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) == want.tobytes()
        at = 0
        for p in pieces:
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(want), zlib.crc32(p["ids"])) and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(sequences), len(got)


def test_whole_texts_are_packed(spark, prose):
    texts = [prose(i, 1 + i * 3) for i in range(60)] + ["", None, "<|endoftext|> is text", "  spaces\n\n é 漢字 ", prose(3, 900)] + [prose(1, 4)] * 3
    padding, _, _ = check(spark, texts)
    assert padding == 0
    check(spark, texts[:3], key="string", parts=1)


def test_rounds_of_merges(spark, prose, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    assert check(spark, [prose(i, 20) for i in range(30)], parts=9)[0] == 0


def test_long_texts_are_encoded_in_parts(prose, monkeypatch):
    text = prose(4, 400) + "  double  spaces\n x " + prose(5, 400)
    whole = packing.encoder(byte_bpe())(text)
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    assert (packing.encoder(byte_bpe())(text) == whole).all()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), byte_bpe()).count() == 0


def test_best_fit():
    out = []
    p = packing.Packer(8, 2, 0, out.append)
    seen = lambda rows: [(r[0], r[1], len(r[2])) for r in rows]
    for name, n in (("a", 5), ("b", 6), ("c", 2), ("d", 4)):  # c fits b's window best and fills it; d opens another
        p.add(name, 0, np.arange(n, dtype=np.uint32), n)
    assert [seen(rows) for rows in out] == [[("b", 0, 6), ("c", 0, 2)]]
    assert [(w[0], seen(w[2])) for w in p.open] == [(3, [("a", 0, 5)]), (4, [("d", 0, 4)])]
    for name, n in (("e", 4), ("f", 7), ("g", 6), ("h", 2)):  # e fills d's window, f opens one; g fits none: the fullest, f's, takes its first token and is emitted
        p.add(name, 0, np.arange(n, dtype=np.uint32), n)
    assert [seen(rows) for rows in out[1:]] == [[("d", 0, 4), ("e", 0, 4)], [("f", 0, 7), ("g", 0, 1)]]
    assert [(w[0], seen(w[2])) for w in p.open] == [(1, [("a", 0, 5), ("h", 0, 2)]), (3, [("g", 1, 5)])]
