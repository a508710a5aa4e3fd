"""Language identification: accuracy on held-out rows, what it may look at, and edges."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, ROWS, remainder

from stratalog.llm import langid

WORDS = {
    "en": "the and of to in that was with for his they from have this which you were there their".split(),
    "de": "der die und das nicht ist mit sich auf eine dem werden auch nach wie über bei einen".split(),
    "fr": "le les des est dans une pour que qui pas sur plus avec par sont cette être aux".split(),
}


def some_rows(n: int = 240) -> list[tuple]:
    rng = random.Random(8)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(12, 60))), lang, "s", 1) for i in range(n) for lang in (rng.choice(list(WORDS)),)]


def test_held_out_rows(spark, folder):
    rows = some_rows()
    got = {r["doc_id"]: r for r in langid.op1_langid(spark, folder(documents=(rows, DOCS))).collect()}
    assert all(got[r[0]]["held_out"] == (remainder(r[0], 4) == 2) for r in rows)
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert not any(r["rejected"] for r in got.values())


def test_held_out_labels_aren_t_looked_at(spark, folder):
    rows = some_rows()
    first = sorted(map(tuple, langid.op1_langid(spark, folder(documents=(rows, DOCS))).collect()))
    turned = [(r[0], r[1], "other" if remainder(r[0], 4) == 2 else r[2], "elsewhere", 5) for r in rows]
    again = sorted(map(tuple, langid.op1_langid(spark, folder(documents=(turned, DOCS))).collect()))
    assert [(*r[:3], r[4]) for r in again] == [(*r[:3], r[4]) for r in first]
    assert [r[3] for r in again] == pytest.approx([r[3] for r in first], abs=1e-5)


def test_edges(spark, edges):
    rows = langid.op1_langid(spark, edges).collect()
    assert len(rows) == len(ROWS)
    languages = {r[2] for r in ROWS if r[2] and r[1] is not None and remainder(r[0], 4) != 2}
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    for doc, text, *_ in ROWS:
        if doc:
            und = text is None or not any(c.isalpha() for c in text)
            assert (by[doc]["lang_pred"] == "und") == und, doc
            assert by[doc]["lang_pred"] in languages | {"und"}
            assert by[doc]["rejected"] or not und


def test_empty_and_no_training_row(spark, empty, folder):
    assert langid.op1_langid(spark, empty).count() == 0
    got = langid.op1_langid(spark, folder(documents=([(1, "some text", None, None, None)], DOCS))).first()
    assert (got["lang_pred"], got["score"], got["rejected"]) == ("und", 0.0, True)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_counts_do_not_depend_on_the_stretch(monkeypatch, stretch):
    texts = pa.array(["", "a", "The cats", "é", "x1y2 zz", "", "ÜBER alles " * 9, "q"])
    whole = langid.counts(texts)
    monkeypatch.setattr(langid, "STRETCH", stretch)
    assert np.array_equal(langid.counts(texts), whole)
    for row, text in zip(whole, texts.to_pylist(), strict=True):
        n = len(text.lower().encode()) + 2  # with a space on either side
        assert row.sum() == (n - 1) + (n - 2)


def test_text_of_another_script_is_rejected(spark):
    docs = spark.createDataFrame(some_rows(), DOCS)
    model = langid.train(docs)
    odd = spark.createDataFrame([("漢字仮名交じり文の文章です",), ("the and of to in that was",)], "text string")
    assert [r["rejected"] for r in langid.identify(odd, model).orderBy("text").collect()] == [False, True]


def junk(rng: random.Random) -> str:
    """Random letters, hexadecimal, base 64, or identifiers: letters, but no language."""
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 10))) for _ in range(rng.randrange(15, 80)))
    if kind == 1:
        return "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(200, 600)))
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rng.randrange(200, 600)))


def test_nearest_centroid_by_brute_force(spark):
    """Each text's cosines with all centroids, one by one, in plain Python."""
    rows = some_rows(90)
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs)
    for r in langid.identify(docs, model).collect():
        grams: dict[int, int] = {}
        raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {r['text'].lower()} ".encode()]
        for n, low, dims in ((2, 0, langid.DIMS[0]), (3, langid.DIMS[0], langid.DIMS[1])):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(bytes(raw[i : i + n]), "big")
                at = (code * 2654435761 >> 15) % dims + low
                grams[at] = grams.get(at, 0) + 1
        x = {g: math.log1p(n) * model["idf"][g] for g, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        near = [sum(v * float(model["centroids"][g, j]) for g, v in x.items()) / norm for j in range(len(model["langs"]))]
        best = max(range(len(near)), key=near.__getitem__)
        assert r["lang_pred"] == model["langs"][best]
        assert r["score"] == pytest.approx(near[best], abs=1e-4)
        assert r["rejected"] == (near[best] < model["limits"][best, min(int(math.log2(len(grams))), langid.LENGTHS - 1)])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_junk_is_rejected_and_documents_are_not(spark):
    """Trained on the driver's documents: of texts without a language nearly all are rejected, of documents with a label next to none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(4)
    model = langid.train(docs.where(~langid.held_out()))
    odd = langid.identify(spark.createDataFrame([(junk(rng),) for _ in range(200)], "text string"), model).collect()
    rate = sum(r["rejected"] for r in odd) / len(odd)
    kept = langid.identify(docs.where("text is not null"), model).where("lang_pred <> 'und'").collect()
    lost = [r for r in kept if r["rejected"]]
    print(f"junk rejected: {rate:.3f}; documents rejected: {len(lost)} of {len(kept)}", [(r["score"], r["text"][:60]) for r in lost][:9])
    assert rate >= 0.85
    assert len(lost) <= 0.003 * len(kept)


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([*some_rows(), *ROWS], DOCS).selectExpr("*", "1 AS score", "2 AS rejected", "3 AS lang_pred")
    got = langid.keep_identified(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r["score"] for r in kept} == {1}
    assert {r[0] for r in some_rows()} <= {r["doc_id"] for r in kept}
    assert not any(r["text"] is None for r in kept)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_the_driver_s_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = langid.op1_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL AND length(text) > 40").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) > 100
