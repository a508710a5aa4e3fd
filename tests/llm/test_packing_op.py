"""Packing: an exact round trip through the tokenizers library."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from cases import DOCS, ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalog.llm import packing

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text: str | None) -> list[int]:
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


def crc(some: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(some)}I", *some))


def check(pieces, rows) -> None:
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(ids(r[1]))
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for p in pieces.collect():
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(docs) == set(texts)
    for doc, expected in texts.items():
        whole = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in docs[doc])
        if len(expected) == 1:
            at = 0
            for start, length, value, total in whole:
                assert (start, value, total) == (at, crc(expected[0][at : at + length]), len(expected[0]))
                at += length
            assert at == len(expected[0])
        else:
            assert sum(w[1] for w in whole) == sum(map(len, expected))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= packing.LENGTH
    total = sum(len(x) for some in texts.values() for x in some)
    assert len(sequences) == -(-total // packing.LENGTH)  # no padding but at the very end


def test_edges(spark, edges):
    check(packing.op4_packing(spark, edges), ROWS)


def test_empty(spark, empty):
    assert packing.op4_packing(spark, empty).count() == 0


def test_odd_texts(spark, folder):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "  two  spaces ", "tail \n", "\n\n\n", "a b   c", "don't  can't", "x" * 3000, "é" * 700, "1 22 333 4444", "\U0001f600 \U0001f600", "tab\tand\x0bvt", "a \u0085 b"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts * 3)]
    check(packing.op4_packing(spark, folder(documents=(rows, DOCS))), rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'.1 \n\t\r\x0b \u0085 é中\U0001f600<|>")), max_size=40), min_size=1, max_size=8))
def test_blocks_of_texts_have_the_library_s_ids(texts):
    made = packing.tokens().batch(pa.array(texts))
    assert [list(struct.unpack(f"<{len(x) // 2}H", x)) for x in made] == [ids(t) for t in texts]


def test_a_shorter_window(spark):
    docs = spark.createDataFrame(ROWS, DOCS).selectExpr("*", "1 AS start", "2 AS ids")
    got = packing.pack(docs, length=64)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 64").isEmpty()
