"""The pipeline's stages: each works on what the one before it kept, and its decisions take effect."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from cases import DOCS, ROWS, WORD
from test_langid_op import some_rows
from test_mixing_op import targets
from test_packing_op import ids
from test_simhash_op import components, fingerprint


def rows() -> list[tuple]:
    rng = random.Random(12)
    out = [(i, t, lang, rng.choice("abc"), len(t)) for i, t, lang, *_ in some_rows(200)]
    out += [(1000 + i, out[i][1], out[i][2], "c", out[i][4]) for i in range(0, 60, 3)]  # copies
    out += [(2000 + i, f"{out[i][1]} write to person{i}@mail.example or call +49 30 12345{i:02d} soon", out[i][2], "b", 1) for i in range(20)]
    return out + [(3000 + i, t, None, "a", None) for i, t in enumerate((None, "", "12 34", "漢字仮名交じり文の文章です、とても長い"))]


@pytest.fixture
def stages(spark, folder):
    """Each stage's input and output."""
    sf_dir = folder(documents=(rows(), DOCS))
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/stage{k}")
        out = spark.read.parquet(f"{sf_dir}/stage{k}")
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return seen


def test_stages(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [s[0] for s in stages] == ["language_id", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(s[3] == columns for s in stages[:-1])

    _, before, after, _ = stages[0]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {3000, 3001, 3002, 3003}

    _, before, after, _ = stages[1]
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in before]
    assert sorted(r["doc_id"] for r in after) == sorted(set(components(prints)))
    assert len(after) < len(before)

    _, before, after, _ = stages[2]
    old = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    assert not any("@" in r["text"] or "+49" in r["text"] for r in after)
    assert any("[EMAIL]" in r["text"] and "[PHONE]" in r["text"] for r in after)
    assert all(r["text"] == old[r["doc_id"]] for r in after if "@" not in old[r["doc_id"]])
    assert all(r["n_chars"] == len(r["text"]) for r in after if "[" in r["text"])

    _, before, after, _ = stages[3]
    sizes: Counter = Counter()
    taken: Counter = Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for s, t in targets(sizes).items():
        assert t - 1 <= taken[s] <= t

    _, before, after, _ = stages[4]
    assert sum(p["length"] for p in after) == sum(len(ids(r["text"])) for r in before)
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] for p in after)
    filled: Counter = Counter()
    for p in after:
        filled[p["sequence_id"]] += p["length"]
    assert sum(n < 1024 for n in filled.values()) <= 1 and max(filled.values()) <= 1024


def test_names_far_from_an_address_are_removed(spark):
    """The stage of personal data counts every word of a text, not only those beside a mention."""
    filler = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun near the old barn"
    texts = [f"Zanthrope wrote {filler} {'abc' * (i + 1)} mail kim@rare.example now" for i in range(4)]
    texts += [f"{filler} mail w{i}@h{i}.example now wrote {'abd' * (i + 1)}" for i in range(200)]
    texts += [f"{filler} wrote note mail now {'abe' * (i + 1)}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.sanitised(spark, docs, "").collect()}
    assert [after[i] for i in range(4)] == [texts[i].replace("Zanthrope", "").replace("kim@rare.example", "[EMAIL]") for i in range(4)]
    assert all(after[i] == texts[i] for i in range(204, 264))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder(documents=(rows(), DOCS))).count() > 0


def test_edges(spark, edges, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_edge_rows(spark, folder):
    docs = spark.createDataFrame(ROWS, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() > 0
