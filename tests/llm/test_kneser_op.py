"""The Kneser-Ney model against plain Python, and its verdicts."""

from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCS, PROSE, ROWS, remainder

from stratalog.llm import kneser

LABELS = "doc_id long, quality int, toxic int"


def symbols(text: str) -> list[int]:
    return [255] * 4 + [*text.encode(), 255]


def model(texts: list[str]):
    """p(byte | four before) of interpolated modified Kneser-Ney, by recursion over dictionaries."""
    top: Counter = Counter()
    for t in texts:
        s = symbols(t)
        top.update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    counts = {5: top}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    freed, whole, less = {}, {}, {}
    for k, c in counts.items():
        n = [0, *(sum(v == i for v in c.values()) for i in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
        d = [min(max(x, 0.05 * i), 0.95 * i) for i, x in zip((1, 2, 3), d, strict=True)]
        less[k] = lambda v, d=d: d[min(v, 3) - 1]
        freed[k], whole[k] = defaultdict(float), defaultdict(int)
        for g, v in c.items():
            freed[k][g[:-1]] += less[k](v)
            whole[k][g[:-1]] += v

    def p(gram: tuple) -> float:
        k = len(gram)
        if not k:
            return 1 / 256
        lower = p(gram[1:])
        if not whole[k][gram[:-1]]:
            return lower
        v = counts[k][gram]
        return (max(v - less[k](v), 0) if v else 0.0) / whole[k][gram[:-1]] + freed[k][gram[:-1]] / whole[k][gram[:-1]] * lower

    return p


def perplexity(p, text: str | None) -> float | None:
    s = symbols(text or "")
    if len(s) < 6:
        return None
    return sum(-math.log2(p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))) / (len(s) - 4)


def some_rows() -> list[tuple]:
    rng = random.Random(6)
    words = PROSE.split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))), "en" if i % 3 else "fr", "a", 1) for i in range(90)]
    return rows + [(500 + i, "".join(rng.choice("zqxjkvw!$#%7é") for _ in range(120)), "en", "a", 1) for i in range(3)]


def test_perplexities(spark, folder):
    rows = some_rows()
    sf_dir = folder(documents=(rows, DOCS), labels=([(i, 1, 0) for i in range(0, 60)] + [(61, 1, 1), (62, 0, 0), (63, None, None)], LABELS))
    p = model([r[1] for r in rows if r[0] < 60 and remainder(r[0], 10)])
    got = {r["doc_id"]: r for r in kneser.op9_kneser(spark, sf_dir).collect()}
    for r in rows:
        assert got[r[0]]["log_perplexity"] == pytest.approx(perplexity(p, r[1]), rel=1e-9)
        assert got[r[0]]["n_symbols"] == len(r[1].encode())
    assert [got[500 + i]["kept"] for i in range(3)] == [False] * 3
    assert sum(got[i]["kept"] for i in range(90)) == 90


@pytest.mark.parametrize("ids", [20, 1000])
def test_all_trusted_documents_are_counted(spark, folder, monkeypatch, ids):
    """The model is that of all labelled texts, whether their ids are broadcast or joined by shuffle; no number of them is enough."""
    rows = some_rows()
    sf_dir = folder(documents=(rows + rows[:3], DOCS), labels=([(i, 1, 0) for i in range(60)] + [(i, 1, 0) for i in range(30)] + [(None, 1, 0)], LABELS))
    monkeypatch.setattr(kneser, "TRUSTED", 20, raising=False)
    monkeypatch.setattr(kneser, "IDS", ids, raising=False)
    p = model([r[1] for r in rows + rows[:3] if r[0] < 60 and remainder(r[0], 10)])
    got = {r["doc_id"]: r["log_perplexity"] for r in kneser.op9_kneser(spark, sf_dir).collect()}
    assert got == pytest.approx({r[0]: perplexity(p, r[1]) for r in rows}, rel=1e-9)


def test_small_parts(spark, folder, monkeypatch):
    """Parts of a few documents: each lists its own n-grams, and the scores stay."""
    rows = some_rows()
    sf_dir = folder(documents=(rows, DOCS), labels=([(i, 1, 0) for i in range(60)], LABELS))
    first = {r["doc_id"]: r["log_perplexity"] for r in kneser.op9_kneser(spark, sf_dir).collect()}
    monkeypatch.setattr(kneser, "PART", 700)
    monkeypatch.setattr(kneser, "BYTES", 300)
    assert {r["doc_id"]: r["log_perplexity"] for r in kneser.op9_kneser(spark, sf_dir).collect()} == pytest.approx(first)


def test_texts_aren_t_shuffled(spark, edges):
    """The parts' texts are read from their buckets; only n-grams move."""
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    plan = kneser.perplexities(docs, docs.limit(1))._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroups") :].split("Exchange")[0]
    assert "Bucketed: true" in left


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_held_out_labels(spark):
    """Of labelled documents that training never sees, the good ones stay and most bad ones go."""
    got = kneser.op9_kneser(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where(kneser.held_out()).selectExpr("quality", "toxic", "cast(kept as int) AS kept").groupBy("quality", "toxic").agg({"kept": "avg", "*": "count"}).collect()
    rates = {(r["quality"], r["toxic"]): r["avg(kept)"] for r in got}
    print(got)
    assert rates[1, 0] >= 0.99
    assert rates[0, 0] <= 0.35


def test_probabilities_sum_to_one():
    p = model([r[1] for r in some_rows()[:40]])
    for context in (b"\xff\xff\xff\xff", b"the ", b"~~~~", b"se w"):
        assert sum(p((*context, s)) for s in range(256)) == pytest.approx(1)


def test_edges(spark, edges):
    got = kneser.op9_kneser(spark, edges)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["log_perplexity"] is None) == (r["n_symbols"] == 0)
        assert not r["kept"] or r["n_symbols"]
    known = [r for r in rows if r["doc_id"] == 4]
    assert known[0]["log_perplexity"] < 3


def test_no_trusted_text(spark, folder):
    sf_dir = folder(documents=(ROWS, DOCS), labels=([], LABELS))
    values = {r["log_perplexity"] for r in kneser.op9_kneser(spark, sf_dir).collect()}
    assert values == {None, 8.0}


def test_empty(spark, empty):
    assert kneser.op9_kneser(spark, empty).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame(some_rows(), DOCS).selectExpr("*", "1 AS kept", "2 AS threshold", "3 AS q1", "4 AS n")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = kneser.judge(docs, labels)
    assert {"kept", "threshold", "log_perplexity", "n_symbols", "n"} <= set(got.columns)
    assert np.isfinite([r["log_perplexity"] for r in got.collect()]).all()
