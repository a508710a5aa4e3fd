"""Quality rules against their SQL and plain Python."""

from __future__ import annotations

import random

import pytest
from cases import DOCS, PROSE, ROWS, WORD, collected

from stratalog.llm import rules

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measured(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        wins.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def some_rows() -> list[tuple]:
    rng = random.Random(9)
    words = [f"{'abcdefgh'[i % 8] * (1 + i % 9)}{i}" for i in range(300)]
    rows = []
    for i in range(700):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))
        if i % 11 == 0:
            text += " #" * rng.randrange(80)
        if i % 13 == 0:
            text = f"{text}\n{text}\n\n{text}"
        rows.append((i, text, "en" if i % 10 else "xx", f"s{i % 3}", 1))
    return rows


def test_edges_against_sql(spark, folder, oracle):
    """All but the very long text, for which the SQL takes too long."""
    sf_dir = folder(documents=([r for r in ROWS if r[0] != 6], DOCS))
    assert collected(rules.op6_rules(spark, sf_dir), *COLUMNS) == oracle(rules.oracle(), sf_dir, COLUMNS, "documents")


def test_edges(spark, edges):
    got = collected(rules.op6_rules(spark, edges), *COLUMNS)
    expected = sorted([(r[0], *measured(r[1])) for r in ROWS], key=str)
    assert sorted([r[:6] for r in got], key=str) == expected


def test_groups(spark, folder, oracle):
    """Groups of different sizes, blended with their language's and the corpus's quartiles."""
    rows = some_rows()
    sf_dir = folder(documents=(rows, DOCS))
    got = collected(rules.op6_rules(spark, sf_dir), *COLUMNS)
    assert got == oracle(rules.oracle(), sf_dir, COLUMNS, "documents")
    assert {r[7] for r in got if not r[6]} == {True, False}
    assert all(not r[7] for r in got if r[6])


def test_each_source_decides_for_itself(spark, folder, oracle):
    """What is usual in one source is out of bounds in the other, of the same language; the SQL agrees row by row."""
    rng = random.Random(3)
    plain = lambda i: " ".join(f"word{rng.randrange(10**6)}" for _ in range(60)) + " #" * (i % 3)
    marked = lambda i: " ".join(f"word{rng.randrange(10**6)} ####" for _ in range(60)) + " #" * (i % 3)
    rows = [(i, plain(i), "en", "prose", 1) for i in range(200)] + [(1000 + i, marked(i), "en", "code", 1) for i in range(200)]
    rows += [(500, marked(0), "en", "prose", 1), (501, plain(0), "en", "code", 1)]
    sf_dir = folder(documents=(rows, DOCS))
    got = collected(rules.op6_rules(spark, sf_dir), *COLUMNS)
    assert got == oracle(rules.oracle(), sf_dir, COLUMNS, "documents")
    kept = {r[0]: r[-1] for r in got}
    assert not kept[500] and all(kept[i] for i in kept if i != 500)


def test_empty(spark, empty):
    assert rules.op6_rules(spark, empty).count() == 0


def test_repeats_near_the_window(spark):
    words = [f"w{i}" for i in range(8)]
    for text in (words, words + words, words + ["x"] + words, words + words[:7], ["a"] * 8, ["a"] * 9, []):
        assert rules.repeated_words([w.encode() for w in text]) == measured(" ".join(text))[4]


def test_clean_documents_of_every_group_are_kept(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(PROSE.split(), 22)), "en", "a", 0) for i in range(150)], DOCS).selectExpr("*", "true AS kept", "5 AS n_words", "1 AS base_failed")
    got = rules.judge(docs)
    assert sorted(got.columns) == sorted({*docs.columns, *rules.COLUMNS} - {"text"})
    assert got.where("kept").count() == 150


def test_sketches_hold_their_error(spark):
    values = sorted(random.Random(1).lognormvariate(0, 1) for _ in range(2000))
    buckets = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("'m' AS measure", f"cast(ceil(ln(x) / ln({rules.GAMMA})) AS int) AS bucket").groupBy("measure", "bucket").count().withColumnRenamed("count", "n")
    got = rules.fences(buckets, []).first()
    assert got["q1"] == pytest.approx(values[500], rel=0.02)
    assert got["q3"] == pytest.approx(values[1499], rel=0.02)
