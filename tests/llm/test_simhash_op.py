"""Fingerprints, keys, links and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from cases import DOCS, ROWS, WORD, lowered

from stratalog.llm import simhash


def fingerprint(text: str | None) -> int:
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(rows: list[tuple[int | None, int]]) -> list[int | None]:
    """Of (doc_id, fingerprint), each row's component, by looking at all pairs."""
    own = list(range(len(rows)))

    def top(i: int) -> int:
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                own[top(i)] = top(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        r = top(i)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return [least[top(i)] for i in range(len(rows))]


def answers(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_edges(spark, edges):
    prints = [(r[0], fingerprint(r[1])) for r in ROWS]
    expected = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, components(prints), strict=True)), key=str)
    assert answers(simhash.op5_simhash(spark, edges)) == expected


def test_near_copies(spark, folder):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((4, 60, 300)))]
        for copy in range(rng.choice((1, 3, 9))):
            text = list(base)
            for _ in range(copy % 4):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(text), "en", f"s{group}", 1))
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    expected = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, components(prints), strict=True)), key=str)
    assert answers(simhash.op5_simhash(spark, folder(documents=(rows, DOCS)))) == expected


def test_empty(spark, empty):
    assert answers(simhash.op5_simhash(spark, empty)) == []


def test_any_pair_at_three_bits_shares_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False).tolist():
            y[i] ^= np.uint64(1 << b)
    for i, (at, to) in enumerate(((0, 22), (22, 43), (43, 64))):  # one bit in each segment, and three in one
        y[i] = x[i] ^ np.uint64(1 << 3 | 1 << 30 | 1 << 50)
        y[i + 3] = x[i + 3] ^ np.uint64(1 << at | 1 << at + 1 | 1 << to - 1)
    a, b = ({(k, r) for k, r in zip(*(v.tolist() for v in simhash.keys_of(z)), strict=True)} for z in (x, y))
    assert {r for _, r in a & b} == set(range(len(x)))


def test_blocks_cover_the_open_bits():
    for row in simhash.free_blocks():
        assert all(not a & b for i, a in enumerate(row) for b in row[:i])
        assert 31 <= sum(m.bit_count() for m in row) <= 43 and sum(row) < 1 << 64


@pytest.mark.parametrize(("seed", "split", "hot"), [(0, 10_000, 10), (1, 10_000, 10), (0, 2, 1_000_000), (1, 4, 10), (1, 1, 1_000_000)])
def test_links_join_what_all_pairs_join(spark, seed, split, hot, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False).tolist():
                prints.add(c ^ 1 << b)
                c ^= int(rng.integers(0, 3) == 0) << b
    rows = sorted(prints)
    got = simhash.components(simhash.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in rows], "print long")))
    roots = {r["u"]: r["v"] for r in got.collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in rows]
    named = components([(i, p) for i, p in enumerate(rows)])
    groups = lambda of: {frozenset(i for i, x in enumerate(of) if x == y) for y in set(of)}
    assert groups([roots.get(p, p) for p in signed]) == groups(named)


def test_a_chain_and_a_star_are_one_component_each(spark):
    chain = [(i, i - 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 40)]
    got = {r["u"]: r["v"] for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 40)} | {100 + i: 100 for i in range(1, 40)}


def test_one_document_of_each_group_stays(spark, edges):
    docs = spark.createDataFrame(ROWS, DOCS).selectExpr("*", "1 AS print", "2 AS component_id")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted({c for c in components([(r[0], fingerprint(r[1])) for r in ROWS]) if c})


def test_null_and_repeated_ids_do_not_cost_a_group_its_document(spark):
    texts = [" ".join(f"{word}{i}" for i in range(40)) for word in ("river", "stone", "cloud", "field", "house")]
    rows = [(None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (None, texts[1], "en", "b", 1), (7, texts[2], "en", "a", 1), (7, texts[3], "en", "a", 1), (8, texts[3], "en", "a", 1), (7, texts[4], "en", "a", 1), (7, texts[4], "en", "a", 1), (6, texts[4], "fr", "a", 1), (None, texts[4], "fr", "a", 1)]
    prints = [fingerprint(t) for t in texts]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(prints) for y in prints[:i])
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (6, texts[4])], key=str)
