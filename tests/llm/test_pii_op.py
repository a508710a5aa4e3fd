"""Personal data against the contract's patterns in plain Python, and the terms that disclose it."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
import regex
from cases import DOCS, ROWS

from stratalog.llm import pii

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind: str, value: str) -> bool:
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 9 <= len(number) <= 15


def base(text: str | None) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text or "", re.ASCII) if valid(kind, m[0]))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def compare(found, rows) -> None:
    columns = [f"n_{k}" for k in KINDS]
    got = sorted(((r["doc_id"], *(r[c] for c in columns), r["base_sha256"]) for r in found.collect()), key=str)
    expected = []
    for r in rows:
        spans = base(r[1])
        expected.append((r[0], *(sum(s[1] == k for s in spans) for k in range(4)), digest(spans)))
    assert got == sorted(expected, key=str)


def test_edges(spark, edges):
    compare(pii.op7_pii(spark, edges), ROWS)


def test_empty(spark, empty):
    assert pii.op7_pii(spark, empty).count() == 0


def test_random_texts(spark, folder):
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "-", "+", "1", "255", "256", "0", " ", "(", ")", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "\n", "é", "\U0001f600", "5500-0000-0000-0004", "%", "_", "٣"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))), None, None, None) for i in range(1500)]
    compare(pii.op7_pii(spark, folder(documents=(rows, DOCS))), rows)


def test_many_matches_and_long_runs(spark, folder):
    texts = ["a@b.cd " * 3000, "1.2.3.4 " * 2000, "9" * 60_000, "a" * 60_000, "a@" * 20_000, "+1 " * 20_000, "1." * 30_000, "4111111111111111 " * 1000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    compare(pii.op7_pii(spark, folder(documents=(rows, DOCS))), rows)


def disclosed(texts: list[str | None]) -> list[list[str]]:
    """Of each text its spans, terms included, counted text by text in plain Python."""
    number = lambda v: re.sub("[^0-9]", "", v)

    def looked_at(text: str) -> tuple[list, set, set, set]:
        """(base spans, entities, words outside them, pairs)."""
        spans = [(a, b, k, text[a:b]) for a, k, b in base(text)]
        pieces, at = [], 0
        for a, b, _, _ in spans:
            pieces.append(text[at : max(a, at)])
            at = max(at, b)
        words = [regex.findall(r"\p{L}{3,}+", x.lower()) for x in [*pieces, text[at:]]]
        seen = {w for x in words for w in x}
        everywhere = {f"k{s[2]}" for s in spans} | ({"a"} if spans else set())
        entities, pairs = set(everywhere), {(e, w) for e in everywhere for w in seen}
        for _, _, k, raw in spans:
            value = raw.lower() if k == 0 else raw if k == 1 else number(raw)
            group = (value.rsplit("@", 1)[-1], value.rsplit(".", 1)[0], value[:6], value[:-7])[k]
            mine = {("v", k, value), ("g", k, group)}
            entities |= mine
            pairs |= {(e, w) for e in mine for w in seen}
        return spans, entities, seen, pairs

    found = {t: looked_at(t) for t in {t or "" for t in texts}}
    n_e, n_t, n_et = (Counter(x for f in found.values() for x in f[i]) for i in (1, 2, 3))
    often = {p: n for p, n in n_et.items() if n >= 3}
    gives: dict = {}
    for (e, t), n in often.items():
        p, q = n / n_t[t], n_e[e] / len(found)
        if not q < p:
            continue
        evidence = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
        share = (math.log(p) - math.log(q)) / -math.log(q)
        if share >= 0.8 and n_t[t] * evidence >= math.log(len(often)):
            gives.setdefault(e, set()).add(t)
    out = []
    for t in texts:
        spans, entities, seen, _ = found[t or ""]
        listed = [(a, k, b) for a, b, k, _ in spans]
        told = {w for e in entities for w in gives.get(e, ())} & seen
        for m in regex.finditer(r"\p{L}+", t or ""):
            if m[0].lower() in told and all(m.end() <= a or b <= m.start() for a, b, _, _ in spans):
                listed.append((m.start(), 4, m.end()))
        out.append([f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in sorted(listed)])
    return out


def everyone(spark, path: str, rows: list[tuple]) -> int:
    """The operator's spans are those of plain Python; gives the number of terms."""
    expected = disclosed([r[1] for r in rows])
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.op7_pii(spark, path).collect()), key=str)
    assert got == sorted(((r[0], ",".join(s)) for r, s in zip(rows, expected, strict=True)), key=str)
    return sum(s.startswith("term") for x in expected for s in x)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_terms_against_plain_python(spark, folder, seed):
    rng = random.Random(seed)
    people = [(name, f"{name.lower()}@{house}.example", f"10.{i}.{i}.7", f"+49 30 55500{i}{i}") for i, (name, house) in enumerate([("Zanthrope", "corp"), ("Quillfeather", "corp"), ("Öhlmann", "post"), ("Brisby", "post")])]
    common = [f"{a}{b}" for a in ("ba", "co", "du", "fé", "gi") for b in ("lan", "mer", "nor", "pas")]
    texts: list[str | None] = [None, "", "no mention", "a@b.cd"]
    for _ in range(400):
        words = [rng.choice(common) for _ in range(rng.randrange(1, 25))]
        if rng.random() < 0.25:
            name, *data = rng.choice(people)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice((name, name.upper(), f"({name})")), rng.choice(data), *([rng.choice(data)] if rng.random() < 0.3 else []), *(["token"] if rng.random() < 0.6 else [])]
        if rng.random() < 0.05:
            words.append(rng.choice(people)[0])
        texts.append(" ".join(words))
    texts += rng.choices(texts, k=60)
    rows = [(rng.choice((i, i, i, None)), t, None, None, None) for i, t in enumerate(texts)]
    assert everyone(spark, folder(documents=(rows, DOCS)), rows) > 20


def test_terms_of_the_documents_against_plain_python(spark):
    path = "/root/testdata/sf0.1"
    rows = pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert everyone(spark, path, [(r["doc_id"], r["text"]) for r in rows]) > 100


def test_terms_that_give_an_entity_away(spark, folder):
    """A rare word that keeps coming with one address is found wherever that address's documents use it; common words are not."""
    filler = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun near the old barn all day long"
    rows = [(i, f"{filler} report {i} by Zanthrope mail zan@corp.example now {'abc' * (i + 1)}", "en", "a", 1) for i in range(6)]
    rows[0] = (0, f"{rows[0][1]}. Later Zanthrope spoke", "en", "a", 1)
    rows += [(100 + i, f"{filler} note {i}", "en", "a", 1) for i in range(300)]
    rows += [(900, "Zanthrope without an address", "en", "a", 1)]
    found = {r["doc_id"]: r["spans"] for r in pii.op7_pii(spark, folder(documents=(rows, DOCS))).collect()}
    text = rows[0][1]
    for m in re.finditer("Zanthrope", text):
        assert f"term:{m.start()}:{m.end()}" in found[0].split(",")
    assert not any(f"term:{m.start()}:" in found[0] for m in re.finditer("the ", text))
    assert found[900] == "" and found[100] == ""


def test_terms_far_from_a_mention(spark, folder):
    """A name gives an address away however many words lie between them; personal data as such is too common here to tell."""
    filler = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun near the old barn"
    rows = [(i, f"Zanthrope wrote {filler} {'abc' * (i + 1)} mail kim@rare.example now", "en", "a", 1) for i in range(4)]
    rows += [(100 + i, f"{filler} mail w{i}@h{i}.example now wrote {'abd' * (i + 1)}", "en", "a", 1) for i in range(200)]
    rows += [(500 + i, f"{filler} wrote note mail now {'abe' * (i + 1)}", "en", "a", 1) for i in range(60)]
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.op7_pii(spark, folder(documents=(rows, DOCS))).collect()}
    assert all("term:0:9" in found[i] for i in range(4))
    assert not any(s.startswith("term") for i in range(200) for s in found[100 + i])


def test_many_entities_and_words_in_one_text(spark, folder):
    """Every pair of three long texts is counted: a name at the end belongs to the first address as to the last."""
    mails = [f"u{i}@h{i}.example" for i in range(1500)]
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, " ".join([f"x{letters(j)} {m}" for j, m in enumerate(mails)] + [f"own{letters(i)} Zanthrope"]), "en", "a", 1) for i in range(3)]
    rows += [(10 + i, f"nothing here {letters(i)}", "en", "a", 1) for i in range(3000)]
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.op7_pii(spark, folder(documents=(rows, DOCS))).collect()}
    for i in range(3):
        at = rows[i][1].index("Zanthrope")
        assert f"term:{at}:{at + 9}" in found[i]


@pytest.mark.parametrize("ending", ["", " of issue {i}"])
def test_copies_do_not_hide_terms(spark, folder, ending):
    """One of three contexts comes many times, in copies of a document or as a passage of different ones."""
    filler = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun near the old barn all day long"
    rows = [(i, f"{filler} {word} by Zanthrope mail zan@corp.example now", "en", "a", 1) for i, word in enumerate(("first", "second", "third"))]
    rows += [(100 + i, rows[0][1] + ending.format(i=i), "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, f"{filler} note {i}", "en", "a", 1) for i in range(300)]
    for r in pii.op7_pii(spark, folder(documents=(rows, DOCS))).collect():
        at = rows[0][1].replace("first", {1: "second", 2: "third"}.get(r["doc_id"], "first")).find("Zanthrope")
        assert (f"term:{at}:{at + 9}" in r["spans"].split(",")) == (r["doc_id"] < 1000)


def test_sanitised_texts(spark):
    rows = [(1, "mail a@b.cd, call +49 30 1234567.", "en", "a", 33), (2, None, "en", "a", None), (3, "nothing here", "en", "a", 12), (3, "nothing here", "en", "a", 12)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS spans", "2 AS base")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    texts = sorted((r["doc_id"], r["text"], r["n_chars"], r["spans"]) for r in got.where("text is not null").collect())
    assert texts == [(1, "mail [EMAIL], call [PHONE].", 27, 1), (3, "nothing here", 12, 1), (3, "nothing here", 12, 1)]
    assert got.count() == 4


def test_no_python_on_the_executors(spark, edges):
    plan = pii.op7_pii(spark, edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
