"""Language-model scoring with a hidden Markov model of words.

Words have classes: each of the OWN most frequent ones its own, the others one of
HASHED by their ending, the end of a text one more. States emit classes; a word's
share of its class comes from the counts of all training documents. So the states'
parameters are bounded, while the counts of words grow with the corpus: they are
summed and sent back by joins sharded by word. Documents are held in parts of some
PART tokens, each with a dictionary of its own, so only distinct words of a part are
joined, and a part is scored in one task, where it lies.

Baum-Welch: every round goes over all training documents, each as one sequence;
expected counts are summed by class across tasks. The score is the scaled forward
recursion over the whole text. Both are exact for this model of classes. Long texts
are cut into segments that are computed together: the product of the transfer matrices
before a segment gives the state it starts in, and that after it what its end is worth,
so the cuts change no count and no likelihood.

Null text counts as empty: its one token is the end. A null doc_id counts as empty
text in the held-out rule. Rows that repeat stay. With no training row each token has
probability 1 by the base formula, and score equals base_score. An empty table gives
none. Further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, parted, stored, table, text_bytes

STATES, ROUNDS = 8, 5
OWN, HASHED = 2048, 2048
END = OWN + HASHED
CLASSES = END + 1
SMOOTH = 0.1
PART = 2_000_000
#: Tokens of a segment of a long text, and of all segments computed together.
SEGMENT, TOGETHER = 256, 400_000
#: Texts of more tokens are cut when training and when scoring.
WHOLE, LONG = 1024, 4096


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text, held_out): documents (part, doc_id, held_out, ids) and dictionaries (part, word, local, n).

    ids: little-endian signed 32-bit places in the part's dictionary, and -1 for the end; n: occurrences in training documents.
    """
    names = ["kind", "part", "doc_id", "held_out", "ids", "word", "local", "n"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, learnt, held = TaskContext.get().partitionId() << 32, defaultdict(), [], 0
        own.default_factory = own.__len__

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(own)
            n = np.bincount(np.concatenate(learnt) if learnt else np.empty(0, np.int64), minlength=len(words))
            for a in range(0, len(words), 50_000):
                some = words[a : a + 50_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1] * k, pa.int32()), pa.array([part] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(range(a, a + k), pa.int32()), pa.array(n[a : a + k], pa.int64())],
                    schema=schema,
                )

        for batch in batches:
            rows: list[tuple] = []
            for doc, text, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.array(list(map(own.__getitem__, (text or b"").lower().split())), np.int32)
                if not out:
                    learnt.append(ids)
                rows.append((doc, out, np.append(ids, np.int32(-1)).astype("<i4").tobytes()))
                held += len(ids) + 1
                if held >= PART:
                    yield documents(part, rows)
                    yield from dictionary()
                    part, held, rows = part + 1, 0, []
                    own.clear()
                    learnt.clear()
            if rows:
                yield documents(part, rows)
        yield from dictionary()

    def documents(part: int, rows: list[tuple]) -> pa.RecordBatch:
        k = len(rows)
        doc, out, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array([part] * k, pa.int64()), pa.array(doc, pa.int64()), pa.array(out, pa.bool_()), pa.array(ids, pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], schema=schema)

    made = docs.select("doc_id", "text", "held_out").mapInArrow(run, "kind int, part long, doc_id long, held_out boolean, ids binary, word string, local int, n long")
    rows = parted(made, "hmm", text_bytes(docs) // (4 * PART))
    return rows.where("kind = 0").select("part", "doc_id", "held_out", "ids"), rows.where("kind = 1").select(F.col("part").alias("of_part"), "word", "local", "n")


def classed(docs: DataFrame) -> tuple[DataFrame, dict]:
    """Documents (doc_id, held_out, n_tokens, n_known, base_score, word_score, classes), and the corpus's totals."""
    texts, words = encode(docs)
    lexicon = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "hmm-lexicon")
    n_docs = texts.where("not held_out").count()
    known, total = lexicon.where("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = total + n_docs, known + (n_docs > 0)
    top = lexicon.where("c > 0").orderBy(F.col("c").desc(), "word").limit(OWN).collect()
    spark = docs.sparkSession
    own = spark.createDataFrame([(r["word"], i) for i, r in enumerate(top)], "word string, own int")  # OWN rows at most
    hashed = F.lit(OWN) + F.pmod(F.xxhash64(F.expr("right(word, 2)")), F.lit(HASHED)).cast("int")
    named = lexicon.join(F.broadcast(own), "word", "left").withColumn("class", F.coalesce("own", hashed))
    sizes = named.groupBy("class").agg(F.sum("c").alias("in_class"), F.count_if(F.col("c") > 0).alias("kinds")).collect()  # CLASSES rows at most
    table_ = spark.createDataFrame([tuple(r) for r in sizes], "class int, in_class long, kinds long")
    share = F.when(F.col("own").isNotNull(), 0.0).otherwise(F.log10((F.col("c") + SMOOTH) / (F.col("in_class") + SMOOTH * (F.col("kinds") + 1))))
    named = named.join(F.broadcast(table_), "class").select("word", "c", "class", share.alias("share"))
    entries = words.select("of_part", "local", "word").join(named, "word").drop("word")
    frequency = np.zeros(CLASSES)
    for c, count, _ in sizes:
        frequency[c] = count
    frequency[END] = n_docs
    floor = n + SMOOTH * (v + 1)

    def resolve(docs: pa.Table, own: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in out.items()})
        at, k = own.column("local").to_numpy(), own.num_rows
        c, cls, share = np.zeros(k + 1), np.zeros(k + 1, np.int64), np.zeros(k + 1)
        c[at], cls[at], share[at] = own.column("c").to_numpy(), own.column("class").to_numpy(), own.column("share").to_numpy()
        c[-1], cls[-1] = n_docs, END
        base = np.log10((c + SMOOTH) / floor)
        raw = docs.column("ids").to_pylist()
        ids, size = np.frombuffer(b"".join(raw), "<i4"), np.array([len(x) // 4 for x in raw])
        first = np.cumsum(size) - size
        of = cls[ids].astype("<u2").tobytes()
        got = {
            "doc_id": docs.column("doc_id").cast(pa.int64()), "held_out": docs.column("held_out"), "n_tokens": pa.array(size),
            "n_known": pa.array(np.add.reduceat((c > 0)[ids].astype(np.int64), first)), "base_score": pa.array(np.add.reduceat(base[ids], first)),
            "word_score": pa.array(np.add.reduceat(share[ids], first)), "classes": pa.array([of[2 * a : 2 * (a + k)] for a, k in zip(first.tolist(), size.tolist(), strict=True)], pa.binary()),
        }
        return pa.table(got)

    out = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "word_score": pa.float64(), "classes": pa.binary()}
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, classes binary"
    done = texts.groupBy("part").cogroup(entries.groupBy("of_part")).applyInArrow(resolve, schema)
    return stored(done, "hmm-classes"), {"n": n, "v": v, "frequency": frequency}


def start(frequency: np.ndarray) -> dict:
    """Class frequencies, each state's disturbed by chance; states tend to stay."""
    random = np.random.default_rng(7)
    b = (frequency[:, None] + SMOOTH) * np.exp(random.normal(size=(CLASSES, STATES)))
    a = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(a, 0.9)
    return {"pi": np.full(STATES, 1 / STATES), "a": a, "b": b / b.sum(0)}


def transfers(parts: list[np.ndarray], first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, the product of its steps' matrices, scaled, and log10 of the scale; a first one has no step before its first token.

    Segments lie innermost, so that each step is one product and a few passes over whole rows.
    """
    n, size = len(parts), np.array([len(x) for x in parts])
    order = np.argsort(-size, kind="stable")  # those longer than t come first
    cls = np.zeros((size.max(), n), np.int64)
    for i, k in enumerate(order):
        cls[: size[k], i] = parts[k]
    longer = np.searchsorted(-size[order], -np.arange(len(cls)), "left")
    begins, to = first[order], np.ascontiguousarray(a.T)
    m, logs = np.zeros((STATES, STATES, n), a.dtype), np.zeros(n)  # state after, state before, segment
    m[range(STATES), range(STATES)] = 1
    for t, k in enumerate(longer):
        moved = (to @ m[:, :, :k].reshape(STATES, -1)).reshape(STATES, STATES, k)
        if t == 0:
            moved[:, :, begins] = m[:, :, begins]
        moved *= np.ascontiguousarray(b.take(cls[t, :k], 0).T)[:, None]
        s = moved.sum((0, 1))
        moved /= s
        m[:, :, :k] = moved
        logs[:k] += np.log10(s)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return np.ascontiguousarray(m[:, :, back].transpose(2, 1, 0)), logs[back]


def cut(seqs: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(segments, sequence of each, whether it is a first one) of stretches of some TOGETHER tokens; a sequence may go on in the next."""
    parts: list[np.ndarray] = []
    of: list[int] = []
    first: list[bool] = []
    for i, x in enumerate(seqs):
        for at in range(0, len(x), SEGMENT):
            parts.append(x[at : at + SEGMENT])
            of.append(i)
            first.append(at == 0)
            if len(parts) * SEGMENT >= TOGETHER:
                yield parts, np.array(of), np.array(first)
                parts, of, first = [], [], []
    if parts:
        yield parts, np.array(of), np.array(first)


#: A piece to count: its classes, whether it begins a text, the states before it and what its end is worth.
Piece = tuple[np.ndarray, bool, np.ndarray, np.ndarray]


def pieces(docs: list[bytes], model: dict) -> list[Piece]:
    """The texts, long ones in segments with the states before them and the worth of what follows."""
    one, pi = np.ones(STATES), model["pi"]
    seqs = [np.frombuffer(raw, "<u2") for raw in docs]
    out: list[Piece] = [(x, True, pi, one) for x in seqs if len(x) <= WHOLE]
    long = [x for x in seqs if len(x) > WHOLE]
    made: list[tuple[np.ndarray, int, bool, np.ndarray]] = []
    for parts, of, first in cut(long):
        m, _ = transfers(parts, first, model["a"].astype(np.float32), model["b"].astype(np.float32))
        made += zip(parts, of.tolist(), first.tolist(), m.astype(np.float64), strict=True)
    before, state = [], pi
    for _, _, first, m in made:
        state = pi if first else state
        before.append(state)
        state = state @ m
        state = state / state.sum()
    worth, after = one, [one] * len(made)
    for i in range(len(made) - 1, 0, -1):
        worth = one if made[i][2] else made[i][3] @ worth
        after[i - 1] = worth = worth / worth.sum()
    out += [(x, first, s, w) for (x, _, first, _), s, w in zip(made, before, after, strict=True)]
    return sorted(out, key=lambda s: len(s[0]))


def together(parts: list[Piece]) -> Iterator[list[Piece]]:
    """Stretches of pieces sorted by length, padded at most TOGETHER tokens."""
    at = 0
    while at < len(parts):
        n = 1
        while at + n < len(parts) and len(parts[at + n][0]) * (n + 1) <= TOGETHER:
            n += 1
        yield parts[at : at + n]
        at += n


def expected(parts: list[Piece], model: dict) -> np.ndarray:
    """Expected counts of (class, state), then of transitions, then of first states; pieces come by length, the shortest first."""
    a, b = model["a"].astype(np.float32), model["b"].astype(np.float32)
    to, n, size = np.ascontiguousarray(a.T), len(parts), np.array([len(p[0]) for p in parts])
    steps = size[-1]
    cls = np.zeros((steps, n), np.int64)
    for i, p in enumerate(parts):
        cls[: size[i], i] = p[0]
    begins = np.array([p[1] for p in parts])
    before, after = (np.array([p[i] for p in parts], np.float32).T for i in (2, 3))
    ended = np.searchsorted(size, np.arange(steps + 1), "right")  # pieces of t tokens or fewer
    alpha, scale = np.zeros((steps, STATES, n), np.float32), np.empty((steps, n), np.float32)
    for t in range(steps):
        k = ended[t]
        x = to @ alpha[t - 1][:, k:] if t else np.where(begins, before, to @ before)
        x *= b.take(cls[t, k:], 0).T
        scale[t, k:] = x.sum(0)
        np.divide(x, scale[t, k:], out=alpha[t][:, k:])
    moves, beta = np.zeros((STATES, STATES)), np.empty((STATES, n), np.float32)
    for t in range(steps - 1, -1, -1):
        k, last = ended[t], slice(ended[t], ended[t + 1])
        beta[:, last] = after[:, last] / (alpha[t][:, last] * after[:, last]).sum(0)
        w = beta[:, k:] / scale[t, k:]
        w *= b.take(cls[t, k:], 0).T
        moves += alpha[t - 1][:, k:] @ w.T if t else before[:, ~begins] @ w[:, ~begins].T
        alpha[t][:, k:] *= beta[:, k:]
        beta[:, k:] = a @ w
    counts = np.zeros((CLASSES + STATES + 1, STATES))
    flat = cls.ravel()  # where a piece has ended alpha is zero
    for s in range(STATES):
        counts[:CLASSES, s] = np.bincount(flat, weights=alpha[:, s].ravel(), minlength=CLASSES)
    counts[CLASSES:-1] = moves * a
    counts[-1] = alpha[0][:, begins].sum(1)
    return counts


def train(docs: DataFrame, frequency: np.ndarray) -> dict:
    """Baum-Welch over all training documents; each round sends CLASSES rows to the driver."""
    model, columns = start(frequency), [f"v{s}" for s in range(STATES)]
    rows = docs.where("not held_out").select("classes")
    for _ in range(ROUNDS):
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((CLASSES + STATES + 1, STATES))
            for batch in batches:
                for parts in together(pieces(batch.column(0).to_pylist(), held.value)):
                    counts += expected(parts, held.value)
            at = np.nonzero(counts.sum(1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(counts[at, s]) for s in range(STATES))], names=["k", *columns])

        summed = rows.mapInArrow(run, ", ".join(["k long", *(f"{c} double" for c in columns)])).groupBy("k").agg(*(F.sum(c).alias(c) for c in columns))
        counts = np.zeros((CLASSES + STATES + 1, STATES))
        for k, *v in summed.collect():
            counts[k] = v
        whole = counts[:CLASSES].sum(1, keepdims=True)
        b = counts[:CLASSES] + (whole + SMOOTH) * 10 / max(whole.sum(), 1)  # a little of the corpus in each state
        a, pi = counts[CLASSES:-1] + SMOOTH, counts[-1] + SMOOTH
        model = {"b": b / b.sum(0), "a": a / a.sum(1, keepdims=True), "pi": pi / pi.sum()}
    return model


def forward(docs: list[bytes], model: dict) -> np.ndarray:
    """log10 of each sequence's likelihood, by the scaled forward recursion."""
    a, b, pi = np.ascontiguousarray(model["a"].T), model["b"], model["pi"]
    seqs = [np.frombuffer(x, "<u2") for x in docs]
    out = np.zeros(len(seqs))
    order, at = sorted((i for i, x in enumerate(seqs) if len(x) <= LONG), key=lambda i: -len(seqs[i])), 0
    while at < len(order):
        some = order[at : at + max(1, TOGETHER // max(len(seqs[order[at]]), 1))]
        at += len(some)
        size = np.array([len(seqs[i]) for i in some])
        cls = np.zeros((size[0], len(some)), np.int64)
        for column, i in enumerate(some):
            cls[: size[column], column] = seqs[i]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
        scales = np.ones((size[0], len(some)))
        for t, k in enumerate(active):
            x = a @ x[:, :k] if t else np.repeat(pi[:, None], k, 1)
            x *= b.take(cls[t, :k], 0).T
            s = x.sum(0)
            scales[t, :k] = s
            x /= s
        out[some] = np.log10(scales).sum(0)
    long = [i for i, x in enumerate(seqs) if len(x) > LONG]
    out[long] = long_forward([seqs[i] for i in long], model)
    return out


def long_forward(seqs: list[np.ndarray], model: dict) -> np.ndarray:
    """log10 of each long sequence's likelihood, by its segments' transfer matrices."""
    out, state = np.zeros(len(seqs)), model["pi"]
    for parts, of, first in cut(seqs):
        m, logs = transfers(parts, first, model["a"], model["b"])
        for k, i in enumerate(of.tolist()):
            state = (model["pi"] if first[k] else state) @ m[k]
            s = state.sum()
            state = state / s
            out[i] += logs[k] + np.log10(s)
    return out


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text, held_out)."""
    rows, totals = classed(docs)
    model = train(rows, totals["frequency"]) if totals["n"] else None
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word_score").to_numpy()
            got = forward(batch.column("classes").to_pylist(), held.value) + own if held.value else batch.column("base_score").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(got)], names=[*batch.schema.names[:-2], "score"])

    found = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (crc_remainder(F.col("doc_id"), 10) == 0).alias("held_out")))
