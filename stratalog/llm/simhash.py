"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits in segments of 22, 21 and 21. Two fingerprints at 3 or
fewer differing bits fall, by the pigeonhole principle, into one of two cases:

* a segment is equal and another differs in at most one bit: the equal segment is
  kept as it is, the other decoded with the perfect (23, 12, 7) Golay code to every
  codeword within distance 4 (1 or 6 of them). Words at distance 1 share at least
  one: the codeword nearest to either lies within 3 + 1 of the other.
* each segment has exactly one differing bit: then one half of each segment is
  equal, so one of the 8 choices of halves is a shared key.

That gives some 40 keys a fingerprint, each of 31 to 34 bits. Equal fingerprints
are taken together first. A key of more than SPLIT fingerprints is split: the bits it
doesn't fix lie in four blocks, one of which two linked fingerprints share, so each goes
to four keys that fix a block more and leave at most 24 bits. Rows are sorted by key; each
key's fingerprints are verified, and leave a spanning forest, never all pairs. Components
follow by alternating stars, written to the shared folder at each step.

Null text counts as empty: fingerprint zero, linked like any other. A null doc_id
keeps its row; a component's id is its smallest doc_id that isn't null (null if
none). Repeated rows stay. An empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, released, stored, table

SEED = 42
WORDS = 3
DISTANCE = 3
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12, 7) code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndromes() -> np.ndarray:
    """Of each word of 23 bits below 2^22, the remainder by the generator."""
    unit = [1 << i if i < 11 else 0 for i in range(23)]
    for i in range(11, 23):
        x = unit[i - 1] << 1
        unit[i] = x ^ GENERATOR if x >> 11 else x
    out = np.zeros(1 << 22, np.uint16)
    for i in range(22):
        out[1 << i : 1 << (i + 1)] = out[: 1 << i] ^ np.uint16(unit[i])
    return out


def neighbours(syndrome_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each syndrome, the error patterns of weight 4 or less (6, or the first repeated) and their number."""
    from itertools import combinations

    unit = [int(syndrome_of[1 << i]) if i < 22 else None for i in range(23)]
    x = unit[21] << 1
    unit[22] = x ^ GENERATOR if x >> 11 else x
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            if weight < 4 or len(found[s]) and found[s][0].bit_count() == 3:
                found[s].append(sum(1 << b for b in bits))
    n = np.array([len(x) for x in found], np.int64)
    return np.array([x + [x[0]] * (6 - len(x)) for x in found], np.int64), n


_tables: list[tuple] = []


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of each key of unsigned 64-bit fingerprints."""
    if not _tables:
        s = syndromes()
        _tables.append((s, *neighbours(s)))
    syndrome_of, errors, number = _tables[0]
    parts = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys, each = [], [], np.arange(len(prints))
    for j, x in enumerate(parts):
        s = syndrome_of[x]
        words = (x[:, None] ^ errors[s]) >> 11  # the 12 information bits
        valid = np.arange(6)[None, :] < number[s][:, None]
        row, col = np.nonzero(valid)
        for i, exact in enumerate(parts):
            if i != j:
                keys.append((np.int64(i * 3 + j) << 58) | exact[row] << 12 | words[row, col])
                rows.append(row)
    halves = [(x & 0x7FF, x >> 11) for x in parts]
    for choice in range(8):
        a, b, c = (halves[i][choice >> i & 1] for i in range(3))
        keys.append((np.int64(9) << 58) | np.int64(choice) << 33 | a << 22 | b << 11 | c)
        rows.append(each)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, highest first."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return bytes(8)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    h = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), np.uint8)
    n, ones = len(h) // 8, np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[8 * at : 8 * (at + 8192)]).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, print, also...): the fingerprint as a signed long."""
    rows = docs.select("doc_id", "text", *also)
    more = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist())
            prints = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), prints, *(batch.column(c) for c in more)], names=["doc_id", "print", *more])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]
    return rows.mapInArrow(released(run), ", ".join(["doc_id long", "print long", *kinds]))


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join what is joined among these fingerprints."""
    a, b, rest = [], [], prints
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= DISTANCE
            new, rest = rest[near], rest[~near]
            a.append(new)
            b.append(np.full(len(new), root))
            queue.extend(new)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


#: Fingerprints of one key that are verified together; keys with more are split.
SPLIT = 10_000
#: Split keys that are broadcast, 8 bytes each; more of them are joined by shuffle.
HOT = 1_000_000


def free_blocks() -> list[list[int]]:
    """Four masks over the bits that a key leaves open: of keys with segment 0, 1 or 2 equal, then of each choice of halves."""
    of = lambda low, width: ((1 << width) - 1) << low
    fixed = [of(*segment) for segment in SEGMENTS]
    for choice in range(8):
        fixed.append(sum(of(low + 11, width - 11) if choice >> i & 1 else of(low, 11) for i, (low, width) in enumerate(SEGMENTS)))
    out = []
    for mask in fixed:
        open_bits = [b for b in range(64) if not mask >> b & 1]
        out.append([sum(1 << b for b in open_bits[n * len(open_bits) // 4 : (n + 1) * len(open_bits) // 4]) for n in range(4)])
    return out


def split(keyed: DataFrame) -> DataFrame:
    """(k, print) with each key of more than SPLIT fingerprints replaced by four finer ones a fingerprint."""
    hot = stored(keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("k", F.lit(True).alias("hot")), "simhash-hot")
    number = hot.count()
    if not number:
        return keyed
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*(F.array(*(F.lit(signed(m)).cast("long") for m in row)) for row in free_blocks()))
    kind, choice = F.shiftright("k", 58), F.shiftright("k", 33).bitwiseAND(F.lit(7))
    own = F.get(masks, F.when(kind == 9, choice + 3).otherwise(F.floor(kind / 3)).cast("int"))
    finer = F.transform(own, lambda m, n: F.xxhash64("k", n, F.col("print").bitwiseAND(m)))
    marked = keyed.join(F.broadcast(hot) if number <= HOT else hot, "k", "left")
    return marked.select(F.explode(F.when(F.col("hot"), finer).otherwise(F.array("k"))).alias("k"), "print")


#: Keys with at most so many fingerprints are verified by shifts over the whole batch; larger ones one by one.
SHORT = 8


def links(distinct: DataFrame) -> DataFrame:
    """(u, v), u > v: links among distinct fingerprints whose components are those of all links."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for at in range(0, len(prints), 20_000):
                k, row = keys_of(prints[at : at + 20_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(prints[at : at + 20_000][row])], names=["k", "print"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the key that the last batch ended in

        def runs(k: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
            if len(k) < 2:
                return None
            first = np.concatenate([[0], np.nonzero(np.diff(k))[0] + 1])
            size = np.diff(np.append(first, len(k)))
            of = np.repeat(size, size)
            a, b = [], []
            for shift in range(1, SHORT):
                near = (k[shift:] == k[:-shift]) & (of[shift:] <= SHORT) & (np.bitwise_count(x[shift:] ^ x[:-shift]) <= DISTANCE)
                a.append(x[shift:][near])
                b.append(x[:-shift][near])
            for s, n in zip(first[size > SHORT], size[size > SHORT], strict=True):
                u, v = forest(x[s : s + n])
                a.append(u)
                b.append(v)
            u, v = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1)[u != v], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"]) if len(pairs) else None

        for batch in batches:
            k, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if held and (cut or held[-1][0][0] != k[0]):  # the former key has ended
                out = runs(*(np.concatenate(p) for p in zip(*held, (k[:cut], x[:cut]), strict=True)))
                held = []
            else:
                out = runs(k[:cut], x[:cut])
            if out:
                yield out
            held.append((k[cut:], x[cut:]))
        if held and (out := runs(*(np.concatenate(p) for p in zip(*held, strict=True)))):
            yield out

    keyed = distinct.select("print").mapInArrow(released(make), "k long, print long")
    return split(keyed).repartition("k").sortWithinPartitions("k").mapInArrow(released(verify), "u long, v long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each node but a component's smallest, with that smallest, by alternating large and small stars."""
    edges, before = stored(edges, name), None
    while True:
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
        dropped(last)


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes with root, the smallest fingerprint of their component; they have one row a print."""
    roots = components(links(nodes), "simhash-links").select(F.col("u").alias("print"), F.col("v").alias("root"))
    return nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) of every document."""
    prints = stored(fingerprints(docs), "simhash")
    nodes = rooted(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.select("print", "root").join(named, "root").drop("root"), "print").select("doc_id", "print", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group: the smallest doc_id stays, nulls last, then the smallest text hash, then the smallest hash of all columns."""
    text = F.xxhash64("text")
    prints = stored(fingerprints(docs, text.alias("hash")), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    nodes = rooted(prints.groupBy("print").agg(F.min(first).alias("least")))
    kept = nodes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("root").alias("__root"), F.col("least.doc_id").alias("__id"), F.col("least.hash").alias("__hash"))
    # of a group, only rows that agree in doc_id and text are left here
    left = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text == F.col("__hash")))
    nth = F.row_number().over(Window.partitionBy("__root").orderBy(F.xxhash64(F.struct(*docs.columns).cast("string"))))
    return left.withColumn("__nth", nth).where("__nth = 1").drop("__root", "__id", "__hash", "__nth")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
