"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte 2- and 3-grams (lower-cased,
other ASCII characters than letters as spaces). Document frequencies come from all
training rows. Each language's vectors, of at most SAMPLE training rows chosen by
hash, are clustered by spherical k-means to CLUSTERS centroids; a fifth of the sample is kept
apart. A text takes the language of its nearest centroid by cosine. It is rejected if it is
farther than the limit of its language for a text of its length, counted in distinct
n-grams by powers of two: MARGIN times the smallest cosine that pieces of that length of the
kept-apart texts reach. So what is as near as anything that the language was seen to hold
stays, a text that is half in another language too (its cosine falls by about the root of
two), and only what is clearly farther goes. Where no piece has that length, the limit of
the next shorter ones holds.

Null texts and texts without a letter are `und`, score 0, rejected. With no training
row every text is. Null doc_id counts as empty text in the held-out rule. Rows that
repeat stay. An empty table gives none. A column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, dropped, released, stored, table

#: Dimensions of 2-grams and of 3-grams.
DIMS = (4096, 8192)
SIZE = sum(DIMS)
#: Training rows a language that its clusters are fitted on; the k-means holds them in one task.
SAMPLE = 800
CLUSTERS = 4
ROUNDS = 12
#: Words of the pieces that set the limits (besides whole texts), and what a limit is of the least cosine seen.
PIECES, MARGIN = (1, 2, 4, 8, 16, 32, 64, 128), 0.7
#: One of so many sampled rows is kept apart for the limits.
APART = 5
#: Powers of two of a text's distinct n-grams.
LENGTHS = 16
#: Rows and bytes of text made into vectors at once.
ROWS, BYTES = 64, 4_000_000
#: Bytes whose n-grams are counted at once: of a very long text only its bytes are held whole, not a code for each n-gram.
STRETCH = 500_000
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size, at, held = pc.binary_length(texts).to_pylist(), 0, 0
    for i, n in enumerate(size):
        if i > at and (i - at >= ROWS or held + n > BYTES):
            yield at, i
            at, held = i, 0
        held += n
    if len(size) > at:
        yield at, len(size)


def counts(texts: pa.Array) -> np.ndarray:
    """n-gram counts, a row a text (none null)."""
    n = len(texts)
    spaced = pc.binary_join_element_wise("", pc.utf8_lower(texts), "", " ")
    size = pc.binary_length(spaced).to_numpy().astype(np.int64)
    raw = LETTERS[np.frombuffer(b"".join(spaced.cast(pa.binary()).to_pylist()), np.uint8)]
    ends, out = np.cumsum(size), np.zeros(n * SIZE)
    for at in range(0, len(raw), STRETCH):  # n-grams that start in this stretch
        piece = raw[at : at + STRETCH + 2].astype(np.int64)
        doc = np.searchsorted(ends, np.arange(at, at + len(piece)), "right")
        two = piece[:-1] << 8 | piece[1:]
        three = two[:-1] << 8 | piece[2:]
        for gram, ahead, low, dims in ((two, 1, 0, DIMS[0]), (three, 2, DIMS[0], DIMS[1])):
            m = min(len(gram), STRETCH)
            same = doc[ahead : ahead + m] == doc[:m]
            bucket = (gram[:m] * 2654435761 >> 15) % dims + low
            out += np.bincount((doc[:m] * SIZE + bucket)[same], minlength=len(out))
    return out.reshape(n, SIZE)


def vectors(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the power of two of each text's distinct n-grams."""
    n = counts(texts)
    x = (np.log1p(n) * idf).astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None], np.minimum(np.log2(np.maximum((n > 0).sum(1), 1)).astype(np.int64), LENGTHS - 1)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\pL").to_numpy(zero_copy_only=False)


def clustered(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids, and each row's."""
    picks, random = [0], np.random.default_rng(0)
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):  # far rows are likelier
        far = np.maximum(1 - near, 1e-9) ** 2
        picks.append(int(random.choice(len(x), p=far / far.sum())))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].mean(0)
                c[j] = mean / (np.linalg.norm(mean) or 1)
    return c, (x @ c.T).argmax(1)


def train(docs: DataFrame) -> dict:
    """Of (doc_id, text, lang) rows: idf, languages, centroids (a column each), limits."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.string())
            for a, b in blocks(texts):
                df[:SIZE] += (counts(texts.slice(a, b - a)) > 0).sum(0)
            df[SIZE] += len(texts)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    df = np.zeros(SIZE + 1, np.int64)
    for bucket, n in rows.select("text").mapInArrow(released(frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        df[bucket] = n
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 0.1

    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {"idf": idf, "langs": [], "centroids": np.zeros((SIZE, 0), np.float32), "limits": np.zeros((0, LENGTHS))}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * SAMPLE / n))))
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.withColumn("chance", chance).where(F.col("chance") < F.element_at(share, F.col("lang")))

    first = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id"))
    some = some.withColumn("nth", first).where(F.col("nth") <= SAMPLE).select("lang", "text", "nth")
    some = stored(some.withColumn("apart", F.col("nth") % APART == 0), "langid-sample")
    found = centroids(some, idf)
    limits = limited(some, idf, found)
    dropped(some)
    langs = [lang for lang in sorted(found) for _ in found[lang]]
    m = np.concatenate([np.zeros((0, SIZE), np.float32), *(found[lang] for lang in sorted(found))])
    return {"idf": idf, "langs": langs, "centroids": np.ascontiguousarray(m.T), "limits": np.array([limits[lang] for lang in langs]).reshape(-1, LENGTHS)}


def centroids(some: DataFrame, idf: np.ndarray) -> dict[str, np.ndarray]:
    """Of each language of (lang, text, nth, apart), the unit centroids of its rows not kept apart, or of all if there are no others."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors where the rows lie, so that long texts don't meet in one task."""
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            real = has_letter(texts)
            for a, b in blocks(texts):
                keep = pa.array(real[a:b])
                x, _ = vectors(texts.slice(a, b - a), idf)
                rest = (batch.column(c).slice(a, b - a).filter(keep) for c in ("lang", "nth", "apart"))
                yield pa.RecordBatch.from_arrays([*rest, pa.array([v.tobytes() for v in x[real[a:b]]], pa.binary())], names=["lang", "nth", "apart", "x"])

    def fit(group: pa.Table) -> pa.Table:
        apart = group.column("apart").to_numpy()
        chosen = np.arange(len(apart)) if apart.all() else np.nonzero(~apart)[0]
        chosen = chosen[np.argsort(group.column("nth").to_numpy()[chosen], kind="stable")]
        x, column = np.empty((len(chosen), SIZE), np.float32), group.column("x")
        for i, k in enumerate(chosen.tolist()):
            x[i] = np.frombuffer(column[k].as_buffer(), np.float32)
        c, _ = clustered(x, CLUSTERS)
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(c), pa.string()), "cluster": pa.array(range(len(c)), pa.int32()), "centroid": pa.array([v.tobytes() for v in c], pa.binary())})

    made = some.mapInArrow(released(sampled), "lang string, nth int, apart boolean, x binary").groupBy("lang").applyInArrow(fit, "lang string, cluster int, centroid binary")
    found: dict[str, list[np.ndarray]] = {}
    for lang, _, c in sorted(map(tuple, made.collect()), key=lambda row: row[:2]):  # CLUSTERS rows a language
        found.setdefault(lang, []).append(np.frombuffer(c, np.float32))
    return {lang: np.array(c) for lang, c in found.items()}


def limited(some: DataFrame, idf: np.ndarray, found: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """Of each language the limits by length: MARGIN times the least cosine of its kept-apart texts and their pieces."""
    held = some.sparkSession.sparkContext.broadcast(found)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not has_letter(pa.array([text]))[0]:
                    continue
                words = text.split(None, PIECES[-1])
                x, length = vectors(pa.array([text, *(" ".join(words[:k]) for k in PIECES if k <= len(words))]), idf)
                near = (x @ held.value[lang].T).max(1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(length, pa.int32()), pa.array(near, pa.float64())], names=["lang", "length", "near"])

    least = some.where("apart").select("lang", "text").mapInArrow(released(measured), "lang string, length int, near double").groupBy("lang", "length").agg(F.min("near"))
    seen = {(lang, length): near for lang, length, near in least.collect()}  # LENGTHS rows a language
    out: dict[str, list[float]] = {}
    for lang in found:
        last = 0.0
        for i in range(LENGTHS):
            last = MARGIN * seen[lang, i] if (lang, i) in seen else last
            out.setdefault(lang, []).append(last)
    return out


def identify(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the predicted language, its cosine (0 to 1) and whether it is rejected."""
    docs = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats a centroid, CLUSTERS centroids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            real = has_letter(texts)
            for a, b in blocks(texts):  # a block's rows go out at once, so that no second batch of texts is held
                got = [("und", 0.0, True)] * (b - a)
                if m["langs"]:
                    x, length = vectors(texts.slice(a, b - a), m["idf"])
                    near = x @ m["centroids"]
                    best = near.argmax(1)
                    top = np.clip(near[np.arange(len(best)), best], 0, 1)
                    out = top < m["limits"][best, length]
                    got = [(m["langs"][j], s, o) if ok else no for j, s, o, ok, no in zip(best, top.tolist(), out.tolist(), real[a:b], got, strict=True)]
                cols = [pa.array(c, kind) for c, kind in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *cols], names=[*batch.schema.names, *names])

    more = [T.StructField(*x) for x in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, *more]))


def held_out() -> Column:
    return crc_remainder(F.col("doc_id"), 4) == 2


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected or hold no letter; columns as they came."""
    found = identify(docs, train(docs.where(~held_out())), ("__lang", "__score", "__rejected"))
    return found.where("not __rejected").select(*docs.columns)
