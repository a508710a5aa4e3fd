"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's units are bytes, its order 5. It is trained on all documents that are labelled
good and not toxic, but for those whose crc32(doc_id as text) mod 10 is 0, which are held out. Counts, continuation counts,
discounts and back-off weights are DataFrames sharded by n-gram, and the n-grams of the
corpus meet them by joins: documents lie in parts of some PART bytes, each part lists its
distinct n-grams, and their probabilities come back to where the part lies. A document is
kept if its log-perplexity lies within its language's fence: REACH quartile ranges beyond
the upper quartile over all documents, with a slack that falls with its length.

Null and empty texts have no perplexity and aren't kept; a null language is a group. With
no trusted text every byte is equally likely. Rows that repeat stay. An empty table
gives none. A column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, parted, stored, table, text_bytes

#: Ids of trusted documents that are broadcast; more of them are joined by shuffle.
IDS = 1_000_000
ORDER, BITS = 5, 8
REACH, SLACK, FALLING = 3.0, 0.15, 6.0
#: Width of the buckets in which log-perplexities are counted for the quartiles.
STEP = 0.002
#: Bytes of text looked at together, and of a part.
BYTES, PART = 2_000_000, 32_000_000
#: The mark before and after a text; no UTF-8 text has this byte.
MARK = b"\xff"


def blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of stretches of some BYTES; null counts as empty."""
    held, size, at = [], 0, 0
    for i, t in enumerate(pc.fill_null(column.cast(pa.string()), "").cast(pa.binary()).to_pylist()):
        if held and size + len(t) > BYTES:
            yield at, held
            held, size, at = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts, one ending at each byte and at the end, and their number by text."""
    s = np.frombuffer(b"".join(MARK * (ORDER - 1) + t + MARK for t in texts), np.uint8)
    size = np.array([len(t) + ORDER for t in texts])
    grams = np.zeros(len(s) - ORDER + 1, np.int64)
    for i in range(ORDER):
        grams <<= BITS
        grams |= s[i : len(grams) + i]
    inside = np.ones(len(s), bool)
    first = np.cumsum(size) - size
    for i in range(ORDER - 1):
        inside[first + i] = False
    return grams[inside[ORDER - 1 :]], size - (ORDER - 1)


def counted(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                found = pa.array(codes(texts)[0]).dictionary_encode()
                yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.bincount(found.indices))], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(orders: dict[int, DataFrame]) -> dict[int, list[float]]:
    """Of each order, those of grams seen once, twice, and more often; all in one job."""
    few = None
    for k, grams in orders.items():
        own = grams.where("n <= 4").groupBy(F.lit(k).alias("k"), "n").agg(F.count("*").alias("kinds"))
        few = own if few is None else few.unionByName(own)
    kinds, out = {(k, n): m for k, n, m in few.collect()}, {}
    for k in orders:
        n = [0, *(kinds.get((k, i), 0) for i in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
        out[k] = [min(max(d, 0.05 * i), 0.95 * i) for i, d in zip((1, 2, 3), raw, strict=True)]
    return out


def gram(of: int, at: Column | str = "gram") -> Column:
    """The last `of` symbols of a code."""
    return F.col(at).bitwiseAND(F.lit((1 << of * BITS) - 1)) if isinstance(at, str) else at.bitwiseAND(F.lit((1 << of * BITS) - 1))


def probabilities(counts: DataFrame, observed: DataFrame) -> DataFrame:
    """(gram, p) of all observed grams under the model of the counts."""
    orders = {ORDER: stored(counts, "kneser-counts")}
    for k in range(ORDER - 1, 0, -1):  # of how many different symbols each gram follows
        orders[k] = orders[k + 1].groupBy(gram(k).alias("gram")).agg(F.count("*").alias("n"))
    found = observed.select("gram", F.lit(1.0 / (1 << BITS)).alias("p"))
    freed = discounts(orders)
    for k in range(1, ORDER + 1):
        d = freed[k]
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        seen = orders[k].select(F.col("gram").alias("g"), (F.col("n") - less).alias("left"))
        context = orders[k].groupBy(F.shiftright("gram", BITS).alias("h")).agg(F.sum("n").alias("all"), F.sum(less).alias("freed"))
        found = found.join(seen, gram(k) == F.col("g"), "left").join(context, F.shiftright(gram(k), BITS) == F.col("h"), "left")
        mixed = (F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("all")
        found = found.select("gram", F.when(F.col("all").isNull(), F.col("p")).otherwise(mixed).alias("p"))
    return found


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in parts (part, text, rest: a struct of the other columns), and the distinct n-grams of each part (part, gram)."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    rows = docs.select("text", rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seen, kind = TaskContext.get().partitionId() << 32, 0, [], None

        def named(part: int, text: pa.Array, rest: pa.Array, gram: pa.Array, what: int) -> pa.RecordBatch:
            k = len(gram)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, part)), text, rest, gram, pa.array(np.full(k, what, np.int32))], names=["part", "text", "rest", "gram", "kind"])

        def listed() -> Iterator[pa.RecordBatch]:
            grams = pa.chunked_array(seen, pa.int64()).unique().sort()
            for at in range(0, len(grams), 50_000):
                some = grams.slice(at, 50_000)
                yield named(part, pa.nulls(len(some), pa.string()), pa.nulls(len(some), kind), some, 1)

        for batch in batches:
            texts, others = batch.column(0).cast(pa.string()), batch.column(1)
            kind = others.type
            for at, some in blocks(texts):
                seen.append(pa.array(codes(some)[0]).unique())
                if len(seen) > 15:
                    seen[:] = [pa.chunked_array(seen).unique()]
                k = len(some)
                yield named(part, texts.slice(at, k), others.slice(at, k), pa.nulls(k, pa.int64()), 0)
                held += sum(map(len, some))
                if held >= PART:
                    yield from listed()
                    part, held = part + 1, 0
                    seen.clear()
        if seen:
            yield from listed()

    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("text", T.StringType()), rows.schema["rest"], T.StructField("gram", T.LongType()), T.StructField("kind", T.IntegerType())])
    schema["rest"].nullable = True
    made = parted(rows.mapInArrow(run, schema), "kneser", text_bytes(docs) // PART)
    return made.where("kind = 0").select("part", "text", "rest"), made.where("kind = 1").select(F.col("part").alias("of_part"), "gram")


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs without text, with n_symbols (bytes) and log_perplexity (bits a symbol)."""
    texts, grams = encode(docs)
    model = probabilities(counted(trusted), grams.select("gram").distinct())
    entries = grams.join(model, "gram").select("of_part", "gram", (-F.log2("p")).alias("bits"))

    def resolve(docs: pa.Table, own: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"rest": pa.array([], docs.schema.field("rest").type), "n_symbols": pa.array([], pa.int64()), "log_perplexity": pa.array([], pa.float64())})
        known = own.column("gram").to_numpy()
        order = np.argsort(known)
        known, bits = known[order], own.column("bits").to_numpy()[order]
        sums, sizes = [], []
        for _, some in blocks(docs.column("text").combine_chunks()):
            grams, size = codes(some)
            found = pa.array(grams).dictionary_encode()
            own_bits = bits[np.searchsorted(known, found.dictionary.to_numpy())]
            sums.append(np.add.reduceat(own_bits[found.indices.to_numpy()], np.cumsum(size) - size))
            sizes.append(size)
        total, size = np.concatenate(sums), np.concatenate(sizes)
        return pa.table({"rest": docs.column("rest"), "n_symbols": pa.array(size.astype(np.int64) - 1), "log_perplexity": pa.array(total / size, mask=size < 2)})

    schema = T.StructType([texts.schema["rest"], T.StructField("n_symbols", T.LongType()), T.StructField("log_perplexity", T.DoubleType())])
    done = texts.groupBy("part").cogroup(entries.groupBy("of_part")).applyInArrow(resolve, schema)
    return done.select("rest.*", "n_symbols", "log_perplexity")


def fences(rows: DataFrame) -> DataFrame:
    """(__of, __q1, __q3): each language's quartiles of log-perplexity, from counts by bucket."""
    counts = rows.where("log_perplexity is not null").groupBy("lang", F.floor(F.col("log_perplexity") / STEP).alias("bucket")).agg(F.count("*").alias("n"))
    every = Window.partitionBy("lang")
    upto = F.sum("n").over(every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(every))
    q = [F.min(F.when(F.col("upto") > (F.col("all") - 1) * p, (F.col("bucket") + 0.5) * STEP)).alias(f"__q{i}") for i, p in ((1, 0.25), (3, 0.75))]
    return ranked.groupBy(F.col("lang").alias("__of")).agg(*q)


def held_out() -> Column:
    return crc_remainder(F.col("doc_id"), 10) == 0


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").where(~held_out()).select("doc_id").distinct()
    return docs.select("doc_id", "text").join(F.broadcast(good) if good.count() <= IDS else good, "doc_id", "left_semi")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without text, with n_symbols, log_perplexity, threshold and kept."""
    docs = docs.drop("n_symbols", "log_perplexity", "threshold", "kept")
    rows = stored(perplexities(docs, trusted(docs, labels)), "kneser")
    room = (F.col("__q3") - F.col("__q1")) * REACH + SLACK + FALLING / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    judged = rows.join(fences(rows), F.col("lang").eqNullSafe(F.col("__of")), "left").withColumn("threshold", F.col("__q3") + room)
    return judged.withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(False))).drop("__of", "__q1", "__q3")


def op9_kneser(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_symbols", "log_perplexity", "threshold", "kept")
