"""Quality rules with adaptive thresholds.

Each document's measures are taken over its whole text. Log-bucket quantile sketches
(relative error (GAMMA - 1) / (GAMMA + 1)), whose counts merge by addition, are built
per language and source over all documents that pass the base rules. A group's quartiles
are blended with its language's, and those with the corpus's: n documents of its own weigh
n, what it is blended with PRIOR, so every source's own sketch counts at every size, the
more the larger it is. A document is kept if each measure lies within its group's fences:
REACH quartile ranges, plus a slack, beyond the blended quartiles.

Null text has no words and fails the base rules; null language or source is a group.
Rows that repeat stay. An empty table gives none. A column named like a result is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

GAMMA = 1.02
#: Documents that the wider group counts for in a blend.
PRIOR = 20
REACH = 3.0
#: Of each measure: slack, its part that falls with the root of the words, and whether low values fail too.
MEASURES = {"word_length": (1.0, 12.0, True), "symbols": (0.1, 0.5, False), "dup_lines": (0.2, 0.5, False), "repeats": (0.1, 0.5, False)}
WINDOW = 8
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_mix = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w += h[i : i + n] * _mix[i]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.nonzero(np.isin(w, twice))[0].tolist()
    same = Counter(tuple(words[i : i + WINDOW]) for i in at)  # equal hashes aren't trusted
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if same[tuple(words[i : i + WINDOW])] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly the six ASCII spaces
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """docs without text, with its measures."""
    rest = [f for f in docs.schema.fields if f.name != "text" and f.name not in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column("text").to_pylist()]
            got = np.array(rows, np.int64).reshape(-1, len(COLUMNS))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *(pa.array(got[:, i]) for i in range(len(COLUMNS)))], names=[*(f.name for f in rest), *COLUMNS])

    return docs.select("text", *(f.name for f in rest)).mapInArrow(run, T.StructType([*rest, *(T.StructField(c, T.LongType()) for c in COLUMNS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratio(name: str) -> Column:
    over = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}[name]
    return F.col(over[0]) / F.col(over[1])


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, rows, q1, q3) of counts n by bucket (null: zero values)."""
    every = Window.partitionBy(*by, "measure")
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(every.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumn("upto", upto).withColumn("rows", F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (GAMMA + 1))
    q = [F.min(F.when(F.col("upto") > (F.col("rows") - 1) * F.lit(p), value)).alias(f"q{i}") for i, p in ((1, 0.25), (3, 0.75))]
    return ranked.groupBy(*by, "measure", "rows").agg(*q)


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per language and source: the blended quartiles that hold for it, by measure."""
    bucket = lambda x: F.when(x > 0, F.ceil(F.ln(x) / math.log(GAMMA)).cast("int"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(ratio(m)).alias("bucket")) for m in MEASURES)))
    sketch = stored(rows.where(~base_failed()).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n")), "sketches")
    wide = lambda f, by: f.groupBy(*by).agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}") for m in MEASURES for q in ("q1", "q3")))
    own, lang, all_ = (wide(fences(sketch, by), by) for by in (["lang", "source"], ["lang"], []))
    names = [f"{m}_{q}" for m in MEASURES for q in ("q1", "q3")]
    lang = lang.select(F.col("lang").alias("l"), F.col("rows").alias("l_rows"), F.struct(*names).alias("of_lang"))
    all_ = all_.select(F.struct(*names).alias("of_all"), F.lit(1).alias("one"))
    joined = own.withColumn("one", F.lit(1)).join(lang, F.col("lang").eqNullSafe(F.col("l"))).join(all_, "one")
    blend = lambda q, n, wider: (q * n + wider * F.lit(float(PRIOR))) / (n + F.lit(float(PRIOR)))
    held = F.struct(*(blend(F.col(c), F.col("rows"), blend(F.col("of_lang")[c], F.col("l_rows"), F.col("of_all")[c])).alias(c) for c in names))
    return joined.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), held.alias("__q"))


def judge(docs: DataFrame) -> DataFrame:
    """docs without text, with the measures, base_failed and kept."""
    rows = stored(measured(docs.drop("base_failed", "kept")), "measures")
    judged = rows.join(thresholds(rows), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for m, (slack, falling, both) in MEASURES.items():
        low, high = F.col("__q")[f"{m}_q1"], F.col("__q")[f"{m}_q3"]
        room = (high - low) * F.lit(REACH) + F.lit(slack) + F.lit(falling) / F.sqrt("n_words")
        inside = inside & (ratio(m) <= high + room) & ((ratio(m) >= low - room) if both else F.lit(True))
    kept = F.when(base_failed(), False).otherwise(F.coalesce(inside, F.lit(True)))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("__lang", "__source", "__q")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    ln = repr(math.log(GAMMA))
    ratios = {"word_length": "word_chars / n_words", "symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words"}
    value = f"CASE WHEN bucket IS NULL THEN 0.0::DOUBLE ELSE pow({GAMMA}::DOUBLE, bucket) * 2 / ({GAMMA}::DOUBLE + 1) END"

    def level(name: str, by: str) -> str:
        cols = ", ".join(f"max(q{i}) FILTER (WHERE measure = '{m}') AS {m}_q{i}" for m in MEASURES for i in (1, 3))
        on = f"{by}," if by else ""
        return f"""
{name}_merged AS (SELECT {on} measure, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY {on} measure, bucket),
{name}_ranked AS (SELECT *, sum(n) OVER (PARTITION BY {on} measure ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
    sum(n) OVER (PARTITION BY {on} measure) AS total FROM {name}_merged),
{name}_q AS (SELECT {on} measure, total, min(CASE WHEN upto > (total - 1) * 0.25::DOUBLE THEN {value} END) AS q1,
    min(CASE WHEN upto > (total - 1) * 0.75::DOUBLE THEN {value} END) AS q3 FROM {name}_ranked GROUP BY {on} measure, total),
{name} AS (SELECT {on} max(total) AS total, {cols} FROM {name}_q {f"GROUP BY {by}" if by else ""}),"""

    def blend(q: str, n: str, wider: str) -> str:
        return f"(({q} * {n} + {wider} * {float(PRIOR)}::DOUBLE) / ({n} + {float(PRIOR)}::DOUBLE))"

    def pick(c: str) -> str:
        return blend(f"o.{c}", "o.total", blend(f"l.{c}", "l.total", f"a.{c}"))

    tests = []
    for m, (slack, falling, both) in MEASURES.items():
        x, room = f"({ratios[m]})", f"(({pick(m + '_q3')} - {pick(m + '_q1')}) * {REACH}::DOUBLE + {slack}::DOUBLE + {falling}::DOUBLE / sqrt(n_words))"
        tests.append(f"{x} <= {pick(m + '_q3')} + {room}")
        if both:
            tests.append(f"{x} >= {pick(m + '_q1')} - {room}")
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
wins AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM words WHERE len(w) > 8),
keyed AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i : i + 7], ' ')) AS n FROM wins),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM keyed WHERE n > 1) GROUP BY r),
lines AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY r),
base AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
    FROM docs d JOIN words USING (r) LEFT JOIN dups u USING (r) LEFT JOIN covered c USING (r)),
flagged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM (
    SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / {ln}::DOUBLE)::INT END AS bucket FROM (
    {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {x} AS x FROM flagged WHERE NOT base_failed" for m, x in ratios.items())})) GROUP BY ALL),
{level("own", "lang, source")}{level("bylang", "lang")}{level("corpus", "").rstrip(",")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN base_failed THEN false ELSE coalesce({" AND ".join(tests)}, true) END AS kept
FROM flagged f LEFT JOIN own o ON f.lang IS NOT DISTINCT FROM o.lang AND f.source IS NOT DISTINCT FROM o.source
LEFT JOIN bylang l ON f.lang IS NOT DISTINCT FROM l.lang LEFT JOIN corpus a ON true
"""
