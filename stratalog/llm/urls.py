"""URL filter: rules, and logistic regression on hashed character n-grams, by DataFrame operations only.

The labelled table is small by contract: its gradient descent is one expression over
one row of arrays. Its weights, BUCKETS of them, are the only thing that goes through
the driver. URLs are scored by expressions in the scan, without a shuffle.

A null url, or one without `://`, has empty host and path, fits no rule and is judged
by the intercept alone. Rows that repeat stay, an empty table gives none, and a column
named like a result is replaced. Long urls take time in proportion to their length.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_ascii, let, table
from .url_seed import ROWS

#: (host and path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BUCKETS = 4096
GRAMS = (3, 4)
STEPS, RATE, PENALTY = 100, 8.0, 1e-4


def host_of(url: Column) -> Column:
    return F.coalesce(fold_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of `^host$` and of the path's words."""

    def of(text: Column, mark: str) -> Column:
        def sized(c: Column, n: int) -> Column:
            first = F.sequence(F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(1)))
            return F.transform(first, lambda i: F.concat(F.lit(mark), *(F.coalesce(F.try_element_at(c, i + k), F.lit("")) for k in range(n))))

        return let(F.split(text, ""), lambda c: F.concat(*(sized(c, n) for n in GRAMS)))

    named = F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), "h"), of(F.concat(F.lit("^"), F.lower(path), F.lit("$")), "p"))
    return F.array_distinct(F.transform(named, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int")))


def train(labelled: DataFrame) -> list[float]:
    """Intercept and weights by bucket, from (url, label) with label 1.0 for block."""
    rows = labelled.select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("b"), F.col("label").cast("double").alias("y"))
    one = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("y", "b"))).alias("rows"))
    # for each bucket, the rows that hold it: as small as the labelled table
    entries = one.select(F.explode(F.flatten(F.transform("rows", lambda r, e: F.transform(r["b"], lambda b: F.struct(b.alias("b"), e.alias("e")))))).alias("x"))
    turned = dict(map(tuple, entries.groupBy("x.b").agg(F.sort_array(F.collect_list("x.e")).alias("e")).collect()))
    if not turned:  # no labelled row: no weight
        return [0.0] * (BUCKETS + 1)
    held = F.from_json(F.lit(json.dumps([turned.get(b, []) for b in range(BUCKETS)])), "array<array<int>>")
    whole = one.select(F.transform("rows", lambda r: F.struct(r["y"].alias("y"), r["b"].alias("b"), (1 / F.sqrt(F.size(r["b"]))).alias("v"))).alias("rows"), held.alias("held"))
    state = "named_struct('w0', 0D, 'w', array_repeat(0D, size(held)))"
    z = "s.w0 + r.v * aggregate(r.b, 0D, (a, b) -> a + s.w[b])"
    errors = f"transform(rows, r -> named_struct('e', 1 / (1 + exp(-({z}))) - r.y, 'v', r.v))"
    step = f"""named_struct(
        'w0', s.w0 - {RATE}D / size(g) * aggregate(g, 0D, (a, x) -> a + x.e),
        'w', transform(s.w, (w, b) -> if(size(held[b]) = 0, w, w - {RATE}D * ({PENALTY}D * w + aggregate(held[b], 0D, (a, i) -> a + g[i].e * g[i].v) / size(g)))))"""
    fitted = F.expr(f"aggregate(sequence(1, {STEPS}), {state}, (s, t) -> transform(array({errors}), g -> {step})[0])")
    got = whole.select(fitted.alias("s")).select("s.w0", "s.w").first()
    return [got[0], *got[1]] if got else [0.0] * (BUCKETS + 1)


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT inline(from_json(:rows, 'array<struct<url:string,label:double>>'))", args={"rows": json.dumps([{"url": u, "label": y} for u, y in ROWS])})


def judge(pages: DataFrame, weights: list[float], rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (the method's probability of block)."""
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    z = let(F.struct(w.alias("w"), grams(F.col("host"), F.col("path")).alias("b")), lambda x: F.element_at(x["w"], 1) + F.aggregate(x["b"], F.lit(0.0), lambda a, b: a + F.element_at(x["w"], b + 2)) / F.sqrt(F.size(x["b"])))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, said = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    found = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    found = found.withColumn("rule", rule).withColumn("score", F.when(F.col("host") == "", 1 / (1 + F.exp(F.lit(-weights[0])))).otherwise(1 / (1 + F.exp(-z))))
    return found.withColumn("verdict", F.coalesce(said, F.when(F.col("score") > 0.5, "block").otherwise("allow")))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), train(seed_table(spark))).select("page_id", "host", "path", "rule", "verdict")


def reference_weights() -> list[float]:
    """The same descent in plain Python, for the oracle and the tests."""
    import math
    from hashlib import md5

    def buckets(url: str) -> list[int]:
        rest = url.split("://", 1)[1]
        host, slash, path = rest.partition("/")
        texts = (("h", f"^{host.lower()}$"), ("p", f"^{(slash + path).partition('?')[0].partition('#')[0].lower()}$"))
        return list({int(md5((m + t[i : i + n]).encode()).hexdigest()[:3], 16): 0 for m, t in texts for n in GRAMS for i in range(max(len(t) - n + 1, 1))})

    rows = [(buckets(u), y) for u, y in ROWS]
    w0, w = 0.0, [0.0] * BUCKETS
    used = sorted({b for bs, _ in rows for b in bs})
    for _ in range(STEPS):
        errors = [1 / (1 + math.exp(-(w0 + sum(w[b] for b in bs) / math.sqrt(len(bs))))) - y for bs, y in rows]
        step = dict.fromkeys(used, 0.0)
        for (bs, _), e in zip(rows, errors, strict=True):
            for b in bs:
                step[b] += e / math.sqrt(len(bs))
        w0 -= RATE * sum(errors) / len(rows)
        for b in used:
            w[b] -= RATE * (PENALTY * w[b] + step[b] / len(rows))
    return [w0, *w]


def oracle() -> str:
    weights = ", ".join(f"{x!r}::DOUBLE" for x in reference_weights())
    rules = "\n".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')," for r, v in RULES).rstrip(",")
    return rf"""
WITH w AS (SELECT [{weights}] AS w),
rules(rule, h, p, said) AS (VALUES {rules}),
parts AS (SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
texts AS (SELECT n, 'h' AS m, '^' || host || '$' AS t FROM parts UNION ALL SELECT n, 'p', '^' || lower(path) || '$' FROM parts),
grams AS (SELECT DISTINCT n, ('0x' || md5(m || t[i : i + k - 1])[1:3])::INT AS b
    FROM (SELECT n, m, t, k, unnest(range(1, greatest(length(t) - k + 1, 1) + 1)) AS i FROM texts, (VALUES (3), (4)) ks(k))),
scores AS (SELECT n, (SELECT w[1] FROM w) + sum((SELECT w FROM w)[b + 2]) / sqrt(count(*)) AS z FROM grams GROUP BY n),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM parts, rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN CASE WHEN host = '' THEN (SELECT w[1] FROM w) ELSE z END > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN scores USING (n) LEFT JOIN fits USING (n)
"""
