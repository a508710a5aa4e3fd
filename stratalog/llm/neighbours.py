"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors are scaled by the largest norm and lifted to the unit sphere by one more
component, where the nearest by distance are the largest by inner product. Centroids
come from balanced k-means, in two levels where there are many, on a bounded sample, one
for each LIST vectors of the table; every vector is indexed: in the list of
its nearest centroid and, near a boundary, in further ones (up to REPLICAS, none closer
to a chosen centroid than to the vector). Centroids are searched by best-first
search on a neighbour graph held in memory. A query reads those of the lists found whose
centroids are within a ratio of its nearest one's distance. The ratio is the smallest that
reaches RECALL by this same search for ASKED rows of the sample, whose nearest are found
outright among all vectors; where none does, the search is widened, to all lists if need be.
What a worker sends or holds at once is bounded however many lists a query reads. The graph lies in memory, so centroids are bounded by LISTS: beyond
LIST * LISTS vectors lists grow longer instead. Lists and their queries are cut into blocks of bounded size,
which meet by a join on list and block, whatever a list's length.

Equal vectors are indexed once, with their smallest ids. Scores are recomputed in double
precision on the vectors as given, summed in one fixed order, so ties are exact.

No part take: null ids, vectors null, zero, or with null or non-finite components.
Vectors of different lengths have no inner product: each length is searched by itself.
Rows with equal id and vector count once. An empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 20
#: Vectors and bytes (8 a component) that the centroids are fitted on: SAMPLE, or SPREAD a list where that is more.
SAMPLE, SPREAD, SAMPLE_BYTES = 20_000, 4, 134_000_000
#: Vectors a list, about; lists at most; lists up to which one level of k-means is enough.
LIST, LISTS, FLAT = 128, 65_536, 1024
#: Centroids linked to each centroid, and followed in a search.
LINKS, BEAM = 24, 48
REPLICAS, BOUNDARY = 4, 1.15
RECALL, RATIOS = 0.95, [1.0 + 0.01 * i for i in range(1, 201)]
#: Vectors and queries of a block.
BLOCK = 4096
#: Rows of the sample that the ratio is fitted on.
ASKED = 400
#: Cells of the tables that a search keeps of rows by centroids, and of a table of scores.
CELLS, SCORES = 1 << 22, 1 << 23
#: Bytes (8 a component) of query vectors that are sent out together.
SENT = 8_000_000
#: Answers of lists to a query that are gathered at once, about.
GATHERED = 64


def step(lists: int) -> int:
    """Rows searched together."""
    return max(16, min(2048, CELLS // max(lists, 1)))


def valid(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """(vec_id, v) of the vectors that take part, and their lengths."""
    sized = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null")
    if "array<float>" not in dict(sized.dtypes)["v"]:
        sized = sized.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    taking = sized.where(fine)
    return taking, sorted(r[0] for r in taking.select(F.size("v")).distinct().collect())  # one row a length


def lift(v: np.ndarray, largest: float) -> np.ndarray:
    x = v.astype(np.float64) / largest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], 1).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def balanced(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids; in each round a centroid with many vectors counts as farther."""
    random = np.random.default_rng(0)
    c, load = x[random.choice(len(x), k, replace=False)].copy(), np.zeros(k, np.float32)
    for _ in range(12):
        own = np.concatenate([(x[i : i + 4096] @ c.T - 0.05 * load).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        empty = n == 0
        sums[empty] = x[random.choice(len(x), int(empty.sum()))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = sums / np.where(norm > 0, norm, 1)
        load = (0.5 * load + 0.5 * np.maximum(n / (len(x) / k) - 1, 0)).astype(np.float32)
    return c.astype(np.float32)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids: outright, or within the clusters of a coarser level, each with its share."""
    if k <= FLAT:
        return balanced(x, k)
    coarse = balanced(x, int(np.ceil(np.sqrt(k))))
    own = np.concatenate([(x[i : i + 4096] @ coarse.T).argmax(1) for i in range(0, len(x), 4096)])
    ends = np.round(np.cumsum(np.bincount(own, minlength=len(coarse))) * (k / len(x))).astype(int)
    return np.concatenate([balanced(x[own == j], min(n, int((own == j).sum()))) for j, n in enumerate(np.diff(ends, prepend=0)) if n])


def graph(c: np.ndarray) -> np.ndarray:
    """Of each centroid, its nearest ones and a few random ones."""
    random, n = np.random.default_rng(1), len(c)
    near = min(LINKS - 4, n - 1)
    if near < 1:
        return np.zeros((n, 1), np.int64)
    found = []
    for at in range(0, n, rows := max(1, SCORES // n)):
        d = c[at : at + rows] @ c.T
        d[np.arange(len(d)), at + np.arange(len(d))] = -9
        found.append(np.argpartition(-d, near - 1, axis=1)[:, :near])
    return np.concatenate([np.concatenate(found), random.integers(0, n, (n, 4))], 1)


def walk(x: np.ndarray, c: np.ndarray, g: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances), nearest first, by best-first search on the graph, for all rows at once."""
    n, k = len(x), len(c)
    beam = min(beam, k)
    if beam == k or 4 * beam * g.shape[1] >= k:  # nearly all centroids, or so many steps that they cost more: ranked outright
        near = x @ c.T
        ids = np.argpartition(-near, beam - 1, axis=1)[:, :beam] if beam < k else np.broadcast_to(np.arange(k), near.shape)
        near = np.take_along_axis(near, ids, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, order, 1), 0))
    rows = np.arange(n)[:, None]
    entry = np.unique(np.linspace(0, k - 1, min(k, max(beam, 16))).astype(np.int64))
    ids = np.broadcast_to(entry, (n, len(entry))).copy()
    seen = np.zeros((n, k), bool)
    seen[:, entry] = True
    near = x @ c[entry].T
    done = np.zeros((n, k), bool)
    while True:
        order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
        ids, near = ids[rows, order], near[rows, order]
        open_ = ~done[rows, ids] & (near > -5)
        if not open_.any():
            return ids, np.sqrt(np.maximum(2 - 2 * near, 0))
        pick = open_.argmax(1)
        has = open_[np.arange(n), pick]
        at = ids[np.arange(n), pick]
        done[np.arange(n)[has], at[has]] = True
        new = g[at]
        old = seen[rows, new] | ~has[:, None]
        seen[rows, new] |= has[:, None]
        more = np.einsum("nld,nd->nl", c[new], x)
        same = np.zeros_like(old)  # one centroid twice among the new
        by = np.argsort(new, axis=1, kind="stable")
        sorted_ = new[rows, by]
        same[rows, by[:, 1:]] = sorted_[:, 1:] == sorted_[:, :-1]
        more[old | same] = -9
        ids, near = np.concatenate([ids, new], 1), np.concatenate([near, more], 1)


def homes(ids: np.ndarray, d: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list of each vector, then boundary ones."""
    n = len(ids)
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    for j in range(1, min(ids.shape[1], 2 * REPLICAS)):
        ok = (d[:, j] <= BOUNDARY * d[:, 0]) & (chosen.sum(1) < REPLICAS)
        for i in range(j):
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", c[ids[:, i]], c[ids[:, j]]), 0))
            ok &= ~(chosen[:, i] & (between < d[:, j] * 0.6))
        chosen[:, j] = ok
    row, col = np.nonzero(chosen)
    return row, ids[np.arange(n)[row], col]


def calibrated(x: np.ndarray, some: np.ndarray, q: np.ndarray, c: np.ndarray, g: np.ndarray) -> tuple[float, int]:
    """The smallest ratio, at the narrowest beam, with which the search finds the K nearest in the sample RECALL of the time.

    q: the rows `some` of the sample as queries; none counts as its own neighbour.
    """
    k, nearest = min(K, len(x) - 1), []
    for at in range(0, len(q), rows := max(1, SCORES // len(x))):
        score = q[at : at + rows] @ x.T
        score[np.arange(len(score)), some[at : at + rows]] = -np.inf
        nearest.append(np.argsort(-score, axis=1)[:, :k])
    best = np.concatenate(nearest)
    points = np.unique(best)
    return fitted(x[points], np.searchsorted(points, best), q, c, g)


def fitted(points: np.ndarray, where: np.ndarray, q: np.ndarray, c: np.ndarray, g: np.ndarray) -> tuple[float, int]:
    """The smallest ratio, at the narrowest beam, with which the search finds RECALL of points[where], the nearest of each of q."""
    if not where.size:
        return RATIOS[0], min(BEAM, len(c))
    # the lists of those that are to be found
    lists = np.full((len(points), REPLICAS), -1, np.int64)
    for at in range(0, len(points), rows := step(len(c))):
        row, of = homes(*walk(points[at : at + rows], c, g), c)
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        lists[at + row, nth] = of
    for beam in sorted({min(b, len(c)) for b in (BEAM, 2 * BEAM, 4 * BEAM, 16 * BEAM, len(c))}):
        needed = []
        for at in range(0, len(q), rows := step(len(c))):
            ids, d = walk(q[at : at + rows], c, g, beam)
            away = np.full((len(ids), len(c) + 1), np.inf)  # the last column: no list
            np.put_along_axis(away, ids, d / np.maximum(d[:, :1], 1e-30), 1)
            homes_of = lists[where[at : at + rows]]
            needed.append(np.take_along_axis(away, homes_of.reshape(len(ids), -1) % (len(c) + 1), 1).reshape(homes_of.shape).min(2))
        needed = np.concatenate(needed)
        for ratio in RATIOS:
            if (needed <= ratio).mean() >= RECALL:
                return ratio, beam
    return float("inf"), len(c)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def sent(queries: pa.RecordBatch, row: np.ndarray, of: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """(q_list, q_id, q) of rows of queries and their lists, some SENT bytes at a time: a query may read very many lists."""
    for at in range(0, len(row), few := max(1, SENT // (8 * dim))):
        some = pa.array(row[at : at + few])
        yield pa.RecordBatch.from_arrays([pa.array(of[at : at + few]), *(queries.column(i).take(some) for i in range(2))], names=["q_list", "q_id", "q"])


def nearest_of_all(points: DataFrame, ids: np.ndarray, raw: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, where): vectors[where] are the K nearest, among all points (id, v), of each of raw, whose ids are given."""
    dim, spark = raw.shape[1], points.sparkSession
    asked = spark.sparkContext.broadcast((ids, unit(raw)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = asked.value
        score, found = np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, rows := max(1, SCORES // len(q) // 4)):
                part = batch.slice(at, rows)
                of = part.column("id").to_numpy()
                more = q @ lift(matrix(part.column("v"), dim), largest).T
                more[own[:, None] == of] = -np.inf
                score, found = np.concatenate([score, more], 1), np.concatenate([found, np.broadcast_to(of, more.shape)], 1)
                if score.shape[1] > K:
                    best = np.argpartition(-score, K - 1, axis=1)[:, :K]
                    score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        nth, keep = np.repeat(np.arange(len(q)), score.shape[1]), np.isfinite(score.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]) for a in (nth, found.ravel(), score.ravel())], names=["nth", "id", "score"])

    by_task = points.select("id", "v").mapInArrow(run, "nth long, id long, score float")
    place = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("score"), "id"))
    best = by_task.withColumn("place", place).where(F.col("place") <= K).select("nth", "place", "id").toArrow()  # K * ASKED rows at most
    wanted = np.unique(best.column("id").to_numpy())
    held = points.join(F.broadcast(spark.createDataFrame(pa.table({"id": wanted}))), "id", "left_semi").select("id", "v").toArrow()
    order = np.argsort(held.column("id").to_numpy())
    where = np.zeros((len(raw), int(best.column("place").to_numpy().max())), np.int64)
    where[best.column("nth").to_numpy(), best.column("place").to_numpy() - 1] = np.searchsorted(wanted, best.column("id").to_numpy())
    return matrix(held.column("v").combine_chunks(), dim)[order], where


def search(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, embedding); queries: a condition on vec_id."""
    rows, lengths = valid(vectors)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths:
        found = found.unionByName(search_length(rows.where(F.size("v") == dim), dim, queries, k)) if len(lengths) > 1 else search_length(rows, dim, queries, k)
    return found


def search_length(rows: DataFrame, dim: int, queries: Column, k: int) -> DataFrame:
    """search among (vec_id, v) of one length."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    order = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    points = rows.withColumn("nth", order).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    points = stored(points.select(F.element_at("ids", 1).alias("id"), "v", "ids"), "points")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, largest = points.agg(F.count("*"), F.max(norm)).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    most = max(64, min(max(SAMPLE, SPREAD * min(LISTS, n // LIST)), SAMPLE_BYTES // (8 * dim)))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = points.where(chance <= 1.3 * most / n).orderBy(chance, "id").limit(most).select("id", "v").toArrow()
    raw = matrix(sample.column("v").combine_chunks(), dim)
    x = lift(raw, largest)
    c = centroids(x, int(min(LISTS, max(1, n // LIST), max(1, len(x) // SPREAD))))
    lists = len(c)
    g = graph(c)
    some = np.linspace(0, len(x) - 1, min(len(x), ASKED, max(8, SAMPLE_BYTES // (8 * dim * K)))).astype(int)
    q = unit(raw[some])
    if len(x) < n:
        near, where = nearest_of_all(points, sample.column("id").to_numpy()[some], raw[some], largest)
        ratio, beam = fitted(lift(near, largest), where, q, c, g)
    else:
        ratio, beam = calibrated(x, some, q, c, g)
    model = spark.sparkContext.broadcast((c, g, largest, ratio, beam))  # LISTS centroids at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, g, largest, _, _ = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, step(len(c))):
                part = batch.slice(at, step(len(c)))
                row, of = homes(*walk(lift(matrix(part.column("v"), dim), largest), c, g), c)
                first = np.concatenate([[True], row[1:] != row[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(first), *(part.column(i).take(pa.array(row)) for i in range(3))], names=["list", "first", "id", "v", "ids"])

    kind = points.schema["v"].dataType.simpleString()
    index = stored(points.select("id", "v", "ids").mapInArrow(place, f"list long, first boolean, id long, v {kind}, ids array<long>"), "lists")
    held, own = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for a, m, f in index.groupBy("list").agg(F.count("*"), F.count_if("first")).collect():
        held[a], own[a] = m, f
    own_ = spark.sparkContext.broadcast(own)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, g, _, ratio, beam = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, step(len(c))):
                part = batch.slice(at, step(len(c)))
                q = unit(matrix(part.column("v"), dim))
                ids, d = walk(q, c, g, beam)
                if (own_.value[ids].sum(1) < k + 1).any():
                    ids, d = walk(q, c, g, len(c))
                near = d <= ratio * d[:, :1]
                near |= np.cumsum(own_.value[ids], 1) - own_.value[ids] < k + 1  # never too few candidates
                row, col = np.nonzero(near)
                yield from sent(part, row, ids[row, col], dim)

    asked = rows.where(queries)
    distinct = asked.groupBy("v").agg(F.min("vec_id").alias("q_id"))
    routed = stored(distinct.select("q_id", "v").mapInArrow(route, f"q_list long, q_id long, q {kind}"), "routes")
    asking = np.zeros(lists, np.int64)
    for a, m in routed.groupBy("q_list").count().collect():
        asking[a] = m
    widest = routed.groupBy("q_id").count().agg(F.max("count")).first()[0] or 1
    parts = -(-widest // GATHERED)
    blocks = F.from_json(F.lit(json.dumps((-(-held // BLOCK)).tolist())), "array<int>")
    turns = F.from_json(F.lit(json.dumps((-(-asking // BLOCK)).tolist())), "array<int>")
    here = lambda counts, of: F.element_at(counts, (F.col(of) + 1).cast("int"))
    every = lambda counts, of: F.explode(F.sequence(F.lit(0), here(counts, of) - 1))
    left = index.where(here(turns, "list") > 0).withColumn("block", F.pmod(F.xxhash64("id"), here(blocks, "list")).cast("int")).withColumn("turn", every(turns, "list")).drop("first")
    right = routed.where(here(blocks, "q_list") > 0).withColumn("q_turn", F.pmod(F.xxhash64("q_id"), here(turns, "q_list")).cast("int")).withColumn("q_block", every(blocks, "q_list"))

    def meet(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if points.num_rows and queries.num_rows:
            v = matrix(points.column("v").combine_chunks(), dim).astype(np.float64)
            ids = points.column("ids").to_pylist()
            q_ids = queries.column("q_id").to_pylist()
            q = matrix(queries.column("q").combine_chunks(), dim).astype(np.float64)
            size = np.sqrt((v * v).sum(1).max())
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ v.T
                cut = np.partition(rough, -min(k + 1, len(v)), axis=1)[:, -min(k + 1, len(v))]
                for i, (s, least) in enumerate(zip(rough, cut, strict=True)):
                    own = q[at + i]
                    some = np.nonzero(s >= least - 1e-9 * size * np.sqrt((own * own).sum()))[0]
                    exact = (v[some] * own).sum(1).tolist()
                    best = sorted((-e, j) for e, p in zip(exact, some.tolist(), strict=True) for j in ids[p])[: k + 1]
                    out.append((q_ids[at + i], [{"less": e, "id": j} for e, j in best]))
        kind = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))
        at = points.column("list")[0].as_py() + points.column("block")[0].as_py() if out else 0
        return pa.table({"q_id": pa.array([o[0] for o in out], pa.int64()), "part": pa.array([at % parts] * len(out), pa.int64()), "best": pa.array([o[1] for o in out], kind)})

    # the largest scores first; a vector lies in REPLICAS lists at most, so a stretch of its copies is no longer
    met = left.groupBy("list", "block", "turn").cogroup(right.groupBy("q_list", "q_block", "q_turn")).applyInArrow(meet, "q_id long, part long, best array<struct<less:double,id:long>>")
    ranked = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, REPLICAS * (k + 1))
    gathered = F.slice(F.array_distinct(ranked), 1, k + 1).alias("best")
    if parts > 1:  # so that no group holds the answers of very many lists
        met = met.groupBy("q_id", "part").agg(gathered)
    best = met.groupBy("q_id").agg(gathered)
    answers = asked.select("vec_id", "v").distinct().join(distinct, "v").select(F.col("vec_id").alias("query_id"), "q_id").join(best, "q_id")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    listed = answers.select("query_id", F.posexplode(others).alias("rank", "b"))
    return listed.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
