"""Level-based compaction as set operations over runs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FILE_COST, LEVELS, PUT, Settings, thresholds
from .log import latest

#: Runs that meet others as one row, and tasks of that join.
BLOCK, TASKS = 1024, 257


def due(level_sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(level, files, threshold, due) of the levels present."""
    limits = F.create_map(*(F.lit(x) for x in chain(*thresholds(settings).items())))
    limit = F.element_at(limits, F.col("level"))
    return level_sizes.select("level", "files", limit.alias("threshold"), (F.col("files") >= limit).alias("due"))


def overlapping(manifest: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs whose range meets [low, high]; a missing bound matches."""
    return manifest.where(F.coalesce((F.col("max_key") >= low) & (F.col("min_key") <= high), F.lit(True)))


def stretches(side: DataFrame, edges: DataFrame) -> DataFrame:
    """The runs with the first and the last stretch between `edges`, one row of sorted keys, that they touch; a missing bound touches all that lie its way."""
    place = lambda key: F.size(F.filter("edges", lambda e: e <= F.col(key)))
    low = F.when(F.col("min_key").isNull(), 0).otherwise(place("min_key"))
    high = F.when(F.col("max_key").isNull(), F.size("edges")).otherwise(place("max_key"))
    return side.crossJoin(F.broadcast(edges)).withColumn("low", low).withColumn("high", F.greatest("low", high)).drop("edges")


def edges_of(runs: DataFrame, cuts: int) -> DataFrame:
    """Some of the smallest keys, chosen by hash, as one row of a sorted array."""
    some = runs.select("min_key").where("min_key IS NOT NULL").distinct().orderBy(F.xxhash64("min_key")).limit(cuts)
    return some.agg(F.sort_array(F.collect_list("min_key")).alias("edges"))


def overlap_pairs(left: DataFrame, right: DataFrame, cuts: int = 256) -> DataFrame:
    """Pairs (left_run, right_run) of overlapping ranges; a missing bound matches.

    The key space is cut at some of the right side's smallest keys. Of two ranges that
    overlap, the one that begins in the later stretch (the right one, if both begin in the
    same) meets the other there. So each side's runs, in blocks where they begin, meet
    those of the other that touch that stretch, and a pair is looked at once. The number of
    tasks is set: Spark would choose it by the size of the rows, which the pairs outgrow.
    """
    edges = edges_of(right, cuts)
    left, right = stretches(left, edges), stretches(right, edges)

    def met(spread: DataFrame, first: Column, homes: DataFrame, name: str, other: str) -> DataFrame:
        bounds = lambda side: [F.col("run_id").alias(f"{side}_run"), F.col("min_key").alias(f"{side}_min"), F.col("max_key").alias(f"{side}_max")]
        touching = spread.where(first <= F.col("high")).select(*bounds(name), F.explode(F.sequence(first, F.col("high"))).alias("stretch"))
        nth = F.row_number().over(Window.partitionBy("stretch").orderBy("min_key", "run_id"))
        begun = homes.select("run_id", "min_key", "max_key", F.col("low").alias("stretch")).withColumn("block", F.floor(nth / BLOCK))
        blocks = begun.groupBy("stretch", "block").agg(F.collect_list(F.struct(*bounds(other))).alias("runs"))
        both = touching.repartition(TASKS, "stretch").join(blocks.repartition(TASKS, "stretch").hint("merge"), "stretch")
        yes = F.lit(True)
        meets = F.coalesce(F.col("left_max") >= F.col("right_min"), yes) & F.coalesce(F.col("left_min") <= F.col("right_max"), yes)
        return both.select(f"{name}_run", f"{name}_min", f"{name}_max", F.inline("runs")).where(meets).select("left_run", "right_run")

    return met(left, F.col("low"), right, "left", "right").unionByName(met(right, F.col("low") + 1, left, "right", "left"))


def overlap_counts(runs: DataFrame, cuts: int = 256) -> DataFrame:
    """(run_id, overlaps): of each run, how many others its range meets; a missing bound matches. Pairs are not made.

    Of all runs, those that begin at or before a run's end meet it, but for those that end
    before it begins. Both are counted by the place of keys in order: running sums within
    stretches of the key space, and the sums of the stretches before.
    """
    edges = edges_of(runs, cuts)
    sides = stretches(runs.select("run_id", "min_key", "max_key"), edges)
    # where keys are the same, begins come first; a missing bound lies before or after all keys
    end = lambda n, key, rank: F.struct(F.lit(n).alias("end"), (F.col(key).isNull().cast("int") * rank).alias("beyond"), F.col(key).alias("key"), F.col("low" if n == 0 else "high").alias("stretch"))
    ends = sides.select("run_id", F.inline(F.array(end(0, "min_key", -1), end(1, "max_key", 1))))
    sums = lambda w=None: [(s.over(w) if w is not None else s).alias(name) for name, s in (("begun", F.sum(1 - F.col("end"))), ("over", F.sum("end")))]
    within = ends.select("run_id", "end", "stretch", *sums(Window.partitionBy("stretch").orderBy("beyond", "key", "end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = ends.groupBy("stretch").agg(*sums())  # a row a stretch
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select("stretch", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("begun", "over")))
    placed = within.join(F.broadcast(earlier), "stretch")
    met = F.when(F.col("end") == 1, F.col("begun") + F.col("begun_before")).otherwise(-F.col("over") - F.col("over_before"))
    return placed.groupBy("run_id").agg((F.sum(met) - 1).alias("overlaps"))


def merge(runs: DataFrame, bottom: bool = False) -> DataFrame:
    """One entry a key, the newest. Tombstones stay unless nothing older can lie below."""
    kept = latest(runs)
    return kept.where(F.col("op") == PUT) if bottom else kept


def inputs(runs: DataFrame, manifest: DataFrame, level: int) -> DataFrame:
    """The rows of a level and of the next level's runs that overlap it."""
    own = manifest.where(F.col("level") == level)
    span = own.agg(F.min("min_key"), F.max("max_key")).first()
    below = overlapping(manifest.where(F.col("level") == level + 1), F.lit(span[0]), F.lit(span[1]))
    chosen = own.select("level", "run_id").unionByName(below.select("level", "run_id"))
    return runs.join(chosen, ["level", "run_id"], "left_semi")


def compact(runs: DataFrame, manifest: DataFrame, level: int, to_run: int) -> DataFrame:
    """All runs after a level is merged into the next; what lies deeper decides whether tombstones may go."""
    target = min(level + 1, LEVELS - 1)
    source = inputs(runs, manifest, level)
    # the manifest tells whether anything older lies below, without a look at the runs
    own = manifest.where(F.col("level") == level).agg(F.min("min_key"), F.max("max_key")).first()
    deeper = manifest.where(F.col("level") >= target).join(overlapping(manifest.where(F.col("level") == target), F.lit(own[0]), F.lit(own[1])).select("level", "run_id"), ["level", "run_id"], "left_anti")
    bottom = deeper.isEmpty()
    merged = merge(source.drop("level", "run_id"), bottom)
    merged = merged.withColumn("level", F.lit(target)).withColumn("run_id", F.lit(to_run).cast("long"))
    rest = runs.join(source.select("level", "run_id").distinct(), ["level", "run_id"], "left_anti")
    return rest.unionByName(merged.select(*rest.columns))


def file_bytes(value: Column) -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length(value), F.lit(0)) + FILE_COST).cast("long")


def file_count(run: DataFrame, value: Column, settings: Settings = Settings()) -> int:
    """Files of about the target size."""
    return run.agg(files_of(F.coalesce(F.sum(file_bytes(value)), F.lit(0)), settings.file_bytes)).first()[0]


def files_of(size: Column, target: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / target)).cast("long")
