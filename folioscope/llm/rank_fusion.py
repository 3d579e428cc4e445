"""One ranking from several differently-scaled scores by robust rank aggregation.

Each signal ranks an item's query's candidates; the rank is divided by their number. Of an item's sorted
normalised ranks r(1) <= ... <= r(m), the k-th is at most r(k) under chance with the probability that a
Beta(k, m-k+1) variable is; the smallest of these, times m (Bonferroni), is the item's significance.

A null or NaN score ranks last (1.0) for its signal. Equal scores share their mean rank. Equal
significance is ordered by the mean normalised rank, then by chunk_id. Rows with a null query_id or
chunk_id are no candidates. Of rows with one query and chunk the latest scored_at counts (null is the
oldest; of ties the largest scores). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.staging import small_or_shuffled, stage

#: name of the signal, and whether its larger values are the better ones
SIGNALS = (("lexical_score", True), ("vector_score", True), ("graph_rank", False))

#: Queries with more candidates than this are ranked over several tasks.
HOT_QUERY = 100_000


def latest_candidates(candidates: DataFrame, signals: tuple = SIGNALS) -> DataFrame:
    """One row for each query_id and chunk_id, with the signals as doubles of which larger is better."""
    better = [
        F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double") * (1 if up else -1)).alias(s) for s, up in signals
    ]
    rows = candidates.where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id", "scored_at", *better)
    names = [s for s, _ in signals]
    newest = rows.groupBy("query_id", "chunk_id").agg(F.max(F.struct("scored_at", *names)).alias("last"))
    return newest.select("query_id", "chunk_id", *[F.col(f"last.{s}").alias(s) for s in names])


def beta_tail(k: int, m: int, r: Column) -> Column:
    """P(Beta(k, m-k+1) <= r): at least k of m uniform values are at most r."""
    terms = [F.lit(float(comb(m, j))) * F.pow(r, F.lit(float(j))) * F.pow(1 - r, F.lit(float(m - j))) for j in range(k, m + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def significance(ranks: list[Column]) -> Column:
    m = len(ranks)
    order = F.array_sort(F.array(*ranks))
    tails = [beta_tail(k, m, F.element_at(order, k)) for k in range(1, m + 1)]
    return F.least(F.lit(1.0), F.least(*tails) * m) if m > 1 else tails[0]


def _window_ranks(rows: DataFrame, names: list[str]) -> DataFrame:
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("of", F.count("*").over(whole))
    for s in names:
        tied = F.count("*").over(Window.partitionBy("query_id", s))
        mean = F.rank().over(whole.orderBy(F.col(s).desc_nulls_last())) + (tied - 1) / 2
        rows = rows.withColumn(f"r_{s}", F.when(F.col(s).isNull(), 1.0).otherwise(mean / F.col("of")))
    return rows


def _ranged_ranks(rows: DataFrame, names: list[str]) -> DataFrame:
    """The same ranks where one query's candidates span many tasks: equal scores are counted first, sorted
    over range partitions, and each partition starts from the candidates in the partitions before it."""
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("of"))
    rows = rows.join(sizes, "query_id")
    for s in names:
        tied = rows.where(F.col(s).isNotNull()).groupBy("query_id", s).agg(F.count("*").alias("tied"))
        ranged = stage(tied.repartitionByRange("query_id", F.col(s).desc()).withColumn("part", F.spark_partition_id()), "ranks")
        before = ranged.groupBy("query_id", "part").agg(F.sum("tied").alias("held"))
        before = before.withColumn("ahead", F.sum("held").over(Window.partitionBy("query_id").orderBy("part")) - F.col("held"))
        inside = Window.partitionBy("query_id", "part").orderBy(F.col(s).desc())
        ranked = ranged.withColumn("local", F.sum("tied").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        ranked = ranked.join(before.drop("held"), ["query_id", "part"]).select(
            "query_id", s, (F.col("ahead") + F.col("local") - (F.col("tied") - 1) / 2).alias("mean")
        )
        rows = rows.join(ranked, ["query_id", s], "left")
        rows = rows.withColumn(f"r_{s}", F.coalesce(F.col("mean") / F.col("of"), F.lit(1.0))).drop("mean")
    return rows


def _is_hot(candidates: DataFrame, hot_query: int) -> DataFrame:
    """query_id of the queries with more candidates than hot_query: at most (all candidates) / hot_query rows."""
    return candidates.where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_query).select("query_id")


def _scored(ranked: DataFrame, names: list[str]) -> DataFrame:
    ranks = [F.col(f"r_{s}") for s in names]
    return ranked.select(
        "query_id", "chunk_id", *ranks, significance(ranks).alias("significance"), (sum(ranks[1:], ranks[0]) / len(ranks)).alias("mean_rank")
    )


def fused_parts(candidates: DataFrame, signals: tuple = SIGNALS, hot_query: int = HOT_QUERY) -> tuple[DataFrame, DataFrame | None]:
    """query_id, chunk_id, the normalised rank of each signal, significance and mean_rank of the candidates of ordinary
    queries and of hot ones (None if there are none). Only hot queries take the way over range partitions."""
    names = [s for s, _ in signals]
    rows = latest_candidates(candidates, signals)
    hot = stage(_is_hot(candidates, hot_query), "hot")
    if not hot.limit(1).count():
        return _scored(_window_ranks(rows, names), names), None
    rows = stage(rows, "candidates")
    hot = small_or_shuffled(hot)
    cold = _window_ranks(rows.join(hot, "query_id", "left_anti"), names)
    return _scored(cold, names), _scored(_ranged_ranks(rows.join(hot, "query_id", "left_semi"), names), names)


def fused_scores(candidates: DataFrame, signals: tuple = SIGNALS, hot_query: int = HOT_QUERY) -> DataFrame:
    cold, hot = fused_parts(candidates, signals, hot_query)
    return cold if hot is None else cold.unionByName(hot)


ORDER = ("rounded", "mean", "chunk_id")


def _placed(scores: DataFrame) -> DataFrame:
    return scores.select("query_id", "chunk_id", F.round("significance", 12).alias("rounded"), F.round("mean_rank", 12).alias("mean"))


def _hot_places(scores: DataFrame) -> DataFrame:
    """query_id, chunk_id, position of hot queries: sorted over range partitions, each of which starts from the
    number of candidates in those before it."""
    ranged = stage(_placed(scores).repartitionByRange("query_id", *ORDER).withColumn("part", F.spark_partition_id()), "places")
    before = ranged.groupBy("query_id", "part").agg(F.count("*").alias("held"))
    before = before.withColumn("ahead", F.sum("held").over(Window.partitionBy("query_id").orderBy("part")) - F.col("held"))
    local = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*ORDER))
    placed = ranged.withColumn("local", local).join(before.drop("held"), ["query_id", "part"])
    return placed.select("query_id", "chunk_id", (F.col("ahead") + F.col("local")).alias("position"))


def fused_ranking(candidates: DataFrame, queries: DataFrame, signals: tuple = SIGNALS, hot_query: int = HOT_QUERY) -> DataFrame:
    """query_id, chunk_id, position: the first `wanted` candidates of each query; none where wanted is null."""
    wanted = queries.where("query_id is not null").groupBy("query_id").agg(F.max("wanted").alias("wanted"))
    cold, hot = fused_parts(candidates, signals, hot_query)
    order = Window.partitionBy("query_id").orderBy(*ORDER)
    placed = _placed(cold).select("query_id", "chunk_id", F.row_number().over(order).alias("position"))
    if hot is not None:
        placed = placed.unionByName(_hot_places(hot).withColumn("position", F.col("position").cast("int")))
    return placed.join(wanted, "query_id").where("position <= wanted").select("query_id", "chunk_id", "position")
