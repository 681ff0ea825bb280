"""Scoring rankings against a truth: recall, reciprocal rank, macro averages, paired intervals, samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)
ITERATIONS, SEED = 10_000, 20260727  # fixed values of the interval


def score_rankings(rankings: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query, truth_files, retrieved, recall@k, all_found@k, precision@1, mrr, exact_set for every query in ``truth``.

    ``rankings`` has query, doc, rank (from 1), ``truth`` has query, doc; repeated rows are one, a query that nothing
    was retrieved for scores 0.
    """
    gold = truth.select("query", "doc").distinct()
    size = gold.groupBy("query").agg(F.count("*").alias("truth_files"))
    got = rankings.groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    marked = got.join(gold.withColumn("hit", F.lit(True)), ["query", "doc"], "left").join(size, "query")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    aggs = [F.count("*").alias("retrieved"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit & (F.col("rank") <= F.col("truth_files"))).alias("within")]
    aggs += [F.count_if(hit & (F.col("rank") <= k)).alias(f"hits@{k}") for k in ks]
    per = size.join(marked.groupBy("query").agg(*aggs), "query", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    out = [F.col("query"), F.col("truth_files"), n("retrieved").alias("retrieved")]
    for k in ks:
        out += [(n(f"hits@{k}") / F.col("truth_files")).alias(f"recall@{k}"), (n(f"hits@{k}") == F.col("truth_files")).cast("double").alias(f"all_found@{k}")]
    out += [(n("first") == 1).cast("double").alias("precision@1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (n("within") == F.col("truth_files")).cast("double").alias("exact_set")]
    return per.select(*out)


def entity_recall(rankings: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query, entity_recall@k over the entities that exist (``is_added`` false); queries whose ranking has no entity, or
    whose truth has none, have no row."""
    gold = truth.filter(~F.coalesce("is_added", F.lit(False))).select("query", "doc").distinct()
    size = gold.groupBy("query").agg(F.count("*").alias("size"))
    got = rankings.groupBy("query", "doc").agg(F.min("rank").alias("rank")).join(gold.withColumn("hit", F.lit(True)), ["query", "doc"], "left").join(size, "query")
    return got.groupBy("query").agg(*((F.count_if(F.coalesce("hit", F.lit(False)) & (F.col("rank") <= k)) / F.max("size")).alias(f"entity_recall@{k}") for k in ks))


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Average of every score column over queries, each query once; ``instances`` is their number."""
    cols = [c for c, t in scores.dtypes if t in ("double", "bigint", "int") and c not in by]
    return scores.groupBy(*by).agg(F.count("*").alias("instances"), *(F.round(F.avg(F.col(f"`{c}`")), 4).alias(c) for c in cols))


def medians(values: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, median and total of ``value``; nulls do not count."""
    return values.groupBy(by).agg(F.median(value).alias("median"), F.sum(value).alias("total"))


def paired_interval(scores: DataFrame, a: str, b: str, metric: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """metric, n, difference, low, high, separates: how far arm ``a`` leads arm ``b`` over the queries both have.

    ``scores`` has arm, query, value. Queries are resampled in pairs, ``iterations`` times with a fixed seed; the
    interval holds the middle 95 %. Fewer than two pairs give only ``n``. Pairs are counted by their difference
    first: how often each comes up in a resample is a multinomial draw, so one task sees each difference once,
    however many queries there are.
    """
    pairs = scores.filter(F.col("arm").isin(a, b) & F.col("value").isNotNull()).groupBy("query").agg(F.avg(F.when(F.col("arm") == a, F.col("value"))).alias("a"), F.avg(F.when(F.col("arm") == b, F.col("value"))).alias("b"))
    counted = pairs.select(F.round(F.col("a") - F.col("b"), 12).alias("lead")).filter("lead is not null").groupBy("lead").agg(F.count("*").alias("n"))

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lead")
        lead, times = rows["lead"].to_numpy(), rows["n"].to_numpy()
        n = int(times.sum())
        out = {"metric": [metric], "n": [n], "difference": [None], "low": [None], "high": [None], "separates": [None]}
        if n > 1:
            rng, block = np.random.default_rng(seed), max(1, 4_000_000 // len(lead))
            means = np.concatenate([rng.multinomial(n, times / n, min(block, iterations - k)) @ lead / n for k in range(0, iterations, block)])
            low, high = np.quantile(means, [0.025, 0.975], method="inverted_cdf").round(4)
            out |= {"difference": [round(float(times @ lead) / n, 4)], "low": [low], "high": [high], "separates": [bool(low > 0 or high < 0)]}
        return pd.DataFrame(out)

    return counted.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(resample, "metric string, n long, difference double, low double, high double, separates boolean")


def stratified(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """``n`` rows taken in turn from each stratum, smallest key first, strata in order of their name."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return rows.withColumn("turn", turn).orderBy("turn", stratum).limit(n).drop("turn")


def ceiling(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """truth, reachable: gold pairs (query, doc), and those whose doc is among the candidates (doc)."""
    gold = truth.select("query", "doc").distinct()
    hit = gold.join(candidates.select("doc").distinct().withColumn("there", F.lit(True)), "doc", "left")
    return hit.agg(F.count("*").alias("truth"), F.count_if(F.coalesce("there", F.lit(False))).alias("reachable"))


def verdicts(averages: DataFrame, metric: str, interval: DataFrame | None = None) -> DataFrame:
    """arm, value, rank, text: arms by a metric; a lead is only called one when its interval excludes zero, and a
    metric that all arms reach is called saturated."""
    m = F.col(f"`{metric}`")
    order = averages.select("arm", m.alias("value")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("value"))))
    spread = averages.agg(F.min(m).alias("least")).withColumn("one", F.lit(1))
    told = order.withColumn("one", F.lit(1)).join(F.broadcast(spread), "one").drop("one")
    clear = F.lit(bool(interval is not None and (r := interval.first()) is not None and r["separates"]))
    text = F.when(F.col("least") >= 0.999, "saturated").when((F.col("rank") == 1) & clear, "leads").when(F.col("rank") == 1, "ahead, not established").otherwise("behind")
    return told.select("arm", "value", "rank", text.alias("text"))
