"""Retrieval arms by name, run side by side over the same queries, scored and compared."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.text import is_test_path
from spandrel.operators import evaluate as E
from spandrel.operators import retrieval as R
from spandrel.operators.graph import links_of, nodes_of, ranked
from spandrel.session import Scratch


@dataclass
class Corpus:
    """What arms may see: files (repo, path, content), entities, edges, queries (space, query, text)."""

    files: DataFrame
    entities: DataFrame
    edges: DataFrame
    queries: DataFrame
    kept: dict[Callable[[Corpus], DataFrame], DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def once(self, arm: Callable[[Corpus], DataFrame]) -> DataFrame:
        """An arm's ranking; arms that others are fused from run once."""
        if arm not in self.kept:
            got = arm(self)
            self.kept[arm] = Scratch(self.queries.sparkSession).keep(got.select(*(c for c in ("space", "query", "doc", "rank") if c in got.columns)))
        return self.kept[arm]


def _in_space(scores: DataFrame, c: Corpus) -> DataFrame:
    """File scores (query, doc) of the query's own repository, ranked."""
    own = scores.join(c.queries.select("space", "query"), "query").filter(F.startswith("doc", F.concat("space", F.lit("/"))))
    return ranked(own, "score", "doc", by=("space", "query"))


def control(c: Corpus) -> DataFrame:
    docs = c.files.select(F.col("repo").alias("space"), F.col("path").alias("doc")).distinct().filter(~is_test_path(F.col("doc")))
    return R.control(c.queries.select("space", "query"), docs)


def lexical(c: Corpus) -> DataFrame:
    return R.bm25(c.queries, R.file_terms(c.files))


def mapped(c: Corpus) -> DataFrame:
    return _in_space(R.file_scores(R.map_arm(c.entities, c.edges, c.queries)), c)


def walked(c: Corpus, rounds: int = 2, seed_top: int = R.SEED_TOP) -> DataFrame:
    parts = R.bm25_terms(c.queries, R.entity_terms(nodes_of(c.entities), F.split("path", "/")[0]))
    final = R.coactivation(R.spread(R.rare_boost(parts), links_of(c.edges), rounds, seed_top, own=True))
    by_file = final.groupBy("query", F.split("node", "::", 2)[0].alias("doc")).agg(F.sum("score").alias("score"))
    return _in_space(by_file.filter(~is_test_path(F.col("doc"))), c)


def hybrid(c: Corpus) -> DataFrame:
    return R.fuse(c.once(lexical), c.once(mapped))


def hybrid_walk(c: Corpus) -> DataFrame:
    return R.fuse(c.once(lexical), c.once(walked))


ARMS: dict[str, Callable[[Corpus], DataFrame]] = {"control": control, "bm25": lexical, "map": mapped, "walk": walked, "hybrid": hybrid, "hybrid_walk": hybrid_walk}


def run(c: Corpus, truth: DataFrame, names: Iterable[str] = tuple(ARMS), ks: tuple[int, ...] = E.KS, arms: dict[str, Callable[[Corpus], DataFrame]] | None = None) -> DataFrame:
    """arm, query and scores of every arm for every query in ``truth``; at least two known arms.

    Arms see the queries without their gold patches.
    """
    arms, names = arms or ARMS, list(names)
    if len(names) < 2 or (unknown := set(names) - set(arms)):
        raise ValueError("two arms or more are needed" if len(names) < 2 else f"unknown arms: {', '.join(sorted(unknown))}")
    seen = Corpus(c.files, c.entities, c.edges, c.queries.select("space", "query", "text"))
    scratch = Scratch(truth.sparkSession)
    every = None
    for name in names:
        own = seen.once(arms[name]).select(F.struct(F.lit(name).alias("arm"), "query").alias("query"), "doc", "rank")
        every = own if every is None else every.unionByName(own)
    # all arms are scored in one plan, each query once an arm
    gold = scratch.keep(truth.select("query", "doc").distinct()).withColumn("arm", F.explode(F.array(*map(F.lit, names))))
    scored = E.score_rankings(every, gold.select(F.struct("arm", "query").alias("query"), "doc"), ks)
    return scratch.keep(scored.select("query.query", *(F.col(f"`{c}`") for c in scored.columns if c != "query"), F.col("query.arm").alias("arm")))


def grid(**values: Iterable) -> list[dict]:
    """Every combination of parameter values."""
    keys = sorted(values)
    return [dict(zip(keys, combo)) for combo in itertools.product(*(values[k] for k in keys))]


def fingerprint(config: dict) -> str:
    """Twelve hex digits that stand for a configuration in result rows."""
    return hashlib.blake2b(repr(sorted(config.items())).encode(), digest_size=6).hexdigest()


def tune(c: Corpus, truth: DataFrame, configs: list[dict], arm: Callable[..., DataFrame] = walked, metric: str = "mrr", dataset: str = "", reporting: frozenset[str] = frozenset()) -> DataFrame:
    """config, fingerprint, value of each configuration of an arm; refuses to tune on a set that results are reported on."""
    if dataset in reporting:
        raise ValueError(f"{dataset} is for reporting, not for tuning")
    rows = []
    for config in configs:
        got = E.score_rankings(arm(c, **config).select("query", "doc", "rank"), truth).agg(F.avg(F.col(f"`{metric}`"))).first()[0]
        rows.append((repr(sorted(config.items())), fingerprint(config), got))
    return truth.sparkSession.createDataFrame(rows, "config string, fingerprint string, value double").orderBy(F.desc("value"), "config")
