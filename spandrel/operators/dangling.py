"""References to records that do not exist, by a merge of co-partitioned, sorted references and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.session import shuffle_partitions
from spandrel.tables import in_force, key_hash

BUCKETS = 4096  # size of the histogram that finds hot keys; the driver gets at most so many numbers
_EVER = 2**62


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _ends(edges: DataFrame) -> DataFrame:
    """One row for each end of an edge in force whose path and name are not null."""
    rows = in_force(edges).select("id", _micros("seen_at").alias("at"), *(F.struct(*key_hash(F.col(f"{s}_path"), F.col(f"{s}_name")), (F.col(f"{s}_path").isNotNull() & F.col(f"{s}_name").isNotNull())).alias(s) for s in ("src", "dst")))
    both = F.array(*(F.struct(F.col(f"{s}.col1").alias("h1"), F.col(f"{s}.col2").alias("h2"), F.lit(s == "dst").alias("is_dst"), F.col(f"{s}.col3").alias("ok")) for s in ("src", "dst")))
    return rows.select("id", "at", F.explode(both).alias("end")).filter("end.ok").select("id", "at", "end.h1", "end.h2", "end.is_dst")


def _parents(entities: DataFrame, shared: DataFrame) -> DataFrame:
    """Validity intervals [start, stop) by address; rows without path, name or start are never valid."""
    h1, h2 = key_hash(F.col("path"), F.col("name"))
    known = F.col("path").isNotNull() & F.col("name").isNotNull() & F.col("seen_at").isNotNull()
    own = entities.filter(known).select(h1.alias("h1"), h2.alias("h2"), _micros("seen_at").alias("at"), F.coalesce(_micros("removed_at"), F.lit(_EVER)).alias("stop"))
    return own.unionByName(shared.filter(known).select(h1.alias("h1"), h2.alias("h2"), _micros("seen_at").alias("at"), F.lit(_EVER).alias("stop"))).distinct()


def dangling_ends(edges: DataFrame, entities: DataFrame, shared: DataFrame) -> DataFrame:
    """Ends of edges that name an address which does not exist when the edge is seen: id, side, seen_at, reason.

    References and parents are partitioned alike by address and sorted by time; one pass over the merged stream
    carries the latest end of all validity intervals begun so far. ``reason`` is ``missing`` (no such address
    ever), ``late`` (it only comes later), ``deleted`` (all its intervals so far have ended) or ``undated``
    (the edge has no ``seen_at``, so no parent can be shown to hold).

    Hot addresses: a histogram of references over 4096 hash buckets (dense, at most 4096 numbers) tells how many
    ways each bucket is split by edge id; only the few parents of a split bucket are repeated, once a way.

    Defined results: edges not in force and ends with null path or name are ignored; rows that repeat an id and
    a parent repeated in any form give one row; empty tables give no rows, or all ends when only parents are
    missing; other columns are ignored.
    """
    spark = edges.sparkSession
    ends = _ends(edges)
    bucket = F.pmod(F.col("h1"), F.lit(BUCKETS)).cast("int")
    sizes = dict(ends.groupBy(bucket.alias("b")).count().collect())  # at most BUCKETS rows
    share = max(1000, sum(sizes.values()) // (4 * shuffle_partitions(spark)))
    ways = [(b, n // share + 1) for b, n in sizes.items() if n > share]
    if ways:
        hot = F.broadcast(spark.createDataFrame(ways, "b int, ways int"))  # at most 4 * shuffle partitions rows
        parents = _parents(entities, shared).join(hot, bucket == F.col("b"), "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("b", "ways")
        ends = ends.join(hot, bucket == F.col("b"), "left").withColumn("way", F.coalesce(F.pmod(F.xxhash64("id"), F.col("ways")).cast("int"), F.lit(0))).drop("b", "ways")
    else:
        parents, ends = _parents(entities, shared).withColumn("way", F.lit(0)), ends.withColumn("way", F.lit(0))
    stream = parents.withColumns({"id": F.lit(None).cast("long"), "is_dst": F.lit(None).cast("boolean"), "ref": F.lit(False)}).unionByName(ends.withColumns({"stop": F.lit(None).cast("long"), "ref": F.lit(True)}))
    merged = Window.partitionBy("h1", "h2", "way").orderBy(F.col("at").asc_nulls_first(), "ref")  # parents first at equal times
    reach = F.max("stop").over(merged.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ever = F.max("stop").over(merged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = stream.select("id", "is_dst", "at", "ref", reach.alias("reach"), ever.alias("ever")).filter(F.col("ref") & (F.col("at").isNull() | F.col("reach").isNull() | (F.col("reach") <= F.col("at"))))
    reason = F.when(F.col("at").isNull(), "undated").when(F.col("ever").isNull(), "missing").when(F.col("reach").isNull(), "late").otherwise("deleted")
    return (
        out.select("id", F.when(F.col("is_dst"), "dst").otherwise("src").alias("side"), F.timestamp_micros("at").cast("timestamp_ntz").alias("seen_at"), reason.alias("reason"))
        .groupBy("id", "side")
        .agg(F.min("seen_at").alias("seen_at"), F.min("reason").alias("reason"))
    )


def dangling_by_period(found: DataFrame) -> DataFrame:
    """Dangling ends counted by referring column and month of ``seen_at`` (``YYYY-MM``, null if undated)."""
    return found.groupBy(F.concat(F.lit("edges."), "side").alias("ref_table"), F.date_format("seen_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n"))
