"""Keeping a graph up to date: what a new listing changes, replacing it, and streams of files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, content string, hash string, size long, mtime_ns long"


def changes(listed: DataFrame, known: DataFrame) -> DataFrame:
    """path, change: what to do about each file of a new listing (path, hash, size, mtime_ns, recipe_version).

    ``same``: size and time are those known and the language's version is; ``restamped``: only the time differs, the
    hash does not; ``changed``, ``stale`` (another version of the language), ``new``, ``deleted``.
    """
    a = listed.select("path", *(F.col(c).alias(f"l_{c}") for c in ("hash", "size", "mtime_ns", "recipe_version")))
    b = known.select("path", *(F.col(c).alias(f"k_{c}") for c in ("hash", "size", "mtime_ns", "recipe_version")))
    change = (
        F.when(F.col("k_size").isNull() & F.col("k_hash").isNull(), "new").when(F.col("l_size").isNull() & F.col("l_hash").isNull(), "deleted")
        .when(~F.col("l_recipe_version").eqNullSafe(F.col("k_recipe_version")), "stale")
        .when(F.col("l_size").eqNullSafe(F.col("k_size")) & F.col("l_mtime_ns").eqNullSafe(F.col("k_mtime_ns")), "same")
        .when(F.col("l_hash").eqNullSafe(F.col("k_hash")), "restamped").otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def replace_paths(table: DataFrame, fresh: DataFrame, changed: DataFrame, column: str = "path") -> DataFrame:
    """``table`` with the rows of all changed and deleted paths gone and the fresh ones in."""
    gone = changed.filter(F.col("change").isin("changed", "stale", "new", "deleted")).select(F.col("path").alias(column))
    return table.join(gone, column, "left_anti").unionByName(fresh)


def latest(deliveries: DataFrame, key: str = "path", order: str = "loaded_at") -> DataFrame:
    """The last delivered row of each key (a compaction of what a stream of deliveries left)."""
    cols = [c for c in deliveries.columns if c not in (key, order)]
    best = deliveries.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *cols)).alias("r"))
    return best.select(key, "r.*")


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], fmt: str = "parquet") -> StreamingQuery:
    """Hand every file that is new in a folder to ``each``, exactly once (by the checkpoint), and stop when none is left.

    ``fmt`` is any file source; with ``binaryFile`` the schema is the source's own.
    """
    reader = spark.readStream.format(fmt)
    reader = reader.schema(spark.read.format("binaryFile").load(folder).schema) if fmt == "binaryFile" else reader.schema(schema)
    return reader.load(folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total by tumbling windows of event time; works on streams (late rows up to ``late``) and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n: sessions of a user's events that no gap of the given length parts."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")
    timed = timed.withWatermark("ts", gap) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def stream_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is there now and give its result, written beside the checkpoint.

    In complete mode each batch replaces the one before; else each is a part of its own, replaced if it is run again.
    """
    at = f"{checkpoint}/{name}"

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/part={0 if mode == 'complete' else n}")

    df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(at).select(*df.columns)
