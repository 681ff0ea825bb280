"""Reading the tables and the rules that hold for every query over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_force(edges: DataFrame) -> DataFrame:
    """Edges whose status is not ``dropped``; a null status counts as in force."""
    return edges.filter(F.col("status").isNull() | (F.col("status") != "dropped"))  # reaches the scan


def node_key(path: Column, name: Column) -> Column:
    """``path::name``; null when either part is null."""
    return F.concat(path, F.lit("::"), name)


def target_key(edges: DataFrame) -> Column:
    """Key of an edge's target: the address inside the workspace, else ``external:`` and its name, else null."""
    return F.coalesce(
        node_key(edges["dst_path"], edges["dst_name"]),
        F.concat(F.lit("external:"), edges["ext_name"]),
    )


def key_hash(path: Column, name: Column) -> list[Column]:
    """128 bits that stand for an address in shuffles: two 64-bit hashes over differently laid out inputs.

    Two addresses among n collide with a chance of about n*n / 2**129 (1e-15 for 1e12 addresses).
    """
    return [F.xxhash64(path, name), F.xxhash64(F.lit("\u0001"), name, F.lit("\u0002"), path)]
