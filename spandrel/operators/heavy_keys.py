"""Per-key results when a few keys hold most records (dense accumulator arrays)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import Scratch, shuffle_partitions
from spandrel.tables import in_force, target_key

_SEP, _NO_KIND = "\u001f", "\u0001"
_KEYS = 500_000  # keys that a split remembers before it hands its counts on
_PIECE = 4_096  # keys of one piece of a block, so that no row and no batch grows with the number of keys
ROWS_A_BLOCK = 100_000
_BLOCK = "block int, keys array<string>, counts array<long>"


def _split_counts(blocks: int):
    """One input split, sorted by id, latest delivery and key -> its counts per key, as arrays per block of keys."""

    def pack(counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        cut: dict[int, list[str]] = {}
        for k in counts:
            cut.setdefault(zlib.crc32(k.encode()) % blocks, []).append(k)
        pieces = [(block, keys[i : i + _PIECE]) for block, keys in cut.items() for i in range(0, len(keys), _PIECE)]
        for i in range(0, len(pieces), 64):
            some = pieces[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in some], pa.int32()), pa.array([k for _, k in some], pa.list_(pa.string())), pa.array([[counts[x] for x in k] for _, k in some], pa.list_(pa.int64()))],
                ["block", "keys", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            # the first row of an id stands; rows with a null id, which come first, repeat none
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | null[1:] | null[:-1]
            fresh[0] = null[0] or last is None or ids[0] != last
            last = last if null[-1] else ids[-1]
            # dictionary-encode the batch and count its codes at once
            key = batch.column(1).dictionary_encode()
            codes = key.indices.to_numpy(zero_copy_only=False)
            for k, n in zip(key.dictionary.to_pylist(), np.bincount(codes[fresh], minlength=len(key.dictionary)).tolist()):
                if n:
                    counts[k] = counts.get(k, 0) + n
            if len(counts) > _KEYS:
                yield from pack(counts)
                counts = {}
        if counts:
            yield from pack(counts)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by block -> dense arrays, one block of keys at a time: a slot a key, added up by ``bincount``."""
    block, slot, total = None, {}, np.zeros(0, np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        keys = list(slot)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)], pa.string()), pa.array(total[i : i + (1 << 16)][: len(keys) - i])], ["key", "n"])

    for batch in batches:
        for b, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if b != block:
                yield from done()
                block, slot, total = b, {}, np.zeros(0, np.int64)
            codes = [slot.setdefault(k, len(slot)) for k in keys.values.to_pylist()]
            if len(slot) > len(total):
                total = np.concatenate([total, np.zeros(max(len(slot) - len(total), len(total)), np.int64)])
            np.add.at(total, codes, counts.values.to_numpy())
    yield from done()


def key_counts(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """Distinct edge ids per (kind, dst_key) for all keys at even cost.

    Rows are spread by id, so that every split holds as many records however skewed the keys are. Each split
    dictionary-encodes its keys and counts them with one ``bincount``; what leaves it is one number a key, cut into
    ``blocks`` by key and pieces of 4,096 keys. Pieces are sorted by block and added up as they stream by, so a task
    holds one block's keys. There is a block for every 100,000 rows, so blocks stay that small however many keys
    there are. A key with a third of all rows costs its block one number a split.

    Defined results: edges not in force are ignored; rows that repeat an id count once, with the content of the
    latest ``loaded_at`` (of equally late ones, the smallest key); rows with a null id are records of their own;
    a null kind is a kind of its own; an edge without any target has a row with null ``dst_key`` a kind, so the
    sum over ``n`` is the number of records. An empty table gives no rows. Other columns are ignored.
    """
    if blocks is None:
        blocks = max(4 * shuffle_partitions(edges.sparkSession), min(2**31 - 1, edges.count() // ROWS_A_BLOCK))  # of the file's footers
    coded = in_force(edges).select(
        F.col("id").cast("long").alias("id"),
        F.concat(F.coalesce("kind", F.lit(_NO_KIND)), F.lit(_SEP), F.coalesce(target_key(edges), F.lit(""))).alias("key"),
        F.greatest(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0)).alias("loaded"),
    )
    spread = coded.repartition(F.xxhash64("id", F.when(F.col("id").isNull(), F.xxhash64("key", "loaded"))))
    spread = spread.sortWithinPartitions("id", F.desc("loaded"), "key")
    parts = spread.mapInArrow(_split_counts(blocks), _BLOCK)
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "key string, n long")
    cut = F.split(F.col("key"), _SEP, 2)
    return summed.select(
        F.when(cut[0] != _NO_KIND, cut[0]).alias("kind"),
        F.when(cut[1] != "", cut[1]).alias("dst_key"),
        "n",
    )


def heavy_keys(edges: DataFrame, share: float = 0.01, blocks: int | None = None) -> DataFrame:
    """The (kind, dst_key) pairs that hold at least ``share`` of the distinct ids of edges in force, with ``n``."""
    counts = Scratch(edges.sparkSession).keep(key_counts(edges, blocks))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("dst_key").isNotNull() & (F.col("n") >= F.lit(share) * F.lit(total)))
