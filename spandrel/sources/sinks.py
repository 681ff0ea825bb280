"""Where results go: partitioned tables, one directory an item, JSON lines, and a scorecard."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_graph(entities: DataFrame, edges: DataFrame, files: DataFrame, to: str) -> None:
    """Parquet tables of a graph; edges are partitioned by kind, so a verb reads only its kinds."""
    entities.write.mode("overwrite").parquet(f"{to}/entities")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{to}/edges")
    files.drop("content").write.mode("overwrite").parquet(f"{to}/files")


def replace_partitions(df: DataFrame, to: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(to)


def append_results(rows: DataFrame, to: str) -> None:
    """Results by item, so that what was done survives an interruption."""
    replace_partitions(rows, to, "query")


def write_predictions(rows: DataFrame, to: str) -> None:
    """JSON lines of instance_id, model, patch."""
    rows.select("instance_id", "model", "patch").write.mode("overwrite").json(to)


def scorecard(averages: list[dict], intervals: list[dict], to: str | Path) -> str:
    """A Markdown table of arms and metrics with the intervals below, written and returned."""
    cols = [c for c in averages[0] if c != "arm"] if averages else []
    lines = ["| arm | " + " | ".join(cols) + " |", "|" + "---|" * (len(cols) + 1)]
    lines += [f"| {a['arm']} | " + " | ".join(f"{a[c]:.3f}" if isinstance(a[c], float) else str(a[c]) for c in cols) + " |" for a in averages]
    for i in intervals:
        told = "established" if i.get("separates") else "not established"
        lines.append(f"\n{i['metric']}: {i['difference']:+.3f} [{i['low']:+.3f}, {i['high']:+.3f}], {told}" if i.get("difference") is not None else f"\n{i['metric']}: {i['n']} pairs, too few")
    Path(to).write_text(text := "\n".join(lines) + "\n")
    Path(to).with_suffix(".json").write_text(json.dumps({"averages": averages, "intervals": intervals}, indent=1))
    return text
