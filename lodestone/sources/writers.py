"""Sinks: idempotent appends, keyed overwrites and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_key
from lodestone.session import cut


def insert_or_ignore(new: DataFrame, path: str, key: str, order: str | None = None) -> DataFrame:
    """Append the rows whose key is not stored yet; returns them. Of equal new keys one row is kept, with ``order`` the first
    in it.

    Rows with null key are ignored. The stored side contributes only its key column to the anti join.
    """
    spark = new.sparkSession
    fresh = new.where(F.col(key).isNotNull())
    fresh = top_per_key(fresh, [key], [F.col(order)], 1) if order else fresh.dropDuplicates([key])
    try:
        stored = spark.read.parquet(path).select(key)
    except Exception:  # noqa: BLE001 - nothing stored yet
        stored = None
    if stored is not None:
        fresh = fresh.join(stored, key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def replace_keys(rows: DataFrame, path: str, partition: str) -> None:
    """Delete and insert per key: only the partitions that occur in ``rows`` are rewritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(rows: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Write the last row of each key in ``order``, in place of what is stored for it; what is stored for others stays.

    The merged state is checkpointed before the stored one is overwritten.
    """
    spark = rows.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - nothing stored yet
        stored = None
    new = top_per_key(rows, keys, [F.desc(order)], 1)
    if stored is not None:
        new = cut(new.unionByName(stored.join(new.select(*keys), keys, "left_anti")))
    new.write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Scalar columns as CSV; nested ones are written as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link export: two folders of JSON lines that hold only scalar attributes."""
    for name, df in (("nodes", nodes), ("links", edges)):
        scalar = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
        df.select(*scalar).write.mode("overwrite").json(f"{path}/{name}")


def comparison_table(df: DataFrame, style: str = "markdown", limit: int = 200) -> str:
    """A report of at most ``limit`` rows as markdown, html, latex or plain text."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    head = df.columns
    if style == "html":
        line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{v}</{tag}>" for v in r) + "</tr>"
        return "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"
    if style == "latex":
        return "\\begin{tabular}{" + "l" * len(head) + "}\n" + " \\\\\n".join(" & ".join(r) for r in [head, *rows]) + "\n\\end{tabular}"
    if style == "plain":
        return "\n".join("\t".join(r) for r in [head, *rows])
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])
