"""Writers: JSON Lines logs, result documents, Markdown. Ledger upserts are in ``snapshots``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, path: str, run: str | None = None) -> None:
    """Result documents as JSON, one folder per ``run`` value when given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(run) if run else writer).json(path)


def write_markdown(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").option("lineSep", "\n\n").text(path)
