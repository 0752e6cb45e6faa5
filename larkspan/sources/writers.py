"""Sinks: documents, text tables, cards and sound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audio import encode_wav


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, in order over the whole output if asked."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_documents(df: DataFrame, column: str, path: str) -> None:
    """One JSON text per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_partition(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that df has: a cache that is keyed by content."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def sound_files(df: DataFrame) -> DataFrame:
    """path, rate, samples -> path, content: the bytes of each sound file, for any binary sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [encode_wav(np.asarray(x, float), int(r)) for x, r in zip(pdf["samples"], pdf["rate"], strict=True)]})

    return df.select("path", "rate", "samples").mapInPandas(run, "path string, content binary")


def text_table(df: DataFrame) -> str:
    """Fixed-width text of a report, all rows of it: a report has a row for each measure, not for each recording."""
    rows = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in df.collect()]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])


REQUIRED = ("name", "purpose", "data", "metrics", "limits")


def card(fields: dict[str, object]) -> tuple[str, list[str]]:
    """Markdown of a model card, and its problems (missing or empty parts)."""
    problems = [f"missing {k}" for k in REQUIRED if not fields.get(k)]
    body = [f"# {fields.get('name', '')}"]
    for k, v in fields.items():
        if k != "name":
            body.append(f"\n## {k}\n")
            body += [f"- {a}: {b}" for a, b in v.items()] if isinstance(v, dict) else [f"- {x}" for x in v] if isinstance(v, list) else [str(v)]
    return "\n".join(body) + "\n", problems
