"""Sinks: Parquet with zstd, JSON lines with sorted keys, reports as JSON and Markdown, the dataset hash."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The committer publishes the files of a job together; zstd as in the source data."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dataset_hash(df: DataFrame) -> str:
    """A hash of all rows that does not depend on their order; a row that stands twice counts twice.

    Two sums of independent 64-bit row hashes, taken apart into halves so that no sum overflows.
    """
    cols = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))]
    h1, h2 = F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
    half = lambda h, shift: F.sum(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)"))
    r = df.agg(F.count(F.lit(1)), half(h1, 0), half(h1, 32), half(h2, 0), half(h2, 32)).first()
    return "-".join(format(int(v or 0) % (1 << 64), "016x") for v in r)


def _table(rows: list[dict[str, Any]]) -> list[str]:
    names = list(rows[0])
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows]]


def to_markdown(title: str, report: dict[str, Any]) -> str:
    """Nested sections as headings, scalars as list items, lists of records as tables."""
    lines = [f"# {title}", ""]

    def section(value: dict[str, Any], level: int) -> None:
        for k, v in value.items():
            if isinstance(v, dict):
                lines.extend(["", f"{'#' * min(level, 6)} {k}", ""])
                section(v, level + 1)
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                lines.extend(["", f"{'#' * min(level, 6)} {k}", "", *_table(v), ""])
            else:
                lines.append(f"- **{k}:** {', '.join(map(str, v)) if isinstance(v, list) else v}")

    section(report, 2)
    return "\n".join(lines) + "\n"


def write_report(report: dict[str, Any], title: str, path: str | Path) -> None:
    """The report as JSON, and its Markdown twin beside it; each file is put in place by a rename."""
    path = Path(path)
    report = {"generated_at_utc": datetime.now(UTC).isoformat(timespec="seconds")} | report
    for p, text in ((path, json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n"), (path.with_suffix(".md"), to_markdown(title, report))):
        p.parent.mkdir(parents=True, exist_ok=True)
        part = p.with_name(p.name + ".part")
        part.write_text(text, encoding="utf-8")
        os.replace(part, p)
