"""Sinks: receipts and findings as text, JSON lines and Markdown."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from gridloom.operators import lint


def diagnostics(found: DataFrame, most: int = 200) -> str:
    """Findings the way compilers print warnings; a report of at most so many lines."""
    rows = found.orderBy("wb", "sheet", "cell", "detector").limit(most).collect()
    return "\n".join(f"{r['wb']}:{r['sheet']}!{r['cell']}: warning [{r['detector']}] {r['proof']}" for r in rows)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(record: dict, path: str) -> None:
    Path(path).write_text(json.dumps(record, indent=1, sort_keys=True, default=str) + "\n", encoding="utf-8")


def baseline(found: DataFrame, path: str) -> None:
    """Keeps the keys of findings, so that later checks report new ones only."""
    found.select(lint.key().alias("key")).distinct().write.mode("overwrite").parquet(path)


def markdown(name: str, summary: dict, found: list, scenarios: list[dict] | None = None) -> str:
    """One workbook's report."""
    lines = [f"# {name}", "", "## Receipt", "", "| | cells |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in summary.items()]
    lines += ["", "## Findings", ""]
    lines += [f"- **{f['detector']}** {f['sheet']}!{f['cell']}: `{f['formula']}` — {f['proof']}" for f in found] or ["none"]
    if scenarios:
        lines += ["", "## Scenarios", "", "| cell | mean | sd | p5 | p50 | p95 |", "|---|---|---|---|---|---|"]
        lines += [f"| {s['cell']} | {s['mean']:.6g} | {s['sd']:.6g} | {s['p5']:.6g} | {s['p50']:.6g} | {s['p95']:.6g} |" for s in scenarios]
    return "\n".join(lines) + "\n"
