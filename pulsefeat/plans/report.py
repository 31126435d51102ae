"""Reports of an analysis: an HTML page and a manifest, from small tables only.

Every table in a report is limited before it is collected. Drawing is optional: histograms are given
as tables, which any plotting tool reads.
"""

from __future__ import annotations

import html
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.sources.tables import save_json

ROWS_SHOWN = 25


@dataclass
class Report:
    title: str = "Feature engineering report"
    project: str = "pulsefeat"
    notes: Sequence[str] = ()
    sections: list[tuple[str, str]] = field(default_factory=list)


def shown(value: Any) -> str:
    """Numbers with four decimals, large ones in scientific notation; a dash for what is missing."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "—"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, (int, float)):
        if abs(value) >= 1e5:
            return f"{value:.2e}"
        return f"{value:.4f}" if isinstance(value, float) else str(value)
    return str(value)


def table_html(df: DataFrame, rows: int = ROWS_SHOWN) -> str:
    found = df.limit(rows).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in r) + "</tr>" for r in found)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" if found else "<p>nothing to show</p>"


def list_html(items: dict[str, Any]) -> str:
    return "<dl>" + "".join(f"<dt>{html.escape(str(k))}</dt><dd>{html.escape(shown(v))}</dd>" for k, v in items.items()) + "</dl>"


def page(report: Report) -> str:
    notes = [report.notes] if isinstance(report.notes, str) else list(report.notes)
    made = datetime.now(UTC).strftime("%Y-%m-%d %H:%M UTC")
    sections = "".join(f"<section><h2>{html.escape(title)}</h2>{body}</section>" for title, body in report.sections)
    remarks = "<ul>" + "".join(f"<li>{html.escape(n)}</li>" for n in notes) + "</ul>" if notes else ""
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left}"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(report.title)}</title><style>{style}</style></head><body><h1>{html.escape(report.title)}</h1><p>{html.escape(report.project)}, {made}</p>{remarks}{sections}</body></html>'


def build(profile: DataFrame, histogram: DataFrame, splits: DataFrame, groups: DataFrame, lineage: DataFrame, tables: dict[str, DataFrame], safety: dict, notes: Sequence[str] = ()) -> Report:
    report = Report(notes=notes)
    report.sections = [
        ("Dataset", list_html(profile.first().asDict())),
        ("Target", table_html(histogram)),
        ("Splits", table_html(splits)),
        ("Feature groups", table_html(groups)),
        ("Feature inventory", table_html(lineage)),
        ("Safety", list_html(safety)),
        *[(name.replace("_", " ").capitalize(), table_html(df)) for name, df in tables.items()],
    ]
    return report


def save(spark: SparkSession, report: Report, folder: str) -> dict[str, str]:
    """The page and a manifest, in folders that Spark writes."""
    paths = {"html": f"{folder.rstrip('/')}/report_html", "manifest": f"{folder.rstrip('/')}/manifest_json"}
    spark.range(1).select(F.lit(page(report)).alias("value")).coalesce(1).write.mode("overwrite").text(paths["html"])
    save_json(spark, {"title": report.title, "sections": [t for t, _ in report.sections], "files": paths, "created": datetime.now(UTC)}, paths["manifest"])
    return paths
