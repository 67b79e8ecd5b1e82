"""The run's report: checks with a status each, the worst of which is the run's, as rows and as HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession

_ORDER = ("OK", "WARN", "FAIL")


def collect(spark: SparkSession, gated: DataFrame, meta: DataFrame, leaks: list[str], max_quarantined: float = 0.05) -> DataFrame:
    """(check, status, detail), from the gate's answer, the panel's summary and the leak check."""
    g = {r.status: r["count"] for r in gated.groupBy("status").count().collect()}
    total, bad = sum(g.values()), g.get("QUARANTINE", 0)
    m = meta.first()
    share = bad / total if total else 1.0
    rows = [
        ("gate", "FAIL" if share > max_quarantined else "WARN" if bad else "OK", f"{bad} of {total} symbols quarantined"),
        ("panel", "OK" if m.rows else "FAIL", f"{m.rows} rows, {m.symbols} symbols, {m.first_session}..{m.last_session}"),
        ("labels", "OK" if m.labels_resolved else "WARN", f"{m.labels_resolved} resolved, {m.labels_pending} pending"),
        ("leaks", "FAIL" if leaks else "OK", ", ".join(leaks) or "no formula looks ahead"),
    ]
    return spark.createDataFrame(rows, "check string, status string, detail string")


def overall(rows: DataFrame) -> str:
    found = {r.status for r in rows.select("status").distinct().collect()}
    return max(found, key=_ORDER.index, default="OK")


def to_html(rows: DataFrame, title: str = "Daily run", shown: int = 60) -> str:
    got = rows.limit(shown + 1).collect()
    lines = "".join(f"<tr class={r.status.lower()}><td>{html.escape(r.check)}</td><td>{r.status}</td><td>{html.escape(r.detail)}</td></tr>" for r in got[:shown])
    more = f"<p>+{rows.count() - shown} more</p>" if len(got) > shown else ""
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}: {overall(rows)}</h1><table>{lines}</table>{more}"
