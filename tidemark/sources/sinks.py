"""Reports and exports of small results: drift as JSON, CSV and Markdown, scores as one CSV file, text summaries."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame

MOST_ROWS = 100_000


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report holds at most {MOST_ROWS} rows")
    return [r.asDict() for r in rows]


def drift_json(results: DataFrame) -> str:
    rows = _rows(results)
    return json.dumps({"total": len(rows), "drifted": sum(bool(r["drift_detected"]) for r in rows), "results": rows}, indent=2, default=str)


def drift_csv(results: DataFrame) -> str:
    out = io.StringIO()
    w = csv.DictWriter(out, results.columns, lineterminator="\n")
    w.writeheader()
    w.writerows(_rows(results))
    return out.getvalue()


def drift_markdown(results: DataFrame) -> str:
    rows = _rows(results)
    hit = [r for r in rows if r["drift_detected"]]
    lines = ["# Drift", "", f"{len(hit)} of {len(rows)} metrics drifted.", "", "| metric | score | drift | finding |", "|---|---|---|---|"]
    return "\n".join([*lines, *(f"| {r['metric']} | {r['drift_score']:.4f} | {'yes' if r['drift_detected'] else 'no'} | {r['interpretation']} |" for r in rows)]) + "\n"


def report(df: DataFrame, kind: str, title: str = "Report") -> str:
    """A small result as the text of a csv, json or html report; another kind raises."""
    rows = _rows(df)
    if kind == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, df.columns, lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
        return out.getvalue()
    if kind == "json":
        return json.dumps({"title": title, "columns": df.columns, "rows": rows}, indent=2, default=str)
    if kind == "html":
        cells = lambda values, tag: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
        body = "\n".join(f"<tr>{cells(r.values(), 'td')}</tr>" for r in rows)
        return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head>\n<body><h1>{html.escape(title)}</h1>\n<table>\n<tr>{cells(df.columns, 'th')}</tr>\n{body}\n</table></body></html>\n"
    raise ValueError(f"no report of kind {kind}")


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for results small enough for one task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def retention_summary(row: dict) -> str:
    return f"{row['retained']} customers stayed ({row['retention_rate']} %), {row['churned']} left ({row['churn_rate']} %), {row['new']} are new, of whom {row['reactivated']} had bought before. Revenue changed by {row['revenue_change_pct']} %."


def cohort_summary(rows: list[dict]) -> str:
    if not rows:
        return "There are no cohorts."
    best, worst = max(rows, key=lambda r: (r["total_revenue"], r["cohort_id"])), min(rows, key=lambda r: (r["total_revenue"], r["cohort_id"]))
    return f"{len(rows)} cohorts. The best is {best['cohort_id']} with {best['total_revenue']}, the weakest {worst['cohort_id']} with {worst['total_revenue']}."
