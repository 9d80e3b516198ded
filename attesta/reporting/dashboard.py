"""A self-contained HTML page of a run's small result tables."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

_STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse;margin:.5em 0 1.5em}td,th{border:1px solid #ccc;padding:.25em .6em;text-align:left}.cards{display:flex;gap:1em}.card{border:1px solid #ccc;padding:.6em 1em}.card b{display:block;font-size:1.5em}.banner{padding:.6em 1em;color:#fff}.BLOCKED{background:#a22}.WARNING{background:#a70}.PASSED{background:#272}"


def cell(value: object) -> str:
    return "-" if value is None else escape(f"{value:.1f}" if isinstance(value, float) else str(value))


def table(df: DataFrame, order: list[str], limit: int = 200) -> str:
    """A table of the first rows; the limit is the report's, which says how many rows there are."""
    n = df.count()
    rows = df.orderBy(*order).limit(limit).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    more = f"<p>first {limit} of {n} rows</p>" if n > limit else ""
    return f"<table><tr>{head}</tr>{body}</table>{more}"


def render(title: str, cards: dict[str, object], gate_status: str, reasons: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """The page: banner of the gate, cards of figures, and the tables."""
    shown = "".join(f'<div class="card">{escape(k)}<b>{cell(v)}</b></div>' for k, v in cards.items())
    parts = "".join(f"<h2>{escape(k)}</h2>{table(df, order)}" for k, (df, order) in tables.items())
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style><h1>{escape(title)}</h1><div class="banner {escape(gate_status)}">{escape(gate_status)} {escape(reasons)}</div><div class="cards">{shown}</div>{parts}'
