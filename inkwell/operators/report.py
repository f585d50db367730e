"""HTML and JSON reports of a run; Spark aggregates, the driver renders a few rows."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame


#: Colours of a change by its kind.
COLOURS = {"better": "#16803c", "worse": "#b42318", "same": "#666", "none": "#666"}


def _shown(value: object) -> str:
    return html.escape("" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value))


def _rows(head: list[str], rows: list[list[str]]) -> str:
    cells = "".join(f"<th>{html.escape(c)}</th>" for c in head)
    return f"<table><tr>{cells}</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def _table(title: str, df: DataFrame) -> str:
    return f"<h2>{html.escape(title)}</h2>" + _rows(df.columns, [[_shown(v) for v in r] for r in df.collect()])


def comparison(title: str, compared: DataFrame, name: str, values: list[str]) -> str:
    """A table of compare_runs(): each value with its signed change, coloured by whether it is better or worse."""
    rows = []
    for r in compared.orderBy(name).collect():
        cells = [_shown(r[name])]
        for v in values:
            change, kind = r[f"{v}_change"], r[f"{v}_kind"]
            sign = "" if change is None else f" <span style=color:{COLOURS[kind]}>{change:+.3f}</span>"
            cells.append(_shown(r[v]) + sign)
        rows.append(cells)
    return f"<h2>{html.escape(title)}</h2>" + _rows([name, *values], rows)


def bars(title: str, df: DataFrame, name: str, share: str) -> str:
    """A bar for each row of an aggregate, as long as its share between 0 and 1."""
    rows = [[_shown(r[name]), f"<div style='background:#3b6fb6;height:1em;width:{max(0.0, min(1.0, r[share] or 0.0)) * 20:.1f}em'></div>", _shown(r[share])] for r in df.orderBy(name).collect()]
    return f"<h2>{html.escape(title)}</h2>" + _rows([name, "", share], rows)


def html_text(title: str, sections: dict[str, DataFrame], extra: list[str] | None = None) -> str:
    """Sections are aggregates: categories, benchmarks, clusters; extra: comparison() and bars() of this module."""
    body = "".join(_table(t, df) for t, df in sections.items()) + "".join(extra or [])
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"


def html_report(path: str, title: str, sections: dict[str, DataFrame], extra: list[str] | None = None) -> None:
    Path(path).write_text(html_text(title, sections, extra), encoding="utf-8")


def json_report(path: str, row: DataFrame) -> None:
    """A one-row aggregate as JSON."""
    Path(path).write_text(json_text(row), encoding="utf-8")


def json_text(row: DataFrame) -> str:
    return json.dumps(row.first().asDict(recursive=True), indent=1, default=str)
