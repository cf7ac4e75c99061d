"""Reports of small aggregates: Markdown tables, and pages with their data embedded."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

#: A report is for reading; a longer result belongs in a table.
MOST_ROWS = 10_000


def report_rows(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """All rows of an aggregate; an error, not a cut, if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes {most} rows at most; aggregate first or write a table")
    return [r.asDict(recursive=True) for r in rows]


def embedded(value: object) -> str:
    """JSON that cannot close or comment out the script element around it, and reads back equal."""
    return json.dumps(value, default=str, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def _cell(value: object) -> str:
    shown = "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)
    return shown.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def markdown(title: str, df: DataFrame, most: int = MOST_ROWS) -> str:
    names = df.columns
    lines = [f"# {title}", "", "| " + " | ".join(map(_cell, names)) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join(_cell(r[n]) for n in names) + " |" for r in report_rows(df, most)]
    return "\n".join(lines) + "\n"


def page(title: str, tables: dict[str, DataFrame], most: int = MOST_ROWS) -> str:
    """An HTML page: a table for each result, and all of them as JSON for scripts."""
    out, data = [], {}
    for name, df in tables.items():
        rows, names = report_rows(df, most), df.columns
        data[name] = rows
        head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if r[n] is None else str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    safe = html.escape(title)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{safe}</title></head><body><h1>{safe}</h1>{"".join(out)}<script type="application/json" id="data">{embedded(data)}</script></body></html>\n'


def write_report(text: str, path: str) -> None:
    """Write a report to a file, never inside a git work tree."""
    target = Path(path).resolve()
    if any((p / ".git").exists() for p in target.parents):
        raise ValueError(f"{target} lies inside a git work tree")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
