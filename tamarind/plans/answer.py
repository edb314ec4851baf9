"""Text around a query: prompts for a generator, SQL out of its reply, and results in words."""

from __future__ import annotations

import re
from collections.abc import Callable

Generator = Callable[[str], str]


def schema_text(schema: dict[str, list[tuple[str, str]]], tables: list[str] | None = None) -> str:
    """'table(column type, ...)' a line, of the tables that were routed to."""
    return "\n".join(f"{t}({', '.join(f'{c} {k}' for c, k in cols)})" for t, cols in schema.items() if tables is None or t in tables)


def prompt(question: str, schema: str, entities: dict[str, str], template: str | None = None, error: str | None = None, sql: str | None = None) -> str:
    """The parts a generator needs, each under its name; with `error`, a request to mend `sql`."""
    parts = [("Schema", schema), ("Entities", ", ".join(f"{k}={v}" for k, v in entities.items())), ("Template", template), ("Failed SQL", sql), ("Error", error), ("Question", question)]
    return "\n\n".join(f"# {n}\n{t}" for n, t in parts if t) + "\n\n# Task\nAnswer with one SELECT statement only."


def extract_sql(reply: str | None) -> str:
    """The statement of a reply: thoughts off, fences off, up to the first semicolon; '' where no line begins with SELECT or WITH, as in a refusal."""
    t = re.sub(r"(?s)<think>.*?(?:</think>|$)", "", reply or "")
    if m := re.search(r"(?s)```\w*\s*(.*?)```", t):
        t = m[1]
    m = re.search(r"(?sim)^\s*(?:sql\s*:\s*)?((?:select|with)\s.+)", t)
    return m[1].split(";")[0].strip() if m else ""


def text_table(columns: list[str], rows: list[tuple], most: int = 30) -> str:
    cells = [[str(c) for c in columns], *[["—" if v is None or v == "" else str(v) for v in r] for r in rows[:most]]]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells]
    lines.insert(1, "-+-".join("-" * w for w in width))
    return "\n".join(lines + ([f"(+{len(rows) - most})"] if len(rows) > most else []))


def context(columns: list[str], rows: list[tuple], most: int = 30) -> str:
    """Rows for a model: a table if it is narrow (8 columns, 50 characters a cell), else 'column: value' records."""
    shown = rows[:most]
    if len(columns) <= 8 and all(len(str(v)) <= 50 for r in shown for v in r):
        return text_table(columns, rows, most)
    return "\n\n".join("\n".join(f"{c}: {v}" for c, v in zip(columns, r) if v not in (None, "")) for r in shown)


def explain(columns: list[str], rows: list[tuple] | None) -> str:
    """A result in words: nothing found, one row as its values, several as a count and a table."""
    if rows is None:
        return "Đang chờ kết quả từ hệ thống..."
    if not rows:
        return "Không tìm thấy kết quả nào phù hợp với yêu cầu."
    if len(rows) == 1:
        return " · ".join(f"{c.replace('_', ' ').capitalize()}: **{v}**" for c, v in zip(columns, rows[0]) if v not in (None, "")) + "."
    return f"Có {len(rows)} kết quả.\n{text_table(columns, rows, 15)}"
