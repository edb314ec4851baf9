"""SQL written for MySQL or SQLite, made to read in Spark. String literals and comments are never touched."""

from __future__ import annotations

import re
from collections.abc import Callable

# Strftime and DATE_FORMAT codes and Spark's pattern letters.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%M": "mm", "%s": "ss", "%S": "ss", "%y": "yy", "%j": "DDD"}
_TOKEN = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^'\"`\-/]+|[-/]", re.S)


def tokens(sql: str) -> list[str]:
    """The text in pieces: literals, quoted names and comments whole, the rest between them."""
    return _TOKEN.findall(sql)


def _pattern(p: str) -> str:
    return re.sub(r"%[A-Za-z]", lambda m: CODES.get(m[0], m[0]), p)


def _call(sql: str, name: str, make: Callable[[list[str]], str]) -> str:
    """Every call of a function replaced by make(arguments), inner calls first."""
    while True:
        hits = list(re.finditer(rf"(?i)\b{name}\s*\(", _blank(sql)))
        if not hits:
            return sql
        m = hits[-1]
        depth, i, start, args, quote = 1, m.end(), m.end(), [], None
        while i < len(sql) and depth:
            c = sql[i]
            if quote:
                quote = None if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "," and depth == 1:
                args.append(sql[start:i].strip())
                start = i + 1
            i += 1
        args.append(sql[start : i - 1].strip())
        sql = sql[: m.start()] + make(args) + sql[i:]


def _blank(sql: str) -> str:
    """The text with the inside of literals blanked, places kept."""
    return "".join(t if t[:1] not in ("'", '"', "`") and not t.startswith(("--", "/*")) else t[0] + " " * (len(t) - 2) + t[-1] for t in tokens(sql))


def to_spark(sql: str) -> str:
    """One statement in Spark's dialect: quoted names, date formats and arithmetic, and the functions Spark lacks."""
    sql = "".join(f"`{t[1:-1]}`" if t[:1] == '"' else t for t in tokens(sql)).strip()
    sql = sql[:-1].rstrip() if sql.endswith(";") else sql
    lit = lambda a: _pattern(a) if a[:1] == "'" else a
    sql = _call(sql, "strftime", lambda a: f"date_format__done({a[1]}, {lit(a[0])})")
    sql = _call(sql, "DATE_FORMAT", lambda a: f"date_format__done({a[0]}, {lit(a[1])})").replace("date_format__done(", "date_format(")
    for name, sign in (("DATE_SUB", "-"), ("DATE_ADD", "+")):
        if re.search(rf"(?i)\b{name}\s*\(.*?INTERVAL", sql, re.S):
            sql = _call(sql, name, lambda a, sign=sign, name=name: f"({a[0]} {sign} {a[1]})" if a[1].upper().startswith("INTERVAL") else f"{name.lower()}__done({', '.join(a)})")
            sql = sql.replace(f"{name.lower()}__done(", f"{name.lower()}(")
    sql = _call(sql, "JULIANDAY", lambda a: f"(unix_seconds(timestamp({a[0]})) / 86400D + 2440587.5D)")
    sql = _call(sql, "GROUP_CONCAT", lambda a: f"array_join(collect_list({a[0]}), {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)})")
    sql = _call(sql, "TOTAL", lambda a: f"coalesce(sum({a[0]}), 0D)")
    return sql
