"""What a query may do, by its parsed plan: one statement, reading only, known tables.

Words inside literals or names mean nothing here. This is the one module that uses Spark's internal parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

from tamarind.plans.dialect import tokens

#: Plan nodes that write or change something, by the ends of their names.
CHANGES = ("Command", "InsertIntoStatement", "CreateTable", "ReplaceTable", "DropTable", "DropView", "DeleteFromTable", "UpdateTable", "MergeIntoTable", "TruncateTable", "AlterTable", "CreateNamespace", "DropNamespace", "SetCatalogAndNamespace", "CacheTable", "UncacheTable", "RefreshTable", "LoadData")
# Words no query may have outside literals.
BLOCKED = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "MERGE")


@dataclass
class Verdict:
    ok: bool
    kind: str = ""  # security, syntax, schema, runtime, connection
    message: str = ""
    tables: list[str] = field(default_factory=list)
    limit: bool = False  # whether the query ends in a limit of its own


def _code(sql: str) -> str:
    """The text without literals, quoted names and comments."""
    return "".join(" " if t[:1] in ("'", '"', "`") else t for t in tokens(sql))


def check_text(sql: str) -> Verdict:
    """The checks that need no parser: nothing blank, no comment, no second statement, no blocked word."""
    code = _code(sql)
    if not code.strip():
        return Verdict(False, "syntax", "the query is empty")
    if "--" in code or "/*" in code:
        return Verdict(False, "security", "comments are not allowed")
    if ";" in code.strip().rstrip(";"):
        return Verdict(False, "security", "more than one statement")
    if m := re.search(rf"(?i)(?<![\w.])({'|'.join(BLOCKED)})(?!\w|\s*\()", code):
        return Verdict(False, "security", f"{m[1].upper()} is not allowed")
    return Verdict(True)


def check(spark: SparkSession, sql: str) -> Verdict:
    """Text checks, then the parsed plan: reading nodes only; its tables; whether its root is a limit."""
    first = check_text(sql)
    if not first.ok:
        return first
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except ParseException as e:
        return Verdict(False, "syntax", str(e).split("\n")[0])
    names: list[str] = []
    found: list[str] = []
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        names.append(name)
        if name == "UnresolvedRelation":
            found.append(node.tableName().replace("`", ""))
        for children in (node.children(), node.innerChildren()):
            for i in range(children.size()):
                child = children.apply(i)
                if hasattr(child, "children"):
                    stack.append(child)
        for e in _subqueries(node):
            stack.append(e)
    if bad := [n for n in names if n.endswith(CHANGES)]:
        return Verdict(False, "security", f"{bad[0]} is not a query")
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bWITH\s+|,\s*)(\w+)\s+AS\s*\(", _code(sql))}
    return Verdict(True, tables=sorted({t for t in found if t.lower() not in ctes}), limit=names[0] in ("GlobalLimit", "LocalLimit", "Limit"))


def _subqueries(node) -> list:
    out = []
    try:
        found = node.subqueries()
        out = [found.apply(i) for i in range(found.size())]
    except Exception:  # noqa: BLE001, an unresolved node may not list them
        pass
    return out


def analyse(spark: SparkSession, sql: str, args: dict | None = None) -> Verdict:
    """check(), then the analyzer: unknown tables and columns are found without running anything."""
    v = check(spark, sql)
    if not v.ok:
        return v
    try:
        spark.sql(sql.strip().rstrip(";"), args=args or {})
    except Exception as e:  # noqa: BLE001
        return Verdict(False, classify(e), str(e).split("\n")[0], v.tables)
    return v


def classify(error: Exception | str) -> str:
    """syntax, schema, runtime or connection. Spark's own errors are told by their condition, others by their words."""
    if isinstance(error, ParseException):
        return "syntax"
    if isinstance(error, AnalysisException):
        return "schema" if (error.getCondition() or "").startswith(("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "UNRESOLVED_ROUTINE", "FIELD_NOT_FOUND", "UNRESOLVED_FIELD")) else "syntax"
    text = str(error).lower()
    if any(w in text for w in ("connection refused", "access denied", "can't connect", "lost connection", "gone away", "not installed")):
        return "connection"
    if any(w in text for w in ("syntax error", "unknown column", "no such column", "ambiguous column", "does not exist", "unrecognized token")):
        return "syntax"
    return "runtime"
