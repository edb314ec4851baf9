"""What a query is made of, read from Spark's parsed plan: tables, columns, filters, aggregates, order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

AGGREGATES = frozenset({"SUM", "AVG", "COUNT", "MAX", "MIN"})
_COMPARISONS = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "Like": "LIKE"}


@dataclass
class Outline:
    tables: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)  # plain columns of the outermost list
    star: bool = False
    where: list[tuple[str, str, object]] = field(default_factory=list)  # column, operator, literal: what all rows must meet
    filtered: list[str] = field(default_factory=list)  # every column in a filter or join condition, in order
    group_by: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str, str]] = field(default_factory=list)  # function, column or '*', alias
    order_by: list[tuple[str, bool]] = field(default_factory=list)  # column, descending
    limit: int | None = None


@dataclass
class _Node:
    kind: str
    fields: dict
    children: list[_Node]

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)


def _tree(flat: list[dict]) -> _Node:
    """A tree out of its nodes in preorder, each with its number of children."""
    root: _Node | None = None
    open_: list[tuple[_Node, int]] = []
    for d in flat:
        node = _Node(d["class"].rpartition(".")[2].rstrip("$"), d, [])
        if open_:
            parent, left = open_.pop()
            parent.children.append(node)
            if left > 1:
                open_.append((parent, left - 1))
        else:
            root = node
        if d["num-children"]:
            open_.append((node, d["num-children"]))
    return root


def _name(n: _Node) -> str:
    """The last part of a name, as '[a, b]' gives 'b'."""
    return re.split(r",\s*", n.fields.get("nameParts", n.fields.get("multipartIdentifier", "[]"))[1:-1])[-1]


def _columns(n: _Node) -> list[str]:
    return [_name(x) for x in n.walk() if x.kind == "UnresolvedAttribute"]


def _literal(n: _Node) -> object:
    v, kind = n.fields.get("value"), n.fields.get("dataType")
    if v is None or kind in ("integer", "long", "short", "byte"):
        return None if v is None else int(v)
    return float(v) if kind in ("double", "float") or str(kind).startswith("decimal") else v


def _conjuncts(n: _Node) -> Iterator[_Node]:
    if n.kind == "And":
        for c in n.children:
            yield from _conjuncts(c)
    else:
        yield n


def outline(spark: SparkSession, sql: str) -> Outline | None:
    """The outline of one statement, or None where it doesn't parse. Inner queries add their tables, filters and aggregates."""
    try:
        flat = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";")).toJSON())
    except ParseException:
        return None
    out, outermost = Outline(), True
    for n in _tree(flat).walk():
        expressions = lambda key: [_tree(e) for e in n.fields.get(key) or []]  # noqa: B023, E731
        if n.kind == "UnresolvedRelation":
            out.tables.append(_name(n))
        elif n.kind in ("Filter", "UnresolvedHaving", "Join"):
            for key in ("condition", "havingCondition"):
                if n.fields.get(key):
                    whole = _tree(n.fields[key])
                    out.filtered += _columns(whole)
                    for c in _conjuncts(whole):
                        if n.kind == "Filter" and c.kind in _COMPARISONS and [x.kind for x in c.children] == ["UnresolvedAttribute", "Literal"]:
                            out.where.append((_name(c.children[0]), _COMPARISONS[c.kind], _literal(c.children[1])))
        elif n.kind == "GlobalLimit" and outermost:
            bound = _tree(n.fields["limitExpr"])
            out.limit = _literal(bound) if bound.kind == "Literal" else None
        elif n.kind == "Sort":
            for e in expressions("order"):
                out.order_by += [(c, "Descending" in str(e.fields.get("direction"))) for c in _columns(e)[:1]]
        elif n.kind in ("Project", "Aggregate"):
            if n.kind == "Aggregate" and outermost:
                out.group_by = [c for e in expressions("groupingExpressions") for c in _columns(e)]
            for e in expressions("projectList" if n.kind == "Project" else "aggregateExpressions"):
                calls = [x for x in e.walk() if x.kind == "UnresolvedFunction" and _name(x).upper() in AGGREGATES]
                out.star |= e.kind == "UnresolvedStar"
                for x in calls:
                    f, cols = _name(x).upper(), _columns(x)
                    out.aggregates.append((f, cols[0] if cols else "*", e.fields["name"] if e.kind == "Alias" else f.lower()))
                if outermost and not calls:
                    out.columns += _columns(e)[:1]
            outermost = False
    return out
