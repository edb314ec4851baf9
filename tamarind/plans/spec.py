"""Query templates with named slots, bound as parameters: values never become SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tamarind.plans import dialect
from tamarind.plans.outline import outline

# Slot names and the entity keys that may fill them, in order.
ALIASES = {"account_number": ("account_no", "from_account_no"), "to_account_number": ("to_account_no",), "min_amount": ("amount_min", "amount"), "max_amount": ("amount_max", "amount"), "status": ("trans_status",), "recipient_name": ("to_account_fullname",)}
SLOT = re.compile(r"\{(\w+)\}")


@dataclass
class Bound:
    sql: str
    args: dict[str, object] = field(default_factory=dict)
    unfilled: list[str] = field(default_factory=list)


def value_for(slot: str, entities: dict[str, object]) -> object | None:
    """The entity of a slot: its own key, its aliases, or the slot it is an alias of."""
    for key in (slot, *ALIASES.get(slot, ()), *(k for k, v in ALIASES.items() if slot in v)):
        if entities.get(key) not in (None, ""):
            return entities[key]
    return None


def bind(template: str, entities: dict[str, object]) -> Bound:
    """Slots as named parameters. A slot inside a literal ('%{name}%') becomes a concatenation around its parameter."""
    out, args, missing = [], {}, []

    def one(slot: str) -> str:
        v = value_for(slot, entities)
        if v is None:
            missing.append(slot)
        else:
            args[slot] = v
        return f":{slot}"

    for piece in dialect.tokens(template):
        if piece[:1] == "'" and SLOT.search(piece):
            inner = SLOT.split(piece[1:-1])
            parts = [one(x) if i % 2 else f"'{x}'" for i, x in enumerate(inner) if i % 2 or x]
            out.append(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")
        else:
            out.append(SLOT.sub(lambda m: one(m[1]), piece))
    return Bound("".join(out), args, list(dict.fromkeys(missing)))


# What a slot gets when templates are tried out without a question.
TRIAL = {"date": "2026-01-01", "account": "0000000000", "amount": 0, "id": "X", "name": "x", "year": 2026, "month": "2026-01"}


def trial(template: str) -> Bound:
    """A template bound to made-up values by the slots' names, so that its SQL can be analysed before anybody asks."""
    slots = SLOT.findall(template)
    return bind(template, {s: next((v for k, v in TRIAL.items() if k in s), "x") for s in slots})


def choose(templates: dict[str, str], intent: str, fallback: str | None = None) -> str | None:
    """The template of an intent: its own, else the first whose id holds the intent's, else the fallback."""
    if intent in templates:
        return templates[intent]
    return next((t for k, t in sorted(templates.items()) if intent and intent in k), fallback)


def ready(bound: Bound, entities: dict[str, object]) -> bool:
    """Whether a template answers without generation: nothing unfilled, and there was something to fill."""
    return not bound.unfilled and bool(entities)


@dataclass
class QuerySpec:
    """A query as data: repairs change the parts, and SQL is written from them at the end."""

    table: str
    columns: list[str] = field(default_factory=list)
    where: list[tuple[str, str, object]] = field(default_factory=list)  # column, operator, value
    group_by: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str, str]] = field(default_factory=list)  # function, column, alias
    order_by: list[tuple[str, bool]] = field(default_factory=list)  # column, descending
    limit: int | None = None

    OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "LIKE")

    def bound(self) -> Bound:
        q = lambda n: f"`{n.replace('`', '')}`"
        aggs = [f"{f}({'*' if c == '*' else q(c)}) AS {q(a)}" for f, c, a in self.aggregates]
        picked = [*map(q, self.group_by), *aggs] if self.aggregates else [q(c) for c in self.columns] or ["*"]
        sql, args = f"SELECT {', '.join(picked)} FROM {q(self.table)}", {}
        conditions = []
        for i, (c, op, v) in enumerate(self.where):
            if op not in self.OPERATORS:
                raise ValueError(f"operator {op}")
            args[f"p{i}"] = v
            conditions.append(f"{q(c)} {op} :p{i}")
        if conditions:
            sql += " WHERE " + " AND ".join(conditions)
        if self.group_by:
            sql += " GROUP BY " + ", ".join(map(q, self.group_by))
        if self.order_by:
            sql += " ORDER BY " + ", ".join(q(c) + (" DESC" if d else "") for c, d in self.order_by)
        return Bound(sql + (f" LIMIT {int(self.limit)}" if self.limit is not None else ""), args)

    def run(self, spark: SparkSession) -> DataFrame:
        b = self.bound()
        return spark.sql(b.sql, args=b.args)


def from_sql(spark: SparkSession, sql: str) -> QuerySpec | None:
    """A query on one table as data; None where it doesn't parse, has another number of tables, or filters that are no plain comparisons."""
    o = outline(spark, sql)
    if o is None or len(o.tables) != 1 or len(o.where) != len(o.filtered):
        return None
    return QuerySpec(o.tables[0], [] if o.star else o.columns, o.where, o.group_by, o.aggregates, o.order_by, o.limit)


def repair(spec: QuerySpec, schema: dict[str, list[str]], entities: dict[str, object], question: str = "") -> QuerySpec:
    """A spec made valid against the schema: known table and columns, filters for the entities at hand, grouped plain columns.

    Unknown columns take the known column of closest spelling, or go. Parts that are fine stay as they are.
    """
    import difflib
    from dataclasses import replace

    table = spec.table if spec.table in schema else next(iter(difflib.get_close_matches(spec.table, schema, 1, 0.4)), next(iter(schema)))
    known = schema[table]

    def col(c: str) -> str | None:
        return c if c in known or c == "*" else next(iter(difflib.get_close_matches(c, known, 1, 0.6)), None)

    where = [(col(c), op, v) for c, op, v in spec.where if col(c)]
    for key, v in entities.items():
        if key in known and not any(c == key for c, _, _ in where):
            where.append((key, "=", v))
    columns = [x for c in spec.columns if (x := col(c))]
    aggregates = [(f, x, a) for f, c, a in spec.aggregates if (x := col(c))]
    group = list(dict.fromkeys([*(x for c in spec.group_by if (x := col(c))), *(columns if aggregates else [])]))
    aliases = {a for _, _, a in aggregates}
    order = [(c if c in aliases else col(c), d) for c, d in spec.order_by if c in aliases or col(c)]
    return replace(spec, table=table, where=where, columns=columns, group_by=group, aggregates=aggregates, order_by=order)


@dataclass
class Retry:
    """When a failed query is tried again: never for connection and security, one repair for each kind, at most two regenerations."""

    most: int = 2
    attempts: list[tuple[str, str, str]] = field(default_factory=list)
    repaired: set[str] = field(default_factory=set)

    def may_repair(self, kind: str) -> bool:
        if kind in ("connection", "security") or kind in self.repaired:
            return False
        self.repaired.add(kind)
        return True

    def may_regenerate(self, kind: str) -> bool:
        return kind not in ("connection", "security") and len(self.attempts) < self.most

    def record(self, sql: str, error: str, kind: str) -> None:
        self.attempts.append((sql, error, kind))
