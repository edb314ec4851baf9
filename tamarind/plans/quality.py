"""How far a query fits its question: semantic rules, structure score, confidence, and why a result is empty."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.plans.outline import AGGREGATES, Outline

# What the words of a question call for in its query. They are the default of a parameter.
CUES = {
    "SUM": ("tổng",),
    "AVG": ("trung bình", "bình quân"),
    "COUNT": ("bao nhiêu", "số lượng", "đếm", "có mấy"),
    "MAX": ("lớn nhất", "cao nhất", "max"),
    "MIN": ("nhỏ nhất", "thấp nhất", "ít nhất", "min"),
    "ORDER BY": ("gần nhất", "mới nhất", "gần đây", "cuối cùng"),
    "a time filter": ("hôm nay", "hôm qua", "tuần này", "tuần trước", "tuần qua", "tháng này", "tháng trước", "tháng qua", "năm nay"),
}
# Weights of the confidence, and from what it passes.
WEIGHTS = {"sql_executable": 0.3, "structure": 0.3, "entity_valid": 0.2, "semantic_ok": 0.1, "has_rows": 0.1}
PASS_FROM = 0.6
#: Steps of a column's name that tell a time.
TIME_STEPS = frozenset({"time", "date", "day", "month", "year", "at"})


def called_for(question: str, cues: dict[str, tuple[str, ...]] = CUES) -> list[str]:
    """What the words of a question call for, in the order of the cues; a cue counts as whole words."""
    said = f" {' '.join(re.findall(r'[^\W_]+', question.lower()))} "
    return [need for need, words in cues.items() if any(f" {w} " in said for w in words)]


def _has(need: str, o: Outline) -> bool:
    if need == "ORDER BY":
        return bool(o.order_by)
    if need == "a time filter":
        return any(TIME_STEPS & set(c.lower().split("_")) for c in o.filtered)
    used = any(f == need for f, _, _ in o.aggregates)
    # The greatest or least may also be the first of an order.
    return used or need == "MAX" and any(d for _, d in o.order_by) or need == "MIN" and any(not d for _, d in o.order_by)


def semantic_warnings(question: str, o: Outline, cues: dict[str, tuple[str, ...]] = CUES) -> list[str]:
    """What the question's words call for and the query lacks; and all columns where one figure was asked for."""
    needs = called_for(question, cues)
    out = [n for n in needs if not _has(n, o)]
    return out + (["no SELECT *"] if o.star and {"SUM", "AVG", "COUNT"} & set(needs) else [])


def structure_score(question: str, o: Outline, entities: dict[str, object], schema: dict[str, list[str]], entity_columns: dict[str, list[str]], cues: dict[str, tuple[str, ...]] = CUES) -> tuple[float, list[str]]:
    """(score of 0 to 1, issues): a quarter each for known tables, known columns, filters for the entities, aggregates asked for.

    A query without any filter column has 0.15 of its second quarter. Where only some of the entities or aggregates
    are met, so is the quarter.
    """
    known = {c.lower() for cols in schema.values() for c in cols}
    strange = {t for t in o.tables if t not in schema}
    odd = {c for c in o.filtered if c.lower() not in known}
    issues = [*(["no table"] if not o.tables else []), *([f"unknown tables {sorted(strange)}"] if strange else []), *([f"unknown columns {sorted(odd)}"] if odd else [])]
    used = {c.lower() for c in o.filtered}
    expected = [set(entity_columns[k]) for k in entities if entity_columns.get(k)]
    if entities and not used:
        issues.append("no filter for the entities")
        met = 0.0
    else:
        met = sum(bool(cols & used) for cols in expected) / len(expected) if expected else 1.0
    needs = [n for n in called_for(question, cues) if n in AGGREGATES]
    figures = sum(_has(n, o) for n in needs) / len(needs) if needs else 1.0
    parts = [0.25 * (bool(o.tables) and not strange), 0.0 if odd else 0.25 if used else 0.15, 0.25 * met, 0.25 * figures]
    return round(sum(round(p, 3) for p in parts), 2), issues


def confidence(executed: Column, structure: Column, entity_valid: Column, semantic_ok: Column, rows: Column) -> Column:
    """struct<score, passed>: the weighted sum, two decimals, passed from PASS_FROM on. Nulls count as false or 0."""
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    total = yes(executed, WEIGHTS["sql_executable"]) + F.round(F.least(F.coalesce(structure, F.lit(0.0)), F.lit(1.0)) * WEIGHTS["structure"], 3)
    total = total + yes(entity_valid, WEIGHTS["entity_valid"]) + yes(semantic_ok, WEIGHTS["semantic_ok"]) + yes(rows > 0, WEIGHTS["has_rows"])
    score = F.round(total, 2)
    return F.struct(score.alias("score"), (score >= PASS_FROM).alias("passed"))


def missing_entities(wanted: DataFrame, key: str, value: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, value) pairs whose value no row of the key's table has: one anti join a key, for whole batches."""
    out = None
    for name, (df, column) in tables.items():
        part = wanted.where(F.col(key) == name).join(df.select(F.col(column).cast("string").alias(value)).distinct(), value, "left_anti").select(key, value)
        out = part if out is None else out.unionByName(part)
    return out


def explain_empty(entities: dict[str, str], missing: set[str], enums: dict[str, list[str]], as_of: date) -> tuple[str, list[str]]:
    """('PASS_EMPTY' or 'DATA_ERROR', why) for a query that ran and found nothing."""
    why = [f"{k} {entities[k]} does not exist" for k in sorted(missing) if k in entities]
    start, end = entities.get("start_date"), entities.get("end_date")
    if start and end and start > end:
        why.append(f"start_date {start} is after end_date {end}")
    far = as_of.replace(year=as_of.year + 1, day=min(as_of.day, 28)).isoformat()
    why += [f"{k} {v} is too far ahead" for k, v in (("start_date", start), ("end_date", end)) if v and v > far]
    why += [f"{k} {entities[k]} is none of {v}" for k, v in enums.items() if k in entities and entities[k].upper() not in {x.upper() for x in v}]
    return ("DATA_ERROR" if why else "PASS_EMPTY"), why
