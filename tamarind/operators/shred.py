"""Deeply nested records to flat tables by adjacency shredding.

Every JSON record becomes rows of one adjacency table (record, node, parent, label, ordinal, kind, scalar).
Entity tables come from joining object nodes with their scalar children and pivoting the labels; since both
sides of that join have the object's node as key, it is one grouped pivot, combined before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "rec string, node string, parent string, label string, ordinal int, kind string, scalar string"
_FIELDS = ["rec", "node", "parent", "label", "ordinal", "kind", "scalar"]
_ARROW = pa.schema([("rec", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])
_EMIT_ROWS = 50_000


def _kind(v: object) -> str:
    return "null" if v is None else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"


def _scalar(v: object) -> str | None:
    return v if isinstance(v, str) else "true" if v is True else "false" if v is False else None if v is None or isinstance(v, (dict, list)) else json.dumps(v)


def nodes(df: DataFrame, record_id: str, text: str, under: list[str] | None = None, lists: frozenset[str] | set[str] = frozenset(), packed: frozenset[str] | set[str] = frozenset(), keep: set[str] | None = None) -> DataFrame:
    """The adjacency table of the JSON objects in column `text`.

    node is the dotted path of places from the root ('' is the root); label is the field name, and an array's
    elements carry its label with their place as ordinal. `under`: only these top-level fields are shredded.
    `lists`: labels that hold lists; a lone object, string or other scalar there counts as a list of one.
    `packed`: labels whose value may itself be JSON in a string. `keep`: only nodes with these labels are stored
    (all are walked), which prunes the table to the entities that are wanted. Null, blank, broken and non-object records, and
    packed strings that are no JSON or nested deeper than a parser goes, give nothing; neither does a null record id. Null elements keep their place and give a node of kind 'null'.
    A record that is delivered twice gives its nodes twice, with equal keys.
    """
    only = set(under) if under is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def walk(rec: str, root: dict) -> None:
            stack = [("", root)]
            if keep is None:
                out.append((rec, "", None, None, 0, "object", None))
            while stack:
                at, obj = stack.pop()
                pre = at + "." if at else ""
                if isinstance(obj, dict):
                    children = [(i, k, 0, v) for i, (k, v) in enumerate(obj.items()) if at or only is None or k in only]
                else:
                    children = [(i, None, i, v) for i, v in enumerate(obj[1])]
                for i, label, ordinal, v in children:
                    if label is None:
                        label = obj[0]
                    else:
                        if label in packed and isinstance(v, str):
                            try:
                                v = json.loads(v)
                            except (ValueError, RecursionError):
                                continue
                        if label in lists and v is not None and not isinstance(v, list):
                            v = [v]
                    node, kind = f"{pre}{i}", _kind(v)
                    if keep is None or label in keep:
                        out.append((rec, node, at, label, ordinal, kind, _scalar(v)))
                    if kind == "object":
                        stack.append((node, v))
                    elif kind == "array":
                        stack.append((node, (label, v)))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * len(_FIELDS)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
            out.clear()
            return made

        for b in batches:
            for rec, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rec is None or not raw:
                    continue
                try:
                    root = json.loads(raw)
                except (ValueError, RecursionError):
                    continue
                if isinstance(root, dict):
                    walk(rec, root)
                if len(out) >= _EMIT_ROWS:
                    yield batch()
        if out:
            yield batch()

    return df.select(F.col(record_id).cast("string"), F.col(text).cast("string")).mapInArrow(run, NODE_SCHEMA)


def entities(adjacency: DataFrame, labels: list[str], scalars: list[str], lists: list[str] = []) -> DataFrame:  # noqa: B006
    """The objects under `labels` as one table: rec, label, node, parent, pos, a column for each scalar child, an array for each list.

    parent is the node of the nearest object above (arrays are skipped), so child tables join on (rec, parent).
    A list column holds (pos, value) of the list's scalar elements, in order. An object without such children,
    or with null ones, has nulls and empty arrays. Repeated deliveries of a record fold into one row.
    """
    is_object = F.col("label").isin(labels) & (F.col("kind") == "object")
    is_scalar = F.col("label").isin(scalars) & ~F.col("kind").isin("object", "array")
    is_element = F.col("label").isin(lists or [""]) & ~F.col("kind").isin("object", "array", "null")
    owner = F.when(is_object, F.col("node")).when(is_element, enclosing_object(F.col("parent"))).otherwise(F.col("parent"))
    keyed = adjacency.where(is_object | is_scalar | is_element).withColumn("owner", owner)
    pick = lambda want, value: F.max(F.when(want, value))
    grouped = keyed.groupBy("rec", "owner").agg(
        pick(is_object, F.col("label")).alias("label"),
        pick(is_object, F.col("parent")).alias("_list"),
        pick(is_object, F.col("ordinal")).alias("pos"),
        *[pick(is_scalar & (F.col("label") == s), F.col("scalar")).alias(s) for s in scalars],
        *[F.array_sort(F.collect_set(F.when(is_element & (F.col("label") == c), F.struct(F.col("ordinal").alias("pos"), F.col("scalar").alias("value"))))).alias(c) for c in lists],
    )
    return grouped.where(F.col("pos").isNotNull()).select("rec", "label", F.col("owner").alias("node"), enclosing_object(F.col("_list")).alias("parent"), "pos", *scalars, *lists)


def enclosing_object(list_node: Column) -> Column:
    """The object that owns a list node: the list's own path without its last step."""
    return F.regexp_replace(list_node, r"\.?[^.]*$", "")


def elements(entity: DataFrame, column: str) -> DataFrame:
    """A list column of an entity table as the child table: rec, parent (the entity's node), parent_pos, pos, value."""
    return entity.select("rec", F.col("node").alias("parent"), F.col("pos").alias("parent_pos"), F.explode(column).alias("_e")).select("rec", "parent", "parent_pos", "_e.pos", "_e.value")
