"""Schemas that drift between files: every change reported, everything read into one table.

Each file's schema is a graph: fields, their types, and nesting. Two successive schemas of one source are
matched by similarity flooding: scores start from the names and flow along equal edges (child of, of type)
of the pairwise connectivity graph until they settle; consistent one-to-one correspondences are selected
from the settled scores. Reported changes come from those correspondences under an exact check; the unified
table casts and unions all files under one name for each chain of correspondences.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.plans.neighbours import with_previous
from tamarind.plans.shared import cut

#: Objects whose keys are data: a field each, with nothing inside.
MAPS = frozenset({"entities"})
#: Settled when no score moves more than this, or after so many rounds.
RESIDUAL, ROUNDS = 1e-3, 50
#: Weight of edges: nesting, type.
NEST, TYPE = 1.0, 0.5
#: Distinct correspondences the driver may hold; they are pairs of field names, so schema width bounds them.
MOST_PAIRS = 200_000
_FLUSH = 200_000


_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object", type(None): ""}


def json_type(v: object) -> str:
    """string, number, boolean, array or object; '' for null, which has no type."""
    return _KINDS[type(v)]


def _parsed(raw: str | None) -> dict | None:
    try:
        o = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def _walk(obj: dict, maps: frozenset[str], into: dict[str, set[str]]) -> None:
    stack = [("", obj)]
    while stack:
        pre, o = stack.pop()
        for k, v in o.items():
            path, kind = pre + k, _KINDS[type(v)]
            seen = into.get(path)
            if seen is None:
                seen = into[path] = set()
            if kind:
                seen.add(kind)
            if kind == "object" and k not in maps:
                stack.append((path + ".", v))


def file_fields(df: DataFrame, source: str, file: str, raw: str, maps: frozenset[str] = MAPS) -> DataFrame:
    """(source, file, path, type), distinct: the fields of each file, types combined inside every task first.

    Null, blank, broken and non-object lines are ignored; a field that is only ever null has type ''.
    Rows with a null source or file belong to no file and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, set[str]]] = defaultdict(dict)

        def out() -> pa.RecordBatch:
            rows = [(s, f, p, t) for (s, f), fields in held.items() for p, ts in fields.items() for t in (ts or {""})]
            held.clear()
            cols = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["source", "file", "path", "type"])

        for b in batches:
            for s, f, x in zip(*[c.to_pylist() for c in b.columns]):
                if (o := _parsed(x)) is not None and s is not None and f is not None:
                    _walk(o, maps, held[(s, f)])
            if len(held) > _FLUSH // 50:
                yield out()
        yield out()

    cols = [F.col(c).cast("string") for c in (source, file, raw)]
    return df.select(*cols).mapInArrow(run, "source string, file string, path string, type string").distinct()


def file_schemas(fields: DataFrame) -> DataFrame:
    """(source, file, schema): one row a file, its fields as a sorted array of 'path<tab>type[|type]'."""
    per = fields.groupBy("source", "file", "path").agg(F.array_join(F.array_sort(F.array_remove(F.collect_set("type"), "")), "|").alias("types"))
    return per.groupBy("source", "file").agg(F.array_sort(F.collect_list(F.concat_ws("\t", "path", "types"))).alias("schema"))


@lru_cache(50_000)
def _grams(name: str) -> set[str]:
    words = "_".join(re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+|[^\W\d_]+", name)).lower()
    return {f"_{words}_"[i : i + 3] for i in range(len(words))} or {words}


def name_similarity(a: str, b: str) -> float:
    """Dice of the letter trigrams of the last step of two paths, case and style of writing aside."""
    return 1.0 if a == b else _dice(a.rpartition(".")[2], b.rpartition(".")[2])


@lru_cache(200_000)
def _dice(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(old: dict[str, str], new: dict[str, str]) -> tuple[list[str], list[str], np.ndarray]:
    """Settled scores between the fields of two schemas (path -> type), rows old and columns new."""
    a, b = sorted(old), sorted(new)
    types = sorted({*old.values(), *new.values()})
    start = np.array([[name_similarity(p, q) for q in b] for p in a], float).reshape(len(a), len(b))

    def parents(paths: list[str]) -> np.ndarray:
        at = {p: i + 1 for i, p in enumerate(paths)}
        m = np.zeros((len(paths), len(paths) + 1))
        for i, p in enumerate(paths):
            m[i, at.get(p.rpartition(".")[0], 0)] = 1
        return m

    def typed(paths: list[str], kinds: dict[str, str]) -> np.ndarray:
        return np.array([[kinds[p] == t for t in types] for p in paths], float).reshape(len(paths), len(types))

    pa_, pb, ta, tb = parents(a), parents(b), typed(a, old), typed(b, new)
    # An edge's weight is shared among the equal edges that leave its node.
    fan_a, fan_b = np.maximum(pa_.sum(0), 1), np.maximum(pb.sum(0), 1)
    tfan_a, tfan_b = np.maximum(ta.sum(0), 1), np.maximum(tb.sum(0), 1)
    score, kind = start.copy(), np.eye(len(types))
    root = np.ones((1, 1))
    for _ in range(ROUNDS):
        base = start + score
        full = np.zeros((len(a) + 1, len(b) + 1))
        full[0, 0], full[1:, 1:] = root[0, 0], base
        from_parent = pa_ @ (full / np.outer(fan_a, fan_b)) @ pb.T
        from_children = (pa_.T @ base @ pb)[1:, 1:] / np.maximum(np.outer(fan_a[1:], fan_b[1:]), 1)
        from_type = ta @ (kind / np.outer(tfan_a, tfan_b)) @ tb.T
        nxt = base + NEST * (from_parent + from_children) + TYPE * from_type
        kind = np.eye(len(types)) + ta.T @ base @ tb / np.outer(tfan_a, tfan_b)
        nxt /= max(nxt.max(initial=0), 1e-12)
        kind /= max(kind.max(initial=0), 1e-12)
        moved = np.abs(nxt - score).max(initial=0)
        score = nxt
        if moved < RESIDUAL:
            break
    return a, b, score


def correspondences(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, float, int, int]]:
    """(old path, new path, score, rivals there, rivals here) one to one, for fields that go and come.

    Only fields whose parent stays an object take part, so what lies in an object that comes, goes or changes
    type is left to that object. Pairs must agree in type; the best settled score is taken first. Rivals count
    the fields of that type that go, and that come.
    """
    def stays(p: str) -> bool:
        up = p.rpartition(".")[0]
        return not up or (old.get(up) == "object" and new.get(up) == "object" and stays(up))

    goes, comes = [p for p in old if p not in new and stays(p)], [p for p in new if p not in old and stays(p)]
    if not goes or not comes:
        return []
    a, b, score = flood(old, new)
    ia, ib = {p: i for i, p in enumerate(a)}, {p: i for i, p in enumerate(b)}
    ranked = sorted(((-score[ia[p], ib[q]], p, q) for p in goes for q in comes if old[p] and old[p] == new[q]))
    n_old, n_new = Counter(old[p] for p in goes), Counter(new[q] for q in comes)
    taken, out = set(), []
    for s, p, q in ranked:
        if (0, p) not in taken and (1, q) not in taken:
            taken |= {(0, p), (1, q)}
            out.append((p, q, float(-s), n_old[old[p]], n_new[new[q]]))
    return out


def changes_between(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str, float]]:
    """(kind, field, new field or '', score): the changes from one schema to the next.

    A correspondence is reported as 'renamed' if it passes the exact check: no other field of its type
    comes or goes. All else that goes is 'removed', that comes 'added'; a field with another type is 'retyped'.
    """
    def stays(p: str) -> bool:
        up = p.rpartition(".")[0]
        return not up or (old.get(up) == "object" and new.get(up) == "object" and stays(up))

    renamed = {p: (q, s) for p, q, s, x, y in correspondences(old, new) if x == 1 and y == 1}
    arrived = {q for q, _ in renamed.values()}
    out = [("renamed", p, q, s) for p, (q, s) in renamed.items()]
    out += [("removed", p, "", 0.0) for p in old if p not in new and p not in renamed and stays(p)]
    out += [("added", q, "", 0.0) for q in new if q not in old and q not in arrived and stays(q)]
    out += [("retyped", p, "", 0.0) for p in old if p in new and stays(p) and old[p] and new[p] and old[p] != new[p]]
    return out


def _as_dict(schema: list[str]) -> dict[str, str]:
    return dict(x.split("\t") for x in schema)


def _per_pair(pairs: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    """fn(old, new) for each row of pairs; equal pairs of schemas are worked out once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, list] = {}
        for b in batches:
            rows = []
            for s, f, new, old in zip(*[b.column(c).to_pylist() for c in ("source", "file", "schema", "prev_schema")]):
                key = (tuple(old), tuple(new))
                if key not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[key] = fn(_as_dict(old), _as_dict(new))
                rows += [(s, f, *r) for r in memo[key]]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _arrow(schema))], names)

    return pairs.mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def successive(df: DataFrame, source: str, file: str, raw: str, maps: frozenset[str] = MAPS) -> DataFrame:
    """(source, file, schema, prev_schema) for each file that has one before it in its source and differs from it.

    Files of one source follow each other by name, whenever they were loaded. A file without any readable
    record has no schema and is passed over.
    """
    files = file_schemas(file_fields(df, source, file, raw, maps))
    pairs = with_previous(files, "source", "file", ["schema"])
    return pairs.where(F.col("prev_file").isNotNull() & (F.col("prev_schema") != F.col("schema"))).select("source", "file", "schema", "prev_schema")


def changes(df: DataFrame, source: str, file: str, raw: str, maps: frozenset[str] = MAPS) -> DataFrame:
    """(source, file, change_kind, field_path, new_path, score): every change against the file before."""
    names = ["source", "file", "change_kind", "field_path", "new_path", "score"]
    return _per_pair(successive(df, source, file, raw, maps), changes_between, "source string, file string, change_kind string, field_path string, new_path string, score double", names)


def canonical_names(pairs: DataFrame, fields: DataFrame, least_support: int = 2) -> dict[str, str]:
    """Field name -> the name its column has in the unified table.

    Exact renames (no other field of the type comes or goes), however few, and other correspondences seen in at least
    `least_support` files, in either direction, link two names unless names of their components occur in one file,
    which two names of one thing don't; exact ones link first. The name in the most files names its component. Everything
    here is a function of field names, whose number is checked against MOST_PAIRS.
    """
    links = _per_pair(pairs, lambda o, n: [(min(p, q), max(p, q), int(x == y == 1)) for p, q, _, x, y in correspondences(o, n)], "source string, file string, p string, q string, exact int", ["source", "file", "p", "q", "exact"])
    counted = links.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("exact")).where((F.col("n") >= least_support) | (F.col("exact") == 1))
    rows = counted.limit(MOST_PAIRS + 1).collect()
    seen = fields.select("source", "file", "path").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("n")).limit(MOST_PAIRS + 1).collect()
    if max(len(rows), len(seen)) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} distinct field names or pairs: their keys are data; name those objects in `maps`")
    spark = pairs.sparkSession
    near: dict[str, str] = {}

    def root(x: str, up: dict[str, str]) -> str:
        while up[x] != x:
            x = up[x]
        return x

    for r in rows:  # only names that links connect can come into one column
        near.setdefault(r["p"], r["p"]), near.setdefault(r["q"], r["q"])
        near[root(r["q"], near)] = root(r["p"], near)
    both: dict[str, set[str]] = defaultdict(set)
    if rows:
        wanted = F.broadcast(spark.createDataFrame([(p, root(p, near)) for p in near], "path string, part string"))
        f = fields.select("source", "file", "path").distinct().join(wanted, "path")
        together = f.join(f.withColumnRenamed("path", "other"), ["source", "file", "part"]).where("path < other").select("path", "other").distinct()
        found = together.limit(MOST_PAIRS + 1).collect()
        if len(found) > MOST_PAIRS:
            raise ValueError(f"more than {MOST_PAIRS} linked field names occur together: their keys are data; name those objects in `maps`")
        for r in found:
            both[r["path"]].add(r["other"])
            both[r["other"]].add(r["path"])
    uses, up = {r["path"]: r["n"] for r in seen}, {r["path"]: r["path"] for r in seen}
    members = {p: {p} for p in up}
    for r in sorted(rows, key=lambda r: (-r["exact"], -r["n"], r["p"], r["q"])):
        if r["p"] not in up or r["q"] not in up:
            continue
        x, y = root(r["p"], up), root(r["q"], up)
        if x != y and not any(both[m] & members[y] for m in members[x]):
            x, y = (x, y) if (uses[x], y) >= (uses[y], x) else (y, x)
            up[y] = x
            members[x] |= members.pop(y)
    return {p: root(p, up) for p in up}


def _cast(v: object, kind: str) -> str | None:
    """A value as the text of the wanted type; one that is wrapped ({'value': 3, 'unit': 's'}, {'id': 'x'}, ['x']) is unwrapped."""
    if v is None or kind in ("object", "array"):
        return None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True)
    if isinstance(v, list) and len(v) == 1:
        v = v[0]
    if isinstance(v, dict):
        v = v.get("value", v.get("id"))
    if v is None or isinstance(v, (dict, list)):
        return None
    if kind == "number" and isinstance(v, bool):
        return "1" if v else "0"
    return v if isinstance(v, str) else json.dumps(v)


def unify(df: DataFrame, source: str, file: str, line: str, raw: str, maps: frozenset[str] = MAPS) -> DataFrame:
    """(source, file, line, one column a unified field): all readable records in one consistent table.

    A column has the type most files give its field (a tie: the first by name); values of other types are cast,
    wrapped values unwrapped, what can't be cast is null. Nested objects are spread into their fields (dots
    become double underscores), maps and arrays stay JSON text. A field missing in a record is null. A boolean in a
    column of numbers is 1 or 0. uncast() counts what can't be cast.
    """
    wide, cols = _wide(df, source, file, line, raw, maps)
    return wide.select(F.col("s").alias("source"), F.col("f").alias("file"), F.col("n").alias("line"), *[c.alias(n) for n, c in cols])


def uncast(df: DataFrame, source: str, file: str, line: str, raw: str, maps: frozenset[str] = MAPS) -> DataFrame:
    """(column, n_values, n_uncast): for each column of unify(), the values given and how many of them can't be cast and are null there."""
    wide, cols = _wide(df, source, file, line, raw, maps)
    given = lambda i: F.array_contains("g", i)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), given(i).alias("given"), c.isNull().alias("lost")) for i, (n, c) in enumerate(cols)])).alias("c")
    return wide.select(each).where("c.given").groupBy("c.column").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("c.lost").alias("n_uncast"))


def _wide(df: DataFrame, source: str, file: str, line: str, raw: str, maps: frozenset[str]) -> tuple[DataFrame, list]:
    """The records as (s, f, n, v: values as text by column, g: columns that were given a value), and (name, cast value) of the columns."""
    fields = cut(file_fields(df, source, file, raw, maps))
    pairs = with_previous(file_schemas(fields), "source", "file", ["schema"])
    pairs = pairs.where(F.col("prev_file").isNotNull() & (F.col("prev_schema") != F.col("schema")))
    names = canonical_names(pairs, fields)
    votes: dict[str, Counter] = defaultdict(Counter)
    for r in fields.where("type <> ''").groupBy("path", "type").agg(F.count(F.lit(1)).alias("n")).collect():
        votes[names[r["path"]]][r["type"]] += r["n"]
    kinds = {c: min(v.items(), key=lambda x: (-x[1], x[0]))[0] for c, v in votes.items()}
    kept = sorted(c for c, k in kinds.items() if k != "object" or c.rpartition(".")[2] in maps)
    kept = [c for c in kept if all(kinds.get(names.get(up, up), "object") == "object" for up in _uppers(c))]
    shared = df.sparkSession.sparkContext.broadcast((names, {c: i for i, c in enumerate(kept)}, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, at, kind = shared.value
        for b in batches:
            rows = []
            for s, f, n, x in zip(*[c.to_pylist() for c in b.columns]):
                if (o := _parsed(x)) is None:
                    continue
                row: list[str | None] = [None] * len(at)
                given = set()
                stack = [("", o)]
                while stack:
                    pre, obj = stack.pop()
                    for k, v in obj.items():
                        c = to.get(pre + k, pre + k)
                        if c in at:
                            if row[at[c]] is None:
                                row[at[c]] = _cast(v, kind[c])
                            if v is not None:
                                given.add(at[c])
                        elif isinstance(v, dict) and k not in maps:
                            stack.append((pre + k + ".", v))
                rows.append((s, f, n, row, sorted(given)))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.list_(pa.int32()))], ["s", "f", "n", "v", "g"])

    wide = df.select(F.col(source).cast("string").alias("s"), F.col(file).cast("string").alias("f"), F.col(line).cast("long").alias("n"), F.col(raw).cast("string").alias("x"))
    wide = wide.distinct().mapInArrow(run, "s string, f string, n long, v array<string>, g array<int>")
    sql = {"number": "double", "boolean": "boolean"}
    cols = [(c.replace(".", "__"), F.col("v")[i].try_cast(sql[kinds[c]]) if kinds[c] in sql else F.col("v")[i]) for i, c in enumerate(kept)]
    return wide, cols


def _uppers(path: str) -> list[str]:
    steps = path.split(".")
    return [".".join(steps[:i]) for i in range(1, len(steps))]
