"""Queries of the general data-preparation operators: intervals, drift, nested records, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.operators import drift, intervals, orphans, shred


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    done = intervals.periods_and_gaps(table(spark, d, "leave_request"), "employee_id", "start_date", "end_date")
    return done.select("employee_id", "kind", F.date_format("start_day", "yyyy-MM-dd").alias("start_date"), F.date_format("end_day", "yyyy-MM-dd").alias("end_date"))


def p1_leave_days(spark: SparkSession, d: str) -> DataFrame:
    done = intervals.periods_and_gaps(table(spark, d, "leave_request"), "employee_id", "start_date", "end_date")
    days = F.date_diff("end_day", "start_day") + 1
    return done.groupBy("employee_id").agg(F.count_if(F.col("kind") == "period").alias("n_periods"), F.sum(F.when(F.col("kind") == "period", days).otherwise(0)).alias("leave_days"), F.max(F.when(F.col("kind") == "gap", days)).alias("longest_gap"))


_PERIODS_SQL = """
WITH r AS (SELECT employee_id, start_date s, end_date e FROM leave_request
           WHERE employee_id IS NOT NULL AND start_date IS NOT NULL AND end_date IS NOT NULL AND start_date <= end_date),
m AS (SELECT *, max(e) OVER (PARTITION BY employee_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY employee_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT employee_id, n, min(s) s, max(e) e FROM g GROUP BY employee_id, n),
q AS (SELECT employee_id, 'period' AS kind, s, e FROM p
      UNION ALL SELECT * FROM (SELECT employee_id, 'gap' AS kind, e + 1 AS s, lead(s) OVER (PARTITION BY employee_id ORDER BY s) - 1 AS e FROM p) WHERE e IS NOT NULL)
"""
P1_FOUND_SQL = _PERIODS_SQL + "SELECT employee_id, kind, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date FROM q"
P1_DAYS_SQL = _PERIODS_SQL + """SELECT employee_id, count(*) FILTER (kind = 'period') AS n_periods,
CAST(sum(CASE WHEN kind = 'period' THEN date_diff('day', s, e) + 1 ELSE 0 END) AS BIGINT) AS leave_days,
CAST(max(CASE WHEN kind = 'gap' THEN date_diff('day', s, e) + 1 END) AS INTEGER) AS longest_gap FROM q GROUP BY employee_id"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = drift.changes(table(spark, d, "batch_record"), "runner", "file_name", "raw")
    return found.select(F.col("source").alias("runner"), F.col("file").alias("file_name"), "change_kind", "field_path", "new_path")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "batch_record"), "runner", "file_name", "line_no", "raw")


def p4_uncast(spark: SparkSession, d: str) -> DataFrame:
    return drift.uncast(table(spark, d, "batch_record"), "runner", "file_name", "line_no", "raw")


def p4_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("change_kind", "field_path", "new_path").agg(F.count(F.lit(1)).alias("n_files"))


def _routing(spark: SparkSession, d: str) -> DataFrame:
    lists = {"ranked_domains", "arbitration_scores", "matched_keywords"}
    flat = shred.nodes(table(spark, d, "query_record"), "record_id", "record", ["domain_routing"], lists, {"domain_routing"}, lists | {"domain_id"})
    found = shred.entities(flat, ["ranked_domains", "arbitration_scores"], ["domain_id"], ["matched_keywords"])
    return found.where(F.size(F.split("node", r"\.")) == 3)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One pass: the entity rows and, for ranked domains, the rows of their keyword lists."""
    entity = _routing(spark, d)
    row = lambda name, pos, sub, val: F.struct(name.alias("list_name"), pos.alias("pos"), sub.alias("sub_pos"), val.alias("val"))
    own = F.array(row(F.col("label"), F.col("pos"), F.lit(-1), F.coalesce("domain_id", F.lit(""))))
    words = F.transform(F.when(F.col("label") == "ranked_domains", F.col("matched_keywords")).otherwise(F.array().cast("array<struct<pos:int,value:string>>")), lambda k: row(F.lit("matched_keywords"), F.col("pos"), k["pos"], k["value"]))
    return entity.select(F.col("rec").cast("long").alias("record_id"), F.explode(F.concat(own, words)).alias("r")).select("record_id", "r.*")


def p6_keywords(spark: SparkSession, d: str) -> DataFrame:
    """How often each keyword matched, per domain: the child table joined to its parent through (record, parent)."""
    entity = _routing(spark, d).where("label = 'ranked_domains'")
    words = shred.elements(entity, "matched_keywords")
    named = words.join(entity.select("rec", F.col("node").alias("parent"), "domain_id"), ["rec", "parent"])
    return named.groupBy("domain_id", F.col("value").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


RELATIONS = (
    ("employee", "employee_id", "department_id", "hire_date", "department", "department_id"),
    ("attendance", "attendance_id", "employee_id", "attendance_date", "employee", "employee_id"),
    ("customer_account", "account_no", "customer_no", "create_date", "bank_customer", "customer_no"),
)


def _orphan_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = pars = None
    for child, child_id, key, at, parent, parent_key in RELATIONS:
        r = orphans.references(table(spark, d, child), child, child_id, key, at, "loaded_at")
        p = orphans.parents(table(spark, d, parent), child, parent_key, "loaded_at", "deleted_at")
        refs, pars = (r, p) if refs is None else (refs.unionByName(r), pars.unionByName(p))
    return refs, pars


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphans(orphans.track(*_orphan_inputs(spark, d)))
    return found.select(F.col("relation").alias("child_table"), "child_id", "period", "why")


def p7_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The counts per table and period at the end of each slice of load time."""
    taken: list[DataFrame] = []
    orphans.track(*_orphan_inputs(spark, d), each=lambda until, s: taken.append(orphans.snapshot(s).withColumn("slice", F.lit(len(taken)))))
    out = taken[0]
    for x in taken[1:]:
        out = out.unionByName(x)
    return out


def p7_reopened(spark: SparkSession, d: str) -> DataFrame:
    return orphans.reopened(orphans.track(*_orphan_inputs(spark, d)))


def _p7_sql() -> str:
    parts = []
    for child, child_id, key, at, parent, parent_key in RELATIONS:
        parts.append(f"""SELECT '{child}' AS relation, c.child_id, c.period, c.child_loaded, p.k, p.deleted_at, p.loaded FROM
(SELECT CAST({child_id} AS VARCHAR) AS child_id, lower(trim({key})) AS k, strftime({at}, '%Y-%m') AS period, min(loaded_at) AS child_loaded FROM {child} WHERE trim({key}) <> '' GROUP BY ALL) c
LEFT JOIN (SELECT lower(trim({parent_key})) AS k, min(loaded_at) AS loaded, min(deleted_at) AS deleted_at FROM {parent} GROUP BY ALL) p ON p.k = c.k""")
    return f"WITH j AS ({' UNION ALL '.join(parts)})"


_WHY_SQL = "CASE WHEN k IS NULL THEN 'missing' WHEN deleted_at <= child_loaded THEN 'deleted' WHEN loaded > child_loaded THEN 'late' END"
P7_FOUND_SQL = _p7_sql() + f" SELECT DISTINCT relation AS child_table, child_id, period, {_WHY_SQL} AS why FROM j WHERE {_WHY_SQL} IS NOT NULL"
P7_REOPENED_SQL = _p7_sql() + f" SELECT relation, period, count(*) AS n FROM j WHERE k IS NOT NULL AND coalesce({_WHY_SQL}, 'late') = 'late' AND deleted_at IS NOT NULL GROUP BY ALL"

_ROUTING_SQL = """WITH r AS (SELECT record_id, CAST(record AS JSON) AS j FROM query_record WHERE json_valid(record)),
d AS (SELECT record_id, j->'$.domain_routing' AS x FROM r WHERE json_type(j) = 'OBJECT'),
e AS (SELECT record_id, CASE WHEN json_type(x) <> 'VARCHAR' THEN x WHEN json_valid(x->>'$') THEN CAST(x->>'$' AS JSON) END AS x FROM d),
l AS (SELECT record_id, 'ranked_domains' AS list_name, x->'$.ranked_domains' AS v FROM e UNION ALL SELECT record_id, 'arbitration_scores', x->'$.arbitration_scores' FROM e),
a AS (SELECT record_id, list_name, CASE WHEN json_type(v) = 'ARRAY' THEN v->'$[*]' WHEN json_type(v) <> 'NULL' THEN [v] END AS v FROM l),
o AS (SELECT record_id, list_name, unnest(v) AS o, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM a),
k AS (SELECT record_id, pos, o->'$.matched_keywords' AS v FROM o WHERE list_name = 'ranked_domains' AND json_type(o) = 'OBJECT'),
m AS (SELECT record_id, pos, CASE WHEN json_type(v) = 'ARRAY' THEN v->'$[*]' WHEN json_type(v) <> 'NULL' THEN [v] END AS v FROM k),
w AS (SELECT record_id, pos, unnest(v) AS w, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS sub_pos FROM m),
f AS (SELECT record_id, list_name, pos, -1 AS sub_pos, coalesce(o->>'$.domain_id', '') AS val FROM o WHERE json_type(o) = 'OBJECT'
      UNION ALL SELECT record_id, 'matched_keywords', pos, sub_pos, w->>'$' FROM w WHERE json_type(w) NOT IN ('NULL', 'OBJECT', 'ARRAY'))
"""
P6_FOUND_SQL = _ROUTING_SQL + "SELECT DISTINCT record_id, list_name, pos, sub_pos, val FROM f"
P6_KEYWORDS_SQL = _ROUTING_SQL + """SELECT o.o->>'$.domain_id' AS domain_id, f.val AS keyword, count(*) AS n FROM (SELECT DISTINCT record_id, pos, sub_pos, val FROM f WHERE list_name = 'matched_keywords') f
JOIN (SELECT DISTINCT record_id, pos, o FROM o WHERE list_name = 'ranked_domains') o ON o.record_id = f.record_id AND o.pos = f.pos GROUP BY ALL"""


def _snapshots_sql(slices: int = 3) -> str:
    """The cases among the rows loaded before each mark, counted: what the state must hold after each slice."""
    refs, pars = [], []
    for child, child_id, key, at, parent, parent_key in RELATIONS:
        refs.append(f"SELECT '{child}' AS relation, CAST({child_id} AS VARCHAR) AS child_id, lower(trim({key})) AS k, strftime({at}, '%Y-%m') AS period, min(loaded_at) AS child_loaded FROM {child} WHERE trim({key}) <> '' GROUP BY ALL")
        pars.append(f"SELECT '{child}' AS relation, lower(trim({parent_key})) AS k, loaded_at AS loaded, deleted_at FROM {parent} WHERE trim({parent_key}) <> ''")
    return f"""WITH r AS ({' UNION ALL '.join(refs)}), p AS ({' UNION ALL '.join(pars)}), b AS (SELECT min(x) AS low, max(x) AS high FROM (SELECT child_loaded AS x FROM r UNION ALL SELECT loaded FROM p)),
m AS (SELECT CAST(i AS INTEGER) AS slice, CASE WHEN i < {slices - 1} THEN make_timestamp(epoch_us(low) + (epoch_us(high) - epoch_us(low)) * (i + 1) // {slices}) END AS mark FROM b, range({slices}) t(i)),
i AS (SELECT slice, relation, k, min(loaded) AS loaded, min(deleted_at) AS deleted_at FROM p, m WHERE mark IS NULL OR CAST(loaded AS TIMESTAMP) < mark GROUP BY ALL),
j AS (SELECT m.slice, r.*, i.k AS found, i.loaded, i.deleted_at FROM r JOIN m ON mark IS NULL OR CAST(child_loaded AS TIMESTAMP) < mark LEFT JOIN i ON i.slice = m.slice AND i.relation = r.relation AND i.k = r.k),
w AS (SELECT DISTINCT slice, relation, child_id, period, CASE WHEN found IS NULL THEN 'missing' WHEN deleted_at <= child_loaded THEN 'deleted' WHEN loaded > child_loaded THEN 'late' END AS why FROM j)
SELECT relation, period, why, count(*) AS n, slice FROM w WHERE why IS NOT NULL GROUP BY ALL"""


P7_SNAPSHOTS_SQL = _snapshots_sql()

QUERIES = {f.__name__: f for f in (p1_found, p1_leave_days, p4_found, p4_unified, p4_uncast, p4_change_counts, p6_found, p6_keywords, p7_found, p7_snapshots, p7_reopened)}
ORACLE = {"p1_found": P1_FOUND_SQL, "p1_leave_days": P1_DAYS_SQL, "p7_found": P7_FOUND_SQL, "p7_reopened": P7_REOPENED_SQL, "p7_snapshots": P7_SNAPSHOTS_SQL, "p6_found": P6_FOUND_SQL, "p6_keywords": P6_KEYWORDS_SQL}
