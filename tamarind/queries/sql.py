"""The query shapes of the SQL surface: projections, filters, joins, aggregates, ranking, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamarind.sources.tables import read_table as table

QUERIES = {}
ORACLE = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def half_open(c: str, first: str, last: str) -> Column:
    """Both days whole: [first, last + 1 day), which a scan can prune by."""
    return (F.col(c) >= F.lit(first).cast("timestamp")) & (F.col(c) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


@query("SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7 OR (event_type = 'error' AND value > 99)")
def txn_by_account_or(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where((F.col("user_id") == 7) | ((F.col("event_type") == "error") & (F.col("value") > 99))).select("event_id", "user_id", "event_type", "value")


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def txn_by_period_halfopen(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(half_open("o_orderdate", "1998-03-01", "1998-03-31"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 110000")
def txn_by_amount_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") <= 110000)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def txn_by_status_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_brand LIKE 'Brand#1_'")
def txn_like_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%'")
def name_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.lower("p_name").contains("widget")).select("p_partkey", "p_name")


@query("SELECT request_id, employee_id, reason FROM leave_request WHERE reason IS NOT NULL AND employee_id IS NOT NULL")
def not_null_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leave_request").where(F.col("reason").isNotNull() & F.col("employee_id").isNotNull()).select("request_id", "employee_id", "reason")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-05'")
def month_predicate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(half_open("o_orderdate", "1997-05-01", "1997-05-31")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def optional(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Each filter that was given (is not None) narrows df; none of them leaves it as it is."""
    return reduce(lambda x, kv: x.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in filters.items() if v is not None), df)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return optional(table(spark, d, "orders"), {"o_orderstatus": "F", "o_custkey": None, "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 250000 AND o_orderstatus = 'F'")
def dim_and_metric_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") > 250000)).where(F.col("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def entity_exists_batch(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def profile_join2(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderstatus = 'O'""")
def profile_join4(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.where("o_orderstatus = 'O'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    return joined.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' AND c_acctbal > 9000
GROUP BY n_name""")
def count_by_dim_keep_zero(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    on = (c.c_nationkey == n.n_nationkey) & (c.c_mktsegment == "MACHINERY") & (c.c_acctbal > 9000)
    return n.join(c, on, "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@query("""SELECT d.department_id, any_value(d.department_name) AS department_name, any_value(m.employee_name) AS manager_name, count(e.employee_id) AS employees
FROM department d LEFT JOIN (SELECT DISTINCT employee_id, employee_name FROM employee) m ON m.employee_id = d.manager_id
LEFT JOIN (SELECT DISTINCT employee_id, department_id FROM employee WHERE employment_status = 'ACTIVE') e ON e.department_id = d.department_id GROUP BY d.department_id""")
def parent_and_child_counts(spark: SparkSession, d: str) -> DataFrame:
    """The child side is counted before the join, so a large department costs one row there."""
    dep, emp = table(spark, d, "department"), table(spark, d, "employee")
    heads = emp.where("employment_status = 'ACTIVE'").select("employee_id", "department_id").distinct().groupBy("department_id").agg(F.count("employee_id").alias("employees"))
    manager = emp.select(F.col("employee_id").alias("manager_id"), F.col("employee_name").alias("manager_name")).distinct()
    joined = dep.join(manager, "manager_id", "left").join(heads, "department_id", "left")
    return joined.select("department_id", "department_name", "manager_name", F.coalesce("employees", F.lit(0)).alias("employees"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'F'")
def agg_five(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(p), 2).alias("total"), F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("least"), F.max(p).alias("most"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL ORDER BY month, o_orderpriority")
def stats_month_type(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority")
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy("month", "o_orderpriority")


@query("""SELECT employee_id, strftime(attendance_date, '%Y-%m') AS month, count_if(status = 'PRESENT') AS present, count_if(status = 'LATE') AS late, count_if(status = 'REMOTE') AS remote,
count_if(status = 'ABSENT') AS absent, count_if(status = 'ON_LEAVE') AS on_leave FROM (SELECT DISTINCT attendance_id, employee_id, attendance_date, status FROM attendance) GROUP BY ALL""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "attendance").select("attendance_id", "employee_id", "attendance_date", "status").distinct()
    by = a.groupBy("employee_id", F.date_format("attendance_date", "yyyy-MM").alias("month"))
    return by.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PRESENT", "LATE", "REMOTE", "ABSENT", "ON_LEAVE")])


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count_if(value > 50) AS successes FROM events GROUP BY event_type")
def summary_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_if(F.col("value") > 50).alias("successes"))


@query("SELECT o_orderpriority AS channel, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def summary_by_channel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(10)


@query("""SELECT text, source, min(id) AS first_id, count(*) AS copies FROM (SELECT question AS text, source, 0 AS id FROM gold_test_set UNION ALL SELECT example_text, source, example_id FROM examples)
GROUP BY ALL""")
def merge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Two result sets by name, duplicates of (text, source) folded, the first kept."""
    gold = table(spark, d, "gold_test_set").select(F.col("question").alias("text"), "source", F.lit(0).cast("long").alias("id"))
    ex = table(spark, d, "examples").select(F.col("example_text").alias("text"), "source", F.col("example_id").alias("id"))
    return gold.unionByName(ex).groupBy("text", "source").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def value_counts_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k >= 50")


@query("SELECT max(o_orderkey) + 1 AS next_id FROM orders")
def next_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("next_id"))


@query("SELECT a.account_no, b.customer_name, a.status FROM (SELECT DISTINCT account_no, customer_no, status FROM customer_account) a JOIN (SELECT DISTINCT customer_no, customer_name FROM bank_customer) b ON a.customer_no = b.customer_no WHERE a.status = 'OPEN'")
def account_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer_account").where("status = 'OPEN'").select("account_no", "customer_no", "status").distinct()
    b = table(spark, d, "bank_customer").select("customer_no", "customer_name").distinct()
    return a.join(b, "customer_no").select("account_no", "customer_name", "status")


@query("SELECT source, round(avg(m), 4) AS mean_best FROM (SELECT source, domain, max(n) AS m FROM (SELECT e.source, d.lang AS domain, length(e.example_text) AS n FROM examples e LEFT JOIN documents d ON e.doc_id = d.doc_id) GROUP BY ALL) GROUP BY source")
def left_join_max_fill(spark: SparkSession, d: str) -> DataFrame:
    e, docs = table(spark, d, "examples"), table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"))
    best = e.join(docs, "doc_id", "left").groupBy("source", "domain").agg(F.max(F.length("example_text")).alias("m"))
    return best.groupBy("source").agg(F.round(F.avg("m"), 4).alias("mean_best"))


@query("""SELECT domain, n, rank FROM (SELECT domain, n, row_number() OVER (ORDER BY n DESC, domain) AS rank FROM (SELECT coalesce(domain, '?') AS domain, count(*) AS n FROM query_log GROUP BY 1)) WHERE rank <= 5""")
def ranked_domains(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over the grouped counts: the window sees one row a domain."""
    n = table(spark, d, "query_log").groupBy(F.coalesce("domain", F.lit("?")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "domain").limit(5).withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "domain"))).select("domain", "n", "rank")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-31' AND o_orderdate < TIMESTAMP '1997-02-01'""")
def single_day_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of one day holds that whole day."""
    return table(spark, d, "orders").where(half_open("o_orderdate", "1997-01-31", "1997-01-31")).select("o_orderkey", "o_orderdate")


@query("SELECT employee_id, employee_name, phone FROM employee ORDER BY phone NULLS LAST, employee_id, employee_name LIMIT 50")
def sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "employee").select("employee_id", "employee_name", "phone").orderBy(F.asc_nulls_last("phone"), "employee_id", "employee_name").limit(50)


@query("SELECT round(count(*) / 1000.0, 3) AS n_thousand FROM examples WHERE example_id >= 0")
def rounded_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "examples").where("example_id >= 0").agg(F.round(F.count(F.lit(1)) / 1000.0, 3).alias("n_thousand"))


def sampled(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, the same for the same seed and rows: the order comes from the rows' own hash, not from their partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *[F.col(c) for c in df.columns]).limit(n)


@query(None)
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampled(table(spark, d, "part"), 100)
