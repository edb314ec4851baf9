"""Running a checked query with a row limit, a timeout and a cache of queries that worked."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

from tamarind.plans import dialect, guard

DEFAULT_LIMIT = 100
#: Rows that are ever brought to the driver for one answer.
MOST_ROWS = 10_000


@dataclass
class Result:
    status: str  # ok, or the kind of error
    rows: list[Row] = field(default_factory=list)
    more: bool = False  # whether the query has rows beyond these
    error: str = ""
    sql: str = ""


def prepare(spark: SparkSession, sql: str, args: dict | None = None, limit: int | None = DEFAULT_LIMIT) -> tuple[guard.Verdict, DataFrame | None]:
    """(verdict, the query as a DataFrame): adapted, guarded, analysed; limited if its root is no limit of its own; with limit=None all rows."""
    text = dialect.to_spark(sql)
    v = guard.analyse(spark, text, args)
    if not v.ok:
        return v, None
    df = spark.sql(text, args=args or {})
    return v, df if v.limit or limit is None else df.limit(limit)


def run(spark: SparkSession, sql: str, args: dict | None = None, limit: int = DEFAULT_LIMIT, timeout: float | None = None) -> Result:
    """The rows, at most `limit` unless the query says otherwise; its jobs are cancelled after `timeout` seconds.

    Rows go to the driver, so of a query with a greater limit of its own MOST_ROWS come, and `more` says that it has others;
    prepare() gives all of them as a DataFrame.
    """
    v, df = prepare(spark, sql, args, limit)
    if df is None:
        return Result(v.kind, error=v.message, sql=sql)
    tag = f"run-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag)) if timeout else None
    spark.addTag(tag)
    try:
        if timer:
            timer.start()
        rows = df.limit(MOST_ROWS + 1).collect()
        return Result("ok", rows[:MOST_ROWS], len(rows) > MOST_ROWS, sql=sql)
    except Exception as e:  # noqa: BLE001
        return Result(guard.classify(e), error=str(e).split("\n")[0], sql=sql)
    finally:
        spark.removeTag(tag)
        if timer:
            timer.cancel()


class QueryCache:
    """SQL of questions whose queries passed, by key, as one small JSON file. Entries are copies: callers can't change them."""

    KEPT = ("PASS", "PASS_EMPTY")

    def __init__(self, path: str):
        self.path = Path(path)
        self.entries: dict[str, dict] = json.loads(self.path.read_text("utf-8")) if self.path.exists() else {}

    def get(self, key: str) -> dict | None:
        return dict(self.entries[key]) if key in self.entries else None

    def put(self, key: str, sql: str, validator: str, **more: object) -> bool:
        if validator not in self.KEPT:
            return False
        self.entries[key] = {"sql": sql, "validator": validator, **more}
        self.path.write_text(json.dumps(self.entries, ensure_ascii=False, indent=1), "utf-8")
        return True
