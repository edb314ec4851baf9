"""From questions to answers: batches are planned as one DataFrame, single questions run through to rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.functions import entities as E
from tamarind.functions import text as T
from tamarind.operators import route
from tamarind.plans import answer, execute, quality, spec
from tamarind.plans.outline import Outline, outline
from tamarind.sources.readers import save_template


@dataclass
class Domain:
    """What a domain is told by, and what it can answer."""

    entry: route.Entry
    intents: list[route.Entry]
    templates: dict[str, str] = field(default_factory=dict)
    tables: list[route.Entry] = field(default_factory=list)
    schema: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    entity_columns: dict[str, list[str]] = field(default_factory=dict)
    entity_tables: dict[str, tuple[str, str]] = field(default_factory=dict)  # entity key: the table and column that know its values
    enums: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Pipeline:
    domains: list[Domain]
    as_of: date
    generator: Callable[[str], str] | None = None
    cache: execute.QueryCache | None = None
    limit: int = execute.DEFAULT_LIMIT
    timeout: float | None = 60.0
    lexicon: E.Lexicon = E.Lexicon()
    templates_folder: str | None = None  # where generated queries that gave rows are kept as templates

    def _domain(self, name: str) -> Domain:
        return next(d for d in self.domains if d.entry.name == name)

    def plan(self, questions: DataFrame, question: str = "question", forced: str | None = None) -> DataFrame:
        """questions plus domain (null if ambiguous), candidates, intent, tables, entities and cache_key, without a join or shuffle.

        The two best domains stand for election if they are close; the arbiter weighs domain, table and intent scores.
        """
        q = F.col(question)
        ranking = route.forced(forced) if forced else route.ranked(q, [d.entry for d in self.domains])
        df = questions.withColumn("_ranking", ranking)
        best = lambda entries: F.get(route.ranked(q, entries), F.lit(0)) if entries else F.struct(F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("score"))
        pick = lambda name, make: self._by_domain(name, make)
        names = route.shortlist(F.col("_ranking"))
        df = df.withColumn("candidates", names)
        score = F.map_from_entries(F.transform("_ranking", lambda r: F.struct(r["name"], r["score"])))
        standing = F.array(*[F.when(F.array_contains("candidates", d.entry.name), F.struct(F.lit(d.entry.name).alias("name"), F.coalesce(F.try_element_at(score, F.lit(d.entry.name)), F.lit(0.0)).alias("domain"), best(d.tables)["score"].alias("table"), best(d.intents)["score"].alias("intent"))) for d in self.domains])
        df = df.withColumn("_arbiter", route.arbitrate(F.filter(standing, lambda s: s.isNotNull())))
        df = df.withColumn("domain", F.lit(forced) if forced else F.col("_arbiter.name"))
        df = df.withColumn("intent", pick("domain", lambda d: best(d.intents)["name"])).withColumn("tables", pick("domain", lambda d: route.at_least(route.ranked(q, d.tables)) if d.tables else F.array().cast("array<string>")))
        df = df.withColumn("entities", E.entities(q, F.col("domain"), self.as_of, self.lexicon)).withColumn("cache_key", T.question_key(q, F.col("domain")))
        return df.drop("_ranking", "_arbiter")

    def _by_domain(self, column: str, make: Callable[[Domain], Column]) -> Column:
        out = None
        for d in self.domains:
            out = F.when(F.col(column) == d.entry.name, make(d)) if out is None else out.when(F.col(column) == d.entry.name, make(d))
        return out

    @staticmethod
    def _missing(spark: SparkSession, d: Domain, found: dict[str, str]) -> set[str]:
        """The entity keys whose value no row of their table has."""
        wanted = [(k, found[k]) for k in d.entity_tables if k in found]
        if not wanted:
            return set()
        tables = {k: (spark.table(d.entity_tables[k][0]), d.entity_tables[k][1]) for k, _ in wanted}
        missing = quality.missing_entities(spark.createDataFrame(wanted, "k string, v string"), "k", "v", tables)
        return {r["k"] for r in missing.collect()}

    def answer(self, spark: SparkSession, question: str, forced: str | None = None) -> dict:
        """One question all the way: a log record with validator, rows, confidence, timing and an explanation.

        validator: CHITCHAT, DOMAIN_AMBIGUOUS, PASS, PASS_EMPTY, DATA_ERROR or FAIL.
        """
        began = time.perf_counter()
        row = spark.createDataFrame([(question,)], "question string").withColumn("_chat", E.is_chitchat(F.col("question")))
        r = self.plan(row, forced=forced).first().asDict(recursive=True)
        log = {"question": question, "domain": r["domain"], "candidate_domains": r["candidates"], "tables": r["tables"], "intent": r["intent"], "entities": r["entities"] or {}, "sql": None, "validator": None, "rows": 0, "confidence": None, "timing": {"routing": time.perf_counter() - began}}
        if r["_chat"]:
            return {**log, "validator": "CHITCHAT", "explanation": "Xin chào!"}
        if r["domain"] is None:
            return {**log, "validator": "DOMAIN_AMBIGUOUS", "explanation": ""}
        d = self._domain(r["domain"])
        found = log["entities"]
        cached = self.cache.get(r["cache_key"]) if self.cache else None
        bound = spec.bind(spec.choose(d.templates, r["intent"] or "") or "", found)
        sql, args = (cached["sql"], cached.get("args", {})) if cached else (bound.sql, bound.args) if spec.ready(bound, found) and bound.sql else ("", {})
        columns = {t: [c for c, _ in cols] for t, cols in d.schema.items()}
        retry, result, error = spec.Retry(), None, None
        while True:
            if not sql and self.generator:
                reply = self.generator(answer.prompt(question, answer.schema_text(d.schema, r["tables"]), found, bound.sql or None, error, retry.attempts[-1][0] if retry.attempts else None))
                sql, args = answer.extract_sql(reply), {}
            if not sql:
                return {**log, "validator": "FAIL", "error": error or "no query", "explanation": ""}
            result = execute.run(spark, sql, args, self.limit, self.timeout)
            if result.status == "ok":
                break
            error = result.error
            retry.record(sql, error, result.status)
            if columns and retry.may_repair(result.status) and (read := spec.from_sql(spark, sql)):
                mended = spec.repair(read, columns, {k: v for k, v in found.items() if k in d.entity_columns}, question).bound()
                if mended.sql != sql:
                    sql, args = mended.sql, mended.args
                    continue
            if not self.generator or not retry.may_regenerate(result.status):
                return {**log, "sql": sql, "validator": "FAIL", "error": error, "explanation": ""}
            sql = ""
        log["sql"], log["rows"] = sql, len(result.rows)
        log["timing"]["execution"] = time.perf_counter() - began - log["timing"]["routing"]
        read = outline(spark, sql) or Outline()
        score, issues = quality.structure_score(question, read, found, columns, d.entity_columns)
        warnings = quality.semantic_warnings(question, read)
        status, why = ("PASS", []) if result.rows else quality.explain_empty(found, self._missing(spark, d, found), d.enums, self.as_of)
        weights = {"sql_executable": True, "structure": min(score, 1.0), "entity_valid": status != "DATA_ERROR", "semantic_ok": not warnings, "has_rows": bool(result.rows)}
        total = round(sum(quality.WEIGHTS[k] * float(v) for k, v in weights.items()), 2)
        log |= {"validator": status, "confidence": {"score": total, "passed": total >= quality.PASS_FROM}, "semantic_warnings": warnings, "structure_score": score, "structure_issues": issues, "data_validation": why}
        if self.templates_folder and status == "PASS" and not cached and sql != bound.sql:
            save_template(spark, self.templates_folder, r["intent"] or r["cache_key"], sql)
        if self.cache:
            self.cache.put(r["cache_key"], sql, status, args=args)
        names = list(result.rows[0].asDict()) if result.rows else []
        return {**log, "explanation": answer.explain(names, [tuple(x) for x in result.rows])}
