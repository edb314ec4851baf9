"""Schema profiling, and questions with their SQL generated from a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import text as T

# The words a role goes by, tried in this order on the name, then on the description.
ROLES = (
    ("IDENTITY", r"(?:^|_)(?:id|no|code|key|uuid|cif|ref)(?:$|_)|\bmã\b|\bsố (?:tài khoản|định danh)\b"),
    ("TEMPORAL", r"(?:^|_)(?:date|time|at|day|month|year)(?:$|_)|\bngày\b|\bthời gian\b|\bgiờ\b"),
    ("METRIC", r"(?:^|_)(?:amount|total|sum|balance|fee|price|qty|quantity|count|rate|days|score|value)(?:$|_)|\bsố (?:tiền|lượng|dư|ngày)\b|\bphí\b|\btổng\b"),
    ("DIMENSION", r"(?:^|_)(?:type|status|category|channel|class|group|segment|gender|currency|level)(?:$|_)|\bloại\b|\btrạng thái\b|\bkênh\b|\bnhóm\b"),
)


def role(name: Column, description: Column) -> Column:
    """IDENTITY, TEMPORAL, METRIC or DIMENSION by the first pattern the name, else the description, matches; else ATTRIBUTE."""
    out = F.lit("ATTRIBUTE")
    for text in (description, name):
        for kind, pattern in reversed(ROLES):
            out = F.when(F.lower(text).rlike("(?U)" + pattern), F.lit(kind)).otherwise(out)
    return out


def keywords(description: Column, most: int = 6) -> Column:
    """The phrases of a description (cut at signs, brackets off) of at most five words, the first `most`, each once."""
    plain = F.regexp_replace(F.lower(description), r"\([^)]*\)|\[[^\]]*\]", " ")
    parts = F.transform(F.split(plain, r"[,;:/|.\n]|\s-\s"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(parts, lambda s: (F.length(s) > 1) & (F.size(F.split(s, " ")) <= 5))), 1, most)


def translate_name(name: Column, words: dict[str, str], heads: frozenset[str] = frozenset({"id", "no", "code", "date", "time", "type", "status", "name"})) -> Column:
    """A column's name in words: parts looked up, and a head noun at its end moved to the front ('trans_date' is 'ngày giao dịch')."""
    table = F.create_map(*[F.lit(v) for kv in words.items() for v in kv]) if words else F.create_map().cast("map<string,string>")
    parts = F.split(F.lower(name), "_")
    last = F.element_at(parts, -1)
    moved = F.when((F.size(parts) > 1) & last.isin(*heads), F.concat(F.array(last), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))))).otherwise(parts)
    return F.array_join(F.transform(moved, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def profile(columns: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """(name, role, description, suggested_keywords, label) of (name, description) rows; null descriptions are empty."""
    d = F.coalesce(F.col("description"), F.lit(""))
    return columns.select("name", role(F.col("name"), d).alias("role"), d.alias("description"), keywords(d).alias("suggested_keywords"), translate_name(F.col("name"), words or {}).alias("label"))


# What is asked of a column of each role, and the SQL that answers it. m is a metric, d a dimension.
BY_ROLE = {
    "IDENTITY": (("LOOKUP", "Thông tin {label} {{value}}", "SELECT * FROM {table} WHERE {name} = '{{value}}'"),),
    "DIMENSION": (("FILTER", "Danh sách có {label} {{value}}", "SELECT * FROM {table} WHERE {name} = '{{value}}'"), ("COUNT", "Có bao nhiêu theo {label}", "SELECT {name}, COUNT(*) AS n FROM {table} GROUP BY {name}")),
    "TEMPORAL": (("PERIOD", "Danh sách từ {label} {{start_date}} đến {{end_date}}", "SELECT * FROM {table} WHERE {name} >= '{{start_date}}' AND {name} < date_add('{{end_date}}', 1)"),),
    "METRIC": (("SUM", "Tổng {label}", "SELECT SUM({name}) AS total FROM {table}"), ("TOP", "Cao nhất theo {label}", "SELECT * FROM {table} ORDER BY {name} DESC LIMIT 10"), ("GREATER", "{label} trên {{value}}", "SELECT * FROM {table} WHERE {name} > {{value}}")),
    "ATTRIBUTE": (("SHOW", "Xem {label}", "SELECT {name} FROM {table}"),),
}
PAIRED = (("GROUP_SUM", "Tổng {m_label} theo {d_label}", "SELECT {d}, SUM({m}) AS total FROM {table} GROUP BY {d}"), ("COMPARE", "{m_label} trên {{value}} với {d_label} {{dim}}", "SELECT * FROM {table} WHERE {d} = '{{dim}}' AND {m} > {{value}}"))


def _fill(template: str, **cols: Column) -> Column:
    out = F.lit(template)
    for k, c in cols.items():
        out = F.replace(out, F.lit("{" + k + "}"), c)
    return F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def intents(profiled: DataFrame, table: str) -> DataFrame:
    """(intent_id, kind, question, sql): what a table can be asked, from the roles of its columns, and of each metric with each dimension.

    SQL keeps {slots} for values, to be bound as parameters. A table has few columns, which bounds the pairs.
    """
    one = None
    for r, shapes in BY_ROLE.items():
        rows = profiled.where(F.col("role") == r)
        made = F.array(*[F.struct(F.lit(k).alias("kind"), _fill(q, label=F.col("label")).alias("question"), _fill(s, table=F.lit(table), name=F.col("name")).alias("sql"), F.col("name").alias("on")) for k, q, s in shapes])
        part = rows.select(F.explode(made).alias("i")).select("i.*")
        one = part if one is None else one.unionByName(part)
    m = profiled.where("role = 'METRIC'").select(F.col("name").alias("m"), F.col("label").alias("m_label"))
    dims = profiled.where("role = 'DIMENSION'").agg(F.collect_list(F.struct("name", "label")).alias("ds"))
    pairs = m.join(F.broadcast(dims)).select("m", "m_label", F.explode("ds").alias("d"))
    made = F.array(*[F.struct(F.lit(k).alias("kind"), _fill(q, m_label=F.col("m_label"), d_label=F.col("d.label")).alias("question"), _fill(s, table=F.lit(table), m=F.col("m"), d=F.col("d.name")).alias("sql"), F.concat_ws("_", "m", "d.name").alias("on")) for k, q, s in PAIRED])
    both = one.unionByName(pairs.select(F.explode(made).alias("i")).select("i.*"))
    return both.select(F.concat_ws("_", F.lit(table), F.lower("kind"), "on").alias("intent_id"), "kind", "question", "sql")


def variations(df: DataFrame, question: str, synonyms: dict[str, list[str]], prefixes: list[str] = [], suffixes: list[str] = [], most: int = 1000, typos: bool = False) -> DataFrame:  # noqa: B006
    """(question, base_question): the base, with synonyms put in, prefixes and suffixes, without accents, in upper and lower case, and with a slip of the keys.

    Pronouns, verbs, abbreviations, regional words and words of another language are synonyms like others.

    Questions that agree but for case are one (the first by text); at most `most` variants of each base are made, by layers.
    """
    base = F.col(question)
    swapped = [F.when(F.contains(F.lower(base), F.lit(k)), F.regexp_replace(F.lower(base), rf"\Q{k}\E", v)) for k, vs in synonyms.items() for v in vs]
    layer = F.filter(F.array(base, *swapped), lambda x: x.isNotNull())
    affixed = F.flatten(F.transform(layer, lambda x: F.array(x, *[F.concat(F.lit(p + " "), x) for p in prefixes], *[F.concat(x, F.lit(" " + s)) for s in suffixes])))
    every = F.slice(F.array_distinct(F.flatten(F.transform(affixed, lambda x: F.array(x, T.fold(x), F.upper(x), *([typo(x)] if typos else []))))), 1, most)
    rows = df.select(base.alias("base_question"), F.explode(every).alias("question"))
    return rows.groupBy(F.lower("question").alias("_k"), "base_question").agg(F.max("question").alias("question")).select("question", "base_question")


def typo(x: Column, seed: int = 42) -> Column:
    """Two neighbouring letters swapped, at a place that the text's own hash gives."""
    at = (F.pmod(F.xxhash64(F.lit(seed), x), F.greatest(F.length(x) - 1, F.lit(1))) + 1).cast("int")
    return F.when(F.length(x) < 2, x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.lit(1)), F.substring(x, at, F.lit(1)), F.substring(x, at + 2, F.length(x))))


def fake_value(name: Column, kind: Column, key: Column, seed: int = 42) -> Column:
    """A made-up value for a column, the same for the same key: by its name and role."""
    h = F.pmod(F.xxhash64(F.lit(seed), name, key), F.lit(1_000_000))
    return (
        F.when(F.lower(name).contains("email"), F.format_string("user%d@example.com", h))
        .when(F.lower(name).rlike("phone|mobile"), F.format_string("060%07d", h))
        .when(kind == "TEMPORAL", F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (h % 365).cast("int")), "yyyy-MM-dd"))
        .when(kind == "METRIC", (h * 1000).cast("string"))
        .when(kind == "IDENTITY", F.format_string("ID%08d", h))
        .otherwise(F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "C", "D")]), (h % 4 + 1).cast("int")))
    )
