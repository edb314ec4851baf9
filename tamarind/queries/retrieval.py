"""Text, retrieval, routing and evaluation queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamarind.functions import dates, entities
from tamarind.functions import text as T
from tamarind.operators import corpus, evaluate, route, search
from tamarind.queries import cases
from tamarind.sources.tables import read_table as table

QUERIES = {}
ORACLE = {}
AS_OF = date(2026, 3, 26)
_WORD = r"[\p{L}\p{N}_]+"


def fold_sql(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{T.ACCENTED}', '{T.PLAIN}'), '\\p{{M}}+', '', 'g')"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{_WORD}')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def fold_diacritics(spark, d):
    return docs(spark, d).select("doc_id", T.fold("text").alias("folded"))


@query("SELECT example_id, lower(trim(regexp_replace(regexp_replace(example_text, '[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}]', '', 'g'), '\\s+', ' ', 'g'), ' ')) AS cleaned FROM examples")
def clean_text(spark, d):
    return table(spark, d, "examples").select("example_id", T.clean("example_text").alias("cleaned"))


@query("SELECT id, regexp_replace(trim(regexp_replace(lower(question), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g')), '\\s+', '_', 'g') AS slug FROM gold_test_set")
def slug(spark, d):
    return table(spark, d, "gold_test_set").select("id", T.slug("question").alias("slug"))


@query(f"""WITH w AS (SELECT doc_id, {words_sql('lower(text)')} AS t FROM documents)
SELECT doc_id, len(t) AS n_words, CAST(greatest(len(t) - 1, 0) AS BIGINT) AS n_pairs, CASE WHEN len(t) > 1 THEN t[1] || '_' || t[2] END AS first_pair FROM w""")
def tokens_ngrams(spark, d):
    t = docs(spark, d).select("doc_id", T.words(F.lower("text")).alias("t")).withColumn("g", T.ngrams(F.col("t"), 2))
    return t.select("doc_id", F.size("t").cast("long").alias("n_words"), F.size("g").cast("long").alias("n_pairs"), F.get("g", F.lit(0)).alias("first_pair"))


@query(f"SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({words_sql('lower(text)')}) AS w FROM documents) GROUP BY w")
def doc_freq(spark, d):
    return corpus.document_frequency(docs(spark, d), "text")


@query(f"""WITH w AS (SELECT {words_sql('lower(example_text)')} AS t FROM examples), u AS (SELECT x AS w, count(*) AS n FROM (SELECT unnest(t) AS x FROM w) GROUP BY x),
b AS (SELECT a || '_' || c AS pair, a, c, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: struct_pack(a := t[i], c := t[i + 1]))) AS p FROM w) q, (SELECT 1) z, LATERAL (SELECT q.p.a AS a, q.p.c AS c) r GROUP BY ALL)
SELECT pair, b.n, round(ln(b.n * (SELECT sum(n) FROM u) / (x.n * y.n) + 1e-9), 4) AS pmi FROM b JOIN u x ON x.w = b.a JOIN u y ON y.w = b.c WHERE b.n >= 3 AND ln(b.n * (SELECT sum(n) FROM u) / (x.n * y.n) + 1e-9) >= 3.0""")
def pmi_phrases(spark, d):
    return corpus.phrases(table(spark, d, "examples"), "example_text")


@query(f"""WITH n AS (SELECT w, count(*) AS n FROM (SELECT unnest({words_sql('lower(example_text)')}) AS w FROM examples) GROUP BY w), g AS (SELECT {fold_sql('w')} AS base, w, n FROM n)
SELECT arg_min(w, struct_pack(a := -n, b := length(w), c := w)) AS stem, CAST(count(*) AS BIGINT) AS n_variants FROM g GROUP BY base HAVING count(*) > 1""")
def stem_groups(spark, d):
    return corpus.stems(table(spark, d, "examples"), "example_text").select("stem", F.size("variants").cast("long").alias("n_variants"))


@query(f"SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({words_sql('lower(text)')}) AS w FROM documents) WHERE length(w) <= 3 GROUP BY w HAVING count(*) >= 0.15 * (SELECT count(*) FROM documents)")
def stop_words(spark, d):
    return corpus.stop_words(docs(spark, d), "text", 0.15)


@query("""SELECT doc_id, CAST(ceil(len(w) / 24.0) AS BIGINT) AS n_chunks, array_to_string(w[1:24], ' ') AS first_chunk FROM
(SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def word_chunks(spark, d):
    c = docs(spark, d).select("doc_id", T.word_chunks("text", 24).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.coalesce(F.get("c", F.lit(0)), F.lit("")).alias("first_chunk"))


@query("SELECT id, 'gold:' || substr(sha256(lower(trim(question))), 1, 16) AS cache_key FROM gold_test_set")
def question_key_sha(spark, d):
    return table(spark, d, "gold_test_set").select("id", T.question_key("question", F.lit("gold")).alias("cache_key"))


@query("""SELECT request_id, employee_id, total_days, CAST(len(list_filter(generate_series(start_date, end_date, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS INTEGER) AS working_days
FROM (SELECT DISTINCT request_id, employee_id, total_days, start_date, end_date FROM leave_request) WHERE start_date <= end_date""")
def working_days(spark, d):
    r = table(spark, d, "leave_request").select("request_id", "employee_id", "total_days", "start_date", "end_date").distinct().where("start_date <= end_date")
    return r.select("request_id", "employee_id", "total_days", dates.working_days(F.col("start_date"), F.col("end_date")).alias("working_days"))


@query("""SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS last_month_start, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS last_month_end,
strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter_start FROM orders""")
def named_periods(spark, d):
    day = F.col("o_orderdate").cast("date")
    p = lambda s, end: F.date_format(dates.named_period(F.lit(s), day)[end], "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", p("tháng trước", "start").alias("last_month_start"), p("tháng trước", "end").alias("last_month_end"), p("tuần này", "start").alias("week_start"), p("quý này", "start").alias("quarter_start"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS question_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings e)
SELECT question_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return search.top_k_cosine(e.where("vec_id % 100 = 0"), "vec_id", "embedding", e, "vec_id", "embedding")


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS question_id, e.label, e.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings e)
SELECT question_id, label, max(score) AS score_max_example FROM s GROUP BY ALL""")
def maxsim_by_label(spark, d):
    e = table(spark, d, "embeddings")
    return search.max_dot_by_group(e.where("vec_id % 100 = 0"), "vec_id", "embedding", e, "label", "embedding")


_BM25_CTE = f"""WITH qt AS (SELECT DISTINCT item_id AS q, unnest({words_sql(fold_sql('text'))}) AS w FROM eval_item), d AS (SELECT doc_id, {words_sql(fold_sql('text'))} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d), tf AS (SELECT doc_id, w, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(t) AS len, unnest(t) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
s AS (SELECT q AS question_id, doc_id AS id, round(sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM qt JOIN tf USING (w) JOIN df USING (w), st GROUP BY ALL)"""


def _bm25(spark, d, k=10, where="true"):
    q = table(spark, d, "eval_item").where(where).select("item_id", search.words_of("text").alias("qt"))
    return search.bm25(q, "item_id", "qt", docs(spark, d).select("doc_id", search.words_of("text").alias("dt")), "doc_id", "dt", k)


@query(_BM25_CTE + " SELECT question_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d)


@query(_BM25_CTE + """, r AS (SELECT *, score / greatest(max(score) OVER (PARTITION BY question_id), 0.001) AS normal, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s)
SELECT question_id, max(CASE WHEN rank = 1 THEN id END) AS first_id, round(max(CASE WHEN rank = 1 THEN normal END) - coalesce(max(CASE WHEN rank = 2 THEN normal END), 0), 4) AS gap,
CASE WHEN coalesce(max(CASE WHEN rank = 2 THEN normal END), 0) >= 0.7 OR 1 - coalesce(max(CASE WHEN rank = 2 THEN normal END), 0) < 0.15 THEN 2 ELSE 1 END AS shortlisted FROM r WHERE rank <= 2 GROUP BY question_id""")
def score_normalize_shortlist(spark, d):
    r = _bm25(spark, d, 2).withColumn("normal", search.by_max("score", ["question_id"])).withColumn("second", F.lead("normal").over(W.partitionBy("question_id").orderBy("rank")))
    second = F.coalesce("second", F.lit(0.0))
    return r.where("rank = 1").select("question_id", F.col("id").alias("first_id"), F.round(F.col("normal") - second, 4).alias("gap"), F.when((second >= 0.7) | (1 - second < 0.15), 2).otherwise(1).alias("shortlisted"))


@query("SELECT id, least(1.0, 0.25 * len(list_filter(tags, lambda k: contains(lower(question), lower(k))))) AS boost FROM gold_test_set")
def keyword_boost(spark, d):
    return table(spark, d, "gold_test_set").select("id", search.keyword_boost(F.col("tags"), F.col("question")).alias("boost"))


@query(_BM25_CTE + """, a AS (SELECT DISTINCT item_id AS question_id FROM eval_item WHERE item_id % 100 = 0),
b AS (SELECT *, score / greatest(max(score) OVER (PARTITION BY question_id), 0.001) AS normal FROM s WHERE question_id % 100 = 0),
h AS (SELECT a.question_id, p.doc_id AS id, round(0.7 * coalesce(list_cosine_similarity(CAST(qe.embedding AS DOUBLE[]), CAST(de.embedding AS DOUBLE[])), 0) + 0.2 * coalesce(normal, 0), 4) AS score
FROM a CROSS JOIN (SELECT DISTINCT doc_id FROM documents) p LEFT JOIN b ON b.question_id = a.question_id AND b.id = p.doc_id LEFT JOIN embeddings qe ON qe.vec_id = a.question_id LEFT JOIN embeddings de ON de.vec_id = p.doc_id)
SELECT question_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 10""")
def hybrid_topk(spark, d):
    """Semantic and lexical scores of all documents for the stated questions, fused.

    Every document is ranked: one without a vector has semantic score 0, one that shares no word lexical score 0.
    """
    asked = table(spark, d, "eval_item").where("item_id % 100 = 0").select(F.col("item_id").alias("question_id")).distinct()
    lexical = _bm25(spark, d, None, "item_id % 100 = 0").withColumn("normal", search.by_max("score", ["question_id"])).select("question_id", "id", "normal")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    qv = asked.join(e.withColumnRenamed("vec_id", "question_id"), "question_id")
    every = docs(spark, d).select("doc_id").distinct()
    dv = every.join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    near = search.best_cosine_by_group(qv, "question_id", "embedding", dv, "doc_id", "doc_id", "embedding", 12).select("question_id", F.col("doc_id").alias("id"), F.col("score").alias("cosine"))
    pairs = every.select(F.col("doc_id").alias("id")).crossJoin(F.broadcast(asked))
    joined = pairs.join(lexical, ["question_id", "id"], "left").join(near, ["question_id", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = joined.select("question_id", "id", F.round(search.hybrid(zero("cosine"), zero("normal"), F.lit(0.0)), 4).alias("score"))
    w = W.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("question_id", "rank", "id", "score")


@query(f"""WITH e AS (SELECT DISTINCT example_id, doc_id, example_text FROM examples), dt AS (SELECT doc_id, list_distinct({words_sql(fold_sql('text'))}) AS t FROM documents),
et AS (SELECT doc_id, list_distinct({words_sql(fold_sql('example_text'))}) AS t FROM e), every AS (SELECT doc_id, unnest(t) AS w FROM dt UNION ALL SELECT doc_id, unnest(t) FROM et WHERE doc_id IN (SELECT doc_id FROM dt)),
len AS (SELECT doc_id, count(*) AS len FROM every GROUP BY doc_id), tf AS (SELECT doc_id, w, count(*) AS tf FROM every GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM (SELECT doc_id, unnest(t) AS w FROM dt) GROUP BY w),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt), q AS (SELECT item_id AS q, unnest(list_distinct({words_sql(fold_sql('text'))})) AS w FROM eval_item WHERE item_id % 100 = 0),
b AS (SELECT q AS question_id, tf.doc_id, round(sum(greatest(0, ln((n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS s
FROM q JOIN tf USING (w) JOIN len ON len.doc_id = tf.doc_id LEFT JOIN df USING (w), st GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, doc_id) AS rank FROM b WHERE s > 0)
SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, round(round(0.2 * s / (SELECT max(s) FROM b m WHERE m.question_id = r.question_id), 6), 4) AS score FROM r WHERE rank <= 5""")
def kb_search(spark, d):
    """The whole search over a knowledge base of documents and their examples; without vectors it is lexical."""
    q = table(spark, d, "eval_item").where("item_id % 100 = 0").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    e = table(spark, d, "examples").select("example_id", "doc_id", "example_text").distinct()
    found = search.hybrid_search(q, docs(spark, d).select("doc_id", F.col("text").alias("document")), e, k=5)
    return found.select("question_id", "rank", "doc_id", F.round("score", 4).alias("score"))


_KB_LEXICAL = ORACLE["kb_search"].split(", r AS (SELECT *, row_number()")[0]


@query(_KB_LEXICAL + """, a AS (SELECT DISTINCT item_id AS question_id, embedding FROM eval_item JOIN embeddings ON vec_id = item_id WHERE item_id % 100 = 0),
x AS (SELECT question_id, doc_id, max(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)) AS c FROM a, e JOIN embeddings v ON v.vec_id = e.example_id WHERE doc_id IN (SELECT doc_id FROM dt) GROUP BY ALL),
o AS (SELECT question_id, doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS c FROM a, dt JOIN embeddings v ON v.vec_id = dt.doc_id),
n AS (SELECT question_id, doc_id, s / (SELECT max(s) FROM b m WHERE m.question_id = b.question_id) AS n FROM b WHERE s > 0),
f AS (SELECT question_id, doc_id, round(0.7 * (0.7 * coalesce(x.c, 0) + 0.3 * coalesce(o.c, 0)) + 0.2 * coalesce(n, 0), 6) AS f FROM n FULL JOIN x USING (question_id, doc_id) FULL JOIN o USING (question_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY f DESC, doc_id) AS rank FROM f)
SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, round(f, 4) AS score FROM r WHERE rank <= 5""")
def kb_search_vectors(spark, d):
    """The whole search with vectors of the questions, the documents and the examples."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = table(spark, d, "eval_item").where("item_id % 100 = 0").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    q = q.join(v.withColumnRenamed("vec_id", "question_id"), "question_id", "left")
    e = table(spark, d, "examples").select("example_id", "doc_id", "example_text").distinct()
    own = docs(spark, d).select("doc_id", F.col("text").alias("document"))
    said = e.select("example_id", "doc_id").join(v.withColumnRenamed("vec_id", "example_id"), "example_id")
    found = search.hybrid_search(q, own, e, 5, own.select("doc_id").join(v.withColumnRenamed("vec_id", "doc_id"), "doc_id"), said)
    return found.select("question_id", "rank", "doc_id", F.round("score", 4).alias("score"))


@query(f"""WITH g AS (SELECT id, list_distinct({words_sql(fold_sql('question'))}) AS t FROM gold_test_set), o AS (SELECT min(example_id) AS o, t FROM (SELECT example_id, list_sort(list_distinct({words_sql(fold_sql('example_text'))})) AS t FROM examples) WHERE len(t) > 0 GROUP BY t),
p AS (SELECT id, o, len(list_intersect(g.t, o.t)) / (len(g.t) + len(o.t) - len(list_intersect(g.t, o.t))) AS s FROM g, o WHERE len(g.t) > 0),
b AS (SELECT id, count(*) AS n_links, max(s) AS s, arg_min(o, struct_pack(a := -s, b := o)) AS best_id FROM p WHERE s >= 0.8 - 1e-9 GROUP BY id)
SELECT g.id AS new_id, coalesce(n_links, 0) AS n_links, best_id, round(100 * s, 1) AS similarity, CASE WHEN 100 * s >= 95 THEN 'duplicate' WHEN 100 * s >= 80 THEN 'maybe' ELSE 'OK' END AS label FROM g LEFT JOIN b USING (id)""")
def jaccard_near_dup(spark, d):
    new = table(spark, d, "gold_test_set").select("id", search.words_of("question").alias("t"))
    old = table(spark, d, "examples").select("example_id", search.words_of("example_text").alias("t"))
    found = search.near_duplicates(new, "id", old, "example_id", "t")
    score = 100 * F.col("similarity")
    return found.select("new_id", "n_links", "best_id", F.round(score, 1).alias("similarity"), search.label(score).alias("label"))


# Folded words that speak for a domain in the test tables.
DOMAIN_WORDS = {"banking": ["tai khoan", "giao dich", "chuyen tien", "account"], "hrm": ["nhan vien", "nghi phep", "cham cong", "leave"], "card": ["the sen", "han muc the", "card"], "lending": ["tra no", "vay", "loan"]}
_HITS = {n: " + ".join(f"CAST(contains(q, '{w}') AS INTEGER)" for w in ws) for n, ws in DOMAIN_WORDS.items()}


@query(f"""WITH g AS (SELECT id, {fold_sql('question')} AS q FROM gold_test_set), h AS (SELECT id, {', '.join(f'{x} AS {n}' for n, x in _HITS.items())} FROM g), t AS (SELECT *, greatest({', '.join(_HITS)}) AS top FROM h)
SELECT id, CASE WHEN top > 0 AND {' + '.join(f'CAST({n} = top AS INTEGER)' for n in _HITS)} = 1 THEN CASE {' '.join(f"WHEN {n} = top THEN '{n}'" for n in _HITS)} END END AS domain FROM t""")
def classify_unique_winner(spark, d):
    q = T.fold("question")
    counts = {n: sum((F.contains(q, F.lit(w)).cast("int") for w in ws[1:]), F.contains(q, F.lit(ws[0])).cast("int")) for n, ws in DOMAIN_WORDS.items()}
    return table(spark, d, "gold_test_set").select("id", search.unique_winner(counts).alias("domain"))


@query("SELECT example_id, contains(lower(trim(e.source)), lower(trim(d.source))) OR contains(lower(trim(d.source)), lower(trim(e.source))) AS is_match FROM (SELECT DISTINCT example_id, doc_id, source FROM examples) e JOIN documents d ON e.doc_id = d.doc_id")
def batch_is_match(spark, d):
    e = table(spark, d, "examples").select("example_id", "doc_id", "source").distinct()
    return e.join(docs(spark, d).select("doc_id", F.col("source").alias("doc_source")), "doc_id").select("example_id", T.is_match("source", "doc_source").alias("is_match"))


@query("""SELECT example_id, nullif(regexp_extract(example_text, '(?:tài khoản|account)\\s+(\\d{6,16})', 1), '') AS account_no FROM examples""")
def account_extract(spark, d):
    return table(spark, d, "examples").select("example_id", F.nullif(F.regexp_extract("example_text", r"(?:tài khoản|account)\s+(\d{6,16})", 1), F.lit("")).alias("account_no"))


@query("""WITH m AS (SELECT id, regexp_extract(lower(question), '(\\d+(?:[.,]\\d+)*)\\s*(tỷ|triệu|nghìn)', ['n', 'u']) AS g FROM gold_test_set)
SELECT id, CAST(round(CAST(replace(replace(g.n, '.', ''), ',', '.') AS DOUBLE) * CASE g.u WHEN 'tỷ' THEN 1e9 WHEN 'triệu' THEN 1e6 ELSE 1e3 END) AS BIGINT) AS amount FROM m WHERE g.n <> ''""")
def money_parse(spark, d):
    raw = F.regexp_extract(F.lower("question"), r"(\d+(?:[.,]\d+)*\s*(?:tỷ|triệu|nghìn))", 1)
    return table(spark, d, "gold_test_set").withColumn("raw", raw).where("raw <> ''").select("id", entities.money(F.col("raw")).cast("long").alias("amount"))


@query()
def entity_maps(spark, d):
    """The entities of every gold question, by its gold domain."""
    return table(spark, d, "gold_test_set").select("id", F.to_json(entities.entities(F.col("question"), F.col("gold.domain"), AS_OF)).alias("entities"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values([(q, k, v) for q, _, e in cases.ENTITIES for k, v in e.items()])}) t(question, entity, value)")
def entity_cases(spark, d):
    """Questions whose entities are known: each known entity with the value that is read."""
    rows = [(q, domain, k) for q, domain, e in cases.ENTITIES for k in e]
    df = spark.createDataFrame(rows, "question string, domain string, entity string")
    return df.withColumn("e", entities.entities(F.col("question"), F.col("domain"), AS_OF)).select("question", "entity", F.try_element_at("e", F.col("entity")).alias("value"))


@query(f"SELECT * FROM (VALUES {_values(cases.TIMES)}) t(expression, first_day, last_day)")
def time_cases(spark, d):
    """Time expressions whose days are known."""
    r = dates.time_range(F.col("expression"), AS_OF)
    df = spark.createDataFrame([(x,) for x, _, _ in cases.TIMES], "expression string").withColumn("r", r)
    return df.select("expression", F.date_format("r.start", "yyyy-MM-dd").alias("first_day"), F.date_format("r.end", "yyyy-MM-dd").alias("last_day"))


@query()
def time_ranges(spark, d):
    r = dates.time_range(F.col("question"), AS_OF)
    return table(spark, d, "gold_test_set").select("id", r.alias("r")).select("id", "r.start", "r.end")


ENTRIES = [route.Entry(n, keywords=ws, words=sorted({w for x in ws for w in x.split()})) for n, ws in DOMAIN_WORDS.items()]


def routed(spark, d):
    return table(spark, d, "gold_test_set").withColumn("ranking", route.ranked(F.col("question"), ENTRIES))


_SCORE = {e.name: " + ".join([*(f"CASE WHEN contains(q, '{k}') THEN 2.0 ELSE 0.0 END" for k in e.keywords), f"0.3 * len(list_intersect(list_distinct({words_sql('q')}), {e.words}))"]) for e in ENTRIES}


@query(f"""WITH g AS (SELECT id, {fold_sql('question')} AS q FROM gold_test_set), s AS (SELECT id, unnest([{', '.join(f"struct_pack(name := '{n}', i := {i}, score := {x})" for i, (n, x) in enumerate(_SCORE.items()))}]) AS r FROM g),
k AS (SELECT id, r.name AS name, r.score / CASE WHEN max(r.score) OVER (PARTITION BY id) > 0 THEN max(r.score) OVER (PARTITION BY id) ELSE 1.0 END AS score, row_number() OVER (PARTITION BY id ORDER BY round(r.score, 9) DESC, r.i) AS rank FROM s)
SELECT id, name AS domain, round(score, 4) AS score FROM k WHERE rank = 1""")
def route_domain(spark, d):
    return routed(spark, d).select("id", F.get("ranking", F.lit(0)).alias("r")).select("id", F.col("r.name").alias("domain"), F.round("r.score", 4).alias("score"))


_RANKED_SQL = ORACLE["route_domain"].split("SELECT id, name AS domain, round(score, 4)")[0] + ", a AS (SELECT id, max(CASE WHEN rank = 1 THEN name END) AS first, max(CASE WHEN rank = 1 THEN score END) AS x, max(CASE WHEN rank = 2 THEN name END) AS second, max(CASE WHEN rank = 2 THEN score END) AS y FROM k GROUP BY id)"


@query(_RANKED_SQL + f" SELECT id, CASE WHEN x - y < {route.SHORTLIST_GAP} OR coalesce(y / nullif(x, 0), 0) >= {route.SHORTLIST_RATIO} THEN [first, second] ELSE [first] END AS domains FROM a")
def route_shortlist(spark, d):
    return routed(spark, d).select("id", route.shortlist(F.col("ranking")).alias("domains"))


@query(_RANKED_SQL + """, c AS (SELECT gold.domain IS NULL OR gold.domain = first AS p, len(list_filter(coalesce(gold.tables, []), lambda t: t IS DISTINCT FROM 'attendance')) = 0 AS t FROM gold_test_set JOIN a USING (id))
SELECT count(*) AS cases, round(avg(CAST(p AS INTEGER)), 4) AS domain, round(avg(CAST(t AS INTEGER)), 4) AS tables, round(avg(CAST(p AND t AS INTEGER)), 4) AS "all" FROM c""")
def eval_scorecard(spark, d):
    r = routed(spark, d).withColumn("predicted", F.get("ranking", F.lit(0))["name"])
    return evaluate.scorecard(r, {"domain": evaluate.exact(F.col("gold.domain"), F.col("predicted")), "tables": evaluate.covers(F.col("gold.tables"), F.array(F.lit("attendance")))})


_CLASSIFIED = ORACLE["classify_unique_winner"]


@query(f"""WITH c AS ({_CLASSIFIED}), j AS (SELECT g.gold.domain AS gold, c.domain AS predicted FROM gold_test_set g JOIN c USING (id)),
e AS (SELECT gold AS label, count(*) FILTER (gold = predicted) AS tp, 0 AS fp, count(*) FILTER (gold IS DISTINCT FROM predicted) AS fn FROM j WHERE gold IS NOT NULL GROUP BY ALL
UNION ALL SELECT predicted, 0, count(*) FILTER (gold IS DISTINCT FROM predicted), 0 FROM j WHERE predicted IS NOT NULL GROUP BY ALL),
s AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM e GROUP BY label), r AS (SELECT label, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s)
SELECT label, CAST(support AS BIGINT) AS support, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r""")
def eval_prf1(spark, d):
    g = table(spark, d, "gold_test_set").select("id", F.col("gold.domain").alias("gold")).join(classify_unique_winner(spark, d), "id")
    return evaluate.prf(evaluate.label_counts(g, "gold", "domain"), ["label"])


@query("SELECT difficulty, count(*) AS n, round(avg(CASE WHEN gold.validator = 'PASS' THEN 1 ELSE 0 END), 4) AS accuracy FROM gold_test_set GROUP BY difficulty")
def accuracy_by_difficulty(spark, d):
    return evaluate.accuracy_by(table(spark, d, "gold_test_set"), "difficulty", F.col("gold.validator") == "PASS")


@query()
def bootstrap_ci(spark, d):
    g = table(spark, d, "gold_test_set").select("id", (F.col("gold.validator") == "PASS").cast("double").alias("hit"))
    return evaluate.bootstrap(g, "id", "hit")


@query("SELECT count(*) AS queries, count_if(validator = 'PASS') AS passed, count_if(validator = 'FAIL') AS failed, round(avg(confidence_score), 4) AS mean_confidence, round(avg(timing_execution), 4) AS mean_execution FROM (SELECT DISTINCT query_id, validator, confidence_score, timing_execution FROM query_log)")
def batch_summary(spark, d):
    q = table(spark, d, "query_log").select("query_id", "validator", "confidence_score", "timing_execution").distinct()
    return q.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("validator") == "PASS").alias("passed"), F.count_if(F.col("validator") == "FAIL").alias("failed"), F.round(F.avg("confidence_score"), 4).alias("mean_confidence"), F.round(F.avg("timing_execution"), 4).alias("mean_execution"))
