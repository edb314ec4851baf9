"""Retrieval over batches of questions: dot-product and BM25 top-k, fusion, near-duplicate search.

A stated set of questions is scored against all rows in blocks: every task scores its rows against one block of
questions as a matrix product and keeps its own k best per question, so what is shuffled is questions times k
a task, never pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

from tamarind.functions import text as T

K1, B = 1.5, 0.75
SEMANTIC_EXAMPLE, SEMANTIC_TEXT = 0.7, 0.3
HYBRID = (0.7, 0.2, 0.1)
#: Questions of one block, for vectors and for words: bounds the driver's and every task's share of the query side.
BLOCK, WORD_BLOCK = 10_000, 1_000
#: Rows scored against a block at once.
ROWS = 256
#: Maxima by question and group that a task holds before it gives them out.
CELLS = 4_000_000


class _Best:
    """The k best (score, id) of each question; equal scores go to the smaller id."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits, self.heaps = k, digits, {}

    def add(self, question: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.round(scores, self.digits)
        heap = self.heaps.setdefault(question, [])
        order = np.lexsort((ids, -scores))[: self.k]
        for s, i in zip(scores[order].tolist(), ids[order].tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
            else:
                break

    def batch(self, names: list) -> pa.RecordBatch:
        rows = [(names[q], -i, s) for q, heap in self.heaps.items() for s, i in heap]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["question_id", "id", "score"])


_TOP = "question_id long, id long, score double"


def _last_rank(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each question out of the tasks' own best."""
    best = parts.groupBy("question_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("b"))
    return best.select("question_id", F.posexplode("b").alias("rank", "b")).select("question_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def _blocks(df: DataFrame, key: str, size: int) -> list[DataFrame]:
    n = df.count()
    parts = max(1, -(-n // size))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_k_cosine(questions: DataFrame, question_id: str, question_vec: str, rows: DataFrame, row_id: str, row_vec: str, k: int = 10, digits: int = 6) -> DataFrame:
    """(question_id, rank, id, score): the k rows of greatest cosine for each question.

    Scores are rounded to `digits`; ties go to the smaller id. Null vectors, and vectors of another length than
    the question's, are left out; a zero vector has cosine 0. Ids are whole numbers.
    """
    parts = []
    for block in _blocks(questions.where(F.col(question_vec).isNotNull()), question_id, BLOCK):
        shared = rows.sparkSession.sparkContext.broadcast(_by_length(block.select(question_id, question_vec).collect(), True))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {size: _Best(k, digits) for size in shared.value}
            for ids, size, m in _vectors(batches, set(shared.value)):
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                score = shared.value[size][1] @ m.T
                for i in range(len(score)):
                    held[size].add(i, score[i], ids.to_numpy(zero_copy_only=False))
            for size, best in held.items():
                yield best.batch(shared.value[size][0])

        parts.append(rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long"), row_vec).mapInArrow(run, _TOP))
    return _last_rank(_union(parts), k)


def _by_length(rows: list, unit: bool) -> dict[int, tuple[list, np.ndarray]]:
    """Vectors as a matrix for each length, with their ids."""
    out = {}
    for size in {len(r[1]) for r in rows}:
        own = [r for r in rows if len(r[1]) == size]
        m = np.array([r[1] for r in own], np.float64)
        out[size] = ([r[0] for r in own], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if unit else m)
    return out


def _vectors(batches: Iterator[pa.RecordBatch], sizes: set[int]) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(keys, length, matrix) of at most ROWS vectors of one length each; other lengths and nulls are passed over."""
    for b in batches:
        lists = b.column(1)
        off = lists.offsets.to_numpy()
        lengths, starts = np.diff(off), off[:-1] - off[0]
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        for size in sizes:
            every = np.flatnonzero((lengths == size) & lists.is_valid().to_numpy(zero_copy_only=False))
            for a in range(0, len(every), ROWS):
                at = every[a : a + ROWS]
                yield b.column(0).take(pa.array(at)), size, flat[starts[at][:, None] + np.arange(size)]


def max_dot_by_group(questions: DataFrame, question_id: str, question_vec: str, rows: DataFrame, group: str, row_vec: str, digits: int = 6) -> DataFrame:
    """(question_id, group, score_max_example): the greatest dot product of each question with the rows of each group.

    Tasks keep one maximum for each question and group, which is all that is shuffled. A null group is a group.
    """
    kind = rows.schema[group].dataType
    parts = []
    for block in _blocks(questions.where(F.col(question_vec).isNotNull()), question_id, BLOCK):
        shared = rows.sparkSession.sparkContext.broadcast(_by_length(block.select(question_id, question_vec).collect(), False))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, object], np.ndarray] = {}
            arrow = None
            for groups, size, m in _vectors(batches, set(shared.value)):
                arrow = groups.type
                score = shared.value[size][1] @ m.T
                names = np.array(groups.to_pylist(), object)
                for g in set(names.tolist()):
                    top = score[:, np.equal(names, g).astype(bool)].max(axis=1)
                    key = (size, g)
                    best[key] = np.maximum(best[key], top) if key in best else top
            for (size, g), top in best.items():
                ids = shared.value[size][0]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g] * len(ids), arrow), pa.array(np.round(top, digits))], ["question_id", "g", "s"])

        schema = T_.StructType([T_.StructField("question_id", T_.LongType()), T_.StructField("g", kind), T_.StructField("s", T_.DoubleType())])
        parts.append(rows.select(group, row_vec).mapInArrow(run, schema))
    return _union(parts).groupBy("question_id", F.col("g").alias(group)).agg(F.max("s").alias("score_max_example"))


def best_cosine_by_group(questions: DataFrame, question_id: str, question_vec: str, rows: DataFrame, group: str, row_id: str, row_vec: str, digits: int = 6) -> DataFrame:
    """(question_id, group, score, id): for each question and every group, the greatest cosine of its rows and the row that has it (the smallest of equals).

    All rows are scored; tasks keep one maximum for each question and group and give theirs out early when they hold
    more than CELLS of them. Null vectors, groups and ids, and vectors of another length than the question's, are left
    out; a zero vector has cosine 0. Groups and ids are whole numbers.
    """
    parts = []
    for block in _blocks(questions.where(F.col(question_vec).isNotNull()), question_id, BLOCK):
        shared = rows.sparkSession.sparkContext.broadcast(_by_length(block.select(question_id, question_vec).collect(), True))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {size: [] for size in shared.value}
            cells = dict.fromkeys(held, 0)
            for keys, size, m in _vectors(batches, set(shared.value)):
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                score = np.round(m @ shared.value[size][1].T, digits)
                held[size].append(_best_of_groups(*[c.to_numpy(zero_copy_only=False) for c in keys.flatten()], score))
                cells[size] += held[size][-1][2].size
                if cells[size] > CELLS:
                    held[size] = [_best_of_groups(*map(np.concatenate, zip(*held[size])))]
                    cells[size] = held[size][0][2].size
                    if cells[size] > CELLS // 2:
                        yield from _group_batches(shared.value[size][0], *held[size][0])
                        held[size], cells[size] = [], 0
            for size, kept in held.items():
                if kept:
                    yield from _group_batches(shared.value[size][0], *_best_of_groups(*map(np.concatenate, zip(*kept))))

        keyed = rows.where(F.col(group).isNotNull() & F.col(row_id).isNotNull())
        parts.append(keyed.select(F.struct(F.col(group).cast("long").alias("g"), F.col(row_id).cast("long").alias("i")), row_vec).mapInArrow(run, "question_id long, g long, id long, score double"))
    best = _union(parts).groupBy("question_id", F.col("g").alias(group)).agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("question_id", group, F.col("b.score").alias("score"), (-F.col("b.i")).alias("id"))


def _best_of_groups(groups: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a group out of score (rows by questions); ids are by row, or by row and question."""
    if ids.ndim == 1:
        ids = np.repeat(ids[:, None], score.shape[1], axis=1)
    order = np.argsort(groups, kind="stable")
    groups, ids, score = groups[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    top = np.maximum.reduceat(score, first, axis=0)
    is_top = score == np.repeat(top, np.diff(np.append(first, len(groups))), axis=0)
    return groups[first], np.minimum.reduceat(np.where(is_top, ids, np.iinfo(np.int64).max), first, axis=0), top


def _group_batches(names: list, groups: np.ndarray, ids: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, 100_000 // len(names))
    for a in range(0, len(groups), step):
        g, i, s = groups[a : a + step], ids[a : a + step], score[a : a + step]
        cols = [np.tile(np.array(names, np.int64), len(g)), np.repeat(g, len(names)), i.ravel(), s.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["question_id", "g", "id", "score"])


def corpus_stats(docs: DataFrame, tokens: str) -> tuple[int, float]:
    """(documents, mean length in tokens)."""
    r = docs.agg(F.count(F.lit(1)), F.avg(F.size(tokens))).first()
    return r[0], float(r[1] or 0.0)


def bm25(questions: DataFrame, question_id: str, question_tokens: str, docs: DataFrame, doc_id: str, doc_tokens: str, k: int | None = 10, k1: float = K1, b: float = B, digits: int = 6, stats_tokens: str | None = None) -> DataFrame:
    """(question_id, rank, id, score) of the k best documents for each question, or with k=None all scores above 0, unranked.

    idf = max(0, ln((N - df + 0.5) / (df + 0.5) + 1)) with df at least 1; the sum runs over a question's distinct
    tokens; a document's token counts as often as it occurs. Documents that share no token score 0 and are left
    out. Null token arrays are empty. `stats_tokens` names another column for df and the mean length. Two passes over the documents: one for the statistics, one for the scores.
    """
    none = F.array().cast("array<string>")
    stats = docs.select(F.coalesce(stats_tokens or doc_tokens, none).alias("t"))
    docs = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(doc_tokens, none).alias("t"))
    n, mean = corpus_stats(stats, "t")
    parts = []
    for block in _blocks(questions, question_id, WORD_BLOCK):
        got = [(r[0], sorted(set(r[1] or []))) for r in block.select(F.col(question_id).cast("long"), question_tokens).collect()]
        terms = {w: i for i, w in enumerate(sorted({w for _, ws in got for w in ws}))}
        if not terms:
            continue
        words = docs.sparkSession.createDataFrame([(w,) for w in terms], "w string")
        seen = stats.select(F.explode(F.array_distinct("t")).alias("w")).join(F.broadcast(words), "w").groupBy("w").agg(F.count(F.lit(1)).alias("df")).collect()
        df = np.ones(len(terms))
        for r in seen:
            df[terms[r["w"]]] = max(1, min(r["df"], n))
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5) + 1))
        weight = np.zeros((len(terms), len(got)))
        for j, (_, ws) in enumerate(got):
            for w in ws:
                weight[terms[w], j] = idf[terms[w]]
        shared = docs.sparkSession.sparkContext.broadcast((terms, [q for q, _ in got], weight, mean or 1.0))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, names, weight, mean = shared.value
            known = pa.array(list(terms), pa.string())
            best = _Best(k or 1, digits)
            for whole in batches:
                for a in range(0, whole.num_rows, 512):
                    part = whole.slice(a, 512)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    length = np.diff(part.column(1).offsets.to_numpy()).astype(np.float64)
                    at = pc.index_in(part.column(1).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(ids)), length.astype(np.int64))
                    hit = at >= 0
                    tf = np.bincount(row[hit] * len(terms) + at[hit], minlength=len(ids) * len(terms)).reshape(len(ids), len(terms)).astype(np.float64)
                    score = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)[:, None])) @ weight
                    if k is None:
                        r, c = np.nonzero(score > 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[c], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(np.round(score[r, c], digits))], ["question_id", "id", "score"])
                        continue
                    for q in range(len(names)):
                        at = np.flatnonzero(score[:, q] > 0)
                        if len(at):
                            best.add(q, score[at, q], ids[at])
            if k is not None:
                yield best.batch(names)

        parts.append(docs.mapInArrow(run, _TOP))
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], _TOP)]
    out = _union(parts)
    return _last_rank(out, k) if k is not None else out.select("question_id", "id", "score")


def embed(df: DataFrame, text: str, encode, out: str = "vector", batch: int = 32, prefix: str = "passage: ") -> DataFrame:
    """df plus the unit vector of each text by `encode` (a function that makes an encoder of list[str] to a matrix).

    The encoder is made once a task and called with `batch` texts at a time. Null texts have null vectors.
    """
    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for s in parts:
            made: list = [None] * len(s)
            there = [i for i, t in enumerate(s) if t is not None]
            for a in range(0, len(there), batch):
                at = there[a : a + batch]
                m = np.asarray(model([prefix + s.iloc[i] for i in at]), np.float32)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                for i, v in zip(at, m):
                    made[i] = v.tolist()
            yield pd.Series(made)

    return df.withColumn(out, run(F.col(text)))


def hybrid_search(questions: DataFrame, docs: DataFrame, examples: DataFrame | None = None, k: int = 10, vectors: DataFrame | None = None, example_vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, rank, doc_id, score, score_semantic, score_bm25, score_keyword_boost, best_matching_example) of the k best documents.

    questions: question_id, question, and optionally vector. docs: doc_id, document, and optionally description and
    keyword. examples: example_id, doc_id, example_text. vectors: doc_id, vector of the documents' search texts;
    example_vectors: example_id, doc_id, vector. A document's token counts once for itself and once for each example
    that has it; lengths hold the examples, the mean length and document frequencies don't. Without vectors the
    semantic score is 0. The semantic score has the greatest cosine of all examples of a document and the cosine of its
    own vector. The candidates are all documents that share a word or have a vector, their own or an example's; equal
    scores go to the smaller doc_id.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_distinct(T.words(T.fold(F.concat_ws(" ", F.coalesce("document", F.lit("")), has("description"), has("keyword"))))).alias("own"), T.parse_keywords(has("keyword")).alias("keywords"))
    if examples is not None:
        said = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(T.words(T.fold("example_text")))).alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("said"))
        own = own.join(said, "doc_id", "left").withColumn("every", F.concat("own", F.coalesce("said", F.array().cast("array<string>")))).drop("said")
    else:
        own = own.withColumn("every", F.col("own"))
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), "question", T.words(T.fold("question")).alias("qt"))
    lexical = bm25(asked, "question_id", "qt", own, "doc_id", "every", None, stats_tokens="own").select("question_id", F.col("id").alias("doc_id"), F.col("score").alias("bm25"))
    scores = lexical.withColumn("score_bm25", by_max("bm25", ["question_id"])).drop("bm25").withColumn("semantic", F.lit(0.0)).withColumn("example_id", F.lit(None).cast("long"))
    for df, share in ((example_vectors, SEMANTIC_EXAMPLE), (vectors, SEMANTIC_TEXT)):
        if df is None or "vector" not in questions.columns:
            continue
        is_example = share == SEMANTIC_EXAMPLE
        best = best_cosine_by_group(questions, "question_id", "vector", df, "doc_id", "example_id" if is_example else "doc_id", "vector")
        best = best.select("question_id", "doc_id", F.col("score").alias("score_max_example"), F.col("id").alias("near_id"))
        scores = scores.join(best, ["question_id", "doc_id"], "full").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)) + share * F.coalesce("score_max_example", F.lit(0.0)))
        scores = scores.withColumn("example_id", F.coalesce("near_id", "example_id") if is_example else F.col("example_id")).drop("score_max_example", "near_id")
    full = scores.join(own.select("doc_id", "keywords"), "doc_id").join(asked.select("question_id", "question"), "question_id")
    full = full.withColumn("score_keyword_boost", keyword_boost(F.col("keywords"), F.col("question"))).withColumn("score_bm25", F.coalesce("score_bm25", F.lit(0.0)))
    full = full.withColumn("score", F.round(hybrid(F.col("semantic"), F.col("score_bm25"), F.col("score_keyword_boost")), 6))
    cols = [F.col("semantic").alias("score_semantic"), "score_bm25", "score_keyword_boost"]
    w = W.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")  # its filter keeps k a task before the shuffle
    ranked = full.select("question_id", "doc_id", "score", *cols, "example_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    if examples is None:
        named = ranked.withColumn("best_matching_example", F.lit(None).cast("string"))
    else:
        named = ranked.join(examples.groupBy("example_id").agg(F.first("example_text").alias("best_matching_example")), "example_id", "left")
    return named.select("question_id", "rank", "doc_id", "score", "score_semantic", "score_bm25", "score_keyword_boost", "best_matching_example")


def keyword_boost(keywords: Column, question: Column, each: float = 0.25) -> Column:
    """0.25 for each keyword the question contains, at most 1; without keywords 0."""
    q = F.lower(question)
    return F.least(F.lit(1.0), F.lit(each) * F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(q, F.lower(k)))))


def max_similarity(scores: DataFrame, group: list[str], score: str, example: str) -> DataFrame:
    """group, best score, and the example that has it (the smallest of equals)."""
    return scores.groupBy(*group).agg(F.max(score).alias("score_max_example"), F.min_by(example, F.struct(-F.col(score), F.col(example))).alias("best_matching_example"))


def hybrid(semantic: Column, bm25_normal: Column, boost: Column) -> Column:
    return HYBRID[0] * semantic + HYBRID[1] * bm25_normal + HYBRID[2] * boost


def by_max(score: str, group: list[str]) -> Column:
    """Scores over the greatest of their group; 0.001 is the least divisor."""
    return F.col(score) / F.greatest(F.max(score).over(W.partitionBy(*group)), F.lit(0.001))


def unique_winner(counts: dict[str, Column]) -> Column:
    """The name of the greatest count; null if it is 0 or shared."""
    top = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    names = F.filter(F.array(*[F.when(c == top, F.lit(n)) for n, c in counts.items()]), lambda x: x.isNotNull())
    return F.when((top > 0) & (F.size(names) == 1), names[0])


def label(score: Column) -> Column:
    """duplicate from 95, maybe from 80, else OK."""
    return F.when(score >= 95, "duplicate").when(score >= 80, "maybe").otherwise("OK")


def document_similarity(name_ratio: Column, keywords: Column, examples: Column) -> Column:
    """0 to 100, one decimal: half the ratio of the names, 0.3 the Jaccard of keywords, 0.2 that of examples."""
    return F.round(0.5 * name_ratio + 30 * keywords + 20 * examples, 1)


def near_duplicates(new: DataFrame, new_id: str, old: DataFrame, old_id: str, tokens: str, least: float = 0.8) -> DataFrame:
    """(new_id, n_links, best_id, similarity) for each new row: how many classes of old rows are as alike as `least`, and the nearest.

    Old rows with one token set are one class, named by its smallest id, and counted once. Candidates share one
    of the rarest tokens (as many as a similarity of `least` leaves unshared, and one), so frequent tokens join
    nothing; each candidate is settled by the Jaccard of the whole sets. New rows without a link have 0 and nulls.
    Rows without tokens match nothing.
    """
    sets = lambda df, i, names: df.select(F.col(i).alias(names[0]), F.sort_array(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))).alias(names[1]))
    classes = sets(old, old_id, ("o", "ot")).where(F.size("ot") > 0).groupBy("ot").agg(F.min("o").alias("o"))
    fresh = sets(new, new_id, ("n", "nt"))
    df = classes.select(F.explode("ot").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def rare(side: DataFrame, i: str, ts: str) -> DataFrame:
        each = side.select(i, F.size(ts).alias("_size"), F.explode(ts).alias("w")).join(df, "w", "left")
        ranked = each.groupBy(i, "_size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("r"))
        keep = F.col("_size") - F.ceil(F.col("_size") * least - 1e-9).cast("int") + 1
        return ranked.select(i, F.explode(F.slice("r", F.lit(1), keep)).alias("r")).select(i, F.col("r.w").alias("w"))

    pairs = rare(fresh, "n", "nt").join(rare(classes, "o", "ot"), "w").select("n", "o").distinct()
    full = pairs.join(fresh, "n").join(classes, "o").withColumn("s", T.jaccard(F.col("nt"), F.col("ot"))).where(F.col("s") >= least - 1e-9)
    best = full.groupBy("n").agg(F.count(F.lit(1)).alias("n_links"), F.max("s").alias("similarity"), F.min_by("o", F.struct(-F.col("s"), F.col("o"))).alias("best_id"))
    return fresh.select("n").distinct().join(best, "n", "left").select(F.col("n").alias("new_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_id", "similarity")


def words_of(c: str) -> Column:
    return T.words(T.fold(c))


