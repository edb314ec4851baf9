"""Evaluation texts leaking into training text: latent semantic retrieval, then word-sequence checks.

Documents and evaluation items are cut into passages over the words of the items. TF-IDF passages (document
frequencies over all documents) get their latent space from a distributed randomised SVD over all passages;
items are sought by the cosine in that space; what is near enough is settled by sequence checks on the words: so many
words in a row, or, for paraphrases, the longest common subsequence and whether the item's answers (words
with digits) are there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm import codepoints as C
from tamarind.plans.shared import cut

#: Words in a row that make a leak.
RUN = 12
#: Document passages are SPAN words and start every BLOCK words, so any run of RUN words lies whole in one.
BLOCK = 4
SPAN = RUN + BLOCK
_SPAN_BLOCKS = SPAN // BLOCK
#: Item passages of RUN words start every ITEM_STRIDE words.
ITEM_STRIDE = 2
#: Rank of the latent space, and extra columns of the random test matrix.
RANK, EXTRA = 40, 24
#: Least cosine of a candidate in the latent space, and of one that may be a paraphrase.
NEAR, PARAPHRASE = 0.6, 0.75
#: A paraphrase shares a subsequence of so many of a passage's RUN words, so a passage must have as many words of items.
LEAST_WORDS = math.ceil(0.75 * RUN)
#: Distinct words of evaluation text in one latent space: bounds the matrices of the driver and of every task.
MOST_WORDS = 1_000_000
#: Words of evaluation text that are sought at a time: bounds the passages' vectors and their broadcast.
SHARD_WORDS = 100_000
#: Partial sums that one task puts together.
FAN = 32
_CHUNK_WORDS = 30_000
#: Passages whose cosines with all item passages of a shard are held at once.
_SCORED = 512


@dataclass
class Items:
    """Evaluation items by word: one shard of those that share a vocabulary."""

    ids: np.ndarray
    words: np.ndarray  # places in the vocabulary, item after item, and one place beyond it after each
    passage_item: np.ndarray
    passage_at: np.ndarray  # places in words
    gram_keys: np.ndarray  # sorted keys of (run of words, item)
    gram_at: np.ndarray  # where in words each begins
    gram_there: np.ndarray  # by the last bits of a key: False where no such key is

    def heads(self) -> np.ndarray:
        """The first passage of each item, and the end."""
        return np.searchsorted(self.passage_item, np.arange(len(self.ids) + 1))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    digit: np.ndarray  # whether the word has a digit

    def __len__(self) -> int:
        return len(self.hashes)


def _grams(ids: np.ndarray, n: int = RUN) -> np.ndarray:
    """A 64-bit key for each run of n words."""
    seed = C.mix(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + seed[j : j + len(out)]
    return out


def _with_item(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
    return C.mix(gram ^ C.mix(item.astype(np.uint64) + np.uint64(0x51ED2701)))


def vocabulary_of(texts: list[str]) -> Vocabulary:
    w = C.words(*C.to_codepoints(pa.array(texts, pa.string())))
    hashes, first = np.unique(w.hash, return_index=True)
    return Vocabulary(hashes, w.digit[first])


def items_of(ids: list[int], texts: list[str], vocabulary: Vocabulary) -> Items:
    w = C.words(*C.to_codepoints(pa.array(texts, pa.string())))
    at = np.searchsorted(vocabulary.hashes, w.hash).astype(np.int32)
    beyond = np.int32(len(vocabulary))
    words, item, start, keys, places, base = [], [], [], [], [], 0
    for i in range(len(ids)):
        ws = at[w.row == i]
        last = len(ws) - RUN
        if last >= 0:
            starts = sorted({*range(0, last + 1, ITEM_STRIDE), last})
            item += [i] * len(starts)
            start += [base + x for x in starts]
            g = _grams(ws)
            keys.append(_with_item(g, np.full(len(g), i)))
            places.append(base + np.arange(len(g)))
        words += [ws, [beyond]]
        base += len(ws) + 1
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    at_all = np.concatenate(places)[order] if keys else np.zeros(0, np.int64)
    flat = np.concatenate(words).astype(np.int32) if words else np.zeros(0, np.int32)
    there = np.zeros(1 << max(10, (16 * len(key)).bit_length()), bool)
    there[key & np.uint64(len(there) - 1)] = True
    return Items(np.array(ids, np.int64), flat, np.array(item, np.int64), np.array(start, np.int64), key[order], at_all, there)


_KEPT = "doc_id long, words array<int>, mixed boolean, seen array<int>, df array<long>, docs long"
_KEPT_NAMES = ["doc_id", "words", "mixed", "seen", "df", "docs"]


def _segments(vocabulary, paraphrases: bool):
    """Documents to their stretches of at least RUN words that all occur in items; and a row a task with document frequencies.

    For paraphrases also, as `mixed`, the passages outside those stretches that have LEAST_WORDS words of items, end to
    end where they follow each other; a word that no item has is the place after the vocabulary.
    """

    def rows(doc: pa.Array, off: np.ndarray, words: np.ndarray, mixed: bool) -> pa.RecordBatch:
        n = len(doc)
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(words, pa.int32()))
        return pa.RecordBatch.from_arrays([doc, lists, pa.array(np.full(n, mixed)), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], _KEPT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = vocabulary.value.hashes
        n = len(hashes)
        df, docs = np.zeros(n, np.int64), 0
        for whole in batches:
            for b in C.pieces(whole, 1):
                docs += b.num_rows
                w = C.words(*C.to_codepoints(b.column(1)))
                if not len(w.hash) or not n:
                    continue
                at = np.minimum(np.searchsorted(hashes, w.hash), n - 1)
                known = hashes[at] == w.hash
                pairs = np.sort(w.row[known].astype(np.int64) * n + at[known])
                first = np.ones(len(pairs), bool)
                first[1:] = pairs[1:] != pairs[:-1]
                df += np.bincount(pairs[first] % n, minlength=n)
                opens = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (w.row[1:] != w.row[:-1])]))
                length = np.diff(np.concatenate([opens, [len(known)]]))
                good = known[opens] & (length >= RUN)
                inside = np.repeat(good, length)
                yield rows(b.column(0).take(pa.array(w.row[opens[good]])), np.concatenate([[0], np.cumsum(length[good])]), at[inside].astype(np.int32), False)
                if paraphrases:
                    start, end = _mixed(w.row, known, inside)
                    length = end - start
                    off = np.concatenate([[0], np.cumsum(length)])
                    places = np.repeat(start - off[:-1], length) + np.arange(off[-1])
                    yield rows(b.column(0).take(pa.array(w.row[start])), off, np.where(known, at, n)[places].astype(np.int32), True)
        seen = np.flatnonzero(df)
        one = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([False]), pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([df[seen].tolist()], pa.list_(pa.int64())), pa.array([docs], pa.int64())]
        yield pa.RecordBatch.from_arrays(one, _KEPT_NAMES)

    return run


def _windows(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the passages of segments laid end to end."""
    n = np.maximum(-(-(length - SPAN) // BLOCK), 0) + 1
    seg = np.repeat(np.arange(len(length)), n)
    off = np.concatenate([[0], np.cumsum(length)])
    start = off[seg] + BLOCK * (np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n))
    return seg, start, np.minimum(start + SPAN, off[seg + 1])


def _mixed(row: np.ndarray, known: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of document passages with LEAST_WORDS known words that aren't wholly inside a stretch."""
    opens = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    seg, start, end = _windows(np.diff(np.append(opens, len(row))))
    n_known, n_inside = [np.concatenate([[0], np.cumsum(x)]) for x in (known, inside)]
    kept = np.flatnonzero((n_known[end] - n_known[start] >= LEAST_WORDS) & (n_inside[end] - n_inside[start] < end - start))
    follows = (np.diff(kept) == 1) & (np.diff(seg[kept]) == 0)
    return start[kept[np.concatenate([[True], ~follows])[: len(kept)]]], end[kept[np.concatenate([~follows, [True]])[: len(kept)]]]


def _chunks(batches: Iterator[pa.RecordBatch], beyond: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words in blocks, first block of each passage, its segment, documents by segment), about _CHUNK_WORDS words at a time.

    Each segment is filled up to whole blocks, and to a whole passage, with the word beyond the vocabulary.
    """
    for b in batches:
        lists = b.column(1)
        off = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy()
        docs = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff((off[1:] - off[0]) // _CHUNK_WORDS)) + 1, [b.num_rows]])
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                length = np.diff(off[a : z + 1])
                blocks = np.maximum(-(-length // BLOCK), _SPAN_BLOCKS)
                first = np.cumsum(blocks) - blocks
                laid = np.full(int(blocks.sum()) * BLOCK, beyond, np.int32)
                laid[np.repeat(first * BLOCK - (off[a:z] - off[a]), length) + np.arange(off[z] - off[a])] = words[off[a] : off[z]]
                n = blocks - _SPAN_BLOCKS + 1
                seg = np.repeat(np.arange(len(length)), n)
                yield laid.reshape(-1, BLOCK), first[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n), seg, docs[a:z]


def _block_sums(rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    out = rows[blocks[:, 0]]
    for j in range(1, BLOCK):
        out += rows[blocks[:, j]]
    return out


def _passage_sums(rows: np.ndarray, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of rows over the words of each passage."""
    by_block = _block_sums(rows, blocks)
    out = by_block[first]
    for j in range(1, _SPAN_BLOCKS):
        out += by_block[first + j]
    return out


def _times_gram(blocks: np.ndarray, first: np.ndarray, weighted: np.ndarray, idf: np.ndarray, total: np.ndarray) -> None:
    """Adds A'A x over these passages to `total`, for the rows A of unit TF-IDF passages and weighted = idf * x; the last row is the word beyond."""
    square = _passage_sums((idf**2)[:, None], blocks, first)
    t = _passage_sums(weighted, blocks, first) / np.maximum(square, np.float32(1e-12))
    by_block = np.zeros((len(blocks), weighted.shape[1]), np.float32)
    for j in range(_SPAN_BLOCKS):
        by_block[first + j] += t  # passages begin at blocks of their own
    flat = blocks.ravel()
    order = np.argsort(flat, kind="stable")
    ids = flat[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total[ids[at]] += np.add.reduceat(by_block[order // BLOCK], at, axis=0) * idf[ids[at]][:, None]


def _item_blocks(items: Items, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """The items' passages as blocks, each filled up to a whole passage."""
    laid = np.full((len(items.passage_at), SPAN), beyond, np.int32)
    laid[:, :RUN] = items.words[items.passage_at[:, None] + np.arange(RUN)]
    return laid.reshape(-1, BLOCK), np.arange(len(laid)) * _SPAN_BLOCKS


_SUM = "slot int, m binary"


def _summed(parts: DataFrame, tasks: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of one matrix a task, by a tree of tasks that put FAN of them together each, down to one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(1):
                m = np.frombuffer(raw.as_buffer(), np.float32)
                total = m.astype(np.float64) if total is None else total + m
        if total is not None:
            yield _matrix(total)

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.repartitionById(tasks, F.col("slot")).mapInArrow(add, _SUM)
    got = parts.collect()
    return sum((np.frombuffer(r["m"], np.float32).astype(np.float64) for r in got), np.zeros(shape[0] * shape[1])).reshape(shape)


def _matrix(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["slot", "m"])


def latent_space(segments: DataFrame, tasks: int, shards: list[Items], idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of all TF-IDF passages: one pass of the corpus.

    With a random test matrix X and Y = A'A X, the Nystrom form Y (X'Y)^-1 Y' has the leading eigenvectors of A'A. Partial
    products are summed in tasks, then in a tree of tasks.
    """
    n = len(idf)
    columns = min(n, rank + EXTRA)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, columns)))[0]
    full = np.append(idf, 0).astype(np.float32)
    weighted = np.concatenate([x * idf[:, None], np.zeros((1, columns))]).astype(np.float32)
    shared = segments.sparkSession.sparkContext.broadcast((full, weighted))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, weighted = shared.value
        total = np.zeros(weighted.shape, np.float64)
        for blocks, first, _, _ in _chunks(batches, len(full) - 1):
            _times_gram(blocks, first, weighted, full, total)
        yield _matrix(total)

    y = _summed(segments.mapInArrow(part, _SUM), tasks, weighted.shape)
    for items in shards:
        if len(items.passage_at):
            _times_gram(*_item_blocks(items, n), weighted, full, y)
    y = y[:-1] + (shift := np.finfo(np.float32).eps * np.linalg.norm(y)) * x
    values, turn = np.linalg.eigh(x.T @ y / 2 + y.T @ x / 2)
    fit = y @ (turn / np.sqrt(np.maximum(values, shift)))
    return np.linalg.svd(fit, full_matrices=False)[0][:, : min(rank, n)]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.float32(1e-12))


def common_subsequences(want: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the longest common subsequences of the rows, bits of the words of `want` that are in `have`), by bit-parallel steps over all rows at once."""
    n = want.shape[1]
    bits = np.zeros(have.shape, np.uint64)
    for i in range(n):
        bits |= (have == want[:, i : i + 1]).astype(np.uint64) << np.uint64(i)
    full = np.uint64((1 << n) - 1)
    v = np.full(len(want), full)
    for j in range(have.shape[1]):
        u = v & bits[:, j]
        v = ((v + u) | (v - u)) & full
    return n - np.bitwise_count(v).astype(np.int32), np.bitwise_or.reduce(bits, axis=1)


_FOUND = "doc_id long, item_id long, kind string, cosine float, lcs int"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("cosine", pa.float32()), ("lcs", pa.int32())])


def _verbatim(items: Items, words: np.ndarray, gram: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether the passages at these places of `words` have RUN words of these items in a row."""
    found = np.zeros(len(at), bool)
    salt, last = C.mix(item.astype(np.uint64) + np.uint64(0x51ED2701)), np.uint64(len(items.gram_there) - 1)
    for j in range(SPAN - RUN + 1):
        key = C.mix(gram[at + j] ^ salt)
        maybe = np.flatnonzero(items.gram_there[key & last])
        k = np.minimum(np.searchsorted(items.gram_keys, key[maybe]), len(items.gram_keys) - 1)
        same = items.gram_keys[k] == key[maybe]
        hit, k = maybe[same], k[same]
        if len(hit):  # equal keys: the words themselves decide
            own = words[(at[hit] + j)[:, None] + np.arange(RUN)]
            found[hit] |= (own == items.words[items.gram_at[k][:, None] + np.arange(RUN)]).all(axis=1)
    return found


def _paraphrased(items: Items, words: np.ndarray, at: np.ndarray, q: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which passages are paraphrases of these item passages, their common subsequences)."""
    want = items.words[items.passage_at[q][:, None] + np.arange(RUN)]
    have = words[at[:, None] + np.arange(SPAN)]
    lcs, there = common_subsequences(want, np.where(have == len(digit) - 1, -1, have))
    answers = (digit[want].astype(np.uint64) << np.arange(RUN, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    good = np.flatnonzero((lcs >= LEAST_WORDS) & ((answers & ~there) == 0))
    return good, lcs[good]


def _hits(docs: np.ndarray, items: np.ndarray, kind: str, near: np.ndarray, lcs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(items), pa.array([kind] * len(docs), pa.string()), pa.array(near.astype(np.float32)), pa.array(lcs, pa.int32())], schema=_FOUND_ARROW)


def _retrieve(vocabulary, space, shards: list, paraphrases: bool):
    """Item passages near a document's in the latent space, and what the sequence checks say of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, vectors = space.value
        digit = np.append(vocabulary.value.digit, False)
        weighted = np.concatenate([vectors * idf[:, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)  # the last: a word no item has
        wanted = [(s.value, _unit(_passage_sums(weighted, *_item_blocks(s.value, len(idf)))), s.value.heads()) for s in shards]
        for blocks, first, seg, docs in _chunks(batches, len(idf)):
            words = np.concatenate([blocks.ravel(), np.full(SPAN, len(idf), np.int32)])
            gram = _grams(words)
            passages = _unit(_passage_sums(weighted, blocks, first))
            for items, vectors_of, heads in wanted:
                for a in range(0, len(first), _SCORED):
                    score = vectors_of @ passages[a : a + _SCORED].T
                    q, p = np.divmod(np.flatnonzero(score.ravel() >= NEAR), score.shape[1])
                    if not len(q):
                        continue
                    there = np.zeros((len(items.ids), score.shape[1]), bool)
                    there[items.passage_item[q], p] = True
                    item, where = np.nonzero(there)
                    exact = np.flatnonzero(_verbatim(items, words, gram, first[where + a] * BLOCK, item))
                    if len(exact):
                        item, where = item[exact], where[exact]
                        near = np.array([score[f:z, x].max() for f, z, x in zip(heads[item].tolist(), heads[item + 1].tolist(), where.tolist())])
                        yield _hits(docs[seg[where + a]], items.ids[item], "verbatim", near, np.full(len(exact), RUN))
                    if paraphrases:
                        close = score[q, p] >= PARAPHRASE
                        p, q = p[close], q[close]
                        for z in range(0, len(p), 50_000):
                            pz, qz = p[z : z + 50_000], q[z : z + 50_000]
                            good, lcs = _paraphrased(items, words, first[pz + a] * BLOCK, qz, digit)
                            if len(good):
                                yield _hits(docs[seg[pz[good] + a]], items.ids[items.passage_item[qz[good]]], "paraphrase", score[qz[good], pz[good]], lcs)

    return run


def leaks(docs: DataFrame, doc_id: str, text: str, evals: DataFrame, item_id: str, item_text: str, paraphrases: bool = True) -> DataFrame:
    """(doc_id, item_id, kind, cosine, lcs): one row for each document and item that leaked into it.

    Candidates are passages whose cosine with an item's passage is at least NEAR in the latent space. kind is 'verbatim' if
    the document has RUN words of the item in a row, else 'paraphrase' if a passage as near as PARAPHRASE shares a subsequence of LEAST_WORDS of an
    item passage's RUN words and has its answers: all words with digits. cosine and lcs are those of the best passage. Words
    are compared without case, accents and disguises, as 64-bit hashes of the words. Null or wordless texts, and items
    shorter than RUN words, match nothing; null ids are left out.

    Documents are read once and never shuffled: what follows works on the stretches of RUN and more words that all occur in
    items, outside which no verbatim run can lie, and for paraphrases besides on all passages with LEAST_WORDS words of items;
    there other words keep their place, have no weight and match nothing. The latent space is fitted to the stretches and the
    items. Items are sought in shards of about SHARD_WORDS words within one pass. Only where items have more than MOST_WORDS
    distinct words are they split into groups, each with a latent space and a pass of its own; the checks that settle a
    candidate do not depend on either.
    """
    spark = docs.sparkSession
    ev = evals.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    ev = cut(ev.mapInArrow(_word_counts, "id long, text string, n long, hashes array<long>"))
    n_words = ev.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct = ev.select(F.explode("hashes").alias("h")).distinct().count()
    groups = 1 if distinct <= MOST_WORDS else -(-n_words // MOST_WORDS)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for g in range(groups):
        mine = ev.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)
        part = _leaks_of_group(rows, mine, max(1, -(-n_words // groups // SHARD_WORDS)), paraphrases)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    best = F.max(F.struct(F.col("kind") == "verbatim", "lcs", "cosine", "kind")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.kind", "b.cosine", "b.lcs")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their words and these words' distinct hashes."""
    for whole in batches:
        for b in C.pieces(whole, 1):
            w = C.words(*C.to_codepoints(b.column(1)))
            each = [np.unique(w.hash[w.row == i]).view(np.int64) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.bincount(w.row, minlength=b.num_rows), pa.int64()), pa.array([e.tolist() for e in each], pa.list_(pa.int64()))], ["id", "text", "n", "hashes"])


def _leaks_of_group(rows: DataFrame, ev: DataFrame, shards: int, paraphrases: bool) -> DataFrame | None:
    sc = rows.sparkSession.sparkContext
    known: list[Vocabulary] = []
    texts = lambda s: ev.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)) == s).select("id", "text").orderBy("id").collect()
    for s in range(shards):
        known.append(vocabulary_of([r["text"] for r in texts(s)]))
    hashes, first = np.unique(np.concatenate([k.hashes for k in known]), return_index=True)
    vocabulary = Vocabulary(hashes, np.concatenate([k.digit for k in known])[first])
    items = []
    for s in range(shards):
        got = texts(s)
        made = items_of([r["id"] for r in got], [r["text"] for r in got], vocabulary)
        if len(made.passage_at):
            items.append(made)
    if not items:
        return None
    words = sc.broadcast(vocabulary)
    kept = cut(rows.mapInArrow(_segments(words, paraphrases), _KEPT))
    tasks = kept.where("docs IS NOT NULL").agg(F.count(F.lit(1)).alias("tasks"), F.sum("docs").alias("docs")).first()
    counts = kept.where("docs IS NOT NULL").select(F.explode(F.arrays_zip("seen", "df")).alias("c")).groupBy("c.seen").agg(F.sum("c.df").alias("n")).collect()
    df = np.zeros(len(vocabulary))
    for r in counts:
        df[r["seen"]] = r["n"]
    idf = np.log((1 + (tasks["docs"] or 0)) / (1 + df)) + 1
    segments = kept.where("docs IS NULL").select("doc_id", "words", "mixed")
    space = sc.broadcast((idf, latent_space(segments.where("NOT mixed"), tasks["tasks"], items, idf)))
    return segments.mapInArrow(_retrieve(words, space, [sc.broadcast(i) for i in items], paraphrases), _FOUND)
