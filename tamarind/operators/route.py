"""Routing questions to a domain, its tables and an intent: scores in each row, no join.

A router's entries (domains, tables or intents) are few and given; their scores are expressions over the
question, so a batch of any size is routed in one narrow pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarind.functions import text as T

KEYWORD, PATTERN, COMMON = 2.0, 2.5, 0.3
SHORTLIST_GAP, SHORTLIST_RATIO = 0.15, 0.7
TABLE_LEAST = 0.3
ARBITER, AMBIGUOUS_GAP = (0.5, 0.2, 0.3), 0.05


@dataclass
class Entry:
    name: str
    keywords: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)  # whose common words with the question count


def _common(question: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(0)
    return F.size(F.array_intersect(T.words(T.fold(question)), F.array(*[F.lit(w) for w in words])))


def score(question: Column, e: Entry, keyword: float = KEYWORD, pattern: float = PATTERN, common: float = COMMON) -> Column:
    """keyword for each keyword the folded question contains, pattern for each regex it matches, common for each common word."""
    q = T.fold(question)
    total = F.lit(0.0)
    for k in e.keywords:
        total = total + F.when(F.contains(q, F.lit(k)), keyword).otherwise(0.0)
    for p in e.patterns:
        total = total + F.when(q.rlike(p), pattern).otherwise(0.0)
    return total + common * _common(question, e.words)


def intent_score(question: Column, keywords: list[str], examples: list[str], description: str, most_examples: int = 5) -> Column:
    """2 for each keyword contained, 0.5 for each common word with each of the first examples, 0.3 with the description."""
    total = score(question, Entry("", keywords), KEYWORD)
    for e in examples[:most_examples]:
        total = total + 0.5 * _common(question, folded_words(e))
    return total + 0.3 * _common(question, folded_words(description))


def folded_words(text: str) -> list[str]:
    """The distinct folded words of a given text."""
    plain = "".join(T.PLAIN[T.ACCENTED.index(c)] if c in T.ACCENTED else c for c in text.lower())
    return sorted(set(re.findall(r"\w+", plain)))


def ranked(question: Column, entries: list[Entry], **weights: float) -> Column:
    """array<struct<name, score>> of all entries, scores over the greatest (or as they are if all are 0), best first, equals in given order."""
    rows = F.array(*[F.struct(score(question, e, **weights).alias("score"), F.lit(i).alias("i"), F.lit(e.name).alias("name")) for i, e in enumerate(entries)])
    top = F.array_max(F.transform(rows, lambda r: r["score"]))
    base = F.when(top > 0, top).otherwise(F.lit(1.0))
    ordered = F.array_sort(F.transform(rows, lambda r: F.struct((-r["score"] / base).alias("neg"), r["i"].alias("i"), r["name"].alias("name"))))
    return F.transform(ordered, lambda r: F.struct(r["name"].alias("name"), (-r["neg"]).alias("score")))


def refine(ranking: Column, similarity: Column, keyword_share: float = 0.75) -> Column:
    """A ranking with a share of max(cosine, 0) from a map name -> cosine, ordered anew."""
    mixed = F.transform(ranking, lambda r, i: F.struct((-(keyword_share * r["score"] + (1 - keyword_share) * F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(similarity, r["name"]), F.lit(0.0))))).alias("neg"), i.alias("i"), r["name"].alias("name")))
    return F.transform(F.array_sort(mixed), lambda r: F.struct(r["name"].alias("name"), (-r["neg"]).alias("score")))


def shortlist(ranking: Column, gap: float = SHORTLIST_GAP, ratio: float = SHORTLIST_RATIO) -> Column:
    """The first two names if they are close (by gap or ratio), else the first."""
    a, b = F.get(ranking, F.lit(0)), F.get(ranking, F.lit(1))
    close = b.isNotNull() & ((a["score"] - b["score"] < gap) | (F.coalesce(F.try_divide(b["score"], a["score"]), F.lit(0.0)) >= ratio))
    return F.when(close, F.array(a["name"], b["name"])).otherwise(F.array(a["name"]))


def forced(name: str) -> Column:
    """The ranking of a domain that was named by the caller."""
    return F.array(F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("score")))


def at_least(ranking: Column, least: float = TABLE_LEAST) -> Column:
    """Names that score at least `least`, else the first."""
    names = F.transform(F.filter(ranking, lambda r: r["score"] >= least), lambda r: r["name"])
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.get(ranking, F.lit(0))["name"]))


def arbitrate(candidates: Column) -> Column:
    """struct<name, score, ambiguous> out of array<struct<name, domain, table, intent>>; ambiguous if the first two are within 0.05."""
    final = lambda c: ARBITER[0] * c["domain"] + ARBITER[1] * c["table"] + ARBITER[2] * c["intent"]
    order = F.array_sort(F.transform(candidates, lambda c, i: F.struct((-final(c)).alias("neg"), i.alias("i"), c["name"].alias("name"))))
    a, b = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    close = b.isNotNull() & (F.round(b["neg"] - a["neg"], 9) <= AMBIGUOUS_GAP)
    return F.struct(F.when(~close, a["name"]).alias("name"), (-a["neg"]).alias("score"), close.alias("ambiguous"))


def profile_entries(profile: dict[str, dict[str, list[str]]]) -> list[Entry]:
    """Table entries out of a semantic profile {table: {column: suggested keywords}}: names and keywords, folded."""
    words = lambda s: folded_words(s.replace("_", " "))
    return [Entry(t, words=sorted({w for c, ks in cols.items() for s in (c, *ks) for w in words(s)}), keywords=sorted({" ".join(words(k)) for ks in cols.values() for k in ks})) for t, cols in profile.items()]
