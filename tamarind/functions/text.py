"""Text functions as Column expressions; Python only where Spark has no equal (normal forms, sequence ratio)."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WORD = r"[\p{L}\p{N}_]+"


def _accents() -> tuple[str, str]:
    """Every lower-case Vietnamese letter with an accent, and its base letter, from the Unicode decomposition."""
    found = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and unicodedata.normalize("NFD", c) != c}
    found["đ"] = "d"
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accents()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Lower case, đ to d, accents off, whether they are composed or not. Null stays null."""
    return F.regexp_replace(F.translate(F.lower(_c(x)), ACCENTED, PLAIN), r"\p{M}+", "")


def normal_form(x: Column | str, form: str = "NFC") -> Column:
    """A Unicode normal form: NFC, NFD, NFKC or NFKD. Null stays null."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else v if v.isascii() else unicodedata.normalize(form, v))

    return run(_c(x))


EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"


def clean(x: Column | str) -> Column:
    """Emoji off, white space folded to single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_c(x), EMOJI, ""), r"\s+", " ")))


def normalize_question(x: Column | str) -> Column:
    """A question as it is searched for: trimmed, lower case, closing ?!.,;: off, single blanks, first letter upper."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), r"[?!.,;:]+$", ""), r"\s+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def slug(x: Column | str) -> Column:
    """An intent id: lower case, signs off, blanks to one underscore; accents stay."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{M}\p{N}_\s]", "")), r"\s+", "_")


def file_name(x: Column | str, most: int = 50) -> Column:
    """A name for a file: signs that file systems refuse become underscores, at most `most` characters."""
    return F.substring(F.regexp_replace(F.trim(_c(x)), r"[\\/:*?\"<>|\s]+", "_"), 1, most)


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(f"({WORD})"), 1)


def replace_phrases(x: Column | str, phrases: dict[str, str]) -> Column:
    """Each phrase replaced where it stands as whole words, longest first, as one left-to-right pass per phrase."""
    ordered = sorted(phrases.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return reduce(lambda c, kv: F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_])\Q{kv[0]}\E(?![\p{{L}}\p{{N}}_])", kv[1].replace("\\", "\\\\").replace("$", "\\$")), ordered, _c(x))


def replace_words(x: Column | str, mapping: dict[str, str], least: int = 2) -> Column:
    """Words (split at blanks) of at least `least` letters looked up in `mapping` in lower case; signs at their end stay."""
    if not mapping:
        return _c(x)
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])

    def one(w: Column) -> Column:
        core = F.regexp_extract(w, r"^(.*?)([\p{P}\p{S}]*)$", 1)
        tail = F.regexp_extract(w, r"^(.*?)([\p{P}\p{S}]*)$", 2)
        return F.when(F.length(core) >= least, F.concat(F.coalesce(F.try_element_at(table, F.lower(core)), core), tail)).otherwise(w)

    return F.array_join(F.transform(F.split(_c(x), " "), one), " ")


def staged(x: Column | str, stages: list[tuple[str, object]]) -> tuple[Column, Column]:
    """(text after all stages, names of the stages that changed it). A stage is (name, function of a Column)."""
    now, log = _c(x), F.array().cast("array<string>")
    for name, f in stages:
        after = f(now)
        log = F.concat(log, F.when(after.eqNullSafe(now), F.array().cast("array<string>")).otherwise(F.array(F.lit(name))))
        now = after
    return now, log


def remove_words(tokens: Column, stop: list[str]) -> Column:
    """Tokens without those of a stop list; repeats of the others stay, and so does their order."""
    return F.filter(tokens, lambda w: ~w.isin(list(stop))) if stop else tokens


def ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """Runs of n tokens joined by `sep`; none if there are fewer."""
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), sep))).otherwise(F.array().cast("array<string>"))


def tokenize(x: Column | str, stop: list[str] = [], phrases: dict[str, str] | None = None, stems: dict[str, str] | None = None, grams: tuple[int, ...] = (1, 2, 3), with_plain: bool = True) -> Column:  # noqa: B006
    """Search tokens: words without stop words, their stems, their forms without accents, and word runs; distinct, longer than one letter.

    `phrases` are protected by joining them with underscores first.
    """
    t = F.lower(_c(x))
    if phrases:
        t = replace_phrases(t, phrases)
    base = F.filter(words(t), lambda w: F.length(w) > 0)
    base = remove_words(base, stop) if stop else base
    if stems:
        table = F.create_map(*[F.lit(v) for kv in stems.items() for v in kv])
        base = F.transform(base, lambda w: F.coalesce(F.try_element_at(table, w), w))
    parts = [ngrams(base, n) if n > 1 else base for n in grams]
    if with_plain:
        parts.append(F.transform(base, fold))
    return F.filter(F.array_distinct(F.concat(*parts)), lambda w: F.length(w) > 1)


def parse_examples(x: Column | str) -> Column:
    """Examples of a cell: what stands in double quotes, else its lines without bullets and labels; longer than five characters."""
    t = _c(x)
    quoted = F.regexp_extract_all(t, F.lit(r'"([^"]+)"'), 1)
    lines = F.transform(F.split(t, r"\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•+]+|\d+[.)])\s*|^\s*\p{L}[\p{L} ]{0,20}:\s*$", "")))
    return F.filter(F.transform(F.when(F.size(quoted) > 0, quoted).otherwise(lines), F.trim), lambda s: F.length(s) > 5)


def parse_keywords(x: Column | str) -> Column:
    """Keywords of a cell, cut at commas, bars and line ends: trimmed, lower case, longer than one letter."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[,|\n]"), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) > 1)


def search_text(*parts: Column | str) -> Column:
    """'passage: a | b | c' of the parts that are not blank."""
    return F.concat(F.lit("passage: "), F.concat_ws(" | ", *[F.nullif(F.trim(_c(p)), F.lit("")) for p in parts]))


def question_key(question: Column | str, domain: Column | str | None = None) -> Column:
    """The cache key of a question: 16 hex digits of the SHA-256 of its trimmed lower-case form, after the domain."""
    key = F.substring(F.sha2(F.lower(F.trim(_c(question))), 256), 1, 16)
    return F.concat_ws(":", _c(domain), key) if domain is not None else key


def word_chunks(x: Column | str, size: int = 24) -> Column:
    """The text in stretches of `size` words, for models with short windows."""
    w = F.filter(F.split(F.trim(_c(x)), r"\s+"), lambda s: s != "")
    n = F.ceil(F.size(w) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """How alike two strings are, 0 to 100, by their longest matching blocks (which levenshtein does not give)."""

    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 100 * difflib.SequenceMatcher(None, p.lower().strip(), q.lower().strip()).ratio() for p, q in zip(x, y)])

    return run(_c(a), _c(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def is_match(a: Column | str, b: Column | str) -> Column:
    """Whether one of two names holds the other, case aside."""
    x, y = F.lower(F.trim(_c(a))), F.lower(F.trim(_c(b)))
    return F.contains(x, y) | F.contains(y, x)


def sanitize(x: Column | str) -> Column:
    """Typographic quotes to plain ones, control characters off, as a sheet cell takes them."""
    return F.regexp_replace(F.translate(_c(x), "“”„‘’‚", "\"\"\"'''"), r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]", "")


def with_fallback_json(x: Column | str) -> Column:
    """A cell as JSON text: itself if it parses, else {"raw_text": cell}."""
    t = _c(x)
    return F.when(F.try_parse_json(t).isNotNull(), t).otherwise(F.to_json(F.struct(t.alias("raw_text"))))


def embedded_json(x: Column | str) -> Column:
    """The stretch from the first { to the last } of a text, as a model wraps its answer in prose; null if it does not parse."""
    t = F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(t).isNotNull(), t)


def raw_text(metadata: Column | str) -> Column:
    """The SQL template that a document's metadata holds."""
    return F.get_json_object(_c(metadata), "$.raw_text")
