"""Personal information inside free text: bootstrapped contextual extraction.

Every text gives candidates by shape (numbers, e-mail addresses, house addresses, names) with the words around
them. Some candidates are seeds, some counter-seeds, by nothing but their own form and the names of known people: a
number that is written like a telephone number, one that can't be one, a name that is built like known people's, a
capitalised phrase that comes far more often than a name built like theirs would. Seeds induce lexical patterns; Spark scores
the graph of patterns and candidates round by round, each confident round labelling more candidates; and what lies in
patterns of high confidence is found although nothing in it tells. No list of cue words takes part: that 'SĐT' announces a
telephone number and 'chi nhánh' no person is learned. Found occurrences are replaced by typed placeholders.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.llm import codepoints as C
from tamarind.plans.shared import keep_table
from tamarind.plans.skew import skew_join

#: Word places of known names that the driver and every task may hold: a word counts if it has one in so many of them.
MOST_NAME_WORDS = 200_000
#: A word of a known name counts from so many names on.
LEAST_NAMES = 2
#: A phrase is too frequent for a name if it has this share of the candidates (of those with, or without, words of known
#: names), and, where known names tell how often it may come, so many times that. At most 2 / TOO_OFTEN phrases can be.
TOO_OFTEN, TIMES = 1 / 1000, 10.0
LEAST_OFTEN = 5
ROUNDS, TRUST = 4, 0.3
#: What a context's score starts from, and with what weight: little evidence leaves it there.
PRIOR, PRIOR_WEIGHT = 0.4, 1.0
#: A candidate without a label of its own is taken from this score on; a seed is dropped below LEAST_SEED.
LEAST, LEAST_SEED = 0.7, 0.25

# Titles, which are no part of a name, in folded form and as they are spelt.
TITLES = frozenset("ong ba anh chi em co chu bac cau di ngai mr ms mrs miss dr".split())
_TITLE_FORMS = frozenset("ông bà anh chị em cô chú bác cậu dì ngài mr ms mrs miss dr".split())
ABBREVIATED = frozenset("mr ms mrs dr ths ts".split())
STREET_CUES = r"(?:[Dd]uong|DUONG|[Pp]ho|PHO|[Nn]go|NGO|[Nn]gach|[Hh]em|[Kk]iet|[Dd]\.|[Dd]ai lo|[Qq]uoc lo)"
UNIT = r"(?:[Pp]huong|[Qq]uan|[Tt]hanh pho|[Hh]uyen|[Tt]inh|[Xx]a|[Tt]hi xa|[Tt]hi tran|TP|[PFQTHX]|[Ww]ard|[Dd]istrict|[Cc]ity of)"

_CAP = r"[A-Z][A-Za-z'’]*"
_CAPS = rf"{_CAP}(?: {_CAP}){{0,4}}(?:(?:(?<=St)|(?<=Rd)|(?<=Ln)|(?<=Dr)|(?<=Ct)|(?<=Ave))\.(?=,))?"
_ALLEY_WORDS = r"(?:[Nn]go|NGO|[Nn]gach|NGACH|[Hh]em|HEM|[Kk]iet|KIET)"
_ALLEY = rf"(?:,? ?{_ALLEY_WORDS} \d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})*,?)"
ADDRESS = re.compile(rf"(?<![\w./,:\-#])(?P<no>\d{{1,4}}[A-Za-z]?(?:/\d{{1,4}}[A-Za-z]?){{0,4}})(?P<cue>{_ALLEY}*,? +(?:{STREET_CUES} *)?)(?P<street>{_CAPS})(?P<tail>(?:, ?(?:(?:{UNIT})\b\.? ?)?(?:{_CAPS}|\d{{1,3}}\b))*)")
ENGLISH_STREET = re.compile(r"\b(?:Street|Road|Lane|Avenue|Drive|Court|Square|St|Rd|Ln|Ave|Dr|Ct|Sq)\b")
TAIL_UNIT = re.compile(rf", ?{UNIT}\b\.? ?")
NUMBER = re.compile(r"(?<![A-Za-z0-9_@/=])(?<![\w]-)(?<!\d\.)(?:\(\+?\d{1,4}\)[ .\-]?|\+ ?)?\d(?:[ .\-]?\d){6,15}(?![A-Za-z0-9_])(?![ .\-]\d)")
PASSPORT = re.compile(r"(?<![A-Za-z0-9_])[A-Z] ?\d{7,8}(?![A-Za-z0-9_])")
DATE = re.compile(r"(?:19|20)\d\d[-.]\d\d?[-.]\d\d?|\d\d?[-.]\d\d?[-.](?:19|20)\d\d")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._+\-]*"
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
AT_SIGN = re.compile(r"@|[\[({<] ?(?:at|a cong|acong) ?[\])}>]| a ?cong | at +[\w\-]+(?: +dot | ?[\[({<] ?dot)", re.IGNORECASE)
_SPELT_DOT = r"(?: ?[\[({<] ?(?:dot|cham) ?[\])}>] ?| +(?:dot|cham) +)"
EMAIL = re.compile(
    rf"{_LOCAL}(?: ?@ ?{_LABEL}(?:\.{_LABEL})+"
    rf"| ?[\[({{<] ?(?:at|a cong|acong) ?[\])}}>] ?{_LABEL}(?:(?:\.|{_SPELT_DOT}){_LABEL})+"
    rf"| +(?:a cong|acong) +{_LABEL}(?:(?:\.|{_SPELT_DOT}){_LABEL})+"
    rf"| +at +{_LABEL}(?:{_SPELT_DOT}{_LABEL})+)",
    re.IGNORECASE,
)
WORD = re.compile(r"(?<!\w)[A-Za-z]+(?:['’][A-Za-z]+)*(?:-[A-Z][A-Za-z]+)*(?!\w)")
TOKEN = re.compile(r"[A-Za-z]+|\d[\d.,/:]*|[^\w\s]|\n|[-]|\w")
SENTENCE = re.compile(r"(?:(?<![A-Z])(?<![A-Z]r)(?<![A-Z]s)(?<!Mrs)[.!?]|\|)\s|\n(?:- |\d+[.)] |(?!SDT|DT|Tel|ID|TEL|SD)[A-Za-z]{2,3}: )|\n\s*\n")
ENDS = frozenset(".!?|\n")
OPENING = re.compile(r"^(?:- |> |\d+[.)] |(?!SDT|DT|Tel|ID|TEL|SD)[A-Za-z]{2,3}: )")
BULLET = re.compile(r"(?:^|\n)(?:- |\d+[.)] |(?!SDT|DT|Tel|ID|TEL|SD)[A-Za-z]{2,3}: )$")
MARKS = {"number": "\ue001", "email": "\ue002", "address": "\ue003", "name": "\ue004"}
FAMILY, MIDDLE, GIVEN = 1, 2, 4

CANDIDATES = "doc_id long, start_pos long, end_pos long, family string, grp string, evidence int, c3 string, c2 string, c1 string, r1 string, phrase string, model double"
#: Words of an address before which a number is no house number: '12' in 'ngõ 12'.
_INNER = re.compile(rf"(?:{STREET_CUES}|{_ALLEY_WORDS}|{UNIT}) ?$")
#: Signs between a passport number and the name of its holder.
_NEAR_NAME = 24


def name_words(people: DataFrame, name: str) -> DataFrame:
    """(word, role, n): the words of known people's names in lower case, by their place in the name; a single word is a given name."""
    w = people.select(F.filter(F.split(F.lower(F.trim(F.col(name))), r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    at = w.select(F.posexplode("w").alias("i", "word"), F.size("w").alias("n"))
    role = F.when(F.col("i") == F.col("n") - 1, GIVEN).when(F.col("i") == 0, FAMILY).otherwise(MIDDLE)
    return at.select("word", role.alias("role")).groupBy("word", "role").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Lexicon:
    """The words of known names: roles by accented and by folded word, and the share a folded word has in its role."""

    accented: dict[str, int]
    folded: dict[str, int]
    share: dict[tuple[str, int], float]

    def model(self, words: list[str]) -> float:
        """How often a name of these folded words comes among names of so many words, by known people's, in either order; 0 if a word is unknown in its place."""
        roles = [GIVEN] if len(words) == 1 else [FAMILY, *[MIDDLE] * (len(words) - 2), GIVEN]
        return max(math.prod(self.share.get((w, r), 0.0) for w, r in zip(words, order)) for order in (roles, roles[::-1]))


def lexicon(words: DataFrame, least: int = LEAST_NAMES) -> Lexicon:
    """The words that at least `least` known names have, and one in MOST_NAME_WORDS of all word places: so there are no more than that."""
    each = words.groupBy("word", "role").agg(F.sum("n").alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = each.where(F.col("n") >= max(least, -(-total // MOST_NAME_WORDS))).collect()
    out, all_of, of = Lexicon({}, {}, {}), Counter(), Counter()
    for r in rows:
        w = unicodedata.normalize("NFC", r["word"])
        plain = _fold(w)
        out.folded[plain] = out.folded.get(plain, 0) | r["role"]
        if plain != w:
            out.accented[w] = out.accented.get(w, 0) | r["role"]
        all_of[r["role"]] += r["n"]
        of[plain, r["role"]] += r["n"]
    out.share = {k: n / all_of[k[1]] for k, n in of.items()}
    return out


@lru_cache(100_000)
def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower().replace("đ", "d")) if not unicodedata.combining(c))


def _left(text: str, start: int, before: tuple[int, str] | None, block: bool) -> list[str]:
    """Up to three tokens before a place, inside its sentence; a candidate there is one token. In a block a line goes on from a candidate that ends the line before, as numbers do under a name."""
    low = max(0, start - 48)
    head = ""
    if before and before[0] >= low:
        head, low = before[1], before[0]
    gap = text[low:start]
    if low == 0 and not head:
        head, gap = "^ ", OPENING.sub("", gap)
    cut = None
    if ENDS & set(gap):
        for m in SENTENCE.finditer(gap):
            cut = m
    line = gap.rfind("\n")
    # A line begins a sentence, unless the line before ends with a comma (a salutation) or is a candidate itself.
    if line >= 0 and not (cut and cut.end() > line) and not gap[:line].endswith(",") and not (block and head and gap == "\n"):
        head, gap = "^ ", gap[line + 1 :]
    elif cut:
        head, gap = "^ ", gap[cut.end() :]
    elif BULLET.search(gap):
        head, gap = "^ ", ""
    elif not head and low == 0:
        head = "^ "
    tokens = TOKEN.findall((head + gap).lower())[-3:]
    tokens = ["#" if t[0].isdigit() else t for t in tokens]
    return [""] * (3 - len(tokens)) + tokens


def _right(text: str, end: int, after: tuple[int, str] | None) -> str:
    if after and after[0] - end <= 1:
        return after[1]
    m = TOKEN.search(text, end, end + 25)
    if not m:
        return "$"
    t = m.group().lower()
    return "#" if t[0].isdigit() else "$" if t in ".|\n" else t


def _number(raw: str) -> tuple[str, int] | None:
    """(group, evidence) of a number by its own form: 1 it is one of its group's kind, -1 it is not, 0 it may be."""
    if DATE.match(raw):
        return None
    d = "".join(c for c in raw if c.isdigit())
    separated = any(c in " .-()" for c in raw.strip())
    if re.fullmatch(r"1[89]00(?:\d{4}|\d{6})", d):
        return ("d10", -1)
    if raw[0] == "+" or raw.startswith("(+") or d.startswith("0084"):
        national = d[4:] if d.startswith("0084") else d[2:] if d.startswith("84") else d
        return ("d10", 1) if 8 <= len(national.lstrip("0")) <= 10 else ("other", -1)
    if raw[0] == "(":
        return ("d10", 1) if len(d) in (10, 11) and d[0] == "0" else ("other", -1)
    if len(d) == 10:
        return ("d10", (1 if separated else 0) if d[0] == "0" else -1)
    if len(d) == 11:
        return ("d10", 0) if d.startswith("84") or d[0] == "0" else ("other", -1)
    if len(d) == 12:
        return ("d12", (1 if separated else 0) if d[0] == "0" else -1)
    if len(d) == 9:  # old identity numbers begin with the number of a province
        return ("d9", (1 if d[0] in "0123" else 0) if not separated else 0)
    return ("other", -1)


def _title(text: str, at: int, original) -> bool:
    """Whether a title stands right before a place: 'anh ', 'Ms. '."""
    end = at - 1
    if end < 1 or text[end] not in " .":
        return False
    dotted = text[end] == " " and text[end - 1] == "."
    if dotted:
        end -= 1
    start = end
    while start > 0 and end - start <= 5 and text[start - 1].isalpha():
        start -= 1
    return text[start:end].lower() in (ABBREVIATED if dotted else TITLES) and (start == 0 or not text[start - 1].isalnum()) and original(start, end) in _TITLE_FORMS | TITLES


def _names(text: str, original, accented: dict[str, int], folded: dict[str, int], starts: re.Pattern, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, evidence) of name-like stretches: known name words, words after a title, runs of capitalised words.

    Only capitalised words and known family names are looked at as starts, so ordinary words cost nothing.
    """

    def read(a: int, b: int) -> tuple[int, int, str, str, int]:
        w = text[a:b]
        low = w.lower()
        roles = folded.get(low, 0)
        if roles:
            own = original(a, b)
            if own != low and _fold(own) == low:
                roles = accented.get(own, 0)
        return a, b, low, "U" if len(w) > 1 and w.isupper() else "C" if w[0].isupper() else "l", roles

    def after(b: int) -> tuple[int, int, str, str, int] | None:
        if text[b : b + 1] != " ":
            return None
        m = WORD.match(text, b + 1)
        return read(*m.span()) if m else None

    def is_title(w: tuple) -> bool:
        return w[2] in TITLES and original(w[0], w[1]) in _TITLE_FORMS | TITLES

    out, done, blocked = [], 0, 0
    for m in starts.finditer(text):
        if m.start() < done:
            continue
        while blocked < len(taken) and taken[blocked][1] <= m.start():
            blocked += 1
        if blocked < len(taken) and taken[blocked][0] < m.end():
            continue
        a, b = m.span()
        capital_next = text[b : b + 1] == " " and text[b + 1 : b + 2].isupper()
        if not capital_next and text[b : b + 2] != ", " and not folded.get(m.group().lower(), 0) & FAMILY and not _title(text, a, original):
            continue  # a capitalised word by itself
        first = read(a, b)
        low, style, roles = first[2:]
        # A full name of known words: family name first, given name last, one style.
        if roles & FAMILY:
            run = [first]
            while len(run) < 5 and (w := after(run[-1][1])) and w[4] and (w[3] == style or (len(w[2]) == 1 and style != "l" and w[3] != "l")):
                run.append(w)
            while len(run) > 1 and not run[-1][4] & GIVEN:
                run.pop()
            if len(run) > 2 or (len(run) == 2 and style != "l"):
                done = run[-1][1]
                out.append((a, done, 1 if len(run) > 2 or style == "C" else 0))
                continue
        if style == "l" or is_title(first):
            continue
        titled = _title(text, a, original)
        run = [first]
        while len(run) < 4 and text[run[-1][1] + 1 : run[-1][1] + 2].isupper() and (w := after(run[-1][1])) and w[3] == style and not is_title(w):
            if w[4] & FAMILY and (x := after(w[1])) and x[4]:  # a full name begins there
                break
            run.append(w)
        done = run[-1][1]
        if len(run) == 1 and style == "C" and text[b : b + 2] == ", ":  # 'Last, First', if the second is one word
            second = WORD.match(text, b + 2)
            if second and (w := read(*second.span()))[3] == "C" and not ((x := after(w[1])) and x[3] != "l"):
                done = w[1]
                out.append((a, done, 0))
                continue
        if titled and (len(run) > 1 or roles & GIVEN):
            out.append((a, done, 1 if roles else 0))
        elif titled and style == "C":
            out.append((a, b, 0))
        elif len(run) in (2, 3):
            turned = len(run) == 2 and style == "C" and roles & GIVEN and run[1][4] & FAMILY  # given name first
            out.append((a, done, 1 if turned else 0))
    return out


def name_starts(folded: dict[str, int]) -> re.Pattern:
    """Words a name may begin with: capitalised ones, and known family names in lower case."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted((w for w, r in folded.items() if r & FAMILY and w.isascii() and w.isalpha()), key=len, reverse=True):
        by_letter.setdefault(w[0], []).append(w[1:])
    family = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))
    word = r"[A-Z][A-Za-z]*(?:['’][A-Za-z]+)*(?:-[A-Z][A-Za-z]+)*"
    return re.compile(rf"(?<!\w)(?:{word}{'|' + family if family else ''})(?!\w)")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses, sought around the sign (or the words) that makes one."""
    done = 0
    for m in AT_SIGN.finditer(text):
        end = m.start()
        while end > done and text[end - 1] == " ":
            end -= 1
        start = end
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        while start < end and not text[start].isalnum():
            start += 1
        if start < end and (e := EMAIL.match(text, start)):
            done = e.end()
            yield e.span()


def _scan_text(text: str, original, names: Lexicon, starts: re.Pattern) -> list[tuple]:
    """(start, end, family, group, evidence, c3, c2, c1, r1, phrase, model) of all candidates of one folded text."""
    spans: list[tuple[int, int, str, str, int]] = []
    spans += [(a, b, "email", "email", 1) for a, b in _emails(text)]
    for m in ADDRESS.finditer(text):
        end = m.end()
        while text[end - 1] in ".,":
            end -= 1
        sure = "/" in m["no"] or m["no"][-1].isalpha() or m["cue"].strip(" ,") or ENGLISH_STREET.search(m["street"]) or (m["tail"] and TAIL_UNIT.search(m["tail"]))
        inner = _INNER.search(text, max(0, m.start() - 12), m.start())
        spans.append((m.start(), end, "address", "address", -1 if inner else 1 if sure else 0))
    for m in NUMBER.finditer(text):
        if kind := _number(m.group()):
            spans.append((*m.span(), "number", *kind))
    for m in PASSPORT.finditer(text):
        spans.append((*m.span(), "number", "pp", 0))
    spans.sort(key=lambda s: (s[0], -s[1]))
    clear: list[tuple[int, int, str, str, int]] = []
    for s in spans:
        if not clear or s[0] >= clear[-1][1]:
            clear.append(s)
    taken = [(s[0], s[1]) for s in clear if s[2] != "number"]
    clear += [(a, b, "name", "name", e) for a, b, e in _names(text, original, names.accented, names.folded, starts, taken)]
    clear.sort()
    out = []
    for k, (a, b, family, group, evidence) in enumerate(clear):
        if family == "email":  # its form is enough
            out.append((a, b, family, group, evidence, "", "", "", "", None, 0.0))
            continue
        before = (clear[k - 1][1], MARKS[clear[k - 1][2]]) if k and clear[k - 1][1] <= a else None
        after = (clear[k + 1][0], MARKS[clear[k + 1][2]]) if k + 1 < len(clear) else None
        phrase, model = None, 0.0
        if family == "name":
            words = text[a:b].lower().split()
            phrase, model = " ".join(words), names.model(words)
        elif group == "pp" and k + 1 < len(clear) and clear[k + 1][2] == "name":
            # A passport number is a seed if a name follows soon in its sentence.
            gap = text[b : clear[k + 1][0]]
            evidence = 1 if len(gap) <= _NEAR_NAME and not ENDS & set(gap) else 0
        out.append((a, b, family, group, evidence, *_left(text, a, before, family != "name"), _right(text, b, after), phrase, model))
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("family", pa.string()), ("grp", pa.string()), ("evidence", pa.int32()), ("c3", pa.string()), ("c2", pa.string()), ("c1", pa.string()), ("r1", pa.string()), ("phrase", pa.string()), ("model", pa.float64())])


def candidates(df: DataFrame, doc_id: str, text: str, names: Lexicon) -> DataFrame:
    """All candidates with their places in the stored text (code points, from 1, end exclusive) and their contexts."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        starts = name_starts(names.folded)
        for whole in batches:
            for b in C.pieces(whole, 1):
                docs, stored = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = []
                for doc, own, (shape, place) in zip(docs, stored, C.shapes(*C.to_codepoints(b.column(1)))):
                    if doc is None or not shape:
                        continue
                    if place is None:
                        original = lambda x, y, own=own: own[x:y].lower()
                    else:
                        original = lambda x, y, own=own, place=place: unicodedata.normalize("NFC", own[place[x] : (place[y] if y < len(place) else len(own))]).strip().lower()
                    for x, y, *rest in _scan_text(shape, original, names, starts):
                        if place is None:
                            rows.append((doc, x + 1, y + 1, *rest))
                        else:
                            rows.append((doc, int(place[x]) + 1, (int(place[y]) if y < len(place) else len(own)) + 1, *rest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return df.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, CANDIDATES)


#: Patterns of a context: (parts, weight, doubt). Longer ones say more. The doubt is what an unlabelled candidate weighs
#: against its pattern, so that general patterns with few seeds among many unknowns earn little.
PATTERNS = (
    (("c3", "c2", "c1", "r1"), 4.0, 0.05),
    (("c3", "c2", "c1"), 3.0, 0.05),
    (("c2", "c1", "r1"), 3.0, 0.05),
    (("c2", "c1"), 2.0, 0.1),
    (("c1", "r1"), 1.5, 0.3),
    (("c1",), 0.1, 1.0),
)
#: Groups of numbers that may be personal.
NUMBERS = ("d10", "d12", "d9", "pp")
_CONTEXT = ["grp", "c3", "c2", "c1", "r1"]


def signature() -> Column:
    return F.xxhash64(*_CONTEXT)


def too_often(found: DataFrame) -> DataFrame:
    """(phrase): name candidates that come far more often than a name would: at most 2 / TOO_OFTEN of them.

    Phrases of known names' words may come TIMES as often as these names tell; of others the share alone decides.
    """
    each = found.where("family = 'name'").groupBy("phrase", "model").agg(F.count(F.lit(1)).alias("n"))
    like = (F.col("model") > 0).alias("like")
    each = each.withColumn("like", like)
    total = each.groupBy("like").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    many = (F.col("n") >= LEAST_OFTEN) & (share >= TOO_OFTEN) & (share > TIMES * F.col("model"))
    return each.join(F.broadcast(total), "like").where(many).select("phrase")


def score_contexts(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(sig, score): how likely a candidate in this context is of its group's kind.

    Candidates with one context are one node of the graph; its patterns are the other side. In each round a pattern's
    score is the share of its labelled candidates that are of the kind, candidates labelled by the round before
    counting TRUST if their score is decided, all other unlabelled ones the pattern's doubt against it; a context's score is
    the mean of its patterns' scores, by weight and evidence, and of PRIOR. A number that by its form is none of any kind
    counts against its patterns for all kinds of numbers: what announces account numbers announces no other.
    """
    nodes = found.groupBy(*_CONTEXT).agg(F.count_if(F.col("evidence") == 1).alias("pos"), F.count_if(F.col("evidence") == -1).alias("neg"), F.count_if(F.col("evidence") == 0).alias("unk")).withColumn("sig", signature())
    # At the start of a sentence there is nothing further left, so patterns without the word after say no more than ('c1',).
    at_start = F.col("c2") == ""
    pattern = lambda i, parts, w, d: F.when(F.lit(len(parts) == 1 or "r1" in parts) | ~at_start, F.struct(F.xxhash64(F.lit(i), "grp", *parts).alias("p"), F.lit(w).alias("w"), F.lit(d).alias("d")))
    keys = F.filter(F.array(*[pattern(i, *x) for i, x in enumerate(PATTERNS)]), lambda k: k.isNotNull())
    of = lambda df: df.select("sig", "pos", "neg", "unk", F.explode(keys).alias("e")).select("sig", "pos", "neg", "unk", "e.p", "e.w", "e.d")
    edges = keep_table(of(nodes))
    others = F.array_except(F.array(*map(F.lit, NUMBERS)), F.array("grp"))
    foreign = nodes.where(F.col("grp").isin(*NUMBERS, "other") & (F.col("neg") > 0)).withColumn("grp", F.explode(others)).withColumns({"pos": F.lit(0), "unk": F.lit(0)})
    against = keep_table(of(foreign).groupBy("p").agg(F.sum("neg").alias("neg")))
    scores = None
    for _ in range(rounds):
        if scores is None:
            labelled = edges.withColumn("hit", F.col("pos").cast("double")).withColumn("all", F.col("pos") + F.col("neg") + F.col("unk") * F.col("d"))
        else:
            decided = F.when((F.col("score") >= 0.8) | (F.col("score") <= 0.2), F.col("unk") * TRUST).otherwise(F.col("unk") * F.col("d"))
            gain = F.when(F.col("score") >= 0.8, F.col("unk") * TRUST * F.col("score")).otherwise(F.lit(0.0))
            joined = edges.join(scores, "sig", "left")
            labelled = joined.withColumn("all", F.col("pos") + F.col("neg") + decided).withColumn("hit", F.col("pos") + gain).drop("score")
        every = labelled.select("p", "hit", "all").unionByName(against.select("p", F.lit(0.0).alias("hit"), F.col("neg").cast("double").alias("all")))
        patterns = every.groupBy("p").agg(F.sum("hit").alias("hit"), F.sum("all").alias("all")).where(F.col("all") > 0)
        patterns = patterns.select("p", ((F.col("hit") + 0.05) / (F.col("all") + 0.1)).alias("ps"), F.log1p("all").alias("pw"))
        by = skew_join(edges, patterns, ["p"]).where(F.col("ps").isNotNull())
        scores = keep_table(by.groupBy("sig").agg(((F.sum(F.col("w") * F.col("pw") * F.col("ps")) + PRIOR * PRIOR_WEIGHT) / (F.sum(F.col("w") * F.col("pw")) + PRIOR_WEIGHT)).alias("score")))
    return scores


def kind_of() -> Column:
    group = F.col("grp")
    return F.when(group == "d10", "phone").when(group.isin("d12", "d9", "pp"), "id_number").otherwise(group)


def occurrences(df: DataFrame, doc_id: str, text: str, names: Lexicon) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos): what is personal, in code points of the stored text from 1, end exclusive.

    Null and empty texts, and null ids, give nothing. Copies of a text give the same places for each id. Whole
    texts are read, of any length. Candidates are kept as a table in the shared folder, since patterns and
    result both read them. A seed stays unless its context speaks against it; all others, phrases that are too frequent
    for names among them, need a context of high confidence.
    """
    found = keep_table(candidates(df, doc_id, text, names))
    often = F.broadcast(keep_table(too_often(found)).withColumn("often", F.lit(True)))
    found = found.join(often, "phrase", "left").withColumn("evidence", F.when(F.col("often"), -1).otherwise(F.col("evidence")))
    scored = skew_join(found.where("evidence >= 0 OR often").withColumn("sig", signature()), score_contexts(found), ["sig"])
    sure = (F.col("evidence") == 1) & (F.coalesce("score", F.lit(1.0)) >= LEAST_SEED)
    unseen = (F.col("evidence") < 1) & (F.col("score") >= LEAST)
    kept = scored.where((F.col("family") == "email") | sure | unseen)
    return kept.select("doc_id", kind_of().alias("kind"), "start_pos", "end_pos").distinct()


def masked(df: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """(doc_id, text): each occurrence replaced by its placeholder, such as [EMAIL]; the rest stays as it is.

    Documents without occurrences come out unchanged, null texts null. Expects doc_id to be unique.
    """
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.pieces(whole, 1):
                out = []
                for t, ss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if t is not None and ss:
                        parts, at = [], 0
                        for s in ss:
                            if s["start_pos"] - 1 >= at:
                                parts += [t[at : s["start_pos"] - 1], f"[{s['kind'].upper()}]"]
                                at = s["end_pos"] - 1
                        t = "".join([*parts, t[at:]])
                    out.append(t)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def known_names(*tables: tuple[DataFrame, str]) -> Lexicon:
    """The lexicon of several tables of people: (table, name column) each."""
    return lexicon(reduce(DataFrame.unionByName, [name_words(t, c) for t, c in tables]))
