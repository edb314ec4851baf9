"""Questions as tokens, and what can be read at a token: phrases, days, amounts, identifiers, names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d]\w*|<=|>=|->|[^\w\s]")
# Units of amounts and what they multiply by.
MONEY_UNITS = {"tỷ": 10**9, "tỉ": 10**9, "triệu": 10**6, "tr": 10**6, "nghìn": 10**3, "ngàn": 10**3, "k": 10**3, "đồng": 1, "đ": 1, "vnd": 1}


@dataclass(frozen=True)
class Token:
    text: str
    low: str
    start: int
    end: int


class Question:
    """A text by tokens. Reading methods take a place and give (value, place after it), or None."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [Token(m.group(), m.group().lower(), *m.span()) for m in TOKEN.finditer(text)]

    def __len__(self) -> int:
        return len(self.tokens)

    def low(self, i: int) -> str:
        return self.tokens[i].low if 0 <= i < len(self.tokens) else ""

    def glued(self, i: int) -> bool:
        """Whether token i touches the one before."""
        return 0 < i < len(self.tokens) and self.tokens[i].start == self.tokens[i - 1].end

    def skip(self, i: int, *words: str) -> int:
        """The place after token i if it is one of these words, else i."""
        return i + 1 if self.low(i) in words else i

    def number(self, i: int, least: int = 1, most: int = 99) -> tuple[int, int] | None:
        t = self.low(i)
        return (int(t), i + 1) if t.isdigit() and least <= len(t) <= most else None

    def amount(self, i: int) -> tuple[str, int] | None:
        """A number with a unit of money: '1,5 triệu', '20tr'."""
        t, unit = self.low(i), self.low(i + 1)
        if not t[:1].isdigit() or unit not in MONEY_UNITS or self.low(i - 1) in (".", ",") and self.glued(i):
            return None
        return amount_of(t, unit), i + 2

    def day(self, i: int, year: int, bare: bool = False) -> tuple[date, int] | None:
        """2025-03-01, 1/3/2025, 1-3-2025, 1.3.2025, 'ngày 1 tháng 3 [năm 2025]'; with `bare` also 1/3 and '1 tháng 3'."""
        at = self.skip(i, "ngày")
        if self.low(at).count(".") == 2:
            d, m, y = self.low(at).split(".")
            return _real(y, m, d, at + 1)
        first = self.low(at)
        if not first.isdigit():
            return None
        sign = self.low(at + 1)
        if sign in ("-", "/") and self.low(at + 2).isdigit():
            second, third = self.low(at + 2), self.low(at + 4) if self.low(at + 3) == sign else ""
            if len(first) == 4 and sign == "-" and third.isdigit():
                return _real(first, second, third, at + 5)
            if len(third) == 4 and third.isdigit():
                return _real(third, second, first, at + 5)
            if bare and len(first) <= 2:
                y = self.after(at + 3, "năm")
                return _real(y or str(year), second, first, at + (5 if y else 3))
            return None
        if sign == "tháng" and (bare or at > i) and self.low(at + 2).isdigit():
            z = at + 3
            y = self.after(z, "năm") or self.after(z, "/") or self.after(z, "-")
            return _real(y or str(year), self.low(at + 2), first, z + 2 if y else z)
        return None

    def after(self, i: int, word: str) -> str | None:
        """The year of four digits behind `word` at i."""
        y = self.low(i + 1)
        return y if self.low(i) == word and len(y) == 4 and y.isdigit() else None

    def identifier(self, i: int, least: int = 6, most: int = 30) -> tuple[str, int] | None:
        """A run of ASCII letters and digits without a blank inside that has a digit."""
        if i >= len(self):
            return None
        z = i + 1
        while self.glued(z) and self.tokens[z].text.isalnum():
            z += 1
        raw = self.text[self.tokens[i].start : self.tokens[z - 1].end]
        return (raw, z) if raw.isascii() and raw.isalnum() and any(c.isdigit() for c in raw) and least <= len(raw) <= most else None

    def account(self, i: int) -> tuple[str, int] | None:
        t = self.low(i)
        return (t, i + 1) if t.isdigit() and 6 <= len(t) <= 16 else None

    def name(self, i: int, families: frozenset[str] = frozenset(), most: int = 5) -> tuple[str, int] | None:
        """A person: two to five words with a capital, or behind a known family name also without."""
        if i >= len(self) or not self.tokens[i].text.isalpha():
            return None
        known = self.low(i) in families
        if families and not known or not (known or self.tokens[i].text[0].isupper()):
            return None
        styled, z = self.tokens[i].text[0].isupper(), i + 1
        while z < len(self) and z - i < most and self.tokens[z].text.isalpha() and self.low(z) not in CLOSED and (self.tokens[z].text[0].isupper() or not styled):
            z += 1
        return (self.text[self.tokens[i].start : self.tokens[z - 1].end], z) if z - i > 1 else None

    def words(self, i: int, most: int, capital: bool = False) -> tuple[str, int] | None:
        """Up to `most` words, as far as the next sign, number or closed-class word."""
        z = i
        while z < len(self) and z - i < most and self.tokens[z].text[0].isalpha() and self.low(z) not in CLOSED and (not capital or self.tokens[z].text[0].isupper()):
            z += 1
        return (self.text[self.tokens[i].start : self.tokens[z - 1].end], z) if z > i else None


#: Closed-class words: where one stands, a free name has ended.
CLOSED = frozenset("và của có là trong ngoài với về theo để từ đến tới ở tại cho đang đã sẽ được bị vào lúc qua này nào ngày tháng năm hôm tuần quý không những các mà thì".split())


def _real(y: str, m: str, d: str, z: int) -> tuple[date, int] | None:
    try:
        return date(int(y), int(m), int(d)), z
    except ValueError:
        return None


def amount_of(number: str, unit: str = "đồng") -> str:
    """'1,5' 'triệu' is 1500000: a dot groups thousands, a comma is the decimal sign."""
    plain = number.replace(".", "").replace(",", ".", 1).replace(",", "")
    return str(int(round(float(plain) * MONEY_UNITS.get(unit.lower(), 1))))


class Phrases:
    """Phrases of words with a value each; at any place the longest counts."""

    def __init__(self, values: dict[str, object] | Iterable[str]):
        table = values if isinstance(values, dict) else dict.fromkeys(values)
        self.by_first: dict[str, list[tuple[list[str], object]]] = {}
        for p, v in sorted(table.items(), key=lambda kv: -len(kv[0].split())):
            words = [t.lower() for t in TOKEN.findall(p)]
            self.by_first.setdefault(words[0], []).append((words, v))

    def at(self, q: Question, i: int) -> tuple[object, int] | None:
        for words, v in self.by_first.get(q.low(i), ()):
            if all(q.low(i + k) == w for k, w in enumerate(words)):
                return v, i + len(words)
        return None

    def all(self, q: Question) -> Iterator[tuple[object, int, int]]:
        """(value, first place, place after) of all phrases in a question."""
        for i in range(len(q)):
            if hit := self.at(q, i):
                yield hit[0], i, hit[1]

    def ends(self, q: Question, z: int) -> bool:
        """Whether a phrase ends right before place z."""
        return any(hit[1] == z for i in range(max(0, z - 4), z) if (hit := self.at(q, i)))

    def longest(self, q: Question) -> object | None:
        """The value of the phrase with the most letters; of equals the first."""
        best = max(self.all(q), key=lambda h: sum(len(q.low(k)) for k in range(h[1], h[2])), default=None)
        return best[0] if best else None


def after_cue(q: Question, cues: Phrases, read: Callable[[int], tuple[object, int] | None], fillers: tuple[str, ...] = (":", "là", "số")) -> Iterator[tuple[object, int]]:
    """What `read` finds behind each cue, fillers passed over: (value, place of the cue)."""
    for _, i, z in cues.all(q):
        while q.low(z) in fillers:
            z += 1
        if r := read(z):
            yield r[0], i
