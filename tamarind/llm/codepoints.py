"""Arrow text as numpy code points: table gathers, expansions and composition without a call per row.

A batch of texts is one array of code points with row offsets. Every table is built by rule from the
interpreter's Unicode data; only the look-alike letters are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tables cover the planes that hold letters, marks, forms and emoji; code points above are ordinary signs.
LIMIT = 0x20000
#: Code points a step works on at once, so that its arrays stay small beside an executor's memory.
CHUNK_BYTES = 2_000_000

# Letters that look like a letter of the Vietnamese alphabet and are another.
LOOK_ALIKES = {
    # Latin: eth and African d
    "Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ь": "b",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "г": "r", "к": "k", "п": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Ս": "U", "Լ": "L",
}
#: Of these, the ones that look Latin only beside Latin letters: a word made of nothing else is read in its own alphabet.
WEAK = frozenset("гкпακιυχϳһүոսհЬ")

NONE, LATIN, LIKE, FOREIGN = 0, 1, 2, 3
ZWJ, VS16, KEYCAP = 0x200D, 0xFE0F, 0x20E3


@dataclass
class Tables:
    base: np.ndarray  # first code point of the full canonical decomposition
    parts_at: np.ndarray
    parts_n: np.ndarray
    parts: np.ndarray
    ccc: np.ndarray
    mark: np.ndarray
    invisible: np.ndarray
    plain: np.ndarray  # full-width forms and odd spaces to their ordinary character, else itself
    like: np.ndarray  # look-alike to Latin, else itself
    weak: np.ndarray
    script: np.ndarray
    word: np.ndarray  # letter or digit
    lower: np.ndarray  # lower case of the base letter, d for đ
    bare: np.ndarray  # the base letter in its own case, d for đ
    lettered: np.ndarray  # lower for letters and digits, else a blank
    emoji: np.ndarray
    suspicious: np.ndarray
    pair_keys: np.ndarray
    pair_to: np.ndarray


@lru_cache(1)
def tables() -> Tables:
    ident = np.arange(LIMIT, dtype=np.uint32)
    base, plain, like, lower = ident.copy(), ident.copy(), ident.copy(), ident.copy()
    ccc, script = np.zeros(LIMIT, np.uint8), np.zeros(LIMIT, np.uint8)
    mark, invisible, word, emoji, suspicious = (np.zeros(LIMIT, bool) for _ in range(5))
    parts: list[int] = []
    parts_at, parts_n = np.zeros(LIMIT, np.int64), np.ones(LIMIT, np.int64)
    pairs: list[tuple[int, int]] = []
    for cp in range(0x80, LIMIT):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x17000 <= cp < 0x1B000:
            word[cp] = 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4
            script[cp] = FOREIGN if word[cp] else NONE
            continue
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Cn":
            continue
        how = unicodedata.decomposition(c)
        if how and how[0] != "<":
            full = unicodedata.normalize("NFD", c)
            parts_at[cp], parts_n[cp], base[cp] = len(parts), len(full), ord(full[0])
            parts += map(ord, full)
            if unicodedata.normalize("NFC", c) != c:
                suspicious[cp] = True
            elif " " in how:
                a, b = how.split()
                pairs.append((int(a, 16) << 32 | int(b, 16), cp))
        elif how.startswith("<wide>"):
            plain[cp] = int(how.split()[1], 16)
        elif how.startswith("<font>") and cat[0] == "L":
            to = chr(int(how.split()[1], 16))
            if to.isascii():
                like[cp] = ord(to)
        if cat == "Zs":
            plain[cp] = 0x20
        elif cat[0] == "M":
            mark[cp], ccc[cp] = True, unicodedata.combining(c)
        elif cat == "Cf" and not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD) or 0xFFF9 <= cp <= 0xFFFB):
            invisible[cp] = True
        elif cat in ("So", "Sk") and (cp >= 0x1F000 or 0x2190 <= cp < 0x2C00):
            emoji[cp] = True
        word[cp] = cat[0] == "L" or cat in ("Nd", "Nl", "No")
        if cat[0] == "L":
            script[cp] = LATIN if unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN")) or cat == "Lm" or cp in (0xAA, 0xBA) else FOREIGN
    for cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        invisible[cp], word[cp], script[cp] = True, False, NONE
    invisible[0xFE00:0xFE10] = True
    mark[invisible] = False
    for a, b in LOOK_ALIKES.items():
        like[ord(a)] = ord(b)
    script[like != ident] = LIKE
    weak = np.zeros(LIMIT, bool)
    weak[[ord(c) for c in WEAK]] = True
    script[ord("A") : ord("Z") + 1] = script[ord("a") : ord("z") + 1] = LATIN
    word[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
    for cp in np.flatnonzero(word):
        if 0x3400 <= cp < 0xD7A4:
            continue
        low = chr(base[cp]).lower()
        lower[cp] = ord(low[0]) if low else cp
    lower[ord("đ")] = lower[ord("Đ")] = ord("d")
    bare = base.copy()
    bare[ord("đ")], bare[ord("Đ")] = ord("d"), ord("D")
    suspicious |= mark | invisible | (plain != ident) | (script == LIKE) | (script[np.minimum(base, LIMIT - 1)] == LIKE)
    keys = np.array([k for k, _ in pairs], np.uint64)
    order = np.argsort(keys)
    return Tables(base, parts_at, parts_n, np.array(parts, np.uint32), ccc, mark, invisible, plain, like, weak, script, word, lower, bare, np.where(word, lower, np.uint32(0x20)), emoji, suspicious, keys[order], np.array([v for _, v in pairs], np.uint32)[order])


def get(table: np.ndarray, cps: np.ndarray, default: object = 0) -> np.ndarray:
    """table[cps], with `default` above the tables."""
    if default == table[LIMIT - 1]:  # the last place is no character, so it has what most others have
        return np.take(table, cps, mode="clip")
    if len(cps) and cps.max() >= LIMIT:
        return np.where(cps < LIMIT, np.take(table, cps, mode="clip"), default)
    return np.take(table, cps)


def mapped(table: np.ndarray, cps: np.ndarray) -> np.ndarray:
    """table[cps] for tables of code points: what lies above them stays itself."""
    out = np.take(table, cps, mode="clip")
    if len(cps) and cps.max() >= LIMIT:
        out = np.where(cps < LIMIT, out, cps)
    return out.astype(np.uint32, copy=False)


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of a string array; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(column) else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts[off - off[0]] if len(off) else np.zeros(1, np.int64)


def to_arrow(cps: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The strings of (code points, row offsets); rows that are not valid are null."""
    raw = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[off]
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw), mask).cast(pa.string())


def keep(mask: np.ndarray, off: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """Only the places of mask: (new offsets, each array)."""
    return (np.concatenate([[0], np.cumsum(mask)])[off], *[a[mask] for a in arrays])


def rows_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def pieces(batch: pa.RecordBatch, column: int | str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about `limit` bytes of text, or of one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [n]])
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def hidden(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which code points are invisible signs, those that hold an emoji together aside."""
    t = tables()
    gone = get(t.invisible, cps, False)
    if not gone.any():
        return gone
    n = len(cps)
    row = rows_of(off)
    pict = get(t.emoji, cps, True).astype(bool) | (cps >= 0x1F000)
    solid = ~gone  # the nearest visible sign before and after, skipping invisible ones
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(solid, at, -1))
    after = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
    ok_b = (before >= 0) & (row[np.maximum(before, 0)] == row)
    ok_a = (after < n) & (row[np.minimum(after, n - 1)] == row)
    pict_b = ok_b & pict[np.maximum(before, 0)]
    pict_a = ok_a & pict[np.minimum(after, n - 1)]
    # A joiner counts as part of an emoji only if nothing but a variation selector lies between it and its neighbours.
    near_b = (at - before) <= 2
    near_a = (after - at) <= 2
    joins = (cps == ZWJ) & pict_b & pict_a & near_b & near_a
    keycap = ok_a & (get(t.mark, cps, False).astype(bool)[np.minimum(after, n - 1)]) & (cps[np.minimum(after, n - 1)] == KEYCAP)
    selects = (cps == VS16) & ((pict_b & (at - before == 1)) | keycap)
    return gone & ~joins & ~selects


def read_as_latin(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """cps with look-alike letters in their Latin form, in words that can be read as Latin.

    A word with a letter that has no Latin look is of another alphabet and stays. So does a word without any
    Latin letter or digit beside such a word, or one that consists of weak look-alikes only.
    cps are base letters and marks (decomposed), without invisible signs.
    """
    t = tables()
    script = get(t.script, cps, NONE)
    if not (script == LIKE).any():
        return cps
    inside = get(t.word, cps, False).astype(bool) | get(t.mark, cps, False).astype(bool)
    first = np.zeros(len(cps), bool)
    first[off[:-1][off[:-1] < len(cps)]] = True
    opens = inside & (first | ~np.concatenate([[False], inside[:-1]]))
    wid = np.cumsum(opens) - 1
    n = int(opens.sum())
    at = wid[inside]
    flag = lambda m: np.bincount(at[m[inside]], minlength=n) > 0
    other = flag(script == FOREIGN)
    latin = flag((script == LATIN) | ((cps >= 0x30) & (cps <= 0x39)))
    strong = flag((script == LIKE) & ~get(t.weak, cps, False).astype(bool))
    row = rows_of(off)[opens]
    beside = np.zeros(n, bool)
    if n > 1:
        same = row[1:] == row[:-1]
        beside[1:] |= other[:-1] & same
        beside[:-1] |= other[1:] & same
    reads = ~other & (latin | (strong & ~beside))
    change = inside & (script == LIKE)
    change[change] = reads[wid[change]]
    out = cps.copy()
    out[change] = t.like[cps[change]]
    return out


def decompose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full canonical decomposition by expansion offsets (Hangul syllables stay whole)."""
    t = tables()
    n = get(t.parts_n, cps, 1).astype(np.int64)
    if (n == 1).all():
        return mapped(t.base, cps), off
    ends = np.cumsum(n)
    src = np.repeat(np.arange(len(cps)), n)
    step = np.arange(len(src)) - np.repeat(ends - n, n)
    out = mapped(t.base, cps)[src]
    many = n[src] > 1
    out[many] = t.parts[t.parts_at[cps[src[many]]] + step[many]]
    return out, np.concatenate([[0], ends])[off]


def compose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed onto their letters, all segments side by side."""
    if not len(cps):
        return cps, off
    t = tables()
    ccc = get(t.ccc, cps, 0).astype(np.int64)
    first = np.zeros(len(cps), bool)
    first[off[:-1][off[:-1] < len(cps)]] = True
    opens = first | (ccc == 0)
    seg = np.cumsum(opens) - 1
    if (np.diff(ccc) < 0).any():
        order = np.argsort(seg * 256 + ccc, kind="stable")
        cps, ccc = cps[order], ccc[order]
    start = np.flatnonzero(opens)
    length = np.diff(np.concatenate([start, [len(cps)]]))
    cps, alive = cps.copy(), np.ones(len(cps), bool)
    active = np.flatnonzero(length > 1)
    last = np.zeros(len(start), np.int64)
    k = 1
    while len(active):
        at = start[active] + k
        mark, cc = cps[at], ccc[at]
        key = cps[start[active]].astype(np.uint64) << np.uint64(32) | mark.astype(np.uint64)
        i = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        fits = (t.pair_keys[i] == key) & (last[active] < cc) & (ccc[start[active]] == 0)
        cps[start[active[fits]]] = t.pair_to[i[fits]]
        alive[at[fits]] = False
        last[active[~fits]] = cc[~fits]
        k += 1
        active = active[length[active] > k]
    off, cps = keep(alive, off, cps)
    return _hangul(cps, off)


def _hangul(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining jamo composed to syllables."""
    lead = (cps >= 0x1100) & (cps <= 0x1112)
    if lead.any():
        row = rows_of(off)
        hit = np.flatnonzero(lead[:-1] & (cps[1:] >= 0x1161) & (cps[1:] <= 0x1175) & (row[1:] == row[:-1]))
        cps, alive = cps.copy(), np.ones(len(cps), bool)
        cps[hit] = 0xAC00 + ((cps[hit] - 0x1100) * 21 + (cps[hit + 1] - 0x1161)) * 28
        alive[hit + 1] = False
        off, cps = keep(alive, off, cps)
    tail = (cps > 0x11A7) & (cps <= 0x11C2)
    if tail.any():
        row = rows_of(off)
        lv = (cps >= 0xAC00) & (cps < 0xD7A4) & ((cps.astype(np.int64) - 0xAC00) % 28 == 0)
        hit = np.flatnonzero(lv[:-1] & tail[1:] & (row[1:] == row[:-1]))
        cps, alive = cps.copy(), np.ones(len(cps), bool)
        cps[hit] += cps[hit + 1] - 0x11A7
        alive[hit + 1] = False
        off, cps = keep(alive, off, cps)
    return cps, off


def canonical(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, which rows changed): every text in its one consistent form."""
    t = tables()
    rows = len(off) - 1
    changed = np.zeros(rows, bool)
    odd = get(t.suspicious, cps, False).astype(bool)
    odd |= (cps >= 0x1100) & (cps <= 0x11FF)
    hits = np.concatenate([[0], np.cumsum(odd)])
    sick = np.diff(hits[off]) > 0
    if not sick.any():
        return cps, off, changed
    there = np.repeat(sick, np.diff(off))
    sub, soff = cps[there], np.concatenate([[0], np.cumsum(np.diff(off)[sick])])
    before, boff = sub, soff
    soff, sub = keep(~hidden(sub, soff), soff, sub)
    sub, soff = decompose(mapped(t.plain, sub), soff)
    sub = read_as_latin(sub, soff)
    sub, soff = compose(sub, soff)
    new_len = np.diff(soff)
    same = new_len == np.diff(boff)
    differs = ~same
    # Rows of equal length are compared place by place.
    pos_b, pos_a = np.repeat(same, np.diff(boff)), np.repeat(same, new_len)
    unlike = before[pos_b] != sub[pos_a]
    at = np.repeat(np.flatnonzero(same), np.diff(boff)[same])
    differs[at[unlike]] = True
    changed[np.flatnonzero(sick)] = differs
    # The rows are laid out again in order: healthy ones as they were, the others in their new form.
    lengths = np.diff(off).copy()
    lengths[sick] = new_len
    noff = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(noff[-1], np.uint32)
    place = np.repeat(sick, lengths)
    out[~place], out[place] = cps[~there], sub
    return out, noff, changed


@dataclass
class Words:
    """The words of a batch: row, place in the stored text (code points from 0, end exclusive) and a 64-bit hash of the folded form."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    digit: np.ndarray  # holds a digit
    length: np.ndarray  # of the folded form


def _apart(cps: np.ndarray, off: np.ndarray, quick, whole) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(code points, offsets, source place) by `quick`, place by place, for rows of ordinary characters, by `whole` for the others.

    The source places are None where every code point has its own.
    """
    odd = np.flatnonzero(get(tables().suspicious, cps, False))
    made = quick(cps)
    if not len(odd):
        return made, off, None
    rows = np.unique(np.searchsorted(off, odd, side="right") - 1)
    lengths = np.diff(off)
    starts, ends = off[rows], off[rows + 1]
    each = lengths[rows]
    soff = np.concatenate([[0], np.cumsum(each)])
    c2, off2, src2 = whole(np.concatenate([cps[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), soff)
    src2 = src2 + np.repeat(starts - soff[:-1], np.diff(off2))
    lengths[rows] = np.diff(off2)
    own = np.arange(len(cps))
    out, src, at = [], [], 0
    for a, b, x, y in zip(starts.tolist(), ends.tolist(), off2[:-1].tolist(), off2[1:].tolist()):
        out += [made[at:a], c2[x:y]]
        src += [own[at:a], src2[x:y]]
        at = b
    return np.concatenate([*out, made[at:]]), np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([*src, own[at:]])


def _bare(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base letters and signs without disguises and marks, with their source places."""
    t = tables()
    stay = ~hidden(cps, off)
    src = np.flatnonzero(stay)
    off, c = keep(stay, off, cps)
    b = read_as_latin(mapped(t.base, mapped(t.plain, c)), off)
    off, b, src = keep(~get(t.mark, b, False).astype(bool), off, b, src)
    return b, off, src


def _lettered(b: np.ndarray) -> np.ndarray:
    return np.take(tables().lettered, b, mode="clip")


def _without_accents(b: np.ndarray) -> np.ndarray:
    return mapped(tables().bare, b)


def fold(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(code points, offsets, source place or None): without disguises, case and accents; what is no letter or digit is a space."""

    def whole(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, o, src = _bare(c, o)
        return _lettered(b), o, src

    return _apart(cps, off, _lettered, whole)


_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_MULT ** (i + 1) and its inverse ** i, modulo 2 ** 64, for the places of one step's code points."""
    n = CHUNK_BYTES + 64
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    power = np.multiply.accumulate(np.full(n, _MULT, np.uint64))
    back = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, inverse, np.uint64))])
    return power, back


def _polynomials(f: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of f[j] * _MULT ** (j - start + 1) over each stretch, modulo 2 ** 64."""
    power, back = _powers()
    n = len(power)
    if len(f) <= n:
        total = np.concatenate([[np.uint64(0)], np.cumsum(f * power[: len(f)], dtype=np.uint64)])
        return (total[end] - total[start]) * back[start]
    length = end - start
    power = np.multiply.accumulate(np.full(int(length.max()), _MULT, np.uint64))
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), 100_000):  # a text beyond one step: stretch by stretch
        s, k = start[a : a + 100_000], length[a : a + 100_000]
        first = np.cumsum(k) - k
        step = np.arange(int(k.sum())) - np.repeat(first, k)
        out[a : a + 100_000] = np.add.reduceat(f[np.repeat(s, k) + step] * power[step], first)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    h = h.astype(np.uint64, copy=True)
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mult)
    return h ^ (h >> np.uint64(33))


def words(cps: np.ndarray, off: np.ndarray) -> Words:
    """The words of stored texts: longest runs of letters and digits, compared without case, accents and disguises."""
    f, foff, src = fold(cps, off)
    if not len(f):
        e = np.zeros(0, np.int64)
        return Words(e, e, e, np.zeros(0, np.uint64), np.zeros(0, bool), e)
    inside = f != 0x20
    first = np.zeros(len(f) + 1, bool)
    first[foff] = True
    parts = first.copy()  # a word begins or ends only where inside changes, or a row does
    parts[1:-1] |= inside[1:] != inside[:-1]
    edges = np.flatnonzero(parts)
    word = inside[edges[:-1]]
    opens, ends = edges[:-1][word], edges[1:][word]
    length = ends - opens
    h = mix(_polynomials(f, opens, ends) + length.astype(np.uint64))
    digits = np.cumsum((f - np.uint32(0x30)) < 10, dtype=np.int32)
    digit = digits[ends - 1] - digits[opens] + ((f[opens] - np.uint32(0x30)) < 10) > 0
    row = np.searchsorted(foff, opens, side="right") - 1
    if src is None:
        return Words(row, opens - off[row], ends - off[row], h, digit, length)
    return Words(row, src[opens] - off[row], src[ends - 1] + 1 - off[row], h, digit, length)


def word_strings(cps: np.ndarray, off: np.ndarray) -> list[list[str]]:
    """The folded words of each row as strings, for small inputs such as evaluation items."""
    f, foff, _ = fold(cps, off)
    return [s.split() for s in to_arrow(f, foff).to_pylist()]


def fold_shape(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(code points, offsets, source place or None): without disguises and accents, but with case and all visible signs."""

    def whole(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, o, src = _bare(c, o)
        return _without_accents(b), o, src

    return _apart(cps, off, _without_accents, whole)


def shapes(cps: np.ndarray, off: np.ndarray) -> list[tuple[str, np.ndarray | None]]:
    """fold_shape() of each row as a string, with its source places, or None where they are the string's own."""
    whole = _without_accents(cps).tobytes().decode("utf-32-le")
    out: list[tuple[str, np.ndarray | None]] = [(whole[a:b], None) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    odd = np.flatnonzero(get(tables().suspicious, cps, False))
    for r in np.unique(np.searchsorted(off, odd, side="right") - 1).tolist():
        f, _, src = fold_shape(cps[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]))
        out[r] = (f.tobytes().decode("utf-32-le"), src)
    return out
