"""The operators of the llm subpackage against brute force, round trips and on the edges."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarind.llm import canonical, leakage, overlap, packing, personal, quantiles
from tamarind.llm import codepoints as C
from tamarind.llm.queries import tokenizer_path

TEXT = st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=20)
ACCENTS = st.text(alphabet="aeiouyAdđĐ q̃ếộượ̧̛̀́̃̉̂̆ệǟḱ한한", max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXT, ACCENTS), max_size=8))
def test_codepoints_round_trip_and_composition(texts):
    cps, off = C.to_codepoints(pa.array(texts, pa.string()))
    assert C.to_arrow(cps, off).to_pylist() == texts
    accents = [t for t in texts if all(ord(c) < 0x2000 or 0xAC00 <= ord(c) < 0xD7A4 for c in t) and all(unicodedata.combining(c) in (0, 202, 216, 220, 230) and not 0x600 <= ord(c) < 0x1000 for c in t)]
    c2, o2 = C.compose(*C.decompose(*C.to_codepoints(pa.array(accents, pa.string()))))
    assert C.to_arrow(c2, o2).to_pylist() == [unicodedata.normalize("NFC", t) for t in accents]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", None),
        ("Tiếng Việt – “ổn”, 👩‍💻 ☎\tx\n", None),
        (unicodedata.normalize("NFD", "Tiếng Việt"), "Tiếng Việt"),
        ("ＡＢＣ１２３（ｘ）", "ABC123(x)"),
        ("a​b­c﻿⁠d", "abcd"),
        ("a b　c d", "a b c d"),
        ("Νа Ρhép ТХN12", "Na Phép TXN12"),
        ("Юлиния Σύνοψη жданица", None),
        ("о̛́", "ớ"),
        ("ｕ̛", "ư"),
        ("👨‍👩‍👧 ❤️ 1️⃣", None),
        ("a‍b", "ab"),
        ("Ðà Nẵng, ÐT, ðồng Ɖ", "Đà Nẵng, ĐT, đồng Đ"),
        ("в 2025", None),
    ],
)
def test_canonical_form(text, want):
    cps, off, changed = C.canonical(*C.to_codepoints(pa.array([text, "x"])))
    out = C.to_arrow(cps, off).to_pylist()
    assert out == [text if want is None else want, "x"] and list(changed) == [want is not None, False]


def test_canonical_table(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "ａ" * 300_000, "z"), (3, "ａ" * 300_000, "z")]
    got = canonical.canonical_text(spark.createDataFrame(rows, "id int, text string, changed string"), "text").collect()
    assert [(r["id"], r["canonical"] and len(r["canonical"]), r["changed"]) for r in got] == [(1, None, False), (2, "", False), (3, 300_000, True), (3, 300_000, True)]
    assert canonical.canonical_text(spark.createDataFrame([], "text string"), "text").count() == 0


def test_words_keep_their_places():
    text = "Xin " + unicodedata.normalize("NFD", "chào") + "_b​1, Ｃ"
    w = C.words(*C.to_codepoints(pa.array(["", text, None])))
    assert [unicodedata.normalize("NFC", text[a:b]) for a, b in zip(w.start, w.end)] == ["Xin", "chào", "b​1", "Ｃ"]
    assert set(w.row) == {1} and list(w.digit) == [False, False, True, False]
    v = C.words(*C.to_codepoints(pa.array(["xin CHAO b1 c"])))
    assert list(v.hash) == list(w.hash)


def test_words_of_texts_beyond_one_step(monkeypatch):
    text = "Xin chào ＡＢ " * 4000 + "Ðồng"
    whole = C.words(*C.to_codepoints(pa.array(["a", text, "b"])))
    C._powers.cache_clear()
    monkeypatch.setattr(C, "CHUNK_BYTES", 500)
    parts = C.words(*C.to_codepoints(pa.array(["a", text, "b"])))
    C._powers.cache_clear()
    assert len(whole.hash) == 12_003 and all((getattr(whole, k) == getattr(parts, k)).all() for k in ("row", "start", "end", "hash", "digit", "length"))
    assert whole.hash[-2] == C.words(*C.to_codepoints(pa.array(["đong"]))).hash[0]


def brute_overlaps(evals, train):
    digits = lambda ws: {w for w in ws if any(c.isdigit() for c in w)}
    ew, tw = (C.word_strings(*C.to_codepoints(pa.array([t for _, t in x], pa.string()))) for x in (evals, train))
    out = set()
    for (e, _), a in zip(evals, ew):
        for (t, _), b in zip(train, tw):
            n = max(len(a), len(b))
            if n and digits(a) == digits(b) and sum((Counter(a) & Counter(b)).values()) >= 0.7 * n - 1e-9 and e is not None and t is not None:
                out.add((e, t))
    return out


@pytest.mark.parametrize("shard", [4_000_000, 200])
def test_overlaps_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(overlap, "SHARD_CHARS", shard)
    r = random.Random(3)
    vocabulary = ["a", "b", "c", "đi", "ve", "nhà", "x1", "22", "ID77", "the", "the"]
    make = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(12)))
    evals = [(f"e{i}", make()) for i in range(40)] + [("n", None), ("long", "a " * 5000)]
    train = [(i, make()) for i in range(400)] + [(1000 + i, t.upper()) for i, (_, t) in enumerate(evals[:30])] + [(2000, None), (2001, ""), (2002, "A " * 4000), (2002, "A " * 4000), (None, "a b c")]
    got = [tuple(x) for x in overlap.overlaps(spark.createDataFrame(evals, "id string, q string"), "id", "q", spark.createDataFrame(train, "id long, q string"), "id", "q").select("eval_id", "train_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_overlaps(evals, train)


def test_coverage_is_merged_from_passages(spark):
    evals = spark.createDataFrame([("a", "một hai ba bốn năm sáu bảy"), ("b", "x y")], "id string, t string")
    train = spark.createDataFrame([(1, "một hai ba KHÁC bốn năm sáu bảy"), (2, "bảy sáu năm bốn ba hai một"), (3, "X, y"), (4, "một hai ba bốn năm"), (5, "ba bốn năm sáu bảy")], "id long, t string")
    pairs = overlap.overlaps(evals, "id", "t", train, "id", "t")
    got = {(r["eval_id"], r["train_id"]): (r["shared"], [(i["first"], i["last"]) for i in r["intervals"]]) for r in pairs.collect()}
    assert got == {("a", 1): (7, [(0, 6)]), ("a", 2): (7, []), ("b", 3): (2, [(0, 1)]), ("a", 4): (5, [(0, 4)]), ("a", 5): (5, [(2, 6)])}
    assert {tuple(r) for r in overlap.coverage(pairs).collect()} == {("a", 4, 1.0, 7), ("b", 1, 1.0, 2)}
    assert overlap.coverage(pairs.where("train_id = 2")).first()["covered_words"] == 0


def test_overlap_of_empty_tables(spark):
    e = spark.createDataFrame([], "id string, t string")
    assert overlap.overlaps(e, "id", "t", spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t").count() == 0


def test_quantiles_keep_their_bound(spark):
    df = spark.range(60_000).select((F.rand(3) * 1000).alias("v"), (F.col("id") % 3).alias("day"), F.when(F.col("id") % 2 == 0, F.lit("hot")).alias("g"))
    odd = spark.createDataFrame([(float("nan"), 0, "x"), (None, 1, "x"), (5.0, 1, "tie"), (5.0, 2, "tie")], "v double, day long, g string")
    df = df.unionByName(odd)
    days = quantiles.sketch(df, ["day", "g"], "v")
    q = quantiles.percentiles(quantiles.merge(days, ["g"]), ["g"], [0.0, 0.5, 0.99, 1.0])
    assert {r["within"] for r in quantiles.rank_check(df, q, ["g"], "v").collect()} == {True}
    by = {(r["g"], r["p"]): r for r in q.collect()}
    assert by[("x", 0.5)]["value"] is None and by[("x", 0.5)]["n_nan"] == 1 and by[("x", 0.5)]["n_null"] == 1
    assert by[("tie", 0.5)]["value"] == 5.0 and (None, 0.5) in by
    assert quantiles.sketch(df.limit(0), ["g"], "v").count() == 0


def test_sum_of_squares_choice_is_the_best():
    p, r, cap = packing.SumOfSquares(10), random.Random(2), 10
    level: dict[int, int] = {}
    for _ in range(400):
        size = r.randrange(1, 11)
        counts = Counter(v for v in level.values() if v < cap)

        def cost(h):
            c = counts.copy()  # noqa: B023
            if h:
                c[h] -= 1
            if h + size < cap:  # noqa: B023
                c[h + size] += 1  # noqa: B023
            return sum(v * v for v in c.values())

        best = min(cost(h) for h in [0, *[h for h in counts if counts[h] and h + size <= cap]])
        window, offset = p.place(size)
        assert cost(offset) == best and level.get(window, 0) == offset
        level[window] = offset + size
    assert sorted(v for v in level.values() if v < cap) == sorted(h for _, h in p.left_open())


def test_packing_loses_nothing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["xin", "chào", "số", "12"]) for _ in range(r.randrange(60)))) for i in range(300)] + [(900, None), (901, ""), (902, "từ " * 3000), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = tokenizer_path(spark)
    got = packing.pack(df, "doc_id", "text", path, 128).collect()
    want = Counter()
    for i, t in rows:
        want[i] += packing.count_tokens(t, path)
    have, taken = Counter(), {}
    for x in got:
        have[x["doc_id"]] += x["n_tokens"]
        if x["n_tokens"]:
            taken.setdefault(x["window_id"], []).append((x["offset"], x["n_tokens"]))
        else:
            assert x["window_id"] is None
    assert have == want and {x["doc_id"] for x in got} == {i for i, _ in rows}
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 128
    assert sum(want.values()) / (len(taken) * 128) > 0.9
    assert packing.pack(df.limit(0), "doc_id", "text", path, 128).count() == 0


def test_token_counts_are_those_of_whole_texts(spark, monkeypatch):
    path, r = tokenizer_path(spark), random.Random(3)
    whole = lambda t: len(packing._encoding(path).encode_ordinary(t))
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(250_001))
    for t in ("câu hỏi   dài\n" * 20_000, letters, " " * 250_001 + "x", letters[:150_000] + " " + letters[:90_000]):
        assert packing.count_tokens(t, path) == whole(t)
    monkeypatch.setattr(packing, "STRETCH", 20)
    for _ in range(500):
        t = "".join(r.choice(["a", " ", "  ", "\n", "'s", "1", "é", "\xa0", "\u3000", "!", "xin", " chào", "-"]) for _ in range(r.randrange(200)))
        assert packing.count_tokens(t, path) == whole(t)


def brute_leaks(docs, items):
    words = lambda rows: C.word_strings(*C.to_codepoints(pa.array([t for _, t in rows], pa.string())))
    runs = lambda ws: {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
    iw = [(i, runs(w)) for (i, _), w in zip(items, words(items))]
    return {(d, i) for (d, _), w in zip(docs, words(docs)) for i, g in iw if d is not None and g & runs(w)}


@pytest.mark.parametrize(("shard", "most"), [(60_000, 10**6), (300, 10**6), (200, 100)])
def test_leaks_equal_brute_force(spark, monkeypatch, shard, most):
    monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
    monkeypatch.setattr(leakage, "MOST_WORDS", most)
    monkeypatch.setattr(leakage, "FAN", 2)
    r = random.Random(6)
    vocabulary = [f"tu{i}" for i in range(150)] + ["số", "dòng", "bảng"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, say(r.randrange(8, 40))) for i in range(30)]
    docs = []
    for d in range(200):
        ws = say(r.randrange(0, 80))
        if d % 2:
            it = items[r.randrange(30)][1]
            n = r.randrange(9, 16)
            at = r.randrange(0, max(1, len(it) - n))
            ws[len(ws) // 2 : len(ws) // 2] = [w.upper() for w in it[at : at + n]]
        docs.append((d, "_".join(ws)))
    items = [(i, " ".join(ws)) for i, ws in items]
    docs += [(500, None), (501, ""), (502, items[0][1] + " x " * 20_000), (None, items[0][1]), (503, items[3][1]), (504, items[3][1])]
    got = [tuple(x) for x in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", False).select("doc_id", "item_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)


def test_leaks_of_empty_tables(spark):
    e = spark.createDataFrame([], "id long, t string")
    some = spark.createDataFrame([(1, "a " * 20)], "id long, t string")
    assert leakage.leaks(some, "id", "t", e, "id", "t").count() == 0 and leakage.leaks(e, "id", "t", some, "id", "t").count() == 0


def test_paraphrases(spark):
    item = "mot hai ba bon nam sau bay tam chin muoi mười1 mười2 x y"
    doc = "mot hai ba bon nam sau KHAC bay tam chin muoi mười1 mười2"
    r = leakage.leaks(spark.createDataFrame([(1, doc + " mot khac " + doc.replace("KHAC", "x"))], "d long, t string"), "d", "t", spark.createDataFrame([(7, item)], "i long, t string"), "i", "t").collect()
    assert len(r) == 1 and r[0]["kind"] in ("verbatim", "paraphrase") and r[0]["lcs"] >= 9


def test_paraphrases_with_words_no_item_has(spark):
    item = "khach hang mo tai khoan 12345 tai chi nhanh ha noi ngay 7 thang nam"
    words = item.split()
    swapped = " ".join(["la", "le", *words[:5], "zzz", *words[6:9], "yyy", *words[10:], "lu"])
    swapped = swapped.replace("zzz", "12345 zzz")  # the answer stays, a foreign word comes in
    docs = [(1, swapped), (2, " ".join(words[:5] + ["xxx"] + words[6:12])), (3, "khong co gi " * 9), (4, " ".join(words[:10])), (5, ""), (6, None)]
    got = leakage.leaks(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(7, item)], "i long, t string"), "i", "t")
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got.collect()) == [(1, 7, "paraphrase"), (4, 7, "paraphrase")]
    only = leakage.leaks(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(7, item)], "i long, t string"), "i", "t", False)
    assert only.count() == 0


def test_planted_paraphrases_are_found(spark):
    """Items of 20 words, each planted with up to three of twelve words in a row changed or taken out; the numbers stay."""
    r = random.Random(12)
    vocabulary = [f"{a}{b}o" for a in "bcdghklmnprstvx" for b in ["a", "e", "i", "u", "ua", "ie", "oa", "ai", "au", "ia", "ue", "oi", "ui", "eo", "iu", "ou", "ea", "ae", "ei", "aa"]]
    items = [(i, [*(r.choice(vocabulary) for _ in range(19)), f"so{i}7"]) for i in range(60)]
    docs, want = [], set()
    for d in range(400):
        ws = [r.choice([*vocabulary, "la", "le", "lo"]) for _ in range(r.randrange(30, 60))]
        if d % 2:
            i, words = items[r.randrange(60)]
            passage = words[8:]  # its last word is the answer
            for at in r.sample(range(10), r.randrange(1, 4)):
                passage[at] = r.choice(["khac", "moi", r.choice(vocabulary)])
            if r.random() < 0.3:
                passage.insert(r.randrange(10), "chen")
            ws[10:10] = passage
            want.add((d, i))
        docs.append((d, " ".join(ws)))
    rows = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text", spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string"), "item_id", "text").collect()
    got = {(x["doc_id"], x["item_id"]) for x in rows}
    assert len(got & want) >= 0.9 * len(want), len(got & want) / len(want)
    assert len(got - want) <= 0.02 * len(want) and all(x["lcs"] >= 9 for x in rows)


@pytest.mark.parametrize("shard", [60_000, 12])
def test_paraphrases_do_not_depend_on_other_items(spark, monkeypatch, shard):
    monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
    words = [f"w{'abcdefghijklmnop'[i]}" for i in range(14)]
    doc = spark.createDataFrame([(1, " ".join([*words[:6], "foreign", *words[6:]]))], "d long, t string")
    alone = [(7, " ".join(words[:12]))]
    for items in (alone, [*alone, (8, "foreign " * 13)], [*alone, (9, " ".join(f"z{'abcdefghijklmnop'[i]}" for i in range(16)))]):
        got = leakage.leaks(doc, "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()
        assert [(x["item_id"], x["kind"], x["lcs"]) for x in got] == [(7, "paraphrase", 12)]


def test_mixed_passages_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        length = rng.integers(1, 60, rng.integers(1, 5))
        row, known = np.repeat(np.arange(len(length)), length), rng.random(length.sum()) < rng.choice([0.5, 0.9])
        inside = np.zeros(len(row), bool)
        for a in range(len(row) - leakage.RUN + 1):
            if known[a : a + leakage.RUN].all() and row[a] == row[a + leakage.RUN - 1]:
                inside[a : a + leakage.RUN] = True
        want, off = set(), 0
        for n in length:
            for a in range(off, off + max(n - leakage.SPAN, 0) + leakage.BLOCK, leakage.BLOCK):
                if a > off and a + leakage.SPAN >= off + n + leakage.BLOCK:
                    continue
                z = min(a + leakage.SPAN, off + n)
                if known[a:z].sum() >= 9 and not inside[a:z].all():
                    want.add((a, z))
            off += n
        start, end = leakage._mixed(row, known, inside)
        seg, a, z = leakage._windows(end - start)
        shift = start[seg] - np.concatenate([[0], np.cumsum(end - start)])[seg]
        assert len(seg) == len(want) and set(zip((a + shift).tolist(), (z + shift).tolist())) == want


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        if a and b:
            lcs, there = leakage.common_subsequences(np.array([a], np.int32), np.array([b], np.int32))
            assert lcs[0] == t[-1][-1] and [bool(int(there[0]) >> i & 1) for i in range(len(a))] == [x in b for x in a]


def people(spark):
    r = random.Random(8)
    parts = (["Nguyễn", "Trần", "Phạm", "Tạ"], ["Duy", "Mộng", "Hữu", "Thế"], ["Sương", "Mây", "Kha", "Lộc"])
    names = [" ".join(r.choice(p) for p in parts) for _ in range(60)]
    return names, personal.known_names((spark.createDataFrame([(n,) for n in names], "n string"), "n"))


def test_personal_information(spark):
    names, lexicon = people(spark)
    r = random.Random(9)
    rows, want = [], set()

    def put(doc, parts):
        text = ""
        for p in parts:
            if isinstance(p, tuple):
                want.add((doc, p[0], len(text) + 1))
                p = p[1]
            text += p
        rows.append((doc, text))

    for i in range(60):
        n, tail = names[i], f"{r.randrange(10**6):06d}"
        phone = [f"063{tail[0]}{tail}", f"063{tail[0]} {tail[:3]} {tail[3:]}", f"+84 63{tail[0]} {tail}", f"(063) {tail[:3]} {tail[3:]}7"][i % 4]
        put(4 * i, ["Liên hệ chị ", ("name", n), ", điện thoại ", ("phone", phone), ", nhận tại ", ("address", f"{i + 1}/2 đường Cầu Nan, phường Mỏ Hạc"), "; gửi ", ("email", [f"a.b{i}@mail.example", f"ab{i} (at) mail.example", f"ab{i}[at]mail[dot]example"][i % 3]), "."])
        put(4 * i + 1, ["CCCD: ", ("id_number", [f"0{i % 9}1{tail}123", f"0{i % 9}1 {tail[:3]} {tail[3:]} 123"][i % 3 == 0]), f"\nSTK {r.choice('123456789')}{tail}123 ở chi nhánh Trần Hữu Kha, job 0{tail}123. Tổng đài 1900 {1000 + i}\n", "Assigned to ", ("name", [f"{'CDFGHJKLMNP'[i % 11]}orbin {'BCDFGHJKLMNPQ'[i % 13]}ostrova", " ".join(reversed(n.split()[::2]))][i % 2]), "; done"])
        put(4 * i + 2, ["Tuyến đường ", "Phạm Duy Lộc thi công, lô 4", tail, "55512 chậm. Biểu mẫu B", tail, "1 thay mẫu cũ"])
        put(4 * i + 3, [unicodedata.normalize("NFD", "Người nhận ") , ("name", unicodedata.normalize("NFD", n)), ", xin chờ"])
    rows += [(9000, None), (9001, ""), (None, "SĐT: 0631234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal.occurrences(df, "doc_id", "text", lexicon)
    got = {(x["doc_id"], x["kind"], x["start_pos"]) for x in found.collect()}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    masked = {x["doc_id"]: x["text"] for x in personal.masked(df, "doc_id", "text", found).collect()}
    assert masked[0].startswith("Liên hệ chị [NAME], điện thoại [PHONE], nhận tại [ADDRESS]; gửi [EMAIL]")
    assert masked[2] == rows[2][1] and masked[9000] is None and masked[9001] == ""
    assert personal.occurrences(df.limit(0), "doc_id", "text", lexicon).count() == 0


def test_personal_contexts_are_learned_not_listed(spark):
    """Cue words that no list could hold announce numbers and names; the same shapes behind others are left."""
    names, lexicon = people(spark)
    rows, want = [], set()
    for i in range(90):
        tail = f"{i * 7919 % 10**6:06d}"
        rows.append((3 * i, f"Zulkor 063{tail[0]}{tail} nha"))
        rows.append((3 * i + 1, f"Plint 063{tail[0]}{tail} nha" if i % 2 else f"Plint 763{tail[0]}{tail} nha"))
        if i % 2:
            rows[-2] = (3 * i, f"Zulkor 063{tail[0]} {tail[:3]} {tail[3:]} nha")
        want.add((3 * i, "phone", 8))
        rows.append((3 * i + 2, f"Vask {names[i % 60]} rồi. Thuộc wuno Phạm Duy Lộc đây"))
        want.add((3 * i + 2, "name", 6))
    got = {(x["doc_id"], x["kind"], x["start_pos"]) for x in personal.occurrences(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", lexicon).collect()}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])


def test_lexicon_is_bounded_by_its_definition(spark, monkeypatch):
    monkeypatch.setattr(personal, "MOST_NAME_WORDS", 10)
    df = spark.createDataFrame([(f"An{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} Lộc",) for i in range(100)] + [("Lộc",), (None,), (" ",)], "n string")
    found = personal.known_names((df, "n"))
    assert list(found.folded) == ["loc"] and found.model(["loc"]) == 1.0 and found.model(["x", "loc"]) == 0.0
