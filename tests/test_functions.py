"""Text, date and entity functions on golden cases."""

import unicodedata
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tamarind.functions import dates, entities
from tamarind.functions import text as T
from tamarind.functions.reading import Question
from tamarind.queries import cases

TODAY = date(2026, 3, 26)


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.fold, "Đường Nguyễn", "duong nguyen"),
        (T.fold, unicodedata.normalize("NFD", "Tiếng Việt"), "tieng viet"),
        (T.fold, None, None),
        (T.clean, "  Xin   CHÀO 👋 ", "xin chào"),
        (T.normalize_question, "  số  dư TK?!. ", "Số dư tk"),
        (T.slug, "Tra cứu, giao dịch (1)", "tra_cứu_giao_dịch_1"),
        (T.file_name, 'a/b:c*"d', "a_b_c_d"),
        (lambda c: T.replace_words(c, {"ko": "không"}), "KO được, ko?", "không được, không?"),
        (lambda c: T.replace_phrases(c, {"tai khoan": "tài khoản", "tai": "tại"}), "Tai khoan tai ngân", "tài khoản tại ngân"),
        (T.parse_examples, '"một ví dụ" x "hai"', ["một ví dụ"]),
        (T.parse_keywords, "A a, b|cc\ndd", ["a a", "cc", "dd"]),
        (lambda c: T.word_chunks(c, 2), " a b c ", ["a b", "c"]),
        (lambda c: T.word_chunks(c, 2), "", []),
        (lambda c: T.ngrams(T.words(c), 2), "a b c", ["a_b", "b_c"]),
        (lambda c: T.ngrams(T.words(c), 3), "a b", []),
        (lambda c: T.normal_form(c, "NFC"), unicodedata.normalize("NFD", "ế"), "ế"),
        (T.with_fallback_json, "x", '{"raw_text":"x"}'),
        (T.embedded_json, 'so {"a": 1} it is', '{"a": 1}'),
        (T.sanitize, "“a”\x00", '"a"'),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_staged(spark):
    df = spark.createDataFrame([("ko",)], "x string")
    out, log = T.staged("x", [("words", lambda c: T.replace_words(c, {"ko": "không"})), ("clean", T.clean)])
    assert tuple(df.select(out, log).first()) == ("không", ["words"])


@pytest.mark.parametrize(("text", "a", "b"), cases.TIMES)
def test_time_parser(text, a, b):
    assert tuple(map(str, dates.TimeParser(TODAY).parse(text))) == (a, b)


def test_time_parser_gives_nothing_where_nothing_is_said():
    for x in (None, "", "  ", "xin chào", "ngày 31 tháng 2 năm 2025"):
        r = dates.TimeParser(TODAY).parse(x)
        assert r is None or x.startswith("ngày 31")


def test_named_periods_agree_with_their_entity_form(spark):
    names = ["hôm nay", "hôm qua", "tuần này", "tuần trước", "tháng này", "tháng trước", "đầu tháng", "cuối tháng", "năm nay", "năm ngoái", "đầu năm", "cuối năm", "quý 2", "quý này", "quý trước"]
    df = spark.createDataFrame([(n, d) for n in names for d in (TODAY, date(2026, 1, 5), date(2024, 2, 29))], "x string, d date")
    for r in df.select("x", "d", dates.named_period(F.col("x"), F.col("d")).alias("p")).collect():
        assert (r["p"]["start"], r["p"]["end"]) == dates.spoken_period(Question(r["x"]), r["d"]), r


def test_working_days(spark):
    rows = [(date(2026, 3, 1) + timedelta(i), date(2026, 3, 1) + timedelta(i + j)) for i in range(7) for j in range(-2, 20)]
    for r in spark.createDataFrame(rows, "a date, b date").select("a", "b", dates.working_days(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["n"] == sum((r["a"] + timedelta(k)).weekday() < 5 for k in range((r["b"] - r["a"]).days + 1))


@pytest.mark.parametrize(
    ("question", "domain", "want"),
    [
        ("giao dịch của tài khoản 1234567890 trong tháng 3", "banking", {"account_no": "1234567890", "start_date": "2026-03-01", "end_date": "2026-03-31"}),
        ("chuyển đến tài khoản 999888777666 từ stk 123456789", "banking", {"to_account_no": "999888777666", "account_no": "123456789", "transaction_type": "TRANSFER"}),
        ("từ 1,5 triệu đến 2 tỷ", "banking", {"amount_min": "1500000", "amount_max": "2000000000"}),
        ("không quá 1.500 đồng", "banking", {"amount_max": "1500"}),
        ("3 ngày trước", "banking", {"start_date": "2026-03-23", "end_date": "2026-03-26"}),
        ("nhân viên Nguyễn Văn An ngày 12/03/2026", "hrm", {"employee_name": "Nguyễn Văn An", "attendance_date": "2026-03-12"}),
        ("EMP0012 tháng 2 năm 2024", "hrm", {"employee_id": "EMP0012", "year_month": "2024-02", "start_date": "2024-02-01", "end_date": "2024-02-29"}),
        ("", "hrm", {}),
        (None, None, {}),
    ],
)
def test_entities(question, domain, want):
    got = entities.extract(question, domain, TODAY)
    assert {k: v for k, v in got.items() if k in want or not want} == want


KNOWN = cases.ENTITIES


@pytest.mark.parametrize(("question", "domain", "want"), KNOWN)
def test_known_entities(question, domain, want):
    got = entities.extract(question, domain, TODAY)
    assert {k: got.get(k) for k in want} == want


def test_entity_column_equals_single_extraction(spark):
    df = spark.createDataFrame([(q, d) for q, d, _ in KNOWN] * 2 + [(None, None), ("", "x")], "q string, d string")
    for r in df.select("q", "d", entities.entities(F.col("q"), F.col("d"), TODAY).alias("e")).collect():
        assert r["e"] == entities.extract(r["q"], r["d"], TODAY)


@pytest.mark.parametrize(
    ("question", "domain", "want"),
    [
        ("chuyển cho Trần Thị Bích 20tr qua ngân hàng Đông Á hôm qua", "banking", {"recipient_name": "Trần Thị Bích", "amount": "20000000", "bank_name": "Đông Á", "start_date": "2026-03-25"}),
        ("mã giao dịch FT2603A001 đã hủy, trên 5 tr - 20 tr", "banking", {"trans_id": "FT2603A001", "status": "CANCELLED", "amount_min": "5000000", "amount_max": "20000000"}),
        ("ngân hàng vcb, tài khoản đích 123456", "banking", {"bank_name": "vcb", "to_account_no": "123456", "account_no": None}),
        ("từ ngày 1 tháng 12 đến ngày 5 tháng 1 năm 2026", "banking", {"start_date": "2026-12-01", "end_date": "2026-01-05"}),
        ("lương dưới 20 triệu ở vị trí kế toán trưởng", "hrm", {"salary_max": "20000000", "job_title": "kế toán trưởng"}),
        ("2026-03 và 31/02/2026", "hrm", {"year_month": "2026-03", "start_date": "2026-03-01", "attendance_date": None}),
        ("nhân viên nguyễn văn an", "hrm", {"employee_name": "nguyễn văn an"}),
    ],
)
def test_entities_by_cue_and_type(question, domain, want):
    lexicon = entities.Lexicon(frozenset({"vcb"}), frozenset({"nguyễn", "trần"}))
    got = entities.extract(question, domain, TODAY, lexicon)
    assert {k: got.get(k) for k in want} == want


def test_money(spark):
    for x, want in (("10 triệu", "10000000"), ("1,5 triệu", "1500000"), ("2 tỷ", "2000000000"), ("1.500", "1500"), ("x", "x")):
        assert one(spark, x, lambda c: entities.money(F.col(c))) == want


def test_bio_and_keys(spark):
    r = spark.sql("select array('số','123','4','ok') t, array('O','B-Số_tài_khoản','I-Số_tài_khoản','I-x') l").select(entities.bio_merge(F.col("t"), F.col("l")).alias("raw")).select(entities.canonical_keys(F.col("raw")).alias("m")).first()["m"]
    assert r == {"account_no": "123 4", "x": "ok"}


def test_long_questions_stay_whole(spark, tmp_path):
    from tamarind.sources import readers

    long = "a" * 1_000_100
    assert spark.createDataFrame([(long,)], "t string").select(F.length(T.normalize_question("t"))).first()[0] == len(long)
    (tmp_path / "q.md").write_text(f"- {long}\n")
    assert len(readers.questions_markdown(spark, str(tmp_path / "q.md")).first()["question"]) == len(long)


def test_stop_words_leave_repeats(spark):
    df = spark.createDataFrame([("a1 b1 a1 c1",)], "t string")
    got = df.select(T.tokenize("t", ["zz"]).alias("x"), T.tokenize("t").alias("y"), T.tokenize("t", ["b1"]).alias("z")).first()
    assert got["x"] == got["y"] and {"b1_a1", "a1_c1"} <= set(got["x"]) and "a1_a1" in got["z"]
