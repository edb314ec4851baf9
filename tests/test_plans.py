"""Dialect, guard, templates, repair, execution; knowledge base, sources, search on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tamarind.operators import generate, kb, route, search
from tamarind.plans import answer, dialect, execute, guard, quality, spec
from tamarind.plans.outline import outline
from tamarind.sources import readers


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "O'Brien", 5.0, "2026-01-02"), (2, "b", 7.0, "2026-01-03")], "id int, name string, amount double, day string").createOrReplaceTempView("txn")
    return spark


@pytest.mark.parametrize(
    ("sql", "part"),
    [
        ("SELECT strftime('%Y-%m', day) FROM \"txn\";", "date_format(day, 'yyyy-MM') FROM `txn`"),
        ("SELECT 'strftime(x)' FROM txn", "'strftime(x)'"),
        ("SELECT DATE_FORMAT(day, '%d/%m/%Y') FROM txn", "date_format(day, 'dd/MM/yyyy')"),
        ("SELECT TOTAL(amount), GROUP_CONCAT(name) FROM txn", "coalesce(sum(amount), 0D), array_join(collect_list(name), ',')"),
        ("SELECT * FROM txn WHERE day > DATE_SUB(CURDATE(), INTERVAL 7 DAY)", "(CURDATE() - INTERVAL 7 DAY)"),
        ("SELECT DATE_ADD(day, 1) FROM txn", "DATE_ADD(day, 1)"),
    ],
)
def test_dialect(views, sql, part):
    out = dialect.to_spark(sql)
    assert part in out
    views.sql(out)


@pytest.mark.parametrize(
    ("sql", "kind"),
    [("DROP TABLE txn", "security"), ("SELECT 1; SELECT 2", "security"), ("SELECT 1 -- x", "security"), ("SELEC", "syntax"), ("", "syntax"), ("SELECT nope FROM txn", "schema"), ("SELECT * FROM nope", "schema"), ("INSERT INTO txn VALUES (1)", "security"), ("SET x = 1", "security"), ("SELECT 'DROP; --' FROM txn", ""), ("SELECT count(*) FROM txn WHERE id IN (SELECT id FROM txn) LIMIT 1", "")],
)
def test_guard(views, sql, kind):
    v = guard.analyse(views, sql)
    assert v.kind == kind and v.ok == (kind == "")


def test_limit_is_told_by_the_plan(views):
    assert guard.check(views, "SELECT amount AS tx_limit FROM txn").limit is False
    assert guard.check(views, "SELECT * FROM txn LIMIT 3").limit is True


def test_values_are_never_sql(views):
    b = spec.bind("SELECT * FROM txn WHERE name LIKE '%{name}%' AND id >= {low}", {"name": "x' OR 1=1 --", "low": 0})
    assert not b.unfilled and execute.run(views, b.sql, b.args).rows == []
    assert len(execute.run(views, *_args(spec.bind("SELECT * FROM txn WHERE name = '{name}'", {"name": "O'Brien"}))).rows) == 1
    assert spec.bind("SELECT {a} {b}", {"a": 1}).unfilled == ["b"]


def _args(b):
    return b.sql, b.args


def test_templates_and_retry():
    assert spec.choose({"abc_x": "T"}, "abc") == "T" and spec.choose({}, "abc", "F") == "F"
    r = spec.Retry()
    assert r.may_repair("syntax") and not r.may_repair("syntax") and not r.may_repair("security")
    r.record("a", "b", "syntax")
    r.record("a", "b", "syntax")
    assert not r.may_regenerate("syntax")


def test_repair(views):
    s = spec.QuerySpec("tx", ["nam"], aggregates=[("SUM", "amount", "total")], order_by=[("total", True)])
    fixed = spec.repair(s, {"txn": ["id", "name", "amount", "day"]}, {"id": 1})
    assert [tuple(r) for r in fixed.run(views).collect()] == [("O'Brien", 5.0)]


def test_repair_from_sql(views):
    s = spec.from_sql(views, "SELECT nam FROM tx WHERE amout > 4 ORDER BY nam")
    fixed = spec.repair(s, {"txn": ["id", "name", "amount", "day"]}, {})
    assert [tuple(r) for r in fixed.run(views).collect()] == [(n,) for n, in views.sql("SELECT name FROM txn WHERE amount > 4 ORDER BY name").collect()]
    assert spec.from_sql(views, "SELECT a FROM x WHERE a = 1 OR b = 2") is None and spec.from_sql(views, "SELECT ( FROM") is None


def test_no_limit_where_none_is_asked(views):
    _, df = execute.prepare(views, "SELECT id FROM range(500)", None, None)
    assert df.count() == 500 and "Limit" not in df._jdf.queryExecution().toString()


def test_rows_for_the_driver_are_bounded(views, monkeypatch):
    monkeypatch.setattr(execute, "MOST_ROWS", 3)
    r = execute.run(views, "SELECT id FROM range(9) LIMIT 2000000000")
    assert len(r.rows) == 3 and r.more and not execute.run(views, "SELECT id FROM range(3) LIMIT 1000").more


def test_execution(views, tmp_path):
    assert len(execute.run(views, "SELECT id FROM range(500)").rows) == execute.DEFAULT_LIMIT
    assert execute.run(views, "SELECT assert_true(false)").status == "runtime"
    cache = execute.QueryCache(str(tmp_path / "c.json"))
    assert not cache.put("k", "SELECT 1", "FAIL") and cache.put("k", "SELECT 1", "PASS")
    assert execute.QueryCache(str(tmp_path / "c.json")).get("k")["sql"] == "SELECT 1"


def test_outline(spark):
    o = outline(spark, "SELECT nam, SUM(amount) AS total FROM tx WHERE id = 1 AND day >= '2026-01-01' GROUP BY nam HAVING SUM(amount) > 5 ORDER BY total DESC LIMIT 5")
    assert (o.tables, o.columns, o.where, o.group_by, o.aggregates[-1], o.order_by, o.limit) == (["tx"], ["nam"], [("id", "=", 1), ("day", ">=", "2026-01-01")], ["nam"], ("SUM", "amount", "total"), [("total", True)], 5)
    o = outline(spark, "SELECT * FROM a JOIN b ON a.x = b.y WHERE (x = 1 OR z LIKE 'p%') AND a.w IN (SELECT w FROM c)")
    assert o.star and o.tables[:2] == ["a", "b"] and set(o.filtered) >= {"x", "y", "z", "w"} and not o.where
    assert outline(spark, "SELECT FROM WHERE x y z") is None


def test_quality(spark):
    read = lambda sql: outline(spark, sql)
    assert quality.semantic_warnings("tổng hôm qua", read("SELECT * FROM t")) == ["SUM", "a time filter", "no SELECT *"]
    assert quality.semantic_warnings("anh Minh", read("SELECT 1")) == []
    assert quality.semantic_warnings("lương cao nhất", read("SELECT a FROM t ORDER BY b DESC LIMIT 1")) == [] and quality.semantic_warnings("lương cao nhất", read("SELECT a FROM t")) == ["MAX"]
    assert quality.semantic_warnings("foo", read("SELECT 1"), {"SUM": ("foo",)}) == ["SUM"]
    t, acc = {"t": ["a"]}, {"acc": ["a"]}
    assert quality.structure_score("", read("SELECT a FROM t WHERE a = 1"), {"acc": "1"}, t, acc) == (1.0, [])
    assert quality.structure_score("tổng", read("SELECT a FROM u"), {}, t, acc) == (0.4, ["unknown tables ['u']"])
    assert quality.structure_score("tổng", read("SELECT SUM(a) FROM t"), {"acc": "1"}, t, acc) == (0.65, ["no filter for the entities"])
    r = spark.sql("select true a, 1.0D s, 3L n").select(quality.confidence(F.col("a"), F.col("s"), F.col("a"), F.col("a"), F.col("n")).alias("c")).first()["c"]
    assert tuple(r) == (1.0, True)
    from datetime import date

    assert quality.explain_empty({"start_date": "2026-02-01", "end_date": "2026-01-01"}, set(), {}, date(2026, 1, 1))[0] == "DATA_ERROR"
    assert quality.explain_empty({"status": "ok"}, set(), {"status": ["OK"]}, date(2026, 1, 1))[0] == "PASS_EMPTY"


def test_answers():
    assert answer.extract_sql("<think>a</think>```sql\nSELECT 1;\nx```") == "SELECT 1"
    assert answer.extract_sql("I cannot do that") == "" and answer.extract_sql("Please give me a SELECT statement to mend") == "" and answer.extract_sql(None) == ""
    assert answer.explain(["a"], []) and "**1**" in answer.explain(["a"], [(1,)]) and "2" in answer.explain(["a"], [(1,), (2,)])
    assert "a: " in answer.context(["a"], [("x" * 60,)])


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "một", "expected_entities": {"a": "1"}}, "hai", " "]), "utf-8")
    assert [(r["id"], r["question"]) for r in readers.questions(spark, str(tmp_path / "q.json")).collect()] == [("q001", "một"), ("q002", "hai")]
    (tmp_path / "q.csv").write_text('question,expected_entities\n"a, b",bad\n ,\n', "utf-8")
    assert [(r["question"], r["expected_entities"]) for r in readers.questions(spark, str(tmp_path / "q.csv")).collect()] == [("a, b", None)]
    (tmp_path / "q.md").write_text("# x\n- một\n-hai\n", "utf-8")
    assert readers.questions(spark, str(tmp_path / "q.md")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.questions(spark, str(tmp_path / "none.csv"))
    (tmp_path / "q.txt").write_text("")
    with pytest.raises(ValueError):
        readers.questions(spark, str(tmp_path / "q.txt"))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbad\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect() == [(1,)]
    readers.save_template(spark, str(tmp_path / "t"), "x/y", "SELECT 1")
    assert [tuple(r) for r in readers.sql_files(spark, str(tmp_path / "t")).collect()] == [("x_y", "SELECT 1")]


def test_knowledge_base(spark, tmp_path):
    k = kb.KnowledgeBase(spark, str(tmp_path / "kb"))
    assert not k.exists()
    with pytest.raises(FileNotFoundError):
        k.table("documents")
    k.create()
    assert k.valid() and k.stats().first()["examples_per_document"] == 0
    k.insert(spark.createDataFrame([("A", '"ví dụ một" "ví dụ hai"'), ("B", None), (" ", "x")], "document string, examples string"))
    assert tuple(k.stats().first()) == (2, 2, 1.0)
    k.update(1, spark.createDataFrame([("A2", "- dòng đầu tiên")], "document string, examples string"))
    assert {r["document"] for r in k.table("documents").collect()} == {"A2", "B"} and k.table("examples").count() == 1
    k.delete(1)
    assert k.table("examples").count() == 0
    with pytest.raises(LookupError):
        k.delete(1)
    k.insert(spark.createDataFrame([("C",)], "document string"))
    assert {r["doc_id"] for r in k.table("documents").collect()} == {2, 3}
    (tmp_path / "kb" / "current-999999999.json.half").write_text("{")  # what a write that stopped leaves
    k.insert(spark.range(40).selectExpr("concat('D', id) AS document").repartition(7))
    assert sorted(r["doc_id"] for r in k.table("documents").collect()) == list(range(2, 44))
    assert len(list((tmp_path / "kb").glob("current-*.json"))) == 2
    k.delete_all()
    assert k.stats().first()["documents"] == 0
    k.drop()
    assert not k.exists()


def test_search_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, v array<float>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<float>")
    got = [tuple(r) for r in search.top_k_cosine(q, "id", "v", rows, "id", "v", 2).collect()]
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0)]
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None)], "d long, t array<string>")
    ask = spark.createDataFrame([(7, ["a", "zzz"]), (8, None)], "q long, t array<string>")
    got = search.bm25(ask, "q", "t", docs, "d", "t", 5).collect()
    assert {(r["question_id"], r["id"]) for r in got} == {(7, 1), (7, 2)}
    assert search.bm25(ask.where("q = 8"), "q", "t", docs, "d", "t").count() == 0
    dup = search.near_duplicates(ask, "q", docs, "d", "t")
    assert {(r["new_id"], r["n_links"]) for r in dup.collect()} == {(7, 0), (8, 0)}


def test_routing(spark):
    entries = [route.Entry("a", ["tai khoan"]), route.Entry("b", ["nghi phep"], [r"\bphep\b"])]
    df = spark.createDataFrame([("Nghỉ phép năm",), ("xyz",)], "q string").withColumn("r", route.ranked(F.col("q"), entries))
    got = df.select(F.col("r")[0]["name"], F.col("r")[0]["score"], route.shortlist(F.col("r"))).collect()
    assert tuple(got[0]) == ("b", 1.0, ["b"]) and tuple(got[1]) == ("a", 0.0, ["a", "b"])


def test_generation(spark):
    cols = spark.createDataFrame([("amount", ""), ("status", None), ("trans_date", ""), ("x", "Mã khách hàng")], "name string, description string")
    p = {r["name"]: r["role"] for r in generate.profile(cols).collect()}
    assert p == {"amount": "METRIC", "status": "DIMENSION", "trans_date": "TEMPORAL", "x": "IDENTITY"}
    made = generate.intents(generate.profile(cols), "t").collect()
    assert {"SUM", "GROUP_SUM", "COMPARE", "PERIOD"} <= {r["kind"] for r in made} and all("{{" not in r["sql"] for r in made)


def test_pipeline(views, tmp_path):
    from datetime import date

    from tamarind.pipeline import Domain, Pipeline

    bank = Domain(
        route.Entry("banking", ["tai khoan", "giao dich"]),
        [route.Entry("by_day", ["giao dich"])],
        {"by_day": "SELECT id, name FROM txn WHERE day >= '{start_date}' AND day <= '{end_date}' AND id <> {account_number}"},
        [route.Entry("txn", ["giao dich"])],
        {"txn": [("id", "int"), ("name", "string"), ("day", "string")]},
    )
    staff = Domain(route.Entry("hrm", ["cham cong"]), [route.Entry("att", ["cham cong"])], tables=[route.Entry("txn", ["cham cong"])])
    asked = []

    def generator(prompt):
        asked.append(prompt)
        return "SELECT nope FROM txn" if len(asked) == 1 else "```sql\nSELECT name FROM txn;\n```"

    p = Pipeline([bank, staff], date(2026, 3, 26), generator, execute.QueryCache(str(tmp_path / "cache.json")))
    q = "giao dịch của tài khoản 1234567890 trong tháng 1"
    first, again = p.answer(views, q), p.answer(views, q)
    assert first["validator"] == again["validator"] == "PASS" and first["rows"] == again["rows"] == 2 and not asked
    made = p.answer(views, "chấm công thế nào")
    assert made["validator"] == "PASS" and made["sql"] == "SELECT name FROM txn" and len(asked) == 2
    assert p.answer(views, "trời đẹp")["validator"] == "DOMAIN_AMBIGUOUS" and p.answer(views, "xin chào")["validator"] == "CHITCHAT"
    assert p.answer(views, "trời đẹp", forced="hrm")["domain"] == "hrm"
    plan = p.plan(views.createDataFrame([(q,), (None,), ("",)], "question string"))
    assert [r["domain"] for r in plan.collect()] == ["banking", None, None] and "Exchange" not in plan._jdf.queryExecution().toString()


def test_pipeline_repairs_checks_entities_and_learns(views, tmp_path):
    from datetime import date

    from tamarind.pipeline import Domain, Pipeline

    bank = Domain(
        route.Entry("banking", ["tai khoan"]),
        [route.Entry("ask", ["tai khoan"])],
        schema={"txn": [("id", "int"), ("name", "string"), ("amount", "double")]},
        entity_tables={"account_no": ("txn", "id")},
    )
    replies = iter(["SELECT nam FROM txm WHERE amount > 4", "SELECT name FROM txn WHERE id = 123456"])
    p = Pipeline([bank], date(2026, 3, 26), lambda prompt: next(replies), templates_folder=str(tmp_path / "t"))
    made = p.answer(views, "tài khoản nào")
    assert made["validator"] == "PASS" and made["rows"] == 2 and "`name`" in made["sql"]  # mended, not asked for again
    assert [r["template_id"] for r in readers.sql_files(views, str(tmp_path / "t")).collect()] == ["ask"]
    empty = p.answer(views, "tài khoản 123456")
    assert empty["validator"] == "DATA_ERROR" and "123456" in empty["data_validation"][0]


def test_hybrid_search(spark):
    q = spark.createDataFrame([(1, "mở tài khoản", [1.0, 0.0])], "question_id long, question string, vector array<float>")
    docs = spark.createDataFrame([(1, "Mở tài khoản", "tài khoản, mở"), (2, "Đóng thẻ", None), (3, None, None)], "doc_id long, document string, keyword string")
    ex = spark.createDataFrame([(10, 2, "tài khoản nào"), (11, 2, "đóng thẻ")], "example_id long, doc_id long, example_text string")
    vec = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "doc_id long, vector array<float>")
    ev = spark.createDataFrame([(10, 2, [0.6, 0.8]), (11, 2, [1.0, 0.0])], "example_id long, doc_id long, vector array<float>")
    got = search.hybrid_search(q, docs, ex, 5, vec, ev).collect()
    assert [r["doc_id"] for r in got] == [2, 1] and got[0]["best_matching_example"] == "đóng thẻ" and abs(got[0]["score_semantic"] - 1.0) < 1e-6
    assert [r["doc_id"] for r in search.hybrid_search(q.drop("vector"), docs, None, 5).collect()] == [1]


def test_corpus_learning(spark):
    from tamarind.operators import corpus

    df = spark.createDataFrame([("tài khoản mới",), ("tai khoan cũ",), ("tài khoản",), (None,), ("",)], "t string")
    assert {(r["stem"], tuple(r["variants"])) for r in corpus.stems(df, "t").collect()} == {("tài", ("tai", "tài")), ("khoản", ("khoan", "khoản"))}
    assert corpus.phrases(df, "t", 2, -10).first()["pair"] == "tài_khoản"
    assert corpus.stop_words(df.where("t <> ''"), "t", 0.6).count() == 1


def test_mock_tables(spark):
    from datetime import date

    from tamarind.sources import mock

    c, a, t = mock.customers(spark), mock.accounts(spark), mock.transactions(spark)
    assert (c.count(), a.count(), t.count()) == (8, 13, 200) and a.join(c, "customer_no", "left_anti").count() == 3
    assert t.where("trans_type = 'WITHDRAW' AND to_account_no <> ''").count() == 0 and t.where("trans_time < '2026-03-01' OR trans_time >= '2026-04-01'").count() == 0
    staff = mock.employees(spark)
    days = mock.attendance(spark, staff, date(2026, 1, 1), date(2026, 3, 24))
    assert days.where("weekday(attendance_date) >= 5 OR (status IN ('ABSENT', 'REMOTE') AND check_in_time IS NOT NULL)").count() == 0
    assert staff.join(mock.departments(spark), "department_id").count() == 50 and mock.leave_types(spark).count() == 5


def test_self_leave_trial_embed(spark):
    from datetime import date

    import numpy as np

    from tamarind.functions import entities as E

    df = spark.createDataFrame([("phép của tôi", {"a": "1"}), ("phép của EMP2", {"employee_id": "EMP2"}), ("toi", {})], "q string, m map<string,string>")
    got = [r[0] for r in df.select(E.with_self(F.col("m"), F.col("q"), "employee_id", "EMP1")).collect()]
    assert got == [{"a": "1", "employee_id": "EMP1"}, {"employee_id": "EMP2"}, {}]
    r = E.leave_request("Xin nghỉ phép năm từ 01/04/2026 đến 03/04/2026 vì việc nhà", date(2026, 3, 26))
    assert r == {"leave_type_id": "AL", "start_date": "2026-04-01", "end_date": "2026-04-03", "reason": "việc nhà"}
    assert not spec.trial("SELECT {start_date}, '{account_number}'").unfilled
    v = search.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: lambda xs: np.array([[len(x), 0.0] for x in xs])).collect()
    assert v[0]["vector"] == [1.0, 0.0] and v[1]["vector"] is None


def test_typos(spark):
    got = spark.createDataFrame([("abcdef",), ("a",), ("",)], "t string").select(generate.typo(F.col("t"))).collect()
    assert sorted(got[0][0]) == list("abcdef") and got[0][0] != "abcdef" and got[1][0] == "a" and got[2][0] == ""


def test_hybrid_topk_ranks_every_document(spark, tmp_path):
    from tamarind.queries import retrieval

    spark.createDataFrame([(100, "mở tài khoản")], "item_id long, text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    texts = [(1, "tài khoản"), (2, "nghỉ phép"), (3, "lương"), (4, None), (5, "đóng thẻ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (5, [-1.0, 0.0]), (9, [1.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["rank"], r["id"], r["score"]) for r in retrieval.hybrid_topk(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(1, 2, 0.7), (2, 1, 0.2), (3, 3, 0.0), (4, 4, 0.0), (5, 5, -0.7)]


def test_hybrid_search_scores_every_example(spark):
    q = spark.createDataFrame([(1, "xin", [1.0, 0.0])], "question_id long, question string, vector array<float>")
    docs = spark.createDataFrame([(1, "một"), (2, "hai"), (3, "ba")], "doc_id long, document string")
    near = [(i, 1, [1.0, 0.001 * i]) for i in range(60)]  # one document's examples fill the 50 nearest places
    ev = spark.createDataFrame([*near, (70, 2, [0.8, 0.6]), (71, 2, [0.8, 0.6]), (72, 3, None)], "example_id long, doc_id long, vector array<float>")
    vec = spark.createDataFrame([(d, [1.0, 0.0]) for d in range(100, 160)] + [(3, [0.6, 0.8])], "doc_id long, vector array<float>")
    ex = ev.selectExpr("example_id", "doc_id", "cast(example_id as string) AS example_text")
    got = [(r["doc_id"], round(r["score_semantic"], 6), r["best_matching_example"]) for r in search.hybrid_search(q, docs, ex, 5, vec, ev).orderBy("rank").collect()]
    assert got == [(1, 0.7, "0"), (2, 0.56, "70"), (3, 0.18, None)]


def test_best_cosine_by_group_gives_out_early(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 200)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "q long, v array<float>")
    rows = spark.createDataFrame([(i % 40, i, [float(i % 7), 1.0]) for i in range(2000)], "g long, i long, v array<float>").coalesce(1)
    whole = sorted(map(tuple, search.best_cosine_by_group(q, "q", "v", rows, "g", "i", "v").collect()))
    want = sorted(map(tuple, search.max_dot_by_group(q, "q", "v", rows.selectExpr("g", "transform(v, x -> cast(x / sqrt(v[0] * v[0] + 1) as float)) AS v"), "g", "v", 5).collect()))
    assert len(whole) == 80 and [(q, g, round(s, 5)) for q, g, s, _ in whole] == want
    assert all(i == min(j for j in range(2000) if j % 40 == g and j % 7 == i % 7) for _, g, _, i in whole)
