"""Intervals, drift, shredding and orphans against brute force and on the edges."""

import json
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest

from tamarind.operators import drift, intervals, orphans, shred


def day(n):
    return date(2025, 1, 1) + timedelta(n)


def brute_periods(rows):
    covered = defaultdict(set)
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and s <= t:
            covered[e] |= {s + timedelta(i) for i in range((t - s).days + 1)}
    out = set()
    for e, days in covered.items():
        runs, ordered = [], sorted(days)
        for d in ordered:
            if runs and d == runs[-1][1] + timedelta(1):
                runs[-1][1] = d
            else:
                runs.append([d, d])
        out |= {(e, "period", a, b) for a, b in runs}
        out |= {(e, "gap", a[1] + timedelta(1), b[0] - timedelta(1)) for a, b in zip(runs, runs[1:])}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periods_equal_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", "hot", "hot", "hot", None]), None if r.random() < 0.05 else day(r.randrange(300)), None) for _ in range(400)]
    rows = [(e, s, None if s is None or r.random() < 0.05 else s + timedelta(r.randrange(-2, 9))) for e, s, _ in rows]
    rows += rows[:50]  # redelivered
    df = spark.createDataFrame(rows, "who string, s date, e date").repartition(5)
    got = {tuple(x) for x in intervals.periods_and_gaps(df, "who", "s", "e").collect()}
    assert got == brute_periods(rows)


def test_periods_edges(spark):
    df = spark.createDataFrame([], "k string, s date, e date, _salt int")
    assert intervals.periods_and_gaps(df, "k", "s", "e").count() == 0
    one = spark.createDataFrame([("x", date(1, 1, 1), date(9999, 12, 31), 5)], "k string, s date, e date, _salt int")
    assert intervals.periods(one, "k", "s", "e").collect()[0][1:] == (date(1, 1, 1), date(9999, 12, 31))


def batch(spark, files):
    rows = [(src, f, i, line) for (src, f), lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "runner string, file string, n long, raw string, path string, schema string" if False else "runner string, file string, n long, raw string")


def changed(spark, *files):
    df = batch(spark, {("r", f"f{i}"): [x if isinstance(x, (str, type(None))) else json.dumps(x) for x in f] for i, f in enumerate(files)})
    return sorted((r["file"], r["change_kind"], r["field_path"], r["new_path"]) for r in drift.changes(df, "runner", "file", "raw").collect())


def test_drift_kinds(spark):
    assert changed(spark, [{"a": 1, "b": {"c": 1}}, "broken{", None, "", "[1]"], [{"a": "x", "d": True, "e": None}]) == [("f1", "added", "d", ""), ("f1", "added", "e", ""), ("f1", "removed", "b", ""), ("f1", "retyped", "a", "")]
    assert changed(spark, [{"t": {"hit": 1}, "q": "x"}], [{"t": {"cache": 2}, "q": "y"}]) == [("f1", "renamed", "t.hit", "t.cache")]
    assert changed(spark, [{"o": {"x": 1, "y": 2}}], [{"p": {"x": 1}}]) == [("f1", "renamed", "o", "p")]
    # Two fields of one type go: none of them is renamed.
    assert changed(spark, [{"x": 1, "y": 2}], [{"z": 3}]) == [("f1", "added", "z", ""), ("f1", "removed", "x", ""), ("f1", "removed", "y", "")]
    # A map whose keys are data has no inner fields; an unreadable file is passed over.
    assert changed(spark, [{"entities": {"a": 1}}], ["nope"], [{"entities": {"b": 1}}]) == []
    assert changed(spark, [{"r": 1}], [{"r": {"value": 1, "unit": "s"}}]) == [("f1", "retyped", "r", "")]


def test_flooding_prefers_the_same_place():
    old = {"timing": "object", "timing.cache_hit": "number", "conf": "object", "conf.value": "number"}
    new = {"timing": "object", "timing.cacheHit": "number", "conf": "object", "conf.level": "number"}
    assert {(p, q) for p, q, *_ in drift.correspondences(old, new)} == {("timing.cache_hit", "timing.cacheHit"), ("conf.value", "conf.level")}


def test_unified_table(spark):
    files = {}
    for r in ("a", "b", "c"):
        files[(r, "1")] = [json.dumps({"score": 1.5, "name": "x"})]
        files[(r, "2")] = [json.dumps({"points": {"value": 2.5, "unit": "s"}, "name": None}), "bad"]
        files[(r, "3")] = [json.dumps({"points": 3.5, "name": ["y"]})]
    files[("a", "4")] = [json.dumps({"rating": 4.5, "name": "z"})]
    files[("b", "4")] = [json.dumps({"rating": 4.5, "name": "z"})]
    rows = drift.unify(batch(spark, files), "runner", "file", "n", "raw").collect()
    assert len(rows) == 11
    got = {(r["source"], r["file"]): r.asDict() for r in rows}
    assert got[("a", "4")]["name"] == "z" and got[("b", "3")]["name"] == "y" and got[("c", "2")]["name"] is None
    assert sum(v for k, v in got[("a", "4")].items() if isinstance(v, float)) == 4.5


def test_one_exact_rename_joins_columns(spark):
    files = {("r", f): [json.dumps({k: v, "k": 1})] for f, k, v in (("1", "error", "x"), ("2", "err", "y"), ("3", "err", "z"))}
    rows = drift.unify(batch(spark, files), "runner", "file", "n", "raw").collect()
    assert "error" not in rows[0].asDict() and sorted(r["err"] for r in rows) == ["x", "y", "z"]


def test_support_counts_both_directions(spark):
    # Two strings go and two come each time: no exact rename, but the same correspondences forth and back.
    old, new = {"sql_text": "s", "user_name": "u", "k": 1}, {"sqlText": "s", "userName": "u", "k": 1}
    rows = drift.unify(batch(spark, {("r", str(i)): [json.dumps(x)] for i, x in enumerate((old, new, old))}), "runner", "file", "n", "raw").collect()
    assert all(r["sql_text"] == "s" and r["user_name"] == "u" for r in rows) and "sqlText" not in rows[0].asDict()


def test_names_that_occur_together_never_share_a_column_by_a_chain(spark):
    one = [("a",), ("b",), ("c",)]  # a -> b -> c are exact renames; in another source a and c occur in one record
    files = {("r", str(i)): [json.dumps({k: f"{k}{i}" for k in ks})] for i, ks in enumerate(one)} | {("s", "0"): [json.dumps({"a": "left", "c": "right"})]}
    rows = drift.unify(batch(spark, files), "runner", "file", "n", "raw").collect()
    values = [v for r in rows for k, v in r.asDict().items() if k not in ("source", "file", "line") and v is not None]
    assert sorted(values) == ["a0", "b1", "c2", "left", "right"]


def test_booleans_in_columns_of_numbers(spark):
    records = [{"hit": 1.5, "ok": True}, {"hit": 2, "ok": True}, {"hit": True, "ok": False}, {"hit": {"value": False}, "ok": None}, {"hit": "soon"}, {"hit": None, "ok": {"a": 1}}]
    df = batch(spark, {("r", str(i)): [json.dumps(x)] for i, x in enumerate(records)})
    assert [r["hit"] for r in drift.unify(df, "runner", "file", "n", "raw").orderBy("file").collect()] == [1.5, 2.0, 1.0, 0.0, None, None]
    assert sorted(map(tuple, drift.uncast(df, "runner", "file", "n", "raw").collect())) == [("hit", 5, 1), ("ok", 4, 1)]


def test_previous_in_a_hot_group(spark):
    from tamarind.plans.neighbours import with_previous

    rows = [("hot", i, f"v{i}") for i in range(500)] + [("cold", i, "x") for i in range(3)]
    random.Random(1).shuffle(rows)
    got = with_previous(spark.createDataFrame(rows, "g string, o int, v string"), "g", "o", ["v"]).collect()
    assert len(got) == 503
    for r in got:
        assert (r["prev_o"], r["prev_v"]) == ((None, None) if r["o"] == 0 else (r["o"] - 1, f"v{r['o'] - 1}" if r["g"] == "hot" else "x"))


def brute_shred(rows):
    out = set()
    for rid, text in rows:
        try:
            o = json.loads(text)
        except (TypeError, ValueError):
            continue
        d = o.get("domain_routing") if isinstance(o, dict) else None
        if isinstance(d, str):
            try:
                d = json.loads(d)
            except ValueError:
                continue
        if not isinstance(d, dict):
            continue
        for name in ("ranked_domains", "arbitration_scores"):
            v = d.get(name)
            for i, e in enumerate(v if isinstance(v, list) else [v]):
                if not isinstance(e, dict):
                    continue
                i_d = e.get("domain_id")
                out.add((rid, name, i, -1, "" if i_d is None else i_d))
                k = e.get("matched_keywords")
                for j, w in enumerate(k if isinstance(k, list) else [k]):
                    if name == "ranked_domains" and isinstance(w, str):
                        out.add((rid, "matched_keywords", i, j, w))
    return out


def test_shredding_equals_walking(spark):
    import duckdb

    from tamarind.queries.data import p6_found

    rows = duckdb.sql("select record_id, record from '/root/testdata/sf0.01/query_record.parquet'").fetchall()
    got = [tuple(r) for r in p6_found(spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_shred(rows)


def test_shredding_edges(spark):
    rows = [(1, '{"a": [[{"x": 1}], null, {"x": "' + "y" * 100_000 + '"}]}'), (2, "[]"), (3, None), (4, '{"a": {"x": null}}'), (4, '{"a": {"x": null}}'), (None, '{"a": 1}')]
    df = spark.createDataFrame(rows, "rec long, node string")
    flat = shred.nodes(df, "rec", "node", lists={"a"})
    got = {(r["rec"], r["pos"], r["x"] and len(r["x"])) for r in shred.entities(flat, ["a"], ["x"]).collect()}
    assert got == {("1", 0, 1), ("1", 2, 100_000), ("4", 0, None)}
    assert shred.entities(shred.nodes(df.limit(0), "rec", "node"), ["a"], ["x"]).count() == 0


def t(n):
    return datetime(2026, 1, 1) + timedelta(hours=n)


def test_orphans_are_the_same_in_any_slicing(spark):
    r = random.Random(5)
    parents = [(f"K{i}", t(r.randrange(100)), t(r.randrange(100)) if r.random() < 0.3 else None) for i in range(30)]
    kids = [(i, r.choice(["K1", " k1 ", *[f"K{r.randrange(40)}" for _ in range(5)], "", None]), date(2026, 1 + r.randrange(3), 1), t(r.randrange(100))) for i in range(400)]
    kids += kids[:20]
    # Later rows of the same parents: some bring a deletion that took place before earlier children loaded.
    parents += [(f" k{r.randrange(30)}", t(r.randrange(100)), t(r.randrange(100)) if r.random() < 0.5 else None) for _ in range(25)]
    index = {}
    for k, a, d in parents:
        x, y = index.get(k.strip().lower(), (a, d))
        index[k.strip().lower()] = (min(x, a), min((z for z in (y, d) if z), default=None))
    want = set()
    for i, k, d, at in kids:
        if k and k.strip():
            p = index.get(k.strip().lower())
            why = "missing" if p is None else "deleted" if p[1] and p[1] <= at else "late" if p[0] > at else None
            if why:
                want.add((str(i), d.strftime("%Y-%m"), why))
    refs = orphans.references(spark.createDataFrame(kids, "id long, key string, d date, loaded timestamp"), "t", "id", "key", "d", "loaded")
    pars = orphans.parents(spark.createDataFrame(parents, "key string, loaded timestamp, gone timestamp"), "t", "key", "loaded", "gone")
    for slices in (1, 3, 7):
        got = {tuple(x) for x in orphans.orphans(orphans.track(refs, pars, slices)).select("child_id", "period", "why").collect()}
        assert got == want
    empty = orphans.track(refs.limit(0), pars.limit(0))
    assert orphans.orphans(empty).count() == 0 and orphans.snapshot(empty).count() == 0


def test_orphans_without_load_times(spark):
    pars = [("a", None, None), ("b", t(5), None), ("c", None, t(3)), ("d", None, None), ("d", t(8), None)]
    kids = [(1, "a", t(1)), (2, "a", t(9)), (3, "x", None), (4, "b", None), (5, "c", t(2)), (6, "c", t(4)), (7, "d", t(1)), (8, "b", t(9)), (9, "a", None)]
    kids = [(i, k, date(2026, 1, 1), at) for i, k, at in kids]
    refs = orphans.references(spark.createDataFrame(kids, "id long, key string, d date, loaded timestamp"), "t", "id", "key", "d", "loaded")
    par = orphans.parents(spark.createDataFrame(pars, "key string, loaded timestamp, gone timestamp"), "t", "key", "loaded", "gone")
    for slices in (1, 3):
        state = orphans.track(refs, par, slices)
        assert sorted((r["child_id"], r["why"]) for r in orphans.orphans(state).collect()) == [("3", "missing"), ("6", "deleted"), ("7", "late")]
        assert [r["n"] for r in orphans.reopened(state).collect()] == [1]


def test_orphans_in_a_stream(spark, tmp_path):
    from tamarind.streaming.orphans import OrphanStream

    schema = "kind string, relation string, child_id string, key string, period string, child_loaded timestamp, parent_loaded timestamp, deleted_at timestamp"
    first = [("ref", "t", "1", "a", "2026-01", t(1), None, None), ("ref", "t", "2", "b", "2026-01", t(1), None, None)]
    second = [("parent", "t", None, "a", None, None, t(5), None)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            import time

            time.sleep(1.1)
    run = lambda: OrphanStream(spark, str(tmp_path / "state")).start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    now = lambda: {(r["child_id"], r["why"]) for r in orphans.orphans(OrphanStream(spark, str(tmp_path / "state")).state()).collect()}
    run()
    assert now() == {("1", "late"), ("2", "missing")}
    # A restart with a new object goes on: a deletion reopens an old reference, a new one finds its parent.
    third = [("parent", "t", None, "a", None, None, t(9), t(0)), ("ref", "t", "3", "b", "2026-01", t(7), None, None)]
    spark.createDataFrame(third, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert now() == {("1", "deleted"), ("2", "missing"), ("3", "missing")}
    # A batch that is retried, or one that stopped half-way, counts once.
    s = OrphanStream(spark, str(tmp_path / "state"))
    s.step(spark.createDataFrame(third, schema), s.epochs()[-1])
    before = {r["n"] for r in orphans.snapshot(s.state()).where("why = 'missing'").collect()}
    (tmp_path / "state" / "epoch-000000000003-index").mkdir()
    (tmp_path / "state" / "manifest-000000000003.json.half").write_text("{")
    s.COMPACT = 1
    fourth = [("parent", "t", None, "b", None, None, t(8), None)]
    s.step(spark.createDataFrame(fourth, schema), s.epochs()[-1] + 1)
    s.step(spark.createDataFrame([("ref", "t", "4", "b", "2026-02", t(9), None, None)], schema), s.epochs()[-1] + 1)
    assert before == {2} and now() == {("1", "deleted"), ("2", "late"), ("3", "late")} and len(s.epochs()) == 2


def test_skewed_join_keeps_all_rows(spark):
    from pyspark.sql import functions as F

    from tamarind.plans.skew import once, skew_join

    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    got = skew_join(left, right, ["k"])
    assert got.count() == 5000 and got.where("v = 1").count() == 2500 and got.where("v = 3").count() == 0
    with pytest.raises(ValueError):
        skew_join(left.withColumn("v", F.lit(1)), right, ["k"])
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a")], "k int, c string")
    assert once(twice, ["k"], ["c"]).count() == 3


def test_deep_brackets_give_nothing(spark):
    deep = json.dumps({"domain_routing": "[" * 200_000})
    df = spark.createDataFrame([(1, deep), (2, "[" * 200_000), (3, json.dumps({"domain_routing": {"a": 1}}))], "id long, r string")
    got = shred.nodes(df, "id", "r", ["domain_routing"], packed={"domain_routing"}).where("label IS NOT NULL").collect()
    assert [(r["rec"], r["label"]) for r in got] == [("3", "domain_routing"), ("3", "a")]


#: Five renames of one type in one file: only scores can tell which is which.
BEFORE = {"error_msg": "e", "user_name": "u", "sql_text": "s", "log_path": "l", "timing": {"start_at": "x", "n": 1}}
AFTER = {"errorMessage": "e", "userName": "u", "sqlTextRaw": "s", "logFilePath": "l", "timing": {"startedAt": "x", "n": 1}}
SAME = {"error_msg": "errorMessage", "user_name": "userName", "sql_text": "sqlTextRaw", "log_path": "logFilePath", "timing.start_at": "timing.startedAt"}


def test_flooding_chooses_among_renames_of_one_type(monkeypatch):
    import numpy as np

    types = lambda o: {k: drift.json_type(v) for k, v in [*o.items(), *((f"timing.{k}", v) for k, v in o["timing"].items())]}
    chosen = lambda: {p: q for p, q, *_ in drift.correspondences(types(BEFORE), types(AFTER))}
    assert chosen() == SAME
    real, rng = drift.flood, np.random.default_rng(1)
    monkeypatch.setattr(drift, "flood", lambda old, new: (*real(old, new)[:2], rng.random((len(old), len(new)))))
    assert sum(chosen() == SAME for _ in range(20)) <= 3


def test_unified_table_joins_renames_of_one_type(spark):
    files = {(f"r{i}", f"f{k}"): [json.dumps(o)] for i in range(3) for k, o in enumerate((BEFORE, AFTER, BEFORE))}
    rows = drift.unify(batch(spark, files), "runner", "file", "n", "raw").collect()
    columns = [c for c in rows[0].__fields__ if c not in ("source", "file", "line")]
    assert len(columns) == 6 and len(rows) == 9
    by = {c.replace("__", "."): {r[c] for r in rows} for c in columns}
    for old, new in SAME.items():
        whole = by.get(old) or by[new]
        assert whole == {"x" if "start" in old else old[0]}, (old, whole)
