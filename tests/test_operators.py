"""Datasets, gauges, checks, text and files on small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from calibrium.functions import text as X
from calibrium.functions import vectors as V
from calibrium.operators import checks as I
from calibrium.operators import dataset as D
from calibrium.operators import gauges as G
from calibrium.operators import guards as K
from calibrium.sources import files as S


def test_allocation():
    assert D.allocate({"a": 240, "b": 882}, 334, 10) == {"a": 71, "b": 263}
    assert D.allocate({"a": 400, "b": 200, "c": 258, "d": 1052}, 333, 10) == {"a": 70, "b": 35, "c": 45, "d": 183}
    assert D.allocate({"a": 200, "b": 200, "c": 16, "d": 24}, 333, 10) == {"a": 152, "b": 151, "c": 12, "d": 18}
    r = random.Random(0)
    for _ in range(200):
        valid = {f"f{i}": r.randrange(0, 60) for i in range(r.randrange(1, 7))}
        total = sum(valid.values())
        target = r.randrange(0, total + 1)
        got = D.allocate(valid, target, 5)
        assert sum(got.values()) == target and all(got[f] <= valid[f] for f in got)
    with pytest.raises(ValueError):
        D.allocate({"a": 3}, 4, 1)


def test_emissions(spark):
    cases = [
        ('{"decision": "none", "confidence": 0.5}', True, "no-call", 0.5),
        ('Sure: {"decision": "several", "confidence": 1, "x": 2} ok', True, "multi-call", 1.0),
        ("no json", False, None, None), ('{"decision": "two", "confidence": 0.5}', False, None, None), ('{"decision": "one", "confidence": true}', False, None, None),
        ('{"decision": "one", "confidence": "0.5"}', False, None, None), ('{"decision": "one", "confidence": 1.2}', False, None, None), ('{"decision": "one", "confidence": 0.', False, None, None),
        (None, False, None, None), ('{"decision": 1, "confidence": 0.5}', False, None, None), ("[{}]", False, None, None),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = {r.k: r for r in rows.select("k", X.parsed_emission(F.col("t")).alias("x")).select("k", "x.*").collect()}
    assert all((got[k].parse_ok, got[k].decision, got[k].confidence) == c[1:] for k, c in enumerate(cases))
    failed = G.emissions(spark.createDataFrame([("x", 0)], "raw string, y int")).first()
    assert failed.decision == -1 and failed.p == [0.0, 0.0, 0.0]


def test_nested_json(spark):
    bodies = ['[[{"role": "user", "content": "a"}, {"role": "system", "content": "b"}, {"role": "user", "content": [{"text": "c"}, "d"]}], [{"role": "user", "content": "later"}]]', '[{"role": "user", "content": {"content": "one"}}]', "[]", '[[{"role": "user", "content": " "}]]']
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string")
    assert [r[0] for r in rows.orderBy("k").select(D.request_text(F.parse_json("b"))).collect()] == ["a\nc\nd", "one", "", ""]
    truths = spark.createDataFrame([(0, "[1, 2]"), (1, '{"a": 1}'), (2, "3"), (3, None)], "k int, b string")
    assert [r[0] for r in truths.orderBy("k").select(D.call_count(F.parse_json("b"))).collect()] == [2, 1, None, None]
    one = spark.createDataFrame([('{"name": "f", "parameters": {"properties": {"x": 1, "y": 2}}}',)], "b string")
    f = one.select(D.function_list(F.parse_json("b")).alias("f")).first().f
    assert [(x.name, x.description, x.params) for x in f] == [("f", None, ["x", "y"])]


def test_drop_reasons(spark):
    items = spark.createDataFrame([("a", 0, "one-call", "x"), ("a", 1, "one-call", "x"), ("b", 2, "one-call", "x"), ("c", 3, "multi-call", "x"), ("d", 4, "no-call", " "), ("e", 5, "multi-call", "x")], "id string, ord int, label string, request string")
    truth = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("c", 2, 1), ("e", 3, 2)], "id string, ord int, calls int")
    got = {(r.id, r.ord): r.drop_reason for r in D.with_drop_reason(items, truth).collect()}
    assert got == {("a", 0): None, ("a", 1): "duplicate_id", ("b", 2): "no_ground_truth", ("c", 3): "contradicts_category", ("d", 4): "empty_request", ("e", 5): None}


def test_file_substitution(spark):
    want = spark.createDataFrame([("B_v3_simple.json",), ("B_v3_multiple.json",), ("B_v3_gone.json",)], "name string")
    have = spark.createDataFrame([("B_v3_simple.json",), ("B_v2_multiple.json",), ("B_v4_multiple.json",), ("B_v3_exec_simple.json",)], "name string")
    got = {r.expected: (r.found, r.substituted) for r in D.resolve_files(want, have).collect()}
    assert got == {"B_v3_simple.json": ("B_v3_simple.json", False), "B_v3_multiple.json": ("B_v2_multiple.json", True), "B_v3_gone.json": (None, None)}


def test_outside_answers(spark):
    rows = spark.createDataFrame([("choice", "a", {"a": 0.5, "b": 0.5}), ("choice", "a", {"a": 0.5, "z": 0.5}), ("choice", "z", None), ("choice", "b", None), ("text", "a", None), ("choice", "a", {"a": 0.0}), ("choice", "a", {"a": 2.0})], "kind string, choice string, p map<string,double>")
    assert [r[0] for r in rows.select(G.valid_answer(F.col("kind"), F.col("choice"), F.col("p"), ["a", "b", "c"])).collect()] == [True, False, False, True, False, False, False]
    m = rows.limit(1).select(*[c.alias(n) for n, c in G.mapped_answer(F.col("choice"), F.col("p"), ["a", "b", "c"]).items()]).first()
    assert m.p == [0.5, 0.5, 0.0] and m.raw_sum == 1.0 and m.missing_keys == ["c"]


def test_as_of_and_streaks(spark):
    events = spark.createDataFrame([("u", 5, 1), ("u", 10, 2), ("u", 11, 3), ("v", 1, 4)], "k string, t int, e int")
    versions = spark.createDataFrame([("u", 5, "a"), ("u", 10, "b"), ("w", 0, "c")], "k string, t int, v string")
    assert {(r.e, r.in_force) for r in I.in_force(events, versions, ["k"], "t", "t", "v").collect()} == {(1, None), (2, "a"), (3, "b"), (4, None)}
    rows = spark.createDataFrame([("u", i, x) for i, x in enumerate([1, 1, 0, 1, 1, 1])], "k string, o int, bad int")
    assert {(r.first, r.last, r.length) for r in I.failure_streaks(rows, ["k"], "o", F.col("bad") == 1).collect()} == {(0, 1, 2), (3, 5, 3)}


def test_text(spark):
    row = spark.createDataFrame([("Send 10 mails to Ada Lovelace, now", "key-abcdef123456 and sk_live_99999999 monkey-business", "7 of 1,000 or 0.70 and 1e-5 100%")], "a string, s string, n string")
    first, second = X.halves(F.col("a"))
    got = row.select(X.twin("a").alias("twin"), first.alias("h"), second.alias("t"), X.redact(F.col("s"), ["and"]).alias("r"), F.transform(X.number_tokens(F.col("n")), X.canonical_number).alias("n"), X.shared_prefix(F.split(F.lit("a b c"), " "), F.split(F.lit("a b d e"), " ")).alias("p")).first()
    assert got.twin == "Send 21 mails to Ostra Velmo, now" and (got.h, got.t) == ("Send 10 mails", "to Ada Lovelace, now")
    assert got.r == "[redacted] [redacted] [redacted] monkey-business" and got.n == ["7", "1000", "0.7", "0.00001", "100"] and got.p == 2


def test_files_keep_order(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(200)]
    S.write_jsonl(spark.createDataFrame(rows, "i int, t string"), f"{tmp_path}/a", ["i"])
    with pytest.raises(Exception):
        S.write_jsonl(spark.createDataFrame(rows, "i int, t string"), f"{tmp_path}/a", ["i"])
    back = S.read_jsonl(spark, f"{tmp_path}/a").orderBy("file", "ord").select(F.variant_get("body", "$.i", "int")).collect()
    assert [r[0] for r in back] == list(range(200))
    (tmp_path / "r.jsonl").write_text('{"kind": "item"}\n{"kind": "header"}\n')
    with pytest.raises(ValueError):
        S.read_run(S.read_jsonl(spark, f"{tmp_path}/r.jsonl"))
    with pytest.raises(ValueError):
        S.result_named(spark, "x", "../y")
    (tmp_path / "rev").mkdir()
    for n in "ab":
        (tmp_path / "rev" / n).write_text("0" * 40 + "\nx\n")
    assert S.revision(spark, f"{tmp_path}/rev").first().revision == "0" * 40


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("one-call",), ("else",)], "label string")
    assert df.where("label = 'one-call'").select(V.label_index(F.col("label"))).first()[0] == 1
    with pytest.raises(Exception):
        df.select(V.label_index(F.col("label"))).collect()


def test_fingerprints(spark):
    assert I.python_fingerprint([]) == "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"
    rows = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 2.0)], "g string, id string, x double")
    a = I.fingerprint(rows, ["g"], "id", ["x"]).first().sha256
    assert a == I.fingerprint(rows.orderBy("id"), ["g"], "id", ["x"]).first().sha256
    assert a != I.fingerprint(rows.withColumn("x", F.col("x") + 0.001), ["g"], "id", ["x"]).first().sha256


def test_guards(spark, tmp_path):
    import numpy as np

    from calibrium.operators import guards as K

    records = spark.createDataFrame([("a", 0.95, 1.0, [0.5] * 3), ("b", 0.9, 1.0, [0.5] * 3), ("c", 0.95, 0.0, [0.5] * 3), ("d", 0.95, 1.0, [0.5, float("nan"), 0.5])], "gauge string, sa_target double, T double, taus array<double>")
    gauges = spark.createDataFrame([(x,) for x in "abcde"], "gauge string")
    assert {(r.gauge, r.fault) for r in K.calibration_faults(records, gauges, 0.95).collect()} == {("b", "other target"), ("c", "temperature"), ("d", "thresholds"), ("e", "no record")}
    texts = spark.createDataFrame([("<think>\n</think>x",), ("<think>a</think>",), ("<think>",), ("</think><think>",), ("plain",), (None,)], "t string")
    assert [r[0] for r in texts.select(K.blank_think_blocks(F.col("t"))).collect()] == [True, False, False, False, True, False]
    assert texts.limit(1).select(K.rendered("{a}-{b}", a=F.lit("x"), b=F.lit(None).cast("string"))).first()[0] == "x-"
    assert K.canonical_sha256({"b": 1, "a": 2}) == K.canonical_sha256({"a": 2, "b": 1})
    np.save(tmp_path / "f.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    rows = S.read_features(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.features for r in rows] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]] and len({r.sha256 for r in rows}) == 1
    S.append_ledger(spark.createDataFrame([(1, "x", 0, 500, "bad key-abcdefgh12345", 0.1, "t")], S.LEDGER), f"{tmp_path}/ledger", [])
    assert S.read_ledger(spark, f"{tmp_path}/ledger").first().error == "bad [redacted]"


def test_tool_blocks_against_the_loop(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "to", "get-it", "number", "x"])
    entries = lambda: [(word(), " ".join(word() for _ in range(rng.randrange(0, 25))) or None, [word() for _ in range(rng.randrange(0, 3))]) for _ in range(rng.randrange(0, 5))]
    rows = [(i, entries(), rng.randrange(0, 60)) for i in range(120)] + [(1000, None, 5)]

    def by_loop(found, cap):
        held = [[n, d or "", "", p] for n, d, p in found or []]
        while held:
            text = "\n".join(f"{n}: {d}{m} ({', '.join(p)})" for n, d, m, p in held)
            if len(text.split()) <= cap:
                return text
            at = max(range(len(held)), key=lambda i: len(held[i][1]))
            size = max(24, int(len(held[at][1]) * 0.7))
            if size < len(held[at][1]):
                held[at][1:3] = held[at][1][:size], "…"
            else:
                held.pop()
        return ""

    df = spark.createDataFrame(rows, "id int, f array<struct<name:string,description:string,params:array<string>>>, cap int")
    got = {r.id: r.block for r in df.select("id", X.trimmed_tools("f", F.col("cap")).alias("block")).collect()}
    assert got == {i: by_loop(f, c) for i, f, c in rows}


def test_templates_and_positional_numbers(spark):
    row = spark.range(1).select(
        K.rendered("{a} and {b}, {c}", a=F.lit("{b}"), b=F.lit("{a}")).alias("t"),
        F.array(*[X.positional(F.lit(x)) for x in ("3.0517578125E-5", "-1.5e3", "12E-1", "7", "-0.5", "1.0E10", "125E-2")]).alias("n"),
    ).first()
    assert row.t == "{b} and {a}, {c}"
    assert row.n == ["0.000030517578125", "-1500", "1.2", "7", "-0.5", "10000000000", "1.25"]


def test_an_emission_is_parsed_once_however_many_fields_are_read(spark):
    x = spark.createDataFrame([(1, "{}")], "k int, t string").select("k", X.parsed_emission(F.col("t")).alias("x")).select("k", "x.*")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_gates_of_all_groups_from_one_pass(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b"]), rng.randrange(-1, 3), rng.randrange(0, 3), round(rng.random(), 2)) for _ in range(400)]
    e = spark.createDataFrame(rows, "g string, decision int, y int, confidence double").withColumn("seen", F.raise_error(F.lit("unread")).cast("int"))
    gates = G.emission_gates(e, ["g"], [0.3, 0.95])
    assert set(gates) == {((g,), t) for g in "ab" for t in (0.3, 0.95)}
    for ((g,), target), found in gates.items():
        assert found == G.emission_gate(e.where(F.col("g") == g), 3, target)
    assert G.emission_gate(e.limit(0))["mode"] == "fallback"


def test_blocks_of_many_tools_are_cut_in_few_steps(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "to", "", "get-it-done", "number", " ", "x\u2003y"])
    entries = lambda n: [(word(), " ".join(word() for _ in range(rng.randrange(0, 12))), [word() for _ in range(rng.randrange(0, 3))]) for _ in range(n)]
    rows = [(i, entries(rng.randrange(0, 14)), rng.randrange(0, 24)) for i in range(150)] + [(200, entries(200), 40)]
    rows.append((201, rows[-1][1] + entries(20_000), 40))

    def by_loop(found, cap):
        held = [[n, d, "", p] for n, d, p in found]
        while held:
            lines = [re.findall(r"[^\x20\x09-\x0D]+", f"{n}: {d}{m} ({', '.join(p)})") for n, d, m, p in held]
            if sum(map(len, lines)) <= cap:
                return "\n".join(f"{n}: {d}{m} ({', '.join(p)})" for n, d, m, p in held)
            at = max(range(len(held)), key=lambda i: len(held[i][1]))
            size = max(24, int(len(held[at][1]) * 0.7))
            if size < len(held[at][1]):
                held[at][1:3] = held[at][1][:size], "…"
            else:
                held.pop()
        return ""

    df = spark.createDataFrame(rows, "id int, f array<struct<name:string,description:string,params:array<string>>>, cap int")
    got = {r.id: r.block for r in df.select("id", X.trimmed_tools("f", F.col("cap")).alias("block")).collect()}
    assert got == {i: by_loop(f[:200], c) for i, f, c in rows}
