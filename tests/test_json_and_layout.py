"""JSON in answers, containment, digests; text of page layouts."""

import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from corpuslens.functions import json as J
from corpuslens.functions import text as T
from corpuslens.operators import evidence as E
from corpuslens.operators import json_index as I
from corpuslens.session import fresh_path, ship


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(2)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def closed(text):
    """The one object that a cut text becomes by adding brackets, by trying them all."""
    for n in range(6):
        for ends in itertools.product("}]", repeat=n):
            try:
                return json.loads(text + "".join(ends))
            except ValueError:
                pass
    return None


def test_cut_answers_are_closed_by_brackets_only(spark):
    whole = json.dumps({"answerable": True, "paragraphs": [{"text": 'a "q\\u" {b] \n é', "evidence_ids": ["E1", "E12"]}], "n": [1, [2.5, None]]})
    cuts = [whole[:i] for i in range(1, len(whole) + 1)]
    got = [None if v is None else json.loads(v) for (v,) in values(spark, cuts, F.to_json(J.object_of(F.col("t"))))]
    assert got == [closed(c) for c in cuts] and sum(g is not None for g in got) > 5


def test_objects_with_words_around_them(spark):
    cases = {
        '```json\n{"a": 1}\n```': {"a": 1}, 'Here: {"a": {"b": "}"}} and more {x}': {"a": {"b": "}"}}, '{"a": 1} {"b": 2}': {"a": 1}, '[{"a": 1}]': None, '[broken {"a": 1}': {"a": 1},
        '"text" {"a": 1}': None, '12 {"a": 1}': None, "true": None, '{"a": [1, 2}': None, '{"a": 1,': None, '{"a": "cut': None, '{"a": "x\\': None, "no object": None, "": None, "{": {}, "}{": {},
        '```{"a": [1': {"a": [1]}, '{"a": [1]\n```': {"a": [1]}, '{"a": "' + "\\n" * 20_000 + '"': {"a": "\n" * 20_000}, "[" * 300: None,
    }
    got = [None if v is None else json.loads(v) for (v,) in values(spark, [*cases, None], F.to_json(J.object_of(F.col("t"))))]
    assert dict(zip(cases, got, strict=False)) == cases and got[-1] is None


def test_cut_answers_in_validation_and_repair(spark):
    raw = '{"answerable": true, "paragraphs": [{"text": "A whole sentence.", "evidence_ids": ["E1", "E9"'
    df = spark.createDataFrame([(1, raw, 2), (2, raw[:-1], 2), (3, raw + "]}]} and so on", 9), (4, "garbage", 2)], "response_id long, raw string, evidence_count int")
    errors = {r["response_id"]: r["error"] for r in E.validate_responses(df).collect()}
    assert errors == {1: "citation_marker_format_invalid", 2: "invalid_json", 3: "invalid_json", 4: "invalid_json"} or errors[2] == "invalid_json"
    repaired = {r["response_id"]: r["repaired"] for r in E.repair_responses(df).collect()}
    assert repaired[1][0]["evidence_ids"] == ["E1"] and repaired[2] is None and repaired[4] is None


def test_digest_ignores_order_and_spacing(spark):
    texts = ['{"b": 1, "a": {"y": [1, 2], "x": null}}', '{ "a":{"x":null,"y":[1,2]},\n"b":1}', '{"a": {"x": null, "y": [2, 1]}, "b": 1}', '{"e": "é\\u00e9", "f": 1.0, "g": true}', "no json", None]
    got = [v for (v,) in values(spark, texts, J.json_digest(F.col("t")))]
    assert got[0] == got[1] == hashlib.sha256(b'{"a":{"x":null,"y":[1,2]},"b":1}').hexdigest() and got[2] != got[0]
    assert got[3] == hashlib.sha256('{"e":"éé","f":1.0,"g":true}'.encode()).hexdigest() and got[4:] == [None, None]


def inside(v, p):
    if isinstance(p, dict):
        return isinstance(v, dict) and all(k in v and inside(v[k], x) for k, x in p.items())
    if isinstance(p, list):
        return isinstance(v, list) and all(any(inside(e, x) for e in v) for x in p)
    return not isinstance(v, (dict, list)) and isinstance(v, bool) == isinstance(p, bool) and v == p


def made(rnd, depth):
    kind = rnd.randrange(7 if depth else 4)
    if kind < 4:
        return [rnd.randrange(3), rnd.choice("ab"), rnd.choice([True, False, None]), 1.5][kind]
    if kind == 4:
        return [made(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {k: made(rnd, depth - 1) for k in rnd.sample(["a", "b", "it's", "x.y"], rnd.randrange(4))}


PATTERNS = [{}, [], {"a": 1}, {"a": {"b": "a"}}, {"it's": None}, {"x.y": [1]}, {"a": [{"b": 1}]}, {"a": [1, 1.0]}, {"b": True}, {"a": {}, "b": []}, [1], [[1]], [{"a": 1}, "b"], {"a": 1.5, "b": 0}]


def test_containment_against_recursion(spark):
    ship(spark)
    rnd = random.Random(4)
    docs = [{"a": made(rnd, 2), "b": made(rnd, 1)} if i % 3 else made(rnd, 3) for i in range(400)]
    texts = [json.dumps(d) for d in docs]
    got = values(spark, [*texts, "no json", None], *[J.contains(F.try_parse_json(F.col("t")), p) for p in PATTERNS])
    for p, column in zip(PATTERNS, zip(*got, strict=True), strict=True):
        assert list(column) == [inside(d, p) for d in docs] + [False, False], p
    scalars = values(spark, ['["foo", 1]', '"foo"', '[["foo"]]'], J.contains(F.try_parse_json(F.col("t")), "foo"))
    assert scalars == [(True,), (True,), (False,)]
    rows = spark.createDataFrame([*enumerate(texts), (1000, "no json"), (1001, None)], "id long, body string")
    path = fresh_path(spark, "json-index")
    I.build_json_index(rows, path, "id", "body")
    for p in PATTERNS[:8]:
        found = I.search_json_index(spark, path, rows, "id", "body", p)
        assert sorted(r["id"] for r in found.collect()) == [i for i, d in enumerate(docs) if inside(d, p)], p
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString() or "bucket#" in found._jdf.queryExecution().toString()


def test_layout_text(spark):
    cases = {
        "  a \n\t b  . c !": "a b. c!", "سال ۵۱۳۱ و ۲": "سال ۱۳۱۵ و ۲", "page 12 از ۶۲": "page 12 از ۲۶", "كتابي": "کتابی", "عل یت": "علیت", "می رود": "می‌رود", "نمی دانم": "نمی‌دانم",
        "ب رگ سبز": "برگ سبز", "کتاب و دفتر": "کتاب و دفتر", "رو یکرد تازه": "رویکرد تازه", "د یوی د": "دیوید", "فیز ی": "فیزی", "خوب ؟": "خوب؟", "a‎b‏c": "abc", "": "", "٢١": "١٢",
    }
    got = dict(zip(cases, (v for (v,) in values(spark, list(cases), T.layout_text(F.col("t")))), strict=True))
    assert got == cases
    assert values(spark, [None], T.layout_text(F.col("t"))) == [("",)]
    plan = spark.createDataFrame([("x",)], "t string").select(T.layout_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
