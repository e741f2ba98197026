import json
import random

import pytest

from tracewright.functions import jsontext as J
from tracewright.operators import nested


def value(r, depth=0):
    k = r.randrange(9 if depth < 5 else 6)
    if k < 3:
        return (None, r.random() < 0.5, r.randrange(-1000, 1000))[k]
    if k == 3:
        return r.random() * 10 ** r.randrange(-5, 20)
    if k < 6:
        return "".join(r.choice('ab"\\\n{}[]é😀,: .') for _ in range(r.randrange(6)))
    if k < 8:
        return {r.choice("abc.[%") + str(r.randrange(4)): value(r, depth + 1) for _ in range(r.randrange(4))}
    return [value(r, depth + 1) for _ in range(r.randrange(4))]


def standard(text):
    try:
        return True, json.loads(text, parse_constant=J._no_constant)
    except ValueError:
        return False, None


def test_reads_what_the_standard_reader_reads():
    r = random.Random(1)
    for _ in range(3000):
        v = value(r)
        text = json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        assert J.build(text) == v
        i = r.randrange(len(text))
        broken = text[:i] + r.choice('{}[]",:0a ') + text[i + r.randrange(2) :]
        ok, want = standard(broken)
        if ok:
            assert J.build(broken) == want
        else:
            with pytest.raises(ValueError):
                J.build(broken)


@pytest.mark.parametrize("depth", [900, 9_000, 60_000])
def test_any_depth(depth):
    text = '{"a":[' * depth + "1" + "]}" * depth
    v = J.load(text)
    for _ in range(depth):
        v = v["a"][0]
    assert v == 1 and J.is_json(text) and not J.is_json(text[:-1])


def test_canonical_ignores_order_of_arrays_only():
    assert J.canonical({"a": [1, {"b": [2, 3]}], "c": 0}) == J.canonical({"c": 0, "a": [{"b": [3, 2]}, 1]})
    assert J.canonical([1]) != J.canonical(["1"]) and J.canonical([True]) != J.canonical([1]) and J.canonical([[1], [2]]) != J.canonical([[1, 2]])
    assert J.canonical([1, 2], ordered=True) != J.canonical([2, 1], ordered=True)


def test_huge_numbers_and_constants():
    assert J.load("1" * 5000) == float("inf") and not J.is_json("NaN") and not J.is_json("") and not J.is_json("1 2")


def test_triples_from_tokens_are_those_of_the_tree():
    r = random.Random(4)
    for _ in range(500):
        v = {"data": value(r), "x": json.dumps([value(r)])}
        text = json.dumps(v)
        for at, expand in (((), False), ((), True), (("data",), True)):
            want = sorted(map(repr, nested._parsed(text, at, expand)))
            assert sorted(map(repr, nested.record_triples(text, at, expand))) == want


def test_keys_with_separators_keep_apart():
    a = list(nested.record_triples('{"a.b": 1, "a": {"b": 2}, "c[0]": [3], "c": [4], "d%2E": 5}'))
    ways = [(parent, pos, path) for _, parent, pos, path, kind, _ in a if kind == "number"]
    assert len(set(ways)) == 5
    assert list(nested.record_triples('{"a": 1, "a": 2}')) == [("", "", None, "", "object", None), ("", "", None, "a", "number", "2")]


def test_every_child_has_its_parent_row(spark):
    r = random.Random(9)
    rows = [(i, json.dumps({"list": [value(r) for _ in range(4)], "more": {"l": [[value(r)], [value(r)]]}})) for i in range(60)]
    t = nested.triples(spark.createDataFrame(rows, "id bigint, body string"), "id", "body")
    flat = nested.tables(t).select("rec", "parent", "pos", "up_parent", "up_pos").cache()
    up = flat.selectExpr("rec", "parent as up_parent", "pos as up_pos")
    assert flat.where("up_parent is not null").join(up, ["rec", "up_parent", "up_pos"], "left_anti").isEmpty()
    assert flat.count() == t.where("path = ''").select("rec", "parent", "pos").distinct().count()


def test_found_elements_at_any_depth(spark):
    deep = '{"data": ' + '{"a":[' * 3_000 + '{"b": 1}' + "]}" * 3_000 + "}"
    d = spark.createDataFrame([(1, (200, deep))], "golden_id bigint, response struct<status_code:int,body:string>")
    assert nested.data_elements(d).count() == 3_000
