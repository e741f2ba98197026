import json

import pytest
from pyspark.sql import Row

from tracewright.operators import nested

GOLDEN = "golden_id bigint, response struct<status_code:int, body:string>, path string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def data_rows(spark, bodies):
    df = spark.createDataFrame([(i, (200, b), "clash") for i, b in enumerate(bodies)], GOLDEN)
    return rows(nested.data_elements(df))


def test_objects_in_arrays_at_any_depth(spark):
    body = json.dumps({"code": 1, "data": {"exam": [{"answers": [{"no": 1}, {"no": 2}]}, {}], "grid": [[{"c": 1}], []]}})
    assert data_rows(spark, [body]) == sorted(
        [
            (0, "data", "data.exam", 0, "exam"),
            (0, "data", "data.exam", 1, "exam"),
            (0, "data", "data.exam[0].answers", 0, "answers"),
            (0, "data", "data.exam[0].answers", 1, "answers"),
            (0, "data", "data.grid[0]", 0, "grid"),
        ]
    )


def test_json_inside_text_counts_as_what_it_holds(spark):
    inner = json.dumps([{"a": json.dumps({"b": [{}]})}])
    got = data_rows(spark, [json.dumps({"data": inner}), json.dumps({"data": "[27]x"}), json.dumps({"data": [1, "{bad}"]})])
    assert got == [(0, "data", "data", 0, "data"), (0, "data", "data[0].a.b", 0, "b")]


@pytest.mark.parametrize("body", [None, "", "{", '{"data": NaN}', "[]", '"x"', '{"other": [{}]}', '{"data": null}'])
def test_bodies_that_give_nothing(spark, body):
    assert data_rows(spark, [body]) == []


def test_null_struct_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, (1, '{"data":[{}]}'), "x"), (2, (1, '{"data":[{}]}'), "x")], GOLDEN)
    assert rows(nested.data_elements(df)) == [(2, "data", "data", 0, "data")] * 2
    assert rows(nested.data_elements(df.limit(0))) == []


def test_deep_and_long(spark):
    deep = "[" * 300 + "{}" + "]" * 300
    assert data_rows(spark, ['{"data":' + deep + "}"])[0][3] == 0
    many = json.dumps({"data": [{"t": "x" * 50}] * 5000})
    assert len(data_rows(spark, [many])) == 5000


def test_collection_shapes(spark):
    body = {
        "item": [
            {"name": "f", "item": [{"request": {"url": {"path": ["api", {"type": "string", "value": "v"}, None]}}, "response": [{"header": [{"key": "A"}, {"key": None}]}, {"header": {"key": "B"}}]}]},
            {"request": {"url": {"path": "/api//x/"}}, "response": {"header": {"key": "C"}}},
            {"request": {"url": "text"}, "response": {"header": [{"key": "D"}]}},
            {"request": None, "item": []},
        ]
    }
    df = spark.createDataFrame([Row(col_id=7, body=json.dumps(body), rec="clash"), Row(col_id=8, body="no json", rec="clash")])
    assert rows(nested.collection_elements(df)) == sorted(
        [
            (7, "path", "0.0", 0, "api"),
            (7, "path", "0.0", 1, "v"),
            (7, "header", "0.0#0", 0, "A"),
            (7, "header", "0.0#1", 0, "B"),
            (7, "path", "1", 0, "api"),
            (7, "path", "1", 1, "x"),
            (7, "header", "1#0", 0, "C"),
            (7, "header", "2#0", 0, "D"),
        ]
    )


def test_table_links_to_parent(spark):
    body = json.dumps({"data": {"exam": [{"id": 1, "answers": [{"no": 5}]}, {"answers": []}]}})
    t = nested.triples(spark.createDataFrame([(3, body)], "rec bigint, body string"), "rec", "body", at=("data",))
    exam = rows(nested.table(t, "data.exam", ["id"]))
    answers = rows(nested.table(t, "data.exam[].answers", ["no"]))
    assert exam == [(3, "data.exam", 0, "1", None, None), (3, "data.exam", 1, None, None, None)]
    assert answers == [(3, "data.exam[0].answers", 0, "5", "data.exam", 0)]


def test_lone_surrogate_is_replaced(spark):
    t = nested.triples(spark.createDataFrame([(1, '{"a": "\\ud800x"}')], "rec bigint, body string"), "rec", "body")
    assert [r.value for r in t.where("path = 'a'").collect()] == ["�x"]


def test_every_group_and_path_comes_out_in_a_table(spark, tmp_path):
    from tracewright.plans import load_core

    golden = {"data": {"note": "n", "exam": [{"id": 1, "department": "d", "answers": [{"no": 5, "files": ["a", {"value": "b"}]}]}], "grid": [[{"Parent": 0}], []]}}
    collection = {"item": [{"name": "q", "request": {"url": {"path": ["api"]}}, "response": [{"header": [{"key": "A"}]}]}]}
    spark.createDataFrame([(3, (200, json.dumps(golden)), "x")], GOLDEN).write.parquet(f"{tmp_path}/golden.parquet")
    spark.createDataFrame([(7, json.dumps(collection))], "col_id bigint, body string").write.parquet(f"{tmp_path}/collection_readonly_partial.parquet")
    queries = load_core().queries
    df = queries["p3_tables"](spark, str(tmp_path))
    links = ("source", "rec", "parent", "pos", "up_parent", "up_pos")
    got = {tuple(r[c] for c in links): {c: v for c, v in r.asDict().items() if c not in (*links, "grp") and v is not None} for r in df.collect()}
    assert got == {
        ("golden", 3, "", None, None, None): {"data/note": "n"},
        ("golden", 3, "data.exam", 0, None, None): {"id": "1", "department": "d"},
        ("golden", 3, "data.exam[0].answers", 0, "data.exam", 0): {"no": "5"},
        ("golden", 3, "data.exam[0].answers[0].files", 0, "data.exam[0].answers", 0): {"value_2": "a"},
        ("golden", 3, "data.exam[0].answers[0].files", 1, "data.exam[0].answers", 0): {"value": "b"},
        ("golden", 3, "data.grid", 0, None, None): {},
        ("golden", 3, "data.grid", 1, None, None): {},
        ("golden", 3, "data.grid[0]", 0, "data.grid", 0): {"Parent_2": "0"},
        ("collection", 7, "", None, None, None): {},
        ("collection", 7, "item", 0, None, None): {"name": "q"},
        ("collection", 7, "item[0].request.url.path", 0, "item", 0): {"value_2": "api"},
        ("collection", 7, "item[0].response", 0, "item", 0): {},
        ("collection", 7, "item[0].response[0].header", 0, "item[0].response", 0): {"key": "A"},
    }
    assert "department" in queries["p3_table_exam"](spark, str(tmp_path)).columns
