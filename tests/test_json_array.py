"""JSON arrays read in splits, against Python's parser, at every split size."""

import json
import random

import pytest

from prefloom.sources import json_array
from prefloom.sources.json_array import array_objects, read_json_array
from prefloom.sources.readers import read_dataset, read_prompts


@pytest.fixture
def splits(spark):
    """Set the largest split in bytes for one test."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def size(n, parts=1):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], str(parts))

    yield size
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


TEXTS = ['plain', 'brace } in a string', '}{][', 'quote " and \\ backslash', '\\', '\\\\"', '"', 'line\nbreak', '日本 😀 é', '', '}}}}"}', '[{"a": "}"}]', 'x' * 300]


def records(rnd, n):
    nested = [None, {}, [], {"a": {"b": "}"}}, [{"q": 'u"}'}, [1, [2]]], {"k\"}": "v"}, -1.5e3, True]
    return [{"id": str(i), "prompt": rnd.choice(TEXTS), "extra": rnd.choice(nested)} for i in range(n)]


def written(path, rows, style):
    text = {"dense": json.dumps(rows, separators=(",", ":"), ensure_ascii=False), "indented": json.dumps(rows, indent=2),
            "ragged": "\n\n [ " + " ,\r\n\t ".join(json.dumps(r, ensure_ascii=False) for r in rows) + " \n] \n"}[style]
    path.write_text(text, encoding="utf-8")
    return str(path)


def objects(df):
    return [json.loads(r["value"]) for r in sorted(df.collect(), key=lambda r: r["ord"])]


@pytest.mark.parametrize("style", ["dense", "indented", "ragged"])
@pytest.mark.parametrize("size", [23, 400])
def test_equal_to_the_parser(spark, splits, tmp_path, style, size):
    rows = records(random.Random(size), 14)
    path = written(tmp_path / "a.json", rows, style)
    splits(size)
    df = array_objects(spark, path)
    assert objects(df) == rows
    assert sorted(r["ord"] for r in df.collect()) == list(range(14))


def test_more_than_one_task(spark, splits, tmp_path):
    """A file without line breaks is several splits, each in a task of its own."""
    path = written(tmp_path / "a.json", records(random.Random(1), 400), "dense")
    splits(4000, parts=8)
    text = spark.read.option("lineSep", "}").text(path)
    assert text.rdd.getNumPartitions() > 4
    assert len(objects(array_objects(spark, path))) == 400


def test_states_by_shuffle(spark, splits, tmp_path, monkeypatch):
    monkeypatch.setattr(json_array, "STATES_SENT", 0)
    rows = records(random.Random(2), 25)
    path = written(tmp_path / "a.json", rows, "dense")
    splits(100)
    assert objects(array_objects(spark, path)) == rows


def test_several_files_and_an_empty_array(spark, splits, tmp_path):
    parts = [records(random.Random(k), n) for k, n in enumerate((5, 0, 9, 1))]
    for k, rows in enumerate(parts):
        written(tmp_path / f"{k}.json", rows, ["dense", "ragged"][k % 2])
    splits(90)
    assert objects(array_objects(spark, str(tmp_path))) == [r for rows in parts for r in rows]


def test_object_over_many_splits(spark, splits, tmp_path):
    rows = [{"id": "0"}, {"id": "1", "deep": [{"x": "}" * 50, "y": ['"}{'] * 9}] * 4}, {"id": "2"}]
    path = written(tmp_path / "a.json", rows, "dense")
    splits(30)
    assert objects(array_objects(spark, path)) == rows


def test_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_bytes(b"\xef\xbb\xbf" + b'[{"a": 1}, {"a": 2}]')
    assert objects(array_objects(spark, str(path))) == [{"a": 1}, {"a": 2}]


@pytest.mark.parametrize("size", [9])
@pytest.mark.parametrize("text", ['[{"a": 1}, 5]', '["x", {"a": 1}]', '{"a": 1}', '[{"a": 1}] [{"a": 2}]', '[{"a": 1}] x', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]',
                                  '[{"a": 1}, ]', '[, {"a": 1}]', '[{"a": 1}', '[{"a": "x}]', '[{"a": 1}]]', '[[{"a": 1}]]', '[{"a": "line\nbreak"}]', '[{"a": 1}}', '[{"a": 1]]'])
def test_anything_else_stops_the_read(spark, splits, tmp_path, text, size):
    path = tmp_path / "a.json"
    path.write_text(text)
    splits(size)
    with pytest.raises(Exception, match="array|comma|object|control|changed"):
        array_objects(spark, str(path)).collect()


def test_prompts_and_datasets(spark, splits, tmp_path):
    rows = [{"id": str(i), "prompt": t, "category": "c"} for i, t in enumerate(TEXTS)]
    path = written(tmp_path / "prompts.json", rows, "dense")
    splits(50)
    got = sorted(read_prompts(spark, path, "json_array").collect())
    assert [(r["ord"], r["id"], r["prompt"], r["category"], r["difficulty"]) for r in got] == [(i, str(i), t, "c", None) for i, t in enumerate(TEXTS)]
    df = read_dataset(spark, path, "json_array")
    assert set(df.columns) == {"ord", "id", "prompt", "category"}
    assert [r["prompt"] for r in sorted(df.collect(), key=lambda r: r["ord"])] == TEXTS


def test_schema_from_all_objects(spark, splits, tmp_path):
    rows = [{"a": 1}] * 20 + [{"a": 1.5, "b": [1]}]
    path = written(tmp_path / "a.json", rows, "ragged")
    splits(40)
    df = read_json_array(spark, path)
    assert dict(df.dtypes) == {"ord": "bigint", "a": "double", "b": "array<bigint>"}
    assert sum(r["a"] for r in df.collect()) == 21.5
