"""The parallel scan of JSON arrays against a parser that reads the whole file."""

import json
import random

import pytest

from turnwise.sources.json_scan import json_records, read_json_array
from turnwise.sources.readers import INTERVIEW, read_interviews


@pytest.fixture
def small_blocks(spark):
    """File blocks of some hundred bytes, as many tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_records(n, seed=4):
    draw = random.Random(seed)
    alphabet = ['"', "\\", "{", "}", "[", "]", ",", "\n", "ä", "東", " ", "a", "b", "}}", '"}', "\\\\"]

    def text(k):
        return "".join(draw.choice(alphabet) for _ in range(draw.randint(0, k)))

    def value(depth):
        kind = draw.randint(0, 5)
        if kind == 0 and depth:
            return {text(3): value(depth - 1) for _ in range(draw.randint(0, 3))}
        if kind == 1 and depth:
            return [value(depth - 1) for _ in range(draw.randint(0, 3))]
        return text(draw.choice([3, 30, 400])) if kind < 4 else draw.choice([None, True, 1.5, -7])
    return [{"id": str(i), "v": value(3), text(4): value(2)} for i in range(n)]


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_records_are_those_of_a_parser(spark, tmp_path, small_blocks, layout):
    files = {name: odd_records(n, seed) for name, n, seed in (("a", 60, 1), ("b", 1, 2), ("c", 0, 3), ("d", 25, 4))}
    for name, records in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(records, **layout), encoding="utf-8")
    rows = json_records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {}
    for r in rows.collect():
        got.setdefault(r.file.rsplit("/", 1)[-1][0], []).append(json.loads(r.json))
    for name, records in files.items():
        assert sorted(got.get(name, []), key=str) == sorted(records, key=str)


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    records = [{"id": "1", "t": "x}" * 2_000}, {"id": "2", "t": '"{' * 1_500}, {"id": "3", "t": ""}]
    (tmp_path / "long.json").write_text(json.dumps(records))
    assert sorted((json.loads(r.json) for r in json_records(spark, str(tmp_path)).collect()), key=lambda r: r["id"]) == records


def test_objects_that_follow_each_other(spark, tmp_path, small_blocks):
    records = odd_records(40, 9)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r, indent=1) for r in records))
    got = [json.loads(r.json) for r in json_records(spark, str(tmp_path), depth=0).collect()]
    assert sorted(got, key=str) == sorted(records, key=str)


def test_cut_off_and_empty_files(spark, tmp_path):
    text = json.dumps(odd_records(5, 2))
    (tmp_path / "cut.json").write_text(text[:text.rindex('{"id"') + 9])
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ] \n")
    assert json_records(spark, str(tmp_path)).count() == 4


def test_interviews(spark, tmp_path, small_blocks):
    corpus = [{"id": f"N-{k}", "program": None, "utt": ["a \"}", "b" * k], "speaker": ["x", "y"], "other": {"z": [k]}} for k in range(50)]
    (tmp_path / "c.json").write_text("﻿" + json.dumps(corpus))
    rows = read_interviews(spark, str(tmp_path / "c.json"))
    assert rows.schema == spark.read.schema(INTERVIEW).json(str(tmp_path)).schema
    assert sorted((r.id, r.program, r.utt, r.speaker) for r in rows.collect()) == sorted(
        (c["id"], None, c["utt"], c["speaker"]) for c in corpus)
    assert read_json_array(spark, str(tmp_path), "id string").count() == 50
