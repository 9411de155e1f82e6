"""Elements of a large JSON document, against the reader that holds it whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vetspark.sources.json_array import json_array
from vetspark.sources.readers import raw_case_source


def both(spark, path, field):
    want = [(r.pos, json.loads(r.raw)) for r in raw_case_source(spark, path, field).orderBy("pos").collect() if r.pos is not None]
    return [(r.pos, json.loads(r.raw)) for r in json_array(spark, path, field).orderBy("pos").collect()], want


def value(r, depth=0):
    kind = r.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return "".join(r.choice('ab"\\{}[],: \n\té日') for _ in range(r.randrange(12)))
    if kind < 5:
        return r.choice([0, -1.5, True, False, "x", "", 'a"', "\\", '\\"'])
    if kind < 7:
        return {f"k{i}": value(r, depth + 1) for i in range(r.randrange(4))} | ({"evals": [1, "in"]} if r.random() < 0.2 else {})
    return [value(r, depth + 1) for _ in range(r.randrange(4))]


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_equal_the_whole_reader(spark, tmp_path, indent):
    r = random.Random(indent)
    evals = [value(r) for _ in range(120)]
    doc = {"skill_name": "a \"b\" \\", "other": [{"evals": [7]}, ["x"]], "evals": evals, "evals2": [9], "last": {"evals": [8]}}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got, want = both(spark, str(path), "evals")
        assert spark.read.option("lineSep", '"').text(str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want == [*enumerate(evals)]


def test_odd_documents(spark, tmp_path):
    path = tmp_path / "doc.json"
    for text, want in (('{"evals": []}', []), ('{"evals": [ ]}', []), ('{"evals": [1]}', [1]), ('{"a": 1}', []), ('{"evals": {"evals": [1]}}', []), ('{"evals":[{},[],"",{"a":[1,2]}]}', [{}, [], "", {"a": [1, 2]}]), (' {"evals":[\n"a,b]"\n,\n2 ] } ', ["a,b]", 2])):
        path.write_text(text)
        assert [json.loads(r.raw) for r in json_array(spark, str(path), "evals").orderBy("pos").collect()] == want, text


def test_golden_cases_are_typed_from_it(spark, tmp_path):
    path = tmp_path / "cases.json"
    cases = [{"id": i, "prompt": f"p {i}", "expected_output": 'Decision=CREATE; reason="x"', "assertions": ["a", "b"], "files": []} for i in range(50)]
    path.write_text(json.dumps({"skill_name": "s", "evals": cases}))
    typed = json_array(spark, str(path), "evals").select(F.from_json("raw", "id long, prompt string, expected_output string, assertions array<string>, files array<string>").alias("c")).select("c.*")
    assert sorted(r.asDict()["id"] for r in typed.collect()) == [*range(50)] and typed.filter("size(assertions) = 2").count() == 50
