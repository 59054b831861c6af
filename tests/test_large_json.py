"""Records of one JSON document cut out by many tasks, against the json module."""

from __future__ import annotations

import json
import random

import pytest

from patcheval.sources import readers
from patcheval.sources.large_json import elements, read_list_records


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def value(r, depth=0):
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", " ", "日"]) for _ in range(r.randint(0, 12)))
    kind = r.randint(0, 9) if depth < 3 else r.randint(4, 9)
    if kind < 2:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    if kind < 4:
        return {text(): value(r, depth + 1) for _ in range(r.randint(0, 3))}
    return r.choice([text(), text(), r.randint(-5, 10**6), 1.5, True, None])


def record(r):
    return {"instance_id": f"i{r.randint(0, 99)}", **{f"k{j}": value(r) for j in range(r.randint(0, 4))}}


def shown(df):
    return [json.loads(x.raw) for x in sorted(df.collect(), key=lambda x: x.position)]


@pytest.mark.parametrize("size, indent", [(150, None), (700, 2)])
def test_lists_and_wrappers(spark, tmp_path, small_splits, size, indent):
    r = random.Random(size)
    small_splits(size)
    records = [record(r) if r.random() < 0.8 else value(r) for _ in range(24)]
    records[12] = {"long": "}{\\\"" * 100, "deep": [[{"a": [{}]}]] * 20}  # over many splits
    listed = tmp_path / "list.json"
    listed.write_text(json.dumps(records, indent=indent, ensure_ascii=False))
    got = read_list_records(spark, str(listed))
    assert shown(got) == records
    assert sorted(x.position for x in got.collect()) == list(range(len(records)))
    if size < 700:
        assert got.sparkSession.read.text(str(listed), lineSep="}").rdd.getNumPartitions() > 5
    extra = {"in{st}an\"ces": [1, {"instances": [9]}], "meta": {"a": {"instances": [{}]}}, "none": None}
    for doc in ({**extra, "instances": records}, {"instances": records, **extra}):
        wrapped = tmp_path / f"{len(str(doc))}-{next(iter(doc))[:2]}.json"
        wrapped.write_text(json.dumps(doc, indent=indent))
        assert shown(read_list_records(spark, str(wrapped), "instances")) == records


def test_several_documents_and_odd_ones(spark, tmp_path, small_splits):
    small_splits(200)
    good = tmp_path / "good"
    good.mkdir()
    docs = {"a.json": [{"x": i} for i in range(30)], "b.json": [], "c.json": {"instances": []}, "d.json": {"instances": [{"y": "}"}] * 30}, "e.json": [1, "}", [2], None]}
    for name, doc in docs.items():
        (good / name).write_text(" \n" + json.dumps(doc) + "\n")
    got = read_list_records(spark, str(good), "instances").collect()
    for name, doc in docs.items():
        mine = sorted((x for x in got if x.file.endswith(name)), key=lambda x: x.position)
        assert [json.loads(x.raw) for x in mine] == (doc if isinstance(doc, list) else doc["instances"])
        assert [x.position for x in mine] == list(range(len(mine)))
    for k, text in enumerate(['{"a": 1}', '{"instances": {"a": 1}}', '"x"', '[{"a": 1}', '[{"a": 1', '[{"a": "1}]', "[1]]"]):
        (tmp_path / f"bad{k}.json").write_text(text)
        with pytest.raises(ValueError):
            read_list_records(spark, str(tmp_path / f"bad{k}.json"), "instances")
    with pytest.raises(ValueError):
        read_list_records(spark, str(good / "c.json"))


def test_large_documents_are_split_by_themselves(spark, tmp_path, small_splits):
    small_splits(2000)
    path = tmp_path / "list.json"
    path.write_text(json.dumps([{"instance_id": f"BUN-{i}", "problem_statement": "x}" * 20} for i in range(60)]))
    rows = readers.read_instances(spark, str(path))
    assert dict(rows.dtypes)["position"] == "bigint"
    assert [x.instance_id for x in rows.orderBy("position").collect()] == [f"BUN-{i}" for i in range(60)]


def test_elements():
    assert list(elements(' , 1,"a}" ,[{"x":1}], {"y": "}"} ')) == ["1", '"a}"', '[{"x":1}]', '{"y": "}"}']
    assert list(elements(" ,\n")) == [] == list(elements(""))


def test_metadata_of_split_documents(spark, tmp_path, small_splits):
    r = random.Random(5)
    records = [record(r) for _ in range(9)]
    long = {"name": "}{\\\"," * 60, "deep": [[{"a": [{}], "metadata": 1}]] * 9, "n": 1, "none": None}
    docs = {
        "first": {"metadata": long, "instances": records}, "last": {"instances": records, "metadata": long},
        "number": {"metadata": 7, "instances": records}, "null": {"instances": records, "metadata": None}, "none": {"instances": records},
        "deeper": {"a": {"metadata": {"x": "y"}}, "instances": [{"metadata": {"x": "z"}}] * 9}, "list": [{"metadata": {"a": "b"}}] * 9,
        "text": {"metadata": "}," * 200, "instances": records}, "met}a,data": {"met}a": {"a": 1}, "metadata": {"q": "}"}, "in": "}"},
    }
    texts = {k: json.dumps(d, indent=r.choice([None, 1])) for k, d in docs.items()}
    one = json.dumps({"metadata": {"a": "1"}, "instances": records})
    texts |= {
        "twice": one[:-1] + ', "metadata": {"a": "2"}}', "wrong": one[:-1] + ', "metadata": 3}', "cut": one[:-1], "cut late": one[:-1] + "\n", "behind": one + "\n",
        "lines": "\n".join([one, one.replace('"1"', '"9"')]), "no value": '{"metadata": , "instances": [' + one + "]}", "blank": " \n",
        "escaped": one.replace("metadata", "met\\u0061data"), "spaced": "\n  " + one.replace(":", " : "),
    }
    for k, t in texts.items():
        (tmp_path / f"{k}.json").write_text(t)
    got = lambda split: {x.file.rsplit("/")[-1]: x.metadata for x in readers.read_dataset_metadata(spark, str(tmp_path), split=split).collect()}
    want = got(False)
    assert {k.removesuffix(".json") for k in want} == {"first", "last", "met%7Da,data", "twice", "behind", "lines", "escaped", "spaced"} and want["last.json"]["name"] == long["name"]
    for size in (600, 1 << 20):
        small_splits(size)
        assert got(True) == want
    small_splits(300)
    plan = readers.read_dataset_metadata(spark, str(tmp_path / "first.json"))._jdf.queryExecution().toString()
    assert "json-field" in plan  # by default a document larger than a split comes into no cell
