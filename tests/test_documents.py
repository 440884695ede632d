"""Documents read in small ranges against json, and line numbers over splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import documents, files


def texts(rng):
    pool = ['a"b', "back\\slash", "\\\\", "{[", "]}", '","annotations":[', "é\n\t", "", 'x\\"', "plain"]
    return [{"id": i, "t": rng.choice(pool) + rng.choice(pool), "n": [[rng.randrange(9)] * rng.randrange(3)], "o": {"annotations": [1, {"k": "]"}]}} for i in range(200)]


@pytest.mark.parametrize("step", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_of_a_document(spark, tmp_path, step, indent):
    rows = texts(random.Random(step))
    doc = {"info": {"annotations": ["no"], "x": "\"annotations\": ["}, "annotations": rows[:150 if step > 7 else 15], "images": rows[150:153], "none": [], "tail": [{"id": 5}]}
    path = str(tmp_path / "d.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=indent, ensure_ascii=step % 2 == 0)
    schema = "id int, t string, n array<array<int>>, o struct<annotations:array<string>>"
    got = documents.read_arrays(spark, path, {k: schema for k in ("annotations", "images", "none", "tail", "missing")}, step)
    for k, df in got.items():
        want = doc.get(k, [])
        held = sorted(df.collect(), key=lambda r: r.id)
        assert [(r.id, r.t, r.n) for r in held] == [(w["id"], w.get("t"), w.get("n")) for w in want]
    if step == 64:
        assert got["annotations"].rdd.getNumPartitions() > 50


def test_a_document_that_is_a_list_or_a_map(spark, tmp_path):
    rows = texts(random.Random(3))[:40]
    path = str(tmp_path / "l.json")
    for doc in (rows, [], rows[:1]):
        (tmp_path / "l.json").write_text(" \n" + json.dumps(doc))
        assert sorted((r.id, r.t) for r in documents.read_arrays(spark, path, {"": "id int, t string"}, 50)[""].collect()) == [(r["id"], r["t"]) for r in doc]
    (tmp_path / "l.json").write_text(json.dumps({f"k{r['id']}": r for r in rows}))
    assert {r.key: r.value.t for r in documents.read_map(spark, path, "struct<t:string>", 60).collect()} == {f"k{r['id']}": r["t"] for r in rows}
    (tmp_path / "l.json").write_text('[{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="isn't closed"):
        documents.read_arrays(spark, path, {"": "id int"}, 50)[""].collect()


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit('q"\n'), F.col("id").cast("string")).alias("t")).repartition(7)
    path = str(tmp_path / "w.json")
    documents.write_document({"images": rows, "none": rows.limit(0), "annotations": rows.where("id < 10")}, path)
    with open(path) as f:
        doc = json.load(f)
    assert sorted(x["id"] for x in doc["images"]) == list(range(1000)) and doc["none"] == [] and len(doc["annotations"]) == 10
    assert {p.name for p in tmp_path.iterdir()} <= {"w.json", ".w.json.crc"}
    documents.write_array(rows.where("id < 3"), path)
    with open(path) as f:
        assert sorted(x["t"] for x in json.load(f)) == ['q"\n0', 'q"\n1', 'q"\n2']
    sizes = documents.write_trainer_data({"a": rows.where("id < 2"), "b": rows.limit(0)}, str(tmp_path))
    info = json.loads((tmp_path / "dataset_info.json").read_text())
    assert list(info) == ["a", "b"] and info["a"]["file_name"] == "a.json" and info["a"]["columns"]["messages"] == "conversations"
    assert sizes["a"] == (tmp_path / "a.json").stat().st_size and json.loads((tmp_path / "b.json").read_text()) == []


def test_malformed_lines_are_named_by_file_and_line(spark, tmp_path):
    lines = [json.dumps({"id": i, "t": "x" * (i % 50)}) if i % 7 else "" for i in range(400)]
    bad = {150: '{"id": 1} {"id": 2}', 151: "{", 333: '{"id": 1},', 399: "]"}
    for i, text in bad.items():
        lines[i] = text
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = documents.malformed_lines(spark, str(tmp_path)).orderBy("line").collect()
        assert [(r.line - 1, r.value) for r in got] == sorted(bad.items()) and all(r.path.endswith("/a.jsonl") for r in got)
        with pytest.raises(ValueError, match=r"a.jsonl:151: invalid JSONL record"):
            files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int")
        assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("step", [16, 64, 100, 1000])
def test_an_array_that_ends_in_its_first_range_reads_no_other(spark, tmp_path, step):
    doc = {"a": [{"id": 1}, {"id": 2}], "b": [{"id": 100 + i, "t": 'x,]}[{\\"' * (i % 3)} for i in range(60)], "c": [], "d": [{"id": 7}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = documents.read_arrays(spark, str(tmp_path / "d.json"), {k: "id int" for k in doc}, step)
    assert {k: sorted(r.id for r in df.collect()) for k, df in got.items()} == {k: [x["id"] for x in v] for k, v in doc.items()}


def test_tasks_get_their_ranges_only_and_read_several(spark, tmp_path):
    import pickle

    (tmp_path / "d.json").write_text(json.dumps({"a": [{"id": i} for i in range(4000)]}))
    df = documents.read_arrays(spark, str(tmp_path / "d.json"), {"a": "id int"}, 16)["a"]
    assert df.rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism and sorted(r.id for r in df.collect()) == list(range(4000))
    few, many = (len(pickle.dumps(documents._Reader("x", [[[0, 9, False, 2, 2, False]]] * n).read)) for n in (1, 1000))
    assert few == many
    plan = df.where("id > 3 and id is not null").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
