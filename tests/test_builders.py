"""Samplers against sequential passes, raw rows, sinks and small functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import parse, text
from millrace.operators import builders, raw, rules, sampling
from millrace.plans.store import table_store
from millrace.sources import files


def sequential_locked(rows, total, caps):
    """The pass that ``locked_rows`` stands for."""
    used, out = {}, []
    total = min(total, len(rows))
    half = {"false_positive": total // 2, "false_negative": total - total // 2}

    def take(r):
        keys = [(k, r[k]) for k in caps]
        if any(used.get(k, 0) >= caps[k[0]] for k in keys):
            return False
        for k in keys:
            used[k] = used.get(k, 0) + 1
        out.append(r["i"])
        return True

    for kind, n in half.items():
        got = 0
        for r in rows:
            if r["error_type"] == kind and got < n:
                got += take(r)
    for r in rows:
        if len(out) < total and r["i"] not in out:
            take(r)
    return set(out)


@pytest.mark.parametrize("share", [0.5, 0.1])
def test_locked_rows_is_the_sequential_pass(spark, share):
    rng = random.Random(share)
    rows = [{"i": i, "a": rng.randrange(5), "b": rng.randrange(4), "c": rng.randrange(20), "error_type": "false_positive" if rng.random() < share else "false_negative"} for i in range(70)]
    caps = {"a": 9, "b": 11, "c": 3}
    df = spark.createDataFrame([(r["i"], r["a"], r["b"], r["c"], r["error_type"]) for r in rows], "i int, a int, b int, c int, error_type string")
    got = {r.i for r in builders.locked_rows(df, 30, caps, ["i"], table_store(spark)).collect()}
    assert got == sequential_locked(rows, 30, caps)


def sequential_turns(rows, n, per_image):
    """The pass that ``strategy_pairs`` stands for; rows are (image, positive, negative, strategy, place)."""
    queues = {s: sorted((r for r in rows if r[3] == s), key=lambda r: r[4]) for s in {r[3] for r in rows}}
    at, own, out, turn = dict.fromkeys(queues, 0), {}, [], 0
    while len(out) < n and any(at[s] < len(q) for s, q in queues.items()):
        turn += 1
        for s in sorted(queues):
            while len(out) < n and at[s] < len(queues[s]):
                image, pos, neg, _, _ = queues[s][at[s]]
                at[s] += 1
                kept = own.setdefault(image, [])
                if len(kept) < per_image and all(p != pos and m != neg for p, m in kept):
                    kept.append((pos, neg))
                    out.append((turn, s, image, pos, neg))
                    break
    return out


@pytest.mark.parametrize("seed, n, per_image, images", [(5, 20, 2, 12), (6, 1000, 3, 12), (7, 60, 1, 40), (8, 25, 2, 1), (9, 0, 2, 5)])
def test_strategy_pairs_are_the_sequential_pass(spark, seed, n, per_image, images):
    rng = random.Random(seed)
    rows = [(rng.randrange(images), rng.randrange(6), rng.randrange(6), rng.choice("xxxyyz"), i) for i in range(200)]
    df = spark.createDataFrame(rows, "image_id int, positive int, negative int, strategy string, i int")
    got = builders.strategy_pairs(df, n, per_image, ["i"], table_store(spark)).collect()
    assert sorted((r.turn, r.strategy, r.image_id, r.positive, r.negative) for r in got) == sequential_turns(rows, n, per_image)


def test_locked_rows_are_refilled_with_invalid_errors(spark):
    rows = [(i, i % 3, "false_positive" if i < 4 else "false_negative" if i < 6 else "invalid_error" if i < 9 else "correct") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, a int, error_type string").withColumn("prediction", F.lit("yes")).withColumn("image", F.lit("x.jpg"))
    take = lambda **k: sorted(r.id for r in builders.locked_rows(df, 8, {"a": 9}, ["id"], table_store(spark), **k).collect())
    assert take() == [0, 1, 2, 3, 4, 5]
    assert take(refill=("invalid_error",)) == [0, 1, 2, 3, 4, 5, 6, 7]
    got = builders.mined_rows(df).orderBy("id").collect()
    assert [r.id for r in got][:2] == ["base_error_mined_000001", "base_error_mined_000002"]
    assert [r.source_candidate_id for r in got] == sorted(str(i) for i in range(12))
    assert set(got[0].asDict()) == {"id", "source", "source_candidate_id", "image", "base_prediction", "base_error_type"}


def test_exact_samples(spark):
    df = spark.range(10)
    assert sampling.sample_exactly(df, F.col("id"), 4, "s").where("picked").count() == 4
    assert sampling.sample_exactly(df, F.col("id"), 40, "s", allow_short=True).where("picked").count() == 10
    for n in (-1, 11):
        with pytest.raises(ValueError, match="rows"):
            sampling.sample_exactly(df, F.col("id"), n, "s")
    assert sampling.sample_pairs(df, F.col("id"), 6, "s").count() == 3
    with pytest.raises(ValueError, match="even"):
        sampling.sample_pairs(df, F.col("id"), 5, "s")


def test_benchmarks_and_balanced_rows(spark):
    q = spark.createDataFrame([(1, "", " Is it? ", 1), (1, "b.png", "later", 2), (2, None, "q", 3), (3, "x/c.jpg", "q", 4)], "id int, image string, query string, n int")
    a = spark.createDataFrame([(1, "discriminative-attribute-number", "TRUE"), (3, "generative", "no")], "id int, type string, truth string")
    rows, lacking = builders.annotated_benchmark(q, a, F.col("n"), "s", "root")
    assert [(r.id, r.image, r.image_id, r.question, r.target, r.task_type) for r in rows.collect()] == [("s_000001", "root/AMBER_1.jpg", "AMBER_1", "Is it?", "yes", "attribute_number")]
    assert [r.id for r in lacking.collect()] == [2]
    with pytest.raises(Exception, match="neither yes nor no"):
        builders.annotated_benchmark(q, a.withColumn("truth", F.lit("?")), F.col("n"), "s", "root")[0].collect()
    bad = spark.createDataFrame([(1, "i", "maybe", "dog")], "id int, image string, target string, target_object string")
    with pytest.raises(Exception, match="no target or object"):
        builders.balanced_rows(bad).collect()
    anchors = spark.createDataFrame([("g1", "i", "What?", "a", "b", "Evidence hint: red dog.", "gqa"), ("c1", "i", "q", "a", "b", "none", "coco")], "id string, image string, question string, chosen string, rejected string, hint_chosen string, source string")
    assert [(r.id, r.prompt) for r in builders.anchor_rows(anchors).collect()] == [("g1::anchor", "<image>\nVisual cue: red dog.\nQuestion: What?\nAnswer:")]


def test_raw_graphs_and_boxes(spark):
    data = [
        '{"image_id": 1, "sceneGraph": {"objects": {"7": {"label": "Dog_1", "x": 1, "width": 5, "attributes": ["Red!", ""], "relations": [{"predicate": "Left-of", "target_id": "8"}, {"name": "near"}]}, "9": {"name": "!"}}}}',
        '{"image_id": 2, "objects": {"1": {"category": "cat"}}}', '{"image_id": 3, "detections": [{"name": "bus", "attrs": ["old"]}, {"label": ""}]}', '{"image_id": 4}',
    ]
    schema = f"image_id int, sceneGraph struct<objects:map<string,{raw.NODE}>>, objects map<string,{raw.NODE}>, detections {raw.DETECTION}"
    rows = spark.createDataFrame([(x,) for x in data], "t string").select(F.from_json("t", schema).alias("r")).select("r.*")
    got = {r.image_id: r.objects for r in raw.scene_graphs(rows).collect()}
    dog = got[1]["7"]
    assert list(got[1]) == ["7"] and (dog.name, dog.x, dog.y, dog.w, dog.attributes) == ("dog 1", 1.0, 0.0, 5.0, ["red"])
    assert [(r.name, r.object) for r in dog.relations] == [("left of", "8")]
    assert got[2]["1"].name == "cat" and got[3]["1"].name == "bus" and got[3]["1"].attributes == ["old"] and got[4] is None
    lists = spark.createDataFrame([(1, [[0.0, 0.0, 2.0, 3.0], [0.0, 0.0, 0.0, 3.0], [1.0]], ["18", "Big-Cat", "x"]), (2, None, None), (None, [[0.0] * 4], ["x"]), (3, [[0.0, 1.0, 2.0, 3.0]], ["99"])], "image_id int, bbox array<array<double>>, category array<string>")
    boxes, skipped = raw.detection_rows(lists, F.create_map(F.lit("18"), F.lit("dog")))
    assert sorted((r.image_id, r.name, r.w) for r in boxes.collect()) == [(1, "dog", 2.0), (3, "category 99", 2.0)]
    assert {r.reason: r.n for r in skipped.collect()} == {"missing_boxes": 1, "missing_image": 1}
    names = spark.createDataFrame([("COCO_train2014_000000000009",), ("a/b c.jpg",), ("//",), (None,)], "v string")
    assert [(r.i, r.n) for r in names.select(raw.int_like_id(F.col("v")).alias("i"), raw.safe_name(F.col("v")).alias("n")).collect()] == [
        (9, "COCO_train2014_000000000009"), (0, "a_b_c_jpg"), (0, "image"), (0, "image"),
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, "x"), None), (2, (3, None), "t")], "z int, s struct<b:int,a:string>, k string")
    assert files.publish(df, str(tmp_path / "one"), str(tmp_path / "two")) == 2
    for name in ("one", "two"):
        lines = sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
        assert lines == ['{"k":"t","s":{"b":3},"z":2}', '{"s":{"a":"x","b":2},"z":1}']
    files.write_json(spark, {"b": 1, "a": "é"}, str(tmp_path / "doc"))
    assert list(json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "doc")).collect())).items()) == [("b", 1), ("a", "é")]
    files.write_ids(df, "k", str(tmp_path / "ids"))
    assert [r.id for r in files.read_ids(spark, str(tmp_path / "ids")).collect()] == ["t"]
    with pytest.raises(ValueError, match="more than"):
        files.markdown_table(spark.range(5), 4)
    assert files.markdown_table(spark.createDataFrame([("a|b\nc",)], "x string")).splitlines()[-1] == "| a\\|b c |"


def test_small_functions(spark):
    rows = [("dog left_of cat", "cat", "dog", "left_of", "supported"), ("cat left_of dog", "cat", "dog", "left_of", "wrong_evidence"), ("x", "a", "b", None, "supported"), ("x", "a", "b", None, None)]
    df = spark.createDataFrame(rows, "c string, s string, o string, r string, p string")
    got = [r.k for r in df.select(text.failure_category(*[F.col(x) for x in "csorp"]).alias("k")).collect()]
    assert got == ["subject/object swap", "left/right ambiguity", "copied candidate evidence without verification", "candidate relation text under-specified"]
    (r,) = spark.range(1).select(text.candidate_evidence(F.lit("Q\nCandidate evidence:  label=dog  x\nz")).alias("e"), text.escape_md(F.lit(" a|b\n c")).alias("m"), text.compact(F.lit("ab cd"), 3).alias("k"), parse.normalize_relation(F.lit("On Top-of")).alias("n")).collect()
    assert (r.e, r.m, r.k, r.n) == ("label=dog x", "a\\|b c", "ab ", "on top of")
    assert (text.percent(0.8651), text.interval(0.5, 0.25, 1)) == ("86.5", "50.0 [25.0, 100.0]")
    assert [text.percent_or_pending(v) for v in (None, 0.5, 1)] == ["pending", "50.0", "100.0"] and text.percent_or_pending(0.125, sign="%") == "12.5%"
    assert (text.percent_or_pending(0.0005, nudged=True), text.delta(0.123), text.delta(-0.5), text.delta(0.0)) == ("0.1", "+12.3", "-50.0", "+0.0")
    assert [text.csv_value(v) for v in (None, 0.5, 3, "x")] == ["", "0.500000", 3, "x"]


def test_rules_of_exports(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(1,), (2,), (3,)], "id int")
    (r,) = rules.export_mismatch(a, b).collect()
    assert (r.ids_differ, r.counts_differ) == (True, False)
    assert {r.id: r.is_repeat for r in rules.with_repeats(a).collect()} == {1: False, 2: True}
    assert [(r.value, r.n) for r in rules.count_mismatches(a.withColumn("t", F.lit("x")), "t", {"x": 3, "y": 1}).collect()] == [("y", 0)]
