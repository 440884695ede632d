import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry, parse, text
from millrace.operators import claims, curate, evalsets, export, quality, rules, sampling
from millrace.plans.store import table_store
from millrace.sources import files


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_predictions(spark):
    said = ["", None, "Yes!", "nope", "I can't tell", "the dog is not visible", "there is not a dog", "there isn't a dog", "  NO\nway", "so yes", "there are no dogs"]
    want = ["other", "other", "yes", "no", "refusal", "yes", "yes", "other", "no", "yes", "no"]
    assert column(spark, said, parse.parse_prediction) == want


def test_support_and_answers(spark):
    assert column(spark, ["Supported", "not supported", "wrong-evidence", "", None, "a mismatch", "dunno"], parse.normalize_support) == [
        "supported", "contradicted", "wrong_evidence", "unknown", "unknown", "wrong_evidence", "dunno",
    ]
    assert column(spark, ["Y", "0", "I say nope", "maybe"], parse.normalize_answer) == ["yes", "no", "no", "maybe"]


def generations(spark, said):
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").withColumn("v", parse.json_object(F.col("t")))
    rows = df.select("i", parse.parse_generation(F.col("t"), F.col("v")).alias("p")).select("i", "p.*").orderBy("i").collect()
    return [(r.answer, r.claim, r.evidence_label, r.support, r.relation, r.json_valid, r.parse_failed) for r in rows]


def test_generations_as_json(spark):
    said = {
        '{"answer": true, "support": "match"} trailing': ("yes", "", "", "supported", "answer true support match trailing", True, False),
        '{"answer":"No.","claim":"A-dog","evidence_label":"","evidence":"Dog","relation":"to the left"}': ("no", "a dog", "dog", "unknown", "left_of", True, False),
        '{"answer":0,"claim":null,"evidence":[],"support":false}': ("", "", "", "unknown", "answer0claimnullevidencesupportfalse", True, False),
        '{"answer":1,"evidence":["a","b"],"claim":{"x":"left"}}': ("yes", "x left", "a b", "unknown", "left_of", True, False),
        "{}": ("", "", "", "unknown", "", True, False),
        '{"a":1} {"b":2}': ("", "", "", "unknown", "a1 b2", False, True),
        '{"a":1}] x}': ("", "", "", "unknown", "a1 x", False, True),
        '{"a":1}} {"b":"yes"}': ("yes", "", "", "unknown", "a1 byes", False, False),
        '{"a":1},{"b":2}': ("", "", "", "unknown", "a1b2", False, True),
        "{'answer': 'yes'}": ("yes", "", "", "unknown", "answer yes", False, False),
        '[{"answer":"no"}]': ("no", "", "", "unknown", "answerno", True, False),
    }
    assert dict(zip(said, generations(spark, list(said)))) == said


def test_generations_as_text(spark):
    said = {
        "Claim: a dog; Evidence: dog, it does not match": ("", "a dog", "dog", "wrong_evidence", "a dog", False, False),
        "Yeah. Evidence-label = 'Cat'\nSupport: unsupported": ("yes", "", "cat", "contradicted", "yeah evidence label catsupport unsupported", False, False),
        "hm": ("", "", "", "unknown", "hm", False, True),
        None: ("", "", "", "unknown", "", False, True),
        "nothing left here": ("", "", "", "unknown", "left_of", False, True),
        "preclaim: on the right, relation: above": ("", "on the right", "", "unknown", "above", False, False),
        "reclaim= left cat": ("", "left cat", "", "unknown", "left_of", False, False),
        "claim: \"quoted\" ": ("", "quoted", "", "unknown", "quoted", False, False),
        "it is correct": ("", "", "", "supported", "it is correct", False, False),
        "support: dunno": ("", "", "", "dunno", "support dunno", False, False),
        "relation: left": ("", "", "", "unknown", "left_of", False, True),
        "I say NOPE": ("no", "", "", "unknown", "i say nope", False, False),
    }
    assert dict(zip(said, generations(spark, list(said)))) == {k: v for k, v in said.items()}


def test_a_key_given_twice(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert generations(spark, ['{"answer":"no","answer":"yes"}'])[0][0] == "yes"
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_names(spark):
    assert column(spark, ["Traffic_Light", "hot-dog!", "a\nb", "  x  y "], text.clean_name) == ["traffic light", "hot dog", "ab", "x y"]
    assert column(spark, ["apple", "dog", "bus", "skis", "cats", "glass"], text.article_phrase) == ["an apple", "a dog", "a bus", "a pair of skis", "cats", "glass"]
    assert column(spark, ["Bus", "scissors", "glass", "dog"], text.be_verb) == ["is", "are", "are", "is"]
    assert column(spark, ["I see a dog", "as shown", "based on it", None], text.has_evidence_cue) == [True, True, False, False]


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 50.0, 10.0), (10.0, 5.0, 0.0, 10.0), (-10.0, 0.0, 20.0, 500.0)], "x double, y double, w double, h double")
    got = [r.b for r in df.select(geometry.normalize_xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(100.0), F.lit(100.0)).alias("b")).collect()]
    assert got == [[0.0, 0.0, 0.5, 0.1], None, [0.0, 0.0, 0.1, 1.0]]


def test_multi_cap_random(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.randrange(6), rng.randrange(5)) for i in range(80)]
    got = {r.i for r in sampling.multi_cap(spark.createDataFrame(rows, "i int, a int, b int"), {"a": 4, "b": 5}, ["i"], table_store(spark)).collect()}
    a, b, want = [0] * 6, [0] * 5, set()
    for i, x, y in rows:
        if a[x] < 4 and b[y] < 5:
            want.add(i)
            a[x] += 1
            b[y] += 1
    assert got == want


GRAPH = "image_id int, width double, height double, objects map<string,struct<name:string,x:double,y:double,w:double,h:double,attributes:array<string>,relations:array<struct<name:string,object:string>>>>"


def graph(spark):
    dog = ("Dog", 0.0, 0.0, 10.0, 10.0, ["silver", "big", "Grey"], [("to the left of", "b"), ("under", "b"), ("near", "b"), ("left", "z")])
    cat = ("cat", 60.0, 0.0, 10.0, 10.0, None, [("to the left of", "a")])
    return spark.createDataFrame([(1, 100.0, 100.0, {"a": dog, "b": cat, "c": ("", 1.0, 1.0, 1.0, 1.0, [], []), "d": ("flat", 1.0, 1.0, 0.0, 1.0, [], [])}), (2, 0.0, 0.0, {"a": dog})], GRAPH)


def test_scene_graph(spark):
    objects = curate.scene_objects(graph(spark))
    assert sorted((r.image_id, r.object_id, r.name) for r in objects.collect()) == [(1, "a", "dog"), (1, "b", "cat")]
    (one,) = curate.attribute_pairs(curate.attribute_candidates(objects)).collect()
    assert (one.attribute, one.task_type, one.question) == ("gray", "attribute_color", "What color is the dog?") and one.negative in set(curate.COLORS) - {"gray"}
    pairs = curate.relation_pairs(curate.relation_candidates(objects)).collect()
    assert sorted((p.subject, p.relation, p.object) for p in pairs) == [("cat", "left", "dog"), ("dog", "below", "cat"), ("dog", "left", "cat")]
    said = {(p.subject, p.relation): (p.question, p.chosen, p.rejected) for p in pairs}
    assert said["dog", "below"] == ("What is below the cat?", "The dog is below the cat.", "The dog is above the cat.")
    assert said["dog", "left"][0] == "What is to the left of the cat?"
    (kept,) = curate.relation_candidates(objects, check_boxes=True).collect()
    assert (kept.subject, kept.relation, kept.object) == ("dog", "left", "cat")


def test_claims_of_objects_and_wrong_evidence(spark):
    boxes = spark.createDataFrame([(1, "dog", [0.0, 0.0, 0.1, 0.1]), (1, "cat", [0.5, 0.0, 0.6, 0.1]), (2, "dog", [0.0, 0.0, 1.0, 1.0])], "image_id int, name string, box array<double>")
    pairs = spark.createDataFrame([("p1", "1.jpg", 1, "dog", "bus"), ("p2", "2.jpg", 2, "dog", "bus"), ("p3", "2.jpg", 2, "cow", "bus")], "id string, image string, image_id int, positive string, negative string")
    pairs = pairs.withColumns({"question": F.lit("Is there a dog in the image?"), "chosen": F.lit("Yes."), "rejected": F.lit("No.")})
    records = claims.object_claims(pairs, boxes)
    wrong = claims.wrong_evidence_claims(records)
    assert sorted(r.id for r in records.collect()) == ["p1", "p2"]  # no box, no record
    (one,) = wrong.collect()  # image 2 has no other object
    assert (one.id, one.source_record_id, one.chosen_answer, one.rejected_answer, one.answer_rejected) == ("p1_wrong", "p1", "Yes.", "Yes.", "No.")
    assert [(e.role, e.label) for e in one.rejected_claims[0].evidence] == [("target", "cat")] and one.rejected_claims[0].support == "wrong_evidence"
    (text,) = [r.rejected for r in claims.claim_exports(wrong).collect()]
    assert text == "Answer: Yes.\nClaims:\n- type: object\n  claim: dog visible\n  evidence: cat\n  support: wrong_evidence"
    (probe,) = claims.probe_rows(wrong, "rejected_claims", "wrong_evidence").collect()
    assert probe.question.splitlines()[0] == "Visual question: Is there a dog in the image?" and probe.target_evidence_label == "cat"
    broken = wrong.withColumn("rejected_answer", F.lit("x")).withColumn("rejected_claims", F.col("chosen_claims"))
    assert {r.rule for r in quality.rule_report(broken, rules.claim_rules()).where("n_failed > 0").collect()} == {"wrong_evidence_answers", "wrong_evidence_support"}


def test_negatives_follow_their_weights(spark):
    vocabulary = spark.createDataFrame([("dog", "a"), ("cat", "a"), ("fork", "b"), ("bus", "c")], "name string, grp string")
    seen = spark.range(4000).select(F.col("id").alias("image_id"), F.explode(F.array(F.lit("dog"), F.lit("lamp"))).alias("name"), F.lit(5.0).alias("max_area"))
    n = {r.negative: r["count"] for r in curate.object_pairs(seen, vocabulary).where("positive = 'dog'").groupBy("negative").count().collect()}
    share = {k: v / sum(n.values()) for k, v in n.items()}
    assert abs(share["cat"] - 3 / 4.35) < 0.03 and abs(share["fork"] - 0.35 / 4.35) < 0.03 and abs(share["bus"] - 1 / 4.35) < 0.03


def test_error_kinds_and_areas(spark):
    rows = spark.createDataFrame([("no", "yes"), ("yes", "no"), ("yes", "refusal"), ("yes", "yes"), ("maybe", "no"), (None, "yes")], "t string, p string")
    assert [r.k for r in rows.select(evalsets.error_kind(F.col("t"), F.col("p")).alias("k")).collect()] == ["false_positive", "false_negative", "invalid_error", "correct", "correct", "correct"]
    images = spark.createDataFrame([(1, "a.jpg", 10, 10)], "image_id int, file_name string, width int, height int")
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0, 0.0, 0), (1, 2, 0.0, 0.0, 5.0, 5.0, 0.2, 0), (1, 1, 0.0, 0.0, 9.0, 9.0, 81.0, 1)], "image_id int, category_id int, x double, y double, w double, h double, area double, iscrowd int")
    names = spark.createDataFrame([(1, "Dog"), (2, "cat")], "category_id int, name string")
    assert [(r.name, r.max_area) for r in curate.visible_objects(images, boxes, names).collect()] == [("dog", 25.0)]


def test_bootstrap_is_binomial(spark):
    from millrace.operators import metrics

    rows = spark.createDataFrame([("a", int(i < 50)) for i in range(125)] + [("b", 1)] * 9 + [("c", 0)], "g string, v int")
    got = {r.g: r for r in metrics.bootstrap_rate(rows, "v", ["g"], 4000).collect()}
    assert abs(got["a"].se - (0.4 * 0.6 / 125) ** 0.5) < 0.002 and abs(got["a"].low - 0.312) <= 0.009 and abs(got["a"].high - 0.488) <= 0.009
    assert (got["b"].low, got["b"].high, got["b"].se) == (1.0, 1.0, 0.0) and (got["c"].low, got["c"].high) == (0.0, 0.0)


def test_hint_without_prefix_fails(spark):
    df = spark.createDataFrame([("1", "i", "q", "c", "r", "no prefix", "Evidence hint: x")], "id string, image string, question string, chosen string, rejected string, hint_chosen string, hint_rejected string")
    with pytest.raises(Exception, match="lacks its prefix"):
        export.evidence_rows(df).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 1 \n\n2\n")
    (tmp_path / "b.jsonl").write_text('{"image_id": 3, "image": "x/4.jpg"}\n{"image_id": 1}\n')
    (tmp_path / "c.json").write_text('{"image_ids": ["7", "8"]}')
    ids = files.read_id_set(spark, [str(tmp_path / n) for n in ("a.txt", "b.jsonl", "c.json")])
    assert sorted(r.id for r in ids.collect()) == ["1", "2", "3", "7", "8", "x/4.jpg"]
    with pytest.raises(ValueError, match="not written"):
        files.write_guarded(ids, str(tmp_path / "out"), ids)
    files.write_guarded(ids, str(tmp_path / "out"), ids.limit(0))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id string").count() == 6
    assert files.markdown_table(ids.where("id = '7'")) == "| id |\n| --- |\n| 7 |"


def test_stream_of_scores(spark, tmp_path):
    from millrace.streaming.scoring import windowed_accuracy

    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'yes' target, 'Yes.' generation union all select timestamp'2024-01-01 00:02:00', 'no', 'yes' union all select timestamp'2024-01-01 00:31:00', 'no', 'no'").write.json(str(src))
    stream = windowed_accuracy(spark.readStream.schema("ts timestamp, target string, generation string").json(str(src)), "ts")
    q = stream.writeStream.format("memory").queryName("acc").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.n_correct) for r in spark.table("acc").collect()) == [(1, 1), (2, 1)]


def test_unique_pairs_is_the_greedy_pass(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.randrange(25), rng.randrange(25)) for i in range(60)]
    got = {r.i for r in sampling.unique_pairs(spark.createDataFrame(rows, "i int, a int, b int"), "a", "b", ["i"], table_store(spark)).collect()}
    used, want = set(), set()
    for i, a, b in rows:
        if a != b and a not in used and b not in used:
            used |= {a, b}
            want.add(i)
    assert got == want


def test_split_targets_backfill(spark):
    df = spark.createDataFrame([(i, "coco" if i < 20 else "graph") for i in range(24)], "i int, source string")
    got = [r.source for r in sampling.split_targets(df, F.col("source"), {"coco": 5, "graph": 6}, [F.col("i")], table_store(spark), "coco").collect()]
    assert (got.count("coco"), got.count("graph")) == (7, 4)


def test_reports(spark):
    from millrace.operators import metrics

    rows = spark.createDataFrame([("a", 1, 0.2, 0.9), ("b", 2, 0.5, 0.895), ("c", 3, 0.45, 0.8)], "model string, k int, wrong double, short double")
    (t,) = metrics.trend(rows, "k", "wrong").collect()
    assert (t.first, t.last, t.monotonic) == (0.2, 0.45, False)
    assert {r.model: r.passes for r in metrics.passes_gate(rows, "a", "wrong", "short").collect()} == {"a": False, "b": True, "c": False}


def test_record_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"questions": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('[{"id": 3},\n {"id": 4}]')
    (tmp_path / "c.json").write_text('{"id": 5}\n{"id": 6}\n')
    got = [sorted(r.id for r in files.read_records(spark, str(tmp_path / f)).collect()) for f in ("a.json", "b.json", "c.json")]
    assert got == [[1, 2], [3, 4], [5, 6]]
    assert files.read_optional(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    found = files.with_existing_file(spark.createDataFrame([("a.json",), ("z.json",)], "f string"), "f", files.file_manifest(spark, str(tmp_path)))
    assert {r.f: r.file_exists for r in found.collect()} == {"a.json": True, "z.json": False}
    last = files.last_by_id(spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 2)], "id int, v string, n int"), "id", "n")
    assert {r.id: r.v for r in last.collect()} == {1: "y", 2: "z"}
