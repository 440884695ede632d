"""What must stay cheap on tables of any size: draws are compiled, records are counted before they are told apart."""

from pyspark.sql import functions as F

from millrace.operators import builders, claims, curate, quality, rules, sampling


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_compiled_negatives_are_the_drawn_ones(spark):
    names = F.array(*map(F.lit, [*curate.COLORS, *curate.MATERIALS, "odd"]))
    rows = spark.range(300).select("id", F.explode(F.array_append(names, F.lit(None).cast("string"))).alias("attribute"))
    rows = rows.withColumn("kind", F.when(F.col("attribute").isin(curate.COLORS), "color").otherwise("material"))
    got = curate.with_negatives(rows, "s", "id", "attribute").withColumn("b", curate.negative_attribute(F.col("kind"), F.col("attribute"), "s", F.col("id"), F.col("attribute")))
    assert got.count() == 300 * 25
    assert got.where("not negative <=> b").count() == 0
    assert "lambda" not in plan(curate.with_negatives(rows, "s", "id"))


def test_graphs_may_be_given_an_object_a_row(spark):
    kind = "struct<name:string,x:double,y:double,w:double,h:double,attributes:array<string>,relations:array<struct<name:string,object:string>>>"
    node = ("Red_Dog", 0.0, 0.0, 2.0, 2.0, ["Red"], [("left of", "1")])
    rows = spark.createDataFrame([(1, 4.0, 4.0, "1", node), (1, 4.0, 4.0, "2", ("", *node[1:])), (2, 4.0, None, "1", node)], f"image_id long, width double, height double, object_id string, o {kind}")
    graphs = rows.groupBy("image_id", "width", "height").agg(F.map_from_entries(F.collect_list(F.struct("object_id", "o"))).alias("objects"))
    for with_boxes in (True, False):
        assert sorted(curate.scene_objects(rows, with_boxes).collect()) == sorted(curate.scene_objects(graphs, with_boxes).collect())


def test_wrong_evidence_is_drawn_by_the_stable_key(spark):
    import hashlib

    told = [("s", "attribute", "supported", [("target", "dog", None)], "red", None)]
    pool = [(x, [0.0, 0.0, 1.0, 1.0]) for x in ("cat", "cow", "cup")] + [(None, None)]
    fixed = [c for c in claims.FIELDS if c not in ("id", "chosen_claims", "rejected_claims", "evidence_pool")]
    rows = spark.createDataFrame([(f"r{i}", *fixed, told, told, pool) for i in range(40)], f"id string, {', '.join(f'{c} string' for c in fixed)}, chosen_claims {claims.CLAIMS}, rejected_claims {claims.CLAIMS}, evidence_pool {claims.POOL}")
    got = {r.source_record_id: r.rejected_claims[0].evidence[0].label for r in claims.wrong_evidence_claims(rows).collect()}
    key = lambda i, x: hashlib.md5("|".join(["wrong", i, *([] if x is None else [x])]).encode()).hexdigest()
    assert got == {f"r{i}": min((x for x, _ in pool), key=lambda x: key(f"r{i}", x)) for i in range(40)}


def test_summaries_count_records_before_they_explode(spark):
    fields = ["task_type", "base_task_type", "negative_type", "source", "answer_rejected", "chosen_answer", "rejected_answer"]
    row = lambda *v: (*v, [("s", "t", "u", [("target", "x", None)], None, None)], None)
    rows = spark.createDataFrame([row("a", None, "n", "s", "", "x", "x"), row("a", "b", "n", None, "y", None, "y"), row("c", "", "m", "s", "x", "x", "z")], f"{', '.join(f'{c} string' for c in fields)}, chosen_claims {claims.CLAIMS}, rejected_claims {claims.CLAIMS}")
    out = rules.claim_summary(rows)
    got = {(r.measure, r.name): r.n for r in out.collect()}
    assert got == {
        ("task_type_counts", "a"): 2, ("task_type_counts", "c"): 1, ("base_task_type_counts", ""): 2, ("base_task_type_counts", "b"): 1, ("negative_type_counts", "n"): 2, ("negative_type_counts", "m"): 1,
        ("source_counts", "s"): 2, ("source_counts", None): 1, ("same_answer_rows", ""): 1, ("answer_dpo_identical_rows", ""): 2, ("claims_with_missing_box", ""): 3, ("total", ""): 3,
    }
    assert plan(out).count("Aggregate") == 2 and rules.claim_summary(rows.limit(0)).count() == 0


def test_wrong_evidence_is_drawn_only_where_it_is_read(spark):
    fixed = [c for c in claims.FIELDS if c not in ("chosen_claims", "rejected_claims", "evidence_pool")]
    rows = spark.createDataFrame([], f"{', '.join(f'{c} string' for c in fixed)}, chosen_claims {claims.CLAIMS}, rejected_claims {claims.CLAIMS}, evidence_pool {claims.POOL}")
    wrong = claims.wrong_evidence_claims(rows)
    assert plan(wrong).count("md5(") == 1
    assert "md5(" not in plan(claims.answer_exports(wrong)) and "md5(" not in plan(rules.task_shares(wrong, {"wrong_evidence": (0.1, 0.4)}))


def test_reports_shuffle_no_records(spark):
    rows = [("a", 1, "x.jpg", "long"), ("a", 2, "y.jpg", "long"), ("a", 1, "", "b"), ("", 4, "x.jpg", "long"), (None, None, None, "b"), ("b", None, "x.jpg", "b"), ("b", 7, "y.jpg", "b"), ("b", 9, "y.jpg", "b")]
    rows = spark.createDataFrame(rows, "id string, place long, image string, text string")
    files, by = spark.createDataFrame([("x.jpg",)], "path string"), {"long": F.col("text") == "long"}
    for there in (None, files):
        want = quality.rule_report(rules.checked(rows, "place", there), rules.with_record_rules(by)).collect()
        got = rules.checked_report(rows, "place", by, there)
        assert got.collect() == want and got.schema == quality.rule_report(rules.checked(rows, "place", there), rules.with_record_rules(by)).schema
    assert not any("text" in line for line in plan(got).splitlines() if "Join" in line)


def test_strategy_pairs_read_more_only_where_a_strategy_runs_out(spark):
    from .test_builders import sequential_turns

    rows = [(1, i, 1000 + i, "a", i) for i in range(200)] + [(2 + i, i, i, "a", 200 + i) for i in range(20)] + [(500 + i, i, i, "b", i) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id int, positive int, negative int, strategy string, i int")
    names = []

    def store(df, name):
        names.append((name, df.count()))
        return df.localCheckpoint()

    for n in (3, 12, 70):
        names.clear()
        got = builders.strategy_pairs(df, n, 2, ["i"], store).collect()
        assert sorted((r.turn, r.strategy, r.image_id, r.positive, r.negative) for r in got) == sequential_turns(rows, n, 2)
        assert len({k for k, _ in names if k.startswith("first")}) == (2 if n == 12 else 1)
    names.clear()
    builders.strategy_pairs(df, 3, 2, ["i"], store)
    assert max(n for _, n in names) <= 2 * (8 * 3 + 1)


def test_unique_pairs_are_written_once_and_without_their_rank(spark):
    rows = [(i, i * 7 % 40, 100 + i * 11 % 60, "x") for i in range(300)]
    written = []

    def store(df, name):
        written.append((name, df.columns, df.count()))
        return df.localCheckpoint()

    got = sampling.unique_pairs(spark.createDataFrame(rows, "i int, a int, b int, t string"), "a", "b", ["i"], store)
    used, want = set(), []
    for i, a, b, t in rows:
        if not {a, b} & used:
            used |= {a, b}
            want.append((i, a, b, t))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert all(c == ["i", "a", "b", "t"] for _, c, _ in written) and sum(n for _, _, n in written) <= 300 + 300


def test_raw_rows_are_worked_on_by_many_tasks_and_joined_by_what_is_kept(spark):
    from millrace.operators import raw
    from millrace.plans import files

    from .conftest import SF

    rows = files._raw_rows(spark, SF)
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    plans = {}

    def store(df, name):
        plans[name] = plan(df)
        return df.localCheckpoint()

    raw.raw_detections(rows, "c_custkey", "v", F.create_map(F.lit("18"), F.lit("dog")), store)
    project, join = plans["rows"].splitlines()[:2]
    assert "Join" in join and "variant" not in project and "regexp" not in project  # all work on rows is done before the join


def test_names_of_classes_are_cleaned_before_boxes_are_joined(spark):
    images = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 10.0)], "image_id long, width double, height double")
    boxes = spark.createDataFrame([(1, 1, 5.0, 5.0, None, 0), (1, 2, 6.0, 5.0, 0.0, None), (2, 1, 1.0, 1.0, 0.5, 0), (2, 3, 9.0, 9.0, None, 0)], "image_id long, category_id long, w double, h double, area double, iscrowd int")
    names = spark.createDataFrame([(1, "Hot-Dog"), (2, "hot dog")], "category_id long, name string")
    out = curate.visible_objects(images, boxes, names)
    assert [tuple(r) for r in out.collect()] == [(1, "hot dog", 30.0)]
    top = plan(out).split("Join")[0]
    assert "lower(" not in top and "regexp_replace" not in top


def test_probes_are_scored_once_for_all_levels(spark):
    from millrace.operators import metrics

    said = ['{"answer": "yes", "support": "supported"}', "No; claim: a dog; support: wrong", "", None, '{"evidence": "dog", "support": "mismatch"}']
    rows = [(said[i % 5], ["relation_spatial", "x", None, ""][i % 4], "yes", ["supported", "wrong_evidence", "", None][i % 3 if i % 7 else 3], "dog", "a dog", "left", "dog", "cat") for i in range(80)]
    kind = ", ".join(f"{c} string" for c in ("generation", "base_task_type", "target_answer", "target_support", "target_evidence_label", "target_claim", "target_relation", "target_subject", "target_object"))
    scored = metrics.score_probes(spark.createDataFrame(rows, kind))
    out = metrics.probe_levels(scored, ["base_task_type", "target_support"])
    want = [("all", "all", r.asDict()) for r in metrics.probe_metrics(scored).collect()]
    want += [(by, r[by], {k: v for k, v in r.asDict().items() if k != by}) for by in ("base_task_type", "target_support") for r in metrics.probe_metrics(scored, by).collect()]
    got = [(r.level, r.name, {k: v for k, v in r.asDict().items() if k not in ("level", "name")}) for r in out.collect()]
    key = lambda x: x[:2]
    assert len(want) == 1 + 3 + 3 and sorted(got, key=key) == sorted(want, key=key)
    assert plan(out).count("LogicalRDD") == 1 and plan(scored).count("labell") == 0 and plan(scored).count("parse_json") <= 4


def test_negatives_of_object_pairs_are_the_weighted_draw_and_texts_are_made_once(spark):
    import hashlib
    import math

    known = [("dog", "a"), ("cat", "a"), ("fork", "a"), ("cow", "b"), ("book", "b"), ("cup", "b")]
    seen = spark.createDataFrame([(i, n, 10.0 + i) for i in range(80) for n in ("dog", known[1 + i % 5][0])], "image_id long, name string, max_area double")
    out = curate.object_pairs(seen, spark.createDataFrame(known, "name string, grp string"))
    unit = lambda *k: (int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    weight = lambda p, n: (3.0 if dict(known)[p] == dict(known)[n] else 1.0) * (0.35 if n in curate.LOW_CONFIDENCE else 1.0)
    rows = out.collect()
    assert len(rows) == 160
    for r in rows:
        absent = [n for n, _ in known if n not in ("dog", known[1 + r.image_id % 5][0])]
        assert r.negative == max(absent, key=lambda n: math.log(unit("pairs", r.image_id, r.positive, n)) / weight(r.positive, n))
    assert "format_string" not in plan(out) and plan(out).count("LN(") <= 1 + 4


def test_findings_shuffle_no_records(spark):
    rows = [("a", 1, "x"), ("a", 2, "long"), ("a", 1, "b"), ("", 4, "long"), (None, None, "long"), ("b", None, "b"), ("b", 7, "long"), ("b", 9, "b"), ("c", 3, "b")]
    rows, by, says = spark.createDataFrame(rows, "id string, place long, text string").withColumn("image", F.lit("x.jpg")), {"long": F.col("text") == "long"}, {"long": "too long"}
    plans = []

    def store(df, name):
        plans.append(plan(df))
        return df.localCheckpoint()

    for limit in (1, 2, 9):
        want, counts = rules.findings(rules.checked(rows, "place"), rules.with_record_rules(by), says, "place", store, limit)
        plans.clear()
        got, n = rules.findings_of(rows, by, says, "place", store, limit)
        order = lambda df: sorted(map(repr, df.collect()))
        assert order(got) == order(want) and n == counts == {"repeated_id": 2, "long": 4, "no_file": 0} and got.columns == want.columns
        assert [k.count("Join") for k in plans] == [0, 1]
        joined = plans[1][plans[1].index("Join"):].splitlines()[1:]
        assert not any("text" in line for line in [*plans[0].splitlines(), *joined] if "Project" in line or "Aggregate" in line)
