"""Names are cleaned and negatives drawn once a row, whatever reads them."""

from pyspark.sql import functions as F

from millrace.functions.steps import once
from millrace.functions.text import filled
from millrace.operators import audits, claims, curate


def named(df, call):
    return df._jdf.queryExecution().optimizedPlan().toString().count(call)


def test_a_column_is_worked_out_once(spark):
    df = once(spark.range(3).withColumn("b", F.lit("x")), a=F.md5(F.col("id").cast("string")), b=F.upper("b"))
    df = df.select("id", "b", *[F.concat("a", F.lit(str(i))).alias(f"a{i}") for i in range(5)])
    assert named(df, "md5(") == 1
    assert sorted((r.id, r.b) for r in df.collect()) == [(0, "X"), (1, "X"), (2, "X")]


def test_templates(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(filled("%s, %s.", "x", F.col("y")).alias("s")).first().s == "a, null."


def test_negatives_are_drawn_once_and_as_by_weights(spark):
    rows = spark.range(300).select("id", F.explode(F.array(*map(F.lit, [*curate.COLORS, *curate.MATERIALS, "odd"]))).alias("attribute"))
    rows = rows.unionByName(spark.range(1).select("id", F.lit(None).cast("string").alias("attribute")))
    rows = rows.withColumn("kind", F.when(F.col("attribute").isin(curate.COLORS), "color").otherwise("material"))
    options = F.when(F.col("kind") == "color", F.array(*map(F.lit, curate.COLORS))).otherwise(F.array(*map(F.lit, curate.MATERIALS)))
    options = F.transform(F.filter(options, lambda o: o != F.col("attribute")), lambda o: F.struct(o.alias("name")))
    weight = lambda o: F.when(F.concat_ws("|", "attribute", o["name"]).isin([f"{a}|{b}" for a, b in curate.CONFUSABLE]), 0.35).otherwise(1.0)
    got = rows.select(curate.negative_attribute(F.col("kind"), F.col("attribute"), "s", F.col("id")).alias("a"), curate.drawn(options, weight, "s", F.col("id")).alias("b"))
    assert got.where("not a <=> b").count() == 0
    candidates = rows.select(F.col("id").alias("image_id"), F.lit("1").alias("object_id"), F.lit("cats").alias("object"), F.lit(None).cast("array<double>").alias("box"), "kind", "attribute")
    assert named(curate.attribute_pairs(candidates), "md5(") <= 2


def test_claims_are_cleaned_once(spark):
    kind = claims.CLAIMS
    fields = ["negative_type", "chosen_answer", "rejected_answer", "chosen_evidence", "rejected_evidence", "rejected_support"]
    rows = spark.createDataFrame([tuple("abcdef")], ", ".join(f"{x} string" for x in fields)).withColumns({s: F.from_json(F.lit("[]"), kind) for s in ("chosen_claims", "rejected_claims")})
    assert named(audits.claim_marks(rows), "regexp_replace") <= 30
    objects = spark.createDataFrame([(1, "1", "dog", [0.0, 0.0, 1.0, 1.0], ["red"], [("left of", "1")])], "image_id long, object_id string, name string, box array<double>, attributes array<string>, relations array<struct<name:string,object:string>>")
    assert named(curate.attribute_candidates(objects), "regexp_replace") <= 2
    assert named(curate.relation_candidates(objects), "regexp_replace") <= 4


def test_preferences_are_cleaned_once(spark):
    fields = ["id", "source", "task_type", "chosen", "rejected", "hint_chosen", "hint_rejected", "positive", "negative", "object", "subject"]
    rows = spark.createDataFrame([tuple(fields)], ", ".join(f"{x} string" for x in fields)).withColumn("visible", F.array(F.lit("x")))
    assert named(audits.preference_marks(rows), "regexp_replace") <= 20


def test_claims_are_cleaned_together(spark):
    from millrace.functions.text import clean_name, cleaned_together

    odd = ["A_b-C", " a  b ", "", None, "_", "x\ny", "\n", "a.\t b", "ß É", "a - b", "- ", "\r1/2"]
    rows = spark.createDataFrame([(x, odd[i - 3], [x, odd[i - 1]] if i % 3 else [] if i % 2 else None, [odd[i - 2]]) for i, x in enumerate(odd)], "a string, b string, l array<string>, m array<string>")
    together, *cleaned = cleaned_together(F.col("a"), F.col("b"), lists=(F.col("l"), F.col("m")))
    one = lambda x: F.coalesce(clean_name(x), F.lit(""))
    want = [one(F.col("a")), one(F.col("b")), F.coalesce(F.transform("l", one), F.array().cast("array<string>")), F.transform("m", one)]
    got = once(rows, _cleaned=together).select(F.array(*[F.struct(x.eqNullSafe(y).alias("same")) for x, y in zip(cleaned, want)]).alias("s"))
    assert all(x.same for r in got.collect() for x in r.s)
    fields = ["negative_type", "chosen_answer", "rejected_answer", "chosen_evidence", "rejected_evidence", "rejected_support"]
    rows = spark.createDataFrame([tuple("abcdef")], ", ".join(f"{x} string" for x in fields)).withColumns({s: F.from_json(F.lit("[]"), claims.CLAIMS) for s in ("chosen_claims", "rejected_claims")})
    assert named(audits.claim_marks(rows), "regexp_replace") <= 2


def test_marks_are_counted_before_they_are_told_apart(spark):
    rows = spark.createDataFrame([("t", "yes", " No"), ("t", "YES", "no"), ("", "na", None), (None, "", "no"), ("u", "odd", "yes")], "task string, a string, b string")
    out = audits.audit_counts(rows, ["a", "b"], "task")
    got = {(r.level, r.name, r.mark): (r.n_yes, r.n_no, r.n_na, r.n_blank, r.audited, r.rate) for r in out.collect()}
    assert got == {
        ("task", "t", "a"): (2, 0, 0, 0, 2, 1.0), ("task", "t", "b"): (0, 2, 0, 0, 2, 0.0), ("task", "unknown", "a"): (0, 0, 1, 1, 0, 0.0), ("task", "unknown", "b"): (0, 1, 0, 1, 1, 0.0),
        ("task", "u", "a"): (0, 0, 0, 0, 0, 0.0), ("task", "u", "b"): (1, 0, 0, 0, 1, 1.0), ("all", "all", "a"): (2, 0, 1, 1, 2, 1.0), ("all", "all", "b"): (1, 3, 0, 1, 4, 0.25),
    }
    assert named(out, "Aggregate") == 2 and audits.audit_counts(rows.limit(0), ["a", "b"], "task").count() == 0
