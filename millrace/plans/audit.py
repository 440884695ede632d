"""Queries of audits: parts as preference records of three kinds, scene graphs as claim records, both with spoiled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, claims
from .registry import query, read
from .scenes import _SCENES, _TOLD, _records


def _preferences(spark, sf_dir) -> DataFrame:
    """Records of parts: objects, attributes of objects with names of two words, relations, and a kind that isn't known."""
    c, k = F.col, F.col("p_partkey")
    adj, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), adj.alias("adj"), noun.alias("noun"), k.alias("k"))
    kind = F.when(k % 3 == 0, "object_existence").when(k % 37 == 0, "count").when(k % 3 == 1, "attribute_color").otherwise("relation_spatial")
    o, a = F.col("k") % 3 == 0, F.col("k") % 3 == 1
    rows = rows.select("id", "k", F.when(o, "coco").otherwise("gqa").alias("source"), F.expr("k").alias("p_partkey"), "adj", "noun").withColumn("task_type", kind)
    text = lambda obj, att, rel: F.when(o, F.format_string(*obj)).when(a, F.format_string(*att)).otherwise(F.format_string(*rel))
    chosen = text(("Yes, there is a %s.", "noun"), ("The big %s is %s.", "noun", "adj"), ("The red-%s is to the left of the wine glass.", "noun"))
    rejected = text(("Yes, there is a %s.", "adj"), ("The Big_%s is teal.", "noun"), ("The red %s is to the right of the wine glass!", "noun"))
    hint = text(("Evidence hint: Annotated visible object: %s.", "noun"), ("Evidence hint: annotated attribute of big %s: %s.", "noun", "adj"), ("Evidence hint: annotated relation: red %s left wine glass.", "noun"))
    other = text(("Evidence hint: unsupported object: %s is not annotated as visible.", "adj"), ("Evidence hint: mismatched attribute for big %s: teal.", "noun"), ("Evidence hint: contradicted relation: red %s right wine glass.", "noun"))
    return rows.select(
        "id", "k", "source", "task_type", F.when(o, c("noun")).when(a, c("adj")).otherwise("left").alias("positive"), F.when(o, c("adj")).when(a, "teal").otherwise("right").alias("negative"),
        F.when(a, F.concat(F.lit("Big "), "noun")).otherwise("wine-glass").alias("object"), F.concat(F.lit("red "), "noun").alias("subject"), F.array(c("noun"), F.when(c("k") % 19 == 0, c("adj")).otherwise("x")).alias("visible"),
        F.when(c("k") % 7 == 0, "It is here.").otherwise(chosen).alias("chosen"), F.when(c("k") % 11 == 0, F.lit(None)).otherwise(rejected).alias("rejected"), hint.alias("hint_chosen"),
        F.when(c("k") % 5 == 0, F.replace(other, F.lit("Evidence"), F.lit("not"))).when(c("k") % 13 == 0, F.regexp_replace(other, "teal|right|visible", "")).otherwise(other).alias("hint_rejected"),
    )


def _sheet(spark, sf_dir) -> DataFrame:
    """Marks of every second part, some of them filled in before, and of one id that has no record."""
    k = F.col("id")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).where("id % 2 = 0").unionByName(spark.range(1).select((-F.col("id") - 1).alias("id")))
    return rows.select("id", F.when(k % 8 == 0, " Passed ").when(k % 10 == 0, "no").otherwise("").alias("chosen_correct"), F.when(k % 6 == 0, "maybe").alias("rejected_wrong"), F.lit(" ").alias("hint_correct"))


def _completed(spark, sf_dir) -> DataFrame:
    return audits.completed(_sheet(spark, sf_dir), audits.preference_marks(_preferences(spark, sf_dir)), audits.PREFERENCE_MARKS)


_WHY = "list_filter([CASE WHEN NOT a THEN CASE kind WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END END, CASE WHEN NOT b THEN CASE kind WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END END, CASE WHEN NOT c THEN CASE kind WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END END], lambda x: x IS NOT NULL)"
_WHY = _WHY.format(*[r[i] for i in range(3) for r in (audits.OBJECT_REASONS, audits.ATTRIBUTE_REASONS, audits.RELATION_REASONS)])
_MARKED = f"""q AS (SELECT p_partkey AS id, p_partkey AS k, p_partkey % 3 AS kind, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_partkey % 3 <> 0 AND p_partkey % 37 = 0 AS unknown FROM part),
m0 AS (SELECT *, NOT unknown AND k % 7 <> 0 AS a, NOT unknown AND k % 11 <> 0 AND (kind <> 0 OR (k % 19 <> 0 AND adj <> noun)) AS b, NOT unknown AND k % 13 <> 0 OR (NOT unknown AND k % 5 = 0) AS c FROM q),
m1 AS (SELECT *, CASE WHEN unknown THEN ['unsupported GQA task_type: count'] ELSE {_WHY} END AS reasons FROM m0),
s AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT -1),
f AS (SELECT s.id, m1.id IS NOT NULL AS has_record, CASE WHEN s.id % 8 = 0 THEN ' Passed ' WHEN s.id % 10 = 0 THEN 'no' WHEN m1.id IS NULL THEN '' WHEN a THEN 'yes' ELSE 'no' END AS chosen_correct,
  CASE WHEN s.id % 6 = 0 THEN 'maybe' WHEN m1.id IS NULL THEN NULL WHEN b THEN 'yes' ELSE 'no' END AS rejected_wrong, CASE WHEN m1.id IS NULL THEN ' ' WHEN c THEN 'yes' ELSE 'no' END AS hint_correct, reasons FROM s LEFT JOIN m1 ON s.id = m1.id)"""


@query(f"WITH {_MARKED} SELECT id, has_record, chosen_correct, rejected_wrong, hint_correct, array_to_string(reasons, '; ') AS reasons FROM f")
def preference_audit(spark, sf_dir):
    """A sheet of preference records with its empty marks filled in, and the reasons of every no."""
    return _completed(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "; "))


@query(
    f"""WITH {_MARKED}, u AS (SELECT 'chosen_correct' AS mark, lower(trim(chosen_correct)) AS v, 0.85::DOUBLE AS threshold FROM f WHERE has_record UNION ALL SELECT 'rejected_wrong', lower(trim(rejected_wrong)), 0.9::DOUBLE FROM f WHERE has_record
  UNION ALL SELECT 'hint_correct', lower(trim(hint_correct)), 0.9::DOUBLE FROM f WHERE has_record),
n AS (SELECT mark, threshold, count(*) FILTER (WHERE v IN ('yes', 'passed')) AS n_yes, count(*) FILTER (WHERE v = 'no') AS n_no, count(*) FILTER (WHERE v = 'maybe') AS n_blank FROM u GROUP BY ALL)
SELECT *, round(n_yes::DOUBLE / (n_yes + n_no), 4) AS rate, round(n_yes::DOUBLE / (n_yes + n_no), 4) >= threshold AS passes FROM n"""
)
def audit_thresholds(spark, sf_dir):
    """Shares of yes among the marks against what they must reach."""
    return audits.audit_summary(_completed(spark, sf_dir))


def _claims(spark, sf_dir) -> DataFrame:
    """Claim records with what a sheet shows of them; a number from the id spoils it in seven ways."""
    c = F.col
    records = _records(spark, sf_dir)
    rows = records.unionByName(claims.wrong_evidence_claims(records)).withColumn("j", F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 9)
    shown = lambda side: claims.compact_evidence(F.get(side, F.lit(0)))
    return rows.select(
        "id", "task_type", "negative_type", "chosen_claims", "rejected_claims", F.when(c("j") == 1, "Yes.").otherwise(c("chosen_answer")).alias("chosen_answer"), F.when(c("j") == 2, "No.").otherwise(c("rejected_answer")).alias("rejected_answer"),
        F.when(c("j") == 3, "").otherwise(shown("chosen_claims")).alias("chosen_evidence"), F.when(c("j") == 6, "label=unicorn").otherwise(shown("rejected_claims")).alias("rejected_evidence"),
        F.when(c("j") == 4, "").when(c("j") == 5, "supported").otherwise(F.get("rejected_claims", F.lit(0))["support"]).alias("rejected_support"),
    )


_CLAIM_MARKED = f"""{_SCENES}, {_TOLD}, z AS MATERIALIZED (SELECT id, task_type, false AS wrong FROM c UNION ALL SELECT id || '_wrong', 'wrong_evidence', true FROM w),
j AS (SELECT *, CAST('0x' || substr(md5(id), 1, 6) AS BIGINT) % 9 AS j FROM z),
k AS (SELECT *, CASE j WHEN 1 THEN 'no' ELSE 'yes' END AS chosen_answer_correct, CASE WHEN wrong THEN 'na' WHEN j = 2 THEN 'no' ELSE 'yes' END AS rejected_answer_wrong, CASE j WHEN 3 THEN 'no' ELSE 'yes' END AS chosen_evidence_correct,
  CASE WHEN j IN (5, 6) THEN 'no' ELSE 'yes' END AS rejected_error_correct FROM j)"""


@query(
    f"""WITH {_CLAIM_MARKED} SELECT id, chosen_answer_correct, rejected_answer_wrong, chosen_evidence_correct, rejected_error_correct,
  CASE WHEN chosen_answer_correct = 'no' THEN '{audits.CLAIM_REASONS[0]}' WHEN rejected_answer_wrong = 'no' THEN '{audits.CLAIM_REASONS[1]}' WHEN chosen_evidence_correct = 'no' THEN '{audits.CLAIM_REASONS[2]}'
    WHEN rejected_error_correct = 'no' THEN '{audits.CLAIM_REASONS[3]}' ELSE '' END AS reasons FROM k"""
)
def claim_audit(spark, sf_dir):
    """Marks of claim records and their wrong-evidence variants, with reasons."""
    return audits.claim_marks(_claims(spark, sf_dir)).select("id", *audits.CLAIM_MARKS, F.array_join("reasons", "; ").alias("reasons"))


@query(
    f"""WITH {_CLAIM_MARKED}, u AS (SELECT task_type AS name, mark, value FROM k UNPIVOT (value FOR mark IN (chosen_answer_correct, rejected_answer_wrong, chosen_evidence_correct, rejected_error_correct))),
g AS (SELECT 'task_type' AS level, name, mark, value FROM u UNION ALL SELECT 'all', 'all', mark, value FROM u),
n AS (SELECT level, name, mark, count(*) FILTER (WHERE value = 'yes') AS n_yes, count(*) FILTER (WHERE value = 'no') AS n_no, count(*) FILTER (WHERE value = 'na') AS n_na, 0::BIGINT AS n_blank FROM g GROUP BY level, name, mark)
SELECT *, n_yes + n_no AS audited, CASE WHEN n_yes + n_no = 0 THEN 0.0::DOUBLE ELSE round(n_yes::DOUBLE / (n_yes + n_no), 6) END AS rate FROM n"""
)
def claim_audit_counts(spark, sf_dir):
    """Marks counted over all records and by task."""
    return audits.audit_counts(audits.claim_marks(_claims(spark, sf_dir)), audits.CLAIM_MARKS, "task_type")
