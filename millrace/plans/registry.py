"""Queries over the driver's tables, one or more for each operator, with the SQL that checks them.

The tables have no images or scene graphs, so operators run on columns that play the same part: parts as objects, orders
as images, suppliers' parts as what an image shows, and generations made by rule from document ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import holds_relation, normalize_xywh
from ..operators import curate, evalsets, export, metrics, quality, sampling

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Generations by rule: every kind of answer the parser knows, by document id.
SAID = [
    "Yes.", "No, there is no dog.", "I am not sure", "The dog is not visible", "Nope", "there isn't a dog", "Yeah, because it is annotated", "I do not see it",
    "", "The answer is no and it goes on for quite a few more words than ten of them", "Well, yes",
]
_SAID_SQL = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{s.replace(chr(39), chr(39) * 2)}'" for i, s in enumerate(SAID)) + " END"


def _generations(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    said = F.element_at(F.array(*[F.lit(s) for s in SAID]), (F.col("doc_id") % 11 + 1).cast("int"))
    return docs.withColumn("target", F.col("quality").cast("string")).withColumn("generation", said)


_PARSED = f"""
g AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, {_SAID_SQL.replace("doc_id", "d.doc_id")} AS generation FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT *, CASE WHEN quality = 1 THEN 'yes' WHEN quality = 0 THEN 'no' END AS target,
        lower(trim(regexp_replace(generation, '\\s+', ' ', 'g'))) AS x FROM g),
s AS (SELECT *, CASE
        WHEN x = '' THEN 'other'
        WHEN regexp_matches(x, '\\b(not sure|unclear|cannot determine|can''t determine|cannot tell|can''t tell|unable to determine|insufficient information|not enough information)\\b') THEN 'refusal'
        WHEN regexp_matches(x, '^[^a-z0-9]*(yes|yeah|yep)\\b') THEN 'yes'
        WHEN regexp_matches(x, '^[^a-z0-9]*(no|nope)\\b') THEN 'no'
        WHEN regexp_matches(x, '\\b(there is no|there are no|do not see|don''t see|cannot see|can''t see)\\b') THEN 'no'
        WHEN regexp_matches(x, '\\b(there is|there are|i can see|visible)\\b') THEN 'yes'
        WHEN regexp_matches(x, '\\byes\\b') THEN 'yes'
        WHEN regexp_matches(x, '\\bno\\b') THEN 'no' ELSE 'other' END AS prediction,
      len(regexp_extract_all(generation, '[A-Za-z0-9'']+')) AS n_words,
      regexp_matches(generation, '(?i)\\b(evidence|visible|visually|see|seen|image|picture|photo|shown|because)\\b') AS cue FROM t)"""
_COUNTS = """count(*) AS n, count(*) FILTER (WHERE target = 'yes') AS n_yes, count(*) FILTER (WHERE target = 'no') AS n_no,
  count(*) FILTER (WHERE target = 'yes' AND prediction = 'yes') AS tp, count(*) FILTER (WHERE target = 'no' AND prediction = 'yes') AS fp,
  count(*) FILTER (WHERE target = 'yes' AND prediction <> 'yes') AS fn, count(*) FILTER (WHERE target = 'no' AND prediction = 'no') AS tn,
  count(*) FILTER (WHERE target = 'yes' AND prediction = 'no') AS y2n, count(*) FILTER (WHERE target = prediction) AS n_correct,
  count(*) FILTER (WHERE prediction = 'yes') AS n_pred_yes, count(*) FILTER (WHERE prediction = 'no') AS n_pred_no, count(*) FILTER (WHERE prediction = 'refusal') AS n_refusal,
  count(*) FILTER (WHERE prediction = 'other') AS n_other, count(*) FILTER (WHERE cue) AS n_cue, CAST(sum(n_words) AS BIGINT) AS sum_words, CAST(max(n_words) AS BIGINT) AS max_words,
  count(*) FILTER (WHERE n_words > 10) AS n_long"""


def _r(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


_RATES = f"""r1 AS (SELECT *, {_r('n_correct', 'n')} AS accuracy, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'n_yes')} AS recall,
  {_r('tn', 'n_no')} AS specificity, {_r('tn', 'tn + y2n')} AS negative_precision, {_r('fp', 'n_no')} AS fpr, {_r('fn', 'n_yes')} AS fnr,
  {_r('n_pred_yes', 'n')} AS yes_bias, {_r('n_pred_no', 'n')} AS no_bias, {_r('n_refusal', 'n')} AS refusal_rate, {_r('n_other', 'n')} AS other_rate,
  {_r('n_refusal + n_other', 'n')} AS invalid_rate, {_r('n_cue', 'n')} AS cue_rate, {_r('sum_words', 'n')} AS avg_words, {_r('n_long', 'n')} AS long_rate FROM c),
r2 AS (SELECT *, {_r('2 * precision * recall', 'precision + recall')} AS f1,
  {_r('2 * negative_precision * specificity', 'negative_precision + specificity')} AS negative_f1,
  CASE WHEN n_yes > 0 AND n_no > 0 THEN (recall + specificity) / 2 WHEN n_yes > 0 THEN recall WHEN n_no > 0 THEN specificity ELSE 0.0::DOUBLE END AS balanced_accuracy FROM r1)"""


@query(f"WITH {_PARSED}, c AS (SELECT {_COUNTS} FROM s), {_RATES} SELECT * FROM r2")
def score_binary(spark, sf_dir):
    """Confusion metrics of parsed answers against document quality."""
    return metrics.evaluate(metrics.score_rows(_generations(spark, sf_dir)))


@query(
    f"""WITH {_PARSED}, c AS (
  SELECT 'lang' AS group_field, lang AS group_value, {_COUNTS} FROM s GROUP BY lang HAVING count(*) >= 20
  UNION ALL SELECT 'source', source, {_COUNTS} FROM s GROUP BY source HAVING count(*) >= 20
  UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), {_COUNTS} FROM s GROUP BY toxic HAVING count(*) >= 20), {_RATES} SELECT * FROM r2"""
)
def score_groups(spark, sf_dir):
    """The same by language, source and toxicity, groups of 20 or more."""
    return metrics.evaluate_groups(metrics.score_rows(_generations(spark, sf_dir)), ["lang", "source", "toxic"])


@query(f"WITH {_PARSED} SELECT prediction, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words FROM s GROUP BY prediction")
def prediction_counts(spark, sf_dir):
    return metrics.score_rows(_generations(spark, sf_dir)).groupBy("prediction").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


@query(
    f"""WITH {_PARSED}, e AS (SELECT lang, CASE WHEN target = prediction THEN 'correct' WHEN target = 'no' AND prediction = 'yes' THEN 'false_positive'
  WHEN target = 'yes' AND prediction = 'no' THEN 'false_negative' WHEN target IN ('yes', 'no') THEN 'invalid_error' ELSE 'correct' END AS kind FROM s)
SELECT lang, kind, count(*) AS n FROM e GROUP BY ALL"""
)
def error_kinds(spark, sf_dir):
    rows = metrics.score_rows(_generations(spark, sf_dir))
    return rows.groupBy("lang", evalsets.error_kind(F.col("target"), F.col("prediction")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PARSED}, c AS (SELECT lang, {_COUNTS} FROM s GROUP BY lang), {_RATES}
SELECT lang, metric, value FROM (SELECT lang, accuracy, precision, recall, f1 FROM r2) UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))"""
)
def metrics_long(spark, sf_dir):
    groups = metrics.evaluate_groups(metrics.score_rows(_generations(spark, sf_dir)), ["lang"], min_size=1)
    return metrics.to_long(groups.withColumn("lang", F.col("group_value")), ["lang"], ["accuracy", "precision", "recall", "f1"])


@query("SELECT lang, sum(avg_q * n) / sum(n) AS weighted_rate FROM (SELECT lang, source, avg(quality::DOUBLE) AS avg_q, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY lang")
def weighted_quality(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    rates = rows.groupBy("lang", "source").agg(F.avg(F.col("quality").cast("double")).alias("q"), F.count("*").alias("n"))
    return metrics.weighted_rate(rates, "q", "n", ["lang"])


_MODELS = """m AS (SELECT l.doc_id, d.lang, v.model, CASE v.model WHEN 'base' THEN l.doc_id % 3 <> 0 WHEN 'answer' THEN l.doc_id % 4 <> 0 ELSE l.doc_id % 7 <> 0 END AS ok
  FROM labels l JOIN documents d USING (doc_id), (VALUES ('base'), ('answer'), ('dual')) AS v(model) WHERE NOT (v.model = 'dual' AND l.doc_id % 10 = 0))"""


@query(
    f"""WITH {_MODELS}, f AS (SELECT doc_id, bool_or(ok) FILTER (model = 'base') AS base_ok FROM m GROUP BY doc_id HAVING count(DISTINCT model) = 3),
c AS (SELECT model, lang, count(*) AS n, count(*) FILTER (WHERE ok) AS n_correct, count(*) FILTER (WHERE base_ok) AS n_base_correct, count(*) FILTER (WHERE NOT base_ok AND ok) AS n_recovered,
        count(*) FILTER (WHERE base_ok AND NOT ok) AS n_lost FROM m JOIN f USING (doc_id) GROUP BY ALL)
SELECT *, n_correct::DOUBLE / n AS accuracy, (n_correct - n_base_correct)::DOUBLE / n AS delta FROM c"""
)
def compare_models(spark, sf_dir):
    """Three models by rule: accuracy on common rows, and what each mends of the base model's errors."""
    rows = read(spark, sf_dir, "labels").select("doc_id").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("model", F.explode(F.array(F.lit("base"), F.lit("answer"), F.lit("dual")))).where("not (model = 'dual' and doc_id % 10 = 0)")
    ok = F.when(F.col("model") == "base", F.col("doc_id") % 3 != 0).when(F.col("model") == "answer", F.col("doc_id") % 4 != 0).otherwise(F.col("doc_id") % 7 != 0)
    return metrics.compare_models(rows.withColumn("is_correct", ok), "doc_id", "model", "base", ["lang"])


def bootstrap_sql(keys: list[str], draws: int) -> str:
    """CTEs from ``g`` (keys, n, mean) to ``boot``: keys, n, mean, se, low and high of the means of resampled 0/1 values."""
    by, said = ", ".join(keys), " || '|' || ".join(keys)
    return f"""b AS (SELECT *, sqrt(n * mean * (1 - mean)) AS sd, n * mean AS mid FROM g),
r AS (SELECT *, CASE WHEN sd = 0 THEN CAST(round(mid) AS BIGINT) ELSE greatest(0, CAST(floor(mid - 40 * sd - 10) AS BIGINT)) END AS lo,
  CASE WHEN sd = 0 THEN CAST(round(mid) AS BIGINT) ELSE least(n, CAST(ceil(mid + 40 * sd + 10) AS BIGINT)) END AS hi FROM b),
k AS (SELECT *, unnest(range(lo, hi + 1)) AS k FROM r),
l AS (SELECT *, sum(CASE WHEN k > lo THEN ln((n - k + 1)::DOUBLE / k::DOUBLE) + ln(mean / (1 - mean)) ELSE 0.0::DOUBLE END) OVER (PARTITION BY {by} ORDER BY k) AS l FROM k),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY {by})) AS w FROM l),
c AS (SELECT {by}, lo, sum(w) OVER (PARTITION BY {by} ORDER BY k) / sum(w) OVER (PARTITION BY {by}) AS v, 0 AS draw FROM w),
d AS (SELECT {by}, lo, (CAST('0x' || substr(md5('boot|' || {said} || '|' || b), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS v, 1 AS draw FROM r, (SELECT unnest(range(0, {draws})) AS b)),
x AS (SELECT *, sum(1 - draw) OVER (PARTITION BY {by} ORDER BY v, draw DESC ROWS UNBOUNDED PRECEDING) AS below FROM (SELECT * FROM c UNION ALL SELECT * FROM d)),
y AS (SELECT {", ".join(f"x.{key}" for key in keys)}, g.n, g.mean, least(x.lo + below, r.hi)::DOUBLE / g.n AS drawn FROM x JOIN g USING ({by}) JOIN r USING ({by}) WHERE draw = 1),
boot AS (SELECT {by}, n, mean, stddev_samp(drawn) AS se, quantile_cont(drawn, 0.025) AS low, quantile_cont(drawn, 0.975) AS high FROM y GROUP BY {by}, n, mean)"""


@query(f"WITH g AS (SELECT d.lang, count(*) AS n, avg(quality::DOUBLE) AS mean FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang), {bootstrap_sql(['lang'], 200)} SELECT * FROM boot")
def bootstrap_quality(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.bootstrap_rate(rows, "quality", ["lang"], 200)


_CLEAN = "trim(regexp_replace(regexp_replace(translate(lower({0}), '_-', '  '), '[^a-z0-9 /]+', '', 'g'), ' +', ' ', 'g'))"
_PLURAL = "(x LIKE '%s' AND x <> 'bus')"
_PHRASE = f"CASE WHEN x IN ('scissors', 'skis') THEN 'a pair of ' || x WHEN {_PLURAL} THEN x WHEN substr(x, 1, 1) IN ('a','e','i','o','u') THEN 'an ' || x ELSE 'a ' || x END"


@query(f"WITH n AS (SELECT p_partkey, {_CLEAN.format('p_name')} AS x FROM part) SELECT p_partkey, x AS name, {_PHRASE} AS phrase, CASE WHEN {_PLURAL} THEN 'are' ELSE 'is' END AS verb, replace(replace(x, '/', ' '), ' ', '_') AS slug FROM n")
def clean_names(spark, sf_dir):
    name = text.clean_name(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", text.article_phrase(F.col("name")).alias("phrase"), text.be_verb(F.col("name")).alias("verb"), text.slug(F.col("name")).alias("slug"))


@query(
    r"""SELECT lang, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^\pL\pN_\s]'))) AS BIGINT) AS tokens,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+'))) AS BIGINT) AS words, count(*) AS n FROM documents GROUP BY lang"""
)
def token_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(text.token_count(F.col("text"))).alias("tokens"), F.sum(text.word_count(F.col("text"))).alias("words"), F.count("*").alias("n"))


# Probe answers in odd forms, and what must be read from each: answer, claim, evidence label, support, relation, all that is
# said of claim and evidence, whether it is JSON, whether nothing was found.
PROBE_SAID = [
    ('Sure: {"answer": "Yes", "claim": "a dog", "evidence_label": "dog", "support": "Supported", "relation": "left of"}', "yes", "a dog", "dog", "supported", "left_of", "a dog dog", True, False),
    ('{"answer": false, "claim": "a dog and a cat", "evidence": "the dog", "support": "not supported"}', "", "a dog and a cat", "the dog", "contradicted", "a dog and a cat", "a dog and a cat the dog", True, False),
    ('{"answer": 1, "evidence_label": "", "evidence": "Cat", "support": "wrong-evidence", "relation": 0}', "yes", "", "cat", "wrong_evidence", "cat", "cat", True, False),
    ('{"answer": ["no"], "claim": null, "support": "mismatch, clearly"}', "no", "", "", "wrong_evidence", "answer no claim null support mismatch clearly", "", True, False),
    ('{"a": 1} then {"b": 2}', "", "", "", "unknown", "a 1 then b 2", "", False, True),
    ("Answer: no; claim = dog left of cat; support: contradiction", "no", "dog left of cat", "", "contradicted", "left_of", "dog left of cat", False, False),
    ("Evidence label: hot-dog, Evidence: 'a cat'", "", "", "hot dog", "unknown", "a cat", "a cat hot dog", False, False),
    ("It does not match, on the right", "", "", "", "wrong_evidence", "right_of", "", False, False),
    ("hm", "", "", "", "unknown", "hm", "", False, True),
    ("", "", "", "", "unknown", "", "", False, True),
    ("Yeah it is correct", "yes", "", "", "supported", "yeah it is correct", "", False, False),
    ("{}", "", "", "", "unknown", "", "", True, False),
    ("proclaim: dog; relation: Right", "", "dog", "", "unknown", "right_of", "dog", False, False),
]
_PROBE_ROWS = ", ".join("(" + ", ".join([str(k), *("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() for v in r[1:])]) + ")" for k, r in enumerate(PROBE_SAID))


@query(
    f"""WITH said(k, answer, claim, label, support, relation, said, valid, failed) AS (VALUES {_PROBE_ROWS}),
e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'relation_spatial' WHEN 1 THEN 'object_existence' WHEN 2 THEN 'attribute_color' END AS base_task_type,
  CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'wrong_evidence' ELSE '' END AS target_support, CASE WHEN event_id % 7 < 4 THEN 'yes' ELSE 'no' END AS target_answer,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'dog' END AS target_label, CASE WHEN event_id % 5 = 1 THEN '' ELSE 'a dog' END AS target_claim, CASE WHEN event_id % 11 < 8 THEN 'left_of' ELSE '' END AS target_relation,
  CASE WHEN event_id % 5 = 2 THEN '' ELSE 'cat' END AS target_object, s.* FROM events JOIN said s ON s.k = event_id % {len(PROBE_SAID)}),
p AS (SELECT *, answer = target_answer AS ok_answer, support = CASE target_support WHEN '' THEN 'unknown' ELSE target_support END AS ok_support, coalesce(base_task_type = 'relation_spatial', false) AS rel,
  CASE WHEN base_task_type = 'relation_spatial' THEN target_object <> '' AND contains(said, 'dog') AND contains(said, target_object) ELSE target_label <> '' AND contains(label, target_label) END AS ok_evidence,
  target_claim <> '' AND (contains(target_claim, claim) OR contains(claim, target_claim)) AS ok_claim, target_relation <> '' AND relation = target_relation AS ok_relation,
  target_support = 'wrong_evidence' AS wrong, target_support = 'wrong_evidence' AND support IN ('wrong_evidence', 'contradicted', 'unsupported') AS rejected FROM e),
g AS (SELECT *, 'all' AS level, 'all' AS name FROM p UNION ALL SELECT *, 'base_task_type', coalesce(base_task_type, 'unknown') FROM p UNION ALL SELECT *, 'target_support', CASE target_support WHEN '' THEN 'unknown' ELSE target_support END FROM p),
c AS (SELECT level, name, count(*) AS n, count(*) FILTER (WHERE ok_answer) AS n_answer, count(*) FILTER (WHERE ok_support) AS n_support, count(*) FILTER (WHERE ok_evidence) AS n_evidence, count(*) FILTER (WHERE ok_claim) AS n_claim,
  count(*) FILTER (WHERE wrong) AS n_wrong, count(*) FILTER (WHERE rejected) AS n_rejected, count(*) FILTER (WHERE rel) AS n_relation, count(*) FILTER (WHERE rel AND ok_relation) AS n_direction,
  count(*) FILTER (WHERE NOT valid) AS n_invalid_json, count(*) FILTER (WHERE failed) AS n_parse_failed FROM g GROUP BY level, name)
SELECT *, round(n_answer::DOUBLE / n, 6) AS answer_accuracy, round(n_support::DOUBLE / n, 6) AS support_accuracy, round(n_evidence::DOUBLE / n, 6) AS evidence_label_accuracy, round(n_claim::DOUBLE / n, 6) AS claim_match_rate,
  round(n_rejected::DOUBLE / CASE level WHEN 'all' THEN n_wrong ELSE n END, 6) AS wrong_evidence_rejection_accuracy, CASE WHEN n_relation = 0 THEN 0.0::DOUBLE ELSE round(n_direction::DOUBLE / n_relation, 6) END AS relation_direction_accuracy,
  round(n_invalid_json::DOUBLE / n, 6) AS invalid_json_rate, round(n_parse_failed::DOUBLE / n, 6) AS parse_failure_rate FROM c"""
)
def probe_metrics(spark, sf_dir):
    """All measures of probe answers in odd forms: over all rows, by kind of question and by the support they should name."""
    return metrics.probe_levels(_scored_probes(spark, sf_dir), ["base_task_type", "target_support"])


def _scored_probes(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    tasks = spark.sparkContext.defaultParallelism * 4  # ids are few bytes and much work: a file is one task otherwise
    return metrics.score_probes(read(spark, sf_dir, "events").select(k).repartition(tasks, "event_id").select(
        k, pick(len(PROBE_SAID), *[r[0] for r in PROBE_SAID]).alias("generation"), pick(4, "relation_spatial", "object_existence", "attribute_color", None).alias("base_task_type"),
        pick(3, "supported", "wrong_evidence", "").alias("target_support"), F.when(k % 7 < 4, "yes").otherwise("no").alias("target_answer"), F.when(k % 5 == 0, "").otherwise("dog").alias("target_evidence_label"),
        F.when(k % 5 == 1, "").otherwise("a dog").alias("target_claim"), F.when(k % 11 < 8, "left_of").alias("target_relation"), F.lit("dog").alias("target_subject"), F.when(k % 5 != 2, "cat").alias("target_object"),
    ))


@query(
    f"""WITH said(k, answer, claim, label, support, relation, said, valid, failed) AS (VALUES {_PROBE_ROWS})
SELECT support AS predicted_support, count(*) AS n FROM events JOIN said ON k = event_id % {len(PROBE_SAID)} GROUP BY support"""
)
def probe_supports(spark, sf_dir):
    """How often each support is named."""
    return metrics.predicted_supports(_scored_probes(spark, sf_dir))


def _answered(spark, sf_dir) -> DataFrame:
    """Relation probes with wrong evidence, answered by three models; one of them leaves some out."""
    k, n = F.col("event_id"), len(PROBE_SAID)
    rows = read(spark, sf_dir, "events").where("event_id % 3 = 0").select(k, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model")) for i, m in enumerate(("base", "answer", "dual"))])).alias("m"))
    rows = rows.select(k.alias("id"), "m.model", F.element_at(F.array(*[F.lit(r[0]) for r in PROBE_SAID]), ((k + F.col("m.i") * 5) % n + 1).cast("int")).alias("generation")).where("not (model = 'dual' and id % 10 = 0)")
    claim = F.when(F.col("id") % 4 == 0, "a cat left_of a dog").otherwise("a dog left_of a cat")
    question = F.concat(F.lit("Visual question: q\nCandidate claim: "), claim, F.lit("\nCandidate evidence:  subject=dog;  object=cat "))
    return metrics.score_probes(rows.withColumns({
        "base_task_type": F.when(F.col("id") % 7 == 0, "attribute_color").otherwise("relation_spatial"), "target_support": F.lit("wrong_evidence"), "target_answer": F.lit("yes"), "target_evidence_label": F.lit(None).cast("string"), "question": question,
        "target_claim": claim, "target_relation": F.when(F.col("id") % 5 == 0, "above").otherwise("left_of"), "target_subject": F.lit("dog"), "target_object": F.lit("cat"),
    }))


_CASES = f"""said(k, answer, claim, label, support, relation, said, valid, failed) AS (VALUES {_PROBE_ROWS}),
a AS (SELECT event_id AS id, max(s.support) FILTER (s.k = event_id % {len(PROBE_SAID)}) AS base, max(s.support) FILTER (s.k = (event_id + 5) % {len(PROBE_SAID)}) AS answer, max(s.support) FILTER (s.k = (event_id + 10) % {len(PROBE_SAID)}) AS dual
  FROM events, said s WHERE event_id % 3 = 0 AND event_id % 7 <> 0 AND event_id % 10 <> 0 GROUP BY event_id),
r AS (SELECT *, base IN ('wrong_evidence', 'contradicted') AS rb, answer IN ('wrong_evidence', 'contradicted') AS ra, dual IN ('wrong_evidence', 'contradicted') AS rd FROM a),
k AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'a cat left_of a dog' ELSE 'a dog left_of a cat' END AS claim, CASE WHEN id % 4 = 0 THEN 'subject/object swap' WHEN dual = 'supported' THEN 'copied candidate evidence without verification'
  WHEN id % 5 = 0 THEN 'candidate relation text under-specified' ELSE 'left/right ambiguity' END AS category,
  CASE WHEN rb THEN 'reject/' ELSE 'accept/' END || base AS base_mark, CASE WHEN ra THEN 'reject/' ELSE 'accept/' END || answer AS answer_mark, CASE WHEN rd THEN 'reject/' ELSE 'accept/' END || dual AS dual_mark, rb, ra, rd FROM r),
b AS (SELECT *, CASE WHEN rd THEN '{evalsets.DUAL_REJECTS}' ELSE '{evalsets.DUAL_ACCEPTS}' END AS bucket FROM k UNION ALL SELECT *, '{evalsets.ALL_FAIL}' FROM k WHERE NOT rb AND NOT ra AND NOT rd UNION ALL SELECT *, '{evalsets.DUAL_ALONE}' FROM k WHERE NOT ra AND rd)"""


@query(
    f"""WITH {_CASES} SELECT id, bucket, 'Visual question: q Candidate claim: ' || claim || ' Candidate evidence: subject=dog; object=cat' AS question, claim, 'subject=dog; object=cat' AS candidate_evidence, category, base_mark, answer_mark, dual_mark
FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5('cases|' || id), id) <= 12"""
)
def failure_cases(spark, sf_dir):
    """Cases in which three models are compared, a few of each kind."""
    cases = evalsets.failure_cases(_answered(spark, sf_dir), "model", ("base", "answer", "dual"))
    order = [sampling.stable_key("cases", F.col("id")), F.col("id")]
    return evalsets.sampled_cases(cases, 12, order).drop("base_generation", "answer_generation", "dual_generation")


def _key(seed: str, column: str) -> str:
    return f"md5('{seed}|' || CAST({column} AS VARCHAR))"


@query(f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('cap', 'o_orderkey')}, o_orderkey) <= 2")
def capped_per_key(spark, sf_dir):
    order = [sampling.stable_key("cap", F.col("o_orderkey")), F.col("o_orderkey")]
    return sampling.capped_per_key(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 2, order)


@query(
    f"""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('cap', 'o_orderkey')}, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('cap', 'o_orderkey')}, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT o_custkey, count(*) AS used FROM a WHERE r <= 3 GROUP BY o_custkey)
SELECT o_custkey, o_orderkey, 1 AS pass FROM a WHERE r <= 3 UNION ALL
SELECT b.o_custkey, o_orderkey, 2 FROM b LEFT JOIN u ON b.o_custkey = u.o_custkey WHERE r <= 3 - coalesce(used, 0)"""
)
def shared_cap(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    part = lambda cond: orders.where(cond).select("o_custkey", "o_orderkey")
    order = [sampling.stable_key("cap", F.col("o_orderkey")), F.col("o_orderkey")]
    return sampling.shared_cap(part("o_orderstatus = 'F'"), part("o_orderstatus <> 'F'"), ["o_custkey"], 3, order)


@query(f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_key('rr', 'doc_id')}, doc_id) AS turn FROM documents) SELECT * FROM r ORDER BY turn, lang LIMIT 100")
def round_robin(spark, sf_dir):
    order = [sampling.stable_key("rr", F.col("doc_id")), F.col("doc_id")]
    return evalsets.balanced_probe(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, order)


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_key('mix', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r <= round_even(n * 0.3, 0) AS picked FROM r")
def ratio_mix(spark, sf_dir):
    return sampling.ratio_split(read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.3, "mix")


@query(
    f"""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand
  ORDER BY ln((CAST('0x' || substr({_key('pick', 'p_partkey')}, 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / greatest(p_retailprice::DOUBLE, 1e-9::DOUBLE) DESC, p_partkey) <= 2"""
)
def weighted_pick(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return sampling.weighted_pick(parts, ["p_brand"], F.col("p_retailprice"), F.col("p_partkey"), 2).select("p_brand", "p_partkey")


@query()
def multi_cap(spark, sf_dir):
    """At most three orders a customer and two hundred a priority, greedily in stable order; tests compare with a sequential pass."""
    from .store import table_store

    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", sampling.stable_key("caps", F.col("o_orderkey")).alias("k"))
    return sampling.multi_cap(orders, {"o_custkey": 3, "o_orderpriority": 200}, ["k", "o_orderkey"], table_store(spark))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top_k(spark, sf_dir):
    return quality.top_counts(read(spark, sf_dir, "part"), "p_brand", 10)


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey")
def leakage_overlap(spark, sf_dir):
    return quality.overlap(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def exclude_train(spark, sf_dir):
    return curate.without_ids(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"), ["c_custkey"])


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def keep_heldout(spark, sf_dir):
    ids = read(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    return curate.only_ids(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ids, ["s_suppkey", "s_nationkey"])


def _seen(spark, sf_dir) -> DataFrame:
    """Brands as objects: what each order shows, by the largest price."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("image_id"), F.col("p_brand").alias("name")).agg(F.max("l_extendedprice").alias("max_area"))


_SEEN = "v AS (SELECT l_orderkey AS image_id, p_brand AS name, max(l_extendedprice) AS max_area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(f"WITH {_SEEN} SELECT * FROM v")
def max_area(spark, sf_dir):
    return _seen(spark, sf_dir)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def argmax_row(spark, sf_dir):
    return sampling.first_per_key(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")])


@query(
    f"""WITH {_SEEN}, g AS (SELECT DISTINCT p_brand AS name, substr(p_brand, 1, 7) AS grp FROM part)
SELECT v.image_id, v.name AS positive, b.name AS negative, a.grp FROM v JOIN g a ON a.name = v.name JOIN g b ON b.grp = a.grp AND b.name <> v.name
WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.image_id = v.image_id AND x.name = b.name)"""
)
def hard_negatives(spark, sf_dir):
    """Brands of the same group that an order lacks."""
    groups = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.substring("p_brand", 1, 7).alias("grp")).distinct()
    return curate.absent_candidates(_seen(spark, sf_dir), groups)


@query(
    f"""WITH {_SEEN}, m AS (SELECT * FROM v WHERE image_id IN (SELECT image_id FROM v GROUP BY image_id HAVING count(*) >= 2)),
p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY
  ln((CAST('0x' || substr(md5('pairs|' || image_id || '|' || name), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / greatest(max_area, 1.0) DESC, name) <= 2),
g AS (SELECT DISTINCT p_brand AS name, substr(p_brand, 1, 7) AS grp FROM part),
c AS (SELECT p.image_id, p.name AS positive, b.name AS negative, CASE WHEN b.grp = a.grp THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p JOIN g a ON a.name = p.name, g b
  WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.image_id = p.image_id AND x.name = b.name)),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id, positive ORDER BY
  ln((CAST('0x' || substr(md5('pairs|' || image_id || '|' || positive || '|' || negative), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / weight DESC) = 1),
q AS (SELECT *, lower(regexp_replace(positive, '#', '')) AS cp, 'a ' || cp AS ph, CAST('0x' || substr(md5('pairsq|' || image_id || '|' || positive), 1, 7) AS BIGINT) % 3 AS qi FROM k)
SELECT image_id, positive, negative,
  CASE qi WHEN 0 THEN 'Is there ' || ph || ' in the image?' WHEN 1 THEN 'Can you see ' || ph || ' in this image?' ELSE 'Does the image contain ' || ph || '?' END AS question,
  'Yes, there is ' || ph || ' in the image.' AS chosen, 'Yes, there is a ' || lower(regexp_replace(negative, '#', '')) || ' in the image.' AS rejected,
  'Evidence hint: annotated visible object: ' || positive || '.' AS hint_chosen,
  'Evidence hint: unsupported object: ' || negative || ' is not annotated as visible.' AS hint_rejected FROM q"""
)
def object_pairs(spark, sf_dir):
    groups = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.substring("p_brand", 1, 7).alias("grp")).distinct()
    return curate.object_pairs(_seen(spark, sf_dir), groups)


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, (l_linenumber * 3)::DOUBLE AS y, (l_quantity - 5)::DOUBLE AS w, (l_linenumber + 1)::DOUBLE AS h FROM lineitem),
c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x / 64)) AS x1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y / 32)) AS y1,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x + w) / 64)) AS x2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (y + h) / 32)) AS y2 FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 AND x2 > x1 AND y2 > y1 THEN CAST(round(x1 * 64) AS BIGINT) END AS x1, CASE WHEN w > 0 AND x2 > x1 AND y2 > y1 THEN CAST(round(x2 * 64) AS BIGINT) END AS x2,
  coalesce((x1 + x2) / 2 + 0.02::DOUBLE < 0.5::DOUBLE AND w > 0 AND x2 > x1 AND y2 > y1, false) AS left_of_centre FROM c"""
)
def boxes(spark, sf_dir):
    """Boxes clipped to the image, and whether they lie left of its centre."""
    n = F.col("l_linenumber")
    box = normalize_xywh(F.col("l_quantity").cast("double"), (n * 3).cast("double"), (F.col("l_quantity") - 5).cast("double"), (n + 1).cast("double"), F.lit(64.0), F.lit(32.0))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    left = F.coalesce(holds_relation(F.lit("left_of"), F.col("box"), F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(1.0))), F.lit(False))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("box")[0] * 64).cast("long").alias("x1"), F.round(F.col("box")[2] * 64).cast("long").alias("x2"), left.alias("left_of_centre"))


_RULES = r"""CASE WHEN text IS NULL OR text = '' THEN 'missing_text' WHEN len(regexp_extract_all(text, '[A-Za-z0-9'']+')) < 20 THEN 'too_short'
  WHEN len(regexp_extract_all(text, '[A-Za-z0-9'']+')) > 2000 THEN 'too_long' WHEN source IN ('src1', 'src2') THEN 'bad_source' ELSE 'kept' END"""


def _rules():
    words = text.word_count(F.col("text"))
    return {"missing_text": F.col("text").isNull() | (F.col("text") == ""), "too_short": words < 20, "too_long": words > 2000, "bad_source": F.col("source").isin("src1", "src2")}


@query(f"SELECT {_RULES} AS reason, count(*) AS n FROM documents GROUP BY ALL")
def first_reasons(spark, sf_dir):
    return quality.reason_counts(read(spark, sf_dir, "documents"), _rules())


@query(
    r"""WITH w AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+')) AS n FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL OR text = '' THEN 'missing_text' END, CASE WHEN n < 20 THEN 'too_short' END, CASE WHEN n > 2000 THEN 'too_long' END, CASE WHEN source IN ('src1', 'src2') THEN 'bad_source' END) AS reasons FROM w"""
)
def every_reason(spark, sf_dir):
    """All rules that a row breaks."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(quality.all_reasons(_rules()), ",").alias("reasons"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return quality.duplicate_ids(read(spark, sf_dir, "orders"), "o_custkey")


@query(
    r"""WITH w AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+')) AS n FROM documents)
SELECT 'missing_text' AS rule, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_failed FROM w UNION ALL SELECT 'too_short', count(*) FILTER (WHERE n < 20) FROM w
UNION ALL SELECT 'too_long', count(*) FILTER (WHERE n > 2000) FROM w UNION ALL SELECT 'bad_source', count(*) FILTER (WHERE source IN ('src1', 'src2')) FROM w"""
)
def rule_report(spark, sf_dir):
    return quality.rule_report(read(spark, sf_dir, "documents"), _rules())


@query(
    """WITH m AS (SELECT d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (SELECT lang, 'quality' AS "column", CAST(quality AS VARCHAR) AS mark FROM m UNION ALL SELECT lang, 'toxic', CAST(toxic AS VARCHAR) FROM m),
g AS (SELECT lang, "column", 0 AS total, mark FROM u UNION ALL SELECT NULL, "column", 1, mark FROM u)
SELECT lang, "column", total, count(*) AS n, count(*) FILTER (WHERE mark = '1') AS n_yes, count(*) FILTER (WHERE mark = '0') AS n_no, count(*) FILTER (WHERE mark IS NULL) AS n_blank,
  CASE WHEN count(*) FILTER (WHERE mark IS NOT NULL) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE mark = '1')::DOUBLE / count(*) FILTER (WHERE mark IS NOT NULL) END AS pass_rate FROM g GROUP BY lang, "column", total"""
)
def audit_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.audit_rates(rows, ["quality", "toxic"], "lang").withColumn("total", F.col("total").cast("int"))


def _turns(spark, sf_dir) -> DataFrame:
    """A record of each user turn and the assistant's next one."""
    c = read(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    rows = user.join(told, ["conv_id", "turn"])
    i = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return rows.select(i.alias("id"), F.concat(F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image"), "question", "chosen", F.lit("No.").alias("rejected"), F.lit("Evidence hint: annotated.").alias("hint_chosen"), F.lit("Evidence hint: unsupported.").alias("hint_rejected"))


_TURNS = """r AS (SELECT u.conv_id || '-' || u.turn AS id, u.conv_id || '.jpg' AS image, u.text AS question, a.text AS chosen FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
_PROMPT = "'<image>' || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'"


@query(f"WITH {_TURNS} SELECT id, image, {_PROMPT} AS prompt, chosen, 'No.' AS rejected FROM r")
def export_answers(spark, sf_dir):
    return export.answer_rows(_turns(spark, sf_dir))


@query(f"WITH {_TURNS} SELECT id, image, {_PROMPT} AS prompt, chosen || chr(10) || 'Evidence hint: annotated.' AS chosen, 'No.' || chr(10) || 'Evidence hint: unsupported.' AS rejected FROM r")
def export_evidence(spark, sf_dir):
    return export.evidence_rows(_turns(spark, sf_dir))


@query(
    f"""WITH {_TURNS}, k AS (SELECT *, row_number() OVER (ORDER BY {_key('42', 'id')}, id) <= round_even((SELECT count(*) FROM r) * 0.3, 0) AS picked FROM r)
SELECT id, image, {_PROMPT} AS prompt, chosen || CASE WHEN picked THEN chr(10) || 'Evidence hint: annotated.' ELSE '' END AS chosen,
  'No.' || CASE WHEN picked THEN chr(10) || 'Evidence hint: unsupported.' ELSE '' END AS rejected FROM k"""
)
def export_mix(spark, sf_dir):
    return export.mixed_rows(_turns(spark, sf_dir))


@query(f"WITH {_TURNS} SELECT id, {_PROMPT} AS prompt, chosen, image, 'human' AS speaker FROM r")
def export_chat(spark, sf_dir):
    chat = export.chat_rows(export.answer_rows(_turns(spark, sf_dir)))
    return chat.select("id", F.col("conversations")[0]["value"].alias("prompt"), F.col("chosen.value").alias("chosen"), F.col("images")[0].alias("image"), F.col("conversations")[0]["from"].alias("speaker"))


@query(f"WITH {_TURNS} SELECT (SELECT count(*) FROM r) AS n_left, (SELECT count(*) FROM r WHERE chosen <> '') AS n_right, (SELECT count(*) FROM r) - (SELECT count(*) FROM r WHERE chosen <> '') AS only_left, 0::BIGINT AS only_right")
def export_same_ids(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return export.same_ids(rows, rows.where("chosen <> ''"))


@query(
    f"""WITH {_SEEN}, p AS (SELECT image_id, min(name) AS positive, max(name) AS negative FROM v GROUP BY image_id HAVING count(*) >= 2),
r AS (SELECT image_id, positive, negative, 'present' AS kind, 'yes' AS target, positive AS object FROM p UNION ALL SELECT image_id, positive, negative, 'absent', 'no', negative FROM p)
SELECT image_id::VARCHAR || '::' || positive || '::' || kind || '::' || object AS id, image_id, kind, target, object, 'Is there a ' || lower(replace(object, '#', '')) || ' in the image?' AS question FROM r"""
)
def paired_eval(spark, sf_dir):
    pairs = _seen(spark, sf_dir).groupBy("image_id").agg(F.min("name").alias("positive"), F.max("name").alias("negative"), F.count("*").alias("k")).where("k >= 2")
    return evalsets.yes_no_rows(pairs.drop("k")).select("id", "image_id", "kind", "target", "object", "question")


def _relations(spark, sf_dir) -> DataFrame:
    """Customers as relation rows: some repeat a source, some have equal names, some are no spatial relation or not borne out."""
    k, c = F.col("c_custkey"), F.col
    relation = F.when(c("c_nationkey") % 4 == 0, "left").when(c("c_nationkey") % 4 == 1, "right of").when(c("c_nationkey") % 4 == 2, "Left-Of").otherwise("right_of")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), F.lit("gqa").alias("source"), F.when(k % 5 != 0, (k - k % 3).cast("string")).alias("source_id"), F.concat(k.cast("string"), F.lit(".jpg")).alias("image"), k.cast("string").alias("image_id"),
        F.when(k % 11 == 0, "attribute_color").otherwise("relation_spatial").alias("task_type"), F.when(k % 7 == 0, "no").when(k % 7 == 1, "1").otherwise("Yes").alias("target"),
        F.when(k % 4 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(c("c_name")).alias("subject"), c("c_mktsegment").alias("object"), relation.alias("relation"),
    )


_STRESS = """r0 AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey - c_custkey % 3 AS VARCHAR) END AS source_id, lower(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE c_name END) AS s,
  CASE WHEN c_nationkey % 2 = 0 THEN 'left_of' ELSE 'right_of' END AS r, lower(c_mktsegment) AS o FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0),
r AS (SELECT *, coalesce(source_id, CAST(id AS VARCHAR)) AS source_key FROM r0 WHERE s <> o QUALIFY row_number() OVER (PARTITION BY coalesce(source_id, CAST(id AS VARCHAR)) ORDER BY id) = 1),
x AS (SELECT id, source_id, source_key, s, r, o, 'subject_object_swap' AS stress_type, o AS es, r AS er, s AS eo FROM r
  UNION ALL SELECT id, source_id, source_key, s, r, o, 'left_right_reversal', s, CASE r WHEN 'left_of' THEN 'right_of' ELSE 'left_of' END, o FROM r),
t AS (SELECT id, source_id, source_key, id || '.jpg' AS image, CAST(id AS VARCHAR) AS image_id, stress_type, s || ' ' || r || ' ' || o AS target_claim, es AS target_subject, eo AS target_object, er AS target_relation,
  'Visual question: Is the ' || s || ' to the ' || replace(r, '_of', '') || ' of the ' || o || '?' || chr(10) || 'Candidate claim: ' || s || ' ' || r || ' ' || o || chr(10)
  || 'Candidate evidence: subject=' || es || '; object=' || eo || '; relation=' || er || chr(10) || 'Decide whether the candidate evidence supports the claim in the image.' AS question FROM x)"""


@query(
    f"""WITH {_STRESS}, k AS (SELECT *, row_number() OVER (PARTITION BY stress_type ORDER BY md5('42|' || source_key), source_key) AS turn FROM t),
n AS (SELECT *, row_number() OVER (ORDER BY turn, stress_type) AS n FROM k)
SELECT 'relation_stress_' || lpad(CAST(n AS VARCHAR), 6, '0') AS id, 'relation_stress_probe' AS benchmark, 'gqa' AS source, source_id, image, image_id, question, 'yes' AS target, 'yes' AS target_answer, 'wrong_evidence' AS target_support, target_claim,
  CAST(NULL AS VARCHAR) AS target_evidence_label, target_subject, target_object, target_relation, 'wrong_evidence' AS task_type, 'relation_spatial' AS base_task_type, stress_type AS negative_type, stress_type FROM n WHERE n <= 99"""
)
def stress_rows(spark, sf_dir):
    """A probe of 99 stress rows, numbered, in turn from both types."""
    return evalsets.stress_probe(evalsets.relation_stress(_relations(spark, sf_dir), ["id"]), 99)


@query(
    f"""WITH {_STRESS}, v AS (SELECT *, CAST(id % 3 AS INT) AS i, id % 5 = 0 AS object_only, id % 5 = 1 AS attribute FROM t WHERE stress_type = 'left_right_reversal'),
w AS (SELECT *, replace(target_relation, '_of', ' of') AS direction, CASE WHEN object_only OR attribute THEN target_object END AS label,
  CASE WHEN object_only THEN target_subject || ' visible' WHEN attribute THEN target_subject || ' is red' ELSE target_claim END AS claim,
  CASE WHEN object_only OR attribute THEN split_part(split_part(question, chr(10), 1), 'Visual question: ', 2) ELSE split_part(split_part(question, chr(10), 1), 'Visual question: ', 2) END AS asked FROM v),
e AS (SELECT *, CASE WHEN object_only THEN CASE i WHEN 0 THEN 'it points to the object category ' || label WHEN 1 THEN 'the proposed support is the visible label ' || label ELSE 'a support cue naming ' || label END
  WHEN attribute THEN CASE i WHEN 0 THEN 'it describes ' || label || ' with attribute red' WHEN 1 THEN 'the evidence phrase says the ' || label || ' is red' ELSE 'a support cue naming ' || label || ' and the property red' END
  ELSE CASE i WHEN 0 THEN 'it identifies ' || replace(target_subject, chr(35), '') || ' as being ' || direction || ' ' || target_object WHEN 1 THEN 'the supporting relation is that ' || replace(target_subject, chr(35), '') || ' is ' || direction || ' ' || target_object
    ELSE 'a relation cue with subject ' || replace(target_subject, chr(35), '') || ', object ' || target_object || ', and direction ' || target_relation END END AS evidence FROM w)
SELECT id || '_paraphrase' AS id, 'paraphrase_probe' AS benchmark, image_id, target_subject, id AS paraphrase_source_id, CAST(i AS VARCHAR) AS paraphrase_variant, CASE i
  WHEN 0 THEN 'Question for the image: ' || asked || chr(10) || 'Claim to verify: ' || claim || chr(10) || 'Proposed visual support: ' || evidence || chr(10) || 'Judge whether the proposed support is valid evidence for the claim.'
  WHEN 1 THEN 'Image question: ' || asked || chr(10) || 'We are checking this claim: ' || claim || chr(10) || 'The candidate support says: ' || evidence || chr(10) || 'Does this support actually back up the claim in the image?'
  ELSE 'Consider the visual claim ' || chr(39) || claim || chr(39) || ' for the image question ' || chr(39) || asked || chr(39) || '.' || chr(10) || 'Candidate support description: ' || evidence || chr(10) || 'Decide if that support should be accepted for the claim.' END AS question FROM e"""
)
def paraphrase_variant(spark, sf_dir):
    """Stress rows as probe rows in three wordings: with relation, attribute and object evidence."""
    rows = evalsets.relation_stress(_relations(spark, sf_dir), ["id"]).where("stress_type = 'left_right_reversal'").withColumn("id", F.col("image_id").cast("long"))
    kind = F.col("id") % 5
    claim = F.when(kind == 0, F.concat("target_subject", F.lit(" visible"))).when(kind == 1, F.concat("target_subject", F.lit(" is red"))).otherwise(F.col("target_claim"))
    rows = rows.withColumns({"target_evidence_label": F.when(kind < 2, F.col("target_object")), "target_relation": F.when(kind >= 2, F.col("target_relation")), "target_claim": claim})
    return evalsets.paraphrases(rows, F.col("id")).select("id", "benchmark", "image_id", "target_subject", "paraphrase_source_id", "paraphrase_variant", "question")


@query(
    f"""WITH b AS (SELECT doc_id, 'toxic' AS bucket FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'good' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'even' FROM labels WHERE doc_id % 2 = 0)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {_key('case', 'doc_id')}, doc_id) <= 25"""
)
def bucketed_cases(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    buckets = {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1, "even": F.col("doc_id") % 2 == 0}
    return evalsets.bucketed_cases(rows, buckets, 25, [sampling.stable_key("case", F.col("doc_id")), F.col("doc_id")]).select("doc_id", "bucket")


@query(
    """WITH n AS (SELECT s_suppkey AS id, s_name AS label, s_nationkey FROM supplier), l AS (SELECT DISTINCT s_nationkey, label, md5('wrong|' || s_nationkey || '|' || label) AS k FROM n),
w AS (SELECT s_nationkey, label, coalesce(lead(label) OVER o, first(label) OVER o) AS wrong_label FROM l WINDOW o AS (PARTITION BY s_nationkey ORDER BY k, label))
SELECT id, label, wrong_label FROM n JOIN w USING (s_nationkey, label) WHERE wrong_label <> label"""
)
def wrong_evidence(spark, sf_dir):
    n = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), "s_nationkey")
    return curate.wrong_evidence(n, "s_nationkey", "label", "id").select("id", "label", "wrong_label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_groups(spark, sf_dir)

