"""Evaluation sets: yes/no pairs, probes, stress rows, paraphrases, error-mined rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import normalize_target
from ..functions.text import article_phrase, candidate_evidence, clean_name, compact, failure_category, one_line
from .sampling import capped_per_key, round_robin, stable_key, with_ids

# The three wordings of a probe question and of its evidence, by kind of evidence.
WORDINGS = [
    "Question for the image: {question}\nClaim to verify: {claim}\nProposed visual support: {evidence}\nJudge whether the proposed support is valid evidence for the claim.",
    "Image question: {question}\nWe are checking this claim: {claim}\nThe candidate support says: {evidence}\nDoes this support actually back up the claim in the image?",
    "Consider the visual claim '{claim}' for the image question '{question}'.\nCandidate support description: {evidence}\nDecide if that support should be accepted for the claim.",
]
RELATION_EVIDENCE = [
    "it identifies {subject} as being {direction} {object}",
    "the supporting relation is that {subject} is {direction} {object}",
    "a relation cue with subject {subject}, object {object}, and direction {relation}",
]
ATTRIBUTE_EVIDENCE = [
    "it describes {label} with attribute {attribute}",
    "the evidence phrase says the {label} is {attribute}",
    "a support cue naming {label} and the property {attribute}",
]
OBJECT_EVIDENCE = [
    "it points to the object category {label}",
    "the proposed support is the visible label {label}",
    "a support cue naming {label}",
]


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[(values[p] if i % 2 else F.lit(p)) for i, p in enumerate(parts) if p])


def by_variant(variant: Column, templates: list[str], **values: Column) -> Column:
    return F.element_at(F.array(*[filled(t, **values) for t in templates]), variant + 1)


def yes_no_rows(pairs: DataFrame) -> DataFrame:
    """Two rows of each (image_id, positive, negative): a present and an absent object."""
    side = lambda kind, target, c: F.struct(F.lit(kind).alias("kind"), F.lit(target).alias("target"), F.col(c).alias("object"))
    rows = pairs.withColumn("s", F.explode(F.array(side("present", "yes", "positive"), side("absent", "no", "negative")))).select("*", "s.*").drop("s")
    rows = rows.withColumn("question", F.format_string("Is there %s in the image?", article_phrase(F.col("object"))))
    return rows.withColumn("id", F.concat_ws("::", F.col("image_id").cast("string"), "positive", "kind", "object"))


def first_pair(rows: DataFrame, pair: str, target: str, order: list[Column]) -> DataFrame:
    """The first yes row and the first no row of each pair that has both."""
    firsts = capped_per_key(rows, [pair, target], 1, order)
    both = firsts.groupBy(pair).agg(F.count("*").alias("k")).where("k = 2").select(pair)
    return firsts.join(both, pair, "left_semi")


def balanced_probe(rows: DataFrame, bucket: str, n: int, order: list[Column]) -> DataFrame:
    """``n`` rows in turn from sorted buckets."""
    return round_robin(rows, bucket, n, order)


def _entity(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))


def stress_relation(value: Column) -> Column:
    """left_of or right_of; any other relation as lower-cased text with underscores."""
    t = F.translate(_entity(value), "- ", "__")
    return F.when(t.isin("left", "left_of"), "left_of").when(t.isin("right", "right_of"), "right_of").otherwise(t)


def relation_stress(rows: DataFrame, order: list[str]) -> DataFrame:
    """Two stress rows of each relation that an image bears out: roles swapped, and the relation reversed.

    ``rows`` have id, source, source_id, image, image_id, task_type, target, subject, object and relation. Of a source (by
    source_id, else id) the first row in ``order`` counts whose subject differs from its object. A row that counts but lacks
    a name, or whose relation is neither left nor right, is an error.
    """
    c = F.col
    rows = rows.where((c("task_type") == "relation_spatial") & (normalize_target(c("target").cast("string")) == "yes"))
    rows = rows.withColumns({"subject": _entity(c("subject")), "object": _entity(c("object")), "relation": stress_relation(c("relation"))}).where("subject <> object")
    rows = rows.withColumn("_source", F.coalesce(F.nullif(c("source_id").cast("string"), F.lit("")), c("id").cast("string")))
    rows = capped_per_key(rows, ["_source"], 1, [c(k) for k in order])
    sound = (c("subject") != "") & (c("object") != "") & c("relation").isin("left_of", "right_of")
    rows = rows.withColumn("relation", F.when(sound, c("relation")).otherwise(F.raise_error(F.concat(F.lit("Malformed relation row: "), F.coalesce(c("id").cast("string"), F.lit("null"))))))
    other = F.when(c("relation") == "left_of", "right_of").otherwise("left_of")
    make = lambda kind, s, r, o: F.struct(F.lit(kind).alias("stress"), s.alias("s"), r.alias("r"), o.alias("o"))
    rows = rows.withColumn("x", F.explode(F.array(make("subject_object_swap", c("object"), c("relation"), c("subject")), make("left_right_reversal", c("subject"), other, c("object")))))
    claim = F.concat_ws(" ", "subject", "relation", "object")
    question = filled(
        "Visual question: Is the {subject} to the {side} of the {object}?\nCandidate claim: {claim}\nCandidate evidence: subject={s}; object={o}; relation={r}\n"
        "Decide whether the candidate evidence supports the claim in the image.",
        subject=c("subject"), side=F.replace(c("relation"), F.lit("_of"), F.lit("")), object=c("object"), claim=claim, s=c("x.s"), o=c("x.o"), r=c("x.r"),
    )
    return rows.select(
        F.lit("relation_stress_probe").alias("benchmark"), "source", "source_id", "image", "image_id", question.alias("question"), F.lit("yes").alias("target"), F.lit("yes").alias("target_answer"),
        F.lit("wrong_evidence").alias("target_support"), claim.alias("target_claim"), F.lit(None).cast("string").alias("target_evidence_label"), c("x.s").alias("target_subject"), c("x.o").alias("target_object"),
        c("x.r").alias("target_relation"), F.lit("wrong_evidence").alias("task_type"), F.lit("relation_spatial").alias("base_task_type"), c("x.stress").alias("negative_type"), c("x.stress").alias("stress_type"), "_source",
    )


def stress_probe(candidates: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """``n`` of the ``relation_stress`` rows in turn from the stress types, numbered relation_stress_000001 on."""
    key = [stable_key(seed, F.col("_source")), F.col("_source")]
    chosen = round_robin(candidates, "stress_type", n, key)
    return with_ids(chosen, "relation_stress", ["turn", "stress_type"]).drop("turn", "_source")


def probe_evidence(variant: Column, claim: Column, label: Column, subject: Column, relation: Column, obj: Column) -> Column:
    """The evidence of a probe row in words: its relation if it has one, else the attribute of its claim, else its label."""
    label = F.when(clean_name(F.coalesce(label, F.lit(""))) == "", "unknown object").otherwise(clean_name(label))
    attribute = F.regexp_extract(clean_name(F.coalesce(claim, F.lit(""))), "^.* is (.+)$", 1)
    direction = F.replace(F.replace(relation, F.lit("_of"), F.lit(" of")), F.lit("_"), F.lit(" "))
    return (
        F.when(F.coalesce(relation, F.lit("")) != "", by_variant(variant, RELATION_EVIDENCE, subject=clean_name(subject), direction=direction, object=clean_name(obj), relation=relation))
        .when(attribute != "", by_variant(variant, ATTRIBUTE_EVIDENCE, label=label, attribute=attribute))
        .otherwise(by_variant(variant, OBJECT_EVIDENCE, label=label))
    )


def visual_question(claim: Column, question: Column) -> Column:
    """The question that a left/right claim answers, else the line marked as visual question, else the first line."""
    parts = lambda k: F.regexp_extract(F.trim(claim), r"^(.+?)\s+(left|right)_of\s+(.+)$", k)
    marked = F.regexp_extract(question, r"(?m)^Visual question:(.*)$", 1)
    told = F.concat(F.lit("Is the "), parts(1), F.lit(" to the "), parts(2), F.lit(" of the "), parts(3), F.lit("?"))
    first = F.trim(F.substring_index(question, "\n", 1))
    return F.when(parts(2) != "", told).when(F.contains(question, F.lit("Visual question:")), F.trim(marked)).when(question == "", "Is the claim visually supported?").otherwise(first)


def paraphrases(rows: DataFrame, index: Column) -> DataFrame:
    """Probe rows in the wording of their index modulo three; their other columns stay.

    ``rows`` have id, question, target_claim, target_evidence_label, target_subject, target_relation and target_object.
    """
    variant = F.pmod(index, F.lit(len(WORDINGS))).cast("int")
    c = F.col
    evidence = probe_evidence(variant, c("target_claim"), c("target_evidence_label"), c("target_subject"), c("target_relation"), c("target_object"))
    text = by_variant(variant, WORDINGS, question=visual_question(c("target_claim"), c("question")), claim=c("target_claim"), evidence=evidence)
    told = {"id": F.concat(c("id").cast("string"), F.lit("_paraphrase")), "benchmark": F.lit("paraphrase_probe"), "question": text, "paraphrase_source_id": c("id"), "paraphrase_variant": variant.cast("string")}
    return rows.withColumns(told)


def error_kind(target: Column, prediction: Column) -> Column:
    """What went wrong with a scored row: false_positive, false_negative, invalid_error, or correct (for any target but yes and no, too)."""
    prediction, target = F.coalesce(prediction, F.lit("")), F.coalesce(target, F.lit(""))
    return (
        F.when((target == "no") & (prediction == "yes"), "false_positive").when((target == "yes") & (prediction == "no"), "false_negative")
        .when(target.isin("yes", "no") & (prediction != target), "invalid_error").otherwise("correct")
    )


def bucketed_cases(rows: DataFrame, buckets: dict[str, Column], k: int, order: list[Column]) -> DataFrame:
    """``k`` rows for each bucket whose condition they meet; a row can be in several."""
    held = F.array_compact(F.array(*[F.when(cond, name) for name, cond in buckets.items()]))
    return capped_per_key(rows.withColumn("bucket", F.explode(held)), ["bucket"], k, order)


# The kinds of cases in which three models are compared; their names are our own.
DUAL_REJECTS, DUAL_ACCEPTS = "The dual model correctly rejects relation wrong-evidence", "The dual model falsely accepts relation wrong-evidence"
ALL_FAIL, DUAL_ALONE = "All models fail", "The answer model fails but the dual model succeeds"


def failure_cases(scored: DataFrame, model: str, models: tuple[str, str, str]) -> DataFrame:
    """A row for each relation probe with wrong evidence that all three models (base, answer, dual) have answered.

    ``scored`` are rows of ``score_probes`` with id, question and generation. Returns id, question, claim, candidate_evidence,
    category, buckets, and of each model mark (reject or accept and the support it names) and generation, cut to 180 characters.
    """
    c = F.col
    rows = scored.where((c("base_task_type") == "relation_spatial") & (c("target_support") == "wrong_evidence") & c(model).isin(*models))
    told = F.struct(
        c("wrong_evidence_rejected").alias("rejected"), c("predicted_support").alias("support"), compact(c("generation")).alias("generation"), c("question"), c("target_claim").alias("claim"),
        c("target_subject").alias("subject"), c("target_object").alias("object"), c("target_relation").alias("relation"),
    )
    base, answer, dual = "_base", "_answer", "_dual"
    wide = rows.groupBy("id").agg(*[F.max_by(F.when(c(model) == m, told), F.when(c(model) == m, 1)).alias(k) for m, k in zip(models, (base, answer, dual))])
    wide = wide.where(c(base).isNotNull() & c(answer).isNotNull() & c(dual).isNotNull())
    rejects = lambda k: c(f"{k}.rejected")
    buckets = F.array_compact(F.array(
        F.when(rejects(dual), DUAL_REJECTS).otherwise(DUAL_ACCEPTS), F.when(~rejects(base) & ~rejects(answer) & ~rejects(dual), ALL_FAIL), F.when(~rejects(answer) & rejects(dual), DUAL_ALONE),
    ))
    mark = lambda k: F.concat_ws("/", F.when(rejects(k), "reject").otherwise("accept"), c(f"{k}.support"))
    category = failure_category(*[c(f"{base}.{k}") for k in ("claim", "subject", "object", "relation")], c(f"{dual}.support"))
    said = [x for k in (base, answer, dual) for x in (mark(k).alias(f"{k[1:]}_mark"), c(f"{k}.generation").alias(f"{k[1:]}_generation"))]
    return wide.select("id", one_line(c(f"{base}.question")).alias("question"), c(f"{base}.claim").alias("claim"), candidate_evidence(c(f"{base}.question")).alias("candidate_evidence"), category.alias("category"), buckets.alias("buckets"), *said)


def sampled_cases(cases: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """``k`` cases of each bucket."""
    return capped_per_key(cases.withColumn("bucket", F.explode("buckets")), ["bucket"], k, order).drop("buckets")
