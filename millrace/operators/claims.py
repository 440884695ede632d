"""Claim records: an answer, the claims it makes and the evidence that is given for them.

A record has id, source, image, image_id, task_type, base_task_type, question, chosen_answer, rejected_answer,
answer_rejected (what plain answer training rejects), chosen_claims, rejected_claims, negative_type, source_record_id and
evidence_pool. A claim is a struct (span, type, support, evidence, attribute, relation), evidence an array of (role, label, box).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import once
from ..functions.text import article_phrase, be_verb, filled
from .curate import flipped, with_negatives

EVIDENCE = "array<struct<role:string,label:string,box:array<double>>>"
CLAIMS = f"array<struct<span:string,type:string,support:string,evidence:{EVIDENCE},attribute:string,relation:string>>"
POOL = "array<struct<label:string,box:array<double>>>"
FIELDS = [
    "id", "source", "image", "image_id", "task_type", "base_task_type", "question", "chosen_answer", "rejected_answer", "answer_rejected", "chosen_claims", "rejected_claims",
    "negative_type", "source_record_id", "evidence_pool",
]


def evidence(*items: tuple[str, Column, Column | None]) -> Column:
    """Evidence of (role, label, box)."""
    parts = [F.struct(F.lit(r).alias("role"), label.alias("label"), (F.lit(None) if box is None else box).cast("array<double>").alias("box")) for r, label, box in items]
    return F.array(*parts).cast(EVIDENCE)


def claims(span: Column, kind: str, support: str, shown: Column, attribute: Column | None = None, relation: Column | None = None) -> Column:
    """An array of one claim."""
    none = F.lit(None).cast("string")
    parts = [span.alias("span"), F.lit(kind).alias("type"), F.lit(support).alias("support"), shown.alias("evidence"), (none if attribute is None else attribute).alias("attribute")]
    return F.array(F.struct(*parts, (none if relation is None else relation).alias("relation"))).cast(CLAIMS)


def evidence_pools(objects: DataFrame) -> DataFrame:
    """(image_id, pool): what an image has, as (label, box) sorted; bounded by one image's annotations."""
    return objects.groupBy("image_id").agg(F.sort_array(F.collect_set(F.struct(F.col("name").alias("label"), F.col("box").cast("array<double>").alias("box")))).cast(POOL).alias("pool"))


def _without(pool: str, label: Column) -> Column:
    return F.filter(F.coalesce(F.col(pool), F.array().cast(POOL)), lambda p: p["label"] != label)


def _record(rows: DataFrame, source: str, task: Column, kind: str) -> DataFrame:
    fixed = {"source": F.lit(source), "task_type": task, "base_task_type": task, "negative_type": F.lit(kind), "source_record_id": F.lit(None).cast("string"), "answer_rejected": F.col("rejected_answer")}
    rows = rows.withColumns(fixed)
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ("id", "image", "image_id") else F.col(c) for c in FIELDS])


def object_claims(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Records of object pairs (id, image, image_id, positive, negative, question, chosen, rejected) whose positive has a box.

    ``boxes`` (image_id, name, box) has the best box of each class of an image.
    """
    c = F.col
    own = boxes.select("image_id", c("name").alias("positive"), "box")
    rows = pairs.join(own, ["image_id", "positive"]).join(evidence_pools(boxes), "image_id", "left")
    rows = rows.withColumns({
        "chosen_answer": c("chosen"), "rejected_answer": c("rejected"), "evidence_pool": _without("pool", c("positive")),
        "chosen_claims": claims(F.concat("positive", F.lit(" visible")), "object", "supported", evidence(("target", c("positive"), c("box")))),
        "rejected_claims": claims(F.concat("negative", F.lit(" visible")), "object", "contradicted", evidence(("target", c("negative"), None))),
    })
    return _record(rows, "coco", F.lit("object_existence"), "answer_wrong")


def attribute_claims(candidates: DataFrame, objects: DataFrame, seed: str = "attr") -> DataFrame:
    """Records of ``attribute_candidates`` that have id and image; ``objects`` are those of the scene graphs."""
    c = F.col
    rows = once(with_negatives(candidates, seed, "image_id", "object_id", "attribute"), _verb=be_verb(c("object")))
    rows = rows.join(evidence_pools(objects), "image_id", "left")
    shown = evidence(("target", c("object"), c("box")))
    said = lambda a: filled("The %s %s %s.", "object", "_verb", a)
    span = lambda a: filled("%s is %s", "object", a)
    rows = rows.withColumns({
        "question": filled("What %s is the %s?", "kind", "object"), "chosen_answer": said("attribute"), "rejected_answer": said("negative"),
        "evidence_pool": _without("pool", c("object")),
        "chosen_claims": claims(span("attribute"), "attribute", "supported", shown, attribute=c("attribute")),
        "rejected_claims": claims(span("negative"), "attribute", "contradicted", shown, attribute=c("negative")),
    })
    return _record(rows, "gqa", F.concat(F.lit("attribute_"), "kind"), "attribute_mismatch")


def relation_claims(candidates: DataFrame) -> DataFrame:
    """Records of left/right ``relation_candidates`` that have id and image."""
    c = F.col
    rows = candidates.where(c("relation").isin("left", "right")).withColumn("negative", flipped(c("relation")))
    shown = evidence(("subject", c("subject"), c("subject_box")), ("object", c("object"), c("object_box")))
    phrase = lambda r: filled("to the %s of the %s", r, "object")
    span, of = lambda r: filled("%s %s_of %s", "subject", r, "object"), lambda r: F.concat(r, F.lit("_of"))
    rows = rows.withColumns({
        "question": filled("Is the %s %s?", "subject", phrase("relation")),
        "chosen_answer": filled("Yes, the %s is %s.", "subject", phrase("relation")), "rejected_answer": filled("No, the %s is %s.", "subject", phrase("negative")),
        "evidence_pool": F.array().cast(POOL),
        "chosen_claims": claims(span("relation"), "relation", "supported", shown, relation=of("relation")),
        "rejected_claims": claims(span("negative"), "relation", "contradicted", shown, relation=of("negative")),
    })
    return _record(rows, "gqa", F.lit("relation_spatial"), "relation_reversal")


def wrong_evidence_claims(records: DataFrame, seed: str = "wrong") -> DataFrame:
    """The same claims with evidence that doesn't support them: another object of the image, or a relation's roles swapped.

    A record without other objects (or a relation without two items of evidence) gives none.
    """
    c, one = F.col, F.get("chosen_claims", F.lit(0))
    # Whether there is other evidence is told without drawing it: what reads only other fields leaves the draw out.
    rows = records.where(F.when(one["type"] == "relation", F.size(one["evidence"]) >= 2).when(one["type"].isin("object", "attribute"), F.size("evidence_pool") > 0))
    key = lambda label: F.md5(F.concat("_start", F.coalesce(F.concat(F.lit("|"), label), F.lit(""))))
    other = F.array_min(F.transform("evidence_pool", lambda p: F.struct(key(p["label"]).alias("k"), p["label"].alias("label"), p["box"].alias("box"))))  # by stable_key
    rows = rows.withColumn("_start", F.concat_ws("|", F.lit(seed), c("id").cast("string"))).withColumn("_other", other)
    first, second = F.get(one["evidence"], F.lit(0)), F.get(one["evidence"], F.lit(1))
    swapped = evidence(("subject", second["label"], second["box"]), ("object", first["label"], first["box"]))
    shown = F.when(one["type"] == "relation", swapped).otherwise(evidence(("target", c("_other.label"), c("_other.box"))))
    wrong = F.transform(F.slice("chosen_claims", 1, 1), lambda x: x.withField("support", F.lit("wrong_evidence")).withField("evidence", shown))
    rows = rows.withColumns({
        "rejected_claims": wrong.cast(CLAIMS), "chosen_claims": F.slice("chosen_claims", 1, 1), "source_record_id": c("id"), "rejected_answer": c("chosen_answer"),
        "base_task_type": c("task_type"), "task_type": F.lit("wrong_evidence"), "negative_type": F.lit("evidence_wrong"), "id": F.concat("id", F.lit("_wrong")),
    })
    return rows.select(*FIELDS)


def _label(shown: Column, role: str, none: str | None = None) -> Column:
    found = F.get(F.filter(shown, lambda e: e["role"] == role), F.lit(0))["label"]
    return found if none is None else F.coalesce(found, F.lit(none))


def compact_evidence(claim: Column) -> Column:
    """A claim's evidence as one line."""
    first = F.coalesce(F.get(claim["evidence"], F.lit(0))["label"], F.lit("none"))
    related = F.concat(F.lit("subject="), _label(claim["evidence"], "subject", "unknown"), F.lit("; object="), _label(claim["evidence"], "object", "unknown"), F.lit("; relation="), F.coalesce(claim["relation"], F.lit("unknown")))
    return F.when(claim["type"] == "relation", related).when(claim["type"] == "attribute", F.concat(first, F.lit("; attribute="), F.coalesce(claim["attribute"], F.lit("None")))).otherwise(first)


def claim_response(answer: Column, told: Column) -> Column:
    """An answer and its claims as indented text."""
    block = lambda x: F.concat(F.lit("- type: "), x["type"], F.lit("\n  claim: "), x["span"], F.lit("\n  evidence: "), compact_evidence(x), F.lit("\n  support: "), x["support"])
    return F.concat(F.lit("Answer: "), answer, F.lit("\nClaims:\n"), F.array_join(F.transform(told, block), "\n"))


def _prompt() -> Column:
    return F.concat(F.lit("<image>\nQuestion: "), "question", F.lit("\nAnswer:"))


def answer_exports(records: DataFrame) -> DataFrame:
    """Plain answers; of wrong-evidence records the rejected answer is the one their source rejects."""
    return records.select("id", "image", _prompt().alias("prompt"), F.col("chosen_answer").alias("chosen"), F.coalesce(F.nullif("answer_rejected", F.lit("")), "rejected_answer").alias("rejected"), "source", "task_type", "negative_type")


def claim_exports(records: DataFrame) -> DataFrame:
    """Answers with their claims."""
    chosen, rejected = claim_response(F.col("chosen_answer"), F.col("chosen_claims")), claim_response(F.col("rejected_answer"), F.col("rejected_claims"))
    return records.select("id", "image", _prompt().alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), "source", "task_type", "negative_type")


def probe_rows(records: DataFrame, side: str, support: str) -> DataFrame:
    """Questions whether the evidence of a record's ``side`` claims supports the claim."""
    one = F.get(side, F.lit(0))
    kind, shown = one["type"], one["evidence"]
    label = F.regexp_replace(one["span"], " visible$", "")
    relation = lambda k: F.regexp_extract(one["span"], "^(.+?) (left|right)_of (.+)$", k)
    asked = (
        F.when(kind == "object", F.concat(F.lit("Is there "), article_phrase(label), F.lit(" in the image?")))
        .when(kind == "attribute", F.concat(F.lit("Is the "), F.regexp_extract(one["span"], "^(.*) is .+$", 1), F.lit(" "), one["attribute"], F.lit("?")))
        .otherwise(F.concat(F.lit("Is the "), relation(1), F.lit(" to the "), relation(2), F.lit(" of the "), relation(3), F.lit("?")))
    )
    first = F.coalesce(F.get(shown, F.lit(0))["label"], F.lit("none"))
    candidate = F.when(kind == "relation", compact_evidence(one)).when(kind == "attribute", F.concat(F.lit("label="), first, F.lit("; attribute="), one["attribute"])).otherwise(F.concat(F.lit("label="), first))
    question = F.concat(F.lit("Visual question: "), asked, F.lit("\nCandidate claim: "), one["span"], F.lit("\nCandidate evidence: "), candidate, F.lit("\nDecide whether the candidate evidence supports the claim in the image."))
    return records.select(
        "id", "source", "image", "image_id", question.alias("question"), F.lit("yes").alias("target"), F.lit("yes").alias("target_answer"), F.lit(support).alias("target_support"),
        one["span"].alias("target_claim"), _label(shown, "target").alias("target_evidence_label"), _label(shown, "subject").alias("target_subject"), _label(shown, "object").alias("target_object"),
        one["relation"].alias("target_relation"), "task_type", "base_task_type", "negative_type",
    )
