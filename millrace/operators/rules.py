"""Rule catalogs for preference and claim records: each rule is a named condition that means failure.

``rule_report`` of ``quality`` counts all rules of a catalog in one pass, ``first_reason`` and ``all_reasons`` name those of a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import token_count
from .curate import LOW_CONFIDENCE
from .quality import first_reason
from .sampling import multi_cap

HINT = "Evidence hint:"


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _missing(columns: list[str]) -> dict[str, Column]:
    return {f"missing_{c}": _blank(c) for c in columns}


def with_repeats(df: DataFrame, key: str = "id") -> DataFrame:
    """Add ``is_repeat``: whether other rows have the same key."""
    n = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.join(n, key, "left").withColumn("is_repeat", F.col("_n").isNotNull()).drop("_n")


def canonical_rules(max_tokens: int = 40, task: str = "task_type") -> dict[str, Column]:
    """Rules of preference records (image, image_id, question, chosen, rejected, hint_chosen, hint_rejected, positive, negative, visible)."""
    c = F.col
    same = c("positive").eqNullSafe(c("negative"))
    return {
        **_missing(["image", "image_id", "question", "chosen", "rejected", "hint_chosen", "hint_rejected"]),
        "identical_answers": F.coalesce("chosen", F.lit("")) == F.coalesce("rejected", F.lit("")),
        "chosen_too_long": token_count(c("chosen")) > max_tokens,
        "rejected_too_long": token_count(c("rejected")) > max_tokens,
        "chosen_hint_prefix": ~F.contains(F.coalesce("hint_chosen", F.lit("")), F.lit(HINT)),
        "rejected_hint_prefix": ~F.contains(F.coalesce("hint_rejected", F.lit("")), F.lit(HINT)),
        "identical_objects": (c(task) == "object_existence") & same,
        "negative_is_visible": (c(task) == "object_existence") & F.array_contains("visible", c("negative")),
        "identical_attributes": F.startswith(c(task), F.lit("attribute_")) & same,
        "identical_relations": (c(task) == "relation_spatial") & same,
    }


def claim_rules(max_tokens: int = 80) -> dict[str, Column]:
    """Rules of claim records."""
    c = F.col
    wrong = c("task_type") == "wrong_evidence"
    each = lambda side, bad: F.coalesce(F.exists(side, bad), F.lit(False))
    roles = lambda x: F.transform(x["evidence"], lambda e: e["role"])
    half = lambda x: (x["type"] == "relation") & ~(F.array_contains(roles(x), "subject") & F.array_contains(roles(x), "object"))
    bare = lambda x: (x["type"] != "relation") & (F.size(x["evidence"]) == 0)
    out = {
        **_missing(["source", "image", "image_id", "task_type", "question", "chosen_answer", "rejected_answer", "answer_rejected", "negative_type"]),
        "chosen_too_long": token_count(c("chosen_answer")) > max_tokens,
        "rejected_too_long": token_count(c("rejected_answer")) > max_tokens,
        "identical_plain_answers": F.coalesce("chosen_answer", F.lit("")) == F.coalesce("answer_rejected", F.lit("")),
    }
    for side in ("chosen_claims", "rejected_claims"):
        out |= {
            f"no_{side}": F.coalesce(F.size(side), F.lit(0)) <= 0,
            f"{side}_field": each(side, lambda x: x["span"].isNull() | x["type"].isNull() | x["support"].isNull()),
            f"{side}_evidence": each(side, lambda x: x["evidence"].isNull()),
            f"{side}_roles": each(side, half),
            f"{side}_bare": each(side, bare),
        }
    return out | {
        "wrong_evidence_answers": wrong & ~c("chosen_answer").eqNullSafe(c("rejected_answer")),
        "wrong_evidence_support": wrong & ~each("rejected_claims", lambda x: x["support"] == "wrong_evidence"),
        "identical_answers": ~wrong & c("chosen_answer").eqNullSafe(c("rejected_answer")),
        "evidence_wrong_elsewhere": ~wrong & (c("negative_type") == "evidence_wrong"),
        "identical_attributes": (c("negative_type") == "attribute_mismatch") & _both("attribute"),
        "identical_relations": (c("negative_type") == "relation_reversal") & _both("relation"),
    }


def _both(field: str) -> Column:
    """Whether the first claims of both sides agree in a field, or lack it."""
    return F.get("chosen_claims", F.lit(0))[field].eqNullSafe(F.get("rejected_claims", F.lit(0))[field])


# What a finding says after the record's id.
CANONICAL_SAYS = {
    "missing_image": "missing image", "missing_image_id": "missing image_id", "missing_question": "missing question", "missing_chosen": "missing chosen_answer", "missing_rejected": "missing rejected_answer",
    "missing_hint_chosen": "missing evidence_hint_chosen", "missing_hint_rejected": "missing evidence_hint_rejected", "identical_answers": "chosen and rejected are identical",
    "chosen_too_long": "chosen exceeds 40 tokens", "rejected_too_long": "rejected exceeds 40 tokens", "chosen_hint_prefix": "chosen hint missing Evidence hint prefix",
    "rejected_hint_prefix": "rejected hint missing Evidence hint prefix", "identical_objects": "positive and negative object are identical",
    "negative_is_visible": "rejected object is annotated visible", "identical_attributes": "positive and negative attributes are identical", "identical_relations": "positive and negative relations are identical",
}
CLAIM_SAYS = {
    "chosen_too_long": "chosen answer exceeds 80 tokens", "rejected_too_long": "rejected answer exceeds 80 tokens", "identical_plain_answers": "Answer-DPO chosen/rejected are identical",
    "wrong_evidence_answers": "wrong-evidence row must keep chosen/rejected answer identical", "wrong_evidence_support": "wrong-evidence rejected claim must use support=wrong_evidence",
    "identical_answers": "non-wrong-evidence row has identical answers", "evidence_wrong_elsewhere": "evidence_wrong negative used outside wrong_evidence task",
    "identical_attributes": "positive and negative attributes are identical", "identical_relations": "relation and negative relation are identical", "missing_answer_rejected": "missing answer_dpo_rejected_answer",
} | {
    f"{rule}": says for side in ("chosen_claims", "rejected_claims") for rule, says in (
        (f"no_{side}", f"{side} must be a non-empty list"), (f"{side}_field", f"{side} claim missing a field"), (f"{side}_evidence", f"{side} evidence must be a list"),
        (f"{side}_roles", "relation claim missing subject/object evidence"), (f"{side}_bare", "non-relation claim has empty evidence"),
    )
}


def _record_id(place: str) -> Column:
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.concat(F.lit("line-"), F.col(place).cast("string")))


def checked(df: DataFrame, place: str, files: DataFrame | None = None) -> DataFrame:
    """``df`` with what rules of ids and files need: record_id, is_repeat (an earlier row has the id) and no_file.

    A row without an id is named after its place. ``files`` (path) lists the images there are; without it all are taken to exist.
    """
    df = df.withColumn("record_id", _record_id(place))
    first = df.groupBy(F.col("record_id").alias("_id")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    df = df.join(first, F.col("record_id") == F.col("_id"), "left").withColumn("is_repeat", F.coalesce(F.col(place) > F.col("_first"), F.lit(False))).drop("_id", "_first", "_n")
    if files is None:
        return df.withColumn("no_file", F.lit(False))
    there = files.select(F.col("path").alias("_path")).distinct()
    return df.join(there, F.col("image") == F.col("_path"), "left").withColumn("no_file", ~_blank("image") & F.col("_path").isNull()).drop("_path")


def with_record_rules(rules: dict[str, Column]) -> dict[str, Column]:
    """``rules`` for ``checked`` records: ids that an earlier row has, and images that don't exist, count too."""
    return {"repeated_id": F.col("is_repeat"), **rules, "no_file": F.col("no_file")}


def checked_report(df: DataFrame, place: str, rules: dict[str, Column], files: DataFrame | None = None) -> DataFrame:
    """(rule, n_failed) of records by ``rules`` and those of ids and files: what ``rule_report`` counts on ``checked`` records.

    Only ids, places and paths are shuffled, not the records: repeats are what an id has beyond its first place.
    """
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    ids = df.select(_record_id(place).alias("id"), F.col(place).alias("p")).groupBy("id", "p").agg(F.count("*").alias("n")).where("p is not null")
    ids = ids.groupBy("id").agg((F.sum("n") - F.min(F.struct("p", "n"))["n"]).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_id"))
    counts = counts.crossJoin(ids)  # a row each
    if files is None:
        counts = counts.withColumn("no_file", F.lit(0).cast("long"))
    else:
        there = files.select(F.col("path").alias("_path")).distinct()
        lost = df.where(~_blank("image")).groupBy("image").agg(F.count("*").alias("n")).join(there, F.col("image") == F.col("_path"), "left_anti")
        counts = counts.crossJoin(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("no_file")))
    return counts.unpivot([], ["repeated_id", *rules, "no_file"], "rule", "n_failed")


def findings(df: DataFrame, rules: dict[str, Column], says: dict[str, str], place: str, store, limit: int = 200) -> tuple[DataFrame, dict[str, int]]:
    """The findings of ``checked`` records, and how often each rule is broken.

    (place, rule, message): of each rule the first ``limit`` by place. The numbers are observed on all findings while these
    are written, so records are read once; their sum is 0 where a check passes.
    """
    return _first_found(_broken(df, rules, says, place), list(rules), store, limit)


def findings_of(df: DataFrame, rules: dict[str, Column], says: dict[str, str], place: str, store, limit: int = 200) -> tuple[DataFrame, dict[str, int]]:
    """``findings`` of records that aren't ``checked``, by ``rules`` and that of repeated ids; all images are taken to exist.

    Only ids and places are shuffled, not the records. Repeated ids are written, so that few of them are broadcast.
    """
    ids = df.select(_record_id(place).alias("record_id"), F.col(place).alias("_place"))
    first = ids.groupBy(F.col("record_id").alias("_id")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_id", "_first")
    repeated = ids.join(store(first, "repeated"), F.col("record_id") == F.col("_id")).where("_place > _first")
    rows = _broken(df.withColumn("record_id", _record_id(place)), rules, says, place)
    found = rows.unionByName(_broken(repeated, {"repeated_id": F.lit(True)}, says, "_place"))
    return _first_found(found, ["repeated_id", *rules, "no_file"], store, limit)


def _broken(df: DataFrame, rules: dict[str, Column], says: dict[str, str], place: str) -> DataFrame:
    """(place, rule, message) of every rule that a record breaks."""
    said = {k: says.get(k, k.replace("missing_", "missing ")) for k in rules} | {"repeated_id": "duplicate id"}
    told = lambda k: F.concat("record_id", F.lit(": image path does not exist: "), "image") if k == "no_file" else F.concat("record_id", F.lit(f": {said[k]}"))
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("rule"), told(k).alias("message"))) for k, cond in rules.items()]))
    return df.select(F.col(place).alias("place"), F.explode(broken).alias("f")).select("place", "f.*")


def _first_found(rows: DataFrame, rules: list[str], store, limit: int) -> tuple[DataFrame, dict[str, int]]:
    seen = Observation(f"findings-{uuid.uuid4().hex[:8]}")
    rows = rows.observe(seen, *[F.count_if(F.col("rule") == k).alias(k) for k in rules])
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("place", "message"))
    first = store(rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank"), "findings")
    return first, dict(seen.get)


def first_findings(found: DataFrame, rules: dict[str, Column], n: int = 200) -> DataFrame:
    """The first ``n`` findings by place, those of a record in the order of the rules."""
    order = F.array_position(F.array(*map(F.lit, rules)), F.col("rule"))
    return found.orderBy("place", order).limit(n)


def cleaning_rules(max_tokens: int = 40, low_confidence: list[str] | None = None) -> list[tuple[str, Column]]:
    """Why a preference record is rejected, in the order in which that is asked; for ``checked`` records.

    A record's label is its positive, negative and visible names; an image that doesn't exist is missing like one not named.
    Objects whose absence is doubtful are rejected unless ``low_confidence`` is an empty list.
    """
    c = F.col
    doubtful = LOW_CONFIDENCE if low_confidence is None else low_confidence
    is_object = F.coalesce(c("task_type") == "object_existence", F.lit(False))
    named = {"id": "id", "source": "source", "image": "image", "image_id": "image_id", "task_type": "task_type", "question": "question", "chosen_answer": "chosen", "rejected_answer": "rejected", "evidence_hint_chosen": "hint_chosen", "evidence_hint_rejected": "hint_rejected"}
    label = _blank("positive") & _blank("negative") & (F.coalesce(F.size("visible"), F.lit(0)) <= 0)
    return [
        *[(f"missing_{k}", _blank(v)) for k, v in named.items()], ("missing_label", label), ("missing_image", c("no_file")), ("identical_answers", c("chosen") == c("rejected")),
        ("chosen_too_long", token_count(c("chosen")) > max_tokens), ("rejected_too_long", token_count(c("rejected")) > max_tokens), ("bad_chosen_hint", ~F.contains("hint_chosen", F.lit(HINT))),
        ("bad_rejected_hint", ~F.contains("hint_rejected", F.lit(HINT))), ("same_positive_negative", is_object & c("positive").eqNullSafe(c("negative"))),
        ("negative_visible", is_object & F.array_contains("visible", c("negative"))), ("low_confidence_negative", is_object & c("negative").isin(doubtful)),
    ]


def cleaned(records: DataFrame, caps: dict[str, int], order: list[str], store, rules: list[tuple[str, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records that no rule rejects, greedily under caps on their names, and (reason, n) of those that go.

    ``caps`` are on positive and negative; a record without a name counts as "unknown". A record that the caps refuse is told
    by the first of them that is full when its turn comes; here by the key whose cap the kept records fill before it.
    """
    rules = cleaning_rules() if rules is None else rules
    rows = records.withColumn("reason", first_reason(rules)).withColumns({f"_{k}": F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("unknown")) for k in caps})
    sound = rows.where("reason is null")
    kept = multi_cap(sound.select(*[f"_{k}" for k in caps], *order), {f"_{k}": n for k, n in caps.items()}, order, store)
    out = sound.join(kept.select(*order), order, "left_semi").drop("reason", *[f"_{k}" for k in caps])
    refused, why = sound.join(kept.select(*order), order, "left_anti"), F.lit(None).cast("string")
    for k, n in caps.items():
        last = kept.groupBy(F.col(f"_{k}").alias("_key")).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias(f"_last_{k}")).where(F.col("_n") >= n).drop("_n")
        refused = refused.join(last, F.col(f"_{k}") == F.col("_key"), "left").drop("_key")
        why = F.coalesce(why, F.when(F.col(f"_last_{k}") < F.struct(*order), f"{k}_cap"))
    reasons = rows.where("reason is not null").select("reason").unionByName(refused.select(why.alias("reason")))
    return out, reasons.groupBy("reason").agg(F.count("*").alias("n"))


def claim_summary(records: DataFrame) -> DataFrame:
    """(measure, name, n) of claim records: by task, base task, negative type and source, rows with equal answers, items without a box."""
    c = F.col
    fields = {"task_type": c("task_type"), "base_task_type": F.coalesce("base_task_type", F.lit("")), "negative_type": c("negative_type"), "source": c("source")}
    items = lambda side: F.flatten(F.transform(F.coalesce(c(side), F.array()), lambda x: F.coalesce(x["evidence"], F.array())))
    boxless = F.size(F.filter(F.concat(items("chosen_claims"), items("rejected_claims")), lambda e: e["box"].isNull()))
    plain = F.coalesce(F.nullif(c("answer_rejected"), F.lit("")), c("rejected_answer"))
    sums = {"same_answer_rows": (c("chosen_answer") == c("rejected_answer")).cast("int"), "answer_dpo_identical_rows": (c("chosen_answer") == plain).cast("int"), "claims_with_missing_box": boxless, "total": F.lit(1)}
    # A row for each combination of names, however many records; only these rows are told apart by measure.
    counts = records.select(*[v.alias(k) for k, v in fields.items()], *[v.cast("long").alias(k) for k, v in sums.items()]).groupBy(*fields).agg(*[F.sum(k).alias(k) for k in sums])
    one = lambda measure, name, n: F.struct(F.lit(measure).alias("measure"), name.alias("name"), c(n).alias("n"))
    told = [one(f"{k}_counts", c(k), "total") for k in fields] + [one(k, F.lit(""), k) for k in sums]
    return counts.select(F.explode(F.array(*told)).alias("t")).select("t.*").groupBy("measure", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def answer_export_rules(block: str = HINT) -> dict[str, Column]:
    """Rules of plain exports (prompt, chosen, rejected): no evidence in them, different answers."""
    has = lambda k: F.contains(F.coalesce(k, F.lit("")), F.lit(block))
    return {"evidence_in_answers": has("prompt") | has("chosen") | has("rejected"), "identical_answers": F.col("chosen").eqNullSafe(F.col("rejected"))}


def evidence_export_rules(block: str = HINT) -> dict[str, Column]:
    """Rules of exports with evidence: none in the prompt, some in both answers."""
    has = lambda k: F.contains(F.coalesce(k, F.lit("")), F.lit(block))
    return {"evidence_in_prompt": has("prompt"), "chosen_lacks_evidence": ~has("chosen"), "rejected_lacks_evidence": ~has("rejected")}


def export_mismatch(canonical: DataFrame, exported: DataFrame, key: str = "id") -> DataFrame:
    """One row: whether ids and row counts of an export differ from its records'."""
    a, b = canonical.groupBy(key).agg(F.count("*").alias("a")), exported.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("other_ids"), F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("m"))
    return both.select((F.col("other_ids") > 0).alias("ids_differ"), (F.col("n") != F.col("m")).alias("counts_differ"))


def task_shares(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(task_type, n, share, outside): of each task type with bounds, whether its share of all rows lies outside of them."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col("task_type") == k).alias(k) for k in bounds])
    rows = counts.unpivot(["total"], list(bounds), "task_type", "n")
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    low, high = (F.coalesce(*[F.when(F.col("task_type") == k, float(v[i])) for k, v in bounds.items()]) for i in (0, 1))
    return rows.select("task_type", "n", share.alias("share"), ((F.col("total") > 0) & ~share.between(low, high)).alias("outside"))


def count_mismatches(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """(value, n, expected) of the values whose counts aren't the expected ones."""
    counts = df.agg(*[F.count_if(F.col(column) == k).alias(k) for k in expected]).unpivot([], list(expected), "value", "n")
    want = F.coalesce(*[F.when(F.col("value") == k, v) for k, v in expected.items()]).cast("long")
    return counts.withColumn("expected", want).where("n <> expected")
