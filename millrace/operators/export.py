"""Training formats from canonical preference records (id, image, question, chosen, rejected, hint_chosen, hint_rejected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import ratio_split


def prompt(question: Column, cue: Column | None = None) -> Column:
    parts = [F.lit("<image>"), *([cue] if cue is not None else []), F.concat(F.lit("Question: "), question), F.lit("Answer:")]
    return F.concat_ws("\n", *parts)


def answer_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "image", prompt(F.col("question")).alias("prompt"), "chosen", "rejected")


# What a hint must contain, and what stands before its body in evidence and in cues.
HINT, EVIDENCE, CUE = "Evidence hint:", "Evidence: ", "Visual cue: "


def evidence_body(hint: str) -> Column:
    """What follows the first ``HINT`` of a column; a hint without it is an error."""
    body = F.regexp_extract(hint, rf"(?s){HINT}(.*)$", 1)
    wrong = F.raise_error(F.concat(F.lit(f"{hint} lacks its prefix: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return F.when(F.contains(hint, F.lit(HINT)), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(wrong)


def _followed(answer: str, what: Column) -> Column:
    return F.concat_ws("\n", F.col(answer), what)


def evidence_rows(df: DataFrame) -> DataFrame:
    """The whole hints stand after both answers; a hint without its prefix is an error."""
    whole = lambda c: F.when(evidence_body(c).isNotNull(), F.col(c))
    return df.select("id", "image", prompt(F.col("question")).alias("prompt"), _followed("chosen", whole("hint_chosen")).alias("chosen"), _followed("rejected", whole("hint_rejected")).alias("rejected"))


def evidence_only_rows(df: DataFrame) -> DataFrame:
    """The chosen answer on both sides, so that the evidence after it alone makes the difference."""
    shown = lambda c: _followed("chosen", F.concat(F.lit(EVIDENCE), evidence_body(c)))
    return df.select("id", "image", prompt(F.col("question")).alias("prompt"), shown("hint_chosen").alias("chosen"), shown("hint_rejected").alias("rejected"))


def input_cue_rows(df: DataFrame) -> DataFrame:
    """What the chosen hint says stands in the prompt, answers are plain."""
    return df.select("id", "image", prompt(F.col("question"), F.concat(F.lit(CUE), evidence_body("hint_chosen"))).alias("prompt"), "chosen", "rejected")


def chosen_only_rows(df: DataFrame) -> DataFrame:
    """Evidence after the chosen answer only."""
    return df.select("id", "image", prompt(F.col("question")).alias("prompt"), _followed("chosen", F.concat(F.lit(EVIDENCE), evidence_body("hint_chosen"))).alias("chosen"), "rejected")


def mixed_rows(df: DataFrame, ratio: float = 0.3, seed: str = "42") -> DataFrame:
    """Exactly round(n * ratio) rows with evidence, the rest without."""
    marked = ratio_split(df, F.col("id"), ratio, seed)
    return evidence_rows(marked.where("picked")).unionByName(answer_rows(marked.where("not picked")))


def verifier_rows(records: DataFrame, side: str, support: str, part: str) -> DataFrame:
    """Rows that ask whether the evidence of a claim record's first ``side`` claim supports it; answers are JSON, keys sorted.

    ``support`` is what the evidence deserves, supported or wrong_evidence, ``part`` the slice that ids and rows carry.
    """
    one = F.get(side, F.lit(0))
    label = lambda role: F.coalesce(F.nullif(F.get(F.filter(one["evidence"], lambda e: e["role"] == role), F.lit(0))["label"], F.lit("")), F.lit("unknown"))
    relation = F.when(one["type"] == "relation", F.nullif(one["relation"], F.lit("")))
    attribute = F.when(one["type"] == "attribute", F.nullif(one["attribute"], F.lit("")))
    first = F.coalesce(F.get(one["evidence"], F.lit(0))["label"], F.lit("unknown"))
    shown = F.when(one["type"] == "relation", F.concat(F.lit("subject="), label("subject"), F.lit("; object="), label("object"), F.lit("; relation="), F.coalesce(relation, F.lit("unknown"))))
    shown = shown.otherwise(F.concat(F.lit("label="), first, F.coalesce(F.concat(F.lit("; attribute="), attribute), F.lit(""))))
    body = F.concat_ws(
        "\n", F.lit("<image>"), F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Candidate claim: "), one["span"]), F.concat(F.lit("Candidate evidence: "), shown),
        F.lit("Does the candidate evidence support the claim in the image?"), F.lit("Answer:"),
    )
    payload = lambda s: F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"relation": "'), relation, F.lit('", ')), F.lit("")), F.lit(f'"support": "{s}"}}'))
    other = "wrong_evidence" if support == "supported" else "supported"
    return records.select(
        F.concat(F.lit(f"{part}_"), "id").alias("id"), "image", body.alias("prompt"), payload(support).alias("chosen"), payload(other).alias("rejected"), "source",
        F.lit("evidence_verifier").alias("task_type"), F.coalesce("base_task_type", "task_type").alias("base_task_type"), F.lit("evidence_support_label").alias("negative_type"),
        F.lit(part).alias("slice"), F.col("id").alias("source_record_id"), F.lit(support).alias("target_support"), one["type"].alias("claim_type"),
    )


def dual_rules() -> dict[str, Column]:
    """Rules of a mixed export: filled fields, different answers, and verifier answers that name a known support."""
    blank = {f"missing_{c}": F.coalesce(c, F.lit("")) == "" for c in ("id", "image", "prompt", "chosen", "rejected", "slice")}
    known = lambda c: F.coalesce(F.get_json_object(c, "$.support").isin("supported", "wrong_evidence"), F.lit(False))
    judged = F.col("slice") != "short_answer"
    return {**blank, "identical_answers": F.col("chosen").eqNullSafe(F.col("rejected")), "verifier_support": judged & ~(known("chosen") & known("rejected"))}


def chat_rows(df: DataFrame) -> DataFrame:
    """Chat preference format of (id, image, prompt, chosen, rejected); a prompt without the image's place gets one."""
    df = df.withColumn("prompt", F.when(F.contains("prompt", F.lit("<image>")), F.col("prompt")).otherwise(F.concat(F.lit("<image>\n"), "prompt")))
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return df.select("id", F.array(turn("human", "prompt")).alias("conversations"), turn("gpt", "chosen").alias("chosen"), turn("gpt", "rejected").alias("rejected"), F.array("image").alias("images"))


def same_ids(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """One row: row counts, distinct ids, and ids that only one side has. Equal exports have 0 in both differences."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    return a.join(b, key, "full").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))
