"""Audits: what a record's texts say against its labels or claims, as marks yes, no or na with the reasons of every no.

Preference records have id, source, task_type, chosen, rejected, hint_chosen, hint_rejected, positive and negative (object,
attribute or relation), visible, object and subject. Claim records are those of ``claims``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import compiled_once, once
from ..functions.text import clean_name, cleaned_together

# The marks of both kinds of sheets, shares of yes that they must reach, what counts as yes and no, what
# hints must say, and the reasons.
PREFERENCE_MARKS = ["chosen_correct", "rejected_wrong", "hint_correct"]
CLAIM_MARKS = ["chosen_answer_correct", "rejected_answer_wrong", "chosen_evidence_correct", "rejected_error_correct"]
THRESHOLDS = {"chosen_correct": 0.85, "rejected_wrong": 0.90, "hint_correct": 0.90}
YES, NO = ["yes", "y", "true", "1", "pass", "passed"], ["no", "n", "false", "0", "fail", "failed"]
OBJECT_HINTS = ("annotated visible object", "not annotated as visible")
ATTRIBUTE_HINTS = ("annotated attribute", "mismatched attribute")
RELATION_HINTS = ("annotated relation", "contradicted relation")
OBJECT_REASONS = ["chosen answer does not match annotated positive object", "rejected answer does not match an unannotated negative object", "evidence hint does not match canonical labels"]
ATTRIBUTE_REASONS = ["chosen answer does not match annotated GQA attribute", "rejected answer does not match the mismatched GQA attribute", "evidence hint does not match GQA attribute labels"]
RELATION_REASONS = ["chosen answer does not match annotated GQA relation", "rejected answer does not match the flipped GQA relation", "evidence hint does not match GQA relation labels"]
CLAIM_REASONS = ["chosen answer does not match chosen claim", "rejected answer does not match rejected claim", "chosen evidence does not match chosen claim", "rejected error type does not match canonical negative"]


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _clean(c: Column) -> Column:
    return F.coalesce(clean_name(c), F.lit(""))


def _yes(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "yes").otherwise("no")


def audit_text(text: Column) -> Column:
    """Cleaned text in which =, ; and , part words."""
    return _clean(F.translate(F.coalesce(text, F.lit("")), "=;,", "   "))


def _parted(text: Column) -> Column:
    """What ``audit_text`` cleans."""
    for sign in "=;,":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return text


def says(text: Column, phrase: Column) -> Column:
    """Whether a cleaned text has a cleaned phrase as whole words; an empty phrase is never said."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (phrase != "") & F.contains(pad(text), pad(phrase))


def relation_in(text: Column, relation: Column) -> Column:
    """Whether a text names a relation; left and right count within words too."""
    return _names_relation(audit_text(text), _clean(relation))


def _names_relation(text: Column, relation: Column) -> Column:
    """``relation_in`` of what is cleaned."""
    return F.when(relation.isin("left", "left of"), F.contains(text, F.lit("left"))).when(relation.isin("right", "right of"), F.contains(text, F.lit("right"))).otherwise((relation != "") & F.contains(text, relation))


def split_attribute(span: Column) -> Column:
    """(object, attribute) of a cleaned span: at the first " is ", else the last word is the attribute."""
    at, words = F.position(F.lit(" is "), span), F.split(span, " ")
    n = F.size(words)
    joined = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), " ")
    obj = F.when(at > 0, F.trim(F.substring(span, F.lit(1), at))).when(n >= 2, joined).otherwise(span)
    attribute = F.when(at > 0, F.trim(F.substring(span, at + 4, F.length(span)))).when(n >= 2, F.element_at(words, -1)).otherwise("")
    return F.struct(obj.alias("object"), attribute.alias("attribute"))


def split_relation(span: Column) -> Column:
    """(subject, relation, object) of a cleaned span: at "left of", else "right of", else at its second word."""
    words, padded = F.split(span, " "), F.concat(F.lit(" "), span, F.lit(" "))
    n = F.size(words)

    def at(name: str) -> Column:
        place = F.position(F.lit(name), span)
        return F.when(
            F.contains(padded, F.lit(f" {name} ")),
            F.struct(F.trim(F.substring(span, F.lit(1), place - 1)).alias("subject"), F.lit(name).alias("relation"), F.trim(F.substring(span, place + len(name), F.length(span))).alias("object")),
        )

    rest = F.array_join(F.slice(words, 3, F.greatest(n - 2, F.lit(0))), " ")
    other = F.when(n >= 3, F.struct(F.get(words, F.lit(0)).alias("subject"), F.get(words, F.lit(1)).alias("relation"), rest.alias("object")))
    return F.coalesce(at("left of"), at("right of"), other, F.struct(span.alias("subject"), F.lit("").alias("relation"), F.lit("").alias("object")))


def preference_marks(rows: DataFrame) -> DataFrame:
    """Add the marks of PREFERENCE_MARKS and ``reasons`` to preference records. Names and texts are cleaned once a row."""
    c, columns = F.col, rows.columns
    visible = F.transform(F.coalesce("visible", F.array().cast("array<string>")), lambda v: _clean(v))
    told = lambda words: F.contains(_low(c("hint_chosen")), F.lit(words[0])) & F.contains(_low(c("hint_rejected")), F.lit(words[1]))
    names, texts = ("positive", "negative", "object", "subject"), ("chosen", "rejected", "hint_chosen", "hint_rejected")
    rows = once(rows, **{f"_{k}": _clean(c(k)) for k in (*names, *texts)}, _visible=visible)
    named = lambda text, *parts: _every([says(c(f"_{text}"), c(f"_{n}")) for n in parts])

    def marks(words: tuple[str, str], reasons: list[str], shared: tuple[str, ...] = (), objects: bool = False) -> Column:
        chosen, rejected = named("chosen", *shared, "positive"), named("rejected", *shared, "negative")
        hint = named("hint_chosen", *shared, "positive") & named("hint_rejected", *shared, "negative") & told(words)
        if objects:
            chosen, rejected = F.array_contains("_visible", c("_positive")) & chosen, ~F.array_contains("_visible", c("_negative")) & rejected
        return F.struct(*[F.coalesce(x, F.lit(False)).alias(k) for x, k in zip((chosen, rejected, hint), PREFERENCE_MARKS)], F.array(*map(F.lit, reasons)).alias("reasons"), F.lit(True).alias("known"))

    unknown = F.struct(*[F.lit(False).alias(k) for k in PREFERENCE_MARKS], F.array(F.concat(F.lit("unsupported GQA task_type: "), F.coalesce("task_type", F.lit("")))).alias("reasons"), F.lit(False).alias("known"))
    of_graph = F.coalesce(c("source") == "gqa", F.lit(False))
    kind = F.when(~of_graph, marks(OBJECT_HINTS, OBJECT_REASONS, objects=True)).when(F.startswith("task_type", F.lit("attribute_")), marks(ATTRIBUTE_HINTS, ATTRIBUTE_REASONS, ("object",)))
    rows = once(rows, _m=kind.when(c("task_type") == "relation_spatial", marks(RELATION_HINTS, RELATION_REASONS, ("subject", "object"))).otherwise(unknown))
    why = F.array_compact(F.array(*[F.when(~c(f"_m.{k}"), F.get("_m.reasons", F.lit(i))) for i, k in enumerate(PREFERENCE_MARKS)]))
    return rows.select(*columns, *[_yes(c(f"_m.{k}")).alias(k) for k in PREFERENCE_MARKS], F.when(c("_m.known"), why).otherwise(c("_m.reasons")).alias("reasons"))


def _every(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def answer_fits(text: Column, claim: Column, attribute: Column, relation: Column) -> Column:
    """Whether a cleaned answer says what a claim's cleaned span says; that is split in ``attribute`` and ``relation``."""
    return (text != "") & (claim["span"] != "") & (
        F.when(claim["type"] == "object", says(text, F.replace(claim["span"], F.lit(" visible"), F.lit(""))))
        .when(claim["type"] == "attribute", says(text, attribute["object"]) & says(text, attribute["attribute"]))
        .when(claim["type"] == "relation", says(text, relation["subject"]) & says(text, relation["object"]) & _names_relation(text, relation["relation"])).otherwise(False)
    )


def evidence_fits(text: Column, claim: Column) -> Column:
    """Whether a text, cleaned as by ``audit_text``, names all labels of a cleaned claim, and its attribute or relation."""
    every = (F.size(claim["labels"]) > 0) & F.forall(claim["labels"], lambda e: says(text, e))
    return (text != "") & every & F.when(claim["type"] == "attribute", says(text, claim["attribute"])).when(claim["type"] == "relation", _names_relation(text, claim["relation"])).otherwise(True)


def claim_marks(rows: DataFrame) -> DataFrame:
    """Add the marks of CLAIM_MARKS and ``reasons``. Names, texts and spans are cleaned together and split once a row.

    ``rows`` have negative_type, chosen_claims and rejected_claims of a record, and chosen_answer, rejected_answer,
    chosen_evidence, rejected_evidence and rejected_support as a sheet shows them; without support the claim's own counts.
    """
    c, columns, sides = F.col, rows.columns, ("chosen", "rejected")
    first = {s: F.get(f"{s}_claims", F.lit(0)) for s in sides}
    names = {f"_{s}_answer": c(f"{s}_answer") for s in sides} | {f"_{s}_evidence": _parted(c(f"{s}_evidence")) for s in sides}
    names |= {f"_{s}_{k}": first[s][k] for s in sides for k in ("span", "attribute", "relation")} | {"_support": F.coalesce(F.nullif("rejected_support", F.lit("")), first["rejected"]["support"])}
    together, *cleaned = cleaned_together(*names.values(), lists=tuple(first[s]["evidence"]["label"] for s in sides))
    rows = compiled_once(rows, _cleaned=together)
    told = dict(zip([*names, *[f"_{s}_labels" for s in sides]], cleaned))
    kind = {s: F.coalesce(first[s]["type"], F.lit("")) for s in sides}
    for s in sides:  # one at a time: methods of more than 8000 bytes aren't compiled
        rows = compiled_once(rows, **{f"_{s}_split_{k}": F.when(kind[s] == k, f(told[f"_{s}_span"])) for k, f in (("attribute", split_attribute), ("relation", split_relation))})
    claim = {s: {"type": kind[s], **{k: told[f"_{s}_{k}"] for k in ("span", "labels", "attribute", "relation")}} for s in sides}
    wrong = F.coalesce(c("negative_type") == "evidence_wrong", F.lit(False))
    due = F.when(wrong, "wrong evidence").when(c("negative_type").isin("answer_wrong", "attribute_mismatch", "relation_reversal"), "contradicted")
    answer = lambda s: answer_fits(told[f"_{s}_answer"], claim[s], c(f"_{s}_split_attribute"), c(f"_{s}_split_relation"))
    shown = lambda s: evidence_fits(told[f"_{s}_evidence"], claim[s])
    marks = {
        "chosen_answer_correct": _yes(answer("chosen")), "rejected_answer_wrong": F.when(wrong, "na").otherwise(_yes(answer("rejected"))),
        "chosen_evidence_correct": _yes(shown("chosen")), "rejected_error_correct": _yes((told["_support"] == due) & shown("rejected")),
    }
    rows = compiled_once(rows, **marks)
    return rows.select(*columns, *marks, F.array_compact(F.array(*[F.when(c(k) == "no", r) for k, r in zip(CLAIM_MARKS, CLAIM_REASONS)])).alias("reasons"))


def completed(sheet: DataFrame, marked: DataFrame, columns: list[str], overwrite: bool = False) -> DataFrame:
    """A sheet's rows with their empty marks (all with ``overwrite``) filled from marked records, ``reasons`` and ``has_record``."""
    new = marked.select(F.col("id").alias("_id"), "reasons", *[F.col(k).alias(f"_{k}") for k in columns])
    rows = sheet.join(new, sheet["id"] == F.col("_id"), "left").withColumn("has_record", F.col("_id").isNotNull())
    fill = lambda k: F.when(F.col("has_record") & (F.lit(overwrite) | (F.coalesce(F.trim(k), F.lit("")) == "")), F.col(f"_{k}")).otherwise(F.col(k))
    return rows.withColumns({k: fill(k) for k in columns}).drop("_id", *[f"_{k}" for k in columns])


def mark_of(value: Column) -> Column:
    """A mark as yes, no or blank."""
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(t.isin(YES), "yes").when(t.isin(NO), "no").otherwise("blank")


def audit_summary(rows: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(mark, n_yes, n_no, n_blank, rate, threshold, passes) of the completed rows that have a record."""
    marks = list(thresholds)
    long = rows.where("has_record").select(*[mark_of(F.col(k)).alias(k) for k in marks]).unpivot([], marks, "mark", "value")
    n = long.groupBy("mark").agg(*[F.count_if(F.col("value") == v).alias(f"n_{v}") for v in ("yes", "no", "blank")])
    judged = F.col("n_yes") + F.col("n_no")
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))]), F.col("mark"))
    out = n.withColumn("rate", F.when(judged == 0, 0.0).otherwise(F.round(F.col("n_yes") / judged, 4))).withColumn("threshold", limit)
    return out.withColumn("passes", F.col("rate") >= F.col("threshold"))


def audit_counts(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(level, name, mark, n_yes, n_no, n_na, n_blank, audited, rate) of all rows and of each value of ``by``."""
    # Rows are counted by their marks before these are told apart: a mark of each count, not of each row.
    rows = rows.groupBy(by, *columns).agg(F.count("*").alias("_n"))
    long = rows.select("_n", F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("unknown")).alias("name"), *[F.coalesce(F.nullif(_clean(F.col(k)), F.lit("")), F.lit("blank")).alias(k) for k in columns]).unpivot(["_n", "name"], columns, "mark", "value")
    counts = [F.coalesce(F.sum(F.when(F.col("value") == v, F.col("_n"))), F.lit(0)).alias(f"n_{v}") for v in ("yes", "no", "na", "blank")]
    out = long.groupingSets([["name", "mark"], ["mark"]], "name", "mark").agg(F.grouping("name").alias("_all"), *counts)
    out = out.withColumn("audited", F.col("n_yes") + F.col("n_no"))
    out = out.withColumns({"level": F.when(F.col("_all") == 1, "all").otherwise(F.lit(by)), "name": F.coalesce("name", F.lit("all")), "rate": F.when(F.col("audited") == 0, 0.0).otherwise(F.round(F.col("n_yes") / F.col("audited"), 6))})
    return out.drop("_all")
