"""Free-text model answers as labels: chains of patterns and VARIANT values, all of them Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_name

# Phrases that decline to answer.
REFUSALS = [
    "not sure", "unclear", "cannot determine", "can't determine", "cannot tell", "can't tell", "unable to determine",
    "insufficient information", "not enough information",
]
YES, NO = ["yes", "y", "true", "1"], ["no", "n", "false", "0"]
SUPPORTED = ["supported", "support", "correct", "match", "matched"]
WRONG = ["wrong evidence", "incorrect", "mismatch", "mismatched"]
CONTRADICTED = ["contradicted", "contradiction", "unsupported", "not support"]
FIELDS = ["claim", "evidence_label", "evidence", "support", "relation"]


def _squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def _stripped(text: Column, what: str = r"\s") -> Column:
    return F.regexp_replace(text, f"^[{what}]+|[{what}]+$", "")


def parse_prediction(text: Column) -> Column:
    """yes, no, refusal or other; the first pattern that holds decides, so "not visible" is a yes."""
    t = _squeezed(text)
    first = F.regexp_extract(t, r"^[^a-z0-9]*(yes|no|yeah|yep|nope)\b", 1)
    return (
        F.when(t == "", "other")
        .when(t.rlike(r"\b(" + "|".join(REFUSALS) + r")\b"), "refusal")
        .when(first.isin("yes", "yeah", "yep"), "yes")
        .when(first != "", "no")
        .when(t.rlike(r"\b(there is no|there are no|do not see|don't see|cannot see|can't see)\b"), "no")
        .when(t.rlike(r"\b(there is|there are|i can see|visible)\b"), "yes")
        .when(t.rlike(r"\byes\b"), "yes")
        .when(t.rlike(r"\bno\b"), "no")
        .otherwise("other")
    )


def normalize_target(value: Column) -> Column:
    t = _squeezed(value)
    return F.when(t.isin(YES), "yes").when(t.isin(NO), "no").otherwise(t)


def normalize_answer(value: Column) -> Column:
    t = F.lower(_stripped(F.coalesce(value, F.lit(""))))
    word = F.regexp_extract(t, r"\b(yes|no|yeah|yep|nope)\b", 1)
    one = lambda w: F.when(w.isin([*YES, "yeah", "yep"]), "yes").when(w.isin([*NO, "nope"]), "no")
    return F.coalesce(one(t), one(word), t)


def normalize_support(value: Column) -> Column:
    """supported, wrong_evidence, contradicted, else the cleaned text or "unknown"."""
    t = F.replace(clean_name(F.coalesce(value, F.lit(""))), F.lit("not supported"), F.lit("unsupported"))
    return (
        F.when(t.isin(SUPPORTED), "supported")
        .when(t.isin(WRONG), "wrong_evidence")
        .when(t.isin(CONTRADICTED), "contradicted")
        .when(t.rlike("wrong|mismatch|incorrect"), "wrong_evidence")
        .when(t.rlike("contradict|unsupported"), "contradicted")
        .when(t.rlike("support|correct|match"), "supported")
        .when(t == "", "unknown")
        .otherwise(t)
    )


def normalize_relation(value: Column) -> Column:
    """left_of before right_of, by substring; else the cleaned text."""
    t = clean_name(F.coalesce(value, F.lit("")))
    return F.when(F.contains(t, F.lit("left")), "left_of").when(F.contains(t, F.lit("right")), "right_of").otherwise(t)


def infer_support(text: Column) -> Column:
    """What free text says of its evidence."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike(r"\b(wrong|incorrect|mismatch|does not match|not the evidence|invalid)\b"), "wrong_evidence")
        .when(t.rlike(r"\b(contradict|contradicted|unsupported|not supported|no support)\b"), "contradicted")
        .when(t.rlike(r"\b(supported|correct|matches|match)\b"), "supported")
        .otherwise("unknown")
    )


def labeled_field(text: Column, key: str) -> Column:
    """The value after ``key:`` or ``key=``, up to a line feed, comma, semicolon or brace; quotes are stripped."""
    name = key.replace("_", r"[_\s-]?")
    value = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i){name}\s*[:=]\s*([^\n,;}}]+)", 1)
    return _stripped(_stripped(_stripped(value), '"'), "'")


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; see ``json_object`` for how that is told."""
    listed, held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce((text != "") & held.isNotNull() & one, F.lit(False))


def json_object(text: Column) -> Column:
    """The object from the first { to the last } as VARIANT (the first item of an array), null where that isn't strict JSON.

    What stands behind a complete value is no error to the parser. So the object is read as the only item of an array and as
    the value of a field as well: what follows it would have to close both a bracket and a brace. NaN is no JSON here, and a
    number's last zeros don't count. An object that gives a key twice is read only with spark.sql.variant.allowDuplicateKeys,
    then the last one counts.
    """
    span = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    listed, held = F.try_parse_json(F.concat(F.lit("["), span, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), span, F.lit("}")))
    return F.when((span != "") & held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), listed)


def json_text(value: Column, key: str) -> Column:
    """A field of ``json_object`` as text; empty if it is missing, null, false, zero or empty. Lists and objects are spelled out."""
    at = f"$[0].{key}"
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(value, at, "variant")), F.lit("VOID"))
    plain = F.coalesce(F.try_variant_get(value, at, "string"), F.lit(""))
    spelled = F.to_json(F.try_variant_get(value, at, "variant"))
    return (
        F.when(kind == "STRING", plain).when(kind == "BOOLEAN", F.nullif(plain, F.lit("false")))
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.when(~spelled.isin("[]", "{}"), F.regexp_replace(spelled, "([,:])", "$1 ")))
        .when(F.try_variant_get(value, at, "double") != 0, plain)
    )


def generation_fields(text: Column, value: Column) -> Column:
    """A struct of what a text says under each of FIELDS, of its answer and of the support it implies, as it is written.

    ``value`` is ``json_object(text)``; where it is null the first yes or no and the labelled fields of the text count.
    """
    here = value.isNotNull()
    first = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"\b(yes|no|yeah|yep|nope)\b", 1)
    fields = {k: F.when(here, json_text(value, k)).otherwise(labeled_field(text, k)) for k in FIELDS} | {"answer": F.when(here, json_text(value, "answer")).otherwise(first)}
    return F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in fields.items()], infer_support(text).alias("inferred"))


def parsed_fields(text: Column, here: Column, field: Column) -> Column:
    """What ``parse_generation`` gives, of ``generation_fields``; ``here`` tells whether the text has an object."""
    evidence = F.coalesce(F.nullif(field["evidence_label"], F.lit("")), field["evidence"])
    named = field["support"] != ""
    relation = F.coalesce(*[F.nullif(field[k], F.lit("")) for k in ("relation", "claim", "evidence")], text)
    said = F.concat_ws(" ", field["claim"], field["evidence"], field["evidence_label"])
    useful = (field["answer"] != "") | (field["claim"] != "") | (field["evidence_label"] != "") | (field["evidence"] != "") | named | (field["inferred"] != "unknown")
    return F.struct(
        normalize_answer(field["answer"]).alias("answer"), clean_name(field["claim"]).alias("claim"), clean_name(evidence).alias("evidence_label"),
        normalize_support(F.when(here | named, field["support"]).otherwise(field["inferred"])).alias("support"), normalize_relation(relation).alias("relation"),
        clean_name(said).alias("said"), here.alias("json_valid"), (~here & ~useful).alias("parse_failed"),
    )


def parse_generation(text: Column, value: Column) -> Column:
    """A struct of answer, claim, evidence_label, support, relation, said (claim and evidence), json_valid and parse_failed.

    ``value`` is ``json_object(text)``, best a column of its own; where it is null the first yes or no and the labelled fields
    of the text count. Over tables ``generation_fields`` is best a column of its own too.
    """
    return parsed_fields(text, value.isNotNull(), generation_fields(text, value))
