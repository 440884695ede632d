"""Scores of model answers: confusion metrics, groups, probe rates, weighted rates, bootstrap and comparisons.

Counts are integers and ratios are plain divisions, unrounded; 0 where nothing is to be divided by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import generation_fields, json_object, normalize_answer, normalize_relation, normalize_support, normalize_target, parse_prediction, parsed_fields
from ..functions.steps import compiled_once
from ..functions.text import clean_name, has_evidence_cue, token_count, word_count
from .sampling import stable_unit


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def score_rows(df: DataFrame, target: str = "target", text: str = "generation") -> DataFrame:
    """Add prediction, is_refusal, is_correct, evidence_cue and n_words."""
    df = df.withColumn(target, normalize_target(F.col(target))).withColumn("prediction", parse_prediction(F.col(text)))
    correct = F.col(target).isin("yes", "no") & (F.col(target) == F.col("prediction"))
    return (
        df.withColumn("is_refusal", F.col("prediction") == "refusal").withColumn("is_correct", F.coalesce(correct, F.lit(False)))
        .withColumn("evidence_cue", has_evidence_cue(F.col(text))).withColumn("n_words", word_count(F.col(text)))
    )


def count_columns(target: str) -> dict[str, Column]:
    """What ``binary_metrics`` needs of scored rows, by name; all but max_words add up over parts of the rows."""
    t, p = F.col(target), F.col("prediction")
    n = lambda c: F.count_if(c)
    return {
        "n": F.count("*"), "n_yes": n(t == "yes"), "n_no": n(t == "no"), "tp": n((t == "yes") & (p == "yes")), "fp": n((t == "no") & (p == "yes")),
        "fn": n((t == "yes") & (p != "yes")), "tn": n((t == "no") & (p == "no")), "y2n": n((t == "yes") & (p == "no")), "n_correct": n(F.col("is_correct")),
        "n_pred_yes": n(p == "yes"), "n_pred_no": n(p == "no"), "n_refusal": n(F.col("is_refusal")), "n_other": n(p == "other"), "n_cue": n(F.col("evidence_cue")),
        "sum_words": F.sum("n_words"), "max_words": F.max("n_words"), "n_long": n(F.col("n_words") > 10),
    }


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Add the rates to rows of counts. A missed yes counts as one whatever was said; a true no must be said."""
    c = F.col
    out = counts.withColumns(
        {
            "accuracy": ratio(c("n_correct"), c("n")), "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("n_yes")),
            "specificity": ratio(c("tn"), c("n_no")), "negative_precision": ratio(c("tn"), c("tn") + c("y2n")), "fpr": ratio(c("fp"), c("n_no")),
            "fnr": ratio(c("fn"), c("n_yes")), "yes_bias": ratio(c("n_pred_yes"), c("n")), "no_bias": ratio(c("n_pred_no"), c("n")),
            "refusal_rate": ratio(c("n_refusal"), c("n")), "other_rate": ratio(c("n_other"), c("n")), "invalid_rate": ratio(c("n_refusal") + c("n_other"), c("n")),
            "cue_rate": ratio(c("n_cue"), c("n")), "avg_words": ratio(c("sum_words"), c("n")), "long_rate": ratio(c("n_long"), c("n")),
        }
    )
    both = F.when((c("n_yes") > 0) & (c("n_no") > 0), (c("recall") + c("specificity")) / 2)
    return out.withColumns(
        {
            "f1": ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")),
            "negative_f1": ratio(2 * c("negative_precision") * c("specificity"), c("negative_precision") + c("specificity")),
            "balanced_accuracy": both.when(c("n_yes") > 0, c("recall")).when(c("n_no") > 0, c("specificity")).otherwise(0.0),
        }
    )


def evaluate(scored: DataFrame, target: str = "target") -> DataFrame:
    return binary_metrics(scored.agg(*[v.alias(k) for k, v in count_columns(target).items()]))


def evaluate_groups(scored: DataFrame, fields: list[str], min_size: int = 20, target: str = "target") -> DataFrame:
    """Metrics of each value of each field, for groups of ``min_size`` rows or more; one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("group_field"), F.col(f).cast("string").alias("group_value")) for f in fields]))
    rows = scored.withColumn("_g", pairs).select("*", "_g.*")
    counts = rows.groupBy("group_field", "group_value").agg(*[v.alias(k) for k, v in count_columns(target).items()])
    return binary_metrics(counts.where(F.col("n") >= min_size))


def score_probes(rows: DataFrame, text: str = "generation") -> DataFrame:
    """Probe answers against their targets: prediction and predicted_* columns, and what is right, as booleans.

    ``rows`` have base_task_type, target_answer, target_support, target_evidence_label, target_claim, target_relation,
    target_subject and target_object. The evidence of a relation is right if claim or evidence name subject and object, other
    evidence if it is or contains the target's label. A missing target is never met, but an empty claim fits any claim.
    """
    c = F.col
    blank = lambda k: F.coalesce(clean_name(c(k)), F.lit(""))
    targets = {
        "support": normalize_support(c("target_support")), "answer": normalize_answer(c("target_answer")), "relation": normalize_relation(c("target_relation")),
        **{k: blank(f"target_{k}") for k in ("evidence_label", "claim", "subject", "object")},
    }
    out = compiled_once(rows, _json=json_object(c(text)))
    out = compiled_once(out, _here=c("_json").isNotNull(), _f=generation_fields(c(text), c("_json"))).drop("_json")
    out = compiled_once(out, _p=parsed_fields(c(text), c("_here"), c("_f"))).drop("_here", "_f")
    out = compiled_once(out, _t=F.struct(*[v.alias(k) for k, v in targets.items()]))
    is_relation = F.coalesce(c("base_task_type") == "relation_spatial", F.lit(False))
    has = lambda whole, part: F.contains(whole, part)
    support, label, claim, subject, obj, answer, relation = (c(f"_t.{k}") for k in ("support", "evidence_label", "claim", "subject", "object", "answer", "relation"))
    evidence = F.when(is_relation, (subject != "") & (obj != "") & has(c("_p.said"), subject) & has(c("_p.said"), obj)).otherwise((label != "") & has(c("_p.evidence_label"), label))
    return out.withColumns({
        "prediction": c("_p.answer"), "predicted_support": c("_p.support"), "predicted_evidence_label": c("_p.evidence_label"), "predicted_relation": c("_p.relation"),
        "answer_correct": (answer != "") & (c("_p.answer") == answer), "support_correct": c("_p.support") == support, "evidence_label_correct": evidence,
        "claim_match": (claim != "") & (has(claim, c("_p.claim")) | has(c("_p.claim"), claim)),
        "relation_direction_correct": F.when(is_relation, (relation != "") & (c("_p.relation") == relation)).otherwise(True),
        "wrong_evidence_rejected": (support == "wrong_evidence") & c("_p.support").isin("wrong_evidence", "contradicted", "unsupported"),
        "json_valid": c("_p.json_valid"), "parse_failed": c("_p.parse_failed"),
    }).drop("_p", "_t")


def _probe_counts() -> dict[str, Column]:
    """Counts of ``score_probes`` rows; n_met is the rejections where wrong evidence is the target."""
    c, n = F.col, F.count_if
    return {
        "n": F.count("*"), "n_answer": n("answer_correct"), "n_support": n("support_correct"), "n_evidence": n("evidence_label_correct"), "n_claim": n("claim_match"),
        "n_wrong": n(c("target_support") == "wrong_evidence"), "n_rejected": n(c("wrong_evidence_rejected")), "n_relation": n(c("base_task_type") == "relation_spatial"),
        "n_direction": n((c("base_task_type") == "relation_spatial") & c("relation_direction_correct")), "n_invalid_json": n(~c("json_valid")), "n_parse_failed": n("parse_failed"),
        "n_met": n(c("wrong_evidence_rejected") & (c("target_support") == "wrong_evidence")),
    }


def _probe_rates(counts: DataFrame, over_all: Column) -> DataFrame:
    c = F.col
    share = lambda k, of: F.round(ratio(c(k), of if isinstance(of, Column) else c(of)), 6)
    return counts.withColumn("n_rejected", F.when(over_all, c("n_met")).otherwise(c("n_rejected"))).drop("n_met").withColumns(
        {
            "answer_accuracy": share("n_answer", "n"), "support_accuracy": share("n_support", "n"), "evidence_label_accuracy": share("n_evidence", "n"),
            "claim_match_rate": share("n_claim", "n"), "wrong_evidence_rejection_accuracy": share("n_rejected", F.when(over_all, c("n_wrong")).otherwise(c("n"))),
            "relation_direction_accuracy": share("n_direction", "n_relation"), "invalid_json_rate": share("n_invalid_json", "n"), "parse_failure_rate": share("n_parse_failed", "n"),
        }
    )


def _probe_group(by: str) -> Column:
    return F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("unknown"))


def probe_metrics(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and rates of ``score_probes`` rows, over all of them or by the text of a column, where null and '' are "unknown".

    Over all rows the rejection of wrong evidence divides by the rows that have it as target, within groups by the group.
    """
    counts = [v.alias(k) for k, v in _probe_counts().items()]
    out = scored.groupBy(_probe_group(by).alias(by)).agg(*counts) if by else scored.agg(*counts)
    return _probe_rates(out, F.lit(by is None))


def probe_levels(scored: DataFrame, fields: list[str]) -> DataFrame:
    """``probe_metrics`` over all rows (level and name "all") and by each of ``fields`` (level: the field, name: its text).

    Rows are scored and counted once, by all fields together; levels are sums of these counts.
    """
    counts = _probe_counts()
    parts = scored.groupBy(*[_probe_group(f).alias(f"_{f}") for f in fields]).agg(*[v.alias(k) for k, v in counts.items()])
    level = lambda a, b: F.struct(F.lit(a).alias("level"), b.alias("name"))
    levels = F.explode(F.array(level("all", F.lit("all")), *[level(f, F.col(f"_{f}")) for f in fields]))
    out = parts.select(levels.alias("_l"), *counts).groupBy("_l.level", "_l.name").agg(*[F.sum(k).alias(k) for k in counts])
    return _probe_rates(out, F.col("level") == "all")


def predicted_supports(scored: DataFrame) -> DataFrame:
    """(predicted_support, n)."""
    return scored.groupBy("predicted_support").agg(F.count("*").alias("n"))


def weighted_rate(df: DataFrame, rate: str, count: str, by: list[str]) -> DataFrame:
    """sum(rate * count) / sum(count) over rows that have both; null if there are none."""
    both = F.col(rate).isNotNull() & F.col(count).isNotNull()
    total = F.sum(F.when(both, F.col(count)))
    return df.groupBy(*by).agg(F.when(total > 0, F.sum(F.when(both, F.col(rate) * F.col(count))) / total).alias("weighted_rate"))


def to_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value) rows of wide metrics."""
    return df.select(*ids, *[F.col(m).cast("double") for m in metrics]).unpivot(ids, metrics, "metric", "value")


def compare_models(scored: DataFrame, row_id: str, model: str, base: str, by: list[str]) -> DataFrame:
    """Accuracy of each model on the rows that all have, its difference to ``base``, and how many of base's errors it mends."""
    models = scored.select(model).distinct().count()
    whole = scored.groupBy(row_id).agg(F.count_distinct(model).alias("_m"), F.max(F.when(F.col(model) == base, F.col("is_correct"))).alias("base_correct"))
    rows = scored.join(whole.where(F.col("_m") == models), row_id)
    out = rows.groupBy(model, *by).agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"), F.count_if("base_correct").alias("n_base_correct"),
        F.count_if(~F.col("base_correct") & F.col("is_correct")).alias("n_recovered"), F.count_if(F.col("base_correct") & ~F.col("is_correct")).alias("n_lost"),
    )
    return out.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n"))).withColumn("delta", ratio(F.col("n_correct") - F.col("n_base_correct"), F.col("n")))


def bootstrap_rate(df: DataFrame, value: str, by: list[str], draws: int, seed: str = "boot") -> DataFrame:
    """Mean, standard error and 2.5 / 97.5 percentiles of the means of ``draws`` resamples of 0/1 values, by group.

    The sum of a resample of n zeros and ones is binomial, so each is drawn from its distribution by a hashed uniform number:
    probabilities follow from one to the next (over 40 standard deviations, beyond which they vanish), and one sort by
    value tells where each draw falls. Groups are never copied. An empty group gives no row.
    """
    c, key = F.col, F.concat_ws("|", *[F.col(b).cast("string") for b in by])
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(c(value).cast("double")).alias("mean")).where("mean is not null")
    sd, mid = F.sqrt(c("n") * c("mean") * (1 - c("mean"))), c("n") * c("mean")
    bound = lambda x: F.when(sd == 0, F.round(mid).cast("long")).otherwise(x)
    low = bound(F.greatest(F.lit(0), F.floor(mid - 40 * sd - 10).cast("long")))
    high = bound(F.least(c("n"), F.ceil(mid + 40 * sd + 10).cast("long")))
    groups = groups.withColumns({"lo": low, "hi": high})
    own = Window.partitionBy(*by)
    k = groups.withColumn("k", F.explode(F.sequence("lo", "hi")))
    step = F.when(c("k") > c("lo"), F.ln((c("n") - c("k") + 1) / c("k")) + F.ln(c("mean") / (1 - c("mean")))).otherwise(0.0)
    k = k.withColumn("l", F.sum(step).over(own.orderBy("k")))
    k = k.withColumn("w", F.exp(c("l") - F.max("l").over(own)))
    points = k.select(*by, "n", "mean", "lo", "hi", (F.sum("w").over(own.orderBy("k")) / F.sum("w").over(own)).alias("v"), F.lit(0).alias("draw"))
    u = stable_unit(seed, key, c("b"))
    drawn = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*by, "n", "mean", "lo", "hi", u.alias("v"), F.lit(1).alias("draw"))
    below = F.sum(1 - c("draw")).over(own.orderBy("v", c("draw").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = points.unionByName(drawn).withColumn("below", below).where("draw = 1")
    rows = rows.withColumn("drawn", F.least(c("lo") + c("below"), c("hi")).cast("double") / c("n"))
    q = lambda p: F.percentile("drawn", F.lit(p))
    return rows.groupBy(*by, "n", "mean").agg(F.stddev_samp("drawn").alias("se"), q(0.025).alias("low"), q(0.975).alias("high"))


# Task types by slice.
SLICES = {"object": ["object_existence"], "attribute": ["attribute_color", "attribute_material"], "relation": ["relation_spatial"]}


def slice_of(task: Column) -> Column:
    """The slice of a base task type, null for others."""
    return F.coalesce(*[F.when(task.isin(tasks), name) for name, tasks in SLICES.items()])


def slice_rates(rates: DataFrame, by: list[str], task: str, rate: str, count: str) -> DataFrame:
    """(by, slice, weighted_rate) of rates by base task type: several task types of a slice weigh by their counts."""
    return weighted_rate(rates.withColumn("slice", slice_of(F.col(task))).where("slice is not null"), rate, count, [*by, "slice"])


def ci_summary(rows: DataFrame, model: str, task: str, value: str, draws: int) -> DataFrame:
    """Bootstrap of 0/1 values by model over all rows, by slice and by task type: (model, level, name, n, mean, se, low, high)."""
    one = lambda level, name: F.struct(F.lit(level).alias("level"), name.alias("name"))
    levels = F.array(one("all", F.lit("all")), one("slice", slice_of(F.col(task))), one("task", F.col(task)))
    rows = rows.withColumn("_l", F.explode(levels)).select(model, value, "_l.*").where("name is not null")
    return bootstrap_rate(rows, value, [model, "level", "name"], draws)


def stress_slices(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of rejected rows of each stress type, six decimals."""
    return rows.groupBy(*by, "stress_type").agg(F.count("*").alias("n"), F.round(ratio(F.count_if("rejected"), F.count("*")), 6).alias("rejection"))


def with_pending(specs: DataFrame, found: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """Every spec with its metrics; ``status`` is pending where none of ``marks`` is known."""
    rows = specs.join(found, key, "left")
    return rows.withColumn("status", F.when(F.coalesce(*[F.col(m).cast("string") for m in marks]).isNull(), "pending").otherwise("complete"))


def record_summary(records: DataFrame, labels: list[str], texts: list[str], top: int = 20) -> DataFrame:
    """(measure, name, value): total, rows by source and task type, the ``top`` labels, and mean token counts to three decimals.

    Labels are columns; equal counts are in the order of their names.
    """
    c = F.col
    one = lambda measure, name: F.struct(F.lit(measure).alias("measure"), name.alias("name"))
    counted = F.array(one("total", F.lit("")), *[one(k, F.coalesce(k, F.lit("unknown"))) for k in ("source", "task_type")])
    label = F.array(*[F.when(F.coalesce(c(k), F.lit("")) != "", one("label", F.concat(F.lit(f"{k}:"), c(k)))) for k in labels])
    pairs = records.select(F.explode(F.concat(counted, F.array_compact(label))).alias("p")).select("p.*")
    n = pairs.groupBy("measure", "name").agg(F.count("*").cast("double").alias("value"))
    ranked = n.where("measure = 'label'").orderBy(F.desc("value"), "name").limit(top)
    means = records.agg(*[F.coalesce(F.round(F.avg(token_count(c(t))), 3), F.lit(0.0)).alias(t) for t in texts]).unpivot([], texts, "name", "value")
    return n.where("measure <> 'label'").unionByName(ranked).unionByName(means.select(F.lit("mean_tokens").alias("measure"), "name", "value"))


def trend(rows: DataFrame, step: str, value: str) -> DataFrame:
    """One row: first and last value by ``step``, the gain, and whether no step falls. For reports of a few rows."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v"))))
    falls = F.exists(F.zip_with(F.slice(F.col("p"), F.lit(1), F.size("p") - 1), F.slice(F.col("p"), F.lit(2), F.size("p") - 1), lambda a, b: b["v"] < a["v"]), lambda x: x)
    out = rows.agg(pairs.alias("p")).where(F.size("p") > 0)
    first, last = F.element_at("p", 1)["v"], F.element_at("p", -1)["v"]
    return out.select(first.alias("first"), last.alias("last"), (last - first).alias("gain"), F.when(F.size("p") < 2, True).otherwise(~falls).alias("monotonic"))


def passes_gate(rows: DataFrame, base: str, wrong: str, short: str, least_gain: float = 0.20, most_loss: float = 0.01) -> DataFrame:
    """Models that gain enough on wrong-evidence rejection over ``base`` without losing short-answer accuracy."""
    b = rows.where(F.col("model") == base).select(wrong, short).first()  # one row of a report
    if b is None:
        return rows.withColumn("passes", F.lit(None).cast("boolean"))
    return rows.withColumn("passes", (F.col(wrong) - F.lit(b[0]) >= least_gain) & (F.col(short) - F.lit(b[1]) >= -most_loss))
