"""Rows of evaluation and balanced training sets, and normalised rows of outside benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_phrase, clean_name
from .export import prompt
from .sampling import binned, capped_per_key, first_rows, multi_cap, running_sum, with_ids

# Names in s that are singular, in balanced rows.
SINGULAR = ["bus", "wine glass"]
# Where outside rows keep what they say, in order of preference.
IMAGE_KEYS = ["image", "image_path", "file_name", "filename"]
IMAGE_ID_KEYS = ["image_id", "imageId", "img_id"]
QUESTION_KEYS = ["question", "text", "prompt"]
LABEL_KEYS = ["label", "answer", "target"]
YES, NO = ["yes", "y", "true", "1"], ["no", "n", "false", "0"]


def first_value(df: DataFrame, keys: list[str]) -> Column:
    """The first of the columns that a table has and a row fills, as text."""
    held = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys if k in df.columns]
    return F.coalesce(*held, F.lit(None).cast("string"))


def yes_no(value: Column, present: bool = False) -> Column:
    """A label as yes or no; null for any other. With ``present``, "present" and "absent" count too."""
    t = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(t.isin(*YES, *(["present"] if present else [])), "yes").when(t.isin(*NO, *(["absent"] if present else [])), "no")


def image_path(image: Column, root: str, numbered: bool = False) -> Column:
    """A path as it is, any other name below ``root``; with ``numbered`` a bare number as a padded file name."""
    named = F.concat(F.lit(f"{root}/"), image)
    if numbered:
        padded = F.concat(F.lit(f"{root}/COCO_val2014_"), F.lpad(F.regexp_replace(image, "^0+(?=.)", ""), 12, "0"), F.lit(".jpg"))
        named = F.when(image.rlike("^[0-9]+$"), padded).otherwise(named)
    return F.when(F.contains(image, F.lit("/")), image).otherwise(named)


def object_benchmark(raw: DataFrame, number: Column, source: str, dimension: str, root: str) -> DataFrame:
    """Yes/no rows of an outside benchmark of objects; rows without question or target go. ``number`` is the row's number."""
    image, fallback = first_value(raw, IMAGE_KEYS), F.format_string("pope_%06d", number)
    stem = F.regexp_replace(image, r"^.*/|\.[^./]*$", "")
    numbered = F.when(F.startswith(stem, F.lit("COCO_")), F.regexp_extract(stem, "_0*([0-9]+)$", 1))
    image_id = F.coalesce(first_value(raw, IMAGE_ID_KEYS), F.nullif(numbered, F.lit("")), F.nullif(stem, F.lit("")), fallback)
    rows = raw.select(
        F.format_string(f"{source}_%06d", number).alias("id"), F.lit(source).alias("source"), F.coalesce(first_value(raw, ["question_id", "id"]), number.cast("string")).alias("source_id"),
        F.lit(dimension).alias("dimension"), F.coalesce(image_path(image, root, numbered=True), F.concat(F.lit(f"{root}/"), image_id)).alias("image"), image_id.alias("image_id"),
        F.trim(first_value(raw, QUESTION_KEYS)).alias("question"), yes_no(first_value(raw, LABEL_KEYS), True).alias("target"), F.lit("object_existence").alias("task_type"),
    )
    return rows.where("question is not null and target is not null")


def annotated_benchmark(queries: DataFrame, annotations: DataFrame, order: Column, source: str, root: str, fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of queries (id, image, query) with their annotations (id, type, truth), and the ids of queries without one.

    Of queries with one id the first by ``order`` stays; rows whose type gives no dimension take ``fallback`` or go. A truth
    that is neither yes nor no is an error.
    """
    first = queries.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_r = 1").drop("_r")
    lacking = first.join(annotations, "id", "left_anti").select("id")
    kind = F.coalesce("type", F.lit(""))
    dimension = F.when(kind == "discriminative-hallucination", "existence").when(F.startswith(kind, F.lit("discriminative-attribute-")), "attribute").when(kind.isin("discriminative-relation", "relation"), "relation").otherwise(F.lit(fallback))
    named = F.when(kind == "discriminative-hallucination", "object_existence").when(kind.isin("discriminative-relation", "relation"), "relation")
    for state in ("state", "number", "action"):
        named = named.when(kind == f"discriminative-attribute-{state}", f"attribute_{state}")
    image = F.coalesce(F.nullif("image", F.lit("")), F.concat(F.lit("AMBER_"), F.col("id").cast("string"), F.lit(".jpg")))
    target = F.coalesce(yes_no(F.col("truth")), F.raise_error(F.concat(F.lit("neither yes nor no: "), F.coalesce("truth", F.lit("null")))))
    rows = first.join(annotations, "id").withColumn("dimension", dimension).where("dimension is not null")
    rows = rows.select(
        F.format_string(f"{source}_%06d", F.col("id").cast("long")).alias("id"), F.lit(source).alias("source"), F.col("id").alias("source_id"), "dimension", kind.alias("type"),
        image_path(image, root).alias("image"), F.regexp_replace(image, r"^.*/|\.[^.]*$", "").alias("image_id"), F.trim("query").alias("question"), target.alias("target"),
        named.otherwise(F.when(kind == "", "unknown").otherwise(kind)).alias("task_type"),
    )
    return rows, lacking


def _plural(name: Column) -> Column:
    return F.endswith(name, F.lit("s")) & ~name.isin(SINGULAR)


def _phrase(name: Column) -> Column:
    return F.when(name.isin(SINGULAR), F.concat(F.lit("a "), name)).otherwise(article_phrase(name))


def balanced_rows(rows: DataFrame, side: str = "input") -> DataFrame:
    """Training rows of yes/no questions (id, image, target, target_object) with a cue of what the image supports.

    On the ``input`` side the cue stands in the prompt, on the ``response`` side as evidence after both answers. A target that
    is neither yes nor no, or a row without an object, is an error.
    """
    name = clean_name(F.col("target_object"))
    wrong = ~F.coalesce(F.col("target").isin("yes", "no"), F.lit(False)) | (F.coalesce(name, F.lit("")) == "")
    name = F.when(wrong, F.raise_error(F.concat(F.lit("no target or object: "), F.col("id").cast("string")))).otherwise(name)
    phrase, verb, many = _phrase(F.col("_name")), F.when(_plural(F.col("_name")), "are").otherwise("is"), _plural(F.col("_name"))
    rows = rows.withColumn("_name", name)
    supported = F.concat(phrase, F.lit(" "), verb, F.lit(" visually supported in the image."))
    lacking = F.concat(phrase, F.lit(" "), verb, F.lit(" not visually supported in the image."))
    yes = F.concat(F.lit("Yes, there "), verb, F.lit(" "), phrase, F.lit(" in the image."))
    no = F.concat(F.when(many, "No, there are no ").otherwise("No, there is no "), F.col("_name"), F.lit(" in the image."))
    question = F.concat(F.when(many, "Are there ").otherwise("Is there "), phrase, F.lit(" in the image?"))
    is_yes = F.col("target") == "yes"
    if side == "input":
        text = prompt(question, F.concat(F.lit("Visual cue: "), F.when(is_yes, supported).otherwise(lacking)))
        told_yes, told_no = yes, no
    else:
        text = prompt(question)
        told_yes, told_no = F.concat(yes, F.lit("\nEvidence: "), supported), F.concat(no, F.lit("\nEvidence: "), lacking)
    chosen, rejected = F.when(is_yes, told_yes).otherwise(told_no), F.when(is_yes, told_no).otherwise(told_yes)
    return rows.select("id", "image", text.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), "target", F.col("_name").alias("target_object"))


def anchor_rows(records: DataFrame) -> DataFrame:
    """Graph records (id, image, question, chosen, rejected, hint_chosen, source) with the body of their hint as cue."""
    body = F.when(F.contains("hint_chosen", F.lit("Evidence hint:")), F.trim(F.regexp_extract("hint_chosen", r"(?s)Evidence hint:(.*)$", 1)))
    body = F.coalesce(body, F.raise_error(F.concat(F.lit("hint lacks its prefix: "), F.col("id").cast("string"))))
    rows = records.where("source = 'gqa'")
    return rows.select(F.concat(F.col("id").cast("string"), F.lit("::anchor")).alias("id"), "image", prompt(F.trim("question"), F.concat(F.lit("Visual cue: "), body)).alias("prompt"), "chosen", "rejected", F.col("id").alias("origin_id"))


def graph_eval_rows(attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """Two yes/no rows of each attribute pair (id, object, task_type, attribute, negative) and left/right relation pair."""
    c = F.col
    make = lambda q, target, text: F.struct(q.alias("question"), F.lit(target).alias("target"), text.alias("target_text"))
    of = F.when(c("task_type") == "attribute_material", F.lit("made of ")).otherwise(F.lit(""))
    ask = lambda a: F.concat(F.lit("Is the "), "object", F.lit(" "), of, a, F.lit("?"))
    a = attributes.where("object <> '' and attribute <> '' and negative <> ''").select("id", "task_type", F.explode(F.array(make(ask("attribute"), "yes", c("attribute")), make(ask("negative"), "no", c("negative")))).alias("q"))
    told = lambda r: F.concat(F.lit("Is the "), "subject", F.lit(" to the "), r, F.lit(" of the "), "object", F.lit("?"))
    r = relations.where("relation in ('left', 'right') and negative in ('left', 'right') and subject <> '' and object <> ''")
    r = r.select("id", F.lit("relation_spatial").alias("task_type"), F.explode(F.array(make(told("relation"), "yes", c("relation")), make(told("negative"), "no", c("negative")))).alias("q"))
    return a.unionByName(r).select(c("id").alias("source_id"), "task_type", "q.*")


def locked_rows(
    rows: DataFrame, total: int, caps: dict[str, int], order: list[str], store, kind: str = "error_type", kinds: tuple[str, str] = ("false_positive", "false_negative"), refill: tuple[str, ...] = ()
) -> DataFrame:
    """``total`` rows of two kinds, half of each, then whatever is left, under caps on several keys at once.

    Exactly what a sequential pass takes: the first kind in ``order`` up to its half, then the second, then the rest of
    both and the kinds that may only ``refill``, each row only while all its keys are below their caps. ``order`` must be
    unique; ``store`` as for multi_cap.
    """
    rows = store(rows.where(F.col(kind).isin(*kinds, *refill)), "eligible")
    total = min(total, rows.count())
    quota, taken = {kinds[0]: total // 2, kinds[1]: total - total // 2}, None
    key = lambda df: df.select(*order)
    for k, n in quota.items():
        new = first_rows(multi_cap(rows.where(F.col(kind) == k), caps, order, store, taken), order, n, store, f"first-{k}")
        taken = store(new if taken is None else taken.unionByName(new), f"taken-{k}")
    missing = total - taken.count()
    if missing:
        rest = rows.join(key(taken), order, "left_anti")
        taken = store(taken.unionByName(first_rows(multi_cap(rest, caps, order, store, taken), order, missing, store)), "taken-rest")
    return rows.join(key(taken), order, "left_semi")


#: What a mined row keeps of the row it was chosen from, and how it is named.
MINED_FIELDS = "image image_id question target target_object target_text task_type candidate_strategy positive_object negative_object pair_id".split()
MINED_PREFIX, MINED_SOURCE = "base_error_mined", "base_error_mined_coco_object_existence"


def mined_rows(locked: DataFrame, prediction: str = "prediction", kind: str = "error_type") -> DataFrame:
    """Locked rows numbered in the order of their ids as text, with the fields of MINED_FIELDS that they have."""
    rows = locked.withColumn("_id", F.col("id").cast("string"))
    kept = [F.col(c) for c in MINED_FIELDS if c in locked.columns]
    rows = rows.select(F.lit(MINED_SOURCE).alias("source"), F.col("_id").alias("source_candidate_id"), *kept, F.col(prediction).alias("base_prediction"), F.col(kind).alias("base_error_type"))
    return with_ids(rows, MINED_PREFIX, ["source_candidate_id"])


def strategy_pairs(pairs: DataFrame, n: int, per_image: int, order: list[str], store) -> DataFrame:
    """``n`` pairs (image_id, positive, negative, strategy) in turn from the strategies, exactly as a sequential pass takes them.

    In each turn every strategy, by name, gives its next pair in ``order`` that isn't refused. A pair is refused if its image
    has ``per_image`` pairs already, or one with the same positive or the same negative. ``order`` must be unique within a
    strategy; ``store`` as for multi_cap.

    A pair's turn is one more than the pairs of its strategy taken before it, and what is taken of an image depends on the
    turns of its pairs. Both are worked out again and again, first as if nothing were refused, until they agree on all turns
    up to the last one that is needed; only the sequential result agrees with itself. Turns are sums over ranges of the
    order, and of an image only the pairs that could be taken meet in one row.

    A pass reads no more of a strategy than it needs. The first pairs of each are tried alone, and many more of them until
    none that has further pairs runs out before the n-th pair: then the result is that of all pairs.
    """
    size, by = 8 * max(n, 1), [F.col(c) for c in order]
    while size <= WHOLE:
        # One more tells whether there are further ones; in parts first, so that no task sorts a whole strategy.
        parts = capped_per_key(pairs.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64))), ["strategy", "_part"], size + 1, by)
        first = capped_per_key(parts.drop("_part"), ["strategy"], size + 1, by)
        first = store(first.withColumn("_place", F.row_number().over(Window.partitionBy("strategy").orderBy(*by))), f"first{size}")
        further = [r.strategy for r in first.where(F.col("_place") == size + 1).select("strategy").collect()]  # a row a strategy
        out, have, last = _in_turn(first.where(F.col("_place") <= size).drop("_place"), n, per_image, order, lambda df, name: store(df, f"{name}-{size}"))  # noqa: B023
        if not further or (sum(have.values()) >= n and all(have.get(s, 0) >= last for s in further)):
            return out
        size *= 16
    return _in_turn(pairs, n, per_image, order, store)[0]


#: Pairs of a strategy up to which it is tried apart; beyond, all pairs are taken.
WHOLE = 1 << 20


def _in_turn(pairs: DataFrame, n: int, per_image: int, order: list[str], store) -> tuple[DataFrame, dict, int]:
    """What a pass takes of all ``pairs``, how many each strategy could give, and the last turn."""
    columns = ["image_id", "positive", "negative", "strategy", *[c for c in order if c not in ("image_id", "positive", "negative", "strategy")]]
    rows = binned(pairs.select(*columns), order, store, "pairs")
    rows = store(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_alive", F.lit(True)), "pairs0")
    turn = 0
    while True:
        turned = running_sum(rows, ["strategy"], order, "_upto", F.col("_alive").cast("long"))
        turned = store(turned.withColumn("turn", F.col("_upto") - F.col("_alive").cast("long") + 1).drop("_upto"), f"turned{turn}")
        taken = _taken(turned, per_image, order).withColumnRenamed("_id", "_taken")
        after = store(turned.join(taken, F.col("_id") == F.col("_taken"), "left").withColumn("_now", F.col("_taken").isNotNull()).drop("_taken"), f"after{turn}")
        have = {r.strategy: r.n for r in turned.where("_alive").groupBy("strategy").agg(F.count("*").alias("n")).collect()}  # a row a strategy
        last = _last_turn(list(have.values()), n)
        if after.where((F.col("turn") <= last) & (F.col("_now") != F.col("_alive"))).isEmpty():
            chosen = after.where("_alive").where(F.col("turn") <= last).select("image_id", "positive", "negative", "strategy", "turn")
            return first_rows(chosen, ["turn", "strategy"], n, store, "chosen"), have, last
        rows = after.select(*columns, "_bin", "_id", F.col("_now").alias("_alive"))
        turn += 1


def _last_turn(have: list[int], n: int) -> int:
    """The turn in which strategies with so many pairs give the n-th."""
    low, high = 0, max(have, default=0)
    if sum(have) <= n:
        return high
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if sum(min(c, mid) for c in have) >= n else (mid + 1, high)
    return low


def _taken(turned: DataFrame, per_image: int, order: list[str]) -> DataFrame:
    """The ``_id`` of the pairs that images take, in the order of turn and strategy.

    Of equal pairs the first counts. With k to be taken, only the first k pairs of each positive and of each negative can be
    among them, and of those only the first k + 2 (k - 1)^2 of an image.
    """
    when = F.struct("turn", "strategy", *[F.col(c).alias(f"o_{c}") for c in order], "_id")
    one = turned.groupBy("image_id", "positive", "negative").agg(F.min(when).alias("when"))
    for part, most in ((["image_id", "positive"], per_image), (["image_id", "negative"], per_image), (["image_id"], per_image + 2 * (per_image - 1) ** 2)):
        one = capped_per_key(one, part, most, [F.col("when")])
    images = one.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("when", "positive", "negative"))).alias("items"))
    kind = images.schema["items"].dataType.simpleString()
    clash = lambda kept, x: F.exists(kept, lambda y: y["positive"].eqNullSafe(x["positive"]) | y["negative"].eqNullSafe(x["negative"]))
    fold = lambda kept, x: F.when((F.size(kept) >= per_image) | clash(kept, x), kept).otherwise(F.concat(kept, F.array(x)))
    return images.select(F.explode(F.aggregate("items", F.array().cast(kind), fold)).alias("k")).select("k.when._id")


def audited(sheet: DataFrame, records: DataFrame, columns: dict[str, Column], overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """An audit sheet (id and mark columns) with its empty marks filled from its records, and the ids that have no record."""
    rows = sheet.join(records.withColumn("_found", F.lit(True)), "id", "left")
    found = F.coalesce("_found", F.lit(False))
    filled = {c: F.when(found & (F.lit(overwrite) | (F.coalesce(F.trim(c), F.lit("")) == "")), F.when(ok, "yes").otherwise("no")).otherwise(F.col(c)) for c, ok in columns.items()}
    return rows.withColumns(filled).select("id", *columns), rows.where(~found).select("id")
