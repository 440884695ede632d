"""From annotations and scene graphs to preference pairs and claim records.

Annotation tables: images (image_id, file_name, width, height), annotations (image_id, category_id, x, y, w, h, area,
iscrowd), categories (category_id, name). Scene graphs: objects (image_id, object_id, name, x, y, w, h, attributes,
relations array<struct<name, object>>), or graphs with a map of them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_area, holds_relation, normalize_xywh
from ..functions.steps import compiled_once, once
from ..functions.text import article_phrase, be_verb, canonical_image_id, clean_name, filled
from .sampling import capped_per_key, stable_key, stable_unit

# Objects whose absence annotations hardly prove, colours, materials, other names for them, attributes that
# are easily confused, flipped relations.
LOW_CONFIDENCE = ["fork", "knife", "spoon", "remote", "cell phone", "toothbrush", "hair drier", "scissors", "sports ball", "tie", "handbag", "book", "clock", "mouse", "keyboard"]
COLORS = ["black", "blue", "brown", "gray", "green", "orange", "pink", "purple", "red", "white", "yellow"]
MATERIALS = ["brick", "ceramic", "cloth", "fabric", "glass", "leather", "metal", "paper", "plastic", "rubber", "stone", "wooden"]
ALIASES = {"grey": "gray", "silver": "gray"}
CONFUSABLE = [("gray", "white"), ("gray", "black"), ("white", "gray"), ("white", "yellow"), ("brown", "orange"), ("orange", "brown")]
FLIPS = {"left": "right", "right": "left", "above": "below", "below": "above"}
#: How much likelier a related class is drawn, and how much less likely a doubtful or confusable one.
RELATED, DOUBTFUL = 3.0, 0.35
QUESTIONS = ["Is there {} in the image?", "Can you see {} in this image?", "Does the image contain {}?"]


def visible_objects(images: DataFrame, annotations: DataFrame, categories: DataFrame, min_area: float = 0.01) -> DataFrame:
    """(image_id, name, max_area): classes seen in each image, crowds and boxes below ``min_area`` of the image left out."""
    area = F.coalesce(F.nullif("area", F.lit(0)), box_area(F.col("w"), F.col("h")))
    named = categories.select("category_id", clean_name(F.col("name")).alias("name"))  # a name is cleaned once, not once a box
    boxes = annotations.where(F.coalesce("iscrowd", F.lit(0)) != 1).select("image_id", "category_id", area.alias("box"))
    rows = boxes.join(images.select("image_id", "width", "height"), "image_id").join(named, "category_id")
    rows = rows.where((F.col("width") * F.col("height") > 0) & (F.col("box") >= min_area * F.col("width") * F.col("height")))
    return rows.groupBy("image_id", "name").agg(F.max("box").alias("max_area"))


def best_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame, order: list[str]) -> DataFrame:
    """(image_id, image, name, box): the valid box with the largest annotated area of each class of an image.

    Crowds, boxes that are empty within the image and images without a size don't count; a missing area is 0. Of equal areas
    the first annotation in ``order`` wins. ``image`` is the canonical id by the file name.
    """
    rows = annotations.where(F.coalesce("iscrowd", F.lit(0)) != 1).join(images, "image_id").join(categories, "category_id").withColumn("name", clean_name(F.col("name")))
    box = normalize_xywh(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    rows = rows.withColumn("box", F.when((F.col("width") > 0) & (F.col("height") > 0), box)).where("box is not null and name <> ''")
    best = capped_per_key(rows.withColumn("area", F.coalesce("area", F.lit(0.0))), ["image_id", "name"], 1, [F.col("area").desc(), *map(F.col, order)])
    return best.select("image_id", canonical_image_id(F.col("file_name"), F.col("image_id")).alias("image"), "name", "box")


def absent_candidates(visible: DataFrame, groups: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(image_id, positive, negative): for each visible class the classes of its coarse group that the image lacks.

    ``groups`` (name, grp) is a vocabulary. An image's classes become one row, a group's too; each visible class meets its
    group's list once, broadcast only if the vocabulary is small.
    """
    images = visible.groupBy("image_id").agg(F.collect_set("name").alias("seen"))
    own = images.select("image_id", "seen", F.explode("seen").alias("positive"))
    named = groups.select(F.col("name").alias("_name"), "grp").distinct()
    members = named.groupBy("grp").agg(F.array_sort(F.collect_set("_name")).alias("_all"))
    known = small(named.join(members, "grp"), groups)
    rows = own.join(known, F.col("positive") == F.col("_name"))
    lacks = F.array_except("_all", F.concat("seen", F.array(*map(F.lit, exclude or [])).cast("array<string>")))
    return rows.select("image_id", "positive", F.explode(lacks).alias("negative"), "grp")


#: Bytes of a vocabulary up to which it is broadcast: a name and its group in each row of a class, and in its group's list.
BROADCAST = 32 << 20


def small(df: DataFrame, measured: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it takes no more than ``limit`` bytes: each row holds the names of its group in ``measured``."""
    names = measured.select("name", "grp").distinct().groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("name") + 16).alias("b"))
    total = names.agg(F.coalesce(F.sum(F.col("n") * (F.col("b") + 64)), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= limit else df


def vocabulary(names: DataFrame) -> Column:
    """A table (name, grp) as an array of (name, grp), sorted by name: one value that all rows share."""
    return names.agg(F.array_sort(F.collect_set(F.struct("name", "grp")))).scalar()


def drawn(options: Column, weight, seed: str, *ids: Column) -> Column:
    """The member of an array of (name, ...) that is drawn with chances by ``weight(member)``: the largest ln(u) / weight."""
    scored = F.transform(options, lambda o: F.struct((F.ln(stable_unit(seed, *ids, o["name"])) / weight(o)).alias("s"), o["name"].alias("o")))
    return F.array_max(scored)["o"]


def object_pairs(visible: DataFrame, groups: DataFrame, per_image: int = 2, seed: str = "pairs") -> DataFrame:
    """Preference pairs on what an image shows: the chosen answer names a visible class, the rejected one an absent class.

    Positives are drawn by area without replacement. Negatives are drawn from all classes that the image lacks, those of the
    positive's group with three times the chance, doubtful ones with 0.35 of it. Images need two visible classes at least.
    One shuffle: an image's classes are one row, bounded by the vocabulary ``groups`` (name, grp).
    """
    c, known = F.col, F.col("known")
    images = visible.groupBy("image_id").agg(F.collect_list(F.struct("name", c("max_area").cast("double").alias("area"))).alias("seen")).where(F.size("seen") >= 2)
    score = lambda o: F.ln(stable_unit(seed, c("image_id"), o["name"])) / F.greatest(o["area"], F.lit(1.0))
    ranked = F.array_sort(F.transform("seen", lambda o: F.struct((-score(o)).alias("k"), o["name"].alias("name"))))
    pairs = images.select("image_id", F.transform("seen", lambda o: o["name"]).alias("seen"), F.explode(F.slice(ranked, 1, per_image)).alias("p")).select("image_id", "seen", c("p.name").alias("positive"))
    pairs = pairs.withColumn("known", vocabulary(groups))
    pairs = pairs.withColumn("grp", F.try_element_at(F.transform(F.filter(known, lambda v: v["name"] == c("positive")), lambda v: v["grp"]), F.lit(1)))
    # ln(u) / weight is largest where u is, among classes of one weight: digits are compared, four candidates are weighed.
    start = F.concat(F.concat_ws("|", F.lit(seed), c("image_id").cast("string"), c("positive")), F.lit("|"))
    absent = F.filter(known, lambda v: ~F.array_contains(c("seen"), v["name"]))
    pairs = compiled_once(pairs, _start=start, _grp=c("grp"), _absent=absent).select("image_id", "positive", "_grp", "_start", "_absent")
    key = lambda v: F.concat(F.substring(F.md5(F.concat("_start", v["name"])), 1, 8), v["name"])
    pairs = compiled_once(pairs, _keys=F.transform("_absent", lambda v: F.struct(F.coalesce(v["grp"] == c("_grp"), F.lit(False)).alias("r"), v["name"].isin(LOW_CONFIDENCE).alias("d"), key(v).alias("k"))))
    weights = {(r, d): (RELATED if r else 1.0) * (DOUBTFUL if d else 1.0) for r in (True, False) for d in (True, False)}
    of = lambda r, d: F.filter("_keys", lambda v: (v["r"] == F.lit(r)) & (v["d"] == F.lit(d)))
    pairs = compiled_once(pairs, **{f"_best{i}": F.array_max(F.transform(of(*k), lambda v: v["k"])) for i, k in enumerate(weights)})
    unit = lambda k: (F.conv(F.substring(k, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = [F.when(c(f"_best{i}").isNotNull(), F.struct((F.ln(unit(c(f"_best{i}"))) / w).alias("s"), F.expr(f"substring(_best{i}, 9)").alias("o"))) for i, w in enumerate(weights.values())]
    pairs = compiled_once(pairs.select("image_id", "positive", *[f"_best{i}" for i in range(len(weights))]), negative=F.greatest(*scored)["o"]).where("negative is not null")
    q = F.conv(F.substring(stable_key(seed + "q", c("image_id"), c("positive")), 1, 7), 16, 10).cast("int") % len(QUESTIONS)
    pairs = compiled_once(pairs, _q=q, _phrase=article_phrase(c("positive")), _other=article_phrase(c("negative")))
    question = F.coalesce(*[F.when(c("_q") == k, filled(t.replace("{}", "%s"), "_phrase")) for k, t in enumerate(QUESTIONS)])
    return pairs.select(
        "image_id", "positive", "negative", question.alias("question"),
        filled("Yes, there is %s in the image.", "_phrase").alias("chosen"), filled("Yes, there is %s in the image.", "_other").alias("rejected"),
        filled("Evidence hint: annotated visible object: %s.", "positive").alias("hint_chosen"),
        filled("Evidence hint: unsupported object: %s is not annotated as visible.", "negative").alias("hint_rejected"),
    )


def scene_objects(graphs: DataFrame, with_boxes: bool = True) -> DataFrame:
    """Objects of scene graphs (image_id, width, height, objects map of id to name, x, y, w, h, attributes, relations).

    Returns image_id, object_id, name, box, attributes, relations; objects without a name go, and with ``with_boxes`` those
    without a box and graphs without a size. Graphs may be given a row an object too, (object_id, o) in place of the map.
    """
    rows = graphs.select("image_id", "width", "height", F.explode("objects").alias("object_id", "o")) if "objects" in graphs.columns else graphs
    box = normalize_xywh(*[F.col(f"o.{k}") for k in "xywh"], F.col("width"), F.col("height"))
    empty = lambda k: F.coalesce(F.col(f"o.{k}"), F.expr("array()"))
    rows = once(rows, name=clean_name(F.col("o.name")), box=box).select("image_id", "object_id", "name", "box", empty("attributes").alias("attributes"), empty("relations").alias("relations"))
    return rows.where((F.col("name") != "") & (F.col("box").isNotNull() if with_boxes else F.lit(True)))


def simple_attributes(attributes: Column) -> Column:
    """The colours and materials among attributes, each once, as an array of (kind, attribute)."""

    def usual(name: Column) -> Column:
        return F.coalesce(*[F.when(name == x, y) for x, y in ALIASES.items()], name)

    def told(name: Column) -> Column:
        return F.struct(F.when(name.isin(COLORS), "color").when(name.isin(MATERIALS), "material").alias("kind"), name.alias("attribute"))

    return F.array_distinct(F.filter(F.transform(F.transform(F.transform(attributes, clean_name), usual), told), lambda t: t["kind"].isNotNull()))


def side(name: Column) -> Column:
    """A relation's name as left, right, above or below; null for any other."""
    named = lambda r: (
        F.when((r == "left") | F.contains(r, F.lit("left of")), "left").when((r == "right") | F.contains(r, F.lit("right of")), "right")
        .when(r.isin("above", "above of", "over"), "above").when(r.isin("below", "below of", "under", "underneath"), "below")
    )
    return F.transform(F.array(clean_name(name)), named)[0]  # cleaned once


def flipped(relation: Column) -> Column:
    return F.coalesce(*[F.when(relation == a, b) for a, b in FLIPS.items()])


def attribute_candidates(objects: DataFrame) -> DataFrame:
    """(image_id, object_id, object, box, kind, attribute) of every colour and material of ``scene_objects``."""
    rows = objects.withColumn("t", F.explode(simple_attributes(F.col("attributes"))))
    return rows.select("image_id", "object_id", F.col("name").alias("object"), "box", "t.kind", "t.attribute")


def relation_candidates(objects: DataFrame, check_boxes: bool = False) -> DataFrame:
    """(image_id, subject_id, subject, subject_box, object_id, object, object_box, relation) of edges whose target exists.

    With ``check_boxes`` only left and right are kept, where the boxes bear them out.
    """
    edges = objects.select("image_id", F.col("object_id").alias("subject_id"), F.col("name").alias("subject"), F.col("box").alias("subject_box"), F.explode("relations").alias("r"))
    edges = once(edges, relation=side(F.col("r.name"))).where("relation is not null").withColumn("to", F.col("r.object")).drop("r")
    targets = objects.select(F.col("image_id").alias("i"), F.col("object_id"), F.col("name").alias("object"), F.col("box").alias("object_box"))
    out = edges.join(targets, (F.col("image_id") == F.col("i")) & (F.col("to") == F.col("object_id"))).drop("i", "to").distinct()
    if check_boxes:
        out = out.where(holds_relation(F.concat("relation", F.lit("_of")), F.col("subject_box"), F.col("object_box")))
    return out


def negative_attribute(kind: Column, attribute: Column, seed: str, *ids: Column) -> Column:
    """Another attribute of the kind; those that are easily confused with it have 0.35 of the chance.

    Drawn as in ``drawn``, by the largest ln(u) / weight. Where weights are equal the digits of u tell, so that logarithms are
    needed for the best of those and for the few that are confused with it.
    """
    options = F.when(kind == "color", F.array(*map(F.lit, COLORS))).otherwise(F.array(*map(F.lit, MATERIALS)))
    near = F.coalesce(*[F.when(attribute == a, F.array(*[F.lit(y) for x, y in CONFUSABLE if x == a])) for a in dict(CONFUSABLE)], F.array().cast("array<string>"))
    start = F.concat_ws("|", F.lit(seed), *[i.cast("string") for i in ids], F.lit(""))  # with a name behind it what stable_key is of
    digits = lambda s, o: F.substring(F.md5(F.concat(s, o)), 1, 8)
    chance = lambda d, w: F.ln((F.conv(d, 16, 10).cast("double") + 0.5) / 4294967296.0) / w
    others = F.array_except(options, F.concat(near, F.array(attribute)))

    def best(s: Column) -> Column:
        return F.array_max(F.transform(others, lambda o: F.struct(digits(s, o).alias("d"), o.alias("o"))))

    def against(s: Column, b: Column) -> Column:
        confused = F.transform(F.array_intersect(options, near), lambda o: F.struct(chance(digits(s, o), DOUBTFUL).alias("s"), o.alias("o")))
        return F.array_max(F.concat(F.array(F.struct(chance(b["d"], 1.0).alias("s"), b["o"].alias("o"))), confused))["o"]

    # A transformed array of one: its variable is worked out once.
    one = F.transform(F.array(start), lambda s: F.transform(F.array(best(s)), lambda b: F.when(F.size(near) == 0, b["o"]).otherwise(against(s, b)))[0])[0]
    return F.when(attribute.isNotNull(), one)


def with_negatives(candidates: DataFrame, seed: str, *ids: str) -> DataFrame:
    """Rows of ``attribute_candidates`` with ``negative``, as ``negative_attribute`` draws it over the columns ``ids``.

    For tables of any size: options are written out one by one, so that the draw is compiled; what a lambda does is interpreted,
    which takes twice as long.
    """
    c, near = F.col, {a: [y for x, y in CONFUSABLE if x == a] for a in dict(CONFUSABLE)}
    is_color = F.coalesce(c("kind") == "color", F.lit(False))
    confused = [F.coalesce(*[F.when(c("attribute") == a, o[i]) for a, o in near.items() if i < len(o)]) for i in range(max(map(len, near.values())))]
    digits = lambda o: F.substring(F.md5(F.concat("_start", o)), 1, 8)
    chance = lambda d, weight: F.ln((F.conv(d, 16, 10).cast("double") + 0.5) / 4294967296.0) / weight

    def candidate(i: int) -> Column:
        option = F.when(c("_is_color"), COLORS[i] if i < len(COLORS) else None).otherwise(MATERIALS[i] if i < len(MATERIALS) else None)
        # Null, and so left out by greatest, for the attribute itself, one that is confused with it and the shorter list's end.
        others = [option != c("attribute")] + [~(c("_is_color") & option.eqNullSafe(c(f"_near{k}"))) for k in range(len(confused))]
        return F.when(reduce(and_, others), F.concat(digits(option), option))

    rows = once(candidates, _start=F.concat_ws("|", F.lit(seed), *[c(i).cast("string") for i in ids], F.lit("")), _is_color=is_color, **{f"_near{i}": o for i, o in enumerate(confused)})
    n = max(len(COLORS), len(MATERIALS))
    rows = rows.withColumn("_best", F.lit(""))
    for i in range(0, n, 4):  # a few at a time: methods of more than 8000 bytes aren't compiled
        rows = once(rows, _best=F.greatest("_best", *map(candidate, range(i, min(i + 4, n)))))
    best = F.substring("_best", 9, 1000)
    scored = [F.struct(chance(F.substring("_best", 1, 8), 1.0).alias("s"), best.alias("o"))]
    scored += [F.when(c(f"_near{i}").isNotNull(), F.struct(chance(digits(c(f"_near{i}")), DOUBTFUL).alias("s"), c(f"_near{i}").alias("o"))) for i in range(len(confused))]
    drawn_one = F.when(c("attribute").isNull(), None).when(c("_is_color") & c("_near0").isNotNull(), F.greatest(*scored)["o"]).otherwise(best)
    rows = once(rows, negative=drawn_one)
    return rows.drop("_start", "_is_color", "_best", *[f"_near{i}" for i in range(len(confused))])


def attribute_pairs(candidates: DataFrame, seed: str = "attr") -> DataFrame:
    """A colour or material of each of ``attribute_candidates`` against another of the same kind, drawn unless they have it."""
    c = F.col
    if "negative" not in candidates.columns:
        candidates = once(candidates, negative=negative_attribute(c("kind"), c("attribute"), seed, c("image_id"), c("object_id"), c("attribute")))
    rows = once(candidates, _verb=be_verb(c("object")))
    said = lambda a: filled("The %s %s %s.", "object", "_verb", a)
    return rows.select(
        "image_id", "object_id", "object", F.concat(F.lit("attribute_"), "kind").alias("task_type"), "attribute", "negative",
        filled("What %s is the %s?", "kind", "object").alias("question"), said("attribute").alias("chosen"), said("negative").alias("rejected"),
        filled("Evidence hint: annotated attribute of %s: %s.", "object", "attribute").alias("hint_chosen"),
        filled("Evidence hint: mismatched attribute for %s: %s.", "object", "negative").alias("hint_rejected"),
    )


def relation_pairs(candidates: DataFrame) -> DataFrame:
    """Each of ``relation_candidates`` against the opposite relation."""
    rows = candidates.withColumn("negative", flipped(F.col("relation")))
    sideways = F.col("relation").isin("left", "right")
    phrase = lambda r: F.when(sideways, filled("to the %s of the %s", r, "object")).otherwise(filled("%s the %s", r, "object"))
    asked = F.when(sideways, filled("to the %s of", "relation")).otherwise(F.col("relation"))
    return rows.select(
        "image_id", "subject_id", "object_id", "subject", "relation", "object", "negative", filled("What is %s the %s?", asked, "object").alias("question"),
        filled("The %s is %s.", "subject", phrase("relation")).alias("chosen"), filled("The %s is %s.", "subject", phrase("negative")).alias("rejected"),
        filled("Evidence hint: annotated relation: %s %s %s.", "subject", "relation", "object").alias("hint_chosen"),
        filled("Evidence hint: contradicted relation: %s %s %s.", "subject", "negative", "object").alias("hint_rejected"),
    )


def wrong_evidence(records: DataFrame, pool: str, label: str, row: str, seed: str = "wrong") -> DataFrame:
    """Rows (pool, label, row) with ``wrong_label``: another label of the same pool, the next one in stable order.

    Labels of a pool are put in the order of their stable key, and each takes the next one, the last the first. So a row
    meets one label, however large its pool; pools of one label give no rows. A pool's labels are ordered within 4096 ranges
    of keys, and the last of a range takes the first of the next range that has any.
    """
    labels = records.select(pool, label).distinct().withColumn("_k", stable_key(seed, F.col(pool), F.col(label))).withColumn("_bin", F.substring("_k", 1, 3))
    firsts = labels.groupBy(pool, "_bin").agg(F.min_by(label, F.struct("_k", label)).alias("_first"))
    bins = Window.partitionBy(pool).orderBy("_bin")
    after = F.coalesce(F.lead("_first").over(bins), F.first("_first").over(bins.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = firsts.select(F.col(pool).alias("_pool"), F.col("_bin").alias("_of"), after.alias("_after"))
    labels = labels.withColumn("_next", F.lead(label).over(Window.partitionBy(pool, "_bin").orderBy("_k", label)))
    labels = labels.join(firsts, (F.col(pool) == F.col("_pool")) & (F.col("_bin") == F.col("_of")))
    labels = labels.select(pool, label, F.coalesce("_next", "_after").alias("wrong_label")).where(F.col("wrong_label") != F.col(label))
    out = records.join(labels, [pool, label])
    return out.withColumn("negative_type", F.lit("evidence_wrong")).withColumn("source_record_id", F.col(row))


def without_ids(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows none of whose ``columns`` is in the single-column ``ids``."""
    ids = ids.toDF("_held").distinct()
    for c in columns:
        df = df.join(ids, F.col(c) == F.col("_held"), "left_anti")
    return df


def only_ids(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows one of whose ``columns`` is in ``ids``; each row once."""
    ids = ids.toDF("_held").distinct()
    first, *rest = columns
    out = df.join(ids, F.col(first) == F.col("_held"), "left_semi")
    left = df.join(ids, F.col(first).eqNullSafe(F.col("_held")), "left_anti")
    for c in rest:
        out = out.unionByName(left.join(ids, F.col(c) == F.col("_held"), "left_semi"))
        left = left.join(ids, F.col(c).eqNullSafe(F.col("_held")), "left_anti")
    return out
