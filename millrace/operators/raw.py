"""Raw annotation rows of differing layouts as tables and scene graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import once
from ..functions.text import clean_name, stem

#: An object of a raw graph with every name its fields go by.
NODE = (
    "struct<name:string,label:string,category:string,x:double,y:double,w:double,h:double,width:double,height:double,attributes:array<string>,"
    "relations:array<struct<name:string,relation:string,predicate:string,object:string,object_id:string,target:string,target_id:string>>>"
)
DETECTION = "array<struct<label:string,name:string,attributes:array<string>,attrs:array<string>>>"
OBJECTS = "map<string,struct<name:string,x:double,y:double,w:double,h:double,attributes:array<string>,relations:array<struct<name:string,object:string>>>>"
# Where a raw row keeps its graph, and its detections.
GRAPH_KEYS = ["sceneGraph", "scene_graph", "scenegraph"]
DETECTION_KEYS = ["ground_truth", "detections", "det"]


def _first(*values: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def int_like_id(value: Column) -> Column:
    """The last twelve digits of a text as a number, 0 without digits."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9]", "")
    return F.coalesce(F.right(digits, F.lit(12)).try_cast("long"), F.lit(0))


def safe_name(value: Column) -> Column:
    """A text as a file name: letters, digits, ``_`` and ``-``, all else an underscore; "image" if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.trim(value.cast("string")), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("image"))


def raw_box(values: Column) -> Column:
    """x, y, w, h of an array as a struct; null with fewer than four numbers or without area."""
    n = [F.try_element_at(values, F.lit(i)).try_cast("double") for i in range(1, 5)]
    box = F.struct(*[v.alias(k) for v, k in zip(n, "xywh", strict=True)])
    return F.when(n[0].isNotNull() & n[1].isNotNull() & (n[2] > 0) & (n[3] > 0), box)


def _names(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_name), lambda a: a != "")


def normalized_objects(objects: Column) -> Column:
    """A raw map of NODE as OBJECTS: objects without a name go; a graph without objects is null."""
    links = lambda r: F.struct(clean_name(_first(r["name"], r["relation"], r["predicate"])).alias("name"), _first(r["object"], r["object_id"], r["target"], r["target_id"]).alias("object"))

    def node(k: Column, o: Column) -> Column:
        told = F.filter(F.transform(F.coalesce(o["relations"], F.expr("array()")), links), lambda r: (r["name"] != "") & r["object"].isNotNull())
        size = lambda a, b: F.coalesce(o[a], o[b], F.lit(0.0)).alias(a)
        at = [F.coalesce(o[c], F.lit(0.0)).alias(c) for c in "xy"]
        return F.struct(clean_name(_first(o["name"], o["label"], o["category"])).alias("name"), *at, size("w", "width"), size("h", "height"), _names(o["attributes"]).alias("attributes"), told.alias("relations"))

    named = F.map_filter(F.transform_values(objects, node), lambda k, o: F.coalesce(o["name"], F.lit("")) != "")
    return F.when(F.size(named) > 0, named).cast(OBJECTS)


def detected_objects(detections: Column) -> Column:
    """A list of DETECTION as OBJECTS, numbered from 1, without boxes and relations."""
    entry = lambda d, i: F.struct(
        (i + 1).cast("string").alias("k"),
        F.struct(clean_name(_first(d["label"], d["name"])).alias("name"), *[F.lit(None).cast("double").alias(c) for c in "xywh"], _names(F.coalesce(d["attributes"], d["attrs"])).alias("attributes"), F.expr("array()").cast("array<struct<name:string,object:string>>").alias("relations")).alias("v"),
    )
    entries = F.filter(F.transform(F.coalesce(detections, F.array().cast(DETECTION)), entry), lambda e: F.coalesce(e["v"]["name"], F.lit("")) != "")
    return F.when(F.size(entries) > 0, F.map_from_entries(entries)).cast(OBJECTS)


def scene_graphs(raw: DataFrame) -> DataFrame:
    """(image_id, width, height, objects) of raw rows whose graph is in one of several columns, else in a list of detections.

    Columns: image_id, width and height if there are any, ``sceneGraph`` and the like (struct with ``objects``), ``objects``
    (map of NODE), ``detections`` and the like (DETECTION). Rows without a named object have null objects: count them.
    """
    found = [normalized_objects(F.col(f"{k}.objects")) for k in GRAPH_KEYS if k in raw.columns]
    found += [normalized_objects(F.col("objects"))] if "objects" in raw.columns else []
    found += [detected_objects(F.col(k)) for k in DETECTION_KEYS if k in raw.columns]
    size = [(F.col(c) if c in raw.columns else F.lit(None)).cast("double").alias(c) for c in ("width", "height")]
    return raw.select("image_id", *size, F.coalesce(*found, F.lit(None).cast(OBJECTS)).alias("objects"))


def detection_rows(raw: DataFrame, names: Column) -> tuple[DataFrame, DataFrame]:
    """Boxes (image_id, name, x, y, w, h) of rows with parallel lists ``bbox`` and ``category``, and counts of skipped rows by reason.

    A category is a name, or a number that ``names`` (a literal map) resolves; unknown numbers become "category n".
    """
    reason = F.when(F.col("image_id").isNull(), "missing_image").when(F.coalesce(F.size("bbox"), F.lit(0)) <= 0, "missing_boxes").when(F.size("bbox") != F.size("category"), "uneven_lists")
    rows = raw.withColumn("reason", reason)
    named = lambda c: F.when(c.rlike("^[0-9]+$"), F.coalesce(F.try_element_at(names, c), F.concat(F.lit("category "), c))).otherwise(clean_name(c))
    pairs = F.transform(F.arrays_zip("bbox", "category"), lambda p: F.struct(named(p["category"]).alias("name"), raw_box(p["bbox"]).alias("b")))
    kept = rows.where("reason is null").select("image_id", F.explode(pairs).alias("p")).where("p.b is not null and p.name <> ''")
    return kept.select("image_id", "p.name", "p.b.*"), rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


# Keys under which an image is looked for first, where ids stand, and where annotations do.
IMAGE_FIRST = ["image", "img", "input_image", "filepath", "file_path", "path"]
ID_FIRST = ["image_id", "imageId", "id", "sample_id", "filepath", "file_path", "coco_url", "url"]
ANNOTATIONS_FIRST = ["objects", "annotations", "annotation", "target", "labels", "instances", "segmentations"]
BOX_KEYS, LABEL_KEYS = ["bbox", "bboxes"], ["category", "categories", "category_id", "category_ids", "labels", "label"]


def _is_object(v: Column) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))


def _has(v: Column, *keys: str) -> Column:
    held = F.lit(False)
    for k in keys:
        held = held | F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return held


def _first_true(v: Column, *keys: str) -> Column:
    """The first field that is neither missing nor null, false, zero or empty."""
    out = []
    for k in keys:
        one = F.try_variant_get(v, f"$.{k}", "variant")
        said = F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.to_json(one), F.lit(""))
        out.append(F.when(~said.isin("", "[]", "{}", "false", "0", "0.0", "null"), one))
    return F.coalesce(*out)


def found_images(rows: DataFrame, key: str, value: str, store) -> DataFrame:
    """(key, image): the image of each row of nested JSON (a VARIANT column), an object with ``bytes`` or ``path`` at any depth.

    In an object its preferred fields come first, then what is found within its fields, by their names; the first image so
    found counts. Objects are walked level by level, and only those without an image of their own are walked further;
    lists are not.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, IMAGE_FIRST)), F.col("field")), F.lit(0)), F.lit(99)).cast("int")
    level = store(rows.select(F.col(key).alias("_key"), F.col(value).alias("v"), F.array().cast("array<struct<r:int,field:string>>").alias("at")).where(_is_object(F.col("v"))), "level0")
    found, depth = level.where(_has(F.col("v"), "bytes", "path")), 0
    while True:
        inner = level.where(~_has(F.col("v"), "bytes", "path")).select("_key", "at", F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")).alias("e"))
        inner = inner.select("_key", "at", F.explode("e").alias("e")).select("_key", "at", F.col("e.key").alias("field"), F.col("e.value").alias("v")).where(_is_object(F.col("v")))
        here = _has(F.col("v"), "bytes", "path")
        step = F.struct(F.when(here, rank).otherwise(F.lit(99)).alias("r"), "field")
        depth += 1
        level = store(inner.select("_key", "v", F.concat("at", F.array(step)).alias("at")), f"level{depth}")
        if level.isEmpty():
            break
        found = found.unionByName(level.where(_has(F.col("v"), "bytes", "path")))
    best = found.groupBy("_key").agg(F.min_by(F.to_json("v"), "at").alias("image"))
    return best.select(F.col("_key").alias(key), F.try_parse_json("image").alias("image"))


def raw_detections(rows: DataFrame, key: str, value: str, names: Column, store) -> tuple[DataFrame, DataFrame]:
    """Boxes (key, file_name, name, x, y, w, h, area, iscrowd) of nested JSON rows, and (reason, n) of the rows that give none.

    Annotations are a field of the row that holds boxes and categories, the usual names first; categories are names, or
    numbers that ``names`` (a literal map) resolves, else "category n". Boxes and categories are paired in order.
    """
    v = F.col(value)
    ids = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ID_FIRST])
    fields = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    walked = found_images(rows, key, value, store).select(F.col(key).alias("_found"))
    rows = once(rows.select(key, value), _id=ids, _fields=fields)
    image_id = F.coalesce(F.nullif(stem(F.col("_id")), F.lit("")), F.col("_id"), F.col(key).cast("string"))
    sound = lambda e: _is_object(e["value"]) & _has(e["value"], *BOX_KEYS) & _has(e["value"], *LABEL_KEYS)
    place = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ANNOTATIONS_FIRST)), e["key"]), F.lit(0)), F.lit(99))
    best = F.array_min(F.transform(F.filter(F.map_entries("_fields"), sound), lambda e: F.struct(place(e).alias("p"), e["key"].alias("k"))))
    rows = once(rows.select(key, "_id", "_fields"), _id=image_id, _best=best["k"])
    file_name = F.when(F.col("_id").rlike("^[0-9]+$"), F.format_string("%012d.jpg", int_like_id(F.col("_id")))).otherwise(F.concat(safe_name(F.col("_id")), F.lit(".jpg")))
    rows = once(rows, file_name=file_name, ann=F.try_parse_json(F.to_json(F.try_element_at("_fields", F.col("_best"))))).select(key, "file_name", "ann")
    a, none = F.col("ann"), F.array().cast("array<variant>")
    listed = lambda *keys: F.coalesce(F.try_variant_get(_first_true(a, *keys), "$", "array<variant>"), none)
    rows = once(rows, _said=F.try_variant_get(a, "$.categories", "array<variant>"), _bbox=listed(*BOX_KEYS), _area=listed("area", "areas"), _crowd=listed("iscrowd", "is_crowd"))
    texts = F.forall(F.coalesce("_said", none), lambda x: F.schema_of_variant(x) == "STRING") & (F.coalesce(F.size("_said"), F.lit(0)) > 0)
    rows = once(rows, _texts=texts)
    numbers = F.coalesce(F.try_variant_get(_first_true(a, "category_id", "category_ids", "category", "labels", "label"), "$", "array<variant>"), F.col("_said"), none)
    # A category is its text, cleaned, and its number, if it is one.
    told = F.transform(F.transform(F.when(F.col("_texts"), F.col("_said")).otherwise(numbers), lambda x: F.try_variant_get(x, "$", "string")), lambda x: F.struct(clean_name(x).alias("text"), x.try_cast("int").alias("number")))
    rows = once(rows, _told=told, _none=a.isNull()).drop("_said", "ann")
    resolved = F.when(F.col("_texts"), F.transform("_told", lambda x: x["text"])).otherwise(
        F.transform(F.filter("_told", lambda x: x["number"].isNotNull() | (x["text"] != "")), lambda x: F.when(x["number"].isNotNull(), F.coalesce(F.try_element_at(names, x["number"].cast("string")), F.concat(F.lit("category "), x["number"].cast("string")))).otherwise(x["text"]))
    )
    zipped = F.arrays_zip(F.col("_bbox").alias("bbox"), resolved.alias("name"), F.col("_area").alias("area"), F.col("_crowd").alias("crowd"))
    at = lambda p, i: F.try_variant_get(p["bbox"], f"$[{i}]", "double")
    crowd = lambda p: F.coalesce(F.try_variant_get(p["crowd"], "$", "boolean").cast("int"), F.lit(0))
    rows = once(rows, _made=F.transform(zipped, lambda p: F.struct(p["name"].alias("name"), *[at(p, i).alias(k) for i, k in enumerate("xywh")], F.try_variant_get(p["area"], "$", "double").alias("area"), crowd(p).alias("iscrowd"))))
    good = F.filter("_made", lambda b: (F.coalesce(b["name"], F.lit("")) != "") & b["x"].isNotNull() & b["y"].isNotNull() & (b["w"] > 0) & (b["h"] > 0))
    boxes = F.transform(good, lambda b: F.struct(b["name"].alias("name"), *[b[k].alias(k) for k in "xywh"], F.coalesce(b["area"], b["w"] * b["h"]).alias("area"), b["iscrowd"].alias("iscrowd")))
    rows = once(rows, boxes=boxes).select(key, "file_name", "boxes", "_none")
    rows = rows.join(walked, F.col(key) == F.col("_found"), "left")  # only what is kept is shuffled
    reason = F.when(F.col("_found").isNull(), "missing_image").when(F.col("_none"), "missing_annotations").when(F.size("boxes") == 0, "empty_annotations")
    rows = store(rows.select(key, "file_name", "boxes", reason.alias("reason")), "rows")
    kept = rows.where("reason is null").select(key, "file_name", F.explode("boxes").alias("b")).select(key, "file_name", "b.*")
    return kept, rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
