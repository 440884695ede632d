"""Folders listed by tasks, images by suffix, streams with late copies, raw rows of unknown depth."""

from pyspark.sql import functions as F

from millrace.operators import metrics, raw
from millrace.plans.store import table_store
from millrace.sources import files
from millrace.streaming import scoring


def test_folders_are_listed_level_by_level(spark, tmp_path):
    for name in ("a/b/c.jpg", "a/d.png", "e.jpeg", "a/b/d.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    got = files.listed_files(spark, [str(tmp_path), str(tmp_path / "none")], table_store(spark))
    assert sorted((r.path.removeprefix(f"file://{tmp_path}/"), r.name, r.bytes) for r in got.collect()) == [("a/b/c.jpg", "c.jpg", 2), ("a/b/d.jpg", "d.jpg", 2), ("a/d.png", "d.png", 2), ("e.jpeg", "e.jpeg", 2)]
    want = spark.createDataFrame([("c",), ("d",), ("z",), (None,)], "i string")
    found = {r.i: (r.image_path or "").rsplit("/", 1)[-1] for r in files.with_image(want, "i", got).collect()}
    assert found == {"c": "c.jpg", "d": "d.jpg", "z": "", None: ""}
    states = files.completeness(want.where("i is not null").select(F.col("i").alias("stem")), got).collect()
    assert sorted((r.state, r.name) for r in states) == [("found", "c.jpg"), ("found", "d.jpg"), ("found", "d.png"), ("missing", "z.jpg"), ("unexpected", "e.jpeg")]


def test_streams_count_late_copies_once(spark, tmp_path):
    rows = [(i, "yes" if i % 2 else "no", "Yes." if i % 3 else "No.", i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, target string, generation string, t int").withColumn("at", F.timestamp_seconds(F.col("t") + 1000))
    for part in (df.where("id < 30"), df.where("id < 40"), df):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, want = scoring.scored_stream(stream, "id", "at", str(tmp_path / "out")).first(), metrics.evaluate(metrics.score_rows(df)).first()
    assert got.asDict() == want.asDict()
    assert len(list((tmp_path / "out" / "counts").glob("batch=*"))) >= 3
    again = scoring.scored_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "at", str(tmp_path / "out")).first()
    assert again.asDict() == want.asDict()  # nothing new came


def test_images_at_unknown_depth(spark):
    texts = {
        '{"image":{"path":"a.jpg"},"b":{"path":"no"}}': "a.jpg", '{"m":{"z":{"path":"no"},"img":{"path":"b"}}}': "b", '{"a":{"image":{"path":"c"}},"b":{"path":"no"}}': "c", '{"path":"d"}': "d",
        '{"image":"text","x":{"y":{"w":{"path":"e"}}}}': "e", '{"x":[{"path":"in a list"}]}': None, "[1]": None, "7": None, None: None, '{"path":{"path":"f"},"image":{"no":1}}': {"path": "f"},
    }
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    got = {r.k: r.p for r in raw.found_images(df, "k", "v", table_store(spark)).select("k", F.expr("to_json(variant_get(image, '$.path', 'variant'))").alias("p")).collect()}
    assert [got.get(k) for k in range(len(texts))] == [None if w is None else '{"path":"f"}' if isinstance(w, dict) else f'"{w}"' for w in texts.values()]


def test_raw_rows_and_why_they_give_nothing(spark):
    texts = [
        '{"image":{"path":"a"},"image_id":"x/COCO_7.jpg","objects":{"bbox":[[1,2,3,4],[0,0,0,1],[5,5,5,5],[6,6,6,6]],"category":[1,"Big-Dog","cat"]}}',
        '{"meta":{"img":{"bytes":"x"}},"id":"a b","annotations":{"bboxes":[[1,2,3,4]],"categories":["Traffic_Light"],"area":[9.5],"iscrowd":[1]}}',
        '{"a":{"b":{"path":null}},"extra":{"bbox":[[1,1,1,1]],"label":[500]}}', '{"objects":{"bbox":[[1,1,1,1]],"label":[1]}}', '{"path":"p","objects":{"bbox":[],"label":[]}}', '{"image":{"path":"q"}}', None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    kept, skipped = raw.raw_detections(df, "k", "v", F.create_map(F.lit("1"), F.lit("person")), table_store(spark))
    assert sorted((r.k, r.file_name, r.name, r.x, r.area, r.iscrowd) for r in kept.collect()) == [
        (0, "COCO_7.jpg", "cat", 5.0, 25.0, 0), (0, "COCO_7.jpg", "person", 1.0, 12.0, 0), (1, "a_b.jpg", "traffic light", 1.0, 9.5, 1), (2, "000000000002.jpg", "category 500", 1.0, 1.0, 0),
    ]
    assert {r.reason: r.n for r in skipped.collect()} == {"missing_image": 2, "empty_annotations": 1, "missing_annotations": 1}
