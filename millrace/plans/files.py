"""Queries over files: tables are written as documents and lines below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curate, export, raw
from ..sources import documents, files
from ..streaming import scoring
from .registry import _COUNTS, _PARSED, _RATES, _generations, _turns, _TURNS, query, read
from .scenes import _graphs
from .store import shared_path, table_store


_DOCUMENT = """d AS (SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS annotation_id, l_partkey AS category_id, l_quantity::DOUBLE AS x, (l_linenumber * 3)::DOUBLE AS y, (l_quantity - 5)::DOUBLE AS w, (l_linenumber + 1)::DOUBLE AS h,
  CASE l_linenumber % 5 WHEN 0 THEN 1 ELSE 0 END AS iscrowd FROM lineitem)"""


def _document(spark, sf_dir) -> str:
    """A detection document of all lines, written by many tasks."""
    c, n = F.col, F.col("l_linenumber")
    boxes = read(spark, sf_dir, "lineitem").select(
        n.alias("id"), c("l_orderkey").alias("image_id"), c("l_partkey").alias("category_id"), F.array(c("l_quantity").cast("double"), (n * 3).cast("double"), (c("l_quantity") - 5).cast("double"), (n + 1).cast("double")).alias("bbox"),
        F.when(n % 5 == 0, 1).otherwise(0).alias("iscrowd"),
    )
    images = read(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.concat(c("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(64).alias("width"), F.lit(32).alias("height"))
    names = read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    path = shared_path(spark, "boxes") + ".json"
    documents.write_document({"images": images, "annotations": boxes, "categories": names}, path)
    return path


@query(f"WITH {_DOCUMENT} SELECT * FROM d")
def document_boxes(spark, sf_dir):
    """The boxes of a detection document, read back in byte ranges."""
    return documents.detection_tables(spark, _document(spark, sf_dir), 1 << 20)[1].drop("area")


@query(
    f"""WITH {_DOCUMENT} SELECT image_id, regexp_replace(lower(p_name), '[^a-z0-9 /]+', '', 'g') AS name, max(greatest(w, 0) * h) AS max_area FROM d JOIN part ON category_id = p_partkey JOIN orders ON image_id = o_orderkey
WHERE iscrowd = 0 AND greatest(w, 0) * h >= 20.48 GROUP BY ALL"""
)
def document_objects(spark, sf_dir):
    """Classes that the images of a detection document show: all three of its arrays joined."""
    return curate.visible_objects(*documents.detection_tables(spark, _document(spark, sf_dir), 1 << 20))


@query("SELECT p_partkey, p_name || chr(10) || '\"x\", ' || p_brand AS text, p_retailprice AS price FROM part")
def csv_table(spark, sf_dir):
    """A table with quotes, commas and line feeds in its texts, written as CSV and read back."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('\n"x", '), "p_brand").alias("text"), F.col("p_retailprice").alias("price"))
    path = shared_path(spark, "csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders")
def id_files(spark, sf_dir):
    """Ids of a text file and of records, together and each once."""
    text, lines = shared_path(spark, "ids"), shared_path(spark, "rows") + ".jsonl"
    files.write_ids(read(spark, sf_dir, "customer"), "c_custkey", text)
    files.write_jsonl(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_orderstatus"), lines)
    return files.read_id_set(spark, [text, lines])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS image_id, count(DISTINCT l_linenumber) AS n_objects FROM lineitem GROUP BY l_orderkey")
def document_graphs(spark, sf_dir):
    """Scene graphs as one document with a field for each image, written and read back."""
    graphs = _graphs(spark, sf_dir)
    field = F.concat(F.lit('"'), F.col("image_id").cast("string"), F.lit('": '), F.to_json(F.struct("width", "height", "objects")))
    path = shared_path(spark, "graphs") + ".json"
    documents.write_framed([("{\n", graphs.select(field.alias("value")))], "}\n", path)
    got = documents.read_map(spark, path, "struct<width:double,height:double,objects:map<string,struct<name:string>>>", 1 << 20)
    return got.select(F.col("key").alias("image_id"), F.size("value.objects").cast("long").alias("n_objects"))


@query(f"WITH {_TURNS} SELECT id, '<image>' || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt, 'human' AS speaker, chosen, 'No.' AS rejected, image, '{{\"ranking\": true, \"formatting\": \"sharegpt\"}}' AS registered FROM r")
def trainer_document(spark, sf_dir):
    """Chat records as the trainer's document with its registry, read back; what the registry says stands beside them."""
    folder = shared_path(spark, "trainer")
    records = export.chat_rows(export.answer_rows(_turns(spark, sf_dir)))
    files.make_folder(spark, folder)
    documents.write_trainer_data({"answers": records}, folder)
    info = spark.read.text(f"{folder}/dataset_info.json", wholetext=True).select(F.parse_json("value").alias("i"))
    said = F.concat(F.lit('{"ranking": '), F.expr("variant_get(i, '$.answers.ranking', 'string')"), F.lit(', "formatting": "'), F.expr("variant_get(i, '$.answers.formatting', 'string')"), F.lit('"}'))
    name = info.select(F.expr("variant_get(i, '$.answers.file_name', 'string')").alias("n")).first().n  # one row
    turn = "struct<from:string,value:string>"
    got = documents.read_arrays(spark, f"{folder}/{name}", {"": f"id string, conversations array<{turn}>, chosen {turn}, rejected {turn}, images array<string>"}, 1 << 20)[""]
    rows = got.select("id", F.col("conversations")[0]["value"].alias("prompt"), F.col("conversations")[0]["from"].alias("speaker"), F.col("chosen.value").alias("chosen"), F.col("rejected.value").alias("rejected"), F.col("images")[0].alias("image"))
    return rows.crossJoin(F.broadcast(info.select(said.alias("registered"))))  # one row of a registry


@query(
    """WITH e AS (SELECT event_id, event_id % 8 AS bucket, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS line FROM events)
SELECT bucket, line, CASE event_id % 3 WHEN 0 THEN '{"id":' WHEN 1 THEN '{"id":1} {"id":2}' ELSE '{"id":1},' END AS value FROM e WHERE event_id % 97 = 0"""
)
def malformed_lines(spark, sf_dir):
    """Lines of eight files of which some are blank and some malformed, named by file and line."""
    k = F.col("event_id")
    line = F.when(k % 97 == 0, F.when(k % 3 == 0, '{"id":').when(k % 3 == 1, '{"id":1} {"id":2}').otherwise('{"id":1},')).when(k % 89 == 0, "").otherwise(F.to_json(F.struct(k.alias("id"), "event_type")))
    rows = read(spark, sf_dir, "events").select(k, (k % 8).alias("bucket"), line.alias("value"))
    path = shared_path(spark, "lines")
    rows.repartition("bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    got = documents.numbered_malformed(spark.read.text(path))
    return got.select(F.regexp_extract("path", "bucket=([0-9]+)/", 1).cast("long").alias("bucket"), "line", "value")


@query(
    """SELECT 'missing' AS state, 'n' || n_nationkey || '.jpg' AS name FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'unexpected', 'r' || r_regionkey || '.png' FROM region
UNION ALL SELECT 'found', 'n' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' ELSE '.png' END FROM nation WHERE n_nationkey % 4 <> 0"""
)
def completeness(spark, sf_dir):
    """Expected images against the files there are, which tasks list folder by folder: what is missing, unexpected and found."""
    n = F.col("n_nationkey")
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("stem"), n)
    folder = shared_path(spark, "images")
    suffix = F.when(n % 3 == 0, ".jpg").when(n % 3 == 1, ".jpeg").otherwise(".png")
    made = nations.where("n_nationkey % 4 <> 0").select(F.concat(F.lit("a/b"), (n % 3).cast("string"), F.lit("/"), "stem", suffix).alias("name"))
    made = made.unionByName(read(spark, sf_dir, "region").select(F.concat(F.lit("c/r"), F.col("r_regionkey").cast("string"), F.lit(".png")).alias("name")))
    files.touch(made, folder)
    found = files.listed_files(spark, [folder], table_store(spark))
    return files.completeness(nations.select("stem"), found).select("state", "name")


def _raw_rows(spark, sf_dir) -> DataFrame:
    """Customers as raw rows of four layouts, images at different depths, some rows without image or annotations."""
    k = F.col("c_custkey")
    box = F.concat(F.lit("["), k.cast("string"), F.lit(",1,"), (k % 3).cast("string"), F.lit(",2]"))
    flat = F.concat(F.lit('{"image":{"path":"p"},"image_id":"x/COCO_'), k.cast("string"), F.lit('.jpg","objects":{"bbox":['), box, F.lit(',[0,0,1,1]],"category":[18,"Big-Cat"]}}'))
    deep = F.concat(F.lit('{"meta":{"z":1,"y":{"img":{"bytes":"b"}}},"id":'), k.cast("string"), F.lit(',"annotations":{"bboxes":['), box, F.lit('],"categories":["Traffic_Light"],"area":[7.5],"iscrowd":[true]}}'))
    other = F.concat(F.lit('{"path":"q","labels":[1],"seen":{"bbox":['), box, F.lit('],"label":[77]}}'))
    bare = F.when(k % 2 == 0, F.lit('{"objects":{"bbox":[[1,1,1,1]],"label":[18]}}')).otherwise('{"a":{"b":{"c":{"path":null}}}}')
    tasks = spark.sparkContext.defaultParallelism * 4  # rows of few bytes and much work: a file is one task otherwise
    return read(spark, sf_dir, "customer").select(k).repartition(tasks, "c_custkey").select(k, F.parse_json(F.when(k % 4 == 0, flat).when(k % 4 == 1, deep).when(k % 4 == 2, other).otherwise(bare)).alias("v"))


@query(
    """WITH c AS (SELECT c_custkey AS k FROM customer), b AS (
SELECT k AS c_custkey, 'COCO_' || k || '.jpg' AS file_name, 'dog' AS name, k::DOUBLE AS x, 1.0::DOUBLE AS y, (k % 3)::DOUBLE AS w, 2.0::DOUBLE AS h, (k % 3 * 2)::DOUBLE AS area, 0 AS iscrowd FROM c WHERE k % 4 = 0 AND k % 3 <> 0
UNION ALL SELECT k, 'COCO_' || k || '.jpg', 'big cat', 0, 0, 1, 1, 1, 0 FROM c WHERE k % 4 = 0
UNION ALL SELECT k, lpad(CAST(k AS VARCHAR), 12, '0') || '.jpg', 'traffic light', k, 1, k % 3, 2, 7.5, 1 FROM c WHERE k % 4 = 1 AND k % 3 <> 0
UNION ALL SELECT k, lpad(CAST(k AS VARCHAR), 12, '0') || '.jpg', 'category 77', k, 1, k % 3, 2, k % 3 * 2, 0 FROM c WHERE k % 4 = 2 AND k % 3 <> 0)
SELECT *, CAST(NULL AS VARCHAR) AS reason, 1::BIGINT AS n FROM b UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason, count(*) FROM (SELECT CASE WHEN k % 4 = 3 THEN CASE k % 2 WHEN 0 THEN 'missing_image' ELSE 'missing_annotations' END ELSE 'empty_annotations' END AS reason FROM c WHERE k % 4 = 3 OR (k % 4 IN (1, 2) AND k % 3 = 0)) GROUP BY reason"""
)
def raw_layouts(spark, sf_dir):
    """Boxes of raw rows of four layouts as one table, and why rows give none."""
    kept, skipped = raw.raw_detections(_raw_rows(spark, sf_dir), "c_custkey", "v", F.create_map(F.lit("18"), F.lit("dog")), table_store(spark))
    empty = {c: F.lit(None).cast(t) for c, t in kept.dtypes}
    return kept.withColumns({"reason": F.lit(None).cast("string"), "n": F.lit(1).cast("long")}).unionByName(skipped.withColumns(empty))


@query(f"WITH {_PARSED}, c AS (SELECT {_COUNTS} FROM s), {_RATES} SELECT * FROM r2")
def streamed_scores(spark, sf_dir):
    """Answers that arrive as a stream, some of them twice, scored batch by batch: the same as all at once."""
    rows = _generations(spark, sf_dir).select("doc_id", "target", "generation", F.timestamp_seconds(F.col("doc_id") * 60 + 1_700_000_000).alias("at"))
    folder = shared_path(spark, "answers")
    rows.unionByName(rows.where("doc_id % 3 = 0")).repartition(6).write.parquet(folder)  # late copies are in other files
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return scoring.scored_stream(stream, "doc_id", "at", shared_path(spark, "scores"))
