"""Readers and writers of the file formats that curation uses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, MapType, StructType

from .documents import malformed_lines

#: Keys that can hold an image id.
ID_KEYS = ["image_id", "imageId", "image", "img_id", "imageIdStr"]


def read_jsonl(spark: SparkSession, path, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped.

    With ``strict`` the lines are looked at first, and the first malformed one is an error that names its file and line;
    else malformed lines are kept in _corrupt_record with their file.
    """
    if strict:
        for bad in malformed_lines(spark, path).orderBy("path", "line").limit(1).collect():
            raise ValueError(f"{bad.path}:{bad.line}: invalid JSONL record")
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType(kept.fields).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def read_json(spark: SparkSession, path, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_ids(spark: SparkSession, path) -> DataFrame:
    """Stripped, non-empty lines as the column ``id``."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_id_set(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ids of text, CSV, JSON and JSONL files; every id key that a record has counts."""
    out = None
    for path in paths:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind in ("json", "jsonl", "csv"):
            df = read_csv(spark, path) if kind == "csv" else spark.read.option("multiLine", kind == "json").json(path)
            if "image_ids" in df.columns:
                ids = df.select(F.explode(F.col("image_ids").cast("array<string>")).alias("id"))
            else:
                keys = [F.col(k).cast("string") for k in ID_KEYS if k in df.columns]
                ids = df.select(F.explode(F.array_compact(F.array(*keys))).alias("id")) if keys else df.select(F.lit("").alias("id")).limit(0)
        else:
            ids = read_ids(spark, path)
        out = ids if out is None else out.unionByName(ids)
    return out.where("id <> ''").distinct()


def _sorted(value: Column, kind: DataType) -> Column:
    """A value with the fields of all its structs in the order of their names."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value"))))) if isinstance(kind.valueType, AtomicType) else value
    return value


def write_jsonl(df: DataFrame, path: str) -> int:
    """One object a line, keys sorted, without null fields; files appear whole or not at all. Returns the number of lines."""
    seen = Observation()
    rows = df.select(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("ignoreNullFields", True).json(path)
    return seen.get["n"]


def write_json(spark: SparkSession, payload, path: str) -> None:
    """A small report as one indented document, keys in the order given."""
    lines = spark.createDataFrame([(json.dumps(payload, indent=2, ensure_ascii=False),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """The distinct ids of a column, one a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value <> ''").distinct().write.mode("overwrite").text(path)


def publish(df: DataFrame, path: str, default: str | None = None) -> int:
    """Write JSONL to ``path`` and, from there, the same rows to the default place."""
    n = write_jsonl(df, path)
    if default:
        write_jsonl(df.sparkSession.read.schema(df.schema).json(path), default)
    return n


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_guarded(df: DataFrame, path: str, leaked: DataFrame) -> None:
    """Write unless ``leaked`` has a row."""
    if not leaked.isEmpty():
        raise ValueError(f"not written: {leaked.count()} keys are in both the training and the evaluation set")
    write_jsonl(df, path)


def markdown_table(df: DataFrame, rows: int = 200) -> str:
    """A report table as Markdown; a table of more than ``rows`` rows is an error. Cells are one line, bars escaped."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    cell = lambda v: "" if v is None else " ".join(str(v).split()).replace("|", "\\|")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in got)])


def read_records(spark: SparkSession, path: str, wrappers=("questions", "annotations", "data", "records")) -> DataFrame:
    """Records of a JSONL, JSON or CSV file. A .json file may be one document, a list, a list under a wrapper key, or lines."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "jsonl":
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    if df.columns == ["_corrupt_record"]:
        return spark.read.json(path)
    for key in wrappers:
        if key in df.columns and df.schema[key].dataType.typeName() == "array":
            return df.select(F.explode(key).alias("r")).select("r.*")
    lines = spark.read.json(path)
    return lines if "_corrupt_record" not in lines.columns else df


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL table, empty with the same schema where the path doesn't exist."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, bytes) of all files below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


#: Suffixes that an image without one may have, the preferred one first.
SUFFIXES = [".jpg", ".jpeg", ".png"]


def listed_files(spark: SparkSession, folders: list[str], store) -> DataFrame:
    """(path, name, bytes) of all files below ``folders``: tasks list the folders of one level, then those found in them."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches):
        for batch in batches:
            out = []
            for folder in batch["path"].to_pylist():
                fs, inner = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                root = folder.removesuffix(inner) or "file://"
                for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
                    out.append({"path": f"{root}{f.path}", "name": f.base_name, "bytes": f.size if f.is_file else None, "folder": f.type == pafs.FileType.Directory})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("folder", pa.bool_())]))

    level, found, depth = spark.createDataFrame([(f,) for f in folders], "path string"), None, 0
    while not level.isEmpty():
        seen = store(level.repartition("path").mapInArrow(run, "path string, name string, bytes long, folder boolean"), f"listed{depth}")
        here, level, depth = seen.where("not folder").select("path", "name", "bytes"), seen.where("folder").select("path"), depth + 1
        found = here if found is None else found.unionByName(here)
    return found


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def touch(names: DataFrame, folder: str) -> int:
    """Empty files of the (relative) ``name``s below ``folder``, made by tasks; returns how many."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for name in batch["name"].to_pylist():
                path = f"{root}/{name}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                fs.open_output_stream(path).close()
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    return names.select("name").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def image_stem(name: Column) -> Column:
    """A file name without one of SUFFIXES."""
    return F.regexp_replace(name, r"\.(jpg|jpeg|png)$", "")


def with_image(df: DataFrame, column: str, manifest: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Add ``image_path``: the file of the manifest that ``column`` names, with the first of ``suffixes`` there is, else null."""
    suffixes = SUFFIXES if suffixes is None else suffixes
    place = F.array_position(F.array(*map(F.lit, suffixes)), F.regexp_extract("name", r"(\.[^.]+)$", 1))
    held = manifest.where(place > 0).groupBy(image_stem(F.col("name")).alias("_stem")).agg(F.min_by("path", F.struct(place.alias("p"), "path")).alias("image_path"))
    return df.join(held, F.col(column) == F.col("_stem"), "left").drop("_stem")


def completeness(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """(state, name) of expected images (``stem``) and files: found, missing (named with the first suffix) or unexpected."""
    files = manifest.select("name", image_stem(F.col("name")).alias("_stem")).distinct()
    both = expected.select("stem").distinct().join(files, F.col("stem") == F.col("_stem"), "full")
    state = F.when(F.col("_stem").isNull(), "missing").when(F.col("stem").isNull(), "unexpected").otherwise("found")
    return both.select(state.alias("state"), F.coalesce("name", F.concat("stem", F.lit(SUFFIXES[0]))).alias("name"))


def with_existing_file(df: DataFrame, name: str, manifest: DataFrame) -> DataFrame:
    """Add ``file_exists``: whether the manifest has a file of the name in column ``name``."""
    seen = manifest.select(F.col("name").alias("_name")).distinct()
    return df.join(seen, F.col(name) == F.col("_name"), "left").withColumn("file_exists", F.col("_name").isNotNull()).drop("_name")


def last_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``: how a list becomes a table by id."""
    best = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*")
