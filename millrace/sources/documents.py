"""Large JSON documents, read and written by many tasks, and line numbers of files that are split.

A document is read in byte ranges. One pass over them finds, for a range that begins inside or outside of a string, how it
changes the nesting, and where the wanted arrays may begin; a row for each range tells then how each range really begins.
In the second pass every task cuts out the elements whose delimiter lies in its range, as text; Spark parses it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.parse import whole_json
from ..functions.steps import once

#: Bytes of a range, of what is read on to find an element's end, and of what is copied at once.
RANGE, STEP = 8 << 20, 1 << 16
_UP, _DOWN = np.zeros(256, np.int8), np.zeros(256, np.int8)
_UP[[0x5B, 0x7B]] = 1
_DOWN[[0x5D, 0x7D]] = 1
# Bytes that nesting and strings depend on, these and commas, and all but white space.
_NESTING, _DELIMITING, _TEXT = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, np.uint8)
_NESTING[[0x22, 0x5B, 0x5D, 0x7B, 0x7D]] = True
_DELIMITING[[0x22, 0x2C, 0x5B, 0x5D, 0x7B, 0x7D]] = True
_TEXT[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(inner)


def _size(path: str) -> int:
    with _open(path) as f:
        return f.size()


def _at(f, start: int, length: int) -> bytes:
    f.seek(start)
    return f.read(length)


def _escaped(f, start: int) -> bool:
    """Whether the byte at ``start`` stands behind an odd number of backslashes."""
    n = 0
    while start - n > 0:
        head = _at(f, max(0, start - n - STEP), min(STEP, start - n))
        kept = len(head) - len(head.rstrip(b"\\"))
        n += kept
        if kept < len(head):
            break
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes that open or close a string."""
    back = data == 0x5C
    if escaped:  # the first byte belongs to an escape that began before
        back = back.copy()
        back[:1] = False
    out = data == 0x22
    if back.any():
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(back, -1, at))  # the last byte that is no backslash
        run = np.zeros(len(data), np.int64)
        run[1:] = (at - last)[:-1] * back[:-1]
        out &= run % 2 == 0
    if escaped:
        out[:1] = False
    return out


def _marks(raw: bytes, escaped: bool, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where bytes of a table are, the bytes, and which of them open or close a string."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(wanted[data])
    byte = data[at]
    return at, byte, _quotes(data, escaped)[at] if escaped or b"\\" in raw else byte == 0x22


def _outside(raw: bytes, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where brackets and commas are outside of strings, the bytes, and the nesting behind each."""
    at, byte, quotes = _marks(raw, escaped, _DELIMITING)
    out = (byte != 0x22) & ((np.cumsum(quotes) + inside) % 2 == 0)
    at, byte = at[out], byte[out]
    return at, byte, depth + np.cumsum(_UP[byte] - _DOWN[byte], dtype=np.int64)


SCAN = "start long, quotes int, d0 long, d1 long, least0 long, least1 long, at array<struct<field:string,open:long,in0:boolean,in1:boolean,l0:long,l1:long>>"


def _scan(path: str, fields: list[str]):
    words = {f: json.dumps(f).encode() for f in fields if f}
    keys = {f: (w, re.compile(re.escape(w) + rb"\s*:\s*\[")) for f, w in words.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                out = []
                for start, end in zip(batch["start"].to_pylist(), batch["end"].to_pylist()):
                    tail = _at(f, start, end - start + STEP)  # a key that begins here may end behind
                    raw = tail[: end - start]
                    at, byte, quotes = _marks(raw, _escaped(f, start), _NESTING)
                    closed, step = np.cumsum(quotes), _UP[byte] - _DOWN[byte]
                    level = [np.cumsum(np.where(closed % 2 == h, step, 0), dtype=np.int64) for h in (0, 1)]
                    seen = []
                    for field, (word, key) in keys.items():
                        k = tail.find(word)
                        while 0 <= k < len(raw):
                            i = int(np.searchsorted(at, k))
                            if quotes[i] and (m := key.match(tail, k)):
                                before = int(closed[i]) - 1
                                seen.append({"field": field, "open": start + m.end(), "in0": bool(before % 2), "in1": bool((before + 1) % 2), "l0": int(level[0][i]), "l1": int(level[1][i])})
                            k = tail.find(word, k + 1)
                    d = [(int(x[-1]), min(0, int(x.min()))) if len(x) else (0, 0) for x in level]
                    out.append({"start": start, "quotes": int(quotes.sum() % 2), "d0": d[0][0], "d1": d[1][0], "least0": d[0][1], "least1": d[1][1], "at": seen})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("start", pa.int64()), ("quotes", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64()), ("least0", pa.int64()), ("least1", pa.int64()), ("at", pa.list_(pa.struct([("field", pa.string()), ("open", pa.int64()), ("in0", pa.bool_()), ("in1", pa.bool_()), ("l0", pa.int64()), ("l1", pa.int64())])))]))

    return run


class Elements(DataSource):
    """Elements of an array within a document, as text: options path, and parts as ``_parts`` plans them."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options["parts"]))


class _Part(InputPartition):
    def __init__(self, ranges: list[list]) -> None:
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: list[list[list]]) -> None:
        self.path, self.parts = path, parts

    def __getstate__(self) -> dict:
        return {"path": self.path, "parts": []}  # a task gets its part, not the list of all

    def partitions(self):
        return [_Part(p) for p in self.parts]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            for r in part.ranges:
                yield from self._elements(f, *r)

    def _elements(self, f, start: int, end: int, within: bool, depth: int, level: int, opened: bool) -> Iterator[pa.RecordBatch]:
        """Elements whose delimiter (the array's bracket, or a comma on its level) lies in [start, end)."""
        schema = pa.schema([("value", pa.string())])
        data, step, own = _at(f, start, end - start + STEP), STEP * 2, end - start
        escaped = not opened and _escaped(f, start)
        while True:
            at, byte, nested = _outside(data, escaped, within, depth)
            comma = at[(byte == 0x2C) & (nested == level)]
            closes = at[(_DOWN[byte] > 0) & (nested == level - 1)]
            ends = comma
            if len(closes):
                comma = comma[comma < closes[0]]
                ends = np.append(comma, closes[0])
            firsts = comma[comma < own]
            if opened:
                firsts = np.append(-1, firsts)
            if not len(firsts) or (len(ends) and ends[-1] > firsts[-1]):
                break
            more = _at(f, start + len(data), step)
            if not more:
                raise ValueError(f"{self.path}: an array isn't closed")
            data, step = data + more, step * 2
        if not len(firsts):
            return
        # Elements lie one behind the other: with white space for what is between them, the bytes are those of a column.
        last = int(ends[np.searchsorted(ends, firsts[-1], "right")])
        text = np.frombuffer(data, np.uint8)[: last + 1].copy()
        text[ends[ends <= last]] = 0x20
        starts = np.maximum(firsts, 0)
        values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, last).astype(np.int32)), pa.py_buffer(text))
        values.validate(full=True)
        filled = np.maximum.reduceat(_TEXT[text], starts) > 0  # an empty array has no element
        if not filled.all():
            values = values.filter(pa.array(filled))
        for k in range(0, len(values), 4096):
            yield pa.RecordBatch.from_arrays([values.slice(k, 4096)], schema=schema)


def _parts(scanned: list, ranges: list[tuple[int, int]], fields: list[str], path: str) -> dict[str, list[list]]:
    """For every field the ranges that hold delimiters of its array, with how they begin: a row for each range is known here."""
    out: dict[str, list[list]] = {f: [] for f in fields}
    state, opened = [], {}
    inside, depth = False, 0
    for row in scanned:
        state.append((inside, depth, depth + (row.least1 if inside else row.least0)))
        for found in row.at or []:
            within, level = (found.in1, found.l1) if inside else (found.in0, found.l0)
            if not within and depth + level == 1:
                opened[found.field] = found.open
        depth += row.d1 if inside else row.d0
        inside ^= bool(row.quotes)
    for field in fields:
        level, start = 2, opened.get(field)
        if not field:  # the document itself
            with _open(path) as f:
                head = _at(f, 0, STEP)
            start, level = len(head) - len(head.lstrip()) + 1, 1
        if start is None:
            continue
        for (a, b), (within, nested, least) in zip(ranges, state):
            if b <= start:
                continue
            if a <= start:
                out[field].append([start, max(b, start), False, level, level, True])
                with _open(path) as f:  # one range of each field
                    if (_outside(_at(f, start, b - start), False, False, level)[2] < level).any():
                        break
            else:
                out[field].append([a, b, within, nested, level, False])
                if least < level:
                    break
    return out


def _scanned(spark: SparkSession, path: str, fields: list[str], range_bytes: int) -> dict[str, list[list]]:
    """What ``_parts`` says of a document, by one pass over it: sorting in Spark would take a second one for its sample."""
    size = _size(path)
    ranges = [(a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]
    table = spark.createDataFrame(ranges or [(0, 0)], "start long, end long").repartition(max(1, min(len(ranges), spark.sparkContext.defaultParallelism * 8)), "start")
    scanned = sorted(table.where("end > start").mapInArrow(_scan(path, fields), SCAN).collect(), key=lambda r: r.start)
    return _parts(scanned, ranges, fields, path)


def _elements(spark: SparkSession, path: str, parts: list[list]) -> DataFrame:
    """Elements as text; a task reads several ranges in turn where there are many."""
    tasks = min(len(parts), spark.sparkContext.defaultParallelism * 16)
    groups = [parts[len(parts) * k // tasks : len(parts) * (k + 1) // tasks] for k in range(tasks)]
    spark.dataSource.register(Elements)
    return spark.read.format("json_elements").option("parts", json.dumps(groups)).load(path)


def read_arrays(spark: SparkSession, path: str, schemas: dict[str, str], range_bytes: int = RANGE) -> dict[str, DataFrame]:
    """The arrays of a JSON document by the names of their fields, each with its schema; "" is the document if it is an array.

    A field that is missing gives an empty table, an element that isn't of its schema null columns. The fields belong to the
    outermost object. Ranges are ``range_bytes`` long, an element may be longer.
    """
    parts, out = _scanned(spark, path, list(schemas), range_bytes), {}
    for field, schema in schemas.items():
        kind = StructType.fromDDL(schema)
        if not parts[field]:
            out[field] = spark.createDataFrame([], kind)
            continue
        out[field] = once(_elements(spark, path, parts[field]), v=F.from_json("value", kind)).select("v.*")
    return out


#: Arrays of a detection document.
DETECTION = {
    "images": "id long, file_name string, width double, height double", "annotations": "id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int",
    "categories": "id long, name string",
}


def detection_tables(spark: SparkSession, path: str, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of a detection document, with the columns that ``curate`` takes."""
    got = read_arrays(spark, path, DETECTION, range_bytes)
    boxes = got["annotations"].select(F.col("id").alias("annotation_id"), "image_id", "category_id", *[F.get("bbox", F.lit(i)).alias(k) for i, k in enumerate("xywh")], "area", "iscrowd")
    return got["images"].withColumnRenamed("id", "image_id"), boxes, got["categories"].withColumnRenamed("id", "category_id")


def read_map(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE) -> DataFrame:
    """(key, value) of a document that is one object of many fields, such as scene graphs by image."""
    rows = _elements(spark, path, _scanned(spark, path, [""], range_bytes)[""])
    return rows.select(F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), f"map<string,{schema}>")))


def write_framed(pieces: list[tuple[str, DataFrame]], end: str, path: str) -> int:
    """One file of texts (column ``value``): of each piece what stands before it and its rows with commas between, then ``end``.

    Rows are written as files by many tasks; their sizes say where each of them lies in the document, and tasks copy them
    there. The document appears under its name when it is complete. ``path`` is on a file system where all tasks can write
    at an offset. Returns the number of bytes.
    """
    spark = pieces[0][1].sparkSession
    target = path.removeprefix("file://")
    made, jobs, frames, at = f"{target}.{uuid.uuid4().hex}", [], [], 0
    listing = spark._jvm.org.apache.hadoop.fs.Path(f"file://{made}").getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (before, rows) in enumerate(pieces):
        rows.select(F.concat(F.lit(","), "value").alias("value")).write.text(f"file://{made}/{k}")
        frames.append((at, before.encode()))
        at += len(before.encode())
        skip = 1  # no comma before the first row
        for status in sorted(listing.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"file://{made}/{k}")), key=lambda s: s.getPath().getName()):
            name, length = status.getPath().getName(), status.getLen()
            if name.startswith("part-") and length > skip:
                jobs.append((f"{made}/{k}/{name}", skip, at, length - skip))
                at, skip = at + length - skip, 0
    frames.append((at, end.encode()))
    whole = f"{made}/whole"
    with open(whole, "wb") as f:
        f.truncate(at + len(end.encode()))
        for place, text in frames:
            f.seek(place)
            f.write(text)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                with open(job["name"], "rb") as source, open(whole, "r+b") as out:
                    source.seek(job["skip"])
                    out.seek(job["at"])
                    while chunk := source.read(RANGE):
                        out.write(chunk)
                yield pa.RecordBatch.from_pydict({"length": [job["length"]]})

    if jobs:
        table = spark.createDataFrame(jobs, "name string, skip long, at long, length long").repartition(len(jobs), "name")
        table.mapInArrow(copy, "length long").agg(F.sum("length")).collect()
    files = spark._jvm.org.apache.hadoop.fs.Path
    listing.delete(files(f"file://{target}"), False)
    if not listing.rename(files(f"file://{whole}"), files(f"file://{target}")):
        raise OSError(f"{target} can't be written")
    listing.delete(files(f"file://{made}"), True)
    return at + len(end.encode())


def write_array(rows: DataFrame, path: str) -> int:
    """Rows as one JSON array, an element a line."""
    return write_framed([("[\n", rows.select(F.to_json(F.struct(*rows.columns)).alias("value")))], "]\n", path)


def write_document(tables: dict[str, DataFrame], path: str) -> int:
    """Tables as the arrays of one JSON object."""
    pieces = [(("{" if not k else "],\n") + json.dumps(name) + ": [\n", rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))) for k, (name, rows) in enumerate(tables.items())]
    return write_framed(pieces, "]}\n", path)


# What the registry says of every data set.
REGISTERED = {"ranking": True, "formatting": "sharegpt", "columns": {"messages": "conversations", "chosen": "chosen", "rejected": "rejected", "images": "images"}}


def write_trainer_data(sets: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Chat records of each data set as ``<name>.json``, and ``dataset_info.json``, which names the files and their columns.

    Returns the bytes of each document. The registry is written last: what it names is complete.
    """
    sizes = {name: write_array(rows, f"{folder}/{name}.json") for name, rows in sets.items()}
    info = {name: {"file_name": f"{name}.json", **REGISTERED} for name in sets}
    with open(f"{folder.removeprefix('file://')}/dataset_info.json", "w", encoding="utf-8") as f:
        f.write(json.dumps(info, indent=2) + "\n")
    return sizes


def numbered(lines: DataFrame, picked: Column) -> DataFrame:
    """(path, line, value) of the ``picked`` lines of text files, numbered from 1, blank lines counted.

    ``lines`` is ``spark.read.text``. Lines of a split stand one after the other, so a line's number is that of the lines in
    the file's splits before, plus its place in the split; only picked lines are joined with the splits.
    """
    rows = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    found = rows.where(picked).join(splits, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    return found.select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def numbered_malformed(lines: DataFrame) -> DataFrame:
    """(path, line, value) of the lines of JSONL files that are neither blank nor one whole JSON value."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    return numbered(lines, (text != "") & ~whole_json(text))


def malformed_lines(spark: SparkSession, path) -> DataFrame:
    return numbered_malformed(spark.read.text(path))
