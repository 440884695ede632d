"""Removal of byte strings that occur more than once, by column-wise construction of a Burrows-Wheeler transform.

What is looked for are strings of ``length`` bytes with two or more starts. Sorting all suffixes of a corpus one symbol
a round needs as many rounds as the longest document has bytes, each over everything sorted so far; instead suffixes
are brought together first, and the transform is built over bounded segments:

1. Of every ``length`` bytes one anchor is selected: the position with the least rolling hash. Equal strings select the
   same place in themselves, so whatever is repeated shares an anchor hash. A run of starts with one anchor is a segment.
2. Segments whose anchor hash occurs once go. The rest are dealt to tasks by anchor hash, as sequential runs of rows. What
   one text has several times over is one row.
3. In a task, segments of an anchor stand aligned. The collection's transform is built column by column: each round
   inserts the next symbol of every segment, re-sorts the segments by what was read so far (a stable sort by the new
   symbol, as in a positional Burrows-Wheeler transform) and updates the common lengths of neighbours. A start is
   repeated when a neighbour has ``length`` symbols in common, compared byte by byte.

The strings of an anchor with more segments than one task should hold are counted instead, by two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small, table
from .textnp import BYTE, U, chunks, column, mix, powers, prefix, spans

LENGTH, GRAM = 400, 48
#: Segments of one anchor that a task takes, and segments sorted at once.
CROWD, BATCH = 16384, 4096


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    rows = np.append(values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, hash, anchor, first start, last start) of each run of starts with one anchor; places within the row."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64, np.int64))
    pre, k = prefix(BYTE[data]), n - gram + 1
    h = mix((pre[gram:] - pre[:k]) * powers(k, -1))
    least = sliding_min((h & U(0xFFFFFFFF00000000)) | np.arange(k, dtype=U), length - gram + 1)
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.maximum(np.diff(offs) - length + 1, 0))
    size = np.maximum(np.diff(offs) - length + 1, 0)
    start = np.repeat(offs[:-1] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(len(row))
    at = at[start]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(row)) - 1
    base = offs[row[first]]
    return row[first], h[at[first]], at[first] - base, start[first] - base, start[last] - base


def repeated_starts(groups: np.ndarray, cells: np.ndarray, inside: np.ndarray, length: int) -> np.ndarray:
    """Which starts of aligned segments are repeated within their group: a matrix (segment, column of the start).

    ``cells`` holds the segments as rows; ``inside`` tells which cells belong to them. Rows are sorted by group.
    """
    m, width = cells.shape
    out = np.zeros((m, max(width - length + 1, 0)), bool)
    order, common = np.arange(m), np.zeros(m, np.int16)
    groups = 2 * groups.astype(np.uint16)
    steps = [1 << j for j in range(max(m.bit_length(), 1))]
    log = np.zeros(m + 1, np.int64)
    for i in range(2, m + 1):
        log[i] = log[i // 2] + 1
    place = np.empty(m, np.int64)
    for col in range(width):
        symbol = cells[:, col][order]
        # Insert the column: a stable sort by symbol within each group.
        by = np.argsort(symbol, kind="stable")
        ok = inside[:, col][order]
        by = by[np.argsort(groups[order[by]] + ~ok[by], kind="stable")]  # rows without a symbol here go last
        new = order[by]
        # Neighbours with one symbol have in common what all between them had before, and this symbol.
        low = np.empty((len(steps), m), np.int16)
        low[0] = common
        for j in range(1, len(steps)):
            s = steps[j - 1]
            low[j] = low[j - 1]
            np.minimum(low[j - 1][: m - s], low[j - 1][s:], out=low[j][: m - s])
        a, b = by[:-1] + 1, by[1:]
        ok = ok[by]
        same = (symbol[by[1:]] == symbol[by[:-1]]) & (groups[new[1:]] == groups[new[:-1]]) & ok[1:] & ok[:-1]
        j = log[np.maximum(b - a + 1, 1)]
        between = np.minimum(low[j, np.minimum(a, m - 1)], low[j, np.maximum(b - (1 << j) + 1, 0)])
        common = np.zeros(m, np.int16)
        common[1:][same] = np.minimum(between[same] + 1, length)
        order = new
        if col >= length - 1:
            hit = common >= length
            hit[:-1] |= hit[1:]
            out[order[hit], col - length + 1] = True
    return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _segments_to_spans(rows: DataFrame, length: int, gram: int, batch_rows: int) -> DataFrame:
    """(t1, t2, first, end) of what is repeated, from segments (h, t1, t2, lo, ats, bytes).

    ``lo`` is the segment's first start as seen from its anchor; ``ats`` are the places of the anchor in the text.
    """
    reach = length - gram
    width = reach + length

    def solve(pending: list[tuple]) -> Iterator[tuple]:
        m = len(pending)
        cells, inside = np.zeros((m, width), np.uint8), np.zeros((m, width), bool)
        groups = np.zeros(m, np.int64)
        for i, (h, _, _, lo, _, raw) in enumerate(pending):
            groups[i] = groups[i - 1] + (h != pending[i - 1][0]) if i else 0
            a = lo + reach
            cells[i, a : a + len(raw)] = np.frombuffer(raw, np.uint8)
            inside[i, a : a + len(raw)] = True
        hit = repeated_starts(groups, cells, inside, length)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
            _, t1, t2, _, ats, _ = pending[i]
            if len(ats) == 1:
                yield t1, t2, a + ats[0] - reach, b - 1 + ats[0] - reach + length
        for _, t1, t2, lo, ats, raw in pending:
            if len(ats) > 1:
                yield from ((t1, t2, a, b) for a, b in merged([(at + lo, at + lo + len(raw)) for at in ats]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        group: list[tuple] = []
        kinds = [pa.int64()] * 4

        def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["t1", "t2", "first", "end"])

        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("h", "t1", "t2", "lo", "ats", "bytes")), strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) > 1 or len(group[0][4]) > 1:
                        if len(pending) + len(group) > batch_rows and pending:
                            yield from packed(list(solve(pending)))
                            pending = []
                        pending += group
                    group = []
                group.append(row)
        if group and (len(group) > 1 or len(group[0][4]) > 1):
            pending += group
        if pending:
            yield from packed(list(solve(pending)))

    rows = rows.repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "t1 long, t2 long, first long, end long")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, batch_rows: int = BATCH, with_kept: bool = False) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts elsewhere, in the same text or another.

    Texts are UTF-8 bytes, null is empty; matches stay within a document, overlaps count, and strings are judged on the
    input. Every occurrence goes, the first too. Rows with equal texts cover each other whole, if long enough; so do rows
    that repeat a doc_id. Texts are known by two 64-bit hashes. A text of any length (below 2 GB) is worked on whole; an empty
    table gives no rows; other columns aren't read, whatever their names. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and the remaining bytes as ``kept`` if asked for (they may cut a character).
    """
    ws = Workspace(docs.sparkSession, "suffix_dedup")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("body"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            t1, t2, where = column(batch, "t1").to_numpy(), column(batch, "t2").to_numpy(), 0
            for a, b, data, offs in chunks(column(batch, "body")):
                row, h, at, lo, hi = anchors(data, offs, length, gram)
                fresh = np.ones(b - a, bool)
                for i in range(b - a):
                    key = (t1[a + i], t2[a + i])
                    fresh[i] = key not in seen
                    seen.add(key)
                use = np.flatnonzero(fresh[row])
                use = use[np.lexsort((h[use], row[use]))]
                row, h, spots = row[use], h[use], np.stack([x[use] for x in (at, lo, hi)], axis=1).astype("<i4")
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(row) else np.zeros(0, np.int64)
                ends = pa.py_buffer((np.append(first, len(row)) * 12).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(spots.tobytes())])
                cols = [pa.array(h[first].view(np.int64)), pa.array(t1[a:b][row[first]]), pa.array(t2[a:b][row[first]]), packed]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "t1", "t2", "spots"])

    # spots: anchor, first and last start of each run, as three 32-bit numbers.
    long_enough = rows.where(F.octet_length("body") >= length)
    found = ws.write(long_enough.select("body", "t1", "t2").mapInArrow(find, "h long, t1 long, t2 long, spots binary"), "anchors")
    texts = long_enough.groupBy("t1", "t2").agg(F.min("doc_id").alias("one"), F.count("*").alias("copies"), F.max(F.octet_length("body")).alias("n"))
    texts = ws.write(texts, "texts")
    often = found.groupBy("h").agg((F.sum(F.octet_length("spots")) / 12).alias("times")).where("times > 1")
    # What several tasks saw of one text counts once.
    shared = ws.write(found.join(often, "h").groupBy("t1", "t2", "h", "spots").agg(F.max("times").alias("times")), "shared")
    # Crowded are anchors with many segments of different texts; tasks have seen as many of them at least.
    crowds = shared.where(F.col("times") > crowd).groupBy(F.col("h").alias("g")).agg((F.sum(F.octet_length("spots")) / 12).alias("segments"))
    crowds = small(ws.write(crowds.where(F.col("segments") > crowd).select("g"), "crowds"))
    shared = shared.join(crowds, F.col("h") == F.col("g"), "left")
    per_text = shared.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "spots", F.col("g").isNotNull().alias("hot"))).alias("anchors"))
    per_text = ws.write(per_text.join(texts.select("t1", "t2", "one"), ["t1", "t2"]), "per_text")
    ws.drop("anchors", "shared")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments; for a crowded anchor, two hashes of each string and its starts (bytes null)."""
        names = ["h", "t1", "t2", "lo", "ats", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            out, held = [], 0
            for body, t1, t2, own in zip(*(column(batch, c).to_pylist() for c in ("body", "t1", "t2", "anchors")), strict=True):
                raw, hashes = body.encode(), None
                for anchor in own:
                    same: dict[tuple, list[int]] = {}
                    for at, lo, hi in np.frombuffer(anchor["spots"], "<i4").reshape(-1, 3).tolist():
                        if anchor["hot"]:
                            if hashes is None:
                                data = np.frombuffer(raw, np.uint8)
                                hashes = prefix(BYTE[data]), prefix(mix(BYTE[data] + U(1)))
                            s = np.arange(lo, hi + 1)
                            one, two = (spans(p, s, s + length).view(np.int64).tolist() for p in hashes)
                            for key in zip(one, two, s.tolist(), strict=True):
                                same.setdefault(key[:2], []).append(key[2])
                        else:
                            same.setdefault((lo - at, raw[lo : hi + length]), []).append(at)
                    for (x, y), places in same.items():
                        out.append((x, t1, t2, y, places, None) if anchor["hot"] else (anchor["h"], t1, t2, x, places, y))
                        held += 8 if anchor["hot"] else len(y)
                if held > 4 << 20 or len(out) > 100_000:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    chosen = small(per_text.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("one")))
    bodies = rows.join(chosen, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("doc_id").eqNullSafe(F.col("one"))).select("body", "t1", "t2")
    pieces = bodies.join(per_text.select("t1", "t2", "anchors"), ["t1", "t2"])
    pieces = pieces.select("body", "t1", "t2", "anchors").mapInArrow(cut, "h long, t1 long, t2 long, lo long, ats array<long>, bytes binary")
    crowded = not per_text.where(F.exists("anchors", lambda a: a["hot"])).isEmpty()
    if crowded:
        pieces = ws.write(pieces, "pieces")
    segments = pieces.where("bytes is not null") if crowded else pieces
    covered = _segments_to_spans(segments, length, gram, batch_rows)
    if crowded:
        strings = pieces.where("bytes is null").select("h", F.col("lo").alias("f2"), "t1", "t2", "ats").distinct()
        twice = strings.groupBy("h", "f2").agg(F.sum(F.size("ats")).alias("n")).where("n > 1").select("h", "f2")
        strings = strings.join(twice, ["h", "f2"]).select("t1", "t2", F.explode("ats").alias("first"))
        covered = covered.unionByName(strings.withColumn("end", F.col("first") + length))
    copied = texts.where("copies > 1").select("t1", "t2", F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("end"))
    covered = covered.unionByName(copied).groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    covered = ws.write(covered, "covered")
    ws.drop("pieces")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            out = []
            for body, own in zip(column(batch, "body").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                raw = body.encode()
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, [s["first"] for s in own], 1)
                np.add.at(edge, [s["end"] for s in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    keys = small(covered.select(F.col("t1").alias("u1"), F.col("t2").alias("u2")))
    on = (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    touched = rows.join(keys, on, "left_semi").join(covered, ["t1", "t2"]).select("doc_id", "body", "spans")
    touched = touched.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    whole = rows.join(keys, on, "left_anti").select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"),
        (F.encode("body", "UTF-8") if with_kept else F.lit(None).cast("binary")).alias("kept"),
    )
    out = touched.unionByName(whole)
    return out if with_kept else out.drop("kept")


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))
