"""Packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut; what is packed depends on the lengths of the pieces alone. The histogram of
lengths is small whatever the corpus (one count a length), so the packing is planned on it:

1. Lengths fall into classes of a few tokens, all of them. The configuration linear program (cover all pieces by as few
   patterns of one sequence as can be) is solved by multiplicative weights: the price of a class falls as it gets covered,
   a knapsack dynamic program finds the patterns of the highest price, and rounds go on until every class is covered.
2. A share of the solution is rounded, by running sums, to whole sequences, filled to the last token with lengths of
   their classes. What is left over goes, longest first, into the tightest open gap. The share kept is the largest that
   needs no more sequences than best fit of everything.
3. Every slot of the plan is a range of ranks among the pieces of one length. Pieces get their ranks from counts by
   length and task, so assigning them to slots is one join of narrow rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Workspace, small, table
from .textnp import BYTE, IS_SPACE, U, chunks, column, prefix, spans, words

CAPACITY, END = 4096, 1
#: Classes of lengths at most; the program: part of a class that one step covers, fall of prices, and how much less than
#: the best a pattern may be worth; shares of the solution that are tried in rounding.
CLASSES, STEP, DECAY, SLACK = 1024, 0.5, 2.0, 0.05
SHARES = (0.9, 0.75, 0.5, 0.25)
#: Bytes of words and tokens that a worker remembers, over its tasks.
CACHE = 24 << 20
#: A character that stands between words while they are encoded.
PARTING = "\x01"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, lrank long"
_encoders: dict[str, tokenizers.Tokenizer] = {}
_word_tokens: dict[str, WordTokens] = {}


def _flat(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the spans [first, first + length), one span after the other."""
    stop = np.cumsum(length)
    return np.repeat(first - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)


class WordTokens:
    """Token ids of texts by words: white space never joins tokens here, so a word that was met before isn't encoded again.

    Words are looked up by a 64-bit hash and then compared byte by byte. What is remembered is dropped beyond ``cache`` bytes.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        if path not in _encoders:
            _encoders[path] = tokenizers.Tokenizer.from_file(path)
        self.encoder, self.cache = _encoders[path], cache
        alone = self.encoder.encode(f"a {PARTING} b", add_special_tokens=False).ids
        self.parting = alone[1] if len(alone) == 3 else None
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slot = np.zeros(0, U), np.zeros(0, np.int32)
        self.ids, self.first, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encoder.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(texts))

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has; a few thousand words are encoded as one text, parted."""
        ids, count = [], []
        for a in range(0, len(texts), 2000):
            part = texts[a : a + 2000]
            joined = f" {PARTING} ".join(part)
            if self.parting is None or joined.count(PARTING) >= len(part):  # a word has the parting character
                own, n = self._one_by_one(part)
            else:
                own = np.array(self.encoder.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(own == self.parting)
                own, n = np.delete(own, cuts), np.diff(np.concatenate([[-1], cuts, [len(own)]])) - 1
            ids.append(own)
            count.append(n)
        return np.concatenate(ids), np.concatenate(count)

    def _keep(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """Encode and remember new words."""
        raw = data.tobytes()
        ids, count = self._tokens([raw[a : a + n].decode() for a, n in zip(starts.tolist(), size.tolist(), strict=True)])
        n = len(self.first)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
        self.length, self.ids = np.append(self.length, count), np.append(self.ids, ids)
        self.at = np.append(self.at, len(self.bytes) + np.cumsum(size) - size)
        self.size, self.bytes = np.append(self.size, size), np.append(self.bytes, data[_flat(starts, size)])
        place = np.searchsorted(self.keys, keys)  # keys are sorted
        self.keys, self.slot = np.insert(self.keys, place, keys), np.insert(self.slot, place, np.arange(n, n + len(size), dtype=np.int32))

    def _known(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """The slot of each word; None if two words have one hash."""
        keys, at, back = np.unique(spans(prefix(BYTE[data]), starts, starts + size), return_index=True, return_inverse=True)
        if 5 * self.bytes.nbytes + 40 * len(keys) > self.cache:
            self._reset()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        new[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] != keys[place < len(self.keys)]
        if new.any():
            self._keep(keys[new], data, starts[at[new]], size[at[new]])
            place = np.searchsorted(self.keys, keys)
        slot = self.slot[place][back]
        # Without white space, the bytes of a chunk are those of its words in turn.
        same = (self.size[slot] == size).all() and (self.bytes[_flat(self.at[slot], size)] == data[~IS_SPACE[data]]).all()
        return slot if same else None

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text; null is empty."""
        for _, _, data, offs in chunks(texts):
            starts, ends, count = words(data, offs)
            if not len(starts):
                yield from (np.zeros(0, np.uint32) for _ in count)
                continue
            slot = self._known(data, starts, ends - starts)
            if slot is None:
                raw = data.tobytes()
                ids, length = self._one_by_one([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            else:
                length = self.length[slot]
                ids = self.ids[_flat(self.first[slot], length)]
            cuts = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(count))]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): PIECES, and ``ids`` if asked for.

    ``part`` and ``lrank`` number the pieces of each length within a task; write the result before using them.
    """
    schema = StructType.fromDDL(PIECES + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        if path not in _word_tokens:
            _word_tokens[path] = WordTokens(path)
        tokens = _word_tokens[path]
        for batch in batches:
            rows = []
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), tokens.encode(column(batch, "text")), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    n = len(own)
                    rows.append((doc, k, a, n, zlib.crc32(own.tobytes()), part, ranks[n], *([own.astype(np.int32)] if with_ids else [])))
                    ranks[n] += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every size up to ``len(prices) - 1``, and the class taken there (0 for none); prices[c] is that of class c."""
    room = len(prices) - 1
    value, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    down = prices[::-1].copy()  # so that value[0:c] + down[room - c : room] pairs value[c - k] with prices[k]
    for c in range(1, room + 1):
        sums = value[:c] + down[room - c : room]
        best = int(sums.argmax())
        if sums[best] > value[c - 1]:
            value[c], took[c] = sums[best], c - best
        else:
            value[c] = value[c - 1]
    return value, took


def traced(took: np.ndarray, size: int) -> list[int]:
    """Classes (with repeats) of the best pattern of ``size``."""
    filled, out = np.maximum.accumulate(np.where(took > 0, np.arange(len(took)), 0)), []
    while (size := int(filled[size])) > 0:
        out.append(int(took[size]))
        size -= out[-1]
    return out


def best_pattern(prices: np.ndarray) -> list[int]:
    """Classes (with repeats) of the most valuable pattern of size ``len(prices) - 1``; 0 is the price of no class."""
    return traced(knapsack(prices)[1], len(prices) - 1)


def solve(counts: np.ndarray, step: float = STEP, decay: float = DECAY, slack: float = SLACK) -> list[tuple[tuple[int, ...], float]]:
    """Fractional pattern counts that cover ``counts`` (by class, 0 unused), each class fully.

    Of each dynamic program all patterns are used that are worth nearly as much as the best, one for each class in it.
    """
    room = len(counts) - 1
    size, live, covered, found = np.arange(room + 1) / max(room, 1), counts > 0, np.zeros(room + 1), {}
    price = lambda: np.where(live & (covered < 1 - 1e-9), size * np.exp(-decay * covered), 0.0)
    while (now := price()).any():
        value, took = knapsack(now)
        kinds = np.flatnonzero(now)
        worth = now[kinds] + value[room - kinds]
        enough, first = (1 - slack) * worth.max(), True
        for c in kinds[np.argsort(-worth, kind="stable")][: (worth >= enough).sum()].tolist():
            need = np.bincount([c, *traced(took, room - c)], minlength=room + 1)
            at = np.flatnonzero(need)
            use = np.minimum(need[at], counts[at])
            left = np.where(covered[at] < 1 - 1e-9, 1 - covered[at], 0.0)
            if covered[c] >= 1 - 1e-9 or (not first and (np.where(left > 0, size[at] * np.exp(-decay * covered[at]), 0.0) * use).sum() < enough):
                continue
            first = False
            at, use, left = at[left > 0], use[left > 0], left[left > 0]
            amount = float(min(step * (counts[at] / use).min(), (left * counts[at] / use).min()))
            covered[at] += amount * use / counts[at]
            pattern = tuple(np.repeat(at, use).tolist()[::-1])
            found[pattern] = found.get(pattern, 0.0) + amount
    return sorted(found.items())


class Plan:
    """Sequences of a packing, as (lengths, how many alike)."""

    def __init__(self, counts: dict[int, int], capacity: int, shares: tuple[float, ...] = SHARES) -> None:
        self.capacity, self.all = capacity, {n: c for n, c in counts.items() if c}
        self.kinds: list[tuple[tuple[int, ...], int]] = []
        self.planned = 0  # pieces placed by the program
        if not self.all:
            return
        grid = max(1, capacity // CLASSES)
        by_class = np.zeros(-(-capacity // grid) + 1, np.int64)
        for n, c in self.all.items():
            by_class[-(-n // grid)] += c
        solution = solve(by_class)
        best = None
        for share in (0.0, *reversed(shares)):
            self._round(solution, share, grid)
            self._fill()
            used = sum(c for _, c in self.kinds)
            if best is None or used <= best[0]:
                best = used, self.kinds, self.planned
        _, self.kinds, self.planned = best

    def _round(self, solution: list[tuple[tuple[int, ...], float]], share: float, grid: int) -> None:
        """Take a share of the solution in whole sequences: the running sum of amounts, rounded, says how many of each pattern."""
        self.left = np.zeros(self.capacity + 1, np.int64)
        for n, c in self.all.items():
            self.left[n] = c
        self.kinds, self.planned = [], 0
        if not share:
            return
        times = np.diff(np.floor(np.cumsum([share * x for _, x in solution]) + 0.5).astype(np.int64), prepend=0)
        for i in np.argsort(-times, kind="stable").tolist():
            todo = int(times[i])
            while todo and (taken := self._filled(solution[i][0], grid)):
                run = min(todo, *(int(self.left[n]) // m for n, m in taken.items()))
                for n, m in taken.items():
                    self.left[n] -= run * m
                    self.planned += run * m
                self.kinds.append((tuple(sorted((n for n, m in taken.items() for _ in range(m)), reverse=True)), run))
                todo -= run

    def _filled(self, pattern: tuple[int, ...], grid: int) -> dict[int, int]:
        """Lengths that make up a pattern and fill the sequence, with their numbers; empty if there are none left."""
        taken: dict[int, int] = {}
        for c in pattern:  # of each class the length that most pieces have
            own = range((c - 1) * grid + 1, min(c * grid, self.capacity) + 1)
            have, n = max((int(self.left[n]) - taken.get(n, 0), n) for n in own)
            if have <= 0:
                return {}
            taken[n] = taken.get(n, 0) + 1
        gap = self.capacity - sum(n * m for n, m in taken.items())
        if gap:  # a longer piece in place of one closes the gap
            for n in sorted(taken, reverse=True):
                if n + gap <= self.capacity and self.left[n + gap] - taken.get(n + gap, 0) > 0:
                    taken[n] -= 1
                    taken[n + gap] = taken.get(n + gap, 0) + 1
                    return {n: m for n, m in taken.items() if m}
            return {}
        return taken

    def _fill(self) -> None:
        """Best fit, longest first: the tightest open gap, else new sequences."""
        gaps: dict[int, list[list]] = {}
        order: list[int] = []

        def add(lengths: tuple[int, ...], count: int) -> None:
            gap = self.capacity - sum(lengths)
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([lengths, count])

        for lengths, count in self.kinds:
            add(lengths, count)
        for n in np.flatnonzero(self.left)[::-1].tolist():
            count = int(self.left[n])
            while count:
                i = bisect_left(order, n)
                if i == len(order):
                    fit = self.capacity // n
                    if count >= fit:
                        add((n,) * fit, count // fit)
                    if count % fit:
                        add((n,) * (count % fit), 1)
                    break
                own = gaps[order[i]]
                lengths, have = own.pop()
                if not own:
                    del gaps[order.pop(i)]
                use = min(have, count)
                if have > use:
                    add(lengths, have - use)
                add((*lengths, n), use)
                count -= use
        self.kinds = [(lengths, count) for own in gaps.values() for lengths, count in own]

    def slots(self) -> dict[str, np.ndarray]:
        """Ranges of ranks by length: from rank ``first`` on, ``each`` pieces go to a sequence, from sequence ``base`` and offset ``at`` on."""
        rows, base, given = [], 0, {}
        for lengths, count in sorted(self.kinds, key=lambda k: (sorted(k[0]), k[1])):
            at = 0
            for n in sorted(set(lengths), reverse=True):
                m = lengths.count(n)
                rows.append((n, given.get(n, 0), m, base, at))
                given[n] = given.get(n, 0) + m * count
                at += m * n
            base += count
        rows.sort()
        out = np.array(rows, np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "each", "base", "at"), out.T, strict=True))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's tokens are those of the tokenizer file ``path`` without special ones, then the id ``end``; a null text
    has the end alone. Rows that repeat a doc_id are packed each for itself; a doc_id is a whole number or null. A text of any
    length is cut into pieces; an empty table gives none; other columns aren't read, whatever their names. Sequences are
    gapless from 0.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    cut = ws.write(pieces(docs, path, capacity, end, with_ids), "pieces")
    by_task = ws.write(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.sparkContext.broadcast(Plan(counts, capacity).slots())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(small(ws.write(starts, "starts")), (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    ranked = ranked.withColumn("rank", F.col("lrank") + F.col("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = StructType([*ranked.select(kept).schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        key = (s["length"] << 44) + s["first"]
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            sequence = s["base"][i] + (rank - s["first"][i]) // s["each"][i]
            offset = s["at"][i] + (rank - s["first"][i]) % s["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary())
