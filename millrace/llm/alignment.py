"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text (with a space before it) into byte ranges. Tokens of both, sorted by their starts, are
coalesced: a group ends where a start reaches the largest end so far, that is where tokens of both end. Every overlap of
an A token with a B token is a link; how often an id pair is linked in the whole corpus ranks the pairs.

Neither tokenizer joins anything across a single space between two characters that aren't white space, so texts fall into
fragments there, and a fragment that a block of documents has many times is encoded and coalesced once. A block yields one
row: its documents as lists of fragments, its fragments as lists of links, and the id pairs it has with their numbers. Pairs
are summed over the corpus; tasks hold the sums while they are few, else each block is joined with those of its own pairs,
so nothing larger than a block is gathered.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .shared import BROADCAST, Workspace, small, table
from .textnp import chunks, column, trim

#: Bytes of fragments that are encoded at once, and of texts that are looked at together.
PIECE, PART = 1 << 16, 1 << 20
#: Bytes of texts and distinct fragments that end a block.
BLOCK, FRAGMENTS = 16 << 20, 100_000
#: First bytes of characters that are surely no white space, and of how many bytes they are.
_SOLID = np.zeros(256, np.uint8)
_SOLID[0x21:0x7F], _SOLID[0xC3:0xE0], _SOLID[0xE0], _SOLID[0xE4:0xF0], _SOLID[0xF0:0xF5] = 1, 2, 3, 3, 4
BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "n_fragments array<int>, fragment array<int>, fragment_links array<int>, link array<int>, pair array<long>, times array<long>"
)
_loaded: dict[tuple[str, str], Pair] = {}


class Pair:
    """Two tokenizers: A a byte-level one of `tokenizers`, B one of `sentencepiece` with byte fallback."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        spec = json.loads(self.a.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError(f"{path_a} is no plain byte-level tokenizer, its tokens may join words")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = _byte_characters()
        by_id = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=False).items())
        self.bytes_a = [b""] * (by_id[-1][0] + 1)
        for i, t in by_id:
            self.bytes_a[i] = bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b} has pieces of more than one word, its tokens may join words")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.digits = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))

    def encode(self, text: bytes) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text that begins with a space; None if the joined bytes of one differ from the text."""
        said = text.decode()
        a, b = self.a.encode(said, add_special_tokens=False).ids, self.b.encode(said[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) != text or b"".join(map(self.bytes_b.__getitem__, b)) != text:
            return None
        return a, b


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of successive runs of ``values``, exact in integers."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the fragments of rows that aren't empty, which are clean at both ends, and how many each row has.

    A cut is at every row's start, and at a space whose neighbours surely are no white space.
    """
    size = _SOLID[data]
    starts = size > 0
    closes = np.zeros(len(data), bool)  # a solid character's last byte
    for k in (1, 2, 3, 4):
        at = np.flatnonzero(size == k) + k - 1
        closes[at[at < len(data)]] = True
    space = data == 0x20
    opens = np.zeros(len(data), bool)
    opens[:-1] = space[:-1] & starts[1:]
    here = opens.copy()
    here[1:] &= closes[:-1]
    here[offs[:-1]] = True
    at = np.flatnonzero(here)
    ends = np.append(at[1:], len(data))
    return at, opens[at] & closes[ends - 1], np.diff(np.searchsorted(at, offs))


class Aligned:
    """Fragments encoded by both tokenizers and coalesced.

    By fragment: ``good`` (both give its bytes back), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``text`` (its groups).
    By link, fragment after fragment: ``pairs`` (the id of A times the size of B, plus the id of B).
    """

    def __init__(self, fragments: list[bytes], clean: np.ndarray, both: Pair) -> None:
        n = len(fragments)
        size = np.fromiter(map(len, fragments), np.int64, n)
        order = np.argsort(~clean, kind="stable")
        n_clean = int(clean.sum())
        begin = np.zeros(n, np.int64)  # where a fragment stands if all stand one after the other in this order
        begin[order] = np.cumsum(size[order]) - size[order]
        self.good = np.ones(n, bool)
        parts = np.split(order[:n_clean], np.flatnonzero(np.diff(begin[order[:n_clean]] // PIECE)) + 1) + [order[i : i + 1] for i in range(n_clean, n)]
        ids: tuple[list, list] = ([], [])
        starts: tuple[list, list] = ([], [])
        parts.reverse()
        while parts:
            part = parts.pop()
            if not len(part):
                continue
            got = both.encode(b"".join([fragments[i] for i in part.tolist()]))
            if got is not None:
                for side, lengths in enumerate((both.len_a, both.len_b)):
                    own = np.array(got[side], np.int64)
                    long = lengths[own]
                    ids[side].append(own)
                    starts[side].append(begin[part[0]] + np.cumsum(long) - long)
            elif len(part) == 1:
                self.good[part[0]] = False
            else:
                parts += [part[i : i + 1] for i in range(len(part))][::-1]
        flat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        a, b, a_at, b_at = flat(ids[0]), flat(ids[1]), flat(starts[0]), flat(starts[1])
        a_to, b_to = a_at + both.len_a[a], b_at + both.len_b[b]
        # Groups: sorted by starts, a start that reaches the largest end so far opens the next one.
        start, end = np.concatenate([a_at, b_at]), np.concatenate([a_to, b_to])
        by = np.lexsort((end, start))
        top = np.maximum.accumulate(end[by])
        opens = np.ones(len(by), bool)
        opens[1:] = start[by][1:] >= top[:-1]
        group = np.zeros(len(by), np.int64)
        group[by] = np.cumsum(opens) - 1
        group_a, group_b = group[: len(a)], group[len(a) :]
        # Overlaps within the groups.
        first = np.searchsorted(b_to, a_at, "right")
        count = np.searchsorted(b_at, a_to, "left") - first
        link_a, link_b = np.repeat(np.arange(len(a)), count), _ranges(first, count)
        # Back from places to fragments.
        slot = begin[order]
        holder = lambda at: order[np.searchsorted(slot, at, "right") - 1]
        of_a, of_b, of_group = holder(a_at), holder(b_at), holder(start[by][opens])
        of_link = of_a[link_a]
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.bincount(x, minlength=n).astype(np.int64) for x in (of_a, of_b, of_group, of_link))
        self.pairs = (a[link_a] * len(both.bytes_b) + b[link_b])[np.argsort(of_link, kind="stable")]
        said_a, said_b = (list(map(both.digits.__getitem__, x.tolist())) for x in (a, b))
        edge = np.arange(int(opens.sum()) + 1)
        bounds_a, bounds_b = np.searchsorted(group_a, edge).tolist(), np.searchsorted(group_b, edge).tolist()
        several = lambda i, j, k, m: f"{','.join(said_a[i:j])}|{','.join(said_b[k:m])}"
        bounds = zip(bounds_a, bounds_a[1:], bounds_b, bounds_b[1:])
        groups = [f"{said_a[i]}|{said_b[k]}" if j - i == 1 == m - k else several(i, j, k, m) for i, j, k, m in bounds]
        self.text, at = [b""] * n, 0
        for i, m in zip(order.tolist(), self.n_groups[order].tolist()):
            self.text[i] = ";".join(groups[at : at + m]).encode()
            at += m


class Block:
    """Documents of one row: texts come in parts, and a fragment is worked on when it is met first."""

    def __init__(self, both: Pair, with_groups: bool) -> None:
        self.both, self.with_groups, self.size = both, with_groups, 0
        self.known: dict[bytes, int] = {}
        self.bad: list[int] = []
        self.text: list[bytes] = []
        self.made: list[tuple[np.ndarray, ...]] = []  # n_a, n_b, n_groups, n_links and pairs of fragments
        self.docs: list[tuple] = []  # doc_id, fragments of each document, the fragments, digests, groups

    def add(self, doc_id: pa.Array, data: np.ndarray, offs: np.ndarray) -> None:
        """Documents as bytes and row offsets into them."""
        self.size += len(data)
        m = len(offs) - 1
        real = np.flatnonzero(np.diff(offs) > 0)
        counts, index, said = np.zeros(m, np.int32), np.zeros(0, np.int32), [b""] * m
        if len(real):
            data = np.insert(data, offs[real], 0x20)
            at, clean, per_row = cut(data, np.concatenate([[0], np.cumsum(np.diff(offs)[real] + 1)]))
            raw, known, old = data.tobytes(), self.known, len(self.known)
            edges = [*at.tolist(), len(raw)]
            index = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(edges, edges[1:])), np.int32, len(at))
            if len(known) > old:
                first = np.zeros(len(known) - old, np.int64)
                here = np.flatnonzero(index >= old)[::-1]
                first[index[here] - old] = here
                new = Aligned([raw[edges[i] : edges[i + 1]] for i in first.tolist()], clean[first], self.both)
                self.bad += (np.flatnonzero(~new.good) + old).tolist()
                self.text += new.text
                self.made.append((new.n_a, new.n_b, new.n_groups, new.n_links, new.pairs))
            if self.bad:
                whole = _sums(np.isin(index, self.bad), per_row) == 0
                index, real, per_row = index[np.repeat(whole, per_row)], real[whole], per_row[whole]
            counts[real] = per_row
            texts = list(map(self.text.__getitem__, index.tolist()))
            for r, e, k in zip(real.tolist(), np.cumsum(per_row).tolist(), per_row.tolist()):
                said[r] = b";".join(texts[e - k : e])
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in said]
        self.docs.append((doc_id, counts, index, digests, [x.decode() for x in said] if self.with_groups else []))

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.known) >= FRAGMENTS

    def row(self) -> dict:
        """The columns of BLOCKS but the block's number."""
        n_a, n_b, n_groups, n_links, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*self.made)) or [()] * 5))
        counts, index = np.concatenate([d[1] for d in self.docs]), np.concatenate([d[2] for d in self.docs])
        pair, link = np.unique(keys, return_inverse=True)
        seen = np.bincount(index, minlength=len(n_links))
        out = {c: _sums(v[index], counts) for c, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))}
        return out | {
            "doc_id": pa.concat_arrays([d[0] for d in self.docs]), "groups_sha256": [x for d in self.docs for x in d[3]], "groups": [x for d in self.docs for x in d[4]],
            "n_fragments": counts, "fragment": index, "fragment_links": n_links.astype(np.int32), "link": link.astype(np.int32), "pair": pair,
            "times": np.bincount(link, np.repeat(seen, n_links), len(pair)).astype(np.int64),
        }


def blocks(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row for each batch of documents, with the columns of BLOCKS (and ``groups``)."""
    schema = StructType.fromDDL(BLOCKS + (", groups array<string>" if with_groups else ""))
    schema = StructType([StructField("doc_id", ArrayType(docs.schema["doc_id"].dataType)) if f.name == "doc_id" else f for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(both, with_groups)

        def row() -> pa.RecordBatch:
            made = block.row()
            cols = [pa.array([number], pa.int64())]
            for f in schema.fields[1:]:
                v = made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name])
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            for lo, hi, data, offs in chunks(column(batch, "text"), PART):
                block.add(column(batch, "doc_id").slice(lo, hi - lo), data, offs)
                if block.full():
                    yield row()
                    block, number = Block(both, with_groups), number + 1
                    trim()
        if block.docs:
            yield row()
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(made: DataFrame, n_b: int) -> DataFrame:
    """id_a, id_b and n, the number of links in the corpus, of every linked id pair in ``blocks``, and whether n is its B id's highest."""
    ws = Workspace(made.sparkSession, "pairs")
    each = made.select(F.explode(F.arrays_zip("pair", "times")).alias("p")).where("p.times > 0").groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = ws.write(each.select("pair", "n", F.expr(f"pair div {n_b}").alias("id_a"), F.expr(f"pair % {n_b}").alias("id_b")), "counts")
    top = ws.write(counts.groupBy(F.col("id_b").alias("top_b")).agg(F.max("n").alias("top")), "top")
    return ws.write(counts.join(small(top), F.col("id_b") == F.col("top_b")).select("pair", "id_a", "id_b", "n", (F.col("n") == F.col("top")).alias("best")), "ranked")


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, held: int = BROADCAST) -> DataFrame:
    """How two tokenizers cut every row of ``docs`` (doc_id, text): one row each, in any order.

    doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose id pair is its B id's most frequent in the corpus,
    ties included), count_sum (of the pairs' numbers over the links), groups_sha256, and with ``with_groups`` the groups
    themselves, as ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros, and '' for the
    groups and their digest; they don't count in the corpus. A text of any length is read whole; repeated rows each count
    and each get a row; a null doc_id stays null; other columns are not read, whatever their names; an empty table gives none.

    Every task holds the pairs' numbers if they take at most ``held`` bytes, else each block is joined with those of its pairs.
    """
    ws = Workspace(docs.sparkSession, "align")
    made = ws.write(blocks(docs, path_a, path_b, with_groups), "blocks", rows=1)  # a block is large; a task has as many as its split gives
    ranked = pair_counts(made, len(pair_of(path_a, path_b).bytes_b)).select(F.col("pair").alias("key"), "n", "best")
    row = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    needed = [*row, "n_fragments", "fragment", "fragment_links", "link", "pair"]
    kind = {f.name: f.dataType.elementType for f in made.schema if f.name in row}
    schema = StructType([StructField(c, kind[c]) for c in row] + StructType.fromDDL("n_best long, count_sum long").fields)
    shared = None
    if ranked.count() * 17 <= held:
        known = ranked.orderBy("key").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy().astype(np.int64) for c in ("key", "n", "best")))
        joined = made.select(needed)
    else:
        own = made.select("block", F.posexplode("pair").alias("pos", "pair")).join(ranked, F.col("pair") == F.col("key"))
        values = own.groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("value"))
        joined = made.join(values, F.col("block") == F.col("of"), "left").select(*needed, "value")

    def numbers(batch: pa.RecordBatch, i: int, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many links each pair of a block has in the corpus, and whether that is its B id's highest; 0 for pairs without."""
        n, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        if shared is not None:
            key, every, top = shared.value
            if len(key):
                at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
                there = key[at] == pair
                n[there], best[there] = every[at[there]], top[at[there]]
            return n, best
        value = column(batch, "value").slice(i, 1).flatten()
        if len(value):
            pos, every, top = (x.to_numpy(zero_copy_only=False) for x in value.flatten())
            n[pos], best[pos] = every, top
        return n, best

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {c: column(batch, c).slice(i, 1).flatten() for c in needed}
                num = {c: one[c].to_numpy(zero_copy_only=False) for c in needed if c not in row}
                n, best = numbers(batch, i, num["pair"])
                sums = [_sums(_sums(v[num["link"]], num["fragment_links"])[num["fragment"]], num["n_fragments"]) for v in (best, n)]
                yield pa.RecordBatch.from_arrays([*(one[c] for c in row), *map(pa.array, sums)], names=schema.names)
            trim()

    return joined.mapInArrow(finish, schema)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"), *vocabularies())
