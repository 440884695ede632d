"""Similarity join of documents on word n-grams by grouped prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches the threshold. Shingles are 64-bit hashes.

1. Documents with equal sets are one class from then on, told by two 64-bit sums over the set and its size.
2. Shingles are ordered: those that some task saw in more than one document come last, by how often they were seen, the
   rest go by hash. Any order gives right results; this one keeps common passages out of prefixes.
3. A set's prefix is so long that two sets that link share several of its shingles, the more the larger they are (and a
   shorter one will do for the smaller of the two). Classes with identical prefix and size are collapsed into one group.
4. Groups meet in blocks of prefix shingles. Pairs of groups that fail the size or prefix condition or share too few over
   all blocks go; so a passage that two long documents share doesn't make them candidates. A shingle with a
   long list isn't expanded into pairs: its groups meet the group that is in most such lists.
5. Members are expanded and verified on whole sets. Groups that meet, directly or not, are gathered in one place if they
   are few; else every group gathers those it meets. A large gathering is dealt out in chunks, each with the centre.
   In a chunk, whoever isn't linked to the centre is compared with all others. What is left over in a chunk of a larger
   gathering is then compared with the other chunks. Links that join nothing new are not written.
6. Components are found over these links; they are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, small, table
from .textnp import BYTE, LOWER, U, chunks, column, mix, ngrams, prefix, spans, words

SHINGLE = 5
THRESHOLD = (80, 100)
#: Times a shingle was seen from which its list counts as long, members of a list that are paired, and of a chunk.
LONG, PAIRED, MEMBERS = 64, 48, 1024
#: Ordered shingles held in memory by every task; with more, those seen least go by hash.
ORDERED = 1 << 20
#: Shingles gathered before a task counts repeats, and prefix shingles of one block.
GATHER, BLOCK = 4_000_000, 500_000


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased; fewer than n words make one shingle."""
    for _, _, data, offs in chunks(texts):
        starts, ends, count = words(data, offs)
        h = spans(prefix(BYTE[LOWER[data]]), starts, ends)
        grams, at = ngrams(h, n), 0
        for c in count.tolist():
            if c >= n:
                yield np.unique(grams[at : at + c - n + 1])
            else:
                yield ngrams(h[at : at + c], c)[:1] if c else np.zeros(0, U)
            at += c


def set_id(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    a = mix(s + U(0x9E3779B97F4A7C15)).sum(dtype=U) + U(len(s))
    b = mix(s ^ U(0xD6E8FEB86659FD93)).sum(dtype=U)
    return np.array([a, b], ">u8").tobytes()


def in_common(n):
    """How many prefix shingles a set of n must share with another; the smaller number of the two sets counts."""
    return 1 + n // 50


def prefix_sizes(n: int, num: int, den: int) -> tuple[int, int]:
    """Prefix length of a set of n, and the one that is enough if the other set is no smaller.

    Sets that link share a * (num + den) >= num * (sum of sizes) shingles, so each lacks no more than its size less a; of
    the first (size - a + k) of each, k at least are in both.
    """
    k = in_common(n)
    return min(n, n - -(-num * n // den) + k), min(n, n - -(-2 * num * n // (num + den)) + k)


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (doc_id, size, gid) of every document; kind 1: (shingle, times) of what a task saw in several sets."""

    def repeats(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(parts), return_counts=True)
        tokens, times = tokens[times > 1], times[times > 1]
        k = len(tokens)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, np.int32)), pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(k, pa.binary())], names=names
        )

    names = ["kind", "id", "size", "gid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held = set(), [], 0
        for batch in batches:
            sizes, gids = [], []
            for s in shingle_sets(column(batch, "text"), n):
                gid = set_id(s) if len(s) else None
                sizes.append(len(s))
                gids.append(gid)
                if gid is not None and gid not in seen:
                    seen.add(gid)
                    parts.append(s)
                    held += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), column(batch, "doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(gids, pa.binary())], names=names)
            if held >= GATHER:
                yield repeats(parts)
                seen, parts, held = set(), [], 0
        if held:
            yield repeats(parts)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, id long, size long, gid binary")


def _order(repeats: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` shingles seen most often, sorted, and how often each was seen."""
    seen = repeats.groupBy("id").agg(F.sum("size").alias("times")).where("times >= 4")
    by_log = sorted(((r.k, r.n) for r in seen.groupBy(F.floor(F.log2("times")).alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 64, 0
    for k, count in by_log:
        if total + count > limit:
            break
        least, total = k, total + count
    got = seen.where(F.col("times") >= 2**least).toArrow() if total else None
    if got is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    tokens, times = got["id"].to_numpy().view(U), got["times"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def _postings(docs: DataFrame, n: int, ratio: tuple[int, int], order, blocks: int, long: int) -> DataFrame:
    """Prefix shingles of all groups dealt to blocks, a row for each block and task.

    grps, sizes, counts: the groups in this block, their set sizes and how many shingles they have here; toks, flags: these
    shingles (what their block doesn't tell of them, 32 bits) and whether the short prefix has them; hot_toks, hot_grps:
    shingles known to have long lists, spread over all blocks; map_gid, map_grp: classes and their groups. 8 bytes stand
    for a group: should two share them, both are candidates.
    """
    num, den = ratio
    shared = docs.sparkSession.sparkContext.broadcast(order)
    names = ["block", "grps", "sizes", "counts", "toks", "flags", "hot_toks", "hot_grps", "map_gid", "map_grp"]

    def flush(toks, owner, flags, gids, grps, sizes) -> pa.RecordBatch:
        rows = []
        tok, own, flag = np.concatenate(toks), np.repeat(np.arange(len(gids)), owner), np.concatenate(flags)
        gid, grp, size = np.frombuffer(b"".join(gids), "V16"), np.array(grps, U), np.array(sizes, np.int32)
        hot = flag >= 2
        hot_tok, hot_grp = tok[hot], grp[own[hot]]
        key, own, flag = mix(tok[~hot] ^ U(0xA5A5A5A5A5A5A5A5)), own[~hot], flag[~hot]
        short = (key // U(blocks)).astype(np.uint32)

        def dealt(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.argsort(block, kind="stable")
            return by, np.searchsorted(block[by], np.arange(blocks + 1, dtype=U))

        cold, cuts = dealt(key % U(blocks))
        home, home_cuts = dealt(grp % U(blocks))
        warm, warm_cuts = dealt(mix(hot_tok + hot_grp) % U(blocks))
        for b in range(blocks):
            at, mine, w = cold[cuts[b] : cuts[b + 1]], home[home_cuts[b] : home_cuts[b + 1]], warm[warm_cuts[b] : warm_cuts[b + 1]]
            if len(at) or len(mine) or len(w):
                used, count = np.unique(own[at], return_counts=True)
                cells = (grp[used], size[used], count.astype(np.uint32), short[at], flag[at], hot_tok[w], hot_grp[w], gid[mine], grp[mine])
                rows.append((b, *(c.tobytes() for c in cells)))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, times = shared.value
        state, seen, held = ([], [], [], [], [], []), set(), 0
        for batch in batches:
            for s in shingle_sets(column(batch, "text"), n):
                size = len(s)
                p, q = prefix_sizes(size, num, den)
                if size * (den - num) < num or (gid := set_id(s)) in seen:
                    continue  # one shingle less is too few already, so only equal sets link
                seen.add(gid)
                at = np.minimum(np.searchsorted(heavy, s), max(len(heavy) - 1, 0))
                is_heavy = heavy[at] == s if len(heavy) else np.zeros(size, bool)
                flag = np.zeros(p, np.uint8)
                if is_heavy.any():
                    light, rest, often = s[~is_heavy], s[is_heavy], times[at[is_heavy]]
                    by = np.lexsort((rest, often))
                    first = np.concatenate([light, rest[by]])[:p]
                    flag[len(light) :] = 2 * (often[by][: max(p - len(light), 0)] >= long)
                else:
                    first = s[:p]
                flag[:q] |= 1
                grp = int.from_bytes(set_id(np.append(np.sort(first), U(size)))[:8], "big")
                for part, value in zip(state, (first, p, flag, gid, grp, size), strict=True):
                    part.append(value)
                held += p
            if held >= GATHER // 4:
                yield flush(*state)
                state, seen, held = ([], [], [], [], [], []), set(), 0
        if held:
            yield flush(*state)

    return docs.select("text").mapInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in names[1:]))


def _meet(ratio: tuple[int, int], paired: int):
    """Of a block: kind 0, two groups that may link; kind 1, a shingle with a long list and one of its groups; kind 2, a group and a class in it."""
    num, den = ratio

    def run(block: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(block[c].to_pylist()), kind)
        grps, first, one = np.unique(join("grps", U), return_index=True, return_inverse=True)
        size = join("sizes", np.int32)[first].astype(np.int64)
        own, tok, flag = np.repeat(one, join("counts", np.uint32)), join("toks", np.uint32), join("flags", np.uint8)
        order = np.lexsort((own, tok))
        tok, own, flag = tok[order], own[order], flag[order]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])  # what several tasks sent of one group
        tok, own, flag = tok[keep], own[keep], flag[keep]
        starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
        length = np.diff(np.append(starts, len(tok)))
        pairs, width = [], max(len(grps), 1)
        for m in np.unique(length[(length > 1) & (length <= paired)]).tolist():
            at = starts[length == m]
            i, j = np.triu_indices(m, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            swap = size[own[a]] > size[own[b]]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            good = (size[own[a]] * den >= num * size[own[b]]) & (flag[a] & 1 > 0)
            pairs.append(own[a[good]] * width + own[b[good]])
        pairs, shared = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        lengthy = np.repeat(length > paired, length)
        number = int(block["block"][0].as_py())
        shingle = np.concatenate([join("hot_toks", U), tok[lengthy].astype(U) + (U(number) << U(32))])
        listed = np.concatenate([join("hot_grps", U), grps[own[lengthy]]])
        members = join("map_grp", U)
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(pairs), len(listed), len(members)])
        gid = pa.concat_arrays([pa.nulls(len(pairs) + len(listed), pa.binary()), pa.array(_cut(b"".join(block["map_gid"].to_pylist())), pa.binary())])
        a = np.concatenate([grps[pairs // width], shingle, members]).view(np.int64)
        b = np.concatenate([grps[pairs % width], listed, members]).view(np.int64)
        n_shared, need = np.zeros(len(kinds), np.int32), np.zeros(len(kinds), np.int32)
        n_shared[: len(pairs)], need[: len(pairs)] = shared, in_common(np.minimum(size[pairs // width], size[pairs % width]))
        return pa.table({"kind": kinds, "a": a, "b": b, "gid": gid, "shared": n_shared, "need": need})

    return run


def _cut(x: bytes) -> list[bytes]:
    return [x[i : i + 16] for i in range(0, len(x), 16)]


class _Verifier:
    """Compares the members of one chunk; ``roots`` joins those that link."""

    def __init__(self, ids: list[bytes], sets: list[np.ndarray], ratio: tuple[int, int]) -> None:
        self.ids, self.sets, self.ratio, self.root = ids, sets, ratio, list(range(len(ids)))
        self.links: list[tuple[bytes, bytes]] = []
        self.sizes = np.array([len(s) for s in sets], np.int64)
        if len(ids) > 8:
            everything = np.concatenate(sets)
            owner = np.repeat(np.arange(len(ids)), self.sizes)
            order = np.argsort(everything, kind="stable")
            self.tokens, first = np.unique(everything[order], return_index=True)
            self.owner, self.first = owner[order], np.append(first, len(order))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def linked(self, i: int) -> np.ndarray:
        """Members whose set links with that of member i."""
        if len(self.ids) > 8:
            at = np.searchsorted(self.tokens, self.sets[i])
            lists = [self.owner[a:b] for a, b in zip(self.first[at].tolist(), self.first[at + 1].tolist(), strict=True)]
            shared = np.bincount(np.concatenate(lists), minlength=len(self.ids))
        else:
            shared = np.array([len(np.intersect1d(self.sets[i], s, assume_unique=True)) for s in self.sets])
        num, den = self.ratio
        return np.flatnonzero(den * shared >= num * (self.sizes[i] + self.sizes - shared))

    def join(self, i: int) -> None:
        for j in self.linked(i).tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((self.ids[i], self.ids[j]))


def _verify(rows: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """rows: (centre, chunk, sub, role, gid, toks); role 0 centre, 1 member, 2 left over from another chunk.

    kind 0: a link (a, b); kind 1: member b of the gathering around ``centre`` is left over.
    """

    def group(key, members) -> Iterator[tuple]:
        unique = {}
        for role, gid, toks in members:
            if gid not in unique or role < unique[gid][0]:
                unique[gid] = (role, toks)
        order = sorted(unique, key=lambda g: (unique[g][0], g))
        v = _Verifier(order, [np.frombuffer(unique[g][1], U) for g in order], ratio)
        roles = [unique[g][0] for g in order]
        if 2 in roles:
            for i in range(roles.index(2), len(order)):
                v.join(i)
        else:
            v.join(0)
            for i in range(1, len(order)):
                if v.find(i) != 0:
                    v.join(i)
            for i in range(1, len(order)):
                if v.find(i) != 0:
                    yield 1, key[0], None, order[i]
        for a, b in v.links:
            yield 0, None, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, members = None, []

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "centre", "a", "b"])

        for batch in batches:
            for c, k, s, role, gid, toks in zip(*(column(batch, n).to_pylist() for n in ("centre", "chunk", "sub", "role", "gid", "toks")), strict=True):
                if (c, k, s) != key:
                    if len(members) > 1:
                        out.extend(group(key, members))
                    key, members = (c, k, s), []
                members.append((role, gid, toks))
            if len(out) > 50_000:
                yield packed()
                out = []
        if len(members) > 1:
            out.extend(group(key, members))
        if out:
            yield packed()

    rows = rows.repartition("centre", "chunk", "sub").sortWithinPartitions("centre", "chunk", "sub")
    return rows.select("centre", "chunk", "sub", "role", "gid", "toks").mapInArrow(run, "kind int, centre long, a binary, b binary")


def ngram_join(docs: DataFrame, n: int = SHINGLE, ratio: tuple[int, int] = THRESHOLD, long: int = LONG, paired: int = PAIRED, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    A document without words has no shingles and links with nothing. component_id is the smallest doc_id that links reach.
    Rows with equal texts, and rows that repeat a doc_id, each are documents; null ids are passed over for component_id.
    Other columns are ignored, whatever their names; a very long text is worked on whole; an empty table gives no rows. No
    list, group or chunk is cut short.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram_join")
    num, den = ratio
    survey = ws.write(_survey(docs, n), "survey")
    keys = survey.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "gid")
    total = keys.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(8, -(-total * (den - num) // den // BLOCK))
    order = _order(survey.where("kind = 1"), ORDERED)
    met = _postings(docs, n, ratio, order, blocks, long).groupBy("block").applyInArrow(_meet(ratio, paired), "kind int, a long, b long, gid binary, shared int, need int")
    met = ws.write(met, "met")
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
    lists = met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("grp")).distinct()
    expand = met.where("kind = 2").select("gid", F.col("b").alias("grp")).distinct()
    often = lists.groupBy("grp").agg(F.count("*").alias("often"))
    centre = lists.join(often, "grp").groupBy("shingle").agg(F.max(F.struct("often", "grp")).alias("top"))
    gathered = lists.join(centre.select("shingle", F.col("top.grp").alias("centre")), "shingle").select(F.col("centre").alias("a"), F.col("grp").alias("b"))
    meets = ws.write(pairs.unionByName(gathered).distinct(), "meets")

    # Groups that meet, directly or not, sit together if they are few; else around each group that others meet.
    parts = components(meets, ws).select(F.col("node").alias("grp"), "root")
    parts = parts.unionByName(parts.select(F.col("root").alias("grp"), "root").distinct())
    seated = expand.join(small(ws.write(parts, "parts")), "grp", "left").withColumn("root", F.coalesce("root", "grp"))
    seated = ws.write(seated, "seated")
    count = seated.groupBy("root").agg(F.count("*").alias("k")).where("k > 1")
    count = ws.write(count, "count")
    together = seated.join(small(count.where(F.col("k") <= members).select("root")), "root").select(F.col("root").alias("centre"), "gid", F.lit(False).alias("own"))
    crowd = seated.join(small(count.where(F.col("k") > members).select("root")), "root").select("grp", "gid")
    seats = together
    if not crowd.isEmpty():
        ends = meets.join(small(crowd.select(F.col("grp").alias("a")).distinct()), "a", "left_semi")
        around = ends.select(F.col("a").alias("centre"), F.explode(F.array("a", "b")).alias("grp"))
        around = around.unionByName(crowd.select(F.col("grp").alias("centre"), "grp")).distinct()
        around = around.join(crowd, "grp").select("centre", "gid", (F.col("centre") == F.col("grp")).alias("own"))
        alone = around.groupBy("centre").agg(F.count("*").alias("k")).where("k > 1").select("centre")
        seats = together.unionByName(around.join(alone, "centre", "left_semi"))
    seats = ws.write(seats, "seats")

    classes = ws.write(keys.where("gid is not null").groupBy("gid").agg(F.min("doc_id").alias("doc_id")), "classes")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, fits, toks = column(batch, "gid").to_pylist(), [], []
            for i, s in enumerate(shingle_sets(column(batch, "text"), n)):
                if len(s) and set_id(s) == want[i]:  # another row may have the same doc_id
                    fits.append(i)
                    toks.append(s.tobytes())
            kept = [column(batch, c).take(pa.array(fits, pa.int64())) for c in ("centre", "chunk", "sub", "role", "gid")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(toks, pa.binary())], names=["centre", "chunk", "sub", "role", "gid", "toks"])

    def verified(rows: DataFrame, name: str) -> DataFrame:
        """Fetch the set of a document of each class in ``rows`` and verify."""
        rows = rows.select("centre", "chunk", "sub", "role", "gid").join(classes.select("gid", F.col("doc_id").alias("id")), "gid")
        rows = ws.write(rows, f"{name}_seats")
        texts = docs.select("doc_id", "text").join(small(rows), F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "centre", "chunk", "sub", "role", "gid")
        return ws.write(_verify(texts.mapInArrow(take, "centre long, chunk int, sub int, role int, gid binary, toks binary"), ratio), name)

    # Chunks of a gathering; its centre, the smallest class of the centre group, sits in each of them.
    head = F.min(F.when(F.col("own"), F.col("gid")))
    size = seats.groupBy("centre").agg(F.ceil(F.count("*") / members).cast("int").alias("k"), F.coalesce(head, F.min("gid")).alias("head"))
    seated = seats.join(size, "centre").withColumn("role", F.when(F.col("gid") == F.col("head"), 0).otherwise(1))
    everywhere = F.sequence(F.lit(0), F.col("k") - 1)
    part = F.pmod(F.xxhash64("gid"), F.col("k")).cast("int")
    seated = seated.withColumn("chunk", F.explode(F.when(F.col("role") == 0, everywhere).otherwise(F.array(part)))).withColumn("sub", F.lit(0))
    found = verified(seated, "found")
    links = found.where("kind = 0").select("a", "b")

    over = found.where("kind = 1").select("centre", F.col("b").alias("gid")).join(size.where("k > 1"), "centre").distinct()
    if not over.isEmpty():
        over = ws.write(over, "over")
        subs = over.groupBy("centre").agg(F.ceil(F.count("*") / members).cast("int").alias("subs"))
        left = over.join(subs, "centre").withColumn("sub", F.pmod(F.xxhash64("gid", F.lit(1)), F.col("subs")).cast("int")).withColumn("chunk", F.explode(everywhere)).withColumn("role", F.lit(2))
        rest = seated.where("role = 1 and k > 1").drop("sub").join(subs, "centre").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        cells = left.select("centre", "chunk", "sub", "role", "gid").unionByName(rest.select("centre", "chunk", "sub", "role", "gid"))
        links = links.unionByName(verified(cells, "more").where("kind = 0").select("a", "b"))
    roots = components(links, ws)
    ws.drop("met")
    named = classes.join(roots, F.col("gid") == F.col("node"), "left").select("gid", "doc_id", F.coalesce("root", "gid").alias("root"))
    least = named.where("root <> gid").groupBy("root").agg(F.min("doc_id").alias("other")).withColumnRenamed("root", "r")
    named = named.join(least, F.col("root") == F.col("r"), "left")
    # The root's own smallest id counts as well; it comes from the class table.
    own = classes.select(F.col("gid").alias("g"), F.col("doc_id").alias("root_id"))
    named = named.where("r is not null").join(own, F.col("root") == F.col("g")).select(F.col("gid").alias("of"), F.least("other", "root_id").alias("component"))
    named = ws.write(named, "named")
    out = keys.join(classes.withColumnRenamed("doc_id", "class_id").withColumnRenamed("gid", "cg"), F.col("gid") == F.col("cg"), "left")
    out = out.join(small(named), F.col("gid") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) AS p WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT s, y FROM reach JOIN both_ways ON t = x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(t) FROM reach WHERE s = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
