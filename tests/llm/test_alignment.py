"""Alignment of two tokenizers against a plain one: bytes by ranges, groups by common ends, links by overlap."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment
from tests.conftest import SF

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b"), (5, "x▁y z"), (6, "<|endoftext|> a <s> <0x41>"), (7, "日本 語 　 と é à ñ x  y"), (8, "a" * 5000), (9, "a\n b\t c \r\n"),
    (10, "it's we'll 12 3 ½ 😀 😀x"), (11, "\x00\x01 a"), (None, "the cat"), (12, "the cat"), (12, "the cat"), (13, "ﬁ ① Ａ"), (14, " lead"), (15, "trail "), (16, "a ▁ b"), (17, "the é " * 4000),
]


def ranges(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(sizes[i]), i))
        at += len(sizes[i])
    return out


def brute(rows):
    both = alignment.pair_of(*alignment.vocabularies())
    per, number = [], collections.Counter()
    for d, text in rows:
        got = both.encode(b" " + text.encode()) if text else None
        a, b = (ranges(*x) for x in zip(got, (both.bytes_a, both.bytes_b))) if got else ([], [])
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            k, m = (sum(1 for _ in filter(lambda t: t[1] <= end, x[at : at + 5000])) for x, at in ((a, i), (b, j)))
            groups.append((a[i : i + k], b[j : j + m]))
            i, j = i + k, j + m
        links = [(x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1]]
        number.update(links)
        per.append((d, a, b, groups, links))
    top = collections.Counter()
    for (_, b), n in number.items():
        top[b] = max(top[b], n)
    out = collections.Counter()
    for d, a, b, groups, links in per:
        said = ";".join(",".join(str(t[2]) for t in g[0]) + "|" + ",".join(str(t[2]) for t in g[1]) for g in groups)
        out[d, len(a), len(b), len(groups), len(links), sum(number[p] == top[p[1]] for p in links), sum(number[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""] += 1
    return out


def rows_of(df):
    return collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("held", [1 << 25, 0])
def test_alignment_of_short_documents(spark, held, monkeypatch):
    monkeypatch.setattr(alignment, "FRAGMENTS", 500)  # many blocks
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 1500)
    assert rows_of(alignment.align(docs, *alignment.vocabularies(), held=held)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("block", F.lit(1))
    got = alignment.align(docs, *alignment.vocabularies(), with_groups=True)
    assert rows_of(got) == brute(ODD) == rows_of(alignment.align(docs, *alignment.vocabularies(), held=0))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.groups else not r.groups_sha256 for r in got.collect())
    assert alignment.align(docs.limit(0), *alignment.vocabularies()).count() == 0


def test_pairs_are_counted_over_all_blocks(spark):
    docs = spark.createDataFrame([(i, "the cat sat") for i in range(40)], "doc_id long, text string").repartition(4)
    both = alignment.pair_of(*alignment.vocabularies())
    pairs = alignment.pair_counts(alignment.blocks(docs, *alignment.vocabularies()), len(both.bytes_b)).collect()
    assert {r.n for r in pairs} == {40} and all(r.best for r in pairs)
