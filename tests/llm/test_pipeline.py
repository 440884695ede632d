"""Every stage against what it should do to its own input."""

import collections
import re

import corpus_pipeline
import __spark_entry__ as entry
from millrace.llm import mixing, quality
from pyspark.sql import functions as F
from tests.conftest import SF

from .test_models import check_packing


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_failed(text):
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    inside = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    return len(words) < 10 or 100 * len(inside) > 20 * len(words)


def exact_kept(texts):
    best = {}
    for d, t in texts.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), d))
    return {d for _, d in best.values()}


def near_kept(texts):
    sets = {}
    for d, t in sorted(texts.items()):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d for d in sets if find(d) == d}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("copies", F.lit(9))
    stages, outs = dict(corpus_pipeline.STAGES), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], SF).write.parquet(str(tmp_path / str(k)))
        outs.append(spark.read.parquet(str(tmp_path / str(k))))
    assert list(stages) == ["quality rules", "exact dedup", "near duplicates", "mixing", "packing"]
    ids = [collections.Counter(r.doc_id for r in o.select("doc_id").collect()) for o in outs[:5]]
    assert all(o.columns == docs.columns for o in outs[:5])
    assert set(ids[1]) == {r.doc_id for r in quality.quality_rules(docs.select("doc_id", "text")).where("kept").collect()}
    texts = [{r.doc_id: r.text or "" for r in o.select("doc_id", "text").collect()} for o in outs[:4]]
    assert set(ids[1]) <= {d for d, t in texts[0].items() if not base_failed(t)}
    assert set(ids[2]) == exact_kept(texts[1])
    assert set(ids[3]) == near_kept(texts[2])
    assert ids[4] == collections.Counter({r.doc_id: r.copies for r in mixing.mix(outs[3].drop("copies")).collect() if r.copies})
    check_packing([(r.doc_id, r.text) for r in outs[4].collect()], outs[5].collect(), 4096)


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert "pipeline" in entry.queries()
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "some words " * 3, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, data, SF).collect()


NAMES = ["gone_id", "n_copies", "_copy", "copy", "copy_", "stays", "mixed_id", "kept", "own_5", "own_6", "N_Words", "keep_id", "component_id", "copies", "size", "_text", "a.b", "it`s"]


def test_clashing_names_ties_and_repeated_rows(spark):
    words = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    near = words(3, 60)
    rows = [
        (1, words(1), "a"), (2, words(1) + " ", "a"), (2, words(1) + " ", "a"),  # equal; the longer row's doc_id stays, both of its rows
        (4, words(2), "b"), (5, words(2), "b"),  # a tie: the smaller doc_id
        (6, near, "b"), (7, near + " end", None), (8, words(4), None), (8, words(4), None), (None, words(5), "a"), (9, "same line\n" * 20, "a"), (10, None, "a"), (11, "", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in NAMES])
    got, want = docs, {
        "quality rules": [1, 2, 2, 4, 5, 6, 7, 8, 8, None], "exact dedup": [2, 2, 4, 6, 7, 8, 8, None], "near duplicates": [2, 2, 4, 6, 8, 8, None],
    }
    key = lambda d: (d is None, d or 0)
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, got = got, stage(spark, got, SF)
        assert got.columns == docs.columns
        held = got.collect()
        assert all(r[n] == f"{n}|{'null' if r.doc_id is None else r.doc_id}" for r in held for n in NAMES)
        if name in want:
            assert sorted((r.doc_id for r in held), key=key) == want[name]
        else:
            copies = collections.Counter()
            for r in mixing.mix(before.select("doc_id", "source", "text")).collect():
                copies[r.doc_id] = max(copies[r.doc_id], r.copies)
            assert collections.Counter(r.doc_id for r in held) == collections.Counter({d: n * (2 if d in (2, 8) else 1) for d, n in copies.items() if n})
    last = corpus_pipeline.STAGES[4][1](spark, got, SF).collect()
    assert collections.Counter(r.doc_id for r in last) == collections.Counter(r.doc_id for r in held)
