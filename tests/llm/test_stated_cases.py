"""Very long texts, empty tables and clashing names, for operators whose own tests lack them."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, line_dedup, mixing, ngram_join, packing, quality, suffix_dedup, warc

LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000)) + "\nlast line of it\n" * 3
NAMES = ["kept", "text_", "h", "t1", "body", "size", "key", "rank", "piece", "component_id", "n_words", "copies", "block", "k1", "lines", "gid"]


def table(spark):
    rows = [(1, LONG, "a"), (2, LONG + " tail", "a"), (3, None, None), (4, "", "a"), (None, "few words here", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit("clash") for n in NAMES if n != "text_"})


OPERATORS = {
    "mix": lambda d: mixing.mix(d), "suffix": lambda d: suffix_dedup.suffix_dedup(d), "quality": lambda d: quality.quality_rules(d.select("doc_id", "text", "kept", "n_words")),
    "lines": lambda d: line_dedup.line_dedup(d), "runs": lambda d: line_dedup.line_runs(d), "exact": lambda d: exact_dedup.exact_dedup(d), "near": lambda d: ngram_join.ngram_join(d),
    "pack": lambda d: packing.pack(d, packing.vocabulary()).select("doc_id").distinct(),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_long_texts_clashing_names_and_empty_tables(spark, name):
    docs = table(spark)
    got = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    assert OPERATORS[name](docs.limit(0)).count() == 0
    if name == "near":
        assert {r.doc_id: r.component_id for r in got}[2] == 1
    if name == "suffix":
        assert {r.doc_id: r.n_removed for r in got}[1] >= len(LONG) - 2


def test_long_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", LONG), (2, "v", LONG), (3, "w", None)], "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    archives = warc.write_warc(pages, f"file://{tmp_path}/a")
    archives.write.parquet(str(tmp_path / "t"))
    got = {r.page_id: r for r in warc.read_warc(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert len(got) == 3
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/b").count() == 0
