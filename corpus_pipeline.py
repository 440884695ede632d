"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows the one before it kept. Rows that repeat a doc_id stand or fall together in the two
deduplication stages and get as many copies as the most any of them is given when mixing; a null doc_id is an id of its
own. Further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import ngram_join
from millrace.llm.packing import pack, vocabulary
from millrace.llm.quality import quality_rules
from millrace.llm.shared import Workspace, small


def _unused(df, name):
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(df):
    """The columns of ``df``, whatever characters their names have."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def _without(docs, verdicts, stays, name):
    """``docs`` less the doc_ids none of whose rows in ``verdicts`` stay."""
    ws, gone_id = Workspace(docs.sparkSession, name), _unused(docs, "gone_id")
    out = verdicts.groupBy(F.col("doc_id").alias(gone_id)).agg(F.max(stays).alias("stays")).where("not stays").select(gone_id)
    return docs.join(small(ws.write(out, "gone")), docs["doc_id"].eqNullSafe(F.col(gone_id)), "left_anti")


def quality(spark, docs, sf_dir):
    """Drop documents that the quality rules reject.

    A null or empty text is rejected, an empty table stays empty, rows that repeat a doc_id are judged each for itself, and
    columns named like the measures keep their values.
    """
    names = [c if c in ("doc_id", "text") else _unused(docs, f"own_{k}") for k, c in enumerate(docs.columns)]  # measures would replace some
    kept = quality_rules(docs.select(*[c.alias(n) for c, n in zip(_own(docs), names)])).where("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def exact(spark, docs, sf_dir):
    """Keep one document of each group of equal texts.

    Null and empty texts are one group. Rows that repeat the doc_id that stays all stay; a null doc_id is an id of its own.
    """
    return _without(docs, exact_dedup(docs.select("doc_id", "text")), F.col("kept"), "exact")


def near(spark, docs, sf_dir):
    """Keep the document with the smallest doc_id of each near-duplicate group.

    Texts without words, null ones too, are near to nothing and stay. Rows that repeat a doc_id stand or fall together.
    """
    return _without(docs, ngram_join(docs.select("doc_id", "text")), F.col("doc_id").eqNullSafe(F.col("component_id")), "near")


def mixed(spark, docs, sf_dir):
    """Repeat each document as often as the mix takes it; one it doesn't take goes.

    Texts without words have no size and are never taken. A null source is a source. Rows that repeat a doc_id get as many
    copies as the most any of them is given.
    """
    ws, mixed_id, times, copy = Workspace(spark, "mixed"), *(_unused(docs, c) for c in ("mixed_id", "n_copies", "copy"))
    copies = mix(docs.select("doc_id", "source", "text")).groupBy(F.col("doc_id").alias(mixed_id)).agg(F.max("copies").alias(times))
    copies = ws.write(copies.where(F.col(times) > 0), "copies")
    out = docs.join(small(copies), docs["doc_id"].eqNullSafe(copies[mixed_id]))
    return out.select(*_own(docs), F.explode(F.array_repeat(F.lit(0), copies[times].cast("int"))).alias(copy)).drop(copy)


def packed(spark, docs, sf_dir):
    """Pack what is left into sequences of 4096 tokens.

    A null text has its end alone; longer texts are cut; every row is packed for itself, repeated ones too.
    """
    return pack(docs.select("doc_id", "text"), vocabulary())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("mixing", mixed), ("packing", packed)]
#: The last stage needs a tokenizer, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.write(docs, f"stage{k}")
    return docs
