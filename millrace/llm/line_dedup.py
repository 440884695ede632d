"""Removal of runs of lines that repeat across the corpus, by content-defined chunks.

A rolling hash over the hashes of two neighbouring lines decides whether a chunk ends between them, so the same lines
are cut the same way wherever they stand, and an inserted line shifts no other boundary. Chunks of several lines whose
hash occurs more than once in the corpus are compared byte by byte; all but the first of each are removed.

Chunks miss the outer edges of what repeats, and passages of one line. ``line_runs`` finds every repeated run of lines of
so many words instead: of each line it takes the shortest run of that size that begins with it, and the shortest that
ends with it, so a passage is covered by runs that lie within it, whatever stands around it.

Only DataFrame functions run here. Chunks are cut within a row; what is shuffled are hashes, then the text of repeated
chunks, then that of documents that lose some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, Workspace, small, table

#: One in so many places between lines ends a chunk; lines a chunk needs to be removed.
DIVISOR, MIN_LINES = 3, 2
#: Words of a run of lines that is removed where it repeats.
RUN_WORDS = 50


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cuts(text: Column, divisor: int) -> Column:
    """The lines of a text, and the numbers (from 1) of those that begin a chunk."""
    lines = F.split(text, "\n", -1)

    def starts(x: Column) -> Column:
        ends = lambda i: (F.element_at(x["m"], i) + 31 * F.element_at(x["m"], i - 1)) % divisor == 0
        return F.filter(F.sequence(F.lit(1), F.size(x["m"])), lambda i: F.when(i == 1, F.lit(True)).otherwise(ends(i)))

    both = F.struct(lines.alias("lines"), F.transform(lines, _line_hash).alias("m"))
    return _bound(both, lambda x: F.struct(x["lines"].alias("lines"), starts(x).alias("starts")))


def line_chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """The chunks of a text as an array; joined by line feeds they give the text."""

    def parts(x: Column) -> Column:
        after = F.concat(F.slice(x["starts"], F.lit(2), F.size(x["starts"])), F.array(F.size(x["lines"]) + 1))
        return F.zip_with(x["starts"], after, lambda a, b: F.array_join(F.slice(x["lines"], a, b - a), "\n"))

    return _bound(_cuts(text, divisor), parts)


def _n_lines(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """Remove repeated chunks of ``min_lines`` lines or more that hold anything but white space.

    The first chunk of equal ones, by doc_id (null last) and place, stays. A null text is empty; an empty text has no
    lines. Rows that repeat both doc_id and text are one document and all keep what it keeps. A text of any length is
    worked on whole; an empty table gives no rows; other columns aren't read, whatever their names. Returns doc_id,
    n_lines, n_chunks, n_removed_chunks, n_removed_lines and kept_text for every row.
    """
    ws = Workspace(docs.sparkSession, "line_dedup")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("body"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit("2"), text, "doc_id").alias("k2"))
    chunks = rows.select("doc_id", "k1", "k2", F.posexplode(line_chunks(F.col("body"), divisor)).alias("place", "chunk"))
    chunks = chunks.where((_n_lines(F.col("chunk")) >= min_lines) & (F.trim(F.regexp_replace("chunk", r"[\x20\x09-\x0D]+", " ")) != ""))
    chunks = chunks.withColumn("c1", F.xxhash64("chunk")).withColumn("c2", F.xxhash64(F.lit("2"), "chunk"))

    cuts = ws.write(chunks.drop("chunk"), "cuts")
    hashes = cuts.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
    hashes = ws.write(hashes, "hashes")
    # Equal hashes aren't enough: texts are compared, combined in each task before they are shuffled.
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "place", "k1", "k2")
    first = chunks.join(small(hashes), ["c1", "c2"]).groupBy("c1", "c2", "chunk").agg(F.min(order).alias("first"))
    first = ws.write(first.select("c1", "c2", F.col("chunk").alias("same"), "first"), "first")
    clash = ws.write(first.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"), "clash")
    own = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("place") == F.col("first.place"))
    clashes = not clash.isEmpty()
    sole = first.join(clash, ["c1", "c2"], "left_anti") if clashes else first
    gone = cuts.join(sole.select("c1", "c2", "first"), ["c1", "c2"]).where(~own).select("k1", "k2", "place")
    if clashes:  # different chunks with both hashes alike
        told = chunks.join(first.join(clash, ["c1", "c2"]), ["c1", "c2"]).where((F.col("chunk") == F.col("same")) & ~own)
        gone = gone.unionByName(told.select("k1", "k2", "place"))
    gone = ws.write(gone.groupBy("k1", "k2").agg(F.collect_set("place").alias("gone")), "gone")

    n_lines = F.when(F.col("body") == "", 0).otherwise(_n_lines(F.col("body"))).cast("long")
    keys = small(gone.select(F.col("k1").alias("u1"), F.col("k2").alias("u2")))
    on = (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2"))
    zero = F.lit(0).cast("long")
    n_chunks = F.when(F.col("body") == "", 0).otherwise(F.size(_cuts(F.col("body"), divisor)["starts"])).cast("long")
    whole = rows.join(keys, on, "left_anti").select("doc_id", n_lines.alias("n_lines"), n_chunks.alias("n_chunks"), zero.alias("n_removed_chunks"), zero.alias("n_removed_lines"), F.col("body").alias("kept_text"))
    touched = rows.join(keys, on, "left_semi").join(gone, ["k1", "k2"])
    kept = F.filter(F.transform(line_chunks(F.col("body"), divisor), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda s: ~F.array_contains(F.col("gone"), s["i"]))
    touched = touched.withColumn("kept", F.transform(kept, lambda s: s["c"]))
    kept_text = F.array_join("kept", "\n")
    kept_lines = F.when(F.size("kept") == 0, 0).otherwise(_n_lines(kept_text)).cast("long")
    n_gone = F.size("gone").cast("long")
    touched = touched.select("doc_id", n_lines.alias("n_lines"), (F.size("kept") + n_gone).cast("long").alias("n_chunks"), n_gone.alias("n_removed_chunks"), (n_lines - kept_lines).alias("n_removed_lines"), kept_text.alias("kept_text"))
    return touched.unionByName(whole)


def _runs(text: Column, words: int) -> Column:
    """Array of (a, b, chunk): the shortest runs of ``words`` words from each line on and up to each line, blank lines left out."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))

    def taken(some: Column) -> Column:
        """How many lines it takes from the first on; null if there are too few words."""
        more = lambda t, x: F.when(t["w"] >= words, t).otherwise(F.struct((t["w"] + x["w"]).alias("w"), (t["n"] + 1).alias("n")))
        return F.aggregate(some, none, more, lambda t: F.when(t["w"] >= words, t["n"]))

    def of(real: Column) -> Column:
        def pair(i: Column) -> Column:  # i counts from 1; every line has a word, so a run has at most ``words`` lines
            low = F.greatest(i - words + 1, F.lit(1))
            on, back = taken(F.slice(real, i, words)), taken(F.reverse(F.slice(real, low, i - low + 1)))
            return F.array(F.struct(i.alias("p"), on.alias("n")), F.struct((i - back + 1).alias("p"), back.alias("n")))

        places = F.when(F.size(real) > 0, F.sequence(F.lit(1), F.size(real))).otherwise(F.array().cast("array<int>"))
        found = F.array_distinct(F.filter(F.flatten(F.transform(places, pair)), lambda r: r["n"].isNotNull()))
        text = lambda r: F.array_join(F.transform(F.slice(real, r["p"], r["n"]), lambda x: x["line"]), "\n")
        end = lambda at: F.element_at(real, at)["i"]
        return F.transform(found, lambda r: F.struct(end(r["p"]).alias("a"), end(r["p"] + r["n"] - 1).alias("b"), text(r).alias("chunk")))

    # An array of one element binds a value that is used for each line.
    return F.element_at(F.transform(F.array(F.filter(lines, lambda x: x["w"] > 0)), of), 1)


def line_runs(docs: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """Remove the lines of every run of lines of ``words`` words or more that stands earlier too, here or in another text.

    Runs are compared byte by byte, blank lines left out; blank lines within a removed run go with it. Earlier is by
    doc_id (null last) and line, so of each line the first occurrence stays. A null text is empty; an empty text has no
    lines. Rows that repeat both doc_id and text are one document. A text of any length is worked on whole; an empty table
    gives no rows; other columns aren't read, whatever their names. Returns doc_id, n_lines, n_removed_lines and kept_text.
    """
    ws = Workspace(docs.sparkSession, "line_runs")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("body"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit("2"), text, "doc_id").alias("k2"))
    runs = rows.select("doc_id", "k1", "k2", F.inline(_runs(F.col("body"), words)))
    runs = runs.withColumn("c1", F.xxhash64("chunk")).withColumn("c2", F.xxhash64(F.lit("2"), "chunk"))

    cuts = ws.write(runs.drop("chunk"), "cuts")
    hashes = ws.write(cuts.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"), "hashes")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "a", "b", "k1", "k2")
    first = runs.join(small(hashes), ["c1", "c2"]).groupBy("c1", "c2", "chunk").agg(F.min(order).alias("first"))
    first = ws.write(first.select("c1", "c2", F.col("chunk").alias("same"), "first"), "first")
    clash = ws.write(first.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"), "clash")
    clashes = not clash.isEmpty()
    sole = first.join(clash, ["c1", "c2"], "left_anti") if clashes else first
    gone = cuts.join(sole.select("c1", "c2", "first"), ["c1", "c2"])
    if clashes:  # different runs with both hashes alike
        told = runs.join(first.join(clash, ["c1", "c2"]), ["c1", "c2"]).where(F.col("chunk") == F.col("same"))
        gone = gone.unionByName(told.select(*gone.columns))
    own = F.lit(True)
    for c in ("k1", "k2", "a", "b"):
        own &= F.col(c) == F.col(f"first.{c}")
    gone = gone.where(~own).select("k1", "k2", F.explode(F.sequence("a", "b")).alias("place"))
    gone = ws.write(gone.groupBy("k1", "k2").agg(F.collect_set("place").alias("gone")), "gone")

    n_lines = F.when(F.col("body") == "", 0).otherwise(_n_lines(F.col("body"))).cast("long")
    keys = small(gone.select(F.col("k1").alias("u1"), F.col("k2").alias("u2")))
    on = (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2"))
    whole = rows.join(keys, on, "left_anti").select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"), F.col("body").alias("kept_text"))
    stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "gone"), lambda i: F.get(ls, i))
    kept = F.element_at(F.transform(F.array(F.split("body", "\n", -1)), stay), 1)
    touched = rows.join(keys, on, "left_semi").join(gone, ["k1", "k2"])
    touched = touched.select("doc_id", n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_removed_lines"), F.array_join(kept, "\n").alias("kept_text"))
    return touched.unionByName(whole)


def op7_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op7_line_runs(spark, sf_dir):
    out = line_runs(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS m FROM l),
c0 AS (
  SELECT *, CASE WHEN (m + 31 * lag(m) OVER w) % 3 = 0 THEN 1 ELSE 0 END AS cut FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM c0),
c AS (SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c1 GROUP BY doc_id, place),
r AS (
  SELECT *, n >= 2 AND regexp_matches(chunk, '[^\x20\x09-\x0D]')
              AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, place) > 1 AS gone FROM c),
k AS (
  SELECT doc_id, count(*) AS n_chunks, sum(gone::INT) AS n_removed_chunks, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed_lines,
         coalesce(string_agg(CASE WHEN NOT gone THEN chunk END, chr(10) ORDER BY place), '') AS kept
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines,
       CASE WHEN t = '' THEN 0 ELSE n_chunks END AS n_chunks, CAST(n_removed_chunks AS BIGINT) AS n_removed_chunks,
       CAST(n_removed_lines AS BIGINT) AS n_removed_lines, sha256(kept) AS kept_sha256
FROM d JOIN k USING (doc_id)
"""

RUNS_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
n AS (
  SELECT *, row_number() OVER v AS p, sum(w) OVER v AS s FROM w WHERE w > 0 WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
j AS (
  SELECT x.doc_id, x.p AS a, y.p AS b FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.p BETWEEN x.p AND x.p + 49 AND y.s - x.s + x.w >= 50),
u AS (SELECT doc_id, a, min(b) AS b FROM j GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM j GROUP BY doc_id, b),
c AS (
  SELECT u.doc_id, a, b, min(i) AS i1, max(i) AS i2, string_agg(line, chr(10) ORDER BY p) AS chunk
  FROM u JOIN n ON u.doc_id = n.doc_id AND p BETWEEN a AND b GROUP BY u.doc_id, a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a, b) > 1 AS gone FROM c),
g AS (SELECT DISTINCT doc_id, unnest(range(i1, i2 + 1)) AS i FROM r WHERE gone),
k AS (
  SELECT l.doc_id, count(g.i) AS n_removed_lines, coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines, n_removed_lines, sha256(kept) AS kept_sha256
FROM d JOIN k USING (doc_id)
"""
