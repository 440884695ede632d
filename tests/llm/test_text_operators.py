"""Quality rules, n-gram join, suffix deduplication, WARC and HTML against brute force."""

import collections
import hashlib
import html
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text, ngram_join, quality, suffix_dedup, textnp, warc
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bb\tccc", None, "", " é  x ", "a bb", "a"]
    starts, hashes, counts = [], [], []
    for _, _, data, offs in textnp.chunks(pa.array(texts)):
        s, e, c = textnp.words(data, offs)
        hashes += textnp.spans(textnp.prefix(textnp.BYTE[data]), s, e).tolist()
        counts += c.tolist()
    assert counts == [3, 0, 0, 2, 2, 1]
    flat = [w for t in texts for w in WORD.findall(t or "")]
    assert len({*zip(flat, hashes, strict=True)}) == len({*flat}) == len({*hashes})
    assert starts == []


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 30_000), (4, " ".join(f"w{i}" for i in range(40))), (None, "same line here\n" * 8), (4, "#$ a")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))
    out = quality.quality_rules(docs).collect()
    got = [(r.doc_id, r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out]
    assert got == [
        (1, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, True, False), (3, 30000, 0, 0, 30000, True, False), (4, 40, 0, 0, 0, False, True),
        (None, 24, 0, 7, 24, True, False), (4, 2, 2, 0, 0, True, False),
    ]
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_quality_catches_repetition_beyond_the_base(spark):
    words = [f"w{i}" for i in range(200)]
    words[50:57] = words[100:107]  # 7 of 200 words repeat: under the base rule and all limits
    long = words + [f"longer{i}" for i in range(5)] * 2
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(w * 6 if w.startswith("longer") else w for w in long))], DOCS)
    a, b = quality.quality_rules(docs).orderBy("doc_id").collect()
    assert a.kept and not b.base_failed and not b.kept


def brute_components(rows, ratio=(80, 100)):
    def shingles(t):
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and ratio[1] * len(sets[i] & sets[j]) >= ratio[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((rows[i][0], len(sets[i]), min(least[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("limits", [{}, {"long": 4, "paired": 4, "members": 15}, {"long": 2, "paired": 2, "members": 3}])
def test_ngram_join_of_a_large_group(spark, limits):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(base[:60])
    rows += [(200 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(150)) + " " + passage) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "a b"), (303, "A  b"), (304, "a b c"), (5, rows[9][1]), (400, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, DOCS).withColumn("gid", F.lit(1)).repartition(3)
    assert sorted(map(tuple, ngram_join.ngram_join(docs, **limits).collect())) == brute_components(rows)


def test_ngram_join_small_sets_and_threshold(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        n = rng.randrange(4, 14)
        rows.append((i, " ".join(rng.choice("ab") if rng.random() < 0.2 else f"k{j}" for j in range(n))))
    assert sorted(map(tuple, ngram_join.ngram_join(spark.createDataFrame(rows, DOCS)).collect())) == brute_components(rows)
    assert ngram_join.ngram_join(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.component_id for r in ngram_join.ngram_join(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f")], DOCS)).collect()] == [7, 7]


def brute_removed(rows, length):
    count = collections.Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limits", [{"length": 40, "gram": 8}, {"length": 40, "gram": 8, "crowd": 3}, {"length": 60, "gram": 12, "batch_rows": 8}])
def test_suffix_dedup(spark, limits):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["ab", "é", "cde", "fghij", "k"]) + str(rng.randrange(50)) for _ in range(n))
    passages = [words(30) for _ in range(4)]
    rows = [(i, words(rng.randrange(60)) + " " + rng.choice([*passages, ""]) + " " + words(rng.randrange(40))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "a" * 300), (104, "b" * 90 + "a" * 35), (105, passages[0] * 2), (3, rows[3][1]), (106, "xyz" * 50)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("body", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs, **limits).collect())) == brute_removed(rows, limits["length"])


def test_suffix_dedup_passages_of_over_50_words(spark):
    """What decides is 400 bytes in common, not the number of words; n_bytes is the whole text's, whatever is removed."""
    rng = random.Random(6)
    own = lambda c: c + " ".join(f"{c}{rng.randrange(10**6)}" for _ in range(80)) + c
    rows, want = [(0, own("y")), (1, own("z"))], {0: 0, 1: 0}
    for i, (words, size) in enumerate([(51, 399), (51, 400), (60, 401), (75, 399), (52, 700)]):
        passage = " ".join(f"é{chr(65 + i)}{rng.randrange(10)}" for _ in range(words))
        passage += "é" * ((size - len(passage.encode())) // 2)
        passage += "." * (size - len(passage.encode()))
        for d, (a, b) in ((10 + 2 * i, "ab"), (11 + 2 * i, "cd")):
            rows.append((d, own(a) + passage + own(b)))
            want[d] = size if size >= 400 else 0
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in out} == want
    assert {r.doc_id: r.n_bytes for r in out} == {d: len(t.encode()) for d, t in rows}
    assert sorted(map(tuple, out)) == brute_removed(rows, 400)


def test_suffix_dedup_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + "tail"), (2, "short")], DOCS)
    out = suffix_dedup.suffix_dedup(docs, length=20, gram=8, with_kept=True).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in out] == [b"tail", b"short"]
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_positional_transform_against_all_pairs():
    rng = np.random.RandomState(0)
    for _ in range(20):
        cells = rng.randint(0, 2, (12, 9)).astype(np.uint8)
        inside = rng.rand(12, 9) > 0.05
        groups = np.sort(rng.randint(0, 3, 12))
        got = suffix_dedup.repeated_starts(groups, cells, inside, 4)
        for i in range(12):
            for a in range(6):
                same = [j for j in range(12) if j != i and groups[j] == groups[i] and inside[i, a : a + 4].all() and inside[j, a : a + 4].all() and (cells[i, a : a + 4] == cells[j, a : a + 4]).all()]
                assert got[i, a] == bool(same)


def test_warc_round_trip(spark):
    rows = [(3, "http://a/é x\r\ny", "same " * 40), (1, None, "same " * 40), (2, "u", None), (4, "u", "tiny"), (5, "u", "tiny"), (None, "u", "same " * 40), (6, "u", ""), (7, "u", "Ω" * 100_000), (1, "twice", "same " * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    from millrace.llm.shared import Workspace

    ws = Workspace(spark, "warc")
    archives = ws.write(warc.write_warc(pages, f"{ws.path}/a", roll=2000), "manifest")
    assert archives.count() > 1
    got = {(r.page_id, r.url): r for r in warc.read_warc(archives).collect()}
    assert len(got) == len(rows)
    for page, url, text in rows:
        r, raw = got[(page, url)], (text or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        first = page == 1 or len(raw) < 100 or page == 7
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", 1))
        assert (bytes(r.payload) == raw) if first else r.payload is None


def test_warc_reader_refuses_damage():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    stream = warc.member(raw) + warc.member(raw)
    assert [warc.parse(m)["page_id"] for m in warc.members(io.BytesIO(stream), block=7)] == [1, 1]
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(stream[:-5])))
    with pytest.raises(warc.WarcError):
        warc.parse(raw.replace(b"payload\r\n", b"paylaod\r\n"))
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(b"no gzip")))


def test_html_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op9_html_text(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", article))
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>one<p>two", "one\ntwo"), ("<nav><a href=x>menu</a></nav>", ""),
        ('<div id="menu"><a href=x>m</a></div><div><h1>T &amp; t</h1><p>Long enough   text\n here</p><p>And more of the text</p></div><div class="comments"><p>no!</p></div>', "T & t\nLong enough text here\nAnd more of the text"),
        ("<article><header><h1>H</h1></header><p>a <b>b</p><ul><li>x<li>y</ul><form>f</form><aside>s</aside></article><footer>f</footer>", "H\na b\nx\ny"),
        ('<main><div class="cookie-notice">c</div><p title="a>b">text</p><!-- no --><script>var a="</p>"</script></main><p>out</p>', "text"),
        ("</p></div>stray<p", "stray<p"),
    ],
)
def test_html_cases(source, want):
    assert html_text.main_text(source) == want


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<div>" * 3000 + "deep"), (1, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()) == [("", 0), ("deep", 4), ("x", 1)]
