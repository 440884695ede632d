"""Repeated runs of lines against SQL, and passages that chunks miss."""

import random
import re

from millrace.llm import line_dedup, registry
from tests.conftest import SF


def test_line_runs_match_their_sql(spark, same):
    out = registry.QUERIES["op7_line_runs"](spark, SF)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
    same(out, registry.ORACLES["op7_line_runs"])


def test_passages_go_whatever_their_lines(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, kept = [], {}
    for k, sizes in enumerate([(55,), (30, 25), (20, 0, 15, 20), (3,) * 20, (10, 60, 4)]):
        passage = "\n".join(words(n) for n in sizes)
        for copy in range(3):
            head, tail = "\n".join(words(9) for _ in range(copy)), words(12)
            i = 10 * k + copy
            rows.append((i, head + "\n" + passage + "\n" + tail))
            kept[i] = rows[-1][1] if copy == 0 else head + "\n" + tail
    short = words(49)
    rows += [(100, short), (101, short), (102, None), (103, ""), (None, rows[0][1]), (104, "\n\n"), (105, "a\n\n" * 3)]
    kept |= {100: short, 101: short, 102: "", 103: "", None: "", 104: "\n\n", 105: "a\n\n" * 3}
    out = {r.doc_id: r for r in line_dedup.line_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.kept_text for i, r in out.items()} == kept
    assert (out[102].n_lines, out[103].n_removed_lines, out[1].n_removed_lines, out[21].n_removed_lines) == (0, 0, 1, 4)
