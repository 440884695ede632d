"""The cleaning step against a pass over shuffled records."""

import collections
import hashlib

from millrace.operators import quality, rules
from millrace.plans import scenes

from .conftest import SF


def test_cleaned_records_are_the_sequential_pass(spark):
    from pyspark.sql import functions as F

    rows = scenes._filed(spark, SF)[0].withColumn("source", F.when(F.col("k") % 47 == 0, "").otherwise("coco"))
    rows = rows.withColumn("reason", quality.first_reason(rules.cleaning_rules(low_confidence=["red"]))).collect()
    rows.sort(key=lambda r: (hashlib.md5(f"clean|{r.k}".encode()).hexdigest(), r.k))
    used, reasons, kept = collections.Counter(), collections.Counter(), set()
    for r in rows:
        if r.reason:
            reasons[r.reason] += 1
        elif used["p", r.positive] >= 9:
            reasons["positive_cap"] += 1
        elif used["n", r.negative] >= 7:
            reasons["negative_cap"] += 1
        else:
            kept.add(r.k)
            used.update([("p", r.positive), ("n", r.negative)])
    got = scenes.cleaned_records(spark, SF).collect()
    assert {r.k for r in got if r.k is not None} == kept and kept
    assert {r.reason: r.n for r in got if r.k is None} == dict(reasons)
    assert reasons["positive_cap"] and reasons["negative_cap"]
