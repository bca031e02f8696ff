"""The mixing query counts in the mix itself."""

import re
from collections import Counter

from conftest import SF

from tidyspark.llm import mixing
from tidyspark.llm.queries import QUERIES


def test_mixing_counts_the_sorted_mix(spark):
    query = QUERIES["op2_mixing"](spark, SF)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Sort \[\S*position", plan) and "RepartitionByExpression" in plan and "regexp_extract_all" in plan
    rows = [(1, "a b\tc d", "s"), (1, "a b\tc d", "s"), (None, "e f", "s"), (2, None, "s"), (3, "g h i", None), (4, "j  k\nl m n o p", "t")]
    docs = spark.createDataFrame(rows * 20, "doc_id long, text string, source string")
    made, mixed = mixing.mix(docs)
    got, want, words = mixed.collect(), {r.row: r for r in made.collect()}, Counter()
    assert [r.position for r in got] == sorted(r.position for r in got)
    for r in got:
        words[r.row] += len(r.doc.text.split())
    assert words == Counter({k: r.taken for k, r in want.items() if r.taken})
