"""Ranges for every kind of id, and the digests that peeling recovers."""

import pytest
from pyspark.sql import functions as F

from tidyspark.llm import fingerprints


def _next(df):
    return [(r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(df).collect()]


@pytest.mark.parametrize("kind", ["outlier", "string", "repeated", "null"])
def test_next_of_any_ids(spark, kind, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 64)
    n = 120
    ids = {"outlier": [*range(n - 1), 2**60], "string": [f"id-{i * 7919 % n}" for i in range(n)], "repeated": [5] * 60 + list(range(60)), "null": [None] * 60 + list(range(60))}[kind]
    data = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(data, f"doc_id {'string' if kind == 'string' else 'long'}, text string").withColumns({"range": F.lit("x"), "a": F.lit(1), "key": F.lit(2)})
    got = _next(df)
    assert sorted(map(str, (g[:2] for g in got))) == sorted(map(str, data))
    # following the next documents visits every document once, ids ascending, nulls first
    after = {text: nxt for _, text, nxt in got}
    of = {text: i for i, text in data}
    order = lambda i: (i is not None, i if i is not None else 0)
    first = min((t for t in of), key=lambda t: order(of[t]))
    seen = [first]
    while len(seen) < n:
        seen.append(after[seen[-1]])
    assert len(set(seen)) == n and after[seen[-1]] == seen[0] or kind in ("repeated", "null")
    at = seen.index(next(t for t, u in after.items() if order(of[u]) < order(of[t]))) + 1
    ranks = [order(of[t]) for t in seen[at:] + seen[:at]]
    assert ranks == sorted(ranks)


def test_repeated_rows_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 16)
    df = spark.createDataFrame([(1, "same")] * 50 + [(2, "other")], "doc_id long, text string")
    got = sorted(_next(df))
    assert len(got) == 51 and sum(g[2] == "same" for g in got) == 50 and sum(g[2] == "other" for g in got) == 1


def test_peeling_recovers_the_digests(spark):
    lines = [f"line {i}" for i in range(40)]
    data = [(1, "\n".join(lines), "\n".join(lines[:-1])), (2, "\n".join(lines), "\n".join([*lines, "x", "y"])), (3, "a", "b"), (4, None, "c"), (5, "\n".join(lines), "\n".join(f"new {i}" for i in range(60))), (6, "same", "same")]
    df = spark.createDataFrame(data, "doc_id long, old string, new string")
    got = fingerprints.changes(df).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {p for _, a, b in data for x in (a, b) if x for p in x.split("\n")}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    digest = lambda text: {hashed[p] for p in (text or "").split("\n") if p}
    for r in got:
        assert set(r.removed) == digest(r.old) - digest(r.new) and set(r.added) == digest(r.new) - digest(r.old)
        assert len(r.removed) == len(set(r.removed)) and len(r.added) == len(set(r.added))
