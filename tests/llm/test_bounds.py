"""Samples are bounded, letters are letters, URL rules agree with SQL."""

import numpy as np
from conftest import SF, plain
from pyspark.sql import functions as F

from tidyspark.llm import langid, quality_model, toxicity, urls
from tidyspark.llm.common import labelled_texts
from tidyspark.llm.queries import QUERIES

RULES_SQL = r"""
with p as (select page_id, coalesce(url, '') as u from pages),
r as (select page_id, case when instr(u, '://') > 0 then substr(u, instr(u, '://') + 3) else '' end as r from p),
h as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from r),
rules(rule, says) as (values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
parts as (select rule, says, split_part(rule, '/', 1) as h, substr(rule, instr(rule, '/')) as p from rules),
fits as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(says, length(rule)) as says from h join parts on (h.host = parts.h or ends_with(h.host, '.' || parts.h)) and starts_with(h.path, parts.p) group by page_id)
select page_id, host, path, fits.rule, fits.says from h left join fits using (page_id)"""


def test_url_rules_agree_with_sql(spark, duck):
    got = QUERIES["op5_url_filters"](spark, SF).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("says"))
    want = duck.execute(RULES_SQL).df()
    assert plain(got.toPandas().astype(object).itertuples(index=False)) == plain(want.astype(object).itertuples(index=False))


def test_url_edges(spark):
    long = "http://long.org/" + "a/" * 50_000
    data = [(1, long), (1, long), (2, None), (3, "http://x.com/"), (4, "http://free.org/a?b=1&c=2")]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("verdict", F.lit("mine")).withColumn("host", F.lit(3))
    got = urls.judge(df).collect()
    assert len(got) == 5 and len({r.verdict for r in got if r.page_id == 1}) == 1
    assert {r.verdict for r in got} == {"allow"}  # one class only
    assert {r.verdict for r in urls.judge(df.filter("page_id in (2, 4)")).collect()} == {"allow"}  # no label


def test_suffix_rates_count_all_labelled_rows(spark):
    data = [(i, f"http://h{i % 3}.net/{'es' if i % 4 else 'it'}/") for i in range(400)]
    df = urls.parse(spark.createDataFrame(data, "page_id long, url string"))
    rule, verdict = urls.match_rules(F.col("host"), F.col("path"))
    got = {r.suffix: r for r in urls.suffix_rates(df.withColumn("verdict", verdict)).collect()}
    assert got["net"].n == 400 and abs(got["net"].rate - 1) < 1e-4


def test_repeated_ids_give_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b" * 1000), (3, None)], "k long, text string")
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "k long, label int")
    assert sorted(r.k for r in labelled_texts(docs, chosen)) == [1, 2, 3]
    assert sorted(r.k for r in labelled_texts(docs, chosen, limit=100)) in ([1, 3], [1], [3], [])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    named = docs.withColumnRenamed("k", "doc_id").withColumn("toxicity", F.lit(1)).withColumn("label", F.lit("x"))
    assert quality_model.train(named, labels) is not None
    assert toxicity.reject_toxic(named, labels).columns == named.columns


def test_numerals_are_no_letters():
    model = langid.fit(["the cat is on the mat"] * 30 + ["der hund ist im haus"] * 30, ["en"] * 30 + ["de"] * 30)
    got, scores = langid.predict(model, ["½ ² 3 _", "½ the", "", None])
    assert got[0] == got[2] == got[3] == "und" and got[1] != "und" and scores[0] == 0


def test_temperature_calibrates():
    """On texts of two mixed vocabularies the mean score is near the share of right answers."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    make = lambda lean: " ".join(words[i] for i in np.where(rng.random(12) < 0.5 + lean, rng.integers(0, 20, 12), rng.integers(20, 40, 12)))
    y = rng.integers(0, 2, 1200)
    texts = [make(0.12 if v else -0.12) for v in y]
    model = langid.fit(texts[:800], ["ab"[v] for v in y[:800]])
    got, scores = langid.predict(model, texts[800:])
    right = np.mean([g == "ab"[v] for g, v in zip(got, y[800:])])
    assert 0.6 < right < 1 and abs(right - scores.mean()) < 0.12


def test_mixing_with_one_row_repeated_and_null_ids(spark):
    """A third of the rows are one row without id; offsets stay exact and no group holds them all."""
    from tidyspark.llm import mixing

    rows = [(None, "a b c", "s", "x")] * 300 + [(i, "w " * (i % 9 + 1), "st"[i % 2], "y") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_row string").repartition(5)
    plan = mixing.mix_plan(mixing._rows(df, "text", "doc_id", "source")).toPandas()
    assert len(plan) == 900 and (plan.taken <= 2 * plan["size"]).all()
    by = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 1).all()
    again = mixing.mix_plan(mixing._rows(df.repartition(3), "text", "doc_id", "source")).toPandas()
    key = ["doc_id", "size", "taken"]
    assert plan[key].astype(str).sort_values(key).values.tolist() == again[key].astype(str).sort_values(key).values.tolist()
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert sum(len(r.text.split()) for r in got) == plan.taken.sum()
    assert sum(r.doc_id is None for r in got) == sum(len(v) for v in plan[plan.doc_id.isna()].visits)
