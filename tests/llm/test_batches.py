"""Whole texts go to the Python workers in batches bounded in bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyspark.llm import common, neardup, toxicity
from tidyspark.llm.queries import QUERIES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY)


def _large(spark):
    """30 MB of text in one partition."""
    return spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), F.lit(20_000)).alias("text"))


def test_toxicity_scores_long_texts_in_small_batches(unbounded, monkeypatch):
    limit = 2 * common.BATCH_BYTES
    # a batch beyond the limit is called toxic
    monkeypatch.setattr(toxicity, "predict", lambda model, texts: np.full((len(texts), 2), float(sum(map(len, texts)) > limit)))
    labels = unbounded.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(_large(unbounded), labels).count() == 300


def test_toxicity_query_bounds_its_batches(unbounded):
    QUERIES["op9_toxicity"](unbounded, "/root/testdata/sf0.001")
    assert int(unbounded.conf.get(KEY)) == common.BATCH_BYTES


def test_near_duplicates_describes_long_texts_in_small_batches(unbounded, monkeypatch):
    limit, describe = 2 * common.BATCH_BYTES, neardup._describe

    def checked(max_ratio):
        run = describe(max_ratio)

        def small(batches):
            for batch in batches:
                if batch.nbytes > limit:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield from run(iter([batch]))

        return small

    monkeypatch.setattr(neardup, "_describe", checked)
    kept = neardup.keep_one(_large(unbounded))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_a_limit_of_the_session_stays(unbounded):
    unbounded.conf.set(KEY, "1000000")
    common.bound_batches(unbounded)
    assert unbounded.conf.get(KEY) == "1000000"
