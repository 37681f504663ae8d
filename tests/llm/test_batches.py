"""What a Python worker gets at a time does not follow the length of the texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.session import BATCH_BYTES

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(docs):
    def go(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    return docs.mapInArrow(go, "n long").agg(F.max("n")).first()[0]


# mixing sends no text to a worker
SENDING = {k: f for k, f in corpus_pipeline.STAGES if k != "mixing"}


@pytest.mark.parametrize("stage", SENDING.values(), ids=SENDING)
def test_a_stage_with_long_texts_has_bounded_batches(spark, sf, stage):
    own = spark.newSession()
    long = own.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id"), 40_000).alias("text"), F.lit("s").alias("source"))
    docs = own.read.parquet(f"{sf}/documents.parquet").limit(50)
    stage(own, docs, sf)
    # a batch ends with the row that fills it
    assert _largest(long) <= BATCH_BYTES + (1 << 20)


def test_the_users_bound_stays(spark, sf):
    own = spark.newSession()
    own.conf.set(BOUND, "9m")
    corpus_pipeline.drop_shared_lines(own, own.read.parquet(f"{sf}/documents.parquet").limit(50), sf)
    assert own.conf.get(BOUND) == "9m"
