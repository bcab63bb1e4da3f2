"""What the pipeline's stages hold in a Python worker doesn't depend on how many rows a task has."""

import numpy as np
import pyarrow as pa
import pytest

from specto.llm import bpe, jaccard
from specto.llm.common import BATCH_BYTES, BATCH_KEY, small_batches

MADE = "doc_id long, text string, lang string, source string"


@pytest.fixture
def own_setting(spark):
    before = spark.conf.get(BATCH_KEY)
    yield
    spark.conf.set(BATCH_KEY, before)


def test_batches_are_bounded_by_bytes(spark, own_setting):
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64()), "rows": pa.array([b.num_rows], pa.int64())})

    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "s") for i in range(5)], MADE)
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.set(BATCH_KEY, "64m")
        stage(spark, docs, "")
        long = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text").mapInArrow(sizes, "bytes long, rows long")
        found = long.collect()
        assert max(r.bytes for r in found) < 1.5 * BATCH_BYTES and sum(r.rows for r in found) == 5000, name


def test_own_settings(spark, own_setting, tmp_path):
    import corpus_pipeline

    def held():
        return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY))

    for given, expected in (("64m", BATCH_BYTES), ("300k", 300 << 10), (str(BATCH_BYTES), BATCH_BYTES)):
        spark.conf.set(BATCH_KEY, given)
        small_batches(spark)
        assert held() == expected
    spark.conf.set(BATCH_KEY, "50m")
    spark.createDataFrame([(1, "some words of text", "en", "s")], MADE).write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path))  # the mixture may leave the row out
    assert held() == 50 << 20


def test_one_encoder_a_worker(monkeypatch):
    path, made = bpe.default_path(), []
    monkeypatch.setattr(bpe, "map_batches", lambda docs, make, schema: made.append(make))
    monkeypatch.setattr(bpe, "narrow", lambda *a: None)
    bpe.encoder.cache_clear()
    bpe.bpe_roundtrip(None, keep_ids=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["Some words", "y" * 5000 + " some"]})
    outs = [made[0]()(batch) for _ in range(2)]
    assert outs[0].equals(outs[1]) and bpe.encoder.cache_info().misses == 1
    assert set(bpe.encoder(path)) == {"some", "words"}  # long words aren't kept


def test_counts_of_a_sketch(spark):
    """Every n-gram is counted, and counts leave a task in pieces."""
    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(40)) for i in range(300)]
    cells, n = 1 << 20, np.zeros(1 << 20, np.int64)
    for t in texts:
        np.add.at(n, (jaccard.shingles(t, 5) & np.uint64(cells - 1)).view(np.int64), 1)
    mean = max(1.0, 4 * n.mean())
    expected = np.minimum(np.ceil(np.log2(np.maximum(1, n / mean))), 62).astype(np.uint8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert (jaccard.sketch(docs, 5, cells) == expected).all() and expected.any()
