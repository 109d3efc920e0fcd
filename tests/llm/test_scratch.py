"""Scratch tables of texts are packed well, as the pipeline's disk is mostly they and the shuffles."""

import random

from scholarlake.llm.common import materialize


def test_scratch_tables_are_small_and_whole(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=300))) for i in range(500)], "doc_id long, text string").coalesce(1)
    texts.write.option("compression", "snappy").parquet(f"{tmp_path}/plain")
    size = lambda files: sum(spark.read.format("binaryFile").load(f).first().length for f in files)
    stored = materialize(texts, "texts")
    assert sorted(stored.collect()) == sorted(texts.collect())
    assert size(stored.inputFiles()) < 0.8 * size(spark.read.parquet(f"{tmp_path}/plain").inputFiles())
