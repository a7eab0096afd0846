"""Columns of a user's own come through the sharding stage under a name that is free, in any case of letters."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("mine", [["shard", "slot", "moved"], ["Shard", "SLOT"], ["slot", "slot_before"], []])
def test_sharding_keeps_clashing_columns(spark, mine):
    rows = [(k, f"text {k}", "en", f"s{k % 3}", 6) for k in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(f"mine {c}").alias(c) for c in mine))
    out = corpus_pipeline.sharding_stage(spark, docs, "")
    assert len(out.columns) == 7 + len(mine) and {"shard", "slot"} <= set(out.columns)
    kept = [c for c in out.columns if "_before" in c]
    got = out.collect()
    assert len(got) == 41 and sorted(r[c] for c in kept for r in got[:1]) == sorted(f"mine {c}" for c in mine)
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == sorted((k, f"text {k}") for k in range(40))
    for j in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == j)
        assert slots == list(range(len(slots)))
