"""What a task of the document operators holds: Python workers and pieces of text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from terrasig.llm import jaccard, words


def test_screened_texts_are_filtered_and_hashed_by_one_worker(spark):
    texts = [(1, "a b c d e f g h i j"), (2, None), (3, "k l m n o p q r s t u")]
    docs = spark.createDataFrame(texts, "id long, text string").select("id", F.xxhash64("text").alias("body"), "text")
    found = jaccard._sets_of(docs, docs.where("id = 1").select("id", "body"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert jaccard.set_key(words.sets(pa.array([texts[0][1]]))[0]) in {r["node"] for r in found.collect()}


def test_slices_hold_every_row_once():
    texts = ["é" * 3, None, "", "abc", "x" * 50, None, "yz"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], names=["text"]).slice(0)
        for cut, want in ((batch, texts), (batch.slice(2, 4), texts[2:6])):
            got = [p.column("text").to_pylist() for p in words.slices([cut], "text", 8)]
            assert sum(got, []) == want and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 8 for p in got)
