"""Operators that SQL cannot express, on the given tables: fingerprints against true sets, and labels that were held out."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terrasig.llm import linededup
from terrasig.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_document_has_its_row_of_lines(spark):
    line = "The quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, line + "\n\n" + line + "\nother words of no other text"), (1, line + "\n\n" + line + "\nother words of no other text"), (2, None), (3, " \n"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit(1))
    got = sorted(linededup.report(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [tuple(r)[:3] for r in got] == [(1, 3, 2), (1, 3, 2), (2, 0, 0), (3, 0, 0), (None, 1, 0)]  # a missing id comes first
    assert linededup.report(docs.limit(0)).count() == 0


def shingles(text: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_fingerprints_against_true_sets(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprints"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    wrong, by_text = [], {}
    for k, text in texts.items():
        r, other = got[k], texts[after[k]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        wrong += [abs(r["near_edited"] - likeness(text, edited)), abs(r["near_next"] - likeness(text, other))]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert max(wrong) < 0.25 and sum(wrong) / len(wrong) < 0.05


def test_languages_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](spark, MIDDLE).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 100


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_toxicity_of_held_out_documents(spark, sf):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    bad, good = ([r for r in held if toxic[r["doc_id"]] == v] for v in (1, 0))
    assert sum(r["predicted"] for r in bad) >= 0.85 * len(bad) > 50
    assert sum(r["predicted"] for r in good) <= 0.02 * len(good)
    # long clean documents are not called toxic much more often than short ones
    long = [r for r in good if size[r["doc_id"]] >= 300]
    assert sum(r["predicted"] for r in long) <= 0.03 * len(long)
