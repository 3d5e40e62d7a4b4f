"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? and line feeds). A sentence's probability is a logistic function of its
hashed words and word stems; the document's is their noisy-or, 1 - prod(1 - p). Only document labels are needed: gradients
flow to the sentences through the noisy-or, so the model learns which sentences carry the label and can point at them.
In a score sentences without cues have no mass, and weak ones only what they have beyond the clean training texts' mean per
sentence, so that no text is called toxic for its length.

Training takes a bounded sample of labelled rows (`TOXIC_ROWS` and `CLEAN_ROWS`, the lowest hashes of their ids), as
hashed features; everything else covers every document and whole texts.

Defined cases: a null or empty text has no sentences and scores 0; a document id with several labels counts as toxic if one
of them is; rows with a null id or label teach nothing; with no labelled rows at all every score is 0; repeated rows are
scored alike; further columns pass through `score` untouched and are never features.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrasig.llm.words import STOPS, raw, slices, stem_hashes

#: Bounds of the training sample.
TOXIC_ROWS = 2000
CLEAN_ROWS = 3000

#: Size of the hashed feature table, a power of two.
FEATURES = 1 << 20

#: A sentence's logit without any cue.
BIAS = -8.0

#: A document is called toxic from here on.
THRESHOLD = 0.3

#: Sentences below this logit are weak: none of them alone makes a document toxic.
WEAK = np.log(THRESHOLD / (1 - THRESHOLD))

#: Standard deviations that weak cues may exceed their mean in a clean text.
SPREAD = 2.0


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one (ascending feature ids), the bias of a sentence, and mean and variance of the
    mass of weak sentences in clean texts."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    mean: float = 0.0
    variance: float = 0.0

    def table(self) -> np.ndarray:
        full = np.zeros(FEATURES, np.float32)
        full[self.features] = self.weights
        return full


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids (rows) of every word, each word's sentence, the sentences' first words, each sentence's text, and the
    byte where each text's sentences start."""
    hashes, at, word_at, offsets = stem_hashes(texts)
    ids = (hashes & np.uint64(FEATURES - 1)).astype(np.int64)
    data, _ = raw(texts)
    stops = STOPS[data].cumsum() if len(data) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(word_at))
    # a word's sentence: changes with the text or with a stop between two words
    change = np.ones(len(at), bool)
    if len(at) > 1:
        change[1:] = (stops[at[1:]] != stops[at[:-1]]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(change)
    return ids, change.cumsum() - 1, first, text_of[first] if len(first) else np.zeros(0, np.int64), at


def _sentence_logits(ids: np.ndarray, first: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    if not len(first):
        return np.zeros(0)
    return np.add.reduceat(table[ids].sum(axis=0, dtype=np.float64), first) + bias


def _chance(logits: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -logits))


def _keep_off(logits: np.ndarray) -> np.ndarray:
    """log(1 - p) of logits."""
    return -np.logaddexp(0.0, logits)


def _mass(logits: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of sentences, over that of a sentence without any cue, which has none."""
    return _keep_off(np.array(bias)) - _keep_off(logits)


def _total(logits: np.ndarray, owner: np.ndarray, rows: int, model: Model) -> np.ndarray:
    """Each text's chance. Sentences that reach the threshold count whole; of the others what exceeds the mass that weak cues
    have by chance in a clean text of so many sentences, its mean and `SPREAD` standard deviations."""
    mass = _mass(logits, model.bias)
    weak = logits < WEAK
    n = np.bincount(owner, weak, rows)
    chance = n * model.mean + SPREAD * np.sqrt(n * model.variance)
    total = np.bincount(owner, np.where(weak, 0.0, mass), rows) + np.maximum(np.bincount(owner, np.where(weak, mass, 0.0), rows) - chance, 0.0)
    return np.clip(-np.expm1(-total), 0.0, 1.0)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column) -> DataFrame:
    """The labelled training rows: (key, text, y), at most TOXIC_ROWS + CLEAN_ROWS ids."""
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ranked = named.withColumn("__h", F.xxhash64(F.col("__key").cast("string")))
    picked = ranked.where("y = 1").orderBy("__h", "__key").limit(TOXIC_ROWS).unionByName(ranked.where("y = 0").orderBy("__h", "__key").limit(CLEAN_ROWS))
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(picked.select("__key", "y")), "__key")


def _featurise(batches):
    for batch in slices(batches, "text"):
        ids, _, first, owner, _ = _bags(batch.column("text"))
        counts = np.bincount(owner, minlength=batch.num_rows)
        ends = np.append(first, ids.shape[1])
        place = np.concatenate([[0], counts.cumsum()])
        rows = []
        for i in range(batch.num_rows):
            a, b = place[i], place[i + 1]
            words = ids[:, ends[a] : ends[b]].astype(np.int32)
            rows.append((words.tobytes(), np.diff(ends[a : b + 1]).astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__key"), batch.column("y"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            names=["__key", "y", "words", "sizes"],
        )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, epochs: int = 12, rate: float = 0.3, shrink: float = 5e-4, seed: int = 7) -> Model:
    """Train on the labels whose rows satisfy `learn` (a condition on the labels' columns; all if None)."""
    rows = sample(docs, labels, key, text, label, F.lit(True) if learn is None else learn)
    rows = rows.withColumn("__key", F.col("__key").cast("string"))
    bags = sorted(map(tuple, rows.mapInArrow(_featurise, "__key string, y int, words binary, sizes binary").collect()))
    words = [np.frombuffer(x[2], np.int32).reshape(4, -1) for x in bags]
    sizes = [np.frombuffer(x[3], np.int32) for x in bags]
    y = np.array([x[1] for x in bags])
    return _train(words, sizes, y, epochs, rate, shrink, seed)


def _train(words: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, shrink: float, seed: int) -> Model:
    """Adagrad on the noisy-or likelihood, in batches of bags; classes weigh alike."""
    full = [i for i in range(len(y)) if len(sizes[i])]
    if not full or y[full].min() == y[full].max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -800.0)
    seen = np.zeros(FEATURES, np.int32)
    for i in full:
        seen[np.unique(words[i])] += 1
    usable = seen >= 2  # a feature of one document says nothing about others
    weight, power = np.zeros(FEATURES, np.float64), np.full(FEATURES, 1e-4)
    share = y[full].mean()
    value = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(full)
        for a in range(0, len(full), 64):
            some = full[a : a + 64]
            ids = np.concatenate([words[i] for i in some], axis=1)
            lengths = np.concatenate([sizes[i] for i in some])
            bag = np.repeat(np.arange(len(some)), [len(sizes[i]) for i in some])
            first = np.concatenate([[0], lengths.cumsum()[:-1]])
            logits = np.add.reduceat((weight * usable)[ids].sum(axis=0), first) + BIAS
            off = np.bincount(bag, _keep_off(logits), len(some))
            p = _chance(logits)
            chance = np.maximum(-np.expm1(off), 1e-9)
            pull = np.where(y[some] == 1, -(1 - chance) / chance, 1.0) * value[some]
            slope = p * pull[bag]
            grad = np.bincount(ids.ravel(), np.tile(np.repeat(slope, lengths), 4), FEATURES) / len(some)
            hit = np.flatnonzero(grad)
            power[hit] += grad[hit] ** 2
            stride = rate / np.sqrt(power[hit])
            # cues only add up, and small ones shrink to nothing: a long clean text gathers no chance by its length
            weight[hit] = np.maximum(weight[hit] - stride * (grad[hit] + shrink), 0.0)
    weight *= usable
    kept = np.flatnonzero(np.abs(weight) > 1e-3)
    model = Model(kept, weight[kept].astype(np.float32), BIAS)
    table, mass = model.table(), [np.zeros(0)]
    for i in full:
        if y[i] == 0:
            logits = _sentence_logits(words[i], np.concatenate([[0], sizes[i].cumsum()[:-1]]), table, BIAS)
            mass.append(_mass(logits[logits < WEAK], BIAS))
    mass = np.concatenate(mass)
    return replace(model, mean=float(mass.mean()), variance=float(mass.var())) if len(mass) else model


def _scorer(model: Model, column: str):
    def run(batches):
        table = model.table()
        for batch in slices(batches, column):
            ids, _, first, owner, _ = _bags(batch.column(column))
            chance = _total(_sentence_logits(ids, first, table, model.bias), owner, batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=[*batch.schema.names, "__score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of docs with the probability `name` (replaced if present); no shuffle."""
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    out = docs.mapInArrow(_scorer(model, text), schema)
    return out.drop(name).withColumnRenamed("__score", name) if name in docs.columns else out.withColumnRenamed("__score", name)


def locate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The offending sentences: (key, sentence, p, text), numbered within their document, where p reaches the threshold."""

    def run(batches):
        table = model.table()
        for batch in slices(batches, "text"):
            column = batch.column("text")
            data, offsets = raw(column)
            ids, _, first, owner, at = _bags(column)
            p = _chance(_sentence_logits(ids, first, table, model.bias))
            number = np.arange(len(first)) - np.searchsorted(owner, owner)
            ends = np.append(at[first[1:]], len(data)) if len(first) else np.zeros(0, np.int64)
            hit = np.flatnonzero(p >= threshold)
            bodies = [bytes(data[at[first[i]] : min(ends[i], offsets[owner[i] + 1])]).decode("utf-8", "replace").strip() for i in hit]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner[hit])), pa.array(number[hit].astype(np.int32)), pa.array(p[hit]), pa.array(bodies, pa.string())], names=["key", "sentence", "p", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, sentence int, p double, text string").withColumnRenamed("key", key)


def learnable(key: str = "doc_id") -> Column:
    """The contract's training rows: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2
