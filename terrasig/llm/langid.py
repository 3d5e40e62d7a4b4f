"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character 1- to 4-grams (inside words, with word edges), followed by a linear
softmax. Embeddings and softmax are trained together by stochastic gradient descent in numpy; a part of the sample that
is not trained on sets the temperature of the probabilities and the rejection threshold.

The sample is bounded: `ROWS` rows in all, the same number for each language (the lowest hashes of their ids); each gives
its whole text and a few short pieces of it. Everything else covers all documents and whole texts. For scoring, embedding and
softmax are multiplied into one small table of logits per hash.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; with no labelled row at all every
text is `und`; rows with a null language teach nothing; repeated rows are scored alike; further columns pass through.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from terrasig.llm.words import mix, slices

#: Bound of the training sample, in rows.
ROWS = 4000

#: Rows of the embedding table, a power of two.
BUCKETS = 1 << 13

#: The share of accepted predictions that may be wrong on the calibration part.
ERRORS = 0.01

UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x30000)]))
    return _LETTERS[0]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every character n-gram, and which texts have a letter."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in lower], np.int64))
    letter = _letters()[np.minimum(codes, 0x2FFFF)]
    codes = np.where(letter, codes, 32)  # every other sign is a word edge
    has = np.bincount(owner, letter, len(texts)) > 0
    buckets, owners = [], []
    key = np.zeros(len(codes), np.uint64)
    inner = np.ones(len(codes), bool)
    n = len(codes)
    for size in range(1, 5):
        key = key[: n - size + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :].astype(np.uint64)
        # an edge may only stand first or last, and not alone
        if size == 1:
            good = letter.copy()
        elif size == 2:
            good = letter[:-1] | letter[1:]
        else:
            inner = (inner if size > 3 else np.ones(n, bool))[: n - size + 1] & letter[size - 2 : n - 1]
            good = inner
        at = np.flatnonzero(good)
        buckets.append((mix(key[at] + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners), has


def sample(docs: DataFrame, key: str, text: str, lang: str, learn: Column) -> DataFrame:
    """At most ROWS rows (text, lang), as many of each language."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & learn).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("lang"))
    kinds = named.select("lang").distinct().count()
    each = max(1, ROWS // max(1, kinds))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    picked = named.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= each).orderBy("r", "lang").limit(ROWS).select("k", "lang").distinct()
    rows = docs.where(F.col(text).isNotNull() & learn).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.join(F.broadcast(picked), ["k", "lang"])


def _bags(batches):
    """For each sampled row its whole text and three short pieces, as counted buckets."""
    for batch in slices(batches, "text", 1 << 20):
        texts, langs, keys = (batch.column(c).to_pylist() for c in ("text", "lang", "k"))
        pieces, owner = [], []
        for i, t in enumerate(texts):
            pieces.append(t)
            owner.append(i)
            rng = np.random.default_rng([len(t), *keys[i].encode()])
            for width in (12, 40, 120):
                at = int(rng.integers(0, max(1, len(t) - width)))
                pieces.append(t[at : at + width])
                owner.append(i)
        bucket, of, has = _grams(pieces)
        cell, count = np.unique(of.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cuts = np.searchsorted(cell, np.arange(len(pieces) + 1) * BUCKETS)
        keep = [i for i in range(len(pieces)) if has[i]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([keys[owner[i]] for i in keep], pa.string()),
                pa.array([i % 4 for i in keep], pa.int32()),
                pa.array([langs[owner[i]] for i in keep], pa.string()),
                pa.array([(cell[cuts[i] : cuts[i + 1]] % BUCKETS).astype(np.int32).tobytes() for i in keep], pa.binary()),
                pa.array([count[cuts[i] : cuts[i + 1]].astype(np.float32).tobytes() for i in keep], pa.binary()),
            ],
            names=["k", "piece", "lang", "ids", "counts"],
        )


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    """Train on the rows that satisfy `learn` (a condition on the columns of docs; all if None)."""
    rows = sample(docs, key, text, lang, F.lit(True) if learn is None else learn)
    bags = rows.mapInArrow(_bags, "k string, piece int, lang string, ids binary, counts binary").toPandas()
    bags = bags.sort_values(["k", "piece", "ids"]).reset_index(drop=True)
    languages = sorted(set(bags["lang"]))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y = np.searchsorted(languages, bags["lang"].to_numpy(str))
    ids = [np.frombuffer(x, np.int32) for x in bags["ids"]]
    part = [np.frombuffer(x, np.float32) / np.frombuffer(x, np.float32).sum() for x in bags["counts"]]
    document = np.unique(bags["k"].to_numpy(str), return_inverse=True)[1]
    fold = mix(document.astype(np.uint64)) % np.uint64(5) == 0  # a fifth of the documents calibrates
    table, bias = _train(ids, part, y, np.flatnonzero(~fold), len(languages), width, epochs, rate, seed)
    rest = np.flatnonzero(fold)
    if not len(rest):
        return Model(languages, table, bias, 1.0, 0.0)
    logits = np.stack([part[i] @ table[ids[i]] for i in rest]) + bias
    return Model(languages, table, bias, *_calibrate(logits, y[rest]))


def _softmax(logits: np.ndarray) -> np.ndarray:
    up = np.exp(logits - logits.max(axis=1, keepdims=True))
    return up / up.sum(axis=1, keepdims=True)


def _train(ids, part, y, rows, classes, width, epochs, rate, seed) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1.0 / width, (BUCKETS, width))
    out, bias = rng.normal(0, 0.1, (width, classes)), np.zeros(classes)
    steps, done = epochs * (len(rows) // 32 + 1), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for a in range(0, len(rows), 32):
            some = rows[a : a + 32]
            sizes = np.array([len(ids[i]) for i in some])
            flat, weight = np.concatenate([ids[i] for i in some]), np.concatenate([part[i] for i in some])
            first = np.concatenate([[0], sizes.cumsum()[:-1]])
            mean = np.add.reduceat(embed[flat] * weight[:, None], first)
            slope = _softmax(mean @ out + bias)
            slope[np.arange(len(some)), y[some]] -= 1
            now = rate * (1 - done / steps)
            back = slope @ out.T
            out -= now * mean.T @ slope / len(some) * 8
            bias -= now * slope.mean(axis=0)
            # means of many n-grams have small gradients, so embeddings move at a higher rate
            np.add.at(embed, flat, -now * 20 * weight[:, None] * np.repeat(back, sizes, axis=0))
            done += 1
    return (embed @ out).astype(np.float32), bias


def _calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of the least log loss, and the least confidence from which on at most ERRORS are wrong."""
    grid = np.geomspace(0.1, 10, 61)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    best, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-best)
    share = wrong[order].cumsum() / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share <= ERRORS)
    return temperature, float(best[order][good[-1]]) if len(good) else 1.0


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of docs with lang_pred, score (calibrated probability) and rejected; no shuffle."""

    def run(batches):
        names = pa.array([*model.languages, UNKNOWN])
        for batch in slices(batches, text, 1 << 20):
            bucket, owner, has = _grams([t or "" for t in batch.column(text).to_pylist()])
            total = np.bincount(owner, minlength=batch.num_rows)
            kinds = len(model.languages)
            if kinds:
                sums = np.stack([np.bincount(owner, model.table[bucket, c], batch.num_rows) for c in range(kinds)], axis=1)
                p = _softmax((sums / np.maximum(total, 1)[:, None] + model.bias) / model.temperature)
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score, has = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            best, score = np.where(has, best, kinds), np.where(has, score, 0.0)
            own = [names.take(pa.array(best)), pa.array(np.clip(score, 0, 1)), pa.array(~has | (score < model.threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "__lang", "__score", "__rejected"])

    schema = StructType([*docs.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType()), StructField("__rejected", BooleanType())])
    out = docs.mapInArrow(run, schema)
    new = {"lang_pred": "__lang", "score": "__score", "rejected": "__rejected"}
    return out.select(*[c for c in docs.columns if c not in new], *[F.col(v).alias(k) for k, v in new.items()])


def learnable(key: str = "doc_id") -> Column:
    """The contract's training rows: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0
