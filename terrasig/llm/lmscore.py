"""Language-model scores with stupid backoff, computed over hash-partitioned n-gram count tables.

score(w | context) is c(context w) / c(context) where the n-gram is in the table, else `BACKOFF` times the score with a
shorter context; unigrams are c(w) / all words. Tables of two and more words keep what occurs at least `LEAST` times in the
corpus, so a document's own singletons do not vouch for it. A document's score is the mean natural logarithm per word.

Counts cover every word of every document. Rows are packed: documents are cut into slices of a few MB; a slice's distinct
n-grams go to the count table's partitions by hash as sorted arrays with their counts in the slice, and each partition
answers every slice with the corpus counts in the same order. So a word as frequent as it may be costs one entry per slice,
not one per occurrence, and partitions are made as many as keep `ENTRIES` in each.

Words are runs of other than white space, A-Z lower-cased, as 48-bit hashes; n-grams are 64-bit hashes of those.

Defined cases: null and empty texts have no words and a null score; unknown order is an error; repeated rows are scored alike
(and counted as often as they stand); an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.llm.store import keep
from terrasig.llm.words import mix, slices, word_hashes

#: Fixed by the published method.
BACKOFF = 0.4

LEAST = 2

#: Entries of the count table (one per slice and distinct n-gram) in one partition.
ENTRIES = 1_000_000

_STEP = 0x9E3779B97F4A7C15


def _grams(vocabulary: np.ndarray, words: np.ndarray, edges: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1..order, the 64-bit n-gram that ends at each word; 0 where the document is too short before it."""
    ids = vocabulary[words]
    place = np.arange(len(words)) - np.repeat(edges[:-1], np.diff(edges))
    out = [mix(ids + np.uint64(1))]
    key = ids.copy()
    for n in range(2, order + 1):
        # the n-gram ending here is the word here after the (n-1)-gram that ends one word before
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]]) if len(ids) else out[-1]
        key = mix(before * np.uint64(_STEP) + ids + np.uint64(n))
        out.append(np.where(place >= n - 1, key, np.uint64(0)))
    return out


def _planes(values: np.ndarray) -> bytes:
    """Differences of ascending 64-bit numbers."""
    return _tight(np.diff(values, prepend=np.uint64(0)))


def _values(planes: bytes) -> np.ndarray:
    return _loose(planes, np.uint64).cumsum(dtype=np.uint64)


def _tight(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _loose(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _counts(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all lengths, ascending, and their counts."""
    flat = np.concatenate(grams)
    return np.unique(flat[flat != 0], return_counts=True)


def _slice(docs: DataFrame, key: str, text: str, order: int, limit: int) -> DataFrame:
    """The slices: (slice, keys, edges, words, vocabulary, entries, tokens), words as places in the vocabulary."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, "text", limit)):
            hashes, edges = word_hashes(batch.column("text"))
            vocabulary, words = np.unique(hashes >> np.uint64(16), return_inverse=True)
            words = words.astype(np.uint32)
            entries = len(_counts(_grams(vocabulary, words, edges, order))[0])
            column = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), column, pa.array([edges.astype(np.int64).tobytes()]), pa.array([_tight(words)]), pa.array([_planes(vocabulary)]), pa.array([entries], pa.int64()), pa.array([len(words)], pa.int64())],
                names=["slice", "keys", "edges", "words", "vocabulary", "entries", "tokens"],
            )

    return keep(rows.mapInArrow(run, f"slice long, keys array<{kind}>, edges binary, words binary, vocabulary binary, entries long, tokens long"), "slices")


def _unpack(edges: bytes, words: bytes, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _values(vocabulary), _loose(words, np.uint32), np.frombuffer(edges, np.int64)


def _parts_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (mix(grams) % np.uint64(parts)).astype(np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2, least: int = LEAST, limit: int = 4 << 20) -> DataFrame:
    """One row per document: key, n_words, score (mean log score per word), backed_off (share of the words whose longest
    n-gram is not in the table)."""
    if order < 1:
        raise ValueError("order is at least 1")
    cut = _slice(docs, key, text, order, limit)
    kind = cut.schema["keys"].dataType.elementType.simpleString()
    sums = cut.agg(F.sum("entries").alias("e"), F.sum("tokens").alias("t")).first()
    parts, total = max(1, -(-(sums["e"] or 0) // ENTRIES)), sums["t"] or 0

    def explode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                grams, counts = _counts(_grams(*_unpack(*(batch.column(c)[i].as_py() for c in ("edges", "words", "vocabulary"))), order))
                part = _parts_of(grams, parts)
                turn = np.argsort(part, kind="stable")  # ascending n-grams inside a partition
                at = np.searchsorted(part[turn], np.arange(parts + 1))
                own = batch.column("slice")[i].as_py()
                for p in range(parts):
                    some = turn[at[p] : at[p + 1]]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([own], pa.int64()), pa.array([_planes(grams[some])]), pa.array([_tight(counts[some].astype(np.uint32))])], names=["part", "slice", "grams", "counts"])

    def count(table: pa.Table) -> pa.Table:
        grams = [_values(x.as_py()) for x in table.column("grams")]
        counts = np.concatenate([_loose(x.as_py(), np.uint32) for x in table.column("counts")])
        _, back = np.unique(np.concatenate(grams), return_inverse=True)
        found = np.bincount(back, counts).astype(np.uint64)[back]
        edges = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        answers = [_tight(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "found": pa.array(answers, pa.binary())})

    asked = cut.mapInArrow(explode, "part long, slice long, grams binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(count, "slice long, part long, found binary")

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["keys"] is not None)
        vocabulary, words, edges = _unpack(own["edges"], own["words"], own["vocabulary"])
        grams = _grams(vocabulary, words, edges, order)
        names, _ = _counts(grams)
        found = np.zeros(len(names), np.uint64)
        part = _parts_of(names, parts)
        turn = np.argsort(part, kind="stable")
        at = np.searchsorted(part[turn], np.arange(parts + 1))
        for r in rows:
            if r["keys"] is None:
                p = r["part"]
                found[turn[at[p] : at[p + 1]]] = _loose(r["found"], np.uint64)
        count_of = [np.where(g != 0, found[np.minimum(np.searchsorted(names, g), max(0, len(names) - 1))], 0).astype(np.float64) if len(names) else g.astype(np.float64) for g in grams]
        value = np.log(np.maximum(count_of[0], 1) / max(total, 1))
        longest = np.zeros(len(words), bool) if order > 1 else np.ones(len(words), bool)
        for n in range(2, order + 1):
            context = np.concatenate([[1.0], count_of[n - 2][:-1]]) if len(words) else count_of[0]
            known, there = count_of[n - 1] >= least, grams[n - 1] != 0
            # at a document's start no longer context exists, so nothing is backed off there
            value = np.where(known, np.log(np.maximum(count_of[n - 1], 1) / np.maximum(context, 1)), value + np.where(there, np.log(BACKOFF), 0.0))
            longest = known | ~there
        n_words = np.diff(edges)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        sums = np.bincount(owner, value, len(n_words))
        off = np.bincount(owner, ~longest, len(n_words))
        none = n_words == 0
        wide = np.maximum(n_words, 1)
        keys = table.column("keys").combine_chunks()
        return pa.table({"key": keys.flatten(), "n_words": pa.array(n_words.astype(np.int64)), "score": pa.array(sums / wide, mask=none), "backed_off": pa.array(off / wide, mask=none)})

    own = cut.select("slice", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("found"), "keys", "edges", "words", "vocabulary")
    back = answers.select("slice", "part", "found", F.lit(None).cast(f"array<{kind}>").alias("keys"), *[F.lit(None).cast("binary").alias(c) for c in ("edges", "words", "vocabulary")])
    out = own.unionByName(back).groupBy("slice").applyInArrow(add, f"key {kind}, n_words long, score double, backed_off double")
    return out.withColumnRenamed("key", key)
