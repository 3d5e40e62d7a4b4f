"""Ranked lexical search by presence masks, exact, in integers.

1. Items are read first; their distinct terms are the vocabulary of a pass. Items are dealt into as many passes as keep a
   vocabulary near `VOCABULARY` terms, so what is broadcast is bounded whatever the benchmark's size.
2. Every text is tokenised once per pass; a document becomes its number of terms and its (term, occurrences) pairs within
   the vocabulary, a table in the shared folder. Corpus counts (documents, terms, documents per term) come from that table.
3. A task reads its documents in blocks. For one item, each matched term sets its bit in the words of its documents; OR-ing
   them gives every document's presence mask, and equal masks are one group. A mask's highest possible score is the sum of
   its terms' highest impacts in the block. Masks are opened in descending order of it until the twentieth score so far is
   above all that is left; ties are still opened, since the lower doc_id wins them.
4. The tasks' lists, twenty rows an item at most, are ranked per item by Spark.

Terms are 64-bit hashes of the lower-cased (A-Z) runs of letters, digits and non-ASCII characters.

Defined cases: null and empty texts have no terms and count nowhere; an item without terms has no rows; equal benchmark rows
are one item, rows that repeat an item_id with another text are ranked each on their own; every row of documents counts and
ranks, also one that repeats a doc_id; a null doc_id comes last among equal scores; an empty table gives no rows; further
columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasig.llm.store import keep
from terrasig.llm.words import SIGNS, slices, word_hashes

#: Documents returned for an item, fixed by the query's contract.
TOP = 20

#: Terms of all items of a pass, about: 8 bytes each go to every task, and as many weights.
VOCABULARY = 500_000

#: Bytes of text hashed at once.
SLICE = 1 << 20

#: Mask groups are opened together until they hold so many documents.
OPENED = 64


def _item_terms(batches):
    for batch in slices(batches, "text", SLICE):
        hashes, at = word_hashes(batch.column("text"), SIGNS)
        parts = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32))
        terms = np.concatenate([*(p[0] for p in parts), np.zeros(0, np.uint64)]).view(np.int64)
        times = np.concatenate([*(p[1] for p in parts), np.zeros(0, np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(times))],
            names=["item", "terms", "times"],
        )


def _tallier(vocabulary):
    """Texts to (doc, n, terms, times): how many terms, and which of the vocabulary (by place) how often."""

    def run(batches):
        known = np.frombuffer(vocabulary.value, np.uint64)
        gate = np.zeros(1 << 20, bool)  # most words end at one look
        gate[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in slices(batches, "text", SLICE):
            hashes, at = word_hashes(batch.column("text"), SIGNS)
            maybe = np.flatnonzero(gate[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            met = known[place] == hashes[maybe]
            doc = np.searchsorted(at, maybe[met], side="right") - 1
            pairs, times = np.unique(doc * len(known) + place[met], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(known)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs % len(known)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32))),
                ],
                names=["doc", "n", "terms", "times"],
            )

    return run


def _groups(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of mask words, and each document's."""
    if words.shape[1] == 1:
        masks, group = np.unique(words[:, 0], return_inverse=True)
        return masks[:, None], group
    return np.unique(words, axis=0, return_inverse=True)


def _bounds(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The highest possible score of each mask."""
    out = np.zeros(len(masks), np.int64)
    for j, high in enumerate(most.tolist()):
        out += ((masks[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64) * high
    return out


class Block:
    """Documents of one batch, their impacts by document and by term."""

    def __init__(self, batch: pa.RecordBatch, count: int, length: int):
        lists = batch.column("terms")
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.terms = lists.values.to_numpy()[self.offsets[0] : self.offsets[-1]]
        times = batch.column("times").values.to_numpy()[self.offsets[0] : self.offsets[-1]].astype(np.int64)
        self.offsets = self.offsets - self.offsets[0]
        n = batch.column("n").to_numpy()
        whole, rest = divmod(25 * count, length)
        m = 75 + n * whole + n * rest // length
        self.owner = np.repeat(np.arange(batch.num_rows), np.diff(self.offsets))
        self.impact = 1_000_000_000 * times // (1000 * times + 12 * m[self.owner])
        order = np.argsort(self.terms, kind="stable")
        self.listed, self.by_term = order, self.terms[order]
        self.docs = batch.num_rows

    def best(self, terms: np.ndarray, weights: np.ndarray, table: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of an item that can be among its best: masks in descending order of their highest score,
        until `top` of them are above what is left. floor: a score that is reached by `top` documents elsewhere."""
        start, end = np.searchsorted(self.by_term, terms, "left"), np.searchsorted(self.by_term, terms, "right")
        held = np.flatnonzero(end > start)
        if not len(held):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.zeros((self.docs, (len(held) + 63) // 64), np.uint64)
        most = np.zeros(len(held), np.int64)
        for j, i in enumerate(held.tolist()):
            places = self.listed[start[i] : end[i]]
            words[self.owner[places], j >> 6] |= np.uint64(1 << (j & 63))
            most[j] = int(weights[i]) * int(self.impact[places].max())
        some = np.flatnonzero(words.any(axis=1))
        masks, group = _groups(words[some])
        bound = _bounds(masks, most)
        order = np.argsort(-bound, kind="stable")
        members = some[np.argsort(group, kind="stable")]
        sizes = np.bincount(group, minlength=len(masks))
        first = np.concatenate([[0], sizes.cumsum()])
        table[terms] = weights
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while at < len(order) and bound[order[at]] >= max(floor, 1):
            to = at + 1 + int(np.searchsorted(sizes[order[at:]].cumsum(), OPENED))
            opened = np.concatenate([members[first[g] : first[g + 1]] for g in order[at:to].tolist()])
            docs, scores = np.append(docs, opened), np.append(scores, self.scores(opened, table))
            if len(scores) >= top:
                floor = max(floor, int(np.partition(scores, -top)[-top]))
            at = to
        table[terms] = 0
        good = scores >= max(floor, 1)
        return docs[good], scores[good]

    def scores(self, docs: np.ndarray, table: np.ndarray) -> np.ndarray:
        size = self.offsets[docs + 1] - self.offsets[docs]
        ends = size.cumsum()
        at = np.arange(ends[-1]) + np.repeat(self.offsets[docs] - (ends - size), size)
        total = np.concatenate([[0], (table[self.terms[at]] * self.impact[at]).cumsum()])
        return total[ends] - total[ends - size]


def _cut(docs: list, scores: np.ndarray, top: int) -> tuple[list, np.ndarray]:
    """The `top` highest scores, equal ones by ascending document, null last."""
    order = sorted(range(len(docs)), key=lambda i: (-int(scores[i]), docs[i] is None, docs[i] if docs[i] is not None else 0))[:top]
    return [docs[i] for i in order], scores[order]


def _searcher(held, count: int, length: int, top: int, kind: pa.DataType):
    def run(batches):
        items, vocabulary = held.value
        table = np.zeros(vocabulary, np.int64)
        best: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch, count, length)
            keys = batch.column("doc")
            for item, terms, weights in items:
                docs, scores = best.get(item, ([], np.zeros(0, np.int64)))
                floor = int(scores[-1]) if len(scores) >= top else 0
                found, values = block.best(terms, weights, table, floor, top)
                if len(found):
                    best[item] = _cut(docs + keys.take(pa.array(found)).to_pylist(), np.append(scores, values), top)
        for item, (docs, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(docs), pa.int64()), pa.array(docs, kind), pa.array(scores)], names=["item", "doc", "score"])

    return run


def weight(documents: int, holders: int) -> int:
    """A term's weight of so many documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _pass(spark, docs: DataFrame, items: list, top: int) -> DataFrame | None:
    """Local lists (item, doc, score) of one pass of items: (item, terms, times) rows."""
    known = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in items]).view(np.uint64))
    vocabulary = spark.sparkContext.broadcast(known.tobytes())
    kind = docs.schema["doc"].dataType.simpleString()
    tallies = keep(docs.mapInArrow(_tallier(vocabulary), f"doc {kind}, n long, terms array<int>, times array<int>").where("n > 0"), "tallies")
    count, length = tallies.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count:
        return None
    spread = tallies.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # the vocabulary's size at most
    holders = np.zeros(len(known), np.int64)
    holders[spread.column("term").to_numpy()] = spread.column("count").to_numpy()
    weights = np.array([weight(count, h) for h in holders.tolist()], np.int64)
    ready = []
    for r in items:
        at = np.searchsorted(known, np.array(r["terms"], np.int64).view(np.uint64))
        ready.append((r["item"], at, weights[at] * np.array(r["times"], np.int64)))
    held = spark.sparkContext.broadcast((ready, len(known)))
    arrow = docs.select("doc").limit(0).toArrow().schema.field("doc").type
    return tallies.where("size(terms) > 0").mapInArrow(_searcher(held, count, length, top, arrow), f"item long, doc {kind}, score long")


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """Each item's `top` best documents with a score above 0: item_id, rank, key, score."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct().withColumn("item", F.xxhash64("id", "text"))
    terms = keep(asked.select("item", "text").mapInArrow(_item_terms, "item long, terms array<long>, times array<long>").where("size(terms) > 0"), "items")
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-total // VOCABULARY)
    found = []
    for p in range(passes):
        items = terms.where(F.pmod("item", F.lit(passes)) == p).orderBy("item").collect()  # VOCABULARY terms on average
        if items and (rows := _pass(spark, texts, items, top)) is not None:
            found.append(keep(rows, "found"))
    if not found:
        rows = texts.select(F.lit(0).cast("long").alias("item"), "doc", F.lit(0).cast("long").alias("score")).limit(0)
    else:
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "id"), "item").select(F.col("id").alias(item_id), "rank", F.col("doc").alias(key), "score")
