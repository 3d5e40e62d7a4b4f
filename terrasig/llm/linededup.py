"""Fuzzy line dedup: MinHash over character shingles, banding, exact verification, distributed union-find.

A line (between line feeds, not blank) is the set of its shingles of `WIDTH` bytes, A-Z lower-cased; a shorter line is one
shingle. Signatures are one-permutation MinHash: a shingle's hash picks a bin and its value, empty bins take over from the next
filled one. `BANDS` bands of `ROWS` bins make the candidates: two lines at a similarity of 0.8 meet with a probability of
0.9992, at 0.85 of 0.9999. In each band every line is paired with one centre (chosen by a hash that differs from band to band);
pairs are verified by their exact Jaccard similarity and links make clusters. A band whose lines are then of one cluster is done.
In the others the lines are cut into salted blocks, and blocks meet each other and themselves: every pair of lines of different
clusters is verified. So two lines that share a band are compared, or connected already. Links make components, and the first
line (least document, then place) of each component stays.

Bands are first counted with partial sums; only bands of two or more lines are joined, so a band that a third of all lines
share is never one task, and most lines end after the count.

Defined cases: equal lines are one node; blank lines stay; a null text stays null; documents of equal key are ordered by a
hash of their text, rows equal in both are one document; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.llm.components import components
from terrasig.llm.store import keep
from terrasig.llm.words import _LOWER, _powers, mix, raw, slices

WIDTH = 9
BANDS = 10
ROWS = 3
SIMILARITY = 0.8

#: Lines and bytes of text in a block of a band of several clusters, about.
BLOCK = 1_000
BYTES = 4 << 20

def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a batch, and of each non-blank line its first byte, its end and its text; blanks are left out."""
    data, offsets = raw(texts)
    if not len(data):
        return data, *(np.zeros(0, np.int64),) * 3
    stop = data == 10
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(stop) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    dark = np.concatenate([[0], (~((data == 32) | ((data >= 9) & (data <= 13)))).cumsum()])
    full = dark[ends] > dark[starts]
    starts, ends = starts[full], ends[full]
    ends = ends - stop[ends - 1]
    return _LOWER[data], starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all lines in order, where each line's begin (one more than lines), and a 64-bit name of each line."""
    sizes = np.maximum(ends - starts - WIDTH + 1, 1)
    edges = np.concatenate([[0], sizes.cumsum()])
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]).cumsum(dtype=np.uint64)])
    at = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)
    to = at + WIDTH
    short = np.flatnonzero(ends - starts < WIDTH)
    to[edges[short]] = ends[short]  # the line alone, whatever follows it
    hashes = mix((total[to] - total[at]) * down[at])
    names = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, edges, names.view(np.int64)


def _bands(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """BANDS band hashes of each line."""
    n, bins = len(edges) - 1, BANDS * ROWS
    line = np.repeat(np.arange(n), np.diff(edges))
    cell = line * bins + ((hashes >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    value = hashes & np.uint64((1 << 40) - 1)
    empty = np.uint64((1 << 64) - 1)
    least = np.full(n * bins, empty)
    np.minimum.at(least, cell, value)
    least = least.reshape(n, bins)
    # an empty bin takes the value of the next filled one, marked with the distance
    for step in range(1, bins):
        hole = least == empty
        if not hole.any():
            break
        moved = np.roll(least, -1, axis=1)
        least = np.where(hole & (moved != empty), moved + np.uint64(1 << 41), least)
    out = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(least[:, r::ROWS] + np.uint64(r))
    return mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _members(batches):
    """Every line with its name, and with its bands where the batch has it first."""
    for batch in slices(batches, "text"):
        data, starts, ends, owner = _lines(batch.column("text"))
        hashes, edges, names = _shingles(data, starts, ends)
        number = np.arange(len(starts)) - np.searchsorted(owner, owner)
        take = pa.array(owner)
        first = np.sort(np.unique(names, return_index=True)[1])
        sizes = np.diff(edges)[first]
        at = np.concatenate([[0], sizes.cumsum()])
        some = hashes[np.arange(at[-1]) + np.repeat(edges[first] - at[:-1], sizes)]
        width = np.zeros(len(names), np.int32)
        width[first] = BANDS
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], width.cumsum()]).astype(np.int32)), pa.array(_bands(some, at).reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("body").take(take), pa.array(number.astype(np.int32)), pa.array(names), bands], names=["id", "body", "number", "line", "bands"])


def _texts(batches):
    """Each line's lower-cased bytes, once in a batch."""
    for batch in slices(batches, "text"):
        data, starts, ends, _ = _lines(batch.column("text"))
        names, first = np.unique(_shingles(data, starts, ends)[2], return_index=True)
        whole = data.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([whole[starts[i] : ends[i]] for i in first], pa.binary())], names=["line", "bytes"])


def _verify(batches):
    """The pairs of lines that reach the similarity."""
    for batch in batches:
        for piece in slices([batch], "x"):
            sides = []
            for side in ("x", "y"):
                data, offsets = raw(piece.column(side))
                hashes, edges, _ = _shingles(data, offsets[:-1], offsets[1:])
                sides.append([np.unique(hashes[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
            shared = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(*sides, strict=True)])
            sizes = np.array([len(p) + len(q) for p, q in zip(*sides, strict=True)])
            yield piece.select(["a", "b"]).filter(pa.array(shared >= SIMILARITY * (sizes - shared)))


def _meet(right: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> set[tuple[int, int]]:
    """Links between clusters of a block's lines, or of two blocks' (the second one is `right`)."""
    own = np.flatnonzero(~right)
    asks = np.flatnonzero(right)
    if not len(own) or root.min() == root.max():
        return set()
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[k] for k in own])
    owner = np.repeat(np.arange(len(own)), sizes[own])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found: set[tuple[int, int]] = set()
    for k in asks if len(asks) else own:
        low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        wide = high - low
        at = np.arange(wide.sum()) + np.repeat(low - np.concatenate([[0], wide.cumsum()[:-1]]), wide)
        shared = np.bincount(owner[at], minlength=len(own))
        good = (shared >= SIMILARITY * (sizes[own] + sizes[k] - shared)) & (root[own] != root[k])
        found.update((int(root[k]), int(x)) for x in np.unique(root[own[good]]))
    return found


def _met(batches):
    """The links of every group; the rows of a group follow each other."""
    now, right, root, sets = None, [], [], []

    def links():
        rows = sorted(_meet(np.array(right, bool), np.array(root, np.int64), sets)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], names=["a", "b"])

    for batch in slices(batches, "bytes"):
        data, offsets = raw(batch.column("bytes"))
        hashes, edges, _ = _shingles(data, offsets[:-1], offsets[1:])
        groups, sides, roots = (batch.column(c).to_pylist() for c in ("group", "right", "root"))
        for k in range(batch.num_rows):
            if groups[k] != now:
                yield links()
                now, right, root, sets = groups[k], [], [], []
            right.append(sides[k])
            root.append(roots[k])
            sets.append(np.unique(hashes[edges[k] : edges[k + 1]]))
    yield links()


def _between(met: DataFrame, roots: DataFrame, bytes_of: DataFrame) -> DataFrame:
    """Links between the clusters that lines of one band belong to (a, b: roots)."""
    rooted = met.join(roots, F.col("line") == F.col("node"), "left").select("band", "line", F.coalesce("root", "line").alias("root"))
    # in a band of two the pair was verified
    mixed = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high").select("band")
    sizes = bytes_of.select("line", F.octet_length("bytes").alias("size"))
    lines = keep(rooted.join(mixed, "band").join(sizes, "line"), "open")
    blocks = lines.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BYTES)).cast("int").alias("blocks"))
    placed = lines.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("line", "band"), F.col("blocks")).cast("int"))
    dealt = placed.select("band", "line", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("group"), (F.col("block") > F.col("other")).alias("right"), "line", "root")
    return dealt.join(bytes_of, "line").select("group", "right", "root", "bytes").repartition("group").sortWithinPartitions("group").mapInArrow(_met, "a long, b long").distinct()


def line_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line: id, body (hash of its document's text), number (among the document's non-blank lines),
    component, keep (true for the first line of the component)."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lines = keep(rows.mapInArrow(_members, f"id {kind}, body long, number int, line long, bands array<long>"), "lines")
    members = lines.drop("bands")
    banded = lines.select("line", F.explode("bands").alias("band"))
    full = banded.groupBy("band").count().where("count > 1").select("band")
    met = keep(banded.join(full, "band", "left_semi").distinct(), "bands")
    centres = met.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "line").alias("h"), "line")).alias("c")).select("band", F.col("c.line").alias("centre"))
    pairs = keep(met.join(centres, "band").where("line <> centre").select(F.greatest("line", "centre").alias("a"), F.least("line", "centre").alias("b")).distinct(), "pairs")

    # the texts of the lines in pairs: one document is read for each
    needed = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    sought = members.join(needed, "line", "left_semi").groupBy("line").agg(F.min(F.struct("id", "body")).alias("d"))
    where = keep(sought.select("d.id", "d.body", "line"), "sought")
    places = where.select(F.col("id").alias("__i"), F.col("body").alias("__b")).distinct()
    read = rows.join(places, F.col("id").eqNullSafe(F.col("__i")) & (F.col("body") == F.col("__b")), "left_semi").select("text").mapInArrow(_texts, "line long, bytes binary")
    bytes_of = keep(read.join(where.select("line"), "line", "left_semi").dropDuplicates(["line"]), "linetexts")
    both = pairs.join(bytes_of.select(F.col("line").alias("a"), F.col("bytes").alias("x")), "a").join(bytes_of.select(F.col("line").alias("b"), F.col("bytes").alias("y")), "b")
    links = both.mapInArrow(_verify, "a long, b long")
    roots = keep(components(links), "clusters")
    joined = keep(components(_between(met, roots, bytes_of)), "joined").withColumnsRenamed({"node": "__n", "root": "__r"})
    alone = joined.join(roots, F.col("__n") == F.col("node"), "left_anti").select(F.col("__n").alias("node"), F.col("__r").alias("root"))
    roots = roots.join(joined, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root")).unionByName(alone)

    named = members.join(roots, F.col("line") == F.col("node"), "left").select("id", "body", "number", F.coalesce("root", "line").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct("id", "body", "number")).alias("f"))
    # joined on the line's own place, which no crowd shares, instead of on the component
    first = first.select(F.col("f.id").alias("__i"), F.col("f.body").alias("__b"), F.col("f.number").alias("__n"), F.lit(True).alias("__first"))
    same = F.col("id").eqNullSafe(F.col("__i")) & (F.col("body") == F.col("__b")) & (F.col("number") == F.col("__n"))
    return named.join(first, same, "left").select("id", "body", "number", "component", F.coalesce("__first", F.lit(False)).alias("keep"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_lines (non-blank ones), n_dropped, dropped (their numbers, ascending). Documents without
    such lines have none; a repeated row has the same lines as the first."""
    found = line_components(docs, key, text).groupBy(F.col("id").alias("__i"), F.col("body").alias("__b"))
    lines = found.agg(F.count_distinct("number").alias("n"), F.sort_array(F.collect_set(F.when(~F.col("keep"), F.col("number")))).alias("gone"))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"))
    joined = rows.join(lines, F.col("id").eqNullSafe(F.col("__i")) & (F.col("body") == F.col("__b")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return joined.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of docs, their texts without the lines that do not stay."""
    gone = line_components(docs, key, text).where("not keep").groupBy("id", "body").agg(F.collect_set("number").alias("__gone")).withColumnsRenamed({"id": "__i", "body": "__b"})
    joined = docs.join(keep(gone, "gone"), docs[key].eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text]) == F.col("__b")), "left")
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(x.alias("l"), x.rlike(r"[^\x20\x09-\x0D]").alias("d")))
    # number the non-blank lines and drop those that go
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def step(s, x):
        stays = ~x["d"] | ~F.array_contains("__gone", s["n"])
        return F.struct(F.when(stays, F.concat(s["out"], F.array(x["l"]))).otherwise(s["out"]).alias("out"), (s["n"] + x["d"].cast("int")).alias("n"))

    cut = F.array_join(F.aggregate(lines, start, step)["out"], "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)
