"""Near copies by HyperMinHash: compressed registers, banded, with a collision-corrected estimate before verification.

Texts are sets of distinct three-word shingles (64-bit hashes); two link at a Jaccard similarity of 0.85 or more. Equal sets
are one node from the start.

1. Registers. Shingles are hashed into 128 buckets; a bucket keeps its least hash, of which only the number of leading zeros
   (6 bits) and the 10 mantissa bits after the first one are stored: 256 bytes a set. A bucket that stays empty is
   filled by the set's shingles hashed anew, round after round, so a register of two sets agrees with the chance of
   their similarity at every size. Sets below six shingles only link with equal ones.
2. Banding. 25 bands of 5 registers: sets at exactly 0.85 share none with a chance of 4e-7.
3. Estimate. The share of equal registers, less what unequal hashes share by chance at the two sizes, must reach `ESTIMATE`
   (0.70, 4.7 standard deviations below 0.85). Every band's members are first held against its least member; those that
   reach it are one family with it. Members of different families are then compared in blocks, two at a time, and a task
   returns a spanning forest of what reaches the estimate. So all links lie inside families, and no list of all pairs is
   ever made.
4. Verification on full sets. A set is first held against the member of highest estimate it met; links make components.
   Where a family has several, members of different ones that reach the estimate are counted exactly, in blocks again.
5. Union-find is distributed; the hot side of a family (its largest part) is never compared with itself.

No step has a cap; what banding and the estimate can miss is the chance stated above, of the same size for every input.

Defined cases: a set without words or text is empty, linked with nothing, and its own component; fewer than three words are
one shingle of the whole sequence; rows that repeat an id or a text are separate rows; null ids are named by no component, a
row without id is kept where its component has no id at all; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.llm.components import components
from terrasig.llm.store import keep
from terrasig.llm.words import mix, sets, slices

WIDTH = 3
#: Link at `LINK` per cent or more; below `LEAST` shingles only equal sets reach it.
LINK, LEAST = 85, 6

BUCKETS, MANTISSA = 128, 10
BANDS, ROWS = 25, 5
ESTIMATE = 0.70

#: Bytes of text hashed at once; rows of a block of registers; tokens of a block of sets.
SLICE, REGISTERS, TOKENS = 1 << 20, 512, 150_000

_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def encode(least: np.ndarray, turn: int) -> np.ndarray:
    """The register of a bucket's least hash (57 bits at the top): leading zeros and the bits after the first one. Every
    turn of filling shifts it, so that turns do not agree but by chance."""
    top = (least >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    zeros = np.where(least > 0, 52 - np.frexp(np.maximum(top, 0.5))[1] + 1, 53).astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(53))
    after = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) + after + np.uint64(turn * 0x9E37 & 0xFFFF)).astype(np.uint16)


def registers(found: list[np.ndarray]) -> np.ndarray:
    """A row of `BUCKETS` registers for each set of distinct hashes, none of which may be empty."""
    n = len(found)
    out, full = np.zeros(n * BUCKETS, np.uint16), np.zeros(n * BUCKETS, bool)
    least = np.full(n * BUCKETS, _ALL, np.uint64)
    tokens = np.concatenate([*found, np.zeros(0, np.uint64)])
    first = np.repeat(np.arange(n) * BUCKETS, [len(s) for s in found])
    turn = 0
    while len(tokens):
        h = mix(tokens + np.uint64((turn + 1) * _STEP & _ALL))
        slot = first + (h >> np.uint64(57)).astype(np.int64)
        open_ = ~full[slot]
        slot = slot[open_]
        np.minimum.at(least, slot, h[open_] << np.uint64(7))
        out[slot] = encode(least[slot], turn)
        full[slot] = True
        if turn < 4 or turn % 8 == 0:
            more = ~full.reshape(n, BUCKETS).all(axis=1)[first // BUCKETS]
            tokens, first = tokens[more], first[more]
        turn += 1
    return out.reshape(n, BUCKETS)


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that a register of two unequal least hashes agrees, for sets of n and m shingles: equal leading zeros
    and equal mantissas."""
    # 1 - 2^-i is the chance of a hash to have i leading zeros at most; a bucket gets a shingle of 128
    i = np.arange(0, 41)
    above = np.exp(np.log1p(-(2.0**-i) / BUCKETS)[None, :] * np.asarray(n, np.float64)[:, None])
    other = np.exp(np.log1p(-(2.0**-i) / BUCKETS)[None, :] * np.asarray(m, np.float64)[:, None])
    return (np.diff(above, axis=1) * np.diff(other, axis=1)).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of registers of sets of n and m shingles."""
    same = (a == b).mean(axis=1)
    chance = by_chance(n, m)
    return np.maximum(0, (same - chance) / (1 - chance))


def _key(tokens: np.ndarray) -> int:
    """64 bits of a set: equal sets have equal keys."""
    total = int(mix(tokens).sum(dtype=np.uint64)) + len(tokens) * _STEP
    return int(mix(np.array([total & _ALL], np.uint64))[0].view(np.int64))


def _sketch(batches):
    for batch in slices(batches, "text", SLICE):
        found = sets(batch.column("text"), WIDTH)
        sizes = np.array([len(s) for s in found], np.int64)
        wide = np.flatnonzero(sizes >= LEAST)
        rows: list[bytes | None] = [None] * len(found)
        for i, r in zip(wide.tolist(), registers([found[i] for i in wide]), strict=True):
            rows[i] = r.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("body"), pa.array([_key(s) for s in found], pa.int64()), pa.array(sizes), pa.array(rows, pa.binary())],
            names=["id", "body", "node", "n", "registers"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    """Registers of all rows of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _banded(batches):
    for batch in batches:
        r = _matrix(batch.column("registers")).astype(np.uint64)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), r.shape[:2])
        for j in range(ROWS):
            key = mix(key * np.uint64(_STEP) + r[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["band", "node"])


def _estimated(batches):
    """Pairs with both registers to those that reach the estimate."""
    for batch in batches:
        if batch.num_rows:
            found = estimate(_matrix(batch.column("r")), _matrix(batch.column("s")), batch.column("n").to_numpy(), batch.column("m").to_numpy())
            good = np.flatnonzero(found >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(good)), batch.column("centre").take(pa.array(good)), pa.array(found[good])], names=["node", "centre", "likeness"])


def _tasks(batches, key: str):
    """Tables of whole groups out of batches that are sorted by `key`; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            held.append(batch.slice(0, int(cut[-1])))
            yield pa.Table.from_batches(held)
            held = []
            batch = batch.slice(int(cut[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n is connected to by the pairs (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _families(batches):
    """Groups of registers to (node, other) edges that connect what reaches the estimate across labels."""
    for table in _tasks(batches, "task"):
        task, node, label, n = (table.column(c).to_numpy() for c in ("task", "node", "label", "n"))
        rows = _matrix(table.column("registers"))
        last = np.searchsorted(task, task, side="right")
        a_all, b_all = [], []
        left = np.arange(len(task))
        shift = 1
        while True:
            left = left[left + shift < last[left]]
            if not len(left):
                break
            right = left + shift
            other = label[left] != label[right]
            a, b = left[other], right[other]
            if len(a):
                good = estimate(rows[a], rows[b], n[a], n[b]) >= ESTIMATE
                a_all.append(a[good])
                b_all.append(b[good])
            shift += 1
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a_all, b_all))
        least = forest(a, b, len(task))
        moved = np.flatnonzero(least != np.arange(len(task)))
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[least[moved]])], names=["a", "b"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets of distinct hashes link."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * shared >= LINK * (len(a) + len(b) - shared)


def _links(batches):
    """Groups of whole sets to links (a, b) across labels, enough to connect all that link."""
    for table in _tasks(batches, "task"):
        task, node, label, n = (table.column(c).to_numpy() for c in ("task", "node", "label", "n"))
        rows = _matrix(table.column("registers"))
        column = table.column("tokens").combine_chunks()
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        found: list[tuple[int, int]] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True):
            mine = label[start:end].copy()  # merged as links are found
            for i in range(end - start):
                j = np.arange(i + 1, end - start)
                j = j[(mine[j] != mine[i]) & (100 * np.minimum(n[start + i], n[start + j]) >= LINK * np.maximum(n[start + i], n[start + j]))]
                if not len(j):
                    continue
                near = estimate(np.broadcast_to(rows[start + i], (len(j), BUCKETS)), rows[start + j], np.full(len(j), n[start + i]), n[start + j]) >= ESTIMATE
                for k in j[near].tolist():
                    if mine[k] != mine[i] and linked(values[offsets[start + i] : offsets[start + i + 1]], values[offsets[start + k] : offsets[start + k + 1]]):
                        found.append((int(node[start + i]), int(node[start + k])))
                        mine[mine == mine[k]] = mine[i]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _whole(batches):
    for batch in slices(batches, "text", SLICE):
        found = [s.view(np.int64) for s in sets(batch.column("text"), WIDTH)]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
        # distinct hashes in ascending order as signed numbers
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*(np.sort(s) for s in found), np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([pa.array([_key(s.view(np.uint64)) for s in found], pa.int64()), tokens], names=["node", "tokens"])


def _blocks(rows: DataFrame, group: str, weight: Column, size: int) -> DataFrame:
    """Rows (group, node, label) of groups that hold several labels, with the `task` ids they are to be compared in. The
    label of most weight is cut into blocks of its own, which meet the blocks of all others but not each other."""
    parts = rows.groupBy(group, "label").agg(F.sum(weight).alias("w"))
    spread = parts.groupBy(group).agg(F.count(F.lit(1)).alias("labels"), F.sum("w").alias("w"), F.max(F.struct("w", "label")).alias("most"))
    spread = spread.where("labels > 1").select(
        group,
        F.col("most.label").alias("main"),
        F.ceil(F.col("most.w") / size).cast("int").alias("mains"),
        F.ceil((F.col("w") - F.col("most.w")) / size).cast("int").alias("others"),
    )
    dealt = rows.join(spread, group).withColumn("at", F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "others")))
    other = F.sequence(F.lit(0), F.col("others") - 1)
    own = lambda j: F.xxhash64(F.col(group), F.lit("o"), F.least("at", j), F.greatest("at", j))
    cross = lambda i, j: F.xxhash64(F.col(group), F.lit("m"), i, j)
    tasks = F.when(F.col("label") == F.col("main"), F.transform(other, lambda j: cross(F.col("at"), j.cast("long")))).otherwise(
        F.concat(F.transform(other, lambda j: own(j.cast("long"))), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: cross(i.cast("long"), F.col("at"))))
    )
    return dealt.select("node", "label", F.explode(F.array_distinct(tasks)).alias("task"))


def _in_tasks(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, schema)


def _links_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that span every component; texts (id, body, text), nodes (node, n, registers, at)."""
    bands = nodes.select("node", "registers").mapInArrow(_banded, "band long, node long")
    groups = bands.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    placed = keep(bands.join(groups, "band"), "bands")

    sketches = nodes.select("node", "n", "registers")
    met = placed.where("node <> centre").select("node", "centre").distinct()
    both = met.join(sketches.select("node", "n", F.col("registers").alias("r")), "node")
    both = both.join(sketches.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("registers").alias("s")), "centre")
    near = keep(both.mapInArrow(_estimated, "node long, centre long, likeness double"), "near")

    # one hop to the least centre is enough to tell most members of a family that they are in it
    hop = near.groupBy("node").agg(F.min("centre").alias("label"))
    named = keep(placed.select("band", "node").join(hop, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "named")
    apart = _blocks(named, "band", F.lit(1), REGISTERS).join(sketches, "node")
    more = _in_tasks(apart, _families, "a long, b long").distinct()
    edges = near.select(F.col("node").alias("a"), F.col("centre").alias("b")).unionByName(more)
    families = keep(components(edges).distinct(), "family")

    # whole sets of the members of families, from one row of each
    chosen = nodes.join(families, "node", "left_semi").select(F.xxhash64("at.id", "at.body").alias("row"))
    whole = texts.withColumn("row", F.xxhash64("id", "body")).join(chosen, "row", "left_semi").select("text").mapInArrow(_whole, "node long, tokens array<long>")
    whole = keep(whole.dropDuplicates(["node"]).join(families, "node").join(sketches, "node"), "sets")

    best = near.groupBy("node").agg(F.max(F.struct("likeness", "centre")).alias("x")).select("node", F.col("x.centre").alias("centre"))
    pair = best.join(whole.select("node", "n", "tokens"), "node").join(whole.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("tokens").alias("other")), "centre")
    shared = F.size(F.array_intersect("tokens", "other"))
    sure = pair.withColumn("o", shared).where(100 * F.col("o") >= LINK * (F.col("n") + F.col("m") - F.col("o")))
    sure = keep(sure.select(F.col("node").alias("a"), F.col("centre").alias("b")), "sure")

    # a centre is less than its members, so two hops end at a centre's centre
    up = sure.select(F.col("a").alias("b"), F.col("b").alias("top"))
    label = sure.join(up, "b", "left").select(F.col("a").alias("node"), F.coalesce("top", "b").alias("label"))
    rows = families.select("node", F.col("root").alias("family")).join(label, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label"))
    rows = keep(rows.join(whole.select("node", "n"), "node"), "parts")
    open_ = _blocks(rows, "family", F.col("n"), TOKENS).join(whole.select("node", "n", "registers", "tokens"), "node")
    return sure.unionByName(_in_tasks(open_, _links, "a long, b long"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least key of its component), kept."""
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sketched = keep(texts.mapInArrow(_sketch, f"id {kind}, body long, node long, n long, registers binary"), "sketches")
    nodes = sketched.where(F.col("registers").isNotNull()).groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("registers").alias("registers"), F.min(F.struct("id", "body")).alias("at"))
    nodes = keep(nodes, "nodes")
    roots = components(_links_of(texts, nodes))
    least = sketched.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    least = least.join(roots, "node", "left").where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    least = keep(least, "least")
    by_root = least.groupBy("root").agg(F.min("least").alias("component"))
    shared = least.join(by_root, "root").select("node", "component")
    named = sketched.select("id", "node", "n").join(shared, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return named.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
