"""Vector code compression: integer product codes, found by a Walsh-Hadamard transform with early elimination.

Components become integers floor(1024 x); vectors are cut into four equal parts. A part and a codebook entry, padded with
zeros to a power of two P, are transformed by the integer Walsh-Hadamard matrix, whose rows are taken in sequency order (by
their number of sign changes). Squared differences of the transforms add up to P times the squared distance, and every
partial sum is a lower bound of it, so that an entry whose partial sum is above the whole sum of another entry is dropped.
All of it is in 64-bit integers: distances and ties are exact.

A round assigns every part in the tasks; a task sends sums and counts of each entry only, Spark adds them, and the driver
holds the codebooks alone, 1,024 entries whatever the number of vectors. The integer vectors are a table in the shared folder
that every round reads again.

Defined cases: vectors that are null, empty, or hold a null or non-finite component are dropped, and so are those whose
length is not that of the first kept vec_id, or not a multiple of four; integers beyond +-(2^30 / P) are held to that limit,
so that no sum can overflow; a null vec_id comes after all others in the first codebooks, equal vec_ids are ordered by their
components; fewer than 256 kept rows give as many entries; null labels are one label; repeated rows are rows; an empty table
gives no rows; further columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.llm.store import keep

#: Fixed by the query's contract.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Vectors whose distances a task holds at once: 256 sums each.
TOGETHER = 1024


def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def padded(width: int) -> int:
    """The power of two that a part of `width` components is padded to."""
    return 1 << max(0, (width - 1).bit_length())


def transform(parts: np.ndarray) -> np.ndarray:
    """Rows of integers to their transforms in sequency order."""
    size = padded(parts.shape[1])
    return parts @ hadamard(size)[:, : parts.shape[1]].T


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, ties to the lower index. Both are transforms."""
    n, size = parts.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # the first look takes a quarter of the sequencies, each further one as many again
    step = max(1, size // 4)
    for a in range(0, n, TOGETHER):
        part = parts[a : a + TOGETHER]
        partial = np.zeros((len(part), len(entries)), np.int64)
        for s in range(step):
            partial += (part[:, s : s + 1] - entries[:, s]) ** 2
        guess = partial.argmin(axis=1)
        limit = ((part - entries[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero(partial <= limit[:, None])
        sums = partial[row, entry]
        for at in range(step, size, step):
            here = slice(at, at + step)
            sums = sums + ((part[row, here] - entries[entry, here]) ** 2).sum(axis=1)
            live = sums <= limit[row]
            row, entry, sums = row[live], entry[live], sums[live]
        # survivors are in order of row and entry, so that the first of the least sums has the lowest index
        first = np.searchsorted(row, np.arange(len(part)))
        least = np.minimum.reduceat(sums, first)
        hit = np.flatnonzero(sums == least[row])
        _, once = np.unique(row[hit], return_index=True)
        index[a : a + TOGETHER] = entry[hit[once]]
        distance[a : a + TOGETHER] = least // size
    return index, distance


def _integers(width: int):
    """Batches of (vec_id, label, embedding) to the kept rows with their integers, clamped."""
    limit = (1 << 30) // padded(width // PARTS)

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            right = np.diff(offsets) == width
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            at = np.flatnonzero(right)
            rows = x[(offsets[at] - offsets[0])[:, None] + np.arange(width)]
            fine = np.isfinite(rows).all(axis=1)
            whole = np.floor(np.clip(rows[fine] * SCALE, -limit, limit)).astype(np.int64)
            chosen = batch.take(pa.array(at[fine]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * width), pa.array(whole.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([chosen.column("vec_id"), chosen.column("label"), flat], names=["vec_id", "label", "v"])

    return run


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    lists = batch.column("v")
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64).reshape(-1, width)


def _assign(vectors: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), a column for each part."""
    wide = vectors.shape[1] // PARTS
    found = [nearest(transform(vectors[:, p * wide : (p + 1) * wide]), transform(codebooks[p])) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(held, width: int):
    """What a task adds up: for each part and entry the sum of its parts and their number."""

    def run(batches):
        codebooks = held.value
        wide, size = width // PARTS, len(codebooks[0])
        total = np.zeros((PARTS, size, wide), np.int64)
        count = np.zeros((PARTS, size), np.int64)
        for batch in batches:
            vectors = _matrix(batch, width)
            codes, _ = _assign(vectors, codebooks)
            for p in range(PARTS):
                np.add.at(total[p], codes[:, p], vectors[:, p * wide : (p + 1) * wide])
                count[p] += np.bincount(codes[:, p], minlength=size)
        p, e = np.nonzero(count)
        if len(p):
            rows = np.column_stack([count[p, e], total[p, e]])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), flat], names=["part", "entry", "sums"])

    return run


def _coder(held, width: int):
    def run(batches):
        codebooks = held.value
        for batch in batches:
            codes, distances = _assign(_matrix(batch, width), codebooks)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(distances.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """The kept rows (vec_id, label, v) as a table, and the length of their vectors (0 if none is kept)."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    width = first[0] if first and first[0] % PARTS == 0 else 0
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>"
    if not width:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("v")).limit(0), 0
    return keep(rows.mapInArrow(_integers(width), schema), "vectors"), width


def fit(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of the four parts, from (vec_id, label, v) rows."""
    spark = rows.sparkSession
    seed = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()], np.int64)
    wide = width // PARTS
    codebooks = [seed[:, p * wide : (p + 1) * wide].copy() for p in range(PARTS)]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(codebooks)
        part = rows.mapInArrow(_sums(held, width), "part int, entry int, sums array<long>")
        added = part.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(wide + 1)])
        codebooks = [c.copy() for c in codebooks]
        for r in added.collect():  # at most one row for each entry of each part
            codebooks[r["part"]][r["entry"]] = np.array([r[f"s{i}"] for i in range(1, wide + 1)], np.int64) // r["s0"]
    return codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: key, code, error, label_error, codebooks_sha256."""
    rows, width = integer_vectors(vectors, key, embedding, label)
    codebooks = fit(rows, width, entries, rounds) if width else []
    if not width:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        held = rows.sparkSession.sparkContext.broadcast(codebooks)
        coded = keep(rows.mapInArrow(_coder(held, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


def decode(codes: DataFrame, codebooks: list[np.ndarray], code: str = "code", name: str = "decoded") -> DataFrame:
    """Add `name`: the integer vector that each code stands for."""
    held = codes.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(code).to_pylist())), np.uint8).reshape(-1, PARTS)
            rows = np.concatenate([held.value[p][at[:, p]] for p in range(PARTS)], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, name])

    return codes.mapInArrow(run, codes.select("*", F.lit(None).cast("array<long>").alias(name)).schema)
