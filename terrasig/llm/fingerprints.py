"""Document fingerprints: threshold-scaled sketches.

A sketch retains every 48-bit five-word shingle hash below a fixed fraction (`1 / SCALE`) of the hash range, so sketches of a
short and of a very long text stay comparable, and the union of sketches is the sketch of the union. A text with fewer
than `FLOOR` such hashes keeps its lowest `FLOOR` ones besides, and so has a higher threshold of its own; two sketches are
compared below the lower of their thresholds.

A fingerprint is a sign (`*` all hashes, `+` own threshold, `=` the fixed fraction) and the ascending hashes, six bytes each,
in base64: equal texts have equal fingerprints.

Defined cases: null is the empty text; texts without words have the fingerprint `*`, like each other (1) and unlike any other
(0); fewer than five words are one shingle; keys are integers, a null key is the lowest, rows of one key are ordered by a hash
of their text; a single row is its own next; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.llm.words import sets, slices

SCALE = 8
FLOOR = 64
RANGE = 1 << 48


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The retained hashes of ascending 64-bit hashes, as 48 bits, and the threshold below which they are complete."""
    small = np.unique(hashes >> np.uint64(16))
    fixed = int(np.searchsorted(small, np.uint64(RANGE // SCALE)))
    if len(small) <= FLOOR:
        return small, RANGE
    if fixed >= FLOOR:
        return small[:fixed], RANGE // SCALE
    return small[:FLOOR], int(small[FLOOR - 1]) + 1


def sketches(texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
    return [sketch(s) for s in sets(pa.array(texts, pa.large_string()))]


def to_text(found: tuple[np.ndarray, int]) -> str:
    hashes, limit = found
    sign = "*" if limit == RANGE else "=" if limit == RANGE // SCALE else "+"
    body = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return sign + base64.b64encode(body).decode()


def from_text(fingerprint: str) -> tuple[np.ndarray, int]:
    rows = np.frombuffer(base64.b64decode(fingerprint[1:]), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, 2:] = rows
    hashes = wide.view(">u8").reshape(-1).astype(np.uint64)
    return hashes, {"*": RANGE, "=": RANGE // SCALE}.get(fingerprint[0]) or int(hashes[-1]) + 1


def merge(*found: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """The sketch of all texts together."""
    limit = min(x[1] for x in found)
    hashes = np.unique(np.concatenate([x[0][x[0] < np.uint64(limit)] for x in found]))
    return hashes, limit


def _common(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[int, int, int]:
    limit = np.uint64(min(a[1], b[1]))
    x, y = a[0][: np.searchsorted(a[0], limit)], b[0][: np.searchsorted(b[0], limit)]
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    both, x, y = _common(a, b)
    if not len(a[0]) and not len(b[0]):
        return 1.0
    return both / (x + y - both) if x + y else 0.0


def containment(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated share of a's shingles that b has."""
    both, x, _ = _common(a, b)
    if not len(a[0]):
        return 1.0
    return both / x if x else 0.0


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All rows and columns with the fingerprint of the text; no shuffle."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([to_text(s) for t in texts for s in sketches([t])])

    return docs.withColumn(name, of(F.col(text)))


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All rows in buckets of descending keys: (bucket, borrowed, key, text), sorted. Each bucket ends with the first row of
    the next one (the last bucket with the first row of all), so every own row has its next row beside it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("h"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("at", shares, 10000).alias("c")).first()["c"] or []
    splits = [-float("inf"), *sorted({0.0, *map(float, cuts)}), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="b").transform(rows.withColumn("place", F.col("at").cast("double"))).withColumn("b", F.col("b").cast("int"))
    # one row per bucket, no more than four per shuffle partition
    heads = sorted((r["b"], r["head"]) for r in dealt.groupBy("b").agg(F.max("at").alias("head")).collect())
    turns = [(b, head, heads[(i + 1) % len(heads)][0]) for i, (b, head) in enumerate(heads)]
    lent = spark.createDataFrame(turns, "b int, head long, above int")
    own = F.struct(F.col("b").alias("bucket"), F.lit(0).alias("borrowed"))
    again = F.struct(F.col("above").alias("bucket"), F.lit(1).alias("borrowed"))
    places = F.when(F.col("at") == F.col("head"), F.array(own, again)).otherwise(F.array(own))
    copied = dealt.join(F.broadcast(lent), "b").select("key", "at", "text", "h", F.explode(places).alias("p")).select("key", "at", "text", "h", "p.*")
    return copied.repartition("bucket").sortWithinPartitions("bucket", "borrowed", F.desc("at"), "h").select("bucket", "borrowed", "key", "text")


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document, its fingerprint, that of its edited text (its last third replaced by the start of the next
    document, descending key), and their likeness and containment with each other and the next document's."""
    ordered = _in_order(docs, key, text)
    kind = ordered.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double, kept_in_next double"

    def run(batches):
        carry: list = []
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            rows = carry + list(zip(batch.column("bucket").to_pylist(), batch.column("borrowed").to_pylist(), [batch.column("key").slice(i, 1) for i in range(batch.num_rows)], texts, sketches(texts), strict=True))
            done = [(r, s) for r, s in zip(rows, rows[1:], strict=False) if not r[1] and r[0] == s[0]]
            carry = rows[-1:]
            if not done:
                continue
            edited = [r[3][: len(r[3]) - len(r[3]) // 3] + s[3][: len(r[3]) // 3] for r, s in done]
            new = sketches(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([r[2] for r, _ in done]),
                    pa.array([len(r[3]) for r, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([to_text(r[4]) for r, _ in done]),
                    pa.array([to_text(e) for e in new]),
                    pa.array([likeness(r[4], e) for (r, _), e in zip(done, new, strict=True)], pa.float64()),
                    pa.array([likeness(r[4], s[4]) for r, s in done], pa.float64()),
                    pa.array([containment(r[4], e) for (r, _), e in zip(done, new, strict=True)], pa.float64()),
                    pa.array([containment(r[4], s[4]) for r, s in done], pa.float64()),
                ],
                names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited", "kept_in_next"],
            )

    return ordered.mapInArrow(run, schema).withColumnRenamed("key", key)
