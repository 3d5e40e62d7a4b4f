"""Token ids as Simple-8b words.

A 64-bit word is a 4-bit selector and 60 bits of payload: so many ids of so many bits (`PACKS`), a run of 120 zeros, or an
escape whose id fills the next word. Ids are coded in blocks of `BLOCK`; a frame keeps the word where every block starts, so
all blocks are decoded side by side in numpy. A table of frames is the file: each row is one frame with its partition, place
and documents, written by Spark's committers, so that a lost executor leaves no half file.

Documents are put in ascending key order by a range partitioning (never one task), tokenised with a public vocabulary
whose path is a parameter, and end with the id `END`. A document is never split over frames.

Defined cases: a null or empty text has only the end id; null keys come first; rows of one key are ordered by a hash of
their text; an empty table gives no frames; further columns are not read; ids may be any unsigned 64-bit number.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasig.llm.store import keep
from terrasig.llm.words import slices

END = 0
BLOCK = 256

#: Ids a frame holds before it is closed after the document at hand.
FRAME = 1 << 18

#: Fixed by the coding: ids per word and bits per id for selectors 1 to 14.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE, ZEROS, ZERO_RUN = 0, 15, 120
MAGIC = b"S8B1"

_COUNTS = np.array([1, *[c for c, _ in PACKS], ZERO_RUN], np.int64)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids and the first word of each block."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, np.uint64)
    values[:n] = ids
    width = np.zeros(blocks * BLOCK, np.uint8)  # the selector of the narrowest bits that hold the id, from 15 (zero) down
    for selector in range(14, 0, -1):
        width += values >= np.uint64(1 << PACKS[selector - 1][1])
    width += values > 0
    end = np.full(blocks, BLOCK)
    end[-1] = n - (blocks - 1) * BLOCK
    # the widest of 1, 2, 4 ... 64 ids from every place on; past the end all is narrow
    spans = {1: np.pad(width.reshape(blocks, BLOCK), ((0, 0), (0, ZERO_RUN)))}
    for k in (1, 2, 4, 8, 16, 32):
        spans[2 * k] = np.maximum(spans[k][:, :-k], spans[k][:, k:])
    choice = np.zeros((blocks, BLOCK), np.uint8)  # escape unless something fits
    for selector in range(14, 0, -1):
        count = PACKS[selector - 1][0]
        half = 1 << (count.bit_length() - 1)
        widest = np.maximum(spans[half][:, :BLOCK], spans[half][:, count - half : count - half + BLOCK])
        choice[widest <= selector] = selector
    room = BLOCK - ZERO_RUN + 1
    zeros = (np.maximum(spans[64][:, :room], spans[64][:, ZERO_RUN - 64 : ZERO_RUN - 64 + room]) == 0) & (end[:, None] - np.arange(room) >= ZERO_RUN)
    choice[:, :room][zeros] = ZEROS
    at, words_in, steps = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), []
    alive = np.arange(blocks)
    while len(alive):
        here = at[alive]
        s = choice[alive, here]
        steps.append((alive, words_in[alive], here, s))
        words_in[alive] += 1 + (s == ESCAPE)
        at[alive] += _COUNTS[s]
        alive = alive[at[alive] < end[alive]]
    starts = np.concatenate([[0], words_in.cumsum()])
    block, word, here, s = (np.concatenate(x) for x in zip(*steps, strict=True))
    out = np.zeros(int(starts[-1]), np.uint64)
    to, first = starts[block] + word, block * BLOCK + here
    padded = np.concatenate([values, np.zeros(ZERO_RUN, np.uint64)])
    last = block * BLOCK + end[block]
    for selector in np.unique(s):
        some = np.flatnonzero(s == selector)
        if selector == ESCAPE:
            out[to[some] + 1] = padded[first[some]]
            continue
        packed = np.full(len(some), int(selector) << 60, np.uint64)
        if selector != ZEROS:
            count, bits = PACKS[selector - 1]
            for j in range(count):
                source = first[some] + j
                packed |= np.where(source < last[some], padded[source], np.uint64(0)) << np.uint64(j * bits)
        out[to[some]] = packed
    return out, starts[:-1].astype(np.uint32)


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encoded words."""
    blocks = len(starts)
    out = np.zeros(blocks * BLOCK + ZERO_RUN, np.uint64)
    end = np.full(blocks, BLOCK)
    if blocks:
        end[-1] = n - (blocks - 1) * BLOCK
    at, word, steps = np.zeros(blocks, np.int64), starts.astype(np.int64), []
    alive = np.arange(blocks)
    while len(alive):
        s = (words[word[alive]] >> np.uint64(60)).astype(np.int64)
        steps.append((word[alive], alive * BLOCK + at[alive], s, alive * BLOCK + end[alive]))
        word[alive] += 1 + (s == ESCAPE)
        at[alive] += _COUNTS[s]
        alive = alive[at[alive] < end[alive]]
    if steps:
        where, first, s, last = (np.concatenate(x) for x in zip(*steps, strict=True))
        for selector in np.unique(s):
            some = np.flatnonzero(s == selector)
            if selector == ESCAPE:
                out[first[some]] = words[where[some] + 1]
            elif selector != ZEROS:
                count, bits = PACKS[selector - 1]
                packed = words[where[some]]
                for j in range(count):
                    to = first[some] + j
                    inside = to < last[some]  # the rest of a block's last word is padding
                    out[to[inside]] = (packed[inside] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out[:n]


def pack(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame: header, lengths of its documents and their ids end to end, both coded."""
    parts = []
    for values in (lengths, ids):
        words, starts = encode(values)
        parts.append(struct.pack("<QQ", len(values), len(words)) + starts.astype("<u4").tobytes() + words.astype("<u8").tobytes())
    body = b"".join(parts)
    return MAGIC + struct.pack("<II", BLOCK, zlib.crc32(body)) + body


def unpack(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document lengths and ids of a frame."""
    block, check = struct.unpack("<II", frame[4:12])
    if frame[:4] != MAGIC or block != BLOCK or zlib.crc32(frame[12:]) != check:
        raise ValueError("not a whole frame")
    at, found = 12, []
    for _ in range(2):
        n, size = struct.unpack("<QQ", frame[at : at + 16])
        blocks = -(-n // BLOCK)
        starts = np.frombuffer(frame, "<u4", blocks, at + 16)
        words = np.frombuffer(frame, "<u8", size, at + 16 + 4 * blocks)
        found.append(decode(words, starts, n))
        at += 16 + 4 * blocks + 8 * size
    return found[0], found[1]


class Encoder:
    """Ids of whole texts by the tokenizers library; pieces between single spaces are encoded once.

    With this vocabulary a space between two other signs always starts a token, so a text is the pieces' ids in a row, and
    new pieces are given to the library in long runs whose ids are cut where a token opens with a space. Texts in which a
    space touches further white space, or that hold a token added to the vocabulary, are given to the library whole.
    """

    #: Pieces that a task keeps at most; then it learns anew.
    PIECES = 400_000
    #: Pieces in one call of the library.
    RUN = 500
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self._mixed = re.compile("|".join([r"\s\s", *added]))
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        self.opens[[i for token, i in self.library.get_vocab().items() if token.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces with a space before them."""
        ends = [p for p in new if not p or p[-1].isspace()]  # of a text: in a run they would touch the next space
        self.known.update(zip(ends, self._encode([" " + p for p in ends]), strict=True))
        new = [p for p in new if p and not p[-1].isspace()]
        raw = b"".join(self._encode([" " + " ".join(new[i : i + self.RUN]) for i in range(0, len(new), self.RUN)]))
        at = [*(4 * np.flatnonzero(self.opens[np.frombuffer(raw, np.uint32)])).tolist(), len(raw)]
        self.known.update(zip(new, [raw[a:b] for a, b in pairwise(at)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.PIECES:
            self.known = {}
        plain = [None if self._mixed.search(t) else t.split(" ") for t in texts]
        self._learn(list({p for x in plain if x for p in x[1:]}.difference(self.known)))
        heads = iter(self._encode([x[0] for x in plain if x is not None]))
        whole = iter(self._encode([t for t, x in zip(texts, plain, strict=True) if x is None]))
        known = self.known.__getitem__
        return [next(whole) if x is None else next(heads) + b"".join(map(known, x[1:])) for x in plain]


def write(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise and write all documents; returns the written table of frames (part, seq, first, keys, frame): `first` is the
    number of ids before the frame in its part, parts and their frames are in ascending key order."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        coder = Encoder(vocabulary)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        keys, ids, held = [], [], 0
        end = np.array([END], np.uint32).tobytes()

        def frame():
            flat = np.frombuffer(b"".join(ids), np.uint32)
            lengths = np.array([len(x) // 4 for x in ids], np.uint64)
            column = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(keys))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()), column, pa.array([pack(lengths, flat)], pa.binary())], names=["part", "seq", "first", "n_ids", "keys", "frame"]), len(flat)

        for batch in slices(batches, "text", 1 << 19):
            found = coder([t or "" for t in batch.column("text").to_pylist()])
            for i, body in enumerate(found):
                keys.append(batch.column("key").slice(i, 1))
                ids.append(body + end)
                held += len(body) // 4 + 1
                if held >= FRAME:
                    out, n = frame()
                    yield out
                    seq, first, keys, ids, held = seq + 1, first + n, [], [], 0
        if ids:
            yield frame()[0]

    ordered = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
    return keep(ordered.mapInArrow(run, f"part int, seq int, first long, n_ids long, keys array<{kind}>, frame binary"), "frames")


def _starts(frames: DataFrame) -> DataFrame:
    """Frames with `start`, the ids before them in the whole file. One row per part is added up, never one per frame."""
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return frames.join(offsets, "part").withColumn("start", F.col("offset") + F.col("first"))


def read(frames: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document with its ids: key, start (ids before it), ids."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = unpack(batch.column("frame")[i].as_py())
                edges = np.concatenate([[0], lengths.cumsum()]).astype(np.int64)
                column = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("keys").slice(i, 1).flatten(), pa.array(edges[:-1] + batch.column("start")[i].as_py()), column], names=["key", "start", "ids"])

    kind = frames.schema["keys"].dataType.elementType.simpleString()
    out = _starts(frames).select("keys", "start", "frame").mapInArrow(run, f"key {kind}, start long, ids array<long>")
    return out.withColumnRenamed("key", key)


def digests(frames: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the files hold of each document: key, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = unpack(batch.column("frame")[i].as_py())
                edges = np.concatenate([[0], lengths.cumsum()]).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("keys").slice(i, 1).flatten(), pa.array(edges[:-1] + batch.column("start")[i].as_py()), pa.array(lengths.view(np.int64)), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    kind = frames.schema["keys"].dataType.elementType.simpleString()
    out = _starts(frames).select("keys", "start", "frame").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
