"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, native.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Each benchmark item gives its windows of ten
consecutive words, or one shorter window if it has fewer. Every document window's hash is probed against the set, hits
are verified word by word, and the words inside hits are counted, cut out as spans, or their documents are dropped.

The set is broadcast only while `BROADCAST_WINDOWS` bounds it (counted first); a larger benchmark is joined by shuffle
on the same hash, with each window's own words carried for the check.

Defined cases: null and empty texts have no words and are clean; items without words have no windows; equal documents
get equal results; a null item_id counts as no item; documents' further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.llm.store import keep

#: Fixed by the query's contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10

#: At about 300 bytes a window, at most some 600 MB; beyond it the join is by shuffle.
BROADCAST_WINDOWS = 2_000_000

#: Names of hit texts, 16 bytes each and a hash table's own, that are sent to every task; beyond it all texts are joined by shuffle.
BROADCAST_TEXTS = 500_000

#: Words and separators before lower-casing.
_WRITTEN, _BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _windows_of(words_col: Column, width: int, carry: bool) -> Column:
    """All windows of a width as (pos, width, hash[, gram])."""

    def one(i: Column) -> Column:
        gram = F.slice(words_col, i + 1, width)
        fields = [i.alias("pos"), F.lit(width).alias("width"), F.xxhash64(gram).alias("hash")]
        return F.struct(*fields, *([gram.alias("gram")] if carry else []))

    n = F.size(words_col)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), one))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (item, width, hash, gram) of all items."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.size("w").alias("width"), F.xxhash64("w").alias("hash"), F.col("w").alias("gram")))
    each = F.when(F.size("w") < width, whole).otherwise(_windows_of(F.col("w"), width, True))
    return items.select("item", F.explode(each).alias("x")).select("item", "x.width", "x.hash", "x.gram").distinct()


def hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified hits: (key, body, pos, width, gram); body is the hash of the text, which tells rows of one key apart."""
    grams = windows.select("width", "hash", "gram").distinct()
    bound = [r["width"] for r in grams.select("width").distinct().collect()]  # at most ten widths
    small = grams.count() <= BROADCAST_WINDOWS
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    if not bound:
        return base.select("key", "body", F.lit(0).alias("pos"), F.lit(0).alias("width"), F.col("w").alias("gram")).limit(0)
    every = F.concat(*[F.coalesce(_windows_of(F.col("w"), n, not small), F.array()) for n in sorted(bound)]) if len(bound) > 1 else _windows_of(F.col("w"), bound[0], not small)
    # a window's row does not carry the text's words: that would be quadratic in the text
    rows = base.select("key", "body", F.explode(every).alias("x")).select("key", "body", "x.*")
    probe = grams.select("width", "hash", F.col("gram").alias("sought"))
    if not small:
        met = rows.join(probe, ["hash", "width"]).where(F.col("gram") == F.col("sought"))
        return met.select("key", "body", "pos", "width", F.col("sought").alias("gram")).distinct()
    met = keep(rows.join(F.broadcast(probe.select("hash", "width").distinct()), ["hash", "width"]).select("key", "body", "pos", "width", "hash").distinct(), "met")
    # the words of the few texts that are hit are taken again, to verify each hit word by word
    near = met.groupBy(F.col("key").alias("__key"), F.col("body").alias("__body")).agg(F.collect_set(F.struct("pos", "width", "hash")).alias("at"))
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    names = near.select("__key", "__body")
    if names.count() <= BROADCAST_TEXTS:
        # the other texts stay where they are
        texts = texts.join(F.broadcast(names), F.col("key").eqNullSafe(F.col("__key")) & (F.col("body") == F.col("__body")), "left_semi")
    found = texts.join(near, F.col("key").eqNullSafe(F.col("__key")) & (F.col("body") == F.col("__body"))).select("key", "body", "at", words(F.col("text")).alias("w"))
    held = F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["width"].alias("width"), x["hash"].alias("hash"), F.slice("w", x["pos"] + 1, x["width"]).alias("gram")))
    sure = found.select("key", "body", F.explode(held).alias("x")).select("key", "body", "x.*").join(F.broadcast(probe), ["hash", "width"]).where(F.col("gram") == F.col("sought"))
    return sure.select("key", "body", "pos", "width", "gram").distinct()


def _covered(spans: Column) -> Column:
    """Words inside at least one of the sorted spans (pos, to)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def step(state: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["to"] - F.greatest(span["pos"], state["reach"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["reach"], span["to"]).alias("reach"))

    return F.aggregate(spans, start, step)["n"]


def _spans(found: DataFrame) -> DataFrame:
    """Each hit document's spans in order, as (pos, to) word positions."""
    span = F.struct("pos", (F.col("pos") + F.col("width")).alias("to"))
    return found.groupBy("key", "body").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (ids as strings, sorted)."""
    windows = item_windows(benchmark, item_id, text, width)
    found = keep(hits(docs, windows, key, text), "hits")
    names = windows.where(F.col("item").isNotNull()).select("item", "gram").distinct()
    # each document's distinct grams meet the grams' items; both sides are as small as the contamination
    by_item = found.select("key", "body", "gram").distinct().join(names, "gram").groupBy("key", "body").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_doc = _spans(found).select("key", "body", _covered(F.col("spans")).cast("long").alias("n_hit")).join(by_item, ["key", "body"], "left")
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    same = base["key"].eqNullSafe(per_doc["key"]) & (base["body"] == per_doc["body"])
    return base.join(per_doc, same, "left").select(
        base["key"].alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", key: str = "doc_id", text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """The documents without contamination: mode `documents` drops every hit document, `spans` cuts the hit words (with the
    separators after them) out of its text. Clean rows are returned as they are."""
    found = hits(docs, item_windows(benchmark, item_id, text, width), key, text)
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    spans = _spans(found).select(F.col("key").alias("__key"), F.col("body").alias("__body"), F.col("spans").alias("__spans"))
    same = docs[key].eqNullSafe(spans["__key"]) & (F.xxhash64(docs[text]) == spans["__body"])
    if mode == "documents":
        return docs.join(spans, same, "left_anti")
    joined = docs.join(spans, same, "left")
    # a text is its leading separators and then words, each with the separators after it
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{_WRITTEN}{_BETWEEN}*"), F.lit(0))
    lead = F.regexp_extract(F.col(text), f"^{_BETWEEN}*", 0)
    inside = lambda i: F.exists("__spans", lambda s: (s["pos"] <= i) & (i < s["to"]))
    left = F.transform(pieces, lambda x, i: F.when(inside(i), F.lit("")).otherwise(x))
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.withColumn(text, cut).select(*docs.columns)
