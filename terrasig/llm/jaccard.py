"""N-gram Jaccard join with a token-group matrix, exact.

Texts are sets of distinct five-word shingles (64-bit hashes); two link at a Jaccard similarity of 0.8 or more. Equal sets
are one node from the start, so copies cost nothing.

1. Screening. A linked set shares at least 4/5 of its tokens with its partner, so of its n//5 + k smallest hashes at least k
   are shared with another set (k = n/10, at least 1). Only those tokens are shuffled, in packs of sets of which each bucket
   of tokens gets 32 bits a token and counts; one that many sets of a pack have is sent once. Tokens that agree in these bits
   only let more sets through. Most sets end here. That is the matrix's root: one group of all other sets.
2. Of the rest every token is counted. Less than 4/5 shared ends a set; the others order their tokens by count, rare first.
3. Groups. Sets with the same least shared token form a group; each is verified against the group's most central set, and
   what links is one cluster. Clusters and the leftovers of each group, cut into blocks of `BLOCK` tokens, are the groups.
4. Token-group matrix. A set can only link into a group whose members' rare prefix (n//5 + 1 tokens) meets its own. For such
   pairs of set and group the overlap with the group's token union is the bound; only groups with 4/5 of the set's
   tokens are opened, and overlaps with all their members are counted at once.
5. Links and clusters go to a distributed union-find.

Nothing is sampled or capped: each filter follows from the threshold. No pair inside a cluster is formed, which loses no
component: its members are linked through the centre.

Defined cases: without words or text a set is empty, linked with nothing, and its own component; fewer than five words are
one shingle of the whole sequence; rows that repeat an id or a text are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.llm.components import components
from terrasig.llm.store import keep
from terrasig.llm.words import mix, sets, slices

#: Tokens in a block of a group, and queries that one block meets in one task.
BLOCK = 200_000
QUERIES = 2_000

#: Tokens that a task packs before it asks the buckets, the mean tokens of a bucket at most, and the least number of buckets.
PACK = 1_000_000
BUCKET = 4_000_000
LEAST = 64

#: Bytes of text hashed at once: a worker keeps tables of twice eight bytes for each.
SLICE = 1 << 20

#: Bits of the filter that finds the screened texts: 32 MB, enough for eight million of them.
FILTER = 1 << 28


def set_key(tokens: np.ndarray) -> int:
    """64 bits of a set: equal sets have equal keys."""
    total = int(mix(tokens).sum(dtype=np.uint64)) + len(tokens) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (1 << 64) - 1], np.uint64))[0].view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _first(n: int) -> int:
    """How many of a set's smallest tokens the screening looks at; sets of up to three only link with equal ones."""
    return n // 5 + max(1, -(-n // 10)) if n > 3 else 0


def _nodes(batches):
    for batch in slices(batches, "text", SLICE):
        found = sets(batch.column("text"))
        sizes = [len(s) for s in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("body"), pa.array([set_key(s) for s in found], pa.int64()), pa.array(sizes, pa.int64()), pa.array([_first(n) for n in sizes], pa.int64())],
            names=["id", "body", "node", "n", "first"],
        )


def _asker(buckets: int):
    """Packs of sets ask each bucket of tokens which are shared: a row is self-contained, so that it does not matter how
    a task that runs again packs its sets."""

    def asks(held: dict[int, np.ndarray]):
        keys = np.array(list(held), np.int64)
        tokens = mix(np.concatenate(list(held.values())))
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(s) for s in held.values()])
        bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((tokens, bucket))
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        many = np.diff(np.append(start, len(tokens))) > 1
        here = np.repeat(many, np.diff(np.append(start, len(tokens))))  # shared inside the pack: sent once, for the others
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        twice = start[many]
        cuts = np.searchsorted(twice, edges)
        rows = []
        for i in np.flatnonzero(np.diff(edges)):
            part = slice(edges[i], edges[i + 1])
            inside = here[part]
            mine = owner[part]
            slots, at = np.unique(mine, return_inverse=True)
            known = np.bincount(at[inside], minlength=len(slots)).astype(np.uint32)
            single = np.argsort(at[~inside], kind="stable")
            counts = np.bincount(at[~inside], minlength=len(slots)).astype(np.uint32)
            low = tokens[part].astype(np.uint32)
            shared = tokens[twice[cuts[i] : cuts[i + 1]]].astype(np.uint32)
            rows.append((int(i), keys[slots].tobytes(), known.tobytes(), counts.tobytes(), low[~inside][single].tobytes(), shared.tobytes()))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "nodes", "known", "counts", "tokens", "shared"])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in slices(batches, "text", SLICE):
            for s in sets(batch.column("text")):
                if len(s) > 3 and (k := set_key(s)) not in held:
                    held[k] = s[: _first(len(s))].copy()
                    size += len(held[k])
                    if size >= PACK:
                        yield asks(held)
                        held, size = {}, 0
        if held:
            yield asks(held)

    return run


def _tally(table: pa.Table) -> pa.Table:
    """One bucket of tokens: for every set that has some there, how many of them another set has too."""

    def column(name, kind):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    nodes, known, counts = column("nodes", np.int64), column("known", np.uint32), column("counts", np.uint32)
    tokens, shared = column("tokens", np.uint32), column("shared", np.uint32)
    hits = known.astype(np.int64)
    slot = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
    order = np.argsort(tokens, kind="stable")
    tokens, slot = tokens[order], slot[order]
    if len(tokens):
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        holders = nodes[slot]
        two = (np.minimum.reduceat(holders, start) != np.maximum.reduceat(holders, start)) | np.isin(tokens[start], shared)
        hits += np.bincount(slot[np.repeat(two, np.diff(np.append(start, len(tokens))))], minlength=len(nodes))
    nodes, once = np.unique(nodes, return_index=True)  # packs that hold the same set know the same
    hits = hits[once]
    some = hits > 0
    return pa.table({"node": pa.array(nodes[some]), "hits": pa.array(hits[some])})


def _places(bodies: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each text hash in a filter of `bits` bits (a power of two)."""
    a = mix(bodies.view(np.uint64))
    return np.stack([a, a >> np.uint64(32)]).astype(np.int64) & (bits - 1)


def _words(bits: int):
    def run(batches):
        for batch in batches:
            at = _places(batch.column("body").to_numpy(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    return run


def _sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, n, tokens) of texts of docs among which are all chosen ones. A bit filter of the chosen texts, of at most `FILTER` bits, goes to
    every task, so that texts stay where they are; beyond that size texts and chosen rows are joined. What a filter lets
    through besides is a set that links with nothing. One Python worker a task filters and hashes: two would each hold their
    batches."""
    schema = "node long, n long, tokens array<long>"
    bits = 1 << max(16, (16 * chosen.count()).bit_length())
    if bits > FILTER:
        named = chosen.select(F.col("id").alias("__i"), F.col("body").alias("__b"))
        return docs.join(named, F.col("id").eqNullSafe(F.col("__i")) & (F.col("body") == F.col("__b")), "left_semi").select("text").mapInArrow(_whole, schema)
    words = chosen.select("body").mapInArrow(_words(bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def passed(batches):
        mask = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            at = _places(batch.column("body").to_numpy(), bits)
            found = (mask[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=0)
            yield batch.select(["text"]).filter(pa.array(found))

    return docs.where("text is not null").select("body", "text").mapInArrow(lambda batches: _whole(passed(batches)), schema)


def _whole(batches):
    for batch in slices(batches, "text", SLICE):
        found = sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), _lists(found)], names=["node", "n", "tokens"])


def _open(table: pa.Table) -> pa.Table:
    """One block of a group and some of its queries: the links found."""
    query = np.asarray(table.column("query").to_numpy())
    node, size, cluster = (table.column(c).to_numpy() for c in ("node", "n", "cluster"))
    column = table.column("tokens").combine_chunks()
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    members = np.flatnonzero(~query)
    flat = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in members])
    owner = np.repeat(np.arange(len(members)), [offsets[i + 1] - offsets[i] for i in members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes, clusters = size[members], cluster[members]
    links: set[tuple[int, int]] = set()
    for i in np.flatnonzero(query):
        mine = values[offsets[i] : offsets[i + 1]]
        a, b = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        if 5 * int((b > a).sum()) < 4 * size[i]:
            continue  # the bound: too few tokens in the group's union
        wide = b - a
        at = np.arange(wide.sum()) + np.repeat(a - np.concatenate([[0], wide.cumsum()[:-1]]), wide)
        shared = np.bincount(owner[at], minlength=len(members))
        good = np.flatnonzero((100 * shared >= 80 * (sizes + size[i] - shared)) & (clusters != cluster[i]))
        if len(good):
            _, once = np.unique(clusters[good], return_index=True)  # one link into each cluster joins it
            links.update((int(node[i]), int(node[members[j]])) for j in good[once])
    rows = sorted(links)
    return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between nodes that span every component."""
    buckets = max(LEAST, -(-(nodes.agg(F.sum("first")).first()[0] or 0) // BUCKET))
    asks = docs.select("text").mapInArrow(_asker(buckets), "bucket int, nodes binary, known binary, counts binary, tokens binary, shared binary")
    hits = asks.groupBy("bucket").applyInArrow(_tally, "node long, hits long").groupBy("node").agg(F.sum("hits").alias("hits"))
    enough = F.greatest(F.lit(1), F.ceil(F.col("n") / 10))
    one = nodes.where("first > 0").groupBy("node").agg(F.min(F.struct("id", "body", "n")).alias("r")).select("node", "r.*")
    chosen = one.join(hits, "node").where(F.col("hits") >= enough).select("id", "body")
    chosen = keep(chosen, "screened")
    whole = keep(_sets_of(docs, chosen).where("n > 3").dropDuplicates(["node"]), "sets")

    tokens = whole.select("node", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").count().where("count > 1")
    sized = tokens.join(counts, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("t")).where(F.size("t") * 5 >= F.col("n") * 4)
    ranked = sized.select(
        "node",
        "n",
        F.col("t.token").alias("tokens"),
        # unshared tokens come first in the order, and meet nothing
        F.slice(F.col("t.token"), F.lit(1), (F.floor(F.col("n") / 5) + 1 - F.col("n") + F.size("t")).cast("int")).alias("prefix"),
        F.array_min("t.token").alias("anchor"),
        (F.aggregate("t.count", F.lit(0).cast("long"), lambda s, c: s + c) / F.col("n")).alias("central"),
    )
    ranked = keep(ranked, "ranked")

    hubs = ranked.groupBy("anchor").agg(F.max_by(F.struct("node", "n", "tokens"), F.struct("central", "node")).alias("c"))
    hubs = hubs.select("anchor", F.col("c.node").alias("centre"), F.col("c.n").alias("m"), F.col("c.tokens").alias("u"))
    both = F.size(F.array_intersect("tokens", "u"))
    met = ranked.join(hubs, "anchor").withColumn("o", both)
    clustered = met.select("node", "anchor", F.size("tokens").alias("size"), F.when(100 * F.col("o") >= 80 * (F.col("n") + F.col("m") - F.col("o")), F.col("centre")).otherwise(F.col("node")).alias("cluster"))
    clustered = keep(clustered, "clustered")
    alone = clustered.groupBy("cluster").agg((F.count(F.lit(1)) == 1).alias("alone"))
    grouped = clustered.join(alone, "cluster").withColumn("group", F.when(F.col("alone"), F.xxhash64(F.lit("left"), "anchor")).otherwise(F.xxhash64(F.lit("cluster"), "cluster")))
    blocks = grouped.groupBy("group").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    placed = grouped.join(blocks, "group").select("node", "cluster", "alone", "group", F.xxhash64("group", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    grouped = keep(ranked.select("node", "n", "tokens", "prefix").join(placed, "node"), "groups")

    matrix = grouped.select(F.explode("prefix").alias("token"), "block", "group", F.col("alone").alias("loose")).distinct()
    span = grouped.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    probes = grouped.select("node", "n", "group", "alone", F.explode("prefix").alias("token"))
    # leftovers ask every group, clusters ask the clusters of lower number: each pair of groups meets once
    asks = (F.col("p.alone") & (F.col("m.loose") | (F.col("p.group") != F.col("m.group")))) | (~F.col("p.alone") & ~F.col("m.loose") & (F.col("m.group") < F.col("p.group")))
    pairs = probes.alias("p").join(matrix.alias("m"), F.col("p.token") == F.col("m.token")).where(asks).select("p.node", "p.n", "m.block").distinct()
    pairs = pairs.join(span, "block").where((5 * F.col("high") >= 4 * F.col("n")) & (4 * F.col("low") <= 5 * F.col("n"))).select("node", "block")
    pairs = keep(pairs, "pairs")

    turns = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
    members = grouped.join(turns, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("query"), "node", "n", "cluster", "tokens")
    asking = pairs.join(turns, "block").join(grouped.select("node", "n", "cluster", "tokens"), "node")
    asking = asking.select("block", F.pmod(F.xxhash64("node"), F.col("turns")).cast("int").alias("turn"), F.lit(True).alias("query"), "node", "n", "cluster", "tokens")
    found = members.unionByName(asking).groupBy("block", "turn").applyInArrow(_open, "a long, b long")
    return clustered.select(F.col("node").alias("a"), F.col("cluster").alias("b")).where("a <> b").unionByName(found)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, body (hash of its text), n_shingles, component_id (the least key of its component), root
    (its component's node: unlike component_id it tells components apart whose keys are null or repeated)."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    nodes = keep(rows.mapInArrow(_nodes, f"id {kind}, body long, node long, n long, first long"), "nodes")
    roots = components(_links(rows, nodes))
    named = nodes.select("id", "body", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(F.col("id").alias(key), "body", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), "root")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one of the least key (of several rows with it, the least text hash). Documents
    without words all stay."""
    found = keep(near_copies(docs, key, text), "components")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col(key).alias("i"), "body")).alias("r"))
    empty = found.where("n_shingles = 0").select(F.col(key).alias("__i"), F.col("body").alias("__b")).distinct()
    kept = first.select(F.col("r.i").alias("__i"), F.col("r.body").alias("__b")).unionByName(empty)
    out = docs.join(kept, docs[key].eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text]) == F.col("__b")), "left_semi")
    again = found.where("n_shingles > 0").groupBy(key, "body").count().where("count > 1").limit(1).count()
    if not again:
        return out
    # some rows repeat an id with its text: of those with words one stays
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~worded).unionByName(out.where(worded).dropDuplicates([key, text]))
