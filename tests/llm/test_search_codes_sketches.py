"""HyperMinHash near copies, vector codes and lexical search: against brute force, with the defined cases."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasig.llm import hyperminhash, lexical, vectorcodes
from terrasig.llm.queries import CHECKS, QUERIES
from tests.compare import diff, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, score long, rank int, item_id long, label string"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(k, t, "en", "s", 0, 7, 8, 9, 1, 5, "x") for k, t in rows], SCHEMA)


def prose(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(0, 10**6)}" for _ in range(n))


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, prose(1)), (5, prose(1)), (6, prose(1) + " more"), (7, prose(1).upper()), (8, prose(2, 30000)), (9, "a b"), (9, "a b"), (None, "no key"), (None, "a b"), (10, "éà ü　日本 😀"), (11, prose(3) + "\n" + prose(1))]


@pytest.mark.parametrize("name", ["op11_minhash_dedup", "op12_vector_codes", "op13_lexical_search"])
def test_matches_sql(spark, name):
    assert diff(QUERIES[name](spark, SF), duck(SF), CHECKS[name]) is None


# near copies


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        ids[find(i)].append(k)
    component = [min((x for x in ids[find(i)] if x is not None), default=None) if sets[i] else k for i, (k, _) in enumerate(rows)]
    return [(k, len(sets[i]), component[i], component[i] == k) for i, (k, _) in enumerate(rows)]


def edited(base: list[str], edits: int, rng) -> str:
    w = list(base)
    for at in rng.integers(0, len(w), edits):
        w[at] = f"x{rng.integers(0, 10**6)}"
    return " ".join(w)


def test_near_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "REGISTERS", 16)  # several blocks a group, in both stages
    monkeypatch.setattr(hyperminhash, "TOKENS", 1500)
    rng = np.random.default_rng(4)
    base, other, short = prose(11, 150).split(), prose(12, 90).split(), prose(13, 9).split()
    rows = [(100 + i, edited(base, i % 12, rng)) for i in range(120)]  # crowded bands, on both sides of 0.85
    rows += [(300 + i, edited(other, 4, rng)) for i in range(40)]
    rows += [(400 + i, " ".join([*short, f"y{i}"])) for i in range(8)] + [(410, " ".join(short)), (411, " ".join(short[1:]))]
    rows += [(500 + i, prose(900 + i) + " " + " ".join(base[:60])) for i in range(20)] + ODD
    got = hyperminhash.near_copies(table(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.drop("kept").collect())) == Counter(r[:3] for r in brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_copies_of_an_empty_table(spark):
    assert hyperminhash.near_copies(table(spark, [])).count() == 0
    assert hyperminhash.near_copies(table(spark, [(1, None), (2, "one")])).count() == 2


@pytest.mark.parametrize("size", [7, 40, 600])
def test_registers_agree_like_the_sets(size):
    rng = np.random.default_rng(size)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
        cut = int(size * 0.2)
        a, b = np.unique(pool[:size]), np.unique(pool[cut : size + cut])
        rows = hyperminhash.registers([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(hyperminhash.estimate(rows[:1], rows[1:], np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_unequal_sets_share_registers_as_often_as_the_correction_says():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(300):
        rows = hyperminhash.registers([rng.integers(0, 1 << 63, 2000).astype(np.uint64) for _ in range(2)])
        same.append((rows[0] == rows[1]).mean())
    chance = hyperminhash.by_chance(np.array([2000]), np.array([2000]))[0]
    assert 0.1 / 1024 < chance < 0.6 / 1024 and abs(np.mean(same) - chance) < 2e-4


def test_banding_finds_links_at_the_threshold():
    """Pairs at 0.85 share a band; the stated chance to miss one is 4e-7."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        pool = np.unique(rng.integers(0, 1 << 63, 260).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:185]), np.sort(pool[15:200])  # 170 of 200
        r = hyperminhash.registers([a, b])[:, : hyperminhash.BANDS * hyperminhash.ROWS].reshape(2, hyperminhash.BANDS, hyperminhash.ROWS)
        missed += not (r[0] == r[1]).all(axis=1).any()
    assert missed == 0


def test_forest_connects():
    least = hyperminhash.forest(np.array([5, 1, 2, 7]), np.array([4, 2, 3, 8]), 10)
    assert least.tolist() == [0, 1, 1, 1, 4, 4, 6, 7, 7, 9]


# vector codes


def brute_codes(vectors, entries, rounds):
    """Plain product codes of integer rows in the order of vec_id."""
    wide = vectors.shape[1] // 4
    books = [vectors[:entries, p * wide : (p + 1) * wide].copy() for p in range(4)]

    def assign():
        d = [((vectors[:, None, p * wide : (p + 1) * wide] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        return np.stack([x.argmin(axis=1) for x in d], axis=1), sum(x.min(axis=1) for x in d)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(4):
            for e in range(len(books[p])):
                if (mine := codes[:, p] == e).any():
                    books[p][e] = vectors[mine, p * wide : (p + 1) * wide].sum(axis=0) // mine.sum()
    return *assign(), books


@pytest.mark.parametrize("width", [4, 20, 64])
def test_codes_match_brute_force(spark, width):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(150, width)), 1 if width == 4 else 5)  # many ties at width 4
    rows = [(i, x[i].tolist(), i % 3 if i % 5 else None) for i in range(150)]
    got = vectorcodes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=32).collect()
    codes, errors, books = brute_codes(np.floor(x * 1024).astype(np.int64), 32, 4)
    by_label = defaultdict(int)
    for i, r in enumerate(rows):
        by_label[r[2]] += int(errors[i])
    want = {i: (bytes(codes[i].astype(np.uint8)).hex(), int(errors[i]), by_label[rows[i][2]]) for i in range(150)}
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {vectorcodes.digest(books)}


def test_vectors_that_are_dropped_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0] * 8, 1), (1, [0.0] * 8, 1), (2, None, 1), (3, [nan] + [0.0] * 7, 1), (4, [None] + [0.0] * 7, 1), (5, [inf] * 8, 1), (6, [1.0] * 7, 1), (7, [], 1), (None, [1e300, -1e300, *[0.5] * 6], None), (8, [0.5] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).withColumn("v", F.lit(1))
    got = vectorcodes.encode(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter([1, 1, 8, None])
    assert all(r["error"] == 0 for r in got)  # fewer rows than entries: each is its own
    assert {r["code"] for r in got if r["vec_id"] == 1} == {"00000000"}  # ties go to the lower index
    assert vectorcodes.encode(df.limit(0)).count() == 0
    assert vectorcodes.encode(df.where("vec_id in (2, 3)")).count() == 0


def test_transform_keeps_distances_and_orders_by_sign_changes():
    h = vectorcodes.hadamard(16)
    assert ((np.diff(h, axis=1) != 0).sum(axis=1) == np.arange(16)).all() and (h @ h.T == 16 * np.eye(16, dtype=int)).all()
    rng = np.random.default_rng(1)
    a, b = rng.integers(-900, 900, (40, 12)), rng.integers(-900, 900, (30, 12))
    index, distance = vectorcodes.nearest(vectorcodes.transform(a), vectorcodes.transform(b))
    full = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_codes_decode_to_entries(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist(), 0) for i in range(40)], "vec_id long, embedding array<double>, label int")
    rows, width = vectorcodes.integer_vectors(df)
    books = vectorcodes.fit(rows, width, entries=8)
    coded = vectorcodes.encode(df, entries=8).join(rows.select("vec_id", "v"), "vec_id")
    for r in vectorcodes.decode(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r["v"], r["decoded"], strict=True)) == r["error"]


# lexical search


def brute_search(rows, items, top=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    docs = [(k, Counter(t)) for k, x in rows if (t := terms(x))]
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for k, c in docs:
            m = 75 + 25 * sum(c.values()) * len(docs) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scored += [(-s, k is None, k if k is not None else 0, k)] if s > 0 else []
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(scored)[:top])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    names = [f"t{i}" for i in range(300)]
    odds = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(1, 80)), p=odds / odds.sum()))) for i in range(400)]
    rows += [(1000 + i, "t1 t2 t3 t4") for i in range(60)] + [(7, "t1 t2 t3 t4")] + ODD  # ties, a repeated id
    items = [(i, " ".join(rng.choice(names, int(rng.integers(1, 40))))) for i in range(25)]
    items += [(90, "t1 t2 T3, t4"), (90, "t1 t2 T3, t4"), (91, "t1 t1 t1 t250"), (92, None), (93, "!?"), (94, "nowhere"), (None, "t5 t6"), (95, " ".join(names))]
    return rows, items


@pytest.mark.parametrize("vocabulary", [lexical.VOCABULARY, 150])
def test_search_matches_brute_force(spark, corpus, monkeypatch, vocabulary):
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)  # one pass, several passes
    monkeypatch.setattr(lexical, "OPENED", 4)
    rows, items = corpus
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = lexical.search(table(spark, rows), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_search(rows, items))


def test_search_of_empty_tables(spark, corpus):
    rows, items = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(table(spark, []), asked).count() == 0
    assert lexical.search(table(spark, rows), asked.limit(0)).count() == 0
    assert lexical.search(table(spark, [(1, None), (2, "")]), asked).count() == 0


def test_search_leaves_low_masks_closed(spark, monkeypatch):
    """Documents of masks that cannot reach the list are never scored."""
    scored = []
    plain = lexical.Block.scores
    monkeypatch.setattr(lexical.Block, "scores", lambda self, docs, weights: scored.append(len(docs)) or plain(self, docs, weights))
    batch = spark.createDataFrame([(i, 10, [0, 1], [1, 1]) if i < 100 else (i, 10, [1], [1]) for i in range(1000)], "doc long, n long, terms array<int>, times array<int>").toArrow().to_batches()[0]
    block = lexical.Block(batch, 1000, 10000)
    docs, _ = block.best(np.array([0, 1]), np.array([3000, 500]), np.zeros(2, np.int64), 0, 20)
    assert sum(scored) == 100 and set(docs.tolist()) <= set(range(100))
