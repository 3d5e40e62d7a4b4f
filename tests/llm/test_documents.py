"""The document operators on small hand-made tables: against brute force, round trips, and the defined cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasig.llm import components, decontamination, fingerprints, jaccard, langid, linededup, lmscore, mixing, sharding, tokenids, toxicity, words
from terrasig.llm.queries import CHECKS, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, bucket string"
SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(0, 10**6)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", f"src{(k or 0) % 3}", 0, 99, "b") for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, short, very long, repeated and near equal texts, and columns named like outputs."""
    base = prose(1)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, base), (5, base), (6, base + " more"), (7, base.upper()), (8, prose(2, 30000)), (9, "a b c d"), (9, "a b c d"), (None, "no key"), (10, "éà ü　日本 😀"), (11, prose(3) + "\n" + base)]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return [(k, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def near_copies(seed: int, n: int):
    """Copies of one text with more and more words changed, and others."""
    rng = np.random.default_rng(seed)
    base = prose(seed, 80).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, 80, i % 6):
            w[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(w)))
    return rows + [(500 + i, prose(900 + i) + " " + " ".join(base[:20])) for i in range(30)]


def test_jaccard_matches_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 500)  # several blocks and turns a group
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    rows = near_copies(5, 60) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = jaccard.near_copies(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows))


def test_jaccard_links_four_shingles_with_five(spark):
    rows = []
    for i in range(12):
        eight = prose(900 + i, 8)
        rows += [(len(rows), eight), (len(rows) + 1, f"{eight} after" if i % 2 else f"before {eight}")]
    rows += [(len(rows), seven := prose(950, 7)), (len(rows) + 1, seven + " after")]  # 3 of 4 is too little
    got = jaccard.near_copies(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))
    assert {tuple(r)[2] for r in got if r["doc_id"] in (0, 1)} == {0}


def test_jaccard_drops_all_but_one(spark, odd, empty):
    kept = [r["doc_id"] for r in jaccard.drop_copies(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 1, 2, 3, 4, 8, 9, 10, 11] and None in kept
    assert jaccard.drop_copies(empty).count() == 0 and jaccard.drop_copies(odd).columns == odd.columns


def test_jaccard_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    a, b, c, d = (prose(700 + i) for i in range(4))
    rows = [(None, a), (None, b), (5, c), (5, d), (6, d), (7, d + " more"), (8, a)]
    kept = jaccard.drop_copies(table(spark, rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter([(None, a), (None, b), (5, c), (5, d)])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))


def test_line_dedup(spark, odd, empty):
    line = "The quick brown fox jumps over the lazy dog near the old river bank today"
    docs = table(spark, [(1, line + "\n\nother words here entirely"), (2, line.replace("today", "todaz")), (3, None), (4, "short\nshort\n \nx")])
    got = {r["doc_id"]: r["text"] for r in linededup.dedupe(docs).collect()}
    assert got == {1: line + "\n\nother words here entirely", 2: "", 3: None, 4: "short\n \nx"}
    assert linededup.dedupe(empty).count() == 0
    assert linededup.dedupe(odd).count() == odd.count()


def test_line_dedup_verifies_all_pairs_of_a_band(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 40)  # several blocks a band
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300))
    lines = []
    for i in range(300):  # families of three around a template: 0.6 to 0.85 to each other
        head = list(base) if i % 3 == 0 else list(lines[-1])
        for at in rng.integers(0, 300, 7 if i % 3 == 0 else 2):
            head[at] = str(rng.integers(10))
        lines.append("".join(head))
    sets = [{x[k : k + 9] for k in range(len(x) - 8)} for x in lines]
    data, starts, ends, _ = linededup._lines(pa.array(lines))
    hashes, edges, _ = linededup._shingles(data, starts, ends)
    bands = linededup._bands(hashes, edges)
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(300):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (bands[i] == bands[j]).any():
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = linededup.line_components(table(spark, list(enumerate(lines)))).collect()
    parts = defaultdict(set)
    for r in got:
        parts[r["component"]].add(r["id"])
    want = defaultdict(set)
    for i in range(300):
        want[find(i)].add(i)
    assert 10 < len(want) < 290 and sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_scores_follow_the_counts(spark, odd, empty):
    docs = table(spark, [(1, "a b a b"), (2, "a c"), (3, None)])
    got = {r["doc_id"]: r for r in lmscore.score(docs).collect()}
    one = {"a": 3, "b": 2, "c": 1}
    expect = [np.log(one["a"] / 6), np.log(2 / 3), np.log(0.4 * one["a"] / 6), np.log(2 / 3)]
    assert got[1]["score"] == pytest.approx(np.mean(expect)) and got[1]["backed_off"] == 0.25
    assert got[3]["score"] is None and got[3]["n_words"] == 0
    assert lmscore.score(odd, order=3, limit=200).count() == odd.count() and lmscore.score(empty).count() == 0
    whole = {r["doc_id"]: r["score"] for r in lmscore.score(docs, limit=1).collect()}
    assert all(whole[k] == pytest.approx(got[k]["score"]) for k in (1, 2))  # slices don't matter


def test_mixing_fills_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "x", "1", 10), ("d", "x", "2", 100), ("d", "y", "1", 100), ("e", "x", "1", 1000)], "a string, b string, c string, tokens long")
    got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(leaves, ["a", "b", "c"], [F.lit(1.0)] * 3, 400 / 1210, 1).collect()}
    # d and e get 200 each; x of d gets 100, its full leaf 10 passes 40 to its sibling
    assert got == {("d", "x", "1"): 10, ("d", "x", "2"): 90, ("d", "y", "1"): 100, ("e", "x", "1"): 200}


def test_mixing_takes_the_budget(spark, odd, empty):
    plan = mixing.plan(odd, mixing.source_levels(), mixing.source_weights(), share=0.5)
    rows = plan.collect()
    taken = sum(r["epochs"] * r["n_tokens"] + r["tail"] for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    assert len(rows) == odd.count() and 0 <= total // 2 - taken <= 12
    assert mixing.take(odd, plan).columns == odd.columns and mixing.select(odd, plan).columns == odd.columns
    assert mixing.plan(empty, mixing.source_levels(), mixing.source_weights()).count() == 0


def test_decontamination(spark, odd, empty):
    test = " ".join(f"t{i}" for i in range(14))
    bench = spark.createDataFrame([(1, test), (2, "Two Words"), (3, None), (4, ""), (5, test)], "item_id long, text string")
    docs = table(spark, [(1, "before, " + test.upper() + ". after"), (2, "two; words"), (3, "clean"), (4, None), (5, "t0 t1 t2 t3 t4 t5 t6 t7 t8")])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.report(docs, bench).collect()}
    assert got == {1: (16, 14, ["1", "5"]), 2: (2, 2, ["2"]), 3: (1, 0, []), 4: (0, 0, []), 5: (9, 0, [])}
    assert sorted(r["doc_id"] for r in decontamination.remove(docs, bench).collect()) == [3, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove(docs, bench, mode="spans").collect()}
    assert cut[1] == "before, after" and cut[2] == "" and cut[3] == "clean" and cut[4] is None
    none = bench.where("item_id = 4")
    assert decontamination.report(odd, none).where("n_hit > 0").count() == 0
    assert decontamination.report(empty, bench).count() == 0


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    test = " ".join(f"t{i}" for i in range(14))
    bench = spark.createDataFrame([(1, test)], "item_id long, text string")
    docs = table(spark, [(1, "x " + test), (2, "clean")])
    small = decontamination.report(docs, bench).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(decontamination.report(docs, bench).collect()) == sorted(small)


def test_sharding_moves_only_into_the_new_shard(spark, odd, empty):
    docs = table(spark, [(i, "x") for i in range(400)])
    rows = sharding.layout(docs).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows) and any(r["grown_shard"] == 16 for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = Counter(r["shard"] for r in sharding.assign(docs, weights=(3.0, 1.0)).collect())
    assert 0.65 < share[0] / 400 < 0.85
    assert sharding.layout(odd).count() == odd.count() and sharding.layout(empty).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [2**64 - 1], [0] * 1000, list(range(3000)), [1 << (i % 64) for i in range(700)]])
def test_simple8b_round_trip(ids):
    values = np.array(ids, np.uint64)
    lengths, got = tokenids.unpack(tokenids.pack(np.array([len(ids)], np.uint64), values))
    assert got.tolist() == ids and lengths.tolist() == [len(ids)]


def test_token_ids(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenids.byte_vocabulary())
    more = odd.unionByName(table(spark, [(20, "two  spaces"), (21, "it's <|endoftext|> x"), (24, "x <|endoftext|> y"), (25, "a<|endoftext|>b c"), (22, " lead and trail "), (23, "a.\n\n b, (c).")]))
    frames = tokenids.write(more, tokenids.byte_vocabulary())
    got = sorted(map(tuple, tokenids.digests(frames).where("doc_id is not null").collect()))
    text = {r["doc_id"]: r["text"] or "" for r in more.collect()}
    for key, _, n, crc in got:
        ids = np.array([*library.encode(text[key], add_special_tokens=False).ids, 0], "<u4")
        assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))
    starts = sorted((r["start"], r["n_tokens"]) for r in tokenids.digests(frames).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert tokenids.read(frames).count() == more.count() and tokenids.digests(tokenids.write(empty, tokenids.byte_vocabulary())).count() == 0


def test_pieces_in_runs_give_the_ids_of_whole_texts():
    coder = tokenids.Encoder(tokenids.byte_vocabulary())
    signs = [" ", " ", " ", "a", "b", "It", "'s", ".", "\n", "\t", "0", "é", "中", "Ġ", "!", "<|endoftext|>", "\x1c", "\x85", "\u3000", "\r"]
    rng = np.random.default_rng(3)
    for _ in range(300):
        texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(20)]
        assert coder(texts) == coder._encode(texts)
    coder.PIECES = 1
    assert coder(["a b c", "", "a b "]) == coder._encode(["a b c", "", "a b "])


def test_fingerprints(spark, odd, empty):
    rows = fingerprints.compare_next(odd).collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: r for r in rows}
    assert of[4]["fingerprint"] == of[5]["fingerprint"] and of[5]["near_next"] == 1.0 and of[0]["near_next"] in (0.0, 1.0)
    assert fingerprints.compare_next(empty).count() == 0
    a, b = prose(1, 20000), prose(2, 200)
    whole, part = fingerprints.sketches([a + " " + b, b])
    assert fingerprints.containment(part, whole) > 0.95 and fingerprints.likeness(part, whole) < 0.1
    assert fingerprints.to_text(fingerprints.from_text(fingerprints.to_text(whole))) == fingerprints.to_text(whole)
    both = fingerprints.merge(*fingerprints.sketches([a, b]))
    assert fingerprints.likeness(both, whole) > 0.98


def test_language(spark, odd, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    blank = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert blank[0] == blank[1] == blank[2] == ("und", 0.0)
    none = langid.fit(docs.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_toxicity_finds_documents_and_sentences(spark, odd, empty):
    rows = [(i, f"{prose(i, 12)}. {'you rotter ' if i % 4 == 0 else ''}{prose(i + 999, 12)}.") for i in range(200)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, learn=F.col("doc_id") < 150)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(150, 200))
    found = toxicity.locate(docs.where("doc_id = 196"), model).collect()
    assert [r["sentence"] for r in found] == [1] and "rotter" in found[0]["text"]
    assert toxicity.score(odd, model).where("doc_id in (0, 1, 2) and score <> 0").count() == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert toxicity.score(docs, none).where("score > 1e-9").count() == 0


def test_toxicity_does_not_grow_with_the_length(spark):
    rows = [(i, f"{prose(i, 12)}. {'you rotter ' if i % 4 == 0 else ''}{prose(i + 999, 12)}.") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    words = prose(5000, 120_000).split(" ")
    clean = [" ".join(words[i : i + 6]) for i in range(0, 120_000, 6)]
    long = table(spark, [(1, ". ".join(clean)), (2, ". ".join(clean[:10_000] + ["you rotter"] + clean[10_001:])), (3, ". ".join(["zz"] * 20_000))])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(long, model).collect()}
    assert got[1] < toxicity.THRESHOLD <= got[2] and got[3] == 0
    # weak cues as frequent as in clean texts
    logits = np.full(20_000, toxicity.BIAS)
    logits[::1000] = -2.0
    mass = toxicity._mass(logits, toxicity.BIAS)
    usual = toxicity.Model(model.features, model.weights, model.bias, float(mass.mean()), float(mass.var()))
    assert toxicity._total(logits, np.zeros(20_000, np.int64), 1, usual)[0] < toxicity.THRESHOLD
    logits[7] = 4.0
    assert toxicity._total(logits, np.zeros(20_000, np.int64), 1, usual)[0] > 0.9


def test_hashing_knows_texts_by_their_own_bytes():
    texts = ["a b c d e f", "A  B\nc d e f", None, "", "f", "a b c d e"]
    sets = words.sets(pa.array(texts))
    assert sets[0].tolist() == sets[1].tolist() and [len(s) for s in sets] == [2, 2, 0, 0, 1, 1]
    assert np.isin(sets[5], sets[0]).all()


def test_queries_match_their_sql(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent.parent))
    from compare import diff, duck

    assert all(f"op{n}_" in "".join(QUERIES) for n in range(1, 11))
    con = duck(SF)
    for name, sql in CHECKS.items():
        assert diff(QUERIES[name](spark, SF), con, sql) is None, name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert list(out.columns) == [*docs.columns, "shard"] and 0 < len(out) < docs.count()
    assert out["doc_id"].is_unique and out["shard"].between(0, 15).all()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.report(spark.createDataFrame(pd.DataFrame(out[["doc_id", "text"]])), bench).where("n_hit > 0").count() == 0
