"""The registered queries of the document operators and their check SQL: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 9 Sharding

SHARDING_SQL = """
WITH keyed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes
  FROM documents),
steps AS (
  SELECT list(step ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
      lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS step
    FROM (SELECT unnest(range(256)) AS i))),
scored AS (
  SELECT doc_id, size, k,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda b: CAST('0x' || b AS BIGINT))),
      lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS text_crc32,
    list_transform(range(17), lambda i: {'score': -ln((CAST('0x' || substr(md5(k || '|' || i), 1, 13) AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE), 'shard': i}) AS s
  FROM keyed, steps),
placed AS (
  SELECT *, list_min(s[1:16]).shard AS shard, list_min(s).shard AS grown_shard FROM scored)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5('slot|' || k), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed"""


@query("op9_sharding", SHARDING_SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards under the law `key`."""
    from terrasig.llm import sharding

    return sharding.layout(documents(spark, sf_dir)).withColumn("law", F.lit("key"))


# 4 Benchmark decontamination

DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM windows),
grams AS (
  SELECT doc_id, i AS pos, width, array_to_string(w[i : i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, widths WHERE len(w) >= width)),
hits AS (SELECT doc_id, item_id, pos, g.width FROM grams g JOIN windows USING (width, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of all benchmark items against all documents."""
    from terrasig.llm import decontamination

    found = decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# 10 Toxicity


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or scores of all documents by a model of the labelled ones that are not held out."""
    from terrasig.llm import toxicity

    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=toxicity.learnable())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


# 7 Language ID


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of the documents that are not held out."""
    from terrasig.llm import langid

    docs = documents(spark, sf_dir)
    model = langid.fit(docs, learn=langid.learnable())
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~langid.learnable()).alias("held_out"), "lang_pred", "score", "rejected")


# 3 Mixing sources to target weights


def _filling(level: str, above: str, parent: str, name: str, weight: str) -> str:
    """SQL of one level: children `level` of `above` (columns of the path, holds), keyed by `parent`."""
    over = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {name}" if parent else name
    source = f"FROM {above}" if parent else f"FROM (SELECT *, (SELECT sum(n_tokens) FROM toks)::DOUBLE AS budget FROM {above})"
    return f"""
{level}_w AS (SELECT *, {weight} AS w, holds / {weight} AS full_at {source}),
{level}_a AS (SELECT *, budget - coalesce(sum(holds) OVER ({over} ORDER BY full_at, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_here,
  sum(w) OVER ({over}) - coalesce(sum(w) OVER ({over} ORDER BY full_at, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wide FROM {level}_w),
{level}_b AS (SELECT *, holds * wide <= w * greatest(rest_here, 0) AS is_full FROM {level}_a),
{level} AS (SELECT {keys}, CASE WHEN is_full THEN holds ELSE w / (sum(w) OVER ({over}) - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ({over}))
  * greatest(budget - sum(CASE WHEN is_full THEN holds ELSE 0 END) OVER ({over}), 0) END AS given FROM {level}_b)"""


MIXING_SQL = (
    r"""
WITH toks AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other'
      ELSE 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4) END AS domain,
    coalesce(lang, '∅') AS language, coalesce(source, '∅') AS origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens) * 4::DOUBLE AS holds FROM toks GROUP BY ALL),
top AS (SELECT domain, sum(holds) AS holds FROM leaves GROUP BY ALL),"""
    + _filling("domains", "top", "", "domain", "CASE domain WHEN 'd0' THEN 4.0::DOUBLE WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")
    + """,
mid AS (SELECT domain, language, sum(holds) AS holds, any_value(given) AS budget FROM leaves JOIN domains USING (domain) GROUP BY ALL),"""
    + _filling("languages", "mid", "domain", "language", "CASE language WHEN 'en' THEN 2.0::DOUBLE ELSE 1 END")
    + """,
low AS (SELECT domain, language, origin, holds, given AS budget FROM leaves JOIN languages USING (domain, language)),"""
    + _filling("origins", "low", "domain, language", "origin", "1.0::DOUBLE")
    + """,
leaf AS (
  SELECT domain, language, origin, tokens, b, CASE WHEN tokens > 0 THEN CAST(floor(b / tokens) AS BIGINT) ELSE 0 END AS epochs
  FROM (SELECT *, floor(given + 1e-6) AS b FROM origins JOIN leaves USING (domain, language, origin))),
placed AS (
  SELECT t.*, epochs, b - epochs * tokens AS rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, origin
    ORDER BY md5('mix|' || epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '∅')), doc_id NULLS FIRST, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM toks t JOIN leaf USING (domain, language, origin))
SELECT doc_id, domain, language, origin, CAST(n_tokens AS BIGINT) AS n_tokens, epochs, CAST(least(greatest(rest - s, 0), n_tokens) AS BIGINT) AS tail
FROM placed"""
)


@query("op3_mixing", MIXING_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as all documents hold, mixed to the target weights with up to four epochs a source."""
    from terrasig.llm import mixing

    return mixing.plan(documents(spark, sf_dir), mixing.source_levels(), mixing.source_weights())


# 5 N-gram Jaccard join


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    from terrasig.llm import jaccard

    return jaccard.near_copies(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


# 8 Token-ID / binary output


@query("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids in Simple-8b frames, read back from the written files."""
    from terrasig.llm import tokenids

    return tokenids.digests(tokenids.write(documents(spark, sf_dir), tokenids.byte_vocabulary()))


# 6 Document fingerprints


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    from terrasig.llm import fingerprints

    return fingerprints.compare_next(documents(spark, sf_dir))


# 2 LM scoring

SCORING_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (
  SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM docs, unnest(range(1, len(w) + 1)) AS r(i)),
ones AS (SELECT b AS word, count(*) AS c FROM words GROUP BY b),
pairs AS (SELECT a, b, count(*) AS c FROM words WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
total AS (SELECT count(*)::DOUBLE AS n FROM words),
each AS (
  SELECT doc_id, CASE WHEN p.c IS NOT NULL THEN ln(p.c::DOUBLE / x.c) ELSE ln(o.c / n) + CASE WHEN w.a IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END AS s,
    CASE WHEN w.a IS NOT NULL AND p.c IS NULL THEN 1.0 ELSE 0.0 END AS off
  FROM words w CROSS JOIN total JOIN ones o ON o.word = w.b LEFT JOIN ones x ON x.word = w.a LEFT JOIN pairs p ON p.a = w.a AND p.b = w.b)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, score, backed_off
FROM docs d LEFT JOIN (SELECT doc_id, avg(s) AS score, avg(off)::DOUBLE AS backed_off FROM each GROUP BY doc_id) USING (doc_id)"""


@query("op2_lm_scoring", SCORING_SQL)
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents against the counts of all documents."""
    from terrasig.llm import lmscore

    return lmscore.score(documents(spark, sf_dir))


# 1 Line dedup


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of all documents go: per document the number of its lines and the places of those that go."""
    from terrasig.llm import linededup

    return linededup.report(documents(spark, sf_dir))


# 13 Ranked lexical search

SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT r, doc_id, t, len(t) AS n FROM docs WHERE len(t) > 0),
size AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM held),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, size),
asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN held USING (r), size GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item among all documents."""
    from terrasig.llm import lexical

    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# 12 Vector code compression


def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """SQL of the codes: every round assigns all parts to all entries and averages them."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
wide AS (SELECT len(v) // 4 AS wide FROM kept WHERE r = 1),
parts AS MATERIALIZED (SELECT r, p, v[p * wide + 1 : (p + 1) * wide] AS x FROM kept, wide, range(4) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {entries})"""
    for i in range(rounds + 1):
        sql += f""",
near{i} AS MATERIALIZED (
  SELECT r, p, a.s.e AS e, a.s.d AS d FROM (
    SELECT r, p, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS s
    FROM parts JOIN book{i} USING (p) GROUP BY r, p) AS a)"""
        if i < rounds:
            sql += f""",
mean{i} AS (
  SELECT p, e, list((s - (((s % c) + c) % c)) // c ORDER BY k) AS y FROM (
    SELECT p, e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS c FROM near{i} JOIN parts USING (r, p), wide, unnest(range(1, wide + 1)) AS t(k) GROUP BY ALL) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"""
    return sql + f""",
codes AS (SELECT r, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), book"""


CODES_SQL = _codes_sql()


@query("op12_vector_codes", CODES_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by codebooks of all embeddings."""
    from terrasig.llm import vectorcodes

    return vectorcodes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# 11 MinHash near-dedup

NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
docs AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sets AS MATERIALIZED (SELECT row_number() OVER () AS node, s, len(s) AS n FROM (SELECT DISTINCT s FROM docs WHERE len(s) > 0)),
tokens AS MATERIALIZED (SELECT node, n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
paired AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT node, node FROM sets UNION SELECT reach.node, paired.b FROM reach JOIN paired ON paired.a = reach.other),
ids AS (SELECT node, min(doc_id) AS least FROM sets JOIN docs USING (s) GROUP BY node),
found AS (SELECT reach.node, min(least) AS component FROM reach JOIN ids ON ids.node = reach.other GROUP BY reach.node)
SELECT doc_id, CAST(len(docs.s) AS BIGINT) AS n_shingles, CASE WHEN len(docs.s) > 0 THEN component ELSE doc_id END AS component_id,
  CASE WHEN len(docs.s) > 0 THEN component ELSE doc_id END IS NOT DISTINCT FROM doc_id AS kept
FROM docs LEFT JOIN sets ON sets.s = docs.s LEFT JOIN found USING (node)"""


@query("op11_minhash_dedup", NEAR_DEDUP_SQL)
def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies by three-word shingles."""
    from terrasig.llm import hyperminhash

    return hyperminhash.near_copies(documents(spark, sf_dir))
