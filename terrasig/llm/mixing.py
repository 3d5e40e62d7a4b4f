"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of groups (domain, language, source). At each node it is dealt to the children by weight;
no child gets more than its subtree holds (its tokens times `epochs`), and what one cannot take goes to its siblings first
and only leaves the node when all of them are full. That is water filling: children are full in order of capacity per
weight, the rest share what is left by weight. Every level is one window over the nodes' children, never over documents.

A leaf's budget then selects from its seeded epochs: whole passes, and of the last epoch, ordered by md5(seed|epoch|key),
the first tokens up to the budget. Running totals are cut into hash buckets, so a leaf of any size is many windows.

Defined cases: null group values form a group of their own; null and empty texts have no tokens and are never taken; a
weight that is missing is 1, of zero or less gives its subtree nothing; ties of the order are broken by key and length, equal
rows share their places; an empty table gives no rows; columns of the input other than those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.llm.order import bucket_of, running_totals
from terrasig.llm.store import keep

NULL = "∅"


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def deal(children: DataFrame, parents: list[str]) -> DataFrame:
    """Add `given` to children (parents, weight, holds, budget of the parent): the water filling of each parent's budget."""
    kids = children.withColumn("__w", F.greatest(F.col("weight").cast("double"), F.lit(0.0))).withColumn("__c", F.when(F.col("__w") > 0, F.col("holds").cast("double")).otherwise(0.0))
    kids = kids.withColumn("__full_at", F.when(F.col("__w") > 0, F.col("__c") / F.col("__w")).otherwise(0.0))
    order = Window.partitionBy(*parents).orderBy("__full_at", "name")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
    kids = kids.withColumn("__left", F.col("budget") - F.coalesce(F.sum("__c").over(before), F.lit(0.0))).withColumn("__wide", F.sum("__w").over(all_of) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    kids = kids.withColumn("__is_full", F.col("__c") * F.col("__wide") <= F.col("__w") * F.greatest(F.col("__left"), F.lit(0.0)))
    full = lambda c: F.sum(F.when(F.col("__is_full"), F.col(c)).otherwise(0.0)).over(all_of)
    kids = kids.withColumn("__rest", F.col("budget") - full("__c")).withColumn("__open", F.sum("__w").over(all_of) - full("__w"))
    given = F.when(F.col("__is_full"), F.col("__c")).otherwise(F.col("__w") / F.col("__open") * F.greatest(F.col("__rest"), F.lit(0.0)))
    return kids.withColumn("given", given).drop("__w", "__c", "__full_at", "__left", "__wide", "__is_full", "__rest", "__open")


def budgets(leaves: DataFrame, levels: list[str], weights: list[Column], share: float, epochs: int) -> DataFrame:
    """Leaf budgets in tokens: leaves has the level columns and `tokens`; weights is one expression per level over the
    level columns; the tree's budget is `share` of all tokens."""
    table = leaves.withColumn("__all", F.lit(0))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * share).alias("b")).first()["b"]
    upper = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = table.groupBy("__all", *path).agg(F.sum("tokens").alias("__t")).withColumn("holds", F.col("__t") * epochs).drop("__t")
        nodes = nodes.withColumn("weight", F.coalesce(weights[depth], F.lit(1.0))).withColumn("name", F.col(level))
        if upper is None:
            nodes = nodes.withColumn("budget", F.lit(float(total)))
        else:
            nodes = nodes.join(upper, ["__all", *path[:-1]])
        dealt = deal(nodes, ["__all", *path[:-1]])
        upper = dealt.select("__all", *path, F.col("given").alias("budget"))
    return upper.select(*levels, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def plan(docs: DataFrame, levels: dict[str, Column], weights: list[Column], share: float = 1.0, epochs: int = 4, seed: str = "mix", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the level columns, n_tokens, epochs (whole passes it is in), tail (its tokens taken in the
    last, partial epoch)."""
    names = list(levels)
    rows = docs.select(F.col(key).alias("__key"), *[F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in levels.items()], tokens(F.col(text)).alias("n_tokens"))
    rows = keep(rows, "tokens")  # one pass over the texts; only numbers go on
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaf = budgets(leaves, names, weights, share, epochs).join(leaves, names)
    leaf = leaf.withColumn("__full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    leaf = keep(leaf.select(*names, "__full", (F.col("budget") - F.col("__full") * F.col("tokens")).alias("__tail")), "leaves")
    placed = rows.join(leaf, names).withColumn("__order", F.md5(F.concat_ws("|", F.lit(seed), F.col("__full").cast("string"), F.coalesce(F.col("__key").cast("string"), F.lit(NULL)))))
    placed = placed.withColumn("__bucket", bucket_of(F.col("__order")))
    placed = running_totals(placed, placed, names, [F.col("__order"), F.col("__key"), F.col("n_tokens")], F.col("n_tokens"), "__start")
    tail = F.least(F.greatest(F.col("__tail") - F.col("__start"), F.lit(0)), F.col("n_tokens"))
    return placed.select(F.col("__key").alias(key), *names, "n_tokens", F.col("__full").alias("epochs"), tail.cast("long").alias("tail"))


def take(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the plan takes: one for each whole epoch and one, cut to its first `tail` words, for the last.
    Rows of one key share the plan of that key's first row."""
    per_key = chosen.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct("epochs", "tail", "n_tokens")).alias("__p"))
    joined = docs.join(per_key, docs[key].eqNullSafe(per_key["__key"]))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__p.epochs").cast("int")), F.when((F.col("__p.tail") > 0), F.array(F.col("__p.tail"))).otherwise(F.array().cast("array<bigint>")))
    out = joined.select(*docs.columns, F.col("__p.n_tokens").alias("__t"), F.explode(copies).alias("__n"))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.greatest(F.col("__n"), F.lit(0)).cast("int")), "")
    return out.withColumn(text, F.when((F.col("__n") < 0) | (F.col("__n") >= F.col("__t")), F.col(text)).otherwise(short)).select(*docs.columns)


def select(docs: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that the plan takes at least in part, whole and once; rows without tokens are never taken. Rows of one
    key go together: they stay if one of them is taken."""
    names = chosen.where((F.col("n_tokens") > 0) & ((F.col("epochs") > 0) | (F.col("tail") > 0))).select(F.col(key).alias("__key")).distinct()
    return docs.join(keep(names, "chosen"), docs[key].eqNullSafe(F.col("__key")), "left_semi")


def source_levels(lang: str = "lang", source: str = "source") -> dict[str, Column]:
    """Domain (the source's number modulo 4), language, source."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]+)$", 1)
    return {"domain": F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("decimal(38,0)") % 4).cast("string"))), "language": F.col(lang), "origin": F.col(source)}


def source_weights() -> list[Column]:
    """Domains 4 : 3 : 2 : 1, English twice any other language, sources alike."""
    domain = reduce(lambda w, d: w.when(F.col("domain") == d[0], F.lit(d[1])), [("d1", 3.0), ("d2", 2.0), ("d3", 1.0)], F.when(F.col("domain") == "d0", F.lit(4.0)))
    return [domain, F.when(F.col("language") == "en", F.lit(2.0)), F.lit(1.0)]
