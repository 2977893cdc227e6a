"""Mixing sources to target weights by hierarchical budgets (DataFrame operations only).

A tree of domain, language and source holds the documents in its leaves. Every node splits its token budget among its
children by weight; a child that cannot use its share (its documents times max_epochs hold too few tokens) passes the
rest to its siblings, and only what a whole family cannot use goes to the family's siblings. A leaf whose budget is q
times its supply and r more takes q whole epochs and, of the next epoch's seeded order, the first r tokens.

Defined results: null text has no tokens and is never taken; null labels form nodes '(null)'; equal rows share their
leaf's budget as separate rows; a weight of 0 leaves a node out; shares are rounded down, so fewer tokens than a node has
children may stay undealt; a budget above what all leaves can give is cut to that; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, written

#: A leaf's documents are summed and ordered in this many parts, by the first hexadecimal digits of their seeded key.
KEY_DIGITS = 3


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent columns, budget of the parent, weight, capacity) with alloc: shares by weight, none above its capacity."""
    ratio = Window.partitionBy(*parent or [F.lit(0)]).orderBy("full_at", "weight", "node")
    whole = Window.partitionBy(*parent or [F.lit(0)])
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = children.withColumn("full_at", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(float("inf")))
    c = c.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(after))
    c = c.withColumn("is_full", F.col("full_at") * F.col("left_weight") + F.col("taken") <= F.col("budget"))
    c = c.withColumn("full_sum", F.sum(F.when(F.col("is_full"), F.col("capacity")).otherwise(0)).over(whole)).withColumn("open_weight", F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("weight"))).over(whole))
    share = F.when(F.col("open_weight") > 0, F.floor((F.col("budget") - F.col("full_sum")) * F.col("weight") / F.col("open_weight"))).otherwise(0)
    return c.withColumn("alloc", F.when(F.col("is_full"), F.col("capacity")).otherwise(F.least(share, F.col("capacity"))).cast("long"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """levels, supply and budget of each leaf. leaves: levels and supply; weights: by level and value, 1 where none is given."""
    def weight_at(level: str) -> Column:
        weight = F.lit(1)
        for value, w in (weights.get(level) or {}).items():
            weight = F.when(F.col(level) == value, w).otherwise(weight)
        return weight

    # What lies under a weight of 0 can take nothing, and nothing is set aside for it on any level.
    takes = F.lit(True)
    for level in levels:
        takes = takes & (weight_at(level) > 0)
    leaves = leaves.withColumn("capacity", F.when(takes, F.col("supply") * max_epochs).otherwise(0))
    found = leaves.agg(F.floor(F.least(F.sum("supply") * F.lit(share), F.sum("capacity").cast("double"))).cast("long").alias("budget"))
    for k, level in enumerate(levels):
        up, at = levels[:k], levels[: k + 1]
        nodes = leaves.groupBy(*at).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_at(level).cast("long")).withColumn("node", F.col(level))
        nodes = nodes.join(found, up) if up else nodes.crossJoin(F.broadcast(found))  # one row
        found = fill(nodes, up).select(*at, F.col("alloc").alias("budget"))
    return leaves.select(*levels, "supply").join(found, levels)


def hierarchical_mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float = 0.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, levels, n_tokens, full_epochs (times the whole document is taken) and part_tokens (of its next time) of every document.

    docs: doc_id, levels and n_tokens. share: the budget as a part of all tokens.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    base = docs.select("doc_id", *[F.coalesce(F.col(x).cast("string"), F.lit("(null)")).alias(x) for x in levels], "n_tokens", key.alias("key"))
    base = written(base.withColumn("part", F.substring("key", 1, KEY_DIGITS)), "mix")
    parts = base.groupBy(*levels, "part").agg(F.sum("n_tokens").alias("tokens"))
    leaves = parts.groupBy(*levels).agg(F.sum("tokens").alias("supply"))
    budgets = leaf_budgets(leaves, levels, weights, share, max_epochs)
    inside = Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("tokens").join(budgets, levels)
    order = Window.partitionBy(*levels, "part").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(starts, [*levels, "part"])
    full = F.expr("CASE WHEN supply > 0 THEN budget div supply ELSE 0 END").cast("long")
    rest = F.expr("CASE WHEN supply > 0 THEN budget % supply ELSE 0 END").cast("long")
    room = F.greatest(F.lit(0), F.least(F.col("n_tokens"), rest - F.col("start") - F.col("ahead"))).cast("long")
    return placed.select("doc_id", *levels, "n_tokens", F.when(F.col("n_tokens") > 0, full).otherwise(0).cast("long").alias("full_epochs"), room.alias("part_tokens"))


#: The tree of the registered query and the pipeline.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def with_tree(docs: DataFrame) -> DataFrame:
    """doc_id, domain (a source's group, by its md5), lang, source, n_tokens."""
    domain = F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce("source", F.lit("(null)"))), 1, 2), 16, 10).cast("int") % 4).cast("string"))
    return docs.select("doc_id", domain.alias("domain"), "lang", "source", word_count(F.col("text")).alias("n_tokens"))


ORACLE = """
WITH base AS (
  SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '(null)')), 1, 2))::INT % 4)::VARCHAR AS domain,
         coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * 2)::BIGINT AS capacity FROM base GROUP BY ALL),
root AS (SELECT floor(least(sum(supply) * 0.5::DOUBLE, sum(capacity)::DOUBLE))::BIGINT AS budget FROM leaves),
n1 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight,
              any_value(budget) AS budget, 0 AS up FROM leaves, root GROUP BY domain),
a1 AS (SELECT *, capacity::DOUBLE / weight AS full_at, coalesce(sum(capacity) OVER (PARTITION BY up ORDER BY capacity::DOUBLE / weight, weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
       sum(weight) OVER (PARTITION BY up ORDER BY capacity::DOUBLE / weight, weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM n1),
f1 AS (SELECT *, full_at * left_weight + taken <= budget AS is_full FROM a1),
g1 AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY up) AS full_sum, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY up) AS open_weight FROM f1),
b1 AS (SELECT domain, CASE WHEN is_full THEN capacity ELSE least(floor(((budget - full_sum) * weight)::DOUBLE / open_weight)::BIGINT, capacity) END AS budget FROM g1),
n2 AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(budget) AS budget
       FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang),
a2 AS (SELECT *, capacity::DOUBLE / weight AS full_at, coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity::DOUBLE / weight, weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
       sum(weight) OVER (PARTITION BY domain ORDER BY capacity::DOUBLE / weight, weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM n2),
f2 AS (SELECT *, full_at * left_weight + taken <= budget AS is_full FROM a2),
g2 AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY domain) AS full_sum, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY domain) AS open_weight FROM f2),
b2 AS (SELECT domain, lang, CASE WHEN is_full THEN capacity ELSE least(floor(((budget - full_sum) * weight)::DOUBLE / open_weight)::BIGINT, capacity) END AS budget FROM g2),
n3 AS (SELECT domain, lang, source, supply, capacity, 1 AS weight, budget FROM leaves JOIN b2 USING (domain, lang)),
a3 AS (SELECT *, capacity::DOUBLE AS full_at, coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
       sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM n3),
f3 AS (SELECT *, full_at * left_weight + taken <= budget AS is_full FROM a3),
g3 AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY domain, lang) AS full_sum, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY domain, lang) AS open_weight FROM f3),
b3 AS (SELECT domain, lang, source, supply, CASE WHEN is_full THEN capacity ELSE least(floor(((budget - full_sum) * weight)::DOUBLE / open_weight)::BIGINT, capacity) END AS budget FROM g3),
placed AS (SELECT base.*, supply, budget::BIGINT AS budget, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM base JOIN b3 USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
       CASE WHEN n_tokens > 0 AND supply > 0 THEN (budget // supply)::BIGINT ELSE 0 END AS full_epochs,
       greatest(0, least(n_tokens, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END - ahead))::BIGINT AS part_tokens
FROM placed
"""
