"""Isolation forest over feature columns.

Trees grow on a bounded sample (TREES x ROWS rows, the least hashes of their key, so the same rows at every partitioning) and are
small arrays; scoring reads every row in Arrow batches. Splits are uniform between a feature's least and largest value, so
robust scaling, which is affine for each feature, changes no split's probability and is left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import evaluation

TREES, ROWS, SEED = 300, 256, 42
# Score tiers, right-closed.
TIERS = [(0.30, "Very Low"), (0.50, "Low"), (0.65, "Medium"), (0.80, "High")]


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays: feature (-1 at leaves), cut, left, right, length (depth and the leaf's mean path)."""
    limit = math.ceil(math.log2(max(2, len(rows))))
    nodes: list[list[float]] = []

    def add(at: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(average_path(len(at)))])
        low, high = rows[at].min(axis=0), rows[at].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth < limit and len(at) > 1 and len(usable):
            f = int(rng.choice(usable))
            cut = rng.uniform(low[f], high[f])
            below = rows[at, f] <= cut
            nodes[me][:2] = [f, cut]
            nodes[me][2] = add(at[below], depth + 1)
            nodes[me][3] = add(at[~below], depth + 1)
        return me

    add(np.arange(len(rows)), 0)
    table = np.array(nodes)
    return {"feature": table[:, 0].astype(int), "cut": table[:, 1], "left": table[:, 2].astype(int), "right": table[:, 3].astype(int), "length": table[:, 4], "depth": limit}


def path_lengths(trees: list[dict[str, np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """The mean over the trees of each row's path length."""
    total, each = np.zeros(len(rows)), np.arange(len(rows))
    for tree in trees:
        at = np.zeros(len(rows), dtype=int)
        for _ in range(tree["depth"]):
            f = tree["feature"][at]
            down = np.where(rows[each, np.maximum(f, 0)] <= tree["cut"][at], tree["left"][at], tree["right"][at])
            at = np.where(f >= 0, down, at)
        total += tree["length"][at]
    return total / len(trees)


def finite(col: str) -> Column:
    c = F.col(col).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def fit(table: DataFrame, key: str, columns: list[str], trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> dict:
    """The model: trees, medians that stand in for values that are missing or not finite, and the sample size of a tree."""
    clean = table.select(key, *[finite(c).alias(c) for c in columns])
    medians = clean.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in columns]).first()
    medians = {c: float(medians[c] or 0.0) for c in columns}
    pool = clean.na.fill(medians).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(trees * rows).toPandas()
    values, rng = pool[columns].to_numpy(dtype=float), np.random.default_rng(seed)
    size = min(rows, len(values))
    grown = [grow(values[rng.choice(len(values), size, replace=False)], rng) for _ in range(trees)] if size else []
    return {"trees": grown, "medians": medians, "size": size, "columns": columns}


def score(table: DataFrame, key: str, model: dict) -> DataFrame:
    """key and raw, 2 ** -(mean path / expected path): near 1 for rows that few cuts isolate. A model without trees scores 0.5."""
    columns = model["columns"]
    sent = table.sparkSession.sparkContext.broadcast(model)  # at most TREES * 2 * ROWS nodes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        usual = float(average_path(m["size"])) or 1.0
        for batch in batches:
            if m["trees"]:
                raw = 2.0 ** (-path_lengths(m["trees"], batch[columns].to_numpy(dtype=float)) / usual)
            else:
                raw = np.full(len(batch), 0.5)
            yield pd.DataFrame({key: batch[key], "raw": raw})

    clean = table.select(key, *[finite(c).alias(c) for c in columns]).na.fill(model["medians"])
    return clean.mapInPandas(run, f"{key} long, raw double")


def tier(col: Column) -> Column:
    out = F.lit("Critical")
    for top, name in reversed(TIERS):
        out = F.when(col <= top, name).otherwise(out)
    return out


def flag(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    """scored with score (raw between its least and largest), tier and is_flagged (raw at or above the quantile that contamination names)."""
    s = scored.agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.percentile_approx("raw", 1 - contamination, 100000).alias("limit"))
    width = F.col("high") - F.col("low")
    out = scored.crossJoin(F.broadcast(s))  # one row
    out = out.withColumn("score", F.when(width > 0, (F.col("raw") - F.col("low")) / width).otherwise(0.0))
    return out.withColumn("tier", tier(F.col("score"))).withColumn("is_flagged", F.col("raw") >= F.col("limit")).drop("low", "high", "limit")


def save(model: dict, spark: SparkSession, path: str) -> None:
    """The model as one row of JSON: at most TREES * 2 * ROWS nodes."""
    plain = model | {"trees": [{k: np.asarray(v).tolist() for k, v in tree.items()} for tree in model["trees"]]}
    spark.createDataFrame([(json.dumps(plain),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    model = json.loads(spark.read.parquet(path).first().model)
    return model | {"trees": [{k: np.array(v) if isinstance(v, list) else v for k, v in tree.items()} for tree in model["trees"]]}


def importance(table: DataFrame, key: str, model: dict, repeats: int = 5, seed: int = SEED) -> list[tuple[str, float]]:
    """Mean absolute change of raw scores when a column's values change places, as shares of the sum, largest first.

    Values change places among rows of a group of about ROWS that share a hash of their key, so no task holds more than a group.
    """
    groups = max(1, table.count() // ROWS)
    base = score(table, key, model).withColumnRenamed("raw", "base")
    change = {}
    for column in model["columns"]:
        total = 0.0
        for r in range(repeats):
            salt = lambda *parts: F.xxhash64(F.lit(seed), F.lit(r), *parts)
            group = F.pmod(salt(F.col(key)), F.lit(groups))
            w = Window.partitionBy("its_group")
            d = table.withColumn("its_group", group)
            d = d.withColumn("its_a", F.row_number().over(w.orderBy(key))).withColumn("its_b", F.row_number().over(w.orderBy(salt(F.lit(column), F.col(key)), key)))
            moved = d.select("its_group", F.col("its_b").alias("its_a"), F.col(column).alias("its_value"))
            other = d.join(moved, ["its_group", "its_a"]).withColumn(column, F.col("its_value")).select(*table.columns)
            total += score(other, key, model).join(base, key).agg(F.avg(F.abs(F.col("raw") - F.col("base")))).first()[0] or 0.0
        change[column] = total / repeats
    whole = sum(change.values()) or 1.0
    return sorted(((c, v / whole) for c, v in change.items()), key=lambda p: (-p[1], p[0]))


def grid_search(table: DataFrame, key: str, columns: list[str], labels: DataFrame, grid: list[dict], seed: int = SEED) -> tuple[dict, float]:
    """The setting of fit() with the best average precision against labels (key, label), the first of equals."""
    best: tuple[dict, float] = ({}, -1.0)
    for setting in grid:
        raw = score(table, key, fit(table, key, columns, seed=seed, **setting)).join(labels, key).select(F.col("raw").alias("score"), "label")
        found = evaluation.areas(raw).first().average_precision or 0.0
        if found > best[1]:
            best = (setting, found)
    return best
