"""The account graph: edges, vertices, weak components, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def account_edges(txns: DataFrame) -> DataFrame:
    return txns.filter("debit > 0 AND account_id <> node").groupBy(F.col("account_id").alias("src"), F.col("node").alias("dst")).agg(F.sum("debit").cast("double").alias("total"), F.count(F.lit(1)).alias("txns"))


def vertices(edges: DataFrame) -> DataFrame:
    """In and out degree and flow of every node."""
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("total").alias("sent"), F.lit(0.0).alias("received"))
    into = edges.select(F.col("dst").alias("node"), F.lit(0), F.lit(1), F.lit(0.0), F.col("total"))
    return out.unionAll(into).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.round(F.sum("sent"), 2).alias("sent"), F.round(F.sum("received"), 2).alias("received"))


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): least labels of neighbours, with label jumping, until nothing changes."""
    e = edges.select("src", "dst")
    both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    labels = both.groupBy("src").agg(F.least(F.min("src"), F.min("dst")).alias("label")).select(F.col("src").alias("node"), "label")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["src"]).select("node", F.least("label", "near").alias("label"))
        up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = new.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")).checkpoint()
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def ego(edges: DataFrame, root: str, hops: int) -> DataFrame:
    """Nodes within hops of root along directed edges, with their distance."""
    found = edges.sparkSession.createDataFrame([(root, 0)], "node string, hop int")
    front = found
    for k in range(1, hops + 1):
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti").withColumn("hop", F.lit(k))
        found = found.unionAll(front).checkpoint()
        front = found.filter(F.col("hop") == k)
    return found.select("node", F.col("hop").cast("long").alias("hop"))


def fund_trace(edges: DataFrame, root: str, hops: int) -> DataFrame:
    """The edges among all nodes within hops of root; what a person is shown of a money trail."""
    near = ego(edges, root, hops).select("node")
    return edges.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi")
