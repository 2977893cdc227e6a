"""Sharding along a Hilbert curve (DataFrame operations only).

Several metadata columns are quantised at their quantiles, the cells are numbered along a Hilbert curve, rows are
ranked by (cell, slice of the id, id) and the ranking is cut into runs. Neighbouring cells on the curve share values in
all dimensions, so a run covers a small box and min/max statistics of its file prune on each of them.

Defined results: a null or unparsable dimension falls in the lowest cell; null text has 0 bytes and crc32 0; rows that
tie in everything take their slots in any order, which gives the same set of results; no rows give no rows; columns of
the input other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Slices of a cell by id: a cell that holds a third of all rows is ranked in so many tasks.
SLICES = 64
#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def curve_table(n: int) -> list[int]:
    """Entry s << n | l, of state s = entry * n + direction and octant l: next state << n | step along the curve."""
    full = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return (x << k | x >> (n - k)) & full

    gray = [i ^ i >> 1 for i in range(1 << n)]
    step_of = {g: i for i, g in enumerate(gray)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    out = []
    for state in range(n << n):
        entry, way = divmod(state, n)
        for octant in range(1 << n):
            step = step_of[turn(octant ^ entry, -(way + 1))]
            first = gray[(step - 1) // 2 * 2] if step else 0
            axis = (ones(step) if step & 1 else ones(step - 1)) % n if step else 0
            out.append(((entry ^ turn(first, way + 1)) * n + (way + axis + 1) % n) << n | step)
    return out


def curve_index(cells: list[Column], bits: int) -> Column:
    """The position on the Hilbert curve of the point whose coordinates are cells, each of so many bits."""
    n = len(cells)
    table = F.array(*map(F.lit, curve_table(n)))

    def walk(at: Column, bit: Column) -> Column:
        octant = reduce(add, [F.expr("0")] + [F.call_function("shiftleft", F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)), F.lit(k)) for k, c in enumerate(cells)])
        found = F.get(table, at["state"] * (1 << n) + octant)
        return F.struct((at["index"] * (1 << n) + found.bitwiseAND(F.lit((1 << n) - 1))).cast("long").alias("index"), F.call_function("shiftright", found, F.lit(n)).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*[F.lit(b) for b in reversed(range(bits))]), start, walk, lambda at: at["index"])


def text_key(col: Column) -> Column:
    """An order-preserving number of a string's first six bytes; -1 for null."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def hilbert_cells(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """df with column cell. dims: numeric columns without nulls, each cut at 2**bits - 1 quantiles."""
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(d, marks, 2000).alias(d) for d in dims]).first()
    at = [reduce(add, [(F.col(d) > F.lit(float(m))).cast("int") for m in sorted(set(row[d] or []))], F.lit(0)) for d in dims]
    return df.withColumn("cell", curve_index(at, bits))


def cut_runs(df: DataFrame, shards: int) -> DataFrame:
    """df (cell, doc_id, size, text_crc32, ...) with shard and slot: runs of the ranking whose counts differ by one at most."""
    df = df.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    inside = Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("cell", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # One row a cell, of which there are at most 2**(bits * dims): this window's size does not grow with the table.
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    starts = counts.join(cells, "cell").select("cell", "slice", (F.col("start") + F.col("before")).alias("start"), "total")
    order = Window.partitionBy("cell", "slice").orderBy("doc_id", "size", "text_crc32")
    ranked = df.withColumn("place", F.row_number().over(order) - 1).join(starts, ["cell", "slice"]).withColumn("rank", F.col("start") + F.col("place"))
    shard = F.expr(f"(rank * {shards}) div total")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).drop("slice", "place", "start", "total", "rank")


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 5) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, cell, shard, slot of every document."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    meta = docs.select("doc_id", "lang", "source", (F.length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), text_key(F.col("lang")).alias("by_lang"), text_key(F.col("source")).alias("by_source"))
    meta = written(meta, "hilbert").withColumn("by_size", F.col("size").cast("double"))
    return cut_runs(hilbert_cells(meta, ["by_lang", "by_source", "by_size"], bits).drop("by_lang", "by_source", "by_size"), shards)
