"""Approximate nearest neighbours by additive quantisation.

A vector (of length 1) is stored as CODEBOOKS codes, whose full-dimensional codewords add up to it nearly, and the norm of
that sum. Codebooks come from residuals and a joint least-squares fit on a bounded sample (SAMPLE vectors, those of least
hash), which a task does; codes come from a beam search over partial sums. A query's table of inner products with all codewords scores a vector by CODEBOOKS
look-ups; the RERANK best by 2 <q, x> - |x|^2 are compared exactly on the original vectors in double precision.

Every vector is indexed and every code scored: on vectors without clusters, lists by the first codeword would have to be
probed to more than a third for a recall of 0.9. Equal vectors are one entry with its least ids, as many as an answer can
hold, so thousands of copies cost one. Codes travel packed in chunks, a row each. Chunks lie in parts of about PART codes,
queries in blocks of at most BLOCK, and a task scores one block against one part. Parts are taken in waves that double: a
wave's tasks return what is no worse than the RERANK-th best of all parts before, which is about RERANK rows a query and
wave however many tasks there are.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; components of any finite size are scaled by a power of two first, which changes no cosine; the query's own id is no
candidate, its copies are; a query with fewer candidates gets all of them; ties go to the smaller id; repeated ids are
candidates once; no vectors or no queries give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import collected, forget, lean, written

CODEBOOKS, WORDS = 16, 256
SAMPLE = 8192
BEAM = 6
RERANK = 500
#: Codes of a chunk, codes of a part (about) and queries of a block (at most).
CHUNK, PART, BLOCK = 4096, 1 << 20, 1 << 14
#: Smaller tables have up to so many blocks, of this many queries or more, so that there are tasks enough.
FEW_BLOCKS, LEAST_BLOCK = 32, 48
#: Queries and codes that are scored together within a task.
SOME_QUERIES, SOME_CODES = 256, 8192
#: Codes as they travel.
CHUNKS = "chunk long, n long, entries binary, codes binary, norms binary"
FOUND = "query_id long, rank int, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def nearest_word(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * (x @ centers.T)).argmin(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row a vector) and the squared norms of their sums, by beam search."""
    n, (m, k, d) = len(x), books.shape
    codes, sums, cost = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, d), np.float32), np.zeros((n, 1), np.float32)
    for b in range(m):
        c = books[b]
        new = (c * c).sum(1) - 2 * (x @ c.T)
        total = cost[:, :, None] + new[:, None, :] + 2 * (sums.reshape(-1, d) @ c.T).reshape(n, -1, k)
        total = total.reshape(n, -1)
        width = min(beam, total.shape[1])
        best = np.argpartition(total, width - 1, axis=1)[:, :width]
        cost = np.take_along_axis(total, best, 1)
        came, word = best // k, best % k
        codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        sums = np.take_along_axis(sums, came[:, :, None], 1) + c[word]
    row, best = np.arange(n), cost.argmin(1)
    found = sums[row, best]
    return codes[row, best], (found * found).sum(1)


def fit(x: np.ndarray, books: int = CODEBOOKS, words: int = WORDS, rounds: int = 2) -> np.ndarray:
    """Codebooks: k-means on residuals, then least squares for all codewords at once given the beam search's codes."""
    rng = np.random.default_rng(5)
    words = min(words, len(x))
    out, left = [], x.copy()
    for _ in range(books):
        c = left[rng.permutation(len(x))[:words]].copy()
        for _ in range(6):
            code = nearest_word(left, c)
            count = np.bincount(code, minlength=words)
            order = np.argsort(code, kind="stable")
            full = np.flatnonzero(count)
            c[full] = np.add.reduceat(left[order], (np.cumsum(count) - count)[full]) / count[full, None]
        out.append(c)
        left -= c[nearest_word(left, c)]
    out = np.stack(out)
    for _ in range(rounds):
        codes = encode(x, out)[0].astype(np.int64) + np.arange(books) * words
        gram, right = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            order = np.argsort(codes[:, a], kind="stable")
            at, first = np.unique(codes[order, a], return_index=True)
            right[at] = np.add.reduceat(x[order], first)
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1)
        gram[np.diag_indices_from(gram)] += 0.5
        right += 0.5 * out.reshape(-1, x.shape[1])
        out = np.linalg.solve(gram, right).reshape(out.shape)
        del gram
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double, scaled by a power of two so that squares neither overflow nor vanish) of the vectors that take part, each id once."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    sizes = v.groupBy(F.size("v").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").first()
    v = v.filter(F.size("v") == (sizes["d"] if sizes else 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite).filter(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    largest = F.array_max(F.transform("v", F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(largest)).cast("double"))))
    return v.withColumn("power", power).select("vec_id", F.transform("v", lambda x: x * F.col("power")).alias("v"))


def least_hashed(entries: DataFrame, n: int, size: int) -> DataFrame:
    """The size entries of least hash, of n in all: those far above the hash that so many are under leave before the one task that orders the others.

    Fewer come out only if the hashes are not spread evenly."""
    place = F.xxhash64("entry")
    if n > size:
        part = (size + 8 * size**0.5) / n
        entries = entries.filter(place <= F.lit(min(2**63 - 1, int(part * 2**64) - 2**63)))
    return entries.orderBy(place, "entry").limit(size)


def learned(entries: DataFrame, n: int, size: int = SAMPLE) -> np.ndarray | None:
    """fit() on the size entries (entry, v; n in all) of least hash, by a task: the driver gets the codebooks only. None without entries."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = [unit(_matrix(b.column(0))) for b in batches if b.num_rows]
        if vectors:
            x = np.concatenate(vectors)
            books = fit(x)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([books.shape[1]]), pa.array([books.tobytes()], pa.binary())], ["n", "words", "books"])

    for chosen in (least_hashed(entries, n, size), entries.orderBy(F.xxhash64("entry"), "entry").limit(size)):
        found = collected(chosen.select("v").mapInArrow(run, "n long, words long, books binary"))
        if found and found[0]["n"] == min(n, size):
            break
    return np.frombuffer(found[0]["books"], np.float32).reshape(CODEBOOKS, found[0]["words"], -1) if found else None


def table_scores(q: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, code and score of each query's best codes by look-up tables, keep at most, none under the query's floor."""
    tables = np.ascontiguousarray((2 * np.einsum("qd,mkd->mkq", q, books)).astype(np.float32))
    best, who = np.full((len(q), keep), -np.inf, np.float32), np.full((len(q), keep), -1, np.int64)
    for at in range(0, len(codes), SOME_CODES):
        c = codes[at : at + SOME_CODES]
        s = np.repeat(-norms[at : at + SOME_CODES, None], len(q), 1)
        for m in range(c.shape[1]):
            s += tables[m][c[:, m]]
        both = np.concatenate([best, s.T], 1)
        top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
        which = np.concatenate([who, np.broadcast_to(np.arange(at, at + len(c)), (len(q), len(c)))], 1)
        best, who = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)
    row, column = np.nonzero((who >= 0) & (best >= floor[:, None]))
    return row, who[row, column], best[row, column]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def candidates(codes: DataFrame, queries: DataFrame, books: np.ndarray, rerank: int, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, entry, near of the rerank codes that look-up tables put first. codes: CHUNKS; queries: query_id, q."""
    spark = codes.sparkSession
    sent = spark.sparkContext.broadcast(books)
    parts, asked = -(-(codes.agg(F.sum("n")).first()[0] or 0) // part), queries.count()
    blocks = max(-(-asked // block), min(FEW_BLOCKS, -(-asked // LEAST_BLOCK)))
    codes = codes.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        entry, norm, packed = (np.frombuffer(b"".join(left[c].to_pylist()), kind) for c, kind in (("entries", np.int64), ("norms", np.float32), ("codes", np.uint8)))
        packed = packed.reshape(len(entry), -1) if len(entry) else packed
        ids, floor = right["query_id"].to_numpy(), right["floor"].to_numpy()
        found = [pa.table({"query_id": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})]
        for at in range(0, len(ids) if len(entry) else 0, SOME_QUERIES):
            q = unit(_matrix(right["q"].slice(at, SOME_QUERIES).combine_chunks()))
            row, code, near = table_scores(q, packed, norm, sent.value, floor[at : at + SOME_QUERIES], rerank)
            found.append(pa.table({"query_id": ids[at + row], "entry": entry[code], "near": near}))
        return pa.concat_tables(found)

    lowest = F.lit(float("-inf")).cast("float")
    best, first = None, 0
    while first < parts:
        last = min(parts, max(1, 2 * first))
        asking = queries.withColumn("floor", lowest)
        if best is not None:
            floors = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= rerank, F.min("near")).alias("floor"))
            asking = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))
        wave = codes.filter((F.col("part") >= first) & (F.col("part") < last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        new = wave.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(score, "query_id long, entry long, near float")
        both = new if best is None else best.unionAll(new)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "entry"))
        best, before = written(both.withColumn("r", rank).filter(F.col("r") <= rerank).drop("r"), "candidates"), best
        if before is not None:
            forget(before)
        first = last
    return best


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, rerank: int = RERANK, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the top of every query (rows whose id is divisible by every) by cosine."""
    spark = vectors.sparkSession
    v = written(usable(vectors).withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"))), "vectors")
    # A class of equal vectors is known by its least ids, one more than an answer holds: the query itself may be one.
    rank = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    members = written(v.select("same", "vec_id").withColumn("r", rank).filter(F.col("r") <= top + 1), "members")
    entries = v.join(members.filter("r = 1").select(F.col("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("entry"), "v")
    queries = v.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n = members.filter("r = 1").count()
    if not n or queries.isEmpty():
        return spark.createDataFrame([], FOUND)
    books = learned(entries, n)
    sent = spark.sparkContext.broadcast(books)

    @lean
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                x = unit(_matrix(some.column(1)))
                coded = [encode(x[k : k + 1000], sent.value) for k in range(0, len(x), 1000)]
                blobs = [some.column(0).to_numpy(), *(np.concatenate(c) for c in zip(*coded, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(x)]), *[pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs]], ["chunk", "n", "entries", "codes", "norms"])
                chunk += 1

    codes = written(entries.mapInArrow(code, CHUNKS), "codes")
    found = candidates(codes, queries, books, rerank, part)
    forget(codes)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = found.join(entries, "entry").join(queries, "query_id").select("query_id", "entry", (dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))).alias("score"))
    # Entries tie at the last score kept too: their ids decide, so all entries with one of the top + 1 scores stay.
    few = exact.withColumn("r", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("r") <= top + 1).drop("r")
    heads = members.filter("r = 1").select("same", F.col("vec_id").alias("entry"))
    all_ids = few.join(heads, "entry").join(members.select("same", "vec_id"), "same").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = all_ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    out = written(out, "nearest")
    forget(v, members, found)
    return out
