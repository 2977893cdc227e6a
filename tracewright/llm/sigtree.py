"""N-gram Jaccard join by signature trees.

A document's set holds its distinct SHINGLE-word shingles as 64-bit hashes; documents link when 100 * intersection >=
85 * union. The join returns components, so a pair already connected need not be compared.

1. Documents with equal sets are one node (their sets' 64-bit digest).
2. Candidates, exactly: two sets that link differ in at most D = 15/185 of their sizes' sum of elements, so when the hash
   range is cut into D + 1 + s parts, at least s + 1 parts are equal; some part that is not empty, unless both sets have
   more than s empty ones, in which case the empty parts are emitted too. Parts are numbered within classes of sizes; a
   set near a class's top is emitted in the next as well. Sets that share fewer
   parts with others than a link takes have none and end here. If a link takes m parts, a set's m - 1 most frequent ones connect
   nothing: the rarest part that two linked sets share is not among them, in one global order of parts.
3. The candidates' connected components are the blocks. Blocks above DIVIDED times CHUNK tokens are divided first, by the same filter with
   FINE instead of COARSE spare parts, which takes more signatures and lets less through. In a block, a signature tree holds at each node the OR of its
   members' token bitmaps, the range of their sizes and what bitmaps may undercount. A dual traversal of the tree with
   itself drops pairs of nodes whose greatest possible overlap is below the least one needed, whose sizes don't fit, or
   whose members are all connected already. What is left is compared exactly.
4. A block above CHUNK tokens is cut into chunks. Each chunk also gets the block's first LEADERS members, which
   connects most of them; then the members outside the block's largest component go to all chunks and are compared
   there. Two members in different components never are both inside the largest, so every such pair is compared.

Defined results: null and empty texts, or texts without words, have 0 shingles and are their own component; with fewer
words than SHINGLE the whole sequence is one; equal rows and equal ids link; a null doc_id counts in no minimum, and a
component of nulls alone has a null id; very long texts are whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import forget, lean, small, written
from .components import components
from .huffman import binary
from .textbytes import Texts, flat, mix, slices, words

SHINGLE = 4
#: The threshold in hundredths.
PERCENT = 85
LEAF = 16
FAN = 4
HUBS = 12
#: Parts to spare (s) as hundredths of the elements in which linked sets may differ: for all sets, and for those of large blocks.
COARSE, FINE = 25, 100
#: Chunks above which a block is divided by finer signatures first, which shuffle about twenty times its tokens' bytes.
DIVIDED = 4
#: Bytes of text whose sets are made at once.
SLICE = 1 << 20
#: Tokens of a task's share of a block.
CHUNK = 6_000_000
LEADERS = 32
#: Passes over the signatures, each with its share of them, so that one share at a time lies in shuffle files.
PASSES = 4

U = np.uint64
_STEP = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes in ascending order, and their offsets."""
    w = words(texts)
    h = w.hashes()
    n = len(texts.offsets) - 1
    count = np.diff(w.first)
    sums = np.zeros(len(h), U)
    for k in range(size):
        factor = mix(np.array([_STEP[k % 4] + U(k)]))[0] | U(1)
        sums[: len(h) - k] += h[k:] * factor
    sums = mix(sums)
    parts = []
    for first, c in zip(w.first[:-1].tolist(), count.tolist(), strict=True):
        if c >= size:
            s = np.sort(sums[first : first + c - size + 1])
            parts.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            short = U(c)
            for x in h[first : first + c]:
                short = mix(np.array([short], U) * _STEP[0] + x)[0]
            parts.append(np.array([short], U))
        else:
            parts.append(np.zeros(0, U))
    return (np.concatenate(parts) if n else np.zeros(0, U)), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


@lru_cache
def classes(percent: int, spare: int = COARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each class, its parts, and its slack of empty parts."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] * 3 // 2, low[-1] * 100 // percent + 2, 7))
    low = np.array(low, np.int64)
    differ = 2 * (100 - percent) * (low[1:] - 1) // (100 + percent)
    slack = 2 + -(-differ * spare // 100)
    return low, np.where(differ > 0, differ + 1 + slack, 0), slack


def signatures(tokens: np.ndarray, offsets: np.ndarray, step: int, percent: int = PERCENT, spare: int = COARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and signature of every part that is emitted in the documents' own class of sizes (step 0) or the next (1), and of
    each document how many of its signatures it has in common, at least, with any set that it links with there."""
    low, parts_of, slack_of = classes(percent, spare)
    size = np.diff(offsets)
    at = np.maximum(np.searchsorted(low, size, "right") - 1, 0) + step
    wanted = (size > 0) & (parts_of[at] > 0)
    if step:
        wanted &= 100 * size >= percent * low[at]
    row = np.repeat(np.arange(len(size)), size)
    use = wanted[row]
    row, token = row[use], tokens[use]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(size), np.int64)
    count = parts_of[at][row].astype(U)
    # Tokens ascend in a document, and so do their parts.
    part = (token >> U(32)) * count >> U(32)
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part.view(np.int64), prepend=-1) != 0))
    row, part, total = row[first], part[first], np.add.reduceat(mix(token * _STEP[1]), first)
    kind = at[row].astype(U) << U(40) | part
    docs, sigs = [row], [mix(total ^ mix(kind * _STEP[2] + U(1)))]
    empty = parts_of[at] - np.bincount(row, minlength=len(size))
    # s + 1 parts are equal; of them at most the smaller number of empty parts is not emitted.
    need = np.where(empty > slack_of[at], 1, slack_of[at] + 1 - empty)
    for d in np.flatnonzero(wanted & (empty > slack_of[at])):
        gone = np.setdiff1d(np.arange(parts_of[at[d]]), part[row == d].astype(np.int64)).astype(U)
        docs.append(np.full(len(gone), d))
        sigs.append(mix(mix((U(at[d]) << U(40) | gone) * _STEP[2] + U(1)) ^ U(0)))
    return np.concatenate(docs), np.concatenate(sigs), need


def digests(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(tokens ^ _STEP[3]))))
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U)).view(np.int64)


SIGNED = "need0 long, sigs0 array<long>, need1 long, sigs1 array<long>"


def signed(tokens: np.ndarray, offsets: np.ndarray, percent: int, spare: int) -> list[pa.Array]:
    """The columns SIGNED: signatures() of both steps as lists."""
    n, out = len(offsets) - 1, []
    for step in (0, 1):
        row, sigs, need = signatures(tokens, offsets, step, percent, spare)
        order = np.argsort(row, kind="stable")
        out += [pa.array(need), pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)), pa.array(sigs[order].view(np.int64)))]
    return out


class Node:
    __slots__ = ("bits", "children", "excess", "high", "low", "members", "most")

    def __init__(self, bits, excess, low, high, most, members, children=()):
        self.bits, self.excess, self.low, self.high, self.most, self.members, self.children = bits, excess, low, high, most, members, children


class Tree:
    """The members of a chunk (sorted token arrays) and what connects them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets])
        self.label = np.arange(len(sets))
        self.of = {i: [i] for i in range(len(sets))}
        self.shared = np.zeros(len(sets), np.int64)
        self.active = np.arange(len(sets))
        while len(self.active):
            self.shared[self.active] = self.counted()
            may = 100 * self.shared[self.active] >= percent * self.size[self.active]
            if may.all():
                break
            self.active = self.active[may]

    def counted(self) -> np.ndarray:
        """How many of its tokens each active member can share: those that another one holds too. Under the threshold, it links with none."""
        tokens = np.concatenate([self.sets[i] for i in self.active])
        order = np.argsort(tokens)
        ranked = tokens[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(tokens), np.int64)
        twice[order[1:][same]] = twice[order[:-1][same]] = 1
        return np.add.reduceat(twice, np.cumsum(self.size[self.active]) - self.size[self.active])

    def union(self, i: int, j: int) -> None:
        i, j = int(self.label[i]), int(self.label[j])
        if i != j:
            if len(self.of[i]) < len(self.of[j]):
                i, j = j, i
            moved = self.of.pop(j)
            self.label[moved] = i
            self.of[i] += moved

    def compare(self, i: int, others: np.ndarray) -> None:
        """Links i with those of the others that it isn't connected with yet and that are similar enough."""
        others = others[self.label[others] != self.label[i]]
        if not len(others):
            return
        need = -(-self.percent * (self.size[i] + self.size[others]) // (100 + self.percent))
        may = np.minimum(self.shared[i], self.shared[others]) >= need
        others, need = others[may], need[may]
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            tokens = np.concatenate([self.sets[j] for j in some])
            own = self.sets[i]
            place = np.searchsorted(own, tokens)
            place[place == len(own)] = 0
            overlap = np.add.reduceat((own[place] == tokens).astype(np.int64), np.cumsum(self.size[some]) - self.size[some])
            for j in some[overlap >= need[at : at + 512]]:
                self.union(i, j)

    def build(self) -> Node:
        """Leaves of neighbours in the order of their first tokens, in which near copies lie together; then levels above."""
        members = np.array(sorted(self.active.tolist(), key=lambda i: (int(self.sets[i][0]), int(self.sets[i][-1]), i)))
        width = 1 << min(16, max(10, int(np.ceil(np.log2(16 * (1 + np.median(self.size)))))))
        level = []
        for at in range(0, len(members), LEAF):
            some = members[at : at + LEAF]
            bits, excess = np.zeros(width, bool), 0
            for i in some:
                own = np.zeros(width, bool)
                own[(self.sets[i] & U(width - 1)).astype(np.int64)] = True
                excess = max(excess, int(self.size[i]) - int(own.sum()))
                bits |= own
            level.append(Node(np.packbits(bits).view(U), excess, int(self.size[some].min()), int(self.size[some].max()), int(self.shared[some].max()), some))
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FAN):
                c = level[at : at + FAN]
                above.append(Node(np.bitwise_or.reduce([x.bits for x in c]), max(x.excess for x in c), min(x.low for x in c), max(x.high for x in c), max(x.most for x in c), np.concatenate([x.members for x in c]), c))
            level = above
        return level[0]

    def one_component(self, a: Node, b: Node) -> bool:
        root = self.label[a.members[0]]
        return bool((self.label[a.members] == root).all() and (a is b or (self.label[b.members] == root).all()))

    def hopeless(self, a: Node, b: Node) -> bool:
        if 100 * a.high < self.percent * b.low or 100 * b.high < self.percent * a.low:
            return True
        need = -(-self.percent * (a.low + b.low) // (100 + self.percent))
        if min(a.most, b.most) < need:
            return True
        return int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess) < need

    def traverse(self, a: Node, b: Node) -> None:
        """Compares the members of a with those of b (of one tree)."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.one_component(a, b) or a is not b and self.hopeless(a, b):
                continue
            if a is b:
                if a.children:
                    todo += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
                else:
                    for k, i in enumerate(a.members):
                        self.compare(i, a.members[k + 1 :])
            elif a.children and (len(a.members) >= len(b.members) or not b.children):
                todo += [(x, b) for x in a.children]
            elif b.children:
                todo += [(a, y) for y in b.children]
            else:
                for i in a.members:
                    self.compare(i, b.members)

    def join(self) -> None:
        everyone = self.active
        if len(everyone) <= LEAF:
            for k, i in enumerate(everyone):
                self.compare(i, everyone[:k])
            return
        # Members that share most of their tokens connect most of a group of near copies at once.
        for i in everyone[np.lexsort((everyone, (self.size - self.shared)[everyone]))[:HUBS]]:
            self.compare(i, everyone)
        root = self.build()
        self.traverse(root, root)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], list]]:
    """Nodes, sets and known components of each run of rows with one (block, chunk); each node once."""
    key, nodes, sets, known, seen = None, [], [], [], set()
    for batch in batches:
        data, offsets = flat(batch.column(3))
        data = data.copy().view(U)
        offsets = offsets // 8
        for k, (block, chunk, node, old) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if (block, chunk) != key:
                if len(nodes) > 1:
                    yield nodes, sets, known
                key, nodes, sets, known, seen = (block, chunk), [], [], [], set()
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(data[offsets[k] : offsets[k + 1]].copy())
                known.append(old)
    if len(nodes) > 1:
        yield nodes, sets, known


def _join_chunks(rows: DataFrame, tasks: int, percent: int) -> DataFrame:
    """Edges u, v that connect each chunk's components. rows: block, chunk, node, tokens, known (component so far, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets, known in _grouped(batches):
            tree = Tree(sets, percent)
            first: dict = {}
            for i, old in enumerate(known):
                if old is not None:
                    tree.union(first.setdefault(old, i), i)
            tree.join()
            found = [(nodes[i], nodes[r]) for i, r in enumerate(tree.label.tolist()) if r != i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

    return rows.repartition(tasks, "block", "chunk").sortWithinPartitions("block", "chunk", "node").mapInArrow(run, "u long, v long")


def _candidates(table: DataFrame) -> DataFrame:
    """node and root of the components of candidates, roots left out. table: node and SIGNED."""
    spark = table.sparkSession
    parts, each = [], []
    for k in range(PASSES):

        def of(sigs: Column, k: int = k) -> Column:
            return F.explode(F.filter(sigs, lambda x: F.pmod(x, F.lit(PASSES)) == k)).alias("sig")

        emitted = table.select("node", of(F.concat("sigs0", "sigs1")))
        shared = written(emitted.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("sig", "least"), "shared")
        steps = [table.select("node", F.lit(x).alias("step"), F.col(f"need{x}").alias("need"), of(F.col(f"sigs{x}"))) for x in (0, 1)]
        each.append(written(steps[0].unionAll(steps[1]).join(shared, "sig").distinct(), "met"))
        parts.append(shared)
    met = reduce(DataFrame.unionAll, each)
    forget(*parts)
    # A set with fewer signatures in common with others than a link takes has no link there; twice, as others go with it.
    for _ in range(2):
        able = met.groupBy("node", "step").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("most_needed")).filter("c >= most_needed").select("node", "step")
        left = met.join(able, ["node", "step"], "left_semi")
        again = left.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("often")).filter("least <> most").select("sig", "often")
        met = written(left.select("sig", "node", "step", "need").join(again, "sig"), "met")
        forget(*each)
        each = [met]
    # Of the need signatures in common the rarest is not among a set's need - 1 most frequent ones, so these connect nothing.
    w = Window.partitionBy("node", "step").orderBy(F.desc("often"), "sig")
    rare = written(met.withColumn("place", F.row_number().over(w)).filter("place >= need").select("sig", "node"), "rare")
    forget(met)
    least = rare.groupBy("sig").agg(F.min("node").alias("least"))
    found = components(rare.join(least, "sig").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    forget(rare)
    return found


def _members(rows: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """rows with column block, the component found of column on; those outside all components go."""
    blocks = found.unionAll(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias(on), F.col("root").alias("block"))
    return rows.join(blocks, on)


def labels(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, chunk_tokens: int = CHUNK, leaders: int = LEADERS) -> DataFrame:
    """doc_id, version (hash of the text), n (its shingles), label (the component's; null for no shingles) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")

    @lean
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2), SLICE):
                tokens, offsets = shingle_sets(texts, size)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.row, n), batch.column(1).slice(texts.row, n), pa.array(np.diff(offsets)), pa.array(digests(tokens, offsets)), *signed(tokens, offsets, percent, COARSE)], ["doc_id", "version", "n", "node", "need0", "sigs0", "need1", "sigs1"])

    both = written(docs.mapInArrow(sets_of, f"doc_id long, version long, n long, node long, {SIGNED}"), "sets")
    sets = written(both.select("doc_id", "version", "n", "node"), "sets")
    found = _candidates(both.filter("n > 0"))
    forget(both)
    chosen = sets.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "version", "n")).alias("d"))
    chosen = small(written(_members(chosen, found, "node").select("node", "block", F.col("d.doc_id").alias("its_id"), F.col("d.version").alias("its_version")), "chosen"))

    @lean
    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2), SLICE):
                tokens, offsets = shingle_sets(texts, size)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(texts.row, n), batch.column(0).slice(texts.row, n), pa.array(np.diff(offsets)), binary(tokens.view(np.uint8), offsets * 8)], ["block", "node", "n", "tokens"])

    fetched = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["its_id"]) & (docs["version"] == chosen["its_version"])).select("node", "block", "text")
    members = written(fetched.mapInArrow(tokens_of, "block long, node long, n long, tokens binary"), "members")
    heavy = members.groupBy("block").agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > DIVIDED * chunk_tokens).select("block")
    heavy = written(heavy, "heavy")
    if not heavy.isEmpty():
        heavy = small(heavy)

        def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *signed(data.copy().view(U), offsets // 8, percent, FINE)], ["node", "need0", "sigs0", "need1", "sigs1"])

        both = written(members.join(heavy, "block", "left_semi").select("node", "tokens").mapInArrow(finer, f"node long, {SIGNED}"), "fine")
        found = _candidates(both)
        forget(both)
        light = members.join(heavy, "block", "left_anti")
        divided = _members(members.join(heavy, "block", "left_semi").drop("block"), found, "node")
        whole, members = members, written(light.unionByName(divided).select("block", "node", "n", "tokens"), "members")
        forget(whole)
    total = members.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_tokens))
    weight = members.groupBy("block").agg(F.ceil(F.sum("n") / chunk_tokens).cast("int").alias("chunks"))
    placed = members.join(weight, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    large = weight.filter("chunks > 1")
    none = F.lit(None).cast("long").alias("known")
    rows = placed.select("block", "chunk", "node", "tokens", none)
    many = large.count()
    if many:
        first = members.join(large, "block").groupBy("block").agg(F.expr(f"slice(array_sort(collect_list(node) FILTER (WHERE pmod(xxhash64(node), chunks * {leaders * 64}) < {leaders * 64})), 1, {leaders})").alias("heads"))
        heads = members.join(first.select(F.col("block").alias("b"), F.explode("heads").alias("node")), "node").join(large, "block")
        rows = rows.unionAll(heads.select("block", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "node", "tokens", none))
    edges = written(_join_chunks(rows, tasks, percent), "links")
    if many:
        # What is outside a large block's largest component is compared with all of the block.
        now = components(edges)
        held = placed.join(large.select("block"), "block").join(now, "node", "left").withColumn("known", F.coalesce("root", "node")).select("block", "chunk", "chunks", "node", "tokens", "known")
        counts = held.groupBy("block", "known").agg(F.count(F.lit(1)).alias("c"))
        biggest = counts.groupBy("block").agg(F.max(F.struct("c", "known")).alias("top")).select("block", F.col("top.known").alias("main"))
        outside = held.join(biggest, "block").filter("known <> main").select("block", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "node", "tokens", "known")
        more = written(_join_chunks(held.select("block", "chunk", "node", "tokens", "known").unionAll(outside), tasks, percent), "links")
        edges = edges.unionAll(more)
    roots = components(edges)
    forget(members)
    return sets.select("doc_id", "version", "n", "node").join(roots, "node", "left").select("doc_id", "version", "n", F.expr("CASE WHEN n > 0 THEN coalesce(root, node) END").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, chunk_tokens: int = CHUNK, leaders: int = LEADERS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    labelled = labels(docs, percent, size, chunk_tokens, leaders)
    least = labelled.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component"))
    with_words = labelled.filter("n > 0").join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return with_words.unionAll(labelled.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least id, and every row without words.

    Rows that are equal in id and text are copies of each other; of them the least in the other columns stays."""
    labelled = labels(docs, percent, size).filter("n > 0")
    stays = labelled.groupBy("label").agg(F.min(F.struct("doc_id", "version")).alias("k")).select("label", "k")
    # Texts leave their rows only where their row may go or has an equal.
    judged = labelled.groupBy("label", "doc_id", "version").agg(F.count(F.lit(1)).alias("c")).join(stays, "label").withColumn("first", F.struct("doc_id", "version").eqNullSafe(F.col("k")))
    judged = small(written(judged.filter("NOT first OR c > 1").select("doc_id", "version", "first"), "judged"))

    def has(some: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(some["doc_id"]) & (F.xxhash64(docs["text"]) == some["version"])

    several = judged.filter("first")
    rows = docs.join(several, has(several), "left_semi").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    others = [F.col("row")[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and not re.search("map<|variant|interval", f.dataType.simpleString())]
    one = rows.groupBy(F.col("row")["doc_id"].alias("doc_id"), F.xxhash64(F.col("row")["text"]).alias("version")).agg(F.min_by("row", F.struct(*others, F.lit(0))).alias("row"))
    return docs.join(judged, has(judged), "left_anti").unionByName(one.select("row.*"))
