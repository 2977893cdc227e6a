"""LM scoring by a gated recurrent network with a class-factored softmax, in numpy.

Tokens are words and one end a document. The LISTED most frequent ones have vectors; they are binned into CLASSES classes by
the square roots of their counts. log p(word | state) = log p(class | state) + log p(word | class, state), both softmaxes of
the state. Words that are not listed belong to one of TAIL further classes by their last two bytes; as their number has no
bound, their probability within it comes from add-one counts over the whole training corpus, with one place for unseen words.

1. Counts of all words of all training documents, by Spark.
2. Training by truncated backpropagation through WINDOW steps. Training documents are dealt by text and id to replicas of
   about REPLICA tokens. A replica lays its documents one after the other in up to LANES lanes that advance side by side,
   window by window, each carrying its state on to the next window and losing it at a document's end, so every token and
   every end is learned from once. Replicas train for ROUNDS rounds, each on its share of documents; after each, executors
   average their parameters and the driver gets the mean (about 1 MB).
3. Scoring: all documents of a batch advance together, each carrying its state to its end, so a document's
   log-likelihood is that of the whole. Words of the at most COMMON most frequent have their counts at hand (that many
   are broadcast, whatever the corpus); the rest is joined with the table of counts.

Defined results: null and empty text is the end alone; a null doc_id is a training document; equal rows are scored each
and counted each; very long documents are carried through whole; without training documents all words are unseen; no
documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import collected, crc32_of, forget, lean, written
from .huffman import binary
from .textbytes import Texts, distinct, flat, mix, slices, words

LISTED, CLASSES, TAIL, HIDDEN = 4096, 64, 16, 16
WINDOW, REPLICA, ROUNDS = 64, 8_000_000, 3
LANES, SPEED = 192, 0.012
COMMON = 1 << 19
#: States whose outputs are computed together, the size of outputs whose exponentials are shifted, and the rows of an id summed at once.
TOGETHER, FAR, OFTEN = 2048, 60.0, 24
#: Numbers of a chunk of parameters.
CHUNK = 1 << 14
#: Stands for the end of a document among hashes of words.
END = -7046029254386353131

U = np.uint64


def tail_class(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    last = data[stop - 1].astype(U)
    before = np.where(stop - start > 1, data[np.maximum(stop - 2, 0)], 0).astype(U)
    return (mix(last << U(8) | before) % U(TAIL)).astype(np.uint8)


class Slice:
    """The tokens of some documents: hashes and tail classes of words, and each document's first token with an end after its words."""

    def __init__(self, texts: Texts):
        w = words(texts)
        keys, one, inverse = distinct(w.hashes().view(np.int64))
        n = len(texts.offsets) - 1
        ends = w.first[1:]
        self.keys = np.append(keys, END)
        self.tails = np.append(tail_class(w.data, w.start[one], w.stop[one]) if len(one) else np.zeros(0, np.uint8), np.uint8(0))
        self.token = np.insert(inverse, ends, len(keys))
        self.first = w.first + np.arange(n + 1)


def count_words(train: DataFrame) -> DataFrame:
    """key, tail, c of every distinct token of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(0)):
                s = Slice(texts)
                c = np.bincount(s.token, minlength=len(s.keys))
                yield pa.RecordBatch.from_arrays([pa.array(s.keys), pa.array(s.tails.astype(np.int32)), pa.array(c)], ["key", "tail", "c"])

    return train.select("text").mapInArrow(run, "key long, tail int, c long").groupBy("key", "tail").agg(F.sum("c").alias("c")).filter("c > 0")


class Words:
    """What scoring knows of the corpus: listed words by class, common words' counts, totals of the tail classes. Its size has fixed bounds."""

    def __init__(self, counts: DataFrame, common: int, listed: int = LISTED):
        self.total, self.distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
        rows = counts.filter(F.col("key") != END).orderBy(F.desc("c"), "key").limit(listed - 1).select("key", "c").unionAll(counts.filter(F.col("key") == END).select("key", "c")).collect()
        rows = sorted([(r[1], r[0]) for r in rows], key=lambda x: (-x[0], x[1])) or [(0, END)]
        heads, often = np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows], float)
        # Ids ascend by class and, in it, by count; classes hold like sums of square roots of counts.
        share = np.cumsum(np.sqrt(often + 1))
        of = np.minimum((share - np.sqrt(often + 1) / 2) / share[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        _, self.class_of = np.unique(of, return_inverse=True)
        self.often, self.end = often, int(np.flatnonzero(heads == END)[0])
        order = np.argsort(heads)
        self.heads, self.head_id = heads[order], order
        # The least count at which the words counted so often are common at most.
        level = F.floor(F.log2(F.col("c").cast("double")) * 8)
        at_level = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
        self.level, held = 10_000, 0
        for r in at_level:
            held += r["n"]
            if held > common:
                break
            self.level = r["level"]
        rows = counts.filter(level >= self.level).select("key", "c").toArrow()
        keys, c = np.concatenate([rows["key"].to_numpy(), heads]), np.concatenate([rows["c"].to_numpy(), often.astype(np.int64)])
        self.keys, first = np.unique(keys, return_index=True)
        self.counts = c[first]
        unlisted = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(k),) for k in heads], "key long")), "key", "left_anti")  # LISTED rows
        self.tails = np.zeros(TAIL)
        room = np.ones(TAIL)
        for r in unlisted.groupBy("tail").agg(F.sum("c"), F.count(F.lit(1))).collect():
            self.tails[r[0]], room[r[0]] = r[1], r[1] + r[2] + 1
        self.tail_logs = np.log10(room)

    def ids(self, keys: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Ids of listed words; those of others are the number of listed words plus their tail class."""
        place = np.minimum(np.searchsorted(self.heads, keys), len(self.heads) - 1)
        return np.where(self.heads[place] == keys, self.head_id[place], len(self.heads) + tails.astype(np.int64))

    def count_of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of common words; -1 of others."""
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.counts[place], -1)


class Network:
    """Parameters as views of one flat array: x (of each id), u, b of the unit; o, c of the classes; w, d of the words in them."""

    def __init__(self, class_of: np.ndarray, end: int, flat: np.ndarray | None = None):
        n, self.end = len(class_of), end
        classes = int(class_of.max()) + 1
        self.class_of = np.concatenate([class_of, classes + np.arange(TAIL)]).astype(np.uint8)
        #: Each class's first word; tail classes have none.
        self.first = np.searchsorted(class_of, np.arange(classes + 1))
        shapes = {"x": (n + TAIL, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "o": (HIDDEN, classes + TAIL), "c": (classes + TAIL,), "w": (HIDDEN, n), "d": (n,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat, at = np.zeros(size, np.float32) if flat is None else flat, 0
        self.p = {}
        for name, shape in shapes.items():
            count = int(np.prod(shape))
            self.p[name] = self.flat[at : at + count].reshape(shape)
            at += count

    def like(self, flat: np.ndarray) -> Network:
        return Network(self.class_of[:-TAIL], self.end, flat)


def new_network(known: Words) -> Network:
    net = Network(known.class_of, known.end)
    rng = np.random.default_rng(7)
    net.flat[:] = rng.standard_normal(len(net.flat)) * 0.15
    p = net.p
    p["b"][:] = 0
    p["b"][:HIDDEN] = 1  # keeps the state at first
    in_class = np.bincount(known.class_of, known.often)
    p["c"][:] = np.log((np.concatenate([in_class, known.tails]) + 1) / (in_class.sum() + known.tails.sum() + len(p["c"])))
    p["d"][:] = np.log((known.often + 1) / (in_class[known.class_of] + 1))
    return net


def step(u: np.ndarray, x: np.ndarray, h: np.ndarray, gates: np.ndarray, own: np.ndarray, new: np.ndarray) -> np.ndarray:
    """One step of the gated unit, a column a document: the new state. u: p["u"] turned; x: columns of p["x"] plus p["b"].

    Filled in: gates (keep above reset), own (the candidate's recurrent part) and new (the candidate)."""
    np.matmul(u[: 2 * HIDDEN], h, out=gates)
    np.matmul(u[2 * HIDDEN :], h, out=own)
    gates += x[: 2 * HIDDEN]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[HIDDEN:], own, out=new)
    new += x[2 * HIDDEN :]
    np.tanh(new, out=new)
    now = h - new
    now *= gates[:HIDDEN]
    now += new
    return now


def reach(p: np.ndarray, states: np.ndarray) -> float:
    """What no output of p (a row an output, the bias last) exceeds in size on the states (a row each, with a last column of ones)."""
    return float((np.abs(p) @ np.abs(states).max(0, initial=0)).max(initial=0))


def log_softmax_at(p: np.ndarray, states: np.ndarray, target: np.ndarray, far: bool, weight: np.ndarray | None = None, grad: np.ndarray | None = None, back: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the probability of each state's target among the outputs of p. far: whether exponentials need a shift.

    With weight: adds the loss's gradients, weighed by state, to grad and back."""
    logs = np.empty(len(target), np.float32)
    for a in range(0, len(target), TOGETHER):
        here = slice(a, a + TOGETHER)
        s, t = states[here], target[here]
        column = np.arange(len(t))
        out = p @ s.T
        if far:
            out -= out.max(0)
        picked = out[t, column]
        np.exp(out, out=out)
        total = out.sum(0)
        logs[here] = picked - np.log(total)
        if weight is not None:
            out[t, column] -= total
            scale = (weight[here] / total)[:, None]
            grad += out @ (s * scale)
            back[here] += (out.T @ p[:, :-1]) * scale
    return logs


def log_likelihoods(net: Network, states: np.ndarray, target: np.ndarray, grad: dict | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each target id's probability (of its tail class, if not listed) given the state: class, then word in the class.

    With grad: adds the gradients of the mean loss, weighed, to it and also returns that of the states."""
    p, of = net.p, net.class_of[target]
    order = np.argsort(of, kind="stable")
    of, target = of[order], target[order].astype(np.int64)
    cuts = np.searchsorted(of, np.arange(len(net.first)))
    s = np.ones((len(order), HIDDEN + 1), np.float32)
    s[:, :-1] = states[order]
    classes, words = (np.vstack([p[w], p[bias]]).T.copy() for w, bias in (("o", "c"), ("w", "d")))
    of_classes = of_words = back = None
    if grad is not None:
        weight, back = weight[order], np.zeros((len(order), HIDDEN), np.float32)
        of_classes, of_words = np.zeros_like(classes), np.zeros_like(words)
    logs = log_softmax_at(classes, s, of, reach(classes, s) > FAR, weight, of_classes, back)
    far = reach(words, s) > FAR
    for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(net.first) > 1)):
        here, own = slice(cuts[k], cuts[k + 1]), slice(net.first[k], net.first[k + 1])
        parts = () if grad is None else (weight[here], of_words[own], back[here])
        logs[here] += log_softmax_at(words[own], s[here], target[here] - net.first[k], far, *parts)
    unsorted = np.empty_like(logs)
    unsorted[order] = logs
    if grad is None:
        return unsorted, None
    for (w, bias), g in ((("o", "c"), of_classes), (("w", "d"), of_words)):
        grad[w] += g[:, :-1].T
        grad[bias] += g[:, -1]
    of_states = np.empty_like(back)
    of_states[order] = back
    return unsorted, of_states


def sums_by_id(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sum of each one's rows."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order].astype(np.int64), prepend=-1))
    n = np.diff(first, append=len(ids))
    out = rows[order[first]]
    for k in np.flatnonzero(n > OFTEN):
        out[k] = np.ones(n[k], rows.dtype) @ rows[order[first[k] : first[k] + n[k]]]
    few = np.flatnonzero((n > 1) & (n <= OFTEN))
    for j in range(1, OFTEN):
        few = few[n[few] > j]
        out[few] += rows[order[first[few] + j]]
    return ids[order[first]], out


@np.errstate(over="ignore")  # a closed gate
def gradient(net: Network, given: np.ndarray, target: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of a window and its gradient through all its steps, and the states after it. given, target and real (whether it counts): a row a step, a column a lane."""
    p, g = net.p, net.like(np.zeros_like(net.flat))
    steps, n = given.shape
    inputs, u, h = p["x"] + p["b"], np.ascontiguousarray(p["u"].T), np.ascontiguousarray(h.T)
    same = (given != net.end).astype(np.float32)  # a document's first step has no state
    olds, own, new = (np.empty((steps, HIDDEN, n), np.float32) for _ in range(3))
    gates, states = np.empty((steps, 2 * HIDDEN, n), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        np.multiply(h, same[t], out=olds[t])
        h = step(u, np.ascontiguousarray(inputs[given[t]].T), olds[t], gates[t], own[t], new[t])
        states[t] = h.T
    weight = real.reshape(-1).astype(np.float32) / np.float32(max(1, int(real.sum())))
    logs, back = log_likelihoods(net, states.reshape(-1, HIDDEN), target.reshape(-1), g.p, weight)
    back = back.reshape(steps, n, HIDDEN)
    # What a state's gradient is multiplied by on its way to the gates and the candidate.
    keep, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
    to_new = (1 - keep) * (1 - new * new)
    to_keep = (olds - new) * keep * (1 - keep)
    to_reset = own * reset * (1 - reset)
    d, through = np.zeros((HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
    of_inputs = np.empty((steps, n, 3 * HIDDEN), np.float32)
    for t in reversed(range(steps)):
        d += back[t].T
        d_new = d * to_new[t]
        np.multiply(d, to_keep[t], out=through[:HIDDEN])
        np.multiply(d_new, to_reset[t], out=through[HIDDEN : 2 * HIDDEN])
        of_inputs[t, :, : 2 * HIDDEN] = through[: 2 * HIDDEN].T
        of_inputs[t, :, 2 * HIDDEN :] = d_new.T
        np.multiply(d_new, reset[t], out=through[2 * HIDDEN :])
        g.p["u"][:] += olds[t] @ through.T
        d *= keep[t]
        d += p["u"] @ through
        d *= same[t]
    of_inputs = of_inputs.reshape(-1, 3 * HIDDEN)
    g.p["b"][:] = np.ones(len(of_inputs), np.float32) @ of_inputs
    ids, sums = sums_by_id(given.reshape(-1), of_inputs)
    g.p["x"][ids] = sums
    return -float(logs @ weight), g.flat, h.T


def train(net: Network, ids: np.ndarray, speed: float = SPEED) -> Network:
    """One pass over documents that lie one after the other, each ending in net.end, by Adam. Lanes carry their states from window to window."""
    net = net.like(net.flat.copy())
    m, v = np.zeros_like(net.flat), np.zeros_like(net.flat)
    lanes = max(1, min(LANES, len(ids) // (48 * WINDOW)))
    length = -(-len(ids) // lanes)
    target = np.zeros(lanes * length, ids.dtype)
    target[: len(ids)] = ids
    given = np.concatenate([np.array([net.end], ids.dtype), target[:-1]])
    real = (np.arange(lanes * length) < len(ids)).reshape(lanes, length).T
    given, target = (np.ascontiguousarray(a.reshape(lanes, length).T) for a in (given, target))
    h = np.zeros((lanes, HIDDEN), np.float32)
    for k, at in enumerate(range(0, length, WINDOW), 1):
        here = slice(at, at + WINDOW)
        if not real[here].any():
            break
        _, g, h = gradient(net, given[here], target[here], real[here], h)
        g *= min(1.0, 1.0 / max(1e-9, float(np.sqrt(g @ g))))
        m *= 0.9
        m += 0.1 * g
        g *= g
        v *= 0.99
        v += 0.01 * g
        net.flat[:] -= (speed / (1 - 0.9**k)) * m / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def training_ids(docs: DataFrame, known: Words) -> DataFrame:
    """place (a hash that orders and deals out) and ids (16 bits each, the end last) of the training texts."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for texts in slices(batch.column(0)):
                s = Slice(texts)
                ids = known.ids(s.keys, s.tails).astype("<u2")[s.token]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(texts.row, len(s.first) - 1), pa.array(np.diff(s.first)), binary(ids.view(np.uint8), s.first * 2)], ["place", "n", "ids"])

    return docs.select("text", F.xxhash64("text", "doc_id").alias("version")).mapInArrow(run, "place long, n long, ids binary")


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The means of rows (at, n, values) by at, weighed by n."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for at, n, values in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            now = np.frombuffer(values, np.float32) * float(n)
            total[at] = (total[at][0] + n, total[at][1] + now) if at in total else (n, now)
    if total:
        yield chunks({at: x / n for at, (n, x) in total.items()}, [n for n, _ in total.values()])


def chunks(values: dict[int, np.ndarray], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(values), pa.int32()), pa.array(n, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in values.values()], pa.binary())], ["at", "n", "values"])


def train_network(texts: DataFrame, net: Network, replica: int, rounds: int) -> Network:
    """Local training in replicas, averaged after each round. texts: place, n, ids."""
    spark, schema = texts.sparkSession, "at int, n long, values binary"
    replicas = max(1, -(-(texts.agg(F.sum("n")).first()[0] or 0) // replica))
    for k in range(rounds):

        @lean
        def run(batches: Iterator[pa.RecordBatch], sent=spark.sparkContext.broadcast(net)) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.zeros(0, "<u2")] + [flat(batch.column(0))[0].copy().view("<u2") for batch in batches])
            if len(ids):
                # A replica counts by its tokens, however many documents it got.
                out = train(sent.value, ids).flat
                parts = {k: out[a : a + CHUNK] for k, a in enumerate(range(0, len(out), CHUNK))}
                yield chunks(parts, [len(ids)] * len(parts))

        part = texts.filter(F.pmod(F.xxhash64("place", F.lit(2)), F.lit(rounds)) == k).repartition(replicas, "place").sortWithinPartitions("place", "n").select("ids")
        rows = collected(part.mapInArrow(run, schema).repartition(8, "at").mapInArrow(averaged, schema))
        if rows:
            net = net.like(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["at"])]).copy())
    return net


@np.errstate(over="ignore")  # a closed gate
def token_logs(net: Network, ids: np.ndarray, first: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """log10 of the probability of each token (of its tail class, if not listed). All documents advance together; each keeps its state to its end."""
    length = np.diff(first)
    by_length = np.argsort(-length, kind="stable")
    rank = np.empty(len(length), np.int32)
    rank[by_length] = np.arange(len(length))
    alive = len(length) - np.searchsorted(np.sort(length), np.arange(1, (length.max() if len(length) else 0) + 1), "left")
    at = np.concatenate(([0], np.cumsum(alive)))
    place = np.arange(len(ids), dtype=np.int32)
    place -= np.repeat(first[:-1].astype(np.int32), length)
    place = at.astype(np.int32)[place]
    place += np.repeat(rank, length)
    packed = np.empty_like(ids)
    packed[place] = ids
    out = np.empty(len(ids), np.float32)
    u, inputs = np.ascontiguousarray(net.p["u"].T), net.p["x"] + net.p["b"]
    h, begin, held = np.zeros((HIDDEN, len(length)), np.float32), 0, []
    for t, n in enumerate(alive.tolist()):
        given = packed[at[t - 1] : at[t - 1] + n] if t else np.full(n, net.end)
        h = step(u, np.ascontiguousarray(inputs[given].T), h[:, :n], *(np.empty((k * HIDDEN, n), np.float32) for k in (2, 1, 1)))
        held.append(h)
        stop = at[t + 1]
        if stop - begin >= block or t + 1 == len(alive):
            states = np.concatenate([x.T for x in held])
            for a in range(0, stop - begin, block):
                b = min(a + block, stop - begin)
                out[begin + a : begin + b] = log_likelihoods(net, states[a:b], packed[begin + a : begin + b])[0]
            begin, held = stop, []
    return out[place] / np.log(10)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(7)) == 2, F.lit(False))


SCORED_AS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<key:long,n:int>>"


def scored_batch(known: Words, network: Network, batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
    """Rows as SCORED_AS says, numbered from row, of a batch of doc_id, held_out and text.

    Words are looked up a slice at a time; all documents advance together, as a step costs nearly the same for few as for many."""
    listed, base_log = len(known.heads), np.log10(known.total + known.distinct + 1)
    parts, tokens, length = [], [], []
    for texts in slices(batch.column(2)):
        s = Slice(texts)
        n = len(s.first) - 1
        ids = known.ids(s.keys, s.tails)
        c = known.count_of(s.keys)
        logs = np.log10(np.maximum(c, 0) + 1.0)
        inside = np.where(ids < listed, 0.0, logs - known.tail_logs[np.maximum(ids - listed, 0)])
        sums = lambda x, first=s.first: np.add.reduceat(x, first[:-1])  # noqa: E731  every document has a token
        seen = (c > 0)[s.token]
        odd = np.flatnonzero((c < 0)[s.token])
        doc = np.searchsorted(s.first, odd, "right") - 1
        pairs, one, of = distinct(doc * len(s.keys) + s.token[odd])
        times = np.bincount(of, minlength=len(pairs)).astype(np.int32)
        keys = s.keys[s.token[odd[one]]] if len(one) else np.zeros(0, np.int64)
        offsets = np.searchsorted(pairs, np.arange(n + 1) * len(s.keys)).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"]))
        parts.append((texts.row, n, sums(seen.astype(np.int64)), sums(logs[s.token] - base_log), sums(inside[s.token]), rare))
        tokens.append(ids.astype(np.uint16)[s.token])
        length.append(np.diff(s.first))
    if not parts:
        return
    first = np.concatenate([[0], *length]).cumsum()
    score = np.add.reduceat(token_logs(network, np.concatenate(tokens), first), first[:-1])
    for (at, n, n_known, base, inside, rare), n_tokens in zip(parts, length, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score[at : at + n] + inside), rare], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
        row += n


def score_documents(docs: DataFrame, replica: int = REPLICA, rounds: int = ROUNDS, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    training = docs.filter("NOT held_out")
    counts = written(count_words(training), "counts")
    known = Words(counts, common)
    texts = written(training_ids(training, known), "training")
    network = train_network(texts, new_network(known), replica, rounds)
    forget(texts)
    sent = spark.sparkContext.broadcast((known, network))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, network = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield from scored_batch(known, network, batch, row)
            row += len(batch)

    scored = written(docs.select("doc_id", "held_out", "text").mapInArrow(run, SCORED_AS), "scored", batch_bytes="16m")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.n")
    # Unseen words add log10(1) = 0 and are known 0 times, so an inner join is enough.
    more = rare.join(counts.select("key", "c"), "key").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("logs"), F.sum("n").alias("times"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("times", F.lit(0))).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
