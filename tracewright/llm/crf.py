"""Language ID of code-switched text by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of one to three bytes, its byte bigrams and trigrams, and the lexicons
(each language's frequent training words) that hold it. The first are hashed into BUCKETS rows of weights, each lexicon has
a row of its own after them. All languages that label a training text are learned, with transitions between them. A document's words get their marginals by forward-backward over the whole text; the
language is the one with the largest mean marginal over words that have a letter, the score is that mean.

Training: at most PER_LABEL distinct labelled texts a language (whole texts; those of least hash). Documents have one label
each, so sequences that switch are made by dealing short stretches of different documents one after the other.

Defined results: null, empty and letterless texts are 'und' with score 0; words without letters have no emission; without
labelled documents everything is 'und'; ties go to the first label in order; null and repeated ids are rows like others;
very long texts are read whole; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import crc32_of, give_back, lean
from .textbytes import Texts, distinct, gather, mix, prefix_hashes, ranges, slices, span_hashes, strings, words

BUCKETS = 1 << 16
PER_LABEL = 200
LEXICON = 150
SEQUENCE, STEPS, SPEED, DECAY = 48, 45, 0.08, 1e-4
SLICE = 1 << 20
#: Distinct words whose features are looked at together.
SOME_WORDS = 1 << 14
#: Bytes of training texts that are hashed together, and sequences whose marginals are held at once.
FIT_SLICE, FIT_SEQUENCES = 1 << 17, 2048

U = np.uint64


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # BUCKETS rows, then one a lexicon
    transitions: np.ndarray  # probabilities up to a factor
    lexicon_keys: np.ndarray
    lexicon_of: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's features, and where each word's begin (and the end)."""
    start, stop = offsets[:-1], offsets[1:]
    n, length = len(start), stop - start
    prefix = prefix_hashes(data)
    fixed = []
    for k in (1, 2, 3):
        fixed.append(span_hashes(prefix, start, np.minimum(start + k, stop)) ^ U(0x1111 * k))
        fixed.append(span_hashes(prefix, np.maximum(stop - k, start), stop) ^ U(0x77770 * k))
    parts, counts = [np.stack(fixed, 1).reshape(-1)], []
    for k in (2, 3):
        count = np.maximum(length - k + 1, 0)
        at = ranges(start, count)
        parts.append(span_hashes(prefix, at, at + k))
        counts.append(count)
    total = 6 + counts[0] + counts[1]
    first = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(first[-1], U)
    out[ranges(first[:-1], np.full(n, 6))] = parts[0]
    out[ranges(first[:-1] + 6, counts[0])] = parts[1]
    out[ranges(first[:-1] + 6 + counts[0], counts[1])] = parts[2]
    return (mix(out) % U(BUCKETS)).astype(np.int64), first


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words hold a letter (Unicode category L)."""
    low = data | 0x20
    letters = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))))
    high = np.concatenate(([0], np.cumsum(data >= 128)))
    out = letters[offsets[1:]] > letters[offsets[:-1]]
    check = np.flatnonzero(~out & (high[offsets[1:]] > high[offsets[:-1]]))
    if len(check):
        out[check] = [any(map(str.isalpha, w)) for w in strings(*gather(data, offsets[check], offsets[check + 1]))]
    return out


class Vocabulary:
    """The distinct words of some documents with their features, and every token's word."""

    def __init__(self, *parts: Texts):
        found = [words(texts) for texts in parts]
        self.keys, one, self.token = distinct(np.concatenate([w.hashes() for w in found]))
        tokens, size = (np.cumsum([0, *(len(x) for x in of)]) for of in ([w.start for w in found], [w.data for w in found]))
        self.first = np.concatenate([[0], *(w.first[1:] + at for w, at in zip(found, tokens))])
        start, stop = (np.concatenate([x + at for x, at in zip(of, size)])[one] for of in ([w.start for w in found], [w.stop for w in found]))
        data, offsets = gather(np.concatenate([w.data for w in found]), start, stop)
        del found, start, stop
        self.some = [slice(at, at + SOME_WORDS) for at in range(0, len(self.keys), SOME_WORDS)]
        buckets, first = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for some in self.some:
            own = offsets[some.start : some.stop + 1]
            bucket, at = features(data[own[0] : own[-1]], own - own[0])
            buckets.append(bucket)
            first.append(at[1:] + first[-1][-1])
        self.buckets, self.at = np.concatenate(buckets), np.concatenate(first)
        self.letter = has_letter(data, offsets)

    def lexicon(self, keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are in a lexicon, and the bucket of each one's."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == self.keys)
        return hit, BUCKETS + of[place[hit]].astype(np.int64)

    def emissions(self, weights: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A row of label scores for each distinct word, the largest 1, and all 1 for words without letters."""
        if not len(self.keys):
            return np.zeros((0, weights.shape[1]))
        sums = np.empty((len(self.keys), weights.shape[1]), weights.dtype)
        for some in self.some:
            at = self.at[some.start : some.stop + 1]
            np.add.reduceat(weights[self.buckets[at[0] : at[-1]]], at[:-1] - at[0], axis=0, out=sums[some])
        sums[lexicon[0]] += weights[lexicon[1]]
        sums[~self.letter] = 0
        return np.exp(sums - sums.max(1, keepdims=True)) + 1e-12

    def by_row(self, by_word: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        """The words' numbers of one label, added up by the row of weights that each word's features have."""
        out = np.bincount(lexicon[1], by_word[lexicon[0]], rows)
        for some in self.some:
            at = self.at[some.start : some.stop + 1]
            out += np.bincount(self.buckets[at[0] : at[-1]], np.repeat(by_word[some], np.diff(at)), rows)
        return out


def marginals(emit: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward of all sequences (tokens first[i] to first[i + 1]) side by side; pairs gets the expected transitions added."""
    labels = len(transitions)
    length = np.diff(first)
    if not len(emit):
        return np.zeros((0, labels))
    by_length = np.argsort(-length, kind="stable")
    rank = np.empty(len(length), np.int64)
    rank[by_length] = np.arange(len(length))
    alive = len(length) - np.searchsorted(np.sort(length), np.arange(1, length.max() + 1), "left")
    at = np.concatenate(([0], np.cumsum(alive)))
    place = at[np.arange(len(emit)) - np.repeat(first[:-1], length)] + np.repeat(rank, length)
    e = np.empty_like(emit)
    e[place] = emit
    ahead, steps = np.empty_like(e), len(alive)
    now = e[: alive[0]]
    ahead[: alive[0]] = now = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (now[: alive[t]] @ transitions) * e[at[t] : at[t + 1]]
        now /= now.sum(1, keepdims=True)
        ahead[at[t] : at[t + 1]] = now
    back = np.ones((alive[-1], labels))
    turned = np.ascontiguousarray(transitions.T)
    for t in range(steps - 1, 0, -1):
        later = e[at[t] : at[t + 1]] * back
        if pairs is not None:
            x = ahead[at[t - 1] : at[t - 1] + alive[t]][:, :, None] * transitions * later[:, None, :]
            pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
        ahead[at[t] : at[t + 1]] *= back
        back = later @ turned
        back /= back.sum(1, keepdims=True)
        if alive[t - 1] > alive[t]:
            back = np.concatenate([back, np.full((alive[t - 1] - alive[t], labels), 1.0)])
    ahead[: alive[0]] *= back
    ahead /= ahead.sum(1, keepdims=True)
    return ahead[place]


def fit(texts: list[str], langs: list[str]) -> Model:
    """The field's weights and transitions from labelled texts, by gradient ascent on the log-likelihood of spliced sequences.

    The driver runs this: texts are hashed in slices and marginals taken in blocks of sequences, so that they need a few numbers a token."""
    labels = sorted(set(langs))
    k = len(labels)
    v = Vocabulary(*slices(pa.array(texts, pa.string()), FIT_SLICE))
    gold_doc = np.array([labels.index(x) for x in langs])
    length = np.diff(v.first)
    gold = np.repeat(gold_doc, length)
    # Lexicons: a language's frequent words that are twice as frequent in it as in all others together.
    counts = np.stack([np.bincount(v.token[gold == j], minlength=len(v.keys)) for j in range(k)], 1)
    keys, of = [], []
    for j in range(k):
        own = np.where(v.letter & (counts[:, j] > 2 * (counts.sum(1) - counts[:, j])), counts[:, j], 0)
        best = np.argsort(-own, kind="stable")[:LEXICON]
        best = best[own[best] > 1]
        keys.append(v.keys[best])
        of.append(np.full(len(best), j))
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    lexicon = v.lexicon(keys, of)
    # Stretches of 8 to 24 words in random order.
    rng = np.random.default_rng(11)
    cuts = np.unique(np.concatenate([np.cumsum(rng.integers(8, 25, len(gold) // 8 + 1)), v.first]))
    cuts = cuts[cuts <= len(gold)]
    start, count = cuts[:-1], np.diff(cuts)
    shuffled = rng.permutation(len(start))
    token_at = ranges(start[shuffled], count[shuffled])
    token, gold = v.token[token_at], gold[token_at]
    first = np.unique(np.append(np.arange(0, len(token), SEQUENCE), len(token)))
    inner = np.setdiff1d(np.arange(1, len(token)), first)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    weights, trans = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    target = np.stack([np.bincount(token[gold == j], minlength=len(v.keys)) for j in range(k)], 1)
    blocks = [first[at : at + FIT_SEQUENCES + 1] for at in range(0, len(first) - 1, FIT_SEQUENCES)]
    for step in range(1, STEPS + 1):
        pairs, by_word = np.zeros((k, k)), target.astype(float)
        emit, moves = v.emissions(weights, lexicon), np.exp(trans - trans.max())
        for block in blocks:
            some = token[block[0] : block[-1]]
            post = marginals(emit[some], block - block[0], moves, pairs)
            for j in range(k):
                by_word[:, j] -= np.bincount(some, post[:, j], len(v.keys))
        by_word[~v.letter] = 0
        g = np.stack([v.by_row(by_word[:, j], lexicon, BUCKETS + k) for j in range(k)], 1) / len(token) - DECAY * weights
        gt = (seen - pairs) / len(token)
        for x, grad, m, s in ((weights, g, state[0], state[1]), (trans, gt, state[2], state[3])):
            m += 0.2 * (grad - m)
            s += 0.05 * (grad * grad - s)
            x += SPEED * (m / (1 - 0.8**step)) / (np.sqrt(s / (1 - 0.95**step)) + 1e-6)
    return Model(labels, weights.astype(np.float32), np.exp(trans - trans.max()), keys, of)


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """fit() on the labelled documents of least hash, so many a language. docs: text, lang of training documents."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("lang"), F.xxhash64("text").alias("place"), "text")
    first = Window.partitionBy("lang").orderBy("place")
    # Places alone are ranked, each once however many copies its text has; Spark keeps so many a language of each task before it shuffles.
    least = labelled.select("lang", "place").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_label).select("lang", "place")
    rows = labelled.join(F.broadcast(least), ["lang", "place"]).groupBy("lang", "place").agg(F.first("text").alias("text")).orderBy("lang", "place").collect()
    model = fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None
    del rows
    give_back()
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(5)) == 0, F.lit(False))


def predict(docs: DataFrame, model: Model | None, keep: list[str], slice_bytes: int = SLICE) -> DataFrame:
    """The kept columns, lang_pred, score of every document; docs holds them and text."""
    columns = keep if "text" in keep else [*keep, "text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            # Texts of like length lie together: a slice takes as many steps as its longest has words.
            batch = batch.take(pc.array_sort_indices(pc.binary_length(batch.column(columns.index("text")))))
            for texts in slices(batch.column(columns.index("text")), slice_bytes):
                n = len(texts.offsets) - 1
                lang, score = np.full(n, -1), np.zeros(n)
                if model:
                    v = Vocabulary(texts)
                    emit = v.emissions(model.weights, v.lexicon(model.lexicon_keys, model.lexicon_of)).astype(float)
                    post = marginals(emit[v.token], v.first, model.transitions)
                    post[~v.letter[v.token]] = 0
                    sums = np.stack([np.diff(np.concatenate(([0.0], np.cumsum(post[:, j])))[v.first]) for j in range(len(model.labels))], 1)
                    count = np.diff(np.concatenate(([0], np.cumsum(v.letter[v.token])))[v.first])
                    lang = np.where(count > 0, sums.argmax(1), -1)
                    score = np.clip(np.where(count > 0, sums.max(1) / np.maximum(count, 1), 0), 0, 1)
                names = pa.array([*(model.labels if model else []), "und"])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(texts.row, n) for k in range(len(keep))], names.take(pa.array(np.where(lang < 0, len(names) - 1, lang))), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, schema)


def identify(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    docs = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    model = train(docs.filter("NOT held_out"), per_label)
    return predict(docs, model, ["doc_id", "held_out"])
