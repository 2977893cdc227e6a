"""Removal of repeated byte strings by a logarithmic family of suffix indexes.

Every string of LENGTH bytes has an anchor: the GRAM bytes in it whose hash is least (the first such). Equal strings have
equal anchors in the same place, so strings can only repeat where anchors do.

1. The anchors of every document, each with the strings that it stands for (about one anchor for 75 bytes).
2. Spark counts anchors; those that occur once are done. For the others, the bytes around them (their strings lie in these)
   are read from the documents.
3. Equal surroundings are first counted together by Spark's partial aggregation, so what thousands of copies share travels
   once a task. The rest meets by anchor; the surroundings of an anchor that has more than HOT of them are cut at the longer
   anchors of LONG bytes in them and meet by both. A task adds them to a family batch by batch: a batch gets its suffix array
   (the order of its strings by anchor, place and bytes), is merged with each level that exists to scan for strings that lie
   side by side and are equal byte for byte, and what no level holds becomes a level itself; levels of like size merge.
   A family can be saved, and later batches scanned against what was stored.
4. Marked strings go back to their documents, where what they cover is removed.

Defined results: null and empty texts have no bytes and lose none; texts under LENGTH bytes lose none; equal rows count as
occurrences of each other; overlapping occurrences in one document count; documents of any length are cut into pieces that
overlap, so none is skipped; rows with one doc_id but other texts are told apart by the text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, lean, written
from .huffman import binary
from .textbytes import Texts, gather, flat, mix, powers, prefix_hashes, ranges, slices, span_hashes

LENGTH = 200
GRAM = 50
#: Surroundings above which an anchor is split, and the bytes of the anchors that split it.
HOT, LONG = 5_000, 150
#: Suffixes that one task of the index holds, about; a batch has SLICE bytes of surroundings.
TASK = 4_000_000
#: Strings whose bytes are sorted at once.
BLOCK = 1 << 15

#: Bytes of a batch of documents or surroundings.
SLICE = 2 << 20

U = np.uint64
_PLACE = 24  # bits for a place in a slice


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width keys in a row."""
    n = len(keys) - width + 1
    whole = -(-len(keys) // width) * width
    x = np.full(whole, np.iinfo(np.uint64).max, U)
    x[: len(keys)] = keys
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).reshape(-1)
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For documents one after the other: document, anchor's place, first and last start of its strings (all in the document), anchor's hash."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.int64),)
    if len(data) < length:
        return none
    starts = ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
    if not len(starts):
        return none
    prefix = prefix_hashes(data)
    _, down = powers(len(prefix))
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram])
    keys = hashes >> U(_PLACE) << U(_PLACE) | np.arange(len(hashes), dtype=U)
    place = (window_least(keys, length - gram + 1)[starts] & U((1 << _PLACE) - 1)).astype(np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(first[1:], len(starts)) - 1
    doc, place = doc[first], place[first]
    return doc, place - offsets[doc], starts[first] - offsets[doc], starts[last] - offsets[doc], hashes[place].view(np.int64)


def text_anchors(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors() of a slice; a document longer than slices are is cut into pieces that share length - 1 bytes."""
    if len(texts.data) <= 2 * SLICE:
        return anchors(texts.data, texts.offsets, length, gram)
    parts = []
    for at in range(0, len(texts.data) - length + 1, SLICE):
        piece = texts.data[at : at + SLICE + length - 1]
        doc, place, first, last, h = anchors(piece, np.array([0, len(piece)]), length, gram)
        parts.append((doc, place + at, first + at, last + at, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def arranged(tags: np.ndarray, starts: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by tag and by their first length bytes, and which of them equals the one before it in that order."""
    n = len(tags)
    order, same = np.argsort(tags, kind="stable"), np.zeros(n, bool)
    ranked = tags[order]
    begins = np.concatenate(([True], ranked[1:] != ranked[:-1])) if n else np.zeros(0, bool)
    alone = begins & np.concatenate((begins[1:], [True])) if n else begins
    tied = np.flatnonzero(~alone)
    if not len(tied):
        return order, same
    run = np.cumsum(begins)[tied]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    at = 0
    while at < len(tied):
        stop = min(at + BLOCK, len(tied))
        # Whole runs; one that is longer than a block is sorted alone.
        if stop < len(tied) and run[stop] == run[stop - 1]:
            stop = int(np.searchsorted(run, run[stop], "left"))
            if stop <= at:
                stop = int(np.searchsorted(run, run[at], "right"))
        here = tied[at:stop]
        which, own = order[here], run[at:stop]
        rows = windows[starts[which]]
        by = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
        by = by[np.argsort(own[by], kind="stable")]
        order[here], rows = which[by], rows[by]
        same[here[1:]] = (own[1:] == own[:-1]) & (rows[1:] == rows[:-1]).all(1)
        at = stop
    return order, same


class Family:
    """Levels of suffix arrays over distinct strings; a batch marks what it shares with itself and with them, then joins them.

    A suffix has a tag (strings can only be equal if their tags are) and a start in the bytes of all batches."""

    def __init__(self, length: int) -> None:
        self.length, self.count, self.size = length, 0, 0
        self.levels: list[np.ndarray] = []
        self.data, self.tags, self.starts, self.marked = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, U), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(new) > len(held):
            held = np.concatenate([held, np.zeros(max(len(new), len(held)), held.dtype)])
            setattr(self, name, held)
        held[at : at + len(new)] = new

    def _arranged(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, same = arranged(self.tags[suffixes], self.starts[suffixes], self.data[: self.size], self.length)
        return suffixes[order], same

    def add(self, data: np.ndarray, starts: np.ndarray, tags: np.ndarray) -> None:
        """A batch: its bytes, where strings start in them, and the strings' tags."""
        new = np.arange(self.count, self.count + len(starts))
        self._put("data", self.size, data)
        self._put("starts", self.count, starts + self.size)
        self._put("tags", self.count, tags)
        self._put("marked", self.count, np.zeros(len(starts), bool))
        self.count, self.size = self.count + len(starts), self.size + len(data)
        array, same = self._arranged(new)
        self._mark(array, same)
        # A run's first suffix stands for it; whether it is marked is read again at the end of the scan.
        heads, run = array[~same], np.cumsum(~same) - 1
        met = np.zeros(self.count, bool)
        for level in self.levels:
            both, same = self._arranged(np.concatenate([level, heads[~met[heads]]]))
            # Strings of a level are distinct, and so are heads: equal ones are one of each.
            self._mark(both, same)
            met[both[same]] = True
            met[both[:-1][same[1:]]] = True
        self.marked[array] |= met[heads[run]] if len(array) else False
        fresh = heads[~met[heads]]
        if len(fresh):
            self.levels.append(fresh)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(self._arranged(np.concatenate([large, small]))[0])

    def _mark(self, array: np.ndarray, same: np.ndarray) -> None:
        self.marked[array[same]] = True
        self.marked[array[:-1][same[1:]]] = True

    def save(self, file) -> None:
        held = {"data": self.data[: self.size], "tags": self.tags[: self.count], "starts": self.starts[: self.count], "marked": self.marked[: self.count], "length": np.array(self.length)}
        np.savez(file, **held, **{f"level{k}": level for k, level in enumerate(self.levels)})

    @staticmethod
    def load(file) -> Family:
        with np.load(file) as held:
            out = Family(int(held["length"]))
            out.data, out.tags, out.starts, out.marked = (held[k].copy() for k in ("data", "tags", "starts", "marked"))
            out.size, out.count = len(out.data), len(out.tags)
            out.levels = [held[f"level{k}"] for k in range(sum(x.startswith("level") for x in held.files))]
        return out


def runs_of(marked: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of each run of marks within rows that lie between offsets."""
    n = len(marked)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = marked & (edge[:-1] | ~np.concatenate(([False], marked[:-1])))
    ends = marked & (edge[1:] | ~np.concatenate((marked[1:], [False])))
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], last - offsets[row]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, version, spans (array of start and stop bytes, which may overlap) of each document that holds repeated strings."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").filter("octet_length(text) >= %d" % length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                doc, place, first, last, h = text_anchors(texts, length, gram)
                rows = pa.array(doc + texts.row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(x.astype(np.int32)) for x in (place, first, last)], pa.array(h)], ["doc_id", "version", "place", "first", "last", "h"])

    found = written(docs.mapInArrow(find, "doc_id long, version long, place int, first int, last int, h long"), "anchors")
    # A table of its own, so that Spark can split the anchor that a common passage repeats.
    often = written(found.groupBy("h").count().filter("count > 1").select("h"), "often")
    wanted = found.join(often, "h", "left_semi").groupBy("doc_id", "version").agg(F.collect_set(F.struct("h", "place", "first", "last")).alias("spots"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(3)
            at = spots.offsets.to_numpy()
            h, place, first, last = (spots.values.field(k).to_numpy() for k in range(4))
            for texts in slices(batch.column(2)):
                n = len(texts.offsets) - 1
                low, high = at[texts.row], at[texts.row + n]
                if low == high:
                    continue
                doc = np.repeat(np.arange(n), np.diff(at[texts.row : texts.row + n + 1]))
                start = texts.offsets[doc] + first[low:high]
                stop = texts.offsets[doc] + last[low:high] + length
                own = span_hashes(prefix_hashes(texts.data), start, stop).view(np.int64)
                rows = pa.array(doc + texts.row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first[low:high]), pa.array((place - first)[low:high]), pa.array(h[low:high]), pa.array(own), binary(*gather(texts.data, start, stop))], ["doc_id", "version", "first", "shift", "h", "own", "bytes"])

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])
    spots = docs.join(wanted, same(docs, wanted)).select(docs["doc_id"], docs["version"], "text", "spots")
    around = written(spots.mapInArrow(surroundings, "doc_id long, version long, first int, shift int, h long, own long, bytes binary"), "around")
    forget(found, often)

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(3))
            row, _, first, last, key = anchors(data, offsets, length, min(LONG, length))
            start, stop = offsets[row] + first, offsets[row] + last + length
            rows = pa.array(row)
            meet = mix(batch.column(0).to_numpy()[row].view(U) ^ key.view(U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(meet), *[batch.column(k).take(rows) for k in range(3)], pa.array(first.astype(np.int32)), binary(*gather(data, start, stop)), batch.column(4).take(rows)], ["meet", "h", "shift", "own", "skip", "bytes", "n"])

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, sizes, many = Family(length), [], [], []
        for batch in batches:
            data, offsets = flat(batch.column(5))
            # Equal strings have the same anchors in the same places.
            meet, shift = batch.column(0).to_numpy().view(U), batch.column(2).to_numpy() - batch.column(4).to_numpy()
            row = 0
            while row < len(meet):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
                count = np.diff(offsets[row : end + 1]) - length + 1
                start = ranges(offsets[row:end] - offsets[row], count)
                place = np.repeat(shift[row:end], count) - (start - np.repeat(offsets[row:end] - offsets[row], count))
                family.add(data[offsets[row] : offsets[end]], start, mix(np.repeat(meet[row:end], count) ^ mix(place.astype(U))))
                sizes.append(count)
                row = end
            rows.append(pa.RecordBatch.from_arrays([batch.column(k) for k in range(1, 5)], ["h", "shift", "own", "skip"]))
            many.append(batch.column(6).to_numpy() > 1)
        if not rows:
            return
        sizes = np.concatenate(sizes)
        marked = family.marked[: family.count] | np.repeat(np.concatenate(many), sizes)
        row, first, last = runs_of(marked, np.concatenate(([0], np.cumsum(sizes))))
        rows = pa.Table.from_batches(rows).combine_chunks().take(pa.array(row))
        skip = rows["skip"].to_numpy()
        rows = rows.drop_columns("skip")
        for name, x in (("from", first), ("to", last)):
            rows = rows.append_column(name, pa.array((x + skip).astype(np.int32)))
        yield from rows.to_batches(max_chunksize=10_000)

    different = written(around.groupBy("h", "shift", "own", "bytes").agg(F.count(F.lit(1)).alias("n")).select("h", "shift", "own", "bytes", "n"), "different")
    hot = written(different.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("h"), "hot")
    whole = different.join(hot, "h", "left_anti").select(F.col("h").alias("meet"), "h", "shift", "own", F.lit(0).alias("skip"), "bytes", "n")
    cut = different.join(hot, "h", "left_semi").select("h", "shift", "own", "bytes", "n").mapInArrow(split, "meet long, h long, shift int, own long, skip int, bytes binary, n long")
    suffixes = different.agg(F.sum(F.octet_length("bytes") - length + 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // TASK))
    marks = written(whole.unionAll(cut).repartition(tasks, "meet").mapInArrow(index, "h long, shift int, own long, `from` int, `to` int"), "marks")
    forget(different, hot)
    where = around.select("doc_id", "version", "first", "shift", "h", "own").join(marks, ["h", "shift", "own"])
    span = F.struct((F.col("first") + F.col("from")).alias("start"), (F.col("first") + F.col("to") + length).alias("stop"))
    out = written(where.groupBy("doc_id", "version").agg(F.collect_set(span).alias("spans")), "spans")
    forget(around, marks)
    return out


def covered(offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which bytes some span covers; spans lie in documents."""
    depth = np.zeros(offsets[-1] + 1, np.int32)
    np.add.at(depth, offsets[doc] + start, 1)
    np.add.at(depth, offsets[doc] + stop, -1)
    return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with_text: also kept, the bytes that remain."""
    found = repeats(docs, length)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).fill_null([])
            at = spans.offsets.to_numpy()
            start, stop = (spans.values.field(k).to_numpy() for k in range(2))
            for texts in slices(batch.column(1)):
                n = len(texts.offsets) - 1
                low, high = at[texts.row], at[texts.row + n]
                doc = np.repeat(np.arange(n), np.diff(at[texts.row : texts.row + n + 1]))
                gone = covered(texts.offsets, doc, start[low:high], stop[low:high])
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[texts.offsets])
                row, _, _ = runs_of(gone, texts.offsets[:-1][np.diff(texts.offsets) > 0])
                filled = np.flatnonzero(np.diff(texts.offsets) > 0)
                spans_of = np.bincount(filled[row], minlength=n) if len(row) else np.zeros(n, np.int64)
                kept = texts.data[~gone]
                size = np.diff(texts.offsets)
                cuts = np.concatenate(([0], np.cumsum(size - removed)))
                raw = memoryview(kept)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.row, n), pa.array(size), pa.array(removed), pa.array(spans_of), pa.array(sha, pa.string()), *[binary(kept, cuts)] * with_text], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (docs["version"] == found["version"])
    return docs.join(found, same, "left").select(docs["doc_id"], "text", "spans").mapInArrow(cut, schema)
