"""Token ids of documents as canonical, length-limited Huffman codes in independent blocks.

1. Texts are tokenised once. Words are cut where the tokenizer cuts anyway (white space, and between letters and ASCII
   punctuation), each distinct piece is given to the library once a worker, and documents are put together from these;
   the ids are those of the whole text. Documents that may hold special tokens go to the library whole.
2. Ids are counted over all documents; package-merge gives code lengths of at most LIMIT bits.
3. Documents in ascending doc_id order are cut into blocks of whole documents. A block holds its documents' ids and
   lengths, a bit offset for every STRIDE-th token, and the codes. Blocks lie in a Parquet table in the shared folder,
   one row a block, written by Spark's committer, so a lost executor leaves no half-written file.
4. The reader decodes all stretches of a block side by side by table look-up.

Defined results: null text is empty (the end id alone); equal doc_ids follow each other by their ids; a null doc_id
comes first; very long documents are blocks of their own; no documents give no blocks; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import forget, new_path, written
from .textbytes import Texts, Words, distinct, flat, gather, ranges, slices, strings, words

#: Longest code in bits; the decoding table has 2**LIMIT entries.
LIMIT = 20
STRIDE = 64
#: Tokens of a block, unless one document has more.
BLOCK = 1 << 16
#: Tokens of a part of the file.
PART = 1 << 24
#: Distinct pieces that a worker keeps.
KEPT = 2_000_000
MAGIC = b"TWH1"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[33:48] = _POINT[58:65] = _POINT[91:97] = _POINT[123:127] = True
_POINT[39] = False  # an apostrophe may belong to the letters after it


#: Characters for bytes in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = np.arange(256, dtype="<u4")
_ALPHABET[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
_ALPHABET[32] = 32


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to an ASCII letter or one of U+00C0 to U+00FF."""
    out = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def pieces(texts: Texts) -> Words:
    """The words of texts, cut between letters and ASCII punctuation."""
    w = words(texts)
    data = w.data
    if not len(w.start):
        return w
    letter, point = letters(data), _POINT[data]
    cut = np.flatnonzero(letter[:-1] & point[1:] | point[:-1] & letter[1:]) + 1
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[w.start] = begins[cut] = ends[w.stop] = ends[cut] = True
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(data, start, stop, np.searchsorted(start, texts.offsets))


#: Texts by which a tokenizer's handling of case, accents, digits, marks and white space is told.
PROBES = ["The CAT", "ÀÉÎÕÜ ÿ straße Ñandú", "it's 12,345.67 (ok)--really?", " a\t\nb\r\n\x0b c  ", "naïve-café_x", "don't U.S.A. e.g.,", "東京 и мир", "", "\u00a0x\u2009y", "a\u0301 e\u0308"]


class PieceEncoder:
    """A tokenizer with the ids of pieces met so far: sorted hashes, and where their ids are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        #: Whether white space only separates, so that a text's ids are those of its words; else texts are encoded whole.
        self.by_word = getattr(self.model, "end_of_word_suffix", None) == "</w>"
        self.reset()
        if self.by_word:
            # A tokenizer that treats case, marks or white space otherwise than the short way does is used the long way.
            data, offsets = flat(pa.array(PROBES))
            ids, at = self.encode_texts(Texts(0, data, offsets), 0)
            self.by_word = all(np.array_equal(ids[a : b - 1], self.encode(x)) for a, b, x in zip(at[:-1], at[1:], PROBES, strict=True))
            self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after the other, and how many each has."""
        n, length = len(offsets) - 1, np.diff(offsets)
        odd = np.add.reduceat(~letters(data), offsets[:-1]) > 0
        count, parts = np.zeros(n, np.int64), []
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        # Letters alone are one word of the model, whose alphabet stands for the lower-cased text's bytes.
        if len(plain):
            bytes_, at = gather(data, offsets[plain], offsets[plain + 1])
            high = np.flatnonzero(bytes_[:-1] == 0xC3) + 1
            bytes_[high[bytes_[high] < 0x9F]] += 0x20
            spaced = np.full(len(bytes_) + len(plain), 32, np.uint8)
            spaced[np.arange(len(bytes_)) + np.repeat(np.arange(len(plain)), length[plain])] = bytes_
            tokenize = self.model.tokenize
            found = [[t.id for t in tokenize(x)] for x in _ALPHABET[spaced].tobytes().decode("utf-32-le").split(" ")[:-1]]
            count[plain] = [len(x) for x in found]
            parts.append(np.array([i for x in found for i in x], np.uint32))
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(strings(*gather(data, offsets[other], offsets[other + 1])), add_special_tokens=False)]
        count[other] = [len(x) for x in found]
        ids = np.concatenate([*parts, *found, np.zeros(0, np.uint32)])
        order = np.concatenate([plain, other])
        first = np.zeros(n, np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return ids[ranges(first, count)], count

    def encode_texts(self, texts: Texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, each with the end id, and their offsets."""
        if not self.by_word:
            parts = [np.append(self.encode(x), np.uint32(end)) for x in strings(texts.data, texts.offsets)]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        p = pieces(texts)
        keys, one, inverse = distinct(p.hashes())
        if len(self.keys) + len(keys) > KEPT:
            self.reset()
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            ids, count = self.encode_pieces(*gather(p.data, p.start[one[new]], p.stop[one[new]]))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(self.ids) + len(ids), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.at = np.insert(self.at, place[new], self.used + np.cumsum(count) - count)
            self.length = np.insert(self.length, place[new], count)
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.used += len(ids)
            place = np.searchsorted(self.keys, keys)
        n = len(texts.offsets) - 1
        at, length = self.at[place][inverse], self.length[place][inverse]
        # The end id of each document as one more piece after its pieces.
        if self.used == len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(1 << 16, np.uint32)])
        self.ids[self.used] = end
        at = np.insert(at, p.first[1:], self.used)
        length = np.insert(length, p.first[1:], 1)
        offsets = np.concatenate(([0], np.cumsum(length)))[np.concatenate((p.first[:1], p.first[1:] + np.arange(1, n + 1)))]
        out = self.ids[ranges(at, length)]
        special = np.flatnonzero((texts.data[:-1] == 60) & (texts.data[1:] == 124))
        if len(special):
            rows = np.unique(np.searchsorted(texts.offsets, special, "right") - 1)
            parts = np.split(out, offsets[1:-1])
            for r in rows:
                parts[r] = np.append(self.encode(texts.data[texts.offsets[r] : texts.offsets[r + 1]].tobytes().decode()), np.uint32(end))
            out, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return out, offsets


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n, ids (little-endian, 16 bits if the vocabulary allows) of each document; and one row a task, without n, of the counts of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        width = np.dtype("<u2" if tokenizer.size <= 1 << 16 else "<u4")
        counts = np.zeros(max(tokenizer.size, end + 1), np.int64)
        for batch in batches:
            for texts in slices(batch.column(1)):
                ids, offsets = tokenizer.encode_texts(texts, end)
                counts += np.bincount(ids, minlength=len(counts))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.row, n), pa.array(np.diff(offsets)), binary(ids.astype(width).view(np.uint8), offsets * width.itemsize)], ["doc_id", "n", "ids"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def global_counts(table: DataFrame) -> np.ndarray:
    """How often each id occurs, summed by Spark; what reaches the driver is bounded by the vocabulary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                c = np.frombuffer(x.as_py(), np.int64)
                total = c if total is None else total + c
        if total is not None:
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    found = table.filter("n IS NULL").select("ids").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r[0] for r in found), default=0), np.int64)
    for r in found:
        out[r[0]] = r[1]
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code of at most limit bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of over {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used]
    is_leaf, list_ = [np.ones(len(coins), bool)], coins
    for _ in range(limit - 1):
        pairs = list_[: len(list_) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        order = np.argsort(both, kind="stable")
        list_ = both[order]
        is_leaf.append(order < len(coins))
    n, found = 2 * len(coins) - 2, np.zeros(len(coins), np.int64)
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:n].sum())
        found[:leaves] += 1
        n = 2 * (n - leaves)
    lengths[used] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for length in np.unique(lengths[used]):
        code <<= int(length) - last
        ids = used[lengths[used] == length]
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + len(ids), int(length)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each run of limit bits: id << 5 | length of the code that it begins with."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    out = np.repeat((used << 5 | lengths[used]).astype(np.int64), 1 << (limit - lengths[used]))
    return np.concatenate([out, np.zeros((1 << limit) - len(out), np.int64)])


def pack_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bits = lengths[ids]
    stop = np.cumsum(bits)
    start = stop - bits
    word, shift = start >> 5, (64 - (start & 31) - bits).astype(np.uint64)
    value = codes[ids] << shift
    first = np.flatnonzero(np.diff(word, prepend=-1))
    at = word[first]
    out = np.zeros(int(stop[-1] >> 5) + 2, np.uint32)
    out[at] |= np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    out[at + 1] |= np.add.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    head = MAGIC + struct.pack("<III", len(doc_ids), len(ids), STRIDE)
    return head + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + start[::STRIDE].astype("<u8").tobytes() + out.astype(">u4").tobytes()


def unpack_block(block: bytes, table: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' ids and sizes, and the ids of all tokens."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n, stride = struct.unpack_from("<III", block, 4)
    at = 16
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    at += 8 * n_docs
    sizes = np.frombuffer(block, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    lanes = -(-n // stride)
    place = np.frombuffer(block, "<u8", lanes, at).astype(np.int64)
    at += 8 * lanes
    b = np.frombuffer(block, np.uint8, offset=at).astype(np.uint32)
    window = np.zeros(len(b), np.uint32)
    window[:-3] = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    out = np.empty((stride, lanes), np.uint32)
    last = n - (lanes - 1) * stride
    for k in range(stride):
        if k == last:  # the last stretch is over
            place = place[:-1]
        found = table[(window[place >> 3] << (place & 7).astype(np.uint32)) >> np.uint32(32 - limit)]
        out[k, : len(place)] = found >> 5
        place = place + (found & 31)
    return doc_ids, sizes, out.T.reshape(-1)[:n]


#: Stands for a null doc_id in a block.
NO_ID = -(1 << 63)


def write_blocks(table: DataFrame, lengths: np.ndarray, path: str) -> None:
    """The documents of tokens() in ascending order as blocks (part, block, start within the part, n tokens, body)."""
    spark = table.sparkSession
    rows = table.filter("n IS NOT NULL")
    total, widest = rows.agg(F.sum("n"), F.max(F.length("ids") / F.col("n"))).first()
    width = np.dtype("<u2" if (widest or 2) <= 2 else "<u4")
    sent = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, bits = sent.value
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, count
            doc_ids, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            body = pack_block(doc_ids, sizes, ids.astype(np.int64), codes, bits)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([count], pa.int64()), pa.array([body], pa.binary())], ["part", "block", "start", "n", "body"])
            block, start, held, count = block + 1, start + count, [], 0
            return out

        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column(2))
            ids, offsets = data.view(width) if not data.ctypes.data % 4 else data.copy().view(width), offsets // width.itemsize
            row = 0
            while row < len(sizes):
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK - count, "right")) - 1)
                if count and offsets[stop] - offsets[row] + count > BLOCK:
                    yield flush()
                    continue
                held.append((doc_ids[row:stop], sizes[row:stop], ids[offsets[row] : offsets[stop]].copy()))
                count += int(offsets[stop] - offsets[row])
                row = stop
                if count >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    parts = max(1, math.ceil((total or 0) / PART))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "ids").mapInArrow(run, "part int, block int, start long, n long, body binary").write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str, lengths: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the blocks."""
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(sent.value)
        for batch in batches:
            for part, start, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, sizes, ids = unpack_block(body.as_buffer().to_pybytes(), table)
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + offsets[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "doc_id", "place", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    found = blocks.select("part", "start", "body").mapInArrow(run, "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    # One row a block here and one a part (PART tokens) in the window.
    parts = blocks.select("part", "start", "n").groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(parts, "part").select("doc_id", (F.col("before") + F.col("place")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, end: int = 2, path: str | None = None) -> tuple[str, np.ndarray]:
    """Writes the documents' ids to path (a new one in the shared folder if none is given); returns it and the code lengths."""
    spark = docs.sparkSession
    table = written(tokens(docs, tokenizer, end), "ids", "lz4")
    lengths = code_lengths(global_counts(table))
    path = path or new_path(spark, "huffman")
    write_blocks(table, lengths, path)
    forget(table)
    return path, lengths
