"""Benchmark decontamination by pigeonhole edit matching.

A text that holds a test item with at most k edits holds at least one of the item's k + 1 pieces unchanged. All pieces
go into one Aho-Corasick automaton; each document is read through it once, and around every piece found the item is
compared with Myers' bit-parallel distance, whose result is exact.

Both sides are lower-cased (A-Z) and every run of white space counts as one space. k is a twentieth of an item's
characters, rounded down.

Items under MIN_ITEM characters are found unchanged and at word limits only: a limit is an end of the text or lies between two
characters that are not both letters or digits.

Defined results: null or empty documents hold nothing; null and empty items are in no document; equal items are each reported; equal documents each get their rows; of several places
that hold one item in a document the one with the least distance is reported, the first on ties; no documents or no
items give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Errors allowed for each character of an item.
RATE = 0.05
#: Shorter items allow no error, and an item of a word or two is not one inside other words.
MIN_ITEM = 20
#: Characters of items in one automaton; more are searched in further passes over the documents, so that what is
#: broadcast has this bound.
BLOCK_CHARS = 4_000_000

FOUND = "doc_id long, item_id long, distance int, start long, stop long"

_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def normal(text: str) -> str:
    return " ".join(text.translate(_lower).split())


def at_limits(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] begins and ends at word limits."""
    return not any(0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum() for i in (start, stop))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces that cover the item, with their offsets; lengths differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(item: str, at: dict[str, int], text: str, k: int) -> tuple[int, int] | None:
    """The least edit distance of item to any part of text and the first end of such a part; None if over k."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (k + 1, 0)
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= k else None


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.where = [], {}
        for item_id, text in items:
            item = normal(text)
            if item:
                k = int(len(item) * rate) if len(item) >= MIN_ITEM else 0
                n = len(self.items)
                self.items.append((item_id, item, masks(item), masks(item[::-1]), k))
                for offset, piece in pieces(item, k):
                    self.where.setdefault(piece, []).append((n, offset))
        self.tree = ahocorasick.Automaton()
        for piece, uses in self.where.items():
            self.tree.add_word(piece, (len(piece), uses))
        if self.where:
            self.tree.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of each item that the normal form of text holds."""
        if not self.where or not text:
            return []
        text = normal(text)
        # Starts of the item that a hit suggests: starts within 2k of each other share one window.
        near: dict[int, list[int]] = {}
        for end, (length, uses) in self.tree.iter(text):
            for n, offset in uses:
                near.setdefault(n, []).append(end + 1 - length - offset)
        out = []
        for n, starts in near.items():
            item_id, item, at, back, k = self.items[n]
            best, done = None, None
            for s in sorted(set(starts)):
                if done is not None and s <= done:
                    continue
                done = s + k
                low, high = max(0, s - k), max(0, s + len(item) + 2 * k)
                if len(item) < MIN_ITEM:
                    if not at_limits(text, s, s + len(item)):
                        continue
                    best = (0, s, s + len(item))
                    break
                if text.startswith(item, max(s, 0)):
                    hit = (0, max(s, 0), max(s, 0) + len(item))
                elif found := myers(item, at, text[low:high], k):
                    stop = low + found[1]
                    rev = text[max(0, stop - len(item) - k) : stop][::-1]
                    hit = (found[0], stop - first_length(item[::-1], back, rev, found[0]), stop)
                else:
                    continue
                if best is None or hit[:2] < best[:2]:
                    best = hit
            if best:
                out.append((item_id, *best))
        return out


_kept: dict[tuple, Matcher] = {}


def matcher_of(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    """The matcher of a block of items; a worker keeps its last one for its next tasks."""
    if (name, rate) not in _kept:
        _kept.clear()
        _kept[name, rate] = Matcher(items, rate)
    return _kept[name, rate]


def first_length(item: str, at: dict[str, int], text: str, distance: int) -> int:
    """The shortest beginning of text at that distance from all of item (there is one)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full  # distance to beginnings: the text's start counts
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score == distance:
            return j + 1
    return len(text)


def blocks_of(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most so many characters (one longer item is a block of its own)."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if block and size + len(row[1]) > chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start and stop (characters of the normal form) of every item that a document holds."""
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL"), None
    for block in blocks_of(benchmark, block_chars):

        def scan(batches: Iterator[pd.DataFrame], sent=docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))) -> Iterator[pd.DataFrame]:
            matcher = matcher_of(*sent.value, rate)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for hit in matcher.find(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "stop"])

        part = texts.mapInPandas(scan, FOUND)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out
