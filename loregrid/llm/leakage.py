"""Evaluation texts leaking into training text.

The corpus is read once, in shards: the documents of a partition, up to SHARD_WORDS words at a time. Each shard gets
a suffix array over its words, and every suffix of every test passage is looked up in it by binary search. What is
found is carried on word by word to the longest verbatim matches with their places. Matches are then joined along the
document, and an exact check decides which documents hold enough of a passage. Nothing of the corpus is shuffled or
sent anywhere; the test passages travel to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.session import written

#: Words of one shard; bounds the memory of a task (a word takes about 60 bytes while a shard is worked on).
SHARD_WORDS = 1_500_000
#: Characters of test passages that travel to the tasks at once; larger test sets take several passes.
BLOCK_CHARS = 16_000_000
#: The share of a passage's words a document must hold, the share of a stretch that may be replaced or missing.
HELD, SLACK = 1 / 3, 1 / 6
#: Words of the shortest verbatim match looked for: with one word in six replaced, every stretch of eight words holds four in a row.
SEED = 4
#: Fewer words in common than LEAST are chance, if a passage has more. A second stretch counts from SECOND words, or from half of what must be held.
LEAST, SECOND = 5, 10
#: The share of what must be held that verbatim matches near two diagonals cover, and near each of them.
COVERED, EACH = 0.75, 0.3

_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def plain_words(text: str) -> list[str]:
    """Words without case, punctuation, spacing, escapes and markup."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\[nrt]", " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = re.sub(r"</?[a-zA-Z][^<>]{0,200}>", " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    return _WORD.findall(text.lower())


def without_stock_line(items: DataFrame) -> DataFrame:
    """(item_id, passage): a first line that opens several passages is no part of them. Null and blank passages go."""
    cut = items.select("item_id", "passage", F.when(F.col("passage").contains("\n"), F.trim(F.substring_index("passage", "\n", 1))).alias("line"))
    stock = cut.filter("line IS NOT NULL").groupBy("line").agg(F.countDistinct("item_id").alias("n")).filter("n > 1").select("line", F.lit(True).alias("stock"))
    rest = F.expr("substring(passage, instr(passage, '\n') + 1)")
    out = cut.join(stock, "line", "left").select("item_id", F.when(F.col("stock"), rest).otherwise(F.col("passage")).alias("passage"))
    return out.filter("passage IS NOT NULL AND trim(passage) <> ''")


class TestSuffixes:
    """All suffixes of the test passages, ranked by their first SEED words.

    Ranks come by doubling: words, then pairs of words, then pairs of pairs, each numbered in sorted order, so that
    the number of different words plays no part. A passage of fewer words is one suffix, ranked as a whole.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.texts: list[list[int]] = []
        for item, passage in items:
            words = plain_words(passage)
            if words:
                self.ids.append(item)
                self.texts.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        stream = np.array([w for t in self.texts for w in (*t, 0)], np.int64)
        item = np.repeat(np.arange(len(self.texts)), self.lengths + 1)
        at = np.arange(len(stream)) - np.repeat(np.cumsum(self.lengths + 1) - self.lengths - 1, self.lengths + 1)
        self.pairs: dict[int, np.ndarray] = {}
        self.suffixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        ranks = self.ranks(stream)
        for k, rank in ranks.items():
            own = np.flatnonzero(rank > 0)
            own = own if k == SEED else own[(at[own] == 0) & (self.lengths[item[own]] == k)]
            self.suffixes[k] = rank[own], item[own], at[own]

    def ranks(self, stream: np.ndarray) -> dict[int, np.ndarray]:
        """By number of words the rank of what begins at each place of a stream, 0 where no passage has it."""
        out = {1: stream}
        for k, (x, y) in {2: (1, 1), 3: (2, 1), 4: (2, 2)}.items():
            rank = np.zeros(len(stream), np.int64)
            n = max(0, len(stream) - x)
            at = np.flatnonzero((out[x][:n] > 0) & (out[y][x : x + n] > 0))
            key = (out[x][at] << 32) | out[y][at + x]
            if k not in self.pairs:
                self.pairs[k] = np.unique(key)
            known = self.pairs[k]
            if len(known):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                rank[at] = np.where(known[place] == key, place + 1, 0)
            out[k] = rank
        return out

    def needed(self) -> np.ndarray:
        """Words of each passage that a document must hold."""
        return np.maximum(np.ceil(self.lengths * HELD - 0.5), np.minimum(self.lengths, LEAST))


def _matches(test: TestSuffixes, stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, document, place in the item, place in the stream, words) of every verbatim match that can't be longer."""
    found = []
    for k, rank in test.ranks(stream).items():
        keys, of, start = test.suffixes[k]
        if not len(keys):
            continue
        # the suffix array: places whose first words some passage has, in sorted order; others match nothing
        places = np.flatnonzero(rank > 0)
        suffixes = places[np.argsort(rank[places], kind="stable")]
        ranked = rank[suffixes]
        low = np.searchsorted(ranked, keys, "left")
        count = np.searchsorted(ranked, keys, "right") - low
        hit = np.repeat(np.arange(len(keys)), count)
        offset = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        found.append((of[hit], start[hit], suffixes[np.repeat(low, count) + offset], np.full(len(hit), k)))
    if not found:
        return (np.empty(0, np.int64),) * 5
    item, at, place, k = (np.concatenate(x) for x in zip(*found))
    # matches one word on from each other are one longer match
    doc = np.searchsorted(bounds, place, "right") - 1
    order = np.lexsort((at, place - at, item))
    item, at, place, doc, k = item[order], at[order], place[order], doc[order], k[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    words = np.diff(np.r_[first, len(item)]) + k[first] - 1
    return item[first], doc[first], at[first], place[first], words


def _stretches(passage: list[int], window: list[int], begin: int) -> list[tuple[int, int, int, int]]:
    """(first, end, first place, end place) of the best stretches, at most two, of a passage in a window of a document."""
    blocks = [b for b in SequenceMatcher(None, passage, window, autojunk=False).get_matching_blocks() if b.size]
    out: list[tuple[int, int, int, int]] = []
    free = [(0, len(blocks))]
    while free and len(out) < 2:
        best = None
        for a, z in free:
            for i in range(a, z):
                if blocks[i].size < 2:
                    continue
                held = 0
                for j in range(i, z):
                    held += blocks[j].size
                    span = blocks[j].a + blocks[j].size - blocks[i].a
                    wide = blocks[j].b + blocks[j].size - blocks[i].b
                    if blocks[j].size > 1 and max(span, wide) - held <= span * SLACK + (0.5 if span >= 18 else 0) and (best is None or held > best[0]):
                        best = (held, i, j, a, z)
        if best is None:
            break
        _, i, j, a, z = best
        free.remove((a, z))
        free += [(a, i), (j + 1, z)]
        out.append((blocks[i].a, blocks[j].a + blocks[j].size, begin + blocks[i].b, begin + blocks[j].b + blocks[j].size))
    return out


def _held(found: list[tuple[int, int, int, int]], needed: float) -> int:
    """Words of the passage in one stretch, or two that follow each other in both texts."""
    best = max((s[1] - s[0] for s in found), default=0)
    long = [s for s in found if s[1] - s[0] >= min(SECOND, needed / 2)]
    for x in long:
        for y in long:
            if x[1] <= y[0] and x[3] <= y[2]:
                best = max(best, x[1] - x[0] + y[1] - y[0])
    return best


def _shard(test: TestSuffixes, docs: list[int], stream: np.ndarray, bounds: np.ndarray) -> list[tuple[int, ...]]:
    """(item_id, doc_id, words held, words of the passage, place of the longest match in the passage, in the document, its words)."""
    item, doc, at, place, words = _matches(test, stream, bounds)
    if not len(item):
        return []
    needed = test.needed()
    # Matches of one stretch lie near one diagonal, as far from it as words may be missing. Bands of twice that
    # breadth are taken twice, so that none is cut apart.
    drift = np.maximum(8, np.ceil(test.lengths * SLACK).astype(np.int64) * 2)[item]
    bands = []
    for shift in (0, 1):
        band = (place - at + shift * drift // 2) // drift
        order = np.lexsort((at, band, doc, item))
        i, d, b, p, w = item[order], doc[order], band[order], at[order], words[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (b[1:] != b[:-1])
        # words of the passage covered: those of each match that go beyond the one before
        gain = np.where(new, w, np.clip(p + w - np.r_[0, (p + w)[:-1]], 0, w))
        first = np.flatnonzero(new)
        covered = np.add.reduceat(gain, first)
        low, high = np.minimum.reduceat(place[order], first), np.maximum.reduceat(place[order] + w, first)
        bands.append((i[first], d[first], covered, low, high, np.full(len(first), shift)))
    i, d, covered, low, high, shift = (np.concatenate(x) for x in zip(*bands))
    # the two bands that cover most of a passage, beside what replaced words break up
    order = np.lexsort((-covered, shift, d, i))
    i, d, covered, low, high, shift = i[order], d[order], covered[order], low[order], high[order], shift[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (shift[1:] != shift[:-1])
    rank = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(new)
    both = np.add.reduceat(np.where(rank < 2, covered, 0), first)
    keep = (both >= COVERED * needed[i[first]])[np.cumsum(new) - 1] & (covered >= EACH * needed[i])
    near = sorted(zip(*(x[keep].tolist() for x in (i, d, low, high))))
    longest = {}
    order = np.lexsort((place, -words, doc, item))
    new = np.ones(len(order), bool)
    new[1:] = (item[order][1:] != item[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    for x in order[new].tolist():
        longest[int(item[x]), int(doc[x])] = int(at[x]), int(place[x] - bounds[doc[x]]), int(words[x])
    out = []
    k = 0
    while k < len(near):
        i, d = near[k][:2]
        size = int(test.lengths[i])
        found: list[tuple[int, int, int, int]] = []
        ranges: list[list[int]] = []
        while k < len(near) and near[k][:2] == (i, d):
            a, z = near[k][2] - size, near[k][3] + size
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = max(z, ranges[-1][1])
            else:
                ranges.append([a, z])
            k += 1
        for a, z in ranges:
            a, z = max(a, int(bounds[d])), min(z, int(bounds[d + 1]))
            found += _stretches(test.texts[i], stream[a:z].tolist(), a)
        held = _held(found, float(needed[i]))
        if held >= needed[i]:
            out.append((test.ids[i], docs[d], held, size, *longest[i, d]))
    return out


def _scan(test: TestSuffixes, id_column: str, text_column: str):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int32()) for c in ("held", "words", "at", "place", "longest")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        parts: list[np.ndarray] = []
        total = 0

        def done() -> pa.RecordBatch:
            bounds = np.r_[0, np.cumsum([len(x) for x in parts])]
            rows = _shard(test, docs, np.concatenate(parts), bounds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

        known = test.vocabulary
        for batch in batches:
            for doc, text in zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist()):
                if text and doc is not None:
                    words = plain_words(text)
                    # a zero after each document: no match runs from one into the next
                    parts.append(np.array([*map(known.get, words, [0] * len(words)), 0], np.int64))
                    docs.append(doc)
                    total += len(words)
                    if total >= SHARD_WORDS:
                        yield done()
                        docs, parts, total = [], [], 0
        if docs:
            yield done()

    return run


def leaked(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(item_id, doc_id, held, words, at, place, longest): documents that hold at least a third of a passage, in one or two stretches.

    held of the words of the passage; the longest verbatim match has `longest` words, from word `at` of the passage and
    word `place` of the document. Null and empty texts hold nothing; a document listed twice comes out twice. Of a
    passage of under three times LEAST words, LEAST must be held, or all if it has fewer.
    """
    corpus = documents.select(id_column, text_column)
    passages = without_stock_line(items)
    blocks = passages.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first()["n"] // BLOCK_CHARS + 1
    parts = []
    for b in range(blocks):
        # BLOCK_CHARS characters on the driver at once, about; what a block finds is written before the next one comes
        block = passages.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        test = TestSuffixes([(r.item_id, r.passage) for r in block.toLocalIterator()])
        found = corpus.mapInArrow(_scan(test, id_column, text_column), "item_id bigint, doc_id bigint, held int, words int, at int, place int, longest int")
        parts.append(written(found, "leaks") if blocks > 1 else found)
    return reduce(DataFrame.unionByName, parts)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no passage."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
