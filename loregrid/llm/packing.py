"""Filling fixed-capacity containers with items.

Sizes are tokens of a public tokenizer, counted once. A text longer than a container is cut into full containers and
a rest; only rests and whole texts are packed. They are spread over blocks of about BLOCK_ITEMS by a hash, so that
every block has the same mix of sizes. Each block starts from a fit in the order the items come, and a local search
moves items, and exchanges one for one, one for two and two for one, between bins that are not full, always increasing
the sum of squared fills, until bins fall empty and nothing improves. Only where that ends above the least number of
bins that could do, the search is run once more from a fit by falling size, and the better end is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.session import written

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEPS = ("move", "exchange", "two for one", "one for two")
#: Items of one block, on average; bounds the memory and time of a task.
BLOCK_ITEMS = 8_000


@lru_cache(maxsize=2)
def _encoding(name: str):
    import base64

    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, salt, tokens) of every row; a null text has none. `salt` spreads the rows, whatever their ids.

    The rank file `name` of the driver's `folder` travels with the job; executors need no copy of their own.
    """
    documents.sparkSession.sparkContext.addFile(f"{folder}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(name).encode_ordinary
        for b in batches:
            sizes = [len(count(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("salt"), pa.array(sizes, pa.int64())], names=["doc_id", "salt", "tokens"])

    rows = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(id_column, text_column).alias("salt"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, salt bigint, tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the bin it fills best."""
    return fit(sizes, capacity, sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)))


def fit(sizes: list[int], capacity: int, order: Iterable[int] | None = None) -> list[list[int]]:
    """Bins of item numbers: each item in its turn, by number if no order is given, into the bin it fills best."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in range(len(sizes)) if order is None else order:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(free, (left - sizes[i], b))
    return bins


class Choices:
    """Items, or pairs of items of one bin, sorted by what they measure, which no step changes."""

    def __init__(self, size: np.ndarray, number: np.ndarray, one: np.ndarray, two: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        order = np.argsort(size, kind="stable")
        self.size, self.number, self.one = size[order], number[order], one[order]
        self.two, self.of = (None, None) if two is None else (two[order], of[order])


class Bins:
    """The state of a local search: which bin each item is in, and how full each bin is."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int) -> None:
        self.size, self.capacity = sizes, capacity
        self.of = np.zeros(len(sizes), np.int64)
        self.items = [set(b) for b in bins]
        for k, b in enumerate(bins):
            self.of[b] = k
        self.fill = np.bincount(self.of, sizes, len(bins)).astype(np.int64)
        # of bins in use
        self.room = np.where(self.fill > 0, capacity - self.fill, -1)

    def place(self, item: int, to: int) -> None:
        old = self.of[item]
        self.items[old].discard(item)
        self.items[to].add(item)
        for b, change in ((old, -self.size[item]), (to, self.size[item])):
            self.fill[b] += change
            self.room[b] = self.capacity - self.fill[b] if self.fill[b] else -1
        self.of[item] = to

    def most_room(self, home: int) -> int:
        """The most room of another bin in use."""
        own, self.room[home] = self.room[home], -1
        most = int(self.room.max())
        self.room[home] = own
        return most

    def move(self, a: int, home: int, most: int) -> bool:
        """Item a into the fullest bin that takes it."""
        if most < self.size[a]:
            return False
        fits = self.room >= self.size[a]
        fits[home] = False
        to = int(np.argmax(np.where(fits, self.fill, -1)))
        # as full a bin as this one must gain at least what this one loses
        if self.size[a] + self.fill[to] - self.fill[home] <= 0:
            return False
        self.place(a, to)
        return True

    def _best(self, size: int, home: int, most: int, by_size: Choices) -> tuple[int, int]:
        """What a choice is worth that is smaller than `size` by at most the room of its bin, and its number; the best, first one."""
        # most is no less than any room, so that what lies outside of the window is no choice
        x, y = by_size.size.searchsorted((size - most, size))
        if x >= y:
            return 0, -1
        gain = size - by_size.size[x:y]
        of = self.of[by_size.one[x:y]]
        ok = (gain <= self.room[of]) & (of != home)
        if by_size.two is not None:
            # both must still be where they were
            ok &= (of == by_size.of[x:y]) & (self.of[by_size.two[x:y]] == of)
        at = ok.nonzero()[0]
        if not len(at):
            return 0, -1
        gain = gain[at]
        worth = gain * (self.fill[of[at]] - self.fill[home] + gain)
        best = int(worth.max())
        return best, int(by_size.number[x + at[worth == best]].min())

    def exchange(self, a: int, home: int, most: int, pool: Choices) -> bool:
        """Item a for a smaller one of a fuller bin, the exchange that increases squared fill most."""
        worth, b = self._best(int(self.size[a]), home, most, pool)
        if worth <= 0:
            return False
        to = int(self.of[b])
        self.place(a, to)
        self.place(b, home)
        return True

    def two_for_one(self, a: int, home: int, most: int, pairs: tuple[Choices, np.ndarray, np.ndarray]) -> bool:
        """Item a for two items of a fuller bin that are smaller together."""
        choices, x, y = pairs
        worth, best = self._best(int(self.size[a]), home, most, choices)
        if worth <= 0:
            return False
        self.place(a, int(self.of[x[best]]))
        self.place(int(x[best]), home)
        self.place(int(y[best]), home)
        return True

    def one_for_two(self, home: int, most: int, pool: Choices) -> bool:
        """Two items for one of a fuller bin that is smaller than both together."""
        own = sorted(self.items[home], key=lambda i: (-self.size[i], i))
        best, chosen, tried = 0, None, set()
        for k, x in enumerate(own):
            for y in own[:k]:
                both = int(self.size[x] + self.size[y])
                if both in tried:
                    continue
                tried.add(both)
                worth, b = self._best(both, home, most, pool)
                if worth > best:
                    best, chosen = worth, (x, y, b, int(self.of[b]))
        if chosen is None:
            return False
        x, y, b, to = chosen
        self.place(b, home)
        self.place(x, to)
        self.place(y, to)
        return True


def _pairs(state: Bins, open_bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two items of one bin, for every bin in question; of items of one size one stands for all."""
    x, y, of = [], [], []
    for b in open_bins.tolist():
        by_size: dict[int, list[int]] = {}
        for i in state.items[b]:
            by_size.setdefault(int(state.size[i]), []).append(i)
        ones = [v[0] for v in by_size.values()]
        twos = [(v[0], v[1]) for v in by_size.values() if len(v) > 1]
        found = [(ones[i], ones[j]) for i in range(len(ones)) for j in range(i)] + twos
        x += [p for p, _ in found]
        y += [q for _, q in found]
        of += [b] * len(found)
    return np.array(x, np.int64), np.array(y, np.int64), np.array(of, np.int64)


def improve(sizes: list[int], bins: list[list[int]], capacity: int, rounds: int | None = None, steps: Counter | None = None) -> list[list[int]]:
    """The local search; it ends at the least number of bins that could do, or when nothing improves (or after `rounds`, if given).

    Every step increases the sum of squared fills, so it ends. `steps` counts what was done by kind.
    """
    size = np.array(sizes, np.int64)
    least = -(-int(size.sum()) // capacity)
    if len(bins) <= max(1, least):
        return bins
    state, steps = Bins(size, bins, capacity), Counter() if steps is None else steps
    in_use = lambda: int((state.fill > 0).sum())
    done, changed = 0, True
    while changed and done != rounds:
        done, changed = done + 1, False
        slack = np.flatnonzero((state.fill > 0) & (state.fill < capacity))
        if not len(slack) or in_use() <= least:
            break
        items = np.flatnonzero(np.isin(state.of, slack))
        pool = Choices(size[items], items, items)
        x, y, of = _pairs(state, slack)
        pairs = (Choices(size[x] + size[y], np.arange(len(x)), x, y, of), x, y)
        for home in slack[np.argsort(state.fill[slack], kind="stable")].tolist():
            if in_use() <= least:
                break
            most = state.most_room(home)
            for a in sorted(state.items[home], key=lambda i: (-sizes[i], i)):
                if state.of[a] != home:
                    continue
                kind = "move" if state.move(a, home, most) else "exchange" if state.exchange(a, home, most, pool) else "two for one" if state.two_for_one(a, home, most, pairs) else None
                if kind:
                    most = state.most_room(home)
                    steps[kind] += 1
                    changed = True
            if state.fill[home] and state.one_for_two(home, most, pool):
                steps["one for two"] += 1
                changed = True
    return [sorted(b) for b in state.items if b]


def searched(sizes: list[int], capacity: int) -> tuple[list[list[int]], int, Counter]:
    """The bins of a block, how many it started from, and the steps of the search that led from there."""
    start, steps = fit(sizes, capacity), Counter()
    bins = improve(sizes, start, capacity, steps=steps)
    if len(bins) > max(1, -(-sum(sizes) // capacity)):
        again, more = best_fit(sizes, capacity), Counter()
        other = improve(sizes, again, capacity, steps=more)
        if len(other) < len(bins):
            return other, len(again), more
    return bins, len(start), steps


def _sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The items of a block in an order of their own, whatever the data's: by a hash of the document."""
    mixed = pd.util.hash_array(pdf["doc_id"].fillna(-1).to_numpy(np.int64))
    return pdf.assign(mixed=mixed).sort_values(["mixed", "doc_id", "piece", "tokens"], kind="stable", na_position="first").reset_index(drop=True)


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _sizes(pdf)
    capacity, block = int(pdf["capacity"].iloc[0]), int(pdf["block"].iloc[0])
    sizes = [int(x) for x in pdf["tokens"]]
    number = np.zeros(len(sizes), np.int64)
    for k, b in enumerate(searched(sizes, capacity)[0]):
        number[b] = k
    pdf["bin"] = [f"b{block}-{k}" for k in number]
    return pdf[["size_id", "capacity", "doc_id", "piece", "tokens", "bin"]]


def _reported(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _sizes(pdf)
    capacity, sizes = int(pdf["capacity"].iloc[0]), [int(x) for x in pdf["tokens"]]
    bins, start, steps = searched(sizes, capacity)
    row = [pdf["size_id"].iloc[0], capacity, pdf["block"].iloc[0], -(-sum(sizes) // capacity), start, len(bins), *(steps[k] for k in STEPS)]
    return pd.DataFrame([row], columns=["size_id", "capacity", "block", "least", "start", "bins", *(k.replace(" ", "_") for k in STEPS)])


def _cut(documents: DataFrame, sizes: DataFrame, **tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Full containers of texts that exceed the capacity, and what is to be packed, in blocks."""
    counts = written(token_counts(documents, **tokenizer), "token-counts")
    caps = sizes.select("size_id", F.col("max_tokens").cast("bigint").alias("capacity")).filter("capacity > 0").distinct()
    # A handful of capacities against all texts: each text comes out once for each capacity.
    n = counts.select(F.count("*").alias("n")).first()["n"]
    blocks = max(1, -(-n // BLOCK_ITEMS))
    choices = [F.struct(F.lit(r.size_id).alias("size_id"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in caps.toLocalIterator()]
    choices = F.array(*choices) if choices else F.array().cast("array<struct<size_id:int,capacity:bigint>>")
    rows = counts.select("doc_id", "salt", "tokens", F.inline(choices))
    full = F.floor(F.col("tokens") / F.col("capacity"))
    rest = F.col("tokens") - full * F.col("capacity")
    rows = rows.withColumns({"full": full.cast("int"), "rest": rest})
    whole = rows.filter("full > 0").select("size_id", "capacity", "doc_id", "salt", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.col("capacity").alias("tokens"))
    whole = whole.withColumn("bin", F.concat_ws("-", F.lit("f"), "doc_id", F.col("salt"), "piece")).drop("salt")
    loose = rows.filter("rest > 0 OR full = 0").select("size_id", "capacity", F.pmod("salt", F.lit(blocks)).cast("bigint").alias("block"), "doc_id", F.col("full").alias("piece"), F.col("rest").alias("tokens"))
    return whole, loose.repartition(max(1, 3 * blocks), "size_id", "block")


def packed(documents: DataFrame, sizes: DataFrame, **tokenizer: str) -> DataFrame:
    """(size_id, capacity, doc_id, piece, tokens, bin) for every capacity of sizes (size_id, max_tokens).

    Pieces are numbered from 0; a text has one unless it exceeds the capacity. Texts without tokens are packed too.
    Capacities that are null or not positive are left out; without any, or without documents, there are no rows.
    """
    whole, loose = _cut(documents, sizes, **tokenizer)
    schema = "size_id int, capacity bigint, doc_id bigint, piece int, tokens bigint, bin string"
    return loose.groupBy("size_id", "block").applyInPandas(_packed, schema).unionByName(whole.select("size_id", "capacity", "doc_id", "piece", "tokens", "bin"))


def search_report(documents: DataFrame, sizes: DataFrame, **tokenizer: str) -> DataFrame:
    """(size_id, capacity, block, least, start, bins, and a count of each kind of step): what the search did in each block."""
    schema = "size_id int, capacity bigint, block bigint, least bigint, start bigint, bins bigint, " + ", ".join(f"{k.replace(' ', '_')} bigint" for k in STEPS)
    return _cut(documents, sizes, **tokenizer)[1].groupBy("size_id", "block").applyInPandas(_reported, schema)


def fill_report(packing: DataFrame) -> DataFrame:
    """(size_id, capacity, texts, bins, tokens, fill) of each capacity; fill is the share of the space that is used."""
    bins = packing.groupBy("size_id", "capacity", "bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    out = bins.groupBy("size_id", "capacity").agg(F.sum("items").alias("items"), F.count("*").alias("bins"), F.sum("tokens").alias("tokens"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))
