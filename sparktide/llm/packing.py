"""Packing documents into bins of fixed size: best fit, then swap-based local search.

Each shard of documents is packed on its own: best fit in the order of a hash, so that a bin mixes lengths as the corpus
does (packing by decreasing length would put documents of like length together), then rounds over the underfull
bins, from the emptiest. A document is moved to another underfull bin, exchanged for a shorter one,
exchanged for two others, or two are exchanged for one, whichever raises the sum of squared fills
most; that drains some bins until they are empty. It ends where the bins are as few as the tokens need, or nothing raises
the sum. Only ids and lengths are moved.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import lean, word_counts

CAPACITY = 4096
DOCS_PER_SHARD = 8192
#: A bin counts as underfull if more than this share of it is free.
SLACK = 0.0


def best_fit(lengths: list[int], capacity: int, decreasing: bool = False) -> list[list[int]]:
    """Best fit in the order given, or by decreasing length: bins as lists of item indices; each length is 1 to capacity."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if decreasing else range(len(lengths)):
        n = lengths[i]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            insort(free, (room - n, b))
    return bins


class _Bin:
    """A bin's documents by distinct length, and their pairs by distinct lengths: documents of one length are interchangeable.

    Distinct lengths sum to at most the capacity, so there are at most about sqrt(2 capacity) of them.
    """

    __slots__ = ("item", "pair", "pair_sum", "size")

    def __init__(self, size: np.ndarray, items: list[int]):
        own = np.array(items, dtype=np.int64)
        self.size, first, count = np.unique(size[own], return_index=True, return_counts=True)
        self.item = own[first]
        i, j = np.triu_indices(len(self.item), 1)
        twice = np.flatnonzero(count > 1)
        second = np.array([own[np.flatnonzero(size[own] == self.size[t])[1]] for t in twice], dtype=np.int64)
        self.pair = np.concatenate([np.stack([self.item[i], self.item[j]], axis=1), np.stack([self.item[twice], second], axis=1)])
        self.pair_sum = np.concatenate([self.size[i] + self.size[j], 2 * self.size[twice]])


class Search:
    """Swap-based local search over the bins of one shard; counts its steps and the bins it emptied."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int, slack: float = SLACK):
        self.size, self.capacity = np.array(lengths, dtype=np.int64), capacity
        self.bins = {b: list(items) for b, items in enumerate(bins)}
        self.fill = np.array([self.size[items].sum() for items in bins], dtype=np.int64)
        self.fewest = -(-int(self.size.sum()) // capacity) if len(lengths) else 0
        self.least = int(slack * capacity)
        self.steps = self.emptied = 0

    def squares(self) -> int:
        return int((self.fill**2).sum())

    def _gather(self, under: list[int], cache: dict[int, _Bin]) -> tuple[np.ndarray, ...]:
        one, two = [cache[b].size for b in under], [cache[b].pair_sum for b in under]
        at = np.arange(len(under))
        return np.concatenate(one), np.repeat(at, [len(x) for x in one]), np.concatenate(two), np.repeat(at, [len(x) for x in two])

    def _step(self, a: int, under: list[int], cache: dict[int, _Bin]) -> int | None:
        """The exchange of bin a with one of `under` that raises the sum of squared fills most; the other bin, None if nothing does."""
        fill = self.fill[under]
        size, home, pair, pair_home = self._gather(under, cache)
        own, here = cache[a], int(self.fill[a])
        best = (0, 0, 0, 0)
        # kinds: move one, one for one, one for two, two for one
        for kind, out, back, at in ((0, own.size, np.zeros(len(under), dtype=np.int64), np.arange(len(under))), (1, own.size, size, home), (2, own.size, pair, pair_home), (3, own.pair_sum, size, home)):
            if not len(out) or not len(back):
                continue
            delta = out[:, None] - back[None, :]
            target = fill[at][None, :] + delta
            gain = np.where((delta > 0) & (target <= self.capacity), delta * (target - here), 0)
            top = int(gain.argmax())
            if gain.flat[top] > best[0]:
                best = (int(gain.flat[top]), kind, *divmod(top, len(back)))
        if not best[0]:
            return None
        _, kind, i, j = best
        at = j if kind == 0 else int((home if kind != 2 else pair_home)[j])
        b = under[at]
        out = own.pair[i].tolist() if kind == 3 else [int(own.item[i])]
        if kind == 0:
            back = []
        elif kind == 2:
            back = cache[b].pair[j - int(np.searchsorted(pair_home, at))].tolist()
        else:
            back = [int(cache[b].item[j - int(np.searchsorted(home, at))])]
        self.bins[a] = [x for x in self.bins[a] if x not in out] + back
        self.bins[b] = [x for x in self.bins[b] if x not in back] + out
        change = int(self.size[out].sum() - self.size[back].sum())
        self.fill[a] -= change
        self.fill[b] += change
        self.steps += 1
        return b

    def run(self) -> list[list[int]]:
        """Bins at the end: as few as the tokens need, or no exchange with an underfull bin raises the sum of squared fills.

        Each step raises that sum, an integer with an upper bound, so it ends.
        """
        moved = True
        while moved and len(self.bins) > self.fewest:
            moved = False
            order = sorted((b for b in self.bins if self.capacity - self.fill[b] > self.least), key=lambda b: (self.fill[b], b))
            cache = {b: _Bin(self.size, self.bins[b]) for b in order}
            for a in order:
                if a not in cache:
                    continue
                under = [b for b in cache if b != a]
                while self.bins[a] and under:
                    b = self._step(a, under, cache)
                    if b is None:
                        break
                    moved = True
                    for x in (a, b):
                        if self.capacity - self.fill[x] > self.least:
                            cache[x] = _Bin(self.size, self.bins[x])
                        elif x in cache:
                            del cache[x]
                            under = [y for y in under if y != x]
                if not self.bins[a]:
                    del self.bins[a]
                    cache.pop(a, None)
                    self.emptied += 1
                    if len(self.bins) <= self.fewest:
                        break
        return list(self.bins.values())


def local_search(lengths: list[int], bins: list[list[int]], capacity: int, slack: float = SLACK) -> list[list[int]]:
    """The bins after Search; empty ones are dropped."""
    return Search(lengths, bins, capacity, slack).run()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(word_counts(batch.column("text")))], names=["id", "n"])


def _pack(capacity: int, slack: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("n", "descending"), ("id", "ascending")])
        shard, n = t.column("shard")[0].as_py() << 32, np.asarray(t.column("n"))
        full, rest = n // capacity, n % capacity
        # pieces of a whole bin first, then what is left of each document, then the documents without a token
        owner = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        left, none = np.flatnonzero(rest), np.flatnonzero(n == 0)
        lengths = rest[left].tolist()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity, slack)
        at = left[np.array([i for b in bins for i in b], dtype=np.int64)]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) + len(owner)
        pieces = np.concatenate([piece, full[at], np.zeros(len(none), dtype=np.int64)])
        bin_id = np.concatenate([np.arange(len(owner)), number, none]) + shard
        return pa.table({
            "bin_id": pa.array(bin_id, pa.int64(), mask=np.arange(len(bin_id)) >= len(bin_id) - len(none)),
            "doc_id": t.column("id").take(pa.array(np.concatenate([owner, at, none]))),
            "piece": pieces, "start_token": pieces * capacity,
            "n_tokens": np.concatenate([np.full(len(owner), capacity), rest[at], n[none]]),
        })

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD, slack: float = SLACK) -> DataFrame:
    """bin_id, doc_id, piece, start_token, n_tokens: each document's pieces and the bin of each.

    A token is a run of characters other than white space (space, tab, line feed, vertical tab, form feed, return). A document longer
    than a bin, however long, fills whole bins and leaves a rest. NULL texts and those without a token need no room: one row with bin_id NULL
    and 0 tokens. Every row is packed, repeated ones each for itself, also with a NULL id.
    Ids of any type are given as they are. Documents are taken in the order of a hash of id and length, then of the id; of exchanges that gain
    alike the first found is made. Other columns don't matter. An empty table gives no rows.
    """
    names = docs.columns
    for c in (id_col, text_col):
        if c not in names:
            raise ValueError(f"column {c!r} is missing; there are {names}")
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    d = docs.toDF(*[f"__p{i}" for i in range(len(names))])
    d = d.select(F.col(f"__p{names.index(id_col)}").alias("id"), F.col(f"__p{names.index(text_col)}").cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    shards = max(1, -(-docs.select(F.lit(1)).count() // docs_per_shard))
    sized = d.mapInArrow(lean(_sizes), f"id {kind}, n bigint")
    # the length and the place in the input take part, so that repeated ids, of many copies, don't all fall in one shard
    place = F.xxhash64("id", "n")
    sized = sized.withColumn("place", place).withColumn("shard", F.pmod(F.xxhash64("place", F.spark_partition_id()), F.lit(shards)))
    return sized.groupBy("shard").applyInArrow(_pack(capacity, slack), f"bin_id bigint, doc_id {kind}, piece bigint, start_token bigint, n_tokens bigint")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
