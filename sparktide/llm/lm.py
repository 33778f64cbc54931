"""Language-model scores: interpolated modified Kneser-Ney over UTF-8 bytes.

Six bytes make the longest n-gram, so an n-gram is a 48-bit number and the counting is exact. Texts begin with five
start symbols and end with an end symbol, bytes that UTF-8 never uses. All documents are counted; the counts of
shorter n-grams are numbers of distinct extensions to the left, derived in Spark level by level from
the table of the longest. Each level gives probabilities (interpolated with the level below) and
back-off weights of its contexts, written to the shared folder as arrays sorted by a hash of the n-gram;
workers memory-map them. A batch's n-grams are sorted together with their documents, so each
distinct one is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import Scratch, pick
from .textkernel import U64, chunks, mix64

ORDER = 6
START, END = 0xFE, 0xFF
#: Symbols that the model spreads what is left over: the bytes of UTF-8 and the end.
SYMBOLS = 256.0
CHUNK_BYTES = 1 << 21
_MERGE = 1 << 22


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 6-byte n-gram that ends at each byte and at the end of each text, and how many each text has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes([START]) * (ORDER - 1)
    b = np.frombuffer(b"".join(pad + r + bytes([END]) for r in raw), dtype=np.uint8)
    n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    ends = np.cumsum(n + ORDER - 1)
    g = b[ORDER - 1 :].astype(U64)
    for j in range(1, ORDER):
        g |= b[ORDER - 1 - j : len(b) - j].astype(U64) << U64(8 * j)
    keep = np.ones(len(g), dtype=bool)
    # n-grams whose last byte belongs to the start of the next text
    for e in range(ORDER - 1):
        at = ends[:-1] + e - (ORDER - 1)
        keep[at] = False
    return g[keep], n


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g)
    g, c = g[order], c[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g[first], np.add.reduceat(c, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for _, texts in chunks(batch.column(0).to_pylist(), CHUNK_BYTES):
            g, _ = grams(texts)
            u, c = np.unique(g, return_counts=True)
            parts.append((u, c))
            size += len(u)
            if size > _MERGE:
                parts = [_merge(parts)]
                size = len(parts[0][0])
                if size > _MERGE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["g", "c"])
                    parts, size = [], 0
    if parts:
        g, c = _merge(parts)
        for i in range(0, len(g), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(g[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)])], names=["g", "c"])


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of n-grams counted 1 to 4 times.

    Where one can't be estimated, or isn't between 0 and its count, it is 0.5, 1 or 1.5.
    """
    out = []
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        d = i - (i + 1) * y * b / a if a and y else -1.0
        out.append(d if 0 < d < i else i / 2)
    return out[0], out[1], out[2]


def _suffix(g: Column, k: int) -> Column:
    return g.bitwiseAND(F.lit((1 << (8 * k)) - 1))


def _discount(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


class Model:
    """Where the arrays lie: parts of each order, by the top bits of the hash."""

    def __init__(self, root: str, parts: int):
        self.root, self.parts = root, parts
        self.open: dict[str, list] = {}

    def __getstate__(self):
        return {"root": self.root, "parts": self.parts, "open": {}}

    def _find(self, name: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in the table, and its value."""
        if name not in self.open:
            self.open[name] = [arrays.get(self.root, f"{name}-{i}", "h", "v") for i in range(self.parts)]
        hit, value = np.zeros(len(h), dtype=bool), np.zeros(len(h))
        order = np.argsort(h)
        s = h[order]
        edges = [0, *np.searchsorted(s, np.array([(i << 64) // self.parts for i in range(1, self.parts)], dtype=U64)).tolist(), len(s)]
        for (keys, values), a, b in zip(self.open[name], edges, edges[1:], strict=False):
            if a == b or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, s[a:b]), len(keys) - 1)
            ok = keys[at] == s[a:b]
            hit[order[a:b]] = ok
            value[order[a:b]] = np.where(ok, values[at], 0)
        return hit, value

    def log_prob(self, g: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each n-gram's last byte after the others."""
        out = np.zeros(len(g))
        rest = np.arange(len(g))
        for k in range(ORDER, 0, -1):
            own = g[rest] & U64((1 << (8 * k)) - 1)
            hit, value = self._find(f"p{k}", mix64(own))
            out[rest[hit]] += value[hit]
            rest, own = rest[~hit], own[~hit]
            if not len(rest):
                return out
            _, value = self._find(f"b{k}", mix64(own >> U64(8)))
            out[rest] += value  # a context that never occurred leaves all to the level below
        out[rest] -= np.log(SYMBOLS)
        return out


def _write_part(root: str, parts: int):
    def run(t: pa.Table) -> pa.Table:
        name, part = t.column("name")[0].as_py(), t.column("part")[0].as_py()
        h = mix64(np.asarray(t.column("g")).astype(np.int64).view(U64))
        order = np.argsort(h)
        arrays.put(root, f"{name}-{part}", h=h[order], v=np.asarray(t.column("v"))[order].astype(np.float32))
        return pa.table({"rows": pa.array([len(h)], pa.int64())})

    return run


def _part_of(parts: int):
    """The part of an n-gram: its hash's place among `parts` equal ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=U64)
        for batch in batches:
            h = mix64(np.asarray(batch.column("g")).view(U64))
            yield batch.append_column("part", pa.array(np.searchsorted(edges, h, side="right").astype(np.int32)))

    return run


def train(docs: DataFrame, text_col: str = "text", parts: int | None = None) -> Model:
    """Count all texts and write the model. NULL texts aren't counted; empty ones count as an end."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    text = pick(docs, text=text_col).where("text IS NOT NULL")
    level = scratch.save(text.mapInArrow(_count, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")))
    parts = parts or max(1, -(-level.count() // 4_000_000))
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = scratch.save(levels[k + 1].groupBy(_suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")))
    below = None
    tables = []
    for k in range(1, ORDER + 1):
        t = levels[k]
        n = t.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first()
        d = discounts(*map(float, n))
        context = F.shiftright("g", 8)
        by = t.groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3"))
        by = by.select("ctx", "total", ((F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("total")).alias("back"))
        p = t.withColumn("ctx", context).join(by, "ctx").withColumn("own", (F.col("c") - _discount(d)) / F.col("total"))
        if below is None:
            p = p.select("g", (F.col("own") + F.col("back") / SYMBOLS).alias("p"))
        else:
            lower = below.select(F.col("g").alias("low"), F.col("p").alias("q"))
            p = p.withColumn("low", _suffix(F.col("g"), k - 1)).join(lower, "low").select("g", (F.col("own") + F.col("back") * F.col("q")).alias("p"))
        below = scratch.save(p)
        tables.append(below.select(F.lit(f"p{k}").alias("name"), "g", F.log("p").alias("v")))
        tables.append(by.select(F.lit(f"b{k}").alias("name"), F.col("ctx").alias("g"), F.log("back").alias("v")))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    every = every.mapInArrow(_part_of(parts), "name string, g bigint, v double, part int")
    root = f"{scratch.path}/model"
    none = np.zeros(0)
    there = {(r[0], r[1]) for r in every.groupBy("name", "part").applyInArrow(_named(root, parts), "name string, part int").collect()}
    for k in range(1, ORDER + 1):
        for name in (f"p{k}", f"b{k}"):
            for i in range(parts):
                if (name, i) not in there:
                    arrays.put(root, f"{name}-{i}", h=none.astype(U64), v=none.astype(np.float32))
    scratch.drop(*levels.values())
    return Model(root, parts)


def _named(root: str, parts: int):
    write = _write_part(root, parts)

    def run(t: pa.Table) -> pa.Table:
        write(t)
        return pa.table({"name": t.column("name").slice(0, 1), "part": t.column("part").slice(0, 1)})

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            raw = batch.column("text").to_pylist()
            total, count = np.zeros(len(raw)), np.zeros(len(raw), dtype=np.int64)
            for first, texts in chunks(raw, CHUNK_BYTES):
                for a in range(0, len(texts), 1 << 16):
                    part = texts[a : a + (1 << 16)]
                    g, n = grams(part)
                    # the document in the low bits: one sort groups equal n-grams
                    x = np.sort((g << U64(16)) | np.repeat(np.arange(len(part), dtype=U64), n))
                    g, doc = x >> U64(16), (x & U64(0xFFFF)).astype(np.int64)
                    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    p = np.repeat(m.log_prob(g[start]), np.diff(np.append(start, len(g))))
                    s = slice(first + a, first + a + len(part))
                    total[s] = np.bincount(doc, weights=p, minlength=len(part))
                    count[s] = n
            null = np.array([t is None for t in raw], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count - 1, mask=null), pa.array(total, mask=null), pa.array(np.exp(-total / np.maximum(count, 1)), mask=null)], names=["id", "n", "lp", "pp"])

    return run


def perplexity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, log_prob (natural), perplexity (per byte, the end included); one row per row of docs.

    A NULL text gives NULLs; an empty one is scored for its end alone; texts of any length are scored whole, repeated rows each.
    Ids of any type, NULL too, are given as they are. Other columns don't matter. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_score(shared), f"id {d.schema['id'].dataType.simpleString()}, n bigint, lp double, pp double").toDF("doc_id", "n_bytes", "log_prob", "perplexity")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return perplexity(docs, train(docs))
