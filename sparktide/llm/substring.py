"""Repeated passages across documents, found batch by batch against a log-structured fingerprint index.

Documents are word sequences (see textkernel). A passage repeats if all its WINDOW-word windows
occurred earlier: in history, or in a document of the batch with a lesser id, or earlier in
the same document. Only later occurrences are reported and cut; the first stays.

Of the 26 25-word grams in each 50-word window the one with the least hash (the leftmost of equals) is
that window's fingerprint, so equal windows share a fingerprint at the same place and about
one gram in 13 is stored. Fingerprints of each batch are an immutable run: bucketed and sorted by
hash. A new batch is merge-joined with every run; windows around grams that met are rebuilt from the
texts on both sides and compared by 128-bit hashes (the verification); spans that were cut leave
tombstones; and runs of a level are merged into one of the next, without what tombstones cover.
A hash of each whole document is stored too (position -1), so that exact copies need no windows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .common import Scratch, restore, small, with_keys
from .textkernel import Words, chunks, lean, sliding_argmin, text_chunks

WINDOW = 50
GRAM = 25
#: More batches than the fan-out, so that runs are compacted before the last batch comes.
BATCHES = 4
FANOUT = 3
_WHOLE = (1 << 31) - 1
_RUN = "h bigint, id bigint, key bigint, pos int"
_SPANS = "id bigint, key bigint, src_id bigint, src_key bigint, ws int, we int"


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = np.asarray(batch.column("__id")), np.asarray(batch.column("__key"))
            for first, texts in text_chunks(batch.column("__text")):
                w = Words(texts)
                n = np.diff(w.off)
                g, _ = w.ngrams(gram)
                # windows that stay within one text; the text's own windows start at its words
                at = sliding_argmin(g, window - gram + 1)
                start = np.arange(len(at))
                inside = start + window <= np.repeat(w.off[1:], n)[: len(at)]
                at = at[inside]
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                long = np.flatnonzero(n >= window)
                doc = np.concatenate([w.doc[at], long])
                h = np.concatenate([g[at], w.text_hash(window)[long]])
                pos = np.concatenate([at - w.off[:-1][w.doc[at]], np.full(len(long), -1)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[first + doc]), pa.array(keys[first + doc]), pa.array(pos.astype(np.int32))], names=["h", "id", "key", "pos"])

    return lean(run)


def _windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, ages = (np.asarray(batch.column(c)) for c in ("id", "key", "age"))
            places = batch.column("places").to_pylist()
            for first, texts in text_chunks(batch.column("text")):
                w = Words(texts)
                h1, _ = w.ngrams(window, 1)
                h2, _ = w.ngrams(window, 2)
                mark = np.zeros(len(w.hash) + 1, dtype=np.int32)
                for i in range(len(texts)):
                    lo, hi = w.off[i], w.off[i + 1]
                    p = np.unique(np.asarray(places[first + i], dtype=np.int64))
                    a = np.maximum(p - (window - gram), 0) + lo
                    b = np.minimum(p + lo, hi - window) + 1
                    ok = a < b
                    np.add.at(mark, a[ok], 1)
                    np.add.at(mark, b[ok], -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                doc = first + w.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(ages[doc]), pa.array(ids[doc]), pa.array(keys[doc]), pa.array((at - w.off[:-1][w.doc[at]]).astype(np.int32))],
                    names=["w1", "w2", "age", "id", "key", "pos"],
                )

    return lean(run)


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the intervals [s, s + length)."""
    s = np.unique(starts)
    if not len(s):
        return []
    cut = np.flatnonzero(s[1:] > s[:-1] + length)
    return list(zip(s[np.append(0, cut + 1)].tolist(), (s[np.append(cut, len(s) - 1)] + length).tolist(), strict=True))


def _merge_spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, e) for i, p in enumerate(batch.column("starts").to_pylist()) for s, e in merged(np.asarray(p), window)]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(c).take(at) for c in ("id", "key", "src_id", "src_key")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["id", "key", "src_id", "src_key", "ws", "we"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, oldest first: (level, table, tombstones of its spans that were cut or None).

    Each run is a table bucketed by hash, so joins of runs with each other and with
    a new batch's run read it in place, without a shuffle. With a path the index lies there and can be opened again by a later
    session: a manifest, written last, names its runs, and what it doesn't name is no part of it.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int | None = None, fanout: int | None = None, window: int = WINDOW, gram: int = GRAM, path: str | None = None):
        self.spark, self.scratch, self.fanout, self.window, self.gram = spark, scratch, fanout or FANOUT, window, gram
        self.path, self.kept = path or scratch.path, path is not None
        self.runs: list[tuple[int, str, str | None]] = []
        self.pending: list[str] = []
        found = arrays.get_text(self.path, "manifest.json") if self.kept else None
        if found is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            return
        m = json.loads(found)
        if (m["window"], m["gram"]) != (window, gram):
            raise ValueError(f"the index has windows of {m['window']} and grams of {m['gram']} words")
        self.buckets = m["buckets"]
        self.runs = [tuple(r) for r in m["runs"]]
        for _, name, _ in self.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def write_run(self, rows: DataFrame) -> str:
        """A run's table name; the run isn't part of the index yet."""
        name = f"sparktide_run_{uuid.uuid4().hex}"
        self.pending.append(name)
        rows.repartition(self.buckets, "h").sortWithinPartitions("h").write.option("path", f"{self.path}/{name}").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def live(self, rows: DataFrame, dead: str | None) -> DataFrame:
        """Rows (key, pos) of a run that its tombstones don't cover: some window that holds the gram isn't cut whole."""
        if dead is None:
            return rows
        cut = small(self.spark.read.parquet(f"{self.path}/{dead}").select(F.col("key").alias("tk"), "ws", "we"), 24)
        covered = (F.col("key") == F.col("tk")) & (F.col("pos") - (self.window - self.gram) >= F.col("ws")) & (F.col("pos") + self.window <= F.col("we"))
        return rows.join(cut, covered, "left_anti")

    def add(self, run: str, cut: DataFrame) -> None:
        """Make a run history; `cut` are its spans (key, ws, we) that were cut.

        Full levels are compacted into one run of the next, without what tombstones cover, which are then spent.
        """
        dead = f"dead_{uuid.uuid4().hex}"
        cut.write.parquet(f"{self.path}/{dead}")
        self.runs.append((0, run, dead))
        gone: list[tuple[str, str | None]] = []
        level = 0
        while sum(r[0] == level for r in self.runs) >= self.fanout:
            old = [r for r in self.runs if r[0] == level]
            parts = []
            for _, r, d in old:
                rows = self.table(r)
                parts.append(self.live(rows.where("pos >= 0"), d).unionByName(rows.where("pos < 0")))
            new = self.write_run(_union(parts))
            self.pending.remove(new)
            gone += [(r, d) for _, r, d in old]
            self.runs = [(level + 1, new, None) if r is old[0] else r for r in self.runs if r is old[0] or r[0] != level]
            level += 1
        if self.kept:
            arrays.put_text(self.path, "manifest.json", json.dumps({"window": self.window, "gram": self.gram, "buckets": self.buckets, "runs": self.runs}))
        self.pending.remove(run)
        for r, d in gone:
            self.drop(r)
            if d is not None:
                self.scratch.delete(f"{self.path}/{d}")

    def drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.scratch.delete(f"{self.path}/{run}")

    def close(self) -> None:
        """Drop what a failed batch left; the catalog's tables go, and the files too unless the index is kept."""
        for r in self.pending:
            self.drop(r)
        for _, r, d in self.runs:
            if self.kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            else:
                self.drop(r)
                if d is not None:
                    self.scratch.delete(f"{self.path}/{d}")
        self.runs, self.pending = [], []


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame) -> DataFrame:
    """Repeated spans of one batch (id, key, src_id, src_key, ws, we, in words), which then joins the index.

    batch and history hold __id, __key and __text; history are the documents of all former batches.
    """
    s, window, gram = index.scratch, index.window, index.gram
    run = index.write_run(batch.select("__id", "__key", "__text").mapInArrow(_fingerprints(window, gram), _RUN))
    new = index.table(run)
    old = [(index.table(r), dead) for _, r, dead in index.runs]

    whole = new.where("pos = -1").select("h", "id", "key").distinct()
    first = Window.partitionBy("h").orderBy("age", "id", "key")
    met = [r.where("pos = -1").join(whole, "h", "left_semi").select("h", "id", "key", F.lit(0).alias("age")).distinct() for r, _ in old]
    seen = _union([whole.withColumn("age", F.lit(1)), *met])
    ranked = seen.select("*", F.first("id").over(first).alias("src_id"), F.first("key").over(first).alias("src_key"))
    copies = s.save(ranked.where("age = 1 AND key <> src_key").select("id", "key", "src_id", "src_key", F.lit(0).alias("ws"), F.lit(_WHOLE).alias("we")))

    rest = new.where("pos >= 0").join(small(copies.select("key"), 24), "key", "left_anti")
    often = rest.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    hits = [rest.join(often, "h", "left_semi").select("id", "key", "pos", F.lit(1).alias("age"))]
    for r, dead in old:
        r = r.where("pos >= 0")
        hits.append(rest.join(r, "h", "left_semi").select("id", "key", "pos", F.lit(1).alias("age")))
        hits.append(index.live(r.join(rest.select("h"), "h", "left_semi"), dead).select("id", "key", "pos", F.lit(0).alias("age")))
    places = s.save(_union(hits).groupBy("age", "id", "key").agg(F.collect_set("pos").alias("places")))

    docs = batch.select(F.lit(1).alias("age"), F.col("__key").alias("key"), F.col("__text").alias("text"))
    if old:
        docs = docs.unionByName(history.select(F.lit(0).alias("age"), F.col("__key").alias("key"), F.col("__text").alias("text")))
    total = places.agg(F.sum(F.size("places") * 4 + 40)).first()[0] or 0
    wanted = F.broadcast(places) if total <= 32 << 20 else places
    near = docs.join(wanted, ["age", "key"]).select("age", "id", "key", "places", "text")
    rows = near.mapInArrow(_windows(window, gram), "w1 bigint, w2 bigint, age int, id bigint, key bigint, pos int")
    by = Window.partitionBy("w1", "w2").orderBy("age", "id", "key", "pos")
    again = rows.select("age", "id", "key", "pos", F.row_number().over(by).alias("n"), F.first("id").over(by).alias("src_id"), F.first("key").over(by).alias("src_key"), F.first("pos").over(by).alias("src_pos"))
    # a row of a repeated document meets itself at the same place; that is no repetition
    again = again.where("n > 1 AND age = 1 AND NOT (key = src_key AND pos = src_pos)")
    spans = again.groupBy("id", "key", "src_id", "src_key").agg(F.collect_list("pos").alias("starts")).mapInArrow(_merge_spans(window), _SPANS)
    out = s.save(copies.unionByName(spans))
    s.drop(copies, places)
    index.add(run, out.select("key", "ws", "we"))
    return out


def batch_bounds(base: DataFrame, batches: int) -> list[tuple[Column, Column]]:
    """Conditions of each batch and of what came before it: ranges of __id of about equal count."""
    cuts = base.agg(F.percentile_approx("__id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = [None, *cuts, None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = (F.lit(True) if lo is None else F.col("__id") > lo) & (F.lit(True) if hi is None else F.col("__id") <= hi)
        out.append((inside, F.lit(False) if lo is None else F.col("__id") <= lo))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, index_path: str | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str], Scratch]:
    """All repeated spans of docs, taken as `batches` batches in order of the id; see the module's text.

    Batches change the order of work, not the result. NULL and empty texts, and those of fewer than
    `window` words, have no spans. Of equal passages the first in order of id, then of place, stays; ids that aren't integral are
    ordered by their hash, and NULL ids come last. Rows that agree in id and text are one document. Texts of any length
    are taken whole.
    With index_path (in a folder that executors share) the index is kept there, and a later call with new docs goes on from it: history then holds the
    documents of all former calls, which come before docs.
    Returns spans, the rows with keys, the column names and the scratch folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    base, names = with_keys(docs, id_col, text_col)
    gram = max(1, window // 2)
    index = FingerprintIndex(spark, scratch, window=window, gram=gram, path=index_path)
    past = with_keys(history, id_col, text_col)[0].select("__id", "__key", "__text") if history is not None else None
    parts = []
    try:
        for inside, before in batch_bounds(base, batches):
            known = base.where(before).select("__id", "__key", "__text")
            parts.append(dedup_batch(index, base.where(inside), known if past is None else known.unionByName(past)))
    finally:
        index.close()
    spans = scratch.save(_union(parts))
    scratch.drop(*parts)
    return spans, base, names, scratch


def _char_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ws, we = np.asarray(batch.column("ws")), np.asarray(batch.column("we"))
        start, end, count = [], [], []
        for first, texts in chunks(batch.column("text").to_pylist()):
            w = Words(texts)
            n = np.diff(w.off)
            for i in range(len(texts)):
                a, b = int(ws[first + i]), int(min(we[first + i], n[i]))
                start.append(int(w.start[w.off[i] + a]))
                end.append(int(w.end[w.off[i] + b - 1]))
                count.append(b - a)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("src"), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(count, pa.int64())], names=["doc", "src", "s", "e", "n"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, index_path: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """Report, one row per repeated passage: doc_id, first_doc_id, start_char, end_char, n_words.

    The passage in first_doc_id stays. Ids are the table's own, of any type. Offsets count code points of the text. See repeated_spans for
    NULL, empty, very long and repeated rows, and for index_path; an empty table gives an empty report. Other columns don't matter.
    """
    spans, base, names, scratch = repeated_spans(docs, id_col, text_col, window, batches, index_path, history)
    own = f"__p{names.index(id_col)}"
    kind = dict(base.dtypes)[own]
    every = base.select("__key", F.col(own).alias("src"))
    if history is not None:
        past, past_names = with_keys(history, id_col, text_col)
        every = every.unionByName(past.select("__key", F.col(f"__p{past_names.index(id_col)}").alias("src")))
    firsts = scratch.save(spans.select(F.col("src_key").alias("__key")).distinct())
    firsts = scratch.save(every.join(small(firsts, 24), "__key", "left_semi").dropDuplicates(["__key"]).withColumnRenamed("__key", "src_key"))
    named = scratch.save(spans.join(small(firsts, 80), "src_key").select("key", "ws", "we", "src"))
    rows = base.select(F.col("__key").alias("key"), F.col(own).alias("doc"), F.col("__text").alias("text")).join(small(named, 96), "key").select("doc", "src", "ws", "we", "text")
    found = rows.mapInArrow(_char_spans, f"doc {kind}, src {kind}, s bigint, e bigint, n bigint").distinct()
    return found.toDF("doc_id", "first_doc_id", "start_char", "end_char", "n_words")


def cut_text(text: str, w: Words, i: int, spans: list[tuple[int, int]]) -> str | None:
    """The text without these spans of its words and what follows each up to the next word; None if no word is left."""
    lo, n = int(w.off[i]), int(w.off[i + 1] - w.off[i])
    keep = np.ones(n, dtype=bool)
    for a, b in spans:
        keep[a : min(b, n)] = False
    if not keep.any():
        return None
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~keep, [False]]).astype(np.int8)))
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : int(w.start[lo + a])])
        at = int(w.start[lo + b]) if b < n else len(text)
    out.append(text[at:])
    return "".join(out)


def _cut(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("__text").to_pylist()
            spans = batch.column("__spans").to_pylist()
            new: list[str | None] = []
            for first, texts in chunks(raw):
                w = Words(texts)
                new += [cut_text(t, w, i, [(s["ws"], s["we"]) for s in spans[first + i]]) for i, t in enumerate(texts)]
            place = batch.schema.get_field_index(f"__p{text_at}")
            kept = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            yield kept.select([c for c in kept.schema.names if c.startswith("__p")]).filter(pa.array([x is not None for x in new], pa.bool_()))

    return lean(run)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, length_col: str | None = "n_chars") -> DataFrame:
    """docs without repeated passages, all columns kept; a document that loses all its words goes.

    length_col, if there is such a column, is set to the new length of the texts that changed. Other
    rows, such as those with NULL or empty texts, stay as they are. See repeated_spans for the rest.
    """
    spans, base, names, scratch = repeated_spans(docs, id_col, text_col, window, batches)
    by_key = scratch.save(spans.groupBy("key").agg(F.collect_list(F.struct("ws", "we")).alias("__spans")).withColumnRenamed("key", "__key"))
    total = by_key.agg(F.sum(F.size("__spans") * 8 + 40)).first()[0] or 0
    hint = F.broadcast if total <= 32 << 20 else lambda x: x
    places = [f"__p{i}" for i in range(len(names))]
    same = base.join(hint(by_key.select("__key")), "__key", "left_anti").select(*places)
    schema = base.select(*places).schema
    changed = base.join(hint(by_key), "__key").select(*places, "__text", "__spans").mapInArrow(_cut(names.index(text_col)), schema)
    if length_col in names:
        n = f"__p{names.index(length_col)}"
        changed = changed.withColumn(n, F.length(f"__p{names.index(text_col)}").cast(schema[n].dataType))
    return restore(same.unionByName(changed), names)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


