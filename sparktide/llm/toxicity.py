"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence ends at . ! ? (or their wide forms) or a line feed. Its features are its words and their prefixes of
3, 4, 5 and 7 characters; its score is p = sigmoid(w.x + b); a document's is the noisy-or
1 - prod(1 - p) over its sentences. w and b maximize the likelihood of the labels of a bounded sample of
documents, so sentences need no labels, and the high p then locate what makes a document toxic.
Training runs in one executor task; scoring is a scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick
from .textkernel import U64, Words, chunks, lean, mix64, text_chunks

#: Most labelled documents of either label that the classifier is fitted on.
SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 6000
#: Features kept by their G-test against the label.
MAX_FEATURES = 20_000
PREFIXES = (3, 4, 5, 7)
THRESHOLD = 0.5
ROUNDS = 300
L2 = 0.02
_ENDS = np.array([ord(c) for c in ".!?\n。！？…"], dtype=np.uint32)
_BITS = 20
_SCREEN = 22
#: Entries of the training matrix that are taken at a time.
_FIT_BLOCK = 1 << 18


def sentence_words(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the sentence number of each (through all texts), and each sentence's text and first word."""
    w = Words(texts)
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.isin(raw, _ENDS))
    of = ends[w.start + w.base[w.doc]] if len(w.hash) else np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype=np.int64)
    number = np.zeros(len(of), dtype=np.int64)
    number[first[1:]] = 1
    return w, np.cumsum(number), w.doc[first] if len(first) else first, first


def features(w: Words) -> list[np.ndarray]:
    """Hashes of each word's features: itself and its prefixes, each kind with its own salt."""
    return [w.hash, *(mix64(w.prefix_hash(n) + U64(n)) for n in PREFIXES)]


class Model:
    """Sorted feature hashes, their weights, and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], float(bias)
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.hashes >> U64(64 - _BITS)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are features, and their numbers."""
        at = np.flatnonzero(self.maybe[(h >> U64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == h[at]
        return at[hit], place[hit]

    def score(self, texts: list[str]) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
        """Toxicity of each text, its words, and each sentence's text, first word and score."""
        w, number, doc, first = sentence_words(texts)
        at, feature = [], []
        for h in features(w):
            a, f = self.lookup(h)
            at.append(number[a])
            feature.append(f)
        s, f = np.concatenate(at), np.concatenate(feature)
        if len(s):
            both = np.unique(s * len(self.hashes) + f)
            s, f = both // len(self.hashes), both % len(self.hashes)
        z = self.bias + np.bincount(s, weights=self.weights[f], minlength=len(first))
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(texts))
        return -np.expm1(-total), w, doc, first, 1 / (1 + np.exp(-z))


def _g_test(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """G statistic of features against the label, from the documents of either label that have them; 0 below 3 documents."""
    e1, e0 = (pos + neg) * n1 / (n1 + n0), (pos + neg) * n0 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(pos > 0, pos * np.log(pos / e1), 0) + np.where(neg > 0, neg * np.log(neg / e0), 0)
    return np.where(pos + neg < 3, 0.0, g)


def fit(texts: list[str], labels: np.ndarray, max_features: int = MAX_FEATURES, rounds: int = ROUNDS, l2: float = L2) -> Model:
    """The model for labelled texts; without texts of both labels, one that scores all near 0.

    Deterministic: full gradients (Adam), no random start.
    """
    y = labels.astype(bool)
    nothing = Model(np.zeros(0, dtype=U64), np.zeros(0), -30.0)
    if not y.any() or y.all():
        return nothing
    # a first pass counts documents of either label by bucket of features, so that only promising ones are kept
    counts = np.zeros((2, 1 << _SCREEN), dtype=np.int32)
    for start, part in chunks(texts):
        w = Words(part)
        for h in features(w):
            both = np.unique((w.doc.astype(U64) << U64(_SCREEN)) | (h >> U64(64 - _SCREEN)))
            bucket, label = (both & U64((1 << _SCREEN) - 1)).astype(np.int64), y[start + (both >> U64(_SCREEN)).astype(np.int64)]
            for i in (0, 1):
                own, n = np.unique(bucket[label == bool(i)], return_counts=True)
                counts[i, own] += n.astype(np.int32)
    n1, n0 = float(y.sum()), float((~y).sum())
    good = np.zeros(1 << _SCREEN, dtype=bool)
    seen = np.flatnonzero(counts[0] + counts[1] >= 3)
    score = _g_test(counts[1, seen].astype(np.float64), counts[0, seen].astype(np.float64), n1, n0)
    best = np.argsort(-score, kind="stable")[: 2 * max_features]
    good[seen[best[score[best] > 0]]] = True
    del counts, score, seen
    # a second one counts those of each feature in a good bucket, and keeps the best features
    tallies = []
    for start, part in chunks(texts):
        w = Words(part)
        for h in features(w):
            use = np.flatnonzero(good[(h >> U64(64 - _SCREEN)).astype(np.int64)])
            if not len(use):
                continue
            h, d = h[use], w.doc[use] + start
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            h, label = h[new], y[d[new]]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            tallies.append((h[first], np.add.reduceat(label.astype(np.int32), first), np.add.reduceat((~label).astype(np.int32), first)))
    if not tallies:
        return nothing
    uniq, at = np.unique(np.concatenate([x[0] for x in tallies]), return_inverse=True)
    pos, neg = (np.bincount(at, weights=np.concatenate([x[i] for x in tallies]), minlength=len(uniq)) for i in (1, 2))
    del tallies, at
    g = _g_test(pos, neg, n1, n0)
    kept = np.flatnonzero(g > 0)
    kept = np.sort(kept[np.argsort(-g[kept], kind="stable")[:max_features]])
    if not len(kept):
        return nothing
    table = Model(uniq[kept], np.zeros(len(kept)), 0.0)
    # a third one lists each sentence's features, in order of the sentences
    fs, ss, sentence_doc = [], [], []
    n_sent = 0
    for start, part in chunks(texts):
        w, number, doc, _ = sentence_words(part)
        pairs = []
        for h in features(w):
            place, feature = table.lookup(h)
            pairs.append(number[place] * len(kept) + feature)
        both = np.unique(np.concatenate(pairs))
        fs.append((both % len(kept)).astype(np.min_scalar_type(len(kept))))
        ss.append((both // len(kept) + n_sent).astype(np.int32))
        sentence_doc.append((doc + start).astype(np.int32))
        n_sent += len(doc)
    sdoc = np.concatenate(sentence_doc)
    f = np.concatenate(fs)
    del fs
    s = np.concatenate(ss)
    del ss, sentence_doc
    blocks = [slice(i, i + _FIT_BLOCK) for i in range(0, len(f), _FIT_BLOCK)]
    w, b = np.zeros(len(kept)), -6.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        z = np.full(n_sent, b)
        for k in blocks:
            lo = s[k.start]
            part = np.bincount(s[k] - lo, weights=w[f[k]])
            z[lo : lo + len(part)] += part
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(sdoc, weights=np.logaddexp(0, z), minlength=len(y))
        pull = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        dz = p * pull[sdoc]
        slope = l2 * w
        for k in blocks:
            slope += np.bincount(f[k], weights=dz[s[k]], minlength=len(kept))
        grad = np.append(slope, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * min(1.0, 2 * (1 - t / (rounds + 1)))
        w -= step[:-1]
        b -= step[-1]
    return Model(table.hashes, w, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN, max_features: int = MAX_FEATURES) -> Model:
    """Model fitted on labelled documents: of each label the documents with the least hashed ids, up to a bound.

    At most most_toxic and most_clean documents are fitted on, and of their features the max_features of the highest G statistic
    are kept, chosen from buckets of features in twice that number. Labels without an id or a label are left out; of several labels of an id the largest counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = pick(labels, id=id_col, y=label_col).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.max("y") > 0).alias("y"))
    few = [marks.where(F.col("y") == lit).orderBy(F.xxhash64("id"), "id").limit(n) for lit, n in ((F.lit(True), most_toxic), (F.lit(False), most_clean))]
    sample = F.broadcast(few[0].unionByName(few[1]))  # bounded by its two limits
    texts = pick(docs, id=id_col, text=text_col).join(sample, "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", bool(y)) for b in batches for i, y, t in zip(b.column("id").to_pylist(), b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True))
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows], dtype=bool), max_features)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.hashes, U64(0)).view(np.int64)), pa.array(np.append(model.weights, model.bias)), pa.array([False] * len(model.hashes) + [True])], names=["h", "w", "bias"])

    saved = scratch.save(texts.repartition(1).mapInArrow(lean(run), "h bigint, w double, bias boolean"))
    rows = saved.toArrow()  # at most MAX_FEATURES + 1 rows
    h, w, bias = (np.asarray(rows.column(c)) for c in ("h", "w", "bias"))
    scratch.drop(saved)
    if not len(bias):
        return fit([], np.zeros(0, dtype=bool))
    return Model(h[~bias].view(U64), w[~bias], w[bias][0])


_ROW = "toxicity double, sentence int, start_char int, end_char int, score double"


def _locate(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for start, texts in text_chunks(batch.column("text")):
                toxicity, w, doc, first, p = model.value.score(texts)
                bad = np.flatnonzero(toxicity >= threshold)
                if not len(bad):
                    continue
                begin = np.searchsorted(doc, bad)
                stop = np.searchsorted(doc, bad, side="right")
                pick_s, pick_n = [], []
                for a, e in zip(begin.tolist(), stop.tolist(), strict=True):
                    s = np.flatnonzero(p[a:e] >= threshold)
                    s = s if len(s) else np.array([int(p[a:e].argmax())])
                    pick_s.append(a + s)
                    pick_n.append(s)
                s, n = np.concatenate(pick_s), np.concatenate(pick_n)
                last = np.append(first[1:], len(w.hash))[s] - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + doc[s])), pa.array(toxicity[doc[s]]), pa.array(n.astype(np.int32)), pa.array(w.start[first[s]].astype(np.int32)), pa.array(w.end[last].astype(np.int32)), pa.array(p[s])], names=["id", "toxicity", "sentence", "start_char", "end_char", "score"])

    return lean(run)


def toxic_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, toxicity, sentence, start_char, end_char, score: the offending sentences of each toxic document.

    A document is toxic if its toxicity is at least threshold; its offending sentences are those whose own score is, or
    else the one that scores highest. Offsets count code points, from the first word to the last of the sentence;
    sentences are numbered from 0 among those with a word. Texts that are NULL, empty or without a word have
    toxicity 0; texts of any length are scored whole. Each of repeated rows is reported. Ids of any type, NULL too, are given as they are.
    Of sentences that score alike the first is the one that scores highest. Other columns don't matter; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES features
    d = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    rows = d.mapInArrow(_locate(shared, threshold), f"id {d.schema['id'].dataType.simpleString()}, {_ROW}")
    return rows.withColumnRenamed("id", "doc_id")


def _keep(model, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.value.score(t)[0] < threshold for _, t in text_chunks(batch.column(text_at))]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return lean(run)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose toxicity is below threshold, all columns as they are; NULL and empty texts stay."""
    names = docs.columns
    if text_col not in names:
        raise ValueError(f"column {text_col!r} is missing; there are {names}")
    d = docs.toDF(*[f"__p{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_keep(shared, names.index(text_col), threshold), d.schema).toDF(*names)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic_sentences(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
