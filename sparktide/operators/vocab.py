"""Tokens, vocabularies, encodings, and pair merging (byte-pair and word-piece n-grams)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..functions.text import english_words, slices
from .shared import checkpointed, ordered_ids


def explode_tokens(df: DataFrame, tokens: str = "tokens", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, term): one row per token, pos from 1."""
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens).alias("pos", "term")).withColumn("pos", F.col("pos") + 1)


def vocabulary(tok: DataFrame) -> DataFrame:
    """(term, term_id): distinct terms in code point order, ids from 0."""
    return ordered_ids(tok, "term", "term_id")


def encode(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, pos, term_id); unknown terms get id 0."""
    return tok.join(vocab, "term", "left").select("doc_id", "pos", F.coalesce("term_id", F.lit(0)).alias("term_id"))


def term_counts(tok: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return tok.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def count_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of documents (doc_id, tokens), each counted in its row: no shuffle. Ids must be distinct."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            words = tokens.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(tokens)), np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))
            both, n = np.unique(row * max(1, len(words.dictionary)) + np.asarray(words.indices, dtype=np.int64), return_counts=True)
            at, term = np.divmod(both, max(1, len(words.dictionary)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), words.dictionary.take(pa.array(term)), pa.array(n)], names=["doc_id", "term", "tf"])

    return docs.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, term string, tf bigint")


def count_english(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, tf) of documents' English words: cleaned and counted in one pass, a slice of a batch at a time, no shuffle. Ids must be distinct."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stop = frozenset(ENGLISH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                counts = [Counter(english_words(t, False, stop)) if t else {} for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                at = np.repeat(np.arange(lo, hi), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["doc_id", "term", "tf"])

    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, term string, tf bigint")


def english_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tokens) of documents' English words; as clean_english, but each slice is handed on at once, not a whole batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stop = frozenset(ENGLISH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words = [None if t is None else english_words(t, False, stop) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "tokens"])

    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, tokens array<string>")


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df) of per-document counts."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def token_frequency(tok: DataFrame) -> DataFrame:
    """(term, freq)."""
    return tok.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def inverted_index(tok: DataFrame) -> DataFrame:
    """(term, docs): the sorted ids of the documents that hold each term."""
    return tok.groupBy("term").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def drop_pure_numbers(vocab: DataFrame) -> DataFrame:
    """The vocabulary without numbers (also joined by underscores), with dense ids again."""
    return ordered_ids(vocab.where(~F.col("term").rlike("^[0-9]+(_[0-9]+)*$")), "term", "term_id")


def pair_counts(tok: DataFrame) -> DataFrame:
    """(w1, w2, freq) of adjacent tokens."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    pairs = tok.select(F.col("term").alias("w1"), F.lead("term").over(w).alias("w2")).where("w2 IS NOT NULL")
    return pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("freq"))


def _with_parts(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    a, b = freq.select(F.col("term").alias("w1"), F.col("freq").alias("f1")), freq.select(F.col("term").alias("w2"), F.col("freq").alias("f2"))
    return pairs.join(a, "w1").join(b, "w2")


def _pmi(parts: DataFrame, n_pairs: Column, n_tokens: Column) -> DataFrame:
    return parts.select("w1", "w2", "freq", F.log2((F.col("freq") / n_pairs) / ((F.col("f1") / n_tokens) * (F.col("f2") / n_tokens))).alias("pmi"))


def _likelihood(parts: DataFrame, smoothing: float = 1e-10) -> DataFrame:
    return parts.select("w1", "w2", "freq", (F.col("freq") / ((F.col("f1") + smoothing) * (F.col("f2") + smoothing))).alias("score"))


def pair_pmi(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """pairs with pmi = log2(p_xy / (p_x p_y)); pair and token totals are their own sums."""
    totals = pairs.agg(F.sum("freq").alias("np")).crossJoin(freq.agg(F.sum("freq").alias("nt")))
    return _pmi(_with_parts(pairs, freq).crossJoin(F.broadcast(totals)), F.col("np"), F.col("nt"))


def pair_likelihood(pairs: DataFrame, freq: DataFrame, smoothing: float = 1e-10) -> DataFrame:
    """pairs with score = f_xy / ((f_x + s)(f_y + s))."""
    return _likelihood(_with_parts(pairs, freq), smoothing)


def best_pair(pairs: DataFrame, score: Column | str = "freq", least: int = 2) -> DataFrame:
    """The pair of highest score among those of frequency `least` and more; ties by the words."""
    s = F.col(score) if isinstance(score, str) else score
    return pairs.where(F.col("freq") >= least).orderBy(s.desc(), "w1", "w2").limit(1)


def merge_pair(tokens: Column, w1: Column, w2: Column, new: Column) -> Column:
    """A token array with each w1, w2 in a row replaced by new, from the left, without overlap. Tokens hold no \\x01.

    Linear in the length: tokens are joined between marks, and the pair is replaced in the string.
    """
    mark = F.lit("\x01")
    text = F.concat(mark, F.array_join(tokens, "\x01\x01"), mark)
    merged = F.replace(text, F.concat(mark, w1, mark, mark, w2, mark), F.concat(mark, new, mark))
    return F.when(F.size(tokens) > 0, F.split(F.substring(merged, F.lit(2), F.length(merged) - 2), "\x01\x01")).otherwise(tokens)


def auto_ngram_count(vocab_size: Column, k: float = 0.5) -> Column:
    """max(10, floor(sqrt(V) k)) merges."""
    return F.greatest(F.lit(10), F.floor(F.sqrt(vocab_size) * k).cast("int"))


#: Merges after which the documents are rewritten and their pairs counted anew.
REWRITE_AFTER = 16


def _places(codes: np.ndarray, row: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where a, b follow each other within a row, from the left and without overlap."""
    at = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b) & (row[:-1] == row[1:]))
    if a == b and len(at):  # of a run every other place
        first = at[np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), np.arange(len(at)), 0))]
        at = at[(at - first) % 2 == 0]
    return at


def _merge_batch(tokens: pa.ListArray, merges: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes and rows of a batch's words after merges, and the names of the codes."""
    words = tokens.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    code = {w: i for i, w in enumerate(names)}
    codes, row = np.asarray(words.indices, dtype=np.int64), np.repeat(np.arange(len(tokens)), np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))
    for w1, w2 in merges:
        if w1 not in code or w2 not in code:
            continue
        at = _places(codes, row, code[w1], code[w2])
        if not len(at):
            continue
        new = f"{w1}_{w2}"
        if new not in code:
            code[new] = len(names)
            names.append(new)
        codes = codes.copy()
        codes[at] = code[new]
        keep = np.ones(len(codes), bool)
        keep[at + 1] = False
        codes, row = codes[keep], row[keep]
    return codes, row, names


def merged(docs: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Documents (doc_id, tokens) after merges, in their order, in one pass without a shuffle."""
    if not merges:
        return docs
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            codes, row, names = _merge_batch(tokens, merges)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(tokens)))).astype(np.int32)
            texts = pa.array(names, pa.string()).take(pa.array(codes))
            out = pa.ListArray.from_arrays(pa.array(ends), texts, mask=tokens.is_null() if tokens.null_count else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], names=["doc_id", "tokens"])

    return docs.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, tokens array<string>")


def _changes(docs: DataFrame, before: list[tuple[str, str]], merge: tuple[str, str]) -> DataFrame:
    """(w1, w2, n): by how much each pair's count changes with one more merge; the row of w2 NULL has the number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, row, names = _merge_batch(batch.column("tokens"), before)
            code = {w: i for i, w in enumerate(names)}
            if merge[0] not in code or merge[1] not in code:
                continue
            at = _places(codes, row, code[merge[0]], code[merge[1]])
            if not len(at):
                continue
            if (name := f"{merge[0]}_{merge[1]}") not in code:
                code[name] = len(names)
                names.append(name)

            def near(c, r, places):
                places = np.unique(places)
                places = places[(places >= 0) & (places < len(c) - 1)]
                places = places[r[places] == r[places + 1]]
                return c[places] * len(names) + c[places + 1]

            old = near(codes, row, np.concatenate([at - 1, at, at + 1]))
            after, keep = codes.copy(), np.ones(len(codes), bool)
            after[at], keep[at + 1] = code[name], False
            j = at - np.arange(len(at))
            new = near(after[keep], row[keep], np.concatenate([j - 1, j]))
            both, where = np.unique(np.concatenate([old, new]), return_inverse=True)
            n = np.bincount(where, np.repeat([-1.0, 1.0], [len(old), len(new)])).astype(np.int64)
            a, b = np.divmod(both[n != 0], len(names))
            table = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([table.take(pa.array(a)), pa.array([""])]), pa.concat_arrays([table.take(pa.array(b)), pa.array([None], pa.string())]), pa.array([*n[n != 0].tolist(), len(at)], pa.int64())], names=["w1", "w2", "n"])

    made = {f"{a}_{b}": (a, b) for a, b in before}  # names are made once: see fit_merges

    def holds(w: str) -> Column:
        own = F.array_contains("tokens", w)
        return own | (holds(made[w][0]) & holds(made[w][1])) if w in made else own

    found = docs.where(holds(merge[0]) & holds(merge[1])).select("tokens").mapInArrow(run, "w1 string, w2 string, n bigint")
    return checkpointed(found.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n <> 0"))


def row_pairs(docs: DataFrame) -> DataFrame:
    """(w1, w2, freq) of adjacent words of documents (doc_id, tokens), taken within their rows: only counts are shuffled."""
    n = F.size("tokens") - 1
    both = docs.where(F.size("tokens") > 1).select(F.explode(F.arrays_zip(F.slice("tokens", 1, n).alias("w1"), F.slice("tokens", 2, n).alias("w2"))).alias("p"))
    return both.groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("freq"))


def fit_merges(docs: DataFrame, merges: int, least: int = 2, method: str = "bpe", use_pmi: bool = False) -> tuple[DataFrame, list[tuple[int, str, str, int]]]:
    """Documents (doc_id, tokens) after up to `merges` merges, and (rank, w1, w2, freq) of each.

    Each round takes the best pair by frequency ("bpe"), PMI times log2(freq + 1), or likelihood ("wordpiece").
    Documents are written and their pairs counted once. Then a round only looks at documents that hold both words and
    gathers by how much the counts next to the merged places change. Pairs rarer than `least` are left out: a merge makes no old
    pair more frequent, unless its name is a word already; then, and after REWRITE_AFTER merges, documents are rewritten and counted anew.
    """
    done: list[tuple[int, str, str, int]] = []
    docs = checkpointed(docs.select("doc_id", "tokens"))
    scored = use_pmi or method == "wordpiece"
    todo: list[tuple[str, str]] = []
    base = None
    for rank in range(1, merges + 1):
        if base is None:
            size = docs.where(F.size("tokens") > 0).agg(F.sum(F.size("tokens")), F.sum(F.size("tokens") - 1)).first()
            n_tokens, n_pairs = size[0] or 0, size[1] or 0
            freq = checkpointed(token_frequency(docs.select(F.explode("tokens").alias("term"))))
            base = row_pairs(docs).where(F.col("freq") >= least)
            base, own, deltas = checkpointed(_with_parts(base, freq) if scored else base), {}, None
        pairs = base
        if deltas is not None:
            d = deltas.groupBy("w1", "w2").agg(F.sum("n").alias("n"))
            fresh = d.where(F.col("w1").isin(*made) | F.col("w2").isin(*made)).withColumnRenamed("n", "freq")
            pairs = base.join(d, ["w1", "w2"], "left").withColumn("freq", F.col("freq") + F.coalesce("n", F.lit(0))).drop("n")
            if scored:
                now = docs.sparkSession.createDataFrame(sorted(own.items()), "term string, freq bigint")
                table = F.create_map(*[F.lit(x) for kv in sorted(own.items()) for x in kv])
                for f, w in (("f1", "w1"), ("f2", "w2")):
                    pairs = pairs.withColumn(f, F.coalesce(F.try_element_at(table, F.col(w)), F.col(f)))
                fresh = _with_parts(fresh, freq.where(~F.col("term").isin(*own)).unionByName(now))
            pairs = pairs.unionByName(fresh)
        if method == "wordpiece":
            best = best_pair(_likelihood(pairs), F.round(F.col("score"), 12), least).first()
        elif use_pmi:
            best = best_pair(_pmi(pairs, F.lit(n_pairs), F.lit(n_tokens)), F.round(F.col("pmi") * F.log2(F.col("freq") + 1), 9), least).first()
        else:
            best = best_pair(pairs, "freq", least).first()
        if best is None:
            break
        done.append((rank, best.w1, best.w2, best.freq))
        name = f"{best.w1}_{best.w2}"
        if rank == merges:
            todo.append((best.w1, best.w2))
        elif name in own or len(todo) + 1 >= REWRITE_AFTER or not freq.where(F.col("term") == name).isEmpty():
            docs, todo, base = checkpointed(merged(docs, [*todo, (best.w1, best.w2)])), [], None
        else:
            change = _changes(docs, todo, (best.w1, best.w2))
            places = change.where("w2 IS NULL").first().n
            change = change.where("w2 IS NOT NULL")
            deltas = change if deltas is None else deltas.unionByName(change)
            known = {r.term: r.freq for r in freq.where(F.col("term").isin(best.w1, best.w2)).collect()} | own
            for w in (best.w1, best.w2):
                own[w] = known[w] = known[w] - places
            own[name] = places
            todo.append((best.w1, best.w2))
            made = [f"{a}_{b}" for a, b in todo]
            n_tokens, n_pairs = n_tokens - places, n_pairs - places
    return merged(docs, todo), done


def merge_names(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, name) of vocabulary entries and merges (new_id, a, b): parts joined by _, however deep.

    Iterates at most as often as merges nest; each round is one join with what has a name.
    """
    named = vocab.select(F.col("term_id").alias("id"), F.col("term").alias("name"))
    rest = merges.select("new_id", "a", "b")
    while not rest.isEmpty():
        a, b = named.select(F.col("id").alias("a"), F.col("name").alias("na")), named.select(F.col("id").alias("b"), F.col("name").alias("nb"))
        new = checkpointed(rest.join(a, "a").join(b, "b").select(F.col("new_id").alias("id"), F.concat_ws("_", "na", "nb").alias("name")))
        if new.isEmpty():
            break
        named = named.unionByName(new)
        rest = rest.join(new.select(F.col("id").alias("new_id")), "new_id", "left_anti")
    return named
