"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives element i a random permutation p_i of the m slots and values r_ij in [0,1);
slot s gets min over i of p_i^-1(s) + r_ij. The elements of one document share out the slots, which
lowers the variance below that of independent hashes. The minimum doesn't depend on the order in
which (i, j) are visited, so this goes rank by rank over all elements of many documents at
once and leaves a document as soon as its largest slot value is below the next rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, pick, restore, small, with_keys
from .textkernel import U64, Words, chunks, constants, lean, mix64, text_chunks

SLOTS = 160
ROWS_PER_BAND = 4
SHINGLE_WORDS = 3
THRESHOLD = 0.5
#: A pair is verified exactly if its estimate is at most this much below the threshold.
MARGIN = 0.15
#: Most members of a bucket, about, that one group of a task holds; larger buckets are cut into so many parts.
PART = 4096
#: Members of a bucket on each side of a tile, the unit in which a bucket's further pairs are verified.
TILE = 64
_GOLDEN = 0x9E3779B97F4A7C15


def superminhash(h: np.ndarray, off: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (documents x m, uint32: rank in the top 8 bits, then 24 random bits) of hashed sets.

    off delimits the elements of each document; repeated elements don't matter. Documents without
    elements get the largest value in every slot. m is at most 255.
    """
    if m > 255:
        raise ValueError("at most 255 slots")
    docs = len(off) - 1
    sig = np.full(docs * m, 0xFFFFFFFF, dtype=np.uint32)
    doc = np.repeat(np.arange(docs), np.diff(off))
    perm = None
    first = None
    for j in range(m):
        x = mix64(h + U64((j + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        value = (x >> U64(40)).astype(np.uint32) | np.uint32(j << 24)
        k = (((x & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64) + j
        if j == 0:
            slot = first = k
        else:
            rows = np.arange(len(h))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
                perm[rows, first] = 0
                perm[rows, 0] = first
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * m + slot, value)
        full = sig.reshape(docs, m).max(axis=1) < np.uint32(min((j + 1) << 24, 0xFFFFFFFF))
        stay = ~full[doc]
        if not stay.any():
            break
        if not stay.all():
            h, doc = h[stay], doc[stay]
            if perm is None:
                first = first[stay]
            else:
                perm = perm[stay]
    return sig.reshape(docs, m)


def shingles(w: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed k-word shingles of each text and their offsets; a text of fewer words is one shingle."""
    g, valid = w.ngrams(k)
    counts = np.diff(w.off)
    short = (counts > 0) & (counts < k)
    if short.any():
        at = w.off[:-1][short]
        g[at] = w.text_hash()[short]
        valid[at] = True
    return g[valid], np.concatenate([[0], np.cumsum(np.bincount(w.doc[valid], minlength=len(counts)))])


def _signatures(m: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_hash, out_sig, has = [], [], []
            for _, texts in text_chunks(batch.column("__text")):
                w = Words(texts)
                h, off = shingles(w, k)
                sig = superminhash(h, off, m)
                # 16 bits of each slot tell values apart well enough
                low = (mix64(sig.astype(U64)) >> U64(48)).astype(np.uint16)
                out_hash.append(w.text_hash(7).view(np.int64))
                out_sig += [s.tobytes() for s in low]
                has.append(np.diff(w.off) > 0)
            if not has:
                continue
            keep = np.concatenate(has)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__key"), batch.column("__doc"), pa.array(np.concatenate(out_hash)), pa.array(out_sig, pa.binary())],
                names=["id", "key", "doc", "content", "sig"],
            ).filter(pa.array(keep))

    return lean(run)


def _bands(m: int, r: int):
    coef = constants(r, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, m)
            n, b = len(sig), m // r
            x = (sig[:, : b * r].reshape(n, b, r).astype(U64) * coef).sum(axis=2, dtype=U64)
            band = mix64(mix64(x) + np.arange(b, dtype=U64) * U64(_GOLDEN)).view(np.int64)
            key = np.asarray(batch.column("key"))
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel()), pa.array(np.repeat(key, b))], names=["band", "key"])

    return run


def spanning_pairs(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that joins rows with at least that share of equal slots.

    Breadth-first: each row reached is compared with those not yet reached, so a bucket of n near
    copies costs about n comparisons, and no pair of components goes unseen.
    """
    rest = np.arange(len(sig))
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        at = queue.pop()
        if len(rest):
            near = (sig[rest] == sig[at]).mean(axis=1) >= least
            out += [(at, int(x)) for x in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return out


def _by_group(emit, *columns: str):
    """Arrow function that passes whole groups of rows to emit, as lists; rows come sorted by the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: tuple[list, ...] = tuple([] for _ in columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            for have, c in zip(hold, columns, strict=True):
                have.extend(batch.column(c).to_pylist())
            last = hold[0][-1]
            cut = len(hold[0])
            while cut and hold[0][cut - 1] == last:
                cut -= 1
            if cut:
                yield from emit(*[x[:cut] for x in hold])
                hold = tuple(x[cut:] for x in hold)
        if hold[0]:
            yield from emit(*hold)

    return lean(run)


def _cuts(group: np.ndarray) -> np.ndarray:
    """Where the groups of a sorted array start, and its length."""
    return np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])


def _propose(m: int, least: float):
    def emit(bucket: list, key: list, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        bucket, key = np.array(bucket), np.array(key)
        sig = np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(-1, m)
        cuts = _cuts(bucket)
        a, b = [], []
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        good = two[(sig[two] == sig[two + 1]).mean(axis=1) >= least]
        a.append(key[good])
        b.append(key[good + 1])
        for i in np.flatnonzero(sizes > 2):
            s = cuts[i]
            pairs = np.array(spanning_pairs(sig[s : cuts[i + 1]], least), dtype=np.int64).reshape(-1, 2)
            a.append(key[s + pairs[:, 0]])
            b.append(key[s + pairs[:, 1]])
        yield _edges(np.concatenate(a), np.concatenate(b))

    return _by_group(emit, "part", "key", "sig")


def _unjoined(m: int, least: float, tile: int):
    """Pairs of each group that the estimate admits and that no verified edges join yet, with the tile of each.

    A group holds one part of a bucket, of which all pairs are taken, or two, of which those across are.
    """

    def emit(group: list, side: list, key: list, label: list, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        group, side, key, label = np.array(group), np.array(side), np.array(key), np.array(label)
        sig = np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(-1, m)
        cuts = _cuts(group)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            middle = s + int(np.searchsorted(side[s:e], side[s], side="right"))
            first, second = ((s, e), (s, e)) if middle == e else ((s, middle), (middle, e))
            for i in range(*first, tile):
                for j in range(i if middle == e else second[0], second[1], tile):
                    x, y = slice(i, min(i + tile, first[1])), slice(j, min(j + tile, second[1]))
                    open_ = label[x, None] != label[None, y]
                    if not open_.any():
                        continue
                    open_ &= (sig[x, None] == sig[None, y]).mean(axis=2) >= least
                    a, b = np.nonzero(np.triu(open_, 1) if i == j else open_)
                    if not len(a):
                        continue
                    place = np.array([group[s], i - s, j - s], dtype=np.int64).view(U64)
                    name = mix64(mix64(place[:1] + place[1:2] * U64(_GOLDEN)) + place[2:] * U64(_GOLDEN)).view(np.int64)
                    pairs = _edges(key[i + a], key[j + b])
                    yield pa.RecordBatch.from_arrays([*pairs.columns, pa.array(np.repeat(name, len(a)))], names=["u", "v", "tile"])

    return _by_group(emit, "group", "side", "key", "label", "sig")


def _shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    out = []
    for _, part in chunks(texts):
        h, off = shingles(Words(part), k)
        out += [np.unique(h[off[i] : off[i + 1]]) for i in range(len(part))]
    return out


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) and both > 0


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _shingle_sets(batch.column("a").to_pylist(), k), _shingle_sets(batch.column("b").to_pylist(), k)
            keep = [_similar(x, y, threshold) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def _verify_tiles(k: int, threshold: float):
    """As _verify, for rows of a tile, key, text and the keys of the same tile to compare it with."""

    def emit(tile: list, key: list, text: list[str], others: list[list[int]]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(np.array(tile))
        sets = _shingle_sets(text, k)
        u, v = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            at = {key[i]: i for i in range(s, e)}
            for i in range(s, e):
                for o in others[i]:
                    if _similar(sets[i], sets[at[o]], threshold):
                        u.append(key[i])
                        v.append(o)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return _by_group(emit, "tile", "key", "text", "others")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, slots: int = SLOTS, rows_per_band: int = ROWS_PER_BAND, shingle_words: int = SHINGLE_WORDS, part: int = PART) -> DataFrame:
    """Documents that have near copies: key, id, doc (the table's own id), root (key of the one that stays), root_doc, size.

    Two documents are joined if the exact Jaccard similarity of their sets of shingle_words-word
    shingles is at least `threshold` and one band of their signatures agrees, unless the share of equal slots is more than
    MARGIN below it; groups are the connected components, and the member with the least id stays. Texts that agree in
    their words are joined whatever their length. NULL and empty texts, and those without a word,
    have no copies. Rows that agree in id and text are one document. Ids that aren't integral are ordered by their hash, NULL ids come
    last. Texts of any length are taken whole; equal estimates don't matter, as all pairs that are admitted count.
    Buckets of more than `part` members are cut into parts, first joined within each, then across.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base, names = with_keys(docs, id_col, text_col)
    base = base.select("__id", "__key", F.col(f"__p{names.index(id_col)}").alias("__doc"), "__text")
    kind = base.schema["__doc"].dataType.simpleString()
    sig = scratch.save(base.mapInArrow(_signatures(slots, shingle_words), f"id bigint, key bigint, doc {kind}, content bigint, sig binary"))
    # exact copies: all but the least of each content leave before banding
    firsts = sig.groupBy("content").agg(F.min(F.struct("id", "key")).alias("r"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("content", F.col("r.key").alias("v"))
    firsts = scratch.save(firsts)
    exact = scratch.save(sig.select("key", "content").join(small(firsts, 32), "content").where("key <> v").select(F.col("key").alias("u"), "v").distinct())
    reps = sig.join(small(exact.select(F.col("u").alias("key")), 24), "key", "left_anti")
    bands = reps.select("key", "sig").mapInArrow(_bands(slots, rows_per_band), "band bigint, key bigint")
    # bands that hold the same documents are one bucket; what they hold is compared by hashes, so no list of members is built
    marks = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    buckets = scratch.save(marks.where("lo <> hi").groupBy("n", "x", "y", "lo", "hi").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / part).alias("parts")))
    member = bands.join(small(buckets, 40), "band").select(F.col("band").alias("bucket"), "key", "parts", F.pmod(F.xxhash64("key", "band"), F.col("parts")).alias("side"))
    member = scratch.save(member.distinct())
    wanted = scratch.save(member.select("key").distinct())
    picked = scratch.save(sig.select("key", "sig").join(small(wanted, 24), "key", "left_semi").dropDuplicates(["key"]))

    def grouped(rows: DataFrame, *by: str) -> DataFrame:
        return rows.join(small(picked, 2 * slots + 40), "key").repartition(by[0]).sortWithinPartitions(*by, "key")

    of_part = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", "side")).alias("part")
    propose = _propose(slots, threshold - MARGIN)
    proposed = scratch.save(grouped(member.select(of_part, "key"), "part").select("part", "key", "sig").mapInArrow(propose, "u bigint, v bigint").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar by their texts."""
        ends = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())
        texts = base.select(F.col("__key").alias("key"), F.col("__text").alias("text")).join(small(ends, 24), "key", "left_semi").dropDuplicates(["key"])
        texts = scratch.save(texts)
        both = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("key").alias("v"), F.col("text").alias("b")), "v")
        out = scratch.save(both.select("u", "v", "a", "b").mapInArrow(_verify(shingle_words, threshold), "u bigint, v bigint"))
        scratch.drop(ends, texts)
        return out

    sure = verified(proposed)
    # a failed edge may have stood in for pairs of its bucket that the tree then left out
    failed = scratch.save(proposed.join(sure, ["u", "v"], "left_anti"))
    hot = not buckets.where("parts > 1").isEmpty()
    if hot or not failed.isEmpty():
        labels = components(sure, scratch).select(F.col("u").alias("key"), F.col("v").alias("label"))

        def labelled(rows: DataFrame) -> DataFrame:
            return rows.join(small(labels, 40), "key", "left").withColumn("label", F.coalesce("label", "key"))

        # buckets of several parts: the least member of each component stands for it, until the parts hold one component or none joins another
        while hot:
            leads = labelled(member.where("parts > 1")).groupBy("bucket", "label").agg(F.min("key").alias("key"))
            leads = scratch.save(leads.select("bucket", "key"))
            sizes = scratch.save(leads.groupBy("bucket").agg(F.ceil(F.count("*") / part).alias("parts"), F.count("*").alias("n")).where("n > 1"))
            leads = leads.join(small(sizes, 40), "bucket").withColumn("side", F.pmod(F.xxhash64("key", "bucket", "n"), F.col("parts")))
            tried = scratch.save(grouped(leads.select(of_part, "key"), "part").select("part", "key", "sig").mapInArrow(propose, "u bigint, v bigint").distinct().join(failed, ["u", "v"], "left_anti"))
            new = verified(tried)
            failed = scratch.save(failed.unionByName(tried.join(new, ["u", "v"], "left_anti")))
            if new.isEmpty():
                break
            sure = scratch.save(sure.unionByName(new))
            labels = components(sure, scratch).select(F.col("u").alias("key"), F.col("v").alias("label"))
        fails = scratch.save(failed.select(F.explode(F.array("u", "v")).alias("key")).distinct().withColumn("fails", F.lit(1)))
        rows = scratch.save(labelled(member).join(small(fails, 24), "key", "left"))
        torn = rows.groupBy("bucket", "parts").agg(F.count("*").alias("n"), F.count("fails").alias("bad"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi AND (parts > 1 OR n > 2 AND bad > 1)").select("bucket")
        again = rows.join(small(scratch.save(torn), 24), "bucket", "left_semi")
        # each part meets itself and every other one
        other = again.select("bucket", "side", "key", "label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
        group = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("group")
        again = grouped(other.select(group, "side", "key", "label"), "group", "side")
        more = again.select("group", "side", "key", "label", "sig").mapInArrow(_unjoined(slots, threshold - MARGIN, TILE), "u bigint, v bigint, tile bigint")
        more = scratch.save(more.groupBy("u", "v").agg(F.min("tile").alias("tile")).join(failed, ["u", "v"], "left_anti"))
        sides = more.select("tile", F.col("u").alias("key"), F.col("v").alias("other")).unionByName(more.select("tile", F.col("v").alias("key"), F.lit(None).cast("bigint").alias("other")))
        sides = scratch.save(sides.groupBy("tile", "key").agg(F.collect_list("other").alias("others")))
        needed = scratch.save(sides.select("key").distinct())
        bodies = scratch.save(base.select(F.col("__key").alias("key"), F.col("__text").alias("text")).join(small(needed, 24), "key", "left_semi").dropDuplicates(["key"]))
        tiles = sides.join(bodies, "key").repartition("tile").sortWithinPartitions("tile", "key")
        found = scratch.save(tiles.select("tile", "key", "text", "others").mapInArrow(_verify_tiles(shingle_words, threshold), "u bigint, v bigint"))
        scratch.drop(fails, rows, more, sides, needed, bodies)
        linked = components(exact.unionByName(sure).unionByName(found), scratch)
    else:
        linked = components(exact.unionByName(sure), scratch)
    scratch.drop(buckets, member, picked, proposed, wanted, failed)
    nodes = linked.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(linked.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
    ids = sig.select("id", "key", "doc").join(small(scratch.save(nodes), 40), "key").distinct()
    lead = ids.groupBy("root").agg(F.min(F.struct("id", "key", "doc")).alias("least"), F.count("*").alias("size"))
    out = ids.join(lead, "root").select("key", "id", "doc", F.col("least.key").alias("root"), F.col("least.doc").alias("root_doc"), "size")
    out = scratch.save(out)
    scratch.drop(sig, firsts, exact, sure)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Report: doc_id, group_id (least doc_id of its group), group_size, keep; one row per document that has near copies.

    See near_duplicate_groups for NULL, empty, very long and repeated rows. Ids are the table's own, of any type. Other columns don't matter.
    An empty table gives an empty report.
    """
    g = near_duplicate_groups(docs, id_col, text_col, **params)
    return g.select(F.col("doc").alias("doc_id"), F.col("root_doc").alias("group_id"), F.col("size").alias("group_size"), (F.col("key") == F.col("root")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs without near copies of an earlier document; all columns stay as they are.

    Of rows that agree in id and text one stays. Otherwise as near_duplicate_groups.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash-drop")
    gone = scratch.save(near_duplicate_groups(docs, id_col, text_col, **params).where("key <> root").select(F.col("key").alias("__key")))
    base, names = with_keys(docs, id_col, text_col)
    kept = base.join(small(gone, 24), "__key", "left_anti")
    again = scratch.save(pick_keys(base).groupBy("__key").count().where("count > 1").select("__key"))
    if not again.isEmpty():
        from pyspark.sql import Window

        twice = kept.join(small(again, 24), "__key", "left_semi")
        one = twice.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))).where("__n = 1").drop("__n")
        kept = kept.join(small(again, 24), "__key", "left_anti").unionByName(one)
    return restore(kept, names)


def pick_keys(base: DataFrame) -> DataFrame:
    return base.select("__key")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


