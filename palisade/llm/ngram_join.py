"""N-gram Jaccard join by MinHash banding, with verification on full n-gram sets.

1. One pass over the texts gives each its word n-gram set as 64-bit hashes, reduced to band hashes and a 128-bit key of the text.
   Texts with equal words form one class; from here on only classes travel, so exact copies are never compared.
2. Classes meet in the bands (a shuffle on band hashes). A band's bucket yields a star around its smallest class, not pairs;
   every candidate pair lies in a component of the stars. A component is one group; one of more than a block whose buckets hold
   fewer pairs than it has in all, such as a chain of neighbours, is compared bucket by bucket instead.
3. Only the texts of groups are read again, for their full sets. A group is cut into blocks by set size; pairs of blocks whose
   sizes allow the threshold are single tasks of bounded size. A task compares all pairs of its two blocks exactly: n-grams
   that many members hold are counted by a matrix product, the others along their posting lists.
4. Tasks return the number of links of each class and the edges of a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import components, free_names, release_memory, small_arrow_batches, stored, text_key

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.995
MAX_HASHES = 128
BLOCK = 1024
WORD = re.compile(r"\w+")
#: Words whose hashes a task remembers, about 30 MB of them; it forgets them when it ends.
MEMO_WORDS = 160_000
_MEMO: dict[str, int] = {}


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that finds a pair at the threshold with this probability."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches this recall")


def _word_hashes(text: str) -> np.ndarray:
    import xxhash

    words = WORD.findall(text.lower())
    memo = _MEMO
    try:
        return np.fromiter((memo[w] for w in words), np.uint64, len(words))
    except KeyError:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str, words: int = WORDS) -> tuple[np.ndarray, bytes]:
    """Sorted distinct hashes of the word n-grams, and a key of the word sequence. Shorter texts are one n-gram; no words, none."""
    import xxhash

    h = _word_hashes(text)
    key = xxhash.xxh128_digest(h.tobytes())
    if not len(h):
        return h, key
    size = min(words, len(h))
    grams = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(grams), key


def band_hashes(grams: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band of the MinHash signature."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048, None] * a + b).min(axis=0), out=least)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def _keyed(documents: DataFrame) -> DataFrame:
    key = text_key("text")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key["a"].alias("ta"), key["b"].alias("tb"))


def signatures(documents: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, ta, tb, ka, kb, n, bands array<long>) of (doc_id, text): keys of the text and of its words, set size, band hashes."""
    small_arrow_batches(documents.sparkSession, "8m")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        a, b = _multipliers(bands * rows)
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in batch.column(1):
                grams, key = ngrams(text.as_py() or "", words)
                keys.append(key)
                sizes.append(len(grams))
                hashes.append(band_hashes(grams, bands, rows, a, b) if len(grams) else None)
            ab = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "ta", "tb", "ka", "kb", "n", "bands"])
        _MEMO.clear()

    return _keyed(documents).mapInArrow(sign, "doc_id long, ta long, tb long, ka long, kb long, n long, bands array<long>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: frequent elements by a product, rare ones along posting lists."""
    out = np.zeros((len(left), len(right)), np.float32)
    sets = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    shared = np.intersect1d(np.unique(sets[0]), np.unique(sets[1]), assume_unique=True)
    if not len(shared):
        return out
    index = []
    for s, r in zip(sets, rows):
        at = np.searchsorted(shared, s)
        at[at == len(shared)] = 0
        hit = shared[at] == s
        index.append((at[hit], r[hit]))
    counts = [np.bincount(i, minlength=len(shared)) for i, _ in index]
    frequent = np.flatnonzero((counts[0] > 8) & (counts[1] > 8))
    place = np.full(len(shared), -1)
    for at in range(0, len(frequent), 4096):
        part = frequent[at : at + 4096]
        place[:] = -1
        place[part] = np.arange(len(part))
        dense = []
        for (i, r), n in zip(index, (len(left), len(right))):
            m = np.zeros((n, len(part)), np.float32)
            ok = place[i] >= 0
            m[r[ok], place[i[ok]]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    rare = np.ones(len(shared), bool)
    rare[frequent] = False
    lists = []
    for i, r in index:
        ok = rare[i]
        order = np.argsort(i[ok], kind="stable")
        lists.append((i[ok][order], r[ok][order]))
    starts = [np.searchsorted(l[0], np.arange(len(shared) + 1)) for l in lists]
    # Each left entry meets every right entry of its element.
    li, lr = lists[0]
    n = starts[1][li + 1] - starts[1][li]
    if n.sum():
        step = 2_000_000
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]), step):
            a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, min(lo + step, int(ends[-1])), "left") + 1
            own = n[a:b]
            inner = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            flat = np.repeat(ends[a:b] - own, own) + inner
            ok = (flat >= lo) & (flat < lo + step)
            rr = lists[1][1][(np.repeat(starts[1][li[a:b]], own) + inner)[ok]]
            np.add.at(out, (np.repeat(lr[a:b], own)[ok], rr), 1)
    return out


def met_before(hit: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The pairs of `hit` that share a hash at the same place: an earlier band has them in one bucket."""
    one, two = np.nonzero(hit)
    again = np.zeros(len(one), bool)
    for a, b in zip(np.array(left).T, np.array(right).T):
        again |= a[one] == b[two]
    out = np.zeros_like(hit)
    out[one[again], two[again]] = True
    return out


def compare_blocks(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity, exactly."""
    common = _overlaps(left, right).astype(np.float64)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return (common > 0) & (common >= threshold * (sizes - common) - 1e-9)


def _stars(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """Edges (a, b) from each node to the smallest one it reaches in this block pair: the links' components, never the links."""
    low, high = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_low = np.minimum(low, np.where(hit, high[None, :], top).min(axis=1, initial=top))
        new_high = np.minimum(high, np.where(hit, new_low[:, None], top).min(axis=0, initial=top))
        if (new_low == low).all() and (new_high == high).all():
            break
        low, high = new_low, new_high
    edges = pd.DataFrame({"a": np.concatenate([left, right]), "b": np.concatenate([low, high])})
    return edges[edges["a"] != edges["b"]].drop_duplicates()


def comparison_groups(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component, band, hash, rep, copies, n, earlier) of (c, rep, copies, n, bands): within which groups classes are compared.

    A group is a component of the candidates (band -1), or one bucket of a component that has more than `block` classes and whose
    buckets hold fewer pairs than all its classes make. A pair may meet in several buckets; `earlier` holds a class's hashes of
    the bands before the bucket's, so that only the first one counts it.
    """
    banded = classes.select("c", F.posexplode("bands").alias("band", "hash"))
    stars = stored(banded.groupBy("band", "hash").agg(F.min("c").alias("m"), F.count("*").alias("k")).where("k > 1"), "stars")
    candidates = stored(banded.join(stars, ["band", "hash"]).where("c != m").select(F.col("m").alias("a"), F.col("c").alias("b")).distinct(), "candidates")
    groups = components(candidates)
    size = groups.groupBy("component").agg(F.count("*").cast("double").alias("size")).where(F.col("size") > block)
    pairs = stars.join(groups.withColumnRenamed("node", "m"), "m").groupBy("component").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("pairs"))
    loose = stored(size.join(pairs, "component").where("pairs < size * size").select("component"), "loose")
    nodes = stored(groups.join(classes.withColumnRenamed("c", "node"), "node"), "groups")
    none = F.lit(None).cast("array<bigint>")
    whole = nodes.join(loose, "component", "left_anti").select("node", "component", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), "rep", "copies", "n", none.alias("earlier"))
    spread = nodes.join(loose, "component").select("*", F.posexplode("bands").alias("band", "hash")).join(stars.select("band", "hash"), ["band", "hash"])
    return whole.unionByName(spread.select("node", "component", "band", "hash", "rep", "copies", "n", F.slice("bands", F.lit(1), F.col("band")).alias("earlier")))


def ngram_join(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, ta, tb, class_id, n_links, kept) of every row of (doc_id, text).

    class_id is the smallest doc_id that links reach, n_links the number of other rows linked directly (Jaccard similarity of
    lower-cased word n-gram sets of at least `threshold`; copies count each), kept whether the row stands for its class: it has
    the smallest (doc_id, ta, tb), where ta, tb are a key of the text. Texts of fewer words than an n-gram are one n-gram. Texts
    without words, null texts and rows with a null doc_id link with nothing, are kept, and have themselves as class. Repeated rows
    are copies of each other and share kept. An empty table stays empty. A pair at the threshold is found with the probability
    `recall`, a closer one with a higher one; inside groups of up to `block` classes all pairs are compared.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = stored(signatures(documents, words, bands, rows), "signatures")
    able = signed.where("n > 0 and doc_id is not null")
    classes = stored(able.groupBy("ka", "kb").agg(F.min(F.struct("doc_id", "ta", "tb")).alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.first("bands").alias("bands")), "classes")
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    members = stored(comparison_groups(classes, block), "members")
    group = ["component", "band", "hash"]

    # Blocks of a group by set size. Ranks inside a group come from counts by size, so a large group is never sorted in one task.
    sizes = members.groupBy(*group, "n").agg(F.count("*").alias("k"))
    before = Window.partitionBy(*group).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "n", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"), "k")
    pieces = members.join(starts, [*group, "n"]).withColumn("within", F.pmod(F.xxhash64("node"), F.greatest(F.ceil(F.col("k") / block), F.lit(1))).cast("long"))
    pieces = pieces.withColumn("blk", F.struct(F.floor(F.col("first") / block).alias("x"), F.when(F.col("k") > block, F.col("n")).otherwise(F.lit(0)).alias("y"), F.when(F.col("k") > block, F.col("within")).otherwise(F.lit(0)).alias("z")))
    placed = stored(pieces.select(*group, "node", "rep", "copies", "n", "blk", "earlier"), "placed")
    ranges = placed.groupBy(*group, "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, two = ranges.select(*group, F.col("blk").alias("l"), F.col("lo").alias("llo"), F.col("hi").alias("lhi")), ranges.select(*group, F.col("blk").alias("r"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    fits = (F.col("l") <= F.col("r")) & (F.col("rhi") >= threshold * F.col("llo") - 1e-9) & (F.col("lhi") >= threshold * F.col("rlo") - 1e-9)
    tasks = stored(one.join(two, group).where(fits).select(*group, "l", "r").withColumn("task", F.monotonically_increasing_id()), "tasks")
    sides = tasks.select(*group, F.col("l").alias("blk"), "task", F.lit(0).alias("side")).union(tasks.where("l != r").select(*group, "r", "task", F.lit(1)))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(text.as_py() or "", words)[0].tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])
        _MEMO.clear()

    wanted = placed.select("rep.doc_id", "rep.ta", "rep.tb", "node").distinct()
    # A merge join at every size: what is wanted grows with the corpus, so it is never sent to all tasks.
    texts = _keyed(documents).join(wanted.hint("merge"), ["doc_id", "ta", "tb"]).select("text", "node")
    sets = stored(texts.mapInArrow(full_sets, "node long, grams binary").dropDuplicates(["node"]), "sets")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        part = [frame[frame["side"] == s] for s in (0, 1)]
        left = [np.frombuffer(g, np.uint64) for g in part[0]["grams"]]
        met = frame["band"].iat[0] > 0
        ids, copies = part[0]["node"].to_numpy(), part[0]["copies"].to_numpy()
        if len(part[1]):
            right, rids, rcopies = [np.frombuffer(g, np.uint64) for g in part[1]["grams"]], part[1]["node"].to_numpy(), part[1]["copies"].to_numpy()
            hit = compare_blocks(left, right, threshold)
            if met:
                hit &= ~met_before(hit, list(part[0]["earlier"]), list(part[1]["earlier"]))
            n = [pd.DataFrame({"a": ids, "n": hit @ rcopies}), pd.DataFrame({"a": rids, "n": hit.T @ copies})]
            edges = _stars(hit, ids, rids)
        else:
            hit = compare_blocks(left, left, threshold)
            np.fill_diagonal(hit, False)
            if met:
                hit &= ~met_before(hit, list(part[0]["earlier"]), list(part[0]["earlier"]))
            n = [pd.DataFrame({"a": ids, "n": hit @ copies})]
            edges = _stars(hit, ids, ids)
        n = [x[x["n"] > 0].assign(b=-1) for x in n]
        return pd.concat([*n, edges.assign(n=0)])[["a", "b", "n"]].astype("int64")

    blocks = placed.join(sides, [*group, "blk"]).select("task", "side", "node", "copies", "band", "earlier").join(sets, "node")
    found = stored(blocks.groupBy("task").applyInPandas(verify, "a long, b long, n long"), "found")
    links = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.where("b >= 0"))
    by_class = classes.select("c", "ka", "kb", "rep", "copies").join(joined.withColumnRenamed("node", "c"), "c", "left").join(links.withColumnRenamed("a", "c"), "c", "left")
    by_class = by_class.withColumn("component", F.coalesce("component", "c"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("least"))
    by_class = by_class.join(least, "component").select("ka", "kb", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = signed.select("doc_id", "ta", "tb", "ka", "kb", "n").join(by_class, ["ka", "kb"], "left")
    return out.select(
        "doc_id",
        "ta",
        "tb",
        F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        (~linked | (F.struct("doc_id", "ta", "tb") == F.col("least"))).alias("kept"),
    )


def drop_near_copies(documents: DataFrame, **options: float) -> DataFrame:
    """documents without near copies: of each class one row stays, the one with the smallest doc_id; of repeated rows one.

    Rows with a null doc_id and rows without words all stay. Columns are those of documents; a row whose class another one stands
    for is found by doc_id and text.
    """
    ta, tb = free_names(documents.columns, "_ta", "_tb")
    gone = ngram_join(documents.select("doc_id", "text"), **options).where("not kept").select("doc_id", F.col("ta").alias(ta), F.col("tb").alias(tb)).distinct()
    key = text_key("text")
    left = documents.withColumns({ta: key["a"], tb: key["b"]}).join(gone.hint("merge"), ["doc_id", ta, tb], "left_anti")
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\w")
    once = left.where(worded).dropDuplicates(["doc_id", ta, tb])
    return once.unionByName(left.where(~worded)).select(*documents.columns)
