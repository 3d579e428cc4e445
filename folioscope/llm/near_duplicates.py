"""Groups and pairs of texts that are copies of each other up to small edits.

One-permutation hashing gives each set of word shingles a signature in one pass; empty bins are filled by
optimal densification. Bands of signature rows make buckets. Any two members of a bucket are compared on the
shingle sets themselves; of the members of large buckets, any two whose rarest shingles leave room for the
threshold. Those that have a link are compared once more by their rarest shingles, so members of one family that
never shared a bucket are found as well.

Equal texts are one class from the start: a class is sketched and compared once, however
many copies it has. Buckets that hold a large part of all classes are found on a sample and never made into
one list, so no task gets a whole hot bucket; the result is the same.

Null texts, null ids and texts of fewer than min_words words take no part. Repeated rows of one chunk_id
are one chunk (of differing texts the last crawl's). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import words
from folioscope.sources.staging import small_or_shuffled, stage, stage_by

WORD = r"\p{L}\p{N}"


@dataclass(frozen=True)
class Sketch:
    """threshold: least shared / all of two shingle sets. bands of rows bins each make the signature.

    bucket_pairs: members of a bucket up to which all its pairs are candidates as they are.
    """

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 1
    bands: int = 32
    rows: int = 6
    hot_share: float = 1 / 512
    hot_rows: int = 64_000
    hot_sample: int = 64
    salts: int = 32
    bucket_pairs: int = 64


#: The documents' own near-copy definition: three words, half of all shingles.
CHUNK_COPIES = Sketch(shingle=3, threshold=0.5, min_words=40, bands=48, rows=4)


def _shingles(said: Column, n: int) -> Column:
    """Distinct 32-bit hashes of n consecutive words; a shorter text is one shingle."""
    size = F.size(said)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1))),
        lambda i: F.hash(*[F.get(said, i - 1 + k) for k in range(n)]),
    )
    return F.array_distinct(grams)


def text_classes(chunks: DataFrame, sketch: Sketch) -> tuple[DataFrame, DataFrame]:
    """(key, cid), one row for each chunk, and staged (cid, grams), one row for each text with enough words.

    cid is a 64-bit hash of the text; copies meet before they are cut into words. The grams are by far the largest
    table and are joined by cid again and again: they are staged by it.
    """
    rows = chunks.where("text is not null and chunk_id is not null")
    rows = rows.select(F.col("chunk_id").alias("key"), "crawled_at", F.xxhash64("text").alias("cid"), "text")
    texts = rows.groupBy("cid").agg(F.any_value("text").alias("text")).select("cid", words(F.col("text"), WORD).alias("said"))
    texts = texts.where(F.size("said") >= sketch.min_words)
    classes = stage_by(texts.select("cid", _shingles(F.col("said"), sketch.shingle).alias("grams")), "cid", "classes")
    return rows.groupBy("key").agg(F.max(F.struct("crawled_at", "cid")).alias("last")).select("key", "last.cid"), classes


def _bins(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), (mixed >> np.uint64(32)).astype(np.uint32)


def signatures(values: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """One-permutation minhashes of many sets at once, densified: an empty bin asks bins in an order that
    depends on its own number alone until it meets a full one, and takes that one's value."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    b, v = _bins(values, k)
    none = np.uint64(1) << np.uint64(40)
    sig = np.full(n * k, none, np.uint64)
    np.minimum.at(sig, owner * k + b, v.astype(np.uint64))
    sig = sig.reshape(n, k)
    full = sig != none
    out = sig.copy()
    todo_r, todo_c = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 1
    while len(todo_r):
        ask, _ = _bins((todo_c + attempt * 1_000_003).astype(np.uint32), k)
        hit = full[todo_r, ask]
        out[todo_r[hit], todo_c[hit]] = sig[todo_r[hit], ask[hit]]
        todo_r, todo_c, attempt = todo_r[~hit], todo_c[~hit], attempt + 1
    return out


def _band_keys(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column(1)
        flat = grams.flatten().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False))])
        sig = signatures(flat.astype(np.uint32), offsets, bands * rows).reshape(-1, bands, rows)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2]).copy()
        for r in range(rows):
            key = (key ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        # 44 bits are shuffled cheaper than 64; buckets that meet by chance only add candidates.
        key >>= np.uint64(20)
        cid = np.repeat(batch.column(0).to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(cid)], names=["bucket", "cid"])


def band_rows(classes: DataFrame, sketch: Sketch) -> DataFrame:
    bands, rows = sketch.bands, sketch.rows
    return classes.select("cid", "grams").mapInArrow(lambda it: _band_keys(it, bands, rows), "bucket long, cid long")


def candidate_links(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """a < b: every two members of a bucket of at most bucket_pairs, and of the members of larger buckets every
    two whose shingles leave room for the threshold."""
    buckets = band_rows(classes, sketch)
    sampled = band_rows(classes.where(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(sketch.hot_sample)) == 0), sketch)
    least = max(sketch.hot_rows, sketch.hot_share * classes.count()) / sketch.hot_sample
    # At most bands / hot_share rows, whatever the input.
    hot = [r[0] for r in sampled.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()]
    cold = buckets.where(~F.col("bucket").isin(hot)) if hot else buckets
    # A bucket that is not hot is short enough for one list.
    lists = cold.groupBy("bucket").agg(F.sort_array(F.collect_list("cid")).alias("m")).where("size(m) > 1").select("m")
    lists = stage(lists.distinct(), "buckets")
    firsts = lists.where(F.size("m") <= sketch.bucket_pairs).select("m", F.posexplode("m").alias("i", "a"))
    near = firsts.select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    crowd = lists.where(F.size("m") > sketch.bucket_pairs).select(F.explode("m").alias("cid"))
    if hot:
        crowd = crowd.unionByName(buckets.where(F.col("bucket").isin(hot)).select("cid"))
    crowd = stage(crowd.distinct().join(classes, "cid"), "crowd")
    return near.unionByName(prefix_links(crowd, sketch)).distinct()


def prefix_links(crowd: DataFrame, sketch: Sketch) -> DataFrame:
    """a < b: every two of the crowd that can reach the threshold, by their rarest shingles (none is missed).

    With all shingles in one order, two sets that share enough have their first common shingle early in both:
    so early that what follows it still suffices. Text that a crowd has in common comes last in that order.
    """
    t = sketch.threshold
    grams = crowd.select("cid", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    # A shingle of one text alone takes a place, before all others, but meets nothing.
    often = grams.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    mine = Window.partitionBy("cid")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("held", "gram"))
    placed = grams.join(often, "gram").withColumn("pos", place)
    placed = stage(placed.where(F.col("pos") <= F.col("n") * (1 - t) + 1 + 1e-6), "prefixes")
    spread = F.when(F.col("held") > sketch.hot_rows / sketch.salts, F.lit(sketch.salts)).otherwise(F.lit(1))
    y = placed.select("gram", F.pmod("cid", spread).alias("salt"), F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    x = placed.where(F.col("pos") <= F.col("n") * (1 - 2 * t / (1 + t)) + 1 + 1e-6)
    x = x.select("gram", F.explode(F.sequence(F.lit(0).cast("long"), spread.cast("long") - 1)).alias("salt"), F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    both = x.join(y, ["gram", "salt"]).where("nx < ny or (nx = ny and x < y)").where(F.col("nx") >= t * F.col("ny") - 1e-6)
    room = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    both = both.where(room >= t / (1 + t) * (F.col("nx") + F.col("ny")) - 1e-6)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def verified(links: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The links a, b whose shingle sets have shared / all >= threshold."""
    left = links.join(classes.select(F.col("cid").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = left.join(classes.select(F.col("cid").alias("b"), F.col("grams").alias("grams_b")), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.where(shared >= threshold * (F.size("grams_a") + F.size("grams_b") - shared)).select("a", "b")


def class_links(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """Every verified link a < b between different classes.

    Members of one family that never shared a bucket are found among the classes that have a link, by their rarest
    shingles: no class is paired with another because both are linked to a third, so a centre of many links makes no
    more pairs than its neighbours have in common text.
    """
    candidates = small_or_shuffled(stage(candidate_links(classes, sketch), "candidates"))
    tried = stage(verified(candidates, classes, sketch.threshold), "tried")
    ends = tried.select(F.col("a").alias("cid")).unionByName(tried.select(F.col("b").alias("cid"))).distinct()
    linked = stage(classes.join(ends, "cid", "left_semi"), "linked")
    fresh = prefix_links(linked, sketch).distinct().join(tried, ["a", "b"], "left_anti")
    return tried.unionByName(verified(small_or_shuffled(stage(fresh, "fresh")), classes, sketch.threshold))


def _linked(chunks: DataFrame, sketch: Sketch) -> tuple[DataFrame, DataFrame]:
    """Staged members (key, cid) of all chunks whose text takes part, and staged links a < b between classes."""
    chunks = chunks.select("chunk_id", "text", "crawled_at")
    members, classes = text_classes(chunks, sketch)
    members = stage(members.join(classes.select("cid"), "cid", "left_semi"), "members")
    return members, stage(class_links(classes, sketch), "links")


def near_duplicate_pairs(chunks: DataFrame, sketch: Sketch = CHUNK_COPIES) -> DataFrame:
    """chunk_a < chunk_b of every pair of chunks whose shingle sets are similar enough, copies included."""
    m, links = _linked(chunks, sketch)
    across = (
        links.join(m.select(F.col("cid").alias("a"), F.col("key").alias("key_a")), "a")
        .join(m.select(F.col("cid").alias("b"), F.col("key").alias("key_b")), "b")
        .select(F.least("key_a", "key_b").alias("chunk_a"), F.greatest("key_a", "key_b").alias("chunk_b"))
    )
    copies = m.select("cid", F.col("key").alias("chunk_a")).join(m.select("cid", F.col("key").alias("chunk_b")), "cid")
    return across.unionByName(copies.where("chunk_a < chunk_b").select("chunk_a", "chunk_b"))


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root of every node in links (a, b): alternating large and small stars until nothing moves.

    Each round is staged in the shared folder; only one number a round comes to the driver.
    """
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        fresh = stage(small.where("u <> v").distinct(), "cc")
        moved = fresh.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(fresh, ["u", "v"], "left_anti").limit(1).count()
        edges = fresh
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicate_groups(chunks: DataFrame, sketch: Sketch = CHUNK_COPIES) -> DataFrame:
    """chunk_id, group_id, n_links of every chunk that takes part.

    group_id is the smallest class of a family of linked texts; n_links counts the other texts a chunk's own
    text is linked to. Copies share a class, so they are never expanded into pairs.
    """
    members, links = _linked(chunks, sketch)
    ends = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid")))
    counts = ends.groupBy("cid").agg(F.count("*").alias("n_links"))
    roots = components(links).withColumnRenamed("node", "cid")
    return members.join(counts.join(roots, "cid"), "cid", "left").select(
        F.col("key").alias("chunk_id"), F.coalesce("root", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
