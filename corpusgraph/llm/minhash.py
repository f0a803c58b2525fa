"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

1. Shingles of five words; weight = occurrences in the document x idf (``sketch.idf``, 1 to 2).
2. Texts with the same word sequence are one *content*; only contents go on.
3. ``BANDS x ROWS`` consistent weighted samples per content (Ioffe's scheme: two contents draw the
   same sample with a probability equal to their weighted Jaccard similarity).
4. Contents that share a band meet in a bucket. Each is first compared with the bucket's smallest
   content, so a group of close copies costs one comparison a copy. Buckets that still hold two
   components are compared in full, in blocks (``blocks.tiled``) that emit no pairs. No bucket has a cap.
5. Every compared pair is verified by exact weighted Jaccard similarity on whole texts.

A pair at similarity s meets in a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.tables import written

from . import sketch
from .blocks import groups, stars, tiled
from .components import components
from .labelled import shielded
from .text import U64, gram_starts, grams, mix, sequence_hash, small, strings, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
_KEY_BITS = 50


@lru_cache(1)
def _tables():
    seeds = np.random.default_rng(77).integers(1, 2**63, BANDS * ROWS, dtype=U64)
    return seeds, np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def shingles(texts: pa.Array):
    """(document, shingle, occurrences) sorted by document and shingle, and the word sequence's hash.

    A text of one to four words has one shingle of all its words; one without words has none.
    """
    w = words(texts)
    at = gram_starts(w, SHINGLE)
    of, keys = w.text[at], grams(w.hash, SHINGLE)[at] if len(at) else np.zeros(0, U64)
    whole = sequence_hash(w)
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        of, keys = np.concatenate([of, short]), np.concatenate([keys, whole[short, 0]])
    packed = (of.astype(U64) << U64(_KEY_BITS)) | (keys >> U64(64 - _KEY_BITS))
    packed.sort()
    first = np.ones(len(packed), bool)
    np.not_equal(packed[1:], packed[:-1], out=first[1:])
    start = np.flatnonzero(first)
    unique = packed[start]
    return (unique >> U64(_KEY_BITS)).astype(np.int64), unique & U64((1 << _KEY_BITS) - 1), np.diff(np.append(start, len(packed))), whole, w.count > 0


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` consistent weighted samples of each segment of (keys, weights) that begins at ``starts``.

    For each hash function a shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its own hash;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the sample is (shingle, t) of the smallest a.
    """
    seeds, log_u = _tables()
    log_w = np.log(weights).astype(np.float32)
    out = np.empty((len(starts), len(seeds)), np.uint32)
    for k, seed in enumerate(seeds):
        x = mix(keys ^ seed)
        u = x.view(np.uint16).reshape(-1, 4)
        y = (x * U64(0x9FB21C651E98DF25)) >> U64(32)
        v = y.view(np.uint16).reshape(-1, 4)
        r = -(log_u.take(u[:, 0]) + log_u.take(u[:, 1]))
        log_c = np.log(-(log_u.take(v[:, 0]) + log_u.take(v[:, 1])))
        b = u[:, 2].astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + b)
        a = log_c - r * (t - b + 1) + np.float32(64)
        identity = (y ^ (t.astype(np.int64).view(U64) * U64(0x85EBCA6B))) & U64(0xFFFFFFFF)
        order = (a.view(np.uint32).astype(U64) << U64(32)) | identity
        out[:, k] = np.minimum.reduceat(order, starts).astype(np.uint32)
    return out


def bands(keys, weights, starts) -> np.ndarray:
    """One bucket number for each band of each segment."""
    drawn = samples(keys, weights, starts).astype(U64).reshape(-1, BANDS, ROWS)
    bucket = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[None, :], len(drawn), 0)
    for i in range(ROWS):
        bucket = mix(bucket * U64(0x9E3779B97F4A7C15) + drawn[:, :, i])
    return bucket.view(np.int64)


def _keys(whole: np.ndarray, some: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(whole).tobytes()
    return pa.array([raw[16 * i:16 * i + 16] if has else None for i, has in enumerate(some)], pa.binary())


def corpus_counts(docs: DataFrame):
    """Documents and shingle document counts over all texts."""
    def features(batch):
        for part in small([batch]):
            yield shingles(strings(part.column("text")))[1]
    return sketch.document_counts(docs.select("text"), features)


def signatures(docs: DataFrame, total: int, counts) -> DataFrame:
    """(doc_id, content, buckets) of each row; content is null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def sign(batches):
        for part in small(batches, limit=1 << 19):
            of, keys, tf, whole, some = shingles(strings(part.column("text")))
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            got = bands(keys, tf * sketch.idf(keys, total, shared.value), starts) if len(starts) else np.zeros((0, BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _keys(whole, some), pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.ravel()))], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, content binary, buckets array<long>")


def with_content(docs: DataFrame) -> DataFrame:
    """The rows with their content's key (null for a text without words) as column ``content``."""
    kept = docs.select(*docs.columns, F.lit(None).cast("binary").alias("content"))

    def add(batches):
        for part in small(batches):
            w = words(strings(part.column("text")))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _keys(sequence_hash(w), w.count > 0)], names=part.schema.names)
    return kept.mapInArrow(add, kept.schema)


def similarity(a: str, b: str, weigh) -> float:
    """Weighted Jaccard similarity of two texts; ``weigh``: shingles -> idf."""
    return float(_similarities(pa.array([a, b]), np.array([0]), np.array([1]), weigh)[0])


def _similarities(texts: pa.Array, left, right, weigh) -> np.ndarray:
    of, keys, tf, _, _ = shingles(strings(texts))
    weight = tf * weigh(keys)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    total = np.concatenate([[0], np.cumsum(weight)])
    out = np.zeros(len(left))
    for n, (i, j) in enumerate(zip(left, right)):
        a, b = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
        ka, kb = keys[a], keys[b]
        if not len(ka) or not len(kb):
            continue
        at = np.searchsorted(ka, kb)
        hit = ka.take(at, mode="clip") == kb
        both = np.minimum(weight[a].take(at[hit]), weight[b][hit]).sum()
        out[n] = both / (total[cut[i + 1]] - total[cut[i]] + total[cut[j + 1]] - total[cut[j]] - both)
    return out


def verified(pairs: DataFrame, texts: DataFrame, total: int, counts, threshold: float) -> DataFrame:
    """Those of ``pairs`` (u, v: contents) whose similarity reaches the threshold; ``texts``: content, text."""
    shared = pairs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    t = texts.select("content", "text")
    both = (pairs.join(t.withColumnsRenamed({"content": "v", "text": "text_v"}), "v")
            .join(t.withColumnsRenamed({"content": "u", "text": "text_u"}), "u").select("u", "v", "text_u", "text_v"))
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("similarity", pa.float64())])

    def check(batches):
        weigh = lambda keys: sketch.idf(keys, total, shared.value)
        for part in small(batches, "text_v"):
            u, v = part.column("u"), part.column("v")
            distinct = {k: i for i, k in enumerate(dict.fromkeys(u.to_pylist()))}
            place = np.array([distinct[k] for k in u.to_pylist()])
            firsts = np.unique(place, return_index=True)[1]
            texts = pa.concat_arrays([part.column("text_u").take(pa.array(firsts)), part.column("text_v")])
            got = _similarities(texts, place, np.arange(len(place)) + len(firsts), weigh)
            near = pa.array(got >= threshold)
            yield pa.RecordBatch.from_arrays([u.filter(near), v.filter(near), pa.array(got[got >= threshold])], schema=schema)
    return both.mapInArrow(check, "u binary, v binary, similarity double")


def compared(rows: DataFrame, texts: DataFrame, total: int, counts, threshold: float) -> DataFrame:
    """Links (u, v) within each block (bucket, lo, hi) of ``rows`` (v, root, tile), as stars.

    All contents of a block are compared at once: with a column for each k-th occurrence of a shingle
    that two of them have, the common weight of all pairs is one matrix product. Only links between
    different ``root``s are of interest; no pairs are emitted but a spanning star of each component.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
    keys = ["bucket", "lo", "hi"]

    def links(texts, roots, tiles, across):
        of, shingle, tf, _, _ = shingles(strings(texts))
        weight = sketch.idf(shingle, total, shared.value)
        sums = np.bincount(of, weight * tf, minlength=len(texts))
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        of, weight = np.repeat(of, tf), np.repeat(weight, tf)
        column = mix(np.repeat(shingle, tf) ^ mix(level.astype(U64)))
        _, first, place, times = np.unique(column, return_index=True, return_inverse=True, return_counts=True)
        common = np.flatnonzero(times > 1)
        number = np.full(len(times), -1)
        number[common] = np.arange(len(common))
        place, root_weight = number[place], np.sqrt(weight[first[common]])
        both = np.zeros((len(texts), len(texts)))
        for begin in range(0, len(common), 2048):
            some = (place >= begin) & (place < begin + 2048)
            x = np.zeros((len(texts), min(2048, len(common) - begin)))
            x[of[some], place[some] - begin] = root_weight[place[some]]
            both += x @ x.T
        near = both >= threshold * (sums[:, None] + sums[None, :] - both)
        near &= (sums > 0)[:, None] & (roots[:, None] != roots[None, :])
        if across:
            near &= tiles[:, None] != tiles[None, :]
        return stars(near)

    def check(batches):
        for table, cuts in groups(batches, keys):
            v = table.column("v").to_pylist()
            roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
            tiles = table.column("tile").to_numpy()
            split = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            texts = table.column("text")
            pairs = [(v[a + i], v[a + j]) for a, b in zip(cuts, cuts[1:])
                     for i, j in links(pa.concat_arrays(texts.slice(a, b - a).chunks), roots[a:b], tiles[a:b], split[a])]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], schema=schema)
    full = rows.join(texts.withColumnRenamed("content", "v"), "v").select(*keys, "v", "root", "tile", "text")
    return full.repartition(*keys).sortWithinPartitions(*keys, "v").mapInArrow(check, "u binary, v binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row for each: doc_id, content, class_id, kept.

    class_id is the smallest doc_id of all documents that are linked, directly or through others, by a
    similarity of ``threshold`` or more or by equal words (case and punctuation aside). ``kept`` marks the
    rows with that doc_id. A text without words (null, empty, punctuation) is a class of its own. Rows that
    repeat a doc_id are judged by their text. Other columns are ignored, an empty table gives no rows.
    """
    total, counts = corpus_counts(docs)
    signed = written(signatures(docs, total, counts), "signatures")
    contents = signed.where("content is not null").groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"))
    contents = written(contents, "contents")
    entries = contents.select(F.explode("buckets").alias("bucket"), F.col("content").alias("v"))
    heads = entries.groupBy("bucket").agg(F.min("v").alias("u"), F.count("*").alias("n")).where("n > 1")
    members = written(entries.join(heads.select("bucket", "u"), "bucket"), "members")

    tried = written(members.where("u != v").select("u", "v").distinct(), "pairs")
    needed = members.select(F.col("v").alias("content")).distinct().join(contents.select("content", "doc_id"), "content")
    rows = with_content(docs.select(F.col("doc_id").cast("long"), "text"))
    texts = (rows.join(needed.withColumnRenamed("doc_id", "least"), "content").where(F.col("doc_id").eqNullSafe(F.col("least")))
             .select("content", "text").dropDuplicates(["content"]))
    texts = written(texts, "texts")
    links = written(verified(tried, texts, total, counts, threshold).select("u", "v"), "links")
    found = components(links)

    placed = members.join(found.withColumnsRenamed({"node": "v"}), "v", "left").select(
        "bucket", "v", F.coalesce("root", "v").alias("root"))
    mixed = (placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("set"))
             .where("a != b").groupBy("set", "n").agg(F.min("bucket").alias("bucket")))
    mixed = written(mixed.select("bucket", "n"), "mixed")
    more = written(compared(tiled(placed.join(mixed.select("bucket"), "bucket"), mixed, "bucket", "v"), texts, total, counts, threshold), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    label = contents.select("content", "doc_id").join(found.withColumnRenamed("node", "content"), "content", "left")
    label = label.select("content", "doc_id", F.coalesce("root", "content").alias("root"))
    least = label.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    label = label.join(least, "root").select("content", "class_id")
    out = signed.select("doc_id", "content").join(label, "content", "left")
    return out.select("doc_id", "content", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: the one with the smallest doc_id (rows that repeat id and words stay once).

    All columns are kept; a text without words is kept as it is.
    """
    plain, restored = shielded(docs, ["doc_id", "text"])
    kept = classes(plain, threshold).where("kept and content is not null").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    rows = with_content(plain)
    one = rows.join(kept, (F.col("content") == F.col("_content")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "content"])
    return restored(one.unionByName(rows.where("content is null")))
