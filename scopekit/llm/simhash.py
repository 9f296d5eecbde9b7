"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 values of the
text's word shingles. Two fingerprints at distance 2r or less have a value in common among
those within r bits of each, so every distinct fingerprint emits all of its variants within r, the variants
are shuffled, and fingerprints that meet on a variant are linked after their distance is verified.

What is shuffled: a variant's bucket is its first KEY_BITS bits. A fingerprint is sent once to each
bucket that its ball reaches, and its variants of that bucket are made there, so the shuffle holds 79
entries for each fingerprint instead of 2,081. Buckets around crowded values are split by a hash of the
variant, and each bucket is worked off in slices of at most SLICE variants. All fingerprints
that meet on a variant are within 2r of each other, so a chain to the smallest of them keeps
every connection without making all pairs; copies of a fingerprint are one node.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; a component without any document id has a null id; repeated rows get a row each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, packed, slices, text_bytes, written
from scopekit.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
KEY_BITS, MOST_KEY_BITS = 12, 20   # 4,096 buckets; more for more than about 4 million fingerprints
BUCKET_VARIANTS = 1 << 21
SLICE = 1 << 21


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    from xxhash import xxh64_intdigest as h
    parts = text.lower().split()   # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [h(line, SEED)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))[:len(parts) - words + 1].tolist()
    return [h(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]


def fingerprints_of(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    todo: list[int] = []
    counts: list[int] = []
    rows: list[int] = []

    def flush():
        if not rows:
            return
        values = np.array(todo, np.uint64)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        ones = np.add.reduceat(np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"),
                               starts, axis=0, dtype=np.int32)
        bits = 2 * ones > np.array(counts)[:, None]
        out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        todo.clear(), counts.clear(), rows.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, words)
        if hashes:
            todo.extend(hashes)
            counts.append(len(hashes))
            rows.append(i)
        if len(todo) >= 100_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long; text_hash tells rows of one id apart."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                fp = fingerprints_of(text_bytes(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fp.view(np.int64))],
                                                 names=["doc_id", "text_hash", "fp"])
    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                                   text.alias("text")), run, "doc_id bigint, text_hash bigint, fp bigint")


def _masks(bits: int, flips: int) -> list[np.ndarray]:
    """For d = 0..flips: all values with at most flips - d of the lowest bits set."""
    out = []
    for d in range(flips + 1):
        ms = [sum(1 << b for b in c) for k in range(flips - d + 1) for c in combinations(range(bits), k)]
        out.append(np.array(ms, np.uint64))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest connected index of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def _variant_slice(variants: np.ndarray, parts: int) -> np.ndarray:
    return ((variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def _links(fps: np.ndarray, key: int, part: int, parts: int, key_bits: int, flips: int, masks) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that meet on a variant of this bucket (and part): a forest."""
    fps = np.unique(fps)
    shift = np.uint64(64 - key_bits)
    own = fps >> shift
    away = np.bitwise_count(own ^ np.uint64(key)).astype(np.int64)
    base = (fps & np.uint64((1 << (64 - key_bits)) - 1)) | (np.uint64(key) << shift)
    total = sum(int((away == d).sum()) * len(masks[d]) for d in range(flips + 1))
    finer = max(1, -(-total // (parts * SLICE)))
    left, right = [], []
    for cut in range(part, parts * finer, parts):
        values, index = [], []
        for d in range(flips + 1):
            rows = np.flatnonzero(away == d)
            step = max(1, SLICE // len(masks[d]))
            for i in range(0, len(rows), step):
                some = rows[i:i + step]
                v = (base[some, None] ^ masks[d][None, :]).ravel()
                r = np.repeat(some, len(masks[d]))
                if parts * finer > 1:
                    mine = _variant_slice(v, parts * finer) == cut
                    v, r = v[mine], r[mine]
                values.append(v)
                index.append(r)
        v, r = np.concatenate(values), np.concatenate(index)
        ordered = np.sort(v)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        met = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v)
        met = met[np.lexsort((r[met], v[met]))]
        v, r = v[met], r[met]
        first = np.ones(len(v), bool)
        first[1:] = v[1:] != v[:-1]
        lowest = r[np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))]
        pairs = np.unique((lowest[~first] * len(fps) + r[~first]))
        a, b = pairs // len(fps), pairs % len(fps)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * flips
        left.append(a[near])
        right.append(b[near])
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = _roots(len(fps), a, b)
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[child]], fps[child]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between fingerprints (column fp, distinct) that connect all those within max_bits of each other."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: half of it is the ball's radius")
    flips = max_bits // 2
    n = distinct.count()
    ball = sum(len(list(combinations(range(64), k))) for k in range(flips + 1))
    key_bits = max(KEY_BITS, min(MOST_KEY_BITS, (n * ball // BUCKET_VARIANTS).bit_length()))
    # crowded buckets hold over 8 times the mean, so there are at most 2^key_bits / 8 of them
    crowd = max(2 * BUCKET_VARIANTS // ball, 8 * n >> key_bits)
    parts_of = {r["k"]: -(-r["n"] * ball // BUCKET_VARIANTS) for r in
                distinct.groupBy(F.shiftrightunsigned("fp", 64 - key_bits).alias("k")).agg(F.count("*").alias("n"))
                .where(F.col("n") > crowd).collect()}

    def deal(batches):
        masks = _masks(key_bits, flips)[0]
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            keys = ((fps >> np.uint64(64 - key_bits))[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], fps[order // len(masks)]
            at = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
            out = []
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
                key, blob = int(keys[s]), owner[s:e].tobytes()
                out += [(key, p, blob) for p in range(parts_of.get(key, 1))]
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out[i:i + 10_000]), (pa.int64(), pa.int32(), pa.binary()))], names=["key", "part", "fps"])

    def meet(batches):
        masks = _masks(64 - key_bits, flips)
        now, blobs = None, []

        def done():
            key, part = now
            parts = parts_of.get(key, 1)
            a, b = _links(np.frombuffer(b"".join(blobs), np.uint64), key, part, parts, key_bits, flips, masks)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for key, part, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "fps"))):
                if now != (key, part):
                    if now:
                        yield from done()
                    now, blobs = (key, part), []
                blobs.append(blob)
        if now:
            yield from done()

    dealt = map_batches(distinct.select("fp"), deal, "key bigint, part int, fps binary")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return map_batches(dealt, meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) per row: component is the smallest fingerprint
    reachable, component_id the smallest document id reachable over links of max_bits or fewer."""
    fps = written(fingerprints(docs, words), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(links(nodes, max_bits))
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "component").select("fp", "component", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays, with all its columns: that of the smallest id (a row
    without id only where no row has one; of repeated rows, one)."""
    found = near_duplicates(docs, words, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("s")
    keep = written(found.groupBy("component").agg(first).select(F.col("s.doc_id").alias("keep_id"), F.col("s.text_hash").alias("keep_hash")), "kept")
    rows = packed(docs).withColumns({"_id": F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(0)), "_null": F.col("row.doc_id").isNull(),
                                     "_hash": F.xxhash64(F.col("row.text").cast("string"))})
    keep = keep.select(F.coalesce("keep_id", F.lit(0)).alias("_id"), F.col("keep_id").isNull().alias("_null"), F.col("keep_hash").alias("_hash"))
    on = ["_id", "_null", "_hash"]
    return rows.join(keep.hint("merge"), on, "left_semi").dropDuplicates(on).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
