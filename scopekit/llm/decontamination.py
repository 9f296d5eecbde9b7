"""Benchmark decontamination with training suffix arrays.

Documents are taken shard by shard (a few MB of text inside a task). Of a shard, the
words that occur in the benchmark are numbered, every run of such words long enough to hold a
window goes into the shard's suffix array, and every suffix of every benchmark item is
binary-searched in it, word by word. That gives the place of every window in the shard and, per
document, the longest verbatim match with its location; no shuffle is needed.

The benchmark is the query set. It is read in blocks of at most BLOCK_BYTES of text, each
broadcast on its own; a document row carries what earlier blocks found through the later ones, again without a
shuffle. After every CHAINED blocks the rows are written to the shared folder and the blocks' broadcasts destroyed, so
neither executors, tasks nor the driver ever hold more than CHAINED blocks, however large the benchmark is.

Edge cases: null or wordless texts have no words and are clean; an item of fewer words
than the window is one window as a whole, an item without words is none; a repeated item id counts
once; windows of an item without id mark words but list no item; repeated documents are
searched one by one.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, slices, text_bytes, written

WINDOW = 10
BLOCK_BYTES = 16 << 20   # benchmark text per block
CHAINED = 4              # blocks in one plan
SHARD_BYTES = 4 << 20    # document text per suffix array

# a word character is 0-9, a-z or any code point from U+0080; A-Z are lower-cased
_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
                  for b in range(256))

SCHEMA = ("doc_id bigint, text string, n_words bigint, spans array<struct<start:int,length:int>>, items array<bigint>, "
          "longest_words int, longest_start int, longest_item bigint")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Queries:
    """A block of benchmark items: the numbered words of all of them, one after the other, each
    followed by 0, and per position the words left, the window that starts there (its length, or 0)."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        seq, left, win, owner, seen = [], [], [], [], set()
        for item_id, text in items:
            words = words_of(text)
            if not words or (item_id, text) in seen:
                continue
            seen.add((item_id, text))
            n, k = len(words), min(window, len(words))
            seq += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] + [0]
            left += [*range(n, 0, -1), 0]
            win += [k if i + k <= n else 0 for i in range(n)] + [0]
            owner += [item_id] * (n + 1)
        self.seq = np.array(seq + [0], np.int32)
        self.left = np.array(left, np.int32)
        self.win = np.array(win, np.int32)
        self.owner = owner
        self.at = np.flatnonzero(self.left > 0)
        self.shortest = int(self.win[self.win > 0].min()) if len(self.at) else 0
        self.depth = int(self.left.max()) if len(self.at) else 0


def _suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the non-zero entries ordered by their following words (0 ends a suffix), by
    prefix doubling; suffixes equal for ``depth`` words stay tied."""
    sa = np.flatnonzero(seq)
    rank = seq.astype(np.int64)
    h = 1
    base = max(len(seq), int(seq.max(initial=0))) + 2   # above every rank: word numbers first, places later
    order = np.argsort(rank[sa], kind="stable")
    sa = sa[order]
    while True:
        nxt = np.zeros(len(sa), np.int64)
        inside = sa + h < len(seq)
        nxt[inside] = rank[sa[inside] + h]
        key = rank[sa] * base + nxt
        order = np.argsort(key, kind="stable")
        sa, key = sa[order], key[order]
        step = np.ones(len(sa), bool)
        step[1:] = key[1:] != key[:-1]
        fresh = np.zeros(len(seq), np.int64)
        fresh[sa] = np.cumsum(step)
        rank, h = fresh, 2 * h
        if h >= depth or step.all():
            return sa


def _bound(seq, sa, lo, hi, depth, word, right: bool) -> np.ndarray:
    """For all queries at once: the first place in [lo, hi) whose word at depth is >= (or >) the query's."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        there = seq[sa[mid] + depth]
        up = there <= word[open_] if right else there < word[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]


def search_shard(texts: list[bytes], q: Queries):
    """(n_words, spans, items, longest match) per text."""
    get = q.vocab.get
    docs = [words_of(t) for t in texts]
    counts = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(counts + 1)
    begins = ends - counts - 1
    found = [([], [], (0, None, None)) for _ in texts]
    if not len(q.at):
        return counts, found
    seq = np.zeros(int(ends[-1]) + q.depth + 2, np.int32)
    for d, b in zip(docs, begins):
        seq[b:b + len(d)] = [get(w, 0) for w in d]
    # only runs of benchmark words that can hold the shortest window
    edge = np.diff((seq > 0).astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    short = last - first < q.shortest
    drop = np.zeros(len(seq) + 1, np.int32)
    np.add.at(drop, first[short], 1)
    np.add.at(drop, last[short], -1)
    kept = np.where(np.cumsum(drop[:-1]) > 0, 0, seq)
    if not kept.any():
        return counts, found
    sa = _suffix_array(kept, q.depth)

    at = q.at
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    matched = np.zeros(len(at), np.int32)
    sample = np.zeros(len(at), np.int64)
    whole_lo, whole_hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    alive, depth = np.arange(len(at)), 0
    while len(alive):
        word = q.seq[at[alive] + depth]
        a = _bound(kept, sa, lo[alive], hi[alive], depth, word, False)
        b = _bound(kept, sa, a, hi[alive], depth, word, True)
        some = b > a
        alive, a, b = alive[some], a[some], b[some]
        depth += 1
        lo[alive], hi[alive], matched[alive], sample[alive] = a, b, depth, a
        full = q.win[at[alive]] == depth
        whole_lo[alive[full]], whole_hi[alive[full]] = a[full], b[full]
        alive = alive[q.left[at[alive]] > depth]

    hits = np.flatnonzero(whole_hi > whole_lo)
    if not len(hits):
        return counts, found
    # windows of the same words have the same interval: take each interval once
    lines, which = np.unique(np.stack([whole_lo[hits], whole_hi[hits]], 1), axis=0, return_inverse=True)
    which = which.ravel()
    size = lines[:, 1] - lines[:, 0]
    group = np.repeat(np.arange(len(lines)), size)
    places = sa[np.repeat(lines[:, 0] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
    length = np.zeros(len(lines), np.int64)
    length[which] = q.win[at[hits]]
    cover = np.zeros(len(seq) + 1, np.int32)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + length[group], -1)
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc_of = np.searchsorted(ends, first, side="right")
    for d, s, e in zip(doc_of.tolist(), first.tolist(), last.tolist()):
        found[d][0].append({"start": int(s - begins[d]), "length": e - s})
    owners: list[set] = [set() for _ in lines]
    for k, h in zip(which.tolist(), hits.tolist()):
        if q.owner[at[h]] is not None:
            owners[k].add(q.owner[at[h]])
    pairs = np.unique(np.stack([np.searchsorted(ends, places, side="right"), group], 1), axis=0)
    for d, k in pairs.tolist():
        found[d][1].extend(owners[k])
    # the longest match of every test suffix, told to the documents at its place in the array; equal matches have one interval
    _, once = np.unique(np.stack([matched[hits], lo[hits], hi[hits]], 1), axis=0, return_index=True)
    once.sort()
    for h in hits[once[np.argsort(-matched[hits[once]], kind="stable")]].tolist():
        span = np.sort(sa[lo[h]:hi[h]])
        inside, first = np.unique(np.searchsorted(ends, span, side="right"), return_index=True)
        for d, p in zip(inside.tolist(), span[first].tolist()):
            if found[d][2][0] < matched[h]:
                found[d] = (*found[d][:2], (int(matched[h]), p - int(begins[d]), q.owner[at[h]]))
    return counts, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The query set in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        text = r["text"].encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    yield block


FOUND = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
         ("items", pa.list_(pa.int64())), ("longest_words", pa.int32()), ("longest_start", pa.int32()),
         ("longest_item", pa.int64())]


def _joined(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans made one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], s["start"] + s["length"] - out[-1]["start"])
        else:
            out.append(dict(s))
    return out


def _searching(block, window: int, shard_bytes: int, carried: bool):
    """Search one block; ``carried``: the rows hold what earlier blocks have found."""
    def run(batches):
        q = Queries(block.value, window)
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                counts, found = search_shard(text_bytes(part.column("text")), q)
                spans, items, longest = [s for s, _, _ in found], [i for _, i, _ in found], [m for _, _, m in found]
                if carried:
                    spans = [_joined(a + b) for a, b in zip(spans, part.column("spans").to_pylist())]
                    items = [a + b for a, b in zip(items, part.column("items").to_pylist())]
                    before = zip(*(part.column(n).to_pylist() for n in ("longest_words", "longest_start", "longest_item")))
                    longest = [a if a[0] > b[0] else b for a, b in zip(longest, before)]
                cols = [counts, spans, [sorted(set(i)) for i in items], *([m[j] for m in longest] for j in range(3))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), *(pa.array(c, t) for c, (_, t) in zip(cols, FOUND))],
                    names=["doc_id", "text", *(n for n, _ in FOUND)])
    return run


def _keeping_clean(block, window: int, shard_bytes: int):
    def run(batches):
        q = Queries(block.value, window)
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                _, found = search_shard(text_bytes(part.column("text")), q)
                yield part.filter(pa.array([not spans for spans, _, _ in found], pa.bool_()))
    return run


def _block_by_block(rows: DataFrame, benchmark: DataFrame, block_bytes: int, step) -> DataFrame:
    """``step(rows, broadcast block, number of the block)`` for all blocks; rows are written before a broadcast goes."""
    sc, held = rows.sparkSession.sparkContext, []
    for i, block in enumerate(_blocks(benchmark, block_bytes)):
        if len(held) == CHAINED:
            rows = written(rows, "searched")
            for b in held:
                b.destroy()
            held = []
        held.append(sc.broadcast(block))
        rows = step(rows, held[-1], i)
    return rows


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document row: n_words, the disjoint word spans inside any window's occurrence, the
    items with occurring windows, and the longest verbatim match (words, start, item) of those that hold a window."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _block_by_block(rows, benchmark, block_bytes, lambda out, block, i: map_batches(
        out, _searching(block, window, shard_bytes, i > 0), SCHEMA)).drop("text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                        shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    return _block_by_block(docs, benchmark, block_bytes, lambda out, block, i: map_batches(
        out, _keeping_clean(block, window, shard_bytes), out.schema))


def digest(matches: DataFrame) -> DataFrame:
    """The report columns of a match table."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return matches.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
