"""Suffix-array deduplication: remove text that also starts in a document of a smaller id.

A byte goes if any LENGTH-byte string over it also starts in a document with a smaller id. Only suffixes
that can have an equal one elsewhere are sorted, and only to LENGTH bytes:

1. Documents are dealt into groups of about GROUP_BYTES by a hash of their id and text. Every LENGTH-byte window has
   an anchor, its smallest GRAM-byte hash, so equal windows have equal anchors at the same place. A group
   sends each of its anchor hashes once; those of one document only are dropped for good.
2. For the rest a group sends the slice of text under each anchor's windows, equal slices once with
   their smallest document id. All windows that could be equal meet in one bucket. An anchor of over CROWD groups is
   dealt to many buckets: by the half of the window on its longer side, which equal windows share.
3. A bucket orders its suffixes by deep-shallow sorting: multikey sorting by eight bytes at a time to
   SHALLOW bytes, then a blind trie for each group that still has different members. Neighbours with
   a common prefix of LENGTH bytes share the smallest document id, which goes back to the groups.
4. Groups mark the windows with a smaller id and cut the bytes that they cover.

Hot strings (a line of a third of all documents) are sent once by each group, not by each document.
Documents are shuffled once and that exchange is used three times.

Edge cases: a null text is empty; a document without id neither removes nor loses anything, and is in no group; rows of one
id never remove each other's text and are dealt to many groups (equal rows of an id to one); texts shorter than LENGTH
are kept; a text is anchored in pieces of CHUNK windows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import text_bytes, text_or_empty
from scopekit.operators.batch import ship_by_value

LENGTH = 50
GRAM = 16
SHALLOW = 32
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
CHUNK = 1 << 17
CROWD = 256          # groups that hold an anchor before its windows are dealt to several buckets
NO_DOC = np.iinfo(np.int64).max

_U = np.uint64


def _words(buf: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each position as one number (little- or big-endian); the end is padded with zeros."""
    a = np.zeros(len(buf) + 8, _U)
    a[:len(buf)] = buf
    for n in (1, 2, 4):
        s = _U(8 * n)
        a = (a[:-n] << s) | a[n:] if big else a[:-n] | (a[n:] << s)
    return a[:len(buf)]


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    w = _words(buf)
    n = len(buf) - GRAM + 1
    h = w[:n] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h += w[8:8 + n]
    h ^= h >> _U(32)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    return h


def anchors(text: np.ndarray):
    """(hash, position, first window, windows) of every anchor of one text, in order of the windows."""
    parts = []
    for a in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
        buf = text[a:a + CHUNK + LENGTH - 1]
        h = _gram_hashes(buf)
        low = (h & ~_U((1 << 20) - 1)) | np.arange(len(h), dtype=_U)   # smallest hash, leftmost of equal ones
        span, want = 1, LENGTH - GRAM + 1
        while span * 2 <= want:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < want:
            low = np.minimum(low[:len(low) - (want - span)], low[want - span:])
        at = (low & _U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        mixed = h[at[first]] * _U(0xD6E8FEB86659FD93)       # minima are small: spread them over all buckets
        parts.append((mixed ^ (mixed >> _U(32)), at[first] + a, first + a, np.diff(first, append=len(at))))
    if not parts:
        return np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard
    head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for size, t in zip(np.frombuffer(raw[:at], np.int64).tolist(), types):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def _short(hashes: np.ndarray) -> bytes:
    """The low six bytes of each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _key(h: np.ndarray) -> np.ndarray:
    """What is sent of a hash beside its bucket (the top bits): six bytes, the lowest bit free for a flag."""
    return h & _U((1 << 48) - 2)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class BlindTrie:
    """Orders strings of one length by the characters at which they part; equal strings share a leaf."""

    def __init__(self):
        self.root = None

    def insert(self, value: int, text: bytes, item: int) -> None:
        """value: the text as a big-endian number. A node is [depth, children], a leaf (value, items)."""
        node = self.root
        if node is None:
            self.root = (value, [item])
            return
        while type(node) is list:                # blind: looks only at the branching characters
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        other = value ^ node[0]
        if not other:
            node[1].append(item)
            return
        common = len(text) - (other.bit_length() + 7) // 8
        differs = node[0] >> 8 * (len(text) - 1 - common) & 255
        leaf = (value, [item])
        above, node = None, self.root
        while type(node) is list and node[0] < common:
            above, node = node, node[1][text[node[0]]]
        if type(node) is list and node[0] == common:
            node[1][text[common]] = leaf
            return
        fork = [common, {differs: node, text[common]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def leaves(self) -> list[list[int]]:
        """The items of each distinct string, in the strings' order."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is list:
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
            elif node:
                out.append(node[1])
        return out


def sort_suffixes(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """(order, classes): starts ordered by their next ``length`` bytes, and for each place in that
    order the number of its distinct string."""
    big = _words(buf, big=True)
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)            # True where a place differs from the one before
    new[:1] = True
    open_ = np.arange(len(starts))               # places whose group isn't resolved
    for depth in range(0, shallow, 8):           # multikey, eight bytes a key
        if not len(open_):
            break
        group = np.cumsum(new)[open_]
        key = big[starts[order[open_]] + depth]
        by = np.lexsort((key, group))
        order[open_], key, group = order[open_][by], key[by], group[by]
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[open_] |= fresh
        single = fresh & np.append(fresh[1:], True)
        open_ = open_[~single]
    if len(open_):                               # long common prefixes: blind tries where members differ
        first = np.flatnonzero(new[open_])
        head = np.repeat(order[open_[first]], np.diff(first, append=len(open_)))
        mine = order[open_]
        same = np.ones(len(open_), bool)
        for depth in [*range(shallow, length - 8, 8), length - 8]:
            same &= big[starts[mine] + depth] == big[starts[head] + depth]
        raw = buf.tobytes()
        mixed = np.flatnonzero(np.add.reduceat(~same, first))
        ends = np.append(first[1:], len(open_))
        for a, b in zip(first[mixed].tolist(), ends[mixed].tolist()):
            trie, members = BlindTrie(), mine[a:b]
            for item, s in zip(members.tolist(), starts[members].tolist()):
                text = raw[s:s + length]
                trie.insert(int.from_bytes(text, "big"), text, item)
            at = int(open_[a])
            for leaf in trie.leaves():
                order[at:at + len(leaf)] = leaf
                new[at] = True
                at += len(leaf)
    return order, np.cumsum(new) - 1


def _rows(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a group in an order that doesn't depend on how the shuffle delivered them."""
    pairs = zip(table.column("doc_id").to_pylist(), text_bytes(table.column("text")))
    pairs = sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    return [i for i, _ in pairs], [t for _, t in pairs]


class _Group:
    """The documents of a group and their anchors."""

    def __init__(self, table: pa.Table):
        self.ids, self.texts = _rows(table)
        cols = []
        for row, (doc_id, text) in enumerate(zip(self.ids, self.texts)):
            if doc_id is not None and len(text) >= LENGTH:
                h, at, first, n = anchors(np.frombuffer(text, np.uint8))
                cols.append((h, np.full(len(h), row), at, first, n))
        empty = (np.zeros(0, _U), *(np.zeros(0, np.int64),) * 4)
        self.hash, self.row, self.at, self.first, self.n = (np.concatenate(c) for c in zip(*(cols or [empty])))
        self.doc = np.array([NO_DOC if i is None else i for i in self.ids], np.int64)


def _send_hashes(bits: int):
    def run(key, table):
        g = _Group(table)
        order = np.lexsort((g.doc[g.row], g.hash))
        h, d = g.hash[order], g.doc[g.row][order]
        start = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        ends = np.append(start[1:], len(h)) - 1
        several = d[start] != d[ends] if len(h) else np.zeros(0, bool)
        h = h[start]
        bucket = (h >> _U(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        sent = _key(h) | several.astype(_U)
        rows = [(int(bucket[a]), key[0].as_py(), _short(sent[a:b])) for a, b in zip(cut, [*cut[1:], len(h)])]
        return _table(rows, (("bucket", pa.int64()), ("grp", pa.int64()), ("blob", pa.binary())))
    return run


def _table(rows: list[tuple], cols) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(cols)})


def _shared_hashes(crowd: int):
    def run(key, table):
        """To each group, those of its hashes that another document has too; the lowest bit marks those of a crowd."""
        lists = [_long(b) for b in table.column("blob").to_pylist()]
        every = np.concatenate(lists)
        plain, groups = np.unique(every & ~_U(1), return_counts=True)
        shared = np.union1d(plain[groups > 1], every[every & _U(1) == 1] & ~_U(1))
        crowded = plain[groups > crowd]
        rows = []
        for grp, own in zip(table.column("grp").to_pylist(), lists):
            own = own & ~_U(1)
            own = own[_among(own, shared)]
            if len(own):
                rows.append((grp, key[0].as_py(), _short(own | _among(own, crowded).astype(_U))))
        return _table(rows, (("grp", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())))
    return run


def _dealt(g: _Group, mine: np.ndarray, crowded: np.ndarray):
    """(hash, row, at, first window, windows) of the chosen anchors. An anchor of a crowd is two entries, of the windows
    with at least half of their other bytes before it, and of the rest, each with the hash of the gram and that half."""
    plain = mine[~crowded]
    half = (LENGTH - GRAM) // 2
    split = []
    for i in mine[crowded].tolist():
        row, at, first, n = int(g.row[i]), int(g.at[i]), int(g.first[i]), int(g.n[i])
        before = min(max(at - half - first + 1, 0), n)
        text = g.texts[row]
        for side, f, k, part in ((1, first, before, text[at - half:at + GRAM]), (2, first + before, n - before, text[at:at + LENGTH - half + 1])):
            if k:
                split.append((zlib.crc32(part, side), row, at, f, k))
    more = np.array(split, np.int64).reshape(-1, 5).T
    hashes = (more[0].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    own = (g.hash, g.row, g.at, g.first, g.n)
    return tuple(np.concatenate([c[plain], x]) for c, x in zip(own, (hashes, *more[1:])))


def _send_slices(bits: int):
    high = min(bits, 16)

    def run(key, table, shared):
        g = _Group(table)
        rows = []
        if shared.num_rows and len(g.hash):
            # six bytes of each hash came back, the bits above them are the bucket's highest
            known = np.sort(np.concatenate([_long(b) | (_U(k >> (bits - high)) << _U(48)) for k, b in zip(
                shared.column("bucket").to_pylist(), shared.column("blob").to_pylist())]))
            code = _key(g.hash) | ((g.hash >> _U(64 - high)) << _U(48))
            mine = np.flatnonzero(_among(code, known & ~_U(1)))
            crowded = known[np.searchsorted(known & ~_U(1), code[mine])] & _U(1) == 1
            hash_, row, at_, first, n = _dealt(g, mine, crowded)
            bucket = (hash_ >> _U(64 - bits)).astype(np.int64)
            mine = np.argsort(bucket, kind="stable")
            bucket = np.sort(bucket)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            own = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(mine)]):
                some = mine[a:b]
                number: dict[tuple, int] = {}
                ids = np.empty(b - a, np.int64)
                for i, (r, f, size, at) in enumerate(zip(*(c[some].tolist() for c in (row, first, n, at_)))):
                    ids[i] = number.setdefault((g.texts[r][f:f + size + LENGTH - 1], at - f), len(number))
                least = np.full(len(number), NO_DOC, np.int64)
                np.minimum.at(least, ids, g.doc[row[some]])
                count = np.array([len(s) - LENGTH + 1 for s, _ in number], np.uint8)
                place = np.array([p for _, p in number], np.uint8)
                body = np.frombuffer(b"".join(s for s, _ in number), np.uint8)
                k = int(bucket[a])
                rows.append((k, key[0].as_py(), _pack(least, count, place, body)))
                own.append((np.full(b - a, k), ids, least[ids], row[some], first[some], n[some]))
            if own:   # the places, for the last step: carried past the buckets
                rows.append((-1 - key[0].as_py(), key[0].as_py(), _pack(*(np.concatenate(c).astype(np.int64) for c in zip(*own)))))
        return _table(rows, (("bucket", pa.int64()), ("grp", pa.int64()), ("blob", pa.binary())))
    return run


def _windows(first: np.ndarray, counts: np.ndarray):
    """All positions first[i] + 0 .. counts[i] - 1, and i of each."""
    of = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return first[of] + np.arange(len(of)) - skip[of], of


def _earliest(key, table):
    """For each group, the runs of windows whose string has a smaller document id than the group's own."""
    bucket = key[0].as_py()
    cols = (("grp", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary()))
    if bucket < 0:
        return table.select(["grp", "bucket", "blob"])
    blobs = [_unpack(b, np.int64, np.uint8, np.uint8, np.uint8) for b in table.column("blob").to_pylist()]
    number: dict[tuple, int] = {}
    owner, ids = [], []
    for i, (_, count, place, body) in enumerate(blobs):
        raw, at = body.tobytes(), 0
        for n, p in zip(count.tolist(), place.tolist()):
            size = n + LENGTH - 1
            ids.append(number.setdefault((raw[at:at + size], p), len(number)))
            at += size
        owner += [i] * len(count)
    ids, owner = np.array(ids, np.int64), np.array(owner, np.int64)
    docs = np.concatenate([b[0] for b in blobs])
    least = np.full(len(number), NO_DOC, np.int64)
    np.minimum.at(least, ids, docs)

    slices = list(number)
    buf = np.frombuffer(b"".join(s for s, _ in slices) + bytes(LENGTH), np.uint8)
    sizes = np.array([len(s) for s, _ in slices], np.int64)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    place = np.array([p for _, p in slices], np.int64)
    # slices around the same anchor: only those can have equal windows
    little = _words(buf)
    gram = np.stack([little[begin + place], little[begin + place + 8]], 1)
    _, which, size = np.unique(gram, axis=0, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[which.ravel()] > 1)
    starts, of = _windows(begin[several], counts[several])
    known, _ = _windows(np.zeros(len(counts), np.int64), counts)
    known = np.repeat(least, counts)                       # the smallest id of each window of each slice
    base = np.cumsum(counts) - counts
    if len(starts):
        order, classes = sort_suffixes(buf, starts)
        mine = least[several][of]
        heads = np.flatnonzero(np.diff(classes, prepend=-1))
        smallest = np.minimum.reduceat(mine[order], heads)[classes]
        slot = base[several][of] + (starts - begin[several][of])
        known[slot[order]] = smallest

    rows = []
    edges = np.searchsorted(owner, np.arange(len(blobs) + 1))
    for i, grp in enumerate(table.column("grp").to_pylist()):
        a, b = edges[i], edges[i + 1]
        slot, of = _windows(base[ids[a:b]], counts[ids[a:b]])
        value = known[slot]
        j = slot - base[ids[a:b]][of]
        better = value < docs[a:b][of]
        start = better & ~np.concatenate(([False], better[:-1] & (of[1:] == of[:-1]) & (value[1:] == value[:-1])))
        at = np.flatnonzero(start)
        if not len(at):
            continue
        stop = np.flatnonzero(better & ~np.concatenate((better[1:] & (of[1:] == of[:-1]) & (value[1:] == value[:-1]), [False])))
        rows.append((grp, bucket, _pack(of[at].astype(np.int32), j[at].astype(np.uint8), (stop - at + 1).astype(np.uint8), value[at])))
    return _table(rows, cols)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
RESULT_COLS = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
               ("kept", pa.binary()))


def _cut(digest: bool):
    def run(key, table, replies):
        ids, texts = _rows(table)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        mark = np.zeros(int(sizes.sum()) + 1, np.int32)
        doc = np.array([NO_DOC if i is None else i for i in ids], np.int64)
        buckets, blobs = replies.column("bucket").to_pylist(), replies.column("blob").to_pylist()
        own = [b for k, b in zip(buckets, blobs) if k < 0]
        if own:
            bucket, number, least, row, first, n = _unpack(own[0], *(np.int64,) * 6)
            gone = np.flatnonzero(least < doc[row])          # a document of this group has the whole slice
            np.add.at(mark, begin[row[gone]] + first[gone], 1)
            np.add.at(mark, begin[row[gone]] + first[gone] + n[gone] + LENGTH - 1, -1)
            lows = np.searchsorted(bucket, np.unique(bucket))
            span = dict(zip(bucket[lows].tolist(), zip(lows.tolist(), [*lows[1:].tolist(), len(bucket)])))
            for k, blob in zip(buckets, blobs):
                if k < 0:
                    continue
                which, j, length, value = _unpack(blob, np.int32, np.uint8, np.uint8, np.int64)
                a, b = span[k]
                order = np.argsort(number[a:b], kind="stable") + a
                lo = np.searchsorted(number[order], which, "left")
                hi = np.searchsorted(number[order], which, "right")
                places, run_ = _windows(lo, hi - lo)
                o = order[places]
                hit = value[run_] < doc[row[o]]
                o, run_ = o[hit], run_[hit]
                at = begin[row[o]] + first[o] + j[run_]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + length[run_] + LENGTH - 1, -1)
        gone = np.cumsum(mark[:-1]) > 0
        rows = []
        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            a = int(begin[i])
            cover = gone[a:a + len(text)]
            removed = int(cover.sum())
            kept = np.frombuffer(text, np.uint8)[~cover].tobytes() if removed else text
            spans = int(np.count_nonzero(cover[1:] & ~cover[:-1]) + cover[0]) if removed else 0
            rows.append((doc_id, len(text), removed, spans, sha256(kept).hexdigest().encode() if digest else kept))
        return _table(rows, RESULT_COLS)
    return run


def remove_repeats(docs: DataFrame, digest: bool = False, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES,
                   crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per document row; kept is what stays (UTF-8 bytes; a cut
    may fall inside a character), or with ``digest`` the hex SHA-256 of it."""
    ship_by_value()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none, whole = F.lit(0).cast("bigint"), text_or_empty()
    no_id = docs.where("doc_id IS NULL").select(
        "doc_id", F.octet_length(whole).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        (F.sha2(whole, 256) if digest else whole).cast("binary").alias("kept"))
    docs = docs.where("doc_id IS NOT NULL")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(64, -(-total // group_bytes))
    bits = max(5, (total // bucket_bytes).bit_length())
    docs = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    sent = "bucket bigint, grp bigint, blob binary"
    back = "grp bigint, bucket bigint, blob binary"
    hashes = docs.groupBy("grp").applyInArrow(_send_hashes(bits), sent)
    shared = hashes.groupBy("bucket").applyInArrow(_shared_hashes(crowd), back)
    parts = docs.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_send_slices(bits), sent)
    found = parts.groupBy("bucket").applyInArrow(_earliest, back)
    return docs.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_cut(digest), RESULT).unionByName(no_id)


def report(removed: DataFrame) -> DataFrame:
    """The report columns of ``remove_repeats(digest=True)``."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
