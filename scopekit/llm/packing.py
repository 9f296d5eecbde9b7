"""Hierarchical multi-length packing of documents into token sequences.

Every context size of TIERS has its own sequences. A document is routed to the smallest tier that
holds it; one longer than the largest context first gives full windows of that size and its rest is
routed. Tiers are packed from the longest to the shortest: the longest document left opens a
window, the window's gap takes whole documents of shorter tiers, best fit first, and what still is
open is filled by cutting one more document, whose rest goes back to the tier it now fits. So every
window is full. Windows of a tier are then dealt into step groups of the same number of tokens, in
snake order of their attention cost, so that groups cost about the same.

A task packs the documents it has read, in units of UNIT_TOKENS; what doesn't fill a window
waits for the next unit, and at the task's end for windows of the TAIL sizes (powers of two down
to one token). Nothing is shuffled, memory is bounded by a unit and one document, and the same input
split gives the same sequences again after a lost executor.

Edge cases: a null or empty text is the end token alone; repeated or null ids are packed row by
row; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, slices, text_bytes, worker_state

TIERS = (2048, 1024, 512, 256)
TAIL = (128, 64, 32, 16, 8, 4, 2, 1)
STEP_TOKENS = 8 * 2048
UNIT_TOKENS = 1 << 20
END_ID = 1
WORDS_KEPT = 1_200_000

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, tier int, step_group bigint")

# Text of these characters alone has one code point per letter and no composing marks, so it can be
# lower-cased and split here; any other word is given to the tokenizer as it is.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible,
    else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordTokenizer:
    """Token ids (little-endian uint32 bytes) of whole texts by a byte-level BPE tokenizer that
    lower-cases and drops white space.

    Its tokens never cross white space, so a text's ids are those of its words one after the other.
    The ids of words and of the pieces they split into are remembered, up to WORDS_KEPT of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.known: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, key: bytes, ids: bytes) -> bytes:
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        if len(key) <= 64:
            self.known[key] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        key = piece.encode()
        ids = self.known.get(key)
        if ids is None:
            tokens = self.model.tokenize(key.decode("latin-1").translate(self.letters))
            ids = self._keep(key, b"".join([t.id.to_bytes(4, "little") for t in tokens]))
        return ids

    def _plain_word(self, word: bytes) -> bytes:
        pieces = _SPLIT.findall(word.decode().lower())
        ids = b"".join(map(self._piece, pieces))
        return ids if len(pieces) == 1 and word.isalpha() else self._keep(word, ids)

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text or not _PLAIN.fullmatch(text.decode()):
            return b"".join([self._encode(w.decode()) for w in text.split()])
        get, make = self.known.get, self._plain_word
        return b"".join([get(w) or make(w) for w in text.lower().split()])


class Packer:
    """Packs pieces (length, document, start) of one task; a document is (doc_id, ids)."""

    def __init__(self, partition: int, tiers=TIERS, tail=TAIL, step_tokens: int = STEP_TOKENS):
        self.tiers, self.tail, self.step_tokens = tuple(sorted(tiers, reverse=True)), tail, step_tokens
        self.next_sequence = self.next_group = partition << 33
        self.pool: list[tuple[int, int, int]] = []
        self.docs: dict[int, tuple] = {}
        self.n_docs = self.tokens = 0
        self.windows: dict[int, list[list[tuple[int, int, int]]]] = {c: [] for c in self.tiers + tuple(tail)}

    def add(self, doc_id, ids: np.ndarray) -> None:
        d, top, n = self.n_docs, self.tiers[0], len(ids)
        self.n_docs += 1
        self.docs[d] = (doc_id, ids)
        self.tokens += n
        for s in range(0, n - top + 1, top):
            self.windows[top].append([(top, d, s)])
        if n % top:
            insort(self.pool, (n % top, d, n - n % top))

    def _cut(self, at: int, length: int) -> tuple[int, int, int]:
        """The head of the pool's piece ``at``; its rest goes back."""
        n, d, s = self.pool.pop(at)
        insort(self.pool, (n - length, d, s + length))
        return length, d, s

    def _fill(self, window: list, gap: int) -> int:
        """Whole documents that fit the gap, longest first, then the head of the shortest that doesn't."""
        while gap and self.pool:
            fits = bisect_right(self.pool, (gap, 1 << 60, 0))
            piece = self.pool.pop(fits - 1) if fits else self._cut(bisect_left(self.pool, (gap + 1,)), gap)
            window.append(piece)
            gap -= piece[0]
        return gap

    def pack(self) -> None:
        waiting = []
        for context, below in zip(self.tiers, self.tiers[1:] + (0,)):
            while self.pool and self.pool[-1][0] > below:
                window = [self.pool.pop()]
                if self._fill(window, context - window[0][0]):
                    waiting += window
                else:
                    self.windows[context].append(window)
        for piece in waiting:
            insort(self.pool, piece)

    def finish(self) -> None:
        self.pack()
        for context in self.tiers + tuple(self.tail):
            while sum(n for n, _, _ in self.pool) >= context:
                window: list = []
                self._fill(window, context)
                self.windows[context].append(window)

    def rows(self) -> Iterator[tuple]:
        """The packed pieces; what still waits stays."""
        for context, windows in self.windows.items():
            if not windows:
                continue
            windows.sort(key=lambda w: -sum(n * n for n, _, _ in w))
            groups = -(-len(windows) // max(1, self.step_tokens // context))
            for i, window in enumerate(windows):
                turn, at = divmod(i, groups)
                group = self.next_group + (groups - 1 - at if turn % 2 else at)
                offset = 0
                for n, d, s in window:
                    doc_id, ids = self.docs[d]
                    yield doc_id, s, n, ids[s:s + n].tobytes(), len(ids), self.next_sequence, offset, context, group
                    offset += n
                self.next_sequence += 1
            self.next_group += groups
            windows.clear()
        left = {d for _, d, _ in self.pool}
        self.docs = {d: v for d, v in self.docs.items() if d in left}
        self.tokens = sum(n for n, _, _ in self.pool)


def pack(docs: DataFrame, tokenizer_path: str, tiers=TIERS, tail=TAIL, step_tokens: int = STEP_TOKENS,
         unit_tokens: int = UNIT_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: where it starts, its ids (uint32, little-endian), the
    sequence and place it lies at, the sequence's tier and step group."""
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def out(packer):
        rows = []
        for row in packer.rows():
            rows.append(row)
            if len(rows) == 5000:
                yield rows
                rows = []
        if rows:
            yield rows

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        from pyspark import TaskContext
        words = worker_state(f"tokenizer:{tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), tiers, tail, step_tokens)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text"))):
                    packer.add(doc_id, np.frombuffer(words.ids(text) + end, "<u4"))
                    if packer.tokens >= unit_tokens:
                        packer.pack()
                        yield from map(batch_of, out(packer))
        packer.finish()
        yield from map(batch_of, out(packer))

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The report columns: the piece's ids as a checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_group")
