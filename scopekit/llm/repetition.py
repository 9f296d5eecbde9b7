"""Quality rule: repetition inside a document, by a suffix array over its words.

The words of a batch of documents are numbered per document and their suffixes sorted by prefix
doubling; the ranks of every doubling step give the longest common prefix of neighbours. The deepest
longest-common-prefix interval around a suffix is the longest repeated substring that starts there;
the union of all those of at least MIN_REPEAT words is the covered part. A document is rejected
if that part is over MAX_COVERED of its words, or its longest repeat has over MAX_LONGEST
words or over MAX_LONGEST_SHARE of all words, beside the base rules (too few words, or too many
words in repeated three-word windows).

Edge cases: a null, empty or blank text has no words, fails the base rule and isn't kept; repeated rows
are judged one by one; an empty table gives no rows. Memory is that of one batch of texts or of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, slices, text_bytes

MIN_REPEAT = 5
MAX_COVERED = 0.5
MAX_LONGEST = 50
MAX_LONGEST_SHARE = 0.25
MIN_WORDS = 50
BASE_WINDOW = 3
SYMBOLS = b"#*$%&|<>"
BATCH_BYTES = 2 << 20

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("n_covered", pa.int64()), ("longest_repeat", pa.int64())]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def longest_repeats(seq: np.ndarray) -> np.ndarray:
    """For each position of a sequence of numbers, the length of the longest substring that starts
    there and also starts elsewhere. Negative numbers are separators and equal nothing."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    levels = []
    order = np.argsort(seq, kind="stable")
    key = seq[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (key[1:] < 0)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))    # a group's rank is its first place
    h = 1
    while True:
        levels.append(rank.copy())
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        mine = order[open_]
        group = rank[mine]
        after = rank[np.minimum(mine + h, n)]
        by = np.argsort(group * (n + 2) + after + 1, kind="stable")
        mine, group, after = mine[by], group[by], after[by]
        order[open_] = mine
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[open_] |= fresh
        rank[mine] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        h *= 2
    # common prefix of neighbours in the order, from the largest step down
    lcp = np.zeros(n + 1, np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    total = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n) & (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)])
        step = same * (1 << k)
        a, b, total = np.minimum(a + step, n), np.minimum(b + step, n), total + step
    lcp[pairs] = total
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:])
    return out


def _covered(starts: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + length, -1)
    return np.cumsum(mark[:-1]) > 0


def profile(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> list[np.ndarray]:
    """The columns FIELDS for a batch of texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts) + b" ", np.uint8)
    edges = np.concatenate(([0], np.cumsum(sizes)))

    def per_text(mask):
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[edges[1:]] - sums[edges[:-1]]

    starts_char = (buf & 0xC0) != 0x80
    chars, symbols = per_text(starts_char & ~_BLANK[buf]), per_text(_SYMBOL[buf])
    dup_lines, counts, number, ids = [], [], {}, []
    for t in texts:
        lines = [line for line in t.split(b"\n") if line and not line.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
        words = t.split()
        counts.append(len(words))
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(-1)
    counts = np.array(counts, np.int64)
    seq = np.array(ids, np.int64)
    ends = np.cumsum(counts + 1)
    doc = np.repeat(np.arange(len(texts)), counts + 1)
    stop = seq < 0
    seq = np.where(stop, -1 - np.arange(len(seq)), seq + doc * (len(number) + 1))   # no match crosses texts
    repeat = longest_repeats(seq)
    sums = []
    for least in (BASE_WINDOW, min_repeat):
        at = np.flatnonzero(repeat >= least)
        sums.append(np.add.reduceat(_covered(at, np.full(len(at), BASE_WINDOW) if least == BASE_WINDOW else repeat[at], len(seq)).astype(np.int64), ends - counts - 1))
    longest = np.maximum.reduceat(repeat, ends - counts - 1)
    return [counts, chars, symbols, np.array(dup_lines, np.int64), sums[0], sums[1], longest]


def profiles(docs: DataFrame, min_repeat: int = MIN_REPEAT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, FIELDS): word and repetition counts of every document."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                cols = profile(text_bytes(part.column("text")), min_repeat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(cols, FIELDS))],
                                                 names=["doc_id", *(n for n, _ in FIELDS)])
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n, _ in FIELDS))


def judged(found: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
           max_longest_share: float = MAX_LONGEST_SHARE) -> DataFrame:
    """With base_failed and kept."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * n)
    repeated = ((F.col("n_covered") > max_covered * n)
                | (F.col("longest_repeat") > max_longest) | (F.col("longest_repeat") > max_longest_share * n))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base.alias("base_failed"), (~base & ~repeated).alias("kept"), "n_covered", "longest_repeat")
