"""Spelling variant grouping with k-d trees over letter-count vectors.

A word's vector counts its letters (code points modulo DIMS). One inserted or deleted letter changes one count by one,
one replaced letter moves one count to another, so near words lie within an L1 distance of two: no more than
one count up and one down between words of a length, and exactly one up from a word to one a letter longer. For each
such pair of lengths the words of one are searched in the tree of the other, pruning every box that needs more changes
than that; in the leaves that remain the order of the letters decides.

The trees have two levels. The upper one is planes fitted on a bounded sample of each length's words (SAMPLE_WORDS in
all); they only balance the cells and don't touch the result. Its leaves, the cells, are shuffle keys: a word is kept
in the cell that holds its vector and asked in all cells whose box it can reach. A task then builds the lower tree of
its cell with tight boxes and searches it for all questions of the cell together. Cells are made as numerous as
CELL_WORDS words each ask for.

Forms point to words of at least five times as many occurrences, so chains are short (at most log5 of the largest
count) and are followed by pointer doubling.

Edge cases: null and empty texts have no words; a null id is the empty string in the checksum's text; repeated rows
count again; words of fewer than MIN_LETTERS code points or MIN_COUNT occurrences take no part; ties go to the first word in
code-point order; an empty table gives no rows; other columns are ignored. A run of any length is one word. Words
of the same letters in any order share one vector and can't be split by planes; a leaf of them is compared in blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, slices, text_bytes, text_or_empty, written

MIN_LETTERS, MIN_COUNT, FORM_FACTOR, SLIP = 6, 5, 5, 199
DIMS = 32
SAMPLE_WORDS = 200_000      # words that the planes of the upper trees are fitted on
CELL_WORDS = 4096
LEAF_WORDS = 48
BLOCK_WORDS = 400_000       # distinct words in a task's memory before their counts are given out
BLOCK_CELLS = 1 << 22       # letters compared at once in a leaf

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def slipped_words(doc_id: str, runs: "Counter[str]") -> "list[tuple[str, int]]":
    """The words that a document's lower-cased runs become, with their occurrences."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    out = []
    for run, n in runs.items():
        if len(run) >= MIN_LETTERS:          # a deletion only shortens
            h = zlib.crc32(run.encode(), seed)
            if h % SLIP == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
                if len(run) < MIN_LETTERS:
                    continue
            out.append((run, n))
    return out


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): all words of at least min_count occurrences."""
    def run(batches):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held: dict = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for doc_id, text in zip(part.column("id").to_pylist(), text_bytes(part.column("text"))):
                    runs = Counter(_RUN.findall(text.translate(_LOWER).decode()))
                    for word, n in slipped_words(doc_id, runs):
                        held[word] = held.get(word, 0) + n
                    if len(held) >= BLOCK_WORDS:
                        yield rows()
                        held = {}
        yield rows()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))
    counted = map_batches(texts, run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letters_of(words: "list[str]") -> np.ndarray:
    """One row of code points for each of the words, which are equally long."""
    size = len(words[0])
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def vectors_of(letters: np.ndarray) -> np.ndarray:
    at = np.arange(len(letters))[:, None] * DIMS + letters % DIMS
    return np.bincount(at.ravel(), minlength=len(letters) * DIMS).reshape(-1, DIMS).astype(np.int32)


class LetterTree:
    """A k-d tree of letter-count vectors; every node has a box, every leaf a range of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf_words: int, tight: bool = True):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.child, self.range = [], [], [], []
        room = np.zeros(DIMS, np.int32), np.full(DIMS, 1 << 30, np.int32)
        todo = [(0, len(vectors), *room, -1, 0)]
        while todo:
            start, end, low, high, parent, side = todo.pop()
            node = len(self.low)
            if parent >= 0:
                self.child[parent][side] = node
            mine = vectors[self.order[start:end]]
            if tight and len(mine):
                low, high = mine.min(0), mine.max(0)
            self.low.append(low)
            self.high.append(high)
            self.child.append([-1, -1])
            self.range.append((start, end))
            if end - start <= leaf_words:
                continue
            dim, cut = self._plane(mine)
            if dim < 0:
                continue
            below = mine[:, dim] < cut
            mid = start + int(below.sum())
            self.order[start:end] = np.concatenate([self.order[start:end][below], self.order[start:end][~below]])
            left, right = high.copy(), low.copy()
            left[dim], right[dim] = cut - 1, cut
            todo += [(mid, end, right, high, node, 1), (start, mid, low, left, node, 0)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    @staticmethod
    def _plane(mine: np.ndarray) -> tuple[int, int]:
        """The dimension and value that halve the vectors best; (-1, 0) if all are equal."""
        best, found = 0, (-1, 0)
        for dim in np.argsort(-mine.var(0), kind="stable")[:6]:
            values, counts = np.unique(mine[:, dim], return_counts=True)
            if len(values) < 2:
                break
            below = np.cumsum(counts)[:-1]
            at = int(np.argmin(np.abs(2 * below - len(mine))))
            smaller = min(below[at], len(mine) - below[at])
            if smaller > best:
                best, found = smaller, (int(dim), int(values[at + 1]))
        return found

    def reach(self, vectors: np.ndarray, up: int, down: int):
        """(leaf node, rows of ``vectors``) for every leaf whose box lies within ``up`` counts up and ``down`` down."""
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            mine = vectors[rows]
            rows = rows[(np.maximum(self.low[node] - mine, 0).sum(1) <= up) & (np.maximum(mine - self.high[node], 0).sum(1) <= down)]
            if len(rows) == 0:
                continue
            left, right = self.child[node]
            if left < 0:
                yield node, rows
            else:
                todo += [(right, rows), (left, rows)]


def near_rows(asked: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of asked, row of kept) that are one letter apart; kept has as many letters, or one more."""
    size = asked.shape[1]
    if kept.shape[1] == size:
        return np.nonzero((asked[:, None, :] != kept[None, :, :]).sum(2, dtype=np.int32) == 1)
    before = np.minimum.accumulate(asked[:, None, :] == kept[None, :, :-1], axis=2).sum(2)
    after = np.minimum.accumulate((asked[:, None, :] == kept[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
    return np.nonzero(before + after >= size)


def search(asked: "list[str]", kept: "list[str]") -> "list[tuple[int, int]]":
    """Index pairs of near words; the words of each list are equally long, kept ones as long as asked ones or a letter longer."""
    if not asked or not kept:
        return []
    a, k = letters_of(asked), letters_of(kept)
    tree = LetterTree(vectors_of(k), LEAF_WORDS)
    out = []
    for leaf, rows in tree.reach(vectors_of(a), 1, 1 if a.shape[1] == k.shape[1] else 0):
        start, end = tree.range[leaf]
        block = max(1, BLOCK_CELLS // (k.shape[1] * (end - start)))
        for i in range(0, len(rows), block):
            x, y = near_rows(a[rows[i:i + block]], k[tree.order[start:end]])
            out += zip(rows[i:i + block][x].tolist(), tree.order[start:end][y].tolist())
    return out


def upper_trees(words: DataFrame, sample_words: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS) -> dict:
    """{length: planes of that length's words}, fitted on about sample_words words by hash."""
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    every = max(1, -(-sum(sizes.values()) // sample_words))
    sample: dict = {}
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").orderBy("word").limit(2 * sample_words)
    for r in picked.toLocalIterator():
        sample.setdefault(len(r["word"]), []).append(r["word"])
    trees = {}
    for size, n in sizes.items():
        mine = sample.get(size) or ["a" * size]
        trees[size] = LetterTree(vectors_of(letters_of(mine)), max(1, len(mine) * cell_words // max(1, n)), tight=False)
    return trees


def near_words(words: DataFrame, trees: dict) -> DataFrame:
    """(word, near, near_n): each word with every near word, from words (word, n)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)     # planes: about two numbers a CELL_WORDS words

    def place(batches):
        """Rows (cell, size, word, n, asked): the cell that keeps the word, and the cells that it is asked in."""
        for batch in batches:
            frame = batch.to_pandas()
            for size, mine in frame.groupby(frame["word"].str.len(), sort=True):
                vectors, names, counts = vectors_of(letters_of(mine["word"].tolist())), mine["word"].to_numpy(), mine["n"].to_numpy()
                for target, up, down, asked in ((size, 0, 0, False), (size, 1, 1, True), (size + 1, 1, 0, True)):
                    if target not in shared.value:
                        continue
                    for cell, rows in shared.value[target].reach(vectors, up, down):
                        yield pa.RecordBatch.from_pandas(pd.DataFrame({"size": np.int32(target), "cell": np.int32(cell), "word": names[rows],
                                                                       "n": counts[rows], "asked": asked}), preserve_index=False)

    def compare(table: pa.Table) -> pa.Table:
        """All near pairs of a cell, both ways where the lengths differ."""
        frame = table.to_pandas()
        kept = frame[~frame["asked"]]
        out: dict = {"word": [], "near": [], "near_n": []}
        names, counts = kept["word"].tolist(), kept["n"].tolist()
        questions = frame[frame["asked"]]
        for size, mine in questions.groupby(questions["word"].str.len(), sort=True):
            asked, asked_n = mine["word"].tolist(), mine["n"].tolist()
            for i, j in search(asked, names):
                ways = [(asked[i], names[j], counts[j])]
                if len(names[j]) > size:
                    ways.append((names[j], asked[i], asked_n[i]))
                for way in ways:
                    for column, value in zip(out.values(), way):
                        column.append(value)
        return pa.table({"word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.string()),
                         "near_n": pa.array(out["near_n"], pa.int64())})

    placed = map_batches(words.select("word", "n"), place, "size int, cell int, word string, n bigint, asked boolean")
    return placed.groupBy("size", "cell").applyInArrow(compare, "word string, near string, near_n bigint")


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words; form is the near word that a word is likely a slip of."""
    words = written(word_counts(docs), "spelling-words")
    near = near_words(words, upper_trees(words))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    both = words.join(found, "word", "left")
    likely = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    forms = written(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the end of the chain of forms, by pointer doubling."""
    at = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = written(at.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                             F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if not at.where("moved").take(1):
            return at.select("word", "root")
        at = at.select("word", "root")
