"""Line deduplication by winnowing over line hashes.

A document is its sequence of non-blank lines (trimmed of blanks, tabs and carriage returns). Sizes count words, not lines: a
gram is the shortest run of lines from a line on that has GRAM_WORDS words, a window the shortest one of RUN_WORDS words.
Each window selects the gram inside it with the smallest hash (the first of equal ones) as its fingerprint. Which gram
that is depends on the window's lines alone, so any two places that share a run of RUN_WORDS words or more, however many
lines that is, have a fingerprint in common; neighbouring windows mostly select the same one.

The positions of each fingerprint are joined with its first place (the smallest document id, then the line), and every match is
extended line by line both ways. A fingerprint carries the hashes of the lines around it, RUN_WORDS words to each side, for
that: a run that goes on beyond has its next fingerprint there. The later one of two matched runs is deleted;
first places stay, as far as they aren't later places of other runs. Blank lines stay.

With ``short`` (SHORT_RUNS, as op6 runs it; the pipeline's stage runs without) every run of ``lines`` lines, however few its words, and every line of
``chars`` characters is a fingerprint as well, so each later copy of one goes; these aren't extended, as a longer run's
other windows match by themselves. Without it runs of fewer than GRAM_WORDS words are never touched, runs between the two
sizes only where they hold a fingerprint.

Smallest places are combined before the shuffle and written, so a passage of a third of all documents is one row on
the side that is looked up; the other side is a plain table whose hot share can be split. The joins are sort-merge
joins at every size.

Edge cases: a null text is empty (one blank line); a line of any length is one line; rows of the same id and text are one
document for the order and get the same result; different texts of one id are ordered by their hash; documents without id come
last; an empty table gives no rows; other columns are kept and can't clash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, packed, slices, text_bytes, text_or_empty, written

GRAM_WORDS = 25
RUN_WORDS = 50


class Short(NamedTuple):
    lines: int
    chars: int


SHORT_RUNS = Short(lines=3, chars=200)
_BLANKS = " \t\r"


def _lines():
    return F.split(text_or_empty("row.text"), "\n")


def _numbered():
    """(s, i) of the non-blank lines: the trimmed line and its place among all lines, from 0."""
    every = F.transform(_lines(), lambda x, i: F.struct(F.btrim(x, F.lit(_BLANKS)).alias("s"), i.alias("i")))
    return F.filter(every, lambda x: x["s"] != "")


def _key(docs: DataFrame) -> DataFrame:
    return packed(docs).withColumns({"_id": F.col("row.doc_id").cast("bigint"), "_hash": F.xxhash64(text_or_empty("row.text"))})


def selected_grams(lines: list[bytes], gram_words: int, run_words: int) -> tuple[dict[int, tuple[int, bytes]], np.ndarray]:
    """({first line: (end, hash)} of the fingerprints of a document's trimmed lines, words before each line and in all)."""
    words = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines], dtype=np.int64)))
    n = len(lines)
    gram_end, window_end = (np.searchsorted(words, words[:n] + size, "left") for size in (gram_words, run_words))
    hashes: dict = {}

    def of(j):
        if j not in hashes:
            hashes[j] = hashlib.md5(b"\n".join(lines[j:gram_end[j]])).digest()
        return hashes[j]
    found = {}
    for start in range(int(np.searchsorted(window_end, n, "right"))):         # windows that the document can fill
        last = int(np.searchsorted(gram_end, window_end[start], "right"))     # grams from start on that end inside
        best = min(range(start, last), key=lambda j: (of(j), j))
        found[best] = (int(gram_end[best]), of(best))
    return found, words


def _line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big", signed=True)


def short_grams(lines: list[bytes], short: Short) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, hash) of every run of ``short.lines`` lines and every line of ``short.chars`` characters. The
    hash names its kind, so it equals no selected gram's."""
    runs = [(j, short.lines, b"r" + hashlib.md5(b"\n".join(lines[j:j + short.lines])).digest()) for j in range(len(lines) - short.lines + 1)]
    # a line has at most as many characters as bytes, so most lines needn't be decoded
    return runs + [(j, 1, b"l" + hashlib.md5(x).digest()) for j, x in enumerate(lines)
                   if len(x) >= short.chars and len(x.decode("utf-8", "replace")) >= short.chars]


def fingerprints(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, short: Short | None = None) -> DataFrame:
    """(_id, _hash, line, n, gram, before, after): each fingerprint's first line (from 1), number of lines and hash, and the hashes
    of the lines before it (the nearest first) and after it, within run_words words (none for those of ``short``)."""
    texts = _key(docs.select("doc_id", "text")).select("_id", "_hash", text_or_empty("row.text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out: list = [[] for _ in range(7)]
                for doc_id, key, text in zip(part.column("_id").to_pylist(), part.column("_hash").to_pylist(), text_bytes(part.column("text"))):
                    lines = [x for x in (y.strip(b" \t\r") for y in text.split(b"\n")) if x]
                    found, words = selected_grams(lines, gram_words, run_words)
                    for j, n, gram in short_grams(lines, short) if short else ():
                        for column, value in zip(out, (doc_id, key, j + 1, n, gram, [], [])):
                            column.append(value)
                    if not found:
                        continue
                    hashes = [_line_hash(x) for x in lines]
                    for j, (end, gram) in sorted(found.items()):
                        low = int(np.searchsorted(words, words[j] - run_words, "left"))
                        high = int(np.searchsorted(words, words[end] + run_words, "right")) - 1
                        for column, value in zip(out, (doc_id, key, j + 1, end - j, gram, hashes[low:j][::-1], hashes[end:high])):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                                 names=["_id", "_hash", "line", "n", "gram", "before", "after"])
    return map_batches(texts, run, "_id bigint, _hash bigint, line int, n int, gram binary, before array<bigint>, after array<bigint>")


def _place(line: str):
    return F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_hash", F.col(line).alias("line"))


def _shared(a: str, b: str):
    """How many lines two lists of line hashes have in common from their start on."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(equal, False).cast("int")
    return F.when(stop > 0, stop - 1).otherwise(F.size(equal))


def repeated_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, short: Short | None = None) -> DataFrame:
    """(_id, _hash, gone): for each document with lines to delete, their numbers among its non-blank lines, from 1."""
    found = written(fingerprints(docs, gram_words, run_words, short), "line-fingerprints")
    place = _place("line")
    first = written(found.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last"),
                                              F.min_by(F.struct(F.col("before").alias("b"), F.col("after").alias("a")), place).alias("around"))
                    .where("first <> last").select("gram", "first", "around"), "line-first")
    later = found.join(first.hint("merge"), "gram").where(place > F.col("first"))
    start = F.col("line") - _shared("before", "around.b")
    end = F.col("line") + F.col("n") - 1 + _shared("after", "around.a")
    lines = later.select("_id", "_hash", F.explode(F.sequence(start, end)).alias("line"))
    return lines.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def with_repeats(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, short: Short | None = None) -> DataFrame:
    """The documents (column ``row``, a struct) with ``_gone``: the numbers of their lines to delete (null: none)."""
    gone = written(repeated_lines(docs, gram_words, run_words, short), "line-deletions").select(
        F.coalesce("_id", F.lit(0)).alias("_id0"), F.col("_id").isNull().alias("_null"), "_hash", F.col("gone").alias("_gone"))
    keyed = _key(docs).withColumns({"_id0": F.coalesce("_id", F.lit(0)), "_null": F.col("_id").isNull()})
    return keyed.join(gone.hint("merge"), ["_id0", "_null", "_hash"], "left").drop("_id0", "_null", "_hash", "_id")


def _kept_text():
    lines, numbered = _lines(), _numbered()
    drop = F.transform("_gone", lambda j: F.element_at(numbered, j)["i"])
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")


def remove_repeated_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, short: Short | None = None) -> DataFrame:
    """The documents with later repeated runs cut out of their text; all rows and columns stay (n_chars follows the text)."""
    changed = F.col("_gone").isNotNull()
    cut = with_repeats(docs, gram_words, run_words, short).withColumn("_cut", F.when(changed, _kept_text()))
    new = {"text": F.col("_cut"), "n_chars": F.char_length("_cut")}
    return cut.select(*[F.when(changed, new[f.name]).otherwise(F.col("row")[f.name]).cast(f.dataType).alias(f.name)
                        if f.name in new else F.col("row")[f.name].alias(f.name) for f in docs.schema])


def report(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, short: Short | None = None) -> DataFrame:
    """Per document row: its lines, the deleted ones, their runs, and the SHA-256 of what stays."""
    cut = with_repeats(docs.select("doc_id", "text"), gram_words, run_words, short)
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    runs = F.size(F.filter(gone, lambda j, i: (i == 0) | (j - F.get(gone, i - 1) > 1)))
    text = F.when(F.col("_gone").isNotNull(), _kept_text()).otherwise(text_or_empty("row.text"))
    return cut.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.size(_lines()).cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"),
                      runs.cast("bigint").alias("n_runs"), F.sha2(text, 256).alias("kept_sha256"))
