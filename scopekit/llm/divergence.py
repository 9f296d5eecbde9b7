"""Source divergence audit: how far the word use of the sources of a language lies apart.

Single-pass in-memory indexing. Each task builds postings (language, source, term) -> occurrences and documents in
memory; when BLOCK_POSTINGS are held it gives them out as one term-sorted run and starts anew. The runs go to hash
shards of (language, term), where Spark's external sorter merges them (a heap over spilled and fetched runs), and a
fold over the merged stream sums them into frequencies, holding one term at a time. Terms in fewer than MIN_DOCS
documents of their language go there.

Scores are exact integers: p = 1 + floor(10^9 (n + 2) / (N + 2 V)) for a term's n occurrences among N of V kept terms,
f(p, q) = floor((p - q)^2 / (p + q)). A pair of sources adds f over all V terms; most of them occur in neither or one
source, so the sum starts from V f(zero, zero), a histogram of each source's p gives what its own terms change,
and only terms of both sources need a correction, streamed from the merged postings and summed within the task.

Edge cases: null text, language and source are ''; a document without terms still makes its group occur; repeated rows
are documents of their own; other columns, the id included, are not read; an empty table gives no rows; without kept
terms every pair has value 0; equal values are ranked by the item's UTF-8 bytes; a very long text is
one entry per distinct term. A term's merged postings are read by one task, at most one row for each run and
source of the language; the number of pairs of sources in the result is that of the contract.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scopekit.llm.common import map_batches, slices, text_bytes, text_or_empty, written

MIN_DOCS = 10
BLOCK_POSTINGS = 1_000_000     # postings in a task's memory before a run is given out
PAIR_SUMS = 500_000            # sums of source pairs in a task's memory
TOP_TERMS = 10
UNIT = 1_000_000_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ONE_DOC = 1 << 48             # a posting holds occurrences + documents * _ONE_DOC
_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return _TERM.findall(text.translate(_LOWER))


def _run_of(block: dict) -> "list[pa.RecordBatch]":
    """A block as term-sorted rows; the empty term marks that a group occurs."""
    out = []
    for (lang, source), postings in sorted(block.items()):
        terms = sorted(postings)
        values = [postings[t] for t in terms]
        size = len(terms) + 1
        columns = [pa.array([lang] * size, pa.string()), pa.array([b"", *terms], pa.binary()).cast(pa.string()),
                   pa.array([source] * size, pa.string()), pa.array([0, *(v % _ONE_DOC for v in values)], pa.int64()),
                   pa.array([0, *(v // _ONE_DOC for v in values)], pa.int64())]
        out += [pa.RecordBatch.from_arrays([c.slice(i, 1 << 16) for c in columns], schema=_RUN) for i in range(0, size, 1 << 16)]
    return out


def term_runs(docs: DataFrame, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(lang, term, source, n, docs): the term-sorted runs of all tasks."""
    def run(batches):
        block, held = {}, 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts, langs, sources = text_bytes(part.column("text")), part.column("lang").to_pylist(), part.column("source").to_pylist()
                for text, lang, source in zip(texts, langs, sources):
                    postings = block.get((lang, source))
                    if postings is None:
                        postings = block[lang, source] = {}
                        held += 1
                    held -= len(postings)
                    for term, n in Counter(terms_of(text)).items():
                        postings[term] = postings.get(term, 0) + n + _ONE_DOC
                    held += len(postings)
                    if held >= block_postings:
                        yield from _run_of(block)
                        block, held = {}, 0
        yield from _run_of(block)
    return map_batches(docs.select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")]), run,
                       "lang string, term string, source string, n bigint, docs bigint")


def _starts(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Positions at which one of the columns changes, the first row included."""
    changed = np.zeros(max(0, table.num_rows - 1), bool)
    for name in names:
        col = table.column(name).combine_chunks()
        changed |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(changed) + 1)) if table.num_rows else np.zeros(0, np.int64)


def _whole_terms(batches, shrink=lambda table: table):
    """Tables that end where a term ends, from batches sorted by (lang, term); ``shrink`` is applied to a term's rows so far."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        starts = _starts(table, ("lang", "term"))
        if len(starts) > 1:
            yield table.slice(0, starts[-1])
        rest = shrink(table.slice(starts[-1])) if len(starts) else None
    if rest is not None and rest.num_rows:
        yield rest


def _merged(table: pa.Table) -> pa.Table:
    """Sorted rows with those of one (lang, term, source) added up."""
    starts = _starts(table, ("lang", "term", "source"))
    first = table.take(pa.array(starts))
    sums = [pa.array(np.add.reduceat(table.column(c).to_numpy(), starts)) for c in ("n", "docs")]
    return pa.table([first.column("lang"), first.column("term"), first.column("source"), *sums], schema=_RUN)


def frequencies(runs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Merged runs: (lang, term, source, n, total, first) of the kept terms, total being the term's occurrences in the
    language and first true in one row of each term; and a row of the empty term for every group that occurs."""
    def fold(batches):
        for table in _whole_terms(batches, _merged):
            table = _merged(table)
            starts = _starts(table, ("lang", "term"))
            sizes = np.diff(np.append(starts, table.num_rows))
            marks = pc.equal(table.column("term"), "").to_numpy()[starts]
            kept = np.repeat(marks | (np.add.reduceat(table.column("docs").to_numpy(), starts) >= min_docs), sizes)
            total = np.repeat(np.add.reduceat(table.column("n").to_numpy(), starts), sizes)
            first = np.zeros(table.num_rows, bool)
            first[starts] = ~marks
            out = table.drop_columns(["docs"]).append_column("total", pa.array(total)).append_column("first", pa.array(first))
            yield from out.filter(pa.array(kept)).to_batches(max_chunksize=1 << 16)
    merged = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return map_batches(merged, fold, "lang string, term string, source string, n bigint, total bigint, first boolean")


def _share(n, total, kept):
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), null without kept terms."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(19, 0)) * {UNIT}BD) DIV nullif(CAST({total} + 2 * {kept} AS DECIMAL(19, 0)), 0)")


def _gap(p, q):
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q}))")


def group_statistics(freq: DataFrame) -> DataFrame:
    """(lang, source, kept, zero, lang_n, group_n): one row per group that occurs; zero is p of a term that it lacks."""
    groups = freq.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count_if("first").alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.sum("firsts").alias("kept"))
    both = groups.join(langs, "lang")
    return both.select("lang", "source", "kept", _share("0", "group_n", "kept").alias("zero"), "lang_n", "group_n")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_corrections(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): for terms of both sources, what their two single changes leave out; source < item.
    Sums are partial (one per task and pair, or more)."""
    def rows(sums: dict):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)),
                                           pa.array([sums[k] for k in keys], pa.int64())], names=["lang", "source", "item", "value"])

    def run(batches):
        sums: dict = {}
        for table in _whole_terms(batches):
            starts = _starts(table, ("lang", "term"))
            sizes = np.diff(np.append(starts, table.num_rows))
            left = np.repeat(sizes, sizes) - (np.arange(table.num_rows) - np.repeat(starts, sizes))   # rows of the term from here on
            p, zero = table.column("p").to_numpy(), table.column("zero").to_numpy()
            lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            code = lang.indices.to_numpy().astype(np.int64) * len(sources) + source.indices.to_numpy()
            groups = len(langs) * len(sources)
            for step in range(1, int(sizes.max())):          # each row with the one ``step`` rows later in its term
                i = np.flatnonzero(left > step)
                j = i + step
                value = _gaps(p[i], p[j]) - _gaps(p[i], zero[j]) - _gaps(zero[i], p[j]) + _gaps(zero[i], zero[j])
                pairs, where = np.unique(code[i] * groups + code[j], return_inverse=True)
                added = np.zeros(len(pairs), np.int64)
                np.add.at(added, where, value)
                for pair, x in zip(pairs.tolist(), added.tolist()):
                    a, b = divmod(pair, groups)
                    key = (langs[a // len(sources)], sources[a % len(sources)], sources[b % len(sources)])
                    sums[key] = sums.get(key, 0) + x
                if len(sums) >= PAIR_SUMS:
                    yield rows(sums)
                    sums = {}
        yield rows(sums)
    ordered = postings.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return map_batches(ordered, run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from every other one of its language ('pair'),
    and the terms that set it apart from its language most ('term', at most TOP_TERMS)."""
    freq = written(frequencies(term_runs(docs, block_postings), min_docs), "term-frequencies")
    stats = written(group_statistics(freq), "source-statistics")
    postings = freq.where("term <> ''").join(stats, ["lang", "source"]).select(
        "lang", "term", "source", _share("n", "group_n", "kept").alias("p"), "zero", _share("total", "lang_n", "kept").alias("q"))
    shares = written(postings, "term-shares")
    key = ["lang", "source"]

    a, b = stats.alias("a"), stats.alias("b")
    other = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))
    base = a.join(b, other).select("a.lang", "a.source", F.col("b.source").alias("item"),
                                   F.coalesce(F.col("a.kept") * _gap("a.zero", "b.zero"), F.lit(0).cast("bigint")).alias("value"))
    own = shares.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("times")).alias("a")
    single = own.join(b, other).select("a.lang", "a.source", F.col("b.source").alias("item"),
                                       (F.col("times") * (_gap("a.p", "b.zero") - _gap("a.zero", "b.zero"))).alias("value"))
    parts = single.unionByName(pair_corrections(shares)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = parts.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(parts).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    pairs = pairs.select(*key, F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = shares.where("p > q").select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
