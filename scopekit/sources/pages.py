"""Page source: one row per page (doc_id, page_no, page_text), from text values or from files of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES = 32 << 20      # bytes of a file that one task reads at a time
BATCH_BYTES = 4 << 20       # page text handed to Spark at once
BLOCKS_PER_SUM = 1024       # blocks of a file whose line counts are added up in one window

PAGE_MODES = ("xhtml", "text")


def check_mode(mode: str) -> str:
    """The extraction mode is validated before any plan is built."""
    if mode not in PAGE_MODES:
        raise ValueError("mode must be xhtml or text")
    return mode


def split_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                separator: str = "\n") -> DataFrame:
    """Documents whose pages are separated by a line break, as ordered pages with a 0-based number.

    A narrow transformation (no shuffle): each document row expands in place.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), separator, -1)).alias("page_no", "page_text"),
    )


def file_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, path, length, start) of all blocks of the files (id, path, length); an empty file is one block."""
    last = F.expr(f"greatest(length - 1, 0) DIV {int(block_bytes)}")
    blocks = files.select("id", "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    return blocks.select("id", "path", "length", (F.col("block") * int(block_bytes)).alias("start"))


def _spread(blocks: DataFrame) -> DataFrame:
    from scopekit.operators.batch import ship_by_value
    from scopekit.session import task_count
    ship_by_value()
    return blocks.repartition(task_count(blocks.sparkSession), "path", "start")


def _opened(path):
    from scopekit.sources.document_files import file_system
    system, where = file_system(path)
    return system.open_input_file(where)


def line_counts(blocks: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks with ``lines``, the number of line breaks in each."""
    def run(batches):
        for batch in batches:
            counts = []
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with _opened(path) as f:
                    f.seek(start)
                    counts.append(f.read(block_bytes).count(b"\n"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "lines"])
    return _spread(blocks).mapInArrow(run, "id string, path string, length bigint, start bigint, lines bigint")


def lines_before(counted: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks with ``before``, the line breaks in all earlier blocks of the file: a prefix sum in two levels, so that a file
    of very many blocks is no single window."""
    run = F.expr(f"start DIV {int(block_bytes) * BLOCKS_PER_SUM}")
    rows = counted.withColumn("run", run)
    runs = rows.groupBy("path", "run").agg(F.sum("lines").alias("n"))
    earlier = Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("path", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("path", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("lines").over(inside), F.lit(0)))
    return rows.join(runs, ["path", "run"]).select("id", "path", "length", "start", (F.col("base") + F.col("inner")).alias("before"))


def split_page_files(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, page_no, page_text) of text files (id, path, length) whose pages are separated by line breaks, numbered from
    0 as ``split_pages`` does.

    A file is read in blocks by many tasks, twice: line breaks are counted, summed over earlier blocks, and then each
    task gives out the pages that *begin* in its block with their numbers, reading on past the block's end to finish the
    last one. Memory is one block and the longest page. Bytes that aren't UTF-8 become replacement characters.
    """
    from scopekit.session import shared_dir
    spark = files.sparkSession
    counts = shared_dir(spark, "line-counts")
    line_counts(file_blocks(files, block_bytes), block_bytes).write.parquet(counts)     # a few numbers a block
    numbered = lines_before(spark.read.parquet(counts), block_bytes)

    def pages_of(path, length, start, before):
        """(number, text) of the pages that begin in [start, start + block_bytes), or at the end of the file."""
        end = min(start + block_bytes, length)
        with _opened(path) as f:
            f.seek(max(0, start - 1))
            data = f.read(end - max(0, start - 1))
            at = 0
            if start:
                # the byte before the block tells whether a page begins with it
                first = data.find(b"\n")
                before += first > 0
                at = first + 1
                if first < 0 or at >= len(data) and end < length:
                    return
            if end < length and not data.endswith(b"\n"):
                tail = [data]
                while more := f.read(1 << 20):
                    cut = more.find(b"\n")
                    tail.append(more if cut < 0 else more[:cut + 1])
                    if cut >= 0:
                        break
                data = b"".join(tail)
                if data.endswith(b"\n"):
                    data = data[:-1]          # it ends the last page of this block; the next one begins in another
            elif end < length:
                data = data[:-1]
            lines = data[at:].split(b"\n")
        for i, line in enumerate(lines):
            yield before + i, line.decode("utf-8", "replace")

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "page_no", "page_text"])
        rows, size = [], 0
        for batch in batches:
            for doc_id, path, length, start, before in zip(*(batch.column(c).to_pylist() for c in ("id", "path", "length", "start", "before"))):
                for number, text in pages_of(path, length, start, before):
                    rows.append((doc_id, number, text))
                    size += len(text) + 16
                    if size >= BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)
    return _spread(numbered).mapInArrow(run, "doc_id string, page_no bigint, page_text string")
