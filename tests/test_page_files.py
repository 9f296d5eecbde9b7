"""Pages of files read in blocks: equal to splitting the whole text, at any block size."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scopekit.session import shared_dir
from scopekit.sources import pages as SP

TEXTS = {"empty": "", "break": "\n", "breaks": "\n\n\n", "one": "abc", "end": "abc\n", "two": "abc\nde", "blank": "\nabc\n\nde\n",
         "long": "x" * 50 + "\n" + "y" * 50, "letters": "äöü\n€€\n\U0001F600\nz", "tail": "abcdefgh\n"}


def _files(spark, texts):
    root = shared_dir(spark, "pages")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(local)
    rows = []
    for k, v in texts.items():
        with open(f"{local}/{k}.txt", "wb") as f:
            f.write(v.encode())
        rows.append((k, f"{root}/{k}.txt", len(v.encode())))
    return spark.createDataFrame(rows, "id string, path string, length bigint")


@pytest.mark.parametrize("block", [1, 2, 3, 4, 8, 9, 51, 1000])
def test_pages_do_not_depend_on_blocks(spark, block):
    rnd = random.Random(block)
    texts = TEXTS | {f"r{i}": "".join(rnd.choices("ab\n\né", k=rnd.randrange(60))) for i in range(4)}
    got = {(r.doc_id, r.page_no, r.page_text) for r in SP.split_page_files(_files(spark, texts), block).collect()}
    assert got == {(k, i, line) for k, v in texts.items() for i, line in enumerate(v.split("\n"))}


def test_prefix_sum_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(SP, "BLOCKS_PER_SUM", 4)
    counted = spark.createDataFrame([("a", "p", 1000, i * 10, i % 3) for i in range(40)], "id string, path string, length bigint, start bigint, lines bigint")
    got = {r.start: r.before for r in SP.lines_before(counted, 10).collect()}
    assert got == {i * 10: sum(j % 3 for j in range(i)) for i in range(40)}


def test_a_large_file_is_read_by_many_tasks(spark):
    text = "\n".join(f"page {i} " + "x" * 200 for i in range(100_000))          # 21 MB
    pages = SP.split_page_files(_files(spark, {"big": text}), 1 << 20)
    by_task = pages.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) >= 4 and sum(r["count"] for r in by_task) == 100_000
    assert max(r["count"] for r in by_task) < 60_000
    assert pages.where("page_text NOT LIKE concat('page ', page_no, ' x%')").count() == 0
