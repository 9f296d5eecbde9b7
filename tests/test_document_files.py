"""Files per document: names, missing and broken files, durable records after crashes and retries, digest rounds."""

import hashlib
import os

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scopekit.operators import batch as B
from scopekit.operators import manifest as M
from scopekit.plans import jobs
from scopekit.session import shared_dir
from scopekit.sources import document_files as DF


def _local(uri):
    return uri[len("file:"):] if uri.startswith("file:") else uri


@pytest.mark.parametrize("doc_id", ["a", "a.b", "a b#1+2%20", "d/e", "..", ".hidden", "_x", "ä€\n", "50%", ""])
def test_file_names_come_back(doc_id):
    name = DF.file_name(doc_id, ".json")
    assert "/" not in name and DF.id_of(f"/x/y.z/{name}") == doc_id
    assert name == ".json" or name[0] not in "._"


def test_files_written_and_read_by_path_table(spark):
    root = shared_dir(spark, "doc-files")
    rows = [("m one", "a b#1+2%20", "x\ny"), ("m one", "_u", "é"), ("two/2", "d/e", ""), ("two/2", "n", None), ("m one", "a b#1+2%20", "x\ny")]
    DF.write_document_files(spark.createDataFrame(rows, "folder string, id string, value string"), root, ".txt")
    folders = spark.createDataFrame([(f"{root}/m one",), (f"{root}/two%2F2",), (f"{root}/none",)], "folder string")
    found = DF.list_files(spark, folders, ".txt")
    assert {r.id: r.length for r in found.collect()} == {"a b#1+2%20": 3, "_u": 2, "d/e": 0, "n": 0}
    with open(_local(root) + "/broken.txt", "wb") as f:
        f.write(b"\xff\xfe")
    extra = spark.createDataFrame([("broken", root + "/broken.txt"), ("gone", root + "/gone.txt"), ("odd", None)], "id string, path string")
    table = shared_dir(spark, "doc-paths")
    DF.write_path_table(found.select("id", "path").unionByName(extra), table, paths_per_file=2)
    df = DF.read_document_files(spark, table, "text")
    got = {r.id: (r.text, r.error) for r in df.collect()}
    assert got.pop("odd")[0] is None
    assert got == {"a b#1+2%20": ("x\ny", None), "_u": ("é", None), "d/e": ("", None), "n": ("", None),
                   "broken": (None, "not UTF-8"), "gone": (None, "missing")}
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 3          # several tasks


def test_empty_path_table(spark):
    table = shared_dir(spark, "no-paths")
    DF.write_path_table(spark.createDataFrame([], "id string, path string"), table)
    assert DF.read_document_files(spark, table).collect() == []


def _prompts(spark, n=60, files=6):
    path = shared_dir(spark, "crash-prompts")
    (spark.range(0, n, 1, files).selectExpr("id AS doc_id", "'ok' AS status", "concat('<CHUNK id=\"', id, '\">') AS prompt")
     .write.parquet(path))
    return path


def test_records_survive_a_crash_with_default_arguments(spark):
    """The scorer's process dies on one prompt; the rows of all finished tasks are kept, once, and only the rest is scored again."""
    prompts, out = _prompts(spark), shared_dir(spark, "crash-records")

    def dying(batch: pd.Series) -> pd.Series:
        if batch.str.contains('"59"').any():
            import time
            time.sleep(8)
            os._exit(1)
        return B.chunk_echo_scorer(batch)
    with pytest.raises(Exception):
        jobs.run_extraction(spark, prompts, out, "m", dying)
    kept = spark.read.parquet(out)
    n = kept.count()
    assert 0 < n < 60 and kept.select("id").distinct().count() == n and kept.where("id = 59").count() == 0
    assert jobs.run_extraction(spark, prompts, out, "m", B.chunk_echo_scorer) == 60 - n
    done = spark.read.parquet(out)
    assert done.count() == 60 and done.select("model", "id").distinct().count() == 60
    assert jobs.run_extraction(spark, prompts, out, "m", B.chunk_echo_scorer) == 0


class _Context:
    def __init__(self, partition, attempt):
        self.partitionId, self.attemptNumber = lambda: partition, lambda: attempt


def _batch(ids, model="m/1"):
    return pa.RecordBatch.from_pydict({"model": [model] * len(ids), "id": ids, "scope_1": ids})


def test_a_retried_task_skips_what_its_first_attempt_committed(tmp_path, monkeypatch):
    import pyarrow.parquet as pq
    from pyspark import TaskContext
    writer = DF.RecordsWriter({"path": str(tmp_path), "rows": "2", "seconds": "1000"})

    def batches(fail_after):
        for i in range(0, 6, 2):
            if i >= fail_after:
                raise RuntimeError("lost")
            yield _batch([i, i + 1])
    monkeypatch.setattr(TaskContext, "get", lambda: _Context(3, 0))
    with pytest.raises(RuntimeError):
        writer.write(batches(4))
    monkeypatch.setattr(TaskContext, "get", lambda: _Context(3, 1))
    message = writer.write(batches(99))
    monkeypatch.setattr(TaskContext, "get", lambda: _Context(4, 0))
    other = writer.write(iter([_batch([10, 11, 12])]))
    monkeypatch.setattr(TaskContext, "get", lambda: _Context(4, 2))          # an attempt that nobody names
    writer.write(iter([_batch([20])]))
    writer.commit([message, other])
    rows = [i for p in sorted((tmp_path / "model=m%2F1").iterdir()) for i in pq.read_table(p).column("id").to_pylist()]
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 10, 11, 12]


def test_old_rows_are_committed_by_time(tmp_path, monkeypatch):
    from pyspark import TaskContext
    writer = DF.RecordsWriter({"path": str(tmp_path), "rows": "1000", "seconds": "0"})
    monkeypatch.setattr(TaskContext, "get", lambda: _Context(0, 0))
    assert len(writer.write(iter([_batch([1]), _batch([2]), _batch([])])).files) == 2


def test_digest_rounds_hash_only_what_changed(spark):
    store = _local(shared_dir(spark, "round-store"))
    os.makedirs(store + "/a")
    contents = {"x": b"one", "y": b"two", "z": b"three"}
    for k, v in contents.items():
        with open(f"{store}/a/{k}.pdf", "wb") as f:
            f.write(v)
    folders, state = spark.createDataFrame([(store + "/a",)], "folder string"), shared_dir(spark, "round-state")
    first = jobs.digest_round(spark, folders, state)
    assert {r.id: (r.sha256, r.hashed) for r in first.collect()} == {k: (hashlib.sha256(v).hexdigest(), True) for k, v in contents.items()}
    assert not any(r.hashed for r in jobs.digest_round(spark, folders, state).collect())
    with open(f"{store}/a/y.pdf", "wb") as f:
        f.write(b"changed")
    os.remove(f"{store}/a/z.pdf")
    with open(f"{store}/a/n.pdf", "wb") as f:
        f.write(b"new")
    third = {r.id: (r.sha256, r.hashed) for r in jobs.digest_round(spark, folders, state).collect()}
    assert third == {"x": (hashlib.sha256(b"one").hexdigest(), False), "y": (hashlib.sha256(b"changed").hexdigest(), True),
                     "n": (hashlib.sha256(b"new").hexdigest(), True)}


def test_an_unfinished_round_is_passed_over(spark):
    state = _local(shared_dir(spark, "half-state"))
    os.makedirs(f"{state}/round=7")
    assert jobs._last_round(spark, state) is None
    store = _local(shared_dir(spark, "half-store"))
    os.makedirs(store)
    folders = spark.createDataFrame([(store,)], "folder string")
    assert jobs.digest_round(spark, folders, state).collect() == [] and jobs._last_round(spark, state) == 0


def test_round_transitions(spark):
    man = spark.createDataFrame([("a", "u", "AA"), ("b", "u", "bb"), ("c", "u", "cc"), ("d", "u", "dd"), ("e", "u", None), ("f", "u", "ff")],
                                "id string, url string, sha256 string")
    stored = spark.createDataFrame([("a", "aa"), ("b", "xx"), ("e", "ee"), ("f", "old")], "id string, sha256 string")
    planned = M.plan_round(man, stored)
    assert {r.id: (r.status, r.action) for r in planned.collect()} == {
        "a": ("ok", "keep"), "b": ("conflict", "fetch"), "c": ("missing", "fetch"), "d": ("missing", "fetch"),
        "e": ("unchecked", "fetch"), "f": ("conflict", "fetch")}
    fetched = spark.createDataFrame([("b", "BB"), ("c", "zz"), ("e", "new"), ("f", None)], "id string, sha256 string")
    assert {r.id: (r.outcome, r.saved) for r in M.finish_round(planned, fetched).collect()} == {
        "a": ("ok", False), "b": ("ok", True), "c": ("failed", False), "d": ("failed", False), "e": ("ok", True), "f": ("failed", False)}
