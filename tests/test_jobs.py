import os

from pyspark.sql import functions as F

from scopekit.operators import batch as B
from scopekit.plans import fixtures as FX
from scopekit.plans import jobs
from scopekit.session import shared_dir
from scopekit.streaming.collector import collect_outputs_incrementally, read_collected
from tests.conftest import SF_SMALL


def _local(uri):
    return uri[len("file:"):] if uri.startswith("file:") else uri


def test_extraction_resumes(spark):
    pages = FX.report_pages(spark, SF_SMALL)
    ids = FX.documents(spark, SF_SMALL, "doc_id")
    prompt_dir, out_dir = shared_dir(spark, "prompts"), shared_dir(spark, "records")
    jobs.build_prompt_table(pages, ids, prompt_dir, mode="text")
    n_docs = ids.count()
    first = jobs.run_extraction(spark, prompt_dir, out_dir, "echo", B.chunk_echo_scorer)
    second = jobs.run_extraction(spark, prompt_dir, out_dir, "echo", B.chunk_echo_scorer)
    assert (first, second) == (n_docs, 0)
    got = spark.read.parquet(out_dir)
    assert got.count() == n_docs and got.select("id").distinct().count() == n_docs
    assert set(r.status for r in got.select("status").distinct().collect()) <= {"ok", "failed", "no_relevant_pages",
                                                                                "over_budget"}


def test_evaluate_to_table(spark):
    out = shared_dir(spark, "metrics")
    t = jobs.evaluate_to_table(spark, FX.predictions(spark, SF_SMALL), FX.ground_truth(spark, SF_SMALL), out)
    csv = spark.read.option("header", True).csv(out)
    assert csv.count() == t.count() == 12
    assert all(len(r.scope_1.split(".")[1]) == 2 for r in csv.collect())


def test_training_set_jsonl(spark):
    out = shared_dir(spark, "dpo")
    chat = FX.chat(spark, SF_SMALL).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    jobs.write_training_set(chat, out, "dpo")
    back = spark.read.schema("prompt string, chosen string, rejected string").json(out)
    assert back.count() == chat.count()
    assert back.where(F.col("rejected").startswith('{"scope_1":')).count() == chat.count()


def test_streaming_collector_is_incremental(spark):
    src = _local(shared_dir(spark, "outputs-src"))
    os.makedirs(src)
    good = '{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[4,4]}'
    for i, text in enumerate([good, good + "</s>", "broken"]):
        with open(os.path.join(src, f"doc{i}.json"), "w") as f:
            f.write(text)
    table, ckpt = shared_dir(spark, "collected"), shared_dir(spark, "collect-ckpt")
    collect_outputs_incrementally(spark, src, table, "m", ckpt)
    got = {r.id: (r.status, r.scope_1, r.sources) for r in read_collected(spark, table).collect()}
    assert got == {"doc0": ("ok", 1, [4]), "doc1": ("ok", 1, [4]), "doc2": ("failed", -1, [-1])}
    with open(os.path.join(src, "doc3.json"), "w") as f:
        f.write('{"scope_1":2000000000,"scope_2":-7,"scope_3":null,"sources":[]}')
    collect_outputs_incrementally(spark, src, table, "m", ckpt)
    got = {r.id: (r.status, r.scope_1, r.scope_2) for r in read_collected(spark, table).collect()}
    assert len(got) == 4 and got["doc3"] == ("ok", 1000000000, -1)
    assert collect_outputs_incrementally(spark, src, table, "n/2") == 1      # its own default checkpoint
    assert collect_outputs_incrementally(spark, src, table, "n/2") == 0
    assert collect_outputs_incrementally(spark, src, table, "m", shared_dir(spark, "again"), max_files_per_trigger=1) == 4
    rows = read_collected(spark, table)
    assert rows.count() == 8 and rows.select("model", "id").distinct().count() == 8


def test_streaming_extraction_is_incremental(spark):
    from scopekit.streaming.scoring import extract_incrementally
    src = _local(shared_dir(spark, "docs-src"))
    os.makedirs(src)
    docs = {"a": "intro\fOur Scope 1 total\fend", "b": "nothing here", "c": "scope two\fscope 3"}
    for k, v in docs.items():
        with open(os.path.join(src, f"{k}.txt"), "w") as f:
            f.write(v)
    out, ckpt = shared_dir(spark, "extract-out"), shared_dir(spark, "extract-ckpt")
    assert extract_incrementally(spark, src, out, "echo", B.chunk_echo_scorer, ckpt, mode="text") == 3
    got = {r.id: (r.status, r.scope_1, r.sources) for r in read_collected(spark, out).collect()}
    assert got == {"a": ("ok", 1, [1]), "b": ("no_relevant_pages", None, []), "c": ("ok", 2, [0, 1])}
    with open(os.path.join(src, "d.txt"), "w") as f:
        f.write("SCOPES one")
    assert extract_incrementally(spark, src, out, "echo", B.chunk_echo_scorer, ckpt, mode="text") == 1
    assert read_collected(spark, out).count() == 4
    assert extract_incrementally(spark, src, out, "other", B.chunk_echo_scorer, mode="text") == 4
    assert extract_incrementally(spark, src, out, "other", B.chunk_echo_scorer, mode="text") == 0
    assert read_collected(spark, out).groupBy("model").count().where("count = 4").count() == 2


def test_verify_documents_from_files(spark):
    import hashlib
    store = _local(shared_dir(spark, "store"))
    os.makedirs(store)
    contents = {"a": b"first", "b": b"second"}
    for k, v in contents.items():
        with open(os.path.join(store, f"{k}.pdf"), "wb") as f:
            f.write(v)
    man = shared_dir(spark, "manifest-in")
    spark.createDataFrame([("a", "u", hashlib.sha256(b"first").hexdigest(), 1), ("b", "u", "00", 2),
                           ("c", "u", "11", 3), ("d", "u", None, 4)],
                          "id string, url string, sha256 string, extra int").write.parquet(man)
    got = {r.id: r.status for r in jobs.verify_documents(spark, man, store + "/*.pdf").collect()}
    assert got == {"a": "ok", "b": "conflict", "c": "missing", "d": "missing"}


def test_collect_output_dir(spark):
    src = _local(shared_dir(spark, "json-outputs"))
    os.makedirs(src)
    files = {"r1": '{"scope_1": 5, "scope_2": null, "scope_3": 2000000000, "sources": [3, 3]}',
             "r2": '{"scope_1":-1,"scope_2":-1,"scope_3":-1,"sources":[-1]}', "r3": "not json"}
    for k, v in files.items():
        with open(os.path.join(src, f"{k}.json"), "w") as f:
            f.write(v)
    table = shared_dir(spark, "pred-table")
    jobs.collect_output_dir(spark, src, "m-x", table)
    got = {r.id: (r.model, r.status, r.scope_1, r.scope_3, r.sources) for r in spark.read.parquet(table).collect()}
    assert got == {"r1": ("m-x", "ok", 5, 1000000000, [3]), "r2": ("m-x", "ok", -1, -1, [-1]),
                   "r3": ("m-x", "failed", -1, -1, [-1])}
    jobs.collect_output_dir(spark, src, "m-y", table)
    jobs.collect_output_dir(spark, src, "m-x", table)
    assert sorted((r.model, r.id) for r in spark.read.parquet(table).collect()) == [
        (m, i) for m in ("m-x", "m-y") for i in ("r1", "r2", "r3")]


def test_sliced_extraction_keeps_finished_slices(spark):
    prompts, out = shared_dir(spark, "slice-prompts"), shared_dir(spark, "slice-records")
    spark.range(40).selectExpr("id AS doc_id", "'ok' AS status", "concat('<CHUNK id=\"', id, '\">') AS prompt").write.parquet(prompts)
    jobs.run_extraction(spark, prompts, out, "m", B.chunk_echo_scorer, slices=4, tasks=3)
    assert spark.read.parquet(out).count() == 40
    lost = spark.read.parquet(out).where("pmod(xxhash64(id), 4) < 2")
    partly = shared_dir(spark, "slice-part")
    lost.write.partitionBy("model").parquet(partly)
    before = lost.count()
    assert jobs.run_extraction(spark, prompts, partly, "m", B.chunk_echo_scorer, slices=4) == 40 - before
    assert spark.read.parquet(partly).select("id").distinct().count() == 40


def test_prompt_statistics_and_training_set_from_files(spark):
    from scopekit import fixed_values as FV
    pdir, rdir = _local(shared_dir(spark, "prompt-cache")), _local(shared_dir(spark, "responses"))
    os.makedirs(pdir)
    os.makedirs(rdir)
    pre, suf = FV.CHAT_WRAPPERS["mistral"]
    cached = {"1": FV.INSTRUCTION + "\n" + "<CHUNK>cached pages</CHUNK>\n", "2": FV.INSTRUCTION + "\n"}
    for k, v in cached.items():
        with open(os.path.join(pdir, f"{k}.txt"), "w") as f:
            f.write(pre + v + suf + FV.ANSWER_START + "\n")
    resp = {"1": '{"scope_1":1,"scope_2":null,"scope_3":null,"sources":[0]}', "2": '{"a":1}', "3": '{"b":2}',
            "4": FV.STUB_JSON}
    for k, v in resp.items():
        with open(os.path.join(rdir, f"{k}.json"), "w") as f:
            f.write(v)
    stats = jobs.prompt_statistics(spark, pdir).first()
    assert stats.n_prompts == 2 and stats.max_tokens >= stats.min_tokens
    pages = spark.createDataFrame([(3, 0, "Scope 1 here"), (3, 1, "x"), (4, 0, "Scope 2")],
                                  "doc_id bigint, page_no int, page_text string")
    out = shared_dir(spark, "sft-out")
    jobs.training_set_from_files(spark, rdir, pdir, pages, out, mode="text")
    got = {r.completion: r.prompt for r in spark.read.schema("prompt string, completion string").json(out).collect()}
    # 1: cached prompt; 2: cached but empty -> dropped; 3: rebuilt from pages; 4: stub -> dropped
    assert set(got) == {resp["1"], resp["3"]}
    assert got[resp["1"]] == cached["1"]
    assert got[resp["3"]] == FV.INSTRUCTION + "\n" + '<CHUNK id="0">\nScope 1 here\n</CHUNK>'
