import json
import os


from scopekit.session import shared_dir
from scopekit.sources import manifest as SM
from scopekit.sources import outputs as SO
from scopekit.operators import manifest as M


def local_dir(spark, name):
    """A shared dir usable with plain file I/O (tests run on one machine)."""
    uri = shared_dir(spark, name)
    path = uri[len("file:"):] if uri.startswith("file:") else uri
    os.makedirs(path)
    return path


def test_json_output_directory(spark):
    d = local_dir(spark, "jsondir")
    records = {"r1": {"scope_1": 5, "scope_2": None, "scope_3": 7, "sources": [1, 2]},
               "r.2": {"scope_1": None, "scope_2": None, "scope_3": None, "sources": []}}
    for k, v in records.items():
        with open(os.path.join(d, f"{k}.json"), "w") as f:
            json.dump(v, f, indent=2)
    for name, text in {"a b#1+2%20": json.dumps(records["r1"]), "broken": "{"}.items():
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            f.write(text)
    got = {r.id: (r.status, r.scope_1, r.scope_3, r.sources) for r in SO.read_json_outputs(spark, d).collect()}
    assert got == {"r1": ("ok", 5, 7, [1, 2]), "r.2": ("ok", None, None, []), "a b#1+2%20": ("ok", 5, 7, [1, 2]),
                   "broken": ("failed", -1, -1, [-1])}


def test_text_files_and_binary_digests(spark):
    import hashlib
    d = local_dir(spark, "textdir")
    payload = {"a": "line1\nline2\n", "b": "other"}
    for k, v in payload.items():
        with open(os.path.join(d, f"{k}.txt"), "w") as f:
            f.write(v)
    got = {r.id: r.text for r in SO.read_text_files(spark, d).collect()}
    assert got == payload
    digests = {r.id: r.sha256 for r in SM.binary_digests(spark, d + "/*.txt").collect()}
    assert digests == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in payload.items()}


def test_verify_manifest_statuses(spark):
    man = spark.createDataFrame([("a", "u", "AA"), ("b", "u", "zz"), ("c", "u", None), ("d", "u", "aa")],
                                "id string, url string, sha256 string")
    dig = spark.createDataFrame([("a", "aa"), ("b", "bb"), ("c", "cc")], "id string, sha256 string")
    got = {r.id: r.status for r in M.verify_manifest(man, dig).collect()}
    assert got == {"a": "ok", "b": "conflict", "c": "unchecked", "d": "missing"}
    assert sorted(r.id for r in M.failed_ids(M.verify_manifest(man, dig)).collect()) == ["b", "d"]


def test_external_predictions_model_from_file_stem(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq
    d = local_dir(spark, "preds")
    for name in ("Mixtral-8x7B-Instruct-v0.1", "m"):
        t = pa.table({"id": ["1", "2"], "scope_1": [1, None], "scope_2": [2, 3], "scope_3": [None, None],
                      "sources": [[1], []]})
        pq.write_table(t, os.path.join(d, f"{name}.parquet"))
    got = sorted({r.model for r in SO.read_external_predictions(spark, d).collect()})
    assert got == ["Mixtral-8x7B-Instruct-v0.1", "m"]


def test_classify_locations(spark):
    locs = spark.createDataFrame([("a", "pdfs/a.pdf"), ("b", "pdfs/b.pdf"), ("c", "https://x/c.pdf"), ("d", "s3://b/d")],
                                 "id string, location string")
    stored = spark.createDataFrame([("pdfs/a.pdf",)], "path string")
    got = {r.id: r.kind for r in M.classify_locations(locs, stored).collect()}
    assert got == {"a": "file", "b": "error", "c": "remote", "d": "error"}


def test_predictions_of_drifting_types(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq
    d = local_dir(spark, "drift")
    files = {"ints": {"id": ["1", "2"], "scope_1": [1, None], "scope_2": [2, 3], "scope_3": [None, 2 ** 40], "sources": [[1], []]},
             "doubles": {"id": ["1", "2"], "scope_1": [1.0, float("nan")], "scope_2": [2.9, 1e30], "scope_3": [None, -1.0], "sources": [[1.0], None]},
             "few.v2": {"id": [1, 2], "scope_2": [7, 8], "extra": ["x", "y"]}}
    for name, columns in files.items():
        pq.write_table(pa.table(columns), os.path.join(d, f"{name}.parquet"))
    got = {(r.model, r.id): (r.scope_1, r.scope_2, r.scope_3, r.sources) for r in SO.read_external_predictions(spark, d).collect()}
    assert got == {("ints", "1"): (1, 2, None, [1]), ("ints", "2"): (None, 3, 2 ** 40, []),
                   ("doubles", "1"): (1, 2, None, [1]), ("doubles", "2"): (None, None, -1, None),
                   ("few.v2", "1"): (None, 7, None, None), ("few.v2", "2"): (None, 8, None, None)}


def test_evaluation_over_a_directory_with_its_options(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from scopekit.plans import jobs
    d, out = local_dir(spark, "eval"), shared_dir(spark, "eval-out")
    pq.write_table(pa.table({"id": ["1", "2", "9"], "scope_1": [10, -1, 5], "scope_2": [1, -1, 1], "scope_3": [1, -1, 1],
                             "sources": [[5], [-1], [1]]}), os.path.join(d, "m.parquet"))
    truth = spark.createDataFrame([("1", 10.0, None, 2.0, 3.0, [4], [5], None, None), ("2", 1.0, 1.0, 1.0, 1.0, [1], None, None, [])],
                                  "id string, scope_1 double, scope_2_market double, scope_2_location double, scope_3 double, scope_1_page array<int>, "
                                  "scope_2_market_page array<int>, scope_2_location_page array<int>, scope_3_page array<int>")

    def strict(**options):
        return jobs.evaluate_directory(spark, d, truth, out, **options).where("mode = 'strict'").first()
    row = strict()
    assert (row.scope_1, row.scope_2, row.scope_3, row.sources) == (1.0, 0.0, 0.0, 0.0)
    assert [(r.model, r.id) for r in spark.read.parquet(out + "-unmatched").collect()] == [("m", "9")]
    assert strict(which="any").sources == 0.5 and strict(which="any", exclude_failed=True).sources == 1.0
    assert strict(keys=("scope_1",)).average is None and "scope_3" not in strict(keys=("scope_1",))


def test_files_in_name_order_are_sorted(spark):
    from pyspark.sql import functions as F

    from scopekit.sources import sinks
    df = spark.range(5000).select(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(900))).alias("id"), F.lit("m").alias("model"))
    for files in (1, 5):
        path = shared_dir(spark, "ordered")
        sinks.write_jsonl(df, path, order_by="id", files=files)
        local = path[len("file:"):] if path.startswith("file:") else path
        parts = sorted(p for p in os.listdir(local) if p.startswith("part-"))
        ids = [json.loads(line)["id"] for p in parts for line in open(os.path.join(local, p))]
        assert len(parts) == files and len(ids) == 5000 and ids == sorted(ids)


def test_large_ordered_tables_get_more_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from scopekit.sources import sinks
    monkeypatch.setattr(sinks, "SORT_ROWS", 100)
    df = spark.range(4000).select(F.concat(F.lit("m"), F.col("id") % 2).alias("model"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).cast("string"), 9, "0").alias("id"))
    path = shared_dir(spark, "ordered-large")
    sinks.write_predictions(df, path, order_by="id", files=7)
    read = spark.read.parquet(path).select("model", "id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).collect()
    per_file = {}
    for r in read:
        per_file[r.model, r.file] = per_file.get((r.model, r.file), 0) + 1
    assert len(read) == 4000 and len(per_file) >= 40 and max(per_file.values()) <= 300
    for model in ("m0", "m1"):
        ids = [r.id for r in sorted((r for r in read if r.model == model), key=lambda r: (r.file, r.row))]
        assert len(ids) == 2000 and ids == sorted(ids)


def test_evaluation_joins_bounded_parts(spark, monkeypatch):
    """The tasks of the evaluation's joins follow the rows, and a union of models is shuffled as one table."""
    from pyspark.sql import functions as F

    from scopekit.operators import evaluate as E
    from scopekit.plans import jobs
    monkeypatch.setattr(E, "JOIN_ROWS", 50)
    truth = spark.range(1000).select(F.col("id").cast("string").alias("id"), *[F.lit(1.0).alias(c) for c in ("scope_1", "scope_2_market", "scope_2_location", "scope_3")],
                                     *[F.array(F.lit(1)).alias(f"{c}_page") for c in ("scope_1", "scope_2_market", "scope_2_location", "scope_3")])
    one = spark.range(1100).select(F.when(F.col("id") < 1090, F.col("id")).cast("string").alias("id"), *[F.lit(1).cast("bigint").alias(c) for c in ("scope_1", "scope_2", "scope_3")],
                                   F.array(F.lit(1).cast("bigint")).alias("sources"))
    pred = one.withColumn("model", F.lit("a")).unionByName(one.withColumn("model", F.lit("b")))
    out, seen = shared_dir(spark, "bounded"), []
    unmatched = E.unmatched_predictions
    monkeypatch.setattr(E, "unmatched_predictions", lambda p, t: seen.append((p, t)) or unmatched(p, t))
    got = jobs.evaluate_to_table(spark, pred, truth, out).collect()
    assert len(got) == 6 and all((r.scope_1, r.average, r.sources) == (1.0, 1.0, 1.0) for r in got)
    assert spark.read.parquet(out + "-unmatched").count() == 200
    (p, t), = seen
    assert p.rdd.getNumPartitions() == t.rdd.getNumPartitions() == 44
    sizes = [r["count"] for r in p.where("id IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200
    assert unmatched(p, t)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_sketches_merge_to_the_whole(spark):
    from pyspark.sql import functions as F

    from scopekit.operators import prompts as PR
    rows = spark.range(200_000).select((F.col("id") % 40).alias("run"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) * 3.5).cast("int").alias("n"))
    got = PR.merged_stats(PR.prompt_sketches(rows.repartition(6), "run", chars_col="n")).first()
    assert got.n_prompts == 200_000 and abs(got.quantile_tokens - 5000) < 200 and got.min_tokens == 0
    by_run = PR.merged_stats(PR.prompt_sketches(rows, "run", chars_col="n"), "run", quantile=0.9).collect()
    assert len(by_run) == 40 and all(abs(r.quantile_tokens - 9000) < 400 for r in by_run)
