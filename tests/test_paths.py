import os

from scopekit.functions import paths as PF

SHAPES = ["pdfs/12.pdf", "outputs/Mixtral-8x7B-Instruct-v0.1/5.json", "/a/b/c.tar.gz", "runs/7/", "plain",
          "models/Mixtral-8x7B-Instruct-v0.1", "a..b", "dir.with.dots/file", "x/file."]


def test_path_stem_matches_python(spark):
    df = spark.createDataFrame([(p,) for p in SHAPES], "p string")
    got = {r.p: r.s for r in df.select("p", PF.path_stem("p").alias("s")).collect()}
    expect = {p: os.path.splitext(os.path.basename(os.path.normpath(p)))[0] for p in SHAPES}
    assert got == expect


def test_run_name(spark):
    df = spark.createDataFrame([("models/Mistral-7B-Instruct-v0.2", ""), ("models/m/", "lora/x")], "p string, l string")
    assert [r[0] for r in df.select(PF.run_name("p", "l")).collect()] == ["Mistral-7B-Instruct-v0.2", "m-lora"]


def test_location_kind(spark):
    df = spark.createDataFrame([("https://x/y.pdf",), ("FTP://h/f",), ("pdfs/1.pdf",), ("s3://b/k",), ("file:/a",)], "u string")
    assert [r[0] for r in df.select(PF.location_kind("u")).collect()] == ["remote", "remote", "local", "unsupported", "local"]
