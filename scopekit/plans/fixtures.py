"""Tables in the shape the extraction pipeline reads and writes, derived from
the driver's generic tables by fixed rules (the same rules are written in SQL
for the oracle, see ``oracle.py``). Every table grows with its source table.

The modulo rules below define these tables (which documents already have an
output, which prompts are cached, which digests are altered, which outputs are
malformed); they are data, not filters: every query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit.functions.records import record_json
from scopekit.sources.pages import split_pages
from scopekit.sources.tables import read_table

MODELS = 4  # prediction models m0..m3

_WRITTEN: dict[tuple[str, str, str], str] = {}


def materialized(name: str):
    """Write a derived table once per application and read it back as Parquet.

    The derived tables stand in for files the pipeline reads; writing them
    keeps later plans as scans (filters and projections reach the Parquet
    reader) and cuts their lineage. They go to the shared checkpoint folder. Each is made
    from ``spread`` source rows, so no derived row is shuffled or sorted for its file.
    """
    def wrap(build):
        def get(spark: SparkSession, sf: str) -> DataFrame:
            from scopekit.session import app_id, shared_dir
            key = (app_id(spark), sf.rstrip("/"), name)
            path = _WRITTEN.get(key)
            if path is None:
                path = shared_dir(spark, f"table-{name}")
                build(spark, sf).write.mode("overwrite").parquet(path)
                _WRITTEN[key] = path
            return spark.read.parquet(path)
        get.__doc__ = build.__doc__
        get.build = build
        return get
    return wrap


def spread(df: DataFrame) -> DataFrame:
    """Source rows dealt over at least one task per core, as a table on a cluster would be (the driver's small source files are
    single row groups, i.e. single tasks). They are dealt by a hash of the whole row: dealing them round robin would sort
    them first, which spills when the tables are large. Rows that the files already spread stay where they are: no task
    that reads them has twice its even share or more (counted from the files' footers)."""
    from scopekit.session import default_parallelism
    n = default_parallelism(df.sparkSession)
    tasks = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    share = tasks.agg(F.max("rows").alias("largest"), F.sum("rows").alias("total")).first()
    if share["total"] and share["largest"] * n < 2 * share["total"]:
        return df
    return df.repartition(n, F.xxhash64(*df.columns))


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return read_table(spark, sf, "documents", *(cols or ("doc_id", "text")))


@materialized("report_pages")
def report_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page_no, page_text): one page per line; trigger phrases appended by
    the first rule that holds for n = doc_id + page_no."""
    p = split_pages(spread(documents(spark, sf, "doc_id", "text")))
    n = F.col("doc_id") + F.col("page_no")
    suffix = (F.when(n % 5 == 0, F.lit(" Scope 1"))
               .when(n % 7 == 0, F.lit(" SCOPES one and two"))
               .when(n % 11 == 0, F.lit(" s c o p e three"))
               .when(n % 13 == 0, F.lit(" scope-2"))
               .otherwise(F.lit("")))
    return p.select("doc_id", "page_no", F.concat("page_text", suffix).alias("page_text"))


@materialized("html_pages")
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, html): raw web pages; every line break becomes an image followed by tail text."""
    pages = spread(read_table(spark, sf, "pages", "page_id", "html"))
    return pages.select("page_id", F.replace("html", F.lit("<br>"), F.lit('<img src="x">tail')).alias("html"))


@materialized("markup_pages")
def markup_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page_no, page_text): four web pages make a document; each body ends with a paragraph of
    references, by page_id: a term (every third), an escaped and a quoted term, empty elements and an image."""
    pages = spread(read_table(spark, sf, "pages", "page_id", "html"))
    k = F.col("page_id")
    extra = (F.when(k % 3 == 0, F.lit("<p>S&#99;ope&#x20;&#49; &#38; &#x3C;b&#62;</p>"))
              .when(k % 5 == 0, F.lit("<p>&quot;SCOPES&quot; CO&#x2082;<br/>scope&#32;two</p><i />"))
              .otherwise(F.lit('<p>none&#160;<img src="x"/>scope 3</p>')))
    return pages.select(F.expr("page_id DIV 4").alias("doc_id"), (k % 4).cast("int").alias("page_no"),
                        F.concat("html", extra).alias("page_text"))


def odd_markup(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, markup): each page's address in markup with a comment, a CDATA section, an image with content, a processing
    instruction, quoted angle brackets or an unclosed image, by page_id."""
    pages = read_table(spark, sf, "pages", "page_id", "url")
    k, t = F.col("page_id"), F.replace("url", F.lit("&"), F.lit("&amp;"))

    def around(before, after):
        return F.concat(F.lit(before), t, F.lit(after))
    markup = (F.when(k % 6 == 0, around('<div><!-- <img src="a>b">x --><p>', "</p></div>"))
               .when(k % 6 == 1, around('<div class="a>b"><![CDATA[1 < 2 &amp; <img>]]><p>', "</p></div>"))
               .when(k % 6 == 2, around("""<div><img alt="x > y" src='s'>inner <b>bold</b></img>tail<![CDATA[more]]><p>""", "</p>end</div>"))
               .when(k % 6 == 3, around("""<?xml version="1.0"?><div id="old" title='q"r>'><img/>gone<!-- c -->""", "</div>"))
               .when(k % 6 == 4, around('<div lang="en"><p>&lt;&#60;</p><!----><img src="x"/>', "<br/><i/>&#233;</div>"))
               .otherwise(around("<div><p>", "<img src='>'>gone</p>stays<image>x</image></div>")))
    return pages.select("page_id", markup.alias("markup"))


@materialized("ground_truth")
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(read_table(spark, sf, "orders", "o_orderkey", "o_totalprice"))
    k, p = F.col("o_orderkey"), F.col("o_totalprice")

    def val(x, null_mod):
        return F.when(k % null_mod == 0, F.lit(None)).otherwise(F.floor(x)).cast("double")

    def arr(*xs):
        return F.array(*[x.cast("int") for x in xs])

    return o.select(
        k.cast("string").alias("id"),
        val(p, 10).alias("scope_1"),
        val(p / 2, 3).alias("scope_2_market"),
        val(p / 3, 9).alias("scope_2_location"),
        val(p * 10, 4).alias("scope_3"),
        arr(k % 50, k % 50 + 1).alias("scope_1_page"),
        arr(k % 40).alias("scope_2_market_page"),
        arr(k % 30).alias("scope_2_location_page"),
        F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(arr(k % 20)).alias("scope_3_page"),
    )


@materialized("predictions")
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(model, id, scope_1, scope_2, scope_3, sources) for models m0..m3, each a
    rule-based distortion of the truth. The model axis is an ``explode`` of a
    literal array (narrow), not a join. The truth is computed on the way, not written first."""
    gt = ground_truth.build(spark, sf)
    k = F.col("id").cast("bigint")
    g = gt.select(k.alias("k"), "id", "scope_1",
                  F.coalesce("scope_2_market", "scope_2_location").alias("scope_2"), "scope_3",
                  F.explode(F.array(*[F.lit(m) for m in range(MODELS)])).alias("m"))
    g = g.withColumn("h", (F.col("k") * 7 + F.col("m") * 13 * (F.col("k") % (F.col("m") + 2))) % 10)
    h = F.col("h")

    def pv(v):
        v = F.col(v)
        return (F.when(h == 4, F.floor(v * 1.05)).when(h == 5, v * 1000).when(h == 6, F.lit(None))
                 .when(h == 7, F.lit(-1)).when(h == 8, F.floor(v * 1.3)).when(h == 9, v + 1)
                 .otherwise(v)).cast("bigint")

    sources = (F.when(h == 7, F.array(F.lit(-1).cast("bigint")))
                .when(h < 6, F.array((F.col("k") % 50 + 1).cast("bigint"), (F.col("k") % 7).cast("bigint")))
                .otherwise(F.array().cast("array<bigint>")))
    return g.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "id",
                    pv("scope_1").alias("scope_1"), pv("scope_2").alias("scope_2"),
                    pv("scope_3").alias("scope_3"), sources.alias("sources"))


@materialized("raw_responses")
def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """(model, id, seq, response): predictions as the raw text a model would print.

    With r = id * 4 + model number: r%23 prints scope_1 as a float, r%19 six
    distinct sources, r%37 sources null, r%41 a duplicated source, r%31 drops
    the scope_3 key, r%47 adds an unknown key, r%53 prints a scope_2 of 19 digits (which fits 64 bits), r%61 one of 24,
    r%59 six distinct sources of 20 digits, r%71 scope_1 twice (the last one counts), r%67 single quotes; then r%13 cuts
    the closing brace, r%29 appends text, r%43 surrounds with white space, r%17 appends the end marker.
    """
    p = predictions(spark, sf)
    m = F.substring("model", 2, 10).cast("bigint")
    p = p.select("*", m.alias("seq"), (F.col("id").cast("bigint") * 4 + m).alias("r"))
    r = F.col("r")

    def num(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    s1 = F.concat(F.when(r % 71 == 0, F.lit('5,"scope_1":')).otherwise(F.lit("")), num("scope_1"),
                  F.when((r % 23 == 0) & F.col("scope_1").isNotNull(), F.lit(".0")).otherwise(F.lit("")))
    joined = F.array_join("sources", ",")
    s2 = (F.when(r % 53 == 0, F.lit("1000000000000000000")).when(r % 61 == 0, F.lit("-123456789012345678901234"))
           .otherwise(num("scope_2")))
    long_sources = "[" + ",".join(f"1000000000000000000{i}" for i in range(6)) + "]"
    src = (F.when(r % 19 == 0, F.lit("[1,2,3,4,5,6]"))
            .when(r % 59 == 0, F.lit(long_sources))
            .when(r % 37 == 0, F.lit("null"))
            .when((r % 41 == 0) & (F.size("sources") > 0),
                  F.concat(F.lit("["), joined, F.lit(","), F.col("sources")[0].cast("string"), F.lit("]")))
            .otherwise(F.concat(F.lit("["), joined, F.lit("]"))))
    s3 = F.when(r % 31 == 0, F.lit("")).otherwise(F.concat(F.lit(',"scope_3":'), num("scope_3")))
    extra = F.when(r % 47 == 0, F.lit(',"note":"a } {b"')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"scope_1":'), s1, F.lit(',"scope_2":'), s2, s3,
                    F.lit(',"sources":'), src, extra, F.lit("}"))
    body = F.when(r % 67 == 0, F.replace(body, F.lit('"'), F.lit("'"))).otherwise(body)
    staged = p.select("model", "id", "seq", "r", body.alias("body"))
    b = F.col("body")
    cut = F.when(r % 13 == 0, F.lit(1)).otherwise(F.lit(0))

    def piece(mod, text):
        return F.when(r % mod == 0, F.lit(text)).otherwise(F.lit(""))

    response = F.concat(piece(43, " "), b.substr(F.lit(1), F.length(b) - cut), piece(29, " trailing"),
                        piece(43, "\n"), piece(17, "</s>"))
    return staged.select("model", "id", "seq", response.alias("response"))


@materialized("chat")
def chat(spark: SparkSession, sf: str) -> DataFrame:
    from scopekit.operators.training import chat_pairs
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return chat_pairs(conv)


def finished(spark: SparkSession, sf: str) -> DataFrame:
    """(id): documents whose output already exists."""
    d = documents(spark, sf, "doc_id")
    return d.where(F.col("doc_id") % 3 == 0).select(F.col("doc_id").cast("string").alias("id"))


@materialized("manifest")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """(id, url, sha256): expected digest of each document; a changed first hex digit
    when doc_id%9=0, none when doc_id%11=0; url of page doc_id % (number of pages)."""
    d = documents(spark, sf, "doc_id", "text")
    pages = read_table(spark, sf, "pages", "page_id", "url")
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    h = F.sha2("text", 256)
    flipped = F.concat(F.when(h.substr(1, 1) == "0", F.lit("1")).otherwise(F.lit("0")), h.substr(F.lit(2), F.lit(64)))
    sha = (F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
            .when(F.col("doc_id") % 9 == 0, flipped).otherwise(h))
    m = d.select("doc_id", sha.alias("sha256"), (F.col("doc_id") % n_pages).alias("page_id"))
    j = m.join(pages, "page_id", "left")
    return j.select(F.col("doc_id").cast("string").alias("id"), "url", "sha256")


@materialized("prompt_cache")
def prompt_cache(spark: SparkSession, sf: str, every: int = 2) -> DataFrame:
    """(id, text): cached prompt files (prompt + newline) of the documents with
    doc_id % every = 0, including empty ones (instruction only)."""
    from scopekit import fixed_values as FV
    from scopekit.operators import pages as P
    from scopekit.operators.prompts import cached_prompt_text
    units = P.page_units(report_pages(spark, sf), "text")
    assembled = P.assemble_documents(units)
    d = documents(spark, sf, "doc_id").where(F.col("doc_id") % every == 0)
    j = d.join(assembled.select("doc_id", "user_message"), "doc_id", "left")
    pre, suf = FV.CHAT_WRAPPERS["mistral"]
    content = F.concat(F.lit(FV.INSTRUCTION + "\n"), F.coalesce("user_message", F.lit("")))
    prompt = F.concat(F.lit(pre), content, F.lit(suf + FV.ANSWER_START))
    return j.select(F.col("doc_id").cast("string").alias("id"), cached_prompt_text(prompt).alias("text"))


def document_models(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, model): each document assigned one configured model by doc_id % 5."""
    from scopekit import fixed_values as FV
    names = F.array(*[F.lit(n) for n in FV.MODEL_NAMES])
    d = documents(spark, sf, "doc_id")
    return d.select("doc_id", F.element_at(names, (F.col("doc_id") % len(FV.MODEL_NAMES) + 1).cast("int")).alias("model"))


def output_files(spark: SparkSession, sf: str) -> DataFrame:
    """(id, value): one model output per document; ids hold a space, '#', '%', a slash, a plus sign or start with '_'; every
    seventh output is broken, others go beyond the limits or are stubs."""
    d = documents(spark, sf, "doc_id", "n_chars")
    k = F.col("doc_id")
    uid = k.cast("string")
    doc_id = (F.when(k % 7 == 1, F.concat(F.lit("report "), uid)).when(k % 7 == 2, F.concat(uid, F.lit("#a")))
               .when(k % 7 == 3, F.concat(F.lit("100% "), uid)).when(k % 7 == 4, F.concat(F.lit("ä+"), uid))
               .when(k % 7 == 5, F.concat(F.lit("d/"), uid)).when(k % 7 == 6, F.concat(F.lit("_"), uid, F.lit(".x"))).otherwise(uid))
    record = F.format_string('{"scope_1":%d,"scope_2":null,"scope_3":%d,"sources":[%d,%d]}', F.col("n_chars"), k * 3000000, k % 5, k % 3)
    value = F.when(k % 7 == 0, F.lit("{")).when(k % 10 == 3, F.lit('{"scope_1":-1,"scope_2":-1,"scope_3":-1,"sources":[-1]}')).otherwise(record)
    return d.select("doc_id", doc_id.alias("id"), value.alias("value"))
