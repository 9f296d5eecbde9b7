"""Secret scan with a random forest against false positives.

Candidates are tokens of at least MIN_LENGTH characters of a key's alphabet that hold a digit or a known key prefix, and
shorter values assigned to a name that means a secret; a word (minified JSON, a URL) may hold several. A random
forest, trained on labelled findings, then keeps the likely secrets. Its features: length, character transitions (changes between lower case, upper
case, digits and other, and how usual the letter pairs are in the corpus' words), dictionary coverage, path
(of the value and of the document) and neighbouring words. DataFrame and Spark ML functions only.

Labelled findings are a table (word, before, name, after, path, label); ``labelled_findings`` derives them from
documents: keys made of digests set behind a secret's name, against digests named as checksums, identifiers of
corpus words, paths and placeholders, and the same kinds of keys in files of tests, samples and fixtures. Training uses
at most TRAIN_DOCS rows of documents (of the smallest id hashes, equal rows once); the dictionary and the letter pairs
are counted on all documents, and the scan covers all text.

Edge cases: null and empty texts have no candidates; a document without candidates has no row; repeated
documents are scanned one by one; null paths are empty; an empty table gives no rows; a very long text is one row of words,
each with its candidates; a row's id is null only if the document's is; equal scores are no tie, as each
candidate is judged by itself; other columns, also those named like the operator's own, are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import text_or_empty, written

MIN_LENGTH = 16
TRAIN_DOCS = 1000
WORD_SHARE = 1e-5     # of all words: the dictionary has at most 1 / WORD_SHARE words
TREES, DEPTH, SEED = 30, 8, 17

# FIXED VALUES: public key prefixes, names of secrets, and words around harmless findings
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ"
SECRET_NAMES = "token|secret|passwd|password|pwd|api_?key|apikey|access_?key|private_?key|auth|credential|bearer"
HARMLESS_NAMES = "commit|sha|sha1|sha256|md5|checksum|digest|hash|etag|revision|uuid|id|version|file|path|build"
PLACEHOLDERS = "example|sample|dummy|test|placeholder|changeme|your|xxxx|fake|todo"
TEST_PATHS = "test|example|sample|fixture|doc|mock"

VALUE = r"[A-Za-z0-9+/_=.\-]+"
KEY = r"A-Za-z0-9+/_.\-"     # a key's alphabet; = only pads its end
# a key behind a slash or dot is a token of its own, and what follows it another
_INNER = rf"(?:{PREFIXES.replace('|eyJ', '')})[A-Za-z0-9_\-]{{12}}"
_RUN = rf"(?:(?!(?<=[/.]){_INNER})[{KEY}])"
_LONG = rf"(?={_RUN}{{{MIN_LENGTH}}}|{_RUN}{{{MIN_LENGTH - 1}}}=|{_RUN}{{{MIN_LENGTH - 2}}}==)(?={_RUN}*[0-9]|{PREFIXES})"
_TOKEN = rf"(?:(?<=[/.]){_INNER}[A-Za-z0-9_\-]*|(?:(?<![{KEY}])|\G){_LONG}{_RUN}+={{0,2}})"
# a run with = inside that is long only as a whole
_JOINED = rf"(?<![{KEY}=])(?=[{KEY}=]{{{MIN_LENGTH}}})(?=[{KEY}=]*[0-9]|{PREFIXES})(?![{KEY}=]*=(?:{_LONG}))(?![{KEY}=]*[/.]{_INNER})[{KEY}=]+"
_NAME = rf"(?<![{KEY}])(?!{_TOKEN})[A-Za-z0-9_.\-]{{1,64}}[\"']?[:=]+"
# a long token with the name it is assigned to and its quotes
PIECE = rf"(?:{_NAME})?[\"'`]?({_TOKEN}|{_JOINED})[\"'`]?"
# a name that means a secret and its value
ASSIGNED = rf"(?i)[a-z0-9_.\-]*(?:{SECRET_NAMES})[a-z0-9_.\-\"']*[:=]([\"][^\s\"]{{8,}}[\"]?|['][^\s']{{8,}}[']?|[^\s\"'&,;]{{8,}})"
# what holds neither has no candidates
MAYBE = rf"(?<![{KEY}=])(?=[{KEY}=]{{{MIN_LENGTH}}})[{KEY}=]*(?:[0-9]|{PREFIXES})|(?i:{SECRET_NAMES})"
FEATURES = ["length", "transitions", "pair_score", "digits", "distinct", "dictionary", "slashes", "test_path",
            "secret_name", "harmless_name", "assigned", "placeholder", "quoted"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, position, part, value, word, before, name, after, path): every candidate of a text, the place of its
    word (split at white space) among the words, its number among the word's candidates, the piece of the word it
    stands in (with the name it is assigned to and its quotes), and the words around it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path")).where(F.rlike("text", F.lit(MAYBE)))
    words = rows.select("doc_id", "path", F.split("text", r"\s+").alias("w"))

    def word(i):
        return F.coalesce(F.get("w", i), F.lit(""))

    def after_name(i):
        return (F.rlike(word(i - 1), F.lit(r"[:=]$")) & (F.char_length(word(i)) >= 8)
                & F.rlike(F.concat_ws(" ", word(i - 2), word(i - 1)), F.lit(rf"(?i)(?:{SECRET_NAMES})[a-z0-9_.\-\"']*\s*[:=]$")))

    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.rlike(word(i), F.lit(MAYBE)) | after_name(i))
    i = F.col("position")
    each = words.select("doc_id", "path", "w", F.explode(places).alias("position")).select(
        "doc_id", "path", "position", word(i).alias("x"), after_name(i).alias("named"), F.concat_ws(" ", word(i - 3), word(i - 2)).alias("before"),
        word(i - 1).alias("name"), word(i + 1).alias("after"))

    def pair(piece, value):
        return F.struct(piece.alias("word"), value.alias("value"))

    # the value of a name in the word before, of names in the word, and the long tokens that are none of these
    whole = F.regexp_extract("x", r"^[\"'`]([^\"'`]+)", 1)
    bare = F.regexp_extract("x", r"^[(\[{]*([^\s\"'`,;]+)", 1)
    first = F.when(F.col("named"), F.array(pair(F.col("x"), F.when(whole != "", whole).when(bare != "", bare).otherwise(F.col("x")))))
    set_ = F.transform(F.regexp_extract_all("x", F.lit(ASSIGNED), 0), lambda s: pair(s, F.regexp_extract(s, ASSIGNED, 1)))
    set_ = F.transform(set_, lambda p: pair(p["word"], F.regexp_replace(p["value"], r"^[\"']|[\"']$", "")))
    named = F.concat(F.coalesce(first, F.array().cast("array<struct<word:string,value:string>>")), set_)
    long = F.transform(F.regexp_extract_all("x", F.lit(PIECE), 0), lambda s: pair(s, F.regexp_extract(s, PIECE, 1)))
    each = each.withColumn("named", named)
    taken = F.transform("named", lambda p: p["value"])
    found = each.select("*", F.posexplode(F.concat("named", F.filter(long, lambda p: ~F.array_contains(taken, p["value"])))).alias("part", "p"))
    # the words before are next to the piece at the word's start only
    lead = rf"^[^{KEY}]+"
    starts = F.startswith(F.regexp_replace("x", lead, ""), F.regexp_replace("p.word", lead, ""))
    return found.select("doc_id", "position", "part", F.col("p.value").alias("value"), F.col("p.word").alias("word"),
                        F.when(starts, F.col("before")).otherwise("").alias("before"), F.when(starts, F.col("name")).otherwise("").alias("name"),
                        "after", "path")


def training_docs(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text): at most train_docs rows of documents, those of the smallest id hashes, then of the smallest row
    hashes (an id may have any number of rows); equal rows once."""
    def smallest(rows, name):
        last = rows.select(name).distinct().orderBy(name).limit(train_docs).agg(F.max(name).alias("last")).first()["last"]
        return rows.where(F.col(name) <= F.lit(last))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    chosen = smallest(rows.withColumn("o", F.xxhash64("doc_id")), "o").withColumn("r", F.xxhash64("doc_id", "text"))
    return smallest(chosen, "r").dropDuplicates(["r"]).select("doc_id", "text")


def vocabulary(docs: DataFrame, share: float = WORD_SHARE) -> tuple[list[str], dict[str, float]]:
    """The words of at least four letters that make up ``share`` of all words, and each letter pair's share: both bounded."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,30}"), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = written(words, "words")
    least = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) * share
    top = words.where((F.length("w") >= 4) & (F.col("n") >= least)).orderBy("w").select("w").collect()
    pairs = (words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"))
             .groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect())     # at most 26 x 26
    total = sum(r["n"] for r in pairs) or 1
    return [r["w"] for r in top], {r["p"]: r["n"] / total for r in pairs}


def _any_of(words: list[str]) -> str:
    """A pattern of the longest word at a place, as a tree of letters: its cost doesn't grow with the number of words."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        kids = [c + pattern(node[c]) for c in sorted(node) if c]
        if not kids:
            return ""
        one = kids[0] if len(kids) == 1 and "" not in node else f"(?:{'|'.join(kids)})"
        return one + "?" if "" in node else one
    return pattern(tree) or "(?!)"


def _first_value():
    """The value of a labelled word: the first run of key characters behind a secret's name, or the word."""
    stripped = F.regexp_replace("word", rf"(?i)^.*?(?:{SECRET_NAMES})[a-z0-9_.\-\"']*[:=]", "")
    value = F.regexp_extract(stripped, VALUE, 0)
    return F.when(value == "", F.col("word")).otherwise(value)


def features(findings: DataFrame, words: list[str], pairs: dict[str, float]) -> DataFrame:
    """The findings with ``value`` (kept if they have one) and the numbers of FEATURES."""
    if "value" not in findings.columns:
        findings = findings.withColumn("value", _first_value())
    f = findings
    v, low, n = F.col("value"), F.lower("value"), F.greatest(F.char_length("value"), F.lit(1))
    changes = F.regexp_count(v, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"))
    table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p]) if pairs else F.create_map(F.lit(""), F.lit(0.0))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(v) - 1, F.lit(1)))
    usual = F.aggregate(places, F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(table, F.substring(low, i, F.lit(2))), F.lit(0.0)))
    known = F.regexp_replace(low, _any_of(words), "")
    around = F.lower(F.concat_ws(" ", "before", "name"))
    name = F.lower(F.concat_ws(" ", F.regexp_extract("before", r"(\S*)$", 1), "name", F.regexp_extract("word", r"^([^:=]*)[:=]", 1)))

    def flag(text, pattern):
        return F.rlike(text, F.lit(pattern)).cast("double")

    return f.withColumns({
        "length": n.cast("double"), "transitions": changes / n, "pair_score": usual / n * 1000.0,
        "digits": F.regexp_count(v, F.lit("[0-9]")) / n, "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary": (n - F.char_length(known)) / n, "slashes": F.regexp_count(v, F.lit("/")) / n,
        "test_path": flag(F.lower("path"), TEST_PATHS), "secret_name": flag(name, SECRET_NAMES),
        "harmless_name": flag(name, rf"\b(?:{HARMLESS_NAMES})\b"), "assigned": flag(F.concat_ws("", "name", "word"), "[:=]"),
        "placeholder": flag(F.concat_ws(" ", around, F.lower("after"), low), PLACEHOLDERS), "quoted": flag(F.col("word"), "[\"'`]")})


# files of labelled findings: of programs, and of their tests and samples
PROGRAM_PATHS = ["", "src/app/settings.py", "deploy/production.env", "config/main.yml", "server/auth/login.go", "web/client.js"]
SAMPLE_PATHS = ["tests/test_login.py", "examples/settings.py", "fixtures/keys.json", "docs/setup.md", "mocks/server.go", "app/sample.env"]


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, word, before, name, after, path, label) made from documents: five secrets and ten harmless findings in
    program files (or without a path), and five keys in files of tests and samples, harmless too; each with words of the
    document around it."""
    w = F.split(text_or_empty(), r"\s+")
    base = docs.select("doc_id", w.alias("w"), F.sha2(F.concat(F.lit("a"), F.col("doc_id").cast("string")), 256).alias("x"),
                       F.sha2(F.concat(F.lit("b"), F.col("doc_id").cast("string")), 512).alias("y"))

    def word(i):
        return F.get("w", F.pmod(F.lit(i) + F.col("doc_id"), F.size("w")).cast("int"))

    def plain(i):
        return F.regexp_replace(F.lower(word(i)), "[^a-z]", "")

    b64 = F.regexp_replace(F.base64(F.unhex("y")), r"\s", "")
    q, s = F.lit('"'), F.concat
    text = F.lit
    kinds = [
        (1, s(q, F.substring("x", 1, 40), q), text("token ="), word(5)), (1, s(q, F.substring(b64, 1, 43), q), text("secret ="), word(6)),
        (1, s(text("AKIA"), F.upper(F.substring("x", 5, 16))), word(7), word(8)), (1, s(text("api_key="), F.substring(b64, 10, 32)), word(9), word(10)),
        (1, s(text("password=\""), F.substring(b64, 20, 14), q), word(11), word(12)),
        (0, F.substring("x", 9, 40), text("commit"), word(13)), (0, F.col("x"), text("sha256 checksum:"), word(14)),
        (0, s(plain(15), text("_"), plain(16), text("_"), plain(17), text("_2021")), word(18), word(19)),
        (0, s(text("/usr/lib/"), plain(20), text("/"), plain(21), text("/v2/"), plain(22), text(".txt")), text("path"), word(23)),
        (0, text("\"your_example_token_1234\""), text("token ="), word(24)), (0, text("xxxxxxxxxxxxxxxx0000"), text("password:"), text("changeme")),
        (0, s(plain(25), text("."), plain(26), text("@mail1.example.com")), word(27), word(28)),
        (0, s(plain(29), plain(30), text("2020"), plain(31)), word(32), word(33)),
        (0, F.substring(s(F.conv(F.substring("x", 1, 14), 16, 10), text("0123456789")), 1, 16), word(34), word(35)),
        (0, F.substring(s(F.conv(F.substring("y", 1, 14), 16, 10), text("01234567890123456789")), 1, 20), word(36), word(37)),
    ]
    keys = [k for k in kinds if k[0] == 1]
    program = [(*k, PROGRAM_PATHS) for k in kinds]
    sample = [(0, F.translate(value, "0123456789", "7306918254"), name, after, SAMPLE_PATHS) for _, value, name, after in keys]

    def one_of(paths, i):
        return F.get(F.array(*[F.lit(p) for p in paths]), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(len(paths))).cast("int"))

    made = F.array(*[F.struct(value.alias("word"), name.alias("near"), after.alias("after"), one_of(paths, i).alias("path"),
                              F.lit(float(label)).alias("label"), F.lit(i).alias("kind"))
                     for i, (label, value, name, after, paths) in enumerate(program + sample)])
    each = base.select("doc_id", word(3).alias("first"), F.explode(made).alias("k"))
    near = F.split("k.near", " ")
    return each.select("doc_id", F.col("k.kind").alias("kind"), F.coalesce("k.word", F.lit("")).alias("word"),
                       F.concat_ws(" ", "first", F.when(F.size(near) > 1, near[0])).alias("before"),
                       F.coalesce(F.element_at(near, -1), F.lit("")).alias("name"), F.coalesce("k.after", F.lit("")).alias("after"),
                       F.col("k.path").alias("path"), F.col("k.label").alias("label"))


def train(labelled: DataFrame, words: list[str], pairs: dict[str, float]):
    """A fitted forest; the rows are put in a fixed order, so the same findings give the same forest."""
    rows = features(labelled, words, pairs).select("doc_id", "kind", "label", *FEATURES)
    rows = written(rows.coalesce(1).sortWithinPartitions("doc_id", "kind"), "labelled-findings")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
                            RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED)]).fit(rows)


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, position, part, value, score, is_secret) for every candidate of all documents."""
    some = written(training_docs(docs), "training-docs")
    if some.isEmpty():
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("position"), F.lit(0).alias("part"), F.lit("").alias("value"),
                           F.lit(0.0).alias("score"), F.lit(False).alias("is_secret")).where("false")
    words, pairs = vocabulary(docs.select(F.col("text").cast("string").alias("text")))
    model = train(labelled_findings(some), words, pairs)
    scored = model.transform(features(candidates(docs), words, pairs))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "position", "part", "value", score.alias("score"), (score >= threshold).alias("is_secret"))


def report(found: DataFrame) -> DataFrame:
    """Findings without showing the values."""
    return found.select("doc_id", F.col("position").cast("bigint").alias("position"), F.col("part").cast("bigint").alias("part"), F.char_length("value").cast("bigint").alias("length"),
                        F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
