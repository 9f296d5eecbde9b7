"""Language identification by Bayesian evidence fusion.

Evidence for a text's language: the text itself (byte trigrams, naive Bayes), the language its markup declares,
the language its address suffix stands for (the top-level domain or the first path segment), and a prior of
its host. Host priors are counts of the text posteriors, gathered by grouped aggregation and smoothed over a
hierarchy: a host's counts are completed by its domain's, those by all. Log evidences are added and
normalised.

The trigram model is fitted on at most TRAIN_DOCS labelled rows (those of the smallest id hashes); everything
else covers all rows. Overlapping trigrams count each character three times, so their sum is divided by three.
A row is rejected if it has no letters, if its best language explains the text clearly worse than
unrelated bytes would (by MARGIN), or if no language reaches MIN_POSTERIOR.

Edge cases: null and empty texts are rejected with language 'und'; null or unknown declarations, addresses and
hosts give no evidence (a null host shares one prior with other null hosts); repeated rows are judged
one by one but all count for priors; without labelled rows every language is as likely as any other and
all rows are rejected; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, packed, slices, text_bytes, text_or_empty, written

TRAIN_DOCS = 2000
BUCKETS = 1 << 16
KNOWN = 0.8                  # share of the counted trigrams in the model, the rest is uniform
MARGIN = 0.5                 # nats a trigram by which a text may be worse explained than unrelated bytes
MIN_POSTERIOR = 0.5
MARKUP_RELIABILITY, SUFFIX_RELIABILITY = 0.9, 0.8
PRIOR_STRENGTH = 20.0        # rows' worth of the level above in a host's prior
SUFFIX_LANGUAGE = {"at": "de", "uk": "en", "us": "en", "ie": "en", "au": "en", "mx": "es", "ar": "es", "co": "es", "cl": "es"}

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _trigrams(texts: list[bytes]):
    """(bucket of each trigram, whether it has a letter, first trigram of each text and the end)."""
    parts = [b" " + t.translate(_LETTERS) + b"   " for t in texts]   # at least two trigrams each
    buf = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    x = buf[:-2] | buf[1:-1] << np.uint32(8) | buf[2:] << np.uint32(16)
    lettered = x != 0x202020
    return (x * np.uint32(2654435761)) >> np.uint32(16), lettered, np.concatenate(([0], ends[:-1])), ends - 2


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    cuts = np.stack([first, end], 1).ravel()
    if cuts[-1] == len(values):
        cuts = cuts[:-1]
    return np.add.reduceat(values, cuts, axis=0)[::2]


class TextModel:
    """Log probabilities of trigram buckets by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        logs = [np.log(KNOWN * counts[c] / max(1.0, counts[c].sum()) + (1 - KNOWN) / BUCKETS) for c in self.languages]
        self.table = np.stack(logs, 1).astype(np.float32) if logs else np.zeros((BUCKETS, 0), np.float32)

    def score(self, texts: list[bytes]):
        """(log likelihoods by language, lettered trigrams) of each text."""
        gram, lettered, first, end = _trigrams(texts)
        own = self.table[gram] * lettered[:, None]
        return _sums(own.astype(np.float64), first, end), _sums(lettered.astype(np.int64), first, end)


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> TextModel:
    """A model from rows (doc_id, text, lang): at most train_docs of them, by id hash."""
    labelled = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null").withColumn("_order", F.xxhash64("doc_id"))
    first = labelled.select("_order").orderBy("_order").limit(train_docs).agg(F.max("_order").alias("last")).first()["last"]
    counts: dict[str, np.ndarray] = {}
    rows = labelled.where(F.col("_order") <= F.lit(first)).select("_order", "text", "lang").orderBy("_order", "text").limit(train_docs)
    for r in rows.toLocalIterator():
        gram, lettered, first, end = _trigrams([r["text"].encode()])
        mine = counts.setdefault(r["lang"], np.zeros(BUCKETS))
        mine += np.bincount(gram[first[0]:end[0]][lettered[first[0]:end[0]]], minlength=BUCKETS)
    return TextModel(counts)


def text_scores(items: DataFrame, model: TextModel) -> DataFrame:
    """The items (without text) with ``loglik`` (array, by the model's languages) and ``trigrams``."""
    keep = [c for c in items.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name != "text")
    shared = items.sparkSession.sparkContext.broadcast(model)   # BUCKETS x languages numbers

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                loglik, n = shared.value.score(text_bytes(part.column("text")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * loglik.shape[1], pa.int32()), pa.array(loglik.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), flat, pa.array(n)],
                                                 names=[*keep, "loglik", "trigrams"])
    return map_batches(items.select(*keep, text_or_empty().alias("text")), run, schema + ", loglik array<double>, trigrams bigint")


def host_of(url):
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)


def domain_of(host):
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def suffix_of(url):
    """The two-letter first path segment, else the top-level domain."""
    path = F.lower(F.regexp_extract(url, r"://[^/]*/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    return F.when(path != "", path).otherwise(F.lower(F.regexp_extract(host_of(url), r"\.([A-Za-z]+)$", 1)))


def declared_in(html):
    """The language of the root element's lang attribute, without region."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def visible_text(html):
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")


def _softmax(logs):
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def _plus(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _evidence(code, languages: list[str], reliability: float):
    """Log likelihoods of a stated language code; zero for all where it is none of the languages."""
    rest = (1 - reliability) / max(1, len(languages) - 1)
    stated = F.array(*[F.when(code == c, F.lit(float(np.log(reliability)))).otherwise(F.lit(float(np.log(rest)))) for c in languages])
    return F.when(code.isin(*languages), stated).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def identify(items: DataFrame, model: TextModel) -> DataFrame:
    """Items with (text, declared, suffix, host, domain) and ids of any kind -> the ids with lang, posterior,
    text_lang and kept. ``declared`` and ``suffix`` are language codes, all but text may be null."""
    ids = [c for c in items.columns if c not in ("text", "declared", "suffix", "host", "domain")]
    langs, k = model.languages, len(model.languages)
    scored = written(text_scores(items, model), "language-scores")
    if not k:
        return scored.select(*ids, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"))
    third = F.transform("loglik", lambda x: x / 3)
    fits = (F.col("trigrams") > 0) & (F.array_max("loglik") > -float(np.log(BUCKETS) + MARGIN) * F.col("trigrams"))
    own = scored.select("host", "domain", F.when(fits, _softmax(third)).otherwise(F.array(*[F.lit(0.0)] * k)).alias("p"))

    def counts(by):
        sums = F.array(*[F.sum(F.col("p")[i]) for i in range(k)])
        return own.groupBy(*by).agg(sums.alias("n"))

    def smoothed(n, above):
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, above, lambda x, p: (x + PRIOR_STRENGTH * p) / (total + PRIOR_STRENGTH))

    flat = F.array(*[F.lit(1.0 / k)] * k)
    every = counts([]).first()["n"] if own.take(1) else None      # one row of k numbers
    total = sum(every) if every else 0.0
    world = F.array(*[F.lit((float(x) + PRIOR_STRENGTH / k) / (total + PRIOR_STRENGTH)) for x in every]) if every else flat
    domains = counts(["domain"]).select("domain", smoothed(F.col("n"), world).alias("domain_prior"))
    hosts = counts(["host", "domain"]).alias("h").join(domains.alias("d"), F.col("h.domain").eqNullSafe(F.col("d.domain")), "left")
    hosts = written(hosts.select("h.host", "h.domain", smoothed(F.col("n"), F.coalesce("domain_prior", world)).alias("prior")), "host-priors")
    s, h = scored.alias("s"), hosts.alias("h")
    both = s.join(h, F.col("s.host").eqNullSafe(F.col("h.host")) & F.col("s.domain").eqNullSafe(F.col("h.domain")), "left")
    code = F.col("s.suffix")
    for country, language in SUFFIX_LANGUAGE.items():
        code = F.when(F.col("s.suffix") == country, F.lit(language)).otherwise(code)
    logs = _plus(_plus(third, _evidence(F.col("s.declared"), langs, MARKUP_RELIABILITY)), _evidence(code, langs, SUFFIX_RELIABILITY))
    logs = _plus(logs, F.transform(F.coalesce("h.prior", flat), lambda p: F.log(p)))
    names = F.array(*[F.lit(c) for c in langs])

    def best(p):
        return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))

    out = both.select(*[F.col(f"s.{c}").alias(c) for c in ids], _softmax(logs).alias("_p"), best(F.col("loglik")).alias("_t"), fits.alias("_fits"))
    top = F.array_max("_p")
    kept = F.col("_fits") & (top >= MIN_POSTERIOR)
    return out.select(*ids, F.when(kept, best(F.col("_p"))).otherwise("und").alias("lang"), F.round(top, 6).alias("posterior"),
                      F.when(F.col("_fits"), F.col("_t")).otherwise("und").alias("text_lang"), kept.alias("kept"))


def document_items(docs: DataFrame) -> DataFrame:
    """Documents as items: their source takes a host's place; nothing declares a language."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), none.cast("bigint").alias("page_id"),
                       F.col("text").cast("string").alias("text"), none.alias("declared"), none.alias("suffix"),
                       F.col("source").cast("string").alias("host"), F.lit("documents").alias("domain"))


def page_items(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"),
                        visible_text(F.col("html")).alias("text"), declared_in(F.col("html")).alias("declared"), suffix_of(url).alias("suffix"),
                        host_of(url).alias("host"), domain_of(host_of(url)).alias("domain"))


def keep_identified(docs: DataFrame, model: TextModel) -> DataFrame:
    """The documents that are not rejected, all rows and columns as they were."""
    key = F.struct(F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(0)).alias("i"), F.col("row.doc_id").isNull().alias("n"),
                   F.xxhash64(text_or_empty("row.text")).alias("h"), F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("s"))
    rows = packed(docs).withColumn("k", key)
    items = packed(docs.select("doc_id", "text", "source")).withColumn("k", key).select("k", "row.*")
    none = F.lit(None).cast("string")
    judged = identify(items.select("k", F.col("text").cast("string").alias("text"), none.alias("declared"), none.alias("suffix"),
                                   F.col("source").cast("string").alias("host"), F.lit("documents").alias("domain")), model)
    rejected = judged.where(~F.col("kept")).select("k").distinct()
    return rows.join(rejected.hint("merge"), "k", "left_anti").select("row.*")
