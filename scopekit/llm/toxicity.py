"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a clause's word classes: insults, threats (with an intent before them), targets (before or
after an insult), negation (a scope of a few words) and reported speech (after a verb of saying, or inside
quotes). They are composed into one machine whose arcs give out marks; a clause's weight is the sum of the weights of
the marks on its path, so "you idiot" weighs more than "idiot", "not an idiot" and "she called him an idiot" less. A
document's score is the logistic function of its clauses' marks, each counted on a logarithmic scale.

Learned from labelled rows (at most TRAIN_DOCS, of the smallest id hashes):
- the insult lexicon: words and word beginnings that occur in toxic documents more often than chance allows after
  correction for the number of candidates (a Chernoff bound), counting near copies of a document once (by the smallest
  hash of its word pairs), and that occur in few others. A beginning stands for the inflections it covers.
- the weights of the marks, by logistic regression around prior weights, which decide where labels say nothing.
Small fixed lists of function words (negations, pronouns, verbs of saying, intents, threats) in four languages complete
the classes. Only the text is read for a score; labels, language, source and id are not.

Edge cases: null and empty texts get the score of a text without marks; a very long text is read clause by clause; a
repeated id has one label (toxic if any of its labels is), each of its rows a score; null ids have no label and aren't
held out; without labelled rows only the fixed lists and prior weights act; an empty table gives no rows; other
columns are ignored. The result doesn't depend on the order of rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import map_batches, slices, text_bytes, text_or_empty, written

TRAIN_DOCS = 20_000
THRESHOLD = 0.7
STEMS = (3, 4, 5, 6, 7, 8)    # letters in a word beginning
MIN_GROUPS = 5                # toxic documents, copies counted once, behind a lexicon entry
MIN_PRECISION = 0.8
SIGNIFICANCE = 0.01           # after correction for all candidates
LEXICON = 5_000               # entries at most, the most significant ones
CACHE = 300_000               # words whose class a worker remembers
NEGATION_SCOPE, TARGET_SCOPE, INTENT_SCOPE = 4, 4, 4

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;:\n]+")

CLASS_WORDS = {
    "negation": "not no never none neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun sans nunca jamás sin",
    "target": "you your you're u he she they him them his her their this these those everyone people du dich dir ihr euch sie er tu toi vous il elle ils tú te usted ustedes ellos ella",
    "report": "said says say wrote writes called calls calling claimed claims quoted quotes reported told sagte sagt schrieb nannte dit dirent écrit appelé dijo dicen escribió llamó",
    "intent": "will shall gonna going must should werde werden wird muss vais va vont voy vas vamos",
    "threat": "kill murder hurt destroy shoot stab strangle beat töten umbringen erschießen tuer frapper matar golpear",
}
SEED_INSULTS = "idiot moron stupid dumb fool jerk imbecile"
MARKS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_intended", "threat_targeted", "threat_negated", "threat_reported")
PRIOR = {"bias": (-3.0, 2.0), "insult": (3.0, 3.0), "insult_targeted": (1.0, 1.0), "insult_negated": (-2.0, 1.0), "insult_reported": (-2.0, 1.0),
         "threat": (0.2, 0.7), "threat_intended": (1.0, 1.0), "threat_targeted": (1.5, 1.0), "threat_negated": (-1.0, 1.0), "threat_reported": (-1.0, 1.0)}


class Transducer:
    """Deterministic: step(state, class) gives the next state and the marks of the arc."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def composed(self, other: "Transducer") -> "Transducer":
        def step(state, word_class):
            (a, marks), (b, more) = self.step(state[0], word_class), other.step(state[1], word_class)
            return (a, b), marks + more
        return Transducer((self.start, other.start), step)


def _core(kind: str) -> Transducer:
    return Transducer(0, lambda state, c: (0, (kind,) if c == kind else ()))


def _before(trigger: str, scope: int, *kinds: str, mark: str) -> Transducer:
    """Marks a core word that follows a trigger within ``scope`` words."""
    def step(state, c):
        marks = tuple(f"{k}_{mark}" for k in kinds if c == k and state > 0)
        return (scope if c == trigger else max(0, state - 1)), marks
    return Transducer(0, step)


def _after(trigger: str, scope: int, kind: str, mark: str) -> Transducer:
    """Marks a core word that a trigger follows within ``scope`` words."""
    def step(state, c):
        if c == kind:
            return scope, ()
        return (0, (f"{kind}_{mark}",)) if c == trigger and state > 0 else (max(0, state - 1), ())
    return Transducer(0, step)


def _reported() -> Transducer:
    """State 1 after a verb of saying, 2 inside quotes; a closing quote ends it."""
    def step(state, c):
        marks = tuple(f"{k}_reported" for k in ("insult", "threat") if c == k and state > 0)
        if c == "quote":
            return (0 if state == 2 else 2), marks
        return (max(state, 1) if c == "report" else state), marks
    return Transducer(0, step)


class Grammar:
    """The composed machine as a table, built from its start state outwards."""

    CLASSES = ("other", "insult", "threat", "target", "negation", "report", "intent", "quote")

    def __init__(self):
        parts = [_core("insult"), _core("threat"), _before("target", TARGET_SCOPE, "insult", "threat", mark="targeted"),
                 _after("target", TARGET_SCOPE, "insult", "targeted"), _after("target", TARGET_SCOPE, "threat", "targeted"),
                 _before("negation", NEGATION_SCOPE, "insult", "threat", mark="negated"), _reported(),
                 _before("intent", INTENT_SCOPE, "threat", mark="intended")]
        machine = parts[0]
        for part in parts[1:]:
            machine = machine.composed(part)
        self._machine, self._arcs = machine, {}

    def marks(self, classes: list[str]) -> set[str]:
        """The marks on a clause's path. Arcs are made when first used."""
        state, found = self._machine.start, set()
        for c in classes:
            arc = self._arcs.get((state, c))
            if arc is None:
                arc = self._arcs[state, c] = self._machine.step(state, c)
            state, marks = arc
            found.update(marks)
        return found


class Lexicon:
    """Word classes and the strength of insults: whole words, and beginnings of words."""

    def __init__(self, learned: dict[str, float]):
        self.fixed = {w: c for c, words in CLASS_WORDS.items() for w in words.split()}
        self.words = {w: 0.5 for w in SEED_INSULTS.split()}
        self.words.update({k: v for k, v in learned.items() if not k.endswith("*")})
        self.stems = {k[:-1]: v for k, v in learned.items() if k.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})

    def class_of(self, word: str) -> tuple[str, float]:
        strength = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) > n)])
        if strength:
            return "insult", strength
        return self.fixed.get(word, "other"), 1.0


def _clause_marks(text: str, lexicon: Lexicon, grammar: Grammar, cache: dict) -> dict[str, float]:
    """Summed strength of every mark over the clauses of a text."""
    out: dict = {}
    if len(cache) > CACHE:
        cache.clear()
    text = text.lower()
    words = set(_WORD.findall(text))
    for w in words:
        if w not in cache:
            cache[w] = lexicon.class_of(w)
    cores = {w for w in words if cache[w][0] in ("insult", "threat")}
    if not cores:
        return out
    for clause in _CLAUSE.split(text):
        pieces = _PIECE.findall(clause)
        if cores.isdisjoint(pieces):
            continue
        classes = [cache[p] if p in cache else ("quote", 1.0) for p in pieces]
        strength = {kind: max([s for c, s in classes if c == kind], default=0.0) for kind in ("insult", "threat")}
        for mark in grammar.marks([c for c, _ in classes]):
            out[mark] = out.get(mark, 0.0) + strength[mark.split("_")[0]]
    return out


def _mark_rows(texts: list[bytes], lexicon: Lexicon, grammar: Grammar, cache: dict) -> np.ndarray:
    rows = np.zeros((len(texts), len(MARKS)))
    for i, text in enumerate(texts):
        for mark, x in _clause_marks(text.decode(), lexicon, grammar, cache).items():
            rows[i, MARKS.index(mark)] = x if x < 1 else 1 + np.log(x)
    return rows


class Model:
    def __init__(self, lexicon: Lexicon, weights: dict[str, float]):
        self.lexicon, self.weights, self.grammar = lexicon, weights, Grammar()

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def scores(self, texts: list[bytes], cache: dict) -> np.ndarray:
        rows = _mark_rows(texts, self.lexicon, self.grammar, cache)
        z = self.weights["bias"] + rows @ np.array([self.weights[m] for m in MARKS])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fitted_weights(rows: np.ndarray, toxic: np.ndarray) -> dict[str, float]:
    """Logistic regression around PRIOR (Newton steps)."""
    names = ("bias", *MARKS)
    mean, sd = (np.array([PRIOR[n][i] for n in names]) for i in (0, 1))
    x, w, precision = np.column_stack([np.ones(len(rows)), rows]), mean.copy(), np.diag(1 / sd ** 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + precision, x.T @ (toxic - p) - precision @ (w - mean))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, (float(round(v, 9)) for v in w)))


def _candidates(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _copy_group(words: list[str]) -> int:
    """Smallest hash of a text's word pairs; copies mostly share it."""
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or words)), default=0)


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of at most train_docs labelled documents: those of the smallest id hashes, equal rows once, and of
    ids with several texts the smallest row hashes. Only ids and hashes move before the rows are chosen."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))

    def smallest(rows, order):
        last = rows.select(order.alias("o")).orderBy("o").limit(train_docs).agg(F.max("o").alias("o")).first()["o"]
        return rows.where(order <= F.lit(last))
    chosen = F.broadcast(smallest(known, F.xxhash64("id")))          # train_docs ids
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text")).join(chosen, "id")
    rows = texts.withColumn("row", F.xxhash64("id", "text"))
    last = smallest(rows.select("row").distinct(), F.col("row")).agg(F.max("row").alias("row")).first()["row"]
    return rows.where(F.col("row") <= F.lit(last)).dropDuplicates(["row"]).select("text", "toxic")


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Insulting words and beginnings (marked by a star) with their strength, from bounded rows (text, toxic)."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}

    def entries(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                for text in text_bytes(part.column("text")):
                    words = _WORD.findall(text.decode().lower())
                    found = sorted(_candidates(set(words)))
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([_copy_group(words)] * len(found), pa.int64())],
                                                     names=["entry", "copies"])
    toxic = map_batches(sample.where("toxic = 1").select("text"), entries, "entry string, copies bigint")
    groups = toxic.distinct().groupBy("entry").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= MIN_GROUPS)
    seen = {r["entry"]: r["groups"] for r in groups.toLocalIterator()}           # at most train_docs texts' entries over MIN_GROUPS
    positives = toxic.select("copies").distinct().count()

    seen_entries = frozenset(seen)

    def clean_counts(batches):
        counts: dict = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                for text in text_bytes(part.column("text")):
                    for e in _candidates(set(_WORD.findall(text.decode().lower()))) & seen_entries:
                        counts[e] = counts.get(e, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "clean"])
    clean = map_batches(sample.where("toxic = 0").select("text"), clean_counts, "entry string, clean bigint")
    clean_of = {r["entry"]: r["clean"] for r in clean.groupBy("entry").agg(F.sum("clean").alias("clean")).toLocalIterator()}
    return chosen_entries(seen, clean_of, positives, n[0])


def chosen_entries(seen: dict[str, int], clean_of: dict[str, int], positives: int, negatives: int) -> dict[str, float]:
    """Entries whose share of toxic documents is beyond chance and MIN_PRECISION; none that a chosen beginning covers as well."""
    share = positives / (positives + negatives)
    need = np.log(max(1, len(seen)) / SIGNIFICANCE)
    good = []
    for entry, a in seen.items():
        b = clean_of.get(entry, 0)
        precision = a / (a + b)
        if precision < MIN_PRECISION:
            continue
        bound = a * np.log(precision / share) + (b * np.log((1 - precision) / (1 - share)) if b else 0.0)
        if bound > need:
            good.append((-round(float(bound), 6), -len(entry), entry, (a + 0.5) / (a + b + 1)))
    chosen: dict = {}
    inside: set = set()                 # the beginnings of all chosen entries
    for _, _, entry, strength in sorted(good):
        # of nested beginnings, the one with the strongest evidence stays: the longest, where it is equal
        word = entry.rstrip("*")
        if len(chosen) < LEXICON and word + "*" not in chosen and not any(word[:k] + "*" in chosen for k in STEMS) and entry not in inside:
            chosen[entry] = float(round(strength, 6))
            inside.update(word[:k] + "*" for k in STEMS if len(word) >= k)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    sample = written(training_rows(docs, labels, train_docs), "toxicity-sample")
    lexicon = Lexicon(learned_lexicon(sample))

    def run(batches):
        grammar, cache = Grammar(), {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                rows = _mark_rows(text_bytes(part.column("text")), lexicon, grammar, cache)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(MARKS), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), flat], names=["toxic", "marks"])
    got = map_batches(sample.select("text", "toxic"), run, "toxic int, marks array<double>").collect()   # train_docs rows of a few numbers
    got.sort()
    return Model(lexicon, fitted_weights(np.array([r["marks"] for r in got]).reshape(-1, len(MARKS)), np.array([r["toxic"] for r in got], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # at most LEXICON words and a few weights

    def run(batches):
        cache = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                p = np.round(shared.value.scores(text_bytes(part.column("text")), cache), 6)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                                 names=["doc_id", "score", "predicted"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), run,
                       "doc_id bigint, score double, predicted int")


def held_out(doc_id):
    """Whether an id is in the third of the ids that nothing is learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def judge(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out ids are never read for the model."""
    model = fit(docs, labels.where(~held_out("doc_id")), train_docs)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
