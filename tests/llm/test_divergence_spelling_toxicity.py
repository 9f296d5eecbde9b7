"""Source divergence, spelling variants and toxicity against brute force, hand-made cases and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from scopekit.llm import divergence as D
from scopekit.llm import spelling as S
from scopekit.llm import toxicity as X
from scopekit.llm.common import table
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string"


def audit_by_hand(rows, min_docs):
    """(lang, source, part, item, value, rank) by the dense definition."""
    occ, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        occ[lang, source].update(terms)
        docs.update({(lang, t) for t in terms})
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]
        v = len(kept)

        def shares(counter):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counter[t] + 2) // (n + 2 * v) for t in kept}
        whole = shares(sum((occ[lang, s] for s in sources), Counter()))
        p = {s: shares(occ[lang, s]) for s in sources}

        def gap(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            terms = sorted((-gap(p[s][t], whole[t]), t.encode()) for t in kept if occ[lang, s][t] and p[s][t] > whole[t])[:10]
            out |= {(lang, s, part, item.decode(), -value, i + 1)
                    for part, ranked in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(ranked)}
    return out


def random_documents(seed, n=220):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "Gamma", "délta", "ΩMEGA", "x", "don't", "a_b", "10%", "\x00z", "ÀB", "ß"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 30))), rnd.choice(["en", "de", None]), rnd.choice(["s", "s", "s", "t", "é\x00", None]))
            for i in range(n)]
    return rows + [(None, None, "en", "s"), (7, "", "fr", "lonely"), (7, "", "fr", "other"), (8, "Alpha " * 5000, "en", "t")] + rows[:10]


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_audit_equals_the_dense_definition(spark, block):
    rows = random_documents(3)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], DOCS + ", n int, term string").repartition(5)
    got = D.audit(df, 4, block).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got} == audit_by_hand(rows, 4)


def test_audit_of_an_empty_table_and_without_kept_terms(spark):
    assert D.audit(spark.createDataFrame([], DOCS)).collect() == []
    got = {tuple(r) for r in D.audit(spark.createDataFrame([(1, "a b", "en", "x"), (2, "a", "en", "y")], DOCS)).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def words_by_hand(rows, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(rows):
    words = words_by_hand(rows)
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and is_near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def variant_rows(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_variants_equal_brute_force_on_the_small_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert variant_rows(S.group_variants(docs)) == variants_by_hand(rows)


def test_variants_with_chains_ties_and_odd_rows(spark):
    counts = {"straße": 5, "strasse": 25, "strassen": 130, "abcdef": 5, "abcdeg": 30, "abcdeh": 30, "façade": 40, "facade": 7, "FAÇADE": 5, "a" * 4000: 5, "a" * 3999: 25}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())] + [(None, "abcdef×÷ abcdef"), (3, None), (4, ""), (4, "12 §§")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, word string")
    got = variant_rows(S.group_variants(df))
    assert got == variants_by_hand(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["abcdef"][3] == "abcdeg" and by_word["strasse"][5] == "strassen"
    assert S.group_variants(df.limit(0)).collect() == []


def test_trees_of_many_cells_lose_no_near_word(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abcdeé", k=rnd.randrange(6, 9))) for _ in range(900)})
    df = spark.createDataFrame([(w, rnd.randrange(5, 50)) for w in words], "word string, n bigint")
    want = {(a, b) for a in words for b in words if a != b and is_near(a, b)}
    for sample, cell in ((10_000, 20), (100, 20), (10_000, 100_000)):
        trees = S.upper_trees(df, sample, cell)
        got = [(r.word, r.near) for r in S.near_words(df, trees).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert max(sum(c[0] < 0 for c in t.child) for t in S.upper_trees(df, 10_000, 20).values()) > 5


def test_grammar_weighs_clauses():
    model = X.Model(X.Lexicon({"blorg*": 0.9}), {n: m for n, (m, _) in X.PRIOR.items()})
    texts = ["you blorgish thing", "blorgs everywhere", "he is not a blorgon", 'she called him "a blorger"', "nothing here", "", "I will kill you", "we kill time",
             "Not so. Blorgy"]
    scores = dict(zip(texts, model.scores([t.encode() for t in texts], {})))
    assert scores["you blorgish thing"] > scores["blorgs everywhere"] > scores["he is not a blorgon"] > scores["nothing here"] == scores[""]
    assert scores["blorgs everywhere"] > scores['she called him "a blorger"'] > scores["nothing here"]
    assert scores["I will kill you"] > scores["we kill time"] > scores["nothing here"]
    assert scores["Not so. Blorgy"] > scores["he is not a blorgon"]        # a negation ends with its clause
    assert X.Lexicon({"blorg*": 0.9}).class_of("blorg") == ("other", 1.0)    # a beginning stands for longer words


def toxic_documents(n, seed):
    """Invented prose; one in six is toxic, by one of two invented stems with any ending; some hold copies."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeioubcdlmnrst", k=rnd.randrange(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = rnd.choices(words, k=rnd.randrange(20, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randrange(1, 5)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["zwulg", "früpp"]) + rnd.choice(words))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_stems_are_learned_and_held_out_labels_are_not_read(spark):
    rows, labels = toxic_documents(900, 11)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, score int, toxic string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in X.judge(docs, known).collect()}
    assert len(out) == 900
    third = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r.held_out} == set(third)
    truth = dict(labels)
    assert sum(out[i].predicted == truth[i] for i in third) >= 0.98 * len(third)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())
    turned = spark.createDataFrame([(i, 1 - t if i in set(third) else t) for i, t in labels], "doc_id bigint, toxic int")
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in X.judge(docs, turned).collect()}


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "you idiot"), (2, "a. " * 50_000 + "stupid")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (5, 0)], "doc_id bigint, toxic int")
    for labels in (none, some):
        out = sorted((r.doc_id or 0, r.held_out, r.score) for r in X.judge(docs, labels).collect())
        assert [o[0] for o in out] == [0, 1, 1, 2] and out[1][2] == out[2][2] < out[0][2] and not out[0][1]
    assert X.judge(docs.limit(0), none).collect() == []


def test_entries_by_chance_are_not_chosen():
    seen, clean = {"common": 60, "rare": 5, "sure*": 40, "surely": 20, "chance": 2}, {"common": 500}
    assert set(X.chosen_entries(seen, clean, 100, 900)) == {"sure*", "rare"}


def test_training_rows_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i % 60}") for i in range(300)] + [(i, "other") for i in range(2, 9)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id bigint, toxic int")
    assert X.training_rows(docs, labels, 50).count() == 50
    every = X.training_rows(docs, labels, 5000)
    assert every.count() == 67 and every.where("toxic = 1").count() == 63
    assert X.training_rows(docs, labels.limit(0), 50).count() == 0
