"""Named queries of the corpus operators (production parameters, whole tables) and their DuckDB SQL."""

from __future__ import annotations

from scopekit.llm import (chat, decontamination, divergence, language, licences, line_dedup, packing, repetition, secrets, simhash, spelling,
                          suffix_dedup, toxicity)
from scopekit.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secret_scan(spark, sf_dir):
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op2_quality_repetition(spark, sf_dir):
    return repetition.judged(repetition.profiles(table(spark, sf_dir, "documents")))


def op3_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontamination.digest(
        decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"), short=line_dedup.SHORT_RUNS)


def op7_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.report(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("SELECT -1L AS conv_id, t.turn, t.role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)",
                        args={"text": CONTROL_TEXT})
    return chat.report(chat.canonical_turns(chat.records_of(rows.unionByName(control))))


def op9_language_id(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    items = language.document_items(docs).unionByName(language.page_items(pages))
    return language.identify(items, language.fit(docs))


def op10_licence_scan(spark, sf_dir):
    return licences.report(licences.recognise(table(spark, sf_dir, "documents")))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_repetition, op3_packing, op4_benchmark_decontamination,
                                   op5_simhash_near_dedup, op6_line_dedup, op7_suffix_array_dedup, op8_chat_formatting,
                                   op9_language_id, op10_licence_scan, op11_source_divergence, op12_spelling_variants, op13_toxicity)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT * FROM d, (SELECT DISTINCT k FROM bw)), unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + k)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_OP6 = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
          FROM (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(13)) AS s FROM raw, unnest(range(1, len(ls) + 1)) t(i))
          WHERE s <> ''),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS c
         FROM (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w FROM lines)),
ends AS (SELECT a.doc_id, a.j, a.c - a.w AS c0, min(b.j) FILTER (WHERE b.c >= a.c - a.w + 25) AS e25, min(b.j) FILTER (WHERE b.c >= a.c - a.w + 50) AS e50
         FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.c - b.w < a.c - a.w + 50 GROUP BY ALL),
grams AS (SELECT e.doc_id, e.j, e.e25 AS e, md5(string_agg(l.s, chr(10) ORDER BY l.j)) AS k
          FROM ends e JOIN lines l ON l.doc_id = e.doc_id AND l.j BETWEEN e.j AND e.e25 GROUP BY ALL),
sel AS (SELECT DISTINCT doc_id, j, e, k FROM (
          SELECT g.*, row_number() OVER (PARTITION BY w.doc_id, w.j ORDER BY g.k, g.j) AS r
          FROM ends w JOIN grams g ON g.doc_id = w.doc_id AND g.j >= w.j AND g.e <= w.e50 WHERE w.e50 IS NOT NULL) WHERE r = 1),
matches AS (SELECT *, row_number() OVER () AS m
            FROM (SELECT s.*, first_value(doc_id) OVER w AS d0, first_value(j) OVER w AS j0, row_number() OVER w AS r
                  FROM sel s WINDOW w AS (PARTITION BY k ORDER BY doc_id, j)) WHERE r > 1),
around AS (SELECT m.m, l.j, l.j < m.j AS early, f.j IS NOT NULL AS same
           FROM matches m JOIN sums a ON a.doc_id = m.doc_id AND a.j = m.j JOIN sums z ON z.doc_id = m.doc_id AND z.j = m.e
           JOIN sums l ON l.doc_id = m.doc_id AND ((l.j < m.j AND (a.c - a.w) - (l.c - l.w) <= 50) OR (l.j > m.e AND l.c - z.c <= 50))
           LEFT JOIN lines f ON f.doc_id = m.d0 AND f.j = m.j0 + l.j - m.j AND f.s = l.s),
runs AS (SELECT m.doc_id, coalesce(x.lo, m.j) AS lo, coalesce(x.hi, m.e) AS hi FROM matches m LEFT JOIN (
           SELECT m, coalesce(max(j) FILTER (WHERE early AND NOT same) + 1, min(j) FILTER (WHERE early)) AS lo,
                  coalesce(min(j) FILTER (WHERE NOT early AND NOT same) - 1, max(j) FILTER (WHERE NOT early)) AS hi
           FROM around GROUP BY m) x ON x.m = m.m),
wins AS (SELECT doc_id, j, 3 AS n, s || chr(10) || lead(s) OVER w || chr(10) || lead(s, 2) OVER w AS key
         FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY j)
         UNION ALL SELECT doc_id, j, 1, s FROM lines WHERE length(s) >= 200),
later AS (SELECT doc_id, j, n FROM (SELECT *, row_number() OVER (PARTITION BY n, key ORDER BY doc_id, j) AS r FROM wins WHERE key IS NOT NULL)
          WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, g AS j FROM (SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, j, j + n - 1 FROM later),
                unnest(range(lo, hi + 1)) t(g)),
cut AS (SELECT raw.doc_id, string_agg(raw.ls[i], chr(10) ORDER BY i) AS kept
        FROM raw, unnest(range(1, len(ls) + 1)) t(i)
        WHERE NOT EXISTS (SELECT 1 FROM gone JOIN lines ON gone.doc_id = lines.doc_id AND gone.j = lines.j
                          WHERE lines.doc_id = raw.doc_id AND lines.i = t.i) GROUP BY raw.doc_id),
counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR j - before > 1) AS runs
           FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM gone) GROUP BY doc_id)
SELECT raw.doc_id, CAST(len(raw.ls) AS BIGINT) AS n_lines, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(counts.runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(cut.kept, '')) AS kept_sha256
FROM raw LEFT JOIN cut ON raw.doc_id = cut.doc_id LEFT JOIN counts ON raw.doc_id = counts.doc_id
"""


def _licence_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in licences.known_sentences().items())
    rules = sorted(licences.RULES, key=lambda r: -len(r[1]))
    seq, hits = ["seq AS s0"], []
    for i, (licence, ids) in enumerate(rules):
        pattern = "".join(f"|{x}|" for x in ids)
        hits.append(f"CASE WHEN contains(s{i}, '{pattern}') THEN '{licence}' END")
        seq.append(f"replace(s{i}, '{pattern}', '||') AS s{i + 1}")
    trigger = " OR ".join(f"contains(ls[i], '{t}')" for t in licences.TRIGGERS)
    return rf"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, string_split_regex(regexp_replace(regexp_replace(translate(text, '{licences.UPPER}' || chr(13), '{licences.LOWER}'),
               '{licences.LINE_START}', chr(10), 'g'), '{licences.VERSION}', '\1 \2', 'g'), '{licences.SENTENCE_END}') AS ls FROM d),
parts AS (SELECT rid, i, ' ' || trim(regexp_replace(ls[i], '{licences.OTHER}', ' ', 'g')) || ' ' AS f
          FROM cut, unnest(range(1, len(ls) + 1)) t(i) WHERE {trigger}),
found AS (SELECT rid, i, id, strpos(f, ' ' || s || ' ') AS p, length(s) AS n, f FROM parts JOIN known ON contains(f, ' ' || s || ' ')),
taken AS (SELECT rid, i, id, p, n FROM found WHERE f[greatest(p - 3, 1):p] <> 'not ' AND NOT regexp_matches(substr(f, p + n + 1), '^{licences.LATER}')),
kept AS (SELECT * FROM taken t WHERE NOT EXISTS (SELECT 1 FROM taken o WHERE o.rid = t.rid AND o.i = t.i AND o.n > t.n AND o.p <= t.p AND o.p + o.n >= t.p + t.n)),
ids AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY i, p) AS sentence_ids, string_agg('|' || id || '|', '' ORDER BY i, p) AS seq
        FROM kept GROUP BY rid),
every AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(sentence_ids, '') AS sentence_ids, coalesce(seq, '') AS seq
          FROM d LEFT JOIN ids ON d.rid = ids.rid),
steps AS (SELECT doc_id, n, sentence_ids, {", ".join(seq)} FROM every),
hit AS (SELECT doc_id, n, sentence_ids, list_sort(list_distinct([x FOR x IN [{", ".join(hits)}] IF x IS NOT NULL])) AS l FROM steps)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, sentence_ids, CAST(len(l) AS BIGINT) AS n_licences, array_to_string(l, ',') AS licences FROM hit
"""


_OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n,
             length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) AS rn FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 13 ELSE 16 + rn END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP11 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT lang, source, row, unnest(w) AS term FROM d),
terms AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN terms USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS s FROM terms GROUP BY lang),
sums AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS s FROM cnt GROUP BY lang, source),
cell AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
                CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(k.s, 0) + 2 * l.v) AS HUGEINT) AS p,
                CAST(1 + CAST(1000000000 AS HUGEINT) * (t.total + 2) // (l.s + 2 * l.v) AS HUGEINT) AS q
         FROM grp g JOIN terms t ON g.lang = t.lang JOIN langs l ON g.lang = l.lang
         LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
         LEFT JOIN sums k ON k.lang = g.lang AND k.source = g.source),
twos AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN twos x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
own AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM cell WHERE n > 0 AND p > q),
ranked AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM own)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, encode(item)) AS r FROM ranked)
WHERE part = 'pair' OR r <= 10
"""

ORACLE: dict[str, str] = {"op11_source_divergence": _OP11, "op8_chat_formatting": _OP8, "op10_licence_scan": _licence_sql(), "op6_line_dedup": _OP6, "op4_benchmark_decontamination": _OP4}
