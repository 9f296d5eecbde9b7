"""DuckDB SQL for every named query, over the driver's base tables only.

The derived tables of ``fixtures.py`` are restated here as CTEs, written
independently in SQL, so each query is checked against a second engine.
"""

from __future__ import annotations

from scopekit import fixed_values as FV
from scopekit.functions import paths as PF
from scopekit.functions import text as TX

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _str(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


# ------------------------------------------------------------------ scalar macros

def relevant(x: str) -> str:
    f = f"replace(lower({x}), ' ', '')"
    for a, b in FV.RELEVANCE_FOLDS:
        f = f"replace({f}, {lit(a)}, {lit(b)})"
    hits = " OR ".join(f"contains({f}, {lit(t)})" for t in FV.RELEVANCE_TERMS)
    return f"coalesce(({hits}), false)"


def markup_text(x: str) -> str:
    out = f"regexp_replace({x}, {lit(TX.TAG_PATTERN)}, '', 'g')"
    for ent, ch in TX._ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def quotes_outside_tags(x: str) -> str:
    """Cut at every tag's start: what follows its end is text."""
    def plain(s):
        return f"""replace({s}, '&quot;', '"')"""
    return (f"array_to_string(list_transform(string_split({x}, '<'), lambda s, i: CASE WHEN i = 1 THEN {plain('s')} "
            f"WHEN contains(s, '>') THEN left(s, instr(s, '>')) || {plain("substr(s, instr(s, '>') + 1)")} ELSE s END), '<')")


def wrap_chunk(page_no: str, text: str) -> str:
    return f"""('<CHUNK id="' || {_str(page_no)} || '">' || {NL} || coalesce({text}, '') || {NL} || '</CHUNK>' || {NL})"""


def trim_eos(x: str) -> str:
    m = FV.EOS_MARKER
    return f"(CASE WHEN ends_with({x}, {lit(m)}) THEN left({x}, length({x}) - {len(m)}) ELSE {x} END)"


def _is_integer(json: str, text: str) -> str:
    """A JSON integer; DuckDB calls one beyond 64 bits a DOUBLE, but keeps its digits as text."""
    return f"({json} IN ('BIGINT', 'UBIGINT') OR ({json} = 'DOUBLE' AND regexp_full_match({text}, '-?[0-9]{{19,}}')))"


def json_valid_record(t: str) -> str:
    """Strict record check: one JSON object, scope keys present as integers or null, sources an array of integers with at
    most five distinct values."""
    def int_or_null(k):
        ty = f"json_type({t}, '$.{k}')"
        return f"coalesce({ty} = 'NULL' OR {_is_integer(ty, f"json_extract_string({t}, '$.{k}')")}, false)"
    scopes = " AND ".join(int_or_null(k) for k in FV.SCOPE_KEYS)
    elems = f"json_extract({t}, '$.sources[*]')"
    return (f"(CASE WHEN coalesce(json_valid({t}), false) THEN coalesce("
            f"json_type({t}) = 'OBJECT' AND {scopes}"
            f" AND coalesce(json_type({t}, '$.sources') = 'ARRAY', false)"
            f" AND coalesce(list_bool_and(list_transform({elems}, lambda x: {_is_integer('json_type(x)', 'CAST(x AS VARCHAR)')})), true)"
            f" AND len(list_distinct(list_transform({elems}, lambda x: CAST(x AS VARCHAR)))) <= {FV.MAX_SOURCES}, false)"
            f" ELSE false END)")


def _to_bigint(text: str) -> str:
    """The integer, or the end of the range that it lies beyond."""
    return (f"(CASE WHEN {text} IS NOT NULL THEN coalesce(TRY_CAST({text} AS BIGINT), CASE WHEN starts_with({text}, '-') "
            f"THEN -9223372036854775808 ELSE 9223372036854775807 END) END)")


def parsed_scope(t: str, k: str) -> str:
    return _to_bigint(f"json_extract_string({t}, '$.{k}')")


def parsed_sources(t: str) -> str:
    return f"list_sort(list_distinct(list_transform(json_extract({t}, '$.sources[*]'), lambda x: {_to_bigint('CAST(x AS VARCHAR)')})))"


def record_text(s1: str, s2: str, s3: str, sources: str) -> str:
    def num(c):
        return f"coalesce({_str(c)}, 'null')"
    return (f"""('{{"scope_1":' || {num(s1)} || ',"scope_2":' || {num(s2)} || ',"scope_3":' || {num(s3)}"""
            f""" || ',"sources":[' || array_to_string({sources}, ',') || ']}}')""")


def _hex_u32(x: str, start: int) -> str:
    return f"CAST(('0x' || substr(md5({x}), {start}, 8)) AS UBIGINT)"


def random_value(key: str) -> str:
    u = f"(CAST({_hex_u32(key, 1)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"
    e = f"CAST({_hex_u32(key, 9)} % {FV.REJECTED_MAX_EXPONENT + 1} AS DOUBLE)"
    return f"CAST(floor({u} * pow(CAST(10 AS DOUBLE), {e})) AS BIGINT)"


def random_page(key: str) -> str:
    return f"CAST({_hex_u32(key, 9)} % {FV.REJECTED_MAX_PAGE + 1} AS BIGINT)"


def strict_ok(p: str, t: str) -> str:
    rp, rt = f"round_even(CAST({p} AS DOUBLE), 0)", f"round_even(CAST({t} AS DOUBLE), 0)"
    return (f"(({p} IS NULL AND {t} IS NULL) OR coalesce(abs({rp} - {rt}) <= "
            f"CAST({FV.STRICT_ATOL!r} AS DOUBLE) + CAST({FV.STRICT_RTOL!r} AS DOUBLE) * abs({rt}), false))")


def tolerant_ok(p: str, t: str) -> str:
    pd_, td = f"CAST({p} AS DOUBLE)", f"CAST({t} AS DOUBLE)"
    return (f"(({p} IS NULL AND {t} IS NULL) OR coalesce(abs({pd_} - {td}) <= "
            f"CAST({FV.TOLERANT_ATOL!r} AS DOUBLE) + CAST({FV.TOLERANT_RTOL!r} AS DOUBLE) * abs({td}), false))")


def _digits(x: str) -> str:
    return f"rtrim(CAST(CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT) AS VARCHAR), '0')"


def graceful_ok(p: str, t: str) -> str:
    return f"({_digits(p)} IS NOT DISTINCT FROM {_digits(t)})"


def model_of(doc: str) -> str:
    names = ", ".join(lit(n) for n in FV.MODEL_NAMES)
    return f"([{names}])[{doc} % {len(FV.MODEL_NAMES)} + 1]"


# ------------------------------------------------------------------ derived tables (CTEs)

INSTR = lit(FV.INSTRUCTION)
ANSWER = lit(FV.ANSWER_START)
M_PRE, M_SUF = (lit(x) for x in FV.CHAT_WRAPPERS["mistral"])
STUB = lit(FV.STUB_JSON)


def _report_pages() -> str:
    n = "(doc_id + pos - 1)"
    return f"""report_pages AS (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS page_no,
         line || CASE WHEN {n} % 5 = 0 THEN ' Scope 1' WHEN {n} % 7 = 0 THEN ' SCOPES one and two'
                      WHEN {n} % 11 = 0 THEN ' s c o p e three' WHEN {n} % 13 = 0 THEN ' scope-2'
                      ELSE '' END AS page_text
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents)))"""


def _units_text() -> str:
    return f"""units AS (
  SELECT doc_id, page_no, {wrap_chunk('page_no', 'page_text')} AS unit, {relevant('page_text')} AS relevant
  FROM report_pages)"""


def _clean_markup(x: str, n: str) -> str:
    """Expression over a subquery that provides x (markup) and n (page number)."""
    return f"""(SELECT CASE WHEN length(h) > 0
              THEN h || regexp_replace(attrs, {lit(TX.ROOT_ID_ATTR_PATTERN)}, '', 'g') || ' id="' || {_str('nn')}
                   || '"' || substr(rest, length(attrs) + 1)
              ELSE x2 END
     FROM (SELECT h, x2, nn, rest, regexp_extract(rest, '^([^>]*?)/?>', 1) AS attrs
           FROM (SELECT h, x2, nn, substr(x2, length(h) + 1) AS rest
                 FROM (SELECT regexp_extract(x2, {lit(TX.ROOT_HEAD_PATTERN)}, 1) AS h, x2, nn
                       FROM (SELECT {quotes_outside_tags('x3')} AS x2, nn
                             FROM (SELECT regexp_replace({x}, {lit(TX.IMG_WITH_TAIL_PATTERN)}, '', 'g') AS x3,
                                          {n} AS nn))))))"""


def _units_xhtml() -> str:
    return f"""units AS (
  SELECT doc_id, page_no, unit, {relevant(markup_text('unit'))} AS relevant
  FROM (SELECT doc_id, page_no, {_clean_markup('page_text', 'page_no')} || {NL} AS unit FROM report_pages))"""


def _units_markup() -> str:
    """The pages of ``fixtures.markup_pages``, their added paragraph as it should be written in the end."""
    raw = """html || CASE WHEN page_id % 3 = 0 THEN '<p>Scope 1 &amp; &lt;b&gt;</p>'
                          WHEN page_id % 5 = 0 THEN '<p>&quot;SCOPES&quot; CO\u2082<br>scope two</p><i></i>'
                          ELSE '<p>none\u00a0</p>' END"""
    return f"""units AS (
  SELECT doc_id, page_no, unit, {relevant(markup_text('unit'))} AS relevant
  FROM (SELECT page_id // 4 AS doc_id, CAST(page_id % 4 AS INTEGER) AS page_no, {_clean_markup('raw', '(page_id % 4)')} || {NL} AS unit
        FROM (SELECT page_id, {raw} AS raw FROM pages)))"""


def _budget(limit_chars: float) -> str:
    rel_len = "CAST(CASE WHEN relevant THEN length(unit) ELSE 0 END AS BIGINT)"
    return f"""budget AS (
  SELECT doc_id, n_pages, n_relevant, relevant_chars, relevant_chars - last_page_chars AS chars_before_last_page,
         (relevant_chars - last_page_chars) > {limit_chars!r} AS over_budget
  FROM (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE relevant) AS n_relevant,
               CAST(sum({rel_len}) AS BIGINT) AS relevant_chars, arg_max({rel_len}, page_no) AS last_page_chars
        FROM units GROUP BY doc_id))"""


def _assembled() -> str:
    return """assembled AS (
  SELECT u.doc_id, count(*) AS n_chunks, string_agg(u.unit, '' ORDER BY u.page_no) AS user_message
  FROM units u JOIN budget b ON u.doc_id = b.doc_id
  WHERE u.relevant AND NOT b.over_budget AND b.n_relevant > 0
  GROUP BY u.doc_id)"""


DEFAULT_LIMIT = float(FV.DEFAULT_MAX_TOKENS) * FV.CHARACTERS_PER_TOKEN


def _pipeline_text() -> list[str]:
    return [_report_pages(), _units_text(), _budget(DEFAULT_LIMIT), _assembled()]


def _prompts(with_model: bool = False) -> str:
    if with_model:
        fam = ("CASE WHEN starts_with(lower(model), 'qwen') THEN 'chatml' "
               "WHEN starts_with(lower(model), 'openchat') THEN 'openchat' ELSE 'mistral' END")
        content = f"({INSTR} || {NL} || a.user_message)"
        wrapped = "CASE " + " ".join(
            f"WHEN fam = {lit(f)} THEN {lit(FV.CHAT_WRAPPERS[f][0])} || {content} || {lit(FV.CHAT_WRAPPERS[f][1])}"
            for f in ("chatml", "openchat")) + f" ELSE {M_PRE} || {content} || {M_SUF} END"
        src = f"(SELECT doc_id, {model_of('doc_id')} AS model, {fam.replace('model', model_of('doc_id'))} AS fam FROM documents)"
        extra = "d.model, "
    else:
        wrapped = f"{M_PRE} || {INSTR} || {NL} || a.user_message || {M_SUF}"
        src = "(SELECT doc_id FROM documents)"
        extra = ""
    return f"""prompts AS (
  SELECT d.doc_id, {extra}
         CASE WHEN coalesce(b.over_budget, false) THEN 'over_budget' WHEN a.user_message IS NULL
              THEN 'no_relevant_pages' ELSE 'ok' END AS status,
         CASE WHEN NOT coalesce(b.over_budget, false) AND a.user_message IS NOT NULL
              THEN {wrapped} || {ANSWER} END AS prompt
  FROM {src} d LEFT JOIN budget b ON d.doc_id = b.doc_id LEFT JOIN assembled a ON d.doc_id = a.doc_id)"""


def _model_config() -> str:
    import json
    cfg = json.loads(FV.MODEL_CONFIG_JSON)
    rows = ", ".join(f"({lit(k)}, {int(v['context_size'])}, {lit(v['model_path'])})" for k, v in cfg.items())
    return f"cfg AS (SELECT model, CAST(context_size AS INTEGER) AS context_size, model_path FROM (VALUES {rows}) t(model, context_size, model_path))"


def _html_pages() -> str:
    return """html_pages AS (SELECT page_id, replace(html, '<br>', '<img src="x">tail') AS html FROM pages)"""


def _ground_truth() -> str:
    k, p = "o_orderkey", "o_totalprice"

    def val(x, mod):
        return f"CAST(CASE WHEN {k} % {mod} = 0 THEN NULL ELSE floor({x}) END AS DOUBLE)"

    def i(x):
        return f"CAST({x} AS INTEGER)"
    return f"""ground_truth AS (
  SELECT CAST({k} AS VARCHAR) AS id, {val(p, 10)} AS scope_1, {val(p + ' / 2', 3)} AS scope_2_market,
         {val(p + ' / 3', 9)} AS scope_2_location, {val(p + ' * 10', 4)} AS scope_3,
         [{i(k + ' % 50')}, {i(k + ' % 50 + 1')}] AS scope_1_page, [{i(k + ' % 40')}] AS scope_2_market_page,
         [{i(k + ' % 30')}] AS scope_2_location_page,
         CASE WHEN {k} % 4 = 0 THEN CAST([] AS INTEGER[]) ELSE [{i(k + ' % 20')}] END AS scope_3_page
  FROM orders)"""


def _predictions() -> str:
    def pv(v):
        return (f"CAST(CASE WHEN h = 4 THEN floor({v} * 1.05) WHEN h = 5 THEN {v} * 1000 WHEN h = 6 THEN NULL "
                f"WHEN h = 7 THEN -1 WHEN h = 8 THEN floor({v} * 1.3) WHEN h = 9 THEN {v} + 1 ELSE {v} END AS BIGINT)")
    return f"""predictions AS (
  SELECT 'm' || CAST(m AS VARCHAR) AS model, id, {pv('scope_1')} AS scope_1, {pv('scope_2')} AS scope_2,
         {pv('scope_3')} AS scope_3,
         CASE WHEN h = 7 THEN CAST([-1] AS BIGINT[]) WHEN h < 6 THEN CAST([k % 50 + 1, k % 7] AS BIGINT[])
              ELSE CAST([] AS BIGINT[]) END AS sources, m
  FROM (SELECT *, (k * 7 + m * 13 * (k % (m + 2))) % 10 AS h
        FROM (SELECT CAST(id AS BIGINT) AS k, id, scope_1, coalesce(scope_2_market, scope_2_location) AS scope_2,
                     scope_3, unnest([0, 1, 2, 3]) AS m FROM ground_truth)))"""


def _raw_responses() -> str:
    def num(c):
        return f"coalesce({_str(c)}, 'null')"

    def piece(mod, text):
        return f"(CASE WHEN r % {mod} = 0 THEN {text} ELSE '' END)"
    s2 = f"CASE WHEN r % 53 = 0 THEN '1000000000000000000' WHEN r % 61 = 0 THEN '-123456789012345678901234' ELSE {num('scope_2')} END"
    longs = "[" + ",".join(str(10 ** 19 + i) for i in range(6)) + "]"
    body = (f"""'{{"scope_1":' || (CASE WHEN r % 71 = 0 THEN '5,"scope_1":' ELSE '' END) || {num('scope_1')} || (CASE WHEN r % 23 = 0 AND scope_1 IS NOT NULL THEN '.0' ELSE '' END)"""
            f""" || ',"scope_2":' || ({s2})"""
            f""" || (CASE WHEN r % 31 = 0 THEN '' ELSE ',"scope_3":' || {num('scope_3')} END)"""
            f""" || ',"sources":' || (CASE WHEN r % 19 = 0 THEN '[1,2,3,4,5,6]' WHEN r % 59 = 0 THEN '{longs}' WHEN r % 37 = 0 THEN 'null'"""
            f""" WHEN r % 41 = 0 AND len(sources) > 0 THEN '[' || array_to_string(sources, ',') || ',' || {_str('sources[1]')} || ']'"""
            f""" ELSE '[' || array_to_string(sources, ',') || ']' END)"""
            f""" || (CASE WHEN r % 47 = 0 THEN ',"note":"a }} {{b"' ELSE '' END) || '}}'""")
    resp = (f"{piece(43, lit(' '))} || left(body, length(body) - (CASE WHEN r % 13 = 0 THEN 1 ELSE 0 END))"
            f" || {piece(29, lit(' trailing'))} || {piece(43, NL)} || {piece(17, lit('</s>'))}")
    return f"""raw_responses AS (
  SELECT model, id, seq, {resp} AS response
  FROM (SELECT model, id, seq, r, CASE WHEN r % 67 = 0 THEN replace({body}, '"', '''') ELSE {body} END AS body
        FROM (SELECT *, CAST(m AS BIGINT) AS seq, CAST(id AS BIGINT) * 4 + m AS r FROM predictions)))"""


def _chat() -> str:
    return """chat AS (
  SELECT conv_id, turn, prompt, completion
  FROM (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS next_role, lead(text) OVER w AS completion
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def _manifest() -> str:
    flipped = "(CASE WHEN substr(h, 1, 1) = '0' THEN '1' ELSE '0' END) || substr(h, 2)"
    return f"""manifest AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, p.url,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 9 = 0 THEN {flipped} ELSE h END AS sha256
  FROM (SELECT doc_id, sha256(text) AS h, doc_id % (SELECT count(*) FROM pages) AS page_id FROM documents) d
  LEFT JOIN pages p ON p.page_id = d.page_id)"""


def _verified() -> str:
    return """verified AS (
  SELECT m.id, m.url, CASE WHEN c.actual IS NULL THEN 'missing' WHEN m.sha256 IS NULL THEN 'unchecked'
                           WHEN lower(m.sha256) = c.actual THEN 'ok' ELSE 'conflict' END AS status
  FROM manifest m LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, lower(sha256(text)) AS actual FROM documents) c
  ON m.id = c.id)"""


CACHE_SUFFIX = FV.CHAT_WRAPPERS["mistral"][1] + FV.ANSWER_START + "\n"


def _prompt_cache() -> str:
    return f"""prompt_cache AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         {M_PRE} || {INSTR} || {NL} || coalesce(a.user_message, '') || {lit(CACHE_SUFFIX)} AS text
  FROM documents d LEFT JOIN assembled a ON d.doc_id = a.doc_id WHERE d.doc_id % 2 = 0)"""


def _stripped() -> str:
    pre, suf = FV.CHAT_WRAPPERS["mistral"][0], CACHE_SUFFIX
    return f"""stripped AS (
  SELECT id, CASE WHEN starts_with(text, {lit(pre)}) AND ends_with(text, {lit(suf)})
                       AND length(text) >= {len(pre) + len(suf)}
                  THEN substr(text, {len(pre) + 1}, length(text) - {len(pre) + len(suf)}) ELSE text END AS content
  FROM prompt_cache)"""


def _empty_prompt(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {lit(FV.FORMAT_END + r'\s*$')}), false)"


def _value_acc() -> list[str]:
    keys = FV.SCOPE_KEYS
    union = " UNION ALL ".join(
        f"SELECT model, '{k}' AS key, p.{k} AS pred, t.{k} AS truth FROM predictions p JOIN truth t ON p.id = t.id"
        for k in keys)
    truth = ("truth AS (SELECT id, scope_1, coalesce(scope_2_market, scope_2_location) AS scope_2, scope_3 "
             "FROM ground_truth)")
    modes = {"strict": strict_ok, "tolerant": tolerant_ok, "graceful": graceful_ok}
    cnt = ", ".join(f"count(*) FILTER (WHERE {f('pred', 'truth')}) AS {m}_correct" for m, f in modes.items())
    acc = ", ".join(f"round(CASE WHEN n > 0 THEN {m}_correct / n END, 6) AS {m}_accuracy" for m in modes)
    return [truth, f"""acc AS (
  SELECT model, key, n, {', '.join(f'{m}_correct' for m in modes)}, {acc}
  FROM (SELECT model, key, count(*) AS n, {cnt}
        FROM ({union}) WHERE pred IS NULL OR pred <> -1 GROUP BY model, key))""",
            """long_acc AS (
  SELECT model, key, n, 'strict' AS mode, strict_correct AS correct, strict_accuracy AS accuracy FROM acc
  UNION ALL SELECT model, key, n, 'tolerant', tolerant_correct, tolerant_accuracy FROM acc
  UNION ALL SELECT model, key, n, 'graceful', graceful_correct, graceful_accuracy FROM acc)""",
            """avg_acc AS (
  SELECT model, mode, count(*) AS n_keys, round(avg(accuracy), 6) AS average
  FROM long_acc GROUP BY model, mode HAVING count(*) > 1)"""]


def _source_acc() -> str:
    return """src_acc AS (
  SELECT model, n, correct, round(CASE WHEN n > 0 THEN correct / n END, 6) AS accuracy
  FROM (SELECT model, count(*) AS n,
               count(*) FILTER (WHERE coalesce(list_has_any(p.sources, CAST(t.scope_1_page AS BIGINT[])), false)) AS correct
        FROM predictions p JOIN ground_truth t ON p.id = t.id GROUP BY model))"""


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _pair_key(field: str) -> str:
    return f"(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || ':{field}:0')"


def _rejected_json() -> str:
    return record_text(random_value(_pair_key("scope_1")), random_value(_pair_key("scope_2")),
                       random_value(_pair_key("scope_3")), f"[{random_page(_pair_key('sources'))}]")


def _validated(src: str, cols: str) -> str:
    """Validity first; values are extracted only from valid rows (invalid text is not parsed)."""
    t = "t"
    vals = ", ".join(f"CASE WHEN valid THEN {parsed_scope(t, k)} END AS p_{k}" for k in FV.SCOPE_KEYS)
    return f"""(SELECT {cols}, valid, {vals}, CASE WHEN valid THEN {parsed_sources(t)} END AS p_sources
        FROM (SELECT {cols}, {t}, {json_valid_record(t)} AS valid
              FROM (SELECT {cols}, replace(t, '{{"scope_1":5,"scope_1":', '{{"scope_1":') AS t FROM {src})))"""


def _stub_or(valid: str) -> str:
    scopes = ", ".join(f"CASE WHEN {valid} THEN p_{k} ELSE -1 END AS {k}" for k in FV.SCOPE_KEYS)
    return f"CASE WHEN {valid} THEN 'ok' ELSE 'failed' END AS status, {scopes}, CASE WHEN {valid} THEN p_sources ELSE CAST([-1] AS BIGINT[]) END AS sources"


def _clip(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {FV.CLIP_MIN}), {FV.CLIP_MAX}) END"


def _training_templates() -> str:
    from scopekit.operators.training import TRAINING_TEMPLATES
    rows = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in TRAINING_TEMPLATES.items())
    return f"templates AS (SELECT * FROM (VALUES {rows}) t(template, format))"


def _output_files() -> str:
    return """output_files AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'report ' || doc_id WHEN 2 THEN doc_id || '#a' WHEN 3 THEN '100% ' || doc_id WHEN 4 THEN 'ä+' || doc_id
                                 WHEN 5 THEN 'd/' || doc_id WHEN 6 THEN '_' || doc_id || '.x' ELSE CAST(doc_id AS VARCHAR) END AS id,
         CASE WHEN doc_id % 7 = 0 THEN '{' WHEN doc_id % 10 = 3 THEN '{"scope_1":-1,"scope_2":-1,"scope_3":-1,"sources":[-1]}'
              ELSE '{"scope_1":' || n_chars || ',"scope_2":null,"scope_3":' || doc_id * 3000000 || ',"sources":[' || doc_id % 5 || ',' || doc_id % 3 || ']}'
         END AS value FROM documents)"""


def _file_queries(text: list[str]) -> dict[str, str]:
    q: dict[str, str] = {}
    bad = "doc_id % 7 = 0"
    q["output_files"] = _with([_output_files()], f"""
SELECT 'm' AS model, id, CASE WHEN {bad} THEN 'failed' ELSE 'ok' END AS status,
       CAST(CASE WHEN {bad} OR doc_id % 10 = 3 THEN -1 ELSE d.n_chars END AS BIGINT) AS scope_1,
       CAST(CASE WHEN {bad} OR doc_id % 10 = 3 THEN -1 END AS BIGINT) AS scope_2,
       CAST(CASE WHEN {bad} OR doc_id % 10 = 3 THEN -1 ELSE least(doc_id * 3000000, 1000000000) END AS BIGINT) AS scope_3,
       CASE WHEN {bad} OR doc_id % 10 = 3 THEN CAST([-1] AS BIGINT[]) ELSE list_sort(list_distinct(CAST([doc_id % 5, doc_id % 3] AS BIGINT[]))) END AS sources
FROM output_files JOIN documents d USING (doc_id)""")
    # what the format's rules make of each kind of markup, written out
    q["odd_markup_clean"] = """
SELECT page_id, CASE page_id % 6
         WHEN 0 THEN '<div' || a || '><!-- <img src="a>b">x --><p>' || e || '</p></div>'
         WHEN 1 THEN '<div class="a>b"' || a || '>1 &lt; 2 &amp;amp; &lt;img&gt;<p>' || e || '</p></div>'
         WHEN 2 THEN '<div' || a || '><p>' || e || '</p>end</div>'
         WHEN 3 THEN '<?xml version="1.0"?><div title=''q"r>''' || a || '><!-- c -->' || e || '</div>'
         WHEN 4 THEN '<div lang="en"' || a || '><p>&lt;&lt;</p><!----><br><i></i>é</div>'
         ELSE '<div' || a || '><p>' || e || '</p>stays<image>x</image></div>' END AS markup,
       CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '1 < 2 &amp; <img>' || url WHEN 2 THEN 'inner boldtailmore' || url || 'end'
            WHEN 3 THEN 'gone' || url WHEN 4 THEN '<<' || url || 'é' ELSE url || 'gonestaysx' END AS text
FROM (SELECT page_id, url, replace(url, '&', '&amp;') AS e, ' id="' || page_id || '"' AS a FROM pages)"""
    q["response_files"] = _with([_output_files()], """
SELECT id, CASE WHEN doc_id % 9 <> 0 THEN value END AS response, CASE WHEN doc_id % 9 = 0 THEN 'missing' END AS error FROM output_files""")
    cache = text + [_prompt_cache(), _stripped()]
    q["prompt_files"] = _with(cache, "SELECT id, content FROM stripped")
    q["prompt_file_stats"] = _with(cache, """
SELECT max(t) AS max_tokens, min(t) AS min_tokens, round(avg(t), 6) AS mean_tokens, CAST(median(t) AS DOUBLE) AS median_tokens, count(*) AS n_prompts
FROM (SELECT CAST(ceil(length(text) / 3.5) AS BIGINT) AS t FROM prompt_cache)""")
    q["page_split_files"] = f"""
SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS page_no, unnest(parts) AS page_text
FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS parts FROM documents)"""
    pr = [_ground_truth(), _predictions()]
    q["ordered_outputs"] = _with(pr, "SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY id) - 1 AS place FROM predictions")
    q["merged_prompt_stats"] = """
SELECT max(t) AS max_tokens, min(t) AS min_tokens, round(sum(t) / count(*), 6) AS mean_tokens, count(*) AS n_prompts, true AS median_close
FROM (SELECT CAST(ceil(n_chars / 3.5) AS BIGINT) AS t FROM documents)"""
    fam = "CASE WHEN starts_with(model, 'qwen') THEN '[PAD151643]' WHEN starts_with(model, 'openchat') THEN '<|end_of_turn|>' ELSE '</s>' END"
    q["trim_model_markers"] = f"""
SELECT doc_id, model, '{{"doc":' || doc_id || '}}' || CASE WHEN printed <> own THEN printed ELSE '' END AS response
FROM (SELECT doc_id, model, {fam} AS own, CASE WHEN doc_id % 5 = 3 THEN (['</s>', '<|end_of_turn|>', '[PAD151643]'])[doc_id % 3 + 1] ELSE {fam} END AS printed
      FROM (SELECT doc_id, {model_of('doc_id')} AS model FROM documents))"""
    q["manifest_rounds"] = _with([_manifest()], """
SELECT id, url, status, CASE WHEN status = 'ok' THEN 'keep' ELSE 'fetch' END AS action,
       CASE WHEN status = 'ok' OR saved THEN 'ok' ELSE 'failed' END AS outcome, saved
FROM (SELECT id, url, status, status <> 'ok' AND n % 17 <> 0 AND (sha256 IS NULL OR sha256 = h) AS saved
      FROM (SELECT m.*, d.doc_id AS n, sha256(d.text) AS h,
                   CASE WHEN d.doc_id % 13 = 0 THEN 'missing' WHEN m.sha256 IS NULL THEN 'unchecked'
                        WHEN m.sha256 = sha256(d.text) THEN 'ok' ELSE 'conflict' END AS status
            FROM manifest m JOIN documents d ON m.id = CAST(d.doc_id AS VARCHAR)))""")
    q["digest_rounds"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(octet_length(encode(t)) AS BIGINT) AS length, sha256(t) AS sha256, doc_id % 4 = 0 AS hashed
FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN {NL} ELSE '' END AS t FROM documents)"""
    return q


def queries() -> dict[str, str]:
    text = _pipeline_text()
    q: dict[str, str] = {}
    rp = [_report_pages()]
    q["page_split"] = _with(rp, "SELECT doc_id, page_no, page_text FROM report_pages")
    q["relevant_flag"] = _with(rp, f"SELECT doc_id, page_no, {relevant('page_text')} AS relevant FROM report_pages")
    q["page_wrap"] = _with(rp + [_units_text()], "SELECT doc_id, page_no, unit AS chunk FROM units")
    q["relevant_pages"] = _with(rp + [_units_text()], "SELECT doc_id, page_no, unit AS chunk FROM units WHERE relevant")
    q["page_plaintext"] = _with([_html_pages()], f"SELECT page_id, {markup_text('html')} AS text FROM html_pages")
    q["page_clean"] = _with([_html_pages()], f"SELECT page_id, {_clean_markup('html', 'page_id')} AS html FROM html_pages")
    q["assemble_documents"] = _with(text, "SELECT doc_id, n_chunks, user_message FROM assembled")
    from scopekit.plans.catalog import OVER_BUDGET_TOKENS
    q["over_budget"] = _with(rp + [_units_xhtml(), _budget(OVER_BUDGET_TOKENS * FV.CHARACTERS_PER_TOKEN)],
                             "SELECT doc_id, n_pages, n_relevant, relevant_chars, chars_before_last_page, over_budget FROM budget")
    q["build_prompt"] = _with(text + [_prompts()], "SELECT doc_id, status, prompt FROM prompts")
    limited = rp + [_units_text(), _budget(OVER_BUDGET_TOKENS * FV.CHARACTERS_PER_TOKEN), _assembled()]
    q["build_prompt_limited"] = _with(limited + [_prompts()], "SELECT doc_id, status, prompt FROM prompts")
    markup = [_units_markup(), _budget(DEFAULT_LIMIT), _assembled()]
    q["assemble_xhtml"] = _with(markup, "SELECT doc_id, n_chunks, user_message FROM assembled")
    q["build_prompt_xhtml"] = _with(markup + [_prompts().replace("FROM (SELECT doc_id FROM documents) d",
                                                                 "FROM (SELECT DISTINCT doc_id FROM units) d")],
                                    "SELECT doc_id, status, prompt FROM prompts")
    tok = "CAST(ceil(length(prompt) / 3.5) AS BIGINT)"
    tokens = f"CASE WHEN starts_with(lower(model), 'qwen') THEN CAST(floor({tok} * 1.2) AS BIGINT) ELSE {tok} END"
    q["context_plan"] = _with(text + [_prompts(True), _model_config()], f"""
SELECT doc_id, model, context_size, prompt_tokens, context,
       CAST(CASE WHEN context > context_size THEN {FV.DEFAULT_MAX_NEIGHBOUR} ELSE {FV.DISABLED_NEIGHBOUR} END AS INTEGER) AS group_neighbour,
       CAST(CASE WHEN context > context_size THEN least(CAST(floor(context_size / 2.0) AS BIGINT), {FV.DEFAULT_MAX_WINDOW})
                 ELSE {FV.DISABLED_WINDOW} END AS INTEGER) AS group_window
FROM (SELECT doc_id, model, context_size, prompt_tokens, prompt_tokens + {FV.CONTEXT_MARGIN} AS context
      FROM (SELECT p.doc_id, p.model, c.context_size, {tokens.replace('model', 'p.model')} AS prompt_tokens
            FROM prompts p JOIN cfg c ON p.model = c.model WHERE p.prompt IS NOT NULL))""")
    q["context_plan_extended"] = q["context_plan"].replace(
        _model_config(), _model_config().replace("CAST(context_size AS INTEGER)", "CAST(context_size // 32 AS INTEGER)"))
    q["prompt_stats"] = _with(text + [_prompts()], f"""
SELECT max(t) AS max_tokens, min(t) AS min_tokens, round(avg(t), 6) AS mean_tokens,
       CAST(median(t) AS DOUBLE) AS median_tokens, count(*) AS n_prompts
FROM (SELECT CAST(ceil(length(prompt || {NL}) / 3.5) AS BIGINT) AS t FROM prompts WHERE prompt IS NOT NULL)""")
    q["token_estimate"] = "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS n_tokens FROM documents"
    q["model_lookup"] = _with([_model_config()], f"""
SELECT d.doc_id, d.model, c.context_size, c.model_path
FROM (SELECT doc_id, {model_of('doc_id')} AS model FROM documents) d JOIN cfg c ON d.model = c.model""")
    from scopekit.plans.catalog import LORA_PATH
    seg = f"regexp_extract(model_path, {lit(PF.LAST_SEGMENT_PATTERN)}, 1)"
    q["run_name"] = _with([_model_config()], f"""
SELECT doc_id, model, lora, run_name, 'outputs/' || run_name || '/' || CAST(doc_id AS VARCHAR) || '.json' AS output_path,
       'prompts/generated/' || {seg} || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS prompt_path
FROM (SELECT d.doc_id, d.model, c.model_path, CASE WHEN d.doc_id % 2 = 1 THEN {lit(LORA_PATH)} ELSE '' END AS lora,
             {seg} || CASE WHEN d.doc_id % 2 = 1 THEN '-lora' ELSE '' END AS run_name
      FROM (SELECT doc_id, {model_of('doc_id')} AS model FROM documents) d JOIN cfg c ON d.model = c.model)""")
    uid = "CAST(doc_id AS VARCHAR)"
    q["id_from_path"] = f"""
SELECT doc_id, path, regexp_extract(path, {lit(PF.STEM_PATTERN)}, 1) AS stem
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdfs/' || {uid} || '.pdf'
                                     WHEN 1 THEN 'outputs/Mixtral-8x7B-Instruct-v0.1/' || {uid} || '.json'
                                     WHEN 2 THEN '/data/archive/' || {uid} || '.tar.gz'
                                     WHEN 3 THEN 'runs/' || {uid} || '/'
                                     WHEN 4 THEN {uid}
                                     ELSE 'models/' || {uid} || '.v0.1.parquet' END AS path FROM documents)"""
    q["location_kind"] = f"""
SELECT page_id, scheme, CASE WHEN scheme IN ('http', 'https', 'ftp') THEN 'remote' WHEN scheme IN ('', 'file') THEN 'local'
                             ELSE 'unsupported' END AS kind
FROM (SELECT page_id, lower(regexp_extract(url, {lit(PF.SCHEME_PATTERN)}, 1)) AS scheme FROM pages)"""
    q["scan_file_stem"] = "SELECT doc_id, 'documents' AS stem FROM documents"
    q["location_check"] = _with([_manifest()], f"""
SELECT l.id, l.location,
       CASE WHEN s.path IS NOT NULL THEN 'file'
            WHEN lower(regexp_extract(l.location, {lit(PF.SCHEME_PATTERN)}, 1)) IN ('http', 'https', 'ftp') THEN 'remote'
            ELSE 'error' END AS kind
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, 'pdfs/' || CAST(doc_id AS VARCHAR) || '.pdf' AS location FROM documents
      UNION ALL SELECT id, url AS location FROM manifest) l
LEFT JOIN (SELECT DISTINCT 'pdfs/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path FROM documents WHERE doc_id % 4 <> 0) s
ON l.location = s.path""")
    man = [_manifest()]
    q["scan_manifest"] = _with(man, "SELECT id, url, sha256 FROM manifest")
    q["verify_manifest"] = _with(man + [_verified()], "SELECT id, url, status FROM verified")
    q["failed_ids"] = _with(man + [_verified()], "SELECT id, status FROM verified WHERE status IN ('conflict', 'missing')")
    pending = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)"
    q["resume_pending"] = pending
    ids = """regexp_extract_all(prompt, '<CHUNK id="(\\d+)">', 1)"""
    scored = (f"""'{{"scope_1":' || CAST(len({ids}) AS VARCHAR) || ',"scope_2":' || CAST(length(prompt) AS VARCHAR)"""
              f""" || ',"scope_3":' || (CASE WHEN length(prompt) % 2 = 1 THEN CAST(length(prompt) % 1000 AS VARCHAR) ELSE 'null' END)"""
              f""" || ',"sources":[' || array_to_string({ids}, ',') || ']}}' || {lit(FV.EOS_MARKER)}""")
    q.update(_file_queries(text))
    pend_prompts = text + [_prompts().replace("FROM (SELECT doc_id FROM documents) d",
                                              f"FROM ({pending}) d")]
    scored_rows = f"""
SELECT doc_id, {_stub_or('valid')}
FROM {_validated(f"(SELECT doc_id, {trim_eos(scored)} AS t FROM prompts WHERE status = 'ok')", 'doc_id')}
UNION ALL
SELECT doc_id, status, CASE WHEN status = 'over_budget' THEN -1 END AS scope_1,
       CASE WHEN status = 'over_budget' THEN -1 END AS scope_2, CASE WHEN status = 'over_budget' THEN -1 END AS scope_3,
       CASE WHEN status = 'over_budget' THEN CAST([-1] AS BIGINT[]) ELSE CAST([] AS BIGINT[]) END AS sources
FROM prompts WHERE status <> 'ok'"""
    q["batch_score"] = _with(pend_prompts, scored_rows)
    q["extraction_records"] = _with(text + [_prompts()], f"""
SELECT 'echo' AS model, CAST(doc_id AS VARCHAR) AS id, status, scope_1, scope_2, scope_3, sources FROM ({scored_rows})""")
    q["batch_score_limited"] = _with(limited + pend_prompts[len(text):], scored_rows)
    gt, pr = [_ground_truth()], [_ground_truth(), _predictions()]
    raw = pr + [_raw_responses()]
    q["trim_eos"] = _with(raw, f"SELECT model, id, {trim_eos('response')} AS response FROM raw_responses")
    q["validate_output"] = _with(raw, f"""
SELECT model, id, valid FROM {_validated(f"(SELECT model, id, {trim_eos('response')} AS t FROM raw_responses)", 'model, id')}""")
    q["stub_on_failure"] = _with(raw, f"""
SELECT model, id, seq, {_stub_or('valid')}
FROM {_validated(f"(SELECT model, id, seq, {trim_eos('response')} AS t FROM raw_responses)", 'model, id, seq')}""")
    q["record_json"] = _with(pr, f"SELECT model, id, {record_text('scope_1', 'scope_2', 'scope_3', 'sources')} AS record FROM predictions")
    q["collect_outputs"] = _with(pr, f"""
SELECT model, id, {_clip('scope_1')} AS scope_1, {_clip('scope_2')} AS scope_2, {_clip('scope_3')} AS scope_3, sources
FROM predictions""")
    q["scan_predictions"] = _with(pr, "SELECT model, id, scope_1, scope_2, scope_3, sources FROM predictions")
    q["collect_two_models"] = q["scan_predictions"]
    q["drop_stubs"] = _with(raw, f"SELECT model, id, response FROM raw_responses WHERE response <> {STUB}")
    q["last_response"] = _with(raw, "SELECT id, arg_max(response, seq) AS response FROM raw_responses GROUP BY id")
    q["scope2_truth"] = _with(gt, "SELECT id, coalesce(scope_2_market, scope_2_location) AS scope_2 FROM ground_truth")
    q["truth_pages"] = _with(gt, """
SELECT id, CAST(list_sort(list_distinct(flatten([coalesce(scope_1_page, CAST([] AS INTEGER[])),
       coalesce(scope_2_market_page, CAST([] AS INTEGER[])), coalesce(scope_2_location_page, CAST([] AS INTEGER[])),
       coalesce(scope_3_page, CAST([] AS INTEGER[]))]))) AS BIGINT[]) AS true_pages FROM ground_truth""")
    q["cited_pages"] = _with(pr, """
SELECT p.model, p.id, list_sort(list_intersect(p.sources, CAST(t.scope_1_page AS BIGINT[]))) AS cited
FROM predictions p JOIN ground_truth t ON p.id = t.id""")
    q["pred_truth_join"] = _with(pr, """
SELECT p.id, p.model, p.scope_1 AS pred_scope_1, p.scope_2 AS pred_scope_2, p.scope_3 AS pred_scope_3,
       t.scope_1 AS true_scope_1, coalesce(t.scope_2_market, t.scope_2_location) AS true_scope_2, t.scope_3 AS true_scope_3
FROM predictions p JOIN ground_truth t ON p.id = t.id""")
    va = pr + _value_acc()
    for m in ("strict", "tolerant", "graceful"):
        q[f"accuracy_{m}"] = _with(va, f"SELECT model, key, n, {m}_correct AS correct, {m}_accuracy AS accuracy FROM acc")
    q["accuracy_sources"] = _with(pr + [_source_acc()], "SELECT model, n, correct, accuracy FROM src_acc")
    q["accuracy_average"] = _with(va, "SELECT model, mode, n_keys, average FROM avg_acc")
    cols = ", ".join(f"max(CASE WHEN key = '{k}' THEN accuracy END) AS {k}" for k in FV.SCOPE_KEYS)
    q["metric_table"] = _with(va + [_source_acc()], f"""
SELECT w.model, w.mode, w.scope_1, w.scope_2, w.scope_3, a.average, s.accuracy AS sources
FROM (SELECT model, mode, {cols} FROM long_acc GROUP BY model, mode) w
LEFT JOIN avg_acc a ON w.model = a.model AND w.mode = a.mode LEFT JOIN src_acc s ON w.model = s.model""")
    q["bucketed_evaluation"] = q["metric_table"]
    q["bucketed_resume"] = q["resume_pending"]
    q["evaluate_directory"] = q["metric_table"].replace(_predictions(), _predictions().replace("predictions AS (", "whole AS (", 1) + """,
predictions AS (SELECT * REPLACE (CASE WHEN model <> 'm2' THEN scope_3 END AS scope_3) FROM whole)""")
    q["failure_count"] = _with(pr, """
SELECT model, count(*) AS n_reports,
       count(*) FILTER (WHERE scope_1 = -1 AND scope_2 = -1 AND scope_3 = -1 AND sources = [-1]) AS n_failed
FROM predictions GROUP BY model""")
    cache = text + [_prompt_cache(), _stripped()]
    q["strip_wrapper"] = _with(cache, "SELECT id, content FROM stripped")
    q["drop_empty_prompts"] = _with(cache, f"SELECT id, content FROM stripped WHERE NOT {_empty_prompt('content')}")
    q["training_prompts"] = _with(cache + [_ground_truth(), _predictions(), _raw_responses()], f"""
SELECT id, prompt, completion FROM (
  SELECT r.id, CASE WHEN c.content IS NOT NULL THEN (CASE WHEN NOT {_empty_prompt('c.content')} THEN c.content END)
                    WHEN coalesce(length(a.user_message), 0) > 0 THEN {INSTR} || {NL} || left(a.user_message, length(a.user_message) - 1)
               END AS prompt, r.response AS completion
  FROM (SELECT id, response FROM (SELECT id, arg_max(response, seq) AS response FROM raw_responses GROUP BY id)
        WHERE response <> {STUB}) r
  LEFT JOIN stripped c ON r.id = c.id
  LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, user_message FROM assembled) a ON r.id = a.id)
WHERE prompt IS NOT NULL""")
    q["bucketed_training"] = q["training_prompts"]
    q["training_prompts_rebuilt"] = _with(text + [_ground_truth(), _predictions(), _raw_responses()], f"""
SELECT r.id, {INSTR} || {NL} || left(a.user_message, length(a.user_message) - 1) AS prompt, r.response AS completion
FROM (SELECT id, arg_max(response, seq) AS response FROM raw_responses GROUP BY id) r
JOIN assembled a ON r.id = CAST(a.doc_id AS VARCHAR) WHERE r.response <> {STUB}""")
    q["training_prompts_from_parquet"] = _with(cache + [_ground_truth(), _predictions()], f"""
SELECT id, prompt, completion FROM (
  SELECT r.id, CASE WHEN c.content IS NOT NULL THEN (CASE WHEN NOT {_empty_prompt('c.content')} THEN c.content END)
                    WHEN coalesce(length(a.user_message), 0) > 0 THEN {INSTR} || {NL} || left(a.user_message, length(a.user_message) - 1)
               END AS prompt, r.response AS completion
  FROM (SELECT id, response FROM (SELECT id, arg_max({record_text('scope_1', 'scope_2', 'scope_3', 'sources')}, model) AS response
                                  FROM predictions GROUP BY id) WHERE response <> {STUB}) r
  LEFT JOIN stripped c ON r.id = c.id
  LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, user_message FROM assembled) a ON r.id = a.id)
WHERE prompt IS NOT NULL""")
    ch = [_chat()]
    q["sft_records"] = _with(ch, "SELECT conv_id, turn, prompt, completion FROM chat")
    q["dpo_records"] = _with(ch, f"SELECT conv_id, turn, prompt, completion AS chosen, {_rejected_json()} AS rejected FROM chat")
    q["rejected_records"] = _with(ch, f"""
SELECT conv_id, turn, {random_value(_pair_key('scope_1'))} AS rejected_scope_1, {random_value(_pair_key('scope_2'))} AS rejected_scope_2,
       {random_value(_pair_key('scope_3'))} AS rejected_scope_3, [{random_page(_pair_key('sources'))}] AS rejected_sources FROM chat""")
    from scopekit.operators.training import TRAINING_TEMPLATES
    names = ", ".join(lit(n) for n in TRAINING_TEMPLATES)
    q["render_training_text"] = _with(ch + [_training_templates()], f"""
SELECT c.conv_id, c.turn, c.template,
       replace(replace(t.format, '{{instruction}}', c.prompt), '{{prompt}}', c.prompt) || c.completion AS text
FROM (SELECT *, ([{names}])[conv_id % {len(TRAINING_TEMPLATES)} + 1] AS template FROM chat) c
JOIN templates t ON c.template = t.template""")
    q["jsonl_roundtrip"] = _with(ch, "SELECT prompt, completion FROM chat")
    return q
