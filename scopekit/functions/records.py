"""Extraction records: serialisation, strict validation, clipping, stubs, random records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scopekit import fixed_values as FV

SCOPES = FV.SCOPE_KEYS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_number(c) -> Column:
    """A value as a whole number of up to 38 digits, cut towards zero; NaN, like null, is a missing value."""
    c = _col(c)
    return F.coalesce(c.try_cast("bigint").cast("decimal(38,0)"), c.try_cast("decimal(38,0)"))


def record_struct(s1="scope_1", s2="scope_2", s3="scope_3", sources="sources") -> Column:
    return F.struct(whole_number(s1).alias("scope_1"), whole_number(s2).alias("scope_2"), whole_number(s3).alias("scope_3"),
                    F.transform(_col(sources), whole_number).alias("sources"))


def record_json(s1="scope_1", s2="scope_2", s3="scope_3", sources="sources") -> Column:
    """Compact JSON object, fixed key order, explicit nulls."""
    return F.to_json(record_struct(s1, s2, s3, sources), {"ignoreNullFields": "false"})


def clip(c) -> Column:
    """Limit to [-1, 1e9]; nulls stay null (least/greatest would skip them)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(FV.CLIP_MIN)), F.lit(FV.CLIP_MAX)))


def trim_marker(text, marker=FV.EOS_MARKER) -> Column:
    """Cut one trailing end marker, a literal or a column (the row's own marker); an empty or null one is a no-op."""
    t = _col(text)
    if not isinstance(marker, Column):
        if not marker:
            return t
        marker = F.lit(marker)
    cut = F.coalesce(t.endswith(marker), F.lit(False))
    return F.when(cut, t.substr(F.lit(1), F.length(t) - F.length(marker))).otherwise(t)


# Whole-text check: the parser reads only the first JSON value, so compare the
# structure of the text with the structure of what was parsed. Strings become
# "", numbers become 0 and white space is dropped; any text after the object
# makes the text's skeleton longer than the parsed value's.
_JSON_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'
_JSON_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _skeleton_length(text: Column) -> Column:
    s = F.regexp_replace(text, _JSON_STRING, '""')
    s = F.regexp_replace(s, _JSON_NUMBER, "0")
    return F.length(F.regexp_replace(s, r"\s+", ""))


JSON_WHITESPACE = " \t\n\r"


def _count(t: Column, ch: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def whole_text_is_object(text: Column) -> Column:
    """True when nothing but white space follows the first JSON object.

    Cheap path: the text is ``{ ... }`` with exactly one brace of each kind.
    Otherwise strings are blanked first; without nested braces the first
    object must end at the last brace; with nested braces (rare) the structure
    of the text is compared with the structure of its parsed value.
    """
    bare = F.btrim(text, F.lit(JSON_WHITESPACE))
    framed = bare.startswith(F.lit("{")) & bare.endswith(F.lit("}"))
    single = (_count(text, "{") == 1) & (_count(text, "}") == 1)
    blanked = F.regexp_replace(text, _JSON_STRING, '""')
    flat = blanked.rlike(r"^\s*\{[^{}]*\}\s*$")
    nested = blanked.rlike(r"^\s*\{[\s\S]*\{")
    exact = _skeleton_length(text) == _skeleton_length(F.to_json(F.try_parse_json(text)))
    return (F.when(~framed, F.lit(False)).when(single, F.lit(True)).when(flat, F.lit(True))
             .when(nested, exact).otherwise(F.lit(False)))


CORRUPT = "_corrupt"
LONG = r"[0-9]{19}"
LONG_INTEGER = r"(?<=[:\[,\s])(-?)[1-9][0-9]{18,}(?=\s*[,}\]])"
PARSE_SCHEMA = "scope_1 bigint, scope_2 bigint, scope_3 bigint, sources array<bigint>, _corrupt string, _distinct int"
TEXT_SCHEMA = "scope_1 string, scope_2 string, scope_3 string, sources array<string>"
BIGINT_MAX, BIGINT_MIN = 9223372036854775807, -9223372036854775808


def _whole(number: Column) -> Column:
    """A number's text as bigint; one beyond 64 bits is the end of the range (and ends at the clip limits anyway)."""
    end = F.when(number.startswith("-"), F.lit(BIGINT_MIN)).otherwise(F.lit(BIGINT_MAX))
    return F.when(number.isNotNull(), F.coalesce(number.try_cast("bigint"), end))


def _parse_long(t: Column) -> Column:
    """The typed parse of a text with long integers: their types are checked with shorter numbers in their place, their
    values are read from their own text, exact to 64 bits; distinct sources are counted by their text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    both = F.struct(F.from_json(F.regexp_replace(t, LONG_INTEGER, "$1999999999999999999"), PARSE_SCHEMA, options).alias("typed"),
                    F.from_json(t, TEXT_SCHEMA, {"allowSingleQuotes": "false"}).alias("text"))

    def exact(b: Column) -> Column:
        typed, text = b["typed"], b["text"]
        scopes = [F.when(typed[k].isNotNull(), _whole(text[k])).alias(k) for k in SCOPES]
        sources = F.when(typed["sources"].isNotNull(), F.transform(text["sources"], _whole))
        return F.struct(*scopes, sources.alias("sources"), typed[CORRUPT].alias(CORRUPT), F.size(F.array_distinct(text["sources"])).alias("_distinct"))
    return F.get(F.transform(F.array(both), exact), 0)


def parse_record(text) -> Column:
    """Typed parse: integer fields accept only JSON integers (no text, float or bool); any mismatch fills ``_corrupt``.
    Integers of 19 digits and more, which may or may not fit 64 bits, take a way of their own."""
    t = _col(text)
    plain = F.from_json(t, PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"})
    return F.when(t.rlike(LONG), _parse_long(t)).otherwise(plain)


def record_checks(text, parsed, keys) -> Column:
    """Strict record validation from the text, its typed parse and its top-level keys.

    Valid when the whole text is one JSON object; every scope key is present
    and an integer or null; ``sources`` is present, an array of integers
    without nulls and has at most five distinct values. Unknown keys are
    ignored; a repeated key keeps its last value.
    """
    t, p, k = _col(text), _col(parsed), _col(keys)
    checks = [p.isNotNull(), p[CORRUPT].isNull(), k.isNotNull()]
    checks += [F.array_contains(k, F.lit(name)) for name in (*SCOPES, "sources")]
    src = p["sources"]
    checks.append(src.isNotNull())
    checks.append(~F.array_join(src, ",", "N").contains("N"))  # no null element
    checks.append(F.coalesce(p["_distinct"], F.size(F.array_distinct(src))) <= F.lit(FV.MAX_SOURCES))
    checks.append(whole_text_is_object(t))
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    return ok


def record_values(parsed, valid) -> list[Column]:
    """Parsed scope values and sorted distinct sources, null unless ``valid``."""
    p, ok = _col(parsed), _col(valid)
    return [*[F.when(ok, p[k]).alias(k) for k in SCOPES],
            F.when(ok, F.array_sort(F.array_distinct(p["sources"]))).alias("sources")]


def stub_struct() -> Column:
    """The failure record: every scope -1, sources [-1]."""
    m1 = F.lit(FV.FAILED_VALUE).cast("bigint")
    return F.struct(m1.alias("scope_1"), m1.alias("scope_2"), m1.alias("scope_3"),
                    F.array(m1).alias("sources"))


def empty_struct() -> Column:
    """The record of a document without relevant pages: all null, no sources."""
    n = F.lit(None).cast("bigint")
    return F.struct(n.alias("scope_1"), n.alias("scope_2"), n.alias("scope_3"),
                    F.array().cast("array<bigint>").alias("sources"))


def is_stub(s1="scope_1", s2="scope_2", s3="scope_3", sources="sources") -> Column:
    m1 = F.lit(FV.FAILED_VALUE)
    src = _col(sources)
    return F.coalesce((_col(s1) == m1) & (_col(s2) == m1) & (_col(s3) == m1)
                      & (F.size(src) == 1) & (F.element_at(src, 1) == m1), F.lit(False))


# ---- reproducible "random" values: a hash of (id, field, seed), never rand() --------------

def _hash_unit(key: Column) -> Column:
    """u in [0, 1) from the first 32 bits of md5(key)."""
    return F.conv(F.md5(key).substr(1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _hash_int(key: Column, modulus: int) -> Column:
    return F.pmod(F.conv(F.md5(key).substr(9, 8), 16, 10).cast("bigint"), F.lit(modulus))


def random_value(row_id, field: str, seed: int = 0) -> Column:
    """int(u * 10**e), u uniform in [0, 1), e uniform in 0..6, derived from a hash."""
    key = F.concat_ws(":", _col(row_id).cast("string"), F.lit(field), F.lit(str(seed)))
    e = _hash_int(key, FV.REJECTED_MAX_EXPONENT + 1)
    return F.floor(_hash_unit(key) * F.pow(F.lit(10.0), e)).cast("bigint")


def random_record(row_id, seed: int = 0) -> Column:
    """A wrong record: three random values and one random page in 0..300."""
    key = F.concat_ws(":", _col(row_id).cast("string"), F.lit("sources"), F.lit(str(seed)))
    page = _hash_int(key, FV.REJECTED_MAX_PAGE + 1)
    return F.struct(*[random_value(row_id, k, seed).alias(k) for k in SCOPES],
                    F.array(page.cast("bigint")).alias("sources"))
