"""Page text: relevance test, markup to text, markup cleaning, page wrapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions import markup as MK


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_for_relevance(text, folds=FV.RELEVANCE_FOLDS) -> Column:
    """Lower-case, drop U+0020 only, then apply the folding pairs in order."""
    out = F.replace(F.lower(_col(text)), F.lit(" "), F.lit(""))
    for src, dst in folds:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def is_relevant(text, terms=FV.RELEVANCE_TERMS, folds=FV.RELEVANCE_FOLDS) -> Column:
    """True when the folded text contains any term (substring match); null text is not relevant."""
    folded = fold_for_relevance(text, folds)
    hit = reduce(lambda a, b: a | b, [folded.contains(F.lit(t)) for t in terms])
    return F.coalesce(hit, F.lit(False))


# Entities decoded after the tag strip; '&amp;' must come last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
             ("&nbsp;", "\u00a0"), ("&amp;", "&"))
# A character reference by number: decimal or hexadecimal.
REFERENCE_PATTERN = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
TAG_PATTERN = r"<[^>]+>"
IMG_WITH_TAIL_PATTERN = r"<img\b[^>]*>[^<]*"
# Everything up to and including the root element's tag name (declarations skipped).
ROOT_HEAD_PATTERN = r"^(\s*(?:<[!?][^>]*>\s*)*<[A-Za-z][^\s/>]*)"
ROOT_ID_ATTR_PATTERN = r"""\s+id\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


# Characters that stay references when markup is written again.
_KEPT_REFERENCES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
# Elements without content are written without a slash, other empty ones with an end tag.
VOID_SLASH_PATTERN = r"<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)(\s+[^<>\s][^<>]*?)?\s*/>"
EMPTY_ELEMENT_PATTERN = r"<([A-Za-z][^\s<>/]*)(\s+[^<>\s][^<>]*?)?\s*/>"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _decode_references(text: Column, keep=()) -> Column:
    """Numeric character references as characters (those of ``keep`` by name); ones without a character
    stay as written."""
    def char(ref: Column) -> Column:
        body = F.regexp_extract(ref, r"^&#([xX]?[0-9A-Fa-f]+);$", 1)
        hexa = F.when(F.lower(body).startswith("x"), F.substring(body, F.lit(2), F.length(body))).otherwise(F.conv(body, 10, 16))
        point = F.conv(hexa, 16, 10).cast("bigint")
        known = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        out = decoded = F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")
        for ch, name in keep:
            out = F.when(decoded == ch, F.lit(name)).otherwise(out)
        return F.when(known, out).otherwise(ref)

    def decoded_text(t: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE_PATTERN), 0), lambda ref: _once(ref, char))
        pieces = F.zip_with(F.concat(F.array(F.lit("")), chars), F.split(t, REFERENCE_PATTERN), lambda c, s: F.concat(c, s))
        return F.when(t.contains("&#"), F.array_join(pieces, "")).otherwise(t)
    return _once(text, decoded_text)


def markup_to_text(markup) -> Column:
    """Concatenated text nodes: strip tags, comments and instructions, keep CDATA as it stands, decode numeric references
    and the common entities elsewhere."""
    def decoded(text: Column) -> Column:
        out = _decode_references(text)
        for ent, ch in _ENTITIES:
            out = F.replace(out, F.lit(ent), F.lit(ch))
        return out
    m = _col(markup)
    return F.when(MK.needs_tokens(m), MK.token_text(m, decoded)).otherwise(decoded(F.regexp_replace(m, TAG_PATTERN, "")))


def _plain_quotes(markup: Column) -> Column:
    """Quote references outside of tags as characters; inside, where they may delimit a value, they stay."""
    def plain(m: Column) -> Column:
        tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(m, F.lit(TAG_PATTERN), 0))
        pieces = F.zip_with(tags, F.split(m, TAG_PATTERN), lambda tag, s: F.concat(
            tag, F.replace(F.replace(s, F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'"))))
        return F.when(m.contains("&quot;") | m.contains("&apos;"), F.array_join(pieces, "")).otherwise(m)
    return _once(markup, plain)


def rewritten_markup(markup) -> Column:
    """Markup as a serialiser writes it after parsing: references decoded where the character may stand as
    it is, empty elements in HTML's form."""
    out = F.replace(_decode_references(_col(markup), _KEPT_REFERENCES), F.lit("&nbsp;"), F.lit("\u00a0"))
    out = F.regexp_replace(F.regexp_replace(out, VOID_SLASH_PATTERN, "<$1$2>"), EMPTY_ELEMENT_PATTERN, "<$1$2></$1>")
    return _plain_quotes(out)


def clean_markup(markup, page_no) -> Column:
    """Drop every ``img`` element together with its tail text, write the rest again and set the root id to
    the page number."""
    def with_id(whole: Column) -> Column:
        head = F.regexp_extract(whole, ROOT_HEAD_PATTERN, 1)
        rest = whole.substr(F.length(head) + 1, F.greatest(F.length(whole), F.lit(1)))
        attrs = F.regexp_extract(rest, r"^([^>]*?)/?>", 1)
        after = rest.substr(F.length(attrs) + 1, F.greatest(F.length(rest), F.lit(1)))
        kept = F.regexp_replace(attrs, ROOT_ID_ATTR_PATTERN, "")
        out = F.concat(head, kept, F.lit(' id="'), _col(page_no).cast("string"), F.lit('"'), after)
        return F.when(F.length(head) > 0, out).otherwise(whole)
    def plain(m: Column) -> Column:
        return _once(rewritten_markup(F.regexp_replace(m, IMG_WITH_TAIL_PATTERN, "")), with_id)
    m = _col(markup)
    return F.when(MK.needs_tokens(m), MK.token_markup(m, _col(page_no), rewritten_markup)).otherwise(plain(m))


def wrap_chunk(page_no, text) -> Column:
    """Plain-text page as appended to the prompt."""
    return F.concat(F.lit('<CHUNK id="'), _col(page_no).cast("string"), F.lit('">\n'),
                    F.coalesce(_col(text), F.lit("")), F.lit("\n</CHUNK>\n"))
