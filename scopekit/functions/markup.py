"""Markup that holds more than plain tags: comments, CDATA sections, processing instructions and quoted ``>``.

A markup text is cut into tokens by one linear pattern and each token is rewritten by its kind; ``functions.text`` takes this way
only for rows with such constructs (``needs_tokens``), as simple expressions are exact on all others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT, CDATA, INSTRUCTION = r"<!--[\s\S]*?-->", r"<!\[CDATA\[[\s\S]*?\]\]>", r"<\?[\s\S]*?\?>"
ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
TAG = rf"</?[A-Za-z]{ATTRIBUTES}>"
TOKEN = rf"{COMMENT}|{CDATA}|{INSTRUCTION}|<![A-Za-z]{ATTRIBUTES}>|{TAG}|[^<]++|<"
# An img element (empty, without end tag, or with content up to its end tag) and its tail, which is text and CDATA
# up to the next tag or comment; images inside comments and CDATA sections are none, so those are matched first.
IMAGE = rf"<img(?![A-Za-z0-9_.:-]){ATTRIBUTES}(?<!/)>(?:(?!</?img(?![A-Za-z0-9_.:-]))[\s\S])*+</img\s*>"
EMPTY_IMAGE = rf"<img(?![A-Za-z0-9_.:-]){ATTRIBUTES}>"
TAIL = rf"(?:[^<]++|{CDATA})*+"
IMAGE_WITH_TAIL = rf"({COMMENT}|{CDATA}|{INSTRUCTION})|(?:{IMAGE}|{EMPTY_IMAGE}){TAIL}"
ROOT_ID = r"""(\s)id\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
ATTRIBUTE = r"""\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?"""


def needs_tokens(markup: Column) -> Column:
    """Cheap searches first: plain text and markup without attributes never reach the pattern."""
    quoted = markup.contains("=") & markup.rlike(r"""=\s*(?:"[^"<]*>|'[^'<]*>)""")
    aside = markup.contains("<!--") | markup.contains("<![CDATA[") | markup.contains("<?") | markup.contains("</img")
    return markup.contains("<") & (aside | quoted)


def _tokens(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))


def _is_cdata(token: Column) -> Column:
    return token.startswith("<![CDATA[")


def _cdata_text(token: Column) -> Column:
    return token.substr(F.lit(10), F.length(token) - F.lit(12))


def _is_text(token: Column) -> Column:
    return ~token.startswith("<") | (token == "<")


def token_text(markup: Column, decoded) -> Column:
    """Concatenated text: tags, comments and instructions give nothing, CDATA its content as it stands, text is ``decoded``."""
    def piece(token: Column) -> Column:
        return F.when(_is_cdata(token), _cdata_text(token)).when(_is_text(token), decoded(token)).otherwise(F.lit(""))
    return F.array_join(F.transform(_tokens(markup), piece), "")


def _escaped(text: Column) -> Column:
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(ch), F.lit(name))
    return text


def without_images(markup: Column) -> Column:
    return F.regexp_replace(markup, IMAGE_WITH_TAIL, "$1")


def token_markup(markup: Column, page_no: Column, rewritten) -> Column:
    """The markup without images and their tails, ``rewritten`` token by token (CDATA as escaped text, comments and instructions
    as they stand), with the page number as the root element's id, after its other attributes."""
    def piece(token: Column) -> Column:
        aside = token.startswith("<!") | token.startswith("<?")
        return F.when(_is_cdata(token), _escaped(_cdata_text(token))).when(aside, token).otherwise(rewritten(token))

    def with_id(tokens: Column) -> Column:
        # tokens before the root hold no open tag; an empty markup or one without tags stays as it is
        opens = F.transform(tokens, lambda t: t.rlike(r"^<[A-Za-z]"))
        at = F.array_position(opens, True).cast("int")
        root = F.get(tokens, at - 1)
        attributes = F.filter(F.regexp_extract_all(root, F.lit(ATTRIBUTE), F.lit(0)), lambda a: ~a.rlike(r"^\s+id\s*="))
        name = F.regexp_extract(root, r"^(<[A-Za-z][^\s/>]*)", 1)
        end = F.when(root.rlike(r"/>$"), F.lit("/>")).otherwise(F.lit(">"))
        new = F.concat(name, F.array_join(attributes, ""), F.lit(' id="'), page_no.cast("string"), F.lit('"'), end)
        parts = F.concat(F.slice(tokens, 1, at - 1), F.array(new), F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0))))
        return F.array_join(F.transform(F.when(at > 0, parts).otherwise(tokens), piece), "")
    return F.get(F.transform(F.array(_tokens(without_images(markup))), with_id), 0)
