"""Links inside HTML and CSS text as native column expressions.

HTML is cut into tokens by one pattern: comments, script and style elements
with their content, and the opening tags that can carry a link.  Each token
then yields zero or more links, so a page is scanned once for all link kinds
and links in comments or script text are not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from capweave.functions.common import bind, code_point

# The CSS url() pattern and the elements that carry links.
CSS_URL = r"""url\((?!['"]?(?:data):)['"]?([^'"\)]*)['"]?\)"""
LINK_ATTRIBUTES = {"a": "href", "link": "href", "img": "src", "script": "src"}

# Quoted values may hold ">".  The repeat is possessive: the engine then walks it in
# a loop, so a tag may have any number of attributes.
_ATTRS = r"""[\s/][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_OPEN_SCRIPT = rf"script(?:{_ATTRS}|[\s/][^>]*>|>)"
_OPEN_STYLE = rf"style(?:{_ATTRS}|[\s/][^>]*>|>)"
# Every branch starts behind the same "<", which the engine finds quickly.
TOKEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    rf"|{_OPEN_SCRIPT}.*?(?:</script\s*>|\z)"
    rf"|{_OPEN_STYLE}.*?(?:</style\s*>|\z)"
    rf"|(?:a|link|img)(?:{_ATTRS}|[\s/][^>]*>))"
)
# The usual spelling of a tag: plain attributes in double quotes, no reference
# in the value.  Anything else goes through ATTRIBUTE.
_UP_TO = r"""(?:(?!{0}[\s=])[a-z-]++(?:="[^"]*+")?+\s++)*+{0}"""
_PLAIN_TAG = (
    rf"(?i)^<(?:(?:a|link)\s++{_UP_TO.format('href')}|(?:img|script)\s++{_UP_TO.format('src')})"
    r"""="([^"&]++)\""""
)
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
# Names that may stand without a semicolon; in an attribute not before a letter, a digit or "=".
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_ENTITY = (
    r"(?s)&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+;|&(?:"
    + "|".join(_BARE_NAMES)
    + r")(?![A-Za-z0-9=])|&|[^&]++"
)
# Numbers that stand for the characters of an older code page.
_OLD_CODES = {n: ord(bytes([n]).decode("cp1252")) for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_ESCAPED_UNITS = r"(?s)(?:\\u[0-9a-fA-F]{4})+|\\.|[^\\]+|\\"

LINK_TYPE = "array<struct<kind:string,raw:string>>"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def unescape_html(text: Column) -> Column:
    """Replace character references once."""

    # Strings that the optimizer folds into array literals.
    names = F.split(F.lit("\n".join(sorted(html5))), "\n")
    values = F.split(F.lit("\n".join(html5[n].replace("\n", "\r") for n in sorted(html5))), "\n")
    old = F.create_map(*[F.lit(x) for pair in _OLD_CODES.items() for x in pair])

    def numbered(digits: Column, base: int) -> Column:
        # Leading zeros say nothing; whatever is longer than the last code point is none.
        plain = F.regexp_replace(digits, "^0+", "")
        number = F.when(F.length(plain) > 8, F.lit(-1)).otherwise(F.coalesce(F.conv(plain, base, 10).try_cast("int"), F.lit(0)))
        return bind(number, lambda n: code_point(F.coalesce(F.try_element_at(old, n), n)))

    def decode(piece: Column) -> Column:
        named = F.array_position(names, F.substr(piece, F.lit(2), F.length(piece))).cast("int")
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.rlike("^&#[0-9]"), numbered(F.regexp_extract(piece, "[0-9]+", 0), 10))
            .when(piece.rlike("^&#[xX]"), numbered(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
            .otherwise(bind(named, lambda at: F.when(at > 0, F.replace(F.element_at(values, at), F.lit("\r"), F.lit("\n"))).otherwise(piece)))
        )

    decoded = F.array_join(F.transform(find_all(text, _ENTITY), decode), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def unescape_script(text: Column) -> Column:
    r"""Replace ``\uXXXX`` units and drop the backslash of other escapes."""

    def decode(piece: Column) -> Column:
        units = F.unhex(F.replace(piece, F.lit("\\u"), F.lit("")))
        return (
            F.when(piece.rlike(r"^\\u[0-9a-fA-F]{4}"), F.decode(units, "UTF-16BE"))
            .when(piece.startswith("\\") & (F.length(piece) == 2), F.substring(piece, 2, 1))
            .otherwise(piece)
        )

    decoded = F.array_join(F.transform(find_all(text, _ESCAPED_UNITS), decode), "")
    return F.when(F.contains(text, F.lit("\\")), decoded).otherwise(text)


def attribute(tag: Column, wanted: Callable[[Column], Column]) -> Column:
    """Value of the first ``name=value`` text in a tag that passes ``wanted``."""
    hits = F.filter(find_all(tag, ATTRIBUTE), wanted)
    value = F.regexp_replace(F.try_element_at(hits, F.lit(1)), r"(?s)^[^=]*=\s*", "")
    bare = bind(
        value,
        lambda v: F.when(v.rlike("""^["']"""), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v),
    )
    return unescape_html(bare)


def links_as(kind: str, raws: Column) -> Column:
    """Give raw links a kind."""
    return F.transform(raws, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("raw")))


def css_url_links(text: Column, kind: str = "css") -> Column:
    """Targets of url() in a stylesheet, ``data:`` targets left out."""
    return links_as(kind, find_all(text, CSS_URL, 1))


def html_links(html: Column) -> Column:
    """Links of a page in document order, of the kinds a, link, img, script, style."""
    none = F.array().cast(LINK_TYPE)

    def link(kind: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), raw.alias("raw"))

    def unusual(token: Column, kind: Column) -> Column:
        tag = F.when(kind == "script", F.regexp_extract(token, f"(?is)^<{_OPEN_SCRIPT}", 0)).otherwise(token)
        target = bind(
            _lookup_attribute(kind),
            lambda named: attribute(tag, lambda a: F.lower(F.regexp_extract(a, r"^([^=\s]+)\s*=", 1)) == named),
        )
        style = F.regexp_replace(token, f"(?is)^<{_OPEN_STYLE}|</style\\s*>$", "")
        return (
            F.when(kind == "", none)
            .when(kind == "style", css_url_links(style, "style"))
            .otherwise(F.transform(F.filter(F.array(target), lambda v: v != ""), lambda v: link(kind, v)))
        )

    def of_token(token: Column) -> Column:
        kind = F.lower(F.regexp_extract(token, "(?i)^<([a-z]*)", 1))
        return F.when(token.startswith("<script>") | token.startswith("<!--"), none).otherwise(
            bind(
                F.regexp_extract(token, _PLAIN_TAG, 1),
                # Bound, as every mention of an expression is worked out again.
                lambda plain: F.when(plain != "", F.array(link(kind, plain))).otherwise(
                    bind(kind, lambda k: unusual(token, k))
                ),
            )
        )

    return F.flatten(F.transform(find_all(html, TOKEN), of_token))


def _lookup_attribute(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for element, name in LINK_ATTRIBUTES.items():
        out = F.when(kind == element, F.lit(name)).otherwise(out)
    return out
