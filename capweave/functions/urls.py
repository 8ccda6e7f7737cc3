"""URL functions as native column expressions.

Every function here stays inside the JVM.  URLs are handled in two steps: raw
text is first brought to canonical form by :func:`normalize_url` (or
:func:`resolve_url`), and everything else, such as :func:`surt` and
:func:`host_of`, reads the canonical form with simple patterns.  Tables hold
canonical URLs, so the costly first step runs once per link.

Known limits: host names outside ASCII are lower-cased but not punycoded, and
IPv4 addresses in other than dotted-quad spelling count as unparsable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capweave.functions.common import bind, characters

# URL grammar (RFC 3986 appendix B narrowed to http and https)
# and the percent-encode sets of the WHATWG URL standard.
_OUTER_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"
_INNER_BREAKS = r"[\t\n\r]"
_SPLIT_URL = (
    r"(?is)^(https?):[/\\]*"  # 1 scheme
    r"(?:([^/\\?#]*)@)?"  # 2 user information
    r"(\[[0-9a-f:.]+\]|[^/\\?#:@\[\]]+)"  # 3 host
    r"(?::([0-9]*))?"  # 4 port
    r"([/\\][^?#]*)?"  # 5 path
    r"(\?[^#]*)?"  # 6 query with its mark
    r"(#.*)?$"  # 7 fragment with its mark
)
_CANONICAL = (
    r"^https?://[a-z_-][a-z0-9_-]*(?:\.[a-z_-][a-z0-9_-]*)*"
    r"/(?!(?:[^?#]*/)?(?:\.|%2[eE]){1,2}(?:[/?#]|$))"
    r"[A-Za-z0-9/._~!$&'()*+,;=:@%|^\[\]-]*"
    r"(?:\?[A-Za-z0-9/._~!$&()*+,;=:@%|^?`{}\[\]-]*)?"
    r"(?:#[A-Za-z0-9/._~!$&'()*+,;=:@%|^?#{}\[\]-]*)?$"
)
_BAD_HOST = r"[\x00-\x20\"%<>\\^`{|}\x7f]"
_NUMERIC_HOST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
_DOTTED_QUAD = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
_PATH_UNSAFE = r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"
_QUERY_UNSAFE = r"[^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e]"
_FRAGMENT_UNSAFE = r"[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e]"
_SURT_PARTS = (
    r"(?s)^https?://(?:[^/?#]*@)?"
    r"(?:www\d*\.(?=[^/:?#]))?"  # dropped from the key
    r"(\[[^\]]*\]|[^/:?#]*)"  # 1 host
    r"(:\d+)?"  # 2 port with its colon
    r"([^?#]*)"  # 3 path
    r"(?:\?([^#]*))?"  # 4 query
    r"(?:#.*)?$"
)
_HOST = r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]*)"
_DEFAULT_PORT = {"http": 80, "https": 443}


def _clean(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, _OUTER_BLANKS, ""), _INNER_BREAKS, "")


def _percent_encode(text: Column, unsafe: str) -> Column:
    """Percent-encode the characters that match ``unsafe``, leave the rest."""
    encoded = F.array_join(
        F.transform(
            characters(text),
            lambda c: F.when(
                c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
            ).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    dot = lambda s: F.lower(s).isin(".", "%2e")
    dots = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    folded = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.lit("").cast("string"),
        lambda acc, s: F.when(dots(s), F.regexp_replace(acc, "/[^/]*$", ""))
        .when(dot(s), acc)
        .otherwise(F.concat(acc, F.lit("/"), s)),
    )
    # A dot segment at the end names a directory and keeps its slash.
    tail = F.when(dot(last) | dots(last), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(_DOT_SEGMENT), F.concat(folded, tail)).otherwise(path)


def _assemble(parts: Column) -> Column:
    part = parts.getItem
    scheme, user, host = F.lower(part(0)), part(1), F.lower(part(2))
    host_ok = F.when(host.startswith("["), F.lit(True)).otherwise(
        ~host.rlike(_BAD_HOST) & (~host.rlike(_NUMERIC_HOST) | host.rlike(_DOTTED_QUAD))
    )
    port = F.regexp_replace(part(3), "^0+(?=[0-9])", "")
    port_ok = (F.length(port) <= 5) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
    default = F.lit(False)
    for name, number in _DEFAULT_PORT.items():
        default = default | ((scheme == name) & (port == str(number)))
    path = F.when(part(4) == "", F.lit("/")).otherwise(F.replace(part(4), F.lit("\\"), F.lit("/")))
    return F.when(
        host_ok & port_ok,
        F.concat(
            scheme,
            F.lit("://"),
            F.when(user == "", F.lit("")).otherwise(F.concat(user, F.lit("@"))),
            host,
            F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
            _percent_encode(_fold_dots(path), _PATH_UNSAFE),
            _percent_encode(part(5), _QUERY_UNSAFE),
            _percent_encode(part(6), _FRAGMENT_UNSAFE),
        ),
    )


def normalize_url(raw: Column) -> Column:
    """Canonical form of an absolute http or https URL, null for anything else.

    Most links of a crawl are canonical already and leave through the first
    branch after one pattern test.
    """
    # Breaks are gone after cleaning, so they can part the pieces of one match.
    pieces = F.split(
        F.regexp_replace(_clean(raw), _SPLIT_URL, "$1\n$2\n$3\n$4\n$5\n$6\n$7"), "\n", -1
    )
    return F.when(raw.rlike(_CANONICAL), raw).otherwise(
        bind(pieces, lambda p: F.when(F.size(p) == 7, _assemble(p)))
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve a reference against a canonical base, null if that is no http URL."""

    def place(r: Column) -> Column:
        scheme = F.regexp_extract(base, "^https?", 0)
        return (
            F.when(r.rlike(r"(?i)^https?:"), r)
            .when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(r.rlike(r"^[/\\]{2}"), F.concat(scheme, F.lit(":"), r))
            .when(r.rlike(r"^[/\\]"), F.concat(F.regexp_extract(base, "^https?://[^/?#]*", 0), r))
            .when(r.startswith("?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), r))
            .when((r == "") | r.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), r))
            .otherwise(F.concat(F.regexp_extract(base, "^[^?#]*/", 0), r))
        )

    def drop_own_scheme(r: Column) -> Column:
        # "http:page" and "http:/page" under an http base are relative references.
        own = F.concat(F.regexp_extract(base, "^https?", 0), F.lit(":"))
        return F.when(
            r.rlike(r"(?i)^https?:(?![/\\]{2})") & F.lower(r).startswith(own),
            F.regexp_replace(r, "^[^:]*:", ""),
        ).otherwise(r)

    absolute = bind(drop_own_scheme(_clean(ref)), place)
    return F.when(ref.rlike(_CANONICAL), ref).otherwise(bind(absolute, normalize_url))


def host_of(url: Column) -> Column:
    """Host of a canonical URL, without port."""
    return F.regexp_extract(url, _HOST, 1)


def hop_cost(source: Column, target: Column) -> Column:
    """1 when following the link leaves the host, else 0."""
    return (host_of(source) != host_of(target)).cast("int")


def _form_decode(text: Column) -> Column:
    # Stray percent signs stand for themselves.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _query_key(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            F.lower(_form_decode(F.regexp_extract(p, "(?s)^[^=]*", 0))).alias("name"),
            i.alias("at"),
            F.lower(_form_decode(F.regexp_replace(p, "(?s)^[^=]*=?", ""))).alias("value"),
        ),
    )
    # Structs order by name, then by place in the query.
    text = F.array_join(
        F.transform(
            F.array_sort(pairs),
            lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])),
        ),
        "&",
    )
    return bind(text, lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("?"), t)))


def surt(url: Column) -> Column:
    """Sort key of a canonical URL, null for null."""
    pieces = F.split(F.regexp_replace(url, _SURT_PARTS, "$1\n$2\n$3\n$4"), "\n", -1)
    return bind(
        pieces,
        lambda p: F.concat(
            F.array_join(F.reverse(F.split(p.getItem(0), r"\.")), ","),
            p.getItem(1),
            F.lit(")"),
            p.getItem(2),
            F.when(p.getItem(3) == "", F.lit("")).otherwise(_query_key(p.getItem(3))),
        ),
    )
