"""HTTP headers, media types and archive records as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammar of a Content-Type value, version labels of the archive
# format, and the standard reason phrases of HTTP status codes.
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_MEDIA_TYPE = (
    rf"^\s*{_TOKEN}/{_TOKEN}"
    rf"(?:\s*+;\s*+{_TOKEN}=(?:{_TOKEN}|\"[^\"]*\"))*+\s*;?\s*$"  # possessive: walked in a loop
)
_PROTOCOLS = {
    "HTTP/0.9": "http/0.9",
    "HTTP/1.0": "http/1.0",
    "HTTP/1.1": "http/1.1",
    "HTTP/2.0": "h2",
    "HTTP/3.0": "h3",
}
_REASONS = {
    100: "Continue",
    101: "Switching Protocols",
    102: "Processing",
    200: "OK",
    201: "Created",
    202: "Accepted",
    203: "Non Authoritative Information",
    204: "No Content",
    205: "Reset Content",
    206: "Partial Content",
    207: "Multi-Status",
    208: "Already Reported",
    226: "IM Used",
    300: "Multiple Choices",
    301: "Moved Permanently",
    302: "Found",
    303: "See Other",
    304: "Not Modified",
    305: "Use Proxy",
    307: "Temporary Redirect",
    308: "Permanent Redirect",
    400: "Bad Request",
    401: "Unauthorized",
    402: "Payment Required",
    403: "Forbidden",
    404: "Not Found",
    405: "Method Not Allowed",
    406: "Not Acceptable",
    407: "Proxy Authentication Required",
    408: "Request Timeout",
    409: "Conflict",
    410: "Gone",
    411: "Length Required",
    412: "Precondition Failed",
    413: "Payload Too Large",
    414: "URI Too Long",
    415: "Unsupported Media Type",
    416: "Range Not Satisfiable",
    417: "Expectation Failed",
    418: "I'm a teapot",
    421: "Misdirected Request",
    422: "Unprocessable Entity",
    423: "Locked",
    424: "Failed Dependency",
    426: "Upgrade Required",
    428: "Precondition Required",
    429: "Too Many Requests",
    431: "Request Header Fields Too Large",
    451: "Unavailable For Legal Reasons",
    500: "Internal Server Error",
    501: "Not Implemented",
    502: "Bad Gateway",
    503: "Service Unavailable",
    504: "Gateway Timeout",
    505: "HTTP Version Not Supported",
    506: "Variant Also Negotiates",
    507: "Insufficient Storage",
    508: "Loop Detected",
    510: "Not Extended",
    511: "Network Authentication Required",
}
_UNKNOWN_REASON = "<unknown status code>"
_CRLF = "\r\n"
_CDX_TIME = "yyyyMMddHHmmss"
_RFC3339_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _lookup(key: Column, table: dict) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(entries, key)


def header(headers: Column, name: str) -> Column:
    """First value of a header, by case-insensitive name; null if absent."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]


def mime(headers: Column) -> Column:
    """Media type without parameters; null if the header is absent or malformed."""
    value = header(headers, "content-type")
    return F.when(value.rlike(_MEDIA_TYPE), F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1)))))


def mime_in(media_type: Column, ranges: Column) -> Column:
    """Whether any range of an array column covers the type; true for a null type."""
    any_hit = F.exists(
        ranges,
        lambda r: (r == "*/*")
        | (F.lower(r) == media_type)
        | (
            r.endswith("/*")
            & (F.split_part(F.lower(r), F.lit("/"), F.lit(1)) == F.split_part(media_type, F.lit("/"), F.lit(1)))
        ),
    )
    return F.coalesce(F.when(media_type.isNotNull(), any_hit), F.lit(True))


def mime_matches(media_type: Column, ranges: Iterable[str]) -> Column:
    """:func:`mime_in` for ranges known when the plan is built."""
    hit = F.lit(False)
    for item in ranges:
        main, _, sub = item.lower().partition("/")
        if (main, sub) == ("*", "*"):
            hit = F.lit(True)
        elif sub == "*":
            hit = hit | media_type.startswith(main + "/")
        else:
            hit = hit | (media_type == f"{main}/{sub}")
    return F.when(media_type.isNull(), F.lit(True)).otherwise(hit)


def protocol_label(version: Column) -> Column:
    return _lookup(version, _PROTOCOLS)


def cdx_time(at: Column) -> Column:
    return F.date_format(at, _CDX_TIME)


def rfc3339_time(at: Column) -> Column:
    return F.date_format(at, _RFC3339_TIME)


def digest(data: Column) -> Column:
    """``sha256:`` and the lower-case hex digest."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def status_line(version: Column, status: Column) -> Column:
    reason = F.coalesce(_lookup(status.cast("int"), _REASONS), F.lit(_UNKNOWN_REASON))
    return F.concat_ws(" ", version, status.cast("string"), reason)


def http_head(version: Column, status: Column, headers: Column) -> Column:
    """Status line, headers and the blank line, as text."""
    lines = F.transform(headers, lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"], F.lit(_CRLF)))
    return F.concat(
        status_line(version, status), F.lit(_CRLF), F.array_join(lines, ""), F.lit(_CRLF)
    )


def http_block(version: Column, status: Column, headers: Column, body: Column) -> Column:
    """The response as it goes into an archive record, as bytes."""
    return F.concat(F.encode(http_head(version, status, headers), "UTF-8"), body)


def ip_of(remote_addr: Column) -> Column:
    """Address without its port; null for null."""
    return F.regexp_extract(remote_addr, r"^\[?([0-9A-Fa-f.:]*?)\]?(?::[0-9]+)?$", 1)


def warc_head(
    url: Column,
    fetched_at: Column,
    capture_id: Column,
    remote_addr: Column,
    version: Column,
    block_digest: Column,
    block_length: Column,
) -> Column:
    """Header of a response record with its blank line, as text."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    # concat_ws leaves out nulls, so a capture without an address has no such line.
    lines = F.concat_ws(
        _CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Target-URI", url),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("WARC-Type", F.lit("response")),
        line("WARC-Date", rfc3339_time(fetched_at)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), capture_id, F.lit(">"))),
        line("WARC-IP-Address", ip_of(remote_addr)),
        line("WARC-Protocol", protocol_label(version)),
        line("WARC-Block-Digest", block_digest),
        line("Content-Length", block_length.cast("string")),
    )
    return F.concat(lines, F.lit(_CRLF + _CRLF))


def warc_record(head: Column, block: Column) -> Column:
    """Record bytes before compression; two line ends close a record."""
    return F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit(_CRLF + _CRLF), "UTF-8"))
