"""SQL twins of the registered queries, for DuckDB over the test tables.

Each twin is one SELECT.  The derived site and its links are common table
expressions that a twin names in ``WITH``; only the needed ones are included.
The patterns are written anew in the dialect of DuckDB's regular expressions,
which has no look-ahead.
"""

from __future__ import annotations

from capweave.plans import catalogue as C
from capweave.sources import sample_site as S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CRLF = "chr(13) || chr(10)"


def host(url: str) -> str:
    return rf"regexp_extract({url}, '^https?://(?:[^/?#]*@)?([^/:?#]*)', 1)"


def form_encode(text: str) -> str:
    return f"replace(replace(replace(url_encode({text}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def form_decode(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


def surt(url: str) -> str:
    name = rf"regexp_replace({host(url)}, '^www[0-9]*\.(.)', '\1')"
    port = rf"regexp_extract({url}, '^https?://(?:[^/?#]*@)?[^/:?#]*(:[0-9]+)', 1)"
    path = rf"regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1)"
    query = rf"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"
    pairs = (
        f"list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''), lambda p, i: "
        f"{{'k': lower({form_decode('regexp_extract(p, $$^[^=]*$$)')}), 'i': i, "
        f"'v': lower({form_decode('regexp_replace(p, $$^[^=]*=?$$, $$$$)')})}})"
    )
    text = (
        f"array_to_string(list_transform(list_sort({pairs}), "
        f"lambda s: {form_encode('s.k')} || '=' || {form_encode('s.v')}), '&')"
    )
    return (
        f"(array_to_string(list_reverse(string_split({name}, '.')), ',') || {port} || ')' || {path} || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {text} END)"
    )


def uuid(text: str) -> str:
    m = f"md5({text})"
    return f"({m}[1:8] || '-' || {m}[9:12] || '-' || {m}[13:16] || '-' || {m}[17:20] || '-' || {m}[21:32])"


def numbered(template: str) -> str:
    return f"replace({q(template)}, '§', page_id::VARCHAR)"


VERSIONS = "['HTTP/0.9', 'HTTP/1.0', 'HTTP/1.1', 'HTTP/2.0', 'HTTP/3.0']"
HTML = "'text/html; charset=utf-8'"

CTES: dict[str, str] = {}
CTES["n"] = "SELECT count(*) AS n FROM pages"
CTES["edge"] = f"""
SELECT DISTINCT src_page, dst_page FROM (
  SELECT page_id AS src_page, (3 * page_id + 1) % n.n AS dst_page FROM pages, n
  UNION ALL SELECT page_id, (5 * page_id + 2) % n.n FROM pages, n
  UNION ALL SELECT page_id, lead(page_id) OVER (
    PARTITION BY {host('lower(url)')}, page_id // 4096 ORDER BY page_id) FROM pages
) WHERE dst_page IS NOT NULL"""
CTES["site0"] = f"""
SELECT page_id, url, {HTML} AS content_type,
  replace(html, '</head>', {numbered(S.HEAD)} || '</head>') || {numbered(S.FOOT)} || coalesce(anchors, '') AS text
FROM pages LEFT JOIN (
  SELECT src_page, string_agg('<a href="' || p.url || '">next</a>', '' ORDER BY dst_page) AS anchors
  FROM edge JOIN pages p ON p.page_id = dst_page GROUP BY src_page
) ON src_page = page_id
UNION ALL
SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') || '/style/' || page_id || '.css', 'text/css',
  {numbered(S.STYLESHEET)} FROM pages"""
CTES["site"] = f"SELECT *, {surt('url')} AS surt FROM site0"
CTES["captures"] = f"""
SELECT {uuid("'capture-' || event_id")} AS capture_id, s.surt, s.url, (event_id % 4)::INTEGER AS hops,
  ts AS fetched_at, CASE event_type WHEN 'error' THEN 500 ELSE 200 END::INTEGER AS status,
  {VERSIONS}[event_id % 5 + 1] AS http_version,
  CASE WHEN event_type <> 'error' THEN s.content_type END AS content_type,
  CASE WHEN event_type <> 'error' THEN split_part(s.content_type, ';', 1) END AS mime,
  CASE WHEN user_id % 10 <> 0 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS ip,
  CASE event_type WHEN 'error' THEN '' ELSE s.text END AS body
FROM events, n, site s
WHERE s.page_id = event_id % n.n
  AND s.content_type = CASE event_type WHEN 'purchase' THEN 'text/css' ELSE {HTML} END"""
CTES["latest"] = """
SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY surt ORDER BY fetched_at DESC, capture_id DESC) = 1"""
# One capture per document or stylesheet; equal keys are settled by the id.
CTES["docs"] = f"""
SELECT * FROM (SELECT *, {uuid("'site-' || content_type || '-' || page_id")} AS capture_id FROM site)
QUALIFY row_number() OVER (PARTITION BY surt ORDER BY capture_id DESC) = 1"""

_ATTRS = r"""[\s/][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
_SCRIPT, _STYLE = rf"<script(?:{_ATTRS}|>)", rf"<style(?:{_ATTRS}|>)"
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|{_SCRIPT}.*?(?:</script\s*>|\z)|{_STYLE}.*?(?:</style\s*>|\z)|<(?:a|link|img){_ATTRS}"
)
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
CSS_URL = r"""url\(['"]?([^'"\)]*)['"]?\)"""


def _found(source: str) -> str:
    """Links of documents in order: (source columns, kind, pos, raw)."""
    return f"""
SELECT * EXCLUDE (links), unnest(links).kind AS kind, unnest(links).raw AS raw,
  generate_subscripts(links, 1)::INTEGER - 1 AS pos
FROM (SELECT * EXCLUDE (text), flatten(list_transform(regexp_extract_all(text, {q(TOKEN)}), lambda t:
  CASE WHEN starts_with(t, '<!--') THEN []
  WHEN lower(t[1:6]) = '<style' THEN
    list_transform(list_filter(regexp_extract_all(regexp_replace(t, {q('(?is)^' + _STYLE)}, ''), {q(CSS_URL)}, 1),
      lambda u: NOT starts_with(u, 'data:')), lambda u: {{'kind': 'style', 'raw': u}})
  ELSE list_transform(list_filter(list_transform(
      list_filter(
        regexp_extract_all(
          CASE WHEN lower(t[1:7]) = '<script' THEN regexp_extract(t, {q('(?is)^' + _SCRIPT)}) ELSE t END,
          {q(ATTRIBUTE)}),
        lambda a: regexp_matches(a, CASE WHEN lower(t[1:2]) = '<a' OR lower(t[1:5]) = '<link'
                                    THEN '(?i)^href\\s*=' ELSE '(?i)^src\\s*=' END))[1:1],
      lambda a: replace(regexp_replace(a, {q("^[^=]*=[" + chr(92) + "s\"']*|[\"']$")}, '', 'g'), '&amp;', '&')),
    lambda v: v <> ''), lambda v: {{'kind': lower(regexp_extract(t, '^<([a-zA-Z]+)', 1)), 'raw': v}})
  END)) AS links FROM {source})"""


CTES["html_found"] = _found(f"(SELECT surt, url, capture_id, text FROM docs WHERE content_type = {HTML})")


def _css(source: str) -> str:
    return f"""
SELECT * EXCLUDE (links), 'css' AS kind, unnest(links) AS raw, generate_subscripts(links, 1)::INTEGER - 1 AS pos
FROM (SELECT * EXCLUDE (text), list_filter(regexp_extract_all(text, {q(CSS_URL)}, 1),
  lambda u: NOT starts_with(u, 'data:')) AS links FROM {source})"""


CTES["css_found"] = _css("(SELECT surt, url, capture_id, text FROM docs WHERE content_type = 'text/css')")
CTES["found"] = "SELECT * FROM html_found UNION ALL BY NAME SELECT * FROM css_found"


def resolved_ctes(source: str, prefix: str = "") -> dict[str, str]:
    """Resolve ``source`` (surt, url, raw, ...) in stages; ends in ``<prefix>resolved``."""
    fold = (
        "list_reduce(string_split(path, '/')[2:], lambda acc, s: CASE WHEN s = '..' "
        "THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')"
    )
    tail = "CASE WHEN regexp_matches(path, '/[.]{1,2}$') THEN '/' ELSE '' END"
    encode = (
        "array_to_string(list_transform(regexp_extract_all(path, '.'), lambda c: "
        "CASE WHEN regexp_matches(c, '^[\\x21-\\x7e]$') THEN c ELSE url_encode(c) END), '')"
    )
    return {
        f"{prefix}r1": rf"""
SELECT * EXCLUDE (surt, url), surt AS src_surt, url AS src_url, CASE
  WHEN regexp_matches(raw, '(?i)^https?:') THEN raw
  WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN starts_with(raw, '//') THEN regexp_extract(url, '^https?:') || raw
  WHEN starts_with(raw, '/') THEN regexp_extract(url, '^https?://[^/?#]*') || raw
  WHEN starts_with(raw, '?') THEN regexp_extract(url, '^[^?#]*') || raw
  WHEN raw = '' OR starts_with(raw, '#') THEN regexp_extract(url, '^[^#]*') || raw
  ELSE regexp_extract(url, '^[^?#]*/') || raw END AS target FROM {source}""",
        f"{prefix}r2": rf"""
SELECT *, regexp_extract(target, '^https?://[^/?#]*') AS origin,
  regexp_extract(target, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(target, '[?#].*$') AS rest FROM {prefix}r1 WHERE target IS NOT NULL""",
        f"{prefix}r3": f"SELECT * REPLACE ({fold} || {tail} AS path) FROM {prefix}r2",
        f"{prefix}r4": f"""
SELECT * EXCLUDE (target, origin, path, rest), origin || {encode} || rest AS url FROM {prefix}r3""",
        f"{prefix}resolved": f"""
SELECT *, {surt('url')} AS surt, {host('src_url')} <> {host('url')} AS cross_host FROM {prefix}r4""",
    }


CTES |= resolved_ctes("found")

_NEEDS = {
    "edge": ["n"],
    "site0": ["edge"],
    "site": ["site0"],
    "captures": ["n", "site"],
    "latest": ["captures"],
    "docs": ["site"],
    "html_found": ["docs"],
    "css_found": ["docs"],
    "found": ["html_found", "css_found"],
    "r1": ["found"],
    "r2": ["r1"],
    "r3": ["r2"],
    "r4": ["r3"],
    "resolved": ["r4"],
}


def define(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = sql
    _NEEDS[name] = needs


def with_(*names: str, recursive: bool = False) -> str:
    wanted: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in wanted:
        sql = CTES[name]
        parts.append(f"{name} {sql[1:]}" if sql.startswith("!") else f"{name} AS MATERIALIZED ({sql})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


ORACLES: dict[str, str] = {}
CDX_TIME = "strftime(fetched_at, '%Y%m%d%H%M%S')"
RFC_TIME = "strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%fZ')"

define(
    "seed",
    [],
    f"SELECT DISTINCT {surt('url')} AS surt, url FROM pages WHERE contains(url, {q(C.SEED_MARK)})",
)

# Store

ORACLES["capture_scan"] = with_("captures") + f"""
SELECT capture_id, surt, url, url AS discovered_in, hops, status, http_version, ip || ':443' AS remote_addr,
  {RFC_TIME} AS fetched_at, coalesce('Content-Type=' || content_type || ';', '') || 'Server=sample' AS headers
FROM captures"""
ORACLES["latest_capture"] = with_("latest") + """
SELECT surt, capture_id, url, status, sha256(body) AS body_digest FROM latest"""
ORACLES["stream_latest"] = ORACLES["latest_capture"]
ORACLES["body_dedup"] = with_("captures") + """
SELECT sha256(body) AS body_digest, count(*) AS captures, count(DISTINCT surt) AS keys, min(surt) AS first_surt
FROM captures GROUP BY 1 HAVING count(*) > 1"""
ORACLES["body_lookup"] = with_("captures") + """
SELECT c.capture_id, bytes AS body_bytes FROM captures c LEFT JOIN (
  SELECT sha256(body) AS d, max(strlen(body))::BIGINT AS bytes FROM captures WHERE status = 200 GROUP BY 1
) ON d = sha256(c.body)"""
define("request", [], r"""
SELECT page_id AS request_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^http://', 'https://www7.')
  WHEN 1 THEN url || '#part'
  ELSE regexp_extract(url, '^https?://[^/]*') || '/style/' || page_id || '.css' END AS url FROM pages""")
ORACLES["url_lookup"] = with_("request", "latest") + f"""
SELECT request_id, {surt('r.url')} AS surt, capture_id, status
FROM request r LEFT JOIN latest l ON l.surt = {surt('r.url')}"""
ORACLES["no_clobber_append"] = with_("captures") + """
SELECT surt, capture_id, status FROM (
  SELECT * FROM captures WHERE hops >= 2
  QUALIFY row_number() OVER (PARTITION BY surt ORDER BY fetched_at DESC, capture_id DESC) = 1)
WHERE surt NOT IN (SELECT surt FROM captures WHERE hops < 2)"""
ORACLES["stored_captures"] = with_("captures") + """
SELECT surt, capture_id, status, strlen(body)::BIGINT AS body_bytes FROM captures
QUALIFY row_number() OVER (PARTITION BY surt ORDER BY hops > 0, fetched_at DESC, capture_id DESC) = 1"""
ORACLES["store_snapshots"] = with_("captures", "seed") + """,
v1 AS (SELECT * FROM captures WHERE hops <= 1
  QUALIFY row_number() OVER (PARTITION BY surt ORDER BY fetched_at DESC, capture_id DESC) = 1),
kept AS (SELECT * FROM v1 WHERE surt NOT IN (SELECT surt FROM seed)),
v2 AS (SELECT surt, capture_id, status FROM kept UNION ALL
  SELECT surt, capture_id, status FROM (SELECT * FROM captures
    QUALIFY row_number() OVER (PARTITION BY surt ORDER BY fetched_at DESC, capture_id DESC) = 1)
  WHERE surt NOT IN (SELECT surt FROM kept))
SELECT 1 AS version, surt, capture_id, status FROM v1
UNION ALL SELECT 2, * FROM v2
UNION ALL SELECT 3, * FROM v2 WHERE surt NOT IN (SELECT surt FROM captures WHERE status <> 200)"""
ORACLES["store_crawl_info"] = with_("seed") + f"""
SELECT DISTINCT surt AS entry_point, {C.MAX_HOPS}::INTEGER AS max_hops, 2 AS version FROM seed"""
ORACLES["seed_invalidate"] = with_("captures", "seed") + """
SELECT capture_id, surt FROM captures WHERE surt NOT IN (SELECT surt FROM seed)"""
ORACLES["entry_points"] = with_("seed") + f"""
SELECT DISTINCT surt AS entry_point, {C.MAX_HOPS}::INTEGER AS max_hops FROM seed"""
ORACLES["capture_versions"] = with_("captures") + """
SELECT surt, capture_id, row_number() OVER (PARTITION BY surt ORDER BY fetched_at, capture_id) AS version
FROM captures"""
ORACLES["unseen_frontier"] = with_("resolved") + f"""
SELECT surt, best.u AS url, best.d AS discovered_in, best.h AS hops FROM (
  SELECT surt, min({{'h': cross_host::INTEGER, 'd': src_url, 'u': url}}) AS best
  FROM resolved WHERE cross_host::INTEGER <= {C.MAX_HOPS} AND surt NOT IN (SELECT surt FROM docs) GROUP BY surt)"""

# URL, header and record functions

define("variant", [], r"""
SELECT page_id, url, 0 AS v FROM pages
UNION ALL SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?D=' || page_id || '&CC=Ab+c&EE&a=%C3%9C&cc='
  || page_id || '#x', 1 FROM pages
UNION ALL SELECT page_id, regexp_replace(url, '^https?://([^/]*)', 'https://www3.\1:8443'), 2 FROM pages""")
ORACLES["surt_key"] = with_("variant") + f"SELECT page_id, url, {surt('url')} AS surt FROM variant"
define("seed_raw", [], r"""
SELECT CASE page_id % 4 WHEN 0 THEN url ELSE regexp_replace(url, '^https?://', 'http://') END AS url
FROM pages WHERE page_id % 4 IN (0, 2)""")
ORACLES["seeds"] = with_("seed_raw") + f"""
SELECT {surt('url')} AS surt, url, url AS discovered_in, 0::INTEGER AS hops FROM seed_raw"""
ORACLES["resolve_links"] = with_("resolved") + "SELECT src_url, kind, pos, raw, url, surt FROM resolved"
ORACLES["hop_count"] = with_("resolved") + """
SELECT src_surt, kind, pos, url, cross_host, cross_host::INTEGER AS hops FROM resolved"""
ORACLES["max_hops_filter"] = with_("resolved") + """
SELECT src_surt, kind, pos, url, 0::INTEGER AS hops FROM resolved WHERE NOT cross_host"""
ORACLES["mime_of"] = with_("captures") + "SELECT capture_id, mime FROM captures"
ORACLES["mime_range_match"] = with_("captures") + """
SELECT capture_id, mime IS NULL OR CASE hops WHEN 0 THEN mime = 'text/html' WHEN 1 THEN mime LIKE 'text/%'
  WHEN 2 THEN false ELSE true END AS by_column,
  mime IS NULL OR mime = 'text/css' AS by_config, mime IS NULL AS by_empty FROM captures"""
define("block", ["captures"], f"""
SELECT *, http_version || ' ' || CASE status WHEN 200 THEN '200 OK' ELSE '500 Internal Server Error' END || {CRLF}
  || coalesce('content-type: ' || content_type || {CRLF}, '') || 'server: sample' || {CRLF} || {CRLF} AS head
FROM captures""")
define("block_sum", ["block"], "SELECT *, 'sha256:' || sha256(head || body) AS digest FROM block")
PROTOCOL = """CASE http_version WHEN 'HTTP/0.9' THEN 'http/0.9' WHEN 'HTTP/1.0' THEN 'http/1.0'
  WHEN 'HTTP/1.1' THEN 'http/1.1' WHEN 'HTTP/2.0' THEN 'h2' ELSE 'h3' END"""
define("rec", ["block_sum"], f"""
SELECT *, 'WARC/1.1' || {CRLF} || 'WARC-Target-URI: ' || url || {CRLF}
  || 'Content-Type: application/http;msgtype=response' || {CRLF} || 'WARC-Type: response' || {CRLF}
  || 'WARC-Date: ' || {RFC_TIME} || {CRLF} || 'WARC-Record-ID: <urn:uuid:' || capture_id || '>' || {CRLF}
  || coalesce('WARC-IP-Address: ' || ip || {CRLF}, '') || 'WARC-Protocol: ' || {PROTOCOL} || {CRLF}
  || 'WARC-Block-Digest: ' || digest || {CRLF} || 'Content-Length: ' || strlen(head || body) || {CRLF} || {CRLF}
  || head || body || {CRLF} || {CRLF} AS record FROM block_sum""")
ORACLES["block_digest"] = with_("block_sum") + "SELECT capture_id, digest FROM block_sum"
ORACLES["capture_times"] = with_("captures") + f"""
SELECT capture_id, {CDX_TIME} AS cdx_time, {RFC_TIME} AS rfc3339_time FROM captures"""
ORACLES["warc_protocol"] = with_("captures") + f"""
SELECT capture_id, http_version, {PROTOCOL} AS protocol, ip FROM captures"""
ORACLES["http_block"] = with_("block") + """
SELECT capture_id, head, strlen(head || body)::BIGINT AS block_length FROM block"""
ORACLES["warc_records"] = with_("rec") + """
SELECT capture_id, sha256(record) AS record_sha, strlen(record)::BIGINT AS length FROM rec"""

# Filters

ORACLES["rule_filter"] = with_("captures") + r"""
SELECT capture_id, url FROM captures
WHERE regexp_matches(url, '/\d+$') AND (mime IS NULL OR mime = 'text/html')"""
RULE_ROWS = r"""
SELECT capture_id, surt, url, body, 'links' AS rule FROM captures WHERE mime IS NULL OR mime = 'text/css'
UNION ALL SELECT capture_id, surt, url, body, 'page_rule' FROM captures
  WHERE regexp_matches(url, '/\d+$') AND (mime IS NULL OR mime = 'text/html')
UNION ALL SELECT capture_id, surt, url, body, 'scrape_html' FROM captures WHERE mime IS NULL OR mime = 'text/html'"""
define("routed", ["captures"], RULE_ROWS)
ORACLES["rule_dispatch"] = with_("routed") + "SELECT capture_id, rule FROM routed"
ORACLES["body_limit"] = with_("captures") + f"""
SELECT capture_id, CASE WHEN strlen(body) > {C.BODY_LIMIT} THEN 'BodyTooLarge' END AS error FROM captures"""
ORACLES["error_counts"] = with_("captures") + f"""
SELECT 'BodyTooLarge' AS error, {host('url')} AS host, count(*) AS failures FROM captures
WHERE strlen(body) > {C.BODY_LIMIT} GROUP BY ALL"""

# Link extraction

ORACLES["html_links"] = with_("html_found") + "SELECT url, kind, pos, raw FROM html_found WHERE kind <> 'style'"
ORACLES["style_links"] = with_("html_found") + "SELECT url, pos, raw FROM html_found WHERE kind = 'style'"
ORACLES["css_links"] = with_("css_found") + "SELECT url, pos, raw FROM css_found"

_UNITS = (
    r"array_to_string(list_transform(regexp_extract_all(v, '\\u[0-9a-fA-F]{4}|[^\\]+'), lambda p: "
    r"CASE WHEN starts_with(p, '\u') THEN chr(('0x' || p[3:6])::INTEGER) ELSE p END), '')"
)


def _patterns(source: str) -> str:
    return rf"""
SELECT DISTINCT * EXCLUDE (v), '/parts/' || v || '.' || suffix AS raw, 'part' AS kind FROM (
  SELECT * EXCLUDE (m), unnest(regexp_extract_all(regexp_extract(m, '<([^<>]*)>', 1), '[^|]+')) AS v,
    regexp_extract(m, '(css|js);$', 1) AS suffix
  FROM (SELECT * EXCLUDE (text), unnest(regexp_extract_all(text, '@parts<[^<>]*>as (?:css|js);')) AS m
        FROM {source}))
UNION ALL BY NAME
SELECT DISTINCT * EXCLUDE (v), '//img.example.com' || {_UNITS} AS raw, 'picture' AS kind, NULL AS suffix FROM (
  SELECT * EXCLUDE (text), unnest(regexp_extract_all(text, '@pic\(([^()]*)\)', 1)) AS v FROM {source})"""


define("pattern_found", ["docs"], _patterns("(SELECT surt, url, text FROM docs)"))
for _name, _sql in resolved_ctes("pattern_found", "p_").items():
    CTES[_name] = _sql
_NEEDS |= {"p_r1": ["pattern_found"], "p_r2": ["p_r1"], "p_r3": ["p_r2"], "p_r4": ["p_r3"], "p_resolved": ["p_r4"]}
ORACLES["pattern_links"] = with_("p_resolved") + "SELECT src_url, kind, url FROM p_resolved"
ORACLES["template_links"] = with_("docs") + r"""
SELECT url AS src_url, pos::INTEGER AS pos,
  regexp_extract(url, '^https?://[^/?#]*') || '/leaf/' || page || CASE pos WHEN 0 THEN ''
    WHEN 1 THEN '/at-' || edition || '/text.json' ELSE '/at-' || edition || '/notes.json' END AS url
FROM (SELECT url, regexp_extract(url, '/(\d+)', 1) AS page, regexp_extract(text, '@edition\(([^()]+)\)', 1) AS edition
      FROM docs), range(3) t(pos) WHERE page <> '' AND edition <> ''"""
ORACLES["subresource_join"] = with_("resolved", "latest") + """
SELECT r.src_url, r.kind, r.url, l.capture_id AS target_id, l.status AS target_status,
  strlen(l.body)::BIGINT AS target_bytes
FROM resolved r LEFT JOIN latest l ON l.surt = r.surt WHERE r.kind IN ('link', 'script')"""
define("all_html", ["routed"], _found("(SELECT surt, rule, capture_id, body AS text FROM routed WHERE rule = 'scrape_html')"))
define("all_css", ["routed"], _css("(SELECT surt, rule, capture_id, body AS text FROM routed WHERE rule = 'links')"))
define(
    "all_patterns",
    ["routed"],
    _patterns("(SELECT surt, rule, capture_id, body AS text FROM routed WHERE rule = 'page_rule')"),
)
ORACLES["all_links"] = with_("all_html", "all_css", "all_patterns") + """
SELECT surt, rule, kind, raw, count(*) AS links FROM (
  SELECT surt, rule, kind, raw FROM all_html UNION ALL SELECT surt, rule, kind, raw FROM all_css
  UNION ALL SELECT surt, rule, kind, raw FROM all_patterns) GROUP BY ALL"""
ORACLES["custom_extractor"] = with_("docs") + r"""
SELECT url AS src_url, 'imports' AS rule, 0::INTEGER AS pos,
  regexp_extract(url, '^https?://[^/?#]*') || '/css/base.css?hops=0' AS url FROM docs WHERE content_type = 'text/css'"""

# Counts and audits

ORACLES["capture_counts"] = with_("captures") + f"""
SELECT {host('url')} AS host, status, coalesce(mime, '') AS mime, count(*) AS captures FROM captures GROUP BY ALL"""
ORACLES["rate_audit"] = f"""
SELECT strftime(date_trunc('{C.RATE[0]}', ts), '%Y-%m-%d %H:%M:%S') AS period_start, count(*) AS captures,
  count(*) > {C.RATE[1]} AS over_quota, count(*) > {2 * C.RATE[1]} AS over_burst FROM events GROUP BY 1"""
ORACLES["stream_rate"] = ORACLES["rate_audit"]

# Crawl.  Distances are hops * 2^32 + links followed.

HOP = 4294967296
define("crawl_edge", ["resolved"], f"""
SELECT src_surt, src_url, surt, min(cross_host::BIGINT * {HOP} + 1) AS step FROM resolved GROUP BY ALL""")


def _reach(name: str, edges: str) -> str:
    return f"""!(surt, dist) USING KEY (surt) AS (
  SELECT DISTINCT surt, 0::BIGINT FROM seed
  UNION
  SELECT e.surt, min(r.dist + e.step) FROM {name} r JOIN {edges} e ON e.src_surt = r.surt
    LEFT JOIN recurring.{name} k ON k.surt = e.surt
  WHERE r.dist + e.step < {(C.MAX_HOPS + 1) * HOP} AND (k.dist IS NULL OR r.dist + e.step < k.dist)
  GROUP BY e.surt)"""


define("reached", ["crawl_edge", "seed"], _reach("reached", "crawl_edge"))
ORACLES["crawl_reach"] = with_("reached", recursive=True) + f"""
SELECT surt, (dist // {HOP})::INTEGER AS hops FROM reached"""
define("tree", ["reached"], f"""
SELECT surt, coalesce(best.s, surt) AS parent_surt, coalesce(best.u, url) AS discovered_in,
  (dist // {HOP})::INTEGER AS hops, (dist % {HOP})::INTEGER AS steps
FROM reached LEFT JOIN (
  SELECT e.surt AS target, min({{'u': e.src_url, 's': e.src_surt}}) AS best
  FROM crawl_edge e JOIN reached a ON a.surt = e.src_surt JOIN reached b ON b.surt = e.surt
  WHERE a.dist + e.step = b.dist GROUP BY e.surt
) ON target = surt
LEFT JOIN (SELECT surt AS seed_surt, min(url) AS url FROM seed GROUP BY 1) ON seed_surt = surt""")
ORACLES["discovery_tree"] = with_("tree", recursive=True) + """
SELECT surt, parent_surt, discovered_in, hops, steps FROM tree"""
ORACLES["archive_replay"] = with_("tree", recursive=True) + """
SELECT surt, hops, discovered_in, capture_id FROM tree JOIN docs USING (surt)"""
define("open_edge", ["crawl_edge", "seed"], """
SELECT * FROM crawl_edge WHERE src_surt IN (SELECT surt FROM seed)
  OR src_surt NOT IN (SELECT surt FROM docs WHERE starts_with(url, 'https:'))""")
define("reached_open", ["open_edge", "seed"], _reach("reached_open", "open_edge"))
ORACLES["crawl_resume"] = with_("reached_open", recursive=True) + f"""
SELECT surt, (dist // {HOP})::INTEGER AS hops FROM reached_open"""
ORACLES["host_edges"] = with_("resolved") + f"""
SELECT {host('src_url')} AS src_host, {host('url')} AS dst_host, count(*) AS links FROM resolved GROUP BY ALL"""

# Export.  Lengths are those of records before compression.

ORACLES["export_order"] = with_("captures") + """
SELECT capture_id, row_number() OVER (ORDER BY surt, fetched_at, capture_id) - 1 AS rank FROM captures"""
define("sized", ["rec"], "SELECT * EXCLUDE (record), strlen(record)::BIGINT AS length FROM rec")
define("started", ["sized"], """
SELECT *, (sum(length) OVER (ORDER BY surt, fetched_at, capture_id) - length)::BIGINT AS start,
  row_number() OVER (ORDER BY surt, fetched_at, capture_id) - 1 AS rank FROM sized""")
define("placed", ["started"], f"""
SELECT *, start // {C.FILE_THRESHOLD} AS file_no, format('{{:05d}}.warc.gz', start // {C.FILE_THRESHOLD}) AS filename,
  start - min(start) OVER (PARTITION BY start // {C.FILE_THRESHOLD}) AS "offset" FROM started""")
ORACLES["warc_rotation"] = with_("placed") + "SELECT capture_id, file_no, filename FROM placed"
ORACLES["warc_offsets"] = with_("placed") + 'SELECT capture_id, "offset", length FROM placed'
ORACLES["warc_file_sizes"] = with_("placed") + """
SELECT filename, sum(length)::BIGINT AS bytes, count(*) AS records FROM placed GROUP BY 1"""
define("line", ["placed"], f"""
SELECT *, surt || ' ' || {CDX_TIME} || ' ' || to_json({{'url': url, 'digest': digest, 'mime': mime,
  'filename': filename, 'offset': "offset", 'length': length, 'status': status}})::VARCHAR AS line FROM placed""")
ORACLES["cdxj_lines"] = with_("line") + "SELECT line FROM line"
ORACLES["cdx_blocks"] = with_("started") + "SELECT capture_id, rank, rank // 1000 AS block FROM started"
ORACLES["zipnum_index"] = with_("line") + f"""
SELECT rank // 1000 AS block, arg_min(surt, rank) AS first_surt, arg_min({CDX_TIME}, rank) AS first_time,
  count(*) AS lines, sum(strlen(line) + 1)::BIGINT AS bytes FROM line GROUP BY 1"""
ORACLES["zipnum_blocks"] = with_("line") + """
SELECT rank // 1000 AS block, arg_min(surt, rank) AS first_surt, count(*) AS lines,
  sha256(string_agg(line || chr(10), '' ORDER BY rank)) AS text_sha, true AS in_place FROM line GROUP BY 1"""
ORACLES["warc_packed"] = with_("rec", "latest") + """
SELECT capture_id, digest, sha256(record) AS record_sha FROM rec WHERE capture_id IN (SELECT capture_id FROM latest)"""
ORACLES["package_check"] = with_("latest", "seed") + """
SELECT kind, items::BIGINT AS items, true AS sound FROM (
  SELECT 'archive' AS kind, count(*) AS items FROM latest UNION ALL
  SELECT 'lines', count(*) FROM latest UNION ALL
  SELECT 'blocks', ceil(count(*) / 1000.0) FROM latest UNION ALL
  SELECT 'pages', count(*) + 1 FROM latest WHERE surt IN (SELECT surt FROM seed) UNION ALL
  SELECT 'extraPages', count(*) + 1 FROM latest WHERE surt NOT IN (SELECT surt FROM seed))"""
for _main in (True, False):
    _head = "{" + ",".join(
        f'"{k}":"{v}"'
        for k, v in zip(
            ("format", "id", "title"),
            (C.A.PAGE_FORMAT, *(C.A.MAIN_PAGES if _main else C.A.EXTRA_PAGES)),
        )
    ) + "}"
    ORACLES["pages_main" if _main else "pages_extra"] = with_("captures", "seed") + f"""
SELECT {q(_head)} AS line UNION ALL
SELECT to_json({{'id': capture_id, 'url': url, 'ts': {RFC_TIME}}})::VARCHAR FROM captures
WHERE surt {'IN' if _main else 'NOT IN'} (SELECT surt FROM seed)"""

# Streaming forms give what their batch forms give.

ORACLES["stream_links"] = with_("resolved") + f"""
SELECT src_surt, kind, pos, url, surt, cross_host::INTEGER AS hops FROM resolved
WHERE cross_host::INTEGER <= {C.MAX_HOPS}"""
ORACLES["stream_first_seen"] = with_("captures") + "SELECT DISTINCT surt FROM captures"
ORACLES["stream_unseen"] = ORACLES["stream_first_seen"]
