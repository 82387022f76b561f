"""The same results as plain SQL for DuckDB, written independently of the Spark code."""

from __future__ import annotations

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
WORDS = {
    "privacy": ["privacy", "data protection", "personal data", "gdpr", "ccpa"],
    "terms": ["terms", "conditions", "agreement", "contract"],
    "liability": ["liability", "warranty", "guarantee", "responsible", "damages"],
    "termination": ["terminate", "suspend", "close account", "cancel", "breach"],
    "rights": ["rights", "permission", "license", "intellectual property", "copyright"],
    "governance": ["governance", "compliance", "regulation", "policy", "guidelines"],
}
HEADERS = ["last-modified", "etag", "content-type", "content-length", "cache-control"]


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def assemble(scheme: str, host: str, path: str) -> str:
    bare_host = (
        f"CASE WHEN {scheme}='http' THEN regexp_replace(lower({host}),':80$','') "
        f"WHEN {scheme}='https' THEN regexp_replace(lower({host}),':443$','') ELSE lower({host}) END"
    )
    bare_path = f"CASE WHEN {path}='/' THEN '/' ELSE regexp_replace({path},'/$','') END"
    return f"({scheme} || '://' || {bare_host} || {bare_path})"


def parts(url: str) -> tuple[str, str, str, str]:
    own = f"lower(regexp_extract({url},{q(SPLIT)},1))"
    scheme = f"(CASE WHEN {own}='' THEN 'http' ELSE {own} END)"
    host = f"regexp_extract({url},{q(SPLIT)},2)"
    path = f"regexp_replace(regexp_extract({url},{q(SPLIT)},3),';[^/]*$','')"
    return own, scheme, host, path


def norm(url: str) -> str:
    _, scheme, host, path = parts(url)
    return f"CASE WHEN {url} IS NULL OR {url}='' THEN {url} ELSE {assemble(scheme, host, path)} END"


def candidates(source: str, cols: str = "url") -> str:
    """Union of candidate keys: columns of source, tier, rnk, key. Needs a column url."""
    own, scheme, host, path = parts("url")
    toggled = f"(CASE WHEN {host} LIKE 'www.%' THEN substr({host},5) ELSE 'www.' || {host} END)"
    forms = [
        f"SELECT {cols}, 1 tier, 0 rnk, url AS key FROM {source}",
        f"SELECT {cols}, 2, 0, {norm('url')} FROM {source}",
        f"SELECT {cols}, 3, 1, {assemble(q('http'), host, path)} FROM {source} WHERE {own}<>'http'",
        f"SELECT {cols}, 3, 1, {assemble(q('https'), host, path)} FROM {source} WHERE {own}<>'https'",
        f"SELECT {cols}, 3, 2, {assemble(scheme, toggled, path)} FROM {source}",
    ]
    return "\nUNION ALL ".join(forms)


# ---------------------------------------------------------------- derived inputs

CAPTURES = """c AS (SELECT 1 AS cycle_no UNION ALL SELECT 2 UNION ALL SELECT 3),
b AS (SELECT page_id, url, cycle_no, page_id % 12 AS k, html, CAST(cycle_no AS VARCHAR(3)) AS v FROM pages CROSS JOIN c),
pc AS (SELECT page_id, cycle_no, url, CASE
  WHEN k=1 AND cycle_no>=2 THEN replace(html,'<title>','<title>Updated ')
  WHEN k=2 THEN replace(html,'<head>',concat('<head><meta name="description" content="rev ',v,'">'))
  WHEN k=5 AND cycle_no>=2 THEN replace(html,'</article>',concat('<p>',repeat('privacy terms rights ',60),'</p></article>'))
  WHEN k=6 THEN replace(html,'</article>',concat('<p>Version: 2.',v,'</p></article>'))
  WHEN k=8 THEN replace(html,'</head>',concat('<script type="application/ld+json">{"@type":"SoftwareApplication","version":"',v,'","name":"m"}</script></head>'))
  WHEN k=9 AND cycle_no=2 THEN NULL
  WHEN k=10 THEN replace(html,'<head>',concat('<head><meta property="og:title" content="t',v,'"><link rel="canonical" href="/p/',v,'">'))
  WHEN k=11 AND cycle_no>=2 THEN replace(html,'</article>','<h2>New</h2><form></form></article>')
  ELSE html END AS html,
  CASE WHEN k=3 AND cycle_no>=2 THEN 404 WHEN k=9 AND cycle_no=2 THEN NULL ELSE 200 END AS status_code,
  CASE WHEN k=4 AND cycle_no>=2 THEN concat(url,'/moved') ELSE url END AS final_url,
  CASE WHEN k=9 AND cycle_no=2 THEN 'connection failed' END AS error,
  CASE WHEN k=9 AND cycle_no=2 THEN NULL WHEN k=7 THEN concat('v',v) ELSE 'v0' END AS etag,
  CASE WHEN k=9 AND cycle_no=2 THEN NULL WHEN k=7 THEN concat('v',v) ELSE 'v0' END AS last_modified
FROM b),
src AS (SELECT page_id, cycle_no, url, html, status_code, final_url, error, etag, last_modified,
  CASE WHEN error IS NULL THEN 'text/html; charset=utf-8' END AS content_type,
  TIMESTAMP '2024-01-01' + to_days(cycle_no) AS captured_at, page_id AS ordinal,
  'cycle_' || strftime(TIMESTAMP '2024-01-01' + to_days(cycle_no), '%Y%m%d_%H%M%S') AS cycle_id,
  CAST(coalesce(strlen(html),0) AS BIGINT) AS content_length FROM pc)"""

TAGGED = r"""src AS (SELECT page_id, 1 AS cycle_no, url, url AS final_url, CAST(NULL AS VARCHAR) AS error, page_id AS ordinal,
  TIMESTAMP '2024-01-02' AS captured_at, NULL AS etag, NULL AS last_modified,
  CASE WHEN page_id % 11 = 10 THEN 503 ELSE 200 END AS status_code,
  CASE WHEN page_id % 13 = 12 THEN 'application/PDF' ELSE 'Text/HTML; charset=latin1' END AS content_type,
  replace(replace(html, '<head>', '<head><META NAME=''twitter:card'' content=summary><meta content="t' || page_id
   || '" name="twitter:Title"><meta name="twitter:title" content="u' || page_id
   || ' &amp; co"><meta name="description" content=" first ' || page_id
   || ' "><meta name="description" content="second"><meta property=''OG:Title'' content=''A > B ' || page_id
   || '''><meta property="og:title" content="last ' || page_id
   || '"><meta property="og:image" content=""><meta property="og:url" content="/o/' || page_id
   || '"><meta http-equiv="Content-Type" content="text/html; charset=iso-8859-1"><meta http-equiv=refresh content="30"><meta http-equiv="Refresh" content="60"><meta name="author" content="a' || page_id
   || '"><meta name="author" content="b"><meta name="robots" content=""><meta name="Generator" content="g"><link rel="stylesheet" href="/s.css"><link rel="nofollow canonical" href=" /c/' || page_id
   || ' "><!-- <meta name="keywords" content="hidden"><script type="application/ld+json">{}</script> --><script type="application/ld+json">{"part":{"safety":"s' || page_id
   || '","version":"v' || page_id || '"},"name":"n' || page_id
   || '","@type":"SoftwareApplication","@list":[1,{"a":null}]}</script><script type="application/ld+json">{broken</script>'),
  '</article>', (SELECT string_agg('<div itemscope itemtype="https://schema.org/T' || (i % 4) || '"></div>', '' ORDER BY i) FROM range(0, page_id % 7 + 1) r(i))
   || '<img src="x"><IMG src=y><ol><li>1</li></ol><h2>two</h2><h3 class="main-head">three</h3><form action="/f"></form><a href="https://twitter.com/x' || page_id
   || '" title="T &amp; t">share <b> it </b></a><a class="k" href=''mailto:x@y''>m</a><a href="//cdn.example/x">cdn</a><a href="#x">frag</a><a href="">none</a><a name="n">no</a><a href="https://other.example/p.html"> other  page </a><p>Last updated: 3 May 2024. Version: 2.' || page_id
   || '. also v1.' || (page_id % 7) || ' and ver 3; effective as of May 1. Date: 1/2/2024 Privacy policy, &quot;terms&quot; &lt;!-- shown --&gt;</p></article>') AS html
 FROM pages)"""

CAPTURE_LOG = """lg AS (SELECT user_id AS key, ts AS captured_at, event_id AS ordinal,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 301 ELSE 200 END AS status_code,
  CAST(floor(value*100) AS BIGINT) AS content_length, props AS etag FROM events)"""

AS_OF = "TIMESTAMP '2024-01-30 23:30:00'"
CHECKS = f"""ck AS (SELECT user_id AS url_key, ts AS checked_at, event_id AS ordinal, event_type<>'error' AS success
  FROM events WHERE ts <= {AS_OF})"""

WATCHLIST = """w0 AS (SELECT page_id, url, CASE page_id%3 WHEN 0 THEN 'policy' WHEN 1 THEN 'research' ELSE 'guideline' END AS type,
  CASE page_id%5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'critical' ELSE 'urgent' END AS priority FROM pages),
wl AS (SELECT url, type, priority, page_id AS ordinal FROM w0
  UNION ALL SELECT url, type, 'low', page_id+1000000 FROM w0 WHERE page_id%20=0
  UNION ALL SELECT 'ftp' || substr(url, strpos(url,':')), type, priority, page_id+2000000 FROM w0 WHERE page_id%25=0),
sch AS (SELECT url, arg_max(type, ordinal) AS type, arg_max(priority, ordinal) AS priority, min(ordinal) AS ordinal FROM wl GROUP BY url)"""

NEXT_CHECKS = """nx AS (SELECT url_key, arg_max(checked_at, (checked_at, ordinal)) AS last_checked, arg_max(success, (checked_at, ordinal)) AS success FROM ck GROUP BY url_key),
nc AS (SELECT *, last_checked + to_seconds(CASE WHEN success THEN 3600 ELSE 1800 END) AS next_check FROM nx),
rs AS (SELECT s.*, n.last_checked, n.next_check FROM sch s LEFT JOIN nc n ON n.url_key = s.ordinal)"""

LINKED = """ld AS (SELECT c.cycle_no, source AS page_key, 'https://docs.example/' || doc_id || CASE doc_id%3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.DOCX' END AS link,
  CASE WHEN c.cycle_no=2 AND doc_id%10=2 THEN text || ' rev2' ELSE text END AS content,
  CASE doc_id%4 WHEN 0 THEN 'application/pdf; charset=binary' WHEN 1 THEN 'text/html' WHEN 3 THEN 'application/msword' END AS content_type,
  200 AS status_code, n_chars AS declared_length
  FROM documents, (SELECT 1 AS cycle_no UNION ALL SELECT 2) c
  WHERE NOT (c.cycle_no=1 AND doc_id%10=0) AND NOT (c.cycle_no=2 AND doc_id%10=1)),
fp AS (SELECT *, CASE WHEN content_type IS NULL THEN regexp_matches(lower(link),'\\.(pdf|docx?)$')
   ELSE trim(split_part(content_type,';',1)) IN ('application/pdf','application/msword') OR regexp_matches(lower(link),'\\.(pdf|docx?)$') END AS followed FROM ld),
mf AS (SELECT cycle_no, page_key, link, content_type, status_code, CASE WHEN followed THEN sha256(content) END AS hash,
  CAST(CASE WHEN followed THEN strlen(content) ELSE coalesce(declared_length,0) END AS BIGINT) AS length, NOT followed AS skipped FROM fp),
mo AS (SELECT * FROM mf WHERE cycle_no=1), mn AS (SELECT * FROM mf WHERE cycle_no=2),
mc AS (SELECT coalesce(n.page_key,o.page_key) AS page_key, coalesce(n.link,o.link) AS link, o.hash AS old_hash, n.hash AS new_hash,
  CASE WHEN o.link IS NULL THEN 'linked_document_added' WHEN n.link IS NULL THEN 'linked_document_removed' ELSE 'linked_document_changed' END AS change_type,
  CASE WHEN o.link IS NULL THEN n.status_code END AS status_code
  FROM mn n FULL OUTER JOIN mo o ON n.page_key=o.page_key AND n.link=o.link
  WHERE o.link IS NULL OR n.link IS NULL OR o.hash IS DISTINCT FROM n.hash)""".replace("\\\\", "\\")


def _state() -> str:
    swapped = "CASE WHEN url LIKE 'https://%' THEN 'http://' || substr(url,9) ELSE 'https://' || substr(url,8) END"
    toggled = "CASE WHEN regexp_matches(url,'^https?://www\\.') THEN regexp_replace(url,'://www\\.','://') ELSE regexp_replace(url,'://','://www.') END"
    return f"""s0 AS (SELECT page_id, url, page_id%6 AS form, {swapped} AS sw, {toggled} AS tg FROM pages WHERE page_id%7<>0),
s1 AS (SELECT *, CASE form WHEN 0 THEN url WHEN 1 THEN {norm('url')} WHEN 2 THEN {norm('sw')} WHEN 3 THEN {norm('tg')} ELSE ({norm('url')}) || '/k' END AS history_key FROM s0),
st AS (SELECT history_key, url, CASE WHEN form=4 THEN url ELSE history_key END AS final_url, CASE WHEN form=5 THEN url END AS canonical_url, page_id AS insertion_seq FROM s1)"""


STATE = _state()
LOOKUP = f"""cd AS ({candidates('(SELECT DISTINCT url FROM pages)')}),
h0 AS (SELECT c.url, c.tier, c.rnk, s.history_key, 0 AS seq FROM cd c JOIN st s ON s.history_key=c.key
 UNION ALL SELECT p.url, 4, 0, s.history_key, s.insertion_seq FROM (SELECT DISTINCT url FROM pages) p JOIN st s
   ON {norm('s.final_url')} = {norm('p.url')} OR {norm('s.canonical_url')} = {norm('p.url')}),
lk AS (SELECT url, tier, rnk, history_key FROM h0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY tier, rnk, seq)=1)"""

# ---------------------------------------------------------------- page profile

REST = "(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
TAGS = rf"(?s)</?[a-zA-Z]{REST}|<[!?][^>]*>"
OPAQUE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
CHROME = r"(?is)<nav\b[^>]*>.*?</nav\s*>|<footer\b[^>]*>.*?</footer\s*>|<header\b[^>]*>.*?</header\s*>"


def unescape(x: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x},'&{name};',{q(char)})"
    return x


def strip(x: str) -> str:
    return rf"regexp_replace({x},'^\s+|\s+$','','g')"


def has(pattern: str, x: str) -> str:
    return f"regexp_matches({x},{q(pattern)})"


def attr(tag: str, name: str) -> str:
    quoted = "\"[^\"]*\"|'[^']*'|[^\\s\"'>]+"
    before = rf"(?:[\s/]+[^\s=>\"'/]+(?:\s*=\s*(?:{quoted}))?)*".replace('\\"', '"')
    pattern = rf"(?is)^<[a-z]+{before}[\s/]+{name}\s*=\s*({quoted})"
    value = unescape(f"trim(regexp_extract({tag},{q(pattern)},1),{q(chr(34) + chr(39))})")
    return f"CASE WHEN {has(pattern, tag)} THEN {value} END"


def count(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x},{q(pattern)}))"


def occurrences(words: list[str]) -> str:
    return " + ".join(f"(strlen(low)-strlen(replace(low,{q(w)},'')))//{len(w)}" for w in words)


VERSIONS = [r"version\s*:?\s*([\d\.]+)", r"v\.?\s*(\d+\.\d+)", r"revision\s*:?\s*([\d\.]+)", r"ver\.?\s*(\d+)"]
DATES = [
    r"last\s+(?:updated|modified|revised)\s*:?\s*([^<\.]+)", r"updated\s+on\s*:?\s*([^<\.]+)",
    r"effective\s+as\s+of\s*:?\s*([^<\.]+)", r"revision\s+date\s*:?\s*([^<\.]+)",
    r"date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
]


def marks(patterns: list[str]) -> str:
    found = [f"regexp_extract_all(raw,{q('(?i)' + p)},1)" for p in patterns]
    return f"to_json(flatten([{', '.join(found)}]))"


def of_meta(condition: str, order: str = "ASC") -> str:
    return f"(SELECT content FROM mt m WHERE m.page_id=t.page_id AND m.cycle_no=t.cycle_no AND {condition} ORDER BY pos {order} LIMIT 1)"


HEADINGS = " || ',' || ".join(
    f"'\"h{n}\":' || {count(rf'(?i)<h{n}[\s/>]', 'red')}" for n in range(1, 7)
)

PROFILE = f"""g AS (SELECT *, error IS NULL AND status_code IS NOT NULL AS has_profile,
  CASE WHEN error IS NOT NULL OR status_code IS NULL THEN NULL WHEN status_code<>200 THEN 'HTTP ' || status_code || ' - Cannot parse HTML'
   WHEN lower(coalesce(content_type,'')) NOT LIKE '%text/html%' THEN 'Non-HTML content type: ' || lower(coalesce(content_type,'')) END AS parse_error FROM src),
g1 AS (SELECT *, has_profile AND parse_error IS NULL AS parsed, CASE WHEN has_profile AND parse_error IS NULL THEN html END AS h FROM g),
g2 AS (SELECT *, regexp_replace(h,{q(OPAQUE)},'','g') AS doc FROM g1),
g3 AS (SELECT *, regexp_replace(doc,{q(CHROME)},'','g') AS red FROM g2),
g4 AS (SELECT *, {unescape(f"regexp_replace(red,{q(TAGS)},'','g')")} AS raw FROM g3),
g5 AS (SELECT *, trim(regexp_replace(raw,'\\s+',' ','g')) AS txt, lower(raw) AS low,
  regexp_extract_all(doc,{q('(?is)<meta' + chr(92) + 'b' + REST)}) AS tags FROM g4),
m0 AS (SELECT page_id, cycle_no, unnest(tags) AS tag, generate_subscripts(tags,1)-1 AS pos FROM g5),
mt AS (SELECT page_id, cycle_no, CAST(pos AS INTEGER) AS pos, {attr('tag','name')} AS name, {attr('tag','property')} AS property,
  {attr('tag','http-equiv')} AS http_equiv, {attr('tag','charset')} AS charset, {attr('tag','content')} AS content FROM m0),
j0 AS (SELECT page_id, cycle_no, unnest(regexp_extract_all(regexp_replace(h,'(?s)<!--.*?-->','','g'),'(?is)<script\\b[^>]*type="application/ld\\+json"[^>]*>(.*?)</script\\s*>',1)) AS body FROM g5),
j1 AS (SELECT page_id, cycle_no, body, '{{' || (SELECT string_agg(to_json(e.key) || ':' || e.value, ',' ORDER BY e.key) FROM json_each(body) e) || '}}' AS canon FROM j0 WHERE json_valid(body)),
i0 AS (SELECT page_id, cycle_no, regexp_extract_all(doc,'(?is)<[a-z][^>]*\\sitemtype="([^"]*)"[^>]*>',1) AS types FROM g5),
i1 AS (SELECT page_id, cycle_no, len(types) AS item_count, (SELECT string_agg(DISTINCT to_json(x), ',' ORDER BY to_json(x)) FROM unnest(types[1:5]) u(x) WHERE x<>'') AS sample FROM i0 WHERE len(types)>0),
t AS (SELECT g5.*, '{{"json_ld":[' || coalesce((SELECT string_agg(canon, ',') FROM j1 WHERE j1.page_id=g5.page_id AND j1.cycle_no=g5.cycle_no),'') || '],"microdata":'
   || coalesce((SELECT '{{"item_count":' || item_count || ',"sample_types":[' || sample || ']}}' FROM i1 WHERE i1.page_id=g5.page_id AND i1.cycle_no=g5.cycle_no),'{{}}') || '}}' AS sd0 FROM g5),
p AS (SELECT page_id, cycle_no, url, final_url, captured_at, ordinal, status_code, content_type, parse_error, has_profile, parsed, etag, last_modified, error, html,
  CASE WHEN {has('(?i)<title', 'doc')} THEN {strip(unescape("regexp_extract(doc,'(?is)<title[^>]*>(.*?)</title',1)"))} END AS title,
  {strip(of_meta("name='description'"))} AS description,
  (SELECT nullif({strip(attr('l','href'))},'') FROM (SELECT unnest(regexp_extract_all(doc,'(?is)<link\\b[^>]*>')) AS l) WHERE list_contains(string_split({attr('l','rel')},' '),'canonical') LIMIT 1) AS canonical,
  CASE WHEN parsed THEN sd0 ELSE '{{}}' END AS sd,
  CAST(CASE WHEN parsed THEN len(list_filter(string_split(txt,' '), lambda x: x<>'')) ELSE 0 END AS BIGINT) AS words,
  CASE WHEN length(txt)>500 THEN substr(txt,1,500) || '...' ELSE txt END AS preview,
  CASE WHEN parsed THEN '{{' || {HEADINGS} || '}}' ELSE '{{}}' END AS headings,
  {count(r'(?i)<img[\s/>]', 'red')} AS images, {count(r'(?i)<p[\s/>]', 'red')} AS paragraphs, {count(r'(?i)<(?:ul|ol)[\s/>]', 'red')} AS lists,
  {has(r'(?i)<(?:main|article)[\s/>]', 'red')} OR {has('(?i)<[a-z][^>]*' + chr(92) + 's' + 'class="[^"]*(?:content|main)', 'red')} AS main_content,
  {', '.join(f"CAST(CASE WHEN parsed THEN {occurrences(w)} ELSE 0 END AS BIGINT) AS n_{c}" for c, w in WORDS.items())},
  CASE WHEN parsed THEN {marks(VERSIONS)} ELSE '[]' END AS versions, {marks(DATES)} AS dates,
  nullif({strip(attr("regexp_extract(doc,'(?is)<html[^>]*>')", 'lang'))},'') AS lang,
  CASE WHEN {of_meta("charset IS NOT NULL").replace('SELECT content', 'SELECT charset')} IS NOT NULL THEN {of_meta("charset IS NOT NULL").replace('SELECT content', 'SELECT charset')}
   WHEN {of_meta("lower(http_equiv) LIKE '%content-type%'")} LIKE '%charset=%' THEN regexp_extract({of_meta("lower(http_equiv) LIKE '%content-type%'")},'charset=([^;]*)',1)
   WHEN parsed THEN regexp_extract(content_type,'charset=([^;]*)',1) END AS charset,
  parsed AND {has(r'(?i)<form[\s/>]', "coalesce(red,'')")} AS has_forms,
  parsed AND coalesce((SELECT bool_or(x LIKE '%&lt;!--%' AND x LIKE '%--&gt;%') FROM unnest(regexp_split_to_array(red,'<[^>]*>')) u(x)), false) AS has_comments
 FROM t)"""


def profile(source: str, select: str) -> str:
    return f"WITH {source},\n{PROFILE}\n{select}"


# ---------------------------------------------------------------- changes

PAIRS = f"""kp AS (SELECT p.*, {norm("CASE WHEN p.final_url='' THEN p.url ELSE p.final_url END")} AS history_key, s.cycle_id, s.content_length,
  n_privacy+n_terms+n_liability+n_termination+n_rights+n_governance>0 AS legal,
  (SELECT m.content FROM mt m WHERE m.page_id=p.page_id AND m.cycle_no=p.cycle_no AND lower(m.property)='og:title' AND m.content<>'' ORDER BY pos DESC LIMIT 1) AS og_title
  FROM p JOIN src s ON s.page_id=p.page_id AND s.cycle_no=p.cycle_no),
cd AS ({candidates('kp', 'captured_at, ordinal, url')}),
bk AS (SELECT c.captured_at, c.ordinal, k.captured_at AS pat, k.ordinal AS pord FROM cd c JOIN kp k ON k.history_key=c.key AND (k.captured_at,k.ordinal)<(c.captured_at,c.ordinal)
  QUALIFY row_number() OVER (PARTITION BY c.captured_at, c.ordinal ORDER BY c.tier, c.rnk, k.captured_at DESC, k.ordinal DESC)=1),
pr AS (SELECT c AS cur, o AS prev, c.url AS url, c.captured_at AS captured_at, c.ordinal AS ordinal, c.cycle_id AS cycle_id, o.ordinal IS NOT NULL AS known
  FROM kp c LEFT JOIN bk USING (captured_at, ordinal) LEFT JOIN kp o ON o.captured_at=bk.pat AND o.ordinal=bk.pord)"""


def _changes() -> str:
    both = "cur.has_profile AND prev.has_profile"

    def row(n, kind, source, severity, alert, field, old, new, when, delta="NULL", percent="NULL"):
        sev = severity if severity.startswith("CASE") else q(severity)
        return (
            f"SELECT url, captured_at, ordinal, cycle_id, CAST({n} AS INTEGER) AS rule_ordinal, {q(kind)} AS change_type, {q(source)} AS source, {sev} AS severity, "
            f"{'true' if alert else 'false'} AS policy_alert, CAST({field} AS VARCHAR) AS field, CAST({old} AS VARCHAR) AS old_value, CAST({new} AS VARCHAR) AS new_value, "
            f"CAST({delta} AS DOUBLE) AS delta, CAST({percent} AS DOUBLE) AS change_percent FROM pr WHERE {when}"
        )

    def pair(f):
        return f"prev.{f}", f"cur.{f}", f"known AND cur.{f} IS DISTINCT FROM prev.{f}"

    def pct(f):
        return f"abs(cur.{f}-prev.{f})/greatest(prev.{f},1)*100"

    http, html = "http_metadata", "html_metadata"
    rows = [
        row(1, "first_detection", "direct_metadata", "low", False, "NULL", "NULL", q("URL detected for the first time"), "NOT known"),
        row(2, "status_change", http, "CASE WHEN cur.status_code>=400 THEN 'high' ELSE 'medium' END", False, "NULL", *pair("status_code")),
        row(3, "redirect_change", http, "medium", False, "NULL", *pair("final_url")),
        row(4, "content_size_change", http, "medium", False, "NULL", "prev.content_length", "cur.content_length",
            "known AND abs(cur.content_length-prev.content_length)>1000", "cur.content_length-prev.content_length", pct("content_length")),
        row(5, "header_change", http, "low", False, q("last-modified"), *pair("last_modified")),
        row(6, "header_change", http, "medium", False, q("etag"), *pair("etag")),
        row(7, "header_change", http, "medium", False, q("content-type"), *pair("content_type")),
    ]
    for n, kind, sev, f in ((10, "title_change", "high", "title"), (11, "meta_description_change", "medium", "description"), (12, "canonical_url_change", "medium", "canonical")):
        old, new, when = pair(f)
        rows.append(row(n, kind, html, sev, False, "NULL", old, new, f"{when} AND {both}"))
    old, new, when = pair("og_title")
    rows.append(row(13, "opengraph_change", html, "medium", False, q("title"), old, new, f"{when} AND {both}"))
    rows.append(row(17, "structured_data_change", html, "medium", False, "NULL", "sha256(prev.sd)", "sha256(cur.sd)", f"known AND cur.parsed AND {both} AND cur.sd<>prev.sd"))
    for f in ("name", "version"):
        def card(side):
            return f"(SELECT json_extract({side}.sd, '$.json_ld[0].{f}'))"
        rows.append(row(18, "model_card_change", "structured_data", "high", True, q(f), card("prev"), card("cur"),
                        f"known AND cur.parsed AND {both} AND cur.sd<>prev.sd AND {card('cur')} IS DISTINCT FROM {card('prev')}"))
    rows.append(row(20, "word_count_change", "content_analysis", "CASE WHEN abs(cur.words-prev.words)>100 THEN 'medium' ELSE 'low' END", False, "NULL",
                    "prev.words", "cur.words", f"known AND {both} AND abs(cur.words-prev.words)>50", "cur.words-prev.words", pct("words")))
    old, new, when = pair("headings")
    rows.append(row(21, "heading_structure_change", "content_analysis", "low", False, "NULL", old, new, f"{when} AND {both}"))
    for i, c in enumerate(WORDS):
        rows.append(row(23 + i, "policy_keyword_change", "policy_analysis", "medium", True, q(c), f"prev.n_{c}", f"cur.n_{c}",
                        f"known AND {both} AND abs(cur.n_{c}-prev.n_{c})>2", f"cur.n_{c}-prev.n_{c}"))
    as_set = "list_sort(list_distinct(CAST({}.versions AS VARCHAR[])))"
    rows.append(row(29, "version_indicator_change", "policy_analysis", "high", True, "NULL", "prev.versions", "cur.versions",
                    f"known AND {both} AND {as_set.format('cur')}<>{as_set.format('prev')}"))
    old, new, when = pair("legal")
    rows.append(row(30, "legal_language_change", "policy_analysis", "medium", True, "NULL", old, new, f"{when} AND {both}"))
    return "\nUNION ALL ".join(rows)


CHANGES = f"ch AS ({_changes()})"
LONG = "url, captured_at, ordinal, cycle_id, rule_ordinal, change_type, source, severity, policy_alert, field, old_value, new_value, delta, change_percent"


def changes(select: str, *extra: str) -> str:
    return "WITH " + ",\n".join([CAPTURES, PROFILE, PAIRS, CHANGES, *extra]) + "\n" + select


def pairs(select: str) -> str:
    return "WITH " + ",\n".join([CAPTURES, PROFILE, PAIRS]) + "\n" + select


ARROW = """CASE change_type WHEN 'status_change' THEN 'Status: ' WHEN 'redirect_change' THEN 'Redirect: ' WHEN 'structured_data_change' THEN 'Structured data change: ' END
 || coalesce(old_value,'None') || '→' || coalesce(new_value,'None')"""
DETECTED = f"""dt AS (SELECT url, captured_at, ordinal, cycle_id, string_agg(change_type, ', ' ORDER BY rule_ordinal, field) AS types,
  coalesce(string_agg({ARROW}, '; ' ORDER BY rule_ordinal, field), 'No changes detected') AS texts, count(*) AS n, count(*) FILTER (WHERE policy_alert) AS alerts FROM ch GROUP BY ALL)"""
LOG = """lr AS (SELECT d.cycle_id, d.captured_at, d.ordinal, strftime(d.captured_at,'%Y-%m-%dT%H:%M:%S') AS timestamp, d.url, d.types AS change_type, d.texts AS change_details,
  CAST(k.status_code AS BIGINT) AS status_code, coalesce(k.content_type,'') AS content_type, k.final_url, 'direct_metadata' AS source, s.priority, 'FALSE' AS resolved, '' AS notes
  FROM dt d JOIN kp k USING (captured_at, ordinal) JOIN sch s ON s.url=d.url)"""
STATS = """cs AS (SELECT k.cycle_id, min(k.captured_at) AS start_time, max(k.captured_at) AS end_time, count(*) AS urls_checked, count(d.n) AS changes_detected,
  count(*) FILTER (WHERE k.error IS NOT NULL) AS errors, count(*) FILTER (WHERE k.has_profile AND NOT k.parsed) AS html_parsing_errors,
  CAST(coalesce(sum(d.alerts),0) AS BIGINT) AS policy_alerts_detected, k.cycle_id=(SELECT min(cycle_id) FROM src) AS first_run,
  CAST(0 AS DOUBLE) AS duration_seconds FROM kp k LEFT JOIN dt d USING (captured_at, ordinal) GROUP BY k.cycle_id)"""

# ---------------------------------------------------------------- queries

ORACLES: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _tagged(select: str, where: str = "has_profile") -> str:
    return profile(TAGGED, f"{select} FROM p WHERE {where}")


def _content(select: str) -> str:
    return _tagged(select, "parsed")


def _sources() -> None:
    o = ORACLES
    o["a1_watchlist_source"] = _with(WATCHLIST) + (
        "SELECT url, type, priority, ordinal//100 AS document, row_number() OVER (PARTITION BY ordinal//100 ORDER BY ordinal)-1 AS position, "
        "CAST(3600 AS INTEGER) AS check_interval FROM wl"
    )
    o["a2_captures_source"] = _with(CAPTURES) + (
        "SELECT page_id, cycle_no, url, captured_at, CAST(status_code AS INTEGER) AS status_code, CASE WHEN error IS NULL THEN final_url ELSE url END AS final_url, "
        "content_length, error, etag, CAST(CASE WHEN error IS NULL THEN 3 ELSE 0 END AS BIGINT) AS n_headers FROM src"
    )
    o["a3_linked_docs_source"] = _with(LINKED) + "SELECT cycle_no, page_key, link, content_type, status_code, CAST(strlen(content) AS BIGINT) AS bytes FROM ld"
    o["a4_state_read"] = _with(STATE) + "SELECT * FROM st"
    o["a5_state_write"] = pairs(
        "SELECT history_key, url, captured_at, ordinal, CAST(status_code AS INTEGER) AS status_code, final_url, content_length, etag, title, "
        "CASE WHEN parsed THEN sha256(sd) END AS structured_hash, first_captured_at FROM (SELECT *, min(captured_at) OVER (PARTITION BY history_key) AS first_captured_at FROM kp) "
        "QUALIFY row_number() OVER (PARTITION BY history_key ORDER BY captured_at DESC, ordinal DESC)=1"
    )
    log = (WATCHLIST, DETECTED, LOG)
    o["a6_cycle_report_sink"] = changes(
        "SELECT cycle_id AS report_id, url, timestamp, source AS change_source, priority, change_type AS change_types, "
        "changes_detected AS total_changes, first_run, urls_checked FROM lr JOIN cs USING (cycle_id)", *log, STATS)
    o["a7_change_log_sink"] = changes(
        'SELECT timestamp AS "Timestamp", url AS "URL", change_type AS "Change Type", change_details AS "Change Details", status_code AS "Status Code", '
        'content_type AS "Content Type", final_url AS "Final URL", source AS "Source", priority AS "Priority", resolved AS "Resolved", notes AS "Notes" FROM lr', *log)
    o["a8_cycle_summary"] = changes(
        "SELECT cycle_id, 'headline' AS part, '' AS url, printf('Cycle ID: %s | Duration: %.2fs | URLs checked: %d | Changes detected: %d | Errors: %d', "
        "cycle_id, duration_seconds, urls_checked, changes_detected, errors) AS text FROM cs "
        "UNION ALL SELECT cycle_id, 'change', url, 'Types: ' || types || ' | Source: direct_metadata | Time: ' || strftime(captured_at,'%Y-%m-%dT%H:%M:%S') FROM dt", DETECTED, STATS)
    o["b9_change_log_rows"] = changes("SELECT * FROM lr", *log)
    o["e4_append_batches"] = changes(
        "SELECT cycle_id, url, captured_at, ordinal, CAST((row_number() OVER (PARTITION BY cycle_id ORDER BY url, captured_at, ordinal)-1)//50 AS BIGINT) AS batch_no FROM lr", *log)
    o["c5_enrich_with_priority"] = changes("SELECT ch.url, captured_at, rule_ordinal, field, priority FROM ch JOIN sch ON sch.url=ch.url", WATCHLIST)
    o["d4_cycle_stats"] = changes("SELECT * FROM cs", DETECTED, STATS)
    o["d6_changes_per_url"] = changes("SELECT url, captured_at, ordinal, n AS n_changes, types AS change_types FROM dt", DETECTED)
    o["d8_append_counts"] = changes(
        "SELECT cycle_id, count(n) AS successful, count(*)-count(n) AS failed FROM kp LEFT JOIN dt USING (captured_at, ordinal, cycle_id) GROUP BY cycle_id", DETECTED)
    o["f3_change_order"] = changes(
        "SELECT url, captured_at, ordinal, CAST(row_number() OVER (PARTITION BY captured_at, ordinal ORDER BY rule_ordinal, field)-1 AS INTEGER) AS position, change_type, field FROM ch")
    o["g1_union_changes"] = changes(
        "SELECT url, rule_ordinal, change_type, source, severity, field FROM ch UNION ALL SELECT page_key, CAST(19 AS INTEGER), change_type, 'linked_documents', "
        "CASE change_type WHEN 'linked_document_changed' THEN 'high' ELSE 'medium' END, link FROM mc", LINKED)
    o["b10_policy_changes_only"] = changes(f"SELECT {LONG} FROM ch WHERE policy_alert")
    o["i_all_changes"] = changes(f"SELECT {LONG} FROM ch")
    for name, kind in {
        "i1_first_detection": "first_detection", "i2_status_change": "status_change", "i3_redirect_change": "redirect_change",
        "i4_content_size_change": "content_size_change", "i5_header_change": "header_change", "i6_title_change": "title_change",
        "i7_meta_description_change": "meta_description_change", "i8_canonical_url_change": "canonical_url_change",
        "i9_opengraph_change": "opengraph_change", "i10_structured_data_change": "structured_data_change",
        "i11_model_card_change": "model_card_change", "i13_word_count_change": "word_count_change",
        "i14_heading_structure_change": "heading_structure_change", "i16_policy_keyword_change": "policy_keyword_change",
        "i17_version_indicator_change": "version_indicator_change", "i18_legal_language_change": "legal_language_change",
    }.items():
        o[name] = changes(f"SELECT {LONG} FROM ch WHERE change_type='{kind}'")
    o["i15_version_change"] = pairs(
        "SELECT url, captured_at, ordinal, cycle_id, CAST(22 AS INTEGER) AS rule_ordinal, 'version_change' AS change_type, 'policy_analysis' AS source, 'high' AS severity, true AS policy_alert, "
        "CAST(NULL AS VARCHAR) AS field, CASE WHEN prev.parsed THEN prev.etag END AS old_value, CASE WHEN cur.parsed THEN cur.etag END AS new_value, CAST(NULL AS DOUBLE) AS delta, CAST(NULL AS DOUBLE) AS change_percent "
        "FROM pr WHERE known AND cur.has_profile AND prev.has_profile AND (CASE WHEN cur.parsed THEN cur.etag END) IS DISTINCT FROM (CASE WHEN prev.parsed THEN prev.etag END)")
    alert = ("SELECT url, captured_at, ordinal, {} AS alert_type, {} AS severity, {} AS message, cur.words-prev.words AS word_count_change, "
             "CAST(cur.versions AS VARCHAR) AS current_versions, CAST(prev.versions AS VARCHAR) AS previous_versions, {} AS last_modified_change FROM pr WHERE known AND cur.has_profile AND prev.has_profile AND {}")
    same = "list_sort(list_distinct(CAST(cur.versions AS VARCHAR[])))=list_sort(list_distinct(CAST(prev.versions AS VARCHAR[])))"
    o["i19_stealth_content_change"] = pairs(alert.format(
        "'STEALTH_CONTENT_CHANGE'", "'HIGH'", "'Significant content changes detected without version update'", "CAST(NULL AS VARCHAR)",
        f"abs(cur.words-prev.words)>100 AND {same}"))
    o["i20_stealth_last_modified_update"] = pairs(alert.format(
        "'STEALTH_LAST_MODIFIED_UPDATE'", "'MEDIUM'", "'Last-Modified header changed with minimal content changes'",
        "coalesce(prev.last_modified,'None') || ' -> ' || coalesce(cur.last_modified,'None')",
        "cur.last_modified IS DISTINCT FROM prev.last_modified AND abs(cur.words-prev.words)<50"))
    o["g2_set_difference_flag"] = pairs(f"SELECT url, captured_at, ordinal, NOT ({same}) AS differs FROM pr WHERE known")
    o["c6_as_of_previous_capture"] = pairs(
        "SELECT url, captured_at, ordinal, cycle_id, prev.captured_at AS prev_at, prev.ordinal AS prev_ordinal, prev.url AS prev_url FROM pr")
    o["j1_stream_change_feed"] = o["j3_checkpointed_resume"] = o["i_all_changes"]


def _lists() -> None:
    o = ORACLES
    rules = _with(WATCHLIST)
    o["b1_validate_watchlist"] = rules + (
        "SELECT ordinal, url, 'Duplicate URL: ' || url AS message FROM wl QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal)>1 "
        "UNION ALL SELECT ordinal, url, 'Invalid URL format: ' || url FROM wl WHERE url NOT LIKE 'http://%' AND url NOT LIKE 'https://%' "
        "UNION ALL SELECT ordinal, url, 'Invalid priority for ' || url || ': ' || priority FROM wl WHERE priority NOT IN ('low','medium','high','critical') "
        "UNION ALL SELECT NULL, NULL, 'Central check interval too short: 120s (minimum: 300s)'")
    o["b2_list_watchlist"] = rules + "SELECT url, type, priority, ordinal, count(*) OVER () AS total FROM wl"
    recheck = _with(CHECKS, WATCHLIST, NEXT_CHECKS)
    due = f"(next_check IS NULL OR {AS_OF} >= next_check)"
    o["b3_due_urls"] = recheck + f"SELECT url, type, priority, last_checked, next_check FROM rs WHERE {due}"
    o["d1_watchlist_summary"] = rules + (
        "SELECT 'priority' AS dimension, priority AS value, count(*) AS urls FROM wl GROUP BY priority UNION ALL SELECT 'type', type, count(*) FROM wl GROUP BY type "
        "UNION ALL SELECT 'total', 'all', count(*) FROM wl")
    o["d2_priority_pivot"] = rules + (
        "SELECT CAST(3600 AS BIGINT) AS central_check_interval, count(*) AS total_urls, count(*) FILTER (WHERE priority='high') AS high, "
        "count(*) FILTER (WHERE priority='medium') AS medium, count(*) FILTER (WHERE priority='low') AS low FROM wl")
    seconds = f"CAST(greatest(0, date_diff('microsecond', {AS_OF}, min(next_check))/1e6) AS DOUBLE)"
    body = f"count(*) AS total_urls, count(*) FILTER (WHERE {due}) AS due_urls, CASE WHEN min(next_check) IS NULL THEN 0 ELSE {seconds} END AS next_check_in FROM rs"
    o["d3_recheck_status"] = recheck + f"SELECT priority, {body} GROUP BY priority UNION ALL SELECT '*', {body}"
    o["e3_duplicate_occurrence"] = rules + (
        "SELECT url, type, priority, ordinal, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS occurrence FROM wl "
        "QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal)>1")
    o["e5_next_check_times"] = recheck + "SELECT url_key, last_checked, success, next_check FROM nc"
    o["f1_upcoming_checks"] = recheck + (
        f"SELECT url, priority, next_check, CAST(date_diff('microsecond', {AS_OF}, next_check)/1e6 AS DOUBLE) AS seconds_until FROM rs WHERE next_check IS NOT NULL ORDER BY next_check, url LIMIT 10")
    o["g4_watchlist_dedupe"] = rules + "SELECT url, type, priority, ordinal FROM sch"
    o["d5_first_run_flag"] = _with(CAPTURES) + "SELECT DISTINCT cycle_id, cycle_id=(SELECT min(cycle_id) FROM src) AS first_run FROM src"
    o["d7_tracked_urls"] = _with(CAPTURES) + f"SELECT DISTINCT {norm('CASE WHEN error IS NULL THEN final_url ELSE url END')} AS history_key FROM src"
    o["c1_previous_state_lookup"] = _with(STATE, LOOKUP) + "SELECT url, CAST(tier AS INTEGER) AS tier, CAST(rnk AS INTEGER) AS rank, history_key FROM lk"
    o["c2_first_detection"] = _with(STATE, LOOKUP) + "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM lk)"
    variants = candidates("pages", "page_id")
    o["h2_url_variants"] = f"SELECT DISTINCT page_id, key AS variant FROM ({variants}) WHERE tier>1"
    o["h1_normalize_url"] = (
        "WITH f AS (SELECT page_id, 0 AS form, url FROM pages UNION ALL SELECT page_id, 1, upper(url) FROM pages "
        "UNION ALL SELECT page_id, 2, regexp_replace(url,'^(https?://[^/?#]+)','\\1:443') FROM pages UNION ALL SELECT page_id, 3, url || ';v=1' FROM pages) "
        f"SELECT page_id, CAST(form AS INTEGER) AS form, {norm('url')} AS key FROM f")
    log = _with(CAPTURE_LOG)
    w = "(PARTITION BY key ORDER BY captured_at, ordinal)"
    o["e1_previous_values"] = log + (
        f"SELECT key, ordinal, status_code, lag(status_code) OVER {w} AS prev_status, lag(content_length) OVER {w} AS prev_length, lag(etag) OVER {w} AS prev_etag FROM lg")
    o["e2_latest_state"] = log + "SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY key ORDER BY captured_at DESC, ordinal DESC)=1"
    numeric = (
        f"SELECT *, lag(status_code) OVER {w} AS old_status, lag(content_length) OVER {w} AS old_length, lag(etag) OVER {w} AS old_etag FROM lg")
    shown = (
        "SELECT key, captured_at, ordinal, status_code, content_length, old_status, old_length, old_status IS NULL AS is_first, "
        "coalesce(status_code<>old_status,false) AS status_changed, CASE WHEN status_code>=400 THEN 'high' ELSE 'medium' END AS status_severity, "
        "coalesce(abs(content_length-old_length)>1000,false) AS size_changed, coalesce(etag<>old_etag,false) AS etag_changed, "
        f"abs(content_length-old_length)/greatest(old_length,1)*100 AS change_percent FROM ({numeric})")
    o["j2_stateful_numeric_diff"] = log + shown
    o["j4_micro_batch_trigger"] = log + shown + " WHERE abs(content_length-old_length)>1000"
    o["j5_late_capture_rule"] = _with(CAPTURES) + (
        f"SELECT arg_max(url, ordinal) AS url, max(captured_at) AS captured_at, 'state' AS kind FROM src WHERE cycle_no=3 GROUP BY {norm('final_url')} "
        "UNION ALL " + _late_sql())


def _late_sql() -> str:
    """Captures of cycle 2 whose key cycle 3 did not write are compared, the others are late."""
    key = norm("final_url")
    return (
        f"SELECT url, captured_at, 'late' FROM src WHERE cycle_no=2 AND {key} IN (SELECT {key} FROM src WHERE cycle_no=3) UNION ALL "
        f"SELECT url, captured_at, 'compared' FROM src WHERE cycle_no=2 AND {key} NOT IN (SELECT {key} FROM src WHERE cycle_no=3) "
        f"UNION ALL SELECT arg_max(url, ordinal), max(captured_at), 'state' FROM src WHERE cycle_no=2 AND {key} NOT IN (SELECT {key} FROM src WHERE cycle_no=3) GROUP BY {key}")


def _documents() -> None:
    o = ORACLES
    d = _with(LINKED)
    o["b5_linked_doc_filter"] = d + "SELECT cycle_no, link, content_type, followed FROM fp"
    o["h28_document_fingerprint"] = d + "SELECT cycle_no, page_key, link, content_type, status_code, hash, length, skipped FROM mf"
    o["c3_linked_doc_diff"] = d + "SELECT page_key, link, change_type, old_hash, new_hash FROM mc"
    o["g3_key_union"] = d + "SELECT DISTINCT page_key, link FROM mf"
    o["i12_linked_document_changes"] = d + (
        "SELECT page_key, CAST(19 AS INTEGER) AS rule_ordinal, change_type, 'linked_documents' AS source, CASE change_type WHEN 'linked_document_changed' THEN 'high' ELSE 'medium' END AS severity, "
        "false AS policy_alert, link, old_hash, new_hash, status_code, CASE change_type WHEN 'linked_document_added' THEN 'Linked doc added: ' || link || ' (status:' || status_code || ' type:)' "
        "WHEN 'linked_document_removed' THEN 'Linked doc removed: ' || link || ' (old_hash:' || coalesce(old_hash,'') || ')' "
        "ELSE 'Linked doc changed: ' || link || ' (old:' || coalesce(old_hash,'') || ' new:' || coalesce(new_hash,'') || ')' END AS log_text FROM mc")
    words = ", ".join(f"CAST({occurrences(w)} AS BIGINT) AS n_{c}" for c, w in WORDS.items())
    o["h19_policy_keyword_counts"] = f"WITH x AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, {words} FROM x"
    found = ", ".join(f"regexp_extract_all(text,{q('(?i)' + p)},1)" for p in VERSIONS)
    o["h20_version_indicators"] = (
        f"WITH x AS (SELECT doc_id, flatten([{found}]) AS m FROM documents) SELECT doc_id, CAST(generate_subscripts(m,1)-1 AS INTEGER) AS pos, unnest(m) AS mark FROM x")
    o["h27_json_hash"] = "SELECT event_id, sha256(CAST(json(props) AS VARCHAR)) AS hash FROM events"
    o["h26_canonical_json"] = (
        "SELECT event_id, CASE WHEN event_id%10=9 THEN CAST(to_json(rtrim(props,'}')) AS VARCHAR) ELSE CAST(json(props) AS VARCHAR) END AS canonical FROM events")


def _pages() -> None:
    o = ORACLES
    o["b4_parse_gate"] = _tagged("SELECT page_id, has_profile, parse_error AS error, title IS NOT NULL AS has_title", "true")
    o["h3_page_title"] = _tagged("SELECT page_id, title")
    o["h4_meta_description"] = _tagged("SELECT page_id, description")
    o["h5_canonical_url"] = _tagged("SELECT page_id, canonical")
    og = "SELECT page_id, replace(lower(property),'og:','') AS key, arg_max(content, pos) AS value FROM mt WHERE lower(property) LIKE 'og:%' AND content<>'' GROUP BY ALL"
    o["h6_og_metadata"] = profile(TAGGED, og)
    o["d9_og_last_wins"] = profile(TAGGED, f"SELECT p.page_id, value AS og_title FROM p LEFT JOIN ({og}) g ON g.page_id=p.page_id AND key='title' WHERE has_profile")
    o["h7_meta_tags"] = profile(TAGGED, "SELECT page_id, pos, name, property, http_equiv, charset, content FROM mt")
    o["h8_twitter_metadata"] = profile(TAGGED, "SELECT page_id, replace(lower(name),'twitter:','') AS key, arg_max(content, pos) AS value FROM mt WHERE lower(name) LIKE 'twitter:%' AND content<>'' GROUP BY ALL")
    other = (
        "SELECT page_id, key, value FROM (SELECT page_id, name AS key, arg_min(content, pos) AS value FROM mt WHERE name IN ('keywords','author','viewport','robots','generator','theme-color','msapplication-TileColor','application-name') GROUP BY ALL) WHERE value<>'' "
        "UNION ALL SELECT page_id, 'http_equiv_' || lower(http_equiv), arg_max(content, pos) FROM mt WHERE http_equiv<>'' AND content<>'' GROUP BY ALL")
    o["h9_other_metadata"] = profile(TAGGED, other)
    o["d10_first_tag_wins"] = profile(TAGGED,
        f"SELECT p.page_id, description, a.value AS author, r.value AS robots FROM p LEFT JOIN ({other}) a ON a.page_id=p.page_id AND a.key='author' LEFT JOIN ({other}) r ON r.page_id=p.page_id AND r.key='robots' WHERE has_profile")
    o["h10_json_ld"] = profile(TAGGED, "SELECT page_id, CAST(0 AS INTEGER) AS pos, canon AS body FROM j1")
    o["h11_microdata"] = profile(TAGGED, "SELECT p.page_id, item_count, replace(replace(sample,'\"',''),',',' ') AS sample_types FROM p LEFT JOIN i1 USING (page_id, cycle_no) WHERE has_profile")
    o["f2_first_k_items"] = profile(TAGGED, "SELECT DISTINCT page_id, unnest(types[1:5]) AS item_type FROM i0 WHERE len(types)>0")
    anchor = f"(SELECT page_id, url AS page_url, unnest(a) AS tag, CAST(generate_subscripts(a,1)-1 AS INTEGER) AS pos FROM (SELECT page_id, url, regexp_extract_all(doc,{q('(?is)<a' + chr(92) + 'b' + REST + '.*?</a>')}) AS a FROM g5))"
    start = f"regexp_extract(tag,{q('(?is)^<a' + chr(92) + 'b' + REST)})"
    fields = (f"SELECT page_id, page_url, pos, {strip(attr(start,'href'))} AS href, coalesce({attr(start,'title')},'') AS title, "
              f"list_aggregate(list_transform(regexp_split_to_array(tag,'<[^>]*>'), lambda x: {strip(unescape('x'))}),'string_agg','') AS text FROM {anchor}")
    kept = "href<>'' AND NOT starts_with(lower(href),'javascript:') AND NOT starts_with(lower(href),'mailto:') AND NOT starts_with(lower(href),'tel:')"
    o["b8_link_skip_filter"] = profile(TAGGED, f"SELECT page_id, href, {kept} AS kept FROM ({fields}) WHERE href IS NOT NULL")
    domain = f"regexp_extract(page_url,{q(SPLIT)},2)"
    o["h12_page_links"] = profile(TAGGED,
        f"SELECT page_id, CASE WHEN href LIKE '/%' OR contains(lower(href),{domain}) THEN 'internal' WHEN regexp_matches(lower(href),'(facebook|twitter|linkedin|instagram|youtube)\\.com') THEN 'social' ELSE 'external' END AS category, "
        f"href AS url, substr(text,1,100) AS text, substr(title,1,100) AS title, pos FROM ({fields}) WHERE href IS NOT NULL AND {kept}")
    o["h13_clean_text"] = profile(TAGGED, "SELECT page_id, txt AS clean_text FROM g5 WHERE parsed")
    o["h14_word_count"] = _content("SELECT page_id, words AS word_count")
    o["h15_text_preview"] = _tagged("SELECT page_id, preview")
    o["h16_heading_structure"] = _content("SELECT page_id, headings")
    o["h17_element_counts"] = _content("SELECT page_id, CAST(images AS BIGINT) AS images, CAST(paragraphs AS BIGINT) AS paragraphs, CAST(lists AS BIGINT) AS lists")
    o["h18_has_main_content"] = _content("SELECT page_id, main_content")
    o["h21_date_indicators"] = profile(TAGGED, "SELECT page_id, CAST(generate_subscripts(m,1)-1 AS INTEGER) AS pos, unnest(m) AS mark FROM (SELECT page_id, CAST(dates AS VARCHAR[]) AS m FROM p WHERE parsed)")
    o["h22_has_legal_language"] = _content("SELECT page_id, n_privacy+n_terms+n_liability+n_termination+n_rights+n_governance>0 AS has_legal_language")
    o["h23_page_language"] = _tagged("SELECT page_id, lang AS language")
    o["h24_page_charset"] = _tagged("SELECT page_id, charset")
    o["h25_forms_and_comments"] = _tagged("SELECT page_id, has_forms, has_comments")
    tree = ("(SELECT page_id, t.id, t.value AS v FROM j1, lateral (SELECT * FROM json_tree(canon)) t WHERE t.type='OBJECT')")
    names = "','".join(["name", "version", "datePublished", "releaseDate", "description", "identifier", "license", "evaluation", "safety", "safetyMitigations", "allowedUse", "prohibitedUse", "metrics", "usageGuidelines"])
    o["h29_model_card_fields"] = profile(TAGGED,
        f"SELECT page_id, field, arg_max(value, id) AS value FROM (SELECT n.page_id, n.id, e.key AS field, CAST(e.value AS VARCHAR) AS value FROM {tree} n, lateral (SELECT * FROM json_each(n.v)) e "
        f"WHERE (regexp_matches(lower(coalesce(json_extract_string(n.v,'$.\"@type\"'), json_extract_string(n.v,'$.type'),'')),'model|softwareapplication') OR len(list_filter(json_keys(n.v), lambda k: lower(k) IN ('model','safety')))>0) AND e.key IN ('{names}')) GROUP BY ALL")
    card = "SELECT page_id, cycle_no, unnest(['name','version']) AS field, unnest([CAST(json_extract(canon,'$.name') AS VARCHAR), CAST(json_extract(canon,'$.version') AS VARCHAR)]) AS value FROM j1"
    o["c4_model_card_diff"] = profile(CAPTURES,
        f"SELECT coalesce(n.page_id,o.page_id) AS page_id, coalesce(n.cycle_no,o.cycle_no+1) AS cycle_no, coalesce(n.field,o.field) AS field, o.value AS old_value, n.value AS new_value "
        f"FROM ({card}) n FULL OUTER JOIN ({card}) o ON n.page_id=o.page_id AND n.cycle_no=o.cycle_no+1 AND n.field=o.field WHERE n.value IS DISTINCT FROM o.value")
    link = "'https://docs.example/' || d || CASE d%3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.DOCX' END"
    own = fields.replace("SELECT page_id, page_url, pos", "SELECT page_id, cycle_no, page_url, pos").replace(
        "(SELECT page_id, url AS page_url", "(SELECT page_id, cycle_no, url AS page_url").replace(
        "FROM (SELECT page_id, url, regexp", "FROM (SELECT page_id, cycle_no, url, regexp").replace("AS a FROM g5", "AS a FROM g5 WHERE parsed")
    manifest = f"""fd AS (SELECT cycle_no, doc_id AS d, {link.replace('d%', 'doc_id%').replace('|| d ', '|| doc_id ')} AS link,
  CASE WHEN cycle_no=3 AND doc_id%10=5 THEN NULL WHEN cycle_no>=2 AND doc_id%10=2 THEN text || ' rev2' WHEN cycle_no=3 AND doc_id%10=3 THEN text || ' rev3' ELSE text END AS content,
  doc_id%3<>1 OR doc_id%4 IN (0,3) AS followed FROM documents, range(1,4) c(cycle_no) WHERE NOT (cycle_no=2 AND doc_id%10=4)),
ml AS (SELECT page_id, cycle_no, {link} AS link FROM g1, range(page_id*4, page_id*4+4) r(d)
  WHERE parsed AND NOT (cycle_no=1 AND d%10=0) AND NOT (cycle_no=2 AND d%10=1)
  UNION SELECT page_id, cycle_no, href FROM ({own}) WHERE {kept}),
ma AS (SELECT ml.page_id, ml.cycle_no, ml.link, CASE WHEN fd.followed AND fd.content IS NOT NULL THEN sha256(fd.content) END AS hash,
  CASE WHEN fd.d IS NOT NULL AND NOT (fd.cycle_no=3 AND fd.d%10=5) THEN 200 END AS status FROM ml LEFT JOIN fd USING (cycle_no, link)),
mb AS (SELECT captured_at, ordinal, url, cycle_id, cur.page_id AS cp, cur.cycle_no AS cc, prev.page_id AS pp, prev.cycle_no AS pc FROM pr WHERE known AND cur.has_profile AND prev.has_profile),
mx AS (SELECT mb.captured_at, mb.ordinal, mb.url, mb.cycle_id, link, hash, status FROM mb JOIN ma ON ma.page_id=cp AND ma.cycle_no=cc),
my AS (SELECT mb.captured_at, mb.ordinal, mb.url, mb.cycle_id, link, hash FROM mb JOIN ma ON ma.page_id=pp AND ma.cycle_no=pc),
md AS (SELECT captured_at, ordinal, url, cycle_id, link, my.hash AS old_hash, mx.hash AS new_hash, mx.status,
  CASE WHEN my.ordinal IS NULL THEN 'added' WHEN mx.ordinal IS NULL THEN 'removed' ELSE 'changed' END AS kind
  FROM mx FULL OUTER JOIN my USING (captured_at, ordinal, url, cycle_id, link)
  WHERE mx.ordinal IS NULL OR my.ordinal IS NULL OR mx.hash IS DISTINCT FROM my.hash)"""
    o["i12_documents_in_detection"] = "WITH " + ",\n".join([CAPTURES, PROFILE, PAIRS, manifest]) + """
SELECT url, captured_at, ordinal, cycle_id, 19 AS rule_ordinal, 'linked_document_' || kind AS change_type, 'linked_documents' AS source,
  CASE kind WHEN 'changed' THEN 'high' ELSE 'medium' END AS severity, false AS policy_alert, link, old_hash, new_hash,
  'Linked doc ' || kind || ': ' || link || CASE kind WHEN 'added' THEN ' (status:' || coalesce(CAST(status AS VARCHAR),'') || ' type:)'
   WHEN 'removed' THEN ' (old_hash:' || coalesce(old_hash,'') || ')' ELSE ' (old:' || coalesce(old_hash,'') || ' new:' || coalesce(new_hash,'') || ')' END AS log_text FROM md"""
    header = ("SELECT page_id, cycle_no, 'content-type' AS name, content_type AS value FROM src WHERE error IS NULL UNION ALL SELECT page_id, cycle_no, 'last-modified', last_modified FROM src WHERE error IS NULL "
              "UNION ALL SELECT page_id, cycle_no, 'etag', 'late-' || url FROM src WHERE error IS NULL")
    o["b6_volatile_header_drop"] = _with(CAPTURES) + header
    o["b7_header_normalise"] = _with(CAPTURES) + header + (
        " UNION ALL SELECT page_id, cycle_no, 'date', strftime(captured_at,'%Y-%m-%d %H:%M:%S') FROM src WHERE error IS NULL UNION ALL SELECT page_id, cycle_no, 'x-cache', 'HIT' FROM src WHERE error IS NULL")


_sources()
_lists()
_documents()
_pages()
