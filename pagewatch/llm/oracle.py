"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from pagewatch.llm.secrets import BASE, RULES, Rule

#: CRC-32 by bytes: the table of its 256 remainders, as a list.
CRC_TABLE = """
crc_table AS (
    SELECT list(c ORDER BY i) AS remainders FROM (
        SELECT i, list_reduce(list_concat([i], range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS t(i)))
"""


def crc32(text: str) -> str:
    """CRC-32 of ASCII text, with ``crc_table`` in scope."""
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), "
        "lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, remainders[xor(c, b) & 255 + 1])))"
    ).replace("& 255 + 1", "& 255) + 1").replace("remainders[xor", "remainders[(xor")


# The cheapest edits, turn by turn: states are the last initial that stays ('' at the start). Up to two insertions
# come before a turn and at the end; more would only lead back. `best` orders by cost, then audit.
CONVERSATIONS = f"""
WITH RECURSIVE {CRC_TABLE.strip()},
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS (SELECT keyed.*, {crc32("k")} % 20 AS fate FROM keyed, crc_table),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM fated, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
    SELECT *, left(role, 1) AS i,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
        right(rtrim(text, e' \\t\\n\\x0b\\x0c\\r'), 1) AS last FROM damaged),
told AS (
    SELECT *, CASE WHEN last = '' THEN 1
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
        WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM placed),
inserted(a, n, b, made) AS (VALUES
    ('', 0, '', []), ('s', 0, 's', []), ('u', 0, 'u', []), ('a', 0, 'a', []),
    ('', 1, 'u', ['user:']), ('s', 1, 'u', ['user:']), ('a', 1, 'u', ['user:']), ('u', 1, 'a', ['assistant:']),
    ('', 2, 'a', ['user:', 'assistant:']), ('s', 2, 'a', ['user:', 'assistant:'])),
follows(a, b) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edited AS (
    SELECT conv_id, pos, f.a, f.b, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cost, 'K' AS edit, [role || ':' || text] AS made
    FROM told JOIN follows f ON f.b = i WHERE fault IN (0, 3)
    UNION ALL
    SELECT conv_id, pos, f.a, f.b, CASE WHEN fault = 3 THEN 6 ELSE 3 END, 'R',
        [CASE f.b WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM told JOIN follows f ON f.b <> 's' WHERE fault IN (0, 3)
    UNION ALL
    SELECT conv_id, pos, s.a, s.a, 4, 'D', [] FROM told, (VALUES (''), ('s'), ('u'), ('a')) s(a)),
parsed AS (
    SELECT conv_id, 0::BIGINT AS pos, '' AS state, '00000000' AS best, []::VARCHAR[] AS lines
    FROM (SELECT DISTINCT conv_id FROM told)
    UNION ALL
    SELECT conv_id, pos, state, min(best), arg_min(lines, best) FROM (
        SELECT p.conv_id, e.pos, e.b AS state,
            lpad((left(p.best, 8)::BIGINT + 3 * x.n + e.cost)::VARCHAR, 8, '0') || substr(p.best, 9) || repeat('I', x.n) || e.edit AS best,
            list_concat(list_concat(p.lines, x.made), e.made) AS lines
        FROM parsed p JOIN inserted x ON x.a = p.state
        JOIN edited e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.pos = p.pos + 1 AND e.a = x.b)
    GROUP BY ALL),
ended AS (
    SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM (
        SELECT p.conv_id, lpad((left(p.best, 8)::BIGINT + 3 * x.n)::VARCHAR, 8, '0') || substr(p.best, 9) || repeat('I', x.n) AS best,
            list_concat(p.lines, x.made) AS lines
        FROM parsed p JOIN inserted x ON x.a = p.state
        JOIN (SELECT conv_id, max(pos) AS n FROM told GROUP BY 1) t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.pos
        WHERE x.b IN ('', 'a'))
    GROUP BY 1),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM told GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
    coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 8)::BIGINT, 0) AS cost,
    coalesce(substr(best, 9), '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""



def secrets() -> str:
    """Matches of every rule, and their places by the lengths of what lies between and before them."""

    def found(order: int, rule: Rule) -> str:
        pattern = (rule.head + rule.body).replace("'", "''")
        head = rule.head.replace("'", "''")
        past = f"length(regexp_extract(m, '^(?:{head})'))" if head else "0"
        return f"""
    SELECT row, ord, '{rule.kind}' AS kind, start, start + length(m) AS stop FROM (
        SELECT row, {order} AS ord, m,
            list_sum(list_transform(between[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT row, found, between, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (
            SELECT row, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS between FROM texts)))
    WHERE length(m) - {past} >= {rule.least}"""

    spans = "\n    UNION ALL".join(found(i, rule) for i, rule in enumerate(RULES))
    base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans}),
grouped AS (
    SELECT row, {counts},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {base}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
    FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN grouped USING (row)
"""


COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
grams AS (
    SELECT lang, phrase, k, count(*) AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
        FROM worded, range(1, 5) AS t(k))
    GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY 1),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE k > 1 AND f >= 30),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(words[i:i + size - 1], ' ') AS phrase
        FROM candidates, range(2, 4) AS s(size), range(1, 4) AS p(i) WHERE size < k AND i + size - 1 <= k)
    GROUP BY 1, 2),
kept AS (
    SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase)
    WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
cuts AS (
    SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f::HUGEINT + y.f) AS score
    FROM kept c JOIN range(1, 4) AS t(cut) ON cut < k
    JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(words[:cut], ' ')
    JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ARCHIVED = """
WITH paged AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
told AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS digest,
    CASE WHEN octet_length(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS keeper FROM paged)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> page_id THEN keeper END AS refers_to, true AS complete
FROM told
"""

ORACLES = {
    "op6_warc": ARCHIVED,
    "op11_secret_scan": secrets(), "op12_conversation_repair": CONVERSATIONS, "op13_phrase_collocations": COLLOCATIONS,
}
