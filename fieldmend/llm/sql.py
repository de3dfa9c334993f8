"""DuckDB SQL for the queries of this folder."""

from __future__ import annotations

from . import pii

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
       FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, i, dw.size, item FROM dw JOIN iw USING (size, gram)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

_AT = "len({0}[i]) + list_sum([0] || [len(x) for x in list_slice({0}, 1, i - 1)]) + list_sum([0] || [len(x) for x in list_slice({1}, 1, i - 1)])"


def _kind(kind: str, pattern: str, valid: str) -> str:
    """Spans of one kind: positions are what stands between the matches and the matches before."""
    at = _AT.format("pieces", "ms")
    return f"""SELECT rid, '{kind}' AS kind, s AS start, s + len(m) AS stop FROM (
  SELECT rid, m, CAST({at} AS BIGINT) AS s FROM (
    SELECT rid, ms, pieces, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS pieces FROM d)))
  WHERE {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN k % 2 = 0 THEN CASE WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END ELSE CAST(x AS INT) END for x, k in string_split(reverse({_DIGITS}), '')]) % 10 = 0"
_MOVED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_MOD97 = f"list_reduce([0] || [CASE WHEN ascii(x) >= 65 THEN ascii(x) - 55 ELSE ascii(x) - 48 END for x in string_split({_MOVED}, '')], lambda a, b: (CASE WHEN b >= 10 THEN a * 100 + b ELSE a * 10 + b END) % 97) = 1"
_NEAR = "lower(substr(t, CAST(greatest(start - 40, 0) AS BIGINT) + 1, CAST(start - greatest(start - 40, 0) AS BIGINT)))"


def _score(base: float, words: str) -> str:
    return f"round({base} + CASE WHEN regexp_matches({_NEAR}, '{words}') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches({_NEAR}, 'version|order|invoice|isbn|serial|build|example') THEN 0.3 ELSE 0 END, 2) >= 0.6"


#: No digit or hyphen stands before or after; this SQL's patterns can't look around.
_ALONE = "NOT regexp_matches(substr(t, CAST(start AS BIGINT), 1), '^[0-9-]') AND NOT regexp_matches(substr(t, CAST(stop AS BIGINT) + 1, 1), '^[0-9-]')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
{_kind("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
UNION ALL
{_kind("ip", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")}
UNION ALL
{_kind("card", "[0-9](?:[ -]?[0-9])+", f"len({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
UNION ALL
{_kind("phone", "[+][0-9][ ().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15")}),
iban AS ({_kind("iban", pii.IBAN.replace("x20", " ").replace(chr(92), ""), _MOD97)}),
ssn AS ({_kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')")}),
secret AS ({_kind("secret", "[A-Za-z0-9_+/-]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 10")}),
spans AS (
  SELECT rid, kind, start, stop, true AS is_base FROM base
  UNION ALL SELECT rid, kind, start, stop, false FROM iban JOIN d USING (rid) WHERE {_score(0.8, pii.FOR["iban"])}
  UNION ALL SELECT rid, kind, start, stop, false FROM ssn JOIN d USING (rid) WHERE {_score(0.4, pii.FOR["ssn"])} AND {_ALONE}
  UNION ALL SELECT rid, kind, start, stop, false FROM secret JOIN d USING (rid) WHERE {_score(0.4, pii.FOR["secret"])}),
ranked AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn', 'secret'], kind) AS r FROM spans),
per AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban,
         count(*) FILTER (kind = 'ssn') AS n_ssn, count(*) FILTER (kind = 'secret') AS n_secret, count(*) AS n_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, r) FILTER (is_base) AS b,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, r) AS s
  FROM ranked GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn, coalesce(n_secret, 0) AS n_secret,
       coalesce(n_spans, 0) AS n_spans, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

OP6 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
      WHERE trim(l[i], ' ') <> '' OR trim(l[i + 1], ' ') <> '' OR trim(l[i + 2], ' ') <> ''),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later),
lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
         FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (SELECT part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
                 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
                 coalesce(doc_id > first_id, false) AS fe, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM d JOIN firsts USING (t) LEFT JOIN lab USING (doc_id)),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM names a, names b, names c, names d, names e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
met AS (SELECT flags.*, filter_order, fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS n_fail,
               least(CASE WHEN fa THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN fb THEN instr(filter_order, 'B') ELSE 6 END,
                     CASE WHEN fc THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN fd THEN instr(filter_order, 'D') ELSE 6 END,
                     CASE WHEN fe THEN instr(filter_order, 'E') ELSE 6 END) AS first_step FROM flags, orders),
steps AS (SELECT met.*, step, substr(filter_order, step, 1) AS f,
                 CASE substr(filter_order, step, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS fails
          FROM met, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
counted AS (SELECT part, filter_order, step, f, count(*) FILTER (first_step > step) AS kept, count(*) FILTER (first_step = step) AS removed,
                   count(*) FILTER (fails AND first_step < step) AS redundant, count(*) FILTER (fails AND n_fail = 1) AS unique_fails,
                   count(*) FILTER (first_step = step AND good = 1) AS good_lost, count(*) FILTER (first_step = step AND toxic = 1) AS toxic_lost
            FROM steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

SQL = {"op12_filter_audit": OP12, "op8_jaccard": OP8, "op4_warc": OP4, "op6_line_dedup": OP6, "op2_pii": OP2, "op5_decontaminate": OP5}
