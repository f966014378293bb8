"""DuckDB statements for the queries that SQL can express.

The others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SOURCE_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix-1', doc_id::VARCHAR, text)), 1, 3))::BIGINT AS slot
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM per_source
), ranked AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         (sum(weight) OVER () - sum(weight) OVER w + weight)::BIGINT AS open_weight,
         (3 * (sum(source_size) OVER w - source_size))::BIGINT AS stopped_before
  FROM weighted
  WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), marked AS (
  SELECT *, bool_and(3 * source_size * open_weight < weight * (total - stopped_before)) OVER w AS stopped
  FROM ranked
  WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), rates AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN (3 * source_size)::DOUBLE
              ELSE (weight * (total - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE
                   / (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM marked
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_copies
  FROM rates
), reached AS (
  SELECT source, slot, (sum(sum(size)) OVER (PARTITION BY source ORDER BY slot))::BIGINT AS held
  FROM sized GROUP BY source, slot
), choices AS (
  SELECT n.source, abs(r.held - (n.target - n.full_copies * n.source_size)) AS gap, r.slot + 1 AS accept
  FROM needs n JOIN reached r ON n.source IS NOT DISTINCT FROM r.source
  UNION ALL
  SELECT source, abs(target - full_copies * source_size), 0 FROM needs
), best AS (
  SELECT source, accept FROM choices
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, accept) = 1
)
SELECT s.doc_id, s.size, n.source_size, n.target,
       s.size * (n.full_copies + (s.slot < b.accept)::BIGINT) AS taken
FROM sized s
JOIN needs n ON s.source IS NOT DISTINCT FROM n.source
JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""

EXACT_DEDUP = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM norm
WINDOW g AS (PARTITION BY norm)
"""

LINE_DEDUP = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: translate(
           trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM split
), held AS (
  SELECT DISTINCT doc_id, unnest(keys) AS key FROM keyed
), repeated AS (
  SELECT key, max(doc_id) AS last FROM held WHERE length(key) >= 20 GROUP BY key HAVING count(*) >= 3
), gone AS (
  SELECT doc_id, list(key) AS dropped FROM held JOIN repeated USING (key) WHERE doc_id <> last GROUP BY doc_id
), left_over AS (
  SELECT doc_id, lines,
         list_filter(lines, lambda x, i: dropped IS NULL OR NOT list_contains(dropped, keys[i])) AS kept
  FROM keyed LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM left_over
"""


def _level(name: str, source: str, by: str) -> str:
    """CTEs that shrink the rates of a level (by, n, bad, above) to those above."""
    return f"""
{name}_prior AS (
  SELECT (1 - rho) / rho AS strength FROM (
    SELECT greatest(least(coalesce(
             (sum(n * (bad / n - above) * (bad / n - above)) - sum(above * (1 - above)))
             / nullif(sum((n - 1) * (above * (1 - above))), 0), 0.5), 0.99), 0.01) AS rho
    FROM {source} WHERE n > 0)
), {name}_rate AS (
  SELECT {by}, (strength * above + bad) / (strength + n) AS above FROM {source}, {name}_prior
)"""


URL_FILTER = rf"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, blocks) AS (
  VALUES ('org', '/', 0), ('example.org', '/es/', 1), ('example.org', '/en/1', 1), ('com', '/fr/', 0), ('com', '/de/', 1)
), ruled AS (
  SELECT s.*, r.rule, r.blocks FROM split s LEFT JOIN LATERAL (
    SELECT rule_host || rule_path AS rule, blocks FROM rules
    WHERE (s.host = rule_host OR ends_with(s.host, '.' || rule_host)) AND starts_with(s.path, rule_path)
    ORDER BY length(rule_host || rule_path) DESC LIMIT 1) r ON true
), counted AS (
  SELECT host, count(blocks)::DOUBLE AS n, coalesce(sum(blocks), 0)::DOUBLE AS bad FROM ruled GROUP BY host
), hosts AS (
  SELECT *, regexp_extract(domain, '\.(.*)$', 1) AS suffix FROM (
    SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+(:\d*)?$') THEN host ELSE coalesce(nullif(regexp_extract(host,
             '([^.]+\.(?:(?:co|com|net|org|gov|ac|edu)\.[a-z]{{2}}|[^.:]+))(?::\d*)?$', 1), ''), host) END AS domain
    FROM counted)
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad,
         (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS above FROM hosts GROUP BY suffix
), {_level("suffix", "suffixes", "suffix")}, domains AS (
  SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(above) AS above
  FROM hosts JOIN suffix_rate USING (suffix) GROUP BY domain
), {_level("domain", "domains", "domain")}, leaves AS (
  SELECT host, n, bad, above FROM hosts JOIN domain_rate USING (domain)
), {_level("host", "leaves", "host")}, posterior AS (
  SELECT host, strength * above + bad AS a, strength * (1 - above) + n - bad AS b FROM leaves, host_prior
), reputation AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS blocked FROM posterior
)
SELECT page_id, host, path, rule,
       CASE WHEN coalesce(blocks = 1, blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN reputation USING (host)
"""

WARC_ARCHIVES = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM hashed
"""

PHRASE_STRIPES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
), counts AS (
  SELECT lang, m, phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30
), parts AS (
  SELECT lang, f, unnest([array_to_string(w[2:], ' '), array_to_string(w[:len(w) - 1], ' ')]) AS part
  FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM counts WHERE m >= 3)
), longer AS (
  SELECT lang, part, max(f) AS most FROM parts GROUP BY lang, part
), open AS (
  SELECT c.lang, c.phrase, c.f AS a, string_split(c.phrase, ' ') AS w
  FROM counts c LEFT JOIN longer g ON g.lang = c.lang AND g.part = c.phrase
  WHERE c.m >= 2 AND NOT coalesce(100 * most >= 80 * c.f, false)
), cuts AS (
  SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM open
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r,
         ((2000000::HUGEINT * c.a) // (x.f + y.f)::HUGEINT)::BIGINT AS score, k
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

STATEMENTS = {
    "op3_source_mixing": SOURCE_MIXING,
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_line_dedup": LINE_DEDUP,
    "op10_url_filter": URL_FILTER,
    "op12_warc_archives": WARC_ARCHIVES,
    "op13_phrase_stripes": PHRASE_STRIPES,
}
