"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

from dataproof.llm.line_rules import BOILERPLATE

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op8_quality_rules"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, t, {_WORDS.format('t')} AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), runs AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT DISTINCT r, unnest(lines) AS line FROM parts
), judged AS (
  SELECT r, line, len({_WORDS.format('line')}) AS n,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouts,
    len(list_filter({_WORDS.format('line')}, lambda x: regexp_full_match(x, '[|>»·]+'))) AS separators
  FROM lines
), kept AS (
  SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
  FROM judged
  WHERE NOT (symbols * 100 > n * 50 OR shouts * 100 > n * 25 OR separators * 100 > n * 15
    OR (n <= 25 AND regexp_matches(line, '{BOILERPLATE}'))
    OR (n >= 20 AND NOT regexp_matches(line, '[.,;:!?]')))
  GROUP BY r
), measured AS (
  SELECT parts.r, doc_id, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM parts LEFT JOIN repeats ON parts.r = repeats.r
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(chars, 0) * 100 >= word_chars * 50 AS kept,
  n_lines, coalesce(n, 0) AS n_lines_kept, coalesce(chars, 0)::BIGINT AS kept_chars
FROM based LEFT JOIN kept ON based.r = kept.r
"""


ORACLES["op10_url_filters"] = rf"""
WITH RECURSIVE parsed AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN host = 'www.example.com' OR host LIKE '%.www.example.com' THEN
      CASE WHEN starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN starts_with(path, '/') THEN 'com/' END
    WHEN host = 'example.com' OR host LIKE '%.example.com' THEN
      CASE WHEN starts_with(path, '/en/') THEN 'example.com/en/' WHEN starts_with(path, '/') THEN 'com/' END
    WHEN host = 'com' OR host LIKE '%.com' THEN CASE WHEN starts_with(path, '/') THEN 'com/' END
    WHEN host = 'net' OR host LIKE '%.net' THEN
      CASE WHEN starts_with(path, '/es/') THEN 'net/es/' WHEN starts_with(path, '/fr/') THEN 'net/fr/' END
    END AS rule,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', ''),
      '[0-9a-fA-F]{{8}}[0-9a-fA-F-]{{8,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g') AS general
  FROM parsed
), labelled AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v FROM ruled
), steps AS (
  SELECT 0 AS level, host, general, count(v) AS l, count(*) FILTER (v = 'block') AS b,
    string_split(general, '/')[2:] AS segments, '' AS template
  FROM labelled GROUP BY host, general
  UNION ALL
  SELECT level + 1, host, general, l, b, segments, template || '/' || CASE
    WHEN sl = 0 THEN segment
    WHEN (sb / sl + 3.8416 / (sl * 2)) / (1 + 3.8416 / sl)
      - 1.96 * sqrt(sb / sl * (1 - sb / sl) / sl + 3.8416 / (sl * sl * 4)) / (1 + 3.8416 / sl) > 0.5 THEN '<blocked>'
    WHEN (sb / sl + 3.8416 / (sl * 2)) / (1 + 3.8416 / sl)
      + 1.96 * sqrt(sb / sl * (1 - sb / sl) / sl + 3.8416 / (sl * sl * 4)) / (1 + 3.8416 / sl) < 0.5 THEN '<allowed>'
    ELSE segment END
  FROM (
    SELECT *, segments[level + 1] AS segment,
      (sum(l) OVER branch)::DOUBLE AS sl, (sum(b) OVER branch)::DOUBLE AS sb
    FROM steps WHERE level < len(segments)
    WINDOW branch AS (PARTITION BY host, template, segments[level + 1])
  )
), templates AS (
  SELECT host, general, template, (sum(b) OVER t + 0.5::DOUBLE) / (sum(l) OVER t + 5::DOUBLE) AS purity
  FROM steps WHERE level = len(segments)
  WINDOW t AS (PARTITION BY host, template)
)
SELECT page_id, labelled.host, path, rule, coalesce(v, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  template, purity
FROM labelled JOIN templates ON labelled.host = templates.host AND labelled.general = templates.general
"""


ORACLES["op11_hard_negatives"] = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.r AS a, a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM scores WHERE same
), found AS (
  SELECT p.a, p.k, p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scores n ON p.a = n.a AND p.k <= 5 AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""

ORACLES["op12_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), terms AS (
  SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(words) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM terms GROUP BY ALL HAVING count(*) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM terms GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL
), shares AS (
  SELECT c.lang, c.source, c.term, c.n,
    1 + 1000000000::HUGEINT * (c.n + 5) // (t.total + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (c.lang_n + 5) // (l.total + 5 * l.v) AS q
  FROM counts c JOIN totals t ON c.lang = t.lang AND c.source = t.source JOIN langs l ON c.lang = l.lang
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), own AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM every UNION ALL SELECT * FROM own)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op13_repeated_passages"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS words
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE doc_id IS NOT NULL)
), again AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY words) AS least FROM windows) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM again
), lists AS (
  SELECT r, list(p) AS p, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: n IS NULL OR NOT list_contains(p, i)), ' ')) AS kept_sha256
FROM docs LEFT JOIN lists ON docs.r = lists.r
"""
