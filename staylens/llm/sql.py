"""SQL that must give the rows of queries that SQL can state."""

from __future__ import annotations

from staylens.llm import quality, warc

WORD = r"[^\x20\x09-\x0D]+"


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""WITH rule_list(rule_host, rule_path, ruled) AS (VALUES {listed}),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS row
  FROM pages
),
best AS (
  SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(ruled, length(rule_host || rule_path)) AS ruled
  FROM parsed JOIN rule_list
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row
)
SELECT page_id, host, path, rule, coalesce(ruled, 'allow') AS verdict
FROM parsed LEFT JOIN best USING (row)"""


def archives() -> str:
    return f"""WITH captured AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS size,
         row_number() OVER () AS row, url,
         coalesce(nullif(regexp_extract(url, '://(.*)$', 1), ''), url) AS rest
  FROM pages
),
placed AS (
  SELECT *, first_value(page_id) OVER same AS response, row_number() OVER same AS place
  FROM captured
  WINDOW same AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, row)
),
told AS (SELECT *, size >= {warc.LEAST_BYTES} AND place > 1 AS again FROM placed)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN response END AS refers_to,
       CASE WHEN url IS NULL THEN '' ELSE
         array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?#]*')), '.')), ',')
         || ')' || coalesce(nullif(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), ''), '/') END AS url_key,
       {warc.FIRST_CAPTURE} + page_id % {warc.SPAN} AS captured_at
FROM told"""


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    ratio = {
        "mean_word_length": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "stop_word_ratio": "n_stop_words / nullif(n_words, 0)",
        "duplicate_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
        "bullet_line_ratio": "n_bullet_lines / nullif(n_lines, 0)",
    }
    ratios = ", ".join(f"{sql} AS {name}" for name, sql in ratio.items())
    held = []
    for t in quality.THRESHOLDS:
        if t.least is not None:
            held.append(f"coalesce({t.measure} >= CAST({t.least} AS DOUBLE), false)")
        if t.most is not None:
            held.append(f"coalesce({t.measure} <= CAST({t.most} AS DOUBLE), false)")
    return rf"""WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
place AS (
  SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM doc
),
shingle AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM place
),
covered AS (
  SELECT row, count(DISTINCT i + k) AS n
  FROM shingle, (VALUES (0), (1), (2)) AS step(k) WHERE n > 1 GROUP BY row
),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS BIGINT)
           AS n_bullet_lines
  FROM doc LEFT JOIN covered USING (row)
),
told AS (
  SELECT *, {ratios}, n_words < {quality.LEAST_WORDS}
         OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM counted
)
SELECT *, NOT base_failed AND {" AND ".join(held)} AS kept FROM told"""


def filter_audit() -> str:
    """Every part, order and step of the filter audit, from the failures of each document."""
    word = r"[^\x20\x09-\x0D]+"
    pick = " || ".join(f"substr('ABCDE', p{i}, 1)" for i in range(1, 6))
    perms = ", ".join(f"range(1, 6) AS r{i}(p{i})" for i in range(1, 6))
    unlike = " AND ".join(f"p{i} <> p{j}" for i in range(1, 6) for j in range(1, i))
    return f"""WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
),
words AS (SELECT *, regexp_extract_all(text, '{word}') AS w FROM texts),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
said AS (
  SELECT doc_id, max(coalesce(quality, 0)) = 1 AS good, max(coalesce(toxic, 0)) = 1 AS bad
  FROM labels GROUP BY doc_id
),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, concat(
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 5 * length(words.text)
         THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM words JOIN firsts ON words.text = firsts.text LEFT JOIN said USING (doc_id)
),
counted AS (SELECT part, fails, good, bad, count(*) AS n FROM failing GROUP BY ALL),
orders AS (SELECT {pick} AS filter_order FROM {perms} WHERE {unlike}),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f,
         substr(filter_order, 1, step - 1) AS earlier
  FROM orders, range(1, 6) AS r(step)
),
placed AS (
  SELECT part, filter_order, step, f, n, good, bad, contains(fails, f) AS here, fails = f AS only_here,
         earlier <> '' AND regexp_matches(fails, '[' || earlier || '_]') AS gone
  FROM counted, steps
),
summed AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND here), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND here), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (only_here), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (NOT gone AND here AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (NOT gone AND here AND bad), 0) AS BIGINT) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, f
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed"""
