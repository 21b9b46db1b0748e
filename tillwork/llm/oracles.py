"""DuckDB SQL of the operators that SQL can express, over the tables as views."""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM d),
least AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h HAVING count(*) > 1),
repeated AS (SELECT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN least USING (h) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM repeated),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

LINE_QUALITY = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (
  SELECT doc_id, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
repeated AS (
  SELECT doc_id, unnest([p, p + 1, p + 2]) AS p
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL)
  WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM repeated GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
real_lines AS (
  SELECT doc_id, source, line, len(lw) AS n,
    regexp_replace(lower(array_to_string(lw, ' ')), '[0-9]+', '0', 'g') AS k
  FROM lines WHERE len(lw) > 0),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real_lines GROUP BY doc_id),
frequent AS (SELECT source, k FROM real_lines GROUP BY source, k HAVING count(DISTINCT doc_id) > 5),
gone AS (
  SELECT doc_id, sum(n) AS n FROM real_lines l
  JOIN frequent f ON f.source IS NOT DISTINCT FROM l.source AND f.k = l.k GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(doubled.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN doubled USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_line_words >= 0.7 * n_words AS kept
FROM measured
"""

_MATCHES = r"""
  SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i,
    unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(string_split_regex(t, '{pattern}')[1:-2]) AS before,
    unnest(string_split_regex(t, '{pattern}')[2:]) AS after
  FROM d"""
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

DISCLOSURE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS (""" + " UNION ALL ".join(
    _MATCHES.format(k=k, kind=kind, pattern=pattern) for k, (kind, pattern) in enumerate(_PATTERNS.items())) + r"""),
placed AS (
  SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(m) AS s,
    regexp_replace(m, '[^0-9]', '', 'g') AS digits
  FROM matches),
base AS (
  SELECT *, s + length(m) AS e, right(before, 100) AS l, left(after, 100) AS r,
    kind || ':' || CASE kind WHEN 'email' THEN lower(m) WHEN 'ip' THEN m ELSE digits END AS value
  FROM placed
  WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(m, '0*(1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])(\.0*(1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5]))*')
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN digits[-1 - i]::INT WHEN digits[-1 - i]::INT > 4 THEN 2 * digits[-1 - i]::INT - 9
      ELSE 2 * digits[-1 - i]::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
contexts AS (
  SELECT doc_id, value, s - length(l) AS origin, l AS c, true AS is_left FROM base UNION ALL
  SELECT doc_id, value, e, r, false FROM base),
runs AS (
  SELECT *, row_number() OVER () AS ctx FROM contexts),
words AS (
  SELECT doc_id, value, origin, c, is_left, ctx, unnest(regexp_extract_all(c, '\p{L}+')) AS w,
    unnest(string_split_regex(c, '\p{L}+')[1:-2]) AS g, unnest(range(len(regexp_extract_all(c, '\p{L}+')))) AS i
  FROM runs),
spotted AS (
  SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY ctx ORDER BY i) - length(w) AS p FROM words),
near AS (
  SELECT DISTINCT doc_id, value, lower(w) AS term, origin + p AS s, origin + p + length(w) AS e
  FROM spotted
  WHERE length(w) >= 3 AND CASE WHEN is_left THEN p > 0 ELSE p + length(w) < length(c) END),
together AS (SELECT value, term, count(DISTINCT doc_id) AS n_both FROM near GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
terms AS (
  SELECT term, count(*) AS n_term
  FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(t, '\p{L}{3,}'), lambda x: lower(x)))) AS term FROM d)
  GROUP BY term),
vals AS (SELECT value, count(DISTINCT doc_id) AS n_value FROM base GROUP BY value),
telling AS (
  SELECT value, term, CASE WHEN 2 * n_both >= n_term THEN 'remove' ELSE 'generalise' END AS kind
  FROM together JOIN terms USING (term) JOIN vals USING (value)
  WHERE n_both * (SELECT count(*) FROM d) >= 8 * n_value * n_term AND 4 * n_both >= n_term),
more AS (SELECT doc_id, max(kind) AS kind, s, e FROM near JOIN telling USING (value, term) GROUP BY doc_id, s, e),
spans AS (
  SELECT doc_id, k, kind, s, e FROM base UNION ALL
  SELECT doc_id, CASE kind WHEN 'generalise' THEN 4 ELSE 5 END, kind, s, e FROM more),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card,
    count(*) FILTER (k = 3) AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""
