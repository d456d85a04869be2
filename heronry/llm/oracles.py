"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_KEY = "translate(trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op7_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, {_KEY.format(x="line")} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE c.k IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""

SQL["op6_mix_sources"] = """
WITH RECURSIVE mass AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS m FROM documents GROUP BY source),
want AS (SELECT source, m, pow(m, 0.5) AS w FROM mass),
sums AS (SELECT sum(m) AS am, sum(w) AS aw FROM want),
rates AS (SELECT source, w / aw * am / m AS rate FROM want, sums),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
drawn AS (SELECT d.*, r.rate, (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '-') || ':1'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
          FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT doc_id, d.source, lang, text, d.rate, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u) AS n FROM drawn d),
copies AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
SELECT doc_id, source, lang, text, round(rate, 6) AS rate, copy::BIGINT AS copy, md5('order42:' || coalesce(doc_id::VARCHAR, '-') || ':' || copy::VARCHAR) AS order_key
FROM copies
"""

_WORDS = "regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"

SQL["op4_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls, {_WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
lines AS (SELECT doc_id, host, t, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
real AS (SELECT *, {_KEY.format(x="line")} AS k, len({_WORDS.format(x="line")}) AS w FROM lines),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real WHERE w > 0 GROUP BY doc_id),
over_limit AS (SELECT host, k FROM real WHERE w > 0 GROUP BY host, k HAVING count(DISTINCT doc_id) >= 10),
common AS (SELECT doc_id, sum(w)::BIGINT AS n_common_words FROM real JOIN over_limit USING (host, k) WHERE w > 0 GROUP BY doc_id),
wins AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, ws FROM d WHERE len(ws) >= 8),
keyed AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS g FROM wins),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice WHERE n >= 2) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_common_words, 0)::BIGINT AS n_common_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN common USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_common_words > 0 AND (n_words - n_common_words < 20 OR n_words - n_common_words < 0.3 * n_words)) AS kept
FROM base
"""

SQL["op1_suffix_tree_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM d WHERE len(ws) >= 20),
keyed AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS g FROM wins),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM d),
left_ AS (SELECT words.doc_id, string_agg(w, ' ' ORDER BY q) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY words.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)
"""

SQL["op11_phrase_mining"] = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM c),
scores AS (SELECT u.lang, u.phrase, u.a, u.j, p.a AS l, q.a AS r, ((2000000::HUGEINT * u.a) // (p.a + q.a))::BIGINT AS score
           FROM cuts u JOIN f p ON p.lang = u.lang AND p.phrase = array_to_string(u.ws[1:u.j], ' ') JOIN f q ON q.lang = u.lang AND q.phrase = array_to_string(u.ws[u.j + 1:u.k], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
subs AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS m FROM c),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM subs) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang)
QUALIFY rank <= 2000
"""

_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")

SQL["secret_counts"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex
FROM d
"""

SQL["edited_texts"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS other FROM d)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(t, 1, n - n // 3) || substr(other, 1, n // 3)) AS edited_sha256 FROM n
"""

SQL["media_payloads"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, strlen(t) AS b, greatest(192, 192 * ((strlen(t) + 191) // 192)) AS p FROM d)
SELECT doc_id, b::BIGINT AS n_bytes, p::BIGINT AS payload_bytes, sha256(t || repeat(' ', (p - b)::INT)) AS payload_sha256 FROM n
"""
