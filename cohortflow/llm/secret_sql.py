"""SQL twin of the secret scan: the same patterns, tests and step-up rule over exploded letters."""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"]))
# Quotes are doubled for the SQL literal.
ASSIGN = "(" + _NAMES + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _list(number: int, pattern: str, group: int = 0) -> str:
    return f"SELECT doc_id, {number} AS kind_no, regexp_extract_all(text, '{pattern}') AS tokens, regexp_extract_all(text, '{pattern}', {group}) AS measured, string_split_regex(text, '{pattern}') AS gaps FROM docs"


_UPPER_TAIL = "exp(-z * z / 2) / (2.5066282746310002::DOUBLE * (0.661::DOUBLE * abs(z) + 0.339::DOUBLE * sqrt(z * z + 5.51::DOUBLE)))"

SECRETS_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES (0, 'assign', 6), (1, 'access', 20), (2, 'hex', 24), (9, 'run', 20)) v(kind_no, kind, least_length)),
lists AS ({_list(0, ASSIGN, 2)} UNION ALL {_list(1, 'AKIA[A-Z0-9]+')} UNION ALL {_list(2, '[0-9a-f]+')} UNION ALL {_list(9, '[A-Za-z0-9+/_-]+={0,2}')}),
parts AS (
  SELECT doc_id, kind_no, unnest(tokens) AS token, unnest(measured) AS measured, unnest(gaps[1:len(tokens)]) AS gap, generate_subscripts(tokens, 1) AS i FROM lists WHERE len(tokens) > 0
), summed AS (
  SELECT doc_id, kind_no, token, measured, (sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) - length(token))::BIGINT AS start FROM parts
), placed AS (
  SELECT doc_id, kind_no, kind, token, start FROM summed JOIN kinds USING (kind_no) WHERE length(measured) >= least_length
), base AS (
  SELECT doc_id, kind_no, kind, start, start + length(token) AS stop FROM placed WHERE kind_no < 9
), tokens AS (
  SELECT doc_id, start, start + length(token) AS stop, rtrim(token, '=') AS bare FROM placed WHERE kind_no = 9 AND length(rtrim(token, '=')) >= 20
), encoded AS (
  SELECT *, CASE WHEN regexp_full_match(bare, '[0-9a-f]+') THEN 'hex' WHEN regexp_full_match(bare, '[0-9A-F]+') THEN 'HEX' WHEN regexp_full_match(bare, '[A-Z2-7]+') THEN 'base32'
    WHEN regexp_full_match(bare, '[A-Za-z0-9+/]+') THEN 'base64' WHEN regexp_full_match(bare, '[A-Za-z0-9_-]+') THEN 'base64url' END AS encoding FROM tokens
), spelled AS (
  SELECT *, CASE encoding WHEN 'hex' THEN '0123456789abcdef' WHEN 'HEX' THEN '0123456789ABCDEF' WHEN 'base32' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
    WHEN 'base64' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_' END AS alphabet FROM encoded WHERE encoding IS NOT NULL
), letters AS (
  SELECT doc_id, start, encoding, length(alphabet)::DOUBLE AS letters, unnest(range(1, length(bare) + 1)) AS i, bare, alphabet FROM spelled
), indexed AS (
  SELECT doc_id, start, encoding, letters, i, instr(alphabet, substr(bare, i, 1)) - 1 AS x,
    CASE WHEN regexp_full_match(substr(bare, i, 1), '[a-z]') THEN 0 WHEN regexp_full_match(substr(bare, i, 1), '[A-Z]') THEN 1 WHEN regexp_full_match(substr(bare, i, 1), '[0-9]') THEN 2 ELSE 3 END AS k FROM letters
), neighbours AS (
  SELECT *, lag(x) OVER w AS px, lag(k) OVER w AS pk, count(*) OVER (PARTITION BY doc_id, start, x) AS same FROM indexed WINDOW w AS (PARTITION BY doc_id, start ORDER BY i)
), sums AS (
  SELECT doc_id, start, encoding, letters, count(*)::DOUBLE AS n, sum(same)::DOUBLE AS squares, sum(x)::DOUBLE AS sx, sum(x * x)::DOUBLE AS sxx, coalesce(sum(x * px), 0)::DOUBLE AS product, arg_min(x, i) AS head, arg_max(x, i) AS foot,
    count(*) FILTER (2 * x >= letters)::DOUBLE AS high, (1 + count(*) FILTER (px IS NOT NULL AND (2 * x >= letters) <> (2 * px >= letters)))::DOUBLE AS runs, count(*) FILTER (pk IS NOT NULL AND pk <> k)::DOUBLE AS changes
  FROM neighbours GROUP BY doc_id, start, encoding, letters
), facts AS (
  SELECT *, letters - 1 AS free, letters * squares / n - n AS chi, sx / n AS mean, 2 * high * (n - high) / n + 1 AS mu, n * (letters * CASE WHEN lower(encoding) = 'hex' THEN 0.1::DOUBLE ELSE 0.06::DOUBLE END - 1) AS shift FROM sums
), scores AS (
  SELECT *, (pow(chi / free, 1 / 3.0::DOUBLE) - (1 - 2 / (9 * free))) / sqrt(2 / (9 * free)) AS z_chi,
    CASE WHEN (mu - 1) * (mu - 2) / (n - 1) > 0 THEN (runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)) ELSE -sqrt(n) END AS z_runs,
    CASE WHEN sxx - n * mean * mean > 0 THEN ((product - mean * (2 * sx - head - foot) + (n - 1) * mean * mean) / (sxx - n * mean * mean) + 1 / n) * sqrt(n) ELSE sqrt(n) END AS z_serial,
    ((free + shift - chi) / sqrt(2 * (free + 2 * shift)) + (changes - (n - 1) * 0.25::DOUBLE) / sqrt((n - 1) * 0.25::DOUBLE * 0.75::DOUBLE)) / sqrt(2.0::DOUBLE) AS z_text FROM facts
), tails AS (
  SELECT *, list_transform([z_chi, abs(z_runs), abs(z_serial), z_text], lambda z: CASE WHEN z >= 0 THEN {_UPPER_TAIL} ELSE 1 - {_UPPER_TAIL} END) AS q FROM scores
), levelled AS (
  SELECT doc_id, start, encoding || ':' || floor(log2(n))::INT AS stratum, CASE WHEN least(1, 3 * least(q[1], 2 * q[2], 2 * q[3])) < 0.001 THEN 0 ELSE floor(-10 * log10(greatest(q[4], 1e-30))) END AS level FROM tails
), steps AS (
  SELECT stratum, level, sum(c) OVER (PARTITION BY stratum ORDER BY level DESC) AS passed, sum(c) OVER (PARTITION BY stratum) AS total FROM (SELECT stratum, level, count(*) AS c FROM levelled GROUP BY stratum, level)
), bars AS (
  SELECT stratum, min(level) AS bar FROM steps WHERE pow(10, -level / 10) <= 0.01::DOUBLE * passed / total GROUP BY stratum
), found AS (
  SELECT t.doc_id, 3 AS kind_no, 'random' AS kind, t.start, t.stop FROM levelled l JOIN bars USING (stratum) JOIN tokens t ON t.doc_id = l.doc_id AND t.start = l.start
  WHERE level >= bar AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start <= t.start AND t.stop <= b.stop)
), spans AS (
  SELECT * FROM base UNION ALL SELECT * FROM found
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind IS NOT NULL), '') AS spans, count(*) FILTER (kind = 'random') AS n_random
FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
