"""DuckDB SQL for those of the queries that SQL can express.

The others have none: op2 and op7 train models, op3 and op4 need tokenizer libraries, op6 hashes with functions
that DuckDB lacks. They are tested against brute force, round trips and held-out labels.
"""

from .quality_rules import CLASSES, COMMON_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(COALESCE(text, ''), '{UPPER}', '{LOWER}')"


def _quoted(text: str) -> str:
    """A SQL string literal; line ends and other control characters by number."""
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in text)


# Jensen-Shannon distance: a class or word that the document lacks adds half the reference's share of it.
_DISTANCE = """SELECT doc_id, sqrt(GREATEST(0, (SUM(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) + 1 - SUM(q)) / 2)) AS distance
FROM (SELECT c.doc_id, c.n / SUM(c.n) OVER (PARTITION BY c.doc_id) AS p, r.q FROM {0} c JOIN long USING (doc_id) JOIN {0}_ref r ON r.lang IS NOT DISTINCT FROM c.lang AND r.bin = c.bin) GROUP BY doc_id"""
_REFERENCE = "SELECT c.lang, bin, SUM(n) / SUM(SUM(n)) OVER (PARTITION BY c.lang) AS q FROM {0} c JOIN long USING (doc_id) WHERE c.lang IS NOT DISTINCT FROM long.lang AND long.enough GROUP BY c.lang, bin"
_COUNT = "length(text) - length(translate(text, {0}, ''))"

OP1 = rf"""
WITH d AS (SELECT doc_id, lang, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
wins AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM places),
twice AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, array_to_string(win, ' ')) AS n FROM wins WHERE len(win) = 8),
repeats AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
dup AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(text) - ({_COUNT.format(_quoted(" " + "".join(map(chr, range(9, 14)))))}) AS word_chars, {_COUNT.format(_quoted(CLASSES["symbol"]))} AS n_symbols,
  COALESCE(dup.n, 0) AS n_dup_lines, COALESCE(repeats.n, 0) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id)),
long AS (SELECT *, COUNT(*) OVER (PARTITION BY lang) >= 20 AS enough FROM base WHERE n_words >= 100 AND word_chars >= 400),
listed AS (SELECT doc_id, lang, {", ".join(f"{_COUNT.format(_quoted(c))} AS c{i}" for i, c in enumerate(CLASSES.values()))}, length(text) AS every FROM d),
class_counts AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT doc_id, lang, {i} AS bin, c{i} AS n FROM listed" for i in range(len(CLASSES)))} UNION ALL SELECT doc_id, lang, {len(CLASSES)}, every - {" - ".join(f"c{i}" for i in range(len(CLASSES)))} FROM listed) WHERE n > 0),
common AS (SELECT unnest([{", ".join(map(_quoted, COMMON_WORDS))}]) AS bin),
word_counts AS (SELECT doc_id, lang, COALESCE(common.bin, '') AS bin, COUNT(*) AS n FROM (SELECT doc_id, lang, trim(translate(word, '{UPPER}', '{LOWER}'), '.,;:!?"()' || chr(39)) AS word FROM places JOIN d USING (doc_id)) LEFT JOIN common ON common.bin = word GROUP BY ALL),
class_counts_ref AS ({_REFERENCE.format("class_counts")}), word_counts_ref AS ({_REFERENCE.format("word_counts")}),
far AS ({_DISTANCE.format("class_counts")}), odd AS ({_DISTANCE.format("word_counts")}),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND COALESCE(far.distance, 0) <= 0.26 AND COALESCE(odd.distance, 0) <= 0.36 AS kept,
ROUND(far.distance, 6) AS class_distance, ROUND(odd.distance, 6) AS word_distance FROM judged j LEFT JOIN far USING (doc_id) LEFT JOIN odd USING (doc_id)"""

OP5 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT DISTINCT item_id, k, win FROM (SELECT item_id, LEAST(10, len(w)) AS k, unnest(list_transform(range(1, GREATEST(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + LEAST(10, len(w)) - 1], ' '))) AS win FROM iw WHERE len(w) > 0)),
dp AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ip) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, k FROM dp JOIN ip USING (k, win)),
words AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n, 0) AS n_items, sha256(COALESCE(s, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_KINDS = (
    ("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 3, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 2, 20),
    ("hex", 2, r"[0-9a-f]{24,}", 2, 24),
)


def _kind(name: str, number: int, pattern: str, group: int, least: int) -> str:
    both = rf"(?s)(.*?)(?:({pattern})|\z)"
    part = lambda g: f"unnest(regexp_extract_all(text, '{both}', {g}))"
    return f"""SELECT doc_id, source, lang, {number} AS k, '{name}' AS kind, e - length(whole) AS s, e, val FROM (
  SELECT *, SUM(length(pre) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, source, lang, {part(1)} AS pre, {part(2)} AS whole, {part(group)} AS val, generate_subscripts(regexp_extract_all(text, '{both}', 1), 1) AS i
  FROM (SELECT * FROM documents WHERE regexp_matches(text, '{pattern}')))) WHERE whole <> '' AND length(val) >= {least}"""


OP9 = f"""
WITH base AS ({" UNION ALL ".join(_kind(*k) for k in _KINDS)}),
spread AS (SELECT val, COUNT(DISTINCT COALESCE(source, '')) AS owners, COUNT(DISTINCT COALESCE(source, '') || '/' || COALESCE(lang, '')) AS repos FROM base GROUP BY val),
entropy AS (SELECT val, -SUM(n / length(val) * log2(n / length(val))) AS h FROM (SELECT val, c, COUNT(*) AS n FROM (SELECT val, unnest(string_split(val, '')) AS c FROM spread) GROUP BY ALL) GROUP BY val),
judged AS (SELECT val, owners > 1 AS copied, owners <= 1 AND repos <= 2 AND length(val) >= 16 AND h >= 3.0 AND NOT regexp_matches(val, '(?i)example|sample|dummy|changeme|placeholder|your|test|x{{4}}|0{{6}}|1234') AS live FROM spread JOIN entropy USING (val)),
marked AS (SELECT * FROM base JOIN judged USING (val)),
live AS (SELECT DISTINCT doc_id, e - length(val) AS s, 3 AS k, 'live' AS kind, e FROM marked WHERE live),
counts AS (SELECT doc_id, COUNT(*) FILTER (k = 0) AS n_assign, COUNT(*) FILTER (k = 1) AS n_access, COUNT(*) FILTER (k = 2) AS n_hex, COUNT(*) FILTER (copied) AS n_copied,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k, e) AS spans FROM marked GROUP BY doc_id),
every AS (SELECT doc_id, COUNT(*) FILTER (k = 3) AS n_live, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k, e) AS spans FROM (SELECT doc_id, s, k, kind, e FROM marked UNION ALL SELECT doc_id, s, k, kind, e FROM live) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(c.spans, '')) AS base_sha256, COALESCE(a.spans, '') AS spans, COALESCE(n_live, 0) AS n_live, COALESCE(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN every a USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, GREATEST(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], chr(10)))) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 75 * (x.n + y.n - COUNT(*))),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.a)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, c.r AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, MIN(r) AS r FROM reach GROUP BY a) c ON c.a = d.doc_id"""

# Five hex digits of the SHA-1 (20 bits) make four base32 digits.
OP8 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
s AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, MIN(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substring(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))::BIGINT) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s"""

ORACLES: dict[str, str] = {"op1_distribution_divergence": OP1, "op5_wu_manber": OP5, "op8_gzip_normaliser": OP8, "op9_secret_ownership": OP9, "op10_multi_order_jaccard": OP10}
