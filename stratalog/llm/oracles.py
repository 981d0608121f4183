"""SQL of another engine for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from stratalog.llm.common import LOWER, UPPER
from stratalog.llm.quality_rules import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM places),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
steps AS (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS n FROM again),
covered AS (SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id),
ls AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ls WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(l.n, 0) AS n_lines, len([x FOR x IN ws IF lower(x) IN ({_STOPS})]) AS n_stop, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_emphasis,
             length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN lines l ON l.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 20.0 AND n_symbols / n_words <= 0.1 AND n_emphasis / n_words <= 0.3
       AND (n_letters = 0 OR n_capitals / n_letters <= 0.5) AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3) AND n_repeat_words / n_words <= 0.2 AS kept
FROM b"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_PLAIN_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_PLAIN_WORD}') AS ws FROM benchmark),
bp AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM dp),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
hits AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line, {_low(f"trim(line, {_SPACES})")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS most FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id <> f.most AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

#: Bytes as two hexadecimal digits each.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, CAST(len(x) // 2 AS BIGINT) - 199, 500)) AS b FROM d WHERE len(x) >= 400),
pieces AS (SELECT doc_id, b, substring(x, 2 * b + 1, 1398) AS y FROM starts),
p AS (SELECT doc_id, b, y, unnest(range(0, CAST(len(y) // 2 AS BIGINT) - 199)) AS o FROM pieces),
w AS (SELECT doc_id, b + o AS i, md5_number(substring(y, 2 * o + 1, 400)) AS g FROM p),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w WHERE g IN (SELECT g FROM again)),
run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + 200 AS hi FROM run GROUP BY doc_id, k),
edge AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM span),
kept AS (SELECT e.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substring(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) || substring(max(x), CAST(2 * max(hi) + 1 AS BIGINT)) AS rest
         FROM edge e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

ORACLES = {
    "op2_quality_rules": QUALITY,
    "op3_decontaminate": DECONTAMINATE,
    "op4_ngram_join": NGRAM_JOIN,
    "op8_line_dedup": LINE_DEDUP,
    "op9_suffix_dedup": SUFFIX_DEDUP,
}
