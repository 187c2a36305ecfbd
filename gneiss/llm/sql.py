"""DuckDB SQL of the queries that SQL can express over whole tables.

Trained scores (op1, op2), the tokenizer (op6) and parsed pages (op10) have none; their tests hold them against
plain versions.
"""

from __future__ import annotations

from gneiss.llm.chat_format import CONTEXT, END, PROBE, TEXT, TURN
from gneiss.llm.common import LOWER, UPPER
from gneiss.llm.license_scan import PHRASES, TEMPLATES, needed, window_words
from gneiss.llm.mixing import GOLDEN, WEIGHTS
from gneiss.llm.quality_rules import BARS, BOILERPLATE, MARKS, MENU, SYMBOLS

SPACES = r"[\x20\x09-\x0D]+"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


QUALITY = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri), (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY 1
), l AS (
  SELECT doc_id, x AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), u AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda x: x <> '')) AS n, length(line) - length(regexp_replace(line, '[{SYMBOLS}]', '', 'g')) AS symbols,
    length(line) - length(regexp_replace(line, '[{BARS}]', '', 'g')) AS bars, regexp_matches(line, '{MARKS}') AS marked, length(regexp_replace(line, '{SPACES}', '', 'g')) AS chars
  FROM (SELECT DISTINCT doc_id, line FROM l)
), k AS (
  SELECT doc_id, sum(chars) AS chars FROM u WHERE NOT (
    (symbols > 0 AND symbols > 0.3 * greatest(n, 1)) OR (bars >= 3 AND 2 * bars >= n) OR (NOT marked AND n >= 12) OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')
    OR (NOT marked AND n <= 8 AND len(list_filter(regexp_split_to_array(lower(line), '{SPACES}'), lambda x: x <> '' AND x NOT IN ({quoted(MENU)}))) = 0)) GROUP BY 1
), b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce((SELECT count(*) - count(DISTINCT line) FROM l WHERE l.doc_id = w.doc_id), 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(k.chars, 0) AS kept_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN k USING (doc_id)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, CASE WHEN word_chars = 0 THEN 0.0 ELSE kept_chars::DOUBLE / word_chars END AS kept_share FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND kept_share >= 0.3) AS kept, kept_share FROM f
"""

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LICENSES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS ws FROM documents
), p AS (SELECT label, string_split(phrase, ' ') AS pw FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, x in PHRASES)}) v(phrase, label)
), hits AS (
  SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), p WHERE ws[i] = pw[1] AND list_slice(ws, i, i + len(pw) - 1) = pw
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY 1
), tm AS (SELECT label, width, need, unnest(list_distinct(string_split(words, ' '))) AS tok, len(list_distinct(string_split(words, ' '))) AS size
  FROM (VALUES {", ".join(f"('{x}', '{t}', {window_words(t)}, {needed(t, 0.9)})" for x, t in TEMPLATES)}) v(label, words, width, need)
), at AS (SELECT doc_id, label, width, need, size, tok, i FROM (SELECT doc_id, unnest(ws) AS tok, unnest(range(0, len(ws))) AS i FROM w) JOIN tm USING (tok)
), enough AS (SELECT doc_id, label FROM at GROUP BY doc_id, label, need HAVING count(DISTINCT tok) >= need
), live AS (SELECT at.* FROM at JOIN enough USING (doc_id, label)
), block AS (
  SELECT a.doc_id, a.label, count(DISTINCT b.tok) / any_value(a.size)::DOUBLE AS share
  FROM live a JOIN live b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.width GROUP BY a.doc_id, a.label, a.i, a.need HAVING count(DISTINCT b.tok) >= a.need
), m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM block GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce((SELECT count(*) - count(DISTINCT line) FROM l WHERE l.doc_id = w.doc_id), 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(k.chars, 0) AS kept_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN k USING (doc_id)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, CASE WHEN word_chars = 0 THEN 0.0 ELSE kept_chars::DOUBLE / word_chars END AS kept_share FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND kept_share >= 0.3) AS kept, kept_share FROM f
"""

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LICENSES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS ws FROM documents
), p AS (SELECT label, string_split(phrase, ' ') AS pw FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, x in PHRASES)}) v(phrase, label)
), hits AS (
  SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), p WHERE ws[i] = pw[1] AND list_slice(ws, i, i + len(pw) - 1) = pw
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY 1
), tm AS (SELECT label, list_distinct(string_split(words, ' ')) AS tw FROM (VALUES {", ".join(f"('{x}', '{t}')" for x, t in TEMPLATES)}) v(label, words)
), ln AS (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(translate(x, '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda y: y <> '')) AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
), m AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share
  FROM (SELECT doc_id, label, len(list_intersect(lw, tw)) / len(tw)::DOUBLE AS share, len(list_intersect(lw, tw)) AS k, ceil(0.9 * len(tw) - 1e-9) AS need FROM ln, tm) WHERE k >= need GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN m USING (doc_id)
"""

SHINGLES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM sh GROUP BY 1
), c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS rep, count(*) OVER (PARTITION BY sig) AS copies FROM n
), one AS (SELECT sh.doc_id, s, n FROM sh JOIN c USING (doc_id) WHERE doc_id = rep
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), comp AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY 1
), deg AS (SELECT e.a, count(*) AS texts, sum(c.copies) AS docs FROM e JOIN c ON c.doc_id = e.b GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.m, c.rep, w.doc_id) AS component_id, coalesce(c.rep, w.doc_id) AS class_id,
  CAST(coalesce(c.copies - 1 + coalesce(deg.docs, 0), 0) AS BIGINT) AS n_links, CAST(coalesce(deg.texts, 0) AS BIGINT) AS n_texts_linked
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN comp ON comp.a = c.rep LEFT JOIN deg ON deg.a = c.rep
"""


def escaped(x: str) -> str:
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + (length({x}) - length(replace({x}, '<|', ''))) // 2)"


CHAT = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), k AS (
  SELECT *, greatest(len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '')), 1) AS tokens, row_number() OVER o AS place FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS before FROM k
), x AS (SELECT *, CAST(before AS BIGINT) // 1024 AS win FROM b
), e AS (
  SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, win) AS fin, max(win) OVER (PARTITION BY conv_id) AS lastw,
    {len(TURN + TEXT + END)} + {escaped("role")} + {escaped("text")} AS piece, place = 1 AND role = 'system' AS opens FROM x
), h AS (SELECT conv_id, count(DISTINCT win) AS n_windows, max(CASE WHEN opens THEN piece + {len(CONTEXT) - len(TURN)} END) AS head FROM e GROUP BY 1)
SELECT e.conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(piece) + coalesce(sum(piece + {len(CONTEXT) - len(TURN)}) FILTER (WHERE win < lastw AND fin - before <= 128 AND NOT opens), 0) + (any_value(n_windows) - 1) * coalesce(any_value(head), 0) AS BIGINT) AS formatted_chars,
  CAST(any_value(n_windows) AS BIGINT) AS n_windows
FROM e JOIN h USING (conv_id) GROUP BY 1
"""

SECTION = r"\n[ \t\r]*\n"


MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents
), j AS (SELECT a.doc_id, a.t, b.t AS nt, length(a.t) // 2 AS half FROM d a JOIN d b ON b.k = a.k % a.n + 1
), e AS (SELECT *, left(t, length(t) - half) || left(nt, half) AS ed FROM j
), x AS (SELECT doc_id, 't' AS kind, t AS body FROM e UNION ALL SELECT doc_id, 'e', ed FROM e UNION ALL SELECT doc_id, 'n', nt FROM e
), s AS (SELECT doc_id, kind, unnest(ss) AS st, unnest(range(0, len(ss))) AS si FROM (SELECT *, string_split_regex(body, '{SECTION}') AS ss FROM x)
), p AS (SELECT doc_id, kind, si, unnest(ps) AS pt, unnest(range(0, len(ps))) AS pi FROM (SELECT *, string_split(st, chr(10)) AS ps FROM s)
), l AS (SELECT doc_id, kind, si, pi, unnest(ls) AS lt, unnest(range(0, len(ls))) AS li FROM (SELECT *, string_split(regexp_replace(pt, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ls FROM p)
), lh AS (SELECT doc_id, kind, si, pi, li, sha256(lt) AS h, length(lt) AS n FROM l
), ph AS (SELECT doc_id, kind, si, pi, sha256(string_agg(h, '' ORDER BY li)) AS h, sum(n) AS n FROM lh GROUP BY 1, 2, 3, 4
), sh AS (SELECT doc_id, kind, si, sha256(string_agg(h, '' ORDER BY pi)) AS h, sum(n) AS n FROM ph GROUP BY 1, 2, 3
), rh AS (
  SELECT sh.doc_id, sh.kind, sha256(string_agg(h, '' ORDER BY si) || any_value(array_to_string(regexp_extract_all(body, '{SECTION}'), ''))) AS h FROM sh JOIN x USING (doc_id, kind) GROUP BY 1, 2
), sc AS (SELECT DISTINCT a.doc_id, b.kind AS o, a.h, a.n FROM sh a JOIN sh b ON a.doc_id = b.doc_id AND a.h = b.h WHERE a.kind = 't' AND b.kind <> 't'
), po AS (
  SELECT ph.doc_id, v.o, ph.kind, ph.si, ph.pi, ph.h, ph.n FROM ph JOIN sh USING (doc_id, kind, si), (VALUES ('e'), ('n')) v(o)
  WHERE ph.kind IN ('t', v.o) AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.doc_id = ph.doc_id AND sc.o = v.o AND sc.h = sh.h)
), pc AS (SELECT DISTINCT a.doc_id, a.o, a.h, a.n FROM po a JOIN po b ON a.doc_id = b.doc_id AND a.o = b.o AND a.h = b.h WHERE a.kind = 't' AND b.kind <> 't'
), lo AS (
  SELECT DISTINCT po.doc_id, po.o, po.kind, lh.h, lh.n FROM po JOIN lh USING (doc_id, kind, si, pi)
  WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.doc_id = po.doc_id AND pc.o = po.o AND pc.h = po.h)
), lc AS (SELECT a.doc_id, a.o, a.h, a.n FROM lo a JOIN lo b ON a.doc_id = b.doc_id AND a.o = b.o AND a.h = b.h WHERE a.kind = 't' AND b.kind <> 't'
), same AS (SELECT doc_id, o, sum(n) AS n FROM (SELECT * FROM sc UNION ALL SELECT * FROM pc UNION ALL SELECT * FROM lc) GROUP BY 1, 2
), rest AS (SELECT doc_id, o, sum(n) AS n FROM lo WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.doc_id = lo.doc_id AND lc.o = lo.o AND lc.h = lo.h) GROUP BY 1, 2
), near AS (
  SELECT e.doc_id, v.o, 2 * coalesce(same.n, 0) AS q, coalesce(rest.n, 0) AS r
  FROM e CROSS JOIN (VALUES ('e'), ('n')) v(o) LEFT JOIN same ON same.doc_id = e.doc_id AND same.o = v.o LEFT JOIN rest ON rest.doc_id = e.doc_id AND rest.o = v.o
), far AS (SELECT a.doc_id, min(a.si) AS si FROM sh a LEFT JOIN sh b ON b.doc_id = a.doc_id AND b.si = a.si AND b.kind = 'e' WHERE a.kind = 't' AND a.h IS DISTINCT FROM b.h GROUP BY 1
), w AS (SELECT doc_id, o, CASE WHEN q + r = 0 THEN 1.0 ELSE q / (q + r)::DOUBLE END AS v FROM near)
SELECT e.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, rt.h AS fingerprint, re.h AS edited_fingerprint,
  CASE WHEN rt.h = re.h THEN 1.0 ELSE we.v END AS near_edited, wn.v AS near_next, CAST(far.si AS BIGINT) AS first_difference
FROM e JOIN rh rt ON rt.doc_id = e.doc_id AND rt.kind = 't' JOIN rh re ON re.doc_id = e.doc_id AND re.kind = 'e'
  JOIN w we ON we.doc_id = e.doc_id AND we.o = 'e' JOIN w wn ON wn.doc_id = e.doc_id AND wn.o = 'n' LEFT JOIN far ON far.doc_id = e.doc_id
"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || left(md5(doc_id || ':' || coalesce(text, '')), 15) AS BIGINT) AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source
), v AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][src % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM s
), o AS (
  SELECT *, row_number() OVER w AS k, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS settled, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM v WINDOW w AS (ORDER BY size / weight, src)
), c AS (SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM s) - 2 * settled) / rest AS level FROM o
), lev AS (SELECT arg_min(level, k) AS level FROM c WHERE 2 * size >= level * weight
), p AS (SELECT source, src, size, CASE WHEN level IS NULL THEN 2.0 * size ELSE least(2.0 * size, level * weight) END::DOUBLE AS target, least(size, greatest(256, -(-size // 65536))) AS n FROM v, lev
), q AS (SELECT *, CASE WHEN size > 0 THEN CAST(ceil(target * n / size) AS BIGINT) ELSE 0 END AS quota FROM p
), live AS (SELECT *, CAST(sum(quota) OVER (ORDER BY src) AS BIGINT) - quota AS low, CAST(sum(quota) OVER () AS BIGINT) AS total, count(*) OVER () AS many FROM q WHERE quota > 0
), pt AS (
  SELECT slot, least(CAST(floor(CAST(slot AS DOUBLE) * {GOLDEN!r}::DOUBLE % 1 * total) AS BIGINT), total - 1) AS point
  FROM (SELECT unnest(range(0, 2 * total + 64 * many)) AS slot, total FROM (SELECT any_value(total) AS total, any_value(many) AS many FROM live))
), r AS (SELECT src, n, quota, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM pt JOIN live ON low <= point AND point < low + quota
), slots AS (SELECT src, rank % n AS block, rank // n AS pass FROM r WHERE rank < quota
), b AS (SELECT greatest(1, count(*) // 5000) AS buckets FROM d
), placed AS (
  SELECT doc_id, key, d.size, src, p.size AS total, target, n, CAST(sum(d.size) OVER (PARTITION BY src ORDER BY key % buckets, key, doc_id) AS BIGINT) - d.size AS start
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, b
), pieces AS (
  SELECT *, greatest(start, (block * total + n - 1) // n) AS lo, least(start + size, ((block + 1) * total + n - 1) // n) AS hi
  FROM (SELECT *, unnest(range(start * n // total, (start + size - 1) * n // total + 1)) AS block FROM placed WHERE size > 0)
), used AS (
  SELECT doc_id, key, sum(greatest(0, least(hi - lo, CAST(floor(target) AS BIGINT) - (pass * total + lo)))) AS taken FROM pieces JOIN slots USING (src, block) GROUP BY 1, 2
)
SELECT doc_id, size, total AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN used USING (doc_id, key)
"""

ORACLES: dict[str, str] = {
    "op3_ngram_join": SHINGLES,
    "op4_chat_format": CHAT,
    "op5_merkle": MERKLE,
    "op7_license_scan": LICENSES,
    "op8_mixing": MIX,
    "op9_quality_rules": QUALITY,
}
