"""DuckDB twins of this subpackage's queries, where SQL can express them.

They state each result directly (self joins, recursive reachability) and
share nothing with the operators.
"""

from __future__ import annotations

from .chat import BUDGET, CHARS_PER_TOKEN, HISTORY_TOKENS, HISTORY_TURNS
from .quality import ALPHA, DELTA, RULES
from .warc import CHUNK_BYTES, SEGMENT_BYTES

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP5 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, i, line, length(s) AS n, {_LOWER.format('s')} AS k
  FROM (SELECT *, trim(line, {_WS}) AS s FROM lines)
), held AS (
  SELECT k, min(doc_id) AS holder FROM keyed WHERE n >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN held ON keyed.k = held.k AND n >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""

_CUTS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts))
_RATIOS = " UNION ALL ".join(
    f"SELECT doc_id, lang, n_words, base_failed, '{r}' AS rule, {col}::DOUBLE / n_words AS ratio FROM counts WHERE n_words > 0"
    for r, (col, _) in RULES.items())

OP3 = f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (
    SELECT doc_id, i FROM windows WHERE (doc_id, x) IN (SELECT doc_id, x FROM windows GROUP BY ALL HAVING count(*) > 1)
  ), (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id
), counts AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), ratios AS ({_RATIOS}
), cuts(rule, i, cut) AS (VALUES {_CUTS}
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), tested AS (
  SELECT coalesce(lang, '') AS lang, rule, i, cut, count(*) AS n, count(*) FILTER (ratio > cut) AS k
  FROM ratios JOIN cuts USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
), terms AS (
  SELECT lang, rule, i, cut, n, k, j FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM tested)
), tails AS (
  SELECT lang, rule, i, cut, CASE WHEN k >= n * {ALPHA / len(RULES)} THEN 1.0 ELSE
    sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA / len(RULES)})
            + (n - j) * ln({1 - ALPHA / len(RULES)}))) END AS p
  FROM terms GROUP BY lang, rule, i, cut, n, k
), safe AS (
  SELECT lang, rule, cut, min(CASE WHEN p <= {DELTA} / ((SELECT count(DISTINCT lang) FROM tested) * {len(RULES)}) THEN 1
                                   ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY i) AS ok FROM tails
), chosen AS (SELECT lang, rule, min(cut) AS cut FROM safe WHERE ok = 1 GROUP BY ALL
), rejected AS (
  SELECT DISTINCT r.doc_id FROM ratios r JOIN chosen c ON c.lang = coalesce(r.lang, '') AND c.rule = r.rule AND ratio > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM counts
"""

_CODE = r"replace(replace(replace({}, '\', '\\'), '###', '\h'), '</turn>', '\e')"
_ROLE = "replace(replace(" + _CODE.format("role") + r", ':', '\c'), '~', '\s')"

OP10 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length({_ROLE}) + length({_CODE.format('text')}) + 15 AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM turns
), costed AS (SELECT *, ceil(size / {float(CHARS_PER_TOKEN)})::BIGINT AS cost FROM sized
), summed AS (
  SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         rn = 1 AND role = 'system' AND cost <= {BUDGET // 2} AS sys FROM costed
), celled AS (
  SELECT *, greatest(floor(({BUDGET - HISTORY_TOKENS} - reserve) / 2.0), 1) AS stride FROM (
    SELECT *, max(CASE WHEN sys THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS reserve FROM summed)
), steps AS (  -- a new cell, or this turn or the one before is longer than the stride
  SELECT *, rn > 1 AND (floor(before / stride) <> floor(lag(before, 1, 0) OVER w / stride)
                        OR cost > stride OR lag(cost, 1, 0) OVER w > stride) AS step
  FROM celled WINDOW w AS (PARTITION BY conv_id ORDER BY rn)
), spans AS (
  SELECT *, sum(CASE WHEN step THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rn
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS span FROM steps
), ends AS (
  SELECT *, max(span) OVER (PARTITION BY conv_id) AS last,
         sum(cost) OVER (PARTITION BY conv_id ORDER BY span RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS next,
         row_number() OVER (PARTITION BY conv_id, span ORDER BY rn DESC) AS from_end,
         sum(cost) OVER (PARTITION BY conv_id, span ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail
  FROM spans
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size + CASE WHEN sys THEN last * (size + 1)
                       WHEN span < last AND from_end <= {HISTORY_TURNS} AND tail <= {HISTORY_TOKENS}
                            AND tail + next + reserve <= {BUDGET} THEN size + 1
                       ELSE 0 END)::BIGINT AS formatted_chars
FROM ends GROUP BY conv_id
"""

OP4 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
         max(page_id) OVER (PARTITION BY b) AS target FROM p
), k AS (
  SELECT *, payload_bytes >= 1000 AND target <> page_id AS again, payload_bytes // {CHUNK_BYTES} AS c,
         payload_bytes % {CHUNK_BYTES} AS r FROM d
), m AS (  -- the message: 87 bytes of head, each chunk with its size in hex and two line ends, the last chunk
  SELECT *, 87 + payload_bytes + c * (4 + length(format('{{:x}}', {CHUNK_BYTES})))
            + CASE WHEN r > 0 THEN 4 + length(format('{{:x}}', r)) ELSE 0 END + 5 AS size FROM k
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN target END AS refers_to,
       CASE WHEN again THEN 1 ELSE ceil(size / {float(SEGMENT_BYTES)})::BIGINT END AS n_segments, true AS complete FROM m
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, h[2 * i - 1:2 * i + 98] AS x
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS m FROM w) WHERE m < doc_id
), runs AS (  -- windows less than 50 apart or touching cover one run of bytes
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM again)
), spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run
), gaps AS (  -- what is kept: before each span, and after the last
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS t FROM spans
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id
), kept AS (
  SELECT g.doc_id, string_agg(substr(h, (2 * f - 1)::BIGINT, (2 * (t - f))::BIGINT), '' ORDER BY f) AS h
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
), sums AS (SELECT doc_id, sum(b - a) AS r, count(*) AS s FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(b) AS component_id, vec_id = min(b) AS kept,
       1.0::DOUBLE AS audit_recall  -- every audited link must be found
FROM embeddings JOIN reach ON reach.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""

OP11 = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT c FROM t
), convs AS (  -- crc32 bit by bit: a code of a byte is added, each -1 shifts once
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
           lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM ids
), turns AS (
  SELECT convs.c, 0 AS own, place, role, txt FROM convs JOIN t ON t.c = convs.c - convs.c % 5 WHERE place <= h
  UNION ALL SELECT convs.c, 1, place, role, txt FROM convs JOIN t ON t.c = convs.c WHERE place > h
), numbered AS (
  SELECT c, octet_length(encode(txt)) AS bytes, row_number() OVER o AS d,
         string_agg(md5(octet_length(encode(role))::VARCHAR || ':' || role || txt), '') OVER o AS path
  FROM turns WINDOW o AS (PARTITION BY c ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), on_path AS (
  SELECT c, 0 AS d, '' AS path, 0 AS bytes, coalesce((SELECT max(d) FROM numbered n WHERE n.c = ids.c), 0) AS len FROM ids
  UNION ALL SELECT c, d, path, bytes, max(d) OVER (PARTITION BY c) FROM numbered
), nodes AS (
  SELECT path, d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends FROM on_path GROUP BY path, d
), kids AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids ON kids.path = nodes.path
), sums AS (
  SELECT u.path, count(*) FILTER (v.k = 0) AS leaves, sum((v.n - 1) * v.bytes) AS saved
  FROM full_nodes u JOIN full_nodes v ON starts_with(v.path, u.path) GROUP BY u.path
)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, p.c AS parent_conv_id, x.n::BIGINT AS n_convs, x.k::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN sums ON sums.path = x.path
LEFT JOIN nodes p ON x.d > 0 AND p.path = substr(x.path, 1, length(x.path) - 32)
"""

OP12 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), failed AS (
  SELECT doc_id, part, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS fc,
         regexp_matches(text, '[#$%&*|]') AS fd, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe FROM texts
), marked AS (
  SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM failed
), f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM marked GROUP BY ALL
), sums AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(t) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums
"""

OP13 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-' || coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w
  FROM d GROUP BY source
), before AS (  -- sources in order of size / weight: words and weights of those before
  SELECT *, sum(words) OVER () AS total, coalesce(sum(words) OVER o, 0) AS capped_words, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_weights
  FROM s WINDOW o AS (ORDER BY words * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (SELECT *, 3 * words * open_weights < w * (total - 3 * capped_words) AS capped FROM before
), level AS (SELECT max(total) - coalesce(sum(3 * words) FILTER (capped), 0) AS r, sum(w) FILTER (NOT capped) AS open FROM flagged
), t AS (
  SELECT source, words, CASE WHEN capped THEN (3 * words)::DOUBLE ELSE (w * r)::DOUBLE / open::DOUBLE END AS target FROM flagged, level
), p AS (
  SELECT d.*, words, target, CASE WHEN words > 0 THEN floor(target / words::DOUBLE) ELSE 0 END AS certain
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (SELECT *, target - certain * words AS rest, (target - certain * words) / words::DOUBLE AS pi FROM p
), ranked AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS rank FROM q
), summed AS (
  SELECT *, sum(size) OVER o AS upto, row_number() OVER o AS place FROM ranked
  WINDOW o AS (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), picked AS (SELECT *, rest > 0 AND upto <= rest AS picked FROM summed
), gaps AS (SELECT *, rest - coalesce(max(upto) FILTER (picked) OVER (PARTITION BY source), 0) AS gap FROM picked
), closing AS (
  SELECT *, NOT picked AND size > 0 AND rest > 0 AND abs(size - gap) < gap AND row_number() OVER (
    PARTITION BY source ORDER BY NOT picked AND size > 0 DESC, abs(size - gap), size, rank, place) = 1 AS closing FROM gaps
)
SELECT doc_id, size, words AS source_size, target,
       (size * (certain::BIGINT + picked::BIGINT + closing::BIGINT))::BIGINT AS taken FROM closing
"""

SQL = {"op2_minhash_dedup": OP2, "op3_quality_rules": OP3, "op4_warc_segments": OP4, "op5_line_dedup": OP5, "op8_embedding_dedup": OP8, "op9_suffix_dedup": OP9, "op10_chat_format": OP10, "op11_conversation_trie": OP11, "op12_filter_audit": OP12, "op13_source_mix": OP13}
