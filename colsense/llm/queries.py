"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, conversation_repair, cotraining, decontaminate, language_id, line_dedup, mixing, near_dup, quality_rules, search, secrets, sharding, token_store
from .common import table


def op4_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_secrets": secrets.query,
    "op2_decontaminate": decontaminate.query,
    "op3_line_dedup": line_dedup.query,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_store": token_store.query,
    "op6_cotraining": cotraining.query,
    "op7_chat": chat.query,
    "op8_language_id": language_id.query,
    "op9_mixing": op9_mixing,
    "op10_near_dup": near_dup.query,
    "op11_sharding": sharding.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_ranked_search": search.query,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

# Windows of every length that an item has are compared as text.
_OP2 = rf"""WITH b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
 win AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - 8, 2))) AS k FROM b WHERE len(ws) > 0)),
 d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 place AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS k, ws FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
 hit AS MATERIALIZED (SELECT r, k, place.n, item FROM place JOIN win ON win.n = place.n AND win.w = array_to_string(ws[k:k + place.n - 1], ' ')),
 words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hit)) GROUP BY 1),
 items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_ESCAPED = lambda c: f"length(regexp_replace({c}, '([\\\\<\\[])', '\\\\\\1', 'g'))"
_OP7 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, 12 + {_ESCAPED('role')} + 1 + {_ESCAPED('text')} + 11 AS chars FROM c),
 e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM s)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS formatted_chars FROM e GROUP BY 1"""

# Every two documents that share a shingle are compared; components by recursion.
_OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 1, 2))) AS k FROM w WHERE len(ws) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
 least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)"""


def _feistel(x: str) -> str:
    """All rounds of the permutation of op11 on a number in [0, a * b); a and b are columns."""
    hashed = lambda k, half: f"CAST('0x' || substr(md5('0:{k}:' || CAST({half} AS VARCHAR)), 1, 15) AS BIGINT)"
    pair = f"{{'l': {x} // b, 'r': {x} % b}}"
    for k in range(sharding.ROUNDS):
        now = f"list_transform([{pair}], lambda s{k}: "
        pair = now + (f"{{'l': (s{k}.l + {hashed(k, f's{k}.r')} % a) % a, 'r': s{k}.r}}" if k % 2 == 0 else f"{{'l': s{k}.l, 'r': (s{k}.r + {hashed(k, f's{k}.l')} % b) % b}}") + ")[1]"
    return f"list_transform([{pair}], lambda s: s.l * b + s.r)[1]"


# Numbers by digest, the permutation with its walk by recursion, the CRC byte by byte from a table made by its rule.
_OP11 = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))) - 1 AS number, count(*) OVER () AS n FROM documents),
 side AS (SELECT max(n) AS n, CAST(floor(sqrt(greatest(max(n) - 1, 0))) AS BIGINT) + 1 AS b FROM d),
 ab AS (SELECT n, b, (n + b - 1) // b AS a FROM side),
 walk(number, v) AS (SELECT number, {_feistel("number")} FROM d, ab UNION ALL SELECT number, {_feistel("v")} FROM walk, ab WHERE v >= n),
 crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
 h AS (SELECT number, hex(encode(text)) AS h FROM d),
 byte AS (SELECT number, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM h),
 sums AS (SELECT number, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32 FROM byte, crc)
 SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(v % 8 AS INTEGER) AS shard, v // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM d JOIN walk USING (number) JOIN sums USING (number) WHERE v < n"""

# The programme row by row: a conversation's rows are folded into the cheapest audit for each state; s: the moves of a row.
_OP12 = rf"""WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
 c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 20 AS d FROM conversations, crc),
 rows_ AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE d <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM rows_),
 coded AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
 state AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) s(p, nxt)),
 inserted AS (SELECT p, p AS q, '' AS l, 0 AS c, nxt FROM state UNION ALL SELECT p, nxt, 'I', 2, 5 - nxt FROM state UNION ALL SELECT p, 5 - nxt, 'II', 4, nxt FROM state),
 moves AS (SELECT initial, fault, list({{'p': p, 'q': CAST(e.q AS INTEGER), 'l': inserted.l || e.l, 'c': inserted.c + e.c}}) AS m FROM (VALUES ('s'), ('u'), ('a'), ('o')) r(initial), (VALUES ('blank'), ('duplicate'), ('truncated'), ('')) f(fault), inserted,
  LATERAL (SELECT inserted.q AS q, 'D' AS l, 3 AS c UNION ALL SELECT inserted.nxt, 'R', 2 + CAST(fault = 'truncated' AS INTEGER) WHERE fault IN ('truncated', '') UNION ALL SELECT CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'K', CAST(fault = 'truncated' AS INTEGER) WHERE fault IN ('truncated', '') AND (initial = 's' AND inserted.q = 0 OR initial = 'u' AND inserted.q <> 2 OR initial = 'a' AND inserted.q = 2)) e GROUP BY ALL),
 told AS (SELECT conv_id, list({{'v': NULL::STRUCT(c INTEGER, a VARCHAR)[], 'm': m}} ORDER BY i) AS x FROM coded JOIN moves USING (initial, fault) GROUP BY 1),
 ends AS (SELECT conv_id, list_reduce(list_prepend({{'v': [{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}], 'm': NULL::STRUCT(p INTEGER, q INTEGER, l VARCHAR, c INTEGER)[]}}, x),
  lambda a, r: {{'v': list_transform([0, 1, 2, 3], lambda q: list_min(list_prepend({{'c': 1000000000, 'a': ''}}, list_transform(list_filter(r.m, lambda t: t.q = q), lambda t: {{'c': CAST(a.v[t.p + 1].c + t.c AS INTEGER), 'a': a.v[t.p + 1].a || t.l}})))), 'm': NULL::STRUCT(p INTEGER, q INTEGER, l VARCHAR, c INTEGER)[]}}).v AS v FROM told),
 best AS MATERIALIZED (SELECT conv_id, list_min([{{'c': v[1].c, 'a': v[1].a}}, {{'c': v[2].c + 4, 'a': v[2].a || 'II'}}, {{'c': v[3].c + 2, 'a': v[3].a || 'I'}}, {{'c': v[4].c, 'a': v[4].a}}]) AS b FROM ends),
 letters AS (SELECT conv_id, b.a AS a, unnest(range(1, len(b.a) + 1)) AS k, b.a[unnest(range(1, len(b.a) + 1))] AS letter FROM best),
 numbered AS (SELECT conv_id, k, letter, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS o FROM letters),
 line AS (SELECT n.conv_id, k, o, letter, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, max(CASE WHEN o = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS sys FROM numbered n JOIN coded c ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = greatest(n.i, 1) WHERE letter <> 'D'),
 out_ AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM line GROUP BY 1),
 told_ AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND prior || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY 1),
 ids AS (SELECT DISTINCT conv_id FROM conversations)
 SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
 FROM ids LEFT JOIN told_ t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN out_ o ON o.conv_id IS NOT DISTINCT FROM ids.conv_id"""

_OP13 = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 d AS MATERIALIZED (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, ws FROM t WHERE len(ws) > 0),
 tf AS MATERIALIZED (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
 all_ AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
 df AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, all_ GROUP BY w, nn),
 q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)),
 hit AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS score FROM q JOIN df USING (w) JOIN tf USING (w) JOIN d USING (r), all_ GROUP BY ALL)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM hit WHERE score > 0 QUALIFY rank <= 50"""

#: The others draw by Spark's hash, fit models or need a tokenizer: tests hold them against brute force, round trips or held-out accuracy.
SQL: dict[str, str] = {"op2_decontaminate": _OP2, "op7_chat": _OP7, "op10_near_dup": _OP10, "op11_sharding": _OP11, "op12_conversation_repair": _OP12, "op13_ranked_search": _OP13}
