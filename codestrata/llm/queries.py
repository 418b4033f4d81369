"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, crosspolytope, mixing, ngramjoin, piece, ppm, quality, sharding, tokencounts, toxicity

QUERIES = {
    "op1_cross_polytope": crosspolytope.query,
    "op2_mix_sources": mixing.query,
    "op3_shard_bytes": sharding.query,
    "op4_token_counts": tokencounts.query,
    "op5_chat_format": chat.query,
    "op6_piece_codec": piece.query,
    "op7_ngram_join": ngramjoin.query,
    "op8_ppm_score": ppm.query,
    "op9_quality_rules": quality.query,
    "op10_toxicity": toxicity.query,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = "[^\\x20\\x09-\\x0D]+"


def escaped(column: str, role: bool) -> str:
    """What chat.escape makes of a text."""
    out = f"coalesce({column}, '')"
    for old, new in chat.ROLE_ESCAPES if role else chat.ESCAPES:
        out = f"replace({out}, {literal(old)}, {literal(new)})"
    return out


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if text != "\n" else "chr(10)"


#: A table of CRC-32, from its rule: eight times a bit to the right, with the polynomial where one falls out.
CRC_STEP = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
CRC_TABLE = "range(256)::BIGINT[]"
for _ in range(8):
    CRC_TABLE = f"list_transform({CRC_TABLE}, lambda x: {CRC_STEP})"


SHARDS, TOGETHER = 24, sharding.TOGETHER
ORACLES: dict[str, str] = {
    "op3_shard_bytes": f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS g, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT {CRC_TABLE} AS crc_of),
-- each different text once: the bytes of its hexadecimal form, folded over the table
c AS (SELECT g, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda x, b: xor(x >> 8, crc_of[(xor(x, b) & 255) + 1])), 4294967295) AS text_crc32 FROM (SELECT DISTINCT g, h FROM d), crc),
s AS (SELECT d.*, text_crc32, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY d.g) AS own, sum(size) OVER (ORDER BY d.g, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (ORDER BY d.g) AS group_upto FROM d JOIN c ON d.g = c.g),
p AS (SELECT *, least({SHARDS - 1}, (CASE WHEN own * {TOGETHER * SHARDS} > total THEN 2 * upto - size ELSE 2 * group_upto - own END) * {SHARDS} // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM p""",
    "op5_chat_format": f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, n, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(n, r))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({escaped("role", True)}) + length({escaped("text", False)}) + {len(chat.HEAD) + len(chat.MIDDLE) + len(chat.END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op7_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN least_ ON a = doc_id""",
}
