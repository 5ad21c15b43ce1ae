"""DuckDB statements that check the registered queries.

Common table expressions are named once and each statement takes those it
needs. They are written for DuckDB's own means (recursion, list functions) and
share no text with the Spark side.
"""

from __future__ import annotations

import re

# Sizes of the derived vocabularies: with bytes and special tokens at most the
# published 50,257 and 30,522, and the published number of merge rules.
VOCAB_WORDS, VOCAB_PIECES = 30_000, 20_001
PIECE_WORDS, PIECE_PARTS = 15_000, 15_519
MERGE_RULES = 49_992
# Batch sizes of the published sweep.
SWEEP = [1, 4, 8, 16, 32]
# Limits that bind: symbols of a word, bytes of a match.
DEVICE_WORD, DEVICE_MATCH = 8, 3

BYTES_TO_SYMBOLS = (
    "array_to_string(list_transform(range(0, strlen({0})), "
    "lambda i: syms[('0x' || substr(hex({0}), 2 * i + 1, 2))::INT + 1]), '')"
)

CTES: dict[str, str] = {
    # -- byte alphabet -------------------------------------------------------
    "byte_table": """
        SELECT b, CASE WHEN kept THEN chr(b)
                       ELSE chr((256 + count(*) FILTER (NOT kept) OVER (ORDER BY b) - 1)::INT) END AS s
        FROM (SELECT b::INT AS b, (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172
                                   OR b BETWEEN 174 AND 255) AS kept
              FROM range(0, 256) t(b))""",
    "alpha": "SELECT list(s ORDER BY b) AS syms FROM byte_table",
    # -- words and vocabulary ------------------------------------------------
    "words": """
        SELECT doc_id, i - 1 AS word_idx, starts_with(w, ' ') AS has_space,
               CASE WHEN starts_with(w, ' ') THEN substr(w, 2) ELSE w END AS word
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, ' ?[^ \\n\\t]+') AS ws
                    FROM documents))""",
    "wform": f"""
        SELECT row_number() OVER () AS wid, word, n, {BYTES_TO_SYMBOLS.format('word')} AS form
        FROM (SELECT word, count(*) AS n FROM words GROUP BY word), alpha""",
    "forms": """
        SELECT CASE WHEN has_space AND word_idx > 0 THEN 'Ġ' ELSE '' END || form AS form,
               count(*) AS n
        FROM words JOIN wform USING (word) GROUP BY 1""",
    "parts": """
        SELECT substr(form, s, k) AS piece, sum(n)::BIGINT AS n
        FROM (SELECT form, n, k, unnest(range(1, length(form) - k + 2)) AS s
              FROM wform, (SELECT unnest([2, 3, 4]) AS k))
        GROUP BY 1""",
    "vocab": f"""
        SELECT s AS token, b AS token_id FROM byte_table
        UNION ALL
        SELECT token, (255 + row_number() OVER (ORDER BY n DESC, token))::INT
        FROM (SELECT token, max(n) AS n
              FROM ((SELECT form AS token, n FROM forms ORDER BY n DESC, form LIMIT {VOCAB_WORDS})
                    UNION ALL
                    (SELECT piece, n FROM parts ORDER BY n DESC, piece LIMIT {VOCAB_PIECES}))
              WHERE length(token) > 1 GROUP BY token)""",
    # -- greedy segmentation -------------------------------------------------
    "best": """
        SELECT wid, s, max(k) AS k, arg_max(token_id, k) AS id
        FROM (SELECT wid, s, k, substr(form, s + 1, k) AS token
              FROM (SELECT wid, form, s, unnest(range(1, length(form) - s + 1)) AS k
                    FROM (SELECT wid, form, unnest(range(0, length(form))) AS s FROM wform))
              WHERE k <= (SELECT max(length(token)) FROM vocab))
        JOIN vocab USING (token) GROUP BY wid, s""",
    "walk": """
        SELECT wid, s, s + k AS nxt, id FROM best WHERE s = 0
        UNION ALL
        SELECT b.wid, b.s, b.s + b.k, b.id
        FROM walk w JOIN best b ON b.wid = w.wid AND b.s = w.nxt""",
    "bare": "SELECT wid, list(id ORDER BY s) AS ids FROM walk GROUP BY wid",
    "seg": """
        SELECT word, form, ids, CASE WHEN p.token_id IS NULL THEN [32] || ids ELSE [p.token_id] END AS spaced, p.token_id AS pid
        FROM wform JOIN bare USING (wid) LEFT JOIN vocab p ON p.token = 'Ġ' || form""",
    "tokens": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx, j) - 1 AS pos, id
        FROM (SELECT doc_id, word_idx, unnest(ids) AS id, generate_subscripts(ids, 1) AS j
              FROM (SELECT doc_id, word_idx,
                           CASE WHEN has_space AND word_idx > 0 THEN spaced ELSE ids END AS ids
                    FROM words JOIN seg USING (word)))""",
    "greedy": """
        SELECT d.doc_id, coalesce(t.ids, []) AS ids
        FROM documents d LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids
                                    FROM tokens GROUP BY doc_id) t USING (doc_id)""",
}

# -- limits: words cut to some symbols, matches to some bytes -------------------
CTES |= {
    "device_forms": f"SELECT DISTINCT substr(form, 1, {DEVICE_WORD}) AS form FROM wform",
    "device_best": f"""
        SELECT form, s, max(k) AS k, arg_max(token_id, k) AS id
        FROM (SELECT form, s, k, substr(form, s + 1, k) AS token
              FROM (SELECT form, s, unnest(range(1, length(form) - s + 1)) AS k
                    FROM (SELECT form, unnest(range(0, length(form))) AS s FROM device_forms)))
        JOIN vocab USING (token) WHERE strlen(token) <= {DEVICE_MATCH} GROUP BY form, s""",
    "device_walk": """
        SELECT form, s, s + k AS nxt, id FROM device_best WHERE s = 0
        UNION ALL
        SELECT b.form, b.s, b.s + b.k, b.id
        FROM device_walk w JOIN device_best b ON b.form = w.form AND b.s = w.nxt""",
    "device_seg": """
        SELECT f.form, CASE WHEN b.token_id IS NULL THEN ids ELSE [b.token_id] END AS bare,
               CASE WHEN p.token_id IS NULL THEN [32] || ids ELSE [p.token_id] END AS spaced
        FROM device_forms f
        JOIN (SELECT form, list(id ORDER BY s) AS ids FROM device_walk GROUP BY form) USING (form)
        LEFT JOIN vocab b ON b.token = f.form LEFT JOIN vocab p ON p.token = 'Ġ' || f.form""",
    "device_ids": f"""
        SELECT doc_id, flatten(list(CASE WHEN has_space AND word_idx > 0 THEN spaced ELSE bare END
                                    ORDER BY word_idx)) AS ids
        FROM words JOIN wform USING (word) JOIN device_seg s ON s.form = substr(wform.form, 1, {DEVICE_WORD})
        GROUP BY doc_id""",
}

# -- slices: the same walk over byte slices of every text ----------------------
BATCH = 8
CTES |= {
    "symbols": """
        SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(text), '..'),
                                                      lambda h: syms[('0x' || h)::INT + 1]), '') AS sym
        FROM documents, alpha""",
    "slices": f"""
        SELECT doc_id, b::INT AS batch_idx, (len_b // 4)::INT AS seq_len,
               substr(sym, (b * len_b + 1)::INT, len_b::INT) AS sym
        FROM (SELECT doc_id, sym, length(sym) // {BATCH} AS len_b FROM symbols), range(0, {BATCH}) t(b)""",
    "slice_words": """
        SELECT doc_id, batch_idx, i - 1 AS word_idx, starts_with(w, 'Ġ') AS has_space,
               CASE WHEN starts_with(w, 'Ġ') THEN substr(w, 2) ELSE w END AS form
        FROM (SELECT doc_id, batch_idx, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT doc_id, batch_idx, regexp_extract_all(sym, 'Ġ?[^ĠĊĉ]+') AS ws
                    FROM slices))""",
    "slice_forms": "SELECT DISTINCT form FROM slice_words",
    "slice_best": """
        SELECT form, s, max(k) AS k, arg_max(token_id, k) AS id
        FROM (SELECT form, s, k, substr(form, s + 1, k) AS token
              FROM (SELECT form, s, unnest(range(1, length(form) - s + 1)) AS k
                    FROM (SELECT form, unnest(range(0, length(form))) AS s FROM slice_forms))
              WHERE k <= (SELECT max(length(token)) FROM vocab))
        JOIN vocab USING (token) GROUP BY form, s""",
    "slice_walk": """
        SELECT form, s, s + k AS nxt, id FROM slice_best WHERE s = 0
        UNION ALL
        SELECT b.form, b.s, b.s + b.k, b.id
        FROM slice_walk w JOIN slice_best b ON b.form = w.form AND b.s = w.nxt""",
    "slice_seg": """
        SELECT form, ids, CASE WHEN p.token_id IS NULL THEN [32] || ids ELSE [p.token_id] END AS spaced
        FROM (SELECT form, list(id ORDER BY s) AS ids FROM slice_walk GROUP BY form)
        LEFT JOIN vocab p ON p.token = 'Ġ' || form""",
    "sliced_tokens": """
        SELECT doc_id, batch_idx, flatten(list(ids ORDER BY word_idx)) AS ids
        FROM (SELECT doc_id, batch_idx, word_idx,
                     CASE WHEN has_space AND word_idx > 0 THEN spaced ELSE ids END AS ids
              FROM slice_words JOIN slice_seg USING (form))
        GROUP BY ALL""",
    "padded": """
        SELECT doc_id, batch_idx, seq_len, coalesce(len(ids), 0) AS n_all,
               list_resize(coalesce(ids, []::INT[]), seq_len, 0) AS ids
        FROM slices LEFT JOIN sliced_tokens USING (doc_id, batch_idx)""",
}

# -- conversations: the same walk over the words of the turns -------------------
CTES |= {
    "turn_words": f"""
        SELECT conv_id, turn, role, i - 1 AS word_idx, starts_with(w, ' ') AS has_space,
               ltrim(w, ' ') AS word
        FROM (SELECT conv_id, turn, role, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT conv_id, turn, role, regexp_extract_all(text, ' ?[^ \\n\\t]+') AS ws
                    FROM conversations))""",
    "turn_forms": f"""
        SELECT word, {BYTES_TO_SYMBOLS.format('word')} AS form
        FROM (SELECT DISTINCT word FROM turn_words), alpha""",
    "turn_best": """
        SELECT form, s, max(k) AS k, arg_max(token_id, k) AS id
        FROM (SELECT form, s, k, substr(form, s + 1, k) AS token
              FROM (SELECT form, s, unnest(range(1, length(form) - s + 1)) AS k
                    FROM (SELECT form, unnest(range(0, length(form))) AS s FROM turn_forms)))
        JOIN vocab USING (token) GROUP BY form, s""",
    "turn_walk": """
        SELECT form, s, s + k AS nxt, id FROM turn_best WHERE s = 0
        UNION ALL
        SELECT b.form, b.s, b.s + b.k, b.id
        FROM turn_walk w JOIN turn_best b ON b.form = w.form AND b.s = w.nxt""",
    "turn_seg": """
        SELECT word, ids, CASE WHEN p.token_id IS NULL THEN [32] || ids ELSE [p.token_id] END AS spaced
        FROM turn_forms
        JOIN (SELECT form, list(id ORDER BY s) AS ids FROM turn_walk GROUP BY form) USING (form)
        LEFT JOIN vocab p ON p.token = 'Ġ' || form""",
    "turn_ids": """
        SELECT conv_id, turn, role, flatten(list(ids ORDER BY word_idx)) AS ids
        FROM (SELECT conv_id, turn, role, word_idx,
                     CASE WHEN has_space AND word_idx > 0 THEN spaced ELSE ids END AS ids
              FROM turn_words JOIN turn_seg USING (word))
        GROUP BY conv_id, turn, role""",
}

# -- WordPiece -----------------------------------------------------------------
WP_SPACE = " \\t\\n\\r\\p{Z}"
CTES |= {
    "normal": "SELECT doc_id, lower(strip_accents(text)) AS text FROM documents",
    "wp_words": f"""
        SELECT doc_id, unnest(ws) AS tok, generate_subscripts(ws, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text,
                  '[[:punct:]\\p{{P}}]|[^{WP_SPACE}[:punct:]\\p{{P}}]+') AS ws FROM normal)""",
    "basic": "SELECT tok, count(*) AS n FROM wp_words GROUP BY tok",
    "wp_parts": """
        SELECT CASE WHEN s > 1 THEN '##' ELSE '' END || substr(tok, s, k) AS piece, sum(n)::BIGINT AS n
        FROM (SELECT tok, n, s, unnest(range(1, least(4, length(tok) - s + 1) + 1)) AS k
              FROM (SELECT tok, n, unnest(range(1, length(tok) + 1)) AS s FROM basic))
        GROUP BY 1""",
    "wp_vocab": f"""
        SELECT unnest(['[UNK]', '[CLS]', '[SEP]']) AS token, unnest([0, 1, 2]) AS token_id
        UNION ALL
        SELECT token, (2 + row_number() OVER (ORDER BY n DESC, token))::INT
        FROM (SELECT token, max(n) AS n
              FROM ((SELECT tok AS token, n FROM basic ORDER BY n DESC, tok LIMIT {PIECE_WORDS})
                    UNION ALL
                    (SELECT piece, n FROM wp_parts ORDER BY n DESC, piece LIMIT {PIECE_PARTS}))
              GROUP BY token)""",
    "wp_best": """
        SELECT tok, s, max(k) AS k, arg_max(token_id, k) AS id
        FROM (SELECT tok, s, k, CASE WHEN s > 0 THEN '##' ELSE '' END || substr(tok, s + 1, k) AS token
              FROM (SELECT tok, s, unnest(range(1, length(tok) - s + 1)) AS k
                    FROM (SELECT tok, unnest(range(0, length(tok))) AS s FROM basic
                          WHERE length(tok) <= 100)))
        JOIN wp_vocab USING (token) GROUP BY tok, s""",
    "wp_walk": """
        SELECT tok, s, s + k AS nxt, id FROM wp_best WHERE s = 0
        UNION ALL
        SELECT b.tok, b.s, b.s + b.k, b.id
        FROM wp_walk w JOIN wp_best b ON b.tok = w.tok AND b.s = w.nxt""",
    "wp_ids": """
        SELECT tok, CASE WHEN w.nxt = length(tok) THEN w.ids ELSE [0] END AS ids
        FROM basic LEFT JOIN (SELECT tok, max(nxt) AS nxt, list(id ORDER BY s) AS ids
                              FROM wp_walk GROUP BY tok) w USING (tok)""",
    "wordpiece": """
        SELECT doc_id, coalesce(ws, []) AS ws
        FROM documents LEFT JOIN (SELECT doc_id, list(ids ORDER BY i) AS ws
                                  FROM wp_words JOIN wp_ids USING (tok) GROUP BY doc_id)
             USING (doc_id)""",
}

# -- merge-rank BPE ------------------------------------------------------------
# A mark before the last of several white-space characters that precede other
# text stands for the look-ahead of the pre-token pattern.
# Rules of two, three and four symbols come in this order, so each size is done
# by itself. Places of one size that overlap their neighbours are taken by rank:
# on a run of them one is taken if the ascents that lead down from it to the
# lowest rank on either side both have an even number of steps.
TAKEN = """
        SELECT tok, p
        FROM (SELECT tok, p, p - max(CASE WHEN rises THEN p END) OVER (PARTITION BY tok, run ORDER BY p) AS l,
                     min(CASE WHEN falls THEN p END) OVER (PARTITION BY tok, run ORDER BY p DESC) - p AS r
              FROM (SELECT *, coalesce(lag(v) OVER w > v, true) AS rises, coalesce(lead(v) OVER w > v, true) AS falls
                    FROM {0} WINDOW w AS (PARTITION BY tok, run ORDER BY p)))
        WHERE l % 2 = 0 AND r % 2 = 0"""
CTES |= {
    "pre_words": """
        SELECT doc_id, unnest(ws) AS tok, generate_subscripts(ws, 1) AS i
        FROM (SELECT doc_id, list_filter(regexp_extract_all(
                  regexp_replace(text, '(\\s+)(\\s\\S)', '\\1' || chr(1) || '\\2', 'g'),
                  '\\x27s|\\x27t|\\x27re|\\x27ve|\\x27m|\\x27ll|\\x27d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x01]+|\\s+|\\x01'),
                  lambda w: w <> chr(1)) AS ws FROM documents)""",
    "pre_forms": f"""
        SELECT tok, n, {BYTES_TO_SYMBOLS.format('tok')} AS form
        FROM (SELECT tok, count(*) AS n FROM pre_words GROUP BY tok), alpha""",
    "pre_parts": """
        SELECT substr(form, s, k) AS piece, sum(n)::BIGINT AS n
        FROM (SELECT form, n, k, unnest(range(1, length(form) - k + 2)) AS s
              FROM pre_forms, (SELECT unnest([2, 3, 4]) AS k))
        GROUP BY 1""",
    "rules": f"""
        SELECT piece, CASE WHEN length(piece) = 2 THEN 1 ELSE 2 END AS cut,
               (row_number() OVER (ORDER BY length(piece), n DESC, piece) - 1)::INT AS rank
        FROM (SELECT * FROM pre_parts ORDER BY n DESC, piece LIMIT {MERGE_RULES})""",
    "merge_ids": """
        SELECT s AS token, b AS token_id FROM byte_table
        UNION ALL SELECT piece, 256 + rank FROM rules""",
    "pre_places": "SELECT tok, form, unnest(range(1, length(form) + 1)) AS p FROM pre_forms",
    "pairs": f"""
        SELECT tok, p, p - row_number() OVER (PARTITION BY tok ORDER BY p) AS run,
               rank::BIGINT << 32 | p AS v
        FROM (SELECT tok, p, substr(form, p, 2) AS piece FROM pre_places WHERE p < length(form))
        JOIN rules USING (piece)""",
    "taken_pairs": f"{TAKEN.format('pairs')}",
    "twos": """
        SELECT tok, form, p, CASE WHEN t.p IS NULL THEN 1 ELSE 2 END AS k
        FROM (SELECT * FROM pre_places
              WHERE (tok, p) NOT IN (SELECT (tok, p + 1) FROM taken_pairs)) s
        LEFT JOIN taken_pairs t USING (tok, p)""",
    "threes": """
        SELECT tok, form, p, CASE WHEN joins THEN 3 ELSE k END AS k,
               row_number() OVER (PARTITION BY tok ORDER BY p) AS j
        FROM (SELECT *, lag(joins) OVER (PARTITION BY tok ORDER BY p) AS used
              FROM (SELECT n.*, rank IS NOT NULL AS joins
                    FROM (SELECT *, CASE WHEN k = 2 AND lead(k) OVER (PARTITION BY tok ORDER BY p) = 1
                                         THEN substr(form, p, 3) END AS piece FROM twos) n
                    LEFT JOIN rules USING (piece)))
        WHERE used IS NOT TRUE""",
    "doubles": """
        SELECT tok, j AS p, j - row_number() OVER (PARTITION BY tok ORDER BY j) AS run, rank::BIGINT << 32 | j AS v
        FROM (SELECT *, CASE WHEN k = 2 AND lead(k) OVER (PARTITION BY tok ORDER BY j) = 2
                             THEN substr(form, p, 4) END AS piece FROM threes)
        JOIN rules USING (piece)""",
    "taken_doubles": f"{TAKEN.format('doubles')}",
    "fours": """
        SELECT tok, p, substr(form, begin_at, CASE WHEN t.p IS NULL THEN k ELSE 4 END) AS token
        FROM (SELECT tok, form, p AS begin_at, j AS p, k FROM threes
              WHERE (tok, j) NOT IN (SELECT (tok, p + 1) FROM taken_doubles)) s
        LEFT JOIN taken_doubles t USING (tok, p)""",
    "merged_ids": """
        SELECT tok, list(token_id ORDER BY p) AS ids FROM fours JOIN merge_ids USING (token) GROUP BY tok""",
    "merge_bpe": """
        SELECT doc_id, coalesce(ids, []) AS ids
        FROM documents LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids
                                  FROM pre_words JOIN merged_ids USING (tok) GROUP BY doc_id)
             USING (doc_id)""",
}

# -- vectors, measurements -----------------------------------------------------
HASH_FAST = """
    SELECT doc_id, list(((((((5381::BIGINT * 33 + b[1]) * 33 + b[2]) * 33 + b[3]) * 33 + b[4])
                         % 4294967296) % {0})::INT ORDER BY i) AS ids
    FROM (SELECT doc_id, i, list_transform([1, 3, 5, 7], lambda p: ('0x' || substr(h, p, 2))::BIGINT) AS b
          FROM (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i
                FROM (SELECT doc_id, regexp_extract_all(hex(text), '.{{8}}') AS hs FROM documents)))
    GROUP BY doc_id"""
EVENTS = """
    SELECT event_id, user_id, event_type AS scenario, (2 ** (user_id % 8))::INT AS payload_kb,
           value AS time_us FROM events"""
CTES |= {
    "wv": "SELECT vec_id::INT AS id, embedding::DOUBLE[] AS vec FROM embeddings",
    "places": "SELECT count(*) AS n FROM wv",
    "token_vec": """
        SELECT token_id AS id, vec FROM places, vocab JOIN wv ON wv.id = token_id % n""",
    "looked": "SELECT doc_id, pos, vec FROM tokens JOIN token_vec USING (id)",
    "summed": """
        SELECT l.doc_id, l.pos, list_transform(list_zip(l.vec, p.vec, t.vec), lambda z: z[1] + z[2] + z[3]) AS vec
        FROM places, looked l JOIN wv p ON p.id = l.pos % n JOIN wv t ON t.id = 0""",
    "m": EVENTS,
    "times": """
        SELECT scenario AS algo, 'p' || (user_id % 16) AS platform,
               sum(time_us::DECIMAL(18,2))::DOUBLE AS time_us FROM m GROUP BY ALL""",
    "stages": """
        SELECT payload_kb, scenario AS stage, sum(time_us::DECIMAL(18,2))::DOUBLE AS time_us
        FROM m GROUP BY ALL""",
    "wide": """
        SELECT user_id,
               sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'signup')::DOUBLE AS signup,
               sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'purchase')::DOUBLE AS purchase,
               sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'error')::DOUBLE AS error,
               sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'view')::DOUBLE AS view,
               sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'click')::DOUBLE AS click
        FROM m GROUP BY user_id""",
}


def joined(ids: str) -> str:
    return f"array_to_string({ids}, ' ') AS token_ids, len({ids})::INT AS n_tokens"


def checksum(vec: str) -> str:
    return (
        f"count(*) AS n_vectors, round(sum(list_sum({vec})), 3) + 0 AS sum_all, "
        f"round(sum({vec}[1]), 3) + 0 AS sum_first"
    )


def letter(digest: str, place: str) -> str:
    return (
        f"substr('abcdefghijklmnopqrstuvwxyz', "
        f"(('0x' || substr({digest}, 2 * ({place}) + 1, 2))::INT % 26 + 1)::INT, 1)"
    )


WP_FLAT = "flatten(ws)"

QUERIES: dict[str, str] = {
    "scan_payloads": """
        SELECT 'documents' AS source, doc_id::VARCHAR AS text_key, length(text)::BIGINT AS n_chars,
               strlen(text)::BIGINT AS n_bytes FROM documents
        UNION ALL SELECT 'conversations', conv_id || ':' || turn, length(text), strlen(text) FROM conversations
        UNION ALL SELECT 'pages', page_id::VARCHAR, length(html), strlen(html) FROM pages
        UNION ALL SELECT 'benchmark', item_id::VARCHAR, length(text), strlen(text) FROM benchmark""",
    "byte_alphabet": "SELECT doc_id, md5(sym) AS symbols_md5, length(sym)::BIGINT AS n_symbols FROM symbols",
    "byte_round_trip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "word_split": "SELECT doc_id, word_idx, word, has_space FROM words",
    "pre_tokens": "SELECT doc_id, i - 1 AS idx, tok AS token FROM pre_words",
    "wordpiece_normalize": f"""
        SELECT chunk, lower(strip_accents(chunk)) AS normal, n_occ
        FROM (SELECT chunk, count(*) AS n_occ
              FROM (SELECT unnest(regexp_extract_all(text, '[^{WP_SPACE}]+')) AS chunk FROM documents)
              GROUP BY chunk)""",
    "basic_token_counts": "SELECT tok AS token, n AS n_occ FROM basic",
    "batch_slices": f"""
        SELECT doc_id, b AS batch_idx, (strlen(text) // {BATCH} // 4)::BIGINT AS seq_len,
               substr(hex(text), (2 * b * (strlen(text) // {BATCH}) + 1)::INT,
                      (2 * (strlen(text) // {BATCH}))::INT) AS slice_hex
        FROM documents, range(0, {BATCH}) t(b)""",
    "payload_clamp": """
        SELECT doc_id, least(greatest(ceil(strlen(text) / 1024), 1), 128)::BIGINT AS payload_kb,
               least(strlen(text) * 4, 65536)::BIGINT AS transfer_bytes FROM documents""",
    "gen_pattern_text": """
        SELECT doc_id, md5(array_to_string(list_transform(range(0, n_chars),
            lambda i: CASE WHEN i % 5 = 4 THEN ' ' ELSE chr((97 + i % 26)::INT) END), '')) AS text_md5
        FROM documents""",
    "gen_random_text": f"""
        SELECT doc_id, md5(substr(string_agg(t, '' ORDER BY b), 1, any_value(n_chars))) AS text_md5
        FROM (SELECT doc_id, n_chars, b, array_to_string(list_transform(range(0, 16), lambda i:
                  CASE WHEN (b * 16 + i) % 5 = 4 THEN ' ' ELSE {letter('d', 'i')} END), '') AS t
              FROM (SELECT doc_id, n_chars, b, md5('42:' || doc_id || ':' || b) AS d
                    FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 16 + 1)) AS b FROM documents)))
        GROUP BY doc_id""",
    "gen_random_words": f"""
        SELECT doc_id, md5(rtrim(substr(string_agg(t, ' ' ORDER BY j), 1, any_value(n_chars)))) AS text_md5
        FROM (SELECT doc_id, n_chars, j, array_to_string(list_transform(
                  range(0, ('0x' || substr(d, 31, 2))::INT % 5 + 4), lambda i: {letter('d', 'i')}), '') AS t
              FROM (SELECT doc_id, n_chars, j, md5('42/' || doc_id || '/' || j) AS d
                    FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 5 + 1)) AS j FROM documents)))
        GROUP BY doc_id""",
    "corpus_vocabulary": "SELECT token, token_id FROM vocab",
    "word_dictionary": "SELECT form, n AS n_occ FROM forms",
    "whole_word_hits": "SELECT form, n AS n_occ, token_id FROM forms JOIN vocab ON token = form",
    "whole_word_misses": """
        SELECT form, n AS n_occ FROM forms ANTI JOIN vocab ON token = form""",
    "greedy_segments": """
        SELECT s.word, n AS n_occ, array_to_string(ids, ' ') AS bare, array_to_string(spaced, ' ') AS spaced
        FROM seg s JOIN wform w ON w.word = s.word""",
    "greedy_bpe_encode": f"SELECT doc_id, {joined('ids')} FROM greedy",
    "greedy_device_limits": f"""
        SELECT doc_id, {joined('ids')}
        FROM (SELECT doc_id, coalesce(ids, [])[1:strlen(text) // 2] AS ids
              FROM documents LEFT JOIN device_ids USING (doc_id))""",
    "encode_conversations": f"""
        SELECT conv_id, turn, role, {joined('coalesce(ids, [])')}
        FROM conversations LEFT JOIN turn_ids USING (conv_id, turn, role)""",
    "token_positions": "SELECT doc_id, pos, id AS token_id FROM tokens",
    "truncate_tokens": f"SELECT doc_id, {joined('ids[1:512]')} FROM greedy",
    "padded_batches": f"""
        SELECT doc_id, batch_idx, seq_len, array_to_string(ids, ' ') AS token_ids,
               greatest(n_all - seq_len, 0)::INT AS cut_tokens, strlen(text) % {BATCH} AS tail_bytes
        FROM padded JOIN documents USING (doc_id)""",
    "stream_padded_batches": f"""
        SELECT doc_id, batch_idx, seq_len, array_to_string(ids, ' ') AS token_ids,
               greatest(n_all - seq_len, 0)::INT AS cut_tokens, strlen(text) % {BATCH} AS tail_bytes
        FROM padded JOIN documents USING (doc_id)""",
    "batch_sweep": f"""
        SELECT doc_id, size AS batch_size, s AS seq_len, s * size AS n_ids, 4 * s * size AS n_bytes,
               strlen(text) % size AS tail_bytes
        FROM (SELECT doc_id, text, size, (strlen(text) // size // 4)::BIGINT AS s
              FROM documents, (SELECT unnest({SWEEP})::INT AS size))""",
    "transfer_modes": """
        SELECT doc_id, 'A' AS mode, sum(4 * seq_len)::BIGINT AS n_bytes,
               least(sum(4 * seq_len), 65536)::BIGINT AS sent_bytes FROM padded GROUP BY doc_id
        UNION ALL
        SELECT doc_id, 'B', strlen(text)::BIGINT, least(strlen(text), 65536)::BIGINT FROM documents""",
    "hash_tokens": f"""
        SELECT doc_id, array_to_string(ids, ' ') AS token_ids
        FROM documents LEFT JOIN ({HASH_FAST.format(50257)}) USING (doc_id)""",
    "hash_tokens_wordpiece": f"""
        SELECT doc_id, array_to_string(ids, ' ') AS token_ids
        FROM documents LEFT JOIN ({HASH_FAST.format(30522)}) USING (doc_id)""",
    "merge_rules": "SELECT piece AS token, cut AS left_size, rank FROM rules",
    "merge_bpe_encode": f"SELECT doc_id, {joined('ids')} FROM merge_bpe",
    "wordpiece_vocabulary": "SELECT token, token_id FROM wp_vocab",
    "wordpiece_encode": f"SELECT doc_id, {joined(WP_FLAT)} FROM wordpiece",
    "wordpiece_capped": f"SELECT doc_id, {joined('flatten(ws[1:512])[1:600]')} FROM wordpiece",
    "wordpiece_special": f"SELECT doc_id, {joined('([1] || flatten(ws)[1:510] || [2])')} FROM wordpiece",
    "decode_tokens": """
        SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5
        FROM (SELECT doc_id, string_agg(CASE WHEN has_space AND word_idx > 0 THEN ' ' ELSE '' END || word, ''
                                        ORDER BY word_idx) AS t FROM words GROUP BY doc_id)""",
    "decode_tokens_raw": """
        SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5
        FROM (SELECT doc_id, string_agg(CASE WHEN has_space AND word_idx > 0 THEN 'Ġ' ELSE '' END || form, ''
                                        ORDER BY word_idx) AS t
              FROM words JOIN wform USING (word) GROUP BY doc_id)""",
    "token_counts": """
        SELECT lang, count(*) AS n_texts, sum(len(ids))::BIGINT AS n_tokens, max(len(ids))::INT AS max_tokens
        FROM greedy JOIN documents USING (doc_id) GROUP BY lang""",
    "token_counts_by_label": """
        SELECT quality, toxic, count(*) AS n_texts, sum(len(ids))::BIGINT AS n_tokens,
               max(len(ids))::INT AS max_tokens
        FROM greedy JOIN labels USING (doc_id) GROUP BY quality, toxic""",
    "tokenizer_comparison": f"""
        SELECT doc_id, len(g.ids)::BIGINT AS greedy, len(b.ids)::BIGINT AS merge_bpe,
               len({WP_FLAT})::BIGINT AS wordpiece, (strlen(text) // 4)::BIGINT AS hash
        FROM greedy g JOIN merge_bpe b USING (doc_id) JOIN wordpiece w USING (doc_id)
             JOIN documents USING (doc_id)""",
    "payload_bytes": """
        SELECT lang, source, count(*) AS n_texts, sum(strlen(text))::BIGINT AS text_bytes,
               sum(4 * len(ids))::BIGINT AS token_bytes,
               sum(4 * len(ids))::BIGINT::DOUBLE / sum(strlen(text))::BIGINT::DOUBLE AS ratio
        FROM greedy JOIN documents USING (doc_id) GROUP BY lang, source""",
    "stream_encode": f"SELECT doc_id, {joined('ids')} FROM greedy",
    "embedding_lookup": f"SELECT doc_id, {checksum('vec')} FROM looked GROUP BY doc_id",
    "embedding_sum": f"SELECT doc_id, {checksum('vec')} FROM summed GROUP BY doc_id",
    "embedding_affine_tanh": f"""
        SELECT doc_id, {checksum('v')}
        FROM (SELECT doc_id, list_transform(list_zip(l.vec, g.vec, b.vec),
                                            lambda z: tanh(z[1] * z[2] + z[3])) AS v
              FROM looked l JOIN wv g ON g.id = 1 JOIN wv b ON b.id = 2) GROUP BY doc_id""",
    "bert_embedding": f"""
        SELECT doc_id, batch_idx, {checksum('v')}
        FROM (SELECT x.doc_id, x.batch_idx,
                     list_transform(list_zip(w.vec, p.vec, t.vec, g.vec, b.vec),
                                    lambda z: tanh((z[1] + z[2] + z[3]) * z[4] + z[5])) AS v
              FROM (SELECT doc_id, batch_idx, seq_len, unnest(ids) AS id,
                           generate_subscripts(ids, 1) - 1 AS pos FROM padded) x
              JOIN token_vec w ON w.id = x.id
              JOIN wv p ON p.id = x.pos % least(seq_len, (SELECT n FROM places))
              JOIN wv t ON t.id = 0 JOIN wv g ON g.id = 1 JOIN wv b ON b.id = 2)
        GROUP BY doc_id, batch_idx""",
    "skip_warmup": """
        SELECT event_id, scenario, time_us
        FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY event_id) AS r FROM m) WHERE r > 3""",
    "latency_summary": """
        SELECT scenario, payload_kb, round(avg(time_us), 6) AS time_us_mean,
               round(stddev_samp(time_us), 6) AS time_us_std, min(time_us) AS time_us_min,
               max(time_us) AS time_us_max
        FROM (SELECT *, row_number() OVER (PARTITION BY scenario, payload_kb ORDER BY event_id) AS r FROM m)
        WHERE r > 3 GROUP BY scenario, payload_kb""",
    "latency_percentiles": """
        SELECT scenario, payload_kb, round(avg(time_us), 6) AS mean_us,
               round(stddev_pop(time_us), 6) AS std_us, round(quantile_cont(time_us, 0.5), 6) AS p50,
               round(quantile_cont(time_us, 0.9), 6) AS p90, round(quantile_cont(time_us, 0.99), 6) AS p99
        FROM m GROUP BY scenario, payload_kb""",
    "iteration_stats": """
        SELECT scenario, count(time_us) AS iterations, round(avg(time_us), 6) AS mean_us,
               min(time_us) AS min_us, max(time_us) AS max_us, round(stddev_pop(time_us), 6) AS std_us
        FROM m GROUP BY scenario""",
    "unpivot_metrics": """
        SELECT user_id, 'signup_us' AS metric, signup AS value FROM wide
        UNION ALL SELECT user_id, 'purchase_us', purchase FROM wide
        UNION ALL SELECT user_id, 'error_us', error FROM wide
        UNION ALL SELECT user_id, 'view_us', view FROM wide
        UNION ALL SELECT user_id, 'click_us', click FROM wide""",
    "ab_saving": """
        SELECT payload_kb, a AS a_us, b AS b_us, (b - a) / b * 100 AS saving_pct
        FROM (SELECT payload_kb,
                     sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'click')::DOUBLE
                         / count(*) FILTER (scenario = 'click') AS a,
                     sum(time_us::DECIMAL(18,2)) FILTER (scenario = 'view')::DOUBLE
                         / count(*) FILTER (scenario = 'view') AS b
              FROM m GROUP BY payload_kb)""",
    "stage_sum": """
        SELECT user_id, coalesce(view, 0) + coalesce(click, 0) AS total_us FROM wide""",
    "end_to_end_total": """
        SELECT payload_kb, round(sum(time_us), 6) AS total_us FROM stages GROUP BY payload_kb""",
    "stage_share": """
        SELECT payload_kb, stage, time_us, round(sum(time_us) OVER w, 6) AS total_us,
               round(time_us / sum(time_us) OVER w, 6) AS share
        FROM stages WINDOW w AS (PARTITION BY payload_kb)""",
    "throughput": """
        SELECT lang, n_bytes, n_tokens, total_us,
               round(n_bytes / 1024.0::DOUBLE / 1024.0::DOUBLE / (total_us / 1e6::DOUBLE), 6) AS mb_per_s,
               round(n_tokens / (total_us / 1e6::DOUBLE), 6) AS tokens_per_s
        FROM (SELECT lang, sum(strlen(text))::BIGINT AS n_bytes, sum(len(ids))::BIGINT AS n_tokens,
                     round(sum(value), 6) AS total_us
              FROM greedy JOIN documents USING (doc_id) JOIN events ON event_id = doc_id GROUP BY lang)""",
    "bpe_vocabulary_file": "SELECT token, token_id FROM vocab",
    "merges_file": """
        SELECT substr(piece, 1, cut) AS "left", substr(piece, cut + 1) AS "right", rank FROM rules""",
    "wordpiece_vocabulary_file": "SELECT token, token_id FROM wp_vocab",
    "greedy_from_file": f"SELECT doc_id, {joined('ids')} FROM greedy",
    "merge_from_files": f"SELECT doc_id, {joined('ids')} FROM merge_bpe",
    "measurement_files": """
        SELECT scenario, payload_kb,
               CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'warmup' || (event_id % 10)
                    ELSE (event_id % 100)::VARCHAR END END AS iteration,
               (CASE WHEN event_id % 3 < 2 THEN time_us ELSE event_id % 1000 END)::DOUBLE AS textgen_us,
               (CASE WHEN event_id % 3 < 2 THEN time_us ELSE event_id % 1000 END)::DOUBLE AS tokenize_us,
               CASE WHEN event_id % 3 < 2 THEN time_us END AS total_us,
               time_us AS transfer_us, time_us AS compute_us,
               CASE WHEN event_id % 3 <> 1 THEN (event_id % 50)::DOUBLE END AS gpu_util_pct,
               CASE WHEN event_id % 3 <> 1 THEN (event_id % 500)::DOUBLE END AS gpu_mem_mb,
               CASE WHEN event_id % 3 = 0 THEN (event_id % 7)::DOUBLE END AS cpu_pct,
               (CASE WHEN event_id % 6 = 0 THEN event_id % 10 ELSE event_id % 100 END)::INT AS run,
               event_id % 6 = 0 AS is_warmup
        FROM m""",
    "summary_file": f"""
        SELECT scenario, payload_kb, {', '.join(f'mean AS {c}_mean, std AS {c}_std' for c in (
            'textgen_us', 'tokenize_us', 'total_us', 'transfer_us', 'compute_us'))},
               least_ AS compute_us_min, most AS compute_us_max, mean AS gpu_util_pct_mean,
               mean AS gpu_mem_mb_mean, mean AS cpu_pct_mean
        FROM (SELECT scenario, payload_kb, round(avg(time_us), 6) AS mean, round(stddev_samp(time_us), 6) AS std,
                     min(time_us) AS least_, max(time_us) AS most FROM m GROUP BY ALL)""",
    "log_markers": """
        SELECT marker, count(*) AS n, sum(v)::DOUBLE AS total, max(v)::DOUBLE AS most
        FROM (SELECT (['DPU_TEXTGEN_TIME', 'DPU_TOKENIZE_TIME', 'DPU_TOTAL_TIME', 'LATENCY_RESULT',
                       'COMPUTE_RESULT', 'COMPUTE_LATENCY', 'CPU_BPE_TIME', 'CPU_WORDPIECE_TIME',
                       'WORDPIECE_TIME', 'WORDPIECE_TOKENS', 'WORDPIECE_GPU_TIME',
                       'WORDPIECE_GPU_TOKENS'])[event_id % 12 + 1] AS marker, time_us::DECIMAL(18,2) AS v FROM m)
        GROUP BY marker""",
    "result_files": """
        SELECT payload_kb, scenario AS tokenizer, 'the ' || scenario AS name, 'host' AS platform,
               'table' AS implementation, round(avg(time_us), 6) AS mean_us, min(time_us) AS min_us,
               max(time_us) AS max_us, round(stddev_pop(time_us), 6) AS std_us, count(*)::INT AS tokens,
               count(*)::INT AS iterations, payload_kb * 1024 AS text_bytes
        FROM m GROUP BY payload_kb, scenario""",
    "transfer_files": """
        SELECT 'A' AS mode, doc_id, batch_idx, md5(array_to_string(ids, ' ')) AS content_md5 FROM padded
        UNION ALL SELECT 'B', doc_id, -1, md5(text) FROM documents""",
    "statistics_file": """
        SELECT scenario, payload_kb, round(avg(time_us), 6) AS mean_us,
               round(stddev_pop(time_us), 6) AS std_us, round(quantile_cont(time_us, 0.5), 6) AS p50,
               round(quantile_cont(time_us, 0.9), 6) AS p90, round(quantile_cont(time_us, 0.99), 6) AS p99
        FROM m GROUP BY scenario, payload_kb""",
    "metric_percentiles": """
        SELECT metric, round(avg(value), 6) AS mean_us, round(stddev_pop(value), 6) AS std_us,
               round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
               round(quantile_cont(value, 0.99), 6) AS p99
        FROM (SELECT 'signup_us' AS metric, signup AS value FROM wide
              UNION ALL SELECT 'purchase_us', purchase FROM wide
              UNION ALL SELECT 'error_us', error FROM wide
              UNION ALL SELECT 'view_us', view FROM wide
              UNION ALL SELECT 'click_us', click FROM wide) GROUP BY metric""",
    "speedup_vs_slowest": """
        SELECT algo, platform, time_us, max(time_us) OVER (PARTITION BY algo) / time_us AS speedup FROM times""",
    "speedup_vs_baseline": """
        SELECT algo, platform, time_us,
               max(time_us) FILTER (platform = 'p0') OVER (PARTITION BY algo) / time_us AS speedup FROM times""",
    "platform_rank": """
        SELECT algo, platform, time_us,
               row_number() OVER (PARTITION BY algo ORDER BY time_us, platform)::INT AS place FROM times""",
    "best_platform": """
        SELECT algo, arg_min(platform, time_us) AS best_platform, min(time_us) AS best_us,
               max(time_us) / min(time_us) AS factor FROM times GROUP BY algo""",
    "stage_timeline": """
        SELECT payload_kb, stage, time_us, round(sum(time_us) OVER w - time_us, 6) AS start_us,
               round(sum(time_us) OVER w, 6) AS end_us
        FROM stages WINDOW w AS (PARTITION BY payload_kb ORDER BY stage
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


# Every CTE that is read more than once or costly is materialised.
MATERIALIZED = {
    "forms", "token_vec", "places", "device_forms", "device_best", "device_seg", "byte_table", "alpha", "words", "wform", "vocab", "best", "seg", "greedy", "tokens",
    "chunks", "basic", "wp_words", "wp_vocab", "wp_best", "wp_ids", "wordpiece",
    "pre_words", "pre_forms", "rules", "pre_places", "taken_pairs", "twos", "threes", "taken_doubles", "merge_bpe", "slices", "slice_words", "slice_best", "turn_words", "turn_forms", "turn_best",
    "symbols", "times", "stages", "sliced_tokens", "padded", "wv",
}


def statement(final: str) -> str:
    """The statement with the expressions it refers to, in order."""
    needed: list[str] = []

    def visit(sql: str, seen: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", sql, re.I):
                visit(CTES[name], (*seen, name))
                if name not in needed:
                    needed.append(name)

    visit(final, ())
    if not needed:
        return final.strip()
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n].strip()})"
        for n in needed
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()
