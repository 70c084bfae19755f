"""SQL that states what some text queries return, for another engine to run."""

from __future__ import annotations

from .decontaminate import WINDOW as LEAK
from .quality import BY_SHARE, LEFT_SHARE, LEFT_WORDS, MAX_SHARE, MIN_DOCS
from .substrings import WINDOW

_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
win AS (SELECT doc_id, pos, hash(array_to_string(ws[pos + 1 : pos + {WINDOW}], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) AS pos FROM w WHERE len(ws) >= {WINDOW})),
first AS (SELECT h, MIN(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM win JOIN first USING (h) WHERE low < doc_id),
kept AS (SELECT word.doc_id, word, word.pos FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(k.n, 0) AS BIGINT) AS n_removed,
    sha256(COALESCE(k.text, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM kept GROUP BY 1) k ON k.doc_id = w.doc_id
"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
        CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', NULL
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', NULL)
SELECT conv_id, COUNT(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(SUM(24 + length(replace({_ESCAPED.format('role')}, chr(10), chr(92) || 'n')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars,
    false AS rewrites
FROM c GROUP BY conv_id, alone
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
item AS (SELECT item_id, ws, LEAST({LEAK}, len(ws)) AS n FROM (SELECT item_id, {_PLAIN} AS ws FROM benchmark) WHERE len(ws) > 0),
pattern AS (SELECT DISTINCT item_id, n, array_to_string(ws[pos + 1 : pos + n], ' ') AS p
    FROM (SELECT item_id, ws, n, unnest(range(len(ws) - n + 1)) AS pos FROM item)),
lengths AS (SELECT DISTINCT n FROM pattern),
place AS (SELECT doc_id, n, pos, array_to_string(ws[pos + 1 : pos + n], ' ') AS p
    FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS pos FROM d JOIN lengths ON n <= len(ws))),
hit AS (SELECT doc_id, item_id, place.n, pos FROM place JOIN pattern USING (n, p)),
covered AS (SELECT doc_id, COUNT(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM hit) GROUP BY 1),
held AS (SELECT doc_id, COUNT(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(covered.n, 0) AS n_hit, COALESCE(held.n, 0) AS n_items,
    sha256(COALESCE(held.ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id
"""

QUALITY = rf"""
WITH w AS (SELECT doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS doc, COALESCE(source, chr(1)) AS host, COALESCE(text, '') AS text, {_WORDS} AS ws FROM documents),
five AS (SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + 5], ' ') AS p
    FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS pos FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, p FROM five GROUP BY 1, 2 HAVING COUNT(*) > 1),
repeated AS (SELECT doc_id, COUNT(DISTINCT pos) AS n
    FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS pos FROM five JOIN twice USING (doc_id, p)) GROUP BY 1),
line AS (SELECT doc_id, doc, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(regexp_replace(lower({_TRIM.format('line')}), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS norm
    FROM (SELECT doc_id, doc, host, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
same AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM line GROUP BY 1),
host AS (SELECT host, COUNT(DISTINCT doc) AS docs FROM w GROUP BY 1),
often AS (SELECT host, norm FROM line JOIN host USING (host) GROUP BY host, norm, docs
    HAVING COUNT(DISTINCT doc) > {MIN_DOCS} AND COUNT(DISTINCT doc) > docs * {{share}}),
lost AS (SELECT doc_id, COUNT(*) AS lines, SUM(n) AS words FROM line JOIN often USING (host, norm) GROUP BY 1),
counted AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    COALESCE(same.n, 0) AS n_dup_lines, COALESCE(repeated.n, 0) AS n_repeat_words,
    COALESCE(lost.lines, 0) AS n_removed_lines, CAST(COALESCE(lost.words, 0) AS BIGINT) AS n_removed_words
    FROM w LEFT JOIN same ON same.doc_id = w.doc_id LEFT JOIN repeated ON repeated.doc_id = w.doc_id
    LEFT JOIN lost ON lost.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_removed_words AS rest FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words,
    NOT base_failed AND NOT (n_removed_words > 0 AND (rest < {LEFT_WORDS} OR rest < {LEFT_SHARE} * n_words)) AS kept
FROM judged
"""

WARC = """SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first_id END AS refers_to
FROM (SELECT page_id, first_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
        strlen(payload) >= 100 AND first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id AS again
    FROM (SELECT page_id, COALESCE(html, '') AS payload, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first_id FROM pages))
"""

#: Documents that may hold a line where the limit shall be exceeded in small tables, too.
LOW_LIMIT = 5

ORACLES = {
    "op3_substring_dedup": SUBSTRINGS,
    "op4_chat": CHAT,
    "op5_decontamination": DECONTAMINATION,
    "op8_quality": QUALITY.format(share=MAX_SHARE),
    "op8_quality_any_host": QUALITY.format(share=0.0),
    "op8_quality_by_share": QUALITY.format(share=BY_SHARE),
    "op8_quality_low_limit": QUALITY.format(share=MAX_SHARE).replace(f"> {MIN_DOCS} AND", f"> {LOW_LIMIT} AND"),
    "op12_warc": WARC,
}
