"""The subpackage's queries, by name, and their SQL."""

from __future__ import annotations

from docframe.llm.bpe_chunks import op9_bpe
from docframe.llm.chat_formatting import op4_chat_formatting
from docframe.llm.fingerprints import op8_fingerprints
from docframe.llm.language_id import op10_language_id
from docframe.llm.ngram_join import op6_ngram_join
from docframe.llm.packing import op5_packing
from docframe.llm.quality_classifier import op3_quality_classifier
from docframe.llm.quality_rules import BOILERPLATE, op1_quality_rules
from docframe.llm.sharding import op7_sharding
from docframe.llm.token_counts import op2_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_packing": op5_packing,
    "op6_ngram_join": op6_ngram_join,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
}

_PHRASES = "|".join(BOILERPLATE)

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM
      (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
      GROUP BY doc_id),
l AS (SELECT doc_id, line, len(list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n,
             length(regexp_replace(line, '[ \t\n\x0B\f\r]+', '', 'g')) AS chars, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS bare
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
b AS (SELECT *, chars > 0 AND (
        length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.25 * n
        OR (length(regexp_replace(line, '[^!]', '', 'g')) >= 3 AND length(regexp_replace(line, '[^!]', '', 'g')) > 0.5 * n)
        OR (n >= 60 AND NOT regexp_matches(line, '[.!?:;…。]'))
        OR length(regexp_replace(line, '[^|›•]', '', 'g')) >= 3
        OR (length(bare) >= 12 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
        OR (n <= 20 AND regexp_matches(line, '(?i){_PHRASES}'))) AS bad FROM l),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad, sum(chars) FILTER (WHERE NOT bad) AS good,
             count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dups FROM b GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dups AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             n_lines, n_bad, coalesce(good, 0) AS good FROM w JOIN s USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND good / word_chars >= 0.5 AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bad AS BIGINT) AS n_bad_lines,
       CASE WHEN word_chars > 0 THEN round(good / word_chars, 6) ELSE 0.0 END AS retention FROM x""",
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], chr(1)) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b, common = x.n AND common = y.n AS equal FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, k.b FROM c JOIN k ON k.a = c.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.component AS BIGINT) AS component_id,
       CAST(least(d.doc_id, coalesce(e.first, d.doc_id)) AS BIGINT) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component FROM c GROUP BY doc_id) m USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS first FROM k WHERE equal GROUP BY a) e USING (doc_id)""",
}
