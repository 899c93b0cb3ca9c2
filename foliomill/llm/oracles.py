"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LINES = r"""
lines AS (
  SELECT c.chapter_id, c.book_id, c.idx, b.host, t.line_no - 1 AS line_no, t.line,
         trim(regexp_replace(regexp_replace(lower(upper(replace(t.line, 'ß', 'ss'))), '\p{Nd}+', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS norm
  FROM chapters c JOIN books b USING (book_id),
       unnest(string_split(c.plain_text, chr(10))) WITH ORDINALITY AS t(line, line_no)
  WHERE c.plain_text IS NOT NULL AND length(regexp_replace(t.line, '\P{L}', '', 'g')) >= 10
),
repeated AS (
  SELECT host, norm FROM (SELECT DISTINCT host, norm, book_id, idx FROM lines)
  GROUP BY host, norm HAVING count(*) >= 6
)"""

_WORDS = r"regexp_extract_all(regexp_replace(lower(strip_accents(replace({}, 'ß', 'ss'))), '[\x{{0300}}-\x{{036f}}\x{{064b}}-\x{{065f}}\x{{0670}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"
_GRAMS = """
{0}_grams AS (
  SELECT DISTINCT {1}, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT {1}, {2} AS w FROM {3} WHERE text IS NOT NULL), unnest(range(1, len(w) - 8)) AS r(i) WHERE len(w) >= 10
)"""

ORACLES: dict[str, str] = {
    "p5_found": f"""WITH {_LINES}
SELECT chapter_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN repeated USING (host, norm)""",
    "p5_without_lines": f"""WITH {_LINES},
gone AS (SELECT chapter_id, line_no FROM lines JOIN repeated USING (host, norm)),
kept AS (
  SELECT c.chapter_id, string_agg(t.line, chr(10) ORDER BY t.n) FILTER (WHERE g.chapter_id IS NULL) AS plain_text, CAST(count(g.chapter_id) AS INTEGER) AS removed
  FROM chapters c, unnest(string_split(c.plain_text, chr(10))) WITH ORDINALITY AS t(line, n) LEFT JOIN gone g ON g.chapter_id = c.chapter_id AND g.line_no = t.n - 1
  WHERE c.plain_text IS NOT NULL GROUP BY c.chapter_id
)
SELECT chapter_id, coalesce(plain_text, '') AS plain_text, removed FROM kept UNION ALL SELECT chapter_id, NULL, 0 FROM chapters WHERE plain_text IS NULL""",
    "p8_found": f"""WITH {_GRAMS.format("doc", "doc_id", _WORDS.format("text"), "documents")}, {_GRAMS.format("item", "item_id", _WORDS.format("text"), "benchmark")}
SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (g)""",
}
