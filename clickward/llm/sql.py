"""DuckDB statements for the rows of the corpus queries."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.top, FALSE) AS gone
  FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUFFIX_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, c, h[2000 * c + 1 : 2000 * c + 2098] AS p
  FROM (SELECT doc_id, h, unnest(range((length(h) + 1999) // 2000)) AS c FROM texts)
), strings AS (
  SELECT doc_id, 1000 * c + j AS i, p[2 * j + 1 : 2 * j + 100] AS s
  FROM (SELECT doc_id, c, p, unnest(range(greatest(0, least(1000, length(p) // 2 - 49)))) AS j FROM pieces)
), least AS (
  SELECT s, min(doc_id) AS low FROM strings GROUP BY s
), gone AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM strings JOIN least USING (s) WHERE low < doc_id
), numbered AS (
  SELECT doc_id, i, count(*) FILTER (WHERE before IS NULL OR i > before + 50)
    OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM gone
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(h[2 * before + 1 : 2 * a], '' ORDER BY a) AS head
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), members AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT r.doc_id, l.o FROM reach r JOIN (SELECT x AS e, y AS o FROM links UNION ALL SELECT y, x FROM links) l ON l.e = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN sizes USING (doc_id)
"""


def _vector_round(k: int) -> str:
    """Assignment k and the codebooks that follow from it."""
    return f"""
near{k} AS (
  SELECT row, p, any_value(x) AS x, min(64 * dist + e) % 64 AS e, min(64 * dist + e) // 64 AS dist FROM (
    SELECT r.row, r.p, r.x, c.e, list_sum(list_transform(list_zip(r.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
    FROM parts r JOIN book{k} c USING (p)) GROUP BY row, p
), mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m
    FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e
), book{k + 1} AS (
  SELECT p, e, coalesce(m.x, c.x) AS x FROM book{k} c LEFT JOIN mean{k} m USING (p, e)
), """


VECTOR_CODES = (
    """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT row, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)
), book0 AS (
  SELECT p, row - 1 AS e, x FROM parts WHERE row <= 64
), """
    + _vector_round(0)
    + _vector_round(1)
    + """
last AS (
  SELECT row, p, min(64 * dist + e) % 64 AS e, min(64 * dist + e) // 64 AS dist FROM (
    SELECT r.row, r.p, c.e, list_sum(list_transform(list_zip(r.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
    FROM parts r JOIN book2 c USING (p)) GROUP BY row, p
), codes AS (
  SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM last GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i))
   FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM book2)) AS codebooks_sha256
FROM kept JOIN codes USING (row)
"""
)

SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS t(i))
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs), crc_table
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN crc % 199 = 0 THEN run[1 : crc % length(run)] || run[crc % length(run) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), less AS (
  SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(root, depth) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM forms f
"""


def _signatures(text: str) -> str:
    """Sorted distinct signatures of a text column, as a list."""
    return f"""
  SELECT * EXCLUDE (words, content, common), list_sort(list_distinct(list_concat(
    list_transform(list_filter(content, lambda x: x IS NOT NULL)[1 : 8], lambda w: md5(w)[1 : 8]),
    list_filter(list_transform(words, lambda w, i:
    CASE WHEN content[i] IS NULL OR len(list_filter(content[greatest(i - 8, 1) : i - 1], lambda x: x IS NULL)) = 0
    THEN md5(array_to_string(list_prepend(w, list_filter(content[i + 1 : i + 8], lambda x: x IS NOT NULL)[1 : 2]), ' '))[1 : 8] END),
    lambda x: x IS NOT NULL)))) AS {text}_sigs
  FROM (SELECT *, list_transform(words, lambda w: CASE WHEN NOT list_contains(common, w) THEN w END) AS content
    FROM (SELECT *, regexp_extract_all(lower({text}), '[^\\x00-/:-@\\[-`{{-\\x7F]+') AS words FROM source), anchors)"""


def fingerprints(common: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in common)
    like = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
    return f"""
WITH anchors AS (SELECT [{words}] AS common
), plain AS (WITH source AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) {_signatures("text")}
), next AS (
  SELECT *, length(text) // 4 AS take,
    coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(text_sigs) OVER o, first_value(text_sigs) OVER o) AS next_sigs,
    coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_doc_id
  FROM plain WINDOW o AS (ORDER BY doc_id)
), edits AS (WITH source AS (SELECT *, text[1 : length(text) - take] || next_text[1 : take] AS edited FROM next) {_signatures("edited")}
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(text_sigs, '') AS fingerprint,
  array_to_string(edited_sigs, '') AS edited_fingerprint, {like.format("text_sigs", "edited_sigs")} AS near_edited,
  {like.format("text_sigs", "next_sigs")} AS near_next, next_doc_id, CAST(len(text_sigs) AS BIGINT) AS n_signatures,
  CAST(CASE WHEN len(text_sigs) > 0 THEN floor(ln(len(text_sigs)) / (ln(1 / 0.75) * (1 + 1e-9))) ELSE -1 END AS INTEGER) AS length_part
FROM edits
"""
