"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_ESCAPED_LENGTH = r"""length({0}) + length({0}) - length(replace({0}, '\', ''))
  + list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2) || [0]) + len(regexp_extract_all({0}, '</turn>'))"""

SQL["op4_chat"] = rf"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
  t AS (SELECT *, length('### ') + {_ESCAPED_LENGTH.format("role")} + length(role) - length(replace(role, ':', '')) + length(': ')
    + {_ESCAPED_LENGTH.format("text")} + length('</turn>') + 1 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

# Every window of at least 50 words, from a line on or up to it, that stands earlier already marks its lines; runs are what they cover.
SQL["op6_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  every AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
  worded AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  placed AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM worded),
  win AS (SELECT doc_id, pos, max(pos) OVER w AS stop, sum(words) OVER w AS n, md5(string_agg(line, chr(10)) OVER w) AS content
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION SELECT doc_id, min(pos) OVER w, pos, sum(words) OVER w, md5(string_agg(line, chr(10)) OVER w)
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY before + words RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS k FROM win WHERE n >= 50),
  longest AS (SELECT doc_id, pos, max(stop) AS stop FROM ranked WHERE k > 1 GROUP BY ALL),
  later AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM longest),
  numbered AS (SELECT *, sum((reached IS NULL OR pos > reached + 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM later),
  runs AS (SELECT doc_id, run, min(pos) AS head, max(stop) AS tail FROM numbered GROUP BY ALL),
  kept AS (SELECT every.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM every
    WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = every.doc_id AND pos BETWEEN head AND tail) GROUP BY ALL),
  lost AS (SELECT doc_id, count(*) AS n_runs, sum(tail - head + 1) AS lines_lost FROM runs GROUP BY ALL),
  counted AS (SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(lines_lost, 0) AS lines_lost, d.text,
    CASE WHEN n_runs IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS left_text
    FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id))
SELECT doc_id, CAST(n_runs AS BIGINT) AS n_runs, CAST(lines_lost AS BIGINT) AS lines_lost,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) - len(regexp_extract_all(coalesce(left_text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words_lost,
  md5(left_text) AS kept_md5
FROM counted"""

SQL["op7_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
  win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  hits AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
  covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id),
  m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(text, '\p{{Lu}}')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_twice
    FROM d LEFT JOIN covered USING (doc_id)),
  b AS (SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, 10 * n_symbols > n_words AS r2,
    10 * n_dup_lines > 6 * n_lines AS r3, 100 * n_capitals > 40 * word_chars AS r4,
    word_chars < 2 * n_words OR word_chars > 20 * n_words AS r5, 100 * n_twice > 20 * n_words AS r6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_twice,
  CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT AS BIGINT) AS failed,
  r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept
FROM b"""

# The mix as common table expressions over a table ``docs_in``: ``mix`` has every row with its copies.
# Sources in order of cap by weight are held at their caps as long as the water stands above.
MIX = rf"""sized AS (SELECT *, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR), md5(text))) AS key FROM docs_in),
  by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM sized GROUP BY source),
  filling AS (SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM by_source),
  level AS (SELECT coalesce(sum(cap) FILTER (cap * weights <= weight * (total - held)), 0) AS held,
    sum(weight) FILTER (NOT cap * weights <= weight * (total - held)) AS weights, any_value(total) AS total FROM filling),
  targets AS (SELECT source, source_size, least(cap, weight * CAST(level.total - level.held AS DOUBLE) / level.weights)::DOUBLE AS target
    FROM filling, level),
  planned AS (SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
  ends AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS mine_end,
    sum(size) OVER (PARTITION BY source, key) AS mine FROM planned),
  mix AS (SELECT * EXCLUDE (key, whole, mine_end, mine), CAST(whole + (mine_end - mine / 2 <= target - whole * source_size AND target - whole * source_size > 0)::INT AS BIGINT) AS copies FROM ends)"""

SQL["op10_mixing"] = f"""
WITH docs_in AS (SELECT * FROM documents), {MIX}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mix"""

SQL["op11_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s USING (anchor_id) WHERE k <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

# The CRC-32 of a text byte by byte, with its table made from the polynomial. Near words share a text with a code
# point taken out of one or of both at the same place.
SQL["op13_spelling"] = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) AS t(i) UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
  crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  often AS (SELECT doc_id, run, count(*) AS m FROM runs WHERE length(run) >= 7 GROUP BY ALL),
  said AS (SELECT run, m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM often),
  hashed AS (SELECT run, m, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM said, crc),
  cut AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, m FROM hashed),
  words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
  less AS (SELECT word, unnest(range(length(word))) AS i FROM words),
  short AS (SELECT word, i, word[1:i] || word[i + 2:] AS rest FROM less),
  pairs AS (SELECT a.word, b.word AS near FROM short AS a JOIN short AS b USING (rest, i) WHERE a.word <> b.word
    UNION SELECT word, rest FROM short WHERE rest IN (SELECT word FROM words)
    UNION SELECT rest, word FROM short WHERE rest IN (SELECT word FROM words)),
  ranked AS (SELECT pairs.word, near, w.n AS near_n, row_number() OVER (PARTITION BY pairs.word ORDER BY w.n DESC, near) AS k,
    count(*) OVER (PARTITION BY pairs.word) AS n_near FROM pairs JOIN words AS w ON near = w.word),
  forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM words LEFT JOIN ranked ON words.word = ranked.word AND k = 1),
  led AS (SELECT word, word AS root FROM forms UNION ALL SELECT led.word, forms.form FROM led JOIN forms ON led.root = forms.word WHERE forms.form IS NOT NULL),
  roots AS (SELECT led.word, root FROM led JOIN forms ON led.root = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)"""
