"""DuckDB SQL of the corpus queries that SQL can express."""

from . import licenses, warc

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def quality_select(docs: str) -> str:
    """Common table expressions ``judged(rid, doc_id, measurements, fail_bits)`` over table ``docs``."""
    return rf"""
q_base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}),
q_parts AS (
  SELECT rid, doc_id, t, {WORDS} AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM q_base),
q_windows AS (
  SELECT rid, unnest(list_transform(generate_series(1, len(w) - 2),
         lambda i: {{'p': i, 'k': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x
  FROM q_parts WHERE len(w) >= 4),
q_again AS (
  SELECT rid, x.p AS p FROM q_windows QUALIFY count(*) OVER (PARTITION BY rid, x.k) >= 2),
q_covered AS (
  SELECT rid, count(DISTINCT p + d) AS n FROM q_again, (VALUES (0), (1), (2)) AS v(d) GROUP BY rid),
q_measured AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM q_parts LEFT JOIN q_covered USING (rid)),
judged AS (
  SELECT *, CAST(
      1 * (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (10 * n_dup_lines > 5 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT
    + 32 * (10 * n_letters < 5 * word_chars)::INT + 64 * (10 * n_upper > 6 * n_letters)::INT AS BIGINT) AS fail_bits
  FROM q_measured)"""


QUALITY_SQL = f"""WITH {quality_select("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_letters, n_upper, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept
FROM judged"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sized GROUP BY source),
-- a source is full at level 2 * source_size / weight; the level that hands out 150 % is found by trying each
levels AS (
  SELECT a.source, 2.0e0 * a.source_size / a.weight AS full_at,
         (SELECT sum(least(2.0e0 * b.source_size, b.weight * 2.0e0 * a.source_size / a.weight)) FROM per b) AS handed
  FROM per a),
bound AS (
  SELECT min(full_at) AS upto FROM levels WHERE handed >= 1.5e0 * (SELECT sum(source_size) FROM per)),
level AS (
  SELECT (1.5e0 * sum(source_size)
          - coalesce(sum(2 * source_size) FILTER (2.0e0 * source_size / weight < upto), 0))
         / sum(weight) FILTER (2.0e0 * source_size / weight >= upto) AS lv
  FROM per, bound),
goal AS (
  SELECT source, source_size, least(2.0e0 * source_size, weight * lv) AS target FROM per, level),
dealt AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)
           / 281474976710656.0e0 AS draw
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       CAST(floor(rate) + (draw < rate - floor(rate))::INT AS BIGINT) AS copies,
       CAST((floor(rate) + (draw < rate - floor(rate))::INT) * size AS BIGINT) AS taken
FROM dealt"""


def license_sql() -> str:
    names = ", ".join(f"('{name}', '{text}')" for name, text in licenses.SENTENCES.items())
    steps, last = [], "l_start"
    for i, (licence, seq) in enumerate(licenses.RULES):
        want = "|" + "||".join(seq) + "|"
        steps.append(
            f"l_{i} AS (SELECT rid, doc_id, n, ids, replace(rest, '{want}', '/') AS rest,"
            f" CASE WHEN contains(rest, '{want}') AND NOT list_contains(found, '{licence}')"
            f" THEN list_append(found, '{licence}') ELSE found END AS found FROM {last})"
        )
        last = f"l_{i}"
    most = max(len(text.split()) for text in licenses.SENTENCES.values())
    return rf"""WITH l_dict(name, sentence) AS (VALUES {names}),
l_docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
-- lower case words with single spaces, L for line breaks, S for ends of sentences, V for the dot of a version
l_lines AS (
  SELECT rid, regexp_replace(regexp_replace(lower(t), '{licenses.LEADER}', '\1', 'g'), '{licenses.ITEM}', '\1S', 'g') AS t
  FROM l_docs),
l_ends AS (
  SELECT rid, replace(regexp_replace(regexp_replace(t, '\bv\.([\x20\x09-\x0D]+[0-9])', 'vV\1', 'g'),
                                     '{licenses.SENTENCE_END}', 'S', 'g'), 'V', '.') AS t
  FROM l_lines),
l_marked AS (
  SELECT rid, trim(regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9.\nS-]+', ' ', 'g'), ' ?\n[ \n]*', 'L', 'g'),
                                  '[ SL]*S[ SL]*', 'S', 'g')) AS m
  FROM l_ends),
l_blocks AS (
  SELECT rid, unnest(string_split(m, 'S')) AS block, unnest(generate_series(1, len(string_split(m, 'S')))) AS b
  FROM l_marked),
l_starts AS (
  SELECT rid, b, string_split(block, 'L') AS lines, unnest(string_split(block, 'L')) AS line,
         unnest(generate_series(1, len(string_split(block, 'L')))) AS i
  FROM l_blocks),
l_begun AS (
  SELECT rid, b, i, lines, name, sentence FROM l_starts JOIN l_dict ON starts_with(sentence, line) WHERE line <> ''),
-- the last line of a sentence that begins with line i, if its lines are all there
l_hits AS (
  SELECT rid, b, i, name, sentence,
         list_min(list_filter(generate_series(i, least(len(lines), i + {most})),
                              lambda j: array_to_string(lines[i:j], ' ') = sentence)) AS j
  FROM l_begun),
l_longest AS (
  SELECT * FROM l_hits WHERE j IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rid, b, i ORDER BY length(sentence) DESC) = 1),
l_known AS (
  SELECT rid, b * 1000000 + i AS nth, name FROM l_longest x
  WHERE NOT EXISTS (
    SELECT 1 FROM l_longest y WHERE y.rid = x.rid AND y.b = x.b AND y.i < x.i AND x.i <= y.j)),
l_ids AS (
  SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY nth) AS ids,
         string_agg('|' || name || '|', '' ORDER BY nth) AS rest
  FROM l_known GROUP BY rid),
l_start AS (
  SELECT rid, doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(rest, '') AS rest,
         CAST([] AS VARCHAR[]) AS found
  FROM l_docs LEFT JOIN l_ids USING (rid)),
{("," + chr(10)).join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_ids, array_to_string(found, ',') AS licences
FROM {last}"""


LICENSE_SQL = license_sql()

WARC_SQL = f"""
WITH w_pages AS (
  SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS hex FROM pages),
w_bits AS (
  SELECT page_id, strlen(p) AS size, hex,
         array_to_string(list_transform(generate_series(0, 31),
           lambda k: substr('{warc.BASE32}', CAST(1 + ((
             (CAST('0x' || substr(hex, 1 + 10 * CAST(k // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31)) AS INT), 1)), '')
           AS digest
  FROM w_pages),
w_first AS (SELECT *, min(page_id) OVER (PARTITION BY hex, size) AS first FROM w_bits)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM w_first"""

NEAR_SQL = r"""
WITH RECURSIVE n_words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
n_sets AS (
  SELECT rid, doc_id,
         CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(generate_series(1, len(w) - 3),
                   lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM n_words),
n_each AS (SELECT rid, len(s) AS n, unnest(s) AS shingle FROM n_sets),
n_pairs AS (
  SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM n_each a JOIN n_each b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY a.rid, b.rid),
n_links AS (SELECT x, y FROM n_pairs WHERE 100 * common >= 80 * (na + nb - common)),
n_reach AS (
  SELECT rid AS x, rid AS y FROM n_sets
  UNION
  SELECT n_reach.x, n_links.y FROM n_reach JOIN n_links ON n_reach.y = n_links.x),
n_least AS (
  SELECT n_reach.x AS rid, min(doc_id) AS component_id FROM n_reach JOIN n_sets ON n_reach.y = n_sets.rid GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n_sets JOIN n_least USING (rid)"""


TRIE_SQL = """
WITH t_turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
t_convs AS (
  SELECT c, c - c % 5 AS base, count(*) AS n,
         -- crc32 of the decimal id, bit by bit
         CAST(xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda crc, x: list_reduce(generate_series(1, 8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384),
                                      xor(crc, CAST(x AS BIGINT))), 4294967295), 4294967295) % 9 AS BIGINT) AS h
  FROM t_turns GROUP BY c),
t_taken AS (
  SELECT a.c, a.base, CASE WHEN a.c = a.base THEN 0 ELSE a.h END AS skip,
         CASE WHEN a.c = a.base THEN 0 ELSE least(a.h, coalesce(b.n, 0)) END AS k
  FROM t_convs a LEFT JOIN t_convs b ON b.c = a.base),
t_rebuilt AS (
  SELECT c, pos - skip + k + 1 AS d, role, text FROM t_turns JOIN t_taken USING (c) WHERE pos >= skip
  UNION ALL
  SELECT x.c, pos + 1, role, text FROM t_taken x JOIN t_turns t ON t.c = x.base AND t.pos < x.k),
-- a prefix as one text: each turn with the lengths of its parts
t_prefixes AS (
  SELECT c, d, strlen(text) AS size,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d) AS p
  FROM t_rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM t_convs),
t_last AS (SELECT c, max(d) AS d FROM t_prefixes GROUP BY c),
t_ends AS (
  SELECT p, string_agg(c, ',' ORDER BY c) AS ids FROM t_prefixes JOIN t_last USING (c, d) GROUP BY p),
t_above AS (
  SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up FROM t_prefixes),
t_nodes AS (
  SELECT p, any_value(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(size) AS size FROM t_above GROUP BY p),
t_children AS (SELECT up AS p, count(*) AS n_children FROM t_nodes WHERE d > 0 GROUP BY up),
t_all AS (
  SELECT t_nodes.*, coalesce(n_children, 0) AS n_children FROM t_nodes LEFT JOIN t_children USING (p)),
t_subtrees AS (
  SELECT a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.size) AS saved
  FROM t_all a JOIN t_all b ON b.d >= a.d AND starts_with(b.p, a.p) GROUP BY a.p)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, y.c AS parent_conv_id, x.n AS n_convs,
       CAST(x.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM t_all x JOIN t_subtrees USING (p) LEFT JOIN t_ends USING (p) LEFT JOIN t_nodes y ON y.p = x.up"""


RANK_SQL = r"""
WITH r_docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
r_size AS (SELECT rid, doc_id, len(w) AS n FROM r_docs WHERE len(w) > 0),
r_all AS (SELECT count(*) AS nn, CAST(coalesce(sum(n), 0) AS BIGINT) AS ll FROM r_size),
r_terms AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM r_docs) GROUP BY rid, term),
r_df AS (SELECT term, count(*) AS df FROM r_terms GROUP BY term),
r_items AS (
  SELECT iid, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS iid, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY iid, item_id, term),
r_scores AS (
  SELECT iid, item_id, doc_id, rid,
         CAST(sum(times * CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM r_items JOIN r_terms USING (term) JOIN r_df USING (term) JOIN r_size USING (rid), r_all
  GROUP BY iid, item_id, doc_id, rid),
r_ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM r_scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r_ranked WHERE rank <= 10"""
