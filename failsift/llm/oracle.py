"""SQL for the queries of this subpackage that SQL can express."""

from failsift.llm.licenses import TEMPLATES, THRESHOLD, template_bigrams
from failsift.llm.mixing import SEED

# CRC-32 for the decimal or UTF-8 form of a value: join ``crc_table``, then ``_crc(value)``.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def _crc(value: str) -> str:
    octets = f"list_transform(range(strlen({value})), lambda k: ('0x' || substr(hex(encode({value})), 2 * k + 1, 2))::BIGINT)"
    step = "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), {step}), 4294967295)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({_quoted(name)}, [{', '.join(map(_quoted, template_bigrams(text)))}])" for name, text in sorted(TEMPLATES.items())
)

OP2 = rf"""
WITH template(licence, grams) AS (VALUES {_TEMPLATES}),
line AS (SELECT doc_id, text, unnest(CASE WHEN contains(text, chr(10))
           THEN list_concat(string_split(text, chr(10)), [text]) ELSE [text] END) AS unit FROM documents),
word AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '),
           lambda x: x <> '') AS w FROM line),
gram AS (SELECT doc_id, row_number() OVER () AS unit_no,
           list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
         FROM word WHERE len(w) >= 2),
score AS (SELECT doc_id, unit_no, licence,
            len(list_intersect(g, grams)) * 2.0::DOUBLE / (len(g) + len(grams)) AS score FROM gram, template),
best AS (SELECT doc_id, unit_no, max(score) AS score, min(licence) AS licence
         FROM (SELECT *, max(score) OVER (PARTITION BY unit_no) AS top FROM score)
         WHERE score = top AND score >= {THRESHOLD} GROUP BY doc_id, unit_no),
doc AS (SELECT doc_id, max(score) AS score, arg_max(licence, (score, -ascii(licence))) AS licence_,
          count(*) AS matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
        FROM best GROUP BY doc_id),
lead_ AS (SELECT b.doc_id, min(b.licence) AS licence FROM best b JOIN doc d
          ON b.doc_id = d.doc_id AND b.score = d.score GROUP BY b.doc_id)
SELECT documents.doc_id, lead_.licence, coalesce(doc.score, 0.0::DOUBLE) AS score, coalesce(doc.matches, 0)::INT AS matches,
       coalesce(doc.licences, '') AS licences
FROM documents LEFT JOIN doc USING (doc_id) LEFT JOIN lead_ USING (doc_id)
"""

OP8 = r"""
WITH turn_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
    4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2
      + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g')) + 8 AS piece
  FROM turn_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR place = turns))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP9 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / coalesce(0.25 + 0.75 * (length(regexp_replace(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'), '\P{{L}}+', '', 'g'))::DOUBLE
        / greatest(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 1)), 0.25) AS sort_key
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS reach,
    (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per_source WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST)),
plan_ AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(w * max(level) FILTER (level <= reach) OVER (), cap::DOUBLE)) AS target FROM levels),
budgeted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM plan_),
summed AS (
  SELECT s.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.sort_key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM sized s JOIN budgeted b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + (budget > 0 AND prefix + size / 2.0 <= budget)::INT))::BIGINT AS taken
FROM summed
"""

OP6 = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM page),
kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response
         FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to, true AS valid
FROM kept
"""

OP13 = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
place AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM place),
repeated AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM win WHERE g IN (SELECT g FROM repeated)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words
         FROM (SELECT * FROM word ANTI JOIN gone USING (r, i)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(words, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""

OP12 = f"""
WITH {_CRC_TABLE},
turn_ AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id::VARCHAR")} % 6 AS h, n
  FROM (SELECT conv_id, count(*) AS n FROM turn_ GROUP BY conv_id), crc_table),
size_ AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM conv c LEFT JOIN conv b ON c.base = b.conv_id),
rebuilt AS (
  SELECT s.conv_id, t.place, t.role, t.text FROM size_ s JOIN turn_ t ON t.conv_id = s.base AND t.place <= s.taken
  UNION ALL SELECT s.conv_id, t.place - s.h + s.taken, t.role, t.text FROM size_ s JOIN turn_ t ON t.conv_id = s.conv_id AND t.place > s.h),
path AS (SELECT conv_id, place AS depth, length(text) AS chars,
    list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY place) AS turns FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM conv),
step AS (SELECT conv_id, depth, chars, md5(turns::VARCHAR) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM path),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM step),
node_ AS (SELECT depth, node, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM up GROUP BY depth, node),
child AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM node_ WHERE depth > 0 GROUP BY ALL),
pair AS (SELECT DISTINCT a.depth, a.node, b.depth AS low_depth, b.node AS low FROM up a JOIN up b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
below AS (SELECT p.depth, p.node, sum((b.n_convs - 1) * b.chars) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM pair p JOIN node_ b ON b.depth = p.low_depth AND b.node = p.low LEFT JOIN child c ON c.depth = p.low_depth AND c.node = p.low
  GROUP BY p.depth, p.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
  b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node_ n JOIN below b USING (depth, node) LEFT JOIN child c USING (depth, node)
  LEFT JOIN node_ u ON u.depth = n.depth - 1 AND u.node = n.parent
"""

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
run_ AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
seen AS (SELECT id, run, count(*) AS n FROM run_ WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("(id || ':' || run)")} AS h FROM seen, crc_table),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
word_ AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word_),
rest AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_ FROM place),
pair AS (SELECT a.word, b.word AS near FROM rest a JOIN rest b ON a.left_ = b.left_ AND a.i = b.i AND a.word <> b.word
  UNION SELECT r.word, w.word FROM rest r JOIN word_ w ON r.left_ = w.word
  UNION SELECT w.word, r.word FROM rest r JOIN word_ w ON r.left_ = w.word),
best AS (SELECT p.word, count(*) AS n_near, max(w.n) AS near_n FROM pair p JOIN word_ w ON p.near = w.word GROUP BY p.word),
form_ AS (SELECT b.word, b.near_n, min(p.near) AS form FROM best b JOIN word_ own ON own.word = b.word JOIN pair p ON p.word = b.word
  JOIN word_ w ON w.word = p.near AND w.n = b.near_n WHERE b.near_n >= 5 * own.n GROUP BY b.word, b.near_n),
chain AS (SELECT word, form AS at_ FROM form_ UNION ALL SELECT c.word, f.form FROM chain c JOIN form_ f ON c.at_ = f.word),
end_ AS (SELECT word, at_ AS root FROM chain WHERE at_ NOT IN (SELECT word FROM form_))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.near_n AS form_n
FROM word_ w LEFT JOIN best b USING (word) LEFT JOIN form_ f USING (word) LEFT JOIN end_ e USING (word)
"""
