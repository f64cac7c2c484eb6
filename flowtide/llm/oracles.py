"""SQL (DuckDB) that gives the rows of the corpus queries which SQL can express."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str = "[\\x20\\x09-\\x0D]+") -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{pattern}'), lambda w: w <> '')"


def _shingles(words: str, width: int) -> str:
    """Distinct runs of ``width`` words of a list; all words in one run where there are fewer."""
    return (f"list_distinct(list_transform(range(1, greatest(len({words}) - {width}, 0) + 2), "
            f"lambda i: array_to_string({words}[i:least(i + {width} - 1, len({words}))], ' ')))")


OP2 = f"""
WITH lines AS (
  SELECT doc_id, i, line, {_LOWER.format(f'trim(line, {_SPACES})')} AS key FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT l.doc_id, l.i, l.line, o.owner IS NULL OR o.owner = l.doc_id AS stays
  FROM lines l LEFT JOIN owners o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP3 = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_words('text')} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_SPACES}) <> '') AS filled FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows), range(3) t(j) WHERE c > 1 GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(filled) - len(list_distinct(filled)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN repeats r ON d.doc_id = r.doc_id),
lines AS (
  SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '\\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)),
common AS (
  SELECT source, line, min(doc_id) AS first FROM lines WHERE line <> '' GROUP BY source, line
  HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) * 100 >
    (SELECT count(DISTINCT d.text) FROM docs d WHERE d.source = lines.source) * 1.0),
lost AS (
  SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN common c
  ON l.source = c.source AND l.line = c.line AND l.doc_id <> c.first GROUP BY l.doc_id),
left_over AS (
  SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         greatest(0, n_words - coalesce(l.n, 0)) AS words_left
  FROM base b LEFT JOIN lost l ON b.doc_id = l.doc_id)
SELECT *, NOT base_failed AND 100 * words_left >= 50 * n_words AS kept FROM left_over
"""

OP6 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words(_LOWER.format('text'))} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE {_shingles('w', 2)} END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(l.low, s.doc_id)) AS component_id,
       least(s.doc_id, coalesce(l.low, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN lowest l ON s.doc_id = l.a
"""

OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn><text></turn>') + 1 + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
           + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_PLAIN = _words(_LOWER.format("text"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")

OP9 = f"""
WITH items AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
item_sets AS (SELECT item_id, {_shingles('w', 5)} AS s FROM items WHERE len(w) > 0),
item_rows AS (SELECT item_id, len(s) AS n_shingles, unnest(s) AS x FROM item_sets),
docs AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
doc_sets AS (SELECT doc_id, {_shingles('w', 5)} AS s FROM docs WHERE len(w) > 0),
doc_rows AS (SELECT doc_id, unnest(s) AS x FROM doc_sets)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM doc_rows d JOIN item_rows i ON d.x = i.x GROUP BY doc_id, item_id, n_shingles
HAVING 100 * count(*) >= 80 * n_shingles
"""

_DAMAGED_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
#: CRC-32 of a short ASCII string, bit by bit.
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({_DAMAGED_KEY}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _edit(cost: str, letter: str, turn: str, after: str) -> str:
    return f"{{'cost': {cost} + {after}.cost, 'audit': '{letter}' || {after}.audit, 'text': {turn} || {after}.text}}"


def _repair_step() -> str:
    """The list of the four states' cheapest rests before a row, from that after it (``b``): nothing yet, s, u, a."""
    after, role = (3, 3, 4, 3), ("user", "user", "assistant", "user")
    kept = ({"s": 2, "u": 3}, {"u": 3}, {"a": 4}, {"u": 3})
    turn = lambda r: f"chr(10) || {r} || ':' || text"
    taken = []
    for s in range(4):
        keeps = [f"CASE WHEN NOT gone AND initial = '{i}' THEN {_edit('late', 'K', turn('role'), f'b[{t}]')} END" for i, t in kept[s].items()]
        fix = _edit("late + 1", "R", turn(f"'{role[s]}'"), f"b[{after[s]}]")
        gone = _edit("2", "D", "''", f"b[{s + 1}]")
        taken.append(f"list_min([{', '.join([gone, *keeps, f'CASE WHEN NOT gone THEN {fix} END'])}])")
    insert = lambda s, x: _edit("5", "I", f"chr(10) || '{role[s]}:'", x)
    best = [f"list_min([t[{s + 1}], {insert(s, f't[{after[s]}]')}, {insert(s, insert(after[s] - 1, f't[{after[after[s] - 1]}]'))}])"
            for s in range(4)]
    return f"SELECT key, i, [{', '.join(best)}] AS b FROM (SELECT key, i, [{', '.join(taken)}] AS t FROM step)"


OP11 = f"""
WITH RECURSIVE marked AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS time FROM marked WHERE kind <> 0)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
         rtrim(text, {_SPACES}) AS core FROM damaged),
faulty AS (
  SELECT *, CASE WHEN core = '' THEN 1 WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 2
                 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY key ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS breaks FROM ordered),
rests AS (
  SELECT key, max(i) + 1 AS i, [{{'cost': 0::BIGINT, 'audit': '', 'text': ''}},
         {{'cost': 10::BIGINT, 'audit': 'II', 'text': chr(10) || 'user:' || chr(10) || 'assistant:'}},
         {{'cost': 5::BIGINT, 'audit': 'I', 'text': chr(10) || 'assistant:'}}, {{'cost': 0::BIGINT, 'audit': '', 'text': ''}}] AS b
  FROM faulty GROUP BY key
  UNION ALL
  SELECT * FROM (
    WITH step AS (SELECT r.key, f.i, r.b, f.role, f.text, f.initial, f.fault IN (1, 2) AS gone, CASE WHEN f.fault = 3 THEN 5 ELSE 0 END AS late
                  FROM rests r JOIN faulty f ON r.key = f.key AND f.i = r.i - 1)
    {_repair_step()})),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (breaks) AS illegal
  FROM faulty GROUP BY key),
found AS (
  SELECT c.*, r.b[1].cost AS cost, r.b[1].audit AS audit, substr(r.b[1].text, 2) AS text FROM counts c JOIN rests r ON c.key = r.key AND r.i = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN found ON found.key = coalesce(e.conv_id::VARCHAR, ' ')
"""

OP12 = f"""
WITH pieces AS (
  SELECT lang, {_words('piece', '[\\x20\\x09]+')} AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
singles AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM pieces) GROUP BY lang, w1),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM singles GROUP BY lang),
pairs AS (
  SELECT lang, p.a AS w1, p.b AS w2, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM pieces WHERE len(w) > 1)
  GROUP BY ALL HAVING count(*) >= 10),
triples AS (
  SELECT lang, p.a AS w1, p.b AS w2, p.c AS w3, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}})) AS p FROM pieces WHERE len(w) > 2)
  GROUP BY ALL HAVING count(*) >= 10),
around AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM triples UNION ALL SELECT lang, w2, w3, f FROM triples) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, l.f AS l, r.f AS r, 1 AS k
  FROM pairs p JOIN singles l ON p.lang = l.lang AND p.w1 = l.w1 JOIN singles r ON p.lang = r.lang AND p.w2 = r.w1
  LEFT JOIN around o ON p.lang = o.lang AND p.w1 = o.w1 AND p.w2 = o.w2 WHERE o.f IS NULL OR 100 * o.f < 50 * p.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, l.f, r.f, 1
  FROM triples t JOIN singles l ON t.lang = l.lang AND t.w1 = l.w1 JOIN pairs r ON t.lang = r.lang AND t.w2 = r.w1 AND t.w3 = r.w2
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, l.f, r.f, 2
  FROM triples t JOIN pairs l ON t.lang = l.lang AND t.w1 = l.w1 AND t.w2 = l.w2 JOIN singles r ON t.lang = r.lang AND t.w3 = r.w1),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

OP13 = f"""
WITH texts AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN groups USING (t)
"""

ORACLES = {"op2_line_dedup": OP2, "op3_quality_rules": OP3, "op6_near_duplicates": OP6, "op7_chat_formatting": OP7,
           "op9_decontamination": OP9, "op11_turn_repair": OP11, "op12_collocations": OP12, "op13_exact_dedup": OP13}
