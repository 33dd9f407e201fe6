"""SQL for the queries of this subpackage that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"


def _level(depth: int, before: str) -> str:
    """Deals each node's budget to its children at `depth`; see mixing.budgets."""
    levels = ["domain", "lang", "source"]
    path, parent = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth]) or "1"
    name = levels[depth]
    return f"""
n{depth} AS (SELECT {path}, CAST(sum(cap) AS BIGINT) AS node_cap, min(budget) AS given, min(w{depth}) AS w FROM {before} GROUP BY {path}),
o{depth} AS (SELECT *, CASE WHEN w > 0 THEN node_cap / w ELSE 'infinity'::DOUBLE END AS ratio FROM n{depth}),
r{depth} AS (SELECT *, row_number() OVER o AS rn,
  CAST(coalesce(sum(node_cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
  sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM o{depth} WINDOW o AS (PARTITION BY {parent} ORDER BY ratio, {name})),
f{depth} AS (SELECT *, min(CASE WHEN NOT (w > 0 AND node_cap * w_left <= (given - cap_before) * w) THEN rn END) OVER (PARTITION BY {parent}) AS cut FROM r{depth}),
c{depth} AS (SELECT *, max(CASE WHEN rn = cut THEN given - cap_before END) OVER (PARTITION BY {parent}) AS cut_left,
  max(CASE WHEN rn = cut THEN w_left END) OVER (PARTITION BY {parent}) AS cut_w FROM f{depth}),
x{depth} AS (SELECT *, CASE WHEN rn >= cut AND w > 0 THEN cut_left * w / cut_w END AS exact FROM c{depth}),
s{depth} AS (SELECT *, cut_left - sum(CAST(floor(exact) AS BIGINT)) OVER (PARTITION BY {parent}) AS over,
  row_number() OVER (PARTITION BY {parent} ORDER BY exact IS NULL, exact - floor(exact) DESC, {name}) AS place FROM x{depth}),
b{depth} AS (SELECT l.* EXCLUDE (budget), CAST(CASE WHEN s.cut IS NULL OR s.rn < s.cut THEN s.node_cap
  WHEN s.w > 0 THEN floor(s.exact) + CASE WHEN s.place <= s.over THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS budget
  FROM {before} l JOIN s{depth} s USING ({path}))"""


def op3(weights: tuple[tuple[int, str, float], ...]) -> str:
    rows = ", ".join(f"({level}, '{name}', {weight}::DOUBLE)" for level, name, weight in weights)
    return f"""
WITH weights(level, name, weight) AS (VALUES {rows}),
docs AS (SELECT doc_id, 'd' || CAST(CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS INTEGER) % 4 AS VARCHAR) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS tokens FROM documents),
sums AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL),
named AS (SELECT s.*, coalesce(d.weight, 1.0::DOUBLE) AS w0, coalesce(l.weight, 1.0::DOUBLE) AS w1, coalesce(o.weight, 1.0::DOUBLE) AS w2 FROM sums s
  LEFT JOIN weights d ON d.level = 0 AND d.name = domain LEFT JOIN weights l ON l.level = 1 AND l.name = lang LEFT JOIN weights o ON o.level = 2 AND o.name = source),
leaves AS (SELECT *, CASE WHEN w0 > 0 AND w1 > 0 AND w2 > 0 THEN 2 * tokens ELSE 0 END AS cap FROM named),
start AS (SELECT *, least((SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaves), (SELECT CAST(sum(cap) AS BIGINT) FROM leaves)) AS budget FROM leaves),
{_level(0, "start")},
{_level(1, "b0")},
{_level(2, "b1")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
  budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS remain, tokens AS leaf_tokens FROM b2),
placed AS (SELECT d.*, p.whole, p.remain, p.leaf_tokens, md5('7:' || CAST(p.whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS rank
  FROM docs d JOIN plan p USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY rank) AS upto FROM placed),
taken AS (SELECT *, whole + CASE WHEN leaf_tokens > 0 AND upto <= remain THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(times)) AS INTEGER) AS epoch FROM taken
"""


OP5 = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, {_SPACES}) AS line FROM lines),
w AS (SELECT *, row_number() OVER o - 1 AS k, sum(n) OVER o AS c, sum(n) OVER o - n AS d
  FROM (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS n FROM t WHERE line <> '') WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
wins AS (SELECT p.doc_id, p.k AS spot, min(j.k) - p.k + 1 AS size FROM w p JOIN w j ON j.doc_id = p.doc_id AND j.k >= p.k AND j.c - p.d >= 50 GROUP BY p.doc_id, p.k
  UNION SELECT e.doc_id, max(s.k) AS spot, e.k - max(s.k) + 1 FROM w e JOIN w s ON s.doc_id = e.doc_id AND s.k <= e.k AND e.c - s.d >= 50 GROUP BY e.doc_id, e.k),
arrs AS (SELECT doc_id, list(line ORDER BY k) AS arr FROM w GROUP BY doc_id),
keyed AS (SELECT wins.*, array_to_string(list_slice(arr, spot + 1, spot + size), chr(10)) AS key FROM wins JOIN arrs USING (doc_id)),
firsts AS (SELECT *, min(struct_pack(d := doc_id, s := spot)) OVER (PARTITION BY key) AS first FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(spot, spot + size)) AS k FROM firsts WHERE doc_id <> first.d OR spot >= first.s + size),
marked AS (SELECT t.doc_id, t.no, t.raw, w.k, gone.k AS lost FROM t LEFT JOIN w USING (doc_id, no) LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.k = w.k),
done AS (SELECT doc_id, count(k) AS n_lines, count(lost) AS n_removed, coalesce(string_agg(CASE WHEN lost IS NULL THEN raw END, chr(10) ORDER BY no), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE done.text END AS text
FROM documents d LEFT JOIN done USING (doc_id)
"""


def _classes() -> str:
    from .quality import CLASSES

    steps, before = [], "text"
    for i, (_, pattern) in enumerate(CLASSES):
        quoted = pattern.replace("'", "''")
        steps.append(f"s{i} AS (SELECT *, regexp_replace({before}, '{quoted}', '', 'g') AS r{i} FROM {f's{i - 1}' if i else 'docs'})")
        before = f"r{i}"
    names = ["text", *(f"r{i}" for i in range(len(CLASSES)))]
    counts = ", ".join(f"len({a}) - len({b})" for a, b in zip(names, names[1:], strict=False))
    return ",\n".join(steps) + f",\ncl AS (SELECT *, [{counts}, len({before})] AS classes FROM s{len(CLASSES) - 1})"


def op10(max_class: float, max_word: float) -> str:
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    js = f"0.5 * ({part.format('p', 'q')}) + 0.5 * ({part.format('q', 'p')})"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
{_classes()},
words AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM grams),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS j) WHERE times > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs JOIN words USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
tokens AS (SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS word FROM docs) WHERE word <> ''),
totals AS (SELECT lang, count(*) AS n_tokens FROM tokens GROUP BY lang),
best AS (SELECT lang, word, n / n_tokens AS q FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM tokens GROUP BY lang, word) JOIN totals USING (lang) WHERE k <= 30),
sizes AS (SELECT doc_id, lang, count(*) AS n FROM tokens GROUP BY ALL),
hist AS (SELECT doc_id, word, count(*) AS n FROM tokens SEMI JOIN best USING (lang, word) GROUP BY ALL),
pairs AS (SELECT s.doc_id, coalesce(h.n, 0) / s.n AS p, b.q AS q FROM sizes s JOIN best b USING (lang) LEFT JOIN hist h ON h.doc_id = s.doc_id AND h.word = b.word
  UNION ALL SELECT s.doc_id, 1.0 - coalesce(x.n, 0) / s.n, greatest(0.0, 1.0 - y.q) FROM sizes s LEFT JOIN (SELECT doc_id, sum(n) AS n FROM hist GROUP BY ALL) x USING (doc_id) JOIN (SELECT lang, sum(q) AS q FROM best GROUP BY ALL) y USING (lang)),
word_js AS (SELECT doc_id, sqrt(greatest(0.0, sum({js}))) AS d FROM pairs GROUP BY doc_id),
cells AS (SELECT doc_id, lang, unnest(classes) AS c, generate_subscripts(classes, 1) AS i, list_sum(classes) AS chars FROM cl),
refs AS (SELECT lang, i, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM cells GROUP BY lang, i),
class_js AS (SELECT doc_id, chars, sqrt(greatest(0.0, sum({js}))) AS d FROM (SELECT doc_id, chars, c / chars AS p, q FROM cells JOIN refs USING (lang, i) WHERE chars > 0) GROUP BY ALL),
verdict AS (SELECT b.*, b.n_words < 50 OR 100 * b.n_repeat_words > 50 * b.n_words AS base_failed,
  coalesce(t.n_tokens >= 1000 AND s.n >= 40 AND w.d > {max_word}, false) AS far_words,
  coalesce(t.n_tokens >= 1000 AND c.chars >= 200 AND c.d > {max_class}, false) AS far_classes
  FROM base b JOIN docs USING (doc_id) LEFT JOIN totals t USING (lang) LEFT JOIN sizes s ON s.doc_id = b.doc_id LEFT JOIN word_js w ON w.doc_id = b.doc_id LEFT JOIN class_js c ON c.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR far_words OR far_classes) AS kept FROM verdict
"""


OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS lo,
  greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS hi FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:lo], ''), '') AS a, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS b, coalesce(array_to_string(units[hi + 1:n], ''), '') AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
    WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE t END AS output FROM p),
q AS (SELECT *, string_split_regex(output, '<[PSM]>') AS x FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'psm' THEN x[2] || x[4] || x[3] WHEN 'spm' THEN x[3] || x[4] || x[2] ELSE output END) AS restored_sha256 FROM q
"""


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {
  'A': len(w) < 200,
  'B': 100 * len(list_distinct(w)) < 50 * len(w),
  'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'),
  'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS fails FROM d LEFT JOIN l USING (doc_id)),
failed AS (SELECT *, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END)
  || (CASE WHEN fails.D THEN 'D' ELSE '' END) || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS set FROM f),
sets AS (SELECT part, set, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (SELECT s.*, set, part, n, good, bad, contains(set, own) AS here, len(translate(set, before, '')) < len(set) AS gone FROM steps s, sets),
sums AS (SELECT part, filter_order, step, own,
  CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (set = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
"""


def op13(templates: list[tuple], gram: int, similarity: float) -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, {size}, {slack}, {votes}, {quoted(words)})" for i, label, base, size, slack, votes, words in templates)
    return rf"""
WITH templates(template, label, base, size, slack, votes, words) AS (VALUES {rows}),
tg AS (SELECT template, slack, spot - 1 AS spot, words[spot:spot + {gram - 1}] AS g FROM (SELECT *, unnest(range(1, size - {gram} + 2)) AS spot FROM templates)),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, pos - 1 AS pos, w[pos:pos + {gram - 1}] AS g FROM (SELECT *, unnest(range(1, len(w) - {gram} + 2)) AS pos FROM docs)),
hits AS (SELECT doc_id, template, slack, spot, pos, pos - spot AS diagonal FROM dg JOIN tg USING (g)),
diagonals AS (SELECT doc_id, template, slack, diagonal, count(*) AS n FROM hits GROUP BY ALL),
apart AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > slack, true) AS apart FROM diagonals),
bands AS (SELECT *, max(CASE WHEN apart THEN diagonal END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM apart),
kept AS (SELECT doc_id, template, band FROM bands JOIN templates USING (template) GROUP BY doc_id, template, band, votes HAVING sum(n) >= votes),
found AS (SELECT h.doc_id, h.template, b.band, unnest(range(h.spot, h.spot + {gram})) AS word, h.pos FROM hits h JOIN bands b USING (doc_id, template, diagonal) JOIN kept k ON k.doc_id = h.doc_id AND k.template = h.template AND k.band = b.band),
sums AS (SELECT doc_id, template, band, count(DISTINCT word) AS covered, min(pos) AS start, max(pos) + {gram} AS stop FROM found GROUP BY ALL),
spans AS (SELECT doc_id, label, base, start, CAST(covered AS DOUBLE) / greatest(size, stop - start) AS score FROM sums JOIN templates USING (template)),
good AS (SELECT * FROM spans WHERE score >= CASE WHEN base THEN 1.0 ELSE {similarity} END),
told AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM good GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN told USING (doc_id)
"""
