"""DuckDB SQL for the registered queries of this folder."""

from __future__ import annotations

from corpusfold.llm.license_scan import TEMPLATES
from corpusfold.llm.quality_rules import RULES

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_REJECTED = " UNION ALL ".join(
    f"SELECT stratum, '{r.name}' AS rule, {j} AS step, {c} AS cutoff, "
    f"sum(CASE WHEN 1000 * {r.numerator} > {c} * {r.denominator} THEN 1 ELSE 0 END) AS k, count(*) AS n FROM holdout GROUP BY stratum"
    for r in RULES for j, c in enumerate(r.cutoffs)
)
_FAILED = " OR ".join(
    f"1000 * {r.numerator} > (SELECT cutoff FROM certified c WHERE c.stratum = coalesce(lang, '') AND rule = '{r.name}') * {r.denominator}"
    for r in RULES
)
QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN repeats USING (doc_id)),
holdout AS (SELECT m.*, coalesce(lang, '') AS stratum FROM m JOIN
    (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)),
rejected AS ({_REJECTED}),
limits AS (SELECT 0.05 / {len(RULES)} AS p, 0.05 / ({len(RULES)} * greatest(1, count(DISTINCT stratum))) AS error FROM holdout),
tails AS (SELECT stratum, rule, step, cutoff, k < n * p AND
    list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) <= error AS passed
    FROM rejected, limits),
ends AS (SELECT stratum, rule, coalesce(min(CASE WHEN passed THEN NULL ELSE step END), count(*)) AS good FROM tails GROUP BY stratum, rule),
certified AS (SELECT stratum, rule, max(cutoff) FILTER (WHERE step = good - 1) AS cutoff FROM tails JOIN ends USING (stratum, rule) GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce({_FAILED.replace(" OR ", ", FALSE) AND NOT coalesce(")}, FALSE) AS kept
FROM m"""

_NORMAL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_NORMAL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(0, len(w) - least(len(w), 13) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 13)], ' '))) AS win
    FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = array_to_string(w[i + 1 : i + dw.n], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(12 + length(role) + 1 + length(body) + 11) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c"""

_PLAIN = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x20\x09-\x0D]+'), lambda w: w <> '')"
)
NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT doc_id, b FROM r JOIN e ON a = reached)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(reached) AS m FROM r GROUP BY doc_id) USING (doc_id)"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(0, len(w) - 34)) AS i,
    unnest(list_transform(range(0, len(w) - 34), lambda i: array_to_string(w[i + 1 : i + 35], ' '))) AS win FROM d WHERE len(w) >= 35),
g AS (SELECT r, i, count(*) OVER (PARTITION BY win) AS c FROM p),
x AS (SELECT DISTINCT r, unnest(range(i + 1, i + 36)) AS q FROM g WHERE c > 1),
w AS (SELECT r, generate_subscripts(w, 1) AS q, unnest(w) AS word FROM d),
k AS (SELECT w.r, count(x.q) AS gone, string_agg(word, ' ' ORDER BY w.q) FILTER (WHERE x.q IS NULL) AS kept FROM w LEFT JOIN x ON x.r = w.r AND x.q = w.q GROUP BY w.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_NORMAL} AS w FROM documents),
t AS (SELECT name, {_NORMAL} AS w FROM (VALUES {_TEMPLATES}) AS v(name, text)),
ts AS (SELECT DISTINCT name, unnest(list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS run FROM t),
tc AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE regexp_matches(run, '[0-9]')) AS numbered, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS stride FROM ts GROUP BY name),
p AS (SELECT r, unnest(range(0, len(w) - 2)) AS i, unnest(list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS run FROM d WHERE len(w) >= 3),
h AS (SELECT r, name, run, n, numbered, unnest([i // stride, i // stride - 1]) AS win FROM p JOIN ts USING (run) JOIN tc USING (name)),
m AS (SELECT DISTINCT r, name FROM (SELECT r, name, win FROM h WHERE win >= 0 GROUP BY r, name, win, n, numbered
    HAVING count(DISTINCT run) >= 0.8 * n AND count(DISTINCT run) FILTER (WHERE regexp_matches(run, '[0-9]')) = numbered)),
l AS (SELECT r, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses FROM m GROUP BY r)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN l USING (r)"""


def _crc32(bytes_: str) -> str:
    """The checksum of a list of byte values, bit by bit."""
    bits = "list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda h, b: {bits}), 4294967295)"


_UTF8 = (
    "flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] "
    "ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END))"
)
SPELLING = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc32(_UTF8.format(text="doc_id || ':' || run"))} AS h FROM g),
d AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM p),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM k x JOIN v y ON y.word = x.a || x.b
    UNION SELECT y.word, x.word, x.n FROM k x JOIN v y ON y.word = x.a || x.b),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN near END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
w AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
e AS (SELECT w.word, w.at AS root FROM w JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)"""

MIX = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) END AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, (nth - 1) % 3 AS schedule, CAST((nth - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap,
    CAST(sum(source_size) OVER (ORDER BY nth) AS BIGINT) - source_size AS start FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, nth) - cap) AS BIGINT) AS rest,
    sum(weight) OVER () - (sum(weight) OVER (ORDER BY cap / weight, nth) - weight) AS among FROM w),
v AS (SELECT cap / weight AS level, nth, rest, among FROM l WHERE weight * rest / among <= cap ORDER BY 1, 2 LIMIT 1),
t AS (SELECT l.source, source_size, schedule, start, CASE WHEN cap / weight < level OR (cap / weight = level AND l.nth < v.nth) THEN CAST(cap AS DOUBLE)
    ELSE weight * v.rest / v.among END AS target FROM l, v),
p AS (SELECT row_number() OVER o AS row, doc_id, source, size, CAST(sum(size) OVER o AS BIGINT) - size AS before FROM d
    WINDOW o AS (ORDER BY source NULLS LAST, md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING)),
u AS (SELECT row, doc_id, size, source_size, target, schedule, epoch, before - start + epoch * source_size AS place
    FROM (SELECT *, unnest([0, 1, 2]) AS epoch FROM p) p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
a AS (SELECT *, least(size, CAST(floor(target) AS BIGINT) - place) AS words, place / target * (schedule + 1.0) AS area FROM u),
b AS (SELECT *, CASE WHEN schedule = 0 THEN 0.0 + 2 * area / (0.5 + sqrt(0.25 + CAST(2.0 AS DOUBLE) * area)) WHEN schedule = 1 THEN 0.0 + 2 * area / (2.0 + sqrt(4.0 + CAST(0.0 AS DOUBLE) * area))
    WHEN area < 1.75 THEN 0.0 + 2 * area / (4.0 + sqrt(16.0 + CAST(-4.0 AS DOUBLE) * area))
    ELSE 0.5 + 2 * (area - 1.75) / (3.0 + sqrt(9.0 + CAST(-4.0 AS DOUBLE) * (area - 1.75))) END AS time FROM a WHERE words > 0),
c AS (SELECT row, words, CAST(sum(words) OVER (ORDER BY time, row, epoch ROWS UNBOUNDED PRECEDING) AS BIGINT) - words AS start FROM b),
m AS (SELECT row, CAST(sum(words) AS BIGINT) AS taken, min(start) AS first_start FROM c GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_start FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN m USING (row)"""


def _repair() -> str:
    """The cheapest edits of every state, one row of a conversation after the other; cost and letters are one string."""

    def more(path: str, cost: str, letters: str) -> str:
        return f"(printf('%09d', CAST(left({path}, 9) AS INT) + {cost}) || substr({path}, 10) || '{letters}')"

    kept, rerole = "CASE WHEN go THEN NULL WHEN fault = 't' THEN 3 ELSE 0 END", "CASE WHEN go THEN NULL WHEN fault = 't' THEN 6 ELSE 3 END"
    # states after inserts; then the edit of the row
    user = f"least(vu, {more('v0', '3', 'I')}, {more('vs', '3', 'I')}, {more('va', '3', 'I')})"
    both = f"least(va, {more('vu', '3', 'I')}, {more('v0', '6', 'II')}, {more('vs', '6', 'II')})"

    def to_user(path: str) -> str:
        return f"CASE WHEN c = 'u' THEN {more(path, kept, 'K')} END, {more(path, rerole, 'R')}"

    return rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32(_UTF8.format(text="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"))} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM r WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, fault IN ('b', 'd') AS go, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE prior IS NOT NULL AND prior || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
e AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS vs, CAST(NULL AS VARCHAR) AS vu, CAST(NULL AS VARCHAR) AS va FROM counts
    UNION ALL SELECT conv_id, i, {more('v0', '4', 'D')}, least({more('vs', '4', 'D')}, CASE WHEN c = 's' THEN {more('v0', kept, 'K')} END),
    least({more('eu', '4', 'D')}, {to_user('v0')}, {to_user('vs')}, {to_user('ea')}),
    least({more('ea', '4', 'D')}, CASE WHEN c = 'a' THEN {more('eu', kept, 'K')} END, {more('eu', rerole, 'R')})
    FROM (SELECT f.conv_id, f.i, c, go, fault, v0, vs, {user} AS eu, {both} AS ea FROM e JOIN f ON f.conv_id = e.conv_id AND f.i = e.i + 1)),
b AS (SELECT conv_id, least(v0, va, {more('vu', '3', 'I')}, {more('vs', '6', 'II')}) AS best FROM e JOIN counts USING (conv_id) WHERE i = n),
x AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM b),
y AS (SELECT conv_id, letter, j, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place
    FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS j FROM x WHERE audit <> '')
    WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
z AS (SELECT y.conv_id, j, letter, place, CASE WHEN letter = 'K' THEN role END AS kept, CASE WHEN letter = 'I' THEN '' ELSE text END AS text,
    max(CASE WHEN letter = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS head FROM y LEFT JOIN f ON f.conv_id = y.conv_id AND f.i = y.i WHERE letter <> 'D'),
t AS (SELECT conv_id, string_agg(coalesce(kept, CASE WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS repaired FROM z GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN x USING (conv_id) LEFT JOIN t USING (conv_id)"""


REPAIR = _repair()
