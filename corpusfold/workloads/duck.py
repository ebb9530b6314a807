"""The same corpora and operators as SQL text for the check engine, written independently of Spark."""

from __future__ import annotations

from corpusfold.functions import langs
from corpusfold.workloads import corpora

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"
LED = r"[ \t\n\r\f\x0B]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B])"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN}'))"


def short(x: str, limit: int = 80) -> str:
    """A text cut to the token limit with an ellipsis."""
    found = f"regexp_extract_all({x}, '{LED}')"
    return f"(CASE WHEN len({found}) > {limit} THEN array_to_string(list_slice({found}, 1, {limit - 3}), '') || '...' ELSE {x} END)"


def lines(x: str) -> str:
    unix = f"replace({x}, chr(13)||chr(10), chr(10))"
    return f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(CASE WHEN ends_with({unix}, chr(10)) THEN left({unix}, length({unix})-1) ELSE {unix} END, chr(10)) END)"


def first_lines(x: str, n: int) -> str:
    kept = f"list_filter(list_transform({lines(x)}, lambda l: {trim('l')}), lambda l: l <> '')"
    return f"array_to_string(list_transform(list_slice({kept}, 1, {n}), lambda l: {short('l')}), chr(10))"


def exploded(source: str, key: str = "path", content: str = "content", extra: str = "") -> str:
    """SELECT of (key, extra, pos, line), positions from zero."""
    return (
        f"SELECT {key}{extra}, unnest(range(len(ls))) AS pos, unnest(ls) AS line "
        f"FROM (SELECT *, {lines(content)} AS ls FROM {source}) WHERE len(ls) > 0"
    )


DOCS = (
    f"docs AS (SELECT {corpora.DOC_PATH} AS path, text AS content, CAST(strlen(text) AS BIGINT) AS size, doc_id FROM documents)"
)
MARKDOWN = (
    "md_pieces AS (SELECT doc_id, source, lang, regexp_split_to_array(text, '[.] ?') AS p FROM documents), "
    f"md AS (SELECT {corpora.DOC_PATH} AS path, array_to_string(list_transform(range(len(p)), "
    f"lambda i: {corpora.MD_LINE.format(i='i', x='p[i+1]')}), chr(10)) AS content FROM md_pieces)"
)
PAGES = (
    "page_names AS (SELECT rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS bare, html FROM pages), "
    "pg AS (SELECT CASE WHEN ends_with(bare, '.html') THEN bare ELSE bare || '.html' END AS path, html AS content, "
    "CAST(strlen(html) AS BIGINT) AS size FROM page_names)"
)
TREE = (
    f"tree AS (SELECT {list(corpora.TREE_FOLDERS)}[CAST(doc_id % {len(corpora.TREE_FOLDERS)} + 1 AS INT)] || '/' || lang || doc_id || '/' || "
    f"{list(corpora.TREE_NAMES)}[CAST(doc_id % {len(corpora.TREE_NAMES)} + 1 AS INT)] AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents)"
)
SNAPSHOT = (
    f"base AS (SELECT {corpora.DOC_PATH} AS abs_path, CAST(strlen(text) + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, "
    "CAST(doc_id * 10 + toxic AS BIGINT) AS mtime_ns, CASE WHEN quality = 0 THEN upper(text) ELSE text END AS content "
    "FROM documents JOIN labels USING (doc_id) UNION ALL "
    f"SELECT {corpora.BENCHMARK_PATH}, CAST(strlen(text) AS BIGINT), CAST(0 AS BIGINT), text FROM benchmark), "
    f"cur AS (SELECT {corpora.DOC_PATH} AS abs_path, CAST(strlen(text) AS BIGINT) AS size, CAST(doc_id * 10 AS BIGINT) AS mtime_ns, "
    "text AS content FROM documents)"
)


def directory(p: str) -> str:
    return f"(CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END)"


def name(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$')"


def ext(p: str) -> str:
    return f"lower(regexp_extract({p}, '[^/]\\.([^./]+)$', 1))"


def priority(p: str) -> str:
    n = name(p)
    return (
        f"CAST(CASE WHEN {n} IN {words(langs.PRIORITY_MANIFESTS)} THEN 5000 WHEN {n} IN {words(langs.PRIORITY_ENTRY_POINTS)} THEN 4000 "
        f"WHEN starts_with({p}, '.github/workflows/') OR contains({p}, '/.github/workflows/') THEN 3000 "
        f"WHEN contains({n}, '.') AND regexp_extract({n}, '[^.]*$') IN {words(langs.PRIORITY_CONFIG_EXTENSIONS)} THEN 2000 ELSE 0 END AS BIGINT)"
    )


def leaf(p: str) -> str:
    return f"CAST((length({p}) - length(replace({p}, '/', ''))) * 1000 + strlen({p}) AS BIGINT)"


def generated(p: str) -> str:
    low = f"lower({p})"
    n = name(low)
    parts = " OR ".join(
        [f"{n} IN {words(langs.LOCKFILES)}", f"contains({n}, '.min.')"]
        + [f"contains({n}, '{x}')" for x in langs.GENERATED_NAME_PARTS]
        + [f"ends_with({n}, '{x}')" for x in langs.GENERATED_NAME_ENDINGS]
    )
    return f"(list_has_any(string_split({low}, '/'), {list(langs.GENERATED_COMPONENTS)}) OR {parts})"


def supported(p: str) -> str:
    return f"{ext(p)} IN {words(langs.EXTENSIONS)}"


def xml(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


def js(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    x = f"replace({x}, '\"', '\\\"')"
    for code, escaped in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        x = f"replace({x}, chr({code}), '{escaped}')"
    return x


# -- Markdown skeletons ---------------------------------------------------------------------------

_SHORT_LINE = short("line")
MARKDOWN_VARIANTS = f"""
ml0 AS (SELECT path, pos, {trim('line')} AS line FROM ({exploded('md')})),
ml1 AS (SELECT *, (starts_with(line, '```') OR starts_with(line, '~~~')) AS fence FROM ml0),
ml2 AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS fn FROM ml1),
opener AS (SELECT path, fn, pos AS fpos, lower(regexp_extract(regexp_replace(line, '^(```)*(~~~)*', ''), '^\\s*(\\S*)', 1)) IN {words(langs.FENCE_LANGUAGES)} AS known
  FROM ml2 WHERE fence AND fn % 2 = 1),
ml3 AS (SELECT m.*, o.fpos, o.known, CASE
  WHEN fence THEN CASE WHEN m.fn % 2 = 1 THEN 'fo' ELSE 'fc' END
  WHEN m.fn % 2 = 1 THEN CASE WHEN o.known THEN 'fb' ELSE 'hid' END
  WHEN line = '' OR contains(line, 'img.shields.io') OR contains(line, '<img ') OR starts_with(line, '<p align=') THEN 'noise'
  WHEN starts_with(line, '|') AND ends_with(line, '|') AND length(line) - length(replace(line, '|', '')) >= 2 THEN 'table'
  WHEN starts_with(line, '#') THEN 'head'
  WHEN (starts_with(line, '- ') OR starts_with(line, '* ')) AND NOT contains(line, 'badge') AND length(line) <= 240 THEN 'item'
  ELSE 'prose' END AS kind FROM ml2 m LEFT JOIN opener o ON o.path = m.path AND o.fn = m.fn AND m.fn % 2 = 1),
ml4 AS (SELECT *, sum(CASE WHEN kind IN ('head', 'item') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS grp,
  CASE WHEN kind IN ('table', 'item') THEN kind END AS rk,
  pos - row_number() OVER (PARTITION BY path, kind ORDER BY pos) AS isl FROM ml3),
ml5 AS (SELECT *, first_value(kind) OVER (PARTITION BY path, grp ORDER BY pos) AS gk,
  sum(CASE WHEN kind = 'prose' AND length(line) <= 280 THEN 1 ELSE 0 END) OVER (PARTITION BY path, grp ORDER BY pos) AS sn,
  row_number() OVER (PARTITION BY path, kind, isl ORDER BY pos) AS rn, count(*) OVER (PARTITION BY path, kind, isl) AS rc FROM ml4),
ml6 AS (SELECT path, pos, kind, known, CASE
  WHEN kind IN ('fo', 'fc') THEN line
  WHEN kind = 'fb' AND pos - fpos <= 24 THEN {_SHORT_LINE}
  WHEN kind = 'fb' AND pos - fpos = 25 THEN '...'
  WHEN rk IS NOT NULL AND (rc <= 14 OR rn <= 10 OR rn > rc - 4) THEN {_SHORT_LINE}
  WHEN rk IS NOT NULL AND rn = 11 THEN '...'
  WHEN kind = 'head' THEN {_SHORT_LINE}
  WHEN kind = 'prose' AND ((length(line) <= 280 AND gk = 'head' AND sn <= 2) OR (contains(line, '](') AND contains(line, '[')) OR (starts_with(line, '[') AND contains(line, ']:'))) THEN {_SHORT_LINE}
  END AS out FROM ml5),
ml7 AS (SELECT path, pos * 2 AS ord, out AS line FROM ml6 WHERE out IS NOT NULL
  UNION ALL SELECT path, pos * 2 + 1, '...' FROM ml6 WHERE kind = 'fo' AND NOT known),
ml8 AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY ord) AS prev FROM ml7),
ml9 AS (SELECT path, ord, line, row_number() OVER (PARTITION BY path ORDER BY ord) AS nth FROM ml8 WHERE prev IS DISTINCT FROM line),
msk AS (SELECT path, string_agg(line, chr(10) ORDER BY ord) AS skeleton FROM ml9 WHERE nth <= 180 GROUP BY path),
mtm AS (SELECT path, list_filter(list_transform({lines('content')}, lambda l: {trim('l')}), lambda l: starts_with(l, '#')) AS hs FROM md),
mv AS (SELECT md.path, content AS "full", coalesce(skeleton, {first_lines('content', 120)}) AS skeleton,
  CASE WHEN len(hs) > 0 THEN array_to_string(list_transform(list_slice(hs, 1, 120), lambda l: {short('l')}), chr(10)) ELSE {first_lines('content', 80)} END AS tree_map
  FROM md LEFT JOIN msk ON msk.path = md.path JOIN mtm ON mtm.path = md.path)"""

MD_COUNTS = f"mc AS (SELECT path, CAST({tokens('\"full\"')} AS BIGINT) AS t1, CAST({tokens('skeleton')} AS BIGINT) AS t2, CAST({tokens('tree_map')} AS BIGINT) AS t3 FROM mv)"


def greedy(start: int, budget: str) -> str:
    """CTEs computing levels of ``mc`` by the sorted step sequence; result table ``lv``."""
    def k(t: str) -> str:
        return f"{{'score': {leaf('path')} + {t} - {priority('path')}, 'tokens': {t}, 'path': path}}"

    steps = f"SELECT path, 2 AS step, t2 - t3 AS delta, {'least(' + k('t1') + ', ' + k('t2') + ')' if start == 1 else k('t2')} AS eff FROM mc"
    if start == 1:
        steps = f"SELECT path, 1 AS step, t1 - t2 AS delta, {k('t1')} AS eff FROM mc UNION ALL " + steps
    return f"""tot AS (SELECT sum(t{start}) AS total, {budget} AS budget FROM mc),
st AS ({steps}),
r AS (SELECT *, row_number() OVER (ORDER BY eff DESC, step) AS n, sum(delta) OVER (ORDER BY eff DESC, step ROWS UNBOUNDED PRECEDING) AS saved FROM st),
cut AS (SELECT CASE WHEN max(total) <= max(budget) THEN 0 ELSE coalesce(min(CASE WHEN total - saved <= budget THEN n END), max(n), 0) END AS stop FROM r CROSS JOIN tot),
taken AS (SELECT path, count(*) AS k FROM r WHERE n <= (SELECT stop FROM cut) GROUP BY path),
lv AS (SELECT mc.*, {start} + coalesce(k, 0) AS level FROM mc LEFT JOIN taken ON taken.path = mc.path)"""


def level_tokens() -> str:
    return "CASE level WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END"


# -- customers as code ----------------------------------------------------------------------------


def _template(text: str, imports: str) -> str:
    pieces = lit(text).replace("{k}", "' || c_custkey || '").replace("{m}", "' || c_mktsegment || '")
    return pieces.replace("{imports}", f"' || {imports} || '")


def code_outlines() -> str:
    """CTE ``code`` with path, skeleton and tree_map as they must come out."""
    arms: dict[str, list[str]] = {"path": [], "skeleton": [], "tree_map": []}
    count = "(CAST(c_nationkey AS INT) % 9 + 1)"
    for n, (language, (extension, import_line, _, skeleton, tree_map)) in enumerate(corpora.CODE.items()):
        before, after = import_line.split("{i}", 1)
        one = lit(before) + " || i || " + lit(after)
        if "{i}" in after:
            second, rest = after.split("{i}", 1)
            one = lit(before) + " || i || " + lit(second) + " || i || " + lit(rest)
        pad = "    " if language == "go" else ""
        shown = (
            f"array_to_string(list_transform(range(1, least({count}, 5) + 1), lambda i: {one}), chr(10)) || "
            f"CASE WHEN {count} > 5 THEN chr(10) || '{pad}... ' || ({count} - 5) || ' more imports' ELSE '' END"
        )
        when = f"WHEN c_custkey % {len(corpora.CODE)} = {n} THEN "
        arms["path"].append(when + f"'src/' || lower(c_mktsegment) || '/c' || c_custkey || '.{extension}'")
        arms["skeleton"].append(when + _template(skeleton, shown))
        arms["tree_map"].append(when + _template(tree_map, shown))
    cells = ", ".join(f"CASE {' '.join(arm)} END AS {column}" for column, arm in arms.items())
    return f"code AS (SELECT {cells} FROM customer)"


def config_outlines() -> str:
    """CTE ``conf`` with path, skeleton and tree_map of the generated manifests."""
    def items(shape: str, keep: str, sep: str) -> str:
        return f"array_to_string(list_transform(range(1, {keep} + 1), lambda i: {shape}), {sep})"

    def listed(shape: str, last: str) -> str:
        # twelve items stay, the rest becomes one ellipsis; only a complete list ends without a comma
        return (
            f"CASE WHEN p_size > 12 THEN {items(shape + chr(32) + '||' + chr(32) + chr(39) + ',' + chr(39), '12', 'chr(10)')} || chr(10) || '...' "
            f"ELSE {items(shape, 'p_size', last)} END"
        )

    js_item = "'\"item-' || i || '.js\"'"
    js_list = listed(js_item, "',' || chr(10)")
    yaml_list = (
        f"CASE WHEN p_size > 12 THEN {items(chr(39) + '- run: step ' + chr(39) + ' || i', '12', 'chr(10)')} || chr(10) || '...' "
        f"ELSE {items(chr(39) + '- run: step ' + chr(39) + ' || i', 'p_size', 'chr(10)')} END"
    )
    bodies = {
        0: "'\"name\": \"part-' || p_partkey || '\",' || chr(10) || '\"description\": \"' || p_name || '\",' || chr(10) || '\"files\": [' || chr(10) || "
        + js_list + " || chr(10) || '\"fixtures\": {' || chr(10) || '\"scripts\": {' || chr(10) || '\"build\": \"make ' || p_type || '\"'",
        1: "'# ' || p_name || chr(10) || '[package]' || chr(10) || 'name = \"part-' || p_partkey || '\"' || chr(10) || '[features]' || chr(10) || 'default = [' || chr(10) || "
        + js_list + " || chr(10) || '[lints.rust]' || chr(10) || 'unsafe = \"' || p_brand || '\"'",
        2: "'name: ' || p_name || chr(10) || 'on:' || chr(10) || 'push:' || chr(10) || 'jobs:' || chr(10) || 'build:' || chr(10) || 'steps:' || chr(10) || "
        + yaml_list + " || chr(10) || 'metadata:' || chr(10) || '...'",
    }
    path = " ".join(f"WHEN p_partkey % 3 = {n} THEN {p}" for n, (p, _) in corpora.CONFIG_SQL.items())
    body = " ".join(f"WHEN p_partkey % 3 = {n} THEN {b}" for n, b in bodies.items())
    return f"conf AS (SELECT CASE {path} END AS path, CASE {body} END AS outline FROM part)"


OBJC = (
    "oc AS (SELECT 'ios/p' || p_partkey || '.m' AS path, array_to_string(list_transform(range(1, p_size * 4 + 1), lambda i: "
    + corpora.OBJC_LINE.replace("{{", "{").replace("}}", "}").replace("{i}", "i")
    + "), chr(10)) AS content FROM part)"
)


def objc_outlines() -> str:
    """CTEs ending in ``ov`` (path, skeleton, tree_map); brace depth by a recursive walk over the lines."""
    delta = "(length(line) - length(replace(line, '{', ''))) - (length(line) - length(replace(line, '}', '')))"
    first = "regexp_extract(line, '^[^<:\\s]*')"
    kept = (
        "(" + " OR ".join(f"starts_with(line, '{d}')" for d in langs.OBJC_DIRECTIVES) + ")"
        + " OR ((starts_with(line, '- ') OR starts_with(line, '+ ') OR starts_with(line, '-(') OR starts_with(line, '+(')) AND contains(line, ')'))"
        + f" OR ({first} IN {words(langs.OBJC_SHAPE_WORDS)} AND (contains(line, '(') OR ends_with(line, ';') OR ends_with(line, '{{')))"
    )
    outline = f"CASE WHEN contains(line, '{{') THEN CASE WHEN rtrim(string_split(line, '{{')[1], {WS}) = '' THEN '{{ ... }}' ELSE rtrim(string_split(line, '{{')[1], {WS}) || ' {{ ... }}' END ELSE line END"

    def variant(limit: int, column: str) -> str:
        return f"""
{column}_a AS (SELECT path, pos, line, (starts_with(line, '#include ') OR starts_with(line, '#import ')) AS imp FROM
  (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY pos) AS prev FROM ok4 WHERE nth <= {limit}) WHERE prev IS DISTINCT FROM line),
{column}_b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) - row_number() OVER (PARTITION BY path, imp ORDER BY pos) AS isl FROM {column}_a),
{column}_c AS (SELECT *, row_number() OVER (PARTITION BY path, imp, isl ORDER BY pos) AS rn, count(*) OVER (PARTITION BY path, imp, isl) AS n FROM {column}_b),
{column}_d AS (SELECT path, string_agg(CASE WHEN imp AND rn = 6 THEN '... ' || (n - 5) || ' more imports' ELSE line END, chr(10) ORDER BY pos) AS {column}
  FROM {column}_c WHERE NOT imp OR rn <= 6 GROUP BY path)"""

    return f"""{OBJC},
ok0 AS (SELECT path, pos, {trim('line')} AS line FROM ({exploded('oc')})),
ok1 AS (SELECT path, pos, line, row_number() OVER (PARTITION BY path ORDER BY pos) AS i, {delta} AS d FROM ok0
  WHERE line <> '' AND NOT starts_with(line, '//') AND NOT starts_with(line, '/*') AND NOT starts_with(line, '*')),
walk AS (SELECT path, i, 0 AS depth, greatest(0, d) AS after FROM ok1 WHERE i = 1
  UNION ALL SELECT o.path, o.i, w.after, greatest(0, w.after + o.d) FROM walk w JOIN ok1 o ON o.path = w.path AND o.i = w.i + 1),
ok3 AS (SELECT path, pos, {outline} AS line FROM ok1 JOIN walk USING (path, i) WHERE depth = 0 AND ({kept})),
ok4 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS nth FROM ok3),
{variant(180, 'skeleton')},
{variant(120, 'tree_map')},
ov AS (SELECT oc.path, coalesce(skeleton, '') AS skeleton, coalesce(tree_map, '') AS tree_map FROM oc
  LEFT JOIN skeleton_d USING (path) LEFT JOIN tree_map_d USING (path))"""
