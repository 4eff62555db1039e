"""SQL text for the same results, for checks in another engine."""

from __future__ import annotations

from corpusveil import values as v
from corpusveil.catalog.corpus import CODE_MAPPING, TEXT_MAPPING, WEB_MAPPING  # noqa: F401

SPACE_LIST = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || " + " || ".join(
    f"chr({ord(c)})" for c in v.SPACE_CHARS if ord(c) > 13 and c != " "
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- name forms over a column ---------------------------------------------------


def is_upper(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def snake(x: str) -> str:
    return (
        f"lower(regexp_replace(regexp_replace({x}, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), "
        f"'([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
    )


def upper_snake(x: str) -> str:
    return f"upper({snake(x)})"


def kebab(x: str) -> str:
    return f"replace({snake(x)}, '_', '-')"


def pascal(x: str) -> str:
    return (
        f"CASE WHEN contains({x}, '_') THEN array_to_string(list_transform(string_split({x}, '_'), "
        f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') "
        f"ELSE upper(left({x}, 1)) || substr({x}, 2) END"
    )


def camel(x: str) -> str:
    p = pascal(x)
    return f"CASE WHEN {is_upper(x)} THEN lower({x}) ELSE lower(left({p}, 1)) || substr({p}, 2) END"


def match_case(x: str, repl: str) -> str:
    return (
        f"CASE WHEN {is_upper(x)} THEN upper({repl}) WHEN {is_upper(f'left({x}, 1)')} "
        f"THEN upper(left({repl}, 1)) || lower(substr({repl}, 2)) ELSE {repl} END"
    )


def _irregular(x: str, pairs: dict[str, str]) -> str:
    return " ".join(f"WHEN lower({x}) = '{k}' THEN {match_case(x, quote(w))}" for k, w in pairs.items())


def plural(x: str) -> str:
    es, ies, s = (f"CASE WHEN {is_upper(x)} THEN '{e.upper()}' ELSE '{e}' END" for e in ("es", "ies", "s"))
    low = f"lower({x})"
    return (
        f"CASE {_irregular(x, v.IRREGULAR_PLURALS)} "
        f"WHEN right({low}, 1) IN ('s', 'x', 'z') OR right({low}, 2) IN ('ch', 'sh') THEN {x} || {es} "
        f"WHEN right({low}, 1) = 'y' AND length({x}) > 1 AND left(right({low}, 2), 1) NOT IN ('a', 'e', 'i', 'o', 'u') "
        f"THEN left({x}, length({x}) - 1) || {ies} ELSE {x} || {s} END"
    )


def singular(x: str) -> str:
    low = f"lower({x})"
    inverse = {w: k for k, w in v.IRREGULAR_PLURALS.items()}
    return (
        f"CASE {_irregular(x, inverse)} "
        f"WHEN right({low}, 3) = 'ies' AND length({x}) > 3 AND left(right({low}, 4), 1) NOT IN ('a', 'e', 'i', 'o', 'u') "
        f"THEN left({x}, length({x}) - 3) || CASE WHEN {is_upper(x)} THEN 'Y' ELSE 'y' END "
        f"WHEN right({low}, 4) IN ('ches', 'shes', 'sses') OR right({low}, 3) IN ('xes', 'zes') THEN left({x}, length({x}) - 2) "
        f"WHEN right({low}, 1) = 's' AND length({x}) > 1 AND right({low}, 2) NOT IN ('ss', 'us', 'is') "
        f"THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


FAMILIES = [("pascal", pascal), ("camel", camel), ("upper_snake", upper_snake), ("snake", snake), ("kebab", kebab)]


# --- the given tables as names, mapping sets and source corpora --------------------

NAMES = """names AS (
  SELECT DISTINCT name FROM (
    SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents
    UNION ALL SELECT replace(p_name, ' ', '_') FROM part
    UNION ALL SELECT upper(replace(p_name, ' ', '_')) FROM part
    UNION ALL SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), '') FROM part
    UNION ALL SELECT lower(p_type) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), '') FROM part
    UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT r_name FROM region
    UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer))"""

MAPPINGS = """mp AS (
  SELECT lang AS set_id, 'variable' AS kind, doc_id::INT AS ord, w[1] AS frm, w[2] AS dst
  FROM (SELECT lang, doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents) WHERE len(w) >= 2
  UNION ALL
  SELECT regexp_extract(host, '([^.]*)$', 1), 'package', page_id::INT, host,
    CASE page_id % 3 WHEN 0 THEN regexp_replace(host, '^[^.]*\\.', '') WHEN 1 THEN 'safe.' || host ELSE host END
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages))"""

# as MAPPINGS in one set, each word of a text with the next one; of a word its first place counts
WHOLE_MAPPINGS = """wd AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents),
wp AS (SELECT doc_id, unnest(range(1, len(w))) AS k, unnest(w[1:len(w) - 1]) AS frm, unnest(w[2:len(w)]) AS dst FROM wd WHERE len(w) >= 2),
wf AS (SELECT frm, min({'doc_id': doc_id, 'k': k, 'dst': dst}) AS f FROM wp GROUP BY frm),
mp AS (
  SELECT 'all' AS set_id, 'variable' AS kind, row_number() OVER (ORDER BY f, frm) AS ord, frm, f.dst AS dst FROM wf
  UNION ALL
  SELECT 'all', 'package', page_id, host,
    CASE page_id % 3 WHEN 0 THEN regexp_replace(host, '^[^.]*\\.', '') WHEN 1 THEN 'safe.' || host ELSE host END
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages))"""


def mapping_values(pairs: list[tuple], set_id: str) -> str:
    rows = ", ".join(f"({quote(set_id)}, '{k}', {n}, {quote(f)}, {quote(t)})" for k, n, f, t in pairs)
    return f"mp AS (SELECT * FROM (VALUES {rows}) AS x(set_id, kind, ord, frm, dst))"


def forms_cte() -> str:
    """mp -> forms(set_id, kind, ord, frm, dst, form_pos, family, form, tag, replacement)."""
    bases = ", ".join(f"{{'k': {k}, 'family': '{n}', 'base': {fn('frm')}}}" for k, (n, fn) in enumerate(FAMILIES))
    tags = (
        f"{{'j': 0, 'tag': 'as_is', 'form': base}}, {{'j': 1, 'tag': 'plural', 'form': {plural('base')}}}, "
        f"{{'j': 2, 'tag': 'singular', 'form': {singular('base')}}}"
    )
    return f"""pv AS (SELECT * FROM mp WHERE kind = 'variable' AND frm <> '' AND dst <> ''),
f1 AS (SELECT set_id, kind, ord, frm, dst, unnest([{bases}]) AS b FROM pv),
f2 AS (SELECT set_id, kind, ord, frm, dst, b.k AS k, b.family AS family, b.base AS base FROM f1),
f3 AS (SELECT set_id, kind, ord, frm, dst, k, family, unnest([{tags}]) AS t FROM f2),
f4 AS (SELECT set_id, kind, ord, frm, dst, k * 3 + t.j AS pos, family, t.form AS form, t.tag AS tag FROM f3),
f5 AS (SELECT * FROM f4 WHERE form <> '' QUALIFY row_number() OVER (PARTITION BY set_id, kind, ord, form ORDER BY pos) = 1),
f6 AS (SELECT *, row_number() OVER (PARTITION BY set_id, kind, ord ORDER BY pos) - 1 AS form_pos,
  CASE WHEN {is_upper('form')} THEN {upper_snake('dst')} WHEN contains(form, '-') THEN {kebab('dst')}
       WHEN contains(form, '_') AND NOT {is_upper('left(form, 1)')} THEN {snake('dst')}
       WHEN {is_upper('left(form, 1)')} THEN {pascal('dst')} ELSE {camel('dst')} END AS target FROM f5),
forms AS (SELECT set_id, kind, ord, frm, dst, form_pos::INT AS form_pos, family, form, tag,
  CASE tag WHEN 'plural' THEN {plural('target')} WHEN 'singular' THEN {singular('target')} ELSE target END AS replacement FROM f6)"""


SHAPE_CASES = """[CASE WHEN form = upper(form) AND form <> lower(form) AND NOT contains(form, '_') THEN 'upper_prefix' END,
  'standalone',
  CASE WHEN left(form, 1) <> lower(left(form, 1)) AND NOT contains(form, '_') AND NOT contains(form, '-') AND length(form) > 1 THEN 'pascal_prefix' END,
  CASE WHEN left(form, 1) <> lower(left(form, 1)) AND NOT contains(form, '_') AND NOT contains(form, '-') AND length(form) > 1 THEN 'pascal_suffix' END,
  CASE WHEN left(form, 1) <> upper(left(form, 1)) AND NOT contains(form, '-') AND length(form) > 1 THEN 'camel_prefix' END]"""

ESCAPED = r"regexp_replace(literal, '([()\[\]{}?*+\-|^$\\.&~# \t\n\r\v\f])', '\\\1', 'g')"


def variable_rules_cte() -> str:
    cases_before = " ".join(f"WHEN '{s}' THEN {quote(b)}" for s, (b, _) in v.SHAPES.items())
    cases_after = " ".join(f"WHEN '{s}' THEN {quote(a)}" for s, (_, a) in v.SHAPES.items())
    return f"""{forms_cte()},
v1 AS (SELECT set_id, kind, ord, form_pos, form AS literal, replacement, list_filter({SHAPE_CASES}, lambda s: s IS NOT NULL) AS shapes FROM forms),
v2 AS (SELECT set_id, kind, ord, form_pos, literal, replacement, unnest(shapes) AS shape, generate_subscripts(shapes, 1) - 1 AS shape_pos FROM v1),
vr AS (SELECT set_id, kind, ord, form_pos, shape_pos::INT AS shape_pos, literal, shape,
  CASE shape {cases_before} END || {ESCAPED} || CASE shape {cases_after} END AS pattern, replacement, length({ESCAPED})::INT AS core_len FROM v2)"""


def package_rules_cte(variants: str = "[{'l': frm, 'r': dst}]") -> str:
    before, after = v.SHAPES["package"]
    return f"""p1 AS (SELECT set_id, kind, ord, unnest({variants}) AS w, generate_subscripts({variants}, 1) - 1 AS form_pos
  FROM mp WHERE kind = 'package' AND frm <> '' AND dst <> ''),
p2 AS (SELECT set_id, kind, ord, form_pos, w.l AS literal, w.r AS replacement FROM p1),
pr AS (SELECT set_id, kind, ord, form_pos::INT AS form_pos, 0 AS shape_pos, literal, 'package' AS shape,
  {quote(before)} || {ESCAPED} || {quote(after)} AS pattern, replacement, length({ESCAPED})::INT AS core_len FROM p2)"""


JAVA_VARIANTS = "[{'l': replace(frm, '.', '/'), 'r': replace(dst, '.', '/')}]"
REACT_VARIANTS = (
    "CASE WHEN contains(frm, '/') OR contains(dst, '/') THEN [{'l': frm, 'r': dst}, "
    "{'l': replace(frm, '/', '\\'), 'r': replace(dst, '/', '\\')}] ELSE [{'l': frm, 'r': dst}] END"
)


def rules_cte(variants: str = "[{'l': frm, 'r': dst}]") -> str:
    return f"{variable_rules_cte()}, {package_rules_cte(variants)}, rules AS (SELECT * FROM pr UNION ALL SELECT * FROM vr)"


def rename_cte(source: str, ids: str, out: str, rules: str = "rules", word: str = r"[A-Za-z0-9_.\-/]", many: bool = False) -> str:
    """CTEs that rename source(ids, text) into out(ids, text, n): distinct words, places
    where a rule holds, best rule per place, chain of places without overlap. `many` finds
    the literals of a word by its substrings instead of trying each."""
    p = out + "_"
    found = f"""{p}cand AS (SELECT w, literal, length(literal) AS n, pk, prep, vrep, shapes, unnest(range(1, length(w) - length(literal) + 2)) AS p
    FROM {p}words JOIN {p}lit ON contains(w, literal)),"""
    if many:
        found = f"""{p}part AS (SELECT w, n, unnest(range(1, length(w) - n + 2)) AS p
    FROM {p}words JOIN (SELECT DISTINCT length(literal) AS n FROM {p}lit) ON n <= length(w) WHERE regexp_matches(w, '^{word}')),
{p}cand AS (SELECT w, literal, n, pk, prep, vrep, shapes, p FROM {p}part JOIN {p}lit ON literal = substr(w, p, n)),"""
    other = "[^" + word[1:]
    id_list = ids
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in ids.split(","))
    return f"""{p}lit AS (SELECT literal, max(CASE WHEN kind = 'package' THEN 1 ELSE 0 END) AS pk,
    arg_min(replacement, (ord, form_pos, shape_pos)) FILTER (kind = 'package') AS prep,
    arg_min(replacement, (ord, form_pos, shape_pos)) FILTER (kind = 'variable') AS vrep,
    list(DISTINCT shape) AS shapes FROM {rules} GROUP BY literal),
{p}pieces AS (SELECT {id_list}, unnest(regexp_extract_all(text, '{word}+|{other}+')) AS piece,
    generate_subscripts(regexp_extract_all(text, '{word}+|{other}+'), 1) AS k FROM {source}),
{p}words AS (SELECT DISTINCT piece AS w FROM {p}pieces),
{found}
{p}near AS (SELECT *, CASE WHEN p > 1 THEN substr(w, p - 1, 1) ELSE '' END AS l, substr(w, p + n, 2) AS r FROM {p}cand
    WHERE substr(w, p, n) = literal),
{p}hit AS (SELECT w, p, n,
    CASE WHEN pk = 1 AND NOT regexp_matches(l, '[A-Za-z0-9_]') AND NOT regexp_matches(r, '^[A-Za-z0-9_]') THEN prep
      WHEN list_contains(shapes, 'standalone') AND NOT regexp_matches(l, '[A-Za-z0-9_]') AND NOT regexp_matches(r, '^[A-Za-z0-9]') THEN vrep
      WHEN list_contains(shapes, 'upper_prefix') AND regexp_matches(r, '^_[A-Z]') THEN vrep
      WHEN (list_contains(shapes, 'pascal_prefix') OR list_contains(shapes, 'camel_prefix')) AND regexp_matches(r, '^[A-Z]') THEN vrep
      WHEN list_contains(shapes, 'pascal_suffix') AND regexp_matches(l, '[a-z]') THEN vrep END AS rep FROM {p}near),
{p}best AS (SELECT w, p, max(n) AS n, arg_max(rep, n) AS rep FROM {p}hit WHERE rep IS NOT NULL GROUP BY w, p),
{p}next AS (SELECT a.w, a.p, a.n, a.rep, min(b.p) AS q FROM {p}best a LEFT JOIN {p}best b ON a.w = b.w AND b.p >= a.p + a.n GROUP BY ALL),
{p}walk AS (SELECT w, p, n, q, substr(w, 1, p - 1) || rep AS made, 1 AS c FROM {p}next
      WHERE (w, p) IN (SELECT (w, min(p)) FROM {p}best GROUP BY w)
    UNION ALL SELECT x.w, x.p, x.n, x.q, y.made || substr(x.w, y.p + y.n, x.p - y.p - y.n) || x.rep, y.c + 1
      FROM {p}walk y JOIN {p}next x ON x.w = y.w AND x.p = y.q),
{p}dict AS (SELECT w, made || substr(w, p + n) AS made, c FROM {p}walk WHERE q IS NULL),
{out} AS (SELECT a.{id_list.replace(', ', ', a.')}, coalesce(b.text, a.text) AS text, coalesce(b.c, 0)::BIGINT AS n
    FROM {source} a LEFT JOIN (SELECT {id_list}, string_agg(coalesce(d.made, piece), '' ORDER BY k) AS text, sum(coalesce(d.c, 0)) AS c
      FROM {p}pieces LEFT JOIN {p}dict d ON d.w = piece GROUP BY {id_list}) b ON {on})"""


_JAVA_NAME = "('Part' || ['Service', 'Repository', 'Controller', 'Enum', 'Util', 'Item'][{i} % 6 + 1] || {i})"
_JAVA_PACKAGE = "('com.myco.m' || ({i} % 7))"
_FOLDER = "['components', 'hooks', 'api', 'types/part-' || {i}, 'lib', 'pages'][{i} % 6 + 1]"
_REACT_NAME = "['PartView' || {i}, 'usePart' || {i}, 'partApi' || {i}, 'index', 'part_' || {i}, 'partPage' || {i}][{i} % 6 + 1]"

PARTS = """parts AS (SELECT (p_partkey % 10)::VARCHAR AS project, p_partkey // 10 AS i, count(*) OVER (PARTITION BY p_partkey % 10) AS n,
  p_name, p_brand, p_type, p_size FROM part),
tg AS (SELECT *, list_filter([CASE WHEN 2 * i + 1 < n + 3 THEN 2 * i + 1 END, CASE WHEN 2 * i + 2 < n + 3 THEN 2 * i + 2 END,
  CASE WHEN i % 11 = 0 AND i > 0 THEN (i * i + 1) % n END], lambda t: t IS NOT NULL) AS ts FROM parts)"""


def _at(template: str, i: str) -> str:
    return template.replace("{i}", i)


JAVA_FILES = f"""{PARTS},
jf AS (SELECT project, i, n, ts, replace({_at(_JAVA_PACKAGE, 'i')}, '.', '/') || '/' || {_at(_JAVA_NAME, 'i')} || '.java' AS path,
  {_at(_JAVA_PACKAGE, 'i')} || '.' || {_at(_JAVA_NAME, 'i')} AS module_id,
  'package ' || {_at(_JAVA_PACKAGE, 'i')} || ';' || chr(10) || chr(10)
  || array_to_string(list_transform(ts, lambda t: 'import ' || {_at(_JAVA_PACKAGE, 't')} || '.' || {_at(_JAVA_NAME, 't')} || ';' || chr(10)), '')
  || 'import com.myco2.ext.E' || i || ';' || chr(10) || chr(10) || '// ' || p_name || chr(10) || '/**' || chr(10) || ' * @author ' || p_brand
  || chr(10) || ' */' || chr(10) || 'public class ' || {_at(_JAVA_NAME, 'i')} || ' {{' || chr(10) || '    String label = "' || p_brand || ' ' || p_type || '";'
  || chr(10) || '    String url = "http://com.myco/part/' || i || '"; /* size ' || p_size || ' */' || chr(10) || chr(10) || chr(10) || chr(10)
  || '    void run() {{' || chr(10) || '        log.info("run {{}}", ' || p_size || ');' || chr(10) || '        part_count = PARTS + myPart;' || chr(10)
  || '    }}' || chr(10) || '}}' || chr(10) AS text FROM tg)"""

_TARGET = (
    f"(CASE WHEN t % 6 = 3 THEN {_at(_FOLDER, 't')} ELSE {_at(_FOLDER, 't')} || '/' || {_at(_REACT_NAME, 't')} "
    f"|| CASE WHEN t % 6 = 4 THEN '.js' ELSE '' END END)"
)
_SPEC = f"(CASE WHEN i % 2 = 0 THEN '@/' WHEN i % 6 = 3 THEN '../../' ELSE '../' END || {_TARGET})"

REACT_FILES = f"""{PARTS},
rf AS (SELECT project, i, n, ts, {_at(_FOLDER, 'i')} || '/' || {_at(_REACT_NAME, 'i')} || ['.tsx', '.ts', '.ts', '.ts', '.js', '.jsx'][i % 6 + 1] AS path,
  'import React from ''react'';' || chr(10)
  || array_to_string(list_transform(ts, lambda t: 'import {{' || chr(10) || '  a' || t || ',' || chr(10) || '}} from ''' || {_SPEC} || ''';' || chr(10)), '')
  || 'import ''./part' || i || '.css'';' || chr(10) || '{{/* ' || p_name || ' */}}' || chr(10) || '// size ' || p_size || '   ' || chr(10) || chr(10) || chr(10) || chr(10)
  || 'const label = ''' || p_brand || ' ' || p_type || ''';' || chr(10) || 'const tpl = `' || p_name || '`;' || chr(10) || 'const url = "http://part/' || p_size
  || '"; /* PART_SIZE */' || chr(10) || 'const live = `n ${{label}} ' || p_size || '`;' || chr(10) || 'console.log(''part ' || i || ''');' || chr(10)
  || 'export const value' || i || ' = myPart' || CASE WHEN i % 4 = 0 THEN '(<Panel />)' ELSE '' END || ';' || chr(10) AS text FROM tg)"""
