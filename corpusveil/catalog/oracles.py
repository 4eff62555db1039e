"""The queries of this catalog as SQL for another engine, written from the semantics."""

from __future__ import annotations

from corpusveil import values as v
from corpusveil.catalog import sql as Q
from corpusveil.catalog.corpus import CODE_MAPPING, TEXT_MAPPING, WEB_MAPPING

NL = "chr(10)"
JAVA_STRING = r'"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"'
SEGMENT = (
    r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|" + r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'" + r"|`(?:[^`\\$]|\\.|\$\{[^}]*\})*`"
)
SPACE = r"[ \t\n\r\v\f\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
FILES = "jf"


def trim(x: str) -> str:
    return f"trim({x}, {Q.SPACE_LIST})"


def strip_java(x: str) -> str:
    kept = f"regexp_replace({x}, {Q.quote(chr(40) + '?s' + chr(41))} || {Q.quote(_JAVA_COMMENT)}, '\\1', 'g')"
    return f"regexp_replace({kept}, '\\n{{3,}}', {NL} || {NL}, 'g')"


_JAVA_COMMENT = r'("[^"\\\n]*(?:\\.[^"\\\n]*)*")|/\*.*?\*/|//[^\n]*'


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '(?i)@(author|since|version|see)(?:([^\\p{{L}}\\p{{N}}_\\n])[^\\n]*|(\\n)|$)', '\\3', 'g')"


def strip_java_log(x: str) -> str:
    return f"regexp_replace({x}, '[ \\t]*log\\.(?:debug|info|warn|error|trace)\\([^;]+\\);\\n?', {NL}, 'g')"


def strip_react_log(x: str) -> str:
    return f"regexp_replace({x}, '[ \\t]*console\\.(?:log|info|warn|error|debug|trace)\\([^;\\n]*\\);?\\n?', {NL}, 'g')"


def pieces_cte(source: str, ids: str, regex: str, out: str) -> str:
    """source(ids, text) -> out(ids, k, gap, hit): the text is gap1 hit1 gap2 hit2 ... gapN."""
    rx = Q.quote(regex)
    return f"""{out}_l AS (SELECT {ids}, string_split_regex(text, {rx}) AS gaps, regexp_extract_all(text, {rx}) AS hits FROM {source}),
{out}_k AS (SELECT {ids}, gaps, hits, unnest(generate_series(1, len(gaps))) AS k FROM {out}_l),
{out} AS (SELECT {ids}, k, gaps[k] AS gap, hits[k] AS hit FROM {out}_k)"""


def dictionary_cte(pieces: str, order: str, out: str, maskable: str = "hit IS NOT NULL") -> str:
    return f"""{out} AS (SELECT 'STR_' || idx AS token, idx, literal FROM (
  SELECT hit AS literal, row_number() OVER (ORDER BY min(({order}, k))) - 1 AS idx FROM {pieces} WHERE {maskable} GROUP BY hit))"""


def masked_cte(pieces: str, ids: str, dictionary: str, out: str, maskable: str = "hit IS NOT NULL") -> str:
    return f"""{out} AS (SELECT {ids}, string_agg(gap || coalesce(CASE WHEN {maskable} THEN left(hit, 1) || token || left(hit, 1) END, hit, ''), '' ORDER BY k) AS text
  FROM {pieces} LEFT JOIN {dictionary} d ON d.literal = hit GROUP BY {ids})"""


PAGES = "pg AS (SELECT page_id, html AS text FROM pages)"
TEXT_RULES = f"{Q.mapping_values(TEXT_MAPPING, 'text')}, {Q.rules_cte()}"
CODE_RULES = f"{Q.mapping_values(CODE_MAPPING, 'code')}, {Q.rules_cte()}"
DOCS = "src AS (SELECT doc_id, text FROM documents)"
PAGE_LITERALS = f"{PAGES}, {pieces_cte('pg', 'page_id', JAVA_STRING, 'pp')}"
PAGE_DICT = f"{PAGE_LITERALS}, {dictionary_cte('pp', 'page_id', 'dict')}"

# --- react pieces: which strings may be masked ------------------------------------
# in the generated files a specifier string follows 'from ' or 'import ' in the code before it
REACT_PIECES = f"""{Q.REACT_FILES}, rs AS (SELECT project, path, i, text FROM rf), {pieces_cte('rs', 'project, path, i', SEGMENT, 'rp')}"""
REACT_MASKABLE = (
    "hit IS NOT NULL AND ((left(hit, 1) = '`' AND NOT contains(hit, '${')) "
    "OR (left(hit, 1) IN ('''', '\"') AND NOT regexp_matches(gap, '(\\bfrom|\\bimport)\\s*$')))"
)

EDGES_JAVA = f"""{Q.JAVA_FILES},
im AS (SELECT project, path AS src_path, unnest(regexp_extract_all(text, '(?m)^import\\s+(?:static\\s+)?([a-zA-Z0-9_.]+);', 1)) AS spec,
    generate_subscripts(regexp_extract_all(text, '(?m)^import\\s+(?:static\\s+)?([a-zA-Z0-9_.]+);', 1), 1) AS raw FROM jf),
ji AS (SELECT project, src_path, (row_number() OVER (PARTITION BY project, src_path ORDER BY raw) - 1)::INT AS ord, spec FROM im
    WHERE starts_with(spec, 'com.myco.') AND regexp_matches(spec, '\\.[A-Z][^.]*$')),
je AS (SELECT a.project, a.src_path, a.ord, a.spec, a.spec AS dep_id, b.path AS dep_path FROM ji a
    LEFT JOIN jf b ON b.project = a.project AND b.path = replace(a.spec, '.', '/') || '.java')"""

_RX1 = r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:[^'";]*?\bfrom\s*)?['"]([^'"\n]+)['"]"""
_RX2 = r"""(?m)^[ \t]*export\s+(?:type\s+)?[^'";]*?\bfrom\s*['"]([^'"\n]+)['"]"""
_RX3 = r"""\b(?:require|import)\(\s*['"]([^'"\n]+)['"]\s*\)"""
REACT_SPECS = "list_concat(" + ", ".join(f"regexp_extract_all(text, {Q.quote(r)}, 1)" for r in (_RX1, _RX2, _RX3)) + ")"
REACT_IMPORTS = f"""{Q.REACT_FILES},
rm AS (SELECT project, path AS src_path, unnest({REACT_SPECS}) AS spec, generate_subscripts({REACT_SPECS}, 1) AS raw FROM rf),
rd AS (SELECT project, src_path, spec, min(raw) AS raw FROM rm GROUP BY ALL),
ri AS (SELECT project, src_path, (row_number() OVER (PARTITION BY project, src_path ORDER BY raw) - 1)::INT AS ord, spec FROM rd)"""
# folders are one or two levels deep, so '../' and '../../' both lead to the top
EDGES_REACT = f"""{REACT_IMPORTS},
rb AS (SELECT *, CASE WHEN starts_with(spec, '@/') THEN substr(spec, 3) ELSE regexp_replace(spec, '^(\\.\\./)+', '') END AS base FROM ri
    WHERE (starts_with(spec, '.') OR starts_with(spec, '@/')) AND NOT ends_with(spec, '.css')),
rk AS (SELECT b.*, f.path AS hit, list_position(['', '.ts', '.tsx', '.tsx', '.ts', '.jsx', '.js', '/index.tsx', '/index.ts', '/index.jsx', '/index.js'],
      substr(f.path, length(base) + 1)) AS rank FROM rb b JOIN rf f ON f.project = b.project AND starts_with(f.path, b.base)
      AND substr(f.path, length(base) + 1) IN ('', '.tsx', '.ts', '.jsx', '.js', '/index.tsx', '/index.ts', '/index.jsx', '/index.js')),
rr AS (SELECT project, src_path, ord, arg_min(hit, rank) AS dep_path FROM rk GROUP BY ALL),
re AS (SELECT b.project, b.src_path, b.ord, b.spec, coalesce(r.dep_path, CASE WHEN starts_with(spec, '@') THEN spec ELSE base END) AS dep_id, r.dep_path
    FROM rb b LEFT JOIN rr r USING (project, src_path, ord))"""


def java_type(x: str) -> str:
    chain = "".join(
        f"WHEN {' OR '.join(f'contains(lower({x}), {Q.quote(w)})' for w in words)} THEN '{kind}' " for kind, words in v.JAVA_TYPE_WORDS
    )
    return f"CASE {chain}ELSE 'model' END"


def react_type(path: str, text: str) -> str:
    segs = f"string_split(lower({path}), '/')"

    def has(kind: str) -> str:
        return f"list_has_any({segs}, [{', '.join(Q.quote(s) for s in v.REACT_SEGMENTS[kind])}])"

    name = f"regexp_extract({path}, '([^/]*)$', 1)"
    return (
        f"CASE WHEN regexp_matches({name}, '^use[A-Z]') OR {has('hook')} THEN 'hook' "
        f"WHEN contains(lower({path}), 'context') OR contains(lower({path}), 'provider') THEN 'context' "
        f"WHEN ends_with(lower({path}), '.d.ts') OR {has('types')} THEN 'types' WHEN {has('api')} THEN 'api' WHEN {has('util')} THEN 'util' "
        f"WHEN ends_with(lower({path}), '.tsx') OR ends_with(lower({path}), '.jsx') OR {has('component')} "
        f"OR regexp_matches({text}, '<[A-Z][A-Za-z0-9]*[\\s/>]') THEN 'component' "
        f"WHEN regexp_matches({text}, '\\b(axios|fetch)\\s*[.(]') THEN 'api' ELSE 'module' END"
    )


def closure_cte(files: str, edges: str, node: str, type_found: str, type_missing: str) -> str:
    """Shortest ordinal paths from every entry; the smallest per module is its place."""
    return f"""RECURSIVE_PLACEHOLDER
nodes AS (SELECT project, path, {node} AS module_id, {type_found} AS type FROM {files}),
adj AS (SELECT e.project, e.src_path, e.ord, e.dep_path, coalesce(n.module_id, e.dep_id) AS module_id,
    coalesce(n.type, {type_missing}) AS type FROM {edges} e LEFT JOIN nodes n ON n.project = e.project AND n.path = e.dep_path),
walk AS (SELECT f.project, f.path AS entry, n.module_id, f.path AS path, n.type, 0 AS depth, '' AS place, '' AS parent, 0 AS ord, [n.module_id] AS trail
      FROM {files} f JOIN nodes n USING (project, path) WHERE f.i IN (1, 2, 5)
    UNION ALL SELECT w.project, w.entry, a.module_id, a.dep_path, a.type, w.depth + 1, w.place || lpad(a.ord::VARCHAR, 3, '0'), w.place, a.ord,
      list_append(w.trail, a.module_id) FROM walk w JOIN adj a ON a.project = w.project AND a.src_path = w.path
      WHERE NOT list_contains(w.trail, a.module_id)),
firsts AS (SELECT project, entry, module_id, arg_min((path, type, depth, place, parent, ord), (depth, place)) AS r FROM walk GROUP BY ALL),
flat AS (SELECT project, entry, module_id, struct_extract(r, 1) AS path, struct_extract(r, 2) AS type, struct_extract(r, 1) IS NOT NULL AS found,
    struct_extract(r, 3) AS depth, struct_extract(r, 4) AS place, struct_extract(r, 5) AS parent, struct_extract(r, 6) AS ord FROM firsts),
closure AS (SELECT project, entry, module_id, path, type, found, depth, row_number() OVER (PARTITION BY project, entry ORDER BY
    CASE WHEN found THEN depth ELSE depth - 1 END, CASE WHEN found THEN place ELSE parent END, CASE WHEN found THEN -1 ELSE ord END) - 1 AS seq FROM flat)"""


JAVA_CLOSURE = f"""{EDGES_JAVA}, {closure_cte('jf', 'je', 'module_id', java_type('module_id'), java_type('e.dep_id'))}""".replace(
    "RECURSIVE_PLACEHOLDER\n", ""
)
REACT_CLOSURE = f"""{EDGES_REACT}, {closure_cte('rf', 're', 'path', react_type('path', 'text'), react_type('e.dep_id', "''"))}""".replace(
    "RECURSIVE_PLACEHOLDER\n", ""
)
CLOSURE_COLUMNS = "project, entry, module_id, path, type, found, depth, seq"


def names_query(expr) -> str:
    return f"WITH {Q.NAMES} SELECT name, {expr('name')} AS form FROM names"


def _labels(lang: str) -> str:
    return " ".join(f"WHEN '{k}' THEN {Q.quote(t)}" for k, t in v.TYPE_LABELS[lang].items())


def _order(lang: str) -> str:
    return "[" + ", ".join(f"'{t}'" for t in v.TYPE_ORDER[lang]) + "]"


def bundle_query(closure: str, lang: str, mapping: list[tuple], name: str, framework: str) -> str:
    label, mock = v.TEST_FRAMEWORKS[framework]
    head = v.BUNDLE_HEAD[lang].replace("{framework}", label).replace("{mock}", mock)
    tail = v.BUNDLE_TAIL[lang]
    rules = f"{Q.mapping_values(mapping, 'm')}, {Q.variable_rules_cte()}"
    return f"""WITH RECURSIVE {closure}, {rules},
dep AS (SELECT project, entry, seq, {name} AS text FROM closure WHERE type <> '{v.BUNDLE_EXCLUDED_TYPE[lang]}'),
{Q.rename_cte('dep', 'project, entry, seq', 'ren', 'vr')},
mid AS (SELECT project, entry, seq // 50 + 1 AS part, string_agg(text, ', ' ORDER BY seq) AS text FROM ren GROUP BY ALL),
fst AS (SELECT project, entry, min(part) AS first FROM mid GROUP BY ALL),
sz AS (SELECT project, entry, max(seq) // 50 + 2 AS last FROM closure GROUP BY ALL)
SELECT project, entry, part, CASE WHEN part > first THEN ', ' ELSE '' END || text AS text FROM mid JOIN fst USING (project, entry)
UNION ALL SELECT project, entry, 0, {Q.quote(head)} FROM sz
UNION ALL SELECT project, entry, last, CASE WHEN first IS NULL THEN {Q.quote(v.BUNDLE_EMPTY[lang])} ELSE '' END || {Q.quote(tail)}
  FROM sz LEFT JOIN fst USING (project, entry)"""


def java_output_ctes(source: str, out: str) -> str:
    """source(project, module_id) -> out(project, module_id, target)."""
    path_rules = Q.package_rules_cte(Q.JAVA_VARIANTS).replace("p1 AS", "q1 AS").replace("FROM p1", "FROM q1").replace(
        "p2 AS", "q2 AS").replace("FROM p2", "FROM q2").replace("pr AS", "qr AS")
    return f"""{path_rules}, prules AS (SELECT * FROM qr UNION ALL SELECT * FROM vr),
{out}0 AS (SELECT project, module_id, module_id AS text FROM {source}),
{Q.rename_cte(out + '0', 'project, module_id', out + '1', 'pr')},
{out}2 AS (SELECT project, module_id, regexp_extract(text, '^(.*\\.)?([^.]*)$', 1) AS pkg, regexp_extract(text, '^(.*\\.)?([^.]*)$', 2) AS text FROM {out}1),
{Q.rename_cte(out + '2', 'project, module_id', out + '3', 'vr')},
{out}4 AS (SELECT a.project, a.module_id, replace(b.pkg || a.text, '.', '/') || '.java' AS text FROM {out}3 a JOIN {out}2 b USING (project, module_id)),
{Q.rename_cte(out + '4', 'project, module_id', out + '5', 'prules')},
{out} AS (SELECT project, module_id, text AS target FROM {out}5)"""


def java_path_ctes(source: str, out: str) -> str:
    """source(project, path) -> out(project, path, target) with the path rules of CODE_RULES."""
    path_rules = Q.package_rules_cte(Q.JAVA_VARIANTS).replace("p1 AS", "q1 AS").replace("FROM p1", "FROM q1").replace(
        "p2 AS", "q2 AS").replace("FROM p2", "FROM q2").replace("pr AS", "qr AS")
    return f"""{path_rules}, prules AS (SELECT * FROM qr UNION ALL SELECT * FROM vr),
{out}0 AS (SELECT project, path, path AS text FROM {source}),
{Q.rename_cte(out + '0', 'project, path', out + '1', 'prules')},
{out} AS (SELECT project, path, text AS target FROM {out}1)"""


RETURNED = f"""{Q.JAVA_FILES}, {CODE_RULES}, {java_path_ctes('jf', 'mv')},
back AS (SELECT project, target AS path, path AS old FROM mv UNION ALL SELECT project, path, NULL FROM jf WHERE contains(path, 'Service')),
plan AS (SELECT b.project, b.path, b.old AS target, contains(b.old, 'Service') AS collision FROM back b WHERE b.old IS NOT NULL AND b.old <> b.path)"""

SANITIZED_JAVA = f"""{Q.JAVA_FILES}, {CODE_RULES}, js AS (SELECT project, path, i, text FROM jf),
{Q.rename_cte('js', 'project, path, i', 'rn')},
st AS (SELECT project, path, i, {strip_tags(strip_java('text'))} AS text FROM rn),
{pieces_cte('st', 'project, path, i', JAVA_STRING, 'sp')}, {dictionary_cte('sp', 'project, i', 'dict')},
{masked_cte('sp', 'project, path, i', 'dict', 'mk')}"""

SANITIZED_PAGES = f"""{PAGES}, {TEXT_RULES}, {Q.rename_cte('pg', 'page_id', 'rn')},
{pieces_cte('rn', 'page_id', JAVA_STRING, 'sp')}, {dictionary_cte('sp', 'page_id', 'dict')}, {masked_cte('sp', 'page_id', 'dict', 'mk')}"""

_REACT_RULES = f"{Q.mapping_values(WEB_MAPPING, 'web')}, {Q.rules_cte()}"
SANITIZED_REACT = f"""{Q.REACT_FILES}, {_REACT_RULES}, js AS (SELECT project, path, i, text FROM rf),
{Q.rename_cte('js', 'project, path, i', 'rn')},
nj AS (SELECT project, path, i, regexp_replace(text, '(?s)\\{{\\s*/\\*.*?\\*/\\s*\\}}', '', 'g') AS text FROM rn),
{pieces_cte('nj', 'project, path, i', SEGMENT, 'cp')},
nc AS (SELECT project, path, i, string_agg(gap || CASE WHEN starts_with(hit, '//') OR starts_with(hit, '/*') THEN '' ELSE coalesce(hit, '') END, '' ORDER BY k) AS text
  FROM cp GROUP BY ALL),
st AS (SELECT project, path, i, {strip_tags(f"regexp_replace(regexp_replace(text, '[ \\t]+\\n', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')")} AS text FROM nc),
{pieces_cte('st', 'project, path, i', SEGMENT, 'sp')}, {dictionary_cte('sp', 'project, i', 'dict', REACT_MASKABLE)},
{masked_cte('sp', 'project, path, i', 'dict', 'mk', REACT_MASKABLE)}"""

CODE_AND_DOCS = f"{Q.JAVA_FILES}, cd AS (SELECT project || '/' || path AS id, text FROM jf UNION ALL SELECT doc_id::VARCHAR, text FROM documents)"
RULE_COLUMNS = "set_id, kind, ord, form_pos, shape_pos, literal, shape, pattern, replacement, core_len"
VALID = "vp AS (SELECT * FROM mp WHERE frm <> '' AND dst <> '')"
COUNTED = f"{VALID}, ct AS (SELECT set_id, kind, frm, dst, count(*) AS n, min(ord) AS ord FROM vp GROUP BY ALL)"
FIRSTS = f"{COUNTED}, fs AS (SELECT set_id, kind, frm, arg_min(dst, ord) AS first_to FROM ct GROUP BY ALL)"


def pair_counts(kind: str, condition: str) -> str:
    """(target, source) with how many pairs of different mappings stand behind it."""
    return f"""SELECT a.set_id, a.dst AS target, b.frm AS source, count(DISTINCT a.ord) AS n_targets, count(DISTINCT b.ord) AS n_sources,
  count(*) FILTER (a.ord <> b.ord) AS n_pairs FROM vp a JOIN vp b ON a.set_id = b.set_id AND {condition}
  WHERE a.kind = '{kind}' AND b.kind = '{kind}' GROUP BY ALL HAVING count(*) FILTER (a.ord <> b.ord) > 0"""


def form_list(x: str) -> str:
    forms = []
    for _, fn in Q.FAMILIES:
        forms.append(fn(x))
    return "[" + ", ".join(forms) + "]"


OVERLAPS = f"""{VALID}, nm AS (SELECT DISTINCT name FROM (SELECT frm AS name FROM vp WHERE kind = 'variable' UNION ALL SELECT dst FROM vp WHERE kind = 'variable')),
nb AS (SELECT name, unnest({form_list('name')}) AS base FROM nm),
nf AS (SELECT name, unnest([base, {Q.plural('base')}, {Q.singular('base')}]) AS form FROM nb),
nd AS (SELECT DISTINCT name, form FROM nf WHERE form <> ''),
sh AS (SELECT a.name AS target, b.name AS source, string_agg(DISTINCT a.form, ', ' ORDER BY a.form) AS shared FROM nd a JOIN nd b USING (form) GROUP BY ALL),
ov AS (SELECT a.set_id, a.dst AS target, b.frm AS source, s.shared, count(DISTINCT a.ord) AS n_targets, count(DISTINCT b.ord) AS n_sources,
  count(*) FILTER (a.ord <> b.ord) AS n_pairs FROM vp a JOIN sh s ON s.target = a.dst JOIN vp b ON b.set_id = a.set_id AND b.frm = s.source
  WHERE a.kind = 'variable' AND b.kind = 'variable' GROUP BY ALL HAVING count(*) FILTER (a.ord <> b.ord) > 0)"""
CASCADES = pair_counts("package", "contains(a.dst, b.frm)")

LANES = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) AS s{k}" for k in range(8))
LANE_TEXT = " || ',' || ".join(["n::VARCHAR"] + [f"s{k}::BIGINT::VARCHAR" for k in range(8)])


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    plain = {
        "n1_snake_case": Q.snake, "n2_upper_snake_case": Q.upper_snake, "n3_kebab_case": Q.kebab, "n4_pascal_case": Q.pascal,
        "n5_camel_case": Q.camel, "n6_pluralize": Q.plural, "n7_singularize": Q.singular,
        "n8_match_case": lambda x: Q.match_case(x, "'criTeria'"),
    }
    q.update({key: names_query(expr) for key, expr in plain.items()})

    q["s1_read_sources"] = f"WITH {Q.JAVA_FILES} SELECT 'all' AS project, project || '/' || path AS path, 'spring' AS lang, text, false AS bad_utf8, 0::INT AS n_replaced FROM jf"
    q["s2_read_mappings"] = f"""WITH {Q.MAPPINGS}, small AS (SELECT set_id || '-' || (ord // 1000) AS set_id, kind, ord, frm, dst FROM mp)
      SELECT set_id, kind, (row_number() OVER (PARTITION BY set_id, kind ORDER BY ord) - 1)::INT AS ord, frm AS "from", dst AS "to" FROM small"""
    q["s3_mappings_from_pairs"] = """SELECT 'cli' AS set_id, 'variable' AS kind, p_partkey::INT AS ord, p_name AS "from", p_brand || '=' || p_type AS "to" FROM part"""
    q["s4_write_mappings"] = f"""WITH {Q.MAPPINGS}, {PAGE_DICT} SELECT kind, frm AS a, dst AS b FROM mp UNION ALL SELECT 'literal', token, literal FROM dict"""
    q["s2_whole_sets"] = f"""WITH {Q.MAPPINGS} SELECT set_id, kind, (row_number() OVER (PARTITION BY set_id, kind ORDER BY ord, frm, dst) - 1)::INT AS ord,
      frm AS "from", dst AS "to" FROM mp"""
    q["s4_whole_sets"] = f"""WITH {Q.MAPPINGS}, {PAGE_DICT} SELECT set_id, kind, frm AS a, dst AS b FROM mp UNION ALL SELECT 'pages', 'literal', token, literal FROM dict"""
    both = f"{Q.JAVA_FILES}, {Q.REACT_FILES.replace(Q.PARTS + ',', '')}"
    q["s5_write_clean"] = f"WITH {both} SELECT project, 'spring' AS lang, path, text FROM jf UNION ALL SELECT project, 'react', path, text FROM rf"
    q["s6_snapshot"] = f"WITH {Q.JAVA_FILES} SELECT project, path, text FROM jf"

    q["p1_infer_lang"] = f"""WITH {both}, ps AS (SELECT path FROM jf UNION ALL SELECT path FROM rf UNION ALL SELECT url FROM pages UNION ALL SELECT c_name || '.TSX' FROM customer)
      SELECT path, CASE WHEN regexp_matches(lower(path), '[^/]\\.(tsx|ts|jsx|js)$') THEN 'react' ELSE 'spring' END AS lang FROM ps"""
    q["p2_resolve_lang"] = """SELECT doc_id, CASE WHEN source = 'src1' THEN 'react' WHEN source = 'src3' THEN 'spring'
      WHEN lang = 'en' THEN 'react' ELSE 'spring' END AS lang FROM documents"""
    q["p3_module_id_java"] = f"""WITH {Q.JAVA_FILES}, every AS (SELECT project, path, text FROM jf UNION ALL SELECT project, 'x/' || path, regexp_replace(text, '(?s)^[^\\n]*\\n', '') FROM jf),
      parts2 AS (SELECT project, path, regexp_extract(text, '(?m)^package\\s+([a-zA-Z0-9_.]+);', 1) AS pkg,
        regexp_extract(text, '(?:public\\s+)?(?:class|interface|enum|@interface)\\s+(\\w+)', 1) AS cls FROM every)
      SELECT project, path, CASE WHEN pkg = '' THEN '' ELSE pkg || '.' END || CASE WHEN cls = '' THEN regexp_extract(path, '([^/]*)\\.java$', 1) ELSE cls END AS module_id FROM parts2"""
    q["p4_module_id_react"] = f"""WITH {Q.REACT_FILES} SELECT project, 'src/x/../' || path AS "full", path AS module_id FROM rf
      UNION ALL SELECT project, 'other/' || path, regexp_extract(path, '([^/]*)$', 1) FROM rf"""
    q["p5_classify_java"] = f"""WITH {Q.JAVA_FILES}, {Q.NAMES}, ids AS (SELECT module_id FROM jf UNION SELECT name FROM names)
      SELECT module_id, {java_type('module_id')} AS type FROM ids"""
    q["p6_classify_react"] = f"""WITH {Q.REACT_FILES}, every AS (SELECT path, text FROM rf UNION ALL SELECT regexp_extract(path, '([^/]*)$', 1), text FROM rf
        UNION ALL SELECT 'x/' || source || '.js', text FROM documents UNION ALL SELECT regexp_extract(url, '^https?://([^?#]*)', 1), html FROM pages)
      SELECT path, {react_type('path', 'text')} AS type, count(*) AS n FROM every GROUP BY ALL"""

    q["g1_java_imports"] = f"WITH {EDGES_JAVA} SELECT project, src_path, ord, spec FROM ji"
    q["g2_react_imports"] = f"WITH {REACT_IMPORTS} SELECT project, src_path, ord, spec FROM ri"
    q["g3_resolve_java"] = f"WITH {EDGES_JAVA} SELECT project, src_path, ord, spec, dep_id, dep_path FROM je"
    q["g4_resolve_react"] = f"WITH {EDGES_REACT} SELECT project, src_path, ord, spec, dep_id, dep_path FROM re"
    q["g5_missing_modules"] = f"WITH {EDGES_JAVA} SELECT DISTINCT project, dep_id AS module_id FROM je WHERE dep_path IS NULL"
    q["g5_missing_pages"] = f"""WITH ln AS (SELECT DISTINCT {HOST} AS project, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS module_id FROM pages),
      kn AS (SELECT {HOST} AS project, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS module_id FROM pages)
      SELECT project, module_id FROM ln ANTI JOIN kn USING (project, module_id)"""
    q["g6_trace_closure"] = f"WITH RECURSIVE {JAVA_CLOSURE} SELECT {CLOSURE_COLUMNS} FROM closure"
    q["g6_trace_closure_bucketed"] = q["g6_trace_closure"]
    q["g6_trace_closure_react"] = f"WITH RECURSIVE {REACT_CLOSURE} SELECT {CLOSURE_COLUMNS} FROM closure"
    q["g7_checklist"] = f"""WITH RECURSIVE {JAVA_CLOSURE} SELECT project, entry, list_position({_order(v.SPRING)}, type)::INT AS type_ord,
      CASE type {_labels(v.SPRING)} END AS label, seq, coalesce(path, replace(module_id, '.', '/') || '.java') AS shown,
      CASE WHEN found THEN 'found' ELSE 'not found' END AS status FROM closure"""
    q["g7_checklist_summary"] = f"""WITH RECURSIVE {JAVA_CLOSURE} SELECT project, entry, type, count(*) AS n_modules,
      count(*) FILTER (NOT found) AS n_missing FROM closure GROUP BY ALL"""

    q["r1_expand_forms"] = f"WITH {Q.MAPPINGS}, {Q.forms_cte()} SELECT set_id, ord, frm AS source, dst AS target, pos AS form_pos, family, form, tag FROM f5".replace(
        "pos AS form_pos", "(row_number() OVER (PARTITION BY set_id, ord ORDER BY pos) - 1)::INT AS form_pos")
    q["r2_expand_rules"] = f"WITH {Q.MAPPINGS}, {Q.variable_rules_cte()} SELECT {RULE_COLUMNS} FROM vr"
    q["r3_package_rules"] = f"WITH {Q.MAPPINGS}, {Q.package_rules_cte()} SELECT {RULE_COLUMNS} FROM pr"
    slashed = "ms AS (SELECT set_id, kind, ord, CASE WHEN kind = 'package' THEN 'src/' || frm ELSE frm END AS frm, dst FROM mp)"
    react_rules = Q.package_rules_cte(Q.REACT_VARIANTS).replace("FROM mp", "FROM ms").replace("p1 AS", "q1 AS").replace(
        "FROM p1", "FROM q1").replace("p2 AS", "q2 AS").replace("FROM p2", "FROM q2").replace("pr AS", "qr AS")
    q["r4_path_rules"] = f"""WITH {Q.MAPPINGS}, {slashed}, {Q.variable_rules_cte()}, {Q.package_rules_cte(Q.JAVA_VARIANTS)}, {react_rules}
      SELECT 'spring' AS lang, {RULE_COLUMNS} FROM pr UNION ALL SELECT 'spring', {RULE_COLUMNS} FROM vr
      UNION ALL SELECT 'react', {RULE_COLUMNS} FROM qr UNION ALL SELECT 'react', {RULE_COLUMNS} FROM vr"""
    q["r5_rank_rules"] = f"""WITH {Q.MAPPINGS}, {Q.rules_cte()},
      one AS (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY set_id, pattern ORDER BY kind, ord, form_pos, shape_pos) = 1)
      SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY core_len DESC, kind, ord, form_pos, shape_pos) AS rank, pattern, replacement, core_len FROM one"""
    q["r6_self_maps"] = f"WITH {Q.MAPPINGS}, {COUNTED} SELECT set_id, kind, frm AS source, n FROM ct WHERE frm = dst"
    q["r6_duplicates"] = f"""WITH {Q.MAPPINGS}, {FIRSTS} SELECT c.set_id, c.kind, c.frm AS source, f.first_to, c.dst AS target, c.n
      FROM ct c JOIN fs f USING (set_id, kind, frm) WHERE c.dst <> f.first_to"""
    q["r6_package_cascades"] = f"WITH {Q.MAPPINGS}, {VALID} {CASCADES}"
    q["r7_variable_overlaps"] = f"WITH {Q.MAPPINGS}, {OVERLAPS} SELECT set_id, target, source, shared, n_targets, n_sources, n_pairs FROM ov"
    note = "replacements are applied in a single pass, so it will not"
    q["r7_validate_mappings"] = f"""WITH {Q.MAPPINGS}, {OVERLAPS}, {FIRSTS.replace(VALID + ', ', '')}, cs AS ({CASCADES})
      SELECT set_id, kind, 'self_map' AS problem, kind || ' mapping ''' || frm || ''' maps to itself' AS message, n FROM ct WHERE frm = dst
      UNION ALL SELECT c.set_id, c.kind, 'duplicate', 'duplicate ' || c.kind || ' mapping for ''' || c.frm || ''' (''' || f.first_to || ''' vs ''' || c.dst || ''') — the first one wins', c.n
        FROM ct c JOIN fs f USING (set_id, kind, frm) WHERE c.dst <> f.first_to
      UNION ALL SELECT set_id, 'package', 'cascade', 'package mapping of ''' || source || ''' would have cascaded onto the output ''' || target || '''; {note}', n_pairs FROM cs
      UNION ALL SELECT set_id, 'variable', 'overlap', 'variable mapping of ''' || source || ''' overlaps the output ''' || target || ''' (' || shared || '); {note} cascade', n_pairs FROM ov"""
    q["r8_invert_mappings"] = f"WITH {Q.MAPPINGS}, {VALID} SELECT set_id, kind, ord, dst AS source, frm AS target FROM vp"
    q["r9_mapping_fingerprint"] = f"""WITH {Q.MAPPINGS}, hs AS (SELECT set_id, sha256(kind || chr(31) || ord || chr(31) || frm || chr(31) || dst) AS h FROM mp),
      ls AS (SELECT set_id, count(*) AS n, {LANES} FROM hs GROUP BY set_id) SELECT set_id, sha256({LANE_TEXT}) AS mapping_sha256 FROM ls"""

    renamed_docs = f"{TEXT_RULES}, {DOCS}, {Q.rename_cte('src', 'doc_id', 'rn')}"
    q["w1_rename_text"] = f"WITH RECURSIVE {renamed_docs} SELECT doc_id, text FROM rn"
    q["w1_rename_conversations"] = f"""WITH RECURSIVE {TEXT_RULES}, src AS (SELECT conv_id, turn, text FROM conversations),
      {Q.rename_cte('src', 'conv_id, turn', 'rn')} SELECT conv_id, turn, text FROM rn"""
    q["w1_rename_many_rules"] = f"""WITH RECURSIVE {Q.WHOLE_MAPPINGS}, {Q.rules_cte()}, {DOCS},
      {Q.rename_cte('src', 'doc_id', 'rn', many=True)} SELECT doc_id, text, n::INT AS n FROM rn"""
    q["w2_count_substitutions"] = f"WITH RECURSIVE {renamed_docs} SELECT doc_id, n::INT AS n FROM rn"
    # occurrences per form: walk the chain of places again, keeping the matched text
    q["w3_substitution_report"] = f"""WITH RECURSIVE {renamed_docs},
      taken AS (SELECT w, p, n, q FROM rn_next WHERE (w, p) IN (SELECT (w, min(p)) FROM rn_best GROUP BY w)
        UNION ALL SELECT x.w, x.p, x.n, x.q FROM taken y JOIN rn_next x ON x.w = y.w AND x.p = y.q)
      SELECT substr(t.w, t.p, t.n) AS form, count(*) AS n_hits, count(DISTINCT doc_id) AS n_texts FROM rn_pieces s JOIN taken t ON t.w = s.piece GROUP BY 1"""
    q["w3_substitutions_by_source"] = f"""WITH RECURSIVE {renamed_docs} SELECT lang, source, count(*) AS n_texts, count(*) FILTER (rn.n > 0) AS n_touched, sum(rn.n)::BIGINT AS n_hits
      FROM documents JOIN rn USING (doc_id) GROUP BY lang, source"""
    web_paths = f"{Q.mapping_values(WEB_MAPPING, 'web')}, {Q.rules_cte(Q.REACT_VARIANTS)}"
    q["w4_rename_path"] = f"""WITH RECURSIVE {Q.REACT_FILES}, {web_paths}, src AS (SELECT project, path, path AS text FROM rf),
      {Q.rename_cte('src', 'project, path', 'rn')} SELECT project, path, text AS target FROM rn"""
    q["w4_java_output_path"] = f"WITH RECURSIVE {Q.JAVA_FILES}, {CODE_RULES}, {java_output_ctes('jf', 'op')} SELECT project, module_id, target FROM op"
    q["w5_strip_comments_java"] = f"WITH {CODE_AND_DOCS} SELECT id, {strip_java('text')} AS text FROM cd"
    q["w6_strip_comments_react"] = f"""WITH {Q.REACT_FILES}, nj AS (SELECT project, path, regexp_replace(text, '(?s)\\{{\\s*/\\*.*?\\*/\\s*\\}}', '', 'g') AS text FROM rf),
      {pieces_cte('nj', 'project, path', SEGMENT, 'cp')},
      nc AS (SELECT project, path, string_agg(gap || CASE WHEN starts_with(hit, '//') OR starts_with(hit, '/*') THEN '' ELSE coalesce(hit, '') END, '' ORDER BY k) AS text FROM cp GROUP BY ALL)
      SELECT project, path, regexp_replace(regexp_replace(text, '[ \\t]+\\n', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g') AS text FROM nc"""
    q["w7_strip_doc_tags"] = f"WITH {CODE_AND_DOCS} SELECT id, {strip_tags('text')} AS text FROM cd"
    q["w8_strip_loggers_java"] = f"WITH {Q.JAVA_FILES} SELECT project, path, {strip_java_log('text')} AS text FROM jf"
    q["w9_strip_loggers_react"] = f"WITH {Q.REACT_FILES} SELECT project, path, {strip_react_log('text')} AS text FROM rf"
    q["w10_sanitize"] = f"WITH RECURSIVE {SANITIZED_JAVA} SELECT project, path, {trim(strip_java_log('text'))} AS text FROM mk"
    q["w10_sanitize_pages"] = f"WITH RECURSIVE {SANITIZED_PAGES} SELECT page_id, {trim('text')} AS text FROM mk"
    q["w10_sanitize_react"] = f"WITH RECURSIVE {SANITIZED_REACT} SELECT project, path, {trim(strip_react_log('text'))} AS text FROM mk"

    q["l0_segments"] = f"""WITH {Q.REACT_FILES}, sg AS (SELECT 'page ' || page_id AS id, html AS text FROM pages UNION ALL SELECT project || '/' || path, text FROM rf),
      {pieces_cte('sg', 'id', SEGMENT, 'sp')}, un AS (SELECT id, 2 * k AS o, 'code' AS kind, gap AS text FROM sp WHERE gap <> ''
        UNION ALL SELECT id, 2 * k + 1, CASE WHEN starts_with(hit, '//') THEN 'line_comment' WHEN starts_with(hit, '/*') THEN 'block_comment'
          WHEN starts_with(hit, '`') THEN 'template' ELSE 'string' END, hit FROM sp WHERE hit IS NOT NULL)
      SELECT id, (row_number() OVER (PARTITION BY id ORDER BY o) - 1)::INT AS pos, kind, text FROM un"""
    q["l1_extract_literals"] = f"WITH {PAGE_LITERALS} SELECT page_id, (k - 1)::INT AS pos, hit AS literal FROM pp WHERE hit IS NOT NULL"
    events = f"ev AS (SELECT event_id, props AS text FROM events), {pieces_cte('ev', 'event_id', JAVA_STRING, 'ep')}"
    q["l1_extract_event_props"] = f"WITH {events} SELECT event_id, (k - 1)::INT AS pos, hit AS literal FROM ep WHERE hit IS NOT NULL"
    q["l1_extract_literals_react"] = f"""WITH {REACT_PIECES} SELECT project, path, (row_number() OVER (PARTITION BY project, path ORDER BY k) - 1)::INT AS pos,
      hit AS literal FROM rp WHERE {REACT_MASKABLE}"""
    q["l2_build_dictionary"] = f"WITH {PAGE_DICT} SELECT token, idx, literal FROM dict"
    q["l2_seeded_dictionary"] = f"""WITH {events}, {dictionary_cte('ep', 'event_id', 'd1')}, {PAGE_LITERALS},
      fresh AS (SELECT hit AS literal, row_number() OVER (ORDER BY min((page_id, k))) + (SELECT max(idx) FROM d1) AS idx FROM pp
        WHERE hit IS NOT NULL AND hit NOT IN (SELECT literal FROM d1) GROUP BY hit)
      SELECT token, idx, literal FROM d1 UNION ALL SELECT 'STR_' || idx, idx, literal FROM fresh"""
    q["l3_mask_literals"] = f"WITH {PAGE_DICT}, {masked_cte('pp', 'page_id', 'dict', 'mk')} SELECT page_id, text FROM mk"
    q["l3_mask_literals_react"] = f"""WITH {REACT_PIECES}, {dictionary_cte('rp', 'project, i', 'dict', REACT_MASKABLE)},
      {masked_cte('rp', 'project, path, i', 'dict', 'mk', REACT_MASKABLE)} SELECT project, path, text FROM mk"""
    q["l4_unmask_literals"] = f"WITH {PAGE_LITERALS} SELECT page_id, any_value(p.text) AS text, count(hit)::INT AS n_restored FROM pp JOIN pg p USING (page_id) GROUP BY page_id"

    # cleaning without stripping and undoing it gives the trimmed original
    q["v1_reverse_text"] = f"""WITH RECURSIVE {SANITIZED_PAGES}, cl AS (SELECT page_id, {trim('text')} AS text FROM mk),
      hits AS (SELECT page_id, count(hit)::INT AS n FROM sp GROUP BY page_id)
      SELECT page_id, {trim('html')} AS text, h.n AS strings_restored, c.text <> {trim('html')} AS changed FROM pages JOIN cl c USING (page_id) JOIN hits h USING (page_id)"""
    q["v2_leftover_tokens"] = f"""WITH {PAGE_LITERALS}, {dictionary_cte('pp', 'page_id', 'dict')}, lt AS (SELECT DISTINCT page_id, token FROM pp JOIN dict ON literal = hit)
      SELECT page_id, 'placeholder(s) found but the mapping has no literals — left as-is' AS reason, string_agg(token, ', ' ORDER BY token) AS tokens FROM lt GROUP BY page_id"""
    q["v3_rename_plan"] = f"WITH RECURSIVE {RETURNED} SELECT project, path, target, collision FROM plan"
    q["v3_collisions"] = f"WITH RECURSIVE {RETURNED} SELECT project, path, target FROM plan WHERE collision"
    q["v4_reversal_summary"] = f"""WITH RECURSIVE {Q.JAVA_FILES}, {CODE_RULES}, {java_path_ctes('jf', 'mv')}, {pieces_cte('jf', 'project, path', JAVA_STRING, 'sp')},
      ms AS (SELECT project, count(*) FILTER (path <> target) AS n_renamed FROM mv GROUP BY project), ls AS (SELECT project, count(hit) AS hits FROM sp GROUP BY project)
      SELECT project, count(*) AS n_files, count(*) AS n_changed, any_value(ms.n_renamed) AS n_renamed, 0::BIGINT AS n_collisions, any_value(ls.hits)::BIGINT AS strings_restored
      FROM jf JOIN ms USING (project) JOIN ls USING (project) GROUP BY project"""
    q["v5_pending_reversals"] = """WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS h FROM orders GROUP BY o_custkey)
      SELECT c_custkey::VARCHAR AS dataset_id, '1-URGENT' AS mapping_sha256 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM last WHERE h = '1-URGENT')"""
    q["a1_leak_audit"] = f"WITH RECURSIVE {renamed_docs} SELECT doc_id, n::INT AS n_hits, rn.text <> src.text AS would_change FROM rn JOIN src USING (doc_id) WHERE n > 0"
    # a target may hold another source (ZQ_OTHER holds THE): the audit must find exactly those
    q["a1_leak_audit_clean"] = f"WITH RECURSIVE {renamed_docs}, {Q.rename_cte('rn', 'doc_id', 'rb')} SELECT count(*) AS n_leaks FROM rb WHERE n > 0"
    stripped = trim(strip_tags(strip_java("text")))
    q["a2_round_trip_audit"] = f"""WITH {CODE_AND_DOCS}, came AS (SELECT project || '/' || path AS id FROM jf UNION ALL SELECT doc_id::VARCHAR FROM labels)
      SELECT cd.id, CASE WHEN came.id IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM cd LEFT JOIN came ON came.id = cd.id
      WHERE came.id IS NULL OR {stripped} <> {trim('text')}"""
    q["a2_merkle_audit"] = f"""WITH {Q.JAVA_FILES}, fl AS (SELECT project, path, text, true AS came FROM jf
        UNION ALL SELECT source, doc_id::VARCHAR, text, doc_id IN (SELECT doc_id FROM labels) FROM documents),
      sd AS (SELECT project, path, came, {trim('text')} AS was, {stripped} AS now FROM fl),
      sp AS (SELECT project, path, came, string_split(was, {NL}) AS a, string_split(now, {NL}) AS b FROM sd WHERE NOT came OR was <> now)
      SELECT project, path, CASE WHEN came THEN 'differs' ELSE 'missing' END AS problem,
        CASE WHEN came THEN list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]))::INT END AS line FROM sp"""
    last = "regexp_extract(module_id, '([^.]*)$', 1)"
    q["b1_bundles"] = bundle_query(JAVA_CLOSURE, v.SPRING, CODE_MAPPING, last, "jest")
    stem = "regexp_replace(regexp_extract(module_id, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')"
    folder = "regexp_extract(module_id, '([^/]*)/[^/]*$', 1)"
    q["b1_bundles_react"] = bundle_query(
        REACT_CLOSURE, v.REACT, WEB_MAPPING, f"CASE WHEN {stem} = 'index' AND {folder} <> '' THEN {folder} ELSE {stem} END", "vitest"
    )
    q["b2_extraction_plan"] = f"""WITH RECURSIVE {JAVA_CLOSURE}, {CODE_RULES}, js AS (SELECT project, path, text FROM jf), {Q.rename_cte('js', 'project, path', 'rn')},
      ids AS (SELECT DISTINCT project, module_id FROM closure), {java_output_ctes('ids', 'op')}
      SELECT c.project, c.entry, c.module_id, CASE WHEN found THEN 'write' ELSE 'skip' END AS action, CASE WHEN found THEN o.target END AS target, rn.n::INT AS substitutions
      FROM closure c JOIN op o USING (project, module_id) LEFT JOIN rn ON rn.project = c.project AND rn.path = c.path"""
    q["i1_sanitize_stream"] = q["w10_sanitize_pages"]
    q["u1_profiles"] = f"""WITH {both}, jq AS (SELECT project, path, text FROM jf), {pieces_cte('jq', 'project, path', JAVA_STRING, 'jp')},
      rq AS (SELECT project, path, text FROM rf), {pieces_cte('rq', 'project, path', SEGMENT, 'rp')},
      jn AS (SELECT project, path, count(hit)::INT AS c FROM jp GROUP BY ALL), rn AS (SELECT project, path, count(*) FILTER ({REACT_MASKABLE})::INT AS c FROM rp GROUP BY ALL)
      SELECT project, path, module_id, c AS n_literals, {java_type('module_id')} AS type, {strip_java_log('text')} AS text FROM jf JOIN jn USING (project, path)
      UNION ALL SELECT project, path, path, c, {react_type('path', 'text')}, {strip_react_log('text')} FROM rf JOIN rn USING (project, path)"""
    # the ways for large dictionaries give the same rows
    # a nested template is one segment, whatever it holds
    nested = """np AS (SELECT p_partkey, '`it' || chr(39) || 's // ' || repeat('${ x', p_size) || p_name || ' " ` ' || repeat('}', p_size) || '`' AS tpl,
      chr(39) || p_type || chr(39) AS str, '/* ' || p_brand || ' */' AS note FROM part)"""
    q["l0_nested_templates"] = f"""WITH {nested}, sg AS (SELECT p_partkey, unnest([{{'kind': 'code', 'text': 'const a = '}}, {{'kind': 'template', 'text': tpl}},
        {{'kind': 'code', 'text': ' + '}}, {{'kind': 'string', 'text': str}}, {{'kind': 'code', 'text': ';'}}, {{'kind': 'line_comment', 'text': '// size'}},
        {{'kind': 'code', 'text': {NL} || 'keep('}}, {{'kind': 'block_comment', 'text': note}}, {{'kind': 'code', 'text': ');' || {NL}}}]) AS s, unnest(range(9))::INT AS pos FROM np)
      SELECT p_partkey, pos, s.kind AS kind, s.text AS text FROM sg"""
    q["l1_nested_templates"] = f"WITH {nested} SELECT p_partkey, 0 AS pos, str AS literal FROM np"
    q["w6_nested_templates"] = f"WITH {nested} SELECT p_partkey, 'const a = ' || tpl || ' + ' || str || ';' || {NL} || 'keep();' || {NL} AS text FROM np"
    found = f"WITH RECURSIVE {JAVA_CLOSURE}, fd AS (SELECT DISTINCT project, path FROM closure WHERE found)"
    q["extract_end_to_end"] = f"{found} SELECT project, path AS source_path, false AS leaks FROM fd"
    q["restore_end_to_end"] = f"{found} SELECT project, path, {trim('text')} AS text FROM fd JOIN jf USING (project, path)"
    for name in (
        "w1_rename_text", "l3_mask_literals", "l4_unmask_literals", "w2_count_substitutions", "w3_substitution_report", "w4_rename_path",
        "w4_java_output_path", "v1_reverse_text", "a1_leak_audit",
    ):
        q[f"{name}_join"] = q[name]
    return dict(sorted(q.items()))
