r"""Plain SQL statements of the same results, for checking the queries.

Written for an engine with list functions and RE2 patterns. The bound tables are the only
thing shared with the queries; rules are stated again here, most of them by lines and
lists instead of the patterns the library uses.
"""

from __future__ import annotations

from docmetrics.operators import graph
from docmetrics.operators import history as hist
from docmetrics.plans import bindings as b
from docmetrics.plans import stored

NL = "chr(10)"
FN = (
    "('FUNCTION','ASYNC_FUNCTION','PROPERTY','STATICMETHOD','CLASSMETHOD','GET','POST','PUT',"
    "'DELETE','PATCH','HEAD','OPTIONS','TRACE','WEBSOCKET')"
)
EP = "('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS','TRACE','WEBSOCKET')"
NONE = "CAST([] AS VARCHAR[])"
GENERATED = "2024-01-31 00:00:00"


def rnd(x: str, digits: int) -> str:
    """Correctly rounded: C-style output of the stored value, read back."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def pct(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0.0::DOUBLE END)"


def n_if(test: str) -> str:
    return f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"


def listed(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda p: '''' || p || ''''), ', ') || ']'"


def pipe(x: str) -> str:
    return f"array_to_string({x}, '|')"


def has(x: str) -> str:
    return f"coalesce({x} <> '', false)"


def texty(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '\\S'), false)"


STYLE_WORDS = {
    "g": [r"(?:Args?|Arguments?):\s*\n", r"(?:Returns?|Return):\s*\n", r"(?:Yields?|Yield):\s*\n",
          r"(?:Raises?|Raise):\s*\n", r"(?:Note|Notes?):\s*\n", r"(?:Example|Examples?):\s*\n"],
    "n": [w + r"\s*\n\s*[-=]+" for w in ("Parameters", "Returns?", "Yields?", "Raises?", "Notes?", "Examples?")],
    "s": [r":param\s+\w+:", r":type\s+\w+:", r":returns?:", r":rtype:", r":raises?\s+\w+:", r":note:", r":example:"],
}


def hits(group: str) -> str:
    return " + ".join(
        f"CAST(coalesce(regexp_matches(fd, '(?i){p}'), false) AS INT)" for p in STYLE_WORDS[group]
    )


VIEWS: dict[str, tuple[list[str], str]] = {
    "items": ([], b.check_sql(b.ITEMS)),
    "f1": (["items"], f"""
SELECT *, CASE WHEN method IN {FN} THEN docstring END AS fd FROM items"""),
    "f2": (["f1"], rf"""
SELECT *, {hits('g')} AS hg, {hits('n')} AS hn, {hits('s')} AS hs,
 regexp_extract(regexp_extract(fd, '(?i)(?:Args?|Arguments?|Parameters?):\s*\n([^\n]*)', 1),
  '^\s+(\w+)(?:\s*\([^)]*\))?\s*:', 1) AS google_param,
 regexp_extract_all(fd, ':param\s+(\w+):', 1) AS sphinx_params,
 coalesce(regexp_matches(fd, '(?i)(?:Returns?|Yields?):|:returns?:'), false) AS has_return_doc,
 split(fd, {NL}) AS ls FROM f1"""),
    "f3": (["f2"], rf"""
SELECT *, CASE WHEN coalesce(fd, '') = '' THEN {NONE} WHEN google_param <> '' THEN [google_param]
  ELSE sphinx_params END AS documented_params,
 greatest(hg, hn, hs) AS top,
 list_position(list_transform(ls, lambda l: regexp_matches(l, '(?i)raises?:\s*$')), true) AS raise_at,
 CASE WHEN coalesce(fd, '') = '' THEN {NONE} ELSE
  regexp_extract_all(fd, ':raises?\s+(\w+(?:\.\w+)*\w):', 1) END AS sphinx_exc FROM f2"""),
    "f4": (["f3"], rf"""
SELECT *,
 list_filter(actual_params, lambda p: NOT list_contains(documented_params, p) AND NOT starts_with(p, '*')) AS missing_params,
 list_filter(documented_params, lambda p: NOT list_contains(actual_params, p)) AS extra_params,
 CASE WHEN coalesce(fd, '') <> '' THEN CASE WHEN top = 0 THEN 'plain' WHEN hg = top THEN 'google'
  WHEN hn = top THEN 'numpy' ELSE 'sphinx' END END AS docstring_style,
 list_filter(['google','numpy','sphinx'], lambda s: top > 0 AND CASE s WHEN 'google' THEN hg WHEN 'numpy' THEN hn ELSE hs END = top) AS leaders,
 CASE WHEN raise_at > 0 THEN list_filter(ls[raise_at + 1:], lambda l: true) ELSE {NONE} END AS after_raise,
 list_position(list_transform(ls, lambda l: regexp_matches(l, '^Raises?\s*$')), true) AS np_at FROM f3"""),
    "f5": (["f4"], rf"""
SELECT *,
 after_raise[coalesce(list_position(list_transform(after_raise, lambda l: l <> ''), true), 1):] AS body,
 CASE WHEN np_at > 0 AND regexp_matches(ls[np_at + 1], '^\s*[-=]+\s*$') THEN ls[np_at + 2:] ELSE {NONE} END AS np_body FROM f4"""),
    "f6": (["f5"], rf"""
SELECT *, list_position(list_transform(body, lambda l: trim(l) = '' OR NOT regexp_matches(l, '^\s')), true) AS stop_at FROM f5"""),
    "facts": (["f6"], rf"""
SELECT *,
 list_filter(list_transform(CASE WHEN stop_at > 0 THEN body[:stop_at - 1] ELSE body END,
  lambda l: regexp_extract(l || {NL}, '^\s+(\w+(?:\.\w+)*\w)(?:\s*:|\s+)', 1)), lambda x: x <> '') AS google_exc,
 list_filter(list_transform(np_body, lambda l: regexp_extract(l, '^\s+(\w+(?:Error|Exception))', 1)), lambda x: x <> '') AS numpy_exc,
 list_filter(list_transform(np_body, lambda l: regexp_extract(l, '^\s*(\w*(?:Error|Exception))', 1)), lambda x: x <> '') AS numpy_exc_section,
 list_transform(list_filter(range(1, len(ls) + 1), lambda i:
   regexp_matches(ls[i], '(?i)^\s*(args?|arguments?|returns?|yields?|raises?|notes?|examples?):\s*$')
   AND i < len(ls) AND ls[i + 1] = ''
   AND coalesce(NOT regexp_matches(list_filter(ls[i + 1:], lambda y: trim(y) <> '')[1], '^\s'), true)),
  lambda i: 'Empty ' || regexp_extract(ls[i], '(\w+):', 1) || ' section') AS google_issues,
 list_transform(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i], '^\s*\w+\s*$')
   AND regexp_matches(ls[i + 1], '^\s*[-=]+') AND len(regexp_extract(ls[i + 1], '[-=]+')) < len(trim(ls[i]))),
  lambda i: 'Underline too short for section ''' || trim(ls[i]) || '''') AS numpy_issues,
 list_sort(list_distinct(list_filter(sphinx_params, lambda p: NOT list_contains(regexp_extract_all(fd, ':type\s+(\w+):', 1), p)))) AS untyped
FROM f6"""),
    "issues": (["facts"], rf"""
SELECT *, list_concat(
 CASE WHEN len(leaders) > 1 THEN ['Mixed docstring styles detected: ' || {listed('leaders')}] ELSE {NONE} END,
 CASE docstring_style WHEN 'google' THEN google_issues WHEN 'numpy' THEN numpy_issues
  WHEN 'sphinx' THEN CASE WHEN len(untyped) > 0 THEN ['Missing type declarations for parameters: ' || {listed('untyped')}] ELSE {NONE} END
  ELSE {NONE} END) AS style_issues FROM facts"""),
    "s1": (["facts"], f"""
SELECT *, len(actual_params) AS n, len(missing_params) AS m, coalesce(length(docstring), 0) AS size,
 {has('docstring')} AS d, coalesce(return_type <> 'None' AND return_type <> '', false) AS r,
 coalesce(method IN {FN}, false) AS fn FROM facts"""),
    "scored": (["s1"], f"""
SELECT *,
 CAST(CASE WHEN fn THEN CASE WHEN d THEN 30 ELSE 0 END + CAST(floor(40 * CASE WHEN n > 0 THEN (n - m) / n ELSE 1::DOUBLE END) AS INT)
   + CASE WHEN r AND NOT has_return_doc THEN 0 ELSE 20 END + CASE WHEN has_type_hints THEN 10 ELSE 0 END
  WHEN method IN ('CLASS','PYDANTIC_MODEL','MODULE') THEN CASE WHEN d THEN 100 ELSE 0 END ELSE 0 END AS DOUBLE) AS coverage_score,
 CAST(CASE WHEN fn THEN CASE WHEN d THEN CASE WHEN size > 100 THEN 50 WHEN size > 50 THEN 30 WHEN size > 20 THEN 15 ELSE 0 END
    + CASE WHEN m = 0 AND n > 0 THEN 30 WHEN m < n / 2 THEN 15 ELSE 0 END + CASE WHEN has_return_doc THEN 20 ELSE 0 END ELSE 0 END
  WHEN method = 'PYDANTIC_MODEL' AND d THEN CASE WHEN size > 50 THEN 100 WHEN size > 20 THEN 70 ELSE 30 END
  WHEN method = 'CLASS' AND d THEN CASE WHEN size > 50 THEN 100 WHEN size > 20 THEN 60 ELSE 30 END
  WHEN method = 'MODULE' AND d THEN 100 ELSE 0 END AS DOUBLE) AS quality_score,
 CASE WHEN fn THEN size ELSE 0 END AS docstring_length,
 CASE WHEN fn THEN {rnd('''least(CASE WHEN n > 0 THEN (least(n / 10, 1::DOUBLE) + CASE WHEN has_type_hints THEN 0.8::DOUBLE ELSE 1.2::DOUBLE END) / 2
   ELSE CASE WHEN has_type_hints THEN 0.8::DOUBLE ELSE 1.2::DOUBLE END END * 100, 100::DOUBLE)''', 1)} ELSE 0 END AS complexity_score,
 CASE WHEN fn THEN {rnd('''(CASE WHEN size > 50 THEN 0.9::DOUBLE WHEN size > 20 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END
   + CASE WHEN n > 0 THEN (n - m) / n ELSE 1::DOUBLE END + CASE WHEN has_type_hints THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END
   + CASE WHEN NOT r THEN 0.8::DOUBLE WHEN has_return_doc THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END) / 4 * 100''', 1)} ELSE 0 END AS maintainability_score,
 CASE WHEN method IN {EP} THEN {rnd('''(CASE WHEN response_model <> '' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END
   + CASE WHEN len(status_codes) > 0 AND status_codes <> ['Default'] THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END
   + CASE WHEN len(tags) > 0 THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END
   + CASE WHEN operation_id <> '' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END
   + CASE WHEN len(dependencies) > 0 THEN len(list_filter(dependency_docs, lambda x: list_contains(documented_params, x.name))) / len(dependencies)
     ELSE 0.8::DOUBLE END) / 5 * 100''', 1)} ELSE 0 END AS api_completeness_score,
 list_filter([CASE WHEN fn AND NOT d THEN 'Missing docstring' END,
  CASE WHEN fn AND m > 0 THEN 'Missing parameter docs: ' || {listed('missing_params')} END,
  CASE WHEN fn AND r AND NOT has_return_doc THEN 'Missing return documentation' END,
  CASE WHEN fn AND NOT has_type_hints THEN 'Missing type hints' END,
  CASE WHEN method = 'PYDANTIC_MODEL' AND NOT d THEN 'Missing model docstring' END,
  CASE WHEN method = 'CLASS' AND NOT d THEN 'Missing class docstring' END,
  CASE WHEN method = 'MODULE' AND NOT d THEN 'Missing module docstring' END], lambda x: x IS NOT NULL) AS completeness_issues
FROM s1"""),
    "sections": (["items"], rf"""
SELECT item_ordinal, coalesce(list({{'s': s, 't': t}} ORDER BY i) FILTER (WHERE t <> '' AND NOT head), []) AS parts FROM (
 SELECT item_ordinal, i, t, mark IS NOT NULL AS head, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY item_ordinal ORDER BY i), 0) AS s FROM (
  SELECT *, CASE WHEN lower(t) LIKE 'args:%' OR lower(t) LIKE 'arguments:%' THEN 1 WHEN lower(t) LIKE 'returns:%' THEN 2 WHEN lower(t) LIKE 'raises:%' THEN 3 END AS mark FROM (
   SELECT item_ordinal, trim(unnest(ls)) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT item_ordinal, split(docstring, {NL}) AS ls FROM items WHERE docstring <> '') a) b) c) d GROUP BY item_ordinal"""),
    "usage0": ([], b.check_sql(b.USAGE)),
    "priced": (["usage0"], """
SELECT *, CAST(round(CAST(prompt_tokens AS DECIMAL(15,0)) * pin + CAST(completion_tokens AS DECIMAL(15,0)) * pout, 0) AS DECIMAL(26,0)) AS micro
FROM (SELECT *, CASE price_key WHEN 'o3' THEN 2.00 WHEN 'gpt-4.1' THEN 2.00 WHEN 'gpt-4o-mini' THEN 0.15
  WHEN 'gpt-4.1-nano-2025-04-14' THEN 0.10 ELSE 1.00 END::DECIMAL(10,4) AS pin,
 CASE price_key WHEN 'o3' THEN 8.00 WHEN 'gpt-4.1' THEN 8.00 WHEN 'gpt-4o-mini' THEN 0.60
  WHEN 'gpt-4.1-nano-2025-04-14' THEN 0.40 ELSE 3.00 END::DECIMAL(10,4) AS pout
 FROM (SELECT *, CASE WHEN model LIKE 'GPT-4.1-nano-2026%' THEN 'gpt-4.1' WHEN model LIKE 'other%' THEN 'default' ELSE model END AS price_key FROM usage0) a) x"""),
    "snaps": ([], f"""
SELECT *, {rnd(pct('documented_items', 'total_items'), 2)} AS coverage_percent FROM ({b.check_sql(b.SNAPSHOT_COUNTS)}) x"""),
    "groups0": ([], f"SELECT *, {pct('documented', 'total')} AS coverage FROM ({b.check_sql(b.GROUP_COUNTS)}) x"),
    "src": ([], b.check_sql(b.source_sql())),
    "good_part": ([], "SELECT *, '/src/' || p_type || '/part' || p_partkey || '.py' AS file_path FROM part WHERE p_size % 17 <> 0"),
    "cls": (["items"], """
SELECT project, qualname, module, signature, docstring, file_path, item_ordinal FROM (
 SELECT *, row_number() OVER (PARTITION BY project, qualname ORDER BY file_path DESC, item_ordinal DESC) AS rn
 FROM items WHERE method IN ('CLASS','PYDANTIC_MODEL')) x WHERE rn = 1"""),
    "members": (["items"], """
SELECT i.project, i.file_path, i.item_ordinal, regexp_extract(qualname, '^(.*)\\.', 1) AS owner,
 regexp_extract(qualname, '([^.]*)$', 1) AS name, starts_with(regexp_extract(qualname, '([^.]*)$', 1), '_') AS is_private,
 method = 'PROPERTY' AS is_attribute, method, return_type, param_types FROM items i
WHERE method IN ('FUNCTION','ASYNC_FUNCTION','PROPERTY') AND contains(qualname, '.')
 AND EXISTS (SELECT 1 FROM items c WHERE c.method IN ('CLASS','PYDANTIC_MODEL') AND c.project = i.project
  AND c.file_path = i.file_path AND c.qualname = regexp_extract(i.qualname, '^(.*)\\.', 1))"""),
    "members_text": (["members"], """
SELECT *, CASE WHEN is_private THEN '-' ELSE '+' END || ' ' || CASE WHEN is_attribute THEN name ELSE
  CASE WHEN method = 'ASYNC_FUNCTION' THEN 'async ' ELSE '' END || name || '(' ||
  array_to_string(list_transform(param_types, lambda p: p.name || ': ' || p.type), ', ') || ')' END
  || coalesce(' : ' || return_type, '') AS text,
 CASE WHEN is_attribute THEN CASE WHEN is_private THEN '-' ELSE '+' END || ' ' || name || coalesce(' : ' || return_type, '')
  ELSE '+ ' || CASE WHEN method = 'ASYNC_FUNCTION' THEN 'async ' ELSE '' END || name || '()' END AS brief FROM members"""),
    "uml": (["cls", "members"], """
SELECT c.project, c.qualname, coalesce(module, '') AS package, c.file_path, c.item_ordinal,
 CASE WHEN contains(lower(qualname), 'service') THEN 'service'
  WHEN contains(lower(qualname), 'model') OR contains(lower(qualname), 'schema') THEN 'model'
  WHEN contains(lower(qualname), 'repository') OR contains(lower(qualname), 'dao') THEN 'repository'
  WHEN contains(lower(qualname), 'controller') OR contains(lower(qualname), 'router') THEN 'controller'
  WHEN contains(lower(qualname), 'config') THEN 'configuration'
  WHEN contains(signature, 'BaseModel') OR contains(signature, 'Schema') THEN 'model'
  WHEN contains(signature, 'Protocol') THEN 'interface' ELSE '-' END AS stereotype,
 contains(signature, 'ABC') OR coalesce(contains(lower(docstring), 'abstract'), false) AS is_abstract,
 coalesce(k.methods, 0) AS methods, coalesce(k.attributes, 0) AS attributes
FROM cls c LEFT JOIN (SELECT project, file_path, owner, count(*) FILTER (NOT is_attribute) AS methods,
 count(*) FILTER (is_attribute) AS attributes FROM members GROUP BY ALL) k
 ON k.project = c.project AND k.file_path = c.file_path AND k.owner = c.qualname"""),
    "chosen": (["uml"], " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{name}' AS diagram, *, row_number() OVER (PARTITION BY project ORDER BY file_path, item_ordinal) AS place
 FROM uml WHERE NOT starts_with(qualname, '_') AND NOT contains(package, 'builtins') AND NOT contains(package, 'typing')
  AND NOT contains(package, 'collections'){extra}) x WHERE place <= {k}"""
        for name, k, extra in [
            ("overview", 15, ""), ("detailed", 10, ""),
            ("fastapi", 20, " AND regexp_matches(lower(qualname), 'router|endpoint|service|model|schema|dependency')"),
        ])),
    "edges0": (["items"], rf"""
SELECT project, item_ordinal, file_path, qualname AS source, trim(unnest(split(regexp_extract(signature, 'inherits=\(([^)]*)\)', 1), ','))) AS target,
  'INHERITANCE' AS relationship_type, '-' AS label, '-' AS stereotype FROM items
 WHERE method IN ('CLASS','PYDANTIC_MODEL') AND contains(signature, 'inherits=(')
UNION ALL SELECT project, item_ordinal, file_path, left(qualname, length(qualname) - 9), p.type, 'COMPOSITION', p.name, '-'
 FROM (SELECT *, unnest(param_types) AS p FROM items WHERE method = 'FUNCTION' AND ends_with(qualname, '.__init__')) x WHERE p.type NOT IN ('str')
UNION ALL SELECT project, item_ordinal, file_path, qualname, d, 'DEPENDENCY', '-', 'depends'
 FROM (SELECT *, unnest(dependencies) AS d FROM items) x WHERE d <> qualname
UNION ALL SELECT project, item_ordinal, file_path, CASE WHEN contains(qualname, '.') THEN regexp_extract(qualname, '^(.*)\.', 1) ELSE qualname END,
  p.type, 'ASSOCIATION', 'uses(' || p.name || ')', '-'
 FROM (SELECT *, unnest(param_types) AS p FROM items WHERE method IN ('FUNCTION','ASYNC_FUNCTION') AND NOT ends_with(qualname, '.__init__')) x WHERE p.type NOT IN ('str')
UNION ALL SELECT project, item_ordinal, file_path, CASE WHEN contains(qualname, '.') THEN regexp_extract(qualname, '^(.*)\.', 1) ELSE qualname END,
  return_type, 'ASSOCIATION', 'returns', '-' FROM items WHERE method IN ('FUNCTION','ASYNC_FUNCTION') AND return_type <> '' AND return_type NOT LIKE 'list[%'
UNION ALL SELECT project, item_ordinal, file_path, unnest(tags) || 'Router', qualname, 'COMPOSITION', '-', 'router' FROM items"""),
    "drawn": (["edges0"], """
SELECT *, source || CASE relationship_type WHEN 'INHERITANCE' THEN ' --|> ' WHEN 'COMPOSITION' THEN ' *-- '
 WHEN 'DEPENDENCY' THEN ' ..> ' ELSE ' --> ' END || target || CASE WHEN label <> '-' THEN ' : ' || label ELSE '' END AS text FROM edges0"""),
    "pstats": (["items"], f"""
SELECT *, total - documented AS missing, {rnd(pct('documented', 'total'), 1)} AS coverage FROM (
 SELECT project, count(*) AS total, {n_if(texty('docstring'))} AS documented, {n_if("method = 'MODULE'")} AS modules,
  {n_if("method = 'CLASS'")} AS classes, {n_if("method = 'FUNCTION'")} AS functions, {n_if(f"method IN {EP}")} AS endpoints
 FROM items GROUP BY project) x"""),
    "nodes": (["items"], """
SELECT project, lang AS path, '' AS parent, lang AS name, 1 AS depth, 0 AS items, lang AS sort_key FROM (
  SELECT DISTINCT project, split_part(module, '.', 1) AS lang FROM items WHERE module <> '') x
UNION ALL SELECT project, module, split_part(module, '.', 1), split_part(module, '.', 2), 2, count(*), replace(module, '.', chr(1))
 FROM items WHERE module <> '' GROUP BY project, module"""),
    "tree0": (["nodes"], """
SELECT *, name = max(name) OVER (PARTITION BY project, parent, depth) AS is_last FROM nodes"""),
    "tree": (["tree0"], """
SELECT t.*, CASE WHEN t.depth = 1 THEN '' WHEN u.is_last THEN '    ' ELSE '│   ' END AS above,
 CASE WHEN t.is_last THEN '└── ' ELSE '├── ' END AS mark
FROM tree0 t LEFT JOIN tree0 u ON u.project = t.project AND u.path = t.parent AND u.depth = 1"""),
    "tree_text": (["tree", "items"], """
SELECT project, sort_key AS k1, -1 AS k2, above || mark || name AS text FROM tree
UNION ALL SELECT i.project, t.sort_key || chr(1) || chr(1) || i.file_path, i.item_ordinal, t.above || CASE WHEN t.is_last THEN '    ' ELSE '│   ' END
  || CASE WHEN row_number() OVER (PARTITION BY i.project, i.module ORDER BY i.file_path DESC, i.item_ordinal DESC) = 1 THEN '└── ' ELSE '├── ' END
  || i.qualname || ' (' || i.method || ')'
 FROM items i JOIN tree t ON t.project = i.project AND t.path = i.module AND t.depth = 2 WHERE i.module <> ''"""),
    "over": ([], f"SELECT project, project_purpose, coalesce(business_context, '') AS business_context, key_business_value FROM ({b.check_sql(b.OVERVIEWS)}) x"),
    "bare": (["items"], f"SELECT *, coalesce(nullif(module, ''), 'Unknown') AS listed_module FROM items WHERE NOT {texty('docstring')}"),
    "longest": (["items"], """
SELECT project, qualname, module, length(docstring) AS length, file_path, item_ordinal, row_number() OVER (PARTITION BY project
 ORDER BY length(docstring) DESC, file_path, item_ordinal) AS place FROM items WHERE length(docstring) > 100"""),
}


def needs(views: list[str]) -> list[str]:
    out: list[str] = []
    for v in views:
        for x in [*needs(VIEWS[v][0]), v]:
            if x not in out:
                out.append(x)
    return out


def sql(body: str, *views: str) -> str:
    ctes = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in needs(list(views)))
    return f"WITH {ctes} {body}" if ctes else body


def lines(kind: str, parts: list[tuple[int, str, str, str, str]]) -> str:
    """Page lines: each part is section, k1, k2, from, and the list of its texts."""
    return " UNION ALL ".join(
        f"""SELECT project, '{kind}' AS page_kind, {section} AS section, k1, k2, line_no - 1 AS line_no, text FROM (
 SELECT project, k1, k2, unnest(ts) AS text, generate_subscripts(ts, 1) AS line_no FROM (
  SELECT project, {k1} AS k1, CAST({k2} AS BIGINT) AS k2, list_filter([{texts}], lambda x: x IS NOT NULL) AS ts FROM {source}) a) x"""
        for section, k1, k2, source, texts in parts
    )


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(*xs: str) -> str:
    """Constant lines."""
    return ", ".join(q(x) for x in xs)


METRICS = (
    "'| Metric | Value |', '|--------|-------|', '| Total Items | ' || total || ' |', '| Documented | ' || documented || ' |',"
    " '| Coverage | ' || coverage || '% |', '| Modules | ' || modules || ' |', '| Classes | ' || classes || ' |',"
    " '| Functions | ' || functions || ' |'"
)
SUMMARY = "CASE WHEN docstring <> '' THEN '  - ' || split_part(docstring, chr(10), 1) END"


def overview_texts(heading: str) -> str:
    shown = f"({texty('project_purpose')} OR {texty('business_context')} OR {texty('key_business_value')})"
    out = [f"CASE WHEN {shown} THEN {q(heading)} END", f"CASE WHEN {shown} THEN '' END"]
    for label, name in [("Project Purpose", "project_purpose"), ("Business Context", "business_context"),
                        ("Key Business Value", "key_business_value")]:
        out += [f"CASE WHEN {shown} AND {name} <> '' THEN '**{label}:** ' || {name} END",
                f"CASE WHEN {shown} AND {name} <> '' THEN '' END"]
    return ", ".join(out)


OVER_JOIN = "(SELECT s.*, o.project_purpose, o.business_context, o.key_business_value FROM pstats s LEFT JOIN over o ON o.project = s.project) z"


def latex(x: str) -> str:
    for old, new in [("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("$", "\\$"), ("&", "\\&"), ("%", "\\%"),
                     ("#", "\\#"), ("^", "\\textasciicircum{}"), ("_", "\\_"), ("~", "\\textasciitilde{}")]:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def storage(x: str) -> str:
    """Markdown to wiki markup; lists and table rows are worked on a list of lines."""
    for pattern, target in [
        (r"(?m)^### (.+)$", r"<h3>\1</h3>"), (r"(?m)^## (.+)$", r"<h2>\1</h2>"), (r"(?m)^# (.+)$", r"<h1>\1</h1>"),
        (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"),
        (r"(?s)```(\w+)\n(.*?)\n```", r'<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">\1</ac:parameter><ac:plain-text-body><![CDATA[\2]]></ac:plain-text-body></ac:structured-macro>'),
        (r"(?s)```\n(.*?)\n```", r'<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">text</ac:parameter><ac:plain-text-body><![CDATA[\1]]></ac:plain-text-body></ac:structured-macro>'),
        (r"`([^`]+)`", r"<code>\1</code>"), (r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>'),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{target}', 'g')"
    return x


STORAGE_LINES = """
SELECT doc_id, list_transform(range(1, len(ls) + 1), lambda i:
 CASE WHEN bullet[i] AND NOT coalesce(bullet[i - 1], false) THEN '<ul>' || chr(10) WHEN coalesce(bullet[i - 1], false) AND NOT bullet[i] THEN '</ul>' || chr(10) ELSE '' END
 || CASE WHEN regexp_matches(it[i], '\\|.+\\|') THEN
   left(it[i], strpos(it[i], '|') - 1) || CASE WHEN len(list_filter(cells[i], lambda c: NOT contains(c, '---'))) = 0 THEN '' ELSE
    '<tr>' || array_to_string(list_transform(cells[i], lambda c: '<td>' || trim(c) || '</td>'), '') || '</tr>' END
   || regexp_extract(it[i], '([^|]*)$', 1) ELSE it[i] END
 || CASE WHEN bullet[i] AND i = len(ls) THEN chr(10) || '</ul>' ELSE '' END) AS done
FROM (SELECT *, list_transform(it, lambda l: split(trim(regexp_extract(l, '\\|.+\\|'), '|'), '|')) AS cells FROM (
 SELECT *, list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN bullet[i] THEN '<li>' || trim(ls[i])[3:] || '</li>' ELSE ls[i] END) AS it FROM (
  SELECT *, list_transform(ls, lambda l: starts_with(trim(l), '- ')) AS bullet FROM (SELECT doc_id, split(%s, chr(10)) AS ls FROM (%s) m) a) b) c) d
"""


def storage_md5() -> str:
    x = "'<p>' || replace(array_to_string(done, chr(10)), chr(10) || chr(10), '</p><p>') || '</p>'"
    for pattern, target in [(r"<p>\s*</p>", ""), (r"<p>(<h[1-6]>)", r"\1"), (r"(</h[1-6]>)</p>", r"\1")]:
        x = f"regexp_replace({x}, '{pattern}', '{target}', 'g')"
    return f"SELECT doc_id, md5({x}) AS storage_md5 FROM ({STORAGE_LINES % (storage('md'), b.check_sql(b.MARKDOWN))}) y"


def price_doc(doc: str = "'Price of ' || p_name || '.' || chr(10) || chr(10) || 'Args:' || chr(10) || '    qty: how many'") -> str:
    return doc


def part_items(columns: dict[str, tuple[str, str, str, str, str, str, str, str]]) -> str:
    """One select per item kind of a part file; each column gives a value per kind in order:
    module, title, debug, class, price, read, endpoint."""
    parts = []
    for i in range(7):
        parts.append("SELECT " + ", ".join(f"{v[i]} AS {k}" for k, v in columns.items()) + " FROM good_part")
    return " UNION ALL ".join(parts)


_READ_DOC = "CASE WHEN p_size % 3 = 0 THEN 'Read one.' END"
_CLASS_KIND = "CASE WHEN p_size % 2 = 0 THEN 'PYDANTIC_MODEL' ELSE 'CLASS' END"
_CLASS_SIG = "'inherits=(' || CASE WHEN p_size % 2 = 0 THEN 'BaseModel' ELSE 'Base' END || ')'"
_READ_SIG = "'limit: int=' || p_size || ', db=Depends(get_db)'"
_PRICE_SRC = (
    "'def price(self, qty: int, rate=1, *rest) -> float:' || chr(10) || '        \"\"\"Price of ' || p_name || '.' || chr(10)"
    " || chr(10) || '        Args:' || chr(10) || '            qty: how many' || chr(10) || '        \"\"\"' || chr(10)"
    " || '        if qty < 0:' || chr(10) || '            raise ValueError(qty)' || chr(10) || '        return qty * ' || p_size"
)
_READ_SRC = (
    "'async def read(limit: int = ' || p_size || ', db=Depends(get_db)):' || chr(10)"
    " || CASE WHEN p_size % 3 = 0 THEN '    \"\"\"Read one.\"\"\"' || chr(10) ELSE '' END || '    return limit'"
)
_CLASS_SRC = (
    "'class Part' || p_partkey || '(' || CASE WHEN p_size % 2 = 0 THEN 'BaseModel' ELSE 'Base' END || '):' || chr(10)"
    f" || '    size: int = ' || p_size || chr(10) || chr(10) || '    ' || {_PRICE_SRC}"
)
_E = "''"
PART_ITEMS = {
    "project": ("p_brand",) * 7,
    "file_path": ("file_path",) * 7,
    "module": ("'part' || p_partkey",) * 7,
    "qualname": ("'<module>'", "'app'", "'app'", "'Part' || p_partkey", "'Part' || p_partkey || '.price'", "'read'", "'read'"),
    "path": (_E, _E, _E, _E, _E, _E, "'/parts/' || p_partkey"),
    "method": ("'MODULE'", "'METADATA'", "'METADATA'", _CLASS_KIND, "'FUNCTION'", "'ASYNC_FUNCTION'", "'GET'"),
    "signature": (_E, "'title'", "'debug'", _CLASS_SIG, "'self, qty: int, rate=1, *rest'", _READ_SIG, _READ_SIG),
    "docstring": ("'Module of ' || p_name || '.'", "p_brand", "'True'", "NULL", price_doc(), _READ_DOC, _READ_DOC),
    "lineno": ("1", "2", "2", "3", "6", "17", "17"),
    "first_lines": (_E, _E, _E, _E,
                    "array_to_string(split(" + _PRICE_SRC + ", chr(10))[2:6], chr(10))",
                    "array_to_string(split(" + _READ_SRC + ", chr(10))[2:6], chr(10))",
                    "array_to_string(split(" + _READ_SRC + ", chr(10))[2:6], chr(10))"),
    "full_source": (_E, _E, _E, _CLASS_SRC, _PRICE_SRC, _READ_SRC, _READ_SRC),
    "actual_params": (_E, _E, _E, _E, "'qty|rate|*rest'", "'limit|db'", "'limit|db'"),
    "types": (_E, _E, _E, "CASE WHEN p_size % 2 = 0 THEN 'size:int' ELSE '' END", "'qty:int'", "'limit:int'", "'limit:int'"),
    "return_type": ("NULL", "NULL", "NULL", "NULL", "'float'", "NULL", "NULL"),
    "has_type_hints": ("false", "false", "false", "false", "true", "true", "true"),
    "raised_exceptions": (_E, _E, _E, _E, "'ValueError'", _E, _E),
    "dependencies": (_E, _E, _E, _E, _E, "'get_db'", "'get_db'"),
    "tags": (_E, _E, _E, _E, _E, _E, "p_type"),
    "response_model": ("NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'Part'"),
}
_D3 = "CASE WHEN p_size % 3 = 0 THEN {} ELSE {} END"
_READ_ISSUES = "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Missing docstring|' END || 'Missing parameter docs: [''limit'', ''db'']'"
_PRICE_LEN = f"length({price_doc()})"
# method score: n=3, m=1, return float undocumented, hints; read: n=2, m=2, no return, hints.
PART_SCORES = {
    "file_path": PART_ITEMS["file_path"], "qualname": PART_ITEMS["qualname"], "method": PART_ITEMS["method"],
    "signature": PART_ITEMS["signature"],
    "documented_params": (_E, _E, _E, _E, "'qty'", _E, _E),
    "missing_params": (_E, _E, _E, _E, "'rate'", "'limit|db'", "'limit|db'"),
    "coverage_score": ("100", "0", "0", "0", "66", _D3.format(60, 30), _D3.format(60, 30)),
    "quality_score": ("100", "0", "0", "0",
                      f"CASE WHEN {_PRICE_LEN} > 50 THEN 45 WHEN {_PRICE_LEN} > 20 THEN 30 ELSE 15 END", "0", "0"),
    "completeness_issues": (_E, _E, _E, "CASE WHEN p_size % 2 = 0 THEN 'Missing model docstring' ELSE 'Missing class docstring' END",
                            "'Missing parameter docs: [''rate'']|Missing return documentation'", _READ_ISSUES, _READ_ISSUES),
    "docstring_style": ("NULL", "NULL", "NULL", "NULL", "'google'", _D3.format("'plain'", "NULL"), _D3.format("'plain'", "NULL")),
    "docstring_length": ("0", "0", "0", "0", _PRICE_LEN, _D3.format(9, 0), _D3.format(9, 0)),
    "complexity_score": ("0", "0", "0", "0", "55", "50", "50"),
    "maintainability_score": ("0", "0", "0", "0",
        f"{rnd(f'(CASE WHEN {_PRICE_LEN} > 50 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END + 2 / 3 + 0.9::DOUBLE + 0.5::DOUBLE) / 4 * 100', 1)}",
        "50", "50"),
    # endpoint: model .9, no status codes .6, tags .8, no id .5, one dependency not described 0
    "api_completeness_score": ("0", "0", "0", "0", "0", "0", "56"),
}
for _k in ("coverage_score", "quality_score", "complexity_score", "maintainability_score", "api_completeness_score"):
    PART_SCORES[_k] = tuple(f"CAST({v} AS DOUBLE)" for v in PART_SCORES[_k])

PATCHED = (
    f"CASE WHEN p_size % 17 = 0 THEN ({b.check_sql(b.part_source())}) ELSE "
    f"replace({b.check_sql(b.part_source(b.PATCHED_DOC))}, '\"\"\"Module of ' || p_name || '.\"\"\"' || chr(10),"
    " '\"\"\"' || chr(10) || 'About ' || p_type || '.' || chr(10) || '\"\"\"' || chr(10)) END"
)
PART_PATH = "'/src/' || p_type || '/part' || p_partkey || '.py'"
IN_GROUPS = "FROM groups0 WHERE level = 'module'"
TRENDS = f"""
SELECT project, period_days, n AS records_found, CASE WHEN n = 0 THEN 'no_data' WHEN c > 1 THEN 'improving' WHEN c < -1 THEN 'declining' ELSE 'stable' END AS trend,
 round(c, 2) AS coverage_change, i AS items_change, d AS documented_change FROM (
 SELECT project, period_days, count(*) AS n, arg_max(coverage_percent, ts) - arg_min(coverage_percent, ts) AS c,
  arg_max(total_items, ts) - arg_min(total_items, ts) AS i, arg_max(documented_items, ts) - arg_min(documented_items, ts) AS d
 FROM snaps, (SELECT 7 AS period_days UNION ALL SELECT 30) p WHERE ts >= TIMESTAMP '2024-01-31' - to_days(period_days) GROUP BY 1, 2) x"""
LEVEL_TEXT = (
    f"CASE WHEN coverage_percent < 30 THEN {q(hist.CRITICAL)} WHEN coverage_percent < 60 THEN {q(hist.WARNING)}"
    f" WHEN coverage_percent < 80 THEN {q(hist.GOOD)} ELSE {q(hist.EXCELLENT)} END"
)
LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC) AS rn FROM snaps) l WHERE rn = 1)"
ADVICE = f"""
SELECT project, 1 AS section, 1 AS place, {LEVEL_TEXT} AS text FROM {LATEST} a
UNION ALL SELECT project, 2, 1, CASE trend WHEN 'declining' THEN {q(hist.DECLINING)} ELSE {q(hist.IMPROVING)} END
 FROM ({TRENDS}) t WHERE period_days = 30 AND trend IN ('declining', 'improving')
UNION ALL SELECT project, 3, row_number() OVER (PARTITION BY project ORDER BY first_seen),
 '🔗 Focus on documenting ' || name || ' endpoints - only ' || printf('%.1f', coverage) || '% are documented.'
 FROM groups0 WHERE level = 'method' AND coverage < 50 AND name IN ('GET','POST','PUT','DELETE')
UNION ALL SELECT project, 4, rn, '📁 Module ''' || name || ''' needs attention - only ' || printf('%.1f', coverage) || '% documented.'
 FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY coverage, first_seen) AS rn {IN_GROUPS}) w WHERE rn <= 3 AND coverage < 40"""
BEST_WORST = f"""
SELECT project, name, total, documented, coverage, place, 'best' AS "end" FROM (
 SELECT *, row_number() OVER (PARTITION BY project ORDER BY coverage DESC, first_seen) AS place {IN_GROUPS}) x WHERE place <= 5
UNION ALL SELECT project, name, total, documented, coverage, place, 'worst' FROM (
 SELECT *, row_number() OVER (PARTITION BY project ORDER BY coverage DESC, first_seen) AS place, count(*) OVER (PARTITION BY project) AS n {IN_GROUPS}) x WHERE place > n - 5"""
COST = "CAST(CAST(sum(micro / 1000000) AS DECIMAL(20,6)) AS DOUBLE)"


def cost(when: str | None = None) -> str:
    total = "sum(micro)" if when is None else f"coalesce(sum(CASE WHEN {when} THEN micro END), 0)"
    return f"CAST({total} AS DOUBLE) / 1000000"


COVER = f"count(*) AS total, {n_if(has('docstring'))} AS documented"


def covered(select: str, group: str, source: str = "items") -> str:
    return f"SELECT *, {pct('documented', 'total')} AS coverage FROM (SELECT {select}, {COVER} FROM {source} GROUP BY {group}) x"


KIND = "coalesce(method, 'UNKNOWN')"
MODULE = "coalesce(module, 'unknown')"
_LEVELS = [("project", "''", "project"), ("method", KIND, "project, " + KIND), ("module", MODULE, "project, " + MODULE)]
SNAPSHOT = " UNION ALL ".join(
    f"""SELECT project, '{level}' AS level, {name} AS name, {COVER},
 arg_min(file_path, {{order}}) AS first_file, arg_min(item_ordinal, {{order}}) AS first_item FROM items GROUP BY {group}"""
    for level, name, group in _LEVELS
).format(order="struct_pack(f := file_path, i := item_ordinal)")
FLAT = "project, item_ordinal, source, target, relationship_type, label, stereotype"
GAP = "unnest(list_distinct(list_concat(actual_params, documented_params)))"
KEY = "file_path"

def pairs_of(section: int) -> str:
    return (
        f"list_filter(parts, lambda p: p.s = {section} AND NOT ends_with(p.t, ':') AND contains(p.t, ':'))"
    )


NAME, TOLD = "trim(split_part(p.t, ':', 1))", "trim(p.t[strpos(p.t, ':') + 1:])"
ENDPOINT_BODY = f"""
SELECT s.project, s.item_ordinal, 'API: ' || method || ' ' || path AS title, array_to_string(list_filter([
 '<h2>Endpoint Details</h2><table><tbody>', '<tr><th>Method</th><td><code>' || method || '</code></td></tr>',
 '<tr><th>Path</th><td><code>' || path || '</code></td></tr>', '<tr><th>Module</th><td>' || coalesce(module, 'N/A') || '</td></tr>',
 '<tr><th>Function</th><td><code>' || qualname || '</code></td></tr>', '</tbody></table><h2>Description</h2>',
 '<p>' || CASE WHEN parts IS NULL THEN 'No description available' ELSE array_to_string(list_transform(list_filter(parts, lambda p: p.s = 0), lambda p: p.t || ' '), '') END || '</p>',
 CASE WHEN len({pairs_of(1)}) > 0 THEN '<h2>Parameters</h2><table><thead><tr><th>Name</th><th>Description</th></tr></thead><tbody>'
  || array_to_string(list_transform({pairs_of(1)}, lambda p: '<tr><td><code>' || {NAME} || '</code></td><td>' || {TOLD} || '</td></tr>'), '') || '</tbody></table>' END,
 CASE WHEN len(list_filter(parts, lambda p: p.s = 2 AND NOT ends_with(p.t, ':'))) > 0 THEN '<h2>Returns</h2><p>'
  || array_to_string(list_transform(list_filter(parts, lambda p: p.s = 2 AND NOT ends_with(p.t, ':')), lambda p: p.t || ' '), '') || '</p>' END,
 CASE WHEN len({pairs_of(3)}) > 0 THEN '<h2>Exceptions</h2><ul>'
  || array_to_string(list_transform({pairs_of(3)}, lambda p: '<li><code>' || {NAME} || '</code>: ' || {TOLD} || '</li>'), '') || '</ul>' END,
 '<h2>Metadata</h2><table><tbody>', '<tr><th>Documentation Coverage</th><td>' || coverage_score || '%</td></tr>', '</tbody></table>'], lambda x: x IS NOT NULL), chr(10)) AS body
FROM scored s LEFT JOIN sections e ON e.item_ordinal = s.item_ordinal WHERE method IN {EP}"""


def titled(x: str) -> str:
    return f"array_to_string(list_transform(split(lower(replace({x}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


LATEX_KINDS = f"({covered(f'project, {KIND} AS method', f'project, {KIND}')}) ck"
LATEX_TOTAL = (
    f"(SELECT *, {pct('documented', 'total')} AS coverage FROM (SELECT project, count(*) AS total, {n_if(texty('docstring'))} AS documented,"
    " count(DISTINCT module) AS n_modules FROM items GROUP BY 1) u) ct"
)
LATEX_LINES = lines("latex", [
    (0, "''", "0", LATEX_TOTAL, r"'\subsection{Documentation Statistics}', '\begin{itemize}', '    \item \textbf{Total Items:} ' || total, '    \item \textbf{Documented Items:} ' || documented, '    \item \textbf{Coverage:} ' || printf('%.1f', coverage) || '\%', '    \item \textbf{Modules:} ' || n_modules, '\end{itemize}', '\subsection{Project Modules}', '\begin{itemize}'"),
    (1, "module", "0", "(SELECT DISTINCT project, module FROM items WHERE module <> '') z", r"'    \item \texttt{' || " + latex("module") + " || '}'"),
    (2, "''", "0", LATEX_TOTAL, r"'\end{itemize}', '\section{Code Documentation}'"),
    (3, "method", "0", LATEX_KINDS, r"'\subsection{' || " + titled("method") + " || '}'"),
    (3, f"{KIND} || chr(1) || {KEY}", "item_ordinal", "items",
     r"'\subsubsection{\texttt{' || " + latex("qualname") + r" || '}}', '\begin{itemize}', '    \item \textbf{Module:} \texttt{' || coalesce(" + latex("module")
     + r", '') || '}', '    \item \textbf{File:} \texttt{' || " + latex("file_path") + r" || '}', '    \item \textbf{Line:} ' || lineno, '\end{itemize}', CASE WHEN docstring <> '' THEN '\paragraph{Documentation:}' || chr(10) || '\begin{quote}' || chr(10) || "
     + latex("docstring") + r" || chr(10) || '\end{quote}' ELSE '\paragraph{Documentation:} \textit{No documentation available}' END, '\vspace{1em}'"),
    (4, "''", "0", LATEX_TOTAL, r"'\section{Coverage Analysis}'"),
    (5, "method", "0", LATEX_KINDS, r"'\subsection{' || " + titled("method") + r" || ' Coverage}', total || ' total items, ' || documented || ' documented (' || printf('%.1f', coverage) || '\%).'"),
])


def diagram(name: str) -> str:
    config = graph.DIAGRAMS[name]
    head = graph.HEADER + [
        x
        for mark, fill, border in graph.STEREOTYPE_COLORS
        for x in (f"skinparam class<<{mark}>>BackgroundColor {fill}", f"skinparam class<<{mark}>>BorderColor {border}")
    ] + ["", config.direction, ""]
    placed = f"(SELECT *, min(place) OVER (PARTITION BY project, package) AS f FROM chosen WHERE diagram = '{name}') pl"
    pkg = "printf('%09d', f)"
    spot = pkg + " || chr(1) || printf('%09d', place) || "
    inner = f"""(SELECT * FROM drawn e WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.diagram = '{name}' AND c.project = e.project AND c.qualname = e.source)
 AND EXISTS (SELECT 1 FROM chosen c WHERE c.diagram = '{name}' AND c.project = e.project AND c.qualname = e.target)) w"""
    rank = "CASE relationship_type WHEN 'INHERITANCE' THEN '01' WHEN 'COMPOSITION' THEN '03' WHEN 'ASSOCIATION' THEN '05' WHEN 'DEPENDENCY' THEN '06' END"
    parts = [
        (0, "''", "0", "pstats", texts(*head)), (2, "''", "0", "pstats", "''"), (3, "''", "0", "pstats", "'@enduml'"),
        (1, spot + "'0'", "0", placed, "'  ' || CASE WHEN is_abstract THEN 'abstract class ' ELSE 'class ' END || qualname || CASE WHEN stereotype <> '-' THEN ' <<' || stereotype || '>>' ELSE '' END || ' {'"),
        (1, spot + "'4'", "0", placed, "'  }'"),
        (1, pkg, "0", f"(SELECT DISTINCT project, package, f FROM {placed}) d", "'package ' || package || ' {'"),
        (1, pkg + " || chr(2)", "0", f"(SELECT DISTINCT project, package, f FROM {placed}) d", "'}', ''"),
        (2, rank + " || chr(1) || file_path || chr(1) || printf('%019d', item_ordinal) || chr(1) || CASE WHEN label = 'returns' THEN '1' ELSE '0' END || chr(1) || text", "0", inner, "text"),
        (2, rank, "-1", f"(SELECT DISTINCT project, relationship_type FROM {inner}) d", "chr(39) || ' ' || upper(left(relationship_type, 1)) || lower(relationship_type[2:]) || ' relationships'"),
        (2, rank + " || chr(2)", "0", f"(SELECT DISTINCT project, relationship_type FROM {inner}) d", "''"),
    ]
    if config.methods:
        parts += [
            (1, spot + "'2'", "0", f"(SELECT * FROM {placed} WHERE attributes > 0 AND methods > 0) d", "'    --'"),
            (1, spot + "CASE WHEN is_attribute THEN '1' ELSE '3' END", "item_ordinal",
             f"(SELECT m.*, f, place FROM members_text m JOIN {placed} ON pl.project = m.project AND pl.file_path = m.file_path AND pl.qualname = m.owner WHERE NOT is_private) d",
             "'    ' || text"),
        ]
    return lines("diagram", parts)


DIAGRAM_PAGE = (
    "SELECT project, 'diagram_page' AS page_kind, 1 AS section, printf('%03d', section) || chr(1) || k1 AS k1, k2, line_no, text"
    f" FROM ({diagram('overview')}) dg UNION ALL "
    + lines("diagram_page", [(0, "''", "0", """(SELECT i.project, count(DISTINCT CASE WHEN method IN ('CLASS','PYDANTIC_MODEL') THEN qualname END) AS c, any_value(n) AS n,
 count(DISTINCT CASE WHEN method IN ('CLASS','PYDANTIC_MODEL') THEN module END) AS p FROM items i JOIN (SELECT project, count(*) AS n FROM edges0 GROUP BY 1) e ON e.project = i.project GROUP BY 1) g""",
        "'<h2>Analysis Summary</h2><ul>', '<li>Classes: ' || c || '</li>', '<li>Relationships: ' || n || '</li>', '<li>Packages: ' || p || '</li>', '</ul>'")])
)

ORACLE: dict[str, str] = {
    "list_files": sql("SELECT project, 'part' || p_partkey || '.py' AS name, p_type || '/part' || p_partkey || '.py' AS path, '/src/' || p_type || '/part' || p_partkey || '.py' AS full_path FROM (SELECT *, p_brand AS project FROM part) x"),
    "documentable_files": f"""SELECT c_custkey, file_path, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.py$', '') AS module
 FROM ({b.check_sql(b.FILE_PATHS)}) x WHERE c_custkey % 10 >= 7""",
    "scan_errors": f"SELECT p_brand AS project, {PART_PATH} AS file_path FROM part WHERE p_size % 17 = 0",
    "extract_items": sql(part_items(PART_ITEMS), "good_part"),
    "extract_scores": sql(part_items(PART_SCORES), "good_part"),
    "extract_coverage": sql(covered("project, method", "project, method", f"({part_items({k: PART_ITEMS[k] for k in ('project', 'method', 'docstring')})})"), "good_part"),
    "extract_endpoints": sql("SELECT p_brand AS project, '/parts/' || p_partkey AS path, 'GET' AS method, 'read' AS qualname, p_type AS tags FROM good_part", "good_part"),
    "extract_deduped": sql(f"SELECT project, method, count(*) AS items FROM ({part_items({k: PART_ITEMS[k] for k in ('project', 'method')})}) x WHERE method <> 'ASYNC_FUNCTION' GROUP BY 1, 2", "good_part"),
    "deduped_items": """SELECT project, method, count(*) AS items FROM (SELECT p_brand AS project, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'CLASS' END AS method FROM part
 UNION ALL SELECT p_brand, 'FUNCTION' FROM part WHERE p_size % 2 <> 0) x GROUP BY 1, 2""",
    "scan_metadata": "SELECT p_brand AS project, 'local' AS scan_type, count(*) AS total_files FROM part GROUP BY 1",
    "report_status": sql("SELECT project, snapshot_id, count(*) AS items FROM items GROUP BY 1, 2", "items"),
    "rescan_changed": sql("SELECT file_path, 'Part' || p_partkey || '.price' AS qualname, 'Cost of ' || p_brand || '.' AS docstring FROM good_part WHERE p_size % 2 = 0", "good_part"),
    "documented_params": sql(f"SELECT item_ordinal, {pipe('documented_params')} AS documented_params, {pipe('missing_params')} AS missing_params, {pipe('extra_params')} AS extra_params FROM facts", "facts"),
    "documented_params_section": sql(rf"""SELECT item_ordinal, {pipe('dp')} AS documented_params,
 {pipe("list_filter(actual_params, lambda p: NOT list_contains(dp, p) AND NOT starts_with(p, '*'))")} AS missing_params,
 {pipe("list_filter(dp, lambda p: NOT list_contains(actual_params, p))")} AS extra_params FROM (
 SELECT *, CASE WHEN coalesce(fd, '') = '' THEN {NONE} WHEN len(gp) > 0 THEN gp ELSE sphinx_params END AS dp FROM (
 SELECT *, list_filter(list_transform(split(regexp_replace(regexp_extract(fd, '(?is)(?:Args?|Arguments?|Parameters?):\s*\n(.*)', 1),
  '(?is)\n\s*(?:Returns?|Yields?|Raises?|Note|Example)s?:.*$', ''), {NL}),
  lambda l: regexp_extract(l, '^\s+(\w+)(?:\s*\([^)]*\))?\s*:', 1)), lambda x: x <> '') AS gp FROM f2) a) c""", "f2"),
    "return_docs": sql("SELECT item_ordinal, has_return_doc FROM facts", "facts"),
    "docstring_style": sql(f"SELECT item_ordinal, docstring_style, {pipe('style_issues')} AS style_issues FROM issues", "issues"),
    "documented_exceptions": sql(f"SELECT item_ordinal, {pipe('x')} AS documented_exceptions, len(x) > 0 AS has_exception_doc FROM (SELECT *, list_concat(google_exc, numpy_exc, sphinx_exc) AS x FROM facts) y", "facts"),
    "documented_exceptions_section": sql(f"SELECT item_ordinal, {pipe('list_concat(google_exc, numpy_exc_section, sphinx_exc)')} AS documented_exceptions FROM facts", "facts"),
    "docstring_sections": sql(rf"""SELECT item_ordinal,
 array_to_string(list_transform(list_filter(parts, lambda p: p.s = 0), lambda p: p.t || ' '), '') AS description,
 {pipe("list_transform(list_filter(parts, lambda p: p.s = 1 AND NOT ends_with(p.t, ':') AND contains(p.t, ':')), lambda p: trim(split_part(p.t, ':', 1)) || '=' || trim(p.t[strpos(p.t, ':') + 1:]))")} AS args,
 array_to_string(list_transform(list_filter(parts, lambda p: p.s = 2 AND NOT ends_with(p.t, ':')), lambda p: p.t || ' '), '') AS returns,
 {pipe("list_transform(list_filter(parts, lambda p: p.s = 3 AND NOT ends_with(p.t, ':') AND contains(p.t, ':')), lambda p: trim(split_part(p.t, ':', 1)) || '=' || trim(p.t[strpos(p.t, ':') + 1:]))")} AS raises
FROM sections e""", "sections"),
    "first_lines": sql(f"SELECT item_ordinal, split_part(docstring, {NL}, 1) AS first_line, length(docstring) AS docstring_length FROM items WHERE docstring IS NOT NULL", "items"),
    "template_docstrings": sql(f"""SELECT item_ordinal, CASE WHEN method = 'FUNCTION' THEN 'Brief description of ' || qualname || '.' || {NL} || {NL} || 'Args:'
  || {NL} || '    ' || split_part(param_types[1].name, ':', 1) || ' (type): Description of ' || param_types[1].name || ' parameter.'
  || {NL} || '    ' || param_types[2].name || ' (type): Description of ' || param_types[2].name || ' parameter.'
  || {NL} || {NL} || 'Returns:' || {NL} || '    type: Description of return value.' || {NL} || 'Raises:' || {NL} || '    Exception: Description of when this exception is raised.'
 WHEN method = 'CLASS' THEN 'Class ' || qualname || '.' || {NL} || '            ' || {NL} || 'This class provides functionality for...' || {NL} || {NL} || 'Attributes:' || {NL}
  || '    attribute_name: Description of attribute.' || {NL} || {NL} || 'Methods:' || {NL} || '    method_name: Description of method.'
 ELSE 'Documentation for ' || qualname || '.' END AS template FROM items WHERE method IS NOT NULL""", "items"),
    "prompt_texts": sql(f"""SELECT item_ordinal, 'Function/Method: ' || qualname || {NL} || 'Type: ' || coalesce(method, 'FUNCTION') || {NL}
 || CASE WHEN signature <> '' THEN 'Signature: ' || signature || {NL} ELSE '' END || 'File: ' || file_path || {NL}
 || 'Source Code:' || {NL} || CASE WHEN length(src) > 1000 THEN left(src, 1000) || '...' ELSE src END || {NL} AS prompt
 FROM (SELECT *, coalesce(docstring, full_source) AS src FROM items) x""", "items"),
    "latex_texts": f"SELECT doc_id, md5({latex('text')}) AS latex_md5 FROM documents",
    "wiki_texts": storage_md5(),
    "safe_names": r"SELECT page_id, replace(trim(regexp_replace(url, '[^\p{L}\p{N}_ \-]', '', 'g')), ' ', '_') AS name FROM pages",
    "name_parts": sql(r"SELECT item_ordinal, regexp_extract(qualname, '([^.]*)$', 1) AS method_name, CASE WHEN contains(qualname, '.') THEN regexp_extract(qualname, '^(.*)\.', 1) ELSE '-' END AS owner FROM items", "items"),
    "custom_types": sql("SELECT return_type, count(*) AS items, return_type NOT IN ('list[str]') AND return_type <> '' AS is_custom FROM items WHERE return_type IS NOT NULL GROUP BY return_type", "items"),
    "docstring_checks": r"""SELECT CAST(doc_id AS VARCHAR) AS qualname, NOT contains(text, '"""') AND NOT ends_with(text, '"') AND NOT contains(text, chr(92)) AND NOT contains(text, chr(0)) AS valid FROM documents""",
    "content_keys": """SELECT doc_id, md5(lang || ':' || text) AS content_key FROM documents WHERE md5(lang || ':' || text) NOT IN (
 SELECT md5(lang || ':' || text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1)""",
    "documented_rules": sql(f"""SELECT project, {n_if(has('docstring'))} AS rule_a, {n_if(texty('docstring'))} AS rule_b,
 {n_if(texty('docstring') + " OR item_ordinal % 7 = 0")} AS rule_c, {n_if(texty('docstring') + " OR item_ordinal % 7 IN (0, 1)")} AS rule_d,
 {n_if(has('docstring'))} AS rule_e FROM items GROUP BY project""", "items"),
    "endpoint_list": sql("SELECT item_ordinal, method, path FROM items WHERE method IN ('GET','POST','PUT','DELETE','PATCH') AND contains(path, '/src1')", "items"),
    "missing_items": sql("SELECT item_ordinal, project, listed_module, qualname FROM bare", "bare"),
    "well_documented": sql("SELECT item_ordinal, length(docstring) AS length FROM items WHERE length(docstring) > 100", "items"),
    "item_table": sql(f"SELECT project, module, qualname, {KIND} AS method, {texty('docstring')} AS documented, CASE WHEN {texty('docstring')} THEN 100 ELSE 0 END AS coverage, CASE WHEN {texty('docstring')} THEN 'Good' ELSE 'Missing' END AS status FROM items", "items"),
    "item_by_ordinal": sql("SELECT item_ordinal, qualname, docstring FROM items WHERE item_ordinal = 1", "items"),
    "patchable_items": sql("SELECT project, method, count(*) AS items FROM items WHERE method IS NOT NULL AND method <> 'ROUTER_METADATA' GROUP BY 1, 2", "items"),
    "history_of_project": sql("SELECT * FROM snaps WHERE project = 'click'", "snaps"),
    "snapshots_in_period": sql("SELECT * FROM snaps WHERE ts >= TIMESTAMP '2024-01-24'", "snaps"),
    "item_scores": sql("SELECT item_ordinal, coverage_score, quality_score, docstring_length, complexity_score, maintainability_score, api_completeness_score FROM scored", "scored"),
    "rescored_items": sql(f"SELECT item_ordinal, CASE WHEN method = 'ROUTER_METADATA' THEN CASE WHEN d THEN 100 ELSE 80 END ELSE coverage_score END AS coverage_score, CASE WHEN method = 'ROUTER_METADATA' THEN CASE WHEN d THEN 100 ELSE 70 END ELSE quality_score END AS quality_score FROM scored", "scored"),
    "completeness_issues": sql(f"SELECT item_ordinal, {pipe('completeness_issues')} AS completeness_issues FROM scored", "scored"),
    "score_summary": sql("SELECT project, method, count(*) AS items, " + ", ".join(
        f"CAST(sum(CAST({s} AS DECIMAL(6,1))) AS DOUBLE) / count({s}) AS mean_{s}" for s in
        ("coverage_score", "quality_score", "complexity_score", "maintainability_score", "api_completeness_score")
    ) + " FROM scored GROUP BY 1, 2", "scored"),
    "score_medians": sql("SELECT project, " + ", ".join(
        f"quantile_disc({s}, 0.5) AS median_{s}" for s in
        ("coverage_score", "quality_score", "complexity_score", "maintainability_score", "api_completeness_score")
    ) + " FROM scored GROUP BY 1", "scored"),
    "issue_frequency": sql("SELECT project, split_part(issue, ':', 1) AS issue, count(*) AS items FROM (SELECT project, unnest(completeness_issues) AS issue FROM scored) x GROUP BY 1, 2", "scored"),
    "style_frequency": sql("SELECT project, coalesce(docstring_style, 'none') AS docstring_style, count(*) AS items FROM facts GROUP BY 1, 2", "facts"),
    "coverage_total": sql(f"SELECT *, total - documented AS missing, {rnd('coverage', 2)} AS coverage_percent FROM ({covered('project', 'project')}) y", "items"),
    "coverage_total_text": sql(f"SELECT *, total - documented AS missing, {rnd('coverage', 1)} AS coverage_percent FROM (SELECT *, {pct('documented', 'total')} AS coverage FROM (SELECT project, count(*) AS total, {n_if(texty('docstring'))} AS documented FROM items GROUP BY 1) x) y", "items"),
    "coverage_by_method": sql(covered(f"project, {KIND} AS method", f"project, {KIND}"), "items"),
    "coverage_by_module": sql(covered(f"project, {MODULE} AS module", f"project, {MODULE}"), "items"),
    "coverage_snapshot": sql(f"SELECT project, level, name, total, documented, {pct('documented', 'total')} AS coverage FROM ({SNAPSHOT}) x", "items"),
    "ordered_snapshot": sql(f"SELECT *, {pct('documented', 'total')} AS coverage FROM ({SNAPSHOT}) x", "items"),
    "snapshot_record": sql(f"SELECT project, TIMESTAMP '2024-01-31' AS ts, total AS total_items, documented AS documented_items, {rnd('coverage', 2)} AS coverage_percent FROM ({covered('project', 'project')}) y", "items"),
    "missing_by_type": sql(f"SELECT *, total - documented AS missing FROM ({covered(f'project, {KIND} AS method', f'project, {KIND}')}) y WHERE total > documented", "items"),
    "stats_by_kind": sql("SELECT project, modules, classes, functions, endpoints FROM pstats", "pstats"),
    "method_counts": sql(f"SELECT project, {KIND} AS method, count(*) AS items FROM items GROUP BY 1, 2", "items"),
    "items_by_type": sql(f"SELECT project, {KIND} AS item_type, item_ordinal, qualname FROM items", "items"),
    "distinct_modules": sql("SELECT DISTINCT project, module FROM items WHERE module <> ''", "items"),
    "modules_sorted": sql("SELECT DISTINCT project, module FROM items WHERE module <> '' ORDER BY 1, 2", "items"),
    "module_counts": sql("SELECT project, count(DISTINCT module) AS modules FROM items GROUP BY 1", "items"),
    "longest_docstrings": sql("SELECT * FROM longest WHERE place <= 10", "longest"),
    "missing_sample": sql("SELECT * FROM (SELECT project, qualname, module, method, file_path, item_ordinal, row_number() OVER (PARTITION BY project ORDER BY file_path, item_ordinal) AS place, greatest(count(*) OVER (PARTITION BY project) - 10, 0) AS more FROM bare) x WHERE place <= 10", "bare"),
    "param_gap": sql(f"SELECT project, item_ordinal, qualname, param, CASE WHEN list_contains(actual_params, param) THEN CASE WHEN list_contains(documented_params, param) OR starts_with(param, '*') THEN 'ok' ELSE 'missing' END ELSE 'extra' END AS status FROM (SELECT *, {GAP} AS param FROM facts) x", "facts"),
    "exception_gap": sql("""SELECT project, item_ordinal, qualname, e AS exception, 'undocumented' AS status FROM (SELECT *, unnest(raised_exceptions) AS e, list_concat(google_exc, numpy_exc, sphinx_exc) AS told FROM facts) x WHERE NOT list_contains(told, e)
 UNION ALL SELECT project, item_ordinal, qualname, e, 'not_raised' FROM (SELECT *, unnest(list_concat(google_exc, numpy_exc, sphinx_exc)) AS e FROM facts) x WHERE NOT list_contains(raised_exceptions, e)""", "facts"),
    "docstring_edits": sql(f"""SELECT item_ordinal, md5(coalesce(doc, '')) AS docstring_md5, {texty('doc')} AS has_docstring FROM (
 SELECT i.item_ordinal, CASE WHEN e.new_docstring IS NOT NULL AND row_number() OVER (PARTITION BY i.project, i.module, i.qualname, i.lineno ORDER BY i.file_path, i.item_ordinal) = 1
  THEN e.new_docstring ELSE i.docstring END AS doc FROM items i LEFT JOIN (
  SELECT project, module, qualname, lineno, arg_max(new_docstring, edited_at) AS new_docstring FROM ({b.check_sql(b.EDITS)}) k GROUP BY 1, 2, 3, 4) e
  ON e.project IS NOT DISTINCT FROM i.project AND e.module IS NOT DISTINCT FROM i.module AND e.qualname IS NOT DISTINCT FROM i.qualname AND e.lineno IS NOT DISTINCT FROM i.lineno) x""", "items"),
    "snapshot_diff": sql(f"""SELECT coalesce(a.project, o.project) AS project, coalesce(a.file_path, o.file_path) AS file_path, coalesce(a.qualname, o.qualname) AS qualname,
 coalesce(coalesce(a.method, o.method), '-') AS method, coalesce(a.path, o.path) AS path,
 CASE WHEN o.project IS NULL THEN 'added' WHEN a.project IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM (SELECT project, file_path, CASE WHEN starts_with(file_path, '/fr/') THEN qualname || '_new' ELSE qualname END AS qualname, method, path,
   list_sort(list(coalesce(docstring, chr(1)) || signature || full_source)) AS c FROM items GROUP BY ALL) a
 FULL JOIN (SELECT project, file_path, qualname, method, path, list_sort(list(coalesce(docstring, chr(1)) || signature || full_source)) AS c FROM ({b.check_sql(b.UNLABELLED_ITEMS)}) u GROUP BY ALL) o
 ON a.project = o.project AND a.file_path = o.file_path AND a.qualname = o.qualname AND a.method IS NOT DISTINCT FROM o.method AND a.path = o.path
 WHERE a.project IS NULL OR o.project IS NULL OR a.c <> o.c""", "items"),
    "history_newest": sql("SELECT * FROM snaps ORDER BY ts DESC, project LIMIT 20", "snaps"),
    "latest_snapshot": sql(f"SELECT project, ts, total_items, documented_items, coverage_percent FROM {LATEST} x", "snaps"),
    "retain_history": sql("SELECT project, ts, total_items, documented_items, coverage_percent FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC) AS rn FROM snaps) x WHERE rn <= 10", "snaps"),
    "retain_history_global": sql("SELECT * FROM snaps ORDER BY ts DESC, project DESC LIMIT 100", "snaps"),
    "coverage_trend": sql(TRENDS, "snaps"),
    "trend_series": sql("SELECT project, ts, coverage_percent, total_items FROM snaps WHERE ts >= TIMESTAMP '2024-01-21'", "snaps"),
    "coverage_deltas": sql("""SELECT * FROM (SELECT project, ts, coverage_percent, coverage_percent - lag(coverage_percent) OVER w AS coverage_change,
 total_items - lag(total_items) OVER w AS items_change, documented_items - lag(documented_items) OVER w AS documented_change
 FROM snaps WINDOW w AS (PARTITION BY project ORDER BY ts)) x WHERE coverage_change IS NOT NULL""", "snaps"),
    "best_worst_modules": sql(BEST_WORST, "groups0"),
    "recommendations": sql(ADVICE, "groups0", "snaps"),
    "progress_report": sql(f"""SELECT project, 'latest' AS part, 1 AS place, 'coverage_percent' AS name, CAST(coverage_percent AS VARCHAR) AS value FROM {LATEST} a
 UNION ALL SELECT project, 'trend', period_days, trend, CAST(records_found AS VARCHAR) FROM ({TRENDS}) t
 UNION ALL SELECT project, "end", place, name, CAST(coverage AS VARCHAR) FROM ({BEST_WORST}) w
 UNION ALL SELECT project, 'missing', 1, name, CAST(total - documented AS VARCHAR) FROM groups0 WHERE level = 'method' AND total > documented
 UNION ALL SELECT project, 'advice', section * 10 + place, '', text FROM ({ADVICE}) r""", "groups0", "snaps"),
    "price_requests": sql("SELECT event_id, price_key, CAST(micro AS DOUBLE) / 1000000 AS cost FROM priced", "priced"),
    "price_requests_longest": sql("""SELECT model, CAST(sum(CASE WHEN model LIKE 'GPT-4.1-nano-2026%' THEN CAST(round(CAST(prompt_tokens AS DECIMAL(15,0)) * CAST(0.10 AS DECIMAL(10,4)) + CAST(completion_tokens AS DECIMAL(15,0)) * CAST(0.40 AS DECIMAL(10,4)), 0) AS DECIMAL(26,0)) ELSE micro END) AS DOUBLE) / 1000000 AS cost FROM priced GROUP BY model""", "priced"),
    "estimated_costs": sql("""SELECT event_id, CAST(round(CAST(floor(total_tokens::DOUBLE * 0.7::DOUBLE) AS DECIMAL(15,0)) * CAST(i AS DECIMAL(10,4)) + CAST(floor(total_tokens::DOUBLE * 0.3::DOUBLE) AS DECIMAL(15,0)) * CAST(o AS DECIMAL(10,4)), 0) AS DOUBLE) / 1000000 AS estimate,
 label FROM (SELECT *, CASE model WHEN 'o3' THEN 2.00 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'gpt-4.1-nano-2025-04-14' THEN 0.10 ELSE 1.00 END AS i,
 CASE model WHEN 'o3' THEN 8.00 WHEN 'gpt-4o-mini' THEN 0.60 WHEN 'gpt-4.1-nano-2025-04-14' THEN 0.40 ELSE 3.00 END AS o,
 CASE model WHEN 'o3' THEN '$0.00000/$0.00001' WHEN 'gpt-4o-mini' THEN '$0.00000/$0.00000' WHEN 'gpt-4.1-nano-2025-04-14' THEN '$0.00000/$0.00000' ELSE '$0.00000/$0.00000' END AS label FROM usage0) x""", "usage0"),
    "cost_texts": sql(f"SELECT project, count(*) AS total_requests, CASE WHEN {cost()} < 0.001 THEN printf('$%.6f', {cost()}) WHEN {cost()} < 0.01 THEN printf('$%.5f', {cost()}) WHEN {cost()} < 1 THEN printf('$%.4f', {cost()}) ELSE printf('$%.2f', {cost()}) END AS cost_text FROM priced GROUP BY 1", "priced"),
    "usage_totals": sql(f"SELECT project, {cost()} AS total_cost, count(*) AS total_requests FROM priced GROUP BY 1", "priced"),
    "usage_daily": sql(f"SELECT project, strftime(ts, '%Y-%m-%d') AS day, {cost()} AS cost, count(*) AS requests FROM priced GROUP BY 1, 2", "priced"),
    "usage_monthly": sql(f"SELECT project, strftime(ts, '%Y-%m') AS month, {cost()} AS cost, count(*) AS requests FROM priced GROUP BY 1, 2", "priced"),
    "usage_calendar": sql(f"SELECT project, coalesce(month, '-') AS month, coalesce(day, '-') AS day, {cost()} AS cost, count(*) AS requests FROM (SELECT *, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day FROM priced) x GROUP BY GROUPING SETS ((project, month, day), (project, month), (project))", "priced"),
    "usage_stats": sql(f"""SELECT project, {cost("ts::DATE = DATE '2024-01-29'")} AS today_cost, {n_if("ts::DATE = DATE '2024-01-29'")} AS today_requests,
 {cost("date_trunc('month', ts) = DATE '2024-01-01'")} AS month_cost, {n_if("date_trunc('month', ts) = DATE '2024-01-01'")} AS month_requests, {cost()} AS total_cost, count(*) AS total_requests FROM priced GROUP BY 1""", "priced"),
    "usage_month": sql(f"""SELECT project, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END AS part, coalesce(model, day, '') AS name, count(*) AS requests, {cost()} AS cost, CAST(sum(total_tokens) AS BIGINT) AS tokens
 FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM priced WHERE date_trunc('month', ts) = DATE '2024-01-01') x GROUP BY GROUPING SETS ((project), (project, model), (project, day))""", "priced"),
    "retain_usage": sql("SELECT project, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS rn FROM usage0) x WHERE rn <= 1000", "usage0"),
    "recent_requests": sql("SELECT project, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS place FROM usage0) x WHERE place <= 50", "usage0"),
    "recent_requests_overall": sql("SELECT event_id, ts FROM usage0 ORDER BY ts DESC, event_id DESC LIMIT 50", "usage0"),
    "reprice_audit": sql("SELECT event_id, CAST(micro AS DOUBLE) / 1000000 * 1000 AS cost, CAST(micro AS DOUBLE) / 1000000 AS due_cost FROM priced WHERE model = 'o3' AND micro > 0", "priced"),
    "usage_since_reset": sql(f"""SELECT p.project, {cost()} AS total_cost, count(*) AS total_requests FROM priced p LEFT JOIN (SELECT project, max(ts) AS r FROM priced WHERE model = 'gpt-4o-mini' GROUP BY 1) s
 ON s.project = p.project WHERE r IS NULL OR ts >= r GROUP BY 1""", "priced"),
    "latest_class": sql("SELECT project, qualname, coalesce(module, '-') AS module, file_path, item_ordinal FROM cls", "cls"),
    "uml_classes": sql("SELECT project, qualname, package, stereotype, is_abstract, methods, attributes FROM uml", "uml"),
    "attach_methods": sql("SELECT project, item_ordinal, owner, is_attribute, is_private, text, brief FROM members_text", "members_text"),
    "class_carry": sql("SELECT item_ordinal, coalesce(last_value(CASE WHEN method IN ('CLASS','PYDANTIC_MODEL') THEN qualname END IGNORE NULLS) OVER (PARTITION BY project ORDER BY file_path, item_ordinal ROWS UNBOUNDED PRECEDING), '-') AS carried_class FROM items", "items"),
    "attach_methods_legacy": sql("""SELECT project, owner, count(*) AS members FROM (SELECT project, method, last_value(CASE WHEN method IN ('CLASS','PYDANTIC_MODEL') THEN qualname END IGNORE NULLS) OVER (PARTITION BY project ORDER BY file_path, item_ordinal ROWS UNBOUNDED PRECEDING) AS owner FROM items) x
 WHERE owner IS NOT NULL AND method IN ('FUNCTION','ASYNC_FUNCTION','PROPERTY') GROUP BY 1, 2""", "items"),
    "edges": sql(f"SELECT {FLAT} FROM edges0", "edges0"),
    "inheritance_edges": sql("SELECT project, item_ordinal, source, target, relationship_type FROM edges0 WHERE relationship_type = 'INHERITANCE'", "edges0"),
    "composition_edges": sql(f"SELECT {FLAT} FROM edges0 WHERE relationship_type = 'COMPOSITION'", "edges0"),
    "association_edges": sql("SELECT project, item_ordinal, source, target, relationship_type, label FROM edges0 WHERE relationship_type = 'ASSOCIATION'", "edges0"),
    "dependency_edges": sql("SELECT project, item_ordinal, source, target, relationship_type, stereotype FROM edges0 WHERE relationship_type = 'DEPENDENCY'", "edges0"),
    "distinct_edges": sql("SELECT DISTINCT project, source, target, relationship_type, label, stereotype FROM edges0", "edges0"),
    "edge_texts": sql("SELECT project, text, count(*) AS times FROM drawn GROUP BY 1, 2", "drawn"),
    "edges_within": sql(f"""SELECT {FLAT} FROM edges0 e WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.diagram = 'overview' AND c.project = e.project AND c.qualname = e.source)
 AND EXISTS (SELECT 1 FROM chosen c WHERE c.diagram = 'overview' AND c.project = e.project AND c.qualname = e.target)""", "chosen", "edges0"),
    "select_classes": sql("SELECT diagram, project, qualname, place FROM chosen", "chosen"),
    "graph_stats": sql("""SELECT i.project, count(DISTINCT CASE WHEN method IN ('CLASS','PYDANTIC_MODEL') THEN qualname END) AS classes, any_value(n) AS relationships,
 count(DISTINCT CASE WHEN method IN ('CLASS','PYDANTIC_MODEL') THEN module END) AS packages FROM items i JOIN (SELECT project, count(*) AS n FROM edges0 GROUP BY 1) e ON e.project = i.project GROUP BY 1""", "items", "edges0"),
    "degree_stats": sql("""SELECT project, element, relationship_type, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(n) AS BIGINT) AS in_degree FROM (
 SELECT project, source AS element, relationship_type, 1 AS o, 0 AS n FROM edges0 UNION ALL SELECT project, target, relationship_type, 0, 1 FROM edges0) x GROUP BY 1, 2, 3""", "edges0"),
    "endpoint_flow": sql(f"""SELECT project, endpoint, '@startuml' || {NL} || 'title ' || endpoint || ' Request Flow' || {NL} || {q(chr(10).join(graph.FLOW_LINES))} AS text FROM (
 SELECT project, arg_min(qualname, struct_pack(f := file_path, i := item_ordinal)) AS endpoint FROM items WHERE method IN ('GET','POST','PUT','DELETE') GROUP BY 1) x""", "items"),
    "module_tree": sql("SELECT project, path, parent, name, depth, items, is_last, above || mark AS branch FROM tree", "tree"),
    "tree_lines": sql("SELECT project, 'tree' AS page_kind, 0 AS section, k1, k2, 0 AS line_no, text FROM tree_text WHERE text IS NOT NULL", "tree_text"),
    "page_stats": sql("SELECT * FROM pstats", "pstats"),
    "page_index": sql(lines("index", [(0, "''", "0", "pstats", f"'# ' || project || ' Documentation', '', 'Welcome to the ' || project || ' documentation. Generated on {GENERATED}.', '', '## Documentation Statistics', '', '- **Total Items**: ' || total, '- **Documented**: ' || documented || ' (' || coverage || '%)', '- **Missing Documentation**: ' || missing, '', '### Coverage by Type', '', '| Type | Count |', '|------|-------|', '| Modules | ' || modules || ' |', '| Classes | ' || classes || ' |', '| Functions | ' || functions || ' |', '| Endpoints | ' || endpoints || ' |'")]), "pstats"),
    "page_structure": sql(lines("code_structure", [
        (0, "''", "0", "pstats", texts("# Code Structure", "", "## Module Hierarchy", "")),
        (2, "''", "0", "pstats", "'', '## Detailed Structure', '', '### Modules (' || modules || ')', ''"),
        (3, KEY, "item_ordinal", "items WHERE method = 'MODULE'", f"'- **' || module || '** - ' || file_path, {SUMMARY}"),
        (4, "''", "0", "pstats", "'', '### Classes (' || classes || ')', ''"),
        (5, KEY, "item_ordinal", "items WHERE method = 'CLASS'", f"'- **' || qualname || '** (' || module || ')', {SUMMARY}"),
        (6, "''", "0", "pstats", "'', '### Functions (' || functions || ')', ''"),
        (7, "m", "0", "(SELECT DISTINCT project, coalesce(module, 'Unknown') AS m FROM items WHERE method = 'FUNCTION') z", "'', '#### ' || m, ''"),
        (7, f"coalesce(module, 'Unknown') || chr(1) || {KEY}", "item_ordinal", "items WHERE method = 'FUNCTION'", f"'- `' || qualname || '()` - Line ' || lineno, {SUMMARY}"),
    ]) + " UNION ALL SELECT project, 'code_structure', 1, k1, k2, 0, text FROM tree_text WHERE text IS NOT NULL", "pstats", "tree_text", "items"),
    "page_coverage": sql(lines("docstring_report", [
        (0, "''", "0", "pstats", f"'# Documentation Coverage Report', '', 'Generated on: {GENERATED}', '', '## Summary', '', '- **Total Items**: ' || total, '- **Documented**: ' || documented || ' (' || coverage || '%)', '- **Missing Documentation**: ' || missing, '', '## Coverage Visualization', '', '```', '[' || repeat('█', CAST(floor(coverage / 10) AS INT)) || repeat('░', 10 - CAST(floor(coverage / 10) AS INT)) || '] ' || coverage || '%', '```', '', '## Items Missing Documentation', ''"),
        (1, "listed_module", "0", "(SELECT DISTINCT project, listed_module FROM bare) z", "'', '### ' || listed_module, ''"),
        (1, f"listed_module || chr(1) || {KEY}", "item_ordinal", "bare", f"'- `' || qualname || '` (' || {KIND} || ') - Line ' || lineno"),
        (2, "''", "0", "pstats", texts("", "## Well-Documented Items", "")),
        (3, "''", "place", "longest WHERE place <= 10", "'- `' || qualname || '` (' || module || ') - ' || length || ' characters'"),
    ]), "pstats", "bare", "longest"),
    "page_reference": sql("SELECT * REPLACE (md5(text) AS text) FROM (" + lines("api_reference", [
        (0, "''", "0", "pstats", texts("# API Reference", "", "## Endpoints", "")),
        (1, KEY, "item_ordinal", f"items WHERE method IN {EP}", "'### ' || qualname, '', '- **Method**: ' || method, '- **Path**: ' || path, '- **Module**: ' || module, '', CASE WHEN docstring <> '' THEN docstring END"),
    ]) + ") y", "pstats", "items"),
    "page_history": sql(lines("changelog", [
        (0, "''", "0", "es", f"'# Changelog', '', '## Current Version', '', '**Generated**: {GENERATED}', '**Total Items**: ' || total, '**Coverage**: ' || coverage || '%', '', '- ' || (total - documented) || ' items still need documentation', '', '### Coverage Trend', '', '| Date | Total Items | Documented | Coverage |', '|------|-------------|------------|----------|'"),
        (1, "strftime(ts, '%Y%m%d%H%M%S') || '000000'", "0", "snaps", "'| ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || total_items || ' | ' || documented_items || ' | ' || coverage_percent || '% |'"),
    ]).replace("FROM es)", f"FROM (SELECT *, {rnd(pct('documented', 'total'), 1)} AS coverage FROM (SELECT event_type AS project, count(*) AS total, {n_if('value > 20')} AS documented FROM events GROUP BY 1) g) es)"), "snaps"),
    "page_overview": sql(lines("overview", [(0, "''", "0", OVER_JOIN, f"'# Project Overview', '', {overview_texts('## Business Overview')}, '## Technical Overview', '', {METRICS}")]), "pstats", "over"),
    "page_master": sql(lines("confluence_master", [
        (0, "''", "0", OVER_JOIN, f"'# ' || project || ' Documentation', '', '> **Generated**: {GENERATED}', '> **Coverage**: ' || coverage || '%', '> **Total Items**: ' || total, '', '---', '', {overview_texts('## 💼 Business Overview')}, '## 📋 Technical Overview', '', '### Key Metrics', '', {METRICS}, '', '---', '', '## 🏗️ Architecture', '', '### Module Structure', '', '```'"),
        (2, "''", "0", "pstats", "'```', '', '---', '', '## 📊 Documentation Coverage', '', '### Summary', '- ✅ Documented: ' || documented || ' items', '- ❌ Missing: ' || missing || ' items', '- 📈 Coverage: ' || coverage || '%', '', '### Items Needing Documentation', ''"),
        (3, "''", "place", "(SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_path, item_ordinal) AS place FROM bare) z WHERE place <= 10", "'- `' || qualname || '` (' || module || ') - Line ' || lineno"),
        (4, "''", "0", "(SELECT project, count(*) - 10 AS more FROM bare GROUP BY 1) z WHERE more > 0", "'', '*... and ' || more || ' more items*'"),
    ]) + " UNION ALL SELECT project, 'confluence_master', 1, k1, k2, 0, text FROM tree_text WHERE text IS NOT NULL", "pstats", "over", "bare", "tree_text"),
    "coverage_page": sql(lines("coverage_page", [
        (0, "''", "0", "ct", f"'<h1>Documentation Coverage Report</h1>', '<p>Generated on: {GENERATED}</p>', '<h2>Overall Coverage</h2>', '<ac:structured-macro ac:name=\"panel\" ac:schema-version=\"1\">', '<ac:parameter ac:name=\"bgColor\">#' || CASE WHEN coverage >= 80 THEN '00875a' WHEN coverage < 50 THEN 'de350b' ELSE 'ff991f' END || '</ac:parameter>', '<ac:rich-text-body><h3 style=\"color: white;\">' || printf('%.1f', coverage) || '% Coverage</h3>', '<p style=\"color: white;\">' || documented || ' of ' || total || ' items documented</p></ac:rich-text-body></ac:structured-macro>', '<h2>Coverage by Type</h2><table><thead><tr><th>Type</th><th>Total</th><th>Documented</th><th>Coverage</th></tr></thead><tbody>'"),
        (1, "method", "0", "ck", "'<tr><td>' || method || '</td><td>' || total || '</td><td>' || documented || '</td><td>' || printf('%.1f', coverage) || '%</td></tr>'"),
        (2, "''", "0", "ct", "'</tbody></table><h2>Undocumented Items</h2>', CASE WHEN total > documented THEN '<table><thead><tr><th>Module</th><th>Name</th><th>Type</th><th>File</th></tr></thead><tbody>' ELSE '<p>All items are documented!</p>' END"),
        (3, "''", "place", "ab WHERE place <= 20", "'<tr><td>' || coalesce(module, 'N/A') || '</td><td><code>' || qualname || '</code></td><td>' || coalesce(method, 'N/A') || '</td><td>' || file_path || '</td></tr>'"),
        (4, "''", "0", "ab WHERE place = 1 AND n > 20", "'<tr><td colspan=\"4\"><em>... and ' || (n - 20) || ' more undocumented items</em></td></tr>'"),
        (5, "''", "0", "ct WHERE total > documented", "'</tbody></table>'"),
    ]).replace("FROM ct", f"FROM ({covered('project', 'project')}) ct").replace("FROM ck", f"FROM ({covered(f'project, {KIND} AS method', f'project, {KIND}')}) ck").replace(
        "FROM ab", f"FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_path, item_ordinal) AS place, count(*) OVER (PARTITION BY project) AS n FROM items WHERE NOT {has('docstring')}) ab"), "items"),
    "endpoint_pages": sql(ENDPOINT_BODY, "scored", "sections"),
    "latex_body": sql(f"SELECT * REPLACE (md5(text) AS text) FROM ({LATEX_LINES}) y", "items"),
    "diagram_lines": sql(f"SELECT *, 'detailed' AS page_key FROM ({diagram('detailed')}) y", "pstats", "chosen", "drawn", "members_text"),
    "diagram_page": sql(DIAGRAM_PAGE, "pstats", "chosen", "drawn", "items"),
    "patch_docstrings": f"""SELECT {PART_PATH} AS file_path, 'next' AS snapshot_id, {PATCHED} AS source,
 CASE WHEN p_size % 17 = 0 THEN '0=Syntax error in file: invalid syntax (<unknown>, line 1)' ELSE '6=ok|0=ok' END AS status FROM part""",
    "rejected_edits": f"""SELECT p_brand AS project, {PART_PATH} AS file_path, 4000 AS lineno, 'Line number 4000 out of range (1-' || len(split({b.check_sql(b.part_source())}, chr(10))) || ')' AS message FROM part
 UNION ALL SELECT p_brand, {PART_PATH}, 6, 'Line number 6 out of range (1-2)' FROM part WHERE p_size % 17 = 0
 UNION ALL SELECT p_brand, '/src/' || p_type || '/part' || p_partkey || '.gone', 6, 'File not found' FROM part
 UNION ALL SELECT p_brand, {PART_PATH}, 2, 'Unsupported kind for patching: METADATA' FROM part""",
    "edit_targets": sql("SELECT item_ordinal, coalesce(CASE WHEN item_ordinal % 2 = 0 THEN file_path END, replace(nullif(module, ''), '.', '/') || '.py', '-') AS target FROM items", "items"),
    "stream_usage_totals": sql(f"SELECT project, strftime(ts, '%Y-%m-%d') AS day, {cost()} AS cost, count(*) AS requests FROM priced GROUP BY 1, 2", "priced"),
    "stream_latest_items": "SELECT 'p' || (user_id % 10) AS project, event_type AS qualname, 'k' || (user_id % 7) AS method, arg_max(props, event_id) AS docstring, max(event_id) AS edited_at FROM events GROUP BY 1, 2, 3",
    "stream_items": sql(f"SELECT project, method, count(*) AS items FROM ({part_items({k: PART_ITEMS[k] for k in ('project', 'method')})}) x GROUP BY 1, 2", "good_part"),
    "stream_history": sql("SELECT project, level, name, total, documented FROM (" + SNAPSHOT + ") x", "items"),
}


_TREE = "CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN NULL ELSE 's' || p_size || '/part' || p_partkey || '.py' END"
_TREE_FILES = f"SELECT 'all' AS project, {_TREE} AS rel_path, 'part' || p_partkey AS module, md5({b.check_sql(b.part_source())}) AS digest FROM part WHERE {_TREE} IS NOT NULL"
_V = "'/v/part' || p_partkey || '.py'"


def _varied(rows: list[tuple[str, ...]]) -> str:
    """method, qualname, path, signature, docstring, lineno, params, status_codes, summary, operation_id, return_type of every part."""
    names = "method qualname path signature docstring lineno params status_codes summary operation_id return_type".split()
    return " UNION ALL ".join(
        f"SELECT {_V} AS file_path, " + ", ".join(f"{x or chr(39) * 2} AS {n}" for x, n in zip(r, names, strict=True)) + " FROM part" for r in rows)


_ORDER = "'Order' || p_partkey"
_STORED = {
    "tree_files": _TREE_FILES,
    "landed_files": _TREE_FILES,
    "extract_varied": _varied([
        ("'ROUTER_METADATA'", "'router'", "", "'prefix'", "'/p' || p_size", "1", "", "", "", "", ""),
        ("'METADATA'", "'app'", "", "'title'", "p_brand", "2", "", "", "", "", ""),
        ("'PYDANTIC_MODEL'", _ORDER, "", "'inherits=(BaseModel)'", "'Order of ' || p_brand || '.'", "5", "", "", "", "", ""),
        ("'PYDANTIC_CONFIG'", f"{_ORDER} || '.Config'", "", "'orm_mode=True, title=' || p_type", "", "7", "", "", "", "", ""),
        ("'CLASS'", f"{_ORDER} || '.Config'", "", "'nested_level=1'", "", "7", "", "", "", "", ""),
        ("'PYDANTIC_MODEL'", f"{_ORDER} || '.Inner'", "", "'nested_level=1 | inherits=(BaseModel)'", "", "10", "", "", "", "", ""),
        ("'PROPERTY'", f"{_ORDER} || '.total'", "", "'self'", "", "13", "", "", "", "", "'int'"),
        ("'STATICMETHOD'", f"{_ORDER} || '.make'", "", "'a: int, b=' || chr(39) || 'x' || chr(39)", "", "16", "'a|b'", "", "", "", ""),
        ("'CLASSMETHOD'", f"{_ORDER} || '.load'", "", "'cls, path: str'", "", "19", "'cls|path'", "", "", "", ""),
        ("'ASYNC_FUNCTION'", "'create'", "", "'order: Order'", "", "22", "'order'", "", "", "", ""),
        ("'POST'", "'create'", "'/o/' || p_partkey", "'order: Order'", "", "22", "'order'", "(200 + p_size) || '|404|409'", "'Make ' || p_size", "'op' || p_partkey", ""),
    ]),
    "extract_wiring": f"""SELECT {_V} AS file_path, 'ROUTER_INCLUSION' AS method, 'router' AS qualname, '/v' || p_size AS path, '' AS signature, 3 AS lineno FROM part
 UNION ALL SELECT {_V}, 'MIDDLEWARE', 'Gate' || p_size, '', '', 4 FROM part""",
    "patch_varied": f"""SELECT file_path, CASE WHEN p_partkey % 10 < 8 THEN after ELSE before END AS source, CASE WHEN p_partkey % 10 < 8 THEN 'ok' ELSE '' END AS status
 FROM (SELECT file_path, source AS before, CAST(substr(module, 5) AS INT) AS p_partkey FROM ({b.check_sql(stored.EDITED['before'])}) x) b
 JOIN (SELECT file_path, source AS after FROM ({b.check_sql(stored.EDITED['after'])}) y) a USING (file_path)""",
    "report_file": sql("""SELECT 'back' AS project, module, qualname, method, lineno, md5(docstring) AS digest, array_to_string(tags, '|') AS tags,
 array_to_string(list_transform(param_types, lambda p: p.name || ':' || p.type), '|') AS types FROM items""", "items"),
    "stored_items": sql("SELECT project, snapshot_id, count(*) AS items FROM items WHERE project <> 'p0' OR method = 'CLASS' GROUP BY 1, 2", "items"),
    "report_exists": sql("SELECT project, 'latest' AS snapshot_id, true AS exists, count(*) AS items FROM items GROUP BY 1 UNION ALL SELECT DISTINCT project, 'never', false, 0 FROM items", "items"),
    "history_file": sql("""SELECT s.*, 'local' AS scan_type, 3::BIGINT AS total_files, 0.5::DOUBLE AS scan_time, kinds, kind_total FROM snaps s
 LEFT JOIN (SELECT project, count(*) AS kinds, CAST(sum(total) AS BIGINT) AS kind_total FROM groups0 WHERE level = 'method' GROUP BY 1) g ON g.project = s.project""", "snaps", "groups0"),
    "ledger_file": sql("""SELECT CASE WHEN event_id % 2 = 0 THEN 'flat' ELSE project END AS project, model, CAST(ts AS DATE) AS day, count(*) AS requests,
 CAST(sum(total_tokens) AS BIGINT) AS tokens, max(context) AS last_context FROM usage0 GROUP BY 1, 2, 3""", "usage0"),
    "overview_file": f"SELECT project, project_purpose, coalesce(business_context, '') AS business_context, key_business_value, project_purpose <> '' OR coalesce(business_context, '') <> '' AS has_overview FROM ({b.check_sql(b.OVERVIEWS)}) x",
    "history_table": ORACLE["retain_history"],
    "usage_table": ORACLE["retain_usage"],
    "price_requests_by_table": ORACLE["price_requests"],
    "price_requests_long_list": f"""WITH p AS ({b.check_sql(stored.PART_PRICES)}), r AS ({b.check_sql(stored.PART_REQUESTS)}), m AS (SELECT DISTINCT lower(model) AS name FROM r),
k AS (SELECT name, coalesce(min(CASE WHEN name = model THEN model END),
  arg_min(model, list_rank) FILTER (WHERE contains(name, model) OR contains(model, name)), 'default') AS price_key FROM m CROSS JOIN p GROUP BY name)
SELECT event_id, price_key, CAST(round(CAST(prompt_tokens AS DECIMAL(15,0)) * input_per_million + CAST(completion_tokens AS DECIMAL(15,0)) * output_per_million, 0) AS DOUBLE) / 1000000 AS cost
FROM r JOIN k ON lower(r.model) = k.name JOIN p ON p.model = price_key""",
    "written_pages": f"SELECT project, 'docstring_report' AS page_kind, text FROM ({ORACLE['page_coverage']}) x",
    "written_diagrams": f"SELECT project, 'diagram' AS page_kind, text FROM ({ORACLE['diagram_lines']}) x",
    "stream_scans": sql("SELECT project, 'latest' AS snapshot_id, level, name, total, documented FROM (" + SNAPSHOT + ") x", "items"),
}
_STORED["written_sources"] = f"""SELECT project, 'latest' AS snapshot_id, file_path, source FROM ({b.check_sql(stored.EDITED['before'])}) x
 UNION ALL SELECT x.project, 'next', x.file_path, y.source FROM ({b.check_sql(stored.EDITED['before'])}) x JOIN ({_STORED['patch_varied']}) y ON y.file_path = x.file_path"""
ORACLE |= _STORED
