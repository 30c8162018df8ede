"""Source text to documentation items.

The only step that needs Python is parsing: executors walk each syntax tree and emit raw
facts (names, lists, text). Kinds, signatures of classes, endpoint rows, docstring
reading and scores are derived from those facts with native columns.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docmetrics.functions import text as tx
from docmetrics.functions.score import with_docstring_facts, with_scores
from docmetrics.schema import (
    DOC_ITEMS,
    ENDPOINT_KINDS,
    FLAG,
    INT,
    LONG,
    NAMED_TYPE,
    NAMED_TYPES,
    TEXT,
    TEXTS,
    layout,
    with_columns_of,
)

RAW_FACTS = layout(
    project=TEXT, snapshot_id=TEXT, file_path=TEXT, module=TEXT, fact_no=LONG,
    fact=TEXT, qualname=TEXT, path=TEXT, signature=TEXT, docstring=TEXT,
    full_source=TEXT, lineno=INT, nested_level=INT, bases=TEXTS, decorators=TEXTS,
    actual_params=TEXTS, param_types=NAMED_TYPES, return_type=TEXT, has_type_hints=FLAG,
    raised_exceptions=TEXTS, dependencies=TEXTS, dependency_docs=NAMED_TYPES, tags=TEXTS,
    endpoints=T.ArrayType(
        layout(
            http=TEXT, path=TEXT, summary=TEXT, description=TEXT, response_model=TEXT,
            status_codes=TEXTS, response_description=TEXT, tags=TEXTS, operation_id=TEXT,
        )
    ),
    error=TEXT,
)
_BATCH_ROWS = 1000
_MODEL_BASES = ("BaseModel", "Model")


def _callee(node: ast.AST) -> str | None:
    """Last name of what a call or reference points at."""
    target = node.func if isinstance(node, ast.Call) else node
    return getattr(target, "id", None) or getattr(target, "attr", None)


def _constant(node: ast.AST | None):
    return node.value if isinstance(node, ast.Constant) else None


def _text(value) -> str | None:
    return None if value is None else str(value)


def _named(pairs) -> list[dict]:
    return [{"name": name, "type": ast.unparse(node)} for name, node in pairs]


# Fields of a statement that hold further statements, in reading order.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(node: ast.AST) -> list[ast.AST]:
    return [child for block in _BLOCKS for child in getattr(node, block, ())]


def _raised(root: ast.AST) -> Iterator[str]:
    """Names raised anywhere inside; no expression is entered, as none holds a statement."""
    todo = [root]
    while todo:
        node = todo.pop()
        name = _callee(node.exc) if isinstance(node, ast.Raise) and node.exc else None
        if name:
            yield name
        todo.extend(reversed(_statements(node)))


def _endpoint(call: ast.Call) -> dict:
    given = {k.arg: k.value for k in call.keywords}
    codes = [_constant(given.get("status_code"))]
    if isinstance(given.get("responses"), ast.Dict):
        listed = [_constant(k) for k in given["responses"].keys]
        codes = listed + codes if list(given).index("responses") < list(given).index(
            "status_code" if "status_code" in given else "responses"
        ) else codes + listed
    tags = given.get("tags")
    tag_nodes = tags.elts if isinstance(tags, ast.List) else [tags]
    model = given.get("response_model")
    return {
        "http": call.func.attr.upper(),
        "path": _text(next((a.value for a in call.args if isinstance(a, ast.Constant)), "")),
        "summary": _text(_constant(given.get("summary"))),
        "description": _text(_constant(given.get("description"))),
        "response_model": ast.unparse(model) if model is not None else None,
        "status_codes": [str(x) for x in codes if x is not None],
        "response_description": _text(_constant(given.get("response_description"))),
        "tags": [str(_constant(t)) for t in tag_nodes if _constant(t) is not None],
        "operation_id": _text(_constant(given.get("operation_id"))),
    }


def _function_facts(node) -> dict:
    spec = node.args
    stars = [(f"*{spec.vararg.arg}", spec.vararg)] if spec.vararg else []
    stars += [(f"**{spec.kwarg.arg}", spec.kwarg)] if spec.kwarg else []
    plain = [(a.arg, a) for a in spec.args]
    keyword = [(a.arg, a) for a in spec.kwonlyargs]
    hints = [(n, a.annotation) for n, a in plain + keyword + stars if a.annotation]
    defaults = dict(zip([n for n, _ in plain][::-1], spec.defaults[::-1]))
    optional = [(n, defaults[n]) for n, _ in plain if n in defaults and n != "self"]
    optional += [(a.arg, d) for a, d in zip(spec.kwonlyargs, spec.kw_defaults) if d]
    needs = _named(
        (n, d.args[0])
        for n, d in optional
        if isinstance(d, ast.Call) and _callee(d) == "Depends" and d.args
    )
    marks = node.decorator_list
    return {
        "signature": ast.unparse(spec),
        "actual_params": [n for n, _ in plain if n != "self"]
        + [n for n, _ in stars]
        + [n for n, _ in keyword],
        "param_types": _named(hints),
        "return_type": ast.unparse(node.returns) if node.returns else None,
        "has_type_hints": bool(hints or node.returns),
        "raised_exceptions": list(dict.fromkeys(_raised(node))),
        "dependencies": [x["type"] for x in needs],
        "dependency_docs": needs,
        "decorators": [_callee(d) or "" for d in marks if not isinstance(d, ast.Call)],
        "endpoints": [
            _endpoint(d)
            for d in marks
            if isinstance(d, ast.Call)
            and isinstance(d.func, ast.Attribute)
            and d.func.attr.upper() in ENDPOINT_KINDS
        ],
    }


def _class_facts(node: ast.ClassDef) -> dict:
    fields: dict[str, ast.AST | None] = {}
    for stmt in node.body:
        if isinstance(stmt, ast.AnnAssign) and isinstance(stmt.target, ast.Name):
            fields[stmt.target.id] = stmt.annotation
        elif isinstance(stmt, ast.Assign):
            fields.update({t.id: None for t in stmt.targets if isinstance(t, ast.Name)})
    return {
        "bases": [ast.unparse(b) for b in node.bases],
        # Names that decide the model test; a subscripted base has none.
        "decorators": [_callee(b) or "" for b in node.bases if not isinstance(b, ast.Call)],
        "param_types": [
            {"name": k, "type": ast.unparse(v) if v is not None else "Any"}
            for k, v in fields.items()
        ],
    }


def _config_text(node: ast.ClassDef) -> str:
    found = {}
    for stmt in node.body:
        if isinstance(stmt, ast.Assign):
            for t in stmt.targets:
                if isinstance(t, ast.Name):
                    value = stmt.value
                    found[t.id] = (
                        str(value.value) if isinstance(value, ast.Constant) else ast.unparse(value)
                    )
    return ", ".join(f"{k}={v}" for k, v in found.items())


def _settings(node: ast.Assign) -> list[dict]:
    """One fact per constant keyword of `app = FastAPI(...)` or `x = APIRouter(...)`."""
    if len(node.targets) != 1 or not isinstance(node.targets[0], ast.Name):
        return []
    name, maker = node.targets[0].id, isinstance(node.value, ast.Call) and _callee(node.value)
    fact = {"FastAPI": "METADATA" if name == "app" else None, "APIRouter": "ROUTER_METADATA"}
    kind = fact.get(maker) if maker else None
    return [
        {"fact": kind, "qualname": name, "signature": k.arg, "docstring": str(k.value.value)}
        for k in (node.value.keywords if kind else [])
        if isinstance(k.value, ast.Constant)
    ]


def _wiring(node: ast.Call) -> dict | None:
    """`app.add_middleware(X)` and `app.include_router(r, prefix=, tags=)`."""
    kind = {"add_middleware": "MIDDLEWARE", "include_router": "ROUTER_INCLUSION"}.get(
        getattr(node.func, "attr", None)
    )
    if kind is None or not node.args:
        return None
    given = {k.arg: k.value for k in node.keywords}
    tags = given.get("tags")
    return {
        "fact": kind,
        "qualname": ast.unparse(node.args[0]),
        "path": _text(_constant(given.get("prefix"))) if kind == "ROUTER_INCLUSION" else None,
        "tags": [str(_constant(t)) for t in tags.elts if _constant(t) is not None]
        if isinstance(tags, ast.List)
        else [],
    }


def file_facts(source: str, wiring: bool = False) -> Iterator[dict]:
    """Facts of one file in reading order."""
    tree = ast.parse(source)
    lines = source.split("\n")

    def segment(node) -> str:
        rows = lines[node.lineno - 1 : node.end_lineno]
        rows[-1] = rows[-1].encode()[: node.end_col_offset].decode()
        rows[0] = rows[0].encode()[node.col_offset :].decode()
        return "\n".join(rows)

    doc = ast.get_docstring(tree)
    if doc:
        yield {"fact": "MODULE", "qualname": "<module>", "docstring": doc, "lineno": 1}
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while todo:
        node, outer = todo.pop()
        inner = outer
        if isinstance(node, ast.ClassDef):
            inner = (*outer, node.name)
            facts = _class_facts(node)
            name = ".".join(inner)
            base = {"docstring": ast.get_docstring(node), "full_source": segment(node)}
            yield {
                "fact": "class", "qualname": name, "lineno": node.lineno,
                "nested_level": len(outer), **base, **facts,
            }
            if any(b in _MODEL_BASES for b in facts["decorators"]):
                for sub in node.body:
                    text = ""
                    if isinstance(sub, ast.ClassDef) and sub.name == "Config":
                        text = _config_text(sub)
                    if text:
                        yield {
                            "fact": "PYDANTIC_CONFIG", "qualname": f"{name}.Config",
                            "signature": text, "docstring": ast.get_docstring(sub),
                            "full_source": segment(sub), "lineno": sub.lineno,
                        }
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield {
                "fact": "async" if isinstance(node, ast.AsyncFunctionDef) else "function",
                "qualname": ".".join((*outer, node.name)),
                "lineno": node.lineno,
                "docstring": ast.get_docstring(node),
                "full_source": segment(node),
                **_function_facts(node),
            }
        elif isinstance(node, ast.Assign):
            yield from ({**x, "lineno": node.lineno} for x in _settings(node))
        elif wiring and isinstance(node, ast.Call):
            found = _wiring(node)
            if found:
                yield {**found, "lineno": node.lineno}
        below = list(ast.iter_child_nodes(node)) if wiring else _statements(node)
        todo.extend((child, inner) for child in reversed(below))


def _parse_one(key: dict, source: str | None, wiring: bool) -> list[dict]:
    if source is None:
        return [{**key, "fact_no": 0, "fact": "ERROR", "error": "not valid UTF-8"}]
    try:
        return [{**key, "fact_no": i, **f} for i, f in enumerate(file_facts(source, wiring))]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{**key, "fact_no": 0, "fact": "ERROR", "error": f"{type(e).__name__}: {e}"}]


def scan_facts(sources: DataFrame, wiring: bool = False) -> DataFrame:
    """Raw facts of every file, with one ERROR row for a file that does not parse.

    Filter the files before this step: Catalyst moves no filter on the result below it.
    """
    keys = ["project", "snapshot_id", "file_path", "module"]
    schema = to_arrow_schema(RAW_FACTS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for key in batch.to_pylist():
                source = key.pop("source")
                rows += _parse_one(key, source, wiring)
                if len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select(*keys, "source").mapInArrow(parse, RAW_FACTS)


def scan_errors(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("fact") == "ERROR").select(
        "project", "snapshot_id", "file_path", "error"
    )


def items_from_facts(
    facts: DataFrame,
    params_mode: str = "first_line",
    exceptions_mode: str = "reference",
    endpoint_functions: bool = True,
) -> DataFrame:
    """Item rows with kinds, endpoint rows, docstring facts and scores.

    An endpoint's function is a row of its own too, unless `endpoint_functions` is off.
    """
    c = F.col
    binding = F.get(
        F.filter(c("decorators"), lambda d: d.isin("property", "staticmethod", "classmethod")),
        F.lit(0),
    )
    is_model = F.exists(c("decorators"), lambda d: d.isin(*_MODEL_BASES))
    method = (
        F.when(c("fact") == "class", F.when(is_model, "PYDANTIC_MODEL").otherwise("CLASS"))
        .when(
            c("fact").isin("function", "async"),
            F.coalesce(
                F.upper(binding),
                F.when(c("fact") == "async", "ASYNC_FUNCTION").otherwise("FUNCTION"),
            ),
        )
        .otherwise(c("fact"))
    )
    nested = F.when(
        c("nested_level") > 0, F.concat(F.lit("nested_level="), c("nested_level").cast("string"))
    )
    inherits = F.when(
        F.size("bases") > 0,
        F.concat(F.lit("inherits=("), F.array_join("bases", ", "), F.lit(")")),
    )
    is_function = c("fact").isin("function", "async")
    own = F.lit(None).cast(RAW_FACTS["endpoints"].dataType.elementType)
    uses = F.concat(F.array(own), F.coalesce(c("endpoints"), F.slice(F.array(own), 1, 0)))
    if not endpoint_functions:
        uses = F.when(F.size("endpoints") > 0, c("endpoints")).otherwise(F.array(own))
    rows = (
        facts.filter(c("fact") != "ERROR")
        .withColumns(
            {
                "_method": method,
                "signature": F.when(
                    c("fact") == "class", F.concat_ws(" | ", nested, inherits)
                ).otherwise(F.coalesce(c("signature"), F.lit(""))),
                "param_types": F.when(
                    (method != "CLASS") & (F.size("param_types") > 0), c("param_types")
                ).otherwise(F.expr(f"cast(array() as {NAMED_TYPE})")),
                # The function itself, then one more row per endpoint mark.
                "_as": uses,
            }
        )
        .select("*", F.posexplode("_as").alias("_nth", "_ep"))
    )
    none = tx.no_strings()
    ep = c("_ep")
    items = rows.select(
        "project", "snapshot_id",
        # Marks on one function stay far below 1000, so ordinals stay in reading order.
        (c("fact_no") * 1000 + c("_nth")).alias("item_ordinal"),
        "module", "qualname",
        F.coalesce(ep["path"], c("path"), F.lit("")).alias("path"),
        F.coalesce(ep["http"], c("_method")).alias("method"),
        "signature", "docstring",
        F.coalesce(ep["description"], ep["summary"]).alias("description"),
        F.when(
            is_function, F.array_join(F.slice(tx.lines_of(c("full_source")), 2, 5), "\n")
        ).otherwise("").alias("first_lines"),
        "lineno", "file_path",
        F.coalesce(c("full_source"), F.lit("")).alias("full_source"),
        F.coalesce(c("actual_params"), none).alias("actual_params"),
        "param_types", "return_type",
        F.coalesce(c("has_type_hints"), F.lit(False)).alias("has_type_hints"),
        F.coalesce(c("raised_exceptions"), none).alias("raised_exceptions"),
        ep["response_model"].alias("response_model"),
        F.coalesce(ep["status_codes"], none).alias("status_codes"),
        ep["response_description"].alias("response_description"),
        F.coalesce(c("dependencies"), none).alias("dependencies"),
        F.coalesce(c("dependency_docs"), F.expr(f"cast(array() as {NAMED_TYPE})")).alias(
            "dependency_docs"
        ),
        F.coalesce(ep["tags"], c("tags"), none).alias("tags"),
        ep["operation_id"].alias("operation_id"),
        ep["summary"].alias("summary_from_decorator"),
    )
    scored = with_scores(with_docstring_facts(items, params_mode, exceptions_mode))
    return with_columns_of(scored, DOC_ITEMS).select(*DOC_ITEMS.fieldNames())


def extract_items(sources: DataFrame, **modes) -> DataFrame:
    """Documentation items of the files that parse."""
    return items_from_facts(scan_facts(sources), **modes)


def docstring_checks(items: DataFrame) -> DataFrame:
    """Whether each docstring would parse inside triple quotes: valid, message."""
    schema = T.StructType(
        [*items.select("project", "qualname", "docstring").schema.fields]
        + layout(valid=FLAG, message=TEXT).fields
    )

    def check(doc: str | None) -> str:
        try:
            ast.parse(f'\ndef f():\n    """{doc or ""}"""\n    pass\n')
            return "Docstring syntax is valid"
        except (SyntaxError, ValueError) as e:
            return f"Docstring syntax error: {e}"

    def run(batches):
        for batch in batches:
            messages = [check(d.as_py()) for d in batch.column("docstring")]
            valid = [m.endswith("is valid") for m in messages]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(valid, pa.bool_()), pa.array(messages, pa.string())],
                names=[*batch.schema.names, "valid", "message"],
            )

    return items.select("project", "qualname", "docstring").mapInArrow(run, schema)
