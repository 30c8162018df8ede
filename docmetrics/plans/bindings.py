"""The given tables seen as documentation tables.

No given table holds Python source or usage records, so each is projected into the layout
a job expects: every row of the table becomes one item, request or source file. The
projections are stated once, in the SQL that Spark and the checking engine share; tokens
in braces stand for what the two dialects write differently.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.functions.numbers import exact_round, percent

NOW = dt.datetime(2024, 1, 31)

# Kinds given to documents in turn; names of the classes they belong to.
KINDS = (
    "GET,POST,PUT,DELETE,FUNCTION,ASYNC_FUNCTION,CLASS,PYDANTIC_MODEL,MODULE,PROPERTY,"
    "WEBSOCKET,ROUTER_METADATA"
)
CLASS_NAMES = "UserService,DataModel,StoreRepository,AppConfig,_Hidden"

NL = "chr(10)"

_DOC = f"""
CASE CAST(d.doc_id % 5 AS INT)
 WHEN 1 THEN d.text || {NL} || {NL} || 'Args:' || {NL} || '    ' || d.source || ' (str): where it is from'
   || {NL} || '    ' || d.lang || ': the language' || {NL} || {NL} || 'Returns:' || {NL}
   || '    str: the text' || {NL} || {NL} || 'Raises:' || {NL} || '    ValueError: if bad' || {NL}
   || '    ' || d.lang || 'Error: if absent'
 WHEN 2 THEN d.text || {NL} || {NL} || 'Parameters' || {NL} || '---' || {NL} || d.source || ' : str'
   || {NL} || {NL} || 'Returns' || {NL} || '-------' || {NL} || 'str' || {NL} || {NL} || 'Raises' || {NL}
   || '------' || {NL} || {NL} || '    KeyError'
 WHEN 3 THEN d.text || {NL} || {NL} || ':param ' || d.source || ': origin' || {NL} || ':param ' || d.lang
   || ': language' || {NL} || ':type ' || d.lang || ': str' || {NL} || ':returns: text' || {NL}
   || ':raises ' || d.source || 'Error: if bad'
 WHEN 4 THEN d.text || {NL} || {NL} || 'Note:' || {NL} || {NL} || 'Done.' || {NL} || ':rtype: str'
 ELSE d.text END
"""

# One documentation item per document.
ITEMS = f"""
SELECT 'p' || CAST(n_chars % 3 AS {{text}}) AS project, 'latest' AS snapshot_id,
 doc_id AS item_ordinal, module, method,
 CASE WHEN method = 'CLASS' THEN cls WHEN method = 'PYDANTIC_MODEL' THEN cls || '.Inner'
  WHEN method = 'MODULE' THEN '<module>'
  WHEN method IN ('FUNCTION','ASYNC_FUNCTION','PROPERTY') THEN cls || '.' ||
   CASE WHEN doc_id % 36 = 4 THEN '__init__' WHEN doc_id % 60 = 9 THEN '_private' ELSE 'm' || doc_id END
  ELSE 'ep_' || doc_id END AS qualname,
 CASE WHEN method IN ('GET','POST','PUT','DELETE','WEBSOCKET') THEN '/' || source || '/' || doc_id ELSE '' END AS path,
 CASE WHEN method = 'CLASS' AND doc_id % 8 = 6 THEN 'inherits=(Base_' || lang || ', ABC)'
  WHEN method = 'CLASS' THEN '' WHEN method = 'PYDANTIC_MODEL' THEN 'nested_level=1 | inherits=(' || cls || ', BaseModel)'
  WHEN method IN ('FUNCTION','ASYNC_FUNCTION') THEN 'self, ' || source || ': str, ' || lang || ': ' || cls
  ELSE '' END AS signature,
 CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN '  ' ELSE doc END AS docstring,
 CAST(n_chars % 1000 + 1 AS INT) AS lineno,
 '/' || lang || '/f' || k || '.py' AS file_path,
 CASE WHEN doc_id % 7 = 0 THEN 'def f():' || {NL} || '    # note' || {NL} || '    \"\"\"x\"\"\"'
  WHEN doc_id % 7 = 1 THEN 'def f():' || {NL} || '    return \"\"\"x\"\"\"'
  ELSE 'def f():' || {NL} || '    return 1' END AS full_source,
 CASE WHEN n_chars % 4 = 0 THEN {{empty}} ELSE split(source || ',' || lang || ',*rest', ',') END AS actual_params,
 CASE WHEN method IN ('FUNCTION','ASYNC_FUNCTION') THEN {{param_types}} ELSE {{no_types}} END AS param_types,
 CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN cls ELSE 'list[str]' END AS return_type,
 doc_id % 3 <> 0 AS has_type_hints,
 CASE WHEN doc_id % 2 = 0 THEN split('ValueError,' || source || 'Error', ',') ELSE {{empty}} END AS raised_exceptions,
 CASE WHEN method IN ('GET','POST') THEN split('get_' || lang || ',' || cls, ',') ELSE {{empty}} END AS dependencies,
 CASE WHEN method IN ('GET','POST') THEN {{dep_docs}} ELSE {{no_types}} END AS dependency_docs,
 CASE WHEN method IN ('GET','PUT') THEN split(source || ',' || lang, ',') ELSE {{empty}} END AS tags,
 CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN {{empty}} WHEN 1 THEN split('Default', ',') ELSE split('200,404', ',') END AS status_codes,
 CASE WHEN doc_id % 2 = 0 THEN 'Model' END AS response_model,
 CASE WHEN doc_id % 5 = 0 THEN 'op_' || doc_id END AS operation_id
FROM (
 SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic, {_DOC} AS doc,
  CASE WHEN d.doc_id % 31 = 0 THEN NULL ELSE d.lang || '.' || d.source END AS module,
  CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE split_part('{KINDS}', ',', CAST(d.doc_id % 12 + 1 AS INT)) END AS method,
  CAST(substr(d.source, 4) AS INT) % 5 AS k,
  split_part('{CLASS_NAMES}', ',', CAST(CAST(substr(d.source, 4) AS INT) % 5 + 1 AS INT)) || '_' || d.lang AS cls
 FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id
) x
"""

# One usage request per event.
USAGE = """
SELECT 'p' || CAST(user_id % 10 AS {text}) AS project, ts, event_id,
 CASE event_type WHEN 'view' THEN 'gpt-4.1-nano-2025-04-14' WHEN 'click' THEN 'GPT-4.1-nano-2026-01-01'
  WHEN 'purchase' THEN 'o3' WHEN 'signup' THEN 'gpt-4o-mini' ELSE 'other-' || event_type END AS model,
 CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
 CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens, props AS context
FROM {events}
"""

# Events per type and day as snapshots of a project: documented where the value is high.
SNAPSHOT_COUNTS = """
SELECT event_type AS project, date_trunc('day', ts) AS ts, count(*) AS total_items,
 CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS documented_items
FROM {events} GROUP BY event_type, date_trunc('day', ts)
"""

_GROUP = """
SELECT event_type AS project, '{level}' AS level, {name} AS name, count(*) AS total,
 CAST(sum(CASE WHEN value > {bar} THEN 1 ELSE 0 END) AS BIGINT) AS documented, min(event_id) AS first_seen
FROM {{events}} GROUP BY event_type, {name}
"""
# Events per type and user group as the module and kind statistics of a project.
GROUP_COUNTS = (
    _GROUP.format(level="module", name="'m' || CAST(user_id % 25 AS {text})", bar=45)
    + " UNION ALL "
    + _GROUP.format(
        level="method",
        name="split_part('GET,POST,PUT,DELETE,FUNCTION', ',', CAST(user_id % 5 + 1 AS INT))", bar=38,
    )
)

# One Python file per part. A new text can be put in place of the method docstring.
PART_DOC = "'Price of ' || p_name || '.'"
_METHOD_DOC = (
    f"'        \"\"\"' || {PART_DOC} || {NL} || {NL} || '        Args:' || {NL}"
    f" || '            qty: how many' || {NL} || '        \"\"\"' || {NL}"
)
PATCHED_DOC = f"'        \"\"\"Cost of ' || p_brand || '.\"\"\"' || {NL}"


def part_source(method_doc: str = _METHOD_DOC) -> str:
    """SQL text of a part's file: lines 1 to 6 lead to the method, whose docstring follows."""
    return f"""
CASE WHEN p_size % 17 = 0 THEN 'def broken(:' || {NL} ELSE
'\"\"\"Module of ' || p_name || '.\"\"\"' || {NL} || 'app = FastAPI(title=\"' || p_brand || '\", debug=True)' || {NL}
|| 'class Part' || p_partkey || '(' || CASE WHEN p_size % 2 = 0 THEN 'BaseModel' ELSE 'Base' END || '):' || {NL}
|| '    size: int = ' || p_size || {NL} || {NL}
|| '    def price(self, qty: int, rate=1, *rest) -> float:' || {NL} || {method_doc}
|| '        if qty < 0:' || {NL} || '            raise ValueError(qty)' || {NL}
|| '        return qty * ' || CAST(p_size AS {{text}}) || {NL} || {NL}
|| '@app.get(\"/parts/' || p_partkey || '\", tags=[\"' || p_type || '\"], response_model=Part)' || {NL}
|| 'async def read(limit: int = ' || p_size || ', db=Depends(get_db)):' || {NL}
|| CASE WHEN p_size % 3 = 0 THEN '    \"\"\"Read one.\"\"\"' || {NL} ELSE '' END
|| '    return limit' || {NL} END
"""


def source_sql(method_doc: str = _METHOD_DOC) -> str:
    return f"""
SELECT p_brand AS project, 'latest' AS snapshot_id,
 '/src/' || p_type || '/part' || p_partkey || '.py' AS file_path,
 p_type || '/part' || p_partkey || '.py' AS rel_path, 'part' || p_partkey AS module,
 {part_source(method_doc)} AS source
FROM {{part}}
"""


_SPARK = {
    "text": "STRING",
    "empty": "cast(array() as array<string>)",
    "no_types": "cast(array() as array<struct<name:string,type:string>>)",
    "param_types": "array(named_struct('name', source, 'type', 'str'),"
    " named_struct('name', lang, 'type', cls))",
    "dep_docs": "array(named_struct('name', lang, 'type', 'get_' || lang),"
    " named_struct('name', 'user', 'type', cls))",
}
_CHECK = {
    "text": "VARCHAR",
    "empty": "CAST([] AS VARCHAR[])",
    "no_types": "CAST([] AS STRUCT(name VARCHAR, type VARCHAR)[])",
    "param_types": "[{'name': source, 'type': 'str'}, {'name': lang, 'type': cls}]",
    "dep_docs": "[{'name': lang, 'type': 'get_' || lang}, {'name': 'user', 'type': cls}]",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def check_sql(sql: str) -> str:
    """A projection as the checking engine writes it."""
    return sql.format(**_CHECK, **{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    text = sql.format(**_SPARK, **{t: "{" + t + "}" for t in TABLES})
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows over several tasks a core: files of few bytes would be read, and all that follows run, in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def bound_parts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A projection of part rows to files.

    The narrow part rows are always dealt out first: what is done with files (parsing, writing)
    is the costly step, and the rows are cheaper to move than the texts made from them.
    """
    return spark.sql(spark_text(sql), part=dealt(table(spark, sf_dir, "part")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, ITEMS)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, USAGE)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per part."""
    return bound_parts(spark, sf_dir, source_sql())


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bound(spark, sf_dir, SNAPSHOT_COUNTS)
    share = exact_round(percent(F.col("documented_items"), F.col("total_items")), 2)
    return counts.withColumn("coverage_percent", share).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bound(spark, sf_dir, GROUP_COUNTS)
    return counts.withColumn("coverage", percent(F.col("documented"), F.col("total")))


def spark_text(sql: str) -> str:
    """A projection for `spark.sql`, its tables still named in braces."""
    return sql.format(**_SPARK, **{t: "{" + t + "}" for t in TABLES})


# ---- inputs of single jobs ------------------------------------------------------------

# Paths of every sort the file test knows, one per customer.
FILE_PATHS = """
SELECT c_custkey, CASE CAST(c_custkey % 10 AS INT)
 WHEN 0 THEN '/app/Migrations/step' || c_custkey || '.py' WHEN 1 THEN '/app/0123456789ab_' || c_custkey || '.py'
 WHEN 2 THEN '/app/__pycache__/c' || c_custkey || '.py' WHEN 3 THEN '/app/tests/test_' || c_custkey || '.py'
 WHEN 4 THEN '/app/c' || c_custkey || '/__init__.py' WHEN 5 THEN '/app/c' || c_custkey || '/setup.py'
 WHEN 6 THEN '/app/_' || c_custkey || '.py' WHEN 7 THEN '/app/test_' || c_custkey || '.py'
 WHEN 8 THEN '/app/' || lower(c_mktsegment) || '.v' || c_custkey || '.py'
 ELSE '/app/' || lower(c_mktsegment) || '/c' || c_custkey || '.py' END AS file_path
FROM {customer}
"""

# New docstrings for the items of documents marked toxic.
EDITS = f"""
SELECT i.project, i.module, i.qualname, i.lineno, 'Checked ' || i.item_ordinal AS new_docstring,
 i.item_ordinal AS edited_at
FROM ({ITEMS}) i JOIN {{labels}} e ON e.doc_id = i.item_ordinal WHERE e.toxic = 1
"""

# The same items before any text was taken away by a label.
UNLABELLED_ITEMS = ITEMS.replace(
    "CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN '  ' ELSE doc END AS docstring",
    "doc AS docstring",
)

# Markdown made of a whole text between heading, bullets, code and a table.
MARKDOWN = f"""
SELECT doc_id, '# ' || source || {NL} || {NL} || '- **one** ' || lang || {NL} || '  - `two`' || {NL}
 || text || {NL} || {NL} || '| a | b |' || {NL} || '|---|---|' || {NL} || '| ' || doc_id || ' | *x* |'
 || {NL} || {NL} || '```python' || {NL} || 'y = 1' || {NL} || '```' || {NL} || '```' || {NL} || 'z' || {NL}
 || '```' || {NL} || '[here](http://example.com/' || doc_id || ')' || {NL} || '## End' || {NL} || '- last' AS md
FROM {{documents}}
"""

# Events as items of their type, for the page that goes with the event snapshots.
EVENT_ITEMS = """
SELECT event_type AS project, 'FUNCTION' AS method, 'e' || event_id AS qualname,
 CASE WHEN value > 20 THEN props END AS docstring FROM {events}
"""

# Overview texts per project, drawn from its documents; one project has none.
OVERVIEWS = """
SELECT 'p' || CAST(n_chars % 3 AS {text}) AS project,
 CASE WHEN n_chars % 3 < 2 THEN 'Purpose of ' || max(source) ELSE '' END AS project_purpose,
 CASE WHEN n_chars % 3 = 1 THEN max(lang) END AS business_context, '' AS key_business_value
FROM {documents} GROUP BY n_chars % 3
"""

# Parts as stored items: a function row each, and an endpoint row for those of even size.
PART_ROWS = """
SELECT p_brand AS project, '/src/' || p_type || '.py' AS file_path, p_partkey AS lineno, 'f' || p_partkey AS qualname,
 'FUNCTION' AS method FROM {part}
UNION ALL SELECT p_brand, '/src/' || p_type || '.py', p_partkey, 'f' || p_partkey,
 CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'CLASS' END FROM {part}
"""

# Five edits per part file: the method's docstring, the module's, one too far down, one in an
# unknown file, one of a kind that holds no docstring.
_PART_EDIT = """
SELECT p_brand AS project, '/src/' || p_type || '/part' || p_partkey || '{ending}' AS file_path,
 'part' || p_partkey AS module, '{method}' AS method, {lineno} AS lineno,
 {doc} AS new_docstring, p_partkey AS edited_at FROM {{part}}
"""
PART_EDITS = " UNION ALL ".join(
    _PART_EDIT.format(ending=ending, method=method, lineno=lineno, doc=doc)
    for ending, method, lineno, doc in [
        (".py", "FUNCTION", 6, "'Cost of ' || p_brand || '.'"),
        (".py", "MODULE", 1, "'About ' || p_type || '.'"),
        (".py", "FUNCTION", 4000, "'Far down'"),
        (".gone", "FUNCTION", 6, "'Nowhere'"),
        (".py", "METADATA", 2, "'No docstring here'"),
    ]
)


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files after the method docstring of every even-sized part was edited."""
    doc = f"CASE WHEN p_size % 2 = 0 THEN {PATCHED_DOC} ELSE {_METHOD_DOC} END"
    return bound_parts(spark, sf_dir, source_sql(doc))
