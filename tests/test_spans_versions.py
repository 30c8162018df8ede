"""Patches by spans, joins that move touched rows only, versioned tables, long price lists, scans in a stream."""

import ast
import inspect
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmetrics.functions import prices as pr
from docmetrics.operators import coverage as cov
from docmetrics.operators import patch, touched, usage
from docmetrics.operators.spans import patch_text
from docmetrics.schema import SOURCE_FILES
from docmetrics.sources import store, versions
from docmetrics.streaming import jobs

HEADERS = [
    "def f(a,\n      b=(1,\n         2),\n      ) -> int:  # note\n    return a\n",
    "def f(): return 1\n",
    "def f(): 'old'\n",
    "def f(): 'old'; return 2\n",
    "def f():\n    'old'; x = 1\n    return x\n",
    "def f():\n    # before\n\n    '''Old\n    text.'''  # after\n    return 1\n",
    "@deco(\n    1)\nasync def f(x):\n\treturn x\n",
    "class f(Base,\n        metaclass=M):\n  x = 1\n",
    "class f: pass\n",
    "class f:\n    @deco\n    def g(self): ...\n",
    "if True:\n    def f(): \\\n        return 1\n",
    "def f():\n    ('old' ' joined')\n",
    "é = 'ü'; w = 3\ndef f(é='ö'): return é\n",
    "def f():\n    \"\"\"Old.\"\"\"",
]
DOCS = ["New.", "New.\n\nArgs:\n    a: b", 'Ends in "quote"', 'Has """three""" inside', "back\\slash \\d \\n", "'''both''' and \"\"\"", "trailing\\", "ünï", ""]


def found(text, name="f"):
    node = next(n for n in ast.walk(ast.parse(text)) if getattr(n, "name", None) == name)
    return ast.get_docstring(node), node


@pytest.mark.parametrize("text", HEADERS)
@pytest.mark.parametrize("doc", DOCS)
def test_headers_and_quotes(text, doc):
    line = next(n for n in ast.walk(ast.parse(text)) if getattr(n, "name", None) == "f").lineno
    new, status = patch_text(text, [{"is_module": False, "lineno": line, "new_docstring": doc}])
    assert status == ["ok"]
    got, node = found(new)
    assert got == (inspect.cleandoc(doc) if doc else None)
    old = found(text)[1]

    def body(n):
        return [ast.dump(s) for s in n.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)) and not isinstance(s, ast.Pass)]

    assert body(node) == body(old)  # nothing but the docstring changed


@given(st.lists(st.sampled_from(HEADERS), min_size=1, max_size=5), st.lists(st.text(max_size=20), min_size=6, max_size=6), st.randoms())
@settings(max_examples=150, deadline=None)
def test_many_edits_of_one_file(parts, docs, rng):
    text = "#!/bin/x\n'''Old module.'''\n" + "".join(p if p.endswith("\n") else p + "\n" for p in parts)
    heads = sorted(n.lineno for n in ast.walk(ast.parse(text)) if getattr(n, "name", None) == "f")
    edits = [{"is_module": False, "lineno": n, "new_docstring": d} for n, d in zip(heads, docs)] + [{"is_module": True, "lineno": 0, "new_docstring": docs[-1]}]
    random.Random(rng.random()).shuffle(edits)
    new, status = patch_text(text, edits)
    tree = ast.parse(new)
    nodes = sorted((n for n in ast.walk(tree) if getattr(n, "name", None) == "f"), key=lambda n: n.lineno)
    by_line = {e["lineno"]: (e["new_docstring"], s) for e, s in zip(edits, status)}
    for n, head in zip(nodes, heads, strict=True):
        doc, said = by_line[head]
        if said == "ok":
            want = "\n".join(doc.strip().splitlines()).strip()
            assert (ast.get_docstring(n) or "").split() == want.split()
    assert new.startswith("#!/bin/x\n")


def test_statuses():
    text = "x = '''\ndef no(): pass\n'''\n"
    assert patch_text(text, [{"is_module": False, "lineno": 2, "new_docstring": "d"}])[1][0].startswith("Line 2 is not a definition")
    assert patch_text("def f(:\n", [{"is_module": False, "lineno": 1, "new_docstring": "d"}])[1][0].startswith("Syntax error in file")
    assert patch_text("'''Old'''; x = 1\n", [{"is_module": True, "lineno": 0, "new_docstring": ""}]) == ("x = 1\n", ["ok"])
    assert patch_text("def f():\r\n    return 1\r\n", [{"is_module": False, "lineno": 1, "new_docstring": "a\nb"}])[0] == (
        'def f():\r\n    """a\r\n    b\r\n    """\r\n    return 1\r\n')


def test_untouched_files_do_not_move(spark):
    rows = [("p", "s", f"/f{i}.py", f"f{i}.py", f"f{i}", f"def f():\n    return {i}\n") for i in range(400)]
    sources = spark.createDataFrame(rows, SOURCE_FILES)
    edits = spark.createDataFrame([("p", "/f7.py", "f7", "FUNCTION", 1, "Doc.", 1)],
                                  "project string, file_path string, module string, method string, lineno int, new_docstring string, edited_at int")
    near, far = touched.split_by_keys(sources, patch.latest_edits(edits), ["project", "file_path"])
    assert near.count() <= 3 and near.count() + far.count() == 400 and near.where("module = 'f7'").count() == 1
    assert "Exchange" not in far._jdf.queryExecution().executedPlan().toString()
    out = patch.patch_docstrings(sources, edits, "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Union")[1].count("MapInArrow") == 1
    texts = {r.module: r.source for r in out.collect()}
    assert texts["f7"] == 'def f():\n    """Doc."""\n    return 7\n' and texts["f8"] == rows[8][5] and len(texts) == 400
    none = touched.split_by_keys(sources, patch.latest_edits(edits.where("false")), ["project", "file_path"])
    assert none[0].count() == 0 and none[1].count() == 400


def test_versioned_appends(spark):
    path = tempfile.mkdtemp(prefix="docmetrics-versions-")
    kind = "project string, ts timestamp_ntz, seq long, text string"

    def batch(lo, hi):
        rows = [(p, i, f"{p}{i}") for i in range(lo, hi) for p in ("a", "007", None) if p == "a" or i % 10 == 0]
        df = spark.createDataFrame(rows, "project string, seq long, text string")
        return df.selectExpr("project", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(seq div 2)) AS ts", "seq", "text")

    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    done = [versions.append(batch(lo, lo + 40), path, f"b{lo}", 50, ["seq"]) for lo in (0, 40, 80, 40, 120)]
    assert done == [True, True, True, False, True]
    got = versions.read(spark, path, ["seq"])
    assert got.select(*[f.split()[0] for f in kind.split(", ")]).dtypes == [tuple(f.split()) if f != "seq long" else ("seq", "bigint") for f in kind.split(", ")]
    rows = [(r.project, r.seq) for r in got.collect()]
    assert sorted(s for p, s in rows if p == "a") == list(range(110, 160))
    assert sorted(s for p, s in rows if p == "007") == sorted(s for p, s in rows if p is None) == list(range(0, 160, 10))
    entries = versions._entries(spark, path).collect()
    assert {e.project for e in entries if e.batch.startswith("compact")} == {"a"}  # others were not written again
    assert all(e.live for e in entries if e.project != "a")
    dead = [r.file for r in versions.dead_files(spark, path).collect()]
    assert dead and all("project=a/" in f for f in dead)


@pytest.mark.parametrize("match", ["first", "longest"])
def test_price_table_equals_compiled_list(spark, match):
    rng = random.Random(3)
    names = ["gpt", "o3", "a", "ab", "x-y-z", ""][: 5] + ["".join(rng.choice("abgpt-o3") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    names = list(dict.fromkeys(names))
    listed = [pr.Price(n, f"{i}.25", f"{i}.5") for i, n in enumerate(names)] + [pr.Price("default", "1.00", "3.00")]
    models = [None, "", "DEFAULT", "zzzz", *names[::3], *[n.upper() + "x" for n in names[::5]], *["q" + n[1:] for n in names[::4]], *["".join(rng.choice("abgpt-o3") for _ in range(12)) for _ in range(60)]]
    requests = spark.createDataFrame([(i, m, 1000 + i, i) for i, m in enumerate(models)], "id int, model string, prompt_tokens long, completion_tokens long")
    want = usage.price_requests(requests, listed, match).withColumn("price_key", pr.price_key(requests["model"], listed, match))
    table = spark.createDataFrame([(p.model, p.input, p.output, i) for i, p in enumerate(listed)], "model string, i string, o string, list_rank int").selectExpr(
        "model", "cast(i as decimal(10,4)) input_per_million", "cast(o as decimal(10,4)) output_per_million", "list_rank")
    got = usage.price_requests_by_table(requests, table, match)
    assert sorted((r.id, r.price_key, r.cost) for r in got.collect()) == sorted((r.id, r.price_key, r.cost) for r in want.collect())


@pytest.mark.parametrize("files", [1, 3, 7])
def test_scans_close_whole_whatever_the_batches(spark, files):
    base = tempfile.mkdtemp(prefix="docmetrics-scans-")
    rows = [(f"p{i % 2}", f"s{i % 3}", "FUNCTION", f"m{i % 4}", "doc" if i % 5 else None, None) for i in range(120)]
    marks = [(f"p{p}", f"s{s}", None, None, None, 20) for p in range(2) for s in range(3)]
    open_scan = [("p9", "s0", "CLASS", "m", "x", None), ("p9", "s0", None, None, None, 2)]
    kind = "project string, snapshot_id string, method string, module string, docstring string, expected_items long"
    everything = [*marks, *rows, *open_scan]
    for k in range(files):
        spark.createDataFrame(everything[k::files], kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.stream_scans(stream, f"{base}/out", f"{base}/state").awaitTermination()
    got = sorted(map(tuple, jobs.read_scans(spark, f"{base}/out").select("project", "snapshot_id", "level", "name", "total", "documented").collect()))
    items = spark.createDataFrame(rows, kind)
    want = []
    for s in range(3):
        snap = cov.coverage_snapshot(items.where(f"snapshot_id = 's{s}'")).collect()
        want += [(r.project, f"s{s}", r.level, r.name, r.total, r.documented) for r in snap]
    assert got == sorted(want)


def test_positions_do_not_depend_on_splits(spark):
    base = tempfile.mkdtemp(prefix="docmetrics-positions-")
    with open(f"{base}/a.json", "w") as f:
        f.writelines('{"qualname": "q%d", "module": "m"}\n' % i for i in range(5000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = store.read_items(spark, f"{base}/a.json", rows_are_lines=True)
        assert rows.rdd.getNumPartitions() > 1
        assert all(r.qualname == f"q{r.item_ordinal}" for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    asked = spark.createDataFrame([("default", "latest"), ("other", "x")], "project string, snapshot_id string")
    assert sorted(map(tuple, store.report_status(rows, asked).collect())) == [("default", "latest", True, 5000), ("other", "x", False, 0)]
