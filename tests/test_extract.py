import pytest
from pyspark.sql import functions as F

from docmetrics.operators import coverage as cov
from docmetrics.schema import SOURCE_FILES
from docmetrics.sources.extract import docstring_checks, scan_errors, scan_facts, items_from_facts

API = '''"""Shop API."""
from fastapi import FastAPI, APIRouter, Depends
from pydantic import BaseModel

app = FastAPI(title="Shop", version="1.0", debug=flag)
router = APIRouter(prefix="/v1", tags=["x"])


class Item(BaseModel):
    """An item of the shop, with its name and price and more."""
    name: str
    price: float = 0.0
    note = None

    class Config:
        """Settings."""
        orm_mode = True
        extra = Extra.allow


class Base:
    class Inner(Base, Generic[K, V]):
        def deep(self):
            def helper(x):
                raise KeyError(x)
            raise errors.Custom("x")

    @property
    def size(self) -> int:
        """Size."""
        return 1

    @staticmethod
    def make(a, *, b: int = 2, **kw): pass

    @classmethod
    def build(cls, a): pass


@router.get("/items/{id}", tags=["items", "read"], summary="Read", response_model=Item,
            status_code=200, responses={404: {}, "default": {}}, operation_id="read_item")
@router.post("/items", description="Write")
async def read(id: int, db: Session = Depends(get_db), *, user=Depends(auth.user)) -> Item:
    """Read an item.

    Args:
        id: the item
        user: who

    Returns:
        Item: found

    Raises:
        ValueError: if bad
        errors.NotFound: if absent
    """
    if id < 0:
        raise ValueError("id")
    raise ValueError


@app.websocket("/ws")
def sock(ws): ...
'''


def by(rows, qualname, method):
    return next(r for r in rows if r.qualname == qualname and r.method == method)


def test_reading_order_and_kinds(scan):
    rows = scan(API)
    assert [(r.qualname, r.method) for r in rows] == [
        ("<module>", "MODULE"),
        ("app", "METADATA"), ("app", "METADATA"),
        ("router", "ROUTER_METADATA"),
        ("Item", "PYDANTIC_MODEL"), ("Item.Config", "PYDANTIC_CONFIG"), ("Item.Config", "CLASS"),
        ("Base", "CLASS"), ("Base.Inner", "CLASS"), ("Base.Inner.deep", "FUNCTION"),
        ("Base.Inner.helper", "FUNCTION"),
        ("Base.size", "PROPERTY"), ("Base.make", "STATICMETHOD"), ("Base.build", "CLASSMETHOD"),
        ("read", "ASYNC_FUNCTION"), ("read", "GET"), ("read", "POST"),
        ("sock", "FUNCTION"), ("sock", "WEBSOCKET"),
    ]


def test_class_facts(scan):
    rows = scan(API)
    model = by(rows, "Item", "PYDANTIC_MODEL")
    assert [(p.name, p.type) for p in model.param_types] == [
        ("name", "str"), ("price", "float"), ("note", "Any")
    ]
    assert model.signature == "inherits=(BaseModel)"
    assert (model.coverage_score, model.quality_score) == (100.0, 100.0)
    assert by(rows, "Item.Config", "PYDANTIC_CONFIG").signature == "orm_mode=True, extra=Extra.allow"
    assert by(rows, "Item.Config", "PYDANTIC_CONFIG").coverage_score == 0.0
    inner = by(rows, "Base.Inner", "CLASS")
    assert inner.signature == "nested_level=1 | inherits=(Base, Generic[K, V])"
    assert inner.completeness_issues == ["Missing class docstring"]
    assert by(rows, "Base", "CLASS").param_types == []


def test_function_facts(scan):
    rows = scan(API)
    deep = by(rows, "Base.Inner.deep", "FUNCTION")
    assert deep.raised_exceptions == ["KeyError", "Custom"]
    assert deep.actual_params == []
    make = by(rows, "Base.make", "STATICMETHOD")
    assert make.actual_params == ["a", "**kw", "b"]
    assert make.missing_params == ["a", "b"]
    assert by(rows, "Base.build", "CLASSMETHOD").actual_params == ["cls", "a"]
    read = by(rows, "read", "ASYNC_FUNCTION")
    assert read.signature == "id: int, db: Session=Depends(get_db), *, user=Depends(auth.user)"
    assert read.dependencies == ["get_db", "auth.user"]
    assert [(d.name, d.type) for d in read.dependency_docs] == [("db", "get_db"), ("user", "auth.user")]
    assert read.raised_exceptions == ["ValueError"]
    assert read.documented_exceptions == ["ValueError", "errors.NotFound"]
    assert read.documented_params == ["id"]
    assert read.return_type == "Item" and read.has_return_doc and read.has_type_hints
    assert read.full_source.startswith("async def read") and read.full_source.endswith("raise ValueError")
    assert read.first_lines == "\n".join(read.full_source.split("\n")[1:6])


def test_section_mode_reads_all_parameters(scan):
    read = by(scan(API, params_mode="section"), "read", "GET")
    assert read.documented_params == ["id", "user"]
    assert read.missing_params == ["db"]


def test_endpoint_facts(scan):
    rows = scan(API)
    get = by(rows, "read", "GET")
    assert get.path == "/items/{id}" and get.tags == ["items", "read"]
    assert get.status_codes == ["200", "404", "default"]
    assert get.response_model == "Item" and get.operation_id == "read_item"
    assert get.description == "Read" and get.summary_from_decorator == "Read"
    post = by(rows, "read", "POST")
    assert post.description == "Write" and post.summary_from_decorator is None
    assert by(rows, "sock", "WEBSOCKET").path == "/ws"
    # model .9, codes .8, tags .8, id .7, no dependency parameter described 0
    assert get.api_completeness_score == pytest.approx(64.0)


def test_worked_scores(scan):
    rows = scan('def a() -> int: pass\ndef b(): pass\ndef c(x, y):\n    """Short one here, with length."""\n')
    assert [r.complexity_score for r in rows] == [80.0, 100.0, 70.0]
    assert [r.coverage_score for r in rows] == [50.0, 60.0, 50.0]
    assert rows[2].completeness_issues == ["Missing parameter docs: ['x', 'y']", "Missing type hints"]
    assert rows[0].completeness_issues == ["Missing docstring", "Missing return documentation"]


def test_many_functions(scan):
    source = "".join(f'def f{i}(a: int) -> int:\n    """Do {i}."""\n    return a\n\n' for i in range(1000))
    rows = scan(source)
    assert len(rows) == 1000 and rows[999].qualname == "f999"


def test_unicode_and_windows_lines(scan):
    rows = scan({"u.py": 'def größe(ñ: "ü"):\n    """Größe – 漢字."""\n    return "é" + ñ\n'})
    assert rows[0].qualname == "größe" and rows[0].docstring == "Größe – 漢字."
    assert rows[0].full_source.endswith('return "é" + ñ')


def test_errors_become_rows(spark):
    files = [("bad.py", "def broken(:"), ("empty.py", ""), ("imports.py", "import os\n"), ("nul.py", None)]
    df = spark.createDataFrame(
        [("p", "s", f"/{n}", n, n[:-3], t) for n, t in files], SOURCE_FILES
    )
    facts = scan_facts(df)
    errors = {r.file_path: r.error for r in scan_errors(facts).collect()}
    assert set(errors) == {"/bad.py", "/nul.py"}
    assert errors["/bad.py"].startswith("SyntaxError")
    assert items_from_facts(facts).count() == 0


def test_wiring_is_optional(spark):
    text = "app.add_middleware(cors.CORS, x=1)\napp.include_router(api.router, prefix='/p', tags=['t'])\n"
    df = spark.createDataFrame([("p", "s", "/a.py", "a.py", "a", text)], SOURCE_FILES)
    assert items_from_facts(scan_facts(df)).count() == 0
    rows = items_from_facts(scan_facts(df, wiring=True)).orderBy("item_ordinal").collect()
    assert [(r.method, r.qualname, r.path, r.tags) for r in rows] == [
        ("MIDDLEWARE", "cors.CORS", "", []), ("ROUTER_INCLUSION", "api.router", "/p", ["t"])
    ]


def test_mixed_docs_coverage(scan, spark, make_items):
    source = '''
def a():
    """A."""
def b(): pass
class C:
    """C."""
    def d(self):
        """D."""
    def e(self): pass
class F:
    def g(self):
        """G."""
    def h(self): pass
'''
    rows = scan(source)
    assert (len(rows), sum(bool(r.docstring) for r in rows)) == (8, 4)


def test_docstring_checks(make_items):
    items = make_items([{"qualname": "a", "docstring": "fine"}, {"qualname": "b", "docstring": 'x""" + ('}])
    rows = {r.qualname: r for r in docstring_checks(items).collect()}
    assert rows["a"].valid and rows["a"].message == "Docstring syntax is valid"
    assert not rows["b"].valid and rows["b"].message.startswith("Docstring syntax error")


def test_dedupe_endpoints(scan, spark):
    from docmetrics.sources.extract import extract_items

    df = spark.createDataFrame([("p", "s", "/a.py", "a.py", "a", API)], SOURCE_FILES)
    kept = cov.dedupe_endpoints(extract_items(df)).filter(F.col("qualname").isin("read", "sock"))
    assert sorted(r.method for r in kept.collect()) == ["GET", "POST", "WEBSOCKET"]
