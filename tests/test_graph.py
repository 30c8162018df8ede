from pyspark.sql import functions as F

from docmetrics.operators import graph
from docmetrics.plans import pages

ORDER = ["section", "k1", "k2", "line_no"]


def named(*pairs):
    return [{"name": n, "type": t} for n, t in pairs]


def fixture(make_items):
    fn = {"dependencies": [], "tags": [], "param_types": [], "module": "app", "signature": ""}
    return make_items([
        {**fn, "qualname": "UserModel", "method": "PYDANTIC_MODEL", "signature": "inherits=(BaseModel, Generic[K, V])"},
        {**fn, "qualname": "UserService", "method": "CLASS", "signature": "inherits=(ABC)", "docstring": "x"},
        {**fn, "qualname": "UserService.__init__", "method": "FUNCTION",
         "param_types": named(("self", "Any"), ("m", "UserModel"), ("n", "int"))},
        {**fn, "qualname": "UserService.get", "method": "ASYNC_FUNCTION", "param_types": named(("m", "UserModel")),
         "return_type": "UserModel"},
        {**fn, "qualname": "UserService.size", "method": "PROPERTY", "return_type": "int"},
        {**fn, "qualname": "UserService._hide", "method": "FUNCTION"},
        {**fn, "qualname": "UserService.make", "method": "STATICMETHOD", "param_types": named(("m", "UserModel"))},
        {**fn, "qualname": "read", "method": "GET", "dependencies": ["get_db", "read"], "tags": ["users"]},
        {**fn, "qualname": "_Private", "method": "CLASS"},
    ])


def texts(df):
    return [r.text for r in df.orderBy(*ORDER).collect()]


def test_edges(make_items):
    rows = graph.edges(fixture(make_items)).collect()
    got = sorted((r.source, r.relationship_type, r.target, r.label or "", r.stereotype or "") for r in rows)
    assert got == sorted([
        ("UserModel", "INHERITANCE", "BaseModel", "", ""), ("UserModel", "INHERITANCE", "Generic[K", "", ""),
        ("UserModel", "INHERITANCE", "V]", "", ""), ("UserService", "INHERITANCE", "ABC", "", ""),
        ("UserService", "COMPOSITION", "UserModel", "m", ""),
        ("UserService", "ASSOCIATION", "UserModel", "uses(m)", ""), ("UserService", "ASSOCIATION", "UserModel", "returns", ""),
        ("read", "DEPENDENCY", "get_db", "", "depends"), ("usersRouter", "COMPOSITION", "read", "", "router"),
    ])


def test_classes(make_items):
    rows = {r.qualname: r for r in graph.uml_classes(fixture(make_items)).collect()}
    assert rows["UserService"].stereotype == "service" and rows["UserService"].is_abstract
    assert rows["UserModel"].stereotype == "model" and not rows["UserModel"].is_abstract
    assert (rows["UserService"].methods, rows["UserService"].attributes) == (3, 1)
    assert rows["_Private"].stereotype is None


def test_last_class_definition_counts(make_items):
    items = make_items([
        {"qualname": "A", "method": "CLASS", "module": m, "signature": s, "file_path": f"/{m}.py"}
        for m, s in [("a", ""), ("b", "inherits=(ABC)")]
    ])
    rows = graph.uml_classes(items).collect()
    assert [(r.package, r.is_abstract) for r in rows] == [("b", True)]


def test_diagram(make_items):
    config = graph.Diagram(view="detailed", colors=False, name="d")
    assert texts(graph.diagram_lines(fixture(make_items), config)) == graph.HEADER + [
        "top to bottom direction", "",
        "package app {",
        "  class UserModel <<model>> {", "  }",
        "  abstract class UserService <<service>> {",
        "    + size : int", "    --",
        "    + async get(m: UserModel) : UserModel",
        "  }",
        "}", "", "",
        "' Composition relationships", "UserService *-- UserModel : m", "",
        "' Association relationships", "UserService --> UserModel : uses(m)", "UserService --> UserModel : returns", "",
        "@enduml",
    ]
    lines = texts(graph.diagram_lines(fixture(make_items), config))
    assert lines[:8] == graph.HEADER + ["top to bottom direction", ""]
    assert "    + async get(m: UserModel) : UserModel" in lines and "    - _hide()" not in lines
    assert lines.index("    + size : int") < lines.index("    --") < lines.index("    + async get(m: UserModel) : UserModel")
    assert lines.index("' Composition relationships") < lines.index("' Association relationships")
    assert lines[-1] == "@enduml" and not any("_Private" in x for x in lines)


def test_diagram_presets(make_items):
    items = fixture(make_items)
    overview = texts(graph.diagram_lines(items, graph.DIAGRAMS["overview"]))
    assert "left to right direction" in overview and not any("get(" in x for x in overview)
    services = graph.select_classes(graph.uml_classes(items.withColumn("module", F.lit("services"))), graph.DIAGRAMS["services"])
    assert [r.qualname for r in services.collect()] == ["UserService"]
    few = graph.select_classes(graph.uml_classes(items), graph.Diagram(max_classes=1))
    assert [r.qualname for r in few.collect()] == ["UserModel"]


def test_legacy_members_follow_list_order(make_items):
    rows = graph.attach_methods_legacy(fixture(make_items)).collect()
    assert {r.owner for r in rows} == {"UserService"} and len(rows) == 4


def test_degree(make_items):
    rows = {(r.element, r.relationship_type): (r.out_degree, r.in_degree) for r in graph.degree_stats(graph.edges(fixture(make_items))).collect()}
    assert rows[("UserService", "ASSOCIATION")] == (2, 0) and rows[("UserModel", "ASSOCIATION")] == (0, 2)


def test_flow(make_items):
    row = graph.endpoint_flow(fixture(make_items)).first()
    assert row.text.startswith("@startuml\ntitle read Request Flow\n\nparticipant Client") and row.text.endswith("@enduml")


def test_module_tree_of_any_depth(make_items):
    items = make_items([{"module": m, "qualname": f"q{i}", "method": "FUNCTION"} for i, m in enumerate(["a.b.c", "a.b", "z", "a.d", "a.b"])])
    assert texts(pages.tree_lines(items, "tree", 0)) == [
        "├── a", "│   ├── b", "│   │   ├── q1 (FUNCTION)", "│   │   ├── q4 (FUNCTION)", "│   │   └── c",
        "│   │       └── q0 (FUNCTION)", "│   └── d", "│       └── q3 (FUNCTION)", "└── z", "    └── q2 (FUNCTION)",
    ]


def test_pages_without_endpoints_list_services(make_items):
    items = make_items([{"module": "m", "qualname": "MailService", "method": "CLASS", "docstring": "Sends.\nMore."}])
    lines = texts(pages.page_reference(items))
    assert "No API endpoints found in the current documentation set." in lines
    assert lines[-2:] == ["- **MailService** - m", "  - Sends."]


def test_all_documented_page(make_items):
    lines = texts(pages.coverage_page(make_items([{"method": "GET", "docstring": "x"}]), "now"))
    assert "<p>All items are documented!</p>" in lines and any("00875a" in x for x in lines)
