"""Relations between code elements: classes, edges, diagram lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions import text as tx
from docmetrics.operators.lines import Part, emit, say, union
from docmetrics.operators.ordered import top_k, with_previous
from docmetrics.schema import CLASS_KINDS, ITEM_ORDER
from docmetrics.session import settled

# --------------------------------------------------------------------------------------
# Stereotype words, arrows, colours, header lines, presets.
STEREOTYPE_WORDS = [
    (["service"], "service"),
    (["model", "schema"], "model"),
    (["repository", "dao"], "repository"),
    (["controller", "router"], "controller"),
    (["config"], "configuration"),
]
ARROWS = {
    "INHERITANCE": "--|>",
    "COMPOSITION": "*--",
    "AGGREGATION": "o--",
    "DEPENDENCY": "..>",
    "ASSOCIATION": "-->",
    "IMPLEMENTATION": "..|>",
    "IMPORT": "..>",
}
DRAWN_ORDER = [
    "INHERITANCE", "IMPLEMENTATION", "COMPOSITION", "AGGREGATION", "ASSOCIATION", "DEPENDENCY",
]
HEADER = [
    "@startuml", "!theme plain", "skinparam classAttributeIconSize 0",
    "skinparam classFontSize 12", "skinparam packageStyle rectangle", "",
]
STEREOTYPE_COLORS = [
    ("service", "#E1F5FE", "#2196F3"),
    ("model", "#E8F5E8", "#4CAF50"),
    ("repository", "#FFF3E0", "#FF9800"),
    ("controller", "#F3E5F5", "#9C27B0"),
    ("configuration", "#FFEBEE", "#F44336"),
    ("interface", "#F1F8E9", "#8BC34A"),
]
ARCHITECTURE_WORDS = ["router", "endpoint", "service", "model", "schema", "dependency"]
FLOW_LINES = [
    "", "participant Client", "participant Router", "participant Endpoint",
    "participant Service", "participant Repository", "participant Database", "",
    "Client -> Router : HTTP Request", "Router -> Endpoint : route()",
    "Endpoint -> Service : process()", "Service -> Repository : save()",
    "Repository -> Database : execute()", "Database --> Repository : result",
    "Repository --> Service : data", "Service --> Endpoint : response",
    "Endpoint --> Router : HTTP Response", "Router --> Client : JSON Response", "", "@enduml",
]
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Diagram:
    """What a diagram shows. `view` is overview, detailed, services, models or architecture."""

    view: str = "detailed"
    methods: bool = True
    attributes: bool = True
    private: bool = False
    max_classes: int = 20
    focus_packages: tuple[str, ...] = ()
    exclude_packages: tuple[str, ...] = ("builtins", "typing", "collections")
    by_package: bool = True
    stereotypes: bool = True
    colors: bool = True
    direction: str = "top to bottom direction"
    name: str = field(default="custom")


DIAGRAMS = {
    "overview": Diagram("overview", False, False, max_classes=15,
                        direction="left to right direction", name="overview"),
    "detailed": Diagram("detailed", max_classes=10, name="detailed"),
    "services": Diagram("services", True, False, max_classes=12,
                        focus_packages=("services",), name="services"),
    "models": Diagram("models", False, True, max_classes=15,
                      focus_packages=("models", "schemas"), name="models"),
    "fastapi": Diagram("architecture", True, False, max_classes=20, name="fastapi"),
}


def _any(col: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return out


# ---- classes --------------------------------------------------------------------------


def stereotype(qualname: Column, signature: Column) -> Column:
    low, sig = F.lower(qualname), F.coalesce(signature, F.lit(""))
    out = F.lit(None).cast("string")
    rules = [(_any(low, words), name) for words, name in STEREOTYPE_WORDS]
    rules += [(_any(sig, ["BaseModel", "Schema"]), "model"), (_any(sig, ["Protocol"]), "interface")]
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def is_abstract(signature: Column, docstring: Column) -> Column:
    return F.coalesce(signature.contains("ABC"), F.lit(False)) | F.coalesce(
        F.lower(docstring).contains("abstract"), F.lit(False)
    )


def latest_class(
    items: DataFrame, keep: dict[str, Column] | None = None, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """The last definition of each class name per project, with the columns in `keep`.

    An aggregate, so many copies of one name shrink before the shuffle. Only short
    columns should be kept: the rows are sorted by name on the way.
    """
    keep = keep or {n: F.col(n) for n in ("module", "method", "signature", "lineno", "file_path")}
    slim = items.filter(F.col("method").isin(CLASS_KINDS)).select(
        "project", "qualname", F.struct(*order).alias("at"), F.struct(*[v.alias(k) for k, v in keep.items()]).alias("c")
    )
    latest = slim.groupBy("project", "qualname").agg(F.max(F.struct("at", "c")).alias("m"))
    return latest.select("project", "qualname", F.col("m.at").alias("at"), "m.c.*")


RUN_LENGTH = 65536


def reading_blocks() -> list[Column]:
    """Directory, file and ordinal range: the runs of the default item order."""
    directory = F.regexp_extract("file_path", r"^(.*)/", 1)
    return [directory, F.col("file_path"), F.floor(F.col("item_ordinal") / RUN_LENGTH)]


def legacy_class_carry(
    items: DataFrame, blocks: Sequence[Column] | None = None, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """Each item with the last class row at or before it in list order.

    The list goes directory by directory, then by file and ordinal.
    """
    is_class = F.when(F.col("method").isin(CLASS_KINDS), F.col("qualname"))
    runs = reading_blocks() if blocks is None else blocks
    return with_previous(items, ["project"], runs, order, is_class, "carried_class", True)


def _members(items: DataFrame, owner: Column, order: Sequence[str]) -> DataFrame:
    name = tx.method_name(F.col("qualname"))
    private = name.startswith("_")
    params = F.transform(
        F.filter("param_types", lambda p: p["name"] != "self"),
        lambda p: F.when(tx.is_given(p["type"]), F.concat(p["name"], F.lit(": "), p["type"])).otherwise(
            p["name"]
        ),
    )
    returns = F.when(
        tx.is_given(F.col("return_type")), F.concat(F.lit(" : "), "return_type")
    ).otherwise("")
    sign = F.when(private, "-").otherwise("+")
    is_async = F.col("method") == "ASYNC_FUNCTION"
    call = F.concat(
        sign, F.lit(" "),
        F.when(F.contains(F.col("signature"), F.lit("staticmethod")), "{static} ").otherwise(""),
        F.when(is_async, "async ").otherwise(""),
        name, F.lit("("), F.array_join(params, ", "), F.lit(")"), returns,
    )
    attribute = F.concat(sign, F.lit(" "), name, returns)
    brief = F.concat(F.lit("+ "), F.when(is_async, "async ").otherwise(""), name, F.lit("()"))
    is_attribute = F.col("method") == "PROPERTY"
    return (
        items.filter(F.col("method").isin("FUNCTION", "ASYNC_FUNCTION", "PROPERTY"))
        .withColumn("owner", owner)
        .filter(F.col("owner").isNotNull())
        .select(
            "project", *dict.fromkeys(["file_path", *order]), "owner", name.alias("name"),
            private.alias("is_private"), is_attribute.alias("is_attribute"),
            F.when(is_attribute, attribute).otherwise(call).alias("text"),
            F.when(is_attribute, attribute).otherwise(brief).alias("brief"),
        )
    )


def attach_methods(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """Members of each class: methods and properties of the same file whose name starts
    with the class name. Long form: one row per class member, with its drawn text."""
    members = _members(items, tx.containing_class(F.col("qualname")), order)
    owners = items.filter(F.col("method").isin(CLASS_KINDS)).select(
        "project", "file_path", F.col("qualname").alias("owner")
    ).distinct()
    return members.join(owners, ["project", "file_path", "owner"])


def attach_methods_legacy(
    items: DataFrame, blocks: Sequence[Column] | None = None, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """Members attached to the last class seen in list order, even across files."""
    return _members(legacy_class_carry(items, blocks, order), F.col("carried_class"), order)


def uml_classes(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """Latest class rows with package, stereotype, abstract mark and member counts."""
    heads = latest_class(items, {
        "package": F.coalesce("module", F.lit("")),
        "file_path": F.col("file_path"),
        "stereotype": stereotype(F.col("qualname"), F.col("signature")),
        "is_abstract": is_abstract(F.col("signature"), F.col("docstring")),
    }, order)
    sizes = attach_methods(items, order).groupBy("project", "file_path", F.col("owner").alias("qualname")).agg(
        F.count_if(~F.col("is_attribute")).alias("methods"),
        F.count_if("is_attribute").alias("attributes"),
    )
    zero = {n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in ("methods", "attributes")}
    return heads.join(sizes, ["project", "file_path", "qualname"], "left").withColumns(zero)


# ---- edges ----------------------------------------------------------------------------


def base_classes(signature: Column) -> Column:
    """Names between `inherits=(` and the next `)`, cut at every comma."""
    inside = F.regexp_extract(signature, r"(?s)inherits=\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ",", -1), tx.strip), lambda x: x != "")


def _edge(kind: str, source: Column, target: Column, label=None, mark=None) -> Column:
    text = lambda v: (F.lit(None) if v is None else v).cast("string")
    return F.struct(
        source.alias("source"), target.alias("target"), F.lit(kind).alias("relationship_type"),
        text(label).alias("label"), text(mark).alias("stereotype"),
    )


def edges_per_item() -> Column:
    """Every edge one item gives rise to, as an array: no edge needs a second item."""
    q, kind = F.col("qualname"), F.col("method")
    none = F.lit(None)
    holder = F.coalesce(tx.containing_class(q), q)
    custom = F.filter("param_types", lambda p: tx.is_custom_type(p["type"]))
    is_init = q.endswith(".__init__")
    inherits = F.transform(base_classes(F.coalesce("signature", F.lit(""))), lambda b: _edge("INHERITANCE", q, b))
    owner = F.regexp_replace(q, r"\.__init__$", "")
    composed = F.transform(custom, lambda p: _edge("COMPOSITION", owner, p["type"], p["name"]))
    depends = F.transform(
        F.filter("dependencies", lambda d: d != q),
        lambda d: _edge("DEPENDENCY", q, d, None, F.lit("depends")),
    )
    uses = F.transform(
        custom,
        lambda p: _edge("ASSOCIATION", holder, p["type"], F.concat(F.lit("uses("), p["name"], F.lit(")"))),
    )
    returns = F.when(
        tx.is_custom_type(F.col("return_type")),
        F.array(_edge("ASSOCIATION", holder, F.col("return_type"), F.lit("returns"))),
    )
    routed = F.transform(
        F.coalesce("tags", tx.no_strings()),
        lambda t: _edge("COMPOSITION", F.concat(t, F.lit("Router")), q, None, F.lit("router")),
    )
    is_function = kind.isin("FUNCTION", "ASYNC_FUNCTION")
    parts = [
        F.when(kind.isin(CLASS_KINDS), inherits),
        F.when((kind == "FUNCTION") & is_init, composed),
        depends,
        F.when(is_function & ~is_init, uses),
        F.when(is_function, returns),
        routed,
    ]
    empty = F.filter(F.array(_edge("", q, q)), lambda _: F.lit(False))
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def edges(items: DataFrame, distinct: bool = False, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """All relations, one narrow pass over the items; `distinct` drops repeats."""
    out = items.select("project", *order, F.explode(edges_per_item()).alias("e")).select(
        "project", *order, "e.*"
    )
    return out.drop(*order).distinct() if distinct else out


def edges_of(items: DataFrame, kind: str, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    return edges(items, order=order).filter(F.col("relationship_type") == kind)


def edges_within(edge_rows: DataFrame, class_set: DataFrame) -> DataFrame:
    """Edges with both ends in the class set (project, qualname)."""
    names = class_set.select("project", "qualname").distinct()
    return edge_rows.join(
        names.withColumnRenamed("qualname", "source"), ["project", "source"], "left_semi"
    ).join(names.withColumnRenamed("qualname", "target"), ["project", "target"], "left_semi")


def graph_stats(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """Distinct class names, relations and class packages per project, in one pass."""
    is_class = F.col("method").isin(CLASS_KINDS)
    return items.groupBy("project").agg(
        F.count_distinct(F.when(is_class, F.col("qualname"))).alias("classes"),
        F.sum(F.size(edges_per_item()).cast("bigint")).alias("relationships"),
        F.count_distinct(F.when(is_class, F.col("module"))).alias("packages"),
    )


def degree_stats(edge_rows: DataFrame) -> DataFrame:
    """In and out degree per element and relation type."""
    ends = edge_rows.select(
        "project",
        F.explode(
            F.array(
                F.struct(F.col("source").alias("element"), F.lit("out").alias("side")),
                F.struct(F.col("target").alias("element"), F.lit("in").alias("side")),
            )
        ).alias("e"),
        "relationship_type",
    ).select("project", "e.*", "relationship_type")
    return ends.groupBy("project", "element", "relationship_type").agg(
        F.count_if(F.col("side") == "out").alias("out_degree"),
        F.count_if(F.col("side") == "in").alias("in_degree"),
    )


def edge_text(multiplicity: Column | None = None) -> Column:
    arrow = F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv])[F.col("relationship_type")]
    times = F.lit("")
    if multiplicity is not None:
        times = F.when(
            tx.is_given(multiplicity), F.concat(F.lit(' "'), multiplicity, F.lit('"'))
        ).otherwise("")
    label = F.when(tx.is_given(F.col("label")), F.concat(F.lit(" : "), "label")).otherwise("")
    return F.concat("source", F.lit(" "), arrow, F.lit(" "), "target", times, label)


# ---- diagrams -------------------------------------------------------------------------


def select_classes(class_rows: DataFrame, config: Diagram) -> DataFrame:
    """Classes a diagram shows: the filters, then the first `max_classes` per project."""
    package, name, mark = F.col("package"), F.lower("qualname"), F.col("stereotype")
    keep = ~_any(package, config.exclude_packages)
    if config.focus_packages:
        keep = keep & _any(package, config.focus_packages)
    if not config.private:
        keep = keep & ~F.col("qualname").startswith("_")
    known = F.coalesce(mark, F.lit(""))
    rules = {
        "services": known.isin("service", "repository") | name.contains("service"),
        "models": (known == "model") | _any(name, ["model", "schema"]),
        "architecture": _any(name, ARCHITECTURE_WORDS),
    }
    if config.view in rules:
        keep = keep & rules[config.view]
    return top_k(
        class_rows.filter(keep), ["project"], [F.asc("at")], config.max_classes, "place",
        ["qualname"],
    )


def diagram_lines(
    items: DataFrame, config: Diagram, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """A class diagram per project as ordered lines (section, k1, k2, line_no).

    Sections: 0 header, 1 packages with classes and members, 2 relations by type, 3 end.
    """
    shown = settled(select_classes(uml_classes(items, order), config))
    out = lambda df, *parts: emit(df, "diagram", *parts, key=config.name)
    styling = [
        line
        for mark, fill, border in STEREOTYPE_COLORS
        for line in (
            f"skinparam class<<{mark}>>BackgroundColor {fill}",
            f"skinparam class<<{mark}>>BorderColor {border}",
        )
    ]
    head = HEADER + ([*styling, ""] if config.colors else []) + [config.direction, ""]
    frame = out(
        items.select("project").distinct(), Part(0, head), Part(2, [""]), Part(3, ["@enduml"])
    )

    # Packages appear in the order of their first class; at most max_classes rows each.
    first = shown.groupBy("project", "package").agg(F.min("place").alias("_first"))
    placed = shown.join(first, ["project", "package"])
    pkg = F.format_string("%09d", F.col("_first")) if config.by_package else F.lit("")
    pad = "  " if config.by_package else ""
    mark = F.lit("")
    if config.stereotypes:
        mark = F.when(
            F.col("stereotype").isNotNull(), say(" <<", F.col("stereotype"), ">>")
        ).otherwise("")
    opening = say(
        pad, F.when(F.col("is_abstract"), "abstract class ").otherwise("class "),
        F.col("qualname"), mark, " {",
    )
    # Within a package: by class, then opening, attributes, rule, methods, closing; members of a
    # role by their ordinal, which is the key's number, so none wraps or ties.
    def spot(role: str | Column) -> Column:
        role = F.lit(role) if isinstance(role, str) else role
        return F.concat(pkg, F.lit("\x01"), F.format_string("%09d", F.col("place")), role)

    ruled = (F.col("attributes") > 0) & (F.col("methods") > 0)
    parts = [
        frame,
        out(
            placed,
            Part(1, [opening], spot("0"), F.lit(0)),
            Part(1, [f"{pad}  --"], spot("2"), F.lit(0), ruled & F.lit(config.attributes and config.methods)),
            Part(1, [f"{pad}}}"] if config.by_package else [f"{pad}}}", ""], spot("4"), F.lit(0)),
        ),
    ]
    if config.by_package:
        parts.append(
            out(
                first,
                Part(1, [say("package ", F.col("package"), " {")], pkg, F.lit(0)),
                Part(1, ["}", ""], F.concat(pkg, F.lit("\x02")), F.lit(0)),
            )
        )
    if config.attributes or config.methods:
        # Members of the few shown classes only; the file bounds their number.
        wanted = F.lit(True) if config.private else ~F.col("is_private")
        if not config.methods:
            wanted = wanted & F.col("is_attribute")
        if not config.attributes:
            wanted = wanted & ~F.col("is_attribute")
        owners = placed.select(
            "project", "file_path", F.col("qualname").alias("owner"), "place", "_first"
        )
        members = _members(items, tx.containing_class(F.col("qualname")), order)
        mine = members.filter(wanted).join(owners, ["project", "file_path", "owner"])
        drawn = F.col("brief") if config.view == "overview" else F.col("text")
        role = F.when(F.col("is_attribute"), F.lit("1")).otherwise(F.lit("3"))
        parts.append(out(mine, Part(1, [say(f"{pad}  ", drawn)], spot(role), F.col(order[-1]))))

    rank = F.array_position(F.array(*[F.lit(k) for k in DRAWN_ORDER]), F.col("relationship_type"))
    inner = edges_within(edges(items, order=order), shown).filter(rank > 0)
    key = F.format_string("%02d", rank.cast("int"))
    title = say("' ", F.initcap("relationship_type"), " relationships")
    parts += [
        # In reading order; of one item first what it uses, then what it returns, by text.
        out(inner, Part(2, [edge_text()], F.concat_ws(
            "\x01", key, *[F.col(o).cast("string") for o in order[:-1]], F.format_string("%019d", F.col(order[-1])),
            F.when(F.col("label") == "returns", "1").otherwise("0"), edge_text()), F.lit(0))),
        out(
            inner.select("project", "relationship_type").distinct(),
            Part(2, [title], key, F.lit(-1)), Part(2, [""], F.concat(key, F.lit("\x02")), F.lit(0)),
        ),
    ]
    return union(parts)


def endpoint_flow(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """A request flow per project, titled with its first endpoint."""
    verbs = F.col("method").isin("GET", "POST", "PUT", "DELETE")
    first = items.filter(verbs).groupBy("project").agg(
        F.min_by("qualname", F.struct(*order)).alias("endpoint")
    )
    title = F.concat(F.lit("title "), "endpoint", F.lit(" Request Flow"))
    text = F.concat(
        F.array(F.lit("@startuml"), title), F.array(*[F.lit(x) for x in FLOW_LINES])
    )
    return first.select("project", "endpoint", F.array_join(text, "\n").alias("text"))
