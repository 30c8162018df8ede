"""Documentation pages as tables of ordered lines.

Pages are kept as lines with a sort key (section, k1, k2, line_no); the page writer
range-partitions by that key. Lines that come from the same rows are made in one pass
over them. Only pages that belong to a single item are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.functions import text as tx
from docmetrics.functions.numbers import exact_round, fixed_text, percent
from docmetrics.operators import coverage as cov
from docmetrics.operators import graph
from docmetrics.operators.lines import Part, emit, say, union
from docmetrics.schema import ENDPOINT_KINDS, ITEM_ORDER
from docmetrics.session import settled

MISSING_SHOWN = 20


def lit(x) -> Column:
    return F.lit(x)


def rekeyed(page: DataFrame, kind: str, section: int) -> DataFrame:
    """The lines of another page as one section of this one."""
    return page.withColumns(
        {
            "k1": F.concat(F.format_string("%03d", "section"), lit("\x01"), "k1"),
            "section": lit(section), "page_kind": lit(kind),
        }
    )


def page_stats(items: DataFrame) -> DataFrame:
    """The numbers of a page, one row per project, in one pass."""
    has = cov.is_documented("B")
    kinds = {
        "modules": F.col("method") == "MODULE", "classes": F.col("method") == "CLASS",
        "functions": F.col("method") == "FUNCTION", "endpoints": F.col("method").isin(ENDPOINT_KINDS),
    }
    out = items.groupBy("project").agg(
        F.count("*").alias("total"), F.count_if(has).alias("documented"),
        *[F.count_if(test).alias(n) for n, test in kinds.items()],
    )
    rate = exact_round(percent(F.col("documented"), F.col("total")), 1)
    return out.withColumns({"missing": F.col("total") - F.col("documented"), "coverage": rate})


def _n(name: str) -> Column:
    return F.col(name).cast("string")


def _place(order: Sequence[str]) -> tuple[Column, Column]:
    """Sort key of an item inside a section: all but the last order column, and the last."""
    return F.concat_ws("\x01", *[F.col(o).cast("string") for o in order[:-1]]), F.col(order[-1])


# ---- module tree ----------------------------------------------------------------------


def module_tree(items: DataFrame) -> DataFrame:
    """One node per dotted prefix: path, parent, name, depth, own items, drawn prefix.

    `rail` is the text drawn before the children of a node, `branch` the node's own mark.
    """
    modules = settled(
        items.filter(tx.is_given(F.col("module"))).groupBy("project", "module").agg(
            F.count("*").alias("n")
        )
    )
    parts = F.split("module", r"\.", -1)
    prefixes = modules.select(
        "project", parts.alias("parts"), "n",
        F.explode(F.sequence(lit(1), F.size(parts))).alias("depth"),
    )
    nodes = prefixes.groupBy(
        "project", "depth", F.slice("parts", lit(1), F.col("depth")).alias("steps")
    ).agg(F.sum(F.when(F.size("parts") == F.col("depth"), F.col("n")).otherwise(0)).alias("items"))
    nodes = nodes.select(
        "project", "depth", "items", "steps",
        F.array_join("steps", ".").alias("path"),
        F.array_join(F.slice("steps", lit(1), F.col("depth") - 1), ".").alias("parent"),
        F.element_at("steps", -1).alias("name"),
    )
    # A node is last if no sibling has a greater name; sibling lists have no bound, so
    # this is an aggregate joined back and not a window.
    last = nodes.groupBy("project", "parent", "depth").agg(
        F.max("name").alias("_last"), F.count("*").alias("_siblings")
    )
    flagged = nodes.join(last, ["project", "parent", "depth"]).withColumn(
        "is_last", F.col("name") == F.col("_last")
    )
    ancestors = flagged.select(
        "project", "path", F.posexplode(F.transform(
            F.sequence(lit(1), F.col("depth")), lambda d: F.array_join(F.slice("steps", lit(1), d), ".")
        )).alias("level", "above"),
    )
    marks = flagged.select("project", F.col("path").alias("above"), F.col("is_last").alias("l"))
    # At most one entry per level of the path.
    chain = ancestors.join(marks, ["project", "above"]).groupBy("project", "path").agg(
        F.sort_array(F.collect_list(F.struct("level", "l"))).alias("chain")
    )
    rail = F.array_join(F.transform("chain", lambda x: F.when(x["l"], "    ").otherwise("│   ")), "")
    above = F.array_join(
        F.transform(
            F.slice("chain", lit(1), F.size("chain") - 1),
            lambda x: F.when(x["l"], "    ").otherwise("│   "),
        ),
        "",
    )
    has_children = last.select(
        "project", F.col("parent").alias("path"), lit(True).alias("has_children")
    ).distinct()
    return (
        flagged.join(chain, ["project", "path"])
        .join(has_children, ["project", "path"], "left")
        .select(
            "project", "path", "parent", "name", "depth", "items", "is_last",
            F.coalesce("has_children", lit(False)).alias("has_children"),
            F.array_join("steps", "\x01").alias("sort_key"),
            rail.alias("rail"),
            say(above, F.when(F.col("is_last"), "└── ").otherwise("├── ")).alias("branch"),
        )
    )


def tree_lines(items: DataFrame, kind: str, section: int, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    tree = settled(module_tree(items))
    nodes = emit(tree, kind, Part(section, [say(F.col("branch"), F.col("name"))], F.col("sort_key"), lit(-1)))
    slim = items.filter(tx.is_given(F.col("module"))).select(
        "project", F.col("module").alias("path"), "qualname", "method",
        F.struct(*order).alias("at"), F.col(order[-1]).alias("n"),
    )
    ends = slim.groupBy("project", "path").agg(F.max("at").alias("end"))
    places = tree.select("project", "path", "sort_key", "rail", "has_children").join(ends, ["project", "path"])
    # Module rows are few against item rows; adaptive execution picks the join and splits
    # a module that holds much of a project.
    leaf = slim.join(places, ["project", "path"])
    closing = (F.col("at") == F.col("end")) & ~F.col("has_children")
    text = say(
        F.col("rail"), F.when(closing, "└── ").otherwise("├── "), F.col("qualname"), " (",
        F.col("method"), ")",
    )
    # A module's items stand after its own line and before its children, file by file.
    place = F.concat_ws("\x01", F.col("sort_key"), F.lit(""), *[F.col(f"at.{o}").cast("string") for o in order[:-1]])
    return nodes.unionByName(emit(leaf, kind, Part(section, [text], place, F.col("n"))))


# ---- markdown pages -------------------------------------------------------------------


def page_index(items: DataFrame, generated: str) -> DataFrame:
    texts = [
        say("# ", F.col("project"), " Documentation"), "",
        say("Welcome to the ", F.col("project"), " documentation. Generated on ", generated, "."), "",
        "## Documentation Statistics", "",
        say("- **Total Items**: ", _n("total")),
        say("- **Documented**: ", _n("documented"), " (", _n("coverage"), "%)"),
        say("- **Missing Documentation**: ", _n("missing")), "",
        "### Coverage by Type", "", "| Type | Count |", "|------|-------|",
        *[
            say(f"| {label} | ", _n(name), " |")
            for label, name in [
                ("Modules", "modules"), ("Classes", "classes"), ("Functions", "functions"),
                ("Endpoints", "endpoints"),
            ]
        ],
    ]
    return emit(page_stats(items), "index", Part(0, texts))


def _summary() -> Column:
    return F.when(tx.is_given(F.col("docstring")), say("  - ", tx.first_line(F.col("docstring"))))


def page_structure(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    k = "code_structure"
    key, at = _place(order)
    kind, name = F.col("method"), F.col("qualname")
    listed = items.withColumn("listed_module", cov.listed_module())
    heads = listed.filter(kind == "FUNCTION").select("project", "listed_module").distinct()
    return union([
        emit(
            page_stats(items), k,
            Part(0, ["# Code Structure", "", "## Module Hierarchy", ""]),
            Part(2, ["", "## Detailed Structure", "", say("### Modules (", _n("modules"), ")"), ""]),
            Part(4, ["", say("### Classes (", _n("classes"), ")"), ""]),
            Part(6, ["", say("### Functions (", _n("functions"), ")"), ""]),
        ),
        tree_lines(items, k, 1, order),
        emit(
            listed.filter(kind.isin("MODULE", "CLASS", "FUNCTION")), k,
            Part(3, [say("- **", F.col("module"), "** - ", F.col("file_path")), _summary()],
                 key, at, kind == "MODULE"),
            Part(5, [say("- **", name, "** (", F.col("module"), ")"), _summary()], key, at, kind == "CLASS"),
            Part(7, [say("- `", name, "()` - Line ", _n("lineno")), _summary()],
                 say(F.col("listed_module"), "\x01", key), at, kind == "FUNCTION"),
        ),
        emit(heads, k, Part(7, ["", say("#### ", F.col("listed_module")), ""], F.col("listed_module"))),
    ])


def page_coverage(items: DataFrame, generated: str, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    k = "docstring_report"
    key, at = _place(order)
    bare = cov.missing(items)
    heads = bare.select("project", "listed_module").distinct()
    longest = cov.longest_docstrings(items, 10, order=order)
    return union([
        emit(
            page_stats(items), k,
            Part(0, [
                "# Documentation Coverage Report", "", say("Generated on: ", generated), "",
                "## Summary", "", say("- **Total Items**: ", _n("total")),
                say("- **Documented**: ", _n("documented"), " (", _n("coverage"), "%)"),
                say("- **Missing Documentation**: ", _n("missing")), "", "## Coverage Visualization", "",
                "```", say("[", tx.coverage_bar(F.col("coverage")), "] ", _n("coverage"), "%"), "```", "",
                "## Items Missing Documentation", "",
            ]),
            Part(2, ["", "## Well-Documented Items", ""]),
        ),
        emit(heads, k, Part(1, ["", say("### ", F.col("listed_module")), ""], F.col("listed_module"))),
        emit(bare, k, Part(
            1, [say("- `", F.col("qualname"), "` (", cov.kind(), ") - Line ", _n("lineno"))],
            say(F.col("listed_module"), "\x01", key), at,
        )),
        emit(longest, k, Part(
            3, [say("- `", F.col("qualname"), "` (", F.col("module"), ") - ", _n("length"), " characters")],
            None, F.col("place"),
        )),
    ])


def page_reference(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """Endpoint entries; projects without endpoints list their service classes."""
    k = "api_reference"
    key, at = _place(order)
    is_endpoint = F.col("method").isin(ENDPOINT_KINDS)
    counts = items.groupBy("project").agg(F.count_if(is_endpoint).alias("n"))
    services = items.filter(
        (F.col("method") == "CLASS") & F.contains(F.lower("qualname"), lit("service"))
    ).join(counts.filter(F.col("n") == 0).select("project"), "project", "left_semi")
    return union([
        emit(
            counts, k,
            Part(0, ["# API Reference", "", "## Endpoints", ""]),
            Part(2, ["No API endpoints found in the current documentation set.", "",
                     "## Available Services", ""], when=F.col("n") == 0),
        ),
        emit(items.filter(is_endpoint), k, Part(1, [
            say("### ", F.col("qualname")), "", say("- **Method**: ", F.col("method")),
            say("- **Path**: ", F.col("path")), say("- **Module**: ", F.col("module")), "",
            F.when(tx.is_given(F.col("docstring")), F.col("docstring")),
        ], key, at)),
        emit(services, k, Part(
            3, [say("- **", F.col("qualname"), "** - ", F.col("module")), _summary()], key, at
        )),
    ])


def page_history(items: DataFrame, snapshots: DataFrame, generated: str) -> DataFrame:
    """Current numbers and one table row per stored snapshot."""
    k = "changelog"
    return union([
        emit(page_stats(items), k, Part(0, [
            "# Changelog", "", "## Current Version", "", say("**Generated**: ", generated),
            say("**Total Items**: ", _n("total")), say("**Coverage**: ", _n("coverage"), "%"), "",
            say("- ", _n("missing"), " items still need documentation"), "", "### Coverage Trend", "",
            "| Date | Total Items | Documented | Coverage |",
            "|------|-------------|------------|----------|",
        ])),
        emit(snapshots, k, Part(1, [
            say("| ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " | ", _n("total_items"), " | ",
                _n("documented_items"), " | ", _n("coverage_percent"), "% |")
        ], F.date_format("ts", "yyyyMMddHHmmssSSSSSS"))),
    ])


def with_overview(pages: DataFrame, overview: DataFrame) -> DataFrame:
    """Rows with their project's overview texts, '' where it has none.

    One overview per project: joined on project with the size left to the optimizer.
    """
    names = ["project_purpose", "business_context", "key_business_value"]
    joined = pages.join(overview.select("project", *names, "has_overview"), "project", "left")
    return joined.withColumns(
        {**{n: F.coalesce(n, lit("")) for n in names}, "has_overview": F.coalesce("has_overview", lit(False))}
    )


def _overview_texts(heading: str) -> list:
    shown = F.col("has_overview")
    out: list = [F.when(shown, lit(heading)), F.when(shown, lit(""))]
    for label, name in [
        ("Project Purpose", "project_purpose"), ("Business Context", "business_context"),
        ("Key Business Value", "key_business_value"),
    ]:
        given = shown & tx.is_given(F.col(name))
        out += [F.when(given, say(f"**{label}:** ", F.col(name))), F.when(given, lit(""))]
    return out


def _metrics() -> list:
    return [
        "| Metric | Value |", "|--------|-------|",
        *[
            say(f"| {label} | ", _n(name), f"{unit} |")
            for label, name, unit in [
                ("Total Items", "total", ""), ("Documented", "documented", ""),
                ("Coverage", "coverage", "%"), ("Modules", "modules", ""),
                ("Classes", "classes", ""), ("Functions", "functions", ""),
            ]
        ],
    ]


def page_overview(items: DataFrame, overview: DataFrame) -> DataFrame:
    s = with_overview(page_stats(items), overview)
    return emit(s, "overview", Part(0, [
        "# Project Overview", "", *_overview_texts("## Business Overview"), "## Technical Overview", "",
        *_metrics(),
    ]))


def page_master(
    items: DataFrame, overview: DataFrame, generated: str, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    k = "confluence_master"
    s = with_overview(page_stats(items), overview)
    sample = cov.missing_sample(items, 10, "B", order=order)
    return union([
        emit(
            s, k,
            Part(0, [
                say("# ", F.col("project"), " Documentation"), "", say("> **Generated**: ", generated),
                say("> **Coverage**: ", _n("coverage"), "%"), say("> **Total Items**: ", _n("total")), "",
                "---", "", *_overview_texts("## 💼 Business Overview"), "## 📋 Technical Overview", "",
                "### Key Metrics", "", *_metrics(), "", "---", "", "## 🏗️ Architecture", "",
                "### Module Structure", "", "```",
            ]),
            Part(2, [
                "```", "", "---", "", "## 📊 Documentation Coverage", "", "### Summary",
                say("- ✅ Documented: ", _n("documented"), " items"),
                say("- ❌ Missing: ", _n("missing"), " items"),
                say("- 📈 Coverage: ", _n("coverage"), "%"), "", "### Items Needing Documentation", "",
            ]),
        ),
        tree_lines(items, k, 1, order),
        emit(
            sample, k,
            Part(3, [say("- `", F.col("qualname"), "` (", F.col("module"), ") - Line ", _n("lineno"))],
                 None, F.col("place")),
            Part(4, ["", say("*... and ", _n("more"), " more items*")],
                 when=(F.col("place") == 1) & (F.col("more") > 0)),
        ),
    ])


# ---- wiki pages -----------------------------------------------------------------------


def endpoint_pages(items: DataFrame) -> DataFrame:
    """One page row per endpoint: title and storage markup. Row by row, no shuffle."""
    rows = tx.with_docstring_sections(
        items.filter(F.col("method").isin(ENDPOINT_KINDS)), "docstring", "_s"
    )
    d = lambda name: F.col(f"_s.{name}")
    row = lambda label, value: say(f"<tr><th>{label}</th><td>", value, "</td></tr>")
    code = lambda x: say("<code>", x, "</code>")
    args = F.transform(
        d("args"),
        lambda a: say("<tr><td><code>", a["name"], "</code></td><td>", a["description"], "</td></tr>"),
    )
    raises = F.transform(
        d("raises"),
        lambda e: say("<li><code>", e["type"], "</code>: ", e["description"], "</li>"),
    )
    body = F.concat_ws(
        "\n",
        lit("<h2>Endpoint Details</h2><table><tbody>"),
        row("Method", code(F.col("method"))), row("Path", code(F.col("path"))),
        row("Module", F.coalesce("module", lit("N/A"))),
        row("Function", code(F.coalesce("qualname", lit("N/A")))),
        lit("</tbody></table><h2>Description</h2>"),
        say("<p>", F.coalesce(d("description"), lit("No description available")), "</p>"),
        F.when(
            F.size(d("args")) > 0,
            say("<h2>Parameters</h2><table><thead><tr><th>Name</th><th>Description</th></tr>"
                 "</thead><tbody>", F.array_join(args, ""), "</tbody></table>"),
        ),
        F.when(tx.is_given(d("returns")), say("<h2>Returns</h2><p>", d("returns"), "</p>")),
        F.when(
            F.size(d("raises")) > 0,
            say("<h2>Exceptions</h2><ul>", F.array_join(raises, ""), "</ul>"),
        ),
        lit("<h2>Metadata</h2><table><tbody>"),
        row("Documentation Coverage", say(_n("coverage_score"), "%")),
        lit("</tbody></table>"),
    )
    return rows.select(
        "project", *ITEM_ORDER,
        say("API: ", F.col("method"), " ", F.col("path")).alias("title"), body.alias("body"),
    )


def panel_color(coverage: Column) -> Column:
    return F.when(coverage >= 80, "00875a").when(coverage < 50, "de350b").otherwise("ff991f")


def coverage_page(items: DataFrame, generated: str, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    k = "coverage_page"
    levels = cov.coverage_snapshot(items, "A")
    sample = cov.missing_sample(items, MISSING_SHOWN, "A", order=order)
    cell = lambda x: say("<td>", x, "</td>")
    share = fixed_text(F.col("coverage"), 1)
    total = F.col("level") == "project"
    gaps = F.col("total") > F.col("documented")
    return union([
        emit(
            levels, k,
            Part(0, [
                "<h1>Documentation Coverage Report</h1>", say("<p>Generated on: ", generated, "</p>"),
                "<h2>Overall Coverage</h2>",
                '<ac:structured-macro ac:name="panel" ac:schema-version="1">',
                say('<ac:parameter ac:name="bgColor">#', panel_color(F.col("coverage")), "</ac:parameter>"),
                say('<ac:rich-text-body><h3 style="color: white;">', share, "% Coverage</h3>"),
                say('<p style="color: white;">', _n("documented"), " of ", _n("total"),
                    " items documented</p></ac:rich-text-body></ac:structured-macro>"),
                "<h2>Coverage by Type</h2><table><thead><tr><th>Type</th><th>Total</th>"
                "<th>Documented</th><th>Coverage</th></tr></thead><tbody>",
            ], when=total),
            Part(1, [say("<tr>", cell(F.col("name")), cell(_n("total")), cell(_n("documented")),
                         cell(say(share, "%")), "</tr>")], F.col("name"), when=F.col("level") == "method"),
            Part(2, [
                "</tbody></table><h2>Undocumented Items</h2>",
                F.when(gaps, lit(
                    "<table><thead><tr><th>Module</th><th>Name</th><th>Type</th><th>File</th></tr>"
                    "</thead><tbody>"
                )).otherwise(lit("<p>All items are documented!</p>")),
            ], when=total),
            Part(5, ["</tbody></table>"], when=total & gaps),
        ),
        emit(
            sample, k,
            Part(3, [say(
                "<tr>", cell(F.coalesce("module", lit("N/A"))),
                cell(say("<code>", F.coalesce("qualname", lit("N/A")), "</code>")),
                cell(F.coalesce("method", lit("N/A"))), cell(F.coalesce("file_path", lit("N/A"))), "</tr>",
            )], None, F.col("place")),
            Part(4, [say(
                '<tr><td colspan="4"><em>... and ', _n("more"), " more undocumented items</em></td></tr>"
            )], when=(F.col("place") == 1) & (F.col("more") > 0)),
        ),
    ])


def latex_body(items: DataFrame, order: Sequence[str] = ITEM_ORDER) -> DataFrame:
    """Statistics, modules, items by kind and coverage per kind as LaTeX lines."""
    k = "latex"
    key, at = _place(order)
    esc = lambda x: tx.escape_latex(F.col(x))
    title = lambda x: F.initcap(F.replace(x, lit("_"), lit(" ")))
    total = cov.coverage_total(items, rule="B").join(cov.module_counts(items), "project")
    modules = cov.distinct_modules(items)
    kinds = cov.coverage_by(
        items.withColumn("method", F.nullif(F.col("method"), lit(""))), "method", rule="E"
    )
    typed = items.withColumn("item_type", F.coalesce(F.nullif(F.col("method"), lit("")), lit("UNKNOWN")))
    return union([
        emit(
            total, k,
            Part(0, [
                r"\subsection{Documentation Statistics}", r"\begin{itemize}",
                say(r"    \item \textbf{Total Items:} ", _n("total")),
                say(r"    \item \textbf{Documented Items:} ", _n("documented")),
                say(r"    \item \textbf{Coverage:} ", fixed_text(F.col("coverage"), 1), r"\%"),
                say(r"    \item \textbf{Modules:} ", _n("modules")), r"\end{itemize}",
                r"\subsection{Project Modules}", r"\begin{itemize}",
            ]),
            Part(2, [r"\end{itemize}", r"\section{Code Documentation}"]),
            Part(4, [r"\section{Coverage Analysis}"]),
        ),
        emit(modules, k, Part(1, [say(r"    \item \texttt{", esc("module"), "}")], F.col("module"))),
        emit(
            kinds, k,
            Part(3, [say(r"\subsection{", title(F.col("method")), "}")], F.col("method")),
            Part(5, [
                say(r"\subsection{", title(F.col("method")), " Coverage}"),
                say(_n("total"), " total items, ", _n("documented"), " documented (",
                    fixed_text(F.col("coverage"), 1), r"\%)."),
            ], F.col("method")),
        ),
        emit(typed, k, Part(3, [
            say(r"\subsubsection{\texttt{", esc("qualname"), "}}"), r"\begin{itemize}",
            say(r"    \item \textbf{Module:} \texttt{", F.coalesce(esc("module"), lit("")), "}"),
            say(r"    \item \textbf{File:} \texttt{",
                F.coalesce(F.nullif(esc("file_path"), lit("")), lit("N/A")), "}"),
            say(r"    \item \textbf{Line:} ", F.coalesce(F.nullif(_n("lineno"), lit("0")), lit("N/A"))),
            r"\end{itemize}",
            F.when(tx.is_given(F.col("docstring")), say(
                "\\paragraph{Documentation:}\n\\begin{quote}\n", esc("docstring"), "\n\\end{quote}"
            )).otherwise(lit(r"\paragraph{Documentation:} \textit{No documentation available}")),
            F.when(tx.is_given(F.col("first_lines")), say(
                "\\paragraph{Source Code Preview:}\n\\begin{verbatim}\n", F.col("first_lines"),
                "\n\\end{verbatim}"
            )),
            r"\vspace{1em}",
        ], say(F.col("item_type"), "\x01", key), at)),
    ])


def diagram_page(
    items: DataFrame, config: graph.Diagram, order: Sequence[str] = ITEM_ORDER
) -> DataFrame:
    """Counts of classes, relations and packages, then the diagram lines."""
    k = "diagram_page"
    return union([
        emit(graph.graph_stats(items, order), k, Part(0, [
            "<h2>Analysis Summary</h2><ul>",
            say("<li>Classes: ", _n("classes"), "</li>"),
            say("<li>Relationships: ", _n("relationships"), "</li>"),
            say("<li>Packages: ", _n("packages"), "</li>"), "</ul>",
        ])),
        rekeyed(graph.diagram_lines(items, config, order), k, 1).withColumn("page_key", lit("")),
    ])
