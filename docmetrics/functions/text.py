r"""Docstring and page text rules as native columns; nothing here leaves the JVM.

Patterns carry the flags `U` (Unicode `\w`, `\s`) and `d` (only `\n` ends a line), so
they read text by code point and line feed alone. Blocks of lines are matched with
possessive repeats: the JVM runs those as a loop, while a lazy or greedy repeat of a
group recurses once per line and overflows the stack on a long docstring.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------------------
# Section words and patterns that decide results.
# Section words per docstring style; each entry of a style counts once.
GOOGLE_SECTIONS = [
    ["arg", "args", "argument", "arguments"],
    ["return", "returns"],
    ["yield", "yields"],
    ["raise", "raises"],
    ["note", "notes"],
    ["example", "examples"],
]
NUMPY_SECTIONS = [
    ["parameters"],
    ["return", "returns"],
    ["yield", "yields"],
    ["raise", "raises"],
    ["note", "notes"],
    ["example", "examples"],
]
# Sphinx fields; those marked with a blank at the end carry a name.
SPHINX_FIELDS = [
    ["param "], ["type "], ["return", "returns"], ["rtype"], ["raise ", "raises "], ["note"], ["example"],
]
SECTION_WORDS = "Args?|Arguments?|Returns?|Yields?|Raises?|Notes?|Examples?"
PARAM_WORDS = ["arg", "args", "argument", "arguments", "parameter", "parameters"]
PARAM_NAME = r"\s+(\w+)(?:\s*\([^)]*\))?\s*:"
EXCEPTION_NAME = r"(\w+(?:\.\w+)*(?:Error|Exception|\w+))"
BUILTIN_TYPES = [
    "str", "int", "float", "bool", "list", "dict", "tuple", "set",
    "List", "Dict", "Tuple", "Set", "Optional", "Union", "Any",
]
LATEX_ESCAPES = [
    ("\\", "\\textbackslash{}"),
    ("{", "\\{"),
    ("}", "\\}"),
    ("$", "\\$"),
    ("&", "\\&"),
    ("%", "\\%"),
    ("#", "\\#"),
    ("^", "\\textasciicircum{}"),
    ("_", "\\_"),
    ("~", "\\textasciitilde{}"),
]
# --------------------------------------------------------------------------------------

NO_STRINGS = "cast(array() as array<string>)"


def no_strings() -> Column:
    return F.expr(NO_STRINGS)


def words(*names: str) -> Column:
    """A constant array of plain words."""
    return F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")")


def lines_of(col: Column) -> Column:
    return F.split(col, "\n", -1)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def is_given(col: Column) -> Column:
    """Present and not empty; never null."""
    return F.coalesce(col != "", F.lit(False))


def has_text(col: Column) -> Column:
    """Present and more than white space; never null."""
    return F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))


def list_text(col: Column) -> Column:
    """Names as bracketed, quoted list text: ['a', 'b']."""
    quoted = F.transform(col, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


# ---- parameters and return ------------------------------------------------------------


def section_marks(doc: Column) -> Column:
    """Section marks of a docstring in lower case: google, numpy and sphinx arrays.

    One scan per style. Google headers and sphinx fields are looked for at colons, the
    words before them by look-behind, so plain text is passed over quickly; numpy headers
    only where the text has a ruler character at all.
    """

    def scan(pattern, guard):
        found = F.regexp_extract_all(doc, F.lit(pattern), F.lit(1))
        return F.when(guard, F.transform(found, F.lower)).otherwise(no_strings())

    colon = F.coalesce(doc.contains(":"), F.lit(False))
    ruler = F.coalesce(doc.contains("-") | doc.contains("="), F.lit(False))
    google = scan(rf"(?iUd):(?<=({SECTION_WORDS}|Parameters?):)\s*\n", colon)
    numpy = scan(
        r"(?iUd)(Parameters|Returns?|Yields?|Raises?|Notes?|Examples?)\s*\n\s*[-=]+", ruler
    )
    field = r"(?iUd):((?:param|type|raises?)\s+\w+|returns?|rtype|note|example)(?=:)"
    sphinx = F.transform(
        scan(field, colon), lambda x: F.regexp_replace(x, r"(?Us)\s+\w+\z", " ")
    )
    return F.struct(google.alias("google"), numpy.alias("numpy"), sphinx.alias("sphinx"))


def documented_params(doc: Column, marks: Column, mode: str = "first_line") -> Column:
    """Parameter names a docstring describes.

    `first_line` reads only the first line of an argument section, `section` reads it to
    the next section. Without any such name, `:param x:` fields are used.
    """
    header = r":(?<=(?:Args?|Arguments?|Parameters?):)\s*\n"
    if mode == "first_line":
        body = F.regexp_extract(doc, rf"(?iUd){header}([^\n]*)", 1)
        google = F.regexp_extract_all(body, F.lit(rf"(?Ud)\A{PARAM_NAME}"), F.lit(1))
    elif mode == "section":
        stop = r"\n\s*(?:Returns?|Return|Yields?|Yield|Raises?|Note|Example)s?:"
        body = F.regexp_extract(doc, rf"(?isUd){header}(.*?)(?={stop}|\z)", 1)
        google = F.regexp_extract_all(body, F.lit(rf"(?mUd)^{PARAM_NAME}"), F.lit(1))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sphinx = F.regexp_extract_all(doc, F.lit(r"(?Ud):param\s+(\w+):"), F.lit(1))
    has_section = F.arrays_overlap(marks["google"], words(*PARAM_WORDS))
    found = F.when(has_section, google).otherwise(no_strings())
    found = F.when(F.size(found) > 0, found).otherwise(sphinx)
    return F.when(is_given(doc), found).otherwise(no_strings())


def has_return_doc(doc: Column) -> Column:
    """A return or yield word directly before a colon; `:returns:` is one of them."""
    return F.coalesce(doc.rlike(r"(?iUd):(?<=(?:returns?|yields?):)"), F.lit(False))


def missing_params(actual: Column, documented: Column) -> Column:
    return F.filter(
        actual, lambda p: ~F.array_contains(documented, p) & ~F.startswith(p, F.lit("*"))
    )


def extra_params(actual: Column, documented: Column) -> Column:
    return F.filter(documented, lambda p: ~F.array_contains(actual, p))


def docstring_length(doc: Column) -> Column:
    return F.coalesce(F.length(doc), F.lit(0))


# ---- style ----------------------------------------------------------------------------


def style_hits(marks: Column) -> Column:
    """How many sections of each style a docstring shows."""

    def count(style, sections):
        mine = marks[style]
        seen = [F.arrays_overlap(mine, words(*names)).cast("int") for names in sections]
        return reduce(add, seen).alias(style)

    return F.struct(
        count("google", GOOGLE_SECTIONS), count("numpy", NUMPY_SECTIONS), count("sphinx", SPHINX_FIELDS)
    )


def _leading_styles(hits: Column) -> Column:
    top = F.greatest(hits["google"], hits["numpy"], hits["sphinx"])
    names = ("google", "numpy", "sphinx")
    return F.when(top == 0, no_strings()).otherwise(
        F.array_compact(F.array(*[F.when(hits[n] == top, F.lit(n)) for n in names]))
    )


def docstring_style(doc: Column, hits: Column) -> Column:
    """google, numpy, sphinx by most section marks (ties in that order), else plain."""
    first = F.get(_leading_styles(hits), F.lit(0))
    return F.when(is_given(doc), F.coalesce(first, F.lit("plain")))


def empty_google_headers(doc: Column, marks: Column) -> Column:
    """Header words whose first usable section is empty, in lower case.

    A section is empty when an empty line follows its header and the next text is not
    indented. The colon is captured only where the first usable header is empty. Only
    words the docstring has are looked at.
    """
    empty = r"[^\S\n]*\n(?:\s*+\z|(?=\n)\s*+(?<=\n)\S)"
    used = r"[^\S\n]*\n\s"

    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains(marks["google"], word)
                    & (
                        F.regexp_extract(
                            doc, rf"(?iUd)(?:(:)(?={empty})|:(?={used}))(?<={word}:)", 1
                        )
                        == ":"
                    ),
                    word,
                )
                for names in GOOGLE_SECTIONS
                for word in names
            ]
        )
    )


def _google_issues(doc: Column, empty: Column) -> Column:
    headers = F.regexp_extract_all(
        doc,
        F.lit(r"(?miUd)^\s*(Args?|Arguments?|Returns?|Yields?|Raises?|Notes?|Examples?):\s*$"),
        F.lit(1),
    )
    empty_ones = F.filter(headers, lambda h: F.array_contains(empty, F.lower(h)))
    issues = F.transform(empty_ones, lambda h: F.concat(F.lit("Empty "), h, F.lit(" section")))
    return F.when(F.size(empty) > 0, issues).otherwise(no_strings())


def _numpy_issues(doc: Column) -> Column:
    pattern = F.lit(r"(?mUd)^\s*(\w+)\s*\n\s*([-=]+)")
    pairs = F.arrays_zip(
        F.regexp_extract_all(doc, pattern, F.lit(1)).alias("head"),
        F.regexp_extract_all(doc, pattern, F.lit(2)).alias("rule"),
    )
    short = F.filter(pairs, lambda x: F.length(x["rule"]) < F.length(x["head"]))
    return F.transform(
        short,
        lambda x: F.concat(F.lit("Underline too short for section '"), x["head"], F.lit("'")),
    )


def _sphinx_issues(doc: Column) -> Column:
    params = F.regexp_extract_all(doc, F.lit(r"(?Ud):param\s+(\w+):"), F.lit(1))
    typed = F.regexp_extract_all(doc, F.lit(r"(?Ud):type\s+(\w+):"), F.lit(1))
    untyped = F.array_sort(F.array_except(params, typed))
    text = F.concat(F.lit("Missing type declarations for parameters: "), list_text(untyped))
    return F.when(F.size(untyped) > 0, F.array(text)).otherwise(no_strings())


def style_issues(doc: Column, hits: Column, empty: Column) -> Column:
    """A mixed-style note, then the issues of the leading style.

    `hits` and `empty` come from `style_hits` and `empty_google_headers`, as columns of
    their own: they are used several times and must not be worked out each time.
    """
    leaders = _leading_styles(hits)
    style = docstring_style(doc, hits)
    mixed = F.when(
        F.size(leaders) > 1,
        F.array(F.concat(F.lit("Mixed docstring styles detected: "), list_text(leaders))),
    ).otherwise(no_strings())
    own = (
        F.when(style == "google", _google_issues(doc, empty))
        .when(style == "numpy", _numpy_issues(doc))
        .when(style == "sphinx", _sphinx_issues(doc))
        .otherwise(no_strings())
    )
    return F.when(is_given(doc), F.concat(mixed, own)).otherwise(no_strings())


# ---- exceptions -----------------------------------------------------------------------


def documented_exceptions(doc: Column, marks: Column, mode: str = "reference") -> Column:
    """Exception names of a Raises section or `:raises X:` fields, first seen first.

    `reference` reads a numpy section only from indented lines; `section` reads the
    names at the start of its lines.
    """
    line = r"[^\S\n]\s*+\S[^\n]*(?:\n(?=\s|\z))?"
    block = F.regexp_extract(
        doc, rf"(?iUd):(?<=Raises?:)[^\S\n]*\n(?=\s|\z)(\n*+(?:{line})*+)", 1
    )
    google = F.regexp_extract_all(
        block, F.lit(rf"(?mUd)^\s+{EXCEPTION_NAME}(?:\s*:|\s+)"), F.lit(1)
    )
    ruled = r"(?isUd)Raises?\s*\n\s*[-=]+\s*\n(.*?)(?=\n\s*\w+\s*\n\s*[-=]+|\z)"
    raise_words = words("raise", "raises")
    numpy_block = F.when(
        F.arrays_overlap(marks["numpy"], raise_words), F.regexp_extract(doc, ruled, 1)
    ).otherwise("")
    if mode == "reference":
        name = r"(?mUd)^\s+(\w+(?:Error|Exception))"
    elif mode == "section":
        name = r"(?mUd)^[^\S\n]*(\w*(?:Error|Exception))"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    numpy = F.regexp_extract_all(numpy_block, F.lit(name), F.lit(1))
    sphinx = F.regexp_extract_all(doc, F.lit(rf"(?Ud):raises?\s+{EXCEPTION_NAME}:"), F.lit(1))
    found = F.array_distinct(F.concat(google, numpy, sphinx))
    return F.when(is_given(doc), found).otherwise(no_strings())


# ---- sections -------------------------------------------------------------------------


# These jobs add columns in steps. A step's result is read several times by the next, and
# an expression pasted into a lambda would run once per line.


def with_docstring_sections(df: DataFrame, doc: str, name: str) -> DataFrame:
    """Add description, args(name, description), returns, raises(type, description).

    Each line is labelled with the last header at or above it, then the labelled lines
    are filtered, so text is joined once per section and not copied line by line.
    """

    def code(x):
        low = F.lower(F.left(x, F.lit(10)))
        return (
            F.when(low.startswith("args:") | low.startswith("arguments:"), F.lit(1))
            .when(low.startswith("returns:"), F.lit(2))
            .when(low.startswith("raises:"), F.lit(3))
            .otherwise(F.lit(0))
        )

    lines, marks = F.col("_lines"), F.col("_marks")

    def label(x, i):
        above = F.filter(marks, lambda m: m["at"] <= i)
        last = F.get(above, F.size(above) - 1)
        part = F.when(last["at"] == i, F.lit(-1)).otherwise(last["code"])
        return F.struct(x.alias("text"), F.coalesce(part, F.lit(0)).alias("part"))

    def plain(x):
        return F.struct(x.alias("text"), F.lit(0).alias("part"))

    def texts(part, closed=False):
        keep = F.filter(
            F.col("_labelled"),
            lambda x: (x["part"] == part) & (F.lit(closed) | ~x["text"].endswith(":")),
        )
        return F.transform(keep, lambda x: x["text"])

    def joined(items):
        return F.array_join(F.transform(items, lambda x: F.concat(x, F.lit(" "))), "")

    def pairs(items, first):
        with_colon = F.filter(items, lambda x: x.contains(":"))
        return F.transform(
            with_colon,
            lambda x: F.struct(
                strip(F.substring_index(x, ":", 1)).alias(first),
                strip(F.regexp_replace(x, r"(?Us)\A[^:]*:", "")).alias("description"),
            ),
        )

    found = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("at"), code(x).alias("code"))),
        lambda m: m["code"] > 0,
    )
    labelled = F.when(F.size(marks) == 0, F.transform(lines, plain)).otherwise(
        F.transform(lines, label)
    )
    sections = F.struct(
        joined(texts(0, closed=True)).alias("description"),
        pairs(texts(1), "name").alias("args"),
        joined(texts(2)).alias("returns"),
        pairs(texts(3), "type").alias("raises"),
    )
    return (
        df.withColumn("_lines", F.when(is_given(F.col(doc)), F.transform(lines_of(F.col(doc)), strip)))
        .withColumn("_marks", found)
        .withColumn("_labelled", F.filter(labelled, lambda x: x["text"] != ""))
        .withColumn(name, F.when(is_given(F.col(doc)), sections))
        .drop("_lines", "_marks", "_labelled")
    )


# ---- small pieces ---------------------------------------------------------------------


def first_line(doc: Column) -> Column:
    return F.substring_index(doc, "\n", 1)


def source_has_docstring(source: Column) -> Column:
    """The first code line after the first line of the source opens with triple quotes."""
    body = F.transform(lines_of(source), strip)
    code = F.filter(body, lambda x, i: (i > 0) & (x != "") & ~x.startswith("#"))
    return F.coalesce(F.get(code, F.lit(0)).rlike(r"^(?:\"\"\"|''')"), F.lit(False))


def source_has_triple_quote(source: Column) -> Column:
    return F.coalesce(source.contains('"""') | source.contains("'''"), F.lit(False))


def method_name(qualname: Column) -> Column:
    return F.substring_index(qualname, ".", -1)


def containing_class(qualname: Column) -> Column:
    """All but the last dotted part; null for a name without a dot."""
    return F.when(qualname.contains("."), F.regexp_extract(qualname, r"(?s)^(.*)\.", 1))


def is_custom_type(type_text: Column) -> Column:
    base = F.substring_index(type_text, "[", 1)
    return is_given(type_text) & ~F.coalesce(base.isin(BUILTIN_TYPES), F.lit(False))


def safe_name(name: Column) -> Column:
    kept = strip(F.regexp_replace(name, r"(?U)[^\w \-]", ""))
    joined = F.regexp_replace(kept, " ", "_")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("documentation"))


def coverage_bar(coverage: Column) -> Column:
    full = (coverage / 10).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(10) - full))


def content_key(config: Column, text: Column) -> Column:
    return F.md5(F.concat(config, F.lit(":"), text))


def escape_latex(col: Column) -> Column:
    """Replace the ten special characters one after another, in the listed order."""
    for old, new in LATEX_ESCAPES:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


# ---- generated text -------------------------------------------------------------------


def template_docstring(kind: Column, qualname: Column, signature: Column) -> Column:
    """A docstring skeleton per kind; function parameters come from the signature."""
    # With several parentheses only the text from the first "(" to the next one counts.
    inside = F.when(
        signature.contains("(") & signature.contains(")"),
        strip(F.regexp_extract(signature, r"(?s)^[^(]*\(([^()]*)", 1)),
    ).otherwise(F.lit(""))
    bare = strip(F.replace(F.replace(inside, F.lit("self, "), F.lit("")), F.lit("self"), F.lit("")))
    names = F.transform(
        F.filter(F.split(bare, ",", -1), has_text),
        lambda p: strip(F.substring_index(F.substring_index(p, ":", 1), "=", 1)),
    )
    rows = F.transform(
        F.filter(names, lambda p: p != ""),
        lambda p: F.concat(
            F.lit("\n    "), p, F.lit(" (type): Description of "), p, F.lit(" parameter.")
        ),
    )
    args = F.when((inside == "") | (inside == "self") | (F.size(names) == 0), F.lit("\n    None"))
    args = args.otherwise(F.array_join(rows, ""))
    # Fixed texts.
    function = F.concat(
        F.lit("Brief description of "), qualname, F.lit(".\n\nArgs:"), args,
        F.lit(
            "\n\nReturns:\n    type: Description of return value.\nRaises:\n"
            "    Exception: Description of when this exception is raised."
        ),
    )
    plain = F.concat(F.lit("Brief description of "), qualname, F.lit("."))
    klass = F.concat(
        F.lit("Class "), qualname,
        F.lit(
            ".\n            \nThis class provides functionality for...\n\nAttributes:\n"
            "    attribute_name: Description of attribute.\n\nMethods:\n"
            "    method_name: Description of method."
        ),
    )
    other = F.concat(F.lit("Documentation for "), qualname, F.lit("."))
    text = (
        F.when(kind == "FUNCTION", F.when(is_given(signature), function).otherwise(plain))
        .when(kind == "CLASS", klass)
        .otherwise(other)
    )
    return strip(text)


def prompt_text(
    kind: Column, qualname: Column, signature: Column, file_path: Column, source: Column
) -> Column:
    """The request context of one item: labelled lines, source cut at 1000 characters."""

    def labelled(name, value):
        return F.when(is_given(value), F.concat(F.lit(name), value, F.lit("\n"))).otherwise("")

    cut = F.when(
        F.length(source) > 1000, F.concat(F.left(source, F.lit(1000)), F.lit("..."))
    ).otherwise(source)
    return F.concat(
        F.lit("Function/Method: "), qualname, F.lit("\nType: "), kind, F.lit("\n"),
        labelled("Signature: ", signature),
        labelled("File: ", file_path),
        labelled("Source Code:\n", cut),
    )


def with_storage_markup(df: DataFrame, md: str, name: str) -> DataFrame:
    """Markdown to wiki storage markup, by ordered replacements; lists and table rows per line."""
    x = F.col(md)
    # Fixed patterns, in the order they apply.
    for pattern, target in [
        (r"(?mUd)^### (.+)$", "<h3>$1</h3>"),
        (r"(?mUd)^## (.+)$", "<h2>$1</h2>"),
        (r"(?mUd)^# (.+)$", "<h1>$1</h1>"),
        (r"(?Ud)\*\*(.+?)\*\*", "<strong>$1</strong>"),
        (r"(?Ud)\*(.+?)\*", "<em>$1</em>"),
        (
            r"(?sUd)```(\w+)?\n(.*?)\n```",
            '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">$1'
            "</ac:parameter><ac:plain-text-body><![CDATA[$2]]></ac:plain-text-body>"
            "</ac:structured-macro>",
        ),
        (
            r'<ac:parameter ac:name="language"></ac:parameter>',
            '<ac:parameter ac:name="language">text</ac:parameter>',
        ),
        (r"(?Ud)`([^`]+)`", "<code>$1</code>"),
        (r"(?Ud)\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    ]:
        x = F.regexp_replace(x, pattern, target)

    def table_row(line):
        first, last = F.instr(line, "|"), F.length(line) - F.instr(F.reverse(line), "|") + 1
        row = F.regexp_replace(
            F.substring(line, first, last - first + 1), r"\A\|+|\|+\z", ""
        )
        cells = F.split(row, r"\|", -1)
        html = F.concat(
            F.lit("<tr>"),
            F.array_join(
                F.transform(cells, lambda c: F.concat(F.lit("<td>"), strip(c), F.lit("</td>"))), ""
            ),
            F.lit("</tr>"),
        )
        shown = F.when(F.forall(cells, lambda c: c.contains("---")), F.lit("")).otherwise(html)
        return F.concat(F.left(line, first - 1), shown, F.substring(line, last + 1, F.length(line)))

    lines, last = F.col("_lines"), F.size("_lines") - 1
    bullet = F.transform(
        lines_of(x), lambda t: F.struct(t.alias("text"), t.rlike(r"(?U)\A\s*- ").alias("bullet"))
    )

    def item(line):
        body = F.substr(strip(line["text"]), F.lit(3))
        text = F.when(line["bullet"], F.concat(F.lit("<li>"), body, F.lit("</li>")))
        return F.coalesce(text, line["text"])

    def framed(line, i):
        before = F.coalesce(F.get(lines, i - 1)["bullet"], F.lit(False))
        opening = F.when(line["bullet"] & ~before, "<ul>\n").when(before & ~line["bullet"], "</ul>\n")
        closing = F.when(line["bullet"] & (i == last), "\n</ul>")
        return F.struct(
            F.coalesce(opening, F.lit("")).alias("opening"), item(line).alias("text"),
            F.coalesce(closing, F.lit("")).alias("closing"),
        )

    def rendered(line):
        is_row = line["text"].rlike(r"(?Ud)\|.+\|")
        body = F.when(is_row, table_row(line["text"])).otherwise(line["text"])
        return F.concat(line["opening"], body, line["closing"])

    marked = df.withColumn("_lines", bullet).withColumn("_lines", F.transform(lines, framed))
    x = F.array_join(F.transform(lines, rendered), "\n")
    x = F.concat(F.lit("<p>"), F.replace(x, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p>"))
    for pattern, target in [
        (r"(?U)<p>\s*</p>", ""),
        (r"<p>(<h[1-6]>)", "$1"),
        (r"(</h[1-6]>)</p>", "$1"),
    ]:
        x = F.regexp_replace(x, pattern, target)
    return marked.withColumn(name, x).drop("_lines")
