"""Text columns against plain statements of the same rules, on random docstrings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docmetrics.functions import text as tx
from docmetrics.functions.numbers import exact_round
from docmetrics.functions.score import with_docstring_facts

PIECES = [
    "Args:", "Arguments:", "Parameters:", "Returns:", "Return:", "Yields:", "Raises:", "raise:", "Note:",
    "Examples:", "    x: first", "    y (int): second", "    ValueError: bad", "  KeyError", "", "", "plain text",
    "Parameters", "Returns", "Raises", "-------", "---", "====", ":param a: one", ":type a: int", ":param b: two",
    ":returns: r", ":rtype: int", ":raises OSError: no", "    more words here", "é: ü", ":note: n", "x Args:",
]


def docs(n=1500, seed=7):
    rng = random.Random(seed)
    out = ["\n".join(rng.choices(PIECES, k=rng.randint(0, 9))).strip() for _ in range(n)]
    return list(dict.fromkeys(out))


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("FUNCTION", d, ["x", "a"]) for d in docs()]
    df = spark.createDataFrame(rows, "method string, docstring string, actual_params array<string>")
    return with_docstring_facts(df).collect()


I, M, S = re.IGNORECASE, re.MULTILINE, re.DOTALL


def test_params(facts):
    for r in facts:
        want = []
        lines = r.docstring.split("\n")
        for i, line in enumerate(lines[:-1]):
            if re.search(r"(args?|arguments?|parameters?):$", line, I):
                body = next((x for x in lines[i + 1:] if x), "")
                found = re.match(r"\s+(\w+)(?:\s*\([^)]*\))?\s*:", body)
                want = [found.group(1)] if found else []
                break
        want = want or re.findall(r":param\s+(\w+):", r.docstring)
        assert r.documented_params == want, r.docstring
        assert r.missing_params == [p for p in ["x", "a"] if p not in want]
        assert r.extra_params == [p for p in want if p not in ["x", "a"]]


def test_return_docs(facts):
    for r in facts:
        want = any(re.search(r"(returns?|yields?):", x, I) for x in r.docstring.split("\n"))
        assert r.has_return_doc == want, r.docstring


def test_style(facts):
    def score(words, form):
        return sum(bool(re.search(form % w, r.docstring, I)) for w in words)

    sections = ["returns?", "yields?", "raises?", "notes?", "examples?"]
    for r in facts:
        g = score(["(?:args?|arguments?)", *sections], r"%s:\s*\n")
        n = score(["parameters", *sections], r"%s\s*\n\s*[-=]+")
        s = score([r"param\s+\w+", r"type\s+\w+", "returns?", "rtype", r"raises?\s+\w+", "note", "example"], ":%s:")
        if not r.docstring:
            assert r.docstring_style is None and r.style_issues == []
            continue
        top = max(g, n, s)
        names = [k for k, v in (("google", g), ("numpy", n), ("sphinx", s)) if v == top and top]
        assert r.docstring_style == (names[0] if names else "plain"), r.docstring
        mixed = [x for x in r.style_issues if x.startswith("Mixed")]
        assert mixed == ([f"Mixed docstring styles detected: {names}"] if len(names) > 1 else [])


def test_empty_google_sections(facts):
    header = re.compile(r"\s*(args?|arguments?|returns?|yields?|raises?|notes?|examples?):\s*$", I)
    for r in facts:
        if r.docstring_style != "google":
            continue
        lines = r.docstring.split("\n")
        heads = [(i, header.match(x).group(1)) for i, x in enumerate(lines) if header.match(x)]
        words = [h.lower() for _, h in heads]
        in_text = [w for x in lines for w in re.findall(r"(\w+):\s*$", x.lower())]
        if len(set(words)) < len(words) or len(in_text) != len(heads):
            continue  # a repeated header is judged by its first usable place
        want = []
        for i, h in heads:
            after = lines[i + 1:]
            text = next((x for x in after if x.strip()), "")
            if after and after[0] == "" and not text.startswith(" "):
                want.append(f"Empty {h} section")
        assert [x for x in r.style_issues if x.startswith("Empty")] == want, r.docstring


def test_exceptions(facts):
    name = r"(\w+(?:\.\w+)*(?:Error|Exception|\w+))"
    for r in facts:
        lines, google = r.docstring.split("\n"), []
        usable = [
            i for i, x in enumerate(lines[:-1])
            if re.search(r"raises?:$", x, I) and (lines[i + 1] == "" or lines[i + 1].startswith(" "))
        ]
        if usable:
            rest = lines[usable[0] + 1:]
            while rest and rest[0] == "":
                rest = rest[1:]
            block = []
            for x in rest:
                if not x.startswith(" "):
                    break
                block.append(x)
            cut = len(block) < len(rest) and rest[len(block)] != ""
            ended = cut or len(block) == len(rest)
            text = "\n".join(block) + ("" if ended else "\n")
            google = re.findall(rf"^\s+{name}(?:\s*:|\s+)", text, M)
        sphinx = re.findall(rf":raises?\s+{name}:", r.docstring)
        numpy = []
        found = re.search(
            r"Raises?\s*\n\s*[-=]+\s*\n(.*?)(?=\n\s*\w+\s*\n\s*[-=]+|\Z)", r.docstring, M | I | S
        )
        if found:
            numpy = re.findall(r"^\s+(\w+(?:Error|Exception))", found.group(1), M)
        assert r.documented_exceptions == list(dict.fromkeys(google + numpy + sphinx)), r.docstring


def test_long_docstring_does_not_overflow(spark):
    text = "Raises:\n" + "    ValueError: x\n" * 30000 + "\nReturns:\n    int: y"
    df = spark.createDataFrame([("FUNCTION", text, [])], "method string, docstring string, actual_params array<string>")
    row = with_docstring_facts(df, params_mode="section").first()
    assert row.documented_exceptions == ["ValueError"] and row.has_return_doc


def test_sections(spark):
    rows = [(i, d) for i, d in enumerate(docs(600, 3))]
    df = tx.with_docstring_sections(spark.createDataFrame(rows, "i int, d string"), "d", "s")
    for r in df.collect():
        if not r.d:
            assert r.s is None
            continue
        part, told, args, returns, raises = "told", "", [], "", []
        for line in (x.strip() for x in r.d.split("\n")):
            low = line.lower()
            if low.startswith(("args:", "arguments:")):
                part = "args"
            elif low.startswith("returns:"):
                part = "returns"
            elif low.startswith("raises:"):
                part = "raises"
            elif line and part == "told":
                told += line + " "
            elif line and not line.endswith(":"):
                if part == "returns":
                    returns += line + " "
                elif ":" in line:
                    pair = tuple(x.strip() for x in line.split(":", 1))
                    (args if part == "args" else raises).append(pair)
        assert r.s.description == told and r.s.returns == returns
        assert [tuple(x) for x in r.s.args] == args
        assert [tuple(x) for x in r.s.raises] == raises


def test_rounding(spark):
    rng = random.Random(1)
    values = [rng.uniform(1, 100) for _ in range(500)] + [k / 8 for k in range(8, 800)]
    values += [k / 200 * 100 / 100 for k in range(200, 20000, 7)] + [0.0, 56.25, 2.675, 12.5, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", exact_round(F.col("v"), 1).alias("a"), exact_round(F.col("v"), 2).alias("b")).collect():
        assert (r.a, r.b) == (round(r.v, 1), round(r.v, 2)), r.v


def one(spark, make, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return row.select(make(*[F.col(k) for k in cols]).alias("out")).first().out


def test_small_pieces(spark):
    assert one(spark, tx.escape_latex, x="a_b\\{$}") == "a\\_b\\textbackslash\\{\\}\\{\\$\\}"
    assert one(spark, tx.safe_name, x=" My: proj/é-1 ") == "My_projé-1"
    assert one(spark, tx.safe_name, x="///") == "documentation"
    assert one(spark, tx.method_name, x="A.B.c") == "c"
    assert one(spark, tx.containing_class, x="A.B.c") == "A.B"
    assert one(spark, tx.containing_class, x="c") is None
    assert one(spark, tx.is_custom_type, x="List[User]") is False
    assert one(spark, tx.is_custom_type, x="User[int]") is True
    assert one(spark, tx.is_custom_type, x="") is False
    assert one(spark, tx.source_has_docstring, x='def f():\n    # c\n\n    """x"""') is True
    assert one(spark, tx.source_has_docstring, x="def f():\n    return 1") is False
    text = one(spark, tx.template_docstring, k="FUNCTION", q="f", s="(self, a: int, b=1)")
    assert "\n    a (type): Description of a parameter.\n    b (type)" in text
    assert "\n    None" in one(spark, tx.template_docstring, k="FUNCTION", q="f", s="(self)")
    assert one(spark, tx.template_docstring, k="GET", q="f", s="") == "Documentation for f."


def test_prompt_cut(spark):
    out = one(spark, tx.prompt_text, k="GET", q="f", s="", p="/a.py", src="x" * 1001)
    assert out == "Function/Method: f\nType: GET\nFile: /a.py\nSource Code:\n" + "x" * 1000 + "...\n"


def test_markup(spark):
    md = "# T\n\n- a\n- **b**\ntext\n\n```\nx = 1\n```\n| a | b |\n|---|---|\n- z"
    df = spark.createDataFrame([(md,)], "md string")
    out = tx.with_storage_markup(df, "md", "out").first().out
    assert out == (
        '<h1>T</h1><p><ul>\n<li>a</li>\n<li><strong>b</strong></li>\n</ul>\ntext</p><p>'
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">text</ac:parameter>'
        "<ac:plain-text-body><![CDATA[x = 1]]></ac:plain-text-body></ac:structured-macro>\n"
        "<tr><td>a</td><td>b</td></tr></p><p><ul>\n<li>z</li>\n</ul></p>"
    )
