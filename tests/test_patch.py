import ast

import pytest

from docmetrics.operators import patch
from docmetrics.schema import SOURCE_FILES

SOURCE = '''#!/usr/bin/env python
"""Old module text."""
import os

class A:
    def one(self):
        """One."""
        return 1

    def two(self):
        \'\'\'Two,

        longer.
        \'\'\'
        return 2

async def three(x):
    return x
'''


def edit(lineno, doc, module=False):
    return {"is_module": module, "lineno": lineno, "new_docstring": doc}


def docs(text):
    tree = ast.parse(text)
    named = {n.name: ast.get_docstring(n) for n in ast.walk(tree) if hasattr(n, "name") and hasattr(n, "body")}
    return {**named, "": ast.get_docstring(tree)}


def test_every_edit_lands():
    text, status = patch.patch_text(
        SOURCE,
        [edit(0, "New module.\n\nMore.", True), edit(5, "A class."), edit(6, "First.\n\nArgs:\n    none"), edit(10, "Second."), edit(17, "Third.")],
    )
    assert status == ["ok"] * 5
    assert docs(text) == {"A": "A class.", "one": "First.\n\nArgs:\n    none", "two": "Second.", "three": "Third.", "": "New module.\n\nMore."}
    assert text.startswith('#!/usr/bin/env python\n"""\nNew module.') and text.endswith("return x\n")


def test_single_edits():
    text, _ = patch.patch_text(SOURCE, [edit(6, "")])
    assert docs(text)["one"] is None and text == SOURCE.replace('        """One."""\n', "")
    text, _ = patch.patch_text(SOURCE, [edit(17, "  Short.  ")])
    assert text == SOURCE.replace("three(x):\n", 'three(x):\n    """Short."""\n')
    text, _ = patch.patch_text(SOURCE, [edit(0, "", True)])
    assert docs(text)[""] is None
    text, _ = patch.patch_text("x = 1", [edit(0, "Doc.", True)])
    assert text == '"""\nDoc.\n"""\nx = 1'


def test_wrong_lines():
    text, status = patch.patch_text(SOURCE, [edit(8, "x"), edit(99, "x")])
    assert text == SOURCE
    assert status[0].startswith("Line 8 is not a definition (found: 'return 1'). A definition was found at line 5")
    assert status[1] == "Line number 99 out of range (1-18)"
    assert patch.patch_text("def f(:\n", [edit(0, "x", True)])[1][0].startswith("Syntax error in file")


@pytest.fixture
def tables(spark):
    sources = spark.createDataFrame(
        [("p", "s1", "/a.py", "a.py", "a", SOURCE), ("p", "s1", "/b.py", "b.py", "b", "x = 1\n")], SOURCE_FILES
    )
    rows = [
        ("p", "/a.py", "a", "FUNCTION", 6, "early", 1), ("p", "/a.py", "a", "GET", 6, "late", 2),
        ("p", "", "a", "FUNCTION", 6, "no path", 3), ("p", "/a.py", "a", "METADATA", 6, "never", 4),
        ("p", "/a.py", "a", "FUNCTION", 900, "far", 5), ("p", "/a.py", "a", "MODULE", 1, "Mod.", 1), ("p", "/a.py", "a", "MODULE", 4, "Mod later.", 2),
    ]
    edits = spark.createDataFrame(
        rows, "project string, file_path string, module string, method string, lineno int, new_docstring string, edited_at int"
    )
    return sources, edits


def test_tables(tables):
    sources, edits = tables
    rows = {r.file_path: r for r in patch.patch_docstrings(sources, edits, "s2").collect()}
    assert rows["/b.py"].source == "x = 1\n" and rows["/b.py"].patch_status == []
    assert docs(rows["/a.py"].source)["one"] == "late" and docs(rows["/a.py"].source)[""] == "Mod later."
    assert rows["/a.py"].snapshot_id == "s2" and [s.status for s in rows["/a.py"].patch_status] == ["ok", "ok"]
    lost = sorted(r.message for r in patch.rejected_edits(sources, edits).collect())
    assert lost == ["File not found", "Line number 900 out of range (1-19)", "Unsupported kind for patching: METADATA"]
