"""Docstring edits of one file as spans of its text.

A file is parsed once. Every edit becomes (start, end, new text) in byte offsets, from the places
of statements that the parser gives and of logical lines that the tokenizer gives, so signatures
over several lines, bodies on the line of their header, comments and decorators are all the same
to it. Spans of different definitions never overlap; they are applied from the last to the first,
and the result is accepted only if it parses.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
import warnings
from typing import NamedTuple

# Lines that open a definition, and lines before a module docstring.
DEFINITION = re.compile(r"\s*(def|class|async\s+def)\s+")
PREAMBLE = re.compile(r"#!|.*(coding|encoding):")
LINE_END = re.compile(rb"\r\n|\r|\n")

Definition = ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef


class Span(NamedTuple):
    start: int
    end: int
    text: bytes


def literal(doc: str, block: str) -> str:
    """`block`, the text between the quotes, as a string literal whose value it is."""
    plain = f'"""{block}"""'
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            if ast.literal_eval(plain) == block:
                return plain
    except (SyntaxError, ValueError, Warning):
        pass
    safe = block.replace("\\", "\\\\").replace('"', '\\"').replace("\0", "\\0").replace("\r", "\\r")
    return f'"""{safe}"""'


def indented(doc: str, indent: str) -> str:
    """A docstring's literal below a header: one line, or a block that ends with quotes of its own line."""
    rows = doc.strip().splitlines()
    if len(rows) == 1:
        return literal(doc, rows[0])
    body = [rows[0], *(f"{indent}{r}" if r.strip() else "" for r in rows[1:]), indent]
    return literal(doc, "\n".join(body))


class Source:
    """A file's text with the places of its definitions."""

    def __init__(self, text: str) -> None:
        self.raw = text.encode("utf-8", "surrogatepass")
        ends = [m.end() for m in LINE_END.finditer(self.raw)]
        self.starts = [0, *ends]  # of lines
        self.feed = b"\r\n" if b"\r\n" in self.raw else b"\n"
        if self.starts[-1] == len(self.raw) and len(self.starts) > 1:
            self.starts.pop()
        self.error: str | None = None
        self.heads: dict[int, Definition] = {}
        self.tree = None
        try:
            self.tree = ast.parse(text)
            self.heads = {n.lineno: n for n in ast.walk(self.tree) if isinstance(n, Definition)}
            lines = tokenize.generate_tokens(io.StringIO(text, newline="").readline)
            self.logical = sorted({t.start[0] for t in lines if t.type == tokenize.NEWLINE})
        except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as e:
            self.error = f"Syntax error in file: {e}"

    def line(self, no: int) -> str:
        end = self.starts[no] if no < len(self.starts) else len(self.raw)
        return self.raw[self.starts[no - 1]: end].decode("utf-8", "surrogatepass").rstrip("\r\n")

    def at(self, lineno: int, col: int) -> int:
        return self.starts[lineno - 1] + col

    def after_line(self, offset: int) -> int:
        """Where the line after the one of offset begins."""
        k = bisect.bisect_right(self.starts, offset)
        return self.starts[k] if k < len(self.starts) else len(self.raw)

    def alone(self, start: int, end: int) -> tuple[int, int] | None:
        """The whole lines of a statement, if nothing else is on them."""
        first = self.starts[bisect.bisect_right(self.starts, start) - 1]
        last = self.after_line(max(start, end - 1))
        return (first, last) if not self.raw[first:start].strip() and not self.raw[end:last].strip() else None

    def encoded(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        return raw if self.feed == b"\n" else raw.replace(b"\n", self.feed)

    def definition(self, lineno: int, doc: str) -> Span | str:
        """The edit of the definition whose header begins on lineno, or why there is none."""
        n = len(self.starts)
        if not 1 <= lineno <= n:
            return f"Line number {lineno} out of range (1-{n})"
        head = self.line(lineno)
        if not DEFINITION.match(head) or self.error is None and lineno not in self.heads:
            near = range(max(1, lineno - 10), min(n, lineno + 10) + 1)
            found = next((k for k in near if k != lineno and DEFINITION.match(self.line(k))), None)
            at = f" A definition was found at line {found}." if found else ""
            return f"Line {lineno} is not a definition (found: '{head.strip()}').{at}"
        if self.error:
            return self.error
        node = self.heads[lineno]
        first = node.body[0]
        top = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
        head_end = self.logical[bisect.bisect_left(self.logical, lineno)]
        start, end = self.at(first.lineno, first.col_offset), self.at(first.end_lineno, first.end_col_offset)
        old = ast.get_docstring(node, clean=False) is not None
        text = doc.strip()
        outer = head[: len(head) - len(head.lstrip())]
        if top <= head_end:  # the body begins on the line of the header
            return self.beside(node, outer + "    ", start, end, old, text)
        column = self.at(top, 0)
        indent = self.raw[column: self.at(top, first.col_offset if top == first.lineno else first.decorator_list[0].col_offset - 1)].decode()
        if not old:
            below = self.after_line(self.at(head_end, 0))
            return Span(below, below, self.encoded(f"{indent}{indented(doc, indent)}\n") if text else b"")
        if text:
            return Span(start, end, self.encoded(indented(doc, indent)))
        if len(node.body) == 1:
            return Span(start, end, b"pass")
        if whole := self.alone(start, end):
            return Span(*whole, b"")
        after = node.body[1]
        if after.lineno == first.end_lineno:  # more statements on its line
            return Span(start, self.at(after.lineno, after.col_offset), b"")
        return Span(start, end, b"")

    def beside(self, node: Definition, indent: str, start: int, end: int, old: bool, text: str) -> Span:
        """The edit of a body on the line of its header, which moves to lines of its own."""
        colon = start
        while self.raw[colon - 1: colon] in (b" ", b"\t", b"\\", b"\n", b"\r", b"\x0c"):
            colon -= 1
        rest = node.body[1:]
        goes_on = self.at(rest[0].lineno, rest[0].col_offset) if rest else end
        if not text:
            return Span(start, goes_on if rest else end, b"" if rest else b"pass") if old else Span(start, start, b"")
        new = f"\n{indent}{indented(text, indent)}"
        if not old:
            return Span(colon, start, self.encoded(f"{new}\n{indent}"))
        return Span(colon, goes_on, self.encoded(f"{new}\n{indent}" if rest else new))

    def module(self, doc: str) -> list[Span] | str:
        """The edit of the module docstring: the old one goes, the new one follows the preamble."""
        if self.error:
            return self.error
        k = next((i for i in range(len(self.starts)) if not PREAMBLE.match(self.line(i + 1))), len(self.starts))
        below = self.starts[k] if k < len(self.starts) else len(self.raw)
        out = []
        if doc.strip():
            rows = "\n".join(["", *doc.strip().splitlines(), ""])
            lead = b"" if not self.raw[:below] or self.raw[:below].endswith((b"\n", b"\r")) else self.feed
            out.append(Span(below, below, lead + self.encoded(literal(doc, rows) + "\n")))
        if ast.get_docstring(self.tree, clean=False) is not None:
            first, *more = self.tree.body
            start, end = self.at(first.lineno, first.col_offset), self.at(first.end_lineno, first.end_col_offset)
            if whole := self.alone(start, end):
                out.append(Span(*whole, b""))
            elif more and more[0].lineno == first.end_lineno:
                out.append(Span(start, self.at(more[0].lineno, more[0].col_offset), b""))
            else:
                out.append(Span(start, end, b""))
        return out

    def applied(self, spans: list[Span]) -> str:
        raw = self.raw
        for s in sorted(spans, reverse=True):
            raw = raw[: s.start] + s.text + raw[s.end:]
        return raw.decode("utf-8", "surrogatepass")


def parses(text: str) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return str(e)
    return None


def patch_text(source: str, edits: list[dict]) -> tuple[str, list[str]]:
    """Apply the edits of one file and report on each: `ok`, or why it was left out.

    Edits: is_module, lineno, new_docstring (null or blank: remove the docstring). Of a
    body that is its docstring alone, `pass` is left. An edit without which the file parses and
    with which it doesn't is left out; a file that doesn't parse takes no edit.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        file = Source(source)
    status, todo = [], []
    for e in edits:
        doc = e["new_docstring"] or ""
        got = file.module(doc) if e["is_module"] else file.definition(e["lineno"], doc)
        status.append(got if isinstance(got, str) else "ok")
        todo.append([] if isinstance(got, str) else got if isinstance(got, list) else [got])
    text = file.applied([s for spans in todo for s in spans])
    if any(todo) and parses(text):
        kept: list[Span] = []
        for i, spans in enumerate(todo):
            if spans and (why := parses(file.applied(kept + spans))):
                status[i] = f"The edit would break the file: {why}"
            else:
                kept += spans
        text = file.applied(kept)
    return text, status
