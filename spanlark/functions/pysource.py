"""What only Python's own syntax can tell: token streams, syntax trees and patch application, as Arrow UDFs and UDTFs."""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

BROKEN = (tokenize.TokenError, IndentationError, SyntaxError)
NODE = "path string, function string, node_id string, type string, start_line int, end_line int, code_snippet string, code_hash string, contains_calls array<string>"
EDGE = "path string, function string, src string, dst string, kind string"


def strip_tokens(text: str | None) -> str:
    """Tokens but comments and strings, joined by spaces; the text itself where it cannot be tokenised."""
    try:
        kept = [t.string for t in tokenize.generate_tokens(io.StringIO(text or "").readline) if t.type not in (tokenize.COMMENT, tokenize.STRING)]
    except BROKEN:
        return text or ""
    return " ".join(kept)


#: The names that masking keeps besides keywords, and the patterns that mask text which cannot be tokenised.
PLAIN_NAMES = {
    "True", "False", "None", "self", "cls", "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "bool", "open", "type", "isinstance", "hasattr", "getattr", "setattr", "super",
    "property", "staticmethod", "classmethod",
}
MASKS = [
    (re.compile(r'""".*?"""', re.DOTALL), "STR"), (re.compile(r"'''.*?'''", re.DOTALL), "STR"), (re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"'), "STR"),
    (re.compile(r"'[^'\\]*(?:\\.[^'\\]*)*'"), "STR"), (re.compile(r"\b\d+\.?\d*\b"), "NUM"),
]


def mask_tokens(text: str | None) -> str:
    """Names but keywords and ``PLAIN_NAMES``, strings and numbers as VAR, STR and NUM. Tokens keep their column and row, and a
    line's end is written besides the row that it ends; by pattern for strings and numbers where tokenising fails."""
    text = text or ""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except BROKEN:
        for pattern, mask in MASKS:
            text = pattern.sub(mask, text)
        return text
    written = {tokenize.STRING: "STR", tokenize.NUMBER: "NUM", tokenize.ENDMARKER: ""}
    out, row, column = [], 1, 0
    for t in tokens:
        rows = t.start[0] - row
        out.append("\n" * rows + " " * (t.start[1] - (0 if rows > 0 else column)))
        is_var = t.type == tokenize.NAME and not keyword.iskeyword(t.string) and t.string not in PLAIN_NAMES
        out.append("VAR" if is_var else written.get(t.type, t.string))
        row, column = t.end
    return "".join(out)


def over_text(f: Callable[[str | None], str]):
    """A plain function on text as an Arrow UDF."""

    @F.pandas_udf("string")
    def applied(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return applied


def apply_hunks(source: str | None, patch: str | None) -> str | None:
    """The text of one file after its hunks; null where a hunk's old lines are not found near their place."""
    old, out, at = (source or "").splitlines(), [], 0
    lines, k = (patch or "").splitlines(), 0
    while k < len(lines):
        m = re.match(r"@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@", lines[k])
        k += 1
        if not m:
            continue
        body = []
        while k < len(lines) and lines[k][:1] in ("+", "-", " ", "") and not lines[k].startswith(("--- ", "+++ ", "diff --git ")):
            body.append(lines[k] or " ")
            k += 1
        before, after = [s[1:] for s in body if s[0] != "+"], [s[1:] for s in body if s[0] != "-"]
        wanted = max(int(m[1]) - 1, 0)
        places = sorted((p for p in range(at, len(old) - len(before) + 1) if old[p : p + len(before)] == before), key=lambda p: abs(p - wanted))
        if not places:
            return None
        out += old[at : places[0]] + after
        at = places[0] + len(before)
    return "\n".join(out + old[at:]) + ("\n" if (source or "").endswith("\n") else "")


def calls(statements: list[ast.AST]) -> list[str]:
    """Dotted names that are called anywhere in the statements, sorted."""

    def dotted(f: ast.expr) -> str:
        parts = []
        while isinstance(f, ast.Attribute):
            parts.append(f.attr)
            f = f.value
        return ".".join([f.id, *reversed(parts)]) if isinstance(f, ast.Name) else ".".join(reversed(parts))

    found = {dotted(n.func) for s in statements for n in ast.walk(s) if isinstance(n, ast.Call)}
    return sorted(found - {""})


#: A node that control leaves, and the kind of the edge that it leaves by.
Exit = tuple[str, str]


class FlowGraph:
    """The statement graph of one function: runs of plain statements are blocks, each control statement has a header."""

    def __init__(self, path: str, name: str, lines: list[str]) -> None:
        self.path, self.name, self.lines, self.nodes, self.edges = path, name, lines, [], []

    def node(self, kind: str, first: int, last: int, statements: list[ast.AST] = ()) -> str:
        snippet = "\n".join(self.lines[first - 1 : last])
        snippet = snippet if len(snippet) <= 500 else snippet[:500] + "..."
        self.nodes.append((f"{self.path}::{self.name}::n{len(self.nodes)}", kind, first, last, snippet, hashlib.md5(snippet.encode()).hexdigest()[:8], calls(statements)))
        return self.nodes[-1][0]

    def link(self, exits: list[Exit], target: str, kind: str | None = None) -> list[Exit]:
        """An edge from each exit, of the exit's own kind unless one is given; what is left is the target's exit."""
        self.edges += [[source, target, kind or own] for source, own in exits]
        return [(target, "fallthrough")]

    def body(self, statements: list[ast.stmt], exits: list[Exit]) -> list[Exit]:
        """Nodes of a suite; returns where control leaves it."""
        plain: list[ast.stmt] = []
        for s in [*statements, None]:
            handler = self.CONTROL.get(type(s))
            if s is not None and handler is None:
                plain.append(s)
                continue
            if plain:
                exits = self.link(exits, self.node("basic_block", plain[0].lineno, max(p.end_lineno for p in plain), plain))
                plain = []
            if s is not None:
                exits = handler(self, s, exits)
        return exits

    def branch(self, s: ast.If, exits: list[Exit]) -> list[Exit]:
        test = self.node("condition", s.lineno, s.lineno, [s])
        plain = self.link(exits, test)
        leave = self.body(s.body, [(test, "branch_true")])
        return leave + (self.body(s.orelse, [(test, "branch_false")]) if s.orelse else plain)

    def loop(self, s: ast.For | ast.While, exits: list[Exit]) -> list[Exit]:
        header = self.node("loop_header", s.lineno, s.lineno, [s])
        head = self.link(exits, header)
        self.link(self.body(s.body, head), header, "back_edge")
        return head + (self.body(s.orelse, head) if s.orelse else [])

    def guarded(self, s: ast.Try, exits: list[Exit]) -> list[Exit]:
        head = self.link(exits, self.node("try_header", s.lineno, s.lineno))
        tried = self.body(s.body, head)
        caught: list[Exit] = []
        for h in s.handlers:
            caught += self.body(h.body, self.link(head, self.node("except_handler", h.lineno, h.end_lineno), "exception"))
        leave = [c for c in caught if c not in tried] + self.body(s.orelse, tried or head) if s.orelse else tried + caught
        if s.finalbody:
            leave = self.body(s.finalbody, self.link(leave, self.node("finally", s.finalbody[0].lineno, s.finalbody[-1].end_lineno), "finally"))
        return leave

    def context(self, s: ast.With, exits: list[Exit]) -> list[Exit]:
        return self.body(s.body, self.link(exits, self.node("with_header", s.lineno, s.lineno, [s])))

    def ending(self, s: ast.stmt, exits: list[Exit]) -> list[Exit]:
        self.link(exits, self.node("return" if isinstance(s, ast.Return) else "raise", s.lineno, s.end_lineno, [s]))
        return []

    def jump(self, s: ast.stmt, exits: list[Exit]) -> list[Exit]:
        return self.link(exits, self.node("basic_block", s.lineno, s.end_lineno, [s]))

    CONTROL = {
        ast.If: branch, ast.For: loop, ast.While: loop, ast.Try: guarded, ast.With: context, ast.AsyncWith: context, ast.AsyncFor: context,
        ast.Return: ending, ast.Raise: ending, ast.Break: jump, ast.Continue: jump,
    }

    def build(self, f: ast.FunctionDef | ast.AsyncFunctionDef) -> FlowGraph:
        leave = self.body(f.body, [(self.node("entry", f.lineno, f.lineno), "fallthrough")])
        self.link(leave, self.node("exit", f.end_lineno, f.end_lineno))
        return self


def graphs(path: str, source: str | None) -> Iterator[FlowGraph]:
    """One for each function of a file; later functions of the same name have their line behind it. Raises SyntaxError."""
    lines, seen = (source or "").splitlines(), set()
    for f in ast.walk(ast.parse(source or "")):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = f.name if f.name not in seen else f"{f.name}_L{f.lineno}"
            seen.add(name)
            yield FlowGraph(path, name, lines).build(f)


#: Rows that a task holds before it hands them on: a file gives many, so batches of files are no bound.
PIECE = 1000


def _rows(pick: Callable[[FlowGraph], Iterator[tuple]], columns: list[str]):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for pdf in batches:
            for path, source in zip(pdf["path"], pdf["source"], strict=True):
                try:
                    rows += [(g.path, g.name, *r) for g in graphs(path, source) for r in pick(g)]
                except SyntaxError:
                    continue
                if len(rows) >= PIECE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return over


def flow_nodes(files: DataFrame) -> DataFrame:
    """files: path, source. Files that do not parse give no rows; see parse_errors."""
    return files.select("path", "source").mapInPandas(_rows(lambda g: iter(g.nodes), [c.split()[0] for c in NODE.split(", ")]), NODE)


def flow_edges(files: DataFrame) -> DataFrame:
    return files.select("path", "source").mapInPandas(_rows(lambda g: iter(g.edges), [c.split()[0] for c in EDGE.split(", ")]), EDGE)


def parse_errors(files: DataFrame) -> DataFrame:
    def error(source: str | None) -> str | None:
        try:
            ast.parse(source or "")
        except (SyntaxError, ValueError) as e:
            return f"{type(e).__name__}: {e}"
        return None

    return files.withColumn("parse_error", over_text(error)("source")).where("parse_error is not null").select(F.col("path").alias("file"), "parse_error")


PATCHED = "scope string, file string, is_node boolean, old boolean, function string, node_id string, type string, start_line int, end_line int, code_snippet string, code_hash string, contains_calls array<string>, problem string"


@F.udtf(returnType=PATCHED)
class PatchedFile:
    """Table function over rows (scope, file, source, hunks): the nodes of a file before and after its hunks, each version parsed once.

    A row with ``is_node`` false says what went wrong: ``apply`` where hunks do not fit, ``parse <side>: <why>`` where a version is no
    Python (it then has no nodes), ``error: <why>`` for anything else. A source that is null is a file that the patch makes."""

    def eval(self, row: Row) -> Iterator[tuple]:
        def problem(what: str) -> tuple:
            return row["scope"], row["file"], False, *[None] * 9, what

        after = apply_hunks(row["source"], row["hunks"])
        if after is None:
            yield problem("apply")
            return
        for old, source in ((True, row["source"]), (False, after)):
            try:
                found = list(graphs(row["file"], source)) if source is not None else []
            except SyntaxError as e:
                yield problem(f"parse {'before' if old else 'after'}: {e.msg}")
                continue
            except (ValueError, RecursionError) as e:
                yield problem(f"error: {type(e).__name__}")
                continue
            for g in found:
                for node_id, kind, first, last, snippet, code_hash, called in g.nodes:
                    yield row["scope"], row["file"], True, old, g.name, node_id, kind, first, last, snippet, code_hash, called, None


def patched_files(files: DataFrame) -> DataFrame:
    """files: scope, file, source, hunks. The rows of ``PatchedFile``."""
    return PatchedFile(files.select("scope", "file", "source", "hunks").asTable())


def register(spark: SparkSession) -> None:
    """SQL names: strip_tokens, mask_tokens, apply_hunks and the table function flow_graph(path, source), and
    patched_file(TABLE(rows of scope, file, source, hunks))."""
    spark.udf.register("strip_tokens", over_text(strip_tokens))
    spark.udf.register("mask_tokens", over_text(mask_tokens))

    @F.pandas_udf("string")
    def hunks(source: pd.Series, patch: pd.Series) -> pd.Series:
        return pd.Series([apply_hunks(s, p) for s, p in zip(source, patch, strict=True)], dtype=object)

    @F.udtf(returnType="function string, node_id string, type string, start_line int, end_line int, code_hash string")
    class FlowTable:
        def eval(self, path: str, source: str):
            try:
                for g in graphs(path, source):
                    for n in g.nodes:
                        yield g.name, n[0], n[1], n[2], n[3], n[5]
            except SyntaxError:
                return

    spark.udf.register("apply_hunks", hunks)
    spark.udtf.register("flow_graph", FlowTable)
    spark.udtf.register("patched_file", PatchedFile)
