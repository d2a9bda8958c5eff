"""Source code parsed with the standard library's ast, as table functions over Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SKIPPED = "syntax_error"


def _text(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[first - 1 : last])


def chunks(source: str, gap: int = 3) -> list[tuple]:
    """(kind, name, parent, first, last, docstring, content) of a module: its docstring, functions,
    classes and methods, then stretches of other lines of at least two lines, joined over gaps."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.split("\n")
    out, covered = [], set()
    if (doc := ast.get_docstring(tree)) and isinstance(tree.body[0], ast.Expr):
        node = tree.body[0]
        out.append(("module_docstring", "", "", node.lineno, node.end_lineno, doc, _text(lines, node.lineno, node.end_lineno)))

    def add(node, kind, parent):
        covered.update(range(node.lineno, node.end_lineno + 1))
        out.append((kind, node.name, parent, node.lineno, node.end_lineno, ast.get_docstring(node) or "", _text(lines, node.lineno, node.end_lineno)))

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            add(node, "function", "")
        elif isinstance(node, ast.ClassDef):
            add(node, "class", "")
            for inner in node.body:
                if isinstance(inner, ast.FunctionDef | ast.AsyncFunctionDef):
                    add(inner, "method", node.name)
    rest = [n for n, x in enumerate(lines, 1) if n not in covered and x.strip()]
    group: list[int] = []
    for n in [*rest, None]:
        if group and (n is None or n - group[-1] > gap):
            if len(group) > 1:
                out.append(("file_level", "", "", group[0], group[-1], "", _text(lines, group[0], group[-1])))
            group = []
        if n is not None:
            group.append(n)
    return out


def symbols(source: str) -> list[tuple]:
    """(name, kind) of every function and class at any depth, in order of their lines."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [("", SKIPPED)]
    found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    return [(n.name, "class" if isinstance(n, ast.ClassDef) else "function") for n in sorted(found, key=lambda n: (n.lineno, n.col_offset))]


def imports(source: str) -> list[tuple]:
    """(module, path): modules imported and the source path that such a module would have."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    names = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            names += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            names.append(n.module)
    return [(m, m.replace(".", "/") + ".py") for m in dict.fromkeys(names)]


SHAPES: dict[Callable, str] = {
    chunks: "kind string, name string, parent string, first int, last int, docstring string, content string",
    symbols: "name string, kind string",
    imports: "module string, path string",
}


def parsed(files: DataFrame, file_id: str, source: str, what: Callable) -> DataFrame:
    """file_id and a row for each of ``what`` (chunks, symbols or imports) in each source."""
    shape = SHAPES[what]
    names = [x.split()[0] for x in shape.split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.string() for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = what(text or "")
                ids += [key] * len(found)
                rows += found
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [file_id, *names])

    kind = files.schema[file_id].dataType.simpleString()
    return files.select(file_id, F.col(source).cast("string")).mapInArrow(run, f"{file_id} {kind}, {shape}")
