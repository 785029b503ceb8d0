"""Everything that is read out of a source file, in one parse: methods with metrics and symbols, calls, imports, file metrics.

Token counts come from the lexer of `parsing`; measures that follow from counts by published formulas are column
expressions (`gleaner.operators.metrics.halstead`, and `maintainability` here). Symbols: `refs` are names that a method
reads or writes, `locals` its parameters and declarations, `declared` what it declares global, `file_symbols` and
`class_symbols` what is declared at file level and in its class. Python's come from its syntax tree, those of the other
languages from declarations by the block that they stand in.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.parsing import _NOT_CALLS, PROFILES, blank, parse, token_metrics

_INT, _NAMES = pa.int32(), pa.list_(pa.string())
_METHOD = {
    **{x: pa.string() for x in ("cls", "name")},
    **{x: _INT for x in ("start", "end", "token_count", "cc", "halstead_eta1", "halstead_eta2", "halstead_total1", "halstead_total2", "nargs", "nexits")},
    **{x: _NAMES for x in ("refs", "locals", "declared", "file_symbols", "class_symbols")},
}
_CALL = {"caller_cls": pa.string(), "caller": pa.string(), "caller_start": _INT, "callee": pa.string(), "receiver": pa.string(), "dotted": pa.string(), "inferred": pa.string()}
_FILE = {"cloc": _INT, "sloc": _INT, "nom": _INT, "file_cc": _INT, "file_length": _INT, "file_vocabulary": _INT}
_IMPORT = {"alias": pa.string(), "target": pa.string()}
_SQL = {"string": "string", "int32": "int", "list<item: string>": "array<string>"}
_IDENT = re.compile(r"(?<![\w.$])[A-Za-z_$][\w$]*(?!\s*\()")
_DECLARED = re.compile(r"(?:\b(?:let|var|val|const|auto|my|local)\s+|(?<![\w.$])[A-Za-z_$][\w$]*(?:<[^<>;]*>)?(?:\[\])*[*&\s]+)([A-Za-z_$][\w$]*)\s*(?::[^=;,){]*)?(?=[=;,)])")
_IMPORTED = re.compile(r"^\s*(?:import|using|use|require|include|from)\b[\s(\"'<]*(?:static\s+)?([\w.:/\\]+)(?:\s+as\s+(\w+))?", re.M)
_TYPED = re.compile(r"\b([A-Z][\w$]*)(?:<[^<>;()]*>)?\s+([a-z_$][\w$]*)\s*(?=[=;,):])|\b([a-z_$][\w$]*)\s*:\s*([A-Z][\w$]*)|\b([a-z_$][\w$]*)\s*:?=\s*(?:new\s+)?([A-Z][\w$]*)\s*(?:\(|\.new\b|\{)")


def _fields(kind: dict) -> str:
    return ", ".join(f"{k}: {_SQL[str(t)]}" for k, t in kind.items())


SCHEMA = f"path string, blob_sha string, language string, methods array<struct<{_fields(_METHOD)}>>, calls array<struct<{_fields(_CALL)}>>, imports array<struct<{_fields(_IMPORT)}>>, " + ", ".join(f"{k} int" for k in _FILE)


def n_args(head: str) -> int:
    """Parameters in the first brackets of a method's text."""
    begin = head.find("(")
    if begin < 0:
        return 0
    depth, commas, some = 0, 0, False
    for c in head[begin:]:
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
            if depth == 0:
                break
        elif c == "," and depth == 1:
            commas += 1
        some |= depth >= 1 and c not in "( \t\r\n"
    return commas + 1 if some else 0


def _python_symbols(text: str) -> tuple[dict[int, tuple], set[str], dict[str, set[str]]]:
    """By first line of each function (refs, locals, declared); file symbols; class symbols by class."""
    by_line: dict[int, tuple] = {}
    tree = ast.parse(text)
    stored = lambda nodes: {n.id for x in nodes for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    plain = lambda body: [x for x in body if isinstance(x, ast.Assign | ast.AnnAssign | ast.AugAssign)]
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            inner = [n for x in node.body for n in ast.walk(x)]
            declared = {g for n in inner if isinstance(n, ast.Global) for g in n.names}
            a = node.args
            params = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
            called = {id(n.func) for n in inner if isinstance(n, ast.Call)}
            refs = {n.id for n in inner if isinstance(n, ast.Name) and id(n) not in called}
            by_line[node.lineno] = (refs, (params | stored(node.body)) - declared, declared)
    classes = {n.name: stored(plain(n.body)) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
    return by_line, stored(plain(tree.body)), classes


def _block_symbols(clean: str, methods: list[tuple]) -> tuple[dict[int, tuple], set[str], dict[str, set[str]]]:
    """The same by the lines that declarations stand on: in a method, else in the class that the methods around it have, else in the file."""
    lines = clean.split("\n")
    found = [(clean.count("\n", 0, m.start(1)) + 1, m[1]) for m in _DECLARED.finditer(clean) if m[1] not in _NOT_CALLS and m.group().split()[0] not in ("return", "throw", "package", "import", "using")]
    inside = lambda at: max((m for m in methods if m[3] <= at <= m[4]), key=lambda m: m[3], default=None)
    spans: dict[str, tuple[int, int]] = {}
    for m in methods:
        if m[1]:
            a, b = spans.get(m[1], (m[3], m[4]))
            spans[m[1]] = (min(a, m[3]), max(b, m[4]))
    for at, line in enumerate(lines, 1):  # a class begins where its name is declared
        if (head := re.search(r"\b(?:class|interface|struct|enum|trait|object)\s+([A-Za-z_]\w*)", line)) and head[1] in spans:
            spans[head[1]] = (min(at, spans[head[1]][0]), spans[head[1]][1])
    by_line: dict[int, tuple] = {m[3]: (set(), set(), set()) for m in methods}
    file: set[str] = set()
    classes: dict[str, set[str]] = {}
    for at, name in found:
        m = inside(at)
        cls = next((c for c, (a, b) in spans.items() if a <= at <= b), None)
        (by_line[m[3]][1] if m else classes.setdefault(cls, set()) if cls else file).add(name)
    for m in methods:
        by_line[m[3]][0].update(x for x in _IDENT.findall("\n".join(lines[m[3] - 1 : m[4]])) if x not in _NOT_CALLS and x != m[2])
    return by_line, file, classes


def measure(path: str, language: str, text: str) -> tuple[list[dict], list[dict], list[dict], dict]:
    """(methods, calls, imports, file metrics) of a file."""
    parsed = parse(text, path, language)
    clean = blank(text, PROFILES[language])
    lines, raw = clean.split("\n"), text.split("\n")
    try:
        by_line, file, classes = _python_symbols(text) if language == "python" else _block_symbols(clean, parsed.methods)
    except (SyntaxError, ValueError, RecursionError):
        by_line, file, classes = _block_symbols(clean, parsed.methods)
    methods, total = [], token_metrics(text, language)
    for _, cls, name, start, end, _ in parsed.methods:
        body = "\n".join(lines[start - 1 : end])
        refs, own, declared = by_line.get(start, (set(), set(), set()))
        n = token_metrics("\n".join(raw[start - 1 : end]), language)
        symbols = {"refs": refs, "locals": own, "declared": declared, "file_symbols": file, "class_symbols": classes.get(cls, set())}
        methods.append({"cls": cls, "name": name, "start": start, "end": end, "token_count": n["halstead_total1"] + n["halstead_total2"], "nargs": n_args(body), **{k: n[k] for k in _METHOD if k in n}, **{k: sorted(v) for k, v in symbols.items()}})
    types = {}
    for m in _TYPED.finditer(clean):
        types.setdefault(m[2] or m[3] or m[5], m[1] or m[4] or m[6])
    calls = [{"caller_cls": cc, "caller": c, "caller_start": s, "callee": callee, "receiver": r or None, "dotted": d or None, "inferred": types.get(r)} for _, c, cc, s, callee, r, d in parsed.calls]
    imports = dict(parsed.imports)
    if language != "python":
        for m in _IMPORTED.finditer(text):
            imports.setdefault(m[2] or re.split(r"[./:\\]+", m[1].rstrip(r"./:\;"))[-1], re.sub(r"::|[/\\]", ".", m[1]))
    counts = {
        "cloc": total["cloc"],
        "sloc": sum(1 for x in raw if x.strip()),
        "nom": len(methods),
        "file_cc": total["cc"],
        "file_length": total["halstead_total1"] + total["halstead_total2"],
        "file_vocabulary": total["halstead_eta1"] + total["halstead_eta2"],
    }
    return methods, calls, [{"alias": k, "target": v} for k, v in imports.items()], counts


def measured(files: DataFrame) -> DataFrame:
    """One row per row of files (path, blob_sha, language, text) with all that is read out of it. A file that can't be read as its language has empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = lambda kind: pa.list_(pa.struct(list(kind.items())))
        for b in batches:
            got = [measure(p, x, t or "") for p, x, t in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text")), strict=True)]
            lists = [pa.array([g[i] for g in got], struct(kind)) for i, kind in enumerate((_METHOD, _CALL, _IMPORT))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "blob_sha", "language")), *lists, *(pa.array([g[3][k] for g in got], t) for k, t in _FILE.items())], ["path", "blob_sha", "language", "methods", "calls", "imports", *_FILE])

    return files.filter(F.col("language").isin(*PROFILES)).select("path", "blob_sha", "language", "text").mapInArrow(run, SCHEMA)


def maintainability(length: Column, vocabulary: Column, cc: Column, sloc: Column) -> Column:
    """The maintainability index by Oman and Hagemeister; null where a logarithm is undefined."""
    volume = length * F.log2(F.when(vocabulary > 1, vocabulary))
    return 171 - 5.2 * F.log(F.when(volume > 0, volume)) - 0.23 * cc - 16.2 * F.log(F.when(sloc > 0, sloc))
