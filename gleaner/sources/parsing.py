"""Source files to methods, call sites and imports, once per distinct blob.

Python is read by the standard library's parser; other languages by a lexer that drops comments and strings and matches
braces (or `end` words), driven by a profile. A file that cannot be read gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = "path string, cls string, name string, start int, end int, language string"
CALLS = "path string, caller string, caller_cls string, caller_start int, callee string, receiver string, dotted string"


@dataclass
class Profile:
    """How a language without its own parser looks: words that open classes and methods, comments, and whether braces or `end` close."""

    classes: tuple[str, ...] = ("class", "interface", "struct", "enum", "trait", "impl", "record", "object", "module", "protocol", "extension")
    functions: tuple[str, ...] = ("function", "func", "fn", "fun", "def", "sub", "proc", "method")
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    closes: str = "brace"


@dataclass
class Parsed:
    methods: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    imports: dict[str, str] = field(default_factory=dict)


_BRACES = Profile()
_HASH = Profile(line=("#",), block=())
_END = Profile(line=("#", "--"), block=(), closes="end")
PROFILES = {x: _BRACES for x in "java javascript typescript tsx c cpp csharp rust go kotlin php swift objectivec groovy dart zig css".split()}
PROFILES |= {x: _HASH for x in "bash shell r perl tcl coffeescript cmake yaml".split()}
PROFILES |= {x: _END for x in "ruby lua julia".split()}
PROFILES |= {x: Profile(line=("--", ";"), block=(("(*", "*)"), ("{-", "-}")), closes="none") for x in "haskell ocaml lisp".split()}
PROFILES |= {"xml": Profile(line=(), block=(("<!--", "-->"),), closes="tag"), "python": _HASH}
#: Words before '(' that are no calls.
_NOT_CALLS = frozenset("if for while switch catch return function func fn def sub new sizeof else elif match with and or not in is when until unless".split())
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*(?:\.|::|->))*)([A-Za-z_$][\w$]*)\s*\(")
_NAME = r"[A-Za-z_$~][\w$:.~]*"


def parse_python(text: str, path: str) -> Parsed:
    out = Parsed()
    tree = ast.parse(text)

    def visit(node: ast.AST, cls: str, method: tuple | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, child.name, method)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                m = (path, cls, child.name, child.lineno, child.end_lineno or child.lineno, "python")
                out.methods.append(m)
                visit(child, cls, m)
            else:
                if isinstance(child, ast.Call) and method:
                    dotted = ast.unparse(child.func) if isinstance(child.func, ast.Attribute | ast.Name) else ""
                    callee = dotted.rpartition(".")[2]
                    receiver = dotted.rpartition(".")[0]
                    if callee:
                        out.calls.append((path, method[2], method[1], method[3], callee, method[1] if receiver == "self" else receiver, dotted))
                elif isinstance(child, ast.Import):
                    out.imports.update((a.asname or a.name.split(".")[0], a.name) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    out.imports.update((a.asname or a.name, f"{'.' * child.level}{child.module or ''}.{a.name}") for a in child.names if a.name != "*")
                visit(child, cls, method)

    visit(tree, "", None)
    return out


def blank(text: str, p: Profile) -> str:
    """text with comments and the insides of strings as spaces; lines stay."""
    parts = [re.escape(a) + r"[\s\S]*?(?:" + re.escape(b) + r"|\Z)" for a, b in p.block] + [re.escape(a) + r"[^\n]*" for a in p.line] + [r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"]
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m.group()), text) if parts else text


def _closing(text: str, at: int, p: Profile) -> int:
    """The place where the block that begins after `at` ends."""
    if p.closes == "brace":
        depth = 0
        for m in re.finditer(r"[{}]", text[at:]):
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return at + m.start()
        return len(text) - 1
    if p.closes == "end":
        depth = 1
        for m in re.finditer(r"\b(?:def|do|if|case|begin|class|module|function|while|for|unless|end)\b", text[at:]):
            depth += -1 if m.group() == "end" else 1
            if depth == 0:
                return at + m.end() - 1
        return len(text) - 1
    nxt = text.find("\n\n", at)
    return nxt if nxt >= 0 else len(text) - 1


def parse_other(text: str, path: str, language: str) -> Parsed:
    p, out = PROFILES[language], Parsed()
    if p.closes == "tag":
        for m in re.finditer(r"<([A-Za-z_][\w:.-]*)[^<>]*?(/?)>", blank(text, p)):
            end = text.find(f"</{m[1]}>", m.end()) if not m[2] else m.end()
            out.methods.append((path, "", m[1], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, end if end >= 0 else m.end()) + 1, language))
        return out
    clean = blank(text, p if language != "css" else Profile(line=(), block=(("/*", "*/"),)))
    line = lambda i: clean.count("\n", 0, i) + 1
    spans = [(m.start(), _closing(clean, m.end(), p), m[1]) for m in re.finditer(rf"\b(?:{'|'.join(p.classes)})\s+(?:<[^>]*>\s*)?({_NAME})", clean)]
    heads = [(m.start(), m.end(), m[1]) for m in re.finditer(rf"\b(?:{'|'.join(p.functions)})\s+(?:\([^()]*\)\s*)?({_NAME})", clean)]
    if p.closes == "brace":
        heads += [(m.start(1), m.end(), m[1]) for m in re.finditer(rf"({_NAME})\s*\([^(){{}};]*\)[^(){{}};=]*\{{", clean) if m[1] not in _NOT_CALLS]
        heads += [(m.start(), m.end(), m[1]) for m in re.finditer(rf"({_NAME})\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>)", clean)]
    if p.closes == "brace" or language == "r":
        heads += [(m.start(), m.end(), m[1]) for m in re.finditer(rf"({_NAME})\s*(?:<-|=)\s*function\b", clean)]
    taken: dict[tuple, tuple] = {}
    for a, b, name in sorted(heads):
        brace = clean.find("{", a) if p.closes == "brace" else b
        end = _closing(clean, brace if brace >= 0 else b, p)
        cls = max((s for s in spans if s[0] < a <= s[1]), default=("", "", ""))[2]
        scope, _, short = name.rpartition("::") if "::" in name else name.rpartition(".")
        taken.setdefault((short, line(a)), (a, end, (path, cls or scope, short, line(a), line(end), language)))
    found = list(taken.values())
    out.methods = [m for _, _, m in found]
    for m in _CALL.finditer(clean):
        inside = max((x for x in found if x[0] < m.start() <= x[1]), key=lambda x: x[0], default=None)
        if inside and m[2] not in _NOT_CALLS and not (m[2] == inside[2][2] and line(m.start()) == inside[2][3]):
            receiver = re.sub(r"(?:\.|::|->)$", "", m[1])
            out.calls.append((path, inside[2][2], inside[2][1], inside[2][3], m[2], inside[2][1] if receiver in ("this", "self") else receiver, m[1] + m[2]))
    return out


def parse(text: str | None, path: str, language: str | None) -> Parsed:
    if not text or language not in PROFILES:
        return Parsed()
    if language == "python":
        try:
            return parse_python(text, path)
        except (SyntaxError, ValueError, RecursionError):
            return parse_other(text, path, language)
    return parse_other(text, path, language)


def facts(blobs: DataFrame, what: str = "methods") -> DataFrame:
    """Rows of methods, calls or imports from (path, language, text), one row per distinct blob and path."""
    schema = {"methods": METHODS, "calls": CALLS, "imports": "path string, alias string, target string"}[what]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                p = parse(text, path, language)
                rows += [(path, k, v) for k, v in p.imports.items()] if what == "imports" else getattr(p, what)
            if rows:
                ints = {"start", "end", "caller_start"}
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ints else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return blobs.select("path", "language", F.col("text")).mapInArrow(run, schema)


_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]+")
_BRANCH = frozenset("if for while case catch elif except and or && || ? when".split())


def token_metrics(text: str | None, language: str = "java") -> dict[str, int]:
    """Counts that the metric expressions start from: operators and operands (total, distinct), decisions, comment lines, exits."""
    text = text or ""
    p = PROFILES.get(language, _BRACES)
    tokens = _TOKEN.findall(blank(text, p))
    operands = [t for t in tokens if t[0].isalnum() or t[0] in "_$"]
    operators = [t for t in tokens if not (t[0].isalnum() or t[0] in "_$")]
    comments = sum(1 for a, b in zip(text.splitlines(), blank(text, p).splitlines(), strict=False) if a.strip() and not b.strip() and not a.strip().startswith(("'", '"')))
    return {
        "halstead_eta1": len(set(operators)),
        "halstead_eta2": len(set(operands)),
        "halstead_total1": len(operators),
        "halstead_total2": len(operands),
        "cc": 1 + sum(t in _BRANCH for t in tokens),
        "cloc": comments,
        "nexits": sum(t in ("return", "throw", "raise") for t in tokens),
    }
