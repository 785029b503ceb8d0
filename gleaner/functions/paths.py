"""Scalar column functions over paths, names and identifiers of source code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes by language. Where two languages share a suffix, the order of the caller's language list decides.
SUFFIXES = {
    "bash": (".sh", ".bash", ".zsh", ".ksh"),
    "shell": (".sh", ".bash", ".zsh", ".ksh"),
    "c": (".c", ".h"),
    "coffeescript": (".coffee", ".litcoffee"),
    "cpp": (".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"),
    "csharp": (".cs",),
    "cmake": (".cmake",),
    "css": (".css",),
    "dart": (".dart",),
    "go": (".go",),
    "groovy": (".groovy", ".gradle"),
    "haskell": (".hs", ".lhs"),
    "java": (".java",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "julia": (".jl",),
    "kotlin": (".kt", ".kts"),
    "lisp": (".lisp", ".lsp", ".cl"),
    "lua": (".lua",),
    "ocaml": (".ml", ".mli"),
    "objectivec": (".m", ".mm"),
    "perl": (".pl", ".pm", ".t"),
    "php": (".php",),
    "python": (".py",),
    "r": (".r",),
    "ruby": (".rb",),
    "rust": (".rs",),
    "swift": (".swift",),
    "tcl": (".tcl",),
    "typescript": (".ts",),
    "tsx": (".tsx",),
    "yaml": (".yaml", ".yml"),
    "xml": (".xml", ".xsd", ".xsl", ".xslt"),
    "zig": (".zig",),
}
#: Whole file names that name a language.
SPECIAL_NAMES = {"CMakeLists.txt": "cmake"}
#: The commit-level change metrics that count as the classic family.
CLASSIC_METRICS = ("fix", "ns", "nd", "nf", "entropy", "la", "ld", "lt", "ndev", "age", "nuc", "exp", "rexp", "sexp")
GLOBAL_CLASS = "<global>"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The lower-cased suffix with its dot; empty if the name has none or only leads with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def language_of(path: Column, languages: list[str]) -> Column:
    """The first language of the list whose special name or suffix fits; null if none does."""
    name, suffix = base_name(path), suffix_of(path)
    special = [F.when(name == n, F.lit(lang)) for n, lang in SPECIAL_NAMES.items() if lang in languages]
    by_suffix = [F.when(suffix.isin(*SUFFIXES[lang]), F.lit(lang)) for lang in languages if lang in SUFFIXES]
    return F.coalesce(*special, *by_suffix, F.lit(None).cast("string"))


def detected_order(languages: list[str]) -> list[str]:
    """shell takes bash's place where both are listed."""
    return [x for x in languages if x != "bash" or "shell" not in languages]


#: Suffixes of files that hold no source text.
BINARY_SUFFIXES = (
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".bmp",
    ".ico",
    ".pdf",
    ".zip",
    ".gz",
    ".jar",
    ".class",
    ".dll",
    ".so",
    ".dylib",
    ".exe",
    ".bin",
    ".woff",
    ".woff2",
    ".ttf",
    ".otf",
    ".mp3",
    ".mp4",
    ".mov",
    ".avi",
    ".wasm",
)


def other_source(path: Column) -> Column:
    """Whether a file of no known language may be source: a short suffix that is not a binary one, outside git's own folder."""
    s, low = suffix_of(path), F.lower(path)
    inside = low.contains("/.git/") | low.endswith(".git")
    return ~inside & (s != "") & (F.length(s) <= 8) & ~s.isin(*BINARY_SUFFIXES)


def method_id(file: Column, cls: Column, name: Column, start: Column) -> Column:
    return F.concat_ws("::", file, F.coalesce(F.nullif(cls, F.lit("")), F.lit(GLOBAL_CLASS)), name, start.cast("string"))


_ID = r"^(.*)::(.*?)::(.*?)::([^:]*)$"


def method_id_parts(ident: Column) -> dict[str, Column]:
    """file, class, name and start line of a method id; a start that is no number is null."""
    part = lambda i: F.regexp_extract(ident, _ID, i)
    cls = part(2)
    return {"file": part(1), "class": F.when(cls == GLOBAL_CLASS, "").otherwise(cls), "name": part(3), "start": part(4).try_cast("int")}


def callable_name(name: Column) -> Column:
    """A bare name: cut at '(' and, without a dot, at '<' of a type list; nothing left: unknown_method."""
    head = F.trim(F.substring_index(name, "(", 1))
    bare = F.when(head.contains("<") & head.contains(">") & ~head.contains("."), F.trim(F.substring_index(head, "<", 1))).otherwise(head)
    return F.when(bare == "", "unknown_method").otherwise(bare)


def split_qualified(name: Column) -> tuple[Column, Column]:
    """(class, method) of a long name, split at the first kind of separator present: '::', '.', '#'."""
    cls, last = F.lit(""), name
    for sep in ("#", ".", "::"):
        has = F.instr(name, sep) > 0
        head = F.substring_index(name, sep, -2)
        cls = F.when(has, F.substring_index(head, sep, 1)).otherwise(cls)
        last = F.when(has, F.substring_index(name, sep, -1)).otherwise(last)
    return cls, last


def target_name(name: Column) -> Column:
    """The method that a changed-method name stands for."""
    tail = F.substring_index(name, ".", -1)
    cut = F.substring_index(F.substring_index(tail, "(", 1), "<", 1)
    return F.when(F.instr(name, "::") > 0, F.substring_index(name, "::", -1)).otherwise(cut)


def class_hint(long_name: Column, name: Column) -> Column:
    """The part before '::name' or '.name' in a long name, its last piece; empty if there is none."""

    def before(sep: str) -> Column:
        token = F.concat(F.lit(sep), name)
        return F.when(F.contains(long_name, token), F.regexp_extract(F.split_part(long_name, token, F.lit(1)), r"([^:.]+)[:.]*$", 1))

    return F.coalesce(F.nullif(before("::"), F.lit("")), before("."), F.lit(""))


def python_module(path: Column) -> Column:
    """The module of a Python file's path."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def module_and_symbol(ref: Column) -> tuple[Column, Column]:
    """A dotted reference cut at its last dot; no dot: (ref, null)."""
    dotted = F.instr(ref, ".") > 0
    return F.when(dotted, F.regexp_extract(ref, r"^(.*)\.[^.]*$", 1)).otherwise(ref), F.when(dotted, F.substring_index(ref, ".", -1))


def symbol_tail(ref: Column) -> Column:
    """The last part of a reference by '.', '::', '\\' and '/'."""
    return F.regexp_extract(ref, r"([^.:\\/]*)$", 1)


def token_count(text: Column) -> Column:
    """White-space tokens; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")), F.lit(0)).cast("long")


def concept_of(feature: Column) -> Column:
    """Drops a statistic's suffix, and the prefix current_ only together with it."""
    stat = F.regexp_extract(feature, r"^(.*)_(mean|max|min|std)$", 1)
    return F.when(stat == "", feature).otherwise(F.regexp_replace(stat, "^current_", ""))


def family_of(feature: Column) -> Column:
    return F.when(feature.isin(*CLASSIC_METRICS), "kamei").otherwise("new")


def is_added(change_type: Column, old: Column, new: Column) -> Column:
    return F.coalesce(change_type == "ADD", F.lit(False)) | (old.isNull() & new.isNotNull())


def path_at(scope: str, old: Column, new: Column) -> Column:
    return F.coalesce(new, old) if scope == "current" else F.coalesce(old, new)


def normal_seed(seed: Column) -> Column:
    return F.pmod(seed.cast("long"), F.lit(4294967295))


def stat_columns(metric: str) -> list[str]:
    return [f"{metric}_{s}" for s in ("mean", "max", "min", "std")]
