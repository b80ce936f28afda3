"""Symbols and dependencies of source files, one table function over all languages.

Brace languages are read from masked source by a table of declarations; Python
by its own parser; Ruby and templates by lines. A file that does not parse, or
whose braces do not match, is ``degraded`` by itself and says why; a language
without an extractor is ``unsupported``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.masking import Layout, mask

SYMBOL = "struct<name:string,kind:string,signature:string,visibility:string,line_start:int,line_end:int,line_count:int,nesting_depth:int>"
DEPENDENCY = "struct<target:string,statement:string,line_number:int,is_external:boolean>"
SCHEMA = f"path string, language string, status string, diagnostic string, symbols array<{SYMBOL}>, dependencies array<{DEPENDENCY}>"
# Modules that are never a workspace's own.
PYTHON_EXTERNAL = frozenset(
    "os sys json math typing re datetime time collections itertools functools pathlib io logging subprocess threading multiprocessing asyncio abc copy enum dataclasses uuid hashlib random socket unittest"
    " pydantic fastapi django flask sqlalchemy celery numpy pandas requests httpx pytest starlette alembic redis".split()
)


@dataclass(frozen=True)
class Rule:
    """A declaration: its pattern has a group ``name`` and perhaps ``vis``."""

    kind: str
    pattern: str
    #: Where it may stand: at the top, in a type's body, or both.
    place: str = "top"
    #: What its body ends without: a value has none.
    body: bool = True


@dataclass(frozen=True)
class Language:
    marks: tuple[str, ...]
    types: tuple[Rule, ...]
    rules: tuple[Rule, ...]
    imports: tuple[str, ...]
    separator: str = "::"
    public: str = "public"
    namespace: str | None = None


_VIS = r"(?:(?P<vis>public|protected|private|internal)\s+)?"
_MODS = r"(?:(?:static|final|abstract|sealed|readonly|async|override|virtual|partial|synchronized|default|native|extern|unsafe|new|declare)\s+)*"
_TS = Language(
    ("//", "/*", '"', "'", "`"),
    (
        Rule("class", r"\b(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)"),
        Rule("interface", r"\binterface\s+(?P<name>[A-Za-z_$][\w$]*)"),
        Rule("enum", r"\benum\s+(?P<name>[A-Za-z_$][\w$]*)"),
    ),
    (
        Rule("type", r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>[A-Za-z_$][\w$]*)[^=\n]*=", body=False),
        Rule("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
        Rule("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>"),
        Rule("constant", r"^[ \t]*(?:export\s+)?const\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>)", body=False),
        Rule("variable", r"^[ \t]*(?:export\s+)?(?:let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?\([^)]*\)\s*=>)", body=False),
        Rule("method", rf"^[ \t]*{_VIS}{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|super\b)#?[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?::[^;{{=\n]+)?\{{", "type"),
        Rule("property", rf"^[ \t]*{_VIS}{_MODS}(?P<name>#?[A-Za-z_$][\w$]*)[?!]?\s*(?::[^=;(\n]+)?(?:=[^;\n]*)?;", "type", body=False),
    ),
    (r"^[ \t]*(?:import|export)\b[^;'\"`]*?\bfrom\s*['\"](?P<t>[^'\"\n]+)['\"]", r"^[ \t]*import\s*['\"](?P<t>[^'\"\n]+)['\"]", r"\b(?:require|import)\s*\(\s*['\"](?P<t>[^'\"\n]+)['\"]\s*\)"),
)
_JVM_METHOD = r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*" + _VIS + _MODS + r"(?:<[^>\n]+>\s*)?(?:[\w.<>\[\],?]+\s+)??(?P<name>(?!if\b|for\b|foreach\b|while\b|switch\b|catch\b|return\b|new\b|lock\b|using\b)[A-Za-z_]\w*)\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?:throws\s+[\w., ]+|where\s+[^{;]+|:\s*(?:base|this)\([^)]*\))?\s*(?:\{|=>)"
LANGUAGES: dict[str, Language] = {
    "typescript": _TS,
    "javascript": _TS,
    "php": Language(
        ("//", "/*", "#", '"', "'"),
        (
            Rule("class", r"\b(?:(?:final|abstract|readonly)\s+)*class\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("interface", r"\binterface\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("trait", r"\btrait\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("enum", r"\benum\s+(?P<name>[A-Za-z_]\w*)"),
        ),
        (
            Rule("function", r"\bfunction\s+&?\s*(?P<name>[A-Za-z_]\w*)\s*\("),
            Rule("method", rf"{_VIS}(?:(?:static|final|abstract)\s+)*(?:(?:public|protected|private)\s+)?function\s+&?\s*(?P<name>[A-Za-z_]\w*)\s*\(", "type"),
            Rule("property", r"\b(?P<vis>public|protected|private)\s+(?:static\s+|readonly\s+)*(?:\??[\w\\|]+\s+)?(?P<name>\$\w+)", "type", body=False),
            Rule("property", rf"{_VIS}const\s+(?:[\w\\]+\s+)?(?P<name>[A-Za-z_]\w*)\s*=", "type", body=False),
            Rule("property", r"\bcase\s+(?P<name>[A-Za-z_]\w*)\s*(?:=[^;:\n]*)?;", "type", body=False),
        ),
        (r"^[ \t]*use\s+(?:function\s+|const\s+)?(?P<t>[A-Za-z_\\][\w\\]*(?:\s*\{[^}]*\})?)(?:\s+as\s+\w+)?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"](?P<t>[^'\"\n]+)['\"]"),
        namespace=r"^[ \t]*namespace\s+(?P<name>[\w\\]+)\s*[;{]",
    ),
    "go": Language(
        ("//", "/*", '"', "`", "'c"),
        (Rule("struct", r"^[ \t]*(?:type\s+)?(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?\s+struct\b"), Rule("interface", r"^[ \t]*(?:type\s+)?(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?\s+interface\b")),
        (
            Rule("method", r"^func\s*\([^)]*\)\s*(?P<name>[A-Za-z_]\w*)"),
            Rule("function", r"^func\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("type", r"^type\s+(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?\s+=?\s*(?!struct\b|interface\b)[\w\[\]*.]", body=False),
            Rule("constant", r"^const\s+(?P<name>[A-Za-z_]\w*)", body=False),
        ),
        (),
    ),
    "rust": Language(
        ("//", "/*", '"', "'c"),
        (
            Rule("struct", r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("enum", r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("interface", r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?\btrait\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("impl", r"\bimpl\b(?:\s*<[^>{]*>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>[A-Za-z_]\w*)"),
        ),
        (
            Rule("function", r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*\bfn\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("method", r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*\bfn\s+(?P<name>[A-Za-z_]\w*)", "type"),
        ),
        (r"^[ \t]*(?:pub\s+)?use\s+(?P<t>[\w:]+(?:::\{[^}]*\}|::\*)?)",),
        public="private",
    ),
    "java": Language(
        ("//", "/*", '"', "'c"),
        (Rule("class", rf"{_VIS}{_MODS}\b(?:class|record)\s+(?P<name>[A-Za-z_]\w*)"), Rule("interface", rf"{_VIS}{_MODS}\binterface\s+(?P<name>[A-Za-z_]\w*)"), Rule("enum", rf"{_VIS}{_MODS}\benum\s+(?P<name>[A-Za-z_]\w*)")),
        (Rule("method", _JVM_METHOD, "type"),),
        (r"^[ \t]*import\s+(?:static\s+)?(?P<t>[\w.]+(?:\.\*)?)\s*;",),
        separator=".",
    ),
    "csharp": Language(
        ("//", "/*", '"', "'c"),
        (
            Rule("class", rf"{_VIS}{_MODS}\b(?:class|record)\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("interface", rf"{_VIS}{_MODS}\binterface\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("struct", rf"{_VIS}{_MODS}\bstruct\s+(?P<name>[A-Za-z_]\w*)"),
            Rule("enum", rf"{_VIS}{_MODS}\benum\s+(?P<name>[A-Za-z_]\w*)"),
        ),
        (Rule("method", _JVM_METHOD, "type"),),
        (r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<t>[\w.]+)\s*;",),
        separator=".",
    ),
}


def _external(language: str, target: str) -> bool:
    if language in ("typescript", "javascript", "frontend"):
        return not target.startswith((".", "/"))
    if language == "rust":
        return target.split("::")[0] not in ("crate", "super", "self")
    if language == "php":
        return bool(re.match(r"\\?(?:Illuminate|Symfony|Doctrine|Psr|Carbon|PHPUnit|GuzzleHttp)\\", target))
    if language == "python":
        return not target.startswith(".") and target.split(".")[0] in PYTHON_EXTERNAL
    if language == "go":
        return "." in target.split("/")[0] or "/" not in target
    return True


def _symbol(name, kind, signature, visibility, start, end, nesting=1) -> dict:
    return {"name": name, "kind": kind, "signature": " ".join(signature.split()), "visibility": visibility, "line_start": start, "line_end": end, "line_count": max(1, end - start + 1), "nesting_depth": nesting}


def _dependency(language, target, statement, line) -> dict:
    return {"target": target, "statement": " ".join(statement.split()), "line_number": line, "is_external": _external(language, target)}


def _visibility(language: str, name: str, given: str | None, usual: str) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if given else "private"
    if name.startswith("#"):
        return "private"
    return given or usual


def _brace_file(language: str, spec: Language, source: str, first_line: int = 1) -> tuple[str, str | None, list, list]:
    masked = mask(source, spec.marks)
    layout = Layout(masked)
    spaces = [(m.start(), m["name"]) for m in re.finditer(spec.namespace, masked, re.M)] if spec.namespace else []
    prefix = lambda at: next((n + "\\" for s, n in reversed(spaces) if s < at), "")
    bodies: list[tuple[int, int, str, int]] = []
    found: list[tuple[int, dict]] = []

    def add(rule: Rule, m: re.Match, name: str) -> None:
        own = layout.block(m.end() - 1 if m[0].endswith("{") else m.end()) if rule.body else None
        end = own[1] if own else m.end() - 1
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        given = (m.groupdict().get("vis") or "").strip() or None
        nesting = layout.nesting(*own) if own else 1
        head = source[start : own[0] if own else m.end()]
        found.append((start, _symbol(name, rule.kind, head, _visibility(language, m["name"], given, spec.public), layout.line(start) + first_line - 1, layout.line(end) + first_line - 1, nesting)))

    for rule in spec.types:
        for m in re.finditer(rule.pattern, masked, re.M):
            own = layout.block(m.end())
            name = prefix(m.start()) + m["name"]
            if own:
                bodies.append((*own, name, layout.depth(own[0]) + 1))
            if rule.kind != "impl":
                add(rule, m, name)
    bodies.sort()

    def around(at: int) -> tuple[str, int] | None:
        inside = [b for b in bodies if b[0] < at < b[1]]
        return (inside[-1][2], inside[-1][3]) if inside else None

    taken: set[int] = set()
    for rule in spec.rules:
        for m in re.finditer(rule.pattern, masked, re.M):
            at = m.start("name")
            place = around(at)
            if at in taken or (rule.place == "type") != (place is not None):
                continue
            if place is not None and layout.depth(at) != place[1] or place is None and layout.depth(at) > (1 if spaces and masked[spaces[0][0] :].lstrip().startswith("namespace") else 0):
                continue
            taken.add(at)
            add(rule, m, place[0] + spec.separator + m["name"] if place else prefix(at) + m["name"])
    blank = mask(source, tuple(x for x in spec.marks if x in ("//", "/*", "#")))
    dependencies = []
    for pattern in spec.imports:
        for m in re.finditer(pattern, blank, re.M):
            line = layout.line(m.start("t")) + first_line - 1
            group = re.match(r"(.*?)\{(.*)\}\Z", m["t"], re.S)
            for target in [group[1] + x.split(" as ")[0].strip() for x in group[2].split(",") if x.strip()] if group else [m["t"]]:
                dependencies.append(_dependency(language, target, m[0], line))
    if language in ("typescript", "javascript"):
        for m in re.finditer(r"\b(?:require|import)\s*\(\s*(?P<t>[^'\"\s)][^)]*)\)", masked):
            dependencies.append(_dependency(language, "dynamic:" + source[m.start("t") : m.end("t")].strip(), m[0], layout.line(m.start()) + first_line - 1))
    if language == "go":
        dependencies += _go_imports(source, blank, layout)
        found += _go_constants(source, masked, layout)
    status = ("parsed", None) if layout.balanced else ("degraded", "unbalanced_braces")
    return *status, [s for _, s in sorted(found, key=lambda x: (x[0], x[1]["name"]))], sorted(dependencies, key=lambda d: (d["line_number"], d["target"]))


def _go_imports(source: str, blank: str, layout: Layout) -> list[dict]:
    out = []
    for block in re.finditer(r"^import\s*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n(]+))", blank, re.M):
        part = "many" if block["many"] is not None else "one"
        for m in re.finditer(r"\"([^\"\n]+)\"", block[part]):
            out.append(_dependency("go", m[1], m[0], layout.line(block.start(part) + m.start())))
    return out


def _go_constants(source: str, masked: str, layout: Layout) -> list[tuple[int, dict]]:
    out = []
    for block in re.finditer(r"^const\s*\((?P<many>[^)]*)\)", masked, re.M):
        for m in re.finditer(r"^[ \t]*(?P<name>[A-Za-z_]\w*)", block["many"], re.M):
            at = block.start("many") + m.start("name")
            line = layout.line(at)
            out.append((at, _symbol(m["name"], "constant", m["name"], _visibility("go", m["name"], None, "public"), line, line)))
    return out


_PY_CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match)


def _py_nesting(node: ast.AST) -> int:
    def depth(n: ast.AST) -> int:
        inner = max((depth(c) for c in ast.iter_child_nodes(n) if not isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda)), default=0)
        return inner + isinstance(n, _PY_CONTROL)

    return 1 + max((depth(c) for c in ast.iter_child_nodes(node)), default=0)


def _python_file(source: str) -> tuple[str, str | None, list, list]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "degraded", "syntax_error", [], []
    lines = source.split("\n")
    symbols, dependencies = [], []

    def hidden(name: str) -> str:
        if name.startswith("__") and name.endswith("__"):
            return "public"
        return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"

    def assigned(node: ast.AST) -> list[str]:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        return [t.id for t in targets if isinstance(t, ast.Name)]

    work: list[tuple[ast.AST, str, bool]] = [(tree, "", False)]
    while work:
        owner, prefix, in_class = work.pop()
        for node in ast.walk(owner) if owner is tree else ():
            if isinstance(node, ast.Import):
                dependencies += [_dependency("python", a.name, lines[node.lineno - 1], node.lineno) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                dependencies.append(_dependency("python", "." * node.level + (node.module or ""), lines[node.lineno - 1], node.lineno))
        for node in _bodies(owner):
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = prefix + node.name
                marks = [ast.unparse(d) for d in node.decorator_list]
                is_class = isinstance(node, ast.ClassDef)
                prop = any(m == "property" or m.endswith((".setter", "cached_property")) for m in marks)
                kind = "class" if is_class else "property" if in_class and prop else "method" if in_class else "function"
                head = "".join(f"@{m} " for m in marks) + lines[node.lineno - 1].strip()
                symbols.append(_symbol(name, kind, head, hidden(node.name), node.lineno, node.end_lineno, 1 if is_class else _py_nesting(node)))
                work.append((node, name + "::", is_class))
            elif isinstance(node, ast.Assign | ast.AnnAssign) and (in_class or owner is tree):
                for target in assigned(node):
                    if in_class or target.isupper():
                        symbols.append(_symbol(prefix + target, "property", lines[node.lineno - 1].strip(), hidden(target), node.lineno, node.end_lineno))
    symbols.sort(key=lambda s: (s["line_start"], s["name"]))
    return "parsed", None, symbols, sorted(dependencies, key=lambda d: (d["line_number"], d["target"]))


def _bodies(owner: ast.AST) -> Iterator[ast.AST]:
    """Declarations of an owner, also those under its control flow."""
    for node in ast.iter_child_nodes(owner):
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef | ast.Assign | ast.AnnAssign):
            yield node
        elif isinstance(node, ast.stmt | ast.ExceptHandler | ast.match_case):
            yield from _bodies(node)


def _ruby_file(source: str) -> tuple[str, str | None, list, list]:
    symbols, dependencies, open_blocks, visibility = [], [], [], ["public"]
    opens = re.compile(r"^(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b")
    for number, raw in enumerate(source.split("\n"), 1):
        line = re.sub(r"(?:^|\s)#.*", "", raw).strip()
        if m := re.match(r"require(_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", line):
            dependencies.append({**_dependency("ruby", m[2], line, number), "is_external": m[1] is None and not m[2].startswith(".")})
        scope = "::".join(b["own"] for b in open_blocks if b["own"])
        if line in ("private", "protected", "public"):
            visibility[-1] = line
        entry = {"own": "", "symbol": None, "scope": False}
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)", line):
            name = f"{scope}::{m[2]}" if scope else m[2]
            entry = {"own": m[2], "symbol": _symbol(name, "class" if m[1] == "class" else "interface", line, "public", number, number), "scope": True}
        elif m := re.match(r"def\s+(self\.)?([\w?!=]+|[^\s\w(]+)", line):
            name = f"{scope}{'.' if m[1] else '#'}{m[2]}" if scope else m[2]
            entry = {"own": "", "symbol": _symbol(name, "method" if scope else "function", line, visibility[-1] if scope else "public", number, number), "scope": False}
        if entry["symbol"]:
            symbols.append(entry["symbol"])
        if opens.search(line) and not re.search(r"\bend\s*$", line) and not re.match(r"def\s+\S+(?:\([^)]*\))?\s*=\s", line):
            open_blocks.append(entry)
            if entry["scope"]:
                visibility.append("public")
        elif re.match(r"end\b", line) and open_blocks:
            done = open_blocks.pop()
            if done["scope"]:
                visibility.pop()
            if done["symbol"]:
                done["symbol"] |= {"line_end": number, "line_count": number - done["symbol"]["line_start"] + 1}
    return ("parsed", None, symbols, dependencies) if not open_blocks else ("degraded", "unclosed_block", symbols, dependencies)


def _blade_file(path: str, source: str) -> tuple[str, str | None, list, list]:
    layout = Layout(re.sub(r"[{}]", " ", source))
    name = re.sub(r"^(?:.*/)?views/", "", re.sub(r"\.blade\.php\Z", "", path)).replace("/", ".")
    last = source.count("\n") + 1
    symbols = [_symbol(name, "view", path, "public", 1, last), _symbol("view:" + name, "view", path, "public", 1, last)]
    dependencies = []
    for m in re.finditer(r"@(extends|include(?:If|When|Unless|First)?|component|livewire|each)\s*\(\s*(?:[^'\",)]+,\s*)?['\"]([^'\"]+)['\"]|<x-([\w.:-]+)|@section\s*\(\s*['\"]([^'\"]+)['\"]|\bid=\"([\w-]+)\"", source):
        line = layout.line(m.start())
        if m[2]:
            dependencies.append({**_dependency("blade", m[2], m[0], line), "is_external": False})
        elif m[3]:
            dependencies.append({**_dependency("blade", "x-" + m[3], m[0], line), "is_external": False})
        else:
            symbols.append(_symbol(f"section:{m[4]}" if m[4] else f"#{m[5]}", "property", m[0], "public", line, line))
    return "parsed", None, symbols, dependencies


def _frontend_file(path: str, source: str) -> tuple[str, str | None, list, list]:
    name = re.sub(r"\.\w+\Z", "", path.rsplit("/", 1)[-1])
    symbols = [_symbol(name, "component", path, "public", 1, source.count("\n") + 1)]
    dependencies, status, why = [], "parsed", None
    front = re.match(r"---\n(.*?)\n---", source, re.S) if path.endswith(".astro") else None
    for m in [front] if front else re.finditer(r"<script\b[^>]*>(.*?)(?:</script>|\Z)", source, re.S):
        status, why, own, needs = _brace_file("typescript", _TS, m[1], source.count("\n", 0, m.start(1)) + 1)
        symbols += own
        dependencies += needs
    return status, why, symbols, dependencies


def extract_file(path: str, language: str | None, source: str | None) -> tuple[str, str | None, list, list]:
    """Status, diagnostic, symbols and dependencies of one file."""
    if source is None:
        return "unsupported", "no_content", [], []
    if language in LANGUAGES:
        return _brace_file(language, LANGUAGES[language], source)
    own = {"python": lambda: _python_file(source), "ruby": lambda: _ruby_file(source), "blade": lambda: _blade_file(path, source), "frontend": lambda: _frontend_file(path, source)}
    return own[language]() if language in own else ("unsupported", "no_extractor", [], [])


def extract(files: DataFrame) -> DataFrame:
    """Symbols and dependencies of every row of (path, language, content), as nested rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, g, *extract_file(p, g, c)) for p, g, c in zip(batch["path"], batch["language"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "language", "status", "diagnostic", "symbols", "dependencies"])

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def symbols_of(extracted: DataFrame) -> DataFrame:
    """One row per symbol."""
    return extracted.select("path", "language", F.inline("symbols"))


def dependencies_of(extracted: DataFrame) -> DataFrame:
    """One row per dependency."""
    return extracted.select(F.col("path").alias("source"), "language", F.inline("dependencies"))
