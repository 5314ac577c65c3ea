"""Outlines of languages with braces, from a lexer alone: JavaScript, TypeScript, Go, Java, Rust, C#.

Comments, strings and the like are blanked first, so what braces remain are the program's own.  One
pass over brackets gives the blocks with the text before each (its head); the head tells a function
from a type and from anything else.  Functions count at the top, and as members of a type there (in
C# below namespaces too); functions in functions, branches and calls don't.

A text whose brackets don't match has no outline.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?\*/"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_TEMPLATE, _RAW = r"`(?:[^`\\]|\\.)*`", r"`[^`]*`"
#: A slash opens a regular expression where no value can stand before it.
_REGEX = r"(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"

_NAME, _ARGS, _GENERIC = r"[A-Za-z_$][\w$]*", r"\([^;]*\)", r"<[^<>]*(?:<[^<>]*>[^<>]*)*>"
_NOT = r"(?!(?:if|for|while|switch|catch|with|return|new|else|do|try|lock|using|foreach|fixed|synchronized|match|loop|unsafe)\b)"


@dataclass(frozen=True)
class Braces:
    """How one language looks: what to blank, and heads of functions and of types that hold members (their group ``name``)."""

    blanks: tuple[str, ...]
    functions: tuple[str, ...]
    members: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    #: Heads of blocks that count as if they weren't there.
    open: tuple[str, ...] = ()
    #: An import statement, with the groups module and names.
    imports: str | None = None
    #: Whether a name found in a head can be used elsewhere.
    public: Callable[[str, str], bool] = lambda head, name: True


_TYPED = r"(?:\s*:[^=;]+)?"
_ARROW = rf"(?:const|let|var)\s+(?P<name>{_NAME})\b[^;]*=\s*(?:async\s*)?(?:{_GENERIC}\s*)?(?:\([^;]*\){_TYPED}|{_NAME})\s*=>$"
_ASSIGNED = rf"(?:const|let|var)\s+(?P<name>{_NAME})\b[^;]*=\s*(?:async\s+)?function\b\s*\*?\s*(?:{_NAME})?\s*{_ARGS}{_TYPED}$"
_FUNCTION = rf"(?:^|\n)\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<name>{_NAME})?\s*(?:{_GENERIC}\s*)?{_ARGS}{_TYPED}$"
_METHOD = rf"(?:^|[\s*]){_NOT}(?P<name>#?{_NAME}|\[[^\]]*\])\s*(?:{_GENERIC}\s*)?{_ARGS}{_TYPED}$"
_ES_IMPORT = r"^import\b(?P<names>[^;'\"]*?)(?:\bfrom\s*)?['\"](?P<module>[^'\"]+)['\"];?"
_JAVA_MEMBER = rf"(?:^|\s){_NOT}(?P<name>{_NAME})\s*{_ARGS}(?:\s*throws\s[^{{}};]+)?$"
_EXPORTED = re.compile(r"(?:^|\s)export\b")

_SCRIPT = Braces(
    (_LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE, _REGEX), (_FUNCTION, _ASSIGNED, _ARROW), (_METHOD,), (rf"\bclass\s+(?P<name>{_NAME})[^=()]*$",), (r"\b(?:namespace|module)\s+[\w.$]+$",), _ES_IMPORT,
    lambda head, name: not name.startswith("#") and bool(_EXPORTED.search(head) or not re.search(r"\b(function|class|const|let|var)\b", head) and not re.search(r"\b(private|protected)\b", head)),
)
LANGUAGES: dict[str, Braces] = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "tsx": _SCRIPT,
    "go": Braces(
        (_LINE, _BLOCK, _DOUBLE, _RAW, _CHAR), (rf"(?:^|\n)func\s*(?:\([^()]*\)\s*)?(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*\([^;]*$", rf"(?:^|\n)var\s+(?P<name>{_NAME})\b[^\n=]*=\s*func\s*\([^;]*$"),
        imports=r"^import\s*(?P<names>)(?P<module>\([^)]*\)|(?:[\w.]+\s+)?\"[^\"]+\")", public=lambda head, name: name[:1].isupper(),
    ),
    "java": Braces((_LINE, r'""".*?"""', _BLOCK, _DOUBLE, _CHAR), (), (_JAVA_MEMBER,), (rf"\b(?:class|interface)\s+(?P<name>{_NAME})[^()=]*$",), (), r"^import\s+(?P<names>(?:static\s+)?)(?P<module>[\w.*]+)\s*;", lambda head, name: bool(re.search(r"\bpublic\b", head))),
    "rust": Braces(
        (_LINE, _BLOCK, r'r(#+)".*?"\1', _DOUBLE, _CHAR), (rf"\bfn\s+(?P<name>{_NAME})\s*(?:{_GENERIC})?\s*\([^;]*$",), (rf"\bfn\s+(?P<name>{_NAME})\s*(?:{_GENERIC})?\s*\([^;]*$",), (rf"\b(?:impl|trait)\b(?:\s*{_GENERIC})?\s*(?P<name>{_NAME})?[^()=]*$",),
        imports=r"^(?:pub\s+)?use\s+(?P<names>)(?P<module>[^;]+);", public=lambda head, name: bool(re.search(r"\bpub\b", head)),
    ),
    "csharp": Braces(
        (_LINE, _BLOCK, r'\$?@"(?:[^"]|"")*"', r'\$?"(?:[^"\\\n]|\\.)*"', _CHAR), (), (rf"(?:^|\s){_NOT}(?P<name>{_NAME})\s*(?:{_GENERIC})?\s*{_ARGS}(?:\s*(?::|where\b)[^{{}};]*)?$",), (rf"\b(?:class|interface|struct|record)\s+(?P<name>{_NAME})[^=;]*$",), (r"\bnamespace\s+[\w.]+$",),
        r"^using\s+(?P<names>(?:static\s+)?)(?P<module>[\w.]+)\s*;", lambda head, name: bool(re.search(r"\bpublic\b", head)),
    ),
}


def blanked(source: str, patterns: tuple[str, ...]) -> str:
    """source with each match of patterns as blanks of the same length; line breaks stay."""
    joined = re.compile("|".join(f"(?:{p})" for p in patterns), re.DOTALL)
    return joined.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


@dataclass
class Block:
    kind: str
    name: str
    head: str
    begin: int
    first: int
    last: int = 0
    inner: list[Block] = field(default_factory=list)


_VALUE = re.compile(r"(?:[=(,:\[?&|<]|\breturn)\s*$")


def blocks(source: str, language: Braces) -> list[Block]:
    """Functions and types at the top with the members of types; raises ValueError where brackets don't match."""
    text = blanked(source, language.blanks)
    line_of = list(itertools.accumulate((c == "\n" for c in text), initial=1))
    root = Block("open", "", "", 0, 0)
    # (bracket, block it belongs to or None, where the statement at hand began)
    stack: list[tuple[str, Block | None, int]] = [("", root, 0)]
    for m in re.finditer(r"[(){}\[\];]", text):
        mark, at = m[0], m.start()
        opened, owner, since = stack[-1]
        if mark == ";":
            if opened in ("", "{"):
                stack[-1] = (opened, owner, at + 1)
        elif mark in "([":
            stack.append((mark, None, at + 1))
        elif mark == "{":
            head = text[since:at].strip()
            found = _kind(head, owner, language) if owner is not None and opened in ("", "{") else None
            block = None
            if found:
                # a statement begins at its first character that isn't blank
                begin = since + len(text[since:at]) - len(text[since:at].lstrip())
                block = Block(*found, head, begin, line_of[at])
                (owner if owner.kind != "open" else root).inner.append(block)
            stack.append((mark, block, at + 1))
        else:
            if opened + mark not in ("()", "[]", "{}") or len(stack) == 1:
                raise ValueError(at)
            stack.pop()
            if mark == "}":
                if owner is not None:
                    owner.last = line_of[at]
                outer, holder, began = stack[-1]
                if outer in ("", "{") and not _VALUE.search(text[began : since - 1] if owner is None else ""):
                    stack[-1] = (outer, holder, at + 1)
    if len(stack) > 1:
        raise ValueError(len(text))
    return [b for b in _flat(root) if b.kind != "open"]


def _kind(head: str, owner: Block, language: Braces) -> tuple[str, str] | None:
    """(kind, name) of a block with this head in owner, or None for one that is neither function nor type."""
    if _VALUE.search(head):
        return None
    patterns = {"open": [("function", language.functions), ("class", language.types), ("open", language.open)], "class": [("method", language.members)]}.get(owner.kind, [])
    for kind, group in patterns:
        for pattern in group:
            if m := re.search(pattern, head, re.DOTALL):
                return kind, (m.groupdict().get("name") or "")
    return None


def _flat(block: Block) -> list[Block]:
    return [x for b in block.inner for x in (b, *_flat(b))]


def body_lines(source: str, language: str) -> set[int]:
    """1-based lines between the braces of functions and methods, without the braces' own."""
    found = blocks(source, LANGUAGES[language])
    return {n for b in found if b.kind in ("function", "method") for n in range(b.first + 1, b.last)}


def symbols(source: str, language: str) -> list[dict]:
    spec, out = LANGUAGES[language], []
    for b in blocks(source, spec):
        name = b.name
        if name and not name.startswith("["):
            line = source.count("\n", 0, b.begin) + 1
            out.append({"name": name, "kind": b.kind, "line": line, "is_public": spec.public(b.head, name), "is_entry_point": b.kind != "class" and name in ("main", "Main")})
    return out


def imports(source: str, language: str) -> list[dict]:
    """Import statements at the start of a line: (line, last line, module, names)."""
    spec, out = LANGUAGES[language], []
    if spec.imports is None:
        return out
    clean = blanked(source, tuple(p for p in spec.blanks if p in (_LINE, _BLOCK)))
    for m in re.finditer(spec.imports, clean, re.MULTILINE | re.DOTALL):
        modules = re.findall(r'"([^"]+)"', m["module"]) if '"' in m["module"] else [" ".join(m["module"].split())]
        names = [x.strip().removeprefix("type ").strip() for x in re.split(r"[{},]", m["names"]) if x.strip()]
        out.append({"line": clean.count("\n", 0, m.start()) + 1, "last": clean.count("\n", 0, m.end()) + 1, "modules": modules, "names": names})
    return out


def relationships(source: str, language: str) -> list[dict]:
    """Imports, base types, and calls inside functions by name."""
    spec, out = LANGUAGES[language], []

    def add(kind: str, origin: str | None, target: str, line: int, qualifier: str | None = None, binds: str | None = None) -> None:
        out.append({"ordinal": len(out), "kind": kind, "source": origin, "target": target, "line": line, "qualifier": qualifier, "origin": binds})

    for found in imports(source, language):
        for module in found["modules"]:
            if language in ("javascript", "typescript", "tsx") and found["names"]:
                for name in found["names"]:
                    origin, _, bound = name.partition(" as ")
                    add("import", None, module, found["line"], (bound or origin).strip(), origin.strip())
            else:
                last = re.split(r"[./:]+", module.rstrip("/"))[-1]
                add("import", None, module, found["line"], last, last)
    text = blanked(source, spec.blanks)
    lines = text.split("\n")
    for b in blocks(source, spec):
        line = source.count("\n", 0, b.begin) + 1
        if b.kind == "class":
            for base in re.findall(r"(?:\bextends|\bimplements|:|,)\s+([\w$.]+)", b.head.partition(b.name)[2] if b.name else ""):
                add("inherits", b.name, base, line)
        elif b.name:
            for n in range(b.first, b.last + 1):
                part = lines[n - 1] if n > b.first else lines[n - 1].rpartition("{")[2]
                for call in re.finditer(rf"(?:\b({_NAME})\s*(?:\.|::)\s*)?(?<![\w$.]){_NOT}({_NAME})\s*\(|\b({_NAME})\s*(?:\.|::)\s*({_NAME})\s*\(", part):
                    owner, name = (call[3], call[4]) if call[4] else (call[1], call[2])
                    add("calls", b.name, name, n, owner)
    return out
