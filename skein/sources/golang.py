"""Entities of Go files, read off the token stream.

A pass over the tokens keeps track of brackets; declarations are found at the top level, and
calls, literals and composite values inside bodies by the tokens around them.
"""

from __future__ import annotations

import re

from skein.sources.gogrammar import failure
from skein.sources.gotokens import lex
from skein.sources.tokens import Tokens

MOST_LITERALS = 50
# Resource types a controller's helpers may make.
MADE_TYPES = frozenset("Deployment StatefulSet DaemonSet ReplicaSet Job CronJob Service ConfigMap Secret".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


class Unparsable(ValueError):
    """A file that is no Go."""


def entity(kind: str, id_: str, name: str, path: str, line: int, parser: str, **more) -> dict:
    """An entity row with all fields; those not given are empty."""
    empty = {c: [] for c in ("files", "imports", "literals", "properties", "embeds", "watches", "calls", "implements", "env_vars")}
    text = {c: "" for c in ("description", "package", "content", "last_author", "last_modified")}
    return {"id": id_, "name": name, "kind": kind, **text, **empty, "change_count": 0, "source_parser": parser, "source_file": path, "source_line": line} | more


class Source:
    """A lexed file: partners of brackets, places of declarations."""

    def __init__(self, text: str):
        self.t: Tokens = lex(text)
        k = self.t.kinds
        if "BAD" in k or not k or k[0] != "package" or len(k) < 3 or k[1] != "ID":
            raise Unparsable("no package clause" if "BAD" not in k else f"bad token at line {self.line(self.t.starts[k.index('BAD')])}")
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, x in enumerate(k):
            if x in _OPEN:
                stack.append(i)
            elif x in _CLOSE:
                if not stack or "([{".index(k[stack[-1]]) != ")]}".index(x):
                    raise Unparsable(f"unmatched {x} at line {self.line(self.t.starts[i])}")
                j = stack.pop()
                self.partner[i], self.partner[j] = j, i
        if stack:
            raise Unparsable("unexpected end of file")
        at = failure(self.t)
        if at is not None:
            raise Unparsable(f"syntax error at line {self.line(self.t.starts[at])}" if at < len(k) else "unexpected end of file")
        self.package = self.t.word(1)
        self.comment_ends = {self.line(b - 1): (a, b) for a, b in self.t.comments}

    def line(self, place: int) -> int:
        return self.t.text.count("\n", 0, place) + 1

    def doc(self, i: int) -> str:
        """The text of the comments right above the declaration at token i."""
        line, parts = self.line(self.t.starts[i]), []
        while (found := self.comment_ends.get(line - 1)) is not None:
            a, b = found
            begin = self.t.text.rfind("\n", 0, a) + 1
            if self.t.text[begin:a].strip():
                break
            parts.append(self.t.text[a:b])
            line = self.line(a)
        lines = []
        for part in reversed(parts):
            if part.startswith("/*"):
                lines += [x.strip() for x in part[2:-2].split("\n")]
            elif not re.match(r"//(?:[a-z0-9]+:[a-z0-9]|line |extern |export )", part):
                lines.append(part[2:].removeprefix(" ").rstrip())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    def top(self):
        """Tokens that begin a top-level declaration."""
        i, n, k = 0, len(self.t.kinds), self.t.kinds
        fresh = True
        while i < n:
            if fresh and k[i] in ("import", "func", "type", "var", "const"):
                yield i
            fresh = k[i] == ";"
            i = self.partner[i] + 1 if k[i] in _OPEN else i + 1

    def specs(self, i: int):
        """First tokens of the specs of a declaration, grouped or not."""
        k = self.t.kinds
        if k[i + 1] != "(":
            yield i + 1
            return
        j, end, fresh = i + 2, self.partner[i + 1], True
        while j < end:
            if fresh and k[j] != ";":
                yield j
            fresh = k[j] == ";"
            j = self.partner[j] + 1 if k[j] in _OPEN else j + 1


def _receiver(s: Source, i: int) -> tuple[str, str]:
    """(variable, type name) of a receiver's brackets; no type for generic ones."""
    k, words = s.t.kinds[i + 1 : s.partner[i]], range(i + 1, s.partner[i])
    ids = [j for j in words if s.t.kinds[j] == "ID"]
    if "[" in k or not ids:
        return (s.t.word(ids[0]) if len(ids) > 1 else "", "")
    return (s.t.word(ids[0]) if len(ids) > 1 else "", s.t.word(ids[-1]))


class Function:
    """A function declaration: name, receiver, body range (tokens), doc, line."""

    def __init__(self, s: Source, i: int):
        k = s.t.kinds
        self.line, self.doc, self.variable, self.receiver = s.line(s.t.starts[i]), s.doc(i), "", ""
        j = i + 1
        if k[j] == "(":
            self.variable, self.receiver = _receiver(s, j)
            j = s.partner[j] + 1
        self.name, self.body, self.method = s.t.word(j), None, k[i + 1] == "("
        while j < len(k) and k[j] != ";":
            if k[j] == "{" and k[j - 1] not in ("struct", "interface"):
                self.body = (j, s.partner[j])
                break
            j = s.partner[j] + 1 if k[j] in _OPEN else j + 1


def _calls(s: Source, body: tuple[int, int]) -> list[tuple[int, str, int]]:
    """(place in pre-order, name, bracket) of the calls in a body.

    A call encloses the calls its function expression is made of, so of two calls of a chain
    the later bracket comes first; otherwise they come as written.
    """
    k, t, out = s.t.kinds, s.t, []
    for i in range(body[0] + 1, body[1]):
        if k[i] != "(" or k[i - 1] != "ID":
            continue
        j = i - 1
        if k[j - 1] in ("func", "type"):
            continue
        if k[j - 1] == "." and k[j - 2] == "ID" and k[j - 3] != ".":
            name, start = f"{t.word(j - 2)}.{t.word(j)}", j - 2
        elif k[j - 1] == ".":
            name, start = t.word(j), _operand(s, j)
        else:
            name, start = t.word(j), j
        out.append((start, -i, name))
    return [(a, name, -b) for a, b, name in sorted(out)]


def _operand(s: Source, j: int) -> int:
    """The first token of the selector expression that ends at the name j."""
    k = s.t.kinds
    while k[j - 1] == ".":
        j -= 2
        while k[j] in _CLOSE:
            j = s.partner[j] - 1
            if k[j] not in _CLOSE and k[j] != "ID":
                return j + 1
    return j


def _literals(s: Source, body: tuple[int, int]) -> list[str]:
    found: dict[str, None] = {}
    k, t = s.t.kinds, s.t
    for i in range(body[0] + 1, body[1]):
        if k[i] == "STR":
            text = t.word(i).strip('"`')
            if len(text.encode()) >= 4 and re.search(r"[./\-_:]", text):
                found.setdefault(text)
        elif k[i] == "ID" and k[i - 1] == ".":
            name = t.word(i)
            if len(name) >= 8 and name[:1].isupper():
                found.setdefault(name)
    return list(found)[:MOST_LITERALS]


def _composite(s: Source, i: int) -> str:
    """The type name of ``&pkg.T{..}`` or ``T{..}`` that begins at token i, '' if none does."""
    k = s.t.kinds
    i += k[i] == "&"
    if k[i] == "ID" and k[i + 1] == "{":
        return s.t.word(i)
    if k[i : i + 4] == ["ID", ".", "ID", "{"]:
        return s.t.word(i + 2)
    return ""


def _assertions(s: Source) -> dict[str, list[str]]:
    """Interfaces asserted by ``var _ Iface = T{}``, by type."""
    out: dict[str, list[str]] = {}
    k, t = s.t.kinds, s.t
    for i in s.top():
        if k[i] != "var":
            continue
        for j in s.specs(i):
            if t.word(j) != "_":
                continue
            eq = j + 1
            while eq < len(k) and k[eq] not in ("=", ";"):
                eq += 1
            if k[eq] != "=" or eq == j + 1 or k[eq - 1] != "ID":
                continue
            name = _composite(s, eq + 1) or (t.word(eq + 1) if k[eq + 1] == "ID" and k[eq + 2] == ";" and t.word(eq + 1) != "nil" else "")
            if name:
                out.setdefault(name, []).append(t.word(eq - 1))
    return out


def parse(path: str, text: str) -> list[dict]:
    """The package of a file, its functions, and its controller if it has one."""
    s = Source(text)
    k, t, pkg = s.t.kinds, s.t, s.package
    imports = [t.word(next(x for x in (j, j + 1) if k[x] == "STR")).strip('"`') for i in s.top() if k[i] == "import" for j in s.specs(i)]
    embeds = [x for a, b in t.comments if (c := t.text[a:b]).startswith("//go:embed ") and (x := c[11:].strip())]
    folder = path.rpartition("/")[0] or "."
    rows = [entity("package", f"package:{pkg}", pkg, folder, 1, "go", package=pkg, files=[path], imports=imports, embeds=embeds)]
    asserted, types = _assertions(s), {}
    functions = []
    for i in s.top():
        if k[i] == "type":
            specs = list(s.specs(i))
            for j in specs:
                doc = s.doc(j) if k[i + 1] == "(" else s.doc(i)
                types[t.word(j)] = doc or (s.doc(i) if len(specs) == 1 else "")
        elif k[i] == "func":
            functions.append(Function(s, i))
    controller, watches, helpers, variable = None, [], set(), ""
    for f in functions:
        calls, env, literals = [], [], []
        if f.body:
            made = _calls(s, f.body)
            calls = list(dict.fromkeys(name for _, name, _ in made))
            env = list(dict.fromkeys(x for _, name, b in made if name == "os.Getenv" and k[b + 1] == "STR" and k[b + 1] and (x := t.word(b + 1).strip('"'))))
            literals = _literals(s, f.body)
        owner = f"{pkg}.{f.receiver}" if f.receiver else pkg
        own = entity("function", f"function:{owner}.{f.name}", f.name, path, f.line, "go", package=pkg, description=f.doc, calls=calls, env_vars=env, literals=literals, implements=asserted.get(f.receiver, []) if f.receiver else [])
        rows.append(own)
        if f.name == "Reconcile" and f.receiver:
            controller = own | {"recv": f.receiver}
        if f.name == "SetupWithManager" and f.body:
            variable = f.variable or variable
            for b in range(f.body[0], f.body[1]):
                if k[b] == "(" and k[b - 1] == "ID" and k[b - 2] == ".":
                    if t.word(b - 1) in ("For", "Owns", "Watches") and (name := _composite(s, b + 1)):
                        watches.append(name)
                    if k[b - 3] == "ID" and t.word(b - 3) == variable and k[b - 4] != ".":
                        helpers.add(t.word(b - 1))
    if controller:
        name = controller["recv"]
        made = [
            t.word(i + 3) for f in functions if f.body and f.method and f.receiver == name and f.name in helpers
            for i in range(*f.body) if k[i] == "&" and k[i + 1 : i + 5] == ["ID", ".", "ID", "{"] and t.word(i + 3) in MADE_TYPES
        ]
        rows.append(
            entity("controller", f"controller:{pkg}.{name}", name, path, controller["source_line"], "go", package=pkg, description=types.get(name, ""), watches=watches, calls=controller["calls"],
                   implements=asserted.get(name, []), properties=[f"creates:{x}" for x in dict.fromkeys(made)])
        )
    return rows


def parse_tests(path: str, text: str) -> list[dict]:
    """The test functions of a file: without receiver, named Test..."""
    s = Source(text)
    found = [Function(s, i) for i in s.top() if s.t.kinds[i] == "func"]
    return [entity("test", f"test:{s.package}.{f.name}", f.name, path, f.line, "test", package=s.package, description=f.doc) for f in found if not f.method and f.name.startswith("Test")]
