"""Entities of Markdown files and YAML manifests; commits and diffs from git's output."""

from __future__ import annotations

import re

from skein.sources.golang import Unparsable, entity

try:
    import yaml
except ImportError:  # optional; YAML files then give warnings
    yaml = None

DOC_LINES, DOC_CHARS, YAML_DEPTH, YAML_ITEMS = 8, 500, 5, 100
# Keys of manifests that say nothing about them.
SKIPPED_KEYS = frozenset("managedFields annotations resourceVersion creationTimestamp uid generation selfLink status".split())


def parse_markdown(path: str, text: str) -> list[dict]:
    """A document: headings as description, the first prose lines after the first as content."""
    headings, prose, fenced = [], [], False
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = raw.strip()
        if line.startswith("```"):
            fenced = not fenced
        elif fenced:
            continue
        elif line.startswith("#"):
            if title := line.lstrip("#").strip():
                headings.append(title)
        elif headings and line and len(prose) < DOC_LINES and not line.startswith(("---", "<!--", "{{")):
            prose.append(line)
    content = " ".join(prose)
    if len(content) > DOC_CHARS:
        content = content[: DOC_CHARS - 3] + "..."
    name = path.rpartition("/")[2]
    return [entity("document", f"document:{name}", name, path, 1, "markdown", package="documentation", description="; ".join(headings), content=content)]


def _said(value) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def flatten(data) -> list[str]:
    """``a.b.0=value`` of nested data, keys in order, to a depth and a number of items."""
    out: list[str] = []

    def go(prefix: str, x, depth: int) -> None:
        if depth > YAML_DEPTH or len(out) >= YAML_ITEMS:
            return
        if isinstance(x, dict):
            for key in sorted(x, key=str):
                if str(key) not in SKIPPED_KEYS:
                    go(f"{prefix}.{key}" if prefix else str(key), x[key], depth + 1)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                go(f"{prefix}.{i}", y, depth + 1)
        elif prefix and x is not None:
            out.append(f"{prefix}={_said(x)}")

    go("", data, 0)
    return out


def _dig(x, *keys) -> str:
    for key in keys:
        x = x.get(key) if isinstance(x, dict) else None
    return x if isinstance(x, str) else ""


def parse_yaml(path: str, text: str) -> list[dict]:
    """The crd or resource of a manifest; nothing of other YAML. The first document counts."""
    if yaml is None:
        raise Unparsable("no YAML library")
    try:
        data = next(iter(yaml.safe_load_all(text)), None)
    except yaml.YAMLError as e:
        raise Unparsable(str(e).replace("\n", " ")) from e
    kind, name = _dig(data, "kind"), _dig(data, "metadata", "name")
    if not kind or not name:
        return []
    if kind == "CustomResourceDefinition":
        group, title = _dig(data, "spec", "group"), _dig(data, "spec", "names", "kind") or name
        versions = data["spec"].get("versions") if isinstance(data.get("spec"), dict) else None
        told = [_dig(v, "schema", "openAPIV3Schema", "description") for v in versions or [] if isinstance(v, dict)]
        return [entity("crd", f"crd:{group}.{title.lower()}", title, path, 1, "yaml", package=group, description=next(filter(None, told), ""))]
    return [entity("resource", f"resource:{kind.lower()}.{name}", name, path, 1, "yaml", package=_dig(data, "metadata", "namespace"), properties=flatten(data))]


def parse_log(text: str) -> list[tuple[int, str, int, str]]:
    """(seq, author, ts, path) of ``git log --format='%ae %at' --name-only``, newest first."""
    rows, seq, author, ts = [], -1, "", 0
    for line in text.split("\n"):
        head = re.fullmatch(r"(\S+@\S*|\S+) (\d{6,})", line)
        if head:
            seq, author, ts = seq + 1, head[1], int(head[2])
        elif line.strip() and seq >= 0:
            rows.append((seq, author, ts, line.strip()))
    return rows


_HUNK = re.compile(r"@@ -(\S+) \+(\S+) @@ ?(.*)")


def _range(text: str) -> tuple[int, int]:
    start, _, count = text.partition(",")
    number = lambda x: int(x) if re.fullmatch(r"[+-]?\d+", x) else 0
    return number(start), number(count) if count or "," in text else 1


def parse_diff(text: str) -> tuple[list[tuple], list[tuple]]:
    """(files, hunks) of a unified diff: (file_ord, path, old_path, status, added, deleted) and
    (file_ord, hunk_ord, old_start, old_count, new_start, new_count, header)."""
    files: list[list] = []
    hunks: list[tuple] = []
    inside, number = False, 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("diff --git "):
            names = re.fullmatch(r"diff --git a/(.*) b/(.*)", line)
            files.append([len(files), names[2] if names else "", names[1] if names else "", "M", 0, 0])
            inside, number = False, 0
        elif not files:
            continue
        elif m := _HUNK.match(line):
            inside = True
            hunks.append((files[-1][0], number, *_range(m[1]), *_range(m[2]), m[3]))
            number += 1
        elif inside:
            files[-1][4] += line.startswith("+")
            files[-1][5] += line.startswith("-")
        elif line.startswith("new file"):
            files[-1][3] = "A"
        elif line.startswith("deleted file"):
            files[-1][3] = "D"
        elif line.startswith("rename from "):
            files[-1][2:4] = [line[12:], "R"]
        elif line.startswith("rename to "):
            files[-1][1] = line[10:]
    return [tuple(f) for f in files], hunks
