"""Plain-text rendering of results that are already small. Nothing here changes its input."""

from __future__ import annotations


SHOWN, SHOWN_PROPERTIES = 10, 15
# The order in which edge types are shown.
TYPE_ORDER = ["reconciles", "creates", "calls", "watches", "tested_by", "owns", "documented_in", "depends_on", "imports", "implements", "emits", "contains", "part_of", "embeds"]
LIMITS = ["Static analysis only: calls through interfaces are not followed.", "Changed lines are matched to the nearest entity above them.", "Only files of the scanned repository are known."]


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def some(values: list[str], most: int = SHOWN) -> str:
    more = f" (+{len(values) - most} more)" if len(values) > most else ""
    return ", ".join(values[:most]) + more


def line(e) -> str:
    """An entity in one line."""
    told = f" - {cut(e['description'], 80)}" if e["description"] else ""
    return f"{e['id']}  {e['source_file']}:{e['source_line']}{told}"


def full(e) -> str:
    """An entity with the fields that are set."""
    out = [f"{e['kind']}: {e['name']}", f"  id: {e['id']}", f"  source: {e['source_file']}:{e['source_line']}"]
    out += [f"  {label}: {e[c]}" for c, label in (("package", "package"), ("description", "description")) if e[c]]
    for c in ("files", "imports", "calls", "literals", "properties", "watches", "implements", "env_vars", "embeds"):
        if e[c]:
            out.append(f"  {c}: {some(e[c], SHOWN_PROPERTIES if c == 'properties' else SHOWN)}")
    if e["change_count"]:
        out.append(f"  history: {e['change_count']} changes, last {e['last_modified']} by {e['last_author']}")
    return "\n".join(out)


def entities(rows, brief: bool = True) -> str:
    return ("\n" if brief else "\n\n").join(map(line if brief else full, rows)) or "No entities found."


def edge(r) -> str:
    return f"{r['src']} --{r['type']}--> {r['dst']}  [{r['confidence']}] {r['ev_file'].rpartition('/')[2]}:{r['ev_line']}"


def edges(rows) -> str:
    return "\n".join(map(edge, rows)) or "No relationships found."


def subgraph(nodes, links, more: int = 0) -> str:
    """Entities with their edges; ``more``: how many edges are not among ``links``."""
    out = []
    for e in nodes:
        out.append(line(e))
        out += [f"  -> {r['type']} {r['dst']}" for r in links if r["src"] == e["id"]] + [f"  <- {r['type']} {r['src']}" for r in links if r["dst"] == e["id"]]
    return "\n".join(out + ([f"(+{more} more relationships)"] if more else [])) or "No entities found."


def stats(kinds, types) -> str:
    total = lambda rows: sum(r["count"] for r in rows)
    out = [f"Entities: {total(kinds)}", *[f"  {r['kind']}: {r['count']}" for r in sorted(kinds, key=lambda r: r["kind"])], f"Relationships: {total(types)}"]
    return "\n".join(out + [f"  {r['type']}: {r['count']}" for r in sorted(types, key=lambda r: r["type"])])


def view(v) -> str:
    out = [f"{v['kind']}: {v['name']}", f"  {v['source_file']}"] + ([f"  {v['description']}"] if v["description"] else [])
    for c in ("reconciles", "reconciled_by", "watches", "creates", "created_by", "calls", "called_by", "tests", "owners"):
        if v[c]:
            out.append(f"  {c.replace('_', ' ')}: {v[c] if isinstance(v[c], str) else some(v[c])}")
    return "\n".join(out)


def investigation(e, parts: dict) -> str:
    """An entity, its edges by type in the order of display, callers, tests and its file's others."""
    rank = {t: i for i, t in enumerate(TYPE_ORDER)}
    out = [full(e)]
    for title, rows, end in (("Outgoing", parts["out"], "dst"), ("Incoming", parts["in"], "src")):
        out.append(f"{title}:")
        for kind in sorted({r["type"] for r in rows}, key=lambda t: (rank.get(t, len(rank)), t)):
            some_ = sorted((r for r in rows if r["type"] == kind), key=lambda r: r["n"])
            out += [f" {kind} ({len(some_)}):"] + [f"  {kind} {r['other_name']} ({r[end]})" for r in some_]
    ends = [{"id": r["dst"], "name": r["other_name"]} for r in sorted(parts["tests"], key=lambda r: r["n"])]
    for title, lines in (("Callers", [line(c) for c in parts["callers"]]), ("Tests", [f"{t['id']}" for t in ends]), ("Same file", [line(x) for x in parts["siblings"]])):
        out += [f"{title} ({len(lines)}):"] + [f"  {x}" for x in lines or ["(none)"]]
    return "\n".join(out)


def short(id_: str) -> str:
    return id_.partition(":")[2].rpartition(".")[2] or id_


def explanation(tree: list[tuple], capped: bool, compact: bool = False) -> str:
    out = [("  " * depth) + (f"{kind} " if kind else "") + (short(id_) if compact else id_) for _, depth, _, kind, id_ in tree]
    return "\n".join(out + (["(capped)"] if capped else []))


def impact(chain, parts: dict, compact: bool = False) -> str:
    name = short if compact else str
    out = [f"Impact of {name(chain[0]['root'])}: {len(chain) - 1} callers"] if chain else ["No such entity."]
    out += [f"  {'  ' * r['level']}{name(r['id'])}" for r in chain[1:]] if not compact else [f"  callers: {some([short(r['id']) for r in chain[1:]])}"] if chain[1:] else []
    for title, col in (("controllers", "id"), ("resources", "id"), ("tests", "id"), ("files", "source_file"), ("owners", "last_author")):
        if parts.get(title):
            found = sorted({name(r[col]) if col == "id" else r[col] for r in parts[title]})
            out.append(f"{title} ({len(found)}): {some(found) if compact else ', '.join(found)}")
    return "\n".join(out)


def asked(answer: dict, detail: bool = False) -> str:
    if answer["entity"] is None:
        return "No entity found."
    out = [view(answer["view"]) if answer.get("view") else full(answer["entity"])]
    if answer.get("answer"):
        out.append(f"Quick answer: {answer['answer']}")
    if "explanation" in answer:
        out.append(explanation(*answer["explanation"], compact=not detail))
    return "\n".join(out)


def label(kind: str) -> str:
    return {"function": "functions", "controller": "controllers", "crd": "CRDs", "package": "packages", "test": "tests", "document": "documents", "resource": "resources"}.get(kind, "entities")


def receiver(id_: str) -> str:
    parts = id_.partition(":")[2].split(".")
    return parts[-2] if len(parts) >= 3 else ""


def review(changed, unmapped, links, parts: dict | None = None) -> str:
    """The report of a diff: changed entities by kind with what they touch, tests and their
    targets, what is unknown.

    ``links``: (test, added, [(target, reason)]). ``parts``: by name, by entity id, the names
    of callees, callers, tests, controllers, resources and its view.
    """
    parts = parts or {}
    shown = [r for r in changed if r["kind"] != "test"]
    out = [f"Review: {len(changed)} changed entities"]
    for kind in sorted({r["kind"] for r in shown}):
        out.append(f"Changed {label(kind)}:")
        for r in (r for r in shown if r["kind"] == kind):
            out.append(f"  {r['id']}" + (f" (on {receiver(r['id'])})" if receiver(r["id"]) else "") + (" ~" if r["approximate"] else ""))
            for title in ("callees", "callers", "tests", "controllers", "resources"):
                names = parts.get(title, {}).get(r["id"], [])
                if names:
                    out.append(f"    {title} ({len(names)}): {some(names)}")
            if r["kind"] == "function" and parts and not parts.get("tests", {}).get(r["id"]):
                out.append("    tests: none known")
            if (seen := parts.get("views", {}).get(r["id"])) is not None:
                out += ["    " + x for x in view(seen).split("\n")]
    if links:
        out.append("Tests:")
        for test, added, targets in links:
            out.append(f"  {test}" + (" (added)" if added else "") + ("" if targets else ": no target found"))
            out += [f"    {test} -> {target} ({reason})" for target, reason in targets]
    if unmapped:
        out += ["Not in the graph:"] + [f"  {r['path']}" + (" (deleted)" if r["status"] == "D" else "") for r in unmapped]
    return "\n".join([*out, "Limits:", *[f"  - {x}" for x in LIMITS]])
