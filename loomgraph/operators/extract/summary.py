"""What a file defines and refers to, as a few lines of text for a prompt."""

from __future__ import annotations

import sys

# How much of each is shown.
METHODS, FUNCTIONS, IMPORTS, CALLS = 8, 12, 10, 12


def _some(items: list[str], most: int) -> str:
    return ", ".join(items[:most]) + (f" and {len(items) - most} more" if len(items) > most else "")


def compact_summary(path: str, defs: list[dict], refs: list[dict]) -> str:
    """Classes with bases and methods, functions, imports from outside and calls of a parsed file; a file without definitions gives its path alone."""
    module = next((d for d in defs if d["kind"] == "module"), None)
    lines = [path + (f": {module['docstring'].splitlines()[0]}" if module and module["docstring"] else "")]
    for d in defs:
        if d["kind"] == "class":
            bases = f"({', '.join(d['bases'])})" if d["bases"] else ""
            methods = _some([m["signature"] or m["name"] for m in d["methods"]], METHODS)
            lines.append(f"class {d['name']}{bases}" + (f": {methods}" if methods else ""))
    functions = [d["signature"] or d["name"] for d in defs if d["kind"] == "function"]
    # what Python itself brings along is no dependency
    outside = sorted({r["target"].split(".")[0] for r in refs if r["ref_kind"] == "import" and not r["is_relative"] and r["target"]} - set(sys.stdlib_module_names))
    calls = sorted({r["target"] for r in refs if r["ref_kind"] == "call"})
    for name, items, most in (("functions", functions, FUNCTIONS), ("imports", outside, IMPORTS), ("uses", calls, CALLS)):
        if items:
            lines.append(f"{name}: {_some(items, most)}")
    return "\n".join(lines)
