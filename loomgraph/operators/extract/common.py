"""Rows that all extractors make."""

from __future__ import annotations


def definition(path: str, kind: str, name: str, line_start: int, line_end: int, **more) -> dict:
    base = {"path": path, "kind": kind, "subkind": "", "name": name, "bases": [], "decorators": [], "docstring": "", "line_start": line_start, "line_end": line_end, "signature": "", "is_async": False, "methods": []}
    return base | more


def reference(path: str, owner: str, ref_kind: str, target: str, via: str = "", level: int = 0, is_relative: bool = False, serialized: bool = False) -> dict:
    return {"path": path, "owner": owner, "ref_kind": ref_kind, "target": target, "via": via, "level": level, "is_relative": is_relative, "serialized": serialized}


def unique(rows: list[dict]) -> list[dict]:
    seen, out = set(), []
    for r in rows:
        key = tuple(r.values())
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out
