"""Engine assets in YAML: references by guid and method bindings of events."""

from __future__ import annotations

import re

from loomgraph.operators.extract.common import definition, reference, unique

_GUID = re.compile(r"\bguid:\s*([0-9a-fA-F]{32})\b")
_SCRIPT = re.compile(r"m_Script:\s*\{[^}]*guid:\s*([0-9a-fA-F]{32})")
# a binding of an event: keys of one call, of which the method is the last that counts; a new call starts with a dash
_BINDING = re.compile(r"(?P<new>^[ \t]*-[ \t])|m_TargetAssemblyTypeName:[ \t]*(?P<type>[^\n]*)|m_MethodName:[ \t]*(?P<method>[A-Za-z_]\w*)", re.M)
_KINDS = {".unity": "scene", ".prefab": "prefab", ".asset": "asset"}
# Types of the engine are no entities, and these methods without a type are the engine's.
ENGINE_TYPES = ("UnityEngine.", "TMPro.")
ENGINE_METHODS = frozenset("SetActive Play Stop Pause SendMessage BroadcastMessage Destroy".split())


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """The module of an asset, guids it refers to, and methods its events call on a type; files that are no YAML and assets without a script are skipped."""
    suffix = path[path.rfind(".") :].lower()
    if not text.lstrip("\ufeff \t\r\n").startswith("%YAML"):
        return [], []
    if suffix == ".asset" and not _SCRIPT.search(text):
        return [], []
    defs = [definition(path, "module", path, 1, text.count("\n") + 1, subkind=f"unity.{_KINDS.get(suffix, 'asset')}")]
    refs = [reference(path, "", "guid", g.lower()) for g in _GUID.findall(text)]
    target = ""
    for m in _BINDING.finditer(text):
        if m["new"] is not None:
            target = ""
        if m["type"] is not None:
            target = m["type"].strip()
        elif m["method"] and not target.startswith(ENGINE_TYPES):
            receiver = target.split(",")[0].strip().rpartition(".")[2]
            if receiver or m["method"] not in ENGINE_METHODS:
                refs.append(reference(path, "", "method_call", f"{receiver}::{m['method']}", "UnityEvent"))
            target = ""
    return defs, unique(refs)
