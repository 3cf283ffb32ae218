"""Encoders and models by name: what a run calls is registered here, since nothing in the library reaches a network.

A provider is a factory: settings to a function that `golden.applied` calls, a text (or a list of them) to text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

KINDS = ("dense", "sparse", "chat", "parser")
_KNOWN: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, factory: Callable) -> None:
    """Makes a provider known; a later one of the same name takes its place."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind!r}")
    _KNOWN[kind, name] = factory


def provider(kind: str, name: str, settings=None) -> Callable:
    """The function of a provider, made from the settings; an unknown name is an error that tells the known ones."""
    if (kind, name) not in _KNOWN:
        known = ", ".join(sorted(n for k, n in _KNOWN if k == kind)) or "none"
        raise ValueError(f"no {kind} provider {name!r}; known: {known}")
    return _KNOWN[kind, name](settings)


def _stub_sparse(settings) -> Callable[[str], str]:
    """Word hashes as dimensions, weighted by how often they occur: repeatable, with no model behind it."""

    def encode(text: str) -> str:
        found: dict[int, float] = {}
        for word in (text or "").lower().split():
            index = int.from_bytes(hashlib.md5(word.encode()).digest()[:3])
            found[index] = found.get(index, 0.0) + 1.0
        order = sorted(found)
        return json.dumps({"indices": order, "values": [found[i] for i in order]})

    return encode


def _plain_parser(settings) -> Callable[[bytes], str]:
    return lambda content: bytes(content).decode()


register("sparse", "stub", _stub_sparse)
register("parser", "md", _plain_parser)
