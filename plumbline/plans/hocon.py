"""A reader for HOCON job files: the superset of JSON that job descriptions are written in.

Supported: comments, optional commas and quotes, ``=`` and ``:``, dotted keys,
merged objects, ``+=``, triple-quoted strings, concatenation, ``include``
of files, and substitutions ``${a.b}`` and ``${?a.b}`` from the file, given
variables and the environment.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

_UNQUOTED_END = set('$"{}[]:=,+#`^?!@*&\\\n')


class _Ref:
    def __init__(self, path: str, optional: bool):
        self.path, self.optional = path, optional


class _Join(list):
    """Values that stand side by side on a line."""


class HoconError(ValueError):
    """The text is not HOCON."""


class _Reader:
    def __init__(self, text: str, base: Path | None):
        self.s, self.i, self.base = text, 0, base

    def fail(self, what: str) -> HoconError:
        return HoconError(f"line {self.s.count(chr(10), 0, self.i) + 1}: {what}")

    def skip(self, newlines: bool = True) -> bool:
        """Skip blanks and comments; whether a line ended."""
        ended = False
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "#" or self.s.startswith("//", self.i):
                end = self.s.find("\n", self.i)
                self.i = len(self.s) if end < 0 else end
            elif c == "\n":
                if not newlines:
                    break
                ended = True
                self.i += 1
            elif c.isspace() or c == "﻿":
                self.i += 1
            else:
                break
        return ended

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def root(self) -> dict:
        self.skip()
        if self.peek() == "{":
            self.i += 1
            out = self.object("}")
        else:
            out = self.object("")
        self.skip()
        if self.i < len(self.s):
            raise self.fail(f"unexpected {self.peek()!r}")
        return out

    def object(self, end: str) -> dict:
        out: dict = {}
        while True:
            self.skip()
            while self.peek() == ",":
                self.i += 1
                self.skip()
            if self.peek() == end:
                self.i += bool(end)
                return out
            if not self.peek():
                raise self.fail("unclosed object")
            m = re.compile(r'include\s+(?:(?:file|required)\()*"([^"]+)"\)*').match(self.s, self.i)
            if m:
                self.i = m.end()
                path = (self.base or Path()) / m[1]
                if path.exists():
                    _merge(out, _Reader(path.read_text(), path.parent).root())
                continue
            key = self.key()
            self.skip()
            if self.s.startswith("+=", self.i):
                self.i += 2
                value = self.value()
                at = out
                for k in key[:-1]:
                    at = at.setdefault(k, {})
                at[key[-1]] = [*at.get(key[-1], []), value]
                continue
            if self.peek() in ":=":
                self.i += 1
            elif self.peek() != "{":
                raise self.fail(f"key {'.'.join(key)!r} has no value")
            value = self.value()
            for k in reversed(key[1:]):
                value = {k: value}
            _merge(out, {key[0]: value})

    def key(self) -> list[str]:
        parts = []
        while True:
            self.skip(False)
            if self.peek() == '"':
                parts.append(self.quoted())
            else:
                m = re.compile(r"[^\s\"{}\[\]:=,+#.$]+").match(self.s, self.i)
                if not m:
                    raise self.fail(f"no key at {self.s[self.i:self.i + 20]!r}")
                parts.append(m.group())
                self.i = m.end()
            self.skip(False)
            if self.peek() != ".":
                return parts
            self.i += 1

    def quoted(self) -> str:
        if self.s.startswith('"""', self.i):
            end = self.s.find('"""', self.i + 3)
            if end < 0:
                raise self.fail("unclosed text")
            while self.s.startswith('"', end + 3):
                end += 1
            out = self.s[self.i + 3:end]
            self.i = end + 3
            return out
        m = re.compile(r'"(?:[^"\\\n]|\\.)*"').match(self.s, self.i)
        if not m:
            raise self.fail("unclosed text")
        self.i = m.end()
        return json.loads(m.group(), strict=False)

    def value(self) -> Any:
        self.skip()
        parts: list[Any] = []
        gap = ""
        while True:
            c = self.peek()
            if c == "" or c in ",\n}]" or c == "#" or self.s.startswith("//", self.i):
                break
            if c.isspace():
                start = self.i
                self.skip(False)
                gap = self.s[start:self.i]
                continue
            if parts and gap and not isinstance(parts[-1], (dict, list)):
                parts.append(gap)
            gap = ""
            if c == "{":
                self.i += 1
                parts.append(self.object("}"))
            elif c == "[":
                self.i += 1
                parts.append(self.array())
            elif c == '"':
                parts.append(("text", self.quoted()))
            elif c == "$":
                m = re.compile(r"\$\{(\?)?([^}]+)\}").match(self.s, self.i)
                if not m:
                    raise self.fail("bad substitution")
                self.i = m.end()
                parts.append(_Ref(m[2].strip().replace('"', ""), bool(m[1])))
            else:
                start = self.i
                while self.i < len(self.s) and self.s[self.i] not in _UNQUOTED_END and not self.s[self.i].isspace() and not self.s.startswith("//", self.i):
                    self.i += 1
                if self.i == start:
                    if c in "+:=?!@*&^`\\" and parts:
                        self.i += 1
                    else:
                        raise self.fail(f"unexpected {c!r}")
                parts.append(self.s[start:self.i])
        if not parts:
            raise self.fail("no value")
        if len(parts) == 1:
            p = parts[0]
            return _literal(p) if isinstance(p, str) else p[1] if isinstance(p, tuple) else p
        return _Join(p[1] if isinstance(p, tuple) else p for p in parts)

    def array(self) -> list:
        out = []
        while True:
            self.skip()
            while self.peek() == ",":
                self.i += 1
                self.skip()
            if self.peek() == "]":
                self.i += 1
                return out
            if not self.peek():
                raise self.fail("unclosed array")
            out.append(self.value())


def _literal(text: str) -> Any:
    if text in ("true", "yes", "on"):
        return True
    if text in ("false", "no", "off"):
        return False
    if text == "null":
        return None
    if re.fullmatch(r"-?(0|[1-9]\d*)", text):
        return int(text)
    if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", text):
        return float(text)
    return text


def _merge(into: dict, new: dict) -> dict:
    for k, v in new.items():
        into[k] = _merge(into[k], v) if isinstance(v, dict) and isinstance(into.get(k), dict) else v
    return into


_MISSING = object()


def _resolve(value: Any, root: dict, extra: dict[str, Any], busy: tuple[str, ...] = ()) -> Any:
    if isinstance(value, _Ref):
        if value.path in busy:
            raise HoconError(f"substitution of {value.path} refers to itself")
        at: Any = root
        for k in value.path.split("."):
            at = at.get(k, _MISSING) if isinstance(at, dict) else _MISSING
        if at is _MISSING:
            at = extra.get(value.path, os.environ.get(value.path, _MISSING))
        if at is _MISSING:
            if value.optional:
                return _MISSING
            raise HoconError(f"nothing to substitute for {value.path}")
        return _resolve(at, root, extra, (*busy, value.path))
    if isinstance(value, _Join):
        parts = [x for x in (_resolve(v, root, extra, busy) for v in value) if x is not _MISSING]
        solid = [p for p in parts if not (isinstance(p, str) and p.isspace())]
        if solid and all(isinstance(p, dict) for p in solid):
            out: dict = {}
            for p in solid:
                _merge(out, p)
            return out
        if solid and all(isinstance(p, list) for p in solid):
            return [x for p in solid for x in p]
        return "".join(p if isinstance(p, str) else json.dumps(p) for p in parts)
    if isinstance(value, dict):
        return {k: r for k, v in value.items() if (r := _resolve(v, root, extra, busy)) is not _MISSING}
    if isinstance(value, list):
        return [r for v in value if (r := _resolve(v, root, extra, busy)) is not _MISSING]
    return value


def loads(text: str, variables: dict[str, Any] | None = None, base: Path | None = None) -> dict[str, Any]:
    """HOCON text as plain dicts, lists, strings, numbers, booleans and None."""
    root = _Reader(text, base).root()
    return _resolve(root, root, variables or {})


def load(*paths: str, variables: dict[str, Any] | None = None) -> dict[str, Any]:
    """Several files as one text: later keys override and merge."""
    root: dict = {}
    for p in paths:
        _merge(root, _Reader(Path(p).read_text(), Path(p).parent).root())
    return _resolve(root, root, variables or {})
