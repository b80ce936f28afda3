"""Masked source and nesting: comments and strings blanked, offsets kept."""

from __future__ import annotations

import re
from bisect import bisect_right

_COMMENTS = {"//": r"//[^\n]*", "/*": r"/\*.*?(?:\*/|\Z)", "#": r"\#(?!\[)[^\n]*"}
_STRINGS = {'"': r'"(?:\\.|[^"\\\n])*(?:"|$)', "'": r"'(?:\\.|[^'\\\n])*(?:'|$)", "`": r"`(?:\\.|[^`\\])*(?:`|\Z)", "'c": r"'(?:\\.|[^'\\\n])'"}
# Words that open a level of control flow.
CONTROL = re.compile(r"\b(?:if|else|for|foreach|while|do|switch|try|catch|match|loop|select)\b")


def mask(source: str, marks: tuple[str, ...]) -> str:
    """The source with comments and strings of the given marks as spaces, line feeds kept."""
    parts = [(_COMMENTS | _STRINGS)[m] for m in marks]
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S | re.M)


class Layout:
    """Line numbers, brace depths and blocks of a masked source."""

    def __init__(self, masked: str):
        self.masked = masked
        self.lines = [0, *[m.end() for m in re.finditer("\n", masked)]]
        self.braces = [m.start() for m in re.finditer(r"[{}]", masked)]
        self.depths, self.close, open_at, depth = [], {}, [], 0
        for at in self.braces:
            if masked[at] == "{":
                open_at.append(at)
                depth += 1
            else:
                depth = max(depth - 1, 0)
                if open_at:
                    self.close[open_at.pop()] = at
            self.depths.append(depth)
        self.balanced = not open_at and masked.count("{") == masked.count("}")

    def line(self, at: int) -> int:
        """Line of an offset, from 1."""
        return bisect_right(self.lines, at)

    def depth(self, at: int) -> int:
        """Braces open before an offset."""
        i = bisect_right(self.braces, at - 1)
        return self.depths[i - 1] if i else 0

    def block(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """The first brace pair after an offset, unless a stop character comes first."""
        found = re.compile(rf"[{{{stop}]").search(self.masked, at)
        if found is None or found[0] != "{":
            return None
        return found.start(), self.close.get(found.start(), len(self.masked) - 1)

    def nesting(self, start: int, end: int) -> int:
        """Deepest control flow in a block: 1, and one more for each level inside."""
        deepest, levels = 1, []
        body = self.masked[start:end]
        for m in re.finditer(r"[{}]", body):
            if m[0] == "{":
                head = re.split(r"[;{}]", body[: m.start()])[-1]
                levels.append(bool(m.start()) and bool(CONTROL.search(head)))
                deepest = max(deepest, 1 + sum(levels))
            elif levels:
                levels.pop()
        return deepest
