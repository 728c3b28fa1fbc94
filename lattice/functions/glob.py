"""Path globs as anchored regular expressions."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """Without a slash the pattern fits the last segment; ** fits any number of segments; a broken one fits nothing."""
    try:
        if "/" not in glob:
            return f"(^|/){_segment(glob)}$"
        out = []
        for k, part in enumerate(glob.split("/")):
            last = k == glob.count("/")
            out.append(("(.*)" if last else "(?:.*/)?") if part == "**" else _segment(part) + ("" if last else "/"))
        return "^" + "".join(out) + "$"
    except ValueError:
        return "(?!)"


def _segment(part: str) -> str:
    out, k = "", 0
    while k < len(part):
        c = part[k]
        k += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = part.find("]", k + 1)
            if end < 0:
                raise ValueError(part)
            inside = part[k:end].replace("\\", "\\\\")
            out += f"[{inside}]"
            k = end + 1
        elif c == "\\":
            if k == len(part):
                raise ValueError(part)
            out += re.escape(part[k])
            k += 1
        else:
            out += re.escape(c)
    return out
