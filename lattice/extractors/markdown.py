"""Notes and the links between them."""

from __future__ import annotations

import os
import re

from lattice.extractors.base import Extractor, Found, register

# What the two kinds of links look like; a link may carry a quoted title.
WIKI = re.compile(r"\[\[([^\[\]\n]+)\]\]")
LINK = re.compile(r'\[([^\]\n]*)\]\(([^\s)]+)(?:\s+"[^"]*")?\)')
FENCE = re.compile(r"[ \t]*(`{3}|~{3})")
RUNS = re.compile("`+")


def without_code(text: str) -> str:
    """Fenced lines emptied, then code spans blanked. A fence ends at its own sign; a span at a run of equal length."""
    lines, fence = [], ""
    for line in text.split("\n"):
        m = FENCE.match(line)
        if fence:
            fence = "" if m and m[1] == fence else fence
            lines.append("")
        elif m:
            fence = m[1]
            lines.append("")
        else:
            lines.append(line)
    text = "\n".join(lines)
    runs = [(m.start(), m.end()) for m in RUNS.finditer(text)]
    nearest: dict[int, int] = {}  # length of a run: the next run of that length
    closing = [0] * len(runs)
    for k in range(len(runs) - 1, -1, -1):
        length = runs[k][1] - runs[k][0]
        closing[k] = nearest.get(length, -1)
        nearest[length] = k
    out, at, k = [], 0, 0
    while k < len(runs):
        if closing[k] < 0:
            k += 1
            continue
        start, end = runs[k][0], runs[closing[k]][1]
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
        at, k = end, closing[k] + 1
    return "".join(out) + text[at:]


def wiki_target(inside: str) -> tuple[str, str]:
    """Target and shown text of [[target#section|shown]]."""
    target, _, shown = inside.partition("|")
    target = target.split("#")[0].strip()
    return target, shown.strip() or target


def note_target(link: str) -> str:
    """The stem that a relative link to a markdown file names, else nothing."""
    if "://" in link or link.startswith(("#", "mailto:", "tel:")):
        return ""
    stem, ext = os.path.splitext(os.path.basename(re.split("[#?]", link)[0]))
    return stem.strip() if ext.lower() in (".md", ".markdown") else ""


def note_id(found: Found) -> str:
    return f"note:{os.path.basename(os.path.dirname(found.path))}/{found.stem}"


def stub(found: Found, properties: dict) -> None:
    found.node(note_id(found), found.stem, "note", "markdown", found.path, **properties)


def read(found: Found, text: str) -> None:
    stub(found, {})
    text, seen = without_code(text), set()
    for m in WIKI.finditer(text):
        target, shown = wiki_target(m[1].strip())
        if target and target not in seen:
            seen.add(target)
            found.edge(note_id(found), f"wikilink:{target}", "dependency", shown, 0.9)
    seen = set()
    for m in LINK.finditer(text):
        target = note_target(m[2].strip())
        if target and target not in seen:
            seen.add(target)
            found.edge(note_id(found), f"wikilink:{target}", "dependency", m[1].strip(), 0.85)


EXTRACTOR = register(Extractor("markdown", (".md", ".markdown"), read, stub))
