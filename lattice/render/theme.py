"""A diagram's colours from two: background and foreground."""

from __future__ import annotations

import re

# How far each of Mermaid's variables lies from the background towards the foreground.
SHARES = {"primaryColor": 0.03, "primaryTextColor": 1.0, "primaryBorderColor": 0.30, "lineColor": 0.30, "secondaryColor": 0.06, "tertiaryColor": 0.02,
          "mainBkg": 0.03, "nodeBorder": 0.30, "clusterBkg": 0.02, "titleColor": 1.0}


def parse(color: str) -> tuple[int, int, int] | None:
    digits = color.removeprefix("#")
    if not re.fullmatch("[0-9a-fA-F]{3}|[0-9a-fA-F]{6}", digits):
        return None
    if len(digits) == 3:
        digits = "".join(c * 2 for c in digits)
    return tuple(bytes.fromhex(digits))


def between(a: tuple, b: tuple, share: float) -> str:
    return "#" + "".join(f"{int(x + share * (y - x)):02x}" for x, y in zip(a, b))


def mermaid_init(colors: tuple[str, str]) -> list[str]:
    """The directive that sets the colours, if both are there."""
    back, front = map(parse, colors)
    if back is None or front is None:
        return []
    variables = ", ".join(f"'{k}': '{colors[1] if share == 1 else between(back, front, share)}'" for k, share in SHARES.items())
    return [f"%%{{init: {{'theme': 'base', 'themeVariables': {{{variables}}}}}}}%%"]
