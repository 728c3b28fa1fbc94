"""Fast splitting of texts whose characters lie below U+0250, where the classes of letters and numbers are few ranges.

The regex module decides all other texts. Both give the same matches: below U+0250, a letter is A-Z, a-z, U+00AA,
U+00B5, U+00BA or any of U+00C0 to U+024F but the two signs, and a number is 0-9 or one of six superscripts and
fractions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: The letters, numbers and white space below U+0250, and all white space of Unicode.
LETTER = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-ɏ"
NUMBER = r"0-9\xB2\xB3\xB9\xBC-\xBE"
NARROW_SPACE = r"\x09-\x0D\x20\x85\xA0"
SPACE = NARROW_SPACE + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
WIDE = re.compile("[ɐ-\U0010ffff]")


def spelled(pattern: str, space: str) -> str:
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern built of \\p{L}, \\p{N}, \\s and \\S."""
    wide = regex.compile(spelled(pattern, SPACE)).findall
    narrow = spelled(pattern, NARROW_SPACE).replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    head, *inside = re.split(r"(\[[^\]]*\\p[^\]]*\])", narrow)  # classes that hold the properties among others
    narrow = "".join(x.replace(r"\p{L}", LETTER).replace(r"\p{N}", NUMBER) if x.startswith("[") else x.replace(r"\p{L}", f"[{LETTER}]").replace(r"\p{N}", f"[{NUMBER}]") for x in [head, *inside])
    fast = re.compile(narrow).findall
    return lambda text: fast(text) if text.isascii() or not WIDE.search(text) else wide(text)
