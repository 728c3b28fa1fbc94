"""Redaction of secrets in text, line by line, as chains of built-in replacements.

What a replacement has to decide by more than its pattern is marked first and then decided by further patterns. The marks
are code points that are no characters (U+FDD0 to U+FDD3); a text that holds them all the same loses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
OPEN, KEPT, VALUE, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
# Shapes of well-known tokens, of bearer tokens, names of credentials, and values that are none.
TOKENS = [r"\bsk-[A-Za-z0-9_-]{16,}", r"\bghp_[A-Za-z0-9]{16,}", r"\bgho_[A-Za-z0-9]{16,}", r"\bgithub_pat_[A-Za-z0-9_]{20,}", r"\bxox[bp]-[A-Za-z0-9-]{10,}", r"\bAKIA[0-9A-Z]{16}\b"]
BEARER = r"(?i)\b(bearer[^\S\n]+)[A-Za-z0-9._~+/=-]{16,}"
NAMES = "api[_-]?key|apikey|secret|token|password|passwd|credential|auth"
PLAIN = ["nil", "null", "none", "true", "false", "bearer", "basic"]

_KEY = rf"""[\w.-]*(?:{NAMES})[\w-]*["']?[^\S\n]*[:=]+[^\S\n]*"""
_QUOTED = r"""\"(?:[^\"\\\n]|\\.)*\"|'[^'\\\n]*'|`[^`\n]*`""".replace('\\"', '"')
_BARE = r"""[^"'`\s,;)}\]]+"""
_INSIDE, _TO_VALUE = f"[^{CLOSE}]*", f"[^{VALUE}]*"


def steps() -> list[tuple[str, str]]:
    """Pattern and replacement, in order; $1 stands for a group."""
    done = f"$1{REDACTED}"
    out = [(f"[{OPEN}-{CLOSE}]", ""), (BEARER, done)]
    # A credential's name with a value: names with author aren't meant, but those with authoriz are.
    out.append((f"(?i)({_KEY})({_QUOTED}|{_BARE})", f"{OPEN}$1{VALUE}$2{CLOSE}"))
    out.append((f"(?i){OPEN}({_TO_VALUE}authoriz{_TO_VALUE}){VALUE}", f"{KEPT}$1{VALUE}"))
    out.append((f"(?i){OPEN}({_TO_VALUE}author{_TO_VALUE}){VALUE}({_INSIDE}){CLOSE}", "$1$2"))
    out.append((KEPT, OPEN))
    for quote in ('"', "'", "`"):
        out.append((f"{OPEN}({_TO_VALUE}){VALUE}{quote}{_INSIDE}{CLOSE}", f"$1{quote}{REDACTED}{quote}"))
    # Bare values that are calls or plain words stay.
    out.append((rf"{OPEN}({_TO_VALUE}){VALUE}([^({CLOSE}]*\({_INSIDE}){CLOSE}", "$1$2"))
    out.append((rf"(?i){OPEN}({_TO_VALUE}){VALUE}({'|'.join(PLAIN)}|\[redacted){CLOSE}", "$1$2"))
    out.append((f"{OPEN}({_TO_VALUE}){VALUE}{_INSIDE}{CLOSE}", done))
    out += [(shape, REDACTED) for shape in TOKENS]
    # Long quoted literals in an assignment, if they hold a letter and a digit.
    for quote in ('"', "'", "`"):
        out.append((rf"([:=][^\S\n]*){quote}([A-Za-z0-9+/=_-]{{32,}}){quote}", f"$1{quote}{OPEN}$2{CLOSE}{quote}"))
    out.append((f"{OPEN}([^0-9{CLOSE}]*){CLOSE}", "$1"))
    out.append((f"{OPEN}([^A-Za-z{CLOSE}]*){CLOSE}", "$1"))
    out.append((f"{OPEN}{_INSIDE}{CLOSE}", REDACTED))
    return out


def mask_secrets(text: Column) -> Column:
    """Bearer tokens, values of credential names, well-known shapes, long literals, in this order."""
    for pattern, by in steps():
        text = F.regexp_replace(text, pattern, by)
    return text


def masked_sql(column: str) -> str:
    """The same chain in SQL."""
    quoted = lambda x: x.replace("'", "''")
    for pattern, by in steps():
        column = f"regexp_replace({column}, '{quoted(pattern)}', '{quoted(by).replace('$', chr(92))}', 'g')"
    return column
