"""Which folders may be scanned, and where results may be written."""

from __future__ import annotations

import os

# Roots and folders below a home that are never scanned.
SYSTEM = ["/etc", "/proc", "/sys", "/dev"]
PRIVATE = [".ssh", ".gnupg", ".aws", ".config/gcloud"]
#: A list of folders, as in PATH: if it is set, scans have to lie at or below one of them.
ALLOWED = "LATTICE_ALLOWED_DIRS"


def inside(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def allowed_dirs() -> list[str] | None:
    """None if there is no list; a list of which nothing can be used allows nothing."""
    raw = os.environ.get(ALLOWED, "")
    return [os.path.realpath(x.strip()) for x in raw.split(os.pathsep) if x.strip()] if raw.strip() else None


def scan_path(path: str) -> str:
    """The absolute path, if it may be scanned. Both the path as written and what its links lead to have to be allowed."""
    if not path:
        raise ValueError("path is required")
    whole = os.path.abspath(path)
    real = os.path.realpath(whole)
    home = os.path.expanduser("~")
    for own in (whole, real):
        for bad in SYSTEM + [os.path.join(home, x) for x in PRIVATE]:
            if inside(own, bad):
                raise PermissionError(f"{bad} may not be scanned")
        if any(f"/{x}/" in f"{own}/" for x in PRIVATE):
            raise PermissionError(f"{own} holds credentials and may not be scanned")
    if not os.path.isdir(whole):
        raise NotADirectoryError(path)
    folders = allowed_dirs()
    if folders is not None and not any(inside(real, f) for f in folders):
        raise PermissionError(f"{path} lies outside of {ALLOWED}")
    return whole


def output_path(file: str, root: str) -> str:
    """The absolute path, if it lies below root even when links are followed; the nearest folder that exists decides."""
    whole, top = os.path.abspath(file), os.path.realpath(root)
    if os.path.isdir(whole):
        raise IsADirectoryError(file)
    below = whole
    while not os.path.exists(below):
        below = os.path.dirname(below)
    if not inside(os.path.normpath(os.path.realpath(below) + whole[len(below):]), top):
        raise PermissionError(f"{file} lies outside of {root}")
    return whole
