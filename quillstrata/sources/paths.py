"""Where raw files of a manifest lie: resolution beside the manifest, and paths that stay inside a project."""

from __future__ import annotations

from pathlib import Path


def resolve_raw(local_path: str, manifest: str, root: str) -> Path:
    """An absolute path as it is; else below root or beside the manifest, whichever exists first; else below root."""
    given = Path(local_path)
    if given.is_absolute():
        return given
    places = [Path(root) / given, Path(manifest).parent / given]
    return next((p for p in places if p.exists()), places[0]).resolve()


def inside(path: str, root: str) -> str:
    """path as written in a manifest, relative to root; one that leaves root is an error."""
    whole = Path(path).resolve()
    if not whole.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} lies outside {root}")
    return whole.relative_to(Path(root).resolve()).as_posix()


def shown(path: str, root: str) -> str:
    """Relative to root where path lies in it, else absolute."""
    try:
        return inside(path, root)
    except ValueError:
        return Path(path).resolve().as_posix()
