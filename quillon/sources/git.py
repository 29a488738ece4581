"""Markdown files of a git repository: a shallow clone first, later the names that changed."""

from __future__ import annotations

import os
import subprocess
from urllib.parse import quote, urlsplit, urlunsplit


def with_token(url: str, token: str) -> str:
    """The URL with a token as its user; other than http URLs and empty tokens change nothing."""
    parts = urlsplit(url)
    if not token or parts.scheme not in ("http", "https"):
        return url
    return urlunsplit(parts._replace(netloc=f"{quote(token, safe='')}@{parts.netloc.rpartition('@')[2]}"))


def _git(*arguments: str, at: str | None = None) -> str:
    return subprocess.run(["git", *arguments], cwd=at, check=True, capture_output=True, text=True).stdout


def sync(url: str, folder: str, token: str = "") -> list[str]:
    """Paths of Markdown files that are new or changed: all of a new clone, else those that differ from the last head."""
    source = with_token(url, token)
    if not os.path.isdir(os.path.join(folder, ".git")):
        _git("clone", "--depth", "1", source, folder)
        names = _git("ls-files", "-z", at=folder).split("\0")
    else:
        before = _git("rev-parse", "HEAD", at=folder).strip()
        _git("fetch", "--depth", "1", source, "HEAD", at=folder)
        _git("reset", "--hard", "FETCH_HEAD", at=folder)
        names = _git("diff", "--name-only", "-z", before, "HEAD", at=folder).split("\0")
    return sorted(n for n in names if n.lower().endswith(".md"))
