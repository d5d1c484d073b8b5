"""Files on any storage that pyarrow knows (local paths and URIs), read by byte ranges."""

from __future__ import annotations

import fnmatch
import glob
import os
from collections.abc import Iterator, Sequence

from pyarrow import fs

#: Bytes that are fetched at once where the length of what is read isn't known yet, and a gap that is read along rather than asked around.
AHEAD, GAP = 1 << 16, 1 << 12


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:/")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The storage of a path or URI and the path on it."""
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        path = "/" + path.lstrip("/")
    if is_uri(path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def expand(paths: str | Sequence[str]) -> list[str]:
    """Paths, URIs and glob patterns (in a URI for the last part only) as files, those of a pattern in name order."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        if not glob.has_magic(p):
            out.append(p)
        elif is_uri(p):
            folder, pattern = p.rsplit("/", 1)
            store, inner = located(folder)
            out += sorted(f"{folder}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if fnmatch.fnmatchcase(x.base_name, pattern))
        else:
            out += sorted(glob.glob(p))
    return out


class Ranged:
    """A file for readers that seek; ``requests`` counts the ranges that were fetched."""

    def __init__(self, path: str, ahead: int = AHEAD):
        store, inner = located(path)
        self.file = store.open_input_file(inner)
        self.size, self.ahead, self.at, self.requests = self.file.size(), ahead, 0, 0
        self.start, self.held = 0, b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        n = max(0, min(n, self.size - self.at))
        if not self.start <= self.at <= self.at + n <= self.start + len(self.held):
            self.start, self.held = self.at, self.file.read_at(min(max(n, self.ahead), self.size - self.at), self.at)
            self.requests += 1
        lo = self.at - self.start
        self.at += n
        return self.held[lo : lo + n]


def merged(spans: list[tuple[int, int]], gap: int = GAP) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, numbers) of ranges that take in the spans (start, bytes), which neighbours and near ones share."""
    start, end, held = 0, -1, []
    for i in sorted(range(len(spans)), key=lambda i: spans[i]):
        at, n = spans[i]
        if held and at <= end + gap:
            end = max(end, at + n)
        else:
            if held:
                yield start, end, held
            start, end, held = at, at + n, []
        held.append(i)
    if held:
        yield start, end, held
