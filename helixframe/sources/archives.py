"""Packed and plain files: unpack by suffix, copy, concatenate."""

from __future__ import annotations

import gzip
import shutil
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO


@contextmanager
def opened(path: str) -> Iterator[Iterator[BinaryIO]]:
    """The members of an archive as streams, in archive order; a .gz file has one."""
    if path.endswith(".tar.gz"):
        with tarfile.open(path, "r:gz") as t:
            yield (t.extractfile(m) for m in t if m.isfile())
    elif path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            yield (z.open(m) for m in z.namelist() if not m.endswith("/"))
    elif path.endswith(".gz"):
        with gzip.open(path) as g:
            yield iter((g,))
    else:
        raise TypeError(f"can't tell how to unpack {path!r}")


def unpack(path: str, to: str) -> None:
    """All members of an archive, one after another, as one file."""
    with opened(path) as members, open(to, "wb") as out:
        for m in members:
            shutil.copyfileobj(m, out)


def concatenate(paths: Iterable[str], to: str) -> None:
    with open(to, "wb") as out:
        for path in paths:
            with open(path, "rb") as f:
                shutil.copyfileobj(f, out)
