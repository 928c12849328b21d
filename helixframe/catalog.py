"""Where genomes and motif sets live: an INI file with one section each, names case-insensitive."""

from __future__ import annotations

import os
from configparser import ConfigParser, Error
from dataclasses import dataclass

from helixframe.errors import InvalidCatalogError, UnknownAssemblyError, UnknownMotifSetError

HOME = os.path.join(os.path.expanduser("~"), ".helixframe")
DEFAULT = os.path.join(HOME, "catalog.ini")
_MISSING = {"genome": UnknownAssemblyError, "motif": UnknownMotifSetError}


@dataclass
class Section:
    """The entries of one kind: name -> path."""

    parser: ConfigParser
    kind: str

    def names(self) -> list[tuple[str, str]]:
        return list(self.parser.items(self.kind))

    def __contains__(self, name: str) -> bool:
        return self.parser.has_option(self.kind, name)

    def __getitem__(self, name: str) -> str:
        if name not in self:
            raise _MISSING[self.kind](name)
        return self.parser.get(self.kind, name)

    def __setitem__(self, name: str, path: str) -> None:
        self.parser.set(self.kind, name, path)

    def __delitem__(self, name: str) -> None:
        self[name]
        self.parser.remove_option(self.kind, name)

    @property
    def root(self) -> str:
        """Folder for entries that are installed without one of their own."""
        return self.parser.get("helixframe", f"{self.kind}_dir", fallback=os.path.join(HOME, f"{self.kind}s"))

    @root.setter
    def root(self, path: str) -> None:
        self.parser.set("helixframe", f"{self.kind}_dir", path)


class Catalog:
    def __init__(self, path: str | None = None):
        self.path = path or DEFAULT
        self.parser = ConfigParser(interpolation=None)
        try:
            self.parser.read(self.path)
        except Error as e:
            raise InvalidCatalogError(self.path) from e
        for section in ("helixframe", "genome", "motif"):
            if not self.parser.has_section(section):
                self.parser.add_section(section)
        self.genomes, self.motifs = Section(self.parser, "genome"), Section(self.parser, "motif")

    def save(self, path: str | None = None) -> None:
        path = path or self.path
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w") as f:
            self.parser.write(f)
