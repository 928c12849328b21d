"""Errors that users can act on; format errors carry the line."""

from __future__ import annotations


class HelixError(Exception):
    """Base of all errors of this package."""


class InvalidCatalogError(HelixError):
    def __init__(self, path: str):
        super().__init__(f"catalog {path!r} can't be parsed")


class UnknownAssemblyError(HelixError):
    """No genome assembly of this name is installed."""

    def __init__(self, name: str):
        super().__init__(f"no genome assembly {name!r} is installed")


class MissingGenomeFileError(HelixError):
    def __init__(self, name: str, which: str):
        super().__init__(f"assembly {name!r} has no {which} file")


class UnknownRemoteAssemblyError(HelixError):
    def __init__(self, source: str, name: str):
        super().__init__(f"{source} lists no assembly {name!r}")


class MissingRemoteFileError(HelixError):
    def __init__(self, source: str, name: str, which: str):
        super().__init__(f"{source} has no {which} file for {name!r}")


class UnknownRemoteMotifsError(HelixError):
    def __init__(self, source: str, name: str):
        super().__init__(f"{source} has no motif set {name!r}")


class UnknownMotifSetError(HelixError):
    def __init__(self, name: str):
        super().__init__(f"no motif set {name!r} is installed")


class MissingPfmsError(HelixError):
    def __init__(self, name: str):
        super().__init__(f"motif set {name!r} has no frequency matrices")


class MissingPwmsError(HelixError):
    def __init__(self, name: str, genome: str):
        super().__init__(f"motif set {name!r} is not built for {genome!r}")


class FormatError(HelixError):
    """A line of an input file breaks its format."""

    kind = "input"

    def __init__(self, line_number: int, line: str, kind: str | None = None):
        self.line_number, self.line = line_number, line
        super().__init__(f"line {line_number} is not valid {kind or self.kind}: {line!r}")


class BackgroundFormatError(FormatError):
    kind = "background frequency"


class PfmFormatError(FormatError):
    kind = "frequency matrix text"


class PwmFormatError(FormatError):
    kind = "weight matrix text"


class RegionFormatError(FormatError):
    def __init__(self, line_number: int, line: str, region_format: str):
        self.region_format = region_format
        super().__init__(line_number, line, region_format)
