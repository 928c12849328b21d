"""Readers and writers of motif files. They are small: text is read whole and parsed on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from helixframe.errors import PfmFormatError, PwmFormatError
from helixframe.functions.matrix import Pfm, Pwm
from helixframe.schemas import BASES


def numbered(lines: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Stripped lines with their numbers; blank lines are skipped."""
    for n, line in enumerate(lines, 1):
        if line := line.strip():
            yield n, line


def _block(lines: Iterator[tuple[int, str]], end: int, error: type) -> Iterator[tuple[str, int, str]]:
    """The four lines after a header, each with its base."""
    for base in BASES:
        found = next(lines, None)
        if found is None:
            raise error(end, "")
        yield base, *found


def parse_pfms(text: str) -> list[Pfm]:
    """Motifs of a JASPAR text: a header `>id name`, then rows A, C, G, T, bracketed and labelled or bare."""
    source = text.splitlines()
    lines, found = numbered(source), []
    for n, line in lines:
        header = re.match(r">\s*(\S+)(?:\s+(\S+))?", line)
        if header is None:
            raise PfmFormatError(n, line)
        rows = []
        for base, k, row in _block(lines, len(source) + 1, PfmFormatError):
            if re.match(r">\s*\S", row):
                raise PfmFormatError(k, row)
            labelled = re.match(r"([ACGT])\s*\[\s*(.+)\s*\]", row)
            if labelled and labelled[1] != base:
                raise PfmFormatError(k, row)
            try:
                rows.append([int(v) for v in (labelled[2] if labelled else row).split()])
            except ValueError:
                raise PfmFormatError(k, row) from None
        found.append(Pfm(rows, header[1], header[2]))
    return found


def parse_pwms(text: str) -> list[Pwm]:
    """Motifs of a weight text: header `>id<TAB>name<TAB>PWM`, four rows, one cutoff line or more."""
    source = text.splitlines()
    lines, found = numbered(source), []
    current: Pwm | None = None
    for n, line in lines:
        cutoff = re.match(r"Cutoff_p(\S+)\t(\S+)", line)
        if cutoff and current is not None:
            try:
                current.cutoffs[cutoff[1]] = float(cutoff[2])
            except ValueError:
                raise PwmFormatError(n, line) from None
            continue
        header = re.fullmatch(r">(\S+)\t(\S+)\tPWM", line)
        if header is None or (current is not None and not current.cutoffs):
            raise PwmFormatError(n, line)
        rows = []
        for base, k, row in _block(lines, len(source) + 1, PwmFormatError):
            matched = re.fullmatch(r"([ACGT]) \[(.+)\]", row)
            if matched is None or matched[1] != base:
                raise PwmFormatError(k, row)
            try:
                rows.append([float(v) for v in matched[2].split()])
            except ValueError:
                raise PwmFormatError(k, row) from None
        current = Pwm(rows, header[1], header[2])
        found.append(current)
    if current is not None and not current.cutoffs:
        raise PwmFormatError(len(source) + 1, "")
    return found


def pwm_text(pwms: Iterable[Pwm]) -> str:
    out = []
    for m in pwms:
        out.append(f">{m.matrix_id}\t{m.name}\tPWM")
        out += [f"{b} [" + "\t".join(f"{v:8.5f}" for v in row) + "]" for b, row in zip(BASES, m.values)]
        out += [f"Cutoff_p{p}\t{v}" for p, v in m.cutoffs.items()]
    return "".join(line + "\n" for line in out)


def read_pfms(*paths: str, format: str = "jaspar") -> list[Pfm]:
    """Motifs of several files, one after another."""
    if format != "jaspar":
        raise ValueError(f"frequency matrices can't be read as {format!r}")
    found: list[Pfm] = []
    for path in paths:
        with open(path) as f:
            found += parse_pfms(f.read())
    return found


def read_pwms(path: str) -> list[Pwm]:
    with open(path) as f:
        return parse_pwms(f.read())


def write_pwms(path: str, pwms: Iterable[Pwm]) -> None:
    with open(path, "w") as f:
        f.write(pwm_text(pwms))
