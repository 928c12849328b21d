"""Personal data: plain detectors, and the same detectors behind an offset-preserving deobfuscation.

Base detectors look for e-mail addresses, IPv4 addresses, payment cards and telephone numbers in the text as it
is (leftmost, not overlapping, per kind; matches that fail the check of their kind are dropped without retry).
Then a transducer rewrites the text, keeping for each written character the source span that it stands for:
homoglyphs and other scripts' digits become ASCII, invisible characters go, runs of spelled digits become digits,
at and dot disguises (dots also before the at sign) become "@" and ".". The detectors run over the rewritten text, and
what they find is mapped back to source characters. A found span that overlaps a base span of its kind is dropped; base
spans always stay, so disguised dots before a plain address are not added to it.

A bare word "at" counts as a disguise only with a disguised dot after it, or when the name before it holds a digit, a
(disguised) dot or an underscore and a plain domain follows; digit words only in runs of `MIN_RUN` digits or more.

Texts in which no rewriting rule can match are not rewritten; the tests for that follow from the rules.

Defined results: null and empty texts have no spans. Spans are code points of the text, end exclusive; ties do not arise, as
spans of a kind don't overlap. All scans are linear in the text, whatever its length, and the mapping back takes room for
the stretches that changed their length only. Repeated rows are treated alike; an empty table gives an empty table. New
columns of `pii_spans` replace columns of the same name; `redacted_documents` passes columns of any name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import per_text, set_aside, table

KINDS = ("email", "ip", "card", "phone")
MIN_RUN = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Cyrillic, Greek and other letters that look like ASCII ones, and signs used for @ . - + and space.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
    "﹫": "@", "。": ".", "｡": ".", "․": ".", "‧": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "﹢": "+", "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digit words, by value, in the four languages of the corpus.
DIGIT_WORDS = {
    0: "zero null zéro cero", 1: "one eins un uno", 2: "two zwei deux dos", 3: "three drei trois tres", 4: "four vier quatre cuatro",
    5: "five fünf cinq cinco", 6: "six sechs seis", 7: "seven sieben sept siete", 8: "eight acht huit ocho", 9: "nine neun neuf nueve",
}
VALUE = {w: str(d) for d, ws in DIGIT_WORDS.items() for w in ws.split()}


def _folds() -> dict[int, str | None]:
    table_: dict[int, str | None] = {ord(a): b for a, b in HOMOGLYPHS.items()}
    table_ |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in (*range(0x660, 0x1A9A), *range(0x1D7CE, 0x1D800)):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table_[c] = str(d)
    return table_ | dict.fromkeys(map(ord, INVISIBLE))


FOLDS = _folds()
#: Those below 256.
LOW_ODD = [chr(c) for c in FOLDS if c < 256]
GONE = re.compile("[" + "".join(re.escape(c) for c in INVISIBLE) + "]")
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FOLDS)) + "]")
_WORDS = "|".join(sorted(VALUE, key=len, reverse=True))
_STEP = rf"(?:{_WORDS}|[0-9])"
_GAP = r"[\x20\t,-]{0,3}"
#: A run of digits at least one of which is spelled; dots between groups may be spelled too.
SPELLED = re.compile(rf"(?<!\w)(?:plus\s+)?(?:{_WORDS})(?:{_GAP}(?:(?:dot|point|punto|punkt)[\x20\t]+)?{_STEP})+(?!\w)", re.I)
WORD_OR_DIGIT = re.compile(rf"{_WORDS}|[0-9]|dot|point|punto|punkt|plus", re.I)
AT = r"(?:\s{0,3}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,3})"
DOT = r"(?:\s{0,3}[\[({<]\s?(?:dot|\.)\s?[\])}>]\s{0,3})"
LABEL = r"[A-Za-z0-9-]+"
DISGUISED = re.compile(
    rf"(?:(?P<at>{AT})|(?P<bare>\s{{1,3}}at\s{{1,3}}))(?P<host>{LABEL}(?:(?:{DOT}|\s{{1,3}}dot\s{{1,3}}|\.){LABEL})+)"
    rf"|(?P<real>@)(?P<host2>{LABEL}(?:(?:{DOT}|\s{{1,3}}dot\s{{1,3}}|\.){LABEL})+)",
    re.I,
)
DOTS = re.compile(rf"{DOT}|\s{{1,3}}dot\s{{1,3}}", re.I)
#: What a disguised at or dot can look like in lower case, white space made spaces; cheap tests before the rewriting.
MARKS = ("dot", "[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at", "[@", "(@", "{@", "<@", "[.", "(.", "{.", "<.", "[ @", "( @", "{ @", "< @", "[ .", "( .", "{ .", "< .")
#: A disguised dot that ends where the local part so far begins; it has DOT_LENGTH characters at most.
LAST_DOT = re.compile(rf"(?:{DOT}|\s{{1,3}}dot\s{{1,3}})\Z", re.I)
DOT_LENGTH = 14
ENDS = frozenset("])}> \t\n\x0b\f\r")
BARE = re.compile(r" at +[\w-]+\.\w")
BLANK = re.compile(r"[^\S ]")
IP_DOTS = re.compile(rf"(?<=[0-9])(?:{DOT}|\s{{1,3}}dot\s{{1,3}})(?=[0-9])", re.I)

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Every "@" in turn: the local part reaches back to the end of the match before, the domain is matched after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of all kinds in the order of KINDS, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13 or m.end() - m.start() > 37:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Rewritten:
    """A text under rewriting, and where its characters come from.

    The text is a row of stretches: `new` has the place of each in the rewritten text, `old` in the source, and `to` the end
    of the source span if all characters of the stretch stand for one span, or -1 if they stand for one character each.
    """

    def __init__(self, text: str):
        self.text = text
        self.new, self.old, self.to = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1, np.int64)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the characters a to b (past the last)."""
        i, j = (int(k) - 1 for k in np.searchsorted(self.new, (a, b - 1), side="right"))
        start = int(self.old[i]) if self.to[i] >= 0 else int(self.old[i]) + a - int(self.new[i])
        end = int(self.to[j]) if self.to[j] >= 0 else int(self.old[j]) + b - int(self.new[j])
        return start, end

    def apply(self, begins: list[int], ends: list[int], signs: list[str]) -> None:
        """Replace spans, in order, each by a sign or nothing; a sign stands for the whole source span of what it replaces."""
        if not len(begins):
            return
        begins, ends = np.asarray(begins, np.int64), np.asarray(ends, np.int64)
        parts, at = [], 0
        for a, b, sign in zip(begins.tolist(), ends.tolist(), signs):
            parts += (self.text[at:a], sign)
            at = b
        parts.append(self.text[at:])
        sizes = np.fromiter(map(len, signs), np.int64, len(signs))
        shift = np.cumsum(sizes - (ends - begins))
        first = np.searchsorted(self.new, begins, side="right") - 1
        last = np.searchsorted(self.new, ends - 1, side="right") - 1
        start = np.where(self.to[first] >= 0, self.old[first], self.old[first] + begins - self.new[first])
        stop = np.where(self.to[last] >= 0, self.to[last], self.old[last] + ends - self.new[last])
        # Stretches: those that begin outside the edits, each sign, and what goes on behind each edit.
        edit = np.searchsorted(begins, self.new, side="right") - 1
        outside = (edit < 0) | (self.new >= ends[edit])
        moved = self.new + np.where(edit >= 0, shift[edit], 0)
        behind = np.searchsorted(self.new, ends, side="right") - 1
        whole = self.to[behind] >= 0
        some = sizes > 0
        new = np.concatenate([moved[outside], ends + shift, (begins + shift - sizes + ends - begins)[some]])
        old = np.concatenate([self.old[outside], np.where(whole, self.old[behind], self.old[behind] + ends - self.new[behind]), start[some]])
        to = np.concatenate([self.to[outside], np.where(whole, self.to[behind], -1), stop[some]])
        # Of stretches at one place the last one holds, the others are empty; signs come behind what an edit before them left.
        order = np.argsort(new, kind="stable")
        new, old, to = new[order], old[order], to[order]
        keep = np.append(new[1:] != new[:-1], True)
        self.text = "".join(parts)
        self.new, self.old, self.to = new[keep], old[keep], to[keep]

    def fold(self) -> None:
        """Homoglyphs and digits become one character each; invisible characters go."""
        gone = [m.start() for m in GONE.finditer(self.text)]
        self.apply(gone, [a + 1 for a in gone], [""] * len(gone))
        self.text = self.text.translate(FOLDS)

    def spelled(self) -> None:
        begins, ends, written = array("q"), array("q"), []
        for run in SPELLED.finditer(self.text):
            steps = list(WORD_OR_DIGIT.finditer(self.text, run.start(), run.end()))
            signs = ["+" if (w := m[0].lower()) == "plus" else "." if w in ("dot", "point", "punto", "punkt") else VALUE.get(w, w) for m in steps]
            if sum(s.isdigit() for s in signs) < MIN_RUN:
                continue
            for m, sign, after in zip(steps, signs, [*steps[1:], None]):
                begins.append(m.start())
                ends.append(m.end())
                written.append(sign)
                if after is not None and after.start() > m.end():
                    begins.append(m.end())
                    ends.append(after.start())
                    written.append("")
        self.apply(begins, ends, written)

    def dots_before(self, at: int, free: int) -> list[tuple[int, int]]:
        """Disguised dots of a local part, read back from its last plain piece, not beyond free."""
        out: list[tuple[int, int]] = []
        text = self.text
        while at > free and text[at - 1] in ENDS:
            m = LAST_DOT.search(text, max(free, at - DOT_LENGTH), at)
            if m is None:
                break
            start = end = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            # The name is what lies behind the last empty piece.
            start = max(start, text.rfind("..", start, end) + 2 if ".." in text[start:end] else start)
            if start < end and text[start] == ".":
                start += 1
            if start >= end or text[end - 1] == ".":
                break
            out.append((m.start(), m.end()))
            at = start
        return out

    def at_dot(self) -> None:
        edits = [(m.start(), m.end(), ".") for m in IP_DOTS.finditer(self.text)]
        free = 0
        for m in DISGUISED.finditer(self.text):
            host = m["host"] or m["host2"]
            first = m.start("host") if m["host"] else m.start("host2")
            dots = list(DOTS.finditer(host))
            before = m.start()
            # No at sign lies in a name, so this goes back over each host once.
            start = before
            while start and self.text[start - 1] in LOCAL:
                start -= 1
            name = self.text[start:before]
            chain = self.dots_before(start, free) if name else []
            free = m.end()
            if not name or (m["real"] and not dots and not chain):
                continue
            if m["bare"] and not dots and not chain and not re.search(r"[0-9._]", name.strip(".")):
                continue
            if not m["real"]:
                edits.append((m.start(), first, "@"))
            edits += [(a, b, ".") for a, b in chain] + [(first + d.start(), first + d.end(), ".") for d in dots]
        begins, ends, signs, at = array("q"), array("q"), [], 0
        for a, b, sign in sorted(edits):
            if a >= at:
                begins.append(a)
                ends.append(b)
                signs.append(sign)
                at = b
        self.apply(begins, ends, signs)


def has_odd(text: str) -> bool:
    """Some character of FOLDS is in the text; text of Latin-1 alone needs few substring tests."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ODD.search(text) is not None
    return any(c in text for c in LOW_ODD)


def has_marks(low: str) -> bool:
    return any(m in low for m in MARKS) or (" at " in low and BARE.search(low) is not None)


def may_change(text: str) -> bool:
    """False only if no rule can match: no character of FOLDS, no run that SPELLED finds, no form of MARKS or BARE."""
    return has_odd(text) or has_marks(BLANK.sub(" ", text.lower())) or SPELLED.search(text) is not None


def rewritten(text: str) -> Rewritten:
    r = Rewritten(text)
    r.fold()
    r.spelled()
    r.at_dot()
    return r


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that the detectors find only in the rewritten text."""
    if not may_change(text):
        return []
    r = rewritten(text)
    if r.text == text:
        return []
    starts: dict[str, list] = {k: [a for kind, a, _ in base if kind == k] for k in KINDS}
    ends: dict[str, list] = {k: [b for kind, _, b in base if kind == k] for k in KINDS}
    out = []
    for kind, a, b in detect(r.text):
        span = r.span(a, b)
        # Base spans of a kind don't overlap: the first that ends after this one's start decides.
        i = bisect_right(ends[kind], span[0])
        if i == len(starts[kind]) or starts[kind][i] >= span[1]:
            out.append((kind, *span))
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = detect(text)
    more = disguised(text, base)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Replace every span by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a < at:
            at = b
            continue
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """Every row with counts of base spans by kind, base_sha256, spans (all, as text), n_spans (how many) and redacted (the text without them)."""
    fields = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, n_spans long, redacted string"])

    def kernel(texts: list) -> dict:
        out: dict[str, list] = {n: [] for n in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "redacted")}
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace")
            base, spans = find(text)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(spans))
            out["n_spans"].append(len(spans))
            out["redacted"].append(None if raw is None else redact(text, spans) if spans else text)
        return out

    return per_text(docs, "text", kernel, fields)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, where there is one, of the new text; a null text stays null."""
    renamed, restored = set_aside(docs, ("text", "n_chars"))
    got = pii_spans(renamed).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("redacted").cast("long"))
    return restored(got)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_spans(docs).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans")
