"""Personal data in whole texts, disguised or not, at offsets of the source.

A chain of transducers rewrites a text step by step; each keeps the way back from its output to its input:

    lookalikes  full-width, mathematical and other compatibility forms, digits of any script, dashes,
                spaces and Cyrillic or Greek twins of Latin letters become ASCII, one for one
    invisible   zero-width and other format characters (of the basic plane) go
    at and dot  ``(at)``, ``[dot]``, ``name at host dot com``, ``name @ host . com`` become ``@`` and ``.``
    digits      runs of spelled digits (``double``, ``plus`` and ``dot`` among them) become digits

The same detectors read the source (base spans) and, where a transducer changed something, its output;
spans found there go back to source characters.  Every scan is linear in the text.  Spark only maps
over rows here: nothing is shuffled, and no row needs another.

Defined cases: a null or empty text has no spans; bytes that are no UTF-8 count as one U+FFFD each
(as Python's ``replace`` does); rows that share an id or a text are treated alike; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.llm.texts import map_texts

KINDS = ("email", "ip", "card", "phone")

# Twins of Latin letters and of signs (source characters above, ASCII below).
TWINS = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρα。｡٠۰＋٭",
    "ABESIJKMHOPCTYXaesijopcyxdqwhlABEZHIKMNOPTYXovipa..00+*",
)
# Words for a sign, per language; last labels that end a host given in bare words.
AT_WORDS = "at|arroba"
DOT_WORDS = "dot|punto|punkt"
BRACKETED_DOT_WORDS = DOT_WORDS + "|point"
LAST_LABELS = frozenset("com org net edu gov info biz io ai co dev app me uk de fr es it eu us ca ch at nl be".split())
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}
TIMES = {"double": 2, "triple": 3}
#: Spelled digits a run must have to be rewritten.
LEAST_SPELLED = 4

# ------------------------------------------------------------------ detectors (plain ASCII patterns)
_LOCAL = "A-Za-z0-9._%+-"
_AROUND_AT = re.compile(rf"[@{_LOCAL}]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    if "@" not in text:
        return
    for chunk in _AROUND_AT.finditer(text):
        begin, end = chunk.span()
        at = text.find("@", begin, end)
        while at >= 0:
            host = _HOST.match(text, at + 1, end) if at > begin else None
            if host:
                yield begin, host.end()
                begin = host.end()
            else:
                begin = at + 1
            at = text.find("@", begin, end)


def _ips(text: str):
    for m in _NUMBERS.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        places = []
        for p in parts:
            places.append((at, at + len(p)))
            at += len(p) + 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[i : i + 4]):
                yield places[i][0], places[i + 3][1]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


DETECTORS = dict(zip(KINDS, (_emails, _ips, _cards, _phones)))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the plain identifiers, by start and kind."""
    return sorted((s, k, e) for k, name in enumerate(KINDS) for s, e in DETECTORS[name](text))


# ------------------------------------------------------------------ transducers
class Rewritten:
    """Output of a transducer: the text after ``edits`` (start, end, new text), and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        pieces, done, size = [], 0, 0
        self._at, self._edits = [], edits
        for start, end, new in edits:
            pieces += (text[done:start], new)
            size += start - done
            self._at.append(size)
            size += len(new)
            done = end
        self.text = "".join([*pieces, text[done:]])

    def _char(self, i: int) -> tuple[int, int]:
        """Source characters (start, end) behind character ``i`` of the output."""
        k = bisect_right(self._at, i) - 1
        if k < 0:
            return i, i + 1
        start, end, new = self._edits[k]
        past = i - self._at[k] - len(new)
        return (start, end) if past < 0 else (end + past, end + past + 1)

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._char(start)[0], self._char(end - 1)[1]


@lru_cache(maxsize=1)
def _characters() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """One-for-one fold, the characters it changes, the characters that are dropped."""
    fold, gone = dict(TWINS), []
    for code in range(0x80, 0x1FC00):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F:
            if code < 0x10000:
                gone.append(c)
            continue
        plain = unicodedata.normalize("NFKC", c)
        if kind == "Nd":
            plain = str(unicodedata.decimal(c))
        elif kind == "Pd":
            plain = "-"
        elif kind == "Zs":
            plain = " "
        if len(plain) == 1 and " " <= plain <= "~":
            fold.setdefault(code, plain)
    fold = {k: chr(v) if isinstance(v, int) else v for k, v in fold.items()}
    # classes of the basic plane compile to tables; beyond it any character calls for the fold
    near = "".join(chr(c) for c in sorted(fold) if c < 0x10000)
    return fold, re.compile(f"[{near}]|[\U00010000-\U0001FFFF]"), re.compile("[" + "".join(gone) + "]")


def drop_invisible(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "") for m in _characters()[2].finditer(text)]


_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_AT = re.compile(
    rf" {{0,3}}{_OPEN} ?(?:{AT_WORDS}|@) ?{_CLOSE} {{0,3}}| {{1,3}}(?:{AT_WORDS}) {{1,3}}| {{1,3}}@ {{1,3}}|@", re.I
)
_SOFT_DOT = rf"(?P<hard>\.(?! )| {{0,3}}{_OPEN} ?(?:{BRACKETED_DOT_WORDS}|\.) ?{_CLOSE} {{0,3}})| {{1,3}}(?:{DOT_WORDS}) {{1,3}}| {{1,3}}\. {{1,3}}"
_DOT = re.compile(_SOFT_DOT, re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_BEFORE = re.compile(
    rf"[{_LOCAL}]+(?:(?: {{1,3}}(?:{DOT_WORDS}) {{1,3}}| {{0,3}}{_OPEN} ?(?:{BRACKETED_DOT_WORDS}) ?{_CLOSE} {{0,3}})[{_LOCAL}]+)*$",
    re.I,
)
#: Characters before an at sign that are searched for dots in words; a plain local part may be longer.
BEFORE = 128


def undisguise_signs(text: str) -> list[tuple[int, int, str]]:
    """Edits that give ``@`` and ``.`` back to addresses.

    Prose has "at" and "dot" too: bare words and spaced signs need a host that ends in a usual last label,
    and a bare "at" also a dot in words or a name with a digit or sign in it.  Signs in brackets need neither.
    """
    edits: list[tuple[int, int, str]] = []
    for at in _AT.finditer(text):
        start, end = at.span()
        sign = at.group().strip(" ")
        if not start or (edits and start < edits[-1][1]) or text[start - 1] not in _LOCAL_SET:
            continue
        bare = sign != "@" and sign[0] not in "([{<" or sign == "@" and len(at.group()) > 1
        label = _LABEL.match(text, end)
        found, dots, soft = None, [], bare
        while label:
            if dots and (not soft or label.group().lower() in LAST_LABELS):
                found = len(dots)
            dot = _DOT.match(text, label.end())
            if not dot:
                break
            soft = soft or dot.group("hard") is None
            dots.append(dot.span())
            label = _LABEL.match(text, dot.end())
        if not found:
            continue
        low = max(start - BEFORE, edits[-1][1] if edits else 0)
        local = _BEFORE.search(text[low:start])
        if not local:
            continue
        if bare and sign != "@" and all(text[s:e].strip(" ") == "." for s, e in dots[:found]) and local.group().isalpha():
            continue
        changed = [(s, e, ".") for s, e in dots[:found] if text[s:e] != "."]
        if sign == "@" and len(at.group()) == 1:
            if not changed:
                continue  # plain already
        else:
            changed.insert(0, (start, end, "@"))
        base, name = low + local.start(), local.group()
        changed[:0] = [(base + s, base + e, ".") for s, e in (m.span() for m in _DOT.finditer(name)) if name[s:e] != "."]
        edits += changed
    return edits


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = rf"(?:(?:{'|'.join(TIMES)})[ -]{{1,2}})?(?:{'|'.join(DIGIT_WORDS)})\b"
_GAP = rf"(?:[ ,-]{{1,2}}| {{0,2}}\. {{0,2}}| {{1,2}}(?:{DOT_WORDS}|point) {{1,2}})"
_SPELLED = re.compile(
    rf"(?:\bplus[ -]{{1,2}}|\+ ?)?\b(?:{_WORD}|[0-9]{{1,4}}\b)(?:{_GAP}(?:{_WORD}|[0-9]{{1,4}}\b)){{{LEAST_SPELLED - 1},}}", re.I
)
_ONE = re.compile(rf"(?:(?P<times>{'|'.join(TIMES)})[ -]{{1,2}})?(?P<word>{'|'.join(DIGIT_WORDS)})\b|(?P<digits>[0-9]+)", re.I)
_ANY_WORD = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})\b", re.I)
_ONLY_DOT = re.compile(rf" {{0,2}}(?:\.|{DOT_WORDS}|point) {{0,2}}", re.I)


def undisguise_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write runs of spelled digits as digits."""
    lower = text.lower()
    if not any(w in lower for w in DIGIT_WORDS) or not _ANY_WORD.search(text):
        return []
    edits = []
    for run in _SPELLED.finditer(text):
        body = run.group()
        if len(_ANY_WORD.findall(body)) < LEAST_SPELLED:
            continue
        tokens = list(_ONE.finditer(body))
        base = run.start()
        if tokens[0].start() and body[0] in "pP":
            edits.append((base, base + tokens[0].start(), "+"))
        for i, m in enumerate(tokens):
            if i:
                last = tokens[i - 1]
                gap = body[last.end() : m.start()]
                spelled = m.group("word") or last.group("word")
                if _ONLY_DOT.fullmatch(gap):
                    if gap != ".":
                        edits.append((base + last.end(), base + m.start(), "."))
                elif spelled:
                    edits.append((base + last.end(), base + m.start(), ""))
            if m.group("word"):
                n = TIMES[m.group("times").lower()] if m.group("times") else 1
                edits.append((base + m.start(), base + m.end(), DIGIT_WORDS[m.group("word").lower()] * n))
    return edits


#: In this order; the fold of lookalikes comes before them and keeps every offset.
TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (drop_invisible, undisguise_signs, undisguise_digits)


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) of all identifiers, by start, kind and end.

    Base spans (not disguised) are those of the plain patterns.  A span of the rewritten text is added where
    its source differs from it and it does not lie inside a base span of its kind.
    """
    base = detect(text)
    out = [(s, k, e, False) for s, k, e in base]
    fold, changes, _ = _characters()
    plain = text if text.isascii() or not changes.search(text) else text.translate(fold)
    steps = []
    for transducer in TRANSDUCERS:
        edits = transducer(plain)
        if edits:
            steps.append(Rewritten(plain, edits))
            plain = steps[-1].text
    if steps or plain is not text:
        kept = [[] for _ in KINDS]  # base spans of a kind are in order and do not overlap
        for s, k, e in base:
            kept[k].append((s, e))
        for s, k, e in detect(plain):
            start, end = s, e
            for step in reversed(steps):
                start, end = step.back(start, end)
            i = bisect_right(kept[k], (start, len(text) + 1)) - 1
            inside = i >= 0 and kept[k][i][1] >= end
            if text[start:end] != plain[s:e] and not inside:
                out.append((start, k, end, True))
    return [(KINDS[k], s, e, d) for s, k, e, d in sorted(set(out), key=lambda o: (o[0], o[1], o[2]))]


# ------------------------------------------------------------------ on tables
SPANS = "array<struct<kind: string, start: bigint, end: bigint, disguised: boolean>>"


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``pii``: all spans of personal data in each whole text (code points, end exclusive)."""

    def work():
        def run(texts: list[bytes]) -> dict[str, list]:
            found = (find_spans(t.decode("utf-8", "replace")) for t in texts)
            return {"pii": [[dict(zip(("kind", "start", "end", "disguised"), s)) for s in spans] for spans in found]}

        return run

    return map_texts(docs, work, [("pii", SPANS)], text, keep)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, all spans as text, and the number of disguised ones."""
    base = F.filter("pii", lambda s: ~s["disguised"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        *[c for c in found.columns if c != "pii"], *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
    )
