"""Personal data in texts, also where it is disguised, with its place in the source.

Mail addresses, network addresses, card and phone numbers are found in a text as it stands. Then two transducers
rewrite it: the first maps single symbols (homoglyphs, full-width and other compatibility forms, digits of other
scripts, kinds of dashes and spaces) and leaves out invisible ones; the second maps words: spelled digits, ``at`` and
``dot`` in brackets or words, ``plus`` and ``dash`` next to digits, letters that stand for digits. Each keeps the list
of its edits, so a place in its output leads back to the symbols it came from. The detectors run again on the
result, and a find that holds a rewritten symbol is mapped back through both and added. What was found in the text
as it stands stays; an added span of the same place, or inside one of those, is left out.

Words are rewritten only where the rest makes an identifier likely: spelled digits next to another spelled digit or
between digits; a bare ``at`` only before a name with a bare ``dot`` and a known ending; plain text with "at" and
"dot" stays as it is.

Defined results: a null text is an empty one and has no spans; texts are read whole; a run of any length is read in
linear time; rows repeated in full each have their row; only the two named columns are read, so other columns and
their names do not matter; an empty table gives no rows. Places are code points, the end is exclusive.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

#: Letters of other scripts that look like a Latin letter, and that letter.
_LOOKALIKES = dict(zip("авекмнорстухіјѕԁһԛԝӏгАВЕКМНОРСТУХІЈЅԌԚԜαβγεηικνορτυχωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡɩ",
                       "abekmhopctyxijsdhqwlrABEKMHOPCTYXIJSGQWabyenikvoptuxwcjABEZHIKMNOPTYXiagi"))
#: Dashes, dots, spaces and signs that stand for an ASCII one, and symbols that are not seen.
_SIGNS = {**dict.fromkeys("\u2010\u2011\u2012\u2013\u2212\ufe63\u2043", "-"), **dict.fromkeys("\u2024\uff0e\uff61\ufe52", "."),
          **dict.fromkeys("\ufe6b\uff20", "@"),
          **dict.fromkeys("\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")}
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\ufe0f"

#: Spelled digits of four languages, words for at, dot and dash, endings of names.
_DIGITS = {w: d for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
                              "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
           for d, w in enumerate(words.split())} | {"oh": 0, "zwo": 2}
_AT = "at|arroba|arobase|ät"
_DOT = "dot|punkt|point|punto"
_DASH = "dash|hyphen|minus"
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|uk|eu|ch|nl|pl|ru|br|jp|cn|au|ca|dev|app"


def _symbols() -> dict[int, str]:
    """Single symbols and what they stand for: the lists above, and by rule every compatibility form and decimal digit."""
    table = {ord(k): v for k, v in {**_SIGNS, **_LOOKALIKES}.items()} | {ord(c): "" for c in _UNSEEN}
    for first, last in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24FF), (0x1F130, 0x1F14A), (0x2070, 0x209D)):
        for point in range(first, last):
            plain = unicodedata.normalize("NFKC", chr(point))
            if len(plain) == 1 and plain.isascii():
                table.setdefault(point, plain)
    for point in range(0x80, 0x1FBFA):
        digit = unicodedata.decimal(chr(point), None)
        if digit is not None:
            table.setdefault(point, str(digit))
    return table


_TABLE = _symbols()
_ODD = re.compile("[^\x00-\x7fÀ-ÿ]+")  # all of the table and more


def _lower(text: str) -> str:
    """Lower case, symbol by symbol, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _any_of(words: list[str]) -> str:
    """A pattern of words by their first letters, longer words first."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


# patterns of lower-cased text; those that every text is searched for begin with a class of few symbols where they can
_WORD = _any_of(list(_DIGITS))
_PIECE = re.compile(rf"([0-9]+)|({_WORD})|(?:{_DASH}|{_DOT})")
_RUN = re.compile(rf"\b(?:{_WORD}|[0-9]++)\b(?:[\s,;\-]{{1,3}}(?:{_WORD}|[0-9]++|{_DASH}|{_DOT})\b)++")
_LETTER = re.compile(r"[0-9](?:[OolI|]|(?<=[OolI|][0-9]))")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])[OolI|]*+[0-9][0-9OolI|]*+(?![A-Za-z0-9])")
_PLUS = re.compile(r"(?<![^\W_])plus\s{1,3}(?=\(?[0-9])", re.I)
_DASH_WORD = re.compile(rf"(?<=[0-9])\s{{1,3}}(?:{_DASH})\s{{1,3}}(?=[0-9])", re.I)
_DOT_WORD = re.compile(rf"(?<=[0-9])\s{{1,3}}(?:{_DOT})\s{{1,3}}(?=[0-9])", re.I)
_BRACKETS = re.compile(rf"[\[({{<]\s{{0,3}}(?:({_AT}|@)|(?:{_DOT}|\.))\s{{0,3}}[\])}}>]")
#: other marks, and a symbol that a text with one holds
_CODED = (("&", re.compile("&(?:(#64|#x40|commat)|#46|#x2e|period);")), ("%40", re.compile("(%40)")),
          ("_", re.compile(rf"_(?:({_AT})|{_DOT})_")))
_PART = r"(?:\s{1,3}|[-_])"
_LABEL = rf"[A-Za-z0-9]++(?:-(?!(?:{_DOT})-)[A-Za-z0-9]++)*+"
_BARE_DOT = re.compile(rf"{_PART}(?:{_DOT}){_PART}", re.I)
_BARE_AT = re.compile(rf"{_PART}(?:{_AT}){_PART}", re.I)
_BARE_NAME = re.compile(rf"{_LABEL}(?:(?:\.|{_PART}(?:{_DOT}){_PART}){_LABEL})*{_PART}(?:{_DOT}){_PART}(?:{_ENDINGS}|example|test)(?![A-Za-z0-9\-])", re.I)
_DOT_BEFORE = re.compile(rf"(?<=[A-Za-z0-9]){_PART}(?:{_DOT}){_PART}\Z", re.I)
_SPACED_AT = re.compile(r"\s{1,3}@\s{0,3}|(?<!\s)@\s{1,3}")
_SPACED_DOT = re.compile(r"\s{1,3}\.\s{0,3}|\.\s{1,3}")
_SPACED_NAME = re.compile(rf"[A-Za-z0-9\-]++(?:\s{{0,3}}\.\s{{0,3}}[A-Za-z0-9\-]++)*?\s{{0,3}}\.\s{{0,3}}(?:{_ENDINGS})(?![A-Za-z0-9\-])", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address begins where the run of its symbols before the sign does, so signs are looked up, not beginnings."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a text as it stands, by kind and place."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or "0") < 256 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
                out.append((3, *m.span()))
    return out


class Edited:
    """A text after edits (start, end, replacement), which knows where its symbols came from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.starts, self.edits, done, size = [], [], edits, 0, 0
        for start, end, new in edits:
            parts += [source[done:start], new]
            size += start - done
            self.starts.append(size)  # of the replacement, in the text
            size += len(new)
            done = end
        parts.append(source[done:])
        self.text = "".join(parts)

    def _place(self, at: int, upper: bool) -> int:
        """The source place of a boundary in the text; inside a replacement that of its end or its beginning."""
        i = bisect.bisect_right(self.starts, at) - 1 if not upper else bisect.bisect_left(self.starts, at) - 1
        if i < 0:
            return at
        start, end, new = self.edits[i]
        over = at - self.starts[i] - len(new)
        if over >= 0:
            return end + over
        return end if upper else start

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start, False), self._place(end, True)

    def rewritten(self, start: int, end: int) -> bool:
        """Whether a run of the text holds a replacement, or symbols were left out inside it."""
        i = bisect.bisect_left(self.starts, end)
        while i:
            i -= 1
            at, new = self.starts[i], self.edits[i][2]
            if new and at + len(new) > start or not new and at > start:
                return True
            if at + len(new) <= start:
                return False
        return False


def symbols(text: str) -> Edited:
    """First transducer: single symbols."""
    edits = []
    for m in _ODD.finditer(text):
        edits += [(i, i + 1, _TABLE[ord(text[i])]) for i in range(*m.span()) if ord(text[i]) in _TABLE]
    return Edited(text, edits)


def _merged(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order; of two that overlap the first stays."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits next to another one, or between digits, without what parts two of them."""
    edits, text = [], _lower(text)
    for run in _RUN.finditer(text):
        # (start, end, digit or None for plain digits); a dash or dot word stands between digits as nothing does
        pieces, apart = [], []
        for m in _PIECE.finditer(text, *run.span()):
            if m.group(1) or m.group(2):
                pieces.append((*m.span(), _DIGITS[m.group(2)] if m.group(2) else None))
                apart.append(False)
            elif apart:
                apart[-1] = True
        last = -1
        for i, (start, end, digit) in enumerate(pieces):
            if digit is None:
                continue
            left, right = (pieces[k][2] if 0 <= k < len(pieces) else -1 for k in (i - 1, i + 1))
            spelled = (i > 0 and left is not None) or (right is not None and right >= 0)
            if spelled or (left is None and right is None):
                joins = last == i - 1 and last >= 0 and not apart[last]
                edits.append((pieces[last][1] if joins else start, end, str(digit)))
                last = i
    return edits


def _digits_for_letters(text: str) -> list[tuple[int, int, str]]:
    """Letters that look like digits, in tokens half of which are digits."""
    if not _LETTER.search(text):
        return []
    edits = []
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not token.isdigit() and 2 * sum(c.isdigit() for c in token) >= len(token):
            edits += [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for i, c in enumerate(token) if not c.isdigit()]
    return edits


def _between_digits(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    edits = [(*m.span(), "+") for m in _PLUS.finditer(text)] if "plus" in low else []
    for words, found, sign in ((_DASH, _DASH_WORD, "-"), (_DOT, _DOT_WORD, ".")):
        if any(w in low for w in words.split("|")):
            edits += [(*m.span(), sign) for m in found.finditer(text)]
    return edits


def _plain(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def _signs(text: str) -> list[tuple[int, int, str]]:
    """At and dot: in brackets or coded wherever they join names, as bare words or apart only in front of a known ending."""
    low, edits, ats = _lower(text), [], []
    marks = [m for m in _BRACKETS.finditer(low)]
    for symbol, pattern in _CODED:
        if symbol in low:
            marks += pattern.finditer(low)
    for m in marks:
        start, end = m.span()
        while start and text[start - 1].isspace() and m.start() - start < 3:
            start -= 1
        while end < len(text) and text[end].isspace() and end - m.end() < 3:
            end += 1
        if _plain(text, start - 1) and _plain(text, end):
            sign = "@" if any(m.groups()) else "."
            edits.append((start, end, sign))
            if sign == "@":
                ats.append((start, end))
    if any(w in low for w in _DOT.split("|")):
        for m in _BARE_AT.finditer(text):
            if _plain(text, m.start() - 1) and _BARE_NAME.match(text, m.end()):
                edits.append((*m.span(), "@"))
                ats.append(m.span())
        ats += [(m.start(), m.end()) for m in re.finditer("@", text)]
        for start, end in ats:
            name = _BARE_NAME.match(text, end)
            if name:
                edits += [(*m.span(), ".") for m in _BARE_DOT.finditer(text, *name.span())]
            while start:  # dots of the part before the sign
                while start and text[start - 1] in _LOCAL:
                    start -= 1
                dot = _DOT_BEFORE.search(text, max(0, start - 12), start)  # no longer than its pattern can be
                if not dot:
                    break
                edits.append((*dot.span(), "."))
                start = dot.start()
    if "@" in text:
        for m in _SPACED_AT.finditer(text):
            name = _SPACED_NAME.match(text, m.end())
            if name and _plain(text, m.start() - 1):
                edits.append((*m.span(), "@"))
                edits += [(*d.span(), ".") for d in _SPACED_DOT.finditer(text, *name.span())]
    return edits


#: The steps of the word transducer; each reads what the one before wrote.
_STEPS = (_spelled, _digits_for_letters, _between_digits, _signs)


def transduced(text: str) -> list[Edited]:
    """The text after each step that changes it."""
    stages = []
    if not text.isascii():
        stages.append(symbols(text))
    for step in _STEPS:
        now = stages[-1].text if stages else text
        stages.append(Edited(now, _merged(step(now))))
        if not stages[-1].edits:
            stages.pop()
    return [s for s in stages if s.edits]


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (kind, start, end) found as the text stands, and those that the transducers add."""
    text = text or ""
    base = detect(text)
    stages = transduced(text)
    if not stages:
        return base, []
    held: dict[int, list[tuple[int, int]]] = {}
    for kind, start, end in base:
        held.setdefault(kind, []).append((start, end))
    added = []
    for kind, start, end in detect(stages[-1].text):
        changed = False
        for s in reversed(stages):
            changed = changed or s.rewritten(start, end)
            start, end = s.source_span(start, end)
        near = held.get(kind, [])
        k = bisect.bisect_left(near, (start + 1,))
        meets = [x for x in near[max(0, k - 1):k + 1] if x[0] < end and start < x[1]]
        # an address may be longer than what stands plainly; a number that stands plainly is whole
        if changed and not (meets if kind else any(x <= start and end <= y for x, y in meets)):
            added.append((kind, start, end))
    return base, added


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", _SPAN), ("added", _SPAN)])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) by kind and place, one row a document."""
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [spans(t.as_py()) for t in batch.column(1)]
            sides = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[i]] for f in found], _SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], schema=_SCHEMA)

    span = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"doc_id long, base {span}, added {span}")


def merged(base: Column, added: Column) -> Column:
    """Spans of both, by kind as listed in KINDS, then by start and end."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat(base, added), lambda s: F.struct(
        F.array_position(kinds, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(found: Column) -> Column:
    """kind:start:end, with commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first one's mark stands for all."""
    by_place = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))
    held = F.coalesce(text, F.lit(""))
    cut = lambda a, b: F.substring(held, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["done"], F.concat(acc["out"], cut(acc["done"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        .otherwise(acc["out"]).alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))
    return F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], cut(acc["done"], F.length(held))))
