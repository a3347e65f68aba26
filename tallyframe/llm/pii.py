"""Personal data in plain and in disguised form, with offsets of the text as it stands.

Plain identifiers (e-mail, IP address, card, phone) are found by fixed patterns. For the others a text goes through a
chain of transducers, each of which rewrites some stretches and keeps the rest: invisible signs vanish, look-alike
letters and digits of other scripts become ASCII, spelled digits become digits, letters that stand for digits inside
numbers become digits, and "at" and "dot" in their disguises become signs. The same patterns then read the end of the
chain; what they find there is mapped back, transducer by transducer, to the characters that it was written as.

A transducer keeps its rewrites as sorted lists of where each stood before and after, so that mapping back is a binary
search and memory grows with the rewrites, not with the text. All patterns are linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")

# -- plain identifiers ------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from their signs, in one pass."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        after = domain.end() if domain else at + 1
        at = text.find("@", after)


def _octets(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.split("."))


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all plain identifiers, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# -- transducers ------------------------------------------------------------------------------------------------------


class Rewritten:
    """A text after one transducer, and where each of its rewrites stood before and stands now."""

    def __init__(self, text: str, rewrites: list[tuple[int, int, str]]):
        """rewrites: (start, end, what stands there instead), by start, without overlaps."""
        parts, seen, size = [], 0, 0
        self.before: list[tuple[int, int]] = []
        self.after: list[tuple[int, int]] = []
        for start, end, new in rewrites:
            parts += [text[seen:start], new]
            size += start - seen
            self.before.append((start, end))
            self.after.append((size, size + len(new)))
            size += len(new)
            seen = end
        self.text = "".join([*parts, text[seen:]])

    def _at(self, place: int) -> int:
        return bisect_right(self.after, (place, len(self.text) + 1)) - 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        """What start:end was written as. A part of a rewrite stands for the whole of it; what vanished at an end is left out."""
        k, j = self._at(start), self._at(end - 1)
        first = start if k < 0 else self.before[k][0] if start < self.after[k][1] else start + self.before[k][1] - self.after[k][1]
        last = end if j < 0 else self.before[j][1] if end <= self.after[j][1] else end + self.before[j][1] - self.after[j][1]
        return first, last


# Signs without a shape, and letters, digits and punctuation that look like ASCII.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁɗ", "e": "еє℮ҽ", "f": "ƒ", "g": "ɡց", "h": "һհ", "i": "іιɩı", "j": "јʝ", "k": "κкᴋ", "l": "ӏⅼ", "m": "ⅿм", "n": "ոп", "o": "оοօᴏ", "p": "рρ",
    "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτᴛ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "хχ", "y": "уүʏγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "Ѕ", "T": "ТΤ",
    "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。｡﹒", "-": "‐‑‒–—―−﹣", "+": "﹢", "_": "﹍", " ": "              　",
}
#: First digits of the runs of ten decimal digits of other scripts, and of mathematical digits.
DIGIT_ZEROS = (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
#: First letters of the mathematical alphabets whose 26 capitals and 26 small letters follow each other.
ALPHABETS = (0x1D400, 0x1D434, 0x1D468, 0x1D49C, 0x1D4D0, 0x1D504, 0x1D538, 0x1D56C, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670)


def _ascii_of() -> dict[str, str]:
    table = {odd: plain for plain, odds in LOOKALIKES.items() for odd in odds}
    table |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
    table |= {chr(zero + k): str(k) for zero in DIGIT_ZEROS for k in range(10)}
    table |= {chr(first + k): chr(65 + k if k < 26 else 71 + k) for first in ALPHABETS for k in range(52)}
    table |= {chr(0x24D0 + k): chr(97 + k) for k in range(26)} | {chr(0x24B6 + k): chr(65 + k) for k in range(26)}
    return table


ASCII_OF = str.maketrans(_ascii_of())
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")

# Names of digits, repeats and signs as they are spelled.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
REPEATS = {"double": 2, "triple": 3}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-"}
_NAMES, _SEPARATOR = "|".join(DIGITS), r"[\s,()-]"
_PLUS, _TIMES, _SIGN = rf"(?:plus{_SEPARATOR}{{1,3}}|\+\s{{0,2}})", rf"(?:(?:double|triple){_SEPARATOR}{{1,3}})?", rf"(?:(?:dot|point|dash|hyphen){_SEPARATOR}{{1,3}})?"
#: Names of digits beside each other or beside digits; a lone one is a number, not a disguise.
_RUN = re.compile(rf"(?<![^\W_])(?:{_PLUS}\(?(?:[0-9]+|{_TIMES}(?:{_NAMES}))|{_TIMES}(?:{_NAMES}))(?:{_SEPARATOR}{{1,3}}{_SIGN}{_TIMES}(?:{_NAMES}|[0-9]+)(?![^\W_]))++", re.IGNORECASE)
_TOKEN = re.compile(rf"{_SEPARATOR}*(?:(?P<word>[A-Za-z]+)|(?P<plain>\+|[0-9]+))")
#: Digits between which an O, l or I stands for another; seven signs at least, most of them digits.
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[\x20().-]{0,2}[0-9OolI]){6,}+(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OolI", "0011")

_OPEN, _CLOSE = r"[\s_]{0,3}[\[({<][\s_]{0,3}", r"[\s_]{0,3}[\])}>][\s_]{0,3}"
_GAP = r"[\s_-]{1,3}"
_SPELLED_DOT = rf"(?:{_OPEN}(?:dot|point|\.){_CLOSE}|{_GAP}(?:dot|point){_GAP})"
#: "at" in brackets or between gaps, and the sign itself, plain or set apart.
_AT = re.compile(rf"(?P<certain>{_OPEN}(?:at|@){_CLOSE})|(?P<bare>{_GAP}at{_GAP})|\s{{0,3}}@\s{{0,3}}", re.IGNORECASE)
#: A hyphen belongs to a label unless it sets a spelled dot apart, so that a domain can be read in one way only.
_LABEL = re.compile(r"[A-Za-z0-9]++(?:-++(?!(?:dot|point)-)[A-Za-z0-9]++)*+", re.IGNORECASE)
_NEXT = re.compile(rf"{_SPELLED_DOT}|\.", re.IGNORECASE)
_NEXT_APART = re.compile(r"\s\.\s")
_ENDS_DOT = re.compile(rf"{_SPELLED_DOT}\Z", re.IGNORECASE)
#: Labels of a domain and parts of a name, at most; code points of a bracketed dot, at most.
_MOST_PARTS, _DOT_WIDTH = 8, 24
_DOT = re.compile(rf"{_SPELLED_DOT}|\s\.\s", re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<][\s_]{0,3}(?:at|@|\.)")
#: Four numbers with a disguised dot between.
_QUAD = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_SPELLED_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)


def _vanished(text: str) -> Rewritten | None:
    rewrites = [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(text)]
    return Rewritten(text, rewrites) if rewrites else None


def _spelled_digits(text: str) -> Rewritten | None:
    """Runs of names of digits as digits; what separates two of them goes with the second."""
    rewrites = []
    for run in _RUN.finditer(text):
        times, names, own = 1, 0, []
        for token in _TOKEN.finditer(text, run.start(), run.end()):
            word = (token["word"] or "").lower()
            names += word in DIGITS
            if word in REPEATS:
                times = REPEATS[word]
                own.append((token.start(), token.end(), ""))
            else:
                own.append((token.start(), token.end(), DIGITS[word] * times if word in DIGITS else SIGNS[word] if word else token["plain"]))
                times = 1
        rewrites += own if names > 1 else []
    return Rewritten(text, rewrites) if rewrites else None


def _letters_as_digits(m: re.Match) -> str:
    return m[0].translate(_AS_DIGITS) if 2 * sum("0" <= c <= "9" for c in m[0]) > sum(c.isalnum() for c in m[0]) else m[0]


def _dots(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in _DOT.finditer(text, start, end)]


def _domain(text: str, start: int, apart: bool) -> int:
    """End of the domain at start whose last label is letters; 0 if there is none."""
    end, at, following = 0, start, _NEXT_APART if apart else _NEXT
    for k in range(_MOST_PARTS):
        label = _LABEL.match(text, at)
        if not label:
            break
        if k and 2 <= len(label[0]) <= 24 and label[0].isalpha():
            end = label.end()
        dot = following.match(text, label.end())
        if not dot:
            break
        at = dot.end()
    return end


def _name(text: str, least: int, end: int) -> int:
    """Start of the name that ends at end, spelled dots included; end if there is none."""
    start = at = end
    for _ in range(_MOST_PARTS):
        run = at
        while run > least and text[run - 1] in _LOCAL:
            run -= 1
        if run == at:  # nothing stands before the dot
            break
        start = run
        dot = _ENDS_DOT.search(text, max(least, run - _DOT_WIDTH), run)
        if not dot:
            break
        at = dot.start()
    return start


def _signs(text: str) -> Rewritten | None:
    """"at" and "dot" as signs, inside whole addresses only. A bare "at" is one only if its domain has a spelled dot."""
    rewrites, after = [], 0
    for at in _AT.finditer(text):
        if at.start() < after:
            continue
        end = _domain(text, at.end(), False) or (_domain(text, at.end(), True) if at[0] == " @ " else 0)
        start = _name(text, after, at.start()) if end else at.start()
        if start == at.start():
            continue
        dots = _dots(text, at.end(), end)
        if not at["bare"] or dots:
            rewrites += [r for r in (*_dots(text, start, at.start()), (at.start(), at.end(), "@"), *dots) if text[r[0] : r[1]] != r[2]]
            after = end
    for quad in _QUAD.finditer(text):
        rewrites += _dots(text, quad.start(), quad.end())
    rewrites = sorted(set(rewrites))
    apart = [r for k, r in enumerate(rewrites) if k == 0 or r[0] >= rewrites[k - 1][1]]
    return Rewritten(text, apart) if apart else None


def normalised(text: str) -> tuple[str, list[Rewritten]]:
    """The end of the chain, and its transducers that moved characters, in order."""
    chain: list[Rewritten] = []

    def through(done: Rewritten | None) -> None:
        nonlocal text
        if done:
            chain.append(done)
            text = done.text

    if not text.isascii():
        through(_vanished(text))
        text = text.translate(ASCII_OF)  # as long as before
    # What a transducer cannot do without is asked for first: most texts have none of it.
    small = text.lower()
    if sum(small.count(name) for name in DIGITS) > 1:
        through(_spelled_digits(text))
    if _DIGIT.search(text):
        text = _MIXED.sub(_letters_as_digits, text)  # as long as before
    if "@" in text or "dot" in small or "point" in small or _BRACKETED.search(small):
        through(_signs(text))
    return text, chain


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind, end, plain, normal form) of all identifiers, by start, then kind, then end; kind as in KINDS.

    What stands in the text plainly is found as it is. A disguised one that a plain one of its kind covers is no other.
    """
    base = identifiers(text)
    found = [(s, k, e, True, text[s:e]) for s, k, e in base]
    normal, chain = normalised(text)
    if normal == text:
        return found
    plain: dict[int, list[tuple[int, int]]] = {}
    for s, k, e in base:
        plain.setdefault(k, []).append((s, e))
    for s, k, e in identifiers(normal):
        form = normal[s:e]
        for done in reversed(chain):
            s, e = done.back(s, e)
        own = plain.get(k, [])
        at = bisect_right(own, (s, len(text) + 1)) - 1
        if at < 0 or own[at][1] < e:
            found.append((s, k, e, False, form))
    return sorted(found)


# -- whole tables -----------------------------------------------------------------------------------------------------

_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("form", pa.string())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(_FOUND))])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "plain": plain, "form": form} for s, k, e, plain, form in find(text.as_py())])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SCHEMA.field("found").type)], schema=_SCHEMA)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and found: kind, start, end (code points, end exclusive), plain and form (normalised) of each identifier.

    One row a row of docs, ids null or repeated included; null and empty texts hold nothing; an empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_searched, "doc_id long, found array<struct<kind: string, start: long, end: long, plain: boolean, form: string>>")


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_sha256, spans, n_disguised; nulls as in find_pii."""
    found = find_pii(docs)
    plain = F.filter("found", lambda x: x["plain"])

    def joined(of):
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(plain, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(plain).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), (F.size("found") - F.size(plain)).cast("long").alias("n_disguised"))
