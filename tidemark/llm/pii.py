"""Format-preserving pseudonyms for personal data.

Finds validated numbers and dates, and replaces each by a keyed permutation of
itself within its format, so that equal values keep equal pseudonyms in every
document and nothing can be read back without the key:

- payment cards: 13 to 19 digits that pass the Luhn check; the pseudonym keeps
  the separators and passes it too;
- telephone numbers: +country or (area) groups of 7 to 15 digits; separators,
  ``+`` and the country code stay;
- IPv4 addresses: four octets of 0 to 255; the pseudonym is one too;
- social security numbers ddd-dd-dddd with valid parts;
- IBANs with valid check digits: letters stay letters, digits digits, and the
  check digits are valid again;
- e-mail addresses: the letters and digits of the local part, by their class: a
  letter beyond ASCII stays in its run of 128 code points and its category;
- dates (ISO, d/m/y, and m/d/y where d/m/y is no date; with / or .) that exist
  between 1900 and 2099: permuted among the days of those years that the same
  format and number of digits can write. ISO dates and dates of two-digit days
  and months share one permutation, so they stay linked with each other.

Method: a value is a number below the size of its format's domain. Eight
Feistel rounds of keyed BLAKE2 over the two halves of its digits permute a
domain of a power of two; cycle walking keeps the result inside the format's
domain. A long local part is permuted by runs of RUN letters and digits, each
with the place of the run as its tweak, so its cost grows with its length. Documents without a digit (and without ``@``) aren't scanned.

Defined results: null text stays null, with no findings; overlapping matches
are resolved from the left, the longer pattern first in the order above;
a card, IBAN or telephone number that fails its check is tried without its last
groups; numbers that fail then stay as they are; input columns named like
output columns are replaced.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec, util

FIELDS = [
    T.StructField("pseudonymised", T.StringType()),
    T.StructField("n_found", T.LongType()),
    T.StructField("findings", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Letters and digits of a local part that are permuted as one number.
RUN = 64
#: Country codes of one and two digits; all others have three.
COUNTRY = {"1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}

PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+%-])[\w.+%-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))
    |(?P<iso>(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-]))
    |(?P<day>(?<![\w./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?!\w|[./]\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))
    |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))""",
    re.VERBOSE,
)


def _ends(s: str, least: int, most: int) -> list[int]:
    """Where the groups of ``s`` end, but for the last, that leave so many letters and digits; the longest first."""
    ends = [m.end() for m in re.finditer(r"[A-Za-z0-9]+", s)][:-1]
    return [e for e in reversed(ends) if least <= sum(map(str.isalnum, s[:e])) <= most]


#: Where a match that fails its check may end instead.
SHORTER = {"card": lambda s: _ends(s, 13, 19), "iban": lambda s: _ends(s, 15, 34), "phone": lambda s: _ends(s, 7, 15) if s[0] == "+" else []}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_check(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


class Permuter:
    """Keyed permutations of [0, size) for any size."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds
        self.known: dict[tuple[str, int, int], int] = {}

    def _round(self, tweak: bytes, r: int, x: int, bits: int) -> int:
        data = x.to_bytes(max(32, -(-bits // 8)), "big")
        out = b"".join(hashlib.blake2b(data, key=self.key, digest_size=32, salt=r.to_bytes(2, "big") + i.to_bytes(4, "big"), person=tweak[:16]).digest() for i in range(-(-bits // 256)))
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _feistel(self, tweak: bytes, x: int, half: int, back: bool) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        if back:
            for r in reversed(range(self.rounds)):
                left, right = right ^ self._round(tweak, r, left, half), left
        else:
            for r in range(self.rounds):
                left, right = right, left ^ self._round(tweak, r, right, half)
        return left << half | right

    def permute(self, kind: str, x: int, size: int, back: bool = False) -> int:
        """A permutation of [0, size), another for each kind and size; ``back`` inverts it."""
        if size < 2:
            return x
        at = (kind, x, size)
        if not back and at in self.known:
            return self.known[at]
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        tweak = hashlib.blake2b(f"{kind}/{size}".encode(), digest_size=16).digest()
        y = self._feistel(tweak, x, half, back)
        while y >= size:
            y = self._feistel(tweak, y, half, back)
        if not back:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[at] = y
        return y


def _spread(digits: str, like: str) -> str:
    """``like`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


@functools.lru_cache(4096)
def _class_of(c: str) -> str:
    """The characters that may stand for ``c``, in order; empty if it stays."""
    if c.isascii():
        return next((x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x), "")
    if not c.isalnum():
        return ""
    kind, at = unicodedata.category(c), ord(c) & ~127
    return "".join(x for x in map(chr, range(max(at, 128), at + 128)) if unicodedata.category(x) == kind and x.isalnum())


@functools.lru_cache(64)
def _days(day_digits: int, month_digits: int, late: bool) -> tuple[int, ...]:
    """The days that can be written with so many digits; ``late``: those after the twelfth of their month."""
    of = map(datetime.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    return tuple(d.toordinal() for d in of if (day_digits == 2 or d.day < 10) and (month_digits == 2 or d.month < 10) and (not late or d.day > 12))


class Pseudonyms:
    def __init__(self, key: bytes):
        self.p = Permuter(key)

    def digits(self, kind: str, d: str) -> str:
        return str(self.p.permute(kind, int(d), 10 ** len(d))).zfill(len(d))

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not luhn(d) or not int(d):
            return None
        body = self.digits("card", d[:-1])
        return _spread(next(body + c for c in "0123456789" if luhn(body + c)), s)

    def phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 7 <= len(d) <= 15:
            return None
        fixed = next((n for n in (1, 2) if d[:n] in COUNTRY), 3) if s[0] == "+" else 0
        return _spread(d[:fixed] + self.digits("phone", d[fixed:]), s)

    def ip(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255:
            return None
        n = self.p.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def ssn(self, s: str) -> str | None:
        a, b, c = map(int, s.split("-"))
        areas = [*range(1, 666), *range(667, 900)]
        if a not in areas or not b or not c:
            return None
        n = self.p.permute("ssn", (areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999)
        return f"{areas[n // (99 * 9999)]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        return self._classes("email", local) + "@" + domain

    def _classes(self, kind: str, s: str) -> str:
        """Letters and digits permuted within their classes, case and place."""
        out = list(s)
        places = [(i, of) for i, c in enumerate(s) if (of := _class_of(c))]
        for run in range(0, len(places), RUN):
            n, size = 0, 1
            for i, of in places[run : run + RUN]:
                n, size = n * len(of) + of.index(s[i]), size * len(of)
            n = self.p.permute(f"{kind}{run}" if run else kind, n, size)
            for i, of in reversed(places[run : run + RUN]):
                n, r = divmod(n, len(of))
                out[i] = of[r]
        return "".join(out)

    def iban(self, s: str) -> str | None:
        c = s.replace(" ", "")
        if not 15 <= len(c) <= 34 or iban_check(c) != 1:
            return None
        body = self._classes("iban", c[4:])
        check = 98 - iban_check(c[:2] + "00" + body)
        it = iter(c[:2] + f"{check:02d}" + body)
        return "".join(x if x == " " else next(it) for x in s)

    def _date(self, y: int, m: int, d: int, day_digits: int = 2, month_digits: int = 2, late: bool = False) -> datetime.date | None:
        try:
            n = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        days = _days(day_digits, month_digits, late)
        kind = "date" if day_digits == month_digits == 2 and not late else f"date{day_digits}{month_digits}{late}"
        return datetime.date.fromordinal(days[self.p.permute(kind, bisect.bisect_left(days, n), len(days))])

    def iso(self, s: str) -> str | None:
        got = self._date(*map(int, s.split("-")))
        return got and got.isoformat()

    def day(self, s: str) -> str | None:
        sep = "." if "." in s else "/"
        a, b, y = s.split(sep)
        got, flip = self._date(int(y), int(b), int(a), len(a), len(b)), False
        if got is None:  # m/d/y: only days that d/m/y can't be, so that both stay apart
            got, flip = self._date(int(y), int(a), int(b), len(b), len(a), late=True), True
        if got is None:
            return None
        x, z = (got.month, got.day) if flip else (got.day, got.month)
        return f"{x:0{len(a)}d}{sep}{z:0{len(b)}d}{sep}{got.year}"

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        out, found, last, at = [], [], 0, 0
        while m := PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup != "sep" else "day"
            new, end = getattr(self, kind)(m[0]), m.end()
            if new is None and kind in SHORTER:  # a number that others follow: end it at an earlier group
                for end in SHORTER[kind](m[0]):
                    new = getattr(self, kind)(m[0][:end])
                    if new is not None:
                        end += m.start()
                        break
            if new is None:  # not valid as this: try what else begins later in it
                skip = re.compile(r"\d+|\w").match(text, m.start())
                at = max(m.start() + 1, skip.end() if skip else 0)
                continue
            out += [text[last : m.start()], new]
            found.append(("date" if kind in ("iso", "day") else kind, m.start(), end))
            last = at = end
        out.append(text[last:])
        return "".join(out), found


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` with pseudonymised, n_found and findings (kind and span in the text)."""

    def compute(batch: pa.RecordBatch) -> list:
        names = Pseudonyms(key)
        new, count, spans = [], [], []
        for t in map(pa.StringScalar.as_py, textvec.text_column(batch, text)):
            found: list[tuple[str, int, int]] = []
            if t and ("@" in t or _DIGIT(t)):
                t, found = names.apply(t)
            new.append(t)
            count.append(len(found))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        return [new, count, spans]

    return util.with_columns(docs, FIELDS, compute)


_DIGIT = re.compile(r"[0-9]").search
