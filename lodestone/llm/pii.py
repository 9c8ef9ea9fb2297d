"""Format-preserving pseudonyms for personal data in texts.

Numbers and dates that pass a check (card numbers by the Luhn digit, IBANs by their
remainder, IPv4 addresses by the range of their parts, phone and social security numbers by
their shape and reserved areas, dates by the calendar) are permuted within their format by
a keyed Feistel network: the output is as long, has the same separators, passes the same
check, and equal values get equal pseudonyms in all documents. Digits of e-mail names and
letters of them are permuted alike, each character within its kind. Keys belong to the
caller; the permutation can be undone with the key.

A network works on numbers below a bound: halves of a power of two are mixed by keyed
BLAKE2 rounds and values that fall beyond the bound walk on along their cycle, so each
format's set of valid values maps onto itself one to one.

A run of digit groups may hold a card beside other numbers (a security code, an expiry
date): if the run as a whole fails the check, its parts between separators are tried.

Defined cases: a null text stays null; a text without findings is returned as it is, byte
for byte; a very long text is searched from start to end in one pass; where findings could
overlap the earlier one counts; rows with a null or the same doc_id are treated each for
itself, and repeated rows alike; an empty table gives no rows; all columns but text are kept
as they are, but for one named n_pii.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import re
import string
import sys
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10


class Feistel:
    """A keyed permutation of the numbers from 0 to ``bound`` - 1."""

    def __init__(self, key: bytes, tweak: str, bound: int):
        self.bound = bound
        self.half = max(1, ((bound - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{tweak}:{bound}:{i}".encode(), key=key, digest_size=32).digest() for i in range(ROUNDS)]

    def _mix(self, i: int, x: int) -> int:
        size = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(size, "big"), key=self.keys[i], digest_size=max(8, size)).digest(), "big") & self.mask

    def _once(self, x: int, order) -> int:
        left, right = x >> self.half, x & self.mask
        for i in order:
            left, right = right, left ^ self._mix(i, right)
        return left << self.half | right

    def permute(self, x: int) -> int:
        while True:
            x = self._once(x, range(ROUNDS))
            if x < self.bound:
                return x

    def restore(self, x: int) -> int:
        swap = lambda v: (v & self.mask) << self.half | v >> self.half
        while True:
            x = swap(self._once(swap(x), reversed(range(ROUNDS))))
            if x < self.bound:
                return x


class Undo(Feistel):
    """The same permutation the other way round."""

    permute = Feistel.restore


def luhn_digit(digits: str) -> str:
    """The digit that completes ``digits`` to a number that passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


class _Beyond:
    """Stands for a match behind the end of every text."""

    def start(self) -> int:
        return sys.maxsize

    end = start


_NONE = _Beyond()


class Pseudonyms:
    """Finds personal data in texts and replaces it under one key, or, with ``undo``, gives the values back that one key replaced."""

    #: What may be personal data; the group's name tells the kind. Fixed formats.
    PATTERN = re.compile(
        r"""(?<![\w.+-])(?P<email>[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
        |(?<![\w.-])(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?![\w-]|\.\d)
        |(?<![\w+-])(?P<phone>\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])
        |(?<![\w+.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
        |(?<![\w+.-])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)
        |(?<![\w+.-])(?P<card>\d(?:[ -]?\d){12,})(?![\w-])
        |(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)""",
        re.X,
    )
    #: The same without cards, to look for other kinds where a run of digits is none.
    OTHER = re.compile(re.sub(r"\|.*\(\?P<card>.*\n", "", PATTERN.pattern), re.X)
    #: How the digits of most cards are grouped.
    GROUPED = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{4,5}")
    #: Every finding has one of these, so most texts need one look.
    HINT = re.compile(r"@|\d[\d./ ()-]{4,}\d|\d{4}")

    def __init__(self, key: bytes, undo: bool = False):
        self.key = key
        self.network = lru_cache(maxsize=1024)(lambda tweak, bound: (Undo if undo else Feistel)(key, tweak, bound))
        self.value = lru_cache(maxsize=8192)(self._value)

    def _number(self, digits: str, tweak: str) -> str:
        return str(self.network(tweak, 10 ** len(digits)).permute(int(digits))).zfill(len(digits))

    @staticmethod
    def _refill(like: str, digits: str) -> str:
        """``digits`` in the places of the digits of ``like``."""
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in like)

    def email(self, text: str) -> str | None:
        name, at, host = text.rpartition("@")
        kinds = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
        places = [(i, k) for i, c in enumerate(name) for k in kinds if c in k]
        bound = x = 0
        for n, (i, k) in enumerate(places):
            bound, x = (bound or 1) * len(k), x * len(k) + k.index(name[i])
        if not places:
            return None
        shape = "".join("aA0"[next(j for j, k in enumerate(kinds) if c in k)] if any(c in k for k in kinds) else c for c in name)
        x, out = self.network("email:" + shape, bound).permute(x), list(name)
        for i, k in reversed(places):
            x, r = divmod(x, len(k))
            out[i] = k[r]
        return "".join(out) + at + host

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        # among the addresses whose parts have as many digits: the format, and so the text's length, stays
        lows, sizes = zip(*(((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts), strict=True)
        bound, x = 1, 0
        for p, low, n in zip(parts, lows, sizes, strict=True):
            bound, x = bound * n, x * n + int(p) - low
        x, out = self.network(f"ipv4:{lows}", bound).permute(x), []
        for low, n in zip(reversed(lows), reversed(sizes), strict=True):
            x, r = divmod(x, n)
            out.append(str(r + low))
        return str(ipaddress.IPv4Address(".".join(reversed(out))))

    def phone(self, text: str) -> str | None:
        """The country's code stays. In numbers of ten digits with code +1, or without one, area and exchange keep whether they begin with 2 to 9; in others a first 0 stays and no other becomes 0. A number with +1 and the same without are permuted alike."""
        head = re.match(r"\+\d{1,3}", text)
        body = text[head.end() :] if head else text
        digits, country = re.sub(r"\D", "", body), head.group() if head else "+1"
        if not 7 <= len(digits) <= 14:
            return None
        if country == "+1" and len(digits) == 10:
            ranges = [((2, 8) if d > "1" else (0, 2)) if i in (0, 3) else (0, 10) for i, d in enumerate(digits)]
        else:
            ranges = [((1, 9) if d > "0" else (0, 1)) if not i else (0, 10) for i, d in enumerate(digits)]
        return text[: len(text) - len(body)] + self._refill(body, self._within(digits, ranges, f"phone:{country}"))

    def _within(self, digits: str, ranges: list[tuple[int, int]], tweak: str) -> str:
        """``digits`` permuted among those whose digits lie in the same ranges (lowest, how many)."""
        bound, x = 1, 0
        for d, (low, n) in zip(digits, ranges, strict=True):
            bound, x = bound * n, x * n + int(d) - low
        x, out = self.network(f"{tweak}:{ranges}", bound).permute(x), []
        for low, n in reversed(ranges):
            x, r = divmod(x, n)
            out.append(str(r + low))
        return "".join(reversed(out))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        index = area - 1 - (area > 666)
        x = self.network("ssn", 898 * 99 * 9999).permute((index * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        index, group = divmod(x, 99)
        return f"{index + 1 + (index >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, text: str) -> str | None:
        """Days are permuted within their century, so that a date of birth stays a likely one.

        The result has as many digits in each part and is read in the same order of parts: a
        month that comes first is followed by a day over 12, as else the day would come first.
        """
        for shape, order in ((r"(\d{4})([-/])(\d\d)\2(\d\d)$", "ymd"), (r"(\d\d?)([./])(\d\d?)\2(\d{4})$", "dmy"), (r"(\d\d?)([./])(\d\d?)\2(\d{4})$", "mdy")):
            if not (m := re.match(shape, text)):
                continue
            part = dict(zip(order, (m[1], m[3], m[4]), strict=True))
            try:
                day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"]))
            except ValueError:
                continue
            first = day.year // 100 * 100
            if not 1800 <= day.year < 2200:
                return None
            start, n = datetime.date(first, 1, 1).toordinal(), datetime.date(first + 99, 12, 31).toordinal() + 1
            moved, net = day.toordinal() - start, self.network(f"date:{first}", n - start)
            while True:  # along the cycle to a day that such parts can write and that is read so; the day itself is one
                moved = net.permute(moved)
                new = datetime.date.fromordinal(start + moved)
                if all(v < 10 or len(part[k]) > 1 for k, v in (("m", new.month), ("d", new.day))) and (order != "mdy" or new.day > 12):
                    break
            out = {"y": f"{new.year:04d}", "m": str(new.month).zfill(len(part["m"])), "d": str(new.day).zfill(len(part["d"]))}
            return m[2].join(out[k] for k in order)
        return None

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        head, body = digits[:1], digits[1:-1]
        made = head + self._number(body, f"card:{head}")
        return self._refill(text, made + luhn_digit(made))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        rest = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if not 15 <= len(plain) <= 34 or rest(plain[4:] + plain[:4]) != 1:
            return None
        body = plain[4:]
        digits = "".join(c for c in body if c.isdigit())
        body = self._refill(body, self._number(digits, "iban:" + plain[:2])) if digits else body
        made = iter(f"{plain[:2]}{98 - rest(body + plain[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(made) for c in text)

    def _value(self, kind: str, text: str) -> str | None:
        return getattr(self, kind)(text)

    def cards(self, run: str) -> list[tuple[int, int]]:
        """Where the valid cards are in a run of digits with single blanks or dashes, which may hold other numbers too.

        A card begins and ends at separators or the run's ends. Where valid ones overlap, the
        whole run goes first, then the usual groupings, then the longer one, then the earlier.
        """
        parts = [m.span() for m in re.finditer(r"\d+", run)]
        found = []
        for i, (a, _) in enumerate(parts):
            n = 0
            for x, b in parts[i:]:
                n += b - x
                if n > 19:
                    break
                if n >= 13 and self.card(run[a:b]) is not None:
                    found.append((b - a < len(run), not self.GROUPED.fullmatch(run, a, b), -n, a, b))
        taken: list[tuple[int, int]] = []
        for *_, a, b in sorted(found):
            at = bisect.bisect(taken, (a, b))
            if (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
        return taken

    def found(self, text: str) -> Iterator[tuple[str, int, int]]:
        """What may be personal data in ``text``, in order: kind, start and end."""
        at = known = 0  # cards that begin before `known` have been found
        cards: deque[tuple[int, int]] = deque()
        m = other = None
        while True:
            if at < known:
                if other is None or other.start() < at:
                    other = self.OTHER.search(text, at) or _NONE
                if cards and cards[0][0] < at:
                    cards.popleft()
                elif cards and other.end() > cards[0][0]:
                    a, at = cards.popleft()
                    yield "card", a, at
                elif other.start() < known:
                    at = other.end()
                    yield other.lastgroup, *other.span()
                else:
                    at = known
                continue
            if (m := self.PATTERN.search(text, at)) is None:
                return
            if m.lastgroup == "card":
                cards.extend((m.start() + a, m.start() + b) for a, b in self.cards(m.group()))
                at, known = m.span()
            else:
                at = m.end()
                yield m.lastgroup, *m.span()

    def apply(self, text: str, note: Callable[[str], None] | None = None) -> str:
        if not self.HINT.search(text):
            return text
        out, at = [], 0
        for kind, a, b in self.found(text):
            if (new := self.value(kind, text[a:b])) is not None:
                out += text[at:a], new
                at = b
                if note:
                    note(kind)
        return "".join([*out, text[at:]])


@lru_cache(maxsize=2)
def pseudonyms(key: bytes) -> Pseudonyms:
    """One for each Python worker, which runs many tasks; what it remembers is emptied after each."""
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; one more column n_pii long counts the replacements.

    ``key`` (up to 64 bytes) is the caller's secret: who has it can undo the replacement. A
    column of ``docs`` named n_pii gives way to the count.
    """
    if not key:
        raise ValueError("a key is needed")
    names = [c for c in docs.columns if c != "n_pii"]
    source = docs.select(*names)
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", n_pii long"

    def run(batches: Iterator[pa.RecordBatch]):
        hide = pseudonyms(key)
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    texts, counts = [], []
                    for t in b.column(at):
                        found: list[str] = []
                        texts.append(None if (t := t.as_py()) is None else hide.apply(t, found.append))
                        counts.append(len(found))
                    columns = [*b.columns]
                    columns[at] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "n_pii"])
        finally:
            hide.value.cache_clear()

    return source.withColumn("text", F.col("text").cast("string")).mapInArrow(run, fields)
