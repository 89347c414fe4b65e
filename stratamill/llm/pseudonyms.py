"""Pseudonyms that keep the format: validated numbers and dates are permuted, by a key, within their format.

Each kind of value is an integer below the number of valid values of its format. A Feistel network over the next even
number of bits, walked until it lands inside, permutes the integers by the key. A value x becomes E(E'(x) + 1), where E'
undoes E: one cycle over all values, so none stays as it is, equal values get equal pseudonyms in all documents, and
whoever has the key gets them back. Check digits and calendars hold for pseudonyms as for values, and lengths are kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm._shared import field, map_texts

ROUNDS = 8
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
#: Groups of digits on cards, besides a single one.
LAYOUTS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
#: Characters that are permuted within their own set.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
SETS = {c: a for a in ALPHABETS for c in a}
#: Characters that are permuted together; longer values are cut.
TOGETHER = 256


#: Sets of characters of other scripts that a process has met; there are no more than code points.
OTHERS: dict[str, str] = {}


def alphabet(c: str) -> str:
    """The set of a letter or digit: of other scripts those of its kind among its 128 code points. Others have none."""
    if c in SETS:
        return SETS[c]
    if not c.isalnum():
        return ""
    if c not in OTHERS:
        low, kind = ord(c) & ~127, unicodedata.category(c)
        OTHERS[c] = "".join(x for x in map(chr, range(low, low + 128)) if x not in SETS and x.isalnum() and unicodedata.category(x) == kind)
    return OTHERS[c]


PATTERN = re.compile(
    r"(?<![\w.+%-])(?P<email>[\w.+%-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.?\w)"
    r"|(?<![\w./-])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\w/-]|\.\d)"
    r"|(?<![A-Za-z0-9])(?P<card>\d(?:[ -]?\d){12,18})(?![A-Za-z0-9])"
)


class Permutation:
    """Keyed permutations of the integers below n, one for each kind of value and each n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, r: int, half: int, x: int) -> int:
        size, told = (half + 7) // 8, b"%s|%x|%d|%x" % (kind.encode(), n, r, x)
        h = hashlib.blake2b(told, key=self.key, digest_size=max(8, size)).digest() if size <= 64 else hashlib.shake_256(self.key + told).digest(size)
        return int.from_bytes(h, "big") & ((1 << half) - 1)

    def _network(self, kind: str, n: int, x: int, rounds) -> int:
        half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        back = rounds.step < 0
        while True:
            left, right = x >> half, x & mask
            for r in rounds:
                left, right = (right ^ self._round(kind, n, r, half, left), left) if back else (right, left ^ self._round(kind, n, r, half, right))
            x = left << half | right
            if x < n:
                return x

    def encrypt(self, kind: str, n: int, x: int) -> int:
        return self._network(kind, n, x, range(ROUNDS))

    def decrypt(self, kind: str, n: int, x: int) -> int:
        return self._network(kind, n, x, range(ROUNDS - 1, -1, -1))

    def next(self, kind: str, n: int, x: int, step: int = 1) -> int:
        """The pseudonym of x, or for step -1 the value whose pseudonym x is."""
        return self.encrypt(kind, n, (self.decrypt(kind, n, x) + step) % n)

    def within(self, kind: str, n: int, x: int, valid, step: int = 1) -> int:
        """The next valid value on the cycle; x itself where it is the only one."""
        y = self.next(kind, n, x, step)
        while not valid(y):
            y = self.next(kind, n, y, step)
        return y


def luhn(digits: str) -> int:
    """The check sum of a whole number, 0 if it is valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _refill(shape: str, fresh: str, taken=str.isalnum) -> str:
    """The shape with its characters of a kind replaced, in order."""
    it = iter(fresh)
    return "".join(next(it) if taken(c) else c for c in shape)


class Pseudonymiser:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, step: int = 1):
        self.permutation, self.kinds, self.step = Permutation(key), frozenset(kinds), step
        self.memo: dict[tuple[str, str], str | None] = {}

    def _mixed(self, kind: str, chars: str) -> str:
        """Characters permuted together, each within its alphabet; as they are where none has another to turn into."""
        if len(chars) > TOGETHER:
            return "".join(self._mixed(f"{kind}{len(chars)}at{k}", chars[k : k + TOGETHER]) for k in range(0, len(chars), TOGETHER))
        n, x = 1, 0
        for c in chars:
            if a := alphabet(c):
                n, x = n * len(a), x * len(a) + a.index(c)
        if n == 1:
            return chars
        x, out = self.permutation.next(f"{kind}{len(chars)}", n, x, self.step), []
        for c in reversed(chars):
            if a := alphabet(c):
                x, i = divmod(x, len(a))
                c = a[i]
            out.append(c)
        return "".join(reversed(out))

    def _email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        fresh = self._mixed("email", local)
        return f"{fresh}@{domain}" if fresh != local else None

    def _iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        remainder = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if not 15 <= len(plain) <= 34 or remainder(plain[4:] + plain[:4]) != 1:
            return None
        body = self._mixed("iban" + plain[:2], plain[4:])
        return _refill(s, f"{plain[:2]}{98 - remainder(body + plain[:2] + '00'):02d}{body}")

    def _card(self, s: str) -> str | None:
        """One run of digits, or groups as they are printed; what follows is looked at again."""
        groups = re.split(r"([ -])", s)
        sizes = tuple(map(len, groups[::2]))
        for layout in ((sizes[0],), *LAYOUTS):
            digits = "".join(groups[: 2 * len(layout) - 1 : 2])
            if sizes[: len(layout)] == layout and 13 <= len(digits) <= 19 and not luhn(digits) and digits.strip("0"):
                body = self._mixed("card", digits[:-1])
                return _refill("".join(groups[: 2 * len(layout) - 1]), body + str(-luhn(body + "0") % 10), str.isdigit)
        return None

    def _phone(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 8 <= len(digits) <= 15:
            return None
        code = re.match(r"\+(\d{1,3})(?=\D)", s)
        country = code[1] if code else digits[: max(1, len(digits) - 10)] if s[0] == "+" else ""
        # numbers of one length are linked however they are spaced, with and without the code +1
        return _refill(s, country + self._mixed("phone" + (country if country != "1" else ""), digits[len(country) :]), str.isdigit)

    def _ssn(self, s: str) -> str | None:
        valid = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 and x % 10**4
        x = int(s.replace("-", ""))
        if not valid(x):
            return None
        return _refill(s, f"{self.permutation.within('ssn', 10**9, x, valid, self.step):09d}", str.isdigit)

    def _ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        n, x = 1, 0
        ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
        for p, (low, many) in zip(parts, ranges, strict=True):
            n, x = n * many, x * many + int(p) - low
        x, out = self.permutation.next("ip" + "".join(str(len(p)) for p in parts), n, x, self.step), []
        for low, many in reversed(ranges):
            x, i = divmod(x, many)
            out.append(str(low + i))
        return ".".join(reversed(out))

    def _date(self, s: str) -> str | None:
        sep = s[4] if s[4] in "-/" and s[:4].isdigit() else s[2]
        parts = s.split(sep)
        if len(parts) != 3:
            return None
        number = list(map(int, parts))
        # day first, but with slashes the month, wherever that is a date
        orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 0, 1), (2, 1, 0)] if sep == "/" else [(2, 1, 0)]
        for turn, order in enumerate(orders):
            try:
                x = (date(*(number[i] for i in order)) - FIRST_DAY).days
            except ValueError:
                continue
            if not 0 <= x < DAYS:
                continue
            day = lambda y: FIRST_DAY + timedelta(days=y)
            y = day(self.permutation.within("date", DAYS, x, lambda y, t=turn: not t or day(y).day > 12, self.step))
            fresh = [""] * 3
            for i, part in zip(order, (f"{y.year:04d}", f"{y.month:02d}", f"{y.day:02d}"), strict=True):
                fresh[i] = part
            return sep.join(fresh)
        return None

    def text(self, t: str | None) -> tuple[str | None, dict[str, int]]:
        found: dict[str, int] = {}
        if not t:
            return t, found

        out, at, done = [], 0, 0
        while m := PATTERN.search(t, at):
            kind, s = m.lastgroup, m.group()
            fresh = self._fresh(kind, s) if kind in self.kinds else None
            if fresh is None:  # what follows the first run of letters or digits may be valid on its own
                at = RUN.search(t, m.start()).end()
                continue
            found[kind] = found.get(kind, 0) + 1
            out += [t[done : m.start()], fresh]
            at = done = m.start() + len(fresh)
        return "".join([*out, t[done:]]) if out else t, found

    def _fresh(self, kind: str, s: str) -> str | None:
        fresh = self.memo.get((kind, s), "")
        if fresh == "":
            fresh = getattr(self, f"_{kind}")(s)
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[kind, s] = fresh
        return fresh


def pseudonymised(df: DataFrame, key: bytes, text_col: str = "text", found_col: str = "found", kinds: tuple[str, ...] = KINDS, restore: bool = False) -> DataFrame:
    """df with its texts' valid values replaced in place, and the number of values of each kind (``found``).

    E-mail addresses keep their domain, and their local part's letters and digits, of any script, become others of
    their kind; phone numbers are told by layout and 8 to 15 digits; IBANs and cards are those whose check digits hold, social security numbers and
    IPv4 addresses those in range, dates those of 1900 to 2099. Null texts stay null, empty ones empty; all else of a
    text and its length are kept. ``restore`` undoes it with the same key. A column named as ``found_col`` gives way.
    """

    def make():
        own = Pseudonymiser(key, kinds, -1 if restore else 1)

        def run(texts):
            out = [own.text(t) if t is None or t.find("@") >= 0 or DIGIT.search(t) else (t, {}) for t in texts]
            return [[t for t, _ in out], [[(k, n) for k, n in f.items()] for _, f in out]]

        return run

    return map_texts(df, text_col, [field(text_col, "string"), field(found_col, "map<string,bigint>")], make)


RUN, DIGIT = re.compile(r"[^\W_]+|.", re.S), re.compile(r"\d")


def counts(df: DataFrame, found_col: str = "found") -> list:
    """Columns n_<kind> from the map of numbers of values."""
    return [F.coalesce(F.col(found_col)[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
