"""Format-preserving pseudonyms: validated numbers, dates and names of mailboxes are permuted within their format.

A Feistel network under a key permutes the values of a format, so equal values stay equal wherever they stand, and
what was valid (check digit, calendar, ranges) stays valid. No value keeps its own place.
"""

from __future__ import annotations

import datetime
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cellarium.llm.common import and_columns, small_batches

ROUNDS = 8

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![\w-]))
    |(?<!\w)(?i:password|token|secret|api_key)[ \t]{0,3}[=:][ \t]{0,3}["']?(?P<secret>[0-9a-fA-F]{16,})(?!\w)
    |(?<!\w)AKIA(?P<access>[0-9A-Z]{16})(?!\w)
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?!\w)|(?<![\w+])\([0-9]{3}\)[ ]?[0-9]{3}[-. ][0-9]{4}(?!\w)|(?<![\w+.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\w-]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.\d))
    |(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.\d))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<!\w)(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<wide>[ -])[0-9]{6}(?P=wide)[0-9]{5})(?!\w))""",
    re.VERBOSE,
)
_MAY_HOLD = re.compile("[0-9@=:]")
# Days are permuted within an age, so that recent ones stay plausible: from one of these years to the next.
_AGES = [datetime.date(y, 1, 1).toordinal() for y in (1, 1000, 1800, 2200)] + [datetime.date.max.toordinal() + 1]


def may_hold(text: str) -> bool:
    """Whether _PATTERN can match at all: each of its values needs one of these signs, but an access key may be all letters."""
    return _MAY_HOLD.search(text) is not None or "AKIA" in text


class Permutation:
    """Keyed permutation of range(size) without fixed points, by cycle walking on a balanced Feistel network."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _walk(self, value: int, size: int, tweak: str, rounds: range, forward: bool) -> int:
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask, wide = (1 << half) - 1, -(-half // 8)
        while True:
            left, right = value >> half, value & mask
            for i in rounds:
                fixed = right if forward else left
                mac = hashlib.blake2b(f"{tweak}|{size}|{i}|{fixed}".encode(), key=self.key, digest_size=min(64, wide)).digest()
                mixed = int.from_bytes(mac * -(-wide // len(mac)), "big") & mask
                left, right = (right, left ^ mixed) if forward else (right ^ mixed, left)
            value = left << half | right
            if value < size:
                return value

    def __call__(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next valid value on the cycle that the network makes of range(size)."""
        if size < 2:
            return value
        start = value
        while True:
            place = (self._walk(value, size, tweak, range(ROUNDS), True) + 1) % size
            value = self._walk(place, size, tweak, range(ROUNDS - 1, -1, -1), False)
            if value == start or valid(value):
                return value

    def letters(self, text: str, tweak: str) -> str:
        """Digits go to digits, letters to letters of the same case; other characters stay."""
        kinds = [(10, "0") if c in "0123456789" else (26, "a" if c.islower() else "A") if c.isascii() and c.isalpha() else (1, c) for c in text]
        value, size = 0, 1
        for c, (n, zero) in zip(text, kinds, strict=True):
            value, size = value * n + ord(c) - ord(zero), size * n
        value = self(value, size, f"{tweak}{[n for n, _ in kinds]}")
        out = []
        for n, zero in reversed(kinds):
            value, d = divmod(value, n)
            out.append(chr(ord(zero) + d))
        return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    """The check digit that follows payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _refill(text: str, fresh: str) -> str:
    """text with its ASCII letters and digits replaced in order; separators stay."""
    new = iter(fresh)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in text)


class Pseudonyms:
    """The pseudonym of each kind of value; None where a value is not valid, which leaves it as it is."""

    def __init__(self, key: bytes):
        self.permute = Permutation(key)

    def email(self, text: str) -> str:
        name, at, domain = text.partition("@")
        fresh = self.permute.letters(name.lower(), "email")
        return "".join(f.upper() if c.isupper() else f for c, f in zip(name, fresh, strict=True)) + at + domain

    def secret(self, text: str) -> str:
        fresh = self.permute(int(text, 16), 16 ** len(text), "secret")
        return f"{fresh:0{len(text)}{'X' if text.isupper() else 'x'}}"

    def access(self, text: str) -> str:
        return self.permute.letters(text, "access")

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        country, check, account = bare[:2], bare[2:4], bare[4:]
        if len(bare) > 34 or _iban_check(country, account) != check:
            return None
        fresh = self.permute.letters(account, f"iban{country}")
        return _refill(text, country + _iban_check(country, fresh) + fresh)

    def phone(self, text: str) -> str | None:
        country = re.match(r"\+([0-9]{1,3})(?=[ .(-])", text)
        code = country[1] if country else ""
        digits = re.sub("[^0-9]", "", text)[len(code) :]
        if not 7 <= len(digits) + len(code) <= 15 or not digits:
            return None
        plan = len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" and code in ("", "1")
        fits = (lambda v: (s := f"{v:010d}")[0] in "23456789" and s[3] in "23456789") if plan else (lambda v: (f"{v:0{len(digits)}d}"[0] == "0") == (digits[0] == "0"))
        fresh = self.permute(int(digits), 10 ** len(digits), f"phone{plan}{len(digits)}", fits)
        return _refill(text, code + f"{fresh:0{len(digits)}d}")

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        fresh = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, fresh.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        """The day that the text's day goes to, in the same order of fields, so that spellings of a day stay linked.

        A month or day that was written without a leading zero is so again, and may have two digits.
        """
        sep = next(c for c in text if not c.isdigit())
        fields = text.split(sep)
        orders = {"-": ["ymd"], "/": ["mdy", "dmy"], ".": ["dmy"]}[sep]
        for order in orders:
            known = dict(zip(order, fields, strict=True))
            try:
                day = datetime.date(int(known["y"]), int(known["m"]), int(known["d"])).toordinal()
            except ValueError:
                continue
            first, end = next((a, b) for a, b in itertools.pairwise(_AGES) if day < b)
            d = datetime.date.fromordinal(first + self.permute(day - first, end - first, "date"))
            new = {"y": f"{d.year:04d}", "m": f"{d.month:0{len(known['m'])}d}", "d": f"{d.day:0{len(known['d'])}d}"}
            return sep.join(new[x] for x in order)
        return None

    def ssn(self, text: str) -> str | None:
        fits = lambda v: (s := f"{v:09d}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        value = int(text.replace("-", ""))
        return _refill(text, f"{self.permute(value, 10**9, 'ssn', fits):09d}") if fits(value) else None

    def card(self, text: str) -> str | None:
        digits = re.sub("[^0-9]", "", text)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        n = len(digits) - 2
        payload = digits[0] + f"{self.permute(int(digits[1:-1]), 10**n, f'card{digits[0]}'):0{n}d}"
        return _refill(text, payload + luhn_digit(payload))

    def text(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """text with every valid value replaced, and how many of each kind there were."""
        found: dict[str, int] = {}
        if not text or not may_hold(text):
            return text, found

        def replace(m: re.Match) -> str:
            kind = next(k for k, v in m.groupdict().items() if v is not None and k not in ("gap", "wide"))
            fresh = getattr(self, kind)(m[kind])
            if fresh is None:
                return m[0]
            found[kind] = found.get(kind, 0) + 1
            a, b = m.span(kind)
            return m[0][: a - m.start()] + fresh + m[0][b - m.start() :]

        lines = text.split("\n")  # no value goes over a line end
        return "\n".join(_PATTERN.sub(replace, x) if may_hold(x) else x for x in lines), found


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with private values in text replaced by pseudonyms, and pii (map of kind to how many were replaced).

    Covers mailbox names, long hexadecimal secrets and access keys, bank accounts and cards with right check digits,
    telephone numbers, IPv4 addresses, social security numbers and all calendar dates of the years 1 to 9999. Texts without any keep every
    character; a null text stays null with an empty map. Every other column and every row is kept: equal rows get
    equal results, an empty table gives an empty table, a column pii is replaced. Whole texts count, however long.
    """
    small_batches(docs.sparkSession)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "pii"]
            done = [names.text(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([list(k.items()) for _, k in done], pa.map_(pa.string(), pa.int32()))], names=[*kept, "pii"])

    return docs.mapInArrow(replace, and_columns(docs, "pii map<string,int>"))
