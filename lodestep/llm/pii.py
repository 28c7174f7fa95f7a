"""Personal data replaced by format-preserving Feistel pseudonyms.

Values are found by pattern and then validated: card numbers by the Luhn check,
bank accounts by their country's length and check digits, addresses by their
parts, dates by the calendar.  A value is numbered within all values of its
format, the number is permuted by a keyed Feistel network, and the result is
written in the same format: same length, punctuation and character kinds, valid
check digits, real dates.  Equal values of a kind become equal pseudonyms in
every document, also where they are written with other separators (days: in
another order of their parts), and ``reveal`` undoes them with the key.

The network works on the least even number of bits that holds the format's
values; a result outside is permuted again until it falls inside (cycle
walking), so that the whole is a permutation of the format.

Emails keep their domain and are linked without regard to case; phone numbers
keep their country's code, and those of ten digits without one are linked with
code 1; accounts keep their country.  IPv6 addresses are written in their
canonical form, which has no fixed length.  Of ``03/04/1999`` the first is the
month, unless it is above 12; days written like ``25/04/1999`` are permuted among
themselves.  Matches don't overlap; the leftmost wins, then the order of
``KINDS``.

Null text stays null and has no spans; empty text stays empty; an empty table
gives an empty one; repeated rows get the same pseudonyms; texts are scanned
whole, however long.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ensure_importable

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

# Lengths of bank account numbers by country, and the telephone codes of one and two digits; all others have three.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
PHONE_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _iban_pattern() -> str:
    by: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(country)
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(rf'(?:{chr(124).join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}' for n, c in by.items())})(?![A-Za-z0-9])"


# The patterns of the kinds.
KINDS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}(?P<sep>[ -]?)[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7}|[0-9]{4}(?P<gap>[ -])[0-9]{6}(?P=gap)[0-9]{5})(?![0-9-])",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-]|\.[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
}
#: What a text must have for a kind to be looked for, and what a match begins with.
_HINTS = {"email": r"@", "iban": r"[A-Z]{2}[0-9]{2}", "ipv6": r":[0-9A-Fa-f]{0,4}:"}
_BEGINS = {"email": r"[A-Za-z0-9]", "iban": r"[A-Z]{2}[0-9]", "ipv6": r"[0-9A-Fa-f:]"}
_HINT = {kind: re.compile(p).search for kind, p in _HINTS.items()}
_DIGIT = re.compile("[0-9]").search


@functools.lru_cache(maxsize=64)
def _finder(kinds: tuple[str, ...]) -> re.Pattern:
    """Finds the kinds, each alternative tried only where it can begin."""
    return re.compile("|".join(rf"(?={_BEGINS.get(k, '[0-9+(]')})(?P<{k}>{KINDS[k]})" for k in kinds))


class Feistel:
    """A keyed permutation of 0 .. size - 1."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(f"{tweak}/{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        data = i.to_bytes(1, "big") + x.to_bytes((self.half + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=max(8, (self.half + 7) // 8)).digest(), "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(i, left), left
            else:
                left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def permute(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _octets(value: str) -> list[int] | None:
    parts = value.split(".")
    return [int(p) for p in parts] if all(p == str(int(p)) and int(p) < 256 for p in parts) else None


def _parts(value: str) -> tuple[str, str, str]:
    """Which of year, month and day stands where in a date."""
    if value[4] in "-/":
        return "y", "m", "d"
    return ("d", "m", "y") if value[2] == "." or int(value[:2]) > 12 else ("m", "d", "y")


def _day(value: str) -> datetime.date | None:
    at = dict(zip(_parts(value), map(int, re.split("[-/.]", value))))
    y, m, d = at["y"], at["m"], at["d"]
    if FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
        return datetime.date(y, m, d)
    return None


def iban_check(account: str) -> int:
    """Remainder by 97 of an account number with its country and check digits moved to the end: 1 if valid."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def phone_code(digits: str) -> int:
    """Digits of the country's code."""
    return next((n for n in (1, 2) if digits[:n] in PHONE_CODES), 3)


class Pseudonymiser:
    """Finds and replaces values under one key."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = tuple(KINDS)):
        if not key:
            raise ValueError("the key is empty")
        self.key, self.kinds = key, frozenset(kinds)
        self._feistel = functools.lru_cache(maxsize=4096)(functools.partial(Feistel, key))
        self.replaced = functools.lru_cache(maxsize=100_000)(self.replace)

    def __reduce__(self):
        return Pseudonymiser, (self.key, tuple(self.kinds))

    def valid(self, kind: str, value: str) -> bool:
        digits = re.sub(r"\D", "", value)
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])
        if kind == "ssn":
            return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        if kind == "ip":
            return _octets(value) is not None
        if kind == "iban":
            return iban_check(value.replace(" ", "")) == 1
        if kind == "ipv6":
            try:
                ipaddress.IPv6Address(value)
            except ValueError:
                return False
            return sum(c != ":" for c in value) > 4 and sum(map(bool, value.split(":"))) > 1
        if kind == "date":
            return _day(value) is not None
        if kind == "phone":
            return 8 <= len(digits) <= 15
        return True

    def _mixed(self, kind: str, chars: str, back: bool) -> str:
        """Letters become letters of their case and digits digits, as one number of mixed radix."""
        radix = [10 if c.isdigit() else 26 for c in chars if c.isascii() and c.isalnum()]
        size, x = 1, 0
        for c, r in zip((c for c in chars if c.isascii() and c.isalnum()), radix):
            x = x * r + (int(c) if r == 10 else ord(c.lower()) - 97)
            size *= r
        x = self._feistel(f"{kind}:{''.join('9' if r == 10 else 'a' for r in radix)}", size).permute(x, back)
        out = []
        for r in reversed(radix):
            x, d = divmod(x, r)
            out.append(str(d) if r == 10 else chr(97 + d))
        fill = iter(reversed(out))
        return "".join((next(fill).upper() if c.isupper() else next(fill)) if c.isascii() and c.isalnum() else c for c in chars)

    def _walked(self, kind: str, x: int, back: bool) -> int:
        """An address whose canonical form is found again."""
        network = self._feistel(kind, 1 << 128)
        x = network.permute(x, back)
        while not self.valid(kind, str(ipaddress.IPv6Address(x))):
            x = network.permute(x, back)
        return x

    def _into(self, shape: str, digits: str) -> str:
        fill = iter(digits)
        return "".join(next(fill) if c.isdigit() else c for c in shape)

    def replace(self, kind: str, value: str, back: bool = False) -> str:
        """The pseudonym of a valid value, or with ``back`` the value of a pseudonym."""
        digits = re.sub(r"\D", "", value)
        if kind == "email":
            local, _, domain = value.partition("@")
            return f"{self._mixed(kind, local.lower(), back)}@{domain}"
        if kind == "card":
            body = self._mixed(kind, digits[:-1], back)
            return self._into(value, body + str(luhn(body)))
        if kind == "ip":
            x = self._feistel(kind, 1 << 32).permute(int.from_bytes(bytes(_octets(value)), "big"), back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "date":
            parts, network, x = _parts(value), self._feistel(kind, (LAST_DAY - FIRST_DAY).days + 1), (_day(value) - FIRST_DAY).days
            odd = value[2] == "/" and parts[0] == "d"
            while True:
                x = network.permute(x, back)
                day = FIRST_DAY + datetime.timedelta(x)
                if not odd or day.day > 12:
                    break
            at = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
            return value[4 if parts[0] == "y" else 2].join(at[p] for p in parts)
        if kind == "ipv6":
            return str(ipaddress.IPv6Address(self._walked(kind, int(ipaddress.IPv6Address(value)), back)))
        if kind == "iban":
            body = self._mixed(kind, re.sub(" ", "", value)[4:], back)
            check = 98 - iban_check(f"{value[:2]}00{body}")
            fill = iter(f"{value[:2]}{check:02d}{body}")
            return "".join(c if c == " " else next(fill) for c in value)
        if kind == "phone":  # the country's code stays
            at = 1 + phone_code(digits) if value[0] == "+" else 0
            return value[:at] + self._mixed(kind, value[at:], back)
        x = self._mixed(kind, digits, back)
        while not self.valid(kind, self._into(value, x)):
            x = self._mixed(kind, x, back)
        return self._into(value, x)

    def values(self, text: str):
        """(kind, start, end) of the valid values."""
        digits = _DIGIT(text) is not None
        kinds = tuple(k for k in KINDS if k in self.kinds and (_HINT[k](text) if k in _HINT else digits))
        if not kinds:
            return
        for m in _finder(kinds).finditer(text):
            if self.valid(m.lastgroup, m.group()):
                yield m.lastgroup, m.start(), m.end()

    def text(self, text: str, back: bool = False) -> tuple[str, list[dict]]:
        """The text with its values replaced, and (kind, start, end) of what is new."""
        out, spans, at, size = [], [], 0, 0
        for kind, a, b in self.values(text):
            new = self.replaced(kind, text[a:b], back)
            out += [text[at:a], new]
            size += a - at
            spans.append({"kind": kind, "start": size, "end": size + len(new)})
            at, size = b, size + len(new)
        return "".join([*out, text[at:]]), spans


def _replaced(text: Column, names: Pseudonymiser, back: bool) -> Column:
    @F.pandas_udf("struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>")
    def run(s: pd.Series) -> pd.DataFrame:
        done = [names.text(t, back) if t is not None else (None, []) for t in s.where(s.notna(), None)]
        return pd.DataFrame({"text": [d[0] for d in done], "spans": [d[1] for d in done]})

    return run(text)


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Replace the values in column ``text`` and add their places there as column ``spans``."""
    ensure_importable(df.sparkSession)
    done = _replaced(df[text], Pseudonymiser(key, kinds), False)
    return df.withColumns({text: done["text"], spans: done["spans"]})


def reveal(df: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Undo ``pseudonymise``; emails come back in lower case and IPv6 addresses in canonical form."""
    ensure_importable(df.sparkSession)
    return df.withColumn(text, _replaced(df[text], Pseudonymiser(key, kinds), True)["text"])
