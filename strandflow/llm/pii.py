"""Personal data replaced by format-preserving pseudonyms.

A validated value (a card number that passes its check, a calendar date, ...) is numbered within
its format, the number is permuted by a keyed Feistel network over the format's size, and the result
is written back in the same format. The permutation depends on the key and the format only, so equal
values stay linked across documents, different values stay different, and the key's holder can
reverse it with ``invert=True``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm.common import extended, ship, table

ROUNDS = 8
#: What the sample query uses where the session has no key. It is public: never for data of others.
SAMPLE_KEY = b"strandflow: replace this key"
KEY_SETTING = "strandflow.pii.key"


class Permutation:
    """A keyed permutation of 0 .. size-1: Feistel rounds over a x b >= size, walked until inside."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        if size >= 1 << 380:
            raise ValueError("a format of 2^380 values or more can't be permuted")
        self.size = size
        self.a = max(1, math.isqrt(max(size - 1, 0)) + 1)
        self.b = max(1, -(-size // self.a))
        self.key = hashlib.blake2b(label.encode() + size.to_bytes(64, "big"), key=key[:64], digest_size=32).digest()

    def _f(self, turn: int, value: int, size: int) -> int:
        data = bytes([turn]) + value.to_bytes(48, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=56).digest(), "big") % size

    def forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._f(i, right, self.a)) % self.a
                right = (right + self._f(i + 1, left, self.b)) % self.b
            x = left * self.b + right
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(i + 1, left, self.b)) % self.b
                left = (left - self._f(i, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.size:
                return x


def luhn_digit(digits: str) -> int:
    """The check digit that makes ``digits`` and it pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 if i % 2 else 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def _long_enough(address: str) -> bool:
    """Whether a written IPv6 address would be found again."""
    return any(c in _DIGITS for c in address) and len([x for x in address.split(":") if x]) >= 3 and "." not in address


def _refill(shape: str, digits: str) -> str:
    """``digits`` put where ``shape`` has digits."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = "0123456789abcdef"
#: Days that dates are permuted within.
_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_MONTHS = "january february march april may june july august september october november december".split()
#: Months by name: in full, by three letters (May is in full), and the one that also has four.
_SPELLINGS = [{x: i for i, x in enumerate(_MONTHS, 1)}, {x[:3]: i for i, x in enumerate(_MONTHS, 1) if x != "may"}, {"sept": 9}]


def _day(year: int, month: int, day: int) -> dt.date | None:
    """A day that there is, from _FIRST to _LAST."""
    try:
        found = dt.date(year, month, day)
    except ValueError:
        return None
    return found if _FIRST <= found.toordinal() <= _LAST else None


def _th(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


class Pseudonyms:
    """Replaces values in texts. ``found`` counts them by kind."""

    def __init__(self, key: bytes, invert: bool = False) -> None:
        self.key, self.invert = key, invert
        self.known: dict[tuple[str, int], Permutation] = {}
        self.found: Counter = Counter()

    def permute(self, label: str, size: int, value: int, valid: Callable[[int], bool] | None = None) -> int:
        """The pseudonym of ``value``; with ``valid``, walked on to the next valid one."""
        p = self.known.get((label, size))
        if p is None:
            p = self.known[label, size] = Permutation(self.key, label, size)
        step = p.backward if self.invert else p.forward
        value = step(value)
        while valid and not valid(value):
            value = step(value)
        return value

    def characters(self, label: str, text: str, alphabets: list[str]) -> str:
        """A text permuted among those with a character of the same alphabet at each place."""
        size = math.prod(len(a) for a in alphabets)
        value = 0
        for c, a in zip(text, alphabets, strict=True):
            value = value * len(a) + a.index(c)
        value = self.permute(f"{label} {'/'.join(f'{a[0]}{len(a)}' for a in alphabets)}", size, value)
        out = []
        for a in reversed(alphabets):
            value, i = divmod(value, len(a))
            out.append(a[i])
        return "".join(reversed(out))

    def mixed(self, label: str, text: str, hexadecimal: bool = False) -> str:
        """Letters and digits permuted within their kind, up to 48 at a time; the rest stays."""
        spots = [i for i, c in enumerate(text) if c in _DIGITS or c in _LOWER or c in _UPPER]
        kept = "".join(text[i] for i in spots)
        as_hex = hexadecimal and len(kept) > 7 and all(c in _HEX for c in kept)
        out = list(text)
        for i in range(0, len(kept), 48):
            part = kept[i : i + 48]
            alphabets = [_HEX if as_hex else _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER for c in part]
            for spot, c in zip(spots[i : i + 48], self.characters(f"{label} {i}", part, alphabets), strict=True):
                out[spot] = c
        return "".join(out)

    # -- kinds: each gives the pseudonym, or None where the value isn't valid ---------------------

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        if ".." in domain or domain.startswith((".", "-")) or ".." in local:
            return None
        return f"{self.mixed('email', local)}@{domain}"

    def service_key(self, s: str) -> str | None:
        start = s.rindex("_") + 1
        return s[:start] + self.mixed("service key", s[start:])

    def access_key(self, s: str) -> str | None:
        alphabet = _UPPER + _DIGITS
        return s[:4] + self.characters("access key", s[4:], [alphabet] * len(s[4:]))

    def secret(self, s: str) -> str | None:
        m = _SECRET.fullmatch(s)
        value = m["value"]
        if not any(c in _DIGITS for c in value) and not any(c in _UPPER for c in value):
            return None  # a word, as in "password: required"
        start = m.start("value")
        return s[:start] + self.mixed("secret", value, hexadecimal=True) + s[start + len(value) :]

    def card(self, s: str) -> str | None:
        digits = "".join(c for c in s if c in _DIGITS)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        n, issuer = len(digits) - 2, digits[0]  # the first digit, which tells the issuer's kind, stays
        made = issuer + str(self.permute(f"card {issuer}", 10**n, int(digits[1:-1]), lambda v: len(set((t := issuer + str(v).zfill(n)) + str(luhn_digit(t)))) > 1)).zfill(n)
        return _refill(s, made + str(luhn_digit(made)))

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4]))
        if not 15 <= len(plain) <= 34 or number % 97 != 1:
            return None
        body = self.mixed("iban " + plain[:2], plain[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        it = iter(plain[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in s)

    def phone(self, s: str) -> str | None:
        digits = "".join(c for c in s if c in _DIGITS)
        if re.fullmatch(r"0[0-9]{2,4}(?: [0-9]{3,4}){2}", s) and not re.fullmatch(r"[0-9]{3} [0-9]{3} [0-9]{4}", s):  # a national number; its first 0 stays
            return _refill(s, "0" + str(self.permute("phone 0", 10 ** (len(digits) - 1), int(digits[1:]))).zfill(len(digits) - 1))
        head = re.match(r"\+([0-9]{1,3})(?=[ .(-])", s)
        country = head[1] if head else "1" if s.startswith("+1") else digits[:2] if s.startswith("+") else ""
        local = digits[len(country) :]
        if not (7 <= len(local) and len(digits) <= 15):
            return None
        american = country in ("", "1") and len(local) == 10
        # area codes and exchanges from 200 up, and the others, are permuted among themselves
        assigned = lambda v: (t := str(v).zfill(10))[0] >= "2" and t[3] >= "2"
        known = assigned(int(local))
        valid = (lambda v: assigned(v) == known) if american else None
        n = len(local)
        made = str(self.permute("phone " + (country or "1" if american else country), 10**n, int(local), valid)).zfill(n)
        return _refill(s, country + made)

    def social(self, s: str) -> str | None:
        valid = lambda v: (t := str(v).zfill(9))[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"
        value = int(s.replace("-", ""))
        return _refill(s, str(self.permute("social", 10**9, value, valid)).zfill(9)) if valid(value) else None

    def bare_social(self, s: str) -> str | None:
        made = self.social(s[-9:])
        return made and s[:-9] + made

    def address6(self, s: str) -> str | None:
        """An IPv6 address; its pseudonym is written in the usual short form."""
        try:
            value = int(ipaddress.IPv6Address(s))
        except ValueError:
            return None
        if not any(c in _DIGITS for c in s) or len([x for x in s.split(":") if x]) < 3:
            return None  # a::b may be anything
        return str(ipaddress.IPv6Address(self.permute("address6", 1 << 128, value, lambda v: _long_enough(str(ipaddress.IPv6Address(v))))))

    def address(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        value = self.permute("address", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(str(b) for b in value.to_bytes(4, "big"))

    def day(self, day: dt.date, valid: Callable[[dt.date], bool]) -> dt.date:
        """The pseudonym of a day, among those that are ``valid``."""
        at = lambda v: dt.date.fromordinal(_FIRST + v)
        return at(self.permute("date", _LAST - _FIRST + 1, day.toordinal() - _FIRST, lambda v: valid(at(v))))

    def date(self, s: str) -> str | None:
        if any(c in _LOWER or c in _UPPER for c in s):
            return self.written_date(s)
        a, b, c = re.split(r"[-/.]", s)
        sep = s[len(a)]
        # 2024-01-31, else 31.01.2024, 31-01-2024 or 31/01/2024, else 01-31-2024 or 01/31/2024
        for i, order in enumerate(("ymd",) if len(a) == 4 else ("mdy", "dmy") if sep == "/" else ("dmy", "mdy") if sep == "-" else ("dmy",)):
            at = dict(zip(order, (a, b, c), strict=True))
            day = _day(int(at["y"]), int(at["m"]), int(at["d"]))
            if day is None:
                continue
            short = lambda x: (x.day < 10, x.month < 10)
            bare = len(at["m"]) == 1 or len(at["d"]) == 1  # then both stay as long as they are
            new = self.day(day, lambda x: (not bare or short(x) == short(day)) and (not i or x.day > 12))  # noqa: B023
            text = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(at['m'])}d}", "d": f"{new.day:0{len(at['d'])}d}"}
            return sep.join(text[x] for x in order)
        return None

    def written_date(self, s: str) -> str | None:
        """A date with its month in letters. Days below 10, and months of one spelling, stay among themselves."""
        m = next(m for x in _WRITTEN if (m := x.fullmatch(s)))
        word = m["month"]
        names = next(x for x in _SPELLINGS if word.lower() in x)
        day = _day(int(m["year"]), names[word.lower()], int(m["day"]))
        if day is None or m["th"] and m["th"] != _th(day.day):
            return None
        spelt = {v: k for k, v in names.items()}
        new = self.day(day, lambda x: x.month in spelt and (x.day < 10) == (day.day < 10))
        name = spelt[new.month]
        made = {"month": name.upper() if word.isupper() else name if word.islower() else name.title(), "day": f"{new.day:0{len(m['day'])}d}", "th": m["th"] and _th(new.day), "year": f"{new.year:04d}"}
        for part in sorted((x for x in made if m[x]), key=m.start, reverse=True):
            s = s[: m.start(part)] + made[part] + s[m.end(part) :]
        return s

    def text(self, s: str) -> str:
        def put(m: re.Match) -> str:
            kind = m.lastgroup
            made = getattr(self, kind)(m[0])
            if made is None:
                return m[0]
            self.found[kind] += 1
            return made

        return _ANY.sub(put, s)


_SECRET = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?(?P<value>[A-Za-z0-9+/_.-]{8,}={0,2})")
_MONTH = r"(?:" + "|".join(f"{x}|{x.upper()}|{x.title()}" for x in sorted({n for names in _SPELLINGS for n in names}, key=lambda n: (-len(n), n))) + r")"
_WRITTEN_DAY = r"(?:0?[1-9]|[12][0-9]|3[01])"
_WRITTEN = [
    re.compile(rf"(?P<day>{_WRITTEN_DAY})(?P<th>st|nd|rd|th)?[ -](?P<month>{_MONTH})\.?,?[ -](?P<year>[0-9]{{4}})"),
    re.compile(rf"(?P<month>{_MONTH})\.? (?P<day>{_WRITTEN_DAY})(?P<th>st|nd|rd|th)?,? (?P<year>[0-9]{{4}})"),
]
_ANY = re.compile(
    r"(?P<secret>(?<![A-Za-z])(?:" + _SECRET.pattern.replace("?P<value>", "?:") + r"))"
    r"|(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<service_key>(?<![A-Za-z0-9])(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]_[A-Za-z0-9]{16,})(?![A-Za-z0-9]))"
    r"|(?P<access_key>(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .(-])[0-9]{1,3}(?:[ -]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![0-9] )(?:[0-9]{3} [0-9]{3} [0-9]{4}|0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4})(?! [0-9]))(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<address>(?<![0-9.A-Za-z])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<address6>(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:|:)(?:[0-9A-Fa-f]{0,4}:){1,6}(?:[0-9A-Fa-f]{1,4})?(?![0-9A-Za-z:]|\.[0-9]))"
    r"|(?P<bare_social>(?<![A-Za-z])(?i:ssn|social security(?: number| no\.?)?)[ :#]{1,3}[0-9]{9}(?![0-9A-Za-z]))"
    r"|(?P<social>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
    r"|(?<![0-9A-Za-z])(?<![0-9]\.)(?:" + "|".join(re.sub(r"\?P<\w+>", "?:", x.pattern) for x in _WRITTEN) + r")(?![0-9A-Za-z]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]))"
)
#: Texts without any of these have nothing to replace.
_HINT = r"[0-9@=:]|AKIA|ASIA|_"


def pseudonymised(docs: DataFrame, key: bytes | None = None, invert: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with its ``text`` replaced, other columns as they are; with ``counts``, the column
    ``n_replaced`` is appended (one of that name is replaced). Null texts stay null and count 0;
    texts may be of any length; repeated rows are each replaced; an empty table gives an empty one.
    The key is the argument, else the session's ``strandflow.pii.key``; without either it is an error."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, "").encode()
    if not key:
        raise ValueError(f"pseudonyms need a key: pass one or set {KEY_SETTING}")
    ship(docs.sparkSession)
    docs = docs.drop("n_replaced") if counts else docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, invert)
        for b in batches:
            texts = b.column(at)
            some = pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_pylist()
            out, many = [], []
            for x, has in zip(texts, some, strict=True):
                before = work.found.total()
                x = x.as_py()
                out.append(work.text(x) if has else x)
                many.append(work.found.total() - before)
            columns = [*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int64())] if counts else columns, [*b.schema.names, "n_replaced"] if counts else b.schema.names)

    return docs.mapInArrow(run, extended(docs, "n_replaced long") if counts else docs.schema)


def sample_key(spark: SparkSession) -> bytes:
    """The session's key, else the public one of the sample queries."""
    return spark.conf.get(KEY_SETTING, SAMPLE_KEY.decode()).encode()


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with pseudonyms; nulls and repeated rows as in ``pseudonymised``."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), sample_key(spark))
