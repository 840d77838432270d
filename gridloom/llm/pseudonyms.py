"""Format-preserving pseudonyms for personal data.

Finds mail addresses, IPv4 addresses, payment card numbers (Luhn), IBANs (mod 97), phone numbers, social security numbers, calendar dates
and long hexadecimal secrets; each is checked before it counts. A found value is permuted within its own
format by a keyed Feistel network over its digits and letters (check digits are made anew; a pseudonym that would not pass the value's own check is
permuted again until one does), so that the text keeps its shape, equal values stay equal in all documents, and the key reverses it. Dates are
permuted as days, whatever the way they are written, so one date is one pseudonym in all of them; days up to the 12th stay among
such days, as else month and day could change places on the way back.

Defined results: null stays null with no findings, an empty text stays empty; a value that fails its check is left as it is, but a value between
spaces inside it is found; the same key gives the same pseudonym everywhere, so repeated rows get
equal results; whole texts are searched, however long; an empty table gives no rows; input columns named text or n_<kind> give way to the
operator's.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import DataFrame

from ._arrow import per_text
from ._shared import make_room

ROUNDS = 10
CHECKED = ("card", "iban")
KINDS = ("email", "iban", "card", "ssn", "ipv4", "date", "phone", "secret")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![\w/-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9]))"
    r"|(?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![\w]|[.-][0-9]))",
    re.ASCII,
)
MAYBE = re.compile(rb"[0-9@]").search
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def feistel(values: list[int], radices: list[int], key: bytes, inverse: bool = False) -> list[int]:
    """A keyed permutation of the mixed-radix number ``values``: halves add pads made of each other."""
    half = (len(values) + 1) // 2
    parts, sizes = [values[:half], values[half:]], [radices[:half], radices[half:]]
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        to, by = r % 2, 1 - r % 2
        seed = b"%d|%d|" % (r, len(values)) + b",".join(b"%d" % x for x in radices) + b"|" + b",".join(b"%d" % x for x in parts[by])
        pad = hashlib.shake_256(key + b"|" + seed).digest(8 * len(parts[to]))
        pads = [int.from_bytes(pad[8 * i : 8 * i + 8], "big") for i in range(len(parts[to]))]
        parts[to] = [(v - p if inverse else v + p) % n for v, p, n in zip(parts[to], pads, sizes[to], strict=True)]
    return parts[0] + parts[1]


def permute_text(s: str, key: bytes, alphabets: tuple[str, ...] = ALPHABETS, inverse: bool = False) -> str:
    """Permutes the characters that belong to an alphabet, each within its own; others stay."""
    where = {c: (k, i) for k, a in enumerate(alphabets) for i, c in enumerate(a)}
    at = [i for i, c in enumerate(s) if c in where]
    kinds = [where[s[i]][0] for i in at]
    out = list(s)
    for i, k, v in zip(at, kinds, feistel([where[s[i]][1] for i in at], [len(alphabets[k]) for k in kinds], key, inverse), strict=True):
        out[i] = alphabets[k][v]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _refill(shape: str, chars: str) -> str:
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def _card(s: str, key: bytes, inverse: bool) -> str | None:
    d = re.sub("[ -]", "", s)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = permute_text(d[:-1], key, inverse=inverse)
    return _refill(s, body + next(c for c in "0123456789" if luhn(body + c)))


def _iban(s: str, key: bytes, inverse: bool) -> str | None:
    v = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = permute_text(v[4:], key, inverse=inverse)
    return _refill(s, v[:2] + f"{98 - number(body + v[:2] + '00') % 97:02d}" + body)


def _ipv4(s: str, key: bytes, inverse: bool) -> str | None:
    v = [int(x) for x in s.split(".")]
    if max(v) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    return ".".join(map(str, feistel(v, [256] * 4, key, inverse)))


def _date(s: str, key: bytes, inverse: bool) -> str | None:
    p = re.split("[/.-]", s)
    iso = len(p[0]) == 4
    orders = [(0, 1, 2)] if iso else [(2, 1, 0), (2, 0, 1)]  # day first if that is a date
    for y, m, d in orders:
        try:
            day = dt.date(int(p[y]), int(p[m]), int(p[d])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        loose = lambda x: dt.date.fromordinal(x).day <= 12
        n, kind = day, loose(day)
        while True:
            hi, lo = divmod(n - FIRST_DAY, 512)
            hi, lo = feistel([hi, lo], [(LAST_DAY - FIRST_DAY) // 512 + 1, 512], key, inverse)
            n = FIRST_DAY + hi * 512 + lo
            if n <= LAST_DAY and loose(n) == kind:
                break
        got = dt.date.fromordinal(n)
        new = {y: f"{got.year:04d}", m: f"{got.month:02d}", d: f"{got.day:02d}"}
        seps = re.findall("[/.-]", s)
        return new[0] + seps[0] + new[1] + seps[1] + new[2]
    return None


def _walk(s: str, valid, step) -> str | None:
    """``step`` taken from a valid value until the next valid one: a permutation of the valid values."""
    if not valid(s):
        return None
    s = step(s)
    while not valid(s):
        s = step(s)
    return s


def _ssn(s: str, key: bytes, inverse: bool) -> str | None:
    valid = lambda x: not (x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000")
    return _walk(s, valid, lambda x: permute_text(x, key, inverse=inverse))


def _phone(s: str, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 9 <= len(digits) <= 15 or digits == s:  # bare digits are no phone number
        return None
    head = re.match(r"\+[0-9]{1,3}(?=[ .-])", s)  # the country code stays
    n = head.end() if head else 0
    return s[:n] + permute_text(s[n:], key, inverse=inverse)


def _email(s: str, key: bytes, inverse: bool) -> str | None:
    name, _, domain = s.partition("@")
    host, dot, top = domain.rpartition(".")
    return permute_text(f"{name}@{host}", key, inverse=inverse) + dot + top


def _secret(s: str, key: bytes, inverse: bool) -> str | None:
    alphabet = "0123456789ABCDEF" if re.search("[A-F]", s) else "0123456789abcdef"
    mixed = lambda x: re.search("[0-9]", x) and re.search("[A-Fa-f]", x)
    return _walk(s, mixed, lambda x: permute_text(x, key, (alphabet,), inverse))


MAKE = {"card": _card, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "email": _email, "secret": _secret}


#: The pattern of each kind alone.
ALONE = {k: re.compile(m[1], re.ASCII) for k in KINDS if (m := re.search(rf"\(\?P<{k}>(.*?)\)(?=\|\(\?P<|$)", PATTERN.pattern))}


def _within(text: str, begin: int, end: int, key: bytes) -> tuple[str, int, int, str] | None:
    """(kind, begin, end, pseudonym) of the first, then longest value between spaces inside a match that failed.

    Only kinds with check digits may hold spaces here: any part of a failed number would look like a phone number.
    """
    edges = [begin, *(i + 1 for i in range(begin, end) if text[i] == " ")]
    stops = [*(i for i in range(end - 1, begin, -1) if text[i] == " ")]
    for lo in edges:
        for hi in [end, *stops] if lo > begin else stops:
            if hi <= lo:
                break
            for kind, pattern in ALONE.items():
                if (kind in CHECKED or " " not in text[lo:hi]) and pattern.fullmatch(text, lo, hi) and (new := MAKE[kind](text[lo:hi], key + kind.encode(), False)) is not None:
                    return kind, lo, hi, new
    return None


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """(text with pseudonyms, findings by kind)."""
    found = dict.fromkeys(KINDS, 0)
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        kind, begin, end = m.lastgroup, m.start(), m.end()
        new = MAKE[kind](m[0], key + kind.encode(), False)
        if new is None:
            if (some := _within(text, begin, end, key)) is None:
                at = end
                continue
            kind, begin, end, new = some
        found[kind] += 1
        out += [text[done:begin], new]
        done = at = end
    return "".join([*out, text[done:]]), found


def pseudonymise_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, then the new ``text`` and ``n_<kind>`` for each kind."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    docs = make_room(docs, *[f"n_{k}" for k in KINDS])
    secret = hashlib.sha256(key.encode()).digest()
    out = StructType([f for f in docs.schema if f.name != text]).add("text", StringType())
    for k in KINDS:
        out = out.add(f"n_{k}", LongType())

    def use(value: bytes | None) -> tuple:
        if value is None or not MAYBE(value):
            return (None if value is None else value.decode("utf-8", "replace"), *[0] * len(KINDS))
        new, found = pseudonymise(value.decode("utf-8", "replace"), secret)
        return (new, *found.values())

    return docs.mapInArrow(lambda batches: per_text(batches, to_arrow_schema(out), use, text), out)
