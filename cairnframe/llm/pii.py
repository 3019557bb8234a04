"""Format-preserving pseudonyms for personal data (operator 4).

Validated numbers (payment cards by Luhn, IBANs by mod 97, social security
numbers, telephone numbers, IPv4 addresses), calendar dates and the local parts
of e-mail addresses are replaced within their own format by a keyed Feistel
permutation: digits stay digits, separators stay, check digits are recomputed
and validity holds after the change.  Equal values under one key have equal
pseudonyms in every document, however their separators (and for dates the order
and width of day and month) differ; whoever holds the key can invert them
(``PiiCipher.reveal``).  Slashed dates are day first unless that is no date.

The permutation is a ten-round Feistel network over the value's domain with
keyed BLAKE2b as round function; values that fall outside the domain or fail
validation walk the cycle until they are valid again, so it stays a bijection.

One narrow pass in Arrow batches, no shuffle.  Defined results: a null text
stays null, an empty one empty; repeated rows and null doc_ids give one row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import table

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "date")
#: Key of the registered query; callers pass their own.
DEMO_KEY = b"cairnframe demonstration key"
_ROUNDS = 10
#: Values a cipher remembers; speed only.
_MEMO = 100_000
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31

# (kind, pattern) in order of precedence; a match must pass its validator below.
_PATTERNS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.A)),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)),
    ("card", re.compile(r"(?<![\dA-Za-z.+-])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])", re.A)),
    ("ssn", re.compile(r"(?<![\dA-Za-z-])\d{3}-\d{2}-\d{4}(?![\dA-Za-z-])", re.A)),
    ("ip", re.compile(r"(?<![\dA-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\dA-Za-z]|\.\d)", re.A)),
    ("date", re.compile(r"(?<![\dA-Za-z./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\dA-Za-z]|[./-]\d)", re.A)),
    ("phone", re.compile(r"(?<![\dA-Za-z+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\dA-Za-z])", re.A)),
]
_HAS = re.compile(r"[0-9@]").search
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {
    c: int(n)
    for c, n in (
        x.split(":")
        for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30".split()
    )
}
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?= ?[A-Z0-9])", re.A)
_CARD_RUN = re.compile(r"(?<![\dA-Za-z])\d+(?:[ -]\d+)*", re.A)
#: Groups of digits as cards are written; other windows of groups come after these.
_CARD_SHAPES = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])


@functools.lru_cache(maxsize=1)
def _calendar() -> tuple[list[tuple[tuple[int, bool], int]], dict[tuple[int, bool], list[int]]]:
    """(class and number in it of every day, days of each class).

    Days of a class are written alike in every format: their day and month have as many digits, and
    none or all could be taken for a month.
    """
    place, members = [], {}
    for n in range(_DAYS):
        d = datetime.date.fromordinal(_FIRST + n)
        c = (0 if d.day < 10 else 1 if d.day <= 12 else 2, d.month >= 10)
        place.append((c, len(members.setdefault(c, []))))
        members[c].append(n)
    return place, members


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _spread(shape: str, symbols: str) -> str:
    """The letters and digits of ``shape`` replaced in order by ``symbols``; separators stay."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def luhn_check(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _card_windows(text: str) -> Iterator[tuple[int, int]]:
    """Where card numbers may stand: windows of digit groups in every run of them, usual shapes first, then the longest."""
    for run in _CARD_RUN.finditer(text):
        if sum(c.isdigit() for c in run[0]) < 13:
            continue
        groups = [m.span() for m in re.finditer(r"\d+", run[0])]
        found = []
        for a in range(len(groups)):
            if a == 0 and text[run.start() - 1 : run.start()] in (".", "+", "-"):
                continue
            n = 0
            for b in range(a, len(groups)):
                n += groups[b][1] - groups[b][0]
                i, j = run.start() + groups[a][0], run.start() + groups[b][1]
                if n > 19:
                    break
                if n >= 13 and not (text[j : j + 1].isascii() and text[j : j + 1].isalpha()):
                    shape = [y - x for x, y in groups[a : b + 1]]
                    usual = a == b or shape in _CARD_SHAPES
                    # rows of short numbers hold a valid window by chance too often
                    if usual or a == 0 or min(shape) >= 4:
                        found.append((not usual, -n, i, j))
        yield from ((i, j) for *_, i, j in sorted(found))


def _iban_windows(text: str) -> Iterator[tuple[int, int]]:
    """Where IBANs may stand: of their country's length, or for other countries up to any end of a group, the longest first."""
    for m in _IBAN_START.finditer(text):
        length, n, ends = _IBAN_LENGTHS.get(m[0][:2]), 0, []
        for k in range(m.start(), len(text)):
            c = text[k]
            if "A" <= c <= "Z" or "0" <= c <= "9":
                n += 1
                behind = text[k + 1 : k + 2]
                if n > (length or 34):
                    break
                if n >= (length or 15) and not (behind.isascii() and behind.isalnum()):
                    ends.append(k + 1)
            elif c != " " or text[k - 1] == " ":
                break
        yield from ((m.start(), e) for e in reversed(ends))


class PiiCipher:
    """Keyed bijections within the formats of ``KINDS``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.memo: dict[tuple, int] = {}

    def _round(self, keyed, i: int, half: int, bits: int) -> int:
        out = b""
        while len(out) * 8 < bits:
            h = keyed.copy()
            h.update(bytes([i, len(out) & 255, len(out) >> 8]) + half.to_bytes((bits + 7) // 8, "little"))
            out += h.digest()
        return int.from_bytes(out, "little") & ((1 << bits) - 1)

    def _feistel(self, n: int, bits: int, keyed, back: bool) -> int:
        low = (1 << bits) - 1
        a, b = n >> bits, n & low
        for i in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            if back:
                a, b = b ^ self._round(keyed, i, a, bits), a
            else:
                a, b = b, a ^ self._round(keyed, i, b, bits)
        return a << bits | b

    def permute(self, n: int, size: int, tweak: str, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """Image of n in 0..size-1; only values for which ``valid`` holds are ever returned. One ``valid`` goes with one tweak."""
        if size <= 1:
            return n
        asked = (n, size, tweak, back)
        if (known := self.memo.get(asked)) is not None:
            return known
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        keyed = hashlib.blake2b(len(tweak.encode()).to_bytes(2, "little") + tweak.encode(), key=self.key, digest_size=64)
        while True:
            n = self._feistel(n, bits, keyed, back)
            if n < size and (valid is None or valid(n)):
                break
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        self.memo[asked] = n
        return n

    def _symbols(self, s: str, tweak: str, back: bool, valid: Callable[[str], bool] | None = None) -> str:
        """Characters permuted within their classes: digits, lower-case, upper-case letters."""
        base = [10 if c.isdigit() else 26 for c in s]
        zero = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in s]
        size = math.prod(base)
        n = 0
        for c, k, z in zip(s, base, zero, strict=True):
            n = n * k + ord(c) - ord(z)

        def text(n: int) -> str:
            out = []
            for k, z in zip(reversed(base), reversed(zero), strict=True):
                n, d = divmod(n, k)
                out.append(chr(ord(z) + d))
            return "".join(reversed(out))

        shape = "".join(zero)
        return text(self.permute(n, size, f"{tweak}:{shape}", back, valid and (lambda n: valid(text(n)))))

    # each returns the pseudonym, or None if the match is no valid value of its kind

    def email(self, s: str, back: bool) -> str | None:
        local, _, domain = s.partition("@")
        core = "".join(c for c in local if c.isalnum())
        return _spread(local, self._symbols(core, "email@" + domain.lower(), back)) + "@" + domain if core else None

    def iban(self, s: str, back: bool) -> str | None:
        core = s.replace(" ", "")
        if not 15 <= len(core) <= 34 or _mod97(core[4:] + core[:4]) != 1:
            return None
        body = self._symbols(core[4:], "iban" + core[:2], back)
        return _spread(s, f"{core[:2]}{98 - _mod97(body + core[:2] + '00'):02d}{body}")

    def card(self, s: str, back: bool) -> str | None:
        d = _digits(s)
        if luhn_check(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = d[0] + self._symbols(d[1:-1], "card" + d[0], back, lambda x: len(set(d[0] + x)) > 1)
        return _spread(s, body + luhn_check(body))

    def ssn(self, s: str, back: bool) -> str | None:
        good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = _digits(s)
        return _spread(s, self._symbols(d, "ssn", back, good)) if good(d) else None

    def ip(self, s: str, back: bool) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if any(p > 255 for p in parts) or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        n = int.from_bytes(bytes(parts), "big")
        return ".".join(map(str, self.permute(n, 1 << 32, "ip", back).to_bytes(4, "big")))

    def phone(self, s: str, back: bool) -> str | None:
        m = re.match(r"\+(\d{1,3})(?=[ .(-])", s)
        country = m[1] if m else ("" if s[0] != "+" else s[1])
        head = len(country) + (s[0] == "+")
        d = _digits(s[head:])
        if not 6 <= len(d) or not 7 <= len(d) + len(country) <= 15:
            return None
        nanp = country in ("", "1")
        good = lambda x: x[0] in "23456789" and x[3] in "23456789"
        if nanp and not (len(d) == 10 and good(d)):
            return None
        # with or without +1 a number of the North American plan is the same value
        return s[:head] + _spread(s[head:], self._symbols(d, "phone" + ("1" if nanp else country), back, good if nanp else None))

    def date(self, s: str, back: bool) -> str | None:
        """One permutation of the calendar for all ways to write a date; day, month and year keep their widths."""
        one, two, three = re.split("[-/.]", s)
        iso = "-" in s
        y, m, d = (int(one), int(two), int(three)) if iso else (int(three), int(two), int(one))
        swapped = m > 12 >= d and "/" in s
        if swapped:
            m, d = d, m
        try:
            n = datetime.date(y, m, d).toordinal() - _FIRST
        except ValueError:
            return None
        if not 0 <= n < _DAYS:
            return None
        place, members = _calendar()
        c, k = place[n]
        new = datetime.date.fromordinal(_FIRST + members[c][self.permute(k, len(members[c]), f"date{c}", back)])
        if iso:
            return new.isoformat()
        sep = "/" if "/" in s else "."
        a, b = (new.month, new.day) if swapped else (new.day, new.month)
        return f"{a:0{len(one)}d}{sep}{b:0{len(two)}d}{sep}{new.year:04d}"

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """(new text, spans of the old one as (start, end, kind))."""
        if not _HAS(text):
            return text, []
        taken: list[tuple[int, int, str, str]] = []  # by start; of kinds before this one
        for kind, pattern in _PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            act = getattr(self, kind)
            windows = {"card": _card_windows, "iban": _iban_windows}.get(kind)
            starts = [t[0] for t in taken]
            mine: list[tuple[int, int, str, str]] = []
            for i, j in windows(text) if windows else (m.span() for m in pattern.finditer(text)):
                # spans do not overlap, so only the last that starts before j can reach beyond i
                k = bisect.bisect_left(starts, j) - 1
                if k >= 0 and taken[k][1] > i:
                    continue
                at = bisect.bisect_left(mine, (j,))
                if at and mine[at - 1][1] > i:
                    continue
                new = act(text[i:j], back)
                if new is not None:
                    mine.insert(at, (i, j, kind, new))
            taken = sorted(taken + mine) if mine else taken
        out, at = [], 0
        for i, j, _, new in taken:
            out += (text[at:i], new)
            at = j
        out.append(text[at:])
        return "".join(out), [(i, j, k) for i, j, k, _ in taken]

    def reveal(self, text: str) -> str:
        """The text with every pseudonym turned back."""
        return self.replace(text, back=True)[0]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, spans array<struct<start, stop, kind>>): new texts and where the old ones had personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = PiiCipher(key)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            texts, spans = [], []
            for t in batch.column(1):
                new, found = (None, []) if t.as_py() is None else cipher.replace(t.as_py())
                texts.append(new)
                spans.append([{"start": i, "stop": j, "kind": k} for i, j, k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    schema = "doc_id long, text string, spans array<struct<start:int,stop:int,kind:string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_found, one count per kind, spans."""
    out = pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_found"), *[n(k) for k in KINDS], spans.alias("spans"))
