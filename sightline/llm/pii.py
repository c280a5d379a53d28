r"""Format-preserving pseudonyms for personal data.

A found value is validated (checksums, ranges, calendar), turned into its rank among all values of its format, moved by
a keyed permutation of those ranks, and written back in the form it had. So a card number becomes another valid card
number, a date another date, and equal values become equal pseudonyms in every document, however they are punctuated.

The permutation is a balanced Feistel network on the next even number of bits, walked on until the rank is in range.
A pseudonym is P^-1(P(x) + 1): that is a permutation too, and it leaves no value where it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import documents

ROUNDS = 10
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: Each kind's form; a match still has to pass the kind's check.
FORMS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_](?:[\w.%+-]*[\w+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])",
    "key": r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)",
    "token": r"(?<!\w)(?:ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d{2}(?:\d{2}|:\d{2}|[Zz]|\b))|(?![\w/-]|\.\d))|(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w(.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "phone_abroad": r"(?<![\w(.-])\+[2-9]\d{0,2}(?:[ .-]?\d){7,12}(?![\w-])",
}
_FORM = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()), re.ASCII)

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: int(n)
    for n, countries in {
        "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV", "22": "BG BH CR DE GB GE IE ME RS VA",
        "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV",
        "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU",
    }.items()
    for c in countries.split()
}


def ends(kind: str, found: str) -> list[int]:
    """Lengths of `found` to try, the likeliest first: all of it, or as far as a group of it ends.

    Of a card the shortest is tried first, so that a security code or an expiry that happens to fit the checksum does
    not join it; of an IBAN its country's length is.
    """
    if kind not in ("card", "iban"):
        return [len(found)]
    groups = [i for i in range(1, len(found) + 1) if found[i - 1].isalnum() and (i == len(found) or not found[i].isalnum())]
    if kind == "card":
        return [i for i in groups if sum(map(str.isdigit, found[:i])) >= 13]
    plain = {i: i - found.count(" ", 0, i) for i in groups}
    own = IBAN_LENGTHS.get(found[:2])
    return sorted((i for i in groups if plain[i] >= 15), key=lambda i: (plain[i] != own, -i))


class Permutation:
    """Keyed permutation of 0..size-1, one for each kind and size."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(f"{kind}|{size}".encode(), key=key, digest_size=32).digest()

    def _round(self, i: int, value: int) -> int:
        wide = hashlib.shake_256(self.seed + bytes([i]) + value.to_bytes((self.half + 7) // 8, "big")) if self.half > 256 else hashlib.blake2b(bytes([i]) + value.to_bytes((self.half + 7) // 8, "big"), key=self.seed)
        data = wide.digest((self.half + 7) // 8) if self.half > 256 else wide.digest()
        return int.from_bytes(data, "big") & self.mask

    def _network(self, value: int, rounds) -> int:
        left, right = value >> self.half, value & self.mask
        for i in rounds:
            left, right = right, left ^ self._round(i, right)
        return right << self.half | left

    def forward(self, value: int) -> int:
        while True:
            value = self._network(value, range(ROUNDS))
            if value < self.size:
                return value

    def back(self, value: int) -> int:
        while True:
            value = self._network(value, reversed(range(ROUNDS)))
            if value < self.size:
                return value

    def move(self, value: int, step: int = 1) -> int:
        return self.back((self.forward(value) + step) % self.size)


def _luhn(digits: str) -> int:
    """Check digit that follows `digits`."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(bban: str, country: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + check)) % 97


_CLASSES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _characters(text: str) -> tuple[int, int, list]:
    """Rank and number of all texts with the same class (digit, upper, lower, itself) at each place."""
    rank, size, places = 0, 1, []
    for c in text:
        own = next((k for k in _CLASSES if c in k), c)
        rank, size = rank * len(own) + own.index(c), size * len(own)
        places.append(own)
    return rank, size, places


def _spelled(rank: int, places: list) -> str:
    out = []
    for own in reversed(places):
        rank, i = divmod(rank, len(own))
        out.append(own[i])
    return "".join(reversed(out))


def _refill(form: str, digits: str) -> str:
    """The digits of `form` replaced in turn, its punctuation kept."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.kept: dict[tuple[str, int], Permutation] = {}

    def _move(self, kind: str, rank: int, size: int, step: int) -> int:
        if size < 2:
            return rank
        if (p := self.kept.get((kind, size))) is None:
            if len(self.kept) > 10_000:
                self.kept.clear()
            p = self.kept[kind, size] = Permutation(self.key, kind, size)
        return p.move(rank, step)

    def _by_class(self, kind: str, text: str, step: int) -> str:
        rank, size, places = _characters(text)
        return _spelled(self._move(kind, rank, size, step), places)

    def of(self, kind: str, text: str, step: int = 1) -> str | None:
        """The pseudonym (step -1: the value behind one), or None if the text fails the kind's check."""
        digits = re.sub(r"\D", "", text)
        if kind == "email":
            local, at, domain = text.rpartition("@")
            return None if ".." in local else self._by_class(kind, local, step) + at + domain
        if kind == "key":
            return text[:4] + self._by_class(kind, text[4:], step)
        if kind == "token":
            head = re.match("ghp_|sk-", text)[0]
            return head + self._by_class(kind, text[len(head) :], step)
        if kind == "iban":
            plain = text.replace(" ", "")
            country, check, bban = plain[:2], plain[2:4], plain[4:]
            if _mod97(bban, country, check) != 1:
                return None
            bban = self._by_class(kind, bban, step)
            it = iter(f"{country}{98 - _mod97(bban, country, '00'):02d}{bban}")
            return "".join(c if c == " " else next(it) for c in text)
        if kind == "ip":
            parts = [int(p) for p in text.split(".")]
            if max(parts) > 255:
                return None
            moved = self._move(kind, int.from_bytes(bytes(parts), "big"), 1 << 32, step)
            return ".".join(map(str, moved.to_bytes(4, "big")))
        if kind == "date":
            return self._date(text, step)
        if kind == "card":
            if _luhn(digits[:-1]) != int(digits[-1]) or digits[0] not in "23456":
                return None
            if digits[0] == "2":
                if len(digits) != 16 or not 2221 <= int(digits[:4]) <= 2720:
                    return None
                body = f"{2221 * 10**11 + self._move('card2', int(digits[:-1]) - 2221 * 10**11, 500 * 10**11, step)}"
                return _refill(text, body + str(_luhn(body)))
            middle = digits[1:-1]
            body = digits[0] + f"{self._move(f'card{digits[0]}', int(middle), 10 ** len(middle), step):0{len(middle)}d}"
            return _refill(text, body + str(_luhn(body)))
        if kind == "ssn":
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            rank, serial = divmod(self._move(kind, rank, 898 * 99 * 9999, step), 9999)
            area, group = divmod(rank, 99)
            area += 1 + (area >= 665)
            return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            lead, own = digits[:-10], digits[-10:]
            if own[0] in "01" or own[3] in "01":
                return None
            rank = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
            rank, line = divmod(self._move(kind, rank, 800 * 800 * 10_000, step), 10_000)
            area, office = divmod(rank, 800)
            return _refill(text, f"{lead}{area + 200}{office + 200}{line:04d}")
        if kind == "phone_abroad":
            if not 8 <= len(digits) <= 15:
                return None
            own = digits[2:]
            return _refill(text, digits[:2] + f"{self._move(kind, int(own), 10 ** len(own), step):0{len(own)}d}")
        raise ValueError(kind)

    def _date(self, text: str, step: int) -> str | None:
        mark = next(c for c in text if not c.isdigit())
        parts = text.split(mark)
        # Year first with hyphens, month first with slashes, day first with full stops; a slashed date with no such month has its day first.
        year, month, day = (parts if mark == "-" else (parts[2], parts[0], parts[1]) if mark == "/" else (parts[2], parts[1], parts[0]))
        swapped = mark == "/" and int(month) > 12
        if swapped:
            month, day = day, month
        try:
            at = date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        # A slashed date with its day first keeps that order only if its day cannot be a month: such days are ranked among themselves.
        late = [o for o in range(FIRST_DAY, LAST_DAY + 1) if date.fromordinal(o).day > 12] if swapped else None
        moved = late[self._move("late_date", late.index(at), len(late), step)] if swapped else FIRST_DAY + self._move("date", at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, step)
        d = date.fromordinal(moved)
        padded = all(len(p) >= 2 for p in parts) or mark == "-"
        number = (lambda n: f"{n:02d}") if padded else str
        if mark == "-":
            return f"{d.year:04d}-{d.month:02d}-{d.day:02d}"
        first, second = (d.day, d.month) if mark == "." or swapped else (d.month, d.day)
        return f"{number(first)}{mark}{number(second)}{mark}{d.year:04d}"

    def rewrite(self, text: str, step: int = 1) -> tuple[str, list[dict]]:
        """The text with every valid value replaced, and what was replaced: kind, start (in the new text), length, pseudonym."""
        out, found, at, copied, made = [], [], 0, 0, 0
        while m := _FORM.search(text, at):
            kind = m.lastgroup
            new, end = self._fitting(kind, m, step)
            if new is None:
                new, kind, end = self._other(m, text, step)
                if new is None:
                    at = m.start() + 1
                    continue
            out += [text[copied : m.start()], new]
            made += m.start() - copied
            found.append({"kind": kind, "start": made, "length": len(new), "pseudonym": new})
            made += len(new)
            at = copied = end
        return ("".join([*out, text[copied:]]), found) if found else (text, found)

    def _fitting(self, kind: str, m: re.Match, step: int) -> tuple[str | None, int]:
        """The pseudonym of the match or of the part of it that passes the kind's check, and where that ends."""
        for n in ends(kind, m[0]):
            if (new := self.of(kind, m[0][:n], step)) is not None:
                return new, m.start() + n
        return None, 0

    def _other(self, m: re.Match, text: str, step: int) -> tuple[str | None, str, int]:
        """Another kind that the same place satisfies, when the first one failed its check."""
        for kind in list(FORMS)[list(FORMS).index(m.lastgroup) + 1 :]:
            if n := _ALONE[kind].match(text, m.start()):
                new, end = self._fitting(kind, n, step)
                if new is not None:
                    return new, kind, end
        return None, "", 0


_ALONE = {k: re.compile(v, re.ASCII) for k, v in FORMS.items()}
_FOUND = "array<struct<kind:string,start:int,length:int,pseudonym:string>>"


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", reverse: bool = False) -> DataFrame:
    """One row per document: doc_id, text (rewritten), found (kind, start, length, pseudonym), n_found.

    A null text stays null with nothing found; rows repeat as they come; an empty table gives no rows. `reverse` turns
    pseudonyms of the same key back. Every row is handled alone, so there is no shuffle and nothing to skew.
    """
    step = -1 if reverse else 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                done = [(None, []) if t is None else names.rewrite(t, step) for t in some["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array([t for t, _ in done], pa.string()), pa.array([f for _, f in done], kind)], ["doc_id", "text", "found"])

    rows = documents(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, found {_FOUND}").withColumn("n_found", F.size("found").cast("long"))
