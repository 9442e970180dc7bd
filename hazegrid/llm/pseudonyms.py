"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes the checks of its kind (check digit, digit ranges, calendar) is read as a number of the
kind's domain, permuted there by a keyed Feistel network, and written back in its own format: same length,
separators and letter case, with a valid check digit. The permutation depends on the key and the kind only, so
equal values stay equal in all documents, and who has the key can turn them back. Only where numbers stand side
by side so that a card or IBAN could be read across their border, and for dates with one-digit fields or the day
before the slash, may a value get another pseudonym than in other places or formats.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 .. size - 1 that maps no number to itself (for sizes of two or more).

    A balanced Feistel network permutes the next power of four; numbers outside the domain are permuted again
    until they fall inside. A step of one between the network and its inverse rules out fixed points.
    """

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(kind.encode() + size.to_bytes(64, "big"), key=key, digest_size=32).digest()

    def _round(self, step: int, value: int) -> int:
        length = (self.half + 7) // 8
        data = bytes([step]) + value.to_bytes(length, "big")
        digest = hashlib.shake_128(self.key + data).digest(length)
        return int.from_bytes(digest, "big") & self.mask

    def _network(self, value: int, forward: bool) -> int:
        while True:
            left, right = value >> self.half, value & self.mask
            if forward:
                for step in range(ROUNDS):
                    left, right = right, left ^ self._round(step, right)
            else:
                for step in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(step, left), left
            value = (left << self.half) | right
            if value < self.size:
                return value

    def apply(self, value: int, back: bool = False) -> int:
        shifted = (self._network(value, True) + (-1 if back else 1)) % self.size
        return self._network(shifted, False)


@functools.lru_cache(maxsize=4096)
def permutation(key: bytes, kind: str, size: int) -> Permutation:
    return Permutation(key, kind, size)


def mixed_radix(digits: list[int], sizes: list[int]) -> int:
    value = 0
    for digit, size in zip(digits, sizes, strict=True):
        value = value * size + digit
    return value


def digits_of(value: int, sizes: list[int]) -> list[int]:
    digits = []
    for size in reversed(sizes):
        value, digit = divmod(value, size)
        digits.append(digit)
    return digits[::-1]


def _product(sizes: list[int]) -> int:
    total = 1
    for size in sizes:
        total *= size
    return total


def _permute(key: bytes, kind: str, digits: list[int], sizes: list[int], back: bool) -> list[int]:
    chosen = permutation(key, kind, _product(sizes))
    return digits_of(chosen.apply(mixed_radix(digits, sizes), back), sizes)


def _filled(shape: str, symbols: str) -> str:
    """``shape`` with its letters and digits replaced by ``symbols`` in order."""
    source = iter(symbols)
    return "".join(next(source) if c.isalnum() else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(text: str, key: bytes, back: bool) -> str:
    digits = re.sub(r"\D", "", text)
    # The first digit names the network and stays.
    body = _permute(key, "card", [int(c) for c in digits[1:-1]], [10] * (len(digits) - 2), back)
    payload = digits[0] + "".join(map(str, body))
    return _filled(text, payload + luhn_digit(payload))


CARD = re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])")
# Sizes of the groups cards are written in, besides one group and groups of four.
CARD_GROUPS = {(4, 6, 5), (4, 6, 4), (6, 13)}


GROUP = re.compile("[0-9]+")


def _card_at(run: str, low: int, state: tuple[int, int]) -> tuple[tuple[int, int], int | None]:
    """The end of a card that begins with the digit group at ``low``: the shortest valid stretch in a card's grouping,
    else the longest stretch of any grouping if it is valid. Shorter ones first, so what follows does not matter.

    ``state``: end of the value before, and of the last longest stretch.
    """
    after, tried = state
    if low < after:
        return state, None
    ends, sizes = [], []
    for group in GROUP.finditer(run, low):
        sizes.append(group.end() - group.start())
        if sum(sizes) > 19:
            break
        fours = set(sizes[:-1]) == {4} and sizes[-1] <= 4
        if sum(sizes) >= 13 and (len(sizes) == 1 or fours or tuple(sizes) in CARD_GROUPS):
            ends.append(group.end())
    whole = CARD.match(run, low) if low >= tried else None
    if whole:
        tried = whole.end()
        ends.append(tried)
    end = next((e for e in ends if _is_card(run[low:e])), None)
    return (after if end is None else end, tried), end


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _is_iban(text: str) -> bool:
    plain = re.sub(r"\s", "", text)
    country, check, account = plain[:2], plain[2:4], plain[4:]
    return 11 <= len(account) <= 30 and f"{_iban_check(country, account):02d}" == check


def _iban(text: str, key: bytes, back: bool) -> str:
    plain = re.sub(r"\s", "", text)
    country, account = plain[:2], plain[4:]
    sizes = [10 if c.isdigit() else 26 for c in account]
    values = [int(c) if c.isdigit() else ord(c) - 65 for c in account]
    new = _permute(key, "iban", values, sizes, back)
    account = "".join(str(v) if size == 10 else chr(65 + v) for v, size in zip(new, sizes, strict=True))
    return _filled(text, f"{country}{_iban_check(country, account):02d}{account}")


IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Length of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban_at(run: str, low: int, state: tuple[int, int]) -> tuple[tuple[int, int], int | None]:
    """The end of an IBAN that begins at ``low``: by the country's length, else as far as the run looks like one.

    Where the country is not known, every end of a word is tried, the next ones first.
    """
    match = IBAN.match(run, low) if low >= state[0] else None
    if not match:
        return state, None
    ends = [e for e in range(low + 15, match.end() + 1) if e == match.end() or run[e] == " "]
    length = IBAN_LENGTHS.get(run[low : low + 2])
    if length:
        ends = [e for e in ends if e - low - run.count(" ", low, e) == length] + [match.end()]
    end = next((e for e in ends if _is_iban(run[low:e])), None)
    return (state if end is None else (end, 0)), end


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """Area and exchange start with 2 to 9 in a real number; others count only where the writing leaves no doubt.

    First digits stay in their group (0 and 1, or 2 to 9), so real numbers become real numbers.
    """
    digits = re.sub(r"\D", "", text)
    national = digits[-10:]
    plain = not text.startswith(("+", "(", "1 ("))
    firsts = [int(national[0]), int(national[3])]
    if len(digits) not in (10, 11) or (len(digits) == 11 and digits[0] != "1") or (plain and min(firsts) < 2):
        return None
    lows, sizes = [2 if f >= 2 else 0 for f in firsts], [8 if f >= 2 else 2 for f in firsts]
    values = [firsts[0] - lows[0], int(national[1:3]), firsts[1] - lows[1], int(national[4:6]), int(national[6:])]
    new = _permute(key, "phone", values, [sizes[0], 100, sizes[1], 100, 10_000], back)
    number = f"{new[0] + lows[0]}{new[1]:02d}{new[2] + lows[1]}{new[3]:02d}{new[4]:04d}"
    return _filled(text, digits[:-10] + number)


def _abroad(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    new = _permute(key, "abroad", [int(c) for c in digits[3:]], [10] * (len(digits) - 3), back)
    return _filled(text, digits[:3] + "".join(map(str, new)))


def _social(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    new = _permute(key, "social", [place, group - 1, serial - 1], [898, 99, 9999], back)
    area = new[0] + 1 + (new[0] >= 665)
    return f"{area:03d}-{new[1] + 1:02d}-{new[2] + 1:04d}"


def _address(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    octets = [int(p) for p in parts]
    if any(o > 255 for o in octets) or any(len(p) > 1 and p[0] == "0" for p in parts) or not octets[0]:
        return None
    # Numbers of as many digits: from 0, 10 or 100 on; the first one is not 0 and stays below or from 224 on.
    lows = [(0, 10, 100)[len(p) - 1] for p in parts]
    ends = [(10, 100, 256)[len(p) - 1] for p in parts]
    lows[0], ends[0] = (224, 256) if octets[0] >= 224 else (max(1, lows[0]), min(224, ends[0]))
    sizes = [b - a for a, b in zip(lows, ends, strict=True)]
    new = _permute(key, "address", [o - a for o, a in zip(octets, lows, strict=True)], sizes, back)
    return ".".join(str(v + a) for v, a in zip(new, lows, strict=True))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1


def _read_date(text: str) -> tuple[tuple[int, int, int], datetime.date] | None:
    """Places of year, month and day, and the day; with slashes month/day, or day/month if that is no date."""
    mark = re.search(r"\D", text)[0]
    parts = text.split(mark)
    for order in [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 0, 1), (2, 1, 0)] if mark == "/" else [(2, 1, 0)]:
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        return (order, day) if FIRST_DAY <= day <= LAST_DAY else None
    return None


def _date_style(text: str) -> list[tuple[int, bool]]:
    """Width of every field; where one has a single digit, a leading zero elsewhere counts too."""
    parts = re.split(r"\D", text)
    return [(len(p), p[0] == "0" and min(map(len, parts)) == 1) for p in parts]


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Days are permuted until one can be written in the same fields and is read in the same order."""
    read = _read_date(text)
    if read is None:
        return None
    (order, day), parts, mark = read, re.split(r"\D", text), re.search(r"\D", text)[0]
    chosen = permutation(key, "date", DAYS)
    while True:
        day = FIRST_DAY + datetime.timedelta(chosen.apply((day - FIRST_DAY).days, back))
        fields = (day.year, day.month, day.day)
        new = mark.join(str(fields[order.index(i)]).zfill(len(parts[i])) for i in range(3))
        if _read_date(new) == (order, day) and _date_style(new) == _date_style(text):
            return new


def _symbols(kind: str, fixed: int = 0) -> Callable[[str, bytes, bool], str | None]:
    """Letters, capitals and digits each stay in their group; the first ``fixed`` characters stay."""

    def change(text: str, key: bytes, back: bool) -> str | None:
        rest = [c for c in text[fixed:] if c.isalnum()]
        groups = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in rest]
        if kind == "hex":
            groups = ["0123456789ABCDEF" if text.upper() == text else "0123456789abcdef"] * len(rest)
        elif kind == "access":
            groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * len(rest)
        sizes = [len(g) for g in groups]
        new = _permute(key, kind, [g.index(c) for g, c in zip(groups, rest, strict=True)], sizes, back)
        return text[:fixed] + _filled(text[fixed:], "".join(g[v] for g, v in zip(groups, new, strict=True)))

    return change


# The form of a date behind a telephone number, which does not belong to it.
DATE = r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])"

# Kind, sign that a text may hold one, pattern of the value or run (its first group), and the change; the first kinds win.
KINDS: list[tuple[str, str | None, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.ASCII), _symbols("email")),
    ("access", "AKIA", re.compile(r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])"), _symbols("access", 4)),
    ("hex", None, re.compile(r"(?i:token|password|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?([0-9a-f]{12,128}|[0-9A-F]{12,128})(?![0-9A-Za-z])"), _symbols("hex")),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}[A-Z0-9]*(?: [A-Z0-9]+)*)(?![A-Za-z0-9])"), _iban),
    ("card", None, re.compile(r"(?<![0-9A-Za-z.-])([0-9](?:[ -]?[0-9]){12,})(?![0-9A-Za-z]|[.-][0-9])"), _card),
    ("phone", None, re.compile(r"(?<![0-9A-Za-z+(])(\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"), _phone),
    ("abroad", "+", re.compile(rf"(?<![0-9A-Za-z+])(\+[2-9](?:[ ()./-]{{0,2}}[0-9]){{7}}(?:(?! {{1,2}}{DATE})[ ()./-]{{0,2}}[0-9]){{0,7}})(?![0-9A-Za-z])"), _abroad),
    ("social", "-", re.compile(r"(?<![0-9A-Za-z-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])"), _social),
    ("address", ".", re.compile(r"(?<![0-9A-Za-z.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])"), _address),
    ("date", None, re.compile(r"(?<![0-9A-Za-z./-])([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?=T[0-9]{2}|(?![A-Za-z]))|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![A-Za-z])|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![A-Za-z]))(?![0-9]|[./-][0-9])"), _date),
]

# Kinds whose pattern gives a run of groups, in which values are found by their check digits: where one may begin.
INSIDE = {"iban": (re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}"), _iban_at), "card": (GROUP, _card_at)}
REACH = 48  # characters that a value in a run has at most

SIGN = re.compile(r"[0-9@]|AKIA")


class _Run:
    """A run of groups in which values are found by check digits; what changes in it must leave it read alike."""

    def __init__(self, start: int, text: str, kind: str):
        self.start, self.text = start, text
        begin, self.step = INSIDE[kind]
        self.begins = [m.start() for m in begin.finditer(text)]
        self.states, self.ends, state = [], [], (0, 0)
        for low in self.begins:
            self.states.append(state)
            state, end = self.step(text, low, state)
            self.ends.append(end)

    def spans(self) -> list[tuple[int, int]]:
        return [(self.start + low, self.start + end) for low, end in zip(self.begins, self.ends, strict=True) if end is not None]

    def changed(self, low: int, new: str) -> str | None:
        """The run with what it holds of a new value at ``low``, or None if it would be read in another way.

        Only what is near can be.
        """
        low -= self.start
        high = min(low + len(new), len(self.text))
        new, low = new[max(0, -low) : high - low], max(0, low)
        text = self.text[:low] + new + self.text[high:]
        first = bisect.bisect_left(self.begins, low - REACH)
        state = self.states[first] if first < len(self.begins) else None
        for i in range(first, len(self.begins)):
            if self.begins[i] >= high and state == self.states[i]:
                break
            state, end = self.step(text, self.begins[i], state)
            if end != self.ends[i]:
                return None
        return text


def _found(text: str, key: bytes, back: bool) -> tuple[list[tuple[int, int, Callable, str]], list[list[_Run]]]:
    """All values of a text in order, and the runs by kind; a value is masked for the kinds after its own."""
    spans, runs = [], []
    for kind, sign, pattern, change in KINDS:
        if sign is not None and sign not in text:
            continue
        if kind in INSIDE:
            runs.append([_Run(m.start(1), m[1], kind) for m in pattern.finditer(text)])
            own = [span for run in runs[-1] for span in run.spans()]
        else:
            own = [m.span(1) for m in pattern.finditer(text) if change(m[1], key, back) is not None]
        pieces, at = [], 0
        for low, high in own:
            pieces += [text[at:low], "x" * (high - low)]
            at = high
        text = "".join([*pieces, text[at:]])
        spans += [(low, high, change, kind) for low, high in own]
    return sorted(spans, key=lambda s: s[:2]), runs


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    """The text with every checked value replaced, and the kinds found, in text order.

    A value in a run of groups is permuted again while the run with it would be read in another way (a stretch
    over its border gets a valid check digit), so that turning back finds the same values. Values go back in the
    opposite order.
    """
    if not SIGN.search(text):
        return text, []
    spans, runs = _found(text, key, back)
    begins = [[r.start for r in own] for own in runs]
    news = {}
    for low, high, change, _ in reversed(spans) if back else spans:
        around = []
        for own, begin in zip(runs, begins, strict=True):
            i = bisect.bisect_left(begin, high) - 1
            while i >= 0 and begin[i] + len(own[i].text) > low:
                around.append(own[i])
                i -= 1
        new = text[low:high]
        while True:
            new = change(new, key, back)
            changed = [r.changed(low, new) for r in around]
            if None not in changed:
                break
        for r, run in zip(around, changed, strict=True):
            r.text = run
        news[low] = new
    pieces, at = [], 0
    for low, high, *_ in spans:
        pieces += [text[at:low], news[low]]
        at = high
    return "".join([*pieces, text[at:]]), [kind for *_, kind in spans]


def pseudonymise(docs: DataFrame, key: bytes, text_column: str = "text", kinds_column: str | None = None, back: bool = False) -> DataFrame:
    """Every row with its text pseudonymised; with ``kinds_column`` also the list of kinds found.

    Null and empty texts stay as they are (no kinds); all other columns pass through, also those named like
    inner names here, since rows are changed by position. ``key`` is 1 to 64 bytes. ``back`` undoes the change.
    """
    place = docs.columns.index(text_column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{fields}, `{kinds_column}` array<string>" if kinds_column else fields

    def change(batches):
        for batch in batches:
            texts, kinds = [], []
            for text in batch.column(place).to_pylist():
                new, found = (text, []) if text is None else pseudonymised(text, key, back)
                texts.append(new)
                kinds.append(found)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, type=batch.column(place).type)
            names = list(batch.schema.names)
            if kinds_column:
                columns.append(pa.array(kinds, type=pa.list_(pa.string())))
                names.append(kinds_column)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(change, schema)
