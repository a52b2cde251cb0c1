"""Date and time texts to one UTC instant or calendar day (pure Python, no Spark)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

#: Names of months, by language (English, German, French, Spanish).
MONTH_NAMES = (
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
#: Further short forms.
SHORT_MONTHS = {"sept": 9, "mär": 3, "maerz": 3, "jänner": 1, "okt": 10, "dez": 12}

MONTHS = {form: i for names in MONTH_NAMES[::-1] for i, m in enumerate(names.split(), 1) for form in (m, m[:3])} | SHORT_MONTHS
del MONTHS["jui"]  # two French months begin with it

_WORD = r"[^\W\d_]+"
_DATES = [
    re.compile(p)
    for p in (
        r"(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{1,2})(?P=s)(?P<d>[0-9]{1,2})(?![0-9])",
        r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})(?=[tT])",
        r"(?P<a>[0-9]{1,2})(?P<s>[-/.])(?P<b>[0-9]{1,2})(?P=s)(?P<c>[0-9]{4}|[0-9]{2})(?![0-9])",
        rf"(?:{_WORD}\.?,? )?(?P<d>[0-9]{{1,2}})\.?(?: de)?[ -](?P<mon>{_WORD})\.?(?: de)?[ -](?P<y>[0-9]{{4}}|[0-9]{{2}})(?![0-9])",
        rf"(?:{_WORD}, )?(?P<mon>{_WORD})\.? (?P<d>[0-9]{{1,2}}),? (?P<y>[0-9]{{4}})(?![0-9])",
    )
]
_TIME = re.compile(r"(?:[tT]|,? | um |, um )(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]{1,9}))?)?(?: ?(?P<ap>[aApP])\.?[mM]\.?(?![A-Za-z]))?(?: Uhr(?![A-Za-z]))?")
_BASIC_TIME = re.compile(r"[tT](?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?P<s>[0-9]{2})?(?:[.,](?P<f>[0-9]{1,9}))?(?P<ap>)")
_OFFSET = re.compile(r" ?(?:(?:UTC|GMT) ?)?(?P<sign>[+\-−])(?P<h>[0-9]{1,2}):?(?P<m>[0-9]{2})?(?: ?\[[^\]]*\])?\Z")
_REGION = re.compile(r" ?\[?(?P<z>[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+|UTC)\]?\Z")
_ABBREVIATION = re.compile(r" ?(?:\((?P<p>[A-Za-z]{1,5})\)|(?P<z>[A-Za-z]{1,5}))\Z")
_NUMBER = re.compile(r"(?P<n>[0-9]{8,16})(?:\.(?P<f>[0-9]{1,9}))?\Z")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def _abbreviations(zone: str, year: int) -> dict[str, timedelta]:
    """Abbreviations that a zone uses from the year before to the year after."""
    z, out = _zone(zone), {}
    if z is not None:
        for y in (year - 1, year + 1, year):
            if 1 < y < 9999:
                for month in range(1, 13):
                    at = datetime(y, month, 1, tzinfo=z)
                    out[(at.tzname() or "").upper()] = at.utcoffset()
    return out


def _in_zone(local: datetime, name: str) -> timedelta | None:
    """Offset of a local time that occurs exactly once, else None."""
    z = _zone(name)
    if z is None:
        return None
    first, second = (local.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
    return first if first == second else None


def _offset(rest: str, local: datetime, local_zone: str | None) -> timedelta | None:
    if not rest:
        return _in_zone(local, local_zone) if local_zone else None
    if rest in ("Z", "z", " Z"):
        return timedelta(0)
    if m := _OFFSET.match(rest):
        hours, minutes = int(m["h"]), int(m["m"] or 0)
        if hours > 18 or minutes > 59:
            return None
        return (1 if m["sign"] == "+" else -1) * timedelta(hours=hours, minutes=minutes)
    if (m := _REGION.match(rest)) and m["z"] != "UTC":
        return _in_zone(local, m["z"])
    if m := _ABBREVIATION.match(rest.replace("[", "").replace("]", "")):
        short = (m["p"] or m["z"]).upper()
        if short in ("UTC", "GMT"):
            return timedelta(0)
        return _abbreviations(local_zone, local.year).get(short) if local_zone else None
    return None


def _instant(ms: int) -> str | None:
    try:
        at = _EPOCH + timedelta(milliseconds=ms)
    except OverflowError:
        return None
    return f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{at.hour:02d}:{at.minute:02d}:{at.second:02d}.{at.microsecond // 1000:03d}Z"


def _number(m: re.Match[str]) -> str | None:
    digits, n, frac = len(m["n"]), int(m["n"]), m["f"]
    if digits == 8:
        return None if frac else _day(n // 10000, n // 100 % 100, n % 100)
    if digits in (9, 10):
        return _instant(n * 1000 + int(((frac or "") + "000")[:3]))
    if digits in (12, 13):
        return _instant(n)
    return _instant(n // 1000) if digits in (15, 16) else None


def _day(y: int, m: int, d: int) -> str | None:
    try:
        datetime(y, m, d)
    except ValueError:
        return None
    return f"{y:04d}-{m:02d}-{d:02d}"


def _date(m: re.Match[str], order: str | None) -> tuple[int, int, int] | None:
    g = m.groupdict()
    if g.get("mon"):
        month = MONTHS.get(g["mon"].lower())
        return None if month is None else (int(g["y"]) + (2000 if len(g["y"]) == 2 else 0), month, int(g["d"]))
    if g.get("y"):
        return int(g["y"]), int(g["m"]), int(g["d"])
    a, b, c = g["a"], g["b"], g["c"]
    if g["s"] == "." or order == "dmy":
        y, mo, d = c, b, a
    elif order == "mdy":
        y, mo, d = c, a, b
    elif order == "ymd":
        y, mo, d = (a, b, c) if len(c) == 2 and len(a) == 2 else (c, a, b)
    else:
        return None
    return int(y) + (2000 if len(y) == 2 else 0), int(mo), int(d)


def parse_instant(text: str | None, local_zone: str | None = None, date_order: str | None = None) -> str | None:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` for a text with a time of day, ``YYYY-MM-DD`` for one without,
    None if it is not resolvable: no such day or time, no zone known, or a local time without offset
    or abbreviation that occurs twice or never. Patterns are anchored at the first sign, so prose of any
    length fails there."""
    if text is None:
        return None
    t = " ".join(text.split())
    if not t:
        return None
    if m := _NUMBER.match(t):
        return _number(m)
    for pattern in _DATES:
        if not (m := pattern.match(t)):
            continue
        ymd = _date(m, date_order or None)
        if ymd is None:
            return None
        rest = t[m.end() :]
        if not rest:
            return _day(*ymd)
        clock = _TIME.match(rest) or _BASIC_TIME.match(rest)
        if not clock:
            return None
        hour, half = int(clock["h"]), (clock["ap"] or "").lower()
        if half:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half == "p" else 0)
        try:
            local = datetime(*ymd, hour, int(clock["mi"]), int(clock["s"] or 0))
            offset = _offset(rest[clock.end() :], local, local_zone or None)
            if offset is None:
                return None
            utc = local - offset
        except (ValueError, OverflowError):
            return None
        return _instant((utc - _EPOCH) // timedelta(milliseconds=1) + int(((clock["f"] or "") + "000")[:3]))
    return None
