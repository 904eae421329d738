"""One raw time, as some export wrote it, to microseconds since 1970 in UTC.

The helper works on single strings; :mod:`corpusloom.operators.timestamps` calls it once per distinct
(string, zone, locale) of a whole corpus.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
#: Instants accepted, in microseconds: the years 2021 to 2025. They settle the unit of bare numbers.
EARLIEST = (datetime(2021, 1, 1) - EPOCH) // timedelta(microseconds=1)
LATEST = (datetime(2026, 1, 1) - EPOCH) // timedelta(microseconds=1)

#: Month names and short forms in the export languages (accents removed), by month number.
MONTHS = {
    1: "january jan januar janner janvier janv enero ene",
    2: "february feb februar fevrier fevr febrero",
    3: "march mar marz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez decembre diciembre dic",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}

#: Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150, "brt": -180, "art": -180,
}

NUMBER = re.compile(r"[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?")
CLOCK = r"(?P<hour>\d{1,2})[:h](?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,](?P<fraction>\d+))?)?(?: ?(?P<half>[ap])\.? ?m\.?)?"
ZONE = r"(?: ?(?P<zone>(?:utc|gmt)? ?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}))?(?: ?\[(?P<region>[^\]]+)\])?"
SEPARATOR = r"(?:,? ?(?:t|at|um|a las|a|,|de)? ?)"
FORMS = [
    re.compile(rf"(?P<year>\d{{4}})(?P<mark>[-/.])(?P<month>\d{{1,2}})(?P=mark)(?P<day>\d{{1,2}})(?:t| |, ?){CLOCK}{ZONE}"),
    re.compile(rf"(?P<year>\d{{4}})(?P<month>\d\d)(?P<day>\d\d)[t ]?(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d)(?:[.,](?P<fraction>\d+))?(?P<half>)?{ZONE}"),
    re.compile(rf"(?P<first>\d{{1,2}})(?P<mark>[-/.])(?P<then>\d{{1,2}})(?P=mark)(?P<year>\d{{4}}|\d\d),? {CLOCK}{ZONE}"),
    re.compile(rf"(?:[a-z]+\.?,? )?(?P<day>\d{{1,2}})(?:\.|st|nd|rd|th|er)?[ -](?:de )?(?P<name>[a-z]+)\.?,?[ -](?:de )?(?P<year>\d{{4}}){SEPARATOR}{CLOCK}{ZONE}"),
    re.compile(rf"(?:[a-z]+\.?,? )??(?P<name>[a-z]+)\.? (?P<day>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<year>\d{{4}}){SEPARATOR}{CLOCK}{ZONE}"),
]


@lru_cache(1024)
def region_zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # not the name of a zone
        return None


def offset_minutes(zone: str) -> int | None:
    """Minutes east of UTC that a zone written in the text stands for; None if it is no zone."""
    bare = zone.replace(" ", "")
    m = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", bare)
    if not m:
        return ABBREVIATIONS.get(bare)
    hours, minutes = int(m[2]), int(m[3] or 0)
    if hours > 18 or minutes > 59:
        return None
    return (hours * 60 + minutes) * (1 if m[1] == "+" else -1)


def from_number(text: str) -> int | None:
    """Seconds, milli-, micro- or nanoseconds, whichever gives an instant in range; finer digits are cut off."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    if not 0 < value < Decimal(10) ** 20:
        return None
    for factor in (Decimal(10) ** 6, Decimal(10) ** 3, Decimal(1), Decimal(10) ** -3):
        if EARLIEST <= (micros := int(value * factor)) < LATEST:
            return micros
    return None


def wall_to_micros(wall: datetime, zone: ZoneInfo) -> int | None:
    """The earlier instant of a wall time that occurs twice; None for one that never occurs."""
    instant = wall.replace(tzinfo=zone, fold=0).astimezone(timezone.utc)
    if instant.astimezone(zone).replace(tzinfo=None) != wall:
        return None
    return (instant.replace(tzinfo=None) - EPOCH) // timedelta(microseconds=1)


def parse_instant(raw: str | None, client_tz: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970 of ``raw``, or None where it denotes no instant of 2021 to 2025.

    An offset or zone in the text wins over ``client_tz``, which wins over UTC. ``locale`` settles the order
    of day and month (month first only in en_US). Null, blank and unreadable texts give None.
    """
    if raw is None:
        return None
    text = " ".join(unicodedata.normalize("NFKC", raw).split())
    if not text:
        return None
    if NUMBER.fullmatch(text):
        micros = from_number(text)
        if micros is not None or not re.fullmatch(r"20\d{12}", text):
            return micros
    if len(text) > 100:
        return None
    text = text.lower()
    region = re.search(r"\[([^\]]+)\]$", " ".join(raw.split()))  # zone names are case-sensitive
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    for form in FORMS:
        m = form.fullmatch(text)
        if not m:
            continue
        part = m.groupdict()
        year = int(part["year"])
        year += 2000 if year < 100 else 0
        if part.get("name"):
            month, day = MONTH_OF.get(part["name"]), int(part["day"])
            if month is None:
                continue
        elif part.get("first"):
            month, day = int(part["then"]), int(part["first"])
            if (locale or "").replace("-", "_").startswith("en_US") and part["mark"] != ".":
                month, day = day, month
        else:
            month, day = int(part["month"]), int(part["day"])
        hour = int(part["hour"])
        if part["half"]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if part["half"] == "p" else 0)
        micro = int(((part["fraction"] or "") + "000000")[:6])
        try:
            wall = datetime(year, month, day, hour, int(part["minute"]), int(part["second"] or 0), micro)
        except ValueError:
            return None
        if part["zone"]:
            offset = offset_minutes(part["zone"])
            if offset is None:
                return None
            micros = (wall - timedelta(minutes=offset) - EPOCH) // timedelta(microseconds=1)
        else:
            zone = region_zone(region[1]) if region else region_zone(client_tz) if client_tz else None
            micros = wall_to_micros(wall, zone or region_zone("UTC"))
        return micros if micros is not None and EARLIEST <= micros < LATEST else None
    return None
