"""Text to instant, as Catalyst expressions only.

`with_instants(df, ...)` adds a timestamp column (UTC), null where the text names no instant. Every step
is a built-in expression, so the parse runs in the JVM with no Python worker. The steps are separate
projections, because one nested expression would repeat its inner parts many times.

Rules
-----
* blank, null and unusable texts, dates that do not exist and instants outside the years asked for (2010..2100): null.
* a clock time without zone is in `zone` (null or unknown zone: UTC); a date alone is its midnight there.
* an offset in the text prevails over a region name in brackets beside it.
* a clock time that occurs twice is the first of the two, a skipped one moves on by the gap
  (`to_utc_timestamp` has exactly these rules).
* numeric dates that start with day or month: month first where `month_first`, else day first.
* pure numbers: digits that spell a date (8, 12, 14 or 17 of them) are that clock time; else seconds,
  milliseconds or microseconds by size. Parts finer than a microsecond are dropped.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Month names by language, in calendar order; three letters suffice where they are unambiguous.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}

#: Minutes east of UTC of the zone abbreviations that occur in news and web dates.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

YEARS = (2010, 2100)

_SPACE = r"[\s   -​    　﻿]"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z_/+-]+|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?)?"
_TAIL = r"(?:[ ]*" + _ZONE + r")?(?:[ ]*\[([A-Za-z_/+-]+)\])?(?:[ ]*\([^)]*\))?$"


@cache
def month_numbers() -> dict[str, int]:
    """Every spelling of a month to its number: full names and all prefixes of three or more letters."""
    found: dict[str, set[int]] = {}
    for names in MONTHS.values():
        for number, name in enumerate(names.split(), 1):
            for n in range(3, len(name) + 1):
                found.setdefault(name[:n], set()).add(number)
    out = {k: min(v) for k, v in found.items() if len(v) == 1}
    return out | {"sept": 9, "mrz": 3, "ago": 8}


@cache
def zone_ids() -> tuple[str, ...]:
    """Region ids the JVM knows; `to_utc_timestamp` fails on any other."""
    spark = SparkSession.getActiveSession()
    try:
        return tuple(sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in str(z) or str(z) == "UTC"))
    except Exception:
        import zoneinfo

        return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z or z == "UTC"))


def valid_zone(zone: Column) -> Column:
    return F.when(zone.isin(*zone_ids()), zone)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


#: Shapes of a date: pattern, and the order of its groups as year, month, day, hour, minute, second,
#: fraction, half of the day, zone, region. `\x1f` parts them.
def _fields(*groups: str) -> str:
    return "\x1f".join(groups)


_REST = r"(?: ?([AaPp])\.?[Mm]\.?)?(?: Uhr| h)?" + _TAIL[:-1]
SHAPES = {
    "ymd": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:[Tt ]|, )" + _CLOCK + _TAIL[:-1] + r")?$", _fields("$1", "$2", "$3", "$4", "$5", "$6", "$7", "", "$8", "$9")),
    "digits": (r"^(20\d{2}|2100)(\d{2})(\d{2})(?:(\d{2})(\d{2})(?:(\d{2})(\d{3})?)?)?$", _fields("$1", "$2", "$3", "$4", "$5", "$6", "$7", "", "", "")),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2}):?(\d{2}):?(\d{2})?(?:[.,](\d+))?" + _TAIL, _fields("$1", "$2", "$3", "$4", "$5", "$6", "$7", "", "$8", "$9")),
    "dmy": (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:,? " + _CLOCK + _REST + r")?$", _fields("$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    "day_name": (r"^(?:\p{L}+\.?, )?(\d{1,2})\.?(?: de)? (\p{L}+)\.?,?(?: de)? (\d{4})(?:,? (?:um |à |at )?" + _CLOCK + _REST + r")?$", _fields("$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    "name_day": (r"^(?:\p{L}+\.?, )?(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:,? (?:at )?" + _CLOCK + _REST + r")?$", _fields("$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    "han": (r"^(\d{4})年(\d{1,2})月(\d{1,2})[日号](?: ?(\d{1,2})[:时時](\d{2})(?:[:分](\d{2}))?[秒分]?)?$", _fields("$1", "$2", "$3", "$4", "$5", "$6", "", "", "", "")),
}
_NUMBER = r"^[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d{1,3})?$"


def _once(column: Column) -> Column:
    """The same value, but not deterministic in the optimiser's eyes: a later filter on the result is not
    pushed below the step with the step's whole expression copied into it, which would grow beyond what
    can be compiled."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def with_instants(df: DataFrame, raw: str, zone: str, month_first: str, out: str, years: tuple[int, int] = YEARS, latest: Column | None = None) -> DataFrame:
    """`df` with the timestamp column `out`, null outside `years` or after `latest`. The columns may have any name; clashing helper names are avoided."""
    from marlspike.session import free_name

    text, parts, got, at = (free_name(df, x) for x in ("_text", "_parts", "_got", "_at"))
    keep = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*keep, F.regexp_replace(F.regexp_replace(F.col(raw), rf"^{_SPACE}+|{_SPACE}+$", ""), rf"{_SPACE}+", " ").alias(text))

    t = F.col(text)
    chosen = None
    for name, (pattern, order) in SHAPES.items():
        fields = F.split(F.regexp_replace(t, pattern, order), "\x1f")
        if name == "dmy":
            pairs = order.split("\x1f")
            swapped = _fields(pairs[0], pairs[2], pairs[1], *pairs[3:])
            fields = F.when(F.col(month_first), F.split(F.regexp_replace(t, pattern, swapped), "\x1f")).otherwise(fields)
        chosen = F.when(t.rlike(pattern), fields) if chosen is None else chosen.when(t.rlike(pattern), fields)
    step = step.select(*keep, text, _once(chosen).alias(parts))

    def field(n: int) -> Column:
        return F.get(F.col(parts), F.lit(n))

    def number(n: int) -> Column:
        return field(n).try_cast("int")

    month = F.coalesce(number(1), F.try_element_at(_map(month_numbers()), F.lower(field(1))))
    z = field(8)
    offset_text = F.regexp_extract(z, r"^(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)$", 1)
    step = step.select(
        *keep, text, parts,
        _once(F.struct(
            number(0).alias("y"), month.alias("mo"), number(2).alias("d"), F.coalesce(number(3), F.lit(0)).alias("h"), F.coalesce(number(4), F.lit(0)).alias("mi"),
            F.coalesce(number(5), F.lit(0)).alias("s"), F.rpad(F.substring(field(6), 1, 6), 6, "0").alias("f"), F.lower(field(7)).alias("half"), z.alias("z"), offset_text.alias("o"),
            F.regexp_replace(offset_text, "[+:-]", "").alias("bare"), F.try_element_at(_map(ABBREVIATIONS), F.upper(z)).alias("abbreviation"),
            F.coalesce(valid_zone(z), valid_zone(field(9))).alias("named"), F.coalesce(valid_zone(F.col(zone)), F.lit("UTC")).alias("own"),
        )).alias(got),
    )

    g = F.col(got)
    half, hour = g["half"], g["h"]
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    # the clock reading in microseconds, without a time zone and so without the session's
    day = F.try_make_timestamp_ntz(g["y"], g["mo"], g["d"], F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date")
    clock = F.when((hour < 24) & (g["mi"] < 60) & (g["s"] < 60), ((hour * 60 + g["mi"]) * 60 + g["s"]).cast("bigint") * 1_000_000 + g["f"].cast("bigint"))
    reading = F.unix_date(day).cast("bigint") * 86_400_000_000 + clock
    minutes = F.when(F.length(g["bare"]) <= 2, g["bare"].try_cast("int") * 60).otherwise(F.left(g["bare"], F.length(g["bare"]) - 2).try_cast("int") * 60 + F.right(g["bare"], F.lit(2)).try_cast("int"))
    minutes = F.when(minutes <= 18 * 60, F.when(F.startswith(g["o"], F.lit("-")), -minutes).otherwise(minutes))
    step = step.select(*keep, text, parts, got, _once(F.struct(reading.alias("reading"), F.when(g["o"] != "", minutes).otherwise(g["abbreviation"]).alias("offset"))).alias(at))

    a = F.col(at)
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(a["reading"]), F.coalesce(g["named"], g["own"])))
    spelled = F.when(a["offset"].isNotNull(), a["reading"] - a["offset"].cast("bigint") * 60_000_000).when((g["z"] != "") & g["named"].isNull(), None).otherwise(local)
    value = F.when(t.rlike(_NUMBER), t.try_cast("decimal(38,9)"))
    size = F.abs(value)
    counted = F.floor(F.when(size < 10**11, value * 1_000_000).when(size < 10**14, value * 1000).when(size < 10**17, value)).try_cast("bigint")
    step = step.select(*keep, _once(F.when(F.col(parts).isNotNull(), spelled).otherwise(counted)).alias(at))
    inside = (a >= _micros(years[0])) & (a < _micros(years[1] + 1))
    if latest is not None:
        inside = inside & (a <= F.unix_micros(latest))
    return step.select(*keep, F.timestamp_micros(F.when(inside, a)).alias(out))


def _micros(year: int) -> int:
    from datetime import datetime, timezone

    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
