"""Scalar functions over texts and times: ISO times, local hours, durations, flag lists, canonical documents, seeds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.views import SECOND, micros

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?$"
_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*[hdwm]?$"


def iso_micros(text: Column) -> Column:
    """Microseconds since the epoch of an ISO time; without a zone it is UTC, bad text is null."""

    def part(i: int, default: str) -> Column:
        found = F.regexp_extract(text, _ISO, i)
        return F.when(found == "", default).otherwise(found)

    local = F.concat(F.regexp_extract(text, _ISO, 1), F.lit(" "), part(2, "00:00"), part(3, ":00")).try_cast("timestamp_ntz")
    zone = F.regexp_extract(text, _ISO, 4)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(zone.isin("", "Z"), 0).when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes)
    return micros(local) - shift.cast("long") * 60 * SECOND


def at(us: Column) -> Column:
    """Microseconds as a timestamp without a zone, whatever the session's zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / SECOND).cast("decimal(18,6)"))


def iso_text(us: Column) -> Column:
    """ISO time in UTC, with a fraction only where there is one."""
    fraction = F.pmod(us, F.lit(SECOND))
    whole = F.replace(at(us - fraction).cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(whole, F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def local_hour(us: Column, zone: str = "America/New_York") -> Column:
    """Hour of the day in a zone, with its summer time."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), at(us)))


def age_hours(us: Column, now_us: int) -> Column:
    """Hours from a time to now; unknown times are very old."""
    return F.coalesce((F.lit(now_us) - us) / (3600.0 * SECOND), F.lit(1e9))


def duration_days(text: Column) -> Column:
    """Days in 30, 30d, 48h, 2w or 3m (months of 30 days); anything else, null too, is 30 days."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, _NUMBER, 1).try_cast("double")
    days = F.when(t.endswith("h"), n / 24).when(t.endswith("w"), n * 7).when(t.endswith("m"), n * 30).otherwise(n)
    return F.coalesce(days, F.lit(30.0))


def distinct_flags(text: Column) -> Column:
    """A list joined by ;, each flag once, in the order in which they first appear."""
    return F.array_join(F.array_distinct(F.filter(F.split(text, ";"), lambda x: x != "")), ";")


def derived_seed(*parts: Column) -> Column:
    """A whole number of 48 bits from the parts, joined by |; null parts count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 12), 16, 10).cast("long")


def canonical_row(*names: str) -> Column:
    """Columns of whole numbers, booleans and texts as one JSON text with sorted keys and no spaces; nulls are kept."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def canonical_json(document: object) -> str:
    """The same for a document that the driver holds, such as a policy."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


def document_sha256(document: object) -> str:
    return hashlib.sha256(canonical_json(document).encode()).hexdigest()
