"""Predicates of the condition algebra, as boolean columns.

A missing value never matches, so a negation keeps it (:func:`negate`). Text compares without case
unless asked otherwise. Array fields match if any element does.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_instant, parse_range


def _c(field) -> Column:
    return field if isinstance(field, Column) else F.col(field)


# ---------------------------------------------------------------- groups


def match_all() -> Column:
    return F.lit(True)


def match_none() -> Column:
    return F.lit(False)


def all_of(*conditions: Column) -> Column:
    """AND; of nothing true."""
    return functools.reduce(operator.and_, conditions) if conditions else match_all()


def any_of(*conditions: Column) -> Column:
    """OR; of nothing false."""
    return functools.reduce(operator.or_, conditions) if conditions else match_none()


def negate(condition: Column) -> Column:
    """NOT where a missing value counts as no match, and so is kept."""
    return ~F.coalesce(condition, F.lit(False))


def exclude(*conditions: Column) -> Column:
    """Exclusion parameters: their negations are ORed, so only a row that matches all is left out."""
    return any_of(*[negate(c) for c in conditions]) if conditions else match_all()


# ---------------------------------------------------------------- text


def wildcard_regex(pattern: str) -> str:
    """``*`` any text, ``?`` one character, a backslash escapes; all else literal; whole value."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and pattern[i + 1] in "*?\\":
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _text(field, test: Callable[[Column], Column], array: bool) -> Column:
    return F.exists(_c(field), test) if array else test(_c(field))


def string_eq(field, value: str, case_sensitive: bool = False, array: bool = False) -> Column:
    low = (lambda c: c) if case_sensitive else F.lower
    return _text(field, lambda c: low(c) == low(F.lit(value)), array)


def string_like(field, pattern: str, case_sensitive: bool = False, array: bool = False) -> Column:
    r = wildcard_regex(pattern if case_sensitive else pattern.lower())
    return _text(field, lambda c: (c if case_sensitive else F.lower(c)).rlike(r), array)


def string_in(field, values: Iterable[str], case_sensitive: bool = False, array: bool = False) -> Column:
    values = list(values) if case_sensitive else [v.lower() for v in values]
    return _text(field, lambda c: (c if case_sensitive else F.lower(c)).isin(values), array)


def multi_value(field, values: Iterable, op: str = "or", make: Callable = string_eq, **options) -> Column:
    """Several values of one parameter, ORed unless ``op`` is ``and``."""
    return (all_of if op == "and" else any_of)(*[make(field, v, **options) for v in values])


def string_range(field, low: str | None, high: str | None, exclusive: bool = False) -> Column:
    return _range(_c(field), low, high, exclusive)


def match(field, text: str) -> Column:
    """Any word of ``text`` is among the field's words."""
    return F.arrays_overlap(F.split(F.lower(_c(field)), r"\s+"), F.array(*[F.lit(w) for w in text.lower().split()]))


def match_prefix(field, text: str) -> Column:
    """The words of ``text`` stand in the field in order, the last as a prefix."""
    words = [re.escape(w) for w in text.lower().split()]
    return F.lower(_c(field)).rlike(r"(^|\s)" + r"\s+".join(words)) if words else match_none()


def keyword_match(words, query: str) -> Column:
    """Every token of ``query`` matches some element of ``words``; wildcards allowed."""
    def token(t: str) -> Column:
        if "*" in t or "?" in t:
            return F.exists(_c(words), lambda w: w.rlike(wildcard_regex(t)))
        return F.array_contains(_c(words), t)

    return all_of(*[token(t) for t in query.lower().split()])


def keyword_phrase(phrases, query: str) -> Column:
    """A quoted phrase, with wildcards, stands in one of the space-padded ``phrases``."""
    text = query.strip()
    quoted = re.findall(r'"', text)
    if len(quoted) != 2 or not (text.startswith('"') and text.endswith('"')):
        raise ValueError("keyword phrase mixed with words, or several phrases, is not supported")
    inner = text[1:-1].lower().strip()
    middle = wildcard_regex(inner)[5:-1]
    return F.exists(_c(phrases), lambda p: F.lower(p).rlike("(?s) " + middle + " "))


# ---------------------------------------------------------------- presence, booleans, numbers


def boolean_eq(field, value) -> Column:
    """``unset`` (any case) matches all."""
    if isinstance(value, str):
        if value.lower() == "unset":
            return match_all()
        if value.lower() not in ("true", "false"):
            raise ValueError(f"not a boolean: {value}")
        value = value.lower() == "true"
    return _c(field) == F.lit(bool(value))


def exists(field, array: bool = False) -> Column:
    return F.coalesce(F.size(_c(field)) > 0, F.lit(False)) if array else _c(field).isNotNull()


def missing(field, array: bool = False) -> Column:
    return ~exists(field, array)


def num_eq(field, value: float) -> Column:
    return _c(field) == F.lit(value)


def _range(c: Column, low, high, exclusive: bool) -> Column:
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    parts = []
    if low is not None:
        parts.append(c > F.lit(low) if exclusive else c >= F.lit(low))
    if high is not None:
        parts.append(c < F.lit(high) if exclusive else c <= F.lit(high))
    return all_of(*parts)


def num_range(field, low: float | None, high: float | None, exclusive: bool = False) -> Column:
    return _range(_c(field), low, high, exclusive)


def num_range_param(field, text: str) -> Column:
    """``min,max`` with either missing; a single number means equality."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) == 1:
        return num_eq(field, float(parts[0]))
    if len(parts) != 2:
        raise ValueError(f"not a range: {text}")
    low, high = (float(p) if p else None for p in parts)
    return num_range(field, low, high)


def range_intersects(low_field, high_field, low: float, high: float) -> Column:
    """The range of two columns shares a value with [low, high]."""
    a, b = _c(low_field), _c(high_field)
    return any_of(a.between(low, high), b.between(low, high), (a <= low) & (b >= high))


# ---------------------------------------------------------------- dates


def _ts(value) -> Column:
    return F.lit(value if isinstance(value, dt.datetime) else parse_instant(value)).cast("timestamp_ntz")


def date_eq(field, value) -> Column:
    return _c(field) == _ts(value)


EARLIEST = dt.datetime(1970, 1, 1)


def date_range(field, start, end, exclusive: bool = False) -> Column:
    """A null start is the earliest date."""
    c, low = _c(field), _ts(start if start is not None else EARLIEST)
    out = c > low if exclusive else c >= low
    if end is None:
        return out
    return out & (c < _ts(end) if exclusive else c <= _ts(end))


def multi_date_range(field, ranges: Iterable, op: str = "or") -> Column:
    """Ranges as texts (``start,end`` or ISO 8601) or pairs."""
    pairs = [parse_range(r) if isinstance(r, str) else r for r in ranges]
    return (all_of if op == "and" else any_of)(*[date_range(field, a, b) for a, b in pairs])


def updated_since(field, instant) -> Column:
    return _c(field) >= _ts(instant)


def temporal_intersects(start, end, exclusive: bool = False, start_field="start_date", end_field="end_date") -> Column:
    """Rows whose time meets [start, end]: their start must exist, and no end means still running."""
    s, e = _c(start_field), _c(end_field)
    out = [s.isNotNull()]
    if end is not None:
        out.append(s < _ts(end) if exclusive else s <= _ts(end))
    if start is not None:
        out.append(e.isNull() | (e > _ts(start) if exclusive else e >= _ts(start)))
    return all_of(*out)


def temporal_periodic(start: dt.datetime | None, end: dt.datetime | None, start_day: int | None, end_day: int | None, now: dt.datetime, exclusive: bool = False) -> Column:
    """Times that meet the days-of-year window in any year between start and end."""
    from .dates import periodic_windows

    return any_of(*[temporal_intersects(a, b, exclusive) for a, b in periodic_windows(start or EARLIEST, end, start_day, end_day, now)])


def temporal_facet_filter(field, year: int, month: int | None = None, day: int | None = None, hour: int | None = None) -> Column:
    """A year, month, day or hour as a range that ends one millisecond early."""
    a = dt.datetime(year, month or 1, day or 1, hour or 0)
    if hour is not None:
        b = a + dt.timedelta(hours=1)
    elif day is not None:
        b = a + dt.timedelta(days=1)
    elif month is not None:
        b = dt.datetime(year + month // 12, month % 12 + 1, 1)
    else:
        b = dt.datetime(year + 1, 1, 1)
    return date_range(field, a, b - dt.timedelta(milliseconds=1))


# ---------------------------------------------------------------- nested fields


def nested_match(path, **subfields) -> Column:
    """One element of an array of structs has all the given subfields (text without case)."""
    def one(e: Column) -> Column:
        return all_of(*[F.lower(e[k]) == v.lower() if isinstance(v, str) else e[k] == F.lit(v) for k, v in subfields.items()])

    return F.exists(_c(path), one)


def nested_any(path, value: str, fields: list[str]) -> Column:
    """One element has ``value`` in any of its ``fields``."""
    return F.exists(_c(path), lambda e: any_of(*[F.lower(e[f]) == value.lower() for f in fields]))


def readable_name(value: str, ur="granule_ur", producer="producer_id", pattern: bool = False, case_sensitive: bool = False) -> Column:
    """The name or the producer's name of a granule."""
    make = string_like if pattern else string_eq
    return F.coalesce(make(ur, value, case_sensitive), F.lit(False)) | F.coalesce(make(producer, value, case_sensitive), F.lit(False))


DEFAULT_DATA_TYPE = "SCIENCE_QUALITY"


def collection_data_type(value: str, field="data_type") -> Column:
    """The default type also matches rows without one."""
    hit = string_eq(field, value)
    return hit | _c(field).isNull() if value.upper() == DEFAULT_DATA_TYPE else hit


def operational_only(flag: bool = True, field="progress") -> Column:
    """Collections in operation, if asked."""
    return string_eq(field, "ACTIVE") if flag else match_all()


def tag_match(key: str | None = None, value: str | None = None, originator: str | None = None, field="tags", pattern: bool = True) -> Column:
    """One tag struct (key, value, originator) meets all that is given; a key is a pattern by default."""
    def one(e: Column) -> Column:
        out = []
        if key is not None:
            out.append(F.lower(e["key"]).rlike(wildcard_regex(key.lower())) if pattern else F.lower(e["key"]) == key.lower())
        if value is not None:
            out.append(F.lower(e["value"]) == value.lower())
        if originator is not None:
            out.append(F.lower(e["originator"]) == originator.lower())
        return all_of(*out)

    return F.exists(_c(field), one)


def measurement_match(groups: list[dict], op: str = "and", field="measurements") -> Column:
    """Each group of subfields on one measurement; groups are ANDed by default."""
    return (all_of if op == "and" else any_of)(*[nested_match(field, **g) for g in groups])


def pass_match(groups: list[dict], op: str = "or", field="passes") -> Column:
    """Pass number and, if given, a tile, on the same pass."""
    def one(g: dict) -> Column:
        tiles = g.get("tiles") or []
        return F.exists(_c(field), lambda e: all_of(e["pass"] == F.lit(g["pass"]), *([F.arrays_overlap(e["tiles"], F.array(*[F.lit(t) for t in tiles]))] if tiles else [])))

    return (all_of if op == "and" else any_of)(*[one(g) for g in groups])


_SLOT = {"string": "string_value", "float": "float_value", "int": "int_value", "datetime": "datetime_value", "date": "date_value", "time": "time_value"}


def parse_attribute(text: str) -> dict:
    """``type,name,value`` or ``type,name,min,max``; a comma in a value is written ``\\,``."""
    parts = [p.replace("\\,", ",") for p in re.split(r"(?<!\\),", text)]
    if len(parts) == 1:
        return {"name": parts[0]}
    if len(parts) not in (3, 4) or parts[0] not in _SLOT:
        raise ValueError(f"not an attribute condition: {text}")
    kind, name = parts[0], parts[1]
    cast = {"float": float, "int": int}.get(kind, str)
    values = [cast(p) if p else None for p in parts[2:]]
    if values.count(None) == len(values):
        raise ValueError("an attribute range needs a bound")
    return {"type": kind, "name": name, **({"value": values[0]} if len(values) == 1 else {"min": values[0], "max": values[1]})}


def attribute_match(spec: dict | str, field="attributes") -> Column:
    """Typed attribute conditions by name, group, value or range on one element."""
    spec = parse_attribute(spec) if isinstance(spec, str) else spec

    def one(e: Column) -> Column:
        out = []
        if "name" in spec:
            out.append(F.lower(e["name"]) == spec["name"].lower())
        if "group" in spec:
            out.append(F.lower(e["group"]).rlike(wildcard_regex(spec["group"].lower())))
        if "type" in spec:
            v = e[_SLOT[spec["type"]]]
            if spec["type"] in ("datetime", "date", "time"):
                lit = lambda x: F.lit(x).cast("timestamp_ntz")
            else:
                lit = F.lit
            if "value" in spec:
                out.append(F.lower(v) == spec["value"].lower() if spec["type"] == "string" else v == lit(spec["value"]))
            if spec.get("min") is not None:
                out.append(v >= lit(spec["min"]))
            if spec.get("max") is not None:
                out.append(v <= lit(spec["max"]))
        return all_of(*out)

    return F.exists(_c(field), one)


# Metres of the units of resolution texts.
_METRES = {"km": 1000.0, "meter": 1.0, "meters": 1.0, "m": 1.0}


def parse_resolution(text: str) -> tuple[float, float | None]:
    """``0 to 1 km`` or ``1 meter & above`` (spaces or +) as metres."""
    t = re.sub(r"[+\s]+", " ", text.strip().lower())
    m = re.fullmatch(r"([\d.]+) (\w+) (?:&|and) above", t)
    if m and m[2] in _METRES:
        return float(m[1]) * _METRES[m[2]], None
    m = re.fullmatch(r"([\d.]+) to ([\d.]+) (\w+)", t)
    if m and m[3] in _METRES:
        return float(m[1]) * _METRES[m[3]], float(m[2]) * _METRES[m[3]]
    m = re.fullmatch(r"([\d.]+) (\w+) to ([\d.]+) (\w+)", t)
    if m and m[2] in _METRES and m[4] in _METRES:
        return float(m[1]) * _METRES[m[2]], float(m[3]) * _METRES[m[4]]
    raise ValueError(f"not a resolution range: {text}")


def resolution_range(text: str, field="resolutions") -> Column:
    """Any horizontal resolution (metres) lies in the range."""
    low, high = parse_resolution(text)
    return F.exists(_c(field), lambda r: (r >= low) & (r <= high) if high is not None else r >= low)


# ---------------------------------------------------------------- grids and orbits


def parse_grid(text: str) -> list[tuple[tuple, tuple]]:
    """``x,y`` points and ``x1-x2,y1-y2`` ranges (either end open) separated by colons."""
    def axis(s: str):
        s = s.strip()
        if not s:
            return (None, None)
        m = re.fullmatch(r"(-?[\d.]+)?\s*-\s*(-?[\d.]+)?", s)
        if m and not re.fullmatch(r"-?[\d.]+", s):
            return tuple(float(x) if x else None for x in m.groups())
        return (float(s), float(s))

    out = []
    for part in text.split(":"):
        x, _, y = part.partition(",")
        out.append((axis(x), axis(y)))
    return out


def grid_match(name: str | None, coordinates: list[tuple[tuple, tuple]], field="grid") -> Column:
    """Grid name, and any of the coordinates: a point lies in the row's range, or ranges overlap."""
    g = _c(field)

    def axis(low, high, a, b) -> Column:
        out = []
        if a is not None:
            out.append(F.coalesce(high, low) >= F.lit(a))
        if b is not None:
            out.append(low <= F.lit(b))
        return all_of(*out)

    where = [axis(g["start_1"], g["end_1"], *x) & axis(g["start_2"], g["end_2"], *y) for x, y in coordinates]
    return all_of(*([F.lower(g["name"]) == name.lower()] if name else []), *([any_of(*where)] if where else []))


def orbit_number(low: float, high: float | None = None, field="orbit_domains") -> Column:
    """An orbit number, or the range between start and stop, meets the value or range."""
    high = low if high is None else high
    return F.exists(_c(field), lambda e: any_of(e["orbit_number"].between(low, high), (e["start_orbit"] <= high) & (e["stop_orbit"] >= low)))


def equator_longitude(low: float, high: float | None = None, field="orbit_domains") -> Column:
    """Equator crossing longitude; a range with low > high wraps the antimeridian."""
    high = low if high is None else high
    if low <= high:
        return F.exists(_c(field), lambda e: e["equator_lon"].between(low, high))
    return F.exists(_c(field), lambda e: (e["equator_lon"] >= low) | (e["equator_lon"] <= high))


def equator_date(start, end, field="orbit_domains") -> Column:
    return F.exists(_c(field), lambda e: date_range(e["equator_time"], start, end))


# ---------------------------------------------------------------- spatial groups


def spatial_any(*groups: list[Column], within: str = "or", across: str = "and") -> Column:
    """Conditions of each spatial parameter by ``within``, parameters by ``across``."""
    inner = any_of if within == "or" else all_of
    return (any_of if across == "or" else all_of)(*[inner(*g) for g in groups])


def mbr_overlap(prefix: str, west: float, north: float, east: float, south: float) -> Column:
    """The box columns ``{prefix}west`` ... meet the box; either may cross the antimeridian (west > east)."""
    w, n, e, s = (F.col(prefix + k) for k in ("west", "north", "east", "south"))
    lat = (n >= south) & (s <= north)
    crosses = w > e
    if west > east:
        lon = crosses | (w <= east) | (e >= west)
    else:
        lon = F.when(crosses, (w <= east) | (e >= west)).otherwise((w <= east) & (e >= west))
    return lat & lon


# ---------------------------------------------------------------- registry and guards

_FILTERS: dict[str, Callable[..., Column]] = {}


def register_filter(name: str, make: Callable[..., Column]) -> None:
    """Add a kind of condition that filter specs can name."""
    _FILTERS[name] = make


def filter_kind(name: str) -> Callable[..., Column]:
    if name not in _FILTERS:
        raise ValueError(f"unknown condition kind: {name}")
    return _FILTERS[name]


for _name, _make in {
    "string": string_eq, "pattern": string_like, "in": string_in, "boolean": boolean_eq, "number": num_eq, "number_range": num_range, "date": date_eq,
    "date_range": date_range, "string_range": string_range, "keyword": keyword_match, "temporal": temporal_intersects, "attribute": attribute_match,
    "resolution": resolution_range, "tag": tag_match, "exists": exists, "missing": missing, "match": match, "prefix": match_prefix,
}.items():
    register_filter(_name, _make)

# Limits on conditions and wildcards, and how many keywords with wildcards a query may
# have by the length of the longest of them (up to so many characters, so many keywords; longer: none).
MAX_CONDITIONS = 4100
MAX_LEADING_WILDCARDS = 5
MAX_KEYWORD_WILDCARDS = 30
KEYWORD_LIMITS = [(4, 115), (5, 75), (7, 60), (16, 36), (40, 22), (74, 16), (110, 13), (182, 10), (241, 5)]


def keyword_limit(longest: int) -> int:
    """Keywords with wildcards that a query may have if the longest of them has so many characters."""
    return min(MAX_KEYWORD_WILDCARDS, next((n for most, n in KEYWORD_LIMITS if longest <= most), 0))


def keyword_problem(text: Column) -> Column:
    """What is wrong with the wildcards of a column of keyword texts, such as those of saved queries; null if nothing is."""
    text = F.coalesce(text, F.lit(""))
    wild = F.filter(F.split(text, r"\s+"), lambda t: F.contains(t, F.lit("*")) | F.contains(t, F.lit("?")))
    n, longest = F.size(wild), F.array_max(F.transform(wild, F.length))
    most = F.lit(0)
    for length, number in reversed(KEYWORD_LIMITS):
        most = F.when(longest <= length, number).otherwise(most)
    by_length = F.format_string("%d keywords with wildcards, %d allowed as the longest has %d characters", n, most, longest)
    return F.when(n > MAX_KEYWORD_WILDCARDS, F.format_string("%d keywords with wildcards, %d allowed", n, F.lit(MAX_KEYWORD_WILDCARDS))).when(n > most, by_length)


def check_query(spec: dict, max_conditions: int = MAX_CONDITIONS, max_leading: int = MAX_LEADING_WILDCARDS) -> None:
    """Refuse specs with too many conditions, leading wildcards or keyword wildcards."""
    count = leading = 0
    stack = [spec]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                if k in ("and", "or"):
                    stack += v
                elif k == "not":
                    stack.append(v)
                else:
                    count += len(v) if isinstance(v, list) else 1
                    for x in v if isinstance(v, list) else [v]:
                        text = x.get("value") if isinstance(x, dict) else x
                        if isinstance(text, str) and text[:1] in ("*", "?"):
                            leading += 1
                        wild = [t for t in text.split() if "*" in t or "?" in t] if k == "keyword" and isinstance(text, str) else []
                        if wild and len(wild) > keyword_limit(max(map(len, wild))):
                            raise ValueError(f"too many keyword wildcards: {len(wild)}")
    if count > max_conditions:
        raise ValueError(f"too many conditions: {count}")
    if leading > max_leading:
        raise ValueError(f"too many leading wildcards: {leading}")
