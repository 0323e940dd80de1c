"""Timestamp formats: which one a file uses, and parsing with it (SQL texts)."""

from __future__ import annotations

from dataclasses import dataclass

from devicelog.functions.cells import one_of, quoted
from devicelog.schema import BLANK_TIMESTAMPS, TIMESTAMP_FORMATS

# Elected values: 0..5 device formats, GUESSED + shape of the first timestamp, EACH_ROW no common format.
GUESSED = 100
EACH_ROW = -1
_ALL_FIT = (1 << len(TIMESTAMP_FORMATS)) - 1


def is_blank(cell: str) -> str:
    return f"({cell} IS NULL OR {cell} IN {one_of(BLANK_TIMESTAMPS)})"


def _shape_fits(cell: str, pattern: str) -> str:
    """A cheap test that a cell must pass to fit a pattern, so that few cells are parsed in vain."""
    if pattern.startswith("yyyyMM"):
        return f"length({cell}) = 14"
    if pattern.startswith("yyyy"):
        clock = f"contains(substr({cell}, 9), '.')"
        fraction = clock if ".S" in pattern else f"NOT {clock}"
        return f"substr({cell}, 5, 1) = '{pattern[4]}' AND {fraction}"
    month, day = "(0?[1-9]|1[0-2])/", "[0-9]{1,2}/"
    first = month + day if pattern.startswith("M") else day + month
    return f"substr({cell}, 2, 2) LIKE '%/%' AND rlike({cell}, '^{first}')"


def _read(cell: str, pattern: str) -> str:
    return f"CAST(try_to_timestamp({cell}, {pattern}) AS TIMESTAMP_NTZ)"


def parsed(cell: str, pattern: str) -> str:
    return f"IF({_shape_fits(cell, pattern)}, {_read(cell, quoted(pattern))}, NULL)"


def fitting(cell: str) -> str:
    """A bit per device format that reads the cell; blank cells fit all."""
    bits = " | ".join(
        f"IF({parsed(cell, p)} IS NOT NULL, {1 << i}, 0)" for i, p in enumerate(TIMESTAMP_FORMATS)
    )
    return f"IF({is_blank(cell)}, {_ALL_FIT}, {bits})"


# --- Shapes of other timestamps ---------------------------------------------------
#
# A timestamp is a date, perhaps a clock, perhaps a zone. A shape says which kind of
# date it is, what stands between its parts and which parts of a clock it has. The
# shape of a file's first timestamp holds for all of its rows.

_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTHS = {name: i + 1 for i, full in enumerate(_NAMES) for name in (full, full[:3])} | {"sept": 9}
_CLOCK = "(?:(T|,? +)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]{1,9}))?)?(?: ?([AaPp][Mm]))?)?"
_ZONE = "(?: ?(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}))?$"


@dataclass(frozen=True)
class _Date:
    """A kind of date: its pattern with four groups, and which of them are year, separator, month and day."""

    pattern: str
    year: int
    separator: int
    month: int
    day: int

    @property
    def regex(self) -> str:
        return quoted(self.pattern + _CLOCK + _ZONE)


_NUMBERS = "^([0-9]{1,2})([-/.])([0-9]{1,2})\\2([0-9]{4}|[0-9]{2})(?![0-9])"
#: The second of two numbers and a year is the day, unless the first cannot be a month; then it is the next kind.
_MONTH_FIRST = 1
_DATES = [
    _Date("^([0-9]{4})([-/. ])([0-9]{1,2})\\2([0-9]{1,2})(?![0-9])", 1, 2, 3, 4),
    _Date(_NUMBERS, 4, 2, 1, 3),
    _Date(_NUMBERS, 4, 2, 3, 1),
    _Date("^([0-9]{1,2})([- ])([A-Za-z]{3,9})[.]?,?[- ]([0-9]{4}|[0-9]{2})(?![0-9])", 4, 2, 3, 1),
    _Date("^([A-Za-z]{3,9})[.]?( )([0-9]{1,2}),? ([0-9]{4})(?![0-9])", 4, 2, 1, 3),
    _Date("^([0-9]{4})([- ])([A-Za-z]{3,9})[- ]([0-9]{1,2})(?![0-9])", 1, 2, 3, 4),
    # A separator that is always empty keeps the groups alike.
    _Date("^([0-9]{4})()([0-9]{2})([0-9]{2})(?![0-9])", 1, 2, 3, 4),
]
_JOINT, _HOUR, _MINUTE, _SECOND, _FRACTION, _HALF, _ZONE_TEXT = range(5, 12)
# Bits of a shape, from the lowest: kind (3), separator (3), joint (2), clock (2), half of day (1), zone (2),
# short year (1), and the zone's minutes from -1023 on (11).
_KIND_MASK = 7
_OFFSET_AT, _OFFSET_ZERO = 14, 1024
_FORM_MASK = (1 << _OFFSET_AT) - 1


def kind(cell: str) -> str:
    """The kind of date that a cell has, NULL if none. Of two numbers and a year the month comes first if it can."""
    first = f"try_cast(regexp_extract({cell}, '^[0-9]+', 0) AS INT)"
    tests = " ".join(
        f"WHEN rlike({cell}, {d.regex}) THEN {f'IF({first} <= 12, {i}, {i + 1})' if i == _MONTH_FIRST else i}"
        for i, d in enumerate(_DATES)
    )
    return f"CASE {tests} END"


def parts(cell: str, of_kind: str) -> str:
    """The groups of a cell as an array, by one match with its kind's pattern; NULL if that does not fit."""
    regex = f"try_element_at(array({', '.join(d.regex for d in _DATES)}), {of_kind} + 1)"
    mark = "\\u0001"
    groups = mark.join(f"${i}" for i in range(1, _ZONE_TEXT + 1))
    return f"IF({of_kind} IS NOT NULL AND rlike({cell}, {regex}), split(regexp_replace({cell}, {regex}, '{groups}'), '{mark}'), NULL)"


def _by_kind(of_kind: str, group: str) -> str:
    places = ", ".join(str(getattr(d, group)) for d in _DATES)
    return f"try_element_at(array({places}), {of_kind} + 1)"


def _zone_minutes(groups: str) -> str:
    zone = f"{groups}[{_ZONE_TEXT - 1}]"
    digits = f"replace(substr({zone}, 2), ':', '')"
    size = f"(try_cast(substr({digits}, 1, 2) AS INT) * 60 + try_cast(substr({digits}, 3, 2) AS INT))"
    return f"IF({zone} RLIKE '^[+-]', IF(startswith({zone}, '-'), -1, 1) * {size}, 0)"


def wall(groups: str, of_kind: str) -> str:
    """The date and clock as written; NULL where there is no such day or time."""

    def clock(number: int) -> str:
        return f"{groups}[{number - 1}]"

    year, month, day = (f"{groups}[{_by_kind(of_kind, name)} - 1]" for name in ("year", "month", "day"))
    full_year = f"(try_cast({year} AS INT) + IF(length({year}) = 2, IF({year} < '69', 2000, 1900), 0))"
    months = ", ".join(f"'{name}', {number}" for name, number in _MONTHS.items())
    of_year = f"coalesce(try_cast({month} AS INT), try_element_at(map({months}), lower({month})))"
    number = f"coalesce(try_cast({clock(_HOUR)} AS INT), 0)"
    hours = (
        f"CASE WHEN {clock(_HALF)} = '' THEN {number} WHEN {number} BETWEEN 1 AND 12 "
        f"THEN {number} % 12 + IF(lower({clock(_HALF)}) = 'pm', 12, 0) END"
    )
    minutes = f"coalesce(try_cast({clock(_MINUTE)} AS INT), 0)"
    # What lies beyond microseconds is cut off.
    seconds = f"CAST(concat('0', {clock(_SECOND)}, '.', substr({clock(_FRACTION)}, 1, 6)) AS DECIMAL(16,6))"
    return f"try_make_timestamp_ntz({full_year}, {of_year}, try_cast({day} AS INT), {hours}, {minutes}, {seconds})"


def shape(groups: str, of_kind: str) -> str:
    """The shape of a timestamp as one number."""

    def group(number: int) -> str:
        return f"{groups}[{number - 1}]"

    separator = group(2)
    bits = [
        (of_kind, 0),
        (f"IF({separator} = '', 0, position({separator} IN '-/. '))", 3),
        (f"CASE {group(_JOINT)} WHEN '' THEN 0 WHEN 'T' THEN 1 ELSE 2 END", 6),
        (
            f"CASE WHEN {group(_JOINT)} = '' THEN 0 WHEN {group(_SECOND)} = '' THEN 1 "
            f"WHEN {group(_FRACTION)} = '' THEN 2 ELSE 3 END",
            8,
        ),
        (f"IF({group(_HALF)} = '', 0, 1)", 10),
        (f"CASE WHEN {group(_ZONE_TEXT)} = '' THEN 0 WHEN {group(_ZONE_TEXT)} RLIKE '^[A-Z]' THEN 1 ELSE 2 END", 11),
        (f"IF(length({groups}[{_by_kind(of_kind, 'year')} - 1]) = 2, 1, 0)", 13),
        (f"({_zone_minutes(groups)} + {_OFFSET_ZERO})", _OFFSET_AT),
    ]
    return "(" + " + ".join(f"shiftleft(CAST({value} AS BIGINT), {place})" for value, place in bits) + ")"


def election(cell: str, fits: str, ordinal: str) -> list[str]:
    """Aggregates of fixed width: the formats that fit every row, and the first row with a timestamp."""
    return [
        f"bit_and({fits}) AS common",
        f"min(IF({is_blank(cell)}, NULL, {ordinal})) AS first_filled",
    ]


def elected(found: str) -> str:
    """The first device format that fits all rows, else the shape of the first timestamp, else row by row."""
    fits = " ".join(f"WHEN common & {1 << i} <> 0 THEN {i}" for i in range(len(TIMESTAMP_FORMATS)))
    return f"CAST(CASE {fits} WHEN {found} IS NULL THEN {EACH_ROW} ELSE {found} + {GUESSED} END AS INT)"


def elected_kind(cell: str, fmt: str) -> str:
    """The kind of date to read a cell by; NULL where a device format reads it, so that nothing is matched."""
    return f"CASE WHEN {fmt} >= {GUESSED} THEN ({fmt} - {GUESSED}) & {_KIND_MASK} WHEN {fmt} = {EACH_ROW} THEN {kind(cell)} END"


def parsed_as(cell: str, fmt: str, groups: str, of_kind: str) -> str:
    """The cell read with its file's elected format; cells it does not fit are NULL.

    ``groups`` are its :func:`parts`. A time with a zone is shown by the clock of its file's first zone.
    """
    device = " ".join(
        f"WHEN {fmt} = {i} THEN {_read(cell, quoted(p))}" for i, p in enumerate(TIMESTAMP_FORMATS)
    )
    elected_shape = f"CAST({fmt} - {GUESSED} AS BIGINT)"
    alike = f"{fmt} = {EACH_ROW} OR ({shape(groups, of_kind)} & {_FORM_MASK}L) = ({elected_shape} & {_FORM_MASK}L)"
    own_zone = f"IF({fmt} = {EACH_ROW}, 0, shiftright({elected_shape}, {_OFFSET_AT}) - {_OFFSET_ZERO} - {_zone_minutes(groups)})"
    return (
        f"CASE WHEN {is_blank(cell)} THEN NULL {device} "
        f"WHEN {groups} IS NOT NULL AND ({alike}) THEN {wall(groups, of_kind)} + make_dt_interval(0, 0, {own_zone}) END"
    )
