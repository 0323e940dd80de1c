"""SQL expressions on single raw cells, given and returned as text."""

from __future__ import annotations

import re

from devicelog.schema import ALARM_TEXT, SENTINELS


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(values: list[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def stripped(cell: str) -> str:
    return f"trim(BOTH ' \\t\\n\\r\\u000b\\u000c' FROM {cell})"


def is_sentinel(cell: str) -> str:
    return f"{cell} IN {one_of(SENTINELS)}"


# A number as written in a device log. The cast alone would also read Java literals
# such as 1.5d or 0x1p3, and is slow on text that is no number.
_NUMBER = (
    "^[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?"
    "|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
)


def to_number(cell: str) -> str:
    """The cell as a double; device codes, other text and NaN become NULL."""
    codes = [s for s in SENTINELS if re.match(_NUMBER, s)]
    no_code = f"NOT {cell} IN {one_of(codes)} AND " if codes else ""
    return f"IF({no_code}rlike({cell}, {quoted(_NUMBER)}), try_cast({cell} AS DOUBLE), NULL)"


def bubble_code(cell: str) -> str:
    return f"IF({cell} = '--', 'OK', {cell})"


def alarm_flag(cell: str) -> str:
    """TRUE for the alarm text, FALSE for anything else, NULL where the file has no such column."""
    return f"{stripped(cell)} = {quoted(ALARM_TEXT)}"
