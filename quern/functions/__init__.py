"""Scalar functions as Column expressions: everything stays inside Catalyst unless it says otherwise."""

from quern.functions.dates import (
    date_add_interval,
    date_format_mysql,
    from_unixtime_utc,
    str_to_date,
    timestampdiff,
    unix_timestamp_days,
    week_of_year,
)
from quern.functions.jsons import (
    json_array,
    json_arrow,
    json_arrow_text,
    json_contains,
    json_extract,
    json_has_key,
    json_object,
    json_remove,
    json_replace,
    json_set,
    json_unquote,
)
from quern.functions.maths import int_div, round_double, text_to_number, truthy
from quern.functions.strings import concat_skip, elt, field, format_fixed, substring_from

__all__ = [
    "concat_skip", "date_add_interval", "date_format_mysql", "elt", "field", "format_fixed", "from_unixtime_utc", "int_div", "json_array", "json_arrow",
    "json_arrow_text", "json_contains", "json_extract", "json_has_key", "json_object", "json_remove", "json_replace", "json_set", "json_unquote",
    "round_double", "str_to_date", "substring_from", "text_to_number", "timestampdiff", "truthy", "unix_timestamp_days", "week_of_year",
]
