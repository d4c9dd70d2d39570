"""Operators as SQL over DataFrames, in a form that Spark and DuckDB both read.

An operator's text names its inputs in braces and its parameters in angle brackets.
A few marks stand for what the two dialects spell differently (see MARKS).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

#: mark -> (Spark, DuckDB); {0}, {1}, ... are its arguments.
MARKS = {
    "EPOCH_US": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({0} AS TIMESTAMP_NTZ))", "epoch_us({0})"),
    "WEEKDAY": ("weekday({0})", "(isodow({0}) - 1)"),
    "TRUNC": ("CAST(date_trunc({0}, {1}) AS TIMESTAMP_NTZ)", "date_trunc({0}, {1})"),
    "PERCENTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "LAST_KNOWN": ("last_value({0}, true)", "last_value({0} IGNORE NULLS)"),
    "NEXT_KNOWN": ("first_value({0}, true)", "first_value({0} IGNORE NULLS)"),
    "ZONE": ("convert_timezone({0}, {1}, CAST({2} AS TIMESTAMP_NTZ))", "(({2} AT TIME ZONE {0}) AT TIME ZONE {1})"),
    "TIMESTAMP_AT": ("TIMESTAMP_NTZ {0}", "TIMESTAMP {0}"),
    "DAY": ("CAST({0} AS DATE)", "CAST({0} AS DATE)"),
    "SERIES": ("LATERAL VIEW explode(sequence({1}, {2})) t_{0} AS {0}", "CROSS JOIN LATERAL (SELECT unnest(range({1}, {2} + 1)) AS {0})"),
    "HAVERSINE": tuple(["(2 * 6371.0088e0 * asin(sqrt(least(1e0 + 0 * ({0} + {1} + {2} + {3}), pow(sin(radians(({2}) - ({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians(({3}) - ({1})) / 2), 2)))))"] * 2),
    "VALID": tuple(["({0} IS NOT NULL AND {1} IS NOT NULL AND NOT isnan({0}) AND NOT isnan({1}) AND abs({0}) <= 90 AND abs({1}) <= 180)"] * 2),
    "SORTED": ("array_join(transform(sort_array(collect_list({0})), e -> CAST(e AS STRING)), ',')", "array_to_string(list_sort(list({0})), ',')"),
    "LONG": tuple(["CAST({0} AS BIGINT)"] * 2),
    "MINUTES": ("(timestampdiff(MICROSECOND, {0}, {1}) / 60000000e0)", "((epoch_us({1}) - epoch_us({0})) / 60000000e0)"),
    "PLUS_MINUTES": ("({0} + make_dt_interval(0, 0, {1}))", "({0} + to_minutes({1}))"),
    "PLUS_US": ("timestampadd(MICROSECOND, {1}, {0})", "({0} + to_microseconds({1}))"),
    "BEARING": tuple(["(degrees(atan2(sin(radians(({3}) - ({1}))) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians(({3}) - ({1}))))))"] * 2),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens at at, and the place after it."""
    depth, start, out = 0, at + 1, []
    for i in range(at, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif text[i] == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(text)


def dialect(text: str, which: int) -> str:
    """text for Spark (0) or DuckDB (1)."""
    while found := re.search(rf"\b({'|'.join(MARKS)})\(", text):
        args, end = _arguments(text, found.end() - 1)
        text = text[: found.start()] + MARKS[found[1]][which].format(*args) + text[end:]
    return text.replace("TIMESTAMP_NTZ)", "TIMESTAMP)") if which else text


class SqlOperator:
    """A callable operator: DataFrames in the order of inputs, parameters by name."""

    def __init__(self, name: str, doc: str, text: str, **defaults: object):
        self.__name__, self.__doc__, self.text, self.defaults = name, doc, text, defaults
        self.inputs = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))
        self.parameters = set(re.findall(r"<(\w+)>", text))

    def _text(self, given: dict) -> str:
        values = self.defaults | given
        unknown, missing = set(values) - self.parameters, self.parameters - set(values)
        if unknown or missing:
            raise TypeError(f"{self.__name__} has no parameter {sorted(unknown)}" if unknown else f"{self.__name__} needs {sorted(missing)}")
        return re.sub(r"<(\w+)>", lambda m: str(values[m[1]]), self.text)

    def __call__(self, *frames: DataFrame, prepare: Callable[[DataFrame, str], DataFrame] | None = None, **given) -> DataFrame:
        if len(frames) != len(self.inputs):
            raise TypeError(f"{self.__name__} takes {self.inputs}")
        named = {n: (prepare(f, n) if prepare else f) for n, f in zip(self.inputs, frames, strict=True)}
        return frames[0].sparkSession.sql(dialect(self._text(given), 0), **named)

    def oracle(self, views: dict[str, str], **given) -> str:
        """The DuckDB text over the named views."""
        body = re.sub(r"\{(\w+)\}", r"\1", dialect(self._text(given), 1))
        need: list[str] = []

        def add(name: str) -> None:
            if name in need or name not in views:
                return
            for other in views:
                if other != name and re.search(rf"\b{other}\b", views[name]):
                    add(other)
            need.append(name)

        for n in self.inputs:
            add(n)
        return "WITH " + ", ".join(f"{n} AS ({dialect(views[n], 1)})" for n in need) + f" SELECT * FROM ({body}) answer"
