"""Finding the columns of a trajectory table by their usual names; metadata only."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Names looked for, in order.
NAMES = {
    "uid": ["uid", "user", "user_id", "userid", "agent_id", "id_user"],
    "datetime": ["datetime", "timestamp", "time", "ts", "check-in_time", "date_time", "started_at"],
    "lat": ["lat", "latitude", "y"],
    "lng": ["lng", "lon", "long", "longitude", "x"],
}


class MissingColumn(ValueError):
    pass


def resolve(columns: list[str], **explicit: str | None) -> dict[str, str]:
    """Canonical name -> column; explicit names win, then the first match."""
    out = {}
    for name, candidates in NAMES.items():
        found = explicit.get(name) or next((c for want in candidates for c in columns if c.lower() == want), None)
        if found is None and name != "uid":
            raise MissingColumn(f"no column for {name}; tried {candidates}")
        if found is not None and found not in columns:
            raise MissingColumn(f"no column {found!r}")
        if found:
            out[name] = found
    return out


def canonical(df: DataFrame, **explicit: str | None) -> DataFrame:
    """df with its trajectory columns renamed to uid, datetime, lat, lng."""
    return df.withColumnsRenamed({v: k for k, v in resolve(df.columns, **explicit).items()})
