"""A catalogue of named data sets: loaders of local files, registered by their users."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .files import read, read_geolife


@dataclass(frozen=True)
class Dataset:
    name: str
    kind: str  # trajectory, flow, tessellation or auxiliary
    load: Callable[[SparkSession, str], DataFrame]
    details: dict = field(default_factory=dict)


_KNOWN: dict[str, Dataset] = {}


def register(name: str, kind: str, load: Callable[[SparkSession, str], DataFrame], **details) -> None:
    _KNOWN[name] = Dataset(name, kind, load, details)


def list_datasets(kinds: list[str] | None = None) -> list[str]:
    return sorted(n for n, d in _KNOWN.items() if kinds is None or d.kind in kinds)


def get_dataset_info(name: str) -> dict:
    d = _KNOWN[name]
    return {"name": d.name, "kind": d.kind, **d.details}


def load_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The data set from a local or shared copy at path; nothing is downloaded."""
    if name not in _KNOWN:
        raise KeyError(f"no data set {name!r}; known: {list_datasets()}")
    return _KNOWN[name].load(spark, path)


register("geolife", "trajectory", read_geolife, format="folders of .plt files")
register("brightkite", "trajectory", lambda spark, path: read(spark, path, sep="\t", header=False, schema="uid bigint, datetime timestamp, lat double, lng double, location_id string"), format="tab-separated check-ins")
