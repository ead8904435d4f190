"""Metric names to service and signal, and other column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor.config import FAULT_TO_INCIDENT, METRIC_SUFFIXES, SYSTEM_NAMES


def service_of(name: Column) -> Column:
    """The name without its last ``_token``; no known suffix holds an underscore, so that it is that token."""
    signal = F.substring_index(name, "_", -1)
    cut = F.contains(name, F.lit("_")) & (signal != "")
    return F.when(cut, F.substring(name, F.lit(1), F.length(name) - F.length(signal) - 1)).otherwise(name)


def signal_of(name: Column) -> Column:
    """The last token; null if there is none."""
    return F.nullif(F.substring_index(name, "_", -1), F.lit(""))


def is_parseable(name: Column) -> Column:
    """Whether the scalar parser accepts the name: an underscore after trimming."""
    return F.coalesce(F.contains(F.btrim(name), F.lit("_")), F.lit(False))


def parse_metric_name(name: str) -> tuple[str, str]:
    """(service, signal) of one name; ValueError if it is blank or has no underscore."""
    name = (name or "").strip()
    for suffix in METRIC_SUFFIXES:
        if name.endswith(f"_{suffix}"):
            return name[: -len(suffix) - 1], suffix
    service, underscore, signal = name.rpartition("_")
    if not underscore:
        raise ValueError(f"can't parse metric name: {name!r}")
    return service, signal


def finite(value: Column) -> Column:
    """The value as a double where it is a finite number, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def incident_of(fault: Column) -> Column:
    pairs = [F.lit(x) for pair in FAULT_TO_INCIDENT.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), fault)


def system_of(dataset: Column) -> Column:
    pairs = [F.lit(x) for pair in SYSTEM_NAMES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.nullif(F.regexp_extract(dataset, r"-(OB|SS|TT)\z", 1), F.lit("")))


def seconds_to_ms(seconds: Column) -> Column:
    """Whole milliseconds; null for what is no number (a case's metadata then raise ValueError)."""
    return (seconds.try_cast("double") * 1000).cast("bigint")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, 0.0).otherwise((value - mean) / F.nullif(std, F.lit(0.0)))


def float_text(ms: Column) -> Column:
    """A whole number of ms as Python prints the float."""
    return F.concat(ms.cast("bigint").cast("string"), F.lit(".0"))
