"""Column names: cleaning, aliases, and the roles that names imply."""

from __future__ import annotations

import re

#: The canonical column for each known raw name (compared without case, spaces or signs).
ALIASES = {
    "udi": "uid",
    "uid": "uid",
    "product id": "product_id",
    "type": "type",
    "air temperature": "air_temperature_k",
    "air temperature k": "air_temperature_k",
    "process temperature": "process_temperature_k",
    "process temperature k": "process_temperature_k",
    "rotational speed": "rotational_speed_rpm",
    "rotational speed rpm": "rotational_speed_rpm",
    "rpm": "rotational_speed_rpm",
    "torque": "torque_nm",
    "torque nm": "torque_nm",
    "tool wear": "tool_wear_min",
    "tool wear min": "tool_wear_min",
    "machine failure": "machine_failure",
    "failure": "machine_failure",
    "target": "machine_failure",
    "twf": "twf",
    "hdf": "hdf",
    "pwf": "pwf",
    "osf": "osf",
    "rnf": "rnf",
    "timestamp": "timestamp",
    "machine id": "machine_id",
}
#: Further names, which count only where no column has one of the names above for the same.
OTHER_ALIASES = {
    "unique id": "uid",
    "unique identifier": "uid",
    "product type": "type",
    "air temp": "air_temperature_k",
    "process temp": "process_temperature_k",
    "failure flag": "machine_failure",
    "date": "timestamp",
    "datetime": "timestamp",
    "date time": "timestamp",
    "time": "timestamp",
    "machineid": "machine_id",
    "machine identifier": "machine_id",
    "asset id": "machine_id",
    "equipment id": "machine_id",
}
SENSORS = ["air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"]
FAILURE_MODES = ["twf", "hdf", "pwf", "osf", "rnf"]
TARGET = "machine_failure"
IDENTIFIERS = ["uid", "product_id"]
LABELS = [TARGET, *FAILURE_MODES]
AI4I = [*IDENTIFIERS, "type", *SENSORS, *LABELS]
DETECTABLE = ["type", *SENSORS, TARGET, *IDENTIFIERS]


def safe_name(name: str) -> str:
    """Lower case; the times sign and the square become letters; anything else one underscore."""
    text = name.strip().lower().replace("×", "x").replace("²", "2").replace("]", "")
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]", "_", text)).strip("_")


def feature_name(group: str, source: str, operation: str) -> str:
    return "__".join(part for part in (safe_name(group), safe_name(source), safe_name(operation)) if part)


def canonical_names(columns: list[str], snake: bool = False) -> list[str]:
    """Each column's canonical name, or its own cleaned name, in snake case if asked for; two columns of one
    name are an error."""
    cleaned = [" ".join(column.replace("﻿", "").split()) for column in columns]
    keys = [" ".join(re.sub(r"[\[\]_()]", " ", clean.lower()).split()) for clean in cleaned]
    taken = {ALIASES[key] for key in keys if key in ALIASES}
    other = {key: name for key, name in OTHER_ALIASES.items() if name not in taken}
    out = [ALIASES.get(key, other.get(key, (safe_name(clean) or clean) if snake else clean)) for key, clean in zip(keys, cleaned)]
    repeated = sorted({n for n in out if out.count(n) > 1})
    if repeated:
        raise ValueError(f"several columns mean {repeated}")
    return out


def find_column(columns: list[str], wanted: str) -> str | None:
    """The column of that name, else the first that differs in case only."""
    if wanted in columns:
        return wanted
    return next((c for c in columns if c.lower() == wanted.lower()), None)


def is_ai4i(columns: list[str], at_least: int = 7) -> bool:
    return sum(c in columns for c in DETECTABLE) >= at_least


def machine_column(columns: list[str]) -> str | None:
    """A column that names a machine, equipment or asset by an id or number."""
    for column in columns:
        words = set(re.split(r"[^a-z]+", column.lower()))
        if words & {"machine", "equipment", "asset"} and words & {"id", "identifier", "number"}:
            return column
    return None


def leak_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.lower() in LABELS]
