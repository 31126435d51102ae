"""One machine's bounded history and the features of its next observation.

Rules of the online mode: observations count in order of arrival; features come from the history
before the observation, but for the exponential means, which include it; windows hold the last finite
values; deviations divide by n - 1; changes are per second. The history keeps ``history`` observations,
so the machine's "start" is the oldest of these.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice
from statistics import median

VERSION = 1
DEFAULT_SENSORS = ("air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min")


@dataclass(frozen=True)
class OnlineSettings:
    sensors: tuple[str, ...] = DEFAULT_SENSORS
    lags: tuple[int, ...] = (1, 3, 6)
    windows: tuple[int, ...] = (3, 6, 12)
    spans: tuple[int, ...] = (3, 6, 12)
    least_values: int = 2
    least_for_z: int = 3
    epsilon: float = 1e-8
    history: int = 128
    deltas_without_time: bool = False
    late: str = "accept"

    def __post_init__(self) -> None:
        if min([*self.lags, *self.windows, *self.spans, self.least_values, self.least_for_z, self.history]) < 1:
            raise ValueError("lags, windows, spans and history sizes must be positive")
        if self.late not in ("accept", "drop"):
            raise ValueError("late must be accept or drop")
        if self.history < max([*self.lags, *self.windows]):
            raise ValueError("the history must hold the longest lag and window")


def micros(time: float) -> int:
    """A time in seconds as whole microseconds, which a double still tells apart (up to the year 2242)."""
    whole = math.floor(time)
    return whole * 1_000_000 + round((time - whole) * 1e6)


def seconds_between(later: float | None, earlier: float | None) -> float | None:
    """Exact, where the difference of the doubles is off by some 1e-7."""
    return None if later is None or earlier is None else (micros(later) - micros(earlier)) / 1e6


def history_features(settings: OnlineSettings) -> list[str]:
    """Names of the features that need state, in order."""
    names = ["time_since_previous_observation_seconds", "elapsed_time_since_machine_start_seconds"]
    for s in settings.sensors:
        names += [f"{s}_lag_{k}" for k in settings.lags]
        names += [f"{s}_rolling_{w}_{k}" for w in settings.windows for k in ("mean", "std", "min", "max", "median", "zscore", "anomaly_score")]
        names += [f"{s}_ewm_{n}" for n in settings.spans]
        names += [f"{s}_roc_{k}" for k in settings.lags]
    return names


@dataclass
class MachineState:
    times: list[float | None] = field(default_factory=list)  # seconds
    values: dict[str, list[float | None]] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)  # "sensor|span"
    count: int = 0
    last: float | None = None

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "times": self.times, "values": self.values, "means": self.means, "count": self.count, "last": self.last})

    @classmethod
    def from_json(cls, text: str | None) -> MachineState:
        if not text:
            return cls()
        data = json.loads(text)
        if data.pop("version", None) != VERSION:
            raise ValueError("unsupported version of the state")
        return cls(**data)

    def observe(self, time: float | None, reading: dict[str, float | None], settings: OnlineSettings) -> dict[str, float | None] | None:
        """Features of an observation, which then joins the history; None if it is late and dropped."""
        if settings.late == "drop" and time is not None and self.last is not None and time < self.last:
            return None
        clean = self.cleaned(reading, settings)
        out = dict(self._features(time, clean, settings))
        self._join(time, clean, settings, {f"{s}|{n}": out[f"{s}_ewm_{n}"] for s, v in clean.items() if v is not None for n in settings.spans})
        return out

    def absorb(self, time: float | None, reading: dict[str, float | None], settings: OnlineSettings) -> None:
        """An observation joins the history, by the same steps but without its features."""
        clean = self.cleaned(reading, settings)
        self._join(time, clean, settings, {f"{s}|{n}": self._mean_with(s, n, v) for s, v in clean.items() if v is not None for n in settings.spans})

    @staticmethod
    def cleaned(reading: dict[str, float | None], settings: OnlineSettings) -> dict[str, float | None]:
        return {s: v if (v := reading.get(s)) is not None and math.isfinite(v) else None for s in settings.sensors}

    def _mean_with(self, s: str, n: int, x: float) -> float:
        before, alpha = self.means.get(f"{s}|{n}"), 2 / (n + 1)
        return x if before is None else alpha * x + (1 - alpha) * before

    def _join(self, time: float | None, clean: dict[str, float | None], settings: OnlineSettings, means: dict[str, float]) -> None:
        self.times.append(time)
        del self.times[: -settings.history]
        for s, v in clean.items():
            past = self.values.setdefault(s, [])
            past.append(v)
            del past[: -settings.history]
        self.means.update(means)
        self.count += 1
        if time is not None:
            self.last = time

    def _features(self, time: float | None, clean: dict[str, float | None], settings: OnlineSettings) -> Iterator[tuple[str, float | None]]:
        since_last = seconds_between(time, self.last)
        yield "time_since_previous_observation_seconds", None if since_last is None else max(since_last, 0.0)
        since_start = seconds_between(time, self.times[0] if self.times else None)
        yield "elapsed_time_since_machine_start_seconds", None if since_start is None else max(since_start, 0.0)
        since = {k: seconds_between(time, self.times[-k]) for k in settings.lags if len(self.times) >= k}
        for s, x in clean.items():
            past = self.values.get(s, [])
            finite = list(islice((v for v in reversed(past) if v is not None), max(settings.windows)))[::-1]
            for k in settings.lags:
                yield f"{s}_lag_{k}", past[-k] if len(past) >= k else None
            for w in settings.windows:
                some = finite[-w:]
                enough = len(some) >= settings.least_values
                mean = math.fsum(some) / len(some) if some else None
                std = math.sqrt(math.fsum((v - mean) ** 2 for v in some) / (len(some) - 1)) if len(some) > 1 else None
                yield f"{s}_rolling_{w}_mean", mean if enough else None
                yield f"{s}_rolling_{w}_std", std if enough else None
                yield f"{s}_rolling_{w}_min", min(some) if enough else None
                yield f"{s}_rolling_{w}_max", max(some) if enough else None
                yield f"{s}_rolling_{w}_median", float(median(some)) if enough else None
                z = None
                if x is not None and std is not None and len(some) >= settings.least_for_z and std > settings.epsilon:
                    z = (x - mean) / std
                yield f"{s}_rolling_{w}_zscore", z
                yield f"{s}_rolling_{w}_anomaly_score", None if z is None else abs(z)
            for n in settings.spans:
                yield f"{s}_ewm_{n}", None if x is None else self._mean_with(s, n, x)
            for k in settings.lags:
                change = None
                if x is not None and len(past) >= k and past[-k] is not None:
                    seconds = since[k]
                    if seconds is not None and seconds > 0:
                        change = (x - past[-k]) / seconds
                    elif settings.deltas_without_time and seconds is None:
                        change = x - past[-k]
                yield f"{s}_roc_{k}", change


def summary(states: dict[str, MachineState]) -> dict:
    return {"machines": len(states), "observations": sum(s.count for s in states.values()), "largest_history": max((len(s.times) for s in states.values()), default=0)}


def output_row(features: dict[str, float | None], names: Sequence[str]) -> list[float | None]:
    return [features.get(n) for n in names]
