"""Options of runs and requests: their ranges, the codes of values outside them, and which value counts."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST_MINUTES = math.floor(2_147_483_647 / 60_000)


@dataclass(frozen=True)
class Range:
    code: str
    low: float | None = None
    high: float | None = None
    above: float | None = None
    whole: bool = False

    def holds(self, value: object) -> bool:
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            return False
        return not (self.whole and value != math.floor(value) or self.low is not None and value < self.low or self.high is not None and value > self.high or self.above is not None and value <= self.above)

    def column(self, value: Column) -> Column:
        ok = value.isNotNull() & ~F.isnan(value.cast("double"))
        for test, use in ((value == F.floor(value), self.whole), (value >= F.lit(self.low), self.low is not None), (value <= F.lit(self.high), self.high is not None), (value > F.lit(self.above), self.above is not None)):
            ok = ok & test if use else ok
        return F.coalesce(ok, F.lit(False))


#: Fixed: numeric options, their ranges and error codes.
RANGES = {
    "chunkSize": Range("INVALID_CHUNK_SIZE", above=0, high=500_000, whole=True),
    "batchSize": Range("INVALID_BATCH_SIZE", above=0, high=1000, whole=True),
    "parallel": Range("INVALID_PARALLEL_SIZE", above=0, high=128, whole=True),
    "rpm": Range("INVALID_RPM_VALUE", above=0),
    "retryDelay": Range("INVALID_RETRY_DELAY_VALUE", low=0),
    "maxAttempts": Range("INVALID_MAX_ATTEMPTS", low=1, whole=True),
    "maxFail": Range("INVALID_MAX_FAIL_VALUE", low=0, whole=True),
    "temperature": Range("INVALID_TEMPERATURE_RANGE", low=0, high=2),
    "top_p": Range("INVALID_TOP_P_RANGE", low=0, high=1),
    "top_k": Range("INVALID_TOP_K_RANGE", low=0, whole=True),
    "presence_penalty": Range("INVALID_PENALTY_RANGE", low=-2, high=2),
    "seed": Range("INVALID_SEED", low=1, whole=True),
    "hardTimeout": Range("INVALID_HARD_TIMEOUT", low=0.1, high=_MOST_MINUTES),
    "idleTimeout": Range("INVALID_IDLE_TIMEOUT", low=0.001, high=_MOST_MINUTES),
}
#: Fixed: the endpoints that an option may name.
ENDPOINTS = ("chat", "completions", "responses", "openrouter-chat", "openrouter-responses", "deepseek")


def in_range(key: Column, value: Column) -> Column:
    """Whether a named option's number is allowed; unknown names are not."""
    out = F.lit(False)
    for name, r in RANGES.items():
        out = F.when(key == name, r.column(value)).otherwise(out)
    return out


def error_code(key: Column, value: Column) -> Column:
    """The code of a number outside its range, null if it is allowed or the name is unknown."""
    out = F.lit(None).cast("string")
    for name, r in RANGES.items():
        out = F.when((key == name) & ~r.column(value), r.code).otherwise(out)
    return out


def check(options: Mapping[str, object]) -> None:
    """Raises ValueError with the code of the first value that is not allowed; names without a rule pass."""
    for name, value in options.items():
        if name in RANGES and not RANGES[name].holds(value):
            raise ValueError(RANGES[name].code)
        if name == "endpoint" and value not in ENDPOINTS:
            raise ValueError("INVALID_ENDPOINT")
        if name == "tempValues" and not (isinstance(value, list | tuple)):
            raise ValueError("INVALID_TEMP_VALUES_TYPE")
        if name == "tempValues" and not all(RANGES["temperature"].holds(x) for x in value):
            raise ValueError("INVALID_TEMP_VALUE")
        if name == "url" and not (isinstance(value, str) and value.startswith(("http://", "https://"))):
            raise ValueError("INVALID_URL_SCHEME" if isinstance(value, str) and value else "INVALID_URL")


def number(value: object) -> float:
    """A command line's text as a number: blank is 0, anything that is none is NaN."""
    if isinstance(value, int | float):
        return float(value)
    text = str(value).strip()
    try:
        return float(int(text, 0)) if text[:2].lower() in ("0x", "0o", "0b") else float(text) if text and "_" not in text else 0.0 if not text else math.nan
    except ValueError:
        return math.nan


def first_given(given: object, configured: object, fallback: object) -> object:
    """What was given (as a number where the others are), else what is configured, else the fallback."""
    if given is not None:
        return number(given)
    return configured if configured is not None else fallback


def common_params(supported: tuple[str, ...], own: Mapping[str, tuple[bool, object]], overrides: Mapping[str, object] = {}) -> dict[str, object]:
    """The parameters of a request: an override (of a pair, its value), else the configured one if it is switched on."""
    out = {}
    for name in supported:
        if (over := overrides.get(name)) is not None:
            out[name] = over[1] if isinstance(over, tuple | list) else over
        elif name in own and own[name][0]:
            out[name] = own[name][1]
    return out


#: Fixed: how a model reasons, and the part of its configuration that then counts.
REASONING = {"reason_and_instruct": ("reasoning", "instruct"), "instruct_only": ("default", "default"), "reason_only": ("default", "default")}


def uses_reasoning(asked: Column, default: Column) -> Column:
    """Asking turns the default round; nulls count as no."""
    return F.coalesce(asked, F.lit(False)) != F.coalesce(default, F.lit(False))


def variant_name(kind: Column, reasoning: Column) -> Column:
    """Which part of a model's configuration counts; null for an unknown kind."""
    out = F.lit(None).cast("string")
    for name, (yes, no) in REASONING.items():
        out = F.when(kind == name, F.when(reasoning, yes).otherwise(no)).otherwise(out)
    return out


def pick_variant(models: Mapping[str, Mapping], name: str, reasoning: bool) -> Mapping:
    """The part of a named model's configuration that counts."""
    if name not in models:
        raise ValueError("UNDEFINED_PARAM")
    if (kind := models[name].get("reasoningType")) not in REASONING:
        raise ValueError("INVALID_REASONING_TYPE")
    return models[name][REASONING[kind][0 if reasoning else 1]]
