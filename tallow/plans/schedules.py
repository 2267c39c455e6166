"""Plain rules of a run: learning rates, layers, preset shares, where a calibration comes from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("mismatch", "noisy", "truncated", "wrong_answer")


def cosine_rate(spark: SparkSession, steps: int, warmup: int, cycles: float = 0.5) -> DataFrame:
    """step, factor: a linear rise over ``warmup`` steps, then a cosine down to zero."""
    step = F.col("id")
    done = (step - warmup) / max(1, steps - warmup)
    fall = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(math.pi * cycles * 2 * done)))
    return spark.range(steps + 1).select(F.col("id").alias("step"), F.when(step < warmup, step / max(1, warmup)).otherwise(fall).alias("factor"))


def layers(spec: str | list[int], n: int) -> list[int]:
    """all, middle_to_last, or a list of layers below n."""
    if isinstance(spec, str):
        if spec not in ("all", "middle_to_last"):
            raise ValueError(f"unknown layers: {spec}")
        return list(range(0 if spec == "all" else n // 2, n))
    if bad := [i for i in spec if not 0 <= int(i) < n]:
        raise ValueError(f"layers {bad} of {n}")
    return [int(i) for i in spec]


def preset(name: str) -> dict[str, float]:
    """compositeN and groundedN (N percent in all), pertype-KIND-N."""
    shares = dict.fromkeys(KINDS, 0.0)
    if name.startswith("pertype-"):
        _, kind, percent = name.split("-")
        if kind not in shares:
            raise ValueError(f"unknown kind: {kind}")
        return shares | {kind: float(percent) / 100}
    for start, used in (("grounded", ("mismatch", "noisy")), ("composite", KINDS)):
        if name.startswith(start):
            return shares | dict.fromkeys(used, float(name.removeprefix(start)) / 100 / len(used))
    raise ValueError(f"unknown preset: {name}")


#: Settings that the token losses were made under; another value needs another forward pass.
FORWARD_BOUND = ("include_eos", "c_trunc", "max_seq_len")


def recomputable(cached: dict, wanted: dict) -> dict:
    """The settings to derive a gate again from cached losses; a changed forward-bound one is an error."""
    if changed := [k for k in FORWARD_BOUND if k in wanted and wanted[k] != cached.get(k)]:
        raise ValueError(f"bound by the forward pass: {', '.join(changed)}")
    return cached | wanted


def calibration(explicit: dict | None, reference: dict | None, cached: dict | None, settings: dict) -> tuple[str, dict]:
    """(where from, calibration): given values first, then a clean reference's, then the cache's.

    One made under another span width, threshold or alpha is refused.
    """
    for name, found in (("explicit", explicit), ("reference", reference), ("cache", cached)):
        if found is None:
            continue
        if off := [k for k in ("span_tokens", "tau", "alpha", "target_pct") if k in found and k in settings and found[k] != settings[k]]:
            raise ValueError(f"the {name} calibration was made with other {', '.join(off)}")
        if not found.get("scale", 0) > 0:
            raise ValueError(f"the {name} calibration has no positive scale")
        return name, found
    raise ValueError("no calibration: give one, or a clean reference")


def require_base_gate(epoch: int, gate_from: str) -> None:
    """After the first epoch only a gate of the base checkpoint may be used."""
    if epoch > 1 and gate_from != "base":
        raise ValueError(f"epoch {epoch} must use the gate of the base checkpoint, not of {gate_from}")


def shard_bounds(n: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous [from, to) ranges: shard i begins at round(i n / shards)."""
    at = [round(i * n / shards) for i in range(shards + 1)]
    return list(zip(at, at[1:]))
