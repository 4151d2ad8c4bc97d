"""Scoring settings: ranges, domains and combinations that are refused (p22).

One table of rules serves both a call's settings on the driver and a table of settings, a row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The settings' ranges and domains.
RANGES = {"tau": (0.0, math.inf), "tau_percentile": (0.0, 100.0), "alpha": (0.0, 1.0)}
DOMAINS = {"backend": ("auto", "cpu", "cuda", "rocm", "vulkan", "metal"), "kv_cache_type": ("f16", "q8_0", "q4_0"), "flash_attention": ("auto", "on", "off"), "entropy_reduction": ("host", "device"), "hierarchy_mode": ("structural", "reference")}


class BadSettings(ValueError):
    """A setting out of its range or domain, or two that exclude each other."""


def _rules() -> list[tuple[str, str]]:
    """(fault, SQL condition under which it holds), in the order in which faults are told. Null stands for a setting that is not given."""
    out = [("tau and tau_percentile exclude each other", "tau is not null and tau_percentile is not null"), ("a quantized cache needs flash attention", "kv_cache_type <> 'f16' and flash_attention = 'off'")]
    for name, (low, high) in RANGES.items():
        above = "" if high == math.inf else f" or {name} > {high}D"
        out.append((f"{name} is out of range", f"isnan({name}) or {name} = double('Infinity') or {name} < {low}D{above}"))
    out += [(f"{name} is unknown", f"{name} not in ({', '.join(repr(x) for x in known)})") for name, known in DOMAINS.items()]
    out += [("force_cpu and gpu_layers exclude each other", "force_cpu and gpu_layers <> 0"), ("gpu_layers is out of range", "gpu_layers < -1"), ("device reduction needs all layers on a GPU", "entropy_reduction = 'device' and gpu_layers <> -1")]
    return out


RULES = _rules()
#: The columns of a table of settings.
SETTINGS = "tau double, tau_percentile double, alpha double, backend string, kv_cache_type string, flash_attention string, entropy_reduction string, hierarchy_mode string, force_cpu boolean, gpu_layers int"


def settings_fault() -> Column:
    """The first rule that a row of SETTINGS breaks, null if none."""
    return F.coalesce(*(F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(fault)) for fault, condition in RULES))


def check_settings(**given: object) -> None:
    """BadSettings for the first rule that these settings break."""
    known = [x.split()[0] for x in SETTINGS.split(", ")]
    if odd := set(given) - set(known):
        raise BadSettings(f"unknown settings: {', '.join(sorted(odd))}")
    has = {name: given.get(name) for name in known}
    if has["tau"] is not None and has["tau_percentile"] is not None:
        raise BadSettings(RULES[0][0])
    if has["kv_cache_type"] not in (None, "f16") and has["flash_attention"] == "off":
        raise BadSettings(RULES[1][0])
    for name, (low, high) in RANGES.items():
        if has[name] is not None and not (math.isfinite(has[name]) and low <= has[name] <= high):
            raise BadSettings(f"{name} is out of range")
    for name, values in DOMAINS.items():
        if has[name] is not None and has[name] not in values:
            raise BadSettings(f"{name} is unknown")
    layers = has["gpu_layers"]
    if has["force_cpu"] and layers not in (None, 0):
        raise BadSettings("force_cpu and gpu_layers exclude each other")
    if layers is not None and layers < -1:
        raise BadSettings("gpu_layers is out of range")
    if has["entropy_reduction"] == "device" and layers not in (None, -1):
        raise BadSettings("device reduction needs all layers on a GPU")
