"""Pipelines declared as configuration: a list of processors becomes one lazy plan."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Processor = Callable[[DataFrame, dict], DataFrame]
_REGISTRY: dict[str, Processor] = {}


def processor(name: str) -> Callable[[Processor], Processor]:
    """Register a function (rows, config) -> rows under a name."""
    def add(f: Processor) -> Processor:
        _REGISTRY[name] = f
        return f

    return add


def interpolate(value, variables: dict[str, str], env: dict[str, str] | None = None):
    """${v} and ${ENV:v} in every string of a configuration; unknown names stay as they are. Variables may use those before them."""
    env = os.environ if env is None else env
    known: dict[str, str] = {}

    def sub(s: str) -> str:
        return re.sub(r"\$\{(ENV:)?([^}]+)\}", lambda m: str(env.get(m[2], m[0]) if m[1] else known.get(m[2], m[0])), s)

    for k, v in variables.items():
        known[k] = sub(v) if isinstance(v, str) else v

    def walk(x):
        if isinstance(x, str):
            return sub(x)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return walk(value)


def invalid_keys(given: dict, known: dict, path: str = "") -> list[str]:
    """Dotted keys of an option dict that the known one lacks."""
    out = []
    for k, v in given.items():
        if k not in known:
            out.append(path + k)
        elif isinstance(v, dict) and isinstance(known[k], dict):
            out.extend(invalid_keys(v, known[k], f"{path}{k}."))
    return out


def selected(steps: list[dict], includes: list[str] = (), excludes: list[str] = ()) -> list[dict]:
    """Enabled steps, those included, or those not excluded; both lists at once are an error."""
    if includes and excludes:
        raise ValueError("includes and excludes")
    on = [s for s in steps if s.get("enabled", True)]
    return [s for s in on if (not includes or s.get("name") in includes) and s.get("name") not in (excludes or ())]


def merge_branches(base: DataFrame, branches: list[DataFrame], key: str) -> DataFrame:
    """Branches joined on a unique key; of a column that several set, the last branch's value counts where it is not null."""
    out = base
    for i, b in enumerate(branches):
        new = [c for c in b.columns if c != key]
        renamed = b.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{i}_{c}") for c in new])
        joined = out.join(renamed, F.col(key).eqNullSafe(F.col("__key")), "left")
        out = joined.select(*[F.coalesce(f"__{i}_{c}", c).alias(c) if c in new else F.col(c) for c in out.columns], *[F.col(f"__{i}_{c}").alias(c) for c in new if c not in out.columns])
    return out


def build(rows: DataFrame, config: dict, includes: list[str] = (), excludes: list[str] = (), key: str = "doc_id") -> DataFrame:
    """The plan of a configuration {variables, processor_list, processor_input_config}; a step with its own processor_list runs its members side by side."""
    config = interpolate(config, config.get("variables", {}))
    settings = config.get("processor_input_config", {})
    for step in selected(config["processor_list"], includes, excludes):
        if "processor_list" in step:
            rows = merge_branches(rows, [_run(rows, s, settings) for s in selected(step["processor_list"])], key)
        else:
            rows = _run(rows, step, settings)
    return rows


def _run(rows: DataFrame, step: dict, settings: dict) -> DataFrame:
    if step["name"] not in _REGISTRY:
        raise KeyError(f"no processor {step['name']}")
    return _REGISTRY[step["name"]](rows, settings.get(step["name"], {}))
