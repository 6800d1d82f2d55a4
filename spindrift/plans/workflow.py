"""Workflow plans: named steps over tables, stored as JSON, run as DataFrame functions.

A step names an operation of ``OPERATIONS`` and its parameters, in which ``{name}`` stands
for a variable of the plan.  A step's inputs are tables by name; its output is a table that
later steps can use, and is written as Parquet where it has a ``path``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import joins, longitudinal
from spindrift.sources.files import read_table


@dataclass
class Step:
    name: str
    operation: str
    inputs: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    path: str | None = None


@dataclass
class Plan:
    name: str
    vars: dict = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Plan:
        d = json.loads(Path(path).read_text())
        return cls(d["name"], d.get("vars", {}), [Step(**s) for s in d.get("steps", [])])


def resolve(value, variables: dict):
    """``{name}`` and ``${NAME:-default}`` in strings, through lists and dicts; a variable
    may use others, an unknown one without a default raises."""
    if isinstance(value, dict):
        return {k: resolve(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def one(m, seen=()):
        key, default = m.group("a") or m.group("b"), m.group("d")
        if key in seen:
            raise ValueError(f"variable {key} refers to itself")
        if key in variables:
            text = str(variables[key])
        elif default is not None:
            text = default
        else:
            raise KeyError(key)
        return pattern.sub(lambda n: one(n, (*seen, key)), text)

    pattern = re.compile(r"\$\{(?P<a>\w+)(?::-(?P<d>[^}]*))?\}|\{(?P<b>\w+)\}")
    return pattern.sub(one, value)


OPERATIONS: dict[str, Callable] = {}


def operation(f):
    OPERATIONS[f.__name__] = f
    return f


@operation
def read(spark, tables, path, strings=False):
    return read_table(spark, path, strings=strings)


@operation
def merge(spark, tables, **params):
    return joins.merge_outcome(*tables, **params)


@operation
def engines(spark, tables, names, key="patient_id"):
    return joins.merge_engines(dict(zip(names, tables)), key)


@operation
def union(spark, tables):
    return joins.union_rows(*tables)


@operation
def differences(spark, tables, pairs, **params):
    return longitudinal.differences(tables[0], {k: tuple(v) for k, v in pairs.items()}, **params)


@operation
def cox_scan(spark, tables, **params):
    from spindrift.models.survival import cox_scan as scan

    return scan(tables[0], **params)


@operation
def logit_scan(spark, tables, **params):
    from spindrift.models.classify import logit_scan as scan

    return scan(tables[0], **params)


@operation
def sql(spark, tables, text, names):
    for n, t in zip(names, tables):
        t.createOrReplaceTempView(n)
    return spark.sql(text)


def run(spark: SparkSession, plan: Plan, **variables) -> dict[str, DataFrame]:
    """All tables by name.  Steps are composed lazily in their order; a step with a path is
    written, and read again by later steps.  The first step that fails ends the run."""
    values, tables = {**plan.vars, **variables}, {}
    for s in plan.steps:
        if s.operation not in OPERATIONS:
            raise ValueError(f"step {s.name}: no operation {s.operation}")
        out = OPERATIONS[s.operation](spark, [tables[i] for i in s.inputs], **resolve(s.params, values))
        if s.path:
            path = resolve(s.path, values)
            out.write.mode("overwrite").parquet(path)
            out = spark.read.parquet(path)
        tables[s.name] = out
    return tables


def survival_plan(features: str, clinical: str, out: str, clinical_id: str, time: str, event: str) -> Plan:
    """Features and outcomes joined, then one Cox model for each feature."""
    return Plan(
        "survival",
        {"features": features, "clinical": clinical, "out": out},
        [
            Step("features", "read", params={"path": "{features}"}),
            Step("clinical", "read", params={"path": "{clinical}"}),
            Step("ready", "merge", ["features", "clinical"], {"clinical_id": clinical_id, "time": time, "event": event}, "{out}/analysis_ready.parquet"),
            Step("cox", "cox_scan", ["ready"], {}, "{out}/cox_results.parquet"),
        ],
    )


def classify_plan(features: str, clinical: str, out: str, clinical_id: str, outcome: str) -> Plan:
    """Features and an outcome joined, then one logistic model for each feature."""
    return Plan(
        "classify",
        {"features": features, "clinical": clinical, "out": out},
        [
            Step("features", "read", params={"path": "{features}"}),
            Step("clinical", "read", params={"path": "{clinical}"}),
            Step("ready", "merge", ["features", "clinical"], {"clinical_id": clinical_id, "outcome": outcome}, "{out}/analysis_ready.parquet"),
            Step("logit", "logit_scan", ["ready"], {"outcome": outcome}, "{out}/logit_results.parquet"),
        ],
    )


TEMPLATES = {"survival": survival_plan, "classify": classify_plan}
