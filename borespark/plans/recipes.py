"""Recipes: named steps over named tables, validated, digested, run and reported."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from borespark.operators.traces import Step, run_pipeline
from borespark.plans.registry import Registry, built_in

VERSION = 1


@dataclass
class Report:
    """What ran: status per step, seconds, manifests, failed assertions."""

    recipe: str
    digest: str
    steps: list[dict] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    def to_markdown(self) -> str:
        lines = [f"# {self.recipe}", "", f"Digest `{self.digest}`", "", "| step | operator | seconds |", "|---|---|---|"]
        lines += [f"| {s['id']} | {s['operator']} | {s['seconds']:.2f} |" for s in self.steps]
        return "\n".join([*lines, "", *(f"- {f}" for f in self.failures)])


def validate(recipe: dict, registry: Registry) -> list[str]:
    """All faults of a recipe {version, id, name, inputs: [{id, path}], steps: [{id, input, operator, ...}], asserts}."""
    faults = []
    if recipe.get("version") != VERSION:
        faults.append(f"version must be {VERSION}")
    faults += [f"{k} must not be empty" for k in ("id", "name") if not str(recipe.get(k, "")).strip()]
    known: set[str] = set()
    for item in recipe.get("inputs", []):
        if item["id"] in known:
            faults.append(f"input {item['id']} is given twice")
        known.add(item["id"])
    for step in recipe.get("steps", []):
        if step["input"] not in known:
            faults.append(f"step {step['id']} reads {step['input']}, which nothing before it makes")
        if step["id"] in known:
            faults.append(f"step {step['id']} is given twice")
        if step["operator"] != "traces" and step["operator"] not in registry.operators:
            faults.append(f"step {step['id']} names no operator")
        known.add(step["id"])
    faults += [f"assertion on {a['table']}, which nothing makes" for a in recipe.get("asserts", []) if a["table"] not in known]
    return faults


def digest(recipe: dict) -> str:
    return hashlib.sha256(json.dumps(recipe, sort_keys=True).encode()).hexdigest()


def run(spark: SparkSession, recipe: dict, registry: Registry | None = None) -> tuple[dict[str, DataFrame], Report]:
    """Tables by id and the report; assertions {table, condition} must hold for every row."""
    registry = registry or built_in()
    if faults := validate(recipe, registry):
        raise ValueError("; ".join(faults))
    tables = {i["id"]: spark.read.parquet(i["path"]) for i in recipe.get("inputs", [])}
    report = Report(recipe["name"], digest(recipe))
    for step in recipe.get("steps", []):
        start = time.perf_counter()
        if step["operator"] == "traces":
            tables[step["id"]] = run_pipeline(tables[step["input"]], [Step(s["name"], s.get("parameters", {})) for s in step["steps"]], step["interval_ms"])
            made = {}
        else:
            tables[step["id"]], manifest = registry.execute(step["operator"], tables[step["input"]], step.get("bindings"), step.get("parameters"))
            made = {"manifest": manifest.digest}
        report.steps.append({"id": step["id"], "operator": step["operator"], "seconds": time.perf_counter() - start, **made})
    for a in recipe.get("asserts", []):
        if not tables[a["table"]].where(f"not coalesce({a['condition']}, false)").isEmpty():
            report.failures.append(f"{a['table']}: {a['condition']}")
    return tables, report
