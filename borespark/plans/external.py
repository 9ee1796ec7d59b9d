"""External operators: a JSON request on standard input, a JSON response on standard output.

A request names operator, package and parameters and carries one asset's payload: named curves for kind 'log', rows for
the others.  ``Host`` is the operator's side; ``run_log`` and ``run_table`` send every asset of a DataFrame through a command.
"""

from __future__ import annotations

import json
import math
import subprocess
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Kinds of payload and the fields of their rows (fixed values).
ROWS = {
    "trajectory": ("measured_depth", "true_vertical_depth", "azimuth_deg", "inclination_deg", "northing_offset", "easting_offset"),
    "top_set": ("name", "top_depth", "base_depth", "source", "source_depth_reference", "depth_domain", "depth_datum"),
    "pressure_observation": ("measured_depth", "pressure", "phase", "test_kind", "timestamp"),
    "drilling_observation": ("measured_depth", "event_kind", "value", "unit", "timestamp", "comment"),
}
KINDS = ("log", *ROWS)
#: Fields of a computed curve that a response must have (fixed values).
CURVE = ("curve_name", "original_mnemonic", "unit", "description", "semantic_type", "values")


@dataclass
class Host:
    """Operators by id; each takes the request and returns a curve, a list of rows, or a whole response."""

    operators: dict[str, Callable[[dict], object]] = field(default_factory=dict)

    def operator(self, id: str):
        def keep(function):
            self.operators[id] = function
            return function

        return keep

    def answer(self, request: Mapping) -> dict:
        id, kind = request["operator_id"], request["payload"]["kind"]
        if id not in self.operators:
            raise KeyError(f"no operator {id}")
        if kind not in KINDS:
            raise ValueError(f"no payloads of kind {kind}")
        result = self.operators[id](dict(request))
        if isinstance(result, Mapping) and "payload" in result:
            return dict(result)
        if kind == "log":
            if not isinstance(result, Mapping):
                raise TypeError("a log operator returns a curve")
            return {"payload": {"kind": "log", "computed_curve": dict(result)}}
        if not isinstance(result, list):
            raise TypeError("a table operator returns rows")
        return {"payload": {"kind": kind, "rows": result}}

    def main(self) -> int:
        json.dump(self.answer(json.load(sys.stdin)), sys.stdout)
        print()
        return 0


def request(operator: str, kind: str, payload: Mapping, parameters: Mapping | None = None, package: str = "", version: str = "") -> dict:
    return {"operator_id": operator, "package_name": package, "package_version": version, "parameters": dict(parameters or {}), "payload": {"kind": kind, **payload}}


def call(command: Sequence[str], message: Mapping, seconds: float = 60.0) -> dict:
    """One request to a command; what it says on standard error goes into the error."""
    done = subprocess.run(list(command), input=json.dumps(message), capture_output=True, text=True, timeout=seconds, check=False)
    if done.returncode:
        raise RuntimeError(f"{message['operator_id']} failed: {done.stderr.strip()[-500:]}")
    payload = json.loads(done.stdout)["payload"]
    if payload.get("kind") != message["payload"]["kind"]:
        raise ValueError(f"{message['operator_id']} answered with {payload.get('kind')}")
    return payload


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and not math.isfinite(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def run_log(df: DataFrame, command: Sequence[str], operator: str, keys: Sequence[str], depth: str, inputs: Mapping[str, str], parameters: Mapping | None = None, types: Mapping[str, str] | None = None, seconds: float = 60.0) -> DataFrame:
    """df with ``value``: the curve that the command computes of each asset's input curves (name -> column), by depth.

    One call an asset (keys); an asset's curves are held by one task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "value") + ", value double"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(depth, kind="stable")
        depths = [float(d) for d in pdf[depth]]
        curves = {n: {"curve_name": c, "original_mnemonic": c, "unit": None, "semantic_type": (types or {}).get(n, "Unknown"), "depths": depths, "values": [_plain(v) for v in pdf[c]]} for n, c in inputs.items()}
        curve = call(command, request(operator, "log", {"inputs": curves, "output_mnemonic": None}, parameters), seconds)["computed_curve"]
        lacking = [f for f in CURVE if f not in curve]
        if lacking or len(curve["values"]) != len(pdf):
            raise ValueError(f"{operator}: a curve without {lacking}" if lacking else f"{operator}: {len(curve['values'])} values for {len(pdf)} samples")
        return pdf.drop(columns="value", errors="ignore").assign(value=[None if v is None else float(v) for v in curve["values"]])

    return df.groupBy(*keys).applyInPandas(work, schema)


def run_table(df: DataFrame, command: Sequence[str], operator: str, kind: str, keys: Sequence[str], parameters: Mapping | None = None, seconds: float = 60.0) -> DataFrame:
    """(keys, fields of the kind): the rows that the command makes of each asset's rows; fields that df lacks are NULL."""
    fields = ROWS[kind]
    have = [f for f in fields if f in df.columns]
    numbers = {"measured_depth", "true_vertical_depth", "azimuth_deg", "inclination_deg", "northing_offset", "easting_offset", "top_depth", "base_depth", "pressure", "value"}
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{f}` {'double' if f in numbers else 'string'}" for f in fields])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{f: _plain(r[f]) if f in have else None for f in fields} for r in pdf.to_dict("records")]
        out = pd.DataFrame(call(command, request(operator, kind, {"rows": rows}, parameters), seconds)["rows"], columns=list(fields))
        for k in reversed(list(keys)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, *have).groupBy(*keys).applyInPandas(work, schema)
