"""Typed operators: definition, parameter checks, eligibility by curve kind, runs with lineage, user operators.

An operator belongs to a family (log, trajectory, tops, pressure, drilling, traces, gathers) and maps a
DataFrame to a DataFrame.  The registry tells which operators an asset may use and why not, validates
parameters, runs an operator and returns a manifest that names what was done to what.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.functions import petro
from borespark.operators import frames


class Family(StrEnum):
    LOG = "log"
    TRAJECTORY = "trajectory"
    TOPS = "tops"
    PRESSURE = "pressure"
    DRILLING = "drilling"
    TRACES = "traces"
    GATHERS = "gathers"


class Subject(StrEnum):
    """What an operator works on."""

    LOG = "log"
    TRAJECTORY = "trajectory"
    TOP_SET = "top_set"
    WELL_MARKER_SET = "well_marker_set"
    PRESSURE_OBSERVATION = "pressure_observation"
    DRILLING_OBSERVATION = "drilling_observation"
    SEISMIC_TRACE_DATA = "seismic_trace_data"


class Lifecycle(StrEnum):
    """What becomes of an operator's output."""

    DERIVED_ASSET = "derived_asset"
    ANALYSIS_ONLY = "analysis_only"
    VIEW_ONLY = "view_only"


class Stability(StrEnum):
    INTERNAL = "internal"
    PREVIEW = "preview"
    STABLE = "stable"


#: Subjects of the families.
SUBJECTS = {
    Family.LOG: Subject.LOG, Family.TRAJECTORY: Subject.TRAJECTORY, Family.TOPS: Subject.TOP_SET, Family.PRESSURE: Subject.PRESSURE_OBSERVATION, Family.DRILLING: Subject.DRILLING_OBSERVATION,
    Family.TRACES: Subject.SEISMIC_TRACE_DATA, Family.GATHERS: Subject.SEISMIC_TRACE_DATA,
}


@dataclass(frozen=True)
class Parameter:
    """A number (with bounds), text or flag."""

    name: str
    kind: str = "number"
    default: float | str | bool | None = None
    least: float | None = None
    most: float | None = None

    def check(self, value):
        if value is None:
            if self.default is None:
                raise ValueError(f"{self.name} is required")
            return self.default
        if self.kind == "number":
            if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
                raise ValueError(f"{self.name} must be a number")
            if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
                raise ValueError(f"{self.name} must be in [{self.least}, {self.most}]")
        elif not isinstance(value, {"text": str, "flag": bool}[self.kind]):
            raise ValueError(f"{self.name} must be a {self.kind}")
        return value


@dataclass(frozen=True)
class Input:
    """A named input curve and the kinds it may have; none named: any numeric curve but depth and time."""

    name: str
    kinds: tuple[str, ...] = ()

    def takes(self, kind: str) -> bool:
        return kind in self.kinds if self.kinds else kind not in ("depth", "time")


@dataclass(frozen=True)
class Operator:
    id: str
    family: Family
    run: Callable[..., DataFrame]
    inputs: tuple[Input, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    output: str = "value"
    version: str = "1"
    deterministic: bool = True
    stability: Stability = Stability.STABLE
    lifecycle: Lifecycle = Lifecycle.DERIVED_ASSET

    @property
    def subject(self) -> Subject:
        return SUBJECTS[self.family]

    def settle(self, given: Mapping | None) -> dict:
        """All parameters with defaults, checked; unknown names are errors."""
        given = dict(given or {})
        out = {p.name: p.check(given.pop(p.name, None)) for p in self.parameters}
        if given:
            raise ValueError(f"{self.id} has no parameters {sorted(given)}")
        return out


@dataclass(frozen=True)
class Manifest:
    """Lineage of one run."""

    operator: str
    version: str
    parameters: dict
    inputs: dict
    digest: str


@dataclass
class Registry:
    operators: dict[str, Operator] = field(default_factory=dict)

    def add(self, operator: Operator) -> Operator:
        if operator.id in self.operators:
            raise ValueError(f"{operator.id} is registered already")
        self.operators[operator.id] = operator
        return operator

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(o.id, str(o.family), o.version, str(o.stability), json.dumps([asdict(p) for p in o.parameters]), json.dumps([asdict(i) for i in o.inputs])) for o in self.operators.values()]
        return spark.createDataFrame(rows, "id string, family string, version string, stability string, parameters string, inputs string")

    def availability(self, curves: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
        """(keys, operator, available, reason) of log operators for assets whose curves (keys, kind) are given.

        One grouped set of kinds per asset, then one row per operator by an explode of literals.
        """
        logs = [o for o in self.operators.values() if o.family == Family.LOG]
        table = F.array(*[F.struct(F.lit(o.id).alias("operator"), F.array(*[F.struct(F.lit(i.name).alias("name"), F.array(*[F.lit(k) for k in i.kinds]).cast("array<string>").alias("kinds")) for i in o.inputs]).alias("inputs")) for o in logs])
        kinds = curves.groupBy(*keys).agg(F.collect_set("kind").alias("have"))
        rows = kinds.withColumn("o", F.explode(table))
        free = F.array_except("have", F.array(F.lit("depth"), F.lit("time")))
        lacking = F.filter(F.col("o.inputs"), lambda i: F.when(F.size(i["kinds"]) > 0, ~F.arrays_overlap(i["kinds"], F.col("have"))).otherwise(F.size(free) == 0))
        names = F.array_join(F.transform(lacking, lambda i: i["name"]), ", ")
        return rows.select(*keys, F.col("o.operator").alias("operator"), (F.size(lacking) == 0).alias("available"), F.when(F.size(lacking) > 0, F.concat(F.lit("no curve for "), names)).alias("reason"))

    def execute(self, id: str, df: DataFrame, bindings: Mapping[str, str] | None = None, parameters: Mapping | None = None) -> tuple[DataFrame, Manifest]:
        operator = self.operators[id]
        bound = dict(bindings or {})
        missing = [i.name for i in operator.inputs if i.name not in bound]
        if missing:
            raise ValueError(f"{id} needs {missing}")
        settled = operator.settle(parameters)
        text = json.dumps([id, operator.version, settled, bound], sort_keys=True)
        manifest = Manifest(id, operator.version, settled, bound, hashlib.sha256(text.encode()).hexdigest())
        return operator.run(df, **bound, **settled), manifest

    def user_log_operator(self, id: str, function: Callable[[pd.Series], pd.Series], parameters: tuple[Parameter, ...] = ()) -> Operator:
        """Registers a vectorised function of one curve (column in, column out)."""

        def run(df: DataFrame, curve: str, **settled) -> DataFrame:
            udf = F.pandas_udf(lambda s: function(s, **settled), "double")
            return df.withColumn("value", udf(F.col(curve).cast("double")))

        return self.add(Operator(id, Family.LOG, run, (Input("curve"),), parameters, stability=Stability.PREVIEW))

    def user_table_operator(self, id: str, family: Family, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str]) -> Operator:
        """Registers a function of one asset's table (table in, table out)."""
        return self.add(Operator(id, family, lambda df: df.groupBy(*keys).applyInPandas(function, schema), stability=Stability.PREVIEW))


def _column(function, *inputs: Input, output: str = "value", parameters: tuple[Parameter, ...] = ()):
    names = [i.name for i in inputs]

    def run(df: DataFrame, **given) -> DataFrame:
        return df.withColumn(output, function(*[given.pop(n) for n in names], **given))

    return run, inputs, parameters


def built_in() -> Registry:
    """The built-in log and table operators."""
    r = Registry()
    line = (Parameter("low", default=30.0), Parameter("high", default=100.0))
    gr, vp, vs, rho, phi = Input("gr", ("gamma_ray",)), Input("vp", ("p_velocity",)), Input("vs", ("s_velocity",)), Input("rho", ("bulk_density",)), Input("phi", ("neutron_porosity", "effective_porosity"))
    for id, function, inputs, parameters in (
        ("gap_flag", petro.gap_flag, (Input("curve"),), ()),
        ("vshale_linear", petro.vshale_linear, (gr,), line),
        ("vshale_clavier", petro.vshale_clavier, (gr,), line),
        ("vshale_steiber", petro.vshale_steiber, (gr,), line),
        ("sonic_velocity", petro.slowness_to_velocity, (Input("s", ("sonic",)),), ()),
        ("shear_sonic_velocity", petro.slowness_to_velocity, (Input("s", ("shear_sonic",)),), ()),
        ("vp_vs_ratio", petro.vp_vs_ratio, (vp, vs), ()),
        ("acoustic_impedance", petro.acoustic_impedance, (vp, rho), ()),
        ("shear_impedance", petro.shear_impedance, (vs, rho), ()),
        ("lambda_rho", petro.lambda_rho, (vp, vs, rho), ()),
        ("mu_rho", petro.mu_rho, (vs, rho), ()),
        ("poisson_ratio", petro.poisson_ratio, (vp, vs), ()),
    ):
        run, ins, ps = _column(function, *inputs, parameters=parameters)
        r.add(Operator(id, Family.LOG, run, ins, ps))
    fluids = tuple(Parameter(n, default=d, least=1e-6) for n, d in asdict(petro.Fluids()).items())
    for number, part in enumerate(("density", "vp", "vs")):

        def substitute(df, vp, vs, rho, phi, number=number, **settled):
            names = tuple("value" if k == number else f"__other{k}" for k in range(3))
            return petro.with_gassmann(df, vp, vs, rho, phi, petro.Fluids(**settled), names).drop(*[n for n in names if n != "value"])

        r.add(Operator(f"gassmann_{part}", Family.LOG, substitute, (vp, vs, rho, phi), fluids))
    keys = (Parameter("keys", "text", "well"), Parameter("order", "text", "row_idx"))
    for id, family, most, default in (("moving_average", Family.LOG, 501, 5), ("smooth_inclination", Family.TRAJECTORY, 101, 5), ("pressure_average", Family.PRESSURE, 51, 3), ("drilling_average", Family.DRILLING, 51, 3)):

        def smooth(df, curve, window, keys, order):
            return frames.moving_average(df, keys.split(","), order.split(","), curve, window, out="value")

        r.add(Operator(id, family, smooth, (Input("curve"),), (Parameter("window", default=default, least=1, most=most), *keys)))
    r.add(Operator("z_score", Family.LOG, lambda df, curve, keys, order: frames.z_score(df, keys.split(","), curve, out="value"), (Input("curve"),), keys))
    r.add(Operator("min_max", Family.LOG, lambda df, curve, low, high, keys, order: frames.min_max_scale(df, keys.split(","), curve, low, high, out="value"), (Input("curve"),), (Parameter("low", default=0.0), Parameter("high", default=1.0), *keys)))
    r.add(Operator("normalise_azimuth", Family.TRAJECTORY, lambda df, curve: df.withColumn("value", petro.normalise_azimuth(curve)), (Input("curve"),)))
    r.add(Operator("normalise_phase", Family.PRESSURE, lambda df, curve: df.withColumn("value", petro.normalise_phase(curve)), (Input("curve"),)))
    r.add(Operator("normalise_event_kind", Family.DRILLING, lambda df, curve: df.withColumn("value", petro.normalise_event_kind(curve)), (Input("curve"),)))
    r.add(Operator("sort_tops", Family.TOPS, lambda df, curve: df.orderBy(F.asc_nulls_last(curve)), (Input("curve"),)))
    r.add(Operator("fill_base", Family.TOPS, lambda df, top, base, keys, order: frames.fill_base(df, keys.split(","), top, base), (Input("top"), Input("base")), keys))
    return r


def load_package(registry: Registry, path: str, functions: Mapping[str, Callable]) -> list[str]:
    """Registers the operators of a JSON manifest {name, version, operators: [{id, family, parameters}]}.

    The manifest's digest is returned as a lock line with each id; functions come by id from the caller.  Log operators
    are functions of a column; operators of the other families take and return an asset's table, and name
    the ``keys`` of an asset and the ``schema`` of their result.
    """
    text = Path(path).read_text()
    manifest = json.loads(text)
    digest, out = hashlib.sha256(text.encode()).hexdigest(), []
    for item in manifest["operators"]:
        if item["id"] not in functions:
            raise ValueError(f"no function for {item['id']}")
        parameters, family = tuple(Parameter(**p) for p in item.get("parameters", ())), Family(item["family"])
        if family == Family.LOG:
            registry.user_log_operator(item["id"], functions[item["id"]], parameters)
        elif parameters or not item.get("keys") or not item.get("schema"):
            raise ValueError(f"{item['id']}: table operators name keys and schema, and have no parameters")
        else:
            registry.user_table_operator(item["id"], family, functions[item["id"]], item["schema"], item["keys"])
        out.append(f"{item['id']}@{manifest['version']}:{digest}")
    return out


@dataclass(frozen=True)
class Capability:
    """Something the engine can do, or why it can't here."""

    id: str
    kind: str
    available: bool = True
    reason: str | None = None


@dataclass
class Capabilities:
    """Capabilities by id; a later record replaces an earlier one of the same id."""

    records: dict[str, Capability] = field(default_factory=dict)

    def add(self, *records: Capability) -> None:
        self.records |= {r.id: r for r in records}

    def of_kind(self, kind: str) -> list[Capability]:
        return [r for r in self.records.values() if r.kind == kind]

    def available(self) -> list[Capability]:
        return [r for r in self.records.values() if r.available]


def capabilities(registry: Registry) -> Capabilities:
    """Operators of the registry, formats and systems, with what is missing for those that can't be used."""
    out = Capabilities()
    out.add(*[Capability(o.id, "operator") for o in registry.operators.values()])
    out.add(*[Capability(f, "format") for f in ("las", "segy", "zarr", "csv", "horizon_text", "velocity_text")])
    out.add(*[Capability(f, "format", False, "needs a library that isn't there") for f in ("vds", "hdf5")], Capability("transverse_mercator", "projection"))
    return out


@dataclass
class ResultCache:
    """Plan digest -> Parquet folder below ``root``: exact results, and the longest prefix of a pipeline that is stored.

    The folder itself is the index, so another session finds what this one stored; a folder that isn't whole counts as none.
    """

    spark: SparkSession
    root: str

    @staticmethod
    def digest(source: str, steps: Sequence) -> str:
        return hashlib.sha256(json.dumps([source, [[s.name, s.parameters] for s in steps]], sort_keys=True).encode()).hexdigest()

    def _stored(self, key: str) -> str | None:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}/_SUCCESS")
        there = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
        return f"{self.root}/{key}" if there else None

    def put(self, source: str, steps: Sequence, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.digest(source, steps)}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def exact(self, source: str, steps: Sequence) -> DataFrame | None:
        path = self._stored(self.digest(source, steps))
        return self.spark.read.parquet(path) if path else None

    def longest_prefix(self, source: str, steps: Sequence) -> tuple[int, DataFrame | None]:
        for n in range(len(steps), 0, -1):
            if (found := self.exact(source, steps[:n])) is not None:
                return n, found
        return 0, None


def write_output(df: DataFrame, path: str, manifest: Manifest) -> None:
    """A result as a package: Parquet below ``data``, a row per file with length and SHA-256 below ``blobs``, the lineage below ``manifest``."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    _blobs(spark, path).write.mode("overwrite").json(f"{path}/blobs")
    spark.createDataFrame([(json.dumps(asdict(manifest), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _blobs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/data")
    return files.select(F.regexp_extract("path", "/data/(.*)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def open_output(spark: SparkSession, path: str) -> tuple[DataFrame, Manifest]:
    """A package of ``write_output``; files that are missing, new or changed are an error."""
    said = spark.read.schema("file string, length long, sha256 string").json(f"{path}/blobs")
    changed = said.exceptAll(_blobs(spark, path)).unionAll(_blobs(spark, path).exceptAll(said)).limit(1).collect()
    if changed:
        raise ValueError(f"the package has changed: {changed[0]['file']}")
    return spark.read.parquet(f"{path}/data"), Manifest(**json.loads(spark.read.text(f"{path}/manifest").first()["value"]))
