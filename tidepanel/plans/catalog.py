"""Named factors with declared inputs: the catalog, its order of evaluation, and running it on a panel."""

from __future__ import annotations

import graphlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recursive as rec
from ..functions import rolling, scalar
from ..functions.factor import PANEL, Axis, Factor, factor, sql, with_factors
from ..operators.cross_section import cs_rank, cs_zscore, null_policy
from ..operators.joins import one_row_per_key
from ..session import durable
from ..sources.manifest import fingerprint

# Factor functions a definition may name.
FUNCTIONS: dict[str, Callable] = {
    name: fn for module in (rolling, scalar) for name, fn in vars(module).items()
    if callable(fn) and not name.startswith("_") and getattr(fn, "__module__", "").startswith("tidepanel.functions")
    and name not in ("factor", "windowed", "staged", "combine", "full", "finite", "safe_corr", "Factor", "Axis", "position")}


@dataclass(frozen=True)
class FactorSpec:
    """One factor.

    ``function`` names a factor function, a recursive one, or is ``"sql"`` with the text in ``inputs["text"]``.
    ``inputs`` maps its parameters to column names, other factors' names, or numbers.
    """

    name: str
    function: str
    inputs: Mapping[str, object] = field(default_factory=dict)
    group: str = "custom"
    source: str = "custom"
    enabled: bool = True
    author: str = ""
    overridden: bool = False

    @property
    def reads(self) -> list[str]:
        if self.function == "sql":
            return list(self.inputs.get("reads", ()))
        return [v for v in self.inputs.values() if isinstance(v, str)]


@dataclass(frozen=True)
class CrossSpec:
    """A factor over a day's cross-section: ``value(z, rank, column)`` combines z-scores, ranks and plain columns."""

    name: str
    value: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    zscores: Sequence[str] = ()
    ranks: Sequence[str] = ()
    columns: Sequence[str] = ()
    group: str = "meta"
    source: str = "custom"
    enabled: bool = True

    @property
    def reads(self) -> list[str]:
        return [*self.zscores, *self.ranks, *self.columns]


def resolve(builtin: Sequence[FactorSpec], overrides: Mapping[str, FactorSpec] | None = None,
            custom: Sequence[FactorSpec] = (), disabled: Sequence[str] = ()) -> list[FactorSpec]:
    """Built-in factors with overrides applied, then custom ones, without the disabled; names must be unique."""
    overrides = dict(overrides or {})
    unknown = set(overrides) - {s.name for s in builtin}
    if unknown:
        raise ValueError(f"overrides of unknown factors: {sorted(unknown)}")
    out = [replace(overrides[s.name], name=s.name, overridden=True) if s.name in overrides else s for s in builtin]
    out += list(custom)
    names = [s.name for s in out]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"factor names occur twice: {twice}")
    return [s for s in out if s.enabled and s.name not in set(disabled)]


def definitions(specs: Sequence[FactorSpec]) -> list[dict]:
    return [asdict(s) | {"inputs": dict(s.inputs)} for s in specs]


def catalog_fingerprint(specs: Sequence[FactorSpec]) -> str:
    return fingerprint(definitions(specs))


def reload(rows: Sequence[Mapping]) -> list[FactorSpec]:
    """Specs back from :func:`definitions`, to score later with exactly the factors of training."""
    return [FactorSpec(**dict(row)) for row in rows]


def as_table(spark: SparkSession, specs: Sequence[FactorSpec]) -> DataFrame:
    """The catalog as rows (one per factor)."""
    rows = [(s.name, s.function, ",".join(f"{k}={v}" for k, v in s.inputs.items()), s.group, s.source, s.enabled)
            for s in specs]
    return spark.createDataFrame(rows, "name string, function string, inputs string, `group` string, source string, enabled boolean")


def resolve_table(builtin: DataFrame, overrides: DataFrame, custom: DataFrame, disabled: DataFrame) -> DataFrame:
    """:func:`resolve` for catalogs kept as tables (columns of :func:`as_table`); a name that occurs twice fails."""
    changed = [c for c in builtin.columns if c != "name"]
    renamed = one_row_per_key(overrides, ["name"]).select("name", *[F.col(c).alias(f"_o_{c}") for c in changed], F.lit(True).alias("_hit"))
    own = builtin.join(renamed, "name", "left").select(
        "name", *[F.when(F.col("_hit"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in changed],
        F.coalesce("_hit", F.lit(False)).alias("overridden"))
    every = one_row_per_key(own.unionByName(custom.withColumn("overridden", F.lit(False))), ["name"])
    return every.where("enabled").join(disabled.select("name").distinct(), "name", "left_anti")


def group_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("group", "source").agg(
        F.count(F.lit(1)).alias("factors"), F.sum(F.col("enabled").cast("int")).alias("enabled"))


def evaluation_order(specs: Sequence[FactorSpec | CrossSpec]) -> list[str]:
    """Factor names, inputs first; a cycle is an error, and so is a time-series factor reading a cross-section."""
    by_name = {s.name: s for s in specs}
    graph = {s.name: [d for d in s.reads if d in by_name and d != s.name] for s in specs}
    for s in specs:
        if isinstance(s, FactorSpec):
            late = [d for d in graph[s.name] if isinstance(by_name[d], CrossSpec)]
            if late:
                raise ValueError(f"{s.name} is a time series over cross-section factors {late}")
    try:
        return list(graphlib.TopologicalSorter(graph).static_order())
    except graphlib.CycleError as e:
        raise ValueError(f"factors depend on each other: {' -> '.join(e.args[1])}") from e


def _build(spec: FactorSpec, known: Mapping[str, Factor], axis: Axis) -> Factor:
    if spec.function == "sql":
        return sql(spec.inputs["text"], axis)
    if spec.function not in FUNCTIONS:
        raise ValueError(f"unknown factor function: {spec.function}")
    args = {k: (known.get(v, factor(v, axis)) if isinstance(v, str) else v) for k, v in spec.inputs.items()}
    windows = args.pop("windows", None)
    return FUNCTIONS[spec.function](**args) if windows is None else FUNCTIONS[spec.function](*args.values(), *windows)


@dataclass
class GraphResult:
    frame: DataFrame
    status: list[tuple[str, str, str]]

    def report(self, spark: SparkSession) -> DataFrame:
        """(factor, status, message), one row per factor."""
        return spark.createDataFrame(self.status, "factor string, status string, message string")


def run_factors(df: DataFrame, specs: Sequence[FactorSpec | CrossSpec], strict: bool = True, fill: float | None = 0.0,
                zero_std: str = "null", axis: Axis = PANEL) -> GraphResult:
    """Evaluates time-series factors, then cross-section factors.

    Between the stages NULLs of every numeric column become ``fill`` (None leaves them).  A factor that cannot be
    built is an error when ``strict``; otherwise it is a NULL column and so are the factors that read it.
    """
    by_name = {s.name: s for s in specs}
    order = [by_name[n] for n in evaluation_order(specs)]
    status, failed = [], set()

    def fail(name, message):
        if strict:
            raise ValueError(f"{name}: {message}")
        failed.add(name)
        status.append((name, "error", message))

    out = df
    pending = [s for s in order if isinstance(s, FactorSpec)]
    while pending:
        known: dict[str, Factor] = {}
        later, done = [], {}
        for s in pending:
            waits = [d for d in s.reads if d in by_name and d not in known and d not in out.columns and d != s.name]
            missing = [d for d in s.reads if d not in by_name and d not in out.columns]
            if [d for d in s.reads if d in failed]:
                fail(s.name, "an input failed")
            elif missing:
                fail(s.name, f"missing columns {missing}")
            elif s.function in rec.FUNCTIONS:
                later.append(s)
            elif waits:
                later.append(s)
            else:
                try:
                    known[s.name] = _build(s, known, axis)
                    done[s.name] = known[s.name]
                    status.append((s.name, "ok", ""))
                except (ValueError, TypeError) as e:
                    fail(s.name, str(e))
        if done:
            out = with_factors(out, done)
        ready = [s for s in later if s.function in rec.FUNCTIONS and all(d in out.columns for d in s.reads)]
        if ready:
            out = rec.with_recursive(out, {s.name: rec.recursive(
                s.function, *s.reads, **{k: v for k, v in s.inputs.items() if not isinstance(v, str)}) for s in ready}, axis)
            status.extend((s.name, "ok", "") for s in ready)
        left = [s for s in later if s not in ready]
        if len(left) == len(pending):
            for s in left:
                fail(s.name, "an input failed")
            left = []
        pending = left

    crossed = [s for s in order if isinstance(s, CrossSpec)]
    if crossed and fill is not None:
        numeric = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "float")]
        out = null_policy(out, numeric, fill)
    if crossed:
        out = durable(out)  # a cross-section reads the panel once for its statistics and once to apply them
    while crossed:
        layer, rest = [], []
        for s in crossed:
            if [d for d in s.reads if d in failed]:
                fail(s.name, "an input failed")
            elif any(d in by_name and d not in out.columns for d in s.reads):
                rest.append(s)
            elif [d for d in s.reads if d not in out.columns]:
                fail(s.name, f"missing columns {[d for d in s.reads if d not in out.columns]}")
            else:
                layer.append(s)
        if not layer:
            break
        before = out.columns
        z = {f"_z_{c}": c for s in layer for c in s.zscores}
        k = {f"_k_{c}": c for s in layer for c in s.ranks}
        if z:
            out = cs_zscore(out, z, zero_std=zero_std)
        if k:
            out = cs_rank(out, k)
        values = []
        for s in layer:
            value = s.value(lambda c: F.col(f"_z_{c}"), lambda c: F.col(f"_k_{c}"))
            if isinstance(value, Factor):
                raise ValueError(f"{s.name}: time-series functions are not allowed over a cross-section")
            values.append(value.alias(s.name))
            status.append((s.name, "ok", ""))
        out = out.select(*before, *values)
        crossed = rest
    nulls = [n for n in failed if n not in out.columns]
    if nulls:
        out = out.select("*", *[F.lit(None).cast("double").alias(n) for n in nulls])
    return GraphResult(out, status)
