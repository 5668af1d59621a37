"""The semantic layer: a validated metric specification becomes one SQL text with bound values, and an answer with its provenance."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.sources import tables

LAYER = Path(__file__).with_name("metrics.yaml")
#: Fixed value: the largest limit of a specification.
MAX_ROWS = 10_000


def load_layer(path: str | Path = LAYER) -> dict:
    """A layer's YAML, completed by `normalised`."""
    return normalised(yaml.safe_load(Path(path).read_text()))


def normalised(layer: dict) -> dict:
    """The layer with every optional key: no dimensions or default filters, and metrics that are their own label, unowned and without caveats."""
    metrics = {}
    for key, m in (layer.get("metrics") or {}).items():
        metrics[key] = {"label": key, "owner": "unowned", "grain": "unknown", "description": "", "caveats": [], "conflicts_with": []} | {k: v for k, v in m.items() if v is not None}
    empty = {k: layer.get(k) or {} for k in ("dimensions", "default_filters")}
    return {"source_table": "silver_events"} | layer | empty | {"metrics": metrics}


@dataclass(frozen=True)
class MetricSpec:
    """What is asked: a metric, its slices, days (both ends included), equality filters, waivers and a row limit."""

    metric: str
    dimensions: tuple[str, ...] | list[str] = ()
    start_date: str | None = None
    end_date: str | None = None
    filters: dict[str, str] = field(default_factory=dict)
    waive_default_filters: tuple[str, ...] | list[str] = ()
    limit: int = 500


class SpecError(ValueError):
    """What is wrong with a specification, with the values that are allowed."""


@dataclass(frozen=True)
class CompiledQuery:
    sql: str
    args: tuple


def _is_day(value: str) -> bool:
    try:
        return date.fromisoformat(value).isoformat() == value
    except (TypeError, ValueError):
        return False


def validate(spec: MetricSpec, layer: dict, max_days: int | None = None) -> None:
    """Raise one SpecError that names every problem."""
    layer = normalised(layer)
    names = {k: sorted(layer[k]) for k in ("metrics", "dimensions", "default_filters")}
    allowed = lambda what: ", ".join(names[what])
    wrong = []
    if spec.metric not in layer["metrics"]:
        wrong.append(f"unknown metric {spec.metric!r}; use one of: {allowed('metrics')}")
    wrong += [f"unknown dimension {d!r}; use: {allowed('dimensions')}" for d in spec.dimensions if d not in layer["dimensions"]]
    wrong += [f"can't filter by {d!r}; use: {allowed('dimensions')}" for d in spec.filters if d not in layer["dimensions"]]
    wrong += [f"no default filter {f!r} to waive; there are: {allowed('default_filters')}" for f in spec.waive_default_filters if f not in layer["default_filters"]]
    if not 1 <= spec.limit <= MAX_ROWS:
        wrong.append(f"limit {spec.limit} isn't between 1 and {MAX_ROWS}")
    days = [d for d in (spec.start_date, spec.end_date) if d is not None]
    wrong += [f"{d!r} isn't a day as YYYY-MM-DD" for d in days if not _is_day(d)]
    if len(days) == 2 and all(map(_is_day, days)):
        if days[0] > days[1]:
            wrong.append(f"start_date {days[0]} is after end_date {days[1]}")
        elif max_days and (date.fromisoformat(days[1]) - date.fromisoformat(days[0])).days >= max_days:
            wrong.append(f"more than {max_days} days")
    if wrong:
        raise SpecError("; ".join(wrong))


def compile_spec(spec: MetricSpec, layer: dict, table: str | None = None, day_column: str | None = None) -> CompiledQuery:
    """One flat SELECT; values are bound, never written into the text. Groups and order are by expression, every dimension, nulls last.

    day_column, the day of event_ts by which a table is laid out, is bounded
    beside event_ts, so that days outside the range aren't read.
    """
    layer = normalised(layer)
    validate(spec, layer)
    slices = [(d, layer["dimensions"][d]["sql"]) for d in spec.dimensions]
    where = [f["sql"] for name, f in layer["default_filters"].items() if name not in spec.waive_default_filters]
    args: list = []
    if spec.start_date:
        where.append("event_ts >= CAST(? AS TIMESTAMP)")
        args.append(spec.start_date)
        if day_column:
            where.append(f"{day_column} >= CAST(? AS DATE)")
            args.append(spec.start_date)
    if spec.end_date:
        where.append("event_ts < CAST(? AS TIMESTAMP) + INTERVAL 1 DAY")
        args.append(spec.end_date)
        if day_column:
            where.append(f"{day_column} <= CAST(? AS DATE)")
            args.append(spec.end_date)
    for name in sorted(spec.filters):
        where.append(f"{layer['dimensions'][name]['sql']} = ?")
        args.append(spec.filters[name])
    value = " ".join(layer["metrics"][spec.metric]["sql"].split())
    columns = [f"{sql} AS {name}" for name, sql in slices] + [f"{value} AS value"]
    parts = ["SELECT " + ", ".join(columns), f"FROM {table or layer['source_table']}"]
    if where:
        parts.append("WHERE " + " AND ".join(where))
    if slices:
        parts += ["GROUP BY " + ", ".join(sql for _, sql in slices), "ORDER BY " + ", ".join(f"{sql} NULLS LAST" for _, sql in slices)]
    return CompiledQuery(" ".join([*parts, f"LIMIT {spec.limit}"]), tuple(args))


def _folded(name: str) -> str:
    return "_".join(name.strip().lower().replace("_", " ").split())


def resolve(name: str, layer: dict) -> dict:
    """{resolved, ambiguous, candidates, message}: the metric that a name means, and the others that it may mean.

    A name is a key, the beginning of one, or a label; case, spaces and
    underscores don't matter. Conflicts with metrics that the layer lacks are
    left out.
    """
    metrics = normalised(layer)["metrics"]
    key = _folded(name)
    if not key:
        raise SpecError(f"a name is needed; there are: {', '.join(sorted(metrics))}")
    if key in metrics:
        found = [key, *(k for k in metrics[key]["conflicts_with"] if k in metrics)]
    else:
        found = [k for k, m in metrics.items() if k.startswith(key) or _folded(m["label"]) == key]
    found = sorted(dict.fromkeys(found))
    if not found:
        raise SpecError(f"no metric is called {name!r}; there are: {', '.join(sorted(metrics))}")
    resolved = key if key in metrics else found[0]
    shown = ("label", "owner", "grain", "description")
    out = {"resolved": resolved, "ambiguous": len(found) > 1, "candidates": [{"key": k} | {x: metrics[k][x] for x in shown} for k in found], "message": None}
    if out["ambiguous"]:
        out["message"] = f"{name!r} may mean " + " or ".join(f"{k} (owner: {metrics[k]['owner']})" for k in found) + f"; answered with {resolved}"
    return out


def lint(layer: dict) -> list[str]:
    """Conflicts that only one side declares, or with a metric that isn't there."""
    m = normalised(layer)["metrics"]
    return [f"{a} names {b} but not the other way" for a in m for b in m[a].get("conflicts_with", []) if a not in m.get(b, {}).get("conflicts_with", [])]


def query_hash(spec: MetricSpec) -> str:
    """16 hex digits that don't depend on the order of dimensions, waivers or filters."""
    value = asdict(spec) | {"dimensions": sorted(spec.dimensions), "waive_default_filters": sorted(spec.waive_default_filters), "filters": dict(sorted(spec.filters.items()))}
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:16]


def definition_hash(spec: MetricSpec, layer: dict) -> str:
    """Changes when the metric or anything it is compiled from does."""
    layer = normalised(layer)
    return hashlib.sha256(json.dumps([layer["metrics"][spec.metric], layer["dimensions"], layer["default_filters"]], sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class MetricAnswer:
    """A value with its definition, owner, caveats, data quality and freshness."""

    metric: str
    label: str
    owner: str
    grain: str
    value: float | None
    rows: list[dict]
    definition_sql: str
    compiled_sql: str
    query_hash: str
    caveats: list[str]
    data_quality: dict
    freshness: str | None
    ambiguity_warning: str | None

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, default=str)

    def render(self) -> str:
        shown = "—" if self.value is None else f"{self.value:,.4f}".rstrip("0").rstrip(".")
        shown = shown if len(self.rows) < 2 else f"{len(self.rows)} rows"
        lines = [f"{self.label}: {shown}", f"owner {self.owner}, grain {self.grain}, query {self.query_hash}, data of {self.freshness or '—'}"]
        lines += [f"! {self.ambiguity_warning}"] * bool(self.ambiguity_warning) + [f"* {c}" for c in self.caveats]
        return "\n".join(lines + [f"= {self.definition_sql}"])


def quality_context(manifest: dict) -> dict:
    """A run's counters as rates of its rows."""
    if not manifest:
        return {}
    n = max(manifest["rows_in"], 1)
    rates = {"duplicate_rate": "duplicates_removed", "quarantine_rate": "quarantined_timestamps", "bot_event_rate": "bot_events_flagged", "schema_drift_rate": "drifted_rows_recovered"}
    return {k: manifest[k] for k in ("rows_in", "rows_out", "events_after_watermark", "notes")} | {k: manifest[v] / n for k, v in rates.items()}


class Engine:
    """Answers over one silver table. Rows come to the driver up to a specification's limit, MAX_ROWS at most."""

    def __init__(self, silver: DataFrame, layer: dict | None = None, manifest: dict | None = None, path: str | None = None):
        self.silver, self.layer, self.manifest, self.path = silver, normalised(layer or load_layer()), manifest or {}, path

    @classmethod
    def connect(cls, spark: SparkSession, silver_path: str, manifest_path: str | None = None, layer: dict | None = None) -> Engine:
        if tables.modified(spark, silver_path) is None:
            raise FileNotFoundError(silver_path)
        silver = spark.read.parquet(silver_path)
        silver.createOrReplaceTempView(normalised(layer or load_layer())["source_table"])
        return cls(silver, layer, tables.read_json(spark, manifest_path) if manifest_path else {}, silver_path)

    def compiled(self, spec: MetricSpec, table: str | None = None) -> CompiledQuery:
        return compile_spec(spec, self.layer, table, tables.DAY_COLUMN if tables.DAY_COLUMN in self.silver.columns else None)

    def frame(self, spec: MetricSpec) -> DataFrame:
        """The compiled query as a DataFrame."""
        q = self.compiled(spec, "{silver}")
        return self.silver.sparkSession.sql(q.sql, args=list(q.args) or None, silver=self.silver)

    def execute(self, spec: MetricSpec, ambiguity: str | None = None) -> MetricAnswer:
        rows = [r.asDict() for r in self.frame(spec).collect()]
        m = self.layer["metrics"][spec.metric]
        fresh = tables.modified(self.silver.sparkSession, self.path) if self.path else None
        return MetricAnswer(
            metric=spec.metric,
            label=m["label"],
            owner=m["owner"],
            grain=m["grain"],
            value=rows[0]["value"] if len(rows) == 1 else None,
            rows=rows,
            definition_sql=" ".join(m["sql"].split()),
            compiled_sql=self.compiled(spec).sql,
            query_hash=query_hash(spec),
            caveats=list(m["caveats"]),
            data_quality=quality_context(self.manifest),
            freshness=fresh,
            ambiguity_warning=ambiguity,
        )

    def ask(self, name: str, **kw) -> MetricAnswer:
        """Resolve a name, check, compile and run."""
        found = resolve(name, self.layer)
        return self.execute(MetricSpec(found["resolved"], **kw), found["message"])

    def list_metrics(self) -> list[dict]:
        return [{"key": k, "label": m["label"], "owner": m["owner"]} for k, m in self.layer["metrics"].items()]

    def describe_metric(self, name: str) -> dict:
        return {"key": (k := resolve(name, self.layer)["resolved"])} | self.layer["metrics"][k]

    def run_metric(self, spec: MetricSpec) -> MetricAnswer:
        return self.execute(spec)

    def _where(self, waived: tuple[str, ...] = ()) -> str:
        return " AND ".join([f["sql"] for name, f in self.layer["default_filters"].items() if name not in waived] or ["true"])

    def two_conversions(self) -> DataFrame:
        """Both conversion rates by day, without the first and the last day. One query over the silver table."""
        day, metrics = self.layer["dimensions"]["event_date"]["sql"], self.layer["metrics"]
        rates = ", ".join(f"{metrics[f'conversion_rate_{x}']['sql']} AS by_{x}" for x in ("sessions", "visitors"))
        sql = f"SELECT {day} AS event_date, {rates} FROM {{silver}} WHERE {self._where()} AND event_ts IS NOT NULL GROUP BY {day}"
        days = self.silver.sparkSession.sql(sql, silver=self.silver)
        every = Window.partitionBy(F.lit(1))  # a row for each day
        return days.withColumns({"lo": F.min("event_date").over(every), "hi": F.max("event_date").over(every)}).filter("event_date > lo and event_date < hi").drop("lo", "hi")

    def conversion_gap(self) -> float | None:
        """How much higher the rate by visitor is than by session, over everything."""
        s, v = (self.execute(MetricSpec(f"conversion_rate_{x}")).value for x in ("sessions", "visitors"))
        return v / s - 1 if s else None

    def filter_waterfall(self, metric: str = "pageviews") -> DataFrame:
        """An additive metric with no default filter, then with one more of them at each step. One query over the silver table."""
        filters, sql = list(self.layer["default_filters"]), self.layer["metrics"][metric]["sql"]
        flags = ", ".join(f"coalesce({self.layer['default_filters'][f]['sql']}, false) AS f{i}" for i, f in enumerate(filters))
        kept = ", ".join(f"f{i}" for i in range(len(filters)))
        cells = self.silver.sparkSession.sql(f"SELECT {kept}, {sql} AS value FROM (SELECT *, {flags} FROM {{silver}}) GROUP BY {kept}", silver=self.silver)
        names = ["raw", *(f"without_{f.removeprefix('exclude_')}" for f in filters[:-1]), "default"]
        passes = [F.lit(True)]
        for i in range(len(filters)):
            passes.append(passes[-1] & F.col(f"f{i}"))
        sums = cells.agg(*(F.coalesce(F.sum(F.when(p, F.col("value"))), F.lit(0)).alias(f"v{i}") for i, p in enumerate(passes)))
        steps = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"v{i}").alias("value")) for i, n in enumerate(names)]
        return sums.select(F.explode(F.array(*steps)).alias("x")).select("x.*")
