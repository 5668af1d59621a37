"""Steps from the command line, each on the tables that the one before it wrote:

    python -m tidewater generate --sessions 8000 --days 14 --end 2024-02-01 DIR
    python -m tidewater silver --lateness-hours 72 DIR
    python -m tidewater ask DIR "conversion rate" --by device --from 2024-01-20

DIR holds bronze_events, silver_events, quarantine_events and quality_manifest.json.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tidewater.operators import corrupt, quality, silver
from tidewater.plans.semantic import Engine, SpecError
from tidewater.sources import tables
from tidewater.sources.generate import generate_events


def generate(spark: SparkSession, args: argparse.Namespace) -> str:
    """Clean events with all faults, as bronze; tells what it came to."""
    clean = generate_events(spark, args.end, n_sessions=args.sessions, days=args.days, seed=args.seed)
    tables.write_bronze(corrupt.corrupt(clean), f"{args.dir}/bronze_events")
    bronze = tables.read_bronze(spark, f"{args.dir}/bronze_events")
    return "\n".join(f"{k}: {v}" for k, v in quality.summary(bronze).first().asDict().items())


def to_silver(spark: SparkSession, args: argparse.Namespace) -> str:
    """Bronze to silver, quarantine and manifest; tells the manifest, the bot scorecard and how days were restated."""
    bronze = tables.read_bronze(spark, f"{args.dir}/bronze_events")
    out, _, manifest = silver.write_pipeline(bronze, f"{args.dir}/silver_events", f"{args.dir}/quarantine_events", args.timeout_minutes, args.lateness_hours)
    tables.write_json(spark, manifest.as_dict(), f"{args.dir}/quality_manifest.json")
    counts = {k: v for k, v in manifest.as_dict().items() if k != "notes"}
    lines = [f"{k}: {v} ({manifest.rate(v):.2%} of rows in)" if k not in ("rows_in", "sessions_derived", "bot_sessions_flagged") else f"{k}: {v}" for k, v in counts.items()]
    score = quality.scorecard_text(quality.bot_scorecard(out).first().asDict())
    days = quality.restatement_text([r.asDict() for r in quality.restatement(out).collect()])
    return "\n".join([*lines, *manifest.notes, score, days])


def ask(spark: SparkSession, args: argparse.Namespace) -> str:
    """One governed answer with its provenance, or what is wrong with the question."""
    engine = Engine.connect(spark, f"{args.dir}/silver_events", f"{args.dir}/quality_manifest.json")
    filters = dict(x.split("=", 1) for x in args.where)
    try:
        answer = engine.ask(args.name, dimensions=tuple(args.by), start_date=args.start, end_date=args.stop, filters=filters, waive_default_filters=tuple(args.waive), limit=args.limit)
    except SpecError as e:
        return f"rejected: {e}"
    rows = [", ".join(f"{k} {v}" for k, v in r.items()) for r in answer.rows] if args.by else []
    return answer.to_json() if args.json else "\n".join([answer.render(), *rows, f"sql: {answer.compiled_sql}"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = p.add_subparsers(required=True)
    day = lambda s: datetime.fromisoformat(s).replace(tzinfo=timezone.utc)
    g = steps.add_parser("generate", help=generate.__doc__)
    g.add_argument("--sessions", type=int, default=8000)
    g.add_argument("--days", type=int, default=14)
    g.add_argument("--seed", type=int, default=11)
    g.add_argument("--end", type=day, default=datetime.now(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0), help="the midnight after the last day; today's where left out")
    g.set_defaults(step=generate)
    s = steps.add_parser("silver", help=to_silver.__doc__)
    s.add_argument("--lateness-hours", type=float, default=silver.LATENESS_HOURS)
    s.add_argument("--timeout-minutes", type=float, default=silver.TIMEOUT_MINUTES)
    s.set_defaults(step=to_silver)
    a = steps.add_parser("ask", help=ask.__doc__)
    for x in (g, s, a):
        x.add_argument("dir")
    a.add_argument("name")
    a.add_argument("--by", action="append", default=[], help="a dimension; may be repeated")
    a.add_argument("--where", action="append", default=[], metavar="DIMENSION=VALUE")
    a.add_argument("--waive", action="append", default=[], help="a default filter to leave out")
    a.add_argument("--from", dest="start")
    a.add_argument("--to", dest="stop")
    a.add_argument("--limit", type=int, default=500)
    a.add_argument("--json", action="store_true")
    a.set_defaults(step=ask)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.step(spark, args)


if __name__ == "__main__":
    print(main())
