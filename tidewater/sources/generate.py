"""The synthetic event source: every value is a function of seed and ids, so any partitioning gives the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.uniform import between, pick, seconds, uniform
from tidewater.sources import world as w

#: Sessions numbered together when new visitors are counted; block sums are one small window.
BLOCK = 100_000


def _lookup(values: dict, key: Column) -> Column:
    """The number or name that a literal table has for a key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _of(table: dict, field: str, key: str) -> Column:
    return _lookup({k: getattr(v, field) for k, v in table.items()}, F.col(key))


def _ends(field: str) -> list[Column]:
    """Both ends of a persona's range."""
    return [_lookup({k: getattr(v, field)[i] for k, v in w.PERSONAS.items()}, F.col("_persona")) for i in (0, 1)]


def _shares(table: dict) -> dict[str, float]:
    return {k: v[0] for k, v in table.items()}  # share or weight stands first


def _one_of(values, u: Column) -> Column:
    values = tuple(values)
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def day_plan(n_sessions: int, days: int, end: datetime) -> list[tuple[datetime, int]]:
    """(day, sessions) by weekday weight; end is the last day's midnight plus one."""
    dates = [end - timedelta(days=days - k) for k in range(days)]
    weights = [w.WEEKDAYS[d.weekday()] for d in dates]
    return [(d, round(n_sessions * x / sum(weights))) for d, x in zip(dates, weights)]


def _visitors(rows: DataFrame, which: Column) -> DataFrame:
    """rows (id, new) with their visitor: a new one's number, or any of those before. Numbers are counted in blocks of ids."""
    rows = rows.withColumn("block", F.floor(F.col("id") / BLOCK))
    is_new = F.col("new").cast("long")
    blocks = rows.groupBy("block").agg(F.sum(is_new).alias("n"))
    before = F.sum("n").over(Window.orderBy("block")) - F.col("n")
    # a row for every BLOCK sessions, joined by shuffle or broadcast as its size allows
    rows = rows.join(blocks.withColumn("before", before).drop("n"), "block")
    seen = F.col("before") + F.sum(is_new).over(Window.partitionBy("block").orderBy("id"))
    rows = rows.withColumn("seen", seen)
    return rows.withColumn("visitor", F.when(F.col("new"), F.col("seen") - 1).otherwise(F.floor(which * F.col("seen"))))


def sessions(spark: SparkSession, n_sessions: int, days: int, end: datetime, seed: int) -> DataFrame:
    """One row per session with its visitor, persona and start."""
    end = end.astimezone(timezone.utc) if end.tzinfo else end.replace(tzinfo=timezone.utc)
    sid, v = F.col("id"), F.col("visitor")
    u = lambda salt, *k: uniform(seed, salt, *(k or (sid,)))
    at, day = 0, F.lit(None).cast("long")
    bounds = []
    for d, n in day_plan(n_sessions, days, end):
        bounds.append((at, at + n, int(d.timestamp())))
        at += n
    for lo, hi, epoch in reversed(bounds):
        day = F.when((sid >= lo) & (sid < hi), F.lit(epoch)).otherwise(day)
    hour = pick(u("hour"), {str(h): x for h, x in enumerate(w.HOURS)}).cast("int")
    rows = spark.range(at).withColumn("start", F.timestamp_seconds(day + hour * 3600) + seconds(u("second") * 3600))
    rows = _visitors(rows.withColumn("new", (u("returning") >= w.RETURNING) | (sid == 0)), u("which"))
    out = rows.withColumns({
        "membership_tier": pick(u("tier", v), _shares(w.TIERS)),
        "device": pick(u("device", v), _shares(w.DEVICES)),
        "_persona": pick(u("persona"), _shares(w.PERSONAS)),
    })

    def number(salt: str, digits: int, *k: Column) -> Column:
        return F.lpad(F.floor(u(salt, *k) * 10**digits).cast("string"), digits, "0")

    def ident(kind: str, k: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(f"{seed}:{kind}"), k.cast("string")))

    is_member = (F.col("membership_tier") != "guest") & (u("member", v) < w.MEMBER)
    return out.withColumns({
        "member_id": F.when(is_member, F.concat(F.lit("M"), number("member-id", 8, v))),
        "session_id": ident("session", sid),
        "visitor_id": ident("visitor", v),
        "order_id": F.concat(F.lit("MO-"), number("order", 10)),
    })


def _pages(s: DataFrame, u) -> DataFrame:
    """A landing page and the middle steps of every session."""
    step = F.col("step")
    page = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    r = u("middle", step)
    middle = F.when(r < 0.22, "search").when(r < 0.42, "category").otherwise("product")
    page = page.withColumn("page_type", F.when(step == 1, pick(u("landing"), w.LANDING)).otherwise(middle))
    is_a = lambda kind: F.col("page_type") == kind
    page = page.withColumns({
        "product_id": F.when(is_a("product"), _one_of(w.SKUS, u("sku", step))),
        "search_term": F.when(is_a("search"), _one_of(w.SEARCHES, u("term", step))),
        "event_name": F.when(is_a("search"), "search").otherwise("page_view"),
    })
    return page.withColumn("category", F.coalesce(_of(w.SKUS, "category", "product_id"), F.when(is_a("category"), _one_of(w.CATEGORIES, u("category", step)))))


def _funnel(s: DataFrame, page: DataFrame, seed: int, u) -> DataFrame:
    """Cart, checkout and purchase of the sessions that viewed a product in a middle step and mean to buy."""
    sid, none = F.col("id"), F.lit(None).cast("string")
    views = page.filter("page_type = 'product' and step > 1").groupBy("id").agg(F.collect_set("product_id").alias("viewed"))
    factors = _of(w.TIERS, "conversion", "membership_tier") * _of(w.DEVICES, "conversion", "device")
    f = s.join(views, "id").filter(u("intent") < F.least(F.lit(0.97), _of(w.PERSONAS, "intent", "_persona") * factors))
    size = F.least(F.size("viewed"), (F.floor(u("cart") * 3) + 1).cast("int"))
    drawn = F.array_sort(F.transform("viewed", lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), sid.cast("string"), x)).alias("h"), x.alias("sku"))))
    f = f.withColumn("cart", F.transform(F.slice(drawn, 1, size), lambda x: x["sku"]))
    # in whole cents and tenths of the factor, halves up
    prices = {k: round(v.price * 100) for k, v in w.SKUS.items()}
    cents = F.aggregate("cart", F.lit(0).cast("long"), lambda a, x: a + _lookup(prices, x))
    tenths = _lookup({k: round(v.order_value * 10) for k, v in w.TIERS.items()}, F.col("membership_tier"))
    total = F.floor((cents * tenths + 5) / 10) / 100

    def item(name: str, page: str, sku: Column, buys: bool) -> Column:
        return F.struct(F.lit(name).alias("event_name"), F.lit(page).alias("page_type"), sku.alias("product_id"), F.lit(buys).alias("buys"))

    carts = F.transform("cart", lambda x: item("add_to_cart", "cart", x, False))
    checkout = F.array(item("begin_checkout", "checkout", none, False))
    bought = F.array(item("purchase", "confirmation", none, True))
    closes = u("close") < _of(w.PERSONAS, "close", "_persona")
    items = F.concat(carts, checkout, F.filter(bought, lambda _: closes))
    f = f.withColumn("total", total).select("*", F.posexplode(items).alias("k", "x"))
    return f.withColumns({
        "step": F.col("depth") + F.col("k") + 1,
        "event_name": F.col("x.event_name"),
        "page_type": F.col("x.page_type"),
        "product_id": F.col("x.product_id"),
        "category": _of(w.SKUS, "category", "x.product_id"),
        "search_term": none,
        "order_total": F.when(F.col("x.buys"), F.col("total")),
        "order_id": F.when(F.col("x.buys"), F.col("order_id")),
    })


def generate_events(spark: SparkSession, end: datetime, n_sessions: int = 5000, days: int = 7, seed: int = 11) -> DataFrame:
    """Clean events: a landing page, middle steps, and for some sessions a cart, a checkout and a purchase."""
    sid, step = F.col("id"), F.col("step")
    u = lambda salt, *k: uniform(seed, salt, sid, *k)
    low, high = _ends("pages")
    s = sessions(spark, n_sessions, days, end, seed)
    s = s.withColumn("depth", F.floor(between(u("depth"), low.cast("double"), high.cast("double") + 1)).cast("int"))
    page = _pages(s, u)
    shared = (
        "id", "step", "start", "session_id", "visitor_id", "member_id", "event_name", "page_type", "product_id",
        "category", "search_term", "device", "membership_tier", "_persona",
    )
    unordered = [F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("double").alias("order_total")]
    rows = page.select(*shared, *unordered).unionByName(_funnel(s, page, seed, u).select(*shared, "order_id", "order_total"))
    wait = F.when(step > 1, between(u("dwell", step), *_ends("seconds"))).otherwise(0.0)
    rows = rows.withColumn("at", F.sum(wait).over(Window.partitionBy("id").orderBy("step")))
    return rows.select(
        F.md5(F.concat_ws(":", F.lit(f"{seed}:event"), sid.cast("string"), step.cast("string"))).alias("event_id"),
        "session_id",
        "visitor_id",
        "member_id",
        (F.col("start") + seconds(F.col("at"))).alias("event_ts"),
        "event_name",
        "page_type",
        "product_id",
        "category",
        "search_term",
        "device",
        "membership_tier",
        F.lit(w.SCHEMA_VERSION).alias("app_version"),
        "order_id",
        "order_total",
        F.lit(w.SCHEMA_VERSION).alias("schema_version"),
        "_persona",
        (F.col("_persona") == "bot").alias("_is_bot"),
    )
