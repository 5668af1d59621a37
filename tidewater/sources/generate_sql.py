"""The event source of `generate` in another engine's SQL, to check it row by row."""

from __future__ import annotations

from datetime import datetime

from tidewater.sources import world as w
from tidewater.sources.generate import day_plan


def _case(key: str, table: dict, at) -> str:
    """A CASE that looks a number or a name up."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {at(v)}" for k, v in table.items()) + " END"


def _pick(u: str, shares: dict) -> str:
    total, at, out = sum(shares.values()), 0.0, []
    for key, share in list(shares.items())[:-1]:
        at += share / total
        out.append(f"WHEN {u} < CAST('{at!r}' AS DOUBLE) THEN '{key}'")
    return f"CASE {' '.join(out)} ELSE '{list(shares)[-1]}' END"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def events_sql(end: datetime, n_sessions: int = 5000, days: int = 7, seed: int = 11) -> str:
    """WITH parts that end in a table `generated` with the columns of `generate_events`, times in microseconds."""

    def u(salt: str, *keys: str) -> str:
        key = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys or ("id",))
        return f"(CAST('0x' || substr(md5('{seed}:{salt}:' || {key}), 1, 8) AS BIGINT) / 4294967296e0)"

    def one_of(values, salt: str) -> str:
        return f"{_list(values)}[CAST(floor({u(salt, 'id', 'step')} * {len(tuple(values))}) AS BIGINT) + 1]"

    number = lambda salt, digits, key: f"lpad(CAST(CAST(floor({u(salt, key)} * 1e{digits}) AS BIGINT) AS VARCHAR), {digits}, '0')"
    at, bounds = 0, []
    for day, n in day_plan(n_sessions, days, end):
        bounds.append(f"WHEN id < {at + n} THEN {int(day.timestamp())}")
        at += n
    persona = lambda pick: _case("_persona", w.PERSONAS, pick)
    category = lambda sku: _case(sku, w.SKUS, lambda v: f"'{v[0]}'")
    hours = {str(h): x for h, x in enumerate(w.HOURS)}
    return f"""g0 AS (SELECT id, CASE {' '.join(bounds)} END + 3600 * CAST({_pick(u('hour'), hours)} AS BIGINT) AS hour_s, {u('returning')} >= {w.RETURNING} OR id = 0 AS is_new FROM (SELECT unnest(range(0, {at})) AS id)),
g1 AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (ORDER BY id) AS seen FROM g0),
g2 AS (SELECT *, CAST(CASE WHEN is_new THEN seen - 1 ELSE floor({u('which')} * seen) END AS BIGINT) AS v, hour_s * 1000000 + CAST(round({u('second')} * 3600 * 1000000) AS BIGINT) AS start_us FROM g1),
g3 AS (SELECT *, {_pick(u('tier', 'v'), {k: x[0] for k, x in w.TIERS.items()})} AS membership_tier, {_pick(u('device', 'v'), {k: x[0] for k, x in w.DEVICES.items()})} AS device, {_pick(u('persona'), {k: x[0] for k, x in w.PERSONAS.items()})} AS _persona FROM g2),
g4 AS (SELECT *, CASE WHEN membership_tier <> 'guest' AND {u('member', 'v')} < {w.MEMBER} THEN 'M' || {number('member-id', 8, 'v')} END AS member_id, md5('{seed}:session:' || id) AS session_id, md5('{seed}:visitor:' || v) AS visitor_id,
  CAST(floor({persona(lambda x: x[1][0])} + {u('depth')} * ({persona(lambda x: x[1][1] + 1)} - {persona(lambda x: x[1][0])})) AS BIGINT) AS depth FROM g3),
g5 AS (SELECT *, unnest(range(1, depth + 1)) AS step FROM g4),
g6 AS (SELECT *, CASE WHEN step = 1 THEN {_pick(u('landing'), w.LANDING)} WHEN {u('middle', 'id', 'step')} < 0.22 THEN 'search' WHEN {u('middle', 'id', 'step')} < 0.42 THEN 'category' ELSE 'product' END AS page_type FROM g5),
g7 AS (SELECT *, CASE WHEN page_type = 'product' THEN {one_of(w.SKUS, 'sku')} END AS product_id, CASE WHEN page_type = 'search' THEN {one_of(w.SEARCHES, 'term')} END AS search_term, CASE WHEN page_type = 'search' THEN 'search' ELSE 'page_view' END AS event_name FROM g6),
pages AS (SELECT *, coalesce({category('product_id')}, CASE WHEN page_type = 'category' THEN {one_of(w.CATEGORIES, 'category')} END) AS category, NULL::VARCHAR AS order_id, NULL::DOUBLE AS order_total FROM g7),
views AS (SELECT DISTINCT id, product_id AS sku FROM pages WHERE page_type = 'product' AND step > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('{seed}:' || id || ':' || sku), sku) AS k, count(*) OVER (PARTITION BY id) AS n FROM views),
bought AS (SELECT g4.*, sku, k, {_case('sku', w.SKUS, lambda v: round(v[1] * 100))} AS cents FROM g4 JOIN ranked USING (id)
  WHERE k <= least(n, floor({u('cart')} * 3) + 1) AND {u('intent')} < least(0.97e0, CAST({persona(lambda x: x[3])} AS DOUBLE) * CAST({_case('membership_tier', w.TIERS, lambda v: v[1])} AS DOUBLE) * CAST({_case('device', w.DEVICES, lambda v: v[1])} AS DOUBLE))),
carts AS (SELECT id, max(k) AS size, floor((sum(cents) * max({_case('membership_tier', w.TIERS, lambda v: round(v[2] * 10))}) + 5) / 10e0) / 100e0 AS total FROM bought GROUP BY id),
funnel AS (SELECT id, k AS nth, 'add_to_cart' AS event_name, 'cart' AS page_type, sku AS product_id, false AS buys FROM bought
  UNION ALL SELECT id, size + 1, 'begin_checkout', 'checkout', NULL, false FROM carts
  UNION ALL SELECT id, size + 2, 'purchase', 'confirmation', NULL, true FROM carts JOIN g4 USING (id) WHERE {u('close')} < {persona(lambda x: x[4])}),
steps AS (SELECT id, step, start_us, session_id, visitor_id, member_id, event_name, page_type, product_id, category, search_term, device, membership_tier, _persona, order_id, order_total FROM pages
  UNION ALL SELECT id, depth + nth, start_us, session_id, visitor_id, member_id, event_name, page_type, product_id, {category('product_id')}, NULL, device, membership_tier, _persona,
    CASE WHEN buys THEN 'MO-' || {number('order', 10, 'id')} END, CASE WHEN buys THEN CAST(total AS DOUBLE) END FROM funnel JOIN g4 USING (id) JOIN carts USING (id)),
waits AS (SELECT *, CASE WHEN step > 1 THEN {persona(lambda x: f'{x[2][0]!r}e0')} + {u('dwell', 'id', 'step')} * ({persona(lambda x: f'{x[2][1]!r}e0')} - {persona(lambda x: f'{x[2][0]!r}e0')}) ELSE 0e0 END AS wait FROM steps),
generated AS (SELECT md5('{seed}:event:' || id || ':' || step) AS event_id, session_id, visitor_id, member_id, start_us + CAST(round(sum(wait) OVER (PARTITION BY id ORDER BY step) * 1000000) AS BIGINT) AS event_us, event_name, page_type,
  product_id, category, search_term, device, membership_tier, order_id, order_total, _persona AS persona FROM waits)
"""
