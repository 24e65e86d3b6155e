"""Independent SQL oracles (DuckDB dialect) for the registered plans.

Each oracle starts from the raw test tables (views ``events``, ``part``,
``orders``, ``lineitem``), derives the advertising inputs with plain SQL and
differs from the Spark plan: one global window for the journey, ordered lists
for the device sequences, ``arg_max`` over emissions for order values, full
outer joins instead of zero-filled unions.

Amounts are summed exactly from their shortest decimal text, without a scale
that could round a row.
"""

from __future__ import annotations

import datetime as dt

from adlens.params import P

# The user-agent profile of an event by event_id % 9.
DEVICE_FIELDS = ("ua_device_family", "ua_os_family", "ua_browser_family", "useragent", "display_env")
DEVICE_PROFILES = (
    ("iPad", "iOS", "Mobile Safari", "Mozilla/5.0 (iPad; CPU OS 10_0) Mobile/14A", "web"),
    ("iPhone", "iOS", "Mobile Safari", "Mozilla/5.0 (iPhone; CPU iPhone OS 10_0) Mobile/14A", "web"),
    ("Samsung SM-G930F", "Android", "Chrome Mobile", "Mozilla/5.0 (Linux; Android 7.0) Chrome Mobile Safari", "web"),
    ("Samsung SM-T810", "Android", "Chrome", "Mozilla/5.0 (Linux; Android 7.0; SM-T810) Safari", "web"),
    ("Generic Smartphone", "Other", "other", "app-sdk/2.1", "app_android"),
    ("Generic Smartphone", "Other", "other", "app-sdk/2.1", "app_ios"),
    ("Other", "Mac OS X", "Safari", "Mozilla/5.0 (Macintosh) Safari/602", "web"),
    (None, "Windows", "Firefox", "Mozilla/5.0 (Windows NT 10.0) Firefox/50", "web"),
    ("Nokia Lumia", "Windows Phone", "Other", "Mozilla/5.0 (Windows Phone 10.0)", "app_android"),
)


def _d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def _in(xs) -> str:
    return "(" + ", ".join(repr(x) for x in xs) + ")"


def _parts(partners) -> str:
    return _in(sorted({p % P.modulus for p in partners}))


def _money(amount: str) -> str:
    """Exact sum of a DOUBLE amount, as DOUBLE (both ways through the decimal text)."""
    return f"CAST(CAST(SUM(CAST(CAST({amount} AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE)"


def _device_field_sql(idx: int) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {('NULL' if prof[idx] is None else repr(prof[idx]))}"
        for i, prof in enumerate(DEVICE_PROFILES))
    return f"CAST(CASE event_id % {len(DEVICE_PROFILES)} {whens} END AS VARCHAR)"


def _pop(user: str = "user_id") -> str:
    return (f"CASE WHEN CAST(('0x' || substr(md5(CAST({user} AS VARCHAR) || ':{P.test_id}'), 1, 8)) "
            f"AS BIGINT) % 2 = 0 THEN 'exposed' ELSE 'control' END")


def _bucket(col: str, edges) -> str:
    """Label of the first edge that is not exceeded: MaxE, or OverE beyond the last."""
    edge_list = "[" + ", ".join(f"{float(e)!r}::DOUBLE" for e in edges) + "]"
    labels = "[" + ", ".join(f"'Max{e:g}'" for e in edges) + "]"
    return (f"coalesce({labels}[list_position([{col} <= e FOR e IN {edge_list}], true)], 'Over{edges[-1]:g}')")


def _hour(col: str) -> str:
    """The first k of 1..24 with col <= k / 24."""
    return f"CAST(list_position([{col} <= k::DOUBLE / 24.0::DOUBLE FOR k IN range(1, 25)], true) AS INTEGER)"


def _day_of(epoch: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor({epoch} / 86400) AS INTEGER))"


# The device rules, in their order of precedence.
DEVICE_CASE = """CASE
        WHEN ua_device_family = 'iPad' THEN 'iPad'
        WHEN ua_device_family = 'iPhone' THEN 'iPhone'
        WHEN ua_os_family = 'Android' AND lower(useragent) LIKE '%mobile%' THEN 'Android - Smartphone'
        WHEN ua_os_family = 'Android' THEN 'Android - Tablet'
        WHEN ua_browser_family = 'other' AND display_env = 'app_android' THEN 'App - Android'
        WHEN ua_browser_family = 'other' AND display_env = 'app_ios' THEN 'App - Apple'
        WHEN lower(ua_browser_family) = 'safari' OR ua_device_family = 'Other'
             OR ua_device_family IS NULL OR ua_device_family = 'Unknown' THEN 'Desktop'
        ELSE 'Mobile - Other' END"""

ADAPTERS = f"""
fx_raw AS (
    SELECT event_id, ts, user_id, event_type, value,
           CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
           epoch_us(ts) AS ts_us
    FROM events
),
fx_base AS (
    SELECT event_id, user_id, event_type, value, ts_us,
           CAST(k % 5 + 1 AS INTEGER) AS partner_id,
           CAST((k % 5 + 1) % {P.modulus} AS INTEGER) AS partner_partition,
           CAST(ts AS DATE) AS day,
           ts_us // 1000000 AS unixtime,
           CAST(ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS DOUBLE)
               / CAST(86400000000 AS DOUBLE) AS days_last_visit,
           CAST(event_id % 2 AS INTEGER) AS is_fbx,
           CASE WHEN event_id % 10 = 0 THEN 'US' ELSE 'EU' END AS host_platform,
           event_id // 3 AS impression_id,
           CASE WHEN event_id % 13 <> 0 THEN event_id % 200 END AS item_id,
           user_id % 10 <> 9 AS persistent_user,
           CASE WHEN event_type = 'purchase' THEN 'Sales' ELSE event_type END AS event_name,
           CASE WHEN event_type = 'purchase'
                THEN CAST(user_id AS VARCHAR) || '-' || CAST(dayofmonth(ts) // 10 AS VARCHAR) END AS transaction_id,
           CASE WHEN event_id % 11 <> 0 THEN list_transform(range(1, event_id % 4 + 1),
                lambda i: {{'price': value * i, 'quantity': CAST(1 + i AS INTEGER)}}) END AS products,
           CASE WHEN event_id % 11 <> 0 THEN list_transform(range(1, event_id % 4 + 1),
                lambda i: {{'itemid': (event_id * 7 + i) % 200}}) END AS displayed_products,
           value AS revenue_local,
           value * 0.5 AS revenue_euro,
           {", ".join(f"{_device_field_sql(i)} AS {name}" for i, name in enumerate(DEVICE_FIELDS))},
           last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY ts_us, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click_id
    FROM fx_raw
),
displays AS (
    SELECT partner_id, partner_partition, day, user_id, impression_id,
           CAST(event_id % 4 AS INTEGER) AS campaign_id, CAST(partner_id + 100 AS INTEGER) AS client_id,
           partner_id AS merchant_id, host_platform, days_last_visit, is_fbx,
           value AS sum_display_revenue_local, value * 0.5 AS marketplace_revenue_raw_euro,
           unixtime AS "timestamp", item_id, displayed_products
    FROM fx_base WHERE event_type IN ('view', 'signup', 'error')
),
clicks AS (
    SELECT partner_id, partner_partition, partner_id AS merchant_id, host_platform, day, user_id,
           unixtime AS "timestamp", impression_id, item_id, revenue_local, revenue_euro, days_last_visit
    FROM fx_base WHERE event_type = 'click'
),
matched_transactions AS (
    SELECT p.partner_id, p.partner_partition, p.day, p.user_id, p.transaction_id,
           c.unixtime AS click_timestamp, c.item_id AS click_internal_item_id,
           c.item_id AS clicked_item_id, c.impression_id AS impression_id,
           p.value AS order_value,
           CASE WHEN c.event_id IS NOT NULL AND p.unixtime - c.unixtime <= 259200 THEN 'pc' ELSE 'pv' END
               AS attribution_type,
           CASE WHEN p.event_id % 5 <> 0 THEN 1 ELSE 0 END AS deduplication_matching
    FROM fx_base p LEFT JOIN fx_base c ON c.event_id = p.last_click_id
    WHERE p.event_type = 'purchase'
),
site_events AS (
    SELECT partner_id, partner_partition, day, user_id, unixtime, event_name, persistent_user,
           transaction_id, products
    FROM fx_base
),
site_events_rich AS (
    SELECT partner_id AS partnerid, user_id AS uid, day, unixtime AS "timestamp", event_name AS eventtype,
           {", ".join(DEVICE_FIELDS)}
    FROM fx_base
),
reco_displays AS (
    SELECT partner_id AS partnerid, day, host_platform, displayed_products FROM displays
),
id_users AS (
    SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL AND user_id <> 0
),
identity AS (
    SELECT a.u AS uid, a.u % 2 AS users,
           list({{'uid': b.u, 'providers': CASE b.u % 3
                WHEN 0 THEN [{{'providertype': 'DATA_PROVIDER', 'providerids': CAST(NULL AS INTEGER[])}}]
                WHEN 1 THEN [{{'providertype': 'PARTNER_ID', 'providerids': [CAST(b.u % 5 + 1 AS INTEGER)]}},
                             {{'providertype': 'APP_CK', 'providerids': CAST([] AS INTEGER[])}}]
                ELSE [{{'providertype': 'PARTNER_ID', 'providerids': CAST([1, 2] AS INTEGER[])}},
                      {{'providertype': 'CRM', 'providerids': CAST(NULL AS INTEGER[])}}] END}}) AS events,
           'EU' AS host_platform, {_d(dt.date(2024, 1, 30))} AS day
    FROM id_users a JOIN id_users b ON a.u // 4 = b.u // 4 AND b.u <= a.u
    GROUP BY a.u
),
catalog AS (
    SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS partnerid,
           CAST((p_partkey % 5 + 1) % {P.modulus} AS INTEGER) AS partner_partition,
           p_partkey AS sqlid, 'ext-' || CAST(p_partkey AS VARCHAR) AS id,
           'http://x/' || lower(p_type) || '/' || replace(p_name, ' ', '/') AS producturl
    FROM part
),
dim_catalog AS (
    SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS merchant_id, p_partkey AS internal_item_id,
           p_size AS value_coefficient
    FROM part
),
catalog_stats AS (
    SELECT s.partner_id, s.day, s.internal_item_id, p.p_name AS product_name, s.displays, s.clicks
    FROM (SELECT partner_id, day, item_id AS internal_item_id,
                 CAST(SUM(CASE WHEN event_type IN ('view', 'signup', 'error') THEN 1 ELSE 0 END) AS BIGINT) AS displays,
                 CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks
          FROM fx_base
          WHERE item_id IS NOT NULL AND event_type IN ('view', 'signup', 'error', 'click')
          GROUP BY partner_id, day, item_id) s
    LEFT JOIN part p ON p.p_partkey = s.internal_item_id
),
dim_merchant AS (
    SELECT CAST(i AS INTEGER) AS merchant_id, CAST(100 + i AS INTEGER) AS most_displayed_client_id
    FROM range(1, 6) t(i)
),
dim_client AS (
    SELECT CAST(100 + i AS INTEGER) AS client_id,
           CASE WHEN i <= 3 THEN 'DK' ELSE 'SE' END AS client_country_code,
           CASE WHEN i <= 3 THEN 'Denmark' ELSE 'Sweden' END AS client_country_name,
           CASE WHEN i = 5 THEN 'OTHER' ELSE 'COMMERCE' END AS vertical_level_1_name,
           CASE WHEN i % 2 = 1 THEN 'RETAIL' ELSE 'TRAVEL' END AS vertical_level_2_name,
           'tier ' || (i % 3 + 1) AS ranking
    FROM range(1, 6) t(i)
),
partner_status AS (
    SELECT CAST(i AS INTEGER) AS partner_id, {_d(dt.date(2024, 1, 30))} AS day, 7 AS period,
           CASE WHEN i <= 4 THEN 1 ELSE 0 END AS status
    FROM range(1, 6) t(i)
),
test_users AS (
    SELECT user_id, MIN(day) AS first_day_seen FROM fx_base
    WHERE event_type = 'purchase' AND day >= {_d(dt.date(2024, 1, 11))}
    GROUP BY user_id
),
order_products AS (
    SELECT l_orderkey, list({{'price': l_extendedprice, 'quantity': CAST(l_quantity AS INTEGER)}}) AS products
    FROM lineitem GROUP BY l_orderkey
),
order_site_events AS (
    SELECT CAST(o_custkey % 5 + 1 AS INTEGER) AS partner_id,
           CAST((o_custkey % 5 + 1) % {P.modulus} AS INTEGER) AS partner_partition,
           CAST(o_orderdate AS DATE) AS day, o_custkey AS user_id,
           epoch_us(o_orderdate) // 1000000 AS unixtime, 'Sales' AS event_name, TRUE AS persistent_user,
           CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y-%m') AS transaction_id,
           op.products
    FROM orders o LEFT JOIN order_products op ON o.o_orderkey = op.l_orderkey
)"""


def _with(*ctes: str, body: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {ADAPTERS}{extra}\n{body}"


# ---------------------------------------------------------------------------
# scopes and shared relations
# ---------------------------------------------------------------------------
def _days(start: dt.date, end: dt.date, col: str = "day") -> str:
    return f"{col} BETWEEN {_d(start)} AND {_d(end)}"


def _known_user() -> str:
    return f"user_id <> {P.sentinel}"


def _scope(partners, start: dt.date, end: dt.date) -> str:
    return (f"partner_id IN {_in(partners)} AND partner_partition IN {_parts(partners)} "
            f"AND {_days(start, end)}")


def _recency_cells(non_fbx: bool = False) -> str:
    return f"""
    SELECT day, user_id, CAST(trunc(days_last_visit) AS INTEGER) AS days_last_visit,
           COUNT(*) AS total_displays, COUNT(*) FILTER (is_fbx = 1) AS fbx_displays
    FROM displays
    WHERE merchant_id IN {_in(P.freq_merchants)} AND {_days(P.freq_start, P.freq_end)} AND {_known_user()}
      AND host_platform = 'EU' AND days_last_visit IS NOT NULL {"AND is_fbx = 0" if non_fbx else ""}
    GROUP BY ALL"""


def _hour_cells() -> str:
    return f"""
    SELECT merchant_id, day, user_id, {_hour("days_last_visit")} AS hour_since_last_visit,
           COUNT(*) AS total_displays, COUNT(*) FILTER (is_fbx = 1) AS fbx_displays
    FROM displays
    WHERE merchant_id IN {_in(P.hour_merchants)} AND {_days(P.hour_start, P.hour_end)} AND {_known_user()}
      AND host_platform = 'EU' AND days_last_visit > 0 AND days_last_visit <= 1
    GROUP BY ALL"""


def _click_recency(partners) -> str:
    return _with(body=f"""
SELECT days_last_visit, COUNT(*) AS nb_clicks,
       CAST(SUM(len(list_distinct([s.transaction_id FOR s IN sales IF s.at = "timestamp"]))) AS BIGINT) AS nb_sales
FROM (
    SELECT DISTINCT "timestamp", user_id, CAST(trunc(days_last_visit) AS INTEGER) AS days_last_visit
    FROM clicks
    WHERE merchant_id IN {_in(partners)} AND host_platform = 'EU' AND {_days(P.click_start, P.click_end)}
      AND {_known_user()}) one
LEFT JOIN (
    SELECT user_id AS buyer, list({{'at': click_timestamp, 'transaction_id': transaction_id}}) AS sales
    FROM matched_transactions
    WHERE partner_id IN {_in(partners)} AND attribution_type = 'pc' AND deduplication_matching = 1
      AND {_days(P.click_start, P.trans_end)} AND {_known_user()}
    GROUP BY user_id) bought ON buyer = user_id
GROUP BY days_last_visit""".replace("CAST(SUM(len(", "CAST(SUM(coalesce(len(").replace(
        """= "timestamp"]))) AS BIGINT)""", """= "timestamp"])), 0)) AS BIGINT)"""))


def _exposure(grain: str) -> str:
    """grain: 'user', 'wide' (user, all cells of a user as one) or 'partner'."""
    if grain == "partner":
        partners, start, end, edges = P.hour_merchants, P.hour_start, P.hour_end, P.hour_edges
        keys, label = ["partner_id", "user_id"], "avg_display_per_user_day_hour"
        cells = f"SELECT merchant_id AS partner_id, user_id, total_displays FROM ({_hour_cells()})"
    else:
        partners, start, end = P.freq_merchants, P.freq_start, P.freq_end
        edges = P.wide_edges if grain == "wide" else P.exposure_edges
        keys, label = ["user_id"], "avg_display_per_user_per_day"
        cells = f"SELECT user_id, total_displays FROM ({_recency_cells()})"
        if grain == "wide":
            cells = f"SELECT user_id, SUM(total_displays) AS total_displays FROM ({cells}) GROUP BY user_id"
    k = ", ".join(keys)
    scope = f"{_scope(partners, start, end)} AND {_known_user()}"
    out = (["partner_id"] if grain == "partner" else []) + [label]
    return _with(
        f"seen AS (SELECT {k}, AVG(total_displays) AS mean, SUM(total_displays) AS shown FROM ({cells}) GROUP BY {k})",
        f"clicked AS (SELECT {k}, COUNT(*) AS n, {_money('revenue_euro')} AS euro FROM clicks WHERE {scope} GROUP BY {k})",
        f"""bought AS (SELECT {k}, COUNT(*) AS n FROM matched_transactions
        WHERE partner_id IN {_in(partners)} AND {_days(start, end)} GROUP BY {k})""",
        f"exposed AS (SELECT {k} FROM displays WHERE {scope} GROUP BY {k})",
        body=f"""SELECT {"partner_id, " if grain == "partner" else ""}{_bucket("mean", edges)} AS {label},
       CAST(SUM(shown) AS BIGINT) AS sum_displays,
       CAST(SUM(coalesce(clicked.n, 0)) AS BIGINT) AS sum_clicks,
       CAST(SUM(coalesce(bought.n, 0)) AS BIGINT) AS sum_sales, coalesce({_money("euro")}, 0.0) AS rev
FROM exposed JOIN seen USING ({k}) LEFT JOIN clicked USING ({k}) LEFT JOIN bought USING ({k})
GROUP BY {", ".join(str(i + 1) for i in range(len(out)))}""")


# ---------------------------------------------------------------------------
# A/B test
# ---------------------------------------------------------------------------
def _emissions(source: str, partners, start: dt.date, end: dt.date) -> str:
    """One row per (user, partner, transaction, second): its value and its number of products."""
    values = "list_transform(products, lambda b: CAST(CAST(b.price * b.quantity AS VARCHAR) AS DECIMAL(38, 18)))"
    return f"""
    SELECT user_id, partner_id, transaction_id, unixtime, SUM(len(products)) AS n,
           CAST(CAST(SUM(list_sum({values})) AS VARCHAR) AS DOUBLE) AS worth
    FROM {source}
    WHERE {_scope(partners, start, end)} AND {_known_user()} AND persistent_user AND event_name = 'Sales'
    GROUP BY user_id, partner_id, transaction_id, unixtime"""


def _order_values(rule: str, source: str = "site_events", partners=None, start=None, end=None) -> str:
    of = _emissions(source, partners or P.ab_partners, start or P.ab_measures_start, end or P.ab_end)
    if rule == "max":
        return f"""SELECT user_id, partner_id, transaction_id, MAX(worth) AS order_value
    FROM ({of}) WHERE n > 0 GROUP BY ALL"""
    return f"""SELECT user_id, partner_id, transaction_id, newest.worth AS order_value FROM (
        SELECT user_id, partner_id, transaction_id, arg_max({{'n': n, 'worth': worth}}, unixtime) AS newest
        FROM ({of}) WHERE transaction_id IS NOT NULL GROUP BY ALL) WHERE newest.n > 0"""


def _transactions(values: str) -> str:
    return f"""SELECT user_id, partner_id, COUNT(DISTINCT transaction_id) AS transactions,
           {_money("order_value")} AS order_value
    FROM ({values}) GROUP BY user_id, partner_id"""


def _ab_seen() -> str:
    return f"""SELECT user_id, partner_id, {_day_of("MIN(unixtime)")} AS first_day_seen, COUNT(*) AS events
    FROM site_events
    WHERE {_scope(P.ab_partners, P.ab_users_start, P.ab_end)} AND persistent_user AND {_known_user()}
    GROUP BY user_id, partner_id"""


def _ab_delivered(scale: str = "") -> str:
    """Full outer join of the users' clicks and displays; ``scale`` multiplies the display revenue."""
    days = _days(P.ab_measures_start, P.ab_end)
    return f"""SELECT user_id, partner_id, coalesce(c.n, 0) AS clicks, coalesce(d.n, 0) AS displays,
           CASE WHEN c.paid IS NULL THEN d.paid / 1000 ELSE c.paid + coalesce(d.paid / 1000, 0) END AS spend
    FROM (SELECT user_id, partner_id, COUNT(*) AS n, {_money("revenue_local")} AS paid FROM clicks
          WHERE partner_id IN {_in(P.ab_partners)} AND partner_partition IN {_parts(P.ab_partners)} AND {days}
            AND {_known_user()} GROUP BY ALL) c
    FULL JOIN (
          SELECT user_id, merchant_id AS partner_id, COUNT(*) AS n,
                 {_money("sum_display_revenue_local" + scale)} AS paid FROM displays
          WHERE merchant_id IN {_in(P.ab_partners)} AND host_platform = 'EU' AND {days} AND {_known_user()}
          GROUP BY ALL) d USING (user_id, partner_id)"""


def _ab_users(rule: str) -> str:
    return _with(f"seen AS ({_ab_seen()})", f"delivered AS ({_ab_delivered()})",
                 f"sold AS ({_transactions(_order_values(rule))})", body=f"""
SELECT user_id, partner_id, {_pop()} AS population, first_day_seen, coalesce(events, 0) AS events,
       coalesce(clicks, 0) AS clicks,
       CASE WHEN delivered.displays IS NULL OR events IS NOT NULL OR transactions IS NOT NULL
            THEN coalesce(spend, 0.0) ELSE spend END AS spend,
       coalesce(transactions, 0) AS transactions,
       CASE WHEN transactions IS NULL OR events IS NOT NULL OR delivered.displays IS NOT NULL
            THEN coalesce(order_value, 0.0) ELSE order_value END AS order_value,
       coalesce(delivered.displays, 0) AS displays
FROM seen FULL JOIN delivered USING (user_id, partner_id) FULL JOIN sold USING (user_id, partner_id)""")


# ---------------------------------------------------------------------------
# path to purchase
# ---------------------------------------------------------------------------
def _first_purchases(with_dims: bool = False) -> str:
    c = P.p2p_date
    dims = dict(P.p2p_dims) if with_dims else {}
    shown = "".join(f", {src} AS {out}" for out, src in dims.items())
    chosen = "".join(f" AND {col} IN {_in(vals)}" for col, vals in P.p2p_dim_filters) if with_dims else ""
    return f"""
    SELECT partnerid AS partner_id, uid, MIN("timestamp") AS "timestamp"{shown}
    FROM site_events_rich
    JOIN (SELECT merchant_id, dim_client.* FROM dim_merchant, dim_client
          WHERE most_displayed_client_id = client_id) client ON merchant_id = partnerid
    WHERE eventtype = 'Sales' AND {_days(c - dt.timedelta(days=6), c)} AND partnerid IN {_in(P.p2p_partners)}{chosen}
      AND uid IN (SELECT uid FROM identity WHERE day = {_d(c)} AND host_platform = 'EU')
      AND partnerid IN (SELECT partner_id FROM partner_status WHERE day = {_d(c)} AND period = 7 AND status = 1)
    GROUP BY ALL"""


def _journey(with_dims: bool = False) -> list[str]:
    c = P.p2p_date
    dims = "".join(f", {name}" for name, _ in P.p2p_dims) if with_dims else ""
    order = ("partner_id NULLS FIRST, super_uid NULLS FIRST, \"timestamp\" DESC NULLS LAST, "
             "user_id NULLS FIRST, event_type NULLS FIRST, device NULLS FIRST")
    return [
        f"first_purchase AS ({_first_purchases(with_dims)})",
        f"""person AS (
        SELECT "timestamp", partner_id, uid AS super_uid,
               unnest([uid] || coalesce((SELECT flatten(list([e.uid FOR e IN events])) FROM identity
                       WHERE identity.uid = first_purchase.uid AND day = {_d(c)} AND host_platform = 'EU'), [])) AS user_id{dims}
        FROM first_purchase)""",
        f"""trail AS (
        SELECT e."timestamp", person.partner_id, super_uid, user_id, {DEVICE_CASE} AS device_type,
               eventtype AS event_type{dims}
        FROM site_events_rich e JOIN person ON e.uid = user_id AND e.partnerid = person.partner_id
        WHERE {_days(c - dt.timedelta(days=29), c)} AND person."timestamp" - e."timestamp" BETWEEN 0 AND 2592000)""",
        f"""switch AS (
        SELECT "timestamp", partner_id, super_uid, user_id, event_type,
               CASE WHEN device_type LIKE '%hone' THEN 'Smartphone' WHEN device_type IN ('iPad', 'Android - Tablet')
                    THEN 'Tablet' ELSE 'Desktop' END AS device{dims}
        FROM trail
        WHERE device_type NOT LIKE 'App%' AND device_type <> 'Mobile - Other' AND partner_id IN {_in(P.p2p_partners)}
          AND partner_id IN (SELECT merchant_id FROM dim_merchant, dim_client WHERE most_displayed_client_id = client_id)
        QUALIFY user_id <> {P.sentinel} AND user_id <> lead(user_id) OVER (ORDER BY {order}))""",
        f"""stops AS (
        SELECT partner_id, super_uid{dims},
               list({{'at': "timestamp", 'device': device}} ORDER BY "timestamp" DESC NULLS LAST, user_id NULLS FIRST,
                    event_type NULLS FIRST, device NULLS FIRST) AS stop
        FROM switch GROUP BY ALL)""",
        f"""sale AS (
        SELECT partner_id, super_uid{dims}, stop[1].at AS timestamp_ref, stop[i].device AS device_sale,
               stop[i + 1].device AS device_1, stop[i + 2].device AS device_2, stop[i + 3].device AS device_3
        FROM stops, LATERAL (SELECT unnest(range(1, len(stop) + 1)) AS i) WHERE stop[i].at = stop[1].at)""",
    ]


# ---------------------------------------------------------------------------
# the oracles
# ---------------------------------------------------------------------------
def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["display_reach"] = _with(body=f"""
SELECT COUNT(DISTINCT user_id) AS unique_users, COUNT(*) AS displays FROM displays
WHERE day >= {_d(P.reach_start)} AND campaign_id = {P.reach_campaign} AND client_id = {P.reach_client}
  AND partner_partition = {P.reach_partner % P.modulus} AND {_known_user()}""")
    o["display_reach_daily"] = o["display_reach"]
    windows = ", ".join(f"({_d(a)}, {_d(z)})" for a, z in P.reach_windows)
    o["reach_by_window"] = _with(body=f"""
SELECT window_start, window_end, campaign_id, client_id, COUNT(DISTINCT user_id) AS unique_users, COUNT(*) AS displays
FROM displays JOIN (VALUES {windows}) w(window_start, window_end) ON day BETWEEN window_start AND window_end
WHERE {_known_user()} GROUP BY ALL""")
    o["rolling_reach"] = _with(body=f"""
SELECT until, campaign_id, client_id, COUNT(DISTINCT user_id) AS unique_users, COUNT(*) AS displays
FROM displays JOIN (SELECT CAST(unnest(generate_series({_d(P.reach_first_day)}, {_d(P.reach_last_day)}, INTERVAL 1 DAY)) AS DATE) AS until)
  ON until - day BETWEEN 0 AND {P.reach_rolling_days - 1}
WHERE {_known_user()} AND {_days(P.reach_first_day, P.reach_last_day)} GROUP BY ALL""")
    o["frequency_cells"] = _with(body=_recency_cells())
    o["frequency_cells_daily"] = o["frequency_cells"]
    for name, non_fbx in (("frequency_by_recency", False), ("frequency_by_recency_non_fbx", True)):
        o[name] = _with(body=f"""
SELECT days_last_visit, AVG(total_displays) AS avg_total_displays, AVG(fbx_displays) AS avg_fbx_displays
FROM ({_recency_cells(non_fbx)}) GROUP BY days_last_visit""")
    o["hourly_recency_cells"] = _with(body=_hour_cells())
    o["hourly_recency_cells_daily"] = o["hourly_recency_cells"]
    o["frequency_by_hour"] = _with(body=f"""
SELECT merchant_id, hour_since_last_visit, AVG(total_displays) AS avg_total_displays,
       AVG(fbx_displays) AS avg_fbx_displays
FROM ({_hour_cells()}) GROUP BY ALL""")
    o["response_by_exposure_bucket"] = _exposure("user")
    o["response_by_exposure_bucket_bucketed"] = o["response_by_exposure_bucket"]
    o["response_by_exposure_bucket_wide"] = _exposure("wide")
    o["response_by_exposure_bucket_partner"] = _exposure("partner")
    hours = f"merchant_id IN {_in(P.hour_merchants)} AND {_days(P.hour_start, P.hour_end)}"
    o["hourly_response_detail"] = _with(
        f"cell AS ({_hour_cells()})",
        f"""clicked AS (
        SELECT merchant_id, user_id, day, COUNT(*) AS clicks, {_money("revenue_local")} AS rev_local,
               {_money("revenue_euro")} AS rev_euro
        FROM clicks WHERE {hours} AND {_known_user()} AND host_platform = 'EU'
          AND days_last_visit > 0 AND days_last_visit <= 1 GROUP BY ALL)""",
        f"""bought AS (
        SELECT partner_id AS merchant_id, user_id, day, COUNT(*) AS sales FROM matched_transactions
        WHERE partner_id IN {_in(P.hour_merchants)} AND {_days(P.hour_start, P.hour_end)} GROUP BY ALL)""",
        body="""SELECT merchant_id AS partner_id, user_id, day, hour_since_last_visit, total_displays, fbx_displays,
       clicks, rev_euro, rev_local, sales
FROM cell LEFT JOIN clicked USING (merchant_id, user_id, day) LEFT JOIN bought USING (merchant_id, user_id, day)""")
    o["conversion_by_click_recency"] = _click_recency(P.recency_partners)
    o["conversion_by_click_recency_multi"] = _click_recency(P.recency_partners_multi)
    feed = " ".join(f"WHEN producturl LIKE '{pat}' THEN '{lab}'" for pat, lab in P.feed_rules)
    bucket = P.feed_partner % P.modulus
    o["clicks_by_feed"] = _with(body=f"""
SELECT day, CASE {feed} ELSE 'other' END AS "type", COUNT(*) AS click
FROM catalog, clicks
WHERE sqlid = item_id AND partnerid = {P.feed_partner} AND partner_id = {P.feed_partner}
  AND catalog.partner_partition = {bucket} AND clicks.partner_partition = {bucket} AND {_days(P.feed_start, P.feed_end)}
GROUP BY ALL""")
    o["clicks_by_feed_rules"] = _with(
        """rule AS (
        SELECT pattern, label, min(p_partkey) AS priority FROM (
            SELECT '%' || lower(p_type) || '/' || split_part(p_name, ' ', 1) || '%' AS pattern,
                   lower(p_type) || ' ' || split_part(p_name, ' ', 1) AS label, p_partkey FROM part
            UNION ALL SELECT '%_/' || split_part(p_name, ' ', 1) || '/%', split_part(p_name, ' ', 1), p_partkey FROM part)
        GROUP BY ALL)""",
        f"""labelled AS (
        SELECT sqlid, coalesce(arg_min(label, (priority, pattern)), 'other') AS label
        FROM catalog LEFT JOIN rule ON producturl LIKE pattern
        WHERE partnerid = {P.feed_partner} AND partner_partition = {bucket} GROUP BY sqlid)""",
        body=f"""SELECT day, label AS "type", COUNT(*) AS click FROM clicks JOIN labelled ON sqlid = item_id
WHERE partner_id = {P.feed_partner} AND partner_partition = {bucket} AND {_days(P.feed_start, P.feed_end)} GROUP BY ALL""")
    o["available_days"] = _with(body=f"""
SELECT day FROM catalog_stats WHERE partner_id IN {_in(P.days_partners)} AND day >= {_d(P.days_start)} GROUP BY day""")
    item_days = _days(P.item_start, P.item_end)
    o["item_display_click_stats"] = _with(
        f"""shown AS (
        SELECT day, partnerid, item.itemid AS sqlid, COUNT(*) AS n
        FROM reco_displays, LATERAL (SELECT unnest(displayed_products) AS item)
        WHERE {item_days} AND partnerid IN {_in(P.item_partners)} AND host_platform = 'EU' GROUP BY ALL)""",
        f"""clicked AS (
        SELECT day, partner_id AS partnerid, item_id AS sqlid, COUNT(*) AS n, {_money("revenue_local")} AS paid
        FROM clicks WHERE {item_days} AND partner_partition IN {_parts(P.item_partners)} GROUP BY ALL)""",
        body="""SELECT day, partnerid, CAST(sqlid AS VARCHAR) AS itemid, id AS external_item_id,
       coalesce(shown.n, 0) AS displays, coalesce(clicked.n, 0) AS clicks, coalesce(paid, 0.0) AS revenue_local
FROM shown FULL JOIN clicked USING (day, partnerid, sqlid) JOIN catalog USING (partnerid, sqlid)""")
    product_days = _days(P.product_start, P.product_end)
    o["product_performance"] = _with(
        f"""bought AS (
        SELECT partner_id, {_day_of("click_timestamp")} AS day, click_internal_item_id AS internal_item_id,
               COUNT(DISTINCT transaction_id) AS sales
        FROM matched_transactions
        WHERE deduplication_matching = 1 AND {_days(P.product_start, P.product_conv_end)} GROUP BY ALL)""",
        f"""paid AS (
        SELECT partner_id, day, item_id AS internal_item_id, {_money("revenue_local")} AS revenue_local,
               {_money("revenue_euro")} AS revenue_euro
        FROM clicks WHERE partner_id = {P.product_partner} AND partner_partition = {P.product_partner % P.modulus}
        GROUP BY ALL)""",
        body=f"""SELECT partner_id, day, internal_item_id, product_name, value_coefficient,
       CAST(SUM(displays) AS BIGINT) AS displays, CAST(SUM(clicks) AS BIGINT) AS clicks,
       any_value(revenue_euro) AS revenue_euro, any_value(revenue_local) AS revenue_local, any_value(sales) AS sales
FROM catalog_stats JOIN dim_catalog item USING (internal_item_id)
LEFT JOIN paid USING (partner_id, day, internal_item_id) LEFT JOIN bought USING (partner_id, day, internal_item_id)
WHERE partner_id = {P.product_partner} AND item.merchant_id = {P.product_partner} AND {product_days}
GROUP BY partner_id, day, internal_item_id, product_name, value_coefficient""")
    graph = f"identity WHERE host_platform = 'EU' AND day = {_d(P.identity_day)}"
    linked = "len(list_distinct(flatten(list([e.uid FOR e IN events]))))"
    o["matched_cookies"] = _with(body=f"""
SELECT uid, users, {linked} AS matched_cookies FROM {graph} GROUP BY uid, users HAVING len(flatten(list(events))) > 0""")
    mine = f"partner_id = {P.cookie_partner}"
    shop = f"{mine} AND partner_partition = {P.cookie_partner % P.modulus} AND {_days(P.click_start, P.click_end)}"
    o["performance_by_matched_cookies"] = _with(
        f"linked AS (SELECT uid, users, {linked} AS cookies FROM {graph} GROUP BY uid, users)",
        f"""per_click AS (
        SELECT impression_id, coalesce(item_id, 0) AS item, COUNT(*) AS n, {_money("revenue_local")} AS paid
        FROM clicks WHERE {shop} GROUP BY ALL)""",
        f"""per_sale AS (
        SELECT impression_id, coalesce(clicked_item_id, 0) AS item, COUNT(DISTINCT transaction_id) AS n,
               {_money("order_value")} AS worth
        FROM matched_transactions WHERE {mine} AND attribution_type = 'pc' AND {_days(P.click_start, P.trans_end)}
        GROUP BY ALL)""",
        body=f"""SELECT greatest(1, least(3, coalesce(cookies, 1)))::INTEGER AS matched_cookies,
       COUNT(DISTINCT user_id) AS total_cookies, COUNT(*) AS displays, CAST(SUM(per_click.n) AS BIGINT) AS clicks,
       {_money("paid")} AS spend, CAST(SUM(per_sale.n) AS BIGINT) AS transactions, {_money("worth")} AS order_value
FROM (SELECT DISTINCT impression_id, user_id FROM displays WHERE {shop})
LEFT JOIN per_click USING (impression_id) LEFT JOIN per_sale USING (impression_id, item)
LEFT JOIN linked ON uid = user_id
GROUP BY 1""")
    own = f"kind = 'PARTNER_ID' AND number = {P.overlap_partner}"
    flags = f"""
        SELECT uid, bool_or(kind IN ('DATA_PROVIDER', 'APP_CK'))::INTEGER AS platform_match,
               coalesce(bool_or({own}), false)::INTEGER AS client_match,
               coalesce(bool_or(kind NOT IN ('DATA_PROVIDER', 'APP_CK') AND NOT ({own})), false)::INTEGER AS other_client_match
        FROM (SELECT uid, provider.providertype AS kind, unnest(coalesce(provider.providerids, [0])) AS number
              FROM (SELECT link.uid AS uid, unnest(link.providers) AS provider
                    FROM (SELECT unnest(events) AS link FROM {graph})))
        GROUP BY uid"""
    o["identity_match_flags"] = _with(body=flags)
    o["audience_overlap"] = _with(f"known AS ({flags})", body=f"""
SELECT (merchant_id = {P.overlap_partner})::INTEGER AS current_client, vertical_level_2_name, platform_match,
       client_match, other_client_match, {_money("marketplace_revenue_raw_euro")} AS revenue,
       COUNT(DISTINCT user_id) AS num_users
FROM dim_client JOIN displays USING (client_id) LEFT JOIN known ON uid = user_id
WHERE client_country_code = '{P.overlap_country}' AND host_platform = 'EU'
  AND {_days(P.identity_day - dt.timedelta(days=6), P.identity_day)}
GROUP BY 1, 2, 3, 4, 5""")
    o["ab_population"] = _with(body=f"SELECT user_id, {_pop()} AS population FROM site_events GROUP BY user_id")
    o["ab_event_measures"] = _with(body=f"SELECT *, {_pop()} AS population FROM ({_ab_seen()})")
    o["ab_delivery_measures"] = _with(body=f"SELECT *, {_pop()} AS population FROM ({_ab_delivered()})")
    o["ab_delivery_measures_small"] = _with(body=_ab_delivered(" * 1e-6"))
    orders = {"source": "order_site_events", "partners": P.orders_partners, "start": P.orders_start, "end": P.orders_end}
    for rule in ("max", "latest"):
        o[f"order_value_{rule}"] = _with(body=_order_values(rule))
        o[f"order_value_{rule}_orders"] = _with(body=_order_values(rule, **orders))
    for name, values in (("", _order_values("max")), ("_latest", _order_values("latest")),
                         ("_orders", _order_values("max", **orders))):
        o[f"ab_transaction_measures{name}"] = _with(body=f"SELECT *, {_pop()} AS population FROM ({_transactions(values)})")
    o["ab_user_measures"] = _ab_users("max")
    o["ab_user_measures_latest"] = _ab_users("latest")
    o["ab_user_measures_daily"] = o["ab_user_measures_bucketed"] = o["ab_user_measures"]
    o["ab_user_measures_latest_daily"] = o["ab_user_measures_latest"]
    start, n = P.funnel_start, P.funnel_mid_days
    cut = _d(start + dt.timedelta(days=n))
    early = f"""
    SELECT user_id, first_day_seen, {_day_of("seen")} AS max_day,
           CASE WHEN first_day_seen - {_day_of("seen")} < {n} THEN 'Lower' ELSE 'Mid' END AS funnel
    FROM (SELECT user_id, first_day_seen, (
            SELECT MAX(unixtime) FROM site_events e
            WHERE e.user_id = u.user_id AND {_scope(P.funnel_partners, start - dt.timedelta(days=n + 1), start - dt.timedelta(days=1))}
              AND persistent_user AND e.user_id <> {P.sentinel}) AS seen
          FROM test_users u WHERE first_day_seen <= {cut} GROUP BY ALL)"""
    o["early_funnel"] = _with(body=early)
    o["funnel_stage"] = _with(body=f"""
SELECT user_id, first_day_seen, funnel FROM ({early})
UNION ALL
SELECT user_id, first_day_seen, 'Mid' FROM test_users WHERE first_day_seen > {cut} GROUP BY ALL""")
    steps = _journey()
    o["buyers"] = _with(body=_first_purchases())
    o["buyers_by_dimension"] = _with(body=_first_purchases(with_dims=True))
    o["expand_identities"] = _with(*steps[:2], body="SELECT * FROM person")
    o["classify_device"] = _with(body=f"""
SELECT partnerid, uid, "timestamp", eventtype, {DEVICE_CASE} AS device_type FROM site_events_rich""")
    o["lookback_events"] = _with(*steps[:3], body="SELECT * FROM trail")
    o["cookie_switches"] = _with(*steps[:4], body="SELECT * FROM switch")
    o["cookie_switches_cut"] = o["cookie_switches"]
    o["device_sequence"] = _with(*steps, body="SELECT * FROM sale")
    for name, with_dims in (("sequence_distribution", False), ("sequence_distribution_by_dimension", True)):
        dims = "".join(f"{d}, " for d, _ in P.p2p_dims) if with_dims else ""
        o[name] = _with(*_journey(with_dims), body=f"""
SELECT {dims}device_sale, device_1, device_2, device_3, COUNT(*) AS "count" FROM sale GROUP BY ALL""")
    for name in ("replaced_table", "created_table", "exported_csv", "versioned_table"):
        o[name] = o["response_by_exposure_bucket"]
    # a MATERIALIZED CTE: DuckDB otherwise plans SELECT * through the as-of
    # join pathologically on larger inputs (same rows either way)
    o["matched_transactions_preview"] = _with(
        "looked_at AS MATERIALIZED (SELECT * FROM matched_transactions)", body=f"""
SELECT * FROM looked_at
WHERE day = {_d(P.preview_day)} AND partner_id = {P.preview_partner}
LIMIT {P.preview_rows}""")
    return o
