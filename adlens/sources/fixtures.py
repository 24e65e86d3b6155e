"""Advertising inputs derived from the bundled test tables (FIXTURES.md §2).

The warehouse tables the analyses expect (displays, clicks, matched
transactions, site events, identity graph, catalog, dimensions) do not exist
in the test data, so they are derived here from ``events`` and ``part`` by
fixed rules. Everything is a lazy DataFrame expression; the per-user
sequence columns use the skew-split windows of ``functions.sequence``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import inspect
import json
import sys
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions import sequence, time
from adlens.functions.sequence import previous_in_sequence
from adlens.functions.time import epoch_micros
from adlens.session import checkpoint_dir
from adlens.sources import storage
from adlens.sources.tables import read_table, table_path

WAREHOUSE_ROOT_CONF = "spark.adlens.warehouse.root"   # optional; defaults under spark.checkpoint.dir
MATERIALIZED = ("delivery", "matched_transactions", "site_events", "site_events_rich",
                "identity", "catalog_stats", "test_users", "order_site_events")
SCHEMA_FILE = "_schema.json"     # published with a table

# Fixed values of the test-data adapters.
ANONYMOUS_USER = 0               # sentinel user id in the test data
PARTNER_COUNT = 5                # partner_id = k % 5 + 1
PARTITION_MODULUS = 3            # partner_partition = pmod(partner_id, 3)
DISPLAY_EVENTS = ("view", "signup", "error")
CLICK_EVENT = "click"
PURCHASE_EVENT = "purchase"
SALES_NAME = "Sales"
ITEM_MODULUS = 200
PC_WINDOW_SECONDS = 3 * 86400    # post-click attribution window
IDENTITY_DAY = dt.date(2024, 1, 30)
STATUS_DAY = dt.date(2024, 1, 30)
TEST_USERS_FROM = dt.date(2024, 1, 11)
PLATFORM_EU = "EU"
PLATFORM_US = "US"

# One user-agent profile per event_id % 9
# (device family, os family, browser family, user agent, display env).
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
DEVICE_FIELDS = ("ua_device_family", "ua_os_family", "ua_browser_family", "useragent", "display_env")

PRODUCT_T = T.StructType([T.StructField("price", T.DoubleType()),
                          T.StructField("quantity", T.IntegerType())])
DISPLAYED_T = T.StructType([T.StructField("itemid", T.LongType())])
PROVIDER_T = T.StructType([T.StructField("providertype", T.StringType()),
                           T.StructField("providerids", T.ArrayType(T.IntegerType()))])


UNIX_SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000000"


def _device_column(idx: int, case: Column) -> Column:
    expr = None
    for i, prof in enumerate(DEVICE_PROFILES):
        v = F.lit(prof[idx]).cast("string")
        expr = F.when(case == i, v) if expr is None else expr.when(case == i, v)
    return expr


def _n_structs(n: Column, make) -> Column:
    """Array of ``n`` structs, the i-th (1-based) built by ``make(i)``."""
    return F.transform(F.array_repeat(F.lit(0), n.cast("int")), lambda _x, i: make(i + 1))


def base_events(events: DataFrame) -> DataFrame:
    """``events`` with every derived column (view ``fx_base``)."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    partner = (k % PARTNER_COUNT + 1).cast("int")
    ts_us = epoch_micros("ts")
    eid = F.col("event_id")
    has_arrays = (eid % 11) != 0
    n = eid % 4
    products = F.when(has_arrays, _n_structs(n, lambda i: F.struct(
        (F.col("value") * i).alias("price"), (i + 1).cast("int").alias("quantity"))))
    displayed = F.when(has_arrays, _n_structs(n, lambda i: F.struct(
        ((eid * 7 + i) % ITEM_MODULUS).cast("bigint").alias("itemid"))))
    device_case = (eid % len(DEVICE_PROFILES)).cast("int")
    is_purchase = F.col("event_type") == PURCHASE_EVENT

    b = e.select(
        "event_id", "user_id", "event_type", "value",
        partner.alias("partner_id"),
        F.pmod(partner, F.lit(PARTITION_MODULUS)).alias("partner_partition"),
        F.to_date("ts").alias("day"),
        ts_us.alias("ts_us"),
        F.expr(UNIX_SECONDS).alias("unixtime"),
        (eid % 2).cast("int").alias("is_fbx"),
        F.when(eid % 10 == 0, F.lit(PLATFORM_US)).otherwise(F.lit(PLATFORM_EU)).alias("host_platform"),
        F.expr("event_id div 3").alias("impression_id"),
        F.when(eid % 13 != 0, eid % ITEM_MODULUS).alias("item_id"),
        ((F.col("user_id") % 10) != 9).alias("persistent_user"),
        F.when(is_purchase, F.lit(SALES_NAME)).otherwise(F.col("event_type")).alias("event_name"),
        F.when(is_purchase, F.concat(F.col("user_id").cast("string"), F.lit("-"),
                                     F.expr("dayofmonth(ts) div 10").cast("string")))
        .alias("transaction_id"),
        products.alias("products"),
        displayed.alias("displayed_products"),
        F.col("value").alias("revenue_local"),
        (F.col("value") * 0.5).alias("revenue_euro"),
        *[_device_column(i, device_case).alias(name) for i, name in enumerate(DEVICE_FIELDS)],
    )
    return b


ORDER = ["ts_us", "event_id"]
HOUR = "__hour"  # segment of the sequence lookups: a hot user's rows are dealt out by hours


def _by_hour(base: DataFrame) -> DataFrame:
    return base.withColumn(HOUR, F.floor(F.col("ts_us") / F.lit(3_600_000_000)))


def with_recency(base: DataFrame) -> DataFrame:
    """Add ``days_last_visit``: days since the user's previous event (any type)."""
    b = previous_in_sequence(_by_hour(base), "user_id", HOUR, ORDER, F.col("ts_us"), "__prev_us")
    dlv = (F.col("ts_us") - F.col("__prev_us")).cast("double") / F.lit(86400000000.0)
    return b.withColumn("days_last_visit", dlv).drop("__prev_us", HOUR)


def with_last_click(base: DataFrame) -> DataFrame:
    """Add ``last_click``: the user's latest click at or before each row (as-of lookup).

    Only clicks and purchases take part, so the sequence is computed over
    those rows alone.
    """
    b = _by_hour(base.where(F.col("event_type").isin(CLICK_EVENT, PURCHASE_EVENT)))
    click = F.when(F.col("event_type") == CLICK_EVENT, F.struct(
        F.col("unixtime").alias("click_timestamp"), F.col("item_id").alias("clicked_item_id"),
        F.col("impression_id").alias("click_impression_id")))
    return previous_in_sequence(b, "user_id", HOUR, ORDER, click, "last_click", ignore_nulls=True)


class TestWarehouse:
    """All derived inputs for one scale-factor directory.

    With ``materialize=True`` (the default for registered plans) each
    derived fact table is written once as Parquet, partitioned by ``day``,
    under the session's shared ``spark.checkpoint.dir``; later plans and
    sessions read it back with partition pruning instead of re-deriving it. The
    folder is keyed by the input files and by the derivation's own code, and a
    table is published by renaming a finished copy, so readers never see a
    part of one. With ``materialize=False`` everything stays a lazy expression.
    """

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize = materialize

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def root(self) -> str:
        h = hashlib.sha256()
        for module in (sys.modules[__name__], sequence, time):
            h.update(inspect.getsource(module).encode())
        for name in ("events", "part", "orders", "lineitem"):
            h.update("\n".join(storage.fingerprint(self.spark, table_path(self.sf_dir, name))).encode())
        base = self.spark.conf.get(WAREHOUSE_ROOT_CONF, None) or \
            f"{checkpoint_dir(self.spark).rstrip('/')}/adlens-warehouse"
        return f"{base}/{h.hexdigest()[:16]}"

    def materialize_all(self) -> None:
        """Build every derived table now (otherwise each is built on first use)."""
        for name in MATERIALIZED:
            getattr(self, name)

    def _stored(self, name: str, build, partition_by: tuple[str, ...] = ("day",)) -> DataFrame:
        """The derived table ``name``: read back if it is stored (its schema lies beside it, so
        nothing is planned or derived for it), else built and stored first."""
        if not self.materialize:
            return build()
        path = f"{self.root}/{name}"
        schema = storage.read_file(self.spark, f"{path}/{SCHEMA_FILE}")
        if schema is None:
            df = build()
            # rebalancing by day makes files of the advisory size: small days share a
            # task, a large day is split over several
            rows = df.hint("rebalance", *partition_by) if partition_by else df
            written = f"{self.root}/.{name}-{uuid.uuid4().hex}"
            rows.write.partitionBy(*partition_by).parquet(written)
            schema = df.schema.json().encode()
            storage.write_file(self.spark, f"{written}/{SCHEMA_FILE}", schema)
            storage.publish(self.spark, written, path)
        # the schema also types the partition columns on read-back
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)

    @cached_property
    def base(self) -> DataFrame:
        return base_events(self.table("events"))

    # -- facts ---------------------------------------------------------------
    @cached_property
    def delivery(self) -> DataFrame:
        """Displays and clicks with the recency of the user's visit, stored once for both."""
        return self._stored("delivery", lambda: with_recency(self.base)
                            .where(F.col("event_type").isin(*DISPLAY_EVENTS, CLICK_EVENT))
                            .select("event_id", "event_type", "partner_id", "partner_partition", "day", "user_id",
                                    "impression_id", "host_platform", "days_last_visit", "is_fbx", "value",
                                    "unixtime", "item_id", "displayed_products", "revenue_local", "revenue_euro"))

    @cached_property
    def displays(self) -> DataFrame:
        """``display`` and ``display_full`` in one frame (both column layouts)."""
        return self.delivery.where(F.col("event_type").isin(*DISPLAY_EVENTS)).select(
            "partner_id", "partner_partition", "day", "user_id", "impression_id",
            (F.col("event_id") % 4).cast("int").alias("campaign_id"),
            (F.col("partner_id") + 100).cast("int").alias("client_id"),
            F.col("partner_id").alias("merchant_id"), "host_platform", "days_last_visit",
            "is_fbx", F.col("value").alias("sum_display_revenue_local"),
            (F.col("value") * 0.5).alias("marketplace_revenue_raw_euro"),
            F.col("unixtime").alias("timestamp"), "item_id", "displayed_products")

    @cached_property
    def clicks(self) -> DataFrame:
        """``click`` and ``click_full`` in one frame."""
        return self.delivery.where(F.col("event_type") == CLICK_EVENT).select(
            "partner_id", "partner_partition", F.col("partner_id").alias("merchant_id"),
            "host_platform", "day", "user_id", F.col("unixtime").alias("timestamp"),
            "impression_id", "item_id", "revenue_local", "revenue_euro", "days_last_visit")

    @cached_property
    def matched_transactions(self) -> DataFrame:
        """Purchases matched to the user's latest click at or before them."""
        def build():
            b = with_last_click(self.base).where(F.col("event_type") == PURCHASE_EVENT)
            lc = F.col("last_click")
            pc = lc.isNotNull() & ((F.col("unixtime") - lc["click_timestamp"]) <= PC_WINDOW_SECONDS)
            return b.select(
                "partner_id", "partner_partition", "day", "user_id", "transaction_id",
                lc["click_timestamp"].alias("click_timestamp"),
                lc["clicked_item_id"].alias("click_internal_item_id"),
                lc["clicked_item_id"].alias("clicked_item_id"),
                lc["click_impression_id"].alias("impression_id"),
                F.col("value").alias("order_value"),
                F.when(pc, F.lit("pc")).otherwise(F.lit("pv")).alias("attribution_type"),
                F.when(F.col("event_id") % 5 != 0, F.lit(1)).otherwise(F.lit(0))
                .alias("deduplication_matching"))
        return self._stored("matched_transactions", build)

    @cached_property
    def site_events(self) -> DataFrame:
        return self._stored("site_events", lambda: self.base.select(
            "partner_id", "partner_partition", "day", "user_id", "unixtime", "event_name",
            "persistent_user", "transaction_id", "products"))

    @cached_property
    def site_events_rich(self) -> DataFrame:
        return self._stored("site_events_rich", lambda: self.base.select(
            F.col("partner_id").alias("partnerid"), F.col("user_id").alias("uid"), "day",
            F.col("unixtime").alias("timestamp"), F.col("event_name").alias("eventtype"),
            *DEVICE_FIELDS))

    @cached_property
    def reco_displays(self) -> DataFrame:
        return self.displays.select(F.col("partner_id").alias("partnerid"), "day",
                                    "host_platform", "displayed_products")

    @cached_property
    def identity(self) -> DataFrame:
        return self._stored("identity", self._identity)

    def _identity(self) -> DataFrame:
        """Identity graph: uid -> linked uids (group ``u div 4``, members m <= u)."""
        users = (self.table("events").select(F.col("user_id").alias("u"))
                 .where(F.col("u").isNotNull() & (F.col("u") != ANONYMOUS_USER)).distinct()
                 .withColumn("g", F.expr("u div 4")))
        members = users.select(F.col("u").alias("m"), F.col("g"))
        m = F.col("m")
        ids = lambda *xs: F.array(*[x.cast("int") for x in xs])
        providers = (
            F.when(m % 3 == 0, F.array(F.struct(F.lit("DATA_PROVIDER").alias("providertype"),
                                                F.lit(None).cast("array<int>").alias("providerids"))))
            .when(m % 3 == 1, F.array(
                F.struct(F.lit("PARTNER_ID").alias("providertype"), ids(m % 5 + 1).alias("providerids")),
                F.struct(F.lit("APP_CK").alias("providertype"), F.array().cast("array<int>").alias("providerids"))))
            .otherwise(F.array(
                F.struct(F.lit("PARTNER_ID").alias("providertype"), ids(F.lit(1), F.lit(2)).alias("providerids")),
                F.struct(F.lit("CRM").alias("providertype"), F.lit(None).cast("array<int>").alias("providerids")))))
        # groups hold at most 4 users by construction, so collect_list is bounded
        links = (users.join(members, "g").where(F.col("m") <= F.col("u"))
                 .groupBy("u").agg(F.collect_list(F.struct(F.col("m").alias("uid"),
                                                           providers.alias("providers"))).alias("events")))
        return links.select(F.col("u").alias("uid"), (F.col("u") % 2).alias("users"), "events",
                            F.lit(PLATFORM_EU).alias("host_platform"), F.lit(IDENTITY_DAY).alias("day"))

    # -- catalog -------------------------------------------------------------
    @cached_property
    def catalog(self) -> DataFrame:
        p = self.table("part")
        partner = (F.col("p_partkey") % PARTNER_COUNT + 1).cast("int")
        return p.select(
            partner.alias("partnerid"),
            F.pmod(partner, F.lit(PARTITION_MODULUS)).alias("partner_partition"),
            F.col("p_partkey").alias("sqlid"),
            F.concat(F.lit("ext-"), F.col("p_partkey").cast("string")).alias("id"),
            F.concat(F.lit("http://x/"), F.lower("p_type"), F.lit("/"),
                     F.regexp_replace("p_name", " ", "/")).alias("producturl"))

    @cached_property
    def dim_catalog(self) -> DataFrame:
        p = self.table("part")
        return p.select((F.col("p_partkey") % PARTNER_COUNT + 1).cast("int").alias("merchant_id"),
                        F.col("p_partkey").alias("internal_item_id"),
                        F.col("p_size").alias("value_coefficient"))

    @cached_property
    def catalog_stats(self) -> DataFrame:
        return self._stored("catalog_stats", self._catalog_stats)

    def _catalog_stats(self) -> DataFrame:
        b = self.base.where(F.col("item_id").isNotNull()
                            & F.col("event_type").isin(*DISPLAY_EVENTS, CLICK_EVENT))
        is_disp = F.col("event_type").isin(*DISPLAY_EVENTS)
        s = b.groupBy("partner_id", "day", F.col("item_id").alias("internal_item_id")).agg(
            F.sum(F.when(is_disp, 1).otherwise(0)).alias("displays"),
            F.sum(F.when(~is_disp, 1).otherwise(0)).alias("clicks"))
        names = self.table("part").select(F.col("p_partkey").alias("internal_item_id"),
                                          F.col("p_name").alias("product_name"))
        return s.join(names, "internal_item_id", "left").select(
            "partner_id", "day", "internal_item_id", "product_name", "displays", "clicks")

    # -- dimensions (bounded: one row per partner) ----------------------------
    @cached_property
    def dim_merchant(self) -> DataFrame:
        r = self.spark.range(1, PARTNER_COUNT + 1)
        return r.select(F.col("id").cast("int").alias("merchant_id"),
                        (F.col("id") + 100).cast("int").alias("most_displayed_client_id"))

    @cached_property
    def dim_client(self) -> DataFrame:
        i = F.col("id")
        return self.spark.range(1, PARTNER_COUNT + 1).select(
            (i + 100).cast("int").alias("client_id"),
            F.when(i <= 3, F.lit("DK")).otherwise(F.lit("SE")).alias("client_country_code"),
            F.when(i <= 3, F.lit("Denmark")).otherwise(F.lit("Sweden")).alias("client_country_name"),
            F.when(i == 5, F.lit("OTHER")).otherwise(F.lit("COMMERCE")).alias("vertical_level_1_name"),
            F.when(i % 2 == 1, F.lit("RETAIL")).otherwise(F.lit("TRAVEL")).alias("vertical_level_2_name"),
            F.concat(F.lit("tier "), (i % 3 + 1).cast("string")).alias("ranking"))

    @cached_property
    def partner_status(self) -> DataFrame:
        r = self.spark.range(1, PARTNER_COUNT + 1)
        return r.select(F.col("id").cast("int").alias("partner_id"), F.lit(STATUS_DAY).alias("day"),
                        F.lit(7).alias("period"),
                        F.when(F.col("id") <= 4, F.lit(1)).otherwise(F.lit(0)).alias("status"))

    @cached_property
    def test_users(self) -> DataFrame:
        return self._stored("test_users", self._test_users, partition_by=())

    def _test_users(self) -> DataFrame:
        b = self.base.where((F.col("event_type") == PURCHASE_EVENT) & (F.col("day") >= F.lit(TEST_USERS_FROM)))
        return b.groupBy("user_id").agg(F.min("day").alias("first_day_seen"))

    # -- large order variant (orders + lineitem) -----------------------------
    @cached_property
    def order_site_events(self) -> DataFrame:
        return self._stored("order_site_events", self._order_site_events, partition_by=())

    def _order_site_events(self) -> DataFrame:
        """Sales site events built from orders; several orders of a customer in
        one month share a transaction id, so emissions repeat."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        li = self.table("lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
        # at most 7 line items per order: a bounded collect
        prods = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").cast("int").alias("quantity"))).alias("products"))
        partner = (F.col("o_custkey") % PARTNER_COUNT + 1).cast("int")
        j = o.join(prods, o.o_orderkey == prods.l_orderkey, "left")
        return j.select(
            partner.alias("partner_id"),
            F.pmod(partner, F.lit(PARTITION_MODULUS)).alias("partner_partition"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_custkey").alias("user_id"),
            F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))")
            .alias("unixtime"),
            F.lit(SALES_NAME).alias("event_name"),
            F.lit(True).alias("persistent_user"),
            F.concat(F.col("o_custkey").cast("string"), F.lit("-"),
                     F.date_format("o_orderdate", "yyyy-MM")).alias("transaction_id"),
            "products")
