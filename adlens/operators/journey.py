"""Cross-device path to purchase.

buyers -> expand_identities -> lookback_events (classify_device)
-> cookie_switches -> device_sequence -> sequence_distribution
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.devices import DEVICE_TYPES_KEPT, classify_device, collapse_device
from adlens.functions.predicates import day_between, not_anonymous
from adlens.functions.sequence import with_segments
from adlens.sources.schemas import require_columns
from adlens.sources.storage import keep_table

SALES = "Sales"
LOOKBACK_SECONDS = 30 * 86400

# Order of the journey: buyer ascending, newest event first. The original
# has no tiebreak for equal timestamps; user, event type and device make the
# order total (identical rows are interchangeable).
BUYER = ["partner_id", "super_uid"]


def _journey_order() -> list[Column]:
    return [F.col("timestamp").desc_nulls_last(), F.col("user_id").asc_nulls_first(),
            F.col("event_type").asc_nulls_first(), F.col("device").asc_nulls_first()]


def buyers(site_events_rich: DataFrame, dim_merchant: DataFrame, dim_client: DataFrame,
           identity: DataFrame, partner_status: DataFrame, *, partners: Sequence[int],
           calc_date: dt.date, days: int = 7, platform: str = "EU",
           dims: Mapping[str, str] | None = None,
           dim_filters: Mapping[str, Sequence] | None = None) -> DataFrame:
    """First purchase time per (partner, uid) over ``days`` days up to
    ``calc_date``, for uids in the identity snapshot and partners whose
    weekly status is clean. ``dims`` maps output names to client-dimension
    columns (country, vertical, ...); ``dim_filters`` restricts them.

    The identity and status joins only test existence, so they are semi
    joins (MIN is unchanged by the duplicates an inner join would add).
    """
    dims = dict(dims or {})
    ev = site_events_rich.where(day_between("day", calc_date - dt.timedelta(days=days - 1), calc_date)
                                & (F.col("eventtype") == SALES)
                                & F.col("partnerid").isin(list(partners)))
    mc = dim_merchant.join(dim_client, F.col("most_displayed_client_id") == F.col("client_id"))
    for col, values in (dim_filters or {}).items():
        mc = mc.where(F.col(col).isin(list(values)))
    mc = mc.select(F.col("merchant_id").alias("partnerid"),
                   *[F.col(src).alias(out) for out, src in dims.items()])
    matched = identity.where((F.col("day") == F.lit(calc_date)) & (F.col("host_platform") == platform)) \
        .select("uid")
    clean = partner_status.where((F.col("day") == F.lit(calc_date)) & (F.col("period") == 7)
                                 & (F.col("status") == 1)).select(F.col("partner_id").alias("partnerid"))
    j = ev.join(mc, "partnerid").join(matched, "uid", "left_semi").join(clean, "partnerid", "left_semi")
    return j.groupBy(F.col("partnerid").alias("partner_id"), "uid", *dims.keys()) \
        .agg(F.min("timestamp").alias("timestamp"))


def expand_identities(buyer_ids: DataFrame, identity: DataFrame, *, calc_date: dt.date,
                      platform: str = "EU", dedup: bool = False) -> DataFrame:
    """(timestamp, partner, super_uid, user_id) for the buyer itself plus
    every linked uid. If the graph lists the uid itself it appears twice
    (``dedup=True`` removes such repeats)."""
    extra = [c for c in buyer_ids.columns if c not in ("timestamp", "partner_id", "uid")]
    own = buyer_ids.select("timestamp", "partner_id", *extra, F.col("uid").alias("super_uid"),
                           F.col("uid").alias("user_id"))
    links = (identity.where((F.col("day") == F.lit(calc_date)) & (F.col("host_platform") == platform))
             .select("uid", F.explode("events").alias("m"))
             .select("uid", F.col("m.uid").alias("matched_uid")))
    linked = buyer_ids.join(links, "uid").select(
        "timestamp", "partner_id", *extra, F.col("uid").alias("super_uid"),
        F.col("matched_uid").alias("user_id"))
    out = own.unionByName(linked)
    return out.distinct() if dedup else out


def with_device_type(df: DataFrame) -> DataFrame:
    """A27 applied to a frame carrying the user-agent columns."""
    return df.withColumn("device_type", classify_device())


def lookback_events(buyers_full: DataFrame, site_events_rich: DataFrame, *, calc_date: dt.date,
                    lookback_seconds: int = LOOKBACK_SECONDS,
                    event_days: int | None = 30, bin_seconds: int = 5 * 86400, rows_per_task: int = 1_000_000,
                    max_hot: int = 10_000) -> DataFrame:
    """Site events of any linked uid within ``lookback_seconds`` up to the purchase.

    The day bound (``event_days`` days up to ``calc_date``) is pushed into the
    scan; ``event_days=None`` removes it. Events are first reduced to the buyers'
    (user, partner) pairs, which are pre-aggregated, so Spark broadcasts them if
    their size allows. The interval join is an equi-join on (user, partner, time bin):
    a buyer row meets the few bins its interval touches, and a hot user's
    events are spread over their bins. A (user, partner, bin) with more than ``rows_per_task`` events is
    measured and salted: its events are dealt over as many parts as they need, its buyer
    rows are repeated for each. The ``max_hot`` heaviest are treated so (a broadcast of so many
    rows at most); any other has less than a ``max_hot``-th of all events.
    """
    ev = site_events_rich
    if event_days is not None:
        ev = ev.where(day_between("day", calc_date - dt.timedelta(days=event_days - 1), calc_date))
    keys = ["user_id", "partner_id"]
    ev = ev.withColumnsRenamed({"uid": "user_id", "partnerid": "partner_id"}).withColumn(
        "__bin", F.floor(F.col("timestamp") / bin_seconds))
    hot = (ev.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task)
           .orderBy(F.desc("n"), *keys, "__bin").limit(max_hot)
           .select(*keys, "__bin", F.ceil(F.col("n") / rows_per_task).cast("int").alias("__parts")))
    ev = (ev.join(buyers_full.select(*keys).distinct(), keys, "left_semi")
          .select(*keys, F.col("timestamp").alias("ev_ts"), classify_device().alias("device_type"),
                  F.col("eventtype").alias("event_type"), "__bin"))
    hot, parts = F.broadcast(hot), F.coalesce("__parts", F.lit(1))
    salt = F.pmod(F.xxhash64("ev_ts", "device_type", "event_type"), parts).cast("int")  # of the row, so a lost task repeats it
    ev = ev.join(hot, [*keys, "__bin"], "left").withColumn("__salt", F.when(parts > 1, salt).otherwise(0)).drop("__parts")
    b = buyers_full.withColumnRenamed("timestamp", "buy_ts")
    b = b.withColumn("__bin", F.explode(F.sequence(
        F.floor((F.col("buy_ts") - lookback_seconds) / bin_seconds), F.floor(F.col("buy_ts") / bin_seconds))))
    b = (b.join(hot, [*keys, "__bin"], "left")
         .withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts"))
    j = ev.join(b, [*keys, "__bin", "__salt"]).where(
        F.col("ev_ts").between(F.col("buy_ts") - lookback_seconds, F.col("buy_ts")))
    extra = [c for c in buyers_full.columns if c not in ("timestamp", "partner_id", "super_uid", "user_id")]
    return j.select(F.col("ev_ts").alias("timestamp"), "partner_id", *extra, "super_uid", "user_id",
                    "device_type", "event_type")


SWITCH_COLUMNS = ("timestamp", *BUYER, "device", "user_id", "event_type")


def _next_buyers_head(heads: DataFrame) -> DataFrame:
    """``BUYER, next_head``: for each buyer the first user of the buyer that follows in order.

    ``heads`` has one row per buyer. Buyers are range-partitioned by their own
    ordering, whatever its type; each range looks ahead inside itself and only its
    first rows (one per range) meet in one task.
    """
    ranges = keep_table(heads.repartitionByRange(*BUYER).withColumn("__range", F.spark_partition_id()), "buyer-ranges")
    inside = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in BUYER])
    ranges_first = (ranges.withColumn("__n", F.row_number().over(inside)).where("__n = 1")
                    .select("__range", F.lead("head_user").over(Window.orderBy("__range")).alias("__after")))
    return (ranges.withColumn("__next", F.lead("head_user").over(inside))
            .withColumn("__last", F.lead(F.lit(1)).over(inside).isNull())
            .join(ranges_first, "__range")
            .select(*BUYER, F.when(F.col("__last"), F.col("__after")).otherwise(F.col("__next")).alias("next_head")))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` in which null equals null."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*(f"__r_{k}" for k in keys))


def cookie_switches(events: DataFrame, dim_merchant: DataFrame, dim_client: DataFrame, *,
                    partners: Sequence[int], sentinel=None, segment_seconds: int = 3600,
                    max_segment_rows: int | None = None) -> DataFrame:
    """Keep the journey rows whose *next* row (in buyer order, newest
    first) belongs to a different user_id. Other columns of ``events`` are kept.

    Row n is compared with row n+1 of the global order, so each buyer's
    oldest row is compared with the *next buyer's* newest row and the very
    last row has no successor.

    No step sorts a whole buyer or the whole table. The journey is sorted once,
    inside segments of a buyer's hours, and stored with each row's successor.
    The last row of a segment takes the head of the next one from a
    one-row-per-segment table: the buyer's next (older) segment or, for the
    buyer's oldest one, the next buyer's newest head.

    With ``max_segment_rows``, the journey is stored before it is sorted and hours of a buyer
    with more rows are cut at quantiles of their times (``functions.sequence``).
    """
    require_columns(events, ("timestamp", *BUYER, "user_id", "device_type", "event_type"),
                    "cookie_switches")
    mc = dim_merchant.join(dim_client, F.col("most_displayed_client_id") == F.col("client_id")) \
        .select(F.col("merchant_id").alias("partner_id"))
    x = (events.join(mc, "partner_id", "left_semi")
         .where(F.col("device_type").isin(*DEVICE_TYPES_KEPT) & F.col("partner_id").isin(list(partners)))
         .withColumn("device", collapse_device("device_type")))
    if max_segment_rows is not None:
        x = keep_table(x, "journey-input")
    x = with_segments(x, BUYER, "timestamp", segment_seconds, "__segment", max_segment_rows)
    extra = [c for c in events.columns if c not in (*SWITCH_COLUMNS, "device_type")]
    seg = [*BUYER, "__segment"]          # newest-first order is monotone in __segment
    w = Window.partitionBy(*seg).orderBy(*_journey_order())
    x = keep_table(x.select(*SWITCH_COLUMNS, *extra, "__segment",
                            F.lead("user_id").over(w).alias("__next_user"),
                            F.lead(F.lit(1)).over(w).isNull().alias("__is_last"),
                            (F.row_number().over(w) == 1).alias("__is_first")), "journey")

    older = Window.partitionBy(*BUYER).orderBy(F.col("__segment").desc_nulls_last())
    heads = (x.where("__is_first").select(*seg, F.col("user_id").alias("head_user"))
             .withColumn("__next_head", F.lead("head_user").over(older))
             .withColumn("__newest", F.row_number().over(older) == 1)
             .withColumn("__oldest", F.lead(F.lit(1)).over(older).isNull()))
    heads = keep_table(heads, "journey-heads")
    after = _next_buyers_head(heads.where("__newest").select(*BUYER, "head_user"))
    oldest = _null_safe(heads.where("__oldest").select(*seg), after, BUYER).select(
        *seg, F.col("next_head").alias("__boundary_user"))
    boundary = heads.where("not __oldest").select(*seg, F.col("__next_head").alias("__boundary_user")).unionByName(oldest)

    differs = not_anonymous("user_id", sentinel)
    inner = x.where("not __is_last").where((F.col("user_id") != F.col("__next_user")) & differs)
    last = _null_safe(x.where("__is_last"), boundary, seg).where(
        (F.col("user_id") != F.col("__boundary_user")) & differs)
    out = [*SWITCH_COLUMNS, *extra]
    return inner.select(*out).unionByName(last.select(*out))


def device_sequence(switches: DataFrame, k: int = 3) -> DataFrame:
    """Device at the sale (rows at the buyer's max timestamp; ties keep
    several) and the devices of the next ``k`` rows of the same buyer. Other columns
    of ``switches`` are those of the sale row.

    The sale rows and the ``k`` rows after them lie within the buyer's newest
    ``k + 1`` distinct timestamps, so a rank limit, applied before the shuffle too,
    keeps the rest of a long journey out of the window.
    """
    buyer = Window.partitionBy(*BUYER)
    newest = F.dense_rank().over(buyer.orderBy(F.col("timestamp").desc_nulls_last()))
    x = switches.withColumn("__rank", newest).where(F.col("__rank") <= k + 1)
    w = buyer.orderBy(*_journey_order())
    for i in range(1, k + 1):
        x = x.withColumn(f"device_{i}", F.lead("device", i).over(w))
    extra = [c for c in switches.columns if c not in SWITCH_COLUMNS]
    return x.where((F.col("__rank") == 1) & F.col("timestamp").isNotNull()).select(
        *BUYER, *extra, F.col("timestamp").alias("timestamp_ref"), F.col("device").alias("device_sale"),
        *[f"device_{i}" for i in range(1, k + 1)])


def sequence_distribution(sequences: DataFrame, k: int = 3, dims: Sequence[str] = ()) -> DataFrame:
    """Number of buyers' sale rows per device sequence (NULL is a group),
    by the dimensions ``dims`` if given."""
    cols = [*dims, "device_sale", *[f"device_{i}" for i in range(1, k + 1)]]
    return sequences.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
