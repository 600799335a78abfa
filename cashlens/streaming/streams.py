"""Structured Streaming forms of ingestion and live statistics."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import cents_sum, or_zero, ratio, to_usd
from ..functions.rules import from_micros, wall_micros
from ..operators.marts import settled
from ..operators.merge import ledger_changes, ledger_state, mark_removed_path, upsert_ledger_path, write_partitions
from ..schema import BANK_WEBHOOK
from ..sources import quarantine
from ..sources.feeds import normalize_processor, removed_ids
from ..sources.ledger import quarantine_path, read_ledger
from ..sources.tablelog import TableLog


def _run(writer, trigger):
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_to_ledger(events, ledger_path, checkpoint, account_id="acct_main", trigger=None, hourly=None, daily=None, cash=None):
    """Event stream into the ledger.

    Every micro-batch is a keyed merge, so a repeated batch or event leaves the table as it was and
    an event may come any time late. Within a batch the event created last wins. ``hourly``, ``daily`` and
    ``cash`` name tables that follow the ledger: live statistics and the cash position. Lines that a stream
    with ``broken`` could not read are kept under the ledger's log, by batch.
    """

    def merge(batch, batch_id):
        spark = batch.sparkSession
        if "reason" in batch.columns:
            quarantine.keep_broken(batch, quarantine_path(ledger_path, "events"), batch_id)
            batch = quarantine.readable(batch)
        rows = normalize_processor(
            batch.withColumn("event_created", F.col("created")), account_id, keep=("event_created",)
        )
        upsert_ledger_path(spark, ledger_path, rows, order_by=("event_created", "occurred_at"))
        if hourly:
            follow_ledger(spark, ledger_path, hourly, HOURLY)
        if daily:
            follow_ledger(spark, ledger_path, daily, DAILY)
        if cash:
            follow_ledger(spark, ledger_path, cash, CASH)

    return _run(events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), trigger)


def stream_bank_webhooks(spark, path):
    return spark.readStream.schema(BANK_WEBHOOK).json(path)


def stream_removals(webhooks, ledger_path, checkpoint, trigger=None):
    """Removal notifications mark their rows in the ledger."""

    def remove(batch, _batch_id):
        mark_removed_path(batch.sparkSession, ledger_path, removed_ids(batch))

    return _run(removed_ids_stream(webhooks).writeStream.foreachBatch(remove).option("checkpointLocation", checkpoint), trigger)


def removed_ids_stream(webhooks):
    """Notifications that name at least one removed row."""
    return webhooks.filter(F.array_size("transactions_removed") > 0)


def _timed(rows):
    """Rows with the event time as an instant, which time windows need."""
    return rows.withColumn("event_time", F.timestamp_micros(wall_micros("occurred_at")))


def _wall(instant):
    return from_micros(F.unix_micros(instant))


def _signed_counts(rows):
    """Per day of the window's start: signed counts by source and status over sliding hours, five minutes apart."""
    return (
        _timed(rows)
        .groupBy(F.window("event_time", "1 hour", "5 minutes"), "source", "status")
        .agg(F.sum("sign").alias("transactions"))
        .select(
            _wall("window.start").alias("start"),
            _wall("window.end").alias("end"),
            "source",
            "status",
            "transactions",
        )
        .withColumn("day", F.to_date("start"))
    )


def _signed_stats(rows):
    """Per day: signed count, exact cents and settled count."""
    cents = F.coalesce(cents_sum(F.col("amount") * F.col("sign")), F.lit(0)).cast("decimal(38,11)")
    return (
        rows.filter("occurred_at IS NOT NULL")
        .groupBy(F.to_date("occurred_at").alias("day"))
        .agg(
            F.sum("sign").alias("volume"),
            cents.alias("cents"),
            F.sum(F.when(settled(), F.col("sign")).otherwise(0)).alias("succeeded"),
        )
    )


def _exact(cents):
    return F.coalesce(cents_sum(cents * F.col("sign")), F.lit(0)).cast("decimal(38,11)")


#: The month of undated postings, which come after all others.
UNDATED = "9999-12-01"


def _signed_cash(rows):
    """Per posting day and its month: signed exact settled cash cents, and how many rows they come from."""
    net, sign = F.col("net_amount"), F.col("sign")
    rated = F.col("fx_rate").isNotNull()
    return (
        rows.filter((F.col("basis") == "cash") & settled())
        .groupBy(F.col("posted_date").alias("date"))
        .agg(
            _exact(F.when(net > 0, net).otherwise(0)).alias("inflow"),
            _exact(F.when(net < 0, -net).otherwise(0)).alias("outflow"),
            _exact(net).alias("net"),
            F.sum(F.when(rated, sign).otherwise(0)).alias("rated"),
            F.sum(F.when(rated & net.isNotNull(), sign).otherwise(0)).alias("known"),
            F.sum("sign").alias("entries"),
        )
        .withColumn("month", F.coalesce(F.trunc("date", "month"), F.lit(UNDATED).cast("date")))
    )


class Followed:
    """A table of live statistics: sums per key that changed rows are added to.

    ``signed`` gives the sums of rows with a column ``sign``, and the partition (``part``) they belong to;
    ``shown`` the columns of the statistics. Rows whose ``count`` has come to nothing are not kept.
    ``totals`` names sums that are also kept per partition, with their sum over all earlier partitions.
    """

    def __init__(self, signed, keys, sums, count, shown, part="day", totals=()):
        self.signed, self.keys, self.sums, self.count, self.shown = signed, keys, sums, count, shown
        self.part, self.totals = part, list(totals)

    def of(self, rows):
        """The statistics of ledger rows, with the sums they are made of."""
        return self.shown(self.signed(rows.withColumn("sign", F.lit(1).cast("long"))))

    def added(self, stored, deltas):
        both = _appended(stored, deltas, [self.part, *self.keys, *self.sums])
        return self.shown(self._summed(both, [self.part, *self.keys], self.sums))

    def carried(self, stored, rows):
        """Totals per partition, old and new ones added up, and what they come to before it (``before_…``).

        There are as many rows as partitions, so the running window is calendar-sized.
        """
        sums = list(dict.fromkeys([*self.totals, self.count]))
        both = self._summed(_appended(stored, rows, [self.part, *sums]), [self.part], sums)
        earlier = Window.orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(both.schema[c].dataType).alias(f"before_{c}") for c in self.totals]
        return both.select("*", *before)

    def _summed(self, both, keys, sums):
        sums = [F.sum(c).cast(both.schema[c].dataType).alias(c) for c in sums]
        return both.groupBy(*keys).agg(*sums).filter(F.col(self.count) != 0)


def _appended(stored, rows, columns):
    rows = rows.select(*columns)
    return rows if stored is None else stored.select(*columns).unionByName(rows)


HOURLY = Followed(
    _signed_counts,
    ["start", "end", "source", "status"],
    ["transactions"],
    "transactions",
    lambda rows: rows.select("start", "end", "source", "status", "transactions", "day"),
)
DAILY = Followed(
    _signed_stats,
    [],
    ["volume", "cents", "succeeded"],
    "volume",
    lambda rows: rows.select(
        "day", "volume", or_zero(to_usd(F.col("cents"))).alias("total_usd"), ratio("succeeded", "volume").alias("success_rate"), "cents", "succeeded"
    ),
)
CASH = Followed(
    _signed_cash,
    ["date"],
    ["inflow", "outflow", "net", "rated", "known", "entries"],
    "entries",
    lambda rows: rows,
    part="month",
    totals=["net", "known"],
)


def hourly_counts(rows):
    """Counts by source and status over sliding hours, moving five minutes at a time."""
    return HOURLY.of(rows).drop("day")


def daily_stats(rows):
    """Count, volume and settled share per day."""
    return DAILY.of(rows).select("day", "volume", "total_usd", "success_rate")


def cash_position(spark, path, start=None, end=None):
    """The daily cash position out of a table that follows the ledger (``CASH``), for a range of dates or all.

    Columns and rows as ``daily_cash_position`` gives them; undated rows, which come last, are in no range with
    an end. A range reads its own months and one row per month of balances carried into it, so a running sum
    stays within a month.
    """
    if not TableLog(spark, path).has_rows():
        return spark.createDataFrame([], ", ".join(["date date", *[f"{c} double" for c in POSITION]]))
    month = F.col("month").cast("date")
    days, carried = (spark.read.parquet(x).withColumn("month", month) for x in (path, f"{path}/{CARRIED}"))
    bounds = [F.lit(str(b)).cast("date") if b is not None else None for b in (start, end)]
    if start is not None:
        days = days.filter(F.col("month") >= F.trunc(bounds[0], "month"))
    if end is not None:
        days = days.filter(F.col("month") <= F.trunc(bounds[1], "month"))
    days = days.join(carried.select("month", "before_net", "before_known"), "month")
    so_far = Window.partitionBy("month").orderBy(F.col("date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    balance, known = (F.col(f"before_{c}") + F.sum(c).over(so_far) for c in ("net", "known"))
    # sums of no known value are missing, as those of the ledger's rows are
    cents = [("rated", F.col("inflow")), ("rated", F.col("outflow")), ("known", F.col("net"))]
    values = [F.when(F.col(n) != 0, to_usd(c)) for n, c in cents] + [F.when(known != 0, to_usd(balance))]
    shown = days.select("date", *[v.alias(c) for v, c in zip(values, POSITION, strict=True)])
    if start is not None:
        shown = shown.filter((F.col("date") >= bounds[0]) | F.col("date").isNull())
    return shown if end is None else shown.filter(F.col("date") <= bounds[1])


POSITION = ["inflows_usd", "outflows_usd", "net_flow_usd", "cumulative_cash_usd"]
#: Folder of a table that follows the ledger for its totals per partition.
CARRIED = "_carried"


def follow_ledger(spark, ledger_path, path, kind):
    """Bring a written table of live statistics up to the ledger's version by the changes since its own.

    A changed row takes its former self out of the sums and brings its present self in, so no ledger
    row is read again, however late an event comes. The table's version of the ledger is moved into place
    together with its rows: a change is added once, whatever is repeated. A table without a version, or one
    that has missed changes which are no longer kept, is computed from the whole ledger.
    """
    ledger, log = ledger_state(spark, ledger_path), TableLog(spark, path)
    state, now = log.state(), ledger.get("version", 0)
    seen = state.get("ledger_version")
    if seen == now:
        return
    missed = None
    if seen is not None and seen + 1 >= ledger.get("followed_from", 0):
        missed = [ledger_changes(spark, ledger_path, v) for v in range(seen + 1, now + 1)]
    staging, after, part = log.staging(), {**state, "ledger_version": now}, kind.part
    stored, totals = None, None
    if missed is None or any(m is None for m in missed):
        deltas = _kept(kind.of(read_ledger(spark, ledger_path)).filter(F.col(part).isNotNull()), f"{staging}/deltas")
        parts = [n.split("=", 1)[1] for n in log.names(path) if n.startswith(f"{part}=")]
        write_partitions(deltas, f"{staging}/rows", [part])
        touched = True
    else:
        changes = reduce(lambda a, b: a.unionByName(b), missed)
        out = changes.filter("before IS NOT NULL").select("before.*", F.lit(-1).cast("long").alias("sign"))
        rows = out.unionByName(changes.select("after.*", F.lit(1).cast("long").alias("sign")))
        deltas = kind.signed(rows)
        deltas = deltas.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in kind.sums]) & F.col(part).isNotNull())
        deltas = _kept(deltas, f"{staging}/deltas")
        # the list of days or months is calendar-sized
        parts = [r[0] for r in deltas.select(part).distinct().collect()]
        touched = bool(parts)
        if touched:
            if log.has_rows():
                stored = spark.read.parquet(path).withColumn(part, F.col(part).cast("date")).filter(F.col(part).isin(parts))
                totals = spark.read.parquet(f"{path}/{CARRIED}") if kind.totals else None
            write_partitions(kind.added(stored, deltas), f"{staging}/rows", [part])
    # a day whose rows have all gone has nothing staged: its folder goes
    placed = log.moves_of(f"{staging}/rows", path, 1)
    kept = {target for _, target in placed}
    moves = [(None, f"{path}/{part}={p}") for p in parts if f"{path}/{part}={p}" not in kept] + placed
    if kind.totals and touched:
        kind.carried(totals, deltas).coalesce(1).write.parquet(f"{staging}/carried")
        moves.append((f"{staging}/carried", f"{path}/{CARRIED}"))
    log.commit(state.get("version", 0), staging, moves, **after)


def _kept(rows, path):
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stream_hourly_counts(events, ledger_path, path, checkpoint, account_id="acct_main", trigger=None):
    """Event stream into the ledger and the rolling hourly counts of its transactions."""
    return stream_to_ledger(events, ledger_path, checkpoint, account_id, trigger, hourly=path)


def stream_daily_stats(events, ledger_path, path, checkpoint, account_id="acct_main", trigger=None):
    """Event stream into the ledger and the daily statistics of its transactions."""
    return stream_to_ledger(events, ledger_path, checkpoint, account_id, trigger, daily=path)


def stream_cash_position(events, ledger_path, path, checkpoint, account_id="acct_main", trigger=None):
    """Event stream into the ledger and the sums behind its daily cash position, which ``cash_position`` reads."""
    return stream_to_ledger(events, ledger_path, checkpoint, account_id, trigger, cash=path)
