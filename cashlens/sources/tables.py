"""The sales tables read as a ledger, its dimensions, and the feeds that lead to it.

Ledger columns follow plain integer arithmetic on the line keys, so any SQL engine gives the
same rows.
"""

import hashlib
import uuid

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.rules import tag_recurring, with_date_parts, with_usd
from ..session import shared_dir
from .ledger import DAYS, by_month, conform_to_schema, copy_ledger, read_ledger, sorted_by_day, with_days, write_ledger

AS_OF = "2001-08-01"
FX_RATES = [1.0, 0.92, 0.79, 0.73, 0.65, 0.0067]
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DESCRIPTIONS = ["Monthly plan renewal", "Subscription invoice", "One-time order", "RECURRING billing"]


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def build_ledger(spark, sf_dir, multi_currency=False, arranged=False):
    """One ledger row per sales line, joined to its order for customer and product.

    ``arranged`` groups the narrow source rows by month and sorts them before the wide columns are
    derived, so that a partitioned write neither shuffles nor sorts the wide ones.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority"
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if arranged:
        joined = by_month(
            joined.withColumns({"occurred_year": F.year("l_shipdate"), "occurred_month": F.month("l_shipdate")})
        ).drop("occurred_year", "occurred_month")
    timed = joined.withColumn("h", F.expr("l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey*3")).withColumn(
        "occurred_at", F.expr("l_shipdate + make_dt_interval(0, cast(h % 24 AS int))")
    )
    if arranged:
        timed = sorted_by_day(with_days(timed))
    keyed = (
        timed.withColumns({"ht": F.expr("h % 100"), "hs": F.expr("(h div 100) % 100")})
        .withColumn(
            "type",
            F.expr(
                """CASE WHEN ht < 60 THEN 'charge' WHEN ht < 67 THEN 'refund' WHEN ht < 77 THEN 'payout'
                WHEN ht < 89 THEN 'fee' WHEN ht < 93 THEN 'transfer' WHEN ht < 98 THEN 'invoice_payment'
                ELSE 'adjustment' END"""
            ),
        )
        .withColumn(
            "status",
            F.expr(
                """CASE WHEN type IN ('payout', 'transfer', 'fee') THEN 'succeeded'
                WHEN type = 'refund' THEN IF(hs < 97, 'succeeded', 'failed')
                WHEN hs < 92 THEN 'succeeded' WHEN hs < 97 THEN 'failed' WHEN hs < 99 THEN 'pending'
                ELSE 'disputed' END"""
            ),
        )
        .withColumn(
            "amount",
            F.expr("cast(round(cast(l_extendedprice AS decimal(18,2)) * 100) AS bigint) % 500000 + 100"),
        )
        .withColumn(
            "fee_amount",
            F.expr(
                """coalesce(CASE WHEN type = 'charge' AND status = 'succeeded'
                THEN least((amount * 29 + 30000) div 1000, amount)
                WHEN type = 'fee' THEN amount ELSE 0L END, 0L)"""
            ),
        )
        .withColumn(
            "net_amount",
            F.expr(
                """CASE WHEN type IN ('refund', 'payout', 'fee') THEN -amount
                WHEN type = 'transfer' THEN IF((h div 10) % 10 < 6, -amount, amount)
                WHEN type = 'adjustment' THEN IF(h % 2 = 0, -amount, amount)
                WHEN type = 'charge' AND status = 'succeeded' THEN amount - fee_amount
                ELSE amount END"""
            ),
        )
        .withColumn(
            "posted_date",
            F.expr("IF(h % 499 = 0, NULL, date_add(to_date(l_shipdate), cast((h div 7) % 3 AS int)))"),
        )
        .withColumn(
            "product_line",
            _pick(fv.PRODUCT_LINES, F.array_position(F.array(*[F.lit(p) for p in ORDER_PRIORITIES]), F.col("o_orderpriority")) - 1),
        )
        # what the wide columns use more than once: a column here, the wide projections stay one
        .withColumn("description", _pick(DESCRIPTIONS, F.expr("(h div 37) % 4")))
        .withColumn("fx_rate", _pick(FX_RATES, F.expr("h % 6")) if multi_currency else F.lit(1.0))
    )
    declined = (F.col("status") == "failed") & F.col("type").isin(fv.REVENUE_TYPES)
    disputed = F.col("status") == "disputed"
    account = F.create_map(*[F.lit(x) for pair in fv.ACCOUNT_CODES.items() for x in pair])
    rows = keyed.select(
        F.expr("concat_ws('-', 'txn', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("transaction_id"),
        F.expr("concat_ws('-', 'idem', l_orderkey, l_linenumber)").alias("idempotency_key"),
        "occurred_at",
        F.col("posted_date").cast("timestamp_ntz").alias("posted_at"),
        "posted_date",
        "type",
        "status",
        F.expr(
            """CASE WHEN l_partkey % 20 < 10 THEN 'stripe' WHEN l_partkey % 20 < 12 THEN 'adyen'
            WHEN l_partkey % 20 < 14 THEN 'ach' WHEN l_partkey % 20 < 15 THEN 'wire'
            WHEN l_partkey % 20 < 18 THEN 'plaid' ELSE 'manual_journal' END"""
        ).alias("source"),
        "amount",
        (_pick(fv.CURRENCIES, F.expr("h % 6")) if multi_currency else F.lit("USD")).alias("currency"),
        "fx_rate",
        "net_amount",
        "fee_amount",
        F.concat(F.lit("cus_"), F.col("o_custkey")).alias("customer_id"),
        F.concat(F.lit("acct_"), F.col("l_suppkey")).alias("merchant_account_id"),
        "product_line",
        _pick(fv.DEPARTMENTS, F.expr("(h div 13) % 6")).alias("department"),
        F.element_at(account, F.col("product_line")).alias("account_code"),
        F.concat(F.lit("CC-"), F.col("l_returnflag")).alias("cost_center"),
        F.expr(
            """IF((h div 11) % 100 < IF(type IN ('payout', 'fee'), 85, 70), 'cash', 'accrual')"""
        ).alias("basis"),
        F.when(declined, _pick(fv.DECLINE_CODES, F.expr("(h div 17) % 15"))).alias("decline_code"),
        F.expr(
            """CASE WHEN status <> 'failed' OR (h div 19) % 10 < 6 THEN 'normal'
            WHEN (h div 19) % 10 < 9 THEN 'elevated' ELSE 'highest' END"""
        ).alias("risk_level"),
        F.when(disputed, F.expr("concat_ws('-', 'dp_txn', l_orderkey, l_linenumber, l_partkey, l_suppkey)")).alias("dispute_id"),
        F.when(disputed, _pick(fv.DISPUTE_STATUSES, F.expr("(h div 23) % 4"))).alias("dispute_status"),
        "description",
        F.when(
            F.expr("h % 10 <> 0"),
            F.concat(
                F.lit('{"card_brand": "'),
                _pick(fv.CARD_BRANDS, F.expr("(h div 29) % 5")),
                F.lit('", "card_funding": "'),
                _pick(fv.CARD_FUNDING, F.expr("(h div 31) % 3")),
                F.lit('"}'),
            ),
        ).alias("metadata_json"),
        F.expr("occurred_at + INTERVAL 1 HOUR").alias("ingested_at"),
        F.concat(F.lit("batch_"), F.col("l_linestatus")).alias("batch_id"),
        *(DAYS if arranged else []),
    )
    return with_usd(conform_to_schema(tag_recurring(with_date_parts(rows, known=DAYS if arranged else ()))))


def build_customers(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("cus_"), F.col("c_custkey")).alias("customer_id"),
        F.concat(F.lit("billing@cus"), F.col("c_custkey"), F.lit(".example")).alias("customer_email"),
        F.col("c_name").alias("customer_name"),
        F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.col("n_name").alias("country"),
        F.expr(
            """CASE c_mktsegment WHEN 'BUILDING' THEN 'enterprise' WHEN 'AUTOMOBILE' THEN 'pro'
            WHEN 'MACHINERY' THEN 'starter' ELSE 'free' END"""
        ).alias("plan"),
        F.col("c_acctbal").alias("ltv_usd"),
        F.lit(True).alias("is_active"),
    )


def build_merchants(spark, sf_dir):
    suppliers = read_table(spark, sf_dir, "supplier")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("acct_"), F.col("s_suppkey")).alias("merchant_account_id"),
        F.col("s_name").alias("account_name"),
        F.lit("USD").alias("currency"),
        F.col("n_name").alias("country"),
        F.lit(True).alias("is_active"),
    )


class Workspace:
    """Tables of one input folder, with the ledger written once and shared by all reports.

    The written ledger survives lost executors, and reports prune its partitions and columns
    instead of repeating the join and the derivations.
    """

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = AS_OF
        files = sorted(
            f for t in ("lineitem", "orders", "events") for f in read_table(spark, sf_dir, t).inputFiles()
        )
        mark = hashlib.sha256("\n".join(files).encode()).hexdigest()[:16]
        self.root = f"{shared_dir(spark)}/cashlens-{spark.sparkContext.applicationId}-{mark}"
        self._tables = {}

    def once(self, name, build):
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    def stored(self, name, build):
        """A derived table written once and read by every report that needs it."""

        def write():
            df, path = build(), f"{self.root}/marts/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        return self.once(f"stored {name}", write)

    @property
    def ledger(self):
        return self.once("ledger", self._write_ledger)

    @property
    def customers(self):
        return self.once("customers", lambda: build_customers(self.spark, self.sf_dir))

    @property
    def merchants(self):
        return self.once("merchants", lambda: build_merchants(self.spark, self.sf_dir))

    def scratch(self, name):
        """A fresh shared path for one run's output."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def table(self, name):
        return read_table(self.spark, self.sf_dir, name)

    def ledger_between(self, start=None, end=None):
        """Ledger read for a date range, down to the month partitions it needs."""
        self.ledger
        return read_ledger(self.spark, f"{self.root}/ledger", start, end)

    @property
    def fx_ledger(self):
        """The ledger in several currencies."""
        return self.once("fx_ledger", lambda: self._write_ledger("fx_ledger", multi_currency=True))

    def copied_ledger(self, name):
        """The path of a copy of the ledger for one run."""
        self.ledger
        path = self.scratch(name)
        copy_ledger(self.spark, f"{self.root}/ledger", path)
        return path

    def _write_ledger(self, name="ledger", multi_currency=False):
        path = f"{self.root}/{name}"
        # wide projections outgrow what the JVM compiles as one method; a session of its own lets
        # this job split them without touching the caller's settings
        builder = self.spark.newSession()
        builder.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        write_ledger(build_ledger(builder, self.sf_dir, multi_currency, arranged=True), path, arranged=True)
        return read_ledger(self.spark, path)


_open = {}


def workspace(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]
