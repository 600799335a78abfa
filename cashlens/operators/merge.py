"""Keyed merges."""

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions.rules import with_usd
from ..schema import GENERATED_COLUMNS, LEDGER, LEDGER_PARTITIONS, LEDGER_STORED
from ..session import unsorted_writes
from ..sources.ledger import conform_to_schema
from ..sources.tablelog import ConcurrentChange, TableLog


def one_per_key(rows, keys, order_by, pick=F.max):
    """The last (or with F.min the first) row of each key by the order columns.

    A plain aggregate rather than a ranking window: copies of a key shrink to one row per task
    before the shuffle. Equal order values fall to the remaining columns, so the pick is stable.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(c).alias(f"_order_{i}") for i, c in enumerate(order_by)]
    picked = rows.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def merge_upsert(target, updates, keys, update_cols=None, order_by=("ingested_at",)):
    """Update matching rows, insert the others.

    ``update_cols`` lists the columns a match overwrites; None means all but the keys. Of several
    updates for one key the last by ``order_by`` wins. The target is only streamed through a join
    with the updates, and the keys of its hits decide what is new, so a small update set moves
    no target rows.
    """
    keys = list(keys)
    latest = one_per_key(updates, keys, [c for c in order_by if c in updates.columns])
    hits = target.select(*keys).join(latest.select(*keys), keys, "left_semi")
    fresh = latest.join(hits, keys, "left_anti")
    return with_new(overwritten(target, latest, keys, update_cols), fresh)


def overwritten(target, latest, keys, update_cols=None):
    """Matching rows take the update columns of ``latest``, which has one row per key."""
    changed = [c for c in (update_cols or latest.columns) if c in latest.columns and c not in keys]
    carried = latest.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    return target.join(carried, keys, "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in target.columns
        ]
    )


def with_new(target, fresh):
    return target.unionByName(fresh.select([c for c in target.columns if c in fresh.columns]), allowMissingColumns=True)


def merge_insert_only(target, updates, keys, order_by=()):
    """Insert rows with new keys, leave existing rows alone; the first copy of a new key wins."""
    keys = list(keys)
    first = one_per_key(updates, keys, [c for c in order_by if c in updates.columns], pick=F.min)
    hits = target.select(*keys).join(first.select(*keys), keys, "left_semi")
    return target.unionByName(first.join(hits, keys, "left_anti"), allowMissingColumns=True)


def copy_tables(sources, targets, keys):
    """Insert-only copy of several tables: name -> (merged table, one-row count of source rows)."""
    return {
        name: (
            merge_insert_only(targets[name], df, keys[name]),
            df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")),
        )
        for name, df in sources.items()
    }


def copied_counts(sources):
    """Rows offered per copied table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in sources.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def merge_ledger(ledger, updates, order_by=("ingested_at",)):
    """Ledger upsert: a known transaction takes nine columns, generated columns follow."""
    stored = ledger.drop(*GENERATED_COLUMNS)
    return with_usd(
        merge_upsert(stored, updates, ["transaction_id"], fv.MERGE_UPDATE_COLUMNS, order_by)
    )


def upsert_table(spark, path, updates, keys, partitions, order_by=("ingested_at",)):
    """Full-column upsert of rows into a written, partitioned table, rewriting only the partitions they touch.

    The merged partitions are written once, beside the table, and then moved into place (see
    ``TableLog``): a cut-short merge is completed by the next one, a second writer is refused, and a
    repeated call gives the same table. A key must not change its partition. Returns the touched
    partitions, or None for a new table.
    """
    latest = one_per_key(updates, list(keys), [c for c in order_by if c in updates.columns])

    def locate(rows, table):
        hits = table.join(rows.select(*keys), keys, "left_semi").select(*dict.fromkeys([*keys, *partitions]))
        return hits, rows.join(hits.select(*keys), keys, "left_anti")

    def merge(target, rows, fresh):
        return with_new(overwritten(target, rows, keys), fresh)

    return _change(TableLog(spark, path), None, latest, list(keys), partitions, merge, locate)


#: Average bytes of a touched file from which rows without an update stay apart, and the bits that tell them.
APART_BYTES, SLOTS = 4 << 20, 1 << 26


def _marked(rows, updates, keys):
    """Rows with ``_marked``: false only where no update has the key.

    The hashes of the updated keys set bits of a map of ``SLOTS`` bits, at most 8 MB whatever the number
    of updates, which every task gets; other keys that share a bit are marked too. Nothing is shuffled but
    the keys of the updates.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    word, bit = F.shiftright(slot, 6).alias("_word"), F.pmod(slot, F.lit(64)).cast("int")
    words = updates.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    words = words.groupBy("_word").agg(F.bit_or("bits").alias("_bits"))
    seen = F.call_function("getbit", F.col("_bits"), F.col("_bit")) == 1
    return (
        rows.withColumns({"_word": word, "_bit": bit})
        .join(F.broadcast(words), "_word", "left")
        .withColumn("_marked", F.coalesce(seen, F.lit(False)))
        .drop("_word", "_bit", "_bits")
    )


def _change(log, state, updates, keys, partitions, merge, locate, more=None):
    """The steps that merges into written tables share. updates: one row per key.

    Where the touched files are large, rows whose keys no update has go from file to file as they are, and
    only the others are joined and shuffled. Small files are merged and laid out anew as a whole.

    ``locate(rows, table)`` gives the known keys with their partitions, and the new rows; ``merge(target,
    rows, fresh)`` the touched partitions; ``more(staging, rows, before, fresh)`` may stage further folders
    and gives their moves and what the state takes on.
    """
    spark, path = updates.sparkSession, log.path
    state, staging = log.state() if state is None else state, log.staging()
    try:
        rows, new = _kept(updates, f"{staging}/updates"), not log.has_rows()
        if new:
            fresh, touched, before = rows, [], rows.limit(0)
        else:
            kinds = {f.name: f.dataType for f in rows.schema if f.name in partitions}
            table = _read_partitions(spark, path, kinds)
            hits, fresh = locate(rows, table)
            hits, fresh = _kept(hits, f"{staging}/hits"), _kept(fresh, f"{staging}/fresh")
            # the list of touched partitions is calendar-sized (months or days), whatever the row counts
            touched = hits.select(*partitions).unionByName(fresh.select(*partitions)).distinct().collect()
            if not touched:
                log.delete(staging)
                return []
            inside = reduce(
                lambda a, b: a | b,
                [reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(row[p])) for p in partitions]) for row in touched],
            )
            before = table.filter(inside)
        apart = not new and log.average_size(_folders(path, partitions, touched)) >= APART_BYTES
        if apart:
            marked = _marked(before, rows, keys).filter("_marked").drop("_marked")
            before = _kept(marked, f"{staging}/before")
        write_partitions(merge(before, rows, fresh), f"{staging}/merged", partitions)
        moves, after = more(staging, rows, before, fresh) if more else ([], {})
        if apart:
            own = unsorted_writes(spark)
            rows = own.read.schema(rows.schema).parquet(f"{staging}/updates")
            rest = _marked(_read_partitions(own, path, kinds).filter(inside), rows, keys).filter("NOT _marked")
            rest = merge(rest.drop("_marked"), rows.limit(0), rows.limit(0))
            _partitioned(rest, partitions).mode("append").parquet(f"{staging}/merged")
        moves = moves + log.moves_of(f"{staging}/merged", path, len(partitions))
        log.commit(state.get("version", 0), staging, moves, **{**state, **after})
    except BaseException as error:
        # a change whose moves have begun keeps its staging: the next one completes it
        if log.begun(staging):
            raise
        log.delete(staging)
        if isinstance(error, Exception) and log.state().get("version", 0) != state.get("version", 0):
            # what it was reading may have gone
            raise ConcurrentChange(f"{path} was changed meanwhile") from error
        raise
    return None if new else [tuple(row) for row in touched]


def _kept(rows, path):
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _read_partitions(spark, path, kinds):
    """A partitioned table whose partition columns keep their types, however few values they hold."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
    return spark.read.schema(schema).parquet(path)


def write_partitions(df, path, partitions):
    (
        _partitioned(df.hint("rebalance", *partitions), partitions)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def _partitioned(df, partitions):
    return df.write.partitionBy(*partitions).option("compression", "zstd")


def _folders(path, partitions, rows):
    """The folders of partitions whose values need no escaping; others are not found."""
    return ["/".join([path, *(f"{p}={row[p]}" for p in partitions)]) for row in rows]


# --- merges into the written ledger -----------------------------------------------------------
KEY = "transaction_id"
#: Keys of an index bucket at about which it is split, and small files in one that are made one.
BUCKET_KEYS, BUCKET_FILES = 1 << 20, 16
#: Versions whose changes are kept for tables that follow the ledger.
KEPT_CHANGES = 1000
#: What the tables that follow the ledger need to know of a changed row.
FOLLOWED = ["occurred_at", "source", "status", "amount", "fx_rate", "net_amount", "basis", "posted_date"]


def bucket_of(key, n):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")


def _index_path(log, index):
    return f"{log.root}/keys-{index}"


def build_index(spark, path):
    """Index of a written ledger: which month holds which key, dealt to buckets by the key's hash.

    The one scan of all keys. It runs for a ledger without an index, for one that something else wrote
    to, and when buckets have grown to four times their size. A row of the index is a key and its month.
    """
    log = TableLog(spark, path)
    state, staging = log.state(), log.staging()
    ledger = spark.read.schema(LEDGER).parquet(path)
    rows = ledger.select(KEY, *LEDGER_PARTITIONS)
    n, index, version = rows.count(), uuid.uuid4().hex, state.get("version", 0)
    buckets = 1 << max(0, (n // BUCKET_KEYS).bit_length())
    _write_keys(rows.withColumn("bucket", bucket_of(KEY, buckets)), f"{staging}/keys")
    _changes(ledger.limit(0), ledger.limit(0)).write.parquet(f"{staging}/changes")
    # a folder of its own, so that a writer which reads the former index is not disturbed before it is refused
    moves = [(f"{staging}/keys", _index_path(log, index)), (f"{staging}/changes", f"{log.root}/changes/{version + 1}")]
    log.commit(version, staging, moves, **{**state, "index": index, "buckets": buckets, "keys": n})
    if state.get("index"):
        log.delete(_index_path(log, state["index"]))
    return log.state()


def _write_keys(rows, path):
    (
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", KEY)
        .write.partitionBy("bucket")
        .option("compression", "zstd")
        .option(f"parquet.bloom.filter.enabled#{KEY}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{KEY}", str(BUCKET_KEYS))
        .parquet(path)
    )


def _index(spark, log, state):
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER if f.name in LEDGER_PARTITIONS)
    return spark.read.schema(f"{KEY} string, {kinds}, bucket int").parquet(_index_path(log, state["index"]))


def known_months(spark, log, state, keys):
    """key and month of those of the given keys that the ledger holds, from the buckets they fall into.

    Up to BLOOM_KEYS keys are also named to the scan, which skips row groups by their ranges and Bloom filters.
    """
    wanted = keys.select(KEY, bucket_of(KEY, state["buckets"]))
    # one number per bucket, of which there is one for every BUCKET_KEYS keys of the ledger
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
    index = _index(spark, log, state)
    if len(buckets) < state["buckets"]:
        index = index.filter(F.col("bucket").isin(buckets))
    few = [r[0] for r in wanted.select(KEY).limit(BLOOM_KEYS + 1).collect()]
    if few and len(few) <= BLOOM_KEYS:
        # as equalities: a long IN list would reach the scan as a range only
        index = index.filter(reduce(lambda a, b: a | b, [F.col(KEY) == k for k in few]))
    return index.join(wanted.select(KEY), KEY, "left_semi").select(KEY, *LEDGER_PARTITIONS)


#: Keys that a look-up names one by one.
BLOOM_KEYS = 100


def _indexed(spark, path):
    """The state of a ledger whose index is complete."""
    log = TableLog(spark, path)
    state = log.state()
    if not log.has_rows():
        return state
    stale = not state.get("index") or state.get("size") != log.size()
    if stale or state["keys"] > 4 * state["buckets"] * BUCKET_KEYS:
        if stale and state.get("index"):
            # whatever else wrote to the ledger left no changes behind: what follows it starts anew
            state = {**state, "followed_from": state["version"] + 1}
            log.commit(state["version"], log.staging(), [], **state)
        state = build_index(spark, path)
    return state


def _stage_keys(log, staging, state, fresh):
    """Moves that bring the index up to date with new rows."""
    spark = fresh.sparkSession
    index, buckets = state.get("index") or uuid.uuid4().hex, state.get("buckets") or 1
    rows = fresh.select(KEY, *LEDGER_PARTITIONS, bucket_of(KEY, buckets))
    n = fresh.count()
    if not state.get("index"):
        buckets = 1 << max(0, (n // BUCKET_KEYS).bit_length())
        rows = fresh.select(KEY, *LEDGER_PARTITIONS, bucket_of(KEY, buckets))
    after = {"index": index, "buckets": buckets, "keys": state.get("keys", 0) + n}
    if not n:
        return [], after
    here = _index_path(log, index)
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]
    full = [b for b in touched if len(log.names(f"{here}/bucket={b}")) >= BUCKET_FILES]
    moves = []
    if full:
        # many small files become one again
        again = _index(spark, log, state).filter(F.col("bucket").isin(full))
        _write_keys(again.unionByName(rows.filter(F.col("bucket").isin(full))), f"{staging}/buckets")
        moves += log.moves_of(f"{staging}/buckets", here, 1)
        rows = rows.filter(~F.col("bucket").isin(full))
    _write_keys(rows, f"{staging}/keys")
    return moves + log.moves_of(f"{staging}/keys", here, 2), after


def _changes(before, after):
    """Every key of ``after`` with the followed columns before and after, where they differ or the row is new."""

    def side(frame, name):
        return frame.select(KEY, F.struct(*FOLLOWED).alias(name))

    both = side(after, "after").join(side(before, "before"), KEY, "left")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def _merge_into_ledger(spark, path, rows, merge, only_known=False):
    """Merge rows, one per key, into a written ledger through its key index."""
    state, log = _indexed(spark, path), TableLog(spark, path)

    def locate(rows, _table):
        hits = known_months(spark, log, state, rows)
        return hits, rows.limit(0) if only_known else rows.join(hits.select(KEY), KEY, "left_anti")

    def more(staging, rows, before, fresh):
        moves, after = _stage_keys(log, staging, state, fresh)
        merged, keys = spark.read.schema(LEDGER).parquet(f"{staging}/merged"), rows.select(KEY)
        changed = _changes(before.join(keys, KEY, "left_semi"), merged.join(keys, KEY, "left_semi"))
        changed.write.parquet(f"{staging}/changes")
        version = state.get("version", 0) + 1
        log.delete(f"{log.root}/changes/{version - KEPT_CHANGES}")
        return [*moves, (f"{staging}/changes", f"{log.root}/changes/{version}")], after

    return _change(log, state, rows, [KEY], LEDGER_PARTITIONS, merge, locate, more)


def upsert_ledger_path(spark, path, updates, order_by=("ingested_at",)):
    """Merge staged rows into a written ledger; returns the months it touched, None for a new one.

    An existing row keeps its month because a merge never changes the event time. The months are found
    through the key index, so what a merge reads hangs on its rows and on the months it rewrites, not on
    the size of the ledger.
    """
    rows = conform_to_schema(one_per_key(updates, [KEY], list(order_by)))

    def merge(target, latest, fresh):
        stored = target.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_STORED])
        return with_usd(with_new(overwritten(stored, latest, [KEY], fv.MERGE_UPDATE_COLUMNS), fresh))

    return _merge_into_ledger(spark, path, rows, merge)


def mark_removed_path(spark, path, ids):
    """Bank rows named by their feed ids become ``removed`` in a written ledger; unknown ids change nothing."""
    gone = ids.select(F.concat(F.lit("plaid_"), "transaction_id").alias(KEY)).where(F.col(KEY).isNotNull()).distinct()
    # the partition columns only give these rows the form of new ones, of which there are none
    kinds = {f.name: f.dataType for f in LEDGER}
    rows = gone.select(KEY, *[F.lit(None).cast(kinds[p]).alias(p) for p in LEDGER_PARTITIONS])

    def merge(target, removed, _fresh):
        hits = removed.select(KEY, F.lit(True).alias("_hit"))
        marked = F.when(F.col("_hit"), "removed").otherwise(F.col("status"))
        return target.join(hits, KEY, "left").withColumn("status", marked).drop("_hit")

    if not TableLog(spark, path).has_rows():
        return []
    return _merge_into_ledger(spark, path, rows, merge, only_known=True)


def ledger_state(spark, path):
    """The ledger's version and what else its log says."""
    return TableLog(spark, path).state()


def ledger_changes(spark, path, version):
    """transaction_id with the followed columns before and after, of one version; None if they are not (all) kept."""
    log = TableLog(spark, path)
    folder = f"{log.root}/changes/{version}"
    if not log.exists(folder):
        return None
    found = spark.read.parquet(folder)
    return found if set(FOLLOWED) <= set(found.schema["after"].dataType.names) else None


def count_by_source(ledger, source):
    """Rows of one source, the control count after a write."""
    return ledger.filter(F.col("source") == source).agg(
        F.lit(source).alias("source"), F.count(F.lit(1)).alias("row_count")
    )


def mark_removed(ledger, ids):
    """Bank rows named by their feed id become ``removed``; the rows stay in the ledger."""
    gone = ids.select(
        F.concat(F.lit("plaid_"), F.col("transaction_id")).alias("transaction_id")
    ).distinct()
    hits = gone.withColumn("_hit", F.lit(True))
    return ledger.join(hits, "transaction_id", "left").select(
        [
            F.when(F.col("_hit"), "removed").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
            for c in ledger.columns
        ]
    )
