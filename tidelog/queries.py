"""Queries over the driver's tables, one for each operator, and the DuckDB SQL that gives the same rows.

``events`` is the workload (errors delete, views get, the rest put); ``orders`` gives runs of unique keys.
"""

from __future__ import annotations

import atexit
import io
import json
import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import store as facade
from tidelog.cli import main
from tidelog.config import StoreConfig
from tidelog.contracts import KeyValueStore, Maintenance
from tidelog.engine import MemoryBuffer
from tidelog.errors import MalformedOperationError, StoreError
from tidelog.functions.bloom import filter_blocks, filter_size, might_contain, might_contain_many, positions
from tidelog.functions.parsing import PARSERS, parser_for
from tidelog.jobs import CompactionJobs
from tidelog.operators.lookup import consulted, get_many, get_many_or_fail, has_many
from tidelog.operators.merge import buffered, latest_wins, merge_runs, run_metadata
from tidelog.operators.replay import asof_reads, mutations, reads_map, sequenced, summary
from tidelog.plans.compaction import SizeTieredPolicy, never
from tidelog.registry import StoreRegistry
from tidelog.schema import ENTRY
from tidelog.sources.files import Files
from tidelog.sources.operations import ArraySource, TextSource
from tidelog.sources.runs import FileRunStore, Run, sequential_ids
from tidelog.sources.wal import MemoryWal
from tidelog.streaming.ingest import event_operations, ingest_stream
from tidelog.trace import BufferSealed, Collecting, Logging, RunsMerged, TraceType, composite, structural

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The workload in SQL.
OPS = """ops as (select event_id as pos, concat('user:', cast(user_id as varchar)) as key,
  case event_type when 'error' then 'delete' when 'view' then 'get' else 'put' end as op,
  case when event_type in ('error', 'view') then null else concat(event_type, ':', cast(event_id as varchar)) end as value from events),
muts as (select key, value, pos, row_number() over (order by pos) as sequence from ops where op <> 'get'),
newest as (select key, value, sequence, pos from (select *, row_number() over (partition by key order by sequence desc) as r from muts) where r = 1),
live as (select key, value from newest where value is not null)"""
ORDER_RUNS = """entries as (select concat('order:', lpad(cast(o_orderkey as varchar), 9, '0')) as key, row_number() over (order by o_orderkey) as sequence from orders),
runs as (select cast(floor((sequence - 1) / 1000) as bigint) as run, count(*) as count, min(key) as min_key, max(key) as max_key, max(sequence) as max_sequence from entries group by 1)"""


def query(sql: str | None = None) -> Callable:
    """Register a query and its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_operations(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workload's mutations with their sequence numbers."""
    return sequenced(mutations(workload(spark, sf_dir)).select("pos", "key", "value"), "pos")


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("key"), F.lit("").alias("value"))
    return sequenced(keys, "o_orderkey")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares, or a local one where no cluster names any; it goes with this process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    root = f"{shared.rstrip('/')}/tidelog-stores-{uuid.uuid4().hex}"
    files = Files(spark)

    def remove() -> None:
        try:
            files.delete(root)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(remove)
    return root


def stores(spark: SparkSession, listener=None, **settings) -> StoreRegistry:
    """A registry with two stores of the same settings."""
    common = {"sync_wal": False} | settings
    return StoreRegistry(spark, shared_folder(spark), {"primary": dict(common), "archive": dict(common)}, listener=listener)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small bulk of changes."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("key"), F.lit("x").alias("value"))


# -- merges


@query(f"with {OPS} select key, value, sequence from newest")
def merge_keep(spark, sf_dir):
    """The newest version of every key, tombstones included."""
    return latest_wins(versions(spark, sf_dir).select("key", "value", "sequence"))


@query(f"with {OPS} select key, value, sequence from newest where value is not null")
def merge_drop(spark, sf_dir):
    """The newest version of every live key."""
    return latest_wins(versions(spark, sf_dir).select("key", "value", "sequence"), drop_tombstones=True)


@query(f"with {OPS} select key, sequence from newest where value is null")
def tombstones(spark, sf_dir):
    """Keys whose newest version is a delete."""
    return latest_wins(versions(spark, sf_dir).select("key", "value", "sequence")).where("value is null").select("key", "sequence")


@query(f"with {OPS} select key, concat(value, '/new') as value, sequence from newest where value is not null")
def merge_tie(spark, sf_dir):
    """Two runs with the same sequence numbers: the newer run's values stay."""
    entries = versions(spark, sf_dir).select("key", "value", "sequence")
    return merge_runs([entries.withColumn("value", F.concat("value", F.lit("/new"))), entries.withColumn("value", F.concat("value", F.lit("/old")))], drop_tombstones=True)


@query(f"with {OPS} select key, value, sequence from newest")
def merge_two_stage(spark, sf_dir):
    """Merging merged runs gives what merging all runs at once gives."""
    entries = versions(spark, sf_dir).select("key", "value", "sequence")
    thirds = [entries.where(F.col("sequence") % 3 == i) for i in range(3)]
    return merge_runs([merge_runs(thirds[:2]), thirds[2]])


@query(f"with {OPS} select key, value, pos from newest")
def buffer_contents(spark, sf_dir):
    """What an unbounded buffer holds: the last to arrive for each key."""
    return buffered(mutations(workload(spark, sf_dir)).select("pos", "key", "value")).select("key", "value", "pos")


# -- workloads


_ASOF = f"""with {OPS},
last as (select pos, key, op, max(case when op <> 'get' then pos end) over (partition by key order by pos rows between unbounded preceding and 1 preceding) as before from ops)
select l.pos, l.key, m.value from last l left join muts m on m.pos = l.before where l.op = 'get'"""


@query(_ASOF)
def asof_get(spark, sf_dir):
    """Each get's answer as of its position."""
    return asof_reads(workload(spark, sf_dir))


@query(_ASOF + " and l.pos >= (select max(event_id) / 2 from events)")
def asof_get_over_base(spark, sf_dir):
    """The second half of the workload on the store that the first half leaves."""
    ops = workload(spark, sf_dir)
    half = ops.agg((F.max("pos") / 2).alias("half")).first()["half"]
    first = mutations(ops.where(F.col("pos") < half)).select("key", "value", F.col("pos").alias("sequence"))
    return asof_reads(ops.where(F.col("pos") >= half), latest_wins(first, True).select("key", "value"))


@query(f"with {OPS} select sum(case when op = 'put' then 1 else 0 end)::bigint as puts, sum(case when op = 'delete' then 1 else 0 end)::bigint as deletes, sum(case when op = 'get' then 1 else 0 end)::bigint as gets, count(*) as total from ops")
def run_summary(spark, sf_dir):
    """Operations by kind."""
    return summary(workload(spark, sf_dir))


@query(f"""select key, value from (select *, row_number() over (partition by key order by pos desc) as r from ({_ASOF})) where r = 1""")
def reads_of_workload(spark, sf_dir):
    """The last answer that each key's gets had."""
    return reads_map(asof_reads(workload(spark, sf_dir)))


# -- lookups


def asked_keys(spark, sf_dir):
    """Keys of customers, some of which the store has."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))


_ASKED = "asked as (select distinct concat('user:', cast(c_custkey as varchar)) as key from customer)"


def live_view(spark, sf_dir):
    return merge_drop(spark, sf_dir).select("key", "value")


@query(f"with {OPS}, {_ASKED} select a.key, l.value from asked a left join live l on l.key = a.key")
def batch_get(spark, sf_dir):
    """The value of each asked key, null where there is none."""
    return get_many(live_view(spark, sf_dir), asked_keys(spark, sf_dir))


@query(f"with {OPS}, {_ASKED} select a.key from asked a where a.key in (select key from live)")
def batch_has(spark, sf_dir):
    """The asked keys that are live."""
    return has_many(live_view(spark, sf_dir), asked_keys(spark, sf_dir))


@query(f"with {OPS} select key, value from live")
def batch_get_or_fail(spark, sf_dir):
    """Values of keys that are all there."""
    view = live_view(spark, sf_dir)
    return get_many_or_fail(view, view.select("key"))


# -- runs


def order_runs(spark, sf_dir):
    entries = order_entries(spark, sf_dir).withColumn("run", F.floor((F.col("sequence") - 1) / 1000).cast("long"))
    return run_metadata(entries, "run")


@query(f"with {ORDER_RUNS} select * from runs")
def runs_meta(spark, sf_dir):
    """Metadata of the runs that 1000 orders each make."""
    return order_runs(spark, sf_dir)


_PROBES = "probes as (select distinct concat('order:', lpad(cast(c_custkey * 7 as varchar), 9, '0')) as key from customer)"


@query(f"with {ORDER_RUNS}, {_PROBES} select p.key, count(r.run) as runs from probes p left join runs r on p.key between r.min_key and r.max_key group by 1")
def range_prune(spark, sf_dir):
    """How many runs' ranges hold each asked key."""
    probes = table(spark, sf_dir, "customer").select(F.concat(F.lit("order:"), F.lpad((F.col("c_custkey") * 7).cast("string"), 9, "0")).alias("key"))
    return consulted(order_runs(spark, sf_dir).withColumn("run_id", F.col("run").cast("string")), probes)


# -- filters


@query(f"with {ORDER_RUNS} select key, true as maybe from entries")
def bloom_filter(spark, sf_dir):
    """The test of every order's key and of as many keys that aren't there against a filter of all orders: what is there is let through, and of the rest
    fewer than a tenth, which are left out here; more than that is an error."""
    entries = order_entries(spark, sf_dir).select("key")
    n = table(spark, sf_dir, "orders").count()
    size = filter_size(n, 10)
    probes = entries.select("key", F.lit(True).alias("there")).union(entries.select(F.concat(F.lit("absent-"), "key"), F.lit(False)))
    seen = might_contain_many(filter_blocks(entries, size, 7), probes, size, 7)
    wrong = seen.agg(F.count_if(F.col("maybe") & ~F.col("there")).alias("w"))
    many = F.when(F.col("w") * 10 >= n, F.raise_error(F.lit("the filter lets too many keys through"))).otherwise(F.lit(True))
    return seen.where("there").select("key", "maybe").crossJoin(F.broadcast(wrong.select(many.alias("few")))).where("few").drop("few")


@query("select concat('nation-', cast(n_nationkey as varchar)) as key, cast(7 as bigint) as bits, true as inside, true as found from nation")
def bloom_positions(spark, sf_dir):
    """Positions of keys: seven of them, inside the filter, and found by the test of the same expression."""
    key = F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))
    p = table(spark, sf_dir, "nation").select(key.alias("key"), positions(key, 250, 7).alias("p"))
    return p.select("key", F.size("p").cast("long").alias("bits"), F.forall("p", lambda x: (x >= 0) & (x < 250)).alias("inside"), might_contain(F.col("p"), F.col("key"), 250, 7).alias("found"))


@query(f"with {ORDER_RUNS} select run, greatest(64, count * 10) as bits, cast(7 as bigint) as hashes from runs")
def bloom_sizing(spark, sf_dir):
    """Size of the filter of each run of orders, and hashes for ten bits a key."""
    rows = [(r["run"], filter_size(r["count"], 10), StoreConfig(bits_per_key=10).hashes) for r in order_runs(spark, sf_dir).collect()]  # a row for each run
    return spark.createDataFrame(rows, "run long, bits long, hashes long")


# -- parsers


def _parsed(lines: DataFrame, format: str) -> DataFrame:
    return lines.select("pos", PARSERS[format](F.col("line")).alias("p")).where("not p.skip").select("pos", "p.op", "p.key", "p.value", "p.error")


@query("""select event_id as pos, case event_id % 5 when 4 then 'get' else 'put' end as op, concat(' k', cast(user_id as varchar)) as key,
case event_id % 5 when 0 then event_type when 1 then cast(event_id as varchar) when 2 then '1' when 3 then '' end as value, cast(null as varchar) as error from events""")
def parse_json(spark, sf_dir):
    """JSON lines with text, numbers, true and false as values; keys keep their spaces, types don't."""
    n = F.col("event_id") % 5
    value = F.when(n == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(n == 1, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).when(n == 2, "true").when(n == 3, "false").otherwise('{"a": 1}')
    op = F.when(n == 4, " GET ").otherwise("Put")
    line = F.concat(F.lit('  {"type": "'), op, F.lit('", "key": " k'), F.col("user_id").cast("string"), F.lit('", "value": '), value, F.lit("}"))
    return _parsed(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), line.alias("line")), "jsonl")


def _separated(spark, sf_dir, sep):
    n = F.col("event_id") % 4
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit(f'{sep}""x"""'))
    op = F.when(n == 3, "delete").when(n == 2, "get").otherwise(" PUT ")
    line = F.concat(op, F.lit(f"{sep} k"), F.col("user_id").cast("string"), F.lit(f" {sep}"), F.when(n == 0, quoted).when(n == 1, F.col("event_type")).otherwise(""), F.lit("\r"))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), line.alias("line"))
    return lines.union(spark.createDataFrame([(-1, f"type{sep}key{sep}value"), (-2, "   ")], "pos long, line string"))


def _separated_sql(sep):
    return f"""select event_id as pos, case event_id % 4 when 3 then 'delete' when 2 then 'get' else 'put' end as op, concat('k', cast(user_id as varchar)) as key,
case event_id % 4 when 0 then concat(event_type, {sep}, '"x"') when 1 then event_type end as value, cast(null as varchar) as error from events"""


@query(_separated_sql("','"))
def parse_csv(spark, sf_dir):
    """Comma-separated lines with quotes, a header and a blank line."""
    return _parsed(_separated(spark, sf_dir, ","), "csv")


@query(_separated_sql("chr(9)"))
def parse_tsv(spark, sf_dir):
    """The same with tabs."""
    return _parsed(_separated(spark, sf_dir, "\t"), "tsv")


@query("""select event_id as pos, case event_id % 6 when 0 then 'not valid JSON' when 1 then 'type and key are needed' when 2 then 'unknown operation upsert' when 3 then 'the key is empty' when 4 then 'a put needs a value' end as error from events""")
def parse_errors(spark, sf_dir):
    """What is wrong with each kind of bad line."""
    n = F.col("event_id") % 6
    line = F.when(n == 0, "{not json").when(n == 1, '{"type": "put"}').when(n == 2, '{"type": "upsert", "key": "a"}').when(n == 3, '{"type": "get", "key": ""}').when(n == 4, '{"type": "put", "key": "a", "value": {"b": 1}}').otherwise('{"type": "delete", "key": "a"}')
    return _parsed(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), line.alias("line")), "json").select("pos", "error")


# -- the engine


@query(f"with {OPS} select key, value from live")
def engine_view(spark, sf_dir):
    """The live view after four ingested batches and the compactions that they set off."""
    engine = stores(spark, max_runs_per_level=2, bottom_level=1).store()
    changes = mutations(workload(spark, sf_dir)).select("pos", "key", "value")
    step = changes.agg(F.max("pos")).first()[0] // 4 + 1
    for i in range(4):
        engine.ingest(changes.where(F.col("pos").between(i * step, (i + 1) * step - 1)))
    return engine.view()


@query(f"with {OPS} select (select count(*) from muts) as sequence, cast(0 as bigint) as buffered, cast(1000 as bigint) as buffer_capacity, cast(1 as bigint) as runs, cast(0 as bigint) as wal_entries, cast(1 as integer) as levels, cast(1 as bigint) as read_amplification, '0:1' as per_level")
def engine_statistics(spark, sf_dir):
    """Statistics after one ingested batch."""
    engine = stores(spark).store()
    engine.ingest(mutations(workload(spark, sf_dir)).select("pos", "key", "value"))
    per_level = F.array_join(F.transform(F.map_entries("runs_per_level"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return engine.statistics().table(spark).select("sequence", "buffered", "buffer_capacity", "runs", "wal_entries", "levels", "read_amplification", per_level.alias("per_level"))


@query(f"with {OPS} select key, value, sequence from newest")
def wal_recovery(spark, sf_dir):
    """All mutations of events, one by one, read by another engine after a restart: from the log and from sealed runs."""
    every = versions(spark, sf_dir)
    keys = every.select("key").distinct().count()
    registry = stores(spark, buffer_capacity=max(2, keys * 4 // 5))  # so that some are sealed and some are in the log
    engine = registry.store()
    for r in every.orderBy("sequence").toLocalIterator():  # a partition at a time
        engine.put(r["key"], r["value"]) if r["value"] is not None else engine.delete(r["key"])
    registry.purge()
    return registry.store().entries()


@query(f"with {OPS} select key, value from live")
def stream_view(spark, sf_dir):
    """The live view after the workload came in as a stream."""
    registry = stores(spark)
    engine = registry.store()
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    ingest_stream(engine, event_operations(events), f"{registry.root}/stream-checkpoint", "events").awaitTermination()
    return engine.view()


@query(f"with {OPS} select key, value from live")
def import_view(spark, sf_dir):
    """The live view after the workload was imported from JSON lines."""
    registry = stores(spark)
    path = f"{registry.root}/ops.jsonl"
    lines = workload(spark, sf_dir).orderBy("pos").select(F.to_json(F.struct(F.col("op").alias("type"), "key", "value")).alias("value"))
    lines.coalesce(1).write.text(path)
    registry.store().replay(TextSource(spark, path, "jsonl", registry.root).operations())
    return registry.view()


@query(f"with {OPS} select 'primary' as store, key, value from live union all select 'archive', key, concat('old ', value) from live")
def store_isolation(spark, sf_dir):
    """The same keys in two stores."""
    registry, live = stores(spark), live_view(spark, sf_dir)
    out = []
    for name, value in (("primary", F.col("value")), ("archive", F.concat(F.lit("old "), F.col("value")))):
        registry.store(name).ingest(live.select(F.monotonically_increasing_id().alias("pos"), "key", value.alias("value")))
        out.append(registry.store(name).view().select(F.lit(name).alias("store"), "key", "value"))
    return out[0].union(out[1])


@query("""select concat('nation:', n_name) as key, cast(n_nationkey as varchar) as value from nation union all select concat('region:', r_name), null from region""")
def point_get(spark, sf_dir):
    """Reads of single keys, one by one: every nation, which is there, and every region, which isn't."""
    engine = stores(spark).store()
    engine.ingest(nations(spark, sf_dir).select("pos", F.concat(F.lit("nation:"), "key").alias("key"), F.col("pos").cast("string").alias("value")))
    asked = [f"nation:{r['n_name']}" for r in table(spark, sf_dir, "nation").collect()] + [f"region:{r['r_name']}" for r in table(spark, sf_dir, "region").collect()]  # fixed tables
    return spark.createDataFrame([(k, engine.get(k)) for k in asked], "key string, value string")


@query(f"with {OPS} select key, value from live where key >= 'user:10' and key < 'user:12'")
def range_scan(spark, sf_dir):
    """Live keys in a range, an extension."""
    engine = stores(spark).store()
    engine.ingest(mutations(workload(spark, sf_dir)).select("pos", "key", "value"))
    return engine.scan("user:10", "user:12")


@query("""select cast(a.i as bigint) as l0, cast(b.i as bigint) as l1, cast(c.i as bigint) as l2,
  cast(case when a.i >= 3 then 0 when b.i >= 3 then 1 when c.i >= 3 then 2 end as bigint) as source,
  cast(case when a.i >= 3 then 1 when b.i >= 3 then 2 when c.i >= 3 then 2 end as bigint) as target,
  case when a.i >= 3 or b.i >= 3 then false when c.i >= 3 then true end as drops
from range(0, 5) a(i), range(0, 5) b(i), range(0, 5) c(i)""")
def compaction_policy(spark, sf_dir):
    """What the size-tiered policy decides for every filling of three levels."""
    policy, rows = SizeTieredPolicy(3, 2), []
    for a in range(5):
        for b in range(5):
            for c in range(5):
                levels = {n: [Run(f"{n}-{i}", n, i, 1, "a", "b", 1) for i in range(k)] for n, k in enumerate((a, b, c)) if k}
                plan = policy(levels)
                rows.append((a, b, c, *((plan.inputs[0].level, plan.target_level, plan.drop_tombstones) if plan else (None, None, None))))
    return spark.createDataFrame(rows, "l0 long, l1 long, l2 long, source long, target long, drops boolean")


@query("select n_name as key, true as there from nation")
def prune_orphans(spark, sf_dir):
    """Runs that no manifest names are not read, and are removed; what is left holds every nation."""
    engine = stores(spark, prune_grace=0.0).store()
    engine.ingest(nations(spark, sf_dir))
    engine.runs.write(spark.createDataFrame([("orphan", "x", 99)], ENTRY), 0, 1)
    unseen, removed, left = engine.get("orphan") is None, engine.prune(), engine.runs.files.names(f"{engine.runs.folder}/runs")
    return engine.view().select("key", F.lit(unseen and removed == 1 and len(left) == engine.runs.count() == 1).alias("there"))


@query(f"with {OPS} select (select count(*) from muts) + 1 as next")
def sequence_resume(spark, sf_dir):
    """The first sequence number after a restart."""
    registry = stores(spark)
    registry.store().ingest(mutations(workload(spark, sf_dir)).select("pos", "key", "value"))
    registry.purge()
    return spark.createDataFrame([(registry.store().sequence.next(),)], "next long")


@query("select cast(level as integer) as level, cast(n as bigint) as runs from (values (0, 1), (1, 1)) t(level, n)")
def levels(spark, sf_dir):
    """Runs by level after three batches, with two runs a level at most: two merged, one fresh."""
    engine = stores(spark, max_runs_per_level=2, bottom_level=2).store()
    changes = nations(spark, sf_dir)
    for i in range(3):
        engine.ingest(changes.where(F.col("pos") % 3 == i))
    return engine.levels().groupBy("level").agg(F.count("*").alias("runs"))


# -- parts of the engine by themselves


def notice(say: bool) -> None:
    """For results that have to hold before there are rows."""
    if not say:
        raise AssertionError("the engine doesn't do what this query is about")


@query("select cast(n_nationkey as bigint) as pos, n_name as key, concat('run-', cast(n_regionkey as varchar)) as run, true as whole from nation")
def run_store_contents(spark, sf_dir):
    """What the engine's run store holds, run by run: each region's nations as one run."""
    engine = stores(spark, max_runs_per_level=99).store()
    for r in range(5):
        engine.ingest(table(spark, sf_dir, "nation").where(F.col("n_regionkey") == r).select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")), once=f"run-{r}")
    runs = engine.runs
    metadata = runs.table().select("run_id", "count", "min_key", "max_key")
    held = runs.read(runs.level(0))
    found = held.groupBy("run_id").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    same = found.join(metadata, "run_id").select("run_id", ((F.col("n") == F.col("count")) & (F.col("a") == F.col("min_key")) & (F.col("b") == F.col("max_key"))).alias("whole"))
    return held.join(same, "run_id").select(F.col("value").cast("long").alias("pos"), "key", F.col("run_id").alias("run"), "whole")


@query(f"with {OPS} select key, value from live")
def memory_store_view(spark, sf_dir):
    """The live view of a store whose runs and log last as long as the process."""
    engine = stores(spark, runs="memory", wal="memory", max_runs_per_level=2).store()
    engine.ingest(mutations(workload(spark, sf_dir)).select("pos", "key", "value"))
    return engine.view()


@query(f"with {OPS} select key, value from live")
def catalog_store_view(spark, sf_dir):
    """The live view of a store whose runs are tables of the catalog."""
    registry = stores(spark)
    registry.configure("catalog", {"runs": "catalog", "sync_wal": False, "max_runs_per_level": 2})
    engine = registry.store("catalog")
    changes = mutations(workload(spark, sf_dir)).select("pos", "key", "value")
    half = changes.agg((F.max("pos") / 2).alias("half")).first()["half"]
    engine.ingest(changes.where(F.col("pos") < half))
    engine.ingest(changes.where(F.col("pos") >= half))
    return engine.view()


_NATIONS = "select n_name as key, cast(n_nationkey as varchar) as value from nation"


def _nation_rows(spark, sf_dir) -> list[tuple[str, str]]:
    return [(r["n_name"], str(r["n_nationkey"])) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a fixed table


@query(_NATIONS)
def memory_log_recovery(spark, sf_dir):
    """Writes that only a log in memory has, after the engine was forgotten."""
    registry = stores(spark, wal="memory")
    for k, v in _nation_rows(spark, sf_dir):
        registry.put(k, v)
    notice(registry.statistics().wal_entries == 25)
    registry.purge()
    return registry.view()


@query("select n_name as key, cast(null as varchar) as value from nation")
def null_log_recovery(spark, sf_dir):
    """Writes without a log don't outlive the engine."""
    registry = stores(spark, wal="null")
    rows = _nation_rows(spark, sf_dir)
    for k, v in rows:
        registry.put(k, v)
    notice(registry.get(rows[0][0]) == rows[0][1])
    registry.purge()
    return registry.get_many(spark.createDataFrame([(k,) for k, _ in rows], "key string"))


@query("select n_name as key, concat('later ', cast(n_nationkey as varchar)) as value from nation")
def ingest_once_after_compaction(spark, sf_dir):
    """Batches that come again after their runs were merged change nothing: the later values stay."""
    engine = stores(spark, max_runs_per_level=2, bottom_level=1).store()
    early, late = (nations(spark, sf_dir).withColumn("value", F.concat(F.lit(f"{t} "), F.col("pos").cast("string"))) for t in ("early", "later"))
    engine.ingest(early, once="n-0")
    engine.ingest(late, once="n-1")
    notice(engine.runs.count() == 1)
    engine.ingest(early, once="n-0")
    engine.ingest(early, once="n-1")
    return engine.view()


@query("select n_name as key, case when n_nationkey % 2 = 0 then 'during' else 'x' end as value from nation")
def write_during_flush(spark, sf_dir):
    """Writes that come while a buffer is being sealed are kept, and win."""
    engine = stores(spark).store()
    rows = _nation_rows(spark, sf_dir)
    for k, _ in rows:
        engine.put(k, "x")
    write = engine.runs.write

    def slow(*args, **more):
        for k, v in rows:
            if int(v) % 2 == 0:
                engine.put(k, "during")
        return write(*args, **more)

    engine.runs.write = slow
    engine.flush()
    notice(engine.statistics().buffered == 13)
    return engine.view()


@query("select n_name as key, 'x' as value from nation")
def view_outlives_compaction(spark, sf_dir):
    """A view that was made before a compaction can still be read after it."""
    engine = stores(spark, max_runs_per_level=2, bottom_level=1).store()
    engine.ingest(nations(spark, sf_dir))
    view = engine.view()
    engine.ingest(nations(spark, sf_dir).withColumn("value", F.lit("y")))
    notice(engine.runs.count() == 1)
    return view


@query("select n_name as key, 'x' as value from nation")
def refresh_after_another_writer(spark, sf_dir):
    """What another engine has committed is seen after a refresh, and not before."""
    registry = stores(spark)
    mine = registry.store()
    other = StoreRegistry(spark, registry.root, registry.settings).store()
    other.ingest(nations(spark, sf_dir))
    notice(mine.runs.count() == 0)
    mine.refresh()
    notice(mine.sequence.current() == 25)
    return mine.view()


@query("select n_name as key, cast(n_nationkey as varchar) as value from nation")
def array_source(spark, sf_dir):
    """Operations given as rows in memory."""
    registry = stores(spark)
    registry.store().replay(ArraySource(spark, [(" PUT ", k, v) for k, v in _nation_rows(spark, sf_dir)] + [("delete", "none"), ("get", "none")]).operations())
    return registry.view()


@query("select 'csv' as format, n_name as key, cast(n_nationkey as varchar) as value from nation union all select 'tsv', n_name, cast(n_nationkey as varchar) from nation union all select 'NDJSON', n_name, cast(n_nationkey as varchar) from nation")
def parser_dispatch(spark, sf_dir):
    """The parser that a path's extension names, in any case."""
    lines = {
        "csv": F.concat(F.lit("put,"), "key", F.lit(","), "value"),
        "tsv": F.concat(F.lit("put\t"), "key", F.lit("\t"), "value"),
        "NDJSON": F.to_json(F.struct(F.lit("put").alias("type"), "key", "value")),
    }
    rows, out = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")), []
    for extension, line in lines.items():
        out.append(rows.select(parser_for(f"/some/where.{extension}")(line).alias("p")).select(F.lit(extension).alias("format"), "p.key", "p.value"))
    return out[0].union(out[1]).union(out[2])


@query("select cast(n_nationkey + 1 as bigint) as bad_line, concat('line ', cast(n_nationkey + 1 as varchar), ': unknown operation upsert') as said, cast(0 as bigint) as applied from nation where n_nationkey % 6 = 0")
def line_errors(spark, sf_dir):
    """An import with a bad line names the line, and applies nothing."""
    registry, out = stores(spark), []
    for bad in range(0, 25, 6):
        path = f"{registry.root}/bad-{bad}.csv"
        kind = F.when(F.col("n_nationkey") == bad, "upsert").otherwise("put")
        table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat(kind, F.lit(","), "n_name", F.lit(",x"))).coalesce(1).write.text(path)
        try:
            registry.store().replay(TextSource(spark, path, "csv", registry.root).operations())
        except MalformedOperationError as e:
            out.append((bad + 1, str(e).removeprefix(f"{path} "), registry.store().view().count()))
    return spark.createDataFrame(out, "bad_line long, said string, applied long")


@query("select 'missing' as source, 'UnreadableSourceError' as raised union all select 'no parser', 'UnreadableSourceError' union all select 'no store', 'StoreNotConfiguredError' union all select 'no driver', 'UnsupportedDriverError' union all select 'no key', 'KeyNotFoundError' union all select 'empty key', 'InvalidKeyError' union all select 'small levels', 'InvalidConfigurationError' union all select 'held lock', 'LockTimeoutError' union all select 'second writer', 'ConflictError'")
def errors_raised(spark, sf_dir):
    """What is raised for sources, stores, keys, settings, locks and commits that aren't sound."""
    registry = stores(spark, lock_wait=0.1)
    registry.configure("odd", {"runs": "tape"})
    engine, other = registry.store(), StoreRegistry(spark, registry.root, registry.settings).store()
    engine.ingest(nations(spark, sf_dir))

    def held() -> None:
        with other.lock.hold():
            engine.compact()

    calls = {
        "missing": lambda: TextSource(spark, f"{registry.root}/none.csv").operations(), "no parser": lambda: TextSource(spark, "a.xlsx"), "no store": lambda: registry.store("nope"), "no driver": lambda: registry.store("odd"),
        "no key": lambda: engine.get_or_fail("none"), "empty key": lambda: engine.put("", "x"), "small levels": lambda: StoreConfig(max_runs_per_level=1), "held lock": held, "second writer": lambda: other.ingest(nations(spark, sf_dir)),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
        except StoreError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "source string, raised string")


@query("""select 'write' as type, 25 as events union all select 'flush', 5 union all select 'compaction', 1 union all select 'read.hit', 25 union all select 'read.miss', 5 union all select 'logged flush', 5
union all select 'published BufferSealed', 5 union all select 'published RunsMerged', 1""")
def trace_events(spark, sf_dir):
    """What listeners hear of twenty-five writes in buffers of five, merged by threes, and of reads: all events by kind, those that a log is asked for, and the structural ones."""
    heard, published, log = Collecting(), [], logging.getLogger(f"tidelog.{uuid.uuid4().hex}")
    lines: list[str] = []
    log.setLevel(logging.INFO)
    log.propagate = False
    keep = logging.Handler()
    keep.emit = lambda record: lines.append(record.getMessage())
    log.addHandler(keep)
    engine = stores(spark, lambda name: composite(heard, structural(name, published.append), Logging(name, ["flush", "no-such-type"], log)), buffer_capacity=5, max_runs_per_level=3).store()
    rows = _nation_rows(spark, sf_dir)
    for k, v in rows:
        engine.put(k, v)
    for k, v in rows:
        notice(engine.get(k) == v)
    for r in table(spark, sf_dir, "region").collect():  # a fixed table
        notice(engine.get(f"no {r['r_name']}") is None)
    kinds = [(t.value, heard.count_of(t)) for t in TraceType if t not in (TraceType.READ_FILTER_SKIP, TraceType.READ_FALSE_POSITIVE)]
    kinds += [("logged flush", sum("sealed" in line for line in lines)), *((f"published {c.__name__}", sum(isinstance(p, c) for p in published)) for c in (BufferSealed, RunsMerged))]
    return spark.createDataFrame(kinds, "type string, events int")


@query("select 'R' || cast(i as varchar) as run_id, cast(i as integer) as number from range(1, 6) t(i)")
def sequential_run_ids(spark, sf_dir):
    """Runs with ids that count."""
    folder = shared_folder(spark)
    runs = FileRunStore(spark, folder, ids=sequential_ids())
    for r in range(5):
        runs.commit([runs.write_some(table(spark, sf_dir, "nation").where(F.col("n_regionkey") == r).select(F.col("n_name").alias("key"), F.lit("x").alias("value"), F.col("n_nationkey").cast("long").alias("sequence")), 0, 5)])
    return runs.table().select("run_id", F.col("run_no").cast("int").alias("number"))


@query("select cast(a.i as bigint) as level, false as merges from range(0, 5) a(i)")
def null_policy(spark, sf_dir):
    """The policy that never merges, for stores of any shape."""
    levels = {n: [Run(f"{n}-{i}", n, i, 1, "a", "b", 1) for i in range(50)] for n in range(5)}
    return spark.createDataFrame([(n, never({n: levels[n]}) is not None or never(levels) is not None) for n in levels], "level long, merges boolean")


@query(f"with {ORDER_RUNS} select string_agg(cast(run as varchar), ',' order by run desc) as inputs, cast(sum(count) as bigint) as entry_count from runs")
def compaction_plan(spark, sf_dir):
    """The plan for the runs of orders, all in one level: its inputs, newest first, and the entries that the merge may have."""
    rows = order_runs(spark, sf_dir).collect()  # a row for each run
    runs = sorted((Run(str(r["run"]), 0, r["run"], r["count"], r["min_key"], r["max_key"], r["max_sequence"]) for r in rows), key=lambda r: -r.run_no)
    plan = SizeTieredPolicy(2, 2)({0: runs})
    return spark.createDataFrame([(",".join(plan.input_ids), plan.entry_count)], "inputs string, entry_count long")


@query("select n_name as key, 'x' as value, cast(n_nationkey + 1 as bigint) as sequence from nation")
def entry_round_trip(spark, sf_dir):
    """Entries written as a run and read back, types and all."""
    engine = stores(spark).store()
    engine.ingest(nations(spark, sf_dir))
    back = engine.runs.read(engine.runs.level(0)).drop("run_id")
    notice([f.dataType for f in back.schema] == [f.dataType for f in ENTRY])
    return back


@query("select 3 as capacity, cast(n_nationkey as bigint) as after, least(n_nationkey + 1, 3) as held, n_nationkey >= 2 as is_full from nation where n_nationkey < 3")
def buffer_states(spark, sf_dir):
    """A buffer of three as it fills; the same key again takes no more room, and clearing empties it."""
    buffer, rows = MemoryBuffer(3), []
    for i, (k, v) in enumerate(_nation_rows(spark, sf_dir)[:3]):  # as many as it is made for
        buffer.put((k, v, i + 1))
        buffer.put((k, v, i + 1))
        rows.append((buffer.capacity, i, len(buffer), buffer.is_full()))
    buffer.clear()
    notice(len(buffer) == 0 and not buffer.is_full())
    return spark.createDataFrame(rows, "capacity int, after long, held int, is_full boolean")


@query(f"with {ORDER_RUNS} select key, true as maybe from entries")
def null_filter(spark, sf_dir):
    """Without a filter no order's key is denied, and reads find what is there."""
    engine = stores(spark, filter="null").store()
    engine.ingest(nations(spark, sf_dir))
    (run,) = engine.runs.level(0)
    known = engine.runs.filter_of(run)
    notice(known.might_contain("anything") and engine.get("FRANCE") in ("x", None))
    return order_entries(spark, sf_dir).select("key", F.lit(known.might_contain("any")).alias("maybe"))


@query("select 'mine' as part, n_name as key, 'x' as value from nation")
def custom_drivers(spark, sf_dir):
    """A store of drivers that were added from outside: its runs and its log are the ones given."""
    registry, log = stores(spark), MemoryWal()
    mine = FileRunStore(spark, f"{registry.root}/elsewhere")
    registry.extend_runs("mine", lambda s, c: mine)
    registry.extend_wal("mine", lambda s, c: log)
    registry.configure("custom", {"runs": "mine", "wal": "mine", "lock": "null", "policy": "null"})
    registry.set_default_store("custom")
    for k, _ in _nation_rows(spark, sf_dir):
        registry.put(k, "x")
    notice(log.count() == 25 and registry.resolved_stores() == ["custom"])
    registry.flush()
    notice(log.count() == 0)
    return mine.read(mine.level(0)).select(F.lit("mine").alias("part"), "key", "value")


@query("select n_name as key, 'x' as value from nation")
def background_jobs(spark, sf_dir):
    """Flushes and merges handed to the background, two for one store at once being one."""
    registry = stores(spark)
    for k, _ in _nation_rows(spark, sf_dir):
        registry.put(k, "x")
    jobs = CompactionJobs(registry)
    first, second = jobs.submit(), jobs.submit()
    first.result()
    second.result()
    notice(registry.statistics().buffered == 0 and registry.statistics().runs == 1)
    return registry.view()


@query("select n_name as key, cast(n_nationkey as varchar) as value, true as has from nation")
def module_functions(spark, sf_dir):
    """The functions of the module ``store`` over one registry."""
    registry = stores(spark)
    facade.use(spark, registry.root, stores=registry.settings)
    rows = _nation_rows(spark, sf_dir)
    for k, v in rows:
        facade.put(k, v)
    facade.put("gone", "x")
    facade.delete("gone")
    notice(facade.get("gone") is None and not facade.has("gone") and facade.registry().default_store() == "primary")
    return spark.createDataFrame([(k, facade.get_or_fail(k), facade.has(k)) for k, _ in rows], "key string, value string, has boolean")


@query("select n_name as key, cast(n_nationkey as varchar) as value from nation")
def write_calls(spark, sf_dir):
    """A store that is used through the narrow protocol of applications, and kept through that of maintenance."""
    engine = stores(spark, buffer_capacity=10).store()
    notice(all(callable(getattr(engine, n)) for protocol in (KeyValueStore, Maintenance) for n in vars(protocol) if not n.startswith("_")))
    for k, v in _nation_rows(spark, sf_dir):
        engine.put(k, "first")
        engine.delete(k)
        engine.put(k, v)
    engine.flush()
    engine.compact()
    notice(engine.recover() == 0 and engine.statistics().sequence == 75)
    return engine.view()


def _command(spark: SparkSession, root: str, *args: str) -> tuple[int, list[str]]:
    out = io.StringIO()
    return main(["--root", root, *args], spark, out), out.getvalue().splitlines()


@query("select 'install' as command, 0 as code, 'wrote' as said union all select 'install again', 1, 'is there already' union all select 'install --force', 0, 'wrote' union all select 'get of an unknown store', 1, 'error' union all select 'get of nothing', 1, 'not found'")
def command_install(spark, sf_dir):
    """Installing settings below a root, and what commands say without luck."""
    root, rows = shared_folder(spark), []
    for name, args, word in (("install", ["install"], "wrote"), ("install again", ["install"], "is there already"), ("install --force", ["install", "--force"], "wrote"), ("get of an unknown store", ["get", "x", "--store", "nope"], "error"), ("get of nothing", ["get", "x"], "not found")):
        code, said = _command(spark, root, *args)
        rows.append((name, code, word if word in said[0] else said[0]))
    return spark.createDataFrame(rows, "command string, code int, said string")


@query("select n_name as key, cast(n_nationkey as varchar) as value, 0 as code from nation where n_nationkey < 4 union all select n_name, n_name || ' not found', 1 from nation where n_nationkey = 4")
def command_put_get_forget(spark, sf_dir):
    """Writing, reading and forgetting by commands, each an engine of its own."""
    root, rows = shared_folder(spark), []
    for k, v in _nation_rows(spark, sf_dir)[:5]:  # a call for each
        _command(spark, root, "put", k, v)
    _command(spark, root, "forget", _nation_rows(spark, sf_dir)[4][0])
    for k, _ in _nation_rows(spark, sf_dir)[:5]:
        code, said = _command(spark, root, "get", k)
        rows.append((k, said[0], code))
    return spark.createDataFrame(rows, "key string, value string, code int")


@query(f"with {OPS} select 'primary: ' || cast(sum(case when op = 'put' then 1 else 0 end) as varchar) || ' puts, ' || cast(sum(case when op = 'delete' then 1 else 0 end) as varchar) || ' deletes, ' || cast(sum(case when op = 'get' then 1 else 0 end) as varchar) || ' gets, ' || cast(count(*) as varchar) || ' in all' as said, 0 as code from ops")
def command_import(spark, sf_dir):
    """Importing the whole workload from CSV by a command."""
    root = shared_folder(spark)
    path = f"{root}/ops.csv"
    workload(spark, sf_dir).orderBy("pos").select(F.concat_ws(",", "op", "key", F.coalesce("value", F.lit("")))).coalesce(1).write.text(path)
    code, said = _command(spark, root, "import", path, "--format", "csv", "--flush")
    return spark.createDataFrame([(said[0], code)], "said string, code int")


@query("select s as store, cast(case when s = 'primary' then 25 else 0 end as bigint) as sequence, cast(case when s = 'primary' then 1 else 0 end as bigint) as runs, case when s = 'primary' then 2000 else 10000 end as buffer_capacity, 0 as code from (values ('primary'), ('archive')) t(s)")
def command_stats(spark, sf_dir):
    """Statistics of all stores, as JSON, after a command has flushed one of them."""
    root = shared_folder(spark)
    registry = StoreRegistry(spark, root)
    for k, v in _nation_rows(spark, sf_dir):
        registry.put(k, v)
    registry.purge()
    notice(_command(spark, root, "flush")[1][0].startswith("primary: "))
    code, said = _command(spark, root, "stats", "--all", "--json")
    rows = [json.loads(line) for line in said]
    return spark.createDataFrame([(r["store"], r["sequence"], r["runs"], r["buffer_capacity"], code) for r in rows], "store string, sequence long, runs long, buffer_capacity int, code int")


@query("select 'compact' as command, 'primary: 1 merges' as said, 0 as code union all select 'compact --queue', 'primary: 0 merges', 0 union all select 'prune', 'primary: 5 removed', 0 union all select 'flush', 'primary: nothing to flush', 0")
def command_maintenance(spark, sf_dir):
    """Merging, pruning and flushing by commands: five runs become one, and are removed."""
    root = shared_folder(spark)
    files = Files(spark)
    files.make(root)
    files.write(f"{root}/stores.json", json.dumps({"primary": {"policy": "null", "prune_grace": 0.0}}).encode())
    engine = StoreRegistry(spark, root, {"primary": {"policy": "null"}}).store()
    for r in range(5):
        engine.ingest(nations(spark, sf_dir).where(F.col("pos") % 5 == r))
    engine.close()
    files.write(f"{root}/stores.json", json.dumps({"primary": {"max_runs_per_level": 5, "prune_grace": 0.0}}).encode())
    rows = []
    for name in ("compact", "compact --queue", "prune", "flush"):
        code, said = _command(spark, root, *name.split())
        rows.append((name, said[0], code))
    return spark.createDataFrame(rows, "command string, said string, code int")


@query(f"with {OPS} select (count(*) filter (op <> 'get')) as sequence, cast(4 as bigint) as calls, count(*) as done from ops")
def replay_progress(spark, sf_dir):
    """A workload in four batches, with what was heard of its progress."""
    engine, heard = stores(spark).store(), []
    engine.replay(workload(spark, sf_dir), lambda done, total: heard.append((done, total)), batches=4)
    notice(all(a[0] <= b[0] for a, b in zip(heard, heard[1:])))
    return spark.createDataFrame([(engine.sequence.current(), len(heard), heard[-1][0])], "sequence long, calls long, done long")


@query("select n_name as key, cast(n_nationkey as varchar) as value from nation")
def log_across_hosts(spark, sf_dir):
    """Writes that only the log has, recovered by a registry that shares nothing with the writer's but the root."""
    first = stores(spark)
    for k, v in _nation_rows(spark, sf_dir):
        first.put(k, v)
    notice(first.store().runs.count() == 0)
    second = StoreRegistry(spark, first.root, first.settings)
    return second.view()
