import json
import os
import random
import threading

import pytest

from tidelog.cli import main
from tidelog.errors import ConflictError, CorruptLogError, CorruptManifestError, InvalidKeyError, KeyNotFoundError, LockTimeoutError, RunNotFoundError, StoreNotConfiguredError, UnsupportedDriverError
from tidelog.jobs import CompactionJobs
from tidelog.locks import FileLock
from tidelog.registry import StoreRegistry
from tidelog.schema import ENTRY, OPERATION
from tidelog.sources.files import Files
from tidelog.sources.runs import FileRunStore, sequential_ids
from tidelog.sources.wal import FileWal, MemoryWal, NullWal
from tidelog.trace import BufferSealed, Collecting, Logging, RunsMerged, TraceType, composite, structural

SMALL = {"buffer_capacity": 3, "max_runs_per_level": 2, "bottom_level": 1}


@pytest.fixture(params=["file", "memory"])
def registry(request, spark, tmp_path):
    made = StoreRegistry(spark, str(tmp_path), {n: SMALL | {"runs": request.param, "wal": request.param} for n in ("primary", "archive")})
    yield made
    made.purge()


def test_round_trip_through_flushes_and_merges(registry):
    e = registry.store()
    for i in range(1, 8):
        e.put(f"k{i}", f"v{i}")
    e.delete("k4")
    e.put("k1", "again")
    e.flush()
    assert e.get("k1") == "again" and e.get("k7") == "v7" and e.get("k4") is None and e.get("missing") is None
    assert e.has("k1") and not e.has("k4")
    with pytest.raises(KeyNotFoundError):
        e.get_or_fail("k4")
    s = e.statistics()
    assert s.sequence == 9 and s.buffered == 0 and s.runs == sum(s.runs_per_level.values()) < 3 and s.levels == len(s.runs_per_level)


def test_deleted_keys_stay_deleted(registry):
    e = registry.store()
    e.put("victim", "x")
    for k in "ab":
        e.put(k, k)
    e.delete("victim")
    for k in "cdefg":
        e.put(k, k)
    e.flush()
    e.compact()
    assert e.get("victim") is None and e.view().where("key = 'victim'").count() == 0


def test_empty_values_and_keys(registry):
    e = registry.store()
    e.put("a", "")
    assert e.get_or_fail("a") == "" and e.has("a")
    for call in (lambda: e.put("", "x"), lambda: e.get(""), lambda: e.delete("")):
        with pytest.raises(InvalidKeyError):
            call()


def test_restart_recovers_the_buffer(spark, tmp_path):
    settings = {"primary": SMALL | {"buffer_capacity": 2}}
    first = StoreRegistry(spark, str(tmp_path), settings)
    first.put("a", "1")
    assert first.store().statistics().wal_entries == 1
    first.put("b", "2")
    assert first.store().statistics().wal_entries == 0
    first.put("c", "3")
    first.purge()
    second = StoreRegistry(spark, str(tmp_path), settings).store()
    assert second.statistics().buffered == 1 and second.get("c") == "3" and second.get("a") == "1"
    assert second.sequence.next() == 4


def test_crash_between_commit_and_truncation(spark, tmp_path, monkeypatch):
    r = StoreRegistry(spark, str(tmp_path), {"primary": SMALL})
    e = r.store()
    e.put("a", "1")
    e.put("b", "2")
    monkeypatch.setattr(FileWal, "drop", lambda self, sealed: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        e.flush()
    monkeypatch.undo()
    again = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    assert again.get("a") == "1" and again.statistics().sequence == 2 and again.entries().count() == 2


def test_crash_before_commit_leaves_an_orphan(spark, tmp_path, monkeypatch):
    r = StoreRegistry(spark, str(tmp_path), {"primary": SMALL})
    e = r.store()
    e.put("a", "1")
    monkeypatch.setattr(e.runs.files, "publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        e.flush()
    again = StoreRegistry(spark, str(tmp_path), {"primary": SMALL | {"prune_grace": 0.0}}).store()
    assert again.runs.count() == 0 and again.get("a") == "1" and again.prune() == 1 and again.wal.count() == 1


def test_a_model_of_random_operations(spark, tmp_path):
    rng, model = random.Random(4), {}
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL | {"buffer_capacity": 4}}).store()
    for i in range(40):
        k = f"k{rng.randint(0, 7)}"
        if rng.random() < 0.3:
            e.delete(k)
            model.pop(k, None)
        else:
            e.put(k, str(i))
            model[k] = str(i)
        if i % 13 == 0:
            assert e.get(k) == model.get(k)
    assert {r["key"]: r["value"] for r in e.view().collect()} == model
    e.flush()
    e.compact()
    assert {r["key"]: r["value"] for r in e.view().collect()} == model


def test_replay_and_many_keys(spark, tmp_path):
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    e.put("base", "b")
    done = e.replay(spark.createDataFrame([(1, "put", "a", "1"), (2, "get", "a", None), (3, "get", "base", None), (4, "delete", "base", None)], OPERATION))
    assert (done.puts, done.deletes, done.gets, done.total) == (1, 1, 2, 4)
    assert {r["key"]: r["value"] for r in done.reads.collect()} == {"a": "1", "base": "b"}
    asked = spark.createDataFrame([("a",), ("base",), ("none",)], "key string")
    assert {r["key"]: r["value"] for r in e.get_many(asked).collect()} == {"a": "1", "base": None, "none": None}
    assert [r["key"] for r in e.has_many(asked).collect()] == ["a"]
    with pytest.raises(Exception, match="key not found"):
        e.get_many_or_fail(asked).collect()


def test_replay_in_batches(spark, tmp_path):
    e, heard = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store(), []
    ops = [(i, ("put", "get", "delete")[i % 3], f"k{i % 5}", f"v{i}" if i % 3 == 0 else None) for i in range(30)]
    done = e.replay(spark.createDataFrame(ops, OPERATION), lambda *a: heard.append(a), batches=3)
    model, reads = {}, {}
    for _, op, k, v in ops:
        if op == "get":
            reads[k] = model.get(k)
        else:
            model[k] = v
    assert (done.puts, done.deletes, done.gets) == (10, 10, 10) and heard[-1] == (30, 30) and len(heard) == 3
    assert {r["key"]: r["value"] for r in done.reads.collect()} == reads
    assert {r["key"]: r["value"] for r in e.view().collect()} == {k: v for k, v in model.items() if v is not None}


def test_runs_are_immutable_and_commits_are_exclusive(spark, tmp_path):
    a, b = FileRunStore(spark, str(tmp_path / "s"), ids=sequential_ids()), FileRunStore(spark, str(tmp_path / "s"), ids=sequential_ids(50))
    rows = [(f"key-{i:03d}", f"value-{i}", i + 1) for i in range(200)]
    assert a.manifest() == b.manifest()
    run = a.write(spark.createDataFrame(rows, ENTRY), 0, 200)
    assert (run.count, run.min_key, run.max_key, run.max_sequence) == (200, "key-000", "key-199", 200)
    a.commit([run])
    with pytest.raises(ConflictError):
        b.commit([b.write(spark.createDataFrame(rows[:1], ENTRY), 0, 1)])
    assert b.count() == 1 and b.highest_sequence() == 200
    with pytest.raises(RunNotFoundError):
        b.commit(remove=["nothing"])
    b.commit(remove=[run.run_id])
    assert b.highest_sequence() == 200 and b.levels() == {} and a.write(spark.createDataFrame([], ENTRY), 0, 0) is None
    keys = [r["key"] for r in spark.createDataFrame(rows, ENTRY).where("key = 'key-200'").collect()]
    assert not keys


def test_a_broken_manifest_is_not_an_empty_store(spark, tmp_path):
    store = FileRunStore(spark, str(tmp_path / "s"))
    store.commit([store.write(spark.createDataFrame([("a", "1", 1)], ENTRY), 0, 1)])
    (tmp_path / "s/manifest/000000000009.json").write_text("{")
    store.refresh()
    with pytest.raises(CorruptManifestError):
        store.manifest()


def test_ingest_once(spark, tmp_path):
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    rows = spark.createDataFrame([(1, "a", "1")], "pos long, key string, value string")
    assert e.ingest(rows, once="batch-1") == e.ingest(rows, once="batch-1") == "batch-1"
    assert e.runs.count() == 1 and e.statistics().sequence == 1


def test_logs(spark, tmp_path):
    file = FileWal(Files(spark), str(tmp_path / "wal"))
    for wal in (file, MemoryWal()):
        wal.append(("a", None, 1))
        wal.append(("ä", "x\ny", 2))
        assert list(wal.replay()) == [("a", None, 1), ("ä", "x\ny", 2)] and wal.count() == 2
        sealed = wal.rotate()
        wal.append(("b", "3", 3))
        wal.drop(sealed)
        assert list(wal.replay()) == [("b", "3", 3)] and wal.count() == 1
    file.close()
    (segment,) = file.segments()
    with open(tmp_path / "wal" / segment, "a") as f:
        f.write('{"key": "torn')
    again = FileWal(Files(spark), str(tmp_path / "wal"))
    assert again.count() == 1
    again.append(("c", "4", 4))
    assert [e[0] for e in again.replay()] == ["b", "c"] and len(again.segments()) == 2
    again.truncate()
    assert again.count() == 0 and again.segments() == []
    NullWal().append(("a", "b", 1))
    assert NullWal().count() == 0 and list(NullWal().replay()) == []


def test_damage_inside_a_log_is_raised(spark, tmp_path):
    wal = FileWal(Files(spark), str(tmp_path / "wal"))
    wal.append(("a", "1", 1))
    wal.close()
    path = tmp_path / "wal" / wal.segments()[0]
    path.write_text("{broken\n" + path.read_text())
    with pytest.raises(CorruptLogError):
        list(FileWal(Files(spark), str(tmp_path / "wal")).replay())


def test_locks(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "l")
    lock = FileLock(files, path, wait=0.1)
    with lock.hold(), pytest.raises(LockTimeoutError), FileLock(files, path, wait=0.1).hold():
        pass
    assert not os.path.exists(path)
    with FileLock(files, path, ttl=-1.0).hold():  # has run out at once
        with lock.hold():
            pass
        with lock.hold():
            owner = (tmp_path / "l").read_text()
    with lock.hold():
        mine = (tmp_path / "l").read_text()
        assert mine != owner
        (tmp_path / "l").write_text(owner)  # taken over by another
        (tmp_path / ".l.crc").unlink(missing_ok=True)
    assert (tmp_path / "l").read_text() == owner  # and not removed by its old holder


def injected(runs, during, monkeypatch):
    """Calls ``during`` while a run is written."""
    write, once = type(runs).write, []

    def slow(*args, **more):
        if not once:
            once.append(1)
            during()
        return write(runs, *args, **more)

    monkeypatch.setattr(runs, "write", slow)


@pytest.mark.parametrize("how", ["flush", "ingest"])
def test_a_put_during_a_flush_is_kept(spark, tmp_path, monkeypatch, how):
    settings = {"primary": SMALL | {"buffer_capacity": 10}}
    e = StoreRegistry(spark, str(tmp_path), settings).store()
    e.put("a", "1")
    e.put("b", "1")
    injected(e.runs, lambda: (e.put("b", "2"), e.put("c", "2")), monkeypatch)
    changes = spark.createDataFrame([(1, "b", "batch"), (2, "d", "batch")], "pos long, key string, value string")
    e.flush() if how == "flush" else e.ingest(changes)
    assert [e.get(k) for k in "abc"] == ["1", "2", "2"] and e.statistics().wal_entries == 2 and e.statistics().buffered == 2
    again = StoreRegistry(spark, str(tmp_path), settings).store()
    assert [again.get(k) for k in "abc"] == ["1", "2", "2"] and {r["key"]: r["value"] for r in again.view().collect()}["b"] == "2"


def test_two_threads_share_an_engine(spark, tmp_path):
    r = StoreRegistry(spark, str(tmp_path), {"primary": SMALL | {"buffer_capacity": 50}})
    e, seen = r.store(), []

    def write(who):
        for i in range(120):
            e.put(f"{who}-{i}", str(i))
            if i % 40 == 0:
                seen.append(e.get(f"{who}-{i}") == str(i))

    threads = [threading.Thread(target=write, args=(w,)) for w in "xy"] + [threading.Thread(target=lambda: CompactionJobs(r).submit().result())]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(seen) and e.statistics().sequence == 240
    r.purge()
    again = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    assert {r["key"]: r["value"] for r in again.view().collect()} == {f"{w}-{i}": str(i) for w in "xy" for i in range(120)}


def test_a_failed_flush_loses_nothing(spark, tmp_path, monkeypatch):
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    e.put("a", "1")

    def fail():
        e.put("a", "2")
        raise OSError("disk")

    injected(e.runs, fail, monkeypatch)
    with pytest.raises(OSError):
        e.flush()
    assert e.get("a") == "2" and e.statistics().buffered == 1
    e.flush()
    assert e.get("a") == "2" and e.wal.count() == 0


def test_a_batch_is_taken_in_once_whatever_was_merged_since(spark, tmp_path):
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    rows = lambda v: spark.createDataFrame([(1, "a", v)], "pos long, key string, value string")
    for n, v in enumerate(("old", "new")):
        e.ingest(rows(v), once=f"s-{n}")
    assert e.runs.count() == 1 and e.runs.level(1)  # merged
    e.ingest(rows("old"), once="s-0")
    e.ingest(rows("old"), once="s-1")
    assert e.get("a") == "new"
    again = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    again.ingest(rows("old"), once="s-0")
    again.ingest(rows("newer"), once="s-2")
    assert again.get("a") == "newer"


def test_a_view_outlives_a_compaction(spark, tmp_path):
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    e.put("a", "1")
    e.flush()
    view = e.view()
    e.put("b", "2")
    e.flush()
    assert e.runs.level(1) and [tuple(r) for r in view.collect()] == [("a", "1")]
    assert e.prune() == 0 and len(e.runs.manifest().retired) == 2
    e.runs.grace = 0.0
    assert e.prune() == 2 and not e.runs.manifest().retired and e.get("a") == "1"


def test_each_replay_keeps_its_own_reads(spark, tmp_path):
    e = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}).store()
    e.put("a", "1")
    first, second = (e.replay(spark.createDataFrame([(1, "get", k, None)], OPERATION)) for k in ("a", "b"))
    assert [tuple(r) for r in first.reads.collect()] == [("a", "1")] and [tuple(r) for r in second.reads.collect()] == [("b", None)]


def test_runs_in_the_catalog(spark, tmp_path):
    e = StoreRegistry(spark, f"file://{tmp_path}", {"cat": SMALL | {"runs": "catalog", "prune_grace": 0.0}}, default="cat").store()
    for i in range(9):
        e.put(f"k{i}", str(i))
    e.delete("k3")
    e.flush()
    assert e.get("k8") == "8" and e.get("k3") is None and e.view().count() == 8
    tables = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("tidelog_cat_")]
    before = len(tables())
    assert e.prune() == before - e.runs.count() and len(tables()) == e.runs.count()
    for t in tables():
        spark.sql(f"drop table {t}")


def test_traces(spark, tmp_path, caplog):
    heard, published = Collecting(), []
    r = StoreRegistry(spark, str(tmp_path), {"primary": SMALL}, listener=lambda n: composite(heard, structural(n, published.append), Logging(n, ["flush"])))
    e = r.store()
    with caplog.at_level("INFO", "tidelog"):
        for k in "abcdef":
            e.put(k, k)
    e.get("a")
    e.get("zzz")
    e.get("aa")
    assert heard.count_of(TraceType.WRITE) == 6 and heard.count_of(TraceType.FLUSH) == 2 and heard.count_of(TraceType.COMPACTION) == 1
    assert heard.count_of(TraceType.READ_HIT) == 1 and heard.count_of(TraceType.READ_MISS) == 2 and heard.count_of(TraceType.READ_FILTER_SKIP) >= 1
    assert [type(p) for p in published] == [BufferSealed, BufferSealed, RunsMerged] and published[2].level == 1
    assert len(caplog.records) == 2 and "tidelog[primary]" in caplog.text
    with caplog.at_level("INFO", "tidelog"):
        Logging("x", ["no-such-type"])(heard.events[0])
    assert len(caplog.records) == 2


def test_registry(spark, tmp_path):
    r = StoreRegistry(spark, str(tmp_path), {"primary": SMALL, "other": SMALL | {"wal": "mine"}})
    assert r.stores() == ["primary", "other"] and r.resolved_stores() == [] and r.default_store() == "primary"
    with pytest.raises(StoreNotConfiguredError):
        r.store("nope")
    with pytest.raises(UnsupportedDriverError):
        r.store("other")
    log = MemoryWal()
    r.extend_wal("mine", lambda s, c: log)
    r.set_default_store("other")
    r.put("a", "1")
    assert log.count() == 1 and r.resolved_stores() == ["other"] and r.store("primary").get("a") is None
    again = r.store()
    r.purge("other")
    assert r.store() is not again and r.get("a") == "1"
    assert CompactionJobs(r).submit().result() == 0 and log.count() == 0


def test_commands(spark, tmp_path, capsys):
    def run(*args):
        code = main(["--root", str(tmp_path), *args], spark)
        return code, capsys.readouterr().out

    assert run("install")[0] == 0 and run("install")[0] == 1 and run("install", "--force")[0] == 0
    (tmp_path / "ops.jsonl").write_text('{"type":"put","key":"alpha","value":"1"}\n{"type":"put","key":"beta","value":"2"}\n{"type":"delete","key":"alpha"}\n\n')
    code, said = run("import", str(tmp_path / "ops.jsonl"), "--flush")
    assert code == 0 and "2 puts, 1 deletes, 0 gets, 3 in all" in said
    assert run("get", "beta") == (0, "2\n") and run("get", "alpha")[0] == 1
    assert run("put", "gamma", "3")[0] == 0 and run("get", "gamma") == (0, "3\n") and run("forget", "gamma")[0] == 0 and run("get", "gamma")[0] == 1
    stats = [json.loads(x) for x in run("stats", "--all", "--json")[1].splitlines()]
    assert [s["store"] for s in stats] == ["primary", "archive"] and stats[0]["runs"] == 1
    assert run("flush")[0] == 0 and run("compact", "--queue")[0] == 0 and "0 removed" in run("prune")[1]
    assert run("get", "x", "--store", "nope")[0] == 1 and run("import", str(tmp_path / "a.xlsx"))[0] == 1
