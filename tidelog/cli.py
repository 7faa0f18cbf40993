"""Commands: python -m tidelog.cli --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession

from tidelog.config import DEFAULT_STORES
from tidelog.errors import StoreError
from tidelog.jobs import CompactionJobs
from tidelog.registry import StoreRegistry
from tidelog.sources.files import Files
from tidelog.sources.operations import TextSource


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("--root", required=True, help="folder of the stores")
    p.add_argument("--config", help="JSON file with the stores' settings; default: the one that install writes")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, many: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("--store", help="the store; default: the default store")
        if many:
            c.add_argument("--all", action="store_true", help="all stores")
        return c

    command("install", "write the default settings").add_argument("--force", action="store_true")
    command("stats", "what the stores hold", True).add_argument("--json", action="store_true")
    command("flush", "seal the buffers", True)
    command("compact", "flush, then merge runs", True).add_argument("--queue", action="store_true", help="in the background")
    command("prune", "remove orphaned runs", True)
    c = command("import", "apply operations from a file")
    c.add_argument("path")
    c.add_argument("--format", help="instead of the path's extension")
    c.add_argument("--flush", action="store_true")
    command("get", "print a value").add_argument("key")
    c = command("put", "write a value")
    c.add_argument("key")
    c.add_argument("value")
    command("forget", "delete a key").add_argument("key")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """0 if all went well."""
    args = _parser().parse_args(argv)
    out = out or sys.stdout
    say = lambda text: print(text, file=out)
    spark = spark or SparkSession.builder.appName("tidelog").getOrCreate()
    files = Files(spark)
    path = args.config or f"{args.root.rstrip('/')}/stores.json"
    try:
        settings = json.loads(files.read(path)) if files.exists(path) else None
        if args.command == "install":
            if settings is not None and not args.force:
                say(f"{path} is there already")
                return 1
            files.make(args.root)
            files.write(path, json.dumps(DEFAULT_STORES, indent=2).encode())
            say(f"wrote {path}")
            return 0
        registry = StoreRegistry(spark, args.root, settings)
        names = registry.stores() if getattr(args, "all", False) else [args.store or registry.default_store()]
        for name in names:
            engine = registry.store(name)
            if args.command == "stats":
                s = engine.statistics()
                body = asdict(s) | {"levels": s.levels, "read_amplification": s.read_amplification}
                say(json.dumps({"store": name} | body) if args.json else "\n".join([name, *(f"  {k}: {v}" for k, v in body.items())]))
            elif args.command == "flush":
                say(f"{name}: {engine.flush() or 'nothing to flush'}")
            elif args.command == "compact":
                if args.queue:
                    say(f"{name}: {CompactionJobs(registry).submit(name).result()} merges")
                else:
                    engine.flush()
                    say(f"{name}: {engine.compact()} merges")
            elif args.command == "prune":
                if engine.config.runs not in ("file", "catalog"):
                    say(f"{name}: warning: only drivers of files and tables leave orphans")
                say(f"{name}: {engine.prune()} removed")
            elif args.command == "import":
                done = engine.replay(TextSource(spark, args.path, args.format, registry.root).operations())
                if args.flush:
                    engine.flush()
                say(f"{name}: {done.puts} puts, {done.deletes} deletes, {done.gets} gets, {done.total} in all")
            elif args.command == "get":
                value = engine.get(args.key)
                if value is None:
                    say(f"{args.key} not found")
                    return 1
                say(value)
            elif args.command == "put":
                engine.put(args.key, args.value)
            elif args.command == "forget":
                engine.delete(args.key)
            engine.close()
        return 0
    except StoreError as e:
        say(f"error: {e}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
