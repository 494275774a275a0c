"""Commands: ``python -m blockvault <command> <repository> ...``; each prints JSON lines or bytes."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import trees, verify
from .repository import Repository, discover
from .sources import repository as source


def show(df: DataFrame, limit: int | None = None) -> None:
    for row in (df if limit is None else df.limit(limit)).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def cat(repo: Repository, path: str, offset: int, length: int | None) -> None:
    """Bytes in order; what no row covers is zeros."""
    at = offset
    for row in repo.read(path, offset, length).orderBy("file_offset").toLocalIterator():
        sys.stdout.buffer.write(b"\0" * (row["file_offset"] - at) + row["data"])
        at = row["file_offset"] + len(row["data"])
    size = repo.locations().filter(F.col("path") == path).first()["file_size"]
    end = size if length is None else min(size, offset + length)
    sys.stdout.buffer.write(b"\0" * max(0, end - at))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="blockvault", description=__doc__)
    parser.add_argument("--key", help="an administrator's key string, id@base64")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *more: [commands.add_parser(name), *[commands.choices[name].add_argument(*a, **k) for a, k in (*more,)]][0]
    root = (("root",), {})
    add("find", root)
    add("doctor", root)
    add("ls", root, (("folder",), {"nargs": "?", "default": ""}))
    add("connections", root)
    add("workloads", root, (("connection",), {"type": int}))
    add("versions", root, (("--deleted",), {"action": "store_true"}))
    add("tree", root, (("version",), {"type": int}), (("--parent",), {}), (("--offset",), {"type": int, "default": 0}), (("--limit",), {"type": int}))
    add("cat", root, (("path",), {}), (("--offset",), {"type": int, "default": 0}), (("--length",), {"type": int}))
    add("export", root, (("output",), {}), (("--prefix",), {"default": ""}))
    add("verify", root, (("--level",), {"choices": ("quick", "full"), "default": "quick"}))
    add("key", root)
    add("bucket", root, (("stream",), {"type": int}), (("bucket",), {"type": int}))
    add("records", root, (("--limit",), {"type": int}))
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("blockvault").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "find":
        for found in discover(spark, given.root):
            print(found.root)
        return 0
    repo = Repository(spark, given.root, given.key)
    if given.command == "doctor":
        print(json.dumps(repo.report()))
    elif given.command == "ls":
        show(source.listing(spark, given.root, given.folder.strip("/")))
    elif given.command == "connections":
        show(repo.connections().orderBy(F.lower("display_name"), "connection_config_id"))
    elif given.command == "workloads":
        show(repo.workloads(given.connection).orderBy(F.lower("display_name"), "workload_id"))
    elif given.command == "versions":
        show(repo.versions(given.deleted).orderBy("workload_id", "place"))
    elif given.command == "tree":
        show(trees.children(repo.version_tree(given.version), given.parent, given.offset, given.limit))
    elif given.command == "cat":
        cat(repo, given.path, given.offset, given.length)
    elif given.command == "export":
        repo.export(repo.locations().filter(F.col("path").startswith(given.prefix)).select("path"), given.output)
    elif given.command == "key":
        repo.vault_key()
        print(json.dumps({"valid": True}))
    elif given.command == "bucket":
        show(repo.inspect_bucket(given.stream, given.bucket).orderBy("type"))
    elif given.command == "records":
        show(repo.walk_records().orderBy("stream", "session", "offset"), given.limit)
    else:
        found = repo.verify(given.level == "full").cache()
        show(verify.ordered(found))
        total = verify.summary(found).first().asDict()
        print(json.dumps(total))
        return int(total["problems"] > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
