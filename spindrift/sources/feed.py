"""A change feed as a Spark data source: batch and streaming, over a REST server or recorded
pages.

Options: ``url`` (an http server whose ``/changes?since=&limit=`` gives ``{"Changes": [...],
"Done": bool, "Last": n}``) or ``path`` (a folder of such pages as JSON files, for replays
and tests), and ``limit``.  The offset is the number of the last change that was read.
"""

from __future__ import annotations

import json
import os
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "seq long, change_type string, resource_type string, id string, path string, date string"


def page(options: dict, since: int) -> tuple[list[tuple], int, bool]:
    """(rows, last, done) of the changes after ``since``."""
    limit = int(options.get("limit", 500))
    if options.get("url"):
        with urllib.request.urlopen(f"{options['url'].rstrip('/')}/changes?since={since}&limit={limit}", timeout=60) as r:
            got = json.load(r)
        changes, last, done = got.get("Changes", []), int(got.get("Last", since)), bool(got.get("Done", True))
    else:
        changes = []
        for name in sorted(os.listdir(options["path"])):
            if name.endswith(".json"):
                with open(os.path.join(options["path"], name)) as f:
                    changes += json.load(f).get("Changes", [])
        changes = sorted((c for c in changes if int(c["Seq"]) > since), key=lambda c: int(c["Seq"]))
        done = len(changes) <= limit
        changes = changes[:limit]
        last = int(changes[-1]["Seq"]) if changes else since
    rows = [(int(c["Seq"]), c.get("ChangeType"), c.get("ResourceType"), c.get("ID"), c.get("Path"), c.get("Date")) for c in changes]
    return rows, max(last, since), done


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(int(self.options.get("since", 0)))]

    def read(self, partition):
        since = partition.value
        while True:
            rows, last, done = page(self.options, since)
            yield from rows
            if done or last <= since:
                return
            since = last


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"since": int(self.options.get("since", 0))}

    def read(self, start):
        rows, last, _ = page(self.options, start["since"])
        return iter(rows), {"since": last}

    def readBetweenOffsets(self, start, end):
        since = start["since"]
        while since < end["since"]:
            rows, last, done = page(self.options, since)
            yield from (r for r in rows if r[0] <= end["since"])
            if last <= since:
                return
            since = last


class ChangeFeed(DataSource):
    @classmethod
    def name(cls):
        return "change_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema):
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    from spindrift.shipping import ship

    ship(spark).dataSource.register(ChangeFeed)
