"""Tables that are published together.

A group of tables lives under one folder.  Rows are written beside what readers
see, into folders of a new generation (``<table>/<by>=<value>/gen=<id>``), and one
small pointer file (``_versions/<number>.json``) then names, per table and
partition, the folders that count.  A reader takes the greatest pointer, so it
sees the old state or the new one, of all tables at once, whatever a lost driver
has left behind:

1. rows written beside -- nothing points at them yet;
2. pointer written under another name -- not a version yet;
3. pointer renamed into place -- the new state.

Nothing is moved or deleted on the way, a job may read the table it replaces, and
a run repeated after a loss starts from the old state.  ``clean`` removes folders
that the last versions do not name.  Partition values are few (years, periods):
pointers are metadata.  One writer at a time; a second one is told.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_DIR = "__HIVE_DEFAULT_PARTITION__"
WHOLE = "*"               # the one "partition" of a table without a partition column
ROWS = "rows"             # the table of a group that holds one


class ConcurrentPublish(RuntimeError):
    """Another writer has published since this one read the state."""


def step(name: str) -> None:
    """Called between the steps of a publication (a place for tests to stop)."""


def part_key(value: Any) -> str:
    return NULL_DIR if value is None else str(value)


@dataclass
class Change:
    """New rows of a table.  ``parts`` are the partition values that ``rows``
    replace (one without a row goes); None: the whole table.  ``append`` adds."""
    rows: DataFrame
    by: str | None = None
    parts: Sequence[Any] | None = None
    append: bool = False
    facts: dict[str, Any] = field(default_factory=dict)    # small notes kept with the table


class TableGroup:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # ---- files -------------------------------------------------------------
    def _path(self, *names: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *names)))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, *names: str) -> list[str]:
        fs, p = self._path(*names)
        return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []

    # ---- state -------------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """What a version's pointer says; the last one's without a number."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "tables": {}}
            version = found[-1]
        fs, p = self._path("_versions", f"{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has(self, table: str = ROWS) -> bool:
        return table in self.state()["tables"]

    def facts(self, table: str = ROWS) -> dict:
        return self.state()["tables"].get(table, {}).get("facts", {})

    def read(self, table: str = ROWS, version: int | None = None) -> DataFrame:
        """The rows of a table as one version has them."""
        t = self.state(version)["tables"][table]
        schema = T.StructType.fromJson(t["schema"])
        root = f"{self.base}/{table}"
        dirs = [f"{root}/{t['by']}={v}/gen={g}" if t["by"] else f"{root}/gen={g}" for v, gens in sorted(t["parts"].items()) for g in gens]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", root).schema(schema).parquet(*dirs).select(*schema.fieldNames())

    # ---- publication ---------------------------------------------------------
    def publish(self, changes: dict[str, Change]) -> int:
        """Publishes new rows of several tables as one version."""
        old = self.state()
        staged = {}
        for name, c in changes.items():
            staged[name] = self.stage(name, c, old["tables"].get(name))
            step(f"rows of {name} written")
        return self.commit(staged, old)

    def commit(self, staged: dict[str, dict], old: dict | None = None) -> int:
        """Points readers at staged tables; the group's other tables stay."""
        old = old or self.state()
        new = {"version": old["version"] + 1, "tables": {**old["tables"], **staged}}
        tmp = f"{uuid.uuid4().hex}.tmp"
        fs, p = self._path("_versions", tmp)
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        step("pointer written")
        _, final = self._path("_versions", f"{new['version']:012d}.json")
        if fs.exists(final) or not fs.rename(p, final):
            fs.delete(p, False)
            raise ConcurrentPublish(f"version {new['version']} of {self.base} exists")
        step("pointer renamed")
        return new["version"]

    def stage(self, name: str, c: Change, old: dict | None) -> dict:
        """Writes rows beside the table ``old`` (an entry of a state, or of an
        earlier stage); returns the entry that has them.  Readers see nothing."""
        gen = uuid.uuid4().hex
        root = f"{self.base}/{name}"
        w = c.rows.withColumn("gen", F.lit(gen)).write.mode("append")
        w.partitionBy(*([c.by] if c.by else []), "gen").parquet(root)
        if c.by:
            fs, p = self._path(name, f"{c.by}=*", f"gen={gen}")
            got = [st.getPath().getParent().getName().split("=", 1)[1] for st in (fs.globStatus(p) or [])]
        else:
            fs, p = self._path(name, f"gen={gen}")
            got = [WHOLE] if fs.exists(p) else []
        parts = {v: list(g) for v, g in (old or {}).get("parts", {}).items()}
        if old and old["by"] != c.by and (c.append or c.parts is not None):
            raise ValueError(f"{name} is partitioned by {old['by']}, not by {c.by}")
        if c.append:
            for v in got:
                parts.setdefault(v, []).append(gen)
        else:
            gone = set(parts) if c.parts is None else {part_key(v) for v in c.parts}
            if c.parts is not None and not set(got) <= gone:
                raise ValueError(f"rows of {name} outside the replaced partitions: {sorted(set(got) - gone)}")
            parts = {v: g for v, g in parts.items() if v not in gone} | {v: [gen] for v in got}
        # a delivery with extra fields widens the table (B17); older rows read them as NULL
        schema = c.rows.schema
        if old and (c.append or c.parts is not None):
            known = T.StructType.fromJson(old["schema"])
            names = set(known.fieldNames())
            schema = T.StructType(known.fields + [f for f in schema.fields if f.name not in names])
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        return {"by": c.by, "schema": schema.jsonValue(), "parts": parts, "facts": {**(old or {}).get("facts", {}), **c.facts}}

    def clean(self, keep: int = 2) -> list[str]:
        """Removes pointers before the last ``keep`` versions, and all folders of
        rows that no kept version names (also what lost runs left).  Run it when
        no reader may still hold an older version."""
        kept = self.versions()[-keep:]
        named = {(name, v, g) for n in kept for name, t in self.state(n)["tables"].items() for v, gens in t["parts"].items() for g in gens}
        removed = []
        for name in self._names():
            if name == "_versions":
                continue
            fs, top = self._path(name)
            for pattern, depth in ((f"{name}/gen=*", 1), (f"{name}/*=*/gen=*", 2)):
                _, p = self._path(pattern)
                for st in fs.globStatus(p) or []:
                    at = st.getPath()
                    value = WHOLE if depth == 1 else at.getParent().getName().split("=", 1)[1]
                    if (name, value, at.getName().split("=", 1)[1]) not in named:
                        fs.delete(at, True)
                        removed.append(at.toString())
        for n in self._names("_versions"):
            if not n.endswith(".json") or int(n[:-5]) not in kept:
                fs, p = self._path("_versions", n)
                fs.delete(p, False)
        return removed


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published table that is alone under ``path``."""
    return TableGroup(spark, path).read()


def table_exists(spark: SparkSession, path: str) -> bool:
    return TableGroup(spark, path).has()
