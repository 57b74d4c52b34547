"""Tables of rows by key that are changed by adding to them, with one commit over several of them.

A change writes what is new and nothing else: an upsert its rows, a delete the
keys that go.  A ledger's manifest lists each table's folders by age; a row
counts unless a newer folder has its key.  When the folders are many the newer
ones are merged, and all of them once they hold as much as half of the
oldest.  What no manifest names any more is deleted after a time.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a table beyond which they are merged.
MOST_FOLDERS = 8
#: Seconds that a folder stays which no manifest names: longer than any write and any read of a manifest that is replaced.
RETENTION = 24 * 3600


class Ledger:
    """Manifests of one or more tables in a folder; the last one counts.

    Within a transaction tables add to one new manifest, which becomes the last
    when it ends: a failure before that changes nothing.  A writer
    that finds its manifest taken by another raises FileExistsError and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, retention: float = RETENTION):
        self.spark, self.path, self.retention = spark, path.rstrip("/"), retention
        self.jvm = spark.sparkContext._jvm
        self._open: dict | None = None
        self._touched: set[str] = set()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def files(self, path: str):
        """The file system of a path."""
        return self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        return sorted(int(x.getPath().getName()[9:21]) for x in self.files(self.path).globStatus(self._at("manifest-*.json")) or [])

    def _manifest(self, number: int) -> dict:
        stream = self.files(self.path).open(self._at(f"manifest-{number:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The last manifest's number (-1 where there is none) and what it says: the next age and the tables' folders."""
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (-1, {"next": 0, "tables": {}})

    def state(self) -> dict:
        """What holds now: within a transaction with its changes."""
        return self._open if self._open is not None else self.last()[1]

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """What is changed inside becomes one manifest; one within another belongs to that."""
        if self._open is not None:
            yield
            return
        number, state = self.last()
        self._open, self._touched = copy.deepcopy(state), set()
        try:
            yield
            made = self._open
        finally:
            self._open = None
        if made != state:
            self._commit(number + 1, made)

    def _commit(self, number: int, made: dict) -> None:
        fs, target = self.files(self.path), self._at(f"manifest-{number:012d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:  # py4j wraps what the file system says
            raise FileExistsError(f"another writer was first at {target}") from e
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        for old in self._numbers()[:-2]:  # the manifest before stays for those who read it
            fs.delete(self._at(f"manifest-{old:012d}.json"), False)
        self.vacuum(self._touched)

    def add(self, name: str, path: str, entry: dict) -> None:
        """A folder for a table of the open manifest, newer than all before."""
        self._touched.add(path)
        self._open["tables"].setdefault(name, []).append(entry | {"age": self._open["next"]})
        self._open["next"] += 1

    def vacuum(self, paths: set[str]) -> int:
        """Delete folders of the tables at `paths` that neither of the last two manifests names and that are old enough; how many."""
        named = {e["folder"] for n in self._numbers()[-2:] for entries in self._manifest(n)["tables"].values() for e in entries}
        gone = 0
        for path in paths:
            fs = self.files(path)
            for x in fs.globStatus(self.jvm.org.apache.hadoop.fs.Path(f"{path}/data/*")) or []:
                if x.getPath().getName() not in named and x.getModificationTime() / 1000 <= time.time() - self.retention:
                    gone += bool(fs.delete(x.getPath(), True))
        return gone


class Table:
    """Rows by `key`; with `part`, a column of few values, each value's rows lie in folders of their own. Several tables may share a ledger under their names."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", part: str | None = None, ledger: Ledger | None = None, name: str = "rows"):
        self.spark, self.path, self.schema, self.key, self.part, self.name = spark, path.rstrip("/"), schema, key, part, name
        self.ledger = ledger or Ledger(spark, path)
        fields = StructType.fromDDL(schema)
        self.columns = fields.names
        self._kind = f"{key} {fields[key].dataType.simpleString()}"

    def _entries(self) -> list[dict]:
        return self.ledger.state()["tables"].get(self.name, [])

    def _folder(self, entry: dict, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{entry['folder']}")

    def _rows(self, entries: list[dict], parts: list[str] | None) -> DataFrame | None:
        """Rows of folders with their age (`_age`), of parts that have not been purged."""
        found = []
        for e in entries:
            live = [p for p in e["parts"] if parts is None or p in parts] if e["kind"] == "rows" else []
            if live:
                df = self._folder(e, f"{self.schema}, _part string")
                # a partition of empty values is read back as null
                found.append(df.filter(F.coalesce("_part", F.lit("")).isin(live)).select(*self.columns, F.lit(e["age"]).alias("_age")))
        return reduce(lambda a, b: a.unionByName(b), found) if found else None

    def _ages(self, entries: list[dict]) -> DataFrame | None:
        """(key, _newest): the greatest age of each key in folders of rows or of keys that went."""
        found = [self._folder(e, self._kind).select(self.key, F.lit(e["age"]).alias("_newest")) for e in entries]
        return reduce(lambda a, b: a.unionByName(b), found).groupBy(self.key).agg(F.max("_newest").alias("_newest")) if found else None

    def _live(self, entries: list[dict], parts: list[str] | None = None) -> DataFrame:
        rows = self._rows(entries, parts)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        newer = self._ages([e for e in entries if e["age"] > min(x["age"] for x in entries if x["kind"] == "rows")])
        if newer is not None:
            rows = rows.join(newer, self.key, "left").filter(F.col("_newest").isNull() | (F.col("_age") >= F.col("_newest")))
        return rows.select(*self.columns)

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some parts, whose folders alone are read."""
        return self._live(self._entries(), parts)

    def _write_rows(self, rows: DataFrame) -> dict:
        """A folder of rows; a key that it has twice raises an error."""
        folder = uuid.uuid4().hex
        part = F.coalesce(F.col(self.part).cast("string"), F.lit("")) if self.part else F.lit("")
        rows.select(*self.columns, part.alias("_part")).write.partitionBy("_part").parquet(f"{self.path}/data/{folder}")
        entry = {"kind": "rows", "folder": folder, "parts": [], "rows": 0}
        made = self._folder(entry, f"{self._kind}, _part string")
        keys = made.groupBy(self.key).agg(F.count("*").alias("n"), F.first("_part").alias("_part"))
        for r in keys.groupBy("_part").agg(F.sum("n").alias("rows"), F.max(F.struct("n", F.col(self.key).cast("string").alias("key"))).alias("most")).collect():  # parts are few
            if r.most.n > 1:
                raise ValueError(f"key {r.most.key!r} is there {r.most.n} times")
            entry["parts"].append(r["_part"] or "")
            entry["rows"] += r.rows
        return entry

    def _write_keys(self, keys: DataFrame) -> dict:
        folder = uuid.uuid4().hex
        keys.select(self.key).distinct().write.parquet(f"{self.path}/data/{folder}")
        entry = {"kind": "gone", "folder": folder, "parts": []}
        return entry | {"rows": self._folder(entry, self._kind).count()}

    def _add(self, entry: dict) -> None:
        if entry["rows"]:
            self.ledger.add(self.name, self.path, entry)
            if len(self._entries()) > MOST_FOLDERS:
                self.merge()

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same key; as much is written as there are rows."""
        with self.ledger.transaction():
            self._add(self._write_rows(rows))

    def delete(self, condition: Column | None) -> None:
        """Rows that fulfil `condition` go; none at all is refused."""
        if condition is None:
            raise ValueError("an empty filter would delete everything")
        with self.ledger.transaction():
            self._add(self._write_keys(self.read().filter(F.coalesce(condition, F.lit(False)))))

    def delete_ids(self, ids: DataFrame) -> None:
        """Rows whose key stands in `ids` go; the table is not read."""
        with self.ledger.transaction():
            self._add(self._write_keys(ids))

    def purge(self, part: str) -> None:
        """All rows of a part go, without reading them."""
        with self.ledger.transaction():
            for e in self._entries():
                if part in e["parts"]:
                    e["parts"].remove(part)
                    self.ledger._touched.add(self.path)

    def merge(self, everything: bool = False) -> None:
        """Fewer folders: the newer ones become one, and all do where those hold half as many rows as the oldest or `everything` is wanted."""
        with self.ledger.transaction():
            entries = self._entries()
            if len(entries) < 2:
                return
            oldest, newer = entries[0], entries[1:]
            if everything or oldest["kind"] == "gone" or 2 * sum(e["rows"] for e in newer) >= oldest["rows"]:
                made = [self._write_rows(self._live(entries))]
                kept = []
            else:
                one = self._write_rows(self._live(newer))
                # keys of the merged folders whose rows went, or whose part was purged, still hide older rows
                hidden = self._ages(newer).join(self._folder(one, self._kind), self.key, "left_anti")
                made, kept = [one, self._write_keys(hidden)], [oldest]
            self.ledger.state()["tables"][self.name] = kept
            for e in made:
                if e["rows"]:
                    self.ledger.add(self.name, self.path, e)
