"""A store of immutable shards with size-tiered compaction and an atomic, versioned manifest.

An append writes small shards and commits a manifest that names them.  Shards of
similar size (a power of ``FAN`` apart at most) form a tier; ``FAN`` of a tier are
merged into one of the next, until a shard reaches the target size.  The merges
are planned over sizes alone, and merges of merges are folded: every shard is
rewritten once.  Readers see old or new shards, never both.

A version is committed by a claim, a small file that must not exist yet, which names
the manifest that was written before it.  No manifest and no claim is ever deleted
or written over.  A writer that lost the race puts its shards on top of the version
that won, if what it takes away is still there.  A claim that its writer left
unfinished is passed over after ``LEASE_MS``: its number stays unused.

Nulls, repeated rows and columns of any name come back as they were appended; a
column that some shards do not have is null in their rows, and an append whose column
has another type than before is refused.  An empty table appends a version without
new shards.
"""

from __future__ import annotations

import heapq
import json
import math
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import others

FAN, LEAST_BYTES, TARGET_BYTES = 4, 1 << 20, 128 << 20
FILE_BYTES = 32 << 20  # of one file of a merged shard, about
WAVE = 4096  # shards that are merged at once, about
LEASE_MS = 60_000  # after which an unfinished claim counts as given up
OPEN_MS = 24 * 3_600_000  # after which a write without a commit counts as given up
TRIES = 20  # to commit against other writers
PLACE = r"/data/([0-9a-f]+)/_shard_*=([^/]+)/"
ARRIVALS = 8  # shards that each task of an append writes


class Conflict(RuntimeError):
    """Another writer committed first, or may still do so."""


class SchemaConflict(ValueError):
    """A column of an append has another type than the store's."""


def merged_schema(old: str, new: StructType) -> str:
    """The columns of both (JSON), all nullable; names are one whatever their case, and must have one type."""
    fields = {f.name.lower(): f for f in (StructType.fromJson(json.loads(old)) if old else StructType()).fields}
    for f in new.fields:
        known = fields.get(f.name.lower())
        if known is not None and known.dataType != f.dataType:
            raise SchemaConflict(f"column {f.name} is {f.dataType.simpleString()}, in the store {known.dataType.simpleString()}")
        fields.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
    return StructType(list(fields.values())).json()


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    after: int = 0  # the version that it was made from
    shards: dict[str, dict] = field(default_factory=dict)  # id: rows, bytes, path


def tier(size: int, fan: int = FAN, least: int = LEAST_BYTES) -> int:
    return max(0, math.floor(math.log(max(size, 1) / least, fan))) if size >= least else 0


def plan(sizes: dict[str, int], fan: int = FAN, least: int = LEAST_BYTES, target: int = TARGET_BYTES) -> list[list[str]]:
    """Groups of shards to merge.  Shards of the target size or more are left alone; ties go by id.

    The smallest tier that is full gives its smallest runs to the next merge.
    Each tier is a heap, so planning takes n log n steps.
    """
    tiers: dict[int, list] = {}

    def put(size: int, names: list[str]) -> None:
        if size < target:
            heapq.heappush(tiers.setdefault(tier(size, fan, least), []), (size, names[0], names))
        elif len(names) > 1:
            out.append(sorted(names))

    out: list[list[str]] = []
    for name, size in sizes.items():
        put(size, [name])
    while full := [t for t, runs in tiers.items() if len(runs) >= fan]:
        runs, taken, total = tiers[min(full)], [], 0
        while runs and len(taken) < fan and total < target:
            taken.append(heapq.heappop(runs))
            total += taken[-1][0]
        put(total, sorted(n for t in taken for n in t[2]))
    return sorted(out + [sorted(names) for runs in tiers.values() for _, _, names in runs if len(names) > 1])


class ShardStore:
    """Shards below a path in any file system that Spark can use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _versions(self) -> list[int]:
        at = self._at("manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)

    def _text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self.fs.create(self._at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _claimed(self, name: str):
        """A new file to write to; ``FileExistsError`` if there is one.

        Creation must be exclusive.  Stores of a cluster see to that; Hadoop's
        local file system looks first and creates then, so the operating system
        is asked instead.
        """
        at = self._at(name)
        if self.fs.getUri().getScheme() == "file":
            return open(at.toUri().getPath(), "xb")
        try:
            return self.fs.create(at, False)
        except Py4JJavaError as e:
            raise FileExistsError(name) from e

    def _claim(self, version: int) -> str | None:
        """The writer that a version's claim names; null if the claim is unfinished, empty if its writer gave it up."""
        try:
            return json.loads(self._text(f"manifest/v{version:08d}.json"))["writer"]
        except (ValueError, KeyError, TypeError):
            return None

    def _content(self, version: int) -> Manifest | None:
        writer = self._claim(version)
        return Manifest(**json.loads(self._text(f"manifest/m{version:08d}-{writer}.json"))) if writer else None

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or the latest that is complete; version 0 is empty."""
        for v in self._versions() if version is None else [version] * (version > 0):
            found = self._content(v)
            if found is not None:
                return found
            if version is not None:
                raise LookupError(f"version {version} was never finished")
        return Manifest()

    def _abandoned(self, version: int) -> bool:
        """Whether a claim without a writer is older than the lease, or was given up."""
        if self._claim(version) == "":
            return True
        return int(time.time() * 1000) - self.fs.getFileStatus(self._at(f"manifest/v{version:08d}.json")).getModificationTime() >= LEASE_MS

    def commit(self, new: Manifest) -> None:
        """Commit the next version after the latest complete one.

        Its number must be above every claim, and claims between must have been
        abandoned.  A writer that was only slow may finish such a claim late.  So
        each side looks at the other after its own mark is set: this one, once its
        claim exists, at the claims it passed over, and gives up if one of them has a
        writer after all; the slow one, once its claim has its writer, at claims
        above, and waits for what becomes of them.
        """
        self.fs.mkdirs(self._at("manifest"))
        latest, claims = self.manifest().version, self._versions()
        if new.version <= max(claims, default=0):
            raise Conflict(f"version {new.version} exists")
        if new.after != latest:
            raise Conflict(f"version {latest} came after {new.after}")
        passed = [v for v in claims if v > latest]
        if not all(map(self._abandoned, passed)):
            raise Conflict(f"version {max(passed)} is being written")
        writer, name = uuid.uuid4().hex, f"manifest/v{new.version:08d}.json"
        self._put(f"manifest/m{new.version:08d}-{writer}.json", json.dumps(new.__dict__, sort_keys=True))
        try:
            out = self._claimed(name)
        except FileExistsError as e:
            raise Conflict(f"version {new.version} exists") from e
        late = any(self._claim(v) for v in passed)
        out.write(bytearray(json.dumps({"writer": "" if late else writer}).encode()))
        out.close()
        if late:
            raise Conflict(f"a version before {new.version} was finished late")
        for above in [v for v in self._versions() if v > new.version]:
            while self._claim(above) is None and not self._abandoned(above):
                time.sleep(0.5)
            found = self._content(above)
            if found is not None and found.after < new.version:
                raise Conflict(f"version {above} passed over {new.version}")

    def _change(self, gone: set[str], written: dict[str, dict], schema: StructType | None = None) -> Manifest:
        """Commit what was written in place of what goes, on top of whatever version is the latest."""
        for _ in range(TRIES):
            old, claims = self.manifest(), self._versions()
            if not gone <= old.shards.keys():
                raise Conflict("shards that were merged are gone")
            shards = {**{k: v for k, v in old.shards.items() if k not in gone}, **written}
            new = Manifest(max(claims, default=0) + 1, merged_schema(old.schema, schema) if schema is not None else old.schema, old.version, shards)
            try:
                self.commit(new)
                return new
            except Conflict:
                if self.manifest().version == old.version:  # nobody won: a claim is unfinished
                    raise
        raise Conflict(f"lost {TRIES} races")

    def _write(self, run: str, df: DataFrame, shard: Column, what: str = "*") -> dict[str, dict]:
        """Write rows by shard; what was written, by shard id.  All columns of ``df`` are kept beside it."""
        name = "_shard"
        while name in {c.lower() for c in df.select(what).columns}:
            name += "_"
        base = f"{self.path}/data/{run}"
        value = F.coalesce(shard.cast("string"), F.lit("null"))
        plain = F.when(value.rlike(r"^[A-Za-z0-9_-]+\z"), value).otherwise(F.concat(F.lit("x"), F.md5(value)))  # paths escape other names
        df.select(what, plain.alias(name)).write.option("compression", "zstd").partitionBy(name).parquet(base)
        out = {}
        for s in self.fs.listStatus(self._at(f"data/{run}")):
            folder = s.getPath().getName()
            if folder.startswith(f"{name}="):
                out[f"{run}-{folder[len(name) + 1 :]}"] = {"path": f"data/{run}/{folder}", "bytes": int(self.fs.getContentSummary(s.getPath()).getLength())}
        return out

    def _opened(self):
        """A marker for a run that is being written, so that ``vacuum`` spares it."""
        run = uuid.uuid4().hex[:12]
        self._put(f"open/{run}", "")
        return run

    def _closed(self, *runs: str) -> None:
        for run in runs:
            self.fs.delete(self._at(f"open/{run}"), False)

    def append(self, df: DataFrame, shard: str | Column) -> Manifest:
        """Add rows as new shards, named by the values of ``shard``; a column of that name stays in the rows.

        Columns may be fewer or more than before.  ``SchemaConflict`` is raised
        before anything is written.
        """
        merged_schema(self.manifest().schema, df.schema)
        run = self._opened()
        try:
            return self._change(set(), self._write(run, df, F.col(shard) if isinstance(shard, str) else shard), df.schema)
        finally:
            self._closed(run)

    def compact(self, **how) -> Manifest:
        """Merge shards by ``plan`` and commit the result; unchanged if there is nothing to merge.

        Merges run in waves of ``WAVE`` shards, about, so that the table of what
        goes where, which is broadcast, has a bound.
        """
        old = self.manifest()
        groups = plan({k: v["bytes"] for k, v in old.shards.items()}, **how)
        if not groups:
            return old
        written, wave, runs = {}, [], []
        try:
            for k, names in enumerate(groups):
                wave.append(names)
                if k + 1 == len(groups) or sum(map(len, wave)) >= WAVE:
                    runs.append(self._opened())
                    written |= self._merge(runs[-1], old, wave)
                    wave = []
            return self._change({name for names in groups for name in names}, written)
        finally:
            self._closed(*runs)

    def _merge(self, run: str, old: Manifest, groups: list[list[str]]) -> dict[str, dict]:
        """Write each group as one shard, by a task for each of its files."""
        files = [max(1, -(-sum(old.shards[n]["bytes"] for n in names) // FILE_BYTES)) for names in groups]
        first = [sum(files[:i]) for i in range(len(files))]
        names = self.spark.createDataFrame([(n, i, first[i], files[i]) for i, ns in enumerate(groups) for n in ns], "shard string, grp int, first int, files int")
        rows = self._rows(old.schema, [old.shards[n] for ns in groups for n in ns])
        held = rows.select(F.struct(*others(rows)).alias("doc"), self._shard_of(rows).alias("shard"), rows.metadataColumn("_metadata")["row_index"].alias("row"))
        if sum(map(len, groups)) <= 2 * WAVE:
            names = F.broadcast(names)
        # The place in the input spreads copies of a row as well.
        placed = held.join(names, "shard").repartitionById(sum(files), (F.col("first") + F.pmod("row", "files")).cast("int"))
        return self._write(run, placed.select("doc", "grp"), F.col("grp"), "doc.*")

    def _shard_of(self, rows: DataFrame) -> Column:
        path = rows.metadataColumn("_metadata")["file_path"]
        return F.concat_ws("-", F.regexp_extract(path, PLACE, 1), F.regexp_extract(path, PLACE, 2))

    def _rows(self, schema: str, shards: list[dict]) -> DataFrame:
        typed = StructType.fromJson(json.loads(schema)) if schema else StructType()
        return self.spark.read.schema(typed).parquet(*[f"{self.path}/{v['path']}" for v in shards]) if shards else self.spark.createDataFrame([], typed)

    def read(self, manifest: Manifest | None = None, shard: str | None = "_shard_id") -> DataFrame:
        """Rows of a version with the id of their shard in the column ``shard``, or without it (None).

        A column of the rows with that name is replaced.
        """
        m = manifest or self.manifest()
        rows = self._rows(m.schema, list(m.shards.values()))
        if shard is None:
            return rows
        return rows.select(*others(rows, shard), (self._shard_of(rows) if m.shards else F.lit(None).cast("string")).alias(shard))

    def vacuum(self) -> int:
        """Delete shards that the latest version does not name; readers of older versions must be done.

        Runs of writes that have not committed yet are spared, until ``OPEN_MS``
        after their start.  What is there is listed first, then what is open, then
        the manifest: a run that is in neither of the last two was given up.
        """
        if not self.fs.exists(self._at("data")):
            return 0
        there = [r.getPath() for r in self.fs.listStatus(self._at("data"))]
        now = time.time() * 1000
        marks = self.fs.listStatus(self._at("open")) if self.fs.exists(self._at("open")) else []
        open_ = {m.getPath().getName() for m in marks if now - m.getModificationTime() < OPEN_MS}
        used, gone = {v["path"] for v in self.manifest().shards.values()}, 0
        for run in there:
            name = run.getName()
            if name in open_:
                continue
            shards = [s.getPath() for s in self.fs.listStatus(run) if s.getPath().getName().startswith("_shard")]
            idle = [s for s in shards if f"data/{name}/{s.getName()}" not in used]
            for path in idle if len(idle) < len(shards) else [run]:
                self.fs.delete(path, True)
            gone += len(idle)
        return gone


def arrivals(df: DataFrame, each: int = ARRIVALS):
    """Names of arriving shards: each input task brings ``each`` of them; nothing is shuffled."""
    return F.spark_partition_id() * each + F.pmod(F.xxhash64("doc_id"), F.lit(each))
