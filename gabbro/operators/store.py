"""A versioned table store over plain Parquet: commits, time travel, restore, merge, change feed.

A table is a folder with data files in data/ and a log in _log/. Every commit is one JSON file
_log/N.json {op, add, remove, props, schema, ...}, created exclusively: of two writers that started from
the same version one wins, and the other gets ConflictError and may try again. Data files are never
changed, so a version is a list of files, and RESTORE is a commit that lists an old version's files.
Every CHECKPOINT commits the state is written beside the log; a reader starts there, and keeps commits
it has read, which never change.

Rows are written first; constraints are checked on the files written, and only then they are committed.
UPDATE, DELETE and MERGE find the files that hold rows they change and rewrite only those; the change
feed compares only the files that a commit added and removed. A partitioned table also has the values
of its partition columns in the names of its files, by which `read` leaves files out.

All data work is DataFrame plans; the log holds file names and counters only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gabbro.sources.files import Files


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


class ConstraintError(ValueError):
    """Rows break a constraint; nothing was committed."""


CHECKPOINT = 20
#: Operations that only add rows; REPLACE begins anew.
APPENDING = ("APPEND", "COPY INTO", "REPLACE", "CLONE")
#: Folder names of partitions: a copy of the column, so that the files hold the column itself, too.
PART = "_by_"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self._read: dict[str, dict] = {}

    # ---------------------------------------------------------------- log

    def _names(self, end: str = ".json") -> list[str]:
        return sorted(n for n, _, _ in self.files.list(f"{self.path}/_log") if n.endswith(end))

    def _entry(self, name: str) -> dict:
        if name not in self._read:
            self._read[name] = json.loads(self.files.read(name))
        return self._read[name]

    def log(self) -> list[dict]:
        return [self._entry(n) for n in self._names()]

    def version(self) -> int:
        return len(self._names()) - 1

    def _state(self, version: int | None = None) -> dict:
        """The table's files, schema and so on at a version, from the last checkpoint before it."""
        names = self._names()[: None if version is None else version + 1]
        state = {"files": [], "schema": None, "props": {}, "constraints": {}, "comment": None, "column_comments": {}, "ledger": {}, "partition_by": []}
        first = 0
        for n in reversed(self._names(".checkpoint")):
            at = int(n.rsplit("/", 1)[1].split(".")[0])
            if at < len(names):
                state, first = json.loads(json.dumps(self._entry(n))), at + 1
                break
        for n in names[first:]:
            c = self._entry(n)
            gone = set(c.get("remove", []))
            state["files"] = [f for f in state["files"] if f not in gone] + c.get("add", [])
            for k in ("props", "constraints", "column_comments", "ledger"):
                state[k] |= c.get(k, {})
            state["constraints"] = {k: v for k, v in state["constraints"].items() if v}
            for k in ("schema", "comment", "partition_by"):
                state[k] = c.get(k, state[k])
        return state

    def _commit(self, op: str, base: int, **what) -> int:
        entry = {"version": base + 1, "op": op, "timestamp_ms": int(time.time() * 1000)} | what
        name = f"{self.path}/_log/{base + 1:010d}"
        if not self.files.create(f"{name}.json", json.dumps(entry)):
            raise ConflictError(f"version {base + 1} of {self.path} is there already")
        if (base + 1) % CHECKPOINT == CHECKPOINT - 1:
            self.files.create(f"{name}.checkpoint", json.dumps(self._state(base + 1)))
        return base + 1

    def _write(self, df: DataFrame, check: bool = True, partition_by: Sequence[str] | None = None) -> list[str]:
        """Writes rows to new files, checks the constraints on what was written, and returns the files."""
        by = self._state()["partition_by"] if partition_by is None else list(partition_by)
        run = uuid.uuid4().hex
        folder = f"{self.path}/data/{run}"
        out = df.withColumns({PART + c: F.col(c) for c in by}) if by else df
        writer = out.write.partitionBy(*[PART + c for c in by]) if by else out.write
        writer.parquet(folder)
        if check:
            try:
                self._check(self.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder))
            except ConstraintError:
                self.files.delete(folder)
                raise
        return [run + n.rsplit(run, 1)[1] for n, _, _ in self.files.list(folder, deep=True) if n.endswith(".parquet")]

    def _check(self, df: DataFrame) -> None:
        rules = self._state()["constraints"]
        if rules:
            # all rules in one pass; a check that is null holds, as in SQL
            row = df.agg(*[F.count_if(~F.coalesce(F.expr(sql), F.lit(True))).alias(n) for n, sql in rules.items()]).first()
            bad = {n: row[n] for n in rules if row[n]}
            if bad:
                raise ConstraintError(f"rows against constraints: {bad}")

    # ---------------------------------------------------------------- reading

    def version_at(self, timestamp_ms: int) -> int:
        """The last version at a time."""
        at = [c["version"] for c in self.log() if c["timestamp_ms"] <= timestamp_ms]
        if not at:
            raise ValueError("no version that early")
        return at[-1]

    def read(self, version: int | None = None, timestamp_ms: int | None = None, partitions: dict[str, Sequence] | None = None) -> DataFrame:
        """The table now, as of a version, or as of the last version at a time. partitions: wanted values by
        partition column; files of other values are not opened."""
        if timestamp_ms is not None:
            version = self.version_at(timestamp_ms)
        if self.version() < 0:
            raise ValueError(f"{self.path} is no table: it has no commits")
        if version is not None and not 0 <= version <= self.version():
            raise ValueError(f"no version {version}")
        state = self._state(version)
        if state["schema"] is None:
            raise ValueError(f"{self.path} has no schema at this version")
        files = state["files"]
        for c, values in (partitions or {}).items():
            if c not in state["partition_by"]:
                raise ValueError(f"{c} is no partition column")
            want = {None if v is None else str(v) for v in values}
            files = [f for f in files if partition_value(f, c) in want]
        return self._rows(files, StructType.fromJson(json.loads(state["schema"])))

    def _rows(self, files: Sequence[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._full(f) for f in files])

    def added(self, version: int) -> DataFrame:
        """The rows of the files that a version added."""
        return self._rows(self._entry(self._names()[version]).get("add", []), StructType.fromJson(json.loads(self._state(version)["schema"])))

    def _full(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{self.path}/data/{name}"

    def _holding(self, rows: DataFrame, files: Sequence[str]) -> list[str]:
        """Those of the table's files that rows (of a read, with `_file`) come from. Their names reach the
        driver, which has the whole list in the log anyway."""
        found = {unquote(r[0]).split(":", 1)[-1].lstrip("/") for r in rows.select("_file").distinct().collect()}
        return [f for f in files if unquote(self._full(f)).split(":", 1)[-1].lstrip("/") in found]

    def history(self) -> DataFrame:
        rows = [(c["version"], c["op"], c["timestamp_ms"], len(c.get("add", [])), len(c.get("remove", [])), json.dumps(c.get("metrics", {}))) for c in self.log()]
        return self.spark.createDataFrame(rows, "version int, op string, timestamp_ms long, files_added int, files_removed int, metrics string")

    def detail(self) -> DataFrame:
        state = self._state()
        size = {n.rsplit("/data/", 1)[-1]: b for n, b, _ in self.files.list(f"{self.path}/data", deep=True)}
        props = state["props"]
        row = (self.path, self.version(), len(state["files"]), sum(size.get(f, 0) for f in state["files"]), [c for c in props.get("clustering", "").split(",") if c], props, state["comment"])
        return self.spark.createDataFrame([row], "path string, version int, num_files int, bytes long, clustering array<string>, props map<string,string>, comment string")

    # ---------------------------------------------------------------- writing

    def replace(self, df: DataFrame, overwrite_schema: bool = False, op: str = "REPLACE", partition_by: Sequence[str] = ()) -> int:
        base, state = self.version(), self._state()
        if state["schema"] and not overwrite_schema and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(state["schema"]))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the schema differs; pass overwrite_schema")
        added = self._write(df, partition_by=partition_by)
        return self._commit(op, base, add=added, remove=state["files"], schema=df.schema.json(), partition_by=list(partition_by))

    def create(self, schema: StructType | str, comments: dict[str, str] | None = None, if_absent: bool = True, partition_by: Sequence[str] = ()) -> bool:
        """An empty table with column comments; False if there is one already (an error unless if_absent)."""
        if self.version() >= 0:
            if not if_absent:
                raise ValueError(f"{self.path} is there already")
            return False
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._commit("CREATE", -1, schema=schema.json(), column_comments=comments or {}, partition_by=list(partition_by))
        return True

    def append(self, df: DataFrame, merge_schema: bool = False, ledger: dict | None = None, op: str = "APPEND") -> int:
        base, state = self.version(), self._state()
        extra = {"ledger": ledger} if ledger else {}
        if state["schema"] is None:
            return self._commit(op, base, add=self._write(df), schema=df.schema.json(), **extra)
        old = StructType.fromJson(json.loads(state["schema"]))
        new = [f for f in df.schema if f.name not in old.names]
        if new and not merge_schema:
            raise ValueError(f"columns {[f.name for f in new]} are new; pass merge_schema")
        wide = StructType([*old.fields, *new])
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wide]
        return self._commit(op, base, add=self._write(df.select(*cols)), schema=wide.json(), **extra)

    def truncate(self) -> int:
        """No rows are left; which source files were loaded stays known."""
        base, state = self.version(), self._state()
        return self._commit("TRUNCATE", base, remove=state["files"])

    def _rewrite(self, op: str, base: int, state: dict, touched: Sequence[str], df: DataFrame | None, **metrics) -> int:
        added = self._write(df) if df is not None else []
        return self._commit(op, base, add=added, remove=list(touched), metrics=metrics | {"files_rewritten": len(touched)})

    def _with_files(self, base: int) -> DataFrame:
        df = self.read(base)
        return df.withColumn("_file", F.col("_metadata.file_path")) if self._state(base)["files"] else df.withColumn("_file", F.lit(None).cast("string"))

    def delete(self, where: str) -> int:
        """Rewrites the files that hold rows to delete."""
        base, state = self.version(), self._state()
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched = self._holding(self._with_files(base).filter(hit), state["files"])
        rows = self._rows(touched, StructType.fromJson(json.loads(state["schema"])))
        return self._rewrite("DELETE", base, state, touched, rows.filter(~hit) if touched else None)

    def update(self, where: str, values: dict[str, str]) -> int:
        """Rewrites the files that hold rows to update."""
        base, state = self.version(), self._state()
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched = self._holding(self._with_files(base).filter(hit), state["files"])
        df = self._rows(touched, StructType.fromJson(json.loads(state["schema"])))
        types = dict(df.dtypes)
        out = df.select(*[F.when(hit, F.expr(values[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
        return self._rewrite("UPDATE", base, state, touched, out if touched else None)

    def merge(self, source: DataFrame, on: Sequence[str], update: bool = True, insert: bool = True, delete_when: Column | None = None, merge_schema: bool = False) -> int:
        """Upsert by key. A source key that occurs twice is an error (which row would win?); null keys
        never match; columns that the target lacks are an error unless merge_schema; columns the source
        lacks keep their values. Only files with a key of the source are rewritten, by one full outer join."""
        base, state = self.version(), self._state()
        new = [f for f in source.schema if f.name not in self.read(base).columns]
        if new and not merge_schema:
            raise ValueError(f"columns {[f.name for f in new]} are new; pass merge_schema")
        schema = StructType([*StructType.fromJson(json.loads(state["schema"])).fields, *new])
        if source.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > 1).filter(" and ".join(f"{k} is not null" for k in on)).limit(1).count():
            raise ValueError("merge source: a key occurs more than once")
        keys = source.select(*[F.col(k).alias(f"_k_{k}") for k in on])
        held = self._with_files(base)
        same = F.lit(True)
        for k in on:
            same = same & (held[k] == keys[f"_k_{k}"])
        touched = self._holding(held.join(keys, same, "left_semi"), state["files"])
        target = self._rows(touched, schema)
        s = source.withColumn("_del", F.coalesce(delete_when if delete_when is not None else F.lit(False), F.lit(False)))
        s = s.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], "_del", F.lit(True).alias("_in_s"))
        t = target.withColumn("_in_t", F.lit(True))
        cond = F.lit(True)
        for k in on:
            cond = cond & (t[k] == s[f"_s_{k}"])
        j = t.join(s, cond, "full_outer")
        both, only_s = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull(), F.col("_in_t").isNull()
        keep = ~F.coalesce(F.col("_del"), F.lit(False))
        if not insert:
            keep = keep & ~only_s
        take = only_s | (both if update else F.lit(False))
        cols = [F.when(take, F.col(f"_s_{c}").cast(dict(target.dtypes)[c])).otherwise(F.col(c)).alias(c) if c in source.columns else F.col(c) for c in target.columns]
        added = self._write(j.filter(keep).select(*cols))
        return self._commit("MERGE", base, add=added, remove=touched, metrics={"files_rewritten": len(touched)}, **({"schema": schema.json()} if new else {}))

    # ---------------------------------------------------------------- versions

    def restore(self, version: int | None = None, timestamp_ms: int | None = None) -> int:
        """Back to a version, or to the last one at a time. All its files have to be there still."""
        if version is None:
            version = self.version_at(timestamp_ms)
        base, now, then = self.version(), self._state(), self._state(version)
        there = {n.rsplit("/data/", 1)[1] for n, _, _ in self.files.list(f"{self.path}/data", deep=True)}
        gone = [f for f in then["files"] if f not in there and not (self._full(f) == f and self.files.exists(f))]
        if gone:
            raise ValueError(f"version {version} can't be restored: {len(gone)} of its files were vacuumed")
        return self._commit("RESTORE", base, add=[f for f in then["files"] if f not in now["files"]], remove=[f for f in now["files"] if f not in then["files"]], schema=then["schema"], partition_by=then["partition_by"])

    def changes(self, start: int, end: int | None = None, key: Sequence[str] = ()) -> DataFrame:
        """The change feed of versions start..end: insert and delete rows, and with a key also
        update_preimage / update_postimage, with the commit's version and time. Rows that a rewritten file
        carries over are in both its old and its new form and cancel."""
        out = None
        for c in self.log():
            v = c["version"]
            if v < start or (end is not None and v > end) or c["op"] == "OPTIMIZE" or not (c.get("add") or c.get("remove")):
                continue
            schema = StructType.fromJson(json.loads(self._state(v)["schema"]))
            new, old = self._rows(c.get("add", []), schema), self._rows(c.get("remove", []), schema)
            diff = new.exceptAll(old).withColumn("_change_type", F.lit("insert")).unionByName(old.exceptAll(new).withColumn("_change_type", F.lit("delete")))
            if key:
                from pyspark.sql import Window

                sides = F.size(F.collect_set("_change_type").over(Window.partitionBy(*key)))
                kind = F.when(sides == 2, F.when(F.col("_change_type") == "insert", "update_postimage").otherwise("update_preimage")).otherwise(F.col("_change_type"))
                diff = diff.withColumn("_change_type", kind)
            diff = diff.withColumn("_commit_version", F.lit(v)).withColumn("_commit_timestamp", F.timestamp_millis(F.lit(c["timestamp_ms"])))
            out = diff if out is None else out.unionByName(diff, allowMissingColumns=True)
        if out is None:
            if not 0 <= start <= self.version():
                raise ValueError("no versions in this range")
            kinds = "_change_type string, _commit_version int, _commit_timestamp timestamp"
            return self.spark.createDataFrame([], StructType([*self.read(start).schema.fields, *StructType.fromDDL(kinds).fields]))
        return out

    def clone(self, path: str, deep: bool = False) -> VersionedTable:
        """A table of its own at path: shallow refers to these files (which VACUUM then keeps as long as the
        clone uses them), deep copies them."""
        other, state = VersionedTable(self.spark, path), self._state()
        if deep:
            other.replace(self.read(), op="CLONE", partition_by=state["partition_by"])
        else:
            other._commit("CLONE", -1, add=[self._full(f) for f in state["files"]], schema=state["schema"], props=state["props"], partition_by=state["partition_by"])
            self.files.create(f"{self.path}/_clones/{uuid.uuid4().hex}.json", json.dumps(other.path))
        return other

    def optimize(self, cluster_by: Sequence[str] = (), files: int | None = None, zorder_by: Sequence[str] = ()) -> int:
        """Fewer files; rows range-partitioned and sorted by the clustering columns, or along a Z-order of
        several, so that min/max statistics of a file exclude most others."""
        base, state = self.version(), self._state()
        by = list(cluster_by) or [c for c in state["props"].get("clustering", "").split(",") if c]
        n = files or max(1, self.detail().first()["bytes"] // (128 << 20))
        df = self.read(base)
        if zorder_by:
            z = z_value(df, zorder_by)
            df = df.withColumn("_z", z).repartitionByRange(n, "_z").sortWithinPartitions("_z").drop("_z")
        else:
            df = df.repartitionByRange(n, *by).sortWithinPartitions(*by) if by else df.repartition(n)
        return self._commit("OPTIMIZE", base, add=self._write(df, check=False), remove=state["files"], **({"props": {"clustering": ",".join(by)}} if by and not zorder_by else {}))

    def vacuum(self, retain_hours: float = 168, now_ms: int | None = None) -> list[str]:
        """Deletes files that were removed from the table longer ago than the retention, counted from the
        commit that removed them (files of no commit: from when they were written), and that neither the
        table nor a shallow clone uses."""
        keep = {self._full(f) for f in self._state()["files"]}
        for n, _, _ in self.files.list(f"{self.path}/_clones"):
            other = VersionedTable(self.spark, json.loads(self.files.read(n)))
            keep |= {other._full(f) for f in (other._state()["files"] if other.version() >= 0 else [])}
        kept = {x.rsplit("/data/", 1)[-1] for x in keep}
        removed = {f: c["timestamp_ms"] for c in self.log() for f in c.get("remove", [])}
        limit = (now_ms or int(time.time() * 1000)) - retain_hours * 3_600_000
        gone = []
        for n, _, at in self.files.list(f"{self.path}/data", deep=True):
            name = n.rsplit("/data/", 1)[1]
            if name not in kept and removed.get(name, at) <= limit:
                self.files.delete(n)
                gone.append(n)
        return gone

    def skipped(self, where: str) -> tuple[int, int]:
        """(files that hold rows for which `where` is true, all files): what min/max statistics can leave out
        at most."""
        files = self._state()["files"]
        return len(self._holding(self._with_files(self.version()).filter(F.expr(where)), files)), len(files)

    def analyze(self) -> DataFrame:
        """Statistics by column in one pass: rows, nulls, distinct values (about), least and greatest as
        text. They are kept as properties, too."""
        df = self.read()
        parts = [f(c).alias(f"{c}|{k}") for c in df.columns for k, f in STATISTICS.items()]
        row = df.agg(F.count("*").alias("n"), *parts).first()
        out = [(c, row["n"], *(row[f"{c}|{k}"] for k in STATISTICS)) for c in df.columns]
        self._commit("ANALYZE", self.version(), props={"rows": str(row["n"])} | {f"stats.{r[0]}": json.dumps(r[1:]) for r in out})
        return self.spark.createDataFrame(out, "column string, rows long, nulls long, distinct_about long, least string, greatest string")

    # ---------------------------------------------------------------- metadata

    def set_props(self, **props: str) -> int:
        return self._commit("SET TBLPROPERTIES", self.version(), props={k: str(v) for k, v in props.items()})

    def comment(self, text: str | None = None, **columns: str) -> int:
        return self._commit("COMMENT", self.version(), **({"comment": text} if text else {}), column_comments=columns)

    def add_constraint(self, name: str, check: str) -> int:
        """CHECK (or NOT NULL as `c IS NOT NULL`): rows there already must hold it, later writes too."""
        if self._state()["schema"] and self.read().filter(~F.coalesce(F.expr(check), F.lit(True))).limit(1).count():
            raise ConstraintError(f"rows break {name} already")
        return self._commit("ADD CONSTRAINT", self.version(), constraints={name: check})

    def drop_constraint(self, name: str) -> int:
        return self._commit("DROP CONSTRAINT", self.version(), constraints={name: ""})

    def drop(self) -> None:
        self.files.delete(self.path)


STATISTICS = {
    "nulls": lambda c: F.count_if(F.col(c).isNull()),
    "distinct": lambda c: F.approx_count_distinct(c),
    "least": lambda c: F.min(c).cast("string"),
    "greatest": lambda c: F.max(c).cast("string"),
}


def partition_value(file: str, column: str) -> str | None:
    """The value of a partition column in a file's name."""
    for part in file.split("/"):
        if part.startswith(f"{PART}{column}="):
            value = unquote(part.split("=", 1)[1])
            return None if value == "__HIVE_DEFAULT_PARTITION__" else value
    return None


def z_value(df: DataFrame, columns: Sequence[str], bits: int = 5) -> Column:
    """The place of a row along a Z-order of numeric columns: bits of their quantile buckets, interleaved.
    At most 2^bits quantiles a column reach the driver."""
    steps = [k / 2**bits for k in range(1, 2**bits)]
    cuts = df.approxQuantile(list(columns), steps, 0.01)
    z = F.lit(0)
    for k, (c, edges) in enumerate(zip(columns, cuts)):
        bucket = sum((F.when(F.col(c) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)) if edges else F.lit(0)
        for b in range(bits):
            z = z + F.shiftleft(F.shiftright(bucket, b).bitwiseAND(F.lit(1)), b * len(columns) + k)
    return z


def read_as_stream(table: VersionedTable, after_version: int) -> tuple[DataFrame, int]:
    """Rows appended after a version, and the version to continue from: an incremental read by cursor."""
    added = [f for c in table.log() if c["version"] > after_version and c["op"] in APPENDING for f in c.get("add", [])]
    schema = StructType.fromJson(json.loads(table._state()["schema"]))
    df = table.spark.read.schema(schema).parquet(*[table._full(f) for f in added]) if added else table.spark.createDataFrame([], schema)
    return df, table.version()
