"""A keyed table in files: writes add small files to the buckets of their keys, readers merge them.

Layout: `data/<write>/part=<leading value>/bucket=<n>/` holds the rows of one write, sorted by key, and
`log/<version>.json` lists the folders that make up a version, with the least and greatest key of each. A row
belongs to the bucket that the hash of its key names; a leading column, if the table has one, comes first, so
that all keys of one leading value can be scanned alone. Rows carry the version that wrote them. Files have
Bloom filters on the keys.

* A write reduces its rows to one per key and adds one file to each bucket it touches; nothing is read or rewritten.
* A lookup reads the buckets of its keys, of these the folders whose key range holds one, and hands few keys down
  to the scan, where column statistics and Bloom filters skip row groups.
* A scan of a leading value, or of keys with a common beginning, reads only folders that can hold them.
* Of rows of one key the one with the greatest order columns counts, then the latest written; columns that are told to be
  `greatest` have the greatest value of all rows of the key. Buckets with a single folder are read without merging.
* Compaction rewrites the buckets that have many folders, and no others.
* Leading values below a bound leave by their log lines alone; rows of the bound itself are rewritten.

A version is there once its log entry is: entries are written beside the log and moved into it without
replacing one, so a writer that comes second fails and a broken write stays invisible. A write may carry the name of
its job and a batch number; a batch that is in the log already is not written again, so repeating it changes nothing.

Keys may be null; nulls are equal as keys. An empty table reads as no rows. `_v` and `_gone` are reserved names.
The driver holds a log entry: a line for each folder, which buckets and compaction bound.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from featloom.operators.latest import top_n_by_key

#: Keys that a lookup hands down to the scan at most; with more, buckets and key ranges alone prune.
PUSHED = 1000


@dataclass(frozen=True)
class Folder:
    """The rows of one write in one bucket."""
    path: str
    part: str | None
    bucket: int
    rows: int
    low: str | int | None   # least and greatest value of the first key column behind the leading one; None if unknown
    high: str | int | None
    whole: bool             # written by a compaction, so nothing older is left of the bucket


@dataclass(frozen=True)
class Version:
    number: int
    keys: tuple[str, ...]
    order: tuple[str, ...]
    leading: str | None
    buckets: int
    schema: str
    batches: dict[str, int]
    folders: tuple[Folder, ...]
    greatest: tuple[str, ...] = ()


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self.path).getFileSystem(conf)

    # ---- log

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 16,
               order: Sequence[str] = (), leading: str | None = None, greatest: Sequence[str] = ()) -> KeyedTable:
        """A new, empty table. `leading` names a key column of few values, `buckets` how many files hold each of them."""
        if leading is not None and leading not in keys or not {*keys, *order, *greatest} <= set(schema.names) or set(greatest) & set(keys) or leading in keys and len(keys) < 2:
            raise ValueError(f"keys {keys}, order {order} and leading column {leading} do not fit {schema.names}")
        table = cls(spark, path)
        table._commit(Version(0, tuple(keys), tuple(order), leading, buckets, schema.json(), {}, (), tuple(greatest)))
        return table

    def versions(self) -> list[int]:
        log = self._fs_path(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        numbers = self.versions()
        if not numbers or number is not None and number not in numbers:
            raise ValueError(f"{self.path} has no version {'' if number is None else number}".rstrip())
        stream = self._fs.open(self._fs_path(self._entry(numbers[-1] if number is None else number)))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        lists = {k: tuple(told[k]) for k in ("keys", "order", "greatest") if k in told}
        return Version(**told | lists | {"folders": tuple(Folder(**f) for f in told["folders"])})

    def holds(self, job: str, batch: int) -> bool:
        """Whether a batch of a job was written."""
        return self.version().batches.get(job, -1) >= batch

    def _entry(self, number: int) -> str:
        return f"{self.path}/log/{number:020d}.json"

    def _commit(self, version: Version) -> None:
        """The version becomes the newest one, unless another writer made one of its number."""
        text = json.dumps(version.__dict__ | {"folders": [f.__dict__ for f in version.folders]})
        jvm, target = self.spark._jvm, self._fs_path(self._entry(version.number))
        self._fs.mkdirs(self._fs_path(f"{self.path}/log"))
        draft = self._fs_path(f"{self.path}/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        keep = self.spark.sparkContext._gateway.new_array(rename, 1)
        keep[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), keep)
        except Exception as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version.number} of {self.path} was written by another writer") from e

    # ---- writing

    def _placed(self, rows: DataFrame, v: Version) -> DataFrame:
        part = F.coalesce(F.col(v.leading).cast("string"), F.lit("")) if v.leading else F.lit("")
        return rows.select("*", F.hex(F.encode(part, "UTF-8")).alias("_part"), self._bucket(v).alias("_bucket"))

    @staticmethod
    def _bucket(v: Version) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in v.keys]), F.lit(v.buckets)).cast("int")

    @staticmethod
    def _lead(v: Version) -> str:
        """The key column whose range a folder tells."""
        return next(k for k in v.keys if k != v.leading)

    @staticmethod
    def _first(rows: DataFrame, v: Version, order: Sequence[Column]) -> DataFrame:
        """The first row of each key, with the greatest values of all of them."""
        # of the same order, so that one sort does for both
        every = Window.partitionBy(*v.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return top_n_by_key(rows.withColumns({c: F.max(c).over(every) for c in v.greatest}), v.keys, order, 1)

    def _write_folders(self, rows: DataFrame, v: Version, number: int, whole: bool) -> list[Folder]:
        """Rows (one per key, with `_v` and `_gone`) as files of a new write, one for each bucket."""
        folder = f"{self.path}/data/{number:08d}-{uuid.uuid4().hex[:12]}"
        placed = (self._placed(rows, v).withColumns({"part": F.concat(F.lit("x"), "_part"), "bucket": F.col("_bucket")})
                  .drop("_part", "_bucket"))
        out = placed.repartition("part", "bucket").sortWithinPartitions("part", "bucket", *v.keys).write.partitionBy("part", "bucket")
        for k in v.keys:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
        out.parquet(folder)
        if not self._fs.exists(self._fs_path(folder)) or not any(
                s.isDirectory() for s in self._fs.listStatus(self._fs_path(folder))):
            return []
        lead = self._lead(v)
        kind = T.StructType.fromJson(json.loads(v.schema))[lead].dataType
        ranged = isinstance(kind, (T.StringType, T.LongType, T.IntegerType, T.ShortType))
        # a null key has no place in a range
        low, high = (F.when(F.count_if(F.col(lead).isNull()) == 0, f(lead)) if ranged else F.lit(None) for f in (F.min, F.max))
        told = (self.spark.read.schema(placed.schema).option("basePath", folder).parquet(folder)
                .groupBy("part", "bucket").agg(F.count("*").alias("rows"), low.alias("low"), high.alias("high")).collect())
        return [Folder(f"{folder}/part={r['part']}/bucket={r['bucket']}", _unhex(r["part"]) if v.leading else None, r["bucket"],
                       r["rows"], r["low"], r["high"], whole) for r in told]

    def write(self, rows: DataFrame, gone: DataFrame | None = None, job: str | None = None, batch: int | None = None,
              reduced: bool = False) -> int:
        """Lay `rows` over the table, and take away the keys of `gone` (and their order columns); gives the version.

        Of rows of one key the one with the greatest order columns counts, ties by the text of the whole row. A `batch` of a
        `job` that was written already is left out. Rows that are `reduced` to one per key already are not compared again.
        """
        v = self.version()
        if job is not None and self.holds(job, batch):
            return v.number
        number = v.number + 1
        schema = T.StructType.fromJson(json.loads(v.schema))
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], F.lit(False).alias("_gone"))
        if gone is not None:
            given = {*v.keys, *v.order}
            new = new.unionByName(gone.select(*[
                (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema],
                F.lit(True).alias("_gone")))
        newest = [*(F.col(c).desc_nulls_last() for c in v.order), F.col("_gone").desc(), F.to_json(F.struct(*schema.names)).desc()]
        new = (new if reduced else self._first(new, v, newest)).withColumn("_v", F.lit(number).cast("bigint"))
        folders = self._write_folders(new, v, number, whole=False)
        batches = v.batches | ({job: batch} if job is not None else {})
        self._commit(replace(v, number=number, batches=batches, folders=v.folders + tuple(folders)))
        return number

    def compact(self, folders: int = 2, keep: Column | None = None) -> int:
        """Rewrite the buckets that have at least so many folders as one; rows that do not meet `keep` go.

        Taken-away keys are forgotten, so a row with lesser order columns that comes later would count again.
        """
        v = self.version()
        full = [group for group in self._groups(v.folders).values()
                if len(group) >= folders or keep is not None or folders <= 1]
        if not full:
            return v.number
        number = v.number + 1
        rows = self._merged(v, [f for g in full for f in g])
        kept = rows.where(~F.col("_gone")) if keep is None else rows.where(~F.col("_gone")).where(keep)
        new = self._write_folders(kept, v, number, whole=True)
        old = {f.path for g in full for f in g}
        self._commit(replace(v, number=number, folders=tuple(f for f in v.folders if f.path not in old) + tuple(new)))
        return number

    def drop_before(self, leading: str, keep: Column | None = None) -> int:
        """Take away all rows whose leading value, as text, sorts before `leading`, without reading them.

        Of the rows of `leading` itself those that do not meet `keep` go; only they are rewritten. Rows without a
        leading value stay.
        """
        v = self.version()
        if v.leading is None:
            raise ValueError(f"{self.path} has no leading column")
        rest = tuple(f for f in v.folders if not f.part or f.part >= leading)
        edge = [f for f in rest if f.part == leading] if keep is not None and leading else []
        if len(rest) == len(v.folders) and not edge:
            return v.number
        number, new = v.number + 1, []
        if edge:
            new = self._write_folders(self._merged(v, edge).where(F.col("_gone") | keep), v, number, whole=True)
            rest = tuple(f for f in rest if f.part != leading)
        self._commit(replace(v, number=number, folders=rest + tuple(new)))
        return number

    def forget(self, versions: int = 1) -> int:
        """Delete all but the newest log entries and the data that they do not name; gives the number of deleted folders.

        Not to be run beside a writer or beside readers of older versions.
        """
        numbers = self.versions()
        for n in numbers[:-versions]:
            self._fs.delete(self._fs_path(self._entry(n)), False)
        named = {f.path.split("/part=")[0].rsplit("/", 1)[-1] for n in numbers[-versions:] for f in self.version(n).folders}
        data, gone = self._fs_path(f"{self.path}/data"), 0
        for s in (self._fs.listStatus(data) if self._fs.exists(data) else []):
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone

    # ---- reading

    @staticmethod
    def _groups(folders: Sequence[Folder]) -> dict[tuple, list[Folder]]:
        out: dict[tuple, list[Folder]] = {}
        for f in folders:
            out.setdefault((f.part, f.bucket), []).append(f)
        return out

    def _read(self, v: Version, folders: Sequence[Folder]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema)).add("_gone", T.BooleanType()).add("_v", T.LongType())
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f.path for f in folders])

    def _merged(self, v: Version, folders: Sequence[Folder], where: Column | None = None) -> DataFrame:
        """One row per key; `where` is on keys alone."""
        groups = self._groups(folders).values()
        lone = self._read(v, [g[0] for g in groups if len(g) == 1])
        many = self._read(v, [f for g in groups if len(g) > 1 for f in g])
        if where is not None:
            lone, many = lone.where(where), many.where(where)
        if all(len(g) == 1 for g in groups):
            return lone
        newest = self._first(many, v, [F.col(c).desc() for c in (*v.order, "_v")])
        return lone.unionByName(newest) if any(len(g) == 1 for g in groups) else newest

    def _shown(self, v: Version, rows: DataFrame) -> DataFrame:
        return rows.where(~F.col("_gone")).select(*T.StructType.fromJson(json.loads(v.schema)).names)

    def scan(self, leading: str | None = None, starts_with: str | None = None, version: int | None = None) -> DataFrame:
        """All rows, those of one leading value, or those whose first key column behind it begins with a text."""
        v = self.version(version)
        folders = [f for f in v.folders if leading is None or f.part == leading]
        where = None if leading is None else F.col(v.leading) == leading
        if starts_with is not None:
            lead = self._lead(v)
            folders = [f for f in folders if not isinstance(f.low, str) or
                       f.low[:len(starts_with)] <= starts_with <= f.high[:len(starts_with)]]
            begins = F.col(lead).startswith(starts_with)
            where = begins if where is None else where & begins
        return self._shown(v, self._merged(v, folders, where))

    def lookup(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose keys are in `wanted` (its key columns), each once."""
        v = self.version(version)
        schema = T.StructType.fromJson(json.loads(v.schema))
        asked = wanted.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in v.keys]).distinct()
        placed = self._placed(asked, v)
        lead = self._lead(v)
        touched = {(_unhex(r["_part"], 0) if v.leading else None, r["_bucket"]): (r["low"], r["high"]) for r in
                   placed.groupBy("_part", "_bucket").agg(
                       F.when(F.count_if(F.col(lead).isNull()) == 0, F.min(lead)).alias("low"),
                       F.when(F.count_if(F.col(lead).isNull()) == 0, F.max(lead)).alias("high")).collect()}

        def may_hold(f: Folder) -> bool:
            if (f.part, f.bucket) not in touched:
                return False
            low, high = touched[f.part, f.bucket]
            return f.low is None or low is None or (f.low <= high and low <= f.high)

        folders = [f for f in v.folders if may_hold(f)]
        few = asked.limit(PUSHED + 1).collect() if folders else []
        where = None
        if few and len(few) <= PUSHED and all(x is not None for r in few for x in r):
            for k in v.keys:
                among = F.col(k).isin(sorted({r[k] for r in few}))
                where = among if where is None else where & among
        rows = self._merged(v, folders, where)
        named = asked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(v.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(v.keys)]
        return self._shown(v, rows.join(named, same, "left_semi"))


def _unhex(part: str, skip: int = 1) -> str:
    return bytes.fromhex(part[skip:]).decode()
