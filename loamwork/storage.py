"""Tables in the folder that all executors share, to cut lineage and to keep state.

The folder is the one named by ``spark.checkpoint.dir``. Only where that is
unset and all of Spark runs on this machine (tests, a laptop) a temporary
folder stands in; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_folders: set[str] = set()
_names: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loamwork-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application's own folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/loamwork-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        for name in list(_names):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001
        _names.clear()
    try:
        delete(spark, folder)
    except Exception:  # noqa: BLE001 - the session may be gone
        return


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loamwork_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove the files of a settled frame that nothing reads any more."""
    path = getattr(df, "_loamwork_path", None)
    if path:
        delete(df.sparkSession, path)


class Parts:
    """Settled frames of one loop, read as one; merged when there are many, and removed when merged.

    A frame that is still the loop's frontier when it is merged is removed one merge later.
    """

    def __init__(self, first: DataFrame, name: str, most: int = 6) -> None:
        self.frames, self.name, self.most = [first], name, most
        self.stale: list[DataFrame] = []

    def df(self) -> DataFrame:
        out = self.frames[0]
        for f in self.frames[1:]:
            out = out.union(f.select(*out.columns))
        return out

    def add(self, frame: DataFrame) -> None:
        """Take in a settled frame, which the caller may go on reading until the next call."""
        self.frames.append(frame)
        for f in self.stale:
            drop(f)
        self.stale = []
        if len(self.frames) >= self.most:
            merged = settle(self.df(), self.name)
            self.stale, self.frames = self.frames, [merged]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes in a folder."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is either there as a whole or not at all; an existing one is never replaced."""
    fs, p = _path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    _, passing = _path(spark, f"{path}-{uuid.uuid4().hex}.part")
    out = fs.create(passing, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(passing, p):
        raise OSError(f"{path} could not be written")


def _apart_in_unions(spark: SparkSession) -> None:
    """Let no union pass on how its parts are bucketed: Spark 4.1 then leaves out the exchange of an aggregate
    above a union of bucketed tables, yet reads these tables unbucketed, and gives a group once a part."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


class Run:
    """An immutable table hash-bucketed and, unless said otherwise, sorted on its key.

    Joins of two runs with the same number of buckets need no shuffle. The
    files lie in the shared folder; only the name is held in the session's
    catalog, from which ``open`` makes it again. ``placed``: the rows are in that order of partitions already.
    """

    def __init__(self, df: DataFrame, key: str | list[str], buckets: int, name: str = "run", placed: bool = False, path: str | None = None, sort: bool = True) -> None:
        keys = [key] if isinstance(key, str) else list(key)
        _apart_in_unions(df.sparkSession)
        self.spark, self.key, self.buckets = df.sparkSession, keys, buckets
        self.path = path or new_path(self.spark, name)
        self.table = f"loamwork_{uuid.uuid4().hex}"
        self.columns = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        out = (df if placed else df.repartition(buckets, *keys)).write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(buckets, *keys)
        (out.sortBy(*keys) if sort else out).saveAsTable(self.table)
        self.sort = sort
        _names.add(self.table)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: list[str], buckets: int, columns: list[tuple[str, str]], sort: bool) -> Run:
        """A run that another session has written."""
        _apart_in_unions(spark)
        out = cls.__new__(cls)
        out.spark, out.path, out.key, out.buckets, out.columns, out.sort = spark, path, list(key), buckets, [tuple(c) for c in columns], sort
        out.table = f"loamwork_{uuid.uuid4().hex}"
        ordered = f" SORTED BY ({', '.join(key)})" if sort else ""
        spark.sql(f"CREATE TABLE {out.table} ({', '.join(f'`{n}` {t}' for n, t in columns)}) USING parquet CLUSTERED BY ({', '.join(key)}){ordered} INTO {buckets} BUCKETS LOCATION '{path}'")
        _names.add(out.table)
        return out

    def df(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Take the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        _names.discard(self.table)

    def drop(self) -> None:
        self.forget()
        delete(self.spark, self.path)


class RunStore:
    """Runs of several kinds in one folder, and a numbered manifest that names those that count.

    A batch writes new runs and publishes one manifest, by rename, when they are complete: a session that
    dies before leaves the former state, and what it had begun is removed when the store is opened again.
    Runs that a manifest no longer names are deleted after it is published. One session writes at a time;
    a second one fails to publish. Without ``path`` the store lies in the application's own folder.
    """

    def __init__(self, spark: SparkSession, path: str | None, settings: dict, name: str = "store") -> None:
        self.spark, self.path = spark, (path or new_path(spark, name)).rstrip("/")
        self.version, self.settings, self.batches = 0, settings, []
        self.runs: list[tuple[str, int, Run]] = []
        self.written = 0
        self._stale: list[Run] = []
        found = sorted(int(n.split("-")[1]) for n in names_in(spark, f"{self.path}/manifest") if n.startswith("v-") and not n.endswith(".part")) if path else []
        if found:
            self._load(found[-1])

    def _load(self, version: int) -> None:
        state = json.loads(self.spark.read.text(f"{self.path}/manifest/v-{version:012d}", wholetext=True).first()[0])
        self.version, self.settings, self.batches = version, state["settings"], state["batches"]
        self.runs = [(r["kind"], r["tier"], Run.open(self.spark, f"{self.path}/runs/{r['folder']}", r["key"], r["buckets"], r["columns"], r["sort"])) for r in state["runs"]]
        named = {r["folder"] for r in state["runs"]}
        for n in names_in(self.spark, f"{self.path}/runs"):
            if n not in named:
                delete(self.spark, f"{self.path}/runs/{n}")

    def of(self, kind: str) -> list[Run]:
        return [r for k, _, r in self.runs if k == kind]

    def add(self, kind: str, df: DataFrame, key: str | list[str], buckets: int, tier: int = 0, placed: bool = False, sort: bool = True) -> Run:
        run = Run(df, key, buckets, kind, placed, f"{self.path}/runs/{kind}-{uuid.uuid4().hex}", sort)
        self.runs.append((kind, tier, run))
        self.written += size_of(self.spark, run.path)
        return run

    def remove(self, run: Run) -> None:
        """No longer named from the next manifest on; readable until then."""
        self.runs = [x for x in self.runs if x[2] is not run]
        self._stale.append(run)

    def compact(self, kind: str, fanout: int, merge: Callable[[list[DataFrame]], DataFrame], placed: bool = False) -> None:
        """Merge the runs of a full tier into one of the next; each row is so rewritten a logarithmic number of times."""
        tier = 0
        while tier <= max((t for k, t, _ in self.runs if k == kind), default=-1):
            full = [r for k, t, r in self.runs if (k, t) == (kind, tier)]
            if len(full) >= fanout:
                self.add(kind, merge([r.df() for r in full]), full[0].key, full[0].buckets, tier + 1, placed, full[0].sort)
                for r in full:
                    self.remove(r)
            tier += 1

    def publish(self, batch: str | None = None) -> None:
        """Make the runs as they are now the state of the store."""
        if batch is not None:
            self.batches = [*self.batches, batch]
        runs = [{"kind": k, "tier": t, "folder": r.path.rsplit("/", 1)[1], "key": r.key, "buckets": r.buckets, "columns": r.columns, "sort": r.sort} for k, t, r in self.runs]
        publish_text(self.spark, f"{self.path}/manifest/v-{self.version + 1:012d}", json.dumps({"settings": self.settings, "batches": self.batches, "runs": runs}))
        self.version += 1
        if self.version > 1:
            delete(self.spark, f"{self.path}/manifest/v-{self.version - 1:012d}")
        for r in self._stale:
            r.drop()
        self._stale = []

    def close(self) -> None:
        """Take all names out of the catalog; the state stays."""
        for _, _, r in self.runs:
            r.forget()
        self.runs = []

    def destroy(self) -> None:
        """Remove the state."""
        self.close()
        delete(self.spark, self.path)
