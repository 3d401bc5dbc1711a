"""Written intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it back.  The folder is the
session's ``spark.checkpoint.dir``, else the checkpoint folder of its context; only a session in one process
(tests, notebooks) may do without, in a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; an error where a session of several machines names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = named.get() if named.isDefined() else None
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cellweave-"))
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    """File system and path object of ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes stored under ``path``."""
    fs, target = _at(spark, path)
    return int(fs.getContentSummary(target).getLength())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in the folder ``path``; none where there is no such folder."""
    fs, target = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file as a whole or not at all; False where ``path`` is there already."""
    fs, target = _at(spark, path)
    part = f"{path}.{uuid.uuid4().hex[:12]}.part"
    _, made = _at(spark, part)
    stream = fs.create(made)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.exists(target) and fs.rename(made, target):
        return True
    fs.delete(made, False)
    return False


class Manifest:
    """What a store consists of: numbered files beside its data, each written once and as a whole.

    The one with the highest number counts; a write that ended before its manifest leaves no trace.
    """

    def __init__(self, spark: SparkSession, path: str, empty: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.n = max((int(m[1]) for m in map(re.compile(r"manifest-(\d+)\.json").fullmatch, names_in(spark, self.path)) if m), default=0)
        self.body: dict = json.loads(read_text(spark, f"{self.path}/manifest-{self.n}.json")) if self.n else empty

    def folder(self) -> str:
        """Name of a new folder, never one that a manifest names."""
        return f"v{self.n + 1}-{uuid.uuid4().hex[:12]}"

    def commit(self, body: dict) -> None:
        """Make ``body`` what counts; an error, and no change, where another writer was first."""
        if not write_text_once(self.spark, f"{self.path}/manifest-{self.n + 1}.json", json.dumps(body)):
            raise RuntimeError(f"{self.path} has been changed by another writer: open it again and repeat the merge")
        self.n, self.body = self.n + 1, body

    def vacuum(self, live: set[str]) -> list[str]:
        """Delete folders of data that ``live`` does not name, and the manifests before the current one."""
        gone = [x for x in names_in(self.spark, self.path) if (x.startswith("v") and x not in live) or (x.startswith("manifest-") and x != f"manifest-{self.n}.json")]
        for name in gone:
            _delete(self.spark, f"{self.path}/{name}")
        return gone


#: Folders of operator calls that are still there, by session.
_OPEN: dict[str, SparkSession] = {}


def clean(spark: SparkSession | None = None) -> None:
    """Delete the intermediate tables of all operator calls so far (of one session); at exit it is done anyway.

    A long session calls it when the results it still needs are written.
    """
    for root, owner in list(_OPEN.items()):
        if spark is None or owner is spark:
            del _OPEN[root]
            try:
                _delete(owner, root)
            except Exception:  # the JVM is gone already
                pass


atexit.register(clean)


class Workspace:
    """Tables one operator call writes; ``drop`` removes a superseded one, ``clean`` the rest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._next = 0
        _OPEN[self.root] = spark

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read back: no lineage, sizes known to the planner."""
        path = f"{self.root}/{self._next}"
        self._next += 1
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._cellweave_path = path
        return back

    def bytes(self, df: DataFrame) -> int:
        return size_of(self.spark, df._cellweave_path)

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._cellweave_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
