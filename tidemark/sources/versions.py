"""Tables that are replaced as a whole: a reader sees the old rows or the new ones, never half of either.

A table is a folder. Every write goes to a version folder of its own, ``v-<id>``, and becomes the
table by a commit: an empty file ``_commits/<number>-<id>``, whose creation is the one atomic step
and whose name says everything. The highest commit is the table. A write that fails or is killed
leaves the table as it was; what it wrote is removed at once where the writer lives, and by
``collect_garbage`` otherwise. Two writers at a time both commit a whole table; the higher name wins.

Only Hadoop's file system is used, on whatever store the path names, from the driver; the number of
files looked at is that of the versions kept.
"""

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"
_COMMIT = re.compile(r"(\d{12})-([0-9a-f]{32})")
_VERSION = re.compile(r"v-([0-9a-f]{32})")


class _Store:
    """The file system that a table's folder is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> dict[str, float]:
        """What a folder holds, with the seconds it was last changed at."""
        where = self._path(f"{self.root}/{folder}".rstrip("/"))
        if not self._fs.exists(where):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(where)}

    def commits(self) -> list[tuple[int, str]]:
        """Number and version of every commit, oldest first."""
        found = (_COMMIT.fullmatch(name) for name in self.names(COMMITS))
        return sorted((int(m[1]), m[2]) for m in found if m)

    def commit(self, version: str) -> None:
        number = max((n for n, _ in self.commits()), default=0) + 1
        self._fs.create(self._path(f"{self.root}/{COMMITS}/{number:012d}-{version}"), False).close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def save_table(df: DataFrame, path: str, keep: int = 1) -> DataFrame:
    """Replaces the table at ``path`` by ``df`` and returns the saved rows.

    The old rows stay readable while the new ones are written, and if that fails, so ``df`` may be
    made of the table itself. The ``keep`` versions before the new one stay for those still reading them.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    store = _Store(spark, path)
    try:
        df.write.option("compression", "zstd").parquet(f"{store.root}/v-{version}")
    except BaseException:
        store.remove(f"v-{version}")
        raise
    store.commit(version)
    _forget(store, keep)
    return spark.read.schema(df.schema).parquet(f"{store.root}/v-{version}")


def open_table(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The table at ``path``, or as it was ``back`` commits before, if that version is kept."""
    store = _Store(spark, path)
    commits = store.commits()
    if not 0 <= back < len(commits):
        raise ValueError(f"{path} has {len(commits)} versions")
    return spark.read.parquet(f"{store.root}/v-{commits[-1 - back][1]}")


def _forget(store: _Store, keep: int) -> None:
    commits = store.commits()
    for number, version in commits[: max(0, len(commits) - 1 - keep)]:
        store.remove(f"{COMMITS}/{number:012d}-{version}")  # first, so that no commit names a lost version
        store.remove(f"v-{version}")


def collect_garbage(spark: SparkSession, path: str, keep: int = 1, hours: float = 24) -> list[str]:
    """Removes all but the table and ``keep`` versions before it, and what writes left that
    were never committed and have not been touched for ``hours``; a younger one may still be
    written. Returns the version folders that are gone."""
    store = _Store(spark, path)
    before = store.names()
    _forget(store, keep)
    committed = {version for _, version in store.commits()}
    for name, changed in store.names().items():
        found = _VERSION.fullmatch(name)
        if found and found[1] not in committed and changed < time.time() - 3600 * hours:
            store.remove(name)
    return sorted(before.keys() - store.names().keys())
