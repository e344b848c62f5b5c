"""What the operators share: tables in the shared folder, bounded broadcasts, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long column that may be broadcast (16 MB); beyond it a shuffle join is used.
BROADCAST_ROWS = 2_000_000
#: Rows of one key from which a join treats it apart.
HOT_ROWS = 100_000
#: Words whose hash a Python worker remembers.
MEMO_WORDS = 200_000

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (local mode, as in tests) a temporary folder stands in.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = _own_folders.setdefault(app, "file://" + tempfile.mkdtemp(prefix="panelforge-"))
    return f"{base.rstrip('/')}/{app}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` (a written table, so counting is cheap) with a broadcast hint if it has at most ``most`` rows, else as it is, for a shuffle join."""
    return F.broadcast(small) if small.count() <= most else small


def join_one(many: DataFrame, one: DataFrame, key: str, left: bool = False) -> DataFrame:
    """``many`` (cheap to read twice) with the columns of ``one``, a written table of one row for each key; ``left`` keeps rows without one.

    Beyond the broadcast bound rows are shuffled by the key, but for the rows of hot keys: there are at most rows / HOT_ROWS such
    keys, so their part of ``one`` is broadcast. Null keys are not shuffled either.
    """
    how = "left" if left else "inner"
    if one.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(one), key, how)
    known = many.where(F.col(key).isNotNull())
    hot = written(known.groupBy(key).count().where(F.col("count") >= HOT_ROWS).select(key), "hot-keys")
    rest = known.join(F.broadcast(hot), key, "left_anti").join(one, key, how)
    out = rest.unionByName(known.join(F.broadcast(hot), key).join(F.broadcast(one.join(F.broadcast(hot), key)), key, how))
    return out.unionByName(many.where(F.col(key).isNull()), allowMissingColumns=True) if left else out


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it (whatever the case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``ids`` (a written table of distinct keys); a null key stays."""
    name = free_name(docs, "_drop_key")
    other = ids.select(F.col(ids.columns[0]).alias(name))
    return docs.join(bounded_broadcast(other), F.col(key) == F.col(name), "left_anti")


def with_places(docs: DataFrame, *names: str) -> DataFrame:
    """``docs``, read from Parquet, with each row's place under two ``names``: a hash of its file's path and its number there. Any later read gives the same. A column of its own named _metadata doesn't hide the place."""
    meta = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(meta["file_path"]).alias(names[0]), meta["row_index"].alias(names[1]))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
