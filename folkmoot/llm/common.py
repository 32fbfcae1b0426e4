"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Intake:
    """A table whose columns are renamed by position, so that no name can clash.

    ``Intake(df, "doc_id", "text")`` finds the named columns (exact spelling
    first, then regardless of case, the leftmost winning) and holds ``rows``,
    the same rows with columns ``_0, _1, ...``. ``restore`` gives rows their
    old column names back, in the old order.
    """

    def __init__(self, df: DataFrame, *needed: str):
        self.names = df.columns
        self.rows = df.toDF(*[f"_{i}" for i in range(len(self.names))])
        self._at = {n: self._find(n) for n in needed}

    def _find(self, name: str) -> str:
        for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
            for i, c in enumerate(self.names):
                if same(c):
                    return f"_{i}"
        raise ValueError(f"the table has no column {name!r}: {self.names}")

    def __getitem__(self, name: str) -> Column:
        return F.col(self._at[name])

    def narrow(self, **wanted: str) -> DataFrame:
        """Only the wanted columns, under new names: ``narrow(id="doc_id")``."""
        return self.rows.select(*[self[old].alias(new) for new, old in wanted.items()])

    def restore(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"_{i}") for i in range(len(self.names))]).toDF(*self.names)

    def replace(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """``restore`` with one column's values replaced."""
        put = self._at[name]
        return rows.select(
            *[value.alias(f"_{i}") if f"_{i}" == put else F.col(f"_{i}") for i in range(len(self.names))]
        ).toDF(*self.names)


def row_key(*cols: Column) -> list[Column]:
    """128 bits that stand for a row's values; rows that repeat share them."""
    return [F.xxhash64(F.lit(n), *[F.coalesce(c.cast("string"), F.lit("\0null")) for c in cols]).alias(f"k{n}") for n in (1, 2)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all work is done by one process, as in tests, a
    temporary one is made; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folkmoot-")
            _removed_at_the_end(spark, folder)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _removed_at_the_end(spark: SparkSession, path: str) -> None:
    """Have the file system remove a path when the application ends; plans may read it until then."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared folder, and read from there; it is removed when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _removed_at_the_end(df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """What a worker process has made for this key. It holds one such thing at a time: processes outlive the stage that started them, and the next stage needs their memory."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    return _kept[key]


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    path = Path(folder) / name
    if not path.exists():
        raise FileNotFoundError(f"no tokenizer file {path}")
    return str(path)


def byte_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pretoken_pattern(folder: str = TOKENIZERS) -> str:
    """The public split pattern that goes with the byte-level vocabularies."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    was, sys.dont_write_bytecode = sys.dont_write_bytecode, True
    try:
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    finally:
        sys.dont_write_bytecode = was
    return module.PATTERN
