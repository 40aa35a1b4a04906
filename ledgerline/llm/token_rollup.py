"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed deltas, added up per source, language and
tokenizer version before anything is written; totals are the sum of all committed batches. Deltas are additive, so
batches may be committed in any order and totals never need the documents again. Every attempt to commit a batch writes a Parquet folder of its own
below the batch's id, which counts once its _SUCCESS marker stands; of several complete attempts of one id the earliest
counts, so committing an id again changes nothing and writers never touch each other's files. ``compact`` lists the
batches once, writes the sum of exactly these and their list as a snapshot, and removes the batches that the snapshot
before had folded already (readers may still be at those of the newest).

Results: null sources, languages and versions are groups like any other; a null count is 0 tokens of one document; a
revision takes the old values from the old_ columns (nothing is taken back where old_tokens is null); unknown kinds of
change are refused; totals that have come back to 0 documents and 0 tokens disappear; an empty batch is committed and
changes nothing; repeated rows in a batch are separate changes.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, folder: str) -> list:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()) if fs.exists(p) else []

    def _marked(self, folder: str) -> int | None:
        """When a folder was completed; None if it isn't."""
        fs, p = self._fs(f"{self.path}/{folder}/_SUCCESS")
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    def _batches(self) -> dict[str, str]:
        """Committed ids and the folder of each that counts."""
        out = {}
        for s in self._list("batches"):
            name = s.getPath().getName()
            attempts = [a.getPath().getName() for a in self._list(f"batches/{name}")]
            done = [(at, a) for a in attempts if (at := self._marked(f"batches/{name}/{a}")) is not None]
            if done:
                out[name] = f"batches/{name}/{min(done)[1]}"
        return out

    def _snapshots(self) -> list[str]:
        return [n for n in (s.getPath().getName() for s in self._list("snapshots")) if self._marked(f"snapshots/{n}") is not None]

    @staticmethod
    def deltas(changes: DataFrame) -> DataFrame:
        """Signed additive deltas of a batch: kind, source, lang, tokenizer, n_tokens and, for revisions, their old_ values."""
        old = {c for c in changes.columns if c.startswith("old_")}
        def at(name):
            return F.col(name).cast("string").alias(name)
        def was(name):
            return (F.col(f"old_{name}") if f"old_{name}" in old else F.col(name)).cast("string").alias(name)
        tokens = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
        taken = F.col("old_tokens").cast("long") if "old_tokens" in old else F.lit(None).cast("long")
        kind = F.col("kind")
        sign = F.when(kind.isin("insert", "revise"), 1).when(kind == "delete", -1).otherwise(
            F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))))
        sides = F.array(F.struct(*(at(k) for k in KEYS), sign.cast("long").alias("n_docs"), (sign * tokens).alias("n_tokens")),
                        F.struct(*(was(k) for k in KEYS), F.when((kind == "revise") & taken.isNotNull(), -1).otherwise(0).cast("long").alias("n_docs"),
                                 F.when(kind == "revise", -F.coalesce(taken, F.lit(0))).otherwise(0).alias("n_tokens")))
        rows = changes.select(F.inline(sides))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, without reading it, if the id is committed already."""
        if not re.fullmatch(r"[\w.-]+", batch_id) or batch_id[0] in "._":
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        self.deltas(changes).write.parquet(f"{self.path}/batches/{batch_id}/{uuid.uuid4().hex}")
        return True

    def _folded(self, snapshot: str | None) -> set[str]:
        if snapshot is None:
            return set()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/folded/{snapshot}").collect()}

    def _state(self) -> tuple[str | None, set[str], dict[str, str]]:
        """The newest snapshot, the batches in it, and those committed since: one listing that everything else goes by. The
        batches are listed first, so that none is missed whose folding ends in between."""
        batches = self._batches()
        snapshot = max(self._snapshots(), default=None)
        folded = self._folded(snapshot)
        return snapshot, folded, {b: f for b, f in batches.items() if b not in folded}

    def committed(self) -> set[str]:
        _, folded, batches = self._state()
        return folded | set(batches)

    def _sum(self, state: tuple[str | None, set[str], dict[str, str]]) -> DataFrame:
        snapshot, _, batches = state
        paths = [f"{self.path}/{f}" for f in batches.values()] + ([f"{self.path}/snapshots/{snapshot}"] if snapshot else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) after all committed batches."""
        return self._sum(self._state())

    def compact(self) -> str:
        """Fold all committed batches into a new snapshot; its list of batches is written first, its totals last."""
        state = self._state()
        before, folded, batches = state
        name = f"{int(before.split('-')[0]) + 1 if before else 0:09d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(b,) for b in sorted(folded | set(batches))], "batch string").coalesce(1).write.parquet(f"{self.path}/folded/{name}")
        self._sum(state).write.parquet(f"{self.path}/snapshots/{name}")
        for batch in folded:
            fs, p = self._fs(f"{self.path}/batches/{batch}")
            fs.delete(p, True)
        return name
