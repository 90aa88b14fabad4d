"""Token counts kept as additive rollups, maintained by signed deltas.

A store holds one folder per committed batch: ``state`` (what each document of the batch
now counts) and ``deltas`` (signed documents and tokens per source, language and
tokenizer version). A change looks up what the document counted before, takes that away
and adds the new count; totals are the sum of all deltas. A batch is written whole, then
its marker is created; readers see marked batches only. Committing an id again does
nothing, and an attempt that died before its marker is overwritten by the next one.
One writer at a time, as its deltas rest on the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: version -> pattern of the runs that count as one token; every other character but white space counts by itself
VERSIONS = {"space-1": r"[^\x20\x09-\x0D]+", "word-2": r"[\p{L}\p{N}]+"}
STATE = "doc_id bigint, version string, source string, lang string, tokens bigint, live boolean, turn bigint"
DELTAS = "source string, lang string, version string, docs bigint, tokens bigint"


def tokens(text: Column, pattern: str) -> Column:
    """Number of tokens by ``pattern``; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "w")
    return F.length(F.regexp_replace(marks, SPACE, "")).cast("long")


class Rollup:
    """Token totals under ``path``, which driver and executors must share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, where: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{where}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def batches(self) -> list[int]:
        """Ids of the committed batches."""
        fs, place = self._at("commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(place)) if fs.exists(place) else []

    def _read(self, what: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{what}/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` as ``batch``; False, and no effect, if the id was committed before.

        Columns: doc_id, version, source, lang, tokens, delete (boolean), turn (order
        within the batch). The last turn of a (doc_id, version) counts, ties by the
        larger (tokens, source, lang), a delete last. Deleting what isn't there, or
        revising to the same values, changes nothing. A null doc_id, source, language or
        version is a value like any other, null tokens are 0, a null delete is false.
        """
        fs, marker = self._at(f"commits/{int(batch)}")
        if fs.exists(marker):
            return False
        gone = F.coalesce(F.col("delete"), F.lit(False))
        new = changes.select(
            "doc_id", "version", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), (~gone).alias("live"),
            F.col("turn").cast("long").alias("turn"), F.lit(True).alias("__new"),
        )
        old = self._read("state", STATE).withColumn("__new", F.lit(False))
        what = F.struct("turn", (~F.col("live")).alias("gone"), "tokens", "source", "lang", "live")
        both = old.unionByName(new).groupBy("doc_id", "version").agg(
            F.max(F.when(~F.col("__new"), what)).alias("__was"), F.max(F.when(F.col("__new"), what)).alias("__is")
        ).where("__is IS NOT NULL")
        # turns of later batches follow those of earlier ones
        turn = F.lit(int(len(self.batches())) + 1).cast("long")
        both.select("doc_id", "version", "__is.source", "__is.lang", "__is.tokens", "__is.live", turn.alias("turn"), "__was").write.mode("overwrite").parquet(f"{self.path}/state/{int(batch)}")
        kept = self.spark.read.parquet(f"{self.path}/state/{int(batch)}")

        def signed(row: str, sign: int) -> Column:
            at = F.col(row)
            return F.when(at["live"], F.struct(at["source"].alias("source"), at["lang"].alias("lang"), F.lit(sign).alias("docs"), (at["tokens"] * sign).alias("tokens")))

        moves = kept.withColumn("__is", F.struct("source", "lang", "tokens", "live"))
        moves = moves.select("version", F.explode(F.array(signed("__was", -1), signed("__is", 1))).alias("m")).where("m IS NOT NULL")
        deltas = moves.groupBy("m.source", "m.lang", "version").agg(F.sum("m.docs").alias("docs"), F.sum("m.tokens").alias("tokens"))
        deltas.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/deltas/{int(batch)}")
        fs.create(marker, False).close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches; groups without documents are left out."""
        sums = self._read("deltas", DELTAS).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")
