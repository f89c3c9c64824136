"""Keys that came in lately, held in a streaming query's keyed state.

Each load hands its keys, one row a key, to a stream of their own. Its state (RocksDB, by hash of the key, with the
checkpoint) remembers a key for ``within`` after it was admitted; what the state admits goes to a file sink, exactly once,
under the load's name. A restarted stream goes on with the state that its checkpoint holds.
"""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.operators.joins import lookup_join
from csvharbor.specs import TableSpec

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "at timestamp, batch string"


@dataclass
class KeyGate:
    """Lets the first row of a key pass and turns its repeats into failed rows, within and across loads.

    Times are those of the loads, which may not run backwards; a load with an earlier time counts as one at the latest time.
    A row is held back if its key was admitted less than ``within`` before. The watermark follows half of that behind and a
    key's term is the other half; a tick with the load's time goes ahead of its keys, so that terms that are over by then
    have ended. Rows with a NULL in their key pass. Of a load's rows with one key the first by upload and line counts.
    """

    spark: SparkSession
    root: str
    spec: TableSpec
    within: dt.timedelta

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _kinds(self) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in self.spec.schema().fields}
        return ", ".join(f"`{k}` {kinds[k]}" for k in self.spec.key_columns)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as none:
            if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def _arrived(self, batch: str, first: DataFrame) -> None:
        """Hands over what is not there yet; a name in ``given`` says that all of it is there, and it is not written again."""
        given = self._read("given", "name string, batch string")
        if given.filter(F.col("batch") == batch).isEmpty():
            first.write.mode("overwrite").parquet(self._path("arrivals", f"batch={batch}"))
            self.spark.createDataFrame([(batch,)], "name string").write.mode("overwrite").parquet(self._path("given", f"batch={batch}"))
        self._run()

    def _time(self, batch: str, at: dt.datetime) -> dt.datetime:
        """The load's time, the same for a retry, never before that of a load before it."""
        clock = self._read("clock", CLOCK)
        known = clock.filter(F.col("batch") == batch).first()
        if known:
            return known.at
        now = F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        latest = clock.agg(F.greatest(F.max("at"), now).alias("at"))
        latest.write.mode("overwrite").parquet(self._path("clock", f"batch={batch}"))
        return latest.first().at

    def _run(self) -> None:
        """Everything that has arrived, through the state to the sink."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            session.conf.set(name, self.spark.conf.get(name))
        schema = f"{self._kinds()}, upload_id string, line_number bigint, at timestamp, batch string"
        # Handled files are deleted as later loads commit; what they admitted stays in the sink.
        arrivals = session.readStream.schema(schema).option("cleanSource", "delete").parquet(self._path("arrivals"))
        half = f"{self.within // dt.timedelta(milliseconds=2)} milliseconds"
        admitted = arrivals.withWatermark("at", half).dropDuplicatesWithinWatermark(self.spec.key_columns)
        query = (
            admitted.select("upload_id", "line_number", "batch")
            .writeStream.format("parquet")
            .partitionBy("batch")
            .option("checkpointLocation", self._path("state"))
            .trigger(availableNow=True)
            .queryName(f"unique_{self.spec.key}")
            .start(self._path("admitted"))
        )
        query.awaitTermination()

    def admit(self, batch: str, rows: DataFrame, at: dt.datetime) -> DataFrame:
        """The judged rows of a load; accepted rows whose key came before are failed, with the reason."""
        keys = self.spec.key_columns
        solid = F.col("outcome") == "accepted"
        for k in keys:
            solid = solid & F.col(f"`{k}`").isNotNull()
        place = F.struct("upload_id", "line_number")
        time = F.lit(self._time(batch, at)).alias("at")
        first = rows.filter(solid).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(place).alias("p"))
        first = first.select(*[F.col(f"`{k}`") for k in keys], "p.upload_id", "p.line_number", time)
        tick = self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in first.dtypes if c != "at"], time)
        self._arrived(f"{batch}-tick", tick)
        self._arrived(batch, first)
        passed = self._read("admitted", "upload_id string, line_number bigint, batch string").filter(F.col("batch") == batch)
        marked = lookup_join(rows, passed.select("upload_id", "line_number", F.lit(True).alias("_in")), ["upload_id", "line_number"], "left")
        again = solid & F.col("_in").isNull()
        reason = F.lit(f"duplicate key: {', '.join(self.spec.unique_key)} came before within {self.within}")
        marked = marked.withColumn("reason", F.when(again, reason).otherwise(F.col("reason")))
        return marked.withColumn("outcome", F.when(again, "failed").otherwise(F.col("outcome"))).select(rows.columns)
