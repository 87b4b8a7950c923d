"""Digests from a stream of candidates: each batch reads the state that the batch before left and writes its own, so that a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.digest import Rules, digests, remembered

STATE = {"seen": "user long, url string, at long", "sent": "user long, last timestamp", "waiting": "user long, seq long, url string, score int"}


class DigestLog:
    """A folder of what each batch sent (`digest`) and of what it left for the next one: URLs sent before, times of the last digests, candidates of users who are not due."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules = Rules()) -> None:
        self.spark, self.folder, self.rules = spark, folder, rules

    def _state(self, name: str, no: int) -> DataFrame:
        return self.spark.createDataFrame([], STATE[name]) if no < 0 else self.spark.read.schema(STATE[name]).parquet(f"{self.folder}/{name}/batch={no}")

    def _put(self, df: DataFrame, name: str, no: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={no}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def take(self, batch: DataFrame, no: int, now: datetime) -> None:
        """Batch `no` of candidates (user, seq, url, score) at the time `now`: users whose last digest is long enough ago get one, others' candidates wait."""
        pool = self._put(self._state("waiting", no - 1).unionByName(batch.select("user", "seq", "url", "score")), "pool", no)
        last, seen = self._state("sent", no - 1), self._state("seen", no - 1)
        hours = (F.unix_micros(F.lit(now)) - F.unix_micros("last")) / 3.6e9
        late = last.where(hours < self.rules.spacing_h).select("user")
        due = pool.join(late, "user", "left_anti")
        sent = self._put(digests(due, seen, self.rules), "digest", no)
        self._put(remembered(seen, sent, no, self.rules), "seen", no)
        times = sent.select("user").distinct().withColumn("last", F.lit(now))
        self._put(last.join(times.select("user"), "user", "left_anti").unionByName(times), "sent", no)
        self._put(pool.join(late, "user", "left_semi"), "waiting", no)

    def drain(self, stream: DataFrame, clock: Callable[[int], datetime]) -> None:
        """All that the stream has now; the next call goes on behind it. The state of this log and the place in the stream stand in the same folder."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.folder}/place").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, no: self.take(batch, no, clock(no))).start().awaitTermination()

    def sent(self) -> DataFrame:
        """(user, rank, url, score, fresh, batch) of all digests."""
        schema = "user long, rank int, url string, score int, fresh boolean, batch int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/digest")
