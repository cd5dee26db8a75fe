"""Incremental duplicate search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from imprint.config import MatchConfig
from imprint.operators.duplicates import FoldedPrints, expand_matches, match_prints, turned_prints, with_print_key
from imprint.operators.similarity import near_hashes
from imprint.plans.duplicates import new_candidates
from imprint.session import materialize
from imprint.streaming.growing import GrowingTable, bucket_of, touched


@dataclass(frozen=True)
class IncrementalMatcher:
    """Matches each micro-batch of print rows against everything before it.

    ``root`` is a shared folder with one growing table of each kind:

    * ``hashes``: hash and print key of every different print, 41 bytes a row. The
      only table read whole, and only in its hash column: within a radius of 10 of 64
      bits, the buckets of any index over hashes that a few prints can reach are
      nearly all of them.
    * ``prints`` and ``members``: fingerprints and rows by print key, ``ids`` by id.
      Of these a micro-batch opens the buckets of its own keys and ids and of the
      print keys that its hashes found.
    * ``pairs``: what was found.

    So history is neither shuffled nor written again. A micro-batch that is run again
    replaces its own parts and reads only earlier ones, so a retry changes nothing.
    Rows delivered twice are recognised by id, within a micro-batch (one of them
    counts) and across them.
    """

    root: str
    config: MatchConfig = MatchConfig()
    buckets: int = 64
    fan: int = 8

    def table(self, name: str) -> GrowingTable:
        return GrowingTable(f"{self.root}/{name}", self.fan)

    def _write(self, rows: DataFrame, name: str, epoch: int) -> DataFrame:
        # Pairs are many, in one bucket.
        return self.table(name).write(rows, epoch, gather=name != "pairs")

    def _fresh(self, rows: DataFrame, epoch: int) -> DataFrame:
        """Rows whose ids were not delivered before, with their print keys."""
        placed = rows.select("id", bucket_of("id", self.buckets).alias("bucket"))
        known = self.table("ids").read(rows.sparkSession, placed.schema, epoch, touched(placed)).select("id")
        new = with_print_key(rows.dropDuplicates(["id"]).join(known, "id", "left_anti"))
        return materialize(new.withColumn("bucket", bucket_of("print_key", self.buckets)))

    def _found(self, upright: DataFrame, hashes: DataFrame) -> DataFrame:
        """print_key and bucket of earlier prints with a hash near one of the new ones."""
        total = hashes.count()
        if not total:
            return hashes.select("print_key").limit(0).withColumn("bucket", F.lit(0))
        probing = upright.select("hash").distinct().count()
        near = materialize(near_hashes(upright, hashes, self.config.structural_max, sizes=(probing, total), split_rows=self.config.split_rows))
        keys = hashes.join(near, "hash", "left_semi").select("print_key").distinct()
        return materialize(keys.withColumn("bucket", bucket_of("print_key", self.buckets)))

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        new = self._fresh(rows, epoch)
        kept = self._write(new.select("id", bucket_of("id", self.buckets).alias("bucket")), "ids", epoch)
        members = self._write(new.select("id", "batch_id", "pairing_key", "print_key", "bucket"), "members", epoch)
        own = touched(new)
        turned = turned_prints(new.withColumn("arrived", F.lit(True)), []).select(
            "print_key", "rotation", "hash", "color", "least", "most", "bucket"
        )
        turned = materialize(turned)
        schema = turned.drop("least", "most").schema
        known = self.table("prints").read(spark, schema, epoch, own).select("print_key")
        fresh = self._write(turned.drop("least", "most").join(known, "print_key", "left_anti"), "prints", epoch)
        narrow = fresh.select("hash", "print_key", F.lit(0).alias("bucket"))
        earlier = self.table("hashes").read(spark, narrow.schema, epoch)
        self._write(narrow, "hashes", epoch)

        found = self._found(turned.filter("rotation = 0").select("hash"), earlier)
        keys, places = new.select("print_key").distinct(), touched(found)
        other_prints = (
            self.table("prints").read(spark, schema, epoch, places)
            .join(found.select("print_key"), "print_key", "left_semi").join(keys, "print_key", "left_anti")
        )
        # Rows of the micro-batch are looked up among each other by id, earlier ones by print alone.
        every_print = turned.withColumn("arrived", F.lit(True)).unionByName(
            other_prints.withColumns({"arrived": F.lit(False), "least": F.lit(None), "most": F.lit(None)}), allowMissingColumns=True
        ).drop("bucket")
        wanted = found.select("print_key").union(keys).distinct()
        old_members = self.table("members").read(spark, members.schema, epoch, sorted({*places, *own})).join(wanted, "print_key", "left_semi")
        seen = old_members.select("print_key").distinct().withColumn("_seen", F.lit(True))
        every_print = every_print.join(seen, "print_key", "left").withColumn("old", F.col("_seen").isNotNull()).drop("_seen")
        every_member = members.withColumn("arrived", F.lit(True)).unionByName(old_members.withColumn("arrived", F.lit(False))).drop("bucket")
        every_member = materialize(every_member)
        row = F.struct("id", "batch_id", "pairing_key", "arrived")
        rows_of = materialize(every_member.groupBy("print_key").agg(F.count(F.lit(1)).alias("_rows"), F.any_value(row).alias("one")))
        ones = rows_of.filter("_rows = 1").drop("_rows")
        index = FoldedPrints(every_member, materialize(every_print.join(ones, "print_key", "left")), [], rows_of.filter("_rows > 1").count())
        matches = match_prints(index, self.config, keys=bool(index.repeated))
        if "query_one" not in matches.columns:
            matches = materialize(matches)
        # Each pair has an id that was not there before, so none of them is recorded yet, and none comes twice.
        pairs = new_candidates(expand_matches(matches, index, self.config), once=True)
        written = self._write(pairs.withColumn("bucket", F.lit(0)), "pairs", epoch)
        for name, schema in (("ids", kept.schema), ("members", members.schema), ("prints", fresh.schema), ("hashes", narrow.schema), ("pairs", written.schema)):
            self.table(name).compact(spark, schema, epoch)

    def pairs(self, spark: SparkSession) -> DataFrame:
        """Every pair found so far."""
        table = self.table("pairs")
        paths = [f"{table.folder}/{table._name(*p)}" for p in table.parts(spark)]
        return spark.read.option("basePath", table.folder).parquet(*paths).drop("part", "bucket")


def start_matching(
    prints: DataFrame,
    root: str,
    checkpoint: str,
    config: MatchConfig = MatchConfig(),
    event_time: str | None = None,
    lateness: str = "10 minutes",
    available_now: bool = True,
) -> StreamingQuery:
    """Run the matcher over a stream of print rows.

    With ``event_time`` rows redelivered within ``lateness`` are dropped before
    they reach a micro-batch.
    """
    if event_time is not None:
        prints = prints.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["id"])
        prints = prints.drop(event_time)
    writer = prints.writeStream.foreachBatch(IncrementalMatcher(root, config)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
