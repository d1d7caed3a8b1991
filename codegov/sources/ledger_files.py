"""The append-only ledger as newline-delimited JSON, and exports of its state."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import matches
from ..functions.ranking import placed
from ..operators.ledger import judge, latest
from .schemas import FACTS, LEDGER
from .shared import checkpointed

#: Digits of base 32 as Spark writes them, and as ids write them (fixed values).
_PLAIN, _CROCKFORD = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

#: Field names in files; tables use snake case.
_CAMEL = {"entry_id": "entryId", "run_id": "runId", "rule_id": "ruleId", "instance_id": "instanceId", "expires_at": "expiresAt", "requires_verification": "requiresVerification", "axiom_id": "axiomId"}


def _ndjson(path: str) -> None:
    if not path.rstrip("/").endswith(".ndjson"):
        raise ValueError(f"a ledger's path ends in .ndjson: {path}")


def _entries(spark: SparkSession, path: str) -> list[str]:
    """The folder's own files and its finished runs; what a run has left unfinished isn't there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [(x.getPath().getName(), x.isDirectory()) for x in fs.listStatus(place)]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    runs = [f"{path}/{n}" for n, folder in names if folder and n.startswith("run-") and done(n)]
    return ([path] if any(not folder and n[0] not in "._" for n, folder in names) else []) + runs


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger events; blank lines are skipped, a missing folder is an empty ledger, bad JSON is an error."""
    _ndjson(path)
    names = [c.strip().split(" ")[0] for c in LEDGER.replace("array<struct<kind:string,data:string>>", "x").split(",")]
    schema = LEDGER
    for snake, camel in _CAMEL.items():
        schema = schema.replace(f"{snake} ", f"{camel} ")
    files = _entries(spark, path)
    if not files:
        return spark.createDataFrame([], LEDGER)
    parts = [spark.read.schema(schema).option("mode", "FAILFAST").json([f for f in files if f != path])] if files != [path] else []
    parts += [spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(f"{path}/*.json")] if path in files else []
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(*(F.col(_CAMEL.get(n, n)).alias(n) for n in names))


def ulid(milliseconds: Column, run_id: Column, place: Column) -> Column:
    """26 characters that sort by time and then, within a run, by place: 48 bits of time, 40 of the run's hash, 40 of the place."""
    digit = lambda n, width: F.lpad(F.translate(F.conv(n.cast("string"), 10, 32), "".join(_PLAIN), _CROCKFORD), width, "0")
    forty = F.lit((1 << 40) - 1)
    return F.concat(digit(milliseconds, 10), digit(F.xxhash64(run_id).bitwiseAND(forty), 8), digit(place.bitwiseAND(forty), 8))


def stamp(events: DataFrame, run_id: str, batch_ms: int, order: list[str]) -> DataFrame:
    """Events with ULIDs that sort in the order given, and one id for the run; the same events have the same ids in every attempt."""
    rows = placed(events, *order)
    return rows.withColumn("entry_id", ulid(F.lit(batch_ms), F.lit(run_id), F.col("place"))).withColumn("run_id", F.lit(run_id)).drop("place")


def append_ledger(events: DataFrame, path: str) -> None:
    _ndjson(path)
    events.select(*(F.col(c).alias(_CAMEL.get(c, c)) for c in events.columns)).write.mode("append").json(path)


def append_run(events: DataFrame, path: str, run_id: str, as_of: datetime, order: list[str]) -> DataFrame:
    """Checks the run's events against the ledger and each other and appends those that may follow; the rejected ones come back.

    A run is a folder of its own that counts when it is finished, so a job that is repeated, or dies and is repeated, adds
    its events once. The batch's time is ``as_of``.
    """
    _ndjson(path)
    spark, folder = events.sparkSession, f"{path}/run-{run_id}"
    judged = checkpointed(judge(events, latest(read_ledger(spark, path).where(F.col("run_id") != run_id), order="entry_id"), as_of, order))
    if folder not in _entries(spark, path):
        good = stamp(judged.where("not rejected").drop("rejected"), run_id, int(as_of.timestamp() * 1000), order).withColumn("timestamp", F.lit(as_of))
        names = [c for c in good.columns if c in {x.strip().split(" ")[0] for x in LEDGER.replace("array<struct<kind:string,data:string>>", "x").split(",")}]
        good.select(*(F.col(c).alias(_CAMEL.get(c, c)) for c in names)).write.mode("overwrite").json(folder)
    return judged.where("rejected").drop("rejected")


def export_states(states: DataFrame, payload: list[str]) -> DataFrame:
    """(state, items): one JSON array per state that has rows, items in fingerprint order; for small ledgers.

    An array is one row in one task. ``export_lines`` has no such bound.
    """
    return states.groupBy("state").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*payload)))).alias("items"))


def export_lines(states: DataFrame, payload: list[str]) -> DataFrame:
    """(state, item): one JSON object per row, sorted over range partitions by state and payload."""
    rows = states.repartitionByRange("state", *payload).sortWithinPartitions("state", *payload)
    return rows.select("state", F.to_json(F.struct(*payload)).alias("item"))


def export_sections(**sections: tuple[DataFrame, list[str]]) -> DataFrame:
    """(section, item): findings, axioms, insights or whatever there is to export, a JSON object a line, each section in the order of its fields."""
    lines = [rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("item")) for name, (rows, payload) in sections.items()]
    return reduce(DataFrame.unionByName, lines).repartitionByRange("section", "item").sortWithinPartitions("section", "item")


def read_facts(spark: SparkSession, folder: str, needed: list[str]) -> dict[str, DataFrame]:
    """Only the fact tables that are asked for, each with its fixed schema."""
    return {k: spark.read.schema(FACTS[k]).parquet(f"{folder}/{k}") for k in needed if k in FACTS}


def list_sources(files: DataFrame, exclude: tuple[str, ...] = (), keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """The source files to process: vendored paths and those that an exclude glob matches go; a file of several sets stays once."""
    rows = files.where(~F.col("path").rlike(r"node_modules|dist"))
    if exclude:
        rows = rows.where(~matches(F.col("path"), exclude))
    return rows.dropDuplicates([*[k for k in keys if k in files.columns], "path"])


def number_lines(rows: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    """``ingest_seq``: the place of an imported event in its file."""
    return rows.withColumn("ingest_seq", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
