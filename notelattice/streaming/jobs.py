"""Structured Streaming forms of the batch operators. Each takes and returns streaming DataFrames or starts one query."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lineage import cut
from ..operators import extract, graph, index
from ..operators.evolve import SUPERSEDING, ShiftState, supersession_replay
from ..operators.notes import construct_notes


def _timed(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """``rows`` with a watermark on ``at``, read in the session's time zone if it has none."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def _written(spark: SparkSession, out: str, name: str, number: int, schema: str) -> DataFrame:
    """What batches before ``number`` have written to a table of ``stream_ingest``."""
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{name}").where(F.col("batch") < number).drop("batch")


def stream_ingest(notes: DataFrame, out: str, checkpoint: str):
    """Start a query that writes notes, postings, edges and supersessions of each micro-batch below ``out``.

    A batch writes to folders named by its number, so a batch that runs again replaces its own output. Notes arrive by batch,
    then by time, then by id. Each replaces at most one live note, as in ``evolve.supersession_replay``, of its own batch or
    of those before; of these only live notes that share an entity with the batch are taken along. ``superseded`` has
    (note_id, superseded_by), ``kg_edges`` the SUPERSEDES edges too; postings are kept, ``live_index`` leaves out
    those of replaced notes.
    """

    def superseded(batch: DataFrame, postings: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        keys = ["entity_type", "entity_value"]
        mine = postings.where(F.col("entity_type").isin(*SUPERSEDING)).select(*keys, "note_id")
        older = _written(spark, out, "entity_index", number, "entity_type string, entity_value string, note_id string").join(mine.select(*keys).distinct(), keys, "left_semi").select(*keys, "note_id")
        gone = _written(spark, out, "superseded", number, "note_id string, superseded_by string")
        older = cut(older.join(gone, "note_id", "left_anti").select(*keys, "note_id"))
        held = _written(spark, out, "notes", number, "note_id string, created_at timestamp").join(older.select("note_id").distinct(), "note_id", "left_semi")
        one = F.lit("").alias("stream")
        new = batch.select(one, "note_id", F.col("created_at").cast("timestamp").alias("created_at"))
        pairs = supersession_replay(new, mine.union(older), held=held.select(one, "note_id", "created_at"))
        return pairs.where("superseded_by IS NOT NULL").select("note_id", "superseded_by")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        postings = index.build_entity_index(extract.extract_all_long(batch)).persist()
        pairs = cut(superseded(batch, postings, number))
        note = F.lit("note")
        replaced = pairs.select(note.alias("from_type"), F.col("superseded_by").alias("from_value"), F.lit("SUPERSEDES").alias("relationship"), note.alias("to_type"), F.col("note_id").alias("to_value"), F.col("superseded_by").alias("note_id"))
        built = construct_notes(batch).withColumn("created_at", F.col("created_at").cast("timestamp"))
        for name, rows in (("notes", built), ("entity_index", postings), ("superseded", pairs), ("kg_edges", graph.rule_edges(postings).union(replaced))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        postings.unpersist()
        batch.unpersist()

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_index(spark: SparkSession, out: str) -> DataFrame:
    """Postings that ``stream_ingest`` wrote below ``out``, without those of replaced notes."""
    gone = spark.read.parquet(f"{out}/superseded").select("note_id")
    return spark.read.parquet(f"{out}/entity_index").join(gone, "note_id", "left_anti").select("entity_type", "entity_value", "note_id")


#: fixed values: domains whose notes are enriched whatever their length, and the length beyond which all are
ENRICHED_DOMAINS = ("cti", "incident", "threat_intel")
ENRICHED_LENGTH = 200


def stream_enrich(notes: DataFrame, complete: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start the slow query beside ``stream_ingest``: causal edges of each note (note_id, domain, content_raw) that is worth it, below ``out``.

    ``notes`` is a stream over the notes that ``stream_ingest`` writes; its source's limit per batch bounds what waits for the
    model at a time, and nothing is dropped. ``complete`` gives (note_id, json) for rows of notes. A batch that runs again
    replaces its own output.
    """
    worth = F.coalesce(F.col("domain").isin(*ENRICHED_DOMAINS), F.lit(False)) | (F.length("content_raw") > ENRICHED_LENGTH)

    def write(batch: DataFrame, number: int) -> None:
        edges = graph.causal_edges(graph.causal_triples(complete(batch)))
        edges.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return notes.where(worth).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_dedupe(rows: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(rows, at, delay).dropDuplicatesWithinWatermark(keys)


def stream_rule_matches(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Match events (rule_id, event_id, ts) with their rules' title and level, once per (rule_id, event_id)."""
    return stream_dedupe(matches, ["rule_id", "event_id"]).join(rules.select("rule_id", "title", "level"), "rule_id")


def stream_rule_notes(matches: DataFrame, rules: DataFrame, out: str, checkpoint: str):
    """Start a query that writes a note and an edge for each new match of a rule below ``out``, once per (rule_id, event_id).

    Matches are those of ``stream_rule_matches``; a note is about its event, an edge leads from the note to the rule.
    """

    def write(batch: DataFrame, number: int) -> None:
        note_id = F.concat(F.lit("match_"), F.col("rule_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"))
        text = F.concat(F.lit("Rule "), "title", F.lit(" ("), "level", F.lit(") matched event "), F.col("event_id").cast("string"))
        notes = batch.select(note_id.alias("note_id"), text.alias("content_raw"), F.col("ts").alias("created_at"), F.lit("detection").alias("source_type"))
        edges = batch.select(F.concat(F.lit("note:"), note_id).alias("from_id"), F.concat(F.lit("rule:"), F.col("rule_id").cast("string")).alias("to_id"), F.lit("MATCHED_BY").alias("relationship"))
        for name, rows in (("notes", notes), ("edges", edges)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream_rule_matches(matches, rules).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_telemetry(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events and mean latency per window and type."""
    return _timed(events, "ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_ms")


def stream_log_tail(logs: DataFrame, level: str) -> DataFrame:
    """Log rows of one level; ``logs`` has a ``level``, or is (file, line) of ``sources.logtail`` with JSON lines."""
    if "level" not in logs.columns:
        logs = logs.withColumn("level", F.get_json_object("line", "$.level"))
    return logs.where(F.col("level") == level)


def stream_access_counts(hits: DataFrame, window: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Hits per note, for update mode; with ``window`` per note and window, whose state goes when the watermark has passed it."""
    counts = (F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))
    if window is None:
        return hits.groupBy("note_id").agg(*counts)
    return _timed(hits, "ts", delay).groupBy(F.window("ts", window), "note_id").agg(*counts).select("note_id", F.col("window.start").alias("start"), "access_count", "last_accessed")


def merge_access_counts(held: DataFrame, updates: DataFrame) -> DataFrame:
    """(note_id, access_count, last_accessed) over the last row of each note and window of ``updates``, all micro-batches of update mode."""
    last = updates.groupBy("note_id", "start").agg(F.max("access_count").alias("n"), F.max("last_accessed").alias("at"))
    rows = last.select("note_id", "n", "at").union(held.select("note_id", "access_count", "last_accessed"))
    return rows.groupBy("note_id").agg(F.sum("n").alias("access_count"), F.max("at").alias("last_accessed"))


def stream_session_activity(events: DataFrame, gap: str = "1 hour", key: str = "actor") -> DataFrame:
    """Sessions of each actor that end after ``gap`` without an event."""
    return _timed(events, "ts", gap).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Rows of a run that is sorted in memory, of a piece of its file, and of a frame of output, and runs that are merged at a time.
RUN, PIECE, FRAME, RUNS = 100_000, 500, 10_000, 200


def in_order(frames: Iterator[pd.DataFrame], run: int = RUN) -> Iterator[tuple]:
    """(at in seconds, note_id, domain, sorted entities) of all rows of ``frames`` in order of time, then id, in bounded memory.

    Rows that are more than a run are sorted in runs, which are kept in temporary files and merged.
    """
    order = lambda r: (r[0], r[1] is None, r[1])

    def runs() -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for f in frames:
            held += zip((x.timestamp() for x in f["at"]), f["note_id"], f["domain"], ([] if e is None else sorted(e) for e in f["entities"]))
            if len(held) >= run:
                held.sort(key=order)
                yield held
                held = []
        held.sort(key=order)
        yield held

    def kept(rows: Iterator[tuple]) -> IO[bytes]:
        file, piece = files.enter_context(tempfile.TemporaryFile()), []
        for row in rows:
            piece.append(row)
            if len(piece) == PIECE:
                pickle.dump(piece, file)
                piece = []
        for last in (piece, []) if piece else ([],):  # an empty one ends the file
            pickle.dump(last, file)
        return file

    def read(file: IO[bytes]) -> Iterator[tuple]:
        file.seek(0)
        while piece := pickle.load(file):
            yield from piece
        file.close()

    with ExitStack() as files:
        parts: list[IO[bytes]] = []
        for rows in runs():
            if not parts and len(rows) < run:
                yield from rows
                return
            parts.append(kept(rows))
            if len(parts) == RUNS:
                parts = [kept(heapq.merge(*map(read, parts), key=order))]
        del rows
        yield from heapq.merge(*map(read, parts), key=order)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ShiftProcessor(StatefulProcessor):
    """The shift detector of one stream: entities and topics are maps of the state store, so a note touches its own only.

    With ``idle`` (hours) a timer forgets entities that event time has left behind so long, and the stream with the last of
    them.
    """

    def __init__(self, key: str, idle: float | None, report: bool):
        self.idle, self.columns = idle, [key, "note_id", "signals", *(["held"] if report else [])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entities = handle.getMapState("entities", "entity string", "count int, last double")
        self.topics = handle.getMapState("topics", "topic string", "weight double")
        self.head = handle.getValueState("head", "count int, last double")

    def _load(self) -> ShiftState:
        count, last = self.head.get() if self.head.exists() else (0, None)
        return ShiftState({k[0]: v for k, v in self.entities.iterator()}, {k[0]: v[0] for k, v in self.topics.iterator()}, count, last, self.idle)

    def _store(self, entities: dict, topics: dict, count: int, last: float) -> None:
        """Write what differs from what is held."""
        for held, now in ((self.entities, entities), (self.topics, {t: (w,) for t, w in topics.items()})):
            before = {k[0]: v for k, v in held.iterator()}
            for k in before.keys() - now.keys():
                held.removeKey((k,))
            for k, v in now.items():
                if before.get(k) != v:
                    held.updateValue((k,), v)
        self.head.update((count, last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        for at, note_id, domain, entities in in_order(rows):
            signals, state = state.take(entities, domain, at)
            out.append((key[0], note_id, ",".join(signals), len(state.entities))[: len(self.columns)])
            if len(out) == FRAME:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        self._store(*state.kept())
        self._wake()
        yield pd.DataFrame(out, columns=self.columns)

    def _wake(self) -> None:
        """Set the timer for the entity that is forgotten first."""
        if self.idle is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        times = [v[1] for _, v in self.entities.iterator()]
        if times:
            self.handle.registerTimer(int(1000 * (min(times) + 3600 * self.idle)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for k, v in list(self.entities.iterator()):
            if now - v[1] >= 3600 * self.idle:
                self.entities.removeKey(k)
        if next(iter(self.entities.iterator()), None) is None:
            self.topics.clear()
            self.head.clear()
        else:
            times = [v[1] for _, v in self.entities.iterator()]
            self.handle.registerTimer(int(1000 * (min(times) + 3600 * self.idle)))
        return iter([])

    def close(self) -> None:
        pass


def stream_shift(notes: DataFrame, key: str = "stream", idle: float | None = None, delay: str = "1 hour", report: bool = False) -> DataFrame:
    """(key, note_id, signals) of notes (key, note_id, at in seconds, domain, entities) that depart from their stream's state.

    Notes of one micro-batch and key are taken in order of time, in bounded memory however many they are. ``report``
    adds ``held``, the number of entities in the state after a note.
    Such state needs the RocksDB state store, which is set for the session's queries from here on. A stream that is idle so long that all its entities are forgotten starts anew.
    """
    notes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("at")
    rows = notes.select(F.col(key).cast("string").alias(key), "note_id", at, "domain", "entities")
    rows, mode = (rows, "none") if idle is None else (_timed(rows, "at", delay), "eventTime")
    return rows.groupBy(key).transformWithStateInPandas(ShiftProcessor(key, idle, report), f"{key} string, note_id string, signals string{', held int' if report else ''}", "append", mode)
