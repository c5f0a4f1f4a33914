"""Supersession, contradictions, consolidation, model decisions and their application."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.ordered import carried_scan, numbered
from .retrieve import embed_batch, vector_topk

# fixed values: entity types that count for supersession, and words that negate
SUPERSEDING = ("cve", "actor", "tool", "campaign", "asset", "person", "location", "organization", "event", "activity", "temporal")
NEGATIONS = ("not", "never", "no longer", "ceased", "discontinued", "denied")


def negated(text: Column) -> Column:
    return F.lower(text).rlike("|".join(NEGATIONS))


def extract_facts(completions: DataFrame, most: int = 5, least_importance: int = 1) -> DataFrame:
    """(note_id, rank, fact, importance) of JSON completions: importance 1 to 10, 5 where it can't be read, most important first."""
    rows = completions.select("note_id", F.posexplode(F.from_json("json", "array<struct<fact:string,importance:string>>")).alias("at", "f"))
    value = F.least(F.greatest(F.coalesce(F.expr("try_cast(f.importance AS INT)"), F.lit(5)), F.lit(1)), F.lit(10))
    rows = rows.select("note_id", "at", F.col("f.fact").alias("fact"), value.alias("importance")).where(F.col("fact").isNotNull() & (F.col("importance") >= least_importance))
    w = Window.partitionBy("note_id").orderBy(F.desc("importance"), "at")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("note_id", "rank", "fact", "importance")


def decide_operation(facts: DataFrame) -> DataFrame:
    """Adds ``operation`` to facts (neighbour, json): ADD without a neighbour or where the answer can't be read."""
    said = F.upper(F.get_json_object("json", "$.operation"))
    return facts.withColumn("operation", F.when(F.col("neighbour").isNull() | said.isNull() | ~said.isin("ADD", "UPDATE", "DELETE", "NOOP"), "ADD").otherwise(said))


def apply_operations(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inserted facts with their status, and (old, new) supersessions, from (fact_id, fact, neighbour, operation)."""
    status = F.when(F.col("operation") == "ADD", "added").when(F.col("operation") == "UPDATE", "updated").when(F.col("operation") == "DELETE", "corrected").otherwise("noop")
    done = decided.withColumn("status", status)
    replaced = done.where(F.col("operation").isin("UPDATE", "DELETE") & F.col("neighbour").isNotNull()).select(F.col("neighbour").alias("old"), F.col("fact_id").alias("new"))
    return done.where("operation <> 'NOOP'").select("fact_id", "fact", "status"), replaced


#: Entities in more sets than this are looked at only where rarer ones can't decide.
HOT = 1000


def supersession_candidates(new: DataFrame, notes: DataFrame, index: DataFrame, threshold: float = 1.0, hot: int = HOT) -> DataFrame:
    """(new_id, old_id, score): for each of ``new`` (note_id, created_at) the live older or newer note that shares most
    entities, plus up to one for age; ``notes`` are the live ones.

    Notes with the same entities are one set, and sets are scored against sets. The age adds at most one and ties go to
    the younger note, so only sets that share most with a new note can hold its best. Entities of more than ``hot`` sets
    come in only for sets that share no more by rarer ones than they have hot ones.
    """
    known = index.where(F.col("entity_type").isin(*SUPERSEDING)).select("note_id", F.concat_ws(":", "entity_type", "entity_value").alias("entity"))
    known = known.groupBy("note_id").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    known = cut(known.withColumn("set_id", F.sha2(F.concat_ws("\n", "entities"), 256)))
    live = cut(known.join(notes.select("note_id", "created_at"), "note_id").select("note_id", "set_id", "entities", "created_at"))
    sets = live.groupBy("set_id").agg(F.first("entities").alias("entities"), F.count("*").alias("members"))
    posts = sets.select("set_id", "members", "entities", F.explode("entities").alias("entity"))
    posts = cut(posts.join(posts.groupBy("entity").agg((F.count("*") > hot).alias("hot")), "entity"))
    mine = new.select(F.col("note_id").alias("new_id"), F.col("created_at").alias("new_at")).join(known.withColumnRenamed("note_id", "new_id"), "new_id")
    mine = cut(mine.join(notes.select(F.col("note_id").alias("new_id"), F.lit(1).alias("in_live")).distinct(), "new_id", "left").fillna(0, "in_live"))
    wants = mine.select(F.col("set_id").alias("want"), "in_live", F.col("entities").alias("wanted")).distinct()
    asked = wants.select("want", "in_live", "wanted", F.explode("wanted").alias("entity"))

    def scored(asking: DataFrame, held: DataFrame) -> DataFrame:
        pairs = asking.join(held, "entity").where((F.col("set_id") != F.col("want")) | (F.col("members") > F.col("in_live")))
        return pairs.select("want", "in_live", "set_id", F.size(F.array_intersect("wanted", "entities")).alias("n")).distinct()

    rare = cut(scored(asked, posts.where("NOT hot")))
    most = rare.groupBy("want", "in_live").agg(F.max("n").alias("most"))
    hots = asked.join(posts.where("hot").select("entity").distinct(), "entity").groupBy("want", "in_live").agg(F.count("*").alias("hots"))
    unsure = hots.join(most, ["want", "in_live"], "left").where("coalesce(most, 0) <= hots").select("want", "in_live")
    pairs = rare.union(scored(asked.join(unsure, ["want", "in_live"], "left_semi"), posts.where("hot"))).distinct()
    pairs = pairs.groupBy("want", "in_live", "n").agg(F.collect_set("set_id").alias("sets")).groupBy("want", "in_live").agg(F.max(F.struct("n", "sets")).alias("b"))
    best = pairs.select("want", "in_live", "b.n", F.explode("b.sets").alias("set_id"))
    # of notes with equal sets and times only the first can win, or the second for the first itself
    first = Window.partitionBy("set_id", "created_at").orderBy("note_id")
    heads = live.withColumn("k", F.row_number().over(first)).where("k <= 2").select("set_id", "note_id", "created_at")
    ids = F.slice(F.array_sort(F.collect_list("note_id")), 1, 2).alias("ids")
    held = best.join(heads, "set_id").groupBy("want", "in_live", "n", "created_at").agg(ids)
    return _best_by_age(mine.select("new_id", "new_at", F.col("set_id").alias("want"), "in_live"), held).where(F.col("score") >= threshold)


def _best_by_age(asks: DataFrame, held: DataFrame) -> DataFrame:
    """(new_id, old_id, score): for each of ``asks`` (new_id, new_at, want, in_live) the best by age of the notes of its ``want``.

    ``held`` (want, in_live, n, created_at, ids): a row per time, with the first two notes of that time. Of notes that are older by
    a day or more, which adds one, the youngest wins; else the oldest, if it is older at all; else the youngest. So a new
    note needs the neighbours of the time a day before its own, which two scans in order of time tell, and the youngest times,
    but no pairs of notes. An unknown time adds one.
    """
    key, day = ["want", "in_live"], 86400
    kind = dict(held.dtypes)["created_at"]
    second = F.coalesce(F.unix_timestamp("created_at"), F.lit(-(2**60)))
    head = F.struct(second.alias("s"), "ids")
    rows = cut(held.select(*key, second.alias("at"), F.col("created_at").alias("t"), F.lit(0).alias("asks"), head.alias("head"), F.lit(None).cast("string").alias("new_id"), "n"))
    now = F.coalesce(F.unix_timestamp("new_at"), F.lit(2**60))
    asking = asks.select(*key, (now - day).alias("at"), F.lit(None).cast(kind).alias("t"), F.lit(1).alias("asks"), F.lit(None).cast("struct<s:bigint,ids:array<string>>").alias("head"), "new_id", F.lit(None).cast("int").alias("n"))
    upto = Window.partitionBy(*key).orderBy("at", "asks", "t").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("asks"), "t").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.union(asking).withColumn("old", F.last("head", True).over(upto)).withColumn("next", F.last("head", True).over(since)).where("asks = 1")
    # the two youngest times: a new note may be all there is of the last one
    ends = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("t")))).where("k <= 2")
    ends = ends.groupBy(*key).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("head.ids"))).alias(f"end{k}") for k in (1, 2)])
    seen = seen.select(*key, "new_id", (F.col("at") + day).alias("now"), "old", "next").join(ends, key)
    other = lambda ids: F.get(F.filter(ids, lambda x: x != F.col("new_id")), F.lit(0))
    younger = F.col("next.s") < F.col("now")
    pick = F.when(F.col("old").isNotNull(), other(F.col("old.ids"))).when(younger, other(F.col("next.ids")))
    pick = pick.otherwise(F.coalesce(other(F.col("end1")), other(F.coalesce("end2", F.array().cast("array<string>")))))
    age = F.when(F.col("old").isNotNull(), 1.0).when(younger, (F.col("now") - F.col("next.s")) / day).otherwise(0.0)
    return seen.select("new_id", pick.alias("old_id"), F.round(F.col("n") + age, 9).alias("score")).where("old_id IS NOT NULL")


def mark_superseded(pairs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SUPERSEDES edges of (new_id, old_id), and the index without the old notes."""
    edges = pairs.select(F.concat(F.lit("note:"), "new_id").alias("from_id"), F.concat(F.lit("note:"), "old_id").alias("to_id"), F.lit("SUPERSEDES").alias("relationship"))
    return edges, index.join(pairs.select(F.col("old_id").alias("note_id")).distinct(), "note_id", "left_anti")


def superseded_notes(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``notes`` with ``superseded_by``, the first (by id) of the notes that replace it, and ``supersedes``, all that it replaces.

    ``pairs`` (new_id, old_id) whose notes aren't both there count for nothing.
    """
    ids = notes.select("note_id")
    known = pairs.join(ids.withColumnRenamed("note_id", "new_id"), "new_id", "left_semi").join(ids.withColumnRenamed("note_id", "old_id"), "old_id", "left_semi")
    by = known.groupBy(F.col("old_id").alias("note_id")).agg(F.min("new_id").alias("superseded_by"))
    of = known.groupBy(F.col("new_id").alias("note_id")).agg(F.sort_array(F.collect_set("old_id")).alias("supersedes"))
    none = F.array().cast("array<string>")
    return notes.join(by, "note_id", "left").join(of, "note_id", "left").withColumn("supersedes", F.coalesce("supersedes", none))


def find_similar(facts: DataFrame, vectors: DataFrame, most: int = 3) -> DataFrame:
    """(fact_id, rank, note_id, score): for each fact (fact_id, note_id, domain, vector) the most similar notes of its domain.

    ``vectors`` (note_id, domain, vector). The note that a fact is from is no neighbour of it. Blocks of facts meet blocks of
    notes of one domain.
    """
    out = None
    for domain in [r[0] for r in facts.select("domain").where("domain IS NOT NULL").distinct().collect()]:  # a few names
        here = F.col("domain") == domain
        near = vector_topk(facts.where(here).select("fact_id", "vector"), vectors.where(here).select("note_id", "vector"), most + 1, None)
        out = near if out is None else out.union(near)
    if out is None:
        return facts.select("fact_id", F.lit(0).alias("rank"), "note_id", F.lit(0.0).alias("score")).limit(0)
    others = out.withColumnRenamed("query_id", "fact_id").join(facts.select(F.col("fact_id").cast("string").alias("fact_id"), F.col("note_id").cast("string").alias("own")), "fact_id").where("NOT own <=> note_id")
    w = Window.partitionBy("fact_id").orderBy("rank")
    return others.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("fact_id", "rank", "note_id", "score")


def entity_components(notes: DataFrame, index: DataFrame, key: str = "stream") -> DataFrame:
    """``notes`` with ``key``: the least note_id of those reachable over shared superseding entities; its own without any.

    Notes with the same entities are one set, named by the least of them. Each round takes the least label among the sets of an
    entity, then that label's own label, so long chains halve.
    """
    links = index.where(F.col("entity_type").isin(*SUPERSEDING)).join(notes.select("note_id"), "note_id", "left_semi")
    held = cut(links.groupBy("note_id").agg(F.sort_array(F.collect_set(F.concat_ws(":", "entity_type", "entity_value"))).alias("entities")))
    sets = cut(held.groupBy("entities").agg(F.min("note_id").alias("id")))
    links = cut(sets.select("id", F.explode("entities").alias("entity")))
    labels = cut(sets.select("id", F.col("id").alias("label")))
    while True:
        least = links.join(labels, "id").groupBy("entity").agg(F.min("label").alias("label"))
        near = links.join(least, "entity").groupBy("id").agg(F.min("label").alias("via"))
        step = labels.withColumnRenamed("label", "old").join(near, "id")
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        moved = cut(step.join(jump, "via", "left").select("id", "old", F.least("via", F.coalesce("far", "via")).alias("label")))
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            break
    labels = held.join(sets.join(labels, "id"), "entities").select("note_id", "label")
    return notes.join(labels, "note_id", "left").withColumn(key, F.coalesce("label", "note_id")).drop("label")


#: Notes of a slice of a replay, about.
SLICE = 5000


def supersession_replay(notes: DataFrame, index: DataFrame, key: str = "stream", size: int = SLICE, held: DataFrame | None = None) -> DataFrame:
    """(key, note_id, superseded_by): notes applied in order of time within each ``key``, each replacing at most one live note.

    A note replaces the live note that shares most entities with it, plus up to one for a day of age (ties: newer, then
    smaller id). Notes of different keys never meet. Notes without superseding entities stay live. ``held`` are live notes that came
    before all others, whatever their time; they replace nothing.

    Notes are cut into slices of ``size`` in order of time, replayed side by side. A slice starts from the older notes that are
    still live by what is known so far and share an entity with one of its notes. The first round knows none, later rounds
    look back over twice as many slices each, eight times as many after one that changed nothing, so few notes are carried
    before most are known to be gone. Only slices that start from other notes than before are replayed again, and a round
    reads only what slices leave live or replace of others. Rounds end when all slices are looked back on and nothing
    changes, which then is what one pass gives.
    """
    index = index.where(F.col("entity_type").isin(*SUPERSEDING)).groupBy("note_id").agg(F.collect_set(F.concat_ws(":", "entity_type", "entity_value")).alias("entities"))
    new = notes.select(F.col(key).cast("string").alias(key), "note_id", "created_at", F.lit(True).alias("own"))
    if held is not None:
        new = new.union(held.select(F.col(key).cast("string").alias(key), "note_id", "created_at", F.lit(False).alias("own")))
    every = cut(new.join(index, "note_id", "left"))
    named = every.where("entities IS NOT NULL").withColumn("entities", F.transform("entities", lambda e: F.concat_ws("\n", F.col(key), e)))
    rows = numbered(named.select("note_id", F.col("created_at").cast("timestamp").alias("created_at"), "entities", "own"), ["own", "created_at", "note_id"], size)
    slices = (rows.agg(F.max("slice")).first()[0] or 0) + 1
    # where each entity is found: a number per slice at most, and none for entities of one slice
    found = cut(rows.select("slice", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sort_array(F.collect_set("slice")).alias("found")).where("size(found) > 1"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        """(slice, old, by, here, ...): notes that are replaced, and of the slice's own (``here``) those left live, whose ``by`` is -1."""
        live: dict[int, tuple] = {}
        postings: dict[str, dict[int, None]] = {}
        number, out = int(pdf["slice"].iloc[0]), []
        pdf = pdf.sort_values("at")
        for at, made, own, mine, name in zip(pdf["at"].tolist(), pdf["created_at"], pdf["entities"], pdf["own"].tolist(), pdf["note_id"]):
            shared: dict[int, int] = {}
            for e in own if mine else ():
                for other in postings.get(e, ()):
                    shared[other] = shared.get(other, 0) + 1
            if shared:
                age = {x: max(0.0, min((made - live[x][0]).total_seconds() / 86400, 1.0)) for x in shared}
                old = min(shared, key=lambda x: (-shared[x] - age[x], -live[x][0].value, live[x][2]))
                out.append((number, old, at, old // size == number, None, None, None))
                for e in live.pop(old)[1]:
                    del postings[e][old]
            live[at] = (made, own, name)
            for e in own:
                postings.setdefault(e, {})[at] = None
        out += [(number, at, -1, True, *note) for at, note in live.items() if at // size == number]
        return pd.DataFrame(out, columns=["slice", "old", "by", "here", "created_at", "entities", "note_id"])

    schema = "slice int, old long, `by` long, here boolean, created_at timestamp, entities array<string>, note_id string"
    runs, ends, into, todo, mine, reach = [], None, None, None, rows, 0
    while mine is not None or reach < slices - 1:
        if mine is not None:
            new = cut(mine.groupBy("slice").applyInPandas(replay, schema))
            runs.append((new.where("here AND `by` >= 0").select("slice", "old", "by"), todo))
            beyond = new.where("NOT here OR `by` < 0")
            ends = cut(beyond if todo is None else ends.join(todo, "slice", "left_anti").unionByName(beyond))
        reach = min(slices, max(1, reach * (8 if mine is None else 2)))
        gone = ends.where("NOT here").groupBy("old").agg(F.min("by").alias("by"))
        last = F.least(F.col("slice") + reach, F.coalesce(F.expr(f"CAST(`by` DIV {size} AS INT)"), F.lit(slices)))
        older = ends.where("here AND `by` < 0").drop("by").join(gone, "old", "left").withColumn("last", last)
        meets = older.select(F.col("old").alias("at"), "slice", "last", F.explode("entities").alias("entity")).join(found, "entity")
        now = cut(meets.select("at", F.explode(F.expr("filter(found, x -> x > slice AND x <= last)")).alias("slice")).distinct())
        differ = now if into is None else now.join(into, ["slice", "at"], "left_anti").unionByName(into.join(now, ["slice", "at"], "left_anti"))
        todo, into = cut(differ.select("slice").distinct()), now
        mine = None
        if not todo.isEmpty():
            carried = now.join(todo, "slice", "left_semi").join(older.select(F.col("old").alias("at"), "note_id", "created_at", "entities"), "at")
            mine = rows.join(todo, "slice", "left_semi").unionByName(carried.withColumn("own", F.lit(False)))
    now, later = ends.where("NOT here").select("old", "by"), None
    for pairs, todo in reversed(runs):  # what a slice's last run gives
        now = now.union((pairs if later is None else pairs.join(later, "slice", "left_anti")).select("old", "by"))
        later = todo if later is None else later if todo is None else later.union(todo).distinct()
    names = rows.select("at", "note_id")
    pairs = now.join(names.withColumnRenamed("at", "old"), "old").select("note_id", "by").join(names.select(F.col("at").alias("by"), F.col("note_id").alias("superseded_by")), "by").drop("by")
    return every.select(key, "note_id").join(pairs, "note_id", "left").select(key, "note_id", "superseded_by")


class ShiftState:
    """What the shift detector holds of one stream: entities with count and last time, topic weights, the number of notes, the last time.

    With ``idle``, entities that were not seen for so many hours are forgotten; the first form of the state has all since the
    last reset.
    """

    def __init__(self, entities=None, topics=None, count: int = 0, last: float | None = None, idle: float | None = None):
        self.entities, self.topics, self.count, self.last, self.idle = {k: tuple(v) for k, v in dict(entities or {}).items()}, dict(topics or {}), count, last, idle

    def known(self, entity: str, at: float) -> bool:
        return entity in self.entities and (self.idle is None or at - self.entities[entity][1] < 3600 * self.idle)

    def shift(self, entities: list[str], domain: str, at: float, novelty: float = 0.4, departure: float = 0.5, gap_hours: float = 4.0, least: int = 3) -> list[str]:
        """Signals that a note departs from the state."""
        if self.count < least:
            return []
        out = []
        if entities and sum(not self.known(e, at) for e in entities) / len(entities) >= novelty:
            out.append("entity_novelty")
        total = math.fsum(self.topics.values())  # the same in any order
        if total > 0 and self.topics.get(domain, 0) / total < departure / max(len(self.topics), 1):
            out.append("topic_shift")
        if self.last is not None and at - self.last >= 3600 * gap_hours:
            out.append("temporal_gap")
        return out

    def observe(self, entities: list[str], domain: str, at: float, alpha: float = 0.3) -> None:
        self.count += 1
        for e in entities:
            self.entities[e] = (self.entities[e][0] + 1 if self.known(e, at) else 1, at)
        self.topics = {t: w * (1 - alpha) for t, w in self.topics.items()}
        self.topics[domain] = self.topics.get(domain, 0) + alpha
        self.last = at

    def kept(self) -> list:
        """What has to be held of the state: without the entities that are forgotten by now."""
        entities = self.entities if self.last is None else {e: v for e, v in self.entities.items() if self.known(e, self.last)}
        return [entities, self.topics, self.count, self.last]

    def take(self, entities: list[str], domain: str, at: float) -> tuple[list[str], ShiftState]:
        """A note's signals, and the state after it: a new one from the note on, if it departs."""
        signals = self.shift(entities, domain, at)
        state = ShiftState(idle=self.idle) if signals else self
        state.observe(entities, domain, at)
        return signals, state


def shift_detect(notes: DataFrame, key: str = "stream", size: int = SLICE, idle: float | None = None) -> DataFrame:
    """(key, note_id, signals, is_shift) of notes (key, note_id, created_at, domain, entities) in order of time per key.

    Notes are cut into slices of ``size`` in order of key and time; a slice takes the state that the slice before it leaves.
    Null entities are none.
    """

    def detect(pdf: pd.DataFrame, held: str | None) -> tuple[pd.DataFrame, str]:
        of, state, out = None, ShiftState(idle=idle), []
        if held is not None:
            of, *parts = json.loads(held)
            state = ShiftState(*parts, idle=idle)
        for k, note_id, made, domain, entities in zip(pdf[key], pdf["note_id"], pdf["created_at"], pdf["domain"], pdf["entities"]):
            if [k] != of:
                of, state = [k], ShiftState(idle=idle)
            signals, state = state.take(sorted(entities) if entities is not None else [], domain, made.timestamp())
            out.append((k, note_id, ",".join(signals), bool(signals)))
        return pd.DataFrame(out, columns=[key, "note_id", "signals", "is_shift"]), json.dumps([of, *state.kept()], sort_keys=True)

    rows = notes.select(F.col(key).cast("string").alias(key), "note_id", F.col("created_at").cast("timestamp").alias("created_at"), "domain", "entities")
    return carried_scan(numbered(rows, [key, "created_at", "note_id"], size), detect, f"{key} string, note_id string, signals string, is_shift boolean")


def consolidation_candidates(notes: DataFrame, index: DataFrame, since: str, least: int = 3) -> DataFrame:
    """note_id of live notes since ``since`` that share an entity with another of their domain.

    Notes whose ``superseded_by``, if there is such a column, isn't null or empty are not live; with fewer than ``least`` live
    notes since then there are no candidates. A null domain is "general".
    """
    live = notes.where(F.coalesce("superseded_by", F.lit("")) == "") if "superseded_by" in notes.columns else notes
    recent = live.where(F.col("created_at") >= F.lit(since).cast("timestamp")).select("note_id", F.coalesce("domain", F.lit("general")).alias("domain"))
    enough = recent.limit(least).agg((F.count("*") >= least).alias("enough"))
    shared = recent.join(index, "note_id").select("domain", "entity_type", "entity_value", "note_id").distinct()
    hot = shared.groupBy("domain", "entity_type", "entity_value").agg(F.count("*").alias("n")).where("n >= 2")
    found = shared.join(hot, ["domain", "entity_type", "entity_value"], "left_semi").select("note_id").distinct()
    return found.crossJoin(F.broadcast(enough)).where("enough").select("note_id")  # one row


def contradictions(notes: DataFrame, index: DataFrame) -> DataFrame:
    """note_id of notes contradicted by a newer one: they share an entity and exactly one of the two is negated.

    A note is contradicted if, for one of its entities, the newest note of the other polarity is newer; of two of one
    time, the one with the smaller id counts as older. So one aggregate per entity replaces pairs of notes.
    """
    marked = notes.select("note_id", "created_at", negated(F.col("content_raw")).alias("neg"))
    rows = cut(index.join(marked, "note_id"))  # read twice
    ends = rows.groupBy("entity_type", "entity_value").agg(*[F.max(F.when(F.col("neg") == n, F.struct("created_at", "note_id"))).alias(f"last_{n}".lower()) for n in (True, False)])
    other = F.when(F.col("neg"), F.col("last_false")).otherwise(F.col("last_true"))
    return rows.join(ends, ["entity_type", "entity_value"]).where(other > F.struct("created_at", "note_id")).select("note_id").distinct()


def promote_tier(notes: DataFrame, candidates: DataFrame, contradicted: DataFrame) -> DataFrame:
    """(note_id, tier): uncontradicted candidates become tier A."""
    up = candidates.join(contradicted, "note_id", "left_anti").withColumn("up", F.lit(True))
    return notes.join(up, "note_id", "left").select("note_id", F.when(F.col("up"), "A").otherwise(F.col("tier")).alias("tier"))


def consolidation_report(notes: DataFrame, candidates: DataFrame, contradicted: DataFrame) -> DataFrame:
    """One row: candidates, contradicted among them, promoted."""
    rows = candidates.join(contradicted.withColumn("c", F.lit(1)), "note_id", "left").join(notes.select("note_id", "tier"), "note_id")
    return rows.agg(F.count("*").alias("candidates"), F.count("c").alias("contradicted"), F.count(F.when(F.col("c").isNull() & (F.col("tier") != "A"), 1)).alias("promoted"))


def evolution_candidates(ranked: DataFrame, most: int = 5) -> DataFrame:
    """(note_id, rank, neighbour): the best neighbours of each note other than itself, from (query_id, note_id, rank)."""
    rows = ranked.where("query_id <> note_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select(F.col("query_id").alias("note_id"), F.col("k").alias("rank"), F.col("note_id").alias("neighbour"))


def evolution_validate(completions: DataFrame) -> DataFrame:
    """Adds action, content and valid: evolve needs content, keep needs none, all else is an error."""
    action, content = F.get_json_object("json", "$.action"), F.get_json_object("json", "$.content")
    valid = (action == "keep") | ((action == "evolve") & (F.length(F.trim(content)) > 0))
    return completions.select("note_id", action.alias("action"), content.alias("content"), F.coalesce(valid, F.lit(False)).alias("valid"))


def evolution_apply(notes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Notes with valid evolutions applied: the old text kept, one more evolution, confidence at most 0.95.

    If ``notes`` have a ``vector``, that of an evolved note is made anew from the first 1000 characters of its new text.
    """
    new = decisions.where("valid AND action = 'evolve'").select("note_id", F.col("content").alias("new_raw"))
    j = notes.join(new, "note_id", "left")
    hit = F.col("new_raw").isNotNull()
    columns = ["note_id", F.when(hit, F.col("content_raw")).alias("previous_raw"), F.coalesce("new_raw", "content_raw").alias("content_raw"), F.when(hit, F.col("evolution_count") + 1).otherwise(F.col("evolution_count")).alias("evolution_count"), F.when(hit, F.least("confidence", F.lit(0.95))).otherwise(F.col("confidence")).alias("confidence")]
    if "vector" in notes.columns:
        made = embed_batch(new.select("note_id", F.substring("new_raw", 1, 1000).alias("text")), "note_id", "text").withColumnRenamed("vector", "made")
        j = j.join(made, "note_id", "left")
        columns.append(F.coalesce("made", "vector").alias("vector"))
    return j.select(*columns)


def evolution_rollback(notes: DataFrame) -> DataFrame:
    """Notes with a previous text get it back and lose one evolution, not below 0."""
    hit = F.col("previous_raw").isNotNull()
    return notes.select("note_id", F.lit(None).cast("string").alias("previous_raw"), F.coalesce("previous_raw", "content_raw").alias("content_raw"), F.when(hit, F.greatest(F.col("evolution_count") - 1, F.lit(0))).otherwise(F.col("evolution_count")).alias("evolution_count"))


def evolution_report(decisions: DataFrame) -> DataFrame:
    flag = lambda c: F.count(F.when(c, 1))
    return decisions.agg(F.count("*").alias("candidates"), flag(F.col("valid")).alias("evaluated"), flag(F.col("valid") & (F.col("action") == "evolve")).alias("evolved"), flag(F.col("valid") & (F.col("action") == "keep")).alias("kept"), flag(~F.col("valid")).alias("errors"))

