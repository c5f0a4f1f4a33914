"""Telemetry roll-ups, operation logs and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.quantiles import order_statistics

# fixed values: event classes of operation logs (class id, class, category id, category), numbers of named activities,
# and the activity of classes that have one, or one for success and one for failure
OCSF_CLASSES = (
    ("api", 6002, "API Activity", 6, "Application Activity"),
    ("authentication", 3001, "Authentication", 3, "Identity & Access Management"),
    ("authorization", 3003, "Authorization", 3, "Identity & Access Management"),
    ("config", 5002, "Configuration Change", 5, "Discovery"),
    ("file", 1001, "File Activity", 1, "System Activity"),
    ("process", 1007, "Process Activity", 1, "System Activity"),
    ("account", 3005, "Account Change", 3, "Identity & Access Management"),
)
OCSF_ACTIVITIES = {
    "file": ("Create", "Read", "Update", "Delete"), "process": ("Start", "Stop", "Crash", "Restart"), "account": ("Create", "Update", "Disable", "Delete"),
    "authentication": "Logon", "authorization": ("Access Grant", "Access Deny"), "config": "Update",
}
SEVERITIES = ("Unknown", "Informational", "Low", "Medium", "High", "Critical")


def when_type(kind: str, value: str = "1") -> Column:
    return F.when(F.col("event_type") == kind, F.expr(value))


def recall_events(results: DataFrame) -> DataFrame:
    """(query_id, notes, result_count): per query its notes (note_id, rank, tier) as one ranked list."""
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "note_id", "tier"))).alias("notes"), F.count("*").alias("result_count"))


def tier_distribution(rows: DataFrame) -> DataFrame:
    return rows.where("event_type = 'recall'").groupBy("tier").agg(F.count("*").alias("n"))


def auto_feedback(retrieved: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, note_id, utility): 4 for retrieved notes that were cited, 2 for others."""
    j = retrieved.select("query_id", "note_id").distinct().join(cited.select("query_id", "note_id").distinct().withColumn("c", F.lit(1)), ["query_id", "note_id"], "left")
    return j.select("query_id", "note_id", F.when(F.col("c") == 1, 4).otherwise(2).alias("utility"))


def daily_report(events: DataFrame) -> DataFrame:
    """One row per day: queries, syntheses, mean latencies, confidence, notes per query, feedback."""
    agg = events.groupBy("event_date").agg(
        F.countDistinct(when_type("recall", "query_id")).alias("total_queries"),
        F.count(when_type("synthesis")).alias("total_synthesis"),
        F.round(F.avg(when_type("recall", "duration_ms")), 2).alias("avg_recall_latency_ms"),
        F.round(F.avg(when_type("synthesis", "duration_ms")), 2).alias("avg_synthesis_latency_ms"),
        F.round(F.avg(when_type("synthesis", "confidence")), 4).alias("avg_confidence"),
        F.count(when_type("recall")).alias("recalled"),
        F.count(when_type("feedback")).alias("feedback_count"),
        F.round(F.avg(when_type("feedback", "utility")), 2).alias("avg_utility"),
    )
    return agg.withColumn("notes_per_query", F.when(F.col("total_queries") > 0, F.round(F.col("recalled") / F.col("total_queries"), 2))).drop("recalled")


def top_utility_notes(events: DataFrame, k: int = 10) -> DataFrame:
    return events.where("event_type = 'feedback' AND utility > 0").groupBy("note_id").agg(F.sum("utility").alias("utility")).orderBy(F.desc("utility"), "note_id").limit(k)


def unused_notes_uncited(events: DataFrame) -> DataFrame:
    """note_id of notes retrieved but never cited by a synthesis."""
    got, cited = (events.where(F.col("event_type") == k).select("note_id").distinct() for k in ("recall", "synthesis"))
    return got.join(cited, "note_id", "left_anti")


def unused_notes_low_utility(events: DataFrame, least: int = 4) -> DataFrame:
    """note_id of notes retrieved that never had feedback of at least ``least``."""
    got = events.where("event_type = 'recall'").select("note_id").distinct()
    good = events.where((F.col("event_type") == "feedback") & (F.col("utility") >= least)).select("note_id").distinct()
    return got.join(good, "note_id", "left_anti")


def daily_volume(events: DataFrame) -> DataFrame:
    return events.groupBy("event_date", "event_type").agg(F.count("*").alias("n"))


def daily_volume_wide(events: DataFrame) -> DataFrame:
    return events.groupBy("event_date").pivot("event_type", ["recall", "synthesis", "feedback", "human_eval"]).agg(F.count(F.lit(1))).na.fill(0)


def latency_percentiles(events: DataFrame) -> DataFrame:
    """p50, p95 and maximum per event type, interpolated."""
    ends = cut(events.groupBy("event_type").agg(F.count("duration_ms").alias("n"), F.max("duration_ms").alias("max_ms")))
    shares = ends.select("event_type", "n", F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    wanted = shares.select("event_type", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k"))
    found = order_statistics(events, "event_type", "duration_ms", wanted)
    lower, upper = (found.withColumnRenamed("value", name).withColumnRenamed("k", f"{name}_at") for name in ("low", "high"))
    both = shares.withColumn("low_at", F.floor("at")).withColumn("high_at", F.ceil("at")).join(lower, ["event_type", "low_at"]).join(upper, ["event_type", "high_at"])
    value = F.round(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.col("low_at")), 6)
    cells = both.groupBy("event_type").agg(F.max(F.when(F.col("p") == 0.5, value)).alias("p50"), F.max(F.when(F.col("p") == 0.95, value)).alias("p95"))
    return ends.join(cells, "event_type", "left").select("event_type", "p50", "p95", "max_ms")


def latency_nearest_rank(events: DataFrame, by: str = "event_type", value: str = "duration_ms") -> DataFrame:
    """p50 and p95 per group as the values at positions n / 2 and int(0.95 n) of the sorted list."""
    ends = cut(events.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n")))
    at50, at95 = F.floor(F.col("n") / 2), F.floor(F.col("n") * 95 / 100)
    found = order_statistics(events, by, value, ends.select(by, F.explode(F.array(at50, at95)).alias("k")))
    rows = ends.join(found, by)
    kind = dict(events.dtypes)[value]
    return rows.groupBy(by).agg(*[F.max(F.when(F.col("k") == at, F.col("value"))).cast(kind).alias(name) for name, at in (("p50", at50), ("p95", at95))])


def utility_trend(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'feedback'").groupBy("event_date").agg(F.round(F.avg("utility"), 6).alias("mean_utility"))


def top_intents(events: DataFrame) -> DataFrame:
    return events.groupBy("intent").agg(F.count("*").alias("n"))


def history(events: DataFrame, as_of: str, days: int = 7, limit: int = 50) -> DataFrame:
    """The newest ``limit`` events of the last ``days`` days before ``as_of``."""
    return events.where((F.col("event_date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("event_date") <= F.lit(as_of).cast("date"))).orderBy(F.desc("ts"), "event_id").limit(limit)


def human_eval_sample(events: DataFrame, n: int = 20, seed: str = "7") -> DataFrame:
    """``n`` syntheses in the order of a seeded hash, shown in order of time."""
    return events.where("event_type = 'synthesis'").withColumn("h", F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(seed)))).orderBy("h").limit(n).drop("h").orderBy("ts")


def operation_metrics(events: DataFrame, slow: float = 50.0) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.when(F.col("duration_ms") > slow, 1.0).otherwise(0.0)), 6).alias("slow_percent"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def rate_violations(events: DataFrame, key: str, most: int, seconds: int = 60) -> DataFrame:
    """Events beyond ``most`` of one key within the trailing ``seconds``."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w)).where(F.col("n") > most).select("event_id", key, "n")


# fixed values: fields of event classes beyond the base, and the classes that have each; ``always`` lists those where it may be empty
OCSF_FIELDS = {
    "actor": ("api", "authentication", "authorization", "config", "file", "account"),
    "resource": ("api", "authorization", "config"),
    "duration_ms": ("api", "file"),
    "auth_protocol": ("authentication",),
    "src_endpoint": ("authentication",),
    "privileges": ("authorization",),
    "policy": ("authorization",),
    "prev_value": ("config", "account"),
    "new_value": ("config", "account"),
    "file_path": ("file",),
    "process_name": ("process",),
    "user": ("account",),
}
OCSF_ALWAYS = {
    "actor": ("authentication", "authorization", "account"),
    "resource": ("authorization", "config"),
    "auth_protocol": ("authentication",),
    "prev_value": ("config", "account"),
    "new_value": ("config", "account"),
    "file_path": ("file",),
    "process_name": ("process",),
    "user": ("account",),
}


def _class_fields(logs: DataFrame) -> list[Column]:
    """The fields of each row's class, in the shapes of the schema; a column that ``logs`` lacks is null."""
    value = {}
    for name, kinds in OCSF_FIELDS.items():
        v = F.col(name) if name in logs.columns else F.lit(None).cast("double" if name == "duration_ms" else "string")
        if name == "duration_ms":
            value[name] = F.when(F.col("kind").isin(*kinds), F.round(v.cast("double"), 2))
        else:
            told = F.col("kind").isin(*OCSF_ALWAYS.get(name, ("",))) | (v.cast("string") != "")
            value[name] = F.when(F.col("kind").isin(*kinds) & told, v.cast("string"))

    def shape(name: str, *path: str) -> Column:
        inner = value[name]
        for p in reversed(path):
            inner = F.struct(inner.alias(p))
        return F.when(value[name].isNotNull(), inner)

    return [
        shape("actor", "user", "name").alias("actor"), value["resource"].alias("resource"), value["duration_ms"].alias("duration_ms"), value["auth_protocol"].alias("auth_protocol"),
        shape("src_endpoint", "ip").alias("src_endpoint"), value["privileges"].alias("privileges"), value["policy"].alias("policy"), value["prev_value"].alias("prev_value"),
        value["new_value"].alias("new_value"), shape("file_path", "path").alias("file"), shape("process_name", "name").alias("process"), shape("user", "name").alias("user"),
    ]


def ocsf_normalize(logs: DataFrame) -> DataFrame:
    """Log rows (event_id, kind, activity, severity_id, ok, ts) as events of the open schema, base fields first.

    An unknown activity has number 0; rows of an unknown kind keep null class fields. Columns named in OCSF_FIELDS, as far as
    ``logs`` has them, go to the classes that know them.
    """
    named_kinds = ("file", "process", "account")
    number = F.coalesce(
        *[F.when((F.col("kind") == k) & (F.col("activity") == a), i) for k in named_kinds for i, a in enumerate(OCSF_ACTIVITIES[k], 1)],
        F.when(F.col("kind").isin("api", "authorization"), F.when(F.col("ok"), 1).otherwise(2)), F.when(F.col("kind").isin("authentication", "config"), 1), F.lit(0),
    )
    grant, deny = OCSF_ACTIVITIES["authorization"]
    title = F.when(F.col("kind") == "authorization", F.when(F.col("ok"), grant).otherwise(deny))
    for k in ("authentication", "config"):
        title = title.when(F.col("kind") == k, OCSF_ACTIVITIES[k])
    logs = logs.withColumn("activity_id", number).withColumn("activity", title.otherwise(F.col("activity")))
    table = logs.sparkSession.createDataFrame(OCSF_CLASSES, "kind string, class_uid int, class_name string, category_uid int, category_name string")
    named = F.coalesce(*[F.when(F.col("severity_id") == k, name) for k, name in enumerate(SEVERITIES)], F.lit("Unknown"))
    rows = logs.join(F.broadcast(table), "kind", "left")  # one row per class
    return rows.select("event_id", "class_uid", "class_name", "category_uid", "category_name", "severity_id", named.alias("severity"), "activity_id", F.col("activity").alias("activity_name"), F.when(F.col("ok"), 1).otherwise(2).alias("status_id"), F.when(F.col("ok"), "Success").otherwise("Failure").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.lit(0).alias("timezone_offset"), (F.col("class_uid") * 100 + F.col("activity_id")).alias("type_uid"), *_class_fields(logs))


def log_tail(logs: DataFrame, lines: int, level: str) -> DataFrame:
    """Of the last ``lines`` rows those of one level."""
    return logs.orderBy(F.desc("ts"), F.desc("event_id")).limit(lines).where(F.col("level") == level)
