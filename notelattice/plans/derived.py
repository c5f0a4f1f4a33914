"""Threat-notes tables derived from the star-schema tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window, functions as F

NOTES = """
SELECT 'note_' || CAST(o_orderkey AS STRING) AS note_id,
       o_orderdate AS created_at,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'cti' WHEN 1 THEN 'incident' ELSE 'general' END AS domain,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier,
       CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'knowledge' WHEN 1 THEN 'memory' WHEN 2 THEN 'wisdom' ELSE 'intelligence' END AS persistence,
       1 + CAST(o_orderkey % 10 AS INT) AS importance,
       CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'synthesis' WHEN 1 THEN 'task_output' WHEN 2 THEN 'conversation' ELSE 'report' END AS source_type,
       'src:' || CAST(o_orderkey % 14000 AS STRING) AS source_ref,
       CAST(o_custkey % 100 AS DOUBLE) / 100.0 AS confidence,
       CAST(o_orderkey % 8 AS INT) AS evolution_count,
       CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'APT' WHEN 1 THEN 'apt ' WHEN 2 THEN 'UNC' WHEN 3 THEN 'Fin-' ELSE 'TA' END
         || CAST(o_custkey % 40 AS STRING)
         || CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN ' uses Cobalt Strike' WHEN 1 THEN ' never uses Mimikatz'
                 WHEN 2 THEN ' used Metasploit' ELSE ' dropped DROPBEAR' END
         || ' and exploits CVE-2024-' || lpad(CAST(o_orderkey % 500 AS STRING), 4, '0')
         || ' via T' || CAST(1000 + o_custkey % 90 AS STRING)
         || ' from 10.' || CAST(o_custkey % 300 AS STRING) || '.3.' || CAST(o_orderkey % 256 AS STRING)
         || '. Contact ops@evil' || CAST(o_custkey % 9 AS STRING) || '.example.com.' AS content_raw
FROM orders
"""

QUESTIONS = """
SELECT c_custkey AS query_id,
       CASE CAST(c_custkey % 6 AS INT)
         WHEN 0 THEN 'What tools does APT' || CAST(c_custkey % 40 AS STRING) || ' use?'
         WHEN 1 THEN 'What is CVE-2024-' || lpad(CAST(c_custkey % 500 AS STRING), 4, '0') || '?'
         WHEN 2 THEN 'When was UNC' || CAST(c_custkey % 40 AS STRING) || ' last seen, before or after 1997?'
         WHEN 3 THEN 'Why did TA' || CAST(c_custkey % 40 AS STRING) || ' succeed?'
         WHEN 4 THEN 'Tell me about Metasploit'
         ELSE 'hello there' END AS text
FROM customer
"""

EDGES = """
SELECT DISTINCT 'actor:' || CAST(o_custkey AS STRING) AS from_id, 'note:' || CAST(o_orderkey AS STRING) AS to_id,
       'MENTIONED_IN' AS relationship, 'heuristic' AS edge_type, o_orderdate AS created_at FROM orders
UNION ALL
SELECT DISTINCT 'actor:' || CAST(o_custkey AS STRING), 'tool:' || CAST(l_partkey AS STRING),
       'USES_TOOL', CASE WHEN l_linenumber = 1 THEN 'causal' ELSE 'heuristic' END, o_orderdate
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL
SELECT DISTINCT 'tool:' || CAST(l_partkey AS STRING), 'cve:' || CAST(l_suppkey AS STRING),
       'EXPLOITS_CVE', 'causal', l_shipdate FROM lineitem WHERE l_linenumber = 1
UNION ALL
SELECT 'note:' || CAST(o_orderkey AS STRING), 'note:' || CAST(prev_key AS STRING), 'SUPERSEDES', 'heuristic', o_orderdate
FROM (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_key
      FROM orders) t WHERE prev_key IS NOT NULL
"""

TELEMETRY = """
SELECT event_id, ts, CAST(ts AS DATE) AS event_date, 'q' || CAST(event_id % 2500 AS STRING) AS query_id,
       CASE event_type WHEN 'view' THEN 'recall' WHEN 'purchase' THEN 'synthesis' WHEN 'click' THEN 'feedback'
            WHEN 'signup' THEN 'recall' ELSE 'human_eval' END AS event_type,
       value AS duration_ms, 'note_' || CAST(user_id AS STRING) AS note_id,
       1 + CAST(event_id % 5 AS INT) AS utility,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier,
       CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'factual' WHEN 1 THEN 'temporal' WHEN 2 THEN 'relational'
            WHEN 3 THEN 'causal' ELSE 'exploratory' END AS intent,
       CAST(event_id % 100 AS DOUBLE) / 100.0 AS confidence
FROM events
"""

PREDICTIONS = """
SELECT CAST(c.conv_id AS STRING) || ':' || CAST(c.turn AS STRING) AS doc_id, c.role AS category,
       lower(c.text) AS predicted, lower(g.text) AS gold
FROM conversations c JOIN conversations g ON g.conv_id = c.conv_id AND g.turn + 1 = c.turn
"""

DERIVED = {"notes": (NOTES, ("orders",)), "questions": (QUESTIONS, ("customer",)), "kg_edges": (EDGES, ("orders", "lineitem")), "telemetry": (TELEMETRY, ("events",)), "predictions": (PREDICTIONS, ("conversations",))}


#: What rows take in memory per byte of their files: a note and its postings about 30 times its order's. Spark's guess is 1, so
#: it broadcasts tables that the driver can't hold.
IN_MEMORY = "32"
#: Notes of a task.
ROWS = 50_000
#: Orders or line items of a task that makes edges of them.
EDGE_ROWS = 200_000


class Tables:
    """The given tables of a folder and those derived from them, as attributes.

    Spark's guess of their sizes in memory is set for the session.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.sources.fileCompressionFactor", IN_MEMORY)

    def _spread(self, df: DataFrame) -> DataFrame:
        """``df`` over at least as many partitions as there are cores, of ROWS rows at most: a split has millions of small rows, and patterns are slow."""
        parts = max(self.spark.sparkContext.defaultParallelism, -(-df.count() // ROWS))  # a count reads no rows
        return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)

    def tasks(self, name: str) -> int:
        """Over how many tasks the rows of the given table ``name`` are dealt: at least as many as there are cores, of EDGE_ROWS rows at most."""
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, name).count() // EDGE_ROWS))  # a count reads no rows

    def _edges(self) -> DataFrame:
        """What EDGES gives, in tasks whose number follows the rows; that of shuffles is fixed, so tasks would grow with the input."""
        few, many = self.tasks("orders"), self.tasks("lineitem")
        orders, lines = self.orders.select("o_orderkey", "o_custkey", "o_orderdate"), self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")

        def edges(rows: DataFrame, start: tuple[str, str], end: tuple[str, str], relationship: str, kind, at: str) -> DataFrame:
            node = [F.concat(F.lit(f"{what}:"), F.col(key).cast("string")) for what, key in (start, end)]
            return rows.select(node[0].alias("from_id"), node[1].alias("to_id"), F.lit(relationship).alias("relationship"), kind.alias("edge_type"), F.col(at).alias("created_at"))

        causal, heuristic = F.lit("causal"), F.lit("heuristic")
        both = orders.repartition(many, "o_orderkey").join(lines.repartition(many, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        distinct = [
            (edges(orders, ("actor", "o_custkey"), ("note", "o_orderkey"), "MENTIONED_IN", heuristic, "o_orderdate"), few),
            (edges(both, ("actor", "o_custkey"), ("tool", "l_partkey"), "USES_TOOL", F.when(F.col("l_linenumber") == 1, causal).otherwise(heuristic), "o_orderdate"), many),
            (edges(lines.where("l_linenumber = 1"), ("tool", "l_partkey"), ("cve", "l_suppkey"), "EXPLOITS_CVE", causal, "l_shipdate"), many),
        ]
        older = orders.repartition(few, "o_custkey").withColumn("prev_key", before).where("prev_key IS NOT NULL")
        out = [rows.repartition(n, "from_id", "to_id").distinct() for rows, n in distinct]
        return out[0].union(out[1]).union(out[2]).union(edges(older, ("note", "o_orderkey"), ("note", "prev_key"), "SUPERSEDES", heuristic, "o_orderdate"))

    def with_table(self, name: str, df: DataFrame) -> Tables:
        """These tables with another one under ``name``."""
        other = Tables(self.spark, self.sf_dir)
        setattr(other, name, df)
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name == "kg_edges":
            df = self._edges()
        elif name in DERIVED:
            sql, needs = DERIVED[name]
            for need in needs:
                sql = sql.replace(f"FROM {need}", f"FROM {{{need}}}").replace(f"JOIN {need}", f"JOIN {{{need}}}")
            df = self.spark.sql(sql, **{need: self._spread(getattr(self, need)) if name == "notes" else getattr(self, need) for need in needs})
        else:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)
        return df


def with_tables(*names: str) -> str:
    """The WITH clause that defines derived tables ``names`` for DuckDB; CTE bodies may follow after a comma."""
    return "WITH " + ", ".join(f"{name} AS ({DERIVED[name][0]})" for name in names)


