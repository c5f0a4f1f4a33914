"""Chat formatting over a prefix tree.

Each turn is written as ``<|turn|>role<|says|>text<|end|>``. In roles and texts ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l``
and ``[`` becomes ``\\b``, so no control string of this or other templates can occur inside, and the text comes back exactly.

Conversations that share initial turns share a path from the root of a tree. A node is a run of turns that the same
conversations share, so its text is stored once; nodes are emitted depth first, as the sort order of their paths, in one
stream over all trees. A node carries where it begins in the stream, the position id of its first character (the
characters of its ancestors), and the stream intervals of its ancestors, which its characters attend to besides
themselves in order. Characters (code points) are the units.

Turns are ordered by (turn, role, text), so repeated and tied rows are kept in a fixed order; a null turn comes first,
null roles and texts are empty, a null conversation id is a conversation of its own. Extra columns are ignored. One
conversation's turns are held by one task, as its digests need them in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .ordering import running_starts
from .scratch import materialize

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED = "assistant"
_ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_BACK = {"\\\\": "\\", "\\l": "<", "\\b": "["}
_MARKED = re.compile(r"\\[\\lb]")


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: _BACK[m[0]], text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{SAYS}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.split(SAYS)
        out.append((unescape(role), unescape(text.removesuffix(END))))
    return out


def _conversations(rows: DataFrame) -> DataFrame:
    """row (unique), conv_id, roles, texts (in order), keys (hash of the turns up to each)."""
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key, path = b"", []
                for role, text in zip(roles, texts):
                    key = hashlib.blake2b(key + format_turn(role, text).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    path.append(key)
                out.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(out))), *batch.columns, pa.array(out, pa.list_(pa.binary()))], ["row", "conv_id", "roles", "texts", "keys"])
            row += len(out)

    return whole.mapInArrow(keys, "row long, conv_id long, roles array<string>, texts array<string>, keys array<binary>")


def prefix_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emitted stream and each conversation's path.

    Stream: node, text, turns, begin, length, position, ancestors (array of begin and end in the stream), loss (array of
    intervals inside the text that are learned). Paths: row, conv_id, level, node.
    """
    spark = rows.sparkSession
    convs = materialize(_conversations(rows), "conversations")
    seen = convs.select("row", F.posexplode("keys").alias("k", "key"))
    # a prefix's count, and the conversation that emits it
    shared = seen.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("owner"))
    shared = materialize(shared, "prefixes")
    counts = seen.join(shared, "key").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "n", "owner"))).alias("c"))
    counted = convs.join(counts, "row").select("row", "conv_id", "roles", "texts", "keys", F.col("c.n").alias("n"), F.col("c.owner").alias("owner"))
    schema = "row long, conv_id long, level int, node binary, owned boolean, path binary, above array<binary>, text string, loss array<array<int>>, turns int, length long"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.string(), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.int64()]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                out: list[tuple] = []
                for row, conv, roles, texts, keys, n, owner in zip(*(c.to_pylist() for c in whole.slice(k, 500).columns)):
                    heads = [i for i in range(len(n)) if i == 0 or n[i] != n[i - 1]]
                    path, above = b"", []
                    for level, (a, b) in enumerate(zip(heads, [*heads[1:], len(n)])):
                        node, owned = keys[b - 1], owner[b - 1] == row
                        path += keys[a][:8]
                        text, loss = "", []
                        if owned:
                            for i in range(a, b):
                                piece = format_turn(roles[i], texts[i])
                                if roles[i] == LEARNED:
                                    end = len(text) + len(piece) - len(END)
                                    loss.append([end - len(escape(texts[i])), end])
                                text += piece
                        out.append((row, conv, level, node, owned, path if owned else None, list(above) if owned else None, text if owned else None, loss if owned else None, b - a, len(text) if owned else 0))
                        above.append(node)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in schema.split(", ")])

    nodes = materialize(counted.mapInArrow(runs, schema), "tree-nodes")
    own = nodes.where("owned")
    placed, starts = running_starts(own.select("path", "node", "length"), ["path", "node"], "length", ["node"])
    base = F.element_at(F.array(*[F.lit(int(x)) for x in starts]), F.col("part") + 1)
    begins = materialize(placed.select("node", (base + F.col("local")).alias("begin")).join(own.select("node", "length", "above"), "node"), "node-begins")
    where = begins.select(F.col("node").alias("up"), F.struct(F.col("begin").alias("begin"), (F.col("begin") + F.col("length")).alias("end")).alias("span"))
    climbed = begins.select("node", F.explode("above").alias("up")).join(where, "up").groupBy("node").agg(F.array_sort(F.collect_list("span")).alias("ancestors"))
    stream = own.select("node", "text", "turns", "length", "loss").join(begins.select("node", "begin"), "node").join(climbed, "node", "left")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    stream = stream.withColumn("ancestors", F.coalesce("ancestors", none))
    stream = stream.withColumn("position", F.aggregate("ancestors", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"]))
    return stream.select("node", "text", "turns", "begin", "length", "position", "ancestors", "loss"), nodes.select("row", "conv_id", "level", "node")


def formatted_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the emitted stream."""
    stream, paths = prefix_tree(rows)
    stream = materialize(stream, "chat-stream")
    parts = paths.join(stream.select("node", "text", "loss", "position"), "node").groupBy("row", "conv_id").agg(F.array_sort(F.collect_list(F.struct("level", "position", "text", "loss"))).alias("parts"))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole, learned = "", []
                for p in pieces:
                    if p["position"] != len(whole):
                        raise ValueError(f"conversation {conv}: position {p['position']} follows {len(whole)} characters")
                    whole += p["text"]
                    learned += [unescape(p["text"][a:b]) for a, b in p["loss"]]
                turns, loss = parse_turns(whole), "".join(learned)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in schema.split(", ")])

    return parts.select("conv_id", "parts").mapInArrow(read, schema)
