r"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share these turns' nodes.  The nodes of
all trees are laid out depth-first in one stream, each once; a node carries its start
in the stream, the position id of its first unit (what its conversation has before
it) and the stream intervals of its ancestors, the only ones it may attend to besides
itself.  Units are code points, or tokens if the path of a rank file is given.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``.  Inside texts ``<|`` becomes ``<\|``,
``<\|`` becomes ``<\\|`` and so on, so no control string of the template can be forged
and unescaping is exact.

Defined results: rows of a conversation are ordered by turn, then role, then text,
nulls first; null roles and texts are empty; repeated rows are turns of their own; a
null conv_id is a conversation; an empty table gives an empty stream.  From its
``MAX_DEPTH``-th turn on a conversation's turns make one node together up to where
conversations part or one of them ends.  Each such place has a conversation of its own
that is at least as long as the key, so keys grow with the input and no faster.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.session import ship, written

START, END = "<|im_start|>", "<|im_end|>\n"
MAX_DEPTH = 128
NODE = (
    "node string, parent string, tree string, depth int, path binary, segment string, units long, position long, "
    "loss array<struct<start:long,end:long>>, ancestors array<string>, tokens array<int>"
)

NAMES = [c.split()[0] for c in NODE.split(", ")]
NODE_TYPES = [
    pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.int32()),
]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        line, stop = formatted.index("\n", at), formatted.index(END, at)
        role = unescape(formatted[at + len(START) : line])
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        out.append((role, unescape(formatted[line + 1 : stop])))
        at = stop + len(END)
    return out


def _encoder(path: str, pattern: str, cache: dict = {}):  # noqa: B006
    if path not in cache:
        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        # control strings get ids of their own behind the vocabulary
        top = max(ranks.values()) + 1
        cache[path] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={START: top, END.strip(): top + 1})
    return cache[path]


def _nodes(conv_type, tokenizer: tuple[str, str] | None):
    def run(batches):
        seen: set[str] = set()
        for b in batches:
            rows: list[tuple] = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = [(t["role"] or "", t["text"] or "") for t in turns]
                parent, tree, path, position, ancestors, node = "", "", b"", 0, [], ""
                for depth, (role, text) in enumerate(parts):
                    segment, x, y = turn(role, text)
                    loss = [{"start": x, "end": y}] if role == "assistant" else []
                    digest = hashlib.sha256(f"{parent}\n{segment}".encode("utf-8", "surrogatepass")).digest()[:16]
                    node = digest.hex()
                    tokens = None
                    if tokenizer:
                        enc = _encoder(*tokenizer)
                        tokens = enc.encode(segment, allowed_special="all")
                    units = len(tokens) if tokens is not None else len(segment)
                    at = depth - MAX_DEPTH + 1
                    if at >= 0:  # a turn of the tail; the first one has the state of what is before it
                        before = (path, list(ancestors)) if at == 0 else (None, None)
                        rows.append((conv, False, node, parent or None, tree, depth, before[0], segment, units, position, loss, before[1], tokens, at))
                        parent = node
                        continue
                    tree, path = tree or node, path + digest[:8]
                    if node not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(node)
                        rows.append((None, False, node, parent or None, tree, depth, path, segment, units, position, loss, list(ancestors), tokens, None))
                    position += units
                    ancestors.append(node)
                    parent = node
                if node:
                    rows.append((conv, True, node, *[None] * 11))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 14
            types = [conv_type, pa.bool_(), *NODE_TYPES, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "leaf", *NAMES, "at"])

    return run


def _runs(batches):
    """The turns of each tail -> its nodes, which end where ``stop`` is set."""
    for b in batches:
        rows = []
        for turns in b.column(0).to_pylist():
            first = turns[0]
            tree, parent, position, path, ancestors, run = first["tree"], first["parent"], first["position"], first["path"], first["ancestors"], []
            depth = first["depth"]
            for t in turns:
                run.append(t)
                if not t["stop"]:
                    continue
                segment, loss = "", []
                for u in run:
                    loss += [{"start": len(segment) + x["start"], "end": len(segment) + x["end"]} for x in u["loss"]]
                    segment += u["segment"]
                tokens = None if t["tokens"] is None else [x for u in run for x in u["tokens"]]
                units, path = sum(u["units"] for u in run), path + bytes.fromhex(t["node"])[:8]
                rows.append((t["node"], parent, tree, depth, path, segment, units, position, loss, list(ancestors), tokens))
                ancestors.append(t["node"])
                parent, depth, position, run = t["node"], depth + 1, position + units, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, NODE_TYPES, strict=True)], NAMES)


def _tails(made: DataFrame) -> DataFrame:
    """The nodes from the ``MAX_DEPTH``-th turn on."""
    deep = made.where("at IS NOT NULL")
    parted = deep.select("parent", "node").distinct().groupBy("parent").count().where("count > 1").select(F.col("parent").alias("node"))
    stops = parted.unionByName(made.where("leaf").select("node")).distinct().withColumn("stop", F.lit(True))
    turns = F.struct("at", *NAMES, F.coalesce("stop", F.lit(False)).alias("stop"))
    return deep.join(stops, "node", "left").groupBy("conv_id").agg(F.sort_array(F.collect_list(turns)).alias("turns")).select("turns").mapInArrow(_runs, NODE)


def _running(batches):
    total = 0
    for b in batches:
        starts = []
        for u in b.column("units").to_pylist():
            starts.append(total)
            total += u
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())], [*b.schema.names, "start"])


def build(turns: DataFrame, conv_id: str = "conv_id", turn_no: str = "turn", role: str = "role", text: str = "text", tokenizer: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): the stream's nodes with start, position, ``attends`` (ancestors'
    intervals, neighbours merged), and (conv_id, node), the last node of each conversation."""
    spark = turns.sparkSession
    ship(spark)
    item = F.struct(F.col(turn_no).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    convs = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = convs.schema["conv_id"].dataType
    made = written(convs.mapInArrow(_nodes(to_arrow_type(kind), tokenizer), f"conv_id {kind.simpleString()}, leaf boolean, {NODE}, at int"), "turns")
    single = made.where("NOT leaf AND at IS NULL").select(*NAMES)
    if not made.where("at IS NOT NULL").isEmpty():
        single = single.unionByName(_tails(made))
    nodes = single.groupBy("node").agg(*[F.first(c).alias(c) for c in NAMES[1:]])
    # depth-first order is the order of paths: a parent's path begins its children's
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = nodes.repartitionByRange(parts, "path", "node").sortWithinPartitions("path", "node").withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    placed = written(ordered.mapInArrow(_running, fields + ", start long"), "placed")
    total, offset = 0, {}
    for r in placed.groupBy("part").agg(F.sum("units").alias("n")).orderBy("part").collect():
        offset[r["part"]] = total
        total += r["n"]
    lookup = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])[F.col("part")] if offset else F.lit(0)
    placed = placed.withColumn("start", F.col("start") + lookup).drop("part", "path")
    up = placed.select("node", F.explode("ancestors").alias("up"))
    where = placed.select(F.col("node").alias("up"), F.struct("start", (F.col("start") + F.col("units")).alias("end")).alias("at"))
    spans = up.join(where, "up").groupBy("node").agg(F.sort_array(F.collect_list("at")).alias("spans"))
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> IF(size(a) > 0 AND a[size(a) - 1].end = x.start,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', x.end))), concat(a, array(x))))"
    )
    nodes = placed.join(spans.select("node", merged.alias("attends")), "node", "left")
    nodes = nodes.withColumn("attends", F.coalesce("attends", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))
    return nodes, made.where("leaf").select("conv_id", "node")


def _digest(conv_type):
    def run(batches):
        for b in batches:
            out = []
            for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                formatted = "".join(p["segment"] for p in parts)
                turns = parse(formatted)
                loss = "".join(unescape(p["segment"][x["start"] : x["end"]]) for p in parts for x in p["loss"])
                digest = hashlib.sha256()
                for r, t in turns:
                    digest.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                out.append((conv, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Digests of each conversation, from its leaf and the leaf's ancestors in the stream."""
    from pyspark.sql.pandas.types import to_arrow_type

    lines = leaves.join(nodes.select("node", "ancestors"), "node").select("conv_id", F.explode(F.concat("ancestors", F.array("node"))).alias("node"))
    parts = lines.join(nodes.select("node", "start", "segment", "loss"), "node")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "loss"))).alias("parts"))
    kind = whole.schema["conv_id"].dataType
    return whole.mapInArrow(_digest(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
