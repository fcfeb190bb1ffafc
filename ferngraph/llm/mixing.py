"""Mixing sources to target weights by pivotal dependent rounding (DataFrame only).

Every row of a source is due ``target / source_size`` copies.  The integral part is
given outright; the fractional part is rounded by the pivotal method: two rows pair
their probabilities and mass (words) moves at random from one to the other until one
of them is integral.  The words of a pair stay as they are, so a source misses its
target by part of its last row only.  Rows meet by hash in blocks of about ``BLOCK`` rows,
largest first, so that small rows settle large ones; what is left of each block (one row)
goes up a reduction tree whose nodes take ``BLOCK`` residuals each, so no task gathers more.
Rows that hold more than 1 / ``LARGE`` of their source (fewer than ``LARGE`` of each) are
rounded among themselves before; the others are then due what these leave of the target.

Defined results: null text has size 0; a null source is a source of its own, last in
order; a source of size 0 takes nothing; rows that agree in key, source and size are
separate rows (each is rounded); an empty table gives an empty mix.  Randomness comes
from hashes of the keys and the seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferngraph.session import written

BLOCK = 128
LARGE = 100
#: Probabilities this near to 0 or 1 are integral.
EPS = "1e-9D"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: A lookup table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of rows (source, size): weights by rank of source,
    shares of the total capped at ``cap`` times the source, the excess reshared.

    Reshared shares are ``min(cap * size, level * weight)`` for one level; sources sorted
    by ``cap * size / weight`` reach their caps in that order, which gives the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    order = W.orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    x = per.withColumn("w", w)
    x = x.withColumn("k", F.row_number().over(order)).withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("level") * F.col("w") < limit, F.struct("k", "level"))).over(every)["level"]
    return x.select("source", "source_size", F.least(limit, F.coalesce(level * F.col("w"), limit)).alias("target"))


def _draw(*parts) -> str:
    return f"(pmod(xxhash64({', '.join(map(str, parts))}), 4503599627370496L) / 4503599627370496.0D)"


def _fold(items: str, kind: str, seed: int, level: int) -> str:
    """SQL that folds an array of items (size, h, key, p) pairwise: ``done`` = decided
    items with their bit, ``rest`` = the one item left, with its probability.

    ``up`` words can move from x to the rest and ``down`` words back before one of the two
    is integral; chances of down : up leave each expectation, and the sum of words, as is.
    """
    u = _draw(seed, level, "a.rest.h", "x.h", "a.rest.size", "x.size")
    moves = """named_struct('up', least((1D - a.rest.p) * a.rest.size, x.p * x.size),
        'down', least(a.rest.p * a.rest.size, (1D - x.p) * x.size))"""
    words = f"transform(array({moves}), m -> IF({u} * (m.up + m.down) < m.down, m.up, -m.down))[0]"
    after = f"transform(array({words}), w -> named_struct('a', a.rest.p + w / a.rest.size, 'x', x.p - w / x.size))[0]"
    split = f"""transform(array({after}), p -> IF(p.a < {EPS} OR p.a > 1D - {EPS},
        named_struct('ends', a.rest, 'bit', int(p.a > 0.5D), 'holds', x, 'p', p.x),
        named_struct('ends', x, 'bit', int(p.x > 0.5D), 'holds', a.rest, 'p', p.a)))[0]"""
    step = f"""transform(array({split}), r -> named_struct(
        'done', concat(a.done, array(named_struct('item', r.ends, 'bit', r.bit))),
        'rest', named_struct('size', r.holds.size, 'h', r.holds.h, 'key', r.holds.key, 'p', r.p)))[0]"""
    start = f"named_struct('done', cast(array() as array<struct<item:{kind},bit:int>>), 'rest', {items}[0])"
    return f"aggregate(slice({items}, 2, size({items})), {start}, (a, x) -> {step})"


def pivotal(items: DataFrame, seed: int) -> DataFrame:
    """Round items (source, size, key struct, h, p) to (source, size, key, bit)."""
    empty = items.where("size = 0").select("source", "size", "key", F.lit(0).alias("bit"))
    items = items.where("size > 0")
    count = written(items.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "blocks")
    c = count.withColumnRenamed("source", "_s")
    if count.count() <= BROADCAST_ROWS:
        c = F.broadcast(c)
    items = items.join(c, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    top = count.agg(F.max("blocks")).first()[0] or 1
    items = items.select("source", F.pmod("h", F.col("blocks")).alias("block"), F.struct("size", "h", "key", "p").alias("item"))
    kind = items.schema["item"].dataType.simpleString()
    done, level = None, 0
    while True:
        grouped = items.groupBy("source", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        node = written(grouped.select("source", "block", F.expr(_fold("items", kind, seed, level)).alias("r")), f"level{level}")
        part = node.select("source", F.explode("r.done").alias("d")).select("source", "d.item.size", "d.item.key", "d.bit")
        done = part if done is None else done.unionByName(part)
        rest = node.select("source", "block", F.col("r.rest").alias("item"))
        if top <= 1:
            u = F.expr(_draw(seed, "'top'", "item.h", "item.size"))
            end = rest.select("source", "item.size", "item.key", (u < F.col("item.p")).cast("int").alias("bit"))
            return done.unionByName(end).unionByName(empty)
        items = rest.select("source", F.floor(F.col("block") / BLOCK).alias("block"), "item")
        top, level = -(-top // BLOCK), level + 1


def mix(df: DataFrame, keys: list[str], seed: int = 17, weights=WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """Rows (keys..., source, size) -> the same rows with source_size, target, copies, taken."""
    base = df.groupBy("source", "size", *keys).agg(F.count("*").alias("n"))
    base = written(base, "rows")
    targets = written(source_targets(base.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap), "targets")
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    t = targets.withColumnRenamed("source", "_t")
    on = F.col("source").eqNullSafe(F.col("_t"))
    # equal rows were counted once; two steps bring them back without one huge array
    rows = base.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1024"))).alias("hi"))
    rows = rows.select("*", F.explode(F.expr("sequence(hi * 1024, least(n, (hi + 1) * 1024) - 1)")).alias("nth"))
    rows = rows.select("source", "size", F.struct(*keys, "nth").alias("key"), F.xxhash64(F.lit(seed), *keys, "nth", "size").alias("h")).join(t, on)

    def rounded(part: DataFrame, due: Column, salt: int) -> tuple[DataFrame, Column]:
        """Bits for the fractional part of ``due``, and its integral part."""
        whole = F.floor(due + F.lit(1e-12))
        p = F.greatest(F.lit(0.0), F.least(due - whole, F.lit(1.0 - 1e-12)))
        return pivotal(part.select("source", "size", "key", "h", p.alias("p")), seed + salt), whole

    big = F.col("size") * LARGE > F.col("source_size")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    bits, whole = rounded(rows.where(big), due, 0)
    large = written(bits.join(t, on).select("source", "size", "key", (whole + F.col("bit")).cast("long").alias("copies")), "large")
    # what the largest rows took, and how many words the others are due
    took = large.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("took"), F.sum("size").alias("held"))
    rest = targets.join(took.withColumnRenamed("source", "_t"), on, "left")
    left = F.col("source_size") - F.coalesce("held", F.lit(0))
    per = F.when(left > 0, F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("target") - F.coalesce("took", F.lit(0))) / left)).otherwise(F.lit(0.0))
    rest = written(rest.select("source", "source_size", "target", per.alias("due")), "rest")
    if rest.count() <= BROADCAST_ROWS:
        rest = F.broadcast(rest)
    r = rest.withColumnRenamed("source", "_t")
    bits, whole = rounded(rows.where(~big).drop(*t.columns).join(r, on), F.col("due"), 100)
    small = bits.join(r, on).select("source", "size", "key", (whole + F.col("bit")).cast("long").alias("copies"))
    out = large.unionByName(small).join(t, on)
    out = out.select(*[F.col(f"key.{k}").alias(k) for k in keys], "source", "size", "source_size", "target", "copies")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The documents of the mix, each once, with size, source_size, target, copies and
    taken, which replace columns of these names; documents without a copy are left out.  Rows equal in all columns are told
    apart by number only."""
    names = docs.columns
    k1, k2 = F.xxhash64(*names), F.xxhash64(F.lit("mix"), *names)
    keyed = docs.select(F.struct(*names).alias("_row"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), k1.alias("_k1"), k2.alias("_k2"))
    plan = mix(keyed.select("source", "size", "_k1", "_k2"), ["_k1", "_k2"], seed)
    plan = plan.where("copies > 0").groupBy("_k1", "_k2", "size", "source_size", "target", "copies", "taken").agg(F.count("*").alias("_n"))
    once = keyed.select("_k1", "_k2", "_row").dropDuplicates(["_k1", "_k2"])
    out = once.join(plan, ["_k1", "_k2"])
    out = out.withColumn("_hi", F.explode(F.expr("sequence(0L, (_n - 1) div 1024)")))
    out = out.withColumn("_nth", F.explode(F.expr("sequence(_hi * 1024, least(_n, (_hi + 1) * 1024) - 1)")))
    own = ("size", "source_size", "target", "copies", "taken")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names if c not in own], *own)
