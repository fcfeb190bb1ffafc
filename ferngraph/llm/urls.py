"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

All of it is DataFrame code: features are expressions, each level of a tree is one
aggregation of a histogram, and the fitted trees are one nested CASE expression.

Defined results: a null url, or one without ``://``, has empty host and path and fits
no rule; its features are those of the empty text (null) or of the text itself.
Repeated urls are judged alike.  Without labelled urls everything is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The trees are fitted on at most about so many labelled urls, chosen by hash.
FIT_ROWS = 40_000
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "suffix_rate", "suffix_rows")
#: Rules are literals of the plan up to so many; more are refused.
MAX_RULES = 2000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


def rules(*texts: str) -> list[Rule]:
    """``("block com/en/", ...)`` -> rules."""
    out = []
    for t in texts:
        action, _, where = t.partition(" ")
        host, _, path = where.partition("/")
        out.append(Rule(action, host.translate(str.maketrans(UPPER, LOWER)), "/" + path))
    if len(out) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, known: list[Rule]) -> Column:
    """The longest fitting rule as struct (n, rule, action), else null; of equals, the last by text."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action")))
        for r in known
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,action:string>")


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features (but suffix statistics) and ``suffix``, as ``_f_*``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = split_url(u)
    n = F.greatest(F.length(u), F.lit(1))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    params = F.when(query == "", F.lit(0)).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"))) + 1)
    df = df.withColumn("_u", u)
    entropy = F.expr(
        "aggregate(transform(array_distinct(split(_u, '')), c -> IF(c = '', 0D, (length(_u) - length(replace(_u, c, ''))) / length(_u))), 0D, (a, p) -> a - IF(p > 0, p * log2(p), 0D))"
    )
    return df.withColumns(
        {
            "_f_length": F.length(u).cast("double"),
            "_f_depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"),
            "_f_digit_ratio": digits / n,
            "_f_entropy": entropy,
            "_f_params": params.cast("double"),
            "_suffix": F.substring_index(host, ".", -1),
        }
    ).drop("_u")


@dataclass
class Model:
    base: float
    trees: list
    cuts: dict[str, list[float]]
    suffixes: DataFrame | None
    prior: float

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Adds ``_score``, the probability of block."""
        x = features(df, url)
        if self.suffixes is None:
            x = x.withColumns({"_f_suffix_rate": F.lit(self.prior), "_f_suffix_rows": F.lit(0.0)})
        else:
            s = self.suffixes.withColumnRenamed("_suffix", "_s")
            x = x.join(s, F.col("_suffix") == F.col("_s"), "left").drop("_s")
            x = x.withColumns({"_f_suffix_rate": F.coalesce("_f_suffix_rate", F.lit(self.prior)), "_f_suffix_rows": F.coalesce("_f_suffix_rows", F.lit(0.0))})
        total = F.lit(self.base)
        for t in self.trees:
            total = total + _tree(t, lambda f, c: F.col(f"_f_{f}") > c)
        x = x.withColumn("_score", 1 / (1 + F.exp(-total)))
        return x.drop("_suffix", *[f"_f_{f}" for f in FEATURES])


def _tree(t, above) -> Column:
    if isinstance(t, float):
        return F.lit(t)
    f, cut, _, low, high = t
    return F.when(above(f, cut), _tree(high, above)).otherwise(_tree(low, above))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rounds: int = 6, depth: int = 2, rate: float = 0.5, bins: int = 16, fit_rows: int = FIT_ROWS) -> Model:
    """Boosted trees (logistic loss) on rows (url, label 0/1).  Suffix statistics count
    every labelled url; the trees see a bounded sample by hash."""
    x = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("y")).where("y is not null")
    suffix = features(x, "url").groupBy("_suffix").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    suffix = written(suffix, "suffixes")
    pos, n = suffix.agg(F.sum("pos"), F.sum("n")).first()
    if not n:
        return Model(-4.0, [], {}, None, 0.0)
    prior = pos / n
    base = math.log((pos + 0.5) / (n - pos + 0.5))
    suffix = suffix.select("_suffix", ((F.col("pos") + 10 * prior) / (F.col("n") + 10)).alias("_f_suffix_rate"), F.log2(F.col("n") + 1.0).alias("_f_suffix_rows"))
    x = x.where(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < F.lit(min(1.0, fit_rows / n) * 1_000_003))
    x = features(x, "url").join(suffix, "_suffix").select("y", *[f"_f_{f}" for f in FEATURES])
    grid = [i / bins for i in range(1, bins)]
    row = x.agg(*[F.percentile_approx(f"_f_{f}", grid).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    # rows of the same bins are one row from here on
    binned = [sum((F.when(F.col(f"_f_{f}") > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f"_b_{f}") for f in FEATURES]
    data = written(x.select("y", *binned).groupBy(*[f"_b_{f}" for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "binned")
    trees: list = []
    code = {f: {c: i for i, c in enumerate(cuts[f])} for f in FEATURES}
    above = lambda f, c: F.col(f"_b_{f}") > code[f][c]
    for _ in range(rounds):
        total = F.lit(base)
        for t in trees:
            total = total + _tree(t, above)
        p = 1 / (1 + F.exp(-total))
        rows = data.select("*", (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        splits: dict[int, tuple] = {}
        leaf: dict[int, float] = {}
        for level in range(depth):
            node = F.lit(1)
            for _ in range(level):
                step = F.lit(None).cast("int")
                for k, (f, c) in splits.items():
                    step = F.when(node == k, F.when(above(f, c), 2 * k + 1).otherwise(2 * k)).otherwise(step)
                node = step
            long = rows.select(node.alias("node"), "g", "h", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in FEATURES])).alias("x")).where("node is not null")
            sums: dict = {}
            for r in long.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            for k, by in sums.items():
                best = None
                for f in FEATURES:
                    g_all, h_all = (sum(v[i] for v in by[f].values()) for i in (0, 1))
                    g = h = 0.0
                    for b in range(len(cuts[f])):
                        dg, dh = by[f].get(b, (0.0, 0.0))
                        g, h = g + dg, h + dh
                        gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, cuts[f][b], g, h, g_all, h_all)
                if best and best[0] > 1e-6:
                    _, f, c, g, h, ga, ha = best
                    splits[k] = (f, c)
                    leaf[2 * k], leaf[2 * k + 1] = rate * g / (h + 1), rate * (ga - g) / (ha - h + 1)

        def build(k, splits=splits, leaf=leaf):
            if k in splits:
                return (*splits[k], None, build(2 * k), build(2 * k + 1))
            return float(leaf.get(k, 0.0))

        if 1 not in splits:
            break
        trees.append(build(1))
    return Model(base, trees, cuts, suffix, prior)


def judge(df: DataFrame, known: list[Rule], url: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict and block_score, which replace columns of these names.  The trees learn from ``labelled`` (url,
    label), or else from the urls that a rule decides."""
    u = F.col(url)
    host, path = split_url(u)
    x = df.withColumns({"_host": host, "_path": path})
    x = x.withColumn("_rule", fitting_rule(F.col("_host"), F.col("_path"), known))
    if labelled is None:
        labelled = x.where("_rule is not null").select(u.alias("url"), (F.col("_rule.action") == "block").cast("int").alias("label"))
    x = fit(labelled).score(x, url)
    own = F.when(F.col("_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    return x.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", own).alias("verdict"), F.col("_score").alias("block_score"))
