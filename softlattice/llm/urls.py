"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Features of a URL: length, path depth, digit ratio, entropy of the host's
characters, parameter count, labels and hyphens of the host, host length,
fragment, and the smoothed block rates of its suffix, of the first segment of its
path, and of both together (its section), exact over all labelled rows; the trees
are fitted on all of them, with rates that leave out the fifth of the URLs that
the row's own belongs to, so a rare section does not give its label away.  The
rates are tables that are joined, of any size.  Labelled URLs are those of a table
that is given, or by default the pages that a rule judges, so the method carries
over to other URLs what the rules say of theirs.  Trees are grown level by level
on histograms: one groupBy of (node, feature, bin) gives the sums of gradients
and Hessians, of which the driver gets nodes x features x bins numbers, and the
fitted trees are CASE expressions, so scoring is one projection.

A null url, or one without `://`, has empty host and path and is judged by the
method; urls are read whole, of any length; of rules of one length that fit, the
later in the list wins; repeated rows get the same verdict; without labelled rows
all are allowed; an empty table gives no rows.  Other columns are not read,
whatever their names.  DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "hyphens", "host_length", "fragment", "suffix_rate", "segment_rate", "section_rate")
RATED = ("suffix", "segment", "section")
BINS, FOLDS = 16, 5


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    host = F.translate(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), _UP, _LOW)
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.withColumns({"rule": rule, "verdict": verdict})


def _entropy(text: str) -> F.Column:
    n = F.length(text)
    one = lambda total, c: total - (n - F.length(F.replace(F.col(text), c))) / n * F.log2((n - F.length(F.replace(F.col(text), c))) / n)
    return F.when(n > 0, F.aggregate(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), F.lit(0.0), one)).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need no statistics, the suffix, the first segment of the path, and the section."""
    many = lambda col, c: (F.length(col) - F.length(F.replace(F.col(col), F.lit(c)))).cast("double")
    digits = F.length(F.regexp_replace("url", r"[^0-9]", "")) / F.greatest(F.length("url"), F.lit(1))
    suffix = F.substring_index("host", ".", -1)
    segment = F.regexp_extract("path", r"^/([^/]*)", 1)
    return rows.withColumns({
        "length": F.length("url").cast("double"), "depth": many("path", "/"), "digits": digits.cast("double"), "entropy": _entropy("host"), "params": many("url", "=") + many("url", "&"),
        "labels": many("host", "."), "hyphens": many("host", "-"), "host_length": F.length("host").cast("double"), "fragment": F.contains("url", F.lit("#")).cast("double"),
        "suffix": suffix, "segment": segment, "section": F.concat(suffix, F.lit("/"), segment),
    })


def _fold() -> F.Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _rates(counts: DataFrame, by: str, mean: float, folds: bool) -> DataFrame:
    """Smoothed block rate of each value of `by`; with folds, of each value and fold from the rows of the others."""
    rate = lambda n, pos: ((pos + 4 * mean) / (n + 4)).alias(f"{by}_rate")
    total = counts.groupBy(by).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    if not folds:
        return total.select(by, rate(F.col("n"), F.col("pos")))
    own = counts.groupBy(by, "fold").agg(F.sum("n").alias("own_n"), F.sum("pos").alias("own_pos"))
    return own.join(total, by).select(by, "fold", rate(F.col("n") - F.col("own_n"), F.col("pos") - F.col("own_pos")))


def _with_rates(rows: DataFrame, stats, folds: bool = False) -> DataFrame:
    counts, mean = stats
    if folds:
        rows = rows.withColumn("fold", _fold())
    for by in RATED:
        rows = rows.join(_rates(counts, by, mean, folds), [by, "fold"] if folds else by, "left")
    return rows.withColumns({f"{by}_rate": F.coalesce(f"{by}_rate", F.lit(mean)) for by in RATED})


def _tree(node, names) -> F.Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, cut, left, right = node
    return F.when(F.col(name) <= cut, _tree(left, names)).otherwise(_tree(right, names))


class Boosted:
    """Fitted trees: nested (feature, cut, left, right) tuples with leaf values, and the base margin."""

    def __init__(self, base: float, trees: list, stats):
        self.base, self.trees, self.stats = base, trees, stats

    def margin(self) -> F.Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + _tree(t, FEATURES)
        return total


def fit(labelled: DataFrame, trees: int = 6, depth: int = 3, rate: float = 0.5, ridge: float = 1.0) -> Boosted | None:
    """Boosting with the log-loss on (features, y) of all labelled rows."""
    spark = labelled.sparkSession
    ws = Workspace(spark, "urls")
    rows = lexical(labelled)
    counts = ws.save(rows.groupBy(*RATED, _fold().alias("fold")).agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "sections")
    n, pos = counts.agg(F.sum("n"), F.sum("pos")).first()
    if not n:
        return None
    stats = (counts, (pos + 0.5) / (n + 1))
    rows = _with_rates(rows, stats, folds=True)
    cuts = rows.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 2000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    binned = {f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES}
    # Equal binned vectors are one row with counts.
    table = ws.save(rows.select(*binned.values(), "y").groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "binned")
    base, grown = math.log((pos + 0.5) / (n - pos + 0.5)), []

    def leaves(node, f) -> F.Column:
        """A grown tree on binned columns; f maps a leaf."""
        if not isinstance(node, list):
            return f(node)
        return F.when(F.col(node[0]) <= node[1], leaves(node[2], f)).otherwise(leaves(node[3], f))

    for _ in range(trees):
        margin = F.lit(base)
        for t in grown:
            margin = margin + leaves(t, lambda leaf: F.lit(leaf[1]))
        p = 1 / (1 + F.exp(-margin))
        root: list | tuple = (0, 0.0)
        for level in range(depth):
            node = leaves(root, lambda leaf: F.lit(leaf[0]))
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("int").alias("b")) for i, f in enumerate(FEATURES)])).alias("c")
            hist = table.select(node.alias("node"), (p * F.col("n") - F.col("pos")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"), cells).groupBy("node", "c.f", "c.b").agg(F.sum("g"), F.sum("h")).collect()
            split = {}
            for leaf in {r[0] for r in hist}:
                split[leaf] = _best([r[1:] for r in hist if r[0] == leaf], ridge)

            def replace(t, level=level, split=split):
                if isinstance(t, list):
                    return [t[0], t[1], replace(t[2]), replace(t[3])]
                gain, f, b, gl, hl, g, h = split.get(t[0], (0, 0, 0, 0, 0, 0, 0))
                value = lambda g, h: -rate * g / (h + ridge)
                if gain <= 1e-6:
                    return (t[0], value(g, h) if level == 0 else t[1])
                return [FEATURES[f], b, (2 * t[0] + 1, value(gl, hl)), (2 * t[0] + 2, value(g - gl, h - hl))]

            root = replace(root)
        grown.append(root)
    ws.drop("binned")

    def unbinned(t):
        return t[1] if not isinstance(t, list) else (t[0], cuts[t[0]][t[1]], unbinned(t[2]), unbinned(t[3]))

    return Boosted(base, [unbinned(t) for t in grown], stats)


def _best(rows, ridge: float):
    """(gain, feature, bin, left g, left h, g, h) of the best split of a node's histogram; ties to the first feature and bin."""
    of: dict[int, list] = {}
    for f, b, g, h in sorted(rows):
        of.setdefault(f, []).append((b, g, h))
    first = next(iter(of.values()))
    total_g, total_h = math.fsum(x[1] for x in first), math.fsum(x[2] for x in first)
    best = (0.0, 0, 0, 0.0, 0.0, total_g, total_h)
    for f in sorted(of):
        gl = hl = 0.0
        for b, g, h in of[f][:-1]:
            gl, hl = gl + g, hl + h
            gain = gl * gl / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, f, b, gl, hl, total_g, total_h)
    return best


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row; labelled: (page_id, url, host, path, y), y 1 to block."""
    rows = ruled(parsed(pages), rules)
    if labelled is None:
        labelled = rows.where("rule is not null").select("page_id", "url", "host", "path", (F.col("verdict") == "block").cast("int").alias("y"))
    model = fit(labelled)
    if model is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("block_score"))
    scored = _with_rates(lexical(rows), model.stats).withColumn("block_score", 1 / (1 + F.exp(-model.margin())))
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "block_score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
