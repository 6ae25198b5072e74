"""URL filter by a tree of path templates, in DataFrame operations only.

Explicit rules decide first. The urls they decide are the labelled examples from which the
other urls are judged: per host a tree of path templates is grown level by level. A level's
segments become a wildcard where they hold digits or where a node has too many different
children; literal siblings whose share of blocked examples is statistically the same are merged
into one branch. A template is rejected when its smoothed share of blocked examples is
high; the smoothing leans on the same path over all hosts, then on all examples.

Cases: a null url or one without ``://`` has an empty host and path, and is judged as a host of its
own; repeated urls are counted each time and judged alike; urls of any length are read whole; an
empty table gives an empty one; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class Tree:
    depth: int = 4  # levels that are told apart; what lies deeper is one wildcard
    many_children: int = 16  # so many different literals under a node are a variable ...
    child_share: float = 0.05  # ... if they are also this share of the node's pages
    prior_weight: float = 4.0
    merge_z: float = 1.64
    reject_at: float = 0.5


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: -len(r.rule))
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _smoothed(bad: Column, seen: Column, prior: Column, k: float) -> Column:
    return (bad + k * prior) / (seen + k)


def template_verdicts(urls: DataFrame, scratch: Scratch, tree: Tree = Tree()) -> DataFrame:
    """From (host, path, label), label 1 blocked, 0 allowed or null: (t_host, t_path, template, purity, rejected).

    All steps work on the different (host, path) pairs with their counts.
    """
    k = tree.prior_weight
    u = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("double").alias("bad"),
        F.count("label").cast("double").alias("seen"),
    )
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    u = u.withColumn("segs", F.slice(F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("#")).otherwise(s)), 1, tree.depth))
    u = u.withColumn("deep", F.size(segments) > tree.depth).withColumn("template", F.lit(""))
    u = scratch.table(u, "paths")
    overall = u.agg(((F.sum("bad") + 1.0) / (F.sum("seen") + 2.0)).alias("p")).first()["p"]
    overall = 0.5 if overall is None else float(overall)
    held = u
    for level in range(tree.depth):
        u = u.withColumn("seg", F.coalesce(F.get("segs", F.lit(level)), F.lit("")))
        nodes = u.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
        nodes = scratch.table(nodes, "nodes")
        shapes = nodes.groupBy("template", "seg").agg(F.sum("bad").alias("s_bad"), F.sum("seen").alias("s_seen"))
        shapes = scratch.table(
            shapes.select(F.col("template").alias("s_template"), F.col("seg").alias("s_seg"), _smoothed(F.col("s_bad"), F.col("s_seen"), F.lit(overall), k).alias("prior")),
            "shapes",
        )
        parents = nodes.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("pages"))
        parents = scratch.table(
            parents.where((F.col("children") >= tree.many_children) & (F.col("children") >= tree.child_share * F.col("pages"))).select(
                F.col("host").alias("v_host"), F.col("template").alias("v_template")
            ),
            "variable",
        )
        nodes = nodes.join(parents, (F.col("host") == F.col("v_host")) & (F.col("template") == F.col("v_template")), "left")
        nodes = nodes.join(shapes, (F.col("template") == F.col("s_template")) & (F.col("seg") == F.col("s_seg")))
        nodes = nodes.withColumn("p", _smoothed(F.col("bad"), F.col("seen"), F.col("prior"), k))
        fixed = nodes.where(F.col("v_host").isNull() | F.col("seg").isin("", "#")).select("host", "template", "seg", "p", "seen")
        # literal siblings by purity: a new branch begins where the step is larger than chance
        literal = ~F.col("seg").isin("", "#")
        by_p = Window.partitionBy("host", "template", literal).orderBy("p", "seg")
        last_p, last_n = F.lag("p").over(by_p), F.lag("seen").over(by_p) + k
        mid, n = (F.col("p") + last_p) / 2, F.col("seen") + k
        apart = F.col("p") - last_p > tree.merge_z * F.sqrt(mid * (1 - mid) * (1 / n + 1 / last_n))
        fixed = fixed.withColumn("new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
        fixed = fixed.withColumn("branch", F.sum("new").over(by_p.rowsBetween(Window.unboundedPreceding, 0)))
        same = Window.partitionBy("host", "template", literal, "branch")
        # a branch of several segments is called by its least one and their number, whatever their number is
        more = F.count("*").over(same) - 1
        name = F.when(literal & (more > 0), F.concat(F.min("seg").over(same), F.lit("|+"), more.cast("string"))).otherwise(F.col("seg"))
        fixed = fixed.select("host", "template", "seg", name.alias("token"))
        variable = nodes.where(F.col("v_host").isNotNull() & literal).select("host", "template", "seg", F.lit("*").alias("token"))
        tokens = fixed.unionByName(variable).select(
            F.col("host").alias("n_host"), F.col("template").alias("n_template"), F.col("seg").alias("n_seg"), "token"
        )
        tokens = scratch.table(tokens, "tokens")
        u = u.join(
            tokens,
            (F.col("host") == F.col("n_host")) & (F.col("template") == F.col("n_template")) & (F.col("seg") == F.col("n_seg")),
        ).drop("n_host", "n_template", "n_seg")
        if level == 0:
            u = u.join(
                shapes.where(F.col("s_template") == "").select(F.col("s_seg").alias("p_seg"), F.col("prior").alias("first_prior")),
                F.col("seg") == F.col("p_seg"),
            ).drop("p_seg")
        u = u.withColumn("template", F.when(F.col("seg") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "token")))
        u = scratch.table(u.drop("seg", "token"), "level")
        scratch.drop(held)
        held = u
    u = u.withColumn("template", F.when(F.col("deep"), F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    leaves = u.groupBy("host", "template").agg(
        F.sum("bad").alias("l_bad"), F.sum("seen").alias("l_seen"), (F.sum(F.col("first_prior") * F.col("n")) / F.sum("n")).alias("l_prior")
    )
    leaves = scratch.table(
        leaves.select(
            F.col("host").alias("l_host"), F.col("template").alias("l_template"),
            _smoothed(F.col("l_bad"), F.col("l_seen"), F.col("l_prior"), k).alias("purity"),
        ), "leaves",
    )
    out = u.join(leaves, (F.col("host") == F.col("l_host")) & (F.col("template") == F.col("l_template")))
    return out.select(
        F.col("host").alias("t_host"), F.col("path").alias("t_path"), "template", "purity", (F.col("purity") >= tree.reject_at).alias("rejected")
    )


def judge(pages: DataFrame, scratch: Scratch, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", tree: Tree = Tree()) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, template, purity."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hit = matched(rules, F.col("host"), F.col("path"))
    rows = scratch.table(rows.withColumn("hit", hit), "parsed")
    label = F.when(F.col("hit.verdict") == "block", 1).when(F.col("hit.verdict") == "allow", 0)
    verdicts = scratch.table(template_verdicts(rows.select("host", "path", label.alias("label")), scratch, tree), "verdicts")
    both = rows.join(verdicts, (F.col("host") == F.col("t_host")) & (F.col("path") == F.col("t_path")))
    return both.select(
        "page_id", "host", "path", "hit.rule",
        F.coalesce("hit.verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )
