"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets the key -ln(u) / weight, where u is a digest of its id, its text and the seed; the
documents of a source in ascending order of the key are a weighted sample without
replacement for every prefix. A source's target is its share of all words; a source takes
``floor(target / size)`` complete epochs of all its documents first, and fills the rest with
the prefix of its order whose words come nearest to it.

The order is summed up in two steps, so that a source with a third of all rows does not meet
in one task: the key's distribution function cuts each source into buckets, which are
summed first; then the one bucket in which the rest ends is ordered by itself. Rows that are equal in id, text and size
are one entry of that order with their number; where the rest ends among them, as many as are wanted are counted off.

Cases: null text has size 0; a null source is a source of its own, after all others; a null or
non-positive weight counts as 1; documents of size 0 take 0; ties of the key are broken by id,
size and text; an id that repeats is a document each time, and of equal rows any may be taken; an
empty table gives an empty one; columns of ``docs`` may have any names and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch

#: Code points of white space between words.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest that any SQL engine has."""
    digest = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row per source from its total size: its target, at most ``most`` times its size.

    The excess of a source over its limit goes to the others by weight until none is above. Sources
    reach their limits in ascending order of limit / weight, so the level at which the
    words are used up follows from running sums over that order; a source gets the
    lesser of its limit and weight times level. ``sizes`` has a row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * float(most))
    up = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level if this source and all after it stay below their limits
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest_w"))
    s = s.withColumn("free", F.col("level") * F.col("w") <= F.col("limit"))
    s = s.withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("w"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("w")))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def text_weight(text: Column) -> Column:
    """A quality weight in (0, 1]: less the more mark-up and list symbols a text has for its words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(1.0 / (1.0 + 4.0 * symbols / F.greatest(n_words(text), F.lit(1))), F.lit(1.0))


#: What the order of a source is by.
_KEY = ("e", "id", "size", "h")


def sampled(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> DataFrame:
    """Two structs: row, all columns of docs, and m(source, id, size, e, h)."""
    text, ident = F.col(text_col), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    w = text_weight(text) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(1.0)
    e = -F.log(uniform(F.concat(ident, F.lit(":"), digest), seed)) / w
    m = F.struct(
        F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), n_words(text).alias("size"), e.alias("e"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"),
    )
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), m.alias("m"))


def _bucket(e: Column) -> Column:
    """Of 0 .. n_buckets - 1, ascending with the key and about evenly filled."""
    return F.least(F.floor((1 - F.exp(-e / F.col("p.mean_e"))) * F.col("p.n_buckets")), F.col("p.n_buckets") - 1)


def plan(sized: DataFrame, weights: tuple[int, ...], most: int, scratch: Scratch, rows_per_bucket: int, most_buckets: int) -> DataFrame:
    """A row per source, a struct p: source, source_size, target, epochs, where its rest ends (cut, cut_bucket), how many of the
    rows that are equal to the cut are in (cut_rows) and how many there are (equal_rows).

    ``sized`` has the columns source, id, size, e and h, and is read three times.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.avg("e").alias("mean_e"))
    per = scratch.table(per, "sources")
    targets = source_targets(per.select("source", "source_size"), weights, most)
    more = per.select(F.col("source").alias("p_source"), "rows", F.when(F.col("mean_e") > 0, F.col("mean_e")).otherwise(1.0).alias("mean_e"))
    per = targets.join(more, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("epochs", epochs.cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # few rows to a bucket, but never so many buckets that summing them up becomes the work
    per = per.withColumn("n_buckets", F.least(F.lit(most_buckets), F.ceil(F.col("rows") / rows_per_bucket)).cast("long"))
    per = scratch.table(per.select(F.struct(*per.columns).alias("p")), "targets")
    # A row per source: Spark broadcasts it while it is below its own limit, and shuffles otherwise.
    placed = sized.join(per, F.col("source").eqNullSafe(F.col("p.source"))).select(*sized.columns, _bucket(F.col("e")).alias("bucket"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("b_size").over(upto), F.lit(0))
    sums = scratch.table(sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "b_size", base.alias("base")), "buckets")
    # only the bucket in which the rest ends needs an order inside
    last = sums.join(per.select("p.source", "p.rest"), F.col("b_source").eqNullSafe(F.col("source"))).drop("source")
    last = last.where((F.col("base") < F.col("rest")) & (F.col("base") + F.col("b_size") >= F.col("rest"))).drop("b_size")
    inside = placed.join(last, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    inside = inside.groupBy("source", "bucket", "base", "rest", *_KEY).agg(F.count("*").alias("n"))
    inner = Window.partitionBy("source", "bucket").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0))
    # A document is in when its middle lies before the rest: the sum ends as near as whole documents allow.
    fits = F.floor((F.col("rest") - before) / F.greatest(F.col("size"), F.lit(1)) + 0.5)
    inside = inside.withColumn("in", F.when(F.col("size") == 0, F.when(before <= F.col("rest"), F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), fits))))
    end = F.max(F.when(F.col("in") > 0, F.struct(F.struct(*_KEY).alias("cut"), F.col("in").alias("cut_rows"), F.col("n").alias("equal_rows"))))
    cuts = inside.groupBy("source").agg(end.alias("end"), F.first("bucket").alias("cut_bucket"))
    cuts = cuts.select(F.col("source").alias("c_source"), "cut_bucket", "end.*")
    out = per.join(cuts, F.col("p.source").eqNullSafe(F.col("c_source")), "left")
    return scratch.table(out.select(F.struct("p.*", "cut_bucket", "cut", "cut_rows", "equal_rows").alias("p")), "plan")


def counted(rows: DataFrame, p: DataFrame, scratch: Scratch, deal: int = 64) -> DataFrame:
    """rows, which have m, with p and times: how often each is taken."""
    both = rows.join(p, F.col("m.source").eqNullSafe(F.col("p.source")))
    bucket, key = _bucket(F.col("m.e")), F.struct(*[F.col(f"m.{c}") for c in _KEY])
    at_cut = F.coalesce((bucket == F.col("p.cut_bucket")) & key.eqNullSafe(F.col("p.cut")), F.lit(False))
    before = (bucket < F.col("p.cut_bucket")) | ((bucket == F.col("p.cut_bucket")) & F.coalesce(key <= F.col("p.cut"), F.lit(False)))
    simple = both.withColumn("times", F.col("p.epochs") + F.coalesce(before, F.lit(False)).cast("int"))
    split = p.where("p.cut_rows < p.equal_rows").select("p.source").limit(1).count()
    if not split:
        return simple
    # of the equal rows at a cut only some are in: they are written, and their places there, dealt out, count them off
    tied = both.where(at_cut & (F.col("p.cut_rows") < F.col("p.equal_rows"))).drop("p").withColumn("place", F.monotonically_increasing_id())
    tied = scratch.table(tied, "tied").withColumn("deal", (F.col("place") % deal).cast("int"))
    sums = tied.groupBy(F.col("m.source").alias("t_source"), F.col("deal").alias("t_deal")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("t_source").orderBy("t_deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.table(sums.select("t_source", "t_deal", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")), "tied-before")
    nth = F.row_number().over(Window.partitionBy("m.source", "deal").orderBy("place"))
    ranked = tied.withColumn("nth", nth).join(sums, F.col("m.source").eqNullSafe(F.col("t_source")) & (F.col("deal") == F.col("t_deal")))
    ranked = ranked.join(p, F.col("m.source").eqNullSafe(F.col("p.source")))
    some = ranked.withColumn("times", F.col("p.epochs") + (F.col("base") + F.col("nth") <= F.col("p.cut_rows")).cast("int"))
    rest = simple.where(~(at_cut & (F.col("p.cut_rows") < F.col("p.equal_rows"))))
    return rest.unionByName(some.select(*rest.columns))


def mix(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 17,
    rows_per_bucket: int = 500,
    most_buckets: int = 1 << 16,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with row and m, m alone, and the plan of every source."""
    rows = sampled(docs, id_col, text_col, source_col, weight, seed)
    sized = scratch.table(rows.select("m.*"), "sized")
    return rows, sized.select(F.struct(*sized.columns).alias("m")), plan(sized, weights, most, scratch, rows_per_bucket, most_buckets)


def taken(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, epochs, taken (words, repeats counted)."""
    _, sized, p = mix(docs, scratch, **options)
    return counted(sized, p, scratch).select(
        F.col("m.id").alias("doc_id"), "m.source", "m.size", "p.source_size", "p.target", "p.epochs",
        (F.col("times") * F.col("m.size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken. The texts are not shuffled
    unless the sources are too many to broadcast, or many equal rows stand where a source's rest ends."""
    rows, _, p = mix(docs, scratch, **options)
    out = counted(rows, p, scratch).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
