"""Stories: articles of different publishers about one event, who gets the credit, and which story takes which daily slot.

An extension: a plan of the curated feeds, beyond what they do today.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwire.operators.components import components
from sparkwire.operators.scan import pinned

#: Words that say nothing about an event.
COMMON_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "has", "have", "he", "her", "his", "how", "in", "into", "is", "it", "its", "more", "new", "no", "not", "of", "on", "or",
    "our", "over", "says", "she", "so", "than", "that", "the", "their", "they", "this", "to", "was", "we", "were", "what", "when", "why", "will", "with", "you", "your",
)
SAME_HOURS, ALIKE, ALIKE_WITH_ENTITY = 72, 60, 35  # percent of the words
COVERED_DAYS, SLOTS, SLOT_HOURS = 7, (9, 14, 20), 24
EXCLUDED = ("opinion", "review", "deal", "sponsored")


def title_words(title: Column) -> Column:
    """The different words of a title, lower-cased, sorted, without common ones."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, COMMON_WORDS))))


def _alike(percent: Column, x: Column, y: Column) -> Column:
    common = F.size(F.array_intersect(x, y))
    return 100 * common >= percent * (F.size(x) + F.size(y) - common)


def _signature(keys: Column) -> list[Column]:
    """128 bits, one set for each word: a bit that only one of two sets has is a word that the other one lacks."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    half = lambda want: F.aggregate(F.filter(keys, lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(1) == want), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(bit(k)))
    return [half(0).alias("s0"), half(1).alias("s1")]


def _prefixes(cells: DataFrame, percent: int) -> DataFrame:
    """The rarest words of each cell: two sets that are alike share one of them."""
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    return cells.select("cell", "span", "n", "s0", "s1", "first", "last", F.explode(F.slice("ranked", F.lit(1), length)).alias("key"))


_END = ("cell", "n", "s0", "s1", "first", "last", "earlier", "root")


def _both_spans(keyed: DataFrame) -> DataFrame:
    """Each row where it meets others: in its own span, and as the earlier one in the next."""
    there = F.explode(F.array(F.struct(F.col("span").alias("near"), F.lit(False).alias("earlier")), F.struct((F.col("span") + 1).alias("near"), F.lit(True).alias("earlier")))).alias("x")
    return keyed.select(*[c for c in keyed.columns if c != "span"], there).select(*[c for c in keyed.columns if c != "span"], "x.*")


def _may(a: str, b: str, percent: int, width: int) -> Column:
    """Whether times allow two ends of a pair, and sizes and signatures do not rule the likeness out."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    lacking = lambda p, q: F.bit_count(p("s0").bitwiseAND(F.bitwise_not(q("s0")))) + F.bit_count(p("s1").bitwiseAND(F.bitwise_not(q("s1"))))
    common = F.least(x("n") - lacking(x, y), y("n") - lacking(y, x))  # at most
    gap = F.when(x("earlier") == y("earlier"), 0).when(x("earlier"), y("first") - x("last")).otherwise(x("first") - y("last"))
    return (x("cell") != y("cell")) & (gap <= width) & ((100 + percent) * common >= percent * (x("n") + y("n")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.cell", "y.cell").alias("a"), F.greatest("x.cell", "y.cell").alias("b")).distinct()


def _with_least(keyed: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs of each key's cells with the least of them: as many as there are rows, however large a group is."""
    rows = _both_spans(keyed).select("near", "key", F.struct(*_END).alias("x"))
    least = rows.groupBy("near", "key").agg(F.min("x").alias("y"))
    return _pairs(rows.join(least, ["near", "key"]).where(_may("x", "y", percent, width)))


def _with_all(keyed: DataFrame, percent: int, width: int) -> DataFrame:
    """All pairs of each key's cells that are not in one component yet."""
    ends = lambda df, name: df.select("near", "key", F.struct(*_END).alias(name))
    left = ends(keyed.withColumn("earlier", F.lit(False)).withColumnRenamed("span", "near"), "x")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("y.earlier") | (F.col("x.cell") < F.col("y.cell")))
    return _pairs(left.join(ends(_both_spans(keyed), "y"), ["near", "key"]).where(apart & _may("x", "y", percent, width)))


def clusters(articles: DataFrame, hours: int = SAME_HOURS, alike: int = ALIKE, with_entity: int = ALIKE_WITH_ENTITY, pin: Callable[[DataFrame], DataFrame] = pinned) -> DataFrame:
    """(id, cluster_id) of ``articles`` (id, title, at, event_type, entities): the least id of each one's story.

    Two articles tell one story if they are at most ``hours`` apart and their titles' words overlap (Jaccard) by ``alike`` percent, or by ``with_entity`` percent where they
    share an entity and the event type; stories are the closure. A title without words, or an article without a time, is a story of its own.

    Articles of equal words within one span of ``hours`` are one cell, so a headline that everybody carries is one row. Cells meet by their rarest words (prefix
    filter), or by an entity and a type that they have in times near enough; sizes and 128-bit signatures of the words rule most pairs out, and the rest are
    compared on all words. First each cell meets the least one of its group; then all pairs meet that this has not brought into one story yet. So a large group of near
    copies costs what its size is, and no link between stories is lost.
    """
    width = hours * 3600 * 1_000_000
    rows = articles.withColumns({"_words": title_words(F.col("title")), "_at": F.unix_micros(F.col("at").cast("timestamp"))})
    rows = rows.where((F.size("_words") > 0) & F.col("_at").isNotNull())
    named = pin(rows.select("id", F.col("_words").alias("words"), "event_type", "entities", F.col("_at").alias("t"), F.floor(F.col("_at") / width).alias("span")))
    cells = pin(named.groupBy("words", "span").agg(F.min("id").alias("cell"), F.min("t").alias("first"), F.max("t").alias("last")).withColumn("n", F.size("words")))
    member = pin(named.join(cells.select("words", "span", "cell"), ["words", "span"]).select("id", "cell", "t", "event_type", "entities"))
    # words are told by a hash where cells meet; what two cells have in common is counted on the words themselves
    keyed = cells.withColumn("keys", F.transform("words", lambda w: F.xxhash64(w)))
    each = keyed.select("cell", F.explode("keys").alias("key"))
    rarity = each.groupBy("key").agg(F.count("*").alias("held"))
    ranked = each.join(rarity, "key").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("held", "key")))["key"].alias("ranked"))
    ranked = pin(keyed.select("cell", "span", "n", "first", "last", *_signature(F.col("keys"))).join(ranked, "cell"))
    by_word = _prefixes(ranked, alike)
    told = member.where(F.col("event_type").isNotNull()).select("cell", "t", "event_type", F.explode(F.array_distinct("entities")).alias("e")).where(F.col("e").isNotNull())
    told = told.groupBy("cell", "event_type", "e").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    by_entity = told.join(ranked.select("cell", "span", "n", "s0", "s1"), "cell").select("cell", "span", "n", "s0", "s1", "first", "last", F.xxhash64("event_type", "e").alias("key"))

    words = cells.select("cell", "words")

    def links(meet: Callable, *keyed: DataFrame) -> DataFrame:
        pairs = meet(keyed[0], alike, width).withColumn("percent", F.lit(alike)).unionByName(meet(keyed[1], with_entity, width).withColumn("percent", F.lit(with_entity)))
        pairs = pairs.groupBy("a", "b").agg(F.min("percent").alias("percent"))
        both = pairs.join(words.select(F.col("cell").alias("a"), F.col("words").alias("x")), "a").join(words.select(F.col("cell").alias("b"), F.col("words").alias("y")), "b")
        return pin(both.where(_alike(F.col("percent"), F.col("x"), F.col("y"))).select("a", "b"))

    none = F.lit(None).cast(cells.schema["cell"].dataType)
    near = links(_with_least, *[k.withColumn("root", none) for k in (by_word, by_entity)])
    roots = components(near, pin).select(F.col("node").alias("cell"), "root")
    rooted = [k.join(roots, "cell", "left").withColumn("root", F.coalesce("root", "cell")) for k in (by_word, by_entity)]
    found = components(near.unionByName(links(_with_all, *rooted)), pin)
    placed = member.join(found, F.col("cell") == F.col("node"), "left").select(F.col("id").alias("_id"), F.coalesce("root", "cell").alias("_cluster"))
    out = articles.select("id").join(placed, F.col("id") == F.col("_id"), "left")
    return out.select("id", F.coalesce("_cluster", "id").alias("cluster_id"))


def credited(articles: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row for each cluster of ``clustered`` (id, cluster_id): the article that gets the credit, by tier, then time, then the longer summary, then id; ``publishers`` and
    ``n_articles``. Whole articles are joined to the ids that were chosen, so texts do not take part in the choice."""
    small = articles.select("id", "tier", "at", "publisher", F.length(F.coalesce("summary", F.lit(""))).alias("_chars"))
    first = F.struct("tier", F.col("at").isNull().alias("undated"), "at", (-F.col("_chars")).alias("length"), "id")
    each = small.join(clustered, "id").groupBy("cluster_id").agg(F.min(first)["id"].alias("_id"), F.countDistinct("publisher").alias("publishers"), F.count("*").alias("n_articles"))
    return each.join(articles, F.col("_id") == F.col("id")).drop("_id")


def already_covered(stories: DataFrame, published: DataFrame, days: int = COVERED_DAYS) -> DataFrame:
    """``stories`` whose cluster was published (cluster_id, published_at) in the ``days`` before, and that are no follow-up."""
    width = days * 86400
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    week = F.floor(seconds("published_at") / width)
    out = published.select(F.col("cluster_id").alias("_c"), seconds("published_at").alias("_p"), F.explode(F.array(week, week + 1)).alias("_w"))
    near = (F.col("cluster_id") == F.col("_c")) & (F.floor(seconds("at") / width) == F.col("_w")) & (F.col("_p") <= seconds("at")) & (seconds("at") - F.col("_p") <= width)
    return stories.where(~F.coalesce("follow_up", F.lit(False))).join(out, near, "left_semi")


def base_score(slot: Column) -> Column:
    """The facts' points at a slot, without the one that depends on the day's earlier posts."""
    age = F.unix_seconds(slot) - F.unix_seconds(F.col("at").cast("timestamp"))
    fresh = F.when(age < 6 * 3600, 3).when(age < 12 * 3600, 2).otherwise(1)
    covered = F.when(F.col("publishers") >= 3, 2).when(F.col("publishers") == 2, 1).otherwise(0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    points = lambda c, n: F.when(yes(c), n).otherwise(0)
    big = yes(F.col("event_type") == "acquisition") | (yes(F.col("event_type") == "launch") & yes(F.col("is_major")))
    funding = F.when(yes(F.col("amount_musd") >= 100), 2).when(yes(F.col("amount_musd") >= 20), 1).otherwise(0)
    security = yes(F.col("event_type") == "security") & yes(F.col("is_exploited"))
    return fresh + covered + points(F.col("tier") <= 2, 1) + points(F.col("is_major"), 1) + points(big, 2) + points(security, 3) + F.when(F.col("event_type") == "funding", funding).otherwise(0)


def _posted(rows: pa.Table) -> pa.Table:
    """The best story of each slot in turn, of the few that can be."""
    out, used, day, today = [], set(), None, []
    there = sorted(rows.select(["slot", "id", "cluster_id", "category", "at", "base"]).to_pylist(), key=lambda r: r["slot"])
    for slot, group in groupby(there, key=lambda r: r["slot"]):
        if slot.date() != day:
            day, today = slot.date(), []
        left = [r | {"score": r["base"] - 2 * (r["category"] in today)} for r in group if r["id"] not in used]
        if left:
            best = max(left, key=lambda r: (r["score"], r["at"], -r["id"]))
            used.add(best["id"])
            today.append(best["category"])
            out.append(best)
    kinds = {"slot": rows.schema.field("slot").type, "id": pa.int64(), "cluster_id": pa.int64(), "category": pa.string(), "score": pa.int32()}
    return pa.table({k: pa.array([r[k] for r in out], kind) for k, kind in kinds.items()})


def slots(stories: DataFrame, hours: tuple[int, ...] = SLOTS) -> DataFrame:
    """(slot, id, cluster_id, category, score): the story of each daily slot, the best of the last 24 hours that was not used, ties to the newest, then the least id.

    A story counts two points less where its category was posted that day. Opinion, reviews, deals and sponsored content stay out, and so does a story without time or category.

    Of the stories of one category only the best few can be chosen in a slot, as those used before in its 24 hours are at most as many as there are slots a day. So each
    (slot, category) is cut to that many and one by a ranked top-k, and the slots are then decided in turn over a table that grows with the calendar alone.
    """
    at = F.col("at").cast("timestamp")
    day = F.date_trunc("day", at)
    due = F.explode(F.flatten(F.array(*[F.array(*[F.timestamp_seconds(F.unix_seconds(day) + 86400 * d + 3600 * h) for h in hours]) for d in (0, 1)])))
    rows = stories.where(F.col("category").isNotNull() & ~F.coalesce(F.col("event_type").isin(*EXCLUDED), F.lit(False))).withColumn("slot", due)
    age = F.unix_seconds("slot") - F.unix_seconds(at)
    rows = rows.where((age >= 0) & (age < SLOT_HOURS * 3600)).select("slot", "id", "cluster_id", "category", at.alias("at"), base_score(F.col("slot")).alias("base"))
    best = Window.partitionBy("slot", "category").orderBy(F.col("base").desc(), F.col("at").desc(), "id")
    rows = rows.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= len(hours) + 1).drop("_rank")
    return rows.groupBy(F.lit(0).alias("_all")).applyInArrow(_posted, "slot timestamp, id long, cluster_id long, category string, score int")
