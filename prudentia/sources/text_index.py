"""A stored index of captions that finds the best few without scoring all matches.

Equal captions are one class, with their number and their first ids, and are
scored once.  Every beginning of a caption's words (three letters and more) has its postings:
the classes with a word that begins so, and how much a match counts there (the
BM25 part without the beginning's rarity).  Postings lie in blocks of about
``BLOCK`` by that part, in ``LEVELS`` steps, so a histogram of a beginning's levels
tells where its blocks are and what they can give at most.

A search scores the captions of each fragment's rarest beginning first.  The
``most``-th best of these is a threshold: beginnings that can't reach it even
together are not opened at all, and of the others only the levels that can reach
it with the help of all the rest.  What is left is scored from the captions
themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudentia.functions.text import normalize_caption
from prudentia.operators.resolve import K1, B, prefixes

LEVELS, BLOCK = 64, 128
#: Postings of the rarest beginning that the threshold is taken from.
SEED = 512
#: Ids that a class has at hand; more are looked up.
FIRST = 16
#: Scores are compared after rounding to six places.
SLACK = 2e-6
_TOP = K1 + 1


def _part(tf: Column, size: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _edge(level: Column) -> Column:
    """More than any part of this level."""
    return (level + 1) * F.lit(_TOP / LEVELS)


@dataclass
class TextIndex:
    """Tables ``members`` (id, text) of all captions, ``captions`` (class, text, n,
    ids, size, terms) of different ones, ``beginnings`` (prefix, df, levels) and
    ``blocks`` (prefix, level, salt, postings); ``docs`` and ``mean`` of the build."""

    spark: SparkSession
    folder: str
    docs: int
    mean: float

    @staticmethod
    def build(rulings: DataFrame, folder: str) -> TextIndex:
        """Index the captions of ``rulings`` (id, caption).  Null captions and those
        without a word are not found by any search."""
        spark = rulings.sparkSession
        text = F.concat_ws(" ", F.filter(F.split(normalize_caption(F.col("caption")), " "), lambda w: w != ""))
        rulings.select("id", text.alias("text")).where("text <> ''").write.parquet(f"{folder}/members")
        members = spark.read.schema("id string, text string").parquet(f"{folder}/members")
        place = F.row_number().over(W.partitionBy("text").orderBy("id"))  # cut to FIRST before the shuffle
        first = members.withColumn("_place", place).where(F.col("_place") <= FIRST).groupBy("text").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        each = members.groupBy("text").agg(F.count("*").alias("n")).join(first, "text").withColumn("words", F.split("text", " "))
        count = lambda w, all_: F.struct(w.alias("term"), F.size(F.filter(all_, lambda x: x == w)).alias("tf"))
        terms = F.transform(F.array_distinct("words"), lambda w: count(w, F.col("words")))
        each.select(F.monotonically_increasing_id().alias("class"), "text", "n", "ids", F.size("words").alias("size"), terms.alias("terms")).write.parquet(f"{folder}/captions")
        captions = spark.read.parquet(f"{folder}/captions")
        docs, mean = captions.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("size") * F.col("n")) / F.sum("n")).first()
        index = TextIndex(spark, folder, docs, mean or 1.0)
        starts = F.array_distinct(F.flatten(F.transform("terms", lambda t: F.transform(F.sequence(F.lit(1), F.length(t["term"])), lambda n: F.substring(t["term"], F.lit(1), n)))))
        long_enough = F.filter(starts, lambda p: F.length(p) >= 3)
        tf = F.aggregate(F.filter("terms", lambda t: F.startswith(t["term"], F.col("prefix"))), F.lit(0), lambda s, t: s + t["tf"])
        posted = captions.select("class", "n", "size", "terms", F.explode(long_enough).alias("prefix")).select("prefix", "class", "n", _part(tf, F.col("size"), F.lit(index.mean)).alias("part"))
        posted = posted.withColumn("level", F.least(F.floor(F.col("part") * LEVELS / _TOP), F.lit(LEVELS - 1)).cast("int"))
        levels = posted.groupBy("prefix", "level").agg(F.count("*").alias("n"), F.sum("n").alias("of"))
        levels.write.parquet(f"{folder}/levels")
        levels = spark.read.parquet(f"{folder}/levels")
        salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("salt")
        blocks = posted.drop("n").join(levels, ["prefix", "level"]).select("prefix", "level", salt, "class", "part").groupBy("prefix", "level", "salt").agg(F.collect_list(F.struct("class", "part")).alias("postings"))  # about BLOCK of them
        blocks.repartitionByRange("prefix", "level", "salt").sortWithinPartitions("prefix", "level", "salt").write.parquet(f"{folder}/blocks")
        levels.groupBy("prefix").agg(F.sum("of").alias("df"), F.sort_array(F.collect_list(F.struct("level", "n")), asc=False).alias("levels")).write.parquet(f"{folder}/beginnings")  # LEVELS of them at most
        return index

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _weighed(self, asked: DataFrame, raw: str) -> DataFrame:
        """(f, prefix, df, levels, idf, most): the beginnings of each different
        fragment, and what each can add to a score at most."""
        fragments = asked.select(prefixes(F.col(raw)).alias("f")).where(F.size("f") > 0).distinct()
        wanted = fragments.select("f", F.explode("f").alias("prefix")).join(self._table("beginnings"), "prefix")
        idf = F.log(1 + (F.lit(float(self.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return wanted.select("f", "prefix", "df", "levels", idf.alias("idf")).withColumn("most", F.col("idf") * _edge(F.element_at("levels", 1)["level"]))

    def _opened(self, chosen: DataFrame) -> DataFrame:
        """(f, class, part): the postings of (f, prefix, idf, level, n)'s blocks."""
        each = chosen.select("f", "prefix", "idf", "level", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("salt"))
        found = each.join(self._table("blocks"), ["prefix", "level", "salt"]).select("f", "idf", F.explode("postings").alias("p"))
        return found.select("f", F.col("p.class").alias("class"), (F.col("idf") * F.col("p.part")).alias("part"))

    def _scored(self, candidates: DataFrame, weights: DataFrame) -> DataFrame:
        """(f, class, n, ids, score) of candidates (f, class) with all beginnings of
        theirs."""
        both = candidates.join(weights.select("f", "weights"), "f").join(self._table("captions"), "class")
        tf = lambda p: F.aggregate(F.filter("terms", lambda t: F.startswith(t["term"], p)), F.lit(0), lambda s, t: s + t["tf"])
        score = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["idf"] * _part(tf(w["prefix"]), F.col("size"), F.lit(self.mean)))
        return both.select("f", "class", "n", "ids", F.round(score, 6).alias("score"))

    def _plan(self, asked: DataFrame, raw: str, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(weights of each fragment, seeds' scores, what to open after them)."""
        weighed = self._weighed(asked, raw)
        weights = weighed.groupBy("f").agg(
            F.sort_array(F.collect_list(F.struct("most", "prefix", "idf", "df", "levels"))).alias("weights"),  # a beginning for each word of a fragment
            F.min_by(F.struct("prefix", "idf", "levels"), F.struct("df", "prefix")).alias("rarest"),
        )
        before = lambda ls, at: F.aggregate(F.slice(ls, F.lit(1), at), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        first = weights.select("f", "rarest.prefix", "rarest.idf", F.col("rarest.levels").alias("ls")).select("f", "prefix", "idf", "ls", F.posexplode("ls").alias("at", "l"))
        left = F.lit(SEED) - before(F.col("ls"), F.col("at"))
        seeds = first.where(left > 0).select("f", "prefix", "idf", "l.level", "l.n", left.alias("left"))
        # Of the level that passes the limit, only so many blocks.
        salts = F.least(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("left") / BLOCK)).cast("int")
        opened = seeds.select("f", "prefix", "idf", "level", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        drawn = opened.join(self._table("blocks"), ["prefix", "level", "salt"]).select("f", F.explode("postings.class").alias("class"))
        scores = self._scored(drawn, weights)
        upon = F.sum("n").over(W.partitionBy("f").orderBy(F.desc("score"), "class").rowsBetween(W.unboundedPreceding, 0))  # about SEED rows
        least = scores.withColumn("upon", upon).where(F.col("upon") >= most).groupBy("f").agg(F.max("score").alias("least"))
        bar = weights.join(least, "f", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
        total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["most"])
        upto = lambda at: F.aggregate(F.slice("weights", F.lit(1), at), F.lit(0.0), lambda s, w: s + w["most"])
        each = bar.select("f", "least", "weights", total.alias("total"), F.posexplode("weights").alias("at", "w")).where(upto(F.col("at") + 1) >= F.col("least"))
        level = each.select("f", "least", "w.prefix", "w.idf", F.explode("w.levels").alias("l"), (F.col("total") - F.col("w.most")).alias("others"))
        chosen = level.where(F.col("idf") * _edge(F.col("l.level")) + F.col("others") >= F.col("least")).select("f", "prefix", "idf", "l.level", "l.n", "least")
        return weights, bar, chosen

    def search(self, asked: DataFrame, raw: str, most: int = 5) -> DataFrame:
        """(query, place, id, score): for each row of ``asked`` the ``most`` captions
        of the greatest BM25 score, where a beginning counts as one term; ties by
        id.  Fragments without a word of three letters find nothing."""
        weights, bar, chosen = self._plan(asked, raw, most)
        partial = self._opened(chosen).groupBy("f", "class").agg(F.sum("part").alias("partial"))
        # What levels and beginnings that stayed closed might add to it.
        shut = self._shut(bar, chosen)
        able = partial.join(shut, "f").where(F.col("partial") + F.col("rest") >= F.col("least")).select("f", "class")
        scores = self._scored(able, weights)
        # what stands before a class's first id stands before all of its ids
        classes = scores.withColumn("place", F.row_number().over(W.partitionBy("f").orderBy(F.desc("score"), F.col("ids")[0], "class"))).where(F.col("place") <= most)
        if most <= FIRST:
            found = classes.select("f", "score", F.explode(F.slice("ids", 1, most)).alias("id"))
        else:
            found = classes.select("f", "class", "score").join(self._table("captions").select("class", "text"), "class").join(self._table("members"), "text").select("f", "score", "id")
        best = found.withColumn("place", F.row_number().over(W.partitionBy("f").orderBy(F.desc("score"), "id"))).where(F.col("place") <= most)
        return asked.select("query", prefixes(F.col(raw)).alias("f")).hint("merge").join(best, "f").select("query", "place", "id", "score")

    @staticmethod
    def _shut(bar: DataFrame, chosen: DataFrame) -> DataFrame:
        """(f, least, rest): the greatest sum of what isn't opened."""
        every = bar.select("f", "least", F.explode("weights").alias("w")).select("f", "least", "w.prefix", "w.idf", F.explode("w.levels").alias("l"))
        open_ = chosen.select("f", "prefix", "level", F.lit(True).alias("open"))
        both = every.withColumn("level", F.col("l.level")).join(open_, ["f", "prefix", "level"], "left")
        worst = both.groupBy("f", "least", "prefix").agg(F.max(F.when(F.col("open").isNull(), F.col("idf") * _edge(F.col("level"))).otherwise(0.0)).alias("worst"))
        return worst.groupBy("f", "least").agg(F.sum("worst").alias("rest"))

    def work(self, asked: DataFrame, raw: str, most: int = 5) -> tuple[int, int]:
        """(postings that a search opens after its seeds, postings that match)."""
        weights, _, chosen = self._plan(asked, raw, most)
        opened = chosen.agg(F.sum("n")).first()[0] or 0
        matched = weights.select(F.explode("weights.df").alias("df")).agg(F.sum("df")).first()[0] or 0
        return opened, matched
