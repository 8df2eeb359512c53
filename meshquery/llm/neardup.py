"""Operator 3, near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its five-word shingles (hashed to 64 bits). Its sketch is the ``K`` smallest hashes. Two
documents of Jaccard similarity J share, among the K smallest of their union, about J * K values, and all of those are
in both sketches; at the threshold (``percent``, in hundredths) fewer than ``least(percent)`` of 64 happens less than
once in 10^4 pairs. So a linked pair shares that many sketch values, and one of them is among the K - least + 1 rarest
of either sketch: only those are put in the inverted lists. Common lines and passages are frequent values and stay out
of the lists.

1. Equal sets become one class (a map-side combined group-by), however many copies there are.
2. Inverted lists over classes. Classes alone in their lists are done; of the others the full sets are kept.
3. Over the full sets the lists are made again, now exactly: a linked pair shares one of the rarest 15 % (at 85) of either set,
   and the places of its first common value leave enough of both sets for the intersection that a link needs. Variants
   of one text differ in their rare shingles: these bounds keep them from being compared all with all.
4. A list never emits all its pairs: its most central member (fewest shingles of its own) is compared with the others;
   members that turn out to be in one component need no more comparing with each other. Lists whose members are in
   several components go to another round with the next leaders, until every pair in a list was compared, is in one
   component, or is excluded exactly by its sizes or by 3. Nothing is capped. A long list is never in one task: counts
   and leaders are combined before the shuffle, and everything else is a join of two saved tables, which Spark splits.
5. A pair whose sketches share ``least`` values and whose union-sketch estimate is near enough is decided by the exact
   Jaccard similarity of the full sets.
6. Components over verified links; label = smallest doc_id.

Defined results: A-Z lower-cased; texts with fewer than five words are one shingle; null, empty and blank texts have
n_shingles 0 and stand alone; repeated rows are copies of each other; null doc_id takes part, and a component's id is
its smallest non-null doc_id (null if it has none); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free_name, saved, table
from .components import components
from .tokens import slices
from .words import Words

#: PERCENT is the contract of op3 alone; other callers name their own threshold.
K, PERCENT = 64, 85
#: How seldom a pair at the threshold may share fewer sketch values than ``least``.
SELDOM = 1e-5
#: Leaders of a list in one round: so many are found without bringing the list together.
MOST_LEADS = 512
TOP = np.uint64(1 << 63)


def least(percent: int) -> int:
    """Of K union-sketch values, each shared with the threshold's probability, fewer than this are shared less often than SELDOM."""
    p, below, found = percent / 100, 0.0, 0
    while found < K and (below := below + math.comb(K, found) * p**found * (1 - p) ** (K - found)) < SELDOM:
        found += 1
    return found


def margin(percent: int) -> int:
    """The estimate may fall this far (in hundredths) below the threshold: over four standard deviations."""
    return math.ceil(4.4 * math.sqrt(percent * (100 - percent) / K))


def _signed(x: np.ndarray) -> np.ndarray:
    """The same order as unsigned, in Spark's long."""
    return (x ^ TOP).view(np.int64)


def _tag(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tag, n, f1, f2, sketch): f1, f2 fingerprint the whole set; row is unique."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows=500, chars=500_000):
                sets = Words(part.column(3)).shingle_sets()
                prints = np.array([_print(s) for s in sets], dtype=np.int64).reshape(len(sets), 2)
                firsts = [_signed(s[:K]) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in firsts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], names=["row", "doc_id", "tag", "n", "f1", "f2", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _tag(F.col("text")).alias("tag"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, tag long, n long, f1 long, f2 long, sketch array<long>")


def _counted(spread: DataFrame, name: str) -> DataFrame:
    """(value, times) of the values that several classes have, saved: a join with it can be split where a value is frequent."""
    return saved(spread.groupBy("value").agg(F.count("*").alias("times")).where("times > 1"), name)


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, cls, n): the values of each class's sketch that may lead to a link, rarest first."""
    spread = classes.select("cls", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    need = F.least(F.ceil(F.col("n") * percent / 100), F.lit(least(percent)))
    # Values of one class only are the rarest: they come first and lead nowhere.
    own = spread.join(_counted(spread, "values"), "value").groupBy("cls", "n", "size").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("values"))
    keep = F.greatest(F.lit(0), F.col("size") - need + 1 - (F.col("size") - F.size("values")))
    return own.select("cls", "n", F.explode(F.slice("values", F.lit(1), keep.cast("int"))).alias("v")).select(F.col("v.value").alias("value"), "cls", "n")


def full_sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """(cls, n, shingles): the full sets of the wanted classes, made again from the whole texts, found by doc_id and hash."""
    key = lambda c: F.struct(F.coalesce(c, F.lit(0)).alias("i"), c.isNull().alias("none"))
    texts = docs.select(key(F.col("doc_id").cast("long")).alias("id"), _tag(F.col("text")).alias("tag"), F.col("text").cast("string").alias("text")).where("text is not null")
    named = classes.join(wanted, "cls", "left_semi").select("cls", "f1", "f2", key(F.col("owner")).alias("id"), "tag")

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows=500, chars=500_000):
                sets = Words(part.column(3)).shingle_sets()
                # Should two texts of a doc_id have one hash: the class's own has its fingerprint.
                keep = [i for i, (x, f1, f2) in enumerate(zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)) if _print(x) == (f1, f2)]
                own = [_signed(sets[i]) for i in keep]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(np.diff(ends).astype(np.int64)), lists], names=["cls", "n", "shingles"])

    found = texts.join(named, ["id", "tag"]).select("cls", "f1", "f2", "text").mapInArrow(run, "cls long, n long, shingles array<long>")
    return found.dropDuplicates(["cls"]) if repeats else found


def exact_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(value, cls, n, u, place): inverted lists over the full sets. A linked pair shares one of the first n - percent / 100 n
    + 1 shingles of either set, rarest first; place counts a set's shingles before the value in that order, u those that no
    other class of ``sets`` has. 31 bits of a hash do: a chance match makes a shingle look more frequent, which excludes
    less, or puts a pair up that is then compared."""
    spread = sets.select("cls", "n", F.explode("shingles").alias("x")).select(F.shiftright("x", 20).bitwiseAND(0x7FFFFFFF).cast("int").alias("value"), "cls", "n")
    own = spread.join(_counted(spread, "values-exact"), "value").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("values"))
    own = own.withColumn("u", F.col("n") - F.size("values"))
    keep = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("u"))
    first = own.select("cls", "n", "u", F.posexplode(F.slice("values", F.lit(1), keep.cast("int"))).alias("at", "v"))
    return first.select("v.value", "cls", "n", "u", (F.col("u") + F.col("at")).alias("place"))


def _possible(an: str, bn: str, aplace: str, bplace: str, percent: int) -> Column:
    """Whether two sets can be linked if a value at these places is their first in common: the intersection is at most what
    is left of either set, and a link needs percent / (100 + percent) of both sizes together. True of every linked pair at its first
    common value, so nothing is lost by asking it at all common values."""
    sizes = F.least(an, bn) * 100 >= F.greatest(an, bn) * percent
    left = F.least(F.col(an) - F.col(aplace), F.col(bn) - F.col(bplace))
    return sizes & (left * (100 + percent) >= (F.col(an) + F.col(bn)) * percent)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the union sketch doesn't exclude."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"))
    union = F.slice(F.array_sort(F.array_union("as", "bs")), 1, K)
    seen = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.array_intersect("as", "bs"))
    shared = F.size("both") >= F.least(F.lit(least(percent)), F.ceil(F.greatest("an", "bn") * percent / 100))
    estimate = F.size(F.array_intersect(union, "both")) * 100 / F.size(union)
    return seen.where(shared & (estimate >= percent - margin(percent))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have Jaccard similarity percent / 100 or more."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"{x}s"))
    both = F.size(F.array_intersect("as", "bs"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return met.where(F.col("both") * 100 >= (F.size("as") + F.size("bs") - F.col("both")) * percent).select("a", "b")


def _print(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit fingerprint as two longs."""
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype="<i8").tolist())


def linked(classes: DataFrame, docs: DataFrame, percent: int, repeats: bool) -> DataFrame:
    """(node, label) of the classes that have a verified link: label is the smallest class reachable. What a round finds joins the labels
    so far, which are stars, never all links again."""
    lists = saved(inverted_lists(classes, percent), "lists")
    lists = saved(lists.join(_counted(lists, "lists-crowded"), "value", "left_semi"), "lists-shared")
    sets = saved(full_sets(classes, lists.select("cls").distinct(), docs, repeats), "sets")
    lists = saved(exact_lists(sets, percent), "lists-exact")
    heads = saved(lists.groupBy("value").agg(F.min(F.struct("u", "cls", "n", "place")).alias("head")), "heads").select("value", F.col("head.cls").alias("a"), F.col("head.n").alias("an"), F.col("head.place").alias("aplace"))
    star = lists.join(heads, "value").where(F.col("a") != F.col("cls")).where(_possible("an", "n", "aplace", "place", percent)).select("a", F.col("cls").alias("b")).distinct()
    labels = components(saved(verified(estimated(star, classes, percent), sets, percent), "links"))
    led, more = 1, 16
    used = saved(lists.groupBy("value").agg(F.min(F.struct("u", "cls")).alias("last")), "leads-used")
    while True:
        named = saved(lists.join(labels, F.col("cls") == F.col("node"), "left").select("value", "cls", "n", "u", "place", F.coalesce("label", "cls").alias("label")), "lists-named")
        split = named.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
        split = saved(split.where((F.col("low") != F.col("high")) & (F.col("members") > led + 1)).select("value"), "values-open")
        lists = saved(named.join(split, "value", "left_semi"), "lists-open")
        if lists.isEmpty():
            return labels
        place_in_list = F.struct("u", "cls")
        next_ones = lists.join(used, "value").where(place_in_list > F.col("last"))
        numbered = next_ones.withColumn("at", F.row_number().over(W.partitionBy("value").orderBy("u", "cls"))).where(F.col("at") <= more)
        lead = saved(numbered.select("value", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("place").alias("aplace"), F.col("label").alias("alabel"), place_in_list.alias("aat")), "leads")
        used = saved(lead.groupBy("value").agg(F.max("aat").alias("last")), "leads-used")
        pairs = lead.join(lists, "value").where(place_in_list > F.col("aat")).where(F.col("label") != F.col("alabel")).where(_possible("an", "n", "aplace", "place", percent))
        found = saved(verified(estimated(pairs.select("a", F.col("cls").alias("b")).distinct(), classes, percent), sets, percent), "links")
        if not found.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found))
        lists = lists.drop("label")
        led, more = led + more, min(more * 4, MOST_LEADS)


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, tag, n, label, component_id) for every row; tag tells texts of one doc_id apart; label is null without words."""
    rows = saved(sketches(docs), "sketches")
    full = rows.where("n > 0")
    first = F.min(F.struct("row", "doc_id", "tag")).alias("first")
    classes = full.groupBy("f1", "f2").agg(first, F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = saved(classes.select(F.col("first.row").alias("cls"), F.col("first.doc_id").alias("owner"), F.col("first.tag").alias("tag"), "f1", "f2", "doc", "n", "sketch"), "classes")
    repeats = not full.groupBy("doc_id", "tag").count().where("count > 1").isEmpty()
    labels = linked(classes, docs, percent, repeats)
    member = classes.join(labels, F.col("cls") == F.col("node"), "left").select("f1", "f2", "doc", F.coalesce("label", "cls").alias("label"))
    names = member.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = member.join(names, "label").select("f1", "f2", "label", "component_id")
    own = full.select("doc_id", "tag", "n", "f1", "f2").join(named, ["f1", "f2"]).select("doc_id", "tag", "n", "label", "component_id")
    alone = rows.where("n = 0").select("doc_id", "tag", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return own.unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = labelled(docs, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component (smallest doc_id, null last); rows without words all stay. Same columns."""
    rows = saved(labelled(docs, percent), "components")
    worded = rows.where("n > 0")
    own_id, own_tag = free_name("id"), free_name("tag")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    keep = worded.groupBy("label").agg(first).select(F.col("first.doc_id").alias(own_id), F.col("first.tag").alias(own_tag))
    keep = keep.unionByName(rows.where("n = 0").select(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag))).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & _tag(docs["text"]).eqNullSafe(F.col(own_tag))
    kept = docs.join(keep, match, "left_semi")
    if worded.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        return kept
    # Rows that are repeated exactly: one stays.
    wordless = F.coalesce(F.regexp_count(kept["text"].cast("string"), F.lit(WORD)), F.lit(0)) == 0
    return kept.where(~wordless).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(wordless))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
