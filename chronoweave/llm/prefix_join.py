"""Operator 2, n-gram Jaccard join: a grouped prefix join.

Sets of word shingles are ordered by how many sets hold a shingle, rarest first; two sets that are similar enough share a shingle
of their prefixes. Sets with the same prefix and size are one group; groups that share a prefix shingle are compared by size and
place of that shingle, and what passes is expanded to members and verified. A shingle that no other set holds can't be shared,
so it only moves the others back.

Only components are asked for, so links inside a component that is already known aren't looked for: each list of groups is
first compared with its most central member, and later rounds take only what is not yet in one component. In the last round
all remaining pairs of different components are verified, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import pin

from .common import LOWER, WordHashes, kept, shingle_hashes, word_hashes
from .components import components
from .shared_tokens import shared_tokens


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles, A-Z lower-cased; fewer words are one shingle, no words none."""
    return np.unique(shingle_hashes(word_hashes(text.translate(LOWER).split(), kept("words", WordHashes))))


def _alike(inter: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * inter >= percent * (n + m - inter)


def _prefix(n: Column, percent: int) -> Column:
    """How many first shingles must share one with any similar set: n - ceil(percent / 100 * n) + 1."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def _pairs_of(lists: DataFrame, leader: DataFrame, percent: int) -> DataFrame:
    """Leader and list members that may be alike by size and by the place of the shared shingle."""
    a, b = leader.alias("a"), lists.alias("b")
    size = (100 * F.col("a.n") >= percent * F.col("b.n")) & (100 * F.col("b.n") >= percent * F.col("a.n"))
    # All that can still be shared from the common shingle on, itself included.
    most = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.item") != F.col("b.item")) & size & _alike(most, F.col("a.n"), F.col("b.n"), percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that are alike."""
    own = sets.select("class", "n", "tokens")
    with_v = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(own.select(F.col("class").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv")), "v")
    both = with_v.join(own.select(F.col("class").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu")), "u")
    return both.where(_alike(F.size(F.array_intersect("tu", "tv")), F.col("nu"), F.col("nv"), percent)).select("u", "v")


def links(sets: DataFrame, percent: int = 75, rounds: int = 3) -> DataFrame:
    """(node, root) of all classes that are linked with another. `sets`: class, n, n_single, tokens."""
    p = F.greatest(_prefix(F.col("n"), percent) - F.col("n_single"), F.lit(0)).cast("int")
    held = pin(sets.withColumn("prefix", F.slice("tokens", F.lit(1), F.least(p, F.size("tokens")))).where(F.size("prefix") > 0))
    # A shingle of its own sets a class apart, so only classes without one can share a whole prefix.
    group = F.when(F.col("n_single") == 0, F.xxhash64("n", "prefix")).otherwise(F.col("class"))
    held = held.withColumn("group", group)
    members = pin(held.select("class", "group", "n", "n_single"))
    by_group = members.groupBy("group").agg(F.min(F.struct("n_single", "class")).alias("first"), F.count(F.lit(1)).alias("members"))
    groups = pin(by_group.select("group", F.col("first")["class"].alias("rep"), "members"))
    reps = held.join(groups.select(F.col("rep").alias("class")), "class", "left_semi")
    entries = reps.select("group", "class", "n", "n_single", F.posexplode("prefix").alias("at", "token"))
    entries = entries.select("token", F.col("group").alias("item"), "n", "n_single", (F.col("n_single") + F.col("at")).alias("place"))
    several = entries.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    entries = pin(entries.join(several, "token"))

    # Round 0: each list with its most central group (fewest shingles of its own), each group with its representative.
    central = Window.partitionBy("token").orderBy("n_single", "item")
    least = entries.groupBy("token").agg(F.min(F.struct("n_single", "item", "n", "place")).alias("x")).select("token", "x.*")
    pairs = pin(_pairs_of(entries, least, percent).select(F.col("a.item").alias("a"), F.col("b.item").alias("b")).distinct())
    more = members.join(groups.where("members > 1"), "group").select("group", "class", "rep").where("class != rep")
    rep = groups.select("group", "rep")
    ab = pairs.join(rep.select(F.col("group").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("group").alias("b"), F.col("rep").alias("rb")), "b")
    others = more.select(F.col("group"), F.col("class").alias("m"))
    first = (
        ab.select(F.col("ra").alias("u"), F.col("rb").alias("v"))
        .unionByName(ab.join(others, F.col("b") == others["group"]).select(F.col("ra").alias("u"), F.col("m").alias("v")))
        .unionByName(more.select(F.col("rep").alias("u"), F.col("class").alias("v")))
    )
    root = components(_verified(first, sets, percent))

    # Later rounds: lists by class, as far as their classes are in several components.
    entry = entries.select("token", "item", "place")
    grouped = members.select(F.col("class"), F.col("group").alias("item"), "n", "n_single")
    lists = entry.join(grouped, "item").select("token", F.col("class").alias("item"), "n", "n_single", "place")
    inside = members.join(groups.where("members > 1").select("group"), "group", "left_semi")
    lists = lists.unionByName(inside.select(F.col("group").alias("token"), F.col("class").alias("item"), "n", "n_single", F.lit(0).cast("long").alias("place")))
    for round_ in range(1, rounds + 1):
        lists = pin(_open(lists, root))
        if lists.isEmpty():
            return root
        if round_ < rounds:
            ranked = lists.withColumn("rank", F.row_number().over(central))
            leader = ranked.where(F.col("rank") == round_ + 1).drop("rank")
        else:  # whoever isn't in the list's largest component, with all members of other components
            leader = lists.where("root != main")
        pairs = _pairs_of(lists, leader, percent).where(F.col("a.root") != F.col("b.root")).select(F.col("a.item").alias("u"), F.col("b.item").alias("v"))
        known = root.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))  # stars already: few rounds more
        root = components(known.unionByName(_verified(pairs, sets, percent)))
    return root


def _open(lists: DataFrame, root: DataFrame) -> DataFrame:
    """The lists whose classes are in more than one component, with each class's component and the list's largest one."""
    own = lists.select("token", "item", "n", "n_single", "place").join(root.select(F.col("node").alias("item"), "root"), "item", "left")
    own = own.withColumn("root", F.coalesce("root", "item"))
    sizes = own.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return own.join(main.select("token", F.col("x")["root"].alias("main")), "token")


def similar(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    NULL and empty texts have no shingles and stand alone. A NULL doc_id names no component: it takes the least id that its text is
    linked with, or NULL. Rows with equal texts are linked whatever their ids; a repeated doc_id is repeated in the result with
    the component of its own text. No rows give no rows.
    """
    shared = shared_tokens(docs, shingle_set, by_text=False)
    sets = pin(shared.sets)
    root = links(sets, percent)
    classes = shared.rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = pin(classes.join(root.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = pin(rooted.join(ids, "root").select("class", "component_id"))
    rows = shared.rows.join(named, "class", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of `docs` with the least doc_id of their component; of rows with that id and the same text one stays."""
    keep = similar(docs, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
    return kept.dropDuplicates(docs.columns)
