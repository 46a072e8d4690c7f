"""Graph operators on edge DataFrames: components, neighbourhoods, near-set links."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.functions import columns as C
from itemlake.operators.nodes import node_sums
from itemlake.operators.overlaps import pairs_in_tiles
from itemlake.plans.numbering import number_rows
from itemlake.plans.scratch import materialise


def _stored(low: DataFrame) -> DataFrame:
    """Minima as a table of their own: then both sides of the join back are plain exchanges, and AQE splits the edges of a hub."""
    return materialise(low, "cc")


def _star_large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _star_small(edges: DataFrame) -> DataFrame:
    low = _stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each component is a star, and another round changes nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf")))
    per = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
    return per.filter("leaf > 1 or (leaf = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node id reachable.

    Alternating large-star / small-star rounds, each written to the shared folder, until the edge
    set is a forest of stars, which a round's own output tells. Work per round is linear in the edges; hot
    nodes are reduced by map-side minima, and the joins back are plain sort-merge joins that AQE can split.
    Edges with a null end and self loops are ignored (a self loop alone yields no row).
    """
    e = (
        edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
        .filter("x is not null and y is not null and x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .distinct()
    )
    e = materialise(e, "cc")
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        e = materialise(_star_small(_star_large(e)), "cc")
    else:
        raise RuntimeError("connected_components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# --- choice sets ------------------------------------------------------------------------------


def set_classes(items: DataFrame) -> DataFrame:
    """choice_set_id, class_id, size of (choice_set_id, text_html): sets with the same distinct texts are one class, named by its smallest id.

    Null texts don't count; all sets without a text are one class of size 0, which has no links. The key is a hash of the hashed texts in order.
    """
    hashed = F.array_sort(F.collect_set(F.sha2("text_html", 256)))
    sets = items.groupBy("choice_set_id").agg(hashed.alias("hashed")).filter("choice_set_id is not null")
    sets = sets.select("choice_set_id", F.sha2(F.array_join("hashed", ""), 256).alias("texts_key"), F.size("hashed").alias("size"))
    sets = materialise(sets, "sets")
    classes = sets.groupBy("texts_key").agg(F.min("choice_set_id").alias("class_id"))
    return sets.join(classes, "texts_key").select("choice_set_id", "class_id", "size")


#: Sets with at most so many subsets of min_shared texts are joined by these, wider ones by single texts.
_SUBSETS = 256


def _texts_by_rarity(items: DataFrame, classes: DataFrame, min_shared: int) -> DataFrame:
    """choice_set_id, t: of each class's own set the numbers of its distinct texts, rarest first; texts that occur less often have smaller numbers."""
    own = classes.filter(F.col("choice_set_id") == F.col("class_id")).filter(F.col("size") >= min_shared).select("choice_set_id")
    texts = items.join(own, "choice_set_id", "left_semi").select("choice_set_id", "text_html").filter("text_html is not null").distinct()
    texts = materialise(texts, "class-texts")
    numbers = number_rows(texts.groupBy("text_html").agg(F.count(F.lit(1)).alias("df")), ["df", "text_html"], "no").select("text_html", "no")
    return texts.join(numbers, "text_html").groupBy("choice_set_id").agg(F.array_sort(F.collect_list("no")).alias("t"))


def _subset_keys(sets: DataFrame, k: int) -> DataFrame:
    """sets with key: a row for each k of a set's numbers, in order."""
    sets = sets.withColumn("key", F.array().cast("array<long>")).withColumn("after", F.lit(0))
    for taken in range(1, k + 1):
        at = F.sequence(F.col("after") + 1, F.size("t") - (k - taken))
        sets = sets.select(*(c for c in sets.columns if c not in ("key", "after")), "key", F.explode(at).alias("after"))
        sets = sets.withColumn("key", F.concat("key", F.array(F.element_at("t", F.col("after")))))
    return sets.drop("after")


def _numbered(items: DataFrame, classes: DataFrame, min_shared: int, wide: Column) -> DataFrame:
    """choice_set_id, t, wide: the sets of _texts_by_rarity, and whether they are joined by single texts."""
    return materialise(_texts_by_rarity(items, classes, min_shared), "class-numbers").withColumn("wide", wide)


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "key"])


def _named() -> list[Column]:
    """A pair of sets that met, once "shared" says how many texts they share."""
    return [F.least("choice_set_id_a", "choice_set_id_b").alias("set_a"), F.greatest("choice_set_id_a", "choice_set_id_b").alias("set_b"), "shared"]


def _met(left: DataFrame, right: DataFrame, once: Column, min_shared: int) -> DataFrame:
    """set_a < set_b, shared of sets (key, choice_set_id, t) of two sides that meet at the first key of what they share."""
    met = _side(left, "a").join(_side(right, "b"), "key").filter(once).withColumn("both", F.array_intersect("t_a", "t_b")).withColumn("shared", F.size("both"))
    return met.filter((F.slice("both", F.lit(1), F.size("key")) == F.col("key")) & (F.col("shared") >= min_shared)).select(*_named())


#: Keys under which more pairs of sets meet than this squared are compared in tiles.
_TILED = 32


def _all_met(rows: DataFrame, min_shared: int) -> DataFrame:
    """set_a < set_b, shared of the sets (key, choice_set_id, t, inner) that meet at the first key of what they share, one of them inner."""
    counts = rows.groupBy("key").agg(F.sum(F.col("inner").cast("long")).alias("n_inner"), F.count(F.lit(1)).alias("n_all"))
    heavy = materialise(counts.filter(F.col("n_inner").cast("double") * F.col("n_all") > _TILED**2), "heavy-keys")
    light = rows.join(heavy, "key", "left_anti")
    once = F.col("inner_b") & (~F.col("inner_a") | (F.col("choice_set_id_a") < F.col("choice_set_id_b")))
    met = _met(light, light.filter("inner"), once, min_shared)
    return met if heavy.isEmpty() else met.unionByName(pairs_in_tiles(rows, heavy, min_shared).select(*_named()))


def _prefixes(sets: DataFrame, min_shared: int) -> DataFrame:
    """sets with at, key: a row for each of a set's size - min_shared + 1 rarest texts."""
    prefix = sets.select("*", F.posexplode(F.slice("t", F.lit(1), F.size("t") - (min_shared - 1))).alias("at", "no"))
    return prefix.withColumn("key", F.array("no")).drop("no")


def _wide_links(sets: DataFrame, min_shared: int) -> DataFrame:
    """set_a < set_b, shared of the links of sets (choice_set_id, t, wide) that have a wide side."""
    prefix = _prefixes(sets.select("choice_set_id", "t", F.col("wide").alias("inner")), min_shared).drop("at")
    held = prefix.filter("inner").select("key").distinct()
    return _all_met(prefix.join(held, "key", "left_semi"), min_shared)


def _asked_links(sets: DataFrame, min_shared: int) -> DataFrame:
    """set_a < set_b, shared of the links of sets (choice_set_id, t, wide, asked) that have a side that is asked for."""
    # of two narrow sets the one asked for is on the left, and of two asked ones the smaller
    once = F.col("asked_a") & F.when(F.col("asked_b"), F.col("choice_set_id_a") < F.col("choice_set_id_b")).otherwise(F.lit(True))
    keyed = _subset_keys(sets.filter("not wide"), min_shared)
    prefix = _prefixes(sets, min_shared)
    left = F.least(F.size("t_a") - F.col("at_a"), F.size("t_b") - F.col("at_b"))
    one_wide = F.col("wide_b") & ~F.col("wide_a") | F.col("wide_a") & F.col("wide_b") & (F.col("choice_set_id_a") < F.col("choice_set_id_b"))
    wide = _met(prefix, prefix.filter("wide"), one_wide & (F.col("asked_a") | F.col("asked_b")) & (left >= min_shared), min_shared)
    return _met(keyed.filter("asked"), keyed, once, min_shared).unionByName(wide)


def class_links(items: DataFrame, classes: DataFrame, min_shared: int = 3, among: DataFrame | None = None) -> DataFrame:
    """set_a < set_b, shared between the classes (their ids) that share at least min_shared distinct texts.

    among (choice_set_id): only the links of the classes that hold one of these sets, all of them.

    One set a class takes part, however many sets are equal. Two sets that share k texts share a subset of k, so
    sets meet by their subsets, and all that meet are linked: the join makes few pairs more than there are links. A
    pair comes out at the first subset of what it shares. Sets with more than _SUBSETS subsets meet others by
    a prefix filter: with texts ordered by rarity, two sets that share k texts share one among each side's
    first size - k + 1. Such a pair comes out at its first common text. Sets that meet under a key of many are compared in tiles.
    """
    n, subsets = F.size("t").cast("double"), F.lit(1.0)
    for x in range(min_shared):
        subsets = subsets * (n - x) / (x + 1)
    sets = _numbered(items, classes, min_shared, F.round(subsets) > _SUBSETS)
    if among is None:
        narrow = _subset_keys(sets.filter("not wide").select("choice_set_id", "t", F.lit(True).alias("inner")), min_shared)
        return _all_met(narrow, min_shared).unionByName(_wide_links(sets, min_shared))
    asked = classes.join(among.select("choice_set_id").distinct(), "choice_set_id", "left_semi").select(F.col("class_id").alias("choice_set_id"), F.lit(True).alias("asked"))
    return _asked_links(sets.join(asked.distinct(), "choice_set_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), min_shared)


#: Sets with more texts than this take part in neighbourhood_sums by their links.
_COUNTED = 16
#: Classes of a node that one task holds at most.
_NODE = 1 << 15


def neighbourhood_sums(items: DataFrame, classes: DataFrame, min_shared: int = 3) -> DataFrame:
    """class_id, n_near, h0, h1 of each class of min_shared texts or more: how many sets are in it or linked to it, and their fingerprint.

    No row for a pair: a class is counted under each of its subsets of k = min_shared texts or more, and adds up what
    others have there. Two classes that share m texts meet under C(m, j) subsets of j texts; these, times
    (-1)^(j - k) C(j - 1, k - 1), make one for every m >= k. The fingerprint is an exclusive or, for which only
    the parity of that factor counts. Rows are made of the subsets of k - 1 texts only: the classes that hold one are a node, and its
    larger subsets are counted in the task that holds it (nodes). Nodes of more than _NODE classes go on by one text more as rows. Sets of more
    than _COUNTED texts add their pairs (_wide_links).
    """
    sets = _numbered(items, classes, min_shared, F.size("t") > _COUNTED)
    hashed = classes.select("class_id", *_fingerprint(F.col("choice_set_id")))
    whole = materialise(hashed.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")), "class-sums")
    linkable = sets.select(F.col("choice_set_id").alias("class_id"), "t", "wide").join(whole, "class_id")
    zero = F.lit(0).cast("long")
    rows = linkable.filter("not wide").select("class_id", "n", "h0", "h1", zero.alias("k0"), zero.alias("k1"), F.col("t").alias("rest"))
    found = [linkable.select("class_id", F.col("n").alias("n_near"), "h0", "h1")]
    for size in range(1, _COUNTED + 1):
        rows = rows.select("*", F.posexplode("rest").alias("at", "taken")).filter(F.size("rest") - F.col("at") > min_shared - size)
        keys = [F.xxhash64(F.lit(salt), k, "taken").alias(k) for salt, k in (("one", "k0"), ("two", "k1"))]
        rows = rows.select("class_id", "n", "h0", "h1", *keys, F.slice("rest", F.col("at") + 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"))
        if size < min_shared - 1:
            continue
        counts = rows.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("holders"), F.sum("n").alias("all"), F.bit_xor("h0").alias("x0"), F.bit_xor("h1").alias("x1"))
        counts = materialise(counts.filter("holders > 1"), "nodes")
        large = counts.filter(F.col("holders") > _NODE)
        done = large.isEmpty()
        work = counts.filter(F.col("holders") <= _NODE).agg(F.sum(F.col("holders").cast("double") * F.col("holders"))).first()[0] or 0
        found.append(node_sums(rows if done else rows.join(large, ["k0", "k1"], "left_anti"), size, min_shared, work))
        if done:
            break
        rows = materialise(rows.join(large.drop("holders"), ["k0", "k1"]), "held-subsets")
        factor = (-1) ** (size - min_shared) * math.comb(size - 1, min_shared - 1) if size >= min_shared else 0
        others = [F.col(h).bitwiseXOR(F.col(x)) if factor % 2 else zero for h, x in (("h0", "x0"), ("h1", "x1"))]
        if factor:
            found.append(rows.select("class_id", ((F.col("all") - F.col("n")) * factor).alias("n_near"), others[0].alias("h0"), others[1].alias("h1")))
        rows = rows.filter(F.size("rest") > 0)
        if rows.isEmpty():
            break
    wide = materialise(_wide_links(sets, min_shared), "wide-links")
    found.append(_both_ways(wide).join(whole.withColumnRenamed("class_id", "linked_class"), "linked_class").select("class_id", F.col("n").alias("n_near"), "h0", "h1"))
    return reduce(DataFrame.unionByName, found).groupBy("class_id").agg(F.sum("n_near").alias("n_near"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))


def counted_links(classes: DataFrame, sums: DataFrame) -> DataFrame:
    """link_counts from neighbourhood_sums, without links."""
    near = classes.select("choice_set_id", "class_id").join(sums.select("class_id", "n_near"), "class_id", "left")
    return near.select("choice_set_id", F.coalesce(F.col("n_near") - 1, F.lit(0)).alias("n_links"))


def summed_groups(classes: DataFrame, sums: DataFrame) -> DataFrame:
    """set_groups from neighbourhood_sums, without links."""
    near = classes.select("choice_set_id", "class_id").join(sums.select("class_id", "h0", "h1"), "class_id", "left").select("choice_set_id", F.col("h0").alias("g0"), F.col("h1").alias("g1"), *_fingerprint(F.col("choice_set_id")))
    return near.select("choice_set_id", F.coalesce("g0", "h0").alias("h0"), F.coalesce("g1", "h1").alias("h1")).select("choice_set_id", _group_key().alias("group_key"))


def _both_ways(links: DataFrame) -> DataFrame:
    """class_id, linked_class, shared in both directions."""
    return links.select(F.col("set_a").alias("class_id"), F.col("set_b").alias("linked_class"), "shared").unionByName(
        links.select(F.col("set_b").alias("class_id"), F.col("set_a").alias("linked_class"), "shared")
    )


def link_counts(classes: DataFrame, links: DataFrame, min_shared: int = 3) -> DataFrame:
    """choice_set_id, n_links: the other sets that each set is linked to, from classes and links between them alone."""
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    own = sizes.select("class_id", F.when(F.col("size") >= min_shared, F.col("n") - 1).otherwise(0).alias("k"))
    near = _both_ways(links).join(sizes.select(F.col("class_id").alias("linked_class"), F.col("n").alias("k")), "linked_class").select("class_id", "k")
    per = own.unionByName(near).groupBy("class_id").agg(F.sum("k").alias("n_links"))
    return classes.select("choice_set_id", "class_id").join(per, "class_id").select("choice_set_id", "n_links")


def expand_links(classes: DataFrame, links: DataFrame, min_shared: int = 3) -> DataFrame:
    """set_a < set_b, shared of all linked sets: members of linked classes, and members of one class among themselves."""
    own = classes.filter(F.col("choice_set_id") == F.col("class_id")).filter(F.col("size") >= min_shared)
    several = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = own.join(several, "class_id", "left_semi").select("class_id", F.col("class_id").alias("linked_class"), F.col("size").alias("shared"))
    links = links.select(F.least("set_a", "set_b").alias("class_id"), F.greatest("set_a", "set_b").alias("linked_class"), "shared")
    members = materialise(classes.join(several, "class_id", "left_semi").select("class_id", "choice_set_id"), "members")
    one, other = (members.select(F.col("class_id").alias(c), F.col("choice_set_id").alias(s)) for c, s in (("class_id", "x"), ("linked_class", "y")))
    pairs = links.unionByName(same).join(one, "class_id", "left").join(other, "linked_class", "left")  # a class of one set has no row there
    pairs = pairs.withColumns({"x": F.coalesce("x", "class_id"), "y": F.coalesce("y", "linked_class")}).filter("class_id <> linked_class or x < y")
    return pairs.select(F.least("x", "y").alias("set_a"), F.greatest("x", "y").alias("set_b"), "shared")


def near_set_links(items: DataFrame, min_shared: int = 3) -> DataFrame:
    """set_a < set_b, shared, relation of sets sharing at least min_shared distinct texts (choice_set_id, text_html); not closed transitively.

    A row for each pair, so n equal sets give n(n-1)/2; set_classes, class_links and link_counts say the same in rows linear in the sets.
    """
    classes = materialise(set_classes(items), "set-classes")
    links = expand_links(classes, class_links(items, classes, min_shared), min_shared)
    return links.withColumn("relation", F.coalesce(C.relation_for(F.col("shared")), F.lit("manual")))


def apply_link_overrides(auto: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """auto links without those removed, and with those added by hand (set_a, set_b, shared); an added pair outside the relations is 'manual'."""
    ordered = lambda d: d.withColumn("lo", F.least("set_a", "set_b")).withColumn("hi", F.greatest("set_a", "set_b")).drop("set_a", "set_b").withColumnsRenamed({"lo": "set_a", "hi": "set_b"})
    own = ordered(add).filter("set_a <> set_b").select("set_a", "set_b", "shared", F.coalesce(C.relation_for(F.col("shared")), F.lit("manual")).alias("relation"))
    rest = auto.join(ordered(remove), ["set_a", "set_b"], "left_anti").join(own, ["set_a", "set_b"], "left_anti")
    return rest.select("set_a", "set_b", "shared", "relation").unionByName(own.dropDuplicates(["set_a", "set_b"]))


def linked_sets(links: DataFrame) -> DataFrame:
    """choice_set_id, linked_id in both directions."""
    both = links.select(F.col("set_a").alias("choice_set_id"), F.col("set_b").alias("linked_id"))
    return both.unionByName(links.select(F.col("set_b").alias("choice_set_id"), F.col("set_a").alias("linked_id"))).distinct()


def _fingerprint(ids: Column) -> list[Column]:
    """Two independent hashes of an id; sets of ids are compared by the exclusive or of each, which no order of them changes."""
    return [F.xxhash64(F.lit(salt), ids.cast("long")).alias(f"h{k}") for k, salt in enumerate(("one", "two"))]


def _group_key() -> Column:
    return F.concat(F.lpad(F.hex("h0"), 16, "0"), F.lpad(F.hex("h1"), 16, "0"))


def closed_neighbourhood(sets: DataFrame, links: DataFrame, as_text: bool = False) -> DataFrame:
    """choice_set_id, group_key: equal for two sets if they and those linked to them are the same sets.

    links may be any (overrides too). The key is 128 bits however many sets are linked, made by a
    mergeable aggregate; as_text gives the sorted ids joined by commas instead, a list as long as the neighbourhood.
    """
    own = sets.select("choice_set_id", F.col("choice_set_id").alias("linked_id"))
    group = own.unionByName(linked_sets(links).join(sets.select("choice_set_id"), "choice_set_id", "left_semi"))
    if as_text:
        return group.groupBy("choice_set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("linked_id")), lambda x: x.cast("string")), ",").alias("group_key"))
    hashed = group.distinct().select("choice_set_id", *_fingerprint(F.col("linked_id")))
    return hashed.groupBy("choice_set_id").agg(F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")).select("choice_set_id", _group_key().alias("group_key"))


def neighbours(classes: DataFrame, links: DataFrame, min_shared: int = 3) -> DataFrame:
    """choice_set_id, near: each set's sorted array of itself and the sets linked to it, for the links of class_links.

    Members of a class have one neighbourhood, which is made once and then given to each.
    """
    members = classes.select(F.col("class_id").alias("linked_class"), F.col("choice_set_id").alias("linked_id"))
    linkable = classes.filter(F.col("size") >= min_shared)
    own = linkable.select("class_id", F.col("choice_set_id").alias("linked_id"))
    per = own.unionByName(_both_ways(links).join(members, "linked_class").select("class_id", "linked_id")).groupBy("class_id").agg(F.array_sort(F.collect_list("linked_id")).alias("near"))
    lone = classes.filter(F.col("size") < min_shared).select("choice_set_id", F.array("choice_set_id").alias("near"))
    return linkable.select("choice_set_id", "class_id").join(per, "class_id").select("choice_set_id", "near").unionByName(lone)


def set_groups(classes: DataFrame, links: DataFrame, min_shared: int = 3) -> DataFrame:
    """choice_set_id, group_key of closed_neighbourhood for the links of class_links, without a row per linked pair of sets.

    The fingerprint of a neighbourhood is that of its classes, of which each is made once.
    """
    per = classes.select("class_id", "size", *_fingerprint(F.col("choice_set_id"))).groupBy("class_id", "size").agg(F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
    near = _both_ways(links).join(per.select(F.col("class_id").alias("linked_class"), "h0", "h1"), "linked_class").select("class_id", "h0", "h1")
    whole = per.filter(F.col("size") >= min_shared).select("class_id", "h0", "h1").unionByName(near).groupBy("class_id").agg(F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
    linked = classes.join(whole, "class_id").select("choice_set_id", _group_key().alias("group_key"))
    lone = classes.filter(F.col("size") < min_shared).select("choice_set_id", *_fingerprint(F.col("choice_set_id"))).select("choice_set_id", _group_key().alias("group_key"))
    return linked.unionByName(lone)


def group_links(classes: DataFrame, links: DataFrame, groups: DataFrame, min_shared: int = 3) -> DataFrame:
    """group_key, linked_key: a group with itself and with every group that holds a set linked to its sets.

    Sets of one group have the same neighbours, so what one of them is linked to all are, and two groups are linked if
    their smallest classes are. So each pair comes from one link, and the others are left out before keys are joined.
    """
    keys = classes.join(groups, "choice_set_id").groupBy("group_key").agg(F.min("class_id").alias("class_id"))
    other = keys.select(F.col("class_id").alias("linked_class"), F.col("group_key").alias("linked_key"))
    near = _both_ways(links).join(keys, "class_id").join(other, "linked_class").select("group_key", "linked_key").filter("group_key <> linked_key")
    return near.unionByName(keys.select("group_key", F.col("group_key").alias("linked_key")))


def linked_groups(items: DataFrame, classes: DataFrame, groups: DataFrame, min_shared: int = 3) -> DataFrame:
    """group_links of all sets, whose groups are given, without a table of links: one class a group takes its group's key as its name before the classes meet.

    So pairs come out as they are made, once, and nothing is joined to them or kept of them.
    """
    linkable = classes.filter(F.col("size") >= min_shared).join(groups, "choice_set_id")
    named = materialise(linkable.groupBy("group_key").agg(F.min("class_id").alias("choice_set_id"), F.max("size").alias("size")), "group-classes")
    texts = items.join(named, "choice_set_id").select(F.col("group_key").alias("choice_set_id"), "text_html")
    links = class_links(texts, named.select(F.col("group_key").alias("choice_set_id"), F.col("group_key").alias("class_id"), "size"), min_shared)
    ways = [F.struct(F.col(a).alias("group_key"), F.col(b).alias("linked_key")) for a, b in (("set_a", "set_b"), ("set_b", "set_a"))]
    own = groups.select("group_key").distinct().select("group_key", F.col("group_key").alias("linked_key"))
    return links.select(F.explode(F.array(*ways)).alias("x")).select("x.*").unionByName(own)


# --- lineage ----------------------------------------------------------------------------------


def lineage(questions: DataFrame, versions: DataFrame) -> DataFrame:
    """question_id, parent_id for each derived question whose source version exists."""
    parent = versions.select(F.col("id").alias("derived_from"), F.col("question_id").alias("parent_id"))
    return questions.select(F.col("id").alias("question_id"), "derived_from").join(parent, "derived_from").select("question_id", "parent_id", "derived_from")


def derivation_family(questions: DataFrame, versions: DataFrame) -> DataFrame:
    """question_id, family_id: the smallest question id connected by derivation (ancestors, siblings and cousins are one family)."""
    edges = lineage(questions, versions).select(F.col("question_id").alias("a"), F.col("parent_id").alias("b"))
    found = connected_components(edges).select(F.col("node").alias("question_id"), F.col("component").alias("family_id"))
    return questions.select(F.col("id").alias("question_id")).join(found, "question_id", "left").select("question_id", F.coalesce("family_id", "question_id").alias("family_id"))
