"""Classes of equal sets, their links and the groups of neighbourhoods against brute force, and on very many equal sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from itemlake.operators import graph as G
from itemlake.plans.scratch import materialise

SCHEMA = "choice_set_id long, text_html string, class_id long, size int"


@pytest.fixture(scope="module")
def sets() -> dict[int, set[str]]:
    r = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    made = {i: set(r.sample(words, r.randint(1, 6))) for i in range(1, 120)}
    made |= {200 + i: set(made[i]) for i in range(1, 120, 3)}
    made |= {500 + i: {"w0", "w1", "w2", "w3", "w4"} for i in range(40)}  # a class of 40
    made |= {600 + i: {"w0", "w1"} for i in range(5)}  # too small to be linked
    return made | {700: set(), 701: set(), 702: {""}, 703: {"w0w1", "w2"}, 704: {"w0", "w1w2"}}


@pytest.fixture(scope="module")
def items(spark, sets):
    rows = [(i, t, -1, -1) for i, s in sets.items() for t in s] + [(i, None, -1, -1) for i in (1, 700, 701)] + [(2, t, -1, -1) for t in sets[2]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def classes(items):
    return materialise(G.set_classes(items), "classes")


@pytest.fixture(scope="module")
def links(items, classes):
    return materialise(G.class_links(items, classes), "links")


def test_classes_are_equal_sets(sets, classes):
    want = {i: (min(j for j, o in sets.items() if o == s), len(s)) for i, s in sets.items()}
    assert {r.choice_set_id: (r.class_id, r.size) for r in classes.collect()} == want


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_links_counts_and_pairs(sets, items, classes, least):
    pairs = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    links = materialise(G.class_links(items, classes, least), "links")
    ids = {r.class_id for r in classes.collect()}
    found = [(r.set_a, r.set_b, r.shared) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b, n) for (a, b), n in pairs.items() if a in ids and b in ids}
    got = [(r.set_a, r.set_b, r.shared) for r in G.near_set_links(items, least).collect()]
    assert sorted(got) == sorted((a, b, n) for (a, b), n in pairs.items())
    counts = {r.choice_set_id: r.n_links for r in G.link_counts(classes, links, least).collect()}
    assert counts == {i: sum(i in p for p in pairs) for i in sets}


def test_groups_are_equal_neighbourhoods(sets, classes, links):
    near = {i: frozenset(j for j in sets if j == i or len(sets[i] & sets[j]) >= 3) for i in sets}
    groups = materialise(G.set_groups(classes, links), "groups")
    keys = {r.choice_set_id: r.group_key for r in groups.collect()}
    assert len(keys) == len(sets)
    for a, b in combinations(sets, 2):
        assert (keys[a] == keys[b]) == (near[a] == near[b])
    pairs = {(r.group_key, r.linked_key) for r in G.group_links(classes, links, groups).collect()}
    assert pairs == {(keys[i], keys[j]) for i in sets for j in near[i]}


def test_keys_of_any_links_are_those_of_the_text(spark, items, sets):
    ids = spark.createDataFrame([(i,) for i in sets], "choice_set_id long")
    r = random.Random(2)
    some = spark.createDataFrame([(*r.sample(list(sets)[:40], 2), 3, "manual") for _ in range(60)] + [(1, 3, 3, "near"), (3, 1, 3, "near")], "set_a long, set_b long, shared int, relation string")
    for given in (G.near_set_links(items), some):
        key = {x.choice_set_id: x.group_key for x in G.closed_neighbourhood(ids, given).collect()}
        text = {x.choice_set_id: x.group_key for x in G.closed_neighbourhood(ids, given, as_text=True).collect()}
        assert set(key) == set(text) == set(sets) and {len(k) for k in key.values()} == {32}
        assert len(set(key.values())) == len(set(text.values())) == len(set(zip(key.values(), (text[i] for i in key), strict=True)))
    by_class = {x.choice_set_id: x.group_key for x in G.set_groups(*(lambda c: (c, G.class_links(items, c)))(G.set_classes(items))).collect()}
    assert by_class == {x.choice_set_id: x.group_key for x in G.closed_neighbourhood(ids, G.near_set_links(items)).collect()}


def test_very_many_equal_sets_stay_linear(spark):
    n = 100_000
    ids = spark.range(n).withColumnRenamed("id", "choice_set_id")
    items = ids.select("choice_set_id", F.explode(F.array(*[F.lit(f"t{k}") for k in range(5)])).alias("text_html"))
    items = items.unionByName(spark.createDataFrame([(n, t) for t in ("t0", "t1", "t2", "x")], "choice_set_id long, text_html string"))
    classes = materialise(G.set_classes(items), "classes")
    links = materialise(G.class_links(items, classes), "links")
    assert [tuple(r) for r in links.collect()] == [(0, n, 3)]
    counts = G.link_counts(classes, links).groupBy("n_links").count().collect()
    assert {(r.n_links, r["count"]) for r in counts} == {(n, n + 1)}
    groups = materialise(G.set_groups(classes, links), "groups")
    assert groups.select("group_key").distinct().count() == 1 and groups.count() == n + 1
    assert G.group_links(classes, links, groups).count() == 1


def test_empty(spark, items):
    none = items.filter("false")
    classes = G.set_classes(none)
    links = G.class_links(none, classes)
    for df in (classes, links, G.link_counts(classes, links), G.set_groups(classes, links), G.near_set_links(none)):
        assert df.count() == 0


def test_wide_sets_and_links_of_some(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    made = {i: set(r.sample(words, r.choice([3, 5, 8, 30, 45]))) for i in range(80)}  # of 30 texts there are 4,060 subsets of three
    items = spark.createDataFrame([(i, t, -1, -1) for i, s in made.items() for t in s], SCHEMA)
    classes = materialise(G.set_classes(items), "classes")
    pairs = {(a, b, len(made[a] & made[b])) for a, b in combinations(made, 2) if len(made[a] & made[b]) >= 3}
    ids = {x.class_id for x in classes.collect()}
    pairs = {p for p in pairs if p[0] in ids and p[1] in ids}
    assert sorted(tuple(x) for x in G.class_links(items, classes).collect()) == sorted(pairs)
    some = {3, 11, 40, 79}
    of = {x.choice_set_id: x.class_id for x in classes.collect()}
    among = spark.createDataFrame([(i,) for i in some] + [(3,), (-5,)], "choice_set_id long")
    asked = {of[i] for i in some}
    got = sorted(tuple(x) for x in G.class_links(items, classes, among=among).collect())
    assert got == sorted(p for p in pairs if p[0] in asked or p[1] in asked)


def test_neighbours_and_group_links_have_no_repeats(sets, classes, links):
    near = {i: sorted(j for j in sets if j == i or len(sets[i] & sets[j]) >= 3) for i in sets}
    assert {x.choice_set_id: x.near for x in G.neighbours(classes, links).collect()} == near
    groups = materialise(G.set_groups(classes, links), "groups")
    pairs = [tuple(x) for x in G.group_links(classes, links, groups).collect()]
    assert len(pairs) == len(set(pairs))


def test_sets_meet_by_what_they_share_not_by_a_common_text(spark):
    """1,000 sets share two texts and no pair is linked: no key of the join holds two of them."""
    items = spark.range(1000).selectExpr("id as choice_set_id", "explode(array('a', 'b', 'x' || id, 'y' || id)) as text_html")
    classes = materialise(G.set_classes(items), "classes")
    keyed = G._subset_keys(G._texts_by_rarity(items, classes, 3), 3)
    assert keyed.count() == 4000 and keyed.groupBy("key").count().filter("count > 1").isEmpty()
    assert G.class_links(items, classes).isEmpty()


@pytest.mark.parametrize("least", [1, 3])
def test_sums_say_what_links_say_without_making_them(spark, items, least):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    wide = [(1000 + i, t, -1, -1) for i in range(25) for t in r.sample(words, r.choice([4, 9, 18, 25]))]  # on both sides of 16 texts
    for rows in (items.unionByName(spark.createDataFrame(wide, SCHEMA)), items.filter("false")):
        of = materialise(G.set_classes(rows), "classes")
        links = materialise(G.class_links(rows, of, least), "links")
        sums = materialise(G.neighbourhood_sums(rows, of, least), "sums")
        assert sorted(map(tuple, G.counted_links(of, sums).collect())) == sorted(map(tuple, G.link_counts(of, links, least).collect()))
        assert sorted(map(tuple, G.summed_groups(of, sums).collect())) == sorted(map(tuple, G.set_groups(of, links, least).collect()))


def test_counts_and_groups_make_no_row_for_a_pair(spark):
    """1,000 sets that all share three texts, 499,500 links: no table that the sums store has a row for each."""
    items = spark.range(1000).selectExpr("id as choice_set_id", "explode(array('a', 'b', 'c', 'x' || id)) as text_html")
    classes = materialise(G.set_classes(items), "classes")
    rows = []
    stored, G.materialise = G.materialise, lambda df, label="table": rows.append(stored(df, label)) or rows[-1]
    try:
        sums = G.neighbourhood_sums(items, classes)
        assert {r.n_links for r in G.counted_links(classes, sums).collect()} == {999}
    finally:
        G.materialise = stored
    assert max(t.count() for t in rows) <= 4000


@pytest.mark.parametrize("least", [1, 3])
def test_keys_of_many_sets_are_compared_in_tiles(spark, monkeypatch, least):
    from itemlake.operators import overlaps

    monkeypatch.setattr(overlaps, "TILE", 32)
    r = random.Random(5)
    few, many = [f"w{i}" for i in range(12)], [f"v{i}" for i in range(60)]
    made = {i: frozenset(r.sample(few, r.randint(2, 5))) for i in range(500)}
    made |= {1000 + i: frozenset(r.sample(few, 3) + r.sample(many, 14)) for i in range(70)}  # wide ones
    made |= {2000 + i: frozenset(["w0", "w1", "w2", f"u{i}"]) for i in range(80)}  # one subset that 80 sets hold
    rows = spark.createDataFrame([(i, t) for i, s in made.items() for t in s], "choice_set_id long, text_html string").cache()
    classes = materialise(G.set_classes(rows), "classes")
    ids = {x.class_id for x in classes.collect()}
    pairs = {(a, b, len(made[a] & made[b])) for a, b in combinations(sorted(made), 2) if len(made[a] & made[b]) >= least}
    links = G.class_links(rows, classes, least)
    assert "MapInArrow" in links._jdf.queryExecution().toString()
    got = [tuple(x) for x in links.collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in pairs if p[0] in ids and p[1] in ids}
    expanded = G.near_set_links(rows, least)
    assert expanded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == links._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")  # links are made once
    got = [(x.set_a, x.set_b, x.shared) for x in expanded.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_linked_groups_store_no_row_for_a_pair(spark, sets, items, classes, links):
    """Groups linked from their texts are those linked from stored links, and no table that they store has a row a pair."""
    groups = materialise(G.set_groups(classes, links), "groups")
    got = sorted(map(tuple, G.linked_groups(items, classes, groups).collect()))
    assert got == sorted(map(tuple, G.group_links(classes, links, groups).collect()))
    many = spark.range(400).selectExpr("id as choice_set_id", "explode(array('a', 'b', 'c', 'x' || id, 'y' || id % 40, 'z' || id % 2)) as text_html")
    many = many.unionByName(spark.range(1000, 1400).selectExpr("id as choice_set_id", "explode(array('z0', 'y' || id % 40, 'x' || (id - 1000))) as text_html"))
    of = materialise(G.set_classes(many), "classes")
    groups = materialise(G.summed_groups(of, G.neighbourhood_sums(many, of)), "groups")
    rows = []
    stored, G.materialise = G.materialise, lambda df, label="table": rows.append(stored(df, label)) or rows[-1]
    try:
        pairs = G.linked_groups(many, of, groups)
        n = pairs.count()
    finally:
        G.materialise = stored
    assert n == G.group_links(of, materialise(G.class_links(many, of), "links"), groups).count()
    assert max(t.count() for t in rows) <= 400 * 6 + 400 * 3


@pytest.mark.parametrize("least", [1, 3])
def test_sums_of_nodes_of_every_size(spark, monkeypatch, least):
    """Nodes compared pair by pair, in blocks and by the next text, in a task and as rows, say what links say."""
    from itemlake.operators import nodes

    r = random.Random(9)
    words = [f"w{i}" for i in range(14)]
    made = [(i, t) for i in range(300) for t in r.sample(words, r.choice([2, 3, 5, 7, 9]))] + [(i + 1000, t) for i in range(300) for t in r.sample(words, 5)]
    rows = spark.createDataFrame(made, "choice_set_id long, text_html string").cache()
    of = materialise(G.set_classes(rows), "classes")
    links = materialise(G.class_links(rows, of, least), "links")
    want = sorted(map(tuple, G.link_counts(of, links, least).collect())), sorted(map(tuple, G.set_groups(of, links, least).collect()))
    for node, small, dense, block in ((1 << 15, 24, 4096, 1024), (1 << 15, 2, 40, 32), (60, 24, 30, 16)):
        monkeypatch.setattr(G, "_NODE", node)
        for name, value in (("_SMALL", small), ("_DENSE", dense), ("_BLOCK", block)):
            monkeypatch.setattr(nodes, name, value)
        sums = materialise(G.neighbourhood_sums(rows, of, least), "sums")
        assert (sorted(map(tuple, G.counted_links(of, sums).collect())), sorted(map(tuple, G.summed_groups(of, sums).collect()))) == want


def test_sums_store_no_subset_of_many_texts(spark):
    """60 sets hold the same 12 texts, 4,017 subsets of three or more each: what is stored stays at the subsets of two."""
    items = spark.range(60).selectExpr("id as choice_set_id", "explode(concat(transform(sequence(1, 12), x -> 't' || x), array('x' || id))) as text_html")
    classes = materialise(G.set_classes(items), "classes")
    rows = []
    stored, G.materialise = G.materialise, lambda df, label="table": rows.append(stored(df, label)) or rows[-1]
    try:
        sums = G.neighbourhood_sums(items, classes)
        assert {x.n_links for x in G.counted_links(classes, sums).collect()} == {59}
    finally:
        G.materialise = stored
    assert max(t.count() for t in rows) <= 60 * 13
