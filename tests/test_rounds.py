"""Procedures in rounds against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F


def order(src, dst, k):
    return (src * 7919 + dst * 104729 + k * 31) % F.lit(10007)


def plain_order(e, k):
    return ((e[0] * 7919 + e[1] * 104729 + k * 31) % 10007, *e)


def graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def plain_seeds(relations, k=0):
    first = {}
    for e in relations:
        for x in e:
            first[x] = min(first.get(x, plain_order(e, k)), plain_order(e, k))
    return [e for e in relations if all(first[x] == plain_order(e, k) for x in e)]


def plain_expand(relations, neighbours, sizes, seeds, budget, recent, k=0):
    live, near = set(relations), defaultdict(set)
    for a, b in neighbours:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    batch = {plain_order(e, k): set(e) for e in seeds}
    room = {s: budget - sum(sizes.get(x, 0) for x in m) for s, m in batch.items()}
    taken = set().union(*batch.values()) if batch else set()
    banned = {s: set() for s in batch}
    while True:
        wanted = {}
        for s, mine in batch.items():
            options = []
            for c in {x for m in mine for x in near[m]} - taken - banned[s]:
                if sizes.get(c, 0) > room[s]:
                    banned[s].add(c)
                    continue
                votes = sum(((c, m) in live) + ((m, c) in live) for m in mine)
                options.append((-votes, -recent.get(c, float("-inf")) if not votes else 0, c))
            if options:
                c = min(options)[2]
                wanted[c] = min(wanted.get(c, s), s)
        if not wanted:
            return batch
        for c, s in wanted.items():
            batch[s].add(c)
            room[s] -= sizes.get(c, 0)
            taken.add(c)


@pytest.fixture
def small(spark):
    edges = graph(5, 24, 40) + [(100, 100), (200, 201)]
    sizes = {x: (x * 13) % 40 for x in range(120)} | {200: 500}
    return edges, sizes, spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(a, b) for a, b in sizes.items()], "node long, size int")


def grouped(rows):
    out = defaultdict(set)
    for r in rows:
        out[tuple(r["seed"])].add(r["node"])
    return dict(out)


def test_batches_grow_as_plain_ones(spark, small):
    from quarry.operators.expansion import expand, independent

    edges, sizes, relations, weights = small
    open_ = [e for e in edges if sum(e) % 3]
    recent = {x: (x * 37) % 50 for x in range(24)}
    seeds = independent(spark.createDataFrame(open_, "src long, dst long"), None, order)
    got = expand(spark.createDataFrame(open_, "src long, dst long"), relations, weights, seeds, 120, recency=spark.createDataFrame(list(recent.items()), "node long, recent int"))
    assert grouped(got.collect()) == plain_expand(open_, edges, sizes, plain_seeds(open_), 120, recent)


def test_seeds_leave_locked_nodes_alone(spark, small):
    from quarry.operators.expansion import expand, independent

    edges, sizes, relations, weights = small
    locked = spark.createDataFrame([(x,) for x in range(0, 24, 5)], "node long")
    got = expand(relations, relations, weights, independent(relations, locked, order), 120, locked).collect()
    assert got and not {r["node"] for r in got} & set(range(0, 24, 5))
    nodes = [r["node"] for r in got]
    assert len(nodes) == len(set(nodes))


def test_neighbours_of_taken_nodes_are_not_read_again(spark, small, monkeypatch):
    from quarry.operators import expansion

    _, _, relations, weights = small
    near = []
    monkeypatch.setattr(expansion, "stored", lambda df, f=expansion.stored: (near.append(f(df)), near[-1])[1])
    seeds = expansion.independent(relations, None, order)
    batches = expansion.expand(relations, relations, weights, seeds, 120).collect()
    first, later = [{(r["node"], r["other"]) for r in t.collect()} for t in near if t.columns == ["node", "other", "votes", "size", "recent"]][:2]
    gone = {r["node"] for r in batches if r["step"] == 0}
    assert gone and later == {(a, b) for a, b in first if not {a, b} & gone}
    open_ = [{(tuple(r["seed"]), r["node"]) for r in t.collect()} for t in near if "won" in t.columns]
    for k, rows in enumerate(open_):  # a node that came by a round is no candidate after it
        assert not {n for _, n in rows} & {r["node"] for r in batches if r["step"] <= k}


def plain_cover(edges, sizes, budget, changed, most):
    live, tries, batches = set(edges), defaultdict(int), []
    k = 0
    while live:
        found = plain_expand(live, live, sizes, plain_seeds(sorted(live), k), budget, {}, k)
        of = {x: s for s, m in found.items() for x in m}
        batches += [(k, s, frozenset(m)) for s, m in found.items()]
        for e in [e for e in live if e[0] in of and of[e[0]] == of.get(e[1])]:
            live.remove(e)
            tries[e] += 1
        for n in changed(of, k):
            for e in edges:
                if e[1] == n and e[0] != n and of.get(e[0]) != of[n] and e not in live and tries[e] < most:
                    live.add(e)
        k += 1
    return batches, dict(tries)


@pytest.mark.parametrize("returns", [True])
def test_cover_is_that_of_plain_python(spark, small, returns):
    from quarry.operators.expansion import cover

    edges, sizes, relations, weights = small
    hook = (lambda b, k: b.where((F.col("node") % 5 == k) & F.lit(k < 4)).select("node")) if returns else None
    batches, tries = cover(relations, weights, 90, hook, most_tries=2, order=order)
    want_batches, want = plain_cover(edges, sizes, 90, (lambda of, k: [x for x in of if x % 5 == k < 4]) if returns else (lambda of, k: []), 2)
    assert {(r["src"], r["dst"]): r["tries"] for r in tries.collect()} == want
    got = defaultdict(set)
    for r in batches.collect():
        got[r["round"], tuple(r["seed"])].add(r["node"])
    assert {(k, s, frozenset(m)) for (k, s), m in got.items()} == set(want_batches)
    assert max(want.values()) == (2 if returns else 1)


def test_cover_of_nothing_and_of_nulls(spark):
    from quarry.operators.expansion import cover

    sizes = spark.createDataFrame([(1, None), (None, 3)], "node long, size int")
    batches, tries = cover(spark.createDataFrame([(None, 1), (2, None)], "src long, dst long"), sizes, 10)
    assert batches.count() == 0 and tries.count() == 0
    batches, tries = cover(spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "src long, dst long"), sizes, 10)
    assert sorted(map(tuple, tries.collect())) == [(1, 2, 1), (3, 3, 1)]


def check_colours(holds, colours):
    of, near = defaultdict(set), defaultdict(set)
    for t, lock in holds:
        if lock is not None and t is not None:
            of[lock].add(t)
    for tasks in of.values():
        assert len({colours[t] for t in tasks}) == len(tasks)
        for t in tasks:
            near[t] |= tasks - {t}
    assert set(colours) == {t for t, _ in holds if t is not None}
    assert all(0 <= c <= len(near[t]) for t, c in colours.items())


@pytest.mark.parametrize("case", ["random", "hub", "nulls", "empty"])
def test_colours(spark, case):
    from quarry.operators.colouring import conflict_free

    rng = random.Random(2)
    holds = {
        "random": [(t, rng.randrange(40)) for t in range(150) for _ in range(rng.randrange(1, 5))],
        "hub": [(t, 0) for t in range(1000)] + [(t, 1 + t % 7) for t in range(0, 1000, 3)] + [(2000, 3)],
        "nulls": [(1, None), (2, None), (None, 4), (3, 4), (4, 4), (4, 4), (5, None), (5, 4)],
        "empty": [],
    }[case]
    got = conflict_free(spark.createDataFrame(holds, "task long, lock long")).collect()
    assert len(got) == len({r["task"] for r in got})
    check_colours(holds, {r["task"]: r["colour"] for r in got})


def test_fixpoint_reads_only_what_is_left(spark):
    from quarry.operators.rounds import fixpoint

    read = []

    def step(left, k):
        read.append(left.count())
        return left.select("id", (F.col("n") - 1).alias("n"))

    items = spark.createDataFrame([(k, k % 4) for k in range(40)] + [(99, 50), (100, None)], "id long, n int")
    got = {r["id"]: (r["n"], r["rounds"], r["unresolved"]) for r in fixpoint(items, step, F.col("n") == 0, 5).collect()}
    assert read == [32, 22, 12, 2, 2]
    assert got[0] == (0, 0, False) and got[7] == (0, 3, False) and got[99] == (45, 5, True) and got[100] == (None, 5, True)
    assert fixpoint(items.limit(0), step, F.col("n") == 0, 5).count() == 0


def test_places_of_a_large_group_of_equal_rows(spark):
    from quarry.operators.rounds import places

    rows = spark.createDataFrame([("a", 5)] * 300 + [("a", k) for k in range(10)] + [("b", 1), (None, 2), (None, 1)], "g string, x int")
    got = [tuple(r) for r in places(rows, ["g"], ["x"]).collect()]
    assert len(got) == 313
    for g in ("a", "b", None):
        mine = sorted((p, x) for h, x, p in got if h == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)


def plain_scc(nodes, edges):
    reach = {v: {v} for v in nodes}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    for v in nodes:
        todo = [v]
        while todo:
            for y in out[todo.pop()]:
                if y not in reach[v]:
                    reach[v].add(y)
                    todo.append(y)
    return {v: min(u for u in reach[v] if v in reach[u]) for v in nodes}


def plain_layers(nodes, edges):
    scc = plain_scc(nodes, edges)
    deps = defaultdict(set)
    for a, b in edges:
        if scc[a] != scc[b]:
            deps[scc[a]].add(scc[b])
    level = {}

    def of(c):
        if c not in level:
            level[c] = max((of(x) + 1 for x in deps[c]), default=0)
        return level[c]

    return {v: (scc[v], of(scc[v])) for v in nodes}, {c for c in scc.values() if sum(x == c for x in scc.values()) > 1}


@pytest.mark.parametrize("seed, n, m", [(1, 30, 34), (2, 16, 40), (4, 12, 0)])
def test_layers_of_cyclic_graphs(spark, seed, n, m):
    from quarry.operators.contraction import layers, levels_before_cycles

    edges = graph(seed, n, m)
    frame = spark.createDataFrame([*edges, *edges[:3], (1, 1), (None, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in range(n)], "node long")
    want, cyclic = plain_layers(range(n), edges)
    assert {r["node"]: (r["scc"], r["layer"]) for r in layers(frame, nodes).collect()} == want
    deps = {v: {w for w in range(n) if any(x == (v, w) for x in edges)} for v in range(n)}
    bad = {v for v in range(n) if want[v][0] in cyclic}
    while more := {v for v in set(range(n)) - bad if deps[v] & bad}:
        bad |= more
    assert {r["node"]: r["level"] for r in levels_before_cycles(frame, nodes).collect()} == {v: want[v][1] for v in range(n) if v not in bad}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from quarry.operators import contraction

    n, tables = 10_000, []
    monkeypatch.setattr(contraction, "stored", lambda df, f=contraction.stored: tables.append(1) or f(df))
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long")
    got = {r["node"]: r["level"] for r in contraction.longest_levels(chain, chain.select(F.col("src").alias("node"), F.lit(0).alias("least")).limit(0)).collect()}
    assert got == {k: n - k for k in range(n + 1)}
    assert len(tables) < 20


def test_a_long_cycle_with_tails(spark):
    from quarry.operators.contraction import components

    edges = [(k, (k + 1) % 200) for k in range(200)] + [(1000 + k, 1001 + k) for k in range(150)] + [(1150, 7), (20, 2000)] + [(2000 + k, 2001 + k) for k in range(100)]
    got = {r["node"]: r["scc"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[k] == k for k in got if k >= 200)


@pytest.mark.parametrize("seed, several", [(3, 0), (4, 0), (5, 6)])
def test_components_of_nodes_with_one_edge_out_take_few_tables(spark, monkeypatch, seed, several):
    from quarry.operators import contraction

    rng, n, tables = random.Random(seed), 900, []
    edges = sorted({(v, rng.randrange(n)) for v in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(several)})
    edges += [(2000 + k, 2001 + k) for k in range(300)] + [(2300, 5), (3000, 3001), (3001, 3000)]
    monkeypatch.setattr(contraction, "stored", lambda df, f=contraction.stored: tables.append(1) or f(df))
    got = {r["node"]: r["scc"] for r in contraction.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {v for e in edges for v in e}
    assert got == plain_scc(nodes, edges)
    assert several or len(tables) < 12


def test_chains_come_back_into_components(spark):
    from quarry.operators.contraction import components

    loop = [(k, k + 1) for k in range(100)] + [(100, 200), (200, 0), (200, 60), (200, 300)]  # in at 0 and 60, a node with several out
    tails = [(400 + k, 401 + k) for k in range(50)] + [(450, 30), (300, 301), (301, 302), (302, 301), (500, 501), (500, 502), (501, 500), (502, 500)]
    edges = [*loop, *tails]
    for way in (edges, [(b, a) for a, b in edges]):
        got = {r["node"]: r["scc"] for r in components(spark.createDataFrame(way, "src long, dst long")).collect()}
        assert got == plain_scc({v for e in way for v in e}, way)


def test_nodes_that_nothing_leads_to_are_not_jumped_from(spark, monkeypatch):
    from quarry.operators import contraction

    rows = []
    monkeypatch.setattr(contraction, "stored", lambda df, f=contraction.stored: rows.append((t := f(df)).count()) or t)
    single = spark.createDataFrame([(k, 0) for k in range(10, 1000)] + [(0, 2), (2, 1), (1, 0)], "node long, to long")
    assert {tuple(r) for r in contraction._cycles(single).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert sum(rows) < 100


def test_a_label_without_a_row_is_of_its_component(spark):
    from quarry.operators.contraction import components

    for hub, chain in ((5, (1, 2)), (1, (5, 7))):  # the hub has several edges out and is trimmed before its chain comes back
        edges = [(hub, chain[0]), chain, (chain[1], hub), (hub, 9), (hub, 10), (20, hub)]
        got = {r["node"]: r["scc"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == plain_scc({v for e in edges for v in e}, edges)


def test_colours_with_large_locks(spark, monkeypatch):
    from quarry.operators import colouring

    rng = random.Random(4)
    holds = [(t, 0) for t in range(300)] + [(t, 1 + rng.randrange(30)) for t in range(400) for _ in range(3)] + [(999, None)]
    df = spark.createDataFrame(holds, "task long, lock long")
    plain = {r["task"]: r["colour"] for r in colouring.conflict_free(df).collect()}
    monkeypatch.setattr(colouring, "LARGE", 50)
    got = {r["task"]: (r["colour"], sorted(r["locks"])) for r in colouring.coloured(df).collect()}
    check_colours(holds, plain)
    assert {t: c for t, (c, _) in got.items()} == plain
    assert all(got[t][1] == sorted({k for u, k in holds if u == t and k is not None}) for t in got)
