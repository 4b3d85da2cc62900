"""Labels of trees, contexts, versions, packing and the rule cascade against plain Python."""

import random

import pytest

PIECES = "doc_id string, path array<string>, kind string, text string, ord int"


def tree(seed, n=60):
    rng = random.Random(seed)
    paths = {("a",)}
    while len(paths) < n:
        up = rng.choice(sorted(paths))
        paths.add(rng.choice([(*up, rng.choice("abcd")), (rng.choice("abcdef"),)]))
    return [("d", list(p), rng.choice(["impl", "struct", "fn", "use"]), "/".join(p), k) for k, p in enumerate(sorted(paths))]


def inside(p, q):
    return p[: len(q)] == q


def paths_of(df):
    return sorted(tuple(r["path"]) for r in df.collect())


@pytest.fixture(scope="module", params=[1, 2])
def forest(spark, request):
    from quarry.operators.labels import labelled

    rows = tree(request.param)
    return rows, labelled(spark.createDataFrame([*rows, ("e", ["a"], "fn", "other", 0), ("e", None, "fn", "none", 1)], PIECES))


def test_ranges_hold_what_lies_inside(forest):
    rows, labels = forest
    got = {tuple(r["path"]): (r["pre"], r["last"]) for r in labels.where("doc_id = 'd'").collect()}
    assert len(got) == len(rows)
    for p, (pre, last) in got.items():
        assert {q for q, (x, _) in got.items() if pre <= x <= last} == {q for q in got if inside(q, p)}


def test_below_above_trimmed_without(spark, forest):
    from quarry.operators import labels as L

    rows, labels = forest
    kind = {tuple(r[1]): r[2] for r in rows}
    want = random.Random(9).sample(sorted(kind), 6)
    chosen = L.with_paths(labels, spark.createDataFrame([("d", list(p)) for p in want], "doc_id string, path array<string>"))
    up = {q for q in kind for p in want if inside(p, q)}
    down = {q for q in kind for p in want if inside(q, p)}
    assert paths_of(L.above(labels, chosen)) == sorted(up) and paths_of(L.below(labels, chosen)) == sorted(down)
    assert paths_of(L.trimmed(labels, chosen, ["struct"])) == sorted(up | down | {q for q in kind for c in up if kind[c] == "struct" and inside(q, c)})
    left = set(kind) - down
    had = {q for q in kind if any(inside(p, q) and p != q for p in kind)}
    while gone := {q for q in left if kind[q] in ("impl", "struct") and q in had and not any(inside(p, q) and p != q for p in left)}:
        left -= gone
    assert paths_of(L.without(labels, chosen, ["impl", "struct"]).where("doc_id = 'd'")) == sorted(left)


def test_context(spark, forest):
    from quarry.operators import labels as L

    rows, labels = forest
    kind = {tuple(r[1]): r[2] for r in rows}
    want, used = random.Random(3).sample(sorted(kind), 4), random.Random(4).sample(sorted(kind), 3)
    frame = lambda ps: spark.createDataFrame([("d", list(p)) for p in ps], "doc_id string, path array<string>")
    shown, signed = L.context(labels, frame(want), frame(used), ["impl"], ["struct"])

    def cut(ps):
        up = {q for q in kind for p in ps if inside(p, q)}
        return up | {q for q in kind for p in ps if inside(q, p)} | {q for q in kind for c in up if kind[c] == "struct" and inside(q, c)}

    roots = {q for q in kind if len(q) == 1 and (kind[q] in ("impl", "struct") or q in want)}
    expect = {q for q in cut(want) if (q[0],) in roots} | {q for q in kind if kind.get((q[0],)) == "use"}
    assert paths_of(shown) == sorted(expect) and paths_of(signed) == sorted(cut(used))


def test_summaries(spark):
    from pyspark.sql import functions as F

    from quarry.operators.labels import summary

    rows = [("fn", "fn a() { 1 }", "fn a()", None), ("const", "const A: u8 = 1;", None, "u8"), ("macro", "(a) => { b }; (c, d) => { e };", None, None), ("struct", "struct S;", None, None), ("fn", "fn x() {}", None, None)]
    got = spark.createDataFrame(rows, "kind string, text string, signature string, type_name string").select(summary(*map(F.col, ("kind", "text", "signature", "type_name"))).alias("s"))
    assert [r["s"] for r in got.collect()] == ["fn a()", "u8", "(a); (c, d)", "struct S;", "fn x() {}"]


def test_versions_are_a_fold_of_the_log(spark, tmp_path):
    from quarry.operators import workspace as W

    rng = random.Random(7)
    log, allowed = [], []
    for v in range(12):
        segments = rng.sample("ABCDE", rng.randrange(1, 4))
        if v % 4:
            allowed += [(v, s) for s in segments]
        for s in rng.sample("ABCDE", 3):
            for k, p in enumerate(rng.sample("pqrstu", rng.randrange(1, 4))):
                log.append((v, s, p, f"{p}{v}{s}", k))
    path = str(tmp_path / "table")
    for some in ([x for x in log if x[0] < 5], [x for x in log if x[0] >= 5]):
        W.append(path, spark.createDataFrame(some, "version long, segment string, piece string, text string, ord long"), spark.createDataFrame(allowed, "version long, segment string"))
    for until in (0, 4, 11):
        fwd, bck, text, evicted = {}, {}, {}, 0
        for v in range(until + 1):
            may = {s for w, s in allowed if w == v}
            new = {}
            for w, s, p, t, k in log:
                if w != v:
                    continue
                if may and s not in may:
                    evicted += 1
                    continue
                new.setdefault(s, []).append((p, k))
                bck.setdefault(p, set()).add(s)
                text[p] = max(text.get(p, (-1,)), (v, k, t))
            fwd |= new
        rows = W.read(spark, path, until)
        assert sorted(map(tuple, W.forward(rows).collect())) == sorted((s, p, k) for s, ps in fwd.items() for p, k in ps)
        assert {r["piece"]: set(r["segments"]) for r in W.back(rows).collect()} == bck
        assert {r["piece"]: (r["version"], r["ord"], r["text"]) for r in W.code(rows).collect()} == text
        assert rows.where("evicted").count() == evicted
    uses = spark.createDataFrame([("A", "B"), ("A", "A"), ("C", "B"), ("C", "Z")], "src string, dst string")
    got = {(r["segment"], r["piece"]) for r in W.of_dependencies(rows, uses).collect()}
    assert got == {(s, p) for s in "AC" for p, _ in fwd.get("B", [])}


def test_leaves_are_packed_in_order(spark):
    from quarry.operators.batching import first_fit_layers, pack_leaves

    def plain(sizes, budget):
        left, out, batch = list(range(len(sizes))), [0] * len(sizes), 0
        while left:
            at, room = left.pop(0), budget
            out[at] = batch
            while fit := [i for i in left if sizes[i] < room]:
                out[fit[0]], room = batch, room - sizes[fit[0]]
                left.remove(fit[0])
            batch += 1
        return out

    for seed in range(60):
        rng = random.Random(seed)
        sizes = [rng.randrange(0, 50) for _ in range(rng.randrange(0, 40))]
        assert pack_leaves(sizes, 60) == plain(sizes, 60)
    assert max(pack_leaves([20, 20, 20], 20)) == 2  # a size that equals what is left doesn't fit
    nodes = spark.createDataFrame([(k % 2, k, k % 7 if k % 5 else None) for k in range(40)], "key int, node long, size int")
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 40)] + [(0, 1)], "src long, dst long")
    got = first_fit_layers(nodes, edges, 9).collect()
    level = {0: 0, 1: 0} | {k: k.bit_length() - 1 for k in range(2, 40)}
    size = {k: (k % 7 if k % 5 else 0) for k in range(40)}
    groups = {}
    for k in range(40):
        if k != 1:  # in a cycle with 0
            groups.setdefault((k % 2, level[k]), []).append((k, size[k] + (size[1] if k == 0 else 0)))
    want = {(key, s, layer, b) for (key, layer), xs in groups.items() for (s, _), b in zip(xs, plain([n for _, n in xs], 9))}
    assert {tuple(r) for r in got} == want


def test_cascade_rules_one_by_one(spark):
    from quarry.operators.cascade import LEFT, RIGHT, match

    left = [
        (1, "macro", "MAX_LEN", None, None, None, None, None), (2, "macro", "debug", None, None, None, None, None), (3, "macro_fun", "Swap", None, None, None, None, None),
        (4, "declaration", "helper", None, [True], None, None, None), (5, "declaration", "count", None, [False], None, None, None), (6, "declaration", "x_pos", None, None, None, None, None),
        (7, "multi_declaration", None, ["count", "helper", "nothing", "x_pos"], [False, True, False, False], None, None, None), (8, "function", "list_push", None, None, None, None, None), (9, "function", "pop", None, None, None, None, None),
        (10, "enum", None, None, None, None, None, ["Red", "GREEN"]), (11, "enum", "Level", None, None, None, None, ["LOW_END", "HIGH", "gone"]), (12, "typedef", "node_t", None, None, "struct", "Node", None),
        (13, "typedef", "point", None, None, "struct", None, None), (14, "typedef", "size", None, None, None, None, None), (15, "multi_typedef", None, ["point", "size", "Node"], None, "struct", None, None),
        (16, "union", "Node", None, None, None, None, None), (17, "struct", "", None, None, None, None, None), (18, "using", "shade", None, None, "enum", "shade", ["red", "green"]), (19, "struct", None, None, None, None, None, None),
    ]
    right = [
        (100, "const", "max_len", None, None), (101, "const", "MAX_LEN", None, None), (102, "const", "DEBUG", None, None), (103, "macro", "swap", None, None), (104, "fn_signature", "helper", None, None), (105, "static", "count", None, None),
        (106, "struct", "Node", None, None), (107, "field", "x_pos", 106, None), (108, "impl", "List", None, None), (109, "fn", "push", 108, None), (110, "fn", "pop", 108, None), (111, "enum", "Color", None, ["RED", "Green"]),
        (112, "const", "lowEnd", None, None), (113, "static", "HIGH", None, None), (114, "struct", "Point", None, None), (115, "type", "size", None, None), (116, "const", "MAX_LEN", None, None),
    ]
    got = {(r["left_id"], r["part"]): (r["right_id"], r["rule"]) for r in match(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)).collect()}
    assert got == {
        (1, 0): (101, "name"), (2, 0): (102, "name parts"), (3, 0): (103, "name parts"), (4, 0): (104, "signature"), (5, 0): (105, "value"), (6, 0): (107, "field"),
        (7, 0): (105, "value"), (7, 1): (104, "signature"), (7, 3): (107, "field"), (8, 0): (109, "method"), (9, 0): (110, "method"), (10, 0): (111, "members"),
        (11, 0): (112, "enumerator parts"), (11, 1): (113, "enumerator"), (12, 0): (106, "body name"), (13, 0): (114, "body kind parts"), (14, 0): (115, "type"), (15, 0): (114, "type parts"), (15, 2): (106, "type"), (18, 0): (111, "body members"),
    }
    assert match(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT)).count() == 0


def test_long_segments_are_few_rows(spark):
    from quarry.operators.intervals import containment_join, lookup_first

    rng = random.Random(1)
    segments = [(f, s, s + rng.choice([0, 5, 60, 700, 10**6]), k) for k, (f, s) in enumerate((rng.choice("ab"), rng.randrange(-500, 5000)) for _ in range(120))] + [(None, 1, 2, 900), ("a", None, 3, 901)]
    probes = [(k, rng.choice("abc"), s, s + rng.randrange(4)) for k, s in enumerate(rng.randrange(-500, 6000) for _ in range(150))] + [(999, None, 1, 1)]
    p, s = spark.createDataFrame(probes, "id int, file string, ps long, pe long"), spark.createDataFrame(segments, "file string, ss long, se long, segment int")
    want = {(k, x[3]) for k, f, a, b in probes for x in segments if f is not None and x[0] == f and x[1] is not None and x[1] <= a and b <= x[2]}
    assert sorted(map(tuple, containment_join(p, s).select("id", "segment").collect())) == sorted(want)
    first = {r["id"]: r["segment"] for r in lookup_first(p, s, "id", "segment").collect()}
    assert first == {k: min((x for y, x in want if y == k), default=None) for k, *_ in probes}
    assert lookup_first(p, s.limit(0), "id", "segment").where("segment is null").count() == len(probes)


def test_cascade_gathers_nothing_in_the_driver(spark):
    from quarry.operators.cascade import LEFT, RIGHT, match

    left = spark.createDataFrame([(1, "macro", "a", None, None, None, None, None)], LEFT)
    right = spark.createDataFrame([(10, "macro", "a", None, None)], RIGHT)
    assert "Broadcast" not in match(left, right)._jdf.queryExecution().executedPlan().toString()


def test_facts_are_parsed_once_before_they_are_joined(spark):
    from quarry.operators.graph import segment_graph

    facts = spark.createDataFrame([("file://a.c:2:1:2:9", "file://b.c:7:1:7:9"), ("file://a.c:2:1:2:9", "file://b.c:90:1:90:9"), ("file://a.c:1:1:5:9", "nowhere"), ("file://b.c:7:1:7:9", "file://:0:0:0:0"), (None, "file://a.c:2:1:2:9")], "src string, dst string")
    segments = spark.createDataFrame([("a.c", 1, 9, 12), ("a.c", 2, 3, 11), ("b.c", 1, 200, 22), ("b.c", 5, 100, 21), ("b.c", 60, 2000, 20)], "file string, ss int, se int, segment long")
    found = segment_graph([facts], segments)
    assert sorted(map(tuple, found.collect())) == [(11, 20), (11, 21)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan and "file://" not in plan


def test_locations_are_as_their_pattern_has_them(spark):
    import re

    from pyspark.sql import functions as F

    from quarry.functions import text as T

    texts = ["file://a.c:1:2:3:4", "file://a:b:1:2:3:4", "file://:0:0:0:0", "file://a:1:2:3", "x file://a:1:2:3:4", "file://a\nfile://b:5:6:7:8", "file://a:1:2:3:4\n:5", "file://a::::", "file://file://a:9:9:x:9", "", "file://é:7::8:", "x\n1\n2", "file://a\u2028:1:2:3:4"]
    number = lambda x: int(x) if re.fullmatch("-?[0-9]+", x) else None
    want = {}
    for t in texts:
        m = re.search(T.LOCATION.replace(".*", "[^\n\r\u0085\u2028\u2029]*"), t)
        want[t] = (m[1], number(m[2]), number(m[3])) if m and m[1] else None
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.location(F.col("t")).alias("at")).collect()
    assert {r["t"]: tuple(r["at"]) if r["at"] else None for r in got} == want
    assert T.LINE_ENDS == ("\n", "\r", "\u0085", "\u2028", "\u2029")


def test_contexts_do_not_match_pieces_that_hold_nothing_by_ranges(spark, monkeypatch):
    """As in plain Python, on nested trees with repeated paths; ranges are of pieces that hold something alone."""
    import random

    from quarry.operators import labels

    rng, rows = random.Random(11), []
    for doc in range(6):
        paths = [(str(k),) for k in range(4)]
        for _ in range(14):
            paths.append((*rng.choice(paths), rng.choice("xyz")))
        rows += [(doc if doc else None, list(p), rng.choice(["impl", "struct", "use", "fn"])) for p in paths]
    tree = labels.labelled(spark.createDataFrame(rows, "doc_id long, path array<string>, kind string"))
    every = [r.asDict() for r in tree.collect()]
    holds = lambda a, b: a["doc_id"] is not None and a["doc_id"] == b["doc_id"] and a["pre"] <= b["pre"] <= a["last"]
    for a in every:  # the last of equal paths holds what lies below
        same = [b["pre"] for b in every if (b["doc_id"], b["path"]) == (a["doc_id"], a["path"])]
        under = [b["pre"] for b in every if b["doc_id"] == a["doc_id"] and len(b["path"]) > len(a["path"]) and b["path"][: len(a["path"])] == a["path"]]
        assert a["last"] == (max([a["pre"], *under]) if a["pre"] == max(same) else a["pre"])
    ranges, join = [], labels.containment_join
    monkeypatch.setattr(labels, "containment_join", lambda p, s, *more: (ranges.append(s), join(p, s, *more))[1])
    number = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["pre"])
    chosen = [r for r in every if r["pre"] % 5 == 0]
    got = labels.trimmed(tree, tree.where("pre % 5 = 0").select("doc_id", "pre", "last"), ["struct"])
    up = [a for a in every if any(holds(a, c) for c in chosen)]
    whole = [a for a in up if a["kind"] == "struct"] + chosen
    want = {number(a) for a in every if a in up or any(holds(w, a) for w in whole)}
    want = {w for w in want if w[0] >= 0}
    assert sorted(number(r.asDict()) for r in got.collect()) == sorted(want)
    assert sorted(number(r.asDict()) for r in labels.below(tree, tree.where("pre % 5 = 0")).collect()) == sorted(number(a) for a in every if any(holds(c, a) for c in chosen))
    assert sorted(number(r.asDict()) for r in labels.above(tree, tree.where("pre % 5 = 0")).collect()) == sorted(number(a) for a in up)
    assert ranges and all(r.where("ss = se").isEmpty() for r in ranges)
