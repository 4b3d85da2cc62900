"""Operators against small plain-Python versions, with shuffled, null, empty and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import batching, graph, intervals, linkage, pieces, relational
from quarry.operators.fences import fenced_blocks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_maximal_intervals_against_pairs(spark):
    rng = random.Random(1)
    data = [(f"f{rng.randrange(3)}", a := rng.randrange(40), a + rng.randrange(12)) for _ in range(120)] * 2
    data.append((None, 1, None))
    want = {x for x in data if x[2] is not None and not any(y != x and y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in data if y[2] is not None)}
    got = intervals.maximal_intervals(spark.createDataFrame(data, "file string, start int, end int"))
    assert rows(got) == sorted(want)
    assert intervals.maximal_intervals(spark.createDataFrame([], "file string, start int, end int")).count() == 0


def test_containment_and_first_match(spark):
    rng = random.Random(2)
    segs = [(f"f{rng.randrange(2)}", a := rng.randrange(200), a + rng.randrange(150), k) for k in range(60)]
    probes = [(f"f{rng.randrange(3)}", a := rng.randrange(220), a + rng.randrange(20), k) for k in range(80)]
    p = spark.createDataFrame(probes, "file string, ps int, pe int, id int")
    s = spark.createDataFrame(segs, "file string, ss int, se int, ordinal int")
    want = sorted((q[3], g[3]) for q in probes for g in segs if q[0] == g[0] and g[1] <= q[1] and q[2] <= g[2])
    assert rows(intervals.containment_join(p, s, width=16).select("id", "ordinal")) == want
    first = {q[3]: min((o for i, o in want if i == q[3]), default=None) for q in probes}
    assert {r["id"]: r["ordinal"] for r in intervals.lookup_first(p, s, "id", "ordinal").collect()} == first


def test_scc_and_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (7, 1)], "src long, dst long")
    assert rows(graph.strongly_connected(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]
    tree = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (9,)], "node long")
    assert rows(graph.topological_levels(tree, nodes)) == [(1, 2), (2, 0), (3, 1), (9, 0)]
    assert rows(graph.reach(tree, 3)) == [(1, 2, 1), (1, 3, 1), (3, 2, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("a // x\n/* y */ b  c", "getHTTPName_x", "file:///p:q/a.c:3:1:9:2"), (None, None, None)], "t string, n string, l string")
    got = df.select(T.normalize(F.col("t")), T.token_key(F.col("n")), T.location(F.col("l"))["start_line"], T.norm_path(F.lit("/a/./b/../c//d"))).collect()
    assert tuple(got[0]) == ("a b c", "gethttpnamex", 3, "/a/c/d")
    assert tuple(got[1])[:3] == (None, None, None)


def test_linkage(spark):
    left = spark.createDataFrame([(1, "fn", "readFile"), (2, "fn", "Same"), (3, "fn", None), (4, "fn", "lost"), (5, "un", "x")], "id long, kind string, name string")
    right = spark.createDataFrame([(10, "f", "read_file"), (11, "f", "Same"), (12, "f", "same"), (13, "f", "x")], "id long, kind string, name string")
    kinds = spark.createDataFrame([("fn", "f")], "left_kind string, right_kind string")
    links = linkage.link(left, right, kinds)
    assert rows(links) == [(1, 10, "tokens"), (2, 11, "exact")]
    assert [r["id"] for r in linkage.unmatched(left, links).orderBy("id").collect()] == [3, 4, 5]
    assert linkage.indel_ratio("kitten", "sitting") == 62 and linkage.indel_ratio("", "") == 100


def test_pieces(spark):
    shape = "doc_id string, path array<string>, kind string, text string, ord int"
    old = spark.createDataFrame([("d", ["S"], "struct", "S", 0), ("d", ["S", "a"], "item", "a", 1), ("d", ["S", "a", "x"], "item", "x", 1), ("d", ["f"], "fn", "f", 2)], shape)
    same = spark.createDataFrame([("d", ["S"], "struct", "S2", 0)], shape)
    both = spark.createDataFrame([("d", ["S"], "struct", "S2", 0), ("d", ["S", "a"], "item", "a2", 1)], shape)
    other = spark.createDataFrame([("d", ["S"], "fn", "S3", 0)], shape)
    assert rows(pieces.upsert(old, same).select("text")) == [("S2",), ("a",), ("f",), ("x",)]
    assert rows(pieces.upsert(old, both).select("text")) == [("S2",), ("a2",), ("f",)]
    assert rows(pieces.upsert(old, other).select("text")) == [("S3",), ("f",)]
    assert rows(pieces.upsert(old, same, extendable=["impl"]).select("text")) == [("S2",), ("f",)]
    assert rows(pieces.upsert(old.limit(0), same).select("text")) == [("S2",)] and pieces.upsert(old, same.limit(0)).count() == 4
    gone = old.where("text = 'a'").select("doc_id", "path")
    assert rows(pieces.without(old, gone, ["struct"]).select("text")) == [("f",)]


def test_votes_and_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (4, 1), (4, 1)], "src long, dst long")
    assert rows(graph.votes(edges, spark.createDataFrame([(1,)], "node long"))) == [(2, 2), (3, 1), (4, 1)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 50)], "node long, parent long")
    assert rows(graph.roots(chain)) == [(k, 50, 50 - k) for k in range(1, 50)]
    with pytest.raises(ValueError):
        graph.roots(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), most_rounds=4)


def test_best_similar_against_all_pairs(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcde_") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    data = [(k, rng.choice("pq"), n) for k, n in enumerate(names)] + [(90, "p", None), (91, "q", "")]
    right = [(100 + k, rng.choice("xy"), n[1:] + "a" if k % 2 else n) for k, n in enumerate(names)]
    kinds = [("p", "x"), ("q", "y"), ("q", "x")]
    for least in (60, 85):
        want = []
        for i, k, n in data:
            some = [(-linkage.indel_ratio(n, m), j) for j, q, m in right if (k, q) in kinds and n and linkage.indel_ratio(n, m) >= least]
            if some:
                want.append((i, min(some)[1], -min(some)[0]))
        got = linkage.best_similar(spark.createDataFrame(data, "id long, kind string, name string"), spark.createDataFrame(right, "id long, kind string, name string"), spark.createDataFrame(kinds, "left_kind string, right_kind string"), least)
        assert rows(got) == want


def test_messages(spark):
    df = spark.createDataFrame([("unresolved imports `a::b`, `c`",), ("use of undeclared type `Foo`",), ("failed to resolve: use of unresolved module or unlinked crate `libc`",), ("could not find `x` in `libc`",), (None,)], "m string")
    assert [r[0] for r in df.select(T.import_root(F.col("m"))).collect()] == ["a", None, "libc", None, None]
    texts = spark.createDataFrame([("#[test]\nfn a() {}\n  #[no_mangle]", "/a/inc/b", "inc"), (None, "/x", "")], "t string, f string, i string")
    assert rows(texts.select(T.strip_include(F.col("f"), F.col("i")))) == [("/a",), ("/x",)]
    assert texts.select(T.exported(F.col("t"))).first()[0] == "fn a() {}\n  #[unsafe(no_mangle)]"


def test_packing(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate([60, 50, 40, 120, 10, None])], "k long, o long, n long")
    assert [r["batch"] for r in batching.next_fit(df, "k", "o", "n", 100).orderBy("o").collect()] == [0, 1, 1, 2, 3, 3]
    assert [r["batch"] for r in batching.first_fit(df, "k", "o", "n", 100).orderBy("o").collect()] == [0, 1, 0, 2, 1, 0]


def test_fences(spark):
    md = "a\n```rust\nx\n```\n ``` \ny\n```c++\nz"
    got = fenced_blocks(spark.createDataFrame([(1, md)], "d int, md string"), "d", "md")
    assert rows(got) == [(1, 1, "rust", "x"), (1, 2, "", "y\n```c++\nz")]


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "y"), (4, "w")], "k int, v string")
    assert rows(relational.diff(a, b, ["k"])) == [(1, "left"), (2, "both"), (3, "changed"), (4, "right")]
    assert relational.result_hash(a).first() == relational.result_hash(a.orderBy(F.desc("k"))).first()


def test_first_fit_is_the_plain_one_and_no_search_of_all():
    import random
    import time

    rng = random.Random(5)
    for most in (30, 100, 130):
        rooms, plain = batching.Rooms(), []
        for n in [rng.randrange(-3, most) for _ in range(1500)]:
            at = next((i for i, r in enumerate(plain) if n <= r), len(plain))
            if at == len(plain):
                plain.append(100)
            plain[at] -= n
            assert rooms.put(n, 100) == at
    rooms, start = batching.Rooms(), time.time()
    assert [rooms.put(n, 100) for n in [60] * 100_000] == list(range(100_000))
    assert time.time() - start < 20  # a search of all took hours


def test_trees_read_their_source_once(spark):
    from quarry.operators import pieces

    rows = spark.range(40).selectExpr("'d' AS doc_id", "CASE WHEN id % 4 = 0 THEN array(string(id)) ELSE array(string(id - id % 4), string(id)) END AS path", "CASE WHEN id % 4 = 0 THEN 'impl' ELSE 'fn' END AS kind", "string(id) AS text", "id AS ord")
    gone = spark.createDataFrame([("d", ["0", "1"]), ("d", ["0", "2"]), ("d", ["0", "3"]), ("d", ["8"])], "doc_id string, path array<string>")
    new = spark.createDataFrame([("d", ["4"], "impl", "new", 0)], "doc_id string, path array<string>, kind string, text string, ord long")
    for got, n in ((pieces.without(rows, gone, ["impl"]), 32), (pieces.trimmed(rows, gone, ["impl"]), 8), (pieces.upsert(rows, new), 40)):
        assert "Range (" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == n


def test_messages_in_several_units_as_by_their_distinct_units(spark):
    import random

    from quarry.operators.diagnostics import located, several_units

    rng = random.Random(3)
    span = lambda: (rng.choice(["src/lib.rs", "src/lib.rs", "src/other.rs"]), (at := rng.randint(0, 60)), at + rng.randint(0, 3))
    messages = spark.createDataFrame([(k, k % 3, [span() for _ in range(rng.randint(0, 3))]) for k in range(200)], "msg long, build long, spans array<struct<file_name:string,line_start:int,line_end:int>>")
    units = spark.createDataFrame([(k % 3, lo, lo + rng.randint(0, 9)) for k in range(40) for lo in [rng.randint(0, 60)] * 2], "build_id long, lo int, hi int")
    want = {}
    for r in located(messages, units, "build", "msg").collect():
        want.setdefault((r["build"], r["msg"]), set()).add(tuple(r["unit"]))
    got = {(r["build"], r["msg"]): r["several"] for r in several_units(messages, units, "build", "msg").collect()}
    assert got == {k: len(v) > 1 for k, v in want.items()} and set(got.values()) == {True, False}
