import pytest
from pyspark.sql import functions as F

from pathloom.functions import text as T
from pathloom.operators import index as I
from pathloom.operators import maintain as M
from pathloom.operators import retrieve as R
from pathloom.operators import search as S
from pathloom.plans.cache import LruCache


def table(spark, *names, workspace="demo"):
    rows = [(i, workspace, "directory" if n.endswith("/") else "file", n.rstrip("/")) for i, n in enumerate(names)]
    return T.with_normal(spark.createDataFrame(rows, "seq long, workspace string, kind string, relative_path string"))


def plain_score(path, name, ws, q):
    """The ladder in plain Python."""
    if path == q:
        return 10000.0
    if path.startswith(q):
        return 9000.0 - len(path)
    if name == q:
        return 8500.0
    if name.startswith(q):
        return 8000.0 - len(name)
    whole = ws + "/" + path
    for text, part, top in ((path, "/" + q, 7500.0), (path, q, 7000.0)):
        if part in text:
            return top - text.index(part) - len(text) * 0.1
    if q in whole:
        return 10000.0 if whole == q else 6500.0 - whole.index(q) - len(whole) * 0.1
    at, last, score = 0, -2, 0.0
    for ch in q:
        i = whole.find(ch, at)
        if i < 0:
            return None
        score += (24 if i == last + 1 else 6) + (35 if i == 0 or whole[i - 1] == "/" else 0)
        last, at = i, i + 1
    return score - len(whole) * 0.15


@pytest.mark.parametrize("q", ["src/components/button.tsx", "src", "button.tsx", "but", "comp", "ton", "demo/src", "sctbtn", "zzz", "o/s"])
def test_ladder(spark, q):
    paths = table(spark, "src/components/Button.tsx", "packages/src/components-old/", "README.md", "源码/入口.ts", "src/")
    got = {r["relative_path"]: r["score"] for r in S.scored(paths, q).collect()}
    want = {r["relative_path"]: plain_score(r["norm_path"], r["norm_name"], "demo", q) for r in paths.collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_typed():
    assert T.parse_typed("abc/bcd/cd") == T.Typed("abc/bcd", "cd")
    assert T.parse_typed("abc/") == T.Typed("abc", "")
    assert T.parse_typed("//src/components/but") == T.Typed("", "src/components/but", True)
    assert [T.parent_typed(x) for x in ("abc/bcd/query", "abc/bcd/", "abc/query", "query")] == ["abc/", "abc/", "", ""]
    assert T.suffix_list(["log", ".MAP", " ", ".test.ts", "log"]) == [".log", ".map", ".test.ts"]
    assert T.normal_query(".\\Src  A") == T.normal_query(".\\src a").replace(" ", "")


def test_pools(spark):
    one = table(spark, "src/main.py", "src/domain.py", "src/readme.md")
    assert [r["relative_path"] for r in S.search(one, S.Request(T.Typed("", "m"))).collect()] == ["src/main.py"]
    two = table(spark, "src/file.ts", "src/final.ts", "src/profile.ts")
    assert {r["relative_path"] for r in S.search(two, S.Request(T.Typed("", "il"))).collect()} == {"src/file.ts", "src/profile.ts"}


def test_postings_and_suffix(spark):
    paths = table(spark, "abc/bcd/cde/", "x/cde/", "src/components/Button.tsx", "src/components/")
    assert [r["relative_path"] for r in R.directory_by_suffix(paths, "bcd/cde").collect()] == ["abc/bcd/cde"]
    assert R.directory_by_suffix(paths, "cde").count() == 0
    assert "src/components/Button.tsx" in {r["relative_path"] for r in R.all_segments(paths, "s/co/bu").collect()}


def test_index_and_removal(spark):
    paths = table(spark, "src/Foo.ts", "src/foo.ts", "src/", "src/a/", "srcs/x.ts", "src/Foo.ts")
    assert I.first_of_equal(paths).count() == 5
    assert {r["relative_path"] for r in M.remove_subtree(paths, "demo", "src").collect()} == {"srcs/x.ts"}
    two = paths.unionByName(table(spark, "src/", "src/a.ts", workspace="other"))
    left = {(r["workspace"], r["relative_path"]) for r in M.discard(two, ("other", "SRC")).collect()}
    assert left == {("demo", r["relative_path"]) for r in paths.collect()}
    assert [r["workspace"] for r in I.by_path(two, "SRC").orderBy("workspace").collect()] == ["demo", "other"]
    assert I.by_identity(two, "other", "file", "src").isEmpty() and I.by_path(paths, "SRC/foo.TS").first()["relative_path"] == "src/Foo.ts"
    assert I.counters(two).where("workspace = 'other'").first()[1:] == (1, 1, 2)


ROW = "seq long, workspace string, kind string, relative_path string"
CHANGE = "seq long, change string, workspace string, kind string, relative_path string"


def entries(df):
    return {(r["workspace"], r["kind"], r["relative_path"]) for r in df.collect()}


def test_changes(spark):
    live = spark.createDataFrame([(1, "w", "directory", "a"), (2, "w", "file", "a/x"), (3, "w", "file", "a/y"), (4, "w", "file", "b/Z"), (5, "v", "directory", "a"), (6, "v", "file", "a/x")], ROW)
    log = [(1, "create", "w", "file", "a/new"), (2, "delete", "w", None, "A"), (3, "create", "w", "file", "b/z"), (4, "delete", "w", None, "c"), (5, "create", "w", "file", "c"), (6, "create", "w", "file", "n/B"), (7, "create", "w", "file", "n/b"), (8, "delete", "v", None, ""), (9, "delete", None, None, "a")]
    after = M.apply_changes(live, spark.createDataFrame(log, CHANGE))
    # the later spelling takes the place of the earlier, and workspaces are apart
    assert entries(after) == {("w", "file", "b/z"), ("w", "file", "a/new"), ("w", "file", "c"), ("w", "file", "n/b"), ("v", "directory", "a"), ("v", "file", "a/x")}
    assert after.groupBy("seq").count().where("count > 1").isEmpty()
    assert M.apply_changes(live, spark.createDataFrame(log, CHANGE), most=2) is None
    assert entries(M.apply_changes(live, spark.createDataFrame(log, CHANGE), most=2, rebuild=lambda: live)) == entries(live)
    assert entries(M.apply_changes(live.limit(0), spark.createDataFrame([], CHANGE))) == set()


def test_create_among_case_variants(spark):
    live = spark.createDataFrame([(1, "w", "file", "Foo"), (2, "w", "file", "foo"), (3, "w", "directory", "d"), (4, "w", "file", "d/x")], ROW)

    def after(*log, **more):
        return {e[1:] for e in entries(M.apply_changes(live, spark.createDataFrame([(i, c, "w", k, p) for i, (c, k, p) in enumerate(log)], CHANGE), **more))}

    rest = {("directory", "d"), ("file", "d/x")}
    assert after(("create", "file", "FOO")) == rest | {("file", "foo")}  # takes Foo away, and is not added beside foo
    assert after(("delete", None, "foo"), ("delete", None, "FOO")) == rest
    assert after(("create", "file", "D")) == {("file", "Foo"), ("file", "foo"), ("file", "D")}
    there = spark.createDataFrame([(1, "w", "directory", "D"), (2, "w", "directory", "D/e"), (3, "w", "file", "D/e/f"), (4, "w", "file", "q"), (5, "v", "file", "D/z")], ROW)
    assert after(("create", "directory", "D"), listing=there) == {("file", "Foo"), ("file", "foo"), ("directory", "D"), ("directory", "D/e"), ("file", "D/e/f")}
    assert len(after(("create", "file", "p1"), ("create", "file", "p2"), entries_most=5)) == 5


def test_scope(spark):
    live = spark.createDataFrame([(1, "w", "directory", "a"), (2, "w", "file", "a/X")], ROW)
    there = spark.createDataFrame([(1, "w", "directory", "a"), (2, "w", "file", "a/x"), (3, "w", "file", "a/y"), (4, "w", "file", "ab"), (5, "v", "file", "a/y")], ROW)
    assert entries(M.add_scope(live, there, "w", "A/")) == entries(live) | {("w", "file", "a/y")}


def test_snapshot(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "snap")
    prints = {w: I.Settings().fingerprint(w) for w in ("v", "w")}
    rows = spark.createDataFrame([(i, w, "file", p) for w in ("v", "w") for i, p in enumerate(["源码/入口.ts", "a/b", "a/c"])], ROW)
    M.save(rows, where, prints, at_ms=1000)
    got, missing = M.load(spark, where, prints)
    assert entries(got) == entries(rows) and not missing
    assert M.load(spark, where, {"w": "other"})[1] == ["w"] and M.load(spark, where, prints, now_ms=3000, age_most_ms=1000)[1] == ["v", "w"]
    # only one workspace gets a new version
    fewer = got.where("relative_path <> 'a/b'")
    assert sorted(M.dirty(got, fewer.where("workspace = 'w'").unionByName(got.where("workspace = 'v'")))) == ["w"]
    M.save(fewer, where, {"w": prints["w"]}, batch=3)
    now = M.manifest(spark, where)
    assert {w: (m["version"], m["size"], m["capacity"]) for w, m in now["workspaces"].items()} == {"v": (1, 3, 3), "w": (2, 2, 2)} and now["batch"] == 3  # numbered anew
    # a crash before the manifest leaves what was in force
    with monkeypatch.context() as m:
        m.setattr(M.store, "put", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            M.save(rows.limit(0), where, prints)
    assert len(entries(M.load(spark, where, prints)[0])) == 5
    for _ in range(2):
        M.save(rows, where, prints)
    assert len([n for n in M.store.names(spark, f"{where}/{M.folder('w')}") if n.startswith("v")]) == 2  # older ones went
    M.save(rows.limit(0), where, {}, drop=["v"])
    assert M.load(spark, where, prints)[1] == ["v"]


def test_stream(spark, tmp_path):
    from pathloom.streaming.changes import keep_up

    where, log = str(tmp_path / "snap"), str(tmp_path / "log")
    prints = {"v": "f", "w": "f"}
    tree = spark.createDataFrame([(1, "v", "file", "a.ts"), (2, "w", "directory", "b"), (3, "w", "file", "b/d")], ROW)
    rebuilt = []

    def rebuild(workspace):
        rebuilt.append(workspace)
        return tree.where(F.col("workspace") == workspace)

    def run(rows, mode="append"):
        spark.createDataFrame(rows, CHANGE).write.mode(mode).json(log)
        keep_up(spark.readStream.schema(CHANGE).json(log), where, prints, rebuild, most=3).awaitTermination(60)
        return entries(M.load(spark, where, prints)[0])

    # without a snapshot all is made from what is there
    assert run([(1, "create", "w", "file", "n")]) == entries(tree) and sorted(rebuilt) == ["v", "w"]
    assert run([(2, "delete", "w", None, "B"), (3, "create", "w", "file", "n"), (4, "create", "x", "file", "n")]) == {("v", "file", "a.ts"), ("w", "file", "n")}
    versions = {w: m["version"] for w, m in M.manifest(spark, where)["workspaces"].items()}
    assert versions == {"v": 1, "w": 2}
    # replayed batches change nothing
    batch = M.manifest(spark, where)["batch"]
    keep_up(spark.readStream.schema(CHANGE).json(log), where, prints, rebuild).awaitTermination(60)
    assert M.manifest(spark, where)["batch"] == batch
    # too many changes: what they touch is made anew
    assert run([(10 + i, "create", "w", "file", f"m{i}") for i in range(5)]) == entries(tree) and rebuilt[-1] == "w"


def test_history_store(spark, tmp_path):
    from pathloom.operators import history as H

    where = str(tmp_path / "history")
    assert H.kept(spark, where).count() == 0
    rows = spark.createDataFrame([("w", "file", "a", 5, 1, None), ("w", "socket", "a", 5, 1, True), ("w", "file", None, 5, 1, True), ("v", "directory", "a", None, 1, True)], H.HISTORY)
    H.keep(rows, where)
    assert [tuple(r) for r in H.kept(spark, where).collect()] == [("w", "file", "a", 5, 1, None)]
    H.keep(H.kept(spark, where).limit(0), where)
    assert H.kept(spark, where).count() == 0


def test_search_history(spark):
    """History of another workspace, of another case, of another kind; chosen for the query; and entries that are gone."""
    from pathloom.operators import history as H

    paths = table(spark, "src/a.ts", "src/b.ts", "src/").unionByName(table(spark, "src/a.ts", workspace="other"))
    one = lambda *rows: spark.createDataFrame(rows, H.HISTORY)
    score = lambda h, **o: {(r["workspace"], r["relative_path"]): r["score"] for r in S.search(paths, S.Request(T.Typed("", "a.ts"), now_ms=0, **o), h).collect()}
    assert score(one(("other", "file", "src/a.ts", 0, 1, None))) == {("demo", "src/a.ts"): 8500.0, ("other", "src/a.ts"): 8500.0 + 40 + 120}
    assert score(one(("demo", "file", "SRC/a.ts", 0, 1, None)))["demo", "src/a.ts"] == 8660.0
    assert score(one(("demo", "directory", "src/a.ts", 0, 1, None)))["demo", "src/a.ts"] == 8500.0
    assert score(one(("demo", "file", "SRC/a.ts", 0, 1, None), ("demo", "file", "src/a.ts", 0, 3, None)))["demo", "src/a.ts"] == 8700.0
    gone = one(("demo", "file", "old/a.ts", 0, 1, None))
    assert ("demo", "old/a.ts") not in score(gone) and score(gone, keep_missing=True)["demo", "old/a.ts"] == 8660.0
    assert ("demo", "old/a.ts") not in score(gone, keep_missing=True, workspace="other")
    log = spark.createDataFrame([("A.TS ", "demo", "file", "src/a.ts", 1), ("a.ts", "demo", "file", "src/a.ts", 2), ("a", "demo", "file", "src/a.ts", 3)], "query string, workspace string, kind string, relative_path string, at_ms long")
    chosen = H.choices(log)
    assert [tuple(r) for r in chosen.collect()] == [("a.ts", "demo", "file", "src/a.ts", 2, 2)]
    h = H.with_affinity(one(("demo", "file", "src/a.ts", 0, 1, None)), chosen, "a.ts")
    assert abs(score(h)["demo", "src/a.ts"] - (8660 + 1901.955001)) < 1e-6
    assert [tuple(r) for r in H.newest(one(("w", "file", "a", 9, 1, None), ("w", "file", "b", 1, 1, True)), 1).collect()][0][2] == "b"
    # a query of a character looks at names that begin with it, but at all of history
    hit = S.search(table(spark, "src/domain.py", "src/main.py"), S.Request(T.Typed("", "m")), one(("demo", "file", "src/domain.py", 0, 1, None)))
    assert {r["relative_path"] for r in hit.collect()} == {"src/domain.py", "src/main.py"}


def test_budget(spark):
    three = table(spark, "a/file-1.ts", "a/file-2.ts", "a/file-3.ts")
    request = S.Request(T.Typed("", "file"), most=1)
    assert S.search(three, request).count() == 1 and tuple(S.progress(three, request).first()) == (1, True)
    assert tuple(S.progress(three, S.Request(T.Typed("", "file"), most=3)).first()) == (3, False)
    many = table(spark, *(f"src/target-{i}.ts" for i in range(100)), "src/target.ts")
    assert [r["relative_path"] for r in S.search(many, S.Request(T.Typed("", "target.ts"), most=1)).collect()] == ["src/target.ts"]
    assert R.most_candidates("a", 10_000) == 2_000 and R.most_candidates("ab", 10_000) == 5_000 and R.most_candidates("abc", -1) == 0
    # pools: names with the rarest pairs come before those with the rarest alone, and these before the rest
    names = table(spark, "xab", "xabcz", "qbc", "zz", "ab/cd")
    got = {r["relative_path"]: r["pool"] for r in R.pooled(names, names, "abc").collect()}
    assert got == {"xab": 4, "xabcz": 3, "qbc": 5, "zz": 5, "ab/cd": 5}  # ab is as rare as bc and stands first
    whole = {r["relative_path"]: r["pool"] for r in R.pooled(names, names, "cd", "ab/cd").collect()}
    assert whole == {"ab/cd": 1}


def test_plan(spark):
    paths = table(spark, "x/src/a/", "y/Src/", "x/src/", "x/", "abc/bcd/cde/", "abc/BCD/cde/").unionByName(table(spark, "k/", "x/src/a/", workspace="other"))
    plan = lambda text, **o: S.plan_request(paths, text, **o)
    assert (plan("x\\src", workspace="demo").typed, plan("y/src").workspace) == (T.Typed("x/src", ""), "demo")
    assert plan("x/src/a").typed == T.Typed("x/src", "a")  # in two workspaces
    assert plan("abc/bcd/cde").typed == T.Typed("abc/bcd/cde", "")  # one a workspace, that of exact case first
    assert plan("bcd/cde").typed.everywhere  # two that end so
    assert plan("nope/x").typed == T.Typed("", "nope/x", True) and plan("k/q").typed == T.Typed("k", "q")


def test_tree(spark, tmp_path):
    import os

    from pathloom.sources.tree import TreeSource

    for d in ("src/nested/deep/er", "empty", "node_modules/x"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "src/nested/deep.ts").write_text("")
    (tmp_path / "src/a.log").write_text("")
    os.symlink(tmp_path / "src", tmp_path / "link")
    spark.dataSource.register(TreeSource)
    read = lambda **o: {tuple(r) for r in spark.read.format("path_tree").options(root=str(tmp_path), exclude="node_modules", suffixes="LOG", **o).load().collect()}
    every = {("src", "directory", False), ("empty", "directory", False), ("link", "directory", False), ("src/nested", "directory", False), ("src/nested/deep.ts", "file", False), ("src/nested/deep", "directory", False), ("src/nested/deep/er", "directory", False)}
    assert read() == every == read(split="0") == read(split="5")
    assert read(depth="2") == {("src", "directory", False), ("empty", "directory", False), ("link", "directory", False), ("src/nested", "directory", True)}
    assert read(below="src/nested") == {r for r in every if r[0].startswith("src/nested/")}
    assert read(below="gone") == {("gone", "unreadable", False)}


def test_grown(spark):
    from pathloom.plans.cache import Searcher, same_order, with_active

    paths = table(spark, *(f"d{i % 7}/file{i}.ts" for i in range(100)))
    searcher = Searcher(paths, 1)
    for text in ("fi", "fil", "file1", "file12", "file1", "d3"):
        request = S.Request(T.Typed("", text))
        assert [tuple(r) for r in searcher(request)] == [tuple(r) for r in S.search(paths, request).collect()]
    assert searcher.reused == 2 and len(searcher.kept.items) == 5
    assert [tuple(r) for r in searcher(S.Request(T.Typed("d1", "file1")))] == [tuple(r) for r in S.search(paths, S.Request(T.Typed("d1", "file1"))).collect()]
    searcher.forget()
    rows = [{"workspace": "w", "kind": "file", "relative_path": p} for p in "abc"]
    assert with_active(rows, rows[2], 2) == [rows[0], rows[2]] and with_active(rows[:1], rows[2], 2) == [rows[0], rows[2]]
    assert with_active(rows, rows[0], 2) == rows[:2] == with_active(rows, None, 2) and with_active(rows, rows[0], 0) == []
    assert same_order(rows, list(rows)) and not same_order(rows, rows[::-1])


def test_settings():
    a, b = I.Settings(excluded_names=("x", "y")), I.Settings(excluded_names=("Y", "x"))
    assert a.fingerprint("w") == b.fingerprint("w") != a.fingerprint("v") and I.Settings(most=1).fingerprint("w") != I.Settings().fingerprint("w")


def test_text_columns(spark):
    uris = spark.createDataFrame([("file:///w/a/b.ts", "file:///w/"), ("file:///w/a/", "file:///w"), ("http:///w/a", "file:///w"), ("file:///wx/a", "file:///w"), (None, "file:///w")], "u string, r string")
    assert [r[0] for r in uris.select(T.relative_to(F.col("u"), F.col("r"))).collect()] == ["a/b.ts", "a", None, None, None]
    one = spark.createDataFrame([("a/b", "w"), ("b", "w")], "p string, w string")
    assert [tuple(r) for r in one.select(*(T.shown(F.col("p"), F.col("w"), d, s) for d in ("parent", "full", "hidden") for s in (False, True))).collect()] == [("a", "w \u00b7 a", "a/b", "w \u00b7 a/b", None, "w"), ("./", "w \u00b7 ./", "b", "w \u00b7 b", None, "w")]
    odd = [".\\Src  A", "a\u00a0b", "./x", "././x"]
    got = spark.createDataFrame([(x,) for x in odd], "q string").select(T.normal_query_column(F.col("q"))).collect()
    assert [r[0] for r in got] == [T.normal_query(x) for x in odd]


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    got = I.numbered(rows, ["g"], ["seq"], "n").collect()
    for g in ("a", "b", None):
        mine = sorted((r["seq"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert I.numbered(rows.limit(0), [], ["seq"], "n").count() == 0


def test_lru():
    c = LruCache(2)
    c.put(1, "a"), c.put(2, "b"), c.get(1), c.put(3, "c")
    assert c.get(2) is None and c.get(1) == "a"
    none = LruCache(0)
    none.put(1, 1)
    assert none.get(1) is None


def test_top_k(spark):
    paths = table(spark, *(f"d{i % 7}/file{i}.ts" for i in range(100)))
    every = S.rank_paths(paths, "file", 1000).collect()
    assert [tuple(r) for r in S.rank_paths(paths, "file", 25).collect()] == [tuple(r) for r in every[:25]]
    assert S.rank_paths(paths, "file", 0).count() == 0
    assert S.top(S.scored(paths, "").withColumn("score", F.lit(1.0)), 3).count() == 3


def test_toggle_pin(spark):
    from pathloom.operators import history as H

    log = spark.createDataFrame([("w", "file", "a", 5, 1, True, 3), ("w", "file", "b", 7, 2, None, None), ("v", "file", "b", 7, 2, None, None)], H.HISTORY + ", affinity long")
    got = lambda df: {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    assert got(H.toggle_pin(log, "w", "file", "b")) == {("w", "file", "a"): (5, 1, True, 3), ("w", "file", "b"): (7, 2, True, None), ("v", "file", "b"): (7, 2, None, None)}
    assert got(H.toggle_pin(log, "w", "file", "a"))["w", "file", "a"] == (5, 1, False, 3)
    assert got(H.toggle_pin(log, "w", "directory", "a"))["w", "directory", "a"] == (0, 0, True, None)
    assert got(H.toggle_pin(log.limit(0), "w", "file", "c")) == {("w", "file", "c"): (0, 0, True, None)}


def test_suffix_queries(spark, monkeypatch):
    import duckdb

    from pathloom.operators import retrieve as R
    from pathloom.plans import queries as Q

    where = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{where}/part.parquet'")
    got = {n: [r[0] for r in Q.QUERIES[n](spark, where).collect()] for n in ("suffix_match_one", "suffix_match_several")}
    assert got == {n: [r[0] for r in duckdb.sql(Q.SQL[n]).fetchall()] for n in got}
    assert len(got["suffix_match_one"]) == 1 and not got["suffix_match_several"]
    # an operator that never sees ambiguity is told apart
    monkeypatch.setattr(R, "directory_by_suffix", lambda paths, q: paths.where((F.col("kind") == "directory") & F.col("norm_path").endswith("/" + q)))
    assert Q.QUERIES["suffix_match_several"](spark, where).count() > 1
