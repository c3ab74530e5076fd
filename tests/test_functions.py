from __future__ import annotations

import fnmatch
import hashlib
import random
import shlex
import struct

import pytest
from pyspark.sql import functions as F

from buildlens.functions import codec, text
from buildlens.operators import commands, export, store, traces, trees, validity


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_path_against_a_model(spark):
    rng = random.Random(3)
    paths = ["/".join(rng.choice(["", ".", "..", "a", "b"]) for _ in range(rng.randint(1, 5))) for _ in range(500)] + ["/", "a", "/a/../..", "./.hidden", "a//b/"]

    def model(path):
        full = path if path.startswith("/") else f"/w/d/{path}"
        out = []
        for p in full.split("/"):
            if p == "..":
                out = out[:-1]
            elif p not in ("", "."):
                out.append(p)
        return "/" + "/".join(out) + ("/" if path.endswith("/") and out else "")

    assert each(spark, paths, lambda v: text.normalize_path(v, "/w/d")) == [model(p) for p in paths]


@pytest.mark.parametrize("path,root,inside", [("/foo/bar", "/foo", True), ("/foo", "/foo", True), ("/foo/", "/foo", True), ("/foo", "/foo/", True), ("/bar", "/foo", False), ("/foobar", "/foo", False), ("/x", "/", True)])
def test_under(spark, path, root, inside):
    assert one(spark, text.under(F.lit(path), F.lit(root)))[0] is inside


def test_ancestors_and_parts(spark):
    assert one(spark, text.ancestors(F.lit("/a/b/c/")))[0] == ["/", "/a", "/a/b", "/a/b/c"]
    assert one(spark, text.ancestors(F.lit("a/b")))[0] == ["a", "a/b"]
    assert tuple(one(spark, text.parent(F.lit("/a/b")), text.parent(F.lit("/a")), text.base_name(F.lit("/a/b/")))) == ("/a", "/", "b")
    assert each(spark, ["<x>", "d/", "f"], text.node_kind) == ["virtual", "directory", "plain"]


def test_globs_against_the_standard_library(spark):
    names, patterns = ["a.c", "b.h", "x+y", "[z]", "dir/a.c", "", "a\nb", "(a)"], ["*.c", "?.h", "[ab].*", "[!a]*", "x+y", "*", "(a)", "a?b"]
    rows = spark.createDataFrame([(n, p) for n in names for p in patterns], "n string, p string")
    for r in rows.select("n", "p", text.glob_match(F.col("n"), F.col("p")).alias("m")).collect():
        assert r["m"] == fnmatch.fnmatchcase(r["n"], r["p"]), r


def test_shell_words_come_back(spark):
    words = ["plain", "with space", "it's", "", "$x", "a\\b", "semi;colon", "new\nline", '"q"']
    assert [shlex.split(w) for w in each(spark, words, text.shell_escape)] == [[w] for w in words]


def test_expand(spark):
    names = F.create_map(F.lit("in"), F.lit("a.c"), F.lit("x.y"), F.lit("dotted"))
    values = ["cc $in -o ${x.y}", "$$x $: $ y", "a$\n    b", "$unknown|${nothing}|", "tail$"]
    assert each(spark, values, lambda v: text.expand(v, names)) == ["cc a.c -o dotted", "$x :  y", "ab", "||", "tail"]
    assert each(spark, ["ok $x", "$$", "bad $!", "open ${x"], text.bad_escape) == [False, False, True, True]


def test_hashes_and_ids(spark):
    a, b = (one(spark, text.fold_hash(F.array(*map(F.lit, x))))[0] for x in (["ab", "c"], ["a", "bc"]))
    assert a != b != one(spark, text.fold_hash(F.array(F.lit("bc"), F.lit("a"))))[0]
    assert one(spark, text.content_id(F.lit("x")))[0] == hashlib.sha256(b"x").hexdigest()
    readable = one(spark, text.canonical_id(F.lit("00" * 33)))[0]
    assert readable == "0~" + "A" * 44
    assert one(spark, text.stable_id("t", F.lit("a")))[0] != one(spark, text.stable_id("u", F.lit("a")))[0]


def test_labels_and_maps(spark):
    assert each(spark, ["//a/b:c", "//a/b", "//:x", "a", "//"], lambda v: F.to_json(text.parse_label(v))) == ['{"components":["a","b"],"name":"c"}', '{"components":["a","b"],"name":"b"}', '{"components":[],"name":"x"}', None, None]
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    assert one(spark, text.merge_last_wins(m(b="1", a="1"), m(b="2")))[0] == {"a": "1", "b": "2"}
    assert one(spark, text.merge_first_wins(m(b="1"), m(b="2", c="3")))[0] == {"b": "1", "c": "3"}
    assert one(spark, store.runs_here(m(arch="x"), ["x"], "p"), store.runs_here(m(arch="x", gpu="1"), ["x"], "p"))[0:2] == (True, False)


def test_integers_and_dependencies(spark):
    data = struct.pack("<QIq", (1 << 64) - 2, 7, -5)
    got = one(spark, codec.little_endian(F.lit(data)), codec.unsigned(codec.little_endian(F.lit(data))), codec.little_endian(F.lit(data), 8, 4), codec.little_endian(F.lit(data), 12))
    assert (got[0], int(got[1]), got[2], got[3]) == (-2, (1 << 64) - 2, 7, -5)
    words = [(5, True, False), (1 << 40, False, True), (0, True, True)]
    blob = b"".join(struct.pack("<Q", k << 2 | s << 1 | o) for k, o, s in words)
    decoded = one(spark, codec.decode_dependencies(F.lit(blob)).alias("d"))["d"]
    assert [tuple(x) for x in decoded] == words
    assert bytes(one(spark, codec.encode_dependencies(codec.decode_dependencies(F.lit(blob))))[0]) == blob
    assert one(spark, codec.decode_dependencies(F.lit(b"")))[0] == [] and one(spark, codec.decode_dependencies(F.lit(b"123")))[0] is None


def test_keys_strings_and_files(spark):
    key = one(spark, codec.decode_key(codec.encode_key("N", F.lit("a\0b"))).alias("k"))["k"]
    assert (key["kind"], bytes(key["name"]), key["data"]) == ("node", b"a\0b", None)
    key = one(spark, codec.decode_key(codec.encode_key("d", F.lit("dir"), F.lit("*.o"))).alias("k"))["k"]
    assert (key["kind"], bytes(key["name"]), bytes(key["data"])) == ("filtered directory contents", b"dir", b"*.o")
    for values in ([], ["a"], ["a", "", "c d"]):
        column = F.array(*map(F.lit, values)).cast("array<string>")
        assert one(spark, codec.decode_strings(codec.encode_strings(column)))[0] == values
    info = struct.pack("<6Q32s", 1, (1 << 64) - 1, 0o100644, 9, 100, 5, b"c" * 32)
    got = one(spark, codec.decode_file_infos(F.lit(struct.pack("<I", 2) + info + info)).alias("f"))["f"]
    assert len(got) == 2 and int(got[1]["inode"]) == (1 << 64) - 1 and got[0]["size"] == 9 and bytes(got[0]["checksum"]) == b"c" * 32
    assert one(spark, codec.decode_file_infos(F.lit(struct.pack("<I", 0))))[0] == []


def info(size=0, mode=0, s=0, ns=0):
    zero = F.lit(0).cast("decimal(20,0)")
    return F.struct(zero.alias("device"), zero.alias("inode"), F.lit(mode).cast("long").alias("mode"), F.lit(size).cast("long").alias("size"), F.lit(s).cast("long").alias("mtime_s"), F.lit(ns).alias("mtime_ns"), F.lit(b"").alias("checksum"))


def test_validity(spark):
    ok = lambda *c: tuple(one(spark, *c))
    kind, gone, here, other, directory = F.lit("ExistingInput"), info(), info(5, 0o100644, 9), info(6, 0o100644, 9), info(1, 0o040755, 9)
    assert ok(validity.file_input(kind, here, here), validity.file_input(kind, here, other), validity.file_input(kind, here, gone), validity.file_input(F.lit("MissingInput"), gone, gone)) == (True, False, False, True)
    assert ok(validity.file_input(kind, here, info(5, 0o100755, 9))) == (True,)  # the mode counts for nothing
    assert ok(validity.produced_node(F.lit("FailedInput")), validity.produced_node(kind), validity.virtual_input(F.lit("VirtualInput")), validity.never()) == (False, True, True, False)
    names = F.array(F.lit("a"))
    contents = lambda k, n, now: validity.directory_contents(F.lit(k), names, here, n, now)
    assert ok(contents("DirectoryContents", names, directory), contents("DirectoryContents", F.array(F.lit("b")), directory), contents("DirectoryContents", names, here), contents("MissingInput", names, gone)) == (True, False, False, True)
    flags = lambda v: F.array(F.lit(v))
    command = lambda now, virtual=False, mutated=False, always=False: validity.external_command(F.lit("SuccessfulCommand"), F.lit(always), F.array(here), F.array(now), flags(virtual), flags(mutated))
    assert ok(command(here), command(other), command(other, mutated=True), command(gone, mutated=True), command(gone, virtual=True), command(here, always=True)) == (True, False, True, False, True, False)
    newer = lambda out, t, strict=False: validity.updated_if_newer(F.array(out), F.struct(F.lit(t).cast("long").alias("s"), F.lit(0).alias("ns")), F.lit(True), strict)
    assert ok(newer(here, 9), newer(here, 9, True), newer(here, 10), newer(gone, 1)) == (True, False, False, False)
    ninja = lambda h, g, now: validity.ninja_command(F.lit("SuccessfulCommand"), F.lit("h"), F.lit(h), F.lit(g), F.array(here), F.array(now))
    assert ok(ninja("h", False, here), ninja("x", False, here), ninja("x", True, here), ninja("h", False, gone)) == (True, False, True, False)
    assert ok(validity.make_directory(F.lit("SuccessfulCommand"), directory), validity.make_directory(F.lit("SuccessfulCommand"), here), validity.modified_outputs_allowed(F.lit("SuccessfulCommand"), F.array(other))) == (True, False, True)
    assert ok(validity.same_file(validity.checksum_only(here, F.lit(b"x")), validity.checksum_only(info(5, 0, 77), F.lit(b"x")))) == (True,)
    with pytest.raises(ValueError):
        validity.is_kind(kind, "NoSuchKind")


def test_stale_files(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    act = lambda prior, expected, roots=None: {r["path"]: r["action"] for r in commands.removals(prior, expected, roots).collect()}
    assert act(paths("a.out", "a.out"), paths("b.out")) == {"a.out": "remove"}
    roots = spark.createDataFrame([("/foo/",)], "root string")
    assert act(paths("/bar/a.out", "/foo", "/foobar.txt", "rel"), paths(), roots) == {"/bar/a.out": "skip-outside", "/foo": "remove", "/foobar.txt": "skip-outside", "rel": "skip-relative"}


def test_tree_signatures_differ(spark):
    def signature(rows, f=trees.tree_signature):
        files = spark.createDataFrame(rows, "path string, info string")
        return {r["path"]: r["signature"] for r in f(trees.with_directories(files)).collect()}

    base = signature([("/t/a", "1"), ("/t/s/b", "1")])
    inner, outer, named = signature([("/t/a", "1"), ("/t/s/b", "2")]), signature([("/t/a", "2"), ("/t/s/b", "1")]), signature([("/t/a", "1"), ("/t/s/c", "1")])
    assert len({x["/t"] for x in (base, inner, outer, named)}) == 4 and base["/t/s"] == outer["/t/s"] != inner["/t/s"]
    flat = lambda rows: signature(rows, trees.structure_signature)["/t"]
    assert flat([("/t/a", "1")]) == flat([("/t/a", "2")]) != flat([("/t/b", "1")])
    assert signature([]) == {}
    links = spark.createDataFrame([("/t/up", "/t")], "path string, target string")
    rows = spark.createDataFrame([("/t/up",), ("/t/b",), ("/t/a",)], "path string")
    assert [r["names"] for r in trees.listing(rows, links).collect()] == [["a", "b"]]


def test_store_and_rules(spark):
    objects = spark.createDataFrame([([], bytearray(b"x")), ([], bytearray(b"x")), (["r"], bytearray(b"x"))], "refs array<string>, data binary")
    empty = store.identify(objects).select("id", "refs", "data").where("false")
    full = store.put(store.put(empty, objects), objects)
    assert full.count() == 2
    wanted = full.select("id").union(spark.createDataFrame([("none",)], "id string"))
    assert sorted((bytes(r["data"]), r["found"]) for r in store.get(full, wanted).collect()) == [(b"", False), (b"x", True), (b"x", True)]
    labels = spark.createDataFrame([("//a/b/c", ["a", "b", "c"]), ("//z", ["z"]), ("//t", ["t"]), ("//r", ["r"])], "label string, components array<string>")
    prefixes = spark.createDataFrame([("a", "A"), ("a/b", "AB"), ("a/bc", "no")], "prefix string, provider string")
    got = store.resolved(labels, spark.createDataFrame([("//t", "T")], "label string, task string"), spark.createDataFrame([("//r", "R")], "label string, rule string"), prefixes)
    assert {r["label"]: (r["how"], r["by"]) for r in got.collect()} == {"//a/b/c": ("provider", "AB"), "//z": ("no-rule", None), "//t": ("task", "T"), "//r": ("rule", "R")}
    tasks = spark.createDataFrame([("c", "s", ["1"], 0, True), ("c", "s", ["1"], 1, True), ("c", "s", ["2"], 0, False)], "context string, signature string, inputs array<string>, pending int, cacheable boolean")
    assert [r["memo_key"] is None for r in store.transition_keys(tasks).collect()] == [False, True, True]


def test_processes(spark):
    events = [(1, "START", 0, "make", 0, 10, None, None), (2, "START", 1, "cc", 100, 120, None, None), (2, "EXIT", None, None, 900, 880, 0.5, 0.1), (1, "EXIT", None, None, 1000, 990, 0.1, 0.1), (2, "START", 1, "cc", 950, 960, None, None)]
    rows = traces.processes(spark.createDataFrame(events, "pid long, event string, parent long, name string, time_us long, user_us long, user_s double, sys_s double").withColumn("args", F.array(F.lit("-c"))))
    assert rows.count() == 3
    lagged = traces.with_depth(traces.with_lags(rows.where("exit_us IS NOT NULL")))
    got = {r["name"]: r for r in traces.aggregate(lagged).collect()}
    assert got["make"]["depth"] == 0 and got["cc"]["depth"] == 1 and abs(got["cc"]["wall_s"] - 0.0008) < 1e-9 and abs(got["cc"]["start_lag_s"] - 0.00002) < 1e-9
    assert {(r["name"], r["is_top"]) for r in traces.focus(lagged, "make").collect()} == {("make", True), ("cc", False)}
    assert traces.samples(lagged).count() == 2


def test_status_and_profile(spark):
    counts = spark.createDataFrame([(30, 40, 10.0)], "finished long, total long, elapsed double")
    row = traces.progress(counts)
    line = row.select(traces.status_line("[%f/%t %p%%] %q", {"finished": F.col("finished"), "total": F.col("total"), "percent": F.col("percent")})).first()[0]
    assert line == "[30/40 75%] %q" and row.first()["remaining"] == 10
    spans = spark.createDataFrame([("cc", 1, 5, 9)], "name string, lane int, begin_us long, end_us long")
    assert [r["value"] for r in traces.profile_rows(spans).orderBy("ts").collect()] == ['{"name":"cc","ph":"B","pid":0,"tid":1,"ts":5}', '{"name":"cc","ph":"E","pid":0,"tid":1,"ts":9}']
    results = spark.createDataFrame([("a", "never-built", 0), ("b", "up-to-date", 1)], "key string, reason string, round int")
    assert [(r["seq"], r["tag"], r["a1"]) for r in traces.trace_rows(results).orderBy("seq").collect()] == [(0, "checking-rule-needs-to-run", "a"), (1, "rule-needs-to-run", "a"), (2, "finished-task", "a"), (3, "checking-rule-needs-to-run", "b"), (4, "rule-does-not-need-to-run", "b")]


def test_exports(spark):
    nodes = spark.createDataFrame([('a"',), ("b",)], "key string")
    edges = spark.createDataFrame([('a"', 0, "b", True)], "key string, ordinal int, dep string, order_only boolean")
    assert [r["value"] for r in export.graphviz_text(export.graphviz(nodes, edges)).collect()] == ["digraph build {", '"a\\""', '"a\\"" -> "b" [style=dashed]', '"b"', "}"]
    made = export.random_manifest(spark, [10, 20, 5], 3)
    assert made.count() >= 25 and sorted(map(tuple, made.collect())) == sorted(map(tuple, export.random_manifest(spark, [10, 20, 5], 3).collect()))
    path = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "ordinal int, key string, w int")
    assert export.critical_path_json(path).first()[0] == '{"path":[0,1],"mapping":[{"id":0,"key":"x","w":1},{"id":1,"key":"y","w":2}]}'


def test_commands(spark):
    rows = [("c1", "shell", ["a"], ["x", "yy"], {"args": "1"}), ("c2", "shell", ["x"], ["z"], {"signature": "fixed"})]
    table = spark.createDataFrame([(*r, {}) for r in rows], "name string, tool string, inputs array<string>, outputs array<string>, attrs map<string,string>, list_attrs map<string,array<string>>")
    assert sorted(r["node"] for r in commands.default_targets(commands.outputs(table), commands.inputs(table)).collect()) == ["yy", "z"]
    signs = {r["name"]: r["s"] for r in table.select("name", commands.command_signature(table).alias("s")).collect()}
    assert signs["c2"] == "fixed" and len(signs["c1"]) == 32
    made = spark.createDataFrame([("p", "/o/d/f"), ("q", "/o/d")], "command string, node string")
    used = spark.createDataFrame([("r", "/o/d/")], "command string, node string")
    assert sorted((r["command"], r["owner"]) for r in commands.owners(made, used).collect()) == [("r", "p"), ("r", "q")]
    assert [tuple(r) for r in commands.conflicts(made).collect()] == [("/o/d", "q", "/o/d/f", "p")]
    got = one(spark, *[commands.lanes(F.lit(n), F.lit(8)) for n in (256, 1_000_000, 20, 2)])
    assert [tuple(x) for x in got] == [(8, 115), (8, 512), (5, 0), (1, 0)]
