from __future__ import annotations

import sqlite3
import struct
import time

import pytest
from pyspark.sql import functions as F

from buildlens.operators import history, nodes, tools
from buildlens.sources import build_db, build_file, text_files
from buildlens.streaming import trace_stream


def files(spark, *contents):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "file string, content string")


def test_make_dependencies(spark):
    text = "a.o: b.c \\\n  c\\ d.h e\\#f $$g x:y\n# note\nb.o c.o : d\nC:/x.o: z\n"
    rows = text_files.make_dependencies(files(spark, text))
    got = sorted((r["rule"], r["ordinal"], r["dep"]) for r in rows.collect())
    assert got == [("C:/x.o", 0, "z"), ("a.o", 0, "b.c"), ("a.o", 1, "c d.h"), ("a.o", 2, "e#f"), ("a.o", 3, "$g"), ("a.o", 4, "x:y"), ("b.o", 0, "d"), ("c.o", 0, "d")]
    assert {r["rule"] for r in text_files.make_dependencies(files(spark, text), True).collect()} == {"a.o"}
    assert [r["message"] for r in text_files.make_errors(files(spark, "a b c\n: x\nok: y\n")).orderBy("line").collect()] == ["missing ':'", "missing rule name"]


def test_dependency_info(spark):
    def parse(data):
        rows = spark.createDataFrame([("f", bytearray(data))], "file string, content binary")
        return [(r["event"], r["operand"], r["offset"]) for r in text_files.dependency_info(rows).orderBy("ordinal").collect()]

    assert parse(b"\0v1\0\x10/in\0\x11/no\0\x40/out\0") == [("version", "v1", 0), ("input", "/in", 4), ("missing", "/no", 9), ("output", "/out", 14)]
    assert parse(b"xxx") == [("error", "missing terminator", 3)] or parse(b"xxx")[-1][0] == "error"
    assert parse(b"\x10/in\0")[0] == ("error", "missing version", 0)
    assert parse(b"\0v\0\x10\0")[1] == ("error", "empty operand", 3)
    assert parse(b"\0version\0\0again\0")[1] == ("error", "duplicate version", 9)
    assert parse(b"\0v\0\x33a\0")[1][1] == "unknown operation"
    assert parse(b"")[0][0] == "error"


def test_trace(spark):
    lines = ['[', '{ "new-rule", "R1", "a\\"b" },', '{ "rule-needs-to-run", "R1", "never-built" },', "]"]
    events = text_files.trace_events(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))
    assert [tuple(r)[:4] for r in events.orderBy("seq").collect()] == [(1, "new-rule", "R1", 'a"b'), (2, "rule-needs-to-run", "R1", "never-built")]
    assert text_files.named(events).where("tag = 'rule-needs-to-run'").first()["key"] == 'a"b'


MANIFEST = """# top
cc = gcc
flags = -O2 $cc
rule CC
  command = $cc $flags $extra -c $in -o $out
  description = compile $
      $in
build a.o: CC a.c | gen.h || dirs
  extra = -g
build b$ c.o$:x | side: CC $cc/b.c d.c
build all: phony a.o
build bad: NOPE x
default all
what is this
"""


def test_manifest(spark):
    lines = text_files.manifest_lines(files(spark, MANIFEST))
    commands = {tuple(r["outputs"]): r["command"] for r in text_files.command_lines(lines).collect()}
    assert commands[("a.o",)] == "gcc -O2 gcc -g -c a.c -o a.o"
    assert commands[("b c.o:x", "side")] == "gcc -O2 gcc  -c gcc/b.c d.c -o b c.o:x side"
    builds = text_files.build_statements(lines)
    edges = {(r["key"], r["ordinal"], r["dep"], r["order_only"]) for r in text_files.manifest_edges(builds).collect()}
    assert {("a.o", 0, "a.c", False), ("a.o", 1, "gen.h", False), ("a.o", 2, "dirs", True), ("all", 0, "a.o", False), ("side", 1, "d.c", False)} <= edges
    assert [r["attrs"]["description"] for r in text_files.rules(lines).collect()] == ["compile $in"]
    assert {r["message"] for r in text_files.manifest_errors(lines).collect()} == {"no statement", "unknown rule NOPE"}


def test_snapshot(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_bytes(b"abc")
    row = text_files.snapshot(spark, str(tmp_path / "d"), checksums=True).first()
    assert row["size"] == 3 and bytes(row["checksum"]).hex().startswith("ba7816bf") and row["mtime_s"] > time.time() - 3600


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "build.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE info (id INTEGER PRIMARY KEY, version, client_version, iteration); CREATE TABLE key_names (id INTEGER PRIMARY KEY, key STRING UNIQUE); CREATE TABLE rule_results (key_id INTEGER PRIMARY KEY, value BLOB, signature INTEGER, built_at INTEGER, computed_at INTEGER, start REAL, end REAL, dependencies BLOB)")
    db.execute("INSERT INTO info VALUES (0, 17, 9, 3)")
    db.executemany("INSERT INTO key_names VALUES (?, ?)", [(1, "A"), (2, "123"), (3, b"n\0ul")])
    blob = struct.pack("<2Q", 1 << 2, 2 << 2 | 1)
    db.executemany("INSERT INTO rule_results VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(1, b"v", 5, 1, 1, 0.5, 2.0, b""), (3, b"w", -6, 3, 2, 1.0, 1.5, blob)])
    db.commit()
    db.close()
    return path


def test_build_database(spark, database, tmp_path):
    names, results = build_db.read(spark, database, "key_names"), build_db.read(spark, database, "rule_results", 9)
    assert sorted(bytes(r["key"]) for r in names.collect()) == [b"123", b"A", b"n\0ul"]
    dump = {bytes(r["key"]): r["duration"] for r in history.dump(names, results).collect()}
    assert dump == {b"A": 1.5, b"n\0ul": 0.5}
    deps = history.resolved(history.dependencies(results), names)
    assert [(r["ordinal"], bytes(r["dep"]), r["order_only"]) for r in deps.orderBy("ordinal").collect()] == [(0, b"A", False), (1, b"123", True)]
    assert build_db.read(spark, database, "info").first()["iteration"] == 3
    for path, version in ((str(tmp_path / "none.db"), None), (str(tmp_path), None), (database, 8)):
        with pytest.raises(Exception):
            build_db.read(spark, path, "info", version).collect()


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def events(spark, folder):
    rows = [("2024-01-01 00:00:01", 1, "begin", "a"), ("2024-01-01 00:00:05", 1, "end", "a"), ("2024-01-01 00:00:09", 2, "begin", "b"), ("2024-01-01 03:00:00", 2, "end", "c")]
    spark.createDataFrame(rows, "ts string, lane long, tag string, name string").select(F.col("ts").cast("timestamp").alias("ts"), "lane", "tag", "name").coalesce(1).write.json(folder)
    return trace_stream.read_events(spark, folder)


def test_stream_of_counters_and_sessions(spark, tmp_path):
    stream = events(spark, str(tmp_path / "e"))
    counts = run(trace_stream.windowed_counters(stream, {"begun": "begin", "ended": "end"}), spark, "counts", "complete")
    assert sorted((r["lane"], r["begun"], r["ended"]) for r in counts.collect()) == [(1, 1, 1), (2, 0, 1), (2, 1, 0)]
    found = run(trace_stream.sessions(stream), spark, "sessions", "complete")
    assert sorted((r["lane"], r["events"]) for r in found.collect()) == [(1, 2), (2, 1), (2, 1)]


def test_stream_of_pairs(spark, tmp_path):
    rows = run(trace_stream.paired(events(spark, str(tmp_path / "e"))), spark, "pairs").collect()
    assert [(r["lane"], r["name"], (r["end"] - r["begin"]).total_seconds()) for r in rows] == [(1, "a", 4.0)]


def test_stream_of_latest_results(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "latest")
    spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "x")], "key string, epoch long, value string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("key string, epoch long, value string").json(source)
    trace_stream.keep_latest(stream, folder, ["key"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["key"], r["value"]) for r in spark.read.parquet(f"{folder}/0").collect()) == [("k", "new"), ("m", "x")]


YAML = """client:
  name: basic
targets:
  all: ["<all>", out]
default: all
nodes:
  dir/:
    content-exclusion-patterns: ["*.o"]
  "<all>": {}
  st: {type: directory-structure, is-mutated: true}
commands:
  cc:
    tool: shell
    inputs: [a.c]
    outputs: [out]
    args: cc a.c
  odd:
    inputs: [x]
"""


def test_build_file(spark):
    rows = build_file.entities(files(spark, YAML, "targets: {}\nclient: {name: x}\nnoise: 1\n", "[1", "a: b")).cache()
    command = build_file.commands(rows).collect()
    assert [(c["name"], c["tool"], c["inputs"], c["outputs"], c["attrs"]) for c in command] == [("cc", "shell", ["a.c"], ["out"], {"args": "cc a.c"})]
    assert [tuple(r) for r in build_file.targets(rows).collect()] == [("all", "<all>", 0), ("all", "out", 1)]
    assert {r["name"]: (r["kind"], r["mutated"], r["exclusion_patterns"]) for r in build_file.nodes(rows).collect()} == {"dir/": ("directory", False, ["*.o"]), "<all>": ("virtual", False, []), "st": ("structure", True, [])}
    found = {r["error"] for r in build_file.errors(rows).collect()}
    assert {"command odd doesn't begin with its tool", "section client out of order", "unknown section noise", "unknown section a"} <= found and any(e.startswith("no YAML") for e in found)


def test_tools(spark):
    rows = build_file.entities(files(spark, YAML))
    base = build_file.commands(rows).select(tools.signature(build_file.commands(rows)).alias("s")).first()["s"]
    other = build_file.commands(build_file.entities(files(spark, YAML.replace("cc a.c", "cc -g a.c"))))
    assert base != other.select(tools.signature(other).alias("s")).first()["s"]
    assert [r["dep"] for r in tools.discovered(files(spark, "o: a b\np: c\n"), "makefile-ignoring-subsequent-outputs").collect()] == ["a", "b"]
    binary = spark.createDataFrame([("f", bytearray(b"\0v\0\x10a\0"))], "file string, content binary")
    assert [r["dep"] for r in tools.discovered(binary, "dependency-info").collect()] == ["a"]
    with pytest.raises(ValueError):
        tools.discovered(binary, "unknown")


def test_node_values(spark):
    snapshot = spark.createDataFrame([("/a", 1, 1, 0o100644, 5, 9, 0, None), ("/d", 1, 2, 0o040755, 1, 9, 0, None)], "path string, device long, inode long, mode long, size long, mtime_s long, mtime_ns int, checksum binary")
    asked = spark.createDataFrame([("/a", "plain"), ("/d/", "directory"), ("/no", "plain"), ("<v>", "virtual")], "node string, kind string")
    values = nodes.input_values(asked, snapshot)
    assert {r["node"]: r["value"] for r in values.collect()} == {"/a": "ExistingInput", "/d/": "ExistingInput", "/no": "MissingInput", "<v>": "VirtualInput"}
    listing = spark.createDataFrame([("/d", ["x"])], "directory string, names array<string>")
    assert {r["node"]: (r["value"], r["names"]) for r in nodes.contents_values(asked.where("kind <> 'virtual'"), snapshot, listing).collect()} == {"/a": ("ExistingInput", None), "/d/": ("DirectoryContents", ["x"]), "/no": ("MissingInput", None)}
    targets = spark.createDataFrame([("t", "/a"), ("t", "/d/"), ("u", "/no"), ("u", "/a")], "target string, node string")
    assert {r["target"]: (r["value"], r["missing"]) for r in nodes.target_values(targets, values).collect()} == {"t": ("Target", 0), "u": ("Invalid", 1)}
    inputs = spark.createDataFrame([("c", "/a"), ("d", "/no")], "command string, node string")
    outcomes = spark.createDataFrame([("c", True, None), ("e", False, None)], "command string, ok boolean, signature string")
    own = spark.createDataFrame([("c",), ("d",), ("e",)], "command string")
    assert {r["command"]: r["value"] for r in nodes.command_values(own, inputs, values, outcomes).collect()} == {"c": "SuccessfulCommand", "d": "PropagatedFailureCommand", "e": "FailedCommand"}
    results = spark.createDataFrame([("k", "1"), ("b", "2"), ("a", "3")], "key string, value string")
    edges = spark.createDataFrame([("k", "b"), ("k", "a")], "key string, dep string")
    assert [(r["dep"], r["dep_value"]) for r in nodes.with_dependencies(results, edges, "k").collect()] == [("a", "3"), ("b", "2")]


def test_manifest_line_of_very_many_inputs(spark):
    """Long lines and words are walked without a call for each character."""
    inputs = " ".join(f"dir/file{i}.o" for i in range(100_000))
    text = f"rule link\n  command = ld $in -o $out\nbuild app: link {inputs} | {'x' * 300_000} || {inputs[:2000].rstrip()}\n"
    row = text_files.build_statements(text_files.manifest_lines(files(spark, text))).first()
    assert len(row["inputs"]) == 100_000 and len(row["implicit"][0]) == 300_000 and row["outputs"] == ["app"]
    deps = text_files.make_dependencies(files(spark, f"a.o: {inputs} {'y' * 300_000}\n"))
    assert deps.count() == 100_001
    line = '{ "new-rule", "R1", "' + "k" * 300_000 + '" },'
    assert len(text_files.trace_events(spark.createDataFrame([(0, line)], "seq long, value string")).first()["a2"]) == 300_000


def test_paths_are_expanded_when_they_are_read(spark):
    text = "x = a\nrule cc\n  command = cc $x $in\nbuild $x: cc in_$x\n  flag = $x\nx = b\nbuild $x: cc in_$x\ny = $x$x\nx = c\nbuild $y: cc\n"
    lines = text_files.manifest_lines(files(spark, text))
    rows = sorted((r["outputs"], r["inputs"], r["attrs"]) for r in text_files.build_statements(lines).collect())
    assert rows == [(["a"], ["in_a"], {"flag": "a"}), (["b"], ["in_b"], {}), (["bb"], [], {})]
    assert sorted(r["command"] for r in text_files.command_lines(lines).collect()) == ["cc a in_a", "cc b in_b", "cc c "]


def test_included_files_and_child_scopes(spark):
    parts = {
        "main": "x = 1\nrule cc\n  command = cc $x $in\ninclude common\nbuild a$x: cc a.c\nsubninja child\nx = 3\nbuild b$x: cc b.c\n",
        "common": "x = 2\nbuild c$x: cc c.c\n",
        "child": "build d$x: cc d.c\n  flag = $x\nx = 9\nbuild e$x: cc e.c\ninclude common\n",
    }
    rows = spark.createDataFrame(list(parts.items()), "file string, content string")
    lines = text_files.joined_files(text_files.manifest_lines(rows), "main")
    got = {r["outputs"][0]: r["command"] for r in text_files.command_lines(lines).collect()}
    assert got == {"c2": "cc 2 c.c", "a2": "cc 2 a.c", "b3": "cc 3 b.c", "d2": "cc 2 d.c", "e9": "cc 9 e.c"}
    assert sorted(r["outputs"][0] for r in text_files.build_statements(lines).collect()) == ["a2", "b3", "c2", "c2", "d2", "e9"]
    with pytest.raises(ValueError, match="no such file: none"):
        text_files.joined_files(text_files.manifest_lines(files(spark, "include none\n")), "0")
    with pytest.raises(ValueError, match="more than 4 times"):
        text_files.joined_files(text_files.manifest_lines(files(spark, "include 0\n")), "0", 4)
