"""Incremental scenarios: the values, and which keys ran."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from buildlens import schema
from buildlens.operators import graph, history, incremental
from buildlens.operators.incremental import Cycle


class World:
    """Rules that multiply their inputs with a factor; leaves have values of their own."""

    def __init__(self, spark, rules: dict[str, tuple[int, list]], leaves: dict[str, int]):
        self.spark, self.rules, self.leaves = spark, rules, dict(leaves)
        self.signatures = dict.fromkeys([*rules, *leaves], "s")
        self.prior: dict[str, tuple] = {}
        self.seen: dict[str, int] = {}
        self.epoch = 0

    def frame(self, rows, ddl):
        return self.spark.createDataFrame(rows, ddl)

    def build(self, *goals):
        self.epoch += 1
        factor = {k: f for k, (f, _) in self.rules.items()}
        leaves, spark = self.leaves, self.spark

        def compute(run):
            def step(pdf: pd.DataFrame) -> pd.DataFrame:
                out = []
                for row in pdf.itertuples():
                    value = leaves.get(row.key, factor.get(row.key, 1))
                    for i in row.inputs:
                        value *= int(i["value"]) if row.key not in leaves else 1
                    out.append((row.key, str(value)))
                return pd.DataFrame(out, columns=["key", "value"])

            return run.groupBy("key").agg(F.first("inputs").alias("inputs")).mapInPandas(lambda it: map(step, it), "key string, value string")

        edges = [(k, n, d if isinstance(d, str) else d[0], not isinstance(d, str) and d[1] == "order", not isinstance(d, str) and d[1] == "once") for k, (_, deps) in self.rules.items() for n, d in enumerate(deps)]
        prior = [(k, *v) for k, v in self.prior.items()]
        valid = [(k, self.seen.get(k) == v) for k, v in self.leaves.items()]
        out = incremental.build(
            self.frame([(g,) for g in goals], "key string"),
            self.frame(list(self.signatures.items()), schema.RULES),
            self.frame(prior, schema.PRIOR),
            self.frame(edges, schema.KEY_EDGES),
            self.frame(valid, schema.VALID),
            compute,
            self.epoch,
        ).collect()
        for r in out:
            if r["reason"] != "up-to-date":
                self.prior[r["key"]] = (r["value"], r["signature"], r["built_at"], r["computed_at"])
                if r["key"] in self.leaves:
                    self.seen[r["key"]] = self.leaves[r["key"]]
        return {r["key"]: r for r in out}

    def ran(self, *goals):
        return {k for k, r in self.build(*goals).items() if r["reason"] != "up-to-date"}


def arithmetic(spark):
    return World(spark, {"C": (5, ["A", "B"]), "R": (7, ["A", "C"]), "D": (11, ["R"]), "R2": (13, ["D"])}, {"A": 2, "B": 3})


def test_only_what_changed_runs(spark):
    w = arithmetic(spark)
    first = w.build("R")
    assert {k for k, r in first.items() if r["reason"] == "never-built"} == {"A", "B", "C", "R"} and first["R"]["value"] == str(2 * (2 * 3 * 5) * 7)
    assert w.ran("R") == set()
    w.leaves["A"] = 4
    assert w.ran("R") == {"A", "C", "R"}
    w.leaves["B"] = 5
    assert w.ran("R") == {"B", "C", "R"}
    assert w.ran("R2") == {"D", "R2"}
    w.leaves["B"] = 7
    assert w.ran("R") == {"B", "C", "R"}
    again = w.build("R2")
    assert {k: r["reason"] for k, r in again.items() if r["reason"] != "up-to-date"} == {"D": "input-rebuilt", "R2": "input-rebuilt"}
    assert w.ran("R2") == set()


def test_an_unchanged_value_stops_propagation(spark):
    w = World(spark, {"result": (3, ["value"])}, {"value": 5})
    assert w.ran("result") == {"value", "result"}
    w.seen.clear()  # invalid, but the same once computed
    out = w.build("result")
    assert {k for k, r in out.items() if r["reason"] != "up-to-date"} == {"value"}
    assert out["value"]["computed_at"] == 1 and out["value"]["built_at"] == 2


def test_signature_change_runs_the_rule_alone(spark):
    w = World(spark, {"R": (3, ["A"])}, {"A": 2})
    assert w.ran("R") == {"A", "R"}
    w.signatures["A"] = "other"
    out = w.build("R")
    assert {k: r["reason"] for k, r in out.items()} == {"A": "signature-changed", "R": "up-to-date"}
    assert w.ran("R") == set()


def test_discovered_edge(spark):
    w = World(spark, {"output": (1, ["A"])}, {"A": 2, "B": 3})
    assert w.ran("output", "B") == {"output", "A", "B"}
    w.rules["output"] = (1, ["A", "B"])  # reported after it ran
    assert w.ran("output") == set()
    w.leaves["B"] = 4
    assert w.ran("output") == {"B", "output"}


def test_order_only_and_single_use(spark):
    w = World(spark, {"out": (1, ["A", ("B", "order"), ("C", "once")])}, {"A": 2, "B": 3, "C": 4})
    assert w.ran("out") == {"out", "A", "B"}  # the single-use edge is gone by the next scan
    w.leaves["B"] = 9
    assert w.ran("out") == {"B"}


def test_cycle_and_breaking(spark):
    w = World(spark, {"A": (1, ["B", "C"]), "B": (1, ["C"]), "C": (1, ["B"])}, {})
    with pytest.raises(Cycle) as e:
        w.build("A")
    assert e.value.path[0] == e.value.path[-1] and set(e.value.path) == {"B", "C"}
    edges = spark.createDataFrame([("A", 0, "B"), ("A", 1, "C"), ("B", 0, "C"), ("C", 0, "B")], "key string, ordinal int, dep string")
    assert graph.acyclic(incremental.break_cycle(edges, e.value.path)).count() == 0
    phony = spark.createDataFrame([("B",)], "key string")
    loop = spark.createDataFrame([("B", 0, "B"), ("A", 0, "A"), ("A", 1, "B")], "key string, ordinal int, dep string")
    assert sorted((r["key"], r["dep"]) for r in incremental.without_phony_self_edges(loop, phony).collect()) == [("A", "A"), ("A", "B")]


def test_a_rule_declared_twice(spark):
    rules = spark.createDataFrame([("A", "s"), ("A", "s")], schema.RULES)
    empty = lambda ddl: spark.createDataFrame([], ddl)
    with pytest.raises(ValueError, match="more than once"):
        incremental.build(spark.createDataFrame([("A",)], "key string"), rules, empty(schema.PRIOR), empty(schema.KEY_EDGES), empty(schema.VALID), lambda x: x, 1)
    assert [tuple(r) for r in history.duplicates(rules).collect()] == [("A", 2)]


def test_dynamic_requests(spark):
    """Ackermann's function: what to ask for next depends on values."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            m, n = map(int, row.key.split(","))
            have = dict(row.inputs)
            if m == 0:
                out.append((row.key, str(n + 1), []))
            elif n == 0:
                ask = f"{m - 1},1"
                out.append((row.key, have.get(ask), [] if ask in have else [ask]))
            else:
                inner = f"{m},{n - 1}"
                outer = f"{m - 1},{have[inner]}" if inner in have else inner
                out.append((row.key, have.get(outer) if outer != inner else None, [] if outer in have and outer != inner else [outer]))
        return pd.DataFrame(out, columns=["key", "value", "asks"])

    goals = spark.createDataFrame([("2,1",)], "key string")
    done = incremental.build_dynamic(goals, lambda run: run.mapInPandas(lambda it: map(step, it), "key string, value string, asks array<string>"))
    got = {r["key"]: r["value"] for r in done.collect()}
    assert got["2,1"] == "5" and got["1,3"] == "5"


def test_dynamic_cycle(spark):
    other = F.when(F.col("key") == "a", "b").otherwise("a")
    with pytest.raises(Cycle):
        incremental.build_dynamic(spark.createDataFrame([("a",)], "key string"), lambda run: run.select("key", F.lit(None).cast("string").alias("value"), F.array(other).alias("asks")))


def test_history_keeps_committed_epochs(spark, tmp_path):
    h = history.BuildHistory(spark, str(tmp_path / "history"))
    assert h.iteration() == 0 and h.results().count() == 0
    row = lambda v, e: spark.createDataFrame([("k", v, "s", e, e)], schema.PRIOR)
    assert h.commit(row("1", 1)) == 1 and h.commit(row("2", 2)) == 2
    assert [r["value"] for r in h.results().collect()] == ["2"]
    row("3", 3).write.parquet(str(tmp_path / "history/results/epoch=3"))  # a build that never ended
    assert [r["value"] for r in h.results().collect()] == ["2"]
    h.clear()
    assert h.iteration() == 0 and h.results().count() == 0


def test_critical_path(spark):
    """In either order of rows, with a tie, a cycle, and a long chain of diamonds."""
    rows = [("A", 1, []), ("B", 1, ["A"]), ("C", 1, []), ("D", 1, ["B", "C"]), ("E", 1, []), ("F", 1, ["D", "E"])]
    for order in (rows, rows[::-1]):
        nodes = spark.createDataFrame([(k, w) for k, w, _ in order], "key string, w int")
        edges = spark.createDataFrame([(k, d) for k, _, deps in order for d in deps], "key string, dep string")
        path = sorted(graph.critical_path(nodes, edges).collect())
        assert [r["key"] for r in path] == ["A", "B", "D", "F"] and int(path[-1]["total"]) == 4
    empty = graph.critical_path(nodes.where("false"), edges.where("false"))
    assert empty.collect() == []
    with pytest.raises(ValueError):
        graph.longest_paths(nodes, edges.union(spark.createDataFrame([("A", "F")], "key string, dep string")))
    with pytest.raises(ValueError):
        graph.longest_paths(nodes.where("key < 'C'"), spark.createDataFrame([("A", "B"), ("B", "A")], "key string, dep string"))
    diamonds = [(f"n{i + 1}", f"{s}{i}") for i in range(12) for s in "lr"] + [(f"{s}{i}", f"n{i}") for i in range(12) for s in "lr"]
    edges = spark.createDataFrame(diamonds, "key string, dep string")
    nodes = edges.select("key").union(edges.select("dep")).distinct().withColumn("w", F.lit(1))
    assert int(graph.longest_paths(nodes, edges).agg(F.max("total")).first()[0]) == 25


def test_path_validation(spark):
    path = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "ordinal int, key string")
    edges = spark.createDataFrame([("B", "A")], "key string, dep string")
    assert {r["key"]: r["ok"] for r in graph.validate_path(path, edges).collect()} == {"A": True, "B": True, "C": False}


def test_dependencies_that_are_no_nodes(spark):
    """They are leaves without weight, whatever the rest of the graph is like."""
    nodes = spark.createDataFrame([(k, 1) for k in "ABCD"], "key string, w int")
    edges = [("A", "B"), ("B", "C"), ("A", "X")]
    for more in ([], [("D", "A"), ("D", "B")]):
        rows = graph.longest_paths(nodes, spark.createDataFrame(edges + more, "key string, dep string")).collect()
        got = {r["key"]: (r["level"], float(r["total"])) for r in rows}
        assert {k: got[k] for k in "ABC"} == {"A": (2, 3.0), "B": (1, 2.0), "C": (0, 1.0)}
        assert got["D"] == ((3, 4.0) if more else (0, 1.0))
    single = graph.longest_paths(nodes, spark.createDataFrame([("A", "X"), ("B", "A"), ("X", "C")], "key string, dep string")).collect()
    assert {r["key"]: (r["level"], float(r["total"])) for r in single} == {"A": (1, 1.0), "B": (2, 2.0), "C": (0, 1.0), "D": (0, 1.0)}


def test_cycles_in_every_shape(spark):
    nodes = spark.createDataFrame([(k, 1) for k in "ABCDE"], "key string, w int")
    ring = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")]
    for more in ([], [("E", "A"), ("E", "B")], [("B", "E")]):
        edges = spark.createDataFrame(ring + more, "key string, dep string")
        assert {r["key"] for r in graph.on_cycles(edges).collect()} == {"A", "B", "C"}
        with pytest.raises(ValueError, match="cycles"):
            graph.longest_paths(nodes, edges).collect()
    assert graph.on_cycles(spark.createDataFrame([("A", "A")], "key string, dep string")).collect()[0]["key"] == "A"


def test_build_names_keys_without_a_rule(spark):
    rules = spark.createDataFrame([("A", "s")], "key string, signature string")
    prior = spark.createDataFrame([], "key string, value string, signature string, built_at long, computed_at long")
    edges = spark.createDataFrame([("A", 0, "B", False, False)], "key string, ordinal int, dep string, order_only boolean, single_use boolean")
    valid = spark.createDataFrame([], "key string, ok boolean")
    goals = spark.createDataFrame([("A",)], "key string")
    compute = lambda run: run.select("key", F.lit("v").alias("value"))
    with pytest.raises(incremental.MissingRules, match="no rule for: B"):
        incremental.build(goals, rules, prior, edges, valid, compute, 1)
    both = rules.union(spark.createDataFrame([("B", "s")], rules.schema))
    assert {r["key"] for r in incremental.build(goals, both, prior, edges, valid, compute, 1).collect()} == {"A", "B"}
    ring = edges.union(spark.createDataFrame([("B", 0, "A", False, False)], edges.schema))
    with pytest.raises(incremental.Cycle) as e:
        incremental.build(goals, both, prior, ring, valid, compute, 1)
    assert e.value.path == ["A", "B", "A"]


@pytest.mark.parametrize("of", ["closure", "longest_paths", "on_cycles", "propagate", "early_cutoff", "build"])
def test_no_round_sends_a_table_whole(spark, monkeypatch, of):
    """A table's file says little about its size in memory, so no join may go by it."""
    rows = spark.range(200).selectExpr("concat('k', id) AS key", "id", "CAST(id AS DECIMAL(12,2)) AS w")
    edges = rows.where("id >= 4").selectExpr("key", "explode(array(concat('k', id DIV 2), concat('k', id DIV 4))) AS dep", "0 AS ordinal", "false AS order_only", "false AS single_use")
    nodes, top = rows.select("key", "w"), rows.where("id > 150").select("key")
    plans = []

    def kept(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *more)

    from buildlens.shared import written

    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    monkeypatch.setattr(graph, "written", kept)
    monkeypatch.setattr(incremental, "written", kept)
    rules = nodes.selectExpr("key", "'s' AS signature")
    prior = nodes.selectExpr("key", "'v' AS value", "'s' AS signature", "1L AS built_at", "1L AS computed_at")
    out = {
        "closure": lambda: graph.closure(top, edges),
        "longest_paths": lambda: graph.longest_paths(nodes, edges),
        "on_cycles": lambda: graph.on_cycles(edges),
        "propagate": lambda: graph.propagate(nodes, edges, rows.where("id = 3").select("key")),
        "early_cutoff": lambda: incremental.early_cutoff(nodes, edges, rows.where("id = 3").select("key"), rows.where("id = 9").select("key")),
        "build": lambda: incremental.build(nodes.select("key"), rules, prior, edges, rows.where("id = 3").selectExpr("key", "false AS ok"), lambda run: run.selectExpr("key", "'v2' AS value"), 2),
    }[of]()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def test_cycles_of_forests_with_long_ways_in(spark):
    """Rings of 1, 2 and 3 keys, ways of many lengths into them, and chains that end."""
    ring = {"a": "a", "b": "c", "c": "b", "d": "e", "e": "f", "f": "d"}
    into = {f"i{n}": f"i{n + 1}" for n in range(20)} | {"i20": "d", "j0": "j1", "j1": "b", "j2": "b"}
    ends = {f"x{n}": f"x{n + 1}" for n in range(9)}
    edges = spark.createDataFrame([*ring.items(), *into.items(), *ends.items()], "key string, dep string")
    assert {r["key"] for r in graph.on_cycles(edges).collect()} == set(ring)
    assert graph.on_cycles(spark.createDataFrame(list(ends.items()), "key string, dep string")).isEmpty()
