"""The maintained view against an event-by-event replay of random logs, whole and in random pieces."""

import random

import pytest

from millrace.operators import graph_view as V

SCHEMA = "seq long, idempotency_key string, op string, id string, type string, src string, dst string, ref string, props map<string,string>, at string"


def sequential(log):
    nodes, edges, refused, seen, intervals = {}, [], [], set(), {}
    drop = lambda keep, seq: [intervals.__setitem__(e[0], seq) for e in edges if not keep(e)] and None
    for seq, key, op, i, kind, a, b, ref, props, at in sorted(log, key=lambda e: e[0]):
        if key in seen:
            continue
        if op == "create_node":
            if i:
                n = nodes.setdefault(i, {"label": kind, "props": {}, "canonical": None, "merged": None, "closed": None})
                n["props"].update(props or {})
        elif op == "create_edge":
            if a in nodes and b in nodes:
                edges.append((seq, kind, a, b, None))
            else:
                refused.append((seq, "dangling_ref"))
        elif op == "merge":
            if a in nodes and b in nodes:
                nodes[a].update(canonical=b, merged=True)
                edges.append((seq, "SAME_AS", a, b, ref or ""))
            else:
                refused.append((seq, "merge_missing_node"))
        elif op == "unmerge":
            if a in nodes:
                keep = lambda e: not (e[2:4] == (a, b) and (not ref or e[1] != "SAME_AS" or e[4] == ref))  # noqa: E731,B023
                drop(keep, seq)
                edges = [e for e in edges if keep(e)]
                if not any(e[2] == a and e[1] == "SAME_AS" for e in edges):
                    nodes[a].update(canonical=None, merged=False)
        elif op == "supersede":
            if a in nodes and b in nodes:
                edges.append((seq, "SUPERSEDES", a, b, None))
                nodes[b]["closed"] = at
        elif op == "delete_node":
            if i in nodes:
                nodes[i]["label"] = "Deleted"
                keep = lambda e: i not in e[2:4]  # noqa: E731,B023
                drop(keep, seq)
                edges = [e for e in edges if keep(e)]
        else:
            continue
        seen.add(key)
    return nodes, sorted(edges), sorted(refused), intervals


def random_log(seed, n=220, names=9):
    r = random.Random(seed)
    node = lambda: f"n{r.randrange(names)}"
    log = []
    for seq in range(1, n + 1):
        op = r.choice(["create_node"] * 2 + ["create_edge"] * 3 + ["merge"] * 3 + ["unmerge"] * 2 + ["supersede", "delete_node", "unknown"])
        key = f"k{seq}" if r.random() < 0.9 else f"k{r.randint(1, seq)}"
        a, b = node(), node()
        props = {r.choice("xyz"): str(seq)} if op == "create_node" and r.random() < 0.7 else None
        log.append((seq, key, op, a if op in ("create_node", "delete_node") else None, r.choice("PQ"), a, b, r.choice([None, "", "r1", "r2"]), props, f"t{seq}"))
        if op in ("create_node", "delete_node"):
            log[-1] = (*log[-1][:5], None, None, *log[-1][7:])
    return log


def state(view):
    nodes = {r["id"]: {"label": r["label"], "props": dict(r["props"]), "canonical": r["canonical_id"], "merged": r["merged"], "closed": r["closed_at"]} for r in view.nodes.collect()}
    edges = sorted(tuple(r) for r in view.live_edges().collect())
    refused = sorted((r["seq"], r["reason"]) for r in view.refused.collect())
    ended = {r["seq"]: r["ended"] for r in view.edges.where("ended is not null").collect()}
    return nodes, edges, refused, ended


@pytest.mark.parametrize("seed", range(2))
def test_replay_in_one_and_in_pieces(spark, tmp_path, seed):
    log = random_log(seed)
    want = sequential(log)
    rows = spark.createDataFrame(log, SCHEMA)
    assert state(V.advance(V.empty(spark), rows)) == want
    r = random.Random(seed + 50)
    cuts = sorted(r.sample(range(1, len(log)), 1 + seed))
    root = "file://" + str(tmp_path / "view")
    for lo, hi in zip([0, *cuts], [*cuts, len(log)], strict=True):
        view = V.maintain(spark, root, spark.createDataFrame(log[lo:hi], SCHEMA))
        assert state(view) == sequential(log[:hi])
    if seed:
        return
    # the same delta again changes nothing
    assert state(V.maintain(spark, root, spark.createDataFrame(log[cuts[-1] :], SCHEMA))) == want


def test_a_delta_reads_touched_parts_only(spark, tmp_path):
    node = lambda seq, name: (seq, f"k{seq}", "create_node", name, "N", None, None, None, None, None)
    root = "file://" + str(tmp_path / "view")
    V.maintain(spark, root, spark.createDataFrame([node(k, f"n{k}") for k in range(300)], SCHEMA))
    delta = spark.createDataFrame([(900, "e1", "create_edge", None, "E", "n1", "n2", None, None, None), (901, "d1", "delete_node", "n2", None, None, None, None, None, None)], SCHEMA)
    parts = V.touched(V.stored(spark, root), delta)
    assert len(parts["nodes"]) <= 2
    plan = V.stored(spark, root, parts).nodes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    view = V.maintain(spark, root, delta)
    assert view.live_edges().count() == 0 and view.edges.where("ended = 901").count() == 2 and view.nodes.count() == 300
    assert V.merge_intervals(view).count() == 0 and view.as_of(900).count() == 1
