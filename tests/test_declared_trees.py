"""Trees that are declared, and budgets that skip, against loops."""

import random

import pytest

from sheafline.operators import packing, rollups, tree

SCHEMA = "bundle_id string, node_id string, parent_id string, kind string, name string, path string"


def sound():
    return [["b", "r", None, "directory", "", ""], ["b", "d1", "r", "directory", "x", "x"], ["b", "d2", "d1", "directory", "y", "x/y"], ["b", "d3", "d2", "directory", "z", "x/y/z"], ["b", "f1", "d3", "file", "a.txt", "x/y/z/a.txt"], ["b", "f2", "r", "file", "b.txt", "b.txt"]]


def change(**by_node):
    def run(rows):
        for node, fields in by_node.items():
            for r in rows:
                if r[1] == node:
                    for k, v in fields.items():
                        r[SCHEMA.split(", ").index(next(x for x in SCHEMA.split(", ") if x.startswith(k + " ")))] = v

    return run


FAULTS = [
    (lambda rows: None, []),
    (lambda rows: rows.append(list(rows[4])), [("f1", "tree-duplicate-node")]),
    (change(f2={"kind": "link"}), [("f2", "tree-kind")]),
    (lambda rows: rows.append(["b", "f9", "r", "file", "n", "n"]), [("f9", "tree-file-reference")]),
    (lambda rows: rows.append(["b", "d9", "r", "directory", "n", "n"]), [("d9", "tree-directory-reference")]),
    (change(f2={"name": "c.txt", "path": "c.txt"}), [("f2", "tree-file-path")]),
    (change(f2={"name": "c.txt"}), [("f2", "tree-path")]),
    (change(f2={"parent_id": None}), [("f2", "tree-file-root")]),
    (change(f2={"parent_id": "gone"}), [("f2", "tree-island"), ("f2", "tree-parent")]),
    (change(d1={"parent_id": "gone"}), [("d1", "tree-island"), ("d1", "tree-parent"), ("d2", "tree-island"), ("d3", "tree-island"), ("f1", "tree-island")]),
    (change(d1={"parent_id": "d3"}), [("d1", "tree-cycle"), ("d1", "tree-path"), ("d2", "tree-cycle"), ("d3", "tree-cycle"), ("f1", "tree-cycle")]),
    (change(d1={"parent_id": "d1"}), [("d1", "tree-cycle"), ("d1", "tree-path"), ("d2", "tree-cycle"), ("d3", "tree-cycle"), ("f1", "tree-cycle")]),
    (change(f1={"parent_id": "f2", "path": "b.txt/a.txt"}), [("f1", "tree-file-path"), ("f1", "tree-island"), ("f2", "tree-file-children")]),
    (change(d1={"parent_id": None}), [("d1", "tree-roots")]),
]


def test_each_fault_of_a_tree(spark):
    rows, want = [], {}
    for i, (fault, codes) in enumerate(FAULTS):
        own = [list(r) for r in sound()]
        fault(own)
        rows += [(f"case{i:02d}", *r[1:]) for r in own]
        if codes:
            want[f"case{i:02d}"] = sorted(codes)
    records = [(f"case{i:02d}", r[1], r[3], r[5]) for i in range(len(FAULTS)) for r in sound()]
    got = {}
    for x in tree.checked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(records, "bundle_id string, node_id string, kind string, path string")).collect():
        got.setdefault(x.bundle_id, []).append((x.node_id, x.code))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_long_chains_and_cycles(spark):
    chain = [("b", f"n{i}", f"n{i - 1}" if i else None, "directory", "d", f"p{i}") for i in range(70)]
    ring = [("b", f"c{i}", f"c{(i + 1) % 9}", "directory", "d", f"c{i}") for i in range(9)] + [("b", "tail", "c0", "directory", "d", "t"), ("b", "lone", "none", "directory", "d", "l"), ("b", "below", "lone", "directory", "d", "k")]
    got = {x.node_id: x.state for x in tree.ranks(spark.createDataFrame(chain + ring, SCHEMA)).collect()}
    assert got == {**{f"n{i}": "rooted" for i in range(70)}, **{f"c{i}": "cycle" for i in range(9)}, "tail": "cycle", "lone": "island", "below": "island"}


@pytest.mark.parametrize("most", [None, 5])
def test_skipping_budget_equals_a_loop(spark, most):
    r = random.Random(8)
    rows = [(f"g{i % 7}", i, r.choice([0, 1, 3, 10, 30, 60, 99, 101])) for i in range(260)] + [("big", 1000, 500), ("zero", 1001, 0), *[("many", 2000 + i, 1) for i in range(150)], *[("down", 3000 + i, 60 - i) for i in range(50)]]
    want = {}
    left, n = {}, {}
    for g, i, size in rows:
        fits = size <= left.get(g, 100) and (most is None or n.get(g, 0) < most)
        want[i] = fits
        if fits:
            left[g], n[g] = left.get(g, 100) - size, n.get(g, 0) + 1
    df = spark.createDataFrame(rows, "g string, at long, size long").repartition(4)
    assert {x["at"]: x.taken for x in packing.skipping_budget(df, ("g",), "at", "size", 100, most).collect()} == want
    assert packing.skipping_budget(df.limit(0), ("g",), "at", "size", 100, most).count() == 0


def test_order_of_names_ignores_case_and_accents(spark):
    names = ["Zebra", "Äpfel 10", "apfel 2", "éclair", "Eclair b", "ÉTÉ", "eta", "Ωmega", "ωmicron", "Ёлка", "ежик", "éa", "10", "9", "ñ", "nz", "o"]
    nodes = tree.nodes(spark.createDataFrame([("b", n) for n in names] + [("b", "Über/x"), ("b", "unter/y")], "bundle_id string, path string"))
    got = [r.name for r in tree.ordered_children(nodes).filter("depth = 1").orderBy("ordinal").collect()]
    assert got == ["Über", "unter", "9", "10", "apfel 2", "Äpfel 10", "éa", "éclair", "Eclair b", "eta", "ÉTÉ", "ñ", "nz", "o", "Zebra", "Ωmega", "ωmicron", "ежик", "Ёлка"]
    walk = [r.path for r in rollups.preorder(nodes).orderBy("position").collect()]
    assert [p for p in walk if "/" not in p and p] == got
