import random

from tablespec.operators import graphs as G


def plain(edges):
    """Nodes that reach themselves, and which reach each other, by a closure."""
    reach = {}
    nodes = {x for e in edges for x in e}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    on = {n for n in nodes if n in reach[n]}
    return {frozenset(m for m in on if m == n or m in reach[n] and n in reach[m]) for n in on}


def found(spark, edges):
    rows = G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.component, set()).add(r.node)
    assert sum(map(len, groups.values())) == len(rows) == len({r.node for r in rows})
    return {frozenset(g) for g in groups.values()}


def ring(*nodes):
    return list(zip(nodes, (*nodes[1:], nodes[0])))


CASES = {
    "rings joined by a chain": ring(1, 2, 3) + [(3, 10), (10, 11), (11, 20)] + ring(20, 21) + [(21, 30), (30, 31)],
    "loops of one edge inside others": [(1, 1), (1, 2), (2, 3), (3, 1), (5, 5), (6, 5), (3, 7), (7, 7), (7, 8)],
    "two rings that share a node": ring(1, 2, 3, 4) + ring(4, 5, 6) + ring(6, 60),
    "a ring with chords and tails": ring(*range(12)) + [(0, 6), (6, 2), (11, 50), (50, 51), (60, 0)],
    "a path": [(k, k + 1) for k in range(9)],
    "repeated edges": ring(1, 2) * 3 + [(2, 9)],
    "small rings that join at once": ring(1, 2) + ring(1, 3) + ring(1, 4) + [(4, 5)],
}


def test_components_equal_a_closure(spark):
    """All cases and two random graphs side by side in one graph."""
    r = random.Random(1)
    cases = [*CASES.values(), *([(r.randrange(40), r.randrange(40)) for _ in range(45)] for _ in range(2))]
    edges = [(1000 * k + a, 1000 * k + b) for k, x in enumerate(cases) for a, b in x]
    assert found(spark, edges) == plain(edges)


def test_no_edges_and_null_ends(spark):
    df = spark.createDataFrame([(None, 1, True), (1, None, False), (None, None, False)], "src long, dst long, deferrable boolean")
    assert G.cycle_members(df).count() == 0


def test_a_long_ring_in_few_rows(spark, monkeypatch):
    n, rows, kept = 5000, [], G.written

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(G, "written", counted)
    found = G.strong_components(spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst"))
    assert found.count() == n and found.select("component").distinct().count() == 1
    assert sum(rows) < 25 * n and len(rows) < 120
