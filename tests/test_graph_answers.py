"""Communities, trails, bounded reach, neighbourhoods and ranked search against plain Python."""

import datetime
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import communities, components, graph, search

DAY = datetime.datetime(2024, 1, 1)


# Communities


def plain_modularity(links, part):
    whole = 2 * sum(w for _, _, w in links)
    inner, total = defaultdict(float), defaultdict(float)
    for a, b, w in links:
        total[part[a]] += w
        total[part[b]] += w
        inner[part[a]] += 2 * w * (part[a] == part[b])
    return sum(inner[c] / whole - (total[c] / whole) ** 2 for c in total)


def sequential_louvain(links):
    """Node by node in order, level by level."""
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    part, level = {x: x for x in nodes}, links
    while True:
        names = sorted({x for a, b, _ in level for x in (a, b)})
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in level:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        twice, of, total = sum(k.values()), {x: x for x in names}, dict(k)
        moved = any_moved = True
        any_moved = False
        while moved:
            moved = False
            for x in names:
                total[of[x]] -= k[x]
                into = defaultdict(float, {of[x]: 0.0})
                for y, w in near[x].items():
                    into[of[y]] += w
                best = max(sorted(into), key=lambda c: (round(into[c] - total[c] * k[x] / twice, 12), c == of[x]))
                moved |= best != of[x]
                of[x] = best
                total[best] += k[x]
            any_moved |= moved
        if not any_moved:
            return part
        part = {x: of[c] for x, c in part.items()}
        merged = defaultdict(float)
        for a, b, w in level:
            merged[tuple(sorted((of[a], of[b])))] += w
        level = [(a, b, w) for (a, b), w in merged.items()]


def ring_of_cliques(n, size):
    links = [(c * size + i, c * size + j, 1.0) for c in range(n) for i, j in itertools.combinations(range(size), 2)]
    return links + [(c * size, (c + 1) % n * size + 1, 1.0) for c in range(n)]


def planted_groups(n, groups, inside, outside, seed):
    rng = random.Random(seed)
    return [(a, b, 1.0 + rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a % groups == b % groups else outside)]


def near_circle(n, seed):
    """No groups at all: links to the next few on a circle, some at random."""
    rng = random.Random(seed)
    return [(i, (i + d) % n, 1.0) for i in range(n) for d in (1, 2, 3)] + [(i, rng.randrange(n), 0.5) for i in range(0, n, 3)]


@pytest.mark.parametrize("links", [ring_of_cliques(8, 5), planted_groups(90, 4, 0.4, 0.04, 1), near_circle(80, 2)], ids=["cliques", "planted", "circle"])
def test_louvain_is_as_good_as_node_by_node(spark, links):
    found = communities.louvain(spark.createDataFrame(links, "a long, b long, weight double")).collect()
    part = {r["ref"]: r["community"] for r in found}
    assert set(part) == {x for a, b, _ in links for x in (a, b)}
    assert all(part[c] == c == min(x for x in part if part[x] == c) for c in set(part.values()))
    assert plain_modularity(links, part) >= 0.98 * plain_modularity(links, sequential_louvain(links))
    pairs = communities.weighted_pairs(spark.createDataFrame(links, "a long, b long, weight double"))
    parts = spark.createDataFrame(list(part.items()), "ref long, c long")
    assert communities.modularity(pairs, parts) == pytest.approx(plain_modularity(links, part))


def test_louvain_of_cliques_and_of_nothing(spark):
    links = [*ring_of_cliques(6, 4), (0, 0, 2.0), (1, 2, 0.5), (5, 6, 0.0), (100, 100, 1.0)]
    found = {r["ref"]: r for r in communities.louvain(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
    assert all(found[i]["community"] == i // 4 * 4 for i in range(24)) and found[100]["community"] == 100
    assert all(r["settled"] for r in found.values())
    assert communities.louvain(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_louvain_folds_leaves_without_rounds(spark, monkeypatch):
    stars = [(h, 100 * h + i, 1.0 + i) for h in range(1, 6) for i in range(1, 8)] + [(-h, 5000 + h, 2.0) for h in range(4)] + [(9000 + i, 9999, 1.0) for i in range(5)]
    asked = []
    rounds = communities.local_moves
    monkeypatch.setattr(communities, "local_moves", lambda *a: asked.append(a) or rounds(*a))
    found = {r["ref"]: r["community"] for r in communities.louvain(spark.createDataFrame(stars, "a long, b long, weight double")).collect()}
    want = {x: 9000 if x >= 9000 else min(a, b) for a, b, _ in stars for x in (a, b)}
    assert found == want and not asked
    links = [*ring_of_cliques(5, 4), *((i, 50 + i, 1.0) for i in range(20)), (3, -1, 0.5), (-7, -8, 3.0)]
    part = {r["ref"]: r["community"] for r in communities.louvain(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
    assert asked and all(part[i] == part[50 + i] for i in range(20)) and part[3] == part[-1] == -1 and part[-7] == part[-8] == -8
    assert all(part[c] == c == min(x for x in part if part[x] == c) for c in set(part.values()))
    assert plain_modularity(links, part) >= 0.98 * plain_modularity(links, sequential_louvain(links))


def test_community_summary_counts_with_denominators(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)], "ref long, community long")
    nodes = spark.createDataFrame([(1, "elevated", 5.0), (2, "insufficient", 9.0), (3, None, None), (4, "routine", 9.0), (6, None, None)], "ref long, band string, score double")
    rows = {r["community"]: tuple(r)[1:] for r in communities.community_summary(members, nodes).collect()}
    assert rows[1] == (4, 2, 1, 2, "insufficient", 9.0) and rows[5] == (2, 0, 0, 5, None, None)


# Trails


def plain_trails(rows, least, most, kept):
    found = []

    def go(path):
        if len(path) >= least and path[-1][2] == path[0][1]:
            found.append((tuple(r[0] for r in path), len(path), round(sum(r[3] for r in path), 6), round(path[-1][3] / path[0][3], 9)))
        if len(path) < most:
            for r in rows:
                if r[1] == path[-1][2] and r not in path and r[3] > 0 and kept * path[-1][3] <= r[3] <= path[-1][3]:
                    go([*path, r])

    for r in rows:
        if r[3] > 0:
            go([r])
    return sorted(found)


def money(seed, n=45, accounts=5):
    """Transfers at random, and one planted trail of each length from 3 to 6."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(accounts), rng.randrange(accounts), float(rng.choice([0, 50, 100, 90, 86, 300, rng.randrange(60, 130)]))) for i in range(n)]
    for length in range(3, 7):
        at = [1000 * length + k for k in range(length)]
        rows += [(100 * length + k, at[k], at[(k + 1) % length], 5000.0 * 0.9**k) for k in range(length)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_trails_of_every_length(spark, seed):
    rows = money(seed)
    table = spark.createDataFrame(rows, "edge_id long, src long, dst long, amount double")
    want = plain_trails(rows, 3, 6, 0.85)
    found = graph.closed_trails(table).collect()
    assert sorted((tuple(r["trail"]), r["length"], round(r["total"], 6), round(r["retention"], 9)) for r in found) == want
    assert {n for ids, n, *_ in want if min(ids) >= 300} == {3, 4, 5, 6}
    best = graph.best_trails(table, 4, gap=0.01).collect()
    for length in range(3, 7):
        ranked = sorted(((-x[3], x[0]) for x in want if x[1] == length))[:4]
        got = sorted(((r["rank"], tuple(r["trail"])) for r in best if r["length"] == length))
        assert [t for _, t in got] == [t for _, t in ranked]


def test_best_trails_in_few_rounds_and_few_rows(spark, monkeypatch):
    rows = money(3, 60)
    table = spark.createDataFrame(rows, "edge_id long, src long, dst long, amount double")
    want = plain_trails(rows, 3, 6, 0.85)
    losses, halves = [], graph.half_trails
    monkeypatch.setattr(graph, "half_trails", lambda *a: losses.append(a[3]) or halves(*a))
    best = graph.best_trails(table, 4).collect()
    for length in range(3, 7):
        ranked = sorted(((-x[3], x[0]) for x in want if x[1] == length))[:4]
        assert [t for _, t in sorted((r["rank"], tuple(r["trail"])) for r in best if r["length"] == length)] == [t for _, t in ranked]
    assert len(losses) <= 5
    for keys, passes in ((16, 1 << 20), (1, 0)):
        monkeypatch.setattr(graph, "KEYS", keys)
        monkeypatch.setattr(graph, "PASSES", passes)
        found = graph.closed_trails(table, 3, 4).collect()
        assert sorted((tuple(r["trail"]), r["length"], round(r["total"], 6), round(r["retention"], 9)) for r in found) == plain_trails(rows, 3, 4, 0.85)


# Reach


def plain_reach(own, rows, hops, most):
    seen, front, out, cut = set(own), {}, {}, False
    for e, s, d, a, t in sorted(rows):
        if s in own and d not in seen and a > 0 and d != s and (d not in front or a > front[d][0]):
            front[d] = (a, a, t, t, 1.0)
    for hop in range(1, hops + 1):
        for d, (_, first, t0, t1, kept) in front.items():
            seen.add(d)
            out[d] = (hop, round(kept, 9), first, t0, t1)
        then = {}
        for e, s, d, a, t in sorted(rows):
            if s in front and d not in seen and d != s and a > 0:
                before, first, t0, t1, _ = front[s]
                if 0.8 * before <= a <= before and a >= 0.55 * first and max(t1, t) - min(t0, t) <= datetime.timedelta(30):
                    if d not in then or (a / first, -e) > (then[d][4], -then[d][5]):
                        then[d] = (a, first, min(t0, t), max(t1, t), a / first, e)
        if len(then) > most and hop < hops:
            cut = True
            then = dict(sorted(then.items(), key=lambda x: (-x[1][4], x[0]))[:most])
        front = {d: v[:5] for d, v in then.items()}
    return {d: (*v, cut) for d, v in out.items()}


@pytest.mark.parametrize("most", [400, 3])
def test_forward_reach_with_a_bounded_frontier(spark, most):
    rng = random.Random(7)
    rows = [(i, rng.randrange(30), rng.randrange(30), float(rng.randrange(70, 101)), DAY + datetime.timedelta(rng.randrange(45))) for i in range(500)]
    subjects = [(s, r) for s, refs in enumerate([[0, 1], [2], [3], [99]]) for r in refs]
    found = graph.forward_reach(spark.createDataFrame(subjects, "subject long, ref long"), spark.createDataFrame(rows, "edge_id long, src long, dst long, amount double, ts timestamp_ntz"), most=most)
    got = defaultdict(dict)
    for r in found.collect():
        got[r["subject"]][r["ref"]] = (r["hops"], round(r["carried"], 9), r["first_amount"], r["first_seen"], r["last_seen"], r["truncated"])
    for s in range(4):
        assert got[s] == plain_reach([r for x, r in subjects if x == s], rows, 4, most)
    assert any(v[-1] for v in got[0].values()) == (most == 3)


# Neighbourhoods


@pytest.mark.parametrize("most", [500, 6])
def test_neighbourhood_with_links_once_and_beyond(spark, most):
    rng = random.Random(3)
    edges = [(i, rng.randrange(40), rng.randrange(40)) for i in range(70)] + [(70, 1, 1), (71, 50, 51)]
    nodes, links = graph.neighbourhood(spark.createDataFrame([(1,), (2,), (77,), (1,)], "ref long"), spark.createDataFrame(edges, "edge_id long, src long, dst long"), 3, most)
    for seed in (1, 2, 77):
        hops, front = {seed: 0}, [seed]
        for k in (1, 2, 3):
            reached = sorted({y for _, a, b in edges for x, y in ((a, b), (b, a)) if x in front and y not in hops})
            front = reached[: most - len(hops)]
            hops |= dict.fromkeys(front, k)
        want = {(e, a, b, not (a in hops and b in hops)) for e, a, b in edges if hops.get(a, 3) < 3 or hops.get(b, 3) < 3}
        assert {r["ref"]: r["hops"] for r in nodes.where(f"seed = {seed}").collect()} == hops and len(hops) <= most
        rows = [tuple(r)[1:] for r in links.where(f"seed = {seed}").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert links.where("beyond").isEmpty() == (most == 500)


def test_paths_from_sources(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (6, 7), (2, 2)], "src long, dst long")
    found = {(r["a"], r["b"]): r["path"] for r in graph.paths_from(spark.createDataFrame([(1,), (9,)], "ref long"), edges, 3).collect()}
    assert found == {(1, 2): [1, 2], (1, 5): [1, 5], (1, 3): [1, 2, 3], (1, 4): [1, 5, 4]}
    pairs = spark.createDataFrame([(1, 4), (1, 1), (1, 7)], "a long, b long")
    assert {(r["b"], r["length"]) for r in graph.shortest_paths(pairs, edges).collect()} == {(4, 2), (1, 0)}


# Search


def slips(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_search_forgives_two_slips_and_ranks(spark):
    rng = random.Random(4)
    letters = "abcé"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    names = [(i, " ".join(word(rng.randrange(1, 7)) for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(60, None), (61, ""), (62, "AB-c, d'e")]
    texts = [(q, " ".join(word(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 4)))) for q in range(15)] + [(15, None), (16, "?!"), (17, "AND ab AB")]
    found = search.search_names(spark.createDataFrame(names, "ref long, name string"), spark.createDataFrame(texts, "query long, text string"))
    got = defaultdict(list)
    for r in found.orderBy("query", "rank").collect():
        got[r["query"]].append((r["ref"], r["matched"], r["score"]))
    split = lambda t: list(dict.fromkeys("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()))
    for q, text in texts:
        want = []
        for ref, name in names:
            parts = []
            for term in split(text):
                near = [slips(term, x) for x in split(name)]
                near = [d for d in near if d <= (2 if len(term) >= 3 else 0)]
                if near:
                    parts.append(1 - min(near) / len(term))
            if parts:
                want.append((ref, len(parts), round(sum(parts) / len(split(text)), 6)))
        assert [(r, m, pytest.approx(s, abs=2e-6)) for r, m, s in sorted(want, key=lambda x: (-x[2], x[0]))] == got[q]
    top = search.search_names(spark.createDataFrame(names, "ref long, name string"), spark.createDataFrame(texts, "query long, text string"), 2)
    assert all(top.where(f"query = {q}").count() == min(2, len(got[q])) for q in (0, 1, 16))


# Components


def test_the_rows_of_a_hub_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 50)
    rng = random.Random(5)
    rows = [(0, i) for i in range(1, 2001)] + [(i, rng.randrange(5000, 9000)) for i in range(3000, 3400)]
    both = spark.createDataFrame(rows, "a long, b long").repartition(4)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    told = components._with_least(both, least, len(rows)).withColumn("task", F.spark_partition_id()).collect()
    m = {a: min(y for x, y in rows if x == a) for a, _ in rows}
    assert sorted((r["a"], r["b"], r["m"]) for r in told) == sorted((a, b, m[a]) for a, b in rows)
    assert len({r["task"] for r in told if r["a"] == 0}) == 4
    of = {}
    for a, b in rows:
        joined = {x for x, c in of.items() if c in (of.get(a, a), of.get(b, b))} | {a, b}
        of |= dict.fromkeys(joined, min(of.get(a, a), of.get(b, b)))
    found = components.connected_components(both)
    assert {r["node"]: r["component"] for r in found.collect()} == of
