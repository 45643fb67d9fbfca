"""Route and area planning against plain searches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wavemesh.functions import geo
from wavemesh.operators import planning

RADIO = geo.Radio()


def high(lat, lon, m=math):
    """The ground, for floats or columns: ridges that run north and south."""
    return 150 + 140 * m.sin(lat * 25) * m.cos(lon * 60)


def ground(lat, lon):
    return high(lat, lon, F)


def far(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(x))


def margin(a, b, km=35.0):
    d = far(a, b)
    if not 0.01 <= d <= km:
        return -math.inf
    n, tx, rx, worst = min(max(int(d / 0.05), 8), 300), high(*a) + RADIO.antenna_m, high(*b) + RADIO.rx_height_m, -math.inf
    for i in range(1, n):
        f = i / n
        d1 = d * 1000 * f
        d2 = d * 1000 - d1
        over = high(a[0] + (b[0] - a[0]) * f, a[1] + (b[1] - a[1]) * f) - d1 * d2 / (2 * geo.REFRACTION * geo.EARTH_KM * 1000) - (tx + (rx - tx) * f)
        worst = max(worst, over * math.sqrt(2 / (geo.LIGHT / 868e6) * (1 / d1 + 1 / d2)))
    loss = 20 * math.log10(d) + 20 * math.log10(868) + 32.44
    return RADIO.budget_db - loss - (6.9 + 20 * math.log10(math.sqrt((worst - 0.1) ** 2 + 1) + worst - 0.1) if worst > -0.78 else 0)


def plain_bridge(a, b, target, most_new, beam, reach, steps, rings, angles):
    per_lon = geo.KM_PER_LON * math.cos(math.radians((a[0] + b[0]) / 2))
    states = [(math.inf, a, [])]
    for step in range(most_new + 1):
        done = [(-round(min(w, margin(cur, b)), 9), i, sites, min(w, margin(cur, b))) for i, (w, cur, sites) in enumerate(states) if margin(cur, b) >= target]
        if done:
            return min(done)[2:]
        ahead = []
        for w, cur, sites in states if step < most_new else []:
            d, taken = far(cur, b), 0
            off = min(15, d * 0.15)
            for i in range(steps, 0, -1):
                spots = []
                for r in range(rings + 1):
                    for k in range(angles if r else 1):
                        t = 2 * math.pi * k / angles
                        p = (cur[0] + (b[0] - cur[0]) * i / steps + r / rings * math.cos(t) * off / geo.KM_PER_LAT, cur[1] + (b[1] - cur[1]) * i / steps + r / rings * math.sin(t) * off / per_lon)
                        if (m := margin(cur, p)) >= target:
                            spots.append((-high(*p), r, k, p, m))
                if spots and taken < reach:
                    taken += 1
                    _, _, _, p, m = min(spots)
                    ahead.append((-round(min(w, m), 9), round(far(p, b), 9), p, min(w, m), [*sites, p]))
        states = [(w, p, sites) for _, _, p, w, sites in sorted(ahead, key=lambda x: x[:3])[:beam]]
        if not states:
            return None
    return None


def test_bridges_equal_a_plain_search(spark, beam=3, reach=2):
    rnd = random.Random(21)
    gaps = [(f"g{i}", 56 + rnd.random() / 2, -4 + rnd.random() / 2, target) for i, target in enumerate([12.0, 6.0, 0.0, 12.0, 25.0, 0.0])]
    gaps = [(g, lat, lon, lat + rnd.uniform(-0.25, 0.25), lon + rnd.uniform(0.1, 0.5), t) for g, lat, lon, t in gaps]
    search = {"most_new": 2, "beam": beam, "reach": reach, "steps": 4, "rings": 1, "angles": 6}
    df = spark.createDataFrame(gaps, "gap string, lat1 double, lon1 double, lat2 double, lon2 double, target double")
    got = {r.gap: ([(s.lat, s.lon) for s in r.sites], r.weakest) for r in planning.bridged(df, ground, RADIO, **search).collect()}
    want = {g: plain_bridge((a, b), (c, d), t, **search) for g, a, b, c, d, t in gaps}
    want = {g: w for g, w in want.items() if w}
    assert set(got) == set(want) and max(len(s) for s, _ in want.values()) > 1
    for g, (sites, weakest) in want.items():
        assert got[g][1] == pytest.approx(weakest, abs=1e-6) and len(got[g][0]) == len(sites)
        assert max((far(x, y) for x, y in zip(got[g][0], sites, strict=True)), default=0) < 1e-6


def test_ends_are_connected_over_known_links_or_new_sites(spark):
    spots = {1: (56.0, -4.0), 2: (56.01, -3.98), 3: (56.02, -3.5), 4: (56.03, -3.48), 9: (56.9, -1.0)}
    sites = spark.createDataFrame([(i, *p) for i, p in spots.items()], "id long, lat double, lon double")
    known = spark.createDataFrame([(1, 2, 20.0), (4, 3, 14.0)], "a long, b long, margin double")
    ends = spark.createDataFrame([(1, 2), (1, 4), (1, 9)], "a long, b long")
    rows = planning.connected(ends, sites, known, ground, RADIO, targets=(12.0, 6.0), steps=6, rings=2, angles=8, most_new=3).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault((r.a, r.b), []).append(r)
    assert [(r["rank"], r.n_new, r.weakest, r.path_a, r.path_b) for r in by[1, 2]] == [(1, 0, 20.0, [1, 2], [])]
    assert (1, 9) not in by and 1 <= len(by[1, 4]) <= 3
    for r in by[1, 4]:
        chain = [spots[i] for i in r.path_a] + [(s.lat, s.lon) for s in r.sites] + [spots[i] for i in r.path_b]
        assert r.path_a[0] == 1 and r.path_b[-1] == 4 and len(r.sites) == r.n_new >= 1
        new = chain[len(r.path_a) - 1 : len(r.path_a) + r.n_new + 1]
        hops = [margin(x, y) for x, y in zip(new, new[1:], strict=False)]
        assert min(hops) >= r.target - 1e-6 and r.weakest == pytest.approx(min([*hops, *([20.0] if len(r.path_a) > 1 else []), *([14.0] if len(r.path_b) > 1 else [])]), abs=1e-6)
    for i, x in enumerate(by[1, 4]):
        for y in by[1, 4][:i]:
            assert x.n_new != y.n_new or any(far((p.lat, p.lon), (q.lat, q.lon)) > 1 for p, q in zip(x.sites, y.sites, strict=True))


def plain_cover(covers, most):
    left, picks = set().union(*covers.values()) if covers else set(), []
    for _ in range(most):
        gain, minus = max(((len(c & left), -s) for s, c in covers.items()), default=(0, 0))
        if not gain:
            break
        picks.append((-minus, gain))
        left -= covers[-minus]
    return picks


@pytest.mark.parametrize("block", [3])
def test_lazy_cover_picks_as_a_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(planning, "BLOCK", block)
    monkeypatch.setattr(planning, "HELD", 9)
    rnd = random.Random(block)
    covers = {s: {c for c in range(80) if rnd.random() < rnd.choice([0.02, 0.1, 0.3])} for s in range(40)}
    covers |= {50: set(covers[3]), 51: set(covers[3])}  # ties
    rows = spark.createDataFrame([(s, c) for s, cs in covers.items() for c in cs] + [(1, c) for c in covers[1]], "site long, cell long")
    assert planning.lazy_cover(rows, 8) == plain_cover(covers, 8)
    done = spark.range(0, 80, 2).withColumnRenamed("id", "cell")
    assert planning.lazy_cover(rows, 6, done) == plain_cover({s: {c for c in cs if c % 2} for s, cs in covers.items()}, 6)
    assert planning.lazy_cover(rows.where("false"), 3) == []


def test_area_cover_equals_its_parts(spark):
    area = [[[(-4.1, 56.0), (-3.7, 56.0), (-3.7, 56.2), (-4.0, 56.25)]]]
    existing = spark.createDataFrame([(1, 56.05, -3.75)], "site int, slat double, slon double").withColumn("tx_m", ground(F.col("slat"), F.col("slon")) + RADIO.antenna_m)
    rows = sorted(planning.area_cover(existing, area, ground, RADIO, 3, 12.0, 9, 5, attempts=2).collect(), key=lambda r: (r.pick is not None, r.pick))
    samples = [(r.lat, r.lon) for r in planning.grid(spark, area, 9).collect()]
    assert 20 < len(samples) < 81 and rows[0].samples == len(samples)
    done = {i for i, p in enumerate(samples) if margin((56.05, -3.75), p, 12.0) >= 0}
    assert rows[0].before == rows[0].covered == len(done)
    nudge = min(0.4 * geo.KM_PER_LON * math.cos(math.radians(56.125)), 0.25 * geo.KM_PER_LAT) / 5
    best = None
    for phase in (0.0, 0.5):
        spots = planning.uphill(planning.grid(spark, area, 5, phase), area, ground, nudge).collect()
        assert all(r.height >= high(p.lat, p.lon) - 1e-9 for r, p in zip(sorted(spots), sorted(planning.grid(spark, area, 5, phase).collect()), strict=True))
        covers = {r.cell: {i for i, p in enumerate(samples) if i not in done and margin((r.lat, r.lon), p, 12.0) >= 0} for r in spots}
        picks = plain_cover(covers, 3)
        if best is None or sum(n for _, n in picks) > sum(n for _, n in best[0]):
            best = picks, {r.cell: (r.lat, r.lon) for r in spots}
    assert [(r.lat, r.lon, r.gain) for r in rows[1:]] == [(*best[1][s], n) for s, n in best[0]]
    assert rows[-1].covered == len(done) + sum(n for _, n in best[0])


def test_a_thin_area_is_sampled_in_its_middle(spark):
    thin = [[[(-4.0, 56.0), (-3.99, 56.0), (-4.0, 56.0000001)]]]
    assert planning.grid(spark, thin, 3).count() >= 1




def test_groups_of_nodes_connect_as_their_nodes_do(spark):
    """Links between groups and their members give what links between all of their nodes give; ties, loops and all."""
    from wavemesh.operators import links

    rnd = random.Random(8)
    heads, spots, members = [0, 10, 20, 30, 40, 50, 60, 70], {}, []
    for g in heads:
        at = (56 + rnd.random() / 5, -4 + rnd.random() / 2)
        for i in range(g, g + rnd.randint(1, 4)):
            spots[i] = at
            members.append((g, i))
    spots |= {99: (56.3, -3.2), 98: (56.05, -3.9), 97: None}  # without links, or a place
    sites = spark.createDataFrame([(i, *(p or (None, None))) for i, p in spots.items()], "id long, lat double, lon double")
    of = [(a, b, rnd.choice([5.0, 8.0, 8.0, 13.0])) for a in heads for b in heads if a < b and rnd.random() < 0.25] + [(g, g, m) for g, m in zip(heads, (20.0, 7.0, 3.0, 20.0), strict=False)]
    of, members = spark.createDataFrame(of, "a long, b long, margin double"), spark.createDataFrame(members, "grp long, id long")
    ends = spark.createDataFrame([(i, rnd.choice(list(spots))) for i in spots for _ in range(3)], "a long, b long")
    search = {"targets": (12.0, 6.0), "most_hops": 3, "steps": 3, "rings": 1, "angles": 4, "most_new": 1, "tried": 2}
    grouped = planning.connected(ends, sites, of, ground, RADIO, members=members, **search)
    single = planning.connected(ends, sites, links.expanded(of, members), ground, RADIO, **search)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert len(plain(single)) > 20 and plain(grouped) == plain(single)


def test_new_routes_make_no_links_between_single_nodes(spark, monkeypatch):
    """Many nodes at a place make a search for each place, not links of all with all."""
    from wavemesh.operators import graph, links
    from wavemesh.plans.queries import QUERIES

    def refused(*args):
        raise AssertionError("links between all nodes of two places")

    starts, search = [], graph.widest_hops
    monkeypatch.setattr(links, "expanded", refused)
    monkeypatch.setattr(graph, "widest_hops", lambda *args: (starts.append(args[1].count()), search(*args))[1])
    QUERIES["r11_new_routes"](spark, "/root/testdata/sf0.01")
    assert max(starts) <= 200  # places of room servers and of the nodes after them: 1,500 nodes at 1,000 places


def test_all_distinct_routes_stay_without_a_number_of_options(spark):
    rows = [(1, 2, [(56.0, lon)], w) for lon, w in ((-4.0, 9.0), (-3.9, 8.0), (-3.8, 7.0), (-3.7, 6.0), (-3.999, 5.5), (-3.6, 4.0))]
    routes = spark.createDataFrame(rows, f"a long, b long, sites array<{planning.SITE}>, weakest double")
    got = sorted((r["rank"], r.weakest) for r in planning.distinct_routes(routes, None, 5.0).collect())
    assert got == list(enumerate((9.0, 8.0, 7.0, 6.0, 4.0), 1))  # 5.5 has the site of 9.0
    assert planning.distinct_routes(routes, 3, 5.0).count() == 3


def test_attempts_start_from_places_not_from_nodes_of_one_place(spark, monkeypatch):
    """However many nodes a mast holds, each of the nearest places makes an attempt, for each target."""
    spots = {1: (56.0, -4.0), 2: (56.0, -3.98), 3: (56.0, -3.98), 4: (56.0, -3.98), 5: (56.0, -3.99), 9: (56.0, -3.0)}
    sites = spark.createDataFrame([(i, *p) for i, p in spots.items()], "id long, lat double, lon double")
    known = spark.createDataFrame([(1, i, 20.0) for i in (2, 3, 4, 5)], "a long, b long, margin double")
    asked, bridged = [], planning.bridged
    monkeypatch.setattr(planning, "bridged", lambda gaps, *args, **search: (asked.extend(gaps.collect()), bridged(gaps, *args, **search))[1])
    planning.connected(spark.createDataFrame([(1, 9)], "a long, b long"), sites, known, ground, RADIO, targets=(12.0, 6.0), tried=3, steps=3, rings=1, angles=4, most_new=1)
    assert sorted((g.target, g.lon1, g.lon2) for g in asked) == [(t, lon, -3.0) for t in (6.0, 12.0) for lon in (-4.0, -3.99, -3.98)]


def test_new_routes_leave_no_part_of_the_search_out(spark, monkeypatch):
    from wavemesh.operators import coverage
    from wavemesh.plans.queries import QUERIES

    class Seen(Exception):
        pass

    def caught(*args, **search):
        assert search.pop("options") is None and search.pop("most_hops") >= 64 and set(search) == {"members"}
        raise Seen

    made = coverage.kind_links
    monkeypatch.setattr(coverage, "kind_links", lambda *args, **more: (lambda km=35.0: made(*args, **more) if km >= 35.0 else None)(*args[3:], **more))
    monkeypatch.setattr(planning, "connected", caught)
    with pytest.raises(Seen):
        QUERIES["r11_new_routes"](spark, "/root/testdata/sf0.001")


def test_a_bound_of_few_samples_changes_no_bridge(spark, monkeypatch):
    rnd = random.Random(21)
    gaps = [(f"g{i}", 56 + rnd.random() / 2, -4 + rnd.random() / 2, t) for i, t in enumerate([12.0, 6.0, 0.0, 12.0, 25.0, 0.0])]
    df = spark.createDataFrame([(g, a, b, a + rnd.uniform(-0.25, 0.25), b + rnd.uniform(0.1, 0.5), t) for g, a, b, t in gaps], "gap string, lat1 double, lon1 double, lat2 double, lon2 double, target double")
    found = []
    for every in (1, 16):
        monkeypatch.setattr(planning, "COARSE", every)
        found.append(sorted(map(repr, planning.bridged(df, ground, RADIO, most_new=2, beam=2, reach=2, steps=4, rings=1, angles=6).collect())))
    assert found[0] and found[0] == found[1]
