"""Plans that hold at size: nothing that is cut from a small table is broadcast, nothing is made for each window or each pair."""

import random

import pytest
from conftest import SF

from helixspark import queries_dna, queries_misc, queries_plans
from helixspark.operators import alignment
from helixspark.plans import intervals

QUERIES = {**queries_dna.QUERIES, **queries_plans.QUERIES, **queries_misc.QUERIES}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mer32_search", "exact_match_genome", "group_matches", "match_evaluate", "pcr_primer_hits", "pcr_products", "pcr_unique"])
def test_pieces_are_not_broadcast(spark, name):
    """Spark takes exploded words for as small as their table's file."""
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["primer_candidates", "primer_best", "oligo_left", "oligo_compromise", "oligo_tasks"])
def test_windows_are_made_in_arrays(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert "MapInArrow" in found and "Generate" not in found


def test_pairs_of_one_shape_are_aligned_together(monkeypatch):
    rng = random.Random(3)
    a = ["".join(rng.choice("ACGT") for _ in range(rng.choice((4, 20, 40)))) for _ in range(200)]
    b = [(s[: (at := rng.randint(0, len(s)))] + rng.choice(("", "A", "GT")) + s[at + rng.randint(0, 2) :]) for s in a]
    for k, width, scores in ((3, 6, alignment.Scores()), (4, 11, alignment.Scores(1, -1, -2, -1)), (10, 24, alignment.Scores())):
        assert alignment.align_all(a, b, k, width, scores) == [alignment.align(x, y, k, width, scores) for x, y in zip(a, b, strict=True)]


def test_nearest_gene_of_crowded_points(spark):
    rng = random.Random(5)
    features = [(rng.choice((i, i // 2)), rng.randint(0, 1), l := rng.randint(-40, 900), l + rng.choice((-1, 0, 30, 300, 700)), rng.random() < 0.5, rng.choice(("ORF", "CDS", None)), rng.choice(("a", "bb", None))) for i in range(300)]
    points = [(rng.choice((i, i // 3)), rng.randint(0, 2), rng.randint(-600, 2500)) for i in range(400)]
    fs = spark.createDataFrame(features, "id long, chr long, l long, r long, fwd boolean, type string, description string")
    ps = spark.createDataFrame(points, "point_id long, chr long, pos long")
    inside = {p: [f for f in features if f[1] == p[1] and f[2] <= p[2] <= f[3]] for p in points}
    covered = {p[0] for p in points if inside[p]}
    assert {r.point_id for r in intervals.lonely(ps, fs, "point_id").collect()} == {p[0] for p in points} - covered
    low = lambda x: (x is not None, x if x is not None else 0)
    want = {}
    for p in points:
        for i, _, l, r, fwd, kind, text in inside[p]:
            rank = (low(None if kind is None else kind == "ORF"), low(None if text is None else len(text)), -i, p[2] - l if fwd else r - p[2])
            want[p[0]] = max(want.get(p[0], rank), rank)
    found = {r.point_id: (r.feature_id, r.rel) for r in intervals.nearest_gene(ps, fs).collect()}
    assert {k: found[k] for k in covered} == {k: (-v[2], v[3]) for k, v in want.items()}
    assert "Join" not in plan(intervals._best_inside(ps, fs, "point_id"))


def crowd(spark, seed):
    """Features and points, many of which share their places, some features ending before they begin; the same as frames."""
    rng = random.Random(seed)
    places = [(rng.randint(0, 2), l := rng.randint(-40, 20_000), l + rng.choice((-9, -1, 0, 30, 300)), rng.random() < 0.5) for _ in range(60)]
    features = [(i // 2, *rng.choice(places), rng.choice(("ORF", "CDS")), rng.choice(("a", "bb", None))) for i in range(400)]
    spots = [(rng.randint(0, 3), rng.choice((rng.randint(-600, 30_000), rng.choice(places)[1] + rng.randint(-3, 3)))) for _ in range(80)]
    points = [(i // 3 if i < 60 else i, *rng.choice(spots)) for i in range(400)]
    fs = spark.createDataFrame(features, "id long, chr long, l long, r long, fwd boolean, type string, description string")
    return features, points, fs, spark.createDataFrame(points, "point_id long, chr long, pos long")


def found_by_sql(features, points):
    """Pairs as the SQL of the queries has them."""
    inside = [(p, f) for p in points for f in features if f[1] == p[1] and f[2] <= p[2] <= f[3]]
    held = {p[0] for p, _ in inside}
    near = []
    for p in points:
        own = [f for f in features if f[1] == p[1]]
        if p[0] not in held and own:
            x = min(own, key=lambda f: (f[2] - p[2], 0, f[3]) if f[2] > p[2] else (p[2] - f[3], 1, -f[2]))
            near += [(p, f) for f in own if f[2:4] == x[2:4]]
    return inside, near


@pytest.mark.parametrize("seed", [1, 2])
def test_find_features_meets_places_once(spark, monkeypatch, seed):
    monkeypatch.setattr(intervals, "TOGETHER", 3)
    features, points, fs, ps = crowd(spark, seed)
    inside, near = found_by_sql(features, points)
    assert inside and near
    df = intervals.find_features(ps, fs)
    assert df.columns == ["point_id", "chr", "pos", "id", "l", "r", "fwd", "type", "description"]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str((*p, f[0], *f[2:])) for p, f in inside + near)


@pytest.mark.parametrize("name", ["feature_find", "nearest_gene"])
def test_frames_of_the_nearest_features_grow(spark, name):
    """A frame that shrinks is looked at as a whole for each of its rows."""
    assert "unboundedfollowing" not in plan(QUERIES[name](spark, SF)).lower()


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_gene_looks_at_places_once(spark, monkeypatch, seed):
    features, points, fs, ps = crowd(spark, seed)
    seen, best_inside = [], intervals._best_inside
    monkeypatch.setattr(intervals, "_best_inside", lambda p, f, *a: seen.extend((p.count(), f.count())) or best_inside(p, f, *a))
    inside, near = found_by_sql(features, points)
    want = {}
    for p, f in inside + near:
        _, _, pos, (i, _, l, r, fwd, kind, text) = *p, f  # noqa: E741
        rel = (pos - r + 100_000 if pos > r else pos - l) if fwd else (l - pos + 100_000 if pos < l else r - pos)
        rank = (kind == "ORF", -1 if text is None else len(text), -i, rel)
        want[p[0]] = max(want.get(p[0], rank), rank)
    found = {r.point_id: (r.feature_id, r.rel) for r in intervals.nearest_gene(ps, fs).collect()}
    assert found == {k: (-v[2], v[3]) for k, v in want.items()}
    assert seen == [len({p[1:] for p in points}), len({f[1:5] for f in features})]
