"""Routes by each kind of evidence, and every violation."""

import random
from bisect import bisect_right

import pytest

from loomline.operators.routes import resolved_routes

KIND = (
    "k long, official array<array<bigint>>, adjudication struct<status: string, operation: string, drops: array<bigint>, route: array<bigint>, evidence: map<bigint, array<bigint>>>, "
    "aligned boolean, wanted int, count long, expanded array<bigint>, pickup boolean, downbeats array<double>, undefined_times array<double>"
)


def plain(official, adjudication, aligned, wanted, count, expanded, pickup, downbeats, times, fallback):
    """(provenance, groups, inserted, undefined, violation), decided step by step."""
    use, violation, groups = fallback and adjudication is not None, None, []
    status, operation, drops, route, evidence = adjudication or (None,) * 5
    if use and status != "user_approved":
        violation = "not_approved"
    if official is not None:
        provenance, groups = "official", official
        if use:
            provenance = "user_approved_official_adjustment"
            if violation is None:
                if operation != "drop_official_positions":
                    violation = "unsupported_operation"
                elif drops is None:
                    violation = "invalid_drops"
                elif any(not 0 <= i < len(official) for i in drops):
                    violation = "drop_out_of_range"
                elif any(i in drops and official[i] != g for i, g in (evidence or {}).items()):
                    violation = "evidence_changed"
                else:
                    groups = [g for i, g in enumerate(official) if i not in drops]
    elif use:
        provenance = "user_approved_fallback"
        if violation is None and route is None:
            violation = "no_route"
        groups = [[x] for x in route or []]
    elif aligned:
        found = []
        for label, r in (("written", list(range(count))), ("expanded", expanded)):
            if r is not None:
                r = r[1:] if pickup and r and r[0] == 0 else r
                if len(r) == wanted and r not in [x for _, x in found]:
                    found.append((label, r))
        provenance = found[0][0] if found else None
        groups = [[x] for x in found[0][1]] if found else []
        violation = "no_candidate" if not found else "ambiguous_route" if len(found) > 1 else None
    else:
        provenance, groups = "source_written_unaligned", [[x] for x in range(count)]
    if violation is None:
        if any(not g for g in groups):
            violation = "empty_group"
        elif any(not 0 <= x < count for g in groups for x in g):
            violation = "ordinal_out_of_range"
    if violation:
        return provenance, None, None, None, violation
    inserted = bool(pickup and groups and 0 not in groups[0])
    groups = [[0], *groups] if inserted else groups
    places = {0 if (i := bisect_right(downbeats, t) - 1) < 0 else i + inserted for t in times}
    return provenance, groups, inserted, sorted(p for p in places if p < len(groups)), None


@pytest.mark.parametrize("fallback", [True, False])
def test_routes_equal_a_plain_reading(spark, fallback):
    rng, rows = random.Random(61), []
    for k in range(1500):
        count = rng.randint(0, 4)
        ordinals = lambda n: [rng.randrange(-1 if rng.random() < 0.1 else 0, count + 1 if rng.random() < 0.1 else max(count, 1)) for _ in range(n)]  # noqa: E731, B023
        official = [ordinals(rng.choice([0, 1, 1, 1, 2])) for _ in range(rng.randint(0, 3))] if rng.random() < 0.4 else None
        drops = None if rng.random() < 0.1 else [rng.randrange(-1, 4) for _ in range(rng.randint(0, 2))]
        evidence = {rng.randrange(3): rng.choice([[0], official[0] if official else [1]])} if rng.random() < 0.4 else None
        adjudication = (rng.choice(["user_approved"] * 6 + ["pending", None]), rng.choice(["drop_official_positions"] * 6 + ["other", None]), drops, None if rng.random() < 0.2 else ordinals(rng.randint(0, 3)), evidence) if rng.random() < 0.4 else None
        expanded = None if rng.random() < 0.4 else rng.choice([list(range(count)), ordinals(rng.randint(0, 4))])
        downbeats = sorted(rng.random() * 9 for _ in range(rng.randint(0, 4)))
        rows.append((k, official, adjudication, rng.choice([True, False, None]), rng.randint(0, 4), count, expanded, rng.random() < 0.5, downbeats, [rng.random() * 9 for _ in range(rng.randint(0, 2))] + downbeats[:1]))
    found = {r.k: r for r in resolved_routes(spark.createDataFrame(rows, KIND), fallback).collect()}
    seen = set()
    for k, *row in rows:
        want = plain(*row, fallback)
        r = found[k]
        assert (r.provenance, r.groups, r.pickup_inserted, r.undefined, r.violation) == want, (row, want)
        seen |= {want[0], want[4]}
    assert {"official", "written", "expanded", "source_written_unaligned", None, "no_candidate", "ambiguous_route", "empty_group", "ordinal_out_of_range"} <= seen
    if fallback:
        assert {"user_approved_official_adjustment", "user_approved_fallback", "not_approved", "unsupported_operation", "invalid_drops", "drop_out_of_range", "evidence_changed", "no_route"} <= seen
