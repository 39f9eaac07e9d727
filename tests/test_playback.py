"""Declared orders of play against a plain reading of the text."""

import random
import re
from collections import Counter

from loomline.operators import playback


def plain(text):
    """(visits, lines played) of one document."""
    order, sections, at, seen = None, {}, "", []
    for n, line in enumerate(text.split("\n")):
        if m := re.match(r"\*>\[([^\]]+)\]", line):
            order = order or [s.strip() for s in m[1].split(",")]
        elif m := re.match(r"\*>([A-Za-z0-9]+)\s*$", line):
            at = m[1]
            sections.setdefault(at, [])
            seen.append(at)
        else:
            sections.setdefault(at, []).append(n)
            seen.append(at)
    order = order or list(dict.fromkeys(seen))
    counts, out = Counter(), []
    for place, s in enumerate(order):
        m = re.match(r"([A-Za-z]+)(\d+)$", s)
        number = int(m[2]) if m and m[1] + ("2" if m[2] == "1" else "1") in sections else 0
        for n in sections[s] if s in sections else [None]:
            out.append((place, s, n, counts[s], counts[s] > 0, number))
        counts[s] += 1
    return order, sections, out


def test_played_lines_equal_a_plain_reading(spark):
    rng = random.Random(41)
    texts = []
    for _ in range(60):
        names = rng.sample(["A", "B", "B1", "B2", "C", "D2", "X"], rng.randint(0, 5))
        lines = [f"intro {k}" for k in range(rng.randrange(3))]
        for name in names:
            lines += [f"*>{name}", *(f"{name} {k}" for k in range(rng.randrange(4)))]
        if rng.random() < 0.7:
            lines.insert(rng.randrange(len(lines) + 1), "*>[" + ", ".join(rng.choices([*names, "B1", "Q"], k=rng.randint(1, 6))) + "]\t*>[Z]")
        texts.append("\n".join(lines))
    texts.append("*>[A,A]\n*>A\nx\n*>[B]\ny\n*>A\nz")
    rows = [(d, n, line) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, line string").repartition(3)
    found = sorted(map(str, (tuple(r) for r in playback.played(lines).collect())))
    want = [(d, p, s, n, o, r, e) for d, t in enumerate(texts) for p, s, n, o, r, e in plain(t)[2]]
    assert found == sorted(map(str, want))
    ratios = {r.doc_id: r for r in playback.expansion(lines).collect()}
    for d, t in enumerate(texts):
        order, sections, _ = plain(t)
        expanded = sum(len(sections.get(s, [])) for s in order)
        original = sum(len(sections.get(s, [])) for s in set(order))
        if d in ratios:
            r = ratios[d]
            assert (r.original, r.expanded, r.undeclared, r.has_repeats) == (original, expanded, sum(s not in sections for s in order), len(order) > len(set(order)))
            assert r.ratio == (expanded / original if original else None)
        else:
            assert not order
