"""Matches and groups against plain loops."""

import random

from cueloom.operators import matching

PAIR = "m long, a long, b long, w long"
CUE = "media_id long, lang string, cue_no long, text string, start_ms long, end_ms long"


def greedy(pairs):
    used_a, used_b, out = set(), set(), set()
    for w, a, b in sorted(((-w, a, b) for a, b, w in pairs)):
        if a not in used_a and b not in used_b:
            out.add((a, b))
            used_a.add(a)
            used_b.add(b)
    return out


def test_heaviest_pairs_against_greedy(spark):
    draw = random.Random(6)
    rows = [(m, draw.randint(0, 9), draw.randint(0, 9), draw.randint(1, 5)) for m in range(12) for _ in range(25)]
    best = {}
    for m, a, b, w in rows:
        best[m, a, b] = max(w, best.get((m, a, b), 0))
    # A chain in which each pair waits for the one before it.
    rows += [(99, k, k + d, 100 - 2 * k - d) for k in range(6) for d in (0, 1)] + [(99, None, 1, 500), (99, 1, 2, None)]
    best |= {(99, k, k + d): 100 - 2 * k - d for k in range(6) for d in (0, 1)}
    got = [tuple(r) for r in matching.heaviest_pairs(spark.createDataFrame(rows, PAIR), ["m"], "a", "b", "w").collect()]
    want = {(m, a, b) for m in {k[0] for k in best} for a, b in greedy([(a, b, w) for (n, a, b), w in best.items() if n == m])}
    assert set(got) == want and len(got) == len(want)
    assert matching.heaviest_pairs(spark.createDataFrame([], PAIR), ["m"], "a", "b", "w").collect() == []


def plain_groups(cues, known):
    t = [c for c in cues if c[1] == "zh"]
    s = [c for c in cues if c[1] == "en"]
    fixed_t, fixed_s = {a for a, _ in known}, {b for _, b in known}
    pairs = [(x[2], y[2], min(x[5], y[5]) - max(x[4], y[4])) for x in t for y in s if x[2] not in fixed_t and y[2] not in fixed_s]
    partner = greedy([p for p in pairs if p[2] > 0]) | set(known)
    of = {}
    for a, b in partner:
        of.setdefault(a, []).append(b)
    groups = [(x[4], False, x[2], b, x[5]) for x in t for b in sorted(of.get(x[2], [None]), key=lambda v: v or 0)]
    groups += [(y[4], True, y[2], y[2], y[5]) for y in s if y[2] not in {b for _, b in partner}]
    groups.sort(key=lambda g: g[:3] + (g[3] or 0,))
    out, before = [], -1
    for k, (start, lone, no, b, end) in enumerate(groups):
        if lone:
            if before > 0:
                start = max(start, before + 10)
            if k + 1 < len(groups) and end > groups[k + 1][0] - 10:
                end = max(start + 10, groups[k + 1][0] - 10)
            if start >= end:
                continue
        out.append((len(out) + 1, None if lone else no, b, start, end))
        before = end
    return out


def test_groups_against_plain_loops(spark):
    draw = random.Random(9)
    media, known = {}, []
    for m in range(60):
        rows = []
        for lang in ("en", "zh"):
            at = 0
            for k in range(1, draw.randint(1, 14)):
                at += draw.choice([0, 100, 400, 900])
                rows.append((m, lang, k, "x", at, at + draw.choice([5, 300, 1000, 2500])))
        media[m] = rows
        numbers = {lang: [r[2] for r in rows if r[1] == lang] for lang in ("en", "zh")}
        if m % 3 == 0 and numbers["en"] and numbers["zh"]:
            known += [(m, draw.choice(numbers["zh"]), draw.choice(numbers["en"]))]
    cues = spark.createDataFrame([r for rows in media.values() for r in rows], CUE).repartition(3)
    for pairs in ([], known):
        out = matching.bilingual_groups(cues, known=spark.createDataFrame(pairs, "media_id long, target_no long, source_no long") if pairs else None).collect()
        got = {}
        for r in out:
            got.setdefault(r.media_id, []).append(tuple(r)[1:])
        for m, rows in media.items():
            assert sorted(got.get(m, [])) == plain_groups(rows, [(a, b) for n, a, b in pairs if n == m]), m
