"""Display times against plain loops over one medium's cues."""

import random

import pytest

from cueloom.operators import pacing

CUE = "media_id long, lang string, cue_no long, text string, start_ms long, end_ms long, merged boolean"
WORD = "media_id long, word_no long, start_ms long, end_ms long, confidence double, cue_no long"
GAP = 105


def shortest_again(c, least):
    for i, x in enumerate(c):
        lack = least - (x["e"] - x["s"])
        if lack > 0:
            after = c[i + 1]["s"] - x["e"] - GAP if i + 1 < len(c) else 0
            before = x["s"] - c[i - 1]["e"] - GAP if i else 0
            forward = min(lack, max(0, after))
            x["e"] += forward
            x["s"] -= min(lack - forward, max(0, before))


def entry(x, words):
    near = sorted((w for w in words if x["s"] - 50 <= w[1] <= x["e"] + 50), key=lambda w: (w[1], w[0]))
    if len(near) < 2:
        return
    first, peak = near[0][3], max(w[3] for w in near[1:6])
    if first < 0.4 and peak >= 0.7 and peak - first >= 0.3:
        good = next((w[1] - 100 for w in near if w[3] > 0.5), None)
        if good is not None and 80 <= good - x["s"] <= 1500:
            x["s"] = good
        return
    for k in range(len(near) - 1):
        steady = k + 2 == len(near) or near[k + 2][1] - near[k + 1][2] <= 1500
        if near[k + 1][1] - near[k][2] > 1500 and steady and near[k + 1][1] - 100 - x["s"] >= 80 and near[k + 1][3] >= 0.45:
            x["s"] = near[k + 1][1] - 100
            return


def plain(cues, words, least=800, most=7000, padding=300):
    c = [dict(no=no, lang=lang, n=len((text or "").replace("\n", "")), s=s, e=e, merged=bool(merged)) for _, lang, no, text, s, e, merged in cues]
    for x in c:
        if x["e"] - x["s"] < least:
            x["e"] = x["s"] + least
        elif x["e"] - x["s"] > most and not x["merged"]:
            x["e"] = x["s"] + most
    for x, y in zip(c, c[1:]):
        gap = y["s"] - x["e"]
        if gap < 0:
            both = x["n"] + y["n"]
            x["e"] = y["s"] + (-gap * x["n"] // both if both else 0)
        elif 0 < gap < 150:
            x["e"] = (x["e"] + y["s"] - GAP) // 2
            y["s"] = x["e"] + GAP
    for i, x in enumerate(c):
        limit, span = 9 if x["lang"] == "zh" else 25, x["e"] - x["s"]
        lack = -(-x["n"] * 1000 // limit) - span
        if not x["merged"]:
            lack = min(lack, max(0, most - span))
        if span <= 0 or lack <= 0:
            continue
        after = max(0, c[i + 1]["s"] - x["e"] - GAP) if i + 1 < len(c) else 0
        before = max(0, x["s"] - c[i - 1]["e"] - GAP) if i else 0
        if lack <= after:
            x["e"] += lack
        elif lack <= after + before:
            x["s"] -= min(lack, before)
            x["e"] += lack - min(lack, before)
    for x, y in zip(c, c[1:]):
        push = max(0, GAP - (y["s"] - x["e"]))
        y["s"], y["e"] = y["s"] + push, y["e"] + push
    for i, x in enumerate(c):
        x["e"] += min(padding, max(0, c[i + 1]["s"] - x["e"] - GAP)) if i + 1 < len(c) else padding
    shortest_again(c, least)
    if words:
        for i, x in enumerate(c):
            own = [w for w in words if w[4] == x["no"]]
            if not own:
                continue
            said, silent = min(w[1] for w in own), max(w[2] for w in own)
            following = c[i + 1]["s"] if i + 1 < len(c) else None
            if x["s"] - said > 100 and (not i or said - c[i - 1]["e"] >= GAP):
                x["s"] = said
            if silent - x["e"] > 100 and (following is None or following - silent >= GAP):
                x["e"] = silent
            if x["e"] - silent > padding + 500:
                x["e"] = silent + padding + 500 if following is None else min(silent + padding + 500, following - GAP)
        for x in c:
            entry(x, words)
        shortest_again(c, least)
    return [(x["no"], x["s"], x["e"]) for x in c]


def medium(seed):
    """Cues close together, overlapping, too short and too long, with words that stray from them."""
    draw = random.Random(seed)
    cues, words, at, no = [], [], 0, 0
    lang = draw.choice(["zh", "en"])
    for k in range(1, draw.randint(2, 40)):
        start, span = at + draw.choice([-300, -40, 0, 60, 120, 400, 1500]), draw.choice([200, 700, 900, 1500, 3000, 8000])
        text = draw.choice([None, "", "ab\ncd", "x" * draw.randint(1, 90)])
        cues.append((seed, lang, k, text, start, start + span, draw.choice([None, False, True])))
        for _ in range(draw.randint(0, 6)):
            no += 1
            s = start + draw.randint(-600, span + 900)
            words.append((no, s, s + draw.randint(20, 900), draw.randint(0, 100) / 100, draw.choice([k, k, None])))
        at = start + span
    return cues, words


@pytest.mark.parametrize("with_words", [False, True])
def test_pace_against_plain_loops(spark, with_words):
    media = [medium(seed) for seed in range(60)]
    cues = spark.createDataFrame([c for m in media for c in m[0]], CUE).repartition(4)
    words = spark.createDataFrame([(seed, *w) for seed, m in enumerate(media) for w in m[1]], WORD).repartition(4)
    out = pacing.pace(cues, words if with_words else None).collect()
    want = {(seed, *row) for seed, m in enumerate(media) for row in plain(m[0], m[1] if with_words else [])}
    assert {(r.media_id, r.cue_no, r.start_ms, r.end_ms) for r in out} == want and len(out) == len(want)


def test_time_is_borrowed_along_a_chain(spark):
    """The second cue takes of the gap after it, so that the third finds less before it and takes the rest after."""
    text = lambda seconds: "x" * (25 * seconds)
    rows = [(1, "en", 1, text(1), 0, 1000, False), (1, "en", 2, text(2), 1105, 2105, False), (1, "en", 3, text(4), 3705, 5705, False), (1, "en", 4, "ab", 7400, 8400, False)]
    out = {r.cue_no: (r.start_ms, r.end_ms) for r in pacing.pace(spark.createDataFrame(rows, CUE), padding=0).collect()}
    assert out[2] == (1105, 3105) and out[3] == (3210, 7210)
    assert [out[k] for k in (1, 2, 3, 4)] == [r[1:] for r in plain(rows, [], padding=0)]


def test_pace_of_nothing(spark):
    assert pacing.pace(spark.createDataFrame([], CUE), spark.createDataFrame([], WORD)).collect() == []
