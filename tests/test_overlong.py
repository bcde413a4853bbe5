"""Parts of overlong units against a search that spells out both sides of every boundary, and known sentences."""

import random
import string

from cueloom.operators import overlong

WORD = "unit long, word_no long, text string, start_ms long, end_ms long"


def norm(w):
    return w[1].strip().lower().strip(string.punctuation + "“”‘’")


def span(words):
    return words[-1][3] - words[0][2]


def worth(left, right):
    a, b, text = norm(left[-1]), norm(right[0]), left[-1][1].strip()
    if text[-1] in ".!?。！？…":
        return 1000
    if text[-1] in ",;:，；：—–":
        return 760
    for score, words in ((900, overlong.STRONG), (620, overlong.MEDIUM), (420, overlong.WEAK)):
        if b in words:
            return score
    return 320 if a in overlong.STRONG else 100


def choose(words, longest):
    target = span(words) / 2 if span(words) <= longest * 2.2 else longest
    best, best_score = None, None
    for k in range(1, len(words)):
        left, right = words[:k], words[k:]
        a, b = norm(left[-1]), norm(right[0])
        if not a or not b or a in overlong.PREPOSITIONS + overlong.ARTICLES + overlong.STRANDED or b in overlong.PREPOSITIONS:
            continue
        x, y = span(left), span(right)
        score = worth(left, right) * 1000
        score += 180_000 if max(x, y) <= longest else 80_000 if max(x, y) <= longest * 1.15 else -120 * (max(x, y) - longest * 1.15)
        score -= abs(x - target) * 18
        score -= sum(180_000 * (len(c) < 3) + 120_000 * (span(c) < 1000) for c in (left, right))
        if best is None or score > best_score:
            best, best_score = k, score
    return best


def split(words, longest, force):
    if len(words) < 2 or (not force and span(words) <= longest * 1.15):
        return [words]
    k = choose(words, longest)
    return [words] if k is None else split(words[:k], longest, False) + split(words[k:], longest, False)


def dangling(chunk):
    norms = [norm(w) for w in chunk]
    return norms[-1] in overlong.PREPOSITIONS and tuple(norms[-2:]) not in overlong.IDIOMS


def plain(words, longest):
    words = [w for w in words if w[1].strip()]
    if not words:
        return []
    if span(words) <= longest:
        return [(words[0][0], words[-1][0])]
    chunks = split(words, longest, True)
    for _ in range(8):
        merged = [*chunks[:-2], chunks[-2] + chunks[-1]] if len(chunks) > 1 and dangling(chunks[-1]) else chunks
        again = [part for c in merged for part in (split(c, longest, False) if len(c) > 1 and span(c) > longest * 1.15 else [c])]
        if again == chunks:
            break
        chunks = again
    if len(chunks) > 1 and dangling(chunks[-1]) and span(chunks[-2] + chunks[-1]) <= longest * 2.5:
        chunks = [*chunks[:-2], chunks[-2] + chunks[-1]]
    return [(c[0][0], c[-1][0]) for c in chunks]


def test_parts_against_plain_search(spark):
    draw = random.Random(2)
    stock = "we the model because, of learn it. and so on about then that is training isn't well, … data to x ' ".split(" ")
    units = {}
    for unit in range(250):
        at, words = 0, []
        for k in range(draw.randint(1, 45)):
            length = draw.randint(50, 600)
            words.append((k, draw.choice(stock), at, at + length))
            at += length + draw.choice([0, 40, 300])
        if unit % 3 == 0:
            words += [(100, "thinking", at, at + 200), (101, draw.choice(["about", "of", "to"]), at + 250, at + 400)]
        units[unit] = words
    df = spark.createDataFrame([(u, *w) for u, ws in units.items() for w in ws], WORD).repartition(3)
    got = {}
    for r in overlong.split_overlong(df, ["unit"], 4000).collect():
        got.setdefault(r.unit, []).append((r.part, r.first_word, r.last_word))
    for u, ws in units.items():
        assert [x[1:] for x in sorted(got.get(u, []))] == plain(ws, 4000), u
    assert sum(len(x) > 2 for x in got.values()) > 80


def sentence(text, each=400):
    return [(k, w, k * each, k * each + each - 50) for k, w in enumerate(text.split())]


def test_known_sentences(spark):
    said = {
        1: "I spent most of last year on this because I wanted to know how these models really learn from data",
        2: "We talked a lot about the new kind of training data that people are thinking about",
        3: "nothing is being corrupted here",
    }
    df = spark.createDataFrame([(u, *w) for u, t in said.items() for w in sentence(t)], WORD)
    parts = overlong.split_overlong(df, ["unit"], 5000)
    units = spark.createDataFrame([(1, "I spent most of last year on this -- you know -- because I wanted to know how these models really learn from data."), (2, "other words"), (3, None)], "unit long, text string")
    got = {(r.unit, r.part): r.text for r in overlong.part_texts(parts, df, units, ["unit"]).collect()}
    assert got[1, 1] == "I spent most of last year on this -- you know --" and got[1, 2].startswith("because I wanted")
    assert got[3, 1] == said[3]
    second = [t for (u, _), t in sorted(got.items()) if u == 2]
    assert " ".join(second) == said[2] and not any(t.split()[0] in overlong.PREPOSITIONS for t in second)
    assert overlong.split_overlong(df.limit(0), ["unit"]).collect() == []


def test_units_are_no_groups_of_their_own(spark):
    df = spark.createDataFrame([(1, 0, "a", 0, 9000), (2, 0, " ", 0, 1)], "unit long, word_no long, text string, start_ms long, end_ms long")
    parts = overlong.split_overlong(df, ["unit"])
    assert [tuple(r) for r in parts.collect()] == [(1, 1, 0, 0, 0, 9000)]
    assert "FlatMapGroups" not in parts._jdf.queryExecution().executedPlan().toString()
