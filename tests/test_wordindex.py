"""Texts and sequences found again, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import wordindex

WORD = "unit long, word_no long, text string, start_ms long, end_ms long"
CHUNK = "unit long, chunk_no long, lines array<string>, start_ms long"


def bare(text):
    return "".join(c for c in (text or "").lower() if c.isalpha() or c.isdigit())


def plain(words, lines, own, cps):
    """By characters, each of which remembers its word."""
    lines = [line or "" for line in lines or []]
    owner = [k for k, w in enumerate(words) for _ in bare(w[1])]
    whole, text = "".join(bare(w[1]) for w in words), bare("".join(lines))
    head, tail = (bare(lines[0]), bare(lines[-1])) if lines else ("", "")
    reading = max(sum(map(len, lines)) * 1000 // cps, 800)
    span = None
    if text and (at := whole.find(text)) >= 0:
        span = at, at + len(text)
    elif text:
        a, b = whole.find(head) if head else 0, whole.rfind(tail) if tail else len(whole)
        if a >= 0 and b > a:
            span = a, b + len(tail)
    if not span:
        return None, None, 0, own, own + reading
    i, j = owner[span[0]], owner[span[1] - 1]
    return words[i][0], words[j][0], j - i + 1, words[i][2], max(words[j][3], words[i][2] + reading)


def test_find_words_against_plain_loops(spark):
    draw = random.Random(4)
    texts = ["The", "quick,", "fox", "-", "", None, "ran!", "ran", "好", "的", "3.5", "É", "fox"]
    units, chunks = {}, []
    for unit in range(150):
        at, words = 0, []
        for k in range(draw.randint(1, 14)):
            words.append((k * 2, draw.choice(texts), at, at + draw.randint(0, 500)))
            at += 600
        units[unit] = words
        for c in range(4):
            a = draw.randint(0, len(words) - 1)
            b = draw.randint(a, len(words) - 1)
            some = [w[1] or "" for w in words[a : b + 1]]
            middle = draw.randint(0, len(some))
            lines = [" ".join(some[:middle]), " ".join(some[middle:])]
            if c == 1:
                lines = [lines[0].upper(), "zz", lines[1]]
            chunks.append((unit, c, draw.choice([lines, lines, lines, lines, ["FOX"], [None, "ran"], [], None]), 77))
    chunks.append((999, 0, ["lost"], 5))
    words = spark.createDataFrame([(u, *w) for u, ws in units.items() for w in ws], WORD).repartition(3)
    out = wordindex.find_words(words, spark.createDataFrame(chunks, CHUNK), ["unit"], 9).collect()
    got = {(r.unit, r.chunk_no): tuple(r)[2:] for r in out}
    assert got == {(u, c): plain(units.get(u, []), lines, own, 9) for u, c, lines, own in chunks} and len(out) == len(chunks)
    assert sum(v[2] > 0 for v in got.values()) > 200


def in_order(line, words):
    at, out = 0, []
    for w in words:
        while at < len(line) and line[at] != w:
            at += 1
        if at == len(line):
            return None
        out.append(at)
        at += 1
    return out


@pytest.mark.parametrize("longest", [12, 40_000])
def test_sequences_in_order_against_plain_loops(spark, longest):
    draw = random.Random(longest)
    rows = []
    for k in range(200 if longest < 100 else 3):
        line = [draw.choice("abc") for _ in range(draw.randint(0, longest) if longest < 100 else longest)]
        words = [x for x in line if draw.random() < 0.6] if k % 2 == 0 else [draw.choice("abcd") for _ in range(draw.randint(0, 5))]
        rows.append((k, line, words))
    df = spark.createDataFrame([*rows, (-1, None, ["a"]), (-2, ["a"], None)], "k long, line array<string>, words array<string>")
    got = {r.k: (r.at, r.holds) for r in df.select("k", wordindex.match_in_order("line", "words").alias("at"), wordindex.contains_in_order(F.col("line"), F.col("words")).alias("holds")).collect()}
    assert got.pop(-1) == got.pop(-2) == (None, False)
    assert got == {k: (in_order(line, words), bool(words) and in_order(line, words) is not None) for k, line, words in rows}
