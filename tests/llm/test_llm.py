"""Each operator against brute force, with the cases its docstring defines."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cueloom.llm import bpe, components, decontam, embeddup, html, langid, mixing, sharding, simhash, tokencount, warc
from cueloom.llm import wordshuffle as ws
from cueloom.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
DOC = "doc_id long, text string, lang string, extra string, key string"
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n\n a", "a\n b", "it's 's  's", "x\x1cy \x1c z", "\x85a \x85", "a　b", "日本語 テキスト", "😀😀 a😀", "\x00 \x00", None, "<|endoftext|> a", "ſ   x", "a\r\n\r\n b\t\tc", "١٢٣ ²½", "x" * 3000, " " * 200 + "y", "same", "same"]


def docs(spark, texts, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[k], "x", "y") for k, (i, t) in enumerate(zip(ids, texts))], DOC).coalesce(2)


# 1


def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("block", [1, 100, 10_000_000])
def test_bpe_as_tiktoken(spark, block):
    ids = bpe.encode(docs(spark, ODD, [k % 5 or None for k in range(len(ODD))]), PATH, public_tokenizers.PATTERN, block_chars=block)
    got = sorted((bytes(r.decoded), r.ids) for r in bpe.decode(ids, PATH).collect())
    assert got == sorted(((t or "").encode(), encoder().encode_ordinary(t or "")) for t in ODD)


def test_bpe_edges(spark):
    assert bpe.encode(docs(spark, ["a"]).limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    rows = spark.createDataFrame([(1, [64, None, 999_999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()}
    word = {v: k for k, v in RANKS.items()}[64]
    assert got == {1: word + "��".encode(), 2: None, 3: b""}
    row = bpe.digests(bpe.encode(docs(spark, ["one two"]), PATH, public_tokenizers.PATTERN), PATH).first()
    want = encoder().encode_ordinary("one two")
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"one two").hexdigest())


# 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x = "</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>no</p> -->
<div id="cookie-notice"><p>We use cookies on this site to make it better for you and for all of the people who come here.</p></div>
<div class="content"><h2>Head &amp; tail</h2><p>It was the best of times, it was the worst&nbsp;of times,\n and that is what there was to say about it all.<p>Short one.</p><p>He had been to the town and it was what they said that it would be when we were there with the others.</p>
<p><a href="q">Read more of what is in the archive of this site and of the others</a></p></div>
<div class="comments"><p>I think this is the best of all that I have read about it on the web, and so it is.</p></div>
<form>Search for what you want to have <input></form><footer>All of the rights are with the owners of the site and with no one else in the world.</footer></body></html>"""


PASSAGE = "<p>" + "This is the story of the people who lived in the town and of what they did when the river was high. " * 3 + "</p>"


@pytest.mark.parametrize(("inside", "want"), [
    ("<p>When the cookies are brown at the edges you should take them out, and let each cookie cool before you accept praise.</p>", ["When the cookies are brown at the edges you should take them out, and let each cookie cool before you accept praise."]),
    ("<p>Most bakers agree that cookies are best when they are warm.</p>", ["Most bakers agree that cookies are best when they are warm."]),
    ("<p>The recipe that we use <svg><text>x</text></svg> is the one of <math><mi>a</mi></math> and <button>Copy</button> we like <select><option>a<option>b</select> it.</p>", ["The recipe that we use is the one of a and we like it."]),
    ('<p class="share-price">The share price fell by two per cent after the news.</p>', ["The share price fell by two per cent after the news."]),
    ('<div class="search-results">The search results that the team had found were of no use to them.</div>', ["The search results that the team had found were of no use to them."]),
    ('<div class="share-buttons">Share Tweet</div><div class="related-posts"><p>Read this too</p></div><button><div>Subscribe</div></button><p>Short end.</p>', ["Short end."]),
    ("<p>Unclosed <button>Copy</p><p>After it there is text.</p>", ["Unclosed", "After it there is text."]),
    ("<p>One <object><p>fallback</p></object> sentence of the text</p>", ["One sentence of the text"]),
    ("<p>One <button/> sentence of <canvas>no</canvas>the text</p>", ["One sentence of the text"]),
])
def test_html_inside_a_marked_article(inside, want):
    page = f"<html><body><nav>Home About</nav><article>{PASSAGE}{inside}{PASSAGE}</article><footer>c</footer></body></html>"
    plain = " ".join(PASSAGE[3:-4].split())
    assert html.main_text(page).split("\n\n") == [plain, *want, plain]


def test_html_notices_need_more_than_words():
    plain = " ".join(PASSAGE[3:-4].split())
    notice = "<div>We use cookies to improve. <button>Accept</button></div>"
    linked = "<div><p>We use cookies, do you accept? <a href=x>more</a></p></div>"
    said = "<p>The cookies that we use to bake are those that most of them accept.</p>"
    page = f"<body>{notice}{PASSAGE}{PASSAGE}{said}{PASSAGE}{PASSAGE}{linked}{PASSAGE}</body>"
    assert html.main_text(page).split("\n\n") == [plain, plain, said[3:-4], plain, plain, plain]


def test_html_by_rules():
    assert html.main_text(PAGE) == "Head & tail\n\nIt was the best of times, it was the worst of times, and that is what there was to say about it all.\n\nShort one.\n\nHe had been to the town and it was what they said that it would be when we were there with the others."


def test_html_articles_and_broken_pages(spark):
    page = "<nav>menu of the site</nav><article><h1>T</h1><p><b>Zx qv.<br><p>Kw &lt;b&gt; zz&copy;<aside>no</aside></article><div class=ad>the of and to in is it that was for on are as with</div>"
    assert html.main_text(page) == "T\n\nZx qv.\n\nKw <b> zz©"
    for broken in ("<p", "<!-- open", "<script>x", "a < b", "</p></div>", "<p class='x>y", "<" * 50, "&#0;&bogus;", ""):
        assert isinstance(html.main_text(broken), str)
    rows = spark.createDataFrame([(1, "u", page, "z"), (1, "u", page, "z"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.n_chars, r.text, r.page_id) for r in html.extract(rows).collect())
    assert got[0] == (0, "", None) and got[1] == got[2] and got[1][0] == len(got[1][1])
    assert html.extract(rows.limit(0)).count() == 0


PROSE = "It was the best of times, it was the worst of times, and that is what there was to say about it all, as they had said to us."
MORE = "He had been to the town and it was what they said that it would be when we were there with the others in the rain."


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar"><p>{0}</p><p>{1}</p></div><div class="sidebar"><p>{0}</p></div>',
        '<article class="post comments-open"><p>{0}</p><p>{1}</p></article>',
        '<main class="skip-link-target"><p>{0}</p><p>{1}</p></main>',
        '<form id="aspnetForm"><div><p>{0}</p><p>{1}</p></div><input></form>',
        '<body class="page sidebar"><div class="share-wrapper"><div><p>{0}</p><p>{1}</p></div></div>',
        "<p>{0}</p><p>{1}</p><div><p>We use cookies to make this site better for you. Accept them all, or read what they are for.</p></div>",
        "<article><p>{0}</p><p>{1}</p><div><h3>2 Comments</h3><p>I think that this is the best of all that I have read about it on the web, and so it is.</p></div></article>",
        '<div><p>{0}</p><p>{1}</p></div><div class="comment-list"><p>{1}</p></div><form><p>{0}</p><input></form>',
    ],
)
def test_html_keeps_main_text_whatever_it_is_called(page):
    assert html.main_text(page.format(PROSE, MORE)) == f"{PROSE}\n\n{MORE}"


def test_html_in_languages_without_listed_stop_words():
    russian = "Вчера вечером мы пошли в магазин, чтобы купить хлеб, молоко и яблоки, но он был уже закрыт, и мы вернулись домой."
    chinese = "昨天晚上我们去商店买面包、牛奶和苹果，可是商店已经关门了，所以我们只好回家，第二天早上再去。路上还下起了大雨。"
    for text in (russian, chinese):
        page = f'<ul><li><a href="/">{text[:9]}</a></li></ul><h1>{text[:12]}</h1><div><p>{text}</p><p>{text[::-1]}</p></div><p><a href="/a">{text}</a></p>'
        assert html.main_text(page) == f"{text[:12]}\n\n{text}\n\n{text[::-1]}"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</section>" * 20_000, "<td>x" * 20_000, "<p>" * 20_000 + "</p>" * 20_000, "<li><div>x" * 20_000, "<h2>2 comments</h2>" + "<div>x" * 5_000, "<section>" + "<ul>" * 10_000 + "<p>x</ol>" * 10_000])
def test_html_takes_linear_time(page):
    import time

    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 1


def test_html_without_names_against_the_marked_article(spark):
    """The driver's pages with the names of elements and classes taken out, against their articles."""
    path = "/root/testdata/sf0.001/pages.parquet"
    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    both = sizes = 0
    for r in spark.read.parquet(path).where("html is not null").collect():
        want = html.main_text(r.html).split()
        plain = regex.sub(r"<(/?)(article|nav|footer|aside|header|main)\b[^>]*>", r"<\1div>", regex.sub(r' (class|id)=("[^"]*"|[^ >]*)', "", r.html))
        got = html.main_text(plain).split()
        both += 2 * sum((Counter(want) & Counter(got)).values())
        sizes += len(want) + len(got)
    assert both > 0.9 * sizes


# 3


def brute_contamination(texts, items, window):
    out = []
    for text in texts:
        words = decontam.words_of((text or "").encode())
        hit, found = [False] * len(words), set()
        for item, body in items:
            own = decontam.words_of((body or "").encode())
            for p in range(max(1, len(own) - window + 1) if own else 0):
                w = own[p : p + window]
                for q in range(len(words) - len(w) + 1):
                    if words[q : q + len(w)] == w:
                        found.add(item)
                        hit[q : q + len(w)] = [True] * len(w)
        out.append((len(words), sum(hit), sorted(x for x in found if x is not None)))
    return out


@pytest.mark.parametrize("shard", [1, 40, 100_000])
def test_fm_index_against_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    texts = [None, "", "!!!"] + [" ".join(rng.choice(list("AabcZ"), rng.integers(0, 50))) for _ in range(40)]
    texts += [texts[10]] * 5
    items = [("1", "a b c a b c"), ("10", "A b"), ("2", None), (None, "c c c"), ("3", "a b c a b z a"), ("10", "z z z z z z z z")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, texts), bench, window=4, shard_words=shard).collect()}
    for k, (n, hits, found) in enumerate(brute_contamination(texts, items, 4)):
        assert (got[k]["n_words"], sum(s["end"] - s["start"] for s in got[k]["spans"]), got[k]["items"]) == (n, hits, found)


def test_decontamination_in_chunks_and_edges(spark, monkeypatch):
    texts = ["one two three four", "x one two y three four", None]
    bench = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "four")], "item_id long, text string")
    whole = sorted(map(repr, decontam.verdicts(decontam.contamination(docs(spark, texts), bench)).collect()))
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 5)
    assert sorted(map(repr, decontam.verdicts(decontam.contamination(docs(spark, texts), bench)).collect())) == whole
    row = decontam.verdicts(decontam.contamination(docs(spark, texts), bench.limit(0))).where("doc_id = 0").first()
    assert (row.n_hit, row.n_items, row.contaminated, row.items_sha256) == (0, 0, False, hashlib.sha256(b"").hexdigest())


# 4


def test_token_counts_against_brute_force(spark):
    scores = tokencount.piece_scores(RANKS)
    longest = max(map(len, scores))

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[k][0] + scores[word[k:end]], best[k][1] - 1) for k in range(max(0, end - longest), end) if word[k:end] in scores))
        return -best[-1][1]

    got = sorted((r.n_bytes, r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(docs(spark, ODD), PATH, public_tokenizers.PATTERN, block_chars=50).collect())
    cut = [[w.encode() for w in regex.findall(public_tokenizers.PATTERN, t or "")] for t in ODD]
    assert got == sorted((len((t or "").encode()), len(w), sum(map(count, w))) for t, w in zip(ODD, cut))
    small, large = tokencount.ScoreTrie(scores, most=3), tokencount.ScoreTrie(scores)
    assert [small.insert(w) for ws_ in cut for w in ws_] == [large.insert(w) for ws_ in cut for w in ws_]
    assert tokencount.count_tokens(docs(spark, ["a"]).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


# 5


def test_lm_base_score_and_counts(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [None, "", "  "] + [" ".join(rng.choice(vocabulary, rng.integers(1, 80), p=np.arange(40, 0, -1) / 820)) for _ in range(150)] + ["Never seen, Ünïcode"]
    x = docs(spark, texts, langs=["en", None, "de"] * 51 + ["fr"]).withColumn("held_out", langid.held_out(F.col("doc_id"), 7))
    got = {r.doc_id: r for r in mixing.score(x, block_chars=500).collect()}
    counts = Counter(t for k, text in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for t in mixing.tokens_of((text or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    for k, text in enumerate(texts):
        tokens = mixing.tokens_of((text or "").encode())
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.bits_per_byte > 0 for r in held)
    empty = mixing.score(x.where("doc_id < 0"))
    assert empty.count() == 0
    untrained = mixing.score(x.withColumn("held_out", F.lit(True))).collect()
    assert len(untrained) == len(texts) and all(r.train_tokens == 0 and np.isfinite(r.score) for r in untrained)


def brute_logs(texts, training):
    """The model's specification decision by decision, with exact contexts in dictionaries."""
    spelled = [mixing.spelled(t) for t in texts]
    pairs = np.zeros((256, 256), dtype=np.int64)
    for s in (s for s, own in zip(spelled, training) if own):
        for a, b in zip(b"\x00" + s, s):
            pairs[a, b] += 1
    code = mixing.Code.of(pairs)
    paths = [[(int(code.node[k]), int(code.bit[k])) for k in range(code.starts[b], code.starts[b] + code.lengths[b])] for b in range(1 << 16)]
    lengths = {b: len(p) for b, p in enumerate(paths)}
    for a in b" a":  # a prefix code is full, and no other full one is shorter by swapping two bytes
        assert sum(0.5 ** lengths[a << 8 | b] for b in range(256)) == 1
        assert all(lengths[a << 8 | b] >= lengths[a << 8 | c] for b in range(256) for c in range(256) if pairs[a, b] < pairs[a, c])
    path_of = lambda s, k: paths[(s[k - 1] if k else 0) << 8 | s[k]]

    def contexts(s, k):
        first = s.rfind(b" ", 0, k) + 1
        before = s[s.rfind(b" ", 0, first - 1) + 1 : first - 1] if first > 1 else b""
        before_known = (before[-7:], len(before)) if first else None
        return [(0, s[max(0, k - 3) : k]), (1, s[max(0, k - 5) : k]), (2, s[first:k][-7:], k - first, before_known)]

    seen = {}
    for s, own in zip(spelled, training):
        for k in range(len(s) if own else 0):
            for context in contexts(s, k):
                for node, bit in path_of(s, k):
                    seen.setdefault((context, node), [0, 0])[bit] += 1
    out = []
    for s in spelled:
        weights, moved = {}, {}
        shift, shifted = {}, {}
        total, k, edges = 0.0, 0, mixing.steps_to(len(s)).tolist()
        for end in edges[1:]:
            up, up_shift = {}, {}
            for k in range(k, min(end, len(s))):
                for node, bit in path_of(s, k):
                    x, gate = [], 0
                    for context in contexts(s, k):
                        n = seen.get((context, node), [0, 0])
                        gate += sum(n) > 0
                        x.append(max(-mixing.MOST_ODDS, min(mixing.MOST_ODDS, math.log((n[bit] + mixing.PRIOR) / (n[1 - bit] + mixing.PRIOR)))))
                    w = [weights.get((gate, i), 1.1 / max(1, gate)) for i in range(3)]
                    mixed = sum(a * b for a, b in zip(w, x))
                    bucket, sign = min(int(abs(mixed) * 2), mixing.BUCKETS - 1), (mixed > 0) - (mixed < 0)
                    p = 1 / (1 + math.exp(-max(-14, min(14, mixed + sign * shift.get(bucket, 0.0)))))
                    total += math.log(p)
                    for i in range(3):
                        up[gate, i] = up.get((gate, i), 0.0) + (1 - p) * x[i]
                    up_shift[bucket] = up_shift.get(bucket, 0.0) + (1 - p) * sign
            k = min(end, len(s))
            for key, u in up.items():
                moved[key] = moved.get(key, 1.0) + u * u
                weights[key] = weights.get(key, 1.1 / max(1, key[0])) + mixing.RATE * u / math.sqrt(moved[key])
            for key, u in up_shift.items():
                shifted[key] = shifted.get(key, 1.0) + u * u
                shift[key] = shift.get(key, 0.0) + mixing.RATE * u / math.sqrt(shifted[key])
        out.append(total)
    return out


def small_model(texts):
    spelled = [mixing.spelled(t) for t in texts]
    code = mixing.Code.of(mixing.pair_counts(spelled).reshape(256, 256))
    tables = [np.zeros(2 << bits, dtype=np.int64) for bits in mixing.BITS]
    mixing.count(spelled, code, tables)
    return mixing.Model(code, [mixing.states_of(t) for t in tables])


def test_lm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 64)
    rng = np.random.default_rng(55)
    words = "the a cat dog sat on mat über 漢字 internationalisation, x".split()
    texts = ["", None, "  \t ", "One Two"] + [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(12)]
    texts += [texts[6], texts[6], " ".join(rng.choice(words, 900))]
    held = [k % 4 == 1 for k in range(len(texts))]
    x = docs(spark, texts).withColumn("held_out", F.col("doc_id") % 4 == 1).withColumn("log", F.lit("clash")).withColumn("training", F.lit(1))
    got = {r.doc_id: r.score for r in mixing.score(x, block_chars=500).collect()}
    want = brute_logs([(t or "").encode() for t in texts], [not h for h in held])
    for k, log in enumerate(want):
        assert got[k] == pytest.approx(log / math.log(10), rel=0.02, abs=1e-4), k


def test_lm_is_a_probability():
    texts = [b"the cat sat on the mat", "über\x00".encode(), b"the dog sat"]
    model = small_model(texts)
    for before in (b"", b"the c", b"the cat the cat the cat the c" * 3):
        ends = [before + bytes([b]) for b in range(256)]
        last = model.logs(ends) - (model.logs([before])[0] if before else 0.0)
        assert np.exp(last).sum() == pytest.approx(1, abs=1e-4)
    some = [b"the cat sat ", b"x", b"the mat " * 30, b"the mat " * 3000]
    together = model.logs(some)
    alone = [model.logs([t])[0] for t in some]
    assert together == pytest.approx(alone, rel=1e-6)


def test_lm_counts_bytes_that_come_again_at_once(monkeypatch):
    text = mixing.spelled(b"The cat sat on the mat, the cat sat again")
    code = mixing.Code.of(mixing.pair_counts([text] * 500).reshape(256, 256))
    once, often = ([np.zeros(2 << bits, dtype=np.int32) for bits in mixing.BITS] for _ in range(2))
    mixing.count([text], code, once)
    asked, decisions = [], mixing.Code.decisions
    monkeypatch.setattr(mixing.Code, "decisions", lambda self, pairs, *rest: asked.append(len(pairs)) or decisions(self, pairs, *rest))
    mixing.count([text] * 500, code, often)
    assert sum(asked) <= mixing.CONTEXTS * len(text)  # it was the bytes of all 500
    assert sum(int(t.sum()) for t in once) > 0 and all((500 * a == b).all() for a, b in zip(once, often))


def test_lm_tokens():
    texts = [b"", b" \t\r\n", b"One two  ONE\x0b\x0ctwo", "\x00Ü \x1c \x85über".encode(), b" a\n\nB " * 300, b"x"]
    spelled = [mixing.spelled(t) for t in texts]
    assert spelled == [b"".join(w if w == mixing.END else w + b" " for w in mixing.tokens_of(t)) for t in texts]
    block = mixing.Tokens()
    for k, t in enumerate(spelled):
        block.add((k,), t)
    codes, sizes = block.tokens()
    want = [mixing.tokens_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert [block.names.order[c] for c in codes.tolist()] == [w for own in want for w in own] and len(block.names) == len(set(block.names.order))


def test_lm_states():
    pairs = [(0, 0), (3, 11), (14, 0), (7, 8), (10**6, 3 * 10**6), (0, 10**9)]
    states = mixing.states_of(np.array(pairs).ravel())
    odds = mixing.stretched().reshape(2, 256)
    for (zero, one), s in zip(pairs, states):
        want = max(-mixing.MOST_ODDS, min(mixing.MOST_ODDS, math.log((one + mixing.PRIOR) / (zero + mixing.PRIOR))))
        assert odds[1, s] == pytest.approx(want, abs=1e-5 if zero + one <= mixing.EXACT else 0.1)
        assert odds[0, s] == -odds[1, s]


def test_lm_outcomes_of_training_rows_add_up_to_one(spark):
    """A row scores alike whether training has seen it or not, if it was there either way."""
    texts = ["the cat sat on the mat again and again", "a dog ran over the hill to the cat", "the cat sat on the mat again and again"]
    x = docs(spark, texts).withColumn("held_out", F.col("doc_id") == 2)
    got = {r.doc_id: r.score for r in mixing.score(x).collect()}
    assert got[0] == got[2]


def test_lm_reads_the_running_text(spark):
    rng = np.random.default_rng(50)
    follows = rng.permutation(60)

    def walk(n):
        out = [int(rng.integers(60))]
        while len(out) < n:
            out.append(int(follows[out[-1]] if rng.random() < 0.9 else rng.integers(60)))
        return [f"{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}{k}" for k in out]

    train, held = [walk(60) for _ in range(60)], [walk(60) for _ in range(10)]
    mixed = [list(rng.permutation(words)) for words in held]
    x = docs(spark, [" ".join(words) for words in train + held + mixed]).withColumn("held_out", F.col("doc_id") >= 60)
    rows = {r.doc_id: r for r in mixing.score(x, block_chars=500).collect()}
    ordered, shuffled, base = (sum(rows[k][c] for k in range(a, a + 10)) for a, c in ((60, "score"), (70, "score"), (60, "base_score")))
    assert ordered > 0.5 * shuffled and ordered > 0.5 * base  # the same words


# 6


def test_language_id(spark):
    rng = np.random.default_rng(6)
    parts = {"en": "the and ing tion er of to".split(), "de": "der und sch ein ung über ich".split(), "fr": "le que ment eau é à des".split()}
    rows = [(lang, " ".join("".join(rng.choice(p, 2)) for _ in range(rng.integers(3, 40)))) for lang, p in parts.items() for _ in range(60)]
    texts = [t for _, t in rows] + [None, "", "123 !?", "the and of"]
    langs = [lang for lang, _ in rows] + ["en", None, "en", None]
    x = docs(spark, texts, langs=langs)
    model = langid.train(x.where(~langid.held_out(F.col("doc_id"))), sample=30)
    got = {r.doc_id: r for r in langid.predict(x, model).collect()}
    held = [k for k in range(180) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].lang_pred == langs[k] for k in held]) > 0.95
    assert [(got[k].lang_pred, got[k].score, got[k].rejected) for k in (180, 181, 182)] == [("und", 0.0, True)] * 3
    assert got[183].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.predict(x, langid.train(x.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(texts)
    assert langid.predict(x.limit(0), model).count() == 0


# 7


@pytest.mark.parametrize("tile", [40, 4096])
def test_embeddings_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddup, "TILE_ROOT", 1)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(15, 12))
    rows = [(k, [float(x) for x in (base[rng.integers(0, 15)] + rng.normal(size=12) * rng.choice([0, 0.02, 0.13, 0.2])).astype(np.float32)], int(rng.integers(0, 2))) for k in range(250)]
    rows += [(250, None, 0), (251, [0.0] * 12, 0), (252, [float("nan")] * 12, 0), (253, [1.0, None], 1), (254, [1.0, 2.0], 1), (255, [2.0, 4.0], 1), (256, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (257, [], 1), (258, [3e38, 3e38], 1), (254, [1.0, 2.0], 1)]
    got = embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), tile=tile).collect()
    fine = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    forest, links = components.Forest(), Counter()
    for a, x in enumerate(fine):
        for b, y in enumerate(fine[a + 1 :], a + 1):
            if x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1]), np.array(y[1])
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    if None not in (x[0], y[0]):
                        forest.join(x[0], y[0])
    want = sorted((str(r[0]), links[k], str(forest.find(r[0])) if r[0] is not None else "254") for k, r in enumerate(fine))
    want += [(str(r[0]), 0, str(r[0])) for r in rows if r not in fine]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id and r.vec_id is not None) for r in got)


def test_embeddings_keep_labels_and_precision(spark):
    rows = [(1, [1e-50, 0.0], 1.2, "a"), (2, [2e-50, 0.0], 1.2, "a"), (3, [1e300, 0.0], 1.7, "a"), (4, [1e300, 1e200], 1.7, "b"), (5, [1.0, 0.0], None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d double, s string")
    of = lambda label: {r.vec_id: r.component_id for r in embeddup.near_duplicates(table, label=label).collect()}
    assert of("d") == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert of("s") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert embeddup.near_duplicates(table.limit(0), label="s").count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddup.quantise(x)
    off = np.abs((q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :] - x @ x.T)
    assert (off <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


# 8


@pytest.mark.parametrize("bucket", [20, 4096])
def test_simhash_links_against_brute_force(spark, bucket):
    rng = np.random.default_rng(8)
    values = {0, 2**64 - 1}
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(40):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            values.add(x)
    values = np.array(sorted(values), dtype=np.uint64)
    signed = [int(v) for v in values.view(np.int64)]
    forest = components.Forest()
    for k, v in enumerate(values):
        for n in np.flatnonzero(np.bitwise_count(values ^ v) <= 2):
            forest.join(signed[k], signed[int(n)])
    found = components.components(simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket))
    got = {r.node: r.component for r in found.collect()}
    assert all(got.get(v, v) == forest.find(v) for v in signed)


def test_simhash_fingerprints_and_edges(spark):
    texts = [None, "", " \t", "One", "one", "a b c d", "A b C d", "a b c d e f g h", "x　y z w"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    for k, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[p : p + 3]) for p in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[k].fingerprint == f"{want:016x}"
    assert [got[k].component_id for k in (0, 1, 2)] == [0, 0, 0] and got[4].component_id == 3 and got[6].component_id == 5
    with_null = simhash.near_duplicates(docs(spark, ["q w e", "q w e", "lone"], [None, 7, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in with_null) == [("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5), (None, 3), (2000, 1001)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000, 2000: 1000}


# 9


def test_warc_round_trip(spark):
    rows = [(1, "http://a\nb", "x"), (2, None, "x"), (None, "u", "x"), (3, "é", None), (4, "q", "é\r\n\r\nz"), (4, "q", "é\r\n\r\nz"), (5, "", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "test-warc")
    warc.write_archive(pages, path)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(spark, path).collect()]
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 1, digest("x"), "response", None), (2, 1, digest("x"), "revisit", 1), (None, 1, digest("x"), "revisit", 1), (3, 0, digest(""), "response", None), (5, 0, digest(""), "revisit", 3)]
    body = "é\r\n\r\nz"
    want += [(4, 7, digest(body), "response", None), (4, 7, digest(body), "revisit", 4)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    records = warc.parse_records(warc.read_records(spark, path)).collect()
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(regex.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size:] == b"\r\n\r\n" and r.warc_type == r.record_type and (r.refers_to_id is None) == (r.warc_type == "response")
    assert {bytes(r.payload).decode() for r in records if r.payload is not None} == {"x", "", body}
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    large = scratch_path(spark, "test-warc")
    warc.write_archive(pages, large, min_bytes=2)
    assert Counter(r.record_type for r in warc.report(spark, large).collect()) == {"response": 6, "revisit": 1}
    empty = scratch_path(spark, "test-warc")
    warc.write_archive(pages.limit(0), empty)
    assert warc.report(spark, empty).count() == 0


def test_warc_notices_damage(spark):
    path = scratch_path(spark, "test-warc")
    spark.createDataFrame([("00", bytearray(b"x"))], "address string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, path).collect()


# 10


def test_sharding(spark):
    texts = ["t" * (k % 50) for k in range(3000)] + [None, "é", "same", "same", "x" * 20_000]
    ids = list(range(3000)) + [None, None, 5, 5, 9999]
    path = scratch_path(spark, "test-map")
    got = sharding.assign(docs(spark, texts, ids), 24, map_path=path).collect()
    size = Counter()
    places = {}
    for r in got:
        size[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(texts) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    # One record is larger than a shard's due and has its shard to itself, but for what hashes with it.
    rest = sorted(size[s] for s in range(24))[:-1]
    assert max(size.values()) < 20_008 + 500 and max(rest) - min(rest) <= 100
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    maps = [{(r.slot, r.piece): r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (0, 1)]
    assert all(len({s for s, _ in m}) == sharding.SLOTS for m in maps) and maps[0] != maps[1]
    assert all(maps[1][r.virtual_slot, r.piece] == r.shard for r in got)
    assert sharding.assign(docs(spark, ["a"]).limit(0), 24).count() == 0


@pytest.mark.parametrize("copy", ["c" * 100, None])
def test_sharding_of_repeated_rows(spark, copy):
    texts = ["t" * (k % 200) for k in range(1000)] + [copy] * 1000
    rows = docs(spark, texts, list(range(1000)) + [7 if copy else None] * 1000).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    got = sharding.assign(rows, 24).collect()
    size, n = Counter(), Counter()
    for r in got:
        size[r.shard] += r["size"]
        n[r.shard] += 1
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 208
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in range(24))


def test_growing_moves_slots_only_into_the_new_shard():
    rng = np.random.default_rng(10)
    sizes = rng.integers(1, 100, 500).tolist()
    before = sharding.rebalance(sizes, [k % 4 for k in range(500)], 4)
    after = sharding.grow(sizes, before, 4)
    assert all(a == b or a == 4 for a, b in zip(after, before))
    load = [sum(s for s, d in zip(sizes, after) if d == shard) for shard in range(5)]
    assert max(load) - min(load) < 0.05 * sum(load)


def test_blocks_and_cells_round_trip():
    rng = np.random.default_rng(0)
    block = ws.Block(lambda t: t.split(), lambda w: [w.encode()])
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 30))) for _ in range(20)] + [None]
    for k, t in enumerate(texts):
        block.add((k,), t)
    (_, _, _, head), *cells = ws.block_cells(block, 0, 3)
    sizes, word = ws.read_head(head)
    names = [w for _, _, _, cell in cells for w in ws.read_words(ws.unpack(cell)[0][0], ws.unpack(cell)[1])]
    assert [names[k].decode() for k in word] == " ".join(t or "" for t in texts).split()
    assert sizes.tolist() == [len((t or "").split()) for t in texts]
