"""Token counts under a unigram model, by trie-shared dynamic programming.

A text is cut into pre-tokens by the pattern; a pre-token has as many tokens as its most probable
split into pieces of the vocabulary (of splits that are as probable, one of the fewest pieces).
Pieces are weighted by Zipf's law over their ranks: the probability of a piece is in proportion to
1 / (rank + 1).

The distinct pre-tokens of the corpus meet in tasks by hash (see ``wordshuffle``) and are inserted
in a trie there. The best score of a prefix is worked out when its node is made, from the nodes of
the shorter prefixes on the way, so a prefix that many pre-tokens share is scored once; the number
of tokens is stored with the node where a pre-token ends. A trie that has grown to ``TRIE_NODES``
is started anew, which bounds its memory and changes no result.

Cases: a null or empty text has no tokens; a vocabulary without some byte counts that byte as one
token with the score of the rarest piece; repeated rows and null keys each keep a row; other
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm import bpe
from cueloom.llm import wordshuffle as ws

TRIE_NODES = 1_500_000


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Logarithms of the pieces' probabilities, up to a constant; every single byte is a piece."""
    last = max(ranks.values(), default=0)
    return {bytes([b]): -math.log(last + 2) for b in range(256)} | {piece: -math.log(rank + 1) for piece, rank in ranks.items()}


class ScoreTrie:
    """A trie of pre-tokens with the best split of every prefix."""

    def __init__(self, scores: dict[bytes, float], most: int = TRIE_NODES) -> None:
        self.scores, self.most = scores, most
        #: What can be the end of a piece: a longer tail than these need not be looked up.
        self.tails = {piece[k:] for piece in scores for k in range(len(piece))}
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]
        self.ends: dict[int, int] = {}  # number of tokens of the pre-tokens that end at a node

    def insert(self, word: bytes) -> int:
        """The number of tokens of the pre-token, which is in the trie from then on."""
        if len(self.score) > self.most:
            self.reset()
        child, node, path = self.child, 0, [0]
        for depth, byte in enumerate(word, 1):
            edge = node << 8 | byte
            node = child.get(edge, -1)
            if node < 0:
                node = child[edge] = self._add(word, depth, path)
            path.append(node)
        self.ends[node] = self.tokens[node]
        return self.ends[node]

    def _add(self, word: bytes, depth: int, path: list[int]) -> int:
        """A node for word[:depth]; path: the nodes of its shorter prefixes."""
        best, fewest = -math.inf, 0
        for start in range(depth - 1, -1, -1):
            tail = word[start:depth]
            if tail not in self.tails:
                break
            if (own := self.scores.get(tail)) is not None:
                total, n = self.score[path[start]] + own, self.tokens[path[start]] + 1
                if total > best or (total == best and n < fewest):
                    best, fewest = total, n
        self.score.append(best)
        self.tokens.append(fewest)
        return len(self.score) - 1


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", block_chars: int = ws.BLOCK_CHARS) -> DataFrame:
    """(key, n_tokens, n_pretokens, n_bytes) of every row of ``docs``."""
    name = bpe.send_ranks(docs, ranks_path)
    names = (key, "n_tokens", "n_pretokens", "n_bytes")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])

    def block() -> ws.Block:
        cut = bpe.Pretokens(pattern)
        return ws.Block(cut.split, cut.words, cut.whole)

    def work() -> Callable[[list[bytes], list[np.ndarray]], list[np.ndarray]]:
        trie = ScoreTrie(piece_scores(bpe.load_ranks(name)))
        known: dict[bytes, int] = {}

        def counts_of(words: list[bytes], _: list[np.ndarray]) -> list[np.ndarray]:
            if len(known) > bpe.KNOWN:
                known.clear()
            for word in sorted(set(words).difference(known)):
                known[word] = trie.insert(word)
            return [np.array([known[word] for word in words]), np.array([len(word) for word in words])]

        return counts_of

    def finish(rows: pa.StructArray, sizes: np.ndarray, word: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        ends = ws.spans(sizes)
        sums = [np.diff(ws.spans(c[word])[ends]) for c in columns] or [np.zeros(len(sizes), np.int64)] * 2
        return pa.table([rows.field(0), pa.array(sums[0]), pa.array(sizes.astype(np.int64)), pa.array(sums[1])], names=names)

    cells = ws.to_cells(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), block, block_chars=block_chars)
    return ws.join_back(ws.each_word(cells, work), finish, schema)
