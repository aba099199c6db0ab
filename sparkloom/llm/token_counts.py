"""Token counts: trie-shared dynamic programming over distinct pre-tokens.

A unigram tokenizer splits each pre-token into the pieces with the highest summed score. The forward score of a prefix
(best score, fewest pieces) depends on the prefix alone, so pre-tokens are inserted in a trie and each shared prefix is
scored once; the node that ends a pre-token stores its piece count. Pre-tokens never leave their task: the work is one
map without any shuffle, and a task's trie is emptied when it reaches its bound.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Scores are whole numbers of this many parts, so that sums do not depend on their order.
PARTS = 1 << 20
#: Letters of a pre-token that get nodes in the trie; what follows is scored without, so its length costs no memory.
DEPTH = 256


def unigram_scores(model_file: str) -> tuple[dict[str, int], int]:
    """Pieces of a vocabulary file with unigram log probabilities, and the score of an unknown byte.

    The file's own order is its frequency order; Zipf's law turns the rank into a probability. Nothing is trained.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    scores = {model.id_to_piece(i): -round((math.log(r) + total) * PARTS) for r, i in enumerate(ids, 1)}
    return scores, -round((math.log(len(ids)) + total + 10) * PARTS)


class Trie:
    """Forward scores by prefix. Node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, int], unknown: int, max_nodes: int):
        self.scores, self.unknown, self.max_nodes = scores, unknown, max_nodes
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[int, int]] = [(0, 0)]  # score, minus the number of pieces
        self.terminal: dict[bytes, int] = {}

    def score(self, token: str, end: int, before: deque[tuple[int, int]]) -> tuple[int, int]:
        """The prefix of ``end`` letters; ``before`` ends with the shorter prefixes that a piece can follow."""
        char, (s, k) = token[end - 1], before[-1]
        single = self.scores.get(char)
        if single is None:  # byte fallback
            n = len(char.encode())
            top = (s + self.unknown * n, k - n)
        else:
            top = (s + single, k - 1)
        for start in range(max(0, end - self.longest), end - 1):
            piece = self.scores.get(token[start:end])
            if piece is not None:
                s, k = before[start - end]
                if (s + piece, k - 1) > top:
                    top = (s + piece, k - 1)
        return top

    def count(self, token: str) -> int:
        """Pieces of the best split; ties go to fewer pieces."""
        if len(self.best) > self.max_nodes:
            self.clear()
        node, best, children = 0, self.best, self.children
        recent = deque([best[0]], self.longest)
        for end in range(1, len(token) + 1):
            if end > DEPTH:  # no node, only the last scores are held
                recent.append(self.score(token, end, recent))
                continue
            down = children[node].get(token[end - 1])
            if down is None:
                down = children[node][token[end - 1]] = len(best)
                best.append(self.score(token, end, recent))
                children.append({})
            node = down
            recent.append(best[node])
        return -recent[-1][1]


def token_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", max_nodes: int = 400_000) -> DataFrame:
    """Unigram token counts of whole texts: ``key, n_pretokens, n_tokens, n_chars``.

    Pre-tokens are the words between ASCII blanks, each with the word mark in front. A character that no piece covers
    costs one token a byte. Null and empty texts have 0 of everything. Repeated rows stay, a null key stays null, an
    empty table gives an empty result, other columns are not read. ``max_nodes`` bounds the trie of a task: beyond it
    the trie starts anew, which changes no count; pre-tokens of any length are scored whole. The vocabulary file must be readable on every executor.
    """

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*unigram_scores(model_file), max_nodes)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            pretokens, tokens = [], []
            for raw in column.cast(pa.binary()).to_pylist():
                words = raw.split()
                known, n = trie.terminal, 0
                for w in words:
                    c = known.get(w)
                    if c is None:
                        c = trie.count(MARK + w.decode())
                        known = trie.terminal
                        if len(w) <= DEPTH:
                            known[w] = c
                    n += c
                pretokens.append(len(words))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(pretokens, np.int64)), pa.array(np.array(tokens, np.int64)), pc.utf8_length(column).cast(pa.int64())],
                names=[key, "n_pretokens", "n_tokens", "n_chars"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(count_batches, f"`{key}` {kind}, n_pretokens long, n_tokens long, n_chars long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
