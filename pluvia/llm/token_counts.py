"""Token counts by a linear longest-match automaton over a vocabulary trie."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers.
CACHE = 500_000


def vocabulary(path: str | None = None) -> list[bytes]:
    """The byte strings of a tiktoken file; by default the public byte_bpe_50k."""
    if path is None:
        import public_tokenizers as P

        path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return [base64.b64decode(x.split()[0]) for x in f if x.strip()]


class Automaton:
    """A trie whose nodes know where the match goes on if a byte doesn't fit, and how many tokens are popped by then.

    Greedy longest-match takes, again and again, the longest vocabulary entry that
    begins what is left. At a node, ``pops`` says how many tokens that takes off the
    node's string before the rest is again a string in the trie, and ``fail`` is the
    node of that rest. So a word costs one step per byte plus one per popped token,
    and no piece is ever built. A byte that begins no entry is a token of its own.
    """

    def __init__(self, vocab: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        parent, byte, token = [0], [0], [False]
        for entry in set(vocab) - {b""}:
            at = 0
            for c in entry:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    parent.append(at)
                    byte.append(c)
                    token.append(False)
                at = to
            token[at] = True
        n = len(self.next)
        self.fail, self.pops = [0] * n, [0] * n
        # parents first, as a node's answer builds on its parent's
        level = list(self.next[0].values())
        for v in level:
            token[v] = True
        while level:
            after = []
            for v in level:
                if token[v]:
                    self.pops[v] = 1
                else:
                    u = parent[v]
                    k, z = self.pops[u], self.fail[u]
                    while byte[v] not in self.next[z] and z:
                        k += self.pops[z]
                        z = self.fail[z]
                    # a byte that begins no entry is popped alone
                    self.fail[v] = self.next[z].get(byte[v], 0)
                    self.pops[v] = k + (byte[v] not in self.next[z])
                after += self.next[v].values()
            level = after

    def count(self, word: bytes) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        at, n = 0, 0
        for c in word:
            to = nxt[at].get(c)
            while to is None and at:
                n += pops[at]
                at = fail[at]
                to = nxt[at].get(c)
            if to is None:
                n += 1
            else:
                at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n


def counter(vocab: Iterable[bytes]) -> Callable[[bytes | None], tuple[int, int]]:
    """(words, tokens) of a text; each word is matched with a space before it, as the vocabulary marks word starts."""
    automaton = Automaton(vocab)

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            n = automaton.count(b" " + word)
            if len(word) < 64:
                if len(self) >= CACHE:
                    self.clear()
                self[word] = n
            return n

    known = Known()

    def count(text: bytes | None) -> tuple[int, int]:
        words = (text or b"").split()
        return len(words), sum(map(known.__getitem__, words))

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_bytes.

    Words are runs of characters other than space and U+0009..U+000D; each, with a
    space before it, is cut by greedy longest match over the UTF-8 bytes with the
    given vocabulary (a tiktoken file that every worker can open). The automaton is
    built once a worker from that file.

    A null text has 0 of all. Null doc_ids and repeated rows stay as they are, an
    empty table gives no rows, extra columns are ignored. Words of any length take
    time linear in their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary(vocabulary_path))
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            found = np.array([count(t) for t in texts], np.int64).reshape(-1, 2)
            cols = [b.column(0), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array([len(t or b"") for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_tokens", "n_bytes"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
