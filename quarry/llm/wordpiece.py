r"""Token counts by linear longest-match.

The vocabulary is a byte trie. Every node has a failure link and the number of
tokens that are popped on the way along it, so greedy longest-match word pieces
are counted in one pass over a word's bytes, each byte read once, and no piece
is built. All single bytes belong to the vocabulary (they are added if missing),
so every word has pieces.

Words are the runs between blanks (space, 0x09-0x0D); each is matched with one
leading space, as byte-level vocabularies mark word starts.

The vocabulary file is read on the driver from ``path``, checked against
``MAX_BYTES`` and broadcast; workers build the automaton once. Counts of words
are remembered, which bounds the work by distinct words for ordinary text.

Results for odd input: null and empty texts have 0 words and 0 tokens; repeated
rows get equal counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow

#: Where the public vocabulary lies on this machine; pass another path elsewhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary that is broadcast.
MAX_BYTES = 64 << 20
#: Words whose counts a worker remembers.
REMEMBERED = 500_000


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    if sum(map(len, tokens)) > MAX_BYTES:
        raise ValueError(f"the vocabulary exceeds {MAX_BYTES} bytes")
    return tokens


class Automaton:
    """Trie with failure links and popped-token counts."""

    def __init__(self, tokens: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        token = [False]
        for t in {*tokens, *(bytes([b]) for b in range(256))} - {b""}:
            at = 0
            for c in t:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    token.append(False)
                at = nxt
            token[at] = True
        # breadth first: a node's failure link is known before its children's
        self.fail, self.pops = [0] * len(self.child), [0] * len(self.child)
        queue = [0]
        for u in queue:
            for c, v in self.child[u].items():
                queue.append(v)
                if token[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while c not in self.child[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                self.fail[v], self.pops[v] = self.child[z][c], n

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest-match."""
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for c in word:
            nxt = child[at].get(c)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                nxt = child[at].get(c)
            at = nxt
        while at:
            n += pops[at]
            at = fail[at]
        return n


class Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


_built: dict[int, Counts] = {}


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""
    tokens = read_vocabulary(path)
    key = hash(tuple(tokens))
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokens)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _built:
            _built.clear()
            _built[key] = Counts(Automaton(vocabulary.value))
        of = _built[key].__getitem__
        words = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sum(map(of, w)) for w in words], pa.int64())],
            names=["doc_id", "n_words", "n_tokens"],
        )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, work, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long")


def op8_longest_match_tokens(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
