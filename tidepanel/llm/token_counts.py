"""Token counts of a unigram segmentation, computed once per shared prefix of the pre-tokens.

The pieces come from the vocabulary file of a public tokenizer (nothing is trained): a piece's score is a logarithmic
probability by its place in the file, log(1 / ((rank + 1) * H)) with H normalising over all pieces (Zipf's law). A pre-token is
segmented into the pieces with the highest sum of scores; of equal sums the one with fewer pieces counts.

Distinct pre-tokens are inserted in a trie. The best score of a prefix depends on the prefix alone: a node is computed
when it is made, from its ancestors on the path, and then serves every pre-token that begins like that. A terminal
node's piece count is the pre-token's answer. A task keeps one trie and one table of answers over all its rows; both are emptied
when they exceed a fixed number of entries, which costs time and changes nothing. No shuffle takes place.
"""

from __future__ import annotations

import base64
import math

from pyspark.sql import DataFrame

from .per_text import per_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_NODES, MOST_ANSWERS = 400_000, 400_000


def scores(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces of a file of lines 'base64 rank', with their scores."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    harmonic = sum(1 / (rank + 1) for rank in ranks.values())
    return {piece: -math.log((rank + 1) * harmonic) for piece, rank in ranks.items()}


class PrefixTrie:
    """Nodes are numbered; 0 is the root. A byte without a piece of its own scores less than any piece."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, token: bytes) -> int:
        """The number of pieces of ``token``; nodes are made for what no earlier token shares."""
        child, best, count, path = self.child, self.best, self.count, [0]
        for byte in token:
            node = child.get(path[-1] << 8 | byte)
            if node is None:
                break
            path.append(node)
        piece = self.pieces.get
        for end in range(len(path), len(token) + 1):
            top, fewest = best[path[end - 1]] + self.unknown, count[path[end - 1]] + 1
            for start in range(max(0, end - self.longest), end):
                score = piece(token[start:end])
                if score is not None:
                    total, n = best[path[start]] + score, count[path[start]] + 1
                    if total > top or total == top and n < fewest:
                        top, fewest = total, n
            child[path[-1] << 8 | token[end - 1]] = len(best)
            path.append(len(best))
            best.append(top)
            count.append(fewest)
        return count[path[-1]]


class Answers(dict):
    """Pre-token -> number of pieces; the trie is asked once for each distinct one."""

    def __init__(self, trie: PrefixTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> int:
        n = self[token] = self.trie.insert(token.encode("utf-8", "surrogatepass"))
        return n

    def trim(self) -> None:
        if len(self) > MOST_ANSWERS or len(self.trie.best) > MOST_NODES:
            self.clear()
            self.trie.clear()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_pretokens, n_tokens, n_bytes), one row per row of ``docs``.

    Null and empty texts count 0. Null ids and repeated rows are kept. Other columns aren't looked at; an empty table
    gives an empty table. The vocabulary file is read by the driver and sent to the tasks: some 50,000 pieces.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(scores(vocabulary))

    def start():
        import regex

        find, answers = regex.compile(PRE_TOKENS).findall, Answers(PrefixTrie(pieces.value))

        def count(texts: list) -> tuple[list, list, list]:
            pre, tokens, sizes = [], [], []
            for text in texts:
                found = find(text) if text else []
                pre.append(len(found))
                tokens.append(sum(map(answers.__getitem__, found)))
                sizes.append(len(text.encode()) if text else 0)
                answers.trim()
            return pre, tokens, sizes

        return count

    return per_text(docs, text_col, [id_col], {"n_pretokens": "long", "n_tokens": "long", "n_bytes": "long"}, start)
