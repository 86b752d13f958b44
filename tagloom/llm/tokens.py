"""Token counts under a unigram model, shared over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, pick

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_WORD = re.compile(WORD)


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and their log-probabilities, read on the driver.

    A vocabulary that has only merge ranks gets them by Zipf's law, -log(rank + 1) - log(sum).
    Control, unknown and byte pieces are left out: other characters cost one token a byte.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    return {sp.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(ids)}


class TrieCounter:
    """Counts of the tokens in the best segmentation of each pre-token.

    New pre-tokens are walked in sorted order, which is the depth-first order of their trie: a
    node's forward score (and count) is computed once for all pre-tokens that share the prefix,
    and the stack holds the scores on the path from the root. Terminal counts are stored by
    pre-token. At most ``room`` of them are kept, then the store starts anew; results don't
    depend on it. Ties of score go to fewer tokens.
    """

    def __init__(self, pieces: dict[str, float], room: int = 400_000):
        self.root: dict = {}
        for piece, score in pieces.items():
            node = self.root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = score
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}
        self.room = room

    def add(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.room:
            self.known.clear()
        root, unknown, known = self.root, self.unknown, self.known
        # on the path: forward score, its count, and the piece-trie nodes of the pieces that are under way here
        score, count, under = [0.0], [0], [[(0.0, 0, root)]]
        last = ""
        for word in sorted(words):
            path = "▁" + word
            d = 0
            for x, y in zip(path, last):
                if x != y:
                    break
                d += 1
            del score[d + 1 :], count[d + 1 :], under[d + 1 :]
            for ch in path[d:]:
                best, n, going = None, 0, []
                for s, c, node in under[-1]:
                    node = node.get(ch)
                    if node is not None:
                        going.append((s, c, node))
                        p = node.get("")
                        if p is not None and (best is None or s + p > best or s + p == best and c + 1 < n):
                            best, n = s + p, c + 1
                if root.get(ch) is None or "" not in root[ch]:  # not a piece by itself: its bytes
                    s = score[-1] + unknown
                    if best is None or s > best:
                        best, n = s, count[-1] + len(ch.encode("utf-8", "surrogatepass"))
                going.append((best, n, root))
                score.append(best)
                count.append(n)
                under.append(going)
            last = path
            known[word] = count[-1]

    def total(self, words: list[str]) -> int:
        return sum(map(self.known.__getitem__, words))


_COUNTERS: dict[str, TrieCounter] = {}


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of each whole text.

    Pre-tokens are the words, each with the word mark before it. Nothing is shuffled: each worker
    keeps its trie over all the batches and tasks it gets. The vocabulary (bounded by its file) is
    broadcast, so executors don't need the file. Null and empty texts have no tokens. Repeated rows
    and null ids are kept as they are; an empty table gives no rows. Other columns are not read.
    """
    t = pick(docs, id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    tag = uuid.uuid4().hex

    def run(batches):
        if tag not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[tag] = TrieCounter(sent.value)
        trie = _COUNTERS[tag]
        for b in batches:
            pre, tok = [], []
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                words = [_WORD.findall(x or "") for x in texts[at : at + 500]]
                new = set().union(*words)
                if new.difference(trie.known):
                    if len(trie.known) + len(new) > trie.room:
                        trie.known.clear()
                    trie.add(new.difference(trie.known))
                pre += map(len, words)
                tok += map(trie.total, words)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(pre, pa.int64()), pa.array(tok, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return t.mapInArrow(run, f"doc_id {dict(t.dtypes)['id']}, n_pretokens long, n_tokens long")
