"""Token counts of a unigram model by dynamic programming over a shared trie of pre-tokens.

The distinct pre-tokens (words) of a block are put in a trie, that is, taken in sorted order with the states of the
common prefix kept. A node's state is the best forward score of its prefix (the sum of piece scores, best over all ways
to cut it) and the number of pieces there; it is computed once for all words below it. A terminal node's number is the
word's token count, and a text's count is the sum over its words.

Pieces and scores are those of a public sentencepiece file (fixed size, broadcast). A word starts with the file's space
mark. A character that no piece covers costs one byte piece for each of its UTF-8 bytes. Of equal scores the cut with
fewer pieces counts. Null and empty texts have no words and no tokens; texts are whole; rows are counted one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for the space before a word.
MARK = "▁"
MOST_CACHED = 200_000
#: What a byte piece costs: less than any piece's score, so that pieces win wherever there is one.
BYTE_SCORE = -1e6


def load_pieces(path: str) -> dict[str, float]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))}


class Trie:
    """Counts for words; ``counts`` keeps what terminal nodes store."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.counts: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Sorted words, each after the states of the prefix that it shares with the word before."""
        pieces, longest = self.pieces, self.longest
        before = ""
        score, count = [0.0], [0]
        for word in words:
            w = MARK + word
            k, n = 0, min(len(w), len(before))
            while k < n and w[k] == before[k]:
                k += 1
            del score[k + 1 :], count[k + 1 :]
            for end in range(k + 1, len(w) + 1):
                size = len(w[end - 1].encode("utf-8", "surrogatepass"))
                best, c = score[end - 1] + BYTE_SCORE * size, count[end - 1] + size
                for start in range(max(0, end - longest), end):
                    p = pieces.get(w[start:end])
                    if p is not None:
                        s = score[start] + p
                        if s > best or s == best and count[start] + 1 < c:
                            best, c = s, count[start] + 1
                score.append(best)
                count.append(c)
            self.counts[word] = count[-1]
            before = w

    def count(self, words: Counter) -> int:
        return sum(self.counts[w] * n for w, n in words.items())


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_words and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            n_words, n_tokens = [], []
            for first in range(0, len(texts), 512):
                # bytes split at ASCII white space only
                rows = [Counter((t or "").encode().split()) for t in texts[first : first + 512]]
                rows = [Counter({w.decode(): n for w, n in r.items()}) for r in rows]
                if len(trie.counts) > MOST_CACHED:
                    trie.counts = {}
                trie.insert(sorted({w for r in rows for w in r if w not in trie.counts}))
                n_words += [r.total() for r in rows]
                n_tokens += [trie.count(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, n_words long, n_tokens long")
