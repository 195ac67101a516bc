"""BPE encoding and decoding: speculate and verify.

For every new word greedy longest match proposes tokens. A row of tokens is what the merges make of the word if, and
only if, no merge crosses between two neighbours; that is tested for all adjacent pairs of all new words at once, by
walking down the facing edges of both tokens' merge trees. Only words with a failing pair are merged step by step. Proposing
walks a trie and merging goes on for all words of a run side by side; words over SHORT letters are taken one by one.

The tokenizer file is read on the driver and broadcast (a fixed size). A task works on AT_ONCE bytes of text at a time and
caches the words of the last of them, at most 2 * MOST_CACHED besides those at hand. When it ends the cache goes, since Spark's
processes live on beside the tasks of other stages; only the vocabulary stays for the next task. Null and empty texts have no
tokens and decode to the empty text; special tokens in a text are tokens, as in the library; texts are whole however long;
every row, repeated ones too, is encoded by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words after which a new cache begins; the one before it is still looked in.
MOST_CACHED = 100_000
#: Bytes of text that a task works on at once; a longer text is whole.
AT_ONCE = 1 << 20
#: Letters up to which words are worked on side by side and merging looks for the lowest rank among all; longer words keep
#: their pairs in a heap.
SHORT = 100
END = "</w>"
#: The code after a word's last letter (letters have the codes of their bytes), a character for it, and no rank.
STOP, STOP_CHAR, NONE = 256, "\u01ff", 1 << 30
#: The split pattern of the tokenizer file, with white space spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stays itself, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the tables for the pair test, from a tokenizer file's text."""

    def __init__(self, text: str) -> None:
        d = json.loads(text)
        model = d["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        n = max(self.ids.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.left, self.right = np.arange(n), np.arange(n)
        self.born = np.full(n, -1)  # the rank of the merge that makes a token; -1 for the letters
        for k, (a, b) in enumerate(merges):
            c = self.made[k]
            if self.born[c] < 0:
                self.left[c], self.right[c], self.born[c] = self.ids[a], self.ids[b], k
        pairs = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.array(list(self.rank.values()))[order]
        self.longest = max(len(t) - (len(END) if t.endswith(END) else 0) for t in self.ids)
        # a token that its own letters do not merge to is never proposed
        self.inner, self.last = {}, {}
        for t, i in self.ids.items():
            end = t.endswith(END) and len(t) > len(END)
            if self.merged(t[: -len(END)] if end else t, end) == [i]:
                (self.last if end else self.inner)[t[: -len(END)] if end else t] = i
        letters = byte_letters()
        self.code = np.zeros(512, np.int64)
        self.code[[*map(ord, letters), ord(STOP_CHAR)]] = np.arange(STOP + 1)
        self.letter, self.closing = (np.array([self.ids.get(c + e, -1) for c in letters]) for e in ("", END))
        self.merge_makes = np.array(self.made, np.int64)
        edges: dict[int, int] = {}
        token = [-1]  # by node of the trie of all that is proposed
        for some, stop in ((self.inner, ""), (self.last, STOP_CHAR)):
            for t, i in some.items():
                node = 0
                for c in self.codes(t + stop).tolist():
                    node = edges.setdefault(node * (STOP + 1) + c, len(token))
                    if node == len(token):
                        token.append(-1)
                token[node] = i
        self.edges, self.node_token = np.array(sorted(edges), np.int64), np.array(token)
        self.child = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.reach: dict[str, int] = {}  # by two letters: the length of the longest token that begins so
        for t in self.inner:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))

    def merged(self, word: str, end: bool = True) -> list[int]:
        """The merges one by one, lowest rank first, leftmost first."""
        none, rank = 1 << 30, self.rank
        s = [self.ids[c] for c in word[:-1]]
        s.append(self.ids[word[-1] + END * end])
        if len(s) > SHORT:
            return self._merged_long(s)
        ranks = [rank.get(p, none) for p in zip(s, s[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            s[k] = self.made[least]
            del s[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank.get((s[k - 1], s[k]), none)
            if k < len(ranks):
                ranks[k] = rank.get((s[k], s[k + 1]), none)
        return s

    def _merged_long(self, s: list[int]) -> list[int]:
        """As ``merged``, in n log n steps: a heap of ranks and places over a linked list of symbols. An entry whose pair has
        changed meanwhile is passed over."""
        rank, n = self.rank, len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | k for k, p in enumerate(zip(s, s[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, k = top >> 40, top & 0xFFFFFFFFFF
            j = after[k]
            if s[k] < 0 or j == n or rank.get((s[k], s[j])) != r:
                continue
            s[k], s[j] = self.made[r], -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank.get((s[k], s[j]))) is not None:
                    heapq.heappush(heap, r << 40 | k)
            if (i := before[k]) >= 0 and (r := rank.get((s[i], s[k]))) is not None:
                heapq.heappush(heap, r << 40 | i)
        return [t for t in s if t >= 0]

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or NONE."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def merged_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merged``, one merge of every word at a time: (word, token) of all tokens, a word's own in order."""
        size = np.array([len(w) for w in words], np.int64)
        codes, last = self.codes("".join(words)), np.cumsum(size) - 1
        s, word, out = self.letter[codes], np.arange(len(words)), [np.empty((2, 0), np.int64)]
        s[last] = self.closing[codes[last]]
        r = np.append(self.ranks(s[:-1], s[1:]), NONE)[: len(s)]
        r[last] = NONE
        while len(word):
            least = np.minimum.reduceat(r << 32 | np.arange(len(r)), np.cumsum(size) - size)
            rank, k = least >> 32, least & 0xFFFFFFFF
            if (done := rank == NONE).any():
                gone = np.repeat(done, size)
                out.append(np.stack((np.repeat(word[done], size[done]), s[gone])))
                k = k[~done] - np.cumsum(gone)[k[~done]]
                s, r, word, size, rank = s[~gone], r[~gone], word[~done], size[~done], rank[~done]
            s[k] = self.merge_makes[rank]
            on = np.ones(len(s), bool)
            on[k + 1] = False
            s, r, size = s[on], r[on], size - 1
            k -= np.arange(len(k))  # every word before has one symbol less
            first = np.cumsum(size) - size
            r[k] = NONE
            x = k[k < first + size - 1]
            r[x] = self.ranks(s[x], s[x + 1])
            x = k[k > first] - 1
            r[x] = self.ranks(s[x], s[x + 1])
        return tuple(np.concatenate(out, axis=1))

    def proposed_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``proposed``, every word one letter down the trie at a time: (word, token) of all tokens, a word's own in order;
        words that can't be spelled have none."""
        size = np.array([len(w) for w in words], np.int64)
        codes = self.codes("".join([w + STOP_CHAR for w in words]))
        p = np.cumsum(size + 1) - size - 1
        live, limit, failed, out = np.arange(len(words)), p + size, np.zeros(len(words), bool), [np.empty((2, 0), np.int64)]
        node, best, stop = np.zeros_like(p), np.full_like(p, -1), p.copy()
        while len(live):
            key = node * (STOP + 1) + codes[p]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            node = np.where(hit, self.child[at], 0)
            p = p + 1
            take = (self.node_token[node] >= 0) & (p != limit)  # the last letter is only taken with the stop
            best, stop = np.where(take, self.node_token[node], best), np.where(take, p, stop)
            over = ~hit | (p > limit)
            some = over & (best >= 0)
            out.append(np.stack((live[some], best[some])))
            failed[live[over & (best < 0)]] = True
            on = ~over | some & (stop <= limit)
            p, node, best = np.where(over, stop, p), np.where(over, 0, node), np.where(over, -1, best)
            live, limit, p, node, best, stop = (x[on] for x in (live, limit, p, node, best, stop))
        word, token = np.concatenate(out, axis=1)
        order = np.argsort(word, kind="stable")
        order = order[~failed[word[order]]]
        return word[order], token[order]

    def proposed(self, word: str) -> list[int]:
        out, k, n = [], 0, len(word)
        while k < n:
            if n - k <= self.longest and (t := self.last.get(word[k:])) is not None:
                out.append(t)
                break
            for stop in range(min(n - 1, k + self.reach.get(word[k : k + 2], 1)), k, -1):
                if (t := self.inner.get(word[k:stop])) is not None:
                    out.append(t)
                    k = stop
                    break
            else:
                return []
        return out

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of neighbours: no merge crosses between them.

        Symbols x at a's right edge and y at b's left edge face each other from the later one's birth until one of them
        is merged into its parent. A merge of x and y that comes before that crosses; of equal ranks the left one goes
        first. From the end of the merging back to the letters, each step undoes the later birth."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x = np.full(len(a), 1 << 30)
        until_y = until_x.copy()
        while len(live):
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == key, self.pair_rank[at], 1 << 30)
            crosses = (rank < until_x) & (rank <= until_y) & (rank < 1 << 30)
            ok[live[crosses]] = False
            bx, by = self.born[x], self.born[y]
            on = ~crosses & ((bx >= 0) | (by >= 0))
            live, x, y, until_x, until_y, bx, by = (v[on] for v in (live, x, y, until_x, until_y, bx, by))
            undo = bx > by
            until_x, until_y = np.where(undo, bx, until_x), np.where(undo, until_y, by)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of distinct words (as byte letters), word by word, and how many each word has."""
        n = len(words)
        long = np.array([len(w) > SHORT for w in words], bool)
        short, rest = np.flatnonzero(~long), np.flatnonzero(long).tolist()
        of, flat = self.proposed_all([words[k] for k in short.tolist()])
        rows = [self.proposed(words[k]) for k in rest]
        of = np.concatenate((short[of], np.repeat(np.array(rest, np.int64), [len(r) for r in rows])))
        flat = np.concatenate((flat, np.array([t for r in rows for t in r], np.int64)))
        bad = np.bincount(of, minlength=n) == 0
        if len(flat) > 1:
            inside = of[1:] == of[:-1]
            pair = flat[:-1][inside] << 20 | flat[1:][inside]
            some, back = np.unique(pair, return_inverse=True)
            bad[of[1:][inside][~self.fitting(some >> 20, some & 0xFFFFF)[back]]] = True
        parts = [(of[~bad[of]], flat[~bad[of]])]
        again = np.flatnonzero(bad & ~long)
        word, token = self.merged_all([words[k] for k in again.tolist()])
        parts.append((again[word], token))
        for k in np.flatnonzero(bad & long).tolist():
            row = np.array(self.merged(words[k]), np.int64)
            parts.append((np.full(len(row), k), row))
        of, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)


class Encoder:
    def __init__(self, text: str) -> None:
        self.v = Vocabulary(text)
        self.split = regex.compile(SPLIT)
        self.letters = byte_letters()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.forget()

    def forget(self) -> None:
        """Empties the cache: of a word the ids, as little-endian 32-bit integers."""
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token is a word with a NUL before it."""
        if self.special is not None and any(s in text for s in self.v.special):
            out = []
            for k, part in enumerate(self.special.split(text)):
                out += ["\0" + part] if k % 2 else self.words_of(part)
            return out
        return self.words_of(text)

    def words_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would make a final sigma
        return self.split.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > MOST_CACHED:
            self.before, self.cache = self.cache, {}
        missing = [w for w in words if w not in self.cache]
        self.cache |= {w: self.before[w] for w in missing if w in self.before}
        new = [w for w in missing if w not in self.before]
        plain = [w for w in new if w[0] != "\0" or w[1:] not in self.v.special]
        spelled = [w if w.isascii() and w.isprintable() else "".join(self.letters[b] for b in w.encode()) for w in plain]
        flat, size = self.v.encoded(spelled)
        ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
        self.cache |= {w: ids[a:b] for w, a, b in zip(plain, [0, *ends], ends, strict=False)}
        for w in new:
            if w not in self.cache:
                self.cache[w] = np.array([self.v.special[w[1:]]], "<u4").tobytes()

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text the ids as little-endian 32-bit integers."""
        full = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(texts)]
        for start, end in ((k, min(k + 256, z)) for a, z in pairwise(cuts) for k in range(a, z, 256)):
            rows = [self.words(t or "") for t in texts.slice(start, end - start).to_pylist()]
            self.learn({w for r in rows for w in r})
            for r in rows:
                yield b"".join([self.cache[w] for w in r])

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, and what they decode to."""
        for ids in self.ids(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            yield ids, " ".join([self.v.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[int, Encoder] = {}


@contextmanager
def _encoder(text: str) -> Iterator[Encoder]:
    """The process's encoder, whose cache goes at the end of the block."""
    key = hash(text)
    if key not in _encoders:
        _encoders[key] = Encoder(text)
    try:
        yield _encoders[key]
    finally:
        _encoders[key].forget()


def _shared(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    file = _shared(docs, path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(file.value) as e:
            for b in batches:
                got = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in e.encode(b.column("text"))]
                cols = list(zip(*got, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and ids (array of int)."""
    file = _shared(docs, path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(file.value) as e:
            for b in batches:
                got = [np.frombuffer(i, "<i4") for i in e.ids(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and text. The file has no decoder, so tokens are joined by spaces; ids that the
    file does not have are left out. Null ids are an empty text."""
    file = _shared(rows, path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(file.value) as e:
            tokens = e.v.tokens
        for b in batches:
            out = [" ".join(tokens[i] for i in ids or [] if i in tokens) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(made, "doc_id long, text string")
