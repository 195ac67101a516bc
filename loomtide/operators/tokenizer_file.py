"""Tokenizers from their JSON files: a chain of normaliser, pre-tokenizer, model, post-processor and decoder, run over text DataFrames.

Each part of a file is compiled to a function; a part or option that is not here raises an error with its name, so no file is read
half. Word-level and word-piece models are here. Word pieces are found by a trie with failure links: a word is read once,
and where no longer piece fits, the link leads to where the rest of it goes on, so work grows with the word's length
and not with its square. A task splits its texts and asks the model for each distinct word once; rows stay where they are."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .text import n_bytes, runs


class UnknownPart(ValueError):
    """A part of a tokenizer file that is not here."""


def _only(part: dict, what: str, **known) -> None:
    """Checks a part's options: ``known`` gives those that must have a value where they are there."""
    for k, v in known.items():
        if k in part and part[k] != v:
            raise UnknownPart(f"{what} {part.get('type', '')} with {k}={part[k]!r}")


def _letters(c: str, *kinds: str) -> bool:
    return unicodedata.category(c).startswith(kinds)


def _is_punctuation(c: str) -> bool:
    return c.isascii() and (33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126) or _letters(c, "P")


#: The ranges of ideographs that stand alone.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _without_marks(t: str) -> str:
    return "".join(c for c in t if not _letters(c, "Mn"))


def _cleaned(t: str) -> str:
    """Without control characters; white space becomes plain."""
    kept = (c for c in t if c in "\t\n\r" or not (c in "\0�" or _letters(c, "Cc", "Cf", "Cn", "Co")))
    return "".join(" " if c in "\t\n\r" or c.isspace() else c for c in kept)


def normaliser(part: dict | None) -> Callable[[str], str]:
    kind = part and part["type"]
    if part is None:
        return lambda t: t
    if kind == "Sequence":
        steps = [normaliser(p) for p in part["normalizers"]]
        return lambda t: reduce(lambda x, f: f(x), steps, t)
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return lambda t: unicodedata.normalize(kind, t)
    if kind == "Lowercase":
        return _lower
    if kind == "StripAccents":
        return _without_marks
    if kind == "Strip":
        left, right = part.get("strip_left", True), part.get("strip_right", True)
        return lambda t: t.strip() if left and right else t.lstrip() if left else t.rstrip() if right else t
    if kind == "Prepend":
        return lambda t: part["prepend"] + t if t else t
    if kind == "Replace" and "String" in part["pattern"]:
        return lambda t: t.replace(part["pattern"]["String"], part["content"])
    if kind == "BertNormalizer":
        lower = part.get("lowercase", True)
        accents = part.get("strip_accents")
        accents = lower if accents is None else accents

        def run(t: str) -> str:
            t = _cleaned(t) if part.get("clean_text", True) else t
            if part.get("handle_chinese_chars", True):
                t = "".join(f" {c} " if any(a <= ord(c) <= b for a, b in IDEOGRAPHS) else c for c in t)
            t = _without_marks(unicodedata.normalize("NFD", t)) if accents else t
            return _lower(t) if lower else t

        return run
    raise UnknownPart(f"normalizer {kind}")


def _lower(t: str) -> str:
    # letter by letter: no rule looks at its neighbours, as only the one for sigma would
    return "".join(c.lower() for c in t) if "\u03a3" in t else t.lower()


def pre_tokenizer(part: dict | None) -> Callable[[str], list[str]]:
    kind = part and part["type"]
    if part is None:
        return lambda t: [t] if t else []
    if kind == "Sequence":
        steps = [pre_tokenizer(p) for p in part["pretokenizers"]]
        return lambda t: reduce(lambda ws, f: [x for w in ws for x in f(w)], steps, [t])
    if kind == "WhitespaceSplit":
        return _split_spaces
    if kind == "Whitespace":
        return regex.compile(r"\w+|[^\w\s]+").findall  # its words take marks along, as Unicode has it
    if kind == "Punctuation":
        _only(part, "pre_tokenizer", behavior="Isolated")
        return lambda t: _apart(t, _is_punctuation)
    if kind == "Digits":
        if part.get("individual_digits"):
            return lambda t: _apart(t, lambda c: _letters(c, "N"))
        return regex.compile(r"\p{N}+|\P{N}+").findall
    if kind == "BertPreTokenizer":
        return lambda t: [x for w in _split_spaces(t) for x in _apart(w, _is_punctuation)]
    raise UnknownPart(f"pre_tokenizer {kind}")


_SPACES = re.compile(r"[^\S\x1c-\x1f]+")  # white space of Unicode, which the four ASCII separators are not


def _split_spaces(t: str) -> list[str]:
    return [w for w in _SPACES.split(t) if w]


def _apart(t: str, alone: Callable[[str], bool]) -> list[str]:
    out, run = [], ""
    for c in t:
        if alone(c):
            out += [run, c] if run else [c]
            run = ""
        else:
            run += c
    return [*out, run] if run else out


class WordPiece:
    """Longest pieces from the left, by one walk of a trie with failure links.

    A node is a string of the beginning of a piece, first pieces and later ones (without their mark) apart. Where a node has
    no child for the next letter, its link leads to the node of what is left of its string after its longest pieces, which
    ``pops`` lists."""

    def __init__(self, vocabulary: dict[str, int], unknown: int | None, mark: str = "##", longest: int = 100) -> None:
        self.unknown, self.longest = unknown, longest
        self.next: list[dict[str, int]] = [{}, {}]  # 0: the start of a word; 1: behind a piece
        ends: dict[int, int] = {}
        for root, pieces in ((0, vocabulary.items()), (1, ((t[len(mark) :], i) for t, i in vocabulary.items() if t.startswith(mark)))):
            for piece, ident in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                    at = self.next[at][c]
                if piece:
                    ends[at] = ident
        self.link: list[int] = [-1] * len(self.next)
        self.pops: list[tuple[int, ...]] = [()] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if v in ends:
                        self.link[v], self.pops[v] = 1, (ends[v],)
                        continue
                    z, more = self.link[u], ()
                    while z >= 0 and c not in self.next[z]:
                        more, z = more + self.pops[z], self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.next[z][c], self.pops[u] + more
            level = below

    def __call__(self, word: str) -> list[int]:
        """The ids of a word; the unknown id alone where no pieces make it up."""
        if len(word) <= self.longest:
            out: list[int] = []
            u = 0
            for c in word:
                while u >= 0 and c not in self.next[u]:
                    out += self.pops[u]
                    u = self.link[u]
                if u < 0:
                    break
                u = self.next[u][c]
            while u > 1:
                out += self.pops[u]
                u = self.link[u]
            if u == 1 or not word:
                return out
        if self.unknown is None:
            raise ValueError("a word is not in the vocabulary, which has no unknown token")
        return [self.unknown]


def model(part: dict) -> tuple[Callable[[str], list[int]], dict[str, int]]:
    kind, vocabulary = part.get("type", "WordLevel" if "unk_token" in part else None), part.get("vocab")
    if kind not in ("WordLevel", "WordPiece"):
        raise UnknownPart(f"model {kind}")
    unknown = vocabulary.get(part["unk_token"])
    if kind == "WordPiece":
        return WordPiece(vocabulary, unknown, part.get("continuing_subword_prefix", "##"), part.get("max_input_chars_per_word", 100)), vocabulary

    def whole(word: str) -> list[int]:
        got = vocabulary.get(word, unknown)
        if got is None:
            raise ValueError("a word is not in the vocabulary, which has no unknown token")
        return [got]

    return whole, vocabulary


def template(part: dict | None) -> tuple[list, list]:
    """What stands where for one text and for a pair: ("A" or "B" or an id, type id)."""
    kind = part and part["type"]
    if part is None:
        return [("A", 0)], [("A", 0), ("B", 1)]
    if kind == "BertProcessing":
        sep, cls = part["sep"][1], part["cls"][1]
        return [(cls, 0), ("A", 0), (sep, 0)], [(cls, 0), ("A", 0), (sep, 0), ("B", 1), (sep, 1)]
    if kind == "TemplateProcessing":

        def told(pieces: list[dict]) -> list:
            out = []
            for p in pieces:
                if "Sequence" in p:
                    out.append((p["Sequence"]["id"], p["Sequence"]["type_id"]))
                else:
                    s = p["SpecialToken"]
                    out += [(i, s["type_id"]) for i in part["special_tokens"][s["id"]]["ids"]]
            return out

        return told(part["single"]), told(part["pair"])
    raise UnknownPart(f"post_processor {kind}")


class TokenizerFile:
    """A tokenizer from a JSON text of version 1 or 2. ``encode`` and ``decode`` take and give what those of ``WordLevel`` do."""

    def __init__(self, text: str, padding: str = "[PAD]") -> None:
        spec = json.loads(text)
        if str(spec.get("version", "1.0")).split(".")[0] not in ("1", "2"):
            raise UnknownPart(f"version {spec['version']}")
        self.text, self.padding = text, padding
        self._normal, self._split = normaliser(spec.get("normalizer")), pre_tokenizer(spec.get("pre_tokenizer"))
        self._model, vocabulary = model(spec["model"])
        self.single, self.pair = template(spec.get("post_processor"))
        decoder = spec.get("decoder")
        if decoder is not None and decoder["type"] != "WordPiece":
            raise UnknownPart(f"decoder {decoder['type']}")
        self.decoder = decoder
        self.vocabulary, self.special = dict(vocabulary), set()
        added = {}
        for t in spec.get("added_tokens") or []:
            _only(t, "added token", single_word=False, lstrip=False, rstrip=False)
            if t.get("normalized") and self._normal(t["content"]) != t["content"]:
                raise UnknownPart(f"added token {t['content']} that is normalized")
            added[t["content"]] = self.vocabulary[t["content"]] = t["id"]
            if t.get("special"):
                self.special.add(t["content"])
        self._added = added
        self._cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.tokens = {i: t for t, i in self.vocabulary.items()}
        if spec.get("truncation") is not None or spec.get("padding") is not None:
            raise UnknownPart("truncation or padding in the file; give them to encode and collate")

    @classmethod
    def from_file(cls, path: str, padding: str = "[PAD]") -> TokenizerFile:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), padding)

    def __reduce__(self):
        return TokenizerFile, (self.text, self.padding)

    def token_to_id(self, *names: str) -> dict[str, int]:
        """Ids of a few tokens; those that are not there are left out."""
        return {t: self.vocabulary[t] for t in names if t in self.vocabulary}

    def id_to_token(self, *ids: int) -> dict[int, str]:
        return {i: self.tokens[i] for i in ids if i in self.tokens}

    def pieces(self, text: str, known: dict[str, list[int]]) -> array:
        """The ids of a text without what the template adds; ``known`` keeps the ids of words, of MOST_KNOWN at most."""
        out = array("i")
        for k, part in enumerate(self._cut.split(text) if self._cut else [text]):
            if k % 2:
                out.append(self._added[part])
                continue
            for w in self._split(self._normal(part)) if part else ():
                ids = known.get(w)
                if ids is None:
                    ids = self._model(w)
                    if len(w) <= MOST_LETTERS:
                        if len(known) >= MOST_KNOWN:
                            known.clear()
                        known[w] = ids
                out.extend(ids)
        return out

    def ids(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the ids of a text column in its place."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        schema = df.schema
        rest = [c for c in df.columns if c != name]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, known = shared.value, {}
            for b in (part for b in batches for part in runs(b, n_bytes(b.column(len(rest))))):
                at = b.column(rest.index("pos")) if "pos" in rest else None
                flat, ends = array("i"), [0]
                for i, x in enumerate(b.column(len(rest))):
                    if not x.is_valid:
                        raise ValueError(f"{name} is null at row {at[i].as_py() if at is not None else i}")
                    flat += t.pieces(x.as_py(), known)
                    ends.append(len(flat))
                ids = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], [*rest, name])

        kinds = ", ".join([*(f"`{c}` {schema[c].dataType.simpleString()}" for c in rest), f"`{name}` array<int>"])
        return df.select(*[F.col(f"`{c}`") for c in rest], name).mapInArrow(rows, kinds)

    def encode(self, df: DataFrame, pair: bool = False, add_special_tokens: bool = True, max_length: int | None = None, direction: str = "right") -> DataFrame:
        """(pos, input_ids, attention_mask, token_type_ids); a length limit counts what the template adds, and takes from the
        longer text of a pair first."""
        shape = (self.pair if pair else self.single) if add_special_tokens else [("A", 0), ("B", 1)][: 1 + pair]
        room = None if max_length is None else max_length - sum(x not in ("A", "B") for x, _ in shape)
        if room is not None and room < 0:
            raise ValueError("the special tokens do not fit")
        rows = self.ids(df.select("pos", "text", *(["text_pair"] if pair else [])), "text")
        rows = self.ids(rows, "text_pair") if pair else rows
        a, b = F.col("text"), F.col("text_pair") if pair else None
        if room is not None:
            a, b = tokens.truncate_pair(a, b, room) if pair else (tokens.truncate(a, room, direction), None)
        rows = rows.select("pos", a.alias("A"), *([b.alias("B")] if pair else []))
        part = lambda x: F.col(x) if x in ("A", "B") else F.array(F.lit(x).cast("int"))
        told = lambda x, kind: F.transform(part(x), lambda _: F.lit(kind))
        rows = rows.select("pos", F.concat(*[part(x) for x, _ in shape]).alias("input_ids"), F.concat(*[told(x, kind) for x, kind in shape]).alias("token_type_ids"))
        return rows.select("pos", "input_ids", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"), "token_type_ids")

    def decode(self, df: DataFrame, skip_special_tokens: bool = True) -> DataFrame:
        """(pos, text) of rows (pos, input_ids). Without a decoder tokens are joined by spaces; a word-piece one joins marked
        pieces to what is before them. An id that the vocabulary does not have is an error."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for b in (part for b in batches for part in runs(b, 4 * np.asarray(pc.fill_null(pc.list_value_length(b.column("input_ids")), 0)))):
                yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array([t.said(x or [], skip_special_tokens) for x in b.column("input_ids").to_pylist()], pa.string())], ["pos", "text"])

        return df.select("pos", "input_ids").mapInArrow(rows, "pos long, text string")

    def said(self, ids: list[int], skip_special_tokens: bool = True) -> str:
        """The text of ids."""
        if missing := [i for i in ids if i not in self.tokens]:
            raise ValueError(f"no token has the id {missing[0]}")
        words = [t for t in map(self.tokens.get, ids) if not (skip_special_tokens and t in self.special)]
        if self.decoder is None:
            return " ".join(words)
        mark = self.decoder.get("prefix", "##")
        out = []
        for k, w in enumerate(words):
            w = (w[len(mark) :] if w.startswith(mark) else " " + w) if k else w
            if self.decoder.get("cleanup", True):
                for old in (" .", " ?", " !", " ,"):
                    w = w.replace(old, old[1:])
                w = w.replace(" ' ", "'").replace(" n't", "n't").replace(" 'm", "'m").replace(" do not", " don't").replace(" 's", "'s").replace(" 've", "'ve").replace(" 're", "'re")
            out.append(w)
        return "".join(out)


#: Distinct words whose ids a task keeps, and letters up to which it keeps a word's: some 20 MB.
MOST_KNOWN = 1 << 16
MOST_LETTERS = 100
