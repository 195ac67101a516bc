"""Tokenizer files against the tokenizers library, and word pieces against the plain rule."""

import json
import random
import time

import pytest
from tokenizers import Tokenizer

from loomtide.operators.tokenizer_file import TokenizerFile, UnknownPart, WordPiece
from loomtide.plans.text_pipeline import TextPipeline

SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
ADDED = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(SPECIAL)]


def fixture():
    """The survey's word-level tokenizer of 12 tokens."""
    return {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": ADDED,
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}, "pre_tokenizer": {"type": "WhitespaceSplit"},
        "post_processor": {"type": "BertProcessing", "sep": ["[SEP]", 3], "cls": ["[CLS]", 2]}, "decoder": None,
        "model": {"type": "WordLevel", "unk_token": "[UNK]", "vocab": {t: i for i, t in enumerate([*SPECIAL, "hello", "world", "good", "bad", "café", "a", "b", "中"])}},
    }


def pieces(seed=1):
    rng = random.Random(seed)
    vocab = [*SPECIAL, *"abcdeé.!?中", *("##" + c for c in "abcdeé"), "##", "don", "n", "'", "t", "##t"]
    vocab += ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6))) for _ in range(60)] + ["##" + "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 5))) for _ in range(60)]
    return {t: i for i, t in enumerate(dict.fromkeys(vocab))}


def word_piece(**other):
    return {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": ADDED,
        "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": False, "lowercase": True}, "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {
            "type": "TemplateProcessing",
            "single": [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "[SEP]", "type_id": 0}}],
            "pair": [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "[SEP]", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 1}}, {"SpecialToken": {"id": "[SEP]", "type_id": 1}}],
            "special_tokens": {t: {"id": t, "ids": [i], "tokens": [t]} for i, t in ((2, "[CLS]"), (3, "[SEP]"))},
        },
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": pieces()},
    } | other


def texts(seed=2):
    rng = random.Random(seed)
    letters = "abcdeéxABC.!?'中 \t\n  "
    out = ["", " ", "Hello world, good CAFÉ 中", "[CLS] a [SEP]b", "##ab ## a##b", "don't. a !", "a\0b​c", "x" * 30, "ab" * 70, "É̀é   a　b", "1a 22 3"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(150)]


@pytest.mark.parametrize(
    "spec",
    [
        fixture(), word_piece(), word_piece(normalizer=None, pre_tokenizer={"type": "Whitespace"}, post_processor=None),
        word_piece(normalizer={"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Replace", "pattern": {"String": "x"}, "content": "ab"}, {"type": "Strip", "strip_left": True, "strip_right": True}]}, pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation", "behavior": "Isolated"}, {"type": "Digits", "individual_digits": True}]}),
        word_piece(normalizer={"type": "BertNormalizer", "clean_text": False, "handle_chinese_chars": False, "strip_accents": None, "lowercase": True}),
    ],
)
def test_equals_the_library(spark, spec):
    theirs, ours = Tokenizer.from_str(json.dumps(spec)), TokenizerFile(json.dumps(spec))
    lines = texts()
    df = spark.createDataFrame([(i, t, lines[-i]) for i, t in enumerate(lines)], "pos long, text string, text_pair string").repartition(3)
    got = {r["pos"]: r for r in ours.encode(df).collect()}
    two = {r["pos"]: r for r in ours.encode(df, pair=True).collect()}
    plain = {r["pos"]: r["input_ids"] for r in ours.encode(df, add_special_tokens=False).collect()}
    said = {k: {r["pos"]: r["text"] for r in ours.decode(ours.encode(df), skip_special_tokens=k).collect()} for k in (True, False)}
    for i, t in enumerate(lines):
        want, pair = theirs.encode(t), theirs.encode(t, lines[-i])
        assert got[i]["input_ids"] == want.ids and got[i]["token_type_ids"] == want.type_ids, repr(t)
        assert two[i]["input_ids"] == pair.ids and two[i]["token_type_ids"] == pair.type_ids
        assert plain[i] == theirs.encode(t, add_special_tokens=False).ids
        for k in (True, False):
            assert said[k][i] == theirs.decode(want.ids, skip_special_tokens=k), repr(t)


def test_fixture_ids(spark):
    t = TokenizerFile(json.dumps(fixture()))
    df = spark.createDataFrame([(0, "Hello CAFÉ nobody", 1), (1, "中 a", 0)], "pos long, text string, label long")
    assert {r["pos"]: r["input_ids"] for r in t.encode(df).collect()} == {0: [2, 4, 8, 1, 3], 1: [2, 11, 9, 3]}
    assert {r["pos"]: r["input_ids"] for r in t.encode(df, max_length=3).collect()} == {0: [2, 4, 3], 1: [2, 11, 3]}
    assert t.token_to_id("good", "none") == {"good": 6} and t.id_to_token(11, 99) == {11: "中"}
    (batch,) = list(TextPipeline(df, t).batch(2).loader())
    assert [r["input_ids"] for r in batch] == [[2, 4, 8, 1, 3], [2, 11, 9, 3, 0]]
    with pytest.raises(ValueError):
        t.encode(df, max_length=1)
    with pytest.raises(Exception, match="null at row 7"):
        t.encode(spark.createDataFrame([(7, None)], "pos long, text string")).collect()
    with pytest.raises(Exception, match="no token has the id 77"):
        t.decode(spark.createDataFrame([(0, [77])], "pos long, input_ids array<int>")).collect()


@pytest.mark.parametrize(
    ("change", "name"),
    [
        ({"model": {"type": "BPE", "vocab": {}, "merges": []}}, "BPE"), ({"model": {"type": "Unigram", "vocab": []}}, "Unigram"), ({"normalizer": {"type": "Nmt"}}, "Nmt"), ({"pre_tokenizer": {"type": "ByteLevel"}}, "ByteLevel"),
        ({"post_processor": {"type": "RobertaProcessing"}}, "Roberta"), ({"decoder": {"type": "ByteLevel"}}, "ByteLevel"), ({"version": "9.0"}, "9.0"), ({"added_tokens": [ADDED[0] | {"lstrip": True}]}, "lstrip"), ({"padding": {"strategy": "BatchLongest"}}, "padding"),
        ({"pre_tokenizer": {"type": "Punctuation", "behavior": "Removed"}}, "Removed"),
    ],
)
def test_unknown_parts_raise_by_name(change, name):
    with pytest.raises(UnknownPart, match=name):
        TokenizerFile(json.dumps(fixture() | change))
    TokenizerFile(json.dumps(fixture() | {"version": "2.0"}))


def test_word_pieces_by_the_plain_rule():
    vocab = pieces()
    ours, rng = WordPiece(vocab, 1), random.Random(3)

    def plain(word):
        out, k = [], 0
        while k < len(word):
            end = next((j for j in range(len(word), k, -1) if ("##" if k else "") + word[k:j] in vocab), None)
            if end is None:
                return [1]
            out.append(vocab[("##" if k else "") + word[k:end]])
            k = end
        return out

    for _ in range(4000):
        w = "".join(rng.choice("abcdeéx#") for _ in range(rng.randrange(0, 14)))
        assert ours(w) == plain(w), w
    # an adversary for the plain rule: every place tries long pieces that fail at the end
    deep = {"[UNK]": 0, "a": 1, "##a": 2} | {"##" + "a" * k + "b": k + 1 for k in range(2, 400)}
    fast, began = WordPiece(deep, 0, longest=1 << 20), time.process_time()
    assert fast("a" * 200_000) == [1] + [2] * 199_999
    assert time.process_time() - began < 3


def test_words_that_are_kept_are_bounded_and_rows_go_in_runs(spark, monkeypatch):
    """One batch of many distinct words and long texts: the ids are the same, and neither words nor rows pile up."""
    from loomtide.operators import text, tokenizer_file

    vocabulary = {"[UNK]": 0} | {c: i + 1 for i, c in enumerate("abcdefghij")} | {f"##{c}": i + 11 for i, c in enumerate("abcdefghij")}
    t = tokenizer_file.TokenizerFile(json.dumps({"version": "1.0", "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "model": {"type": "WordPiece", "unk_token": "[UNK]", "vocab": vocabulary}}))
    words = [a + b + c for a in "ABCDEFGHIJ" for b in "abcdefghij" for c in "abcdefghij"]
    ids = lambda w: [vocabulary[w[0].lower()], vocabulary[f"##{w[1]}"], vocabulary[f"##{w[2]}"]]
    monkeypatch.setattr(tokenizer_file, "MOST_KNOWN", 7)
    known = {}
    assert list(t.pieces(" ".join([*words, "a" * 500]), known)) == [i for w in words for i in ids(w)] + [0] and len(known) <= 7
    assert t._normal("ΟΔΟΣ İ É") == "".join(c.lower() for c in "ΟΔΟΣ İ É")
    monkeypatch.undo()
    monkeypatch.setattr(text, "AT_ONCE", 64)
    df = spark.createDataFrame([(k, " ".join(words[k : k + k % 40])) for k in range(300)], "pos long, text string").coalesce(1)
    rows = {r["pos"]: r["input_ids"] for r in t.encode(df).collect()}
    assert rows == {k: [i for w in words[k : k + k % 40] for i in ids(w)] for k in range(300)}
