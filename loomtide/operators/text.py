"""Word-level tokenizers over text DataFrames (pos, text[, text_pair], label): encode, decode and collate.

A tokenizer is a table of tokens and ids (``WordLevel``), broadcast where it is of a checked size: each row's words are looked up
where the row is. Beyond that words meet their ids in a join. Nulls are errors with their row, labels are all or none, and a batch's rows have one length."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import tokens
from ..functions.core import checked

#: Tokens up to which a vocabulary is broadcast; a larger one is joined by a shuffle.
MAX_TOKENS = 1_000_000
#: Bytes of text, or of ids, that a task works on at once.
AT_ONCE = 1 << 22
#: Words whose counts a task keeps; with more it tells them and begins anew.
MAX_KEPT = 1 << 20
#: Fixed: white space of Unicode beyond ASCII, as Java has it.
_WIDE_SPACES = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def runs(b: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, in their order, of about AT_ONCE bytes together; ``size`` has the bytes of each row."""
    full = np.cumsum(size, dtype=np.int64) // AT_ONCE
    for start, end in pairwise([0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), b.num_rows]):
        yield b.slice(start, end - start)


def n_bytes(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of a task's texts, words with A-Z in lower case: one row a word, and more only beyond MAX_KEPT words."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).select(["token", "n_sum"]).rename_columns(["token", "n"])

    for b in batches:
        for part in runs(b, n_bytes(b.column(0))):
            found = pc.value_counts(pc.ascii_split_whitespace(pc.ascii_lower(part.column(0))).flatten())
            words = pa.table([found.field("values"), found.field("counts")], ["token", "n"])
            held.append(words.filter(pc.not_equal(found.field("values"), "")))
            if sum(h.num_rows for h in held) > 2 * MAX_KEPT:
                held = [summed()]
                if held[0].num_rows > MAX_KEPT:
                    yield from held.pop().to_batches(1 << 16)
    if held:
        yield from summed().to_batches(1 << 16)


def word_counts(df: DataFrame, name: str = "text") -> DataFrame:
    """(token, n) of the words that ``tokens.pieces`` finds in a column. A task sums its counts before the JVM and the shuffle get them.
    Letters beyond ASCII become lower case in distinct words, not in texts: no rule of case looks beyond white space."""
    text = checked(F.col(name).isNotNull(), F.col(name), f"{name} is null")
    found = df.select(text).mapInArrow(counted, "token string, n long")
    return found.select(F.lower("token").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


@F.pandas_udf(StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@dataclass(frozen=True)
class WordLevel:
    """``vocabulary`` has distinct tokens (token string, id int). Words are lower-cased runs without white space, composed
    (NFC) first; one that is not in the vocabulary is ``unknown``. A text stands between ``first`` and ``last``, a second
    one of a pair before another ``last``."""

    vocabulary: DataFrame
    unknown: str = "[UNK]"
    first: str = "[CLS]"
    last: str = "[SEP]"
    padding: str = "[PAD]"

    def token_to_id(self, *names: str) -> dict[str, int]:
        """Ids of a few tokens; those that are not there are left out."""
        return {r["token"]: r["id"] for r in self.vocabulary.where(F.col("token").isin(*names)).collect()}

    def id_to_token(self, *ids: int) -> dict[int, str]:
        return {r["id"]: r["token"] for r in self.vocabulary.where(F.col("id").isin(*ids)).collect()}

    def _special(self) -> tuple[int, int, int]:
        names, few = (self.unknown, self.first, self.last), self._table()
        got = self.token_to_id(*names) if few is None else {t: i for t, i in zip(few[0].to_pylist(), few[1].tolist(), strict=True) if t in names}
        if missing := [t for t in names if t not in got]:
            raise ValueError(f"the vocabulary has no {', '.join(missing)}")
        return got[self.unknown], got[self.first], got[self.last]

    def _texts(self, df: DataFrame, names: tuple[str, ...], most: int | None, direction: str) -> DataFrame:
        """(pos and these columns): texts composed and in lower case; with ``most`` what holds that many words of one end is enough,
        and the rest is cut off before anything else is done with it."""
        said = F.raise_error(F.concat(F.lit("text is null at row "), F.col("pos").cast("string")))
        df = df.select("pos", *[F.when(F.col(n).isNull(), said).otherwise(F.col(n)).alias(n) for n in names])
        if most is not None:
            # one more than that: the first or the last one is empty where white space is at the end
            words = lambda n: F.split(n, r"(?U)\s+", most + 2 if direction == "right" else -1)
            df = df.select("pos", *[words(n).alias(n) for n in names])
            df = df.select("pos", *[F.array_join(tokens.truncate(F.col(n), most + 1, direction), " ").alias(n) for n in names])
        # only letters from U+0300 on can be composed: other texts do not go to Python for it
        beyond = lambda n: F.when((F.length(n) != F.octet_length(n)) & F.col(n).rlike(r"[^\x00-\x{2ff}]"), F.col(n))
        return df.select("pos", *[F.lower(F.coalesce(_composed(beyond(n)), n)).alias(n) for n in names])

    @cached_property
    def _few(self) -> pa.Table:
        """The vocabulary, or a row more than MAX_TOKENS of it; made once."""
        return self.vocabulary.select("token", "id").limit(MAX_TOKENS + 1).toArrow().combine_chunks()

    def _table(self) -> tuple[pa.Array, np.ndarray] | None:
        """Tokens and their ids, where they are few enough to be broadcast."""
        if self._few.num_rows > MAX_TOKENS:
            return None
        names = self._few.column("token").cast(pa.string()).combine_chunks()
        return names, self._few.column("id").to_numpy().astype(np.int32)

    def ids(self, df: DataFrame, names: tuple[str, ...], unknown: int, most: int | None = None, direction: str = "right") -> DataFrame:
        """(pos and a column of ids for each of these text columns); with ``most`` at least that many ids from the ``direction``'s
        start, where a text has them. Words are looked up where their row is; only with a vocabulary over MAX_TOKENS they are
        shuffled to it."""
        few = self._table()
        if few is not None:
            shared = df.sparkSession.sparkContext.broadcast(few)

            def found(texts: pa.Array) -> pa.Array:
                tokens, numbers = shared.value
                if pc.any(pc.match_substring_regex(texts, _WIDE_SPACES)).as_py():
                    texts = pc.replace_substring_regex(texts, _WIDE_SPACES, " ")
                words = pc.ascii_split_whitespace(texts)
                flat, ends = words.flatten(), np.asarray(words.offsets, np.int64)
                full = n_bytes(flat) > 0  # a text may begin or end with white space
                ends = np.concatenate(([0], np.cumsum(full)))[ends - ends[0]]
                at = pc.index_in(flat, value_set=tokens).filter(pa.array(full))
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.fill_null(pc.take(pa.array(numbers), at), unknown))

            def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for part in runs(b, sum(n_bytes(b.column(n)) for n in names)):
                        yield pa.RecordBatch.from_arrays([part.column("pos"), *(found(part.column(n)) for n in names)], ["pos", *names])

            kinds = ", ".join(["pos long", *(f"`{n}` array<int>" for n in names)])
            return self._texts(df, names, most, direction).mapInArrow(looked_up, kinds)
        out = None
        for name in names:
            split = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
            words = self._texts(df, (name,), most, direction).select("pos", F.posexplode_outer(split).alias("at", "token"))
            known = words.join(self.vocabulary.select("token", "id"), "token", "left")
            told = F.struct("at", F.coalesce("id", F.lit(unknown)).cast("int").alias("id"))
            # a text without words has one row without a word
            rows = known.groupBy("pos").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), told))).alias("x"))
            rows = rows.select("pos", F.transform("x", lambda x: x["id"]).alias(name))
            out = rows if out is None else out.join(rows, "pos")
        return out

    def encode(self, df: DataFrame, pair: bool = False, add_special_tokens: bool = True, max_length: int | None = None, direction: str = "right") -> DataFrame:
        """(pos, input_ids, attention_mask, token_type_ids); a length limit counts the special tokens, and takes from the
        longer text of a pair first."""
        unknown, first, last = self._special()
        room = None if max_length is None else max_length - (2 + pair) * add_special_tokens
        if room is not None and room < 0:
            raise ValueError("the special tokens do not fit")
        # of a pair, too, no more than the room is left of either text
        rows = self.ids(df, ("text", "text_pair")[: 1 + pair], unknown, room, "right" if pair else direction)
        a, b = F.col("text"), F.col("text_pair") if pair else F.array().cast("array<int>")
        if room is not None:
            a, b = tokens.truncate_pair(a, b, room) if pair else (tokens.truncate(a, room, direction), b)
        one = lambda i: F.array(F.lit(i))
        rows = rows.select("pos", a.alias("a"), b.alias("b"))
        head, tail = F.col("a"), F.col("b")
        if add_special_tokens:
            head = F.concat(one(first), head, one(last))
            tail = F.concat(tail, one(last)) if pair else tail
        rows = rows.select("pos", F.concat(head, tail).alias("input_ids"), F.concat(F.transform(head, lambda _: F.lit(0)), F.transform(tail, lambda _: F.lit(1))).alias("token_type_ids"))
        return rows.select("pos", "input_ids", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"), "token_type_ids")

    def decode(self, df: DataFrame, skip_special_tokens: bool = True) -> DataFrame:
        """(pos, text) of rows (pos, input_ids): tokens joined by spaces. An id that the vocabulary does not have is an
        error."""
        hidden = (self.unknown, self.first, self.last, self.padding) if skip_special_tokens else ()
        few = self._table()
        if few is not None:
            shared = df.sparkSession.sparkContext.broadcast(few)

            def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, numbers = shared.value
                numbers = pa.array(numbers)
                said = pc.invert(pc.is_in(names, value_set=pa.array(hidden, pa.string()))).to_numpy(zero_copy_only=False)
                said = np.append(said, False)  # for a null
                for b in (part for b in batches for part in runs(b, 4 * np.asarray(pc.fill_null(pc.list_value_length(b.column("input_ids")), 0)))):
                    ids = b.column("input_ids")
                    flat = ids.flatten().cast(pa.int32())
                    at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=numbers), -1))
                    if missing := np.flatnonzero((at < 0) & flat.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        raise ValueError(f"no token has the id {flat[missing[0]].as_py()}")
                    keep = said[at]
                    size = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
                    ends = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(size)))]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.take(names, pa.array(at[keep])))
                    yield pa.RecordBatch.from_arrays([b.column("pos"), pc.binary_join(lists, " ")], ["pos", "text"])

            return df.select("pos", "input_ids").mapInArrow(joined, "pos long, text string")
        words = df.select("pos", F.posexplode_outer("input_ids").alias("at", "id"))
        known = words.join(self.vocabulary.select("id", "token"), "id", "left")
        said = F.raise_error(F.concat(F.lit("no token has the id "), F.col("id").cast("string")))
        token = F.when(F.col("id").isNotNull() & F.col("token").isNull(), said).otherwise(F.col("token"))
        keep = F.col("id").isNotNull()
        if skip_special_tokens:
            keep = keep & ~F.coalesce(F.col("token").isin(*hidden), F.lit(False))
        rows = known.groupBy("pos").agg(F.array_sort(F.collect_list(F.when(keep, F.struct("at", token.alias("token"))))).alias("x"))
        return rows.select("pos", F.array_join(F.transform("x", lambda x: x["token"]), " ").alias("text"))


def collate(df: DataFrame, size: int, pad_id: int, labels: str = "sample", pad_to: int | None = None, side: str = "right", multiple: int = 1, ignore: int = -100) -> DataFrame:
    """Encoded rows (with pos, and label for labels="sample") as rectangular batches: batch_id, batch_pos, padded columns,
    position_ids, length and labels. Padding goes to the batch's longest row or to ``pad_to``, never shortening one."""
    rows = df.withColumns({"batch_id": F.floor(F.col("pos") / size), "batch_pos": (F.col("pos") % size).cast("int"), "length": F.size("input_ids")})
    w = Window.partitionBy("batch_id")
    width = F.max("length").over(w) if pad_to is None else F.lit(pad_to)
    rows = rows.withColumn("width", (F.ceil(width / multiple) * multiple).cast("int"))
    rows = rows.withColumn("width", checked(F.col("length") <= F.col("width"), F.col("width"), "a row is longer than the padding"))
    rows = rows.withColumns({"input_ids": tokens.pad(F.col("input_ids"), F.col("width"), pad_id, side), "attention_mask": tokens.pad(F.col("attention_mask"), F.col("width"), 0, side), "token_type_ids": tokens.pad(F.col("token_type_ids"), F.col("width"), 0, side)})
    rows = rows.withColumn("position_ids", tokens.positions(F.col("attention_mask")))
    if labels == "causal":
        if "label" in df.columns:
            raise ValueError("causal labels do not go with sample labels")
        rows = rows.withColumn("labels", tokens.causal_labels(F.col("input_ids"), F.col("attention_mask"), ignore))
    elif "label" in df.columns:
        some = F.count("label").over(w)
        rows = rows.withColumn("label", F.when((some == 0) | (some == F.count("*").over(w)), F.col("label")).otherwise(F.raise_error(F.lit("a batch has labels for some rows only"))))
    return rows.drop("width")
