"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts anywhere else.

A sample of suffixes stands for all of them, as in a difference cover: two equal LENGTH-byte strings must contain a
sampled place at the same offset. Here the content picks the sample (the least hash of WINDOW consecutive
GRAM-byte strings), so the cover holds for any two places of any two texts with one suffix in about WINDOW / 2.

1. Each sampled suffix is named by its first phrase, up to the next sampled place, and by its whole context, the bytes
   of all LENGTH-byte strings that it stands for.
2. Suffixes are sorted by (name, context). Adjacent suffixes with equal contexts settle all their strings at once.
3. In a name with several contexts one suffix of each context brings its bytes, and the remaining suffixes (the
   strings' own starts) are merged by their offset and first LENGTH bytes; equal neighbours are repeats.
4. Repeats become spans, and spans are joined to their texts.

A name with over HOT suffixes (a passage that very many texts share) is in no task whole: its contexts are counted by
(name, context), and the strings' own starts by (name, offset, hash of the LENGTH bytes), with partial sums before the
shuffle.

Equal whole texts are settled first (all but one leave the sort), and so are equal contexts inside a text, so that
copies and periodic texts do not fill one name. Contexts are compared by 128 bits of hash, single strings byte by byte (by
128 bits where they are counted), whole texts by their MD5 and length. Matches never cross texts. Null and empty texts
have nothing to remove; texts under LENGTH bytes cannot repeat. Texts are whole however long. Rows that repeat an id
(null too) keep their own spans, and equal rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_IDS, Scratch, loads, mixed, range_hashes, settled, shared_dir, sorted_groups, utf8_blocks, window_hashes

LENGTH, WINDOW, GRAM = 200, 88, 24
#: A string's sampled place and the phrase there are inside the string: the next place after the first is found in time.
assert 2 * WINDOW + GRAM <= LENGTH
#: Suffixes up to which one task takes a name whole: about 2 MB of bytes, as one block of ``_merged``.
HOT = 8192
#: Bytes of a block of texts; arrays of eight bytes for each of its bytes stay in the cache.
BLOCK = 1 << 18


def gram_order(data: np.ndarray) -> np.ndarray:
    """A number for the GRAM bytes from each place on, in the upper 32 bits; it only orders places, and decides nothing."""
    x = loads(data).copy()
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ (h >> np.uint64(29)) ^ x[k : k + n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
    return h


def sampled(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block: (text, place, first start, last start, name, context, context2) of every sampled suffix; places count
    from the block's start. The starts are of the strings that the place stands for; a context is 128 bits."""
    none = (np.empty(0, np.int64),) * 7
    if len(data) < LENGTH:
        return none
    x = np.arange(len(data) - GRAM + 1)
    low = np.uint64(0xFFFFFFFF)
    v = (gram_order(data) & ~low) | x.astype(np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        v, span = np.minimum(v[:-span], v[span:]), 2 * span
    if span < WINDOW:
        v = np.minimum(v[: len(v) - (WINDOW - span)], v[WINDOW - span :])
    least = (v & low).astype(np.int64)
    s = np.arange(len(data) - LENGTH + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(s)]
    ok = s + LENGTH <= offsets[text + 1]
    s, text = s[ok], text[ok]
    if not len(s):
        return none
    place = least[s]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(s)) - 1
    p, lo, hi = place[first], s[first], s[last]
    (name,) = range_hashes(data, p, least[p + 1] + GRAM)
    context, context2 = range_hashes(data, lo, hi + LENGTH, 2)
    off = (p - lo).astype(np.uint64)
    return text[first], p, lo, hi, name.view(np.int64), (context ^ mixed(off)).view(np.int64), (context2 ^ off).view(np.int64)


def _suffixes(docs: DataFrame) -> DataFrame:
    """(name, context, context2, doc, lo, hi, off, twice): one row per text and context; twice: it has an equal one in the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc").to_numpy()
            for at, o, d in utf8_blocks(b.column("text"), BLOCK):
                got = sampled(o, d)
                order = np.lexsort((got[1], got[6], got[5], got[0]))
                text, p, lo, hi, name, context, context2 = (a[order] for a in got)
                same = np.concatenate(([False], (text[1:] == text[:-1]) & (context[1:] == context[:-1]) & (context2[1:] == context2[:-1]) & (name[1:] == name[:-1])))
                twice = same | np.append(same[1:], False)
                start = o[text]
                # the first of equal ones goes on; the others are spans already, and told as such by off = -1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a) for a in (name, context, context2, ids[at + text], lo - start, hi - start, np.where(same, -1, p - lo), twice)],
                    ["name", "context", "context2", "doc", "lo", "hi", "off", "twice"],
                )

    return docs.mapInArrow(made, "name long, context long, context2 long, doc long, lo long, hi long, off long, twice boolean")


_SORTED = "doc long, lo long, hi long, off long, name long, twice boolean, repeat boolean, check boolean"


def _hot_names(suffixes: DataFrame) -> DataFrame:
    """The names with over HOT suffixes."""
    names = suffixes.where("off >= 0").groupBy("name").agg(F.count("*").alias("c"))
    return settled(names.where(F.col("c") > HOT).select("name"), "hot")


def _few(keys: DataFrame) -> DataFrame:
    """Settled keys, broadcast up to an eighth of MAX_IDS; beyond, both sides of the join are shuffled, and Spark splits
    what is skewed."""
    return F.broadcast(keys) if keys.count() <= MAX_IDS // 8 else keys


def _counted(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_compared``, for hot names, by counts: (doc, lo, hi) of certain repeats, and what must be checked."""
    rows = suffixes.where("off >= 0")
    # the columns of one row: all firsts of a group are taken from the same
    one = [F.first(c).alias(c) for c in ("doc", "lo", "hi", "off")]
    groups = settled(rows.groupBy("name", "context", "context2").agg(F.count("*").alias("c"), *one), "contexts")
    several = settled(groups.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "several")
    checks = groups.join(_few(several), "name", "left_semi").select("name", "doc", "lo", "hi", "off")
    again = groups.where("c > 1").select("name", "context", "context2")
    more = rows.where("not twice").join(_few(again), ["name", "context", "context2"], "left_semi")
    return rows.where("twice").select("doc", "lo", "hi").union(more.select("doc", "lo", "hi")), checks


def _compared(suffixes: DataFrame) -> DataFrame:
    """Sorted by (name, context): what is a repeat for certain and what must be checked byte by byte."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "name"):
            name, context, context2, twice = (t.column(c).to_numpy() for c in ("name", "context", "context2", "twice"))
            new_name = np.concatenate(([True], name[1:] != name[:-1]))
            new = new_name | np.concatenate(([True], (context[1:] != context[:-1]) | (context2[1:] != context2[:-1])))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(new)))
            cls = np.cumsum(new) - 1
            repeat = (n[cls] > 1) | twice
            contexts = np.bincount(np.cumsum(new_name) - 1, weights=new)[np.cumsum(new_name) - 1]
            check = new & (contexts > 1)
            keep = repeat | check
            cols = [t.column(c).combine_chunks() for c in ("doc", "lo", "hi", "off", "name")]
            out = pa.table([*cols, pa.array(repeat), pa.array(repeat), pa.array(check)], _names(_SORTED))
            yield from out.filter(pa.array(keep)).to_batches()

    rows = suffixes.where("off >= 0").repartition("name").sortWithinPartitions("name", "context", "context2")
    return rows.mapInArrow(made, _SORTED)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fetched(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """The suffixes ``checks`` (name, doc, lo, hi, off) with the bytes of their strings."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {k: [] for k in ("name", "doc", "lo", "hi", "off", "bytes")}
            for doc, text, want in zip(b.column("doc").to_pylist(), b.column("text"), b.column("want").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for w in want:
                    for k in ("name", "lo", "hi", "off"):
                        rows[k].append(w[k])
                    rows["doc"].append(doc)
                    rows["bytes"].append(data[w["lo"] : w["hi"] + LENGTH])
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[k], pa.int64()) for k in ("name", "doc", "lo", "hi", "off")], pa.array(rows["bytes"], pa.binary())], list(rows))

    want = checks.groupBy("doc").agg(F.collect_list(F.struct("name", "lo", "hi", "off")).alias("want"))
    texts = _near(docs, checks.select("doc").distinct())
    return texts.join(want, "doc").mapInArrow(fetched, "name long, doc long, lo long, hi long, off long, bytes binary")


def _starts(lo: np.ndarray, hi: np.ndarray, strings: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, k, hash, begin, bytes) of every LENGTH-byte string of suffixes: it starts at the row's lo + k, and at
    ``begin`` in ``bytes``."""
    data = np.frombuffer(b"".join(x.as_buffer() for x in strings), np.uint8)
    starts = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), starts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    begin = np.repeat(np.cumsum(starts + LENGTH - 1) - (starts + LENGTH - 1), starts) + k
    return row, k, window_hashes(data, LENGTH)[begin], begin, data


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LENGTH-byte strings at ``a`` and ``b`` are the same, byte by byte."""
    x, same = loads(data), np.ones(len(a), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= x[a + k] == x[b + k]
    return same


def _merged(rows: DataFrame) -> DataFrame:
    """(doc, lo, hi): runs of starts whose strings repeat, from fetched suffixes of several contexts."""

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "name"):
            name, doc, lo, hi, off = (t.column(c).to_numpy() for c in ("name", "doc", "lo", "hi", "off"))
            cut = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            size = np.cumsum(hi - lo + LENGTH)
            first = 0
            while first < len(cut):  # whole names, about 2 MB of bytes at a time
                base = size[cut[first] - 1] if cut[first] else 0
                last = max(first + 1, int(np.searchsorted(size[np.append(cut[1:], len(name)) - 1], base + (1 << 21), "right")))
                a, z = cut[first], cut[last] if last < len(cut) else len(name)
                row, k, h, begin, data = _starts(lo[a:z], hi[a:z], t.column("bytes").slice(a, z - a))
                row += a
                order = np.lexsort((h, off[row] - k, name[row]))
                h2, o2, n2 = h[order], (off[row] - k)[order], name[row][order]
                same = (h2[1:] == h2[:-1]) & (o2[1:] == o2[:-1]) & (n2[1:] == n2[:-1])
                same[same] = _equal(data, begin[order[1:][same]], begin[order[:-1][same]])
                hit = np.zeros(len(row), bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                d = np.flatnonzero(hit)
                if len(d):
                    head = np.concatenate(([True], (d[1:] != d[:-1] + 1) | (row[d[1:]] != row[d[:-1]])))
                    f, l = d[head], np.append(d[:-1][head[1:]], d[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row[f]]), pa.array(lo[row[f]] + k[f]), pa.array(lo[row[l]] + k[l])], ["doc", "lo", "hi"])
                first = last

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(equal, "doc long, lo long, hi long")


def _spelled(rows: DataFrame) -> DataFrame:
    """(name, o, h, h2, doc, at): every start of fetched suffixes by its offset from the sampled place and 128 bits of hash
    of its bytes."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                b = whole.slice(first, 2048)
                name, doc, lo, hi, off = (b.column(c).to_numpy() for c in ("name", "doc", "lo", "hi", "off"))
                row, k, h, begin, data = _starts(lo, hi, b.column("bytes"))
                h2 = window_hashes(data, LENGTH, 1)[begin]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name[row], off[row] - k, h.view(np.int64), h2.view(np.int64), doc[row], lo[row] + k)], ["name", "o", "h", "h2", "doc", "at"])

    return rows.mapInArrow(spelled, "name long, o long, h long, h2 long, doc long, at long")


def _merged_hot(rows: DataFrame) -> DataFrame:
    """As ``_merged``, for hot names: the starts are counted, so no task needs all suffixes of a name."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, at = b.column("doc").to_numpy(), b.column("at").to_numpy()
                head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))))
                last = np.append(head[1:], len(doc)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(at[head]), pa.array(at[last])], ["doc", "lo", "hi"])

    starts = _spelled(settled(rows, "fetched"))
    key = ["name", "o", "h", "h2"]
    again = settled(starts.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key), "again")
    return starts.join(_few(again), key, "left_semi").select("doc", "at").mapInArrow(runs, "doc long, lo long, hi long")


def _near(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, "doc", how)


def _keyed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows (doc_id, doc, text), and what gives ``docs`` with all its columns the same column doc. doc tells texts apart: the id itself where ids are unique
    and none is null, else a number for each pair of id and text (told by 256 bits), equal rows sharing one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = base.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n[0] == n[2]:
        return base.withColumn("doc", F.col("doc_id")), lambda t: t.withColumn("doc", F.col("doc_id").cast("long"))
    told = lambda t: (t["doc_id"].cast("long"), F.sha2(F.coalesce(t["text"].cast("string"), F.lit("")), 256))
    # written once, so that a number stays what it is
    ids = settled(base.select(*[c.alias(k) for k, c in zip(("i", "s"), told(base), strict=True)]).distinct().withColumn("doc", F.monotonically_increasing_id()), "numbers")

    def numbered(t: DataFrame) -> DataFrame:
        i, s = told(t)
        return t.join(ids, i.eqNullSafe(F.col("i")) & (s == F.col("s"))).drop("i", "s")

    return settled(numbered(base), "numbered"), numbered


def spans(docs: DataFrame) -> DataFrame:
    """(doc, starts, ends): the maximal removed runs of every text that has any, as arrays; docs: (doc, text)."""
    shared_dir(docs.sparkSession)
    size = F.octet_length("text").cast("long")
    whole = settled(docs.where(F.octet_length("text") >= LENGTH).select("doc", size.alias("n"), F.md5("text").alias("h")), "texts")
    # settled, so that the join below is of two plain shuffles: Spark splits the one that a large group of copies skews
    copies = settled(whole.groupBy("h", "n").agg(F.count("*").alias("c"), F.min("doc").alias("one")).where("c > 1").select("h", "n", "one"), "groups")
    copies = settled(whole.join(copies, ["h", "n"]).select("doc", "n", "one"), "copies")
    rest = _near(docs, copies.where("doc <> one").select("doc").distinct(), "left_anti")
    suffixes = settled(_suffixes(rest.where(F.octet_length("text") >= LENGTH)), "suffixes")
    hot = _hot_names(suffixes)
    some = bool(hot.take(1))
    ranked = settled(_compared(suffixes.join(_few(hot), "name", "left_anti") if some else suffixes), "ranked")
    inner = suffixes.where("off < 0").select("doc", "lo", "hi")
    checks = ranked.where("check").select("name", "doc", "lo", "hi", "off")
    runs = inner.union(ranked.where("repeat").select("doc", "lo", "hi")).union(_merged(_fetched(rest, checks)))
    if some:
        repeats, more = _counted(suffixes.join(_few(hot), "name", "left_semi"))
        runs = runs.union(repeats).union(_merged_hot(_fetched(rest, more)))
    covered = runs.select("doc", "lo", (F.col("hi") + LENGTH).alias("end")).union(copies.select("doc", F.lit(0).cast("long"), "n"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "doc"):
            doc, lo, end = (t.column(c).to_numpy() for c in ("doc", "lo", "end"))
            at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            big = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc)))) * (1 << 40)
            reach = np.maximum.accumulate(end + big)
            new = np.concatenate(([True], (lo + big)[1:] > reach[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            groups = np.searchsorted(first, np.append(at, len(doc)))
            off = pa.array(groups.astype(np.int32))
            s, e = lo[first], reach[last] - big[last]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.ListArray.from_arrays(off, pa.array(s)), pa.ListArray.from_arrays(off, pa.array(e))], ["doc", "starts", "ends"])

    return covered.repartition("doc").sortWithinPartitions("doc", "lo").mapInArrow(joined, "doc long, starts array<long>, ends array<long>")


def kept_bytes(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base, _ = _keyed(docs)
    with Scratch(docs.sparkSession) as tables:
        s = settled(spans(base.select("doc", "text")), "spans")
        tables.keep(s)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, x, y in zip(b.column("text"), b.column("starts"), b.column("ends"), strict=True):
                data = t.as_buffer().to_pybytes()
                x, y = x.as_py(), y.as_py()
                rows.append((len(data), sum(y) - sum(x), len(x), hashlib.sha256(kept_bytes(data, x, y)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], _names(schema))

    ids = s.select("doc")
    cut = _near(base, ids).join(s, "doc").select("doc_id", "text", "starts", "ends").mapInArrow(told, schema)
    whole = _near(base, ids, "left_anti")
    zero = F.lit(0).cast("long")
    return cut.union(whole.select("doc_id", F.octet_length("text").cast("long"), zero, zero, F.sha2("text", 256)))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its text; of a character that a cut splits nothing is left. Other
    columns stay as they are (n_chars too, where there is one, is counted anew)."""
    p = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    base, numbered = _keyed(docs)
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in p.items()], "doc_id", "text")
    held = numbered(held).drop("doc_id", "text")
    with Scratch(docs.sparkSession) as tables:
        s = settled(spans(base.select("doc", "text")), "spans")
        tables.keep(s)
    at = p["text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, x, y in zip(b.column(at), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                out.append(kept_bytes(data, x, y).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == at else b.column(n) for n in p.values()], list(p.values()))

    ids = s.select("doc")
    some = _near(held, ids).join(s, "doc")
    schema = held.drop("doc").schema
    out = some.mapInArrow(cut, schema).union(_near(held, ids, "left_anti").drop("doc"))
    back = [F.length(at).cast("long").alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in p.items()]
    return out.select(*back)
