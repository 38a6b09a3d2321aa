"""Held-out test items that stand, whole or in part, in corpus documents.

The n-grams of the normalised test items are a hash set that every task holds. Corpus documents are scanned once, in
Arrow batches, without a shuffle: token windows are hashed with numpy, looked up, and the documents and items that share
enough windows are verified by aligning the item with the part of the document where they lie. Every window of every
whole text is looked at and every pair of a document and an item with enough hits is verified. Leaked documents can be
dropped whole or have the leaked spans cut out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of test items that are held in memory at a time; more items are taken in several scans.
BLOCK_WORDS = 2_000_000
GRAM = 6
#: A passage counts from this many words (Chinese: characters) on.
PASSAGE = 12
SHARE = 0.4
#: Shared windows, as a share of the item's words, from which on a pair is verified.
WINDOWS = 0.15
#: Words in a row of either text that an alteration within a passage may span.
SLACK = 6

_WORDS = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")
_UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F])
_BITS = 22


def words(text: str | None) -> list[str]:
    """Words, and Chinese characters one by one, without case, width, punctuation, spacing and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_UNSEEN))
    return _WORDS.findall(text.lower())


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n ids from each position on."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - n + 1 + j].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
    return h


class TestItems:
    """Vocabulary, n-gram set and aligners of the test items."""

    __test__ = False

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.keys = [k for k, _ in items]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in items)))}
        self.ids = [[self.vocab[w] for w in ws] for _, ws in items]
        self.size = np.array([len(x) for x in self.ids], np.int64)
        grams, owner, place = [], [], []
        for i, x in enumerate(self.ids):
            if len(x) >= GRAM:
                g = _windows(np.array(x), GRAM)
                grams.append(g), owner.append(np.full(len(g), i)), place.append(np.arange(len(g)))
        grams, owner, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, np.uint64), (owner, np.int64), (place, np.int64)))
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.grams >> np.uint64(64 - _BITS)] = True
        self.matchers: dict[int, SequenceMatcher] = {}

    def hits(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``flat``, item, position in the item) of shared windows. ``room``: words left of the document there."""
        none = (np.zeros(0, np.int64),) * 3
        if len(flat) < GRAM or not len(self.grams):
            return none
        h = _windows(flat, GRAM)
        known = np.cumsum(np.concatenate([[0], flat == 0]))
        at = np.nonzero(self.bitmap[h >> np.uint64(64 - _BITS)] & (known[GRAM:] == known[:-GRAM]) & (room[: len(h)] >= GRAM))[0]
        where = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[where] == h[at]
        at, where = at[real], where[real]
        if not len(at):
            return none
        n = self.count[where]
        at = np.repeat(at, n)
        index = np.repeat(self.first[where] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(len(at))
        return at, self.owner[index], self.place[index]

    def held(self, item: int, doc: list[int], shifts: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
        """Share of the item's words that the document holds in passages, and where those begin and end in the document. ``shifts``: where the item
        would begin in the document, least and greatest, for each place where they run alongside."""
        size = len(self.ids[item])
        if item not in self.matchers:
            self.matchers[item] = SequenceMatcher(None, "", self.ids[item], autojunk=False)
        match = self.matchers[item]
        covered: set[int] = set()
        passages: set[tuple[int, int]] = set()
        for least, most in shifts:
            lo, hi = max(0, least - SLACK), min(len(doc), most + size + SLACK)
            match.set_seq1(doc[lo:hi])
            run: list[tuple[int, int, int]] = []
            for block in [*match.get_matching_blocks(), (1 << 40, 1 << 40, 0)]:
                a, b, n = block
                if run and (a - run[-1][0] - run[-1][2] > SLACK or b - run[-1][1] - run[-1][2] > SLACK):
                    if sum(r[2] for r in run) >= PASSAGE:
                        passages.add((lo + run[0][0], lo + run[-1][0] + run[-1][2]))
                        for _, y, m in run:
                            covered.update(range(y, y + m))
                    run = []
                if n > 1 or (run and n):
                    run.append((a, b, n))
        return len(covered) / size, sorted(passages)

    def whole(self, flat: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position in ``flat``, item, words) of items of fewer than PASSAGE words that stand whole in a document (``of`` each word)."""
        for n in sorted(set(self.size[self.size < PASSAGE].tolist()) - {0}):
            if len(flat) < n:
                break
            h, inside = _windows(flat, n), of[: len(flat) - n + 1] == of[n - 1 :]
            for i in np.nonzero(self.size == n)[0].tolist():
                own = _windows(np.array(self.ids[i]), n)[0]
                for at in np.nonzero((h == own) & inside)[0].tolist():
                    if flat[at : at + n].tolist() == self.ids[i]:
                        yield at, i, n


def _blocks(items: list[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    block, n = [], 0
    for key, ws in items:
        if block and n + len(ws) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((key, ws))
        n += len(ws)
    if block:
        yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", short: bool = False) -> DataFrame:
    """(doc id, item id, ``share``, ``passages``, ``starts``, ``ends``: the passages' first words and ends in the document) of each document that holds at least SHARE of an item's words in the item's
    wording and order, in passages of at least PASSAGE words with alterations of at most SLACK words in a row.

    Items are few by nature; they are read to the driver and taken BLOCK_WORDS at a time, so that what a task holds is
    bounded. Items of fewer than PASSAGE words can't hold a passage; with ``short`` they count where they stand whole.
    Documents or items with a null, empty or very short text have no row; repeated items have one each; an
    empty side gives no row. Other columns are ignored.
    """
    known = [(r[0], words(r[1])) for r in items.select(item_id, text).toLocalIterator()]
    known = [(k, w) for k, w in known if len(w) >= (1 if short else PASSAGE)]
    key = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, key), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("share", T.DoubleType()), T.StructField("passages", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends"))])
    plain = docs.select(doc_id, text)
    out = None
    for block in _blocks(known):
        part = plain.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), doc_id, text, item_id, schema), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _scan(block, doc_id: str, text: str, item_id: str, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tests, arrow = TestItems(block.value), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = list(_found(tests, part.column(text).to_pylist()))
                if rows:
                    ids = part.column(doc_id)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([r[0] for r in rows])), pa.array([tests.keys[r[1]] for r in rows], arrow.field(1).type),
                        pa.array([r[2] for r in rows], pa.float64()), pa.array([len(r[3]) for r in rows], pa.int32()),
                        *(pa.array([[s[e] for s in r[3]] for r in rows], pa.list_(pa.int32())).cast(arrow.field(4 + e).type) for e in (0, 1)),
                    ], schema=arrow)

    return run


def _found(tests: TestItems, texts: list[str | None]) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
    """(index of the text, index of the item, share, where the passages begin and end)."""
    docs = [words(t) for t in texts]
    size = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter(map(tests.vocab.get, chain.from_iterable(docs), repeat(0)), np.int64, int(size.sum()))
    ends = size.cumsum()
    of = np.repeat(np.arange(len(docs)), size)
    brief: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, i, n in tests.whole(flat, of):
        d = int(of[p])
        brief.setdefault((d, i), []).append((p - int(ends[d] - size[d]), p - int(ends[d] - size[d]) + n))
    for (d, i), spans in brief.items():
        yield d, i, 1.0, spans
    at, item, place = tests.hits(flat, np.repeat(ends, size) - np.arange(len(flat)))
    if not len(at):
        return
    pair = of[at] * len(tests.keys) + item
    shift = at - (ends - size)[of[at]] - place
    order = np.lexsort((shift, pair))
    pair, shift = pair[order], shift[order]
    # windows of one pair that lie at about the same shift run alongside each other
    first = np.nonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(shift) > 2 * SLACK)]))[0]
    count = np.diff(np.append(first, len(pair)))
    long = count >= PASSAGE - GRAM
    pairs, least, most, count = pair[first][long], shift[first][long], shift[first + count - 1][long], count[long]
    if not len(pairs):
        return
    heads = np.nonzero(np.concatenate([[True], np.diff(pairs) != 0]))[0]
    total, stops = np.add.reduceat(count, heads), np.append(heads[1:], len(pairs))
    # Two fifths of an item, one word in eight altered, or in passages of a dozen words, share more windows than this.
    enough = total >= WINDOWS * tests.size[pairs[heads] % len(tests.keys)]
    for a, b in zip(heads[enough].tolist(), stops[enough].tolist()):
        d, i = divmod(int(pairs[a]), len(tests.keys))
        doc = flat[ends[d] - size[d] : ends[d]].tolist()
        share, passages = tests.held(i, doc, list(zip(least[a:b].tolist(), most[a:b].tolist())))
        if share >= SHARE:
            yield d, i, share, passages


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold test items; documents with a null id stay."""
    return docs.join(found.select(doc_id).distinct(), doc_id, "left_anti")


def _places(text: str) -> list[tuple[str, int, int]]:
    """The :func:`words` of a text with the code points that each covers. A base character and its marks are normalised together."""
    made, origin, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or text[j] == "\u200d"):
            j += 1
        part = unicodedata.normalize("NFKC", text[i:j].translate(_UNSEEN)).lower()
        made.append(part)
        origin += [(i, j)] * len(part)
        i = j
    return [(m.group(), origin[m.start()][0], origin[m.end() - 1][1]) for m in _WORDS.finditer("".join(made))]


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words from ``start`` to before ``end`` of each span, and what stands between them."""
    places = _places(text)
    if [w for w, _, _ in places] != words(text):  # a rare composition across characters: the words themselves are what is left
        kept = np.ones(len(words(text)), bool)
        for a, b in spans:
            kept[a:b] = False
        return " ".join(w for w, k in zip(words(text), kept) if k)
    out, at = [], 0
    for a, b in sorted(spans):
        if b > a and places[b - 1][2] > at:
            out.append(text[at : max(at, places[a][1])])
            at = places[b - 1][2]
    return "".join([*out, text[at:]])


def without_spans(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the leaked passages cut out of ``text``, and ``words_cut``, the passages' words summed (of two that overlap both count); other documents stay as they are."""
    spans = found.select(doc_id, F.explode(F.arrays_zip("starts", "ends")).alias("s")).groupBy(doc_id).agg(F.collect_set("s").alias("_spans"))  # a document's own

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, [(s["starts"], s["ends"]) for s in x]) for t, x in zip(texts, own)])

    met = docs.join(spans, doc_id, "left")
    held, rest = met.filter(F.col("_spans").isNotNull()), met.filter(F.col("_spans").isNull())
    total = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["ends"] - s["starts"])
    whole = lambda d, value, n: d.select(*(value.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns), n.alias("words_cut"))
    return whole(held, cut(F.col(text), F.col("_spans")), total).unionByName(whole(rest, F.col(text), F.lit(0)))


def leaks_by_item(found: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Which test items leaked, into how many documents."""
    return found.groupBy(item_id).agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("most"))
