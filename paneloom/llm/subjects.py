"""Subjects of documents by label propagation over a graph of passages.

The graph's nodes are the sentences of all documents; two sentences are neighbours if they share a phrase (a word, or
three Chinese characters in a row). It is kept factorised, as sentence-phrase edges, so that a phrase with a million
sentences is a million edges and not their square. Labels start at a few labelled documents and the subjects'
descriptions and spread in rounds, until they settle: a phrase takes the labels of its sentences, a sentence the
labels of its phrases. Edges are verified: a phrase must stand in several *different* sentences (copies of a sentence,
as of small talk and disclaimers, count once) and its labels must be purer than chance, and a sentence takes a
label only by several phrases that agree on it. Seeds whose own sentences bear them out are trusted and clamped: their
sentences take no other subjects. A sentence has one subject or none, a document as many as take a fair share of its sentences.

Edges lie with a block of documents, in a table bucketed by block, and name a phrase by its place among the block's
distinct phrases. The phrase labels are a table too: a round joins them with the blocks' distinct phrases, sends each block
its own, and sums a block's labels by phrase before they are shuffled. What a task holds is a block and its phrases,
however many phrases the corpus has.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: A phrase is a node if it stands in at least so many different sentences, however large the corpus.
LEAST_SENTENCES = 5
#: Labels have settled when the subjects' sums of a round differ from the last round's by less than this share; at most so many rounds.
SETTLED, ROUNDS = 0.05, 12
#: Score that a sentence must reach to be devoted to its best subject: purity-weighted log lift, in units of the greatest
#: lift of one phrase (the logarithm of the number of subjects).
DEVOTED = 0.455
#: Score, in the same units, that the phrases other than the strongest must add.
AGREED = 0.1
#: Share of the sentences with a subject that a subject must have to be one of the document's.
SUBJECT_SHARE = 0.25
#: Share of its sentences that must have a subject, or else the document mentions subjects in passing only.
ABOUT = 1 / 3
PRIOR = 0.5
#: Added to a subject's share of all labels when a phrase's share is divided by it: few labels are no evidence.
LEAST_CHANCE = 0.01
#: Bytes of text in a block of documents (one document is never split).
BLOCK = 4 << 20

#: Identifiers and calls (up to their own last character: what follows, a sentence end too, is text), words, runs of ideographs, numbers, sentence ends.
_TOKENS = re.compile(r"[a-z0-9]+[_(](?:[a-z0-9_(),.]*[a-z0-9_)])?|[a-z]+|[㐀-鿿]+|\d[\d.,]*\d|\d|\.(?=\s|$)|[!?;。\n\r]")
_CJK, _STOP, _NUMBER = 1 << 40, -1, -2


class _Ids(dict):
    """Token -> id: 32-bit checksum of a word, _CJK of a run of ideographs, _STOP of a sentence end,
    _NUMBER of what is no phrase: numbers, identifiers and calls."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c.isdigit() or "_" in token or "(" in token:
            own = _NUMBER
        elif "a" <= c <= "z":
            own = zlib.crc32(token.encode())
        else:
            own = _STOP if ord(c) < 0x3100 else _CJK
            if own == _CJK:
                return own  # runs are too many to remember
        self[token] = own
        return own


def sentence_phrases(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, number of the sentence, phrase) of all distinct edges, in this order. Case, width and compatibility
    forms don't matter; numbers are no phrases; null, empty and wordless texts have no edge."""
    found: list[list[str]] = []
    for t in texts:
        t = t or ""
        found.append(_TOKENS.findall((t if t.isascii() else unicodedata.normalize("NFKC", t)).lower() + "\n"))
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = list(chain.from_iterable(found))
    tok = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(found)), size)
    stop = (tok == _STOP).astype(np.int64)
    sentence = np.cumsum(stop) - stop  # an end belongs to the sentence that it ends
    word = (tok >= 0) & (tok < _CJK)
    runs = np.nonzero(tok == _CJK)[0]
    strings = [flat[i] for i in runs]
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64)
    head = np.nonzero(np.arange(len(points)) + 2 < np.repeat(length.cumsum(), length))[0]
    three = np.repeat(runs, length)[head]
    with np.errstate(over="ignore"):
        mixed = points[head]
        for j in (1, 2):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + points[head + j]
            mixed ^= mixed >> np.uint64(31)
    at = np.concatenate([np.nonzero(word)[0], three])
    phrase = np.concatenate([tok[word], (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64)])
    edge = np.unique((sentence[at].astype(np.uint64) << np.uint64(32)) | phrase.astype(np.uint64))
    of, phrase = (edge >> np.uint64(32)).astype(np.int64), (edge & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.zeros(int(sentence[-1]) + 1 if len(sentence) else 1, np.int64)
    first[sentence[::-1]] = doc[::-1]
    return first[of], of, phrase


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row a block of documents: (``block``, ``ids``, ``seeds``, ``counts``: sentences of each document, ``sizes``:
    phrases of each sentence, ``edges``: places of those phrases in ``phrases``, the block's distinct ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, block = _Ids(), TaskContext.get().partitionId() << 32
        for batch in batches:
            of = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum() // BLOCK
            cuts = (np.nonzero(np.diff(of))[0] + 1).tolist()
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(at, end - at)
                if not part.num_rows:
                    continue
                if len(ids) > 500_000:
                    ids.clear()
                found, before = [], 0
                for first in range(0, part.num_rows, 250):  # few enough for the processor's caches
                    doc, sentence, phrase = sentence_phrases(part.column(text).slice(first, 250).to_pylist(), ids)
                    found.append((doc + first, sentence + before, phrase))
                    before += int(sentence[-1]) + 1 if len(sentence) else 0
                doc, sentence, phrase = (np.concatenate(x) for x in zip(*found))
                heads = np.nonzero(np.concatenate([[True], np.diff(sentence) != 0]))[0] if len(doc) else np.zeros(0, np.int64)
                places = pa.array(phrase).dictionary_encode()
                lists = [
                    part.column(doc_id), part.column("seed").cast(pa.int64()).fill_null(0), np.bincount(doc[heads], minlength=part.num_rows).astype(np.int32),
                    np.diff(np.append(heads, len(doc))).astype(np.int32), places.indices, places.dictionary,
                ]
                lists = [x if isinstance(x, pa.Array) else pa.array(x) for x in lists]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names=["block", "ids", "seeds", "counts", "sizes", "edges", "phrases"])
                block += 1

    kinds = {"ids": docs.schema[doc_id].dataType, "seeds": T.LongType(), "counts": T.IntegerType(), "sizes": T.IntegerType(), "edges": T.IntegerType(), "phrases": T.LongType()}
    return docs.select(doc_id, text, "seed").mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), *(T.StructField(n, T.ArrayType(x)) for n, x in kinds.items())]))


def _seeds(labels: DataFrame, doc_id: str, subjects: list[str]) -> DataFrame:
    """(doc id, ``seed``: bits of its labelled subjects)."""
    bit = F.create_map(*chain.from_iterable((F.lit(s), F.lit(1 << i)) for i, s in enumerate(subjects)))
    known = labels.filter(F.col("subject").isin(*subjects) & F.col(doc_id).isNotNull())
    return known.groupBy(doc_id).agg(F.bit_or(bit[F.col("subject")]).alias("seed"))


def votes(sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Phrase step: from the summed labels of its sentences a phrase gets, for each subject, log of lift times purity.
    Sums are taken in proportion to a subject's share of all labels (``totals``), so that lift and purity don't depend on
    how much of the corpus a subject holds."""
    k = len(totals)
    chance = (totals + 1e-9) / (totals.sum() + 1e-9 * k)
    lift = (sums + PRIOR * chance) / (sums.sum(1, keepdims=True) + PRIOR) / (chance + LEAST_CHANCE)
    p = lift / lift.sum(1, keepdims=True)
    purity = np.clip(1 + (p * np.log(p + 1e-9)).sum(1, keepdims=True) / np.log(max(2, k)), 0, 1) ** 2
    return np.log((p + 1e-3) / (1 / k + 1e-3)) * purity


def _voted(blocks: DataFrame, sums: DataFrame, totals: np.ndarray) -> DataFrame:
    """``blocks`` with ``votes`` (place, labels as 32-bit floats) of those of its phrases that are nodes."""
    names = [f"s{j}" for j in range(len(totals))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = votes(np.stack([batch.column(n).to_numpy() for n in names], 1), totals).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("phrase"), pa.array([v.tobytes() for v in made], pa.binary())], names=["phrase", "vote"])

    own = blocks.select("block", F.posexplode("phrases").alias("place", "phrase")).join(sums.mapInArrow(run, "phrase long, vote binary"), "phrase")
    return blocks.join(own.groupBy("block").agg(F.collect_list(F.struct("place", "vote")).alias("votes")), "block", "left")


class _Block:
    """Sentence step of one block: its edges and, where it has votes, each sentence's score by subject and its best subject, -1 for none."""

    def __init__(self, batch: pa.RecordBatch, i: int, k: int) -> None:
        part = {n: batch.column(n).slice(i, 1).flatten() for n in batch.schema.names if n != "block"}
        self.part, self.k = part, k
        counts, sizes, self.at = (part[n].to_numpy() for n in ("counts", "sizes", "edges"))
        self.documents, self.row, self.owner = len(counts), np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(sizes)), sizes)
        self.heads, self.phrases = np.cumsum(sizes) - sizes, part["phrases"].to_numpy() if "phrases" in part else None
        if "votes" not in part:
            return
        place, vote = part["votes"].flatten()
        self.node, own = place.to_numpy(), np.zeros((k, int(self.at.max()) + 1 if len(self.at) else 0))
        own[:, self.node] = np.frombuffer(b"".join(vote.to_pylist()), np.float32).reshape(-1, k).T
        if not len(self.at):
            self.score, self.best = np.zeros((0, k)), np.zeros(0, np.int64)
            return
        self.score = np.stack([np.add.reduceat(v[self.at], self.heads) for v in own], 1)
        best, most = self.score.argmax(1), self.score.max(1)
        strongest = np.maximum.reduceat(own[best[self.owner], self.at], self.heads)
        unit = np.log(max(2, k))
        self.best = np.where((most > DEVOTED * unit) & (most - strongest > AGREED * unit), best, -1)

    def by_subject(self) -> np.ndarray:
        """Sentences of each document and subject."""
        some = self.best >= 0
        return np.bincount(self.row[some] * self.k + self.best[some], minlength=self.documents * self.k).reshape(-1, self.k)

    def labels(self) -> np.ndarray:
        """Labels of each sentence: soft among the subjects, none below the thresholds; of seeds that their own sentences bear
        out, none of other subjects."""
        soft = np.exp(2 * (self.score - self.score.max(1, keepdims=True)))
        soft *= (self.best >= 0)[:, None] / soft.sum(1, keepdims=True)
        bits, n = (self.part["seeds"].to_numpy()[:, None] >> np.arange(self.k)) & 1, self.by_subject()
        trusted = 2 * (n * bits).sum(1) > n.sum(1)
        soft[trusted[self.row] & (bits[self.row, self.best] == 0)] = 0
        return soft

    def seeded(self) -> np.ndarray:
        """Labels of each sentence before the first round: those of its document in equal parts."""
        bits = (self.part["seeds"].to_numpy()[:, None] >> np.arange(self.k)) & 1
        return (bits / np.maximum(1, bits.sum(1, keepdims=True)))[self.row]

    def seen(self) -> np.ndarray:
        """For each phrase a set of 64 bits, one for each of its different sentences (some share a bit)."""
        with np.errstate(over="ignore"):
            h = self.phrases[self.at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = np.add.reduceat(h, self.heads) * np.uint64(0x9E3779B97F4A7C15)
        pair = np.unique(self.at.astype(np.int64) << 6 | (h >> np.uint64(58)).astype(np.int64)[self.owner])
        places = pair >> 6
        return np.bitwise_or.reduceat(np.uint64(1) << (pair & 63).astype(np.uint64), np.nonzero(np.diff(places, prepend=-1))[0]).view(np.int64)


def _sums(blocks: DataFrame, described: DataFrame, k: int) -> DataFrame:
    """(phrase, ``s0`` ...: labels of its sentences and of the descriptions, summed) of each node; a block's labels are its seeds
    where it has no votes yet, and its phrases are not known to be nodes then."""
    names, first = [f"s{j}" for j in range(k)], "votes" not in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i, k)
                if not len(b.at):
                    continue
                label = b.seeded() if first else b.labels()
                at, owner, node, seen = b.at, b.owner, slice(None) if first else b.node, [pa.array(b.seen())] if first else []
                some = label.any(1)[owner]
                if first or some.mean() < 0.5:
                    at, owner = at[some], owner[some]
                sums = [np.bincount(at, x[owner], len(b.phrases))[node] for x in np.ascontiguousarray(label.T)]
                yield pa.RecordBatch.from_arrays([pa.array(b.phrases[node]), *seen, *(pa.array(x, pa.float64()) for x in sums)], names=["phrase", *["seen"] * first, *names])

    schema = ", ".join(["phrase long", *["seen long"] * first, *(f"{n} double" for n in names)])
    made = blocks.select(*(n for n in blocks.columns if n not in ("block", "ids"))).mapInArrow(run, schema).unionByName(described, allowMissingColumns=True)
    summed = made.groupBy("phrase").agg(*[F.bit_or("seen").alias("seen")] * first, *(F.sum(n).alias(n) for n in names))
    return summed.filter(F.bit_count("seen") >= LEAST_SENTENCES).drop("seen") if first else summed


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: list[tuple[str, str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, ``subject``, ``share``, ``sentences``) of each subject that takes at least SUBJECT_SHARE of a document's sentences
    with a subject.

    ``labels`` has doc id and ``subject`` of some documents and may be wrong or repeated: labels start the propagation, and
    clamp it where a document's own sentences bear them out. ``subjects`` are names and descriptions. Documents with a
    null, empty or off-topic text or with subjects in less than ABOUT of their sentences, and all documents where there are
    no labels, have no row; ids are taken to be unique. Other columns are ignored.
    """
    names = [s for s, _ in subjects]
    k = len(names)
    seeded = docs.select(doc_id, text).join(_seeds(labels, doc_id, names), doc_id, "left")
    blocks = written(_blocks(seeded, doc_id, text), "block")
    of, _, phrase = sentence_phrases([d for _, d in subjects], _Ids())
    own = [(int(p), *(float(i == j) for j in range(k))) for i, p in zip(of, phrase)]
    described = docs.sparkSession.createDataFrame(own, ", ".join(["phrase long", *(f"s{j} double" for j in range(k))]))

    def totals(sums: DataFrame) -> np.ndarray:
        return np.array([x or 0.0 for x in sums.agg(*(F.sum(f"s{j}") for j in range(k))).first()])

    sums = written(_sums(blocks, described, k))
    now = totals(sums)
    for _ in range(ROUNDS):
        last, sums = now, written(_sums(_voted(blocks, sums, now), described, k))
        now = totals(sums)
        if np.abs(now - last).sum() <= SETTLED * now.sum():
            break

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i, k)
                ids, n = b.part["ids"], b.by_subject()
                labelled = n.sum(1, keepdims=True)
                share = n / np.maximum(1, labelled) * (labelled >= ABOUT * b.part["counts"].to_numpy()[:, None])
                d, j = np.nonzero(share >= SUBJECT_SHARE)
                if len(d):
                    cols = [ids.take(pa.array(d)), pa.array([names[x] for x in j]), pa.array(share[d, j]), pa.array(n[d, j].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "subject", "share", "sentences"])

    out = T.StructType([docs.schema[doc_id], T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("sentences", T.IntegerType())])
    return _voted(blocks, sums, now).select("ids", "counts", "sizes", "edges", "votes").mapInArrow(settle, out)


def composition(found: DataFrame, docs: DataFrame, by: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Documents and code points of the corpus by subject and the columns ``by``; documents of several subjects count once
    for each, those of none under a null subject."""
    met = docs.select(doc_id, "n_chars", *by).join(found.select(doc_id, "subject"), doc_id, "left")
    return met.groupBy("subject", *by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))
