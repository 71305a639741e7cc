"""Cross-tokenizer alignment over exact-text deduplication.

Texts are shuffled by their whole text, so that each distinct text is
tokenized and aligned once, by a byte-level BPE (A, on a space and the text)
and a sentencepiece model (B, which adds the space).  Byte offsets where
tokens of both end cut them into groups; the two tokens that end there are
linked.  Tasks add up the counts of linked id pairs, weighted by the rows that
hold the text.

Of two linked tokens one's bytes end with the other's, so the pairs that can
occur follow from the two vocabularies (:class:`Vocabularies`; under 400,000 for the default ones,
less than the bytes of all tokens in any case): that bounds the state
of a task and the table of counts, which a second pass over the stored links
reads whole.  Its measures are joined to the rows: texts held by over
1/``heavy`` of all rows (fewer than ``heavy``) map side, others by a shuffle
on the digest of the text.

Defined results: null and empty texts, and texts whose joined token bytes of
either side differ from space and text, have no tokens: zeros and ''.  Repeated
rows each get their row and count each.  An empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import slices, whole_text, written
from specgrade.llm.encoding import VOCABULARY, byte_bpe, vocabulary_bytes

PIECES = "piece_bpe_32k"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Vocabularies:
    """The bytes of both vocabularies' tokens and the pairs that can be
    linked, as sorted keys ``a * len(b) + b``."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece
        ranks = vocabulary_bytes(vocabulary)
        self.a = [b""] * len(ranks)
        for token, i in ranks.items():
            self.a[i] = token
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{pieces}.model"))
        self.b = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                  else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())]
        self.a_bytes, self.a_ends = self._joined(self.a)
        self.b_bytes, self.b_ends = self._joined(self.b)

    @staticmethod
    def _joined(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each token's bytes, and its length."""
        if not all(tokens):
            raise ValueError("a token without bytes")
        return np.array(tokens, dtype=object), np.array([len(t) for t in tokens], dtype=np.int64)

    def pairs(self) -> np.ndarray:
        by_a, by_b = {}, {}
        for of, tokens in ((by_a, self.a), (by_b, self.b)):
            for i, t in enumerate(tokens):
                of.setdefault(t, []).append(i)
        found = {(i, j) for t, held in by_a.items() for k in range(len(t)) for j in by_b.get(t[k:], ()) for i in held}
        found |= {(i, j) for t, held in by_b.items() for k in range(len(t)) for i in by_a.get(t[k:], ()) for j in held}
        return np.sort(np.array([i * len(self.b) + j for i, j in found], dtype=np.int64))

    def strings(self) -> np.ndarray:
        """``i`` with the sign after it, by side: A in a group (``,``), A at
        its end (``|``), B in a group, B at its end (``;``)."""
        return np.array([f"{i}{sign}" for n, signs in ((len(self.a), ",|"), (len(self.b), ",;")) for sign in signs for i in range(n)], dtype=object)


class Aligner:
    """Aligns texts; made once a task."""

    def __init__(self, vocabulary: str, pieces: str, pair_keys: np.ndarray):
        self.v = Vocabularies(vocabulary, pieces)
        self.encode = byte_bpe(vocabulary, special=False)
        self.pair_keys = pair_keys
        self.string = self.v.strings()
        # slots of the strings: A, A at an end, B, B at an end
        self.slot_b = 2 * len(self.v.a)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, empty where the bytes are not those of the text."""
        a, b = np.array(self.encode(" " + text), dtype=np.int64), np.array(self.v.model.encode(text), dtype=np.int64)
        want = (" " + text).encode()
        if b"".join(self.v.a_bytes[a].tolist()) != want or b"".join(self.v.b_bytes[b].tolist()) != want:
            return a[:0], b[:0]
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, str]:
        """(numbers of the linked pairs in order, digest of the groups)."""
        if not len(a):
            return np.zeros(0, np.int32), ""
        ends_a, ends_b = np.cumsum(self.v.a_ends[a]), np.cumsum(self.v.b_ends[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = np.searchsorted(self.pair_keys, a[last_a] * len(self.v.b) + b[last_b])
        # a group's A tokens stand after the B tokens of earlier groups, its B
        # tokens after the A tokens of its own
        slots_a, slots_b = a.copy(), b + self.slot_b
        slots_a[last_a] += len(self.v.a)
        slots_b[last_b] += len(self.v.b)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        merged = np.empty(len(a) + len(b), dtype=np.int64)
        merged[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = slots_a
        merged[np.arange(len(b)) + (last_a + 1)[group_b]] = slots_b
        whole = "".join(self.string[merged].tolist())[:-1]
        return links.astype(np.int32), hashlib.sha256(whole.encode()).hexdigest()


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text, times) of the texts that are not empty, shuffled by text."""
    return docs.select(whole_text().alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))


def aligned(texts: DataFrame, vocabulary: str, pieces: str, pair_keys: np.ndarray) -> DataFrame:
    """(digest, times, n_a, n_b, groups_sha256, links) a distinct text; the
    links are numbers of pairs."""
    sent = texts.sparkSession.sparkContext.broadcast(pair_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = Aligner(vocabulary, pieces, sent.value)
        for batch in (part for whole in batches for part in slices(whole)):
            n_a, n_b, shas, links = [], [], [], []
            for text in batch.column("text").to_pylist():
                a, b = it.ids(text)
                linked, sha = it.align(a, b)
                n_a.append(len(a))
                n_b.append(len(b))
                shas.append(sha)
                links.append(linked.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("times"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(shas, pa.string()), pa.array(links, pa.binary())],
                ["digest", "times", "n_a", "n_b", "groups_sha256", "links"])
    rows = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "times", "text")
    return rows.mapInArrow(run, "digest binary, times long, n_a long, n_b long, groups_sha256 string, links binary")


def pair_counts(links: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): how many links of all rows hold a pair, by its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for found, times in zip(batch.column("links"), batch.column("times").to_pylist()):
                pair, held = np.unique(np.frombuffer(found.as_buffer(), np.int32), return_counts=True)
                n[pair] += held * times
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], ["pair", "n"])
    return links.select("links", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def measured(links: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """The measures of each distinct text; ``counts`` by pair and whether a
    pair is a best one of its B id."""
    sent = links.sparkSession.sparkContext.broadcast((counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = sent.value
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("links")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("times"), batch.column("n_a"), batch.column("n_b"), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([int(top[x].sum()) for x in found], pa.int64()), pa.array([int(n[x].sum()) for x in found], pa.int64()), batch.column("groups_sha256")],
                ["digest", "times", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256"])
    return (links.mapInArrow(run, "digest binary, times long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string")
            .withColumn("n_links", F.col("n_groups")))  # no token is without bytes: one link a group


def alignment(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, heavy: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256."""
    vocabularies = Vocabularies(vocabulary, pieces)
    keys = vocabularies.pairs()
    links = written(aligned(distinct_texts(docs), vocabulary, pieces, keys), "alignment")
    counts = np.zeros(len(keys), np.int64)
    found = pair_counts(links, len(keys)).toPandas()  # at most len(keys) rows
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    most = np.zeros(len(vocabularies.b), np.int64)
    np.maximum.at(most, keys % len(most), counts)
    measures = written(measured(links, counts, counts == most[keys % len(most)]), "alignment-measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length(whole_text()) > 0, F.unhex(F.sha2("text", 256))).alias("digest"))
    total = rows.count()
    often = F.broadcast(measures.filter(F.col("times") * heavy > total))  # fewer than ``heavy`` rows
    rest = rows.filter("digest IS NOT NULL").join(often.select("digest"), "digest", "left_anti").join(measures, "digest")
    columns = ["doc_id", *MEASURES, "groups_sha256"]
    none = rows.filter("digest IS NULL").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in MEASURES), F.lit("").alias("groups_sha256"))
    return rows.join(often, "digest").select(*columns).unionByName(rest.select(*columns)).unionByName(none)
