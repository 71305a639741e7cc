"""Phrase collocations by mergeable Misra-Gries summaries.

Phrases are runs of ``1 .. longest`` words inside a piece of text, counted per
language.  A phrase is a 64-bit key here; the high bits of the key are its
hash partition.  First pass, one level of lengths after the other: every task
adds up its keys and sends one summary per hash partition; each partition
merges its summaries into a Misra-Gries summary whose capacity exceeds
``slack`` times the partition's mass (all occurrences that fall into it)
divided by ``min_count``: no count is too low by ``min_count / slack``, so every
phrase with ``min_count`` occurrences survives, and few others do.  A longer
phrase is sent only if all its parts survived.  Second pass: the phrases whose keys survived are
counted exactly, by their words; two phrases with one key only cost work.  A
task adds up its counts before it sends them, in the order of the phrases, so
that equal beginnings stand side by side in what is shuffled.  A phrase costs a
row in every task that meets it, so the tasks follow the cores, not the files'
splits: the rows grow with the distinct phrases that survive.

Survivors are kept as a bitmap over the high bits of the keys, ``2 **
filter_bits`` bits whatever the corpus: a partition makes the stretch of the
bitmap that belongs to it, and tasks read the whole.  A fuller bitmap lets
more phrases through to the exact count, it never loses one.  The number of
partitions follows the bytes of text, so a partition's summaries stay within
about ``mass`` keys on average, and a phrase that makes up a third of the corpus is one
entry of a task's summary.

Defined results: null text counts as empty, null lang as ``und``.  A-Z are
lower-cased; pieces end at ``.,;:!?`` and the line ends \\n \\v \\f \\r; words end at blanks
and tabs.  Repeated rows count each.  Empty tables and texts without a phrase
of ``min_count`` occurrences give no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrade.llm.common import cut, whole_text

# A-Z lower-cased; what ends a piece becomes a line feed
MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
END = b"."  # stands between pieces; no word holds it
CHUNK_BYTES = 1 << 20
# the keys a task holds before it sends a summary of those it met once
FLUSH_KEYS = 1 << 20
# the exact counts a task holds before it adds them up, or their bytes
FLUSH_ROWS, FLUSH_BYTES = 1 << 20, 64 << 20
# a pass over the text runs in this many tasks a core, more if one would have
# to read more text than this
TASKS_PER_CORE, TASK_BYTES = 2, 512 << 20
# a key is sent as the 32 bits that follow its partition's; of a partition's few
# million keys some in a thousand then share theirs, which can only make a phrase
# look more frequent.  Keys seen once by a task go without their counts
SUMMARY = "part int, mass long, single binary, keys binary, counts binary"


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(lang, distinct words, codes) of stretches of text of one language, of
    about CHUNK_BYTES or one document; code -1 stands between pieces."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").cast(pa.large_binary())
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts):
            by_lang.setdefault(lang, []).append(text.as_py())
        while by_lang:
            lang, held = by_lang.popitem()
            start = size = 0
            for i, text in enumerate(held):
                size += len(text) + 1
                if size >= CHUNK_BYTES or i == len(held) - 1:
                    yield lang, *_words(b"\n".join(held[start:i + 1]))
                    start, size = i + 1, 0


def _words(text: bytes) -> tuple[pa.Array, np.ndarray]:
    tokens = text.translate(MAP).replace(b"\n", b" " + END + b" ")
    array = pa.array([tokens], pa.large_binary()).cast(pa.large_string())
    coded = pc.ascii_split_whitespace(array).flatten().dictionary_encode()
    if not len(coded):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    # leading and trailing blanks make empty tokens; they are no words
    empty, end = pc.index(words, "").as_py(), pc.index(words, END.decode()).as_py()
    if empty >= 0:
        codes = codes[codes != empty]
    if end >= 0:
        codes[codes == end] = -1
    return words, codes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Filters:
    """Which keys survived: one bitmap per level of lengths, sent compressed."""

    def __init__(self, bits: int, maps: list[bytes]):
        self.shift = np.uint64(64 - bits)
        self.maps = [np.frombuffer(zlib.decompress(m), np.uint8) for m in maps]

    def passes(self, level: int, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.maps[level][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def phrase_keys(lang: str, words: pa.Array, codes: np.ndarray, filters: Filters, longest: int,
                level: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, keys) of the phrases of a level: words, pairs, longer
    ones.  Those longer than a word are held back unless their parts passed."""
    seed = xxhash.xxh64_intdigest(lang)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    one = of_word[codes] if len(words) else np.zeros(0, np.uint64)
    at = np.flatnonzero(codes >= 0)
    if level == 0:
        return [(1, at, one[at])]
    ok = np.zeros(len(codes) + 1, bool)
    ok[at] = filters.passes(0, one[at])
    out, before = [], one
    for length in range(2, longest + 1 if level > 1 else 3):
        # starts whose first and last length - 1 words passed
        at = np.flatnonzero(ok[:-1] & ok[1:])
        keys = _mixed(before[at] * np.uint64(0x9E3779B97F4A7C15) + one[at + length - 1] + np.uint64(length))
        if (length > 2) == (level > 1):
            out.append((length, at, keys))
        before = np.zeros(len(codes), np.uint64)
        before[at] = keys
        if length == 2 and level > 1:
            at = at[filters.passes(1, keys)]
        ok = np.zeros(len(codes) + 1, bool)
        ok[at] = True
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def misra_gries(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of added-up keys at most ``capacity``: the count after the last place
    is taken from all of them."""
    if len(keys) <= capacity:
        return keys, counts
    less = np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
    left = counts > less
    return keys[left], counts[left] - less


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte plane by byte plane: equal high bytes side by side."""
    return keys.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(held: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(held.as_buffer(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _summaries(part_bits: int, bits: int, longest: int, level: int, maps):
    """The summaries of a task, one row per hash partition and flush."""
    def send(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
        part = (k >> np.uint64(64 - part_bits)).astype(np.int32) if part_bits else np.zeros(len(k), np.int32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(k) else []
        ends = [*first[1:], len(k)]
        k = ((k << np.uint64(part_bits)) >> np.uint64(32)).astype(np.uint32)
        rows = []
        for a, b in zip(first, ends):
            once = n[a:b] == 1
            rows.append({"part": int(part[a]), "mass": int(n[a:b].sum()), "single": _planes(k[a:b][once]),
                         "keys": _planes(k[a:b][~once]), "counts": n[a:b][~once].tobytes()})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("single", pa.binary()),
                                                           ("keys", pa.binary()), ("counts", pa.binary())]))

    def run(batches):
        filters = Filters(bits, maps.value)
        keys, counts, held = [], [], 0
        for lang, words, codes in chunks(batches):
            found = np.concatenate([np.zeros(0, np.uint64)] + [k for _, _, k in phrase_keys(lang, words, codes, filters, longest, level)])
            k, n = _summed(found, np.ones(len(found), np.int64))
            keys, counts, held = keys + [k], counts + [n], held + len(k)
            if held >= FLUSH_KEYS:
                k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                if len(k) >= FLUSH_KEYS // 2:
                    # the frequent ones stay, so that they are sent with their sums
                    go = (n == 1) | (np.count_nonzero(n > 1) >= FLUSH_KEYS // 2)
                    yield send([k[go]], [n[go]])
                    k, n = k[~go], n[~go]
                keys, counts, held = [k], [n], len(k)
        if held:
            yield send(keys, counts)
    return run


def _survivors(part_bits: int, bits: int, min_count: int, slack: int):
    """The stretch of the bitmap that belongs to a hash partition."""
    def run(table: pa.Table) -> pa.Table:
        mass = pc.sum(table.column("mass")).as_py()
        capacity = slack * mass // min_count + 1
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        wait_k, wait_n, waiting = [], [], 0
        for once, k, n in zip(table.column("single"), table.column("keys"), table.column("counts")):
            once = _from_planes(once)
            wait_k += [once, _from_planes(k)]
            wait_n += [np.ones(len(once), np.int64), np.frombuffer(n.as_buffer(), np.int64)]
            waiting += len(wait_k[-1]) + len(once)
            if waiting > capacity:
                keys, counts = misra_gries(*_summed(np.concatenate([keys, *wait_k]), np.concatenate([counts, *wait_n])), capacity)
                wait_k, wait_n, waiting = [], [], 0
        keys, counts = misra_gries(*_summed(np.concatenate([keys, *wait_k]), np.concatenate([counts, *wait_n])), capacity)
        lost = (mass - int(counts.sum())) // (capacity + 1)  # no count is too low by more
        keys = keys[counts + lost >= min_count]
        stretch = np.zeros(1 << (bits - part_bits), np.uint8)
        stretch[keys >> np.uint32(32 - bits + part_bits)] = 1
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part], pa.int32()), "stretch": pa.array([zlib.compress(np.packbits(stretch, bitorder="little"), 1)], pa.binary())})
    return run


def surviving(texts: DataFrame, part_bits: int, bits: int, longest: int, level: int, min_count: int, slack: int, maps: list[bytes]) -> bytes:
    """The bitmap of the keys of a level that survive, compressed."""
    sent = texts.sparkSession.sparkContext.broadcast(maps)
    summaries = texts.mapInArrow(_summaries(part_bits, bits, longest, level, sent), SUMMARY)
    stretches = summaries.groupBy("part").applyInArrow(_survivors(part_bits, bits, min_count, slack), "part int, stretch binary")
    size = 1 << (bits - part_bits - 3)
    whole = bytearray(1 << (bits - 3))
    for row in stretches.toLocalIterator():
        whole[row.part * size:(row.part + 1) * size] = zlib.decompress(row.stretch)
    return zlib.compress(whole, 1)


def _exact(bits: int, longest: int, maps):
    """Exact counts of a task's surviving phrases; the phrase '' of no words
    holds the number of words."""
    def unique(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        order = np.lexsort(columns)
        columns = [c[order] for c in columns]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return [c[first] for c in columns], np.diff(np.r_[first, len(order)])

    def counted(batches):
        filters = Filters(bits, maps.value)
        for lang, words, codes in chunks(batches):
            yield _rows(lang, pa.array([""]), [int((codes >= 0).sum())])
            for level in range(len(filters.maps)):
                for length, at, keys in phrase_keys(lang, words, codes, filters, longest, level):
                    at = at[filters.passes(level, keys)]
                    columns, n = unique([codes[at + k] for k in range(length)])
                    parts = [words.take(pa.array(c)) for c in columns]
                    yield _rows(lang, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()), n)

    return lambda batches: added_up(counted(batches), FLUSH_ROWS, FLUSH_BYTES)


def added_up(counts: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """(key, f) with the counts of a key added up, ordered by key; of what is
    held beyond ``rows`` rows or ``size`` bytes, the most frequent quarter stays
    and the rest goes out if adding up leaves more than three quarters of it."""
    def total(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).group_by("key", use_threads=False).aggregate([("f", "sum")])
        return table.select(["key", "f_sum"]).rename_columns(["key", "f"])

    def frequent(table: pa.Table) -> np.ndarray:
        order = np.argsort(-table["f"].to_numpy(), kind="stable")[:rows // 4]
        nbytes = pc.binary_length(table["key"]).to_numpy().astype(np.int64) + 12
        stay = np.zeros(len(table), bool)
        stay[order[np.cumsum(nbytes[order]) <= size // 4]] = True
        return stay

    held, n, nbytes = [], 0, 0
    for batch in counts:
        held, n, nbytes = held + [batch], n + len(batch), nbytes + batch.nbytes
        if n >= rows or nbytes >= size:
            table, held = total(held), []
            if len(table) >= rows * 3 // 4 or table.nbytes >= size * 3 // 4:
                stay = frequent(table)
                yield from table.filter(pa.array(~stay)).sort_by("key").to_batches()
                table = table.filter(pa.array(stay))
            held, n, nbytes = table.to_batches(), len(table), table.nbytes
    if held:
        table, held = total(held), []
        yield from table.sort_by("key").to_batches()


def _rows(lang: str, phrases: pa.Array, n) -> pa.RecordBatch:
    """(key, f); the key is lang, preceded by its length, and phrase."""
    keys = pc.binary_join_element_wise(pa.scalar(f"{len(lang)}:{lang}"), phrases, pa.scalar(""))
    return pa.RecordBatch.from_arrays([keys, pa.array(np.asarray(n, np.int64))], ["key", "f"])


def phrase_counts(docs: DataFrame, min_count: int = 30, longest: int = 4, mass: int = 1 << 22, slack: int = 8,
                  filter_bits: int = 27) -> DataFrame:
    """(lang, phrase, f, words) of every phrase with ``min_count``
    occurrences, and for every lang its number of words under phrase ''."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    texts = texts.coalesce(tasks)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # words have about six bytes and start up to longest - 1 phrases of a level
    parts = max(shuffles, size // 6 * max(1, longest - 2) // mass, 1)
    part_bits = min((parts - 1).bit_length(), filter_bits - 3)
    maps: list[bytes] = []
    for level in range(min(longest, 3)):
        maps = maps + [surviving(texts, part_bits, filter_bits, longest, level, min_count, slack, maps)]
    sent = docs.sparkSession.sparkContext.broadcast(maps)
    exact = texts.mapInArrow(_exact(filter_bits, longest, sent), "key string, f long")
    colon = F.instr("key", ":")
    chars = F.substring("key", F.lit(1), colon - 1).cast("int")
    phrase = F.col("phrase")
    summed = (exact.groupBy("key").agg(F.sum("f").alias("f"))
              .select(F.substring("key", colon + 1, chars).alias("lang"), F.substring("key", colon + 1 + chars, F.length("key")).alias("phrase"), "f")
              .withColumn("words", F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ", -1)))))
    return cut(summed.filter((F.col("f") >= min_count) | (F.col("words") == 0)))


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def _big(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 30, longest: int = 4, num: int = 80, den: int = 100,
                 mass: int = 1 << 22, slack: int = 8, filter_bits: int = 27) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each lang: lang,
    rank, phrase, a, l, r, n, score.  a counts the phrase, l and r the two
    parts of its weakest cut, n the words of the lang; the score is
    floor(2000000 a / (l + r))."""
    counts = phrase_counts(docs, min_count, longest, mass, slack, filter_bits)
    found = counts.filter("words >= 2").withColumn("w", F.split("phrase", " ", -1))
    # what lies inside a longer phrase that is nearly as frequent goes
    inside = (found.filter("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
              .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
              .select("lang", _part(F.col("i"), F.col("m")).alias("phrase"), "f"))
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.coalesce(_big("longer") * den >= _big("f") * num, F.lit(False))
    kept = found.join(around, ["lang", "phrase"], "left").filter(~covered)
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.size("w")).alias("right"))
    parts = counts.filter("words >= 1")
    both = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            .withColumns({"a20": _big("a"), "lr": _big("l") + _big("r")})
            .withColumn("score", F.expr("a20 * CAST(2000000 AS DECIMAL(7,0)) div lr")))
    weakest = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = weakest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    words = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
