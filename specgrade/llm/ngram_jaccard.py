"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles; documents with equal sets
are one class, and only classes are compared.  Shingles are ordered by
estimated frequency (a count sketch of fixed size over all documents), rare
ones first.  Two sets that reach the similarity share at least l shingles
within the first n - ceil(t n) + l of each, for every l.  Every class picks
its own l: a longer prefix costs postings, but asks for more shared shingles
and so leaves fewer candidates; the estimated cost of both decides.  A pair of
classes is a candidate if it shares min(l, l') prefix shingles and passes the
length and the positional filter, and the parity filter: a class carries 512
bits, each the parity of its shingles that fall there, and two sets differ in at
least as many shingles as bits.  Its whole sets are then compared exactly.

Only connected components are asked for, so a group of similar classes is not
expanded into pairs.  First each posting list is compared with its smallest
class only, a star; then the lists that still join different components are
compared across components, never inside one.  No link between components is
lost: every pair inside one is linked already.

Defined results: null text counts as empty.  A text with fewer words than a
shingle is one shingle of all its words; a text without words has an empty
set, links with nothing and is its own component.  Repeated rows share a
class.  A null doc_id is no component id unless all of its component are null.
An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgrade.llm.common import cut, cut_observed, no_bloom_filters, row_key, whole_text
from specgrade.llm.graph import components

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct k-word shingles."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    full = ~_BLANK[data]
    start = np.flatnonzero(full & np.concatenate(([True], ~full[:-1])))
    # where each text begins, in bytes, hence in words
    sizes = np.array([len(t.encode("utf-8", "replace")) + 1 for t in texts])
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    if len(start):
        owner = np.zeros(len(data), dtype=np.int64)
        owner[start[0]:] = np.repeat(start, np.diff(np.append(start, len(data))))
        place = np.where(full, np.arange(len(data)) - owner, 0)
        power = np.ones(int(place.max()) + 1, dtype=np.uint64)
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
        word = _mixed(np.add.reduceat(np.where(full, _BYTE[data] * power[place], np.uint64(0)), start))
    for a, b in zip(first, first[1:]):
        n = b - a
        if n == 0:
            yield np.zeros(0, dtype=np.uint64)
        elif n < k:
            yield _mixed(np.array([(word[a:b] * _PLACE[:n]).sum() + np.uint64(n)], dtype=np.uint64))
        else:
            h = word[a:b - k + 1] * _PLACE[0]
            for j in range(1, k):
                h = h + word[a + j:b - k + 1 + j] * _PLACE[j]
            yield np.unique(_mixed(h + np.uint64(k)))


SKETCH = 8  # longs


def parities(h: np.ndarray) -> np.ndarray:
    """64 SKETCH bits, each the parity of the shingles that fall there."""
    odd = np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def text_blocks(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters: bounded arrays over bytes."""
    run, chars = [], 0
    for t in texts:
        if run and chars + len(t) > most:
            yield run
            run, chars = [], 0
        run.append(t)
        chars += len(t)
    if run:
        yield run


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least num/den over k-word shingles."""

    k: int
    num: int
    den: int

    def prefix(self, n: int) -> int:
        """Prefix length for one shared shingle."""
        return n - -(-self.num * n // self.den) + 1


def sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Count of documents per hash bucket of their shingles: 2^bits numbers,
    whatever the corpus."""
    def count(batches):
        held = np.zeros(1 << bits, dtype=np.int64)
        for pdf in batches:
            for run in text_blocks(list(pdf["text"])):
                h = np.concatenate(list(shingle_sets(run, k)))
                held += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": held[at]})
    got = docs.select(whole_text().alias("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def choose_prefix(est: np.ndarray, base: int, most_l: int, verify_cost: float) -> int:
    """The l of least estimated cost for a document whose shingles, in order,
    have the estimated frequencies ``est``; ``base`` is the prefix for l = 1.
    A candidate is in l of the prefix's lists, so there are at most
    sum / l candidates, and at most what the lists hold but for the l - 1
    longest."""
    others = est[:base + most_l - 1] - 1
    best, best_cost = 1, np.inf
    for l in range(1, min(most_l, len(est) - base + 1) + 1):
        lists = np.sort(others[:base + l - 1])
        total = lists.sum()
        found = min(total / l, total - lists[len(lists) - l + 1:].sum())
        cost = base + l - 1 + total + verify_cost * found
        if cost < best_cost:
            best, best_cost = l, cost
    return best


def signatures(docs: DataFrame, sim: Similarity, counts: np.ndarray, bits: int, most_l: int, verify_cost: float) -> DataFrame:
    """(doc_id, rk, s1, s2, n, l, common, prefix, odd): s1, s2 and n name the
    set; common is how frequent its shingles are on the mean, as 100 log2; odd
    are its parities."""
    noise = counts.mean() + 4 * np.sqrt(counts.mean() + 1)
    held = docs.sparkSession.sparkContext.broadcast(np.maximum(1, counts - int(noise)).astype(np.int64))

    def sign(batches):
        for pdf in batches:
            out = []
            texts, ids, keys, at = list(pdf["text"]), list(pdf["doc_id"]), list(pdf["rk"]), 0
            for run in text_blocks(texts):
                for h in shingle_sets(run, sim.k):
                    n, l, common, prefix = len(h), 0, 0, np.zeros(0, dtype=np.int64)
                    if n:
                        est = held.value[(h >> np.uint64(64 - bits)).astype(np.int64)]
                        order, common = np.argsort(est, kind="stable"), int(100 * np.log2(est).mean())
                        l = choose_prefix(est[order], sim.prefix(n), most_l, verify_cost)
                        prefix = h[order[:sim.prefix(n) + l - 1]].view(np.int64)
                    out.append((ids[at], keys[at], int(h.sum(dtype=np.uint64).view(np.int64)), int(_mixed(h ^ _BASE).sum(dtype=np.uint64).view(np.int64)), n, l, common, prefix, parities(h)))
                    at += 1
            yield pd.DataFrame(out, columns=["doc_id", "rk", "s1", "s2", "n", "l", "common", "prefix", "odd"]).astype({"doc_id": "Int64"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), whole_text().alias("text"))
    return rows.mapInPandas(sign, "doc_id long, rk long, s1 long, s2 long, n int, l int, common int, prefix array<long>, odd array<long>")


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, sim: Similarity, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity.  The
    set of b travels once for each pair, that of a once, both to a's place;
    many pairs of one a are an ordinary skewed join, which Spark splits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), whole_text().alias("text"))
    rep = classes.select("node", "rep_doc", "rep_rk")
    pairs = cut(pairs)  # read for both sides

    def sets(batches):
        for pdf in batches:
            made = [h.view(np.int64) for run in text_blocks(list(pdf["text"])) for h in shingle_sets(run, sim.k)]
            pdf["shingles"] = pd.Series(made, index=pdf.index, dtype=object)
            yield pdf.drop(columns=["text"])

    def with_sets(wanted: DataFrame, names: list[str]) -> DataFrame:
        listed, told = cut_observed(wanted, n=F.count(F.lit(1)))
        listed = F.broadcast(listed) if told["n"] <= broadcast_rows else listed
        texts = rows.join(listed, (F.col("rk") == F.col("rep_rk")) & F.col("doc_id").eqNullSafe(F.col("rep_doc"))).select(*names, "text")
        return texts.mapInPandas(sets, ", ".join(f"{c} long" for c in names) + ", shingles array<long>")

    xs = with_sets(pairs.select("a").distinct().join(rep.withColumnRenamed("node", "a"), "a"), ["a"]).withColumnRenamed("shingles", "x")
    ys = with_sets(pairs.join(rep.withColumnRenamed("node", "b"), "b"), ["a", "b"]).withColumnRenamed("shingles", "y")
    shared = F.size(F.array_intersect("x", "y"))
    # repeated rows give their class's set again; distinct() removes what that repeats
    return ys.join(xs, "a").filter(sim.den * shared >= sim.num * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def packed(n: str, l: str, pos: str):
    """Size, l and position of a posting in one long: 29, 4 and 30 bits."""
    return F.shiftleft(F.col(n).cast("long"), 34).bitwiseOR(F.shiftleft(F.col(l).cast("long"), 30)).bitwiseOR(F.col(pos).cast("long"))


def unpacked(meta: str, to: str) -> dict:
    return {f"{to}n": F.shiftright(meta, 34).cast("int"), f"{to}l": F.shiftright(meta, 30).bitwiseAND(F.lit(15)).cast("int"),
            f"{to}pos": F.col(meta).bitwiseAND(F.lit((1 << 30) - 1)).cast("int")}


def candidates(meets: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) from rows (a, b, x_n, x_l, x_pos, y_n, y_l, y_pos), one
    for each prefix shingle that a and b share.  Such a row must leave room
    for the overlap asked for (length and positional filter); the pair needs
    min(l, l') of them.  Beyond the last shared one, the set whose prefix ends
    first can only go on sharing what lies past its prefix."""
    n, m = F.col("x_n"), F.col("y_n")
    least = F.ceil(sim.num * (n + m) / (sim.num + sim.den))
    x_after, y_after = (F.col(f"{s}_n") - F.col(f"{s}_pos") - 1 for s in "xy")
    met = (meets.filter((sim.den * F.least(n, m) >= sim.num * F.greatest(n, m)) & (room() >= least)).groupBy("a", "b")
           .agg(F.count(F.lit(1)).alias("c"), F.min(x_after).alias("x_after"), F.min(y_after).alias("y_after"),
                *[F.first(c).alias(c) for c in ("x_n", "x_l", "y_n", "y_l")]))
    x_past, y_past = (past(sim, F.col(f"{s}_n"), F.col(f"{s}_l")) for s in "xy")
    most = F.col("c") + F.greatest(F.least(x_past, F.col("y_after")), F.least(F.col("x_after"), y_past))
    return met.filter((F.col("c") >= F.least("x_l", "y_l")) & (most >= least)).select("a", "b")


def room():
    """The largest overlap of two sets that share the shingle at x_pos and
    y_pos.  What follows counts whole: a shingle of one prefix may lie past the
    other's, so that no other class holds it in a prefix and it is shared all
    the same."""
    return F.least("x_pos", "y_pos") + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))


def differ(xs: list, ys: list):
    """How many of the bits differ."""
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(xs, ys)])


def within(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) whose parities leave room for the similarity."""
    n, m = F.col("x_n"), F.col("y_n")
    least = F.ceil(sim.num * (n + m) / (sim.num + sim.den))
    bits = [[F.get(f"{s}_odd", i) for i in range(SKETCH)] for s in "xy"]
    for name, s in (("a", "x"), ("b", "y")):
        pairs = pairs.join(classes.select(F.col("node").alias(name), F.col("n").alias(f"{s}_n"), F.col("odd").alias(f"{s}_odd")), name)
    return pairs.filter(differ(*bits) <= n + m - 2 * least).select("a", "b")


def past(sim: Similarity, n, l):
    """How many shingles of a set lie past its prefix."""
    return F.ceil(sim.num * n / sim.den) - l


def shared_postings(classes: DataFrame) -> DataFrame:
    """(token, node, meta, p_node, p_meta): the prefix shingles that several
    classes hold.  A class that holds none of them is similar to no other; any
    other stays, as one shared shingle is enough beside a partner of l = 1.
    p_ is the holder nearest to a group's common text: its shingles are the
    most frequent on the mean."""
    postings = classes.select("node", "n", "l", "common", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "common", packed("n", "l", "pos").alias("meta"))
    whole = Window.partitionBy("token").orderBy(F.desc("common"), "meta", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = {f"p_{c}": F.first(c).over(whole) for c in ("node", "meta")}
    return postings.withColumns({"holders": F.count(F.lit(1)).over(whole), **head}).filter("holders > 1").drop("holders", "common")


def across(shared: DataFrame, classes: DataFrame, labels: DataFrame, sim: Similarity, long: int = 64) -> DataFrame:
    """Candidate pairs (a, b) of classes in different components.

    Only lists that join several components matter, and they hold all that
    such a pair shares.  A similar pair shares at least ``need`` of them, so
    one, the rarest that it shares, is followed by ``need - 1`` more in either
    class's own list, rarest first: this prefix filter keeps long lists out of
    the join.  Every posting also carries its class's parities, folded to half
    as many bits.  A
    pair that meets in several long lists (``long`` holders or more) is taken
    from the first alone: a posting there carries its class's earlier tokens of
    long lists.  What a pair shares is then counted on the classes' lists."""
    labelled = shared.select("token", "node", "meta").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    token = Window.partitionBy("token")
    open_lists = (labelled.withColumns({"lo": F.min("label").over(token), "hi": F.max("label").over(token), "holders": F.count(F.lit(1)).over(token)})
                  .filter("lo <> hi").drop("lo", "hi"))
    own = Window.partitionBy("node")
    rarest_last = own.orderBy(F.desc("holders"), F.desc("token"))
    in_long = F.when(F.col("holders") >= long, F.col("token"))
    earlier = F.collect_list(in_long).over(own.orderBy("holders", "token").rowsBetween(Window.unboundedPreceding, -1))
    odd = [f"odd{i}" for i in range(SKETCH // 2)]
    folded = classes.select("node", *[F.get("odd", i).bitwiseXOR(F.get("odd", i + SKETCH // 2)).alias(c) for i, c in enumerate(odd)])
    left = cut(open_lists.join(folded, "node").withColumns({"earlier": F.when(F.col("holders") >= long, earlier),
                                       "more": F.row_number().over(rarest_last) - 1}).drop("holders"))  # rarer ones have more after them
    right = left.select("token", *[F.col(c).alias(f"q_{c}") for c in ("node", "meta", "label", "more", *odd, "earlier")])
    met = (left.join(right, "token").filter((F.col("node") < F.col("q_node")) & (F.col("label") != F.col("q_label")))
           .withColumns(unpacked("meta", "x_") | unpacked("q_meta", "y_")).withColumnsRenamed({"node": "a", "q_node": "b"}))
    n, m = F.col("x_n"), F.col("y_n")
    least = F.ceil(sim.num * (n + m) / (sim.num + sim.den))
    need = F.greatest(F.least("x_l", "y_l"), least - F.greatest(past(sim, n, F.col("x_l")), past(sim, m, F.col("y_l"))))
    fits = (sim.den * F.least(n, m) >= sim.num * F.greatest(n, m)) & (room() >= least) & (F.least("more", "q_more") >= need - 1)
    fits = fits & (differ([F.col(c) for c in odd], [F.col(f"q_{c}") for c in odd]) <= n + m - 2 * least) & ~F.coalesce(F.arrays_overlap("earlier", "q_earlier"), F.lit(False))
    pairs = met.filter(fits).select("a", "b", need.alias("need")).distinct()
    tokens = left.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    both = (pairs.join(tokens.withColumnsRenamed({"node": "a", "tokens": "x"}), "a").join(tokens.withColumnsRenamed({"node": "b", "tokens": "y"}), "b"))
    return both.filter(F.size(F.array_intersect("x", "y")) >= F.col("need")).select("a", "b")


def classes_with_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, bits: int = 18,
                            most_l: int = 8, verify_cost: float = 8.0, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, rk, s1, s2, n; classes has s1, s2, n,
    component_id and keep_rk, the key of the component's row that stays."""
    sim = Similarity(k, num, den)
    counts = sketch(docs, k, bits)
    rows = cut(signatures(docs, sim, counts, bits, most_l, verify_cost))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = cut(rows.filter("n > 0").groupBy("s1", "s2", "n")
                  .agg(F.min("doc_id").alias("rep_doc"), F.min_by("rk", order).alias("rep_rk"), F.first("l").alias("l"), F.first("common").alias("common"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"))
                  .withColumn("node", F.monotonically_increasing_id()))
    shared = cut(shared_postings(classes))
    meets = (shared.filter("node <> p_node").withColumns(unpacked("p_meta", "x_") | unpacked("meta", "y_"))
             .withColumnsRenamed({"p_node": "a", "node": "b"}))
    stars = cut(candidates(meets, sim))
    linked = cut(similar(within(stars, classes, sim), classes, docs, sim, broadcast_rows))
    first_labels = cut(components(linked))
    rest = cut(across(shared, classes, first_labels, sim).join(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"))
    more = similar(within(rest, classes, sim), classes, docs, sim, broadcast_rows)
    labels = components(cut(linked.unionByName(more)))
    named = cut(classes.select("node", "s1", "s2", "n", "rep_doc", "rep_rk").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    top = named.groupBy("label").agg(F.min("rep_doc").alias("component_id"), F.min_by("rep_rk", F.coalesce("rep_doc", F.lit((1 << 63) - 1))).alias("keep_rk"))
    return rows, named.join(top, "label").select("s1", "s2", "n", "component_id", "keep_rk")


def ngram_components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows, classes = classes_with_components(docs, **options)
    joined = rows.select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"], "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id,
    and all rows without words."""
    rows, classes = classes_with_components(docs, **options)
    goes = (rows.filter("n > 0").select("doc_id", "rk", "s1", "s2", "n").join(classes, ["s1", "s2", "n"])
            .filter((F.col("rk") != F.col("keep_rk")) | ~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__did"), F.col("rk").alias("__drk")).distinct())
    with no_bloom_filters(docs.sparkSession):
        goes = cut(goes)
    wordless = ~F.regexp_like(whole_text(), F.lit(r"[^\x20\x09-\x0D]"))
    once = Window.partitionBy("doc_id", "__rk").orderBy(F.lit(1))
    # a row that goes has words, so only those are looked up
    left = (docs.filter(~wordless).withColumn("__rk", row_key())
            .join(goes, F.col("doc_id").eqNullSafe(F.col("__did")) & (F.col("__rk") == F.col("__drk")), "left_anti"))
    return docs.filter(wordless).unionByName(left.withColumn("__nth", F.row_number().over(once)).filter("__nth = 1").select(*docs.columns))
