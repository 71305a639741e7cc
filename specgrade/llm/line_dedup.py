"""Line dedup over levelled sorted runs of line hashes.

Lines arrive in batches.  A batch is reduced to (line hash, documents that
hold it) and sorted by hash; it is merge-anti-joined with the runs, whose
settled hashes (already in enough documents) need no more counting, and what
is left becomes a run of level 0.  ``fanout`` runs of one level are compacted
into one run of the next, so hashes are rewritten once per level only.

After the last batch every line whose hash reached ``min_docs`` documents
goes from every document.  Matching lines to hashes joins on the hash; the
hashes that a large share of all lines carry (fewer than ``hot`` per batch by
their counts, hence a bounded broadcast) are matched map side, the rest by a
shuffle in which none of them is hot.  Texts move once, by row.

Defined results: a line's key is the line with ASCII blanks stripped at both
ends and A-Z lower-cased; shorter keys than ``min_chars`` (blank lines) always
stay.  Null text is one empty line, as is empty text.  A document counts once
for a key however often it holds it; repeated rows count as documents of
their own.  Rows with a null doc_id are treated like any other.  An empty
table gives no rows.  Other columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import BLANKS, ascii_lower, cut, row_key, whole_text


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(text: Column, min_chars: int) -> Column:
    """128-bit hash of every line's key in order; null for lines that stay."""
    def one(line):
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))
    return F.transform(F.split(text, "\n", -1), one)


@dataclass
class SortedRuns:
    """Runs of (hash, n_docs), each sorted by hash within hash partitions."""

    min_docs: int
    fanout: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)

    def _sorted(self, df: DataFrame) -> DataFrame:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut(df.repartition(n, "hash").sortWithinPartitions("hash"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (hash, n_docs), each hash once."""
        fresh = batch
        for level in self.levels:
            for run in level:
                fresh = fresh.join(run.filter(F.col("n_docs") >= self.min_docs).hint("merge"), "hash", "left_anti")
        self._place(0, self._sorted(fresh))

    def _place(self, at: int, run: DataFrame) -> None:
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at].append(run)
        if len(self.levels[at]) == self.fanout:
            merged = self._sorted(self._sum(self.levels[at]))
            self.levels[at] = []
            self._place(at + 1, merged)

    @staticmethod
    def _sum(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"))

    def frequent(self) -> DataFrame:
        """Hashes held by at least ``min_docs`` documents."""
        return self._sum([r for level in self.levels for r in level]).filter(F.col("n_docs") >= self.min_docs).select("hash")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4,
               fanout: int = 4, hot: int = 1024) -> DataFrame:
    """``docs`` with ``text`` less its frequent lines, and the columns
    ``__n_lines`` (before) and ``__n_dropped``."""
    keyed = docs.withColumns({"__rk": row_key(), "__id": F.col("doc_id")})
    lines = cut(keyed.select("__id", "__rk", line_hashes(whole_text(), min_chars).alias("hashes"))
                .withColumn("batch", F.pmod("__rk", F.lit(batches))))
    each = lines.select("batch", F.explode(F.array_distinct("hashes")).alias("hash")).filter("hash IS NOT NULL")
    counted = cut(each.groupBy("batch", "hash").agg(F.count(F.lit(1)).alias("n_docs")))
    totals = counted.groupBy("batch").agg(F.sum("n_docs").alias("pairs"))
    # over pairs/hot documents of a batch: fewer than ``hot`` hashes each
    often = cut(counted.join(F.broadcast(totals), "batch").filter(F.col("n_docs") * hot > F.col("pairs")).select("hash").distinct())
    runs = SortedRuns(min_docs, fanout)
    for b in range(batches):
        runs.add(counted.filter(F.col("batch") == b).select("hash", "n_docs"))
    frequent = cut(runs.frequent())
    placed = lines.select("__id", "__rk", F.posexplode("hashes").alias("pos", "hash")).filter("hash IS NOT NULL")
    hot_frequent = F.broadcast(often.join(frequent, "hash", "left_semi"))
    hits = (placed.join(hot_frequent, "hash", "left_semi")
            .unionByName(placed.join(F.broadcast(often), "hash", "left_anti").join(frequent, "hash", "left_semi")))
    drops = hits.groupBy("__id", "__rk").agg(F.collect_set("pos").alias("__drop")).withColumnsRenamed({"__id": "__did", "__rk": "__drk"})
    joined = keyed.join(drops.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__rk") == F.col("__drk")), "left")
    whole = joined.withColumn("text", whole_text()).withColumn("__lines", F.split("text", "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), __drop), i -> __lines[i]), '\n')")
    return (whole.withColumns({"__n_lines": F.size("__lines").cast("long"), "__n_dropped": F.coalesce(F.array_size("__drop"), F.lit(0)).cast("long"),
                                    "text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)})
            .select(*docs.columns, "__n_lines", "__n_dropped"))
