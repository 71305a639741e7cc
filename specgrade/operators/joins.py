"""Key joins, first-row dedupe, replication and positional pairing.

Dedupe aggregates (key, order, row hash) alone and fetches the rows it picked
by their hash: texts are in no aggregate, and since rows meet by row hash, not
by key, a key holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from specgrade.operators.corpus import assign_row_number
from specgrade.operators.quality import require_columns


def broadcast_limit(spark) -> int:
    """The session's broadcast ceiling in bytes (``spark.sql.autoBroadcastJoinThreshold``; -1 = never)."""
    raw = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB") or "").strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    num = raw.rstrip("bkmg")
    try:
        return int(float(num) * units.get(raw[len(num):] or "b", 1))
    except ValueError:
        return -1


MAX_IN_KEYS = 4096  # keys a bounded lookup turns into a pushed-down IN filter


def restrict_to_keys(table: DataFrame, key: str, keys: DataFrame, max_keys: int,
                     read_keys: bool = True) -> DataFrame:
    """Rows of ``table`` whose ``key`` occurs in ``keys`` (one column named
    ``key``), where ``max_keys`` is a proven bound on the number of keys.

    Up to ``MAX_IN_KEYS`` keys (and ``read_keys``) the keys are read, a list
    of at most ``max_keys`` values, and become an ``IN`` filter that the
    Parquet scan pushes down, so row groups without a wanted key are
    skipped.  Otherwise the keys go into a semi join, broadcast when
    ``max_keys`` fits the session's broadcast ceiling (16 bytes per key,
    checked before running), so ``table`` is scanned but never shuffled."""
    if read_keys and max_keys <= MAX_IN_KEYS:
        found = [r[0] for r in keys.select(key).limit(max_keys + 1).collect()]
        if len(found) > max_keys:
            raise ValueError(f"more than {max_keys} keys, the bound given for {key}")
        return table.filter(F.col(key).isin(found))
    if 0 <= 16 * max_keys <= broadcast_limit(table.sparkSession):
        keys = F.broadcast(keys)
    return table.join(keys.select(key), key, "left_semi")


def _suffixed_join(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str],
                   how: str = "inner") -> DataFrame:
    """pandas-style merge: columns present on both sides (other than the key)
    get ``suffixes``; an empty suffix keeps the plain name."""
    both = (set(left.columns) & set(right.columns)) - {on}
    lsel = [F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in right.columns]
    return left.select(*lsel).join(right.select(*rsel), on, how)


def _hashable(df: DataFrame) -> list:
    """The columns as values that can be hashed: a map as its sorted entries."""
    return [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields]


def dedupe_first(df: DataFrame, key: str | list[str], order: str | list[str] | None) -> DataFrame:
    """First row per key in ``order``, which must be stated (input order
    does not exist in a distributed table).  Rows that ``order`` leaves tied
    go by a hash of the whole row, so the row is the same on any partitioning.

    The aggregate holds (key, order, hash); the rows it picked are found again
    by their 128-bit hash in a semi join that shuffles each row once, spread
    by hash, and of rows equal in every column one stays."""
    keys = [key] if isinstance(key, str) else key
    order = [order] if isinstance(order, str) else order
    if not order:
        raise ValueError(f"which row of {keys} is the first? state the columns of its order")
    marked = df.withColumns({f"_sg_h{s}": F.xxhash64(F.lit(s), *_hashable(df)) for s in (1, 2)})
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "_sg_h1", "_sg_h2")).alias("_sg_first")
    picked = marked.groupBy(*keys).agg(first).select("_sg_first._sg_h1", "_sg_first._sg_h2")
    w = Window.partitionBy("_sg_h1", "_sg_h2").orderBy("_sg_h1")
    return (marked.join(picked, ["_sg_h1", "_sg_h2"], "left_semi")
            .withColumn("_sg_nth", F.row_number().over(w)).filter("_sg_nth = 1").select(*df.columns))


def default_order(df: DataFrame, order: str | list[str] | None) -> str | list[str] | None:
    """The order of a bucketed table is its buckets'."""
    return order or ("subset_size" if "subset_size" in df.columns else None)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key (count - count distinct)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.col(key))).cast("bigint").alias("n_duplicates"))


def join_constraints_base(constraints: DataFrame, base: DataFrame, key: str = "instruction_number",
                          dedupe_right: bool = True, order: str | None = None) -> DataFrame:
    """Inner join on the key, colliding columns suffixed _constraint/_base.

    Both sides may carry several rows per key (bucketed constraints, base
    replicated to buckets); ``dedupe_right`` keeps one base row per key so
    the output has one row per constraint row.  ``dedupe_right=False`` is the
    reference's fan-out (rows = product of the per-key counts)."""
    require_columns(constraints, [key])
    require_columns(base, [key])
    if dedupe_right:
        order = default_order(base, order)
        if order is None:
            warnings.warn(f"no order of the base rows of a {key} is stated: one is taken by its hash")
        base = dedupe_first(base, key, order or key)
    return _suffixed_join(constraints, base, key, ("_constraint", "_base"))


def join_three(constraints: DataFrame, base: DataFrame, evaluation: DataFrame,
               key: str = "instruction_number") -> DataFrame:
    """Constraints x base (suffix _constraint/_base) x evaluation (suffix ''/_eval)."""
    first = _suffixed_join(constraints, base, key, ("_constraint", "_base"))
    return _suffixed_join(first, evaluation, key, ("", "_eval"))


def replicate_left(df: DataFrame, generated: DataFrame, key: str, cols: list[str], heavy: int = 1024) -> DataFrame:
    """Values generated once per key, replicated to every row of ``df``
    (left join: rows without a generated value keep nulls).  Columns of
    ``df`` with the same names are replaced by the generated ones.

    Keys that hold more than 1/``heavy`` of all rows (counted; fewer than
    ``heavy``) are dealt over parts, and their generated row is sent to each
    part, so one key is never one task."""
    rows = df.drop(*[c for c in cols if c in df.columns])
    total = rows.agg(F.count(F.lit(1))).scalar()
    hot = (rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * heavy > total)
           .select(F.col(key).alias("_hot"), F.ceil(F.col("_n") * heavy / total).cast("int").alias("_parts")))  # < heavy rows

    def dealt(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")

    left = dealt(rows).withColumn("_part", F.pmod(F.xxhash64(*_hashable(rows)), F.col("_parts")).cast("int")).drop("_parts")
    right = dealt(generated.select(key, *cols)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(right, [key, "_part"], "left").drop("_part")


def join_pruned(left: DataFrame, right: DataFrame, key: str, right_cols: list[str]) -> DataFrame:
    """Inner join against only (key, right_cols) of the right side."""
    return left.join(right.select(key, *right_cols), key, "inner")


def _positions(df: DataFrame, order: list[str]) -> DataFrame:
    """(hashes of a row, its position in ``order``): only the order columns
    and the row's hash are sorted and written, not the row."""
    slim = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "_sg_h1", "_sg_h2")
    return assign_row_number(slim, [f"_o{i}" for i in range(len(order))] + ["_sg_h1", "_sg_h2"], out="_sg_pos").select("_sg_h1", "_sg_h2", "_sg_pos")


def zip_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str],
             warn: bool = True) -> DataFrame:
    """Positional pairing (row i with row i), truncated to the shorter
    side.  The distributed numbering F16 sorts the order columns and a row
    hash of each side; the positions meet first, and the rows are fetched by
    their 128-bit hashes."""
    if warn:
        na, nb = left.count(), right.count()
        if na != nb:
            warnings.warn(f"zip_join: length mismatch {na} vs {nb}; truncating to {min(na, nb)}")
    marks = ["_sg_h1", "_sg_h2"]
    w = Window.partitionBy(*marks).orderBy("_sg_h1")
    rows, positions = [], []
    for side, df, order in (("l", left, left_order), ("r", right, right_order)):
        marked = df.withColumns({f"_sg_h{s}": F.xxhash64(F.lit(s), *_hashable(df)) for s in (1, 2)})
        positions.append(_positions(marked, order).withColumnsRenamed({m: m + side for m in marks}))
        one = marked.withColumn("_sg_nth", F.row_number().over(w)).filter("_sg_nth = 1")
        rows.append(one.select(F.struct(*df.columns).alias(f"_sg_{side}"), *[F.col(m).alias(m + side) for m in marks]))
    met = positions[0].join(positions[1], "_sg_pos").join(rows[0], [m + "l" for m in marks]).join(rows[1], [m + "r" for m in marks])
    return met.select(F.col("_sg_pos").alias("position"), "_sg_l.*", "_sg_r.*")


def resolve_column(df: DataFrame, name: str, suffixes=("_constraint", "_base"), default: str | None = None):
    """First existing of name, name+suffix..., default, default+suffix...;
    raises naming the candidates when none exists (driver-side schema lookup)."""
    cands = [name] + [name + s for s in suffixes]
    if default:
        cands += [default] + [default + s for s in suffixes]
    for c in cands:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"none of the columns {cands} exists")
