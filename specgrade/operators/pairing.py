"""Embedding similarity and pairing.

Nothing here enumerates all pairs.  Candidate partners come from a seeded,
portable hash sample of at most ``k`` partners per row (the reference's own
rule: score <= 50 random later rows), generated per row with array
functions and resolved with equi-joins.  Exact top-k search scores the corpus
against a *bounded* batch of query vectors shipped to each task (checked
size); each task keeps one running exact top-k per query, so only
``queries x k x tasks`` rows are shuffled.  Beyond that size slices of the
queries meet tiles of the corpus, pruned by an exact bound.  Greedy one-to-one
matching runs as rounds of locally dominant edges, checkpointed each round.
Finders with a pair limit work on a growing prefix of the scan order (the
first matches depend only on the edges before them), and bounded id lists
restrict the big tables through pushed-down filters or size-checked
broadcasts instead of shuffling them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrade.functions.hashing import mix62
from specgrade.operators.features import embed
from specgrade.operators.joins import broadcast_limit, restrict_to_keys  # noqa: F401
from specgrade.session import ensure_checkpoint_dir

# fixed values: the reference's default pairing parameters
DEFAULT_K = 50          # candidates scored per row
DEFAULT_MAX_PAIRS = 25  # pairs requested
DISSIMILAR_BAND = (0.40, 0.50)

QUERY_BATCH = 1 << 17   # query vectors collected at most in knn(), further capped by MAX_BATCH_BYTES
MAX_BATCH_BYTES = 8 << 20
GROUP_BYTES = 8 << 20  # vectors of one side of a task beyond one batch
GROUP_SIDE = 16         # tiles and slices there at least, where they hold more than a block
CELLS = 256             # pivots of a search beyond one batch
BLOCK_ROWS = 4096       # rows of the corpus scored at once there
SLICE_ROWS = 1024       # queries scored at once there


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector_norm(vec) -> Column:
    """Euclidean norm in double precision."""
    return F.sqrt(F.aggregate(F.transform(_c(vec), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def l2_normalize(vec) -> Column:
    """Unit vector as array<double>; null for a zero (or null) vector."""
    # the norm is bound once: inside the inner lambda it would be summed anew for each element
    scaled = F.transform(F.array(vector_norm(vec)), lambda n: F.when(n > 0, F.transform(_c(vec), lambda x: x.cast("double") / n)))
    return F.get(scaled, 0)


def dot(u, v) -> Column:
    """Dot product of two equal-length arrays, in double."""
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _idiv(a: Column, b: int) -> Column:
    """Integer division in bigint (no detour over double)."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def candidate_ids(i, n, k: int = DEFAULT_K, seed: int = 0) -> Column:
    """P5: array of exactly min(k, m) distinct partners j > i (ids dense
    0..n-1), in the order a scan would visit them; m = n-1-i later rows.

    The later rows are cut into k strata of (nearly) equal width, and every
    stratum gives one seeded 62-bit draw; the draws' hashes order the scan.
    With at most k later rows every stratum holds at most one row, so all of
    them are taken: one rule at every size, O(k) per row."""
    i_, n_ = _c(i).cast("bigint"), _c(n).cast("bigint")
    m = n_ - i_ - 1
    strata = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda r: F.struct(
        mix62(i_, r, seed).alias("h"), _idiv(r * m, k).alias("lo"),
        (_idiv((r + 1) * m, k) - _idiv(r * m, k)).alias("width")))
    draws = F.transform(F.filter(strata, lambda s: s["width"] > 0), lambda s: F.struct(
        s["h"].alias("h"), (i_ + 1 + s["lo"] + F.pmod(s["h"], s["width"])).alias("j")))
    return F.transform(F.array_sort(draws), lambda s: s["j"])


def sampled_candidates(vectors: DataFrame, id_col: str = "vec_id", k: int = DEFAULT_K,
                       seed: int = 0, dense: bool = True) -> DataFrame:
    """P5 as rows: (i, j, rank), rank 1-based scan order, i and j in
    ``id_col`` terms.  With ``dense`` the ids are the positions 0..n-1 (the
    reference's row index); otherwise positions are assigned in id order by
    the distributed numbering (F16) and mapped back with two equi-joins."""
    if dense:
        n = vectors.select(F.count(F.lit(1))).scalar()
        ids = vectors.select(F.col(id_col).alias("i")).withColumn("_n", n)
        return ids.select("i", F.posexplode(candidate_ids("i", "_n", k, seed)).alias("pos", "j")).select(
            "i", "j", (F.col("pos") + 1).alias("rank"))
    from specgrade.operators.corpus import assign_row_number
    pos = assign_row_number(vectors.select(F.col(id_col).alias("_id")), ["_id"], out="_pos", start=0)
    by_pos = sampled_candidates(pos.select(F.col("_pos").alias("_p")), "_p", k, seed, dense=True)
    a = by_pos.join(pos.withColumnsRenamed({"_pos": "i", "_id": "_ii"}), "i")
    b = a.join(pos.withColumnsRenamed({"_pos": "j", "_id": "_jj"}), "j")
    return b.select(F.col("_ii").alias("i"), F.col("_jj").alias("j"), "rank")


def score_edges(edges: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                normalize: bool = True) -> DataFrame:
    """P3 on given edges: cosine of (i, j) via two equi-joins on the ids
    (vectors shuffled by id, edges by i then j; no pair enumeration).

    The raw ``array<float>`` travels through both shuffles with one double
    norm (half the bytes of a normalised double array); the cosine is
    dot / (|u| |v|), computed after the joins.  Zero vectors are dropped.
    """
    v = vectors.select(F.col(id_col).alias("_id"), _c(vec).alias("_v"),
                       (vector_norm(vec) if normalize else F.lit(1.0)).alias("_n")).filter(F.col("_n") > 0)
    a = edges.join(v.withColumnsRenamed({"_id": "i", "_v": "_vi", "_n": "_ni"}), "i")
    b = a.join(v.withColumnsRenamed({"_id": "j", "_v": "_vj", "_n": "_nj"}), "j")
    return b.withColumn("similarity", dot("_vi", "_vj") / (F.col("_ni") * F.col("_nj"))).drop(
        "_vi", "_vj", "_ni", "_nj")


def band_pairs(edges: DataFrame, lo: float, hi: float, sim: str = "similarity") -> DataFrame:
    """Inclusive similarity band."""
    return edges.filter(F.col(sim).between(lo, hi))


def find_pairs(vectors: DataFrame, lo: float = DISSIMILAR_BAND[0], hi: float = DISSIMILAR_BAND[1],
               max_pairs: int | None = DEFAULT_MAX_PAIRS, k: int = DEFAULT_K, seed: int = 0,
               id_col: str = "vec_id", vec: str = "embedding", dense: bool = True,
               first_rows: int = 4096) -> DataFrame:
    """P6 (non-distinct): in-band sampled candidates in scan order (i, rank),
    first ``max_pairs`` (a top-n, no global sort); all of them with None.

    Only a growing prefix of rows is sampled and scored (``first_rows``, x4
    per pass): the first in-band edges in scan order come from the first
    rows, so the pass that yields ``max_pairs`` of them is exact."""
    if max_pairs is None:
        edges = score_edges(sampled_candidates(vectors, id_col, k, seed, dense), vectors, id_col, vec)
        return band_pairs(edges, lo, hi).select(F.col("i").alias("blog_1_id"), F.col("j").alias("blog_2_id"), "similarity")

    def run(v, col):
        ensure_checkpoint_dir(v.sparkSession)
        n = v.count()
        bound = max(1, first_rows)
        while True:
            cand = _prefix_candidates(v, col, n, bound, k, seed)
            scored = band_pairs(score_edges(cand, _vectors_for(cand, v, col, bound * (k + 1), n), col, vec), lo, hi)
            top = scored.orderBy("i", "rank").limit(max_pairs).checkpoint()  # <= max_pairs rows, kept
            if bound >= n or top.count() >= max_pairs:
                return top
            bound *= 4
    m = run(vectors, id_col) if dense else _in_position_space(vectors, id_col, vec, run)
    return m.select(F.col("i").alias("blog_1_id"), F.col("j").alias("blog_2_id"), "similarity")


def _vectors_for(edges: DataFrame, vectors: DataFrame, id_col: str, max_ids: int, n: int | None = None) -> DataFrame:
    """The vectors whose ids occur in ``edges`` (at most ``max_ids`` distinct
    ids).  When that id list provably fits the session's broadcast ceiling
    (16 bytes per id, checked before running), it is broadcast into a semi
    join: the vector table is scanned once and never shuffled, and only the
    selected vectors reach the scoring joins.  Otherwise Spark plans it.
    When the bound reaches the table's ``n`` rows nothing can be saved and
    the vectors are returned as they are."""
    if n is not None and max_ids >= n:
        return vectors
    ids = (edges.select(F.col("i").alias(id_col))
                .unionByName(edges.select(F.col("j").alias(id_col))).distinct())
    return restrict_to_keys(vectors, id_col, ids, max_ids, read_keys=False)


def _prefix_candidates(vectors: DataFrame, id_col: str, n: int, bound: int, k: int, seed: int) -> DataFrame:
    """P5 rows (i, j, rank) for the rows with dense id ``i < bound`` only."""
    ids = vectors.select(F.col(id_col).cast("bigint").alias("i")).filter(F.col("i") < bound)
    return (ids.withColumn("_n", F.lit(n).cast("bigint"))
               .select("i", F.posexplode(candidate_ids("i", "_n", k, seed)).alias("pos", "j"))
               .select("i", "j", (F.col("pos") + 1).alias("rank")))


def _in_position_space(vectors: DataFrame, id_col: str, vec: str, fn) -> DataFrame:
    """Run ``fn(v, "_pv")`` on the vectors numbered 0..n-1 in id order (F16)
    and map the (i, j) of its result back to ids with two equi-joins.  The
    numbered vectors are checkpointed once: ``fn`` reads them in several
    jobs, and each re-read would otherwise repeat the id join's shuffle."""
    from specgrade.operators.corpus import assign_row_number
    pos = assign_row_number(vectors.select(F.col(id_col).alias("_id")), ["_id"], out="_pos", start=0)
    vp = (vectors.join(pos.withColumnRenamed("_id", id_col), id_col)
                 .select(F.col("_pos").alias("_pv"), vec).checkpoint())
    out = fn(vp, "_pv")
    rest = [c for c in out.columns if c not in ("i", "j")]
    return (out.join(pos.withColumnsRenamed({"_pos": "i", "_id": "_ii"}), "i")
               .join(pos.withColumnsRenamed({"_pos": "j", "_id": "_jj"}), "j")
               .select(F.col("_ii").alias("i"), F.col("_jj").alias("j"), *rest))


# ----------------------------------------------------------------- matching
def greedy_matching(edges: DataFrame, u: str = "i", v: str = "j", priority: list[str] | None = None,
                    max_pairs: int | None = None) -> DataFrame:
    """The matching a sequential scan over edges in ``priority`` order
    builds (take an edge when both ends are still free).

    Distributed as rounds: an edge whose priority is the minimum at both of
    its ends is in the greedy matching; take all such edges, drop every
    edge touching a matched node, repeat.  Each round is a handful of
    shuffles keyed by node id and is checkpointed to the session's
    checkpoint dir, so lineage stays short and a lost executor only
    recomputes the current round.  With ``max_pairs`` the loop stops as soon
    as the first ``max_pairs`` matched edges in priority order can no longer
    change (every remaining edge ranks after them).  The loop always ends:
    the globally smallest remaining edge is locally dominant, so every round
    removes at least one edge.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    priority = priority or [u, v]
    pcols = [F.col(c) for c in priority] + [F.col(u), F.col(v)]
    e = edges.withColumn("_p", F.struct(*pcols)).select(u, v, "_p", *[c for c in edges.columns if c not in (u, v)])
    e = e.checkpoint()
    chosen_all = None
    n_chosen = 0
    while True:
        if max_pairs is None:
            if e.isEmpty():  # stops at the first row found
                break
        else:
            st = e.agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("mn")).first()  # one small job per round
            if st["n"] == 0:
                break
            if n_chosen >= max_pairs:
                kth = chosen_all.orderBy("_p").limit(max_pairs).agg(F.max("_p").alias("mx")).first()["mx"]
                if st["mn"] > kth:  # every remaining edge ranks after the first max_pairs
                    break
        ends = e.select(F.col(u).alias("_n"), "_p").unionByName(e.select(F.col(v).alias("_n"), "_p"))
        best = ends.groupBy("_n").agg(F.min("_p").alias("_best"))
        chosen = (e.join(best.withColumnsRenamed({"_n": u, "_best": "_bu"}), u)
                   .join(best.withColumnsRenamed({"_n": v, "_best": "_bv"}), v)
                   .filter((F.col("_p") == F.col("_bu")) & (F.col("_p") == F.col("_bv")))
                   .drop("_bu", "_bv")).checkpoint()
        if max_pairs is not None:
            n_chosen += chosen.count()
        # a union of checkpointed pieces: lineage stays one scan per round
        chosen_all = chosen if chosen_all is None else chosen_all.unionByName(chosen)
        matched = chosen.select(F.col(u).alias("_n")).unionByName(chosen.select(F.col(v).alias("_n")))
        e = (e.join(matched.withColumnRenamed("_n", u), u, "left_anti")
              .join(matched.withColumnRenamed("_n", v), v, "left_anti")).checkpoint()
    if chosen_all is None:
        return edges.limit(0)
    out = chosen_all
    if max_pairs is not None:
        out = out.orderBy("_p").limit(max_pairs)
    return out.drop("_p")


def find_pairs_distinct(vectors: DataFrame, lo: float = DISSIMILAR_BAND[0], hi: float = DISSIMILAR_BAND[1],
                        max_pairs: int | None = DEFAULT_MAX_PAIRS, k: int = DEFAULT_K, seed: int = 0,
                        id_col: str = "vec_id", vec: str = "embedding", dense: bool = True,
                        first_rows: int = 4096) -> DataFrame:
    """Each row in at most one pair; rows scanned in id order, first free
    in-band candidate (in sample order) wins; similarity rounded to 3 dp.

    With ``max_pairs`` only a growing prefix of rows is sampled and scored:
    the sequential scan's first matches depend only on the edges before
    them, so the first ``max_pairs`` matches among rows ``i < bound`` are the
    global ones.  The bound starts at ``first_rows`` and grows 4x per pass
    until ``max_pairs`` pairs are fixed or every row is covered."""
    if max_pairs is None:
        cand = sampled_candidates(vectors, id_col, k, seed, dense)
        edges = band_pairs(score_edges(cand, vectors, id_col, vec), lo, hi)
        m = greedy_matching(edges, "i", "j", ["i", "rank"])
    else:
        def run(v, col):
            return _distinct_prefix(v, lo, hi, max_pairs, k, seed, col, vec, first_rows)
        m = run(vectors, id_col) if dense else _in_position_space(vectors, id_col, vec, run)
    return m.select(F.col("i").alias("blog_1_id"), F.col("j").alias("blog_2_id"),
                    F.round("similarity", 3).alias("similarity"))


def _distinct_prefix(vectors: DataFrame, lo: float, hi: float, max_pairs: int, k: int, seed: int,
                     id_col: str, vec: str, first_rows: int) -> DataFrame:
    """Greedy matching over the candidates of rows ``i < bound`` (dense ids),
    bound x4 per pass; each pass is one sampling + scoring of the prefix rows
    (a small edge set joined to the vectors) and its matching rounds."""
    n = vectors.count()
    bound = max(1, first_rows)
    while True:
        cand = _prefix_candidates(vectors, id_col, n, bound, k, seed)
        edges = band_pairs(score_edges(cand, _vectors_for(cand, vectors, id_col, bound * (k + 1), n), id_col, vec),
                           lo, hi)
        m = greedy_matching(edges, "i", "j", ["i", "rank"], max_pairs=max_pairs)
        if bound >= n or m.count() >= max_pairs:  # count: <= max_pairs rows
            return m
        bound *= 4


def attach_pair_text(pairs: DataFrame, texts: DataFrame, id_col: str, text: str = "text",
                     max_pairs: int | None = None) -> DataFrame:
    """Materialise both texts on the pair list.

    With ``max_pairs`` (a proven bound on the pair rows, e.g. from a pair
    finder's limit) the corpus is never shuffled.  Up to ``joins.MAX_IN_KEYS`` ids
    they are read (a list of at most 2*max_pairs values) and become an
    ``IN`` filter that the Parquet scan pushes down, so row groups without a
    wanted id are skipped instead of reading every text.  Above that, the
    ids are broadcast into a semi join when they fit the session's
    broadcast ceiling (``joins.restrict_to_keys``).  Without a bound Spark
    plans the two left joins."""
    t = texts.select(F.col(id_col), F.col(text))
    if max_pairs is not None:
        ids = (pairs.select(F.col("blog_1_id").alias(id_col))
                    .unionByName(pairs.select(F.col("blog_2_id").alias(id_col))).distinct())
        t = restrict_to_keys(t, id_col, ids, 2 * max_pairs)
    a = pairs.join(t.withColumnsRenamed({id_col: "blog_1_id", text: "blog_1_text"}), "blog_1_id", "left")
    return a.join(t.withColumnsRenamed({id_col: "blog_2_id", text: "blog_2_text"}), "blog_2_id", "left")


def pair_stats(pairs: DataFrame, sim: str = "similarity") -> DataFrame:
    """Count, min, max, mean similarity."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.min(sim).alias("min_similarity"),
                     F.max(sim).alias("max_similarity"), F.avg(sim).alias("mean_similarity"))


# ---------------------------------------------------------------- top-k search
def _topk_scorer(qids: np.ndarray, qmat: np.ndarray, k: int, exclude_self: bool):
    """mapInPandas body: score the task's corpus rows against the query batch
    (float64 matmul, one score block <= 64 MB at a time) and keep a running
    exact top-k per query across all blocks and Arrow batches of the task,
    so a task emits at most k rows per query however large its partition.
    Each block is first cut to its own top-k (in place, query-major), then
    merged with the running q x k best."""
    chunk = max(1, (64 << 20) // (8 * max(len(qids), 1)))  # score block <= 64 MB
    nq = len(qids)

    def run(batches):
        best_s = np.empty((nq, 0))
        best_i = np.empty((nq, 0), dtype=np.int64)
        for pdf in batches:
            for start in range(0, len(pdf), chunk):
                part = pdf.iloc[start:start + chunk]
                ids = part["_id"].to_numpy(dtype=np.int64)
                mat = np.stack(part["_v"].to_numpy()).astype(np.float64)
                # corpus-major product (rows: corpus), then query-major for the cut
                scores = np.ascontiguousarray((mat @ qmat.T).T)
                scores[np.isnan(scores)] = -np.inf
                if exclude_self:
                    scores[qids[:, None] == ids[None, :]] = -np.inf
                scores = _canonical(scores, qmat, mat, k)
                blk_s, blk_i = _top_cols(scores, ids, k)
                best_s, best_i = _top_cols(np.hstack([best_s, blk_s]), np.hstack([best_i, blk_i]), k)
        rows, cols = np.nonzero(np.isfinite(best_s))
        if len(rows):
            yield pd.DataFrame({"query_id": qids[rows].astype(np.int64), "id": best_i[rows, cols],
                                "score": best_s[rows, cols]})
    return run


def _canonical(scores: np.ndarray, qmat: np.ndarray, mat: np.ndarray, k: int) -> np.ndarray:
    """Scores that do not depend on the block layout.  A matrix product rounds
    differently from tile to tile, so it only tells which columns can be among
    a query's k best (within its rounding error); those are scored anew by a
    sum in the order of the dimensions, all others drop out."""
    m, d = scores.shape[1], mat.shape[1]
    kth = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(len(scores), -np.inf)
    scale = np.abs(qmat).max(initial=0.0) * np.abs(mat).max(initial=0.0)
    qi, cj = np.nonzero((scores >= kth[:, None] - d * d * scale * 2.0 ** -50) & (scores > -np.inf))
    exact = np.zeros(len(qi))
    for t in range(d):
        exact += qmat[qi, t] * mat[cj, t]
    out = np.full(scores.shape, -np.inf)
    out[qi, cj] = exact
    return out


def _top_cols(s: np.ndarray, ids: np.ndarray, k: int):
    """Per row (query) of the score matrix ``s`` (q x m), the k best columns
    by (score desc, id asc), as q x k scores and ids.  ``ids`` is one id per
    column (shape m, shared by all rows) or per cell (q x m); ids are
    distinct within a row.  Ties at the cut go to the smallest ids, so the
    result does not depend on how the corpus is split into tasks and blocks."""
    q, m = s.shape
    if m <= k:
        return s, (np.broadcast_to(ids, s.shape).copy() if ids.ndim == 1 else ids)
    kth = np.partition(s, m - k, axis=1)[:, m - k]  # k-th largest score per row
    above = s > kth[:, None]
    tie = s == kth[:, None]
    need = k - above.sum(axis=1)  # >= 1 ties to take per row
    sel = tie
    crowded = np.nonzero(tie.sum(axis=1) > need)[0]  # more ties than places
    if len(crowded):
        ic = ids[None, :] if ids.ndim == 1 else ids[crowded]
        tk = np.where(tie[crowded], ic, np.iinfo(np.int64).max)
        thr = np.sort(tk, axis=1)[np.arange(len(crowded)), need[crowded] - 1]
        sel = tie.copy()
        sel[crowded] &= ic <= thr[:, None]
    idx = np.nonzero(above | sel)[1].reshape(q, k)  # exactly k kept columns per row
    top_i = ids[idx] if ids.ndim == 1 else np.take_along_axis(ids, idx, 1)
    return np.take_along_axis(s, idx, 1), top_i


def prepare_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                    normalize: bool = True, materialize: bool = True) -> DataFrame:
    """(_id, _v) with unit vectors (P2: no zero vectors).  With ``materialize`` it is written once
    with a reliable checkpoint so repeated passes (query batches, rounds)
    never recompute the upstream plan (e.g. a feature pipeline)."""
    out = df.select(F.col(id_col).alias("_id"), (l2_normalize(vec) if normalize else _c(vec)).alias("_v"))
    out = out.filter(F.col("_id").isNotNull() & F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False)))
    if not materialize:
        return out
    ensure_checkpoint_dir(df.sparkSession)
    return out.checkpoint()


def knn(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding",
        exclude_self: bool = False, normalize: bool = True, batch: int = QUERY_BATCH) -> DataFrame:
    """Exact top-k neighbours by inner product, (query_id, id, score, rank).

    Queries that provably fit one batch (rows, and bytes against
    MAX_BATCH_BYTES) travel to the tasks; each task scores its corpus
    partition with one matrix product and emits only a local top-k per query,
    and a window with rank <= k (window-group-limit) merges them.  More
    queries than that stay on the executors and meet the corpus cell by cell
    (``_knn_cells``).

    A separate corpus is checkpointed only when the queries exceed one
    batch: a search whose queries fit reads the corpus once and writes
    nothing.  An all-vs-all
    search (queries are the corpus) is read by several jobs, so its vectors
    are always written once.
    """
    same = corpus is queries
    q = prepare_vectors(queries, id_col, vec, normalize, materialize=same)
    st = _query_stats(q)
    multi = bool(st["n"]) and st["n"] > _per_batch(st, batch)
    if multi and not same:
        q = prepare_vectors(queries, id_col, vec, normalize)
    c = q if same else prepare_vectors(corpus, id_col, vec, normalize, materialize=multi)
    return knn_prepared(q, c, k, exclude_self, batch, stats=st)


def search_text(queries: DataFrame, docs: DataFrame, model, k: int = 5, query_id: str = "query_id", id_col: str = "doc_id",
                text: str = "text", preview: int = 200, search=None) -> DataFrame:
    """P10 for texts: both sides are embedded by one fitted feature pipeline
    (``features.fit_embedder``), so a query gets the corpus's weights; (query_id,
    id, score to 3 decimals, rank, preview).  A query or document without a
    weighted token has no vector and no hit.  ``search`` replaces the exact
    search, with the arguments of ``knn``."""
    def vectors(df: DataFrame, key: str) -> DataFrame:
        return embed(model, df.select(F.col(key).alias("vec_id"), text)).select("vec_id", "embedding")
    hits = (search or knn)(vectors(queries, query_id), vectors(docs, id_col), k, normalize=False)
    shown = docs.select(F.col(id_col).alias("id"), F.substring(text, 1, preview).alias("preview"))
    return hits.join(shown, "id").select("query_id", "id", F.round("score", 3).alias("score"), "rank", "preview")


def _query_stats(q: DataFrame):
    return q.agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi"),
                 F.max(F.size("_v")).alias("d")).first()


def _per_batch(st, batch: int) -> int:
    return max(1, min(batch, MAX_BATCH_BYTES // (8 * max(st["d"] or 1, 1))))


def knn_prepared(q: DataFrame, c: DataFrame, k: int, exclude_self: bool = False,
                 batch: int = QUERY_BATCH, stats=None, cells: int = CELLS, block: int = BLOCK_ROWS) -> DataFrame:
    """P9 on prepared (_id, _v) frames (see prepare_vectors)."""
    spark = c.sparkSession
    st = stats if stats is not None else _query_stats(q)
    if not st["n"]:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    if st["n"] > _per_batch(st, batch):
        return _knn_cells(q, c, k, exclude_self, st["d"] or 1, cells, block)
    pdf = q.orderBy("_id").toPandas()  # one batch, its size checked above
    return _merge_topk(_score_batch(c, pdf, k, exclude_self), k)


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a group's rows, one row each."""
    flat = table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(table.num_rows, -1)


def _finite(ids: np.ndarray, mat: np.ndarray, *more: np.ndarray):
    """Without the vectors that have no finite score with any other."""
    ok = np.isfinite(mat).all(axis=1)
    return (ids, mat, *more) if ok.all() else (ids[ok], mat[ok], *[x[ok] for x in more])


def _lengths(mat: np.ndarray) -> np.ndarray:
    """The rows' norms, 1 for a zero row, without overflow."""
    most = np.abs(mat).max(axis=1)
    most[most == 0] = 1.0
    length = most * np.sqrt(((mat / most[:, None]) ** 2).sum(axis=1))
    length[length == 0] = 1.0
    return length


def _fewest_copies(ids: np.ndarray, mat: np.ndarray, keep: int):
    """Of equal vectors the ``keep`` smallest ids: the others lose every tie."""
    order = np.argsort(ids, kind="stable")
    ids, mat = ids[order], np.ascontiguousarray(mat[order])
    group = np.unique(mat.view(np.dtype((np.void, mat.dtype.itemsize * mat.shape[1]))).ravel(), return_inverse=True)[1]
    if len(ids) == 0 or np.bincount(group).max() <= keep:
        return ids, mat
    by = np.argsort(group, kind="stable")
    nth = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    kept = np.sort(by[nth < keep])
    return ids[kept], mat[kept]


def _best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best (score desc, id asc) of each row, and the place in its row."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    top = nth < k
    return row[top], ids[top], score[top], nth[top]


def _places(hit: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask with few hits, eight bytes at a time."""
    flat = hit.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[some])
    return some[word] * 8 + byte


def _exact_scores(qmat: np.ndarray, mat: np.ndarray, qi: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """Inner products as sums in the order of the dimensions."""
    out = np.empty(len(qi))
    step = max(1, (1 << 21) // qmat.shape[1])
    for a in range(0, len(qi), step):
        out[a:a + step] = np.add.accumulate(qmat[qi[a:a + step]] * mat[cj[a:a + step]], axis=1)[:, -1]
    return out


def _group_topk(qids: np.ndarray, qmat: np.ndarray, floor: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int,
                exclude_self: bool, block: int):
    """The k best of ``mat`` for each query, as (query_id, id, score), those
    below a query's ``floor`` left out.  A product in single precision only
    tells which columns can be among the k best (within its rounding error);
    those are scored anew in double precision."""
    qids, qmat, floor = _finite(qids, qmat, floor)
    ids, mat = _finite(ids, mat)
    found = []
    if len(qids) and len(ids):
        extra = int(np.unique(ids, return_counts=True)[1].max()) if exclude_self else 0  # rows that a query leaves out
        ids, mat = _fewest_copies(ids, mat, k + extra)
        length, unit = _lengths(qmat), _lengths(mat).max()
        q32, c32 = (qmat / length[:, None]).astype(np.float32), (mat / unit).astype(np.float32)
        rows, dim, tiny = SLICE_ROWS, qmat.shape[1], np.finfo(np.float64).tiny
        for a in range(0, len(qids), rows):
            part = slice(a, a + rows)
            scale = np.maximum(length[part] * unit, 5e-324)
            error = 2 * (dim + 8) * 2.0 ** -23 + dim * tiny / scale
            least = np.minimum(floor[part] / scale, 2.0) - error
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for c in range(0, len(ids), block):
                s = q32[part] @ c32[c:c + block].T
                m = s.shape[1]
                new = np.flatnonzero(np.isneginf(least))
                if len(new) and m > k + extra:
                    least[new] = np.partition(s[new], m - k - extra, axis=1)[:, m - k - extra] - error[new]
                at = _places(s >= least.astype(np.float32)[:, None])
                qi, cj = at // m, at % m + c
                if exclude_self:
                    other = qids[part][qi] != ids[cj]
                    qi, cj = qi[other], cj[other]
                held = tuple(np.concatenate(x) for x in zip(held, (qi, ids[cj], _exact_scores(qmat[part], mat, qi, cj))))
                if len(held[0]) > 2 * k * rows or c + block >= len(ids):
                    *held, nth = _best_of(*held, k)
                    row, kth = (x[nth == k - 1] for x in (held[0], held[2]))
                    least[row] = np.maximum(least[row], kth / scale[row] - error[row])
            sure = np.isfinite(held[2]) & (held[2] >= floor[part][held[0]])
            found.append((qids[part][held[0][sure]], held[1][sure], held[2][sure]))
    return tuple(np.concatenate([np.zeros(0, t), *[f[i] for f in found]]) for i, t in enumerate((np.int64, np.int64, np.float64)))


def _packed(tile: int, ids: np.ndarray, mat: np.ndarray, floor: np.ndarray, got) -> pa.RecordBatch:
    """A tile as one row."""
    return pa.RecordBatch.from_pydict({"tile": pa.array([tile], pa.int32())} | {
        name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        for name, x in zip(("ids", "vectors", "floor", "found"), (ids, mat, floor, _triples(got)))})


def _triples(got) -> bytes:
    """(query_id, id, score) as bytes, one column after the other."""
    return np.frombuffer(b"".join(x.astype(t, copy=False).tobytes() for x, t in zip(got, (np.int64, np.int64, np.float64))), np.uint8)


def _raise_floor(qids: np.ndarray, floor: np.ndarray, got, k: int):
    """The k best of each query in ``got``, and ``floor`` raised to the k-th score."""
    *best, nth = _best_of(*got, k)
    by, kth = best[0][nth == k - 1], best[2][nth == k - 1]
    if len(by):  # by query id, as _best_of sorts
        at = np.minimum(np.searchsorted(by, qids), len(by) - 1)
        floor = np.where(by[at] == qids, np.maximum(floor, kth[at]), floor)
    return tuple(best), floor


def _knn_cells(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, dim: int, cells: int,
               block: int) -> DataFrame:
    """P9 for query sets of any size: exact, and no vector but the pivots
    passes through the driver.

    The ``cells`` vectors of smallest id hash are pivots; every vector x goes
    to its nearest pivot p, and a cell's radius R bounds |x - p|, so
    q.x <= q.p + |q| R for all of the cell.  Vectors in the order of their
    cells are dealt into tiles of at most GROUP_BYTES, queries likewise into
    slices; each is packed into one row and written once.  An all-vs-all
    search has one set of tiles for both sides: a tile first meets itself,
    which bounds the k-th scores of its queries from below.  Then a task takes
    one slice through a run of tiles, one tile at a time, scores those queries
    whose bound cannot rule out all of the tile's cells, and raises the bounds
    as it goes.  Tiles are read again from where they were written, so nothing
    but the vectors and the results is on disk, however many tiles there are;
    a separate query set starts without bounds."""
    spark = c.sparkSession
    ensure_checkpoint_dir(spark)
    picked = c.orderBy(F.xxhash64("_id"), "_id").limit(cells).toPandas()  # <= cells rows
    if picked.empty:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    pivots = np.nan_to_num(np.stack(picked["_v"].to_numpy()).astype(np.float64))

    def place(df: DataFrame) -> DataFrame:
        half = (pivots ** 2).sum(axis=1) / 2

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    m = np.nan_to_num(np.stack(pdf["_v"].to_numpy()).astype(np.float64))
                    cell = np.argmax(m @ pivots.T - half, axis=1)
                    yield pdf.assign(cell=cell.astype(np.int32), far=np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1)))
        return df.select("_id", "_v").mapInPandas(run, "_id bigint, _v array<double>, cell int, far double")

    def dealt(df: DataFrame, itself: bool):
        """``df`` in packed tiles, one to a partition, and the cells' first
        places and sizes."""
        placed = place(df)
        known = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("cell")  # <= cells rows
        size = max(1, min(GROUP_BYTES // (8 * max(dim, 1)), max(block, -(-int(known["n"].sum()) // GROUP_SIDE))))
        known["first"] = known["n"].cumsum() - known["n"]
        shape = F.broadcast(spark.createDataFrame(known[["cell", "first", "n"]], "cell int, first long, n long"))
        part = F.floor((F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("n"))) / size).cast("int")
        tiles = max(1, -(-int(known["n"].sum()) // size))

        def pack(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            ids, mat = table.column("_id").to_numpy(), _matrix(table)
            floor, got = np.full(len(ids), -np.inf), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if itself:
                got, floor = _raise_floor(ids, floor, _group_topk(ids, mat, floor, ids, mat, k, exclude_self, block), k)
            yield _packed(table.column("tile")[0].as_py(), ids, mat, floor, got)
        packed = (placed.join(shape, "cell").select("_id", "_v", part.alias("tile")).repartitionById(tiles, "tile")
                  .mapInArrow(pack, "tile int, ids binary, vectors binary, floor binary, found binary")).rdd.map(lambda r: r.asDict())
        packed.checkpoint()  # as Python wrote them: a read hands the bytes on
        packed.map(lambda r: r["tile"]).take(1)
        return packed, known, size, tiles

    same = q is c
    corpus, known, size, n_tiles = dealt(c, same)
    asked, n_slices = (corpus, n_tiles) if same else dealt(q, False)[::3]
    at, first, n, radius = (known[x].to_numpy() for x in ("cell", "first", "n", "radius"))
    lo, hi = first // size, (first + n - 1) // size  # the tiles of a cell
    near_pivots = pivots[at]

    def tiles_of(qmat: np.ndarray, tile: int, floor: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The queries that the bound of a cell of the tile does not rule out."""
        least = floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        return np.flatnonzero(~(bound[:, (lo <= tile) & (tile <= hi)] < least[:, None]).all(axis=1))

    def run(pairs):
        mine, held = None, None
        for a, b in pairs:
            if a["tile"] != mine:
                if held is not None and len(held[0]):
                    yield (bytes(_triples(held)),)
                mine, held = a["tile"], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                qids, floor = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["floor"], np.float64)
                qmat = np.frombuffer(a["vectors"], np.float64).reshape(len(qids), -1)
                finite = np.nan_to_num(qmat)
                bound = finite @ near_pivots.T + np.sqrt((finite ** 2).sum(axis=1))[:, None] * radius
            if same and b["tile"] == mine:
                continue
            ask = tiles_of(qmat, b["tile"], floor, bound)
            if len(ask):
                ids = np.frombuffer(b["ids"], np.int64)
                got = _group_topk(qids[ask], qmat[ask], floor[ask], ids, np.frombuffer(b["vectors"], np.float64).reshape(len(ids), -1), k, exclude_self, block)
                held, floor = _raise_floor(qids, floor, tuple(np.concatenate(x) for x in zip(held, got)), k)
        if held is not None and len(held[0]):
            yield (bytes(_triples(held)),)

    def rows(batches):
        for batch in batches:
            for x in batch.column(0):
                three = np.frombuffer(x.as_py(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(three[0]), pa.array(three[1]), pa.array(three[2].view(np.float64))], ["query_id", "id", "score"])

    runs = max(1, min(n_tiles, -(-8 * spark.sparkContext.defaultParallelism // n_slices)))
    met = asked.cartesian(corpus.coalesce(runs)).mapPartitions(run)
    own = corpus.map(lambda r: (bytes(r["found"]),))
    found = spark.createDataFrame(met.union(own) if same else met, "found binary").checkpoint()
    return _merge_topk(found.mapInArrow(rows, "query_id bigint, id bigint, score double"), k)


def _score_batch(c: DataFrame, pdf, k: int, exclude_self: bool) -> DataFrame:
    """Local top-k of every corpus task against one collected query batch."""
    qids = pdf["_id"].to_numpy(dtype=np.int64)
    qmat = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
    return c.mapInPandas(_topk_scorer(qids, qmat, k, exclude_self), "query_id bigint, id bigint, score double")


def _merge_topk(local: DataFrame, k: int) -> DataFrame:
    """Global top-k per query from the per-task lists (window-group-limit)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_pairs_distinct(vectors: DataFrame, k: int = 10, lo: float = 0.70, hi: float = 0.80,
                       max_pairs: int | None = DEFAULT_MAX_PAIRS, id_col: str = "vec_id", vec: str = "embedding",
                       first_batch: int = 256, batch: int = QUERY_BATCH,
                       materialize: bool = False, prefixes: int = 2) -> DataFrame:
    """Rows scanned in id order; each free row takes its first free
    neighbour (among its k-1 nearest, self excluded) whose cosine is in
    [lo, hi]; stop at ``max_pairs``.  With None all rows are searched
    (``knn``) and matched in rounds, nothing passing through the driver.

    Pairs found among the first rows can never be displaced by later rows,
    so with a limit a prefix of query ids is searched first: the 256, then 512
    smallest ids (a top-n per batch, no global sort), one corpus pass per
    batch.  Where ``prefixes`` batches do not fix ``max_pairs`` pairs, all rows
    are searched on the executors as without a limit, and the matching stops
    at its first ``max_pairs`` pairs, so the driver never holds more than
    those batches.  The used set carried between batches holds at most
    2*max_pairs ids.

    A batch reads the vectors twice (its top-n and its scoring pass), so a
    table input is re-read rather than copied; pass ``materialize=True`` when the vectors come
    from an expensive plan (they are then checkpointed once).
    """
    spark = vectors.sparkSession
    def search_all(limit: int | None) -> DataFrame:
        near = knn(vectors, vectors, k - 1, id_col, vec, exclude_self=True, batch=batch)
        edges = band_pairs(near.select(F.col("query_id").alias("i"), F.col("id").alias("j"), "rank",
                                       F.col("score").alias("similarity")), lo, hi)
        m = greedy_matching(edges, "i", "j", ["i", "rank"], max_pairs=limit)
        return m.select(F.col("i").alias("blog_1_id"), F.col("j").alias("blog_2_id"),
                        F.round("similarity", 3).alias("similarity"))
    if max_pairs is None:
        return search_all(None)
    prepared = prepare_vectors(vectors, id_col, vec, True, materialize=materialize)
    ids = vectors.select(F.col(id_col).cast("bigint").alias("_id")).filter(F.col("_id").isNotNull())
    cap = None  # batch size bound, from the dimension of the first batch
    found: list[tuple] = []
    used: set[int] = set()
    last = None
    size = max(1, min(first_batch, batch))
    searched = 0
    while len(found) < max_pairs:
        # the batch's id range from the id column alone (a top-n), then its
        # vectors through a range filter the scan can push down
        rest = ids if last is None else ids.filter(F.col("_id") > F.lit(last))
        hi_id = rest.orderBy("_id").limit(size).agg(F.max("_id").alias("hi")).first()["hi"]
        if hi_id is None:
            break
        if searched == prefixes:
            return search_all(max_pairs)
        searched += 1
        lo_cut = F.lit(True) if last is None else F.col("_id") > F.lit(last)
        pdf = prepared.filter(lo_cut & (F.col("_id") <= F.lit(hi_id))).orderBy("_id").toPandas()  # <= size vectors
        last = int(hi_id)
        if pdf.empty:
            continue
        if cap is None:
            d = max(len(v) for v in pdf["_v"]) or 1
            cap = max(1, min(batch, MAX_BATCH_BYTES // (8 * d)))
        nn = _merge_topk(_score_batch(prepared, pdf, k - 1, exclude_self=True), k - 1)
        edges = band_pairs(nn.select(F.col("query_id").alias("i"), F.col("id").alias("j"), "rank",
                                     F.col("score").alias("similarity")), lo, hi)
        if used:
            lit_used = list(used)
            edges = edges.filter(~F.col("i").isin(lit_used) & ~F.col("j").isin(lit_used))
        need = max_pairs - len(found)
        m = greedy_matching(edges, "i", "j", ["i", "rank"], max_pairs=need).collect()  # <= need rows
        for r in sorted(m, key=lambda r: (r["i"], r["rank"])):
            found.append((r["i"], r["j"], r["similarity"]))
            used.update((r["i"], r["j"]))
        size = min(size * 2, cap)
    rows = [(i, j, float(round(s, 3))) for i, j, s in found[:max_pairs]]
    return spark.createDataFrame(rows, "blog_1_id bigint, blog_2_id bigint, similarity double")
