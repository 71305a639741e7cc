"""Benchmark decontamination by canonical templates.

Documents and benchmark items are canonicalised alike: lower-cased words, and
their templates, in which numbers, names (capitalised words but the function
words of ``FUNCTION``, wherever they stand) and units (after a number) are
replaced by typed placeholders.  What a word becomes depends on no text before
it.  Every run of ``window`` words of an item (the whole item, if shorter) is
one window, matched exactly on the lower-cased words and, where it has
placeholders, on the template words too; there it is lengthened until it has
``min_literals`` literal words, to the right or, at the item's end, to the
left.  A window is found by its probe, the hash of ``window`` of its words.
The probes of all places of a document are asked of a Bloom filter; those that
it holds take the words around them along, join the windows on the probe, and
then the words themselves must agree.

Matches of one item at one shift form an alignment.  Its slots must be
consistent: the original values map one to one onto the document's values, so
a re-parameterised question is caught and a chance match of placeholders is
not; of an inconsistent one the exact matches alone count.  An alignment
counts if it covers ``min_words`` words of the item, or all of a shorter item.

Only DataFrame functions are used, in one pass over the documents.  The filter
takes at most 16 MB; the windows are broadcast up to ``block_windows`` of them
and shuffled beyond, so a benchmark of any size is searched with bounded memory.

Defined results: null or wordless texts match nothing, on either side; items
with fewer than ``min_literals`` literal words are matched exactly only.
Repeated items count once, items with the same texts are searched once and
reported each, repeated documents each on its own.  Empty tables
give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import broadcast_if, cut, no_bloom_filters, row_key, whole_text

# Marks of the canonical text: a name, a number, a unit, and the place of a
# separator inside a number.
NAME, NUMBER, UNIT, INNER = "\x01", "\x02", "\x03", "\x04"
SLOTS = [NAME, NUMBER, UNIT]
# Unit words.
UNITS = ["km", "m", "cm", "mm", "miles", "mile", "feet", "inches", "kg", "g", "mg", "pounds", "liters", "litres", "ml",
         "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "months", "years",
         "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "mph", "kmh"]
# Words that are no names although they begin a sentence.
FUNCTION = ["A", "An", "The", "This", "That", "These", "Those", "There", "Here", "It", "Its", "He", "She", "We", "You", "They", "His", "Her", "Our",
            "Your", "Their", "My", "In", "On", "At", "By", "For", "From", "Of", "To", "With", "Without", "Into", "After", "Before", "During", "Between",
            "Under", "Over", "About", "And", "Or", "But", "Nor", "So", "Yet", "If", "When", "While", "Because", "Although", "Since", "Until", "As", "Than",
            "Then", "Not", "No", "Is", "Are", "Was", "Were", "Be", "Do", "Does", "Did", "Has", "Have", "Had", "Can", "Could", "Will", "Would", "Should",
            "May", "Might", "Must", "What", "Which", "Who", "Whom", "Whose", "Why", "How", "Where", "Each", "Every", "All", "Some", "Any", "Both", "One"]
# ASCII characters that part words, listed one by one (a table lookup in Java)
APART = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() and chr(c) not in SLOTS + [INNER])
WORD = f"[^{APART}]++"
BUCKET_LONGS = 512   # of 64 bits: one row of the probes' filter
MAX_BUCKETS = 1 << 12  # 16 MB of bits
MAX_NAMED = 1 << 16  # items whose names are broadcast at most


def spaced_text(text: Column) -> Column:
    """Text in which a number is one word, and a unit written to it another."""
    unit = "|".join(UNITS)
    joined = F.regexp_replace(text, r"([0-9])[.,](?=[0-9])", f"$1{INNER}")
    return F.regexp_replace(joined, f"([0-9])(?=(?:{unit})(?:[{APART}]|$))", "$1 ")


def template_text(spaced: Column) -> Column:
    """Lower-case text with every name, number and unit replaced by its
    placeholder, word by word."""
    name = rf"(?=\p{{Lu}}\p{{Ll}})(?<![^{APART}])(?!(?:{'|'.join(FUNCTION)})(?:[{APART}]|$)){WORD}"
    names = F.lower(F.regexp_replace(spaced, name, NAME))
    numbers = F.regexp_replace(names, f"(?=[0-9])(?<![^{APART}])[0-9]++(?:{INNER}[0-9]++)*+(?![^{APART}])", NUMBER)
    return F.regexp_replace(numbers, f"{NUMBER}([ \\t\\r\\n]++)(?:{'|'.join(UNITS)})(?=[{APART}]|$)", f"{NUMBER}$1{UNIT}")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def canonical(df: DataFrame) -> DataFrame:
    """Adds ``raw`` and ``tmpl``, the raw and the template words, aligned."""
    spaced = spaced_text(whole_text())
    return df.withColumns({"raw": words(F.lower(spaced)), "tmpl": words(template_text(spaced))})


def named_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, item) and (item, text): items with the same texts share one
    ``item`` and are searched once."""
    rows = benchmark.select("item_id", "text").distinct()
    marks = [F.bit_xor(F.xxhash64(whole_text(), F.lit(seed))) for seed in (0, 1)]
    named = cut(rows.groupBy("item_id").agg(F.xxhash64(F.count(F.lit(1)), *marks).alias("item")))
    own = named.withColumnRenamed("item_id", "__own")
    return named, rows.join(own, F.col("item_id").eqNullSafe(F.col("__own"))).select("item", "text").distinct()


def windows(items: DataFrame, window: int, min_literals: int) -> DataFrame:
    """(item, item_words, at, length, exact, w_tmpl, w_raw, probe_at,
    probe_words, probe); a document's words must equal w_raw if exact and else
    w_tmpl.  The probe is the hash of at most ``window`` words of these, of
    those with the most literal ones, from ``probe_at`` on."""
    places = F.filter(F.sequence(F.lit(0), F.size("tmpl") - 1), lambda i: ~F.get("tmpl", i).isin(*SLOTS))
    tasks = items.sparkSession.sparkContext.defaultParallelism
    each = (canonical(items.repartition(tasks, "item")).filter(F.size("tmpl") > 0)
            .withColumns({"item_words": F.size("tmpl"), "length": F.least(F.lit(window), F.size("tmpl")), "places": places}))
    starts = F.sequence(F.lit(0), F.col("item_words") - F.col("length"))

    def run(at: Column, length: Column, exact: bool) -> Column:
        return F.struct(at.alias("at"), length.alias("length"), F.lit(exact).alias("exact"))

    def lengthened(at: Column) -> Column:
        after = F.filter("places", lambda p: p >= at)
        longer = F.greatest(F.col("length"), F.get(after, F.lit(min_literals - 1)) + 1 - at)
        earlier = F.least(F.get("places", F.size("places") - min_literals), F.col("item_words") - F.col("length"))
        at_end = F.size(after) < min_literals
        return run(F.when(at_end, earlier).otherwise(at), F.when(at_end, F.col("item_words") - earlier).otherwise(longer), False)

    slotted = F.when(F.size("places") >= min_literals, F.array_distinct(F.transform(starts, lengthened)))
    runs = [F.transform(starts, lambda at: run(at, F.col("length"), True)), slotted]
    found = (each.withColumn("run", F.explode(F.concat(runs[0], F.coalesce(runs[1], F.slice(runs[0], 1, 0)))))
             .select("item", "item_words", "run.*", *[F.slice(c, F.col("run.at") + 1, F.col("run.length")).alias(f"w_{c}") for c in ("tmpl", "raw")])
             .withColumn("key", wanted("w_raw", "w_tmpl"))
             .filter((F.col("exact") | F.exists("w_tmpl", lambda w: w.isin(*SLOTS))) & F.exists("key", lambda w: ~w.isin(*SLOTS))))
    some = F.least(F.lit(window), F.col("length"))
    literals = F.transform("key", lambda w: F.when(w.isin(*SLOTS), 0).otherwise(1))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("length") - some), lambda o: F.struct(
        F.aggregate(F.slice(literals, o + 1, some), F.lit(0), lambda n, one: n + one).alias("n"), (-o).alias("o"))))
    return (found.withColumns({"probe_words": some, "probe_at": F.when(F.col("length") == some, 0).otherwise(-best["o"])})
            .withColumn("probe", F.xxhash64(F.slice("key", F.col("probe_at") + 1, F.col("probe_words")))).drop("key"))


def wanted(raw: str, tmpl: str) -> Column:
    """The words to compare: of an exact window the raw ones."""
    return F.when(F.col("exact"), F.col(raw)).otherwise(F.col(tmpl))


def probe_place(buckets: int, probe: str = "probe") -> tuple[Column, list[Column]]:
    """A probe's bucket of the filter, and its two bits there."""
    return F.pmod(F.col(probe), F.lit(buckets)).cast("int"), [F.pmod(F.shiftright(probe, n), F.lit(64 * BUCKET_LONGS)).cast("int") for n in (20, 40)]


def probe_filter(found: DataFrame, buckets: int) -> DataFrame:
    """Bloom filter of the windows' probes, one row a bucket: (bucket, bits,
    left, right); a window reaches at most ``left`` words before its probe and
    ``right`` from the probe's first word on."""
    bucket, places = probe_place(buckets)
    each = found.select(bucket.alias("bucket"), F.explode(F.array(*places)).alias("bit"), "probe_at", (F.col("length") - F.col("probe_at")).alias("after"))
    words = each.groupBy("bucket", F.shiftright("bit", 6).alias("nth")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"), F.max("probe_at").alias("left"), F.max("after").alias("right"))
    whole = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("nth", "bits"))).alias("bits"), F.max("left").alias("left"), F.max("right").alias("right"))
    return whole.withColumn("bits", F.transform(F.sequence(F.lit(0), F.lit(BUCKET_LONGS - 1)), lambda i: F.coalesce(F.try_element_at("bits", i), F.lit(0).cast("long"))))


def alignments(docs: DataFrame, items: DataFrame, window: int = 8, min_words: int = 13, min_literals: int = 5,
               block_windows: int = 1 << 15) -> DataFrame:
    """(doc_id, rk, item, shift, n_windows, covered, item_words,
    reparameterised, first_word) of every alignment that counts; ``items`` is
    ``named_items``' (item, text)."""
    found = cut(windows(items, window, min_literals))
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words"), F.collect_set("probe_words").alias("sizes")).first()  # <= window sizes
    buckets = 1 << max(0, min(MAX_BUCKETS, -(-seen["n"] // BUCKET_LONGS)) - 1).bit_length()
    asked = F.broadcast(cut(probe_filter(found, buckets)))
    few = seen["n"] <= block_windows and (seen["words"] or 0) <= 16 * block_windows
    found = F.broadcast(found) if few else found

    prepared = canonical(docs.select("doc_id", row_key().alias("rk"), "text")).select("doc_id", "rk", "raw", "tmpl")
    placed = prepared.select("doc_id", "rk", "raw", "tmpl", F.explode(F.when(F.size("raw") > 0, F.sequence(F.lit(0), F.size("raw") - 1))).alias("pos"))
    sizes = sorted(seen["sizes"]) or [window]
    hashes = {f"{c}_{n}": F.xxhash64(F.slice(c, F.col("pos") + 1, F.lit(n))) for n in sizes for c in ("raw", "tmpl")}
    probes = F.array(*[x for n in sizes for x in (F.col(f"raw_{n}"), F.when(F.col(f"tmpl_{n}") != F.col(f"raw_{n}"), F.col(f"tmpl_{n}")))])
    bucket, places = probe_place(buckets)
    held = [F.expr(f"getbit(bits[{p}], {q})") == 1 for p, q in (("bit_0 >> 6", "bit_0 & 63"), ("bit_1 >> 6", "bit_1 & 63"))]
    met = (placed.withColumns(hashes).select("doc_id", "rk", "raw", "tmpl", "pos", F.explode(probes).alias("probe"))
           .withColumns({"bucket": bucket, "bit_0": places[0], "bit_1": places[1]}).join(asked, "bucket").filter(held[0] & held[1]))
    first = F.greatest(F.col("pos") - F.col("left"), F.lit(0))
    near = [F.slice(c, F.col("first") + 1, F.col("pos") - F.col("first") + F.col("right")).alias(c) for c in ("raw", "tmpl")]
    around = met.withColumn("first", first).select("doc_id", "rk", "probe", "pos", (F.col("pos") - F.col("first")).alias("here"), *near)

    start = F.col("here") - F.col("probe_at")
    theirs = [F.slice(c, F.greatest(start, F.lit(0)) + 1, F.col("length")) for c in ("raw", "tmpl")]
    hit = around.join(found, "probe").filter((start >= 0) & (F.when(F.col("exact"), theirs[0]).otherwise(theirs[1]) == wanted("w_raw", "w_tmpl")))
    pair = F.arrays_zip(F.col("w_tmpl").alias("kind"), F.col("w_raw").alias("ours"), theirs[0].alias("theirs"))
    begin = F.col("pos") - F.col("probe_at")
    hits = hit.select("doc_id", "rk", "item", "item_words", (begin - F.col("at")).alias("shift"), "at", "length", "exact", begin.alias("start"),
                      F.filter(pair, lambda p: p["kind"].isin(*SLOTS)).alias("slots"))
    if not few:  # a runtime Bloom filter would read the documents once more
        with no_bloom_filters(docs.sparkSession):
            hits = cut(hits)
    run = F.struct("at", "length")
    grouped = hits.groupBy("doc_id", "rk", "item", "shift").agg(
        F.first("item_words").alias("item_words"), F.collect_set(run).alias("runs"), F.collect_set(F.when(F.col("exact"), run)).alias("exact_runs"),
        F.min("start").alias("first_word"), F.min(F.when(F.col("exact"), F.col("start"))).alias("exact_first"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    ours = F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["kind"], p["ours"]))))
    theirs = F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["kind"], p["theirs"]))))
    consistent = (ours == F.size("slots")) & (theirs == F.size("slots"))
    counted = (grouped.withColumn("consistent", consistent)
               .withColumns({"runs": F.when(F.col("consistent"), F.col("runs")).otherwise(F.col("exact_runs")),
                             "first_word": F.when(F.col("consistent"), F.col("first_word")).otherwise(F.col("exact_first")),
                             "reparameterised": F.col("consistent") & F.exists("slots", lambda p: p["ours"] != p["theirs"])}))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["length"] - 1)))))
    starts = F.size(F.array_distinct(F.transform("runs", lambda r: r["at"])))
    return (counted.withColumns({"covered": covered, "n_windows": starts})
            .filter(F.col("covered") >= F.least(F.lit(min_words), F.col("item_words")))
            .drop("runs", "exact_runs", "exact_first", "consistent", "slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per (document, item) found: doc_id, item_id, n_windows, covered
    (words of the best alignment), containment, reparameterised (that of the
    best alignment), first_word (its first word in the document)."""
    best = F.max(F.struct("covered", "n_windows", (-F.col("first_word")).alias("early"), "reparameterised", "item_words"))
    named, items = named_items(benchmark)
    each = alignments(docs, items, **options).groupBy("doc_id", "rk", "item").agg(best.alias("b")).join(broadcast_if(named, MAX_NAMED), "item")
    return each.select("doc_id", "item_id", F.col("b.n_windows").cast("long").alias("n_windows"), F.col("b.covered").cast("long").alias("covered"),
                       (F.col("b.covered") / F.col("b.item_words")).alias("containment"), F.col("b.reparameterised").alias("reparameterised"),
                       (-F.col("b.early")).cast("long").alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    hits = alignments(docs, named_items(benchmark)[1], **options).select(F.col("doc_id").alias("__did"), F.col("rk").alias("__drk")).distinct()
    keyed = docs.withColumn("__rk", row_key())
    return keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("__did")) & (F.col("__rk") == F.col("__drk")), "left_anti").select(*docs.columns)
