"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's units are the stretches between spaces; a k-mer is ``K`` consecutive units, the first ones starting before the
text. k-mers are numbered by occurrence, so that repeats count. One hash per k-mer both picks one of ``BINS`` bins and
ranks it there (occurrences of a k-mer follow each other). In every bin the ``PER_BIN`` minimal numbered k-mers are put
back into text order, and the hash of that tuple is the bin's signature: moving a block of text changes tuples although
the set of k-mers stays. Likeness is the share of equal signatures among bins that are not empty in both texts.

Limits: positions are held in 24 bits, so units behind the 16.7 millionth share the last position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import quantiles, width

BINS = 64  # a power of two, at most 64: the bin takes 6 bits of a signature
PER_BIN = 2
POSITION_BITS = 24


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a column array<int>: for each bin that is not empty, in order, its number (upper 6 bits) and the hash of its tuple.

    Every step is a column of its own: an array that a lambda looks into is then computed once per row.
    """
    mask = (1 << POSITION_BITS) - 1
    shift = 64 - (BINS.bit_length() - 1)

    def bin_of(v: Column) -> Column:
        return F.shiftright(v, shift)

    # Two consecutive units make a k-mer; the first unit is one alone. Hash in the upper bits, position in the lower.
    df = df.withColumn("_units", F.split(text, " "))
    df = df.withColumn(
        "_ranked",
        F.sort_array(
            F.transform(
                "_units",
                lambda unit, i: F.xxhash64(unit, F.get("_units", i - 1)).bitwiseAND(F.lit(~mask)).bitwiseOR(F.least(i, F.lit(mask)).cast("long")),
            )
        ),
    )
    df = df.withColumn(
        "_least", F.filter("_ranked", lambda v, i: (i < PER_BIN) | (bin_of(v) != bin_of(F.get("_ranked", i - PER_BIN))))
    )

    def tuple_of(v: Column, i: Column) -> Column:
        after = F.get("_least", i + 1)
        paired = F.coalesce(bin_of(after) == bin_of(v), F.lit(False))
        first, second = F.shiftright(v, POSITION_BITS), F.shiftright(after, POSITION_BITS)
        again = (first == second).cast("int")
        # Text order of the two: by position; the first occurrence of a repeated k-mer precedes the second.
        swapped = after.bitwiseAND(F.lit(mask)) < v.bitwiseAND(F.lit(mask))
        hashed = (
            F.when(~paired, F.hash(first, F.lit(0)))
            .when(swapped, F.hash(second, again, first, F.lit(0)))
            .otherwise(F.hash(first, F.lit(0), second, again))
        )
        head = F.coalesce(bin_of(F.get("_least", i - 1)) != bin_of(v), F.lit(True))
        low = hashed.bitwiseAND(F.lit((1 << 26) - 1))
        return F.when(head, F.shiftleft(bin_of(v).cast("int"), 26).bitwiseOR(low))

    found = F.filter(F.transform("_least", tuple_of), lambda s: s.isNotNull())
    return df.withColumn(name, found).drop("_units", "_ranked", "_least")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal signatures over bins used by either text."""
    bins = lambda s: F.transform(s, lambda v: F.shiftright(v, 26))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint, and how like it is to its edited text and to the next document.

    The next document is the one with the next smaller id (after the last: the first); rows with equal ids are ordered by
    a hash of their text, null ids come last. The edited text has its last floor(n/2) code points replaced by the first
    as many of the next document. A null text is empty. A table of one row has itself as next.

    Documents are dealt out by ranges of ids, each small enough for one task; rows of one frequent id are spread over
    ranges by the hash of their text. Within a range the next row is the one behind; a range's last row gets its
    neighbour's first. Only that border table (one row per range) is joined.
    """
    spark = docs.sparkSession
    n = 4 * width(spark)
    cuts = quantiles(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", n)
    limits = F.array(*map(F.lit, cuts)).cast("array<long>") if cuts else F.expr("CAST(array() AS array<long>)")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    below = F.size(F.filter(limits, lambda c: c < F.col("doc_id")))
    upto = F.size(F.filter(limits, lambda c: c <= F.col("doc_id")))
    # A value that fills whole ranges is spread over them in the order of its ties.
    share = F.least((((F.col("tie") / F.lit(2.0**64)) + 0.5) * (upto - below)).cast("int"), upto - below - 1)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).when(upto > below, below + 1 + share).otherwise(upto)
    rows = with_signatures(rows.select("doc_id", "text", "tie", bucket.alias("bucket")), "text", "sig")
    order = "PARTITION BY bucket ORDER BY doc_id DESC NULLS LAST, tie DESC"
    rows = rows.selectExpr(
        "*",
        f"lead(text) OVER ({order}) AS next_text",
        f"lead(sig) OVER ({order}) AS next_sig",
    )
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    keyed = keyed.select("text", bucket.alias("bucket"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie").alias("place"))
    # As many rows as there are ranges, at most 4 * width + 1.
    heads = keyed.groupBy("bucket").agg(F.max("place").alias("head"))
    firsts = keyed.join(F.broadcast(heads.withColumnRenamed("bucket", "_b")), (F.col("bucket") == F.col("_b")) & F.col("place").eqNullSafe(F.col("head")))
    firsts = firsts.groupBy("bucket").agg(F.any_value("text").alias("border_text"))
    # One row per range.
    borders = firsts.selectExpr(
        "bucket", "coalesce(lead(border_text) OVER (ORDER BY bucket DESC), first(border_text) OVER (ORDER BY bucket DESC)) AS border_text"
    )
    rows = rows.join(with_signatures(borders, "border_text", "border_sig"), "bucket")
    rows = rows.select(
        "doc_id",
        "text",
        "sig",
        F.coalesce("next_text", "border_text").alias("next_text"),
        F.coalesce("next_sig", "border_sig").alias("next_sig"),
        F.char_length("text").cast("long").alias("n_chars"),
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_sig")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
