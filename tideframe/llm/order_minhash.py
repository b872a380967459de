"""Fingerprints by order min-hash, in DataFrame operations only.

K-mers are runs of ``k`` words (runs other than space and \\x09-\\x0D; a shorter text is one k-mer,
a text without words one empty k-mer).  Each k-mer is numbered by its occurrence in the text, and
(k-mer, occurrence) is hashed once.  The top bits of the hash deal the k-mers to ``sketches`` bins;
of each bin the ``take`` minimal ones are selected, put back in text order and hashed as a tuple.  So a
sketch agrees only when the minimal k-mers agree and stand in the same order, which follows edit
distance where plain min-hash follows sets only.  One hash per k-mer serves all sketches.

The likeness of two fingerprints is the share of equal sketches among those filled in either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: A packed k-mer: the upper 41 bits of its hash, then 23 bits of its place in the text (in texts
#: of over 8 million words places repeat, which only affects the order within a tuple).
PLACE = (1 << 23) - 1


def fingerprints(rows: DataFrame, texts: dict[str, str], k: int = 3, sketches: int = 64, take: int = 2) -> DataFrame:
    """Add to ``rows`` for each column name -> text column an array of sketches (null: none)."""
    bits = sketches.bit_length() - 1
    if sketches != 1 << bits or not bits:
        raise ValueError("sketches: a power of two, at least 2")
    kept, names = [F.col(f"`{c}`") for c in rows.columns], list(texts)

    def step(df: DataFrame, **make) -> DataFrame:
        """A projection with, for each text, one column per part; every part is a column of its own, so no
        array is computed again for each of its elements."""
        return df.select(*kept, *[f(n).alias(f"{n}_{part}") for n in names for part, f in make.items()])

    def of(part: str):
        return lambda n: F.col(f"{n}_{part}")

    def get(n: str, part: str, i: Column) -> Column:
        return F.get(F.col(f"{n}_{part}"), i)

    def starts(part: str, shift: int):
        """Places in a sorted array at which the bits above ``shift`` change."""
        def make(n: str) -> Column:
            before = lambda i: get(n, part, F.greatest(i - 1, F.lit(0)))
            return F.filter(F.sequence(F.lit(0), F.size(f"{n}_{part}") - 1), lambda i: (i == 0) | (F.shiftright(get(n, part, i), shift) != F.shiftright(before(i), shift)))
        return make

    def run(n: str, part: str, begin: Column, number: Column) -> Column:
        """The elements from one start to the next."""
        return F.slice(F.col(f"{n}_{part}"), begin + 1, F.coalesce(get(n, "at", number + 1), F.size(f"{n}_{part}")) - begin)

    def marked(x: Column, place: Column) -> Column:
        return x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.bitwiseAND(F.lit(PLACE)))

    def in_text_order(part: Column) -> Column:
        moved = F.transform(part, lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 40).bitwiseOR(F.shiftrightunsigned(x, 24)))
        return F.transform(F.sort_array(moved), lambda y: y.bitwiseAND(F.lit((1 << 40) - 1)))

    top = 64 - bits
    words = step(rows, words=lambda n: F.split(F.btrim(F.col(texts[n]), F.lit(" \t\n\x0b\f\r")), SPACE))
    hashes = step(words, hashes=lambda n: F.slice(F.transform(f"{n}_words", lambda w, i: F.xxhash64(w, *[get(n, "words", i + j) for j in range(1, k)])), F.lit(1), F.greatest(F.size(f"{n}_words") - (k - 1), F.lit(1))))
    # occurrences: equal hashes are brought together by sorting and numbered in text order
    alike = step(hashes, alike=lambda n: F.sort_array(F.transform(f"{n}_hashes", lambda x, i: marked(x, i.cast("long")))))
    alike = step(alike, alike=of("alike"), at=starts("alike", 23))
    numbered = step(alike, all=lambda n: F.flatten(F.transform(f"{n}_at", lambda b, r: F.transform(run(n, "alike", b, r), lambda x, j: marked(F.xxhash64(F.shiftright(x, 23), j), x)))))
    ordered = step(numbered, all=lambda n: F.sort_array(f"{n}_all"))
    low = step(ordered, low=lambda n: F.filter(f"{n}_all", lambda x, i: (i < take) | (F.shiftright(x, top) != F.shiftright(get(n, "all", F.greatest(i - take, F.lit(0))), top))))
    low = step(low, low=of("low"), at=starts("low", top))
    bins = step(low, bins=lambda n: F.transform(f"{n}_at", lambda b: F.shiftright(get(n, "low", b), top).cast("int")), tuples=lambda n: F.transform(f"{n}_at", lambda b, r: F.xxhash64(in_text_order(run(n, "low", b, r)))))
    every = F.sequence(F.lit(-(sketches // 2)), F.lit(sketches // 2 - 1))
    filled = step(bins, map=lambda n: F.map_from_arrays(f"{n}_bins", f"{n}_tuples"))
    # the map is named twice, so that it stays a column and isn't built again for every bin
    sketch = lambda n: F.when(F.size(f"{n}_map") > 0, F.transform(every, lambda b: F.element_at(f"{n}_map", b)))
    return filled.select(*kept, *[sketch(n).alias(n) for n in names])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those filled in either; null if one fingerprint is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return F.when(a.isNotNull() & b.isNotNull(), same / filled)


def text_of(fingerprint: Column) -> Column:
    """Eight hex digits per sketch, dashes for an empty one."""
    digits = lambda x: F.coalesce(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8), F.lit("-" * 8))
    return F.lower(F.array_join(F.transform(fingerprint, digits), ""))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows (id, text, ghost) dealt to ranges of descending id, and the window in which lead() is the next
    row; after the last row comes the first.

    Ranges come from approximate percentiles of the ids, four per shuffle partition.  The first row
    of a range follows the last row of the range before it, so it is put there once more as a ghost.
    Only the bounds of the ranges, four numbers per partition, come to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that hashing ranges to tasks evens out
    bounds = sorted(set(rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    range_ = F.coalesce(F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("id"))), F.lit(0)) if bounds else F.lit(0)
    ranged = rows.select("id", "text", F.when(F.col("id").isNull(), 0).otherwise(range_).alias("range"))
    tops = sorted(((r["range"], r["top"]) for r in ranged.groupBy("range").agg(F.max("id").alias("top")).collect()), reverse=True)
    real = ranged.withColumn("ghost", F.lit(0))
    if tops:
        follows = [(tops[(k + 1) % len(tops)][1], tops[k][0]) for k in range(len(tops))]
        small = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(top).cast("long").alias("top"), F.lit(at).alias("at")) for top, at in follows])))
        ghosts = ranged.join(F.broadcast(small), F.col("id").eqNullSafe(F.col("top"))).select("id", "text", F.col("at").alias("range"), F.lit(1).alias("ghost"))
        real = real.unionByName(ghosts)
    return real, Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text (the last half replaced by the beginning of the next
    document in descending id), and the likeness to the edited text and to the next document.

    Null text: empty.  Null ids come last; equal ids are in order of text."""
    rows, by = with_next(docs, id_col, text_col)
    follow = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("next", F.lead("text").over(by))
    half = "n_chars div 2"
    edited = F.concat(F.expr(f"substring(text, 1, cast(n_chars - {half} as int))"), F.coalesce(F.expr(f"substring(next, 1, cast({half} as int))"), F.lit("")))
    texts = follow.withColumn("edited", edited)
    done = fingerprints(texts, {"print": "text", "edited_print": "edited"})
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    slim = done.select("id", "range", "ghost", "text", "n_chars", digest.alias("edited_sha256"), "print", "edited_print")
    after = slim.withColumn("next_print", F.lead("print").over(by)).where("ghost = 0")
    return after.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", text_of(F.col("print")).alias("fingerprint"), text_of(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
