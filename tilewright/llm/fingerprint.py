"""SimHash document fingerprints with Spark expressions only.

A text's terms are its pairs of neighbouring words (a lone word by itself; the
whole text where it has no word). Each term votes with the bits of a 128-bit
hash, weighted by the letters it has, so that pairs of short and common words
count little; a bit of the fingerprint is 1 if it has over half of the weight.
Two vote counts share one 64-bit sum, 32 bits each, which holds texts of up to
four thousand million letters.

``search`` finds all fingerprints within ``RADIUS`` bits of given ones by
permuted block tables: eight blocks of 16 bits, of which at least two agree in
any pair within 6 bits, so a table for each of the 28 pairs of blocks, keyed by
the two, holds every such pair. A pair counts in the first table that has it.

Defined results: null text is empty; equal texts have equal fingerprints; rows
that share an id share the next document, which is the first by text of the
next greater id; rows with a null id have no next document, an unchanged edited
text and likenesses of 1. Empty tables give no rows. Columns other than id and text are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut, let, table, whole_text

BITS, BLOCKS, RADIUS = 128, 8, 6
WORD = r"[\p{L}\p{N}]+"
LANES = 0x0000000100000001


def _terms(text: Column) -> Column:
    """array<struct<h, w>>: the terms' hashes and weights."""
    lower = F.lower(text)

    def term(*parts: Column) -> Column:
        letters = reduce(lambda a, b: a + b, (F.char_length(p) for p in parts))
        return F.struct(F.xxhash64(*parts).alias("h"), letters.cast("bigint").alias("w"))

    def of(words: Column) -> Column:
        n = F.size(words)
        pairs = F.transform(
            F.arrays_zip(F.slice(words, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(n - 1, F.lit(0))).alias("b")),
            lambda p: term(p["a"], p["b"]),
        )
        return F.when(n > 1, pairs).when(n == 1, F.array(term(F.get(words, F.lit(0))))).otherwise(
            F.array(F.struct(F.xxhash64(lower).alias("h"), F.lit(1).cast("bigint").alias("w")))
        )

    return let(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), of)


def with_fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo): the fingerprint of each key's text as two bigints. Keys are unique, their partitioning is kept."""
    terms = df.select(*keys, F.explode(_terms(F.col(text))).alias("t")).select(
        *keys, F.col("t.h").alias("__lo"), F.xxhash64("t.h").alias("__hi"), F.col("t.w").alias("__w")
    )
    lanes = [
        F.sum(F.shiftrightunsigned(f"__{half}", k).bitwiseAND(F.lit(LANES)) * F.col("__w")).alias(f"__{half}{k}")
        for half in ("hi", "lo")
        for k in range(32)
    ]
    votes = terms.groupBy(*keys).agg(F.sum("__w").alias("__all"), *lanes)

    def half(name: str) -> Column:
        bits = []
        for k in range(32):
            low = F.col(f"__{name}{k}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"__{name}{k}", 32)
            for at, v in ((k, low), (k + 32, high)):
                one = (1 << at) - (1 << 64) * (at == 63)
                bits.append(F.when(v * 2 > F.col("__all"), F.lit(one).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return votes.select(*keys, half("hi").alias("hi"), half("lo").alias("lo"))


def written(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """The share of bits that agree."""
    return 1 - (F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))) / F.lit(float(BITS))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, n, next_id) for distinct ids (id, n): the next greater id, and after the greatest the least.

    Ids are dealt out by ranges and ordered within each; only each range's
    first id, one row for each partition, is ordered in a single task.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.where("id IS NOT NULL").repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    order = Window.orderBy("part")
    after = firsts.select(
        F.col("part").alias("p"),
        F.coalesce(F.lead("first").over(order), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
    )
    own = ranged.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return own.join(F.broadcast(after), F.col("part") == F.col("p")).select("id", "n", F.coalesce("next_id", "after").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, n_chars, edited_sha256, hi, lo, e_hi, e_lo, next_id) for each row and its edited text.

    The edited text's last half is the beginning of the next document. Each
    text is shuffled once, and of the next document's only as much as is put in.
    """
    given = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    own, unnamed = given.where("id IS NOT NULL"), given.where("id IS NULL")
    order = cut(next_ids(own.groupBy("id").agg(F.max(F.char_length("text")).alias("n"))))
    rows = own.withColumn("tie", F.row_number().over(Window.partitionBy("id").orderBy("text")))
    # `own` is the same plan here and in `rows`, so that its exchange is made once
    heads = order.alias("o").join(own.alias("h"), F.col("o.next_id") == F.col("h.id"))
    put = heads.select(F.col("o.id").alias("put_id"), "o.next_id", F.substring("h.text", F.lit(1), F.floor(F.col("o.n") / 2).cast("int")).alias("put"))
    put = put.groupBy("put_id", "next_id").agg(F.min("put").alias("put"))  # of the first text, where several share an id
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("put", F.lit(1), half))
    both = rows.join(put, F.col("id") == F.col("put_id")).select("id", "tie", "next_id", n.alias("n_chars"), "text", edited.alias("edited"))
    alone = unnamed.select(
        "id",
        F.row_number().over(Window.partitionBy("text").orderBy("id")).alias("tie"),
        F.col("id").alias("next_id"),
        n.alias("n_chars"),
        "text",
        F.col("text").alias("edited"),
    )
    keys = ["id", "tie", "next_id", "n_chars", "edited_sha256", "which"]
    pick = lambda c, k: F.max(F.when(F.col("which") == k, F.col(c)))

    def of(texts: DataFrame) -> DataFrame:
        sha = F.sha2("edited", 256).alias("edited_sha256")
        each = texts.select(*keys[:4], sha, F.posexplode(F.array("text", "edited")).alias("which", "own"))
        each = with_fingerprints(each, keys, "own").groupBy(*keys[:-1])
        return each.agg(pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("e_hi"), pick("lo", 1).alias("e_lo"))

    return of(both).unionByName(of(alone))


def _block_keys(hi: Column, lo: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)) for h in (hi, lo) for k in range(4)]


def search(queries: DataFrame, all_: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, near_hi, near_lo): for each fingerprint (hi, lo) of ``queries``, those of ``all_`` within ``radius`` <= 6 bits.

    Both hold distinct fingerprints.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"radius must be within 0 and {BLOCKS - 2}")
    tables = list(combinations(range(BLOCKS), 2))

    def keyed(df: DataFrame) -> DataFrame:
        b = _block_keys(F.col("hi"), F.col("lo"))
        rows = F.array(
            *[F.struct(F.lit(t).alias("t"), (b[i] * 65536 + b[j]).alias("key")) for t, (i, j) in enumerate(tables)]
        )
        return df.select("hi", "lo", F.explode(rows).alias("x")).select("hi", "lo", "x.t", "x.key")

    q, a = keyed(queries).alias("q"), keyed(all_).alias("a")
    hi, lo = F.col("q.hi").bitwiseXOR(F.col("a.hi")), F.col("q.lo").bitwiseXOR(F.col("a.lo"))
    agree = reduce(lambda x, y: x + y, (F.when(b == 0, 1 << k).otherwise(0) for k, b in enumerate(_block_keys(hi, lo))))
    below = F.element_at(F.array(*[F.lit((2 << j) - 1) for _, j in tables]), F.col("q.t") + 1)
    mine = F.element_at(F.array(*[F.lit((1 << i) | (1 << j)) for i, j in tables]), F.col("q.t") + 1)
    near = F.bit_count(hi) + F.bit_count(lo) <= radius
    met = q.join(a, (F.col("q.t") == F.col("a.t")) & (F.col("q.key") == F.col("a.key")) & near & (agree.bitwiseAND(below) == mine))
    return met.select("q.hi", "q.lo", F.col("a.hi").alias("near_hi"), F.col("a.lo").alias("near_lo"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and for ids divisible by 50 how many others are near.

    ``n_near`` counts the other documents within RADIUS bits, all documents
    being searched; it is null for documents that aren't queries.
    """
    own = cut(fingerprints(table(spark, sf_dir, "documents")))
    after = own.where("tie = 1").select(F.col("id").alias("a_id"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"))
    counts = own.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    asked = own.where("id % 50 = 0").select("hi", "lo").distinct()
    near = search(asked, counts.select("hi", "lo")).join(
        counts.select(F.col("hi").alias("near_hi"), F.col("lo").alias("near_lo"), "n"), ["near_hi", "near_lo"]
    )
    near = near.groupBy("hi", "lo").agg(F.sum("n").alias("n_near")).select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), "n_near")
    c = F.col
    out = own.join(after, c("next_id") == c("a_id"), "left")
    out = out.join(near, (c("hi") == c("s_hi")) & (c("lo") == c("s_lo")) & (c("id") % 50 == 0), "left")
    return out.select(
        c("id").alias("doc_id"),
        c("n_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        written("hi", "lo").alias("fingerprint"),
        written("e_hi", "e_lo").alias("edited_fingerprint"),
        likeness(c("hi"), c("lo"), c("e_hi"), c("e_lo")).alias("near_edited"),
        F.when(c("id").isNull(), F.lit(1.0)).otherwise(likeness(c("hi"), c("lo"), c("n_hi"), c("n_lo"))).alias("near_next"),
        (c("n_near") - 1).alias("n_near"),
    )
