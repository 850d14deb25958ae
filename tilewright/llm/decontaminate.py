"""Benchmark decontamination with Spark expressions only.

Benchmark items and documents are reduced to words (A-Z lower-cased, every
run of digits, a-z and non-ASCII characters). An item's windows are its runs
of ``window`` consecutive words, or all its words where it has fewer. Window
hashes of the benchmark form a hash set that is broadcast if its measured size
is under a bound and is joined by a shuffle otherwise; the hashes of the
documents' windows are looked up in it, and each hit is verified word by word
before it counts.

Defined results: null text has no words; an empty item has no window; items
that repeat are each reported; items without an id are reported as one whose id
is the empty string; rows of documents that repeat get the same result each, and
texts that share an id or have none are told apart by their hash; empty tables
give no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import ascii_lower, table, text_hash, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The benchmark's windows are broadcast up to this many rows and bytes of text.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(whole_text(text)), F.lit(WORD), F.lit(0))


def _hashes(word_array: Column) -> Column:
    return F.transform(word_array, lambda w: F.xxhash64(w))


def _window_hashes(hashes: Column, length: int) -> Column:
    """array<struct<pos, len, h>> of every run of ``length`` words; pos counts from 0."""
    n = F.size(hashes)
    return F.transform(
        F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            i.alias("pos"),
            F.lit(length).alias("len"),
            F.xxhash64(*[F.get(hashes, i + k) for k in range(length)]).alias("h"),
        ),
    )


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> tuple[DataFrame, list[int]]:
    """(h, len, gram, items): one row for each distinct window, with the items that have it; and the lengths there are."""
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    own = own.where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(window)).alias("len"))
    lengths = sorted(r[0] for r in own.select("len").distinct().collect())  # at most `window` values
    grams = own.select(
        "item",
        "len",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("len") + 1),
                lambda i: F.slice("w", i, F.col("len")),
            )
        ).alias("g"),
    ).select("item", "len", F.array_join("g", " ").alias("gram"), _hashes(F.col("g")).alias("hs"))
    if not lengths:
        return grams.select(F.lit(0).cast("bigint").alias("h"), "len", "gram", F.array("item").alias("items")), []
    h = F.coalesce(*[F.when(F.col("len") == n, F.get(_window_hashes(F.col("hs"), n), F.lit(0))["h"]) for n in lengths])
    return (
        grams.select("item", "len", "gram", h.alias("h"))
        .groupBy("h", "len", "gram")
        .agg(F.sort_array(F.collect_set("item")).alias("items")),
        lengths,
    )


def _by_text(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """(id, th, rows, n_words, hits): one row for each id and text, of which the table has ``rows`` rows."""
    grams, lengths = benchmark_windows(benchmark, item_col, item_text_col, window)
    own = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    keyed = own.select("id", text_hash("text").alias("th"), words(F.col("text")).alias("w"))
    if not lengths:
        none = F.array().cast("array<struct<pos:int,len:int,items:array<string>>>")
        return keyed.select("id", "th", F.lit(1).alias("rows"), F.size("w").alias("n_words"), none.alias("hits"))
    # A mark of length 0 goes with each document's windows, so that one scan gives the clean documents too.
    mark = F.array(F.struct(F.size("w").alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("h")))
    windows = F.concat(mark, *[_window_hashes(F.col("hs"), n) for n in lengths])
    one = docs.sparkSession.range(1)
    grams = grams.unionByName(
        one.select(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("len"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("items"))
    )
    hashed = keyed.select("id", "th", "w", _hashes(F.col("w")).alias("hs"))
    same = (F.col("len") == 0) | (F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ") == F.col("gram"))
    size = grams.select(F.count("*"), F.sum(F.octet_length("gram") + 40 * F.size("items"))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES:
        # the words stay in the task's own row: only windows that are found are written out
        scanned = hashed.select("id", "th", "w", F.explode(windows).alias("at")).select("id", "th", "w", "at.*")
        hits = scanned.join(F.broadcast(grams), ["h", "len"]).where(same)
    else:
        scanned = hashed.select("id", "th", F.explode(windows).alias("at")).select("id", "th", "at.*")
        found = scanned.where("len > 0").join(grams, ["h", "len"])
        texts = keyed.select(F.col("id").alias("w_id"), F.col("th").alias("w_th"), "w").dropDuplicates(["w_id", "w_th"])
        hits = found.join(texts, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).where(same)
        marks = keyed.select("id", "th", F.size("w").alias("pos"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items"))
        hits = hits.select(marks.columns).unionByName(marks)
    return hits.groupBy("id", "th").agg(
        F.count_if(F.col("len") == 0).cast("int").alias("rows"),
        F.max(F.when(F.col("len") == 0, F.col("pos"))).alias("n_words"),
        F.collect_set(F.when(F.col("len") > 0, F.struct("pos", "len", "items"))).alias("hits"),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(id, n_words, hit_words array<int>, items array<string>): one row for each row of ``docs``.

    ``hit_words`` are the positions, from 0, of the words inside any occurrence
    of a window. The documents' windows never leave the task that reads them;
    only those found in the hash set are grouped, by document.
    """
    by_text = _by_text(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    covered = F.flatten(F.transform("hits", lambda c: F.sequence(c["pos"], c["pos"] + c["len"] - 1)))
    return by_text.select(
        "id",
        "n_words",
        F.array_sort(F.array_distinct(covered)).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"])))).alias("items"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("row"),
    ).drop("row")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose text shares no window with the benchmark, unchanged.

    Rows are known by id (null like any other) and text, so a clean text stays beside a contaminated one of its id.
    """
    found = _by_text(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", WINDOW)
    bad = found.where(F.size("hits") > 0).select(F.col("id").alias("__bad_id"), F.col("th").alias("__bad_th"))
    same = F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (text_hash("text") == F.col("__bad_th"))
    return docs.join(bad, same, "left_anti")


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM item_words WHERE len(w) > 0
), grams AS (
  SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lens AS (SELECT DISTINCT k FROM grams
), doc_grams AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, lens WHERE len(w) >= k)
), hits AS (SELECT d.doc_id, d.i, d.k, g.item_id FROM doc_grams d JOIN grams g ON d.k = g.k AND d.gram = g.gram
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
