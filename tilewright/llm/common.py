"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans.state import cut, ensure_checkpoint_dir

__all__ = ["ascii_lower", "cut", "cut_out", "ensure_checkpoint_dir", "let", "running_most", "running_total", "table", "text_hash", "texts", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_hash(column: str | Column) -> Column:
    """64 bits of a text, null as empty: with an id, what rows are known by where several texts share the id."""
    return F.xxhash64(whole_text(column))


#: Rows in a batch that goes to Python: texts may be long, so fewer than Spark's 10,000.
BATCH_ROWS = 1_000


def texts(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """(id, text) for operators in Python, null texts empty; without ``id_col``, the text alone.

    Lowers the session's Arrow batch size where it still is Spark's default, as
    batches of whole texts are what bounds a worker's memory.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:
        conf.set(key, BATCH_ROWS)
    return df.select(*([F.col(id_col).alias("id")] if id_col else []), whole_text(text_col).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` is right for a text of ASCII bytes only and is much the faster;
    any other text goes through ``translate``.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, also inside lambdas, where Spark repeats common expressions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each of an integer array's values, itself merged with all before it (from 0), as an array of bigint.

    Blocks are merged first, so the work grows with the array's length times
    the block and not with its square.
    """
    zero = F.lit(0).cast("bigint")
    total = lambda array: F.aggregate(array, zero, lambda t, x: merge(t, x.cast("bigint")))

    def of(own: Column) -> Column:
        n = F.size(own)
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda k: total(F.slice(own, k * block + 1, F.lit(block))))

        def within(base: Column, part: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(part)), lambda j: merge(base, total(F.slice(part, F.lit(1), j))))

        return let(
            sums,
            lambda sums: F.flatten(
                F.transform(
                    blocks,
                    lambda k: let(
                        total(F.slice(sums, F.lit(1), k)),
                        lambda base: let(F.slice(own, k * block + 1, F.lit(block)), lambda part: within(base, part)),
                    ),
                )
            ),
        )

    return let(values, of)


def running_total(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def running_most(values: Column) -> Column:
    return running(values, F.greatest)


#: Characters that a cut out of a text looks through at most, beside its own.
CHUNK = 4096


def cut_out(text: Column, spans: Column) -> Column:
    """array<string>: what ``text`` has at each of ``spans``, structs <first, end> in code points.

    Spark's ``substring`` counts characters from the beginning; cutting chunks
    first keeps the work linear where a long text has many spans.
    """

    def of(chunks: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            a = F.greatest(s["first"] - k * CHUNK, F.lit(0))
            b = F.least(s["end"] - k * CHUNK, F.lit(CHUNK))
            return F.substring(F.get(chunks, k), (a + 1).cast("int"), (b - a).cast("int"))

        def span(s: Column) -> Column:
            at = lambda x: F.floor(x / CHUNK).cast("int")
            return F.array_join(F.transform(F.sequence(at(s["first"]), at(s["end"] - 1)), lambda k: piece(s, k)), "")

        return F.transform(spans, lambda s: F.when(s["end"] > s["first"], span(s)).otherwise(F.lit("")))

    return let(F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{CHUNK}}}"), F.lit(0)), of)
