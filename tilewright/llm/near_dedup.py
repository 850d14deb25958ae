"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
3-word shingles. Two fingerprints within ``RADIUS`` = 3 bits agree in one of
their two 32-bit halves but for at most one bit, which is half the radius. So
every distinct fingerprint emits, for each half, all values within one bit of
it; fingerprints meet by a shuffle on (half, value), and pairs that collide are
verified on all 64 bits. Links run between distinct fingerprints only: exact
copies share one and never meet as pairs.

A value that many distinct fingerprints share exactly would make pairs with
the square of their number. Fingerprints that meet in such a bucket (more than
``HOT`` members) take another exact way instead: the ball of radius 1 and the
ball of radius 2 around each are shuffled, and all that meet in a point which
is in someone's ball of radius 1 are linked to the least of those, as any such
link is at most 1 + 2 = 3 bits long. That is linear in their number.

Components come from alternating large-star and small-star rounds over the
links, each round cut by a checkpoint; the label is the least document id.

The nodes of the graph are the distinct fingerprints, so neither copies nor
ids that are null or repeat change who is linked.

``op6_near_dedup`` links by this rule. The pipeline's stage links texts by how
many five-word shingles they share (``similar_groups``). Candidates meet if all ``ROWS`` least hashes
(MinHash) of one of ``BANDS`` bands agree, so each text has that many keys. In every shared value all are held
against one centre, first the text that meets most others, in turns until few are still in different
components. What is still apart then is joined exactly (``_crossing``): shingles in one order, the rarer first, and
two texts meet in a shingle only if what follows it in both is enough. So a group of copies costs as much as it
has members, and no pair that met is left out.
Meeting is by chance: of two texts at a similarity of 0.8, 24 bands of 5 miss one in 13,000 by expectation; at 0.9,
none to speak of. Keys have 64 bits, so texts that have nothing in common don't meet however many there are.

Defined results: null or empty text has fingerprint zero and links like any
other; each row has the component of its own text, also where rows share an id;
a null id is never the label unless a component has no other (then it is null);
empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import cut, table, text_hash, texts

RADIUS, SHINGLE, SEED = 3, 3, 42
HOT = 64
#: The stage's rule: texts link if they share this part of their distinct shingles of so many words.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Candidates: bands, and least hashes in each; words in a fingerprint's shingle, and bits by which all 192 may differ (at 0.8, 18 are expected).
BANDS, ROWS = 24, 5
PAIR, FAR = 2, 36
#: An odd constant, 2^64 by the golden ratio.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd constants, one for each least hash.
FACTORS = np.random.default_rng(7).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Texts to verify are found by a broadcast of their hashes (16 bytes each) up to this many, else by a shuffle join.
BROADCAST_ENDS = 500_000
#: Turns in which texts are held against one centre of each shared value; they end when a row has this many pairs or fewer left, or a turn doesn't halve what is left.
STAR_TURNS, FEW_PAIRS = 6, 4
#: First turns, whose centres are the texts that meet most others, each once.
RANKED = 2
#: Bits of a set's parities (a power of two) and the columns that hold them. They rule pairs out up to sets of about 2,000 shingles; larger sets differ by more than so few bits can tell.
PARITIES = 1024
PARITY_WORDS = tuple(f"p{i}" for i in range(PARITIES // 64))
#: Shingles hashed at a time; bounds the memory that a very long text takes.
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of one text as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        line = b" ".join(part)
        ends = list(accumulate((len(w) + 1 for w in part), initial=0))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(line[s : e - 1], SEED) for s, e in zip(ends, ends[k:], strict=False)), np.uint64, len(part) - k + 1
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["id", "fp", "th"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint, th bigint) for each row; th tells texts of one id apart."""
    own = texts(docs, id_col, text_col).withColumn("th", text_hash("text"))
    return own.mapInArrow(_fingerprints, f"id {dict(own.dtypes)['id']}, fp bigint, th bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(weight: int, width: int) -> list[int]:
    """All masks of at most ``weight`` (0 to 2) bits within ``width``."""
    one = [1 << i for i in range(width)]
    return [0, *one, *([a | b for i, a in enumerate(one) for b in one[:i]] if weight == 2 else [])]


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join's side that grows with the corpus: never collected on the driver to be broadcast, whatever a plan takes its size for."""
    return df.hint("merge")


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between the ids of ``nodes`` (id, fp; fp distinct) that connect all within RADIUS bits.

    Outside hot buckets these are all pairs; inside, stars that join the same
    nodes. Every link returned is within RADIUS.
    """
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("v")),
        F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")),
    )
    exact = nodes.select("id", "fp", F.explode(halves).alias("x")).select("id", "fp", "x.half", "x.v")
    near = exact.select("id", "fp", "half", "v", F.explode(F.array(*[F.lit(m).cast("bigint") for m in _bits(1, 32)])).alias("m")).select(
        "id", "fp", "half", F.col("v").bitwiseXOR(F.col("m")).alias("v")
    )
    crowded = exact.groupBy("half", "v").count().where(F.col("count") > hot).select("half", "v")
    crowded = cut(crowded)
    cold = exact.join(_shuffled(crowded), ["half", "v"], "left_anti")
    a, b = cold.alias("a"), _shuffled(near.alias("b"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    pairs = a.join(
        b,
        (F.col("a.half") == F.col("b.half")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") != F.col("b.id")) & close,
    ).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    if crowded.isEmpty():
        return pairs.distinct()
    # the exact way for crowded buckets
    theirs = near.join(_shuffled(crowded), ["half", "v"], "left_semi").select("id", "fp").distinct()
    masks = F.array(*[F.lit(_signed(m)) for m in _bits(2, 64)])
    balls = theirs.select("id", "fp", F.explode(masks).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m")).alias("p"), "id", (F.bit_count("m") <= 1).alias("inner")
    )
    centre = balls.groupBy("p").agg(F.min(F.when(F.col("inner"), F.col("id"))).alias("centre"), F.count("*").alias("n"))
    centre = centre.where(F.col("centre").isNotNull() & (F.col("n") > 1)).select("p", "centre")
    stars = balls.join(_shuffled(centre), "p").where(F.col("id") != F.col("centre"))
    stars = stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each id of ``edges`` (a, b) reaches."""
    edges = cut(edges.select("a", "b").where("a != b").distinct())

    def round_of(e: DataFrame, larger_only: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        flipped = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        near = both.unionByName(flipped) if larger_only else flipped  # small-star: only neighbours below u
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = near.join(_shuffled(least), "u")
        if larger_only:
            out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
                least.select(F.col("m").alias("a"), F.col("u").alias("b"))
            )
        return out.where("a != b").distinct()

    seen = None
    while True:
        edges = cut(round_of(round_of(edges, True), False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("id"), F.col("a").alias("root"))
            ).distinct()
        seen = state


def _groups(docs: DataFrame, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp, th) of each row, and (fp, first): of each fingerprint, the first row of its component as (no id, id, th)."""
    marked = cut(with_fingerprints(docs, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "th")).alias("first")))
    roots = components(links(nodes.select(F.col("fp").alias("id"), "fp"), hot)).withColumnRenamed("id", "node")
    rooted = nodes.join(_shuffled(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).withColumnRenamed("root", "f_root")
    return marked, rooted.drop("first").join(_shuffled(firsts), F.col("root") == F.col("f_root")).select(F.col("fp").alias("n_fp"), "first")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, fp bigint, component): one row for each row of ``docs``."""
    marked, firsts = _groups(docs, id_col, text_col, hot)
    return marked.join(_shuffled(firsts), F.col("fp") == F.col("n_fp"), "left").select("id", "fp", F.col("first.id").alias("component"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


#: Columns of a wide fingerprint.
WORDS = ("f0", "f1", "f2")


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """Two 64-bit hashes of each distinct shingle, n x 2; a text of fewer words is one shingle, no words are none."""
    k, parts = min(size, len(words)), [np.zeros((0, 2), np.uint64)]
    for at in range(0, len(words) - k + 1 if words else 0, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        line = b" ".join(part)
        ends = list(accumulate((len(w) + 1 for w in part), initial=0))
        digest = xxhash.xxh3_128_digest
        parts.append(np.frombuffer(b"".join(digest(line[s : e - 1]) for s, e in zip(ends, ends[k:], strict=False)), np.uint64).reshape(-1, 2))
    hashes = np.concatenate(parts)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def wide_fingerprint(words: list[bytes]) -> np.ndarray:
    """The 192-bit SimHash of distinct word pairs, as three 64-bit integers; the third word of a pair's hash is mixed from two."""
    hashes, ones = _shingles(words, PAIR), np.zeros(192, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        third = part[:, 0] * MIX ^ part[:, 1]
        third = (third ^ third >> np.uint64(29)) * MIX
        bits = np.unpackbits(np.column_stack([part, third ^ third >> np.uint64(32)]).view(np.uint8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The 64-bit key of each band of a set of hashes; none if the set is empty."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * FACTORS).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        keys = (keys ^ row) * MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _node(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, fps, keys = [], [], []
        for t in batch.column(1):
            words = _words(t.as_py())
            nodes.append(_node(words))
            fps.append(wide_fingerprint(words))
            keys.append(band_keys(_shingles(words, SIMILAR_SHINGLE)[:, 0]))
        f = np.array(fps, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), *(pa.array(f[:, i]) for i in range(3)), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "th", "node", *WORDS, "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.column(1):  # a text at a time: its set may be as large as the text
            words = _words(t.as_py())
            own = _shingles(words, SIMILAR_SHINGLE)[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_node(words)], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=["node", "s"])


def _sets_of(wanted: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(node, s): the hashes of the distinct shingles of the texts in ``wanted`` (node, distinct).

    ``own`` is (id, text, th); of each node, the text of its first row is read.
    """
    ends = cut(wanted.join(nodes, "node").select(F.col("first.id").alias("e_id"), F.col("first.th").alias("e_th")))
    few = F.broadcast(ends) if ends.count() <= BROADCAST_ENDS else ends
    read = own.join(few, (F.col("th") == F.col("e_th")) & F.col("id").eqNullSafe(F.col("e_id")), "left_semi").select("id", "text")
    return cut(read.mapInArrow(_sets, "node bigint, s array<bigint>").dropDuplicates(["node"]))


def _enough(shared: Column, total: Column) -> Column:
    """Whether two sets of ``total`` members together, of which ``shared`` are in both, are similar; no members are like no members."""
    return shared >= SIMILARITY * (total - shared)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (node, s): whether an odd number of members fall on each of PARITIES places."""
    for batch in batches:
        bits = np.zeros((len(batch), PARITIES), np.uint8)
        for own, s in zip(bits, batch.column(1), strict=True):
            places = s.values.to_numpy().view(np.uint64) * MIX >> np.uint64(64 - PARITIES.bit_length() + 1)
            own[:] = np.bincount(places.astype(np.int64), minlength=PARITIES) & 1
        words = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w.copy()) for w in words.T)], names=["p_node", *PARITY_WORDS])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts share SIMILARITY of their shingles."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    return cut(both.where(_enough(F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b"))).select("a", "b"))


def _crossing(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``apart`` (key, node, root) that have not one root and may be similar.

    A shingle that only texts of one root have is in no intersection asked for. The others are put in one order for all,
    the rarer among these texts first. Two texts share nothing before their first common shingle, so they share
    at most what either has from there on (``rest``); a text is listed under a shingle only if that is enough for
    some other, and two meet there if it is enough for both. In a large group what its texts have in common comes
    last, so they meet by what else they share. Two that meet are a pair only if their sets' parities, which differ in
    at most as many bits as the sets in members, allow it; that is seen in the join, so the pairs it makes are nearly the
    similar ones. No similar pair goes. Rows of a shingle are still compared with each other, by 128 bytes each.
    """
    own = sets.join(_shuffled(apart.select("node", "root").distinct()), "node")
    items = own.select("node", "root", F.size("s").alias("size"), F.explode("s").alias("key"))
    common = items.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    last = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("key")))
    listed = items.join(_shuffled(cut(common.select("key", "n"))), "key").withColumn("rest", last).drop("n").where(_enough(F.col("rest"), F.col("size") + F.col("rest")))
    listed = cut(listed)
    smallest = listed.groupBy("key").agg(F.min("size").alias("smallest"))
    able = cut(listed.join(_shuffled(smallest), "key").where(_enough(F.col("rest"), F.col("size") + F.greatest("smallest", "rest"))).drop("smallest"))
    # a shingle's most frequent root is met by the others only, so a large component isn't held against itself
    of_roots = able.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    mixed = able.join(_shuffled(of_roots.where("roots > 1").select("key", "main")), "key")
    parities = sets.select("node", "s").mapInArrow(_parities, ", ".join(f"{c} bigint" for c in ("p_node", *PARITY_WORDS)))
    mixed = cut(mixed.join(_shuffled(parities), F.col("node") == F.col("p_node")).drop("p_node"))
    x, y = mixed.where("root != main").alias("x"), _shuffled(mixed).alias("y")
    total = F.col("x.size") + F.col("y.size")
    apart_by = sum(F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in PARITY_WORDS)
    may = _enough(F.least("x.rest", "y.rest"), total) & _enough((total - apart_by) / 2, total)
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.root") < F.col("y.root"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & may)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _edges(roots: DataFrame) -> DataFrame:
    """The links (a, b) that make the components of ``roots``."""
    return roots.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b"))


def _similar(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, th, node, ...) of each row, and (n_node, first): of each node, the first row of its component as (no id, id, th)."""
    own = texts(docs, id_col, text_col).withColumn("th", text_hash("text"))
    marked = cut(own.mapInArrow(_mark, f"id {dict(own.dtypes)['id']}, th bigint, node bigint, f0 bigint, f1 bigint, f2 bigint, bands array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "th")).alias("first")
    nodes = cut(marked.groupBy("node").agg(first, *[F.min(f).alias(f) for f in WORDS], F.first("bands").alias("bands")))

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(x), *[F.col(f).alias(x + f) for f in WORDS]) for x in "ab")
        bits = sum(F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in WORDS)
        return pairs.join(a, "a").join(b, "b").where(bits <= FAR).select(*pairs.columns)

    points = nodes.select(F.explode("bands").alias("key"), "node")
    shared = points.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(points.join(_shuffled(shared), "key"))
    # the texts that meet most others, likely what the rest were made from or little else, come first; then others by a hash of the round
    most = met.groupBy("node").agg(F.sum("n").alias("rank"))
    apart = cut(met.drop("n").join(most, "node").withColumn("root", F.col("node")))
    roots, before = None, float("inf")
    for turn in range(1, STAR_TURNS + 1):
        centre = apart.groupBy("key").agg(F.max(F.struct("rank", "node", "root")).alias("c"))
        held = apart.join(centre, "key")
        stars = held.where("root != c.root").select(F.col("c.node").alias("a"), F.col("node").alias("b"), "c.rank").distinct()
        pairs = cut(near(stars).groupBy("b").agg(F.max(F.struct("rank", "a")).alias("c")).select("c.a", "b"))
        found = _alike(pairs, _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, own))
        roots = cut(components(found if roots is None else found.unionByName(_edges(roots))))
        after = F.when(F.col("node") == F.col("c.node"), F.lit(-1)).otherwise(F.col("rank")) if turn < RANKED else F.xxhash64("node", F.lit(turn))
        placed = held.select("key", "node", after.alias("rank")).join(roots.withColumnRenamed("id", "node"), "node", "left")
        placed = cut(placed.select("key", "node", F.coalesce("root", "node").alias("root"), "rank"))
        sizes = placed.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
        mixed = cut(sizes.where("own < n * n"))
        apart = cut(placed.join(mixed, "key", "left_semi"))
        rows, left = mixed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()
        if left <= FEW_PAIRS * rows or left > before / 2:
            break
        before = left
    # what is still apart is joined by its shingles
    sets = _sets_of(apart.select("node").distinct(), nodes, own)
    late = _alike(near(_crossing(apart, sets)), sets)
    if not late.isEmpty():
        roots = components(late.unionByName(_edges(roots)))
    rooted = nodes.join(roots.withColumnRenamed("id", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).withColumnRenamed("root", "f_root")
    return marked, rooted.drop("first").join(firsts, F.col("root") == F.col("f_root")).select(F.col("node").alias("n_node"), "first")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): one row for each row of ``docs``; texts link at SIMILARITY of five-word shingles or more.

    Words are as for ``fingerprint``. Texts of the same words are one text. The
    component is its least id (null is greatest).
    """
    marked, firsts = _similar(docs, id_col, text_col)
    return marked.join(firsts, F.col("node") == F.col("n_node"), "left").select("id", F.col("first.id").alias("component"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of ``similar_groups``, unchanged: the least id's, and of its texts in the group the one with the least hash.

    Rows are known by id and text, so a text that is in no group stays whatever else has its id; a row with a
    null id goes only if its text is a copy of another; of rows that repeat both id and text, any one stays.
    """
    _, firsts = _similar(docs, "doc_id", "text")
    kept = cut(firsts.select(F.col("first.id").alias("__k_id"), F.col("first.th").alias("__k_th")).distinct())
    own = docs.withColumn("__th", text_hash("text"))
    same = F.col("__th") == F.col("__k_th")
    # in two parts, as a null-safe key would shuffle the texts twice
    named = own.where("doc_id IS NOT NULL").join(kept.where("__k_id IS NOT NULL"), (F.col("doc_id") == F.col("__k_id")) & same, "left_semi")
    unnamed = own.where("doc_id IS NULL").join(kept.where("__k_id IS NULL"), same, "left_semi")
    return named.dropDuplicates(["doc_id", "__th"]).unionByName(unnamed.dropDuplicates(["__th"])).drop("__th")
