"""MinHash near-dedup with an LSH forest.

Each text's MinHash signature is read in several rotated orders, the trees. In every tree the
texts are sorted by signature; neighbours with a long common prefix are candidates, as deep as
the region allows. A second step takes the pairs that share a region but still lie in different
components, so that hot regions lose no link. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ordering import dealt
from .store import finished, settled, written
from .text import hash_spans, mix, pieces, spans_of, utf8

#: Trees, the depth that makes a region, and the deeper signature bytes that order it.
TREES, DEPTH, DEEPER = 32, 3, 8
#: Neighbours of each text, those with the longest common prefixes over all trees.
NEIGHBOURS = 2
#: Leaves of the forest: regions up to this size give all their pairs, a bounded number for each text.
LEAF = 16
#: Words of 64 bits in a bit map of a difference, and in one of all that a pivot's texts outside its component add.
BIT_WORDS, ADDED_WORDS = 8, 1024
#: Up to so many added shingles their bit map tells texts apart; beyond, those that no other text adds are counted too.
CROWDED = BIT_WORDS * 64 // 4
WORDS, PERCENT = 5, 75
_ROWS = TREES * DEPTH
_A = mix(np.arange(1, _ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes; fewer words than a shingle make one."""
    low = _LOWER[data]
    starts, ends, before = spans_of(_WORD[low], offsets)
    hashes = hash_spans(low, starts, ends)
    odd = mix(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    m = max(n - words + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for k in range(words):
        rolled += mix(hashes[k : k + m] + np.uint64(k)) * odd[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(h) * (2 * k + 3) for k, h in enumerate(hashes[a:b].tolist())) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(out, (low[a : a + 2048, None] * _A + high[a : a + 2048, None]).min(axis=0), out=out)
    return out


def _set_hash(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_hashes(*utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(list(map(_set_hash, sets)), pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_hash", "signature"],
        )


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, deeper, id, n_shingles): a row for each tree; `deeper` holds a byte of each of the next signature values."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, _ROWS)
        region, deeper = np.empty((n, TREES), np.uint64), np.empty((n, TREES), np.uint64)
        for t in range(TREES):
            own = np.roll(sig, -t * DEPTH, axis=1)
            key = np.full(n, t, np.uint64)
            for k in range(DEPTH):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
            region[:, t] = key
            bytes_ = (mix(own[:, DEPTH : DEPTH + DEEPER].astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            deeper[:, t] = np.ascontiguousarray(bytes_).view(">u8").reshape(n).astype(np.uint64)
        at = np.repeat(np.arange(n), TREES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.reshape(-1).view(np.int64)), pa.array(deeper.reshape(-1).view(np.int64)), batch.column("id").take(pa.array(at)), batch.column("n_shingles").take(pa.array(at))],
            ["region", "deeper", "id", "n_shingles"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_hashes(*utf8(batch.column("text")))
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(_set_hash, sets)), pa.binary()), lists], ["doc_id", "set_hash", "shingles"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _nearest(members: DataFrame) -> DataFrame:
    """Each text with the NEIGHBOURS texts of the longest common prefixes with it in the sorted orders, as pairs (a, b).

    The depth of a pair is what the signatures about it allow, from a region's to DEPTH + DEEPER.
    Rows are numbered over all partitions, so that no neighbours are apart.
    """
    order = ["region", "deeper", "id"]
    ranked = written(dealt(members.select(order), order, "sorted-trees"), "numbered-trees")
    after = ranked.select("region", F.col("deeper").alias("d"), F.col("id").alias("partner"), (F.col("before") - 1).alias("before"))
    differ = F.col("deeper").bitwiseXOR(F.col("d"))
    common = F.when(differ == 0, DEEPER).otherwise(F.floor((64 - F.length(F.bin(differ))) / 8))
    near = ranked.join(after, ["before", "region"]).where("id != partner").select("id", "partner", (DEPTH + common).cast("long").alias("depth"))
    both = near.unionByName(near.select(F.col("partner").alias("id"), F.col("id").alias("partner"), "depth"))
    scored = both.groupBy("id", "partner").agg(F.sum("depth").alias("depth"))
    lists = scored.groupBy("id").agg(F.collect_list(F.struct("depth", (-F.col("partner")).alias("partner"))).alias("all"))  # at most two a tree
    best = lists.select("id", F.explode(F.slice(F.sort_array("all", asc=False), 1, NEIGHBOURS)).alias("best"))
    return best.select("id", (-F.col("best.partner")).alias("partner")).select(_ordered("id", "partner")).distinct()


def _hubs(members: DataFrame) -> DataFrame:
    """Each text with the most central text of its regions: the likely original of edited copies."""
    rank = F.struct("central", (-F.col("id")).alias("id"))
    hubs = settled(members.groupBy("region").agg(F.max(rank).alias("hub")), "hubs")
    best = members.select("region", "id").join(hubs, "region").where(F.col("hub.id") != -F.col("id")).groupBy("id").agg(F.max("hub").alias("hub"))
    return best.select("id", (-F.col("hub.id")).alias("partner")).select(_ordered("id", "partner"))


def _one(s: F.Column) -> F.Column:
    """A hash's bit in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(63).cast("int"))


def _bits(column: str) -> list[F.Column]:
    """Bit maps of an array of hashes, in words of 64 bits."""
    word = lambda s: F.shiftright(s, 6).bitwiseAND(BIT_WORDS - 1)
    put = lambda k: lambda bits, s: F.when(word(s) == k, bits.bitwiseOR(_one(s))).otherwise(bits)
    return [F.aggregate(column, F.lit(0).cast("long"), put(k)).alias(f"{column}_{k}") for k in range(BIT_WORDS)]


def _common(column: str, size: str) -> list[F.Column]:
    """Upper bounds of how many elements x and y share: each bit that the other lacks is an element that it lacks."""
    own = lambda a, b: sum((F.bit_count(F.col(f"{a}_{column}_{k}").bitwiseAND(F.bitwise_not(f"{b}_{column}_{k}"))) for k in range(BIT_WORDS)), F.lit(0))
    return [F.col(f"x_{size}") - own("x", "y"), F.col(f"y_{size}") - own("y", "x")]


def _met(relation: DataFrame) -> DataFrame:
    """Rows (id, main, met): the added shingles that a text outside the pivot's component may add too.

    Every pair has such a text, so no other shingle is shared in any. Those of texts outside are
    kept whole; those of the main component, however many it has, only where their bit is set.
    """
    outside = relation.where("outside").select("main", F.explode("added").alias("s"))
    part = lambda s: F.shiftright(s, 11).bitwiseAND(ADDED_WORDS // 32 - 1).cast("int")
    word = lambda s: F.shiftright(s, 6).bitwiseAND(31).cast("int")
    words = outside.groupBy("main", part(F.col("s")).alias("part"), word(F.col("s")).alias("word")).agg(F.bit_or(_one(F.col("s"))).alias("bits"))
    parts = words.groupBy("main", "part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0)))
    maps = parts.groupBy("main").agg(F.map_from_entries(F.collect_list(F.struct("part", dense.alias("bits")))).alias("bits"))  # ADDED_WORDS at most
    maps = settled(maps, "added-outside")
    is_set = lambda s: F.get(F.try_element_at("bits", part(s)), word(s)).bitwiseAND(_one(s)) != 0
    return relation.join(maps, "main").select("id", "main", F.filter("added", is_set).alias("met"))


def _shared(relation: DataFrame) -> DataFrame:
    """Rows (main, id, shared) of texts that add more than CROWDED shingles: how many of them another such text may add too.

    Only these have a row for each added shingle. It bounds pairs of two such texts only.
    """
    met = written(_met(relation.where(F.size("added") > CROWDED)), "met")
    alone = met.select("id", "main", F.explode("met").alias("shingle")).groupBy("main", "shingle").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n = 1").groupBy("main", "id").agg(F.count(F.lit(1)).alias("alone"))
    return met.join(alone, ["main", "id"], "left").select("main", "id", (F.size("met") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _across(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that share regions, lie in different components and may be linked.

    In a leaf every such pair counts. A larger region has a pivot, the most central text of its
    main component, and each text is known by its difference from the pivot: shingles that it
    lacks and that it adds, as numbers and as bit maps of their hashes, and where these fill
    their bit map also those that no text it may be compared with adds. The size of the
    difference between two texts is at least what these counts leave, and pairs whose bound
    excludes a link aren't formed.
    """
    known = members.select("region", "size", "id", "n_shingles", "central").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_region = known.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_region.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1").select("region", "main")
    rows = written(known.join(settled(mixed, "mixed-regions"), "region"), "mixed")

    def pairs(table: DataFrame, extra: list[str], condition) -> DataFrame:
        x = table.where("component != main").select("region", *[F.col(c).alias(f"x_{c}") for c in ("id", "n_shingles", "component", *extra)])
        y = table.select("region", *[F.col(c).alias(f"y_{c}") for c in ("id", "n_shingles", "component", *extra)], (F.col("component") == F.col("main")).alias("in_main"))
        low, high = F.least("x_n_shingles", "y_n_shingles"), F.greatest("x_n_shingles", "y_n_shingles")
        apart = (100 * low >= PERCENT * high) & (F.col("x_component") != F.col("y_component")) & (F.col("in_main") | (F.col("x_id") < F.col("y_id")))
        return x.join(y, (x["region"] == y["region"]) & apart & condition).select(_ordered("x_id", "y_id"))

    few = pairs(rows.where(F.col("size") <= LEAF), [], F.lit(True))

    large = rows.where(F.col("size") > LEAF)
    pivots = large.where("component = main").groupBy("main").agg(F.max(F.struct("central", (-F.col("id")).alias("id"))).alias("p")).select("main", (-F.col("p.id")).alias("pivot"))
    relation = written(large.select("id", "main", (F.col("component") != F.col("main")).alias("outside")).distinct().join(settled(pivots, "pivots"), "main"), "texts-and-pivots")
    relation = relation.join(sets.withColumnRenamed("shingles", "x"), "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("p")), "pivot")
    relation = relation.select("id", "main", "outside", F.array_except("p", "x").alias("lacked"), F.array_except("x", "p").alias("added"))
    relation = written(relation.select("id", "main", "outside", "added", F.size("lacked").alias("lacks"), *_bits("lacked"), *_bits("added")), "differences")
    bits = [f"{c}_{k}" for c in ("lacked", "added") for k in range(BIT_WORDS)]
    counts = relation.select("id", "main", "lacks", F.size("added").alias("adds"), *bits).join(_shared(relation), ["main", "id"], "left")
    # by pivot instead of by region, so that a pair which shares many regions is formed once
    each = written(large.select(F.col("main").alias("region"), "main", "id", "n_shingles", "component").distinct(), "pivot-members")
    counts = settled(counts, "difference-counts")
    described = written(each.join(counts.select("id", "main", "lacks", "adds", "shared", *bits), ["id", "main"], "left"), "described")
    shared = F.when(F.col("x_shared").isNotNull() & F.col("y_shared").isNotNull(), F.least("x_shared", "y_shared"))
    both = F.least(*_common("lacked", "lacks")) + F.least(shared, *_common("added", "adds"))
    apart = F.col("x_lacks") + F.col("x_adds") + F.col("y_lacks") + F.col("y_adds") - 2 * both
    may = (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("x_n_shingles") + F.col("y_n_shingles"))
    many = pairs(described, ["lacks", "adds", "shared", *bits], F.coalesce(may, F.lit(True)))
    return few.unionByName(many).distinct()


def _named(given: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (set_hash, component_id): the component of each distinct set."""
    # classes are numbered by their smallest doc_id: the least number of a component is that of its smallest document
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(dealt(classes, ["doc_id", "set_hash"], "sorted-classes").withColumnRenamed("before", "id"), "classes")

    trees = classes.mapInArrow(_tree_rows, "region long, deeper long, id long, n_shingles long")
    shared = trees.groupBy("region").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high").select("region", "size")
    shared = settled(shared, "shared-regions")
    members = written(trees.join(shared, "region"), "regions")
    linked = settled(classes.select("id", "doc_id", "set_hash").join(members.select("id").distinct(), "id", "left_semi"), "linked-classes")
    found = given.join(linked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set_hash binary, shingles array<long>")
    sets = found.join(linked, ["doc_id", "set_hash"]).groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = written(sets, "sets")
    central = settled(members.groupBy("id").agg(F.sum("size").alias("central")), "central")
    members = written(members.join(central, "id"), "central-regions")

    first = _nearest(members).unionByName(_hubs(members)).distinct()
    named = classes.select("set_hash", "id")
    texts = known.join(named, "set_hash").groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    same = texts.select("a", F.explode("ids").alias("b")).where("a != b")  # the texts of one document
    links = written(confirmed(first, sets).unionByName(same), "links")
    found = written(components(links), "components")
    more = written(confirmed(_across(members, found, sets), sets), "more-links")
    named = classes.select("set_hash", "id").join(found, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    if more.head(1):  # only components, and no longer their texts, are to be merged
        for end in ("a", "b"):
            more = more.join(found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in")), end, "left").withColumn(end, F.coalesce(f"{end}_in", end)).drop(f"{end}_in")
        merged = written(components(more), "merged").select(F.col("id").alias("component"), F.col("component").alias("merged"))
        named = named.join(merged, "component", "left").select("set_hash", F.coalesce("merged", "component").alias("component"))
    least = classes.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
    return named.join(least, "component").select("set_hash", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of `docs`.

    Sets of equal shingles are one class from the start, so copies cost one row. A null or
    empty text has no shingles and links with nothing. Rows that repeat a doc_id are one
    document with the links of all its texts; a row with a null doc_id is never linked and is
    kept. Other columns are ignored; an empty table gives no rows. Texts of any length are
    read whole. Within a region the work is linear in its rows, but for texts that share
    large regions without being linked: where the bound can't exclude them, their pairs are compared.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(given.mapInArrow(_signatures, "doc_id long, n_shingles long, set_hash binary, signature binary"), "signatures")
    known = rows.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    named = finished(lambda: _named(given, known), "classes-named")
    linked = known.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("set_hash IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
