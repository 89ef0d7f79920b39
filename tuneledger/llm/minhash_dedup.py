"""Near-duplicates by word shingles: fast similarity sketches, banding, exact verification.

A sketch has ``bins`` coordinates. In round after round every shingle is thrown into one bin by a hash of the
round, until all bins hold something; from round ``bins`` on, each round fills one given bin, so that no
coordinate stays empty however few shingles there are. A bin keeps its least value, where an earlier round
counts as less. Two sets agree in a coordinate with the probability of their similarity, and the share of
agreeing coordinates is as concentrated as for independent ones, at a cost that does not grow with the product
of shingles and coordinates. Coordinates are banded so that a pair at the threshold fails to share a band with
a probability below ``MISSED``.

Documents with equal sets are one class, named by 64 bits of the set's digest. Pairs are not listed within a bucket.
First the least class of a bucket, its leader, is compared with all others, and the components of the links found
are computed. Then only classes of different components can matter; buckets with the same leader are one group.
Classes that can have no link are left out: similar sets share so many shingles that a class with too many of its
own, which no other class in question holds, is similar to none. The others are seen as differences D(x) = x ^ C
to the group's centre C, the shingles that most of some of its members hold. With q = (100 - percent) / (100 + percent),
x and y are similar if and only if |x ^ y| <= q(|x| + |y|). Let e(x) = |D(x)| - q|x|. As |x ^ y| <= |D(x)| + |D(y)|,
classes with e(x) + e(y) <= 0 are linked; this links many with the class of the least e, the hub. Where the sum is
above zero, a link needs (e(x) + e(y)) / 2 shingles in both D(x) and D(y). So it is enough to join the rarest shingles
of D, all but that number less one: every link meets there, while passages that the group has in common are in no D.
This takes sums over shingles and is exact, whatever the centre. Pairs whose sizes or sketch bits are too
unlike for the threshold are ruled out within the joins. Links that meet are confirmed on whole sets of 64-bit
shingle hashes. Every link of two classes that share a band is thus found or implied by components.

Defined results: words are cut at ASCII white space and A-Z are lower-cased; a text with fewer words than a
shingle is one shingle, a text without words or a null text has none and links with nothing; rows that repeat a
key stay several rows, each in the component of its own text, and components of different texts may have an id in
common; a null key links with nothing and is kept; an empty table stays empty. Only the two named columns
are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tuneledger.llm.components import components
from tuneledger.llm.held import held

SHINGLE, PERCENT = 5, 80
#: Coordinates of a band, and the greatest probability that a pair at the threshold shares no band.
BAND, MISSED = 5, 1e-6
#: Coordinates of which one bit each is compared before sets are, and the greatest probability that a pair at the
#: threshold differs in more of these bits than ``most_unlike`` allows.
BITS, UNLIKE = 512, 1e-9
#: Times that classes with too many shingles of their own are looked for; leaving some out gives others more of their own.
PRUNED = 2
#: Members of a group whose common shingles are its centre; the result does not depend on it.
CENTRAL = 15
#: Columns of 64 such bits each.
BIT_COLUMNS = [f"bits_{k}" for k in range(BITS // 64)]
#: Words whose hashes a worker keeps; at more it starts anew.
KEPT_WORDS = 500_000
#: Shingles and coordinates that are worked on together.
THROWN = 400_000

SKETCHED = ", ".join(f"{c} long" for c in ("doc_id", "copy", "n_shingles", "set_a", "set_b", *BIT_COLUMNS)) + ", bands array<long>"
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def n_bands(percent: int) -> int:
    """Bands so that a pair of this similarity shares one but for a probability of ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** BAND))


def most_unlike(percent: int) -> int:
    """Bits in which two sketches may differ: the tail of a binomial distribution, as coordinates are as concentrated.

    Coordinates of a pair at the threshold differ with a probability of one minus the threshold, their bits with half of it.
    """
    n, p = BITS, (1 - percent / 100) / 2
    tail, most = 0.0, n
    while most > 0 and tail + (at := math.comb(n, most) * p**most * (1 - p) ** (n - most)) < UNLIKE:
        tail, most = tail + at, most - 1
    return most


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text: sorted 64-bit hashes of its shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    kept = held("words of shingles", dict)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    try:
        hashes = [kept[w] for w in words]
    except KeyError:
        for w in words:
            if w not in kept:
                kept[w] = xxhash.xxh64_intdigest(w)
        hashes = [kept[w] for w in words]
    h = np.array(hashes, np.uint64)
    length = min(size, len(h))
    with np.errstate(over="ignore"):
        rolled = np.full(len(h) - length + 1, length, np.uint64)
        for k in range(length):
            rolled = _mixed(rolled * np.uint64(0x9FB21C651E98DF25) + h[k:len(h) - length + 1 + k], 7)
    return np.unique(rolled)


def _digest(one: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.frombuffer(xxhash.xxh3_128_digest(one.tobytes()), np.int64)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The sketches of several sets, one row each; an empty set's row is full of the greatest value."""
    found = np.full((len(sets), bins), _FULL, np.uint64)
    flat = found.reshape(-1)
    live = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(live):
        return found
    elements = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, [len(sets[i]) for i in live])
    open_bins = np.full(len(sets), bins)
    for number in range(2 * bins):
        thrown = _mixed(elements, number)
        into = (thrown % np.uint64(bins)).astype(np.int64) if number < bins else number - bins
        value = np.uint64(number << 52) | (_mixed(thrown, 3) >> np.uint64(12))
        np.minimum.at(flat, owner * bins + into, value)
        if number % 8 == 7:
            open_bins[live] = (found[live] == _FULL).sum(axis=1)
            live = live[open_bins[live] > 0]
            if not len(live):
                break
            wanted = open_bins[owner] > 0
            elements, owner = elements[wanted], owner[wanted]
    return found


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row; the band's number is part of the key."""
    rows, bins = sketch.shape
    parts = sketch.reshape(rows, bins // BAND, BAND)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bins // BAND + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(BAND):
            key = _mixed(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k], 11)
    return key


def sketched(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """A hash of the text, set size, a 128-bit digest of the set, and band keys of every document."""
    banded = n_bands(percent) * BAND
    bins = max(BITS, banded)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(ids: list, copies: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            sketch = sketches(sets, bins)
            keys = bands_of(sketch[:, :banded]).view(np.int64)
            bits = np.packbits((sketch[:, :BITS] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            digests = [_digest(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 *[pa.array(bits[:, k]) for k in range(len(BIT_COLUMNS))],
                 pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                ["doc_id", "copy", "n_shingles", "set_a", "set_b", *BIT_COLUMNS, "bands"])

        ids, copies, sets, size = [], [], [], 0
        for batch in batches:
            for i, c, t in zip(*(batch[n].to_pylist() for n in ("doc_id", "copy", "text"))):
                ids.append(i)
                copies.append(c)
                sets.append(shingles(t))
                size += len(sets[-1]) + bins
                if size > THROWN:
                    yield closed(ids, copies, sets)
                    ids, copies, sets, size = [], [], [], 0
        if ids:
            yield closed(ids, copies, sets)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text")).mapInArrow(rows, SKETCHED)


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``id, hashes``: the whole set of each wanted class ``id, least, set_a, set_b`` as bytes, read again from its text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, t, a, b in zip(*(batch[c].to_pylist() for c in ("id", "text", "set_a", "set_b"))):
                one = shingles(t)
                if _digest(one).tolist() == [a, b]:
                    ids.append(i)
                    found.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "hashes"])

    texts = docs.select(F.col(key).cast("long").alias("least"), F.col(text).alias("text"))
    return texts.join(wanted, "least").select("id", "text", "set_a", "set_b").mapInArrow(
        rows, "id long, hashes binary").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last, first = [], None, None
            for i, (a, x, y) in enumerate(zip(batch["a"].to_pylist(), batch["x"], batch["y"])):
                if a != last:
                    last, first = a, np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(first, other), len(first) - 1)
                both = int((first[at] == other).sum())
                if 100 * both >= percent * (len(first) + len(other) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(kept, pa.int64())) for c in ("a", "b")], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def _own(sets: DataFrame) -> DataFrame:
    """``id, own``: how many shingles of a class no other class of ``sets`` has; classes without such are absent."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(f) for f in found])),
                                               pa.array(np.concatenate(found))], ["id", "hash"])

        ids, found, size = [], [], 0
        for batch in batches:
            for i, x in zip(batch["id"].to_pylist(), batch["hashes"]):
                ids.append(i)
                found.append(np.frombuffer(x.as_buffer(), np.int64))
                size += len(found[-1])
                if size > THROWN:
                    yield closed(ids, found)
                    ids, found, size = [], [], 0
        if ids:
            yield closed(ids, found)

    held = sets.select("id", "hashes").mapInArrow(rows, "id long, hash long")
    once = held.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id")).where("m = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def may_link(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``members`` (``bucket, id, n, ...``) whose class can be similar to another class in one of its buckets.

    Sets of sizes n and m at the threshold share at least percent / (100 + percent) of n + m shingles, and m is no less
    than the least size in the bucket, nor than percent of n.
    """
    least = members.groupBy("bucket").agg(F.min("n").alias("m"))
    ids = members.join(least, "bucket").groupBy("id").agg(F.first("n").alias("n"), F.min("m").alias("m"))
    own = _own(sets.join(ids.select("id"), "id", "left_semi"))
    able = ids.join(own, "id", "left").where(
        f"100 * (100 + {percent}) * (n - coalesce(own, 0)) >= {percent} * (100 * n + greatest({percent} * n, 100 * m))")
    return members.join(able.select("id"), "id", "left_semi")


def _centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``bucket, centre``: the shingles that more than half of ``CENTRAL`` members of a group hold. Any set would do; a common one is best."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, held in zip(batch["bucket"].to_pylist(), batch["held"].to_pylist()):
                hashes, times = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in held]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array(
                    [hashes[2 * times > len(held)].tobytes()], pa.binary())], ["bucket", "centre"])

    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("id"), "id"))
    some = members.select("bucket", "id").withColumn("place", place).where(F.col("place") <= CENTRAL)
    return some.join(sets, "id").groupBy("bucket").agg(F.collect_list("hashes").alias("held")).mapInArrow(rows, "bucket long, centre binary")


def apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``bucket, id, e, differs``: what sets each class of ``members`` (``bucket, id``) apart from its group's centre, and e(x) times 100 + percent."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, centre, found, e = None, np.empty(0, np.uint64), [], []
            for bucket, c, x in zip(batch["bucket"].to_pylist(), batch["centre"], batch["hashes"]):
                if bucket != last:
                    last, centre = bucket, np.frombuffer(c.as_buffer(), np.uint64)
                one = np.frombuffer(x.as_buffer(), np.uint64)
                found.append(np.setxor1d(centre, one, assume_unique=True).view(np.int64))
                e.append((100 + percent) * len(found[-1]) - (100 - percent) * len(one))
            yield pa.RecordBatch.from_arrays([batch["bucket"], batch["id"], pa.array(e, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                             ["bucket", "id", "e", "differs"])

    return members.select("bucket", "id").join(sets, "id").join(_centres(members, sets), "bucket").select(
        "bucket", "id", "centre", "hashes").mapInArrow(rows, "bucket long, id long, e long, differs array<long>")


def hubs(found: DataFrame) -> DataFrame:
    """``bucket, hub, least``: the class of the least e of a group, and its e."""
    return found.groupBy("bucket").agg(F.min(F.struct("e", "id")).alias("least")).select("bucket", F.col("least.id").alias("hub"), F.col("least.e").alias("least"))


def meeting(found: DataFrame, hub: DataFrame, percent: int) -> DataFrame:
    """Rows ``bucket, id, hash, e, size, place, far, among, alone`` of the shingles where links of classes that are far can meet.

    A class is far if e does not link it with the hub; others are in one component with each other. ``place`` counts the shingles of
    D from the rarest of the group. Those marked ``among`` are enough to meet classes that are far; a far class meets others among
    those marked ``alone``. Shingles that only one class of the group has are left out.
    """
    twice = 2 * (100 + percent)
    numbered = found.join(hub, "bucket").withColumn("size", F.size("differs")).withColumn("far", F.expr("e + least > 0"))
    alone = F.expr(f"IF(far, size + 1 - greatest(1, (e + least + {twice - 1}) div {twice}), 0)")
    reach = numbered.withColumn("alone", alone).withColumn("among", F.expr(f"IF(least > 0, alone, size - (e - least) div {twice})"))
    rows = reach.select("bucket", "id", "e", "size", "far", "alone", "among", F.explode("differs").alias("hash"))
    counted = rows.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("bucket", "hash")))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "id").orderBy("held", "hash")))
    return placed.where("held > 1 AND place <= greatest(among, alone)").select(
        "bucket", "id", "hash", "e", "size", "place", "far", F.expr("place <= among").alias("among"), F.expr("place <= alone").alias("alone"))


def meets(percent: int) -> str:
    """Whether the shingle of two rows of ``meeting`` is early enough in both to be the first of as many as a link needs."""
    twice = 2 * (100 + percent)
    return f"greatest(place - size, place_one - size_one) + (e + e_one + {twice - 1}) div {twice} <= 1"


def classes(spark: SparkSession, docs: DataFrame, fresh_dir: Callable[[SparkSession, str], str], key: str = "doc_id",
            text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    return _labelled(spark, docs, fresh_dir, key, text, percent).select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labelled(spark: SparkSession, docs: DataFrame, fresh_dir: Callable[[SparkSession, str], str], key: str, text: str,
              percent: int) -> DataFrame:
    """Per document: ``doc_id, copy, set_a, set_b, n_shingles, label, component_id``; ``label`` names the component."""
    def stored(frame: DataFrame, label: str) -> DataFrame:
        folder = fresh_dir(spark, label)
        frame.write.parquet(folder)
        return spark.read.schema(frame.schema).parquet(folder)

    found = stored(sketched(docs, key, text, percent), "sketches")
    filled = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("least"))
    keyed = filled.select("doc_id", "set_a", "set_b", "n_shingles", *BIT_COLUMNS, "bands").join(least, ["set_a", "set_b", "n_shingles"])
    # A class is named by its set, as an id may be the least of several.
    chosen = keyed.where("doc_id = least").groupBy(F.col("set_a").alias("id")).agg(F.min(
        F.struct("set_a", "set_b", "n_shingles", "least", *BIT_COLUMNS, "bands")).alias("of"))
    bands = stored(chosen.select("id", "of.least", "of.set_a", "of.set_b", F.col("of.n_shingles").alias("n"),
                                 *[f"of.{c}" for c in BIT_COLUMNS], F.col("of.bands").alias("bands")), "classes")
    ids, told = bands.select("id", "least", "set_a", "set_b"), bands.select("id", "n", *BIT_COLUMNS)
    bands = bands.select("id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("leader")).where("m > 1")
    members = stored(bands.join(shared, "bucket").select("bucket", "id", "leader").join(told, "id"), "buckets")
    sets = stored(_sets(docs, key, text, ids.join(members.select("id").distinct(), "id", "left_semi")), "sets")
    columns, limit = ("n", *BIT_COLUMNS), most_unlike(percent)
    unlike = " + ".join(f"bit_count({c} ^ {c}_one)" for c in BIT_COLUMNS)
    alike = f"100 * least(n, n_one) >= {percent} * greatest(n, n_one) AND {unlike} <= {limit}"

    def as_one(frame: DataFrame, *more: str) -> DataFrame:
        return frame.select(F.col("bucket").alias("shared"), F.col("id").alias("one"), *[F.col(c).alias(f"{c}_one") for c in (*columns, *more)])

    def confirmed(met: DataFrame) -> DataFrame:
        pairs = met.select(F.least("one", "id").alias("a"), F.greatest("one", "id").alias("b")).distinct()
        return stored(_confirmed(pairs, sets, percent), "links")

    def unsettled(named: DataFrame) -> DataFrame:
        """The groups that hold classes of several components."""
        parts = named.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        return named.join(parts.select("bucket"), "bucket")

    links = confirmed(as_one(members.where("id = leader")).join(members, F.expr(f"bucket = shared AND id <> one AND {alike}")))
    labels = components(spark, links, fresh_dir)
    # Buckets with the same leader are one group from here on, named by the leader.
    grouped = members.select(F.col("leader").alias("bucket"), "id", *columns).distinct()
    named = grouped.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = stored(unsettled(named), "groups")
    for _ in range(PRUNED):
        left = stored(unsettled(may_link(left, sets, percent)), "groups")
    if not left.isEmpty():
        found_apart = stored(apart(left, sets, percent), "apart")
        hub = stored(hubs(found_apart), "hubs")
        near = found_apart.join(hub, "bucket").where("id <> hub AND e + least <= 0")
        links = links.union(stored(near.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "links"))
        labels = components(spark, links, fresh_dir)
        renamed = left.drop("component").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        left = stored(unsettled(renamed), "groups")
        # A pair meets in several groups; the least of those they share is where it is compared.
        told = left.join(left.groupBy("id").agg(F.collect_list("bucket").alias("groups")), "id")
        there = found_apart.join(left.select("bucket", "id"), ["bucket", "id"])
        rows = stored(meeting(there, hub, percent).join(told, ["bucket", "id"]), "meeting")
        far, other = rows.where("far"), rows.where("NOT far AND among")
        once = (f"bucket = shared AND hash = hash_one AND component <> component_one AND {meets(percent)} AND {alike} AND "
                "array_min(array_intersect(groups, groups_one)) = bucket")
        more = ("hash", "component", "groups", "e", "size", "place")
        both = as_one(far.where("among"), *more).join(far.where("among"), F.expr(f"{once} AND id > one"))
        one = as_one(other, *more).join(far.where("alone"), F.expr(once))
        found_links = confirmed(both.select("one", "id").union(one.select("one", "id")))
        if not found_links.isEmpty():
            labels = components(spark, links.union(found_links), fresh_dir)
    # A document's class is its set; a component has the id of its least document.
    of = least.join(labels.withColumnRenamed("node", "set_a"), "set_a", "left").withColumn("label", F.coalesce("component", "set_a")).drop("component")
    names = of.groupBy("label").agg(F.min("least").alias("named"))
    rows = found.join(of.join(names, "label").drop("least"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("named", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "copy", "set_a", "set_b", "n_shingles", "label",
                       F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, fresh_dir: Callable[[SparkSession, str], str], key: str = "doc_id",
             text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, but of each component only one row: of the least id, then of the least set."""
    folder = fresh_dir(spark, "rows")
    linked = _labelled(spark, docs, fresh_dir, key, text, percent).where("n_shingles > 0 AND doc_id IS NOT NULL")
    linked.groupBy("label", "doc_id", "set_a", "set_b", "copy").agg(F.count(F.lit(1)).alias("times")).write.parquet(folder)
    linked = spark.read.parquet(folder)
    row = F.struct("doc_id", "set_a", "set_b", "copy")
    first = linked.groupBy("label").agg(F.min(row).alias("first"))
    judged = linked.join(first, "label").select(F.col("doc_id").alias("_key"), F.col("copy").alias("_copy"), (row == F.col("first")).alias("_first"), "times")
    same = (F.col(key).cast("long") == F.col("_key")) & (F.xxhash64(text) == F.col("_copy"))
    kept = docs.join(judged.where("NOT _first"), same, "left_anti")
    repeated = judged.where("_first AND times > 1")
    if repeated.isEmpty():
        return kept
    names = docs.columns
    once = docs.join(repeated, same).dropDuplicates(["_key", "_copy"]).select(*[docs[c] for c in names])
    return kept.join(repeated, same, "left_anti").union(once)
