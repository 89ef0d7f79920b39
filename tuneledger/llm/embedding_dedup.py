"""Links between embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least ``c`` are at most ``2 - 2c`` apart, squared. A rotation, the same for all
vectors, spreads them over all coordinates, which are then split into blocks of few dimensions, each with a
share of the squared distance in proportion to its dimensions. Two linked vectors stay within the share in
one block at least. Each block is joined by range: signs of some of its coordinates make a cell, and a vector
visits every cell that its ball reaches, that is, where the squares of the coordinates whose sign it changes
add up to no more than the share. Only cells of a higher number are visited, so a pair meets once per block.

A group of a block, a cell and a chunk of its vectors and visitors is compared in one task by matrix products:
first the distance in the block, then, for those that pass, the cosine of the whole vectors in double
precision. A pair counts in the first block that brings it together. No pair leaves the task: a group returns
how many links each vector got, and as many links as connect what it found connected. Cells of any size are
cut into chunks on both sides, so a cell that holds a third of all vectors is spread over many groups.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, links with
nothing; vectors of different lengths link with nothing of the other length; equal vectors are linked; rows
that repeat an id are vectors of their own, which count as links and share a component; a null id is counted
but never a component; an empty table stays empty. Only the two named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneledger.llm.components import components

COSINE = 0.95
#: Dimensions of a block; vectors a cell has on average; vectors of a cell that one group compares with as many others.
BLOCK, CELL, CHUNK = 8, 2048, 4096
#: Vectors of a chunk whose distances are computed together.
STRIP = 512
#: Widening of the ranges against rounding.
SLACK = 1e-9

ROWS = "width int, block int, cell int, home boolean, row long, vector binary"


def rotation(width: int) -> np.ndarray:
    """A fixed random rotation of this many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def blocks(width: int) -> list[slice]:
    """Blocks of about ``BLOCK`` dimensions that cover all."""
    edges = np.linspace(0, width, max(1, round(width / BLOCK)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def shares(width: int, cosine: float) -> np.ndarray:
    """Squared distance of each block, in proportion to its dimensions."""
    return (2 - 2 * cosine) * np.array([b.stop - b.start for b in blocks(width)]) / width + SLACK


def _valid(vector: np.ndarray | None) -> bool:
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool(vector.any())


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision of vectors stored as ``kind``."""
    vectors = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares of tiny and huge values finite
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _visits(vectors: DataFrame, cosine: float, signs: int, kind: str, whole: bool = True) -> DataFrame:
    """A row for the cell of every vector and block, and one for each further cell that it visits; without vectors if not ``whole``."""
    names = ["width", "block", "cell", "home", "row", "vector"][:6 if whole else 4]
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[tuple[int, bytes]]] = {}
            for row, raw in zip(batch["row"].to_pylist(), batch["vector"].to_pylist()):
                by_width.setdefault(len(raw) // np.dtype(kind).itemsize, []).append((row, raw))
            for width, some in by_width.items():
                ids, raw = np.array([r for r, _ in some]), np.array([v for _, v in some], dtype=object)
                turned = _units(list(raw), kind) @ rotation(width)
                for number, (block, share) in enumerate(zip(blocks(width), shares(width, cosine))):
                    part = turned[:, block][:, :signs]
                    used = part.shape[1]
                    power = 1 << np.arange(used)
                    cell = (part > 0) @ power
                    found = [(np.arange(len(ids)), cell, True)]
                    for change in itertools.chain.from_iterable(
                            itertools.combinations(range(used), n) for n in range(1, used + 1)):
                        to = cell ^ int(power[list(change)].sum())
                        reached = np.flatnonzero(((part[:, change] ** 2).sum(axis=1) <= share) & (to > cell))
                        if len(reached):
                            found.append((reached, to[reached], False))
                    for who, cells, home in found:
                        n = len(who)
                        columns = [pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, number, np.int32)),
                                   pa.array(cells.astype(np.int32)), pa.array(np.full(n, home))]
                        if whole:
                            columns += [pa.array(ids[who]), pa.array(raw[who].tolist(), pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(rows, ROWS if whole else ROWS.rpartition(", row")[0])


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect: at most one per vector."""
    name = np.arange(n)

    def root(i: int) -> int:
        while name[i] != i:
            name[i] = name[name[i]]
            i = name[i]
        return i

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            name[max(x, y)] = min(x, y)
            kept.append((int(a), int(b)))
    return kept


def _linked(left: np.ndarray, right: np.ndarray, number: int, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs that this block is the first to bring together."""
    width = left.shape[1]
    turn, parts, share = rotation(width), blocks(width), shares(width, cosine)
    a, b = left @ turn, right @ turn
    x, y = a[:, parts[number]], b[:, parts[number]]
    found = []
    for at in range(0, len(x), STRIP):
        strip = x[at:at + STRIP]
        apart = (strip * strip).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * strip @ y.T
        i, j = np.nonzero(apart <= share[number] + SLACK)
        i += at
        found.append((i[i < j], j[i < j]) if same else (i, j))
    i, j = (np.concatenate(side) for side in zip(*found))
    linked_i, linked_j = [], []
    for at in range(0, len(i), 1 << 16):
        some, other = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        good = (left[some] * right[other]).sum(axis=1) >= cosine
        some, other = some[good], other[good]
        first = np.ones(len(some), bool)
        for earlier in range(number):
            # The same products and the same bound as above, so every block decides alike wherever the pair meets.
            x, y = a[some][:, parts[earlier]], b[other][:, parts[earlier]]
            first &= ((x - y) ** 2).sum(axis=1) > share[earlier]
        linked_i.append(some[first])
        linked_j.append(other[first])
    return np.concatenate(linked_i or [i]), np.concatenate(linked_j or [j])


def _compare(cosine: float, kind: str):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        home = rows[rows["home"]].drop_duplicates("row")
        other = rows[~rows["home"]].drop_duplicates("row")
        number, counts, links = int(rows["block"].iloc[0]), {}, []
        sides = [(home, home, True)] if rows["pair"].iloc[0] else []
        if not sides or len(other):
            sides.append((home, other, False))
        for one, two, same in sides:
            if one.empty or two.empty:
                continue
            left, right = one["row"].to_numpy(), two["row"].to_numpy()
            i, j = _linked(_units(list(one["vector"]), kind), _units(list(two["vector"]), kind), number, same, cosine)
            for side, at in ((left, i), (right, j)):
                for place, n in zip(*np.unique(at, return_counts=True)):
                    counts[side[place]] = counts.get(side[place], 0) + int(n)
            joint = _spanning(np.stack([i, j + len(left) * (not same)], axis=1), len(left) + len(right))
            every = left if same else np.concatenate([left, right])
            links += [(every[a], every[b]) for a, b in joint]
        return pd.DataFrame({"a": [*counts, *[a for a, _ in links]], "b": [*[-1] * len(counts), *[b for _, b in links]],
                             "n": [*counts.values(), *[0] * len(links)]}).astype("int64")

    return group


def classes(spark: SparkSession, vectors: DataFrame, fresh_dir: Callable[[SparkSession, str], str], key: str = "vec_id",
            vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``."""
    def stored(frame: DataFrame, label: str) -> DataFrame:
        folder = fresh_dir(spark, label)
        frame.write.parquet(folder)
        return spark.read.schema(frame.schema).parquet(folder)

    kind = "<f4" if vectors.schema[vector].dataType.jsonValue().get("elementType") == "float" else "<f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for one in batch["vector"]:
                values = one.as_py()
                found = np.array(values, kind) if values and None not in values else None
                raw.append(found.tobytes() if _valid(found) else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["row"], pa.array(raw, pa.binary())], ["vec_id", "row", "vector"])

    numbered = vectors.select(F.col(key).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
                              F.col(vector).alias("vector"))
    every = stored(numbered.mapInArrow(read, "vec_id long, row long, vector binary"), "vectors")
    usable = every.where("vector IS NOT NULL")
    n = usable.count()
    signs = min(BLOCK, max(1, math.ceil(math.log2(max(1, n) / CELL))))
    # Made twice rather than stored: once as counts, once with the vectors.
    visits = _visits(usable.select("row", "vector"), cosine, signs, kind)
    cell = ["width", "block", "cell"]
    sizes = _visits(usable.select("row", "vector"), cosine, signs, kind, whole=False).groupBy(*cell).agg(F.ceil(F.sum(F.col("home").cast("long")) / CHUNK).cast("int").alias("homes"),
                                      F.ceil(F.sum((~F.col("home")).cast("long")) / CHUNK).cast("int").alias("others"))
    sized = visits.join(F.broadcast(sizes), cell)  # at most 2**BLOCK cells for a block of a width
    # Chunk pairs of a cell: homes with homes of a chunk not before their own, and homes with visitors.
    chunk = F.pmod(F.xxhash64("row"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int")
    sized = sized.where("homes > 0").withColumn("chunk", chunk)
    own = F.col("chunk")
    to_homes = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: F.struct(
        F.least(own, k).alias("one"), F.greatest(own, k).alias("two"), F.lit(True).alias("among"), (own <= k).alias("left")))
    to_others = F.when(F.col("others") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("others"), F.lit(1)) - 1), lambda k: F.struct(
        own.alias("one"), k.alias("two"), F.lit(False).alias("among"), F.lit(True).alias("left")))).otherwise(
        F.expr("array()").cast("array<struct<one:int,two:int,among:boolean,left:boolean>>"))
    of_other = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: F.struct(
        k.alias("one"), own.alias("two"), F.lit(False).alias("among"), F.lit(False).alias("left")))
    dealt = sized.withColumn("meeting", F.explode(F.when(F.col("home"), F.concat(to_homes, to_others)).otherwise(of_other)))
    dealt = dealt.select(*cell, "row", "vector", "meeting.*").withColumn("pair", F.col("among") & (F.col("one") == F.col("two")))
    dealt = dealt.withColumnRenamed("left", "home")
    schema = "a long, b long, n long"
    found = stored(dealt.groupBy(*cell, "one", "two", "among").applyInPandas(_compare(cosine, kind), schema), "found")
    counts = found.where("b < 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
    joint = components(spark, found.where("b >= 0").select("a", "b"), fresh_dir)
    named = stored(every.select("vec_id", "row").join(joint.withColumnRenamed("node", "row"), "row", "left").join(
        counts, "row", "left").select("vec_id", "row", F.coalesce("component", "row").alias("of"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    # Components are of rows; each takes the least id of its vectors.
    least = named.groupBy("of").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "of").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                                          F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
