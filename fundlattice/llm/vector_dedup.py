"""Near duplicates among embeddings: an exact metric range join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, unstash
from .graph import components
from .neighbours import usable

#: Pivots at most; they are all that the driver holds.
MOST_PIVOTS = 4_096
#: Rows of a cell that one task compares with as many others, and rows that meet all pivots at once.
BLOCK, AT_ONCE = 2_048, 256


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all unit rows of x from all unit rows of y."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def cosines(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Cosines of all rows of x with all of y; those within rounding of `least` are taken pair by pair."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    c = (x @ y.T) / nx[:, None] / ny[None]
    i, j = np.nonzero(np.abs(c - least) < 1e-9)
    c[i, j] = (x[i] * y[j]).sum(axis=1) / (nx[i] * ny[j])
    return c


def roots_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in the component of each of n indices, for pairs (i, j)."""
    root = np.arange(n)
    while True:
        low, fresh = np.minimum(root[i], root[j]), root.copy()
        for side in (i, j, root[i], root[j]):
            np.minimum.at(fresh, side, low)
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, root):
            return root
        root = fresh


def places(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(home, cells) of each unit row: the nearest pivot, and every cell that may hold a row within r, home included.

    For y at home with pivot c and |x - y| <= r: |x - c| <= |y - c| + r <= |y - h| + r <= |x - h| + 2 r, and
    the plane between c and x's own pivot h is at most r from x.
    """
    d = distances(x, pivots)
    home = d.argmin(axis=1)
    own, apart = d[np.arange(len(x)), home], distances(pivots, pivots)[home]
    near = (d <= own[:, None] + 2 * r + 1e-9) & (d * d - (own * own)[:, None] <= 2 * r * apart + 1e-9)
    near[np.arange(len(x)), home] = True
    return home, [np.flatnonzero(row) for row in near]


def link(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links between rows of one group whose vectors' cosine is at least `least`.

    Unit vectors of such pairs are at most r = sqrt(2 - 2 least) apart. Equal vectors of a group are one
    class with a weight. A class is at home in its nearest pivot's cell and visits the cells that the
    triangle inequality leaves open (see places). A cell compares all that are in it with those at home
    there, so each ordered pair meets once; large cells do so in blocks of `block` rows. Blocks give counts
    and a spanning forest of their links, never the pairs. Pivots are classes with small hashes: about one
    for each `block` rows of the largest group, at most MOST_PIVOTS; beyond, cells grow, and with them the number of their
    blocks, never a block.

    Returns a row for every row of vectors: id_col, n_links, component_id, kept. Rows that are unusable (see
    neighbours.usable) or have a null group have no links and are their own component; a row with a null id
    too, and its component_id is null. Equal rows, also with one id, are linked with each other. Vectors of unequal
    numbers of components are not compared.
    """
    r = float(np.sqrt(2 - 2 * least))
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.col(group_col).alias("g"))
    rows = rows.withColumn("good", usable(F.col("v")) & F.col("g").isNotNull() & F.col("id").isNotNull())
    classes = stash(rows.where("good").groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("w")).withColumns({"class": F.monotonically_increasing_id(), "size": F.size("v")}), "classes")
    sizes = classes.groupBy("size", "g").count().groupBy("size").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.lit(pivots) if pivots else F.ceil(F.col("most") / block))
    drawn = classes.select("size", "v", F.pmod(F.xxhash64("id", "class"), F.lit(1 << 40)).alias("h"))
    share = sizes.select("size", (wanted / F.col("all") * (1 << 40)).alias("below"))
    some = drawn.join(F.broadcast(share), "size").where("h < below").select("size", "v")  # one row for each number of components
    one = drawn.groupBy("size").agg(F.min_by("v", "h").alias("v"))
    centres: dict[int, list[np.ndarray]] = {}
    for size, v in zip(*(c.to_pylist() if n else c.to_numpy() for n, c in enumerate(some.unionAll(one).distinct().toArrow().columns))):
        centres.setdefault(int(size), []).append(np.array(v, np.float64))
    units = {size: np.array(c) / np.sqrt((np.array(c) ** 2).sum(axis=1))[:, None] for size, c in centres.items()}

    def place(batches):
        for pdf in batches:
            for size, same in pdf.groupby("size"):
                for at in range(0, len(same), AT_ONCE):
                    part = same[at : at + AT_ONCE]
                    x = np.stack(part["v"].to_list()).astype(np.float64)
                    home, cells = places(x / np.sqrt((x * x).sum(axis=1))[:, None], units[int(size)], r)
                    yield part.assign(home=home.astype(np.int32), cells=cells)

    kind = f"g {rows.schema['g'].dataType.simpleString()}, v array<double>, id long, w long, class long, size int"
    placed = stash(classes.mapInPandas(place, kind + ", home int, cells array<int>"), "placed")
    visits = placed.select("g", "size", "home", F.explode("cells").alias("cell"))
    held = visits.groupBy("g", "size", "cell").agg(F.count("*").alias("n"), F.count_if(F.col("home") == F.col("cell")).alias("n_home")).where("n_home > 0")
    held = held.select("g", "size", "cell", F.ceil(F.col("n") / block).cast("int").alias("n_left"), F.ceil(F.col("n_home") / block).cast("int").alias("n_right"))
    part = lambda salt, n: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.select("g", "size", "v", "id", "class", F.explode("cells").alias("cell")).join(held, ["g", "size", "cell"]).withColumn("left", part(1, "n_left")).withColumn("right", each("n_right"))
    right = placed.select("g", "size", "v", "id", "class", "w", F.col("home").alias("cell")).join(held, ["g", "size", "cell"]).withColumn("right", part(2, "n_right")).withColumn("left", each("n_left"))
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"class": [], "links": [], "id": [], "root": []})
        near = cosines(np.stack(a["v"].to_list()), np.stack(b["v"].to_list()), least) >= least
        near &= a["class"].to_numpy()[:, None] != b["class"].to_numpy()[None]
        i, j = np.nonzero(near)
        ids, index = np.unique(np.r_[a["id"].to_numpy(), b["id"].to_numpy()], return_inverse=True)
        root = ids[roots_of(index[i], index[len(a) + j], len(ids))]
        first = pd.DataFrame({"class": a["class"], "links": near @ b["w"].to_numpy(), "id": a["id"], "root": root[index[: len(a)]]})[near.any(axis=1)]
        second = pd.DataFrame({"class": b["class"], "links": 0, "id": b["id"], "root": root[index[len(a) :]]})[near.any(axis=0)]
        return pd.concat([first, second])

    keys = ["g", "size", "cell", "left", "right"]
    found = stash(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "class long, links long, id long, root long"), "links")
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "class", "left").join(reached.withColumnRenamed("id", "rid"), F.col("id") == F.col("rid"), "left")
    known = known.select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    unstash(placed)
    out = rows.where("good").select("id", "g", "v").join(known, ["g", "v"]).select("id", "n_links", "component_id")
    rest = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.unionAll(rest).select(F.col("id").alias(id_col), "n_links", "component_id", kept)


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id
"""
