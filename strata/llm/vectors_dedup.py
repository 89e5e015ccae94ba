"""Near-duplicate embeddings by int8 tile products with error bounds.

Unit vectors are quantised to int8, each with its own scale. For a vector
u = s*q + e the length of the rounding error e is stored, so the product of two
quantised vectors bounds the true cosine rigorously:

    |u.v - s_u s_v (q_u.q_v)| <= |e_u| + |e_v| + |e_u||e_v|

(because |s q| <= 1 + |e|). Pairs surely below the threshold are settled by the
integer product, and so are those surely above; only the doubtful ones between
are computed again in double precision. Vectors are quantised once, and blocks
of them with equal labels meet in tiles as bytes; a tile returns link counts and
a spanning forest of its links, never the pairs, and the ids of its doubtful
vectors, whose full components are fetched for a second pass.
Blocks follow a random direction's order, and two blocks that lie further apart
along any of a few directions than linked vectors can be are not multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strata.llm.ann import usual_length, valid_vector
from strata.llm.common import components, load, pick, save, shuffle_width

THRESHOLD = 0.93
BLOCK = 1024  #: vectors in a block: a tile holds BLOCK * BLOCK products
DIRECTIONS = 8  #: directions along which blocks are compared


def quantise(u):
    """int8 components, scale and length of the rounding error of every unit row."""
    import numpy as np

    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    error = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


def _project(directions: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
            u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            basis = np.linalg.qr(np.random.default_rng(31).normal(size=(u.shape[1], min(directions, u.shape[1]))))[0]
            along = u @ basis
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * u.shape[1], pa.int32()), pa.array(u.ravel()))
            q, scale, error = quantise(u)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("copies"), unit,
                 pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(error),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * along.shape[1], pa.int32()), pa.array(along.ravel()))],
                names=["vec_id", "label", "copies", "u", "q", "scale", "error", "along"],
            )

    return run


def _side(table, r: str):
    """ids, copies, int8 rows, scales and errors of one side of a tile, by id."""
    import numpy as np

    t = table.combine_chunks()
    ids = t["vec_id" + r].to_numpy()
    order = np.argsort(ids)
    q = np.frombuffer(b"".join(t["q" + r].to_pylist()), np.int8).reshape(t.num_rows, -1)
    return ids[order], t["copies" + r].to_numpy()[order], q[order], t["scale" + r].to_numpy()[order], t["error" + r].to_numpy()[order], order


def _bounds(a, b, threshold: float, own: bool):
    """Which pairs of a tile are surely, and which possibly but not surely, at or above the threshold."""
    import numpy as np

    (ia, _, qa, sa, ea, _), (ib, _, qb, sb, eb, _) = a, b
    # products of int8 values summed over d <= 1000 components stay exact in float32
    kind = np.float32 if qa.shape[1] * 127 * 127 < 2**24 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    slack = ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :]
    once = ia[:, None] < ib[None, :] if own else np.ones(near.shape, bool)
    sure = once & (near - slack >= threshold)
    return sure, once & (near + slack >= threshold) & ~sure


def _links(a, b, pairs):
    """Link counts of the vectors in ``pairs``, and for each the root of its tree."""
    import numpy as np

    r, c = pairs
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a[0][r].tolist(), b[0][c].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = []
    for ids, n in ((a[0], np.bincount(r, weights=b[1][c], minlength=len(a[0]))), (b[0], np.bincount(c, weights=a[1][r], minlength=len(b[0])))):
        hit = np.flatnonzero(n)
        out += [(x, k, root(x)) for x, k in zip(ids[hit].tolist(), n[hit].astype(np.int64).tolist(), strict=True)]
    return out


def _tile(threshold: float, label_type):
    """side 0: links of the sure pairs (vec_id, links, root); sides 1 and 2: doubtful vectors of the tile."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        rows = []
        if left.num_rows and right.num_rows:
            a, b = _side(left, ""), _side(right, "_r")
            sure, doubt = _bounds(a, b, threshold, left["own"][0].as_py())
            rows = [(0, *x) for x in _links(a, b, np.nonzero(sure))]
            rows += [(1, x, 0, 0) for x in a[0][doubt.any(axis=1)].tolist()] + [(2, x, 0, 0) for x in b[0][doubt.any(axis=0)].tolist()]
        tile = [pa.array([k.as_py()] * len(rows), t) for k, t in zip(key, [label_type, pa.int32(), pa.int64(), pa.int32(), pa.int64()], strict=True)]
        names = ["label", "p", "b", "p2", "b2", "side", "vec_id", "links", "root"]
        columns = [pa.array([r[c] for r in rows], pa.int32() if c == 0 else pa.int64()) for c in range(4)]
        return pa.table(dict(zip(names, [*tile, *columns], strict=True)))

    return run


def _doubtful(threshold: float):
    """Links of a tile's doubtful pairs, by their cosine in double precision."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        rows = []
        if left.num_rows and right.num_rows:
            a, b = _side(left, ""), _side(right, "_r")
            units = []
            for t, r, side in ((left, "", a), (right, "_r", b)):
                u = t.combine_chunks()["u" + r].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                units.append(u.reshape(t.num_rows, -1)[side[5]])
            own = key[1].as_py() == key[3].as_py() and key[2].as_py() == key[4].as_py()
            r, c = np.nonzero(_bounds(a, b, threshold, own)[1])
            link = np.einsum("ij,ij->i", units[0][r], units[1][c]) >= threshold
            rows = _links(a, b, (r[link], c[link]))
        return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("vec_id", "links", "root"))})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label", block: int = BLOCK, directions: int = DIRECTIONS) -> DataFrame:
    """Links between vectors of one label whose cosine reaches ``threshold``.

    Returns one row for each vec_id: n_links (other vectors linked directly),
    component_id (smallest vec_id reachable) and kept (vec_id = component_id).
    Vectors that are null, zero, of unusual length, hold null or non-finite
    components, or have no label link with nothing. Of the other rows with one
    vec_id, the first by label, then vector counts; rows without a vec_id are
    left out. An
    empty table gives no rows. Equal vectors of a label are compared once; the
    class then counts with all its members.
    """
    spark = vectors.sparkSession
    ids = pick(vectors, id_col).toDF("vec_id").where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long")).distinct()
    rows = pick(vectors, id_col, vector_col, label_col).toDF("vec_id", "v", "label").where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"), "label").where(valid_vector(F.col("v")))
    dim = usual_length(rows)
    d = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("first"))
    d = save(d.select("vec_id", "first.v", "first.label"), "labelled")
    classes = save(d.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "classes")
    kind = d.schema["label"].dataType.simpleString()
    flat = classes.select("vec_id", "label", "copies", "v").mapInArrow(
        _project(directions), f"vec_id long, label {kind}, copies long, u array<double>, q binary, scale double, error double, along array<double>")
    # vectors of fewer components than directions have null bounds along the rest, which tell nothing apart
    # blocks: runs of equal label along the first direction, cut inside each range partition
    ranged = flat.withColumn("x", F.col("along")[0]).repartitionByRange(shuffle_width(spark), "label", "x", "vec_id").sortWithinPartitions("label", "x", "vec_id")
    ranged = ranged.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = save(ranged, "ranged")
    cut = ranged.withColumn("b", F.floor(F.col("i") / block))
    low = F.array(*[F.min(F.get("along", F.lit(j))).alias(f"l{j}") for j in range(directions)])
    high = F.array(*[F.max(F.get("along", F.lit(j))).alias(f"h{j}") for j in range(directions)])
    blocks = save(cut.groupBy("label", "p", "b").agg(low.alias("low"), high.alias("high")), "blocks")
    # |u - v|^2 = 2 - 2 cos, so linked vectors differ by at most this along any direction
    far = (2 - 2 * threshold) ** 0.5 + 1e-9
    other = blocks.toDF("label", "p2", "b2", "low2", "high2")
    apart = F.exists(F.arrays_zip("low", "high", "low2", "high2"), lambda z: (z["low"] - z["high2"] > far) | (z["low2"] - z["high"] > far))
    tiles = blocks.join(other, "label").where("p < p2 OR (p = p2 AND b <= b2)").where(~F.coalesce(apart, F.lit(False)))
    tiles = save(tiles.select("label", "p", "b", "p2", "b2", F.expr("p = p2 AND b = b2").alias("own")), "tiles")
    key = ["label", "p", "b", "p2", "b2"]
    key_r = [f"{k}_r" for k in key]
    small = ["vec_id", "copies", "q", "scale", "error"]
    rows = cut.select("label", "p", "b", *small)
    left = tiles.join(rows, ["label", "p", "b"])
    right = tiles.join(rows.toDF("label", "p2", "b2", *small), ["label", "p2", "b2"])
    right = right.select(*key, *small).toDF(*key_r, *[f"{c}_r" for c in small])
    label_type = to_arrow_type(d.schema["label"].dataType)
    made = f"label {kind}, p int, b long, p2 int, b2 long, side int, vec_id long, links long, root long"
    met = left.groupBy(*key).cogroup(right.groupBy(*key_r)).applyInArrow(_tile(threshold, label_type), made)
    met = save(met, "met")
    # the doubtful vectors with all their components, tile by tile
    full = ranged.select("vec_id", "copies", "q", "scale", "error", "u")
    sides = [met.where(F.col("side") == k).select(*key, "vec_id").join(full, "vec_id").select(*key, *small, "u") for k in (1, 2)]
    right = sides[1].toDF(*key_r, *[f"{c}_r" for c in small], "u_r")
    again = sides[0].groupBy(*key).cogroup(right.groupBy(*key_r)).applyInArrow(_doubtful(threshold), "vec_id long, links long, root long")
    met = save(met.where("side = 0").select("vec_id", "links", "root").unionByName(again), "linked")
    counts = met.groupBy("vec_id").agg(F.sum("links").alias("links")).toDF("rep", "links")
    comp = components(met.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).toDF("rep", "component")
    of = classes.join(counts, classes["vec_id"] == counts["rep"], "left").drop("rep")
    of = of.join(comp, of["vec_id"] == comp["rep"], "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = d.join(of, ["label", "v"]).select("vec_id", "n_links", "component_id")
    out = ids.join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_vector_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, links at a cosine of 0.93 within a label."""
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"))
