"""Distance to the k-th neighbour by ring search, and density parameters derived from it.

Every point is counted in a box of each of ``LEVELS`` nested grids, each with a
quarter of the side of the one above.  Points are searched for in groups, the
smallest boxes that the grids are cut into.  A group's ring is set by the
smallest box around it that weighs k or more: the k-th neighbour of each of its
points is no further than that box's far side.  Boxes of that grid inside
the ring are then opened step by step.  Before each step the weights of the
boxes tell how far the k-th neighbour can be at most; a box beyond that is
dropped unopened, however many points it holds.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.operators.dbscan import BLOCK, BLOCK_GAP, PROBE_DIMS, _Metric
from emberlog.operators.features import NUMERIC, VECTOR_KEY
from emberlog.operators.ordering import weighted_quantile
from emberlog.params import Params
from emberlog.session import cut_lineage, store

LEVELS = 13
SHRINK = 4
GROUP = 16  # points of a box that are no longer told apart by boxes
_SLACK = 1e-9

_ALL = _Metric(math.inf, tuple(NUMERIC))  # no two classes are out of reach


def _corners() -> list[Column]:
    corner = lambda f: F.struct(*[f(F.col(f"p.{d}")).alias(d) for d in NUMERIC])
    return [corner(F.min).alias("lo"), corner(F.max).alias("hi")]


class _Grids:
    """Points with their box on each grid, and all boxes."""

    def __init__(self, points: DataFrame):
        ends = points.agg(*[f(d).alias(f"{n}_{d}") for n, f in (("lo", F.min), ("hi", F.max)) for d in NUMERIC]).first()
        self.origin = {d: ends[f"lo_{d}"] or 0.0 for d in NUMERIC}
        widest = max((ends[f"hi_{d}"] or 0.0) - self.origin[d] for d in NUMERIC)
        self.side = max(widest, _SLACK) * (1 + 1e-9)
        point = points.select(F.struct(*VECTOR_KEY).alias("vec"), BLOCK, F.struct(*NUMERIC).alias("p"), "weight")
        path = F.array(*[self._key(level) for level in range(LEVELS)])
        self.points = store(point.withColumn("path", path))
        boxes = self.points.select("*", F.posexplode("path").alias("level", "box"))
        boxes = boxes.withColumn("above", F.when(F.col("level") > 0, F.expr("path[level - 1]")).otherwise(""))
        self.boxes = store(
            boxes.groupBy("level", "box", "above", BLOCK).agg(
                F.sum("weight").alias("weight"), F.count("*").alias("n"), F.any_value("path").alias("path"), *_corners()
            )
        )

    def _key(self, level: int) -> Column:
        size = self.side / SHRINK**level
        places = [F.floor((F.col(f"p.{d}") - self.origin[d]) / size).cast("string") for d in NUMERIC]
        return F.concat_ws(":", BLOCK, *places)

    def coarse(self, corner: str, level: Column) -> list[Column]:
        """Place among blocks of boxes that reach as far as a box's diagonal."""
        reach = math.ceil(math.sqrt(len(NUMERIC)))
        size = F.lit(self.side) / F.pow(F.lit(float(SHRINK)), level)
        return [F.floor(F.floor((F.col(f"{corner}.{d}") - self.origin[d]) / size) / reach) for d in PROBE_DIMS]


def _bounded(pairs: DataFrame, k: int) -> DataFrame:
    """Without the boxes that lie beyond the k-th neighbour of every point of the group."""
    by_far = W.partitionBy("group").orderBy("far").rowsBetween(W.unboundedPreceding, 0)
    reached = pairs.withColumn("_sum", F.sum("weight").over(by_far))
    most = F.min(F.when(F.col("_sum") >= k, F.col("far"))).over(W.partitionBy("group"))
    return reached.withColumn("_most", most).where(F.col("near") <= F.col("_most") + _SLACK).drop("_sum", "_most")


def _groups(grids: _Grids, k: int) -> DataFrame:
    """Boxes of at most ``GROUP`` points inside larger ones, with the ring to search."""
    above = grids.boxes.select((F.col("level") + 1).alias("level"), F.col("box").alias("above"), F.col("n").alias("n_above"))
    small = (F.col("n") <= GROUP) | (F.col("level") == LEVELS - 1)
    leaves = grids.boxes.where(small).join(above, ["level", "above"], "left").where("n_above IS NULL OR n_above > %d" % GROUP)
    leaves = store(leaves.select("level", F.col("box").alias("group"), BLOCK, "lo", "hi", F.slice("path", 1, F.col("level") + 1).alias("path")))
    around = leaves.select("group", F.col("level").alias("g_level"), F.posexplode("path").alias("level", "box"))
    heavy = grids.boxes.where(F.col("weight") >= k).select("level", "box", F.struct("level", "box", "lo", "hi").alias("home"))
    homes = around.join(heavy, ["level", "box"]).groupBy("group", "g_level").agg(F.max_by("home", "level").alias("home"))
    found = leaves.withColumnRenamed("level", "g_level").join(homes, ["group", "g_level"], "left")
    ring = F.when(F.col("home").isNull(), F.lit(math.inf)).otherwise(_ALL.boxes_max("lo", "hi", "home.lo", "home.hi"))
    return store(
        found.select(
            F.concat_ws("|", "g_level", "group").alias("group"), F.col(BLOCK).alias("g_block"), F.col("lo").alias("g_lo"),
            F.col("hi").alias("g_hi"), F.coalesce("home.level", F.lit(0)).alias("level"),
            F.coalesce("home.box", F.col("path")[0]).alias("home"), ring.alias("ring"),
        )
    )


def _in_ring(grids: _Grids, groups: DataFrame) -> DataFrame:
    """(group, box) pairs to begin with: boxes of the home grid inside the ring."""
    names = [f"g{i}" for i in range(len(PROBE_DIMS))]
    steps = itertools.product((-1, 0, 1), repeat=len(names))
    step = lambda s: "named_struct(" + ", ".join(f"'{n}', {v}L" for v, n in zip(s, names)) + ")"
    offsets = F.expr("array(" + ", ".join(step(s) for s in steps) + ")")
    homes = groups.groupBy("level", "home", "g_block").agg(F.max("ring").alias("ring"))
    boxes = grids.boxes.select("level", "box", BLOCK, "weight", "n", "lo", "hi", *[c.alias(n) for c, n in zip(grids.coarse("lo", F.col("level")), names)])
    home = boxes.select("level", F.col("box").alias("home"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"), *[F.col(n).alias("_" + n) for n in names])
    probes = homes.join(home, ["level", "home"])
    known = grids.boxes.where("level = 0").select(BLOCK).distinct().collect()  # as many as there are classes
    classes = F.array(*[F.lit(r[0]) for r in known])
    probes = probes.withColumn(BLOCK, F.explode(F.when(F.col("ring") >= BLOCK_GAP, classes).otherwise(F.array("g_block"))))
    probes = probes.select("*", F.explode(offsets).alias("_s"))
    probes = probes.select("level", "home", "g_block", "ring", "h_lo", "h_hi", BLOCK, *[(F.col("_" + n) + F.col(f"_s.{n}")).alias(n) for n in names])
    near = _ALL.boxes_min("h_lo", "h_hi", "lo", "hi", ("g_block", BLOCK))
    met = probes.join(boxes, ["level", BLOCK, *names]).where(near <= F.col("ring") + _SLACK)
    met = met.select("level", "home", "g_block", "box", F.col(BLOCK).alias("block"), "weight", "n", "lo", "hi")
    pairs = groups.join(met, ["level", "home", "g_block"])
    return _measured(pairs).where(F.col("near") <= F.col("ring") + _SLACK).drop("home", "ring")


def _measured(pairs: DataFrame) -> DataFrame:
    blocks = ("g_block", "block")
    return pairs.withColumns(
        {"near": _ALL.boxes_min("g_lo", "g_hi", "lo", "hi", blocks), "far": _ALL.boxes_max("g_lo", "g_hi", "lo", "hi", blocks)}
    )


def k_distances(points: DataFrame, k: int) -> DataFrame:
    """Vector key, ``weight`` and ``k_distance``: the distance to the k-th nearest row, itself included.

    ``points`` are weighted distinct vectors; all of them together must weigh
    at least k.  A vector that weighs k alone has distance 0.
    """
    grids = _Grids(points)
    groups = _groups(grids, k)
    group = ["group", "g_block", "g_lo", "g_hi"]
    box = ["level", "box", "block", "weight", "n", "lo", "hi"]
    pairs = store(_bounded(_in_ring(grids, groups), k).select(*group, *box))
    inner = grids.boxes.select((F.col("level") - 1).alias("level"), F.col("above").alias("box"), F.struct("box", F.col(BLOCK).alias("block"), "weight", "n", "lo", "hi").alias("in"))
    open_ = (F.col("n") > GROUP) & (F.col("level") < LEVELS - 1)
    for _ in range(LEVELS - 1):
        if pairs.where(open_).isEmpty():
            break
        opened = pairs.where(open_).select(*group, "level", "box").join(inner, ["level", "box"])
        opened = opened.select(*group, (F.col("level") + 1).alias("level"), "in.*")
        pairs = store(_bounded(_measured(pairs.where(~open_).unionByName(opened)), k).select(*group, *box))

    placed = grids.points.select("vec", F.col("p"), F.col(BLOCK).alias("block"), "weight", F.posexplode("path").alias("level", "box"))
    light = placed.where(F.col("weight") < k).select(
        "vec", F.col("p").alias("v_p"), F.col("block").alias("v_block"), F.concat_ws("|", "level", "box").alias("group")
    )
    asked = light.join(groups.select("group"), "group")
    others = placed.select("level", "box", F.col("p").alias("u_p"), F.col("block").alias("u_block"), F.col("weight").alias("u_weight"))
    met = asked.join(pairs.select("group", "level", "box"), "group").join(others, ["level", "box"])
    met = met.select("vec", _ALL.points("v_p", "u_p", ("v_block", "u_block")).alias("d"), "u_weight")
    met = met.groupBy("vec", "d").agg(F.sum("u_weight").alias("u_weight"))
    inside = F.sum("u_weight").over(W.partitionBy("vec").orderBy("d"))
    found = met.withColumn("_sum", inside).where(F.col("_sum") >= k).groupBy("vec").agg(F.sqrt(F.min("d")).alias("k_distance"))
    every = grids.points.select("vec", "weight").join(found, "vec", "left")
    return every.select("vec.*", "weight", F.coalesce("k_distance", F.lit(0.0)).alias("k_distance"))


def density_parameters(points: DataFrame, rows: int, params: Params) -> tuple[float, int, bool]:
    """(eps, min_samples, derived): as given, or derived from the points, as ``params.density`` asks."""
    if params.density == "given":
        return params.eps, params.min_samples, False
    if params.density != "derived":
        raise ValueError("density must be 'given' or 'derived'")
    samples = max(4, min(params.min_samples, max(4, rows // 100)))
    found = cut_lineage(k_distances(points, min(samples, rows)).select("k_distance", "weight"))
    most = found.agg(F.max("k_distance")).first()[0] or 1.0
    share = found.select((F.col("k_distance") / most).alias("share"), "weight")
    cut = weighted_quantile(share, "share", "weight", 0.95).first()[0] * most
    return max(float(cut), 0.1), samples, True
