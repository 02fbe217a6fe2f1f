"""Exact DBSCAN on weighted distinct points, as joins on a grid.

Points are placed in cells so small that two points of one cell are always
neighbours (Gunawan 2013; Gan and Tao 2015).  Then

* a cell whose weight reaches ``min_samples`` has only core points, so its
  points are never compared with each other;
* any other cell holds fewer than ``min_samples`` points, so comparing them
  with each other is linear in the number of points;
* a point of such a thin cell counts a dense cell by weight: its box is halved
  again and again, a part wholly within reach counts unopened, a part wholly
  beyond is dropped, and only small parts on the border are opened;
* two dense cells are linked through their boxes and corner points, and the
  few undecided pairs are split into halves until every one is decided.

Cells are as many as the occupied feature space needs; they do not grow with
the number of rows.  Nothing here enumerates the pairs inside a group.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.operators.components import connected_components
from emberlog.operators.features import NUMERIC, VECTOR_KEY
from emberlog.operators.ordering import with_row_index
from emberlog.operators.skew import attach_by_key
from emberlog.session import cut_lineage

BLOCK = "event_class"
BLOCK_GAP = 2.0  # squared distance between the one-hots of two classes
PROBE_DIMS = ("hour_sin", "log_length", "log_template_freq", "log_burst")
HOT_CELL = 100_000  # points of a cell whose facts are broadcast
OPEN_PART = 64  # points of a dense cell, or of a part of it, that are compared one by one
DIRECT_PAIRS = 4096  # compare two dense cells point by point up to this product


@dataclass(frozen=True)
class _Metric:
    """Distances between structs ``p`` of the numeric features."""

    eps: float
    dims: tuple[str, ...]

    @property
    def limit(self) -> float:
        return round(self.eps * self.eps, 9)

    @property
    def side(self) -> float:
        return self.eps / math.sqrt(len(self.dims)) * (1 - 1e-9)

    @property
    def blocked(self) -> bool:
        """Two classes can only be neighbours when eps reaches their gap."""
        return self.limit < BLOCK_GAP

    def near(self, squared: Column) -> Column:
        return F.round(squared, 9) <= F.lit(self.limit)

    def _squares(self, gap: str, blocks, **names) -> Column:
        """Sum of the squared gaps over the features, plus the class gap where classes may differ."""
        gaps = [gap.format(d=d, **names) for d in self.dims]
        total = " + ".join(f"({g}) * ({g})" for g in gaps)
        if not self.blocked and blocks is not None:
            total += f" + IF({blocks[0]} = {blocks[1]}, 0D, {BLOCK_GAP}D)"
        return F.expr(total)

    def points(self, a: str, b: str, blocks=None) -> Column:
        return self._squares("{a}.{d} - {b}.{d}", blocks, a=a, b=b)

    def boxes_min(self, lo_a, hi_a, lo_b, hi_b, blocks=None) -> Column:
        gap = "greatest(0D, {lo_b}.{d} - {hi_a}.{d}, {lo_a}.{d} - {hi_b}.{d})"
        return self._squares(gap, blocks, lo_a=lo_a, hi_a=hi_a, lo_b=lo_b, hi_b=hi_b)

    def boxes_max(self, lo_a, hi_a, lo_b, hi_b, blocks=None) -> Column:
        reach = "greatest({hi_b}.{d} - {lo_a}.{d}, {hi_a}.{d} - {lo_b}.{d})"
        return self._squares(reach, blocks, lo_a=lo_a, hi_a=hi_a, lo_b=lo_b, hi_b=hi_b)

    def cell_key(self, level: int = 0) -> Column:
        size = self.side / 2**level
        return F.concat_ws(
            ":", BLOCK, *[F.floor(F.col(f"p.{d}") / size).cast("string") for d in self.dims]
        )


def _boxes(metric: _Metric) -> list[Column]:
    corner = lambda f: F.struct(*[f(F.col(f"p.{d}")).alias(d) for d in metric.dims])
    return [corner(F.min).alias("lo"), corner(F.max).alias("hi"), F.min("p").alias("rep")]


class DensityModel:
    """Cells, neighbour cells and contacts of one set of points.

    ``close`` holds the pairs of thin points within eps, ``counted`` a thin
    point's weight in each dense cell that it reaches; several answers share them.
    """

    def __init__(self, points: DataFrame, eps: float, min_samples: int, dims=tuple(NUMERIC)):
        self.metric = m = _Metric(float(eps), tuple(dims))
        self.min_samples = int(min_samples)
        placed = points.select(
            F.struct(*VECTOR_KEY).alias("vec"),
            BLOCK,
            F.struct(*dims).alias("p"),
            "weight",
            "first_row",
        ).withColumn("cell", m.cell_key())
        self.cells = cut_lineage(
            placed.groupBy("cell", BLOCK).agg(
                F.sum("weight").alias("cell_weight"), F.count("*").alias("n_vec"), *_boxes(m)
            )
        )
        facts = self.cells.select("cell", "cell_weight", "n_vec")
        self.points = cut_lineage(
            attach_by_key(placed, facts, ["cell"], F.col("vec"), "n_vec", hot_rows=HOT_CELL)
            .withColumn("dense", F.col("cell_weight") >= self.min_samples)
        )
        self.cell_pairs = self._cell_pairs()
        probes = cut_lineage(self._probes())
        self.close = cut_lineage(self._close_pairs(probes.where(~F.col("dense"))))
        self.counted = cut_lineage(self._counted(probes.where("dense")))

    def _cell_pairs(self) -> DataFrame:
        """Unordered pairs of cells that could hold neighbours."""
        m = self.metric
        reach = math.ceil(math.sqrt(len(m.dims)))
        coarse = [F.floor(F.floor(F.col(f"lo.{d}") / m.side) / reach).cast("int") for d in PROBE_DIMS]
        names = [f"g{i}" for i in range(len(PROBE_DIMS))]
        located = self.cells.select(
            "cell", BLOCK, "n_vec", "cell_weight", "lo", "hi", "rep",
            (F.col("cell_weight") >= self.min_samples).alias("dense"),
            *[c.alias(n) for c, n in zip(coarse, names)],
        )
        # half of the surrounding grid is enough: each pair is met from one side
        steps = [s for s in itertools.product((-1, 0, 1), repeat=len(names)) if s >= (0,) * len(names)]
        step = lambda s: "named_struct(" + ", ".join(f"'{n}', {v}" for v, n in zip(s, names)) + ")"
        offsets = F.expr("array(" + ", ".join(step(s) for s in steps) + ")")
        kept = ["cell", BLOCK, "n_vec", "cell_weight", "lo", "hi", "rep", "dense"]
        a = located.withColumn("_step", F.explode(offsets)).select(
            *[F.col(c).alias("a_" + c) for c in kept],
            *[(F.col(n) + F.col(f"_step.{n}")).alias(n) for n in names],
            F.when(F.greatest(*[F.abs(F.col(f"_step.{n}")) for n in names]) == 0, True)
            .otherwise(False)
            .alias("_home"),
        )
        b = located.select(*[F.col(c).alias("b_" + c) for c in kept], *names)
        on = list(names)
        if m.blocked:
            a = a.withColumn("_block", F.col("a_" + BLOCK))
            b = b.withColumn("_block", F.col("b_" + BLOCK))
            on.append("_block")
        blocks = ("a_" + BLOCK, "b_" + BLOCK)
        pairs = a.join(b, on).where(~F.col("_home") | (F.col("a_cell") < F.col("b_cell")))
        return pairs.where(m.near(m.boxes_min("a_lo", "a_hi", "b_lo", "b_hi", blocks))).drop(
            *on, "_home"
        )

    def _probes(self) -> DataFrame:
        """Each thin point with the other cells whose box it may reach."""
        m = self.metric

        def seen(side, other):
            names = {"cell": "part", "cell_weight": "weight", "n_vec": "n", "lo": "lo", "hi": "hi", BLOCK: "u_block", "dense": "dense"}
            fields = [F.col(f"{other}_{c}").alias(n) for c, n in names.items()]
            return F.struct(F.col(side + "_cell").alias("v_cell"), F.col(side + "_dense").alias("from_dense"), *fields)

        directed = self.cell_pairs.select(F.explode(F.array(seen("a", "b"), seen("b", "a"))).alias("d")).select("d.*")
        thin = self.points.where(~F.col("dense")).select(
            F.col("cell").alias("v_cell"), F.col("vec").alias("v"), F.col("p").alias("v_p"), F.col(BLOCK).alias("v_block")
        )
        met = thin.join(directed.where(~F.col("from_dense")).drop("from_dense"), "v_cell").withColumn("cell", F.col("part"))
        return met.where(m.near(m.boxes_min("v_p", "v_p", "lo", "hi", ("v_block", "u_block"))))

    def _met(self, probes: DataFrame, targets: DataFrame) -> DataFrame:
        """Probes with the points of their part within eps."""
        named = targets.select(
            "part", F.col("vec").alias("u"), F.col("p").alias("u_p"), F.col("weight").alias("u_weight")
        )
        m = self.metric
        return probes.join(named, "part").where(m.near(m.points("v_p", "u_p", ("v_block", "u_block"))))

    def _close_pairs(self, probes: DataFrame) -> DataFrame:
        """(v, u): two points of thin cells within eps; a thin cell has few points, so these are few a point."""
        thin = self.points.where(~F.col("dense")).withColumn("part", F.col("cell"))
        return self._met(probes, thin).select("v", "v_cell", "u", F.col("cell").alias("u_cell"), "u_weight")

    def _parts(self, level: int, cells: DataFrame) -> DataFrame:
        """Boxes of the dense ``cells`` halved ``level`` times, with the box of the level above."""
        m = self.metric
        return (
            self.points.where("dense")
            .join(cells, "cell", "left_semi")
            .withColumn("above", m.cell_key(level - 1))
            .withColumn("part", m.cell_key(level))
            .groupBy("cell", "above", "part", BLOCK)
            .agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), *_boxes(m))
        )

    def _counted(self, probes: DataFrame) -> DataFrame:
        """(v, v_cell, cell, weight): weight of the points of a dense cell within eps of v, at least 1.

        The weight is complete unless the ones found reach ``min_samples``: then v is core whatever else
        is near, and a cell that v is known to touch is not opened further.
        """
        m, pair = self.metric, ["v", "v_cell", "cell"]
        blocks = ("v_block", "u_block")
        kept = [*pair, "v_p", "v_block", "u_block", "part", "n", "weight", "lo", "hi"]
        todo, found, level = probes.select(*kept), None, 0
        while True:
            inside = m.near(m.boxes_max("v_p", "v_p", "lo", "hi", blocks))
            judged = cut_lineage(todo.withColumn("_inside", inside))
            whole = judged.where("_inside").select(*pair, "weight")
            border = judged.where(~F.col("_inside")).drop("_inside")
            points = self.points.where("dense").withColumn("part", m.cell_key(level) if level else F.col("cell"))
            opened = self._met(border.where(F.col("n") <= OPEN_PART), points).select(*pair, F.col("u_weight").alias("weight"))
            more = whole.unionByName(opened).groupBy(*pair).agg(F.sum("weight").alias("weight"))
            found = cut_lineage(more if found is None else found.unionByName(more).groupBy(*pair).agg(F.sum("weight").alias("weight")))
            border = border.where(F.col("n") > OPEN_PART)
            if border.isEmpty():
                return found
            core = found.groupBy("v").agg(F.sum("weight").alias("_all")).where(F.col("_all") >= self.min_samples)
            border = border.join(found.join(core, "v", "left_semi").select("v", "cell"), ["v", "cell"], "left_anti")
            level += 1
            parts = self._parts(level, border.select("cell").distinct()).select(
                "cell", F.col("above").alias("part"), F.struct("part", "n", "weight", "lo", "hi").alias("_in")
            )
            inner = border.select(*pair, "v_p", "v_block", "u_block", "part").join(parts, ["cell", "part"]).drop("part")
            todo = inner.select(*pair, "v_p", "v_block", "u_block", "_in.*")
            todo = todo.where(m.near(m.boxes_min("v_p", "v_p", "lo", "hi", blocks))).select(*kept)

    # ------------------------------------------------------------------ flags
    def thin_points(self) -> DataFrame:
        """Points of thin cells with their core flag; ``neighbours`` is their whole weight where it is below ``min_samples``."""
        near = self.close.select("v", F.col("u_weight").alias("weight")).unionByName(self.counted.select("v", "weight"))
        around = near.groupBy(F.col("v").alias("vec")).agg(F.sum("weight").alias("around"))
        total = F.col("cell_weight") + F.coalesce("around", F.lit(0))
        return (
            self.points.where(~F.col("dense"))
            .join(around, "vec", "left")
            .withColumn("neighbours", total)
            .withColumn("core", total >= self.min_samples)
        )

    def _core_contacts(self, thin: DataFrame) -> DataFrame:
        """(vec, cell): each thin point with the cells of the core points within its reach."""
        core = thin.where("core")
        outside = self.close.join(core.select(F.col("vec").alias("u")), "u", "left_semi")
        outside = outside.select(F.col("v").alias("vec"), F.col("u_cell").alias("cell"))
        outside = outside.unionByName(self.counted.select(F.col("v").alias("vec"), "cell"))
        own = thin.select("vec", "cell").join(core.select("cell").distinct(), "cell", "left_semi")
        return outside.unionByName(own.select("vec", "cell"))

    def flags(self) -> DataFrame:
        """Vector key, ``core`` and ``noise``; needs no cluster ids and no iteration."""
        thin = self.thin_points()
        touched = self._core_contacts(thin).select("vec").distinct().withColumn("_touched", F.lit(True))
        judged = thin.join(touched, "vec", "left").select(
            "vec", "weight", "core", F.col("_touched").isNull().alias("noise")
        )
        dense = self.points.where("dense").select(
            "vec", "weight", F.lit(True).alias("core"), F.lit(False).alias("noise")
        )
        return dense.unionByName(judged).select("vec.*", "weight", "core", "noise")

    # --------------------------------------------------------------- clusters
    def _dense_links(self) -> DataFrame:
        """Pairs of dense cells that hold at least one pair within eps."""
        m = self.metric
        blocks = ("a_" + BLOCK, "b_" + BLOCK)
        pairs = cut_lineage(
            self.cell_pairs.where(F.col("a_dense") & F.col("b_dense")).select(
                F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), "a_n_vec", "b_n_vec",
                (m.near(m.boxes_max("a_lo", "a_hi", "b_lo", "b_hi", blocks))
                 | m.near(m.points("a_rep", "b_rep", blocks))).alias("sure"),
            )
        )
        undecided = pairs.where(~F.col("sure"))
        small = F.col("a_n_vec") * F.col("b_n_vec") <= DIRECT_PAIRS
        dense = self.points.where("dense").select("cell", "vec", "p", BLOCK)
        direct = self._side(self._side(undecided.where(small), dense, "a"), dense, "b")
        direct = direct.where(
            m.near(m.points("a_p", "b_p", ("a_block", "b_block")))
        ).select("a", "b")
        links = pairs.where("sure").select("a", "b").unionByName(direct)
        for found in self._split_links(undecided.where(~small).select("a", "b")):
            links = links.unionByName(found)
        return links

    @staticmethod
    def _side(pairs: DataFrame, points: DataFrame, side: str) -> DataFrame:
        named = points.select(
            F.col("cell").alias(side), F.col("p").alias(side + "_p"), F.col(BLOCK).alias(side + "_block")
        )
        return pairs.join(named, side)

    def _split_links(self, pairs: DataFrame):
        """Decide large undecided pairs by halving both cells again and again."""
        m = self.metric
        todo = cut_lineage(pairs.select("a", "b", F.col("a").alias("a_sub"), F.col("b").alias("b_sub")))
        level = 0
        while not todo.isEmpty():
            level += 1
            involved = todo.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
            parts = self._parts(level, involved)
            both = todo
            for side in ("a", "b"):
                named = parts.select(
                    F.col("cell").alias(side), F.col("above").alias(side + "_sub"),
                    *[F.col(c).alias(f"{side}_{c}") for c in ("part", "n", "lo", "hi", "rep", BLOCK)],
                )
                both = both.join(named, [side, side + "_sub"])
            blocks = ("a_" + BLOCK, "b_" + BLOCK)
            judged = cut_lineage(
                both.where(m.near(m.boxes_min("a_lo", "a_hi", "b_lo", "b_hi", blocks))).select(
                    "a", "b", F.col("a_part").alias("a_sub"), F.col("b_part").alias("b_sub"),
                    (m.near(m.boxes_max("a_lo", "a_hi", "b_lo", "b_hi", blocks))
                     | m.near(m.points("a_rep", "b_rep", blocks))).alias("hit"),
                    (F.col("a_n") * F.col("b_n") > 1).alias("splittable"),
                )
            )
            found = judged.where("hit").select("a", "b").distinct()
            yield found
            todo = cut_lineage(
                judged.where("splittable").join(found, ["a", "b"], "left_anti").drop("hit", "splittable")
            )

    def clusters(self) -> DataFrame:
        """Vector key, ``dbscan_cluster`` (-1 for noise), ``core`` and ``noise``.

        Clusters are numbered by their earliest core row; a border point joins
        the lowest-numbered cluster among its core neighbours.
        """
        thin = cut_lineage(self.thin_points())
        core_thin = thin.where("core").select("vec", "cell", "first_row")
        core = self.points.where("dense").select("vec", "cell", "first_row").unionByName(core_thin)
        starts = core.groupBy("cell").agg(F.min("first_row").alias("first_row"))
        thin_links = (
            self.close.join(core_thin.select(F.col("vec").alias("u")), "u", "left_semi")
            .select("v", "v_cell", F.col("u_cell").alias("cell"))
            .unionByName(self.counted.select("v", "v_cell", "cell"))
            .join(core_thin.select(F.col("vec").alias("v")), "v", "left_semi")
            .select(F.col("v_cell").alias("a"), F.col("cell").alias("b"))
        )
        links = self._dense_links().unionByName(thin_links)
        rooted = connected_components(starts.select(F.col("cell").alias("id")), links)
        rooted = rooted.withColumnRenamed("id", "cell").join(starts, "cell")
        heads = rooted.groupBy("root").agg(F.min("first_row").alias("first_row"))
        numbered = with_row_index(heads, "first_row", name="number").select("root", "number")
        cell_cluster = cut_lineage(rooted.join(numbered, "root").select("cell", "number"))

        contacts = self._core_contacts(thin).join(cell_cluster, "cell")
        border = contacts.groupBy("vec").agg(F.min("number").alias("border"))
        own = thin.join(cell_cluster, "cell", "left").join(border, "vec", "left")
        number = F.when(F.col("core"), F.col("number")).otherwise(F.coalesce("border", F.lit(-1)))
        judged = own.select("vec", "weight", "first_row", "core", number.alias("dbscan_cluster"))
        settled = self.points.where("dense").join(cell_cluster, "cell").select(
            "vec", "weight", "first_row", F.lit(True).alias("core"), F.col("number").alias("dbscan_cluster")
        )
        return settled.unionByName(judged).select(
            "vec.*", "weight", "first_row", "core", F.col("dbscan_cluster").cast("long"),
            (F.col("dbscan_cluster") == -1).alias("noise"),
        )


def dbscan_noise(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    return DensityModel(points, eps, min_samples).flags()


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    return DensityModel(points, eps, min_samples).clusters()
