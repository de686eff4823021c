"""Order graphs as edge tables (graph_id, src, dst): building and observables.

All graphs of an ensemble are one job, keyed by graph_id.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordergraph.operators import tiles

KEYS = ["graph_id", "src", "dst"]
#: Bits of an atom's place in its block.
BLOCK = 10


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run on this machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows, read back from a table in the shared folder, so later plans know its true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_atoms(points: DataFrame) -> DataFrame:
    """Atoms in the order of time u + v, then id, from 1."""
    return points.withColumn("atom", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("u") + F.col("v"), "id")))


def _blocks(n: str) -> Column:
    """Numbers of the blocks of 1024 atoms up to n."""
    return F.sequence(F.lit(0), F.shiftright(F.col(n).cast("int"), BLOCK))


def relations_from_points(points: DataFrame) -> DataFrame:
    """i before j when both light-cone coordinates of i are smaller.

    Blocks of atoms meet, so a task holds 1024 atoms a side, not a graph; a
    block meets only itself and those after it.
    """
    numbered = number_atoms(points).withColumn("_block", F.shiftright("atom", BLOCK))
    numbered = numbered.withColumn("_last", F.max("atom").over(Window.partitionBy("graph_id")))
    a = numbered.select("graph_id", F.explode(F.filter(_blocks("_last"), lambda b: b >= F.col("_block"))).alias("_later"), "_block", F.col("atom").alias("src"), F.col("u").alias("u1"), F.col("v").alias("v1"))
    b = numbered.select("graph_id", F.col("_block").alias("_later"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_block"), F.col("atom").alias("dst"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    return a.join(b, ["graph_id", "_block", "_later"]).filter("u1 < u2 and v1 < v2").select(*KEYS)


def relation_tiles(points: DataFrame) -> DataFrame:
    """The relations of points as packed tiles, which no table of edges precedes."""
    numbered = number_atoms(points).sortWithinPartitions("graph_id", "atom")  # as the window leaves them
    return written(tiles.packed_points(numbered, written))


def intervals(relations: DataFrame) -> DataFrame:
    """graph_id, src, dst, inside: how many atoms lie strictly between related ones.

    Counted by products of packed tiles of 1024 x 1024 atoms; no row is made
    for an atom between.
    """
    return tiles.between(written(tiles.packed(relations)), "intervals", written)


def transitive_reduction(relations: DataFrame) -> DataFrame:
    """Relations with no atom between their ends."""
    return tiles.between(written(tiles.packed(relations)), "links", written)


def links_of_tiles(relations: DataFrame) -> DataFrame:
    """The transitive reduction of relations that are packed tiles already."""
    return tiles.between(relations, "links", written)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrise(edges: DataFrame) -> DataFrame:
    return edges.select(*KEYS).unionByName(reverse(edges))


def atoms_of(graphs: DataFrame) -> DataFrame:
    return graphs.select("graph_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("atom"))


def links_to_arrays(links: DataFrame) -> DataFrame:
    return links.groupBy("graph_id", "src").agg(F.array_sort(F.collect_list("dst")).alias("future"))


def arrays_to_links(arrays: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """The links of arrays of futures; with ``graphs`` (graph_id, n) a row fails that is of no graph, or has a null
    or an end outside 1 .. n, or the same end twice."""
    if graphs is not None:
        known = arrays.join(graphs.select("graph_id", "n"), "graph_id", "left")
        inside = lambda j: j.isNotNull() & (j >= 1) & (j <= F.col("n"))
        sound = F.col("n").isNotNull() & inside(F.col("src")) & F.col("future").isNotNull() & F.forall("future", inside) & (F.size(F.array_distinct("future")) == F.size("future"))
        wrong = F.raise_error(F.concat(F.lit("not an array of links: graph "), F.col("graph_id").cast("string"), F.lit(", atom "), F.coalesce(F.col("src").cast("string"), F.lit("null"))))
        # the checked array itself is what is read on, so the check cannot be planned away
        arrays = known.withColumn("future", F.when(F.coalesce(sound, F.lit(False)), F.col("future")).otherwise(wrong))
    return arrays.select("graph_id", "src", F.explode("future").alias("dst"))


def degrees(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, atom, in_degree, out_degree, degree; isolated atoms have 0."""
    ends = edges.select("graph_id", F.col("dst").alias("atom"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select("graph_id", F.col("src").alias("atom"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    every = ends.unionByName(atoms_of(graphs).select("graph_id", "atom", F.lit(0).alias("i"), F.lit(0).alias("o")))
    d = every.groupBy("graph_id", "atom").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def connectivity(relations: DataFrame, graphs: DataFrame) -> DataFrame:
    n = relations.groupBy("graph_id").agg(F.count("*").alias("r"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return graphs.filter("n >= 2").join(n, "graph_id", "left").select("graph_id", (F.coalesce("r", F.lit(0)) / pairs).alias("connectivity"))


def sources_sinks(links: DataFrame, graphs: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.when(F.col(c) == 0, 1).otherwise(0))
    return degrees(links, graphs).groupBy("graph_id").agg(count("in_degree").alias("num_sources"), count("out_degree").alias("num_sinks"))


def _by_levels(links: DataFrame, graphs: DataFrame) -> DataFrame:
    """Longest paths by lifting, in each round, the atoms after those lifted last; for atoms in any order."""
    links = cut_lineage(links)
    front = cut_lineage(atoms_of(graphs).withColumn("height", F.lit(0)))
    heights = front
    while True:
        after = front.select("graph_id", F.col("atom").alias("src"), "height").join(links, ["graph_id", "src"])
        front = cut_lineage(after.select("graph_id", F.col("dst").alias("atom"), (F.col("height") + 1).alias("height")).distinct())
        if front.isEmpty():
            return heights.groupBy("graph_id", "atom").agg(F.max("height").alias("height"))
        heights = heights.unionByName(front)


def _walkable(links: DataFrame) -> DataFrame | None:
    """The links as tiles, if all go from smaller to larger atoms and no graph has more than tiles.WALK blocks."""
    packed = written(tiles.packed(links))
    most = packed.agg(F.max(F.greatest("bi", "bj")).alias("top"), F.min("ordered").alias("ordered")).first()
    return packed if most["ordered"] is not False and (most["top"] or 0) < tiles.WALK else None


def _with_all_atoms(values: DataFrame, graphs: DataFrame, name: str, zero) -> DataFrame:
    every = values.unionByName(atoms_of(graphs).withColumn(name, zero))
    return every.groupBy("graph_id", "atom").agg(F.max(name).alias(name))


def height_profile(links: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, atom, height: longest link path that ends at each atom.

    A graph's tiles are walked through once, target block by target block, so
    no round follows the length of a path. Links against the order of atoms,
    and graphs of more than tiles.WALK blocks, are lifted level by level.
    """
    packed = _walkable(links)
    return _by_levels(links, graphs) if packed is None else _with_all_atoms(tiles.longest_paths(packed, True), graphs, "height", F.lit(0).cast("long"))


def heights(links: DataFrame, graphs: DataFrame) -> DataFrame:
    """Longest path that starts at each atom."""
    packed = _walkable(links)
    return _by_levels(reverse(links), graphs) if packed is None else _with_all_atoms(tiles.longest_paths(packed, False), graphs, "height", F.lit(0).cast("long"))


def source_heights(links: DataFrame, graphs: DataFrame) -> DataFrame:
    sources = degrees(links, graphs).filter("in_degree = 0").select("graph_id", "atom")
    return heights(links, graphs).join(sources, ["graph_id", "atom"], "left_semi")


def cardinalities(relations: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, bin, weight: pairs whose interval, ends included, has so many atoms."""
    return cardinalities_of_tiles(written(tiles.packed(relations)), graphs)


def cardinalities_of_tiles(relations: DataFrame, graphs: DataFrame) -> DataFrame:
    sizes = tiles.between(relations, "sizes", written)
    sizes = sizes.groupBy("graph_id", (F.col("inside") + 2).alias("bin")).agg(F.sum("weight").alias("weight"))
    return sizes.unionByName(graphs.select("graph_id", F.lit(1).cast("long").alias("bin"), F.col("n").alias("weight")))


def communicability(links: DataFrame, graphs: DataFrame) -> DataFrame:
    """Row sums of exp(A): path counts by length over factorials."""
    packed = _walkable(links)
    if packed is not None and tiles.blocks_of(packed) <= 16:  # a walk holds a number for each atom and length
        longer = _with_all_atoms(tiles.path_sums(packed), graphs, "c", F.lit(0.0))
        return longer.select("graph_id", "atom", (F.col("c") + 1).alias("communicability"))
    links = cut_lineage(links)
    term = cut_lineage(atoms_of(graphs).withColumn("c", F.lit(1.0)))
    out, k = term, 0
    while True:
        k += 1
        after = term.select("graph_id", F.col("atom").alias("dst"), "c").join(links, ["graph_id", "dst"])
        term = cut_lineage(after.groupBy("graph_id", F.col("src").alias("atom")).agg((F.sum("c") / k).alias("c")))
        if term.isEmpty():
            return out.groupBy("graph_id", "atom").agg(F.sum("c").alias("communicability"))
        out = out.unionByName(term)


def countmap(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy("graph_id", F.col(value).alias("bin")).agg(F.count("*").alias("weight"))


def sparse_hist(hist: DataFrame) -> DataFrame:
    return hist.filter(F.when(F.col("weight") < 0, F.raise_error(F.lit("negative count"))).otherwise(F.col("weight") != 0))


def summary(values: DataFrame, value: str, key: str = "graph_id") -> DataFrame:
    """Seven numbers; quantiles are linear between order statistics."""
    x = F.col(value).cast("double")
    q = lambda p: F.percentile(x, F.lit(p))
    return values.groupBy(key).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.5).alias("median"))


def spectrum_summary(df: DataFrame, values: str, key: str, tolerance: float = 1e-10) -> DataFrame:
    """Summary of an array column: also zeros and the least nonzero magnitude."""
    flat = df.select(key, F.explode(values).alias("x")).withColumn("x", F.col("x").cast("double"))
    flat = flat.withColumn("x", F.when(F.isnan("x") | (F.abs("x") == float("inf")), F.raise_error(F.lit("not finite"))).otherwise(F.col("x")))
    big = F.when(F.abs("x") > tolerance, F.abs("x"))
    zeros = flat.groupBy(key).agg(F.sum(F.when(F.abs("x") <= tolerance, 1).otherwise(0)).alias("num_zero"), F.coalesce(F.min(big), F.lit(math.nan)).alias("min_abs_nonzero"))
    return zeros.join(summary(flat, "x", key), key)


def component_labels(links: DataFrame) -> DataFrame:
    """graph_id, atom, label: the least atom of the component, for atoms with an edge.

    A graph's tiles are walked through once; graphs of more than tiles.WALK blocks go by rounds.
    """
    packed = written(tiles.packed(links))
    return tiles.components(packed, written) if tiles.blocks_of(packed) <= tiles.WALK else _labels_by_rounds(links)


def _labels_by_rounds(links: DataFrame) -> DataFrame:
    """The same from tables of edges.

    Each round takes the least label of the neighbours, then the label of the
    atom which that label names, so rounds follow the logarithm of the diameter.
    """
    edges = written(symmetrise(links))
    label = written(edges.select("graph_id", F.col("src").alias("atom")).distinct().withColumn("label", F.col("atom")))
    while True:
        near = edges.join(label.select("graph_id", F.col("atom").alias("dst"), "label"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("atom")).agg(F.min("label").alias("near"))
        least = written(label.join(near, ["graph_id", "atom"]).select("graph_id", "atom", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        if least.filter("moved").isEmpty():
            return least.select("graph_id", "atom", "label")
        named = least.select("graph_id", F.col("atom").alias("label"), F.col("label").alias("further"))
        label = written(least.join(named, ["graph_id", "label"]).select("graph_id", "atom", F.col("further").alias("label")))


def weak_components(links: DataFrame) -> DataFrame:
    """graph_id, num_components: components with an edge."""
    return _counted(component_labels(links))


def weak_components_of_tiles(relations: DataFrame) -> DataFrame:
    """The same of relations that are packed tiles: whatever they join, their links join."""
    if tiles.blocks_of(relations) > tiles.WALK:
        return weak_components(links_of_tiles(relations))
    return _counted(tiles.components(relations, written))


def _counted(labels: DataFrame) -> DataFrame:
    """A component has one atom that is its own label."""
    return labels.filter("atom = label").groupBy("graph_id").agg(F.count("*").alias("num_components"))


def laplacian_weights(links: DataFrame, graphs: DataFrame) -> DataFrame:
    """Off-diagonal entries of the normalised Laplacian of the undirected links."""
    d = degrees(links, graphs).select("graph_id", "atom", "degree")
    both = symmetrise(links)
    out = both.join(d.select("graph_id", F.col("atom").alias("src"), F.col("degree").alias("ds")), ["graph_id", "src"]).join(d.select("graph_id", F.col("atom").alias("dst"), F.col("degree").alias("dd")), ["graph_id", "dst"])
    return out.select(*KEYS, (-1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """graph_id, atom, x of the matrix times the vector."""
    return matrix.join(vector.select("graph_id", F.col("atom").alias("dst"), "x"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("atom")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def laplacian_times(links: DataFrame, graphs: DataFrame, vector: DataFrame) -> DataFrame:
    """graph_id, atom, x of the normalised Laplacian times the vector; isolated atoms keep theirs."""
    off = multiply(laplacian_weights(links, graphs), vector).withColumnRenamed("x", "_off")
    return vector.join(off, ["graph_id", "atom"], "left").select("graph_id", "atom", (F.col("x") + F.coalesce("_off", F.lit(0.0))).alias("x"))


def antisymmetric_entries(links: DataFrame, graphs: DataFrame, kind: str = "in") -> DataFrame:
    """Imaginary parts of the in- or out-degree antisymmetric operator."""
    d = degrees(links, graphs)
    end, name, sign = ("dst", "in_degree", 0.5) if kind == "in" else ("dst", "out_degree", -0.5)
    e = links.join(d.select("graph_id", F.col("atom").alias(end), F.col(name).alias("d")), ["graph_id", end])
    k = F.when(F.col("d") > 0, F.lit(sign) / F.col("d")).otherwise(0.0)
    rows = F.array(F.struct(F.col("src"), F.col("dst"), k.alias("w")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), (-k).alias("w")))
    return e.select("graph_id", F.inline(rows))


def spectral_moments(links: DataFrame, graphs: DataFrame) -> DataFrame:
    """Mean and second moment of both spectra, without solving for them."""
    d = degrees(links, graphs)
    e = links.join(d.select("graph_id", F.col("atom").alias("src"), F.col("degree").alias("ds")), ["graph_id", "src"]).join(d.select("graph_id", F.col("atom").alias("dst"), F.col("degree").alias("dd"), F.col("in_degree").alias("di")), ["graph_id", "dst"])
    s = e.groupBy("graph_id").agg(F.sum(1 / (F.col("ds") * F.col("dd"))).alias("a"), F.sum(1 / (F.col("di") * F.col("di"))).alias("b"))
    return graphs.join(s, "graph_id", "left").select("graph_id", (1 + 2 * F.coalesce("a", F.lit(0.0)) / F.col("n")).alias("laplacian_2"), (F.coalesce("b", F.lit(0.0)) / 2).alias("antisymmetric_2"))


def relation_dimension(connected: DataFrame, top: int = 60) -> DataFrame:
    """Dimension at which sprinkled points have the connectivity; interpolated
    in a table of d = 1, 1.1, .. (a fixed number of rows)."""
    spark = connected.sparkSession
    f = lambda d: math.exp(math.lgamma(d + 1) + math.lgamma(d / 2) - math.lgamma(3 * d / 2)) / 2
    steps = [(k / 10, f(k / 10), (k + 1) / 10, f((k + 1) / 10)) for k in range(10, top)]
    grid = spark.createDataFrame(steps, "d1 double, f1 double, d2 double, f2 double")
    c = F.col("connectivity")
    inside = connected.join(F.broadcast(grid), (c <= F.col("f1")) & (c > F.col("f2")), "left")
    return inside.select("graph_id", "connectivity", (F.col("d1") + (F.col("f1") - c) / (F.col("f1") - F.col("f2")) * (F.col("d2") - F.col("d1"))).alias("dimension"))


GROUPS = ("connectivity", "degree", "link_degree", "height_profile", "cardinalities")


def record(relations: DataFrame, graphs: DataFrame, groups: tuple[str, ...] = ("connectivity", "link_degree")) -> DataFrame:
    """One row a graph with the requested observables only."""
    if unknown := set(groups) - set(GROUPS):
        raise ValueError(f"unknown observables: {sorted(unknown)}")
    out = graphs
    links = transitive_reduction(relations)
    parts = {
        "connectivity": lambda: connectivity(relations, graphs),
        "degree": lambda: summary(degrees(relations, graphs), "degree"),
        "link_degree": lambda: summary(degrees(links, graphs), "degree"),
        "height_profile": lambda: summary(height_profile(links, graphs), "height"),
        "cardinalities": lambda: summary(cardinalities(relations, graphs), "weight"),
    }
    for name in groups:
        part = parts[name]()
        named = [F.col(c).alias(c if c in ("graph_id", name) else f"{name}_{c}") for c in part.columns]
        out = out.join(part.select(*named), "graph_id", "left")
    return out


def _summary_of_array(x: Column) -> dict[str, Column]:
    """The numbers of ``summary``, of an array."""
    x = F.array_sort(x.cast("array<double>"))

    def q(share: float) -> Column:
        place = F.lit(share) * (F.size(x) - 1)
        low = F.floor(place)
        at = lambda k: F.get(x, k.cast("int"))
        return F.when(place == low, at(low)).otherwise((low + 1 - place) * at(low) + (place - low) * at(low + 1))

    mean = F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / F.size(x))
    return {"min": F.array_min(x), "max": F.array_max(x), "mean": mean, "q25": q(0.25), "q75": q(0.75), "median": q(0.5)}


def record_of_tiles(relations: DataFrame, graphs: DataFrame, groups: tuple[str, ...] = ("connectivity", "link_degree")) -> DataFrame:
    """The record of relations that are (written) packed tiles in the order of atoms.

    A graph of one block gives all its observables at once, where its tile
    lies, and one join brings them to its row; larger ones go through edges.
    """
    if unknown := set(groups) - set(GROUPS):
        raise ValueError(f"unknown observables: {sorted(unknown)}")
    small, wide = tiles.parted(relations, written)
    rest = graphs
    if wide is not None:
        wide = written(wide)
        ids = written(wide.select("graph_id").distinct())
        rest, large = graphs.join(ids, "graph_id", "left_anti"), graphs.join(ids, "graph_id", "left_semi")
    found = rest.join(tiles.observed(small, groups), "graph_id", "left")
    none = F.array().cast("array<bigint>")
    known = lambda c: F.coalesce(F.col(c), none)
    every = {"cardinalities": lambda c: F.concat(F.array(F.col("n").cast("bigint")), known(c))}
    padded = lambda c: F.concat(known(c), F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.col("n") - F.size(known(c)), F.lit(0)).cast("int")))
    out = [F.col(c) for c in graphs.columns]
    for name in groups:
        if name == "connectivity":
            out.append(F.when(F.col("n") >= 2, F.coalesce("relations", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias(name))
        else:
            found = found.withColumn(name, every.get(name, padded)(name))
            out += [c.alias(f"{name}_{of}") for of, c in _summary_of_array(F.col(name)).items()]
    found = found.select(*out)
    return found if wide is None else found.unionByName(record(tiles.edges(wide), large, groups))


def inconsistent(relations: DataFrame, graphs: DataFrame) -> DataFrame:
    """Edges whose graph is missing or whose ends are not among its atoms."""
    joined = relations.join(graphs.select("graph_id", "n"), "graph_id", "left")
    return joined.filter("n is null or src < 1 or dst > n or src >= dst").select(*KEYS)
