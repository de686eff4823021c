"""Queries over the ensemble of order graphs made from ``orders``."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import functions as F

from ordergraph.operators import graphs as G
from ordergraph.operators import histograms as H
from ordergraph.operators import spectra as P
from ordergraph.operators import tiles as T
from ordergraph.sources import ensembles as S

QUERIES, SQL = {}, {}

PREFIX = """WITH RECURSIVE atoms AS (
  SELECT o_custkey AS graph_id, epoch(o_orderdate)::DOUBLE AS u, o_totalprice AS v,
         row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate)::DOUBLE + o_totalprice, o_orderkey) AS atom
  FROM orders),
g AS (SELECT graph_id, count(*) AS n FROM atoms GROUP BY 1),
rel AS (SELECT a.graph_id, a.atom AS src, b.atom AS dst FROM atoms a JOIN atoms b ON a.graph_id = b.graph_id AND a.u < b.u AND a.v < b.v),
lnk AS (SELECT * FROM rel r WHERE NOT EXISTS (SELECT 1 FROM rel x JOIN rel y ON x.graph_id = y.graph_id AND x.dst = y.src
        WHERE x.graph_id = r.graph_id AND x.src = r.src AND y.dst = r.dst)),
deg AS (SELECT a.graph_id, a.atom, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree
  FROM atoms a LEFT JOIN (SELECT graph_id, dst, count(*) AS c FROM lnk GROUP BY 1, 2) i ON i.graph_id = a.graph_id AND i.dst = a.atom
  LEFT JOIN (SELECT graph_id, src, count(*) AS c FROM lnk GROUP BY 1, 2) o ON o.graph_id = a.graph_id AND o.src = a.atom)
"""
SEVEN = "min({x})::DOUBLE AS min, max({x})::DOUBLE AS max, round(avg({x}), 6) AS mean, quantile_cont({x}::DOUBLE, 0.25) AS q25, quantile_cont({x}::DOUBLE, 0.75) AS q75, quantile_cont({x}::DOUBLE, 0.5) AS median"


def query(sql: str | None = None, prefix: str = PREFIX):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return add


class Ensemble:
    """Relations, links and graphs of the ensemble, each made when it is asked for."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def graphs(self):
        return S.graph_table(self.spark, self.sf)

    @cached_property
    def tiles(self):
        return G.relation_tiles(S.points(self.spark, self.sf))

    @cached_property
    def relations(self):
        return T.edges(self.tiles)

    @cached_property
    def links(self):
        return G.links_of_tiles(self.tiles)


def edges(df):
    return df.select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def rounded(df, *names, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def longs(df, *names):
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


@query("SELECT graph_id, src, dst FROM rel")
def i2_relations_from_points(spark, sf):
    return edges(G.relations_from_points(S.points(spark, sf)))


@query("SELECT graph_id, src, dst FROM lnk")
def i1_transitive_reduction(spark, sf):
    return edges(Ensemble(spark, sf).links)


@query("SELECT graph_id, dst AS src, src AS dst FROM lnk")
def i3_reverse_links(spark, sf):
    return edges(G.reverse(Ensemble(spark, sf).links))


@query("SELECT graph_id, src, dst FROM lnk")
def i4_link_arrays_round_trip(spark, sf):
    e = Ensemble(spark, sf)
    return edges(G.arrays_to_links(G.links_to_arrays(e.links), e.graphs))


@query("SELECT graph_id, src, dst FROM lnk UNION ALL SELECT graph_id, dst, src FROM lnk")
def i5_symmetrised_links(spark, sf):
    return edges(G.symmetrise(Ensemble(spark, sf).links))


@query("SELECT graph_id, atom, in_degree, out_degree, degree FROM deg")
def g1_link_degrees(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return longs(G.degrees(links, graphs), "atom", "in_degree", "out_degree", "degree")


@query("SELECT g.graph_id, round(coalesce(c, 0) / (n * (n - 1) / 2), 6) AS connectivity FROM g LEFT JOIN (SELECT graph_id, count(*) AS c FROM rel GROUP BY 1) r USING (graph_id) WHERE n >= 2")
def g2_connectivity(spark, sf):
    e = Ensemble(spark, sf)
    relations, graphs = e.relations, e.graphs
    return rounded(G.connectivity(relations, graphs), "connectivity")


@query("SELECT graph_id, count(*) FILTER (in_degree = 0) AS num_sources, count(*) FILTER (out_degree = 0) AS num_sinks FROM deg GROUP BY 1")
def g3_sources_sinks(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return longs(G.sources_sinks(links, graphs), "num_sources", "num_sinks")


LEVELS = """, lev(graph_id, atom, h) AS (SELECT graph_id, atom, 0 FROM atoms UNION
  SELECT l.graph_id, l.{to}, h + 1 FROM lev JOIN lnk l ON l.graph_id = lev.graph_id AND l.{at} = lev.atom)
"""


@query(LEVELS.format(to="dst", at="src") + "SELECT graph_id, atom, max(h)::BIGINT AS height FROM lev GROUP BY 1, 2")
def g4_height_profile(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return longs(G.height_profile(links, graphs), "atom", "height")


@query(LEVELS.format(to="src", at="dst") + "SELECT graph_id, atom, max(h)::BIGINT AS height FROM lev GROUP BY 1, 2")
def g5_heights(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return longs(G.heights(links, graphs), "atom", "height")


@query(LEVELS.format(to="src", at="dst") + "SELECT lev.graph_id, lev.atom, max(h)::BIGINT AS height FROM lev JOIN deg USING (graph_id, atom) WHERE in_degree = 0 GROUP BY 1, 2")
def g6_source_heights(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return longs(G.source_heights(links, graphs), "atom", "height")


CARD = """, iv AS (SELECT r.graph_id, r.src, r.dst, count(y.dst) + 2 AS bin FROM rel r
  LEFT JOIN (SELECT x.graph_id, x.src, y.dst FROM rel x JOIN rel y ON x.graph_id = y.graph_id AND x.dst = y.src) y
  ON y.graph_id = r.graph_id AND y.src = r.src AND y.dst = r.dst GROUP BY 1, 2, 3),
card AS (SELECT graph_id, bin, count(*) AS weight FROM iv GROUP BY 1, 2 UNION ALL SELECT graph_id, 1, n FROM g)
"""


@query(CARD + "SELECT graph_id, bin, weight FROM card")
def g7_cardinalities(spark, sf):
    e = Ensemble(spark, sf)
    return longs(G.cardinalities_of_tiles(e.tiles, e.graphs), "bin", "weight")


@query(""", w(graph_id, a, b, k, c) AS (SELECT graph_id, atom, atom, 0, 1.0::DOUBLE FROM atoms UNION ALL
  SELECT graph_id, a, b, k, sum(c)::DOUBLE FROM (SELECT w.graph_id, w.a, l.dst AS b, w.k + 1 AS k, w.c / (w.k + 1) AS c FROM w JOIN lnk l ON l.graph_id = w.graph_id AND l.src = w.b) GROUP BY 1, 2, 3, 4)
SELECT graph_id, a AS atom, round(sum(c), 6) AS communicability FROM w GROUP BY 1, 2""")
def g8_communicability(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return rounded(longs(G.communicability(links, graphs), "atom"), "communicability")


@query("SELECT graph_id, degree AS bin, count(*) AS weight FROM deg GROUP BY 1, 2")
def g9_degree_histogram(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return longs(G.countmap(G.degrees(links, graphs), "degree"), "bin")


@query("SELECT graph_id, degree AS bin, count(*) AS weight FROM deg GROUP BY 1, 2 HAVING count(*) <> 0")
def g10_sparse_histogram(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    dense = G.countmap(G.degrees(links, graphs), "degree")
    return longs(G.sparse_hist(dense.unionByName(dense.select("graph_id", (F.col("bin") + 1000).alias("bin"), F.lit(0).cast("long").alias("weight")))), "bin")


@query("SELECT graph_id, " + SEVEN.format(x="degree") + " FROM deg GROUP BY 1")
def g11_degree_summary(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return rounded(G.summary(G.degrees(links, graphs), "degree"), "mean")


@query(CARD + "SELECT graph_id, " + SEVEN.format(x="weight") + " FROM card GROUP BY 1")
def g11_cardinality_summary(spark, sf):
    e = Ensemble(spark, sf)
    return rounded(G.summary(G.cardinalities_of_tiles(e.tiles, e.graphs), "weight"), "mean")


@query("""SELECT vec_id, count(*) FILTER (abs(x) <= 1e-10) AS num_zero, min(abs(x)) FILTER (abs(x) > 1e-10) AS min_abs_nonzero, min(x) AS min, max(x) AS max,
  round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.5), 6) AS median
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""", prefix="")
def g12_array_summary(spark, sf):
    out = G.spectrum_summary(S.table(spark, sf, "embeddings"), "embedding", "vec_id")
    return rounded(longs(out, "num_zero"), "mean", "q25", "q75", "median")


@query(""", e AS (SELECT graph_id, src, dst FROM lnk UNION ALL SELECT graph_id, dst, src FROM lnk),
lab(graph_id, atom, l) AS (SELECT graph_id, src, src FROM e UNION SELECT e.graph_id, e.dst, lab.l FROM lab JOIN e ON e.graph_id = lab.graph_id AND e.src = lab.atom WHERE lab.l < e.dst),
m AS (SELECT graph_id, atom, min(l) AS l FROM (SELECT * FROM lab UNION ALL SELECT graph_id, src, src FROM e) GROUP BY 1, 2)
SELECT graph_id, count(DISTINCT l) AS num_components FROM m GROUP BY 1""")
def g13_weak_components(spark, sf):
    return G.weak_components_of_tiles(Ensemble(spark, sf).tiles)


@query("""SELECT e.graph_id, e.src, e.dst, round(-1 / sqrt(a.degree * b.degree), 6) AS w
FROM (SELECT graph_id, src, dst FROM lnk UNION ALL SELECT graph_id, dst, src FROM lnk) e
JOIN deg a ON a.graph_id = e.graph_id AND a.atom = e.src JOIN deg b ON b.graph_id = e.graph_id AND b.atom = e.dst""")
def g14_laplacian_weights(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return rounded(longs(G.laplacian_weights(links, graphs), "src", "dst"), "w")


@query("""SELECT a.graph_id, a.atom, round(a.degree - coalesce(s, 0), 6) AS x FROM deg a LEFT JOIN
(SELECT e.graph_id, e.src, sum(y.degree / sqrt((x.degree * y.degree)::DOUBLE)) AS s FROM (SELECT graph_id, src, dst FROM lnk UNION ALL SELECT graph_id, dst, src FROM lnk) e
 JOIN deg x ON x.graph_id = e.graph_id AND x.atom = e.src JOIN deg y ON y.graph_id = e.graph_id AND y.atom = e.dst GROUP BY 1, 2) t ON t.graph_id = a.graph_id AND t.src = a.atom""")
def g14_laplacian_times_degrees(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    vector = G.degrees(links, graphs).select("graph_id", "atom", F.col("degree").cast("double").alias("x"))
    return rounded(longs(G.laplacian_times(links, graphs, vector), "atom"), "x")


@query()
def g15_largest_laplacian_eigenvalue(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return P.last_laplacian_eigenvalue(links, graphs)


@query()
def g15_first_nonzero_laplacian_eigenvalue(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return P.first_nonzero_laplacian_eigenvalue(links, graphs)


ENTRIES = """SELECT graph_id, src, dst, CASE WHEN d > 0 THEN round({s} / d, 6) ELSE 0 END AS w FROM (SELECT l.graph_id, l.src, l.dst, {deg} AS d FROM lnk l JOIN deg ON deg.graph_id = l.graph_id AND deg.atom = l.dst)
UNION ALL SELECT graph_id, dst, src, CASE WHEN d > 0 THEN round(-({s}) / d, 6) ELSE 0 END FROM (SELECT l.graph_id, l.src, l.dst, {deg} AS d FROM lnk l JOIN deg ON deg.graph_id = l.graph_id AND deg.atom = l.dst)"""


@query(ENTRIES.format(s="0.5::DOUBLE", deg="in_degree"))
def g16_antisymmetric_in(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return rounded(longs(G.antisymmetric_entries(links, graphs, "in"), "src", "dst"), "w")


@query(ENTRIES.format(s="-0.5::DOUBLE", deg="out_degree"))
def g16_antisymmetric_out(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return rounded(longs(G.antisymmetric_entries(links, graphs, "out"), "src", "dst"), "w").withColumn("w", F.col("w") + 0.0)


@query()
def g17_lowest_antisymmetric_eigenvalue(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return P.lowest_antisymmetric_eigenvalue(links, graphs)


@query("""SELECT g.graph_id, round(1 + 2 * coalesce(a, 0) / n, 6) AS laplacian_2, round(coalesce(b, 0) / 2, 6) AS antisymmetric_2 FROM g LEFT JOIN
(SELECT l.graph_id, sum(1.0::DOUBLE / (x.degree * y.degree)) AS a, sum(1.0::DOUBLE / (y.in_degree * y.in_degree)) AS b FROM lnk l JOIN deg x ON x.graph_id = l.graph_id AND x.atom = l.src
 JOIN deg y ON y.graph_id = l.graph_id AND y.atom = l.dst GROUP BY 1) s USING (graph_id)""")
def g18_spectral_moments(spark, sf):
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    return rounded(G.spectral_moments(links, graphs), "laplacian_2", "antisymmetric_2")


@query(""", f AS (SELECT d / 10.0::DOUBLE AS d, exp(lgamma(d / 10.0::DOUBLE + 1) + lgamma(d / 20.0::DOUBLE) - lgamma(3 * d / 20.0::DOUBLE)) / 2 AS f FROM range(10, 61) t(d)),
steps AS (SELECT d AS d1, f AS f1, lead(d) OVER (ORDER BY d) AS d2, lead(f) OVER (ORDER BY d) AS f2 FROM f),
con AS (SELECT g.graph_id, coalesce(c, 0) / (n * (n - 1) / 2) AS c FROM g LEFT JOIN (SELECT graph_id, count(*) AS c FROM rel GROUP BY 1) r USING (graph_id) WHERE n >= 2)
SELECT graph_id, round(c, 6) AS connectivity, round(d1 + (f1 - c) / (f1 - f2) * (d2 - d1), 6) AS dimension FROM con LEFT JOIN steps ON c <= f1 AND c > f2""")
def g19_relation_dimension(spark, sf):
    e = Ensemble(spark, sf)
    return rounded(G.relation_dimension(G.connectivity(e.relations, e.graphs)), "connectivity", "dimension")


@query("""SELECT g.graph_id, g.n, c_mktsegment AS cls, c_nationkey::DOUBLE AS scalar, round(CASE WHEN n >= 2 THEN coalesce(r.c, 0) / (n * (n - 1) / 2) END, 6) AS connectivity,
  link_degree_min, link_degree_max, link_degree_mean, link_degree_q25, link_degree_q75, link_degree_median
FROM g JOIN customer ON c_custkey = g.graph_id LEFT JOIN (SELECT graph_id, count(*) AS c FROM rel GROUP BY 1) r USING (graph_id)
LEFT JOIN (SELECT graph_id, min(degree)::DOUBLE AS link_degree_min, max(degree)::DOUBLE AS link_degree_max, round(avg(degree), 6) AS link_degree_mean, quantile_cont(degree::DOUBLE, 0.25) AS link_degree_q25,
  quantile_cont(degree::DOUBLE, 0.75) AS link_degree_q75, quantile_cont(degree::DOUBLE, 0.5) AS link_degree_median FROM deg GROUP BY 1) s USING (graph_id)""")
def g20_record(spark, sf):
    e = Ensemble(spark, sf)
    return rounded(G.record_of_tiles(e.tiles, e.graphs), "connectivity", "link_degree_mean")


_PARTS = {"degree": ("rdeg", "degree"), "link_degree": ("deg", "degree"), "height_profile": ("hts", "height"), "cardinalities": ("card", "weight")}


@query(
    LEVELS.format(to="dst", at="src") + CARD + """, rdeg AS (SELECT a.graph_id, a.atom, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM atoms a
  LEFT JOIN (SELECT graph_id, dst, count(*) AS c FROM rel GROUP BY 1, 2) i ON i.graph_id = a.graph_id AND i.dst = a.atom
  LEFT JOIN (SELECT graph_id, src, count(*) AS c FROM rel GROUP BY 1, 2) o ON o.graph_id = a.graph_id AND o.src = a.atom),
hts AS (SELECT graph_id, atom, max(h) AS height FROM lev GROUP BY 1, 2)
SELECT g.graph_id, g.n, c_mktsegment AS cls, c_nationkey::DOUBLE AS scalar, round(CASE WHEN n >= 2 THEN coalesce(r.c, 0) / (n * (n - 1) / 2) END, 6) AS connectivity, """
    + ", ".join(f"{p}.{c} AS {p}_{c}" for p in _PARTS for c in ("min", "max", "mean", "q25", "q75", "median"))
    + " FROM g JOIN customer ON c_custkey = g.graph_id LEFT JOIN (SELECT graph_id, count(*) AS c FROM rel GROUP BY 1) r USING (graph_id)"
    + "".join(f" LEFT JOIN (SELECT graph_id, {SEVEN.format(x=x)} FROM {t} GROUP BY 1) {p} USING (graph_id)" for p, (t, x) in _PARTS.items())
)
def g20_record_of_all_groups(spark, sf):
    e = Ensemble(spark, sf)
    return rounded(G.record_of_tiles(e.tiles, e.graphs, G.GROUPS), "connectivity", *[f"{p}_mean" for p in _PARTS])


@query("SELECT graph_id + 10000000 AS graph_id, src, dst FROM rel WHERE graph_id % 10 = 0 UNION ALL SELECT graph_id, dst, src FROM rel WHERE graph_id % 10 = 1 UNION ALL SELECT graph_id, src, dst + 1000 FROM rel WHERE graph_id % 10 = 2")
def s13_inconsistent_edges(spark, sf):
    """Of whole relations and broken ones (no such graph, turned round, no such atom), the broken ones."""
    e = Ensemble(spark, sf)
    r, graphs = e.relations, e.graphs
    wrong = r.filter("graph_id % 10 = 0").withColumn("graph_id", F.col("graph_id") + 10_000_000)
    wrong = wrong.unionByName(G.reverse(r.filter("graph_id % 10 = 1"))).unionByName(r.filter("graph_id % 10 = 2").withColumn("dst", F.col("dst") + 1000))
    return edges(G.inconsistent(r.unionByName(wrong), graphs))


@query("SELECT graph_id, n, c_mktsegment AS cls, c_nationkey::DOUBLE AS scalar, n::DOUBLE AS size FROM g JOIN customer ON c_custkey = graph_id")
def s9_sizes(spark, sf):
    return S.with_size(S.graph_table(spark, sf))


@query("SELECT g.graph_id, g.n, c_mktsegment AS cls, c_nationkey::DOUBLE AS scalar, round(CASE WHEN n >= 2 THEN coalesce(r.c, 0) / (n * (n - 1) / 2) END, 6) AS connectivity FROM g JOIN customer ON c_custkey = g.graph_id LEFT JOIN (SELECT graph_id, count(*) AS c FROM rel GROUP BY 1) r USING (graph_id)")
def s11_pruned_record(spark, sf):
    """Only the requested group is computed and returned."""
    e = Ensemble(spark, sf)
    relations, graphs = e.relations, e.graphs
    return rounded(G.record(relations, graphs, ("connectivity",)), "connectivity")


KINDS = {"BUILDING": ["scalar"], "MACHINERY": [], "FURNITURE": ["scalar", "cls"]}


@query("SELECT graph_id, n, c_nationkey::DOUBLE AS scalar FROM g JOIN customer ON c_custkey = graph_id WHERE c_mktsegment = 'BUILDING'")
def s12_kind_columns(spark, sf):
    return S.of_kind(S.graph_table(spark, sf), "BUILDING", KINDS)


def _folder(spark, name):
    return f"{G.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT graph_id, n, c_mktsegment AS kind, 100.0::DOUBLE AS batchsize FROM g JOIN customer ON c_custkey = graph_id")
def s10_statistics_sink(spark, sf):
    path = _folder(spark, "statistics")
    S.write_statistics(S.graph_table(spark, sf).select("graph_id", "n", F.col("cls").alias("kind")), path, "kind", {"batchsize": 100})
    return S.read_statistics(spark, path).select("graph_id", "n", "kind", "batchsize")


@query("SELECT n, count(*) AS graphs FROM g GROUP BY 1")
def s14_csv_sink(spark, sf):
    path = _folder(spark, "rows")
    S.write_rows(S.graph_table(spark, sf).groupBy("n").agg(F.count("*").alias("graphs")), path)
    return spark.read.option("header", True).schema("n long, graphs long").csv(path)


@query("SELECT graph_id, n, 8 AS size, 100 AS count FROM g WHERE n <= 8 UNION ALL SELECT graph_id, n, 16, 200 FROM g WHERE n <= 16")
def s15_size_scan(spark, sf):
    root, graphs = _folder(spark, "sizes"), S.graph_table(spark, sf).select("graph_id", "n")
    for kind, size, count in (("sprinkled", 8, 100), ("sprinkled", 16, 200), ("layered", 8, 100)):
        graphs.filter(F.col("n") <= size).write.parquet(f"{root}/{kind}_{size}_{count}")
    return S.size_scan(spark, root, "sprinkled")


@query("SELECT graph_id, bin, round(weight / sum(weight) OVER (PARTITION BY graph_id), 6) AS weight FROM (SELECT graph_id, degree AS bin, count(*) AS weight FROM deg GROUP BY 1, 2)")
def s16_named_observable(spark, sf):
    """The histogram that the catalogue names for link degrees."""
    e = Ensemble(spark, sf)
    links, graphs = e.links, e.graphs
    field, _, mode = S.observable("link_degree")
    hist = G.countmap(G.degrees(links, graphs), field).withColumn("weight", F.col("weight").cast("double"))
    return rounded(longs(H.normalize(hist, mode, "graph_id"), "bin"), "weight")
