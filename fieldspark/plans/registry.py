"""Planning queries over the demo points; equal SQL is in oracle.py."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance, haversine, morton, projected
from ..operators import areas, chains, colouring, contiguity, focus, growth, outputs, placement, power, territories, units, workload
from ..operators.components import components
from ..operators.knn import knn
from ..operators.outliers import with_outliers
from ..operators.proximity import gabriel
from ..operators.ranking import ranked, upper_median
from ..operators.workload import SUBSET, min_per_km, with_travel, with_visit_load
from ..sources import regions
from ..sources.points import demo_points, valid
from ..sources.shared import kept, written
from . import plan
from .params import Params

P = Params()
CAP = P.capacity_hours * 60
AREA = "coalesce(area, '(no area)')"
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(c, n: int = 4, name: str | None = None):
    return F.round(c, n).alias(name or c)


def _pts(spark, sf) -> DataFrame:
    return valid(demo_points(spark, sf)).withColumn("id", F.col("k"))


def _global(spark, sf) -> DataFrame:
    return projected(with_visit_load(_pts(spark, sf)))


def _near(spark, sf, k: int) -> DataFrame:
    """The 30 nearest of every client among all, kept by content; k of them."""
    return kept(_global(spark, sf).select("id", "x", "y"), "near", 30, lambda p: knn(p, 30)).filter(F.col("rank") <= k)


def _regions(spark, sf) -> DataFrame:
    return kept([_pts(spark, sf), regions.demo_rings(spark, sf)], "regions", None, regions.with_regions)


def _model(spark, sf) -> DataFrame:
    """Clients with region, field area and travel."""
    return kept(_regions(spark, sf), "model", P, lambda p: with_travel(areas.field_areas(p), P))


def _replay(spark, sf) -> DataFrame:
    """A given assignment: nations as territories with given centres, their regions as areas; one client in 53 has none."""

    of = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_regionkey").cast("int").alias("area_id"))

    def build(p: DataFrame, of: DataFrame, rings: DataFrame) -> DataFrame:
        has = p.withColumn("territory", F.when(F.col("k") % 53 != 0, F.col("nk"))).drop("area")
        assigned = has.filter("territory is not null").join(of, "nk").withColumn("area", F.concat(F.lit("R"), F.col("area_id").cast("string")))
        model = workload.postal_starts(with_travel(assigned, P), P)
        base = rings.select(F.col("state_id").cast("long").alias("territory"), F.col("ring")[0].alias("a"), F.col("ring")[2].alias("b"))
        base = base.select("territory", ((F.col("a.lat") + F.col("b.lat")) / 2).alias("base_lat"), ((F.col("a.lon") + F.col("b.lon")) / 2).alias("base_lon"))
        out = workload.with_load(model, "territory", base)
        whole = workload.with_load(model, "territory", base, "from_lat", "from_lon").select("id", F.col("load").alias("load_postal"))
        rest = with_visit_load(has.filter("territory is null"))
        rest = rest.withColumn("load", F.col("visit_load")).withColumn("load_postal", F.col("visit_load"))
        return out.join(whole, "id").unionByName(rest, allowMissingColumns=True)

    return kept([_regions(spark, sf), of, regions.demo_rings(spark, sf)], "replay", P, build)


@query
def points_valid(spark, sf):
    return valid(demo_points(spark, sf))


@query
def points_ordered_topk(spark, sf):
    return points_valid(spark, sf).orderBy("customer_id").limit(100).select("k", "customer_id")


@query
def workload_per_client(spark, sf):
    return with_visit_load(_pts(spark, sf)).select("k", "v", "m", r("visit_load"))


@query
def projected_points(spark, sf):
    return _global(spark, sf).select("k", r("x"), r("y"))


@query
def speed_min_per_km(spark, sf):
    return _pts(spark, sf).select("k", r(min_per_km(P), 6, "min_per_km"))


@query
def visit_sizing_rollup(spark, sf):
    """Salespeople needed per area before travel, with the total (area null)."""
    pts = with_visit_load(_pts(spark, sf)).withColumn("area_name", F.expr(AREA))
    out = pts.rollup("area_name").agg(F.sum("visit_load").alias("s"), F.count(F.lit(1)).alias("n_clients"))
    return out.select(F.col("area_name").alias("area"), F.round(F.col("s") / 60, 3).alias("hours"), F.round(F.col("s") / 60 / P.capacity_hours, 3).alias("salespeople"), "n_clients")


@query
def bounding_box(spark, sf):
    return _pts(spark, sf).groupBy(F.expr(AREA).alias("area")).agg(r(F.avg("lat"), 6, "lat"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")])


def _density(spark, sf) -> DataFrame:
    """Points with cx, cy and dens, the visit load of the 3 x 3 cells around; a cell has the side of four clients' mean spacing."""
    pts = _global(spark, sf)
    box = pts.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.lit(1.0), (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("km2"), F.count(F.lit(1)).alias("n"))
    pts = pts.crossJoin(F.broadcast(box.withColumn("cell", F.greatest(F.lit(0.5), F.sqrt(F.col("km2") / F.col("n")) * 4))))  # one row
    pts = pts.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / F.col("cell"))).withColumn("cy", F.floor((F.col("y") - F.col("y0")) / F.col("cell")))
    cells = pts.groupBy("cx", "cy").agg(F.sum("visit_load").alias("load"), F.count(F.lit(1)).alias("clients"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = cells.withColumn("i", steps).withColumn("j", steps).groupBy((F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy")).agg(F.sum("load").alias("dens"))
    return pts.join(cells.join(around, ["cx", "cy"]), ["cx", "cy"])


@query
def bbox_density_cells(spark, sf):
    return _density(spark, sf).groupBy("cx", "cy").agg(F.first("clients").alias("n"), r(F.first("load"), 3, "load"), r(F.first("dens"), 3, "density"))


@query
def density_order(spark, sf):
    """Every client's place from the densest, ties by id."""
    rows = _density(spark, sf).select("k", r("dens", 3, "d"))
    return ranked(rows, F.desc("d"), "k", name="place").select("k", "place")


@query
def knn_30(spark, sf):
    return _near(spark, sf, 30).groupBy("id").agg(F.count(F.lit(1)).alias("n"), r(F.max(F.sqrt("d2")), 4, "far_km"))


@query
def knn_counts(spark, sf):
    return _near(spark, sf, 30).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.sqrt("d2")), 6, "mean_km"))


@query
def knn_symmetric_degree(spark, sf):
    near = _near(spark, sf, 5).select("id", "other")
    both = near.unionByName(near.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query
def outliers_third_nn(spark, sf):
    return with_outliers(_global(spark, sf), 25).select("k", "is_outlier")


@query
def outlier_count(spark, sf):
    """How many are outliers, and the clients and visit hours that go on without them."""
    out = with_outliers(_global(spark, sf), 25)
    return out.agg(F.count_if("is_outlier").alias("outliers"), F.count_if(~F.col("is_outlier")).alias("rest"), r(F.sum(F.when(~F.col("is_outlier"), F.col("visit_load"))) / 60, 3, "hours"))


@query
def field_area_ids(spark, sf):
    return areas.field_areas(_pts(spark, sf)).groupBy("area", "area_id").agg(F.count(F.lit(1)).alias("n"))


@query
def hop_minutes(spark, sf):
    return _model(spark, sf).select("k", r("hop"))


@query
def visits_per_day_tpk(spark, sf):
    return _model(spark, sf).select("k", *[r(c) for c in ("hop", "per_day", "tpk")])


@query
def single_client_travel(spark, sf):
    """Clients alone in their code, each code modelled apart."""
    pts = _pts(spark, sf)
    model = kept(pts, "codes", P, lambda p: with_travel(p, P, ["postal"]))
    alone = pts.groupBy("postal").agg(F.count(F.lit(1)).alias("c")).filter("c = 1")
    return model.join(alone, "postal", "left_semi").select("k", r("hop"), r("tpk", 6))


@query
def load_replay(spark, sf):
    return _replay(spark, sf).select("k", r("load", 3))


@query
def load_replay_postal(spark, sf):
    return _replay(spark, sf).select("k", r("load_postal", 3, "load"))


@query
def territory_stats(spark, sf):
    out = workload.territory_stats(_replay(spark, sf), "territory", P.capacity_hours)
    return out.select("territory", "n", r("hours", 3), r("visit_hours", 3), r("deviation_pct", 3))


@query
def area_sizing(spark, sf):
    out = workload.area_sizing(_replay(spark, sf), P.capacity_hours)
    return out.select("area", r("hours", 3), "territories", r("salespeople", 3))


@query
def sizing_rollup(spark, sf):
    out = _replay(spark, sf).filter("territory is not null").rollup("area").agg(F.sum("load").alias("s"), F.sum("visit_load").alias("v"))
    return out.select("area", r(F.col("s") / 60, 3, "hours"), r(F.col("v") / 60, 3, "visit_hours"), r(F.col("s") / CAP, 3, "salespeople"))


@query
def travel_share(spark, sf):
    """Of assigned clients; and the share of territories within the capacity."""
    out = _replay(spark, sf).filter("territory is not null").groupBy("territory").agg(F.sum("load").alias("s"), F.sum("visit_load").alias("v"))
    return out.agg(r(F.sum(F.col("s") - F.col("v")) / F.sum("s"), 6, "travel_share"), r(F.avg((F.col("s") <= CAP).cast("double")), 6, "within"))


@query
def area_badges(spark, sf):
    out = _replay(spark, sf).filter("territory is not null").groupBy("area").agg(F.sum("load").alias("s"), *[(F.sum(F.col(c) * F.col("load")) / F.sum("load")).alias(c) for c in ("lat", "lon")])
    return out.select("area", r("lat", 5), r("lon", 5), r(F.col("s") / CAP, 1, "badge"))


@query
def cv_of_zone_loads(spark, sf):
    return _replay(spark, sf).filter("territory is not null").groupBy("territory").agg(F.sum("load").alias("s")).agg(r(F.stddev_pop("s") / F.avg("s"), 6, "cv"))


@query
def inertia(spark, sf):
    """Load-weighted squared distance from the centre of each territory, and the lexicographic cost: minutes above the capacity, then travel."""
    rows = _replay(spark, sf).filter("territory is not null").withColumn("base", F.col("v") * (F.col("m") + F.col("hop")))
    m = territories.moments(rows.withColumn("part", F.col("territory")), ["part"])
    cost = rows.groupBy("territory").agg(F.sum("load").alias("s"), F.sum(F.col("load") - F.col("v") * (F.col("m") + F.col("hop"))).alias("t"))
    return m.join(cost, F.col("part") == F.col("territory")).select("territory", r(F.col("sxx") + F.col("syy"), 1, "inertia"), r(F.greatest(F.col("s") - CAP, F.lit(0.0)), 3, "over"), r("t", 3, "travel"))


@query
def postal_extent_split(spark, sf):
    return units.extents(_global(spark, sf), ["postal"]).select("postal", r("extent", 4, "extent_km"), "n", (F.col("extent") > 25).alias("wide"))


@query
def split_codes(spark, sf):
    return units.extents(_global(spark, sf), ["postal"]).agg(F.count_if(F.col("extent") > 25).alias("split"), F.count(F.lit(1)).alias("codes"))


@query
def postal_coherence(spark, sf):
    """Of the codes as they are, and of codes that have nothing to do with place."""
    pts = _global(spark, sf)
    one = lambda name, p: units.coherence(p).select(F.lit(name).alias("codes"), "clients", r("coherence", 6), "ignored")
    return one("cells", pts).unionByName(one("numbers", pts.withColumn("postal", (F.col("k") % 50).cast("string"))))


@query
def weighted_mode_area(spark, sf):
    pts = with_visit_load(_pts(spark, sf)).select("postal", F.expr(AREA).alias("area"), F.col("visit_load").alias("w"))
    return units.majority(pts, ["postal"], "area")


@query
def unit_rollup(spark, sf):
    pts = with_visit_load(_pts(spark, sf)).select("postal", F.col("lat").alias("y"), F.col("lon").alias("x"), F.col("visit_load").alias("w"))
    return units.rollup_units(pts, ["postal"]).select("postal", r("y", 5, "lat"), r("x", 5, "lon"), r("weight", 4))


@query
def postal_unit_rollup(spark, sf):
    """Codes as units of territories: visits, mean minutes with hops, mean trip minutes per km, centre."""
    out = territories.unit_rows(territories.postal_units(_model(spark, sf), SUBSET, P.capacity_hours), SUBSET)
    return out.select(*SUBSET, "unit", "n", *[r(c, 3) for c in ("v", "minutes", "tpk", "x", "y")])


@query
def towns_components(spark, sf):
    return units.towns(_global(spark, sf)).select("id", "town")


@query
def unit_keys(spark, sf):
    """Codes that span a country are split by towns."""
    return units.unit_keys(_global(spark, sf).select("id", "x", "y", F.col("nk").cast("string").alias("postal"))).select("id", "unit")


@query
def solver_towns(spark, sf):
    """Clients linked by steps of at most twice the upper median of the fifth neighbours' distances."""
    near = _near(spark, sf, 10)
    eps = upper_median(near.filter("rank = 5").withColumn("d", F.sqrt("d2")), "d")
    links = near.crossJoin(F.broadcast(eps)).filter(F.sqrt("d2") <= 2 * F.col("median"))  # one row
    label = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return _pts(spark, sf).select("id").join(label.select(F.col("a").alias("id"), "class"), "id", "left").select("id", F.coalesce("class", "id").alias("town"))


@query
def land_groups(spark, sf):
    return regions.land_groups(regions.demo_rings(spark, sf), regions.demo_adjacency(spark, sf))


@query
def region_of_point(spark, sf):
    return regions.in_rings(_pts(spark, sf), regions.demo_rings(spark, sf)).select("id", "state_id", "land_id")


@query
def region_nearest_fill(spark, sf):
    return _regions(spark, sf).select("id", "state_id", "land_id")


@query
def regions_unresolved(spark, sf):
    """Points in no ring."""
    return _pts(spark, sf).select("id").join(regions.in_rings(_pts(spark, sf), regions.demo_rings(spark, sf)), "id", "left_anti")


@query
def states_touch_pairs(spark, sf):
    s = regions.demo_rings(spark, sf).select("state_id").unionByName(spark.range(1).select(F.lit(-1).alias("state_id")))
    return regions.touching(s.select(F.col("state_id").alias("s")).crossJoin(F.broadcast(s.select(F.col("state_id").alias("t")))), regions.demo_adjacency(spark, sf))  # all pairs of 26 states, as asked


def _units(spark, sf) -> DataFrame:
    """Codes as units of areas: weight, centre, state by majority, land group."""
    pts = with_visit_load(_regions(spark, sf)).withColumn("w", F.col("visit_load") + 1e-9)
    pts = projected(pts)
    state = units.majority(pts.filter("state_id >= 0"), ["postal"], "state_id")
    group = regions.land_groups(regions.demo_rings(spark, sf), regions.demo_adjacency(spark, sf))
    out = units.rollup_units(pts, ["postal"]).join(state, "postal", "left").join(group, "state_id", "left")
    return out.select(F.col("postal").alias("unit"), "n", "weight", "x", "y", F.coalesce("state_id", F.lit(-1)).alias("state_id"), F.coalesce("group_id", F.lit(-1)).alias("group_id"))


@query
def unit_states(spark, sf):
    return _units(spark, sf).select("unit", "n", "state_id", "group_id")


@query
def land_group_loads(spark, sf):
    return areas.main_group(_units(spark, sf)).select("group_id", r("load", 3), "is_main")


@query
def island_areas_named(spark, sf):
    return areas.islands(_units(spark, sf), regions.demo_rings(spark, sf))


def _unit_points(spark, sf) -> DataFrame:
    return projected(_regions(spark, sf)).select("id", "x", "y", F.col("postal").alias("unit"), "state_id")


def _unit_areas(spark, sf) -> DataFrame:
    """Units in areas that are not compact: by the remainder of their state."""
    return _units(spark, sf).withColumn("area", F.pmod("state_id", F.lit(4)).cast("int"))


def _unit_edges(spark, sf) -> DataFrame:
    return kept([_unit_points(spark, sf), _units(spark, sf), regions.demo_adjacency(spark, sf)], "unit-edges", None, areas.unit_edges)


@query
def proximity_edges(spark, sf):
    """Gabriel graph of all clients, those of one spot linked to its least id."""
    return gabriel(_global(spark, sf)).select("id", "other", r(F.sqrt("d2"), 4, "km"))


@query
def unit_adjacency(spark, sf):
    return _unit_edges(spark, sf).select("u", "v", r("km"))


@query
def cut_edges(spark, sf):
    return areas.cut_edges(_unit_areas(spark, sf), _unit_edges(spark, sf))


@query
def area_pieces(spark, sf):
    at = areas.pieces(_unit_areas(spark, sf), _unit_edges(spark, sf))
    return at.groupBy("area", "piece").agg(F.count(F.lit(1)).alias("units"))


@query
def stray_vote(spark, sf):
    out = areas.stray_vote(_unit_areas(spark, sf), _unit_points(spark, sf), regions.demo_adjacency(spark, sf))
    return out.select("unit", "area", "vote", r("share", 6), (F.col("share") > 0.6).alias("moves"))


def _auto(spark, sf) -> DataFrame:
    build = lambda *tables: areas.automatic(*tables, 5)
    return kept([_units(spark, sf), _unit_points(spark, sf), regions.demo_adjacency(spark, sf), regions.demo_rings(spark, sf)], "auto", 5, build)


@query
def auto_areas(spark, sf):
    out = _units(spark, sf).join(_auto(spark, sf), "unit")
    return out.groupBy("area_id", "area").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("clients"), r(F.sum("weight") / 60, 3, "hours"))


@query
def auto_area_repair(spark, sf):
    """Pieces of every automatic area after repair."""
    at = _units(spark, sf).join(_auto(spark, sf).select("unit", F.col("area_id").alias("area")), "unit")
    got = areas.pieces(at, _unit_edges(spark, sf))
    return got.groupBy("area").agg(F.countDistinct("piece").alias("pieces"))


def _divided(spark, sf) -> DataFrame:
    return territories.clients(_model(spark, sf), SUBSET).withColumn("part", F.concat_ws(":", *SUBSET))


@query
def principal_axis(spark, sf):
    """Of each area and landmass, as an angle from the x axis, where it has two clients at least."""
    out = territories.with_axis(territories.moments(_divided(spark, sf), SUBSET)).filter("n > 1")
    return out.select(*SUBSET, "n", r("gx", 3), r("gy", 3), r(F.atan(F.col("ay") / F.col("ax")), 6, "angle"))


@query
def bisection_round1(spark, sf):
    """The first cut of every area and landmass above the capacity."""
    rows = _divided(spark, sf)
    stats = territories.loads(rows, ["part"])
    open_ = stats.filter((F.col("load") > CAP) & (F.col("n") > 1)).withColumn("k", territories.needed(F.col("load"), CAP))
    return territories.cut(rows, open_).select("id", "second")


def _solved(spark, sf) -> DataFrame:
    """Clients with their territory (numbered by area, land and part), its centre and load."""

    def build(model: DataFrame) -> DataFrame:
        parts = written(territories.territories(territories.clients(model, SUBSET), SUBSET, CAP), "solved-parts")
        ids = ranked(parts.select(*SUBSET, "part").distinct(), *SUBSET, "part", name="territory").select("part", (F.col("territory") - 1).alias("territory"))
        pts = model.join(parts.select("id", "part").join(ids, "part"), "id")
        return workload.with_load(pts, "territory", workload.centres(pts, "territory")).withColumn("is_outlier", F.lit(False))

    return kept(_model(spark, sf), "solved", P, build)


@query
def territories_bisect(spark, sf):
    out = workload.territory_stats(_solved(spark, sf), "territory", P.capacity_hours)
    return out.select("territory", "n", r("hours", 3), r("visit_hours", 3), r("deviation_pct", 3))


@query
def area_sizing_bisect(spark, sf):
    out = workload.area_sizing(_solved(spark, sf), P.capacity_hours)
    return out.select("area", r("hours", 3), "territories", r("salespeople", 3))


def _filled(spark, sf) -> DataFrame:
    """Clients with their territory by the power diagram, its centre and load; clients of no territory are those set apart before."""

    def build(model: DataFrame) -> DataFrame:
        rows = written(power.solved(territories.clients(model, SUBSET), SUBSET, CAP), "filled-parts")
        ids = ranked(rows.select(*SUBSET, "part").distinct(), *SUBSET, "part", name="territory").select("part", (F.col("territory") - 1).alias("territory"))
        return model.join(rows.select("id", "part", "gx", "gy", "load").join(ids, "part"), "id").withColumn("is_outlier", F.lit(False))

    return kept(_model(spark, sf), "filled", P, build)


@query
def territories_power(spark, sf):
    out = workload.territory_stats(_filled(spark, sf), "territory", P.capacity_hours)
    return out.select("territory", "n", r("hours", 3), r("visit_hours", 3), r("deviation_pct", 3))


@query
def area_sizing_power(spark, sf):
    out = workload.area_sizing(_filled(spark, sf), P.capacity_hours)
    return out.select("area", r("hours", 3), "territories", r("salespeople", 3))


def _priced(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Clients with candidates, and the nations' centres with prices."""
    pts = _global(spark, sf)
    centres = pts.groupBy(F.col("nk").alias("c")).agg(F.avg("x").alias("gx"), F.avg("y").alias("gy")).withColumn("set", F.lit("")).withColumn("w", (F.col("c") % 5) * 300.0)
    rows = pts.select(F.lit("").alias("set"), "id", "x", "y", F.col("visit_load").alias("base"), (F.col("v") * 0.5).alias("trip"))
    return power.candidates(rows, centres), centres


@query
def priced_assignment(spark, sf):
    """Of every client's eight nearest centres the one of least squared distance plus price."""
    return power.priced(*_priced(spark, sf)).select("id", "c", r("p", 3))


@query
def ascent_step(spark, sf):
    """Prices and places of the centres after one step of dual ascent."""
    near, centres = _priced(spark, sf)
    out = power.ascended(centres, power.totals(power.priced(near, centres)))
    return out.select("c", "n", r("load", 2), r("w2", 3, "price"), r("gx2", 4, "gx"), r("gy2", 4, "gy"))


@query
def chain_costs(spark, sf):
    """The cheapest chain of at most six clients from nation to nation, from each way out, that ends where there is room."""
    pts = _global(spark, sf)
    at = pts.groupBy(F.col("nk").alias("c")).agg(F.avg("x").alias("gx"), F.avg("y").alias("gy")).withColumn("set", F.lit(""))
    rows = pts.select(F.lit("").alias("set"), "id", "x", "y", F.col("visit_load").alias("base"), (F.col("v") * 0.5).alias("trip"))
    options = written(power.options_of(rows, at, pts.select("id", F.col("nk").alias("c")), 3), "chain-options")
    moves, loads = chains.state(options, pts.select("id", F.col("nk").alias("c")))
    cap = loads.agg(F.avg("load")).first()[0] * 1.02
    return chains.chain_costs(chains.ways_out(moves), loads, cap).select("a", "b", r("total"))


@query
def placement_gains(spark, sf):
    """Moves and swaps of clients that their ten nearest outvote, codes as territories of at most 1.02 mean loads: change of misplaced clients and of pairs in one territory."""
    pts = _global(spark, sf)
    at = pts.groupBy(F.col("postal").alias("c")).agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    rows = written(pts.select("id", F.col("postal").alias("c"), "x", "y", F.col("visit_load").alias("base"), (F.col("v") * 0.5).alias("trip")), "gains-rows")
    amount = placement.amounts(rows.drop("c"), at)
    cap = amount(rows.select("id", "c")).groupBy("c").agg(F.sum("amount").alias("s")).agg(F.avg("s")).first()[0] * 1.02
    return placement.gains(_near(spark, sf, 10), rows.select("id", "c"), amount, cap).select("i", "b", "j", F.col("bad").cast("int"), F.col("pairs").cast("int"))


def _improved(spark, sf) -> DataFrame:
    """The filled territories after the local search: id, territory, before and load."""

    def build(model: DataFrame, full: DataFrame) -> DataFrame:
        rows = written(territories.clients(model, SUBSET), "improved-rows")
        homes = full.select("id", F.col("territory").alias("c"))
        near = knn(rows, 10, SUBSET).select("id", "other")
        amount = placement.amounts(rows, full.select(F.col("territory").alias("c"), "gx", "gy").distinct())
        ends = placement.placed(near, homes, amount, CAP, rounds=12)
        was, now = (placement.misplaced(near, h).withColumn(n, F.lit(1)) for h, n in ((homes, "was"), (ends, "now")))
        out = amount(ends).select("id", F.col("c").alias("territory"), F.col("amount").alias("load"))
        return out.join(homes.withColumnRenamed("c", "before"), "id").join(was, "id", "left").join(now, "id", "left").fillna(0, ["was", "now"]).join(model.select("id", "area_id", "area"), "id")

    return kept([_model(spark, sf), _filled(spark, sf)], "improved", P, build)


@query
def territories_placed(spark, sf):
    """Of each area the clients that moved and those misplaced before and after the local search."""
    per = _improved(spark, sf).groupBy("area_id", "area", "territory").agg(F.count_if(F.col("territory") != F.col("before")).alias("moved"), F.sum("was").alias("before"), F.sum("now").alias("after"), F.sum("load").alias("load"))
    return per.groupBy("area").agg(F.count(F.lit(1)).alias("territories"), F.sum("moved").alias("moved"), F.sum("before").alias("misplaced_before"), F.sum("after").alias("misplaced"), r(F.max("load") / 60, 3, "largest_hours"))


@query
def town_need(spark, sf):
    """Places of several clients with their load from their own centres: it is a town from half a capacity on; and how many territories it needs."""
    model = _model(spark, sf).select("id", (F.col("v") * (F.col("m") + F.col("hop"))).alias("base"), (F.col("v") * F.col("tpk")).alias("trip"))
    rows = written(_global(spark, sf).select("id", "x", "y").join(model, "id").join(units.towns(_global(spark, sf)), "id"), "town-rows")
    load = territories.loads(rows, ["town"]).filter("n > 1")
    return load.select("town", "n", r(F.col("load") / 60, 3, "hours"), (F.col("load") >= CAP / 2).alias("is_town"), F.greatest(F.lit(1), F.ceil(F.col("load") / (0.97 * CAP))).cast("int").alias("need"))


@query
def territory_colours(spark, sf):
    """Codes as territories of their areas: no two of one area share a colour of which one is among the six nearest of the other."""
    at = _unit_areas(spark, sf).select("area", F.col("unit").alias("name"), "x", "y")
    return colouring.coloured(at, colouring.conflicts(at, ["area"])).select("name", "colour")


@query
def cut_vertices(spark, sf):
    """Units without which their area's piece falls apart."""
    at = _unit_areas(spark, sf).select("unit", "area")
    of = lambda u, a: at.select(F.col("unit").alias(u), F.col("area").alias(a))
    inner = _unit_edges(spark, sf).join(of("u", "au"), "u").join(of("v", "av"), "v").filter("au = av")
    return contiguity.cut_vertices(inner.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("v").alias("unit"))


@query
def seed_distances(spark, sf):
    """Of every code that the first codes of the states reach over neighbouring codes: the nearest of them and the way there."""
    seeds = _units(spark, sf).groupBy("state_id").agg(F.min("unit").alias("node")).select(F.col("node").alias("seed"), "node")
    edges = _unit_edges(spark, sf).select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("km").alias("w"))
    return growth.distances(edges, seeds, delta=400.0).select(F.col("node").alias("unit"), "seed", r("dist", 3, "km"))


def _grown(spark, sf) -> DataFrame:
    """Units (whole codes, and clients of codes too large) of each area and landmass with the territory that grew to them over the clients' neighbour graph."""

    def build(model: DataFrame, points: DataFrame) -> DataFrame:
        pts = written(territories.postal_units(model, SUBSET, P.capacity_hours).withColumn("unit", F.concat_ws("|", *SUBSET, "unit")), "grown-points")
        units = written(territories.unit_rows(pts, SUBSET).withColumnRenamed("unit", "id"), "grown-units")
        of = lambda i, u: pts.select(F.col("id").alias(i), F.col("unit").alias(u))
        pairs = gabriel(points).join(of("id", "a"), "id").join(of("other", "b"), "other").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        at = lambda u: units.select(F.col("id").alias(u), F.struct("x", "y").alias(f"at_{u}"))
        far = F.hypot(F.col("at_a.x") - F.col("at_b.x"), F.col("at_a.y") - F.col("at_b.y"))
        return growth.territories(units.select(*SUBSET, "id", "n", "x", "y", "base", "trip"), pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", far.alias("w")), SUBSET, CAP)

    return kept([_model(spark, sf), _global(spark, sf).select("id", "x", "y")], "grown", P, build)


@query
def territories_grown(spark, sf):
    """Territories of whole units that hang together: units, clients and hours, travel from the unit where each began to grow."""
    per = _grown(spark, sf).groupBy(*SUBSET, "part").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("clients"), r(F.sum("amount") / 60, 3, "hours"))
    return per.withColumnRenamed("part", "grown_from")


@query
def solved_assignment(spark, sf):
    return outputs.assignment_lines(_planned(spark, sf))


@query
def solved_client_detail(spark, sf):
    out = outputs.client_detail(_planned(spark, sf))
    return out.select("customer_id", "area", "territory", "postal", *[r(c, 3) for c in ("load_hours", "visit_hours", "travel_hours")])


@query
def solved_diagnostics(spark, sf):
    rows, pts = demo_points(spark, sf), _global(spark, sf)
    out = outputs.diagnostics(rows, _planned(spark, sf), units.coherence(pts), units.extents(pts, ["postal"]).filter("extent > 25"))
    return out.select("n_rows", "n_points", "n_dropped", "n_outliers", r("travel_share", 6), r("coherence", 6), "ignored", "postal_split")


def _planned(spark, sf) -> DataFrame:
    """The whole plan of the demo table: its columns by role, clients farther than 40 km from their third neighbour set apart, areas by the field, territories filled."""
    raw = demo_points(spark, sf).withColumn("id", F.col("k"))
    settings = Params(outlier_km=40)
    return kept([raw, regions.demo_rings(spark, sf), regions.demo_adjacency(spark, sf)], "planned", settings, lambda *t: plan.planned(*t, settings))


@query
def territories_whole_postal(spark, sf):
    out = kept(_model(spark, sf), "postal", P, lambda m: territories.whole_postal(m, SUBSET, P.capacity_hours))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("postal").alias("codes"), r(F.sum("load") / 60, 3, "hours"))


@query
def territory_hulls(spark, sf):
    out = outputs.territory_shapes(_replay(spark, sf))
    return out.select("territory", "clients", r("hours", 3), "colour", F.array_join(F.transform("hull", lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])), ",").alias("hull"))


@query
def client_detail(spark, sf):
    out = outputs.client_detail(_replay(spark, sf))
    return out.select("customer_id", "area", "territory", "postal", *[r(c, 3) for c in ("load_hours", "visit_hours", "travel_hours")])


@query
def assignment_export(spark, sf):
    return outputs.assignment_lines(_replay(spark, sf).withColumn("is_outlier", F.col("k") % 2 == 0).withColumn("load", F.round("load", 3)))


@query
def diagnostics(spark, sf):
    rows, pts = demo_points(spark, sf), _global(spark, sf)
    wide = units.extents(pts, ["postal"]).filter("extent > 25")
    out = outputs.diagnostics(rows, _replay(spark, sf).withColumn("is_outlier", F.col("territory").isNull()), units.coherence(pts), wide)
    return out.select("n_rows", "n_points", "n_dropped", "n_outliers", r("travel_share", 6), r("coherence", 6), "ignored", "postal_split")


def _centres(spark, sf) -> DataFrame:
    pts = _global(spark, sf)
    return pts.groupBy("nk").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select((-1 - F.col("nk")).alias("id"), "x", "y")


@query
def nearest_centre(spark, sf):
    """The three nearest of the nations' centres to every client."""
    near = knn(_centres(spark, sf), 3, seekers=_global(spark, sf).select("id", "x", "y"))
    return near.select("id", (-1 - F.col("other")).alias("centre"), "rank", r(F.sqrt("d2"), 4, "km"))


@query
def nearest_zones(spark, sf):
    """The five nearest centres of each centre."""
    return knn(_centres(spark, sf), 5).select((-1 - F.col("id")).alias("zone"), (-1 - F.col("other")).alias("near"), r(F.sqrt("d2"), 4, "km"))


@query
def vote_10nn(spark, sf):
    """Clients whose nation is outvoted by another among their ten nearest."""
    pts = _pts(spark, sf)
    near = _near(spark, sf, 10).join(pts.select(F.col("id").alias("other"), F.col("nk").alias("vote")), "other").join(pts.select("id", "nk"), "id")
    per = near.groupBy("id", "nk", "vote").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy("id", "nk").agg(F.coalesce(F.max(F.when(F.col("vote") == F.col("nk"), F.col("c"))), F.lit(0)).alias("own"), F.coalesce(F.max(F.when(F.col("vote") != F.col("nk"), F.col("c"))), F.lit(0)).alias("most"))
    return out.select("id", "own", "most", (F.col("most") > F.col("own")).alias("misplaced"))


@query
def upper_median_5nn(spark, sf):
    return upper_median(_near(spark, sf, 5).filter("rank = 5").select(F.sqrt("d2").alias("d")), "d").select(r("median", 6))


@query
def morton_order(spark, sf):
    return ranked(morton(_pts(spark, sf)).select("id", "zkey"), "zkey", "id", name="place")


@query
def haversine_pairs(spark, sf):
    """Great-circle and planar km to the nearest client."""
    pts = _pts(spark, sf).select("id", "lat", "lon")
    near = _near(spark, sf, 1).join(pts, "id").join(pts.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "other")
    return near.select("id", r(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4, "km"), r(F.sqrt("d2"), 4, "plane_km"))


@query
def focus_semi_join(spark, sf):
    """Orders of the customers that focusing one area selects; codes span areas, so customer ids are the key."""
    got = _replay(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer_id")), "o_custkey")
    keys = focus.focus_keys(got.withColumn("postal", F.lit("all")), "R1", False)
    return focus.apply_focus(orders, keys).groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))


@query
def focus_reverse_lookup(spark, sf):
    """The area that a filter on codes means."""
    got = _replay(spark, sf)
    return focus.area_of_values(got, "postal", got.filter("k <= 20").select("postal"))


@query
def focus_of_selection(spark, sf):
    got = _replay(spark, sf)
    one = lambda name, cond: focus.focus_of_selection(got, got.filter(cond).select("customer_id")).withColumn("selection", F.lit(name))
    return one("mixed", "k <= 20").unionByName(one("territory", "territory = 3"))


@query
def hover_nearest(spark, sf):
    pts = _pts(spark, sf).select("id", "lat", "lon")
    probes = pts.filter("id % 7 = 0").select(F.col("id").alias("probe"), (F.col("lat") + 0.01).alias("plat"), (F.col("lon") - 0.01).alias("plon"), (F.col("id") % 3 + 6).alias("zoom"))
    return focus.hover(pts, probes)


@query
def parameter_sweep(spark, sf):
    """Hours of visits and hops by detour and speed: neighbours are kept, only the formula runs again; trips are not in it."""
    model = _model(spark, sf).select("id", "v", "m", "mpk", "hop", "per_day")
    grid = spark.createDataFrame([(float(d), float(s)) for d in (1.0, 1.3, 1.6) for s in (30, 45, 90)], "detour double, speed double")
    f = (F.col("detour") / P.detour) * (P.speed_kmh / F.col("speed"))
    out = model.crossJoin(F.broadcast(grid)).withColumn("w", F.col("v") * (F.col("m") + F.col("hop") * f))  # nine settings
    return out.groupBy("detour", "speed").agg(r(F.sum("w") / 60, 3, "hours"))


@query
def waiting_for_areas(spark, sf):
    """Without the area field and without automatic areas nothing is divided: points stay unassigned; any field value lifts that."""
    pts = _pts(spark, sf)
    has = lambda p: p.agg(F.coalesce(F.max(F.col("area").isNotNull() & (F.col("area") != "")), F.lit(False)).alias("has_area"), F.coalesce(F.max(F.col("postal").isNotNull() & (F.col("postal") != "")), F.lit(False)).alias("has_postal"), F.count(F.lit(1)).alias("n"))
    one = lambda name, p: has(p).select(F.lit(name).alias("points"), "n", "has_area", "has_postal", (~F.col("has_area") & F.lit(P.areas < 1)).alias("waits"))
    return one("all", pts).unionByName(one("no field", pts.withColumn("area", F.lit(None).cast("string")))).unionByName(one("none", pts.limit(0)))


NAMES = tuple(QUERIES)
