"""The whole plan of a user's table: columns by role, clients set apart, areas, territories, loads."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, projected
from ..operators import areas, power, territories, units
from ..operators.outliers import with_outliers
from ..operators.ranking import ranked
from ..operators.workload import SUBSET, with_travel, with_visit_load
from ..sources.points import valid
from ..sources.regions import land_groups, with_regions
from ..sources.shared import written
from .params import Params

ROLES = {"customer_id": "string", "lat": "double", "lon": "double", "visits": "double", "minutes": "double", "speed_kmh": "double", "postal": "string", "area": "string"}
NEEDED = ("customer_id", "lat", "lon")


def by_role(table: DataFrame, roles: Mapping[str, str | list[str]] = {}) -> DataFrame:
    """id, a column per role and `tooltips` (a map of text) of a user's table. `roles` names the column of each role, else the role's own name counts; `tooltips` is a list.

    Roles without a column are null but for those NEEDED; values that are no numbers are null. The table's own id stays where it has one that tells rows apart by itself."""
    at = {r: roles.get(r, r) for r in ROLES}
    missing = [r for r in NEEDED if at[r] not in table.columns] + [c for r, c in roles.items() if r != "tooltips" and c not in table.columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    value = lambda r: F.col(f"`{at[r]}`").try_cast(ROLES[r]) if at[r] in table.columns else F.lit(None).cast(ROLES[r])
    tips = [x for c in roles.get("tooltips", []) for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    out = table.select(*[value(r).alias(r) for r in ROLES], (F.create_map(*tips) if tips else F.create_map().cast("map<string,string>")).alias("tooltips"), *(["id"] if "id" in table.columns else []))
    return out if "id" in out.columns else ranked(out, *ROLES, F.to_json("tooltips"), name="id")


def waits(points: DataFrame, settings: Params) -> bool:
    """Whether nothing is divided: no client has an area, and no automatic areas are asked for."""
    return settings.areas < 1 and points.filter(F.col("area") != "").isEmpty()


def with_areas(points: DataFrame, adjacency: DataFrame, names: DataFrame, settings: Params) -> DataFrame:
    """The points with area and area_id: by the field, or as many automatic ones as asked for, of codes, or of towns where codes say little about place."""
    if settings.areas < 1:
        return areas.field_areas(points)
    flat = written(projected(with_visit_load(points)).withColumn("w", F.col("visit_load") + 1e-9), "plan-flat")
    ignored = units.coherence(flat).first()["ignored"]
    coded = flat.filter("postal <> ''").isEmpty()
    keyed = written(units.unit_keys(flat.select("id", "x", "y", "postal", "w", "state_id"), None if ignored or coded else "postal"), "plan-units")
    state = units.majority(keyed.filter("state_id >= 0"), ["unit"], "state_id")
    one = units.rollup_units(keyed, ["unit"]).join(state, "unit", "left").join(land_groups(names, adjacency), "state_id", "left")
    one = written(one.withColumn("state_id", F.coalesce("state_id", F.lit(-1))).withColumn("group_id", F.coalesce("group_id", F.lit(-1))), "plan-rollup")
    made = areas.automatic(one, keyed.select("id", "x", "y", "unit", "state_id"), adjacency, names, int(settings.areas))
    return points.drop("area").join(keyed.select("id", "unit").join(made, "unit").select("id", "area_id", "area"), "id")


def planned(table: DataFrame, rings: DataFrame, adjacency: DataFrame, settings: Params = Params(), roles: Mapping[str, str | list[str]] = {}) -> DataFrame:
    """Every valid client of the table with region, area, territory (from 0), its centre (base_lat, base_lon), load, visit_load, is_outlier.

    Outliers are set apart before anything is solved and have no territory; where the plan waits for areas nobody has one. Loads without a territory are
    those of the visits alone."""
    points = written(valid(by_role(table, roles)), "plan-points")
    marked = written(with_outliers(projected(points), settings.outlier_km).drop("x", "y", "kx"), "plan-outliers")
    rest = marked.filter("not is_outlier")
    apart = with_visit_load(marked.filter("is_outlier")).withColumn("area", F.lit(None).cast("string"))
    if waits(rest, settings):
        apart, rest = with_visit_load(marked), rest.limit(0)
    at = written(with_areas(written(with_regions(rest, rings), "plan-regions"), adjacency, rings, settings), "plan-areas")
    model = written(with_travel(at, settings), "plan-model")
    done = written(power.solved(territories.clients(model, SUBSET), SUBSET, settings.capacity_hours * 60), "plan-solved")
    ids = ranked(done.select(*SUBSET, "part").distinct(), *SUBSET, "part", name="territory").select("part", (F.col("territory") - 1).alias("territory"))
    out = model.join(done.select("id", "part", "gx", "gy", "load").join(ids, "part").drop("part"), "id")
    out = out.withColumn("base_lon", F.col("gx") / F.col("kx")).withColumn("base_lat", F.col("gy") / KM_PER_DEGREE).drop("gx", "gy")
    return out.unionByName(apart.withColumn("load", F.col("visit_load")), allowMissingColumns=True)
