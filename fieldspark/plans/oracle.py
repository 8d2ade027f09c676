"""SQL that gives the rows of the planning queries, written for itself: all pairs for neighbours, recursion for components."""
from __future__ import annotations

from ..functions.geo import KM_PER_DEGREE
from ..sources.points import DEMO_SQL, TABLES
from ..sources.regions import RINGS_SQL
from .params import Params

P = Params()
KM, CAP, DAY = repr(KM_PER_DEGREE), P.capacity_hours * 60.0, P.capacity_hours * 60 / P.work_days
AREA = "coalesce(area, '(no area)')"


def pairs(src: str, out: str, keys: str = "", k: int = 30) -> str:
    """The k nearest of every row (k, x, y) of src within the same keys."""
    d2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"
    same = "".join(f" AND a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys.split(",") if c)
    return f"{out} AS (SELECT * FROM (SELECT a.k AS id, b.k AS other, {d2} AS d2, row_number() OVER (PARTITION BY a.k ORDER BY {d2}, b.k) AS rank FROM {src} a JOIN {src} b ON a.k<>b.k{same}) WHERE rank<={k})"


def travel(src: str, p: str, keys: str) -> str:
    """{p}t: rows of src (k, lat, lon, v, m, mpk) with x, y, kx, hop, per_day, tpk, modelled apart by keys."""
    return f"""{p}x AS (SELECT *, lon*{KM}*cos(radians(avg(lat) OVER (PARTITION BY {keys}))) AS x, lat*{KM} AS y, {KM}*cos(radians(avg(lat) OVER (PARTITION BY {keys}))) AS kx FROM {src}),
{pairs(f"{p}x", f"{p}nn", keys)},
{p}h AS (SELECT s.*, coalesce(d,0)*mpk AS hop, d IS NULL AS alone FROM {p}x s LEFT JOIN (SELECT id, avg(sqrt(d2)) AS d FROM {p}nn WHERE rank<=3 GROUP BY id) q ON q.id=s.k),
{p}c AS (SELECT n.id, sum(h.v*(h.m+h.hop))/sum(h.v) AS cost FROM (SELECT id, other FROM {p}nn UNION ALL SELECT k, k FROM {p}x) n JOIN {p}h h ON h.k=n.other GROUP BY n.id),
{p}t AS (SELECT *, 2*mpk/per_day AS tpk FROM (SELECT h.*, CASE WHEN alone THEN 1.0 ELSE greatest(1.0, {DAY}/greatest(cost,1e-6)) END AS per_day FROM {p}h h JOIN {p}c c ON c.id=h.k))"""


BASE = f"""pts AS ({DEMO_SQL.format(**{t: t for t in TABLES})}),
w AS (SELECT *, v*m AS visit_load, {AREA} AS a, {float(P.detour)}/coalesce(speed_kmh,{float(P.speed_kmh)})*60 AS mpk FROM (SELECT *, CASE WHEN minutes>0 THEN minutes ELSE 60.0/v END AS m FROM (SELECT *, CASE WHEN visits>0 THEN visits ELSE 1.0 END AS v FROM pts))),
x AS (SELECT *, lon*{KM}*cos(radians((SELECT avg(lat) FROM pts))) AS x, lat*{KM} AS y FROM w),
{pairs("x", "nn")},
rings AS ({RINGS_SQL.format(nation="nation")}),
adj AS (SELECT a.state_id AS s, b.state_id AS t FROM rings a JOIN rings b ON a.land_id=b.land_id AND (abs(a.state_id-b.state_id)=5 OR abs(a.state_id-b.state_id)=1 AND a.state_id//5=b.state_id//5)),
inr AS (SELECT k, min(state_id) AS state_id FROM pts p JOIN rings r ON abs(p.lon-r.lon)<r.half AND abs(p.lat-r.lat)<r.high GROUP BY k),
far AS (SELECT k, state_id FROM (SELECT p.k, i.state_id, row_number() OVER (PARTITION BY p.k ORDER BY (p.lon*q-o.lon*q)*(p.lon*q-o.lon*q)+(p.lat-o.lat)*(p.lat-o.lat), o.k) AS n
  FROM pts p, (SELECT cos(radians((min(lat)+max(lat))/2)) AS q FROM pts), pts o JOIN inr i ON i.k=o.k WHERE p.k NOT IN (SELECT k FROM inr)) WHERE n=1),
reg AS (SELECT k, state_id, land_id FROM (SELECT * FROM inr UNION ALL SELECT * FROM far) JOIN rings USING (state_id)),
f AS (SELECT w.*, state_id, land_id, CAST(dense_rank() OVER (ORDER BY coalesce(area,''))-1 AS INT) AS area_id FROM w JOIN reg USING (k)),
{travel("f", "f", "area_id,land_id")},
{travel("w", "p", "postal")},
rs AS (SELECT w.*, land_id, nk AS territory, CAST(n_regionkey AS INT) AS area_id, concat('R', CAST(n_regionkey AS VARCHAR)) AS ra FROM w JOIN reg USING (k) JOIN nation ON n_nationkey=nk WHERE k%53<>0),
{travel("rs", "r", "area_id,land_id")},
code AS (SELECT area_id, land_id, postal, sum(lat*(v*(m+hop)+1e-9))/sum(v*(m+hop)+1e-9) AS clat, sum(lon*(v*(m+hop)+1e-9))/sum(v*(m+hop)+1e-9) AS clon FROM rt GROUP BY 1,2,3 HAVING count(*)=1 OR sum(v*(m+hop))<=0.75*{CAP}),
rb AS (SELECT t.*, b.lat AS blat, b.lon AS blon, coalesce(clat,t.lat) AS slat, coalesce(clon,t.lon) AS slon FROM rt t JOIN rings b ON b.state_id=t.territory LEFT JOIN code c ON c.area_id=t.area_id AND c.land_id=t.land_id AND c.postal=t.postal),
l AS (SELECT k, customer_id, postal, lat, lon, territory, ra, v, m, hop, x, y, visit_load,
  v*(m+hop+sqrt(((lon-blon)*kx)*((lon-blon)*kx)+((lat-blat)*{KM})*((lat-blat)*{KM}))*tpk) AS load,
  v*(m+hop+sqrt(((slon-blon)*kx)*((slon-blon)*kx)+((slat-blat)*{KM})*((slat-blat)*{KM}))*tpk) AS lp FROM rb
  UNION ALL BY NAME SELECT k, customer_id, postal, lat, lon, v, m, visit_load, visit_load AS load, visit_load AS lp FROM w WHERE k%53=0),
la AS (SELECT * FROM l WHERE territory IS NOT NULL),
grid AS (SELECT x.*, CAST(floor((x-x0)/cell) AS BIGINT) AS cx, CAST(floor((y-y0)/cell) AS BIGINT) AS cy FROM x, (SELECT min(x) AS x0, min(y) AS y0, greatest(0.5, sqrt(greatest(1.0,(max(x)-min(x))*(max(y)-min(y)))/count(*))*4) AS cell FROM x)),
cells AS (SELECT cx, cy, count(*) AS n, sum(visit_load) AS load FROM grid GROUP BY cx, cy),
dens AS (SELECT a.cx, a.cy, a.n, a.load, sum(b.load) AS density FROM cells a JOIN cells b ON abs(a.cx-b.cx)<=1 AND abs(a.cy-b.cy)<=1 GROUP BY ALL),
u AS (SELECT postal AS unit, count(*) AS n, sum(visit_load+1e-9) AS weight, sum(x*(visit_load+1e-9))/sum(visit_load+1e-9) AS x, sum(y*(visit_load+1e-9))/sum(visit_load+1e-9) AS y FROM x GROUP BY postal),
us AS (SELECT unit, state_id FROM (SELECT postal AS unit, state_id, row_number() OVER (PARTITION BY postal ORDER BY round(sum(visit_load+1e-9),6) DESC, state_id) AS n FROM w JOIN reg USING (k) GROUP BY postal, state_id) WHERE n=1),
lg AS (SELECT state_id, min(t) AS group_id FROM (WITH RECURSIVE c AS (SELECT state_id, state_id AS t FROM rings UNION SELECT c.state_id, adj.t FROM c JOIN adj ON adj.s=c.t) SELECT * FROM c) GROUP BY state_id),
un AS (SELECT u.*, state_id, group_id, state_id%4 AS area FROM u JOIN us USING (unit) JOIN lg USING (state_id)),
gl AS (SELECT group_id, round(sum(weight),6) AS load FROM un GROUP BY group_id),
mg AS (SELECT group_id AS main FROM gl ORDER BY load DESC, group_id LIMIT 1),
sp AS (SELECT x, y, min(k) AS k FROM x GROUP BY x, y),
sn AS (SELECT * FROM (SELECT a.k AS id, b.x AS cx, b.y AS cy, row_number() OVER (PARTITION BY a.k ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.k) AS rank FROM sp a JOIN sp b ON a.k<>b.k) WHERE rank<=12),
g1 AS (SELECT a.k AS p, b.k AS q, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM sp a JOIN sp b ON a.k<b.k WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.id=a.k AND (cx-a.x)*(cx-b.x)+(cy-a.y)*(cy-b.y)<0)),
ge AS (SELECT p, q, (px-qx)*(px-qx)+(py-qy)*(py-qy) AS d2 FROM g1 WHERE NOT EXISTS (SELECT 1 FROM sp c WHERE (c.x-px)*(c.x-qx)+(c.y-py)*(c.y-qy)<0)
  UNION ALL SELECT sp.k, x.k, 0 FROM x JOIN sp ON sp.x=x.x AND sp.y=x.y AND sp.k<>x.k),
ue AS (SELECT u, v, km FROM (SELECT least(a.postal,b.postal) AS u, greatest(a.postal,b.postal) AS v, sqrt(min(d2)) AS km FROM ge JOIN pts a ON a.k=ge.p JOIN pts b ON b.k=ge.q WHERE a.postal<>b.postal GROUP BY 1,2) JOIN us a ON a.unit=u JOIN us b ON b.unit=v
  WHERE a.state_id=b.state_id OR EXISTS (SELECT 1 FROM adj WHERE s=a.state_id AND t=b.state_id)),
md AS (SELECT sqrt(d2) AS d, row_number() OVER (ORDER BY d2)-1 AS i, count(*) OVER () AS n FROM nn WHERE rank=5),
mo AS (SELECT area_id, land_id, count(*) AS n, sum(q) AS sw, sum(q*x)/sum(q) AS gx, sum(q*y)/sum(q) AS gy FROM (SELECT *, v*(m+hop)+1e-9 AS q FROM ft) GROUP BY 1,2),
sc AS (SELECT mo.*, sxx, sxy, syy, sl FROM mo JOIN (SELECT area_id, land_id, sum((v*(m+hop)+1e-9)*(x-gx)*(x-gx)) AS sxx, sum((v*(m+hop)+1e-9)*(x-gx)*(y-gy)) AS sxy, sum((v*(m+hop)+1e-9)*(y-gy)*(y-gy)) AS syy,
  sum(v*(m+hop)+v*tpk*sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy))) AS sl FROM ft JOIN mo USING (area_id, land_id) GROUP BY 1,2) USING (area_id, land_id)),
ax AS (SELECT *, CASE WHEN abs(sxy)+abs(l1-sxx)<1e-12 THEN 1.0 ELSE sxy END AS ax, CASE WHEN abs(sxy)+abs(l1-sxx)<1e-12 THEN 0.0 ELSE l1-sxx END AS ay FROM (SELECT *, (sxx+syy)/2+sqrt(greatest((sxx+syy)*(sxx+syy)/4-(sxx*syy-sxy*sxy),0)) AS l1 FROM sc)),
cu AS (SELECT k, greatest(2,ceil(sl/(0.97*{CAP}))) AS m2, n, v*(m+hop)+v*tpk*sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy))/greatest(2,ceil(sl/(0.97*{CAP}))) AS share, (x-gx)*ax+(y-gy)*ay AS proj, area_id, land_id FROM ft JOIN ax USING (area_id, land_id) WHERE sl>{CAP} AND n>1),
ce AS (SELECT nk, avg(x) AS x, avg(y) AS y FROM x GROUP BY nk),
prc AS (SELECT nk AS c, x AS gx, y AS gy, (nk%5)*300.0 AS w FROM ce),
pa AS (SELECT id, c, p, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, c) AS m FROM (SELECT k AS id, c, d2, d2+w AS p, row_number() OVER (PARTITION BY k ORDER BY d2, -c) AS n FROM (SELECT x.k, c, w, (x.x-gx)*(x.x-gx)+(x.y-gy)*(x.y-gy) AS d2 FROM x, prc)) WHERE n<=8) WHERE m=1),
zb AS (SELECT min(lon) AS o0, max(lon) AS o1, min(lat) AS a0, max(lat) AS a1 FROM pts),
zi AS (SELECT k, CAST(floor((lon-o0)*(65535.0/greatest(1e-9,o1-o0))+0.5) AS BIGINT) AS zx, CAST(floor((lat-a0)*(65535.0/greatest(1e-9,a1-a0))+0.5) AS BIGINT) AS zy FROM pts, zb),
z AS (SELECT k AS id, CAST(list_sum([((zx>>i)&1)*(1::BIGINT<<(2*i))+((zy>>i)&1)*(2::BIGINT<<(2*i)) FOR i IN range(16)]) AS BIGINT) AS zkey FROM zi)
"""


def coherent(name: str, code: str) -> str:
    """Codes' coherence, of the nearest other spot."""
    return f"""SELECT '{name}' AS codes, count(*) AS clients, CASE WHEN count(*)>=20 THEN round(avg(CASE WHEN a.c=b.c THEN 1.0 ELSE 0.0 END),6) END AS coherence,
coalesce(CASE WHEN count(*)>=20 THEN avg(CASE WHEN a.c=b.c THEN 1.0 ELSE 0.0 END) END<0.5,false) AS ignored
FROM nn JOIN (SELECT k, {code} AS c, count(*) OVER (PARTITION BY {code}) AS n FROM x) a ON a.k=nn.id AND a.n>=2 JOIN (SELECT k, {code} AS c FROM x) b ON b.k=nn.other WHERE rank=1"""


def reach(edges: str, nodes: str) -> str:
    """id and the least id that steps over edges (a, b) reach."""
    return f"SELECT n.k AS id, least(n.k, coalesce(min(t),n.k)) AS town FROM {nodes} n LEFT JOIN (WITH RECURSIVE c AS (SELECT a AS s, b AS t FROM {edges} UNION SELECT c.s, e.b FROM c JOIN {edges} e ON e.a=c.t) SELECT * FROM c) q ON q.s=n.k GROUP BY n.k"


TOWN_EDGES = "(SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.k<>b.k AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=2)"
EPS_EDGES = "(SELECT id AS a, other AS b FROM nn WHERE rank<=10 AND sqrt(d2)<=2*(SELECT d FROM md WHERE i=n//2) UNION SELECT other, id FROM nn WHERE rank<=10 AND sqrt(d2)<=2*(SELECT d FROM md WHERE i=n//2))"

SQL = {n: f"WITH RECURSIVE {BASE}, {q[15:]}" if q.startswith("WITH RECURSIVE ") else f"WITH {BASE} {q}" for n, q in {
    "points_valid": "SELECT * FROM pts",
    "points_ordered_topk": "SELECT k, customer_id FROM pts ORDER BY customer_id LIMIT 100",
    "workload_per_client": "SELECT k, v, m, round(visit_load,4) AS visit_load FROM w",
    "projected_points": "SELECT k, round(x,4) AS x, round(y,4) AS y FROM x",
    "speed_min_per_km": "SELECT k, round(mpk,6) AS min_per_km FROM w",
    "visit_sizing_rollup": f"SELECT a AS area, round(sum(visit_load)/60,3) AS hours, round(sum(visit_load)/60/{float(P.capacity_hours)},3) AS salespeople, count(*) AS n_clients FROM w GROUP BY ROLLUP (a)",
    "bounding_box": "SELECT a AS area, round(avg(lat),6) AS lat, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM w GROUP BY a",
    "bbox_density_cells": "SELECT cx, cy, n, round(load,3) AS load, round(density,3) AS density FROM dens",
    "density_order": "SELECT k, row_number() OVER (ORDER BY round(density,3) DESC, k) AS place FROM grid JOIN dens USING (cx, cy)",
    "knn_30": "SELECT id, count(*) AS n, round(max(sqrt(d2)),4) AS far_km FROM nn GROUP BY id",
    "knn_counts": "SELECT CAST(rank AS INT) AS rank, count(*) AS n, round(avg(sqrt(d2)),6) AS mean_km FROM nn GROUP BY rank",
    "knn_symmetric_degree": "SELECT id, count(*) AS degree FROM (SELECT id, other FROM nn WHERE rank<=5 UNION SELECT other, id FROM nn WHERE rank<=5) GROUP BY id",
    "outliers_third_nn": "SELECT k, coalesce(sqrt(d2)>25, true) AS is_outlier FROM x LEFT JOIN (SELECT * FROM nn WHERE rank=3) q ON q.id=x.k",
    "outlier_count": "SELECT count(*) FILTER (o) AS outliers, count(*) FILTER (NOT o) AS rest, round(sum(visit_load) FILTER (NOT o)/60,3) AS hours FROM (SELECT x.*, coalesce(sqrt(d2)>25, true) AS o FROM x LEFT JOIN (SELECT * FROM nn WHERE rank=3) q ON q.id=x.k)",
    "field_area_ids": "SELECT a AS area, area_id, count(*) AS n FROM f GROUP BY a, area_id",
    "hop_minutes": "SELECT k, round(hop,4) AS hop FROM ft",
    "visits_per_day_tpk": "SELECT k, round(hop,4) AS hop, round(per_day,4) AS per_day, round(tpk,4) AS tpk FROM ft",
    "single_client_travel": "SELECT k, round(hop,4) AS hop, round(tpk,6) AS tpk FROM pt WHERE postal IN (SELECT postal FROM pts GROUP BY postal HAVING count(*)=1)",
    "load_replay": "SELECT k, round(load,3) AS load FROM l",
    "load_replay_postal": "SELECT k, round(lp,3) AS load FROM l",
    "territory_stats": f"SELECT territory, count(*) AS n, round(sum(load)/60,3) AS hours, round(sum(visit_load)/60,3) AS visit_hours, round((sum(load)/60-{P.capacity_hours})/{P.capacity_hours}*100,3) AS deviation_pct FROM la GROUP BY territory",
    "area_sizing": f"SELECT ra AS area, round(sum(load)/60,3) AS hours, count(DISTINCT territory) AS territories, round(sum(load)/{CAP},3) AS salespeople FROM la GROUP BY ROLLUP (ra)",
    "sizing_rollup": f"SELECT ra AS area, round(sum(load)/60,3) AS hours, round(sum(visit_load)/60,3) AS visit_hours, round(sum(load)/{CAP},3) AS salespeople FROM la GROUP BY ROLLUP (ra)",
    "travel_share": f"SELECT round(sum(s-v)/sum(s),6) AS travel_share, round(avg(CASE WHEN s<={CAP} THEN 1.0 ELSE 0.0 END),6) AS within FROM (SELECT sum(load) AS s, sum(visit_load) AS v FROM la GROUP BY territory)",
    "area_badges": f"SELECT ra AS area, round(sum(lat*load)/sum(load),5) AS lat, round(sum(lon*load)/sum(load),5) AS lon, round(sum(load)/{CAP},1) AS badge FROM la GROUP BY ra",
    "cv_of_zone_loads": "SELECT round(stddev_pop(s)/avg(s),6) AS cv FROM (SELECT sum(load) AS s FROM la GROUP BY territory)",
    "inertia": f"SELECT territory, round(sum(q*((x-gx)*(x-gx)+(y-gy)*(y-gy))),1) AS inertia, round(greatest(sum(load)-{CAP},0),3) AS over, round(sum(load-v*(m+hop)),3) AS travel FROM (SELECT *, v*(m+hop)+1e-9 AS q, sum(x*(v*(m+hop)+1e-9)) OVER t/sum(v*(m+hop)+1e-9) OVER t AS gx, sum(y*(v*(m+hop)+1e-9)) OVER t/sum(v*(m+hop)+1e-9) OVER t AS gy FROM la WINDOW t AS (PARTITION BY territory)) GROUP BY territory",
    "postal_extent_split": "SELECT postal, round(e,4) AS extent_km, n, e>25 AS wide FROM (SELECT postal, sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))) AS e, count(*) AS n FROM x GROUP BY postal)",
    "split_codes": "SELECT count(*) FILTER (e>25) AS split, count(*) AS codes FROM (SELECT sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))) AS e FROM x GROUP BY postal)",
    "postal_coherence": coherent("cells", "postal") + " UNION ALL " + coherent("numbers", "CAST(k%50 AS VARCHAR)"),
    "weighted_mode_area": "SELECT postal, a AS area FROM (SELECT *, row_number() OVER (PARTITION BY postal ORDER BY w DESC, a) AS r FROM (SELECT postal, a, round(sum(visit_load),6) AS w FROM w GROUP BY ALL)) WHERE r=1",
    "unit_rollup": "SELECT postal, round(sum(lat*visit_load)/sum(visit_load),5) AS lat, round(sum(lon*visit_load)/sum(visit_load),5) AS lon, round(sum(visit_load),4) AS weight FROM w GROUP BY postal",
    "postal_unit_rollup": f"""SELECT area_id, land_id, unit, count(*) AS n, round(sum(v),3) AS v, round(sum(v*(m+hop))/sum(v),3) AS minutes, round(sum(v*tpk)/sum(v),3) AS tpk, round(sum(x*(v*(m+hop)+1e-9))/sum(v*(m+hop)+1e-9),3) AS x, round(sum(y*(v*(m+hop)+1e-9))/sum(v*(m+hop)+1e-9),3) AS y
  FROM (SELECT *, CASE WHEN count(*) OVER c=1 OR sum(v*(m+hop)) OVER c<=0.75*{CAP} THEN concat('c',postal) ELSE concat('i',CAST(k AS VARCHAR)) END AS unit FROM ft WINDOW c AS (PARTITION BY area_id, land_id, postal)) GROUP BY 1,2,3""",
    "towns_components": reach(TOWN_EDGES, "x"),
    "unit_keys": f"""SELECT id, CASE WHEN ce>25 THEN concat(CAST(nk AS VARCHAR),'|',CASE WHEN te>25 THEN concat(CAST(town AS VARCHAR),':',CAST(CAST(floor(x/5) AS BIGINT) AS VARCHAR),':',CAST(CAST(floor(y/5) AS BIGINT) AS VARCHAR)) ELSE CAST(town AS VARCHAR) END) ELSE CAST(nk AS VARCHAR) END AS unit
  FROM (SELECT *, sqrt((max(x) OVER c-min(x) OVER c)*(max(x) OVER c-min(x) OVER c)+(max(y) OVER c-min(y) OVER c)*(max(y) OVER c-min(y) OVER c)) AS ce, sqrt((max(x) OVER t-min(x) OVER t)*(max(x) OVER t-min(x) OVER t)+(max(y) OVER t-min(y) OVER t)*(max(y) OVER t-min(y) OVER t)) AS te
  FROM x JOIN ({reach(TOWN_EDGES, "x")}) q ON q.id=x.k WINDOW c AS (PARTITION BY nk), t AS (PARTITION BY town))""",
    "solver_towns": reach(EPS_EDGES, "x"),
    "land_groups": "SELECT state_id, CAST(group_id AS BIGINT) AS group_id FROM lg",
    "region_of_point": "SELECT k AS id, state_id, land_id FROM inr JOIN rings USING (state_id)",
    "region_nearest_fill": "SELECT k AS id, state_id, land_id FROM reg",
    "regions_unresolved": "SELECT k AS id FROM far",
    "states_touch_pairs": "SELECT a.s, b.s AS t, a.s=b.s OR a.s<0 OR b.s<0 OR EXISTS (SELECT 1 FROM adj WHERE adj.s=a.s AND adj.t=b.s) AS touch FROM (SELECT state_id AS s FROM rings UNION ALL SELECT -1) a, (SELECT state_id AS s FROM rings UNION ALL SELECT -1) b",
    "unit_states": "SELECT unit, n, state_id, CAST(group_id AS BIGINT) AS group_id FROM un",
    "land_group_loads": "SELECT CAST(group_id AS BIGINT) AS group_id, round(load,3) AS load, group_id=main AS is_main FROM gl, mg",
    "island_areas_named": """SELECT CAST(group_id AS BIGINT) AS group_id, CAST(dense_rank() OVER (ORDER BY group_id)-1 AS INT) AS island, concat(name, CASE WHEN c>1 THEN concat(' +',CAST(c-1 AS VARCHAR)) ELSE '' END) AS name
  FROM (SELECT group_id, state_id, count(*) OVER (PARTITION BY group_id) AS c, row_number() OVER (PARTITION BY group_id ORDER BY round(sum(weight),6) DESC, state_id) AS n FROM un, mg WHERE group_id<>main GROUP BY group_id, state_id) JOIN rings USING (state_id) WHERE n=1""",
    "unit_adjacency": "SELECT u, v, round(km,4) AS km FROM ue",
    "cut_edges": "SELECT CAST(least(a.area,b.area) AS INT) AS area, CAST(greatest(a.area,b.area) AS INT) AS other, count(*) AS edges FROM ue JOIN un a ON a.unit=u JOIN un b ON b.unit=v WHERE a.area<>b.area GROUP BY 1,2",
    "area_pieces": "SELECT CAST(area AS INT) AS area, piece, count(*) AS units FROM (SELECT n.unit, n.area, least(n.unit, coalesce(min(t),n.unit)) AS piece FROM un n LEFT JOIN (WITH RECURSIVE e AS MATERIALIZED (SELECT u AS a, v AS b FROM ue JOIN un p ON p.unit=u JOIN un q ON q.unit=v WHERE p.area=q.area UNION ALL SELECT v, u FROM ue JOIN un p ON p.unit=u JOIN un q ON q.unit=v WHERE p.area=q.area), c AS (SELECT a AS s, b AS t FROM e UNION SELECT c.s, e.b FROM c JOIN e ON e.a=c.t) SELECT * FROM c) q ON q.s=n.unit GROUP BY n.unit, n.area) GROUP BY 1,2",
    "stray_vote": """SELECT unit, area, vote, round(wt/total,6) AS share, wt/total>0.6 AS moves FROM (SELECT unit, area, vote, wt, sum(wt) OVER (PARTITION BY unit) AS total, row_number() OVER (PARTITION BY unit ORDER BY round(wt,9) DESC, vote<>area, vote) AS n FROM (
  SELECT unit, area, vote, sum(1/(sqrt(d2)+0.5)) AS wt FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY d2, k) AS n FROM (
  SELECT un.unit, CAST(un.area AS INT) AS area, CAST(o.area AS INT) AS vote, p.k, (un.x-p.x)*(un.x-p.x)+(un.y-p.y)*(un.y-p.y) AS d2
  FROM un, x p JOIN un o ON o.unit=p.postal WHERE un.n<=30 AND o.unit<>un.unit AND (un.state_id=o.state_id OR EXISTS (SELECT 1 FROM adj WHERE adj.s=un.state_id AND adj.t=o.state_id))) WHERE d2<=14400) WHERE n<=10 GROUP BY 1,2,3)) WHERE n=1""",
    "proximity_edges": "SELECT least(p,q) AS id, greatest(p,q) AS other, round(sqrt(d2),4) AS km FROM ge",
    "priced_assignment": "SELECT id, c, round(p,3) AS p FROM pa",
    "ascent_step": """SELECT c, n, round(load,2) AS load, round(w+(scale+1e-9)*greatest(-0.5,least(0.5,(load-mean)/greatest(mean,1e-9))),3) AS price, round(CASE WHEN n>0 THEN gx+0.7*(mx-gx) ELSE gx END,4) AS gx, round(CASE WHEN n>0 THEN gy+0.7*(my-gy) ELSE gy END,4) AS gy
  FROM (SELECT prc.c, w, gx, gy, coalesce(n,0) AS n, coalesce(load,0) AS load, coalesce(scale, avg(scale) OVER ()) AS scale, avg(coalesce(load,0)) OVER () AS mean, mx, my FROM prc LEFT JOIN (SELECT c, count(*) AS n, sum(visit_load+v*0.5*sqrt(d2)) AS load, avg(d2) AS scale,
  sum(x*(visit_load+1e-9))/sum(visit_load+1e-9) AS mx, sum(y*(visit_load+1e-9))/sum(visit_load+1e-9) AS my FROM pa JOIN x ON x.k=pa.id GROUP BY c) t ON t.c=prc.c)""",
    "chain_costs": """SELECT a, b, round(min(total),4) AS total FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT k AS id, nk AS home, c, d2, visit_load+v*0.5*sqrt(d2) AS amount FROM (SELECT x.k, x.nk, x.v, x.visit_load, prc.c, (x.x-gx)*(x.x-gx)+(x.y-gy)*(x.y-gy) AS d2, row_number() OVER (PARTITION BY x.k ORDER BY (x.x-gx)*(x.x-gx)+(x.y-gy)*(x.y-gy), -prc.c) AS n FROM x, prc) WHERE n<=3 OR c=nk),
  ld AS MATERIALIZED (SELECT home AS c, sum(amount) AS load FROM o WHERE c=home GROUP BY home), cp AS MATERIALIZED (SELECT avg(load)*1.02 AS cap FROM ld),
  wy AS MATERIALIZED (SELECT * FROM (SELECT f.home AS a, t.c AS b, t.d2-f.d2 AS cost, f.id, f.amount AS own, t.amount AS next, row_number() OVER (PARTITION BY f.home, t.c ORDER BY t.d2-f.d2, f.id) AS n FROM o f JOIN o t ON t.id=f.id AND t.c<>f.home WHERE f.c=f.home) JOIN ld ON ld.c=b WHERE n=1),
  ch AS (SELECT a, b, id, own, cost AS total, 1 AS steps FROM wy, cp WHERE load+next<=cap UNION ALL SELECT w.a, w.b, w.id, w.own, w.cost+ch.total, steps+1 FROM ch JOIN wy w ON w.b=ch.a, cp WHERE steps<6 AND w.id<>ch.id AND w.load-ch.own+w.next<=cap) SELECT * FROM ch) GROUP BY a, b""",
    "placement_gains": """WITH RECURSIVE k10 AS MATERIALIZED (SELECT id, other FROM nn WHERE rank<=10), h AS MATERIALIZED (SELECT k AS id, postal AS c FROM x), am AS MATERIALIZED (SELECT x.k AS id, q.c, x.visit_load+x.v*0.5*sqrt((x.x-gx)*(x.x-gx)+(x.y-gy)*(x.y-gy)) AS amount FROM x, (SELECT postal AS c, avg(x) AS gx, avg(y) AS gy FROM x GROUP BY postal) q),
  ho AS MATERIALIZED (SELECT h.id, h.c, amount FROM h JOIN am ON am.id=h.id AND am.c=h.c), ld AS MATERIALIZED (SELECT c, sum(amount) AS load FROM ho GROUP BY c), cp AS (SELECT avg(load)*1.02+1e-9 AS cap FROM ld),
  vt AS MATERIALIZED (SELECT k10.id, h.c, count(*) AS n FROM k10 JOIN h ON h.id=k10.other GROUP BY 1,2), wi AS (SELECT h.id AS i, h.c AS a, vt.c AS b FROM vt JOIN h USING (id) LEFT JOIN vt o ON o.id=h.id AND o.c=h.c WHERE vt.n>coalesce(o.n,0)),
  ac AS MATERIALIZED (SELECT row_number() OVER () AS act, i, a, b, j FROM (SELECT i, a, b, NULL::BIGINT AS j FROM wi UNION ALL SELECT i, a, b, other FROM wi JOIN k10 ON k10.id=i JOIN h ON h.id=other AND h.c=b)),
  ok AS MATERIALIZED (SELECT ac.* FROM ac JOIN ho hi ON hi.id=i JOIN am ib ON ib.id=i AND ib.c=b LEFT JOIN ho hj ON hj.id=j LEFT JOIN am ja ON ja.id=j AND ja.c=a JOIN ld la2 ON la2.c=a JOIN ld lb ON lb.c=b, cp
    WHERE (la2.load+coalesce(ja.amount,0)-hi.amount<=cap OR coalesce(ja.amount,0)-hi.amount<=0) AND (lb.load+ib.amount-coalesce(hj.amount,0)<=cap OR ib.amount-coalesce(hj.amount,0)<=0)),
  se AS MATERIALIZED (SELECT act, i AS p FROM ok UNION SELECT act, j FROM ok WHERE j IS NOT NULL UNION SELECT act, id FROM ok JOIN k10 ON other=i UNION SELECT act, id FROM ok JOIN k10 ON other=j),
  nw AS (SELECT act, p, h.c AS was, CASE WHEN p=i THEN b WHEN p=j THEN a ELSE h.c END AS now FROM se JOIN ok USING (act) JOIN h ON h.id=p),
  cn AS (SELECT act, p, was, now, CASE WHEN other=i THEN b WHEN other=j THEN a ELSE o.c END AS c, o.c AS c0 FROM nw JOIN ok USING (act) JOIN k10 ON k10.id=p JOIN h o ON o.id=other),
  af AS (SELECT act, p, coalesce(max(n) FILTER (c=now),0) AS own, max(n) AS most FROM (SELECT act, p, now, c, count(*) AS n FROM cn GROUP BY ALL) GROUP BY act, p),
  be AS (SELECT act, p, coalesce(max(n) FILTER (c0=was),0) AS own, max(n) AS most FROM (SELECT act, p, was, c0, count(*) AS n FROM cn GROUP BY ALL) GROUP BY act, p)
  SELECT i, b, j, CAST(sum(CAST(af.most>af.own AS INT)-CAST(be.most>be.own AS INT)) AS INT) AS bad, CAST(sum(af.own-be.own) AS INT) AS pairs FROM af JOIN be USING (act, p) JOIN ok USING (act) GROUP BY act, i, b, j""",
    "town_need": f"""SELECT town, n, round(load/60,3) AS hours, load>={CAP}/2 AS is_town, CAST(greatest(1,ceil(load/(0.97*{CAP}))) AS INT) AS need FROM (SELECT town, count(*) AS n, sum(base+trip*sqrt((x-gx)*(x-gx)+(y-gy)*(y-gy))) AS load FROM (SELECT *, sum(x*(base+1e-9)) OVER t/sum(base+1e-9) OVER t AS gx, sum(y*(base+1e-9)) OVER t/sum(base+1e-9) OVER t AS gy
  FROM (SELECT q.town, x.x, x.y, f.v*(f.m+f.hop) AS base, f.v*f.tpk AS trip FROM x JOIN ft f USING (k) JOIN ({reach(TOWN_EDGES, "x")}) q ON q.id=x.k) WINDOW t AS (PARTITION BY town)) GROUP BY town) WHERE n>1""",
    "territory_colours": """WITH RECURSIVE ce2 AS MATERIALIZED (SELECT unit, area, x, y, CAST(row_number() OVER (ORDER BY md5(unit), unit) AS INT) AS i FROM un),
  nr AS (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS n FROM ce2 a JOIN ce2 b ON a.area=b.area AND a.i<>b.i),
  bf AS MATERIALIZED (SELECT i, list(j) AS js FROM (SELECT i, j FROM nr WHERE n<=6 UNION SELECT j, i FROM nr WHERE n<=6) WHERE j<i GROUP BY i),
  st AS (SELECT 0 AS i, CAST([] AS INT[]) AS cs UNION ALL SELECT st.i+1, list_append(cs, (SELECT min(c) FROM range(40) t(c) WHERE NOT list_contains(list_transform(coalesce(bf.js,[]), lambda j: cs[j]), c))::INT) FROM st LEFT JOIN bf ON bf.i=st.i+1 WHERE st.i<(SELECT count(*) FROM ce2))
  SELECT unit AS name, (SELECT cs FROM st ORDER BY i DESC LIMIT 1)[ce2.i] AS colour FROM ce2""",
    "cut_vertices": """WITH RECURSIVE ie AS MATERIALIZED (SELECT u AS a, v AS b FROM ue JOIN un p ON p.unit=u JOIN un q ON q.unit=v WHERE p.area=q.area UNION ALL SELECT v, u FROM ue JOIN un p ON p.unit=u JOIN un q ON q.unit=v WHERE p.area=q.area),
  rea AS (SELECT a AS v, min(b) AS t FROM ie GROUP BY a UNION SELECT rea.v, ie.b FROM rea JOIN ie ON ie.a=rea.t WHERE ie.b<>rea.v) SELECT DISTINCT a AS unit FROM ie WHERE NOT EXISTS (SELECT 1 FROM rea WHERE rea.v=ie.a AND rea.t=ie.b)""",
    "seed_distances": """WITH RECURSIVE ee AS MATERIALIZED (SELECT u AS a, v AS b, km AS w FROM ue UNION ALL SELECT v, u, km FROM ue), se AS MATERIALIZED (SELECT min(unit) AS seed FROM un GROUP BY state_id),
  sd(unit, seed, d) USING KEY (unit) AS (SELECT seed, seed, 0::DOUBLE FROM se UNION SELECT b, arg_min(seed, (d, seed)), min(d) FROM (SELECT e.b, sd.seed, sd.d+e.w AS d FROM sd JOIN ee e ON e.a=sd.unit) n
  WHERE NOT EXISTS (SELECT 1 FROM recurring.sd r WHERE r.unit=n.b AND (r.d<n.d OR (r.d=n.d AND r.seed<=n.seed))) GROUP BY b) SELECT unit, seed, round(d,3) AS km FROM sd""",
    "principal_axis": "SELECT area_id, land_id, n, round(gx,3) AS gx, round(gy,3) AS gy, round(atan(ay/ax),6) AS angle FROM ax WHERE n>1",
    "bisection_round1": "SELECT k AS id, coalesce(before,0)>=goal OR nth=n AS second FROM (SELECT *, sum(share) OVER (PARTITION BY area_id, land_id ORDER BY proj, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY area_id, land_id ORDER BY proj, k) AS nth, sum(share) OVER (PARTITION BY area_id, land_id)*floor(m2/2)/m2 AS goal FROM cu)",
    "client_detail": "SELECT customer_id, ra AS area, territory+1 AS territory, postal, round(load/60,3) AS load_hours, round(visit_load/60,3) AS visit_hours, round(greatest(0,(load-visit_load)/60),3) AS travel_hours FROM l",
    "assignment_export": "SELECT concat_ws(',', customer_id, coalesce(ra,''), CASE WHEN territory IS NOT NULL THEN CAST(territory+1 AS VARCHAR) WHEN k%2=0 THEN 'outlier' ELSE 'unassigned' END, printf('%.2f', floor(round(load,3)/60*100+0.5)/100), postal) AS line FROM l",
    "diagnostics": "SELECT (SELECT count(*) FROM pts) AS n_rows, (SELECT count(*) FROM pts) AS n_points, 0::BIGINT AS n_dropped, (SELECT count(*) FROM l WHERE territory IS NULL) AS n_outliers, (SELECT round(sum(load-visit_load)/sum(load),6) FROM la) AS travel_share, coherence, ignored, (SELECT count(*) FROM (SELECT postal FROM x GROUP BY postal HAVING sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y)))>25)) AS postal_split FROM (" + coherent("c", "postal") + ")",
    "nearest_centre": "SELECT * FROM (SELECT k AS id, ce.nk AS centre, CAST(row_number() OVER (PARTITION BY k ORDER BY (x.x-ce.x)*(x.x-ce.x)+(x.y-ce.y)*(x.y-ce.y), -ce.nk) AS INT) AS rank, round(sqrt((x.x-ce.x)*(x.x-ce.x)+(x.y-ce.y)*(x.y-ce.y)),4) AS km FROM x, ce) WHERE rank<=3",
    "nearest_zones": "SELECT zone, near, km FROM (SELECT a.nk AS zone, b.nk AS near, row_number() OVER (PARTITION BY a.nk ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), -b.nk) AS n, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),4) AS km FROM ce a JOIN ce b ON a.nk<>b.nk) WHERE n<=5",
    "vote_10nn": "SELECT id, own, most, most>own AS misplaced FROM (SELECT id, coalesce(max(c) FILTER (vote=nk),0) AS own, coalesce(max(c) FILTER (vote<>nk),0) AS most FROM (SELECT nn.id, a.nk, b.nk AS vote, count(*) AS c FROM nn JOIN pts a ON a.k=nn.id JOIN pts b ON b.k=nn.other WHERE rank<=10 GROUP BY ALL) GROUP BY id)",
    "upper_median_5nn": "SELECT round(d,6) AS median FROM md WHERE i=n//2",
    "morton_order": "SELECT id, zkey, row_number() OVER (ORDER BY zkey, id) AS place FROM z",
    "haversine_pairs": "SELECT id, round(2*6371*atan2(sqrt(h),sqrt(1-h)),4) AS km, round(sqrt(d2),4) AS plane_km FROM (SELECT nn.id, d2, sin(radians(b.lat-a.lat)/2)*sin(radians(b.lat-a.lat)/2)+cos(radians(a.lat))*cos(radians(b.lat))*sin(radians(b.lon-a.lon)/2)*sin(radians(b.lon-a.lon)/2) AS h FROM nn JOIN pts a ON a.k=nn.id JOIN pts b ON b.k=nn.other WHERE rank=1)",
    "focus_semi_join": "SELECT c_name AS customer_id, count(*) AS orders FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_name IN (SELECT customer_id FROM la WHERE ra='R1') GROUP BY c_name",
    "focus_reverse_lookup": "SELECT ra AS area, count(*) AS n FROM la WHERE postal IN (SELECT postal FROM l WHERE k<=20) GROUP BY ra ORDER BY n DESC, ra LIMIT 1",
    "focus_of_selection": "SELECT 'area' AS kind, (SELECT ra FROM la WHERE k<=20 GROUP BY ra ORDER BY count(*) DESC, ra LIMIT 1) AS value, 'mixed' AS selection UNION ALL SELECT 'territory', '3', 'territory'",
    "hover_nearest": "SELECT probe, id FROM (SELECT q.k AS probe, p.k AS id, row_number() OVER (PARTITION BY q.k ORDER BY sqrt(((p.lon*c)-((q.lon-0.01)*c))*((p.lon*c)-((q.lon-0.01)*c))+(p.lat-(q.lat+0.01))*(p.lat-(q.lat+0.01))), p.k) AS n FROM pts q, pts p, (SELECT cos(radians((min(lat)+max(lat))/2)) AS c FROM pts) WHERE q.k%7=0 AND sqrt(((p.lon*c)-((q.lon-0.01)*c))*((p.lon*c)-((q.lon-0.01)*c))+(p.lat-(q.lat+0.01))*(p.lat-(q.lat+0.01)))<8*360/(256*pow(2.0,q.k%3+6))) WHERE n=1",
    "parameter_sweep": f"SELECT CAST(d AS DOUBLE) AS detour, CAST(s AS DOUBLE) AS speed, round(sum(v*(m+hop*(d/{P.detour})*({P.speed_kmh}/s)))/60,3) AS hours FROM ft, (VALUES (1.0::DOUBLE),(1.3::DOUBLE),(1.6::DOUBLE)) a(d), (VALUES (30::DOUBLE),(45::DOUBLE),(90::DOUBLE)) b(s) GROUP BY d, s",
    "waiting_for_areas": "SELECT 'all' AS points, count(*) AS n, true AS has_area, true AS has_postal, false AS waits FROM pts UNION ALL SELECT 'no field', count(*), false, true, true FROM pts UNION ALL SELECT 'none', 0, false, false, true",
}.items()}
