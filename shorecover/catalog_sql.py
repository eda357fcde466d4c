"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from .fixtures import CELL, KERNEL, SAMPLES, SEED, SLICE, SURVEY

STEP = SLICE - int(0.2 * SLICE)


class _Steps:
    """Named subqueries; get() joins those that a query needs, in order."""

    def __init__(self):
        self.named: dict[str, str] = {}

    def add(self, name: str, sql: str) -> None:
        self.named[name] = sql

    def get(self, query: str) -> str:
        import re

        need: set[str] = set()

        def visit(text: str) -> None:
            for name in self.named:
                if name not in need and re.search(rf"\b{name}\b", text):
                    need.add(name)
                    visit(self.named[name])

        visit(query)
        steps = ", ".join(f"{n} as ({s})" for n, s in self.named.items() if n in need)
        return f"with {steps} {query}" if steps else query


S = _Steps()
S.add("survey", SURVEY)
S.add("located", "select * from (select *, case when len(string_split(image_name, '_')) >= 3 then string_split(image_name, '_')[1] || '_' || string_split(image_name, '_')[2] end as location, string_split(image_name, '_')[3] as site_name from survey) where location is not null")
S.add("colors", "select location, cast(s % 60 + 60 as int) as cl, cast(s % 50 + 60 as int) as ca, cast(s % 70 + 60 as int) as cb from (select location, sum(image_id) as s from located group by location) where s % 2 = 0")
S.add("samples", SAMPLES)
S.add(
    "px",
    """select image, y, x, cast(least(greatest(floor(70e0 + case when image % 4 = 3 then 100 else 0 end + amp * e0), 0), 255) as int) as r,
  cast(least(greatest(floor(120e0 + amp * e1), 0), 255) as int) as g, cast(least(greatest(floor(130e0 + amp * e2), 0), 255) as int) as b
from (select *, case when y < 16 then 12e0 when y < 32 then 30e0 when y < 48 then 60e0 else 200e0 end as amp from
  (select cast(vec_id // 64 as int) as image, cast(vec_id % 64 as int) as y, cast(x as int) as x, cast(embedding[x+1] as double) e0,
     cast(embedding[(x+21)%64+1] as double) e1, cast(embedding[(x+42)%64+1] as double) e2 from (select *, unnest(range(64)) as x from embeddings) u) p) q""",
)


def _lab(source: str, keys: str) -> str:
    lin = lambda c: f"case when {c}/255e0 <= 0.04045e0 then {c}/255e0/12.92e0 else power(({c}/255e0+0.055e0)/1.055e0, 2.4e0) end"
    f = lambda t: f"case when {t} > 0.008856e0 then cbrt({t}) else 7.787e0*{t}+16e0/116e0 end"
    return f"""select {keys}, r, g, b, case when ty > 0.008856e0 then 116*fy-16 else 903.3e0*ty end as cl, 500*(fx-fy) as ca, 200*(fy-fz) as cb from
 (select *, {f("tx")} as fx, {f("ty")} as fy, {f("tz")} as fz from
  (select *, (0.412453e0*lr+0.357580e0*lg+0.180423e0*lb)/0.950456e0 as tx, 0.212671e0*lr+0.715160e0*lg+0.072169e0*lb as ty, (0.019334e0*lr+0.119193e0*lg+0.950227e0*lb)/1.088754e0 as tz from
   (select *, {lin("r")} as lr, {lin("g")} as lg, {lin("b")} as lb from {source})))"""


S.add("lab", _lab("px", "image, y, x"))
DIST = "sqrt(power({}-47.25e0,2)+power({}+14e0,2)+power({}+10.7e0,2))"
S.add("dist", f"select *, {DIST.format('cl', 'ca', 'cb')} as dist from lab")
S.add("sizes", "select image, max(y)+1 as h, max(x)+1 as w from px group by image")


def _plan(size: int, step: int) -> str:
    n = lambda v: f"case when {v} <= {size} then 1 else 1 + cast(ceil(({v}-{size})/{step}e0) as int) end"
    return f"""select image, cast(iy*nx+ix as int) as slice_id, cast(greatest(0, least(ix*{step}, w-{size})) as int) as x0, cast(greatest(0, least(iy*{step}, h-{size})) as int) as y0, h, w from
 (select *, unnest(range(nx)) as ix from (select *, unnest(range(ny)) as iy from (select *, {n("h")} as ny, {n("w")} as nx from sizes)))"""


S.add("plan", f"select image, slice_id, x0, y0, least(x0+{SLICE}, w) as x1, least(y0+{SLICE}, h) as y1 from ({_plan(SLICE, STEP)})")
S.add("sliced", "select dist.*, slice_id, x0, y0, x1, y1 from dist join plan on dist.image = plan.image and x >= x0 and x < x1 and y >= y0 and y < y1")
S.add(
    "cellstats",
    f"""select image, slice_id, cast((y-y0)//{CELL} as int) as cy, cast((x-x0)//{CELL} as int) as cx, count(*) as n, avg(cl) as mean_l, avg(ca) as mean_a, avg(cb) as mean_b, sqrt(greatest(0, avg(cl*cl)-avg(cl)*avg(cl))) as std_l
from sliced where (y-y0)//{CELL} < (y1-y0)//{CELL} and (x-x0)//{CELL} < (x1-x0)//{CELL} group by 1, 2, 3, 4""",
)
S.add("flagged", f"select *, u and wt as valid from (select *, std_l <= 4 as u, {DIST.format('mean_l', 'mean_a', 'mean_b')} <= 10 as wt from cellstats)")
S.add(
    "cands",
    f"""select k.*, from (select image, slice_id, y-y0 as sy, x-x0 as sx, y1-y0 as h, x1-x0 as w, cast(((y-y0)*((y1-y0)//{CELL}))//(y1-y0) as int) as cy, cast(((x-x0)*((x1-x0)//{CELL}))//(x1-x0) as int) as cx from sliced where y1-y0 >= {CELL} and x1-x0 >= {CELL}) k
join flagged f on k.image = f.image and k.slice_id = f.slice_id and k.cy = f.cy and k.cx = f.cx where f.valid""".replace("k.*, from", "k.* from"),
)
ORDER = f"md5(concat_ws('|', '{SEED}', image, slice_id, sy, sx))"
S.add("filtered", f"select * from (select *, cast((sy//{CELL})*((w+{CELL}-1)//{CELL})+sx//{CELL} as int) as cell_id from cands) qualify row_number() over (partition by image, slice_id, cell_id order by {ORDER}, sy, sx) = 1")
S.add("smasks", "select image, slice_id, y, x, dist <= 6 + 2*(slice_id % 4) as m from sliced")
S.add("fine", "select image, y, x, coalesce(bool_or(m), false) as m from px left join smasks using (image, y, x) group by 1, 2, 3")
S.add("coarse", "select image, y, x, dist <= 14 as m from dist")
S.add("eroded", f"select a.image, a.y, a.x, bool_or(b.m) as m from fine a join fine b on a.image = b.image and abs(a.y-b.y) <= {KERNEL // 2} and abs(a.x-b.x) <= {KERNEL // 2} group by 1, 2, 3")

S.add("ceroded", f"select a.image, a.y, a.x, bool_or(b.m) as m from coarse a join coarse b on a.image = b.image and abs(a.y-b.y) <= {KERNEL // 2} and abs(a.x-b.x) <= {KERNEL // 2} group by 1, 2, 3")


def _passes(coarse: str) -> str:
    return f"""select f.image, f.y, f.x, not f.m and not c.m as agreed, f.m <> c.m as disputed, f.m <> c.m and cl < 75 and sqrt(power(ca+14e0,2)+power(cb+10.7e0,2)) > 6 as validated
from fine f join {coarse} c using (image, y, x) join lab using (image, y, x)"""


S.add("merged", _passes("coarse"))
S.add("emerged", _passes("ceroded"))
S.add("points", "select *, 6378137e0*radians(-abs(longitude)) as cx, 6378137e0*ln(tan(pi()/4+radians(latitude)/2)) as cy from survey where latitude is not null")
S.add("bounds", "select *, cast(ceil((max_x-min_x)/30) as bigint) as nx, cast(ceil((max_y-min_y)/30) as bigint) as ny from (select min(cx)-18 as min_x, min(cy)-18 as min_y, max(cx)+18 as max_x, max(cy)+18 as max_y from points)")


def _area(x0: str, y0: str, x1: str, y1: str) -> str:
    """Over the strips of the 64-gon of radius 18; the bounds are relative to its centre."""
    xa, xb = "(-18*cos(k*pi()/32))", "(-18*cos((k+1)*pi()/32))"
    ya, yb = "(18*sin(k*pi()/32))", "(18*sin((k+1)*pi()/32))"
    a, b = f"greatest({xa}, {x0})", f"least({xb}, {x1})"
    slope = f"(({yb}-{ya})/({xb}-{xa}))"
    ta, tb = f"({ya}+{slope}*({a}-{xa}))", f"({ya}+{slope}*({b}-{xa}))"
    g = lambda t: f"(case when {t} <= {y0} then {y0}*({t}-{y0}) when {t} <= {y1} then ({t}*{t}-{y0}*{y0})/2 else ({y1}*{y1}-{y0}*{y0})/2+{y1}*({t}-{y1}) end)"
    mean = lambda p, q: f"(case when abs({q}-{p}) < 1e-12 then least(greatest({p}, {y0}), {y1}) else ({g(q)}-{g(p)})/({q}-{p}) end)"
    return f"list_sum(list_transform(range(32), lambda k: case when {b} > {a} then ({b}-{a})*({mean(ta, tb)}-{mean(f'(-{ta})', f'(-{tb})')}) else 0 end))"


S.add(
    "near",
    """select *, unnest(range(cast(greatest(0, floor((cy-18-min_y)/30)) as bigint), cast(least(ny-1, floor((cy+18-min_y)/30)) as bigint)+1)) as iy from
 (select *, unnest(range(cast(greatest(0, floor((cx-18-min_x)/30)) as bigint), cast(least(nx-1, floor((cx+18-min_x)/30)) as bigint)+1)) as ix from points, bounds)""",
)
S.add("pairs", f"select * from (select *, {_area('rx', 'ry', '(rx+30)', '(ry+30)')} as area from (select *, ix*ny+iy as grid_id, min_x+ix*30-cx as rx, min_y+iy*30-cy as ry from near)) where area > 1e-9")
S.add("grid", "select grid_id, ix, iy, min(min_x)+ix*30 as x0, min(min_y)+iy*30 as y0, sum(coverage_percentage*area)/sum(area) as v from pairs group by 1, 2, 3")

R = "round({0}, 6) as {1}".format
KEY4 = "image, slice_id, cy, cx"
SQL: dict[str, str] = {}


def _sql(name: str, query: str) -> None:
    SQL[name] = S.get(query)


_sql("heatmap", f"select ix, iy, grid_id, {R('v', 'weighted_coverage')} from grid")
_sql("prj_1_location", "select image_id, location from survey left join (select image_id, location from located) using (image_id)")
_sql("prj_2_drop_unlocated", "select image_id, location from located")
_sql("prj_3_site_name", "select location, arg_min(site_name, image_name) as site_name from located group by 1")
_sql("prj_4_title_token", "select location, arg_min(string_split(image_name, '_')[2], image_id) as title from located group by 1")
_sql("prj_5_num_id", "select image_id, replace(replace(string_split(image_name, '_')[-1], 'DSC', ''), '.JPG', '') as num_id from survey")
_sql("prj_6_basename", "select image_id, image_name as basename, image_name[:-5] as stem from survey")
_sql("prj_7_west_longitude", f"select image_id, {R('-abs(longitude)', 'longitude')} from survey")
_sql("prj_8_pick_images", "select pos, image_name, s.image_id from (select image_name, cast(row_number() over (partition by image_id % 13 order by image_id) as int) as pos from survey where image_id % 97 = 0) n join survey s using (image_name)")
_sql("prj_9_pick_sites", "select image_id, location from located where location in (select location from colors)")
SQL["prj_10_run_hash"] = """select s_suppkey, sha256('{"clahe": ' || case when s_suppkey % 2 = 0 then 'true' else 'false' end || case when s_suppkey % 5 <> 0 then ', "color_validation_threshold": 50' else '' end || ', "downsample_factor": 1.0'
 || case when s_suppkey % 5 <> 0 then ', "erosion_kernel_size": 51' else '' end || ', "fallback_brightness_threshold": 100.0, "fallback_distance_threshold": 55.0, "final_point_strategy": "' || case when s_suppkey % 3 = 0 then 'center_bias' else 'poisson_disk' end
 || '", "grid_size": 64, "hierarchical": ' || case when s_suppkey % 5 <> 0 then 'true, "hierarchical_slice_size": 4096, "merge_color_threshold": 15, "merge_lightness_threshold": 75.0' else 'false' end
 || ', "num_points": ' || s_suppkey % 7 || ', "padding": 0, "slice_overlap": 0.2, "slice_size": ' || 512*(1+s_suppkey%4) || ', "threshold": 20, "threshold_max": ' || s_suppkey % 30
 || ', "uniform_grid_thresh": 0.98, "uniformity_check": true, "uniformity_std_threshold": 4.0' || case when s_suppkey % 5 <> 0 then ', "use_color_validation": true, "use_erosion_merge": true' else '' end || ', "water_grid_thresh": 0.98}')[:8] as run_hash from supplier"""
_sql("prj_11_result_rows", f"select image_name, image_id, {R('latitude', 'latitude')}, {R('longitude', 'longitude')}, coverage_percentage from survey")
_sql("prj_12_cell_category", f"select {KEY4}, case when valid then 'green' when u then 'purple' else 'red' end as category from flagged")
_sql("prj_13_distance_map", f"select image, y, x, {R('case when dist <= 8 then dist end', 'dist')} from dist")
_sql("prj_14_grid_labels", f"select ix, iy, printf('%.2f', v) as label, {R('(x0+x0+30)/2', 'label_x')}, {R('(y0+y0+30)/2', 'label_y')} from grid")
_sql(
    "join_1_metadata",
    f"""select image_name, coverage_percentage, m.image_id, {R('m.latitude', 'latitude')}, {R('m.longitude', 'longitude')} from (select case when image_id % 11 = 0 then image_name || 'x' else image_name end as image_name, coverage_percentage from survey) r
left join (select * from (select *, row_number() over (partition by image_name order by image_id) as k from (select image_name, image_id, latitude, longitude from survey
 union all select image_name, image_id + 1000000, latitude, longitude from survey where image_id % 10 = 1)) where k = 1) m using (image_name)""",
)
_sql("join_2_pending_images", "select image_id, location from located l where not exists (select 1 from located e where e.image_id % 3 = 0 and e.location = l.location and e.image_name = l.image_name)")
_sql("join_3_pending_results", "select image_id, image_name from survey where image_name not in (select image_name from survey where image_id % 3 = 0)")
_sql(
    "join_4_upsert",
    """select image_id, image_name, coverage_percentage from survey where image_id % 3 = 0 and image_name not in (select image_name from survey where image_id % 4 = 0)
union all select image_id, image_name, 1.5e0 from survey where image_id % 4 = 0""",
)
_sql("join_5_water", f"select image_id, {R('cl*100e0/255', 'water_l')}, ca-128e0 as water_a, cb-128e0 as water_b from located join colors using (location)")
_sql("join_6_assign_slices", "select image, slice_id, y, x from sliced")
_sql("join_7_candidates", "select image, slice_id, sy, sx, cy, cx from cands")
_sql("join_8_compare", "select image, y, x, not f.m as fine, not c.m as coarse, not f.m and not c.m as agreed, f.m <> c.m as disputed from fine f join coarse c using (image, y, x)")
_sql("join_9_overlay", f"select image_id, ix, iy, grid_id, {R('area', 'area')} from pairs")
for _c, _d in (("6378137e0*radians(-abs(longitude)) as cx", "cx"), ("6378137e0*ln(tan(pi()/4+radians(latitude)/2)) as cy", "cy")):
    SQL["join_9_overlay"] = SQL["join_9_overlay"].replace(_c, f"round({_c.removesuffix(f' as {_d}')}, 2) as {_d}")
_sql("join_10_fill_grid", f"select grid_id, ix, iy, {R('v', 'weighted_coverage')} from grid")
S.add("slab", _lab("samples", "location"))
_BYTE = "cast(least(greatest(round({}), 0), 255) as int)".format
S.add("slab8", f"select location, {_BYTE('cl*255/100')} as l8, {_BYTE('ca+128')} as a8, {_BYTE('cb+128')} as b8 from slab")
_COLORS = "select location, cast(trunc(median(l8)) as int) as {0}L{0}, cast(trunc(median(a8)) as int) as {0}A{0}, cast(trunc(median(b8)) as int) as {0}B{0} from slab8 group by 1".format('"')
_sql("agg_1_site_colors", _COLORS)
_sql("calibration", _COLORS)
_sql(
    "agg_2_histogram",
    """select location, channel, bin, count(*) as n, any_value(md) as median from (select location, channel, md, cast(case when hi = lo then 0 else least(floor((v-lo)/((hi-lo)/32e0)), 31) end as int) as bin from
 (select *, min(v) over w as lo, max(v) over w as hi, median(v) over w as md from (select location, 'r' as channel, r as v from samples union all select location, 'g', g from samples union all select location, 'b', b from samples) window w as (partition by location, channel))) group by 1, 2, 3""",
)
_sql("agg_3_cell_stats", f"select {KEY4}, n, {R('mean_l', 'mean_l')}, {R('mean_a', 'mean_a')}, {R('mean_b', 'mean_b')}, {R('std_l', 'std_l')} from cellstats")
_sql("agg_4_cell_flags", f"select {KEY4}, u as is_uniform, wt as is_water, valid as is_valid from flagged")
S.add("shortcuts", "select image, slice_id, avg(cast(u as int)) as uniform_pct, avg(cast(wt as int)) as water_pct from flagged group by 1, 2")
_sql("agg_5_shortcut", f"select image, slice_id, {R('uniform_pct', 'uniform_pct')}, {R('water_pct', 'water_pct')}, uniform_pct >= 0.98 and water_pct >= 0.98 as shortcut from shortcuts")
S.add("fallbacks", "select image, slice_id, avg(cl) as mean_l, avg(dist) as mean_distance, avg(cl) > 46 and avg(dist) < 12 as all_water from sliced group by 1, 2")
_sql("agg_6_fallback", f"select image, slice_id, {R('mean_l', 'mean_l')}, {R('mean_distance', 'mean_distance')}, all_water from fallbacks")
_sql("agg_7_or_merge", "select image, y, x, m as is_water from fine")
_sql("agg_8_and_merge", "select image, y, x, case when image % 5 = 2 then false else coalesce(bool_and(m), true) end as is_water from px left join (select * from smasks where image % 5 <> 2 and slice_id <> 1) using (image, y, x) group by 1, 2, 3")
_sql("agg_9_coverage", f"select image, {R('count_if(not m)*100e0/count(*)', 'coverage_percentage')} from fine group by 1")
_sql("agg_10_weighted_grid", f"select grid_id, ix, iy, {R('v', 'weighted_coverage')} from grid")
_sql("agg_11_bounds", f"select location, {R('min(cx)-18', 'min_x')}, {R('min(cy)-18', 'min_y')}, {R('max(cx)+18', 'max_x')}, {R('max(cy)+18', 'max_y')} from points left join (select image_id, location from located) using (image_id) group by 1")
_sql("agg_11_view_extent", f"select {R('a-(c-a)*0.1e0', 'min_x')}, {R('b-(d-b)*0.1e0', 'min_y')}, {R('c+(c-a)*0.1e0', 'max_x')}, {R('d+(d-b)*0.1e0', 'max_y')} from (select min(x0) as a, min(y0) as b, max(x0)+30 as c, max(y0)+30 as d from grid)")
S.add("ncands", "select image, slice_id, count(*) as n from cands group by 1, 2")
S.add("nfiltered", "select image, slice_id, count(*) as n from filtered group by 1, 2")
_sql(
    "agg_12_diagnostics",
    """select f.image, f.slice_id, f.n_cells, f.n_green, f.n_purple, f.n_red, coalesce(c.n, 0) as n_candidates, coalesce(k.n, 0) as n_filtered, case when coalesce(c.n, 0) >= 3 then least(3, k.n) else 0 end as n_points, case when c.n > 0 then 10e0 end as threshold_used
from (select image, slice_id, count(*) as n_cells, count_if(valid) as n_green, count_if(u and not valid) as n_purple, count_if(not u) as n_red from flagged group by 1, 2) f left join ncands c using (image, slice_id) left join nfiltered k using (image, slice_id)""".replace("count_if(valid) as", "cast(count_if(valid) as bigint) as").replace("count_if(u and not valid) as", "cast(count_if(u and not valid) as bigint) as").replace("count_if(not u) as", "cast(count_if(not u) as bigint) as"),
)
_sql(
    "agg_13_merge_report",
    f"""select image, cast(n_disputed as bigint) as n_disputed, cast(n_validated as bigint) as n_validated, cast(n_kelp as bigint) as n_kelp, cast(n_before as bigint) as n_before, cast(n_after as bigint) as n_after, {R('fine_coverage', 'fine_coverage')}, {R('coarse_coverage', 'coarse_coverage')} from
 (select image, count_if(disputed) as n_disputed, count_if(validated) as n_validated, count_if(agreed or validated) as n_kelp from emerged group by 1) join (select image, count_if(not m)*100e0/count(*) as fine_coverage from fine group by 1) using (image)
 join (select image, count_if(not m) as n_after from ceroded group by 1) using (image) join (select image, count_if(not m) as n_before, count_if(not m)*100e0/count(*) as coarse_coverage from coarse group by 1) using (image)""",
)
_sql("win_1_slice_per_location", "select image_id, location from located qualify row_number() over (partition by location order by image_id) > 2 and row_number() over (partition by location order by image_id) <= count(*) over (partition by location) - 3")
_sql("win_2_sample_per_location", f"select image_id, location from located qualify row_number() over (partition by location order by md5(concat_ws('|', '{SEED}', image_id)), image_id) <= 20")
_sql("win_3_sample_images", f"select image_name, site_name from located qualify row_number() over (partition by site_name order by md5(concat_ws('|', '{SEED}', image_name)), image_name) <= 15")
_sql("win_4_one_per_cell", "select image, slice_id, cell_id, sy, sx from filtered")
_sql("win_5_sample_pixels", f"select image, y, x, r, g, b from px qualify row_number() over (partition by image order by md5(concat_ws('|', '{SEED}', image, y, x)), y, x) <= 500")
_sql("win_6_random_points", f"select image, slice_id, sx as x, sy as y from filtered qualify row_number() over (partition by image, slice_id order by {ORDER}, sy, sx) <= 3")
_sql("win_7_center_bias", f"select image, slice_id, sx as x, sy as y from filtered qualify row_number() over (partition by image, slice_id order by -ln(('0x' || substr({ORDER}, 1, 8))::bigint / 4294967296e0 + power(2e0, -33)) * (sqrt(power(sy-h/2e0, 2)+power(sx-w/2e0, 2))+1e-6), sy, sx) <= 3")
S.add("tried", f"select image, slice_id, sy, sx, row_number() over (partition by image, slice_id order by {ORDER}, sy, sx) as k, least(3, count(*) over (partition by image, slice_id)) as n from filtered")
S.add(
    "walk",
    f"""select image, slice_id, k, n, [sy] as ys, [sx] as xs, 0 as refused from tried where k = 1 union all
select image, slice_id, k, n, case when far then list_append(ys, sy) else ys end, case when far then list_append(xs, sx) else xs end, case when far then 0 else refused + 1 end from
 (select t.*, ys, xs, refused, len(list_filter(list_zip(ys, xs), lambda p: 4*t.n*t.n*((p[1]-sy)*(p[1]-sy)+(p[2]-sx)*(p[2]-sx)) <= 2*{SLICE}*{SLICE})) = 0 as far
  from walk w join tried t on w.image = t.image and w.slice_id = t.slice_id and t.k = w.k + 1 where len(ys) < w.n and refused < 30)""",
)
SQL["win_8_poisson_disk"] = S.get("select image, slice_id, unnest(xs) as x, unnest(ys) as y from (select * from walk qualify row_number() over (partition by image, slice_id order by k desc) = 1)").replace("with ", "with recursive ", 1)
_sql("win_9_require_points", "select f.image, f.slice_id, sy, sx from filtered f join ncands c on f.image = c.image and f.slice_id = c.slice_id where c.n >= 200")
_sql("win_10_erode", "select image, y, x, m as is_water from eroded")
_sql("win_11_sample_per_cell", f"select image, slice_id, sy, sx from cands qualify row_number() over (partition by {KEY4} order by {ORDER}, sy, sx) <= 10")
S.add("pix8", f"select image, y, x, {_BYTE('cl*255/100')} as v, {_BYTE('ca+128')} as a8, {_BYTE('cb+128')} as b8 from lab")
S.add("tiled", "select *, cast(y//th as int) as ty, cast(x//tw as int) as tx from (select pix8.*, cast(ceil(h/8e0) as int) as th, cast(ceil(w/8e0) as int) as tw from pix8 join sizes using (image))")
S.add("tiles", "select image, ty, tx, count(*) as area, greatest(1, floor(2e0*count(*)/256)) as cap from tiled group by 1, 2, 3")
S.add("bins", "select t.*, bin, coalesce(n, 0) as n from (select *, unnest(range(256)) as bin from tiles) t left join (select image, ty, tx, v as bin, count(*) as n from tiled group by 1, 2, 3, 4) using (image, ty, tx, bin)")
S.add("maps", "select image, ty, tx, bin, least(255, round(sum(m) over (partition by image, ty, tx order by bin)*255e0/area)) as map from (select *, least(n, cap)+floor(sum(greatest(n-cap, 0)) over (partition by image, ty, tx)/256) as m from bins)")
S.add(
    "corners",
    """select image, y, x, v, least(greatest(floor(py)+dy, 0), my) as ty, least(greatest(floor(px_)+dx, 0), mx) as tx, (case when dy = 1 then py-floor(py) else 1-py+floor(py) end)*(case when dx = 1 then px_-floor(px_) else 1-px_+floor(px_) end) as k
from (select *, (y+0.5e0)/th-0.5e0 as py, (x+0.5e0)/tw-0.5e0 as px_ from tiled) join (select image, max(ty) as my, max(tx) as mx from tiled group by 1) using (image), (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx)""",
)
_sql("win_12_equalize", "select c.image, y, x, v, cast(round(sum(k*map)) as int) as equalized from corners c join maps m on c.image = m.image and c.ty = m.ty and c.tx = m.tx and c.v = m.bin group by 1, 2, 3, 4")
_sql("math_1_lab", f"select image, y, x, {R('cl', 'lab_l')}, {R('ca', 'lab_a')}, {R('cb', 'lab_b')} from lab")
_sql("math_2_lab8", "select image, y, x, v as \"L8\", a8 as \"A8\", b8 as \"B8\" from pix8")
_sql("math_3_decode", f"select location, {R('cl*100e0/255', 'water_l')}, ca-128e0 as water_a, cb-128e0 as water_b from colors")
_sql("math_4_water_pixels", f"select image, y, x, {R('dist', 'dist')} from dist where dist <= 8")
_sql("math_5_validate", "select image, y, x, cl < 75 and sqrt(power(ca+14e0,2)+power(cb+10.7e0,2)) > 6 as validated from lab")
_sql("math_6_merge_passes", "select image, y, x, agreed, disputed, validated, not (agreed or validated) as is_water from merged")
_sql(
    "math_7_downsample",
    """select image, cast(ty as int) as y, cast(tx as int) as x, cast(round(round(sum(wt*r)/sum(wt), 6)) as int) as r, cast(round(round(sum(wt*g)/sum(wt), 6)) as int) as g, cast(round(round(sum(wt*b)/sum(wt), 6)) as int) as b from
 (select *, (least(y+1, (ty+1)*fy)-greatest(y, ty*fy))*(least(x+1, (tx+1)*fx)-greatest(x, tx*fx)) as wt from
  (select *, unnest([cast(floor(x/fx) as int), cast(floor(x/fx) as int)+1]) as tx from (select *, unnest([cast(floor(y/fy) as int), cast(floor(y/fy) as int)+1]) as ty from
   (select px.*, floor(h/1.5e0) as nh, floor(w/1.5e0) as nw, h/floor(h/1.5e0) as fy, w/floor(w/1.5e0) as fx from px join sizes using (image))))
  where ty < nh and tx < nw and ty*fy < y+1 and tx*fx < x+1 and (ty+1)*fy > y and (tx+1)*fx > x) where wt > 1e-9 group by 1, 2, 3""",
)
_sql("math_8_slices", f"select image, slice_id, x0, y0, least(x0+28, w) as x1, least(y0+28, h) as y1 from ({_plan(28, 28 - int(0.2 * 28))})")
_sql("math_9_mercator", f"select image_id, {R('cx', 'cx')}, {R('cy', 'cy')} from points")
_sql("math_10_disc_area", f"select image_id, {R(_area('bx', 'byy', '(bx+9)', '(byy+14)'), 'area')} from (select image_id, image_id % 31 - 20e0 as bx, image_id % 37 - 22e0 as byy from survey)")
_sql("math_11_grid", f"select ix*ny+iy as grid_id, ix, iy, {R('min_x+ix*30', 'x0')}, {R('min_y+iy*30', 'y0')} from (select *, unnest(range(ny)) as iy from (select *, unnest(range(nx)) as ix from bounds))")
_sql(
    "math_12_pad",
    f"""select image, slice_id, cast(y-y0+2 as int) as sy, cast(x-x0+2 as int) as sx, r, g, b, {R('cl', 'lab_l')} from sliced union all
select image, slice_id, cast(sy as int), cast(sx as int), 0, 255, 0, 0e0 from (select *, unnest(range(x1-x0+4)) as sx from (select *, unnest(range(y1-y0+4)) as sy from plan)) where sy < 2 or sy >= y1-y0+2 or sx < 2 or sx >= x1-x0+2""",
)
_sql("math_12_unpad", "select image, slice_id, y, x, cl > 47 as is_water from sliced")
_sql("math_14_normalize", f"select image, y, x, {R('(r-123.675e0)/58.395e0', 'nr')}, {R('(g-116.28e0)/57.12e0', 'ng')}, {R('(b-103.53e0)/57.375e0', 'nb')} from px")
S.add("routes", "select p.image, p.slice_id, f.all_water, case when s.uniform_pct >= 0.98 and s.water_pct >= 0.98 then 'shortcut' when coalesce(c.n, 0) < 100 then 'fallback' else 'model' end as route from plan p left join shortcuts s using (image, slice_id) left join ncands c using (image, slice_id) left join fallbacks f using (image, slice_id)")
_sql("udf_1_routes", "select image, slice_id, route from routes")
_sql("udf_2_predict_masks", "select image, cast(count_if(dist <= 14) as bigint) as n_water from dist group by 1")
_sql("set_1_combine_routes", "select s.image, s.slice_id, y, x, case route when 'shortcut' then true when 'fallback' then all_water else dist <= 8 end as is_water from sliced s join routes r on s.image = r.image and s.slice_id = r.slice_id")
_sql("src_1_read_survey", f"select image_id, image_name, {R('latitude', 'latitude')}, {R('longitude', 'longitude')} from survey")
_sql("src_2_list_images", "select distinct 'image_' || image || '.png' as name, true as full from px")
_sql("src_3_read_rasters", "select image, y, x, r, g, b from px")
_sql("src_4_explode_pixels", "select image, y, x, r, g, b from px")
_sql("src_5_site_colors", "select location, cl as \"L\", ca as \"A\", cb as \"B\" from colors")
_sql("src_6_results_document", f"select image_name, image_id, {R('latitude', 'latitude')}, {R('longitude', 'longitude')}, coverage_percentage from survey")
_sql("src_7_write_results", "select image_id, image_name, coverage_percentage, coalesce(site_name, 'none') as site from survey left join (select image_id, site_name from located) using (image_id)")
_sql("src_8_mask_bytes", "select image, y, x, case when m then 0 else 255 end as value from fine")
_sql("src_8_write_masks", "select image, y, x, case when m then 0 else 255 end as value from fine")
_sql("src_9_split_errors", "select image_id, case when latitude is null then 'no position: ' || image_name else 'ok' end as state from survey")
_sql("src_9_task_errors", f"select image, {R('case when image % 5 = 2 then -1e0 else count_if(dist > 14)*100e0/count(*) end', 'coverage_percentage')} from dist group by image")
_sql("inc_1_watch", "select image_name, coalesce(min(image_id + 1000000) filter (image_id % 11 = 0), min(image_id)) as image_id, cast(null as varchar) as error from survey group by 1")
_sql("inc_1_errors", "select image_name, case when min(image_id) % 7 = 0 then 'failed: ' || image_name else 'ok' end as state from survey group by 1")


def _job_pass(name: str, size: int, merge: str) -> None:
    """One pass of the coverage job by its rules: slices, cells, routes, masks, merging. Slices of a size that the rasters don't pass are one a raster."""
    step = size - int(0.2 * size)
    S.add(f"{name}_plan", f"select image, slice_id, x0, y0, least(x0+{size}, w) as x1, least(y0+{size}, h) as y1 from ({_plan(size, step)})")
    S.add(f"{name}_px", f"select dist.*, slice_id, x0, y0, x1, y1 from dist join {name}_plan p on dist.image = p.image and x >= x0 and x < x1 and y >= y0 and y < y1")
    S.add(
        f"{name}_cells",
        f"""select image, slice_id, cy, cx, sd <= 4 as u, away <= 10 as wt from (select *, {DIST.format('ml', 'ma', 'mb')} as away from
 (select image, slice_id, (y-y0)//{CELL} as cy, (x-x0)//{CELL} as cx, avg(cl) as ml, avg(ca) as ma, avg(cb) as mb, sqrt(greatest(0, avg(cl*cl)-avg(cl)*avg(cl))) as sd from {name}_px
  where (y-y0)//{CELL} < (y1-y0)//{CELL} and (x-x0)//{CELL} < (x1-x0)//{CELL} group by 1, 2, 3, 4))""",
    )
    S.add(f"{name}_short", f"select image, slice_id, avg(cast(u as int)) >= 0.98 and avg(cast(wt as int)) >= 0.98 as short from {name}_cells group by 1, 2")
    S.add(
        f"{name}_found",
        f"""select k.image, k.slice_id, count(*) as n from (select image, slice_id, ((y-y0)*((y1-y0)//{CELL}))//(y1-y0) as cy, ((x-x0)*((x1-x0)//{CELL}))//(x1-x0) as cx from {name}_px) k
 join {name}_cells c on k.image = c.image and k.slice_id = c.slice_id and k.cy = c.cy and k.cx = c.cx where u and wt group by 1, 2""",
    )
    S.add(f"{name}_dark", f"select image, slice_id, avg(cl) > 100 and avg(dist) < 55 as all_water from {name}_px group by 1, 2")
    S.add(
        f"{name}_mask",
        f"""select image, y, x, {merge}(case when short then true when coalesce(n, 0) < 3 then all_water else dist <= 20 end) as m from {name}_px
 left join {name}_short using (image, slice_id) left join {name}_found using (image, slice_id) left join {name}_dark using (image, slice_id) group by 1, 2, 3""",
    )


_job_pass("jobfine", SLICE, "bool_or")
_job_pass("jobcoarse", 64, "bool_and")
S.add("jobshrunk", f"select a.image, a.y, a.x, bool_or(b.m) as m from jobcoarse_mask a join jobcoarse_mask b on a.image = b.image and abs(a.y-b.y) <= {KERNEL // 2} and abs(a.x-b.x) <= {KERNEL // 2} group by 1, 2, 3")
_sql(
    "coverage_job",
    f"""select image, {R('count_if(kelp)*100e0/count(*)', 'coverage_percentage')} from (select f.image, case when f.m = c.m then not f.m else cl < 75 and sqrt(power(ca+14e0,2)+power(cb+10.7e0,2)) > 15 end as kelp
 from jobfine_mask f join jobshrunk c using (image, y, x) join lab using (image, y, x)) group by 1""",
)


def _option_pass(name: str, size: int, merge: str) -> None:
    """The same with a border of two black pixels a slice, and candidates by pixel."""
    content = size - 4
    S.add(f"{name}_plan", f"select image, slice_id, x0, y0, least(x0+{content}, w) as x1, least(y0+{content}, h) as y1 from ({_plan(content, content - int(0.2 * content))})")
    S.add(f"{name}_px", f"select dist.*, slice_id, x0, y0, x1, y1 from dist join {name}_plan p on dist.image = p.image and x >= x0 and x < x1 and y >= y0 and y < y1")
    area = "((any_value(y1)-any_value(y0)+4)*(any_value(x1)-any_value(x0)+4))"
    black = "sqrt(47.25e0*47.25e0+14e0*14e0+10.7e0*10.7e0)"
    S.add(f"{name}_flags", f"select image, slice_id, count_if(dist <= 9) as n, sum(cl)/{area} as mean_l, (sum(dist)+({area}-count(*))*{black})/{area} as mean_distance from {name}_px group by 1, 2")
    S.add(f"{name}_mask", f"select image, y, x, {merge}(case when n < 60 then mean_l > 38 and mean_distance < 22 else dist <= 14 end) as m from {name}_px join {name}_flags using (image, slice_id) group by 1, 2, 3")


_option_pass("optfine", SLICE, "bool_or")
_option_pass("optcoarse", 64, "bool_and")
_sql("coverage_options", f"select image, {R('count_if(not f.m and not c.m)*100e0/count(*)', 'coverage_percentage')} from optfine_mask f join optcoarse_mask c using (image, y, x) group by 1")
_sql("agg_6_fallback_padded", f"select image, slice_id, {R('mean_l', 'mean_l')}, {R('mean_distance', 'mean_distance')}, mean_l > 38 and mean_distance < 22 as all_water from optfine_flags")

S.add("diagnosed", SQL["agg_12_diagnostics"][SQL["agg_12_diagnostics"].rindex("select f.image") :])
S.add("nshown", "select image, slice_id, cast(sum(least(10, n)) as bigint) as n from (select image, slice_id, cy, cx, count(*) as n from cands group by 1, 2, 3, 4) group by 1, 2")
_sql(
    "debug_slices",
    f"""select d.*, p.x0, p.y0, p.x1, p.y1, case when s.shortcut then 'shortcut' when d.n_candidates < 3 then 'fallback' else 'model' end as route,
 case when s.shortcut then true when d.n_candidates < 3 then f.all_water end as all_water, {R('s.uniform_pct', 'uniform_pct')}, {R('s.water_pct', 'water_pct')}, cast(coalesce(n.n, 0) as int) as n_shown
from diagnosed d join plan p using (image, slice_id) join (select image, slice_id, uniform_pct, water_pct, uniform_pct >= 0.98 and water_pct >= 0.98 as shortcut from shortcuts) s using (image, slice_id)
 join fallbacks f using (image, slice_id) left join nshown n using (image, slice_id)""",
)

# the tiled tier gives what the others give
SQL["win_10_erode_tiles"] = SQL["win_10_erode"]
SQL["agg_7_merge_tiles"] = SQL["agg_7_or_merge"]
SQL["coverage_tiles"] = SQL["coverage_job"]
