"""Pieces of DuckDB SQL that the twins of the queries share."""

from __future__ import annotations

from pluvio.config import Detector
from pluvio.functions.palette import TIERS

D = Detector()
KR, KC, KM, PX = D.grid.km_per_row, D.grid.km_per_col, D.grid.km_per_px, D.proximity_px

PIXELS = """
seeds as (select event_id, date_diff('day', timestamp '2024-01-01', ts) as session_id, value from events where event_id % 20 = 0),
blobs as (select session_id, f as frame_idx,
   (event_id*37)%56 + ((event_id//20)%3-1)*f + dr as r, (event_id*53)%40 + ((event_id//20)%4)*f + dc as c,
   case when value<10 then 0.10 when value<25 then 0.18 when value<50 then 0.38 when value<100 then 0.63 when value<200 then 0.88 else 1.0 end::double as inten
  from seeds, range(8) a(f), range(3) b(dr), range(3) d(dc)),
speckle as (select date_diff('day', timestamp '2024-01-01', ts) as session_id, (event_id//7)%8 as frame_idx, (event_id*37+user_id*11)%64 r, (event_id*53+user_id*29)%64 c, 0.18::double inten from events where event_id%20<>0),
pixels as (select session_id::bigint session_id, frame_idx::bigint frame_idx, r::bigint r, c::bigint c, max(inten) inten
  from (select * from blobs union all select * from speckle) where r between 0 and 63 and c between 0 and 63 group by all)"""

CELLS = f"""
strong as (select * from pixels where inten >= {D.intensity}),
reach as (select session_id, frame_idx, r, c, r*64+c as root from strong
  union select n.session_id, n.frame_idx, n.r, n.c, e.root from reach e join strong n
    on n.session_id = e.session_id and n.frame_idx = e.frame_idx and abs(n.r-e.r)+abs(n.c-e.c) = 1),
rooted as (select session_id, frame_idx, r, c, min(root) as root from reach group by all),
labelled as (select s.*, (dense_rank() over (partition by s.session_id, s.frame_idx order by root))::int as label from strong s join rooted using (session_id, frame_idx, r, c)),
cells as (select session_id, frame_idx, label, avg(r) as row_c, avg(c) as col_c, count(*) as area, max(inten) as peak from labelled group by all)"""

ROUNDS = 8


def _rounds() -> str:
    out = []
    for k in range(ROUNDS):
        out.append(
            f"""best{k} as (select session_id, frame_idx, l0, l1, d2 from (select *,
    row_number() over (partition by session_id, frame_idx, l0 order by d2, l0, l1) as a,
    row_number() over (partition by session_id, frame_idx, l1 order by d2, l0, l1) as b from left{k}) where a = 1 and b = 1),
left{k + 1} as (select p.* from left{k} p anti join best{k} x using (session_id, frame_idx, l0))"""
        )
        out[-1] = out[-1].replace(f"left{k + 1} as (", f"half{k} as (") + f",\nleft{k + 1} as (select p.* from half{k} p anti join best{k} x using (session_id, frame_idx, l1))"
    return ",\n".join(out) + ",\nmatches as (" + " union all ".join(f"select * from best{k}" for k in range(ROUNDS)) + ")"


MATCHES = f"""
left0 as (select a.session_id, a.frame_idx, a.label as l0, b.label as l1, (a.row_c-b.row_c)*(a.row_c-b.row_c) + (a.col_c-b.col_c)*(a.col_c-b.col_c) as d2
  from cells a join cells b on b.session_id = a.session_id and b.frame_idx = a.frame_idx + 1
  where (a.row_c-b.row_c)*(a.row_c-b.row_c) + (a.col_c-b.col_c)*(a.col_c-b.col_c) <= {D.max_match_px**2}),
{_rounds()}"""

TRACKS = f"""
chain as (select session_id, frame_idx, label, frame_idx as root_frame, label as root_label from cells
    where not exists (select 1 from matches m where m.session_id = cells.session_id and m.frame_idx + 1 = cells.frame_idx and m.l1 = cells.label)
  union all select h.session_id, h.frame_idx + 1, m.l1, h.root_frame, h.root_label from chain h join matches m on m.session_id = h.session_id and m.frame_idx = h.frame_idx and m.l0 = h.label),
entries as (select c.*, h.root_frame, h.root_label from cells c join chain h using (session_id, frame_idx, label)),
steps as (select * from (select session_id, root_frame, root_label, frame_idx,
    ((lead(frame_idx) over w - frame_idx) * {D.frame_s}) as dt,
    (lead(row_c) over w - row_c) / ((lead(frame_idx) over w - frame_idx) * {D.frame_s}) as vy,
    (lead(col_c) over w - col_c) / ((lead(frame_idx) over w - frame_idx) * {D.frame_s}) as vx
  from entries window w as (partition by session_id, root_frame, root_label order by frame_idx)) where dt > 0),
mean_v as (select session_id, root_frame, root_label, avg(vy) vy, avg(vx) vx, count(*) n_steps from steps group by all),
velocity as (select *, sqrt(pow(vy*{KR!r},2) + pow(vx*{KC!r},2))*3600 as speed_kmh,
    fmod(degrees(atan2(vx*{KC!r}, -(vy*{KR!r}))) + 360.0, 360.0) as bearing from mean_v),
turning as (select session_id, root_frame, root_label, count(a) as n_moving, 1 - sqrt(pow(avg(sin(a)),2) + pow(avg(cos(a)),2)) as variance
  from (select *, case when abs(vy) > 1e-9 or abs(vx) > 1e-9 then atan2(vy, vx) end as a from steps) group by all),
coherence as (select *, case when n_moving = 0 then false when n_moving = 1 then true else variance <= {D.max_angular_variance} end as coherent from turning),
summary as (select session_id, root_frame, root_label, count(*) as length, max(frame_idx) as last_frame, max(peak) as track_peak,
    arg_min(peak, frame_idx) first_peak, arg_max(peak, frame_idx) last_peak, arg_max(label, frame_idx) last_label, arg_max(row_c, frame_idx) row_c, arg_max(col_c, frame_idx) col_c
  from entries group by all),
gated as (select * from summary where last_frame = 7 and (length >= {D.min_frames} or (length >= {D.bypass_frames} and track_peak >= {D.bypass_intensity})))"""

PLACES = """
places as (select n_nationkey::bigint as location_id, n_name as name, (n_nationkey*13)%64 as loc_row, (n_nationkey*29)%64 as loc_col from nation)"""


def _trend(name: str, distances: str) -> str:
    return f"""
{name}_path as (select session_id, root_frame, root_label, location_id, list(struct_pack(f := frame_idx, d := dist_km) order by frame_idx) as p from ({distances}) group by all),
{name} as (select session_id, root_frame, root_label, location_id, len(p)::int as n, p[1].d as first_km, case when len(p) > 1 then p[len(p)-1].d end as before_km, p[len(p)].d as last_km,
    ((p[len(p)].f - p[1].f) * {D.frame_s})::double as duration_s from {name}_path)"""


def _eta(name: str, source: str, ok: str, least: float, out: str) -> str:
    rate = "((first_km - last_km) / nullif(duration_s, 0) * 3600)"
    return f"""
{name} as (select session_id, root_frame, root_label, location_id, case when ({ok}) and first_km - last_km >= {least} and {rate} <= {D.max_speed_kmh} then
    case when last_km - {D.proximity_km} <= 0 then 0.0 when (last_km - {D.proximity_km}) / {rate} * 3600 <= {D.lookahead_s} then (last_km - {D.proximity_km}) / {rate} * 3600 end end as {out} from {source})"""


ARRIVALS = (
    _trend(
        "centroid_trend",
        f"select e.session_id, e.root_frame, e.root_label, location_id, frame_idx, sqrt(pow(e.row_c-loc_row,2)+pow(e.col_c-loc_col,2))*{KM!r} as dist_km from entries e semi join gated g using (session_id, root_frame, root_label) cross join places",
    )
    + ","
    + _trend(
        "edge_trend",
        f"select e.session_id, e.root_frame, e.root_label, location_id, e.frame_idx, min(sqrt(pow(l.r-loc_row,2)+pow(l.c-loc_col,2)))*{KM!r} as dist_km from entries e semi join gated g using (session_id, root_frame, root_label) join labelled l using (session_id, frame_idx, label) cross join places group by all",
    )
    + ","
    + _eta("closing", "centroid_trend", "(n < 3 or last_km < before_km) and duration_s > 0 and first_km > last_km", D.centroid_min_closing_km, "w04_s")
    + ","
    + _eta("edge", "edge_trend", "n >= 2 and last_km < first_km and last_km < before_km", D.edge_min_closing_km, "w05_s")
    + f""",
placed as (select g.*, v.vy, v.vx, v.n_steps, v.speed_kmh, v.bearing, k.coherent, p.location_id, p.loc_row, p.loc_col, sqrt(pow(g.row_c-loc_row,2)+pow(g.col_c-loc_col,2)) <= {PX!r} as overhead
  from gated g left join velocity v using (session_id, root_frame, root_label) left join coherence k using (session_id, root_frame, root_label) cross join places p),
projected as (select p.*, (select min(t) from range(0, {D.lookahead_s + 1}, {D.step_s}) s(t) where sqrt(pow(row_c + vy*t - loc_row,2) + pow(col_c + vx*t - loc_col,2)) <= {PX!r})::double as w06_s from placed p),
evaluated as (select session_id, root_frame, root_label, location_id, row_c, col_c, case when overhead then 'overhead' else 'approaching' end as kind, coalesce(speed_kmh,0) speed_kmh, coalesce(bearing,0) bearing,
    case when overhead then 0.0 when not coherent then w05_s else coalesce(w06_s, w04_s, w05_s) end as arrival_s, last_peak
  from projected left join closing using (session_id, root_frame, root_label, location_id) left join edge using (session_id, root_frame, root_label, location_id)
  where not (case when overhead then coalesce(speed_kmh,0) > {D.max_speed_kmh} when n_steps is null then true when not coherent then w05_s is null else coalesce(speed_kmh,0) > {D.max_speed_kmh} end)),
near_rain as (select session_id, location_id, frame_idx, max(inten) as inten from pixels join places on abs(r-loc_row) <= {int(PX)} and abs(c-loc_col) <= {int(PX)} where frame_idx > {7 - D.recent_frames} group by all having max(inten) >= {D.intensity}),
rain as (select session_id, location_id, max(frame_idx) as rain_frame, arg_max(inten, frame_idx) as rain_intensity from near_rain group by all),
reduced as (select session_id, location_id, min(arrival_s) as arrival_s, max(case when arrival_s is not null then last_peak end) as contribution, count(*) as n_cells from evaluated group by all),
sessions as (select session_id, count(distinct frame_idx) as n_frames from pixels group by all),
merged as (select s.session_id, p.location_id, n_frames, case when n_frames >= 2 then least(arrival_s, (rain_frame - 7) * {float(D.frame_s)}) end as best, contribution, rain_frame, rain_intensity, n_cells
  from sessions s cross join places p left join reduced using (session_id, location_id) left join rain using (session_id, location_id)),
detections as (select session_id, location_id, best is not null as rain_expected, best as arrival_s, case when best is not null then greatest(coalesce(contribution,0), coalesce(rain_intensity,0)) else 0.0 end::double as max_intensity,
    n_frames >= 2 and rain_frame is not null as rain_at_location, (case when n_frames >= 2 then coalesce(n_cells,0) else 0 end)::bigint as n_cells,
    case when n_frames < 2 then 'unavailable' when n_frames < 3 then 'degraded' else 'normal' end as confidence from merged)"""
)

#: Detection over effective pixels: ``conf`` (session_id, frame_idx, r, c, inten, conf) stands before.
CELLS_QC = (
    "effective as (select session_id, frame_idx, r, c, inten*conf as inten, inten as raw, conf from conf),"
    + CELLS.replace("from pixels where inten", "from effective where inten")
    .replace("labelled as (select s.*,", "labelled as (select s.session_id, s.frame_idx, s.r, s.c, s.raw as inten, s.conf,")
    .replace("max(inten) as peak from labelled", "max(inten) as peak, avg(conf) as mean_conf from labelled")
)
ARRIVALS_QC = (
    ARRIVALS.replace("evaluated as (select", "judged as (select", 1)
    .replace("near_rain as (select", f"""evaluated as (select j.session_id, j.root_frame, j.root_label, location_id, kind, speed_kmh, bearing, mean_conf, case when mean_conf >= {D.min_confidence} then arrival_s end as arrival_s, j.last_peak
  from judged j join summary s using (session_id, root_frame, root_label) join cells c on c.session_id = s.session_id and c.frame_idx = s.last_frame and c.label = s.last_label),
near_rain as (select * from (select""")
    .replace("max(inten) as inten from pixels join", "max(inten) as inten, first(conf order by inten desc, r*64+c) as at_conf from effective join")
    .replace(f"group by all having max(inten) >= {D.intensity})", f"group by all) where inten >= {D.intensity} and at_conf >= {D.min_confidence})")
)
TRACKS_TWICE = TRACKS.replace(f"length >= {D.min_frames} or", f"length >= {2 * D.min_frames} or")
ARRIVALS_FASTER = (
    ARRIVALS.replace("placed as (select g.*,", """turns as (select *, (lead(vy) over w - vy) / lead(dt) over w as ay, (lead(vx) over w - vx) / lead(dt) over w as ax from steps window w as (partition by session_id, root_frame, root_label order by frame_idx)),
pull as (select session_id, root_frame, root_label, coalesce(avg(ay),0) as ay, coalesce(avg(ax),0) as ax from turns group by all),
placed as (select g.*, ay, ax,""")
    .replace("cross join places p),", "left join pull using (session_id, root_frame, root_label) cross join places p),")
    .replace("row_c + vy*t -", "row_c + vy*t + 0.5*ay*t*t -").replace("col_c + vx*t -", "col_c + vx*t + 0.5*ax*t*t -")
)

_Q = {"T": TRACKS_TWICE, "A": ARRIVALS_QC, "F": ARRIVALS_FASTER, "C": CELLS_QC, "p": PIXELS, "c": CELLS, "m": MATCHES, "t": TRACKS, "l": PLACES, "a": ARRIVALS}


def sql(parts: str, body: str) -> str:
    """``body`` after the shared parts: p pixels, c cells, m matches, t tracks, l places, a arrivals;
    C and A with confidence, T for twice as many frames, F with acceleration."""
    return "with recursive" + ",".join(_Q[x] for x in parts) + "\n" + body  # a body may begin with a comma and go on with the list


PALETTE = "palette as (select * from (values " + ", ".join(f"({i}, {r}, {g}, {b}, {v}::double)" for i, (r, g, b, v) in enumerate(TIERS)) + ") t(tier, pr, pg, pb, intensity))"
COLOURS = """colours as (select f as frame_idx, (event_id//256)::int as row, (event_id%256)::int as col, ((event_id*7+f*13)%8*36)::int as r, ((event_id*11+f*5)%6*51)::int as g, ((event_id*5+f*3)%4*85)::int as b,
  (case when event_id%9=0 then event_id%20 else 255 end)::int as alpha from events, range(2) x(f))"""
NEAREST = f"""{PALETTE}, {COLOURS},
distinct_rgb as (select distinct r, g, b from colours),
nearest as (select r, g, b, min(d2) as d2, arg_min(tier, d2*100+tier) as tier, arg_min(intensity, d2*100+tier) as intensity from (select *, ((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb))::int as d2 from distinct_rgb, palette) group by r, g, b)"""
GEO = "geo as (select n_nationkey::bigint as location_id, n_nationkey*6.37::double-70.0 as lat, n_nationkey*13.7::double-160.0 as lon from nation), geod as (select location_id, lat::double as lat, lon::double as lon from geo)"
OBS = "obs as (select (user_id%25) as station, (ceil(floor(epoch(ts))/900)*900)::bigint as obs, value/100 as rain_mm from events where event_type='purchase')"
PRED = "pred as (select event_id, (user_id%25) as station, floor(epoch(ts))::bigint as t, value > 50 as predicted from events where event_type='click')"
