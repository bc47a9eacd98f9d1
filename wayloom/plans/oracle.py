"""The same analyses as DuckDB SQL, put together from named parts."""

from __future__ import annotations

from ..sources.derive import POINTS_SQL

GPS = "gps AS (" + POINTS_SQL.replace("{ep}", "CAST(floor(epoch(ts)) AS BIGINT)").replace("{st}", "VARCHAR").replace("{events}", "events") + ")"


def center(a: str) -> str:
    return f"(({a}) - 360e0*floor((({a}) + 180e0)/360e0))"


def fixed(a: str, digits: int = 6) -> str:
    return f"(floor(({a}) * 1e{digits} + 0.5e0) / 1e{digits})"


def mean(c: str) -> str:
    """The mean of a column by whole micrometres."""
    return fixed(f"sum(CAST(floor({c}*1e6 + 0.5e0) AS BIGINT)) / 1e6 / count(*)")


_BEARING = "degrees(atan2(b_y - a_y, b_x - a_x))"
_RA, _RB = center(f"{_BEARING} - a_orientation"), center(f"{_BEARING} - b_orientation")
_COLS = ("point_id", "x", "y", "z", "orientation", "speed", "dense_ts AS ts", "tag")
_NAMES = [c.split(" AS ") for c in _COLS]
PAIRS = (
    "p0 AS (SELECT vehicle, seq, "
    + ", ".join(f"{c[0]} AS a_{c[-1]}" for c in _NAMES) + ", "
    + ", ".join(f"lead({c[0]}) OVER w AS b_{c[-1]}" for c in _NAMES)
    + " FROM gps WINDOW w AS (PARTITION BY vehicle ORDER BY seq)),\n"
    + "pm AS (SELECT *, b_ts - a_ts AS dt, sqrt((b_x - a_x)*(b_x - a_x) + (b_y - a_y)*(b_y - a_y)) AS dist, "
    + f"CASE WHEN a_speed >= 0 AND b_speed >= 0 THEN false WHEN a_speed <= 0 AND b_speed <= 0 THEN true "
    + f"WHEN {_RA} BETWEEN -90 AND 90 AND ({_RB} <= -90 OR {_RB} >= 90) THEN false "
    + f"WHEN ({_RA} <= -90 OR {_RA} >= 90) AND {_RB} BETWEEN -90 AND 90 THEN true ELSE a_speed + b_speed < 0 END AS rev "
    + "FROM p0 WHERE b_point_id IS NOT NULL),\n"
    + "pv AS (SELECT *, CASE WHEN dt = 0 AND a_x = b_x AND a_y = b_y AND a_z = b_z AND a_orientation = b_orientation THEN 'identical' "
    + "WHEN dt > 30 AND dist > 200 THEN 'gap' WHEN dt > 0 AND dist / dt > 80e0/3.6e0 THEN 'speed' END AS verdict FROM pm),\n"
    + "ed AS (SELECT * FROM pv WHERE verdict IS NULL)"
)
_CELL = "((CAST(floor(x/30e0) AS BIGINT) + 1048576) * 2097152 + (CAST(floor(y/30e0) AS BIGINT) + 1048576)) * 16 + CAST(floor((orientation + 180e0)/30e0) AS BIGINT)"
CLUSTERS = f"""cl AS (SELECT *, {_CELL} AS id FROM gps),
st AS (SELECT id, {", ".join(f"{mean(c)} AS {c}" for c in "xyz")},
  {fixed(center("degrees(atan2(sum(sin(radians(orientation))), sum(cos(radians(orientation)))))"))} AS orientation,
  {fixed("var_pop(z)")} AS z_variance, count(*) AS weight FROM cl GROUP BY id)"""
LINKS = """lk AS (SELECT CASE WHEN rev THEN b.id ELSE a.id END AS src, CASE WHEN rev THEN a.id ELSE b.id END AS dst, rev,
  CASE WHEN rev THEN b_ts ELSE a_ts END AS src_ts, CASE WHEN rev THEN a_ts ELSE b_ts END AS dst_ts, a_tag, a_point_id, b_point_id
  FROM ed JOIN cl a ON a.point_id = a_point_id JOIN cl b ON b.point_id = b_point_id WHERE a.id != b.id),
ss AS (SELECT src, dst, count(*) AS weight, min(src_ts) AS first_src, max(dst_ts) AS last_dst, greatest(max(src_ts), max(dst_ts)) AS last_traversal FROM lk GROUP BY src, dst),
lv AS (SELECT * FROM ss WHERE weight >= 2)"""
EQUIPMENT = """dg AS (SELECT 'D' || vehicle AS name, arg_max({'x': x, 'y': y, 'z': z, 'ts': timestamp}, {'t': timestamp, 's': seq}) AS v FROM gps WHERE vehicle % 10 = 0 GROUP BY 1),
dm AS (SELECT 'P' || vehicle AS name, arg_max({'x': x, 'y': y, 'z': z, 'ts': timestamp}, {'t': timestamp, 's': seq}) AS v FROM gps WHERE vehicle % 10 = 1 GROUP BY 1),
el AS (SELECT 'D' || vehicle AS name, arg_max({'location': tag, 'ts': timestamp}, {'t': timestamp, 's': seq}) AS v FROM gps WHERE vehicle % 10 = 0 AND tag IS NOT NULL GROUP BY 1),
lt AS (SELECT tag, arg_max({'x': x, 'y': y, 'z': z, 'ts': timestamp}, {'t': timestamp, 's': -point_id}) AS v FROM gps WHERE tag IS NOT NULL GROUP BY tag),
diggers AS (SELECT name, v.x AS x, v.y AS y, v.z AS z, v.ts AS ts FROM dg), dumps AS (SELECT name, v.x AS x, v.y AS y, v.z AS z, v.ts AS ts FROM dm),
locations AS (SELECT name, v.location AS location, v.ts AS ts FROM el), tags AS (SELECT tag, v.x AS x, v.y AS y, v.z AS z, v.ts AS ts FROM lt)"""
TAGS = """ch0 AS (SELECT *, CASE WHEN lag(b_point_id) OVER (PARTITION BY vehicle ORDER BY seq) = a_point_id THEN 0 ELSE 1 END AS broken FROM ed),
ch1 AS (SELECT *, sum(broken) OVER (PARTITION BY vehicle ORDER BY seq) AS chain FROM ch0),
ch2 AS (SELECT *, CAST(floor(dist*1e6 + 0.5e0) AS BIGINT) AS um, sum(CAST(floor(dist*1e6 + 0.5e0) AS BIGINT)) OVER (PARTITION BY vehicle, chain ORDER BY seq) AS tu FROM ch1),
ch AS (SELECT *, tu / 1e6 AS to_, (tu - um) / 1e6 AS at_ FROM ch2),
tp AS (SELECT vehicle, chain, pid, max(p) AS p, any_value(t0) AS t0, any_value(tag) AS tag FROM (
  SELECT vehicle, chain, at_ AS p, a_ts AS t0, a_point_id AS pid, a_tag AS tag FROM ch WHERE a_tag IS NOT NULL
  UNION ALL SELECT vehicle, chain, to_, b_ts, b_point_id, b_tag FROM ch WHERE b_tag IS NOT NULL) GROUP BY ALL),
pt AS (SELECT a_point_id, b_point_id, arg_min(tp.tag, {'t': t0, 'p': pid}) AS tag FROM ch JOIN tp USING (vehicle, chain)
  WHERE (at_ >= p AND to_ - p <= 100 AND b_ts <= t0 + 300) OR (to_ <= p AND p - at_ <= 100 AND a_ts >= t0 - 300) GROUP BY a_point_id, b_point_id),
vt AS (SELECT src, dst, pt.tag AS tag, count(*) AS votes FROM lk LEFT JOIN pt USING (a_point_id, b_point_id) GROUP BY src, dst, pt.tag),
mj AS (SELECT src, dst, tag, votes FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY votes DESC, tag ASC NULLS LAST) AS n FROM vt) WHERE n = 1 AND tag IS NOT NULL AND votes >= 2),
zn AS (SELECT id, max(tag) AS tag FROM (SELECT src AS id, tag FROM mj UNION ALL SELECT dst, tag FROM mj) GROUP BY id)"""
#: Waypoints by chords: Dijkstra over each live connection's poses, one step of all connections in each round.
_OK = f"""sqrt((P[n].x-P[prev[i]].x)*(P[n].x-P[prev[i]].x) + (P[n].y-P[prev[i]].y)*(P[n].y-P[prev[i]].y)) >= 1e-5
  AND {center('P[i].h - ch')} BETWEEN least(-30, {center('P[prev[i]].h - ch')} - 30, {center('P[n].h - ch')} - 30) AND greatest(30, {center('P[prev[i]].h - ch')} + 30, {center('P[n].h - ch')} + 30)"""
CHORDS = f"""cc AS (SELECT s.src, s.dst, list({{'id': m.id, 'x': m.x, 'y': m.y, 'h': m.orientation}} ORDER BY m.id) AS between_ FROM lv s JOIN st a ON a.id = s.src JOIN st b ON b.id = s.dst JOIN st m ON m.id NOT IN (s.src, s.dst)
  AND sqrt((m.x-(a.x+b.x)/2)*(m.x-(a.x+b.x)/2) + (m.y-(a.y+b.y)/2)*(m.y-(a.y+b.y)/2)) <= sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))/2 GROUP BY s.src, s.dst),
po AS (SELECT s.src, s.dst, list_concat(list_concat([{{'id': a.id, 'x': a.x, 'y': a.y, 'h': a.orientation}}], coalesce(between_, [])), [{{'id': b.id, 'x': b.x, 'y': b.y, 'h': b.orientation}}]) AS P
  FROM lv s JOIN st a ON a.id = s.src JOIN st b ON b.id = s.dst LEFT JOIN cc ON cc.src = s.src AND cc.dst = s.dst),
dj(src, dst, P, n, cost, prev, done, ended) AS (
  SELECT src, dst, P, len(P), list_transform(range(1, len(P) + 1), lambda k: CASE WHEN k = 1 THEN 0e0 ELSE 'inf'::DOUBLE END), list_transform(range(1, len(P) + 1), lambda k: 0::BIGINT), list_transform(range(1, len(P) + 1), lambda k: false), false FROM po
  UNION ALL
  SELECT src, dst, P, n, CASE WHEN shut THEN cost ELSE list_transform(range(1, n + 1), lambda k: CASE WHEN better[k] THEN way[k] ELSE cost[k] END) END,
    CASE WHEN shut THEN prev ELSE list_transform(range(1, n + 1), lambda k: CASE WHEN better[k] THEN i ELSE prev[k] END) END, now_done, i = n
  FROM (SELECT *, list_transform(range(1, n + 1), lambda k: NOT now_done[k] AND way[k] < cost[k]) AS better
    FROM (SELECT *, i = n OR (i != 1 AND NOT ({_OK})) AS shut, list_transform(range(1, n + 1), lambda k: k = i OR done[k]) AS now_done,
      list_transform(range(1, n + 1), lambda k: cost[i] + ((P[k].x-P[i].x)*(P[k].x-P[i].x) + (P[k].y-P[i].y)*(P[k].y-P[i].y))) AS way
      FROM (SELECT *, CASE WHEN i > 1 THEN degrees(atan2(P[n].y-P[prev[i]].y, P[n].x-P[prev[i]].x)) END AS ch
        FROM (SELECT *, list_position(open_, list_min(open_))::BIGINT AS i
          FROM (SELECT *, list_transform(range(1, n + 1), lambda k: CASE WHEN done[k] THEN 'inf'::DOUBLE ELSE cost[k] END) AS open_ FROM dj WHERE NOT ended)))))),
bt(src, dst, P, prev, path, k) AS (SELECT src, dst, P, prev, [P[n].id], n::BIGINT FROM dj WHERE ended UNION ALL SELECT src, dst, P, prev, list_prepend(P[prev[k]].id, path), prev[k] FROM bt WHERE k > 1),
cp AS (SELECT src, dst, path FROM bt WHERE k = 1),
cs AS (SELECT DISTINCT src, dst, path[k] AS s, path[k + 1] AS d FROM (SELECT src, dst, path, unnest(range(1, len(path))) AS k FROM cp))"""


#: Zones: tails without seeds go round by round; in each round those from clusters without a way in (g), then those from clusters without a way out (h).
ZONES = """tz(tag, ed_, S, L, g, h, phase) AS (
  SELECT tag, list({'a': src, 'b': dst}), coalesce(any_value(s), []), list_distinct(list_concat(list(src), list(dst))), []::BIGINT[], []::BIGINT[], 1 FROM mj LEFT JOIN (SELECT tag, list(DISTINCT id) AS s FROM cl WHERE tag IS NOT NULL GROUP BY tag) USING (tag) GROUP BY tag
  UNION ALL
  SELECT tag, CASE WHEN turn THEN list_filter(ed_, lambda e: NOT list_contains(gh, e.a) AND NOT list_contains(gh, e.b)) ELSE ed_ END, S, CASE WHEN turn THEN list_filter(L, lambda v: NOT list_contains(gh, v)) ELSE L END,
    CASE WHEN turn THEN [] WHEN phase = 1 THEN list_concat(g, new) ELSE g END, CASE WHEN turn THEN [] WHEN phase = 2 THEN list_concat(h, new) ELSE h END,
    CASE WHEN len(new) > 0 THEN phase WHEN phase = 1 THEN 2 WHEN turn THEN 1 ELSE 9 END
  FROM (SELECT *, list_concat(g, h) AS gh, phase = 2 AND len(new) = 0 AND len(g) + len(h) > 0 AS turn FROM (SELECT *, CASE WHEN phase = 1
      THEN list_filter(L, lambda v: NOT list_contains(S, v) AND NOT list_contains(g, v) AND len(list_filter(ed_, lambda e: e.a = v)) <= 1 AND (len(list_filter(ed_, lambda e: e.b = v)) = 0 OR len(list_filter(ed_, lambda e: e.b = v AND list_contains(g, e.a))) > 0))
      ELSE list_filter(L, lambda v: NOT list_contains(S, v) AND NOT list_contains(g, v) AND NOT list_contains(h, v) AND len(list_filter(ed_, lambda e: e.b = v)) <= 1 AND (len(list_filter(ed_, lambda e: e.a = v)) = 0 OR len(list_filter(ed_, lambda e: e.a = v AND list_contains(h, e.b))) > 0)) END AS new FROM tz WHERE phase < 9))),
zo AS (SELECT id, max(tag) AS tag FROM (SELECT tag, unnest(L) AS id FROM tz WHERE phase = 9) GROUP BY id),
zt AS (SELECT DISTINCT a.tag AS a, b.tag AS b FROM ss JOIN zo a ON a.id = src JOIN zo b ON b.id = dst WHERE a.tag != b.tag), zu AS (SELECT a, b FROM zt UNION SELECT b, a FROM zt),
zr(node, label) AS (SELECT tag, tag FROM zo UNION SELECT r.node, u.b FROM zr r JOIN zu u ON u.a = r.label),
zm AS (SELECT id, meta FROM zo JOIN (SELECT node, min(label) AS meta FROM zr GROUP BY node) ON node = tag)"""
#: Runs of points inside one meta zone, in chains of pairs.
RUNS = """cpt AS (SELECT vehicle, chain, seq, a_point_id AS point_id FROM ch UNION ALL SELECT vehicle, chain, max(seq) + 1, arg_max(b_point_id, seq) FROM ch GROUP BY vehicle, chain),
zs AS (SELECT vehicle, chain, cpt.seq AS seq, point_id, cl.id, meta FROM cpt JOIN cl USING (point_id, vehicle) LEFT JOIN zm ON zm.id = cl.id),
zq AS (SELECT *, sum(nw) OVER (PARTITION BY vehicle, chain ORDER BY seq) AS run FROM (SELECT *, CASE WHEN lag(meta) OVER (PARTITION BY vehicle, chain ORDER BY seq) IS NOT DISTINCT FROM meta THEN 0 ELSE 1 END AS nw FROM zs))"""


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join((GPS, *parts)) + "\n" + body
