"""Expected results of the outline and SVG queries."""

from __future__ import annotations

from inkloom.plans.fixture_sql import SVG_DOCS, VERTICES
from inkloom.plans.oracle.common import with_

POINTS = "pts AS (SELECT path_id, CAST(seq AS BIGINT) AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM vertices)"
BODY = """
cnt AS (SELECT path_id, count(*) AS n FROM pts GROUP BY path_id),
ends AS (SELECT c.path_id, c.n, a.x AS x0, a.y AS y0, abs(a.x - z.x) < 0.5 AND abs(a.y - z.y) < 0.5 AS closed FROM cnt c
  JOIN pts a ON a.path_id = c.path_id AND a.seq = 0 JOIN pts z ON z.path_id = c.path_id AND z.seq = c.n - 1),
body AS (SELECT p.* FROM pts p JOIN ends e USING (path_id) WHERE NOT closed OR seq < n - 1)"""
RING = """
wrapped AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
  FROM body WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
ringm AS (SELECT path_id, count(*) AS n_points, abs(sum(x * ny - nx * y)) / 2 AS area,
  sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter FROM wrapped GROUP BY path_id)"""


def circle(source: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT path_id, x - avg(x) OVER p AS u, y - avg(y) OVER p AS v, avg(x) OVER p AS mx, avg(y) OVER p AS my, x, y
  FROM {source} WINDOW p AS (PARTITION BY path_id)),
{name}_m AS (SELECT path_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv,
  sum(u*u*u) + sum(u*v*v) AS du, sum(v*v*v) + sum(u*u*v) AS dv FROM {name}_c GROUP BY path_id HAVING count(*) >= 8),
{name}_s AS (SELECT *, (vv * du - uv * dv) / (2 * (uu * vv - uv * uv)) AS uc, (uu * dv - uv * du) / (2 * (uu * vv - uv * uv)) AS vc
  FROM {name}_m WHERE abs(2 * (uu * vv - uv * uv)) >= 1e-9),
{name}_r AS (SELECT path_id, uc + mx AS cx, vc + my AS cy, sqrt(uc * uc + vc * vc + (uu + vv) / n) AS r FROM {name}_s),
{name} AS (SELECT r.path_id, r.cx, r.cy, r.r FROM {name}_r r JOIN {source} p USING (path_id) WHERE r.r BETWEEN 2 AND 1e6
  GROUP BY ALL HAVING avg(abs(sqrt((p.x - r.cx) * (p.x - r.cx) + (p.y - r.cy) * (p.y - r.cy)) - r.r)) / r.r <= 0.08)"""


def rdp(points: str, segments: str, name: str) -> str:
    """Kept split positions of ``segments(path_id, s, e)`` over ``points``."""
    return f"""
{name}_t(path_id, s, e, m) AS (
 SELECT path_id, s, e, CAST(NULL AS BIGINT) FROM {segments}
 UNION ALL
 SELECT path_id, unnest([s, m]), unnest([m, e]), unnest([m, NULL]) FROM (
  SELECT path_id, s, e, arg_min(seq, (-d, seq)) AS m, max(d) AS d FROM (
   SELECT t.path_id, t.s, t.e, p.seq, abs((b.y - a.y) * p.x - (b.x - a.x) * p.y + b.x * a.y - b.y * a.x)
     / CASE WHEN (b.x - a.x) = 0 AND (b.y - a.y) = 0 THEN 1.0e0 ELSE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) END AS d
   FROM {name}_t t JOIN {points} a ON a.path_id = t.path_id AND a.seq = t.s JOIN {points} b ON b.path_id = t.path_id AND b.seq = t.e
   JOIN {points} p ON p.path_id = t.path_id AND p.seq > t.s AND p.seq < t.e) GROUP BY path_id, s, e) WHERE d > 1.25),
{name} AS (SELECT DISTINCT path_id, m AS seq FROM {name}_t WHERE m IS NOT NULL)"""


def collapse(points: str, name: str) -> str:
    """Sequential collinear collapse of ``points(path_id, seq, x, y, n)``."""
    return f"""
{name}_r AS (
 SELECT path_id, seq, n, x AS lx, y AS ly, true AS keep FROM {points} WHERE seq = 0
 UNION ALL
 SELECT v.path_id, v.seq, v.n, CASE WHEN k THEN v.x ELSE lx END, CASE WHEN k THEN v.y ELSE ly END, k FROM (
  SELECT v.*, t.lx, t.ly, v.seq = v.n - 1 OR coalesce(n1 >= 1e-9 AND n2 >= 1e-9 AND ((v.x - t.lx) * (q.x - v.x) + (v.y - t.ly) * (q.y - v.y)) / (n1 * n2) < 0.998e0, false) AS k
  FROM {name}_r t JOIN {points} v ON v.path_id = t.path_id AND v.seq = t.seq + 1 LEFT JOIN {points} q ON q.path_id = v.path_id AND q.seq = v.seq + 1,
  LATERAL (SELECT sqrt((v.x - t.lx) * (v.x - t.lx) + (v.y - t.ly) * (v.y - t.ly)) AS n1, sqrt((q.x - v.x) * (q.x - v.x) + (q.y - v.y) * (q.y - v.y)) AS n2) z) v),
{name} AS (SELECT p.path_id, p.seq, p.x, p.y FROM {points} p JOIN {name}_r r USING (path_id, seq) WHERE r.keep)"""


def ring_simplify(tolerance: str) -> tuple[str, ...]:
    return (
        f"""
e4 AS (SELECT c.path_id, c.n, a.x AS x0, a.y AS y0, abs(a.x - z.x) < {tolerance} AND abs(a.y - z.y) < {tolerance} AS closed
  FROM (SELECT path_id, count(*) AS n FROM pts GROUP BY path_id) c
  JOIN pts a ON a.path_id = c.path_id AND a.seq = 0 JOIN pts z ON z.path_id = c.path_id AND z.seq = c.n - 1),
w4 AS (SELECT path_id, seq, x, y FROM pts JOIN e4 USING (path_id) WHERE NOT closed OR seq < n - 1
 UNION ALL SELECT path_id, n - CASE WHEN closed THEN 1 ELSE 0 END, x0, y0 FROM e4),
m4 AS (SELECT path_id, n - CASE WHEN closed THEN 1 ELSE 0 END AS m, x0, y0, closed FROM e4),
f4 AS (SELECT w.path_id, arg_min(w.seq, (-((w.x - x0) * (w.x - x0) + (w.y - y0) * (w.y - y0)), w.seq)) AS far, any_value(m) AS m
  FROM w4 w JOIN m4 USING (path_id) WHERE w.seq BETWEEN 1 AND m - 1 GROUP BY w.path_id),
s4 AS (SELECT path_id, CAST(0 AS BIGINT) AS s, far AS e FROM f4 UNION ALL SELECT path_id, far, m FROM f4)""",
        rdp("w4", "s4", "k4"),
        """
u4 AS (SELECT path_id, seq FROM k4 UNION SELECT path_id, 0 FROM f4 UNION SELECT path_id, far FROM f4
  UNION SELECT path_id, m FROM m4 WHERE closed),
g4 AS (SELECT w.path_id, row_number() OVER (PARTITION BY w.path_id ORDER BY w.seq) - 1 AS seq, w.x, w.y,
  count(*) OVER (PARTITION BY w.path_id) AS n FROM w4 w JOIN u4 USING (path_id, seq))""",
        collapse("g4", "o4"),
    )


def num(v: str) -> str:
    return f"printf('%.2f', {v})"


BASIC = f"""
o5 AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq) - 1 AS seq, x, y,
  count(*) OVER (PARTITION BY path_id) AS n FROM o4),
line AS (SELECT path_id, any_value(n) AS n, string_agg(concat(CASE WHEN seq = 0 THEN 'M ' ELSE 'L ' END, {num('x')}, ' ', {num('y')}), ' ' ORDER BY seq)
  || CASE WHEN any_value(closed) THEN ' Z' ELSE '' END AS d FROM o5 JOIN (SELECT path_id, closed FROM e4) USING (path_id) GROUP BY path_id)"""
STRICT = "b5 AS (SELECT o.path_id, o.x, o.y FROM o5 o JOIN (SELECT path_id, closed FROM e4) USING (path_id) WHERE o.n >= 8 AND NOT (closed AND o.seq = o.n - 1))"
MIXED = """
seg AS (SELECT path_id, seq, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
smp AS (SELECT path_id, seq * 6 + k - 6 AS seq, pow(1 - k / 6.0e0, 3) * px + 3 * pow(1 - k / 6.0e0, 2) * (k / 6.0e0) * px
   + 3 * (1 - k / 6.0e0) * pow(k / 6.0e0, 2) * x + pow(k / 6.0e0, 3) * x AS x,
   pow(1 - k / 6.0e0, 3) * py + 3 * pow(1 - k / 6.0e0, 2) * (k / 6.0e0) * py + 3 * (1 - k / 6.0e0) * pow(k / 6.0e0, 2) * y + pow(k / 6.0e0, 3) * y AS y
  FROM seg, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) WHERE seq > 0
  UNION ALL SELECT path_id, 0, x, y FROM seg WHERE seq = 0)"""
BLEMISHED = """
blem AS (SELECT path_id, CASE WHEN path_id % 5 = 0 THEN '<svg></svg>' WHEN path_id % 3 = 0
  THEN replace(svg, '</svg>', repeat(' <path d="M 0.00 0.00 L 0.00 0.00 Z"/>', 3)) ELSE svg END AS svg FROM svg_docs)"""


def sql() -> dict[str, str]:
    pts, docs = (VERTICES, POINTS), (VERTICES, SVG_DOCS)
    count = "len(regexp_extract_all(svg, '{}'))"
    return {
        "A25_ring_metrics": with_(*pts, BODY, RING, select="""
            SELECT path_id, closed, n_points, round(area, 6) AS area, round(perimeter, 6) AS perimeter,
              round(4.0e0 * pi() * area / (perimeter * perimeter), 6) AS circularity FROM ringm JOIN ends USING (path_id)"""),
        "A26_fit_circle": with_(*pts, BODY, circle("body", "fit"), select="""
            SELECT path_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r FROM fit"""),
        "G1_path_vertices": with_(*pts, select="""
            SELECT path_id, CAST(0 AS BIGINT) AS path_no, CAST(0 AS BIGINT) AS ring, seq, round(x, 6) AS x, round(y, 6) AS y FROM pts"""),
        "G1_path_vertices_mixed": with_(*pts, MIXED, select="""
            SELECT path_id, CAST(0 AS BIGINT) AS path_no, CAST(0 AS BIGINT) AS ring, seq, round(x, 6) AS x, round(y, 6) AS y
            FROM (SELECT path_id, seq, x, y FROM pts WHERE path_id % 2 = 1 UNION ALL SELECT * FROM smp WHERE path_id % 2 = 0)"""),
        "G2_collapse_collinear": with_(*pts, "np AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM pts)",
                                       collapse("np", "col"), select="SELECT path_id, seq, x, y FROM col"),
        "G3_simplify_polyline": with_(
            *pts, BODY, "sg AS (SELECT path_id, CAST(0 AS BIGINT) AS s, max(seq) AS e FROM body GROUP BY path_id)",
            rdp("body", "sg", "kp"), select="""
            SELECT path_id, seq, x, y FROM body WHERE (path_id, seq) IN (SELECT (path_id, seq) FROM kp
              UNION SELECT (path_id, s) FROM sg UNION SELECT (path_id, e) FROM sg)"""),
        "G4_simplify_ring": with_(*pts, *ring_simplify("1e-6"), select="SELECT path_id, seq, x, y FROM o4"),
        "G5_circle_candidates": with_(*pts, BODY, RING, circle("body", "fit"), select="""
            SELECT path_id, round(area, 6) AS area, round(4.0e0 * pi() * area / (perimeter * perimeter), 6) AS circularity,
              round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r FROM ringm JOIN ends USING (path_id) JOIN fit USING (path_id)
            WHERE closed AND n >= 12 AND area / 40000 >= 0.04 AND 4.0e0 * pi() * area / (perimeter * perimeter) >= 0.88"""),
        "G6_normalize_basic": with_(*pts, *ring_simplify("0.5"), BASIC, select="SELECT path_id, d FROM line"),
        "G6_normalize_documents": with_(*pts, *ring_simplify("0.5"), BASIC, select="""
            SELECT path_id, concat('<svg width="200" height="200"><path d="', d, '" fill="#c53837"/> <path d=""/> <path d="', d,
              ' M 0.00 0.00 L 9.00 0.00 L 9.00 9.00 L 0.00 9.00 L 0.00 0.00 Z"/></svg>') AS svg FROM line"""),
        "G6_normalize_strict": with_(*pts, *ring_simplify("0.5"), BASIC, STRICT, circle("b5", "fit"), select=f"""
            SELECT l.path_id, CASE WHEN f.r IS NULL THEN l.d ELSE concat('M ', {num('cx + r')}, ' ', {num('cy')}, ' A ', {num('r')}, ' ', {num('r')},
              ' 0 1 1 ', {num('cx - r')}, ' ', {num('cy')}, ' A ', {num('r')}, ' ', {num('r')}, ' 0 1 1 ', {num('cx + r')}, ' ', {num('cy')}, ' Z') END AS d
            FROM line l LEFT JOIN fit f ON f.path_id = l.path_id"""),
        "P15_svg_d_extract": with_(*docs, select="""
            SELECT path_id, unnest(regexp_extract_all(svg, '\\bd="([^"]*)"', 1)) AS d FROM svg_docs"""),
        "P16_svg_node_count": with_(*pts, select="SELECT path_id, count(*) + 1 AS nodes FROM pts GROUP BY path_id"),
        "P17_degenerate_path_share": with_(*docs, BLEMISHED, select=f"""
            SELECT path_id, round({count.format('d="M 0[.]00 0[.]00 L 0[.]00 0[.]00 Z"')} / nullif({count.format('<path')}, 0), 6) AS share FROM blem"""),
        "P18_svg_fill_colors": with_(*docs, BLEMISHED, select="""
            SELECT path_id, '#c53837' AS fill FROM blem WHERE contains(svg, 'fill="#c53837"')"""),
        "P19_svg_rescale": with_(*docs, select="""
            SELECT path_id, CASE WHEN path_id % 3 = 0 THEN svg ELSE replace(replace(svg, '<svg width="200" height="200">',
              concat('<svg width="100" height="90">', chr(10), '<g transform="scale(', printf('%.6f', 1.0e0 / (path_id % 3 + 1)), ', ',
              printf('%.6f', 1.0e0 / (path_id % 3 + 1)), ')">')), '</svg>', concat('</g>', chr(10), '</svg>')) END AS svg FROM svg_docs"""),
        "S8_read_svg_docs": with_(*docs, BLEMISHED, select="""
            SELECT path_id, true AS is_svg FROM blem
            UNION ALL SELECT -page_id, regexp_matches(html, '<svg\\b', 'i') FROM pages"""),
        "S8_read_svg_files": with_(*docs, BLEMISHED, """
            fl AS (SELECT concat('doc_', path_id) AS name, svg FROM blem UNION ALL SELECT concat('page_', page_id), html FROM pages)""", select="""
            SELECT name, CASE WHEN regexp_matches(svg, '<svg\\b', 'i') THEN length(svg) END AS n_chars,
              CASE WHEN NOT regexp_matches(svg, '<svg\\b', 'i') THEN 'does not look like SVG' END AS reason FROM fl"""),
    }
