"""Expected results of the region queries, computed pixel by pixel."""

from __future__ import annotations

from inkloom.plans.oracle.common import PIXELS, with_
from inkloom.plans.oracle.labels import BAND, labelled

MASK = """
mask AS (SELECT image_id, x, y, w, h, CASE WHEN least(pr, pg, pb) >= 250 THEN NULL
  ELSE CAST(pr * 65536 + pg * 256 + pb AS BIGINT) END AS c FROM ref),
offs AS (SELECT dx, dy FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS dx), (SELECT unnest([-2, -1, 0, 1, 2]) AS dy)
  WHERE abs(dx) + abs(dy) <= 2)"""
OPENED = """
hit AS (SELECT a.image_id, a.x, a.y FROM mask a CROSS JOIN offs o JOIN mask b
  ON b.image_id = a.image_id AND b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE a.c = b.c),
eroded AS (SELECT image_id, x, y FROM hit GROUP BY ALL HAVING count(*) = 13),
opened AS (SELECT DISTINCT m.image_id, m.x, m.y, m.w, m.h, m.c FROM eroded e JOIN mask s
   ON s.image_id = e.image_id AND s.x = e.x AND s.y = e.y
  CROSS JOIN offs o JOIN mask m ON m.image_id = e.image_id AND m.x = e.x + o.dx AND m.y = e.y + o.dy
  WHERE m.c = s.c)"""


def components(source: str) -> str:
    """Smallest row-major position reachable over equal 4-neighbours."""
    return f"""
step AS (SELECT unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy),
cc(image_id, x, y, c, lab) USING KEY (image_id, x, y) AS (
 SELECT image_id, x, y, c, CAST(y * w + x AS BIGINT) FROM {source} WHERE c IS NOT NULL
 UNION
 SELECT n.image_id, n.x, n.y, n.c, min(t.lab) FROM cc t CROSS JOIN step o JOIN recurring.cc n
  ON n.image_id = t.image_id AND n.x = t.x + o.dx AND n.y = t.y + o.dy AND n.c = t.c AND t.lab < n.lab
 GROUP BY n.image_id, n.x, n.y, n.c)"""


STATS = """
dims AS (SELECT image_id, max(w) AS w, max(h) AS h FROM mask GROUP BY image_id),
box AS (SELECT image_id, c, lab, count(*) AS area, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1
  FROM cc GROUP BY image_id, c, lab),
shape AS (SELECT b.*, d.w, d.h, greatest(bx1 - bx0 + 1, by1 - by0 + 1) / greatest(1, least(bx1 - bx0 + 1, by1 - by0 + 1)) AS aspect,
  least(bx1 - bx0 + 1, by1 - by0 + 1) / 2.0e0 * 0.99e0 AS radius, (bx0 + bx1) / 2.0e0 AS cx, (by0 + by1) / 2.0e0 AS cy
  FROM box b JOIN dims d USING (image_id)),
cand AS (SELECT *, area >= w * h * 0.06e0 AND aspect <= 4.0 AND radius >= 2 AS candidate FROM shape),
ringpx AS (SELECT c.image_id, c.c, c.lab, sqrt((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy)) AS d, c.radius
  FROM cand c JOIN cc p USING (image_id, c, lab) WHERE c.candidate),
ring AS (SELECT image_id, c, lab, count(*) AS ring_px, stddev_pop(d) / (avg(d) + 1e-6) AS ring_cv FROM ringpx
  WHERE d >= radius * 0.88e0 GROUP BY image_id, c, lab),
disk AS (SELECT c.image_id, c.c, c.lab, count(*) AS n FROM cand c JOIN mask m USING (image_id)
  WHERE c.candidate AND (m.x - c.cx) * (m.x - c.cx) + (m.y - c.cy) * (m.y - c.cy) <= c.radius * c.radius GROUP BY ALL),
stats AS (SELECT c.*, r.ring_px, r.ring_cv, CASE WHEN candidate THEN area / k.n END AS fill,
  coalesce(candidate AND ring_px >= 10 AND ring_cv <= 0.5 AND area / k.n >= 0.5, false) AS is_disk
  FROM cand c LEFT JOIN ring r USING (image_id, c, lab) LEFT JOIN disk k USING (image_id, c, lab))"""
SNAP = """
own AS (SELECT image_id, x, y, CAST(pr * 65536 + pg * 256 + pb AS BIGINT) AS c, least(pr, pg, pb) >= 250 AS white FROM ref),
act AS (SELECT o.image_id, o.x, o.y, s.c AS sc, s.lab,
   CASE WHEN d2 <= radius * radius AND white THEN 16777215 WHEN d2 <= radius * radius THEN s.c
    WHEN d2 <= (radius * 1.05e0) * (radius * 1.05e0) AND o.c = s.c THEN 16777215 END AS v
  FROM own o JOIN stats s ON s.image_id = o.image_id AND s.is_disk,
  LATERAL (SELECT (o.x - s.cx) * (o.x - s.cx) + (o.y - s.cy) * (o.y - s.cy) AS d2) q),
fin AS (SELECT o.image_id, o.x, o.y, coalesce(a.v, o.c) AS v FROM own o LEFT JOIN
  (SELECT image_id, x, y, arg_max(v, (sc, lab)) AS v FROM act WHERE v IS NOT NULL GROUP BY image_id, x, y) a
  ON a.image_id = o.image_id AND a.x = o.x AND a.y = o.y)"""


def sql() -> dict[str, str]:
    base = (PIXELS, BAND, labelled("pixels", "ref"), MASK)
    return {
        "R0_binary_opening": with_(*base, OPENED, select="SELECT image_id, x, y, c FROM opened"),
        "R1_connected_components": with_(*base, components("mask"), select="""
            SELECT image_id, x, y, c, lab AS region FROM cc"""),
        "A27_region_stats": with_(*base, OPENED, components("opened"), STATS, select="""
            SELECT image_id, c, lab AS region, area, bx0, bx1, by0, by1, round(aspect, 6) AS aspect, round(radius, 6) AS radius,
              ring_px, round(ring_cv, 6) AS ring_cv, round(fill, 6) AS fill, is_disk FROM stats"""),
        "R2_snap_disks": with_(*base, OPENED, components("opened"), STATS, SNAP, select="""
            SELECT image_id, x, y, CAST(v // 65536 AS BIGINT) AS r, CAST((v // 256) % 256 AS BIGINT) AS g,
              CAST(v % 256 AS BIGINT) AS b FROM fin"""),
        "R2_snap_disks_alpha": with_(*base, OPENED, components("opened"), STATS, SNAP, select="""
            SELECT f.image_id, f.x, f.y, CAST(v // 65536 AS BIGINT) AS r, CAST((v // 256) % 256 AS BIGINT) AS g,
              CAST(v % 256 AS BIGINT) AS b, CAST(p.a AS BIGINT) AS a
            FROM fin f JOIN pixels p ON p.image_id = f.image_id AND p.x = f.x AND p.y = f.y"""),
    }
