"""Shared SQL fragments."""

from __future__ import annotations

from inkloom.plans.fixture_sql import PIXELS

def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes if c) + "\n" + select


def d2(a: str, b: str) -> str:
    """Squared distance of rows/structs ``a`` and ``b`` with fields r, g, b."""
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "rgb") + ")"


def white(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"({r} >= 230 AND {g} >= 230 AND {b} >= 230)"


def light(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(({r} + {g} + {b}) / 3.0e0)"


def sat(r: str = "r", g: str = "g", b: str = "b") -> str:
    mx, mn = f"(greatest({r}, {g}, {b}) / 255.0e0)", f"(least({r}, {g}, {b}) / 255.0e0)"
    return f"(CASE WHEN {mx} < 1e-9 THEN 0.0e0 ELSE ({mx} - {mn}) / {mx} END)"


def hue(r: str = "r", g: str = "g", b: str = "b") -> str:
    R, G, B = (f"({c} / 255.0e0)" for c in (r, g, b))
    mx, mn = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    span = f"({mx} / 255.0e0 - {mn} / 255.0e0)"
    raw = (f"(CASE WHEN {mx} = {r} THEN ({G} - {B}) / {span} WHEN {mx} = {g} THEN 2.0e0 + ({B} - {R}) / {span} "
           f"ELSE 4.0e0 + ({R} - {G}) / {span} END * 60.0e0)")
    return f"(CASE WHEN {mx} = {mn} THEN 0.0e0 WHEN {raw} < 0 THEN {raw} + 360.0e0 ELSE {raw} END)"


def hue_gap(a: str, b: str) -> str:
    return f"least(abs({a}.hue - {b}.hue), 360.0e0 - abs({a}.hue - {b}.hue))"


def hsl(a: str, b: str) -> str:
    """Weighted distance of two rows/structs with light, sat, hue."""
    dl = f"(2.0e0 * (abs({a}.light - {b}.light) / 255.0e0))"
    ds = f"abs({a}.sat - {b}.sat)"
    dh = f"({hue_gap(a, b)} / 180.0e0)"
    return f"sqrt({dl} * {dl} + {ds} * {ds} + {dh} * {dh})"


BORDER = """
border AS (
 SELECT image_id, r, g, b FROM pixels WHERE y = 0 AND x % greatest(1, least(w, h) // 200) = 0
 UNION ALL SELECT image_id, r, g, b FROM pixels WHERE y = h - 1 AND x % greatest(1, least(w, h) // 200) = 0
 UNION ALL SELECT image_id, r, g, b FROM pixels WHERE x = 0 AND y % greatest(1, least(w, h) // 200) = 0
 UNION ALL SELECT image_id, r, g, b FROM pixels WHERE x = w - 1 AND y % greatest(1, least(w, h) // 200) = 0)"""

BACKGROUND = BORDER + """,
bstat AS (SELECT image_id, count(*) AS n,
  count(*) FILTER (WHERE least(r, g, b) >= 230 OR r + g + b > 600) AS nl,
  list_sort(list(r)) AS ar, list_sort(list(g)) AS ag, list_sort(list(b)) AS ab,
  list_sort(list(r) FILTER (WHERE least(r, g, b) >= 230 OR r + g + b > 600)) AS lr,
  list_sort(list(g) FILTER (WHERE least(r, g, b) >= 230 OR r + g + b > 600)) AS lg,
  list_sort(list(b) FILTER (WHERE least(r, g, b) >= 230 OR r + g + b > 600)) AS lb
 FROM border GROUP BY image_id),
bgx AS (SELECT image_id,
  CASE WHEN nl >= greatest(1, n // 3) THEN lr[nl // 2 + 1] ELSE ar[n // 2 + 1] END AS bg_r,
  CASE WHEN nl >= greatest(1, n // 3) THEN lg[nl // 2 + 1] ELSE ag[n // 2 + 1] END AS bg_g,
  CASE WHEN nl >= greatest(1, n // 3) THEN lb[nl // 2 + 1] ELSE ab[n // 2 + 1] END AS bg_b
 FROM bstat)"""

# The working copy: images with a side beyond 320 are box-reduced, the others stay.
WORK = """
big AS (SELECT *, greatest(1, CAST(floor(w / (greatest(w, h) / 320.0e0)) AS BIGINT)) AS w2,
  greatest(1, CAST(floor(h / (greatest(w, h) / 320.0e0)) AS BIGINT)) AS h2 FROM pixels WHERE greatest(w, h) > 320),
work AS (SELECT image_id, x, y, w, h, r, g, b FROM pixels WHERE greatest(w, h) <= 320
 UNION ALL SELECT image_id, CAST(floor((x + 0.5e0) * w2 / w) AS BIGINT) AS x2, CAST(floor((y + 0.5e0) * h2 / h) AS BIGINT) AS y2,
  w2, h2, CAST(floor(sum(r) / count(*) + 0.5e0) AS BIGINT), CAST(floor(sum(g) / count(*) + 0.5e0) AS BIGINT),
  CAST(floor(sum(b) / count(*) + 0.5e0) AS BIGINT) FROM big GROUP BY image_id, x2, y2, w2, h2)"""


def clusters(source: str) -> str:
    """Ink pixels and ranked clusters of ``source``."""
    return f"""
inkp AS (SELECT p.*, bg_r, bg_g, bg_b FROM {source} p JOIN bgx USING (image_id)
 WHERE (r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b) > 2025),
clus0 AS (SELECT image_id, r >> 4 AS br, g >> 4 AS bg, b >> 4 AS bb, count(*) AS mass,
  CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g,
  CAST(sum(b) // count(*) AS BIGINT) AS b, min(y * w + x) AS first_ord
 FROM inkp GROUP BY image_id, r >> 4, g >> 4, b >> 4),
clus AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mass DESC, first_ord) AS rk,
  max(mass) OVER (PARTITION BY image_id) AS top FROM clus0)"""


KEPT = """
kept AS (SELECT * FROM clus WHERE mass >= greatest(top * 0.03e0, 8) OR (rk = 1 AND top < greatest(top * 0.03e0, 8)))"""
