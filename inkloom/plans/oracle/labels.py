"""Expected results of the label queries."""

from __future__ import annotations

from inkloom.plans.fixture_sql import TRACED
from inkloom.plans.oracle.common import PIXELS, with_
from inkloom.plans.oracle.palette import AUTO

BAND = """
slots AS (SELECT s.image_id, s.image_id % 6 AS kind, k.ink FROM (SELECT DISTINCT image_id FROM pixels) s
  JOIN (SELECT unnest([-1, 0, 1, 2]) AS ink) k ON s.image_id % 6 <> 5 OR k.ink = -1),
band AS (SELECT image_id, CAST(ink + 1 AS BIGINT) AS slot,
  CASE WHEN ink < 0 THEN CASE kind WHEN 1 THEN 20 WHEN 2 THEN 12 ELSE 250 END
   WHEN kind = 2 THEN 90 + ink * 62 WHEN kind = 3 THEN 20 + ink * 6
   WHEN kind = 4 THEN CASE ink WHEN 0 THEN 200 WHEN 1 THEN 214 ELSE 40 END
   ELSE (image_id * 53 + ink * 97 + 40) % 240 + 8 END AS pr,
  CASE WHEN ink < 0 THEN CASE kind WHEN 1 THEN 80 WHEN 2 THEN 12 ELSE 250 END
   WHEN kind = 2 THEN 90 + ink * 62 WHEN kind = 3 THEN 40 + ink * 10
   WHEN kind = 4 THEN CASE ink WHEN 0 THEN 40 WHEN 1 THEN 52 ELSE 50 END
   ELSE (image_id * 31 + ink * 61 + 90) % 240 + 8 END AS pg,
  CASE WHEN ink < 0 THEN CASE kind WHEN 1 THEN 50 WHEN 2 THEN 12 ELSE 250 END
   WHEN kind = 2 THEN 90 + ink * 62 WHEN kind = 3 THEN 120 + ink * 20
   WHEN kind = 4 THEN CASE ink WHEN 0 THEN 40 WHEN 1 THEN 50 ELSE 190 END
   ELSE (image_id * 17 + ink * 151 + 10) % 240 + 8 END AS pb FROM slots)"""


def labelled(source: str, name: str, palette: str = "band") -> str:
    """Nearest slot of each pixel of ``source`` by a plain join with its palette."""
    return f"""
{name} AS (SELECT image_id, x, y, w, h, r, g, b, pr, pg, pb, slot FROM (
  SELECT p.image_id, p.x, p.y, p.w, p.h, p.r, p.g, p.b, q.pr, q.pg, q.pb, q.slot, row_number() OVER (
    PARTITION BY p.image_id, p.x, p.y ORDER BY (p.r - q.pr) * (p.r - q.pr) + (p.g - q.pg) * (p.g - q.pg)
      + (p.b - q.pb) * (p.b - q.pb), q.slot) AS k
  FROM {source} p JOIN {palette} q ON q.image_id = p.image_id) WHERE k = 1)"""


PLATE = "plate AS (SELECT image_id, pr AS qr, pg AS qg, pb AS qb FROM band WHERE slot = 0)"
NEAR_PLATE = "((r - qr) * (r - qr) + (g - qg) * (g - qg) + (b - qb) * (b - qb) <= 2025)"


def sql() -> dict[str, str]:
    return {
        "J1_assign_nearest": with_(PIXELS, BAND, labelled("pixels", "lab"), select="""
            SELECT image_id, x, y, slot, CAST(pr AS BIGINT) AS r, CAST(pg AS BIGINT) AS g, CAST(pb AS BIGINT) AS b FROM lab"""),
        "J2_remap_to_palette": with_(PIXELS, BAND, labelled("pixels", "lab"), PLATE, select=f"""
            SELECT image_id, x, y, CASE WHEN {NEAR_PLATE} THEN CAST(0 AS BIGINT) ELSE slot END AS slot,
              CAST(CASE WHEN {NEAR_PLATE} THEN qr ELSE pr END AS BIGINT) AS r,
              CAST(CASE WHEN {NEAR_PLATE} THEN qg ELSE pg END AS BIGINT) AS g,
              CAST(CASE WHEN {NEAR_PLATE} THEN qb ELSE pb END AS BIGINT) AS b
            FROM lab JOIN plate USING (image_id)"""),
        "P20_alpha_rule": with_(PIXELS, BAND, PLATE, select=f"""
            SELECT image_id, x, y, CAST(CASE WHEN {NEAR_PLATE} OR a < 16 THEN 0 ELSE a END AS BIGINT) AS a
            FROM pixels JOIN plate USING (image_id)"""),
        "J2b_prepare_corpus": with_(
            *AUTO, "apal AS (SELECT image_id, slot, r AS pr, g AS pg, b AS pb FROM pal)",
            labelled("pixels", "lab", "apal"),
            "qlate AS (SELECT image_id, bg_r AS qr, bg_g AS qg, bg_b AS qb FROM bgx)",
            "fl AS (SELECT image_id, min(a) < 255 AS has_alpha FROM pixels GROUP BY image_id)",
            "al AS (SELECT image_id, x, y, a FROM pixels)", select=f"""
            SELECT image_id, x, y, CASE WHEN {NEAR_PLATE} THEN CAST(0 AS BIGINT) ELSE slot END AS slot,
              CASE WHEN {NEAR_PLATE} THEN qr ELSE pr END AS r, CASE WHEN {NEAR_PLATE} THEN qg ELSE pg END AS g,
              CASE WHEN {NEAR_PLATE} THEN qb ELSE pb END AS b,
              CAST(CASE WHEN NOT has_alpha THEN 255 WHEN {NEAR_PLATE} OR a < 16 THEN 0 ELSE a END AS BIGINT) AS a
            FROM lab JOIN qlate USING (image_id) JOIN fl USING (image_id) JOIN al USING (image_id, x, y)"""),
        "A21_ink_coverage": with_(PIXELS, select="""
            SELECT image_id, round(count(*) FILTER (WHERE a >= 16 AND (r < 250 OR g < 250 OR b < 250)) / count(*), 6)
              AS ink_coverage FROM pixels GROUP BY image_id"""),
    }


LABEL_CTES = (PIXELS, TRACED, BAND, labelled("pixels", "ref"), labelled("traced", "ren"))
