"""Expected results of the mask, edge and Chamfer queries."""

from __future__ import annotations

import re

from inkloom.plans.oracle.common import PIXELS, with_
from inkloom.plans.oracle.labels import BAND, LABEL_CTES, labelled

PAIRS = """
pairs AS (SELECT a.image_id, a.x, a.y, a.slot AS ref_slot, b.slot AS out_slot FROM ref a JOIN ren b
  ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y)"""
TABLE = """
tab AS (SELECT image_id, ref_slot, out_slot, count(*) AS n FROM pairs GROUP BY image_id, ref_slot, out_slot)"""
GREEDY = """
refs AS (SELECT image_id, ref_slot, row_number() OVER (PARTITION BY image_id ORDER BY ref_slot) AS k
  FROM (SELECT DISTINCT image_id, ref_slot FROM tab)),
outs AS (SELECT DISTINCT image_id, out_slot FROM tab),
cost AS (SELECT r.image_id, r.k, r.ref_slot, o.out_slot,
   (p.pr - q.pr) * (p.pr - q.pr) + (p.pg - q.pg) * (p.pg - q.pg) + (p.pb - q.pb) * (p.pb - q.pb) AS d
  FROM refs r JOIN outs o ON r.image_id = o.image_id JOIN band p ON p.image_id = r.image_id AND p.slot = r.ref_slot
  JOIN band q ON q.image_id = o.image_id AND q.slot = o.out_slot),
costs AS (SELECT image_id, k, ref_slot, list(out_slot ORDER BY d, out_slot) AS pref FROM cost GROUP BY ALL),
greedy AS (
 SELECT image_id, k, [struct_pack(r := ref_slot, o := pref[1])] AS done FROM costs WHERE k = 1
 UNION ALL
 SELECT c.image_id, c.k, CASE WHEN len(list_filter(c.pref, lambda o: NOT list_contains(list_transform(g.done, lambda z: z.o), o))) = 0
   THEN g.done ELSE list_append(g.done, struct_pack(r := c.ref_slot,
     o := list_filter(c.pref, lambda o: NOT list_contains(list_transform(g.done, lambda z: z.o), o))[1])) END
 FROM greedy g JOIN costs c ON c.image_id = g.image_id AND c.k = g.k + 1),
pairing AS (SELECT image_id, s.r AS ref_slot, s.o AS out_slot FROM
  (SELECT image_id, unnest(arg_max(done, k)) AS s FROM greedy GROUP BY image_id))"""
MASKS = """
masks AS (SELECT p.image_id, p.ref_slot, p.out_slot, p.ref_slot = 0 AS is_bg,
   coalesce(t.n, 0) / (a.n + o.n - coalesce(t.n, 0)) AS raw, CAST(a.n AS BIGINT) AS area_px, z.n AS total
  FROM pairing p LEFT JOIN tab t USING (image_id, ref_slot, out_slot)
  JOIN (SELECT image_id, ref_slot, sum(n) AS n FROM tab GROUP BY ALL) a ON a.image_id = p.image_id AND a.ref_slot = p.ref_slot
  JOIN (SELECT image_id, out_slot, sum(n) AS n FROM tab GROUP BY ALL) o ON o.image_id = p.image_id AND o.out_slot = p.out_slot
  JOIN (SELECT image_id, sum(n) AS n FROM tab GROUP BY ALL) z ON z.image_id = p.image_id)"""


def edges(source: str, name: str, slot: str = "slot") -> str:
    """Pixels of ``source`` with a differing 4-neighbour, by four keyed self joins."""
    arms = " UNION ALL ".join(
        f"SELECT a.image_id, a.x, a.y FROM {source} a JOIN {source} b ON a.image_id = b.image_id "
        f"AND b.x = a.x + {dx} AND b.y = a.y + {dy} WHERE a.{slot} <> b.{slot}"
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return f"{name} AS (SELECT DISTINCT * FROM ({arms}))"


def nearest(queries: str, targets: str, name: str) -> str:
    return f"""
{name} AS (SELECT q.image_id, q.x, q.y, min((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)) AS d2
  FROM {queries} q JOIN {targets} t ON q.image_id = t.image_id GROUP BY ALL)"""


def own_iou(other: str, name: str) -> str:
    """Mean IoU of an image's masks with those of ``other``, through the pairing of both."""
    pairs = f"""
pairs_ AS (SELECT a.image_id, a.x, a.y, a.slot AS ref_slot, b.slot AS out_slot FROM ref a JOIN {other} b
  ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y)"""
    ctes = ",".join((pairs, TABLE.replace("FROM pairs", "FROM pairs_"), GREEDY, MASKS))
    mean = """,
mean_ AS (SELECT image_id, round_even(sum(CAST(round(round_even(raw, 4) * 10000) AS BIGINT)) / count(*), 0) / 10000 AS v
  FROM masks GROUP BY image_id)"""
    return re.sub(r"\b(pairs_|tab|refs|outs|cost|costs|greedy|pairing|masks|mean_)\b", rf"{name}_\1",
                  ctes + mean)


EDGES = (edges("ref", "re"), edges("ren", "oe"))
SHIFT = """
mv AS (SELECT image_id, x, y, coalesce(lead(slot) OVER (PARTITION BY image_id, y ORDER BY x), slot) AS slot FROM ref)"""


def late(ctes: tuple[str, ...]) -> tuple[str, ...]:
    """The same tables for the trace that is off by five columns."""
    return tuple(
        re.sub(r"lag\((\w)\)", r"lag(\1, 5)", c.replace("pk % 11 = 0", "pk % 1 = 0")) for c in ctes)


EVALUATED = """
SELECT i.image_id, '{name}' AS variant, i.w, i.h, i.n_colors, i.nodes, m.iou_mean, m.iou_worst, m.iou_aw, m.iou_bg, m.iou_unmatched,
  round_even((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2, 2) AS chamfer, s.same AND i.nodes > 0 AS degenerate
FROM (SELECT image_id, CAST(max(w) AS BIGINT) AS w, CAST(max(h) AS BIGINT) AS h, count(*) FILTER (WHERE pk % 7 = 0) AS nodes,
    (SELECT count(*) FROM band WHERE band.image_id = pixels.image_id) AS n_colors FROM pixels GROUP BY image_id) i
JOIN (SELECT m.image_id, round_even(sum(i4) / count(*), 0) / 10000 AS iou_mean, min(round_even(raw, 4)) AS iou_worst,
    round_even(sum(i4 * area_px) / sum(area_px), 0) / 10000 AS iou_aw, round_even(avg(raw) FILTER (WHERE is_bg), 4) AS iou_bg,
    (SELECT count(*) FROM refs r WHERE r.image_id = m.image_id) - count(*) AS iou_unmatched
  FROM (SELECT *, CAST(round(round_even(raw, 4) * 10000) AS BIGINT) AS i4 FROM masks) m GROUP BY m.image_id) m USING (image_id)
JOIN (SELECT image_id, bool_and(ref_slot = out_slot) AS same FROM tab GROUP BY image_id) s USING (image_id)
LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n1 GROUP BY image_id) a USING (image_id)
LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n2 GROUP BY image_id) b USING (image_id)"""


def sql() -> dict[str, str]:
    base = (*LABEL_CTES, PAIRS, TABLE)
    whole = (*base, GREEDY, MASKS, *EDGES, nearest("re", "oe", "n1"), nearest("oe", "re", "n2"))
    ref = (PIXELS, BAND, labelled("pixels", "ref"))
    return {
        "J3_contingency": with_(*base, select="SELECT * FROM tab"),
        "J4_pair_palettes": with_(*base, GREEDY, select="SELECT image_id, ref_slot, out_slot FROM pairing"),
        "J5_nearest_edge": with_(*LABEL_CTES, *EDGES, nearest("oe", "re", "nn"), select="SELECT image_id, x, y, CAST(d2 AS BIGINT) AS d2 FROM nn"),
        "J6_neighbour_join": with_(*ref[:2], ref[2].replace("ref AS (", "ref AS MATERIALIZED (", 1), select="""
            SELECT c.image_id, c.x, c.y, c.slot, l.slot AS slot_left, r.slot AS slot_right, u.slot AS slot_up, d.slot AS slot_down
            FROM ref c LEFT JOIN ref l ON l.image_id = c.image_id AND l.y = c.y AND l.x = c.x - 1
            LEFT JOIN ref r ON r.image_id = c.image_id AND r.y = c.y AND r.x = c.x + 1
            LEFT JOIN ref u ON u.image_id = c.image_id AND u.x = c.x AND u.y = c.y - 1
            LEFT JOIN ref d ON d.image_id = c.image_id AND d.x = c.x AND d.y = c.y + 1"""),
        "J8_present_colors": with_(*ref, select="""
            SELECT image_id, slot, CAST(pr AS BIGINT) AS r, CAST(pg AS BIGINT) AS g, CAST(pb AS BIGINT) AS b, slot = 0 AS is_bg FROM band
            WHERE (image_id, slot) IN (SELECT (image_id, slot) FROM ref)"""),
        "A16_mask_iou": with_(*base, GREEDY, MASKS, select="""
            SELECT image_id, ref_slot, out_slot, is_bg, round_even(raw, 4) AS iou, area_px,
              round_even(area_px / total * 100, 2) AS area_pct FROM masks"""),
        "A17_sample_iou": with_(*base, GREEDY, MASKS, select="""
            SELECT m.image_id, round_even(sum(i4) / count(*), 0) / 10000 AS iou_mean, min(round_even(raw, 4)) AS iou_worst,
              round_even(sum(i4 * area_px) / sum(area_px), 0) / 10000 AS iou_aw,
              round_even(avg(raw) FILTER (WHERE is_bg), 4) AS iou_bg,
              (SELECT count(*) FROM refs r WHERE r.image_id = m.image_id) - count(*) AS iou_unmatched
            FROM (SELECT *, CAST(round(round_even(raw, 4) * 10000) AS BIGINT) AS i4 FROM masks) m GROUP BY m.image_id"""),
        "A18_edge_map": with_(*ref, edges("ref", "re"), select="SELECT image_id, x, y FROM re"),
        "A19_chamfer": with_(*LABEL_CTES, *EDGES, nearest("re", "oe", "n1"), nearest("oe", "re", "n2"), select="""
            SELECT i.image_id, round_even((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2, 2) AS chamfer
            FROM (SELECT DISTINCT image_id FROM pixels) i
            LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n1 GROUP BY image_id) a USING (image_id)
            LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n2 GROUP BY image_id) b USING (image_id)"""),
        "A20_degenerate_flag": with_(*base, select="""
            SELECT image_id, bool_and(ref_slot = out_slot) AND any_value(nodes) > 0 AS degenerate FROM tab
            JOIN (SELECT image_id, count(*) FILTER (WHERE pk % 7 = 0) AS nodes FROM pixels GROUP BY image_id) USING (image_id)
            GROUP BY image_id"""),
        "A24_self_test": with_(
            *ref, edges("ref", "re"), SHIFT, edges("mv", "me"), nearest("re", "re", "n1"), nearest("re", "me", "n2"),
            own_iou("ref", "same"), own_iou("mv", "moved"), select="""
            SELECT i.image_id, i.n_edges, e.v AS iou_mean, round_even(coalesce(q.m, 0), 2) AS chamfer, f.v AS shift_iou,
              round(coalesce(s.m, 0), 6) AS shift_chamfer,
              e.v > 0.999 AND coalesce(q.m, 0) < 0.01 AND (i.n_edges = 0 OR coalesce(s.m, 0) > 0.01) AS passed
            FROM (SELECT p.image_id, count(re.x) AS n_edges FROM (SELECT DISTINCT image_id FROM pixels) p
              LEFT JOIN re USING (image_id) GROUP BY p.image_id) i
            JOIN same_mean_ e USING (image_id) JOIN moved_mean_ f USING (image_id)
            LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n1 GROUP BY image_id) q USING (image_id)
            LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n2 GROUP BY image_id) s USING (image_id)"""),
        "E1_evaluate_corpus": " UNION ALL ".join(
            f"SELECT * FROM ({with_(*ctes, select=EVALUATED.format(name=name))})"
            for name, ctes in (("near", whole), ("late", late(whole)))),
        "W6_xor_mask": with_(*late(base), GREEDY, MASKS, select="""
            SELECT DISTINCT p.image_id, p.x, p.y, m.ref_slot AS slot FROM pairs p JOIN masks m ON m.image_id = p.image_id
            AND round_even(m.raw, 4) < 0.5 AND (p.ref_slot = m.ref_slot) <> (p.out_slot = m.ref_slot)"""),
    }
