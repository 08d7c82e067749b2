"""Expected results of the colour, cluster and palette queries."""

from __future__ import annotations

from inkloom.plans.oracle.common import (
    BACKGROUND, KEPT, PIXELS, WORK, clusters, d2, hsl, hue, hue_gap, light, sat, white, with_,
)

SWATCH = f"r, g, b, mass, mass AS mass0, {light()} AS light, {sat()} AS sat, {hue()} AS hue"


def pack(t: str, mass: str | None = None) -> str:
    fields = [f"{f} := {t}.{f}" for f in ("r", "g", "b", "mass0", "light", "sat", "hue")]
    return "struct_pack(" + ", ".join(fields + [f"mass := {mass or t + '.mass'}"]) + ")"


def merge_cte(source: str, name: str = "merged") -> str:
    """First-fit HSL merge of ``source(image_id, rk, swatch...)`` into ``name``."""
    return f"""
{name}_r AS (
 SELECT image_id, rk, [{pack('s')}] AS kept FROM {source} s WHERE rk = 1
 UNION ALL
 SELECT s.image_id, s.rk,
  CASE WHEN coalesce(list_position(list_transform(t.kept, lambda k: {hsl('k', 's')} <= 0.18e0), true), 0) = 0
   THEN list_append(t.kept, {pack('s')})
   ELSE list_transform(t.kept, lambda k, i: CASE WHEN i = list_position(list_transform(t.kept, lambda m: {hsl('m', 's')} <= 0.18e0), true)
     THEN {pack('k', 'k.mass + s.mass')} ELSE {pack('k')} END) END
 FROM {name}_r t JOIN {source} s ON s.image_id = t.image_id AND s.rk = t.rk + 1),
{name}_u AS (SELECT image_id, unnest(kept) AS s, generate_subscripts(kept, 1) AS pos
 FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM {name}_r GROUP BY image_id)),
{name} AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY s.mass DESC, pos) AS rk,
  s.r, s.g, s.b, s.mass, s.mass0, s.light, s.sat, s.hue FROM {name}_u)"""


def crush_cte(source: str, name: str, same: str) -> str:
    """Grey collapse, hue buckets by ``same`` (of k.head and s), 12-unit dedupe, of ``source``."""
    return f"""
{name}_n AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM {source}),
{name}_g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mass0 DESC, rk) AS gp
  FROM {name}_n WHERE n > 1 AND sat <= 0.14e0) WHERE gp = 1),
{name}_c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY hue, rk) AS cp
  FROM {name}_n WHERE n > 1 AND sat > 0.14e0),
{name}_b AS (
 SELECT image_id, cp, [struct_pack(head := {pack('s')}, anchor := {pack('s')})] AS bk FROM {name}_c s WHERE cp = 1
 UNION ALL
 SELECT s.image_id, s.cp,
  CASE WHEN coalesce(list_position(list_transform(t.bk, lambda k: {same.format(k='k.head')}), true), 0) = 0
   THEN list_append(t.bk, struct_pack(head := {pack('s')}, anchor := {pack('s')}))
   ELSE list_transform(t.bk, lambda m, i: CASE WHEN i = list_position(list_transform(t.bk, lambda k: {same.format(k='k.head')}), true)
     AND (s.sat > m.anchor.sat OR (s.sat = m.anchor.sat AND s.light < m.anchor.light))
     THEN struct_pack(head := m.head, anchor := {pack('s')}) ELSE m END) END
 FROM {name}_b t JOIN {name}_c s ON s.image_id = t.image_id AND s.cp = t.cp + 1),
{name}_o AS (
 SELECT image_id, 0 AS pos, {pack('g')} AS s FROM {name}_g g
 UNION ALL SELECT image_id, pos, u.anchor AS s FROM (SELECT image_id, unnest(bk) AS u, generate_subscripts(bk, 1) AS pos
   FROM (SELECT image_id, arg_max(bk, cp) AS bk FROM {name}_b GROUP BY image_id))
 UNION ALL SELECT image_id, 0 AS pos, {pack('z')} AS s FROM {name}_n z WHERE n = 1),
{name}_p AS (SELECT image_id, s, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS p FROM {name}_o),
{name}_d AS (
 SELECT image_id, p, [s] AS kept FROM {name}_p WHERE p = 1
 UNION ALL
 SELECT x.image_id, x.p, CASE WHEN len(list_filter(t.kept, lambda k: {d2('k', 'x.s')} <= 144)) > 0 THEN t.kept
   ELSE list_append(t.kept, x.s) END
 FROM {name}_d t JOIN {name}_p x ON x.image_id = t.image_id AND x.p = t.p + 1),
{name} AS (SELECT image_id, s.r, s.g, s.b, s.mass, s.mass0, s.light, s.sat, s.hue, pos AS rk FROM
 (SELECT image_id, unnest(kept) AS s, generate_subscripts(kept, 1) AS pos
  FROM (SELECT image_id, arg_max(kept, p) AS kept FROM {name}_d GROUP BY image_id)))"""


AUTO_SAME = f"({hue_gap('{k}', 's')} <= 28.0e0 AND {hsl('{k}', 's')} <= 0.18e0)"


def ramp_same(width: float) -> str:
    return f"({hue_gap('{k}', 's')} <= {width}e0)"


def mass_cte(source: str, name: str) -> str:
    """Mass candidates of ``source(image_id, rk, swatch...)`` ranked by updated mass."""
    return f"""
{name}_t AS (SELECT *, sum(mass) OVER (PARTITION BY image_id) AS total FROM {source}),
{name}_m AS (SELECT * FROM {name}_t WHERE mass >= 8 AND mass / total >= 0.03e0),
{name}_s AS (
 SELECT image_id, rk, [{pack('s')}] AS sel FROM {name}_m s WHERE rk = 1
 UNION ALL
 SELECT s.image_id, s.rk, CASE WHEN list_min(list_transform(t.sel, lambda k: {d2('k', 's')})) <= 144
   THEN list_transform(t.sel, lambda k, i: CASE WHEN i = list_position(list_transform(t.sel, lambda m: {d2('m', 's')}),
      list_min(list_transform(t.sel, lambda m: {d2('m', 's')}))) THEN {pack('k', 'k.mass + s.mass')} ELSE {pack('k')} END)
   ELSE list_append(t.sel, {pack('s')}) END
 FROM {name}_s t JOIN {name}_m s ON s.image_id = t.image_id AND s.rk = t.rk + 1),
{name}_k AS (SELECT image_id, unnest(sel) AS s, generate_subscripts(sel, 1) AS pos
  FROM (SELECT image_id, arg_max(sel, rk) AS sel FROM {name}_s GROUP BY image_id)),
{name}_x AS (SELECT d.image_id, d.rk, min(struct_pack(d := {d2('k.s', 'd')}, pos := k.pos)) AS near
  FROM {name}_t d LEFT JOIN {name}_k k ON k.image_id = d.image_id
  WHERE NOT (d.mass >= 8 AND d.mass / d.total >= 0.03e0) GROUP BY d.image_id, d.rk),
{name}_a AS (SELECT x.image_id, x.near.pos AS pos, sum(t.mass) AS extra FROM {name}_x x JOIN {name}_t t USING (image_id, rk)
  WHERE x.near.d <= 1225 GROUP BY x.image_id, x.near.pos),
{name}_u AS (
 SELECT k.image_id, 0 AS minor, k.pos, k.s.r, k.s.g, k.s.b, CAST(k.s.mass + coalesce(a.extra, 0) AS BIGINT) AS mass
  FROM {name}_k k LEFT JOIN {name}_a a ON a.image_id = k.image_id AND a.pos = k.pos
 UNION ALL SELECT t.image_id, 1, t.rk, t.r, t.g, t.b, t.mass FROM {name}_t t JOIN {name}_x x USING (image_id, rk)
  WHERE x.near.d IS NULL OR x.near.d > 1225),
{name} AS (SELECT u.*, row_number() OVER (PARTITION BY u.image_id ORDER BY mass DESC, minor, pos) AS rk,
   t.total FROM {name}_u u JOIN (SELECT DISTINCT image_id, total FROM {name}_t) t USING (image_id))"""


def up_to_cte(cand: str, name: str, k: int) -> str:
    st = "struct_pack(r := {t}.r, g := {t}.g, b := {t}.b)"
    return f"""
{name}_m AS (SELECT image_id, list({st.format(t='c')} ORDER BY rk)[1:{k}] AS picked FROM {cand} c
  WHERE mass >= 8 AND mass / total >= 0.03e0 GROUP BY image_id),
{name}_f AS (SELECT c.image_id, 0 AS rk, coalesce(m.picked, [{st.format(t='c')}]) AS picked
  FROM {cand} c LEFT JOIN {name}_m m ON m.image_id = c.image_id WHERE c.rk = 1),
{name}_r AS (
 SELECT image_id, CAST(rk AS BIGINT) AS rk, picked FROM {name}_f
 UNION ALL
 SELECT c.image_id, c.rk, CASE WHEN len(t.picked) < {k} AND len(list_filter(t.picked, lambda p: {d2('p', 'c')} <= 1225)) = 0
   THEN list_append(t.picked, {st.format(t='c')}) ELSE t.picked END
 FROM {name}_r t JOIN {cand} c ON c.image_id = t.image_id AND c.rk = t.rk + 1),
{name} AS (SELECT image_id, s.r, s.g, s.b, pos AS rk FROM (SELECT image_id, unnest(picked) AS s, generate_subscripts(picked, 1) AS pos
  FROM (SELECT image_id, arg_max(picked, rk) AS picked FROM {name}_r GROUP BY image_id)))"""


GUARD = """
gstat AS (SELECT image_id, max(greatest(r, g, b)) - min(least(r, g, b)) AS span, count(*) AS n FROM inkp GROUP BY image_id),
gpeak AS (SELECT image_id, CAST(floor((r + g + b) / 3.0e0 / 20.0e0) AS BIGINT) AS k, count(*) AS c FROM inkp GROUP BY ALL),
guard AS (SELECT s.image_id, (s.span > 60 AND count(p.k) >= 2 AND coalesce(max(p.k) - min(p.k), 0) >= 3) AS is_bimodal
 FROM gstat s LEFT JOIN gpeak p ON p.image_id = s.image_id AND p.c / s.n > 0.10e0 GROUP BY s.image_id, s.span)"""

SWATCHES = f"sw AS (SELECT image_id, rk, first_ord, {SWATCH} FROM clus)"
KEPT_SW = f"ksw AS (SELECT image_id, rk, first_ord, {SWATCH} FROM kept)"
BASE = (PIXELS, BACKGROUND, WORK, clusters("work"))
FULL = (PIXELS, BACKGROUND, clusters("pixels"))


def final_palette(inks: str, name: str, cap: str) -> str:
    """Background first, then inks further than 35 units from it, at most ``cap``."""
    return f"""
{name}_i AS (SELECT i.image_id, i.r, i.g, i.b, row_number() OVER (PARTITION BY i.image_id ORDER BY i.rk) AS slot
  FROM {inks} i JOIN bgx USING (image_id)
  WHERE (i.r - bg_r) * (i.r - bg_r) + (i.g - bg_g) * (i.g - bg_g) + (i.b - bg_b) * (i.b - bg_b) > 1225),
{name} AS (SELECT image_id, CAST(0 AS BIGINT) AS slot, bg_r AS r, bg_g AS g, bg_b AS b FROM bgx
 UNION ALL SELECT image_id, slot, r, g, b FROM {name}_i WHERE slot <= {cap})"""


def auto(k: int) -> tuple[str, ...]:
    return (
        *BASE, KEPT, SWATCHES, KEPT_SW, merge_cte("ksw"), "surv AS (SELECT * FROM merged WHERE rk <= 8)",
        crush_cte("surv", "crushed", AUTO_SAME), GUARD, mass_cte("sw", "cand"), up_to_cte("cand", "upto", k),
        """
autoink AS (SELECT c.image_id, c.r, c.g, c.b, c.rk FROM crushed c JOIN guard USING (image_id)
  WHERE NOT (is_bimodal AND (SELECT count(*) FROM crushed z WHERE z.image_id = c.image_id) = 1)
 UNION ALL SELECT u.image_id, u.r, u.g, u.b, u.rk FROM upto u JOIN guard USING (image_id)
  WHERE is_bimodal AND (SELECT count(*) FROM crushed z WHERE z.image_id = u.image_id) = 1)""",
        final_palette("autoink", "pal", "99"),
    )


AUTO = auto(4)


def exact(k: int) -> tuple[str, ...]:
    return (*BASE, SWATCHES, mass_cte("sw", "cand"), f"ex AS (SELECT * FROM cand WHERE rk <= {k})",
            final_palette("ex", "pal", str(k)))


HIST = f"""hist AS (SELECT image_id, r, g, b, count(*) AS n, min(y * w + x) AS first_ord FROM pixels GROUP BY image_id, r, g, b)"""


def sql() -> dict[str, str]:
    px = PIXELS
    return {
        "flagship_main_inks": with_(*BASE, KEPT, select="""
            SELECT image_id, r, g, b, mass, CAST(rk AS BIGINT) AS rank, round(mass / n, 6) AS share
            FROM (SELECT k.*, sum(mass) OVER (PARTITION BY image_id) AS n FROM kept k) WHERE rk <= 8"""),
        "P1_rgb_dist2": with_(px, BACKGROUND, select="""
            SELECT image_id, x, y, (r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b) AS d2
            FROM pixels JOIN bgx USING (image_id)"""),
        "P2_is_near_white": with_(px, select=f"SELECT image_id, x, y, {white()} AS near_white FROM pixels"),
        "P3_lightness": with_(px, select=f"SELECT image_id, x, y, round({light()}, 6) AS lightness FROM pixels"),
        "P4_saturation": with_(px, select=f"SELECT image_id, x, y, round({sat()}, 6) AS saturation FROM pixels"),
        "P5_hue_deg": with_(px, select=f"SELECT image_id, x, y, round({hue()}, 6) AS hue FROM pixels"),
        "P6_hsl_distance": with_(
            px, BACKGROUND,
            f"a AS (SELECT image_id, x, y, {light()} AS light, {sat()} AS sat, {hue()} AS hue FROM pixels)",
            f"z AS (SELECT image_id, {light('bg_r', 'bg_g', 'bg_b')} AS light, {sat('bg_r', 'bg_g', 'bg_b')} AS sat, {hue('bg_r', 'bg_g', 'bg_b')} AS hue FROM bgx)",
            select=f"SELECT a.image_id, a.x, a.y, round({hsl('a', 'z')}, 6) AS hsl FROM a JOIN z ON a.image_id = z.image_id"),
        "P7_bucket4": with_(px, select="""
            SELECT image_id, r >> 4 AS br, g >> 4 AS bg, b >> 4 AS bb, count(*) AS n FROM pixels
            GROUP BY image_id, r >> 4, g >> 4, b >> 4"""),
        "P8_ink_mask": with_(*FULL, select="SELECT image_id, x, y, r, g, b FROM inkp"),
        "P9_hex_color": with_(px, BACKGROUND, select="""
            SELECT image_id, printf('#%02x%02x%02x', bg_r, bg_g, bg_b) AS bg_hex FROM bgx"""),
        "P21_colour_families": with_(px, BACKGROUND, select="""
            SELECT image_id, count(*) AS n_px,
              count(*) FILTER (WHERE gr) AS green_px, count(*) FILTER (WHERE gr AND sn) AS green_as_bg,
              count(*) FILTER (WHERE go) AS gold_px, count(*) FILTER (WHERE go AND sn) AS gold_as_bg,
              count(*) FILTER (WHERE gr AND NOT sn) AS green_ink_px
            FROM (SELECT image_id, g > r + 20 AND g > b + 10 AS gr, r > g + 20 AND g > b + 10 AND r > 150 AS go,
              (r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b) <= 2025 AS sn
              FROM pixels JOIN bgx USING (image_id)) GROUP BY image_id"""),
        "S4_has_alpha": with_(px, select="SELECT image_id, min(a) < 255 AS has_alpha FROM pixels GROUP BY image_id"),
        "A1_estimate_background": with_(px, BACKGROUND, select="SELECT image_id, bg_r, bg_g, bg_b FROM bgx"),
        "A2_box_downsample": with_(px, """
            dim AS (SELECT *, greatest(1, CAST(floor(w / (greatest(w, h) / 12.0e0)) AS BIGINT)) AS w2,
              greatest(1, CAST(floor(h / (greatest(w, h) / 12.0e0)) AS BIGINT)) AS h2 FROM pixels)""", select="""
            SELECT image_id, CAST(floor((x + 0.5e0) * w2 / w) AS BIGINT) AS x, CAST(floor((y + 0.5e0) * h2 / h) AS BIGINT) AS y,
              w2 AS w, h2 AS h, CAST(floor(sum(r) / count(*) + 0.5e0) AS BIGINT) AS r,
              CAST(floor(sum(g) / count(*) + 0.5e0) AS BIGINT) AS g, CAST(floor(sum(b) / count(*) + 0.5e0) AS BIGINT) AS b
            FROM dim GROUP BY ALL"""),
        "A3_color_clusters": with_(*BASE, select="SELECT image_id, br, bg, bb, r, g, b, mass, first_ord FROM clus"),
        "A4_mass_filter": with_(*BASE, KEPT, select="SELECT image_id, r, g, b, mass, first_ord FROM kept"),
        "A5_merge_by_hsl": with_(*BASE, KEPT, KEPT_SW, merge_cte("ksw"), select="""
            SELECT image_id, s.r, s.g, s.b, s.mass, CAST(pos AS BIGINT) AS pos FROM merged_u"""),
        "A6_mass_aware_exact": with_(*BASE, SWATCHES, mass_cte("sw", "cand"), f"""
            home AS (SELECT z.image_id, z.rk, z.mass, k.rk AS k, row_number() OVER (PARTITION BY z.image_id, z.rk ORDER BY {d2('z', 'k')}, k.rk) AS o
              FROM cand z JOIN cand k ON k.image_id = z.image_id AND k.rk <= 2 WHERE z.rk > 2)""", """
            more AS (SELECT image_id, k, sum(mass) AS mass FROM home WHERE o = 1 GROUP BY image_id, k)""", select="""
            SELECT c.image_id, CAST(c.rk AS BIGINT) AS pos, c.r, c.g, c.b, CAST(c.mass + coalesce(m.mass, 0) AS BIGINT) AS mass
            FROM cand c LEFT JOIN more m ON m.image_id = c.image_id AND m.k = c.rk WHERE c.rk <= 2"""),
        "A7_mass_aware_up_to": with_(*BASE, SWATCHES, mass_cte("sw", "cand"), up_to_cte("cand", "upto", 4), select="""
            SELECT image_id, CAST(rk AS BIGINT) AS pos, r, g, b FROM upto"""),
        "A8_gradient_crush": with_(*BASE, SWATCHES, crush_cte("sw", "crushed", AUTO_SAME), select="""
            SELECT image_id, CAST(rk AS BIGINT) AS pos, r, g, b, mass FROM crushed"""),
        "A9_collapse_gradient_ramps": with_(
            *BASE, SWATCHES, crush_cte("sw", "ramp", ramp_same(28.0)), select="""
            SELECT image_id, CAST(p AS BIGINT) AS pos, r, g, b, mass FROM (SELECT *, CASE WHEN n > 2
               THEN row_number() OVER (PARTITION BY image_id ORDER BY (CASE WHEN sat > 0.14e0 THEN 0 ELSE 1 END), sat DESC, light, rk)
               ELSE rk END AS p FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM ramp)) WHERE p <= 2"""),
        "A10_bimodal_guard": with_(*BASE, GUARD, select="SELECT image_id, is_bimodal FROM guard"),
        "A11_palette_auto": with_(*AUTO, select="SELECT image_id, slot, r, g, b, slot = 0 AS is_bg FROM pal"),
        "A12_palette_exact": with_(*exact(2), select="SELECT image_id, slot, r, g, b, slot = 0 AS is_bg FROM pal"),
        "A29_extract_colors": with_(*AUTO, select="SELECT image_id, slot, r, g, b FROM pal"),
        "A13_unique_color_count": with_(px, select="""
            SELECT image_id, count(DISTINCT (r, g, b)) AS n_colors FROM pixels GROUP BY image_id"""),
        "A13_unique_color_sketch": with_(px, select="""
            SELECT image_id, count(DISTINCT (r, g, b)) AS n_colors, true AS within FROM pixels GROUP BY image_id"""),
        "A14_raw_color_histogram": with_(px, HIST, select=f"""
            SELECT image_id, rank, r, g, b, n, round(n / total, 6) AS share, round({light()}, 6) AS lightness,
              round({sat()}, 6) AS saturation FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS total,
              row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first_ord) AS rank FROM hist) WHERE rank <= 20"""),
        "A15_white_fraction": with_(px, select=f"""
            SELECT image_id, round(count(*) FILTER (WHERE {white()}) / count(*), 6) AS white_fraction FROM pixels GROUP BY image_id"""),
        "A28_palette_trace": with_(*FULL, """
            tot AS (SELECT image_id, count(*) AS total FROM pixels GROUP BY image_id)""", """
            it AS (SELECT image_id, count(*) AS ink_n FROM inkp GROUP BY image_id)""", select=f"""
            SELECT image_id, rk AS rank, r, g, b, mass, round(mass / ink_n, 6) AS share,
              CASE WHEN mass >= 8 AND mass / ink_n >= 0.03e0 THEN 'MAJOR' ELSE 'dust' END AS class,
              CASE WHEN {sat()} <= 0.14e0 THEN 'gray' ELSE 'chroma' END AS family,
              round(ink_n / total, 6) AS ink_share, round(1.0e0 - ink_n / total, 6) AS bg_share
            FROM clus JOIN tot USING (image_id) JOIN it USING (image_id) WHERE rk <= 20"""),
        "W1_top_k_by_mass": with_(*BASE, select="SELECT image_id, CAST(rk AS BIGINT) AS rank, r, g, b, mass FROM clus WHERE rk <= 8"),
        "W9_bg_dedupe": with_(px, BACKGROUND, HIST, select="""
            SELECT image_id, r, g, b, n FROM hist JOIN bgx USING (image_id)
            WHERE (r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b) > 1225"""),
    }
