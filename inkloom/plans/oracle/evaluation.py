"""Expected results of the evaluation records and the reports written from them."""

from __future__ import annotations

from inkloom.plans.fixture_sql import SVG_DOCS, VERTICES
from inkloom.plans.oracle.common import with_
from inkloom.plans.oracle.labels import LABEL_CTES
from inkloom.plans.oracle.quality import EDGES, GREEDY, MASKS, PAIRS, TABLE, late, nearest

RECORDS = """
SELECT printf('sample_%05d', i.image_id) AS sample, printf('sample_%05d.png', i.image_id) AS file, '{name}' AS variant, i.w, i.h,
  CAST(4 AS BIGINT) AS colors_requested, CASE WHEN bad THEN '—' ELSE pal.t END AS palette, CASE WHEN NOT bad THEN pal.bg END AS bg_color,
  CASE WHEN ok THEN m.iou_mean END AS iou_mean, CASE WHEN ok THEN m.iou_worst END AS iou_worst, CASE WHEN ok THEN m.iou_bg END AS iou_bg,
  CASE WHEN ok THEN m.iou_aw END AS iou_aw, CASE WHEN ok THEN m.iou_unmatched ELSE 0 END AS iou_unmatched,
  CASE WHEN ok THEN round_even((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2, 2) END AS chamfer,
  CASE WHEN NOT bad THEN q.nodes END AS nodes, CASE WHEN bad THEN 0 ELSE length(q.svg) END AS svg_bytes, ok AS render_ok,
  coalesce(ok AND s.same AND q.nodes > 0, false) AS degenerate, '{upscale}' AS upscale, CAST({scale} AS DOUBLE) AS effective_scale,
  'outline' AS engine, (i.image_id * 7 + {place} * 13) % 60 / 10.0e0 AS elapsed, CASE WHEN bad THEN 'trace failed' END AS error,
  CASE WHEN ok THEN m.per_mask END AS per_mask
FROM (SELECT image_id, CAST(max(w) AS BIGINT) AS w, CAST(max(h) AS BIGINT) AS h, image_id % 17 = 0 AS bad,
    image_id % 17 <> 0 AND image_id % 19 <> 0 AS ok FROM pixels GROUP BY image_id) i
JOIN (SELECT path_id, svg, len(regexp_extract_all(regexp_extract(svg, ' d="([^"]*)"', 1), '[MLZ]')) AS nodes FROM svg_docs) q
  ON q.path_id = i.image_id
JOIN (SELECT image_id, string_agg(printf('#%02x%02x%02x', pr, pg, pb), ', ' ORDER BY slot) AS t,
    max(printf('#%02x%02x%02x', pr, pg, pb)) FILTER (WHERE slot = 0) AS bg FROM band GROUP BY image_id) pal ON pal.image_id = i.image_id
JOIN (SELECT m.image_id, round_even(sum(i4) / count(*), 0) / 10000 AS iou_mean, min(round_even(raw, 4)) AS iou_worst,
    round_even(sum(i4 * area_px) / sum(area_px), 0) / 10000 AS iou_aw, round_even(avg(raw) FILTER (WHERE is_bg), 4) AS iou_bg,
    (SELECT count(*) FROM refs r WHERE r.image_id = m.image_id) - count(*) AS iou_unmatched,
    string_agg(printf('#%02x%02x%02x %s %.4f %.2f %d', c.pr, c.pg, c.pb, CASE WHEN is_bg THEN 'bg' ELSE 'ink' END, round_even(raw, 4),
      round_even(area_px / total * 100, 2), area_px), '; ' ORDER BY ref_slot) AS per_mask
  FROM (SELECT *, CAST(round(round_even(raw, 4) * 10000) AS BIGINT) AS i4 FROM masks) m
  JOIN band c ON c.image_id = m.image_id AND c.slot = m.ref_slot GROUP BY m.image_id) m ON m.image_id = i.image_id
JOIN (SELECT image_id, bool_and(ref_slot = out_slot) AS same FROM tab GROUP BY image_id) s ON s.image_id = i.image_id
LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n1 GROUP BY image_id) a ON a.image_id = i.image_id
LEFT JOIN (SELECT image_id, avg(sqrt(d2)) AS m FROM n2 GROUP BY image_id) b ON b.image_id = i.image_id"""
VARIANTS = [("near", "off", "1.0"), ("late", "2x", "2.0")]


def records() -> str:
    whole = (*LABEL_CTES, PAIRS, TABLE, GREEDY, MASKS, *EDGES, nearest("re", "oe", "n1"), nearest("oe", "re", "n2"))
    docs = (VERTICES, SVG_DOCS)
    return " UNION ALL ".join(
        f"SELECT * FROM ({with_(*ctes, *docs, select=RECORDS.format(name=name, upscale=up, scale=scale, place=i))})"
        for i, ((name, up, scale), ctes) in enumerate(zip(VARIANTS, (whole, late(whole)), strict=True)))


def _or_dash(value: str, pattern: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '—' ELSE printf('{pattern}', {value}) END"


def _span(label: str, c: str, digits: int, unit: str = "", where: str = "") -> str:
    def number(f: str) -> str:
        return f"printf('%.{digits}f', round_even(CAST({f}({c}){where} AS DOUBLE), {digits}))"

    return (f"CASE WHEN count({c}){where} > 0 THEN '- **{label} ' || {number('avg')} || '{unit}  (min: ' || {number('min')} "
            f"|| ', max: ' || {number('max')} || ')' END")


def report() -> str:
    fair = " FILTER (WHERE NOT degenerate)"
    sample = " || ' | ' || ".join([
        "no", "'`' || file || '`'", "w || '×' || h", "palette",
        _or_dash("iou_mean", "%.4f") + " || CASE WHEN degenerate THEN ' ⚠' ELSE '' END",
        *(_or_dash(c, "%.4f") for c in ("iou_aw", "iou_worst", "iou_bg")), _or_dash("chamfer", "%.2f"),
        "coalesce(CAST(nodes AS VARCHAR), 'None')", "printf('%.1f', round_even(svg_bytes / 1024, 1))",
        "CASE WHEN elapsed = 0 THEN '—' ELSE printf('%.1fs', elapsed) END"])
    head = """['# Evaluation (v4-' || variant || ')', '', '**Samples:** ' || count(*), '**Date:** 2026-07-21', ''] ||
      CASE WHEN arg_min(upscale, no) <> 'off' THEN ['**Upscale:** ' || arg_min(upscale, no), ''] ELSE [] END || ['## Per-Sample Metrics', '',
      '| # | Sample | Size | Inks | IoU mean | IoU aw | IoU worst | IoU bg | Chamfer | Nodes | SVG KB | Time |',
      '|---|--------|------|------|----------|--------|-----------|--------|---------|-------|--------|------|']"""
    aggregate = ", ".join([
        "''", "'## Aggregate'", "''", _span("IoU mean:** ", "iou_mean", 4), _span("IoU area-weighted:**", "iou_aw", 4),
        _span("IoU bg mean:**", "iou_bg", 4), _span("Chamfer mean:**", "chamfer", 2, " px", fair), _span("Nodes mean:** ", "nodes", 0),
        "'- **SVG size mean:** ' || printf('%.1f', round_even(avg(svg_bytes) / 1024, 1)) || ' KB'",
        "CASE WHEN count(nullif(elapsed, 0)) > 0 THEN '- **Time mean:** ' || printf('%.1f', round_even(avg(nullif(elapsed, 0)), 1)) || "
        "'s  (total: ' || printf('%.0f', round_even(sum(elapsed), 0)) || 's)' END",
        "CASE WHEN count(*) FILTER (WHERE degenerate) > 0 THEN '- **Degenerate samples:** ' || count(*) FILTER (WHERE degenerate) END"])

    def lines(section: int, listed: str, source: str = "rec", first: int = 0, having: str = "") -> str:
        return (f"SELECT variant, CAST({section} AS BIGINT) AS section, CAST(generate_subscripts(l, 1) - 1 + {first} AS BIGINT) AS no, "
                f"unnest(l) AS line FROM (SELECT variant, {listed} AS l FROM {source} GROUP BY variant {having})")

    parts = [
        lines(0, head), f"SELECT variant, 1, no, '| ' || {sample} || ' |' FROM rec",
        lines(2, "['', '> ⚠ = degenerate metric']", having="HAVING bool_or(degenerate)"),
        lines(3, "['', '## Per-Mask Detail', '', '| Sample | Color | Is BG | IoU | Area % |', '|--------|-------|-------|-----|--------|']",
              having="HAVING count(per_mask) > 0"),
        """SELECT variant, 4, no * 32 + slot, '| `' || file || '` | ' || m[1] || ' | ' || m[2] || ' | ' || m[3] || ' | ' ||
          printf('%.1f%%', round_even(CAST(m[4] AS DOUBLE), 1)) || ' |' FROM (SELECT variant, no, file, string_split(u.mask, ' ') AS m,
          (SELECT max(b.slot) FROM mband b WHERE b.file = r.file AND b.hex = split_part(u.mask, ' ', 1)) AS slot
          FROM rec r, unnest(string_split(per_mask, '; ')) u(mask))""",
        lines(5, f"list_filter([{aggregate}], lambda x: x IS NOT NULL)"),
        lines(6, "['', '## Worst Chamfer', ''] || list(line ORDER BY chamfer DESC, no)",
              source=f"""(SELECT variant, no, chamfer, '- `' || file || '` — Chamfer ' || printf('%.2f', chamfer) || ' px, IoU mean ' ||
                {_or_dash('iou_mean', '%.4f')} AS line FROM rec WHERE chamfer IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY variant ORDER BY chamfer DESC, no) <= 3)"""),
        lines(7, "['', '## Render Failures']", "(SELECT * FROM rec WHERE NOT render_ok)", first=-2),
        "SELECT variant, 7, no, '- `' || file || '` — ' || coalesce(error, 'render-back failed') FROM rec WHERE NOT render_ok",
    ]
    return f"""WITH rec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY file) AS no FROM ({records()})),
mband AS (SELECT file, hex, CAST(k - 1 AS BIGINT) AS slot FROM (SELECT DISTINCT file, palette FROM rec WHERE palette <> '—'),
  unnest(string_split(palette, ', ')) WITH ORDINALITY u(hex, k))
""" + "\nUNION ALL ".join(parts)


def matrix() -> str:
    names = [v for v, _, _ in VARIANTS]
    heads, rule = "".join(f" {v} |" for v in names), "--------|" * (len(names) + 1)

    def number(value: str, digits: int) -> str:
        return f"CASE WHEN {value} IS NULL THEN '—' ELSE printf('%.{digits}f', round_even(CAST({value} AS DOUBLE), {digits})) END"

    def fixed(section: int, listed: str, source: str = "") -> str:
        return (f"SELECT CAST({section} AS BIGINT) AS section, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS no, '' AS sample, "
                f"unnest(l) AS line FROM (SELECT {listed} AS l {source})")

    parts = [fixed(0, "['# Variant Comparison', '', '**Samples:** ' || count(DISTINCT sample), '**Date:** 2026-07-21', '']", "FROM rec")]
    metrics = [("IoU aw", "iou_aw", 4), ("Chamfer (px)", "chamfer", 2), ("Nodes", "nodes", 0), ("Time (s)", "elapsed", 1)]
    for k, (title, c, digits) in enumerate(metrics, 1):
        lead = "'', " if k > 1 else ""
        parts.append(fixed(k, f"[{lead}'## {title}', '', '| Sample |{heads}', '|{rule}']"))
        cells = " || ".join("' ' || " + number(f"(max({c}) FILTER (WHERE variant = '{v}'))", digits) + " || ' |'" for v in names)
        parts.append(f"SELECT {k}, 0, sample, '| `' || sample || '` |' || {cells} FROM rec GROUP BY sample")
    means = [("IoU mean", "avg(iou_mean)", 4), ("IoU aw", "avg(iou_aw)", 4), ("Chamfer", "avg(chamfer)", 2), ("Nodes", "avg(nodes)", 0),
             ("SVG KB", "avg(svg_bytes / 1024)", 1), ("Time (s)", "avg(elapsed)", 1)]
    rows = ", ".join(f"'| {title} |' || " + " || ".join(
        "' ' || " + number(f"({f} FILTER (WHERE variant = '{v}'))", digits) + " || ' |'" for v in names) for title, f, digits in means)
    parts.append(fixed(len(metrics) + 1, f"['', '## Aggregate (mean across samples)', '', '| Metric |{heads}', '|{rule}', {rows}]", "FROM rec"))
    return f"WITH rec AS MATERIALIZED ({records()})\n" + "\nUNION ALL ".join(parts)


def sql() -> dict[str, str]:
    return {"E1_evaluation_records": records(), "E1_report": report(), "E1_matrix_report": matrix()}
