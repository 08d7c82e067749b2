"""Expected results of the request, artifact, run log and report queries."""

from __future__ import annotations

from inkloom.plans.fixture_sql import PIXELS, REQUESTS, RUNS, SVG_DOCS, VERTICES
from inkloom.plans.oracle import palette
from inkloom.plans.oracle.common import with_

SCALED = """
dims AS (SELECT p_partkey AS image_id, p_partkey % 4000 + 1 AS w, (p_partkey * 37) % 5000 + 1 AS h,
  (['off', 'auto', '2x', '4x', '4x-smooth', 'huge'])[p_partkey % 6 + 1] AS variant FROM part),
lim AS (SELECT *, CASE variant WHEN 'off' THEN 1.0e0 WHEN 'auto' THEN 2.0e0 WHEN '2x' THEN 2.0e0 WHEN '4x' THEN 4.0e0
   WHEN '4x-smooth' THEN 4.0e0 END AS asked FROM dims),
eff AS (SELECT *, CASE WHEN asked IS NULL THEN NULL
   WHEN greatest(1.0e0, least(asked, 3072.0e0 / greatest(w, h), sqrt(9500000.0e0 / (w * h)))) < 1.05e0 THEN 1.0e0
   ELSE greatest(1.0e0, least(asked, 3072.0e0 / greatest(w, h), sqrt(9500000.0e0 / (w * h)))) END AS scale FROM lim)"""
POLICY = """
cl AS (SELECT *, lower(trim(palette)) AS p, lower(trim(coalesce(colors_mode, 'auto'))) AS m FROM requests),
pol AS (SELECT *, CASE WHEN p IS NULL OR p IN ('', 'auto') THEN NULL
   WHEN NOT regexp_full_match(p, '[+-]?[0-9]+') THEN 'colors must be auto or int 1..16'
   WHEN CAST(p AS INTEGER) NOT BETWEEN 1 AND 16 THEN concat('colors must be 1..16, got ', CAST(CAST(p AS INTEGER) AS VARCHAR))
   WHEN m NOT IN ('', 'auto', 'default', 'up_to', 'exact') THEN 'colors_mode must be auto|up_to|exact' END AS error,
   p IS NULL OR p IN ('', 'auto') AS is_auto FROM cl),
res AS (SELECT *, CASE WHEN is_auto THEN CAST(4 AS BIGINT) WHEN error IS NULL THEN CAST(p AS BIGINT) END AS n,
   CASE WHEN is_auto OR (error IS NULL AND m = 'up_to') THEN 'up_to' WHEN error IS NULL THEN 'exact' END AS mode FROM pol)"""
VERDICT = """
ver AS (SELECT *, CASE WHEN lower(trim(format)) NOT IN ('pdf', 'svg') THEN 'format must be pdf or svg'
   WHEN lower(trim(geom)) NOT IN ('off', 'basic', 'strict') THEN 'geom must be off|basic|strict'
   WHEN error IS NOT NULL THEN error WHEN n_bytes = 0 THEN 'empty file'
   WHEN n_bytes > 12582912 THEN 'file too large' END AS reason FROM res)"""
RUN_ID = """concat('ui_', strftime(ts, '%Y%m%d_%H%M%S'), '_', lpad(CAST((epoch_us(ts) // 1000) % 100000 AS VARCHAR), 5, '0'))"""
FILES = """
files AS (SELECT event_id AS file_id, concat((['a/sample_', 'sample_', 'x.sample_', 'scan.', 'up.load/logo', '.hidden'])[event_id % 6 + 1],
   event_id, (['.jpg', '.png', '.JPEG', '', '.tar', '.webp', '.'])[event_id % 7 + 1]) AS path,
   (['FFD8FFE000104A464946000101', '89504E470D0A1A0A0000000D', '524946460000000057454250', '474946383961', '474946383761', '00FF',
     '52494646000000005741564500'])[(event_id // 3) % 7 + 1] AS head FROM events),
suf AS (SELECT *, CASE WHEN regexp_matches(list_last(string_split(path, '/')), '[^.].*\\.[^.]+$')
   THEN lower('.' || list_last(string_split(path, '.'))) ELSE '' END AS s FROM files)"""
METRICS = """
sums AS (SELECT l_suppkey AS k, l_returnflag AS v, count(*) AS n, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d,
   sum(CAST(round(l_tax * 100) AS BIGINT)) AS t, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
metrics AS (SELECT k, n, printf('sample_%05d', k) AS sample, concat('v', v) AS variant, (k + n) % 17 <> 0 AS render_ok,
   CASE WHEN (k + n) % 17 <> 0 THEN floor((n - d / 100.0e0) * 10000.0e0 / n) / 10000.0e0 END AS iou_mean,
   CASE WHEN (k + n) % 17 <> 0 THEN floor((n - t / 100.0e0) * 10000.0e0 / n) / 10000.0e0 END AS iou_aw,
   CASE WHEN n % 4 <> 0 AND (k + n) % 17 <> 0 THEN floor((n - d / 200.0e0) * 10000.0e0 / n) / 10000.0e0 END AS iou_bg,
   CASE WHEN (k + n) % 17 <> 0 THEN floor((t / 10.0e0) * 100.0e0 / n) / 100.0e0 END AS chamfer,
   CASE WHEN (k + n) % 17 <> 0 THEN n * 3 END AS nodes, q AS svg_bytes, (n % 60) / 10.0e0 AS elapsed,
   (k + n) % 17 <> 0 AND n % 29 = 0 AS degenerate, CASE WHEN (k + n) % 17 = 0 AND k % 2 = 0 THEN 'trace failed' END AS error FROM sums)"""
ARTIFACTS = """
art AS (SELECT path_id, path_id % 10 <> 0 AS present, CASE WHEN path_id % 4 = 0 THEN '.pdf' WHEN path_id % 11 = 0 THEN '.eps' ELSE '.svg' END AS suffix,
   CASE WHEN path_id % 4 = 0 AND path_id % 3 <> 0 THEN concat('%PDF-1.7 ', svg)
    WHEN path_id % 7 = 0 THEN replace(svg, '</svg>', repeat(' <path d="M 0.00 0.00 L 0.00 0.00 Z"/>', 3))
    WHEN path_id % 13 = 0 THEN 'plain text' ELSE svg END AS content, length(svg) + path_id % 400 AS n_bytes,
   (path_id % 50) / 1000.0e0 AS cov, CASE WHEN path_id % 3 <> 0 THEN (path_id % 90) / 100.0e0 END AS src FROM svg_docs),
qa AS (SELECT path_id, CASE WHEN NOT present THEN 'missing output' WHEN n_bytes < 500 THEN 'output too small'
   WHEN suffix = '.pdf' AND NOT starts_with(content, '%PDF') THEN 'not a PDF'
   WHEN suffix = '.svg' AND NOT contains(lower(content), '<svg') THEN 'not an SVG'
   WHEN suffix = '.svg' AND path_id % 7 = 0 THEN 'mostly degenerate zero-paths'
   WHEN suffix = '.eps' THEN 'unsupported type' WHEN cov < 0.002 THEN 'blank render'
   WHEN src > 0.01 AND cov < src * 0.05 THEN 'output ink much lower than source' END AS reason FROM art)"""
HINT = """
fin AS (SELECT ts, event_id, concat(CASE WHEN event_id % 3 = 0 THEN '/tmp/up load/' ELSE '__.lo go' END, event_type, event_id,
   CASE WHEN event_id % 4 = 0 THEN '?.PNG/' ELSE '.jpg_' END) AS hint, CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id * 10 END AS ib,
   CAST(round(value * 100) AS BIGINT) AS ob FROM events),
safe AS (SELECT *, left(regexp_replace(regexp_replace(list_last(string_split(rtrim(hint, '/'), '/')), '[^a-zA-Z0-9._-]+', '_', 'g'),
   '^[._]+|[._]+$', '', 'g'), 80) AS s FROM fin)"""


def mean(c: str, where: str = "") -> str:
    return f"round(avg({c}){where}, 6)"


def sql() -> dict[str, str]:
    fair = " FILTER (WHERE NOT degenerate)"
    docs = (VERTICES, SVG_DOCS)
    text = "CASE WHEN {0} IS NULL THEN '—' ELSE printf('{1}', {0}) END"
    return {
        "P10_effective_scale": with_(SCALED, select="SELECT image_id, w, h, variant, round(scale, 6) AS scale FROM eff"),
        "P11_scaled_thresholds": with_(SCALED, select="""
            SELECT image_id, CAST(CASE WHEN scale > 1.05 THEN greatest(1, floor(2 * scale)) ELSE 2 END AS BIGINT) AS speckle,
              CAST(CASE WHEN scale > 1.05 THEN least(10, greatest(3, floor(10 * scale))) ELSE 10 END AS BIGINT) AS segment FROM eff"""),
        "P12_palette_policy": with_(REQUESTS, POLICY, select="SELECT req_id, n, mode, error FROM res"),
        "P13_validate_request": with_(REQUESTS, POLICY, VERDICT, select="""
            SELECT req_id, CAST(CASE WHEN reason = 'file too large' THEN 413 WHEN reason IS NOT NULL THEN 400 END AS BIGINT) AS reject_code,
              n, reason AS reject_reason, mode FROM ver"""),
        "E2_requested_palettes": " UNION ALL ".join(
            f"SELECT * FROM ({with_(*build(k), REQUESTS, POLICY, VERDICT, select=f"""
              SELECT image_id, slot, p.r, p.g, p.b FROM pal p JOIN ver ON req_id = image_id
              WHERE reason IS NULL AND ver.n = {k} AND mode = '{mode}'""")})"
            for mode, build in (("up_to", palette.auto), ("exact", palette.exact)) for k in (2, 4, 16)),
        "P14_safe_name": with_(HINT, select="SELECT hint AS filename_hint, s AS safe FROM safe"),
        "P22_run_id": with_(RUNS, select=f"SELECT run_id, {RUN_ID} AS id FROM runs"),
        "S2_sample_filter": with_(FILES, select="""
            SELECT path FROM files WHERE list_last(string_split(path, '/')) SIMILAR TO 'sample_.*[.](jpg|png)'"""),
        "S3_explode_pixels": with_(PIXELS, select="SELECT image_id, y, CAST(x AS BIGINT) AS x, r, g, b, CAST(a AS BIGINT) AS a FROM pixels"),
        "S5_sniff_format": with_(FILES, select="""
            SELECT file_id, CASE WHEN s = '.jpeg' THEN '.jpg' WHEN s IN ('.jpg', '.png', '.webp', '.gif', '.bin') THEN s
              WHEN head LIKE 'FFD8FF%' THEN '.jpg' WHEN head LIKE '89504E470D0A1A0A%' THEN '.png'
              WHEN head LIKE '52494646________57454250%' THEN '.webp' WHEN head LIKE '47494638_961%' THEN '.gif' ELSE '.bin' END AS ext FROM suf""".replace(
            "'47494638_961%'", "'474946383961%' OR head LIKE '474946383761%'")),
        "S1_read_images": with_(PIXELS, select="""
            SELECT image_id, CAST(x AS BIGINT) AS x, y, CAST(w AS BIGINT) AS w, h, r, g, b, CAST(NULL AS VARCHAR) AS reason
            FROM pixels WHERE image_id % 7 <> 3
            UNION ALL SELECT DISTINCT image_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'cannot decode image' FROM pixels WHERE image_id % 7 = 3"""),
        "S5_file_kinds": with_(FILES, """
            nm AS (SELECT file_id, head, lower(regexp_extract(concat('f', file_id, '-', list_last(string_split(path, '/'))), '(\\.[^.]+)$', 1)) AS s FROM files),
            kn AS (SELECT file_id, head, CASE WHEN s = '.jpeg' THEN '.jpg' WHEN s IN ('.jpg', '.png', '.webp', '.gif', '.bin') THEN s END AS k FROM nm)""", select="""
            SELECT file_id, CAST(length(head) / 2 AS BIGINT) AS length, coalesce(k, CASE WHEN head LIKE 'FFD8FF%' THEN '.jpg'
              WHEN head LIKE '89504E470D0A1A0A%' THEN '.png' WHEN head LIKE '52494646________57454250%' THEN '.webp'
              WHEN head LIKE '474946383961%' OR head LIKE '474946383761%' THEN '.gif' ELSE '.bin' END) AS ext,
              CAST(CASE WHEN k IS NULL THEN least(12, length(head) / 2) ELSE 0 END AS BIGINT) AS head_bytes FROM kn"""),
        "S6_write_metrics": with_(METRICS, select="SELECT sample, variant, iou_mean, nodes, render_ok FROM metrics"),
        "S6_sample_report": with_(METRICS, select=f"""
            SELECT row_number() OVER (ORDER BY sample, variant) AS no, concat('| ', row_number() OVER (ORDER BY sample, variant), ' | `', sample, '` | ',
              printf('#%02x%02x%02x', (k * 3) % 256, (k * 5) % 256, (k * 7) % 256), ' | ', {text.format('iou_mean', '%.4f')},
              CASE WHEN degenerate THEN ' ⚠' ELSE '' END, ' | ', {text.format('iou_aw', '%.4f')}, ' | ', {text.format('iou_bg', '%.4f')}, ' | ',
              {text.format('chamfer', '%.2f')}, ' | ', coalesce(CAST(nodes AS VARCHAR), '—'), ' | ', printf('%.1f', svg_bytes / 1024), ' | ',
              CASE WHEN elapsed = 0 THEN '—' ELSE printf('%.1fs', elapsed) END, ' |') AS line FROM metrics"""),
        "S7_run_log_append": with_(HINT, select=f"""
            SELECT {RUN_ID} AS id, 'api' AS source, s AS filename_hint, event_id % 16 + 1 AS colors, 'exact' AS colors_mode, 'off' AS geom,
              CASE WHEN event_id % 7 = 0 THEN 'svg' ELSE 'pdf' END AS fmt, ib AS input_bytes, ob AS output_bytes,
              concat('[{{"r":', event_id % 256, ',"g":', event_id % 200, ',"b":', event_id % 100, '}}]') AS palette
            FROM safe WHERE ib > 0 AND ob > 0"""),
        "J7_source_vs_output": with_(PIXELS, """
            cov AS (SELECT image_id, count(*) FILTER (WHERE ink AND a >= 16) / count(*) AS s,
              count(*) FILTER (WHERE ink AND a >= 16 AND image_id % 3 <> 0) / count(*) AS o
              FROM (SELECT image_id, a, least(r, g, b) < 250 AS ink FROM pixels) GROUP BY image_id)""", select="""
            SELECT image_id, round(s, 6) AS source_coverage, round(o, 6) AS output_coverage, s > 0.01 AND o < s * 0.05 AS lost FROM cov"""),
        "A22_artifact_qa": with_(*docs, ARTIFACTS, select="""
            SELECT path_id, CASE WHEN reason IS NULL THEN 'pass' ELSE 'fail' END AS status, reason FROM qa"""),
        "A23_report_aggregates": with_(METRICS, select=f"""
            SELECT count(*) AS samples, {mean('iou_mean')} AS iou_mean_avg, min(iou_mean) AS iou_mean_min, max(iou_mean) AS iou_mean_max,
              {mean('iou_aw')} AS iou_aw_avg, min(iou_aw) AS iou_aw_min, max(iou_aw) AS iou_aw_max,
              {mean('iou_bg')} AS iou_bg_avg, min(iou_bg) AS iou_bg_min, max(iou_bg) AS iou_bg_max,
              {mean('chamfer', fair)} AS chamfer_avg, min(chamfer){fair} AS chamfer_min, max(chamfer){fair} AS chamfer_max,
              {mean('nodes')} AS nodes_avg, min(nodes) AS nodes_min, max(nodes) AS nodes_max, round(avg(svg_bytes) / 1024, 6) AS svg_kb_avg,
              {mean('nullif(elapsed, 0)')} AS time_avg, round(sum(elapsed), 6) AS time_total, count(*) FILTER (WHERE degenerate) AS degenerates
            FROM metrics"""),
        "W2_worst_chamfer": with_(METRICS, select="""
            SELECT sample, variant, chamfer, iou_mean FROM metrics WHERE chamfer IS NOT NULL ORDER BY chamfer DESC, sample, variant LIMIT 3"""),
        "W3_keep_newest_runs": with_(f"""
            nm AS (SELECT ts, CASE WHEN event_id % 50 = 0 THEN concat('ui_', event_id) ELSE concat({RUN_ID}, e) END AS name
              FROM events, (SELECT unnest(['.jpg', '_meta.json']) AS e))""", """
            gr AS (SELECT CASE WHEN len(string_split(name, '_')) < 4 THEN name ELSE array_to_string(string_split(name, '_')[1:4], '_') END AS key,
              max(ts) AS newest FROM nm GROUP BY 1)""", select="""
            SELECT key, row_number() OVER (ORDER BY newest DESC, key DESC) <= 500 AS keep FROM gr"""),
        "W4_latest_run": with_(RUNS, select="""
            SELECT run_id, source, kind, output_bytes FROM runs ORDER BY ts DESC, run_id DESC LIMIT 1"""),
        "W5_variant_matrix": with_(METRICS, select="SELECT sample, " + ", ".join(
            f"max({m}) FILTER (WHERE variant = '{v}') AS {v}_{m}" for v in ("vA", "vN", "vR")
            for m in ("iou_aw", "chamfer", "nodes", "elapsed")) + " FROM metrics GROUP BY sample"),
        "W5_variant_means": with_(METRICS, select=f"""
            SELECT variant, {mean('iou_mean')} AS iou_mean, {mean('iou_aw')} AS iou_aw, {mean('chamfer')} AS chamfer, {mean('nodes')} AS nodes,
              {mean('svg_bytes / 1024')} AS svg_kb, {mean('elapsed')} AS elapsed FROM metrics GROUP BY variant"""),
        "W7_render_failures": with_(METRICS, select="""
            SELECT sample, variant, coalesce(error, 'render-back failed') AS reason FROM metrics WHERE NOT render_ok"""),
        "W8_union_samples": with_(RUNS, REQUESTS, select="""
            SELECT run_id, kind FROM runs UNION ALL SELECT req_id, format FROM requests"""),
    }
