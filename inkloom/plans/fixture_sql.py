"""SQL text of the derived tables, as defined in FIXTURES.md, for the DuckDB side."""

PIXELS = """
r AS (SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i,
  count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(l_quantity AS BIGINT) AS q, l_partkey AS pk FROM lineitem),
whole AS (SELECT image_id, i, n, q, pk FROM r UNION ALL SELECT image_id, n + k, n, 17, 2 FROM (SELECT image_id, max(n) AS n FROM r GROUP BY image_id) z
  JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22)) o(k) ON n + k < n + 23 - (n + 23) % 24),
geo AS (SELECT image_id, image_id % 6 AS kind, i % 24 AS x, CAST((i - i % 24) / 24 AS BIGINT) AS y, 24 AS w, CAST((n + 23 - (n + 23) % 24) / 24 AS BIGINT) AS h, q, pk FROM whole),
reg AS (SELECT *, CASE WHEN kind = 5 OR x < 2 OR x > 21 OR y < 2 OR y >= h - 2 THEN -1 ELSE CAST((x - 2 - (x - 2) % 7) / 7 AS BIGINT) END AS ink FROM geo),
base AS (SELECT *,
 CASE WHEN ink < 0 THEN CASE kind WHEN 1 THEN 20 WHEN 2 THEN 12 ELSE 250 END
  WHEN kind = 2 THEN 90 + ink * 62 WHEN kind = 3 THEN 20 + ink * 6
  WHEN kind = 4 THEN CASE ink WHEN 0 THEN 200 WHEN 1 THEN 214 ELSE 40 END
  ELSE (image_id * 53 + ink * 97 + 40) % 240 + 8 END AS r0,
 CASE WHEN ink < 0 THEN CASE kind WHEN 1 THEN 80 WHEN 2 THEN 12 ELSE 250 END
  WHEN kind = 2 THEN 90 + ink * 62 WHEN kind = 3 THEN 40 + ink * 10
  WHEN kind = 4 THEN CASE ink WHEN 0 THEN 40 WHEN 1 THEN 52 ELSE 50 END
  ELSE (image_id * 31 + ink * 61 + 90) % 240 + 8 END AS g0,
 CASE WHEN ink < 0 THEN CASE kind WHEN 1 THEN 50 WHEN 2 THEN 12 ELSE 250 END
  WHEN kind = 2 THEN 90 + ink * 62 WHEN kind = 3 THEN 120 + ink * 20
  WHEN kind = 4 THEN CASE ink WHEN 0 THEN 40 WHEN 1 THEN 50 ELSE 190 END
  ELSE (image_id * 17 + ink * 151 + 10) % 240 + 8 END AS b0 FROM reg),
pixels AS (SELECT image_id, kind, x, y, w, h, r0 + q % 7 - 3 AS r, g0 + q % 5 - 2 AS g, b0 + pk % 5 - 2 AS b,
 CASE WHEN image_id % 4 = 0 AND ink < 0 THEN 0 ELSE 255 END AS a, ink, pk FROM base)"""

TRACED = """
traced AS (SELECT image_id, x, y, w, h,
 CASE WHEN pk % 11 = 0 THEN coalesce(lag(r) OVER row_w, r) ELSE r END AS r,
 CASE WHEN pk % 11 = 0 THEN coalesce(lag(g) OVER row_w, g) ELSE g END AS g,
 CASE WHEN pk % 11 = 0 THEN coalesce(lag(b) OVER row_w, b) ELSE b END AS b
 FROM pixels WINDOW row_w AS (PARTITION BY image_id, y ORDER BY x))"""

VERTICES = """
nums AS (SELECT k FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) z WHERE k <= 24),
prm AS (SELECT p_partkey AS path_id, p_partkey % 4 AS shape, CASE WHEN p_partkey % 4 = 3 THEN 16 ELSE 12 + p_size % 13 END AS n, 20 + p_size % 30 AS rad FROM part),
ang AS (SELECT path_id, shape, n, rad, k AS seq, k % n AS m, 2.0E0 * pi() * (k % n) / n AS t FROM prm JOIN nums ON k <= n),
vertices AS (SELECT path_id, shape, seq,
 CASE WHEN shape < 3 THEN round(100 + (rad + CASE WHEN shape = 2 THEN 3 * (m % 2) ELSE 0 END) * cos(t), 2)
  WHEN m < 4 THEN m * 10 WHEN m < 8 THEN 40 WHEN m < 12 THEN 40 - (m - 8) * 10 ELSE 0 END AS x,
 CASE WHEN shape < 3 THEN round(100 + (rad + CASE WHEN shape = 2 THEN 3 * (m % 2) ELSE 0 END) * CASE WHEN shape = 1 THEN 0.6E0 ELSE 1.0E0 END * sin(t), 2)
  WHEN m < 4 THEN 0 WHEN m < 8 THEN (m - 4) * 10 WHEN m < 12 THEN 40 ELSE 40 - (m - 12) * 10 END AS y FROM ang)"""

SVG_DOCS = """
svg_docs AS (SELECT path_id, concat('<svg width="200" height="200"><path d="', string_agg(concat(CASE WHEN seq = 0 THEN 'M ' ELSE 'L ' END, CAST(CAST(x AS DECIMAL(9,2)) AS VARCHAR), ' ', CAST(CAST(y AS DECIMAL(9,2)) AS VARCHAR)), ' ' ORDER BY seq), ' Z" fill="#c53837"/></svg>') AS svg FROM vertices GROUP BY path_id)"""

REQUESTS = """
requests AS (SELECT event_id AS req_id,
 CASE event_id % 9 WHEN 0 THEN 'auto' WHEN 1 THEN '' WHEN 2 THEN '2' WHEN 3 THEN ' 16 ' WHEN 4 THEN '17' WHEN 5 THEN '0' WHEN 6 THEN 'abc' WHEN 7 THEN 'AUTO' ELSE NULL END AS palette,
 CASE event_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'up_to' WHEN 2 THEN 'exact' WHEN 3 THEN '' ELSE 'bogus' END AS colors_mode,
 CASE event_id % 7 WHEN 0 THEN 'svg' WHEN 1 THEN 'png' ELSE 'PDF' END AS format,
 CASE event_id % 8 WHEN 0 THEN 'basic' WHEN 1 THEN 'wild' ELSE 'off' END AS geom,
 CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) * 1000 END AS n_bytes FROM events)"""

RUNS = """
runs AS (SELECT event_id AS run_id, ts, user_id AS source, event_type AS kind, value AS output_bytes FROM events)"""
