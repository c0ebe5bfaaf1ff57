"""The queries of ``layerscan.plans.queries`` as SQL over the same tables."""

from __future__ import annotations

from layerscan.plans.queries import LAYERS, LISTED_FILES, TREE_BYTES, TREE_FILES, TREE_PATHS

NAMES = ", ".join(f"'{name}'" for name in LAYERS)

FIELDS = f"""
    SELECT table_name AS layer, CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS name, '' AS alias,
           CASE data_type WHEN 'BIGINT' THEN 'Integer64' WHEN 'INTEGER' THEN 'Integer' WHEN 'DOUBLE' THEN 'Real'
                WHEN 'VARCHAR' THEN 'String' WHEN 'TIMESTAMP' THEN 'DateTime' WHEN 'FLOAT[]' THEN 'RealList'
                ELSE data_type END AS type,
           0 AS width, 0 AS "precision"
    FROM information_schema.columns WHERE table_name IN ({NAMES})
"""

COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS layer, count(*) AS feature_count, (SELECT CAST(count(*) AS INTEGER) "
    f"FROM information_schema.columns WHERE table_name = '{name}') AS field_count FROM {name}"
    for name in LAYERS
)


def size_text(value: str) -> str:
    steps = [f"WHEN {value} < 0 THEN '0 B'", f"WHEN {value} < 1024 THEN CAST({value} AS VARCHAR) || ' B'"]
    units = ["KB", "MB", "GB", "TB"]
    for power, unit in enumerate(units, start=1):
        steps.append(
            f"WHEN {value} < {1024 ** (power + 1)} THEN "
            f"printf('%.2f', CAST({value} AS DOUBLE) / {1024**power}) || ' {unit}'"
        )
    return f"CASE {' '.join(steps)} ELSE printf('%.2f', CAST({value} AS DOUBLE) / {1024**5}) || ' PB' END"


def extent_text(gap: str) -> str:
    return (
        f"CASE WHEN xmin IS NULL THEN '-' ELSE "
        f"printf('X:{gap}[%.4f, %.4f]  Y:{gap}[%.4f, %.4f]', xmin, xmax, ymin, ymax) END"
    )


def box(name: str, source: str, x: str, y: str) -> str:
    return (
        f"SELECT '{name}' AS layer, count(*) AS feature_count, "
        f"CAST(min({x}) AS DOUBLE) + 0.0 AS xmin, CAST(max({x}) AS DOUBLE) + 0.0 AS xmax, "
        f"CAST(min({y}) AS DOUBLE) + 0.0 AS ymin, CAST(max({y}) AS DOUBLE) + 0.0 AS ymax FROM {source}"
    )


def ring(source: str, key: str, condition: str) -> str:
    return f"""
        SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS match_index,
               coalesce(lead({key}) OVER (ORDER BY {key}), min({key}) OVER ()) AS next_key,
               coalesce(lag({key}) OVER (ORDER BY {key}), max({key}) OVER ()) AS prev_key
        FROM {source} WHERE {condition}
    """


def spans(source: str, key: str, text: str, query: str) -> str:
    return f"""
        WITH pieces AS (
            SELECT {key}, unnest(string_split(lower({text}), '{query}')) AS piece,
                   generate_subscripts(string_split(lower({text}), '{query}'), 1) AS i,
                   len(string_split(lower({text}), '{query}')) - 1 AS hits
            FROM {source}),
        ends AS (
            SELECT {key}, hits, i,
                   sum(length(piece)) OVER (PARTITION BY {key} ORDER BY i) + (i - 1) * {len(query)} AS start
            FROM pieces)
        SELECT {key}, CAST(max(hits) AS INTEGER) AS hits,
               coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= hits), '')
                   AS starts
        FROM ends GROUP BY {key}
    """


def progress(source: str, key: str) -> str:
    return f"""
        WITH placed AS (
            SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS pos, count(*) OVER () AS total FROM {source}),
        pages AS (
            SELECT CASE WHEN pos < 200 THEN 0 ELSE 1 + (pos - 200) // 500 END AS page, {key}, total FROM placed),
        sums AS (
            SELECT page, count(*) AS page_rows, min({key}) AS first_key, max({key}) AS last_key,
                   max(total) AS total_features
            FROM pages GROUP BY page)
        SELECT CAST(page AS BIGINT) AS page, page_rows, first_key, last_key,
               CAST(sum(page_rows) OVER (ORDER BY page) AS BIGINT) AS loaded, total_features
        FROM sums
    """


def card(layer: str, x: str = "CAST(NULL AS DOUBLE)", y: str = "CAST(NULL AS DOUBLE)") -> str:
    facts = box(layer, layer, x, y)
    return f"""
        SELECT 'Feature Class' AS type, c.layer, c.field_count, f.feature_count, f.xmin, f.xmax, f.ymin, f.ymax
        FROM (SELECT table_name AS layer, CAST(count(*) AS INTEGER) AS field_count
              FROM information_schema.columns WHERE table_name = '{layer}' GROUP BY table_name) c
        LEFT JOIN ({facts}) f ON f.layer = c.layer
    """


STATS = """
    CASE WHEN blank THEN NULL ELSE round(lo, 6) + 0.0 END AS "min", CASE WHEN blank THEN NULL ELSE round(hi, 6) + 0.0 END AS "max",
    CASE WHEN blank THEN NULL ELSE round(mid, 6) + 0.0 END AS mean, CASE WHEN blank THEN NULL ELSE round(dev, 6) + 0.0 END AS stddev
"""


def bands(pixels: str) -> str:
    return f"""
        SELECT band, valid_count, {STATS} FROM (
            SELECT *, valid_count = 0 OR (lo = 0 AND hi = 0 AND mid = 0 AND dev = 0) AS blank FROM (
                SELECT CAST(band AS INTEGER) AS band, count(v) AS valid_count, min(v) AS lo, max(v) AS hi,
                       avg(v) AS mid, stddev_pop(v) AS dev
                FROM ({pixels}) GROUP BY band))
    """


EMBEDDING_PIXELS = """
    SELECT generate_subscripts(embedding, 1) AS band, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings
"""

ITEM_PIXELS = """
    SELECT band, CASE WHEN v <> 0 THEN v END AS v FROM (
        SELECT unnest([1, 2, 3, 4, 5]) AS band,
               unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_tax * 0]) AS v FROM lineitem)
"""

SHAPE_TYPES = {
    0: "Unknown (any)", 1: "Point", 3: "Line String", 5: "Polygon", 8: "Multi Point", 11: "3D Point",
    13: "3D Line String", 15: "3D Polygon", 18: "3D Multi Point", 21: "Measured Point",
    23: "Measured Line String", 25: "Measured Polygon", 28: "Measured Multi Point", 31: "3D Unknown (any)",
}

CATALOG = f"""
    WITH files AS (SELECT {LISTED_FILES} AS path, CAST(p_size * 1000 AS BIGINT) AS length FROM part),
    owned AS (
        SELECT path, length,
               CASE WHEN contains(path, '.gdb/') THEN split_part(path, '.gdb/', 1) || '.gdb'
                    WHEN path LIKE '%.tif' THEN path
                    WHEN path LIKE '%.shp.xml' THEN left(path, length(path) - 4)
                    WHEN path LIKE '%.txt' THEN NULL
                    ELSE left(path, length(path) - 4) || '.shp' END AS owner
        FROM files WHERE path NOT LIKE '/data/.hidden/%'),
    folded AS (
        SELECT owner AS path, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS size_bytes,
               bool_or(path = owner OR contains(path, '.gdb/')) AS complete
        FROM owned WHERE owner IS NOT NULL GROUP BY owner)
    SELECT path, regexp_extract(path, '([^/]*)\\.[a-z]+$', 1) AS layer,
           CASE right(path, 4) WHEN '.shp' THEN 'shapefile' WHEN '.tif' THEN 'raster' ELSE 'geodatabase' END
               AS format,
           CASE right(path, 4) WHEN '.shp' THEN 'Shapefile' WHEN '.tif' THEN 'Raster' ELSE 'Geodatabase' END
               AS type_label,
           file_count, size_bytes, {size_text("size_bytes")} AS size
    FROM folded WHERE complete
"""

# The tree of files on disk, with the dataset that each file belongs to.
TREE = f"""
    SELECT c_custkey AS key, {TREE_FILES} AS path, {TREE_BYTES} AS length,
           CASE WHEN c_custkey % 10 < 3 THEN concat('n', (c_custkey - c_custkey % 10) % 7, '/layer_', c_custkey - c_custkey % 10, '.shp')
                WHEN c_custkey % 10 = 4 THEN concat('n', c_custkey % 7, '/store_', c_nationkey, '.gdb')
                WHEN c_custkey % 10 IN (3, 6, 8) THEN {TREE_FILES} END AS owner
    FROM customer
"""

TREE_DATASETS = f"""
    SELECT owner AS path, regexp_replace(regexp_extract(owner, '[^/]*$'), '[.][^.]+$', '') AS layer,
           CASE right(owner, 4) WHEN '.shp' THEN 'shapefile' WHEN '.gdb' THEN 'geodatabase' ELSE 'raster' END AS format,
           CASE right(owner, 4) WHEN '.shp' THEN 'Shapefile' WHEN '.gdb' THEN 'Geodatabase' ELSE 'Raster' END AS type_label,
           count(*) AS file_count, CAST(sum(length) AS BIGINT) AS size_bytes
    FROM ({TREE}) WHERE owner IS NOT NULL GROUP BY owner HAVING bool_or(owner LIKE '%.gdb' OR path = owner)
"""

POLYGONS = """
    SELECT p_partkey AS partkey, p_name AS name, CAST(p_partkey AS DOUBLE) AS xmin,
           CAST(p_partkey + p_size + CASE WHEN twice THEN 1000 ELSE 0 END AS DOUBLE) AS xmax,
           p_retailprice AS ymin, p_retailprice + 1 AS ymax, twice, 13 + 16 * (2 * p_size + 3) AS ring_bytes
    FROM (SELECT *, p_partkey % 5 = 0 AS twice FROM part)
"""

ORACLES = {
    "container_info": COUNTS,
    "container_counts": f"SELECT layer, feature_count FROM ({COUNTS}) WHERE feature_count > 0",
    "container_footers": f"SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({COUNTS})",
    "layer_names": f"SELECT unnest([{NAMES}]) AS layer",
    "schema_fields": f'SELECT *, true AS "nullable" FROM ({FIELDS})',
    "search_fields": f"""
        SELECT *, 'yes' AS "nullable" FROM ({FIELDS})
        WHERE contains(lower(name), 'key') OR contains(lower(type), 'key')
    """,
    "search_layers": f"SELECT layer FROM (SELECT unnest([{NAMES}]) AS layer) WHERE contains(layer, 'ar')",
    "layer_extent": "SELECT *, "
    + extent_text(" ")
    + " AS text, "
    + extent_text("")
    + " AS compact_text FROM ("
    + " UNION ALL ".join(
        [
            box("events", "events", "value", "user_id"),
            box("embeddings", "embeddings", "CAST(embedding[1] AS DOUBLE)", "CAST(embedding[2] AS DOUBLE)"),
            box("orders", "orders", "o_totalprice", "o_custkey"),
            box("lineitem", "lineitem", "l_extendedprice", "l_quantity"),
            box("no_rows", "events WHERE event_id < 0", "value", "user_id"),
        ]
    )
    + ")",
    "layer_card": card("customer", "c_acctbal", "c_nationkey"),
    "layer_card_fallback": card("benchmark"),
    "layer_card_orders": card("orders", "o_totalprice", "o_custkey"),
    "unknown_layer": "SELECT 'Layer not found: no such layer' AS error",
    "layer_documents": f"""
        SELECT c.layer, c.feature_count, 'None' AS geometry_type, b.xmin, b.xmax, b.ymin, b.ymax,
               CAST(NULL AS VARCHAR) AS crs, c.field_count, CAST(NULL AS VARCHAR) AS error
        FROM ({COUNTS}) c LEFT JOIN (
            {box("customer", "customer", "c_acctbal", "c_nationkey")}
            UNION ALL {box("orders", "orders", "o_totalprice", "o_custkey")}) b ON b.layer = c.layer
    """,
    "info_json": f"""
        WITH counts AS ({COUNTS}), fields AS ({FIELDS})
        SELECT c.layer, CAST(to_json({{'layer': c.layer, 'feature_count': any_value(c.feature_count),
                   'field_count': any_value(c.field_count),
                   'fields': list({{'name': f.name, 'type': f.type, 'width': f.width}} ORDER BY f.ordinal)}})
                   AS VARCHAR) AS document
        FROM counts c JOIN fields f ON f.layer = c.layer GROUP BY c.layer
    """,
    "peek_lineitem": """
        SELECT l_orderkey, count(*) AS shown FROM (
            SELECT l_orderkey FROM lineitem ORDER BY l_orderkey LIMIT 25) GROUP BY l_orderkey
    """,
    "scan_from_conversations": """
        SELECT conv_id, count(*) AS "left" FROM (
            SELECT conv_id FROM conversations ORDER BY conv_id OFFSET 31) GROUP BY conv_id
    """,
    "row_positions_lineitem": """
        SELECT l_orderkey, min(position) AS first, max(position) AS last, count(*) AS n FROM (
            SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS position FROM lineitem)
        GROUP BY l_orderkey
    """,
    "match_ring_conversations": """
        SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS match_index
        FROM conversations WHERE lower(text) LIKE '%the%'
    """,
    "peek_rows": """
        SELECT o_orderkey AS fid, *, CAST(NULL AS VARCHAR) AS geometry FROM orders ORDER BY o_orderkey LIMIT 10
    """,
    "peek_sparse": """
        SELECT doc_id AS fid, *, CAST(NULL AS VARCHAR) AS geometry FROM labels ORDER BY doc_id LIMIT 25
    """,
    "peek_nothing": "SELECT o_orderkey AS fid, *, CAST(NULL AS VARCHAR) AS geometry FROM orders LIMIT 0",
    "peek_summary": """
        SELECT 'orders' AS layer, count(*) AS total_features, least(10, count(*)) AS showing FROM orders
        UNION ALL SELECT 'labels', count(*), least(1000000, count(*)) FROM labels
        UNION ALL SELECT 'events', count(*), 0 FROM events
        UNION ALL SELECT 'region', count(*), least(2, count(*)) FROM region
    """,
    "scan_from": "SELECT * FROM events ORDER BY event_id OFFSET 200",
    "scan_from_sparse": "SELECT * FROM labels ORDER BY doc_id OFFSET 137",
    "scan_from_documents": "SELECT * FROM documents ORDER BY doc_id OFFSET 150",
    "scan_past_end": "SELECT * FROM labels ORDER BY doc_id OFFSET 1000000000",
    "row_positions": "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels",
    "row_pages": """
        SELECT *, CASE WHEN position < 200 THEN 0 ELSE 1 + (position - 200) // 500 END AS page
        FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events)
    """,
    "page_progress": progress("events", "event_id"),
    "page_progress_sparse": progress("labels", "doc_id"),
    "search_rows": "SELECT * FROM events WHERE contains(lower(event_type), 'error') OR contains(lower(props), 'error')",
    "search_every_column": """
        SELECT * FROM orders
        WHERE contains(lower(concat_ws(chr(1), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
                                       CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority)),
                       '99.')
    """,
    "search_documents": """
        SELECT * FROM documents
        WHERE contains(lower(text), 'the ') OR contains(lower(lang), 'the ') OR contains(lower(source), 'the ')
    """,
    "search_pages": """
        SELECT page_id, url FROM pages WHERE contains(lower(url), '<title') OR contains(lower(html), '<title')
    """,
    "search_conversations": """
        SELECT * FROM conversations WHERE contains(lower(role), 'é') OR contains(lower(text), 'é')
    """,
    "search_nothing": "SELECT * FROM events WHERE false",
    "match_ring": ring("events", "event_id", "contains(lower(event_type), 'error') OR contains(lower(props), 'error')"),
    "match_ring_documents": ring(
        "documents",
        "doc_id",
        "contains(lower(text), 'tion') OR contains(lower(lang), 'tion') OR contains(lower(source), 'tion')",
    ),
    "match_ring_sparse": ring("labels", "doc_id", "contains(CAST(quality AS VARCHAR), '0')"),
    "highlight_spans": spans("part", "p_partkey", "p_name", "in"),
    "highlight_documents": spans("documents", "doc_id", "text", "on"),
    "highlight_pages": spans("pages", "page_id", "html", "</p>"),
    "band_stats": bands(EMBEDDING_PIXELS),
    "band_stats_nodata": bands(ITEM_PIXELS),
    "raster_extent": "SELECT *, "
    + extent_text(" ")
    + """ AS text FROM (
        SELECT p_partkey, p_retailprice AS xmin, p_retailprice + p_size * 0.5 * (p_size * 10) AS xmax,
               CAST(p_partkey AS DOUBLE) - p_size * 0.25 * (p_partkey % 7 + 1) AS ymin,
               CAST(p_partkey AS DOUBLE) AS ymax,
               CAST(p_size * 0.5 AS DOUBLE) AS cell_size_x, CAST(p_size * 0.25 AS DOUBLE) AS cell_size_y
        FROM part)
    """,
    "classify_paths": f"""
        WITH paths AS (SELECT url AS path FROM pages UNION ALL SELECT {TREE_PATHS} FROM part),
        named AS (
            SELECT path, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS name,
                   lower(regexp_extract(rtrim(path, '/'), '\\.([A-Za-z0-9]+)$', 1)) AS extension
            FROM paths),
        typed AS (
            SELECT *,
                   CASE WHEN strpos(substr(name, 2), '.') > 0 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END
                       AS stem,
                   CASE WHEN extension = 'shp' THEN 'shapefile'
                        WHEN extension IN ('tif', 'tiff', 'jp2', 'png', 'jpg', 'jpeg', 'gif', 'img', 'vrt', 'dem')
                            THEN 'raster'
                        WHEN extension = 'gdb' THEN 'geodatabase' END AS format,
                   contains(path, '/.') AS hidden,
                   contains(rtrim(lower(path), '/'), '.gdb/') AS inside_container
            FROM named)
        SELECT path, name, stem, extension, format,
               CASE format WHEN 'shapefile' THEN 'Shapefile' WHEN 'raster' THEN 'Raster'
                    WHEN 'geodatabase' THEN 'Geodatabase' ELSE 'Input' END AS type_label,
               hidden, inside_container, NOT hidden AND NOT inside_container AND format IS NOT NULL AS is_dataset
        FROM typed
    """,
    "dataset_catalog": CATALOG,
    "search_catalog": f"SELECT * FROM ({CATALOG}) WHERE contains(layer, 'image_1')",
    "human_size": f"""
        SELECT lang, total, {size_text("total")} AS size
        FROM (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY lang)
    """,
    "human_size_units": f"""
        SELECT doc_id, bytes, {size_text("bytes")} AS size FROM (
            SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN -n_chars
                                ELSE n_chars * CAST(power(1024, doc_id % 5) AS BIGINT) END AS bytes
            FROM documents)
    """,
    "render_values": """
        SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
               CASE WHEN abs(c_acctbal) < 1 THEN printf('%.6f', c_acctbal) ELSE printf('%.2f', c_acctbal) END
                   AS c_acctbal,
               CASE WHEN abs(c_acctbal / 100000) < 1 THEN printf('%.6f', c_acctbal / 100000)
                    ELSE printf('%.2f', c_acctbal / 100000) END AS small,
               CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '-' END AS sometimes,
               CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS positive
        FROM customer
    """,
    "render_nested": """
        SELECT doc_id, concat('doc_id=', doc_id, ', quality=', quality, ', toxic=', toxic) AS as_struct,
               CASE WHEN quality = 1 THEN concat(quality, ', ', toxic, ', 7') ELSE '-' END AS as_list,
               '2 items (see below)' AS as_items
        FROM labels
    """,
    "cell_texts": """
        SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 14 < 8 THEN o_totalprice / power(10, 8 - o_orderkey % 14)
                                     ELSE o_totalprice * power(10, o_orderkey % 14 - 8) END AS VARCHAR) AS text
        FROM orders
    """,
    "crs_labels": """
        SELECT s_suppkey,
               CASE s_suppkey % 8 WHEN 0 THEN concat('EPSG:', 32600 + s_nationkey, ' - ', s_name) WHEN 1 THEN s_name
                    WHEN 2 THEN concat('EPSG:', 4000 + s_nationkey, ' - ', s_name)
                    WHEN 3 THEN concat('EPSG:', 6000 + s_nationkey, ' - ', s_name)
                    WHEN 4 THEN concat('EPSG:', 4600 + s_nationkey, ' - ', s_name)
                    WHEN 5 THEN concat('EPSG:', 25800 + s_nationkey, ' - a "[', s_name) WHEN 6 THEN s_name END AS crs,
               CASE s_suppkey % 8 WHEN 0 THEN 'metre' WHEN 1 THEN 'US survey foot' WHEN 3 THEN 'foot' WHEN 5 THEN 'kilometre'
                    END AS linear_unit,
               CASE s_suppkey % 8 WHEN 2 THEN 'degree' WHEN 4 THEN 'grad' WHEN 6 THEN 'radian' END AS angular_unit
        FROM supplier
    """,
    "geometry_names": """
        SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN
            ['POINT', 'LINESTRING', 'POLYGON', 'MULTIPOINT', 'MULTILINESTRING', 'MULTIPOLYGON',
             'GEOMETRYCOLLECTION'][CAST(p_partkey % 7 AS INTEGER) + 1] END AS geometry
        FROM part
    """,
    "layer_geometry_types": "SELECT p_partkey, CASE "
    + " ".join(f"WHEN p_size = {code} THEN '{name}'" for code, name in SHAPE_TYPES.items())
    + " WHEN p_size < 32 THEN 'Unknown (any)' ELSE 'None' END AS geometry_type FROM part",
    "shapefile_scan": """
        SELECT event_id, event_type, user_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
               CAST(ts AS DATE) AS day, props, CASE WHEN located THEN 'POINT' END AS geometry,
               CASE WHEN located THEN value END AS xmin, CASE WHEN located THEN value END AS xmax,
               CASE WHEN located THEN CAST(user_id AS DOUBLE) END AS ymin,
               CASE WHEN located THEN CAST(user_id AS DOUBLE) END AS ymax, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, event_id % 10 > 0 AS located FROM events)
    """,
    "shapefile_extent": """
        SELECT 'Point' AS geometry_type, 'EPSG:4326 - WGS 84' AS crs, 7 AS field_count,
               (SELECT count(*) FROM events) AS feature_count, min(value) AS xmin, max(value) AS xmax,
               CAST(min(user_id) AS DOUBLE) AS ymin, CAST(max(user_id) AS DOUBLE) AS ymax
        FROM events WHERE event_id % 10 > 0
    """,
    "shapefile_geometry": """
        SELECT CASE WHEN event_id % 10 > 0 THEN 'POINT' END AS geometry, count(*) AS features FROM events GROUP BY 1
    """,
    "raster_pixels": """
        SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS band,
               round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value, CAST(NULL AS VARCHAR) AS error
        FROM embeddings
    """,
    "raster_band_stats": bands(EMBEDDING_PIXELS),
    "raster_bands": """
        SELECT 'GTiff' AS driver, 64 AS band_count, CAST(i AS INTEGER) AS band, 'Float32' AS data_type,
               CASE WHEN i = 1 THEN 'Gray' ELSE 'Undefined' END AS color_interp, '1x16' AS block_size,
               CAST(NULL AS VARCHAR) AS error, (SELECT count(*) FROM embeddings) AS rows
        FROM range(1, 65) t(i)
    """,
    "raster_band_stats_nodata": bands(ITEM_PIXELS),
    "polygon_scan": f"""
        SELECT partkey, name, CASE WHEN twice THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS geometry, xmin, xmax, ymin, ymax,
               CAST(CASE WHEN twice THEN 9 + 2 * ring_bytes ELSE ring_bytes END AS INTEGER) AS wkb_bytes,
               CAST(NULL AS VARCHAR) AS error
        FROM ({POLYGONS})
    """,
    "polygon_box": f"""
        SELECT partkey, xmin, xmax, ymin, ymax FROM ({POLYGONS})
        WHERE xmin <= 150 AND xmax >= 120 AND ymin <= 1100 AND ymax >= 900
    """,
    "shapefile_folder": """
        SELECT 'suppliers' AS kind, s_suppkey AS number, CAST(NULL AS BIGINT) AS custkey, s_name AS name,
               CAST(s_nationkey AS DOUBLE) AS nation, 'POINT' AS geometry, s_acctbal AS xmin, CAST(NULL AS VARCHAR) AS error
        FROM supplier
        UNION ALL SELECT 'customers', NULL, c_custkey, c_mktsegment, c_acctbal, NULL, NULL, NULL FROM customer
        UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, 'Could not open shapefile: index file is missing'
        FROM region WHERE r_regionkey % 2 = 0
    """,
    "damaged_files": """
        SELECT 'suppliers' AS kind, false AS damaged, count(*) AS features FROM supplier
        UNION ALL SELECT 'customers', false, count(*) FROM customer
        UNION ALL SELECT DISTINCT 'broken', true, 0 FROM region
    """,
    "discover_tree": f"SELECT *, {size_text('size_bytes')} AS size FROM ({TREE_DATASETS})",
    "raster_layers": f"SELECT layer, path FROM ({TREE_DATASETS}) WHERE format = 'raster'",
    "dataset_size": f"""
        SELECT *, {size_text('size_bytes')} AS size FROM (
            SELECT 'tree' AS name, CAST(sum(length) AS BIGINT) AS size_bytes FROM ({TREE})
            UNION ALL SELECT 'folder', CAST(coalesce(sum(length), 0) AS BIGINT) FROM ({TREE}) WHERE path LIKE 'n3/%'
            UNION ALL SELECT 'shapefile', CAST(sum(length) AS BIGINT) FROM ({TREE}) WHERE key BETWEEN 70 AND 72
            UNION ALL SELECT 'missing', 0)
    """,
    "refreshed_profile": """
        SELECT event_type AS layer, CAST(count(*) AS BIGINT) AS feature_count, min(value) + 0.0 AS xmin, max(value) + 0.0 AS xmax,
               CAST(min(user_id) AS DOUBLE) AS ymin, CAST(max(user_id) AS DOUBLE) AS ymax
        FROM events WHERE event_id % 4 <> 1 OR value > 50 GROUP BY event_type
    """,
    "scan_progress": """
        SELECT batch, n // 4 AS rows, (batch + 1) * (n // 4) AS loaded, n AS total,
               CAST(floor(100.0 * ((batch + 1) * (n // 4)) / n) AS BIGINT) AS percent
        FROM range(4) b(batch), (SELECT count(*) AS n FROM events)
    """,
    "search_indexed": "SELECT * FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(lang), 'the ')",
    "stream_profile": box("events", "events", "value", "user_id"),
}
