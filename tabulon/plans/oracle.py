"""DuckDB SQL of each query of the catalogue."""

ORACLES = {
    "scan": r"""SELECT * FROM nation""",
    "select_reorder": r"""SELECT o_totalprice, o_orderkey FROM orders""",
    "query_predicate": r"""SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'""",
    "filter_mask": r"""SELECT * FROM events WHERE event_id % 3 = 0""",
    "filter_short_mask": r"""SELECT * FROM events WHERE event_id < 100 AND event_id % 2 = 0""",
    "take": r"""SELECT * FROM events WHERE event_id IN (4, 0, 2, 97)""",
    "head": r"""SELECT * FROM events ORDER BY event_id LIMIT 5""",
    "tail": r"""SELECT * FROM events ORDER BY event_id DESC LIMIT 5""",
    "slice": r"""SELECT * FROM events ORDER BY event_id LIMIT 20 OFFSET 100""",
    "slice_negative": r"""SELECT * FROM events WHERE event_id >= (SELECT count(*) - 10 FROM events) AND event_id < (SELECT count(*) - 7 FROM events)""",
    "row_at": r"""SELECT * FROM events WHERE event_id = 7 OR event_id = (SELECT count(*) - 1 FROM events)""",
    "collect_limit": r"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""",
    "distinct": r"""SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""",
    "distinct_with_nulls": r"""SELECT DISTINCT nullif(event_type, 'view') AS event_type FROM events""",
    "union_all": r"""SELECT * FROM nation UNION ALL SELECT * FROM nation""",
    "union_distinct_rows": r"""SELECT DISTINCT * FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)""",
    "shape": r"""SELECT count(*) AS rowcount, CAST(6 AS BIGINT) AS columncount FROM orders""",
    "batches": r"""SELECT CAST(event_id // 1000 AS BIGINT) AS batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1""",
    "group_count": r"""SELECT count(*) AS "COUNT(*)", o_orderstatus FROM orders GROUP BY o_orderstatus""",
    "group_count_column": r"""SELECT count(nullif(event_type, 'view')) AS "COUNT(event_type)", user_id FROM events GROUP BY user_id""",
    "group_sum": r"""SELECT CAST(sum(l_linenumber) AS BIGINT) AS "SUM(l_linenumber)", l_returnflag FROM lineitem GROUP BY l_returnflag""",
    "group_min": r"""SELECT min(o_totalprice) AS "MIN(o_totalprice)", o_orderpriority FROM orders GROUP BY o_orderpriority""",
    "group_max": r"""SELECT max(o_orderdate) AS "MAX(o_orderdate)", o_custkey FROM orders GROUP BY o_custkey""",
    "group_avg": r"""SELECT round(avg(l_quantity), 6) AS "AVG(l_quantity)", l_returnflag FROM lineitem GROUP BY l_returnflag""",
    "group_multi": r"""SELECT CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS "SUM(l_quantity)", count(l_quantity) AS "COUNT(l_quantity)", min(l_quantity) AS "MIN(l_quantity)", max(l_quantity) AS "MAX(l_quantity)", l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "group_all_null": r"""SELECT min(CASE WHEN event_type = 'view' THEN NULL ELSE value END) AS "MIN(value)", count(*) AS "COUNT(*)", event_type FROM events GROUP BY event_type""",
    "groups": r"""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""",
    "column_stats": r"""SELECT min(o_totalprice) AS lowest_value, max(o_totalprice) AS highest_value, count(*) - count(o_totalprice) AS null_count FROM orders""",
    "validate": r"""SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'Column not Nullable' END AS error FROM orders""",
    "cast_boolean": r"""SELECT event_id, upper(CASE event_id % 5 WHEN 0 THEN 'on' WHEN 1 THEN 'off' WHEN 2 THEN '1.0' WHEN 3 THEN 'y' ELSE 'abc' END) IN ('TRUE','ON','YES','1','1.0','T','Y') AS flag FROM events""",
    "cast_integer": r"""SELECT event_id, CAST(trunc(value) AS BIGINT) AS value_int FROM events""",
    "cast_decimal": r"""SELECT event_id, CAST(value AS DECIMAL(12,2)) AS value_dec FROM events""",
    "cast_varchar_n": r"""SELECT c_custkey, substr(c_name, 1, 8) AS c_name8 FROM customer""",
    "cast_blob_n": r"""SELECT c_custkey, encode(substr(c_name, 1, 5)) AS c_name_blob FROM customer""",
    "cast_date": r"""SELECT event_id, CAST(ts AS DATE) AS d FROM events""",
    "cast_timestamp_iso": r"""SELECT event_id, date_trunc('second', ts) AS ts_s FROM events""",
    "cast_timestamp_epoch": r"""SELECT event_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(event_id * 1000) AS ts_e FROM events""",
    "cast_interval": r"""SELECT event_id, ts + to_days(CAST(event_id % 5 AS INTEGER)) AS ts_shift FROM events""",
    "cast_array": r"""SELECT event_id, [event_id, event_id + 1] AS arr FROM events""",
    "cast_vector": r"""SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings""",
    "json_field": r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "rle_encode": r"""SELECT min(event_id) AS start_pos, any_value(event_type) AS run_value, count(*) AS run_length FROM (SELECT *, sum(chg) OVER (ORDER BY event_id) AS run_id FROM (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS chg FROM events)) GROUP BY run_id""",
    "rle_decode": r"""SELECT event_id AS pos, event_type AS v FROM events""",
    "dict_encode": r"""SELECT event_type, CAST(row_number() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS code FROM (SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY event_type)""",
    "dict_encode_sorted": r"""SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code FROM events""",
    "dict_decode": r"""SELECT event_id, event_type FROM events""",
    "sparse_encode": r"""SELECT event_id AS idx, event_type AS v FROM events WHERE event_type IS DISTINCT FROM 'view'""",
    "sparse_decode": r"""SELECT event_id AS idx, event_type AS v FROM events""",
    "constant_column": r"""SELECT event_id, 'fixed' AS c FROM events""",
    "compressed_multiply": r"""SELECT l_orderkey, l_linenumber, l_linenumber * 2 AS doubled FROM lineitem""",
    "row_json": r"""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS js FROM nation""",
    "frame_hash": r"""SELECT bit_xor(CAST('0x' || substr(md5(length(CAST(event_id AS VARCHAR)) || ':' || event_id || coalesce(length(event_type) || ':' || event_type, '-')), 1, 15) AS BIGINT)) AS h, count(*) AS n FROM events""",
    "arrow_roundtrip": r"""SELECT * FROM customer""",
    "description": r"""SELECT * FROM (VALUES ('n_nationkey','INTEGER',true),('n_name','VARCHAR',true),('n_regionkey','INTEGER',true)) t(name, type_code, null_ok)""",
    "redact": r"""SELECT c_custkey, substr(sha256(c_name), 1, 8) AS redacted FROM customer""",
    "flagship": r"""SELECT CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS "SUM(l_quantity)", CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(20,2)) AS "SUM(l_extendedprice)", round(avg(l_discount), 6) AS "AVG(l_discount)", count(*) AS "COUNT(*)", l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus""",
    "distinct_keep_first": """SELECT event_type, min(event_id) AS first_position FROM events GROUP BY event_type""",
    "take_after_query": r"""SELECT * FROM events WHERE event_id IN (3, 17, 38)""",
    "mask_after_query": r"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events WHERE event_id % 7 = 3) WHERE k < 90 AND k % 3 = 0""",
    "batches_after_query": r"""SELECT CAST(k // 500 AS BIGINT) AS batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events WHERE event_type <> 'view') GROUP BY 1""",
    "slice_after_query": r"""SELECT * FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 30 OFFSET 40""",
    "slice_of_slice": r"""SELECT * FROM events WHERE event_id IN ((SELECT count(*) - 90 FROM events), (SELECT count(*) - 71 FROM events))""",
    "batch_three": r"""SELECT * FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 21""",
    "head_of_union": r"""SELECT * FROM region UNION ALL SELECT * FROM region WHERE r_regionkey IN (3, 4)""",
    "take_of_union": r"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation WHERE n_regionkey IN (1, 3)) WHERE k IN (0, 4)""",
    "distinct_in_order": r"""SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS place FROM (SELECT o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY o_orderpriority)""",
    "from_dicts": r"""SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (NULL, 'y'), (4, NULL)) t(a, b)""",
    "append_records": r"""SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 5 <> 0 THEN 'nation ' || n_nationkey END AS name, CAST(n_nationkey / 4 AS DECIMAL(10,2)) AS price FROM nation""",
    "defaults": r"""SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS event_type, CASE WHEN event_id % 3 > 0 THEN coalesce(value, -1.0) ELSE -1.0 END AS value FROM events""",
    "validate_types": r"""SELECT o_orderkey, concat_ws('; ', 'extra: Unknown field', CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'o_orderstatus: Column not Nullable' END, CASE WHEN o_orderkey % 2 = 0 AND o_totalprice IS NOT NULL THEN 'price: Wrong type, DOUBLE for INTEGER' END, 'lost: Column missing') AS faults FROM orders""",
    "cast_decimal_wide": r"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN '123456789012.500000000000000000000' WHEN 1 THEN '12345678901234567.000000000000000000000' WHEN 2 THEN '0.123456789012345678901' WHEN 3 THEN '-99999999999999999.999999999999999999999' WHEN 4 THEN '2.500000000000000000000' WHEN 6 THEN '1000.000000000000000000000' END AS dec FROM events""",
    "cast_decimal_big": r"""SELECT event_id, CASE WHEN event_id = 0 THEN '0.12' ELSE event_id || '0000000000000000000000.' || CASE WHEN length(CAST(event_id AS VARCHAR)) + 22 <= 30 THEN '12' ELSE '13' END END AS dec FROM events""",
    "cast_double": r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN -2000.0 WHEN 4 THEN 7.0 END::DOUBLE AS num FROM events""",
    "cast_time": r"""SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events""",
    "cast_varchar_bytes": r"""SELECT event_id, event_id || CASE length(CAST(event_id AS VARCHAR)) WHEN 1 THEN 'é日' WHEN 2 THEN 'é日' WHEN 3 THEN 'é日' WHEN 4 THEN 'é日' WHEN 5 THEN 'é' WHEN 6 THEN 'é' END AS short FROM events""",
    "cast_interval_fraction": r"""SELECT event_id, ts + to_hours(CAST(event_id % 8 * 6 AS INTEGER)) AS ts_shift FROM events""",
    "cast_epoch_zone": r"""SELECT event_id, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(event_id * 86399), '%Y-%m-%d %H:%M:%S') AS moment FROM events""",
    "encode_rle": r"""SELECT min(event_id) AS start_pos, any_value(event_type) AS run_value, count(*) AS run_length FROM (SELECT *, sum(chg) OVER (ORDER BY event_id) AS run_id FROM (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS chg FROM events)) GROUP BY run_id""",
    "encode_dictionary": r"""SELECT event_id, code FROM events JOIN (SELECT event_type AS v, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS code FROM events GROUP BY event_type) ON event_type IS NOT DISTINCT FROM v""",
    "row_bytes": r"""SELECT unhex('5201' || printf('%08X', strlen(js)) || hex(js)) AS frame FROM (SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS js FROM nation)""",
    "promotion_table": r"""WITH t(n, g, i) AS (VALUES ('BOOLEAN','num',1),('INTEGER','num',2),('DOUBLE','num',3),('DECIMAL','num',4),('VARCHAR','',0),('BLOB','',0),('DATE','time',1),('TIMESTAMP','time',2),('TIME','',0),('INTERVAL','',0),('ARRAY','list',2),('STRUCT','',0),('JSONB','',0),('VECTOR','list',1),('NULL','',0))
SELECT a.n AS a, b.n AS b, CASE WHEN a.n = b.n THEN a.n WHEN a.n = 'NULL' THEN b.n WHEN b.n = 'NULL' THEN a.n WHEN a.g = b.g AND a.g <> '' THEN CASE WHEN a.i > b.i THEN a.n ELSE b.n END
WHEN least(a.n, b.n) = 'BLOB' AND greatest(a.n, b.n) = 'VARCHAR' THEN 'VARCHAR' WHEN a.n = 'BLOB' OR b.n = 'BLOB' OR (a.n IN ('STRUCT','JSONB','VARCHAR') AND b.n IN ('STRUCT','JSONB','VARCHAR')) THEN 'BLOB' ELSE 'VARCHAR' END AS result FROM t a, t b""",
    "from_tuples": r"""SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region""",
    "pandas_roundtrip": r"""SELECT * FROM supplier""",
    "column_arrays": r"""SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key FROM nation""",
    "record_columns": r"""SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS nothing, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation""",
    "row_frames_roundtrip": r"""SELECT * FROM supplier""",
    "row_accessors": r"""SELECT r_name AS name, '-' AS other, 'r_regionkey,r_name' AS fields, CAST(r_regionkey AS BIGINT) AS key, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS js FROM region""",
    "frame_bytes": r"""SELECT CAST(sum(strlen('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}')) AS BIGINT) AS bytes FROM nation""",
    "cursor_fetches": r"""SELECT CASE WHEN k = 1 THEN 'one' WHEN k <= 5 THEN 'many' ELSE 'all' END AS how, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) UNION ALL SELECT 'end', CAST(-1 AS BIGINT), 'None'""",
    "materialized": r"""SELECT count(*) AS rowcount, (SELECT count(*) FROM (DESCRIBE customer)) AS columncount, count(*) AS iterated FROM customer""",
    "query_callable": r"""SELECT * FROM nation WHERE n_regionkey = 2 AND n_name LIKE '%I%'""",
    "cast_null": r"""SELECT r_regionkey, CAST(NULL AS VARCHAR) AS nothing FROM region""",
    "function_column": r"""SELECT r_regionkey, CAST(42 AS INTEGER) AS made FROM region""",
    "type_names": r"""SELECT * FROM (VALUES ('bigint','INTEGER',true,false,false,'int'),('VARCHAR[12]','VARCHAR[12]',false,false,false,'str'),('decimal(10, 2)','DECIMAL(10,2)',true,false,false,'Decimal'),('list','ARRAY<VARCHAR>',false,false,true,'list'),('array<date>','ARRAY<DATE>',false,false,true,'list'),('vector[8]','VECTOR[8]',false,false,true,'list'),('numeric(4,1)','DECIMAL(4,1)',true,false,false,'Decimal'),('bson','JSONB',false,false,true,'bytes'),('blob[3]','BLOB[3]',false,false,false,'bytes'),('Timestamp','TIMESTAMP',false,true,false,'datetime'),('varchar[x]',NULL,NULL,NULL,NULL,NULL),('decimal(40,2)',NULL,NULL,NULL,NULL,NULL),('array<array<integer>>',NULL,NULL,NULL,NULL,NULL),('integer[3]',NULL,NULL,NULL,NULL,NULL),('',NULL,NULL,NULL,NULL,NULL)) t(given, type, numeric, temporal, complex, python)""",
    "arrow_fields": r"""SELECT column_name AS name, CASE WHEN column_type IN ('BIGINT','INTEGER') THEN 'INTEGER' WHEN column_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE column_type END AS type, CASE WHEN column_type IN ('BIGINT','INTEGER') THEN 'int64' WHEN column_type = 'DOUBLE' THEN 'double' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'DATE' THEN 'date32[day]' ELSE 'timestamp[us]' END AS arrow, true AS nullable, CASE WHEN column_type IN ('BIGINT','INTEGER') THEN 'INTEGER' WHEN column_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE column_type END AS again FROM (DESCRIBE orders)""",
    "schema_lookup": r"""SELECT * FROM (VALUES ('id','id','id'),('nr','id','id'),('NAME',NULL,'name'),('price','price','price'),('none',NULL,NULL)) t(wanted, found, found_in_any_case)""",
    "schema_algebra": r"""SELECT CAST(place AS BIGINT) AS place, name, names, 'id' AS gone, 'm,o' AS aliases, CAST(3 AS BIGINT) AS columns FROM (VALUES (0,'name','name'),(1,'price','price'),(2,'late','late')) t(place, name, names)""",
    "schema_roundtrip": r"""SELECT * FROM (VALUES ('id','INTEGER',false,CAST(NULL AS VARCHAR),CAST(NULL AS VARCHAR),CAST(NULL AS VARCHAR),'INTEGER',true),('name','VARCHAR[8]',true,'x',NULL,NULL,'VARCHAR[8]',true),('price','DECIMAL(9,2)',true,NULL,'MONEY',NULL,'DECIMAL(9,2)',true)) t(name, type, nullable, preset, disposition, flat, again, found)""",
    "record_faults": r"""SELECT CAST(record AS BIGINT) AS record, fault FROM (VALUES (0,'valid'),(1,'id: Column not Nullable; name: Wrong type, int for VARCHAR[8]'),(2,'name: Column missing; price: Column missing'),(3,'unknown fields: more, most')) t(record, fault)""",
    "markdown_lines": r"""WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS k, CAST(r_regionkey AS VARCHAR) AS a, r_name AS b FROM region), h AS (SELECT * FROM r WHERE k <= 3), w AS (SELECT CAST(greatest(11, max(length(a))) AS INTEGER) AS wa, CAST(greatest(6, max(length(b))) AS INTEGER) AS wb FROM h)
SELECT CAST(0 AS BIGINT) AS line, '| ' || rpad('r_regionkey', wa, ' ') || ' | ' || rpad('r_name', wb, ' ') || ' |' AS shown FROM w UNION ALL SELECT 1, '|' || repeat('-', CAST(wa + 2 AS BIGINT)) || '|' || repeat('-', CAST(wb + 2 AS BIGINT)) || '|' FROM w UNION ALL SELECT k + 1, '| ' || rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' |' FROM h, w""",
    "html_table": r"""SELECT '<table><thead><tr><th>r_regionkey</th><th>r_name</th></tr></thead><tbody>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</tbody></table><p>' || count(*) || ' rows x 2 columns</p>' AS shown FROM region""",
    "interval_text": r"""SELECT CAST(seconds AS BIGINT) AS seconds, shown FROM (VALUES (0,'0s'),(59,'59.00s'),(3600,'1h'),(90061,'1d 1h 1m 1.00s'),(31536000,'1y')) t(seconds, shown)""",
}
