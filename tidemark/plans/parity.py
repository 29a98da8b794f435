"""Host parity: ordinary SQL that Spark has built in, one query for each kind. The text
is run by Spark and, in the other dialect, is its own oracle."""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events".split()

#: name: (Spark SQL, the same for the oracle where the dialects differ)
SQL: dict[str, str | tuple[str, str]] = {
    "h1_full_join": "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey",
    "h1_right_join": "SELECT n.n_name AS n, r.r_name AS r FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey",
    "h2_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)",
    "h2_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "h3_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "h5_lateral": "SELECT r.r_name, t.n_name FROM region r, LATERAL (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_nationkey LIMIT 2) t",
    "h6_having_filter": "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "h6_pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "h7_distinct_agg": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus",
    "h8_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "h8_cube": "SELECT n_regionkey, n_nationkey % 2 AS k, count(*) AS n FROM nation GROUP BY CUBE (n_regionkey, n_nationkey % 2)",
    "h8_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "h9_statistics": "SELECT round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(regr_slope(l_extendedprice, l_quantity), 3) AS sl FROM lineitem",
    "h9_percentile": ("SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p FROM events GROUP BY event_type"),
    "h10_bool_bit": "SELECT n_regionkey, bool_and(n_nationkey > 3) AS a, bool_or(n_nationkey > 20) AS o, bit_or(n_nationkey) AS b, bit_and(n_nationkey) AS c FROM nation GROUP BY n_regionkey",
    "h10_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey"),
    "h11_ranking": "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "h11_percent": "SELECT n_nationkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)",
    "h12_lag_lead": "SELECT event_id, lag(event_id, 1) OVER w AS b, lead(event_id, 2) OVER w AS a, first_value(event_id) OVER w AS f, nth_value(event_id, 3) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "h13_frames": "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS r, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS g FROM events",
    "h14_nulls_last_top_k": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey ASC NULLS LAST, c.c_custkey LIMIT 20 OFFSET 5",
    "h15_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "h15_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "h15_intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_nationkey % 5 FROM nation WHERE n_nationkey > 4",
    "h15_except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "h16_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "h16_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT max(n) AS m, min(n) AS l FROM big",
    "h17_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "h17_scalar": "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) - 100 FROM orders)",
    "h18_strings": "SELECT n_nationkey, substr(n_name, 2, 3) AS a, lpad(n_name, 12, '*') AS b, replace(n_name, 'A', '_') AS c, upper(trim(n_name)) AS d, translate(n_name, 'AEI', 'aei') AS e, split_part(n_name, ' ', 1) AS f, length(n_name) AS g FROM nation",
    "h18_regexp": ("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS x FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS x FROM customer"),
    "h19_dates": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate + INTERVAL 40 DAYS) AS BIGINT) AS d FROM orders",
    "h19_trunc": ("SELECT date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS m, count(*) AS n FROM orders GROUP BY 1", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, count(*) AS n FROM orders GROUP BY 1"),
    "h20_math": "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(power(p_size, 2), 3) AS p, round(ln(p_size + 1), 6) AS l, greatest(p_size, 20) AS g, least(p_size, 20) AS s FROM part",
    "h21_arrays": ("SELECT n_regionkey, sort_array(collect_list(n_nationkey))[0] AS first, size(collect_list(n_nationkey)) AS n, array_contains(collect_list(n_nationkey), 7) AS has FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(n_nationkey))[1] AS first, len(list(n_nationkey))::INT AS n, list_contains(list(n_nationkey), 7) AS has FROM nation GROUP BY n_regionkey"),
    "h22_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props->>'k' AS k FROM events"),
    "h23_map": ("SELECT n_regionkey, map_from_entries(collect_list(struct(n_nationkey, n_name)))[n_regionkey] AS name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, max(n_name) FILTER (n_nationkey = n_regionkey) AS name FROM nation GROUP BY n_regionkey"),
    "h24_tablesample_all": ("SELECT n_nationkey, n_name FROM nation TABLESAMPLE (100 PERCENT)", "SELECT n_nationkey, n_name FROM nation"),
    "h26_sliding": (
        "SELECT event_type, unix_timestamp(cast(w.start as timestamp)) AS start, count(*) AS n FROM (SELECT event_type, window(ts, '2 hours', '1 hour') AS w FROM events) GROUP BY event_type, w",
        "SELECT event_type, CAST(epoch(s) AS BIGINT) AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS s FROM events, (VALUES (0), (1)) t(i)) GROUP BY ALL",
    ),
    "h26_session": (
        "SELECT user_id, unix_micros(cast(w.start as timestamp)) AS start, n FROM (SELECT user_id, session_window(ts, '6 hours') AS w, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '6 hours'))",
        """SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (
            SELECT user_id, ts, sum(CASE WHEN ts < before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
            FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s""",
    ),
    "h24_values":"SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(i, s)",
    "h26_tumbling": ("SELECT event_type, unix_timestamp(cast(w.start as timestamp)) AS start, count(*) AS n FROM (SELECT event_type, window(ts, '1 hour') AS w FROM events) GROUP BY event_type, w", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL"),
}


def _spark_text(text: str) -> str:
    return re.sub(r"\b(FROM|JOIN|,)\s+(" + "|".join(TABLES) + r")\b", r"\1 {\2}", text)


def _run(text: str):
    names = [t for t in TABLES if "{" + t + "}" in text]
    return lambda spark, d: spark.sql(text, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in names})


def queries() -> dict:
    return {k: _run(_spark_text(v if isinstance(v, str) else v[0])) for k, v in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[1] for k, v in SQL.items()}
