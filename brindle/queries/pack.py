"""Queries in the dialect by group: (name, dialect, DuckDB). An empty twin: SQL cannot express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.query import Query
from brindle.sources import load_tables


def runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Query(load_tables(spark, sf_dir), text).dataframe()


SCANS = [
    ("scan_region", "SELECT * FROM region", "SELECT r_regionkey, r_name FROM region"),
    ("select_star_qualified", "SELECT n.*, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n.n_nationkey, n.n_name, n.n_regionkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    ("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem"),
    ("filter_and_or_not", "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0.0) AND NOT c_nationkey = 3", "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT (c_nationkey = 3)"),
    ("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 10 + 2 AND l_shipdate NOT BETWEEN #1996-01-01# AND #1997-01-01#", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate NOT BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'"),
    ("filter_in_list", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3 + 4)", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 7)"),
    ("filter_not_in_list", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)"),
    ("filter_is_null", "SELECT n_name, NULLIF(n_regionkey, 2) AS k FROM nation WHERE NULLIF(n_regionkey, 2) IS NULL OR NULLIF(n_regionkey, 1) IS NOT NULL", "SELECT n_name, nullif(n_regionkey, 2) AS k FROM nation WHERE nullif(n_regionkey, 2) IS NULL OR nullif(n_regionkey, 1) IS NOT NULL"),
    ("like_ci", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%ro%' AND p_name LIKE 'R_D %'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%ro%' AND p_name ILIKE 'R_D %'"),
    ("not_like", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'brand#1%'", "SELECT p_partkey FROM part WHERE p_brand NOT ILIKE 'brand#1%'"),
    ("similar_to", "SELECT n_name FROM nation WHERE n_name SIMILAR TO '_1[0-5]$' OR n_name NOT SIMILAR TO '[0-9]'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_1[0-5]$') OR NOT regexp_matches(n_name, '[0-9]')"),
    ("sounds_like", "SELECT a.n_name AS x, b.r_name AS y FROM nation a CROSS JOIN region b WHERE a.n_name SOUNDS LIKE 'Natian' AND b.r_name SOUNDS LIKE 'Ashia'", "SELECT a.n_name AS x, b.r_name AS y FROM nation a CROSS JOIN region b WHERE b.r_name = 'ASIA'"),
    ("select_without_from", "SELECT 1 AS one, 'it''s' AS two, TRUE AS three", "SELECT 1 AS one, 'it''s' AS two, TRUE AS three"),
]

OPERATORS = [
    ("int_division", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, -l_linenumber / 2 AS h FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, CAST(trunc(-l_linenumber / 2) AS INTEGER) AS h FROM lineitem"),
    ("float_division_by_zero", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / (n_regionkey - 2) AS q FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / CAST(n_regionkey - 2 AS DOUBLE) AS q FROM nation"),
    ("modulo", "SELECT o_orderkey, o_orderkey % 7 AS m, (0 - o_orderkey) % 7 AS n FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, (0 - o_orderkey) % 7 AS n FROM orders"),
    ("power", "SELECT n_nationkey, n_nationkey ** 2 AS p, 2 ** n_regionkey AS q FROM nation", "SELECT n_nationkey, pow(n_nationkey, 2) AS p, pow(2, n_regionkey) AS q FROM nation"),
    ("bitops_int", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, n_nationkey ^ 6 AS x, ~n_nationkey AS c FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, xor(n_nationkey, 6) AS x, ~n_nationkey AS c FROM nation"),
    ("bitops_bool", "SELECT n_nationkey, (n_nationkey > 5) & (n_regionkey > 2) AS a, (n_nationkey > 5) | (n_regionkey > 2) AS o, (n_nationkey > 5) ^ (n_regionkey > 2) AS x FROM nation", "SELECT n_nationkey, n_nationkey > 5 AND n_regionkey > 2 AS a, n_nationkey > 5 OR n_regionkey > 2 AS o, (n_nationkey > 5) <> (n_regionkey > 2) AS x FROM nation"),
    ("shifts", "SELECT n_nationkey, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation", "SELECT n_nationkey, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation"),
    ("unary_ops", "SELECT n_nationkey, -n_nationkey AS m, +n_nationkey AS p, NOT n_nationkey > 3 AS b FROM nation", "SELECT n_nationkey, -n_nationkey AS m, n_nationkey AS p, NOT (n_nationkey > 3) AS b FROM nation"),
    ("string_concat_mixed", "SELECT n_name + ':' + n_nationkey + ':' + (n_nationkey > 3) AS s FROM nation", "SELECT n_name || ':' || n_nationkey || ':' || CASE WHEN n_nationkey > 3 THEN 'True' ELSE 'False' END AS s FROM nation"),
    ("compare_bang_ops", "SELECT n_nationkey FROM nation WHERE n_nationkey !< 5 AND n_nationkey !> 20 AND n_regionkey != 2", "SELECT n_nationkey FROM nation WHERE n_nationkey >= 5 AND n_nationkey <= 20 AND n_regionkey <> 2"),
    ("three_valued_logic", "SELECT n_nationkey, NULLIF(n_regionkey, 1) > 1 AND n_nationkey > 5 AS a, NULLIF(n_regionkey, 1) > 1 OR n_nationkey > 5 AS o, NOT NULLIF(n_regionkey, 1) > 1 AS n FROM nation", "SELECT n_nationkey, nullif(n_regionkey, 1) > 1 AND n_nationkey > 5 AS a, nullif(n_regionkey, 1) > 1 OR n_nationkey > 5 AS o, NOT (nullif(n_regionkey, 1) > 1) AS n FROM nation"),
    ("precedence", "SELECT n_nationkey FROM nation WHERE NOT n_regionkey = 1 AND n_nationkey * 2 + 1 > 9 OR n_name LIKE '%_3' AND 2 ** 2 * 3 = 12.0", "SELECT n_nationkey FROM nation WHERE ((NOT (n_regionkey = 1)) AND n_nationkey * 2 + 1 > 9) OR n_name ILIKE '%_3'"),
    ("number_literals", "SELECT 0FFh AS h, 101b AS b, 17o AS o, 1e2 AS e, .5 AS f, 3000000000 AS l", "SELECT 255 AS h, 5 AS b, 15 AS o, CAST(100 AS DOUBLE) AS e, CAST(0.5 AS DOUBLE) AS f, CAST(3000000000 AS BIGINT) AS l"),
]

CONDITIONAL = [
    ("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0.0 THEN 'debt' WHEN c_acctbal < 5000.0 THEN 'some' ELSE 'rich' END AS k FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS k FROM customer"),
    ("case_simple", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k FROM nation", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k FROM nation"),
    ("case_no_else", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey WHEN n_regionkey = 2 THEN 0.5 END AS k FROM nation", "SELECT n_name, CAST(CASE WHEN n_regionkey = 1 THEN n_nationkey WHEN n_regionkey = 2 THEN 0.5 END AS DOUBLE) AS k FROM nation"),
    ("coalesce_multi", "SELECT n_name, COALESCE(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 1), -1) AS k FROM nation", "SELECT n_name, coalesce(nullif(n_regionkey, 1), nullif(n_nationkey, 1), -1) AS k FROM nation"),
    ("nullif_std", "SELECT n_name, NULLIF(n_regionkey, n_nationkey) AS k, NULLIF(n_regionkey, NULLIF(n_regionkey, n_regionkey)) AS s FROM nation", "SELECT n_name, nullif(n_regionkey, n_nationkey) AS k, n_regionkey AS s FROM nation"),
    ("cast_matrix", "SELECT n_nationkey, CAST(n_nationkey AS LONG) AS l, CAST(n_nationkey AS DOUBLE) AS d, CAST(n_nationkey + 0.75 AS INT) AS i, CAST(n_regionkey AS SHORT) AS s FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS l, CAST(n_nationkey AS DOUBLE) AS d, CAST(trunc(n_nationkey + 0.75) AS INTEGER) AS i, CAST(n_regionkey AS SMALLINT) AS s FROM nation"),
]

FUNCTIONS = [
    ("math_trig", "SELECT n_nationkey, ROUND(SIN(n_nationkey) + COS(n_nationkey) + TAN(n_nationkey), 6) AS t, ROUND(ASIN(n_nationkey / 30.0) + ACOS(n_nationkey / 30.0) + ATAN(n_nationkey) + ATAN2(n_nationkey, 2), 6) AS a, ROUND(SINH(n_nationkey / 10.0) + COSH(n_nationkey / 10.0) + TANH(n_nationkey), 6) AS h FROM nation", "SELECT n_nationkey, round(sin(n_nationkey) + cos(n_nationkey) + tan(n_nationkey), 6) AS t, round(asin(n_nationkey / 30.0) + acos(n_nationkey / 30.0) + atan(n_nationkey) + atan2(n_nationkey, 2), 6) AS a, round(sinh(n_nationkey / 10.0) + cosh(n_nationkey / 10.0) + tanh(n_nationkey), 6) AS h FROM nation"),
    ("math_exp_log", "SELECT n_nationkey, ROUND(EXP(n_nationkey / 10.0), 6) AS e, ROUND(LOG(n_nationkey + 1), 6) AS l, ROUND(LOG(n_nationkey + 1, 2), 6) AS l2, ROUND(LOG10(n_nationkey + 1), 6) AS l10, ROUND(SQRT(n_nationkey), 6) AS s, POW(n_nationkey, 2) AS p FROM nation", "SELECT n_nationkey, round(exp(n_nationkey / 10.0), 6) AS e, round(ln(n_nationkey + 1), 6) AS l, round(log2(n_nationkey + 1), 6) AS l2, round(log10(n_nationkey + 1), 6) AS l10, round(sqrt(n_nationkey), 6) AS s, pow(n_nationkey, 2) AS p FROM nation"),
    ("math_round_ceil_floor", "SELECT c_custkey, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1, CEILING(c_acctbal) AS c, FLOOR(c_acctbal) AS f FROM customer", "SELECT c_custkey, round(c_acctbal) AS r, round(c_acctbal, 1) AS r1, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer"),
    ("math_abs_sign", "SELECT c_custkey, ABS(c_acctbal) AS a, SIGN(c_acctbal) AS s, ABS(-c_nationkey) AS i FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INTEGER) AS s, abs(-c_nationkey) AS i FROM customer"),
    ("str_case_trim", "SELECT UPPER(n_name) AS u, LOWER(n_name) AS l, TRIM('  ' + n_name + ' ') AS t, LTRIM('  ' + n_name) AS lt, RTRIM(n_name + '  ') AS rt, LEN(n_name) AS n FROM nation", "SELECT upper(n_name) AS u, lower(n_name) AS l, n_name AS t, n_name AS lt, n_name AS rt, CAST(length(n_name) AS INTEGER) AS n FROM nation"),
    ("str_substring_edges", "SELECT n_name, SUBSTRING(n_name, 1, 3) AS a, SUBSTRING(n_name, 0) AS b, SUBSTRING(n_name, 100) AS c, SUBSTRING(n_name, 8) AS d FROM nation", "SELECT n_name, substr(n_name, 1, 3) AS a, '' AS b, '' AS c, substr(n_name, 8) AS d FROM nation"),
    ("str_charindex", "SELECT n_name, CHARINDEX('_', n_name) AS a, CHARINDEX('', n_name) AS b, CHARINDEX('zz', n_name) AS c FROM nation", "SELECT n_name, CAST(instr(n_name, '_') AS INTEGER) AS a, 0 AS b, 0 AS c FROM nation"),
    ("str_left_right", "SELECT LEFT(n_name, 3) AS l, RIGHT(n_name, 2) AS r, LEFT(n_name, 99) AS a, RIGHT(n_name, 0) AS z FROM nation", "SELECT left(n_name, 3) AS l, right(n_name, 2) AS r, n_name AS a, '' AS z FROM nation"),
    ("str_pad_repeat_reverse", "SELECT LPAD(n_name, 12) AS l, RPAD(n_name, 12) AS r, LPAD(n_name, 2) AS s, REPLICATE('ab', n_regionkey) AS p, REVERSE(n_name) AS v, '[' + SPACE(n_regionkey) + ']' AS e FROM nation", "SELECT lpad(n_name, greatest(12, length(n_name))::INT, ' ') AS l, rpad(n_name, greatest(12, length(n_name))::INT, ' ') AS r, n_name AS s, repeat('ab', n_regionkey) AS p, reverse(n_name) AS v, '[' || repeat(' ', n_regionkey) || ']' AS e FROM nation"),
    ("str_replace", "SELECT REPLACE(n_name, 'NATION', 'Land') AS r FROM nation", "SELECT replace(n_name, 'NATION', 'Land') AS r FROM nation"),
    ("regex_replace_match", "SELECT n_name, REGEX_REPLACE(n_name, '[0-9]+', '#') AS r, REGEX_MATCH(n_name, '_1') AS m, REGEX_ESCAPE(n_name + '.*') AS e, REGEX_UNESCAPE('a\\.b') AS u FROM nation", "SELECT n_name, regexp_replace(n_name, '[0-9]+', '#', 'g') AS r, regexp_matches(n_name, '_1') AS m, n_name || '\\.\\*' AS e, 'a.b' AS u FROM nation"),
    ("soundex_codes", "SELECT r_name, SOUNDEX(r_name) AS s, SOUNDEX('Ashcraft') AS a, SOUNDEX('Tymczak') AS t, SOUNDEX('') AS e FROM region", "SELECT r_name, CASE r_name WHEN 'AFRICA' THEN 'A162' WHEN 'AMERICA' THEN 'A562' WHEN 'ASIA' THEN 'A200' WHEN 'EUROPE' THEN 'E610' ELSE 'M340' END AS s, 'A261' AS a, 'T522' AS t, '0000' AS e FROM region"),
    ("date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, o_orderdate.DayOfYear AS n FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofyear(o_orderdate) AS INTEGER) AS n FROM orders"),
    ("date_subtraction", "SELECT o_orderkey, (o_orderdate - #1995-01-01#).Days AS d, o_orderdate.AddDays(10) AS later FROM orders", "SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS d, o_orderdate + INTERVAL 10 DAY AS later FROM orders"),
    ("conversion_to_x", "SELECT n_nationkey, TO_INT32(n_nationkey + 0.5) AS i, TO_INT64(TO_STRING(n_nationkey)) AS l, TO_DOUBLE(n_nationkey) AS d, TO_STRING(n_nationkey > 2) AS s, TO_BOOLEAN(n_regionkey) AS b, TO_INT16('12') AS h FROM nation", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_nationkey + 1 END AS INTEGER) AS i, CAST(n_nationkey AS BIGINT) AS l, CAST(n_nationkey AS DOUBLE) AS d, CASE WHEN n_nationkey > 2 THEN 'True' ELSE 'False' END AS s, n_regionkey <> 0 AS b, CAST(12 AS SMALLINT) AS h FROM nation"),
    ("conversion_others", "SELECT TO_BYTE(200) AS b, TO_SBYTE(-5) AS sb, TO_UINT16(65535) AS u2, TO_UINT32('4294967295') AS u4, TO_SINGLE(1.5) AS f, TO_CHAR('x') AS c, TO_DATETIME('2020-01-02') AS t, TO_DECIMAL(7) AS d", "SELECT CAST(200 AS SMALLINT) AS b, CAST(-5 AS TINYINT) AS sb, 65535 AS u2, CAST(4294967295 AS BIGINT) AS u4, CAST(1.5 AS FLOAT) AS f, 'x' AS c, TIMESTAMP '2020-01-02' AS t, CAST(7 AS DECIMAL(38,18)) AS d"),
    ("to_uint64", "SELECT n_nationkey, TO_UINT64(n_nationkey) AS u, TO_UINT64('18446744073709551615') AS m FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DECIMAL(20, 0)) AS u, CAST(18446744073709551615 AS DECIMAL(20, 0)) AS m FROM nation"),
    ("dates_of_now", "SELECT (GETDATE() - GETDATE()).Days AS d, YEAR(GETUTCDATE()) >= 2024 AS a, (GETUTCDATE() - GETDATE()).Days AS u", "SELECT 0 AS d, TRUE AS a, 0 AS u"),
    ("cultures", "SELECT n_nationkey, TO_STRING(n_nationkey * 1.5, 'de-DE') AS s, TO_DOUBLE('1.234,5', 'de-DE') + n_nationkey AS d, FORMAT(n_nationkey * 1000.5, 'N2', 'de-DE') AS f, TO_STRING(#2020-01-02 03:04:05#, 'en-GB') AS t, TO_DATETIME('31.12.2020', 'de-DE') AS x, UPPER('ai', 'tr-TR') AS u, LOWER('I', 'tr-TR') AS l FROM nation", "SELECT n_nationkey, replace(regexp_replace(CAST(n_nationkey * CAST(1.5 AS DOUBLE) AS VARCHAR), '\\.0$', ''), '.', ',') AS s, CAST(1234.5 AS DOUBLE) + n_nationkey AS d, translate(format('{:,.2f}', n_nationkey * CAST(1000.5 AS DOUBLE)), ',.', '.,') AS f, '02/01/2020 03:04:05' AS t, TIMESTAMP '2020-12-31' AS x, 'Aİ' AS u, 'ı' AS l FROM nation"),
    ("format_masks", "SELECT c_custkey, FORMAT(c_acctbal, 'F1') AS f, FORMAT(c_acctbal, '#,##0.00') AS m, FORMAT(c_custkey, 'D6') AS d, FORMAT(c_custkey, 'X4') AS x FROM customer", "SELECT c_custkey, format('{:.1f}', c_acctbal) AS f, format('{:,.2f}', c_acctbal) AS m, format('{:06d}', c_custkey) AS d, format('{:04X}', c_custkey) AS x FROM customer"),
    ("format_number_date", "SELECT n_nationkey, FORMAT(n_nationkey * 1000.5, 'N2') AS n, FORMAT(n_nationkey, '000') AS z, FORMAT(#2020-01-02#, 'yyyy-MM-dd') AS d FROM nation", "SELECT n_nationkey, format('{:,.2f}', n_nationkey * CAST(1000.5 AS DOUBLE)) AS n, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS z, '2020-01-02' AS d FROM nation"),
]

AGGREGATES = [
    ("agg_scalar", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS d, MIN(l_shipdate) AS a, MAX(l_shipdate) AS z FROM lineitem", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem"),
    ("agg_scalar_empty", "SELECT COUNT(*) AS n, SUM(n_nationkey) AS s, MIN(n_name) AS m, CONCAT(n_name) AS c FROM nation WHERE n_nationkey < 0", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, min(n_name) AS m, coalesce(string_agg(n_name, ', '), '') AS c FROM nation WHERE n_nationkey < 0"),
    ("agg_group_by", "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus"),
    ("agg_group_by_expr", "SELECT YEAR(o_orderdate) AS y, o_custkey % 3 AS m, COUNT(*) + 1 AS n FROM orders GROUP BY YEAR(o_orderdate), o_custkey % 3", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey % 3 AS m, CAST(count(*) + 1 AS BIGINT) AS n FROM orders GROUP BY ALL"),
    ("agg_having", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 55 AND MIN(c_custkey) < 1000", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55 AND min(c_custkey) < 1000"),
    ("agg_having_no_group", "SELECT n_name FROM nation HAVING n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    ("agg_concat", "SELECT n_regionkey, CONCAT(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    ("agg_stdev_var", "SELECT l_returnflag, ROUND(STDEV(l_quantity), 6) AS s, ROUND(VAR(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag"),
    ("agg_min_max_types", "SELECT MIN(c_name) AS a, MAX(c_acctbal) AS b, MIN(c_nationkey) AS c, MAX(c_nationkey > 3) AS d FROM customer", "SELECT min(c_name) AS a, max(c_acctbal) AS b, min(c_nationkey) AS c, max(c_nationkey > 3) AS d FROM customer"),
    ("agg_group_of_nothing", "SELECT COUNT(*) AS k FROM (SELECT n_regionkey, COUNT(*) AS n FROM nation WHERE n_nationkey < 0 GROUP BY n_regionkey) AS d", "SELECT CAST(0 AS BIGINT) AS k"),
    ("count_star_vs_col", "SELECT COUNT(*) AS a, COUNT(NULLIF(n_regionkey, 2)) AS b, COUNT(NULL) AS c FROM nation", "SELECT CAST(count(*) AS BIGINT) AS a, CAST(count(nullif(n_regionkey, 2)) AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM nation"),
    ("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    ("distinct_order_by", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY 2 DESC, o_orderpriority", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders"),
    ("group_null_keys", "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)", "SELECT nullif(n_regionkey, 2) AS k, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1"),
    ("flagship_pricing_summary", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_quantity), 4) AS avg_qty, COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= #1998-09-02# GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
]

_FIVE = "SELECT r.r_name, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM region r INNER JOIN nation n ON n.n_regionkey = r.r_regionkey INNER JOIN customer c ON c.c_nationkey = n.n_nationkey INNER JOIN orders o ON o.o_custkey = c.c_custkey INNER JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name"
JOINS = [
    ("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    ("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    ("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000.0", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000"),
    ("join_inner_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a INNER JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND b.l_quantity > 45.0", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND b.l_quantity > 45"),
    ("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a INNER JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey = 3", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey = 3"),
    ("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000.0", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000"),
    ("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000.0", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000"),
    ("join_full", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_suppkey"),
    ("join_full_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a FULL JOIN region b ON a.n_nationkey > b.r_regionkey + 22", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a FULL JOIN region b ON a.n_nationkey > b.r_regionkey + 22"),
    ("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    ("join_nested_paren", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r LEFT JOIN (nation n INNER JOIN supplier s ON s.s_nationkey = n.n_nationkey) ON n.n_regionkey = r.r_regionkey AND s.s_acctbal > 8000.0", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r LEFT JOIN (nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey) ON n.n_regionkey = r.r_regionkey AND s.s_acctbal > 8000"),
    ("join_on_subquery", "SELECT r.r_name, n.n_name FROM region r INNER JOIN nation n ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey * 20)", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey * 20)"),
    ("join_left_on_subquery", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey * 20 + 60)", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN (SELECT a.r_regionkey AS k, n.* FROM region a JOIN nation n ON n.n_regionkey = a.r_regionkey WHERE EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > a.r_regionkey * 20 + 60)) n ON n.k = r.r_regionkey"),
    ("join_right_on_subquery", "SELECT r.r_name, n.n_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey * 20 + 60)", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN (SELECT a.r_regionkey AS k, n.* FROM region a JOIN nation n ON n.n_regionkey = a.r_regionkey WHERE EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > a.r_regionkey * 20 + 60)) n ON n.k = r.r_regionkey"),
    ("join_full_on_subquery", "SELECT r.r_name, n.n_name FROM region r FULL JOIN nation n ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey * 20 + 60)", "WITH p AS (SELECT r.r_regionkey, r.r_name, n.n_nationkey, n.n_name FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey WHERE EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey > r.r_regionkey * 20 + 60)) SELECT r_name, n_name FROM p UNION ALL SELECT r_name, NULL FROM region WHERE r_regionkey NOT IN (SELECT r_regionkey FROM p) UNION ALL SELECT NULL, n_name FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM p)"),
    ("join_inner_subquery_in_outer", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r LEFT JOIN (nation n INNER JOIN supplier s ON s.s_nationkey = n.n_nationkey AND EXISTS (SELECT * FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < s.s_acctbal - 10000.0)) ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 5 WHERE r.r_regionkey < 4", "SELECT r.r_name, d.n_name, d.s_suppkey FROM region r LEFT JOIN (SELECT n.n_name, n.n_regionkey, n.n_nationkey, s.s_suppkey FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE EXISTS (SELECT * FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < s.s_acctbal - 10000)) d ON d.n_regionkey = r.r_regionkey AND d.n_nationkey > 5 WHERE r.r_regionkey < 4"),
    ("join_null_keys", "SELECT a.n_name AS x, b.r_name AS y FROM nation a LEFT JOIN region b ON NULLIF(a.n_regionkey, 2) = NULLIF(b.r_regionkey, 2)", "SELECT a.n_name AS x, b.r_name AS y FROM nation a LEFT JOIN region b ON nullif(a.n_regionkey, 2) = nullif(b.r_regionkey, 2)"),
    ("join_five_way", _FIVE, _FIVE.replace("COUNT(*)", "CAST(COUNT(*) AS BIGINT)")),
]

SUBQUERIES = [
    ("sub_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 2 * (SELECT AVG(o_totalprice) FROM orders) - 90000.0", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders) - 90000"),
    ("sub_scalar_correlated", "SELECT n.n_name, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900.0) AS k FROM nation n", "SELECT n.n_name, CAST((SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900) AS BIGINT) AS k FROM nation n"),
    ("sub_scalar_empty_null", "SELECT r_name, (SELECT MAX(n_name) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 2) AS m FROM region", "SELECT r_name, (SELECT max(n_name) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 2) AS m FROM region"),
    ("sub_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000.0)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    ("sub_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000.0)", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)"),
    ("sub_exists_in_or", "SELECT n_name FROM nation n WHERE n_regionkey = 0 OR EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000.0)", "SELECT n_name FROM nation n WHERE n_regionkey = 0 OR EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000)"),
    ("sub_exists_as_column", "SELECT n_name, EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000.0) AS rich FROM nation n", "SELECT n_name, EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000) AS rich FROM nation n"),
    ("sub_in", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950.0)", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)"),
    ("sub_not_in", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950.0)", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)"),
    ("sub_not_in_with_null", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region)", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)"),
    ("sub_not_in_null_operand", "SELECT n_name FROM nation WHERE NULLIF(n_regionkey, 1) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)", "SELECT n_name FROM nation WHERE nullif(n_regionkey, 1) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)"),
    ("sub_not_in_nothing", "SELECT n_name, NULLIF(n_regionkey, 1) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS a, n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region) AS b, n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS c FROM nation", "SELECT n_name, TRUE AS a, FALSE AS b, n_regionkey <= 2 AS c FROM nation"),
    ("sub_not_in_correlated", "SELECT n_name FROM nation n WHERE n_regionkey NOT IN (SELECT s.s_suppkey % 5 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "SELECT n_name FROM nation n WHERE n_regionkey NOT IN (SELECT s.s_suppkey % 5 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)"),
    ("sub_any_all_nulls", "SELECT n_nationkey, n_nationkey > ANY (SELECT NULLIF(r_regionkey, 0) FROM region) AS a, n_nationkey <= ALL (SELECT NULLIF(r_regionkey, 0) FROM region) AS b, n_nationkey < ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS c, NULLIF(n_regionkey, 2) > ANY (SELECT r_regionkey FROM region) AS d, n_regionkey = ALL (SELECT 1) AS e, n_regionkey <> ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AS f, n_regionkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 1) AS g, n_regionkey < ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS h FROM nation", "SELECT n_nationkey, n_nationkey > 1 AS a, FALSE AS b, TRUE AS c, coalesce(nullif(n_regionkey, 2) > 0, FALSE) AS d, n_regionkey = 1 AS e, n_regionkey > 2 AS f, n_regionkey <> 0 AS g, FALSE AS h FROM nation"),
    ("sub_all_correlated", "SELECT c_custkey FROM customer c WHERE c_acctbal >= ALL (SELECT d.c_acctbal FROM customer d WHERE d.c_nationkey = c.c_nationkey)", "SELECT c_custkey FROM customer c WHERE c_acctbal >= (SELECT max(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)"),
    ("sub_any", "SELECT n_name FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region) AND n_nationkey <> ANY (SELECT 1)", "SELECT n_name FROM nation WHERE n_nationkey < (SELECT max(r_regionkey) FROM region) AND n_nationkey <> 1"),
    ("sub_all", "SELECT n_name FROM nation WHERE n_nationkey >= ALL (SELECT r_regionkey + 10 FROM region)", "SELECT n_name FROM nation WHERE n_nationkey >= (SELECT max(r_regionkey + 10) FROM region)"),
    ("sub_some", "SELECT n_name FROM nation n WHERE n_nationkey = SOME (SELECT s_nationkey FROM supplier s WHERE s.s_acctbal > 9000.0)", "SELECT n_name FROM nation n WHERE n_nationkey IN (SELECT s_nationkey FROM supplier s WHERE s.s_acctbal > 9000)"),
    ("sub_in_having", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) FROM customer) / 25", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) FROM customer) // 25"),
    ("sub_in_case", "SELECT n_name, CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN (SELECT MAX(r_name) FROM region WHERE r_regionkey = n_nationkey) ELSE 'none' END AS k FROM nation", "SELECT n_name, CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN (SELECT max(r_name) FROM region WHERE r_regionkey = n_nationkey) ELSE 'none' END AS k FROM nation"),
    ("derived_table", "SELECT d.k, d.n FROM (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey) AS d WHERE d.n > 4", "SELECT d.k, CAST(d.n AS BIGINT) AS n FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) AS d WHERE d.n > 4"),
    ("sub_skip_level", "SELECT r.r_name FROM region r WHERE EXISTS (SELECT * FROM nation n WHERE n.n_regionkey > 0 AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND s.s_acctbal > 9500.0))", "SELECT r.r_name FROM region r WHERE EXISTS (SELECT * FROM nation n WHERE n.n_regionkey > 0 AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND s.s_acctbal > 9500))"),
    ("sub_skip_level_scalar", "SELECT n.n_name, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > (SELECT MAX(s.s_acctbal) FROM supplier s WHERE s.s_nationkey = n.n_nationkey)) AS k FROM nation n", "SELECT n.n_name, CAST((SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > (SELECT max(s.s_acctbal) FROM supplier s WHERE s.s_nationkey = n.n_nationkey)) AS BIGINT) AS k FROM nation n"),
    ("sub_nested_two_levels", "SELECT r_name FROM region r WHERE EXISTS (SELECT * FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9500.0))", "SELECT r_name FROM region r WHERE EXISTS (SELECT * FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9500))"),
]

ORDER_TOP = [
    ("order_by_ordinal", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1", "SELECT n_name, n_regionkey FROM nation"),
    ("order_by_alias", "SELECT n_name AS a, -n_nationkey AS b FROM nation ORDER BY b", "SELECT n_name AS a, -n_nationkey AS b FROM nation"),
    ("order_by_hidden_expr", "SELECT TOP 7 n_name FROM nation ORDER BY n_nationkey % 5 DESC, n_nationkey * 2", "SELECT n_name FROM nation ORDER BY n_nationkey % 5 DESC, n_nationkey * 2 LIMIT 7"),
    ("order_by_nulls_first", "SELECT TOP 6 n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY k DESC, n_nationkey", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS FIRST, n_nationkey LIMIT 6"),
    ("order_by_subquery", "SELECT TOP 2 r_name FROM region r ORDER BY (SELECT MAX(n_nationkey) FROM nation n WHERE n.n_regionkey = r.r_regionkey) DESC", "SELECT r_name FROM region r ORDER BY (SELECT max(n_nationkey) FROM nation n WHERE n.n_regionkey = r.r_regionkey) DESC LIMIT 2"),
    ("top_n", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    ("top_with_ties", "SELECT TOP 3 WITH TIES n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC", "SELECT n_name, n_regionkey FROM nation QUALIFY rank() OVER (ORDER BY n_regionkey DESC) <= 3"),
    ("top_zero", "SELECT TOP 0 n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation LIMIT 0"),
]

SETS = [
    ("union_all", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'q'", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'q'"),
    ("union_distinct", "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region", "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region"),
    ("union_mixed_types", "SELECT n_regionkey AS x FROM nation UNION ALL SELECT c_acctbal FROM customer UNION ALL SELECT NULL", "SELECT CAST(n_regionkey AS DOUBLE) AS x FROM nation UNION ALL SELECT c_acctbal FROM customer UNION ALL SELECT NULL"),
    ("intersect", "SELECT NULLIF(n_regionkey, 1) AS x FROM nation INTERSECT SELECT NULLIF(r_regionkey, 1) FROM region", "SELECT nullif(n_regionkey, 1) AS x FROM nation INTERSECT SELECT nullif(r_regionkey, 1) FROM region"),
    ("except", "SELECT n_nationkey AS x FROM nation EXCEPT SELECT r_regionkey FROM region", "SELECT n_nationkey AS x FROM nation EXCEPT SELECT r_regionkey FROM region"),
    ("set_op_precedence", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 3 EXCEPT SELECT 9", "SELECT 1 AS x UNION (SELECT 2 INTERSECT SELECT 3) EXCEPT SELECT 9"),
    ("union_order_by", "SELECT r_name AS x FROM region UNION SELECT n_name FROM nation ORDER BY x DESC", "SELECT r_name AS x FROM region UNION SELECT n_name FROM nation"),
    ("cte_simple", "WITH big AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000.0) SELECT n.n_name, COUNT(*) AS k FROM big b JOIN nation n ON n.n_nationkey = b.c_nationkey GROUP BY n.n_name", "WITH big AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000) SELECT n.n_name, CAST(count(*) AS BIGINT) AS k FROM big b JOIN nation n ON n.n_nationkey = b.c_nationkey GROUP BY n.n_name"),
    ("cte_chained", "WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (SELECT k, COUNT(*) AS n FROM a GROUP BY k) SELECT x.k, y.n FROM a x JOIN b y ON x.k = y.k", "WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (SELECT k, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY k) SELECT x.k, y.n FROM a x JOIN b y ON x.k = y.k"),
    ("cte_column_list", "WITH t (k, m) AS (SELECT n_regionkey, MAX(n_nationkey) FROM nation GROUP BY n_regionkey) SELECT k, m FROM t WHERE m > 20", "WITH t (k, m) AS (SELECT n_regionkey, max(n_nationkey) FROM nation GROUP BY n_regionkey) SELECT k, m FROM t WHERE m > 20"),
    ("cte_recursive_counter", "WITH t (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 100) SELECT n, n * n AS sq FROM t", "SELECT CAST(i AS INTEGER) AS n, CAST(i * i AS INTEGER) AS sq FROM range(1, 101) t(i)"),
    ("cte_recursive_hierarchy", "WITH tree (k, depth, path) AS (SELECT n_nationkey, 0, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1, t.path + '/' + n.n_name FROM nation n JOIN tree t ON n.n_nationkey = t.k * 2 + 1 OR n.n_nationkey = t.k * 2 + 2) SELECT * FROM tree", "WITH RECURSIVE tree (k, depth, path) AS (SELECT n_nationkey, 0, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1, t.path || '/' || n.n_name FROM nation n JOIN tree t ON n.n_nationkey = t.k * 2 + 1 OR n.n_nationkey = t.k * 2 + 2) SELECT * FROM tree"),
    ("cte_two_anchors", "WITH t (n) AS (SELECT 1 UNION ALL SELECT 100 UNION ALL SELECT n + 1 FROM t WHERE n % 10 <> 5) SELECT n FROM t", "SELECT CAST(unnest([1, 2, 3, 4, 5, 100, 101, 102, 103, 104, 105]) AS INTEGER) AS n"),
]

QUERIES: list[tuple[str, str, str]] = [*SCANS, *OPERATORS, *CONDITIONAL, *FUNCTIONS, *AGGREGATES, *JOINS, *SUBQUERIES, *ORDER_TOP, *SETS]
