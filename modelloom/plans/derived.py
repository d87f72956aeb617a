"""Metadata rows made from the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_M = "'MSR_'||lpad(CAST({0} AS STRING),6,'0')"
_m = _M.format

_fact = "'Fact_'||lpad(CAST({0} AS STRING),3,'0')".format
_col = "'Col_'||lpad(CAST({0} AS STRING),2,'0')".format

MEASURES = f"""SELECT p_partkey AS ord, 'Measures' AS tbl, CASE WHEN p_partkey%89=0 THEN {_m('p_partkey-1')} ELSE {_m('p_partkey')} END AS name,
  CASE WHEN p_partkey%97=1 THEN 'SUM ( '||col||' )'||repeat(' + SUM ( '||col||' )',60)
       WHEN p_partkey%97=2 THEN 'CALCULATE ( SUM ( '||col||' ), FILTER ( '||host||', '||col||' > 0 ), ''Date''[Year] = 2024 )'
       WHEN p_partkey%97=3 THEN 'CALCULATE ( CALCULATE ( CALCULATE ( SUM ( '||col||' ), a = 1 ), b = 2 ), FILTER ( '||host||', '||col||' > 0 ), FILTER ( '||host||', '||col||' < 9 ) )'
       WHEN p_partkey%97=4 THEN 'SUM ( ''Sales/Returns''[Amt] ) + ''IF (x)''[a]'
       WHEN p_partkey%97=5 THEN 'TOTALYTD ( SUM ( '||col||' ), ''Date''[Date] ) + dateadd ( ''Date''[Date], -1, YEAR ) -- PREVIOUSYEAR ('
       WHEN p_partkey%97=6 THEN 'SWITCH ( a, 1, SWITCH ( b, 2, SWITCH ( c, 3, SWITCH ( d, 4, 5 ) ) ) )'
       WHEN p_partkey%97=7 THEN 'VAR x = ['||{_m('p_partkey-1')}||']'||repeat(chr(10)||'-- note',27)||chr(10)||'RETURN x'
       WHEN p_partkey%97=8 THEN 'VAR T1 = 1 RETURN T1 + COUNTROWS ( T2 ) + SUM ( ''T3''[Key] ) + ['||{_m('p_partkey-1')}||']'
       WHEN p_partkey%97=9 THEN 'COUNTROWS ( '||host||' ) + COUNTROWS ( T4 )'
       WHEN p_partkey%5=0 AND p_partkey>0 THEN 'DIVIDE ( ['||{_m('p_partkey-1')}||'], COUNTROWS ( '||host||' ) )'
       WHEN p_partkey%7=0 THEN 'CALCULATE ( SUM ( '||col||' ), FILTER ( '||host||', '||col||' > 0 ) )'
       WHEN p_partkey%11=0 THEN '['||{_m('p_partkey-1')}||'] / ['||{_m('p_partkey-2')}||']'
       WHEN p_partkey%13=0 THEN 'SUM ( '||col||' ) -- 50/50'
       WHEN p_partkey%17=0 THEN 'SUM ( '||col||' ) + ['||{_m('p_partkey+100000')}||']'
       WHEN p_partkey%40 BETWEEN 22 AND 34 THEN '['||{_m('p_partkey-1')}||'] + SUM ( '||col||' )'
       WHEN p_partkey%40 IN (37,38) THEN 'IF ( a, 1, IF ( b, 2, IF ( c, 3, IF ( d, 4, IF ( e, 5, 6 ) ) ) ) )'
       WHEN p_partkey%40=36 THEN 'IF ( a, 1 ) + IF ( b, 1 ) + IF ( c, 1 ) + IF ( d, 1 ) + IF ( e, 1 )'
       ELSE 'SUM ( '||col||' )' END AS expression,
  CASE WHEN p_size%4=0 THEN NULL ELSE '#,0.00' END AS format_string, p_partkey%19=0 AS is_hidden,
  CASE WHEN p_size%3=0 THEN ' ' WHEN p_size%3=1 THEN NULL ELSE 'About it' END AS description
FROM (SELECT *, {_fact('p_partkey%30')} AS host, {_fact('p_partkey%30')}||'['||{_col('p_partkey%25')}||']' AS col FROM {{part}}) x"""

_PAGE = "'s'||CAST(CAST(floor(event_id/900.0) AS BIGINT) AS STRING)||'_'||CAST(CAST(floor(sqrt(event_id%900)) AS BIGINT) AS STRING)"
_TYPE = "CASE event_type WHEN 'click' THEN 'slicer' WHEN 'view' THEN 'card' WHEN 'error' THEN 'tableEx' WHEN 'purchase' THEN 'barChart' ELSE 'textbox' END"
_FIELD = _m("CASE WHEN event_id%6=0 THEN (event_id%4)*97+1 WHEN event_id%6=1 THEN 28+event_id%5 ELSE (event_id*14)%((SELECT count(*) FROM {part})+20) END")
VISUALS = f"""SELECT event_id AS ord, {_PAGE} AS page, 'v'||CAST(event_id AS STRING) AS visual_id, {_TYPE} AS type, {_FIELD} AS field,
  CAST((event_id*7)%5*220 AS DOUBLE) AS x, CAST((event_id*3)%8*95 AS DOUBLE) AS y, CAST(180 AS DOUBLE) AS width, CAST(40+event_id%3*25 AS DOUBLE) AS height,
  CASE WHEN event_id%11=0 THEN 'Title '||CAST(event_id AS STRING)||' :' WHEN event_id%11=1 THEN '   ' END AS title,
  CASE WHEN event_id%2=0 THEN 'Caption '||CAST(event_id AS STRING) END AS text FROM {{events}}"""

#: What each visual binds: its measure, and columns for large grids; hierarchies too, which no rule looks up.
REFS = f"""SELECT v.ord AS ord, v.page AS page, v.visual_id AS visual_id, v.type AS type, k AS ref_ord,
  CASE WHEN k=0 AND v.ord%7=0 THEN NULL WHEN k=0 THEN 'Measures' WHEN k=2 AND v.ord%4=0 THEN 'Nowhere' ELSE {_fact('(v.ord+k)%30')} END AS tbl,
  CASE WHEN k=0 THEN v.field ELSE {_col('(v.ord*3+k)%26')} END AS field, CASE WHEN k=0 THEN 'measure' WHEN k=9 THEN 'hierarchy' ELSE 'column' END AS kind
FROM ({VISUALS}) v CROSS JOIN (SELECT r_regionkey*2 AS k FROM {{region}} UNION ALL SELECT r_regionkey*2+1 AS k FROM {{region}}) ks WHERE k=0 OR (v.type='tableEx' AND v.ord%3=0) OR (v.type='barChart' AND k<3)"""

PAGES = f"""SELECT min(ord) AS ord, page, 'Page '||page AS display_name, max(CASE WHEN page LIKE '%7' THEN 1 ELSE 0 END)=1 AS is_hidden FROM ({VISUALS}) v GROUP BY page
UNION ALL SELECT 10000000+r_regionkey AS ord, 'empty_'||CAST(r_regionkey AS STRING) AS page, r_name AS display_name, r_regionkey%2=1 AS is_hidden FROM {{region}}"""

_FROM = "FROM dbo.Orders"
STATEMENTS = f"""SELECT s_suppkey AS ord, CASE s_suppkey%6 WHEN 0 THEN 'Sql.Database' WHEN 1 THEN 'Snowflake.Databases' WHEN 2 THEN 'PostgreSQL.Database' WHEN 3 THEN 'Sql.Databases' WHEN 4 THEN 'GoogleBigQuery.Database' ELSE 'Odbc.Query' END AS connector,
  CASE WHEN s_suppkey%3=0 THEN 'Id,Net Amount' ELSE '' END AS loaded,
  CASE s_suppkey%25 WHEN 0 THEN 'SELECT * {_FROM} WHERE a > 1' WHEN 1 THEN 'SELECT a, b {_FROM} WHERE a > 1 ORDER BY b'
   WHEN 2 THEN 'SELECT a {_FROM} WHERE YEAR(OrderDate) = 2024 AND b = 1' WHEN 3 THEN 'SELECT a {_FROM} WHERE UPPER(name) = ''X''' WHEN 4 THEN 'SELECT a {_FROM} WHERE name LIKE''%x'''
   WHEN 5 THEN 'SELECT DISTINCT a {_FROM} WHERE a > 1 GROUP BY a' WHEN 6 THEN 'SELECT a {_FROM} -- WHERE a > 1' WHEN 7 THEN 'SELECT a {_FROM} WHERE code = ''42'''
   WHEN 8 THEN 'SELECT a {_FROM} WHERE a IN (SELECT b FROM dbo.Other)'
   WHEN 9 THEN 'SELECT a {_FROM} JOIN b ON 1=1 JOIN c ON 1=1 JOIN d ON 1=1 JOIN e ON 1=1 JOIN f ON 1=1 WHERE a > 1'
   WHEN 10 THEN 'SELECT a {_FROM} WITH (NOLOCK) WHERE a > 1' WHEN 11 THEN 'SELECT a FROM (SELECT * {_FROM}) q WHERE a > 1 /* SELECT * */'
   WHEN 12 THEN 'SELECT TOP (10) * {_FROM} ORDER BY a' WHEN 13 THEN 'SELECT a, limits {_FROM} ORDER BY a' WHEN 14 THEN 'SELECT a {_FROM} WHERE a > 1 ORDER BY a OFFSET 5 ROWS FETCH NEXT 5 ROWS ONLY'
   WHEN 15 THEN 'SELECT count(DISTINCT a) {_FROM} WHERE a > 1 GROUP BY b' WHEN 16 THEN 'SELECT a FROM (SELECT a, row_number ( ) OVER (ORDER BY b) AS n {_FROM}) q ORDER BY a'
   WHEN 17 THEN 'SELECT a {_FROM} WHERE year ( t.Day )=20245 OR YEAR(f(x)) = 2024' WHEN 18 THEN 'SELECT a, top {_FROM}' WHEN 19 THEN 'select distinct top 5 *, b {_FROM} where [code] = ''7'' OR x.code=''8'''
   WHEN 20 THEN 'SELECT a, (SELECT max(b) FROM c ORDER BY 1) {_FROM} WHERE a > 1 ORDER BY a' WHEN 21 THEN 'SELECT a {_FROM} WHERE Year( Day ) = 1999'
   WHEN 22 THEN 'SELECT'||repeat(' ',120)||'DISTINCT a {_FROM} /* SELECT DISTINCT a */ WHERE a > 1 GROUP BY a' WHEN 23 THEN '/* SELECT DISTINCT * */ SELECT * {_FROM} WHERE a > 1'
   ELSE 'SELECT a {_FROM} WHERE a > 1 AND note = ''SELECT * ORDER BY --''' END AS statement FROM {{supplier}}"""

RELATIONS = """SELECT n_nationkey AS ord, 'T'||CAST(n_nationkey AS STRING) AS a, 'T'||CAST((n_nationkey*7+3)%25 AS STRING) AS b, CASE WHEN n_nationkey%3=0 THEN 'Other' ELSE 'Key' END AS column_a,
  CASE WHEN n_nationkey%4=1 THEN 'Other' WHEN n_nationkey%4=2 THEN 'Absent' ELSE 'Key' END AS column_b, n_nationkey%2=0 AS from_many,
  n_nationkey%4=0 AS to_many, n_nationkey%5=0 AS both_directions, n_nationkey%7<>3 AS active FROM {nation}"""

_TABLE = "CASE WHEN s_suppkey%23=0 THEN 'LocalDateTable_'||CAST(s_suppkey AS STRING) ELSE 'T'||CAST(s_suppkey AS STRING) END"
TABLES = f"""SELECT s_suppkey AS ord, {_TABLE} AS name, CASE WHEN s_suppkey%4=0 THEN '' WHEN s_suppkey%4=1 THEN NULL ELSE 'About it' END AS description, s_suppkey%9=0 AS is_hidden, CAST(NULL AS STRING) AS data_category FROM {{supplier}}
UNION ALL SELECT 1000000+p_partkey AS ord, {_fact('p_partkey-1')} AS name, 'About it' AS description, false AS is_hidden, 'Fact' AS data_category FROM {{part}} WHERE p_partkey<=30"""
COLUMNS = f"""SELECT s_suppkey AS ord, {_TABLE} AS tbl, CASE WHEN s_suppkey%10=0 THEN {_m('s_suppkey')} ELSE 'Key' END AS name, CASE WHEN s_suppkey%3=1 THEN 'string' ELSE 'int64' END AS data_type,
  CASE WHEN s_suppkey%8=0 THEN 'calculated' ELSE 'data' END AS kind, CASE WHEN s_suppkey%6=0 THEN NULL ELSE s_nationkey*100000 END AS cardinality FROM {{supplier}}
UNION ALL SELECT 500000+s_suppkey AS ord, {_TABLE} AS tbl, 'Other' AS name, CASE WHEN s_suppkey%2=0 THEN 'string' ELSE 'int64' END AS data_type, 'data' AS kind, 100 AS cardinality FROM {{supplier}} WHERE s_suppkey<25
UNION ALL SELECT 1000000+p.p_partkey*100+c.p_partkey AS ord, {_fact('p.p_partkey-1')} AS tbl, {_col('c.p_partkey-1')} AS name, 'decimal' AS data_type, 'data' AS kind, NULL AS cardinality
  FROM (SELECT p_partkey FROM {{part}} WHERE p_partkey<=30) p CROSS JOIN (SELECT p_partkey FROM {{part}} WHERE p_partkey<=24) c"""

#: A table's partitions: native statements and folded sources, with their steps; tables whose numbers differ by 42 read one object.
_OBJ = "CASE WHEN c=6 THEN 'dbo.T6' ELSE 'dbo.Obj'||CAST(c AS STRING) END"
PARTITIONS = f"""SELECT s_suppkey AS ord, {_TABLE} AS tbl, 'p'||CAST(s_suppkey AS STRING) AS name, CASE WHEN s_suppkey%53=4 THEN 'calculated' ELSE 'm' END AS source_type,
  CASE WHEN c%5<2 THEN 'Sql.Database' WHEN c%5<4 THEN 'PostgreSQL.Database' ELSE 'Odbc.DataSource' END AS connector, 'Srv'||CAST(c%2 AS STRING) AS server, 'Db' AS db, CASE WHEN c%10=9 THEN NULL ELSE {_OBJ} END AS object,
  CASE WHEN c%7=5 AND k%2=1 THEN 'let s = Source, t = Table.SelectRows(s, each true), u = Table.TransformColumnTypes(t, x) in Table.Distinct(u)' ELSE 'let s = Source in Table.TransformColumnTypes(s, x)' END AS script,
  CASE WHEN c%7=1 AND k%2=1 THEN 'SELECT [A], t.D FROM '||{_OBJ} WHEN c%7=1 THEN 'select distinct top (5) A, coalesce(B, 0), "C" from '||{_OBJ} WHEN c%7=2 AND k%2=1 THEN 'SELECT A FROM '||{_OBJ}||' WHERE  A > 1 /* B */ ORDER BY A'
   WHEN c%7=2 THEN 'SELECT A FROM '||{_OBJ}||' -- WHERE a' WHEN c%7=3 AND k%2=1 THEN 'SELECT A, sum(B) FROM '||{_OBJ}||' GROUP BY A' WHEN c%7=3 THEN 'SELECT DISTINCT A FROM '||{_OBJ} WHEN c%7=4 THEN 'SELECT * FROM '||{_OBJ}
   WHEN c%13=11 THEN 'SELECT A FROM '||{_OBJ}||' o JOIN y ON 1=1' WHEN c%13=12 THEN 'SELECT A FROM [dbo].x' WHEN k%2=1 THEN 'SELECT B, a FROM '||{_OBJ}||' WHERE x = ''WHERE'' ' ELSE 'SELECT A, B FROM '||{_OBJ}||' WHERE X = ''other'' ' END AS statement
FROM (SELECT *, s_suppkey%42 AS c, CAST(floor(s_suppkey/42.0) AS BIGINT) AS k FROM {{supplier}}) x"""

#: Edits, a session (file) for each customer: renames that meet each other, moves of measures and descriptions.
_B = "o_custkey%300"
_NAMES = f"CASE o_orderkey%7 WHEN 2 THEN {_m(_B + '+2')} WHEN 3 THEN 'New A' WHEN 4 THEN 'New A' WHEN 5 THEN 'New B' WHEN 6 THEN {_m(_B + '+3')} ELSE {_m(_B + '+1')} END"
_TABLES = f"CASE o_orderkey%5 WHEN 0 THEN 'New T' WHEN 1 THEN 'T'||CAST(o_custkey%60 AS STRING) WHEN 2 THEN 'New U' ELSE {_fact(_B + '%30')} END"
CHANGES = f"""SELECT o_orderkey AS seq, 'c'||CAST(o_orderkey AS STRING) AS change_id, o_custkey AS file, target_type,
  CASE target_type WHEN 'measure' THEN CASE WHEN o_orderkey%11=0 THEN 'T'||CAST(o_custkey%60 AS STRING) ELSE 'Measures' END ELSE {_TABLES} END AS tbl,
  CASE target_type WHEN 'measure' THEN {_NAMES} WHEN 'table' THEN {_TABLES} ELSE CASE o_orderkey%3 WHEN 0 THEN 'New C' WHEN 1 THEN {_col(_B + '%25')} ELSE 'Key' END END AS name,
  CASE WHEN o_orderkey%13=0 THEN 'description' WHEN target_type='measure' AND o_orderkey%13<3 THEN 'homeTable' ELSE 'name' END AS field,
  CASE WHEN o_orderkey%13=0 THEN 'About it' WHEN target_type='measure' AND o_orderkey%13<3 THEN 'T'||CAST(o_custkey%60 AS STRING)
       WHEN target_type='measure' THEN CASE o_orderkey%5 WHEN 1 THEN 'New B' WHEN 2 THEN {_m(_B + '+1')} WHEN 3 THEN 'New '||CAST(o_orderkey AS STRING) ELSE 'New A' END
       WHEN target_type='table' THEN CASE o_orderkey%4 WHEN 0 THEN 'New T' WHEN 1 THEN 'New U' WHEN 2 THEN {_fact(_B + '%30')} ELSE 'Sales '||CAST(o_orderkey AS STRING) END
       ELSE CASE o_orderkey%4 WHEN 0 THEN 'New C' WHEN 1 THEN 'Other' WHEN 2 THEN {_col(_B + '%25')} ELSE 'Col '||CAST(o_orderkey AS STRING) END END AS after
FROM (SELECT *, CASE WHEN o_orderkey%10<4 THEN 'measure' WHEN o_orderkey%10<6 THEN 'table' ELSE 'column' END AS target_type FROM {{orders}}) o"""

#: Parts of project files: names of many kinds, documents with a model, other JSON and text that is none.
PARTS = """SELECT CAST(floor(c_custkey/5.0) AS BIGINT) AS file, c_custkey%5 AS place,
  CASE c_custkey%5 WHEN 0 THEN 'Version' WHEN 1 THEN CASE CAST(floor(c_custkey/5.0) AS BIGINT)%6 WHEN 0 THEN 'DataModelSchema' WHEN 1 THEN '/datamodelschema' WHEN 2 THEN 'Sales.SemanticModel/model.bim' WHEN 3 THEN 'Sales.SemanticModel/definition/t.tmdl' WHEN 4 THEN 'DataModel' ELSE 'other.txt' END
   WHEN 2 THEN CASE WHEN c_custkey%4=0 THEN 'Report/layout' WHEN c_custkey%4=1 THEN 'Sales.Report/report.json' ELSE 'Report/Layout' END WHEN 3 THEN CASE WHEN c_custkey%7=0 THEN 'report.json' ELSE 'Settings' END ELSE CASE WHEN c_custkey%9=0 THEN 'DataModel' ELSE 'Metadata' END END AS part,
  CASE WHEN c_custkey%5=1 AND c_custkey%4=0 THEN '{{"tables":[{{"name":"T'||CAST(c_custkey AS STRING)||'","columns":[{{"name":"Key","dataType":"int64","isKey":true}},{{"name":"X"}}],"measures":[{{"name":"M","expression":["SUM (","  Über )"]}}]}}]}}'
   WHEN c_custkey%5=1 THEN '{{"model":{{"culture":"en","tables":[{{"name":"A","columns":[{{"name":"C'||CAST(c_custkey%3 AS STRING)||'","dataType":"string"}}],"measures":[{{"name":"N'||CAST(c_custkey AS STRING)||'","expression":"1 + 2","isHidden":true}},{{"name":"O","expression":"'||CASE WHEN c_custkey%3=0 THEN '[2024]' ELSE '[N]' END||'","formatString":"0"}}]}},{{"name":"B","isHidden":true,"columns":[]}}]}}}}'
   WHEN c_custkey%5=0 THEN 'v1.'||CAST(c_custkey AS STRING)||' {{' WHEN c_custkey%5=2 THEN '{{"sections":[{{"name":"p'||CAST(c_custkey AS STRING)||'"}}]}}' ELSE '{{"a":'||CAST(c_custkey AS STRING)||'}}' END AS doc FROM {customer}"""

#: The model as a faulty export holds it: rows lost, changed and added, expressions laid out in another way.
X_TABLES = f"SELECT ord, name, CASE WHEN ord%19=0 THEN 'Changed' ELSE description END AS description, is_hidden FROM ({TABLES}) t WHERE ord%17<>0 UNION ALL SELECT -1, 'Added', 'By hand', false"
X_COLUMNS = f"SELECT ord, tbl, name, CASE WHEN ord%19=0 THEN 'other' ELSE data_type END AS data_type, kind FROM ({COLUMNS}) t WHERE ord%17<>0"
X_MEASURES = f"SELECT ord, tbl, name, CASE WHEN ord%19=0 THEN expression||' + 0' ELSE replace(expression, ' ', '   ') END AS expression, format_string FROM ({MEASURES}) t WHERE ord%17<>0 UNION ALL SELECT -1, 'Measures', 'Added', '1', NULL"
X_RELATIONS = f"SELECT ord, a, b, column_a, column_b, from_many, to_many, both_directions, CASE WHEN ord%19=2 THEN NOT active ELSE active END AS active FROM ({RELATIONS}) t WHERE ord%17<>0"
X_PARTITIONS = f"SELECT ord, tbl, name, source_type, CASE WHEN ord%19=3 THEN statement||' WHERE 1=0' ELSE statement END AS statement FROM ({PARTITIONS}) t WHERE ord%17<>0"
X_PAGES = f"SELECT ord, page, CASE WHEN ord%19=1 THEN 'Renamed' ELSE display_name END AS display_name, is_hidden FROM ({PAGES}) t WHERE ord%17<>0"
X_VISUALS = f"SELECT ord, page, visual_id, CASE WHEN ord%19=4 THEN 'shape' ELSE type END AS type, title FROM ({VISUALS}) t WHERE ord%17<>0"
X_REFS = f"SELECT ord, page, visual_id, ref_ord, tbl, CASE WHEN ord%19=5 THEN 'Gone' ELSE field END AS field, kind FROM ({REFS}) t WHERE ord%17<>0"

VIEWS = {
    "dv_measures": (MEASURES, ("part",)), "dv_visuals": (VISUALS, ("part", "events")), "dv_refs": (REFS, ("part", "events", "region")), "dv_pages": (PAGES, ("part", "events", "region")),
    "dv_statements": (STATEMENTS, ("supplier",)), "dv_relations": (RELATIONS, ("nation",)), "dv_tables": (TABLES, ("supplier", "part")), "dv_columns": (COLUMNS, ("supplier", "part")),
    "dv_partitions": (PARTITIONS, ("supplier",)), "dv_changes": (CHANGES, ("orders",)), "dv_parts": (PARTS, ("customer",)),
    "dx_tables": (X_TABLES, ("supplier", "part")), "dx_columns": (X_COLUMNS, ("supplier", "part")), "dx_measures": (X_MEASURES, ("part",)), "dx_relations": (X_RELATIONS, ("nation",)), "dx_partitions": (X_PARTITIONS, ("supplier",)),
    "dx_pages": (X_PAGES, ("part", "events", "region")), "dx_visuals": (X_VISUALS, ("part", "events")), "dx_refs": (X_REFS, ("part", "events", "region")),
}


#: Views with a row for each part, event, order or customer. Their columns are made from a few keys, so a plan takes them for much smaller than
#: they are and would send them through the driver to every task.
LONG = {f"{p}_{x}" for p in ("dv", "dx") for x in ("measures", "visuals", "refs", "pages")} | {"dv_changes", "dv_parts"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; parts, from whose few bytes long texts are made, are dealt to all cores where their files make fewer tasks."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, "p_partkey") if table == "part" and rows.rdd.getNumPartitions() < cores else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = VIEWS[name]
    rows = spark.sql(text, **{t: _read(spark, sf_dir, t) for t in tables})
    return rows.hint("merge") if name in LONG else rows


def duck(name: str) -> str:
    text, tables = VIEWS[name]
    return text.format(**{t: t for t in tables})
