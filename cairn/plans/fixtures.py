"""Field data derived from the given tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TYPES = """case event_id%3
  when 0 then case event_type when 'click' then 'stone' when 'view' then 'large_boulder' when 'error' then 'pit' when 'signup' then '' else 'path' end
  when 1 then case event_type when 'click' then 'path' when 'view' then 'stream' when 'error' then 'cliff' when 'signup' then null else 'dense' end
  else case event_type when 'click' then 'dense_forest' when 'view' then 'open' when 'error' then 'lake' when 'signup' then 'marsh' else 'nonsense' end end"""
_LAT, _LNG = "59e0+((event_id*7919)%10000)/10000e0*0.5e0", "17.5e0+((event_id*104729)%10000)/10000e0"

#: Text by name; {t} stands for table t, {_name} for another of these.
SQL = {
    "fixes": f"""select user_id device_id, ts received_at, event_id seq, value accuracy, {_LAT} lat, {_LNG} lng,
        case when event_id%4=0 then null else ((event_id*31)%2000)/10e0 end altitude, case when event_id%5=0 then 'manual' else 'gps' end source from {{events}}""",
    "objects": f"""select cast(event_id as string) id, cast(user_id as string) contributor_id, ts created_at,
        case event_id%3 when 0 then 'point' when 1 then 'line' else 'area' end category, {_TYPES} object_type, {_LAT} lat, {_LNG} lng, value accuracy from {{events}}""",
    "workspaces": """select s_suppkey workspace_id, s_name name, case s_suppkey%3 when 0 then 7500 when 1 then 10000 else 15000 end scale,
        case s_suppkey%2 when 0 then 2.5e0 else 5e0 end contour_interval, case s_suppkey%3 when 0 then 2 when 1 then 5 else 10 end size_km,
        case s_suppkey%4 when 0 then null when 1 then 'digital' else 'print' end symbol_display_mode,
        59e0+((s_suppkey*37)%100)/200e0 center_lat, 17.5e0+((s_suppkey*53)%100)/100e0 center_lng from {supplier}""",
    "bounds": """select workspace_id, size_km, contour_interval, center_lat-size_km/2e0/111.32e0 south, center_lat+size_km/2e0/111.32e0 north,
        center_lng-size_km/2e0/(111.32e0*cos(center_lat*pi()/180e0)) west, center_lng+size_km/2e0/(111.32e0*cos(center_lat*pi()/180e0)) east from ({_workspaces}) w""",
    "roads": """select concat('f',p_partkey) id, p_partkey ordinal, case when p_partkey%50=0 then null else concat('way/',p_partkey) end source_id,
        case when p_partkey%7=0 then null else cast(502+p_size%6 as string) end automatic_isom_symbol,
        case p_size%6 when 0 then 'wide_road' when 1 then 'road' when 2 then 'vehicle_track' when 3 then 'wide_path' when 4 then 'path' else 'faint_path' end automatic_road_type,
        cast(502+p_size%6 as string) isom_symbol,
        case p_size%6 when 0 then 'wide_road' when 1 then 'road' when 2 then 'vehicle_track' when 3 then 'wide_path' when 4 then 'path' else 'faint_path' end road_type,
        case p_partkey%5 when 0 then null when 1 then '' else p_name end name,
        case p_partkey%4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else null end classification_confidence,
        p_partkey, p_size from {part}""",
    "previous": """select id, ordinal, source_id, case p_partkey%4 when 0 then null when 1 then 'locally-approved' when 2 then 'locally-rejected' else 'locally-edited' end status,
        case when p_partkey%4=0 then null else timestamp '2024-01-01 00:00:00' end reviewed_at, cast(502+(p_size+1)%6 as string) isom_symbol, 'edited' road_type from ({_roads}) r where p_partkey%10<>7""",
    "following": """select id, source_id, case when p_partkey%3=0 then '' else null end status, cast(null as timestamp) reviewed_at, isom_symbol, road_type from ({_roads}) r where p_partkey%10<>3""",
    "review_events": """select event_id, ts, concat('f',event_id%200) feature_id,
        case event_type when 'click' then 'approved' when 'error' then 'rejected' when 'view' then 'change' when 'signup' then 'reset' else 'change' end action,
        case when event_type in ('view','purchase') then cast(500+(event_id%9) as string) end symbol from {events}""",
    "actions": """select user_id device_id, ts, event_id seq, case event_type when 'signup' then 'begin' when 'purchase' then 'finish'
        when 'error' then case when event_id%10=0 then 'cancel' else 'undo' end when 'view' then case when event_id%20=1 then 'stop_gps' else 'point' end else 'fix' end action,
        case when event_id%2=0 then 'line' else 'area' end category, value accuracy from {events}""",
    "grid": """select distinct cast(o_orderkey%100 as bigint) x, cast(floor(o_orderkey/100e0) as bigint) y from {orders}""",
    "elevation": """select x, y, 100e0+(3*x*x+5*y*y-4*x*y)/256e0 z from ({_grid}) g""",
    "ground": """select x, y, 100.013e0+(u*u+v*v-u*v/2e0)/40e0 z from (select x, y, abs(x%60-30) u, abs(y%80-40) v from ({_grid}) g) w""",
    "sheets": """select workspace_id, contour_interval, case workspace_id%3 when 0 then 'detailed' when 1 then 'normal' else 'soft' end generalization, w/57334e0+17.5e0 west, s/111320e0+59e0 south,
        (w+20e0+(workspace_id%5)*7.37e0)/57334e0+17.5e0 east, (s+15e0+(workspace_id%4)*6.43e0)/111320e0+59e0 north
        from (select s_suppkey workspace_id, case s_suppkey%2 when 0 then 2.5e0 else 5e0 end contour_interval, (s_suppkey*37)%240+3.31e0 w, s_suppkey*4.1e0+1.17e0 s from {supplier}) q""",
    "shapes": """select c_custkey id, c_custkey%2=0 is_area, 59e0+((c_custkey*7919)%10000)/20000e0 lat, 17.5e0+((c_custkey*104729)%10000)/10000e0 lng, (c_custkey%7)/100e0 w, (c_custkey%5)/100e0 h from {customer}""",
}


def _expanded(name: str, relation) -> str:
    text = SQL[name]
    for other in SQL:
        if f"{{_{other}}}" in text:
            text = text.replace(f"{{_{other}}}", _expanded(other, relation))
    for t in ("events", "supplier", "part", "orders", "customer"):
        text = text.replace(f"{{{t}}}", relation(t))
    return text


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_expanded(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def duck(sql: str) -> str:
    """SQL for DuckDB, with the derived tables that it names as common table expressions."""
    used = [n for n in SQL if f" {n} " in f" {' '.join(sql.replace('(', ' ').replace(')', ' ').replace(',', ' ').split())} "]
    ctes = ",\n".join(f"{n} as ({_expanded(n, lambda t: t)})" for n in used)
    body = sql.strip()
    if not ctes:
        return body
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"
