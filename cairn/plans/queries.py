"""Registered queries of the field-map operators, each with the SQL that it's held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import catalog as fixed
from cairn.functions import geometry, gps, text
from cairn.operators import objects, portrayal, recorder, refresh, reviews, spatial, workspaces
from cairn.plans.fixtures import derived, duck
from cairn.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for DuckDB (tables and derived tables by name)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(quote, r))})" for r in rows)


_CATALOG = f"(values {_values([(c, *r) for c, g in fixed.CATALOG.items() for r in g])}) cat(c, t, s, l)"
_ALIASES = f"(values {_values(list(fixed.ALIASES.items()))}) al(a, b)"
_ROADS = f"(values {_values([(k, *v) for k, v in fixed.ROAD_TYPES.items()])}) rt(s, t, l)"
_QUALITY = "case when accuracy <= 3 then 'excellent' when accuracy <= 10 then 'good' when accuracy <= 50 then 'warn' else 'bad' end"
_US = "unix_micros(cast({} as timestamp))"


def _objects(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "objects")


def _boxed(spark, sf_dir) -> DataFrame:
    w = derived(spark, sf_dir, "workspaces").withColumn("center", F.struct(F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng")))
    return workspaces.workspace_bounds(w)


def objects_per_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: GPS points, classified, gated and typed, placed in all workspaces over them and counted."""
    found = _objects(spark, sf_dir).withColumn("source", F.lit("gps")).withColumn("quality", gps.gps_quality(F.col("accuracy")))
    typed = objects.normalize_objects(objects.accept_points(found))
    return spatial.counts_in_workspaces(typed.select("category", "lng", "lat"), _boxed(spark, sf_dir), "category")


query("""select b.workspace_id, o.category, count(*) n_objects from objects o join bounds b on o.lng between b.west and b.east and o.lat between b.south and b.north
    where accuracy <= 50 group by all""")(objects_per_workspace)


@query(f"select seq, {_QUALITY} quality, cast(floor(accuracy + 0.5) as bigint) metres from fixes")
def gps_quality(spark, sf_dir):
    return derived(spark, sf_dir, "fixes").select("seq", gps.gps_quality(F.col("accuracy")).alias("quality"), text.metres(F.col("accuracy")).alias("metres"))


@query("select seq from fixes where not coalesce(source = 'gps' and accuracy > 50, false)")
def accept_points(spark, sf_dir):
    return objects.accept_points(derived(spark, sf_dir, "fixes")).select("seq")


@query("select seq from fixes where accuracy <= 50")
def accept_fixes(spark, sf_dir):
    return objects.accept_fixes(derived(spark, sf_dir, "fixes")).select("seq")


_NAMED = f"select o.id, o.category, o.contributor_id, coalesce(al.b, nullif(o.object_type, '')) t from objects o left join {_ALIASES} on nullif(o.object_type, '') = al.a"


@query(f"""select n.id, n.category, coalesce(cat.t, case n.category when 'point' then 'boulder' when 'line' then 'path' else 'dense' end) object_type,
    n.id observation_id, n.contributor_id, 'local' sync_status, 1 version from ({_NAMED}) n left join {_CATALOG} on n.category = cat.c and n.t = cat.t""")
def normalize_objects(spark, sf_dir):
    return objects.normalize_objects(_objects(spark, sf_dir)).select("id", "category", "object_type", "observation_id", "contributor_id", "sync_status", "version")


@query(f"select o.id, coalesce(cat.s, '') symbol, coalesce(cat.l, o.object_type) label from objects o left join {_CATALOG} on o.category = cat.c and o.object_type = cat.t")
def catalog_lookup(spark, sf_dir):
    return objects.catalog_lookup(_objects(spark, sf_dir)).select("id", F.col("catalog_symbol").alias("symbol"), "label")


@query(f"select id from objects o where not exists (select 1 from {_CATALOG} where o.category = cat.c and o.object_type = cat.t)")
def unknown_types(spark, sf_dir):
    return objects.unknown_types(_objects(spark, sf_dir)).select("id")


@query(f"select id from objects o where exists (select 1 from {_CATALOG} where o.category = cat.c and o.object_type = cat.t)")
def known_types(spark, sf_dir):
    return objects.known_types(_objects(spark, sf_dir)).select("id")


@query("select id from objects where id not in (select cast(event_id as string) from review_events where action = 'rejected')")
def delete_objects(spark, sf_dir):
    gone = derived(spark, sf_dir, "review_events").where("action = 'rejected'").select(F.col("event_id").cast("string").alias("id"))
    return objects.delete_objects(_objects(spark, sf_dir), gone).select("id")


@query("select id, category, case when category = 'point' then accuracy end accuracy from objects")
def all_objects(spark, sf_dir):
    o = _objects(spark, sf_dir).select("id", "category", "accuracy")
    return objects.all_objects(o.where("category = 'point'"), o.where("category = 'line'").drop("accuracy"), o.where("category = 'area'").drop("accuracy"))


@query("select contributor_id, category, count(*) n_objects from objects group by all")
def object_counts(spark, sf_dir):
    return objects.object_counts(_objects(spark, sf_dir), "contributor_id", "category")


_LOG = """select seq, cast((seq * 7919) % greatest(n, 1) as string) id, case when seq % 97 = 0 then 'delete' when seq % 3 = 0 then 'move_vertex' else 'move' end action,
    cast(seq % 2 as int) idx, lng, lat from fixes, (select max(seq) + 1 n from fixes) m"""


@query(f"""with log as ({_LOG}), pt as (select cast(seq as string) id, case when seq % 2 = 0 then 'point' else 'line' end category, lng, lat from fixes),
    v as (select id, category, 0 idx, lng, lat from pt union all select id, category, 1, lng + 1, lat + 1 from pt where category = 'line'),
    mv as (select id, arg_max(lng, seq) lng, arg_max(lat, seq) lat from log where action = 'move' group by id),
    mx as (select id, idx, arg_max(lng, seq) lng, arg_max(lat, seq) lat from log where action = 'move_vertex' group by id, idx)
    select v.id, v.idx, case when v.category = 'point' and mv.id is not null then mv.lng when mx.id is not null then mx.lng else v.lng end lng,
    case when v.category = 'point' and mv.id is not null then mv.lat when mx.id is not null then mx.lat else v.lat end lat,
    case when v.category = 'point' and mv.id is not null then 'manual-adjustment' else 'gps' end source
    from v left join mv on v.id = mv.id left join mx on v.id = mx.id and v.idx = mx.idx where v.id not in (select id from log where action = 'delete')""")
def current_objects(spark, sf_dir):
    """An object a fix, and an edit a fix that is about another one's object."""
    fixes = derived(spark, sf_dir, "fixes")
    last = fixes.agg((F.max("seq") + 1).alias("n"))
    log = fixes.crossJoin(F.broadcast(last)).select(F.col("seq").alias("ts"), "seq", F.expr("cast((seq * 7919) % greatest(n, 1) as string)").alias("id"), F.expr("case when seq % 97 = 0 then 'delete' when seq % 3 = 0 then 'move_vertex' else 'move' end").alias("action"), F.expr("cast(seq % 2 as int)").alias("index"), "lng", "lat")
    vertex = lambda d: F.struct((F.col("lng") + d).alias("lng"), (F.col("lat") + d).alias("lat"), F.col("accuracy"), F.lit(0).cast("long").alias("time"), F.lit(None).cast("double").alias("altitude"), F.lit(None).cast("double").alias("altitude_accuracy"))
    some = fixes.select(F.col("seq").cast("string").alias("id"), F.expr("case when seq % 2 = 0 then 'point' else 'line' end").alias("category"), F.lit("gps").alias("source"), "lng", "lat", "accuracy")
    start = some.withColumn("coordinates", F.when(F.col("category") == "point", F.array(vertex(0))).otherwise(F.array(vertex(0), vertex(1)))).drop("lng", "lat", "accuracy")
    now = objects.current_objects(start, log)
    return now.select("id", "source", F.posexplode("coordinates").alias("idx", "v")).select("id", "idx", "v.lng", "v.lat", "source")


@query("""select seq, coalesce(gap_us > 15000000, false) lost, cast(sum(case when gap_us > 15000000 then 1 else 0 end) over (partition by device_id order by received_at, seq) as bigint) run
    from (select *, epoch_us(received_at) - epoch_us(lag(received_at) over (partition by device_id order by received_at, seq)) gap_us from fixes) f""")
def gps_gaps(spark, sf_dir):
    return objects.gps_gaps(derived(spark, sf_dir, "fixes")).select("seq", "lost", "run")


def _shapes(spark, sf_dir) -> DataFrame:
    """A shape a device and day, of all fixes that may be vertices: so a device's history is no one array."""
    fixes = objects.accept_fixes(derived(spark, sf_dir, "fixes"))
    day = F.floor(F.expr(_US.format("received_at")) / 86_400_000_000).cast("long").alias("day_no")
    vertices = fixes.select("device_id", day, "seq", "lng", "lat", "accuracy", F.expr(_US.format("received_at")).alias("time"), "altitude", F.lit(None).cast("double").alias("altitude_accuracy"))
    return recorder.build_shapes(vertices, "device_id", "day_no")


_ACCEPTED = "(select *, epoch_us(received_at) // 86400000000 as day_no from fixes where accuracy <= 50) a"


@query(f"select device_id, day_no, count(*) n, arg_min(lng, seq) first_lng, arg_max(lng, seq) last_lng from {_ACCEPTED} group by device_id, day_no")
def build_shapes(spark, sf_dir):
    c = F.col("coordinates")
    return _shapes(spark, sf_dir).select("device_id", "day_no", F.size(c).cast("long").alias("n"), F.element_at(c, 1)["lng"].alias("first_lng"), F.element_at(c, -1)["lng"].alias("last_lng"))


@query(f"select device_id, day_no, count(*) n from {_ACCEPTED} group by device_id, day_no having count(*) >= case when device_id % 2 = 0 then 3 else 2 end")
def complete_shapes(spark, sf_dir):
    shapes = _shapes(spark, sf_dir).withColumn("category", F.expr("case when device_id % 2 = 0 then 'area' else 'line' end"))
    return objects.complete_shapes(shapes).select("device_id", "day_no", F.size("coordinates").cast("long").alias("n"))


@query(f"select device_id || '/' || day_no id, row_number() over (partition by device_id, day_no order by seq) - 1 ordinal, accuracy, altitude from {_ACCEPTED}")
def vertex_samples(spark, sf_dir):
    found = objects.vertex_samples(_shapes(spark, sf_dir).withColumn("id", F.concat_ws("/", "device_id", "day_no")))
    return found.select("id", F.col("ordinal").cast("long").alias("ordinal"), "accuracy", "altitude")


@query("select workspace_id, round(west, 6) west, round(south, 6) south, round(east, 6) east, round(north, 6) north from bounds")
def workspace_bounds(spark, sf_dir):
    return _boxed(spark, sf_dir).select("workspace_id", *[F.round(f"bbox.{c}", 6).alias(c) for c in ("west", "south", "east", "north")])


@query("""select workspace_id, concat_ws(',', case when trim(name2) = '' then 'name missing' end, case when length(trim(name2)) > 60 then 'name too long' end, case when scale2 = 5000 then 'scale' end,
    case when size2 = 3 then 'size' end, case when mode2 = 'paper' then 'symbol mode' end, case when workspace_id % 9 = 0 then 'center' end) problems
    from (select *, case when workspace_id % 8 = 0 then '  ' when workspace_id % 8 = 1 then repeat(name, 4) else name end name2, case when workspace_id % 7 = 0 then 5000 else scale end scale2,
    case when workspace_id % 5 = 0 then 3 else size_km end size2, case when workspace_id % 6 = 0 then 'paper' else symbol_display_mode end mode2 from workspaces) w""")
def validate_workspaces(spark, sf_dir):
    w = derived(spark, sf_dir, "workspaces")
    bad = w.withColumns({
        "name": F.expr("case when workspace_id % 8 = 0 then '  ' when workspace_id % 8 = 1 then repeat(name, 4) else name end"),
        "scale": F.expr("case when workspace_id % 7 = 0 then 5000 else scale end"),
        "size_km": F.expr("case when workspace_id % 5 = 0 then 3 else size_km end"),
        "symbol_display_mode": F.expr("case when workspace_id % 6 = 0 then 'paper' else symbol_display_mode end"),
        "center": F.expr("case when workspace_id % 9 = 0 then null else struct(center_lat as lat, center_lng as lng) end"),
        "standard": F.lit(workspaces.STANDARD),
    })
    return workspaces.validate_workspaces(bad).select("workspace_id", F.concat_ws(",", "problems").alias("problems"))


@query("select workspace_id, row_number() over (order by touched desc, workspace_id) pos from (select workspace_id, (workspace_id * 37) % 11 touched from workspaces) w qualify pos <= 20")
def recent_workspaces(spark, sf_dir):
    w = derived(spark, sf_dir, "workspaces").select(F.col("workspace_id").alias("id"), F.expr("(workspace_id * 37) % 11").alias("updated_at"))
    top = workspaces.recent_workspaces(w, 20)
    order = Window.orderBy(F.desc("updated_at"), "id")  # twenty rows
    return top.select(F.col("id").alias("workspace_id"), F.row_number().over(order).cast("long").alias("pos"))


@query("select w.workspace_id, greatest(epoch_us(timestamp '2024-01-10 00:00:00'), coalesce(max(epoch_us(f.received_at)), 0)) updated_us from workspaces w left join fixes f on f.device_id = w.workspace_id group by w.workspace_id")
def touch_workspaces(spark, sf_dir):
    w = derived(spark, sf_dir, "workspaces").select(F.col("workspace_id").alias("id"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("updated_at"))
    opens = derived(spark, sf_dir, "fixes").select(F.col("device_id").alias("id"), F.col("received_at").cast("timestamp").alias("ts"))
    return workspaces.touch_workspaces(w, opens).select(F.col("id").alias("workspace_id"), F.unix_micros("updated_at").alias("updated_us"))


@query("""with l as (select device_id user_id, arg_max(lat, row(received_at, seq)) lat, arg_max(lng, row(received_at, seq)) lng, arg_max(seq % 40, row(received_at, seq)) workspace_id from fixes group by device_id),
    q as (select c_custkey user_id, case when c_custkey % 7 <> 0 then 60.5e0 end qlat, 18.5e0 qlng from customer where c_custkey % 3 = 0)
    select user_id, l.lat, l.lng, coalesce(w.lat, case when qlat is not null then qlat end, l.lat, 59.3293) open_lat, coalesce(w.lng, case when qlat is not null then qlng end, l.lng, 18.0686) open_lng
    from l full join q using (user_id) left join (select workspace_id, center_lat lat, center_lng lng from workspaces where workspace_id % 2 = 0) w on w.workspace_id = l.workspace_id""")
def latest_center(spark, sf_dir):
    """Users with and without moves, addresses (some without a latitude) and workspaces (some without a centre)."""
    moves = derived(spark, sf_dir, "fixes").select(F.col("device_id").alias("user_id"), F.col("received_at").alias("ts"), "seq", "lat", "lng", F.expr("seq % 40").alias("workspace_id"))
    w = derived(spark, sf_dir, "workspaces").selectExpr("workspace_id id", "case when workspace_id % 2 = 0 then struct(center_lat as lat, center_lng as lng) end center")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").selectExpr("c_custkey user_id", "case when c_custkey % 7 <> 0 then 60.5e0 end lat", "18.5e0 lng")
    return workspaces.latest_center(moves, w, asked)


@query("select o.id, b.workspace_id from objects o join bounds b on o.lng between b.west and b.east and o.lat between b.south and b.north")
def objects_in_workspaces(spark, sf_dir):
    return spatial.objects_in_workspaces(_objects(spark, sf_dir).select("id", "lng", "lat"), _boxed(spark, sf_dir)).select("id", "workspace_id")


def _extents(spark, sf_dir) -> DataFrame:
    box = F.expr("struct(lng as west, lat as south, lng + w as east, lat + h as north)")
    return derived(spark, sf_dir, "shapes").select("id", box.alias("extent"))


@query("select s.id, b.workspace_id from shapes s join bounds b on s.lng <= b.east and b.west <= s.lng + s.w and s.lat <= b.north and b.south <= s.lat + s.h")
def features_in_workspaces(spark, sf_dir):
    return spatial.features_in_workspaces(_extents(spark, sf_dir), _boxed(spark, sf_dir)).select("id", "workspace_id")


@query("select a.workspace_id a_id, b.workspace_id b_id from bounds a join bounds b on a.workspace_id < b.workspace_id and a.west <= b.east and b.west <= a.east and a.south <= b.north and b.south <= a.north")
def overlapping_workspaces(spark, sf_dir):
    return spatial.overlapping_workspaces(_boxed(spark, sf_dir))


@query("select device_id, min(lng) west, min(lat) south, max(lng) east, max(lat) north from fixes where accuracy <= 50 group by device_id")
def layer_extent(spark, sf_dir):
    return spatial.layer_extent(_shapes(spark, sf_dir), "device_id")


@query(f"""select id, coalesce(nullif(isom_symbol, ''), '506') display_symbol, coalesce(nullif(name, ''), l, 'Väg eller stig') display_name, 'automatic-unverified' status,
    coalesce(case classification_confidence when 'high' then 'hög' when 'medium' then 'medel' when 'low' then 'låg' end, 'okänd') confidence_label
    from (select id, name, classification_confidence, case when p_partkey % 9 = 0 then '' else isom_symbol end isom_symbol from roads) r left join {_ROADS} on r.isom_symbol = rt.s""")
def feature_defaults(spark, sf_dir):
    roads = derived(spark, sf_dir, "roads").withColumn("isom_symbol", F.expr("case when p_partkey % 9 = 0 then '' else isom_symbol end")).withColumn("status", F.expr("case when p_partkey % 2 = 0 then '' end"))
    return reviews.feature_defaults(roads, "road").select("id", "display_symbol", "display_name", "status", "confidence_label")


@query("select id from previous where isom_symbol = '502' and coalesce(status, '') <> 'locally-rejected'")
def road_fill_features(spark, sf_dir):
    return reviews.road_fill_features(derived(spark, sf_dir, "previous")).select("id")


@query("""select id, case when coalesce(nullif(status, ''), '') = '' then 'automatic-unverified' else status end status, coalesce(nullif(name, ''), 'Byggnad') display_name
    from (select id, name, case when p_partkey % 2 = 0 then '' when p_partkey % 3 = 0 then 'locally-approved' end status from roads) r""")
def building_defaults(spark, sf_dir):
    buildings = derived(spark, sf_dir, "roads").withColumn("status", F.expr("case when p_partkey % 2 = 0 then '' when p_partkey % 3 = 0 then 'locally-approved' end"))
    return reviews.feature_defaults(buildings, "building").select("id", "status", "display_name")


_LAST = "select source_id, arg_max(coalesce(nullif(status, ''), 'automatic-unverified'), ordinal) status, arg_max(coalesce(epoch_us(reviewed_at), -1), ordinal) us, arg_max(isom_symbol, ordinal) isom_symbol, arg_max(road_type, ordinal) road_type from previous group by source_id"


@query(_LAST)
def latest_reviews(spark, sf_dir):
    prev = derived(spark, sf_dir, "previous").withColumn("status", reviews.status_of(F.col("status"))).withColumn("us", F.coalesce(F.expr(_US.format("reviewed_at")), F.lit(-1)))
    return reviews.latest_reviews(prev, ["status", "us", "isom_symbol", "road_type"]).select("source_id", "review.*")


_CARRY = f"from following f left join ({_LAST}) r on f.source_id is not distinct from r.source_id and r.status <> 'automatic-unverified'"


@query(f"select f.id, coalesce(r.status, f.status, '') status, case when r.status is not null then r.us else -1 end us {_CARRY}")
def carry_over_building_reviews(spark, sf_dir):
    out = reviews.carry_over_building_reviews(derived(spark, sf_dir, "following"), derived(spark, sf_dir, "previous"))
    return out.select("id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.expr(_US.format("reviewed_at")), F.lit(-1)).alias("us"))


@query(f"select f.id, coalesce(r.status, f.status, '') status, case when r.status is not null then r.isom_symbol else f.isom_symbol end isom_symbol, case when r.status is not null then r.road_type else f.road_type end road_type {_CARRY}")
def carry_over_road_reviews(spark, sf_dir):
    out = reviews.carry_over_road_reviews(derived(spark, sf_dir, "following"), derived(spark, sf_dir, "previous"))
    return out.select("id", F.coalesce("status", F.lit("")).alias("status"), "isom_symbol", "road_type")


_REPLAY = """select feature_id, arg_max(action, n) last_action, max(ts) last_ts, coalesce(max(n) filter (action = 'reset'), 0) reset_n, arg_max(symbol, n) filter (action = 'change') symbol_any,
    coalesce(max(n) filter (action = 'change'), 0) change_n from (select *, row_number() over (order by ts, event_id) n from review_events where action <> 'change' or symbol in ('502','503','504','505','506','507')) e group by feature_id"""


@query(f"select feature_id, last_action, epoch_us(last_ts) last_us, symbol_any, case when change_n > reset_n then symbol_any end symbol_since, reset_n > 0 has_reset from ({_REPLAY}) r")
def replay_reviews(spark, sf_dir):
    found = reviews.replay_reviews(derived(spark, sf_dir, "review_events"))
    return found.select("feature_id", "last_action", F.expr(_US.format("last_ts")).alias("last_us"), "symbol_any", "symbol_since", "has_reset")


@query(f"""select f.id, case when e.feature_id is null then 'stored' when last_action = 'approved' then 'locally-approved' when last_action = 'rejected' then 'locally-rejected' when last_action = 'change' then 'locally-edited' else 'automatic-unverified' end status,
    case when e.feature_id is null or last_action = 'reset' then -1 else epoch_us(last_ts) end us,
    case when e.feature_id is null then f.isom_symbol when automatic_isom_symbol is not null then coalesce(case when change_n > reset_n then symbol_any end, case when reset_n > 0 then automatic_isom_symbol end, f.isom_symbol) else coalesce(symbol_any, f.isom_symbol) end isom_symbol,
    case when e.feature_id is null then f.road_type else coalesce(case when change_n > reset_n then rt.t end, case when reset_n > 0 then automatic_road_type end, f.road_type) end road_type
    from roads f left join ({_REPLAY}) e on f.id = e.feature_id left join {_ROADS} on rt.s = e.symbol_any""")
def apply_reviews(spark, sf_dir):
    roads = derived(spark, sf_dir, "roads").withColumns({"status": F.lit("stored"), "reviewed_at": F.lit(None).cast("timestamp_ntz")})
    out = reviews.apply_reviews(roads, derived(spark, sf_dir, "review_events"))
    return out.select("id", "status", F.coalesce(F.expr(_US.format("reviewed_at")), F.lit(-1)).alias("us"), "isom_symbol", "road_type")


@query(f"""with s as (select r.id, p_partkey % 5 ws, r.source_id, p_partkey ord, case when e.feature_id is not null then case last_action when 'approved' then 'locally-approved' when 'rejected' then 'locally-rejected' when 'change' then 'locally-edited' else 'automatic-unverified' end
        else case p_partkey % 4 when 0 then 'automatic-unverified' when 1 then 'locally-approved' when 2 then 'locally-rejected' else 'locally-edited' end end status from roads r left join ({_REPLAY}) e on r.id = e.feature_id),
    l as (select ws, source_id, arg_max(status, ord) status from s group by 1, 2),
    f as (select cast(substr(id, 2) as int) % 5 ws, source_id from following),
    n as (select f.ws, case when l.status <> 'automatic-unverified' then l.status else 'automatic-unverified' end status from f left join l on l.ws = f.ws and l.source_id is not distinct from f.source_id where f.ws <> 4 union all select ws, status from s where ws = 4)
    select ws workspace_id, count(*) total, count(*) filter (status = 'locally-rejected') rejected, count(*) filter (status = 'automatic-unverified') unverified, count(*) filter (status in ('locally-approved', 'locally-edited')) reviewed from n group by 1""")
def refresh_layer(spark, sf_dir):
    """A stored layer of roads, actions on it, and a new extract for all workspaces but one."""
    roads = derived(spark, sf_dir, "roads")
    status = F.expr("case p_partkey % 4 when 0 then null when 1 then 'locally-approved' when 2 then 'locally-rejected' else 'locally-edited' end")
    layer = roads.select(F.expr("p_partkey % 5").alias("workspace_id"), "id", "ordinal", "source_id", status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), "isom_symbol", "road_type", "automatic_isom_symbol", "automatic_road_type")
    before, after = scratch_path(spark), scratch_path(spark)
    refresh.store(layer, before, buckets=16)
    events = derived(spark, sf_dir, "review_events").withColumn("workspace_id", F.expr("event_id % 200 % 5"))
    extract = layer.where("cast(substr(id, 2) as int) % 10 <> 3 and workspace_id <> 4").withColumn("status", F.lit(None).cast("string"))
    return refresh.refresh(spark, before, events, extract.drop("ordinal"), after, buckets=16)


@query("""select f.id, case when e.feature_id is null then 'stored' when a = 'approved' then 'locally-approved' when a = 'rejected' then 'locally-rejected' else 'automatic-unverified' end status,
    case when e.feature_id is null or a = 'reset' then -1 else epoch_us(t) end us from roads f left join (select feature_id, arg_max(action, n) a, max(ts) t from (select *, row_number() over (order by ts, event_id) n from review_events) q group by feature_id) e on f.id = e.feature_id""")
def apply_building_reviews(spark, sf_dir):
    """Of a building any other action than those listed leaves a time and no verdict."""
    stored = derived(spark, sf_dir, "roads").select("id").withColumns({"status": F.lit("stored"), "reviewed_at": F.lit(None).cast("timestamp_ntz")})
    out = reviews.apply_reviews(stored, derived(spark, sf_dir, "review_events"), "building")
    return out.select("id", "status", F.coalesce(F.expr(_US.format("reviewed_at")), F.lit(-1)).alias("us"))


@query("select isom_symbol, count(*) total, count(*) filter (status = 'locally-approved') approved, count(*) filter (status = 'locally-rejected') rejected, count(*) filter (coalesce(status, '') not in ('locally-approved', 'locally-rejected')) unverified from previous group by isom_symbol")
def building_review_counts(spark, sf_dir):
    return reviews.building_review_counts(derived(spark, sf_dir, "previous"), "isom_symbol")


@query("select isom_symbol, count(*) total, count(*) filter (status = 'locally-rejected') rejected, count(*) filter (status is null) unverified, count(*) filter (status in ('locally-approved', 'locally-edited')) reviewed from previous group by isom_symbol")
def road_review_counts(spark, sf_dir):
    return reviews.road_review_counts(derived(spark, sf_dir, "previous"), "isom_symbol")


_MARKS = "select device_id, received_at t, seq, 0 later, lng, 0 stop from fixes union all select device_id, ts, seq, 1, null, case when action = 'stop_gps' then 1 else 0 end from actions where action <> 'fix'"


@query(f"""select seq, l lng from (select *, last_value(lng ignore nulls) over (partition by device_id, run order by t, seq, later) l from (select *, sum(stop) over (partition by device_id order by t, seq, later) run from ({_MARKS}) m) r) x where later = 1""")
def fix_at_action(spark, sf_dir):
    a = derived(spark, sf_dir, "actions").where("action <> 'fix'").select("device_id", "ts", "seq", "action")
    return recorder.fix_at_action(a, derived(spark, sf_dir, "fixes")).select("seq", F.col("fix.lng").alias("lng"))


@query("""select seq, recording from (select *, last_value(b ignore nulls) over w open, count(*) filter (b = 1) over w recording from
    (select device_id, ts t, seq, 0 is_fix, case when action = 'begin' then 1 else 0 end b, null accuracy from actions where action in ('begin', 'finish', 'cancel')
    union all select device_id, received_at, seq, 1, null, accuracy from fixes) m window w as (partition by device_id order by t, seq, is_fix)) x where is_fix = 1 and open = 1 and accuracy <= 50""")
def fixes_in_recording(spark, sf_dir):
    return recorder.fixes_in_recording(derived(spark, sf_dir, "actions"), derived(spark, sf_dir, "fixes")).select("seq", "recording")


def recorder_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes and all kinds of actions of each device, from events."""
    f = derived(spark, sf_dir, "fixes")
    kind = "case when seq%17=0 then 'action' when seq%19=0 then 'finish' when seq%23=0 then 'undo' when seq%101=0 then 'cancel' when seq%53=0 then 'set_mode' when seq%59=0 then 'stop_gps' when seq%61=0 then 'set_type' when source='manual' then 'tap' else 'fix' end"
    category = "case seq%4 when 0 then 'point' when 1 then 'area' else 'line' end"
    return f.selectExpr("device_id", f"{_US.format('received_at')} div 1000 ts", "seq", f"{kind} kind", f"{category} category", f"case {category} when 'point' then 'pit' when 'line' then 'stream' else 'lake' end object_type", "case when seq%2=0 then 'gps' else 'manual' end mode", "lng", "lat", "accuracy", "altitude", "cast(null as double) altitude_accuracy")


@query()
def recordings(spark, sf_dir):
    """Sequential by nature: tests hold it against the rules and the stream."""
    return recorder.recordings(recorder_events(spark, sf_dir)).select("device_id", "ordinal", "category", "object_type", "source", "created_at", F.size("coordinates").alias("n_vertices"))


_SCALE = "case when symbol_display_mode = 'print' then greatest(0.55, least(5.0, pow(2.0, {z} - 16) * scale / 10000)) else 1.0 end"


@query(f"select workspace_id, round({_SCALE.format(z='(12 + workspace_id % 8)')}, 6) symbol_scale from workspaces")
def symbol_scale(spark, sf_dir):
    w = derived(spark, sf_dir, "workspaces")
    return w.select("workspace_id", F.round(text.symbol_scale(F.col("symbol_display_mode"), F.col("scale"), F.expr("12 + workspace_id % 8")), 6).alias("symbol_scale"))


_STYLES = [
    ("building", "r", "#a13d38", 1.5, "4,3", "#fff", 0.08, 1.0), ("building", "a", "#111", 1.0, "", "#111", 0.92, 1.0), ("building", "e", "#171b19", 1.0, "", "#171b19", 0.62, 1.0), ("building", "u", "#171b19", 1.0, "", "#171b19", 0.62, 1.0),
    *[("road", f"{s}{k}", "#a13d38" if k == "r" else "#111", 2.0 if k == "r" else w, "4,4" if k == "r" else d, None, None, 0.8 if k == "r" else 0.7 if k == "u" else 1.0) for s, w, d in (("502", 8.0, ""), ("503", 3.5, ""), ("504", 3.0, "12,4"), ("505", 2.5, "9,5"), ("506", 1.8, "5,4"), ("507", 1.8, "2,4,2,8")) for k in "raeu"],
    *[("road_fill", k, "#b89b72", 5.2, "", None, None, 0.75 if k == "u" else 1.0) for k in "raeu"],
    ("contour", "1", "#9a5b35", 2.2, "", None, None, 0.9), ("contour", "0", "#9a5b35", 1.25, "", None, None, 0.9),
]


@query(f"""select p.id, p.layer, s.colour, round(s.weight * case when p.layer = 'building' then greatest(1.0, p.s) else p.s end, 6) weight, s.fill, s.fill_opacity, s.opacity,
    nullif(array_to_string(list_transform(list_filter(string_split(s.dash, ','), lambda x: x <> ''), lambda x: cast(round(cast(x as double) * case when p.layer = 'building' then greatest(1.0, p.s) else p.s end, 6) as decimal(18, 2))), ' '), '') dash
    from (select q.*, l.layer, greatest(0.55, least(5.0, pow(2.0, 17 - 16) * 7500 / 10000)) s,
    case l.layer when 'road' then isom_symbol || st when 'contour' then case when ordinal % 5 = 0 then '1' else '0' end else st end k
    from (select *, case status when 'locally-rejected' then 'r' when 'locally-approved' then 'a' when 'locally-edited' then 'e' else 'u' end st from previous) q, (values ('building'), ('road'), ('road_fill'), ('contour')) l(layer)) p
    join (values {_values(_STYLES)}) s(layer, k, colour, weight, dash, fill, fill_opacity, opacity) on s.layer = p.layer and s.k = p.k""")
def portrayal_of_features(spark, sf_dir):
    rows = derived(spark, sf_dir, "previous").withColumn("layer", F.explode(F.array(*map(F.lit, ("building", "road", "road_fill", "contour")))))
    rows = rows.withColumns({"object_type": F.lit(None).cast("string"), "index_contour": F.col("ordinal") % 5 == 0, "symbol_display_mode": F.lit("print"), "scale": F.lit(7500)})
    drawn = portrayal.portrayal(rows, F.lit(17))
    as_decimals = F.array_join(F.transform(F.split("dash", " "), lambda d: d.cast("decimal(18,2)").cast("string")), " ")
    return drawn.select("id", "layer", "colour", F.round("weight", 6).alias("weight"), as_decimals.alias("dash"), "fill", F.col("fill_opacity").cast("double").alias("fill_opacity"), F.col("opacity").cast("double").alias("opacity"))


@query("""select id, category, case when category = 'line' then case when t = 'stream' then '#168cab' when t = 'ditch' then '#8d5b36' else '#181b19' end
    else case when t = 'building' then '#181b19' when t in ('lake', 'marsh', 'hard_marsh') then '#168cab' when t in ('field', 'open_land') then '#d2a82f' when t = 'forbidden' then '#9b3d83' else '#1d874e' end end colour,
    case when category = 'line' then case when t = 'stream' then 4.0 when t in ('ditch', 'fence') then 3.0 when t = 'cliff' then 5.0 when t = 'wide_path' then 5.0 when t like '%path%' then 3.0 when t = 'paved_road' then 7.0 else 5.0 end else 1.0 end weight,
    case when category = 'line' then case when t = 'ditch' then '8 5' when t = 'fence' then '3 5' when t = 'wide_path' then '9 5' when t = 'faint_path' then '3 7' when t like '%path%' then '9 5' when t = 'gravel_road' then '12 4' end when t like '%marsh%' then '5 4' end dash,
    case when category = 'area' then case when t = 'building' then '#181b19' when t = 'lake' then '#7bcfe1' when t like '%marsh%' then '#bce2df' when t in ('field', 'open_land') then '#ffe270' when t = 'forbidden' then '#d995ca' when t = 'very_dense' then '#228847' else '#60aa63' end end fill,
    case when category = 'area' then case when t = 'building' then 0.82 when t = 'lake' then 0.55 when t like '%marsh%' then 0.5 when t in ('field', 'open_land') then 0.55 when t = 'forbidden' then 0.45 else 0.52 end end fill_opacity, 1.0 opacity
    from (select id, category, coalesce(object_type, '') t from objects where category <> 'point') o""")
def portrayal_of_objects(spark, sf_dir):
    rows = _objects(spark, sf_dir).where("category <> 'point'").withColumn("layer", F.col("category"))
    rows = rows.withColumns({"status": F.lit(None).cast("string"), "isom_symbol": F.lit(None).cast("string"), "index_contour": F.lit(None).cast("boolean"), "symbol_display_mode": F.lit("digital"), "scale": F.lit(10000)})
    return portrayal.portrayal(rows, F.lit(15)).select("id", "category", "colour", "weight", "dash", "fill", "fill_opacity", "opacity")


@query("""select p_partkey, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '"', '&quot;') html from (select p_partkey, '<' || p_name || ' & "' || p_brand || '''>' t from part) x""")
def escape_html(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("""concat('<', p_name, ' & "', p_brand, "'>")""").alias("t"))
    return p.select("p_partkey", text.escape_html(F.col("t")).alias("html"))


@query("""select workspace_id, '1:' || case scale when 7500 then '7' || chr(160) || '500' when 10000 then '10' || chr(160) || '000' else '15' || chr(160) || '000' end || ' · ' || case when contour_interval = 5 then '5' else '2.5' end || ' m · ' || size_km || ' × ' || size_km || ' km · ' ||
    case when coalesce(symbol_display_mode, 'print') = 'print' then 'Utskriftsläge' else 'Digitalt läge' end label, size_km || ' × ' || size_km || ' km · ' || printf('%.5f, %.5f', center_lat, center_lng) area_label from workspaces""")
def labels(spark, sf_dir):
    w = derived(spark, sf_dir, "workspaces")
    size = F.col("size_km").cast("double")
    return w.select("workspace_id", text.workspace_label(F.col("scale"), F.col("contour_interval"), size, F.col("symbol_display_mode")).alias("label"), text.area_label(size, F.col("center_lat"), F.col("center_lng")).alias("area_label"))


@query("""select seq, case when accuracy <= 3 then '★ ' else '' end || 'GPS ± ' || cast(floor(accuracy + 0.5) as bigint) || ' m · ' || case when accuracy <= 3 then 'Utmärkt' when accuracy <= 10 then 'Bra' when accuracy <= 50 then 'Osäkert' else 'Otillräckligt' end gps from fixes""")
def gps_labels(spark, sf_dir):
    return derived(spark, sf_dir, "fixes").select("seq", gps.gps_label(F.col("accuracy")).alias("gps"))


@query("""select isom_symbol, total || ' · ' || approved || ' godkända · ' || rejected || ' avvisade · ' || unverified || ' ogranskade' buildings, total || ' · ' || reviewed || ' granskade · ' || (total - reviewed - rejected) || ' ogranskade' roads,
    case when total - 20 > 0 then (total - 20) || ' linjer · ' || case when isom_symbol = '503' then '5' else '2.5' end || ' m' else 'Inte importerade' end contours
    from (select isom_symbol, count(*) total, count(*) filter (status = 'locally-approved') approved, count(*) filter (status = 'locally-rejected') rejected, count(*) filter (coalesce(status, '') not in ('locally-approved', 'locally-rejected')) unverified,
    count(*) filter (status in ('locally-approved', 'locally-edited')) reviewed from previous group by isom_symbol) c""")
def summaries(spark, sf_dir):
    prev = derived(spark, sf_dir, "previous")
    b = reviews.building_review_counts(prev, "isom_symbol")
    r = reviews.road_review_counts(prev, "isom_symbol").select("isom_symbol", "reviewed", F.col("unverified").alias("open"))
    interval = F.when(F.col("isom_symbol") == "503", 5.0).otherwise(2.5)
    return b.join(r, "isom_symbol").select("isom_symbol", text.building_summary(F.col("total"), F.col("approved"), F.col("rejected"), F.col("unverified")).alias("buildings"), text.road_summary(F.col("total"), F.col("reviewed"), F.col("open")).alias("roads"), text.contour_label(F.col("total") - 20, interval).alias("contours"))


@query("select seq, strftime(received_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' iso, epoch_us(received_at) // 1000 millis, epoch_us(received_at) // 1000 * 1000 iso_us, epoch_us(received_at) // 1000 * 1000 millis_us from fixes")
def iso_times(spark, sf_dir):
    ts = F.col("received_at").cast("timestamp")
    out = derived(spark, sf_dir, "fixes").select("seq", text.iso_utc(ts).alias("iso"), text.to_millis(ts).alias("millis"))
    back = lambda c: F.unix_micros(c)
    return out.select("seq", "iso", "millis", back(text.from_iso(F.col("iso"))).alias("iso_us"), back(text.from_millis(F.col("millis"))).alias("millis_us"))


@query(f"""with v as (select * from {_ACCEPTED}) select device_id, day_no, count(*) + 1 n_closed, count(*) - 1 n_undone, arg_max(lng, seq) last_lng, arg_min(lng, seq) closing_lng,
    count(altitude) n_3d, arg_min(lat, seq) swapped_first from v group by device_id, day_no""")
def coordinate_arrays(spark, sf_dir):
    s, c = _shapes(spark, sf_dir), F.col("coordinates")
    flat = geometry.flat_positions(c)
    return s.select("device_id", "day_no", F.size(geometry.closed(c)).cast("long").alias("n_closed"), F.size(geometry.without_last(c)).cast("long").alias("n_undone"), F.element_at(flat, -1)[0].alias("last_lng"), F.element_at(geometry.closed(flat), -1)[0].alias("closing_lng"), F.size(F.filter(geometry.positions(c), lambda p: F.size(p) == 3)).cast("long").alias("n_3d"), F.element_at(geometry.swapped(flat), 1)[0].alias("swapped_first"))
