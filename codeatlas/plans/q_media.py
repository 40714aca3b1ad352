"""Image-asset queries over assets derived from `part` (one image per part) and key frames derived
from `lineitem` (one frame per line item of a gif part); change-point sampling over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.media import data_uri, image_tokens, snapped_size
from ..operators.media import frames_of_gif, frames_payload, instance_image_tokens, route_assets
from ..operators.sampling import keyframe_counts, keyframes, keyframes_vector
from .registry import T, register

_EXTS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")
_EXTS_SQL = "[" + ", ".join(f"'{e}'" for e in _EXTS) + "]"
_ASSETS_SQL = f"""(select p_brand as instance_key, p_partkey as pk, 'img_' || p_partkey || {_EXTS_SQL}[p_partkey % 6 + 1] as name,
                  case when p_partkey % 97 = 0 then null else (p_partkey % 97) * 20 end as height,
                  p_size * 40 as width from part)"""
_FRAMES_SQL = f"""(select a.instance_key, a.name || '_' || (l.l_orderkey * 8 + l.l_linenumber) || '.png' as frame,
                  l.l_linenumber * 100 as height, cast(l.l_quantity * 10 as bigint) as width
                  from lineitem l join {_ASSETS_SQL} a on a.pk = l.l_partkey where a.name like '%.gif')"""


def assets(spark, root):
    p = T(spark, root, "part")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("instance_key"), F.col("p_partkey").alias("pk"),
                    F.concat(F.lit("img_"), F.col("p_partkey"), ext).alias("name"),
                    F.when(F.col("p_partkey") % 97 == 0, F.lit(None)).otherwise((F.col("p_partkey") % 97) * 20)
                    .alias("height"), (F.col("p_size") * 40).alias("width"))


def frames(spark, root):
    a = assets(spark, root).filter(F.col("name").endswith(".gif"))
    li = T(spark, root, "lineitem")
    return li.join(a, li.l_partkey == a.pk).select(
        "instance_key",
        F.concat(F.col("name"), F.lit("_"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"),
                 F.lit(".png")).alias("frame"),
        (F.col("l_linenumber") * 100).alias("height"), (F.col("l_quantity") * 10).cast("long").alias("width"))


_ROUTE_SQL = """case when ends_with(name, '.gif') then 'frames'
       when ends_with(name, '.png') or ends_with(name, '.jpeg') or ends_with(name, '.jpg') or ends_with(name, '.webp')
       then 'image' else 'reject' end"""
_MIME_SQL = """case when ends_with(name, '.gif') or ends_with(name, '.png') then 'image/png'
       when ends_with(name, '.jpeg') or ends_with(name, '.jpg') then 'image/jpeg'
       when ends_with(name, '.webp') then 'image/webp' end"""


@register("media_route", f"select pk, name, {_ROUTE_SQL} as kind, {_MIME_SQL} as mime from {_ASSETS_SQL}")
def q_media_route(spark, root):
    return route_assets(assets(spark, root)).select("pk", "name", "kind", "mime")


def _snap_sql(h, w):
    hb0 = f"round_even({h} / 28.0, 0) * 28"
    wb0 = f"round_even({w} / 28.0, 0) * 28"
    big = f"({hb0}) * ({wb0}) > 1280 * 784"
    small = f"({hb0}) * ({wb0}) < 4 * 784"
    down = f"sqrt({h} * {w} / (1280.0 * 784))"
    up = f"sqrt(4.0 * 784 / ({h} * {w}))"
    hb = f"case when {big} then floor({h} / {down} / 28) * 28 when {small} then ceil({h} * {up} / 28) * 28 else {hb0} end"
    wb = f"case when {big} then floor({w} / {down} / 28) * 28 when {small} then ceil({w} * {up} / 28) * 28 else {wb0} end"
    miss = f"({h} is null or {w} is null or {h} <= 0 or {w} <= 0)"
    return (f"case when {miss} then 0 else cast({hb} as bigint) end",
            f"case when {miss} then 0 else cast({wb} as bigint) end")


_HB, _WB = _snap_sql("height", "width")


@register("image_tokens", f"""
select pk, {_HB} as h_bar, {_WB} as w_bar, cast(floor(({_HB}) * ({_WB}) / 784) as bigint) as tokens from {_ASSETS_SQL}""")
def q_image_tokens(spark, root):
    a = assets(spark, root)
    hb, wb = snapped_size(F.col("height"), F.col("width"))
    return a.select("pk", hb.alias("h_bar"), wb.alias("w_bar"), image_tokens(F.col("height"), F.col("width")).alias("tokens"))


@register("data_uri", "select doc_id, 'data:image/png;base64,' || to_base64(encode(text)) as uri from documents")
def q_data_uri(spark, root):
    d = T(spark, root, "documents")
    return d.select("doc_id", data_uri(F.lit("image/png"), F.col("text").cast("binary")).alias("uri"))


@register("frames_of_gif", f"""
select regexp_replace(frame, '_\\d+\\.png$', '') as gif, count(*) as n_frames from {_FRAMES_SQL} group by 1""")
def q_frames_of_gif(spark, root):
    return frames_of_gif(frames(spark, root)).groupBy("gif").agg(F.count(F.lit(1)).alias("n_frames"))


@register("frames_payload", f"""
with f as (select frame, regexp_replace(frame, '_\\d+\\.png$', '') as gif,
                  cast(regexp_extract(frame, '_(\\d+)\\.png$', 1) as bigint) as no from {_FRAMES_SQL}),
a as (select instance_key, name as gif from {_ASSETS_SQL} where name like '%.gif')
select a.instance_key, a.gif, count(*) as n_frames,
       case when count(*) < 4 then 'image_url' else 'video' end as payload,
       string_agg(f.frame, ',' order by f.no, f.frame) as frames
from a join f on a.gif = f.gif group by a.instance_key, a.gif""")
def q_frames_payload(spark, root):
    a = assets(spark, root).filter(F.col("name").endswith(".gif"))
    return frames_payload(a, frames(spark, root), ["instance_key"])


_FH, _FW = _snap_sql("height", "width")


@register("instance_image_tokens", f"""
with a as {_ASSETS_SQL}, f as {_FRAMES_SQL},
t as (select instance_key, cast(floor(({_HB}) * ({_WB}) / 784) as bigint) as t from a where not ends_with(name, '.gif')
      union all
      select a.instance_key, cast(floor(({_FH.replace('height', 'f.height').replace('width', 'f.width')})
                                      * ({_FW.replace('height', 'f.height').replace('width', 'f.width')}) / 784) as bigint)
      from f join a on regexp_replace(f.frame, '_\\d+\\.png$', '') = a.name)
select instance_key, cast(sum(t) as bigint) as image_tokens from t group by instance_key""")
def q_instance_image_tokens(spark, root):
    return instance_image_tokens(assets(spark, root), frames(spark, root), ["instance_key"])


# -- change-point sampling: events of a user are the frames, value the feature, threshold 10 ----
_KF_SQL = """
with recursive s as (
  select user_id, event_id, value, ts,
         row_number() over (partition by user_id order by ts, event_id) - 1 as raw from events),
f as (select user_id, event_id, value, raw // 2 as idx from s where raw % 2 = 0),
r as (select user_id, idx, event_id, value, true as kept, value as last from f where idx = 0
      union all
      select f.user_id, f.idx, f.event_id, f.value, abs(f.value - r.last) > 10,
             case when abs(f.value - r.last) > 10 then f.value else r.last end
      from r join f on f.user_id = r.user_id and f.idx = r.idx + 1),
k as (select user_id, event_id, row_number() over (partition by user_id order by idx) as kept_no from r where kept)
"""


def _kept(spark, root):
    ev = T(spark, root, "events").select("user_id", "event_id", "ts", "value")
    return keyframes(ev, ["user_id"], ["ts", "event_id"], "value", threshold=10.0)


@register("keyframes", _KF_SQL + "select user_id, event_id, cast(kept_no as bigint) as kept_no from k")
def q_keyframes(spark, root):
    return _kept(spark, root).select("user_id", "event_id", F.col("kept_no").cast("long").alias("kept_no"))


@register("keyframe_counts", _KF_SQL + """
select f.user_id, count(*) as total_frames, (select count(*) from k where k.user_id = f.user_id) as saved_frames
from (select user_id from s) f group by f.user_id""")
def q_keyframe_counts(spark, root):
    ev = T(spark, root, "events").select("user_id", "event_id", "ts", "value")
    return keyframe_counts(_kept(spark, root), ev, ["user_id"]).select("user_id", "total_frames", "saved_frames")


_SHARED = "regexp_replace({}, '^img_\\d+', 'img')"


def _shared(df, col):
    return df.withColumn(col, F.regexp_replace(col, r"^img_\d+", "img"))


@register("instance_image_tokens_shared", f"""
with a as {_ASSETS_SQL}, f as {_FRAMES_SQL},
t as (select instance_key, cast(floor(({_HB}) * ({_WB}) / 784) as bigint) as t from a where not ends_with(name, '.gif')
      union all
      select g.instance_key, cast(floor(({_FH.replace('height', 'f.height').replace('width', 'f.width')})
                                      * ({_FW.replace('height', 'f.height').replace('width', 'f.width')}) / 784) as bigint)
      from f join (select instance_key, {_SHARED.format('name')} as gif from a where ends_with(name, '.gif')) g
        on g.instance_key = f.instance_key
       and regexp_replace({_SHARED.format('f.frame')}, '_\\d+\\.png$', '') = g.gif)
select instance_key, cast(sum(t) as bigint) as image_tokens from t group by instance_key""")
def q_instance_image_tokens_shared(spark, root):
    """Gifs of all instances share the name img.gif."""
    return instance_image_tokens(_shared(assets(spark, root), "name"), _shared(frames(spark, root), "frame"), ["instance_key"])


@register("keyframes_null", """
with recursive e as (
  select nullif(user_id % 7, 0) as g, event_id, ts, case when event_id % 5 = 0 then null else value end as value from events),
s as (select g, event_id, value, row_number() over (partition by g order by ts, event_id) - 1 as raw from e),
f as (select g, event_id, value, row_number() over (partition by g order by raw) - 1 as idx from s
      where raw % 2 = 0 and value is not null),
r as (select g, idx, event_id, value, true as kept, value as last from f where idx = 0
      union all
      select f.g, f.idx, f.event_id, f.value, abs(f.value - r.last) > 10,
             case when abs(f.value - r.last) > 10 then f.value else r.last end
      from r join f on f.g is not distinct from r.g and f.idx = r.idx + 1)
select g, event_id, cast(row_number() over (partition by g order by idx) as bigint) as kept_no from r where kept""")
def q_keyframes_null(spark, root):
    """Sequences without a group and frames without a value."""
    ev = T(spark, root, "events").select(F.expr("nullif(user_id % 7, 0)").alias("g"), "event_id", "ts",
                                         F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return keyframes(ev, ["g"], ["ts", "event_id"], "value", threshold=10.0) \
        .select("g", "event_id", F.col("kept_no").cast("long").alias("kept_no"))


# -- key frames over feature vectors: embeddings of a label in id order, cosine below 0.2; every frame taken --
@register("keyframes_vector", """
with recursive f as (
  select label, vec_id, embedding::double[] as v, row_number() over (partition by label order by vec_id) - 1 as idx from embeddings),
r as (select label, idx, vec_id, v as last, true as kept from f where idx = 0
      union all
      select f.label, f.idx, f.vec_id, case when list_cosine_similarity(f.v, r.last) < 0.2 then f.v else r.last end,
             list_cosine_similarity(f.v, r.last) < 0.2
      from r join f on f.label = r.label and f.idx = r.idx + 1)
select label, vec_id, row_number() over (partition by label order by idx) as kept_no from r where kept""")
def q_keyframes_vector(spark, root):
    emb = T(spark, root, "embeddings").select("label", "vec_id", "embedding")
    return keyframes_vector(emb, ["label"], ["vec_id"], "embedding", threshold=0.2, step=1).select("label", "vec_id", "kept_no")


# Two features per event; frames without features, sequences without a group, every second frame.
@register("keyframes_vector_abs", """
with recursive e as (
  select nullif(user_id % 5, 0) as g, event_id, ts, case when event_id % 6 <> 0 then [value, event_id % 7 * 4.0] end as v from events),
s as (select *, row_number() over (partition by g order by ts, event_id) - 1 as raw from e),
f as (select g, event_id, v, row_number() over (partition by g order by raw) - 1 as idx from s where raw % 2 = 0 and v is not null),
r as (select g, idx, event_id, v as last, true as kept from f where idx = 0
      union all
      select f.g, f.idx, f.event_id, case when greatest(abs(f.v[1] - r.last[1]), abs(f.v[2] - r.last[2])) > 15 then f.v else r.last end,
             greatest(abs(f.v[1] - r.last[1]), abs(f.v[2] - r.last[2])) > 15
      from r join f on f.g is not distinct from r.g and f.idx = r.idx + 1)
select g, event_id, row_number() over (partition by g order by idx) as kept_no from r where kept""")
def q_keyframes_vector_abs(spark, root):
    features = F.array(F.col("value"), (F.col("event_id") % 7 * 4).cast("double"))
    ev = T(spark, root, "events").select(F.expr("nullif(user_id % 5, 0)").alias("g"), "event_id", "ts",
                                         F.when(F.col("event_id") % 6 != 0, features).alias("v"))
    return keyframes_vector(ev, ["g"], ["ts", "event_id"], "v", threshold=15.0, measure="abs").select("g", "event_id", "kept_no")
