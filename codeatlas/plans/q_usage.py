"""Model-call log queries: events are calls (task = user, purchase = success, signup = status 400,
view = no response, error / click = failed call); stage from the `k` property."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.usage import attempt_outcomes, usage_rollup
from .registry import T, register

_CALLS_SQL = """(select user_id, event_id, ts, event_type,
        'stage_' || (cast(json_extract_string(props, '$.k') as bigint) // 25) as stage,
        cast(floor(value * 100) as bigint) as prompt_tokens, cast(floor(value * 10) as bigint) as completion_tokens,
        case event_type when 'purchase' then 'ok' when 'signup' then '400' when 'view' then 'none' else 'ERROR' end
          as status
 from events)"""


def calls(spark, root):
    e = T(spark, root, "events")
    status = (F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "signup", "400")
              .when(F.col("event_type") == "view", "none").otherwise("ERROR"))
    stage = F.concat(F.lit("stage_"), F.floor(F.get_json_object("props", "$.k").cast("long") / 25).cast("string"))
    return e.select("user_id", "event_id", "ts", "event_type", stage.alias("stage"),
                    F.floor(F.col("value") * 100).cast("long").alias("prompt_tokens"),
                    F.floor(F.col("value") * 10).cast("long").alias("completion_tokens"), status.alias("status"))


@register("usage_rollup", f"""
select stage, user_id, cast(sum(prompt_tokens) as bigint) as prompt_tokens,
       cast(sum(completion_tokens) as bigint) as completion_tokens, count(*) as calls
from {_CALLS_SQL} where status = 'ok' group by rollup(stage, user_id)""")
def q_usage_rollup(spark, root):
    return usage_rollup(calls(spark, root), "stage", "user_id", F.col("status") == "ok")


@register("attempt_outcomes", f"""
with a as (select *, row_number() over (partition by user_id order by ts, event_id) as attempt_no from {_CALLS_SQL}),
g as (select user_id, count(*) as n, min(case when status in ('ok', '400') then attempt_no end) as t from a group by user_id),
j as (select g.*, a.status as ts_, a.prompt_tokens as tp from g left join a on a.user_id = g.user_id and a.attempt_no = g.t)
select user_id,
       case when t is not null and t <= 3 and ts_ = 'ok' then 'success' when t is not null and t <= 3 then 'rejected'
            else 'exhausted' end as outcome,
       cast(case when t is not null and t <= 3 then t else least(n, 3) end as bigint) as attempts_used,
       cast(case when t is not null and t <= 3 and ts_ = 'ok' then tp else 0 end as bigint) as prompt_tokens
from j""")
def q_attempt_outcomes(spark, root):
    return attempt_outcomes(calls(spark, root), ["user_id"], ["ts", "event_id"], "status", max_try=3)
