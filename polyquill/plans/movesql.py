"""Pseudomoves of the events' signals as SQL: a recursive query that takes one sample of every signal a step."""

from __future__ import annotations

import numpy as np


def moves_sql(value: str, seed: int = 123, lag: int = 100) -> str:
    """CTEs up to ``filled`` (user_id, i from 1, move).  The places that a baseline is drawn from are part of the text."""
    draws = ", ".join(str(d + 1) for d in np.random.default_rng(seed).choice(30, lag))
    return f"""with recursive s as (select user_id, ({value})::double as v, row_number() over (partition by user_id order by ts, event_id, value) as i from events),
x as (select user_id, list(v order by i) as x from s group by 1),
often as (select user_id, list(v order by n desc, v) as o from (select user_id, v, count(*) as n from s group by all) group by 1),
pools as (select user_id, x, list_resize(o[1:20], 20) || list_resize(x[1:10], 10) as pool from x join often using (user_id)),
walk as (
  select user_id, x, 0 as t, list_transform([{draws}], lambda d: pool[d]) as kept, []::int[] as moves from pools
  union all
  select user_id, x, t + 1, (kept || [case when far then kept[len(kept)] else y end])[-{lag + 1}:], moves || [case when far then sign(y - m)::int else 0 end]
  from (select *, coalesce(abs(y - m) > 3.5 * sd, false) as far from (select *, x[t + 1] as y, list_avg(kept) as m, list_stddev_samp(kept) as sd from walk where t < len(x)))
),
raw as (select user_id, unnest(moves) as move, generate_subscripts(moves, 1) as i from walk where t = len(x)),
later as (select user_id, i, case when i > 5 then move else 0 end as move from raw),
filled as (select user_id, i, case when move = 0 and lag(move) over w = lead(move) over w and lag(move) over w <> 0 then lag(move) over w else move end as move from later window w as (partition by user_id order by i))"""
