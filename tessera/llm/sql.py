"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
with base as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size,
         cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as w
  from base group by source),
filled as (select *, 3.0::double * source_size as most, 3.0::double * source_size / w as fill from per),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(most) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from filled window before as (order by fill, source nulls last rows between unbounded preceding and 1 preceding)),
goal as (
  select source, source_size, coalesce(least(most, w * (select arg_min(level, fill) from levels where fill > level)), most) as target
  from levels),
parts as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from goal),
ranked as (select *, row_number() over (partition by source, h) as i from base),
units as (
  select source, h, coalesce(sum(sum(size)) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0) as before
  from base group by source, h)
select b.doc_id, b.size, p.source_size, p.target,
       cast(b.size * (p.whole + case when 2 * (u.before + (b.i - 1) * b.size) + b.size <= 2 * (p.target - p.whole * p.source_size) then 1 else 0 end) as bigint) as taken
from ranked b join parts p on b.source is not distinct from p.source
join units u on b.source is not distinct from u.source and b.h = u.h
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_hash_threshold_mix": OP10}
