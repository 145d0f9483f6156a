"""SQL fragments for the DuckDB oracle (the same rules as the Spark operators,
written independently as plain SQL over the pre-registered driver views)."""

from __future__ import annotations

from tabprep.functions.compass import compass_degrees
from tabprep.rules import CLEAN_TOKENS, COMPASS_POINTS, PROFILE_TOKENS
from tabprep.sources.fixtures import DIR_BY_RESIDUE

EPS = 1e-9


def q(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


PROFILE_IN = q(PROFILE_TOKENS)
CLEAN_IN = q(CLEAN_TOKENS)
COMPASS_IN = q(COMPASS_POINTS)


def degrees(expr: str) -> str:
    whens = " ".join(f"when '{k}' then {v}" for k, v in compass_degrees().items())
    return f"(case {expr} {whens} end)"


def radians(expr: str) -> str:
    return f"radians({degrees(expr)})"


def r6(expr: str) -> str:
    """The comparison grid of catalog.quantize: floor(x * 1e6 + 0.3183) / 1e6."""
    return (f"(case when isnan({expr}) then {expr} else "
            f"floor(({expr}) * 1000000.0::double + 0.3183::double) / 1000000.0::double end)")


def missing(c: str) -> str:
    s = f"cast({c} as varchar)"
    return f"({c} is null or trim({s}) = '' or lower({s}) in ({PROFILE_IN}))"


def hash_bucket(id_col: str = "row_id", seed: int = 2025) -> str:
    return f"(('0x' || substr(md5(cast({id_col} as varchar) || ':{seed}'), 1, 8))::bigint % 1000000)"


_DIRS = DIR_BY_RESIDUE

OBS = f"""obs as (
select o_orderkey as row_id,
  concat('L', cast(o_custkey % 25 as varchar)) as location,
  cast(o_orderdate as date) as obs_date,
  cast(month(o_orderdate) as integer) as month,
  case when month(o_orderdate)=12 and o_orderkey%2=0 then null
       when o_orderkey % 7 = 0 then null else o_totalprice end as num_a,
  case when month(o_orderdate)=2 then case when o_orderkey%3=0 then null end
       when o_orderkey % 11 = 0 then null else o_totalprice/10 end as num_b,
  case when o_orderkey % 13 = 0 then 'NA' when o_orderkey % 17 = 0 then ' '
       else cast(o_totalprice as varchar) end as txt_num,
  case (o_orderkey*7) % 19 {" ".join(f"when {i} then '{v}'" for i, v in enumerate(_DIRS))} end as dir,
  case when o_orderkey % 19=0 then null when o_orderkey % 23 =0 then 'NA'
       when o_orderstatus='F' then ' yes' else 'No' end as yn,
  case when o_orderkey % 37 = 0 then null else o_orderkey % 10 end as code,
  case when o_orderkey % 41 = 0 then '2020-02-30x' else strftime(o_orderdate, '%Y-%m-%d') end as date_txt,
  o_orderstatus as status
from orders)"""

OBS_COLUMNS = ["row_id", "location", "obs_date", "month", "num_a", "num_b", "txt_num", "dir", "yn",
               "code", "date_txt", "status"]
OBS_TYPES = ["bigint", "string", "date", "int", "double", "double", "string", "string", "string",
             "bigint", "string", "string"]

DUP = "dup as (select * from obs union all select * from obs where row_id % 100 = 0)"

NORM = f"""norm as (
select row_id, location, obs_date, cast(month(obs_date) as integer) as month, num_a, num_b,
  try_cast(case when trim(txt_num) = '' or upper(trim(txt_num)) in ({CLEAN_IN}) then null
                else trim(txt_num) end as double) as txt_num,
  case when upper(trim(dir)) in ({CLEAN_IN}) then null else upper(trim(dir)) end as dir,
  case when upper(trim(yn)) = '' or upper(trim(yn)) in ({CLEAN_IN}) then null
       when lower(trim(yn)) = 'yes' then 'Yes' when lower(trim(yn)) = 'no' then 'No' else yn end as yn,
  code, date_txt, status
from obs)"""

TRAIN = f"train as (select * from norm where {hash_bucket()} < 800000)"
TRAIN_RAW = f"train_raw as (select * from obs where {hash_bucket()} < 800000)"


def with_(*ctes: str, body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def mode_sql(src: str, keys: list[str], target: str, alias: str | None = None, where: str | None = None) -> str:
    """Mode per group (ties: smallest value) as a subquery."""
    k = ", ".join(keys)
    w = f"where {target} is not null" + (f" and ({where})" if where else "")
    return (f"(select {k}, {target} as {alias or target} from ("
            f"select {k}, {target}, row_number() over (partition by {k} order by cnt desc, {target}) as rn "
            f"from (select {k}, {target}, count(*) as cnt from {src} {w} group by {k}, {target})) where rn = 1)")
