"""Domain tables derived from the star-schema tables, as SQL that Spark and DuckDB read alike.

Returns are integer micro-units before they are summed, so that running sums
are exact in either engine; derived products are not rounded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from vintage.sources import scratch

#: Name of each domain table, its SQL, and the domain tables it reads.
SQL: dict[str, str] = {
    "bars": """
with d as (select p_brand as symbol, cast(l_shipdate as date) as date, count(*) as n,
  sum(cast(round(l_discount*100) as bigint)) as sd, sum(cast(round(l_tax*100) as bigint)) as st,
  sum(cast(l_quantity as bigint)) as volume
  from lineitem join part on l_partkey=p_partkey group by p_brand, cast(l_shipdate as date)),
r as (select symbol,date,volume,
  sum(cast(round(cast((sd-5*n)*4000 as double)/n) as bigint)) over (partition by symbol order by date rows between unbounded preceding and current row) as cum,
  cast(round(cast((st-4*n)*2000 as double)/n) as bigint) as gap from d),
c as (select symbol,date,cast(volume as bigint) as volume, round(100*exp(cast(cum as double)/1000000),4) as close, gap from r),
o as (select *, coalesce(lag(close) over (partition by symbol order by date), close)*cast(1000000+gap as double)/1000000 as open,
  row_number() over (partition by symbol order by date) as rn from c)
select symbol,date,open, greatest(open,close)*cast(1.004 as double) as high, least(open,close)*cast(0.996 as double) as low,
  close, close*cast(8000+rn as double)/10000 as adj_close, volume, date as knowable_at from o
""",
    "bench": """
with d as (select cast(l_shipdate as date) as date, count(*) as n, sum(cast(round(l_discount*100) as bigint)) as sd,
  sum(cast(l_quantity as bigint)) as volume from lineitem group by cast(l_shipdate as date)),
r as (select date, cast(volume as bigint) as volume,
  sum(cast(round(cast((sd-5*n)*3000 as double)/n) as bigint)) over (order by date rows between unbounded preceding and current row) as cum from d),
c as (select date, volume, round(100*exp(cast(cum as double)/1000000),4) as close from r),
o as (select *, coalesce(lag(close) over (order by date), close) as open from c)
select 'MKT' as symbol, date, open, greatest(open,close) as high, least(open,close) as low, close, close as adj_close, volume, date as knowable_at from o
""",
    "universe": """
select cast(e.eff as date) as effective, b.symbol, cast(e.eff as date) as knowable_at
from (select distinct date_trunc('month', date) as eff from bars) e
cross join (select distinct symbol, cast(substr(symbol,7) as int) as k from bars) b
where (extract(year from e.eff)*12 + extract(month from e.eff) + b.k) % 10 < 8
""",
    "facts": """
with y as (select p_brand as symbol, cast(substr(p_brand,7) as int) as k, extract(year from l_shipdate) as yr,
   sum(cast(round(l_extendedprice*100) as bigint)) as rev_cents, sum(cast(l_quantity as bigint)) as qty
   from lineitem join part on l_partkey=p_partkey group by p_brand, extract(year from l_shipdate)),
c as (select symbol,k,yr,'NetIncomeLoss' as concept, cast(rev_cents as double)/100*0.01*(k%7-1) as value from y
 union all select symbol,k,yr,'StockholdersEquity', cast(rev_cents as double)/100*0.08*(case when k%11=0 then -1 else 1 end) from y
 union all select symbol,k,yr,'WeightedAverageNumberOfDilutedSharesOutstanding', cast(qty as double)/(case when k%13=0 then 1000 else 1 end) from y),
f as (select *, make_date(cast(yr as int),12,31) as period_end, 0 as amend from c
 union all select symbol,k,yr,concept,value*1.25,make_date(cast(yr as int),12,31),1 from c where k%3=0)
select symbol,concept,period_end,value,
  cast(period_end + (case when amend=1 then 200 else 30+2*k end) * interval '1' day as date) as knowable_at,
  concat(symbol,'-',cast(yr as string),'-',cast(amend as string)) as accn from f
""",
    "splits": """
select symbol, make_date(1996 + k%4, 6, 10) as date, cast(2 + k%3 as double) as ratio, make_date(1996 + k%4, 6, 10) as knowable_at
from (select distinct symbol, cast(substr(symbol,7) as int) as k from bars) s where k%4 <> 0
union all
select symbol, make_date(2000, 1 + k%12, 3) as date, cast(10 as double) as ratio, make_date(2000, 1 + k%12, 3) as knowable_at
from (select distinct symbol, cast(substr(symbol,7) as int) as k from bars) s where k%6 = 0
""",
    "spans": """
select symbol as ticker, make_date(1995, 1 + k%12, 2) as start_date, case when k%3=0 then make_date(1997, 1 + k%12, 15) end as end_date
from (select distinct symbol, cast(substr(symbol,7) as int) as k from bars) s
union all
select symbol, make_date(1999, 1 + k%12, 23), case when k%2=0 then make_date(2001, 1 + k%9, 23) end
from (select distinct symbol, cast(substr(symbol,7) as int) as k from bars) s where k%3=0
""",
    "news": """
select concat('Brand#',cast(doc_id%25+1 as string)) as symbol,
  timestamp '1998-01-01 00:00:00' + doc_id*interval '7' hour as published_at, source,
  concat(substr(text,1,60),' ',case doc_id%6 when 0 then 'beats and raises' when 1 then 'lawsuit' when 2 then 'record growth'
    when 3 then 'misses and cut' when 4 then 'upgrade despite loss' else 'neutral' end) as headline, coalesce(text, '') as body
from documents
""",
    "nav": """
select concat('X',upper(symbol),'X') as symbol, date, close*cast(1000+(rn*7+k)%50 as double)/1000 as close
from (select symbol, date, close, cast(substr(symbol,7) as int) as k, row_number() over (partition by symbol order by date) as rn from bars) b
where not (k%5=0 and rn%97=0)
""",
    "event_bars": """
select concat('U',cast(user_id as string)) as symbol, cast(ts as date) as date, min_by(value, struct_key) as open, max(value) as high,
  min(value) as low, max_by(value, struct_key) as close, max_by(value, struct_key) as adj_close, count(*) as volume, cast(ts as date) as knowable_at
from (select user_id, ts, value, ts as struct_key from events) e group by user_id, cast(ts as date)
""",
}

NEEDS: dict[str, tuple[str, ...]] = {name: ("bars",) for name in ("universe", "splits", "spans", "nav")}
RAW = ("lineitem", "part", "documents", "events")


def with_clause(*names: str, given: Iterable[str] = ()) -> str:
    """WITH ... that defines the named tables and what they read, but for those given as views."""
    wanted = [n for n in SQL if n not in given and (n in names or any(n in NEEDS.get(m, ()) for m in names))]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in wanted) + "\n" if wanted else ""


class Tables:
    """The domain tables of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made, self._kept = spark, folder, {}, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """A query over the named domain tables."""
        for raw in RAW:
            self.raw(raw).createOrReplaceTempView(raw)
        for name, table in self._kept.items():
            table.createOrReplaceTempView(name)
        return self.spark.sql(with_clause(*names, given=self._kept) + text)

    def keep(self, *names: str) -> None:
        """Write the named tables once, for a plan that reads them many times; those that read them come from what was written."""
        for name in names:
            if name not in self._kept:
                self._made[name] = self._kept[name] = scratch.written(getattr(self, name), name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.sql(f"SELECT * FROM {name}", name)
        return self._made[name]
