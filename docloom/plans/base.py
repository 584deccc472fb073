"""What the query families share: reading tables, and pieces of DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident_sql(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*'), lambda x: lower(x))"


def stem_sql(text: str) -> str:
    return rf"""list_transform(regexp_extract_all(replace(lower({text}), '_', ' '), '[a-z0-9]+'), lambda w: case when length(w) <= 3 then w
      when w like '%ies' then w[1:length(w)-3] || 'y' when w like '%s' and w not like '%ss' then w[1:length(w)-1] else w end)"""


def bm25_sql(units: str, questions: str, tokens, k: int, tag: str = "") -> str:
    """CTEs ending in `ranked(query_id, unit_id, score, rank)`, all names followed by the tag; units and questions are queries of (unit_id, text) and (query_id, text)."""
    return f"""
u{tag} as (select unit_id::varchar as unit_id, {tokens('text')} as ts from ({units})),
q{tag} as (select distinct query_id, unnest({tokens('text')}) as term from ({questions})),
st{tag} as (select count(*)::double as n, avg(len(ts)) as av from u{tag}),
po{tag} as (select unit_id, len(ts) as l, term, count(*)::double as tf from (select unit_id, ts, unnest(ts) as term from u{tag}) group by all),
df{tag} as (select term, count(*)::double as df from po{tag} group by term),
sc{tag} as (select query_id, unit_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * l / av))), 6) as score
  from q{tag} join po{tag} using (term) join df{tag} using (term), st{tag} group by all),
ranked{tag} as (select * from (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from sc{tag} where score > 0) where rank <= {k})"""
