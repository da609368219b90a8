"""op6: a verdict for every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.llm.url_filter import judge_urls
from docassay.sources import read_table

NAME = "op6_url_filter"
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SQL = r"""
WITH rules(host_end, path_start, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), split AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parsed AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM split
), judged AS (
  SELECT page_id, any_value(url) AS url, any_value(p.host) AS host, any_value(p.path) AS path,
         arg_max(host_end || path_start, length(host_end || path_start)) AS rule,
         arg_max(verdict, length(host_end || path_start)) AS verdict
  FROM parsed p LEFT JOIN rules r
    ON (p.host = host_end OR ends_with(p.host, '.' || host_end)) AND starts_with(p.path, path_start)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(lower(url),
         '^[^:/?#]*://([^/?#]*\.)?(spam-farm|casino|adserver)\.|/pagead/|/adserver/|/wp-login\.php|-sponsored-links-|\?affiliate_id=.*&click='
       ) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).drop("url")
