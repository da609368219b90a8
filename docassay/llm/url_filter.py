"""URL filters: pattern rules indexed by their rarest literal token.

A rule's literal tokens are runs of a-z and 0-9 that must stand whole in every
URL it fits. Each rule is filed under the one that the fewest URLs hold. A URL's
own tokens fetch the candidate rules from that index, and only these run their
regular expressions. Judging is one projection: no shuffle, no Python.

Two kinds of rules: host rules ("example.org/es/": the host, its subdomains and
a start of the path), of which the longest that fits decides; and patterns over
the whole URL in lower case ("||name." anchors at a host label, "*" is any run,
"^" is a separator or the end), which block where no host rule fits.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
_TOKEN = r"[a-z0-9]+"
_RULE = "array<struct<token: string, regex: string, on_url: boolean, block: boolean, text: string, length: int>>"

#: Patterns that block where no host rule fits; a parameter, kept small here.
DEFAULT_PATTERNS = (
    "||spam-farm.",
    "||casino.",
    "||adserver.",
    "/pagead/",
    "/adserver/",
    "/wp-login.php",
    "-sponsored-links-",
    "?affiliate_id=*&click=",
)


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else "\\x{%x}" % ord(c) for c in text)


def _lower(text: str) -> str:
    return text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))


def host_rule(text: str, block: bool) -> dict:
    """"host/path" as a rule over host + path; the last word of the path may go on in the URL."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = [*re.findall(_TOKEN, _lower(host)), *re.findall(_TOKEN + "(?![a-z0-9]|$)", _lower(path))]
    return {
        "regex": rf"^(?:[^/]*\.)?{_escaped(_lower(host))}{_escaped(path) or '(?:/|$)'}",
        "tokens": whole,
        "on_url": False,
        "block": block,
        "text": text,
        "length": len(text),
    }


def pattern_rule(text: str) -> dict:
    """A blocking pattern over the whole URL in lower case."""
    anchored = text.startswith("||")
    body = _lower(text[2:] if anchored else text)
    regex = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c) or _escaped(c) for c in body)
    bounded = f"^{body}" if anchored else f"*{body}"
    tokens = [m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", bounded + "*")]
    return {
        "regex": (r"^[^:/?#]*://(?:[^/?#]*\.)?" if anchored else "") + regex,
        "tokens": tokens,
        "on_url": True,
        "block": True,
        "text": text,
        "length": len(text),
    }


def token_counts(pages: DataFrame, rules: Iterable[dict], url_col: str = "url") -> dict[str, int]:
    """URLs that hold each token of the rules; a row a token of a rule comes to the driver, whatever the table's size."""
    wanted = sorted({t for r in rules for t in r["tokens"]})
    if not wanted:
        return {}
    known = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))  # tokens of the rules
    held = pages.select(F.explode(_tokens(F.col(url_col))).alias("token"))
    return {r[0]: r[1] for r in held.join(known, "token", "left_semi").groupBy("token").count().collect()}


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, ascii_uppercase, ascii_lowercase), F.lit(f"({_TOKEN})")))


def token_index(rules: Iterable[dict], counts: dict[str, int] | None = None) -> tuple[dict[str, list[dict]], list[dict]]:
    """Rules by rarest token and those without one. Rarest: in `counts`, then among the rules, then the longer, then the first in order."""
    rules, counts = list(rules), counts or {}
    shared = Counter(t for r in rules for t in set(r["tokens"]))
    filed, loose = {}, []
    for r in rules:
        if r["tokens"]:
            token = min(set(r["tokens"]), key=lambda t: (counts.get(t, 0), shared[t], -len(t), t))
            filed.setdefault(token, []).append(r)
        else:
            loose.append(r)
    return filed, loose


def _literal(rules: list[tuple[str, dict]]) -> list[dict]:
    keys = ("regex", "on_url", "block", "text", "length")
    return [{"token": token} | {k: r[k] for k in keys} for token, r in rules]


def _bucket(token: str) -> int:
    value = 0
    for c in token.encode():
        value = (value * 31 + c) % 65521
    return value % BUCKETS


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def judge_urls(
    pages: DataFrame,
    host_rules: Iterable[tuple[str, str]],
    patterns: Iterable[str] = DEFAULT_PATTERNS,
    url_col: str = "url",
) -> DataFrame:
    """`pages` with host, path, rule, verdict (in place of columns of that name).

    `host_rules`: (allow or block, "host/path"). The longest that fits gives the
    verdict, and its text the rule; of equally long ones a blocking one wins. A
    url that none fits is blocked if a pattern fits, else allowed, with a null
    rule. A null url, or one without "://", has an empty host and path; patterns
    still see its text. Repeated rows are judged one by one. The rules' tokens
    are counted in all urls first. Rules travel in the plan; the number of
    candidates of a url does not grow with that of rules.
    """
    rules = [*(host_rule(text, action == "block") for action, text in host_rules), *map(pattern_rule, patterns)]
    filed, loose = token_index(rules, token_counts(pages, rules, url_col))
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for token, found in filed.items():
        buckets[_bucket(token)] += _literal([(token, r) for r in found])
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<{_RULE}>")
    always = F.from_json(F.lit(json.dumps(_literal([("", r) for r in loose]))), _RULE)

    base = pages.drop("host", "path", "rule", "verdict")
    url = F.coalesce(F.col(url_col), F.lit(""))
    parsed = base.withColumns({"host": url_host(url), "path": url_path(url)}).withColumns(
        {
            "__url": F.translate(url, ascii_uppercase, ascii_lowercase),
            "__place": F.concat("host", "path"),
        }
    )
    def bucket(token: Column) -> Column:
        bytes_of = F.split(token, "")
        return F.aggregate(
            bytes_of, F.lit(0), lambda v, c: F.pmod(v * 31 + F.ascii(c), F.lit(65521)), lambda v: F.pmod(v, F.lit(BUCKETS))
        )

    fetched = parsed.withColumn("__tokens", _tokens(F.col("__url"))).withColumn(
        "__rules",
        F.concat(
            always,
            F.flatten(
                F.transform(
                    "__tokens", lambda t: F.filter(F.get(index, bucket(t)), lambda r: r["token"] == t)
                )
            ),
        ),
    )
    fitting = fetched.withColumn(
        "__fit",
        F.filter(
            "__rules",
            lambda r: F.regexp_like(F.when(r["on_url"], F.col("__url")).otherwise(F.col("__place")), r["regex"]),
        ),
    )
    hosts = F.filter("__fit", lambda r: ~r["on_url"])
    decided = fitting.withColumns(
        {
            "__best": F.array_max(F.transform(hosts, lambda r: F.struct(r["length"], r["block"], r["text"].alias("text")))),
            "__pattern": F.exists("__fit", lambda r: r["on_url"]),
        }
    )
    blocked = F.coalesce(F.col("__best.block"), F.col("__pattern"))
    return decided.select(
        *base.columns,
        "host",
        "path",
        F.col("__best.text").alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
    )
