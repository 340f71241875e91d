"""URL filters: host and path rules, then a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import bloom
from touchline.llm.text import ascii_lower, quoted
from touchline.session import stage

_PARTS = r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Parameters that tell where a visitor came from, by the start of their name; a page is the same without them.
TRACKING = "utm_"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without one leading ``www.``, path without closing slashes, and the parameters in order, but for those of tracking; null if
    there is no host. The fragment is left out."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    given = F.split(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.startswith(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), query))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest (host, path, verdict) rule that fits; nulls if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. The rules are settings, tens of them.
    """
    name = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.lit(rule_host + rule_path)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name.otherwise(nothing), verdict.otherwise(nothing))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    blocks: int = bloom.BLOCKS,
) -> DataFrame:
    """One row per page: key, host, path, canonical, rule, listed, verdict (``allow`` or ``block``).

    A rule decides where one fits. Any other url is blocked if its canonical form is among those of the ``url`` column of
    ``listed``. The Bloom filter passes possible hits; only they are shuffled, and an exact join removes the false ones.

    Null or broken urls have an empty host and path, no canonical form, and are allowed. Repeated rows are judged one
    by one. An empty list blocks nothing. Other columns, whatever their names, are ignored. Empty tables give no rows.
    """
    address = F.col(quoted(url))
    forms = stage(listed.select(canonical(address).alias("form")).where("form IS NOT NULL").distinct(), "listed")
    parts = pages.select(F.col(quoted(key)).alias(key), host_of(address).alias("host"), path_of(address).alias("path"), canonical(address).alias("canonical"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select(quoted(key), "host", "path", "canonical", rule.alias("rule"), says.alias("says"))
    open_form = F.when(F.col("rule").isNull(), F.col("canonical"))
    flagged = bloom.flag_hits(parts.withColumn("form", open_form), "form", bloom.build(forms, "form", blocks), "maybe", blocks)
    sure = flagged.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    confirmed = flagged.where("maybe").join(forms.withColumn("found", F.lit(True)), "form", "left")
    confirmed = confirmed.withColumn("listed", F.coalesce(F.col("found"), F.lit(False)))
    columns = [quoted(key), "host", "path", "canonical", "rule", "listed"]
    verdict = F.coalesce(F.col("says"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    return sure.select(*columns, verdict).unionByName(confirmed.select(*columns, verdict))
