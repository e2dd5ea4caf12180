"""Operator 8, URL filters (native): pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
(``[a-z0-9]+``) that every address it matches must contain. Each rule is filed
under the one of its tokens that the fewest addresses of the table hold; an
address fetches the rules filed under its own tokens and runs those expressions
only. Host rules ("this host, its subdomains, this path") are rules of the same
kind whose weight is their length, so that the longest decides; weight 0 rules
are the method's own patterns, consulted where no host rule fits.

Up to ``MAX_INLINE_RULES`` rules travel inside the plan as one literal map, which
keeps the stage free of shuffles; more rules are joined by token instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are not put into the plan but joined.
MAX_INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``pattern`` (a Java regular expression) is searched in host + path; ``label`` names the rule in results."""

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    label: str | None = None
    weight: int = field(default=0)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """The host and all its subdomains, addresses whose path starts with ``path``."""
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    tokens = tuple(re.findall("[a-z0-9]+", host)) + tuple(re.findall(r"(?<=/)[a-z0-9]+(?=/)", path))
    return Rule(rf"^(?:[^/]*\.)?{quoted}", verdict, tokens, host + path, len(host + path))


def word_rule(*words: str) -> Rule:
    """Blocks addresses with these words in a row, between characters that are no letters or digits."""
    return Rule(rf"(?i)(?:^|[^a-z0-9]){'[^a-z0-9]'.join(words)}(?:[^a-z0-9]|$)", "block", words)


#: Host rules of the production query.
HOST_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)
#: The method's own patterns of the production query: words of spam and adult addresses.
WORD_RULES = tuple(
    word_rule(*words.split())
    for words in ("spam farm", "cheap pills", "online casino", "free casino", "adult video", "xxx", "porn", "viagra", "payday loans", "replica watches", "warez", "torrent download")
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(address, UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))


def token_frequencies(addresses: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many addresses each token of the rules occurs; at most a row a token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held = addresses.select(F.explode(F.array_intersect(tokens_of(F.col("address")), F.lit(wanted))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_by_rarest(rules: list[Rule], frequencies: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, ties to the token first in the alphabet."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"a rule needs a literal token: {rule.pattern}")
        index.setdefault(min(rule.tokens, key=lambda t: (frequencies.get(t, 0), t)), []).append(rule)
    return index


def _literal(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.weight).alias("weight"), F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"),
        F.lit(rule.label).cast("string").alias("label"),
    )


def _best(matched: Column) -> Column:
    """The rule with the most weight; of equals, block before allow."""
    return F.element_at(
        F.array_sort(matched, lambda a, b: F.when(a["weight"] != b["weight"], b["weight"] - a["weight"]).otherwise(
            F.when(a["verdict"] == b["verdict"], 0).when(a["verdict"] == "block", -1).otherwise(1))), 1)


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    A null url, or one without ``://``, has an empty host and path, matches no
    rule and gets ``default``. Repeated rows are judged each for itself; an
    empty table gives an empty result. ``rule`` is the label of the rule that
    decided, null where that rule has none or no rule fits.
    """
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    work = df.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    address = F.concat("host", "path")
    if not rules:
        return work.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    index = index_by_rarest(list(rules), token_frequencies(work.select(address.alias("address")), list(rules)))
    if len(rules) <= max_inline:
        filed = F.create_map(*[x for token, own in sorted(index.items()) for x in (F.lit(token), F.array(*map(_literal, own)))])
        # Only tokens that files exist for are looked up: few addresses get past this intersection.
        keys = F.array_intersect(tokens_of(address), F.lit(sorted(index)))
        candidates = F.flatten(F.transform(keys, lambda t: F.try_element_at(filed, t)))
        matched = F.filter(candidates, lambda r: F.regexp(address, r["pattern"]))
        judged = work.withColumn("__best", F.when(F.size(keys) > 0, _best(F.when(F.size(matched) > 0, matched))))
    else:
        rows = [(t, r.weight, r.pattern, r.verdict, r.label) for t, own in index.items() for r in own]
        filed = df.sparkSession.createDataFrame(rows, "token string, weight int, pattern string, verdict string, label string")
        addressed = work.withColumn("__address", address)
        hits = (
            addressed.select("__address", F.explode(F.array_intersect(tokens_of(F.col("__address")), F.lit(sorted(index)))).alias("token"))
            .join(filed, "token").where(F.regexp(F.col("__address"), F.col("pattern")))
            .groupBy("__address").agg(_best(F.collect_set(F.struct("weight", "pattern", "verdict", "label"))).alias("__best"))
        )
        judged = addressed.join(hits, "__address", "left")
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__best.label").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, [*HOST_RULES, *WORD_RULES]).select("page_id", "host", "path", "rule", "verdict")


_WORDS = " or ".join(f"""regexp_matches(a, '(?i)(^|[^a-z0-9]){'[^a-z0-9]'.join(r.tokens)}([^a-z0-9]|$)')""" for r in WORD_RULES)
OP8_SQL = rf"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(rule, rule_verdict, rule_host, rule_path) as (values
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
judged as (
  select p.page_id, p.host, p.path, p.host || p.path as a,
    (select arg_max(struct_pack(rule := rule, v := rule_verdict), length(rule)) from rules
     where (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)) as best
  from parts p)
select page_id, host, path, best.rule as rule, coalesce(best.v, case when {_WORDS} then 'block' else 'allow' end) as verdict
from judged
"""
