"""Judge URLs by rules and by a list of canonical URLs.

Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 12
BLOCK_BITS = 64
PROBES = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without `://`."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without `www.` or `m.`, a page suffix, slashes at the end, query and fragment."""
    return F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html?)?/*$", ""))


def winning_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried last and stands outermost
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The bits of a key inside its block."""
    spread = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for probe in range(PROBES):
        bit = F.shiftright(spread, 6 * probe).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): one 64-bit word for each block that has keys; summed before the shuffle."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed.

    `listed` has one column `key` of canonical URLs, nulls and repeats allowed. The Bloom filter passes
    every listed URL and few others; only what passes is joined with the list itself. A rule's verdict
    stands; else a listed URL is blocked and any other allowed. An empty list blocks nothing; repeated
    pages are judged each. No side is forced to be broadcast: Spark sees the sizes.
    """
    keys = listed.where("key IS NOT NULL").distinct()
    blocks = max(64, keys.count() * BITS_PER_URL // BLOCK_BITS)
    host, path = url_parts(F.col("url"))
    name, verdict = winning_rule(F.col("host"), F.col("path"), rules)
    parts = (
        pages.select("page_id", "url").withColumns({"host": host, "path": path})
        .withColumns({"rule": name, "_verdict": verdict, "key": canonical(F.col("host"), F.col("path"))})
        .withColumn("block", _block(F.col("key"), blocks))
    )
    probed = parts.join(blocked_bloom(keys, blocks), "block", "left").withColumn(
        "possible", F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")), F.lit(False)))
    # What the filter rules out gets a key that spreads and meets nothing in the list.
    probe_key = F.when(F.col("possible"), F.concat(F.lit("="), F.col("key"))).otherwise(
        F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    exact = keys.select(F.concat(F.lit("="), F.col("key")).alias("probe"), F.lit(True).alias("_hit"))
    out = probed.withColumn("probe", probe_key).join(exact, "probe", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_verdict", F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"))


#: Parts of host names that stand for gambling, drugs, adult pages, advertising and spam.
UNWANTED = (
    "ads", "adserver", "adult", "banner", "bet", "bets", "betting", "bingo", "casino", "gambling", "jackpot", "lottery",
    "pharmacy", "pills", "poker", "popunder", "porn", "slots", "spam", "tracker", "viagra", "xxx",
)


def unwanted_hosts(pages: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """The list for the registered query: canonical URLs of hosts with one of `words` among the parts of a label.

    Parts are what dots and hyphens divide. Null URLs and URLs without a host are not listed; no words list nothing.
    """
    host, path = url_parts(F.col("url"))
    unwanted = F.array(*map(F.lit, words)).cast("array<string>")
    return (
        pages.select(host.alias("host"), path.alias("path"))
        .where(F.arrays_overlap(F.split("host", "[.-]"), unwanted))
        .select(canonical(F.col("host"), F.col("path")).alias("key"))
    )
