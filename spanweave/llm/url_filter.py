"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern with an action. A URL is cut into tokens (runs of ASCII letters and digits, lower case).
A pattern's literal runs that must be whole tokens of every URL it matches are its tokens; the rule is kept
under the one that the fewest of the table's URLs hold. A URL looks only at the rules under its own tokens, by a
join on the token, and only these rules' regular expressions run. Rules without such a token are kept under the
empty token, which every URL has, so no rule is ever skipped.

Patterns: `*` any characters; `^` a character that is no letter, digit or any of `_ - . %`, or the end; `|` at
either end the URL's start or end; `||` in front the start of a label of the host; all else stands for itself;
letters match in either case. Host rules (host and path in one text, as `example.com/en/`) fit the host and all its
subdomains if the URL's path starts with the rule's; they are kept in the same index.

The longest host rule that fits decides (of equal length the one with the longer host); else an allowing
pattern, else a blocking one (the first in the order of patterns); else the URL is allowed.

URLs are judged once each, however many rows hold them; rows get the verdict by a join on the URL that Spark may
split where many rows share one. The index joins on the token: Spark broadcasts it where it is small.

Defined cases: a null URL is judged as the empty one; host and path of a URL without `://` are empty; an empty
table gives no rows; no rules allow all; rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host rules of the query, with actions.
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Pattern rules of the query: junk hosts and places that hold no prose; patterns with @@ allow.
PATTERNS = (
    "||adult-x.", "||cheap-pills.", "||casino-win.", "||spam-farm.", "||casino.", "||xxx.", "||porn.", "||viagra.",
    "/wp-login.php", "/wp-admin/", "/cart^", "/checkout^", "/cgi-bin/", "/login^", "/signup^", "/tag/", "/search?", "^sessionid=", "^sid=", "^replytocom=",
    ".exe|", ".zip|", ".jpg|", "*.gif|", "||ads.", "||adserver*.", "||tracker.", "/doubleclick/", "-for-sale-*.html|", "|ftp://",
    "@@||wikipedia.org^", "@@||gutenberg.org/*/login^", "@@/robots.txt|",
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_SPECIAL = re.compile(r"[*^|]")
_BORDER = r"(?:[^A-Za-z0-9_.%-]|\z)"


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern, for java.util.regex."""
    head = re.match(r"\|{0,2}", pattern).group()
    body, tail = pattern[len(head) :], ""
    if body.endswith("|"):
        body, tail = body[:-1], r"\z"
    starts = {"": "", "|": r"\A", "||": r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*[.])?"}
    parts = [{"*": ".*", "^": _BORDER}.get(c) or re.sub(r"([^A-Za-z0-9])", r"\\\1", c) if c.isascii() else c for c in body]
    return "(?s)(?i)" + starts[head] + "".join(parts) + tail


def pattern_tokens(pattern: str) -> list[str]:
    """Runs that are whole tokens of every URL that matches: both neighbours are anchors, borders or other literal characters."""
    head = re.match(r"\|{0,2}", pattern).group()
    end = pattern.endswith("|") and len(pattern) > len(head)
    body = pattern[len(head) : len(pattern) - end].lower()
    found = []
    for m in re.finditer(TOKEN, body):
        left = body[m.start() - 1] if m.start() else ("|" if head else "*")
        right = body[m.end()] if m.end() < len(body) else ("|" if end else "*")
        # Letters outside ASCII may match ones inside in either case, as the Kelvin sign does.
        if all(c != "*" and c.isascii() for c in (left, right)):
            found.append(m.group())
    return found


def host_regex(rule: str) -> str:
    """For the host and path in one text, the host in lower case."""
    host, slash, path = rule.partition("/")
    quoted = lambda text: re.sub(r"([^A-Za-z0-9])", lambda m: "\\" + m[0] if m[0].isascii() else m[0], text)
    return r"\A(?:[^/]*[.])?" + quoted(host.translate(str.maketrans(UPPER, LOWER)) + slash + path) + ("" if slash else r"(?:/|\z)")


def host_tokens(rule: str) -> list[str]:
    return pattern_tokens("||" + rule.translate(str.maketrans(UPPER, LOWER)) + ("" if "/" in rule else "^"))


def rules_table(spark: SparkSession, host_rules: tuple = HOST_RULES, patterns: tuple = PATTERNS) -> DataFrame:
    """rule, is_host, action, regex, rank (smaller wins), tokens."""
    rows = [(rule, True, action, host_regex(rule), [-len(rule), -len(rule.partition("/")[0])], host_tokens(rule)) for rule, action in host_rules]
    for k, pattern in enumerate(patterns):
        allow = pattern.startswith("@@")
        bare = pattern[2:] if allow else pattern
        rows.append((pattern, False, "allow" if allow else "block", pattern_regex(bare), [int(not allow), k], pattern_tokens(bare)))
    return spark.createDataFrame(rows, "rule string, is_host boolean, action string, regex string, rank array<int>, tokens array<string>")


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(url), F.lit(f"({TOKEN})"), 1))


def indexed(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """rules with the token that they are kept under: of their tokens the one in the fewest URLs, ties by code point, else the empty one."""
    named = rules.select("rule", "is_host", F.explode("tokens").alias("token")).distinct()
    counts = url_tokens.groupBy("token").agg(F.count("*").alias("n"))  # before any join: a hot token is one row of each task
    rarest = named.join(counts, "token", "left").groupBy("rule", "is_host").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least"))
    return rules.join(rarest, ["rule", "is_host"], "left").select("rule", "is_host", "action", "regex", "rank", F.coalesce("least.token", F.lit("")).alias("token"))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, pattern, verdict of the URLs (distinct, not null) that some rule fits."""
    url_tokens = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    index = stored(indexed(rules, url_tokens))
    asked = urls.select("url", F.explode(F.array_append(tokens_of(F.col("url")), F.lit(""))).alias("token"))
    found = asked.join(index, "token")
    subject = F.when(F.col("is_host"), F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.col("url"))
    hits = found.filter(F.regexp_like(subject, F.col("regex"))).select("url", F.struct(F.col("rank"), "rule", "action").alias("hit"), "is_host")
    best = hits.groupBy("url").agg(F.min(F.when(F.col("is_host"), F.col("hit"))).alias("host"), F.min(F.when(~F.col("is_host"), F.col("hit"))).alias("other"))
    return best.select("url", F.col("host.rule").alias("rule"), F.col("other.rule").alias("pattern"), F.coalesce("host.action", "other.action").alias("verdict"))


def filter_urls(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with url) and host, path, rule (the host rule that decides), pattern (the pattern that fits first) and verdict, in place of own columns of these names.

    Rows travel as one value, so other columns may have any name.
    """
    new = ("host", "path", "rule", "pattern", "verdict")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in new]
    held = rows.select(F.struct(*kept).alias("row"), F.coalesce(F.col("url"), F.lit("")).alias("url"))
    verdicts = judged(stored(held.select("url").distinct()), rules)
    joined = held.join(verdicts, "url", "left")
    return joined.select("row.*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", "pattern", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql_rules() -> str:
    rows = [(rule, True, action, host_regex(rule), -len(rule), -len(rule.partition("/")[0])) for rule, action in HOST_RULES]
    for k, p in enumerate(PATTERNS):
        rows.append((p, False, "allow" if p.startswith("@@") else "block", pattern_regex(p.removeprefix("@@")), int(not p.startswith("@@")), k))
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


OP13_SQL = f"""
WITH rules(name, is_host, action, regex, r1, r2) AS (VALUES {_sql_rules()}),
urls AS (SELECT DISTINCT coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hits AS (SELECT u, is_host, name, action, r1, r2 FROM urls, rules WHERE regexp_matches(CASE WHEN is_host THEN host || path ELSE u END, regex)),
best AS (SELECT u, arg_min(struct_pack(name, action), (r1, r2)) FILTER (is_host) AS h, arg_min(struct_pack(name, action), (r1, r2)) FILTER (NOT is_host) AS p FROM hits GROUP BY u)
SELECT page_id, host, path, h.name AS rule, coalesce(h.action, p.action, 'allow') AS verdict, p.name AS pattern FROM pages JOIN urls ON u = coalesce(url, '') LEFT JOIN best USING (u)
"""
