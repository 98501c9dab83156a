"""URL filters: pattern rules indexed by their rarest literal token.

Rules use the filter-list syntax: ``||`` starts at a host or any of its subdomains,
``|`` at either end anchors there, ``^`` is a separator or the end, ``*`` is any run, all
else is literal.  A literal token is a letter-digit run that every match must
contain whole, so one that touches ``*`` or an open end of the rule does not count.
Token counts over all URLs choose each rule's rarest token; URL tokens fetch the
rules filed under them, and only those candidates run their expression.  All
steps are DataFrame operations.

Rules come in two lists.  A host rule (``example.com/en/``, short for
``||example.com/en/``) fits its host and all subdomains when the URL's path starts
with the rule's path; the longest fitting host rule decides.  A pattern rule is asked only
where no host rule fits; the first in list order that matches decides, else ``default``.

Defined cases: a null URL, or one without ``://``, has empty host and path and gets
the default verdict; other columns are not read; rows that repeat are each judged;
an empty table gives an empty result.  Rules are a caller's list of at most ``MAX_RULES``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import read_table

# The contract's rules.
HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Pattern rules of the method, asked where no host rule fits.
PATTERN_RULES = (
    ("block", "||spam-farm."),
    ("block", "||cheap-pills."),
    ("block", "||casino."),
    ("block", "/adult/"),
    ("block", "/phishing/"),
)
DEFAULT = "allow"
MAX_RULES = 100_000
#: A token is a run of these, lower-cased; everything else parts tokens.
TOKEN_BREAK = "[^a-z0-9]+"


def rule_pattern(rule: str) -> str:
    """The regular expression of a rule over host + path."""
    body, head, tail = rule, "", ""
    if body.startswith("||"):
        head, body = r"^([^/]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    special = {"*": ".*", "^": "([^A-Za-z0-9_.%-]|$)"}
    return "(?s)" + head + "".join(special.get(c, re.escape(c)) for c in body) + tail


def literal_tokens(rule: str) -> list[str]:
    """Tokens that every match of the rule holds whole."""
    # a space stands for a closed side, an asterisk for an open one
    closed = ("" if rule.startswith("|") else "*") + rule + ("" if rule.endswith("|") else "*")
    return sorted(set(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", closed.lower())))


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(rule, verdict, pattern, priority, tokens): lower priority decides first."""
    if len(host_rules) + len(pattern_rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    longest = max([len(r) for _, r in host_rules], default=0)
    rows = [(r, v, rule_pattern("||" + r), longest - len(r), literal_tokens("||" + r))
            for v, r in host_rules]
    rows += [(None, v, rule_pattern(r), longest + 1 + i, literal_tokens(r))
             for i, (v, r) in enumerate(pattern_rules)]
    return spark.createDataFrame(
        rows, "rule string, verdict string, pattern string, priority int, tokens array<string>")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("rest", "(?s)^([^/?#]*)", 1)
    tail = F.regexp_extract("rest", "(?s)^[^/?#]*([^?#]*)", 1)
    return (pages.select("page_id", rest.alias("rest"))
            .select("page_id", lower_ascii(host).alias("host"), tail.alias("path")))


def indexed_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """File every rule under its rarest token by the counts of ``tokens`` (one row a URL and
    token); a rule without tokens is filed under the empty token, which every URL has."""
    listed = rules.select("rule", "verdict", "pattern", "priority", F.explode_outer("tokens").alias("token"))
    # only the rules' own tokens are counted, so one row a token leaves each task
    own = listed.select("token").distinct()
    counts = tokens.join(F.broadcast(own), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return (listed.join(counts, "token", "left")
            .groupBy("rule", "verdict", "pattern", "priority")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
            .select("rule", "verdict", "pattern", "priority",
                    F.coalesce("rarest.token", F.lit("")).alias("token")))


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES,
          default: str = DEFAULT) -> DataFrame:
    """Per row: page_id, host, path, rule (the deciding host rule), verdict, n_candidates."""
    parts = url_parts(pages)
    address = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(
        F.array(F.lit("")), F.split(lower_ascii(address), TOKEN_BREAK)))
    rows = parts.withColumn("uid", F.monotonically_increasing_id()).withColumn("address", address)
    exploded = rows.select("uid", "page_id", "host", "path", "address", F.explode(tokens).alias("token"))
    filed = indexed_rules(rule_table(pages.sparkSession, host_rules, pattern_rules),
                          parts.select(F.explode(tokens).alias("token")))
    hits = exploded.join(F.broadcast(filed), "token", "left")  # at most MAX_RULES rows
    fits = F.expr("address RLIKE pattern")
    choice = F.min(F.when(fits, F.struct("priority", "rule", "verdict")))
    return (hits.groupBy("uid", "page_id", "host", "path")
            .agg(choice.alias("c"), F.count("pattern").alias("n_candidates"))
            .select("page_id", "host", "path", F.col("c.rule").alias("rule"),
                    F.coalesce("c.verdict", F.lit(default)).alias("verdict"), "n_candidates"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page's URL judged."""
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _host_case(pick) -> str:
    """CASE over the host rules, longest first."""
    whens = []
    for verdict, rule in sorted(HOST_RULES, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        whens.append(f"WHEN ends_with('.' || host, '.{host}') AND starts_with(path, '/{path}') "
                     f"THEN '{pick(verdict, rule)}'")
    return " ".join(whens)


OP4_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r)
SELECT page_id, host, path,
       CASE {_host_case(lambda v, r: r)} END AS rule,
       CASE {_host_case(lambda v, r: v)}
            WHEN regexp_matches(host || path, '^([^/]*[.])?(spam-farm|cheap-pills|casino)[.]') THEN 'block'
            WHEN contains(host || path, '/adult/') OR contains(host || path, '/phishing/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM p
"""
