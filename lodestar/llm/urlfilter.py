"""URL filters: pattern rules found by their rarest literal token.

A rule is an expression over ``host/path`` (or the host alone): ``*`` is any run, ``^`` a separator (an end, or anything but a letter or a
digit), ``|`` at an end anchors it there, ``||`` at the start means a host or any of its subdomains; all else is literal. Its
literal tokens are the runs of letters and digits that it bounds on both sides, so that any URL it fits holds them whole; they are
read from the expression. Of these the one that the fewest of the URLs hold is its index key. A URL's tokens fetch the rules under them,
and only those run as regular expressions. A rule without such a token stands under the empty one, which every URL has. Among fitting
rules the highest rank wins, then the longest rule, then the rule's text.

While the rules number at most ``MOST_MAPPED`` they go to the scan as one map from token to rules, and the pages are not shuffled;
beyond that, distinct URLs are joined with the rules on the token.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule, and gets the default verdict. Repeated rows and
equal URLs are judged alike; rules without an expression fit nothing; without rules all get the default; an empty table gives an empty
result. Extra columns are kept; names that clash with the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns

#: A map's lookup is a scan of its keys, so it holds some hundreds of rules at most.
MOST_MAPPED = 200
#: Literal tokens of all rules that may be broadcast.
MOST_BROADCAST = 100_000
SEPARATOR = r"(?:^|\z|[^A-Za-z0-9])"


@dataclass(frozen=True)
class Rule:
    rule: str
    verdict: str
    expression: str
    rank: int = 0
    host_only: bool = False


def site(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and the start of a path."""
    rule = host + "/" + path.removeprefix("/")
    return Rule(rule, verdict, "||" + rule, 1)


#: The sites to allow and to block.
SITES = (
    site("org", "/", "allow"),
    site("example.org", "/es/", "block"),
    site("example.org", "/en/1", "block"),
    site("com", "/fr/", "allow"),
    site("com", "/de/", "block"),
)
#: What else is blocked where no site rule fits, unless a table of rules is given: words of the host that tell of spam.
SPAM = tuple(Rule(f"^{words}^", "block", f"^{words}^", 0, True) for words in ("spam-farm", "cheap-pills", "casino", "viagra", "porn", "adult", "payday", "warez"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _small(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(host: Column, path: Column) -> Column:
    """The runs of letters and digits, and the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(_small(F.concat_ws("/", host, path)), "[^a-z0-9]+")))


def literal_tokens(expression: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_small(expression), F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))


def pattern(expression: Column) -> Column:
    """The regular expression that a rule's expression stands for."""
    start = F.when(F.startswith(expression, F.lit("||")), r"^(?:[^/]*\.)?").when(F.startswith(expression, F.lit("|")), "^").otherwise("")
    end = F.when(F.endswith(expression, F.lit("|")) & (F.length(expression) > 2), r"\z").otherwise("")

    def meant(c: Column) -> Column:
        return F.when(c == "*", r"[\s\S]*").when(c == "^", SEPARATOR).when(F.rlike(c, F.lit(r"[!-/:-@\[-`{-~]")), F.concat(F.lit("\\"), c)).otherwise(c)

    body = F.transform(F.split(F.regexp_replace(expression, r"^\|\|?|\|$", ""), ""), meant)
    return F.concat(start, F.array_join(body, ""), end)


def rule_table(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """``token`` and a rule each; ``token`` is the rarest of the rule's literal tokens over ``pages(host, path)``, empty if it has none.

    ``rules`` as a table has the columns rule, verdict, expression, rank and host_only.
    """
    if not isinstance(rules, DataFrame):
        rows = [(r.rule, r.verdict, r.expression, r.rank, r.host_only) for r in rules]
        rules = pages.sparkSession.createDataFrame(rows, "rule string, verdict string, expression string, rank int, host_only boolean")
    known = rules.where("expression is not null").select("rule", "verdict", "rank", F.coalesce("host_only", F.lit(False)).alias("host_only"), pattern(F.col("expression")).alias("pattern"), literal_tokens(F.col("expression")).alias("tokens"))
    each = known.select("rule", "verdict", "pattern", "rank", "host_only", F.explode_outer("tokens").alias("token")).na.fill({"token": ""})
    asked = each.select("token").where("token <> ''").distinct()
    held = pages.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    if asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        held = held.join(F.broadcast(asked), "token", "left_semi")
    # Beyond that all tokens are counted: a join before the count would bring a token that most URLs hold to one task.
    held = held.groupBy("token").count()
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token"))
    return each.join(held, "token", "left").groupBy("rule", "verdict", "pattern", "rank", "host_only").agg(rarest.alias("token"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + SPAM, url: str = "url", default: str = "allow", most_mapped: int = MOST_MAPPED) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``by``: site (rank 1), pattern (rank 0) or default."""
    pages = pages.select(columns.row(pages, "host", "path", "rule", "verdict", "by").alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    table = rule_table(pages, rules)
    if table.limit(most_mapped + 1).count() <= most_mapped:
        best = _by_map(pages, table)
    else:
        best = _by_join(pages, table)
    by = F.when(F.col("best").isNull(), "default").when(F.col("best.rank") == 1, "site").otherwise("pattern")
    verdict = F.coalesce("best.verdict", F.lit(default))
    return best.select("page.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))


def _by_map(pages: DataFrame, table: DataFrame) -> DataFrame:
    entry = F.struct("rank", "rule", "verdict", "pattern", "host_only")
    index = table.groupBy("token").agg(F.collect_list(entry).alias("rules")).agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index"))
    found = F.flatten(F.filter(F.transform("url_tokens", lambda t: F.try_element_at("index", t)), lambda x: x.isNotNull()))
    fitting = F.filter(found, lambda r: F.rlike(F.when(r["host_only"], F.col("host")).otherwise(F.col("url_target")), r["pattern"]))
    ranked = F.transform(fitting, lambda r: F.struct(r["rank"].alias("rank"), F.length(r["rule"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    host, path = F.col("host"), F.col("path")
    rows = pages.withColumns({"url_tokens": _tokens(host, path), "url_target": F.concat(host, path)}).join(F.broadcast(index))
    return rows.withColumn("best", F.when(host != "", F.array_max(ranked)))


def _by_join(pages: DataFrame, table: DataFrame) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    urls = pages.where(host != "").select("host", "path").distinct()
    every = not table.where("token = ''").isEmpty()
    keyed = urls.select("host", "path", F.explode(_tokens(host, path)).alias("token")).where((F.col("token") != "") | F.lit(every))
    fits = keyed.join(table, "token").where(F.rlike(F.when(F.col("host_only"), host).otherwise(F.concat(host, path)), F.col("pattern")))
    entry = F.struct("rank", F.length("rule").alias("length"), "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(entry).alias("best"))
    return pages.join(best, ["host", "path"], "left")
