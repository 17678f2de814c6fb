"""URL filters: fixed rules, and association rules that FP-growth mines."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK, ALLOW = "block", "allow"
#: Labelled urls that a rule has to block at least, in number and as a share, and the share of those with its tokens.
LEAST_URLS, SUPPORT, CONFIDENCE = 20, 0.0002, 0.8
#: Standard deviations by which a rule's confidence has to stand off the share of urls to block at large.
CERTAINTY = 3.0
#: Rows of the inverted index up to which it is broadcast.
BROADCAST_INDEX = 100_000
_LABEL = "label="


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url: scheme, host labels with their level from
    the right, path words with digits made one sign, query keys, fragment."""
    labels = F.reverse(F.filter(F.split(host_of(url), r"\."), lambda x: x != ""))
    host = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    words = F.filter(F.split(path_of(url), r"[/._~+-]+"), lambda x: x != "")
    path = F.transform(words, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    keys = F.transform(query, lambda x: F.concat(F.lit("query="), F.regexp_extract(x, r"^[^=]*", 0)))
    extra = F.array(
        F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([^:/?#]*)://", 1)),
        F.concat(F.lit("fragment="), F.regexp_extract(url, r"#(.*)", 1)),
    )
    return F.coalesce(F.array_distinct(F.concat(host, path, keys, F.filter(extra, lambda x: ~x.endswith("=")))), F.array())


def mine(
    labelled: DataFrame, url_col: str = "url", label_col: str = "label", support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_URLS
) -> DataFrame:
    """Rows (rule_id, antecedent, confidence, support): token sets whose urls are to be blocked.

    ``label_col`` holds ``block`` or ``allow``; rows with a null label or url
    teach nothing. A rule needs ``least`` urls that it rightly blocks, be the
    table small or large, and a confidence whose lower bound is above the share
    of urls to block at large, so that no rule remembers single rows. A rule is
    left out where one without one of its tokens is as confident. ``support``
    prunes while mining, and bounds the number of frequent tokens by the mean
    number of tokens over it. Without labelled urls there are no rules.
    """
    known = labelled.filter(F.col(label_col).isNotNull() & F.col(url_col).isNotNull())
    baskets = materialize(known.select(F.array_append(tokens_of(F.col(url_col)), F.concat(F.lit(_LABEL), F.col(label_col))).alias("items")), "baskets")
    n, bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", _LABEL + BLOCK))).first()
    if not n:
        return baskets.sparkSession.createDataFrame([], _RULES)
    model = FPGrowth(itemsCol="items", minSupport=max(support, min(1.0, least / n)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.array_contains("consequent", _LABEL + BLOCK))
    # The lower bound of Wilson's interval for the share of a rule's urls that are to be blocked.
    p, m, z = F.col("confidence"), F.round(F.col("support") * n / F.col("confidence")), F.lit(CERTAINTY)
    bound = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    sure = rules.filter(bound > bad / n).select(
        F.concat_ws(" ", F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
    )
    sure = materialize(sure, "sure")
    i = F.explode(F.sequence(F.lit(1), F.size("antecedent")))
    one_less = sure.filter(F.size("antecedent") > 1).select("rule_id", F.col("confidence").alias("own"), "antecedent", i.alias("i"))
    one_less = one_less.select("rule_id", "own", F.array_except("antecedent", F.array(F.element_at("antecedent", F.col("i")))).alias("antecedent"))
    implied = one_less.join(sure.select("antecedent", "confidence"), "antecedent").filter("confidence >= own").select("rule_id")
    return materialize(sure.join(implied, "rule_id", "left_anti"), "rules")


_RULES = "rule_id string, antecedent array<string>, confidence double, support double"


def _fixed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fixed rule that fits, as struct(rule, verdict), or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, mined_rule, confidence), one for each input row.

    ``rules`` are pairs of verdict and ``host/path``. A url that none fits gets
    the verdict of the mined rules: block if the url holds all tokens of one,
    else allow; a null url has no tokens. The rules are matched by an inverted
    index from token to rule, a rule counting as found when as many index rows
    as it has tokens meet in a url. An index too large to broadcast is joined
    by shuffle.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        url.alias("url"),
    ).withColumn("fixed", _fixed(F.col("host"), F.col("path"), rules))
    index = mined.select(F.explode("antecedent").alias("token"), "rule_id", "confidence", F.size("antecedent").alias("needed"))
    if index.count() <= BROADCAST_INDEX:
        index = F.broadcast(index)
    own = ["row", "page_id", "host", "path", "fixed"]
    tokens = rows.select(*own, F.explode_outer(F.when(F.col("fixed").isNull(), tokens_of(F.col("url")))).alias("token"))
    met = tokens.join(index, "token", "left").groupBy(*own, "rule_id", "needed", "confidence").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("n") == F.col("needed"), F.struct("confidence", F.col("rule_id"))))
    found = met.groupBy(*own).agg(best.alias("best")).select(*own, F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("confidence"))
    by_method = F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW)
    return found.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", by_method).alias("verdict"), "mined_rule", "confidence"
    )
