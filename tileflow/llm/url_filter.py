"""URL verdicts: host and path rules first, a character language-model ratio for the rest.

DataFrame expressions only. Two variable-order Markov models, of the urls that the rules accept and of those
that they reject, are count tables of character n-grams. Each order is smoothed with the next lower one, so an
unseen context falls back to a shorter one. A url is judged by the difference of its log-likelihoods under the
two models, divided by its length and compared with a threshold calibrated on the urls that rules decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.llm.exact_dedup import ascii_lower
from tileflow.llm.folders import stored

START, END = "\x02", "\x03"  # characters that stand before and after a url


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # lower case; fits this host and all hosts below it
    path: str  # fits urls whose path starts with it

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url and for one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), F.coalesce(path, F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    same = (host == rule.host) | host.endswith("." + rule.host)
    return same & path.startswith(rule.path)


def first_fitting(rules: Sequence[Rule], host: Column, path: Column, field: str) -> Column:
    """The name or verdict of the longest rule that fits, else null; of equal lengths the first given."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    tests = [F.when(fits(r, host, path), F.lit(getattr(r, field))) for r in ordered]
    return F.coalesce(F.lit(None).cast("string"), *tests)


def grams(url: Column, order: int) -> Column:
    """The n-gram that ends at each character of the url and at its end, as one array."""
    padded = F.concat(F.lit(START * (order - 1)), F.coalesce(url, F.lit("")), F.lit(END))
    places = F.sequence(F.lit(1), F.length(padded) - F.lit(order - 1))
    return F.transform(places, lambda i: F.substring(padded, i, F.lit(order)))


def log_ratios(counts: DataFrame, order: int, strength: float, alphabet: int) -> DataFrame:
    """gram, ratio: difference of the two models' log-probabilities of each gram's last character.

    ``counts`` has gram, accepted, rejected. p_k = (n(context, c) + strength * p_(k-1)) / (n(context) + strength)
    for contexts of k characters, from p = 1 / alphabet; an unseen context leaves p_(k-1) unchanged.
    """
    table = counts.withColumns({f"p_{side}": F.lit(1.0 / alphabet) for side in ("accepted", "rejected")})
    for k in range(order):
        longer = F.substring("gram", order - k, k + 1)
        context = F.substring("gram", order - k, k)
        level = counts.groupBy(longer.alias("own")).agg(
            F.sum("accepted").alias("n_accepted"), F.sum("rejected").alias("n_rejected")
        )
        total = counts.groupBy(context.alias("before")).agg(
            F.sum("accepted").alias("t_accepted"), F.sum("rejected").alias("t_rejected")
        )
        table = table.join(level, longer == F.col("own")).join(total, context == F.col("before"))
        table = table.select(
            "gram",
            "accepted",
            "rejected",
            *[
                ((F.col(f"n_{s}") + strength * F.col(f"p_{s}")) / (F.col(f"t_{s}") + strength)).alias(f"p_{s}")
                for s in ("accepted", "rejected")
            ],
        )
    return table.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = 4,
    strength: float = 2.0,
    alphabet: int = 256,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (log-likelihood ratio per character).

    The models learn from all urls that a rule decides; the threshold is the middle between the mean scores of
    the accepted and the rejected ones, 0 if either is missing. At or above it a page without a rule is allowed.
    Defined cases: a null or empty url has empty parts and is scored as the empty text; equal urls get equal
    verdicts; pages without an id and repeated pages are judged like others; other columns are not read.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    ruled = parts.select(
        "*",
        first_fitting(rules, F.col("host"), F.col("path"), "name").alias("rule"),
        first_fitting(rules, F.col("host"), F.col("path"), "verdict").alias("ruled"),
    )
    urls = stored(ruled.withColumn("row", F.monotonically_increasing_id()), "urls")  # the number is fixed when written
    places = urls.select("row", "ruled", F.explode(grams(F.col("url"), order)).alias("gram"))
    counts = stored(
        places.groupBy("gram").agg(
            F.count_if(F.col("ruled") == "allow").alias("accepted"), F.count_if(F.col("ruled") == "block").alias("rejected")
        ),
        "grams",
    )
    ratios = stored(log_ratios(counts, order, strength, alphabet), "ratios")
    # A frequent gram stands in many urls; Spark splits its rows, since both sides of the join are plain tables.
    sums = places.select("row", "gram").join(ratios, "gram").groupBy("row").agg(F.sum("ratio").alias("sum"))
    length = F.length(F.coalesce("url", F.lit(""))) + 1
    scored = stored(urls.join(sums, "row").withColumn("score", F.round(F.col("sum") / length, 9)), "scores")
    middle = scored.agg(
        ((F.avg(F.when(F.col("ruled") == "allow", F.col("score"))) + F.avg(F.when(F.col("ruled") == "block", F.col("score")))) / 2).alias("m")
    ).first()["m"]
    learned = F.when(F.col("score") >= F.lit(round(middle, 9) if middle is not None else 0.0), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
