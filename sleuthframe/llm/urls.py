"""URL filters: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.decontam import small
from sleuthframe.plans.lineage import materialise

#: Longest context in characters.
ORDER = 4
#: Keys with more than this share of a join's rows are joined by broadcast, of which there are at most 1 / HOT; all others are shuffled.
HOT = 1e-3
#: Share of different held-out accepted URLs that may be blocked; it sets the threshold.
FALSE_BLOCKS = 0.005
#: One URL in FOLDS is held out of the final counts and calibrates the threshold; sites are scored by the other folds when labels are revised.
FOLDS = 5
#: A URL without a seed counts as rejected if it scores as this share of those with one do, or higher.
LIKE_SEEDS = 0.75
#: Host words that mark an unruled URL as rejected when the models are first fitted.
SEEDS = ("ads", "adult", "banner", "bet", "bets", "bonus", "casino", "cheap", "click", "free", "loan", "pills", "poker", "porn", "promo", "spam", "track", "tracker", "viagra", "win", "xxx")
BEGIN, END = "^", "$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, parts, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` that fits, as struct(size, rule, action); null if none does.

    A rule is ``(action, "host/path")``. It fits its host and all subdomains
    where the path starts with the rule's. Rules are an argument, written by
    hand; they stand in the plan, and no row is joined to find its rule.
    """
    each = []
    for action, rule in rules:
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        each.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.array_max(F.array_compact(F.array(*each)))


def spelling(host: Column, path: Column) -> Column:
    """What the models read: host and path, digits as 0, in BEGIN and END."""
    return F.concat(F.lit(BEGIN), F.regexp_replace(F.lower(F.concat(host, path)), r"\p{N}", "0"), F.lit(END))


def pairs_of(spelled: DataFrame, most: Column) -> DataFrame:
    """A row per character after BEGIN: all columns but ``spelling``, and ``context``, the ``most`` characters before it or what there is of them, and ``next``."""
    at = spelled.select("*", F.explode(F.sequence(F.lit(2), F.length("spelling"))).alias("i")).withColumn("size", F.least(most, F.col("i") - 1))
    context = F.substr("spelling", F.col("i") - F.col("size"), F.col("size"))
    return at.withColumns({"context": context, "next": F.substr("spelling", F.col("i"), F.lit(1))}).drop("spelling", "i", "size")


def pair_counts(urls: DataFrame) -> DataFrame:
    """``fold, size, context, next, rejected, accepted``: how often in either class each character follows each context of 0 to ORDER characters.

    Each of ``urls`` (``spelling, rejected, n, folds``) counts in all of its ``folds``.
    """
    whole = pairs_of(urls.select("rejected", "spelling", "n", "folds"), F.lit(ORDER)).groupBy("rejected", "folds", "context", "next").agg(F.sum("n").alias("n"))
    sized = whole.select("rejected", "next", "n", "context", "folds", F.explode(F.sequence(F.lit(0), F.length("context"))).alias("size")).withColumn("fold", F.explode("folds"))
    count = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
    return sized.groupBy("fold", "size", F.right("context", F.col("size")).alias("context"), "next").agg(count(F.col("rejected")).alias("rejected"), count(~F.col("rejected")).alias("accepted"))


class MarkovModel:
    """Variable-order Markov model in plain Python: Witten-Bell mixing over all contexts; tests hold ``pair_gains`` against it."""

    def __init__(self, pairs: pd.DataFrame):
        self.next: dict[str, dict[str, int]] = {}
        for context, char, n in zip(pairs["context"], pairs["next"], pairs["n"], strict=True):
            self.next.setdefault(context, {})[char] = int(n)
        self.total = {c: sum(d.values()) for c, d in self.next.items()}

    def probability(self, context: str, char: str) -> float:
        p = 1 / 256
        for k in range(len(context) + 1):
            seen = self.next.get(context[len(context) - k :])
            if seen is None:
                break
            kinds, total = len(seen), self.total[context[len(context) - k :]]
            p = (seen.get(char, 0) + kinds * p) / (total + kinds)
        return p


class Ratio:
    """Log-likelihood difference of two models a character."""

    MOST_KNOWN = 200_000

    def __init__(self, rejected: MarkovModel, accepted: MarkovModel):
        self.rejected, self.accepted, self.known = rejected, accepted, {}

    def gain(self, context: str, char: str) -> float:
        key = context + char
        value = self.known.get(key)
        if value is None:
            value = math.log(self.rejected.probability(context, char) / self.accepted.probability(context, char))
            if len(self.known) < self.MOST_KNOWN:
                self.known[key] = value
        return value

    def score(self, spelled: str) -> float:
        """Above 0: likelier among the rejected."""
        return sum(self.gain(spelled[max(0, i - ORDER) : i], spelled[i]) for i in range(1, len(spelled))) / max(1, len(spelled) - 1)


def pair_gains(used: DataFrame, counts: DataFrame) -> DataFrame:
    """``used`` (distinct ``fold, context, next``, and more) with ``gain``: the log of the two classes' probabilities' ratio.

    Orders are mixed from the shortest up, each by a join with all counts of that
    order; a context that a class hasn't seen leaves its probability as it is.
    """
    flags = ("rejected", "accepted")
    sums = [f(flag).alias(f"{name}_{flag}") for flag in flags for f, name in ((F.sum, "total"), (lambda c: F.count_if(F.col(c) > 0), "kinds"))]
    contexts = materialise(counts.groupBy("fold", "size", "context").agg(*sums))
    rows = used.withColumns({f"p_{flag}": F.lit(1 / 256) for flag in flags})
    for k in range(ORDER + 1):
        rows = rows.withColumn("suffix", F.when(F.length("context") >= k, F.right("context", F.lit(k))))
        around = contexts.where(F.col("size") == k).drop("size").withColumnRenamed("context", "suffix")
        seen = counts.where(F.col("size") == k).drop("size").withColumnRenamed("context", "suffix")
        rows = rows.join(small(around, "suffix"), ["fold", "suffix"], "left").join(small(seen, "suffix", "next"), ["fold", "suffix", "next"], "left")
        mixed = {f"p_{f}": F.when(F.col(f"total_{f}") > 0, (F.coalesce(f, F.lit(0)) + F.col(f"kinds_{f}") * F.col(f"p_{f}")) / (F.col(f"total_{f}") + F.col(f"kinds_{f}"))).otherwise(F.col(f"p_{f}")) for f in flags}
        rows = rows.select(*used.columns, *[p.alias(name) for name, p in mixed.items()])
    return rows.select(*used.columns, F.log(F.col("p_rejected") / F.col("p_accepted")).alias("gain"))


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the ``value`` of their ``keys``, which all stand once in ``values``, ``n`` being how many rows have them."""
    limit = HOT * (values.agg(F.sum("n")).first()[0] or 0)
    hot = values.where(F.col("n") > limit).select(*keys, F.col(value).alias("hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("hot is null").drop("hot").join(values.where(F.col("n") <= limit).select(*keys, value), keys)
    return marked.where("hot is not null").withColumnRenamed("hot", value).unionByName(cold)


def scores(spelled: DataFrame, learned: DataFrame) -> DataFrame | None:
    """Distinct ``spelled`` (``spelling, fold, n``) with ``score``, above 0 if likelier among the rejected of its fold's ``learned`` (see ``pair_counts``).

    None if either class is empty. All counts are tables and stay so. Gains are
    added as decimals, so that their order doesn't matter.
    """
    counts = materialise(pair_counts(learned))
    if not all(counts.where("size = 0").agg(F.coalesce(F.sum("rejected"), F.lit(0)), F.coalesce(F.sum("accepted"), F.lit(0))).first()):
        return None
    spelled = materialise(spelled.withColumn("key", F.monotonically_increasing_id()))
    pairs = pairs_of(spelled.select("key", "fold", "spelling"), F.lit(ORDER))
    gains = materialise(pair_gains(pairs.groupBy("fold", "context", "next").agg(F.count(F.lit(1)).alias("n")), counts))
    sums = looked_up(pairs, gains, ["fold", "context", "next"], "gain").groupBy("key").agg(F.sum(F.col("gain").cast("decimal(20,15)")).alias("sum"))
    return spelled.join(sums, "key").drop("key").withColumn("score", F.col("sum").cast("double") / (F.length("spelling") - 1)).drop("sum")


def site(host: Column) -> Column:
    """The longest label of a host, digits as 0: what its subdomains and endings share."""
    labels = F.transform(F.split(F.regexp_replace(host, r"\p{N}", "0"), r"\."), lambda x: F.struct(F.length(x).alias("size"), x.alias("label")))
    return F.array_max(labels)["label"]


def revised(labelled: DataFrame) -> DataFrame:
    """``labelled`` (``spelling, site_fold, rejected, n``) with ``rejected`` true as well for what scores like the seeds' URLs.

    Every site is scored by models that were fitted without it, so a site without
    a seed is judged by what it has in common with the others of either class.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: f != F.col("site_fold"))
    found = scores(labelled.withColumnRenamed("site_fold", "fold"), labelled.withColumn("folds", others))
    if found is None:
        return labelled
    found = materialise(found)
    bar = max(0.0, found.where("rejected").agg(F.percentile_approx("score", 1 - LIKE_SEEDS, 10000)).first()[0] or 0.0)
    return found.select("spelling", (F.col("rejected") | (F.col("score") > bar)).alias("rejected"), "n")


def judge(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """A verdict on every row's ``url``: ``page_id, host, path, rule, score, verdict``.

    ``pages`` needs ``page_id`` and ``url``; other columns are ignored. The
    longest fitting rule decides. Any other URL gets the length-normalised log
    likelihood difference of two Markov models, and is blocked above a threshold
    that blocks FALSE_BLOCKS of held-out accepted ones. The models are fitted on
    the URLs without a rule: first, rejected are those with a seed among their
    host's words and accepted all others; then also those that models of other
    sites score like them. Where one class is empty nothing is blocked but by
    rule. Null urls and urls without ``://`` have an empty host and path;
    repeated rows get equal verdicts; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("spelling", spelling(F.col("host"), F.col("path")))
    seeded = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(s) for s in seeds]).cast("array<string>"))
    free = split.where("found is null and host <> ''").withColumn("site_fold", F.pmod(F.xxhash64(site(F.col("host"))), F.lit(FOLDS)).cast("int"))
    labelled = materialise(revised(materialise(free.groupBy("spelling", "site_fold").agg(F.max(seeded).alias("rejected"), F.count(F.lit(1)).alias("n")))))
    labelled = labelled.withColumn("held", F.pmod(F.xxhash64("spelling"), F.lit(FOLDS)) == 0)
    every = split.groupBy("spelling").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", F.lit(0))
    found = scores(every, labelled.where("not held").withColumn("folds", F.array(F.lit(0))))
    if found is None:
        scored = split.withColumn("score", F.lit(0.0))
        limit = math.inf
    else:
        found = materialise(found)
        clean = found.drop("n").join(labelled.where("held and not rejected"), "spelling")
        limit = max(0.0, clean.agg(F.percentile_approx("score", 1 - FALSE_BLOCKS, 10000)).first()[0] or 0.0)
        scored = looked_up(split, found, ["spelling"], "score")
    verdict = F.coalesce(F.col("found.action"), F.when((F.col("score") > limit) & (F.col("host") != ""), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), "score", verdict.alias("verdict"))
