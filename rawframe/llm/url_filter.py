"""URL filter: rules on hosts and paths, and a classifier for what no rule decides.

Names of hosts run words together. A unigram model of words, counted over the pages' own texts, splits
them: of all ways to cut a run of letters the likeliest is taken (Viterbi). Only the words that a
name can hold are looked up: the distinct runs of letters are exchanged as substrings and joined with
the counts. Multinomial naive Bayes, fitted on the addresses that rules decide, then scores the host's
words and the path's tokens. Weights are whole numbers (millionths), so sums don't depend on order.

Addresses are reduced to distinct hosts and distinct token lists of paths before anything is split or scored,
so a host that a third of all pages have is split once; rows only meet the results, in joins that
Spark can split.

Defined results: a null url, or one without `://`, has an empty host and path; it has no tokens, so the
classes' shares decide; a score of 0, as without any decided address, allows; of rules that fit the one
with the longest host and path together wins, then the one that sorts first; of equally likely cuts the one with the fewest
words is taken, then the one whose last words are longest; null html has no words; repeated rows count as often as they
stand; an empty table gives no rows; extra columns go through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stage_table

#: (verdict, rule): a rule is a host and the path from its first slash on. They are put into the plan, so there are some hundreds at most.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MOST_RULES = 1_000
#: Longer runs of letters are no single word.
WORD_LETTERS = 24
#: Weights and costs are natural logarithms in millionths.
UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The rule that fits best, as struct(rule, verdict); null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def path_tokens(path: Column) -> Column:
    """The path's runs of letters, and `#` for each number, in order, as one text."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(lowered(path), "[0-9]+", "#"), F.lit("([a-z]+|#)"), F.lit(1)), " ")


def count_words(texts: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): the words of letters a to z in the visible text of pages."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(html, "<[^>]*+>", " ")), F.lit(f"(?<![a-z])([a-z]{{2,{WORD_LETTERS}}})(?![a-z])"), F.lit(1))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def cost(n: Column, total: int) -> Column:
    return F.round(-F.log(n / F.lit(float(max(total, 1)))) * UNIT).cast("bigint")


def unknown_cost(letters: int, total: int) -> int:
    """Of a run of letters that is no word: ten times less likely with each letter."""
    return round((math.log(max(total, 1)) + (letters - 1) * math.log(10)) * UNIT)


def best_cut(run: str, costs: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of a run, given the costs of known words by (start, length)."""
    other = [unknown_cost(k, total) for k in range(WORD_LETTERS + 1)]
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for end in range(1, len(run) + 1):
        best.append(min((best[start][0] + costs.get((start, end - start), other[end - start]), best[start][1] + 1, start) for start in range(max(0, end - WORD_LETTERS), end)))
    words, end = [], len(run)
    while end:
        start = best[end][2]
        words.append(run[start:end])
        end = start
    return words[::-1]


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words): each distinct run of letters with the words it is cut into, joined by spaces."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    runs = runs.select("run").distinct()
    length, start = F.length("run"), F.col("start")
    begun = runs.select("run", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    parts = begun.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD_LETTERS), length - start + 1))).alias("letters"))
    named = parts.withColumn("word", F.substring("run", F.col("start"), F.col("letters"))).where("letters > 1")
    known = named.join(counts, "word").select("run", (start - 1).alias("start"), "letters", cost(F.col("n"), total).alias("cost"))
    found = known.groupBy("run").agg(F.collect_list(F.struct("start", "letters", "cost")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(best_cut(r, {(x["start"], x["letters"]): x["cost"] for x in f or ()}, total)) for r, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], ["run", "words"])

    return map_arrow(runs.join(found, "run", "left"), run, "run string, words string")


def split_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_words): each host of the table of distinct hosts with the words of its names, in order."""
    placed = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("([a-z]+)"), F.lit(1))).alias("at", "run"))
    words = placed.join(split_runs(placed, counts), "run").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return hosts.join(words, "host", "left").select("host", F.coalesce(F.array_join(F.col("all.words"), " "), F.lit("")).alias("host_words"))


def weights(decided: DataFrame) -> tuple[DataFrame, int]:
    """(token, weight), and the prior: what each token adds to the logarithm of block against allow. decided: (tokens array, verdict, n)."""
    classes = {r["verdict"]: r for r in decided.groupBy("verdict").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.size("tokens")).alias("tokens")).collect()}
    shares = [(classes[v]["n"] if v in classes else 0) + 1 for v in ("block", "allow")]
    counts = decided.select(F.explode("tokens").alias("token"), "verdict", "n").groupBy("token").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")))
    counts = stage_table(counts, "tokens")
    kinds = counts.count()
    blocked, allowed = ((classes[v]["tokens"] if v in classes else 0) + kinds for v in ("block", "allow"))
    weight = F.round((F.log((F.col("block") + 1) / F.lit(float(max(blocked, 1)))) - F.log((F.col("allow") + 1) / F.lit(float(max(allowed, 1))))) * UNIT)
    return counts.select("token", weight.cast("bigint").alias("weight")), round((math.log(shares[0]) - math.log(shares[1])) * UNIT)


def marked(words: str, kind: str) -> Column:
    """Tokens of a list of words, marked by where they come from."""
    return F.transform(F.filter(F.split(words, " "), lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))


def token_scores(lists: DataFrame, name: str, tokens: Column, weighed: DataFrame) -> DataFrame:
    """(name, score): the sum of the weights of each distinct list's tokens; unknown tokens add nothing."""
    return lists.select(name, F.explode(tokens).alias("token")).join(weighed, "token").groupBy(name).agg(F.sum("weight").alias(f"{name}_score"))


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """(row, host, path, rule, verdict, score, host_words): the rows of pages as a struct with what is judged of their addresses;
    score is the classifier's (null where a rule decides)."""
    own = [F.col(c) for c in pages.columns if c != html]
    cut = pages.select(F.struct(*own).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = cut.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).select("row", "host", "path", "found.rule", "found.verdict", path_tokens(F.col("path")).alias("path_words"))
    kinds = stage_table(judged.groupBy("host", "path_words", "verdict").agg(F.count("*").alias("n")), "addresses")
    hosts = stage_table(split_hosts(kinds.select("host").distinct(), stage_table(count_words(pages, html), "words")), "hosts")

    decided = kinds.where("verdict IS NOT NULL").join(hosts, "host").select(F.concat(marked("host_words", "h:"), marked("path_words", "p:")).alias("tokens"), "verdict", "n")
    weighed, prior = weights(decided)
    host_scores = token_scores(hosts, "host", marked("host_words", "h:"), weighed)
    path_scores = token_scores(kinds.where("verdict IS NULL").select("path_words").distinct(), "path_words", marked("path_words", "p:"), weighed)
    scored_hosts = hosts.join(host_scores, "host", "left").select("host", "host_words", F.coalesce("host_score", F.lit(0)).alias("host_score"))

    by_rule = judged.where("verdict IS NOT NULL").join(hosts, "host").withColumn("score", F.lit(None).cast("bigint"))
    score = F.col("host_score") + F.coalesce("path_words_score", F.lit(0)) + F.lit(prior)
    open_rows = judged.where("verdict IS NULL").join(scored_hosts, "host").join(path_scores, "path_words", "left").withColumn("score", score)
    open_rows = open_rows.withColumn("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    columns = ["row", "host", "path", "rule", "verdict", "score", "host_words"]
    return by_rule.select(*columns).unionByName(open_rows.select(*columns))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtered(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "host", "path", "rule", "verdict", "score", "host_words")
