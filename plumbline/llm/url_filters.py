"""URL filters: rules first, then word segmentation of the host and naive Bayes over host and path tokens.

Host labels such as "freeshoes" are split by a unigram Viterbi over word counts of the pages; a multinomial
naive Bayes, trained on the urls that a rule decides, judges the others.

Defined results. A null url, or one without "://", has an empty host and path; no rule fits an empty host and
the method judges it by the class priors. Repeated rows are judged alike. With no rule-decided url at all every
other url is allowed. Ties between rules of one length go to the one listed first. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

#: Rules written as literal expressions; longer lists are joined as a table.
MAX_INLINE_RULES = 200
#: Words of up to so many letters are looked up as substrings of a label, longer ones by their first so many letters.
STEM = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host between "://" and / ? # or the end, path from there up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are (text, verdict) like ("net/de/", "allow")."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):  # the last one that fits wins: the first listed of a length
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows(host, path, ...) plus rule and verdict. Many rules become a table that meets the ends of the hosts, with the same results."""
    if len(rules) <= MAX_INLINE_RULES:
        rows = rows.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
        return rows.select("*", "hit.rule", "hit.verdict").drop("hit")
    table = rows.sparkSession.createDataFrame([(*t.partition("/")[::2], t, v, i) for i, (t, v) in enumerate(rules)], "name string, start string, rule string, verdict string, i int")
    ends = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.array_join(F.slice(ends, i, F.size(ends)), "."))
    met = rows.select("host", "path").distinct().withColumn("name", F.explode(ends)).join(table, "name")
    met = met.where(F.col("path").startswith(F.concat(F.lit("/"), "start")))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), -F.col("i"))).alias("hit"))
    return rows.join(best, ["host", "path"], "left").select(*[rows[c] for c in rows.columns], "hit.rule", "hit.verdict")


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): letters-only words of the visible text of all pages, lower-cased, of two letters or more."""
    text = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, starts: np.ndarray, lengths: np.ndarray, logs: np.ndarray, total: int) -> list[str]:
    """The most probable split of label; the arrays list the known substrings.

    An unseen piece of any length is ten times rarer with each letter: its best start is the running maximum of what
    leads up to it, so a label costs its letters and its known substrings. At a tie the shorter last piece wins.
    """
    n, letter, first = len(label), np.log(10.0), -np.log(total + 1.0)
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, int)
    best[0] = 0
    known: dict[int, list[tuple[int, float]]] = {}
    for s, w, g in zip(starts, lengths, logs, strict=True):
        known.setdefault(s + w, []).append((s, g))
    ahead, at = -np.inf, 0  # the largest of best[i] + i * letter, and its i
    for j in range(1, n + 1):
        if best[j - 1] + (j - 1) * letter >= ahead:
            ahead, at = best[j - 1] + (j - 1) * letter, j - 1
        best[j], back[j] = max([(ahead - j * letter + first, at), *((best[s] + g, s) for s, g in known.get(j, ()))])
    out = []
    while n:
        out.append(label[back[n] : n])
        n = back[n]
    return out[::-1]


def segment_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words): Viterbi split of every distinct label; nothing but matching substrings is gathered per label.

    Substrings of up to STEM letters meet the counts in an equi-join, distinct ones first, so a substring common to all
    labels costs one row there, and the join back is one that adaptive execution can split. Longer words meet
    the labels by their first STEM letters and are then compared whole: words and labels may have any length.
    """
    counts = materialize(counts, "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    labels = labels.select("label").where("label is not null and label <> ''").distinct()
    at = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("s"))
    at = at.select("label", "s", F.explode(F.sequence(F.lit(2), F.lit(STEM))).alias("w")).where("s + w <= length(label) + 1")
    parts = at.select("label", (F.col("s") - 1).alias("s"), "w", F.substring("label", F.col("s"), F.col("w")).alias("word"))
    lp = F.log(F.col("n") / F.lit(max(total, 1))).alias("lp")
    short, long = counts.where(F.length("word") <= STEM), counts.where(F.length("word") > STEM)
    seen = parts.select("word").distinct().join(short, "word").select("word", lp)
    found = parts.join(seen, "word").select("label", "s", "w", "lp")
    stems = long.select(F.substring("word", 1, STEM).alias("stem"), F.col("word").alias("whole"), lp)
    places = parts.where(F.col("w") == STEM).select("label", "s", F.col("word").alias("stem"))
    met = places.join(stems, "stem").where(F.substring("label", F.col("s") + 1, F.length("whole")) == F.col("whole"))
    found = found.unionByName(met.select("label", "s", F.length("whole").alias("w"), "lp"))
    found = found.groupBy("label").agg(F.collect_list(F.struct("s", "w", "lp")).alias("parts"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, parts: pd.Series) -> pd.Series:
        def one(x: str, p: object) -> list[str]:
            p = [] if p is None else p
            return viterbi(x, np.array([q["s"] for q in p], int), np.array([q["w"] for q in p], int), np.array([q["lp"] for q in p], float), total)

        return pd.Series([one(x, p) for x, p in zip(label, parts, strict=True)])

    return labels.join(found, "label", "left").select("label", split("label", "parts").alias("words"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row; score is the log odds of block, null where a rule decides."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    rows = with_rules(rows, rules)
    # urls repeat; judge each (host, path shape) once. Digits are folded, so that ids do not make every path its own.
    shape = F.regexp_replace(F.lower("path"), r"\p{Nd}+", "0")
    rows = materialize(rows.withColumn("shape", shape), "urls")
    kinds = rows.groupBy("host", "shape").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("block", "allow")])
    kinds = materialize(kinds, "url-kinds")
    labels = kinds.select(F.explode(F.split("host", r"[^\p{L}]+")).alias("label"))
    words = segment_labels(labels, word_counts(pages, html))
    host_words = kinds.select("host").distinct().select("host", F.explode(F.split("host", r"[^\p{L}]+")).alias("label")).join(words, "label")
    host_tokens = host_words.select("host", F.explode("words").alias("w")).groupBy("host", F.concat(F.lit("h:"), "w").alias("token")).agg(F.count("*").alias("k"))
    shape_tokens = kinds.select("shape").distinct().select("shape", F.explode(F.split("shape", r"[^\p{L}\p{Nd}]+")).alias("w")).where("w <> ''")
    shape_tokens = shape_tokens.groupBy("shape", F.concat(F.lit("p:"), "w").alias("token")).agg(F.count("*").alias("k"))
    shape_tokens = materialize(shape_tokens, "path-tokens")
    by_host = kinds.groupBy("host").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    by_shape = kinds.groupBy("shape").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counts = lambda t, by, on: t.join(by, on).groupBy("token").agg(*[F.sum(F.col("k") * F.col(v)).alias(v) for v in ("block", "allow")])
    model = materialize(counts(host_tokens, by_host, "host").unionByName(counts(shape_tokens, by_shape, "shape")), "url-model")
    sums = model.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("block", "allow")]).first()
    docs = kinds.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("block", "allow")]).first()
    prior = float(np.log((docs["block"] + 1) / (docs["allow"] + 1))) if docs["block"] + docs["allow"] else -1.0
    weight = F.log((F.col("block") + 1.0) / (sums["block"] + sums["v"] + 1.0)) - F.log((F.col("allow") + 1.0) / (sums["allow"] + sums["v"] + 1.0))
    weights = model.select("token", weight.alias("weight"))
    # written first: Spark then knows their size and broadcasts them, or else joins by splittable shuffles
    scored = lambda t, on, to: materialize(t.join(weights, "token").groupBy(on).agg(F.sum(F.col("k") * F.col("weight")).alias(to)), f"{on}-scores")
    out = rows.join(scored(host_tokens, "host", "hs"), "host", "left").join(scored(shape_tokens, "shape", "ss"), "shape", "left")
    score = F.coalesce("hs", F.lit(0.0)) + F.coalesce("ss", F.lit(0.0)) + F.lit(prior)
    return out.select(
        F.col("_key").alias(key), "host", "path", "rule",
        F.coalesce("verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), score).alias("score"),
    )
