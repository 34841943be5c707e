"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings per character class.

One pass without any shuffle: every span is computed inside its row by array functions, so hot keys, repeated
rows and lost executors cost nothing special. Offsets are code points, ends exclusive.

Defined results. Null text counts as empty and has no spans. Matches of one kind never overlap; spans of
different kinds may. Two spans with one start are ordered by kind as listed in KINDS.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import let
from plumbline.llm.common import running_max, running_sum

#: kind -> (pattern, the group whose length counts, least code points of it). Fixed values of the contract.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Character classes of the entropy method: candidate pattern, alphabet, least bits a character in some window.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_=-])", "0123456789abcdefABCDEF", 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
}
KINDS = [*BASE, *CLASSES]
WINDOW = 20
#: Candidates that are no secrets: documentation samples, plain words, runs of one character, identifiers made of words.
ALLOWED = r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|abcdefgh|^[a-z]+$|^[A-Z]+$|^[A-Za-z]?[a-z]+([_/=-][A-Za-z]?[a-z]+)*$|^[-_=+/]+$"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, hit, part>> of the leftmost non-overlapping matches; part is the group's text.

    The pieces between matches and the matches themselves give the offsets by running sums of their lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    both = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda z: z["g"] + F.coalesce(F.length(z["h"]), F.lit(0)))
    starts = F.zip_with(running_sum(both), gaps, lambda s, g: s + g)
    rows = F.arrays_zip(starts.alias("start"), hits.alias("hit"), parts.alias("part"))
    found = F.transform(F.slice(rows, F.lit(1), F.size(hits)), lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(r["hit"])).alias("end"), r["hit"].alias("hit"), r["part"].alias("part")))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string,part:string>>"))


#: A count takes COUNT_BITS bits, so a long holds COUNTS of them: windows have up to 31 characters.
COUNT_BITS, COUNTS = 5, 12
#: Terms n * log2(n) are kept as whole numbers of this part of a bit, so sums are exact in any order.
PARTS = 2**40


def window_entropy(word: Column, alphabet: str, window: int = WINDOW, enough: float = math.inf) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of word; 0 if it is shorter than a window.

    The first window that has `enough` ends the search, and its entropy is the result.

    The word is taken apart once. A step adds the character that enters and drops the one that leaves: two counts, kept
    in the bits of a few longs, change, and the sum of n * log2(n) by their two terms alone. Time is linear in the word.
    """
    terms = [0, *(round(n * math.log2(n) * PARTS) for n in range(1, window + 1))]
    rise = F.array(*[F.lit(b - a).cast("long") for a, b in itertools.pairwise(terms)])  # rise[n]: from n to n + 1
    shift = lambda how, x, by: F.call_function(how, x, by)

    def place(letter: Column) -> Column:
        """Where a character's count is: the long, the bits below it, and 1 at it."""
        code = F.instr(F.lit(alphabet), letter)
        low = code % COUNTS * COUNT_BITS
        return F.struct(F.floor(code / COUNTS).cast("int").alias("at"), low.alias("low"), shift("shiftleft", F.lit(1).cast("long"), low).alias("one"))

    def step(a: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]
        count = lambda p: shift("shiftright", F.get(a["n"], p["at"]), p["low"]).bitwiseAND(2**COUNT_BITS - 1).cast("int")
        leaves = out["at"].isNotNull()
        same = leaves & (into["at"] == out["at"]) & (into["low"] == out["low"])
        counts = F.transform(a["n"], lambda n, k: n + F.when(into["at"] == k, into["one"]).otherwise(F.lit(0)) - F.when(out["at"] == k, out["one"]).otherwise(F.lit(0)))
        s = F.when(same, a["s"]).otherwise(a["s"] + F.get(rise, count(into)) - F.when(leaves, F.get(rise, count(out) - 1)).otherwise(F.lit(0)))
        after = F.struct(counts.alias("n"), s.cast("long").alias("s"), (a["i"] + 1).alias("i"), F.when(a["i"] + 1 >= window, F.least(a["least"], s)).otherwise(a["least"]).cast("long").alias("least"))
        return F.when(a["least"] <= stop, a).otherwise(after)

    # entropy is log2(window) less the sum's share
    stop = math.floor((math.log2(window) - enough) * window * PARTS) if enough < math.inf else -1
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(alphabet) // COUNTS + 1).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"), F.lit(None).cast("long").alias("least"))

    def steps(places: Column) -> Column:
        gone = F.slice(F.concat(F.array_repeat(F.lit(None), window), places), F.lit(1), F.size(places))
        return F.zip_with(places, gone, lambda i, o: F.struct(i.alias("into"), o.alias("out")))

    places = F.transform(F.split(word, ""), place)
    least = F.aggregate(let(places, steps), start, step)["least"]
    return F.coalesce(math.log2(window) - least / F.lit(float(PARTS)) / window, F.lit(0.0))


def _at_least(least: int, m: Column) -> Column:
    return F.length(m["part"]) >= least


def _high(alphabet: str, bits: float, m: Column) -> Column:
    return window_entropy(m["hit"], alphabet, enough=bits) >= bits


def secret_spans(text: Column) -> Column:
    """array<struct<start, rank, kind, end>> of a text, sorted; rank is the kind's place in KINDS."""
    body = F.coalesce(text, F.lit(""))

    def spans(kind: str, kept: Column) -> Column:
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    out = []
    for kind, (pattern, group, least) in BASE.items():
        long = partial(_at_least, least)
        out.append(spans(kind, F.filter(matches(body, pattern, group), lambda m: long(m))))
    for kind, (pattern, alphabet, bits) in CLASSES.items():
        likely = F.filter(matches(body, pattern), lambda m: ~F.rlike(m["hit"], F.lit(ALLOWED)))
        high = partial(_high, alphabet, bits)
        out.append(spans(kind, F.filter(likely, lambda m: high(m))))
    return F.array_sort(F.concat(*out))


def find_secrets(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """docs plus the column `to`: the spans of secret_spans; a column of that name is replaced."""
    return docs.withColumn(to, secret_spans(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of secret_spans replaced by mark; overlapping spans are replaced as one. Null text stays null."""
    body = F.col(text)

    def without(spans: Column) -> Column:
        # a gap of the text lies before each span that no earlier one reaches; it begins where the farthest of those ends
        ends = F.transform(spans, lambda s: s["end"])
        gaps = F.zip_with(spans, running_max(ends), lambda s, at: F.struct(at.alias("at"), (s["start"] - at).alias("len")))
        pieces = F.transform(F.filter(gaps, lambda g: g["len"] >= 0), lambda g: F.substring(body, (g["at"] + 1).cast("int"), g["len"].cast("int")))
        rest = F.substring(body, (F.array_max(ends) + 1).cast("int"), F.lit(2**31 - 1))
        return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, mark), F.lit(mark), rest)).otherwise(body)

    return docs.withColumn(text, let(secret_spans(body), without))
