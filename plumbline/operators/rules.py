"""The prose rules: each maps one sentence's tokens to an array of findings.

A rule is an expression over a sentence row, so any set of rules is one narrow pass over the text: no joins, no shuffle.
Word lists are literals; membership tests on them are hash probes, and only hits look further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lex
from plumbline.functions.arrays import found, let
from plumbline.operators.parse import word_count

ERROR, WARNING, SUGGESTION = "error", "warning", "suggestion"
FINDING = "struct<message:string,hint:string,line:int,col:int,end_line:int,end_col:int,match:string>"


@dataclass(frozen=True)
class Rule:
    """id, default severity, description, and check: (block kind, tokens, words) -> array<FINDING>."""

    id: str
    severity: str
    description: str
    check: Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Settings:
    """What the rules depend on. A limit of 0 or less turns the sentence limit off.

    allowed: lower-cased words and phrases that pass; the built-in technical terms, unless told otherwise.
    """

    procedure_max: int = 20
    description_max: int = 25
    strict: bool = False
    slop: bool = True
    allowed: frozenset[str] = frozenset(lex.TECHNICAL_TERMS)
    substitutions: dict[str, list[str]] = field(default_factory=lambda: lex.SUBSTITUTIONS)
    bare: tuple[str, ...] = tuple(lex.BARE_WORDS)


def finding(message: Column, hint: Column | str, first: Column, last: Column, match: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(message.alias("message"), text(hint).alias("hint"), first["line"].alias("line"), first["col"].alias("col"), last["end_line"].alias("end_line"), last["end_col"].alias("end_col"), text(match).alias("match"))


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def among(values: Iterable[str]) -> Callable[[Column], Column]:
    """Membership in a fixed list, a hash probe; an empty list has no members."""
    values = sorted(values)
    return lambda c: c.isin(*values) if values else F.lit(False)


def few(values: Iterable[str]) -> Callable[[Column], Column]:
    """Membership as one literal that is searched in turn: for tests that stand in many places and rarely run."""
    values = sorted(values)
    if any("," in v for v in values):
        return among(values)
    return lambda c: F.find_in_set(c, F.lit(",".join(values))) > 0


def choice(table: dict[str, str], key: Column) -> Column:
    """The value of a key; the table is one literal, as a whole word list as literals of its own takes long to plan."""
    return F.element_at(F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in sorted(table.items()))), F.lit("\x02"), F.lit("\x01")), key)


def low(words: Column, i: Column | int) -> Column:
    """The lower-cased word at place i, null outside the sentence."""
    return F.get(words, i)["lower"]


def gram(words: Column, i: Column, n: int) -> Column:
    """n lower-cased words from place i, joined by spaces; null if they reach beyond the sentence."""
    return F.concat_ws(" ", F.transform(F.slice(words, i + 1, F.lit(n)), lambda w: w["lower"])) if n > 3 else say(*[x for k in range(n) for x in ((" ", low(words, i + k)) if k else (low(words, i),))])


def phrases(words: Column, table: Iterable[str], make: Callable[[Column, Column, Column], Column], opens: Column | None = None) -> Column:
    """make(phrase, first, last) of every place where a phrase of the table stands; phrases of one first place may repeat.

    opens: structs (w, i) of the words to look at and their places, if not all.
    """
    out = []
    for n in sorted({p.count(" ") + 1 for p in table}):
        mine = [p for p in table if p.count(" ") + 1 == n]
        starts, whole = few({p.split(" ")[0] for p in mine}), few(mine)
        at = _phrase(words, n, starts, whole, make)
        out.append(found(F.transform(words, at) if opens is None else _each(opens, at)))
    return F.concat(*out) if out else F.array().cast(f"array<{FINDING}>")


def _each(places: Column, at: Callable[[Column, Column], Column]) -> Column:
    return F.transform(places, lambda x: at(x["w"], x["i"]))


def _phrase(words: Column, n: int, starts: Callable, whole: Callable, make: Callable) -> Callable[[Column, Column], Column]:
    def at(w: Column, i: Column) -> Column:
        return F.when(starts(w["lower"]) & (i + n <= F.size(words)) & whole(gram(words, i, n)), make(gram(words, i, n), w, F.get(words, i + n - 1)))

    return at


# The messages and hints of the rules below are part of their results.


def sentence_length(s: Settings) -> Callable[[Column, Column, Column], Column]:
    def check(kind: Column, toks: Column, words: Column) -> Column:
        count, first, last = word_count(toks), F.element_at(toks, 1), F.element_at(toks, -1)
        name, most = F.when(kind == "list", "procedure").otherwise("description"), F.when(kind == "list", s.procedure_max).otherwise(s.description_max)
        hit = finding(say("Sentence has ", count.cast("string"), " words; the ", name, " limit is ", most.cast("string"), "."), "Divide the sentence into shorter sentences.", first, last, "")
        return found(F.array(F.when((kind != "heading") & (most > 0) & (count > most), hit)))

    return check


def contractions(kind: Column, toks: Column, words: Column) -> Column:
    straight = lambda w: F.replace(w["lower"], F.lit("’"), F.lit("'"))
    hits = F.filter(words, lambda w: straight(w).isin(*lex.CONTRACTIONS))
    return F.transform(hits, lambda w: finding(say('Contraction "', w["text"], '" is not allowed.'), say('Write "', choice(lex.CONTRACTIONS, straight(w)), '".'), w, w, w["text"]))


def participle(w: Column) -> Column:
    return w.isin(*lex.IRREGULAR_PARTICIPLES) | (w.endswith("ed") & (F.length(w) >= 4) & ~w.isin(*lex.NOT_PARTICIPLES))


def passive_voice(kind: Column, toks: Column, words: Column) -> Column:
    def at(w: Column, i: Column) -> Column:
        j = i + 1 + F.coalesce(low(words, i + 1).endswith("ly").cast("int"), F.lit(0))
        part = F.get(words, j)
        both = say(w["text"], " ", part["text"])
        hit = finding(say('Passive voice: "', both, '".'), "Rewrite the sentence in the active voice. State who does the action.", w, part, both)
        return F.when(w["lower"].isin(*lex.BE_VERBS) & participle(part["lower"]), hit)

    return found(F.transform(words, at))


def ing_forms(kind: Column, toks: Column, words: Column) -> Column:
    hits = F.filter(words, lambda w: (kind != "heading") & w["lower"].endswith("ing") & (F.length(w["lower"]) >= 5) & ~w["lower"].isin(*lex.ING_ALLOWED))
    return F.transform(hits, lambda w: finding(say('The -ing form "', w["text"], '" is hard to read in an instruction.'), "Use a simple verb form, such as the imperative.", w, w, w["text"]))


def phrasal_verbs(kind: Column, toks: Column, words: Column) -> Column:
    return phrases(words, lex.PHRASAL_VERBS, lambda p, a, b: finding(say('Phrasal verb "', p, '" is not clear.'), say('Use "', choice(lex.PHRASAL_VERBS, p), '".'), a, b, p))


def one_instruction(kind: Column, toks: Column, words: Column) -> Column:
    make = lambda t, m: finding(F.lit(m), "Divide the step into one instruction for each sentence.", t, t, "")
    semicolons = F.transform(F.filter(toks, lambda t: (t["kind"] == "punct") & (t["text"] == ";")), lambda t: make(t, "The semicolon joins two instructions."))
    joined = found(F.transform(words, lambda w, i: F.when((w["lower"] == "and") & (low(words, i + 1) == "then"), make(w, 'The words "and then" join two instructions.'))))
    return F.when(kind == "list", F.concat(semicolons, joined)).otherwise(F.array().cast(f"array<{FINDING}>"))


def vocabulary(s: Settings) -> Callable[[Column, Column, Column], Column]:
    hints = {w: 'Use "' + '" or "'.join(a) + '".' if a else "Use an approved word." for w, a in s.substitutions.items()}
    multi = [w for w in s.substitutions if " " in w]
    lone_words = {w for w in s.substitutions if " " not in w} - s.allowed
    bare_words = set(s.bare) - set(s.substitutions) - s.allowed if s.strict else set()
    single, bare = few(lone_words), few(bare_words)
    opens = among(lone_words | bare_words | {w.split(" ")[0] for w in multi if w not in s.allowed})
    lengths = sorted({w.count(" ") + 1 for w in multi})

    def covered(words: Column, i: Column) -> Column:
        """Some phrase of the list, allowed or not, stands over place i."""
        out = F.lit(False)
        for n in lengths:
            whole = few(w for w in multi if w.count(" ") + 1 == n)
            for k in range(n):
                out = out | F.coalesce((i - k >= 0) & whole(gram(words, i - k, n)), F.lit(False))
        return out

    def check(kind: Column, toks: Column, words: Column) -> Column:
        make = lambda text, a, b, key: finding(say('The word "', text, '" is not approved Simplified Technical English.'), choice(hints, key), a, b, text)
        lone = lambda w, i: F.when(single(w["lower"]) & ~covered(words, i), make(w["text"], w, w, w["lower"]))
        strict = lambda w, i: F.when(bare(w["lower"]) & ~covered(words, i), finding(say('The word "', w["text"], '" is not in the approved vocabulary.'), "Use an approved word with the same meaning.", w, w, w["text"]))

        def at(places: Column) -> Column:
            spans = phrases(words, [w for w in multi if w not in s.allowed], lambda p, a, b: make(p, a, b, p), places)
            return F.concat(spans, found(_each(places, lone)), *([found(_each(places, strict))] if s.strict else []))

        # all else looks at the words that may open a finding alone
        places = F.filter(F.transform(words, lambda w, i: F.when(opens(w["lower"]), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
        return let(places, at)

    return check


def slop_vocabulary(s: Settings) -> Callable[[Column, Column, Column], Column]:
    table = {w: f for w, f in lex.SLOP_WORDS.items() if w not in s.allowed}
    member = among(table)

    def check(kind: Column, toks: Column, words: Column) -> Column:
        hits = F.filter(words, lambda w: member(w["lower"]))
        return F.transform(hits, lambda w: finding(say('The word "', w["text"], '" is common to LLM output (', choice(table, w["lower"]) if table else "", ")."), "Prefer a plain, concrete term.", w, w, w["text"]))

    return check


def slop_restatement(kind: Column, toks: Column, words: Column) -> Column:
    return phrases(words, lex.RESTATEMENTS, lambda p, a, b: finding(say('Restatement marker "', p, '" repeats an existing point.'), "Delete the restatement or merge it with the original.", a, b, p))


def slop_impersonal_hedge(kind: Column, toks: Column, words: Column) -> Column:
    return F.concat(*[found(F.transform(words, _template(words, t))) for t in lex.IMPERSONAL_HEDGES])


def _template(words: Column, options: list[list[str]]) -> Callable[[Column, Column], Column]:
    n = len(options)

    def at(w: Column, i: Column) -> Column:
        fits = w["lower"].isin(*options[0]) & (i + n <= F.size(words))
        for k, o in enumerate(options[1:], 1):
            fits = fits & low(words, i + k).isin(*o)
        text = say(*[x for k in range(n) for x in ((" ", F.get(words, i + k)["text"]) if k else (w["text"],))])
        return F.when(fits, finding(say('Impersonal hedge "', text, '" is wordy and evasive.'), "State the fact directly in the active voice.", w, F.get(words, i + n - 1), text))

    return at


def slop_negative_parallelism(kind: Column, toks: Column, words: Column) -> Column:
    """At most one finding per sentence and pattern: the first anchor, then the first second anchor past it."""
    return F.when(F.exists(words, lambda w: w["lower"] == "not"), found(F.array(*[_parallel(words, a, b) for a, b in lex.PARALLELISMS]))).otherwise(F.array().cast(f"array<{FINDING}>"))


def _parallel(words: Column, first: list[str], second: list[str]) -> Column:
    def places(anchor: list[str], least: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            fits = (w["lower"] == anchor[0]) & (i >= least)
            for k, x in enumerate(anchor[1:], 1):
                fits = fits & (low(words, i + k) == x)
            return F.when(fits, i)

        return F.array_min(found(F.transform(words, at)))

    i = places(first, F.lit(0))
    j = places(second, i + len(first))
    a, b = F.get(words, i), F.get(words, j + len(second) - 1)
    return F.when(i.isNotNull() & j.isNotNull(), finding(F.lit('Negative parallelism ("not only … but also …") is wordy filler.'), "State the point directly.", a, b, a["text"]))


def density(member: Callable[[Column], Column], least: int, noun: str, hint: str) -> Callable[[Column, Column, Column], Column]:
    """One finding, at the first hit, for a sentence with `least` hits."""

    def check(kind: Column, toks: Column, words: Column) -> Column:
        hits = F.filter(words, lambda w: member(w["lower"]))
        first = F.get(hits, 0)
        return found(F.array(F.when(F.size(hits) >= least, finding(say("This sentence stacks ", F.size(hits).cast("string"), f" {noun}."), hint, first, first, first["text"]))))

    return check


def nominalization(w: Column) -> Column:
    """The length counts bytes, so accented words reach it sooner."""
    return (F.octet_length(w) >= 6) & F.rlike(w, F.lit(f"(?:{'|'.join(lex.NOMINAL_SUFFIXES)})$"))


def rules(s: Settings | None = None) -> list[Rule]:
    """The rules in registration order: seven always, seven more if slop is on."""
    s = s or Settings()
    key = (s.procedure_max, s.description_max, s.strict, s.slop, s.allowed, s.bare, tuple((w, tuple(a)) for w, a in s.substitutions.items()))
    return list(_rules(key))


@lru_cache(maxsize=64)
def _rules(key: tuple) -> tuple[Rule, ...]:
    """The rules of equal settings are the same ones, so what is made of them can be kept."""
    s = Settings(*key[:5], {w: list(a) for w, a in key[6]}, key[5])
    always = [
        Rule("STE.SentenceLength", ERROR, "A sentence has more words than its kind of text allows.", sentence_length(s)),
        Rule("STE.Contractions", ERROR, "Two words are drawn together with an apostrophe.", contractions),
        Rule("STE.PassiveVoice", WARNING, "A form of be and a participle leave open who acts.", passive_voice),
        Rule("STE.IngForms", SUGGESTION, "A word ends in -ing.", ing_forms),
        Rule("STE.PhrasalVerbs", WARNING, "A verb and a particle stand where one verb would do.", phrasal_verbs),
        Rule("STE.OneInstruction", WARNING, "A step holds more than one instruction.", one_instruction),
        Rule("STE.Vocabulary", SUGGESTION, "A word or phrase is outside the controlled vocabulary.", vocabulary(s)),
    ]
    slop = [
        Rule("STE.SlopVocabulary", WARNING, "A word is rare in people's prose and frequent in that of models.", slop_vocabulary(s)),
        Rule("STE.SlopRestatement", SUGGESTION, "A phrase announces that a point is made again.", slop_restatement),
        Rule("STE.SlopImpersonalHedge", WARNING, "A sentence opens with an impersonal it and a modal.", slop_impersonal_hedge),
        Rule("STE.SlopNegativeParallelism", WARNING, "Two halves are set against each other as in not only, but also.", slop_negative_parallelism),
        Rule("STE.SlopEvaluative", SUGGESTION, "Words of praise pile up in a sentence.", density(among(lex.EVALUATIVE), 2, "evaluative adjectives", "Replace praise words with concrete, factual detail.")),
        Rule("STE.SlopHedgeDensity", SUGGESTION, "Hedges pile up in a sentence.", density(among(lex.HEDGES), 3, "hedges", "State the condition once, or commit to a direct statement.")),
        Rule("STE.SlopNominalization", SUGGESTION, "Nouns made of verbs pile up in a sentence.", density(nominalization, 3, "nominalizations", "Rewrite with direct verbs.")),
    ]
    return tuple(always + (slop if s.slop else []))

