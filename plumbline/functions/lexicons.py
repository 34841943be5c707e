"""Word lists of the prose rules.

Fixed values: the entries must be these for right findings. Substitutions and technical terms are in openste.py (MIT
licence, (c) openSTE.org, see LICENSE-DATA.md); another wordset is a parameter, read by sources.wordset.
"""

from plumbline.functions.openste import SUBSTITUTIONS, TECHNICAL_TERMS  # noqa: F401

CONTRACTIONS = {
    "aren't": "are not", "can't": "cannot", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not", "he'd": "he had / he would",
    "he'll": "he will", "he's": "he is", "here's": "here is", "i'd": "I had / I would", "i'll": "I will",
    "i'm": "I am", "i've": "I have", "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "mustn't": "must not", "shan't": "shall not", "she'd": "she had / she would",
    "she'll": "she will", "she's": "she is", "shouldn't": "should not", "that's": "that is", "there's": "there is",
    "they'd": "they would", "they'll": "they will", "they're": "they are", "they've": "they have",
    "wasn't": "was not", "we'd": "we would", "we'll": "we will", "we're": "we are", "we've": "we have",
    "weren't": "were not", "what's": "what is", "where's": "where is", "who's": "who is", "won't": "will not",
    "wouldn't": "would not", "you'd": "you had / you would", "you'll": "you will", "you're": "you are",
    "you've": "you have",
}

BE_VERBS = "am is are was were be been being".split()

IRREGULAR_PARTICIPLES = """
    beaten become begun bent bound broken brought built bought caught chosen come cut dealt done drawn driven eaten
    fallen fed felt found frozen given gone grown held hidden hit hurt kept known laid led left lost made meant met
    paid put read run said seen sent set shown shut sold spent split spread sung taken taught told thrown understood
    worn written""".split()

NOT_PARTICIPLES = """
    need indeed speed proceed exceed embed feed seed bed red bred shed sled shred wed fled bled sped hundred
    sacred""".split()

ING_ALLOWED = """
    bearing being bring building casing ceiling coating coding during engineering everything fitting following
    grounding heading housing king lightning meaning morning nothing opening packaging ring setting something spring
    string swing thing timing training warning wing wiring according regarding sing""".split()

PHRASAL_VERBS = {
    "carry out": "do or complete", "check out": "examine", "fill in": "complete", "find out": "determine",
    "hook up": "connect", "look up": "find", "pick up": "lift or collect", "put in": "install",
    "set up": "install or prepare", "shut down": "stop", "take out": "remove", "turn off": "stop", "turn on": "start",
}

BARE_WORDS = """
    abrasive adjacent bolt brush cap center damage dent filter focus generous generously gouge graph guard hold hum
    kink loop opportunity overhaul plot pump recess sample significant stamp tape time undertake warm work
    zero""".split()

OPENAI, ANTHROPIC, SHARED = "OpenAI", "Anthropic", "cross-family"
SLOP_WORDS = dict.fromkeys(
    """delve delves delving delved underscore underscores showcasing showcase intricate meticulous meticulously pivotal
    realm boasts garner interplay tapestry testament nestled elucidate groundbreaking seamlessly unparalleled
    multifaceted""".split(), OPENAI,
) | dict.fromkeys("leverage harness vibrant".split(), SHARED) | dict.fromkeys("nuanced genuinely".split(), ANTHROPIC)

EVALUATIVE = """
    commendable meticulous notable noteworthy innovative versatile comprehensive invaluable robust remarkable
    exceptional thorough seamless cutting-edge""".split()

HEDGES = """
    may might could likely possibly perhaps presumably seems appears typically generally probably arguably""".split()

RESTATEMENTS = [
    "in other words", "to put it another way", "that is to say", "to reiterate", "as mentioned", "as noted above",
    "in essence", "simply put",
]

#: Options by position.
IMPERSONAL_HEDGES = [
    [["it"], ["can", "could", "may", "might"], ["be"], ["argued", "said", "assumed", "shown", "noted", "seen"], ["that"]],
    [["it"], ["is"], ["possible"], ["that"]],
    [["there"], ["is"], ["a"], ["possibility"], ["that"]],
]

#: (first anchor, second anchor).
PARALLELISMS = [(["not", "only"], ["but", "also"]), (["not", "just"], ["but"])]

NOMINAL_SUFFIXES = "tion sion ment ance ence ity ness".split()
