"""The engine's queries as DuckDB SQL over the same tables, composed from common table expressions."""

from __future__ import annotations

from plumbline.functions import lexicons as lex
from plumbline.queries import (
    ALLOW, ALTERNATIVES, DENY, DISABLED, ENDINGS, FAILED, FAMILIES, FENCED, FENCES, FIXTURES, FOLDERS, FRONT_MATTER, FRONTS, HEAVY_DOCUMENTS, PATHS, PROMPT_LINES, PROMPTS, RULE_KEYS, SEVERITIES, WORDS,
)
from plumbline.operators.evaluation import FIX_TASK, FIX_TEXT, NOTHING_FOUND
from plumbline.operators.repetition import ABOVE, KEYNESS, LEAST_LETTERS, LEAST_WORDS, TOO_MUCH, WINDOW
from plumbline.operators.report import SOURCE
from plumbline.operators.rules import Settings, rules
from plumbline.sources.markdown import FRONT_PATTERN

COLUMNS = "rule_id, severity, message, hint, path, line, col, end_line, end_col, match"


def q(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: q(x) if isinstance(x, str) else str(x).lower()
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


CORPUS = f"""
docs as (
    select 'doc:' || doc_id as path, text, false as md from documents
    union all select * from {values(FIXTURES, "path, text, md")}),
raw as (
    select path, md, cast(unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as integer) as line,
        regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\\r$', '') as src
    from docs),
prose as (
    select path, line, src,
        case when md then regexp_replace(regexp_replace(src, '^# ', '  '), '^- ', '  ') else src end as masked,
        case when md and src like '- %' then 'list' when md and src like '# %' then 'heading' else 'paragraph' end as kind
    from raw),
lined as (select *, regexp_matches(masked, '^[\\s\\x{{85}}\\p{{Z}}]*$') as blank from prose),
starts as (
    select *, kind <> 'paragraph' or coalesce(lag(blank) over w, true) or lag(kind) over w <> 'paragraph' as opens
    from lined window w as (partition by path order by line)),
blocked as (
    select path, line, masked, kind, cast(sum(opens::int) over (partition by path order by line) - 1 as integer) as block_id
    from starts where not blank),
pieces as (
    select path, line, kind as block_kind, block_id, unnest(p) as text, unnest(range(1, len(p) + 1)) as i
    from (select *, regexp_extract_all(masked, '(?s)[\\p{{L}}\\p{{Nd}}]+(?:[''’\\-][\\p{{L}}\\p{{Nd}}]+)*|[ \\t]+|.') as p from blocked)),
placed as (
    select *, cast(1 + coalesce(sum(length(text)) over (partition by path, line order by i rows between unbounded preceding and 1 preceding), 0) as integer) as col
    from pieces),
typed as (
    select path, block_id, block_kind, text, lower(text) as lower,
        case when regexp_matches(text, '^\\p{{Nd}}') then 'number' when regexp_matches(text, '^\\p{{L}}') then 'word' else 'punct' end as kind,
        line, col, line as end_line, cast(col + length(text) as integer) as end_col
    from placed where not regexp_matches(text, '^[ \\t]')),
shaped as (
    select *, case when kind = 'number' or regexp_matches(text, '^\\p{{Lu}}') then 'U' when kind = 'word' then 'l'
        when text = '.' then '.' when text in ('!', '?') then '!' end as shape
    from typed),
ended as (
    select *, block_kind <> 'heading' and coalesce(shape = '!' or (shape = '.' and coalesce(
        first_value(shape ignore nulls) over (partition by path, block_id order by line, col rows between 1 following and unbounded following), 'U') = 'U'), false) as ends
    from shaped),
numbered as (
    select *, cast(coalesce(sum(ends::int) over (partition by path, block_id order by line, col rows between unbounded preceding and 1 preceding), 0) as integer) as sent_id
    from ended),
toks as (
    select path, block_id, block_kind, sent_id, cast(row_number() over (partition by path, block_id, sent_id order by line, col) - 1 as integer) as tok_idx,
        text, lower, kind, line, col, end_line, end_col
    from numbered),
words as (
    select path, block_id, block_kind, sent_id, cast(row_number() over (partition by path, block_id, sent_id order by tok_idx) - 1 as integer) as word_idx,
        text, lower, kind, line, col, end_line, end_col
    from toks where kind = 'word'),
sents as (
    select path, block_id, sent_id, any_value(block_kind) as block_kind, cast(count(*) filter (where kind <> 'punct') as integer) as word_count,
        min_by(line, tok_idx) as line, min_by(col, tok_idx) as col, max_by(end_line, tok_idx) as end_line, max_by(end_col, tok_idx) as end_col
    from toks group by path, block_id, sent_id),
w as (
    select *, {", ".join(f"lead(lower, {k}) over s as l{k}, lead(text, {k}) over s as t{k}, lead(end_line, {k}) over s as el{k}, lead(end_col, {k}) over s as ec{k}" for k in range(1, 5))}
    from words window s as (partition by path, block_id, sent_id order by word_idx)),
grams as (
    select *, lower || ' ' || l1 as g2, lower || ' ' || l1 || ' ' || l2 as g3, lower || ' ' || l1 || ' ' || l2 || ' ' || l3 as g4,
        lower || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 as g5
    from w)"""


def with_(*more: str) -> str:
    return "with " + ",\n".join([CORPUS.strip(), *more])


META = {r.id: r for r in rules(Settings())}


def row(rule: str, message: str, hint: str, last: int | str, match: str, source: str, where: str) -> str:
    """One rule's findings; last is how many words on the finding ends."""
    el, ec = ("end_line", "end_col") if last == 0 else (f"el{last}", f"ec{last}") if isinstance(last, int) else last.split(",")
    return f"select {q(rule)} as rule_id, {q(META[rule].severity)} as severity, {message} as message, {hint} as hint, path, line, col, {el} as end_line, {ec} as end_col, {match} as match from {source} where {where}"


def table(name: str, mapping: dict[str, str]) -> str:
    return f"{name} as (select * from {values(list(mapping.items()), 'key, val')})"


def hint_of(alternatives: list[str]) -> str:
    return 'Use "' + '" or "'.join(alternatives) + '".'


ALLOWED = Settings().allowed
#: Phrase lengths of the word list.
LENGTHS = sorted({k.count(" ") + 1 for k in lex.SUBSTITUTIONS} - {1})
PARTICIPLE = lambda c: f"({c} in {listed(lex.IRREGULAR_PARTICIPLES)} or ({c} like '%ed' and length({c}) >= 4 and {c} not in {listed(lex.NOT_PARTICIPLES)}))"


def spans(rule: str, phrases: list[str], message: str, hint: str) -> list[str]:
    """A select for every phrase length; {p} stands for the phrase."""
    out = []
    for n in sorted({p.count(" ") + 1 for p in phrases}):
        mine = [p for p in phrases if p.count(" ") + 1 == n]
        out.append(row(rule, message.format(p=f"g{n}"), hint.format(p=f"g{n}"), n - 1, f"g{n}", "grams", f"g{n} in {listed(mine)}"))
    return out


def density(rule: str, where: str, least: int, noun: str, hint: str) -> str:
    return f"""select {q(rule)} as rule_id, {q(META[rule].severity)} as severity, 'This sentence stacks ' || count(*) || ' {noun}.' as message, {q(hint)} as hint, path,
        min_by(line, word_idx) as line, min_by(col, word_idx) as col, min_by(end_line, word_idx) as end_line, min_by(end_col, word_idx) as end_col, min_by(text, word_idx) as match
        from words where {where} group by path, block_id, sent_id having count(*) >= {least}"""


def rule_sql() -> dict[str, list[str]]:
    """Rule -> the selects whose union is its findings."""
    r = {}
    r["STE.SentenceLength"] = [row("STE.SentenceLength", "'Sentence has ' || word_count || ' words; the ' || case when block_kind = 'list' then 'procedure limit is 20.' else 'description limit is 25.' end", q("Divide the sentence into shorter sentences."), "end_line,end_col", "''", "sents", "block_kind <> 'heading' and word_count > case when block_kind = 'list' then 20 else 25 end")]
    r["STE.Contractions"] = [row("STE.Contractions", "'Contraction \"' || text || '\" is not allowed.'", "'Write \"' || val || '\".'", 0, "text", f"words join {values(list(lex.CONTRACTIONS.items()), 'key, val')} on replace(lower, '’', '''') = key", "true")]
    text = "text || ' ' || case when l1 like '%ly' then t2 else t1 end"
    r["STE.PassiveVoice"] = [row("STE.PassiveVoice", f"'Passive voice: \"' || {text} || '\".'", q("Rewrite the sentence in the active voice. State who does the action."), "case when l1 like '%ly' then el2 else el1 end,case when l1 like '%ly' then ec2 else ec1 end", text, "w", f"lower in {listed(lex.BE_VERBS)} and {PARTICIPLE('(case when l1 like ' + q('%ly') + ' then l2 else l1 end)')}")]
    r["STE.IngForms"] = [row("STE.IngForms", "'The -ing form \"' || text || '\" is hard to read in an instruction.'", q("Use a simple verb form, such as the imperative."), 0, "text", "words", f"block_kind <> 'heading' and lower like '%ing' and length(lower) >= 5 and lower not in {listed(lex.ING_ALLOWED)}")]
    r["STE.PhrasalVerbs"] = spans("STE.PhrasalVerbs", list(lex.PHRASAL_VERBS), "'Phrasal verb \"' || {p} || '\" is not clear.'", "'Use \"' || (select val from phrasal where key = {p}) || '\".'")
    divide = q("Divide the step into one instruction for each sentence.")
    r["STE.OneInstruction"] = [
        row("STE.OneInstruction", q("The semicolon joins two instructions."), divide, 0, "''", "toks", "block_kind = 'list' and text = ';'"),
        row("STE.OneInstruction", q('The words "and then" join two instructions.'), divide, 0, "''", "w", "block_kind = 'list' and lower = 'and' and l1 = 'then'"),
    ]
    says = "'The word \"' || {p} || '\" is not approved Simplified Technical English.'"
    r["STE.Vocabulary"] = [
        *[row("STE.Vocabulary", says.format(p=f"g{n}"), "val", n - 1, f"g{n}", f"grams join hints on g{n} = key", f"n = {n}") for n in LENGTHS],
        row("STE.Vocabulary", says.format(p="text"), "val", 0, "text", "covered join hints on lower = key", "n = 1 and not over"),
    ]
    r["STE.SlopVocabulary"] = [row("STE.SlopVocabulary", "'The word \"' || text || '\" is common to LLM output (' || val || ').'", q("Prefer a plain, concrete term."), 0, "text", f"words join {values(list(lex.SLOP_WORDS.items()), 'key, val')} on lower = key", "true")]
    r["STE.SlopRestatement"] = spans("STE.SlopRestatement", lex.RESTATEMENTS, "'Restatement marker \"' || {p} || '\" repeats an existing point.'", q("Delete the restatement or merge it with the original."))
    r["STE.SlopImpersonalHedge"] = []
    for t in lex.IMPERSONAL_HEDGES:
        said = " || ' ' || ".join("text" if k == 0 else f"t{k}" for k in range(len(t)))
        fits = " and ".join(f"{'lower' if k == 0 else f'l{k}'} in {listed(o)}" for k, o in enumerate(t))
        r["STE.SlopImpersonalHedge"].append(row("STE.SlopImpersonalHedge", f"'Impersonal hedge \"' || {said} || '\" is wordy and evasive.'", q("State the fact directly in the active voice."), len(t) - 1, said, "w", fits))
    r["STE.SlopNegativeParallelism"] = []
    for a, b in lex.PARALLELISMS:
        first = " and ".join(f"{'lower' if k == 0 else f'l{k}'} = {q(x)}" for k, x in enumerate(a))
        second = " and ".join(f"{'lower' if k == 0 else f'l{k}'} = {q(x)}" for k, x in enumerate(b))
        end = ("end_line", "end_col") if len(b) == 1 else (f"el{len(b) - 1}", f"ec{len(b) - 1}")
        key = "path, block_id, sent_id"
        r["STE.SlopNegativeParallelism"].append(f"""select 'STE.SlopNegativeParallelism' as rule_id, 'warning' as severity, 'Negative parallelism ("not only … but also …") is wordy filler.' as message,
            'State the point directly.' as hint, path, line, col, e.end_line, e.end_col, text as match from (
                select {key}, min(word_idx) as i, min_by(line, word_idx) as line, min_by(col, word_idx) as col, min_by(text, word_idx) as text from w where {first} group by {key}) f
            join lateral (select min_by({end[0]}, word_idx) as end_line, min_by({end[1]}, word_idx) as end_col from w x
                where x.path = f.path and x.block_id = f.block_id and x.sent_id = f.sent_id and x.word_idx >= f.i + {len(a)} and {second}) e on e.end_line is not null""")
    r["STE.SlopEvaluative"] = [density("STE.SlopEvaluative", f"lower in {listed(lex.EVALUATIVE)}", 2, "evaluative adjectives", "Replace praise words with concrete, factual detail.")]
    r["STE.SlopHedgeDensity"] = [density("STE.SlopHedgeDensity", f"lower in {listed(lex.HEDGES)}", 3, "hedges", "State the condition once, or commit to a direct statement.")]
    r["STE.SlopNominalization"] = [density("STE.SlopNominalization", f"strlen(lower) >= 6 and regexp_matches(lower, '(?:{'|'.join(lex.NOMINAL_SUFFIXES)})$')", 3, "nominalizations", "Rewrite with direct verbs.")]
    return r


LOOKUPS = [
    table("phrasal", lex.PHRASAL_VERBS),
    f"""hints as (select *, len(string_split(key, ' ')) as n from {values([(k, hint_of(v)) for k, v in lex.SUBSTITUTIONS.items() if k not in ALLOWED], 'key, val')})""",
    # a place is covered by a phrase that starts at it or up to its length less one before it; allowed phrases cover as well
    f"""phrase as (select * from {values([(k, k.count(" ") + 1) for k in lex.SUBSTITUTIONS if " " in k], 'key, n')}),
places as (
    {" union all ".join(f"select path, block_id, sent_id, unnest(range(word_idx, word_idx + {n})) as word_idx from grams join phrase on g{n} = key and n = {n}" for n in LENGTHS)}),
covered as (
    select w.*, p.word_idx is not null as over from words w left join (select distinct * from places) p using (path, block_id, sent_id, word_idx))""",
]
RULES = rule_sql()
UNION = "\nunion all ".join(s for part in RULES.values() for s in part)
KEYWORD = r"<!--\s*lint\s+(.*?)\s*-->"
SUPPRESS = [
    f"""bodies as (
    select path, line, cast(unnest(range(0, len(b))) as integer) as ord, unnest(b) as body
    from (select path, line, list_transform(regexp_extract_all(src, '(?i){KEYWORD}'), lambda x: regexp_extract(x, '(?i){KEYWORD}', 1)) as b from raw)),
directives as (
    select path, line, ord, lower(t[1]) as verb, t[1] as first, t[2:] as args
    from (select *, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') as t from bodies) where len(t) > 0),
toggles as (
    select path, line, max_by(off, ord) as off, rule_id from (
        select path, line, ord, '*' as rule_id, verb = 'off' as off from directives where verb in ('on', 'off')
        union all select path, line, ord, first, upper(args[2]) = 'NO' from directives
        where verb not in ('on', 'off', 'disable-line', 'disable-next-line') and len(args) = 2 and args[1] = '=' and upper(args[2]) in ('NO', 'YES'))
    group by path, line, rule_id),
marks as (
    select r.path, r.line, t.rule_id from raw r asof join toggles t on r.path = t.path and r.line >= t.line where false
    union all
    select path, line, rule_id from (
        select r.path, r.line, k.rule_id, (select max_by(off, t.line) from toggles t where t.path = r.path and t.rule_id = k.rule_id and t.line <= r.line) as off
        from raw r join (select distinct path, rule_id from toggles) k using (path)) where off
    union
    select path, cast(line + (verb = 'disable-next-line')::int as integer), unnest(case when len(args) = 0 then ['*'] else args end) from directives where verb in ('disable-line', 'disable-next-line')),
marked as (select distinct path, line, rule_id from marks)""",
]
FOUND = ["found as (" + UNION + ")", "kept as (select f.* from found f where not exists (select 1 from marked m where m.path = f.path and m.line = f.line and m.rule_id in (f.rule_id, '*')))"]


def over(select: str) -> str:
    """A select over `kept`, the findings that no directive suppresses."""
    return with_(*LOOKUPS, *SUPPRESS, *FOUND) + "\n" + select


PLACE = "path || ':' || line || ':' || col"
HINT = "case when hint <> '' then ' hint: ' || hint else '' end"
COLOR = "case severity when 'error' then chr(27) || '[31merror' when 'warning' then chr(27) || '[33mwarning' else chr(27) || '[36msuggestion' end || chr(27) || '[0m'"
RANK = "case severity when 'error' then 0 when 'warning' then 1 else 2 end"
GROUPS = "select rule_id, min_by(severity, {'path': path, 'line': line, 'col': col}) as severity, count(*) as n, case when min(hint) = max(hint) then min(hint) else '' end as shared_hint from kept group by rule_id"
UTF16 = lambda l, c: f"cast(case when {c} <= 1 then 0 else length(substring({l}, 1, {c} - 1)) + coalesce(len(regexp_extract_all(substring({l}, 1, {c} - 1), '[\\x{{10000}}-\\x{{10FFFF}}]')), 0) end as integer)"
REPLY = f"""
per as (select path, rule_id, count(*) as n from kept group by path, rule_id),
replies as (
    select doc_id as seq, source as model, lang as family, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')) as words, null as err from documents
    union all select seq, model, family, 0, trim(replace(err, chr(10), ' ')) from {values([(a, b, c, e) for a, b, c, _, e in FAILED], 'seq, model, family, err')}),
counted as (
    select r.*, p.rule_id, p.n from replies r left join per p on p.path = 'doc:' || r.seq and r.err is null),
models as (
    select model, min_by(family, seq) as family, min(seq) as first_seq, count(*) as samples, count(err) as errors, min_by(err, seq) filter (where err is not null) as first_error,
        cast(coalesce(sum(words), 0) as bigint) as words from replies group by model),
sums as (select model, cast(coalesce(sum(n) filter (where rule_id like 'STE.Slop%'), 0) as bigint) as slop_findings, cast(coalesce(sum(n), 0) as bigint) as total_findings from counted group by model),
by_model as (
    select m.*, slop_findings, total_findings, case when words = 0 then 0.0::double else slop_findings * 100.0::double / words end as slop_per_100,
        case when words = 0 then 0.0::double else total_findings * 100.0::double / words end as total_per_100 from models m join sums using (model))"""


def evaluated(select: str) -> str:
    return with_(*LOOKUPS, *SUPPRESS, *FOUND, REPLY.strip()) + "\n" + select


#: Every word of the conversations and the one behind it.
SAID = """(select (conv_id * 1000 + turn) * 100000 + i as pos, w[i + 1] as word, coalesce(w[i + 2], '') as next, role
    from (select *, unnest(range(len(w))) as i from (select conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\\s+') as w from conversations)))"""


def alternatives(more: bool) -> str:
    fixed = values([(i - 100, a, b) for i, (a, b) in enumerate(ALTERNATIVES)], "pos, title, alt_title")
    return f"(select * from {fixed}" + (f" union all select pos, word, next from {SAID})" if more else ")")


TITLE = "^[a-z]+(?:[-'' ][a-z]+)*$"
SUBS = lambda more: f"""select title as word, string_agg(alt_title, '|' order by pos) as alternatives from (
    select title, alt_title, min(pos) as pos from {alternatives(more)}
    where regexp_matches(title, '{TITLE}') and alt_title <> '' and lower(alt_title) <> lower(title) group by title, alt_title) group by title"""
STRICT = row("STE.Vocabulary", "'The word \"' || text || '\" is not in the approved vocabulary.'", q("Use an approved word with the same meaning."), 0, "text", "covered", f"not over and lower in {listed(sorted(set(lex.BARE_WORDS) - set(lex.SUBSTITUTIONS) - ALLOWED))}")


def terms(words: list[str], more: str = "false") -> str:
    return f"(select distinct lower(trim(term)) as term from (select term from {values([(w,) for w in words], 'term')} union all select word from {SAID} where {more}) where trim(term) <> '')"


def picked(options: list[str], key: str) -> str:
    return f"[{', '.join(map(q, options))}][{key} % {len(options)} + 1]"


FILES = f"""(select path, explicit from {values(PATHS, 'path, explicit')}
    union all select {picked(FOLDERS, 'page_id')} || regexp_extract(url, '://([^?#]*)', 1) || {picked(ENDINGS, 'page_id')}, page_id % 11 = 0 from pages)"""


def wrapped(around: list[tuple[str, str]], fixed: list[str]) -> str:
    side = lambda k: picked([a[k] for a in around], "conv_id")
    return f"(select text from {values([(t,) for t in fixed], 'text')} union all select {side(0)} || coalesce(text, '') || {side(1)} from conversations)"


TERMS = listed(lex.TECHNICAL_TERMS)
PHRASES = "said as (" + " union all ".join(
    f"select path, block_id, sent_id, word_idx, {n} as n, g{n} as phrase from grams where g{n} is not null and g{n} not in {TERMS} and not (lower in {TERMS} and {' and '.join(f'l{k} in {TERMS}' for k in range(1, n))})"
    for n in (3, 4)
) + ")"
WINDOWS = f"""sequenced as (
    select path, n, phrase, row_number() over (partition by path, n order by block_id, sent_id, word_idx) - 1 as j, count(*) over (partition by path, n) as total from said),
near as (
    select *, greatest(total - {WINDOW}, 0) as top from (select *, lag(j) over (partition by path, n, phrase order by j) as p from sequenced) where j - p < {WINDOW}),
opened as (
    select path, n, top, total, unnest(range(greatest(j - {WINDOW} + 1, 0), least(p, top) + 1)) as i from near),
repeats as (select path, n, top, total, i, count(*) as repeats from opened group by path, n, top, total, i)"""
#: Distinct content words of sentences, and their classes, in a scope: path or all.
CLASSES = lambda scope: f"""chosen as (
    select path, block_id, sent_id, list_sort(list(distinct lower)) as ws from words where length(lower) >= {LEAST_LETTERS} group by path, block_id, sent_id having count(distinct lower) >= {LEAST_WORDS}),
scoped as (select *, {scope} as scope, {{'path': path, 'block_id': block_id, 'sent_id': sent_id}} as place from chosen),
classes as (select scope, ws, min(place) as id, count(*) as size, len(ws) as n from scoped group by scope, ws),
spelled as (select scope, id, ws, n, unnest(ws) as word from classes),
ranked as (
    select s.*, row_number() over (partition by scope, id order by often, word) as rank from spelled s join (select word, count(*) as often from spelled group by word) using (word)),
heads as (select * from ranked where rank <= n - n * {ABOVE[0]} // {ABOVE[1]}),
near as (select distinct a.id as a, b.id as b, a.ws as aw, b.ws as bw from heads a join heads b on a.scope = b.scope and a.word = b.word and a.id < b.id),
pairs as (
    select * from (select a, b, len(list_intersect(aw, bw)) as shared, len(aw) + len(bw) - len(list_intersect(aw, bw)) as together from near)
    where {ABOVE[1]} * shared > {ABOVE[0]} * together)"""
PAIRS = "select a.path as a_path, a.block_id as a_block_id, a.sent_id as a_sent_id, b.path as b_path, b.block_id as b_block_id, b.sent_id as b_sent_id, cast(shared as integer) as shared, cast(together as integer) as together from pairs"


ORACLE_SQL: dict[str, str] = {
    "rep_n_documents": with_(PHRASES) + " select path, cast(n as integer) as n, count(*) as total, count(distinct phrase) as distinct_phrases, 1 - count(distinct phrase) / count(*) as rep_n, count(distinct phrase) / count(*) as distinct_n from said group by path, n",
    "rep_n_windows": with_(PHRASES, WINDOWS) + f" select path, cast(n as integer) as n, any_value(top) + 1 as windows, arg_max(i, repeats * 1000000000 - i) as worst_start, max(repeats) as worst_repeats, count(*) filter (where repeats > {TOO_MUCH} * least({WINDOW}, total)) as flagged from repeats group by path, n",
    "rep_heavy_phrases": with_(PHRASES) + f" select phrase, cast(n as integer) as n, count(distinct path) as documents, count(*) as times from said group by phrase, n having count(distinct path) >= {HEAVY_DOCUMENTS}",
    "restatement_within": with_(CLASSES("path")) + " " + PAIRS,
    "restatement_across": with_(CLASSES("''")) + " " + PAIRS,
    "restatement_members": with_(CLASSES("''")) + """ select s.path, s.block_id, s.sent_id, c.id.path as class_path, c.id.block_id as class_block_id, c.id.sent_id as class_sent_id
        from scoped s join classes c using (scope, ws) where c.size > 1 or c.id in (select a from pairs) or c.id in (select b from pairs)""",
    "word_overuse": with_(f"""own as (select path, lower as word, count(*) as times from words group by path, lower),
        sizes as (select path, sum(times) as words from own group by path),
        rates as (
            select path, word, times, words, sum(times) over (partition by word) - times as others, times::double as k1, words::double as n1, (sum(times) over (partition by word) - times)::double as k2, (sum(times) over () - words)::double as n2 from own join sizes using (path)),
        scored as (
            select *, 2 * (k1 * ln(k1 / (n1 * ((k1 + k2) / (n1 + n2)))) + case when k2 > 0 then k2 * ln(k2 / (n2 * ((k1 + k2) / (n1 + n2)))) else 0 end) as g from rates)""") + f" select path, word, times, cast(words as bigint) as words, cast(others as bigint) as others, round(g, 3) as score from scored where k1 * n2 > k2 * n1 and g >= {KEYNESS}",
    "lines": with_() + " select path, line, src, masked, kind, blank from lined",
    "blocks": with_() + " select path, block_id, any_value(kind) as block_kind, min(line) as start, cast(count(*) as integer) as n_lines, md5(string_agg(masked, chr(10) order by line)) as body_md5 from blocked group by path, block_id",
    "tokens": with_() + " select * from toks",
    "words": with_() + " select * from words",
    "sentences": with_() + " select path, block_id, sent_id, block_kind, word_count, line, col, end_line, end_col from sents",
    "sentence_word_count": with_() + " select path, count(*) as n_sentences, cast(sum(word_count) as bigint) as n_words, max(word_count) as longest from sents group by path",
    **{key: with_(*LOOKUPS) + "\n" + "\nunion all ".join(RULES[rule]) for rule, key in RULE_KEYS.items()},
    "vocabulary_by_join": with_(*LOOKUPS) + "\n" + "\nunion all ".join(RULES["STE.Vocabulary"]),
    "rule_vocabulary_all_terms": (with_(*LOOKUPS) + "\n" + "\nunion all ".join(RULES["STE.Vocabulary"])).replace(LOOKUPS[1], f"""hints as (select *, len(string_split(key, ' ')) as n from {values([(k, hint_of(v)) for k, v in lex.SUBSTITUTIONS.items()], 'key, val')})"""),
    "rule_vocabulary_strict": with_(*LOOKUPS) + "\n" + "\nunion all ".join([*RULES["STE.Vocabulary"], STRICT]),
    "lint_all": over(f"select {COLUMNS} from kept"),
    "lint_min_severity": over(f"select {COLUMNS} from kept where severity in ('error', 'warning')"),
    "lint_severity_override": over(f"select * replace (case rule_id {' '.join(f'when {q(k)} then {q(v)}' for k, v in SEVERITIES.items() if v in ('error', 'warning', 'suggestion'))} else severity end as severity) from kept"),
    "lint_disabled_rule": over(f"select {COLUMNS} from kept where rule_id not in {listed(DISABLED)}"),
    "gate": over("select coalesce(bool_or(severity = 'error'), false) as failed from kept"),
    "suppress_directives": with_(*SUPPRESS) + " select path, line, ord, verb, array_to_string(args, ' ') as args from directives",
    "suppress_map": with_(*SUPPRESS) + " select path, line, rule_id from marked",
    "suppress_filter": over(f"select {COLUMNS} from kept where rule_id = 'STE.IngForms'"),
    "report_summary": over("select *, printf('%d problems (%d errors, %d warnings, %d suggestions)', total, errors, warnings, suggestions) as summary_line from (select count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'suggestion') as suggestions, count(*) as total from kept)"),
    "report_concise_groups": over(GROUPS),
    "report_concise": over(f"""select seq_rank, rule_id, seq, path, line, col, report from (
        select cast({RANK} as integer) as seq_rank, rule_id, cast(0 as integer) as seq, '' as path, cast(0 as integer) as line, cast(0 as integer) as col, rule_id || ' · ' || severity || ' · ' || n as report from ({GROUPS})
        union all select cast({RANK} as integer), rule_id, 1, '', 0, 0, '  ↳ ' || shared_hint from ({GROUPS}) where shared_hint <> ''
        union all select cast({RANK.replace('severity', 'g.severity')} as integer), k.rule_id, 2, path, line, col, '  ' || {PLACE} || '  ' || case when match = '' then message else match end || case when shared_hint = '' and hint <> '' then '  — ' || hint else '' end from kept k join ({GROUPS}) g on k.rule_id = g.rule_id)"""),
    "report_text": over(f"select path, line, col, rule_id, {PLACE} || ': ' || severity || ': ' || message || ' [' || rule_id || ']' || {HINT} as report from kept"),
    "report_text_color": over(f"select path, line, col, rule_id, {PLACE} || ': ' || {COLOR} || ': ' || message || ' [' || rule_id || ']' || {HINT} as report from kept"),
    "report_json": over("select path, count(*) as n, string_agg(f, chr(10) order by f) as findings from (select path, concat_ws('|', line, col, rule_id, severity, message, case when hint = '' then '-' else hint end, end_line, end_col, case when match = '' then '-' else match end) as f from kept) group by path"),
    "lsp_diagnostics": over(f"""select k.path, k.line - 1 as start_line, {UTF16('a.src', 'k.col')} as start_char, k.end_line - 1 as end_line, {UTF16('b.src', 'k.end_col')} as end_char,
        cast(case severity when 'error' then 1 when 'warning' then 2 else 3 end as integer) as severity, rule_id as code, {q(SOURCE)} as source, message || ' — ' || hint as message
        from kept k join raw a on a.path = k.path and a.line = k.line join raw b on b.path = k.path and b.line = k.end_line"""),
    "list_rules": over(f"select cast(pos as integer) as pos, t.rule_id, t.severity, t.description, count(k.rule_id) as n from {values([(i, r.id, r.severity, r.description) for i, r in enumerate(rules(Settings()))], 'pos, rule_id, severity, description')} left join kept k on k.rule_id = t.rule_id group by all"),
    "vocab_build": SUBS(True),
    "vocab_unapproved": f"select distinct title as word from (select * from {values(WORDS, 'title, wordstatus')} union all select word, case when length(word) % 2 = 0 then 'unapproved' else 'approved' end from {SAID}) where wordstatus = 'unapproved' and regexp_matches(title, '{TITLE}') and title not in (select word from ({SUBS(False)}))",
    "vocab_merge": f"select term from {terms(ALLOW + DENY, 'true')}",
    "allowed_vocabulary": f"select term from (select term from {terms(lex.TECHNICAL_TERMS)} union select term from {terms(ALLOW, "role = 'user' and length(word) <= 6")}) where term not in (select term from {terms(DENY, "role = 'assistant'")})",
    "scan_docs": "select 'doc:' || doc_id as path, length(text) as chars, md5(text) as digest from documents",
    "scan_filter_paths": f"""select distinct path from {FILES} where explicit or (
        regexp_matches(lower(path), '\\.(md|markdown|mdown|mkd|txt)$') and not regexp_matches(path, '(^|/)(\\.git|node_modules)/') and not regexp_matches(path, '^vendor/[^/]*(/|$)')
        and not regexp_matches(path, '(^|/)[^/]*\\.gen\\.md$') and not regexp_matches(path, '(^|/)CHANGELOG\\.md$'))""",
    "markdown_mode": f"select path, regexp_matches(lower(path), '\\.(md|markdown|mdown|mkd)$') as markdown from {FILES}",
    "eval_tasks": f"select model, prompt from (select distinct source as model from documents), {values([(p,) for p in PROMPTS], 'prompt').replace(') t(', ') u(')}",
    "eval_family_lookup": f"select model, coalesce(nullif(family, ''), 'unknown') as family from (select distinct source as model from documents) left join {values(FAMILIES, 'model, family')} using (model)",
    "eval_samples": over("""select seq, words, coalesce(findings, 0) as findings, coalesce(slop, 0) as slop from (
        select conv_id * 1000000 + turn as seq, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as bigint) as words from conversations where role = 'assistant') r
        left join (select path, count(*) as findings, count(*) filter (where rule_id like 'STE.Slop%') as slop from kept group by path) f on f.path = cast(r.seq as varchar)""").replace("select 'doc:' || doc_id as path, text, false as md from documents", "select cast(conv_id * 1000000 + turn as varchar) as path, text, false as md from conversations where role = 'assistant'"),
    "eval_by_rule": evaluated("select model, rule_id, cast(sum(n) as bigint) as n from counted where n is not null group by model, rule_id"),
    "eval_by_model": evaluated("select * from by_model"),
    "eval_by_family": evaluated("""select *, case when words = 0 then 0.0::double else slop_findings * 100.0::double / words end as slop_per_100, case when words = 0 then 0.0::double else total_findings * 100.0::double / words end as total_per_100
        from (select family, count(*) as models, cast(sum(words) as bigint) as words, cast(sum(slop_findings) as bigint) as slop_findings, cast(sum(total_findings) as bigint) as total_findings from by_model group by family)"""),
    "eval_report": evaluated("""select cast(0 as integer) as section, printf('  %-12s slop %6.2f  all %6.2f  (%d models, %d words)', family, case when words = 0 then 0.0::double else slop_findings * 100.0::double / words end, case when words = 0 then 0.0::double else total_findings * 100.0::double / words end, models, words) as report
        from (select family, count(*) as models, cast(sum(words) as bigint) as words, cast(sum(slop_findings) as bigint) as slop_findings, cast(sum(total_findings) as bigint) as total_findings from by_model group by family)
        union all select 1, printf('  %-28s %-10s slop %6.2f  all %6.2f  (%d words)', model, family, slop_per_100, total_per_100, words) || case when errors > 0 then printf('  [%d errors: %s]', errors, first_error) else '' end from by_model"""),
    "stream_lint": over(f"select {COLUMNS} from kept").replace("select 'doc:' || doc_id as path, text, false as md from documents", "select 'conv:' || conv_id as path, max_by(text, turn) as text, false as md from conversations group by conv_id").replace(f"union all select * from {values(FIXTURES, 'path, text, md')}", ""),
    "eval_rollup": evaluated("""select cast(grouping(family, model, rule_id) as integer) as level, family, model, rule_id, cast(sum(n) as bigint) as n, cast(case when grouping(rule_id) = 1 then sum(words) end as bigint) as words,
            case when grouping(rule_id) = 1 then case when sum(words) = 0 then 0.0::double else sum(n) * 100.0::double / sum(words) end end as per_100
        from (select family, model, rule_id, coalesce(n, 0) as n, 0 as words, rule_id is null as own from counted union all select family, model, null, 0, words, true from replies)
        group by grouping sets ((family, model, rule_id), (family, model), (family, rule_id), (family), (rule_id), ()) having grouping(rule_id) = 1 or rule_id is not null"""),
    "eval_json": evaluated("""select 'models' as section, family, model, samples as size, errors, words, slop_findings, total_findings, round(slop_per_100, 6) as slop_per_100, round(total_per_100, 6) as total_per_100, coalesce(rules, '') as rules, coalesce(first_error, '') as first_error
        from by_model left join (select model, string_agg(rule_id || '=' || n, ';' order by rule_id) as rules from (select model, rule_id, cast(sum(n) as bigint) as n from counted where n is not null group by model, rule_id) group by model) using (model)
        union all select 'families', family, null, count(*), null, cast(sum(words) as bigint), cast(sum(slop_findings) as bigint), cast(sum(total_findings) as bigint),
            round(case when sum(words) = 0 then 0.0::double else sum(slop_findings) * 100.0::double / sum(words) end, 6), round(case when sum(words) = 0 then 0.0::double else sum(total_findings) * 100.0::double / sum(words) end, 6), null, null from by_model group by family"""),
    "eval_prompts": f"select p as prompt from (select regexp_replace(value, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') as p from (select value from {values([(p,) for p in PROMPT_LINES], 'value')} union all select case when conv_id % 5 = 0 then ' # ' || value else chr(9) || value || ' ' end from (select conv_id, unnest(string_split(coalesce(text, ''), chr(10))) as value from conversations where role = 'user'))) where p <> '' and p not like '#%'",
    "md_frontmatter": f"select text, cast(length(regexp_extract(text, {q(FRONT_PATTERN.replace(chr(92) + 'Z', chr(92) + 'z'))}, 0)) as integer) as front_end from {wrapped(FRONTS, FRONT_MATTER)}",
    "fix_prompt": with_(*LOOKUPS, *SUPPRESS, *FOUND, f"""by_rule as (
            select path, rule_id, min_by(severity, {{'line': line, 'col': col, 'severity': severity}}) as severity, count(*) as n, case when min(hint) = max(hint) then min(hint) else '' end as shared_hint from kept group by path, rule_id),
        listed as (
            select path, rule_id, string_agg('  ' || text || case when shared_hint = '' and hint <> '' then '  — ' || hint else '' end, chr(10) order by line, col, text, hint) as rows from (
                select path, rule_id, line, col, k.hint, shared_hint, {PLACE} || '  ' || case when match = '' then message else match end as text from kept k join by_rule using (path, rule_id)) group by path, rule_id),
        issues as (
            select path, string_agg(rule_id || ' · ' || severity || ' · ' || n || case when shared_hint <> '' then chr(10) || '  ↳ ' || shared_hint else '' end || chr(10) || rows, chr(10) order by {RANK}, rule_id) as issues
            from by_rule join listed using (path, rule_id) group by path)""") + f"""
        select path, {q(FIX_TASK)} || coalesce(issues, {q(NOTHING_FOUND)}) || {q(FIX_TEXT)} || coalesce(text, '') as prompt from docs left join issues using (path)""",
    "strip_fence": f"""select text, case when len(l) >= 2 and regexp_matches(l[1], '^\\s*```') and regexp_matches(l[-1], '^\\s*```\\s*$') then array_to_string(l[2:-2], chr(10)) else text end as stripped
        from (select text, string_split(text, chr(10)) as l from {wrapped(FENCES, FENCED)})""",
}
