"""Text to lines, blocks, tokens and sentences, row by row.

No step shuffles: a document's lines are grouped into blocks, a block's text is cut into sentences, and each line of a
sentence into tokens. Rows only fan out (blocks, then sentences), and each row holds its own part of the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import let, offsets

#: Lines that hold nothing but Unicode white space.
BLANK = r"^[\s\x85\p{Z}]*$"
#: Words and numbers joined by ' ’ or -, or any one character, each with the blanks behind it. The pieces make up the whole line.
PIECE = r"(?s)(?:[\p{L}\p{Nd}]+(?:['’\-][\p{L}\p{Nd}]+)*|.)[ \t]*+"
#: The place behind a mark that ends a sentence.
SENTENCE_END = r"(?<=[!?])|(?<=\.)(?=[^\p{L}\p{Nd}.!?]*+(?:[\p{Lu}\p{Nd}]|\z))"
TOKEN = "struct<text:string,lower:string,kind:string,line:int,col:int,end_line:int,end_col:int>"


def source_lines(text: Column) -> Column:
    """array<string>: split at newlines, one carriage return removed from each end; an empty text is one empty line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: F.regexp_replace(s, r"\r\z", ""))


def plain_lines(text: Column) -> Column:
    """array<struct<line, masked, kind, blank>> of a plain text: every line is a paragraph line."""
    return F.transform(source_lines(text), lambda s, i: F.struct((i + 1).alias("line"), s.alias("masked"), F.lit("paragraph").alias("kind"), F.rlike(s, F.lit(BLANK)).alias("blank")))


def with_lines(docs: DataFrame) -> DataFrame:
    """docs(path, text) plus prose, its lines: plain ones, or masked where docs has a markdown column that says so.

    docs that have prose already keep it. The mask is Python; only texts that need it are handed over.
    """
    from plumbline.sources.markdown import mask

    if "prose" in docs.columns:
        return docs.select("path", "text", "prose")
    if "markdown" not in docs.columns:
        return docs.select("path", "text", plain_lines(F.col("text")).alias("prose"))
    masked = F.coalesce("markdown", F.lit(False))
    prose = F.when(masked, F.coalesce(mask(F.when(masked, F.col("text"))), plain_lines(F.lit("")))).otherwise(plain_lines(F.col("text")))
    return docs.select("path", "text", prose.alias("prose"))


def lines(docs: DataFrame) -> DataFrame:
    """(path, line, src, masked, kind, blank) of every line."""
    both = with_lines(docs).select("path", F.explode(F.arrays_zip(source_lines(F.col("text")).alias("src"), F.col("prose").alias("p"))).alias("x"))
    return both.select("path", F.col("x.p.line").alias("line"), F.col("x.src").alias("src"), F.col("x.p.masked").alias("masked"), F.col("x.p.kind").alias("kind"), F.col("x.p.blank").alias("blank"))


def block_lists(docs: DataFrame) -> DataFrame:
    """(path, found): the blocks of every document, as an array of (block_kind, start, n_lines, body)."""
    letter = lambda p: F.when(p["blank"], "b").when(p["kind"] == "heading", "h").when(p["kind"] == "list", "l").otherwise("p")

    def cut(prose: Column, runs: Column) -> Column:
        spans = F.zip_with(runs, offsets(F.transform(runs, lambda r: F.length(r))), lambda r, a: F.struct(r.alias("run"), a.alias("at")))
        some = F.filter(spans, lambda x: ~x["run"].startswith("b"))
        body = lambda x: F.array_join(F.transform(F.slice(prose, x["at"] + 1, F.length(x["run"])), lambda p: p["masked"]), "\n")
        kind = lambda x: F.when(x["run"] == "h", "heading").when(x["run"] == "l", "list").otherwise("paragraph")
        return F.transform(some, lambda x: F.struct(kind(x).alias("block_kind"), F.get(prose, x["at"])["line"].alias("start"), F.length(x["run"]).alias("n_lines"), body(x).alias("body")))

    shape = lambda prose: F.regexp_extract_all(F.array_join(F.transform(prose, letter), ""), F.lit("p+|h|l|b"), F.lit(0))
    found = let(F.col("prose"), lambda prose: let(shape(prose), lambda runs: cut(prose, runs)))
    return with_lines(docs).select("path", found.alias("found"))


def blocks(docs: DataFrame) -> DataFrame:
    """(path, block_id, block_kind, start, n_lines, body) of every block: a run of lines without a blank one; a heading or list line stands alone.

    Each block is cut out of its document before rows fan out, so a row holds its own lines and no others.
    """
    return block_lists(docs).select("path", F.posexplode("found").alias("block_id", "x")).select("path", "block_id", "x.*")


def line_tokens(line: Column, number: Column, col: Column) -> Column:
    """The tokens of a piece of a line from a column on: its parts at their offsets; blanks that open it are a part of their own, left out."""

    def token(x: Column) -> Column:
        text, at = F.rtrim(x["text"], F.lit(" \t")), x["at"] + col
        kind = F.when(F.rlike(text, F.lit(r"^\p{L}")), "word").when(F.rlike(text, F.lit(r"^\p{Nd}")), "number").otherwise("punct")
        return F.struct(text.alias("text"), F.lower(text).alias("lower"), kind.alias("kind"), number.alias("line"), at.alias("col"), number.alias("end_line"), (at + F.length(text)).alias("end_col"))

    def placed(pieces: Column) -> Column:
        both = F.zip_with(pieces, offsets(F.transform(pieces, lambda p: F.length(p))), lambda p, a: F.struct(p.alias("text"), a.alias("at")))
        return F.transform(F.filter(both, lambda x: ~x["text"].startswith(" ") & ~x["text"].startswith("\t")), token)

    return let(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), placed)


def sentence_texts(docs: DataFrame) -> DataFrame:
    """(path, block_id, block_kind, sent_id, line, col, body): where each sentence of a block begins, and its text; sent_id counts inside the block.

    ! and ? always end a sentence. A full stop does if, past what is neither a word nor . ! or ?, a capital or a digit
    follows or nothing. A heading is one sentence. Sentences are cut out of the block's text, so a block of any length
    costs what its text does, and a row holds one sentence.
    """

    def cut(body: Column, kind: Column) -> Column:
        parts = F.when(kind == "heading", F.array(body)).otherwise(F.split(body, SENTENCE_END, -1))
        some = F.filter(parts, lambda s: ~F.rlike(s, F.lit(r"\A[ \t\n]*+\z")))
        line_at = offsets(F.transform(F.split(body, "\n", -1), lambda s: F.length(s) + 1))
        return let(some, lambda some: let(line_at, lambda line_at: placed(some, line_at)))

    def placed(parts: Column, line_at: Column) -> Column:
        at = offsets(F.transform(parts, lambda s: F.length(s)))
        line = offsets(F.transform(parts, lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))))
        rows = F.arrays_zip(parts.alias("body"), F.slice(at, F.lit(1), F.size(parts)).alias("at"), F.slice(line, F.lit(1), F.size(parts)).alias("line"))
        return F.transform(rows, lambda r: F.struct(r["line"].alias("line"), (r["at"] - F.get(line_at, r["line"]) + 1).alias("col"), r["body"].alias("body")))

    rows = blocks(docs).select("path", "block_id", "block_kind", "start", F.posexplode(cut(F.col("body"), F.col("block_kind"))).alias("sent_id", "s"))
    return rows.select("path", "block_id", "block_kind", "sent_id", (F.col("start") + F.col("s.line")).alias("line"), F.col("s.col").alias("col"), F.col("s.body").alias("body"))


def sentences(docs: DataFrame, deal: int = 0) -> DataFrame:
    """(path, block_id, block_kind, sent_id, toks): the tokens of every sentence; deal > 0 deals the sentences to as many partitions first."""
    piece = lambda s, i: line_tokens(s, F.col("line") + i, F.when(i == 0, F.col("col")).otherwise(1))
    rows = sentence_texts(docs)
    return (rows.repartition(deal) if deal else rows).select("path", "block_id", "block_kind", "sent_id", F.flatten(F.transform(F.split("body", "\n", -1), piece)).alias("toks"))


def words_of(toks: Column) -> Column:
    """Word tokens only: numbers and punctuation vanish, so phrases match across them."""
    return F.filter(toks, lambda t: t["kind"] == "word")


def word_count(toks: Column) -> Column:
    """Words and numbers."""
    return F.size(F.filter(toks, lambda t: t["kind"] != "punct"))


def tokens(docs: DataFrame) -> DataFrame:
    """One row per token."""
    return sentences(docs).select("path", "block_id", "block_kind", "sent_id", F.posexplode("toks").alias("tok_idx", "t")).select("path", "block_id", "block_kind", "sent_id", "tok_idx", "t.*")


def words(docs: DataFrame) -> DataFrame:
    """One row per word token, with word_idx inside the sentence."""
    return sentences(docs).select("path", "block_id", "block_kind", "sent_id", F.posexplode(words_of(F.col("toks"))).alias("word_idx", "t")).select("path", "block_id", "block_kind", "sent_id", "word_idx", "t.*")


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(path, block_id, sent_id, block_kind, word_count, line, col, end_line, end_col)."""
    first, last = F.element_at("toks", 1), F.element_at("toks", -1)
    return sentences(docs).select("path", "block_id", "sent_id", "block_kind", word_count(F.col("toks")).alias("word_count"), first["line"].alias("line"), first["col"].alias("col"), last["end_line"].alias("end_line"), last["end_col"].alias("end_col"))
