"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.arrays import let
from plumbline.llm import (
    chat_format, embedding_dedup, language_id, merkle_manifest, minhash_dedup, nearest_neighbours, periodic_runs, quality_crf, secret_scans,
    sentencepiece_codec, source_mixing, substring_dedup, url_filters,
)
from plumbline.llm.common import WORD, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7, formatted and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    out = chat_format.read_back(chat_format.format_conversations(chat_format.conversation_messages(rows.unionByName(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        F.get_json_object("tree", "$.conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Fixed values of the contract.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by rules, else by segmentation and naive Bayes."""
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scans.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scans.BASE))
    return found.select("doc_id", *map(count, secret_scans.BASE), F.sha2(secret_scans.joined(base), 256).alias("base_sha256"), secret_scans.joined(F.col("spans")).alias("spans"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: The vocabulary file; read on the driver only.
PIECES_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str, path: str = PIECES_PATH) -> DataFrame:
    """Ids of every whole document, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load(path), ["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that language models never see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    got = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out())
    return got.select("doc_id", (~F.col("trained")).alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    out = source_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every vector whose id is divisible by 50."""
    return nearest_neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def id_crc(doc_id: str = "doc_id") -> Column:
    """Unsigned crc32 of the id in decimal; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, proof and verification; where 3 divides the id's crc32, the text claimed is the lower-cased one."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = F.when(id_crc() % 3 == 0, merkle_manifest.digest(*map(F.col, fields), lower))
    return merkle_manifest.manifest(docs, [*fields, "text"], claimed=claimed)


#: A document is good from this score on. A fixed value of the contract.
GOOD_SCORE = 0.3


def op12_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of those not held out: one in five is, by its id's crc32."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(id_crc() % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    got = quality_crf.quality(docs, labels, with_lines=False)
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def planted(text: Column) -> Column:
    """The text, or for one document in ten its words with a period of p from word a on (the contract's rule)."""
    g = F.floor(id_crc() / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        word = lambda i, a, p: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))
        every = let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: word(i, x["a"], x["p"])))
        return F.when(n > 0, F.array_join(every, " "))

    return F.when(id_crc() % 10 == 0, F.coalesce(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeated), text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, some with periods planted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.coalesce("text", F.lit(""))).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_url_filter, op3_secret_scan, op4_embedding_dedup, op5_sentencepiece, op6_substring_dedup, op7_minhash_dedup, op8_source_mix, op9_language_id,
        op10_nearest_neighbours, op11_merkle_manifest, op12_quality_crf, op13_periodic_runs,
    )
}

#: Unsigned crc32 of doc_id in decimal; the polynomial is fixed.
ID_CRC = """xor(4294967295::ubigint, list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::ubigint),
            lambda a, c: list_reduce([xor(a, c)] || range(8)::ubigint[], lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384::ubigint) else s >> 1 end)))"""

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": f"""
        with recursive rows(id, v, ok) as (
            select vec_id as id, embedding::double[] as v, coalesce(len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0, false) as ok from embeddings),
        good as (select id, v from rows where ok),
        links as (select a.id as a, b.id as b from good a join good b on a.id <> b.id where list_cosine_similarity(a.v, b.v) >= {embedding_dedup.COSINE}),
        reach(id, seen) as (select id, id from rows union select r.id, l.b from reach r join links l on r.seen = l.a),
        low as (select id, min(seen) as component_id from reach group by id),
        n as (select a as id, count(*) as n_links from links group by a)
        select id as vec_id, coalesce(n_links, 0) as n_links, component_id, id = component_id as kept from low left join n using (id)""",
    "op7_minhash_dedup": r"""
        with recursive split as (
            select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        rows as (
            select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from split),
        shingles as (select id, len(s) as n, unnest(s) as s from rows),
        links as (
            select a.id as a, b.id as b from shingles a join shingles b on a.s = b.s and a.id <> b.id
            group by a.id, b.id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(id, seen) as (select id, id from rows union select r.id, l.b from reach r join links l on r.seen = l.a),
        low as (select id, min(seen) as component_id from reach group by id)
        select id as doc_id, cast(len(s) as bigint) as n_shingles, component_id, id = component_id as kept from low join rows using (id)""",
    "op1_chat_format": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e as (
            select *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
                + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) as body
            from c)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(length(role) + body + 4 + 2 + 8) as bigint) as formatted_chars
        from e group by conv_id""",
    "op11_merkle_manifest": r"""
        with recursive
        f as (
            select row_number() over () as rid, doc_id, lang,
                coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
                text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
            from documents),
        l as (
            select rid, doc_id, coalesce('=' || lang, '') as g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) as low
            from f),
        p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from l),
        lv(g, k, i, n, h) as (
            select g, 0, i, n, leaf from p
            union all
            select g, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from lv where n > 1 group by g, k, i // 8, n),
        sub as (select g, h, row_number() over (order by encode(g)) - 1 as i, count(*) over () as n from lv where n = 1),
        up(k, i, n, h) as (
            select 0, i, n, h from sub
            union all
            select k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from up where n > 1 group by k, i // 8, n),
        kind as (select rid, doc_id, g, i, leaf, case when crc % 3 = 0 then low else leaf end as claimed from (select *, @CRC@ as crc from p)),
        fold(rid, g, k, i, h, sib) as (
            select rid, g, 0, i, claimed, '' from kind
            union all
            select f.rid, f.g, f.k + 1, f.i // 8, sha256(string_agg(case when x.i = f.i then f.h else x.h end, '' order by x.i)), f.sib || coalesce(string_agg(x.h, '' order by x.i) filter (where x.i <> f.i), '')
            from fold f join lv x on x.g = f.g and x.k = f.k and x.i // 8 = f.i // 8 and x.n > 1 group by f.rid, f.g, f.k, f.i, f.h, f.sib),
        half as (select rid, fold.g, s.i, fold.h, sib, s.h as subroot from fold join sub s on s.g = fold.g where k = (select max(k) from lv where lv.g = fold.g)),
        rise(rid, k, i, h, sib) as (
            select rid, 0, i, h, sib from half
            union all
            select f.rid, f.k + 1, f.i // 8, sha256(string_agg(case when x.i = f.i then f.h else x.h end, '' order by x.i)), f.sib || coalesce(string_agg(x.h, '' order by x.i) filter (where x.i <> f.i), '')
            from rise f join up x on x.k = f.k and x.i // 8 = f.i // 8 and x.n > 1 group by f.rid, f.k, f.i, f.h, f.sib)
        select kind.doc_id, kind.leaf, half.subroot, root.h as root, sha256(r.sib) as proof_sha256, r.h as folded_root, r.h = root.h as verified
        from kind join half using (rid) join rise r using (rid) join (select h from up where n = 1) root on true
        where r.k = (select max(k) from up)""".replace("@CRC@", ID_CRC),
    "op13_periodic_runs": r"""
        with h as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, @CRC@ as h from documents),
        g as (select *, len(w) as n, h // 10 as g from h),
        d as (
            select rid, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end as w
            from (select *, 1 + (n - a) // (3 + (g % 8)::bigint) as p from (select *, case when n > 0 then (g % n)::bigint end as a from g))),
        e as (select rid, n, unnest(w) as x, unnest(range(n)) as i from d),
        pairs as (select a.rid, b.i - a.i as q, a.i from e a join e b on a.rid = b.rid and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
        stretches as (
            select rid, min(i) as s, count(*) + q as len, q from (select *, i - row_number() over (partition by rid, q order by i) as same from pairs) group by rid, q, same
            having count(*) + q >= greatest(6, 4 * q)),
        runs as (select rid, s, len, min(q) as q from stretches group by rid, s, len),
        own as (
            select rid, count(*) as n_runs, max({'len': len, 's': -s, 'q': -q}) as top, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as said from runs group by rid),
        gone as (select distinct rid, unnest(range(s + q, s + len)) as i from runs),
        kept as (select rid, string_agg(x, ' ' order by i) as t from e anti join gone using (rid, i) group by rid)
        select doc_id, coalesce(n_runs, 0) as n_runs, -top.s as start, top.len as length, -top.q as period, 1000 * top.len // -top.q as exponent_milli,
            sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
        from d left join own using (rid) left join kept using (rid)""".replace("@CRC@", ID_CRC),
}
