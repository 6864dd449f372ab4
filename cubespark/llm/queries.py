"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, linededup, media, mixing, quality, simhash, tokens, topk
from .common import read

COUNTER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), COUNTER)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), doc_weight=mixing.length_weight(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "kept_text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs`` (doc_id, text)."""
    coded = bpe.round_trip(docs, RANKS, PATTERN)
    ids, decoded = F.col("coded.ids"), F.col("coded.decoded")
    return coded.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = read(spark, sf_dir, "labels").select("doc_id", quality.label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    graded = quality.grade(docs, quality.train(docs, rated, 3))
    return graded.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen is a conversation up to its last assistant turn; rejected has the last answer of conversation ``conv_id`` + 1
    in that turn's place, or nothing if there is none. Conversations without an assistant turn make no pair."""
    turns = read(spark, sf_dir, "conversations").filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    last = turns.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.max(turn).alias("last"))
    other = last.select(F.try_subtract("conv_id", F.lit(1).cast("long")).alias("conv_id"), F.col("last.text").alias("other"))
    said = lambda chosen, text: F.struct(F.lit(chosen).alias("is_chosen"), F.col(text).alias("text"))
    same, end = turn == F.col("last"), turn <= F.col("last")
    sides = F.array_compact(F.array(F.when(end, said(True, "text")), F.when(end & ~same, said(False, "text")), F.when(same & F.col("other").isNotNull(), said(False, "other"))))
    both = turns.join(last, "conv_id").join(other, "conv_id", "left").select("conv_id", "turn", "role", F.explode(sides).alias("x")).select("conv_id", "turn", "role", "x.*")
    rows = chat.preference_rows(both, F.col("conv_id"), F.col("is_chosen"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return rows.withColumns({c: text(c) for c in ("chosen_spans", "rejected_spans")})


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types are wrong, by the length of the text; what the blobs hold is told by signatures and carved."""
    wrong = F.get(F.array(*map(F.lit, ("image/gif", "application/pdf", "audio/ogg"))), F.pmod(F.coalesce(F.length("text"), F.lit(0)), F.lit(3)))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", wrong.alias("declared"))
    found = media.carve(media.sniff(media.store(docs), "media", "declared"), "media")
    back = media.read_back(found, "carved")
    each = F.transform("found", lambda x: F.concat(x["type"], F.lit("@"), x["start"], F.lit("+"), x["length"]))
    return back.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "actual_type", F.array_join(each, ",")).alias("feature"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_source_mix, op3_line_dedup, op4_simhash, op5_byte_bpe, op6_quality, op7_preference_chat, op8_langid, op9_media, op10_topk)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mix": """
            with counted as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
            docs as (select *, length(bin(size)) as tilt from counted),
            sizes as (select source, sum(size)::bigint as source_size, sum(size * tilt)::double as tilted from docs group by source),
            named as (select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w, 2 * source_size as cap from sizes),
            filled as (select *, row_number() over f as nth,
                coalesce(sum(cap) over (f rows between unbounded preceding and 1 preceding), 0)::bigint as before,
                sum(w) over (f rows between current row and unbounded following)::bigint as w_left,
                sum(source_size) over ()::bigint * 3 as wanted
                from named window f as (order by source_size::double / w::double, source nulls last)),
            levels as (select *, wanted - before * 2 as left_, w * (wanted - before * 2) >= cap * w_left * 2 as is_full from filled),
            free as (select left_ as l, w_left as wl from levels where not is_full order by nth limit 1),
            targets as (select source, source_size, tilted, case when is_full then cap::double else (w * (select l from free))::double / ((select wl from free) * 2)::double end as target from levels),
            drawn as (select d.*, t.source_size, t.target, t.tilted, (('0x' || substr(md5(coalesce(doc_id::varchar, '~') || '|' || size::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u,
                case when t.source_size > 0 then target / t.source_size::double else 0.0 end as e
                from docs d join targets t on d.source is not distinct from t.source),
            parts as (select *, floor(e) as whole, least(greatest((e - floor(e)) * case when tilted > 0 then tilt::double * (source_size::double / tilted) else 0.0 end, 0.0), 1.0) as p from drawn),
            ranked as (select *, least(floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 68719476736.0), 68719476735.0)::bigint as slot,
                case when whole < 2 then size else 0 end as extra from parts),
            slots as (select source, slot, any_value(target) - 0 as target, sum(extra)::bigint as words from ranked group by source, slot),
            needs as (select source, any_value(target) - sum(whole::bigint * size)::bigint as need from ranked group by source),
            walked as (select s.source, s.slot, need, words, sum(words) over (partition by s.source order by s.slot)::bigint as upto
                from slots s join needs n on s.source is not distinct from n.source),
            taken as (select source, slot, 2 * (upto - words) + words <= 2 * need as more from walked)
            select doc_id, size, source_size, target, (size * (whole::bigint + case when more and whole < 2 then 1 else 0 end))::bigint as taken
            from ranked r join taken t on r.source is not distinct from t.source and r.slot = t.slot
        """,
        "op3_line_dedup": """
            with docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
            wins as (select doc_id, text, unnest(range(len(ls) - 2)) as pos, ls from docs where len(ls) >= 3),
            seen as (select doc_id, text, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] as w from wins),
            numbered as (select *, row_number() over (partition by w order by doc_id nulls last, pos) as nth from seen where regexp_matches(w, '[^\\x20\\x09-\\x0D]')),
            gone as (select distinct doc_id, pos + k as pos from numbered, (select unnest([0, 1, 2]) as k) where nth > 1),
            lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs where text is not null),
            kept as (select l.doc_id, count(*)::bigint as n_lines, count(g.pos)::bigint as n_removed,
                coalesce(string_agg(line, chr(10) order by l.pos) filter (where g.pos is null), '') as kept_text
                from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
            select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, kept_text
            from documents d left join kept using (doc_id)
        """,
        "op7_preference_chat": """
            with raw as (select conv_id, turn, replace(coalesce(role, ''), '<|im_', '<| im_') as role, replace(coalesce(text, ''), '<|im_', '<| im_') as text
                from conversations where conv_id is not null),
            numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from raw),
            final as (select * from numbered where role = 'assistant' qualify row_number() over (partition by conv_id order by i desc) = 1),
            ends as (select n.conv_id, min(n.i) as a, max(n.i) as z from numbered n join final f on n.conv_id = f.conv_id and n.turn is not distinct from f.turn and n.role = f.role and n.text = f.text group by 1),
            sides as (select conv_id, 0 as side, turn, role, text from numbered join ends using (conv_id) where i <= z
                union all select conv_id, 1, turn, role, text from numbered join ends using (conv_id) where i < a
                union all select n.conv_id, 1, n.turn, n.role, f.text from numbered n join ends e on n.conv_id = e.conv_id and n.i between a and z join final f on f.conv_id = n.conv_id + 1),
            t as (select conv_id as pair_id, side, role, text, row_number() over (partition by conv_id, side order by turn nulls first, role, text) - 1 as i from sides),
            c as (select * from t where side = 0), r as (select * from t where side = 1),
            lens as (select pair_id, least(count(*) filter (where side = 0), count(*) filter (where side = 1)) as both_ from t group by pair_id),
            diff as (select c.pair_id, min(c.i) as first from c join r on c.pair_id = r.pair_id and c.i = r.i where c.role <> r.role or c.text <> r.text group by c.pair_id),
            pre as (select pair_id, coalesce(first, both_)::bigint as n from lens left join diff using (pair_id)),
            said as (select t.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as s,
                12 + length(role) + 1 as head, length(text) + 10 as body from t join pre using (pair_id)),
            laid as (select *, coalesce(sum(length(s)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) as at_ from said where i >= n),
            done as (select pair_id, side, string_agg(s, '' order by i) as text,
                string_agg((at_ + head)::bigint || '-' || (at_ + head + body)::bigint, ',' order by i) filter (where role = 'assistant') as spans from laid group by pair_id, side)
            select p.pair_id, p.n as n_prompt_turns,
                coalesce((select string_agg(s, '' order by i) from said where said.pair_id = p.pair_id and side = 0 and i < said.n), '') as prompt,
                coalesce(dc.text, '') as chosen, coalesce(dr.text, '') as rejected, coalesce(dc.spans, '') as chosen_spans, coalesce(dr.spans, '') as rejected_spans
            from pre p left join done dc on p.pair_id = dc.pair_id and dc.side = 0 left join done dr on p.pair_id = dr.pair_id and dr.side = 1
        """,
        "op10_topk": """
            with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
                where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            pairs as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
                from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
            ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
            select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
        """,
    }
