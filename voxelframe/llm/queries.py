"""The operators over their whole tables, with production parameters, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import bpe, decontaminate, divergence, hard_negatives, jaccard, licences, packed_ids, phrases, ranked_search, simhash, toxicity, warc, winnow
from voxelframe.session import sound_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(lambda table: sound_unions(spark).read.parquet(f"{folder}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return fn

    return wrap


BLANKS = r"\x20\x09-\x0D"

QUALITY_SQL = rf"""
with named as (
  select doc_id, coalesce(text, '') as text,
         case when regexp_matches(lower(lang), '^[a-z]{{2,3}}$') then lower(lang) else '' end as lang
  from documents
), spelled as (
  select doc_id, lang, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') as ws from named
), own_counts as (
  select lang, w, count(*) as n from (select lang, unnest(ws) as w from spelled) group by all
), totals as (
  select lang, sum(n) as total from own_counts group by lang having lang <> '' and sum(n) >= {divergence.LANGUAGE_SHARE} * (select sum(n) from own_counts)
  union all select '', sum(n) from own_counts having sum(n) > 0
), d as (
  select doc_id, text, coalesce(t.lang, '') as lang, ws from spelled left join totals t using (lang)
), letters as (
  select doc_id, lang, ws from d
), counts as (
  select lang, w, n from own_counts where lang <> '' union all select '', w, sum(n) from own_counts group by w
), common as (
  select lang, w, n, total from counts join totals using (lang) where n >= total * {divergence.COMMON_SHARE}
), word_ref as (
  select lang, w, n / total::double as q from common
  union all select lang, '' as w, (any_value(total) - sum(n)) / any_value(total)::double from common group by lang
), long_docs as (
  select doc_id, lang, ws, len(ws) as n from letters join totals using (lang) where len(ws) >= {divergence.MIN_WORDS}
), doc_words as (
  select doc_id, any_value(x.n) as n, case when c.w is null then '' else x.w end as w, count(*) as k
  from (select doc_id, lang, n, unnest(ws) as w from long_docs) x left join common c on c.lang = x.lang and c.w = x.w group by doc_id, 3
), word_d as (
  select doc_id, sqrt(greatest((sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2, 0)) as d
  from (
    select l.doc_id, r.q, coalesce(w.k, 0) / l.n::double as p
    from (select doc_id, lang, n from long_docs) l join word_ref r using (lang) left join doc_words w on w.doc_id = l.doc_id and w.w = r.w
  ) group by doc_id
), cls as (
  select doc_id, lang, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as c, unnest([
    length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
    length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^{BLANKS}]', '', 'g')),
    length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')),
    length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F+/<=>@\[\\\]^_`{{|}}~\x7F]', '', 'g')),
    length(regexp_replace(text, '[^#$%&*]', '', 'g')),
    length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))]) as n
  from d
), class_ref as (
  select lang, c, sum(n) / sum(sum(n)) over (partition by lang)::double as q
  from (select lang, c, n from cls where lang <> '' union all select '', c, n from cls) join totals using (lang) group by lang, c
), class_d as (
  select doc_id, any_value(total) as total, sqrt(greatest((sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2, 0)) as d
  from (select doc_id, q, n / (sum(n) over (partition by doc_id))::double as p, sum(n) over (partition by doc_id) as total from cls join class_ref using (lang, c))
  where total >= {divergence.MIN_CHARS} group by doc_id
), words as (
  select doc_id, text, regexp_extract_all(text, '[^{BLANKS}]+') as ws from d
), grams as (
  select doc_id, i, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from words)
), again as (
  select doc_id, count(distinct i + j) as n
  from (select doc_id, i, unnest(range(0, 5)) as j from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1) group by doc_id
), dup_lines as (
  select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from d)
  where regexp_matches(l, '[^{BLANKS}]') group by doc_id
), base as (
  select w.doc_id, len(ws) as n_words, length(regexp_replace(text, '[{BLANKS}]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(a.n, 0) as n_repeat_words
  from words w left join dup_lines l using (doc_id) left join again a using (doc_id)
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and coalesce(c.d <= {divergence.MAX_CLASS_DISTANCE} * sqrt(greatest(1, {divergence.FULL_CHARS} / c.total::double)), true) and coalesce(w.d, 0) <= {divergence.MAX_WORD_DISTANCE} as kept
from judged left join class_d c using (doc_id) left join word_d w using (doc_id)
"""


@query("op1_distribution_divergence", QUALITY_SQL)
def op1(table):
    return divergence.quality(table("documents")).drop("class_distance", "word_distance")


@query("op2_bm25_decontamination")
def op2(table):
    hits = decontaminate.search(table("documents"), table("benchmark"))
    return hits.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


@query("op3_warc_index_merge")
def op3(table):
    return warc.write_and_read(table("pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "range_pos")


@query("op4_licence_automaton")
def op4(table):
    return licences.scan(table("documents")).drop("spans")


@query("op5_ftrl_toxicity")
def op5(table):
    docs = table("documents")
    return toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), table("labels")))


@query("op6_packed_token_ids")
def op6(table):
    return packed_ids.write_and_read(table("documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_phrase_automata")
def op7(table):
    return phrases.remove_repeats(table("documents"), with_text=False)


@query("op8_ngram_jaccard_join")
def op8(table):
    return jaccard.components(table("documents")).select("doc_id", "n_shingles", "component_id", "class_id")


LINES_SQL = rf"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), f as (
  select doc_id, i, line, len(regexp_extract_all(line, '[^{BLANKS}]+')) as n, row_number() over (partition by doc_id order by i) - 1 as p from l where regexp_matches(line, '[^{BLANKS}]')
), runs as (
  select doc_id, p, line, lead(line) over w as l2, lead(line, 2) over w as l3, n, n + lead(n) over w as n2 from f window w as (partition by doc_id order by p)
), candidates as (
  select doc_id, p, 3 as k, [line, l2, l3] as run from runs where l3 is not null
  union all select doc_id, p, 2, [line, l2] from runs where n2 >= {winnow.MIN_WORDS}
  union all select doc_id, p, 1, [line] from runs where n >= {winnow.MIN_WORDS}
), later as (
  select doc_id, p, k from (select doc_id, p, k, row_number() over (partition by run order by doc_id, p) as place from candidates) where place > 1
), gone as (
  select distinct doc_id, p + j as p from later, unnest([0, 1, 2]) as u(j) where j < k
), marked as (
  select f.*, gone.p is not null as dropped from f left join gone using (doc_id, p)
), counts as (
  select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_removed from marked group by doc_id
), texts as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) as kept from l left join marked m on m.doc_id = l.doc_id and m.i = l.i where not coalesce(m.dropped, false) group by l.doc_id
)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(case when n_removed > 0 and n_removed = n_lines then '' when n_removed > 0 then t.kept else coalesce(d.text, '') end) as kept_sha256
from documents d left join counts using (doc_id) left join texts t using (doc_id)
"""


@query("op9_line_winnowing", LINES_SQL)
def op9(table):
    done = winnow.dedup_lines(table("documents"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_bpe_merge_replay")
def op10(table):
    decoded = bpe.decode(bpe.encode(table("documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_bit_sliced_simhash")
def op11(table):
    done = simhash.components(table("documents"))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.vec, b.vec)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id, (row_number() over w)::int as rank, other_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, other_id)
qualify row_number() over w <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(table):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table("embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


SEARCH_SQL = rf"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{ranked_search.UPPER}', '{ranked_search.LOWER_CASE}'), '{ranked_search.TERM}')) as term from documents
), tfs as (
  select doc_id, term, count(*) as tf from words group by all
), lens as (
  select doc_id, sum(tf)::bigint as n from tfs group by all
), totals as (
  select count(*) as n_all, sum(n)::bigint as l_all from lens
), weights as (
  select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)))::bigint as w from tfs, totals group by term, n_all
), asked as (
  select item_id, unnest(regexp_extract_all(translate(text, '{ranked_search.UPPER}', '{ranked_search.LOWER_CASE}'), '{ranked_search.TERM}')) as term from benchmark
), scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all))))::bigint as score
  from asked join tfs using (term) join weights using (term) join lens using (doc_id), totals group by all
)
select item_id, (row_number() over r)::int as rank, doc_id, score from scores where score > 0
window r as (partition by item_id order by score desc, doc_id) qualify row_number() over r <= 10
"""


@query("op13_nra_ranked_search", SEARCH_SQL)
def op13(table):
    return ranked_search.search(table("documents"), table("benchmark"))
