"""Queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, fst, linededup, lm, mixing, quality, ranked, search, simhash, toxicity, variants
from .common import is_held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


SQL["op1_line_dedup"] = r"""
with cut as (select doc_id, string_split(text, chr(10)) as l from documents),
 all_lines as (select doc_id, unnest(l) as line, unnest(range(len(l))) as pos from cut),
 worded as (select doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line from all_lines),
 sized as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from worded where line <> ''),
 placed as (select *, sum(words) over (partition by doc_id order by pos) as after, sum(words) over (partition by doc_id order by pos) - words as before,
   sum(words) over (partition by doc_id) as total from sized),
 windows as (
   select doc_id, min(pos) over w as start, max(pos) over w as stop, list(line) over w as content, before + 50 <= total as whole from placed
     window w as (partition by doc_id order by before range between current row and 49 following)
   union
   select doc_id, min(pos) over w, max(pos) over w, list(line) over w, after >= 50 from placed
     window w as (partition by doc_id order by after range between 49 preceding and current row)),
 firsts as (select content, min({'doc_id': doc_id, 'start': start, 'stop': stop}) as f from windows where whole group by content having count(*) > 1),
 hits as (select w.doc_id, w.start, w.stop from windows w join firsts f on w.content = f.content where w.whole and not (w.doc_id = f.f.doc_id and w.start <= f.f.stop)),
 kept as (select a.* from all_lines a where not exists (select 1 from hits h where h.doc_id = a.doc_id and a.pos between h.start and h.stop)),
 texts as (select doc_id, string_agg(line, chr(10) order by pos) as text from kept group by doc_id)
select d.doc_id, cast(length(coalesce(t.text, '')) as bigint) as chars_left, sha256(coalesce(t.text, '')) as text_sha256 from documents d left join texts t on t.doc_id = d.doc_id"""


@query
def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.bm25_topk(docs, docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")).withColumn("score", F.round("score", 6))


SQL["op2_search"] = r"""
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
 s as (select count(*) as n, avg(len(l)) as average from w),
 tf as (select doc_id, size, term, count(*) as tf from (select doc_id, len(l) as size, unnest(l) as term from w) group by all),
 df as (select term, count(*) as df from tf group by term),
 scored as (select q.doc_id as query_id, d.doc_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.size / s.average))), 9) as score
   from tf q join tf d on d.term = q.term join df f on f.term = q.term cross join s where q.doc_id % 50 = 0 and d.doc_id <> q.doc_id group by 1, 2),
 ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)
select query_id, cast(rank as int) as rank, doc_id, round(score, 6) as score from ranked where rank <= 10"""


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


SQL["op3_lm_scoring"] = r"""
with docs as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
 tokens as (select doc_id, unnest(list_zip(list_concat([''], w), w)) as p from docs),
 pairs as (select doc_id, p[1] as a, p[2] as b from tokens where p[2] is not null),
 pair as (select a, b, count(*) as n, count(distinct doc_id) as d from pairs group by a, b),
 context as (select a, count(*) as n from pairs group by a),
 word as (select b, count(*) as n, sum(count(*)) over () as total from pairs group by b),
 scored as (select p.doc_id, sum(case when q.d > 1 then ln(q.n::double) - ln(c.n::double) else ln(0.4::double) + ln(w.n::double) - ln(w.total::double) end) as s
   from pairs p join pair q on p.a = q.a and p.b = q.b join context c on c.a = p.a join word w on w.b = p.b group by p.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, round(coalesce(s.s, 0), 3) as log_score from docs d left join scored s on s.doc_id = d.doc_id"""


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op5_mixing"] = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5('17:' || doc_id || ':' || coalesce(text, '')), 1, 15) as bigint) as key from documents),
 per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
 weighed as (select *, [3.0::double, 1.0::double, 2.0::double][cast((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 as int)] as weight from per),
 filled as (select *, 2.0::double * source_size / weight as full_at from weighed),
 levels as (select *, (sum(source_size::double) over () * 1.5::double - coalesce(sum(2.0::double * source_size) over w, 0))
    / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level from filled
    window w as (order by full_at, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
 stop as (select arg_min(level, struct_pack(a := full_at, b := source is null, c := encode(source))) as stop from levels where level <= full_at),
 targets as (select source, source_size, least(2.0::double * source_size, coalesce((select stop from stop), 'infinity'::double) * weight) as target from levels),
 placed as (select s.*, t.source_size, t.target, cast(coalesce(sum(size) over (partition by s.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
    cast(round(t.target) as bigint) as whole from sized s join targets t on s.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target, cast(case when source_size = 0 then 0 else (whole // source_size) * size
    + greatest(0, least(size, whole % source_size - before)) end as bigint) as taken from placed"""


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Conversation -7: a user and an assistant who both say control strings.
ESCAPES = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(ESCAPES, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(said.unionByName(extra))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for plain, safe in chat.CONTROL.items():
        out = f"replace({out}, '{plain}', '{safe}')"
    return out


SQL["op9_chat_formatting"] = f"""
with said as (select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(coalesce(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' order by turn, role, text), '')) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(coalesce(text, '')) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then coalesce(text, '') end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum({len(chat.TURN) + len(chat.SAID) + len(chat.END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) as bigint) as formatted_chars
from said group by conv_id"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_ranked_search"] = r"""
with cut as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) as l from documents),
 asked as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
 s as (select count(*)::bigint as n_docs, sum(len(l))::bigint as length from cut where len(l) > 0),
 tf as (select doc_id, size, term, count(*)::bigint as tf from (select doc_id, len(l)::bigint as size, unnest(l) as term from cut) group by all),
 df as (select term, count(*)::bigint as df from tf group by term),
 w as (select f.term, cast(floor(1000 * ln((2 * s.n_docs + 2)::double / (2 * f.df + 1)::double)) as bigint) as w from df f cross join s),
 scored as (select q.item_id, t.doc_id, cast(sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.size * s.n_docs) // s.length)))) as bigint) as score
   from asked q join tf t on t.term = q.term join w on w.term = q.term cross join s group by 1, 2),
 ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10"""


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fst.round_trip(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
