"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, gif, langid, lines, mixing, phrases, pieces, quality, resample, simhash, tokencount, urls, warc
from gridloom.llm.common import fold_of, table

URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Parts of the mix by source; the others have one part each.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}
UNIT = 576


def hex_digest(text: F.Column) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the label row with its id: bad if toxic or of no quality."""
    labels = table(spark, sf_dir, "labels")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
with parts as (
  select page_id,
    translate(case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
marks as (
  select doc_id, max(case when coalesce(toxic = 1, false) or coalesce(quality = 0, false) then 1 else 0 end) as bad
  from labels where doc_id is not null group by doc_id),
named as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as k,
    regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\d*$', '') as bare
  from parts left join marks on marks.doc_id = parts.page_id group by host),
hosts as (
  select *, split_part(bare, '.', -1) as suffix,
    case when length(bare) - length(split_part(bare, '.', -1)) - 1 <= 0 then bare
      else split_part(bare, '.', -2) || '.' || split_part(bare, '.', -1) end as domain
  from named),
d0 as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
s0 as (select suffix, sum(n) as n, sum(k) as k, (select (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) from hosts) as parent from d0 group by suffix),
sm as (select 1 / least(greatest(coalesce((sum(n * pow(k / n - parent, 2)) - sum(parent * (1 - parent))) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 as m from s0 where n > 0),
s1 as (select suffix, (m * parent + k) / (m + n) as parent from s0, sm),
d1 as (select d0.*, s1.parent from d0 join s1 using (suffix)),
dm as (select 1 / least(greatest(coalesce((sum(n * pow(k / n - parent, 2)) - sum(parent * (1 - parent))) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 as m from d1 where n > 0),
d2 as (select domain, (m * parent + k) / (m + n) as parent from d1, dm),
h1 as (select hosts.*, d2.parent from hosts join d2 using (domain)),
hm as (select 1 / least(greatest(coalesce((sum(n * pow(k / n - parent, 2)) - sum(parent * (1 - parent))) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 as m from h1 where n > 0),
ab as (select host, m * parent + k as a, m * (1 - parent) + n - k as b from h1, hm),
bound as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from ab),
ruled as (
  select page_id, host, path, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from parts)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when low > 0.5 then 'block' else 'allow' end as verdict
from ruled join bound using (host)
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = pieces.PieceCodec(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return _piece_digests(codec, table(spark, sf_dir, "documents"))


def _piece_digests(codec: pieces.PieceCodec, docs: DataFrame) -> DataFrame:
    coded = docs.select("doc_id", codec.round_trip(F.col("text")).alias("coded"))
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join(F.col("coded.ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_digest(F.col("coded.decoded")).alias("decoded_sha256"),
    )


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    docs = docs.select(
        F.struct("doc_id", F.octet_length("raw").cast("long").alias("n_bytes")).alias("key"),
        F.expr(f"rpad(raw, cast(greatest(1, ceil(octet_length(raw) / {UNIT})) * {UNIT} as int), X'FF')").alias("payload"),
    )
    read = gif.decode_gif(gif.as_gif(docs, "key", "payload"), "id", "media")
    return read.select(
        "id.doc_id",
        "id.n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.col("histogram").cast("array<string>"), ",").alias("feature"),
        F.size("frames").cast("long").alias("n_frames"),
        F.aggregate("frames", F.lit(0), lambda s, f: s + f["delay_ms"]).cast("long").alias("duration_ms"),
    )


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole."""
    counter = tokencount.TokenCounter(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", counter.by_section(F.col("text")).alias("sections"))
    return docs.selectExpr("doc_id", "inline(sections)").withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
f as (select digest, max(page_id) as first_id from d where n >= 1000 group by digest)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from first_id then first_id end as refers_to
from d left join f using (digest)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    judged = docs.select("doc_id", quality.quality(docs, F.col("text"), model).alias("q"))
    return judged.select("doc_id", *(f"q.{c}" for c in quality.BASE), "q.base_failed", "q.kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs)
    found = docs.select("doc_id", langid.language(docs, F.col("text"), model).alias("l"))
    return found.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        F.col("l.lang").alias("lang_pred"),
        "l.score",
        "l.rejected",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _, _ = mixing.mix_sources(table(spark, sf_dir, "documents"), "source", SOURCE_WEIGHTS)
    return mixed


OP9_SQL = """
with sizes as (select source, count(*) as size, case source when 'src0' then 4.0 when 'src1' then 3.0 when 'src2' then 2.0 when 'src3' then 0.5 else 1.0 end as weight from documents group by source),
means as (select source, cast(weight as double) / (select sum(cast(weight as double)) from sizes) * (select sum(size) from sizes) / size as mean from sizes),
parts as (select source, greatest(1, cast(ceil(mean / 16) as int)) as draws, mean / greatest(1, cast(ceil(mean / 16) as int)) as mean from means),
terms as (select source, draws, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) as p from parts, range(0, 85) t(k)),
sums as (select source, draws, list(s order by k) as sums from (select source, draws, k, sum(p) over (partition by source order by k) as s from terms) group by source, draws),
rows as (
  select *, digest || ':' || cast(row_number() over (partition by digest) as varchar) as row from (
    select *, md5(concat_ws(chr(31), coalesce(cast(doc_id as varchar), chr(30) || 'null'), coalesce(text, chr(30) || 'null'), coalesce(lang, chr(30) || 'null'), coalesce(source, chr(30) || 'null'), coalesce(cast(n_chars as varchar), chr(30) || 'null'))) as digest
    from documents)),
drawn as (
  select row, r.source, s.sums, (cast('0x' || substr(md5(row || ':mix:' || cast(d.j as varchar)), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u
  from rows r join sums s on s.source is not distinct from r.source, unnest(range(1, s.draws + 1)) d(j)),
counts as (select row, cast(sum(len(list_filter(sums, lambda c: c <= u))) as bigint) as n from drawn group by row)
select t.doc_id, t.text, t.lang, t.source, t.n_chars, cast(c.copy as int) as copy, md5(row || ':' || cast(c.copy as varchar) || ':mix-order') as shuffle_key
from rows t join counts n using (row), unnest(range(1, n.n + 1)) c(copy)
"""


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
with said as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, speaker as perspective from said where speaker <> 'system'),
seen as (
  select s.*, perspective, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role
  from said s join people p on s.conv_id is not distinct from p.conv_id),
headed as (select *, '<|im_start|>' || role || case when role = 'user' then ' name=' || regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') else '' end || chr(10) as head from seen),
shown as (select *, head || text || '<|im_end|>' || chr(10) as rendered from headed),
placed as (select *, cast(sum(length(rendered)) over (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding) as bigint) as char_end from shown)
select conv_id, perspective, turn, role, speaker, rendered, char_end - length(rendered) as char_start, char_end,
  case when role = 'assistant' then char_end - length(rendered) + length(head) end as loss_start,
  case when role = 'assistant' then char_end - 1 end as loss_end
from placed
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = lines.LineIndex.build(docs)
    cleaned, found = index.clean(docs)
    return cleaned.select("doc_id", f"{found}.n_lines", f"{found}.n_dropped", hex_digest(F.col(f"{found}.text")).alias("kept_sha256"))


OP11_SQL = r"""
with l as (
  select doc_id, u.line, u.k, translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), unnest(list_transform(ls, lambda x, i: {'line': x, 'k': i})) t(u)),
shared as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (select l.*, shared.first is not null and doc_id <> shared.first as gone from l left join shared on l.key = shared.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select row_number() over () as piece, lang, words from (
    select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') as words from (
      select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) as p
      from documents))),
w as (select lang, words[i] as w1, words[i + 1] as w2, words[i + 2] as w3 from (select lang, words, unnest(range(1, len(words) + 1)) as i from pieces)),
totals as (select lang, count(*) as n from w group by lang),
f1 as (select lang, w1, count(*)::hugeint as n from w group by all),
f2 as (select lang, w1, w2, count(*)::hugeint as n from w where w2 is not null group by all having count(*) >= 10),
f3 as (select lang, w1, w2, w3, count(*)::hugeint as n from w where w3 is not null group by all having count(*) >= 10),
c3 as (
  select f3.*, a.n as l1, b.n as r1, c.n as l2, d.n as r2, 1000000 * f3.n * f3.n // (a.n * b.n) as s1, 1000000 * f3.n * f3.n // (c.n * d.n) as s2
  from f3 join f1 a on a.lang = f3.lang and a.w1 = f3.w1 join f2 b on b.lang = f3.lang and b.w1 = f3.w2 and b.w2 = f3.w3
  join f2 c on c.lang = f3.lang and c.w1 = f3.w1 and c.w2 = f3.w2 join f1 d on d.lang = f3.lang and d.w1 = f3.w3),
inside as (select lang, w1, w2 from c3 where 100 * n >= 50 * l2 union select lang, w2, w3 from c3 where 100 * n >= 50 * r1),
found as (
  select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.n as a, x.n as l, y.n as r, 1000000 * f2.n * f2.n // (x.n * y.n) as score
  from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
  anti join inside on inside.lang = f2.lang and inside.w1 = f2.w1 and inside.w2 = f2.w2
  union all
  select lang, w1 || ' ' || w2 || ' ' || w3, n, case when s2 < s1 then l2 else l1 end, case when s2 < s1 then r2 else r1 end, least(s1, s2) from c3),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from found)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""

QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_gif_media": op3_gif_media,
    "op4_token_attribution": op4_token_attribution,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_source_mix": op9_source_mix,
    "op10_chat_rotation": op10_chat_rotation,
    "op11_line_dedup": op11_line_dedup,
    "op12_resample": op12_resample,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {
    "op1_url_reputation": OP1_SQL,
    "op5_warc": OP5_SQL,
    "op9_source_mix": OP9_SQL,
    "op10_chat_rotation": OP10_SQL,
    "op11_line_dedup": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
