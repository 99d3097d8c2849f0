"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.alignment import alignment_report
from tallybook.llm.curriculum import taken_words
from tallybook.llm.decontamination import contaminations
from tallybook.llm.exact import exact_duplicates
from tallybook.llm.importance import importance_ranks
from tallybook.llm.language_model import scored
from tallybook.llm.licenses import notices_found, oracle_sql
from tallybook.llm.minhash_forest import Forest, near_duplicates
from tallybook.llm.passages import repeated_passages
from tallybook.llm.quality import assessed
from tallybook.llm.simhash import fingerprint_report
from tallybook.llm.warc import normalised, read_back, written
from tallybook.llm.wrappers import main_texts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(_table(spark, folder, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents on four-word shingles."""
    return near_duplicates(_table(spark, folder, "documents"), Forest(size=4))


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain benchmark items, with the items."""
    return contaminations(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence, site rates and verdict of every document."""
    return assessed(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and the rows near those asked for."""
    return fingerprint_report(_table(spark, folder, "documents"))


def op6_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices among the lines of every document."""
    return notices_found(_table(spark, folder, "documents"))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability under the context-mixing model and the unigram base."""
    return scored(_table(spark, folder, "documents"))


def op8_mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document, read back from the training order."""
    return taken_words(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records read back from archives of all pages."""
    archives = normalised(written(_table(spark, folder, "pages")))
    return read_back(archives, payloads=False).drop("payload")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of passages of 50 words or more that another document keeps."""
    return repeated_passages(_table(spark, folder, "documents"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's words."""
    return importance_ranks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays of those with its text."""
    return exact_duplicates(_table(spark, folder, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens of every document."""
    return alignment_report(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_license_scans": op6_license_scans,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_mixing_to_weights": op8_mixing_to_weights,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

# All pairs that share a shingle. A component's id spreads along links until it is the least.
NEAR_DEDUP_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') as own
  from documents),
shingled as (
  select doc_id, unnest(case when len(own) = 0 then [] when len(own) < 4 then [own]
                        else list_transform(range(1, len(own) - 2),
                                            lambda i: own[i : i + 3]) end) as shingle
  from words),
sets as (select distinct doc_id, hash(shingle) as shingle from shingled),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from sets a join sets b using (shingle) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach as (
  select doc_id, doc_id as least from documents
  union
  select links.b, reach.least from reach join links on links.a = reach.doc_id
  where reach.least < links.b)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(least) as component_id from reach group by doc_id)
left join sizes using (doc_id)
"""

# Documents follow one another by Spark's xxhash64 of their ids, which is worked out here in numbers
# modulo 2**64. Sources fill up in the order of their caps per weight.
MIXING_SQL = r"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         (cast(doc_id as hugeint) + 18446744073709551616) % 18446744073709551616 as u
  from documents),
turned as (
  select *, cast(u * 14029467366897019727 % 18446744073709551616 as uhugeint) as x
  from (select * replace (cast(u as uhugeint) as u) from rows)),
keyed as (
  select *, xor(cast(2870177450012600311 as ubigint), cast(
           (x * 2147483648 % 18446744073709551616 + x // 8589934592)
           * 11400714785074694791 % 18446744073709551616 as ubigint)) as a
  from turned),
spread as (
  select *, cast(((cast(a as uhugeint) * 134217728 % 18446744073709551616 + a // 137438953472)
           * 11400714785074694791 + 9650029242287828579) % 18446744073709551616 as ubigint) as b
  from keyed),
first_mixed as (
  select *, cast(cast(xor(b, b >> 33) as uhugeint) * 14029467366897019727
           % 18446744073709551616 as ubigint) as c
  from spread),
mixed as (
  select *, cast(cast(xor(c, c >> 29) as uhugeint) * 1609587929392839161
           % 18446744073709551616 as ubigint) as d
  from first_mixed),
hashed as (
  select doc_id, source, size, xor(d, d >> 32) as h from mixed),
sizes as (select source, sum(size) as source_size from hashed group by source),
weighed as (
  select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight,
         row_number() over (order by source nulls last) as place,
         cast(source_size * 2 as double) as cap
  from sizes),
filling as (
  select * replace (cast(weight as double) as weight),
         sum(source_size) over () * cast(1.5 as double) as share,
         coalesce(sum(cap) over before, 0) as full_,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as open,
         row_number() over (order by cap / weight, place) as nth
  from weighed
  window before as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
levels as (
  select *, (share - full_) / cast(open as double) as level from filling),
targets as (
  select source, cast(source_size as bigint) as source_size,
         coalesce(least(cap, weight * (select arg_min(level, nth) from levels
                                       where level * weight <= cap)), cap) as target
  from levels),
streamed as (
  select h.*, t.source_size, t.target,
         sum(size) over (partition by h.source order by h.h % 4096,
             case when h.h >= 9223372036854775808 then cast(h.h as hugeint) - 18446744073709551616
                  else cast(h.h as hugeint) end, doc_id) - size as begins
  from hashed h join targets t on t.source is not distinct from h.source)
select doc_id, size, source_size, target, cast(
         greatest(0, least(size, cast(round(target) as bigint) - begins))
         + greatest(0, least(size, cast(round(target) as bigint) - begins - source_size))
         as bigint) as taken
from streamed
"""

# Records of equal payloads; base32 is read off the digest's bits, five at a time.
WARC_SQL = """
with payloads as (
  select page_id, url, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as digits
  from pages),
bits as (
  select digits, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111',
           4 * strpos('0123456789abcdef', substr(digits, i, 1)) - 3, 4), '' order by i) as own
  from (select distinct digits from payloads), range(1, 41) as r(i) group by digits),
digests as (
  select digits, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_reduce(list_transform(range(1, 6),
                 lambda k: cast(substr(own, 5 * g + k, 1) as int)), lambda x, y: 2 * x + y), 1),
           '' order by g) as payload_digest
  from bits, range(32) as r(g) group by digits)
select page_id, octet_length(payload) as payload_bytes, payload_digest,
       case when page_id = largest then 'response' else 'revisit' end as record_type,
       case when page_id <> largest then largest end as refers_to, coalesce(url, '') as url
from (select *, max(page_id) over (partition by digits) as largest from payloads)
join digests using (digits)
"""

# A word's CRC-32 is worked out byte by byte from the table of the reflected polynomial.
IMPORTANCE_SQL = r"""
with crc_table as (
  select list(list_reduce(range(8), lambda v, i: case when v & 1 = 1
                          then xor(v >> 1, 3988292384) else v >> 1 end, b) order by b) as entries
  from range(256) as r(b)),
own as (
  select 0 as target, doc_id, text from documents
  union all select 1, item_id, text from benchmark),
lists as (
  select target, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from own),
occurrences as (select target, doc_id, unnest(words) as word from lists),
spellings as (
  select word, hex(encode(word)) as digits from (select distinct word from occurrences)),
buckets as (
  select word, xor(list_reduce(
           list_transform(range(length(digits) // 2),
                          lambda i: cast('0x' || substr(digits, 2 * i + 1, 2) as bigint)),
           lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8),
           cast(4294967295 as bigint)), 4294967295) % 10000 as bucket
  from spellings, crc_table),
counts as (
  select b as bucket,
         count(*) filter (where target = 0) as s, count(*) filter (where target = 1) as t
  from range(10000) as r(b) left join (occurrences join buckets using (word)) on bucket = b
  group by b),
gains as (
  select bucket, cast(floor(1000 * ln(
           (cast(t as double) + 1) * (cast(sum(s) over () as double) + 10000)
           / ((cast(s as double) + 1) * (cast(sum(t) over () as double) + 10000)))) as bigint) as gain
  from counts),
weights as (
  select doc_id, cast(sum(gain) as bigint) as weight
  from occurrences join buckets using (word) join gains using (bucket)
  where target = 0 group by doc_id),
scored as (
  select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln(
           (cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5) / 4294967296)
         )) as bigint) as score
  from lists left join weights using (doc_id) where target = 0),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
         count(*) filter (where n_features >= 20) over () as n
  from scored)
select doc_id, n_features, weight, score,
       case when n_features >= 20 and place <= 10 * n // 100 then place end as rank
from placed
"""

EXACT_DEDUP_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR_DEDUP_SQL,
    "op8_mixing_to_weights": MIXING_SQL,
    "op9_warc": WARC_SQL,
    "op6_license_scans": oracle_sql(),
    "op11_importance_resampling": IMPORTANCE_SQL,
    "op12_exact_dedup": EXACT_DEDUP_SQL,
}
