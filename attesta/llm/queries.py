"""The registered queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.llm.fingerprints import compare_with_next
from attesta.llm.licenses import TEMPLATES, bigrams, scan_licenses, text_words
from attesta.llm.masked_lm import pseudo_likelihood
from attesta.llm.mixing import mix_rows
from attesta.llm.ngram_jaccard import jaccard_classes
from attesta.llm.nn_descent import near_duplicates
from attesta.llm.packing import pack
from attesta.llm.quality_fm import quality
from attesta.llm.rans import token_files
from attesta.llm.secret_ledger import BASE_KINDS, BlobLedger, span_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors, cosine 0.9 or more."""
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of all documents under a network trained on them."""
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, each distinct text scanned once with a new ledger."""
    found = BlobLedger(spark).scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "blob")


def op4_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_next(_table(spark, sf_dir, "documents"))


def source_domain() -> Column:
    """Domains of the synthetic sources: src0 to src9 web, to src14 books, to src19 code."""
    number = F.regexp_extract("source", "^src([0-9]{1,3})$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n < 10, "web").when(n < 15, "books").when(n < 20, "code").otherwise("other")


#: Target weights by path; 1 where none is given.
MIX_WEIGHTS = {("web",): 5, ("books",): 3, ("code",): 2, ("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 2, ("books", "en"): 2, ("web", "en", "src0"): 4}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17


def op5_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, 60 per cent of all tokens, at most two epochs of any source."""
    return mix_rows(_table(spark, sf_dir, "documents"), source_domain(), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def _mix_sql() -> str:
    """The same in SQL: one window over each leaf instead of buckets."""

    def level(name: str, keys: list[str], parents: list[str], given: str) -> str:
        by = f"partition by {', '.join(parents)}" if parents else ""
        weight = "case " + " ".join(f"when {' and '.join(f"{k} = '{v}'" for k, v in zip(keys, path))} then {w}" for path, w in MIX_WEIGHTS.items() if len(path) == len(keys)) + " else 1 end"
        if len(keys) == 3:
            weight = "case when domain = 'web' and lang = 'en' and source = 'src0' then 4 else 1 end"
        order = f"({by} order by capacity / weight, {keys[-1]}"
        return f"""
  {name}0 as (select {', '.join(keys)}, cast(sum(available) * {MIX_EPOCHS} as bigint) as capacity, cast(sum(available) as bigint) as available, {weight} as weight from leaves group by {', '.join(keys)}),
  {name}1 as (select n.*, {given} as given from {name}0 n {f"join {parents and 'l' + str(len(parents))} p using ({', '.join(parents)})" if parents else ''}),
  {name}2 as (select *, sum(capacity) over {order} rows between unbounded preceding and current row) - capacity as before, sum(weight) over {order} rows between current row and unbounded following) as rest from {name}1),
  {name}3 as (select *, (given - before) * weight >= capacity * rest as full_ from {name}2),
  {name}4 as (select *, given - sum(case when full_ then capacity else 0 end) over ({by}) as spare, sum(case when full_ then 0 else weight end) over ({by}) as open from {name}3),
  {name}5 as (select *, case when full_ then capacity else spare * weight // open end as part from {name}4),
  {name}6 as (select *, given - sum(part) over ({by}) as left_, sum(case when full_ then 0 else 1 end) over ({by} order by {keys[-1]} rows between unbounded preceding and current row) as rank_ from {name}5),
  l{len(keys)} as (select {', '.join(keys)}, cast(part + case when not full_ and rank_ <= left_ then 1 else 0 end as bigint) as allotted from {name}6),"""

    keys = ["domain", "lang", "source"]
    number = "try_cast(regexp_extract(source, '^src([0-9]{1,3})$', 1) as int)"
    order = "order by key, doc_id rows between unbounded preceding and current row"
    return f"""
with rows_ as (select doc_id, case when {number} < 10 then 'web' when {number} < 15 then 'books' when {number} < 20 then 'code' else 'other' end as domain,
    coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens, md5(coalesce(text, '')) as digest from documents),
  live as (select * from rows_ where n_tokens > 0),
  leaves as (select domain, lang, source, sum(n_tokens) as available from live group by all),
  {level('a', keys[:1], [], f'least(sum(available) over () * {MIX_PERCENT} // 100, sum(capacity) over ())')}
  {level('b', keys[:2], keys[:1], 'p.allotted')}
  {level('c', keys, keys[:2], 'p.allotted')}
  leaf as (select domain, lang, source, cast(l3.allotted // available as bigint) as epochs, cast(l3.allotted % available as bigint) as rest from leaves join l3 using (domain, lang, source)),
  keyed as (select live.*, epochs, rest, md5('{MIX_SEED}|' || epochs || '|' || coalesce(cast(doc_id as varchar), 'null') || '|' || digest) as key from live join leaf using (domain, lang, source)),
  summed as (select *, sum(n_tokens) over (partition by domain, lang, source {order}) - n_tokens as before from keyed),
  picked as (select *, unnest(range(0, epochs + 1)) as epoch from summed)
select doc_id, domain, lang, source, cast(epoch as bigint) as epoch, n_tokens, cast(case when epoch < epochs then n_tokens else least(n_tokens, rest - before) end as bigint) as taken
from picked where epoch < epochs or before < rest"""


def op6_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one token stream in windows of 4096."""
    pieces = pack(_table(spark, sf_dir, "documents"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to rANS token files in order of id and read back."""
    read = token_files(_table(spark, sf_dir, "documents"), end_id=1)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents, Dice 0.8 or more over word bigrams; ``hits`` lists all as licence:start:shared:size."""
    found = scan_licenses(_table(spark, sf_dir, "documents"), TEMPLATES, "0.8")
    return found.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["start"], h["shared"], h["size"])), ","))


def _license_sql() -> str:
    """The same over all windows of the texts that have enough of a template's bigrams anywhere."""
    rows = ", ".join(f"('{name}', {len(text_words(text))}, [{', '.join(f"'{g}'" for g in bigrams(text))}])" for name, text in TEMPLATES.items())
    return f"""
with templates(license, w, grams) as (values {rows}),
  own as (select license, len(grams) as of_, unnest(grams) as g from templates),
  whole as (select row_number() over () as row_id, doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as words from documents),
  grams as (select row_id, i, words[i + 1] || ' ' || words[i + 2] as g from (select row_id, words, unnest(range(0, len(words) - 1)) as i from whole)),
  pairs as (select row_id, license from grams join own using (g) group by row_id, license, of_ having 3 * count(distinct g) >= 2 * of_),
  starts as (select row_id, license, w, len(grams) as b, least(w, len(words)) as l, unnest(range(0, len(words) - least(w, len(words)) + 1)) as s from pairs join templates using (license) join whole using (row_id)),
  scores as (select row_id, s.license, w, s, count(distinct g.g) + any_value(b) as size, count(distinct o.g) as shared
    from starts s join grams g using (row_id) left join own o on o.license = s.license and o.g = g.g where g.i >= s.s and g.i <= s.s + l - 2 group by all),
  reach as (select *, 2.0 * shared / size as dice from scores where 10 * shared >= 4 * size),
  heads as (select *, case when s - lag(s) over (partition by row_id, license order by s) < w then 0 else 1 end as head from reach),
  runs as (select *, sum(head) over (partition by row_id, license order by s rows between unbounded preceding and current row) as run from heads),
  places as (select *, row_number() over (partition by row_id, license, run order by dice desc, s) as place from runs),
  hits as (select row_id, count(*) as n, arg_min(struct_pack(license := license, dice := dice, s := s), struct_pack(a := -dice, b := s, c := license)) as best,
    string_agg(license || ':' || s || ':' || shared || ':' || size, ',' order by s, license) as hits from places where place = 1 group by row_id)
select doc_id, cast(coalesce(n, 0) as bigint) as n_hits, best.license as license, cast(best.dice as double) as dice, cast(best.s as bigint) as start, coalesce(hits, '') as hits
from whole left join hits using (row_id)"""


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, trained on labels that are not held out."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), max_train=5000)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard 0.9 or more, all pairs, exact."""
    return jaccard_classes(_table(spark, sf_dir, "documents"), n=3, threshold="0.9")


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_masked_pseudo_likelihood": op2_masked_pseudo_likelihood,
    "op3_blob_ledger": op3_blob_ledger,
    "op4_content_defined_chunks": op4_content_defined_chunks,
    "op5_hierarchical_budget": op5_hierarchical_budget,
    "op6_concatenate_and_cut": op6_concatenate_and_cut,
    "op7_rans_token_files": op7_rans_token_files,
    "op8_license_dice": op8_license_dice,
    "op9_factorisation_machine": op9_factorisation_machine,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLE_SQL: dict[str, str] = {
    "op5_hierarchical_budget": _mix_sql(),
    "op8_license_dice": _license_sql(),
}
