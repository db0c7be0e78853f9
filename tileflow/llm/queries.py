"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.bpe import round_trip
from tileflow.llm.exact_dedup import ascii_lower, duplicate_groups
from tileflow.llm.filter_audit import audit_filters
from tileflow.llm.folders import prepare
from tileflow.llm.jaccard_join import linked_groups
from tileflow.llm.language_id import identify
from tileflow.llm.lm_scoring import score_texts
from tileflow.llm.merkle import fold, merkle_proofs, record_digest, siblings
from tileflow.llm.mixing import mix_sources
from tileflow.llm.packing import pack_documents
from tileflow.llm.substring_dedup import remove_repeats
from tileflow.llm.token_counts import piece_counts
from tileflow.llm.url_filter import Rule, judge_urls
from tileflow.llm.winnowing import edit_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return job(spark, sf_dir)

    QUERIES[job.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.col("text")), 256))
    groups = duplicate_groups(docs, keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op1_exact_dedup"] = f"""
with norm as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents),
g as (select t, max(doc_id) keep_id, count(*) group_size from norm group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id kept, sha256(n.t) text_sha256
from norm n join g on n.t = g.t"""


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(documents(spark, sf_dir))


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(documents(spark, sf_dir), size=4, percent=85)


SQL["op3_jaccard_join"] = f"""
with recursive words as (select doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end s from words),
sized as (select doc_id, len(s) n_shingles, s from sets),
items as (select doc_id, n_shingles, hash(unnest(s)) h from sized),
common as (select a.doc_id a, b.doc_id b, any_value(a.n_shingles) na, any_value(b.n_shingles) nb, count(*) n
    from items a join items b on a.h = b.h and a.doc_id < b.doc_id
      and 100 * least(a.n_shingles, b.n_shingles) >= 85 * greatest(a.n_shingles, b.n_shingles) group by 1, 2),
links as (select a, b from common where 100 * n >= 85 * (na + nb - n)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from sized
    union select r.doc_id, w.b from reach r join ways w on r.other = w.a)
select s.doc_id, s.n_shingles, (select min(other) from reach r where r.doc_id = s.doc_id) component_id from sized s"""


def tokenizer_file() -> str:
    """The public vocabulary file; the package that knows its place is installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file(), capacity=2048, close=1)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(documents(spark, sf_dir), tokenizer_file())
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", "n_tokens", *digests)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(documents(spark, sf_dir), tokenizer_file())


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=35)
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op7_substring_dedup"] = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
wins as (select doc_id, i, array_to_string(w[i:i + 34], ' ') s
  from (select doc_id, w, unnest(range(1, len(w) - 33)) i from words)),
twice as (select s from wins group by s having count(*) > 1),
hit as (select doc_id, i from wins semi join twice using (s)),
gone as (select distinct doc_id, i + j p from hit, range(35) r(j)),
placed as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from words),
kept as (select doc_id, count(*) n, string_agg(word, ' ' order by p) k from placed anti join gone using (doc_id, p)
  group by 1)
select w.doc_id, len(w.w) n_words, len(w.w) - coalesce(k.n, 0) n_removed, sha256(coalesce(k.k, '')) kept_sha256
from words w left join kept k using (doc_id)"""


def fold_of(n: int) -> Column:
    """The remainder that decides whether a document is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    named = identify(docs, training=fold_of(4) != 2)
    held_out = F.coalesce(fold_of(4) == 2, F.lit(False)).alias("held_out")
    return named.select("doc_id", held_out, "lang_pred", "score")


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(documents(spark, sf_dir), training=fold_of(7) != 2)
    return scored.withColumn("trained", F.expr("not trained")).withColumnRenamed("trained", "held_out")


URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _url_sql(order: int = 4, strength: float = 2.0, alphabet: int = 256) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))

    def case(field: str) -> str:
        tests = [
            f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') "
            f"then '{getattr(r, field)}'"
            for r in ordered
        ]
        return f"case {' '.join(tests)} end"

    levels = [f"p0 as (select gram, 1.0::double / {alphabet} pa, 1.0::double / {alphabet} pr from counts)"]
    for k in range(order):
        own, before = f"substr(gram, {order - k}, {k + 1})", f"substr(gram, {order - k}, {k})"
        levels += [
            f"n{k} as (select {own} own, sum(a) na, sum(r) nr from counts group by 1)",
            f"t{k} as (select {before} before, sum(a) ta, sum(r) tr from counts group by 1)",
            f"p{k + 1} as (select gram, (na + {strength} * pa) / (ta + {strength}) pa, "
            f"(nr + {strength} * pr) / (tr + {strength}) pr "
            f"from p{k} join n{k} on {own} = own join t{k} on {before} = before)",
        ]
    return f"""
with raw as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest
  from pages),
parts as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from raw),
ruled as (select *, {case('name')} rule, {case('verdict')} ruled, row_number() over () rid from parts),
padded as (select rid, ruled, repeat(chr(2), {order - 1}) || coalesce(url, '') || chr(3) p from ruled),
places as (select rid, ruled, substr(p, i, {order}) gram
  from (select rid, ruled, p, unnest(range(1, length(p) - {order - 2})) i from padded)),
counts as (select gram, count(*) filter (ruled = 'allow') a, count(*) filter (ruled = 'block') r from places group by 1),
{', '.join(levels)},
sums as (select rid, sum(ln(pa) - ln(pr)) s from places join p{order} using (gram) group by 1),
scored as (select r.*, round(s / (length(coalesce(url, '')) + 1), 9) score from ruled r join sums using (rid)),
middle as (select coalesce(round((avg(score) filter (ruled = 'allow') + avg(score) filter (ruled = 'block')) / 2, 9), 0) m
  from scored)
select page_id, host, path, rule, coalesce(ruled, case when score >= m then 'allow' else 'block' end) verdict
from scored, middle"""


SQL["op10_url_filter"] = _url_sql()


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", UPPER, LOWER)
    altered = F.when(fold_of(3) == 0, record_digest([*map(F.col, names[:-1]), lowered]))
    leaves = docs.select("doc_id", "lang", record_digest([*map(F.col, names)]).alias("leaf"), altered.alias("altered"))
    proofs = merkle_proofs(leaves)
    folded = fold(F.coalesce("altered", "leaf"), F.col("proof"))
    proofs = proofs.withColumn("proof_sha256", F.sha2(siblings(F.col("proof")), 256)).withColumn("folded_root", folded)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _merkle_sql(fanout: int = 8) -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        shown = [f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in fields]
        return f"sha256({' || '.join(shown)})"

    step = "xor(a >> 1, 3988292384 * (a & 1))"
    eight = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {step})"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), "
        f"lambda x: ord(x)::bigint)), lambda c, b: {eight}))"
    )
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    grow = (
        f"select part, level + 1, pos // {fanout}, sha256(string_agg(h, '' order by pos)), (max(n) + {fanout - 1}) // {fanout}"
    )
    return f"""
with recursive leaves as (select row_number() over () rid, doc_id, lang, {leaf('text')} leaf,
    case when {crc} % 3 = 0 then {leaf(lowered)} end altered from documents),
parts as (select lang, row_number() over (order by lang nulls first) - 1 part from (select distinct lang from leaves)),
placed as (select l.*, part, row_number() over (partition by part order by doc_id nulls first, leaf) - 1 pos
    from leaves l join parts p on l.lang is not distinct from p.lang),
tree(part, level, pos, h, n) as (select part, 0, pos, leaf, count(*) over (partition by part) from placed
    union all {grow} from tree where n > 1 group by part, level, pos // {fanout}),
subroots as (select part, h subroot from tree where n = 1),
top(part, level, pos, h, n) as (select 0, 0, part, subroot, count(*) over () from subroots
    union all {grow} from top where n > 1 group by part, level, pos // {fanout}),
runs as (select rid, t.level step, t.pos, h, t.pos = p.pos // ({fanout} ** t.level)::bigint own from placed p join tree t
      on p.part = t.part and n > 1 and t.pos // {fanout} = p.pos // ({fanout} ** (t.level + 1))::bigint
    union all select rid, 1000 + t.level, t.pos, h, t.pos = p.part // ({fanout} ** t.level)::bigint from placed p join top t
      on n > 1 and t.pos // {fanout} = p.part // ({fanout} ** (t.level + 1))::bigint),
steps as (select *, dense_rank() over (partition by rid order by step) k from runs),
proofs as (select rid, string_agg(h, '' order by k, pos) filter (not own) proof from steps group by rid),
folded(rid, k, h) as (select rid, 0, coalesce(altered, leaf) from placed
    union all select f.rid, f.k + 1, sha256(string_agg(case when own then f.h else s.h end, '' order by pos))
      from folded f join steps s on f.rid = s.rid and s.k = f.k + 1 group by f.rid, f.k),
last as (select rid, arg_max(h, k) h from folded group by rid)
select doc_id, leaf, subroot, t.h root, sha256(coalesce(proof, '')) proof_sha256, l.h folded_root, l.h = t.h verified
from placed p join subroots s on p.part = s.part join top t on t.n = 1 join last l on p.rid = l.rid
  left join proofs f on p.rid = f.rid"""


SQL["op11_merkle"] = _merkle_sql()


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op12_mixing"] = """
with recursive sized as (select row_number() over () rid, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size,
    md5(concat_ws(':', '0', coalesce(doc_id::varchar, '-'), md5(coalesce(text, '')))) place from documents),
sources as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 number
    from sized group by source),
weighted as (select *, [5, 2, 1][number % 3 + 1] weight, 2 * source_size cap from sources),
levels(i, level, still) as (select 0, sum(source_size) * 1.5 / sum(weight), sum(weight) from weighted
    union all select i + 1, l, w from (select i, ((select sum(source_size) * 1.5 from weighted)
        - coalesce(sum(cap) filter (cap < weight * level), 0)) / sum(weight) filter (cap >= weight * level) l,
        sum(weight) filter (cap >= weight * level) w, any_value(still) still from levels, weighted group by i)
      where w <> still),
targets as (select number, source, source_size, least(cap, weight * level)::double target
    from weighted, (select arg_max(level, i) level from levels)),
seats as (select number, q from (select number, target / (2 * k + 1) q,
      row_number() over (order by target / (2 * k + 1) desc, number) r
      from (select number, target, unnest(range(0, (target / 8)::bigint + 4)) k from targets))
    where r <= (select round_even(sum(target) / 16, 0) from targets)),
quotas as (select number, count(*) source_quota from seats group by number),
known as (select d.*, t.number, t.source_size, t.target, coalesce(source_quota, 0) source_quota,
    case when size > 0 then ('0x' || substr(place, 1, 8))::bigint % ceil(t.source_size / 4194304)::bigint end shard
    from sized d join targets t on d.source is not distinct from t.source left join quotas q on t.number = q.number),
cells as (select number, shard, sum(size)::bigint length, max(source_quota) source_quota,
    ceil(sum(size) / 16)::bigint blocks from known where size > 0 group by number, shard),
given as (select number, shard, count(*) quota from (select number, shard, source_quota,
      row_number() over (partition by number order by length::double / (2 * k + 1) desc, shard) r
      from (select *, unnest(range(0, source_quota)) k from cells)) where r <= source_quota group by number, shard),
shards as (select c.number, c.shard, blocks, least(coalesce(quota, 0), 2 * blocks) quota
    from cells c left join given g on c.number = g.number and c.shard = g.shard),
drawn as (select number, shard, b, row_number() over (partition by number, shard
      order by md5(concat_ws(':', '0', number, shard, b)), b) <= quota % blocks chosen
    from (select *, unnest(range(0, blocks)) b from shards)),
placed as (select k.*, quota // blocks passes, sum(size) over (partition by k.number, k.shard order by place, doc_id, size, rid)
      - size start from known k left join shards s on k.number = s.number and k.shard = s.shard),
more as (select rid, sum(least((b + 1) * 16, start + size) - greatest(b * 16, start))::bigint more
    from placed p join drawn d on p.number = d.number and p.shard = d.shard and chosen
      and b between start // 16 and (start + size - 1) // 16 where size > 0 group by rid)
select doc_id, size, source_size, target, (coalesce(passes, 0) * size + coalesce(more, 0))::bigint taken
from placed left join more using (rid)"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, text = F.col("words"), F.col("text")
    filters = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), filters, repeated="E")


SQL["op13_filter_audit"] = """
with words as (select row_number() over () rid, doc_id, coalesce(lang, '') part, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
judged as (select rid, part, doc_id in (select doc_id from labels where quality = 1) good,
    doc_id in (select doc_id from labels where toxic = 1) toxic,
    list_filter([case when len(w) < 200 then 'A' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' end,
      case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) then 'C' end,
      case when regexp_matches(t, '[#$%&*|]') then 'D' end,
      case when doc_id > min(doc_id) over (partition by t) then 'E' end], lambda x: x is not null) fails from words),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
orders as (select a.f || b.f || c.f || d.f || e.f o from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
failed as (select rid, part, good, toxic, f, fails from judged, letters where list_contains(fails, f)),
steps as (select o filter_order, s step, o[s] f, substr(o, 1, s - 1) earlier from orders, range(1, 6) r(s)),
hits as (select part, filter_order, step, f, good, toxic,
      len(list_filter(fails, lambda x: contains(earlier, x))) > 0 gone, len(fails) = 1 lone from failed join steps using (f)),
sums as (select part, filter_order, step, f, count(*) filter (not gone) removed, count(*) filter (gone) redundant,
    count(*) filter (lone) unique_fails, count(*) filter (not gone and good) good_lost,
    count(*) filter (not gone and toxic) toxic_lost from hits group by all),
parts as (select part, count(*) n from judged group by part),
report as (select part, n, filter_order, step, f, coalesce(removed, 0) removed, coalesce(redundant, 0) redundant,
    coalesce(unique_fails, 0) unique_fails, coalesce(good_lost, 0) good_lost, coalesce(toxic_lost, 0) toxic_lost
    from parts cross join steps left join sums using (part, filter_order, step, f))
select part, filter_order, step, n - sum(removed) over (partition by part, filter_order order by step) kept, removed,
  redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f) shapley from report"""
