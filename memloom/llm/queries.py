"""The registered queries of this subpackage: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.automaton import encode_documents
from memloom.llm.chat import rotate
from memloom.llm.common import scratch, stored, table
from memloom.llm.decontam import ANCHORS, SLOP, contaminated, contamination
from memloom.llm.filter_audit import FILTERS, LEAST_WORDS, ORDERS, audit
from memloom.llm.mixing import SCHEDULES, _segments, mix
from memloom.llm.pfor import read_token_files, write_token_files
from memloom.llm.runs import digests, periodic_runs
from memloom.llm.secrets import find_secrets
from memloom.llm.simhash import simhash_components
from memloom.llm.token_ledger import Ledger, count_tokens
from memloom.llm.toxicity import toxicity
from memloom.llm.url_templates import ACCEPT, DEPTH, MIN_SHARE, PRIOR_N, VALUE, Z, judge
from memloom.llm.webp import text_media

#: The id that ends every document in token files.
END_ID = 2

#: The contract's rules on hosts and paths.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_media(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("masks", spans)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come in; those labelled of low quality go; those not in English move to a
    tokenizer for many languages. The last batch is committed twice, which changes nothing."""
    counts = stored(count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "not (lang <=> 'en')"), "counts")
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("low", F.lit(True))
    old = {"old_tokenizer": F.lit(None).cast("string"), "old_tokens": F.lit(None).cast("long")}
    first = counts.withColumn("tokenizer", F.lit("byte_bpe_50k"))
    marked = first.join(low, "doc_id", "left")
    moved = marked.where("low is null and other_tokens is not null").withColumns({"old_tokenizer": F.col("tokenizer"), "old_tokens": F.col("tokens"), "tokenizer": F.lit("byte_bpe_multi_50k"), "tokens": F.col("other_tokens")})
    ledger = Ledger(spark, scratch(spark, "ledger"))
    ledger.commit("batch1", first.withColumns({"op": F.lit("insert"), **old}))
    ledger.commit("batch2", marked.where("low").withColumns({"op": F.lit("delete"), **old}))
    for _ in range(2):
        ledger.commit("batch3", moved.withColumn("op", F.lit("revise")))
    return ledger.totals()


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "n_near")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=True))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_templates": op1_url_templates,
    "op2_webp": op2_webp,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_chat_rotation": op5_chat_rotation,
    "op6_token_rollup": op6_token_rollup,
    "op7_secrets": op7_secrets,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bpe_automaton": op13_bpe_automaton,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _position_sql() -> str:
    """The inverse of each schedule's demand at y, by place in the cycle."""
    cases = []
    for place, knots in enumerate(SCHEDULES):
        for t0, length, w, slope, done in reversed(_segments(knots)):
            need = f"(y - {done!r}::double)"
            t = f"{need} / {w!r}::double" if slope == 0 else f"{need} * 2.0::double / ({w!r}::double + sqrt(greatest(0.0::double, {w * w!r}::double + {2 * slope!r}::double * {need})))"
            cases.append(f"when place = {place} and (y >= {done!r}::double or {t0!r} = 0.0) then {t0!r}::double + least(greatest({t}, 0.0::double), {length!r}::double)")
    return "case " + " ".join(cases) + " end"


def _templates_sql() -> str:
    """op1 level by level, as `url_templates` documents it."""
    fits = [f"when (host = '{d}' or host like '%.{d}') and starts_with(path, '/{p}') then '{{}}'" for r, _ in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])) for d, _, p in [r.partition("/")]]
    ruled = sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0]))
    rule, verdict = (" ".join(f.format(r[k]) for f, r in zip(fits, ruled, strict=True)) for k in (0, 1))
    steps = [f"""
cut as (select *, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosted as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
ruled as (select *, case {rule} end as rule, case {verdict} end as ruled from hosted),
p0 as (select host, path, list_filter(string_split(path, '/'), lambda x: x <> '') as segs, count(*) as n, count(*) filter (where ruled = 'allow') as good, count(*) filter (where ruled = 'block') as bad, '/' as node from ruled group by host, path)"""]
    for k in range(DEPTH + 1):
        segment = f"segs[{k + 1}]" if k < DEPTH else f"case when len(segs) > {DEPTH} then '**' end"
        order = "partition by host, node, rate is null order by rate, segment"
        steps.append(f"""
h{k} as (select *, {segment} as segment from p{k}),
c{k} as (select host, node, segment, sum(n) as n, sum(good) as good, sum(bad) as bad, sum(sum(n)) over (partition by host, node) as all_n from h{k} where segment is not null group by host, node, segment),
s{k} as (select *, case when regexp_matches(segment, '{VALUE}') then '*' || regexp_extract(segment, '(\\.[A-Za-z0-9]{{1,5}})?$') end as shape from c{k}),
r{k} as (select host, node, segment, good, good + bad as labelled, case when good + bad > 0 then good::double / (good + bad) end as rate from s{k} where shape is null and not (n < {MIN_SHARE} * all_n and segment <> '**')),
g{k} as (select *, lag(labelled) over ({order}) as bn, lag(good) over ({order}) as bg from r{k}),
a{k} as (select *, coalesce(rate - bg::double / bn > {Z} * sqrt((good + bg)::double / (labelled + bn) * (1 - (good + bg)::double / (labelled + bn)) * (1::double / labelled + 1::double / bn)), false) as apart from g{k}),
u{k} as (select *, sum(apart::int) over ({order}) as grp from a{k}),
m{k} as (select host, node, rate is null as blank, grp, string_agg(segment, '|' order by segment) as names from u{k} group by all),
b{k} as (select host, node, segment, case when contains(names, '|') then '{{' || names || '}}' else segment end as branch from u{k} join m{k} using (host, node, grp) where (rate is null) = blank
    union all select host, node, segment, coalesce(shape, '*') from s{k} where shape is not null or (n < {MIN_SHARE} * all_n and segment <> '**')),
p{k + 1} as (select h.host, h.path, h.segs, h.n, h.good, h.bad, case when branch is null then h.node else h.node || case when h.node = '/' then '' else '/' end || branch end as node from h{k} h left join b{k} b on h.host = b.host and h.node = b.node and h.segment = b.segment)""")
    return "with" + ",".join(steps) + f""",
t as (select host, node as template, sum(good) as good, sum(bad) as bad from p{DEPTH + 1} group by all),
o as (select coalesce(sum(good), 0) + {PRIOR_N} as g, coalesce(sum(bad), 0) as b from t),
hp as (select host, (sum(good) + {PRIOR_N} * (g / (g + b))) / (sum(good) + sum(bad) + {PRIOR_N}) as prior from t, o group by host, g, b),
j as (select host, template, good + bad as labelled, ((good + {PRIOR_N} * prior) / (good + bad + {PRIOR_N}))::double as purity from t join hp using (host))
select page_id, ruled.host, ruled.path, rule, coalesce(ruled, case when labelled > 0 and purity < {ACCEPT} then 'block' else 'allow' end) as verdict, template, purity
from ruled join p{DEPTH + 1} p on ruled.host = p.host and ruled.path = p.path join j on p.host = j.host and p.node = j.template"""


def _audit_sql() -> str:
    """op11 order by order over the documents' flags, not by masks."""
    before = " or ".join(f"(contains(substr(filter_order, 1, s - 1), '{x}') and f{x})" for x in FILTERS)
    own = "case substr(filter_order, s, 1) " + " ".join(f"when '{x}' then f{x}" for x in FILTERS) + " end"
    return rf"""
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
counted as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from docs),
flags as (select doc_id, part, len(w) < {LEAST_WORDS} as fA, 100 * len(list_distinct(w)) < 50 * len(w) as fB,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as fC, regexp_matches(text, '[#$%&*|]') as fD, coalesce(doc_id > least, false) as fE from counted),
marks as (select doc_id as labelled, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
facts as (select flags.*, coalesce(good, false) as good, coalesce(toxic, false) as toxic, fA::int + fB::int + fC::int + fD::int + fE::int as fails from flags left join marks on doc_id = labelled),
orders as (select unnest({ORDERS!r}) as filter_order),
steps as (select filter_order, unnest(range(1, 6)) as s from orders),
applied as (select part, filter_order, s, good, toxic, fails, ({before}) as gone, {own} as own from facts, steps),
out as (select part, filter_order, s as step, count(*) filter (where not gone and not own) as kept, count(*) filter (where own and not gone) as removed, count(*) filter (where own and gone) as redundant,
    count(*) filter (where own and fails = 1) as unique_fails, count(*) filter (where own and not gone and good) as good_lost, count(*) filter (where own and not gone and toxic) as toxic_lost
    from applied group by all)
select *, sum(removed) over (partition by part, substr(filter_order, step::bigint, 1))::bigint as shapley from out"""


#: DuckDB SQL for the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "op1_url_templates": _templates_sql(),
    "op5_chat_rotation": """
with rows_ as (select distinct conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null),
said as (select *, (row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) - 1) // 256 as part from rows_),
speakers as (select distinct conv_id, role as perspective from said where role <> 'system'),
views as (select said.*, perspective, coalesce(role = perspective, false) as own,
    case when role is null then '<|user|>' when role = perspective then '<|assistant|>' when role = 'system' then '<|system|>' else '<|user name=' || role || '|>' end || chr(10) as opening,
    text || '<|end|>' || chr(10) as body from said join speakers using (conv_id)),
ends as (select *, sum(length(opening) + length(body)) over (partition by conv_id, perspective order by turn nulls first, role nulls first, text rows unbounded preceding) as till,
    row_number() over (partition by conv_id, perspective order by turn nulls first, role nulls first, text) as k from views)
select conv_id, part, perspective, count(*) as n_turns, string_agg(opening || body, '' order by k) as rendered,
    coalesce(string_agg((till - length(body))::bigint || ':' || till::bigint, ',' order by k) filter (where own), '') as masks
from ends group by conv_id, part, perspective""",
    "op9_decontamination": rf"""
with docs as (select row_number() over () as u, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ITEM_WORD}'), []) as w from documents),
items as (select item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ITEM_WORD}'), []) as w from benchmark),
cuts as (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from items where len(w) > 0),
wins as (select distinct item_id, k, array_to_string(w[s : s + k - 1], ' ') as phrase from cuts),
sizes as (select distinct k from wins),
starts as (select u, w, k, unnest(range(1, len(w) - k + 2)) as s from docs, sizes where len(w) >= k),
hits as (select u, s, k, item_id from (select u, s, k, array_to_string(w[s : s + k - 1], ' ') as phrase from starts) join wins using (k, phrase)),
marked as (select u, count(distinct p) as n_hit from (select u, unnest(range(s, s + k)) as p from hits) group by u),
counted as (select term, count(*) as n from (select unnest(w) as term from docs) group by term),
phrases as (select distinct phrase, string_split(phrase, ' ') as w from wins),
ranked as (select phrase, w, term, row_number() over (partition by phrase order by coalesce(n, 0), term) as rank from (select *, unnest(list_distinct(w)) as term from phrases) left join counted using (term)),
pairs as (select phrase, len(w) as k, o, w[o + 1] as first, w[o + 2] as second, min(rank) as rank from (select *, least(list_position(w, term) - 1, greatest(len(w) - 2, 0)) as o from ranked where rank <= {ANCHORS}) group by all),
places as (select u, len(w) as n_words, i, w[i] as first, w[i + 1] as second from (select *, unnest(range(1, len(w))) as i from docs)),
lists as (select u, phrase, rank, i - 1 - o as start from places join (select *, count(*) over (partition by phrase) as pairs_of from pairs) using (first, second) where pairs_of > 1 and i - 1 - o >= 0 and i - 1 - o + k <= n_words),
near as (select u, count(distinct (phrase, start)) as n_near from (select a.u, a.phrase, a.start from lists a join lists b on a.u = b.u and a.phrase = b.phrase and a.rank = 1 and b.rank > 1 and abs(a.start - b.start) <= {SLOP}) group by u),
owned as (select u, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct u, cast(item_id as varchar) as id from hits) group by u)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0) as n_near
from docs left join marked using (u) left join owned using (u) left join near using (u)""",
    "op11_filter_audit": _audit_sql(),
    "op10_mixing": rf"""
with docs as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(concat(coalesce(doc_id::varchar, ''), '|', coalesce(text, ''))) as key from documents),
totals as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from totals),
weighed as (select *, rank % 3 as place, rank % 3 + 1 as w from ranked),
shared as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / w, rank rows between unbounded preceding and 1 preceding), 0))::double
    / sum(w) over (order by source_size / w, rank rows between current row and unbounded following) as share from weighed),
settled as (select *, (select arg_min(share, (source_size / w, rank)) from shared where source_size * 3 >= share * w) as level from shared),
facts as (select source, place, source_size, least(level * w, (source_size * 3)::double) as target from settled),
parts as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as full_rounds from facts),
runs as (select d.doc_id, d.source, d.size, d.key, p.place, p.source_size, p.target, p.full_rounds, p.target - p.full_rounds * p.source_size as rest,
    sum(d.size) over (partition by d.source order by d.key)::bigint as till, sum(d.size) over (partition by d.source, d.key)::bigint as own
    from docs d join parts p on d.source is not distinct from p.source),
chosen as (select *, (2 * till - own)::double <= rest * 2 as extra from runs),
counted as (select *, coalesce(max(case when extra then till end) over (partition by source), 0) as extra_words,
    full_rounds + case when extra and full_rounds < 3 then 1 else 0 end as copies from chosen),
shares as (select *, (till - own + size / 2) / (source_size * full_rounds + extra_words)::double as y, copies * size as taken from counted)
select doc_id, size, source_size, target, taken, case when taken > 0 then {_position_sql()} end as position from shares""",
}
