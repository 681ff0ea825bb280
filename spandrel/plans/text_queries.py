"""Queries of retrieval, fusion and evaluation over files, entities, instances and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import text as T
from spandrel.operators import arms as A
from spandrel.operators import evaluate as E
from spandrel.operators import graph as G
from spandrel.operators import retrieval as R
from spandrel.session import Scratch
from spandrel.tables import table


def _queries(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "instances").groupBy("instance_id").agg(F.min("repo").alias("space"), F.min("problem_statement").alias("text"))
    return i.select("space", F.col("instance_id").alias("query"), "text")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return R.file_postings(table(spark, d, "files"))


def _short(spark: SparkSession, d: str) -> DataFrame:
    """The packages' names as short queries."""
    return table(spark, d, "upstream_files").select(F.col("package_name").alias("query"), F.regexp_replace("path", "^.*/|\\.\\w+$", "").alias("text")).distinct()


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """For each instance, the files of its repository that have the most telling words of it in their path."""
    files = table(spark, d, "files").select(F.col("repo").alias("space"), F.col("path").alias("doc")).distinct()
    words = _queries(spark, d).select("space", "query", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]+_[a-z]+)"), F.lit(1)))).alias("word"))
    return words.join(files, "space").filter(F.contains("doc", F.split("word", "_")[0])).select("query", "doc").distinct()


def t_tokens(spark: SparkSession, d: str) -> DataFrame:
    """term, n over all entity names."""
    e = G.nodes_of(table(spark, d, "entities"))
    return e.select(F.explode(T.tokens(F.replace("name", F.lit("."), F.lit(" ")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def t_document_words(spark: SparkSession, d: str) -> DataFrame:
    """source, words, distinct_words over all documents."""
    w = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))).alias("w"))
    return w.groupBy("source").agg(F.count("*").alias("words"), F.countDistinct("w").alias("distinct_words"))


def t_postings(spark: SparkSession, d: str) -> DataFrame:
    """space, docs, terms, tokens of the inverted index of all files."""
    return _posts(spark, d).groupBy("space").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))


def t_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(_posts(spark, d)).select("space", "n", F.round("avg_len", 6).alias("avg_len"))


def t_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequency(_posts(spark, d)).groupBy("term").agg(F.sum("df").alias("df"), F.count("*").alias("spaces"))


def t_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best files of its repository for each instance."""
    return R.bm25(_queries(spark, d), _posts(spark, d)).filter("rank <= 10").select("query", "doc", F.round("score", 6).alias("score"))


def t_rare_coactivation(spark: SparkSession, d: str) -> DataFrame:
    """query, doc, score, reached: rare terms boost, distinct telling terms raise."""
    got = R.coactivation(R.rare_boost(R.bm25_terms(_queries(spark, d), _posts(spark, d))))
    return got.select("query", "doc", F.round("score", 6).alias("score"), "reached", "terms")


def t_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of BM25 and the boosted ranking."""
    parts = Scratch(spark).keep(R.bm25_terms(_queries(spark, d), _posts(spark, d)))
    plain = G.ranked(parts.groupBy("space", "query", "doc").agg(F.round(F.sum("part"), 6).alias("score")), "score", "doc", by=("space", "query"))
    boosted = G.ranked(R.rare_boost(parts).withColumn("score", F.round("score", 6)), "score", "doc", by=("space", "query"))
    return R.fuse(plain, boosted).select("query", "doc", F.round("score", 9).alias("score"))


def t_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that each document names."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("query"), "text")
    return R.seeds(docs).select(F.col("query").alias("doc_id"), "symbol", "weight", "rank")


def t_seed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Instances' symbols by camel case and underscores alone."""
    q = _queries(spark, d)
    every = q.select("query", F.explode(F.array(*(F.struct(F.lit(k).alias("how"), R.all_of(F.col("text"), rx).alias("s")) for k, rx in (("camel", R.CAMEL), ("snake", R.SNAKE))))).alias("o"))
    return every.select("query", F.explode(F.array_distinct("o.s")).alias("symbol"), "o.how")


def t_name_scores(spark: SparkSession, d: str) -> DataFrame:
    """All entities scored for short queries, likeness left out."""
    return R.name_scores(G.nodes_of(table(spark, d, "entities")), _short(spark, d), fuzzy=False)


def t_search(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best entities for short queries by name, likeness and full text."""
    return R.search(G.nodes_of(table(spark, d, "entities")), _short(spark, d))


def t_map_arm(spark: SparkSession, d: str) -> DataFrame:
    """Files by entities that the instances name and the graph leads to."""
    return R.file_scores(R.map_arm(table(spark, d, "entities"), table(spark, d, "edges"), _queries(spark, d)))


def t_spread(spark: SparkSession, d: str) -> DataFrame:
    """Entities by activation that spreads along the graph from the terms of the instances."""
    nodes = G.nodes_of(table(spark, d, "entities"))
    terms = R.entity_terms(nodes, F.split("path", "/")[0])
    return R.coactivation(R.spread(R.rare_boost(R.bm25_terms(_queries(spark, d), terms)), G.links_of(table(spark, d, "edges"))))


def t_control(spark: SparkSession, d: str) -> DataFrame:
    """The order without information of each instance's files."""
    docs = table(spark, d, "files").select(F.col("repo").alias("space"), F.col("path").alias("doc")).distinct().filter(~T.is_test_path(F.col("doc")))
    return R.control(_queries(spark, d).select("space", "query"), docs).select("query", "doc", "rank")


def t_scores(spark: SparkSession, d: str) -> DataFrame:
    """recall@k, mrr and the like of BM25 for each instance."""
    got = E.score_rankings(R.bm25(_queries(spark, d), _posts(spark, d)).withColumn("rank", F.col("rank")), _truth(spark, d), (1, 5, 10))
    return got.select([F.round(F.col(f"`{c}`"), 6).alias(c.replace("@", "_at_")) if t == "double" else F.col(f"`{c}`") for c, t in got.dtypes])


def t_macro(spark: SparkSession, d: str) -> DataFrame:
    """Averages by repository."""
    got = E.score_rankings(R.bm25(_queries(spark, d), _posts(spark, d)), _truth(spark, d), (10,)).join(_queries(spark, d).select("query", F.col("space").alias("repo")), "query")
    return got.groupBy("repo").agg(F.count("*").alias("instances"), F.round(F.avg("`recall@10`"), 6).alias("recall_at_10"), F.round(F.avg("mrr"), 6).alias("mrr"))


def t_ceiling(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "files").select(F.col("path").alias("doc")).filter(~T.is_test_path(F.col("path")))
    return E.ceiling(docs, _truth(spark, d))


def t_interval(spark: SparkSession, d: str) -> DataFrame:
    """How far BM25 leads the control in reciprocal rank."""
    truth = _truth(spark, d)
    docs = table(spark, d, "files").select(F.col("repo").alias("space"), F.col("path").alias("doc")).distinct()
    a = E.score_rankings(R.bm25(_queries(spark, d), _posts(spark, d)), truth, (1,)).select(F.lit("bm25").alias("arm"), "query", F.col("mrr").alias("value"))
    b = E.score_rankings(R.control(_queries(spark, d).select("space", "query"), docs), truth, (1,)).select(F.lit("control").alias("arm"), "query", F.col("mrr").alias("value"))
    return E.paired_interval(a.unionByName(b), "bm25", "control", "mrr")


def t_lead(spark: SparkSession, d: str) -> DataFrame:
    """metric, n, difference: by how much BM25 leads the control, over how many instances."""
    return t_interval(spark, d).select("metric", "n", "difference")


def t_arms(spark: SparkSession, d: str) -> DataFrame:
    """Averages of all six arms over the instances."""
    c = A.Corpus(table(spark, d, "files"), table(spark, d, "entities"), table(spark, d, "edges"), _queries(spark, d))
    got = E.macro(A.run(c, _truth(spark, d), ks=(1, 5, 10)).drop("query"), "arm")
    return got.select([F.col(f"`{x}`").alias(x.replace("@", "_at_")) for x in got.columns])


def t_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Sixty instances, taken from the repositories in turn."""
    return E.stratified(table(spark, d, "instances").select("instance_id", "repo").distinct(), "repo", "instance_id", 60)


def t_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median and total of values by event type."""
    e = table(spark, d, "events")
    got = E.medians(e, "event_type", "value")
    return got.select("event_type", F.round("median", 6).alias("median"), F.round("total", 2).alias("total"))


def t_path_references(spark: SparkSession, d: str) -> DataFrame:
    """path, target, normal: what the src and href attributes of HTML files refer to."""
    f = table(spark, d, "files").filter(F.col("path").endswith(".html") & F.col("content").isNotNull()).select("path", "content").distinct()
    refs = f.select("path", F.explode(F.regexp_extract_all("content", F.lit('(?:src|href)="([^"]*)"'), F.lit(1))).alias("ref")).distinct()
    got = refs.withColumn("target", T.path_reference(F.col("ref")))
    return got.select("path", F.substring("ref", 1, 40).alias("ref"), "target", T.normal_path(F.col("target"), F.col("path")).alias("normal"))


def t_module_paths(spark: SparkSession, d: str) -> DataFrame:
    """path, module, file: what the imports of Python files stand for."""
    f = table(spark, d, "files").filter(F.col("path").endswith(".py") & F.col("content").isNotNull()).select("path", "content").distinct()
    got = f.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^from ([\w.]+) import"), F.lit(1))).alias("module")).distinct()
    return got.select("path", "module", T.module_path(F.col("module"), F.col("path"), F.lit(".py")).alias("file"))


def _all(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all({text}, '{quoted}', 1)"


def _seeds_sql() -> str:
    """Offers of every way of naming, in the order of ``R.WEIGHTS``."""
    inside = lambda rx: f"flatten(list_transform(blocks, lambda b: {_all('b', rx)}))"
    last = lambda a: f"list_transform({a}, lambda s: string_split(s, '.')[-1])"
    named = f"flatten(list_transform({_all('text', R.BACKTICKS)}, lambda b: case when len({_all('b', R.DOTTED)}) > 0 then {_all('b', R.DOTTED)} else {_all('b', R.NAME)} end))"
    ways = {
        "traceback": _all("text", R.TRACEBACK), "backticks": named, "defined": _all("text", R.DEFINED), "called in code": inside(R.CALLED), "dotted in code": inside(R.DOTTED), "end of dotted in code": last(inside(R.DOTTED)),
        "called": _all("text", R.CALLED), "dotted": _all("text", R.DOTTED), "end of dotted": last(_all("text", R.DOTTED)), "camel": _all("text", R.CAMEL), "snake": _all("text", R.SNAKE),
    }
    offers = ", ".join(f"list_transform({a}, lambda s: struct_pack(s := s, w := {R.WEIGHTS[k]}::double))" for k, a in ways.items())
    stop = ", ".join(f"'{x}'" for x in R.STOP_SYMBOLS)
    lines = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    return f"""with t as (select doc_id, text, list_concat({_all('text', R.FENCED)}, {_all(lines, R.INDENTED)}) as blocks from documents where text is not null),
o as (select doc_id, unnest(flatten([{offers}])) as o from t), b as (select doc_id, regexp_replace(trim(o.s), '^[().,:''"]+|[().,:''"]+$', '', 'g') as symbol, o.w as w from o),
g as (select doc_id, symbol, max(w) as weight from b where len(symbol) >= 3 and lower(symbol) not in ({stop}) group by 1, 2)
select * from (select doc_id, symbol, weight, row_number() over (partition by doc_id order by weight desc, symbol)::int as rank from g) where rank <= {R.SEEDS}"""


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("t_")}

_TOK = """flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: list_concat([lower(w)],
  list_concat(case when len(list_filter(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z]|[0-9])', '\\1 \\2', 'g'), '[A-Z]+[a-z0-9]*|[a-z0-9]+'), lambda p: len(p) > 1)) > 1
    then list_transform(list_filter(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z]|[0-9])', '\\1 \\2', 'g'), '[A-Z]+[a-z0-9]*|[a-z0-9]+'), lambda p: len(p) > 1), lambda p: lower(p)) else [] end,
  case when len(list_filter(string_split(lower(w), '_'), lambda p: len(p) > 1)) > 1 then list_filter(string_split(lower(w), '_'), lambda p: len(p) > 1) else [] end))))"""
_TEST = "list_has_any(string_split({0}, '/')[1:len(string_split({0}, '/')) - 1], ['tests', 'test', 'testing']) or starts_with(string_split({0}, '/')[-1], 'test_') or ends_with({0}, '_test.py') or string_split({0}, '/')[-1] = 'conftest.py'"
_Q = "q as (select instance_id as query, min(repo) as space, min(problem_statement) as text from instances group by 1)"
_FILES = f"""f as (select repo as space, path as doc, min(content) as content from files where content is not null and path is not null and not ({_TEST.format('path')}) group by 1, 2),
posts as (select space, doc, term, count(*) as tf from (select space, doc, unnest(list_concat(list_concat(list_concat(pt, pt), pt), ct)) as term from (select space, doc, {_TOK.format("regexp_replace(replace(doc, '/', ' '), '\\.[A-Za-z0-9_]+$', '')")} as pt, {_TOK.format('content')} as ct from f)) group by 1, 2, 3)"""
_STATS = "len_ as (select space, doc, sum(tf) as len from posts group by 1, 2), st as (select space, count(*) as n, avg(len) as avg_len from len_ group by 1), dfs as (select space, term, count(*) as df from posts group by 1, 2)"
_PARTS = f"""{_FILES}, {_STATS}, {_Q}, a as (select distinct space, query, term from (select space, query, unnest({_TOK.format('text')}) as term from q) where len(term) >= 3),
parts as (select a.space, a.query, p.doc, a.term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as weight, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) as part
  from a join posts p on p.space = a.space and p.term = a.term join dfs on dfs.space = a.space and dfs.term = a.term join len_ l on l.space = p.space and l.doc = p.doc join st on st.space = a.space)"""
_BM25 = f"{_PARTS}, b as (select *, row_number() over (partition by space, query order by score desc, doc) as rank from (select space, query, doc, sum(part) as score from parts group by 1, 2, 3))"
_BOOST = """bits as (select space, query, term, 1::bigint << (rank - 1)::int as bit from (select *, row_number() over (partition by space, query order by weight desc, term) as rank from (select distinct space, query, term, weight from parts)) where rank <= 32),
boost as (select parts.space, parts.query, doc, sum(part) * (1 + 2.0 * count(*) filter (df <= 3)) as score, bit_count(bit_or(coalesce(bit, 0))) as reached, count(*) as terms from parts left join bits on bits.space = parts.space and bits.query = parts.query and bits.term = parts.term group by 1, 2, 3)"""
_TRUTH = f"""words as (select distinct space, query, unnest(regexp_extract_all(text, '[a-z]+_[a-z]+')) as word from q), truth as (select distinct query, path as doc from words join files on files.repo = words.space where contains(path, string_split(word, '_')[1]))"""
_OWN = "n as (select path, name, min(kind) as kind, min(meta) as meta from entities where removed_at is null and path is not null and name is not null group by 1, 2)"

ORACLE = {
    "t_tokens": f"with {_OWN} select term, count(*) as n from (select unnest({_TOK.format(chr(39).join(['replace(name, ', '.', ', ', ' ', ')']))}) as term from n) group by 1",
    "t_document_words": "select source, count(*) as words, count(distinct w) as distinct_words from (select source, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) as w from documents) group by 1",
    "t_postings": f"with {_FILES} select space, count(distinct doc) as docs, count(distinct term) as terms, sum(tf)::bigint as tokens from posts group by 1",
    "t_corpus_stats": f"with {_FILES}, {_STATS} select space, n, round(avg_len, 6) as avg_len from st",
    "t_document_frequency": f"with {_FILES}, {_STATS} select term, sum(df)::bigint as df, count(*) as spaces from dfs group by 1",
    "t_bm25": f"with {_BM25} select query, doc, round(score, 6) as score from b where rank <= 10",
    "t_rare_coactivation": f"with {_PARTS}, {_BOOST} select query, doc, round(score * (1 + 0.6 * greatest(reached - 1, 0)), 6) as score, reached::int as reached, terms from boost",
    "t_fusion": f"""with {_PARTS}, {_BOOST}, r as (select space, query, doc, row_number() over (partition by space, query order by score desc, doc) as rank from (select space, query, doc, round(sum(part), 6) as score from parts group by 1, 2, 3)
union all select space, query, doc, row_number() over (partition by space, query order by score desc, doc) from (select space, query, doc, round(score, 6) as score from boost))
select query, doc, round(sum(1.0::double / (60 + rank)), 9) as score from r group by 1, 2""",
    "t_seeds": _seeds_sql(),
    "t_lead": f"""with {_BM25}, {_TRUTH}, g as (select distinct query from truth), f2 as (select distinct repo as space, path as doc from files),
c as (select query, doc, row_number() over (partition by f2.space, query order by sha256(query || chr(1) || doc) desc, doc) as rank from q join f2 on f2.space = q.space),
x as (select g.query, coalesce(1.0 / min(b.rank), 0) as v from g left join truth t on t.query = g.query left join b on b.query = t.query and b.doc = t.doc group by 1),
y as (select g.query, coalesce(1.0 / min(c.rank), 0) as v from g left join truth t on t.query = g.query left join c on c.query = t.query and c.doc = t.doc group by 1)
select 'mrr' as metric, count(*) as n, round(avg(x.v - y.v), 4) as difference from x join y on y.query = x.query""",
    "t_seed_kinds": f"""with {_Q} select distinct query, unnest(regexp_extract_all(text, '\\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\\b', 1)) as symbol, 'camel' as how from q
union all select distinct query, unnest(regexp_extract_all(text, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1)), 'snake' from q""",
    "t_name_scores": f"""with {_OWN}, a as (select distinct package_name as query, lower(regexp_replace(path, '^.*/|\\.[A-Za-z0-9_]+$', '', 'g')) as asked from upstream_files), t as (select *, list_filter(string_split(replace(asked, '_', ' '), ' '), lambda x: len(x) > 1) as terms from a),
s as (select query, path, name, case when lower(name) = asked or lower(string_split(name, '.')[-1]) = asked then 6.0 when starts_with(lower(string_split(name, '.')[-1]), asked) then 3.0 else 0.0 end
  + coalesce(list_sum(list_transform(terms, lambda x: case when contains(replace(replace(lower(name), '_', ' '), '.', ' '), x) then 2.0 else 0.0 end + case when contains(lower(path), x) then 1.0 else 0.0 end + case when contains(lower(coalesce(meta, '')), x) then 0.5 else 0.0 end)), 0) as score
  from n, t where name <> '<module>') select query, path, name, round(score, 2)::double as score from s where score > 0.9""",
    "t_control": f"""with {_Q}, f as (select distinct repo as space, path as doc from files where not ({_TEST.format('path')})) select query, doc, row_number() over (partition by f.space, query order by sha256(query || chr(1) || doc) desc, doc)::int as rank from q join f on f.space = q.space""",
    "t_scores": f"""with {_BM25}, {_TRUTH}, g as (select query, count(*) as truth_files from truth group by 1), m as (select b.query, b.doc, rank, truth.doc is not null as hit from b left join truth on truth.query = b.query and truth.doc = b.doc),
s as (select g.query, truth_files, count(m.doc) as retrieved, min(rank) filter (hit) as first, count(*) filter (hit and rank <= truth_files) as within, count(*) filter (hit and rank <= 1) as h1, count(*) filter (hit and rank <= 5) as h5, count(*) filter (hit and rank <= 10) as h10 from g left join m on m.query = g.query group by 1, 2)
select query, truth_files, retrieved, round(h1 / truth_files, 6) as recall_at_1, (h1 = truth_files)::int::double as all_found_at_1, round(h5 / truth_files, 6) as recall_at_5, (h5 = truth_files)::int::double as all_found_at_5,
round(h10 / truth_files, 6) as recall_at_10, (h10 = truth_files)::int::double as all_found_at_10, coalesce(first = 1, false)::int::double as precision_at_1, round(coalesce(1 / first, 0), 6) as mrr, (within = truth_files)::int::double as exact_set from s""",
    "t_macro": f"""with {_BM25}, {_TRUTH}, g as (select query, count(*) as truth_files from truth group by 1), m as (select b.query, rank from b join truth on truth.query = b.query and truth.doc = b.doc),
s as (select g.query, count(rank) filter (rank <= 10) / any_value(truth_files) as r, coalesce(1 / min(rank), 0) as rr from g left join m on m.query = g.query group by 1)
select q.space as repo, count(*) as instances, round(avg(r), 6) as recall_at_10, round(avg(rr), 6) as mrr from s join q on q.query = s.query group by 1""",
    "t_ceiling": f"with {_Q}, {_TRUTH} select count(*) as truth, count(*) filter (not ({_TEST.format('doc')})) as reachable from truth",
    "t_stratified": "select instance_id, repo from (select *, row_number() over (partition by repo order by instance_id) as turn from (select distinct instance_id, repo from instances)) order by turn, repo limit 60",
    "t_medians": "select event_type, round(median(value), 6) as median, round(sum(value), 2) as total from events group by 1",
    "t_path_references": """with r as (select distinct path, unnest(regexp_extract_all(content, '(?:src|href)="([^"]*)"', 1)) as ref from files where path like '%.html' and content is not null),
t as (select path, ref, case when trim(ref) <> '' and len(trim(ref)) <= 1024 and not regexp_matches(trim(ref), '^[A-Za-z][A-Za-z0-9+.\\-]*:') and not regexp_matches(trim(ref), '^(//|#|\\?)') and not regexp_matches(trim(ref), '\\s') then string_split(string_split(trim(ref), '#')[1], '?')[1] end as target from r)
select path, substr(ref, 1, 40) as ref, target, case when target is null then null else list_aggregate(list_concat(p[1:len(p) - 1 - ups], list_filter(string_split(target, '/'), lambda x: x not in ('.', '..', ''))), 'string_agg', '/') end as normal
from (select *, string_split(path, '/') as p, len(list_filter(string_split(target, '/'), lambda x: x = '..')) as ups from t)""",
    "t_module_paths": """with r as (select distinct path, unnest(regexp_extract_all(content, '(?m)^from ([\\w.]+) import', 1)) as module from files where path like '%.py' and content is not null),
t as (select *, len(module) - len(ltrim(module, '.')) as dots, replace(ltrim(module, '.'), '.', '/') as rest, string_split(path, '/') as p from r)
select path, module, case when dots = 0 then rest || '.py' else list_aggregate(list_filter(list_concat(p[1:len(p) - dots], [rest]), lambda x: x <> ''), 'string_agg', '/') || '.py' end as file from t""",
}
