"""The queries of the path search operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Typed, ancestors, base_name, normal_path, normal_query_column, shown, with_normal
from ..operators import history as H
from ..operators import index as I
from ..operators import maintain as M
from ..operators import retrieve as R
from ..operators import search as S
from ..sources import corpora as C

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Fixed value: 2001-11-05 00:00 UTC, the day after the last event of the log.
NOW_MS = 1_004_918_400_000

FILES = """files AS (SELECT p_partkey AS seq, 'parts' AS workspace, 'file' AS kind,
  p_brand || '/' || p_type || '/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.item' AS relative_path FROM part)"""
PATHS = (
    FILES
    + """, every AS (SELECT * FROM files UNION ALL SELECT DISTINCT -1, 'parts', 'directory', unnest([split_part(relative_path, '/', 1), split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2)]) FROM files),
paths AS (SELECT *, lower(relative_path) AS norm_path, regexp_extract(lower(relative_path), '([^/]*)$', 1) AS norm_name, regexp_extract(lower(relative_path), '^(.*)/', 1) AS norm_parent, workspace AS norm_workspace FROM every)"""
)
BRANDS = """bfiles AS (SELECT p_partkey AS seq, p_brand AS workspace, 'file' AS kind, p_type || '/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.item' AS relative_path FROM part),
bevery AS (SELECT * FROM bfiles UNION ALL SELECT DISTINCT -1, workspace, 'directory', split_part(relative_path, '/', 1) FROM bfiles),
bpaths AS (SELECT *, lower(relative_path) AS norm_path, regexp_extract(lower(relative_path), '([^/]*)$', 1) AS norm_name, regexp_extract(lower(relative_path), '^(.*)/', 1) AS norm_parent, lower(workspace) AS norm_workspace FROM bevery)"""
PAGES = """pages0 AS (SELECT page_id AS seq, regexp_extract(regexp_extract(url, '^[^:]+://(.*)$', 1), '^([^/?#]*)', 1) AS workspace, 'file' AS kind,
  regexp_replace(regexp_extract(regexp_extract(url, '^[^:]+://(.*)$', 1), '^[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS relative_path FROM pages),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, relative_path ORDER BY seq) AS k FROM pages0) WHERE k = 1)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def fuzzy_sql(whole: str, q: str) -> str:
    chars = ", ".join(f"{{'ch': '{c}', 'at': 0, 'score': CAST(0 AS DOUBLE)}}" for c in q)
    at = f"instr(substr({whole}, s.at + 1), c.ch)"
    step = f"""CASE WHEN s.at >= 0 AND {at} > 0 THEN {{'ch': c.ch, 'at': CAST(s.at + {at} AS INTEGER), 'score': CAST(s.score + CASE WHEN {at} = 1 AND s.at > 0 THEN 24 ELSE 6 END
      + CASE WHEN s.at + {at} = 1 OR substr({whole}, CAST(s.at + {at} - 1 AS BIGINT), 1) = '/' THEN 35 ELSE 0 END AS DOUBLE)}} ELSE {{'ch': c.ch, 'at': CAST(-1 AS INTEGER), 'score': s.score}} END"""
    folded = f"list_reduce([{{'ch': '', 'at': 0, 'score': CAST(0 AS DOUBLE)}}, {chars}], lambda s, c: {step})"
    return f"(SELECT CASE WHEN r.at > 0 THEN r.score - length({whole}) * CAST(0.15 AS DOUBLE) END FROM (SELECT {folded} AS r))"


def ladder_sql(q: str, use_fuzzy: bool = True) -> str:
    if not q:
        return "CASE WHEN kind = 'directory' THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    whole, d = "(norm_workspace || '/' || norm_path)", "CAST(0.1 AS DOUBLE)"
    return f"""CAST(CASE WHEN norm_path = '{q}' THEN 10000 WHEN starts_with(norm_path, '{q}') THEN CAST(9000 AS DOUBLE) - length(norm_path)
      WHEN norm_name = '{q}' THEN 8500 WHEN starts_with(norm_name, '{q}') THEN CAST(8000 AS DOUBLE) - length(norm_name)
      WHEN instr(norm_path, '/{q}') > 0 THEN CAST(7500 AS DOUBLE) - (instr(norm_path, '/{q}') - 1) - length(norm_path) * {d}
      WHEN instr(norm_path, '{q}') > 0 THEN CAST(7000 AS DOUBLE) - (instr(norm_path, '{q}') - 1) - length(norm_path) * {d}
      WHEN {whole} = '{q}' THEN 10000 WHEN instr({whole}, '{q}') > 0 THEN CAST(6500 AS DOUBLE) - (instr({whole}, '{q}') - 1) - length({whole}) * {d}
      ELSE {fuzzy_sql(whole, q) if use_fuzzy else "NULL"} END AS DOUBLE)"""


def top_sql(rows: str, k: int) -> str:
    return f"""SELECT row_number() OVER (ORDER BY score DESC, kind <> 'directory', relative_path COLLATE en, workspace, seq) AS rank, relative_path, workspace, kind, score
FROM ({rows}) WHERE score IS NOT NULL ORDER BY rank LIMIT {k}"""


def scored_sql(q: str, where: str = "true", use_fuzzy: bool = True, source: str = "paths") -> str:
    return f"SELECT *, {ladder_sql(q, use_fuzzy)} AS score FROM {source} WHERE {where}"


def all_scores(q: str, use_fuzzy: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.scored(C.part_paths(spark, sf_dir), q, use_fuzzy).select("relative_path", "kind", "score")

    return run, f"WITH {PATHS} SELECT relative_path, kind, score FROM ({scored_sql(q, use_fuzzy=use_fuzzy)}) WHERE score IS NOT NULL"


for _name, _q, _fuzzy in (
    ("score_exact_path", "brand#1", False), ("score_prefix", "brand#1/", False), ("score_segment", "economy", False), ("score_substring", "gear", False),
    ("score_workspace_qualified", "parts/brand#2", False), ("score_fuzzy", "rngear", True),
):
    QUERIES[_name], SQL[_name] = all_scores(_q, _fuzzy)


def searches(text: str, where: str, q: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = C.part_paths(spark, sf_dir)
        return S.search(paths, S.plan_request(paths, text, **options))

    return run, f"WITH {PATHS} " + top_sql(scored_sql(q, where, options.get("fuzzy", True)), options.get("k", 50))


for _name, _text, _where, _q, _options in (
    ("rank_topk", "gear", "true", "gear", {}),
    ("rank_empty_query", "", "norm_parent = ''", "", {}),
    ("search_len1", "n", "starts_with(norm_name, 'n')", "n", {}),
    ("search_len2", "ea", "instr(norm_name, 'ea') > 0", "ea", {}),
    ("search_scoped", "Brand#1/ge", "starts_with(norm_path, 'brand#1/') AND instr(norm_name, 'ge') > 0", "ge", {}),
    ("search_global", "//brand#1/gear", "true", "brand#1/gear", {}),
    ("search_strict", "gear", "true", "gear", {"fuzzy": False}),
    ("kind_filter", "bra", "kind = 'directory'", "bra", {"files": False}),
    ("plan_fallback_global", "brand/gear", "true", "brand/gear", {}),
    ("direct_children", "Brand#1/", "norm_parent = 'brand#1'", "", {"k": 500}),
):
    QUERIES[_name], SQL[_name] = searches(_text, _where, _q, **_options)


@query("normalize_paths", f"WITH {PATHS} SELECT relative_path, kind, norm_path, norm_name, norm_parent FROM paths")
def normalize_paths(spark, sf_dir):
    return C.part_paths(spark, sf_dir).select("relative_path", "kind", "norm_path", "norm_name", "norm_parent")


@query("descendants", f"WITH {PATHS} SELECT relative_path, kind FROM paths WHERE starts_with(norm_path, 'brand#1/')")
def descendants(spark, sf_dir):
    return C.part_paths(spark, sf_dir).where(R.in_scope("Brand#1", False)).select("relative_path", "kind")


@query("exclude_dirs", f"WITH {PATHS} SELECT relative_path, kind FROM paths WHERE NOT list_contains(string_split(norm_path, '/')[1:CASE WHEN kind = 'file' THEN 2 ELSE 9 END], 'brand#2')")
def exclude_dirs(spark, sf_dir):
    return I.exclude(C.part_paths(spark, sf_dir), ["brand#2"]).select("relative_path", "kind")


@query("exclude_suffixes", f"WITH {PAGES} SELECT workspace, relative_path FROM firsts WHERE NOT ends_with(lower(relative_path), '.html')")
def exclude_suffixes(spark, sf_dir):
    return I.exclude(with_normal(I.first_of_equal(C.page_paths(spark, sf_dir))), suffixes=["HTML "]).select("workspace", "relative_path")


@query("depth_limit", f"WITH {PATHS} SELECT relative_path, len(string_split(relative_path, '/')) = 2 AND kind = 'directory' AS cut FROM paths WHERE len(string_split(relative_path, '/')) <= 2")
def depth_limit(spark, sf_dir):
    return I.to_depth(C.part_paths(spark, sf_dir), 2).select("relative_path", "cut")


@query("display_parent", f"WITH {PATHS} SELECT relative_path, regexp_extract(relative_path, '([^/]*)$', 1) AS label, CASE WHEN norm_parent = '' THEN './' ELSE regexp_extract(relative_path, '^(.*)/', 1) END AS above FROM paths")
def display_parent(spark, sf_dir):
    path = F.col("relative_path")
    return C.part_paths(spark, sf_dir).select("relative_path", base_name(path).alias("label"), shown(path, F.col("workspace")).alias("above"))


@query("display_several_roots", f"WITH {PAGES} SELECT workspace, relative_path, workspace || ' \u00b7 ' || relative_path AS full_path, workspace || ' \u00b7 ' || CASE WHEN instr(relative_path, '/') = 0 THEN './' ELSE regexp_extract(relative_path, '^(.*)/', 1) END AS above, workspace AS hidden FROM firsts")
def display_several_roots(spark, sf_dir):
    path, ws = F.col("relative_path"), F.col("workspace")
    return I.first_of_equal(C.page_paths(spark, sf_dir)).select("workspace", "relative_path", shown(path, ws, "full", True).alias("full_path"), shown(path, ws, "parent", True).alias("above"), shown(path, ws, "hidden", True).alias("hidden"))


@query("index_dedupe", f"WITH {PAGES} SELECT workspace, relative_path, seq, row_number() OVER (PARTITION BY workspace ORDER BY seq) AS entry_id FROM firsts")
def index_dedupe(spark, sf_dir):
    return I.first_of_equal(C.page_paths(spark, sf_dir)).select("workspace", "relative_path", "seq", F.col("entry_id").cast("long").alias("entry_id"))


@query("derive_directories", f"WITH {PAGES} SELECT DISTINCT workspace, array_to_string(string_split(relative_path, '/')[1:i], '/') AS directory FROM firsts, LATERAL (SELECT unnest(range(1, len(string_split(relative_path, '/')))) AS i)")
def derive_directories(spark, sf_dir):
    return C.page_paths(spark, sf_dir).select("workspace", F.explode(ancestors(F.col("relative_path"))).alias("directory")).distinct()


BRAND = "(SELECT min(workspace) FROM bpaths)"


@query("workspace_filter", f"WITH {BRANDS} " + top_sql(scored_sql("gear", f"workspace = {BRAND}", source="bpaths"), 50))
def workspace_filter(spark, sf_dir):
    paths = C.brand_paths(spark, sf_dir)
    first = paths.agg(F.min("workspace")).first()[0]
    return S.search(paths, S.Request(Typed("", "gear"), workspace=first))


@query(
    "entry_quota",
    f"""WITH RECURSIVE {PAGES}, sizes AS (SELECT workspace, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY workspace) AS i, count(*) OVER () AS roots FROM firsts GROUP BY workspace),
shared(i, remaining, share, workspace, n) AS (
  SELECT CAST(0 AS BIGINT), CAST(100 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT)
  UNION ALL SELECT s.i, CAST(remaining - least(s.n, CAST(ceil(remaining / (s.roots - s.i + 1)) AS BIGINT)) AS BIGINT), least(s.n, CAST(ceil(remaining / (s.roots - s.i + 1)) AS BIGINT)), s.workspace, s.n FROM shared JOIN sizes s ON s.i = shared.i + 1),
ids AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY seq) AS entry_id FROM firsts)
SELECT ids.workspace, relative_path, shared.n > share AS limited FROM ids JOIN shared ON ids.workspace = shared.workspace WHERE entry_id <= share""",
)
def entry_quota(spark, sf_dir):
    return I.quota(I.first_of_equal(C.page_paths(spark, sf_dir)), 100).select("workspace", "relative_path", "limited")


@query("entry_counters", f"WITH {BRANDS} SELECT workspace, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'directory') AS directories, count(*) AS size FROM bpaths GROUP BY workspace")
def entry_counters(spark, sf_dir):
    return I.counters(C.brand_paths(spark, sf_dir))


@query("removed_share", f"WITH {BRANDS}, kept AS (SELECT count(*) AS n FROM bpaths WHERE NOT starts_with(norm_path, 'economy/')) SELECT n AS size, m AS capacity, 1 - n / CAST(m AS DOUBLE) AS removed_share FROM kept, (SELECT CAST(count(*) AS INTEGER) AS m FROM bpaths)")
def removed_share(spark, sf_dir):
    paths = C.brand_paths(spark, sf_dir)
    return I.counters(paths.where("not startswith(norm_path, 'economy/')"), paths.count())


@query("lookup_by_id", f"WITH {BRANDS}, ids AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY seq, relative_path) AS entry_id FROM bpaths) SELECT workspace, kind, relative_path FROM ids WHERE workspace = {BRAND} AND entry_id = 7")
def lookup_by_id(spark, sf_dir):
    paths = I.first_of_equal(C.brand_paths(spark, sf_dir))
    return I.by_id(paths, paths.agg(F.min("workspace")).first()[0], 7).select("workspace", "kind", "relative_path")


@query("lookup_by_identity", f"WITH {BRANDS} SELECT workspace, kind, relative_path FROM bpaths WHERE workspace = {BRAND} AND norm_path = 'economy' AND kind = 'directory'")
def lookup_by_identity(spark, sf_dir):
    paths = C.brand_paths(spark, sf_dir)
    return I.by_identity(paths, paths.agg(F.min("workspace")).first()[0], "directory", "Economy").select("workspace", "kind", "relative_path")


ENTRY = "workspace, kind, relative_path"


def opens_sql(files: str) -> str:
    return f"""opened AS (SELECT {ENTRY}, epoch_ms(l_shipdate) AS at_ms FROM lineitem JOIN {files} ON seq = l_partkey),
gaps AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY {ENTRY} ORDER BY at_ms) AS gap FROM opened),
history AS (SELECT {ENTRY}, max(at_ms) AS last_ms, CAST(sum(CASE WHEN gap IS NULL OR gap >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS opens FROM gaps GROUP BY ALL)"""


OPENS = opens_sql("files")
CHOSEN = f"""clicks AS (SELECT CASE event_id % 3 WHEN 0 THEN 'ge' WHEN 1 THEN 'gear' ELSE 'n' END AS query, {ENTRY}, epoch_us(ts) // 1000 AS at_ms FROM events CROSS JOIN (SELECT count(*) AS n FROM part) AS c JOIN files ON seq = event_id % n WHERE event_type = 'click'),
chosen AS (SELECT query, {ENTRY}, count(*) AS affinity, max(at_ms) AS last_ms FROM clicks WHERE length(query) >= 2 GROUP BY ALL)"""


def used_sql(q: str, typed: str = "h.relative_path") -> str:
    """hist: the newest 200 of history, pinned first, with what was chosen for the query; typed: their paths as history has them."""
    return f"""hist AS (SELECT h.* REPLACE ({typed} AS relative_path), ends_with(h.relative_path, '77.item') AS pinned, c.affinity FROM history h LEFT JOIN chosen c ON c.query = '{q}' AND c.workspace = h.workspace AND c.kind = h.kind AND c.relative_path = {typed}
  ORDER BY pinned DESC, last_ms DESC, {typed} LIMIT 200)"""


def part_history(spark, sf_dir, query=None, typed=None):
    """Opens of the log; files whose name ends in 77 are pinned; with what was chosen for the query. typed: their paths as history has them."""
    h = H.count_opens(C.opens(spark, sf_dir)).withColumn("pinned", F.col("relative_path").endswith("77.item"))
    if typed is not None:
        h = h.withColumn("relative_path", typed)
    return h if query is None else H.with_affinity(h, H.choices(C.clicks(spark, sf_dir)), query)


BOOST = f"""round((CASE WHEN pinned THEN CAST(2000 AS DOUBLE) ELSE 0 END) + least(CAST(300 AS DOUBLE), least(CAST(180 AS DOUBLE), log2(opens + CAST(1 AS DOUBLE)) * 40)
  + greatest(CAST(0 AS DOUBLE), 120 - greatest(CAST(0 AS DOUBLE), (CAST({NOW_MS} AS DOUBLE) - last_ms) / CAST(86400000 AS DOUBLE)) * 10))
  + least(CAST(2500 AS DOUBLE), log2(coalesce(affinity, 0) + CAST(1 AS DOUBLE)) * 1200), 6)"""


@query("history_opens", f"WITH {FILES}, {OPENS} SELECT {ENTRY}, last_ms, opens FROM history")
def history_opens(spark, sf_dir):
    return H.count_opens(C.opens(spark, sf_dir))


@query("history_workspaces", f"WITH {BRANDS}, {opens_sql('(SELECT seq, workspace, kind, split_part(relative_path, chr(47), 1) AS relative_path FROM bfiles)')} SELECT {ENTRY}, last_ms, opens FROM history")
def history_workspaces(spark, sf_dir):
    """Opens of directories that are called the same in every workspace."""
    dirs = lambda spark, sf_dir: C.brand_files(spark, sf_dir).withColumn("relative_path", F.substring_index("relative_path", "/", 1))
    return H.count_opens(C.opens(spark, sf_dir, dirs))


@query("history_topn", f"WITH {FILES}, {OPENS} SELECT relative_path, ends_with(relative_path, '77.item') AS pinned, last_ms FROM history ORDER BY pinned DESC, last_ms DESC, relative_path LIMIT 200")
def history_topn(spark, sf_dir):
    return H.newest(part_history(spark, sf_dir)).select("relative_path", "pinned", "last_ms")


@query("usage_boost", f"WITH {FILES}, {OPENS}, {CHOSEN}, h AS (SELECT h.*, ends_with(h.relative_path, '77.item') AS pinned, affinity FROM history h LEFT JOIN chosen c ON c.query = 'gear' AND c.workspace = h.workspace AND c.kind = h.kind AND c.relative_path = h.relative_path) SELECT relative_path, {BOOST} AS gain FROM h")
def usage_boost(spark, sf_dir):
    from ..functions.score import boost

    h = part_history(spark, sf_dir, "gear")
    return h.select("relative_path", boost(F.col("pinned"), F.col("last_ms"), F.col("opens"), F.col("affinity"), NOW_MS).alias("gain"))


@query("query_affinity", f"WITH {FILES}, {CHOSEN} SELECT query, {ENTRY}, affinity, last_ms FROM chosen")
def query_affinity(spark, sf_dir):
    return H.choices(C.clicks(spark, sf_dir))


@query("selection_topn", f"WITH {FILES}, {CHOSEN} SELECT query, relative_path, last_ms FROM chosen ORDER BY last_ms DESC, query, relative_path LIMIT 500")
def selection_topn(spark, sf_dir):
    return H.newest_choices(H.choices(C.clicks(spark, sf_dir))).select("query", "relative_path", "last_ms")


@query("record_uris", f"WITH roots AS (SELECT DISTINCT regexp_extract(url, '^([^:]+://[^/]+)', 1) AS root FROM pages WHERE instr(url, '.com/') > 0) SELECT root AS workspace, 'file' AS kind, regexp_replace(substr(url, length(root) + 2), '/$', '') AS relative_path, page_id * 1000 AS at_ms FROM pages JOIN roots ON starts_with(url, root || '/') WHERE regexp_extract(regexp_replace(substr(url, length(root) + 2), '/$', ''), '([^/]*)$', 1) <> ''")
def record_uris(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    roots = pages.where("instr(url, '.com/') > 0").select(F.regexp_extract("url", "^([^:]+://[^/]+)", 1).alias("root")).distinct().withColumn("workspace", F.col("root"))
    return H.opened(pages.select(F.col("url").alias("uri"), (F.col("page_id") * 1000).alias("at_ms")), roots)


def history_search_sql(q: str, where: str, source: str = "paths", k: int = 50) -> str:
    """History rows need a match, others `where` too; the boost goes to the former."""
    rows = f"SELECT p.*, h.opens, h.last_ms, h.pinned, h.affinity FROM ({scored_sql(q, source=source)}) p LEFT JOIN hist h ON p.workspace = h.workspace AND p.kind = h.kind AND p.norm_path = lower(h.relative_path) WHERE h.opens IS NOT NULL OR ({where})"
    return f"both_rows AS ({rows}), gained AS (SELECT * EXCLUDE (score), round(CASE WHEN opens IS NULL THEN score ELSE score + {BOOST} END, 6) AS score FROM both_rows) " + top_sql("SELECT * FROM gained", k)


@query("search_with_history", f"WITH {PATHS}, {OPENS}, {CHOSEN}, {used_sql('gear')}, " + history_search_sql("gear", "true"))
def search_with_history(spark, sf_dir):
    return S.search(C.part_paths(spark, sf_dir), S.Request(Typed("", "gear"), now_ms=NOW_MS), part_history(spark, sf_dir, "gear"))


UPPER = "CASE WHEN ends_with(h.relative_path, '3.item') THEN upper(h.relative_path) ELSE h.relative_path END"


@query("search_len1_history", f"WITH {PATHS}, {OPENS}, {CHOSEN}, {used_sql('n', UPPER)}, " + history_search_sql("n", "starts_with(norm_name, 'n')"))
def search_len1_history(spark, sf_dir):
    """History is looked at beside the names that begin with n; some of its paths are in another case than the index has them."""
    typed = F.when(F.col("relative_path").endswith("3.item"), F.upper("relative_path")).otherwise(F.col("relative_path"))
    return S.search(C.part_paths(spark, sf_dir), S.Request(Typed("", "n"), now_ms=NOW_MS), part_history(spark, sf_dir, "n", typed))


@query("history_first", f"WITH {PATHS}, {OPENS}, {CHOSEN}, {used_sql('gear')}, " + history_search_sql("gear", "false"))
def history_first(spark, sf_dir):
    return S.from_history(C.part_paths(spark, sf_dir), S.Request(Typed("", "gear"), now_ms=NOW_MS), part_history(spark, sf_dir, "gear"))


@query(
    "search_stale_history",
    f"WITH {PATHS}, {OPENS}, {CHOSEN}, {used_sql('gear')}, known AS (SELECT * FROM paths WHERE NOT starts_with(norm_path, 'brand#2/') OR relative_path IN (SELECT relative_path FROM hist)), "
    + history_search_sql("gear", "true", "(SELECT * REPLACE (CASE WHEN starts_with(norm_path, 'brand#2/') THEN -1 ELSE seq END AS seq) FROM known)"),
)
def search_stale_history(spark, sf_dir):
    """The index lacks what is below a directory; history still has some of it."""
    paths = C.part_paths(spark, sf_dir).where("not startswith(norm_path, 'brand#2/')")
    return S.search(paths, S.Request(Typed("", "gear"), now_ms=NOW_MS, keep_missing=True), part_history(spark, sf_dir, "gear"))


def posting_sql(tokens: str) -> str:
    return f"WITH {PATHS} SELECT DISTINCT workspace, token, relative_path FROM paths, LATERAL (SELECT unnest({tokens}) AS token) WHERE token <> ''"


SEGMENTS = "list_distinct(flatten(list_transform(string_split(norm_path, '/'), lambda s: [s[1:1], s[1:2], s[1:3]])))"
for _kind, _tokens in (
    ("prefix", "[norm_name[1:1], norm_name[1:2], norm_name[1:3]]"),
    ("bigram", "list_transform(range(1, length(norm_name)), lambda i: substr(norm_name, i, 2))"),
    ("segment", SEGMENTS),
):
    QUERIES[f"postings_{_kind}"] = lambda spark, sf_dir, kind=_kind: I.postings(C.part_paths(spark, sf_dir), kind)
    SQL[f"postings_{_kind}"] = posting_sql(_tokens)

GRAMS = f"""{PATHS}, posts AS (SELECT DISTINCT workspace, token, relative_path FROM paths, LATERAL (SELECT unnest(list_transform(range(1, length(norm_name)), lambda i: substr(norm_name, i, 2))) AS token)),
n AS (SELECT workspace, token, count(*) AS n FROM posts WHERE token IN ('ge', 'ea', 'ar') GROUP BY ALL)"""


@query("ngram_rarest", f"WITH {GRAMS}, best AS (SELECT workspace, min_by(token, (n, instr('gear', token))) AS token FROM n GROUP BY workspace HAVING count(*) = 3) SELECT workspace, relative_path FROM posts JOIN best USING (workspace, token)")
def ngram_rarest(spark, sf_dir):
    return R.rarest_gram(I.postings(C.part_paths(spark, sf_dir), "bigram"), "gear")


@query("ngram_intersect", f"WITH {GRAMS} SELECT workspace, relative_path FROM posts JOIN n USING (workspace, token) GROUP BY ALL HAVING count(*) = 3")
def ngram_intersect(spark, sf_dir):
    return R.common_grams(I.postings(C.part_paths(spark, sf_dir), "bigram"), "gear")


@query("segment_intersect", f"WITH {PATHS} SELECT relative_path, kind FROM paths WHERE list_has_all({SEGMENTS}, ['bra', 'eco'])")
def segment_intersect(spark, sf_dir):
    return R.all_segments(C.part_paths(spark, sf_dir), "eco/bra").select("relative_path", "kind")


POOLED = f"""toks AS (SELECT * FROM (VALUES ('ge', 0), ('ea', 1), ('ar', 2), ('r-', 3), ('-1', 4)) AS t(token, place)),
counted AS (SELECT workspace, token, place, count(*) AS n FROM bpaths JOIN toks ON instr(norm_name, token) > 0 GROUP BY ALL),
lists AS (SELECT workspace, count(*) AS have, list(token ORDER BY n, place)[1:3] AS common, min_by(token, (n, place)) AS rare FROM counted GROUP BY workspace),
pooled AS (SELECT p.*, CASE WHEN norm_name = 'gear-1' THEN 1 WHEN starts_with(norm_name, 'gea') THEN 2 WHEN have >= 2 AND len(list_filter(common, lambda t: instr(norm_name, t) > 0)) = len(common) THEN 3
  WHEN have = 5 AND instr(norm_name, rare) > 0 THEN 4 ELSE 5 END AS pool FROM bpaths p LEFT JOIN lists USING (workspace))"""


@query("candidate_pools", f"WITH {BRANDS}, {POOLED} SELECT workspace, relative_path, kind, pool FROM pooled")
def candidate_pools(spark, sf_dir):
    paths = C.brand_paths(spark, sf_dir)
    return R.pooled(paths, paths, "gear-1").select("workspace", "relative_path", "kind", "pool")


@query("candidate_budget", f"WITH {BRANDS}, {POOLED} " + top_sql(scored_sql("gear-1", source="(SELECT * FROM pooled ORDER BY pool, workspace, seq, relative_path LIMIT 100)"), 50))
def candidate_budget(spark, sf_dir):
    return S.search(C.brand_paths(spark, sf_dir), S.Request(Typed("", "gear-1"), most=100))


@query("search_progress", f"WITH {BRANDS}, n AS (SELECT count(*) AS n FROM bpaths WHERE kind = 'file' AND instr(norm_name, 'ge') > 0) SELECT least(n, 50) AS processed, n > 50 AS truncated FROM n")
def search_progress(spark, sf_dir):
    return S.progress(C.brand_paths(spark, sf_dir), S.Request(Typed("", "ge"), most=50, directories=False))


@query("search_len1_budget", f"WITH {BRANDS} " + top_sql(scored_sql("r", source="(SELECT * FROM bpaths WHERE starts_with(norm_name, 'r') ORDER BY workspace, seq, relative_path LIMIT 2000)"), 50))
def search_len1_budget(spark, sf_dir):
    """One character is never looked for in more than 2,000 names."""
    return S.search(C.brand_paths(spark, sf_dir), S.Request(Typed("", "r"), most=10_000))


@query("suffix_exact", f"WITH {PATHS} SELECT relative_path FROM paths WHERE kind = 'directory' AND norm_path = (SELECT min(norm_path) FROM paths WHERE kind = 'directory' AND instr(norm_path, '/') > 0)")
def suffix_exact(spark, sf_dir):
    """The chain as a user may type it: with backslashes, white space and another case."""
    paths = C.part_paths(spark, sf_dir)
    first = paths.where("kind = 'directory' and depth = 2").agg(F.min("norm_path")).first()[0]
    return R.directory_by_suffix(paths, ".\\ " + first.upper().replace("/", "\\") + "\\").select("relative_path")


#: Directories three deep under one root: chains of type and brand end one of them, chains of brand and size often several.
NESTED = """levels AS (SELECT DISTINCT lower(p_type) || '/' || lower(p_brand) AS one, lower(p_brand) || '/size-' || p_size AS leaf, lower(p_type) AS type FROM part),
dirs AS (SELECT DISTINCT 'shop/' || one AS norm_path FROM levels UNION SELECT 'shop/' || type || '/' || leaf FROM levels)"""
SUFFIX_SQL = "WITH {nested}, typed AS ({typed}), ends AS (SELECT norm_path FROM dirs, typed WHERE ends_with(norm_path, '/' || chain)) SELECT norm_path FROM ends WHERE (SELECT count(*) FROM ends) = 1"


def nested_paths(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    path = F.concat(F.lit("shop/"), "p_type", F.lit("/"), "p_brand", F.lit("/size-"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".item"))
    files = p.select(F.col("p_partkey").alias("seq"), F.lit("shops").alias("workspace"), F.lit("file").alias("kind"), path.alias("relative_path"))
    dirs = files.select("workspace", F.explode(ancestors(F.col("relative_path"))).alias("relative_path")).distinct()
    return with_normal(files.unionByName(dirs.select(F.lit(-1).cast("long").alias("seq"), "workspace", F.lit("directory").alias("kind"), "relative_path")))


def nested_chain(paths, depth, least):
    """The first chain of the last two names that at least `least` directories of a depth end with."""
    chain = F.regexp_extract("norm_path", "([^/]+/[^/]+)$", 1)
    return paths.where((F.col("kind") == "directory") & (F.col("depth") == depth)).groupBy(chain.alias("chain")).count().where(F.col("count") >= least).agg(F.min("chain")).first()[0]


@query("suffix_match_one", SUFFIX_SQL.format(nested=NESTED, typed="SELECT min(one) AS chain FROM levels"))
def suffix_match_one(spark, sf_dir):
    paths = nested_paths(spark, sf_dir)
    return R.directory_by_suffix(paths, nested_chain(paths, 3, 1)).select("norm_path")


@query("suffix_match_several", SUFFIX_SQL.format(nested=NESTED, typed="SELECT min(leaf) AS chain FROM (SELECT leaf FROM levels GROUP BY leaf HAVING count(*) > 1)"))
def suffix_match_several(spark, sf_dir):
    paths = nested_paths(spark, sf_dir)
    return R.directory_by_suffix(paths, nested_chain(paths, 4, 2)).select("norm_path")


def changes_sql(files: str) -> str:
    return f"""changed AS (SELECT event_id AS num, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS change, {ENTRY} FROM events CROSS JOIN (SELECT count(*) AS n FROM part) AS c JOIN {files} f ON f.seq = event_id % n WHERE event_type IN ('error', 'signup')),
last AS (SELECT {ENTRY}, max_by(change, num) AS change, max(num) AS seq FROM changed GROUP BY ALL)"""


@query("coalesce_changes", f"WITH {FILES}, {changes_sql('files')} SELECT workspace, relative_path, change, seq FROM last")
def coalesce_changes(spark, sf_dir):
    return M.last_change(C.changes(spark, sf_dir)).select("workspace", "relative_path", "change", "seq")


@query("remove_subtree", f"WITH {PATHS} SELECT relative_path, kind FROM paths WHERE norm_path <> 'brand#1' AND NOT starts_with(norm_path, 'brand#1/')")
def remove_subtree(spark, sf_dir):
    return M.remove_subtree(C.part_paths(spark, sf_dir), "parts", "brand#1").select("relative_path", "kind")


@query("remove_in_workspace", f"WITH {BRANDS} SELECT {ENTRY} FROM bpaths WHERE workspace <> {BRAND} OR norm_path <> 'economy' AND NOT starts_with(norm_path, 'economy/')")
def remove_in_workspace(spark, sf_dir):
    """All workspaces have a directory of that name; one loses it."""
    paths = C.brand_paths(spark, sf_dir)
    return M.remove_subtree(paths, paths.agg(F.min("workspace")).first()[0], "economy").select("workspace", "kind", "relative_path")


def applied(spark, sf_dir, files, paths):
    """What is left after the log, from what was there before it; a batch over the limit is rebuilt from what is there now."""
    log = C.changes(spark, sf_dir, files)
    every = files(spark, sf_dir)
    live = paths(spark, sf_dir).join(C.unborn(log), C.ENTRY, "left_anti")
    gone = M.last_change(log).where("change = 'delete'").select(*C.ENTRY)
    now = paths(spark, sf_dir).select("seq", *C.ENTRY).join(gone, C.ENTRY, "left_anti")
    return M.apply_changes(live, log, rebuild=lambda: now).select(*C.ENTRY)


@query("apply_changes", f"WITH {PATHS}, {changes_sql('files')} SELECT {ENTRY} FROM paths WHERE relative_path NOT IN (SELECT relative_path FROM last WHERE change = 'delete')")
def apply_changes(spark, sf_dir):
    return applied(spark, sf_dir, C.part_files, C.part_paths)


@query("apply_in_workspaces", f"WITH {BRANDS}, {changes_sql('bfiles')} SELECT {ENTRY} FROM bpaths p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE change = 'delete' AND l.workspace = p.workspace AND l.relative_path = p.relative_path)")
def apply_in_workspaces(spark, sf_dir):
    return applied(spark, sf_dir, C.brand_files, C.brand_paths)


@query("delete_directories", f"WITH {BRANDS} SELECT {ENTRY} FROM bpaths p WHERE NOT (p.norm_path = 'small' OR starts_with(p.norm_path, 'small/')) OR workspace = {BRAND}")
def delete_directories(spark, sf_dir):
    """Deletes a directory, typed in another case, in all workspaces but the first."""
    paths = C.brand_paths(spark, sf_dir)
    names = paths.select("workspace").distinct()
    log = names.where(F.col("workspace") != paths.agg(F.min("workspace")).first()[0]).select(F.lit(1).alias("seq"), F.lit("delete").alias("change"), "workspace", F.lit(None).cast("string").alias("kind"), F.lit("Small").alias("relative_path"))
    return M.apply_changes(paths, log).select(*C.ENTRY)


@query("create_again", f"WITH {BRANDS} SELECT workspace, kind, relative_path FROM bpaths p WHERE NOT (p.norm_path = 'small' OR starts_with(p.norm_path, 'small/')) UNION ALL SELECT DISTINCT workspace, 'file', 'Small' FROM bpaths")
def create_again(spark, sf_dir):
    """A file created in place of a directory whose name differs in case takes it away, and all below it."""
    paths = C.brand_paths(spark, sf_dir)
    log = paths.select("workspace").distinct().select(F.lit(1).alias("seq"), F.lit("create").alias("change"), "workspace", F.lit("file").alias("kind"), F.lit("Small").alias("relative_path"))
    return M.apply_changes(paths, log).select(*C.ENTRY)


@query("load_scope", f"WITH {BRANDS} SELECT {ENTRY} FROM bpaths WHERE kind = 'directory' OR workspace = {BRAND} AND starts_with(norm_path, 'economy/')")
def load_scope(spark, sf_dir):
    """An index of the top level gets all below one directory of one workspace."""
    paths = C.brand_paths(spark, sf_dir)
    some = I.to_depth(paths, 1)
    return M.add_scope(some, paths, paths.agg(F.min("workspace")).first()[0], "economy").select(*C.ENTRY)


@query("case_lookup", f"WITH {PATHS} SELECT relative_path FROM paths WHERE norm_path = 'brand#1'")
def case_lookup(spark, sf_dir):
    return I.by_path(C.part_paths(spark, sf_dir), "BRAND#1").select("relative_path")


@query("normalize_query", r"""SELECT p_partkey, lower(regexp_replace(replace(p_brand || '/' || p_name, '\', '/'), '\s+', '', 'g')) AS norm FROM part""")
def normalize_query(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    return p.select("p_partkey", normal_query_column(F.concat(F.lit(".\\"), "p_brand", F.lit("\\"), "p_name")).alias("norm"))


@query("normalize_slashes", f"WITH {FILES} SELECT relative_path, lower(relative_path) AS norm FROM files")
def normalize_slashes(spark, sf_dir):
    return C.part_files(spark, sf_dir).select("relative_path", normal_path(F.concat(F.lit("./"), F.translate("relative_path", "/", "\\"))).alias("norm"))
