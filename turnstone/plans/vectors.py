"""Queries over vectors: name -> (query, SQL that gives the same rows, or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstone.functions import text
from turnstone.operators import graph, retrieval as r
from turnstone.plans.adapters import AS_OF, points, queries, table, turns
from turnstone.sources.shared import written

K = 10
LANES = [("content", 1, 32, 1.0, None), ("code", 33, 32, 0.5, None), ("error", 1, 64, 0.7, "has_errors"), ("idle", 17, 32, 0.0, None)]
SPARSE = [("tool", 0.05), ("path", 0.02)]

_PTS = f"""p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::VARCHAR AS project, label % 2 = 0 AS has_errors, {AS_OF} - vec_id * 37 % 90 * 86400 AS start_ts FROM embeddings),
q AS (SELECT id AS query_id, vec AS qv, project AS qp FROM p WHERE id % 50 = 0)"""
_ALL = f"""WITH {_PTS}, s AS (SELECT query_id, id, round(list_dot_product(vec, qv), 6) AS score, project, qp, has_errors FROM p, q WHERE id <> query_id)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
_UNIT = "list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"


def _lane(name: str, first: int, size: int, weight: float, where: str | None) -> str:
    sl = lambda v: _UNIT.format(x=f"{v}[{first}:{first + size - 1}]")
    return f"SELECT '{name}' AS lane, {weight}::DOUBLE AS weight, query_id, id, score, rank FROM (SELECT *, {_RANK} FROM (SELECT query_id, id, round(list_dot_product({sl('vec')}, {sl('qv')}), 6) AS score FROM p, q WHERE id <> query_id{' AND ' + where if where else ''})) WHERE rank <= 50"


_TOK = "list_filter(string_split_regex(lower({x}), '[^\\pL\\pN]+'), lambda t: strlen(t) >= 2)"


def _sparse(name: str, weight: float, tokens: str) -> str:
    """tokens: SQL of rows (id, token)."""
    return f"SELECT '{name}' AS lane, {weight}::DOUBLE AS weight, query_id, id, score, rank FROM (SELECT *, {_RANK} FROM (SELECT query_id, id, round(sum(tf * q * ln((n - df + 0.5) / (df + 0.5) + 1)), 6) AS score FROM (SELECT token, id, count(*) AS tf FROM ({tokens}) GROUP BY ALL) po JOIN (SELECT token, id AS query_id, count(*) AS q FROM ({tokens}) WHERE id % 50 = 0 GROUP BY ALL) qt USING (token) JOIN (SELECT token, count(DISTINCT id) AS df FROM ({tokens}) GROUP BY ALL) df USING (token), (SELECT count(DISTINCT id) AS n FROM ({tokens})) WHERE id <> query_id GROUP BY ALL)) WHERE rank <= 50"


_TOOLS = "SELECT user_id AS id, event_type AS token FROM events WHERE event_type IS NOT NULL"
_PATHS = f"SELECT page_id AS id, unnest({_TOK.format(x="coalesce(url, '')")}) AS token FROM pages"
_LANES = f"WITH {_PTS}, l AS ({' UNION ALL '.join([_lane(*x) for x in LANES if x[3] > 0] + [_sparse(*SPARSE[0], _TOOLS), _sparse(*SPARSE[1], _PATHS)])})"


def _found(spark: SparkSession, d: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    return p, r.neighbours(p, queries(p), k)


def knn_content(spark, d):
    return _found(spark, d)[1]


def knn_filtered_recall(spark, d):
    p = points(spark, d)
    return r.neighbours(p.filter("has_errors"), queries(p), 5)


def knn_threshold(spark, d):
    p = points(spark, d)
    return r.neighbours(p, queries(p), K, at_least=0.2)


def cosine_pairs(spark, d):
    from turnstone.functions.vector import cosine

    p = points(spark, d)
    return p.select("id", F.round(cosine(F.slice("vec", 1, 32), F.slice("vec", 33, 32)), 6).alias("halves"))


def _counted(rows: DataFrame, key: str, tokens) -> tuple[DataFrame, DataFrame]:
    """Postings (token, id, tf) of the rows, and how many ids they have."""
    own = written(rows.select(F.col(key).alias("id"), F.explode(tokens).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf")), "postings")
    return own, own.agg(F.countDistinct("id").alias("documents"))


def _fused(spark, d):
    """The dense lanes, and two sparse ones: sessions are points, users and pages of one id."""
    p = points(spark, d)
    found = r.lanes(p, queries(p), LANES)
    tools = _counted(table(spark, d, "events").filter("event_type is not null"), "user_id", F.array("event_type"))
    paths = _counted(table(spark, d, "pages"), "page_id", text.sparse_tokens(F.coalesce("url", F.lit(""))))
    for (name, weight), (postings, n) in zip(SPARSE, (tools, paths)):
        asked = postings.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "token", "tf")
        found = found.unionAll(r.sparse_lane(name, weight, postings, asked, n))
    return p, found


def lens_formula(spark, d):
    p, found = _fused(spark, d)
    return r.formula_fusion(found, p, AS_OF, K)


def lens_rrf(spark, d):
    return r.rrf_fusion(_fused(spark, d)[1], K)


def lens_breakdown(spark, d):
    b = r.breakdown(_fused(spark, d)[1])
    get = lambda k: F.col("scores")[k].alias(k)
    return b.select("query_id", "id", *[get(x) for x in ("content", "code", "error", "tool", "path")])


def grouped_topk(spark, d):
    p = points(spark, d)
    return r.grouped(p, queries(p), "project", 2, 8)


def neighbours_excluded(spark, d):
    """Neighbours outside the query's own project."""
    p = points(spark, d)
    return r.neighbours(p, queries(p), 5, other="project")


def neighbour_bands(spark, d):
    """The five nearest, in bands of similarity."""
    score = F.col("score")
    return r.ranked(_found(spark, d)[1].drop("rank"), 5).select("query_id", "id", F.when(score > 0.7, "strong").when(score > 0.5, "related").otherwise("weak").alias("band"))


def _vecs(p: DataFrame, ids: list[int]) -> dict[int, list[float]]:
    """The vectors of a few given points, in one job."""
    got = {row[0]: list(row[1]) for row in p.filter(F.col("id").isin(ids)).select("id", "vec").collect()}
    if missing := [i for i in ids if i not in got]:
        raise ValueError(f"no points {missing}")
    return got


def mix_match(spark, d):
    p = points(spark, d)
    pairs, target = r.pad_pairs([0, 1, 2], [3, 4])
    v = _vecs(p, [0, 1, 2, 3, 4])
    return r.discover(p, [(v[a], v[b]) for a, b in pairs], v[target], [0, 1, 2, 3, 4], 20)


def discovery_pairs(spark, d):
    p = points(spark, d)
    v = _vecs(p, [5, 6, 7, 8, 9])
    return r.discover(p, [(v[5], v[6]), (v[7], v[8])], v[9], [5, 6, 7, 8, 9], 20)


def relevance_feedback(spark, d):
    p = points(spark, d)
    v = _vecs(p, [0, 1, 2, 3, 4])
    return r.feedback(p, v[0], [(v[1], v[2], 1.0), (v[3], v[4], 0.5)], 20)


_V = lambda i: f"(SELECT vec FROM p WHERE id = {i})"
_DOT = lambda i: f"list_dot_product(vec, {_V(i)})"


def _discover_sql(pairs: list[tuple[int, int]], target: int, out: list[int]) -> str:
    rank = " + ".join(f"sign(round({_DOT(a)} - {_DOT(b)}, 9))" for a, b in pairs)
    return f"WITH {_PTS} SELECT id, round({rank} + 1 / (1 + exp(-{_DOT(target)})), 6) AS score FROM p WHERE id NOT IN ({', '.join(map(str, out))}) ORDER BY score DESC, id LIMIT 20"


def maxsim_late(spark, d):
    """Points as four chunks of 16 dimensions; queries as four rows."""
    p = points(spark, d)
    cut = lambda c: F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(c, i * 16 + 1, 16)))
    chunks = p.select("id", cut(F.col("vec")).alias("chunk", "vec"))
    rows = queries(p).select("query_id", cut(F.col("vec")).alias("row", "vec"))
    return r.maxsim(chunks, rows, K)


def mmr_diverse(spark, d):
    p, found = _found(spark, d, 200)
    return r.mmr(found, p, K)


def ndcg_at_10(spark, d):
    p, found = _found(spark, d)
    own = queries(p).select("query_id", F.col("project").alias("own"))
    marked = found.join(own, "query_id").join(p.select("id", "project"), "id").withColumn("hit", F.col("project") == F.col("own"))
    sizes = own.join(p.groupBy(F.col("project").alias("own")).agg((F.count(F.lit(1)) - 1).alias("n")), "own")
    return r.ndcg_of(marked, sizes)


def facet_projects(spark, d):
    return r.facets(points(spark, d), "project")


def ordered_sessions(spark, d):
    return r.ordered(points(spark, d)).select("id", "start_ts", "project")


def range_filter(spark, d):
    p = r.exact_filter(points(spark, d), {"has_errors": True, "start_ts": (AS_OF - 30 * 86400, None), "project": ["2", "4", "6"]})
    return p.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def _postings(spark, d):
    t = turns(spark, d).filter("role <> 'system'")
    own = t.select(F.col("session_id").alias("id"), F.explode(text.sparse_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return written(own.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf")), "postings")


def sparse_idf_search(spark, d):
    """Each tenth conversation's first turn against all conversations."""
    t = turns(spark, d)
    q = t.filter("turn_index = 0 and session_id % 10 = 0").select(F.col("session_id").alias("query_id"), F.explode(text.sparse_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    n = t.agg(F.countDistinct("session_id").alias("documents"))
    return r.sparse_search(_postings(spark, d), q, n, K)


def knn_pairs(spark, d):
    return graph.pairs(graph.sample(points(spark, d), 80), 5)


def _forest(spark, d):
    p = graph.sample(points(spark, d), graph.SAMPLE)
    edges = graph.pairs(p, 5)
    return p, edges, graph.spanning_forest(edges)


def mst_edges(spark, d):
    """The forest of all points."""
    return graph.forest_of_any(graph.pairs(points(spark, d), 5))


def bridges(spark, d):
    p, _, forest = _forest(spark, d)
    return graph.bridges(forest, p)


def _named(p):
    """Only each fifth point's project is known, and there are many."""
    return p.withColumn("project", F.when(F.col("id") % 5 == 0, F.concat(F.lit("p"), F.col("id") % 51)).otherwise(""))


def isolated_projects(spark, d):
    p, _, forest = _forest(spark, d)
    return graph.isolated(forest, _named(p))


def gap_near_miss(spark, d):
    """Projects that are alike at half of the usual similarity, as the vectors of the table are far apart."""
    p, edges, forest = _forest(spark, d)
    return graph.near_misses(edges, forest, _named(p).filter("project <> ''"), at_least=0.25)


def node_detail(spark, d):
    """What is stored of the sample's nodes: a third of them in the newer points."""
    p = points(spark, d)
    stored = p.select("id", "project", "start_ts")
    return graph.node_detail(graph.sample(p, 80), stored.filter("id % 3 = 0").withColumn("version", F.lit(3)), stored.withColumn("version", F.lit(2)))


def project_insights(spark, d):
    """Projects of the sample: sessions are users of the same ids, tools their events, folders those of pages."""
    p, _, forest = _forest(spark, d)
    tool = F.element_at(F.create_map(*[F.lit(x) for pair in _TOOLS.items() for x in pair]), F.col("event_type"))
    calls = table(spark, d, "events").filter((F.col("user_id") % 4 != 1) | (F.col("event_type") != "purchase")).select(F.col("user_id").alias("session_id"), tool.alias("name"), F.to_json(F.struct(F.concat(F.lit("/srv/"), "event_type", F.lit("/a/b/x.py")).alias("file_path"))).alias("input_json"))
    return graph.insights(p.withColumn("project", F.concat("project", F.lit("-"), F.col("id") % 7)), calls, forest)


#: Tools that events stand for.
_TOOLS = {"click": "Bash", "view": "Read", "signup": "WebFetch", "purchase": "Edit", "error": "Task"}


_POST = f"po AS (SELECT t AS token, id, count(*) AS tf FROM (SELECT conv_id AS id, unnest({_TOK.format(x='text')}) AS t FROM conversations WHERE role <> 'system') GROUP BY ALL)"

_SAMPLE = f"(SELECT * FROM p ORDER BY md5(id::VARCHAR), id LIMIT {graph.SAMPLE})"
#: An edge is in the forest unless edges that come before it connect its ends.
_MST = f"""WITH RECURSIVE {_PTS}, e0 AS (
  SELECT least(q, id) AS a, greatest(q, id) AS b, max(score) AS score FROM (
    SELECT x.id AS q, y.id AS id, round(list_dot_product(x.vec, y.vec), 6) AS score, row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.vec, y.vec), 6) DESC, y.id) AS k FROM {{z}} x, {{z}} y WHERE x.id <> y.id) WHERE k <= 5 GROUP BY 1, 2
), e AS (
  SELECT *, row_number() OVER (ORDER BY weight, a, b) AS r FROM (SELECT a, b, round(greatest(0, 1 - score), 6) AS weight FROM e0)
), arcs AS (
  SELECT a AS v, b AS w, r FROM e UNION ALL SELECT b, a, r FROM e
), reach AS (
  SELECT r, a AS v FROM e UNION SELECT reach.r, arcs.w FROM reach JOIN arcs ON arcs.v = reach.v AND arcs.r < reach.r
), f AS (
  SELECT a, b, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = e.r AND reach.v = e.b)
)"""
def _mmr(k: int) -> str:
    """The greedy choice, a step for each place: the best of what is left by half its score less half its likeness to the nearest chosen one."""
    steps = ["c AS MATERIALIZED (SELECT s.query_id, s.id, s.score, p.vec FROM (SELECT *, " + _RANK + " FROM s) s JOIN p ON p.id = s.id WHERE rank <= 200)"]
    for n in range(1, k + 1):
        before = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(1, n)) or "SELECT query_id, id, score, vec, 0::DOUBLE AS worth, 0 AS place FROM c WHERE false"
        steps.append(f"b{n} AS MATERIALIZED ({before})")
        steps.append(f"w{n} AS (SELECT c.query_id, c.id, any_value(c.score) AS score, any_value(c.vec) AS vec, round(0.5 * any_value(c.score) - 0.5 * coalesce(max(list_dot_product(c.vec, b.vec)), 0), 9) AS worth FROM c LEFT JOIN b{n} b ON b.query_id = c.query_id WHERE NOT EXISTS (SELECT 1 FROM b{n} x WHERE x.query_id = c.query_id AND x.id = c.id) GROUP BY c.query_id, c.id)")
        steps.append(f"m{n} AS MATERIALIZED (SELECT query_id, id, score, vec, worth, {n} AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, score DESC, id) AS r FROM w{n}) WHERE r = 1)")
    return f"{_ALL}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT query_id, id, score, worth, place::BIGINT AS place FROM m{n}" for n in range(1, k + 1))


QUERIES: dict[str, tuple] = {
    "knn_content": (knn_content, f"{_ALL} SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 10"),
    "knn_filtered_recall": (knn_filtered_recall, f"{_ALL} SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM s WHERE has_errors) WHERE rank <= 5"),
    "knn_threshold": (knn_threshold, f"{_ALL} SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM s WHERE score >= 0.2) WHERE rank <= 10"),
    "cosine_pairs": (cosine_pairs, f"WITH {_PTS} SELECT id, round(list_cosine_similarity(vec[1:32], vec[33:64]), 6) AS halves FROM p"),
    "lens_formula": (lens_formula, f"{_LANES}, f AS (SELECT query_id, l.id, round(sum(weight * score) + any_value(pow(0.5, abs({AS_OF} - start_ts) / 2592000.0)) + any_value(CASE WHEN has_errors THEN 0.2 ELSE 0.0 END), 5) AS score FROM l JOIN p ON l.id = p.id GROUP BY query_id, l.id) SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10"),
    "lens_rrf": (lens_rrf, f"{_LANES}, f AS (SELECT query_id, id, round(sum(weight / (60 + rank)), 9) AS score FROM l GROUP BY ALL) SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10"),
    "lens_breakdown": (lens_breakdown, f"{_LANES} SELECT query_id, id, max(score) FILTER (lane = 'content') AS content, max(score) FILTER (lane = 'code') AS code, max(score) FILTER (lane = 'error') AS error, max(score) FILTER (lane = 'tool') AS tool, max(score) FILTER (lane = 'path') AS path FROM l GROUP BY ALL"),
    "grouped_topk": (grouped_topk, f"{_ALL}, h AS (SELECT query_id, project AS \"group\", id, score FROM s), g AS (SELECT *, row_number() OVER w AS in_group, first(score) OVER w AS best, first(id) OVER w AS best_id FROM h WINDOW w AS (PARTITION BY query_id, \"group\" ORDER BY score DESC, id)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, best_id, in_group) AS place FROM g WHERE in_group <= 2) SELECT query_id, \"group\", id, score, in_group, place FROM o WHERE place <= 8"),
    "neighbours_excluded": (neighbours_excluded, f"{_ALL}, h AS (SELECT query_id, id, score FROM s WHERE project <> qp) SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM h) WHERE rank <= 5"),
    "neighbour_bands": (neighbour_bands, f"{_ALL} SELECT query_id, id, CASE WHEN score > 0.7 THEN 'strong' WHEN score > 0.5 THEN 'related' ELSE 'weak' END AS band FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 5"),
    "mix_match": (mix_match, _discover_sql([(0, 3), (1, 4), (2, 3)], 0, [0, 1, 2, 3, 4])),
    "discovery_pairs": (discovery_pairs, _discover_sql([(5, 6), (7, 8)], 9, [5, 6, 7, 8, 9])),
    "relevance_feedback": (relevance_feedback, f"WITH {_PTS} SELECT id, round({_DOT(0)} + {_DOT(1)} - {_DOT(2)} + 0.5 * ({_DOT(3)} - {_DOT(4)}), 6) AS score FROM p ORDER BY score DESC, id LIMIT 20"),
    "maxsim_late": (maxsim_late, f"WITH {_PTS}, c AS (SELECT id, vec[i * 16 + 1 : i * 16 + 16] AS cv FROM p, range(4) t(i)), w AS (SELECT query_id, i, qv[i * 16 + 1 : i * 16 + 16] AS rv FROM q, range(4) t(i)), b AS (SELECT query_id, id, i, max(list_dot_product(cv, rv)) AS best FROM c, w GROUP BY ALL), f AS (SELECT query_id, id, round(sum(best), 6) AS score FROM b GROUP BY ALL) SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10"),
    "mmr_diverse": (mmr_diverse, _mmr(K)),
    "ndcg_at_10": (ndcg_at_10, f"{_ALL}, h AS (SELECT *, {_RANK} FROM s), g AS (SELECT query_id, sum(CASE WHEN project = qp THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h WHERE rank <= 10 GROUP BY ALL), n AS (SELECT query_id, least(count(*), 10) AS n FROM s WHERE project = qp GROUP BY ALL), i AS (SELECT query_id, sum(1 / log2(k + 1)) AS ideal FROM n, range(1, 11) t(k) WHERE k <= n GROUP BY ALL) SELECT g.query_id, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM g LEFT JOIN i ON g.query_id = i.query_id"),
    "facet_projects": (facet_projects, "SELECT label::VARCHAR AS value, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 256"),
    "ordered_sessions": (ordered_sessions, f"WITH {_PTS} SELECT id, start_ts, project FROM p ORDER BY start_ts DESC NULLS LAST, id LIMIT 60"),
    "range_filter": (range_filter, f"WITH {_PTS} SELECT project, count(*) AS n FROM p WHERE has_errors AND start_ts >= {AS_OF - 30 * 86400} AND project IN ('2', '4', '6') GROUP BY ALL"),
    "sparse_idf_search": (sparse_idf_search, f"WITH {_POST}, n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), df AS (SELECT token, count(*) AS df FROM po GROUP BY ALL), qt AS (SELECT query_id, t AS token, count(*) AS q FROM (SELECT conv_id AS query_id, unnest({_TOK.format(x='text')}) AS t FROM conversations WHERE turn = 0 AND conv_id % 10 = 0) GROUP BY ALL), f AS (SELECT query_id, id, round(sum(tf * q * ln((n - df + 0.5) / (df + 0.5) + 1)), 6) AS score FROM po JOIN qt ON po.token = qt.token JOIN df ON po.token = df.token CROSS JOIN n GROUP BY ALL) SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10"),
    "knn_pairs": (knn_pairs, f"WITH {_PTS}, z AS (SELECT id, vec FROM p ORDER BY md5(id::VARCHAR), id LIMIT 80), s AS (SELECT x.id AS query_id, y.id AS id, round(list_dot_product(x.vec, y.vec), 6) AS score FROM z x, z y WHERE x.id <> y.id), h AS (SELECT * FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 5) SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM h GROUP BY 1, 2"),
    "mst_edges": (mst_edges, f"{_MST.format(z='p')} SELECT a, b, weight FROM f"),
    "bridges": (bridges, f"{_MST.format(z=_SAMPLE)}, j AS (SELECT x.project AS pa, y.project AS pb FROM f JOIN p x ON x.id = f.a JOIN p y ON y.id = f.b WHERE x.project <> y.project) SELECT project, partner, count(*) AS n FROM (SELECT pa AS project, pb AS partner FROM j UNION ALL SELECT pb, pa FROM j) GROUP BY ALL"),
    "isolated_projects": (isolated_projects, f"{_MST.format(z=_SAMPLE)}, n AS (SELECT id, 'p' || id % 51 AS project FROM {_SAMPLE} WHERE id % 5 = 0), j AS (SELECT x.project AS pa, y.project AS pb FROM f JOIN n x ON x.id = f.a JOIN n y ON y.id = f.b WHERE x.project <> y.project), g AS (SELECT project, count(*) AS sessions FROM n GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM g WHERE project NOT IN (SELECT pa FROM j UNION SELECT pb FROM j)"),
    "gap_near_miss": (gap_near_miss, f"{_MST.format(z=_SAMPLE)}, n AS (SELECT id, 'p' || id % 51 AS project FROM {_SAMPLE} WHERE id % 5 = 0), m AS (SELECT least(x.project, y.project) AS x, greatest(x.project, y.project) AS y, round(avg(score), 6) AS score FROM e0 JOIN n x ON x.id = e0.a JOIN n y ON y.id = e0.b WHERE x.project <> y.project GROUP BY 1, 2), j AS (SELECT least(x.project, y.project) AS x, greatest(x.project, y.project) AS y FROM f JOIN n x ON x.id = f.a JOIN n y ON y.id = f.b) SELECT x, y, score FROM m WHERE score >= 0.25 AND NOT EXISTS (SELECT 1 FROM j WHERE j.x = m.x AND j.y = m.y) ORDER BY score DESC, x, y LIMIT 5"),
    "node_detail": (node_detail, f"WITH {_PTS} SELECT id, project, start_ts, CASE WHEN id % 3 = 0 THEN 3 ELSE 2 END AS version FROM (SELECT * FROM p ORDER BY md5(id::VARCHAR), id LIMIT 80)"),
    "project_insights": (project_insights, f"""{_MST.format(z=_SAMPLE)}, z AS (SELECT id, project || '-' || id % 7 AS project, has_errors FROM {_SAMPLE}),
b AS (SELECT project, count(*) AS sessions, count(*) FILTER (has_errors) AS with_errors FROM z GROUP BY ALL),
c AS (SELECT project, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOOLS.items())} END AS name, event_type, count(*) AS n FROM events JOIN z ON user_id = id WHERE user_id % 4 <> 1 OR event_type <> 'purchase' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, name) AS k, row_number() OVER (PARTITION BY project ORDER BY n DESC, event_type) AS kf FROM c),
t AS (SELECT project, list(name) FILTER (k <= 4) AS names, string_agg(name || '×' || n, ' ' ORDER BY k) FILTER (k <= 4) AS tools, string_agg(name || '×' || n, ' ' ORDER BY k) FILTER (k <= 3) AS three, string_agg('/srv/' || event_type || '/a/…', ' ' ORDER BY kf) FILTER (kf <= 3) AS folders FROM r GROUP BY ALL),
j AS (SELECT x.project AS pa, y.project AS pb FROM f JOIN z x ON x.id = f.a JOIN z y ON y.id = f.b WHERE x.project <> y.project),
o AS (SELECT project, count(*) AS bridges_out, string_agg(DISTINCT partner, ',' ORDER BY partner) AS partners FROM (SELECT pa AS project, pb AS partner FROM j UNION ALL SELECT pb, pa FROM j) GROUP BY ALL),
m AS (SELECT *, CASE WHEN list_contains(names, 'Bash') AND list_contains(names, 'Edit') THEN 'code + shell' WHEN list_contains(names, 'WebFetch') THEN 'research' WHEN list_contains(names, 'Task') THEN 'agent orchestration' WHEN list_contains(names, 'Edit') THEN 'editing' WHEN list_contains(names, 'Bash') THEN 'shell work' WHEN list_contains(names, 'Read') THEN 'exploration' ELSE 'general' END AS theme FROM t)
SELECT b.project, sessions, with_errors, coalesce(theme, 'general') AS theme, coalesce(theme, 'general') || coalesce(' · ' || three, '') AS label, coalesce(tools, '') AS tools, coalesce(folders, '') AS folders, coalesce(bridges_out, 0) AS bridges_out, coalesce(partners, '') AS partners FROM b LEFT JOIN m ON b.project = m.project LEFT JOIN o ON b.project = o.project"""),
}
