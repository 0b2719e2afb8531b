"""The whole run over stored graphs: ingest with evolution, build, refine, answer, score, sum up; each phase can be repeated.

A phase reads what is stored and adds what is missing, in one commit (sources.graph_store), so a run that was cut off at any
write goes on where it stopped and ends with the graph of an uncut one. `report` is called after each phase with its name and
the number of rows it added."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import text as T
from sparkloom.operators import answering, bm25, embedder, graph, hierarchy, providers, retrieval, stats
from sparkloom.operators.communities import semi_synchronous
from sparkloom.session import written
from sparkloom.sources import graph_store, results
from sparkloom.streaming import ingest

log = logging.getLogger("sparkloom")
KEYS = ["sample_id"]
NEIGHBOURS, ALIKE = 5, 0.8
#: Questions that have an answer in the conversation; the fifth category's don't and are left out.
CATEGORIES = (1, 2, 3, 4)
STRATEGIES = ("flat", "graph_traversal", "top_down", "bottom_up")
Report = Callable[[str, int], None]


def set_logging(path: str | None = None) -> None:
    """Messages to the console and, if given, to a file."""
    log.setLevel(logging.INFO)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)


def timestamp(at: Column | str, style: str = "seconds") -> Column:
    """A time as the text that nodes ("seconds"), file names ("minutes") and log records ("iso") carry."""
    return F.date_format(at, {"seconds": "yyyy-MM-dd HH:mm:ss", "minutes": "yyyy-MM-dd-HH-mm", "iso": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}[style])


def _done(name: str, n: int, report: Report | None) -> None:
    log.info("%s: %d", name, n)
    if report:
        report(name, n)


# -- evolution -------------------------------------------------------------------------------------------------------


def prefix_neighbours(facts: DataFrame, keys: list[str] = KEYS, k: int = NEIGHBOURS, only: DataFrame | None = None) -> DataFrame:
    """keys, node_id, other, rank, cosine: for every fact the k best of those up to it by the hybrid score an index of that
    time gives. What is asked is the fact's content, what is searched are the indexed documents; a fact is indexed before it
    asks, so it is among its own candidates. only: (keys, node_id) of the facts that ask, if not all do."""
    docs = facts.select(*keys, "node_id", "content", F.col("node_seq").alias("at"), T.index_document("content", "context", "keywords", "tags").alias("doc"))
    both = bm25.prefix_scores(docs, keys, "node_id", "at", "doc", "content", only, (T.hash_embedding("content"), T.hash_embedding("doc")), retrieval.ALPHA, k)
    scored = both.withColumn("cosine", F.round(2 * F.col("dense") - 1, 9))
    scored = scored.withColumn("score", F.round(retrieval.ALPHA * (F.col("cosine") + 1) / 2 + (1 - retrieval.ALPHA) * F.col("sparse"), 9))
    return retrieval.top_k(scored, [*keys, "query"], "score", "other_seq", k).select(*keys, F.col("query").alias("node_id"), "other", "rank", "cosine")


def evolution_prompt(note: Column | str, neighbours: Column | str) -> Column:
    return F.concat(F.lit("A new memory and its neighbours, numbered from 0. Should it be linked with some, should their context and tags change? Reply as JSON with should_evolve, actions (strengthen, update_neighbor), suggested_connections, new_context_neighborhood and new_tags_neighborhood.\nMemory: "), T._c(note), F.lit("\nNeighbours:\n"), T._c(neighbours))


def offline_links(near: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The offline decision: a fact is linked both ways with those of its neighbours that are alike enough; not with itself.
    Both ways come of one row, so neighbours are found once."""
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    alike = near.where((F.col("cosine") >= ALIKE) & (F.col("node_id") != F.col("other")))
    return alike.select(*keys, F.inline(F.array(way("node_id", "other"), way("other", "node_id")))).distinct()


def decided(near: DataFrame, facts: DataFrame, backend: str, **settings) -> tuple[DataFrame, DataFrame]:
    """(edges, updates) a provider decides on: links by place among the neighbours or by id, new contexts and tags by place."""
    others = facts.select(*KEYS, F.col("node_id").alias("other"), F.col("content").alias("other_content"))
    lists = near.join(others, [*KEYS, "other"]).groupBy(*KEYS, "node_id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "other_content"))).alias("n"))
    asked = lists.join(facts.select(*KEYS, "node_id", "content"), [*KEYS, "node_id"])
    lines = F.array_join(F.transform("n", lambda x: F.concat((x["rank"] - 1).cast("string"), F.lit(": "), x["other_content"])), "\n")
    replied = written(providers.complete(asked.withColumn("prompt", evolution_prompt("content", lines)), "prompt", "reply", backend, **settings), "job-decisions")
    d = replied.withColumn("d", F.from_json(T.json_object("reply"), schemas.EVOLUTION)).where("d.should_evolve").withColumn("ids", F.transform("n", lambda x: x["other"]))
    picks = d.where(F.array_contains("d.actions", "strengthen")).select(*KEYS, "node_id", "ids", F.explode("d.suggested_connections").alias("s"))
    place = F.expr("try_cast(s AS int)")
    target = F.when(place.isNotNull(), F.get("ids", place)).when(F.array_contains("ids", F.col("s")), F.col("s"))
    edges = graph.both_ways(picks.select(*KEYS, F.col("node_id").alias("src"), target.alias("dst")).where("dst IS NOT NULL AND dst <> src").distinct()).distinct()
    changes = graph.neighbour_updates(d.where(F.array_contains("d.actions", "update_neighbor")).select(*KEYS, F.col("ids").alias("neighbours"), F.col("d.new_context_neighborhood").alias("contexts"), F.col("d.new_tags_neighborhood").alias("tags"), F.col("n")[0]["rank"].alias("r"), F.col("node_id").alias("by")))
    last = changes.join(facts.select(*KEYS, F.col("node_id").alias("by"), F.col("node_seq").alias("by_seq")), [*KEYS, "by"])
    return edges, last.groupBy(*KEYS, "node_id").agg(F.max_by(F.struct("context", "tags"), "by_seq").alias("x")).select(*KEYS, "node_id", "x.*")


def _edges(links: DataFrame, kind: str, version: int) -> DataFrame:
    """Rows of the edge table; what they lack is null or 0."""
    have = links.columns
    return links.select("sample_id", "src", "dst", (F.col("edge_seq") if "edge_seq" in have else F.lit(0)).cast("long").alias("edge_seq"), F.lit(kind).alias("type"), (F.col("weight") if "weight" in have else F.lit(None)).cast("double").alias("weight"), F.lit(version).cast("long").alias("version"))


def ingest_turns(spark: SparkSession, turns: DataFrame, root: str, version: int = 0, backend: str | None = None, report: Report | None = None, **settings) -> None:
    """Turns become facts with documents and vectors, then facts evolve. A turn that is stored already isn't added again, and
    an index that lacks documents gets them first."""
    ingest.rebuild_index(spark, root)
    known = graph_store.load(spark, root, "nodes").where("level = 'fact'").select("sample_id", F.col("node_seq").alias("turn_seq"))
    new = written(turns.join(known, ["sample_id", "turn_seq"], "left_anti"), "job-turns")
    _done("facts", 0 if new.isEmpty() else ingest.write_batch(new, root, version), report)
    evolve(spark, root, version, backend, report, **settings)


def evolve(spark: SparkSession, root: str, version: int = 0, backend: str | None = None, report: Report | None = None, **settings) -> None:
    """Facts that haven't evolved yet meet those before them in their sample. Links, changed neighbours and the mark that a
    fact has evolved are one commit."""
    facts = graph_store.load(spark, root, "nodes").where("level = 'fact'")
    todo = written(facts.join(graph_store.load(spark, root, "evolved"), [*KEYS, "node_id"], "left_anti").select(*KEYS, "node_id"), "job-evolving")
    if todo.isEmpty():
        _done("evolution", 0, report)
        return
    facts = facts.join(todo.select(*KEYS).distinct(), KEYS, "left_semi")
    near = written(prefix_neighbours(facts, only=todo), "job-neighbours")
    links, changed = (offline_links(near), None) if backend is None else decided(near, facts, backend, **settings)
    stored = graph_store.load(spark, root, "edges").select("sample_id", "src", "dst")
    with graph_store.Commit(spark, root, "evolution") as c:
        n = c.add(_edges(links.join(stored, ["sample_id", "src", "dst"], "left_anti"), "persona_related", version), "edges")
        if changed is not None:
            rows = facts.drop("context", "tags").join(changed, ["sample_id", "node_id"]).withColumn("version", F.col("version") + 1)
            c.add(rows, "nodes")
        c.add(todo, "evolved")
    _done("evolution", n, report)


# -- build and refine ------------------------------------------------------------------------------------------------


def _nodes(rows: DataFrame, version: int) -> DataFrame:
    """Rows of the node table; what they lack is null."""
    kinds = [x.strip().split(" ", 1) for x in schemas.NODES.replace("map<string,string>", "map<string;string>").split(",")]
    fixed = {"version": F.lit(version), "refined": F.lit(False)}
    return rows.select(*[(F.col(c) if c in rows.columns else fixed.get(c, F.lit(None))).cast(t.replace(";", ",")).alias(c) for c, t in kinds])


def offline_profiles(scenes: DataFrame) -> DataFrame:
    """A sample's profile without a model: its scenes' most frequent terms as interests, nothing else."""
    text = scenes.groupBy(*KEYS).agg(hierarchy.ordered_text(F.col("content"), F.col("node_seq")).alias("text"))
    none = F.lit("N/A")
    return text.select(*KEYS, *[(F.array_join(T.top_terms("text", 5), ", ") if d == "interests" else none).alias(d) for d in hierarchy.DIMENSIONS])


def communities(facts: DataFrame, related: DataFrame, rounds: int | None = None) -> DataFrame:
    """keys, node_id, community: by label propagation; where that fails, runs of ten facts in order."""
    try:
        return written(semi_synchronous(facts, related, KEYS, rounds).withColumnRenamed("label", "community"), "job-communities")
    except PySparkException as e:
        log.warning("clustering failed, facts are taken in order: %s", e)
        return written(graph.chunk_communities(facts, KEYS), "job-communities")


def build(spark: SparkSession, root: str, version: int = 1, rounds: int | None = None, backend: str | None = None, report: Report | None = None, **settings) -> None:
    """Scenes of communities that have none yet, personas of samples that have none yet, and the links between them."""
    nodes, edges = graph_store.load(spark, root, "nodes"), graph_store.load(spark, root, "edges")
    facts = nodes.where("level = 'fact'")
    related = edges.where("type = 'persona_related'").select(*KEYS, "src", "dst")
    label = communities(facts, related, rounds)
    todo = label.join(graph.uncovered(label, nodes, edges, KEYS, "scene").select(*KEYS, "community"), [*KEYS, "community"])
    first = facts.select(*KEYS, "node_id", "node_seq")
    # a community's name is its first fact's place, so it stays the same when the job is run again
    named = todo.join(first, [*KEYS, "node_id"]).groupBy(*KEYS, "community").agg(F.min("node_seq").alias("name"))
    todo = todo.join(named, [*KEYS, "community"]).select(*KEYS, "node_id", F.col("name").alias("community"))
    scenes, contains = hierarchy.build_scenes(facts, todo, KEYS)
    if backend is not None:
        replied = providers.complete(scenes.withColumn("prompt", answering.scene_prompt("content")), "prompt", "reply", backend, **settings)
        told = F.get_json_object(T.json_object("reply"), "$.scene_summary")
        scenes = replied.withColumn("content", F.coalesce(told, F.col("content"))).drop("prompt", "reply")
    scenes = written(_nodes(scenes, version), "job-scenes")
    _commit(spark, root, "scenes", scenes, contains, version, report)
    nodes = graph_store.load(spark, root, "nodes")
    scenes = nodes.where("level = 'scene'")
    if backend is None:
        profiles = offline_profiles(scenes)
    else:
        text = scenes.groupBy(*KEYS).agg(answering.persona_prompt(hierarchy.ordered_text(F.col("content"), F.col("node_seq"))).alias("prompt"))
        replied = providers.complete(text, "prompt", "reply", backend, **settings)
        profiles = replied.select(*KEYS, *[F.get_json_object(T.json_object("reply"), f"$.{d}").alias(d) for d in hierarchy.DIMENSIONS])
    personas = hierarchy.build_personas(profiles, KEYS, nodes).withColumn("tags", F.array("tag")).withColumn("attribute_type", F.col("tag"))
    personas = written(_nodes(personas, version), "job-personas")
    with_vec = nodes.unionByName(personas).withColumn("vec", T.hash_embedding("content"))
    links = hierarchy.link_personas(with_vec.where("level = 'persona'"), with_vec.where("level = 'scene'"), KEYS)
    stored = graph_store.load(spark, root, "edges").select(*KEYS, "src", "dst")
    _commit(spark, root, "personas", personas, links.join(stored, [*KEYS, "src", "dst"], "left_anti"), version, report)


def _commit(spark: SparkSession, root: str, phase: str, nodes: DataFrame, links: DataFrame, version: int, report: Report | None) -> None:
    """New nodes and their links together."""
    if nodes.isEmpty():
        _done(phase, 0, report)
        return
    with graph_store.Commit(spark, root, phase) as c:
        n = c.add(nodes, "nodes")
        c.add(_edges(links, "contains", version), "edges")
    _done(phase, n, report)


def refine(spark: SparkSession, root: str, version: int = 2, backend: str | None = None, report: Report | None = None, **settings) -> None:
    """Scenes not refined yet meet their sample's profile; all are refined then, changed or not. Offline nothing is added."""
    nodes = graph_store.load(spark, root, "nodes")
    scenes = nodes.where("level = 'scene' AND NOT coalesce(refined, false)")
    profile = hierarchy.profile_text(nodes, KEYS, F.coalesce(F.col("tags")[0], F.lit("")), "persona")
    asked = scenes.select(*KEYS, "node_id", "content").join(profile, KEYS)
    if backend is None:
        additions = asked.select(*KEYS, "node_id", F.lit("").alias("addition"))
    else:
        replied = providers.complete(asked.withColumn("prompt", answering.refinement_prompt("content", "profile")), "prompt", "reply", backend, **settings)
        body = T.json_object(T.literal_repair("reply"))
        wanted = F.coalesce(F.get_json_object(body, "$.needs_enhancement").cast("boolean"), F.lit(False))
        additions = replied.select(*KEYS, "node_id", F.when(wanted, F.get_json_object(body, "$.addition")).alias("addition"))
    fresh = hierarchy.refine(scenes, additions, KEYS)
    rows = scenes.drop("content", "refined").join(fresh, [*KEYS, "node_id"]).withColumn("version", F.col("version") + 1)
    rows = written(_nodes(rows.drop("version"), version).withColumn("refined", F.lit(True)), "job-refined")
    n = 0
    if not rows.isEmpty():
        with graph_store.Commit(spark, root, "refined scenes") as c:
            n = c.add(rows, "nodes")
    _done("refined scenes", n, report)


# -- answers ---------------------------------------------------------------------------------------------------------


def _indexed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("doc", T.index_document("content", "context", "keywords", "tags")).withColumn("vec", T.hash_embedding("doc"))


def rewritten(questions: DataFrame, backend: str | None, **settings) -> DataFrame:
    """questions with `text`, what is searched for: the question, or the keywords a provider makes of it."""
    if backend is None:
        return questions.withColumn("text", F.col("question"))
    replied = providers.complete(questions.withColumn("prompt", answering.keyword_prompt("question")), "prompt", "reply", backend, **settings)
    return replied.withColumn("text", F.coalesce(answering.keywords_of("reply"), "question")).drop("prompt", "reply")


def related(queries: DataFrame, nodes: DataFrame, edges: DataFrame, strategy: str = "graph_traversal", k: Column | int = 5, levels: tuple[int, ...] | None = None) -> DataFrame:
    """keys, query_id, node_id, rank of a strategy; queries (keys, query_id, text). k may be a column of queries."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {STRATEGIES}")
    queries, docs = queries.withColumn("vec", T.hash_embedding("text")), _indexed(nodes)
    if strategy == "flat":
        return retrieval.flat(queries, docs, KEYS, k).select(*KEYS, "query_id", "node_id", "rank")
    if strategy == "graph_traversal":
        return retrieval.graph_traversal(queries, docs, nodes, edges, KEYS, k).select(*KEYS, "query_id", "node_id", "rank")
    walk = (retrieval.top_down if strategy == "top_down" else retrieval.bottom_up)(queries, docs, edges, KEYS, levels)
    once = walk.groupBy(*KEYS, "query_id", "node_id").agg(F.min(F.struct("stage", "rank")).alias("at"))
    w = F.row_number().over(retrieval.Window.partitionBy(*KEYS, "query_id").orderBy("at", "node_id"))
    return once.select(*KEYS, "query_id", "node_id", w.alias("rank"))


def related_text(queries: DataFrame, nodes: DataFrame, edges: DataFrame, strategy: str = "graph_traversal", k: int = 5, levels: tuple[int, ...] | None = None) -> DataFrame:
    """keys, query_id, context: related() as the one text that goes into a prompt."""
    return retrieval.context_text(related(queries, nodes, edges, strategy, k, levels), nodes, KEYS)


def filtered_context(rows: DataFrame, backend: str, **settings) -> DataFrame:
    """rows(context, question, ..) with the parts of the context that a provider finds relevant; its failure keeps all."""
    replied = providers.complete(rows.withColumn("prompt", answering.filter_prompt("context", "question")), "prompt", "reply", backend, **settings)
    part = F.get_json_object(T.json_object("reply"), "$.relevant_parts")
    return replied.withColumn("context", F.when(F.coalesce(part, F.lit("")) != "", part).otherwise(F.col("context"))).drop("prompt", "reply")


def offline_answer(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys, query_id, prediction: the first sentence of the best memory. Stands in for a model."""
    top = found.where("rank = 1").join(nodes.select(*KEYS, "node_id", "content"), [*KEYS, "node_id"])
    return top.select(*KEYS, "query_id", T.first_sentence("content").alias("prediction"))


def allowed(questions: DataFrame, categories: tuple[int, ...] = CATEGORIES) -> DataFrame:
    """Questions of these categories, numbered anew from 1 in each sample."""
    w = Window.partitionBy(*KEYS).orderBy("qa_idx")
    return questions.where(F.col("category").cast("int").isin(*categories)).withColumn("qa_idx", F.row_number().over(w))


def answer(spark: SparkSession, root: str, questions: DataFrame, out: str, strategy: str = "graph_traversal", k: int | None = None, backend: str | None = None, rewrite: bool = False, filter_context: bool = False, categories: tuple[int, ...] = CATEGORIES, levels: tuple[int, ...] | None = None, report: Report | None = None, **settings) -> int:
    """Answer and score questions (sample_id, qa_idx, question, category, reference) of these categories that the log `out`
    doesn't have yet, and append their records. k: memories a question is answered from; without it, by its category.
    Returns how many there were."""
    done = answered(spark, out)
    todo = written(stats.unanswered(allowed(questions, categories), done, KEYS), "job-questions")
    n = todo.count()
    if not n:
        _done("answers", 0, report)
        return 0
    nodes, edges = written(graph_store.load(spark, root, "nodes"), "job-nodes"), written(graph_store.load(spark, root, "edges"), "job-edges")
    queries = rewritten(todo.withColumn("query_id", F.col("qa_idx")), backend if rewrite else None, **settings)
    found = written(related(queries, nodes, edges, strategy, T.category_k("category") if k is None else k, levels), "job-found")
    lists = found.groupBy(*KEYS, "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("retrieved_nodes"))
    if backend is None:
        replied = queries.join(offline_answer(found, nodes), [*KEYS, "query_id"], "left")
    else:
        asked = queries.join(retrieval.context_text(found, nodes, KEYS), [*KEYS, "query_id"], "left").withColumn("context", F.coalesce("context", F.lit("")))
        replied = answering.answers(filtered_context(asked, backend, **settings) if filter_context else asked, backend, **settings)
    predicted = written(replied.select(*KEYS, "query_id", "question", "category", "reference", F.coalesce("prediction", F.lit("")).alias("prediction")).join(lists, [*KEYS, "query_id"], "left"), "job-predictions")
    model = written(embedder.fit(nodes, "content"), "job-vectors")
    scored = answering.evaluated(predicted, [*KEYS, "query_id"], model)
    names = [c for c in scored.columns if c not in (*KEYS, "query_id")]
    metric_map = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    rows = predicted.join(scored.select(*KEYS, "query_id", metric_map.alias("metrics")), [*KEYS, "query_id"])
    results.append(rows.select("sample_id", F.col("query_id").cast("int").alias("question_id_in_sample"), "question", "prediction", "reference", F.col("category").cast("string").alias("category"), "metrics", F.coalesce("retrieved_nodes", F.array().cast("array<string>")).alias("retrieved_nodes")), out, "qa_result")
    _done("answers", n, report)
    return n


def answered(spark: SparkSession, out: str) -> DataFrame:
    """The answers of a log folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/type=qa_result")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schemas.RESULT[7:-1].replace(":", " "))
    return spark.read.schema(schemas.RESULT[7:-1].replace(":", " ")).json(f"{out}/type=qa_result")


# The field names of the records `metadata`, `qa_result` and `run_summary` below, which readers of a log know.
def run_summary(answers: DataFrame, model: str, errors: int = 0, at: Column | None = None) -> DataFrame:
    """One record: model, questions, errors, questions by category, mean of every metric overall and by category, end time."""
    rows = answers.select("category", F.explode("metrics").alias("metric", "value"))
    means = rows.groupBy("category", "metric").agg(F.sum("value").alias("s"), F.count("value").alias("n"))  # a row a category and metric
    scopes = means.unionByName(means.withColumn("category", F.lit("overall"))).groupBy("category", "metric").agg((F.sum("s") / F.sum("n")).alias("mean"))
    by_scope = scopes.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "mean")))).alias("means"))
    agg = by_scope.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("category", F.lit("null")).alias("scope"), "means"))).alias("aggregate_metrics_for_this_run"))
    counts = answers.groupBy("category").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("questions_processed_in_this_run"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("category", F.lit("null")).alias("c"), "n")))).alias("category_distribution_in_this_run"))
    end = timestamp(F.current_timestamp() if at is None else at, "iso")
    # two one-row frames
    return counts.crossJoin(agg).select(F.lit(model).alias("model"), "questions_processed_in_this_run", F.lit(errors).alias("error_num_in_this_run"), "category_distribution_in_this_run", "aggregate_metrics_for_this_run", end.alias("run_end_time"))


def run(spark: SparkSession, turns: DataFrame, questions: DataFrame, root: str, out: str, strategy: str = "graph_traversal", backend: str | None = None, model: str = "offline", ratio: float = 1.0, refinement: bool = True, rewrite: bool = False, k: int | None = None, levels: tuple[int, ...] | None = None, report: Report | None = None, **settings) -> DataFrame:
    """Everything, from turns to the summary of this run's answers, which is appended to the log and returned."""
    if backend not in (None, "echo"):
        settings = {"model": model} | settings
    head = spark.createDataFrame([(model, backend or "offline", root, float(ratio), strategy)], "model string, backend string, dataset string, ratio double, retrieval_strategy string")
    results.append(head.withColumn("evaluation_start_time", timestamp(F.current_timestamp(), "iso")), out, "metadata")
    ingest_turns(spark, turns, root, backend=backend, report=report, **settings)
    build(spark, root, backend=backend, report=report, **settings)
    if refinement:
        refine(spark, root, backend=backend, report=report, **settings)
    before = written(answered(spark, out).select("sample_id", "question_id_in_sample"), "job-before")
    answer(spark, root, questions, out, strategy, k, backend, rewrite, levels=levels, report=report, **settings)
    mine = answered(spark, out).join(before, ["sample_id", "question_id_in_sample"], "left_anti")
    summary = written(run_summary(mine, model), "job-summary")
    results.append(summary, out, "run_summary")
    return summary


def graph_report(spark: SparkSession, root: str, most: int = 5) -> str:
    """The graph as text: counts, all personas, the first scenes and facts, each with its edges."""
    nodes, edges = graph_store.load(spark, root, "nodes"), graph_store.load(spark, root, "edges")
    ends = graph.degrees(edges, KEYS)
    lines = [", ".join(f"{r['level']}: {r['n']}" for r in nodes.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()), f"edges: {edges.count()}"]
    for level in ("persona", "scene", "fact"):
        rows = nodes.where(F.col("level") == level).orderBy(F.coalesce("timestamp", F.lit("")), "sample_id", "node_seq", "node_id")
        rows = rows if level == "persona" else rows.limit(most)
        shown = rows.join(ends, [*KEYS, "node_id"], "left").select("sample_id", "node_id", "timestamp", "node_seq", T.preview("content").alias("content"), F.coalesce("predecessors", F.lit("")).alias("p"), F.coalesce("successors", F.lit("")).alias("s"))
        lines.append(f"== {level}")
        for r in shown.orderBy(F.coalesce("timestamp", F.lit("")), "sample_id", "node_seq", "node_id").toLocalIterator():
            lines += [f"{r['sample_id']} {r['node_id']}: {r['content']}", f"  from: {r['p'] or '-'}", f"  to: {r['s'] or '-'}"]
    return "\n".join(lines) + "\n"
