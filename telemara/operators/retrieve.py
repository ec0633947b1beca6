"""F: chunking, lexical and TF-IDF retrieval, fusion and citation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunk_id, ordered_rules, tokenise_technical
from ..sources import scratch, settled
from .textindex import LEXICAL, SEMANTIC, TextIndex


def chunk_markdown(df: DataFrame, uri: str = "uri", text: str = "text", min_chars: int = 60) -> DataFrame:
    """sections of Markdown at headings of level 1 to 3 outside code fences, Overview before the first.

    Lines of a document are folded in its own row's window; sections below min_chars characters are dropped.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.col(uri), "/"), -1), r"\.md$", "")
    lines = df.select(F.col(uri).alias("uri"), stem.alias("stem"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "line"))
    w = Window.partitionBy("uri").orderBy("i")
    fenced = lines.withColumn("fence", F.col("line").rlike(r"^\s*```")).withColumn("open", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    head = fenced.withColumn("head", ~F.col("open") & ~F.col("fence") & F.col("line").rlike(r"^#{1,3} +\S"))
    numbered = head.withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    whole = Window.partitionBy("uri")
    h1 = F.min(F.when(F.col("head") & F.col("line").rlike("^# "), F.struct("i", "line"))).over(whole)["line"]
    named = numbered.withColumn("doc_title", F.coalesce(F.trim(F.regexp_replace(h1, "^# +", "")), F.col("stem")))
    parts = named.groupBy("uri", "stem", "doc_title", "section").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"), F.min(F.when(F.col("head"), F.col("line"))).alias("h"))
    body = F.trim(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    title = F.coalesce(F.trim(F.regexp_replace("h", "^#{1,3} +", "")), F.lit("Overview"))
    out = parts.select("uri", "stem", "doc_title", title.alias("section_title"), body.alias("content")).where(F.length("content") >= min_chars)
    return out.select(chunk_id(F.col("stem"), F.col("section_title")).alias("chunk_id"), "uri", "doc_title", "section_title", "content", F.size(F.filter(F.split("content", r"\s+"), lambda t: t != "")).alias("token_count"), F.when(F.col("uri").rlike("(^|/)runbooks?/"), "runbook").otherwise("postmortem").alias("doc_type"))


def bm25_index(chunks: DataFrame, id: str = "id", text: str = "text"):
    """postings (id, length, term, tf) and the row (n, avg_length)."""
    tokens = chunks.select(F.col(id).alias("id"), tokenise_technical(F.col(text)).alias("t"))
    postings = tokens.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    return postings, tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_length"))


def ranked(scored: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(index, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """the k best texts of each query (query_id, text); repeated query terms count again, ties by id.

    Only postings of the queries' terms are counted: Spark takes that filter below the count, to the tokens. Their
    document frequencies are all that idf needs.
    """
    postings, stats = index
    terms = queries.select("query_id", F.explode(tokenise_technical(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    idf = df.select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avg_length")
    hit = asked.join(terms.join(idf, "term"), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = hit.groupBy("query_id", "id").agg(F.round(F.sum(part), 4).alias("score")).where("score > 0")
    return ranked(scored, k)


def grams(text):
    """Word 1-grams and 2-grams of two or more letters or digits a word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def tfidf_fit(chunks: DataFrame, id: str = "id", text: str = "text"):
    """weights (id, term, raw), idf (term, idf) and lengths (id, length); raw over length is a unit vector.

    The vocabulary of words and pairs is exact. Counts are kept in the shared folder, as they are read three times.
    """
    tf = settled(chunks.select(F.col(id).alias("id"), F.explode(grams(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")))
    n = chunks.agg(F.count("*").alias("n"))
    idf = settled(tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    weights = weighed(tf, idf, "id")
    return weights, idf, lengths_of(weights, "id")


def weighed(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    return tf.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))


def lengths_of(weights: DataFrame, key: str) -> DataFrame:
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, tf) of queries (query_id, text) for F7."""
    return queries.select("query_id", F.explode(grams(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))


def search_lexical(index: TextIndex, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """F5 over a stored index; only the k best of each block of documents meet."""
    terms = queries.select("query_id", F.explode(tokenise_technical(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    found = settled(index.found(LEXICAL, terms))
    n, mean = index.stats(LEXICAL).first()  # one row
    df = found.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weights = terms.join(df.select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    scored = index.best(LEXICAL, found, weights, k, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), lambda sums, length: sums)
    return ranked(scored.withColumn("score", F.round("score", 4)).where("score > 0"), k)


def search_semantic(index: TextIndex, queries: DataFrame, k: int = 5, minimum: float = 0.0, services: DataFrame | None = None) -> DataFrame:
    """F7 over a stored index; only the k best of each block of documents meet.

    services (id, service_id): a query with a service_id finds only texts of that service.
    """
    asked = query_terms(queries)
    if services is not None:
        return cosine_topk(index.semantic(asked.select("term")), queries, k, minimum, services)
    found = settled(index.found(SEMANTIC, asked))
    idf = index.idf(found)
    q = weighed(asked, idf, "query_id")
    unit = q.join(lengths_of(q, "query_id"), "query_id").join(idf, "term")
    weights = unit.select("query_id", "term", (F.col("raw") / F.col("length") * F.col("idf")).alias("weight"))
    scored = index.best(SEMANTIC, found, weights, k, lambda tf, length: 1 + np.log(tf), lambda sums, length: sums / length)
    return ranked(scored.withColumn("score", F.round("score", 4)).where(F.col("score") > minimum), k)


def cosine_topk(index, queries: DataFrame, k: int = 5, minimum: float = 0.0, services: DataFrame | None = None) -> DataFrame:
    """the k texts nearest to each query by cosine, above `minimum`.

    Only weights of the queries' terms meet them; a text's length divides its sum at the end. With services (id,
    service_id), weights of another service than the query's never meet it.
    """
    weights, idf, lengths = index
    q = weighed(query_terms(queries), idf, "query_id")
    q = q.join(lengths_of(q, "query_id"), "query_id").select("query_id", "term", (F.col("raw") / F.col("length")).alias("q"))
    met = weights.join(q, "term") if services is None else _of_service(weights, q, queries, services)
    dots = met.groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("raw")).alias("dot"))
    scored = dots.join(lengths, "id").select("query_id", "id", F.round(F.col("dot") / F.col("length"), 4).alias("score"))
    return ranked(scored.where(F.col("score") > minimum), k)


def _of_service(weights: DataFrame, q: DataFrame, queries: DataFrame, services: DataFrame) -> DataFrame:
    """Pairs of weights and query weights of one term, and of one service where the query names one."""
    asked = q.join(queries.select("query_id", "service_id"), "query_id")
    named = weights.join(services.select("id", "service_id"), "id").join(asked.where("service_id is not null"), ["term", "service_id"])
    free = weights.join(asked.where("service_id is null"), "term")
    keep = ["query_id", "id", "q", "raw"]
    return named.select(*keep).unionByName(free.select(*keep))


def rrf_fuse(lex: DataFrame, sem: DataFrame, k: int = 60) -> DataFrame:
    """F8: reciprocal ranks of two lists added up; a text missing from one has rank 999 there."""
    a = lex.select("query_id", "id", F.col("score").alias("lexical"), F.col("rank").alias("r1"))
    b = sem.select("query_id", "id", F.col("score").alias("semantic"), F.col("rank").alias("r2"))
    j = a.join(b, ["query_id", "id"], "full")
    rank = lambda c: 1 / (k + F.coalesce(F.col(c), F.lit(999)))
    return j.select("query_id", "id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.round(rank("r1") + rank("r2"), 6).alias("rrf"))


def rerank_and_cite(fused: DataFrame, top_k: int = 5, min_relevance: float = 0.35, chunks: DataFrame | None = None, doc_type: str | None = None) -> DataFrame:
    """lexical and semantic scores weighed .45 to .55, the best top_k of each query with their citation.

    chunks (id, uri, section, doc_type) give the citation [file#chunk: section] and let doc_type choose among the
    candidates; without them a citation is [doc-id].
    """
    peak = F.greatest(F.lit(1.0), F.max("lexical").over(Window.partitionBy("query_id")))
    scored = fused.withColumn("rerank", F.round(0.45 * F.least(F.lit(1.0), F.col("lexical") / peak) + 0.55 * F.col("semantic"), 4)).where(F.col("rerank") >= min_relevance)
    cite = F.format_string("[doc-%s]", F.col("id").cast("string"))
    if chunks is not None:
        named = chunks.select("id", F.format_string("[%s#%s: %s]", F.element_at(F.split("uri", "/"), -1), F.col("id").cast("string"), F.col("section")).alias("cited"), "doc_type")
        scored = scored.join(named, "id")
        scored, cite = (scored if doc_type is None else scored.where(F.col("doc_type") == doc_type)), F.col("cited")
    w = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), F.col("rrf").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).withColumn("citation", cite).drop("cited", "doc_type")


def retrieve(chunks: DataFrame, queries: DataFrame, top_k: int = 5, min_relevance: float = 0.35, doc_type: str | None = None, candidates: int = 15) -> DataFrame:
    """F5, F7, F8 and F9 in a row: the evidence of each query (query_id, text) among chunks (id, text, uri, section, doc_type)."""
    index = TextIndex.build(chunks, scratch(chunks.sparkSession, "index"))
    lex, sem = search_lexical(index, queries, candidates), search_semantic(index, queries, candidates)
    return rerank_and_cite(rrf_fuse(lex, sem), top_k, min_relevance, chunks, doc_type)


def diagnostic_query(incidents: DataFrame, service="service_id", metric="metric", archetype="archetype") -> DataFrame:
    """the search text of an incident. The phrases that a metric's name calls for."""
    m = F.col(metric)
    has = lambda *ws: F.coalesce(F.expr(" or ".join(f"contains(`{metric}`, '{w}')" for w in ws)), F.lit(False))
    phrase = ordered_rules([(has("pool", "query_latency"), "PostgreSQL connection pool max_connections saturation"), (has("memory"), "memory leak garbage collection stop-the-world heap restart"), (has("latency", "error_rate"), "timeout circuit breaker downstream failure"), (has("checkout", "order", "revenue"), "payment gateway failure failover decline")], F.lit(None).cast("string"))
    return incidents.withColumn("query", F.concat_ws(" ", service, m, phrase, F.translate(archetype, "_", " ")))


def memory_search(entries: DataFrame, queries: DataFrame, top_k: int = 3, min_similarity: float = 0.05) -> DataFrame:
    """nearest entries with a grade: strong from .65, moderate from .35.

    Where queries have a service_id that is not null, only entries of that service count.
    """
    index = TextIndex.build(entries, scratch(entries.sparkSession, "index"), kinds=(SEMANTIC,))
    both = "service_id" in queries.columns and "service_id" in entries.columns
    top = search_semantic(index, queries, top_k, min_similarity, entries if both else None)
    return top.withColumn("grade", F.when(F.col("score") >= 0.65, "STRONG").when(F.col("score") >= 0.35, "MODERATE").otherwise("WEAK"))


def postmortem_facts(df: DataFrame, uri: str = "uri", text: str = "text") -> DataFrame:
    """title, incident id, first service named, and keyword tags of a report."""
    t = F.col(text)
    tags = [F.when(F.lower(t).contains(w), F.lit(w)) for w in ("database", "memory", "latency", "payment", "traffic", "timeout")]
    nonempty = lambda c: F.when(c != "", c)
    return df.select(F.col(uri).alias("uri"), nonempty(F.regexp_extract(t, r"(?m)^# +(.+)$", 1)).alias("title"), nonempty(F.regexp_extract(t, r"(INC-[0-9A-Za-z-]+)", 1)).alias("incident_id"), nonempty(F.regexp_extract(t, r"([a-z]+(?:-[a-z]+)*-(?:service|processing|core))", 1)).alias("service_id"), F.array_compact(F.array(*tags)).alias("tags"))


def postmortem_incidents(facts: DataFrame) -> DataFrame:
    """the facts that name an incident, as resolved incidents with their report's title and tags."""
    return facts.where("incident_id is not null").select("incident_id", F.coalesce("title", "uri").alias("title"), "service_id", F.lit("RESOLVED").alias("status"), "tags")


def nearest(own: np.ndarray, asked: np.ndarray, other: np.ndarray, rows: np.ndarray, k: int, strip: int = 256) -> pa.Table:
    """The k rows of the largest product with each asked one, itself left out; products of `strip` asked ones are held at once."""
    order = np.argsort(other, kind="stable")
    other, rows, made = other[order], rows[order].T, []
    for at in range(0, max(1, len(own)), strip):
        mine = own[at : at + strip]
        score = np.round(asked[at : at + strip] @ rows, 12)
        score[mine[:, None] == other[None, :]] = -2.0
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score, top, axis=1).ravel()
        keep = value > -2.0
        made.append(pa.table({"query_id": np.repeat(mine, top.shape[1])[keep], "id": other[top.ravel()][keep], "score": value[keep]}))
    return pa.concat_tables(made)


def vector_topk(base: DataFrame, queries: DataFrame, id: str, vec: str, k: int, block: int = 4096) -> DataFrame:
    """the k nearest vectors of each query by cosine; queries are a stated set, compared with all rows.

    Both sides are dealt to blocks, and each pair of blocks is one matrix product that keeps k rows a query; the best
    k of those remain. Vectors are of one length; null and zero vectors are left out. Ties, to twelve places, by id.
    """
    sides = [(df.where(F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0)).select(F.col(id).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v")), max(1, -(-df.count() // block))) for df in (base, queries)]
    (rows, n), (asked, m) = sides
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    left = rows.select(deal(n).alias("b"), every(m).alias("q"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select(every(n).alias("b"), deal(m).alias("q"), F.lit(True).alias("asks"), "id", "v")

    def best(t: pa.Table) -> pa.Table:
        ids, asks = t["id"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False)
        v = np.stack(t["v"].to_numpy()) if t.num_rows else np.zeros((0, 1))
        v /= np.linalg.norm(v, axis=1)[:, None]
        return nearest(ids[asks], v[asks], ids[~asks], v[~asks], k)

    found = left.unionByName(right).groupBy("b", "q").applyInArrow(best, "query_id long, id long, score double")
    return ranked(found, k)
