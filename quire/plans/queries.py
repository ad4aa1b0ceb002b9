"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per SURVEY §2 key.

Each reads the given tables (through the page views of ``sources.tables``) and runs over whole
tables and whole texts. Floats leave rounded to 6 places and arrays are exploded, so the
DuckDB oracles in ``oracles.py`` can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_ALPHA, DEFAULT_BOUNDARY_THRESHOLD, DEFAULT_THRESHOLD, SPLIT_LEVEL_MAX, SPLIT_LEVEL_MIN, SPLIT_LEVEL_STEP
from ..functions import text as T
from ..functions import vectors as V
from ..operators import cluster, links, pairs
from ..operators import documents as D
from ..operators import evaluate as E
from ..operators import segment as S
from ..operators import topics as TP
from ..operators.numbering import number_rows
from ..operators.vectorize import embed_missing, sparse_vectors, text_vectors
from ..sinks import outputs as O
from ..sources import pages as SP
from ..sources import tables
from .split import split_level

OUT = 6  # decimals of float outputs
SPLIT_LEVELS = [round(SPLIT_LEVEL_MIN + k * SPLIT_LEVEL_STEP, 1) for k in range(round((SPLIT_LEVEL_MAX - SPLIT_LEVEL_MIN) / SPLIT_LEVEL_STEP) + 1)]


def _r(c, name: str):
    return F.round(c if not isinstance(c, str) else F.col(c), OUT).alias(name)


# ---------------------------------------------------------------- P1, V1-V5
def q_page_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return tables.vector_pages(spark, sf).select("input_id", "vec_id", "page_no", "gold")


def _next_page(spark, sf):
    p = tables.vector_pages(spark, sf).select("input_id", "page_no", "embedding")
    q = p.select("input_id", (F.col("page_no") - 1).alias("page_no"), F.col("embedding").alias("next_embedding"))
    return p.join(q, ["input_id", "page_no"])


def q_l2_distance(spark, sf):
    """V1: content distance of each page to the next page of its input."""
    return _next_page(spark, sf).select("input_id", "page_no", _r(V.l2_distance("embedding", "next_embedding"), "l2"))


def q_page_distance(spark, sf):
    """V2: page distance of every page pair of an input (upper triangle)."""
    return pairs.page_pairs(tables.vector_pages(spark, sf), 1.0).select(
        "input_id", "i", "j", V.page_distance("i", "j").cast("int").alias("page_dist")
    )


def q_blended_distance(spark, sf):
    """V3 with alpha > 1 (page weight negative), every page pair."""
    return pairs.page_pairs(tables.vector_pages(spark, sf), 1.2, decimals=None).select("input_id", "i", "j", _r("dist", "dist"))


def q_cosine_similarity(spark, sf):
    """V4: cosine of each page to the mean vector of its input."""
    p = tables.vector_pages(spark, sf)
    m = V.mean_vector(p, ["input_id"], "embedding", "mean")
    return p.join(m, "input_id").select("input_id", "page_no", _r(V.cosine_similarity("embedding", "mean"), "cos"))


def q_mean_vector(spark, sf):
    """V5: mean vector per (input, gold label), exploded to cells."""
    m = V.mean_vector(tables.vector_pages(spark, sf), ["input_id", "gold"], "embedding", "mean")
    return m.select("input_id", "gold", F.posexplode("mean").alias("dim", "value")).select(
        "input_id", "gold", F.col("dim").cast("int").alias("dim"), _r("value", "value")
    )


# ---------------------------------------------------------------- J1, J2, A13
def q_page_pairs(spark, sf):
    return pairs.page_pairs(tables.vector_pages(spark, sf), DEFAULT_ALPHA, decimals=None).select("input_id", "i", "j", _r("dist", "dist"))


def q_distance_matrix(spark, sf):
    p = tables.vector_pages(spark, sf)
    m = pairs.distance_matrix(pairs.page_pairs(p, DEFAULT_ALPHA, decimals=None), p)
    return m.select("input_id", "i", "j", _r("dist", "dist"))


def q_distance_heatmap(spark, sf):
    m = pairs.weighted_matrices(tables.vector_pages(spark, sf), (1.0, 0.9))
    return pairs.distance_heatmap(m, 10, ("input_id", "alpha")).select(
        "input_id", "alpha", "bi", "bj", _r("avg_dist", "avg_dist"), _r("min_dist", "min_dist"), _r("max_dist", "max_dist"), "cells"
    )


# ---------------------------------------------------------------- A1-A4
def _cluster(linkage: str, alpha: float = DEFAULT_ALPHA, threshold: float = DEFAULT_THRESHOLD):
    def q(spark, sf):
        return cluster.cluster_pages(tables.vector_pages(spark, sf), alpha, threshold, linkage, spread=False)  # F1 inputs have 50 pages

    return q


q_cluster_average = _cluster("average")
q_cluster_complete = _cluster("complete")
q_cluster_single = _cluster("single", 0.85, 1.36)


def q_cluster_rounds(spark, sf):
    """A1 through the distributed rounds path only (the path large inputs take)."""
    from ..operators.rounds import cluster_rounds

    return cluster_rounds(tables.vector_pages(spark, sf), DEFAULT_ALPHA, DEFAULT_THRESHOLD, "average")


def q_cluster_components(spark, sf):
    """A3 through the connected-components path large inputs take."""
    from ..operators.components import single_linkage_components

    return single_linkage_components(tables.vector_pages(spark, sf), 0.85, 1.36)


def q_threshold_sweep(spark, sf):
    """A4: average-linkage labels at every split level from one merge sequence per input."""
    return cluster.threshold_sweep(tables.vector_pages(spark, sf), DEFAULT_ALPHA, SPLIT_LEVELS, "average", spread=False)


# ---------------------------------------------------------------- text pages (F2): P3-P5, S4
def _f2(spark, sf):
    """The F2 pages, numbered and stored once for all branches of a query, and their hashed-term vectors, written once as well."""
    from ..session import cut_lineage

    pages = tables.text_pages(spark, sf)
    return pages, cut_lineage(text_vectors(pages).select("input_id", "page_no", "embedding"))


def _f2_vectors(spark, sf):
    return _f2(spark, sf)[1]


def q_text_vectors(spark, sf):
    sv = sparse_vectors(tables.text_pages(spark, sf), ["input_id", "page_no"])
    return sv.select("input_id", "page_no", "cell", _r("value", "value"))


def q_embed_missing(spark, sf):
    """A store that holds every second page's text already; the others are vectorised and appended, and all pages read from it."""
    pages, store = tables.text_pages(spark, sf), _scratch(spark, "vectors")
    embed_missing(pages.where("page_no % 2 = 0"), store)
    vecs = embed_missing(pages, store)
    cells = vecs.select("input_id", "page_no", "text_hash", F.posexplode("embedding").alias("cell", "value"))
    return cells.where(F.col("value") != 0).select("input_id", "page_no", "text_hash", F.col("cell").cast("int").alias("cell"), _r("value", "value"))


def q_short_segments(spark, sf):
    p = tables.text_pages(spark, sf)
    return p.select(
        "input_id", "page_no",
        F.size(F.split("text", "\n")).cast("int").alias("segments"),
        F.size(T.long_segments("text")).cast("int").alias("kept"),
    )


def q_page_text(spark, sf):
    p = tables.raw_pages(spark, sf)
    return p.select("input_id", "page_no", "page_id", T.html_to_text("html").alias("text"))


def q_file_scan(spark, sf):
    """Page addresses in files of two kinds in one folder; the scan takes those with the accepted suffix only."""
    folder = _scratch(spark, "files")
    p = tables.table(spark, sf, "pages").select("page_id", "url")
    p.select(F.concat_ws("\t", F.col("page_id").cast("string"), "url")).write.text(folder)
    p.write.mode("append").json(folder)
    lines = SP.scan_page_files(spark, folder, (".txt",)).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line != ''")
    cells = F.split("line", "\t")
    return lines.select(cells[0].cast("long").alias("page_id"), cells[1].alias("url"))


# ---------------------------------------------------------------- S1, P2, J6, S9
def _f3_pages(spark, sf):
    return SP.explode_pages(tables.long_texts(spark, sf), tables.LINES_PER_PAGE)


def q_page_explode(spark, sf):
    return _f3_pages(spark, sf).select("input_id", "page_no", "page_name", "n_lines", F.md5("text").alias("text_md5"))


def q_name_parts(spark, sf):
    p = _f3_pages(spark, sf)
    return p.select(
        "input_id", "page_no", "page_name",
        T.file_stem("page_name").alias("stem"),
        T.text_file_name("page_name").alias("text_name"),
        T.vectors_file_name(F.concat(F.lit("doc_"), F.col("input_id"), F.lit(".pdf"))).alias("vectors_name"),
    )


def q_missing_pages(spark, sf):
    """Each input requests as many pages as its length suggests (one per 1,000 characters)."""
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("input_id"), "n_chars")
    req = d.select("input_id", F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(F.col("n_chars") / 1000.0), F.lit(1)) - 1).cast("int"))).alias("page_no"))
    return D.missing_pages(req, _f3_pages(spark, sf))


def q_missing_inputs(spark, sf):
    """Documents that have no label."""
    req = tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("input_id"))
    have = tables.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("input_id"))
    return SP.missing_inputs(req, have)


# ---------------------------------------------------------------- W1, W2
def q_boundary_detection(spark, sf):
    return S.boundary_detection(_f2_vectors(spark, sf), DEFAULT_BOUNDARY_THRESHOLD)


def q_boundary_chunked(spark, sf):
    """W1 through the chunked path large inputs take (chunks of 16 pages here)."""
    return S.boundary_chunked(_f2_vectors(spark, sf), DEFAULT_BOUNDARY_THRESHOLD, chunk=16)


def _scattered_labels(spark, sf):
    """F1 pages in vec_id order, labelled by gold: gold labels scattered with page gaps."""
    e = tables.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / tables.VECTORS_PER_INPUT).cast("string").alias("input_id"), "vec_id", F.col("label").cast("int").alias("label")
    )
    return number_rows(e, "input_id", ["vec_id"]).select("input_id", "page_no", "label")


def q_gap_split(spark, sf):
    return S.gap_split(_scattered_labels(spark, sf), 2)


def q_near_pairs(spark, sf):
    """J1 below a threshold without a band of pages (alpha 1): the F2 pages of an input whose texts are alike, by the pivot join. Copies are not
    expanded: a pair stands for all pages with the same two vectors, by the lowest page of each (``near_links`` has the members)."""
    return pairs.metric_pairs(links.copy_classes(_f2_vectors(spark, sf)), 1.0, 0.25, vec="v").select("input_id", "i", "j", _r("dist", "dist"))


def q_near_links(spark, sf):
    """J1 below a threshold as a row per page: the lowest page with the same vector, and the number of pages that are alike."""
    return links.near_links(_f2_vectors(spark, sf), 0.25)


# ---------------------------------------------------------------- documents (F2 clustered)
def _f2_labels(spark, sf):
    """The F2 pages and their labels."""
    pages, vectors = _f2(spark, sf)
    return pages, cluster.cluster_pages(vectors, DEFAULT_ALPHA, DEFAULT_THRESHOLD, "average")


def _f2_docs(spark, sf, first=False):
    """Labels, documents and the texts of their pages; with ``first`` of each document's first page only."""
    from ..session import cut_lineage

    pages, labels = _f2_labels(spark, sf)
    labels = cut_lineage(labels)  # written once, read by every branch below
    docs = D.documents_from_labels(labels)
    doc_pages = D.document_pages(labels, docs)
    doc_text = D.page_texts(D.first_pages(doc_pages) if first else doc_pages, pages)
    return labels, docs, doc_text


def q_documents_from_labels(spark, sf):
    _, docs, _ = _f2_docs(spark, sf)
    return docs.select("input_id", "document_no", "document_id", "topic_name", "page_start", "page_end", "n_pages")


def q_renumber_documents(spark, sf):
    labels = cluster.cluster_pages(tables.vector_pages(spark, sf), DEFAULT_ALPHA, DEFAULT_THRESHOLD, "complete", spread=False)
    return D.documents_from_labels(labels).select("input_id", "document_no", "page_start")


def q_label_pages(spark, sf):
    p = tables.vector_pages(spark, sf)
    labels = cluster.cluster_pages(p, DEFAULT_ALPHA, DEFAULT_THRESHOLD, "complete", spread=False)
    return labels.join(p.select("input_id", "page_no", "gold"), ["input_id", "page_no"])


def q_document_text(spark, sf):
    _, _, doc_text = _f2_docs(spark, sf)
    return doc_text.select("input_id", "document_no", "page_no", F.md5("text").alias("text_md5"))


def q_first_page_text(spark, sf):
    _, _, doc_text = _f2_docs(spark, sf, first=True)
    return D.first_page_text(doc_text).select("input_id", "document_no", F.md5("text").alias("text_md5"))


def q_sample_pages(spark, sf):
    _, _, doc_text = _f2_docs(spark, sf)
    return D.sample_pages(doc_text).select("input_id", "document_no", "n_sampled", F.md5("text").alias("text_md5"))


def q_concat_pages(spark, sf):
    c = D.concat_in_order(tables.text_pages(spark, sf), ["input_id", "gold"], " ")
    return c.select("input_id", "gold", F.length("text").cast("int").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_reassemble_documents(spark, sf):
    _, _, doc_text = _f2_docs(spark, sf)
    return D.reassemble(doc_text).select("input_id", "document_no", F.length("text").cast("int").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_document_topics(spark, sf):
    _, _, doc_text = _f2_docs(spark, sf, first=True)
    return TP.tfidf_topics(D.first_page_text(doc_text))


def _named_docs(spark, sf, strategy="first_page"):
    _, docs, doc_text = _f2_docs(spark, sf, first=strategy == "first_page")
    return TP.assign_topics(docs, doc_text, strategy)


def q_assign_topics(spark, sf):
    return _named_docs(spark, sf).select("input_id", "document_no", "topic_name")


def q_split_documents(spark, sf):
    """Flagship: named documents of every F2 input."""
    return _named_docs(spark, sf).select("input_id", "document_no", "document_id", "topic_name", "page_start", "page_end", "n_pages")


def q_output_manifest(spark, sf):
    return O.output_names(_named_docs(spark, sf)).select("input_id", "name", "position")


def q_split_summary(spark, sf):
    return D.split_summary(_named_docs(spark, sf))


def q_split_levels(spark, sf):
    """Page labels at every level of the user's scale (average linkage, text vectors)."""
    return cluster.threshold_sweep(_f2_vectors(spark, sf), DEFAULT_ALPHA, [split_level(x) for x in SPLIT_LEVELS], "average")


# ---------------------------------------------------------------- evaluation
def q_gold_labels(spark, sf):
    """Each label's range reaches two pages into the next one's, and label 2 has no range."""
    p = tables.vector_pages(spark, sf)
    ranges = E.runs_as_ranges(p).where("gold != 2").withColumn("page_end", F.col("page_end") + 2)
    return E.gold_from_ranges(p, ranges)


def _f2_contingency(spark, sf):
    from ..session import cut_lineage

    pages, labels = _f2_labels(spark, sf)
    return cut_lineage(E.contingency(labels, pages.select("input_id", "page_no", "gold"), ["input_id"]))


def q_contingency(spark, sf):
    return _f2_contingency(spark, sf)


def q_adjusted_rand(spark, sf):
    cont = _f2_contingency(spark, sf)
    return E.adjusted_rand(cont, ["input_id"]).select("input_id", _r("ari", "ari"))


def q_nmi(spark, sf):
    cont = _f2_contingency(spark, sf)
    return E.nmi(cont, ["input_id"]).select("input_id", _r("nmi", "nmi"))


def q_param_grid(spark, sf):
    """The grid for every F2 input with the page band each setting allows (None = all pairs).
    The 396 grid points are a literal array exploded per input (a generator, no join)."""
    from ..constants import ALPHA_GRID, LINKAGE_GRID, THRESHOLD_GRID

    n = tables.text_pages(spark, sf).groupBy("input_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    points = []
    for ia, a in enumerate(ALPHA_GRID):
        for it, t in enumerate(THRESHOLD_GRID):
            for il, lk in enumerate(LINKAGE_GRID):
                pos = ia * len(THRESHOLD_GRID) * len(LINKAGE_GRID) + it * len(LINKAGE_GRID) + il
                points.append(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(t)).alias("threshold"), F.lit(lk).alias("linkage"), F.lit(pos).alias("grid_pos")))
    g = n.select("input_id", "n_pages", F.explode(F.array(*points)).alias("g")).select("input_id", "n_pages", "g.*")
    band = F.when(F.col("alpha") < 1.0, F.least(F.ceil(F.col("threshold") / (1.0 - F.col("alpha"))), F.col("n_pages")).cast("int"))
    return g.select("input_id", "n_pages", "alpha", "threshold", "linkage", "grid_pos", band.alias("band_pages"))


def _search(spark, sf):
    pages, vectors = _f2(spark, sf)
    return E.grid_search(vectors, pages.select("input_id", "page_no", "gold"))


def q_grid_search(spark, sf):
    return _search(spark, sf).select("input_id", "alpha", "threshold", "linkage", "grid_pos", _r("ari", "ari"), _r("nmi", "nmi"))


def q_best_params(spark, sf):
    b = E.best_params(_search(spark, sf))
    return b.select("input_id", "alpha", "threshold", "linkage", _r("ari", "ari"), _r("nmi", "nmi"))


# ---------------------------------------------------------------- S3, S6, R1/S8, R2 (side effects
# go to a fresh folder under the session's checkpoint folder; results are read back)
def _scratch(spark, name: str) -> str:
    import uuid

    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def q_text_scan(spark, sf):
    """S3: F3 pages staged as a text file each, scanned back whole."""
    root = _scratch(spark, "texts")
    SP.stage_page_texts(_f3_pages(spark, sf), root)
    got = SP.scan_page_texts(spark, root)
    return got.select(F.regexp_replace("input_stem", "^doc_", "").alias("input_id"), "page_no", F.md5("text").alias("text_md5"))


def q_write_documents(spark, sf):
    """S5 + S6: F2 documents written over those of a first run that made every page a document, and read back."""
    out = _scratch(spark, "documents")
    pages = tables.text_pages(spark, sf)
    each = pages.select("input_id", F.col("page_no").alias("document_no"), "page_no", "text")
    O.write_documents(each, each.select("input_id", "document_no", F.lit("page").alias("topic_name")), out)
    _, docs, doc_text = _f2_docs(spark, sf)
    O.write_documents(doc_text, TP.assign_topics(docs, doc_text), out)
    return O.read_documents(spark, out).select("input_id", "document_no", "page_no", "name", F.md5("text").alias("text_md5"))


def q_stream_intake(spark, sf):
    """F2 pages arrive as text in several files, each input's pages in all of them; every micro-batch runs the whole
    split of the inputs it touches again, from text to outputs."""
    from ..streaming.intake import start_intake

    intake, out, ck = _scratch(spark, "intake"), _scratch(spark, "intake-out"), _scratch(spark, "intake-ck")
    pages = tables.text_pages(spark, sf).select("input_id", "page_no", "text")
    pages.repartition(2, "page_no").write.parquet(intake)
    start_intake(spark, intake, pages.schema, out, ck, max_files_per_trigger=1).awaitTermination()
    schema = "document_no int, document_id string, topic_name string, page_start int, page_end int, n_pages int, input_id string"
    docs = spark.read.schema(schema).parquet(f"{out}/documents")
    bodies = O.read_documents(spark, f"{out}/outputs").groupBy("input_id", "document_no").agg(F.count("*").cast("int").alias("n_written"))
    return docs.join(bodies, ["input_id", "document_no"]).select("input_id", "document_no", "document_id", "topic_name", "page_start", "page_end", "n_pages", "n_written")


def q_stream_boundaries(spark, sf):
    """R2: F2 page vectors arrive out of order in several files; the stateful stream must give
    the batch boundary labels."""
    from ..streaming.online import STATE_STORE, online_boundaries

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    src, out, ck = _scratch(spark, "online"), _scratch(spark, "online-out"), _scratch(spark, "online-ck")
    v = _f2_vectors(spark, sf).select("input_id", "page_no", "embedding")
    # pages of one input land in different files: partition by a hash of the page, not the input
    v.repartition(4, F.col("page_no")).write.parquet(src)
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (
        online_boundaries(stream, DEFAULT_BOUNDARY_THRESHOLD)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    back = spark.read.parquet(out)
    return back.where(F.col("status") == "ok").select("input_id", "page_no", "label")


def registry() -> dict:
    return {
        "page_numbering": q_page_numbering,
        "l2_distance": q_l2_distance,
        "page_distance": q_page_distance,
        "blended_distance": q_blended_distance,
        "cosine_similarity": q_cosine_similarity,
        "mean_vector": q_mean_vector,
        "page_pairs": q_page_pairs,
        "near_pairs": q_near_pairs,
        "near_links": q_near_links,
        "distance_matrix": q_distance_matrix,
        "distance_heatmap": q_distance_heatmap,
        "cluster_average": q_cluster_average,
        "cluster_complete": q_cluster_complete,
        "cluster_single": q_cluster_single,
        "cluster_rounds": q_cluster_rounds,
        "cluster_components": q_cluster_components,
        "threshold_sweep": q_threshold_sweep,
        "text_vectors": q_text_vectors,
        "embed_missing": q_embed_missing,
        "short_segments": q_short_segments,
        "page_text": q_page_text,
        "file_scan": q_file_scan,
        "page_explode": q_page_explode,
        "name_parts": q_name_parts,
        "missing_pages": q_missing_pages,
        "missing_inputs": q_missing_inputs,
        "boundary_detection": q_boundary_detection,
        "boundary_chunked": q_boundary_chunked,
        "gap_split": q_gap_split,
        "documents_from_labels": q_documents_from_labels,
        "renumber_documents": q_renumber_documents,
        "label_pages": q_label_pages,
        "document_text": q_document_text,
        "first_page_text": q_first_page_text,
        "sample_pages": q_sample_pages,
        "concat_pages": q_concat_pages,
        "reassemble_documents": q_reassemble_documents,
        "document_topics": q_document_topics,
        "assign_topics": q_assign_topics,
        "output_manifest": q_output_manifest,
        "split_summary": q_split_summary,
        "split_levels": q_split_levels,
        "gold_labels": q_gold_labels,
        "contingency": q_contingency,
        "adjusted_rand": q_adjusted_rand,
        "nmi": q_nmi,
        "param_grid": q_param_grid,
        "grid_search": q_grid_search,
        "best_params": q_best_params,
        "split_documents": q_split_documents,
        "text_scan": q_text_scan,
        "write_documents": q_write_documents,
        "stream_intake": q_stream_intake,
        "stream_boundaries": q_stream_boundaries,
    }
