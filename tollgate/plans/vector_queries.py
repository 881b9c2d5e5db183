"""Retrieval, MaxSim and classification over vectors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollgate.functions.vectors import cosine, dot, mean_vectors, norm
from tollgate.operators import similarity
from tollgate.operators.embedding import classify_texts
from tollgate.operators.zero_shot import classify_captions
from tollgate.plans import views
from tollgate.plans.catalog import query, view

# --- vectors -------------------------------------------------------------------------------

view(
    "label_means",
    """SELECT label, list(x ORDER BY p) AS vector FROM
         (SELECT label, p, avg(x) AS x FROM
           (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
          GROUP BY label, p) GROUP BY label""",
)


def vectors(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings")


def label_means(spark, sf_dir):
    """One mean vector per label, over the whole table."""
    return mean_vectors(vectors(spark, sf_dir), ["label"], "embedding")


@query(
    "vec_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
         round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
         round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vec_cosine(spark, sf_dir):
    """Each vector with the one of the next id."""
    here = vectors(spark, sf_dir)
    following = here.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pair = here.join(following, "vec_id")
    a, b = F.col("embedding"), F.col("other")
    return pair.select(
        "vec_id",
        F.round(cosine(a, b), 6).alias("cosine"),
        F.round(dot(a, b), 6).alias("dot"),
        F.round(norm(a), 6).alias("norm"),
    )


@query(
    "retrieve_topk",
    """SELECT query_id, id, rank::INTEGER AS rank, score FROM (
         SELECT l.label AS query_id, e.vec_id AS id,
           round(list_dot_product(e.embedding::DOUBLE[], l.vector) / sqrt(list_dot_product(l.vector, l.vector)), 6) AS score,
           row_number() OVER (PARTITION BY l.label ORDER BY
             list_dot_product(e.embedding::DOUBLE[], l.vector) / sqrt(list_dot_product(l.vector, l.vector)) DESC, e.vec_id) AS rank
         FROM label_means l, embeddings e) WHERE rank <= 5""",
    "label_means",
)
def retrieve_topk(spark, sf_dir):
    """The five nearest vectors to the mean of each label."""
    asked = label_means(spark, sf_dir).withColumnRenamed("label", "query_id")
    found = similarity.top_k(asked, vectors(spark, sf_dir).withColumnRenamed("vec_id", "id"), 5)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


view(
    "overall_mean",
    """SELECT list(x ORDER BY p) AS vector FROM (SELECT p, avg(x) AS x FROM
         (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY p)""",
)


@query(
    "retrieve_single",
    """SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], vector) / sqrt(list_dot_product(vector, vector)), 6) AS score
       FROM embeddings, overall_mean
       ORDER BY list_dot_product(embedding::DOUBLE[], vector) / sqrt(list_dot_product(vector, vector)) DESC, vec_id LIMIT 10""",
    "overall_mean",
)
def retrieve_single(spark, sf_dir):
    """The ten vectors nearest to the mean of all."""
    df = vectors(spark, sf_dir)
    asked = mean_vectors(df.withColumn("all", F.lit(1)), ["all"], "embedding").first()
    found = similarity.nearest(df.withColumnRenamed("vec_id", "id"), asked["vector"] if asked else [0.0], 10)
    return found.select("id", F.round("score", 6).alias("score"))


# --- MaxSim: documents are groups of ten token vectors ----------------------------------------

view("doc_tokens", "SELECT vec_id // 10 AS doc_id, vec_id % 10 AS token_no, embedding::DOUBLE[] AS vector FROM embeddings")
view("query_tokens", "SELECT (label // 5)::BIGINT AS query_id, label AS token_no, vector FROM label_means", "label_means")
view(
    "token_maxima",
    """SELECT q.query_id, d.doc_id, q.token_no, max(list_cosine_similarity(q.vector, d.vector)) AS best
       FROM query_tokens q, doc_tokens d GROUP BY 1, 2, 3""",
    "query_tokens doc_tokens",
)


def doc_tokens(spark, sf_dir, name="doc_id"):
    return vectors(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 10).alias(name),
        (F.col("vec_id") % 10).alias("token_no"),
        F.col("embedding").alias("vector"),
    )


def query_tokens(spark, sf_dir):
    return label_means(spark, sf_dir).select(
        F.floor(F.col("label") / 5).alias("query_id"), F.col("label").alias("token_no"), "vector"
    )


def _maxsim(spark, sf_dir, agg):
    scores = similarity.maxsim(query_tokens(spark, sf_dir), doc_tokens(spark, sf_dir), agg)
    return scores.withColumn("score", F.round("score", 6))


@query(
    "maxsim_scores",
    "SELECT query_id, doc_id, round(avg(best), 6) AS score FROM token_maxima GROUP BY 1, 2",
    "token_maxima",
)
def maxsim_scores(spark, sf_dir):
    return _maxsim(spark, sf_dir, "mean")


@query(
    "maxsim_sum",
    "SELECT query_id, doc_id, round(sum(best), 6) AS score FROM token_maxima GROUP BY 1, 2",
    "token_maxima",
)
def maxsim_sum(spark, sf_dir):
    return _maxsim(spark, sf_dir, "sum")


view(
    "doc_means",
    """SELECT doc_id, list(x ORDER BY p) AS vector FROM (SELECT doc_id, p, avg(x) AS x FROM
         (SELECT doc_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM doc_tokens) GROUP BY 1, 2) GROUP BY 1""",
    "doc_tokens",
)
view(
    "query_means",
    """SELECT query_id, list(x ORDER BY p) AS vector FROM (SELECT query_id, p, avg(x) AS x FROM
         (SELECT query_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM query_tokens) GROUP BY 1, 2) GROUP BY 1""",
    "query_tokens",
)


@query(
    "maxsim_rerank",
    """SELECT query_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id))::INTEGER AS rank
       FROM (SELECT c.query_id, c.doc_id, avg(t.best) AS score FROM
         (SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY
             list_cosine_similarity(q.vector, d.vector) DESC, d.doc_id) AS place FROM query_means q, doc_means d) c
         JOIN token_maxima t ON t.query_id = c.query_id AND t.doc_id = c.doc_id WHERE c.place <= 10 GROUP BY 1, 2)""",
    "query_means doc_means token_maxima",
)
def maxsim_rerank(spark, sf_dir):
    """Ten candidates per query by mean vector, put in MaxSim order."""
    found = similarity.rerank(query_tokens(spark, sf_dir), doc_tokens(spark, sf_dir), 10, decimals=6)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "maxsim_topk",
    """SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM
         (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank
          FROM (SELECT query_id, doc_id, avg(best) AS score FROM token_maxima GROUP BY 1, 2)) WHERE rank <= 10""",
    "token_maxima",
)
def maxsim_topk(spark, sf_dir):
    """The ten documents of largest MaxSim per query, without scoring those that cannot be among them."""
    found = similarity.maxsim_top(query_tokens(spark, sf_dir), doc_tokens(spark, sf_dir), 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# --- nearest class -----------------------------------------------------------------------------

view(
    "example_tokens",
    """SELECT label AS class, example_no, token_no, list(x ORDER BY p) AS vector FROM
         (SELECT label, vec_id % 2 AS example_no, vec_id // 2 % 2 AS token_no, p, avg(x) AS x FROM
           (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
          GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
)
view(
    "class_scores",
    """SELECT doc_id AS text_id, class, max(score) AS score FROM
         (SELECT doc_id, class, example_no, avg(best) AS score FROM
           (SELECT d.doc_id, d.token_no, e.class, e.example_no, max(list_cosine_similarity(d.vector, e.vector)) AS best
            FROM doc_tokens d, example_tokens e GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "doc_tokens example_tokens",
)


def vector_class_scores(spark, sf_dir):
    marked = vectors(spark, sf_dir).select(
        F.col("label").alias("class"),
        F.col("label").alias("class_no"),
        (F.col("vec_id") % 2).cast("int").alias("example_no"),
        (F.floor(F.col("vec_id") / 2) % 2).alias("token_no"),
        "embedding",
    )
    examples = mean_vectors(marked, ["class", "class_no", "example_no", "token_no"], "embedding")
    return similarity.class_scores(doc_tokens(spark, sf_dir, "text_id"), examples)


@query(
    "maxsim_classify",
    """SELECT text_id, arg_max(class, score) AS predicted_class, round(max(score), 6) AS confidence FROM class_scores GROUP BY 1""",
    "class_scores",
)
def maxsim_classify(spark, sf_dir):
    found = similarity.predicted(vector_class_scores(spark, sf_dir))
    return found.select("text_id", "predicted_class", F.round("confidence", 6).alias("confidence"))


@query(
    "class_score_map",
    "SELECT text_id, class::VARCHAR AS class, round(score, 6) AS score FROM class_scores",
    "class_scores",
)
def class_score_map(spark, sf_dir):
    found = similarity.predicted(vector_class_scores(spark, sf_dir))
    rows = found.select("text_id", F.explode("class_scores").alias("class", "score"))
    return rows.withColumn("score", F.round("score", 6))


# --- texts ---------------------------------------------------------------------------------------

view(
    "example_words",
    """SELECT class_no, class, example_no, lower(w) AS word FROM (VALUES
         (0, 'Class 1: PII', 0, 'SSN: 123-45-6789'), (0, 'Class 1: PII', 1, 'Credit card: 4111-1111-1111-1111'),
         (1, 'Class 2: Confidential', 0, 'Project codename: Phoenix'), (1, 'Class 2: Confidential', 1, 'Internal memo'),
         (2, 'Class 3: Internal', 0, 'Meeting notes'), (2, 'Class 3: Internal', 1, 'Draft document'),
         (3, 'Class 4: Public', 0, 'Press release'), (3, 'Class 4: Public', 1, 'Public blog post'))
         v(class_no, class, example_no, phrase), unnest(string_split(phrase, ' ')) t(w)""",
)
view(
    "text_words",
    """SELECT id, w AS word, count(*) AS n FROM (SELECT doc_id AS id, text FROM documents),
         unnest(string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) t(w)
       WHERE w <> '' GROUP BY 1, 2""",
)
view(
    "word_grams",
    """SELECT word, (unicode(c[i]) * 961 + unicode(c[i + 1]) * 31 + unicode(c[i + 2])) % 64 AS dim, count(*)::DOUBLE AS x
       FROM (SELECT word, c, unnest(range(1, len(c) - 1)) AS i FROM
         (SELECT word, string_split(' ' || word || ' ', '') AS c FROM
           (SELECT word FROM text_words UNION SELECT word FROM example_words))) GROUP BY 1, 2""",
    "text_words example_words",
)
view(
    "word_best",
    """SELECT t.word, e.class_no, e.class, e.example_no, max(coalesce(s.dot, 0)) AS best
       FROM (SELECT DISTINCT word FROM text_words) t, example_words e LEFT JOIN
         (SELECT a.word AS tw, b.word AS ew, sum(a.x * b.x) / (any_value(na.len) * any_value(nb.len)) AS dot
          FROM word_grams a JOIN word_grams b ON a.dim = b.dim
          JOIN (SELECT word, sqrt(sum(x * x)) AS len FROM word_grams GROUP BY 1) na ON na.word = a.word
          JOIN (SELECT word, sqrt(sum(x * x)) AS len FROM word_grams GROUP BY 1) nb ON nb.word = b.word
          WHERE b.word IN (SELECT word FROM example_words) GROUP BY 1, 2) s ON s.tw = t.word AND s.ew = e.word
       GROUP BY 1, 2, 3, 4""",
    "text_words example_words word_grams",
)
view(
    "text_scores",
    """SELECT id, class_no, class, max(score) AS score FROM (SELECT w.id, b.class_no, b.class, b.example_no, sum(w.n * b.best) / sum(w.n) AS score
       FROM text_words w JOIN word_best b ON b.word = w.word GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    "text_words word_best",
)


@query(
    "classify_sensitivity",
    """SELECT d.doc_id, coalesce(s.predicted_class, 'Class 5: Unknown') AS predicted_class, coalesce(s.confidence, 0.0) AS confidence
       FROM documents d LEFT JOIN (SELECT id, arg_max(class, round(score, 9) - class_no * 1e-12) AS predicted_class,
         round(max(score), 6) AS confidence FROM text_scores GROUP BY 1) s ON s.id = d.doc_id""",
    "text_scores",
)
def classify_sensitivity(spark, sf_dir):
    """Sensitivity class of every whole document text."""
    docs = views.documents(spark, sf_dir).select("doc_id", "text")
    found = classify_texts(docs, "text", "result")
    return found.select(
        "doc_id",
        F.col("result.predicted_class").alias("predicted_class"),
        F.round("result.confidence", 6).alias("confidence"),
    )


# --- captions over supplied vectors ----------------------------------------------------------------

view(
    "caption_scores",
    """SELECT i.doc_id AS image_id, c.token_no AS caption_no, 100 * list_cosine_similarity(i.vector, c.vector) AS score
       FROM doc_tokens i JOIN doc_tokens c ON c.doc_id = i.doc_id AND c.token_no > 0 WHERE i.token_no = 0""",
    "doc_tokens",
)


@query(
    "caption_softmax",
    """SELECT image_id, arg_max(caption_no, score) - 1 AS best_caption_index,
         round(exp(max(score) - any_value(top)) / sum(exp(score - top)), 6) AS confidence, count(*) AS captions
       FROM (SELECT *, max(score) OVER (PARTITION BY image_id) AS top FROM caption_scores) GROUP BY 1""",
    "caption_scores",
)
def caption_softmax(spark, sf_dir):
    """The first vector of ten is the image, the others are its captions."""
    rows = doc_tokens(spark, sf_dir, "image_id")
    # ten rows per image by construction of the id
    images = rows.groupBy("image_id").agg(
        F.max_by("vector", F.when(F.col("token_no") == 0, 1)).alias("image"),
        F.array_sort(F.collect_list(F.when(F.col("token_no") > 0, F.struct("token_no", "vector")))).alias("captions"),
    )
    best = classify_captions(F.col("image"), F.transform("captions", lambda c: c["vector"]))
    return images.select(
        "image_id",
        best["index"].cast("long").alias("best_caption_index"),
        F.round(best["score"], 6).alias("confidence"),
        F.size("captions").cast("long").alias("captions"),
    )
