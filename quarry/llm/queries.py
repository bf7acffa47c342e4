"""The queries op1 to op13: digest columns over the operators' outputs, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, embeddings, html, kmeans, language, linededup, lm, mix, quality, shard, simhash, spelling, topk
from quarry.llm.common import arrow_rows, materialize
from quarry.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and components of links at two bits or fewer, for every document."""
    with arrow_rows(spark, 500):
        found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the chunks that earlier documents have too."""
    got = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words, occurring items and the contamination mark, for every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with arrow_rows(spark, 500):
        found = materialize(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes; grown_shard belongs to another law."""
    docs = table(spark, sf_dir, "documents")
    return shard.shard(docs, 40).select(
        "doc_id",
        "size",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    with arrow_rows(spark, 500):
        return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components at cosine 0.98 within labels, for every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the field fitted on labelled ones, those of remainder 0 held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with arrow_rows(spark, 500):
        field = quality.train(docs, table(spark, sf_dir, "labels"))
        found = materialize(quality.scored(docs, field).select("doc_id", "quality_score"))
    return found.select(
        "doc_id",
        F.coalesce(quality.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by the base and by the tree, those of remainder 0 held out."""
    with arrow_rows(spark, 500):
        return materialize(lm.score(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, those of remainder 1 held out."""
    docs = table(spark, sf_dir, "documents")
    with arrow_rows(spark, 500):
        model = language.train(docs)
        found = materialize(language.identified(docs.select("doc_id", "text"), model).drop("text"))
    return found.select(
        "doc_id",
        F.coalesce(quality.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    got = mix.copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words, its form and the root that forms lead to."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20, against all rows."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in one of 16 clusters after three rounds."""
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_shard": op4_shard,
    "op5_html": op5_html,
    "op6_embeddings": op6_embeddings,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_language": op9_language,
    "op10_mix": op10_mix,
    "op11_spelling": op11_spelling,
    "op12_topk": op12_topk,
    "op13_kmeans": op13_kmeans,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)


def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assigning all vectors to all centroids, then moving these, one common table each."""
    parts = [
        """v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, e) - 1 AS c, e FROM v
             ORDER BY c LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT rid, vec_id, e, c, d FROM (SELECT v.*, c, list_sum(list_transform(range(1, 65), lambda i:
            (v.e[i] - c{r}.e[i]) * (v.e[i] - c{r}.e[i])))::BIGINT AS d FROM v, c{r})
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        parts.append(f"""m{r} AS (SELECT c, list(x ORDER BY i) AS e FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT
            AS x FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{r}) GROUP BY c, i) GROUP BY c)""")
        parts.append(f"c{r + 1} AS (SELECT c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (c))")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} USING (c)"""


ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
               FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
        words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
        FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
    "op6_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT x AS n, x AS r FROM link UNION SELECT link.y, reach.r FROM reach JOIN link ON reach.n = link.x),
        least AS (SELECT n, min(r) AS r FROM reach GROUP BY n),
        degree AS (SELECT x, count(*) AS k FROM link GROUP BY x)
        SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON vec_id = n LEFT JOIN degree ON vec_id = x""",
    # these pages have one article each, of h1 and p elements with b and br in them
    "op5_html": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's') AS h FROM pages),
        s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '</?(?:p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)) AS x FROM a),
        b AS (SELECT page_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM s),
        c AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
                     '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b),
        d AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY page_id)
        SELECT p.page_id, p.url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages p LEFT JOIN d USING (page_id)""",
    "op11_spelling": r"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
                     CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
        low AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
        bytes AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
                    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM low),
        hashed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
                   FROM bytes, crc),
        words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k
                  FROM hashed),
        v AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        cut AS (SELECT DISTINCT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z
                FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        close AS (SELECT x.word, y.word AS near, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
                  UNION SELECT v.word, c.word, c.n FROM v JOIN cut c ON v.word = c.a || c.z
                  UNION SELECT c.word, v.word, v.n FROM v JOIN cut c ON v.word = c.a || c.z),
        best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM close GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * v.n THEN best.m END AS form_n,
                     CASE WHEN best.m >= 5 * v.n THEN (SELECT min(near) FROM close c WHERE c.word = v.word AND c.m = best.m) END AS form
              FROM v LEFT JOIN best USING (word)),
        chain AS (WITH RECURSIVE r AS (SELECT word, word AS here, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.form = f.word)
                  SELECT word, here AS root FROM r WHERE form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN chain USING (word)""",
    "op12_topk": """
        WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, coalesce(list_inner_product(q.e[:len(c.e)], c.e[:len(q.e)]), 0)::BIGINT AS score
              FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_kmeans": _kmeans_sql(),
}
