"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from velas.llm import (class_lm, decontaminate, exact_dedup, jaccard_join, language_id, lexical_search, minhash, mixing,
                       sharding, span_dedup, spelling, toxicity, url_filter)
from velas.llm.common import fold, read_table, text_or_empty

#: Rules of the URL query (fixed values).
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]

#: Shards of the placement query and the pipeline's last stage.
SHARDS = [f"shard-{i:02d}" for i in range(16)]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), digest="all")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    model = language_id.fit(docs, ~F.col("held_out"))
    return language_id.predict(docs, model, extra=["held_out"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, SHARDS)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan_documents(docs, read_table(spark, sf_dir, "benchmark"), with_spans=False)
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("p_block")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = (read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
            .withColumn("held_out", fold(F.col("doc_id"), 5) == 1))
    model, unlisted = class_lm.fit(docs.where("not held_out").select("text"))
    return class_lm.score(docs, model, unlisted)


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.span_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs, size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs, thin=spelling.drop_letter)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, read_table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=4, percent=80)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_language_id, op3_sharding, op4_decontaminate, op5_mixing, op6_url_filter, op7_toxicity,
    op8_class_lm, op9_span_dedup, op10_jaccard_join, op11_spelling, op12_lexical_search, op13_minhash)}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op4_decontaminate": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
                     regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
               FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
               FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
        hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
                FROM hit GROUP BY r)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
               sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r""",
    "op9_span_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
              FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        m AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g),
        gone AS (SELECT DISTINCT r, p FROM (
                   SELECT g.r, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m ON g.g = m.g
                   WHERE m.first_doc < g.doc_id)),
        kept AS (SELECT t.r, string_agg(t.word, ' ' ORDER BY t.p) AS words, count(*) AS n
                 FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t
                 LEFT JOIN gone ON t.r = gone.r AND t.p = gone.p WHERE gone.p IS NULL GROUP BY t.r)
        SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed,
               sha256(coalesce(kept.words, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.r = kept.r""",
    "op10_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g
              FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        shared AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
        link AS (SELECT x, y FROM shared JOIN n a ON x = a.r JOIN n b ON y = b.r
                 WHERE 100 * k >= 85 * (a.n + b.n - k)),
        both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
               (SELECT min(e.doc_id) FROM reach JOIN d e ON e.r = reach.y WHERE reach.x = d.r) AS component_id
        FROM d LEFT JOIN n ON d.r = n.r""",
    "op5_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS sz, row_number() OVER (ORDER BY source NULLS LAST) AS k
              FROM d GROUP BY source),
        w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt FROM s),
        -- the share per unit of weight: sources at their stop leave, the excess is shared again
        fill AS (
          SELECT 0 AS step, (SELECT 1.5::DOUBLE * sum(sz)::DOUBLE / sum(CASE WHEN sz > 0 THEN wt END)::DOUBLE FROM w) AS share
          UNION ALL
          SELECT step + 1, (SELECT (1.5::DOUBLE * sum(sz)::DOUBLE - coalesce(sum(CASE WHEN fill.share * wt > 2 * sz THEN 2 * sz END), 0)::DOUBLE)
                              / sum(CASE WHEN fill.share * wt <= 2 * sz THEN wt END)::DOUBLE FROM w)
          FROM fill WHERE step < 60 AND fill.share IS NOT NULL),
        last AS (SELECT share FROM fill ORDER BY step DESC LIMIT 1),
        t AS (SELECT source, sz, CASE WHEN sz = 0 OR share * wt > 2 * sz THEN (2 * sz)::DOUBLE ELSE share * wt END AS target
              FROM w, last),
        o AS (SELECT d.doc_id, d.size, t.sz, t.target,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, sz AS source_size, target,
               (size * (CASE WHEN size > 0 AND before + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END
                      + CASE WHEN size > 0 AND before + sz + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM o""",
    "op11_spelling": rf"""
        WITH RECURSIVE b AS (SELECT range(0, 256) AS r),
        -- the table of crc32, a byte at a time: eight shifts, each folding in the polynomial where a one falls out
        crc AS (SELECT list_transform(r, lambda x: list_reduce([x] || range(0, 8),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t FROM b),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(
                     translate(coalesce(text, ''), {_LOWER}), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
        kept AS (SELECT k, w, count(*) AS c FROM runs GROUP BY k, w),
        hashed AS (SELECT w, c, xor(list_reduce([4294967295] || flatten(list_transform(string_split(k || ':' || w, ''),
                       lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                                 ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)),
                       lambda a, y: xor(crc.t[(xor(a, y) & 255) + 1], a >> 8)), 4294967295) AS h FROM kept, crc),
        changed AS (SELECT c, CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2)
                                   ELSE w END AS word FROM hashed),
        v AS (SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS s
                FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (SELECT DISTINCT word, n, other, m FROM (
                   SELECT a.word, a.n, z.word AS other, z.n AS m FROM cut a JOIN cut z ON a.s = z.s AND a.i = z.i
                     AND length(a.word) = length(z.word) AND a.word <> z.word
                   UNION ALL SELECT a.word, a.n, z.word, z.n FROM cut a JOIN v z ON a.s = z.word
                   UNION ALL SELECT z.word, z.n, a.word, a.n FROM cut a JOIN v z ON a.s = z.word)),
        best AS (SELECT word, n, count(*) AS n_near, max(m) AS top FROM near GROUP BY word, n),
        form AS (SELECT b.word, b.n_near, CASE WHEN b.top >= 2 * b.n THEN (SELECT min(x.other) FROM near x
                     WHERE x.word = b.word AND x.m = b.top) END AS form, CASE WHEN b.top >= 2 * b.n THEN b.top END AS form_n
                 FROM best b),
        path AS (SELECT word, form AS at FROM form WHERE form IS NOT NULL
                 UNION ALL SELECT path.word, form.form FROM path JOIN form ON form.word = path.at WHERE form.form IS NOT NULL),
        roots AS (SELECT path.word, path.at AS root FROM path LEFT JOIN form ON form.word = path.at WHERE form.form IS NULL)
        SELECT v.word, form.form, coalesce(roots.root, v.word) AS root, v.n, coalesce(form.n_near, 0) AS n_near, form.form_n
        FROM v LEFT JOIN form ON form.word = v.word LEFT JOIN roots ON roots.word = v.word""",
    "op12_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        stat AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, sum(len(t))::BIGINT AS terms FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
              FROM p, stat GROUP BY term, docs),
        s AS (SELECT q.item_id, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf
                       + 20 * (100 - 50 + (50 * len(d.t) * stat.docs) // stat.terms))))::BIGINT AS score
              FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term JOIN d ON d.r = p.r, stat GROUP BY q.item_id, p.r),
        o AS (SELECT s.item_id, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank,
                     d.doc_id, s.score FROM s JOIN d ON d.r = s.r WHERE s.score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50""",
}

SQL["op13_minhash"] = SQL["op10_jaccard_join"].replace("85 *", "80 *").replace(
    "SELECT d.doc_id, coalesce", "SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept "
    "FROM (SELECT d.doc_id, coalesce") + ")"
