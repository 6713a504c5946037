"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, fingerprint, langid, mixing, neardup, packing, quality, sharding, topk, toxicity, url_filter, vector_codes
from .common import remainder, stash, table

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
SHARDS = 24


def tokenizer_path() -> str:
    """The default vocabulary file, outside the repository; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages under four rules; the trees learn from the urls that a rule decides and judge the others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(pages, "url", url_filter.matching_rule(RULES)["verdict"] == "block")
    return url_filter.judge(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", remainder(F.col("doc_id"), 3) != 1)
    return quality.predict(docs, model).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), 2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", remainder(F.col("doc_id"), 4) != 2)
    return toxicity.predict(docs, model).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.withColumn("law", F.lit("key"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 5), F.lit(1)) == 0
    model = langid.fit(docs, "text", "lang", ~held)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("edited_text")


def op9_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with the least doc_id of its near-duplicate class."""
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, with the shard of every copy and its place in the shard's order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.make_plan(docs)
    return mixing.with_copies(docs, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("drawn")["shard"].alias("shards"), F.col("drawn")["order_key"].alias("places"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document the benchmark's windows hit, and the digest of the items."""
    found = decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    coded = stash(vector_codes.encode(vectors, books))
    return vector_codes.with_group_total(coded, F.col("label")).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_quality_ranker, op3_block_topk, op4_best_fit_packing, op5_toxicity, op6_jump_sharding, op7_language_mixture, op8_scaled_fingerprint, op9_bagminhash_classes, op10_source_mix, op11_divergence_audit, op12_decontamination, op13_vector_codes)}

def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's rounds in plain SQL: codebooks b0, b1, ... and assignments a0, a1, ...; of equal distances the lower entry."""
    steps = [
        """r AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"d AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, v, len(v) // {parts} AS n FROM r)",
        f"p AS (SELECT k, i, v[i * n + 1:i * n + n] AS v FROM d, (SELECT unnest(generate_series(0, {parts - 1})) AS i))",
        f"b0 AS (SELECT i, k - 1 AS e, v FROM p WHERE k <= {entries})",
    ]
    for r in range(rounds + 1):
        far = "list_sum([CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT) FOR z IN list_zip(p.v, b.v)])"
        steps.append(f"a{r} AS MATERIALIZED (SELECT k, p.i, p.v, min(CAST({far} AS BIGINT) * {entries} + e) AS x FROM p JOIN b{r} b ON b.i = p.i GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT i, x % {entries} AS e, j, sum(u) AS s, count(*) AS n FROM (SELECT i, x, unnest(v) AS u, unnest(generate_series(1, len(v))) AS j FROM a{r}) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT i, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{r} GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.i, b.e, CAST(coalesce(m.v, b.v) AS BIGINT[]) AS v FROM b{r} b LEFT JOIN m{r} m USING (i, e))")
    steps.append(f"c AS (SELECT k, string_agg(printf('%02x', x % {entries}), '' ORDER BY i) AS code, CAST(sum(x // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY k)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY i, e)) AS h FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM d JOIN c USING (k), h"


ORACLES: dict[str, str] = {
    "op3_block_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
                     AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # all pairs that share a shingle, exactly; classes by the links' transitive closure
    "op9_bagminhash_classes": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
        m AS (SELECT t, min(doc_id) AS id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d GROUP BY t),
        s AS (SELECT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)] END) AS s
              FROM m WHERE len(w) > 0),
        c AS (SELECT id, s, count(*) AS n FROM s GROUP BY ALL),
        z AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
        p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE CAST(shared AS DOUBLE) / CAST(x.n + y.n - shared AS DOUBLE) >= CAST(0.8 AS DOUBLE)),
        l AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT d.doc_id, m.id FROM d JOIN m USING (t) UNION SELECT m.id, d.doc_id FROM d JOIN m USING (t)),
        r AS (SELECT a AS id, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.b)
        SELECT id AS doc_id, min(b) AS class_id FROM r GROUP BY id""",
    "op11_divergence_audit": r"""
        WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k FROM documents),
        w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
                     1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(t.total + l.v AS HUGEINT) AS p,
                     1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 1)) // CAST(l.total + l.v AS HUGEINT) AS q
              FROM t JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT item_id, least(len(w), 10) AS m, unnest([array_to_string(w[j:j + least(len(w), 10) - 1], ' ') FOR j IN generate_series(1, greatest(len(w) - 9, 1))]) AS s FROM i WHERE len(w) > 0),
        dw AS (SELECT k, m, unnest(generate_series(1, len(w) - m + 1)) AS j, unnest([array_to_string(w[j:j + m - 1], ' ') FOR j IN generate_series(1, len(w) - m + 1)]) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m),
        o AS (SELECT k, j, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s),
        h AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(generate_series(j, j + m - 1)) FROM o) GROUP BY k),
        e AS (SELECT k, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM o WHERE item_id IS NOT NULL) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(e.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (k) LEFT JOIN e USING (k)""",
    "op13_vector_codes": _vector_codes_sql(),
}
