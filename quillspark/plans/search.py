"""Search queries over the driver tables: a document is a source with one page and one block."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, retrieval
from ..operators.ordering import first_per_key, top
from .index import blocks, hybrid, postings, table, vectors

QUERY = "the that with"


def keyword_search(spark, sf_dir):
    """First 20 documents with all terms, in document order, from postings."""
    return postings(spark, sf_dir).search(QUERY).select("source_id", "block_id", F.col("rank").cast("long").alias("rank"), "score")


def keyword_phrase(spark, sf_dir):
    """A token with punctuation is a phrase; only two sources."""
    return postings(spark, sf_dir).search("of-the and", ["src1", "src2"]).select("source_id", "block_id", "score")


def like_fallback(spark, sf_dir):
    return retrieval.like_search(blocks(spark, sf_dir), "All rights", ["src0", "src3", "src7"]).select("source_id", "block_id")


def vector_topk(spark, sf_dir):
    """The ten vectors nearest to vector 0."""
    index = table(spark, sf_dir, "embeddings")
    sought = index.where("vec_id = 0").first()["embedding"]
    found = retrieval.vector_topk(index, list(sought), 10, "vec_id", "embedding")
    return found.select("vec_id", "label", F.round("cosine", 5).alias("cosine"))


def vector_topk_many(spark, sf_dir):
    """The three nearest of each vector whose id is divisible by 50, among all."""
    index = table(spark, sf_dir, "embeddings")
    asked = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = retrieval.vector_topk_many(index, asked, 3, "vec_id", "embedding")
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("cosine", 5).alias("cosine"))


def hash_embed(spark, sf_dir):
    """Integer weights of every document's hashed embedding."""
    docs = table(spark, sf_dir, "documents")
    return retrieval.token_weights(docs, ["doc_id"]).select("doc_id", F.col("dim").cast("long").alias("dim"), "weight")


def hybrid_search(spark, sf_dir):
    """Keyword and vector hits of one query, merged; postings and stored vectors are read, and the query alone is embedded."""
    found = hybrid(postings(spark, sf_dir), vectors(spark, sf_dir), QUERY)
    return found.select("source_id", "block_id", F.round("score", 5).alias("score"), "origin")


def term_frequency(spark, sf_dir):
    """The 20 most frequent terms without stop words."""
    rows = table(spark, sf_dir, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).where(~T.is_stop_word(F.col("term")))
    return top(rows.groupBy("term").agg(F.count("*").alias("n")), 20, [F.desc("n"), F.asc("term")])


def chunk_documents(spark, sf_dir):
    """Chunks of 1200 characters with 150 of overlap; the lines of a document are its blocks."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("source_id"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    lines = lines.withColumn("block_id", F.concat_ws("-", "source_id", "seq"))
    chunks = retrieval.chunk_pages(lines)
    return chunks.select(F.col("source_id").alias("doc_id"), "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), F.size("block_ids").alias("n_blocks"))


def dup_lines(spark, sf_dir):
    """Lines of every document, the first of each white-space-free lower-case key."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("key", F.lower(F.regexp_replace("line", "[ \t\r\x0b\f]", ""))).where("key != ''")
    kept = first_per_key(lines, ["doc_id", "key"], [F.col("line_no")])
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


def dup_paragraph_pairs(spark, sf_dir):
    """Paragraphs (lines over 40 characters) of a document, each with its first later one of Jaccard above 0.85."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.length("line") > 40)
    lines = lines.select("doc_id", F.struct("doc_id", "pos").alias("at"), T.overlap_tokens(F.col("line")).alias("tokens"))
    pairs = joins.jaccard_pairs(lines, "at", "tokens", 0.85, within="doc_id")
    first = pairs.groupBy("a").agg(F.min("b.pos").alias("twin"))
    return first.select("a.doc_id", F.col("a.pos").cast("long").alias("pos"), F.col("twin").cast("long").alias("twin"))


def benchmark_overlap(spark, sf_dir):
    """Documents and benchmark items that share 12 distinct tokens or more."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return joins.token_overlap(docs.select("doc_id", "text"), items.select("item_id", F.col("text").alias("item")), "doc_id", "item_id", 12, "text", "item")


def evidence_types(spark, sf_dir):
    """Evidence type of every document by keyword cases, counted by source."""
    docs = table(spark, sf_dir, "documents")
    kind = retrieval.evidence_type(F.col("source"), F.col("text"), F.array(F.lit("QUALITATIVE")))
    return docs.groupBy("source", kind.alias("evidence_type")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    keyword_search, keyword_phrase, like_fallback, vector_topk, vector_topk_many, hash_embed, hybrid_search, term_frequency,
    chunk_documents, dup_lines, dup_paragraph_pairs, benchmark_overlap, evidence_types,
)}

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_OVERLAP = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+|[가-힣]{{2,}}'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_EMBED = r"""
    toks AS (
        SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]{2,}'),
            CASE WHEN length(head) > 1 THEN list_transform(range(1, length(head)), lambda i: substr(head, i, 2)) ELSE [] END)) AS t
        FROM (SELECT doc_id, text, substr(regexp_replace(text, '\s', '', 'g'), 1, 201) AS head FROM src)
    ),
    weights AS (
        SELECT doc_id, ('0x' || substr(md5(t), 31, 2))::BIGINT AS dim,
            sum(CASE WHEN (('0x' || substr(md5(t), 30, 1))::BIGINT & 1) = 1 THEN 1 ELSE -1 END)::BIGINT AS weight
        FROM toks GROUP BY ALL HAVING weight <> 0
    )
"""
_KEYWORD = f"""
    words AS (
        SELECT *, row_number() OVER (ORDER BY source, doc_id) AS seq FROM (
            SELECT doc_id, source, text FROM documents WHERE list_has_all({_TOKENS}, ['the', 'that', 'with'])
            ORDER BY source, doc_id LIMIT 20)
    )
"""

ORACLE_SQL = {
    "keyword_search": f"WITH {_KEYWORD} SELECT source AS source_id, doc_id AS block_id, seq::BIGINT AS rank, round(1.0 - 0.01 * (seq - 1), 2)::DOUBLE AS score FROM words",
    "keyword_phrase": f"""
        SELECT source AS source_id, doc_id AS block_id, round(1.0 - 0.01 * (row_number() OVER (ORDER BY source, doc_id) - 1), 2)::DOUBLE AS score
        FROM (SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')
            AND contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ') AND list_contains({_TOKENS}, 'and')
            ORDER BY source, doc_id LIMIT 20)""",
    "like_fallback": """
        SELECT source AS source_id, doc_id AS block_id FROM documents
        WHERE source IN ('src0', 'src3', 'src7') AND contains(text, 'All rights') ORDER BY source, doc_id LIMIT 20""",
    "vector_topk": """
        WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], v), 5) AS cosine FROM embeddings, q
        ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10""",
    "vector_topk_many": """
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c
            FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
        SELECT query_id, vec_id, rank::BIGINT AS rank, round(c, 5) AS cosine FROM r WHERE rank <= 3""",
    "hash_embed": f"WITH src AS (SELECT doc_id, text FROM documents), {_EMBED} SELECT doc_id, dim, weight FROM weights",
    "hybrid_search": f"""
        WITH {_KEYWORD}, src AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'the that with'), {_EMBED},
        q AS (SELECT dim, weight AS sought FROM weights WHERE doc_id = -1),
        scored AS (
            SELECT doc_id, round(dot / sqrt(norm2::DOUBLE * (SELECT sum(sought * sought) FROM q)::DOUBLE), 6) AS cosine FROM (
                SELECT doc_id, sum(weight * coalesce(sought, 0)) AS dot, sum(weight * weight) AS norm2
                FROM weights LEFT JOIN q USING (dim) WHERE doc_id <> -1 GROUP BY doc_id) WHERE dot > 0
            ORDER BY cosine DESC, doc_id LIMIT 20),
        near AS (SELECT s.doc_id, cosine, source, substr(text, 1, 80) AS head, 20 + row_number() OVER (ORDER BY cosine DESC, s.doc_id) AS seq
            FROM scored s JOIN documents d ON s.doc_id = d.doc_id),
        kw AS (SELECT doc_id, source, substr(text, 1, 80) AS head, seq, round(1.0 - 0.01 * (seq - 1), 2) AS score,
            seq = min(seq) OVER (PARTITION BY source, substr(text, 1, 80)) AS is_first FROM words),
        best AS (SELECT source, head, max(cosine) AS best FROM near GROUP BY ALL),
        a AS (SELECT doc_id, kw.source, seq,
            CASE WHEN is_first AND best IS NOT NULL THEN greatest(score, round(best + 0.5, 6)) ELSE score END AS score,
            CASE WHEN is_first AND best IS NOT NULL THEN 'hybrid' ELSE 'keyword' END AS origin
            FROM kw LEFT JOIN best ON kw.source = best.source AND kw.head = best.head),
        b AS (SELECT *, count(*) OVER (PARTITION BY source, head) AS n, row_number() OVER (PARTITION BY source, head ORDER BY seq) AS k,
            lead(cosine) OVER (PARTITION BY source, head ORDER BY seq) AS second
            FROM near WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.source = near.source AND kw.head = near.head)),
        everything AS (SELECT source, doc_id, score, origin, seq FROM a UNION ALL
            SELECT source, doc_id, CASE WHEN n > 1 THEN greatest(cosine, round(second + 0.5, 6)) ELSE cosine END,
            CASE WHEN n > 1 THEN 'hybrid' ELSE 'vector' END, seq FROM b WHERE k = 1)
        SELECT source AS source_id, doc_id AS block_id, round(score::DOUBLE, 5) AS score, origin FROM everything ORDER BY score DESC, seq LIMIT 24""",
    "term_frequency": f"""
        SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-_/]+|[가-힣]{{2,}}')) AS term FROM documents)
        WHERE lower(term) NOT IN ({_STOP}) GROUP BY term ORDER BY n DESC, term LIMIT 20""",
    "dup_lines": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT doc_id, length(line) AS n, lower(regexp_replace(line, '[ \\t\\r\\x0b\\f]', '', 'g')) AS key FROM l),
        f AS (SELECT doc_id, key, first(n) AS n FROM k WHERE key <> '' GROUP BY doc_id, key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, sum(n)::BIGINT AS n_chars FROM f GROUP BY doc_id""",
    "dup_paragraph_pairs": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        t AS (SELECT doc_id, pos, {_OVERLAP.format('line')} AS toks FROM l WHERE length(line) > 40)
        SELECT a.doc_id, a.pos::BIGINT AS pos, min(b.pos)::BIGINT AS twin FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.pos < b.pos
        WHERE len(a.toks) > 0 AND len(b.toks) > 0
            AND len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) > 0.85 GROUP BY ALL""",
    "benchmark_overlap": f"""
        WITH d AS (SELECT doc_id, unnest({_OVERLAP.format('text')}) AS t FROM documents), b AS (SELECT item_id, unnest({_OVERLAP.format('text')}) AS t FROM benchmark)
        SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM d JOIN b USING (t) GROUP BY doc_id, item_id HAVING count(*) >= 12""",
    "evidence_types": "SELECT source, CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(source || chr(10) || text), '{w.lower()}')" for w in words) + f" THEN '{label}'"
        for label, words in retrieval.EVIDENCE_CASES
    ) + " ELSE 'QUALITATIVE' END AS evidence_type, count(*)::BIGINT AS n FROM documents GROUP BY ALL",
}
