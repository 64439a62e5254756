"""Search over text blocks: keyword, vector and hybrid, chunking and evidence.

Blocks are rows (source_id, page, seq, block_id, text). ``sources`` filters by source everywhere alike: None means all,
an empty list means none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import rank_score

KEYWORD_LIMIT, VECTOR_LIMIT, MERGED_LIMIT = 20, 20, 24
KEY_CHARS = 80
#: Rows of a block of vectors, and the size from which numbers are compared one by one.
BLOCK_ROWS, HUGE = 4096, 1e100


def in_sources(df: DataFrame, sources: list | None, column: str = "source_id") -> DataFrame:
    if sources is None:
        return df
    return df.where(F.col(column).isin(sources)) if sources else df.where(F.lit(False))


def phrases_of(query: str) -> list[list[str]]:
    """The words of each white-space token of a query; a token with punctuation inside has several and is a phrase."""
    import regex

    found = (regex.findall(T.SEARCH_TOKEN, word.lower()) for word in query.replace('"', " ").split())
    return [p for p in found if p]


def matches_all(text: Column, query: str) -> Column:
    """Every white-space token of the query occurs; a token with punctuation inside is a phrase."""
    phrases = phrases_of(query)
    if not phrases:
        return F.lit(False)
    # A token ends where no letter or digit follows; the search stops at the first place of each phrase.
    flat, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(True)
    for phrase in phrases:
        out = out & flat.rlike(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(phrase) + r"(?![\p{L}\p{N}])")
    return out


def keyword_search(blocks: DataFrame, query: str, sources: list | None = None, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """First blocks in document order that hold all terms; ``seq`` numbers them from 1 and ``score`` falls by 0.01."""
    found = in_sources(blocks, sources).where(matches_all(F.col("text"), query))
    found = found.orderBy("source_id", "page", "seq", "block_id").limit(limit)
    # At most ``limit`` rows are numbered.
    number = F.row_number().over(Window.orderBy("source_id", "page", "seq", "block_id"))
    return found.withColumn("rank", number).withColumn("score", rank_score(F.col("rank")))


def like_search(blocks: DataFrame, query: str, sources: list | None = None, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """Substring fallback; keeps the source filter."""
    found = in_sources(blocks, sources).where(F.col("text").contains(query))
    return found.orderBy("source_id", "page", "seq", "block_id").limit(limit)


def token_codes(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, codes): the codes of a text's tokens, as many as there are tokens."""
    # Heads and tokens are columns of their own, so that each is computed once.
    rows = docs.select(*keys, F.col(text).alias("text"), T.embedding_head(F.col(text)).alias("head"))
    rows = rows.select(*keys, T.embedding_tokens(F.col("text"), F.col("head")).alias("tokens"))
    return rows.select(*keys, F.transform("tokens", T.token_code).alias("codes"))


def code_sums(codes):
    """Signed counts of an Arrow array of code lists: a row per list, a column per dimension."""
    import numpy as np
    import pyarrow.compute as pc

    flat = np.asarray(codes.flatten(), dtype="int64")
    row = np.repeat(np.arange(len(codes)), np.asarray(pc.list_value_length(codes).fill_null(0)))
    sign = np.where(flat & T.VECTOR_DIMS, 1.0, -1.0)
    return np.bincount(row * T.VECTOR_DIMS + (flat & (T.VECTOR_DIMS - 1)), sign, len(codes) * T.VECTOR_DIMS).astype("int64").reshape(-1, T.VECTOR_DIMS)


def token_weights(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, dim, weight): integer weights of the hashed embedding before normalisation; zeros are left out.

    A document is one row, with the codes of its tokens, until its sums are known; rows that repeat a key are one document.
    """
    rows = token_codes(docs, keys, text).groupBy(*keys).agg(F.flatten(F.collect_list("codes")).alias("codes"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            weights = code_sums(batch.column("codes"))
            row, dim = np.nonzero(weights)
            taken = [batch.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(dim.astype("int32")), pa.array(weights[row, dim])], [*keys, "dim", "weight"])

    return rows.mapInArrow(sums, f"{kinds}, dim int, weight bigint")


def hash_embedding(docs: DataFrame, name: str = "vec", text: str = "text") -> DataFrame:
    """docs with an array<float> of unit length (all zero for texts without tokens), without a shuffle."""
    rows = docs.withColumn("_head", T.embedding_head(F.col(text)))
    rows = rows.withColumn("_codes", F.transform(T.embedding_tokens(F.col(text), F.col("_head")), T.token_code))
    # Codes of 9 bits: the dimension, and the sign above it.
    rows = rows.withColumn("_codes", F.transform("_codes", lambda c: c.bitwiseAND(F.lit(2 * T.VECTOR_DIMS - 1))))
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(T.VECTOR_DIMS - 1)),
        lambda k: (F.size(F.filter("_codes", lambda c: c == k + T.VECTOR_DIMS)) - F.size(F.filter("_codes", lambda c: c == k))).cast("double"),
    )
    rows = rows.withColumn("_weights", weights)
    return rows.withColumn(name, unit(F.col("_weights"))).drop("_head", "_codes", "_weights")


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def vector_topk(index: DataFrame, query: list[float], k: int = VECTOR_LIMIT, id_col: str = "chunk_id", vec_col: str = "vec", sources: list | None = None) -> DataFrame:
    """The k nearest rows by dot product; ties by id. Filters come before the sort."""
    sought = F.array(*[F.lit(float(x)) for x in query])
    scored = in_sources(index, sources).withColumn("cosine", T.dot(F.col(vec_col), sought))
    return scored.orderBy(F.desc("cosine"), F.asc(id_col)).limit(k)


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows (id, vec) as blocks of about BLOCK_ROWS: (size, ids, data), the ids of one vector length in order and their vectors."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            sizes = pc.list_value_length(batch.column("vec"))
            for size in pc.unique(sizes).to_pylist():
                mine = batch.filter(pc.equal(sizes, size))
                data = np.asarray(mine.column("vec").flatten(), dtype="float64").tobytes()
                ids = pa.array([mine.column("id").to_pylist()], pa.list_(batch.schema.field("id").type))
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), ids, pa.array([data], pa.binary())], ["size", "ids", "data"])

    return rows.repartition(max(1, -(-n // BLOCK_ROWS))).mapInArrow(pack, f"size int, ids array<{kind}>, data binary")


def nearest_in_block(asked, known, k: int):
    """Three arrays: the places of queries and rows, k rows or fewer of each query, and their dot products.

    A matrix product chooses what can be among the k; these products are then summed in order, as SQL does, and of equal ones
    the first rows stay.
    """
    import numpy as np

    k = min(k, len(known))
    # Far beyond what the order of the sums can change.
    slack = 1e-10 * np.sqrt((asked * asked).sum(axis=1)) * np.sqrt((known * known).sum(axis=1).max())
    out = []
    for at in range(0, len(asked), 256):
        rough = asked[at : at + 256] @ known.T
        least = np.partition(rough, -k, axis=1)[:, -k] - slack[at : at + 256]
        q, i = np.nonzero(rough >= least[:, None])
        exact = np.zeros(len(q))
        for d in range(asked.shape[1]):
            exact += asked[at + q, d] * known[i, d]
        order = np.lexsort((i, -exact, q))
        q, i, exact = q[order], i[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((at + q[first], i[first], exact[first]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def vector_topk_many(index: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """The k nearest rows of each row of ``queries`` (query_id, query_vec), ties by id; every row is compared with every query.

    Of equal vectors the first k ids can count. Blocks of rows meet blocks of queries in matrix products, and each pair of blocks
    leaves k rows of a query. Rows whose numbers or id are missing or not finite are compared one by one.
    """
    known = index.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_vec").cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: F.abs(x) < HUGE) & (F.size("vec") > 0) & F.col("id").isNotNull()
    good = F.coalesce(good, F.lit(False))
    copies = Window.partitionBy("vec").orderBy("id")
    plain = known.where(good).withColumn("_k", F.row_number().over(copies)).where(F.col("_k") <= k).drop("_k")
    left = _blocks(plain, index.count()).select(*(F.col(c).alias(f"i_{c}") for c in ("size", "ids", "data")))
    right = _blocks(asked.where(good), queries.count()).select(*(F.col(c).alias(f"q_{c}") for c in ("size", "ids", "data")))
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, known)]

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fields = [batch.schema.field(c).type.value_type for c in ("q_ids", "i_ids")]
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                q_ids, i_ids = row["q_ids"].values, row["i_ids"].values
                size, other = row["q_size"].as_py(), row["i_size"].as_py()
                if size == other:
                    vectors = [np.frombuffer(row[c].as_py(), dtype="float64").reshape(-1, size) for c in ("q_data", "i_data")]
                    q, i, cosine = nearest_in_block(*vectors, k)
                else:
                    few = min(k, len(i_ids))  # vectors of other lengths count as 0
                    q, i = np.repeat(np.arange(len(q_ids)), few), np.tile(np.arange(few), len(q_ids))
                    cosine = np.zeros(len(q))
                parts = [q_ids.take(pa.array(q)).cast(fields[0]), i_ids.take(pa.array(i)).cast(fields[1]), pa.array(cosine)]
                yield pa.RecordBatch.from_arrays(parts, ["query_id", "id", "cosine"])

    scored = left.crossJoin(right).mapInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, cosine double")
    odd = ~good
    a, b = known.select(F.col("id"), "vec", odd.alias("odd")), asked.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), odd.alias("asked_odd"))
    pairs = a.where("odd").crossJoin(b).unionByName(a.where("NOT odd").crossJoin(b.where("asked_odd")))
    scored = scored.unionByName(pairs.select("query_id", "id", T.dot(F.col("vec"), F.col("query_vec")).alias("cosine")))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(id_col), "cosine", "rank")


def check_dimensions(index: DataFrame, vec_col: str = "vec") -> int:
    """The one dimension of an index; mixed dimensions are refused."""
    low, high = index.agg(F.min(F.size(vec_col)), F.max(F.size(vec_col))).first()
    if low != high:
        raise ValueError(f"mixed vector dimensions: {low} to {high}")
    return low or 0


def document_vector_scores(blocks: DataFrame, query: str, limit: int = VECTOR_LIMIT) -> DataFrame:
    """Cosine of every block's hashed embedding with that of the query, best ``limit``."""
    asked = blocks.sparkSession.createDataFrame([(query,)], "text string")
    # At most 256 rows.
    sought = token_weights(asked.withColumn("q", F.lit(1)), ["q"]).select("dim", F.col("weight").alias("sought"))
    weights = token_weights(blocks, ["block_id"]).join(F.broadcast(sought), "dim", "left")
    scores = weights.groupBy("block_id").agg(
        F.sum(F.col("weight") * F.coalesce("sought", F.lit(0))).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("norm2")
    )
    asked_norm = sought.agg(F.sum(F.col("sought") * F.col("sought")).alias("asked2"))
    scores = scores.crossJoin(F.broadcast(asked_norm))  # one row
    cosine = F.round(F.col("dot") / F.sqrt(F.col("norm2").cast("double") * F.col("asked2").cast("double")), 6)
    return scores.where("dot > 0").select("block_id", cosine.alias("cosine")).orderBy(F.desc("cosine"), "block_id").limit(limit)


def hybrid_search(blocks: DataFrame, query: str, sources: list | None = None, limit: int = MERGED_LIMIT, vector: bool = True) -> DataFrame:
    """Keyword and vector hits of blocks that no index holds, merged. ``vector=False`` is the keyword-only mode."""
    words = keyword_search(blocks, query, sources).select("block_id", "source_id", "page", "text", "score", "rank")
    if not vector:
        return merge_hits(words, None, limit)
    scoped = in_sources(blocks, sources)
    near = scoped.join(F.broadcast(document_vector_scores(scoped, query)), "block_id")  # at most twenty rows
    return merge_hits(words, near.select("block_id", "source_id", "page", "text", "cosine"), limit)


def merge_hits(words: DataFrame, near: DataFrame | None, limit: int = MERGED_LIMIT) -> DataFrame:
    """Keyword hits (block_id, source_id, page, text, score, rank) and vector hits (..., cosine), at most twenty of each.

    A vector hit equal to an earlier row on (source, page, first 80 characters) lifts that row to
    max(score, cosine + 0.5) and makes it ``hybrid``; other vector hits score their cosine.
    """
    key = ["source_id", "page", F.substring("text", 1, KEY_CHARS).alias("head")]
    words = words.select("block_id", *key, "score", F.col("rank").alias("seq"), F.lit("keyword").alias("origin"))
    if near is None:
        return words.orderBy(F.desc("score"), "seq").limit(limit)
    place = F.lit(KEYWORD_LIMIT) + F.row_number().over(Window.orderBy(F.desc("cosine"), "block_id"))
    near = near.select("block_id", *key, "cosine", place.alias("seq"))
    rows = words.unionByName(near.withColumn("origin", F.lit("vector")), allowMissingColumns=True)
    same = Window.partitionBy("source_id", "page", "head")
    rows = rows.withColumns({
        "words": F.count("score").over(same), "near": F.count("cosine").over(same), "best": F.max("cosine").over(same),
        "nth": F.row_number().over(same.orderBy("seq")), "second": F.lead("cosine").over(same.orderBy("seq")),
    })
    # A keyword hit takes the best vector hit of its key; of vector hits alone the first stays and the next one lifts it.
    lift = F.when(F.col("words") > 0, F.col("best")).otherwise(F.col("second"))
    own = F.coalesce("score", "cosine")
    lifted = (F.col("nth") == 1) & lift.isNotNull()
    rows = rows.where(F.col("score").isNotNull() | ((F.col("words") == 0) & (F.col("nth") == 1)))
    score = F.when(lifted, F.greatest(own, F.round(lift + 0.5, 6))).otherwise(own)
    rows = rows.select("block_id", "source_id", "page", "head", score.alias("score"), "seq", F.when(lifted, "hybrid").otherwise(F.col("origin")).alias("origin"))
    return rows.orderBy(F.desc("score"), "seq").limit(limit)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunk_pages(blocks: DataFrame, max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """(source_id, page, chunk_no, text, block_ids): greedy chunks of a page's blocks with an overlap tail.

    A chunk closes before the block that would take it past ``max_chars`` (a separator counts as one character); the
    next one starts with its last ``overlap`` characters and its last block id. Blocks longer than that stay whole;
    blank blocks and ``[IMAGE]`` are skipped.
    """
    usable = blocks.where(F.col("text").isNotNull() & (_strip(F.col("text")) != "") & (F.col("text") != "[IMAGE]"))
    item = F.struct("seq", "block_id", _strip(F.col("text")).alias("text"))
    pages = usable.groupBy("source_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<string>")
    chunk = "array<struct<text:string,block_ids:array<string>>>"
    zero = F.struct(F.array().cast(chunk).alias("done"), F.lit("").alias("buf"), none.alias("ids"), F.lit(0).alias("length"))

    def step(acc: Column, b: Column) -> Column:
        size = F.length(b["text"])
        full = (F.size(acc["ids"]) > 0) & (acc["length"] + size + 1 > max_chars)
        text = _strip(acc["buf"])
        tail = F.right(text, F.lit(overlap)) if overlap else F.lit("")
        done = F.when(full & (text != ""), F.concat(acc["done"], F.array(F.struct(text.alias("text"), acc["ids"].alias("block_ids"))))).otherwise(acc["done"])
        kept = F.when(full, tail).otherwise(acc["buf"])
        ids = F.when(full, F.slice(acc["ids"], -1, 1) if overlap else none).otherwise(acc["ids"])
        length = F.when(full, F.length(tail)).otherwise(acc["length"])
        buf = F.when(F.size(ids) > 0, F.concat_ws("\n", kept, b["text"])).otherwise(b["text"])
        return F.struct(done.cast(chunk).alias("done"), buf.alias("buf"), F.concat(ids, F.array(b["block_id"].cast("string"))).alias("ids"), (length + size + 1).alias("length"))

    def finish(acc: Column) -> Column:
        last = F.struct(_strip(acc["buf"]).alias("text"), acc["ids"].alias("block_ids"))
        return F.when(F.size(acc["ids"]) > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    chunks = pages.select("source_id", "page", F.posexplode(F.aggregate("items", zero, step, finish)).alias("chunk_no", "c"))
    return chunks.select("source_id", "page", "chunk_no", "c.text", "c.block_ids")


#: Ordered keyword cases of evidence types, fixed values; a table, so that a domain can bring its own.
EVIDENCE_CASES: list[tuple[str, tuple[str, ...]]] = [
    ("METRIC", ("%", "증가", "감소", "향상", "지표")),
    ("ARCHITECTURE", ("구성", "아키텍처", "vpn", "클라우드", "노드", "연결")),
    ("PROCESS", ("절차", "프로세스", "흐름", "단계", "주문", "출하")),
    ("PROBLEM", ("문제", "한계", "누락", "미연계", "노후")),
    ("DEFINITION", ("정의", "이란", "의미", "측정방법")),
]


def evidence_type(title: Column, text: Column, required: Column, cases: list[tuple[str, tuple[str, ...]]] | None = None) -> Column:
    """First keyword case over title and text, else the first required type, else QUALITATIVE."""
    fallback = F.coalesce(F.get(required, F.lit(0)), F.lit("QUALITATIVE"))
    return T.first_match(F.concat_ws("\n", title, text), cases or EVIDENCE_CASES, fallback)


def merge_queries(hits: DataFrame, limit: int = 10) -> DataFrame:
    """Hits (section_id, qpos, rank, source_id, page, text, ...) of several queries: first per key, then the first ten."""
    head = hits.withColumn("_head", F.substring("text", 1, 60))
    w = Window.partitionBy("section_id", "source_id", "page", "_head").orderBy("qpos", "rank")
    once = head.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_head")
    order = Window.partitionBy("section_id").orderBy("qpos", "rank")
    return once.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= limit)


def evidence_packs(hits: DataFrame) -> DataFrame:
    """One row per section: typed lists of its merged hits, what is missing and what limits it."""
    item = F.struct("seq", "source_id", "page", F.col("text").alias("statement"))
    usable = hits.where((F.trim("text") != "") & (F.col("text") != "[IMAGE]"))

    def of(*types: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("evidence_type").isin(*types), item)))

    packs = usable.groupBy("section_id").agg(
        of("DEFINITION").alias("definitions"), of("METRIC").alias("metrics"), of("PROCESS").alias("process_facts"),
        of("ARCHITECTURE").alias("architecture_facts"), of("PROBLEM", "QUALITATIVE").alias("supporting_facts"),
    )
    some = sum((F.size(c) for c in ("metrics", "process_facts", "architecture_facts", "supporting_facts")), F.lit(0))
    return packs.withColumn("missing_evidence", F.when(some == 0, F.array(F.lit("no evidence"))).otherwise(F.array().cast("array<string>")))
