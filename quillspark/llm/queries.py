"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    chat_format,
    decontaminate,
    html_extract,
    importance,
    language_id,
    line_dedup,
    ngram_join,
    quality_rules,
    sentencepiece_codec,
    suffix_dedup,
    url_filters,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that also start elsewhere, as digests."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=200))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that an earlier document, or an earlier line of it, holds in the same or like form."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, model_path()))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one (-1) full of control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    formatted = chat_format.format_conversations(turns.unionByName(extra))
    return chat_format.digests(chat_format.read_back(formatted))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), percent=75)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all rules for every document, with the verdicts of the base and the current policy."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lexicon = quality_rules.fit_lexicon(docs, _table(spark, sf_dir, "labels"))
    book = quality_rules.apply_policy(quality_rules.ledger(docs.select("doc_id", "text"), lexicon))
    base = ~quality_rules.passes(quality_rules.BASE)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept",
        "n_upper", "n_lines", "n_insults", "failed",
    )


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 mod 4 is not 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(_remainder() != 2))
    found = language_id.predict(docs, model)
    return found.select(
        "doc_id", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def _digit(column: F.Column, start: int) -> F.Column:
    return F.conv(F.substring(F.md5(column), start, 4), 16, 10).cast("long")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against dated list entries active at its fetch time.

    The tables hold neither lists nor fetch times. Both follow from the pages by rule: fetch times spread over the year
    2024 by page_id; a quarter of the hosts enter a list on a day that their md5 names, half of those leave it 60 days
    later, half of these enter again after 120 days; a fifth of the three-label domains and a twentieth of the URL keys
    enter once.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def after(minutes: F.Column) -> F.Column:
        return start + F.make_dt_interval(mins=minutes.cast("int"))

    captures = pages.withColumn("fetch_ts", after(F.pmod(F.col("page_id") * 7919, F.lit(525600))))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("pattern")).where("pattern != ''").distinct()
    labels = F.split("pattern", r"\.")
    domains = hosts.where(F.size(labels) > 3).select(F.array_join(F.slice(labels, -3, 3), ".").alias("pattern")).distinct()
    keys = pages.select(F.lower(url_filters.url_key(F.col("url"))).alias("pattern")).where("pattern != ''").distinct()
    v, day = _digit(F.col("pattern"), 1), F.pmod(_digit(F.col("pattern"), 5), F.lit(300)) * 1440
    name = F.element_at(F.array(*map(F.lit, ("adult", "malware", "phishing"))), (F.pmod(v, F.lit(3)) + 1).cast("int"))

    def entries(rows: DataFrame, kind: str, every: int, action: str, later: int = 0) -> DataFrame:
        rows = rows.where(F.pmod(v, F.lit(every)) == 0)
        return rows.select(
            F.lit(kind).alias("kind"), "pattern", name.alias("list_name"), F.lit(action).alias("action"),
            after(day + later * 1440).alias("at"),
        )

    listed = entries(hosts, "domain", 4, "add").unionByName(entries(hosts, "domain", 8, "remove", 60))
    listed = listed.unionByName(entries(hosts, "domain", 16, "add", 120)).unionByName(entries(domains, "domain", 5, "add"))
    return url_filters.filter_captures(captures, listed.unionByName(entries(keys, "url", 20, "add")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item that it holds a passage of."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector, fitted on the distinct vectors of the whole table."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, components=16))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of 5 of 100 towards the benchmark."""
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole document, as digests."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_line_dedup,
        op3_sentencepiece,
        op4_chat_format,
        op5_html_extract,
        op6_ngram_join,
        op7_quality_rules,
        op8_language_id,
        op9_decontaminate,
        op10_url_filters,
        op11_whitening,
        op12_importance,
        op13_byte_bpe,
    )
}

ORACLE_SQL = {
    "op4_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))
                + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17
                  ELSE 26 + length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) END AS chars
            FROM turns
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op10_url_filters": r"""
        WITH p AS (
            SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(((page_id * 7919) % 525600)::INT) AS fetch_ts,
                regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1)), '\.+$', '') AS host,
                regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
            FROM pages
        ),
        captures AS (SELECT page_id, url, fetch_ts, host, lower(host || path) AS key FROM p),
        hosts AS (SELECT DISTINCT host AS pattern FROM captures WHERE host <> ''),
        labelled AS (SELECT pattern, string_split(pattern, '.') AS l FROM hosts),
        up AS (
            SELECT pattern AS host, array_to_string(list_slice(l, i, len(l)), '.') AS pattern
            FROM (SELECT pattern, l, unnest(range(1, len(l) + 1)) AS i FROM labelled)
        ),
        domains AS (SELECT DISTINCT array_to_string(list_slice(l, len(l) - 2, len(l)), '.') AS pattern FROM labelled WHERE len(l) > 3),
        urls AS (SELECT DISTINCT key AS pattern FROM captures WHERE key <> ''),
        named AS (
            SELECT *, ('0x' || substr(md5(pattern), 1, 4))::BIGINT AS v, (('0x' || substr(md5(pattern), 5, 4))::BIGINT % 300)::INT AS day
            FROM (SELECT 'host' AS what, pattern FROM hosts UNION ALL SELECT 'domain', pattern FROM domains UNION ALL SELECT 'url', pattern FROM urls)
        ),
        rules AS (
            SELECT * FROM (VALUES ('host', 'domain', 4, 'add', 0), ('host', 'domain', 8, 'remove', 60), ('host', 'domain', 16, 'add', 120),
                ('domain', 'domain', 5, 'add', 0), ('url', 'url', 20, 'add', 0)) AS t(what, kind, every, action, later)
        ),
        entries AS (
            SELECT DISTINCT kind, pattern, ['adult', 'malware', 'phishing'][v % 3 + 1] AS list_name, action,
                TIMESTAMP '2024-01-01 00:00:00' + to_days((day + later)::INT) AS since
            FROM named JOIN rules USING (what) WHERE v % every = 0
        ),
        spans AS (
            SELECT kind, pattern, list_name, action, since AS valid_from, coalesce(
                lead(since) OVER (PARTITION BY kind, pattern, list_name ORDER BY since, action = 'remove'), TIMESTAMP '9999-12-31 00:00:00') AS valid_to
            FROM entries
        ),
        active AS (
            SELECT host AS key, 'd' AS side, s.* FROM up JOIN spans s USING (pattern) WHERE kind = 'domain' AND action = 'add'
            UNION ALL SELECT pattern, 'u', * FROM spans WHERE kind = 'url' AND action = 'add'
        ),
        joined AS (
            SELECT c.page_id, c.url, c.fetch_ts, c.host, a.kind, a.pattern, a.list_name, a.valid_from
            FROM captures c LEFT JOIN active a ON c.host <> '' AND a.key = CASE a.side WHEN 'd' THEN c.host ELSE c.key END
                AND c.fetch_ts >= a.valid_from AND c.fetch_ts < a.valid_to
        ),
        ranked AS (
            SELECT *, count(pattern) OVER w AS n_entries, row_number() OVER (PARTITION BY page_id, url, fetch_ts
                ORDER BY length(pattern) DESC NULLS LAST, kind, list_name, valid_from, pattern) AS nth
            FROM joined WINDOW w AS (PARTITION BY page_id, url, fetch_ts)
        )
        SELECT page_id, url, fetch_ts, host, n_entries > 0 AS blocked, n_entries::BIGINT AS n_entries, list_name, kind, pattern, valid_from
        FROM ranked WHERE nth = 1
    """,
}
