"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import exact_dedup, licenses, packing, quality, scratch, sentencepiece_codec, sharding, simhash, substring, vector_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), threshold=0.9)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=4096)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives, equal payloads once, and read the archives back with each payload verified."""
    pages = _table(spark, sf_dir, "pages")
    path = scratch.new_path(spark, "op4")
    warc.write_archive(warc.with_revisits(pages, "page_id", "url", F.encode("html", "utf-8")), path)
    back = warc.read_archive(spark, path, "record_id string, record_type string, payload_digest string, payload_length long, refers_to string", verify="true").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(.+)$", 1)
    return back.select(
        F.when(page("record_id") != "", page("record_id").cast("long")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to").cast("long")).alias("refers_to"),
    )


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.group_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=24)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group_near(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_packing": op2_packing,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_warc": op4_warc,
        "op5_vectors": op5_vectors,
        "op6_sharding": op6_sharding,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_simhash": op8_simhash,
        "op9_substring": op9_substring,
        "op10_quality": op10_quality,
    }


def _licenses_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licenses.TEMPLATES.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda c: f"list_filter(string_split(regexp_replace(translate({c}, '{upper}', '{lower}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
        WITH tw AS (SELECT name, {words("txt")} AS w FROM (VALUES {rows}) v(name, txt)),
        tb AS (SELECT name, len(w) - 1 AS tn, w[k] || ' ' || w[k + 1] AS g, count(*) AS tc FROM tw, unnest(range(1, len(w))) r(k) GROUP BY ALL),
        lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
        lw AS (SELECT doc_id, line, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, line, {words("u")} AS x FROM lines)),
        pw AS (SELECT doc_id, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS p FROM lw),
        bg AS (SELECT doc_id, p, line, lead(line) OVER o AS next_line, w || ' ' || lead(w) OVER o AS g FROM pw WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        hit AS (SELECT doc_id, p, line, next_line, name, g, tn, tc FROM bg JOIN tb USING (g)),
        near AS (SELECT doc_id, name FROM (SELECT doc_id, name, tn, least(count(*), any_value(tc)) AS c FROM hit GROUP BY doc_id, name, tn, g) GROUP BY doc_id, name, tn HAVING sum(c) >= tn * 0.9 / 1.1),
        edge AS (SELECT doc_id, line, min(p) AS first_p, max(p) AS last_p FROM pw GROUP BY ALL),
        a AS (SELECT DISTINCT doc_id, name, tn, line FROM hit SEMI JOIN near USING (doc_id, name)), z AS (SELECT DISTINCT doc_id, name, next_line AS line FROM hit SEMI JOIN near USING (doc_id, name)),
        runs AS (SELECT a.doc_id, a.name, a.tn, a.line AS la, z.line AS lz, x.first_p, y.last_p, y.last_p - x.first_p AS n FROM a JOIN z ON a.doc_id = z.doc_id AND a.name = z.name AND z.line >= a.line
                 JOIN edge x ON x.doc_id = a.doc_id AND x.line = a.line JOIN edge y ON y.doc_id = z.doc_id AND y.line = z.line
                 WHERE y.last_p - x.first_p BETWEEN greatest(a.tn * 0.9 / 1.1, 1) AND a.tn * 1.1 / 0.9),
        c AS (SELECT r.doc_id, r.name, r.tn, la, lz, n, least(count(*), any_value(tc)) AS c FROM runs r JOIN hit h ON h.doc_id = r.doc_id AND h.name = r.name AND h.p >= first_p AND h.p < last_p
              GROUP BY r.doc_id, r.name, r.tn, la, lz, n, g),
        d AS (SELECT doc_id, name, la, lz, 2 * sum(c)::DOUBLE / (tn + n) AS dice FROM c GROUP BY doc_id, name, la, lz, tn, n HAVING 2 * sum(c)::DOUBLE / (tn + n) >= 0.9),
        top AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, la, lz DESC, name) = 1),
        m AS (SELECT doc_id, count(DISTINCT k) AS m FROM d, unnest(range(la, lz + 1)) r(k) GROUP BY doc_id)
        SELECT documents.doc_id, name AS license, dice AS score, la::INTEGER AS line, (lz - la + 1)::INTEGER AS n_lines, coalesce(m, 0) AS n_matched
        FROM documents LEFT JOIN top USING (doc_id) LEFT JOIN m USING (doc_id)
    """


_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
#: Four letters of base32 from each five hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr({0}, 5 * k + 1, 5))::INT >> s) & 31) + 1]), '')), '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": _licenses_sql(),
        "op7_exact_dedup": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
                 g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
            FROM t JOIN g ON t.x = g.x
        """,
        "op4_warc": f"""
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS x FROM pages),
                 g AS (SELECT x, max(page_id) AS first FROM p GROUP BY x)
            SELECT page_id, payload_bytes, {_BASE32.format("upper(sha1(x))")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first THEN first END AS refers_to
            FROM p JOIN g USING (x)
        """,
        "op5_vectors": """
            WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
                 u AS (SELECT * FROM v WHERE list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
                 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
                 r(n, m) AS (SELECT a, b FROM l UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
                 c AS (SELECT n, least(n, min(m)) AS component FROM r GROUP BY n)
            SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
            FROM embeddings LEFT JOIN c ON c.n = vec_id
        """,
        "op9_substring": f"""
            WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
                 g AS (SELECT doc_id, i, w[i : i + 12] AS x FROM d, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
                 f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM g),
                 gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM f, range(13) t(k) WHERE first < doc_id),
                 rem AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY 1),
                 kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS x FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM d) ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
            SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN rem USING (doc_id) LEFT JOIN kept USING (doc_id)
        """,
    }
