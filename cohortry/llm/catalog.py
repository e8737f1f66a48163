"""Registered queries of the operators in this package and, where SQL can say it, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import bpe, divergence, idfile, jaccard, negatives, packing, quality, repeats, sharding, tokens, toxicity, urls, vectors, warc
from cohortry.llm.common import new_folder, table
from cohortry.llm.encoders import SpaceLed, WordEnded

QUERIES, SQL = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_warc(spark, sf_dir) -> DataFrame:
    """Pages written as WARC archives and read back."""
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, shard_bytes=64 << 20)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
    k AS (SELECT h, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY h)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
           CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < last THEN last END AS refers_to
    FROM p LEFT JOIN k ON p.h = k.h"""


@_query
def op3_byte_bpe(spark, sf_dir) -> DataFrame:
    """Every text encoded by byte-level BPE and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op7_id_files(spark, sf_dir) -> DataFrame:
    """Every text as ids in ranked variable-length files, read back."""
    path, folder = public_tokenizers.path("word_bpe_49k.json"), new_folder(spark, "ids")
    ids = tokens.encoded(table(spark, sf_dir, "documents"), WordEnded, path, end_id=1, width=2)
    idfile.write(ids, folder, width=2, file_ids=4_000_000)
    return idfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op9_packing(spark, sf_dir) -> DataFrame:
    """Every document packed into windows of 1024 ids."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    ids = tokens.encoded(docs, SpaceLed, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, width=2)
    pieces = packing.pack(ids, window=1024, width=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op2_quality_rules(spark, sf_dir) -> DataFrame:
    """Word, symbol, line and repetition counts of every document, and whether it is kept."""
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op2_quality_rules"] = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines,
               list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[1-9]', '0', 'g'),
                   '[ \t\x0B-\r]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS normal
        FROM documents),
    windows AS (
        SELECT DISTINCT t, w.i AS i, w.v AS v FROM (
            SELECT t, unnest(list_transform(range(len(words) - 4), lambda i: {'i': i, 'v': array_to_string(words[i + 1:i + 5], ' ')})) AS w
            FROM (SELECT DISTINCT t, words FROM d) WHERE len(words) >= 5)),
    twins AS (SELECT t, i FROM (SELECT t, i, count(*) OVER (PARTITION BY t, v) AS k FROM windows) WHERE k > 1),
    repeats AS (SELECT t, sum(least(5, coalesce(following - i, 5))) AS n FROM (SELECT t, i, lead(i) OVER (PARTITION BY t ORDER BY i) AS following FROM twins) GROUP BY t),
    line AS (SELECT DISTINCT host, md5(t) AS doc, unnest(normal) AS line FROM d),
    hosts AS (SELECT host, count(DISTINCT doc) AS n FROM line GROUP BY host),
    removed AS (SELECT host, line, min(doc) AS keeper FROM line GROUP BY host, line HAVING count(*) > 20 AND count(*) > 0.1 * (SELECT n FROM hosts h WHERE h.host = line.host)),
    lost AS (SELECT host, doc, sum(len(string_split(line, ' '))) AS lost FROM line JOIN removed USING (host, line) WHERE doc <> keeper GROUP BY host, doc),
    counts AS (
        SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
               coalesce(l.lost, 0) AS lost, coalesce(list_sum(list_transform(normal, lambda x: len(string_split(x, ' ')))), 0) AS total
        FROM d LEFT JOIN repeats r USING (t) LEFT JOIN lost l ON l.host = d.host AND l.doc = md5(d.t))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
               AND NOT (lost > 0 AND (total - lost < 10 OR total - lost < 0.3 * total)) AS kept
    FROM counts"""


@_query
def op4_sharding(spark, sf_dir) -> DataFrame:
    """Every document in one of 24 shards of near-equal bytes, equal texts together."""
    rows = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: (host, path, verdict): fixed by the task.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@_query
def op5_url_filter(spark, sf_dir) -> DataFrame:
    """Every page's URL judged by rules, else by trees on how it looks."""
    rows = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict", "score")


@_query
def op6_toxicity(spark, sf_dir) -> DataFrame:
    """Every document's probability of being toxic, by its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = toxicity.scored(docs, model, keep_text=False)
    held, score = toxicity.held_out(F.col("doc_id")), F.col("toxic_score")
    return rows.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@_query
def op8_jaccard_join(spark, sf_dir) -> DataFrame:
    """Every document's class of near copies and the number of documents it is linked with."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


@_query
def op10_near_vectors(spark, sf_dir) -> DataFrame:
    """Every embedding's links at a cosine of 0.9 and its component."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op10_near_vectors"] = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
          AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept
    FROM embeddings JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = vec_id"""


@_query
def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    """For every hundredth vec_id its five nearest of the same label, and per such the five best of other labels below it."""
    vec, label = F.col("vec_id").cast("long"), F.col("label")
    moved = F.when(F.coalesce(vec % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(vec.alias("vec_id"), moved.alias("label"), negatives.whole_numbers("embedding").alias("x"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = """
    WITH v AS (
        SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
            AND coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)),
    s AS (
        SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS other_id, a.label = b.label AS alike,
               CAST(coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row),
    p AS (SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score FROM s WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other_id, other) AS INTEGER) AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor = s.anchor AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other_id, other) <= 5"""


@_query
def op11_source_divergence(spark, sf_dir) -> DataFrame:
    """Per language how far each source is from every other, and its most marked terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    times AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
    here AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM times t WHERE t.lang = g.lang AND t.source = g.source), 0) AS total
        FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang)),
    p AS (SELECT h.lang, h.source, k.term, coalesce(t.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(t.n, 0) + 2) // (h.total + 2 * h.v) AS p
        FROM here h JOIN kept k USING (lang) LEFT JOIN times t ON t.lang = h.lang AND t.source = h.source AND t.term = k.term),
    whole AS (SELECT lang, term, sum(n) AS n FROM times GROUP BY lang, term),
    q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM whole JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    rows AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM here a JOIN here b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM rows QUALIFY part = 'pair' OR rank <= 10"""


@_query
def op13_repeated_passages(spark, sf_dir) -> DataFrame:
    """Every text without the passages of 400 bytes or more that repeat."""
    rows = repeats.removed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
