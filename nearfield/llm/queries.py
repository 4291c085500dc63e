"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import jaccard, langid, linededup, media, mixing, neardup, packing, pii, quality, substring
from nearfield.llm.common import table
from nearfield.llm.grams import held_out


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_rows(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    """Sequences of 2048 with the 49k word tokenizer, each source at its share of the tokens, the one mixture that lasts to the end."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, capacity=2048, end=1)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(*mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("recall")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "demonstration key")


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_ngram_jaccard_join, op4_packing, op5_substring_dedup, op6_mixing, op7_language_id, op8_quality, op9_embedding_near_dedup, op10_pii)}

_WORDS = r"w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"

_JACCARD = f"""WITH RECURSIVE {_WORDS},
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, any_value(coalesce(k.n, 0)) AS n_links, count(*) AS class_size FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k USING (a) GROUP BY a"""

_SUBSTRING = f"""WITH {_WORDS},
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
d AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM d, (SELECT unnest(range(0, 35)) AS o)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_DOT = "list_sum(list_transform(list_zip({}, {}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding AS e, sqrt({_DOT.format("embedding", "embedding")}) AS n FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE {_DOT.format("x.e", "y.e")} / (x.n * y.n) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS vec_id, any_value(coalesce(k.n, 0)) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k USING (a) GROUP BY a"""

#: The others learn, tokenise, use hashes that SQL lacks or patterns with look-behind; their tests compare with brute force.
ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard_join": _JACCARD, "op5_substring_dedup": _SUBSTRING, "op9_embedding_near_dedup": _VECTORS}
