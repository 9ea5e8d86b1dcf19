"""Registry of the corpus queries, one ``opN_<name>`` per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm.alignment import alignment
from stratafold.llm.exact_dedup import exact_duplicates
from stratafold.llm.jaccard import jaccard_components
from stratafold.llm.licenses import license_scan
from stratafold.llm.line_dedup import line_digests
from stratafold.llm.mixing import sampled
from stratafold.llm.near_vectors import near_vectors
from stratafold.llm.packing import pack
from stratafold.llm.quality import quality
from stratafold.llm.repeats import WORDS, without_repeats
from stratafold.llm.secrets import secret_digests
from stratafold.llm.toxicity import toxicity
from stratafold.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"), passages=WORDS).drop("kept")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_secret_scan": op2_secret_scan,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_license_scan": op5_license_scan,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_repeats": op7_repeats,
        "op8_near_vectors": op8_near_vectors,
        "op9_toxicity": op9_toxicity,
        "op10_quality": op10_quality,
        "op11_alignment": op11_alignment,
        "op12_line_dedup": op12_line_dedup,
        "op13_whitening": op13_whitening,
    }


#: links: (a, b) both ways -> reach: what each document or vector reaches, itself included.
_REACH = "reach(id, there) AS (SELECT {id}, {id} FROM {table} UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.there)"

SQL = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, len(w) AS n_words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), runs AS (
  SELECT doc_id, n_words, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS e
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT DISTINCT doc_id, e FROM runs WHERE i <= greatest(1, n_words - 4)
), sizes AS (
  SELECT d.doc_id, count(e) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY 1
), common AS (
  SELECT e, row_number() OVER () AS k FROM (SELECT e FROM shingles GROUP BY e HAVING count(*) > 1)
), held AS (
  SELECT doc_id, n, k FROM shingles JOIN common USING (e) JOIN sizes USING (doc_id)
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM held x JOIN held y ON x.k = y.k AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY 1, 2
), linked AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), links AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), """ + _REACH.format(id="doc_id", table="documents") + """
SELECT sizes.doc_id, CAST(any_value(sizes.n) AS BIGINT) AS n_shingles, min(there) AS component_id FROM sizes JOIN reach ON reach.id = sizes.doc_id GROUP BY 1""",
    "op8_near_vectors": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), """ + _REACH.format(id="vec_id", table="embeddings") + """, counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY 1
), named AS (
  SELECT id, min(there) AS component_id FROM reach GROUP BY 1
)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM named LEFT JOIN counted ON a = id""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM src
), filled AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS fill FROM named
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER w, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM filled WINDOW w AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT *, first_value(CASE WHEN fill >= level THEN level END IGNORE NULLS) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final FROM levels
), targets AS (
  SELECT source, source_size, least(coalesce(weight * final, (3 * source_size)::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM chosen
), ranked AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) AS rank,
    (('0x' || substr(md5('17|' || coalesce('s' || s.source, 'n')), 1, 5))::BIGINT + 0.5)::DOUBLE / 1048576.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate * rank + u) - floor(rate * (rank - 1) + u)) * size AS BIGINT) AS taken FROM ranked""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_line_dedup": """
WITH lines AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 3
), told AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.top AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY r""",
}
