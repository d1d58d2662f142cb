"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import table
from .decontaminate import decontaminate
from .language_id import language_id, train_languages
from .license_scan import license_scan
from .line_dedup import line_verdicts
from .lm_score import lm_score
from .mixing import fit, mixing
from .ngram_join import ngram_join
from .quality_rules import learn_rules, quality_rules
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .toxicity import toxicity, train_toxicity
from .vector_codes import vector_codes


#: The mixture that op6 and the pipeline aim at: shares of the tokens by language and topic. Sources have none given: their own shares are evened out.
TARGETS = {
    "lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.15, "none": 0.02, "other": 0.03},
    "topic": {f"topic{k}": 0.125 for k in range(8)},
}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents"), min_chars=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, train_languages(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(fit(table(spark, sf_dir, "documents"), TARGETS))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, learn_rules(docs, table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_license_scan, op4_line_dedup, op5_language_id, op6_mixing, op7_quality_rules, op8_secret_scan, op9_lm_score, op10_ngram_join, op11_collocations, op12_substring_dedup, op13_vector_codes)}
#: Sets of 4-grams, links by counting the common ones, and components as the closure of the links.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(l) >= 4 THEN list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i+3], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) m ON m.id = s.doc_id"""

#: Phrases of one to three words by lists' slices, and their cuts.
_COLLOCATIONS = r"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS c FROM (SELECT lang, k, unnest(list_transform(range(1, len(l) - k + 2), lambda i: l[i : i + k - 1])) AS g FROM p, range(1, 4) r(k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND c >= 10),
s AS (SELECT x.lang, x.g, x.c AS a, y.c AS l, z.c AS r, i, (1000000 * CAST(x.c AS HUGEINT) * x.c) // (CAST(y.c AS HUGEINT) * z.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) x JOIN f y ON y.lang = x.lang AND y.g = x.g[:i] JOIN f z ON z.lang = x.lang AND z.g = x.g[i + 1 :]),
b AS (SELECT lang, g, a, l, r, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
d AS (SELECT lang, g, max(c) AS m FROM (SELECT lang, g[1:2] AS g, c FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], c FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b JOIN n ON n.lang = b.lang LEFT JOIN d ON d.lang = b.lang AND d.g = b.g WHERE len(b.g) = 3 OR coalesce(100 * m < 50 * a, true))
QUALIFY rank <= 2000"""

#: Windows as strings, and the words that a repeated one covers.
_SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
x AS (SELECT doc_id, i, l[i] AS word, CASE WHEN i + 49 <= len(l) THEN array_to_string(l[i : i + 49], ' ') END AS g FROM d, unnest(range(1, len(l) + 1)) u(i)),
m AS (SELECT doc_id, i, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM x),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, len(l)"""

#: Six Lloyd rounds, one common table each.
_LLOYD = (
    """WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM k, range(8) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS z FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),"""
    + "".join(
        f"""
a{i} AS MATERIALIZED (SELECT vec_id, label, p.part, x, min(struct_pack(d := CAST(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - z[j]) * (x[j] - z[j]))) AS BIGINT), e := e)) AS best FROM p JOIN c{i} c ON c.part = p.part GROUP BY vec_id, label, p.part, x),
s{i} AS MATERIALIZED (SELECT part, e, list((t - ((t % n) + n) % n) // n ORDER BY j) AS m FROM (SELECT part, best.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS t, count(*) AS n FROM a{i}, range(1, len(x) + 1) r(j) GROUP BY ALL) GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m, z) AS z FROM c{i} LEFT JOIN s{i} USING (part, e)),"""
        for i in range(6)
    )
    + """
a6 AS (SELECT vec_id, label, p.part, min(struct_pack(d := CAST(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - z[j]) * (x[j] - z[j]))) AS BIGINT), e := e)) AS best FROM p JOIN c6 c ON c.part = p.part GROUP BY vec_id, label, p.part),
r AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY part, e)) FROM c6) AS codebooks_sha256 FROM r"""
)

#: The other operators learn, or compare by methods that SQL has no form of; tests hold them against brute force and held-out truth.
ORACLE_SQL: dict[str, str] = {"op10_ngram_join": _NGRAM_JOIN, "op11_collocations": _COLLOCATIONS, "op12_substring_dedup": _SUBSTRINGS, "op13_vector_codes": _LLOYD}
