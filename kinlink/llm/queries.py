"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, graph_search, jaccard_join, language_id, license_scan, line_dedup, minhash, mixing, pitman_yor, token_counts, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]
#: The model's file; a parameter of the query.
MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path(MODEL)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return docs.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_graph_search": op3_graph_search,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _lines() -> str:
    return r"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id"""


def _windows() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win, least(len(w), 10) AS k FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _near(width: int, percent: int, more: str = "") -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {width - 1}) AS sh FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {width - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= {percent} * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id{more} FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)"""


def _phrases() -> str:
    return r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
b AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, list_slice(g, 1, 2) AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, list_slice(g, 2, 3), f FROM c WHERE k = 3) GROUP BY ALL),
x AS (SELECT c.* FROM c LEFT JOIN b ON c.lang = b.lang AND c.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * c.f),
u AS (SELECT x.lang, x.g, x.f AS a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * x.f * x.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM (SELECT x.*, unnest(generate_series(1, k - 1)) AS cut FROM x) x
      JOIN g l ON l.lang = x.lang AND l.k = cut AND l.g = list_slice(x.g, 1, cut) JOIN g r ON r.lang = x.lang AND r.k = x.k - cut AND r.g = list_slice(x.g, cut + 1, x.k)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS place FROM u),
o AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM t WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def _mix() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1.0::DOUBLE + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, n, w, false AS held, 0.0::DOUBLE AS target FROM s
  UNION ALL
  SELECT round + 1, source, n, w, held OR t > 3.0 * n, CASE WHEN held THEN 3.0 * n ELSE t END
  FROM (SELECT *, (sum(n::DOUBLE) OVER () - sum(CASE WHEN held THEN 3.0 * n ELSE 0.0 END) OVER ()) * w / sum(CASE WHEN held THEN 0.0 ELSE w END) OVER () AS t FROM fill)
  WHERE round <= (SELECT count(*) FROM s)),
goal AS (SELECT source, n, target FROM fill WHERE round = (SELECT max(round) FROM fill)),
r AS (SELECT d.*, goal.n AS source_size, goal.target AS target, row_number() OVER (PARTITION BY d.source ORDER BY size, hash, doc_id)::DOUBLE AS rank,
             CASE WHEN goal.n > 0 THEN goal.target / goal.n ELSE 0.0 END AS each,
             CAST('0x' || substr(md5(coalesce('s' || d.source, 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS off
      FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(rank * each + off) - floor((rank - 1) * each + off), 3) AS BIGINT) * size AS taken FROM r"""


def _licenses() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({quote(t)}, {quote(label)})" for t, label in license_scan.TEMPLATES.items())
    s = license_scan.STRIDE
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT label, string_split(phrase, ' ') AS ph FROM (VALUES {phrases}) AS v(phrase, label)),
x AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
hit AS (SELECT doc_id, label, i - 1 AS pos FROM x JOIN p ON w[i] = ph[1] AND list_slice(w, i, i + len(ph) - 1) = ph),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM hit GROUP BY doc_id),
t AS (SELECT label, list_distinct({_WORDS}) AS tw FROM (VALUES {templates}) AS v(text, label)),
blocks AS (SELECT doc_id, list_slice(w, b * {s} + 1, (b + 2) * {s}) AS bw FROM (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // {s})) AS b FROM d WHERE len(w) > 0)),
met AS (SELECT doc_id, label, max(len(list_intersect(bw, tw))::DOUBLE / len(tw)) AS c FROM blocks, t
        WHERE len(list_intersect(bw, tw)) >= ceil({license_scan.THRESHOLD} * len(tw) - 1e-9) GROUP BY doc_id, label),
names AS (SELECT doc_id, label, 1 AS base, 1.0::DOUBLE AS c FROM (SELECT DISTINCT doc_id, label FROM hit) UNION ALL SELECT doc_id, label, 0, c FROM met),
agg AS (SELECT doc_id, string_agg(DISTINCT CASE WHEN base = 1 THEN label END, ',' ORDER BY CASE WHEN base = 1 THEN label END) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM names GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN agg USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_license_scan": _licenses(),
    "op5_line_dedup": _lines(),
    "op6_decontaminate": _windows(),
    "op8_jaccard_join": _near(5, 75),
    "op9_mixing": _mix(),
    "op11_minhash_dedup": _near(2, 80, ", d.doc_id = component_id AS kept"),
    "op12_collocations": _phrases(),
}
