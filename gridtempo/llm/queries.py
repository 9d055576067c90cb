"""The queries of this subpackage's operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, centroids, chat, decontamination, html_text, language, minhash, mixing, pareto, quality, sharding, simhash, substrings
from ._shared import crc_mod, read


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"), out="kept_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "title", "text")


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_chats(told.unionByName(added)))


def op7_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, crc_mod("doc_id", 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (crc_mod("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = brown.scored(read(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "matched", "width")


def op11_pareto_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pareto.layered(pareto.offers(*[read(spark, sf_dir, t) for t in ("sale_lines", "sales", "items")]))
    return found.select("item_id", "vendor_id", "part_type", "price", "discount", "delay", "quantity", "type_layer", "global_layer", "n_equal")


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"))
    # Without a null on either side; a row whose id and component are both null is its own.
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.report(*centroids.cluster(read(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_suffix_trees": op3_suffix_trees,
    "op4_layout_text": op4_layout_text,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_chat_round_trip": op6_chat_round_trip,
    "op7_word_backoff": op7_word_backoff,
    "op8_brown_classes": op8_brown_classes,
    "op9_isolation_forest": op9_isolation_forest,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_pareto_layers": op11_pareto_layers,
    "op12_circulant_minhash": op12_circulant_minhash,
    "op13_partial_distance": op13_partial_distance,
}

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '</turn>', '\e'), '### ', '\h')"
_OP6 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
), escaped AS (
  SELECT *, length('### : </turn>' || chr(10)) + length(replace({_ESCAPED.format("role")}, ': ', '\c')) + length({_ESCAPED.format("text")}) AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, true AS exact
FROM escaped GROUP BY conv_id
"""


def _apportioned(name: str, parts: str, by: str, weight: str, seats: str, order: str, out: str) -> str:
    """CTEs ``name``: Sainte-Lague quotas of the rows of ``parts``."""
    over = f"(PARTITION BY {by})" if by else "()"
    keys = f"{by}, {order}" if by else order
    return f"""
{name}_b AS (
  SELECT *, CASE WHEN {weight} > 0 THEN CAST(greatest(0, floor(n * {weight} / w - k / 2 * {weight} / w + 0.5) - 1) AS BIGINT) ELSE 0 END AS low,
    CASE WHEN {weight} > 0 THEN CAST(ceil(n * {weight} / w + k / 2 * {weight} / w + 0.5) + 1 AS BIGINT) ELSE 0 END AS high
  FROM (SELECT *, sum({weight}) OVER {over} AS w, CAST(count(*) FILTER ({weight} > 0) OVER {over} AS DOUBLE) AS k, CAST({seats} AS DOUBLE) AS n FROM {parts})
), {name}_o AS (SELECT *, {seats} - sum(low) OVER {over} AS open FROM {name}_b
), {name}_s AS (SELECT {keys}, {weight}, open, unnest(range(low, high + 1)) AS s FROM {name}_o WHERE {weight} > 0
), {name}_w AS (
  SELECT {keys}, count(*) AS won FROM (
    SELECT *, row_number() OVER ({f"PARTITION BY {by} " if by else ""}ORDER BY CAST({weight} AS DOUBLE) / (2 * s + 1) DESC, {order}) AS r FROM {name}_s) WHERE r <= open GROUP BY ALL
), {name} AS (SELECT o.* EXCLUDE (w, k, n, low, high, open), low + coalesce(won, 0) AS {out} FROM {name}_o o LEFT JOIN {name}_w USING ({keys}))"""


_OP1 = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest, greatest(1, least({mixing.MOST_CELLS}, (count(*) OVER () + {mixing.CELL_ROWS - 1}) // {mixing.CELL_ROWS})) AS cells
  FROM documents
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY src, cell ORDER BY digest, size ROWS UNBOUNDED PRECEDING) AS fin FROM (SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % cells AS cell FROM d)
), whole AS (
  SELECT src, cell, sum(size) AS words, CAST(ceil(sum(size) / {mixing.BLOCK_WORDS}) AS BIGINT) AS blocks FROM placed GROUP BY ALL
), source AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight FROM (SELECT src, sum(words) AS source_size, sum(blocks) AS source_blocks FROM whole GROUP BY src)
), fill AS (
  SELECT *, row_number() OVER f AS pos, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM source WINDOW f AS (ORDER BY 3 * source_size / weight, weight, src)
), level AS (SELECT pos AS first_pos, rest AS l, share AS s FROM fill WHERE 3 * source_size * share >= rest * weight ORDER BY pos LIMIT 1
), claims AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * source_blocks / source_size ELSE 0.0 END AS claim
  FROM (SELECT src, source_size, source_blocks, CASE WHEN pos >= first_pos THEN CAST(l * weight AS DOUBLE) / CAST(s AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM fill, level)
), seated AS (SELECT *, CAST(round(sum(claim) OVER ()) AS BIGINT) AS seats FROM claims
), {_apportioned("quota1", "seated", "", "claim", "seats", "src", "source_quota")}
, cellq AS (SELECT whole.*, source_size, target, source_quota FROM whole JOIN quota1 USING (src)
), {_apportioned("quota2", "cellq", "src", "blocks", "source_quota", "cell", "quota")}
, lined AS (
  SELECT *, least(quota, 3 * blocks) // greatest(blocks, 1) AS passes, least(quota, 3 * blocks) % greatest(blocks, 1) AS rest, greatest(blocks, 1) AS n,
    CAST('0x' || substr(md5('mix:' || src || ':' || CAST(cell AS VARCHAR)), 1, 8) AS BIGINT) % greatest(blocks, 1) AS off
  FROM placed JOIN quota2 USING (src, cell)
), ends AS (
  SELECT *, fin // {mixing.BLOCK_WORDS} AS b1, (fin - size) // {mixing.BLOCK_WORDS} AS b0 FROM lined
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(passes * size
    + ((b1 + off) * rest // n - off * rest // n) * {mixing.BLOCK_WORDS} + ((b1 + 1 + off) * rest // n - (b1 + off) * rest // n) * (fin - b1 * {mixing.BLOCK_WORDS})
    - ((b0 + off) * rest // n - off * rest // n) * {mixing.BLOCK_WORDS} - ((b0 + 1 + off) * rest // n - (b0 + off) * rest // n) * (fin - size - b0 * {mixing.BLOCK_WORDS}) AS BIGINT) AS taken
FROM ends
"""


def _op13() -> str:
    """Vectors as rows of (n, d, x); each round assigns by sums over d and moves centroids to floored means."""
    head = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) AS n, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), x AS (
  SELECT n, unnest(range(64)) AS d, unnest(list_transform(embedding, lambda e: CAST(greatest(-134217728, least(134217728, floor(64 * CAST(e AS DOUBLE)))) AS BIGINT))) AS x FROM v
), c0 AS (SELECT CAST(n - 1 AS INT) AS j, d, x AS c FROM x WHERE n <= 16)"""
    near = """, a{r} AS (
  SELECT n, arg_min(j, (dist, j)) AS j, min(dist) AS dist FROM (SELECT n, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS dist FROM x JOIN c{r} USING (d) GROUP BY n, j) GROUP BY n
)"""
    move = """, m{r} AS (SELECT j, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM x JOIN a{r} USING (n) GROUP BY j, d
), c{s} AS (SELECT j, d, CASE WHEN k IS NULL THEN c ELSE (s - ((s % k) + k) % k) // k END AS c FROM c{r} LEFT JOIN m{r} USING (j, d))"""
    steps = "".join(near.format(r=r) + move.format(r=r, s=r + 1) for r in range(3)) + near.format(r=3)
    return head + steps + """
SELECT vec_id, j AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN v USING (n) JOIN (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY j) USING (j)
"""


#: A chain grows by one offer a round; a vector's layer is the longest chain that ends with it.
_OP11 = """
WITH RECURSIVE l AS (
  SELECT *, CAST(floor(100 * amount + 0.5) AS BIGINT) AS c, CAST(floor(100 * discount + 0.5) AS BIGINT) AS d FROM sale_lines LEFT JOIN (SELECT sale_id, min(sold_at) AS sold FROM sales GROUP BY 1) USING (sale_id)
  WHERE item_id IS NOT NULL AND vendor_id IS NOT NULL
), s AS (
  SELECT item_id, vendor_id, CAST(sum(c * (100 - d)) FILTER (quantity IS NOT NULL) AS BIGINT) AS worth, CAST(sum(quantity) FILTER (c IS NOT NULL AND d IS NOT NULL) AS BIGINT) AS bought,
    CAST(sum(d) AS BIGINT) AS d, count(d) AS nd, CAST(sum(date_diff('day', CAST(sold AS DATE), CAST(shipped_at AS DATE))) AS BIGINT) AS days,
    count(date_diff('day', CAST(sold AS DATE), CAST(shipped_at AS DATE))) AS ndays, max(quantity) AS quantity
  FROM l GROUP BY 1, 2
), i AS (SELECT item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p, kind FROM items
), o AS (
  SELECT item_id, vendor_id, kind AS part_type, CASE WHEN p >= 1 THEN (worth - ((worth % nullif(p * bought, 0)) + p * bought) % (p * bought)) // (p * bought) END AS price,
    (d - ((d % nullif(nd, 0)) + nd) % nd) // nd AS discount, (days - ((days % nullif(ndays, 0)) + ndays) % ndays) // ndays AS delay, CAST(quantity AS BIGINT) AS quantity
  FROM s LEFT JOIN i USING (item_id)
), k AS (
  SELECT *, coalesce(price, 9e15) AS x1, coalesce(-discount, 9e15) AS x2, coalesce(delay, 9e15) AS x3, coalesce(-quantity, 9e15) AS x4, coalesce('t' || part_type, 'n') AS scope FROM o
), v AS (
  SELECT DISTINCT scope, x1, x2, x3, x4 FROM k UNION ALL SELECT DISTINCT 'g', x1, x2, x3, x4 FROM k
), chain AS (
  SELECT *, 1 AS layer FROM v
  UNION
  SELECT v.*, layer + 1 FROM chain u JOIN v ON u.scope = v.scope AND u.x1 <= v.x1 AND u.x2 <= v.x2 AND u.x3 <= v.x3 AND u.x4 <= v.x4 AND (u.x1 < v.x1 OR u.x2 < v.x2 OR u.x3 < v.x3 OR u.x4 < v.x4) WHERE layer <= 24
), layers AS (SELECT scope, x1, x2, x3, x4, CASE WHEN max(layer) > 24 THEN 0 ELSE max(layer) END AS layer FROM chain GROUP BY ALL)
SELECT item_id, vendor_id, part_type, price, discount, delay, quantity, CAST(t.layer AS BIGINT) AS type_layer, CAST(g.layer AS BIGINT) AS global_layer, count(*) OVER (PARTITION BY x1, x2, x3, x4) AS n_equal
FROM k JOIN layers t USING (scope, x1, x2, x3, x4) JOIN (SELECT * EXCLUDE (scope) FROM layers WHERE scope = 'g') g USING (x1, x2, x3, x4)
"""
#: All pairs of distinct sets that share a shingle, by an inverted list; components by the smallest id that reaches a set.
_OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS sh FROM d
), f AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) ELSE 'empty ' || CAST(doc_id AS VARCHAR) END AS fp, sh FROM s
), sets AS (SELECT fp, min(doc_id) AS least, any_value(n) AS n, any_value(sh) AS sh FROM f GROUP BY fp
), inv AS (SELECT fp, n, unnest(sh) AS g FROM sets
), links AS (
  SELECT a.fp AS a, b.fp AS b FROM inv a JOIN inv b ON a.g = b.g AND a.fp < b.fp AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.fp, b.fp, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT fp, least AS root FROM sets
  UNION
  SELECT b, root FROM reach JOIN both_ways ON fp = a
), named AS (SELECT fp, min(root) AS component_id FROM reach GROUP BY fp)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, doc_id IS NULL AND component_id IS NULL) AS kept FROM f JOIN named USING (fp)
"""
ORACLE_SQL: dict[str, str] = {"op12_circulant_minhash": _OP12, "op11_pareto_layers": _OP11, "op13_partial_distance": _op13(), "op1_mix_sources": _OP1, "op6_chat_round_trip": _OP6}
