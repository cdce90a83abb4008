"""Registered queries of the operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumetrics.llm import (
    decontamination, embedding_dedup, langid, merkle, mixing, packing, prefix_trie, secret_scan, simhash, suffix_dedup,
    topk_search, toxicity, url_filter,
)
from plumetrics.llm.common import fold, table

# The rules of the URL query.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_hits")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), with_bytes=False)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("group")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    profiles = langid.learn(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = len(secret_scan.BASE)
    own = F.filter("found", lambda s: s["kind"] < base)
    # ``filter`` gives a second parameter of its function the place in the array, so the kind is bound outside.
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(own), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("found")).alias("spans"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=fold("doc_id", 3) == 0).drop("proof")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_topk_search, op3_suffix_dedup, op4_embedding_dedup, op5_packing, op6_mixing, op7_url_filter,
        op8_simhash, op9_langid, op10_secret_scan, op11_decontamination, op12_merkle_manifest, op13_prefix_trie, pipeline,
    )
}


def _url_sql() -> str:
    """Rules and vocabulary as SQL text."""
    fits = "(h.host = '{0}' OR ends_with(h.host, '.{0}')) AND starts_with(h.path, '{1}')"
    longest = sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
    rule, verdict = (
        "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{getattr(r, what)}'" for r in longest) + " END"
        for what in ("name", "verdict"))
    known = url_filter.vocabulary(url_filter.STRICT, url_filter.SOFT)
    terms = ", ".join(f"('{form}', '{term}', {int(strict)})" for form, (term, strict) in known.items())
    # Patterns are only tried on urls that contain the form at all.
    hit = ("CASE WHEN contains(p.words, t.form) THEN "
           "regexp_matches(p.words, '[^\\p{L}\\p{N}]' || t.form || '[^\\p{L}\\p{N}]') ELSE false END")
    return f"""
WITH terms(form, term, strict) AS (VALUES {terms}),
one AS (
  SELECT row_number() OVER () AS no, page_id, url, ' ' || lower(url_decode(coalesce(url, ''))) || ' ' AS words FROM pages),
found AS (SELECT p.no, t.term, t.strict FROM one p, terms t WHERE {hit}),
hits AS (
  SELECT p.page_id, p.url, count(DISTINCT f.term) FILTER (f.strict = 1) AS s,
    count(DISTINCT f.term) FILTER (f.strict = 0) AS w
  FROM one p LEFT JOIN found f USING (no) GROUP BY p.no, p.page_id, p.url),
h AS (
  SELECT page_id, s, w,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM hits)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN s > 0 OR w >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(s AS INTEGER) AS strict_hits, CAST(w AS INTEGER) AS soft_hits
FROM h"""


def _crc32_sql(number: str) -> str:
    """crc32 of a number's decimal text, bit by bit; that of an empty text where it is null."""
    start = "4294967295::BIGINT"
    bit = "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda x, y: list_reduce([xor(x, y), 0, 1, 2, 3, 4, 5, 6, 7], {bit})"
    codes = f"[ascii(c)::BIGINT FOR c IN string_split(CAST({number} AS VARCHAR), '')]"
    return f"coalesce(xor(list_reduce([{start}] || {codes}, {byte}), 4294967295), 0)"


def _window_sql() -> str:
    """Every window of every item against every stretch of words."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
pos AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
hit AS MATERIALIZED (SELECT r, n, p, item FROM pos JOIN win USING (win, n)),
covered AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
held AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)"""


def _merkle_sql(levels: int = 9) -> str:
    """Level by level for all trees at once; at most ``levels`` levels below a subroot and as many above."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    now = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tower(name: str, source: str) -> str:
        steps = [f"{name}0 AS MATERIALIZED ({source})"]
        for k in range(levels):
            # A tree of one node stays as it is.
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT tree, spot // 8 AS spot, CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY spot)) END AS h,
    (any_value(total) + 7) // 8 AS total, any_value(total) > 1 AS made FROM {name}{k} GROUP BY tree, spot // 8)""")
        return ",\n".join(steps)

    def climb(name: str, nodes: str, source: str) -> str:
        steps = [f"{name}0 AS MATERIALIZED ({source})"]
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT c.r, c.tree, c.spot // 8 AS spot,
    any_value(c.proof) || coalesce(string_agg(n.h, '' ORDER BY n.spot) FILTER (WHERE n.spot <> c.spot AND n.total > 1), '') AS proof,
    CASE WHEN any_value(n.total) = 1 THEN any_value(c.now)
      ELSE sha256(string_agg(CASE WHEN n.spot = c.spot THEN c.now ELSE n.h END, '' ORDER BY n.spot)) END AS now
  FROM {name}{k} c JOIN {nodes}{k} n ON n.tree = c.tree AND n.spot // 8 = c.spot // 8 GROUP BY c.r, c.tree, c.spot)""")
        return ",\n".join(steps)

    return f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, {leaf('text')} AS h,
    CASE WHEN {_crc32_sql('doc_id')} % 3 = 0 THEN {leaf(now)} ELSE {leaf('text')} END AS now FROM documents),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS total
  FROM leaves),
{tower('n', 'SELECT tree, spot, h, total, false AS made FROM placed')},
{tower('m', f'SELECT 0 AS tree, tree AS spot, h, count(*) OVER () AS total, false AS made FROM n{levels}')},
{climb('c', 'n', "SELECT r, tree, spot, '' AS proof, now FROM placed")},
{climb('e', 'm', f'SELECT r, 0 AS tree, tree AS spot, proof, now FROM c{levels}')}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.now AS folded_root, e.now = t.h AS verified
FROM placed p JOIN n{levels} s USING (tree) JOIN e{levels} e USING (r) CROSS JOIN (SELECT h FROM m{levels}) t"""


def _trie_sql() -> str:
    """Every prefix of every conversation as a list of turns; subtrees by comparing prefixes."""
    return f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, {_crc32_sql('conv_id')} % 6 AS h FROM t),
kept AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
whole AS MATERIALIZED (
  SELECT c.conv_id, coalesce(list(strlen(k.role) || ':' || k.role || k.text ORDER BY part, place) FILTER (WHERE k.part IS NOT NULL), []) AS turns,
    coalesce(list(length(k.text) ORDER BY part, place) FILTER (WHERE k.part IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN kept k USING (conv_id) GROUP BY c.conv_id),
steps AS (SELECT conv_id, turns, sizes, unnest(range(0, len(turns) + 1)) AS depth FROM whole),
nodes AS MATERIALIZED (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[depth]), 0) AS size,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends
  FROM steps GROUP BY turns[1:depth], depth),
tips AS MATERIALIZED (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children FROM nodes n),
-- Every node once for each node above it, itself included.
above AS (SELECT path[1:up] AS path, n_children, n_convs, size FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM tips)),
below AS (SELECT path, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM above GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM tips n JOIN below b USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1] AND p.depth = n.depth - 1"""


ORACLES: dict[str, str] = {
    "op11_decontamination": _window_sql(), "op12_merkle_manifest": _merkle_sql(), "op13_prefix_trie": _trie_sql(),
    "op7_url_filter": _url_sql(),
    # Every score of every query, without cutoffs.
    "op2_topk_search": """
WITH v AS MATERIALIZED (
  SELECT vec_id, e, row_number() OVER () AS no FROM (
    SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
scored AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(
    CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id IS NOT NULL AND c.no <> q.no),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
