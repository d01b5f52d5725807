"""The registered queries of the package, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bucket_refine, byte_cnn, elias_fano, exact_dedup, fill_middle, jump_shards, kneser_ney, license_rules, maxscore,
               prefix_trie, raking, simhash, vector_fit)
from .store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


LOWERED = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query("op10_exact_dedup", f"""
    WITH n AS (SELECT doc_id, {LOWERED} AS norm FROM documents),
         g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    return (exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")))


@query("op3_jump_shards")
def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards by its id, and where it goes when a ninth is appended."""
    return jump_shards.assign_shards(table(spark, sf_dir, "documents"), 8)


@query("op9_simhash_bit_sliced")
def op9_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document over 3-word shingles, and the components of links at two bits or fewer."""
    return simhash.near_components(table(spark, sf_dir, "documents"))


@query("op7_elias_fano_ids")
def op7_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in ascending order and read back."""
    parts = elias_fano.write_parts(table(spark, sf_dir, "documents"), elias_fano.tokenizer_path("byte_bpe_50k.json"), 2, True)
    return elias_fano.read_documents(parts)


@query("op8_vector_best_fit")
def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return vector_fit.pack_documents(table(spark, sf_dir, "documents"), elias_fano.tokenizer_path("word_bpe_49k.json"), False)


@query("op4_kneser_ney_quality")
def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether its language's threshold keeps it."""
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _raking_sql() -> str:
    """Raking and the search for the factor, unrolled."""
    margins = list(raking.MARGINS)
    steps = [f"""
        d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
                CASE WHEN {LOWERED} LIKE '%license%' OR {LOWERED} LIKE '%copyright%' THEN 'legal'
                     WHEN {LOWERED} LIKE '%@%' OR {LOWERED} LIKE '%http%' THEN 'contact'
                     WHEN {LOWERED} LIKE '% | %' THEN 'table'
                     WHEN strlen(coalesce(text, '')) >= 8192 THEN 'long' ELSE 'prose' END AS topic,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
        c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
        t AS (SELECT sum(tokens) AS total FROM c)"""]
    for m, power in raking.MARGINS.items():
        steps.append(f"""g_{m}_0 AS (SELECT {m}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS share,
                         sum(tokens) / sum(sum(tokens)) OVER () / {raking.KEEP} AS cap FROM c GROUP BY {m})""")
        for i in range(raking.ROUNDS):
            name = f"g_{m}_{i + 1}" if i + 1 < raking.ROUNDS else f"g_{m}"
            steps.append(f"""{name} AS MATERIALIZED (SELECT {m}, cap, CASE WHEN share >= cap THEN cap ELSE share * coalesce(
                             (1 - coalesce(sum(cap) FILTER (share >= cap) OVER (), 0)) / nullif(sum(share) FILTER (share < cap) OVER (), 0), 1) END AS share
                             FROM g_{m}_{i})""")
    steps.append("w0 AS (SELECT c.*, tokens AS weight FROM c)")
    k = 0
    for _ in range(raking.PASSES):
        for m in margins:
            steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight, most, goal, full_, all_, held, free), CASE WHEN goal / nullif(all_, 0) <= 1
                             THEN weight * (goal / all_) WHEN full_ THEN most ELSE coalesce(least(most, weight * (goal - coalesce(held, 0)) / nullif(free, 0)), 0) END AS weight
                             FROM (SELECT *, sum(weight) OVER (PARTITION BY {m}) AS all_, sum(weight) FILTER (full_) OVER (PARTITION BY {m}) AS held,
                             sum(weight) FILTER (NOT full_) OVER (PARTITION BY {m}) AS free FROM (SELECT w.*, tokens / {raking.KEEP} AS most, share * total AS goal,
                             weight >= tokens / {raking.KEEP} * (1 - 1e-9) AS full_ FROM w{k} w JOIN g_{m} USING ({m}), t)))""")
            k += 1
    steps.append("f0 AS (SELECT 0.0::DOUBLE AS factor)")
    for i in range(12):
        steps.append(f"""f{i + 1} AS MATERIALIZED (SELECT greatest(factor, coalesce(({raking.KEEP} * total - full_) / nullif(rest, 0), 0)) AS factor FROM f{i}, t,
            (SELECT coalesce(sum(tokens) FILTER (factor * weight / nullif(tokens, 0) >= 1), 0) AS full_,
                    coalesce(sum(weight) FILTER (NOT coalesce(factor * weight / nullif(tokens, 0) >= 1, false)), 0) AS rest FROM w{k}, f{i}))""")
    steps.append(f"""p AS (SELECT w.*, coalesce(least(1.0, factor * weight / nullif(tokens, 0)), 1.0) AS probability,
                         coalesce(weight / nullif(tokens, 0), 0.0) AS per_token FROM w{k} w, f12)""")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id, source, lang, topic, d.tokens, round(per_token, 6) AS weight, round(probability, 6) AS probability,
               d.tokens = 0 OR ('0x' || substr(md5(doc_id || ':{raking.SEED}'), 1, 13))::BIGINT / 4503599627370496.0 < probability AS selected
        FROM d JOIN p USING (source, lang, topic)"""


@query("op1_ipf_mixing", _raking_sql())
def op1_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion probabilities raked to flattened source, language and topic shares, and the documents drawn by them."""
    return raking.mixed(table(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 6) for c in ("weight", "probability")})


@query("op5_maxscore_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_license_rules")
def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of every document."""
    return license_rules.summarise(table(spark, sf_dir, "documents"))


@query("op2_bucket_refinement")
def op2_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 50-byte strings of documents before it."""
    found = bucket_refine.repeated_spans(table(spark, sf_dir, "documents"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op11_framed_fill_middle", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
         k AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
                      ('0x' || h[25:32])::BIGINT AS h4 FROM d),
         c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
         p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""")
def op11_framed_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and the digest of the text rebuilt from the output."""
    outputs = fill_middle.transform(fill_middle.framed(table(spark, sf_dir, "documents")))
    found = fill_middle.digests(outputs)
    return found.select(F.col("id").cast("long").alias("doc_id"), *found.columns[1:])


@query("op12_byte_cnn_language")
def op12_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a byte network that has not seen the third of them held out."""
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""


@query("op13_conversation_trie", f"""
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
         l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS turns
               FROM t GROUP BY c),
         h AS (SELECT c, turns, xor({_CRC}, 4294967295) % 9 AS h FROM l),
         r AS (SELECT h.c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS seq FROM h LEFT JOIN l b ON b.c = h.c - h.c % 5),
         p AS (SELECT c, len(seq) AS n, d, md5(to_json(seq[1:d])::VARCHAR) AS node, md5(to_json(seq[1:d - 1])::VARCHAR) AS parent,
                      CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS bytes FROM r, unnest(range(0, len(seq) + 1)) u(d)),
         n AS (SELECT d, node, min(c) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes,
                      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, node),
         k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
         s AS (SELECT p.d, p.node, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
               FROM n LEFT JOIN k USING (d, node) JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
           s.saved_tokens, n.ends_sha256
    FROM n JOIN s USING (d, node) LEFT JOIN k USING (d, node) LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.node = n.parent
""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix that rebuilt conversations share, with what is stored once instead of once a member."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop(*prefix_trie.WORDS)
