"""The registered query of each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.llm.common import materialise, table
from geomart.llm.decontam import leaks
from geomart.llm.linededup import remove_repeated_passages
from geomart.llm.merkle import lower_ascii, manifest, proof_text
from geomart.llm.mixing import mix_sources
from geomart.llm.ngramjoin import similar_documents
from geomart.llm.packing import pack, token_pieces
from geomart.llm.quality import resample
from geomart.llm.registry import register
from geomart.llm.substring import remove_repeated_windows
from geomart.llm.surrogates import replace_entities
from geomart.llm.tokenfile import read_token_file, write_token_file
from geomart.llm.topk import quantised, top_k
from geomart.llm.toxicity import fit, score_toxicity
from geomart.llm.trie import in_order, prefix_trie, turn_digests
from geomart.session import scratch_path

SEQUENCE_TOKENS = 2048
PACKED_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` in sequences of at most 2048 byte-level BPE ids."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=SEQUENCE_TOKENS)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, SEQUENCE_TOKENS).select(*PACKED_COLUMNS)


@register("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@register("op6_token_file")
def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm", "token_file")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    read = read_token_file(spark, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register(
    "op7_substring_dedup",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
            FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (s) WHERE doc_id > m),
    per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
               [w[p] for p in range(1, len(w) + 1) if NOT list_contains(ps, p)] END, ' '), '')) AS kept_sha256
    FROM d LEFT JOIN per USING (r)
    """,
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), width=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks(docs, table(spark, sf_dir, "benchmark"))


@register("op2_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(spark, table(spark, sf_dir, "documents"), sf_dir)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, table(spark, sf_dir, "labels"), F.col("quality") == 1)


@register("op1_quality_resampling")
def quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the resampling keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return good_documents(spark, docs, sf_dir).select("doc_id", "log_weight", "sample_key")


@register("op5_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs)


@register("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), width=5, threshold=0.8)


_VALID = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0"


@register(
    "op10_exact_top_k",
    f"""
    WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings WHERE {_VALID}),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"), scale=256)
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0), k=5)


@register("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels"), toxic=F.col("toxic") == 1, learn=~held_out)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op9_pii_surrogates")
def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key="surrogates-1")


# ---- mixing, manifest, prefix trie -----------------------------------------------

_SIZE = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


@register(
    "op11_mix_sources",
    f"""
    WITH d AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
    -- In the order in which sources reach their limit: what those before hold and weigh.
    f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
                 coalesce(sum(3 * source_size) OVER before, 0) AS held, coalesce(sum(weight) OVER before, 0) AS gone
          FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, 3 * source_size * (weights - gone) <= (total - held) * weight AS at_limit FROM f),
    r AS (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (at_limit), 0) AS rest,
                 max(weights) - coalesce(sum(weight) FILTER (at_limit), 0) AS share FROM l),
    t AS (SELECT source, source_size, CASE WHEN at_limit THEN CAST(3 * source_size AS DOUBLE)
                 ELSE CAST(rest AS DOUBLE) * weight / CAST(share AS DOUBLE) END AS target FROM l, r),
    u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS units,
                 CAST('0x' || substr(sha256('mix-1:' || coalesce(source, '')), 1, 6) AS BIGINT) AS start FROM t),
    p AS (SELECT doc_id, size, source_size, target, units, start,
                 row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS pos
          FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
    SELECT doc_id, size, source_size, target, size * (((units * pos + start) >> 24) - ((units * (pos - 1) + start) >> 24)) AS taken FROM p
    """,
)
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: CRC-32 of a decimal number, bit by bit from its rule.
_CRC_TABLE = """bits AS (SELECT CAST(i AS BIGINT) AS i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
      UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc_sql(number: str) -> str:
    letters = f"[CAST(ascii(x) AS BIGINT) for x in string_split(CAST({number} AS VARCHAR), '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {letters}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


@register(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE {_CRC_TABLE},
    leaves AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
                      {_leaf_sql("text")} AS leaf,
                      CASE WHEN {_crc_sql("doc_id")} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
               FROM documents, crc_table),
    low AS (SELECT lang, 0 AS lvl, idx, n, leaf AS digest FROM leaves
            UNION ALL SELECT lang, lvl + 1, idx // 8, max(n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lang, lvl, idx // 8),
    subs AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (SELECT 0 AS lvl, idx, n, digest FROM subs
             UNION ALL SELECT lvl + 1, idx // 8, max(n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 8),
    -- Every node with the siblings before and after it.
    sib AS (SELECT a.lang, 0 AS tree, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
                   coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
            FROM low a JOIN low b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8
            WHERE a.n > 1 GROUP BY ALL
            UNION ALL
            SELECT NULL, 1, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''),
                   coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
            FROM high a JOIN high b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL),
    path AS (SELECT v.doc_id, s.tree, s.lvl, s.l, s.r
             FROM leaves v JOIN sib s ON s.tree = 0 AND s.lang IS NOT DISTINCT FROM v.lang AND s.idx = v.idx // CAST(pow(8, s.lvl) AS BIGINT)
             UNION ALL
             SELECT v.doc_id, s.tree, s.lvl, s.l, s.r
             FROM leaves v JOIN subs g ON g.lang IS NOT DISTINCT FROM v.lang JOIN sib s ON s.tree = 1 AND s.idx = g.idx // CAST(pow(8, s.lvl) AS BIGINT)),
    step AS (SELECT doc_id, l, r, row_number() OVER (PARTITION BY doc_id ORDER BY tree, lvl) AS k FROM path),
    proof AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, max(k) AS height FROM step GROUP BY doc_id),
    fold AS (SELECT doc_id, 0 AS k, coalesce(other, leaf) AS digest FROM leaves
             UNION ALL SELECT fold.doc_id, fold.k + 1, sha256(step.l || fold.digest || step.r) FROM fold JOIN step ON step.doc_id = fold.doc_id AND step.k = fold.k + 1)
    SELECT v.doc_id, v.leaf, g.digest AS subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
           f.digest AS folded_root, f.digest = t.digest AS verified
    FROM leaves v JOIN subs g ON g.lang IS NOT DISTINCT FROM v.lang JOIN high t ON t.n = 1
    LEFT JOIN proof p ON p.doc_id = v.doc_id JOIN fold f ON f.doc_id = v.doc_id AND f.k = coalesce(p.height, 0)
    """,
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = manifest(docs, {"text": F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))}, arity=8)
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the conversations that op13 rebuilds: the first h
    turns of conversation c - c % 20, then c's own after its first h."""
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    turns = in_order(turn_digests(conversations))
    members = materialise(turns.select("conv_id").distinct(), "trie_members")
    own = turns.filter(F.col("place") >= opening)
    # At most three turns of a conversation, and at most 39 that ask for them.
    first = turns.filter((F.col("place") < 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed("conv_id", "base")
    lent = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), opening.alias("h")).join(first, "base").filter("place < h")
    return own.unionByName(lent.select(*own.columns)), members


@register(
    "op13_prefix_trie",
    f"""
    WITH RECURSIVE {_CRC_TABLE},
    o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
          FROM conversations WHERE conv_id IS NOT NULL),
    m AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
    b AS (SELECT m.conv_id, o.place, o.role, o.text FROM m JOIN o ON o.conv_id = m.base AND o.place < m.h
          UNION ALL SELECT m.conv_id, o.place, o.role, o.text FROM m JOIN o ON o.conv_id = m.conv_id AND o.place >= m.h),
    k AS (SELECT conv_id, row_number() OVER run AS depth, text,
                 string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER run AS key
          FROM b WINDOW run AS (PARTITION BY conv_id ORDER BY place)),
    paths AS (SELECT conv_id, depth, key, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words FROM k
              UNION ALL SELECT conv_id, 0, '', 0 FROM m),
    nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own FROM paths GROUP BY depth, key),
    ups AS (SELECT n.depth, n.key, p.key AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
    kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n FROM ups GROUP BY ALL),
    -- Every node under each of its ancestors and itself.
    under AS (SELECT a.depth, a.key, n.own, kids.n IS NULL AS leaf
              FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.key = n.key),
    sums AS (SELECT depth, key, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM under GROUP BY depth, key),
    ends AS (SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha
             FROM (SELECT conv_id, max(depth) AS depth, max_by(key, depth) AS key FROM paths GROUP BY conv_id) GROUP BY depth, key)
    SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
           coalesce(e.sha, sha256('')) AS ends_sha256
    FROM nodes n LEFT JOIN ups u ON u.depth = n.depth AND u.key = n.key LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.key = u.parent
    LEFT JOIN kids ON kids.depth = n.depth AND kids.key = n.key JOIN sums s ON s.depth = n.depth AND s.key = n.key
    LEFT JOIN ends e ON e.depth = n.depth AND e.key = n.key
    """,
)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = rebuilt_conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, members).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
