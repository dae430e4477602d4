"""The registered queries of this subpackage and their SQL twins (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_mincut, langid, license_join, line_dedup, merkle, minhash, nn_descent, packing, prefix_trie, substring_index, toxicity, warc, wu_manber


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), share=85)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_mincut.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(_table(spark, sf_dir, "documents"))


def license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 with stretches of the whole text as blocks, for notices that are wrapped over lines."""
    return license_join.scan_windows(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), wu_manber.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), rows=_remainder(4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "sentences")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.train(docs.withColumn("held_out", _remainder(5) == 0).where("not held_out"))
    out = langid.classify(docs, learned)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substring_index.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(_remainder(7) == 0, F.try_add("n_chars", F.lit(1).cast("long"))).otherwise(F.col("n_chars"))
    claimed = merkle.leaf_digest(columns, {"n_chars": tampered})
    return merkle.manifest(_table(spark, sf_dir, "documents"), columns=columns, claimed=claimed).verified()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_PHRASES = ", ".join(f"({len(p.split())}, '{p}', '{label}')" for p, label in license_join.PHRASES.items())
_STRETCHES = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {-(-125 * len(t.split()) // 100)})" for k, (t, label) in enumerate(license_join.TEMPLATES.items()))
_TEMPLATES = ", ".join(f"('{label}', {sorted(set(t.split()))})" for t, label in license_join.TEMPLATES.items())



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB, which has no such function: bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)), 4294967295), 4294967295)"


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_BASE32 = "array_to_string(flatten(list_transform(range(0, 8), lambda i: list_transform([15, 10, 5, 0], lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || h[5 * i + 1:5 * i + 5])::BIGINT >> b) & 31) + 1)::BIGINT]))), '')"
_PAIRS = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"

#: DuckDB twins of the queries that SQL can express.
ORACLES = {
    "op1_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS h FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        common AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1),
        sh AS (SELECT s.* FROM s JOIN common USING (h)),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op3_license_scan": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT * FROM (VALUES {_PHRASES}) t(m, phrase, label)), t AS (SELECT * FROM (VALUES {_TEMPLATES}) t(label, own)),
        g AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p)),
        b AS (SELECT doc_id, k - 1 AS k, label FROM g JOIN p ON p.m = g.m AND array_to_string(w[k:k + g.m - 1], ' ') = phrase),
        n AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word FROM b GROUP BY 1),
        l AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "line")} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
        sv AS (SELECT k AS template, label, len(own) AS n, size, unnest(own) AS word FROM (VALUES {_STRETCHES}) t(k, label, own, size)),
        se AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1)::BIGINT AS i FROM d),
        sh AS (SELECT doc_id, label, n, count(DISTINCT word) OVER (PARTITION BY doc_id, template ORDER BY i RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS c FROM se JOIN sv USING (word)),
        x AS (SELECT doc_id, label, len(list_intersect(list_distinct(w), own)) / len(own) AS c FROM l, t WHERE 100 * len(list_intersect(list_distinct(w), own)) >= 80 * len(own)
            UNION ALL SELECT doc_id, label, c / n FROM sh WHERE 100 * c >= 80 * n),
        best AS (SELECT doc_id, max(c) AS c FROM x GROUP BY 1),
        bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY 1),
        al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM x) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)""",
    "license_windows": f"""
        WITH t AS (SELECT k, label, own, len(own) AS n, size FROM (VALUES {_STRETCHES}) t(k, label, own, size)), v AS (SELECT k, label, n, size, unnest(own) AS word FROM t),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1)::BIGINT AS i FROM d),
        h AS (SELECT doc_id, k, label, n, count(DISTINCT word) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS c FROM e JOIN v USING (word)),
        x AS (SELECT doc_id, label, c / n AS c FROM h WHERE 100 * c >= 80 * n),
        best AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM x GROUP BY 1)
        SELECT doc_id, coalesce(labels, '') AS labels, coalesce(c, 0.0)::DOUBLE AS containment FROM documents LEFT JOIN best USING (doc_id)""",
    "op4_decontamination": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS t FROM i WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT m FROM p),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, sizes)),
        hit AS (SELECT doc_id, g.m, k, item_id FROM g JOIN p ON p.m = g.m AND p.t = g.t),
        n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM hit) GROUP BY 1),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
        keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        often AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
        told AS (SELECT keyed.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM keyed LEFT JOIN often USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY 1""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: (x IS NULL OR NOT isfinite(x))::INT), 'sum') = 0 AND list_aggregate(list_transform(embedding, lambda x: (x <> 0)::INT), 'sum') > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id)""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
        f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS x FROM g JOIN f USING (h) WHERE doc_id > first),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d),
        kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.x) AS t, count(*) AS n FROM each ANTI JOIN gone ON gone.doc_id = each.doc_id AND gone.x = each.x GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_warc_archive": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM p""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, strlen(coalesce(text, '')) AS n, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT c, c - c % 5 AS base, {_crc32("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
        u AS (SELECT h.c, k, n, x FROM h JOIN t ON t.c = base AND k <= h UNION ALL SELECT h.c, k + 1000000, n, x FROM h JOIN t USING (c) WHERE k > h),
        s AS (SELECT c, list(x ORDER BY k) AS xs, list(n ORDER BY k) AS ns FROM u GROUP BY 1),
        a AS (SELECT c, coalesce(xs, []) AS xs, coalesce(ns, []) AS ns FROM h LEFT JOIN s USING (c)),
        p AS (SELECT c, d, array_to_string(xs[:d], '') AS prefix, len(xs) AS deep, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM a)),
        node AS (SELECT d, prefix, min(c) AS low, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (deep = d), '') AS ends, max(deep) = d AS leaf FROM p GROUP BY 1, 2),
        m AS (SELECT p.c, p.d, low FROM p JOIN node USING (d, prefix)),
        v AS (SELECT node.*, m.low AS parent FROM node LEFT JOIN m ON m.c = node.low AND m.d = node.d - 1),
        kids AS (SELECT parent AS low, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
        sub AS (SELECT m.low, m.d, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM node JOIN m ON m.c = node.low AND m.d <= node.d GROUP BY 1, 2)
        SELECT v.low AS conv_id, v.d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
        FROM v JOIN sub ON sub.low = v.low AND sub.d = v.d LEFT JOIN kids ON kids.low = v.low AND kids.d = v.d""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE l AS (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE {_LEAF} END AS claim FROM documents),
        r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM l),
        t AS (SELECT lang, 0 AS level, list(leaf ORDER BY k) AS nodes FROM r GROUP BY lang UNION ALL SELECT lang, level + 1, {_PAIRS} FROM t WHERE len(nodes) > 1),
        s AS (SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM t WHERE len(nodes) = 1),
        u AS (SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM s UNION ALL SELECT level + 1, {_PAIRS} FROM u WHERE len(nodes) > 1),
        top AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
        steps AS (SELECT id, level, nodes, k FROM r JOIN t ON r.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1
            UNION ALL SELECT id, height + level, nodes, s.k << height FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, u WHERE len(nodes) > 1),
        e AS (SELECT id, level, (k >> level) & 1 AS side, coalesce(nodes[xor(k >> level, 1) + 1], '') AS sibling FROM steps),
        p AS (SELECT id, string_agg(sibling, '' ORDER BY level) AS siblings, list(side || sibling ORDER BY level) AS path FROM e GROUP BY 1),
        f AS (SELECT r.*, coalesce(siblings, '') AS siblings, list_reduce(coalesce(path, []), lambda a, e: CASE WHEN e[1] = '1' THEN sha256(e[2:] || a) ELSE sha256(a || e[2:]) END, claim) AS folded_root FROM r LEFT JOIN p USING (id))
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang, top""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash, op2_html_text, op3_license_scan, license_windows, op4_decontamination, op5_toxicity, op6_line_dedup, op7_language, op8_embedding_dedup, op9_packing, op10_substring_dedup, op11_warc_archive, op12_prefix_trie, op13_merkle_manifest, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
