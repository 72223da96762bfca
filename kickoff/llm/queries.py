"""The registered queries of this package, by operator number, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, fingerprints, jaccard_join, packing, prefix_trie, quality_knn, quality_rules, secrets, sharding, source_divergence, substring_dedup,
    token_counts, toxicity)
from .common import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a smaller document has too."""
    return substring_dedup.remove_repeats(documents(spark, sf_dir), 50, with_text=False).drop("kept", "n_spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 13-word windows of the benchmark."""
    found = decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.drop("hits")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), 0.3)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, similarity 0.8 or more."""
    return jaccard_join.near_duplicates(documents(spark, sf_dir), 5, 80)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, counts at most one apart, equal texts together."""
    return sharding.shard(documents(spark, sf_dir), 40)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_knn.quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), 0.7)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the base rules and the certified cutoffs."""
    return quality_rules.quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), length=2048, end_id=1)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and linked multipart credentials."""
    return secrets.secret_report(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(documents(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the other ones of its language, and the terms that set it apart."""
    return source_divergence.divergence(documents(spark, sf_dir), 3, 200)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_token_counts, op3_decontamination, op4_toxicity, op5_jaccard_join,
             op6_sharding, op7_quality_classifier, op8_quality_rules, op9_packing, op10_secret_scan,
             op11_prefix_trie, op12_source_divergence, op13_fingerprints)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": REPEATS_SQL, "op3_decontamination": CONTAMINATION_SQL, "op5_jaccard_join": NEAR_DUPLICATES_SQL,
            "op11_prefix_trie": PREFIX_TRIE_SQL, "op12_source_divergence": DIVERGENCE_SQL}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS_SQL = r'''
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, MIN(doc_id) AS first_doc FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN firsts USING (k) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, COUNT(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
'''

CONTAMINATION_SQL = rf'''
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS k
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
hit AS (SELECT doc_id, n, s, item FROM dw JOIN bw USING (n, k)),
cov AS (SELECT doc_id, COUNT(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
'''

NEAR_DUPLICATES_SQL = rf'''
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS i FROM g x JOIN g y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
nearest AS (SELECT a, MIN(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(nearest.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN nearest ON nearest.a = d.doc_id
'''

PREFIX_TRIE_SQL = r'''
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
t AS (SELECT CAST(conv_id AS BIGINT) AS c, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'id': id, 'w': words} ORDER BY turn NULLS FIRST, id) AS s FROM t GROUP BY c),
h AS (SELECT c, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(tab.t[xor(a, b) % 256 + 1], a // 256))) % 4 AS h FROM o, tab),
r AS (SELECT h.c, coalesce(b.s[1:h.h], []) || h.s[h.h + 1:] AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS (SELECT c, d, len(s) = d AS ends, list_transform(s[1:d], lambda x: x.id) AS k, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM r)),
node AS (SELECT k, any_value(d) AS d, MIN(c) AS conv_id, COUNT(*) AS n, any_value(w) AS w, string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS e FROM m GROUP BY k),
kids AS (SELECT k[1:d - 1] AS k, COUNT(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
up AS (SELECT k[1:i] AS k, SUM((n_children = 0)::BIGINT) AS n_leaves, SUM((n - 1) * w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS i FROM full_) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves,
       CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM full_ f JOIN up USING (k) LEFT JOIN node p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
'''

DIVERGENCE_SQL = rf'''
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING COUNT(*) >= 3),
v AS (SELECT lang, COUNT(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(t, 0) AS t, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, SUM(n) AS t FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 * (coalesce(n, 0) + 1)::HUGEINT // (t + v)::HUGEINT AS BIGINT) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
ln AS (SELECT lang, term, SUM(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + CAST(1000000000 * (n + 1)::HUGEINT // ((SELECT SUM(l.n) FROM ln l WHERE l.lang = ln.lang) + v)::HUGEINT AS BIGINT) AS q FROM ln JOIN v USING (lang)),
pv AS (SELECT x.lang, x.source, y.source AS item, SUM((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 200
'''
