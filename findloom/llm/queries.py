"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fim, html, language, media, packing, quality, secrets, simhash, substring, trie, urls, warc
from .common import materialize, release, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of WARC archives, read back: see ``warc.round_trip``. Null html is an empty payload."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every url: see ``urls.judge``. A null url, or one without ``://``, has an empty host and path and is allowed."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # The last step of a page's path is the id of the document that it shows.
    shown = pages.select("url", F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = shown.join(labels, "doc_id").select("url", F.when(bad, urls.BLOCK).otherwise(urls.ALLOW).alias("label"))
    return urls.judge(pages, URL_RULES, urls.mine(labelled))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document: see ``simhash.near_duplicates``. Null and empty texts share fingerprint zero."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in an ISO container and read back: see ``media.store_and_read``. Null and empty texts are 64 bytes 0."""
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark words in every document: see ``decontamination.report``. A null text has no words and is clean."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: see ``language.identify``. A null text or one without a letter is ``und``."""
    return language.identify(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that every document loses as repeats: see ``substring.removal_report``. A null text has no words."""
    return substring.removal_report(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document: see ``quality.score_documents``. Null and empty texts have statistics of zero."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: see ``html.main_text``. Null and empty pages have none."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in its sequences: see ``packing.pack``. A null text is the end token alone."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each begun with another's turns.

    Conversation c is rebuilt from the first h turns of conversation c - c % 5
    and its own turns after its first h: see ``trie.spliced``. A node is each
    distinct sequence of first d turns, ``depth`` d from the root's 0 on;
    ``conv_id`` is its smallest member, ``parent_conv_id`` its parent's,
    ``saved_tokens`` the bytes of its subtree's turns that other members repeat,
    ``ends_sha256`` tells the members that end there. Null roles and texts are
    empty; turns of one number are in order of their digests; rows without a
    conv_id are left out. No conversations, no nodes.
    """
    return trie.prefix_trie(*trie.spliced(trie.ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut by characters and put in another order: see ``fim.transform``. Null and empty texts are plain."""
    return fim.report(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: see ``secrets.scan``. Null and empty texts have none."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(secrets.samples(docs)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality model rejects. Null and empty texts are judged as texts of no words."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the smallest doc_id. Rows with a null doc_id stay."""
    return simhash.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the words of repeats of 35 words or more. Every row stays, an empty text as it is."""
    return substring.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the words of benchmark windows. Every row stays; a clean text is not touched."""
    return decontamination.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences; no documents give no rows."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]


def run_stages(spark: SparkSession, sf_dir: str, stages=STAGES) -> DataFrame:
    """Each stage works on the written table of the one before, which is then
    deleted with all that the stage wrote on its way."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(stages):
        begun = written()
        docs = stage(spark, docs, sf_dir)
        if k < len(stages) - 1:
            docs = materialize(docs, f"stage-{name}")
            if k:
                begun = [path for path in begun if path != last]
            last = written()[-1]
            release(spark, keep=(*begun, last))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_warc,
        op2_url_filters,
        op3_simhash,
        op4_media,
        op5_decontamination,
        op6_language,
        op7_substring,
        op8_quality,
        op9_html,
        op10_packing,
        op11_prefix_trie,
        op12_fill_in_middle,
        op13_secrets,
    )
    return {f.__name__: f for f in own}


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)
),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
found AS (
  SELECT p.doc_id, p.s, p.n, x.item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM places) p JOIN windows x ON x.win = p.win AND x.n = p.n
),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM found) GROUP BY doc_id
),
of_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, coalesce(i.items_sha256, sha256('')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN of_items i USING (doc_id)
"""

_OP7_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM places),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks
  FROM (SELECT doc_id, unnest(range(s, s + 35)) AS k FROM windows SEMI JOIN twice USING (h)) GROUP BY doc_id
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t, count(*) AS n
  FROM words ANTI JOIN (SELECT doc_id, unnest(ks) AS k FROM gone) g ON g.doc_id = words.doc_id AND g.k = words.k GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

_BASE32_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha, 1 + 10 * c, 10) AS BIGINT) >> (35 - 5 * k)) & 31 AS INTEGER), 1)"

_OP1_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS sha FROM p),
d AS (
  SELECT page_id, url, n, array_to_string(list_transform(range(0, 32), lambda x: {_BASE32_DIGIT.replace(" c,", " (x // 8),").replace("* k", "* (x % 8)")}), '') AS digest FROM s
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY n, digest) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url AS target_uri,
  CAST(NULL AS VARCHAR) AS error
FROM f
"""


#: The unsigned crc32 of a decimal number.
_CRC_SQL = """(4294967295 - list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: xor(a >> 8, list_reduce([xor(a, c) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))
  ))"""

_OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, {_CRC_SQL.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
head AS (SELECT c.conv_id, o.d, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.d <= c.h),
heads AS (SELECT conv_id, count(*) AS m FROM head GROUP BY conv_id),
turns AS (
  SELECT conv_id, d, sha256(strlen(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM (
    SELECT * FROM head
    UNION ALL
    SELECT conv_id, o.d - c.h + coalesce(m, 0), role, text FROM own o JOIN convs c USING (conv_id) LEFT JOIN heads USING (conv_id) WHERE o.d > c.h
  )
),
lengths AS (SELECT conv_id, coalesce(max(d), 0) AS n FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, d, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS p, bytes FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
),
nodes AS (
  SELECT d, p, min(conv_id) AS node, count(*) AS n_convs, any_value(bytes) AS bytes,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY d, p
),
places AS (SELECT x.conv_id, x.d, n.node FROM prefixes x JOIN nodes n USING (d, p)),
tree AS (SELECT n.*, a.node AS parent FROM nodes n LEFT JOIN places a ON a.conv_id = n.node AND a.d = n.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM tree WHERE parent IS NOT NULL GROUP BY ALL),
below AS (
  SELECT a.node, a.d, sum((t.n_convs - 1) * t.bytes) AS saved, count(*) FILTER (c.node IS NULL) AS n_leaves
  FROM tree t LEFT JOIN children c ON c.node = t.node AND c.d = t.d JOIN places a ON a.conv_id = t.node AND a.d <= t.d GROUP BY a.node, a.d
)
SELECT t.node AS conv_id, CAST(t.d AS BIGINT) AS depth, t.parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM tree t LEFT JOIN children c ON c.node = t.node AND c.d = t.d JOIN below b ON b.node = t.node AND b.d = t.d
"""

_OP12_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM docs
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (SELECT *, t[1:a] AS pre, t[a + 1:b] AS mid, t[b + 1:n] AS suf FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1_SQL, "op5_decontamination": _OP5_SQL, "op7_substring": _OP7_SQL, "op11_prefix_trie": _OP11_SQL, "op12_fill_in_middle": _OP12_SQL}
