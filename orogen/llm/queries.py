"""The thin queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, edit_prints, fill_middle, line_dedup, quality, simhash, spelling, suffix_dedup, toxicity, url_lists, warc
from .common import table


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and pattern of the byte-level BPE."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), window=200).drop("kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.remainder(3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("contamination.n_words").cast("long").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op6_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.remainder(5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day of 2024 that follows from the page_id; the list has dated entries for
    about half of the hosts, by a hash of the host."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    hosts = captures.select(url_lists.host_of().alias("pattern")).where("pattern is not null").distinct()
    digit = lambda i: F.ascii(F.substring(F.md5("pattern"), i, 1))
    day = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))
    start = digit(2) * 3 - 140
    turns = F.array(
        F.struct(F.lit("add").alias("action"), day(start).alias("effective")),
        F.struct(F.lit("remove").alias("action"), day(start + digit(3)).alias("effective")),
        F.struct(F.lit("add").alias("action"), day(start + digit(3) + digit(4)).alias("effective")),
    )
    entries = hosts.where(digit(1) % 2 == 0).select("pattern", F.explode(turns).alias("e")).select("pattern", "e.action", "e.effective")
    return url_lists.evaluate(captures, entries)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=100)


def op11_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.against_next(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.with_slips(spelling.runs_of(table(spark, sf_dir, "documents")), every=97)
    return spelling.group(spelling.count_words(runs, min_chars=5, min_n=3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_one_bit_neighbours": op4_one_bit_neighbours,
    "op5_decontaminate": op5_decontaminate,
    "op6_passage_quality": op6_passage_quality,
    "op7_url_lists": op7_url_lists,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_edit_prints": op11_edit_prints,
    "op12_fill_middle": op12_fill_middle,
    "op13_spelling": op13_spelling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, u.j, substr(h, 1024 * u.j + 1, 1422) AS s FROM d, unnest(range(0, (length(h) // 2 - 200) // 512 + 1)) AS u(j) WHERE length(h) >= 400),
w AS (SELECT doc_id, 512 * j + u.t AS i, md5(substr(s, 2 * u.t + 1, 400)) AS k FROM blocks, unnest(range(0, least(512, length(s) // 2 - 199))) AS u(t)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE k IN (SELECT k FROM twice)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, g),
gaps AS (SELECT doc_id, g, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (
  SELECT gaps.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS k,
    sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN d ON d.doc_id = gaps.doc_id JOIN (SELECT doc_id, max(b) AS last FROM gaps GROUP BY doc_id) AS e ON e.doc_id = gaps.doc_id GROUP BY gaps.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT item, least(13, len(w)) AS m, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i, w FROM b WHERE len(w) > 0
),
pat AS (SELECT DISTINCT item, m, list_slice(w, i, i + m - 1) AS p FROM bw),
ms AS (SELECT DISTINCT m FROM pat),
dw AS (
  SELECT d.doc_id, ms.m, u.i, list_slice(d.w, u.i, u.i + ms.m - 1) AS p
  FROM d JOIN ms ON len(d.w) >= ms.m, unnest(range(1, len(d.w) - ms.m + 2)) AS u(i)
),
hit AS (SELECT dw.doc_id, dw.i, dw.m, pat.item FROM dw JOIN pat ON dw.m = pat.m AND dw.p = pat.p),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_url_lists": r"""
WITH c AS (
  SELECT page_id, CAST(date '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host
  FROM pages
),
p AS (SELECT DISTINCT host AS pattern, md5(host) AS m FROM c WHERE host IS NOT NULL),
n AS (
  SELECT pattern, ascii(substr(m, 2, 1)) * 3 - 140 AS a, ascii(substr(m, 3, 1)) AS b, ascii(substr(m, 4, 1)) AS d
  FROM p WHERE ascii(substr(m, 1, 1)) % 2 = 0
),
iv AS (
  SELECT pattern, date '2024-01-01' + CAST(a AS INTEGER) AS valid_from, date '2024-01-01' + CAST(a + b AS INTEGER) AS valid_to FROM n
  UNION ALL SELECT pattern, date '2024-01-01' + CAST(a + b + d AS INTEGER), NULL FROM n
),
m AS (
  SELECT c.page_id, iv.pattern, iv.valid_from FROM c JOIN iv
  ON (c.host = iv.pattern OR ends_with(c.host, '.' || iv.pattern)) AND c.fetched >= iv.valid_from AND (iv.valid_to IS NULL OR c.fetched < iv.valid_to)
),
best AS (SELECT page_id, arg_max(pattern, length(pattern)) AS pattern, arg_max(valid_from, length(pattern)) AS listed_since FROM m GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched, best.page_id IS NOT NULL AS blocked, best.pattern, CAST(best.listed_since AS DATE) AS listed_since
FROM c LEFT JOIN best ON c.page_id = best.page_id
""",
    "op9_line_dedup": """
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], E' \\t\\n\\r\\x0B\\x0C'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) AS d, unnest(range(1, len(ls) + 1)) AS u(i)
),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
m AS (SELECT l.*, hot.k IS NOT NULL AND l.doc_id <> hot.keeper AS dropped FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
""",
    "op12_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT *, array_to_string(list_slice(u, 1, least(a, b)), '') AS pre, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS mid,
    array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS suf
  FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
    "op13_spelling": r"""
WITH RECURSIVE bits AS (
  SELECT b AS i, list_reduce(list_concat([CAST(b AS BIGINT)], list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256) AS r(b)
),
tab AS (SELECT list(v ORDER BY i) AS crc FROM bits),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
x AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM c),
y AS (SELECT run, n, list_transform(range(0, length(b), 2), lambda i: CAST('0x' || substr(b, CAST(i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM x),
h AS (
  SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda a, z: xor(a >> 8, crc[xor(a & 255, z) + 1])), 4294967295) AS h FROM y, tab
),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
gone AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM w, unnest(range(0, length(word))) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM gone AS a JOIN gone AS b ON a.d = b.d AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM gone AS a JOIN w AS b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM gone AS a JOIN w AS b ON a.d = b.word
),
f AS (
  SELECT w.word, w.n, count(near) AS n_near, CASE WHEN max(p.n) >= 2 * w.n THEN max(p.n) END AS form_n FROM w LEFT JOIN pairs AS p ON p.word = w.word GROUP BY w.word, w.n
),
g AS (SELECT f.*, (SELECT min(near) FROM pairs AS p WHERE p.word = f.word AND p.n = f.form_n) AS form FROM f),
chain AS (
  SELECT word, word AS here, 0 AS depth FROM g
  UNION ALL SELECT chain.word, g.form, depth + 1 FROM chain JOIN g ON g.word = chain.here WHERE g.form IS NOT NULL
),
ends AS (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY word)
SELECT g.word, g.form, ends.root, g.n, CAST(g.n_near AS BIGINT) AS n_near, g.form_n FROM g JOIN ends ON ends.word = g.word
""",
}
