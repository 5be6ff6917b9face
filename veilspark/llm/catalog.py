"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import license_scan, secret_tags, token_files, url_rules
from veilspark.llm.contamination import contamination
from veilspark.llm.gated_lm import score_texts
from veilspark.llm.impact_search import top_k
from veilspark.llm.license_scan import license_notices
from veilspark.llm.line_dedup import without_shared_lines
from veilspark.llm.part_codes import compress
from veilspark.llm.prefix_bpe import encode_texts
from veilspark.llm.prefix_trie import prefix_trie, rebuilt, turn_lists
from veilspark.llm.pu_toxicity import fold, toxicity
from veilspark.llm.tensored_minhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(parts) -> F.Column:
    """An array of strings as one string."""
    return F.array_join(parts, ",")


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the base rules and the pattern rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.rule_table(spark, url_rules.BASE_RULES + url_rules.PATTERN_RULES)
    judged = url_rules.judge_urls(pages, rules)
    rule = F.when(F.col("tier") == 0, F.col("rule")).alias("rule")
    return judged.select("page_id", "host", "path", rule, "verdict")


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_REST}, '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}')"
ORACLE["op1_url_filters"] = f"""
WITH parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])({"|".join(url_rules.UNWANTED)})([^a-z0-9]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM judged"""


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns, and what the random field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_tags.find_secrets(docs, secret_tags.fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "tagged")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans) -> F.Column:
        return joined(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to sequence files and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(index).withColumnRenamed("id", "doc_id")


@query
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document, learnt from nine tenths of them."""
    return score_texts(table(spark, sf_dir, "documents"), fold(10) == 0)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined("items"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), '{0}', '{1}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')".format(
    url_rules.UPPER, url_rules.LOWER
)
ORACLE["op8_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS body
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS body
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lens ON len(w) >= n)),
found AS (SELECT r, i, places.n, item FROM places JOIN win ON places.body = win.body AND places.n = win.n),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document; spans are in words, end exclusive."""
    notices = license_scan.NOTICES + license_scan.FURTHER
    found = license_notices(table(spark, sf_dir, "documents").select("doc_id", "text"), notices)
    span = F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), joined("licenses").alias("licenses"), "best", joined(span).alias("spans")
    )


def _license_sql() -> str:
    rows = []
    for i, t in enumerate(license_scan.NOTICES + license_scan.FURTHER):
        w = license_scan.word_list(t.text)
        assert len(w) >= license_scan.SHINGLE
        rows.append(f"({i}, '{t.license}', '{' '.join(w)}', {license_scan.length_class(len(w))})")
    return f"""
WITH RECURSIVE t(tid, license, body, class) AS (VALUES {', '.join(rows)}),
ts AS (SELECT DISTINCT tid, license, class, array_to_string(w[i : i + 4], ' ') AS s
       FROM (SELECT tid, license, class, string_split(body, ' ') AS w, unnest(range(1, greatest(len(string_split(body, ' ')) - 3, 2))) AS i FROM t)),
tn AS (SELECT tid, count(*) AS n FROM ts GROUP BY tid),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT r, i - 1 AS p, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
hit AS (SELECT r, p, tid, license, class, s, class // 4 AS step, class + class // 4 - 4 AS width FROM ds JOIN ts USING (s)),
inw AS (SELECT *, unnest(range(greatest(0, CAST(ceil((p - width + 1) / step) AS BIGINT)), p // step + 1)) AS k FROM hit),
win AS (SELECT r, tid, license, k, count(DISTINCT s) AS common, count(DISTINCT s) / any_value(n) AS c, min(p) AS a, max(p) + 5 AS b FROM inw JOIN tn USING (tid) GROUP BY r, tid, license, k),
good AS (SELECT DISTINCT r, license, common, max(c) OVER (PARTITION BY r, license) AS c, a, b FROM win WHERE c >= 0.75),
big AS (SELECT r, a, b, license, common, c FROM good g WHERE NOT EXISTS (
  SELECT 1 FROM good h WHERE h.r = g.r AND h.license = g.license AND h.a <= g.a AND h.b >= g.b AND (h.a <> g.a OR h.b <> g.b))),
ranked AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY common DESC, c DESC, a DESC, b DESC, license DESC) AS i,
         {{'a': a, 'b': b, 'license': license, 'common': common, 'c': c}} AS x FROM big),
settled(r, i, taken) AS (
  SELECT r, 1::BIGINT, [x] FROM ranked WHERE i = 1
  UNION ALL
  SELECT s.r, k.i, CASE WHEN len(list_filter(taken, lambda y: y.license <> k.x.license AND y.common > k.x.common
    AND 2 * (least(k.x.b, y.b) - greatest(k.x.a, y.a)) > least(k.x.b - k.x.a, y.b - y.a))) > 0 THEN taken ELSE list_append(taken, k.x) END
  FROM settled s JOIN ranked k ON k.r = s.r AND k.i = s.i + 1),
done AS (SELECT r, unnest(arg_max(taken, i), recursive := true) FROM settled GROUP BY r),
sp AS (SELECT r, string_agg(license || ':' || a || ':' || b, ',' ORDER BY a, b, license) AS spans FROM (SELECT DISTINCT r, a, b, license FROM done) GROUP BY r),
li AS (SELECT r, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(c) AS best FROM done GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(best, 0.0) AS best, coalesce(spans, '') AS spans
FROM d LEFT JOIN li USING (r) LEFT JOIN sp USING (r)"""


ORACLE["op10_licenses"] = _license_sql()


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as eight codebook indexes."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    numbers = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    return coded.select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _codes_sql(rounds: int = 6) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, parts.p, e, CAST(list_sum(list_transform(range(1, len(parts.x) + 1), lambda i: (parts.x[i] - c.x[i]) * (parts.x[i] - c.x[i]))) AS BIGINT) AS d
        FROM parts JOIN b{k} c USING (p)) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT p, e, list(v ORDER BY i) AS x
  FROM (SELECT p, e, i, sum(x[i]) // count(*) - CASE WHEN sum(x[i]) % count(*) < 0 THEN 1 ELSE 0 END AS v
        FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM parts JOIN a{k} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM (SELECT r, x, unnest(range(8)) AS p FROM v)),
b0 AS (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 16),{",".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN coded USING (r)"""


ORACLE["op11_vector_codes"] = _codes_sql()


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document before it holds."""
    done = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op12_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT r, doc_id, i, l[i] AS line,
         translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{url_rules.UPPER}', '{url_rules.LOWER}') AS key
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
shared AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
  HAVING count(DISTINCT doc_id) + CASE WHEN count(*) > count(doc_id) THEN 1 ELSE 0 END >= 2),
marked AS (SELECT r, i, line, owner IS NOT NULL AND doc_id IS DISTINCT FROM owner AS lost FROM lines LEFT JOIN shared USING (key)),
done AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost) AS kept
  FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN done USING (r)"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    return prefix_trie(rebuilt(turn_lists(table(spark, sf_dir, "conversations"))))


# CRC-32 of a decimal: each digit is followed by eight markers, one per bit to be shifted out.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''),
  lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END))"""
ORACLE["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv),
c AS (
  SELECT o.conv, coalesce(b.turns[1 : h], []) || o.turns[h + 1 :] AS turns
  FROM (SELECT *, CAST({_CRC} % 4 AS INTEGER) AS h FROM own) o LEFT JOIN own b ON b.conv = o.conv - o.conv % 20),
p AS (SELECT conv, turns, len(turns) AS l, d, turns[1 : d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
node AS (
  SELECT d, path, min(conv) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (l = d), '') AS ends
  FROM p GROUP BY d, path),
own_saved AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved,
         path[1 : d - 1] AS up FROM node),
kids AS (SELECT up AS path, d - 1 AS d, count(*) AS children FROM own_saved WHERE d > 0 GROUP BY 1, 2),
tree AS (SELECT s.*, coalesce(children, 0) AS children FROM own_saved s LEFT JOIN kids USING (d, path)),
below AS (
  SELECT a AS d, path[1 : a] AS path, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves
  FROM (SELECT path, saved, children, unnest(range(0, d + 1)) AS a FROM tree) GROUP BY 1, 2)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, t.n AS n_convs, t.children AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tree t JOIN below b USING (d, path) LEFT JOIN node u ON t.d > 0 AND u.d = t.d - 1 AND u.path = t.up"""
