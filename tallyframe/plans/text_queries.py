"""Queries over documents, benchmark, embeddings, conversations and pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import gates, policy, similarity
from tallyframe.plans.session import table

QUERIES: dict = {}
ORACLES: dict = {}

NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
SKELETON = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9][0-9.,]*', '#', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
SHARE = "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT) % 10000"
SPLIT = "CASE WHEN " + SHARE.format("'split|' || CAST(doc_id AS VARCHAR)") + " < 8000 THEN 'train' WHEN " + SHARE.format("'split|' || CAST(doc_id AS VARCHAR)") + " < 9000 THEN 'calibration' ELSE 'locked_test' END"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""
WITH k AS (SELECT lang, sha256({NORM}) AS key FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT key) AS BIGINT) AS n_distinct, CAST(count(*) - count(DISTINCT key) AS BIGINT) AS n_duplicates FROM k GROUP BY lang
""")
def dedup_exact_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.dedup_summary(docs_of(spark, sf_dir), "lang")


@query(f"""
WITH k AS (SELECT doc_id, lang, sha256({NORM}) AS key FROM documents)
SELECT doc_id, lang, key, min(doc_id) OVER (PARTITION BY lang, key) AS keep_id FROM k
""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.dedup_exact(docs_of(spark, sf_dir), "lang").select("doc_id", "lang", "key", "keep_id")


_SETS = f"""
r AS (SELECT lang{{extra}}, min(doc_id) AS rep, any_value(norm) AS norm FROM (SELECT doc_id, lang{{extra}}, {NORM} AS norm FROM {{source}}) GROUP BY lang{{extra}}, norm),
w AS (SELECT lang{{extra}}, rep, string_split(norm, ' ') AS w FROM r WHERE norm <> ''),
s AS (SELECT DISTINCT lang{{extra}}, rep, CASE WHEN len(w) <= 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS s
      FROM (SELECT lang{{extra}}, rep, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w)),
n AS (SELECT lang{{extra}}, rep, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.lang, a.rep AS id_a, b.rep AS id_b, count(*) AS c FROM s a JOIN s b ON a.lang = b.lang AND a.s = b.s AND a.rep < b.rep {{where}} GROUP BY ALL),
p AS (SELECT c.lang, id_a, id_b, c / (x.n + y.n - c) AS jaccard FROM c JOIN n x ON x.rep = id_a AND x.lang = c.lang JOIN n y ON y.rep = id_b AND y.lang = c.lang)
"""


@query("WITH " + _SETS.format(extra="", source="documents", where="") + "SELECT lang, id_a, id_b, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.9")
def dedup_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.similar_texts(similarity.keyed_sets(docs_of(spark, sf_dir), ["lang"]), "lang", 0.9)
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


@query()
def dedup_greedy_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardest texts first (long, medium, short), then by id; copies follow their first row."""
    hard = F.when(T.length_bucket(F.col("text")) == "long", 0).when(T.length_bucket(F.col("text")) == "medium", 1).otherwise(2)
    keyed = similarity.keyed_sets(docs_of(spark, sf_dir).withColumn("hard", hard), ["lang", "hard"])
    pairs = similarity.similar_texts(keyed, "lang", 0.9)
    nodes = keyed.select(F.col("doc_id").alias("id"), F.struct("hard", F.col("doc_id").alias("id")).alias("rank"))
    own = similarity.dedup_exact_keyed(keyed, "lang").join(similarity.decided_nodes(nodes, pairs), F.col("keep_id") == F.col("id"), "left")
    status = F.when(F.coalesce("status", F.lit("kept")) == "near_duplicate", "near_duplicate").when(F.col("doc_id") == F.col("keep_id"), "kept").otherwise("exact_duplicate")
    return own.select("doc_id", "lang", status.alias("status"), F.when(status == "near_duplicate", F.col("keeper")).when(status == "exact_duplicate", F.col("keep_id")).alias("keeper"))


@query(
    f"WITH d AS (SELECT doc_id, text, lang, {SPLIT} AS split FROM documents), "
    + _SETS.format(extra=", split", source="d", where="AND a.split <> b.split").replace("x.lang = c.lang JOIN", "x.lang = c.lang JOIN")
    + "SELECT p.lang, id_a, id_b, round(jaccard, 6) AS jaccard, x.split AS split_a, y.split AS split_b FROM p JOIN r x ON x.rep = id_a JOIN r y ON y.rep = id_b WHERE jaccard >= 0.92"
)
def cross_split_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).withColumn("split", similarity.split_of(F.col("doc_id")))
    return similarity.cross_split_pairs(docs, "lang", 0.92).withColumn("jaccard", F.round("jaccard", 6))


_GRAMS = "unnest(range(1, len(w) - {n1} + 1)) AS i"


@query(f"""
WITH dw AS (SELECT doc_id, string_split({NORM}, ' ') AS w FROM documents), iw AS (SELECT item_id, string_split({NORM}, ' ') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM iw WHERE len(w) >= 8)),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN b USING (s) GROUP BY ALL),
t AS (SELECT doc_id, item_id, hits FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, item_id) = 1),
r AS (SELECT t.*, round(greatest(hits / nd.n, hits / ni.n), 6) AS ratio FROM t JOIN (SELECT doc_id, count(*) AS n FROM d GROUP BY 1) nd USING (doc_id) JOIN (SELECT item_id, count(*) AS n FROM b GROUP BY 1) ni USING (item_id))
SELECT doc_id, item_id, CAST(hits AS BIGINT) AS hits, ratio FROM r WHERE ratio >= 0.1
""")
def contamination_exact_shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.shingle_contamination(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: The corpus has no proper names: a capitalised word and the one after it stand for one.
_NAMES = "[A-Z][a-z]+ [a-z]{4,}"


@query(f"""
WITH de AS (SELECT DISTINCT doc_id, lower(e) AS e FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_NAMES}')) AS e FROM documents)),
ie AS (SELECT DISTINCT item_id, lower(e) AS e FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_NAMES}')) AS e FROM benchmark)),
ri AS (SELECT e FROM ie GROUP BY e HAVING count(*) <= 3), rd AS (SELECT e FROM de GROUP BY e HAVING count(*) <= greatest(3.0, 0.002 * (SELECT count(*) FROM documents)))
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared FROM de JOIN ie USING (e) WHERE e IN (SELECT e FROM ri) AND e IN (SELECT e FROM rd) GROUP BY ALL HAVING count(*) >= 2
""")
def contamination_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.entity_contamination(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), least=2, pattern=_NAMES)


_SKEL_WORDS = f"string_split(trim(regexp_replace(regexp_replace(lower({SKELETON}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' ')"
_FIVE = "SELECT DISTINCT doc_id, {family}, {extra} array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, {family}, {extra} w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)"


@query(f"""
WITH w AS (SELECT doc_id, lang, {SPLIT} <> 'train' AS is_eval, {_SKEL_WORDS} AS w FROM documents), g AS ({_FIVE.format(family="lang", extra="is_eval,")}),
t AS (SELECT DISTINCT lang, g FROM g WHERE NOT is_eval), r AS (SELECT g.lang, doc_id, avg(CASE WHEN t.g IS NULL THEN 0 ELSE 1 END) AS share FROM g LEFT JOIN t ON g.lang = t.lang AND g.g = t.g WHERE is_eval GROUP BY ALL)
SELECT lang, CAST(count(*) AS BIGINT) AS rows, round(avg(share), 6) AS coverage FROM r GROUP BY lang
""")
def phrase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).withColumn("is_eval", similarity.split_of(F.col("doc_id")) != "train")
    return similarity.phrase_coverage(docs, "lang")


@query(f"""
WITH w AS (SELECT doc_id, source, {_SKEL_WORDS} AS w FROM documents), g AS ({_FIVE.format(family="source", extra="")}),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
f AS (SELECT g.source, g FROM g JOIN n ON n.source = g.source GROUP BY g.source, g, n.n HAVING count(*) >= greatest(3, floor(n.n * 0.05))),
r AS (SELECT g.source, doc_id, avg(CASE WHEN f.g IS NULL THEN 0 ELSE 1 END) AS share FROM g LEFT JOIN f ON g.source = f.source AND g.g = f.g GROUP BY ALL)
SELECT source, CAST(count(*) AS BIGINT) AS rows, round(avg(share), 6) AS share FROM r GROUP BY source
""")
def boilerplate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.boilerplate_share(docs_of(spark, sf_dir), "source")


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT md5(coalesce(text, ''))) AS BIGINT) AS texts, CAST(count(DISTINCT md5({SKELETON})) AS BIGINT) AS skeletons FROM documents GROUP BY source")
def audit_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.skeleton_audit(docs_of(spark, sf_dir), "source")


@query(f"""
WITH d AS (SELECT source, {SPLIT} AS split, sha256({NORM}) AS key FROM documents), s AS (SELECT source, count(*) AS shared FROM (SELECT source, key FROM d GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY 1)
SELECT d.source, CAST(count(DISTINCT split) AS BIGINT) AS splits, bool_or(split = 'train') AS in_train, CAST(coalesce(max(s.shared), 0) AS BIGINT) AS shared_keys FROM d LEFT JOIN s ON s.source = d.source GROUP BY d.source
""")
def isolation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.isolation_report(docs_of(spark, sf_dir).withColumn("split", similarity.split_of(F.col("doc_id"))), "source")


_REDACT = "coalesce(text, '')"
_COUNTS = []
for _, _pattern in T.SECRETS:
    _COUNTS.append(f"len(regexp_extract_all({_REDACT}, '{_pattern}'))")
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, CAST({' + '.join(_COUNTS)} AS BIGINT) AS n_masked, md5({_REDACT}) AS text_md5 FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = T.redact(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", n.alias("n_masked"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"))


#: What a text must not tell, by code.
LEAKS = {"secret_token": 'token = "[0-9a-f]+"', "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "license_line": "(?i)licensed? under"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{code}' AS code, CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(coalesce(text, ''), '{p}')" for code, p in LEAKS.items()))
def leakage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.scan_leaks(docs_of(spark, sf_dir), "doc_id", "text", LEAKS).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH g AS (SELECT source, CASE WHEN length(trim(coalesce(text, ''))) <= 3 THEN 'schema:missing' WHEN length(text) > 12000 THEN 'schema:invalid' WHEN regexp_matches(text, '{LEAKS["secret_token"]}') THEN 'label_leak:secret'
  WHEN regexp_matches(text, '{LEAKS["email"]}') THEN 'privacy' WHEN {NORM} = '' THEN 'degenerate' ELSE 'accepted' END AS reason FROM documents)
SELECT source, reason, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL
""")
def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    steps = [
        ("schema", F.when(F.length(F.trim(text)) <= 3, "missing:text")),
        ("schema", F.when(F.length(text) > 12_000, "invalid:length")),
        ("label_leak", F.when(text.rlike(LEAKS["secret_token"]), "secret:token")),
        ("privacy", F.when(text.rlike(LEAKS["email"]), "email")),
        ("degenerate", F.when(T.normalize(F.col("text")) == "", "text")),
    ]
    return gates.funnel(docs_of(spark, sf_dir), steps, "source")


_TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "it": 0.1}


@query("""
WITH t AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.2), ('de', 0.2), ('it', 0.1)) v(lang, target)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT coalesce(c.lang, t.lang) AS lang, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM documents), 6) AS share, round(coalesce(target, 0.0), 6) AS target,
       round(coalesce(n, 0) / (SELECT count(*) FROM documents) - coalesce(target, 0.0), 6) AS gap FROM c FULL JOIN t ON c.lang = t.lang
""")
def composition_vs_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.composition(docs_of(spark, sf_dir), "lang", spark.createDataFrame(list(_TARGETS.items()), "lang string, target double"))


_SIGNATURES = {"invoice": ["digits", "currency", "colon"], "letter": ["question", "comma", "exclaim"], "config": ["equals", "quote", "digits"], "prose": ["comma", "newline"]}
_FEATURES = {"digits": "[0-9]", "currency": "[$]", "colon": ":", "question": "[?]", "comma": ",", "exclaim": "!", "equals": "=", "quote": "\"", "newline": "\n"}
_FEATURE_SQL = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{k}' END" for k, p in _FEATURES.items()).replace("\n", "\\n")
_COVER_SQL = " UNION ALL ".join(
    "SELECT doc_id, '{0}' AS t, round(({1}) / {2}.0, 9) AS c FROM f".format(t, " + ".join(f"CAST(list_contains(f, '{x}') AS INT)" for x in own), len(own)) for t, own in _SIGNATURES.items()
)


@query(f"""
WITH f AS (SELECT doc_id, list_filter_null AS f FROM (SELECT doc_id, [x for x in [{_FEATURE_SQL}] if x IS NOT NULL] AS list_filter_null FROM documents)), c AS ({_COVER_SQL}),
b AS (SELECT doc_id, max(c) AS best FROM c GROUP BY 1), w AS (SELECT c.doc_id, best, max(t) AS t, count(*) AS k FROM c JOIN b ON b.doc_id = c.doc_id AND c.c = b.best GROUP BY ALL)
SELECT doc_id, CASE WHEN best >= 0.6 AND k = 1 THEN t ELSE 'other' END AS doc_type FROM w
""")
def document_type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.operators.rules import coverage_type

    text = F.coalesce("text", F.lit(""))
    features = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in _FEATURES.items()]))
    return docs_of(spark, sf_dir).select("doc_id", coverage_type(features, _SIGNATURES).alias("doc_type"))


_FLOOR_SQL = "greatest(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {policy.RANK[least]} ELSE 0 END" for least, p in policy.PATTERNS.values())
_FLOOR_SQL += """, CASE WHEN length(text) > 8000 OR (length(text) - length(replace(text, '''', ''))) % 2 = 1 OR (length(text) - length(replace(text, '"', ''))) % 2 = 1 THEN 1 ELSE 0 END)"""


@query(f"""
WITH f AS (SELECT conv_id, turn, {_FLOOR_SQL} AS f, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 'allow' ELSE 'deny' END AS m, 0.99 + (conv_id % 10) / 1000.0 AS p FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
r AS (SELECT conv_id, turn, f, greatest(f, CASE WHEN m IS NULL THEN 1 WHEN m = 'allow' AND p < 0.995 THEN 1 WHEN m = 'deny' THEN 2 ELSE 0 END) AS r FROM f)
SELECT conv_id, turn, ['allow', 'ask', 'deny'][f + 1] AS floor, ['allow', 'ask', 'deny'][r + 1] AS action FROM r
""")
def policy_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is taken as a command; the model's opinion is derived from the turn and its certainty from the conversation."""
    label = F.when(F.col("turn") % 3 == 0, None).when(F.col("turn") % 3 == 1, "allow").otherwise("deny")
    rows = table(spark, sf_dir, "conversations").withColumn("floor", policy.floor(F.coalesce("text", F.lit(""))))
    return rows.select("conv_id", "turn", "floor", policy.resolve(F.col("floor"), label, F.lit(0.99) + (F.col("conv_id") % 10) / 1000.0).alias("action"))


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, md5(string_agg('### ' || role || chr(10) || replace(coalesce(text, ''), '###', '# # #'), chr(10) ORDER BY turn, role, text)) AS prompt_md5 FROM conversations GROUP BY conv_id
""")
def text_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt a conversation: a fence and the role before each turn, fences inside texts taken apart."""
    part = F.concat(F.lit("### "), F.col("role"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("###"), F.lit("# # #")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", part.alias("part"))))
    joined = F.array_join(F.transform(turns, lambda t: t["part"]), "\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.md5(F.encode(joined, "UTF-8")).alias("prompt_md5"))


@query("""
SELECT lang, length_bucket, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars), 1) AS mean_chars FROM (SELECT lang, n_chars, CASE WHEN length(coalesce(text, '')) < 300 THEN 'short' WHEN length(text) < 900 THEN 'medium' ELSE 'long' END AS length_bucket FROM documents) GROUP BY ALL
""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).groupBy("lang", T.length_bucket(F.col("text")).alias("length_bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 1).alias("mean_chars"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 12000 THEN md5(substr(text, 1, 8000) || chr(10) || '... [' || CAST(length(text) - 12000 AS VARCHAR) || ' characters omitted] ...' || chr(10) || right(text, 4000)) ELSE md5(text) END AS text_md5, length(text) > 12000 AS was_cut FROM documents WHERE text IS NOT NULL
""")
def truncate_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(F.encode(T.truncate_middle(F.col("text")), "UTF-8")).alias("text_md5"), (F.char_length("text") > 12_000).alias("was_cut"))


@query("""
WITH p AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c
           FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, id_a, id_b, round(c, 4) AS cosine FROM p WHERE c >= 0.35
""")
def cosine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_vectors(table(spark, sf_dir, "embeddings"), 0.35).withColumn("cosine", F.round("cosine", 4))


@query()
def fake_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer seam with a deterministic scorer."""
    return gates.map_batches(docs_of(spark, sf_dir).select("doc_id", "text"), "doc_id long, probs array<double>", gates.fake_scorer)


@query("SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, ''), '<a ')) AS BIGINT) AS links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS n_chars FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit("<a ")).cast("long").alias("links"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.char_length(plain).cast("long").alias("n_chars"))


@query("SELECT key, CAST(count(*) AS BIGINT) AS n, CAST(min(CAST(value AS BIGINT)) AS BIGINT) AS least, CAST(max(CAST(value AS BIGINT)) AS BIGINT) AS most FROM (SELECT 'k' AS key, json_extract_string(props, '$.k') AS value FROM events) WHERE value IS NOT NULL GROUP BY key")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "events").select(F.explode(gates.flatten_json(F.col("props"))).alias("key", "value"))
    n = F.col("value").cast("long")
    return flat.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))
