"""Registered queries of the training-data operators, each with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.catalog.base import table
from echoframe.llm import align, chat, decontaminate, fingerprint, kneser, language, near, negatives, packing, personal, quality, secrets, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def comma_sha256(strings):
    return F.sha2(F.array_join(strings, ","), 256)


CRC_SQL = """steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, text, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: ('0x' || h)::BIGINT)) AS b FROM documents),
crc AS (SELECT doc_id, text, xor(4294967295::BIGINT, list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS text_crc32
  FROM bytes, steps)"""


@query(f"""WITH {CRC_SQL},
sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, text_crc32 FROM crc),
run AS (SELECT *, sum(size) OVER (ORDER BY doc_id)::HUGEINT AS upto, sum(size) OVER ()::HUGEINT AS whole FROM sized),
put AS (SELECT *, least((2 * upto - size) * 8 // (2 * whole), 7)::INTEGER AS shard FROM run)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM put""")
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Eight contiguous shards of the documents, of nearly equal bytes."""
    docs = table(spark, sf, "documents").select(
        "doc_id", sharding.text_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(docs, 8, F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '{WORD_SQL}')"


@query(f"""WITH item AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
gram AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, p, n FROM gram JOIN win USING (n, gram)),
word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside ten-word passages of benchmark items."""
    found = decontaminate.decontaminate(table(spark, sf, "documents"), "doc_id", "text",
                                        table(spark, sf, "benchmark"), "item_id", "text")
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        comma_sha256(names).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def spans_sql(kinds: list[tuple[str, str, str]], base: int) -> str:
    """CTEs ``span`` (doc_id, s, e, k, kind) and ``digest``; each kind is (name, regex, condition on match ``m``)."""
    each = " UNION ALL ".join(f"""
SELECT doc_id, s, s + length(m) AS e, {k} AS k, '{kind}' AS kind FROM (
  SELECT doc_id, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM txt)))
WHERE {cond}""" for k, (kind, pattern, cond) in enumerate(kinds) for p in ["'" + pattern.replace("'", "''") + "'"])
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(kinds[:base]))
    mark = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""txt AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), span AS ({each}),
digest AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg({mark}, ',' ORDER BY s, k) FILTER (k < {base}), '')) AS base_sha256,
  string_agg({mark}, ',' ORDER BY s, k) AS spans FROM span GROUP BY doc_id)"""


WORDS_ASSIGNED = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN_SQL = rf"""({WORDS_ASSIGNED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PEM_SQL = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
           r"|(?:(?:\s|\\[rn])+(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
           r"(?:(?:(?:\s|\\[rn])+[A-Za-z0-9+/]{20,}={0,2})+(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]+={0,2})?)?)")
SECRET_SQL = spans_sql([
    ("assign", ASSIGN_SQL, "length(regexp_extract(m, '" + ASSIGN_SQL.replace("'", "''") + "', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"), ("hex", "[0-9a-f]+", "length(m) >= 32"),
    ("pem", PEM_SQL, "true"), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true")], 3)


@query(f"""WITH {SECRET_SQL}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM txt LEFT JOIN digest USING (doc_id)""")
def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document, found behind a trigram index."""
    found = secrets.find_secrets(table(spark, sf, "documents"), "doc_id", "text")
    return spans_digest(found, ("assign", "access", "hex"))


def spans_digest(found: DataFrame, base: tuple[str, ...], of: str = "spans") -> DataFrame:
    def count_of(kind):
        return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [count_of(k) for k in base]
    return found.select(F.col("key").alias("doc_id"), *count, F.sha2(secrets.joined(of, base), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"))


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


@query()
def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document by a network that learned from two thirds of them."""
    docs = table(spark, sf, "documents")
    network = language.fit(docs, "doc_id", "text", "lang", ~held_out("doc_id"))
    return language.predict(docs, "doc_id", "text", network).select(
        F.col("key").alias("doc_id"), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of documents linked by five-word shingles of Jaccard similarity 0.8 or more."""
    return near.near_duplicates(table(spark, sf, "documents"), "doc_id", "text").select(
        F.col("key").alias("doc_id"), "class_id", "copy_of", "n_links")


def public_tokenizer() -> dict[str, str]:
    """The tokenizer that the box offers; its files are read where they lie."""
    import public_tokenizers

    return {"definition": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


@query()
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf, "documents"), "doc_id", "text", **public_tokenizer(), with_ids=False)
    return pieces.withColumnRenamed("key", "doc_id")


@query()
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Order MinHash of every document and of its text edited with the next one's."""
    return fingerprint.with_successors(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query()
def op7_personal(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document, by a field trained on a sample of them."""
    docs = table(spark, sf, "documents")
    found = personal.find_personal(docs, "doc_id", "text", personal.fit(docs, "doc_id", "text"))
    return spans_digest(found, personal.KINDS, "stated")


@query("""WITH c AS (SELECT conv_id AS conv, turn, role, text FROM conversations),
calls AS (SELECT conv, turn, 'c' || turn AS id, text, CASE WHEN turn >= 2 THEN 'c' || (turn - 2) END AS after FROM c WHERE role = 'user'),
results AS (SELECT conv, turn, 'c' || (turn - 1) AS id, text FROM c WHERE role = 'assistant'),
both_ AS (SELECT coalesce(k.conv, r.conv) AS conv, coalesce(k.id, r.id) AS id, k.turn AS ct, r.turn AS rt, k.text AS q, r.text AS a, k.after,
    k.turn IS NOT NULL AS is_call, k.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv = k.conv AND p.id = k.after) AS lost
  FROM calls k FULL JOIN results r ON k.conv = r.conv AND k.id = r.id),
told AS (SELECT *, CASE WHEN is_call THEN concat_ws(',', CASE WHEN length(q) = 0 THEN 'text: too short' END, CASE WHEN lost THEN 'names an unknown call' END)
  ELSE 'result without a call' END AS problems FROM both_)
SELECT conv AS conv_id, id AS call_id, coalesce(ct, rt) AS turn, CASE WHEN is_call THEN 'reply' END AS name,
  CASE WHEN is_call THEN row_number() OVER (PARTITION BY conv, is_call ORDER BY ct) - 1 END AS position,
  is_call AND rt IS NOT NULL AS answered, problems, problems = '' AS valid,
  '{"arguments":' || CASE WHEN is_call THEN '{' || CASE WHEN after IS NOT NULL THEN '"after":"' || after || '",' ELSE '' END
    || '"text":' || to_json(q) || ',"turn":' || ct || '}' ELSE 'null' END || ',"id":"' || id || '","name":' || CASE WHEN is_call THEN '"reply"' ELSE 'null' END
    || ',"result":' || coalesce(to_json(a)::VARCHAR, 'null') || '}' AS record
FROM told
UNION ALL SELECT conv, NULL, turn, NULL, NULL, false, '', true, '{"content":' || to_json(text) || ',"id":null,"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM c WHERE role IS NULL OR role NOT IN ('user', 'assistant')""")
def op8_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of a dialogue: calls linked with their results, checked and ordered, and all other messages, in canonical JSON."""
    messages = chat.as_protocol(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    found = chat.link_tool_calls(messages, "conv", "turn", "text", chat.REPLY, every=True)
    return found.withColumnsRenamed({"conv": "conv_id", "id": "call_id"}).withColumn("problems", F.concat_ws(",", "problems"))


@query()
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality and toxicity of every document, by its text and by its source and language there."""
    found = quality.classify(table(spark, sf, "documents"), "doc_id", "text", F.col("source"), F.col("lang"),
                             table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])
    return found.select(
        F.col("key").alias("doc_id"), F.col("quality_probability").alias("quality_score"), (F.col("quality_probability") >= 0.5).alias("keep"),
        F.col("toxic_probability").alias("toxic_score"), (F.col("toxic_probability") >= 0.5).alias("toxic"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3""")
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of other labels nearly as close to an anchor as its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), "vec_id", "embedding", label, F.col("id") % 50 == 0)


@query()
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document by two vocabularies, cut into groups and linked."""
    import public_tokenizers

    own = public_tokenizer()
    return align.align(table(spark, sf, "documents"), "doc_id", "text", own["definition"], own["ranks"], own["pattern"],
                       public_tokenizers.path("piece_bpe_32k.model"), with_groups=False).withColumnRenamed("key", "doc_id")


LM_SQL = r"""doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(crc32_text % 10 = 0, false) AS held_out, list_append(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM keyed),
tok AS (SELECT r, doc_id, held_out, unnest(range(1, len(w) + 1)) AS i, unnest(list_prepend('', w[:-2])) AS v, unnest(w) AS w FROM doc),
uni AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
whole AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
bi AS (SELECT v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY v, w),
cont AS (SELECT w, count(*) AS a FROM bi GROUP BY w),
counts AS (SELECT 2 AS k, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM bi
  UNION ALL SELECT 1, count(*) FILTER (a = 1), count(*) FILTER (a = 2), count(*) FILTER (a = 3), count(*) FILTER (a = 4) FROM cont),
ds AS (SELECT k, CASE WHEN ok THEN least(greatest(1 - 2 * y * n2 / n1, 0), 1) ELSE 0.5 END AS d1, CASE WHEN ok THEN least(greatest(2 - 3 * y * n3 / n2, 0), 2) ELSE 1.0 END AS d2,
  CASE WHEN ok THEN least(greatest(3 - 4 * y * n4 / n3, 0), 3) ELSE 1.5 END AS d3
  FROM (SELECT *, n1 / (n1 + 2 * n2) AS y, n1 > 0 AND n2 > 0 AND n3 > 0 AS ok FROM counts)),
one AS (SELECT sum(a) AS kinds, sum(CASE WHEN a = 1 THEN d1 WHEN a = 2 THEN d2 ELSE d3 END) / sum(a) AS rest FROM cont, (SELECT * FROM ds WHERE k = 1)),
p1 AS (SELECT w, greatest(a - CASE WHEN a = 1 THEN d1 WHEN a = 2 THEN d2 ELSE d3 END, 0) / kinds AS p FROM cont, one, (SELECT * FROM ds WHERE k = 1)),
ctx AS (SELECT v, sum(c) AS total, sum(CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END) / sum(c) AS rest FROM bi, (SELECT * FROM ds WHERE k = 2) GROUP BY v),
p2 AS (SELECT v, w, greatest(c - CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END, 0) AS seen FROM bi, (SELECT * FROM ds WHERE k = 2)),
each_ AS (SELECT r, doc_id, held_out, uni.c, log10((coalesce(uni.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (whole.v + 1))) AS base,
  coalesce(p1.p, 0) + one.rest / (whole.v + 1) AS low, total, coalesce(seen, 0) AS seen, ctx.rest AS rest
  FROM tok, whole, one LEFT JOIN uni ON uni.w = tok.w LEFT JOIN p1 ON p1.w = tok.w LEFT JOIN ctx ON ctx.v = tok.v LEFT JOIN p2 ON p2.v = tok.v AND p2.w = tok.w)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT n FROM whole)::BIGINT AS train_tokens, round(sum(base), 6) AS base_score,
  round(sum(log10(CASE WHEN total IS NULL THEN low ELSE seen / total + rest * low END)), 6) AS score
FROM each_ GROUP BY r, doc_id"""

KEY_CRC_SQL = """steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT doc_id, text, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS crc32_text
  FROM documents, steps)"""


@query(f"WITH {KEY_CRC_SQL}, {LM_SQL}")
def op11_language_model(spark: SparkSession, sf: str) -> DataFrame:
    """Log-probability of every document by word pairs counted in nine tenths of them."""
    docs = table(spark, sf, "documents")

    def held(key):
        return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))

    model = kneser.fit(docs, "text", ~held("doc_id"))
    return kneser.score(docs, "doc_id", "text", model).select(
        F.col("key").alias("doc_id"), held("key").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))
