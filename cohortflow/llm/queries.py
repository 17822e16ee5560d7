"""Registered queries of the subpackage: thin digests of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import co_training, infilling, language_id, line_crf, line_dedup, metric_search, mixing, packing, personal_data, secret_scan, simhash, tool_calls, vector_codes
from cohortflow.llm.secret_sql import SECRETS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    """The vocabulary file of the packing query; operators take it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT d.doc_id, d.pos, d.line, f.k IS NOT NULL AND d.doc_id <> f.keeper AS lost FROM keyed d LEFT JOIN frequent f ON d.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per document before dropping, lines dropped, and the digest of the text that stays."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest doc_id that links of at most four bits reach."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@query("op9_source_mixing", r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS draw, row_number() OVER (ORDER BY doc_id) AS row_id
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY source
), fill AS (
  SELECT 0 AS step, source, w, 2 * source_size AS cap, false AS clamped FROM sources
  UNION ALL
  SELECT step + 1, source, w, cap, clamped OR over FROM (
    SELECT *, bool_or(over) OVER () AS go FROM (
      SELECT *, NOT clamped AND w * level > cap AS over FROM (
        SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () AS level FROM fill))) WHERE go
), last AS (
  SELECT * FROM fill WHERE step = (SELECT max(step) FROM fill)
), targets AS (
  SELECT source, CASE WHEN clamped THEN cap::DOUBLE ELSE w * ((1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - (SELECT coalesce(sum(cap) FILTER (WHERE clamped), 0) FROM last)) / (SELECT sum(w) FILTER (WHERE NOT clamped) FROM last)) END AS target FROM last
), plan AS (
  SELECT s.*, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM sources s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT z.*, p.source_size, p.target, p.whole, CASE WHEN p.whole < 2 THEN p.target - p.whole * p.source_size ELSE 0 END AS rest,
         row_number() OVER (PARTITION BY z.source ORDER BY z.size = 0, z.draw, z.size) AS turn
  FROM sized z JOIN plan p ON z.source IS NOT DISTINCT FROM p.source
), walk AS (
  SELECT source, turn, row_id, size <= rest AND size > 0 AS took, rest - CASE WHEN size <= rest THEN size ELSE 0 END AS left_over FROM ranked WHERE turn = 1
  UNION ALL
  SELECT r.source, r.turn, r.row_id, r.size <= w.left_over AND r.size > 0, w.left_over - CASE WHEN r.size <= w.left_over THEN r.size ELSE 0 END
  FROM walk w JOIN ranked r ON r.source IS NOT DISTINCT FROM w.source AND r.turn = w.turn + 1
)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (r.whole + w.took::INT))::BIGINT AS taken FROM ranked r JOIN walk w USING (row_id)
""")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its source's size and target."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every text, the base verdict, and the verdict of the labelled lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = line_crf.judge_documents(docs, table(spark, sf_dir, "labels"))
    return judged.select("document.doc_id", *line_crf.STATS, "base_failed", "kept", "content_share", F.size("boilerplate_lines").cast("long").alias("n_boilerplate_lines"))


@query("op1_secret_scan", SECRETS_SQL)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every whole text, counted and digested, and all spans with those that the randomness tests add."""
    scanned = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.joined_spans(F.col("spans"), lambda s: s["kind"] != secret_scan.RANDOM)
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secret_scan.joined_spans(F.col("spans")).alias("spans"), count("random"))


@query("op2_exact_top_k", r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", metric_search.integer_vector(F.col("embedding")).alias("v"))
    return metric_search.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by a model that never sees the documents held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.train_language_model(docs.filter(~held_out))
    found = language_id.identify_languages(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("document.doc_id", "document.held_out", "lang_pred", "score", "accepted")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the co-trained views of its text and its page."""
    return co_training.score_quality(*[table(spark, sf_dir, name) for name in ("documents", "labels", "pages")])


@query("op4_tool_call_linking", r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), asking AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns WHERE role IN ('system', 'user')
), edges AS (
  SELECT a.conv_id, a.turn, b.turn AS dep FROM asking a JOIN asking b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2) WHERE a.role = 'user'
), paths AS (
  SELECT conv_id, turn, 0 AS depth FROM asking
  UNION
  SELECT e.conv_id, e.turn, p.depth + 1 FROM paths p JOIN edges e ON p.conv_id = e.conv_id AND p.turn = e.dep
), levels AS (
  SELECT conv_id, turn, max(depth)::INTEGER AS level FROM paths GROUP BY conv_id, turn
), refs AS (
  SELECT conv_id, turn, string_agg('"$c' || dep || '"', ',' ORDER BY '$c' || dep) AS listed FROM edges GROUP BY conv_id, turn
), answers AS (
  SELECT conv_id, turn, text FROM turns WHERE role = 'assistant'
), linked AS (
  SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, 'c' || coalesce(a.turn, r.turn - 1) AS call_id, CASE a.role WHEN 'system' THEN 'configure' WHEN 'user' THEN 'lookup' END AS name,
         coalesce(a.turn, r.turn) AS turn, l.level, (r.conv_id IS NOT NULL)::BIGINT AS n_results,
         CASE WHEN a.role = 'user' THEN concat_ws(',', CASE WHEN length(a.text) > 400 THEN 'length:query' END, CASE WHEN a.words > 60 THEN 'maximum:words' END, CASE WHEN a.words < 1 THEN 'minimum:words' END) ELSE '' END AS errors,
         CASE a.role WHEN 'user' THEN '"arguments":{"after":[' || coalesce(f.listed, '') || '],"query":' || to_json(a.text) || ',"words":' || a.words || '},'
                     WHEN 'system' THEN '"arguments":{"prompt":' || to_json(a.text) || '},' ELSE '' END AS arguments, r.text AS result, a.conv_id IS NULL AS orphan
  FROM asking a FULL JOIN answers r ON a.conv_id = r.conv_id AND a.turn + 1 = r.turn LEFT JOIN levels l ON a.conv_id = l.conv_id AND a.turn = l.turn LEFT JOIN refs f ON a.conv_id = f.conv_id AND a.turn = f.turn
)
SELECT conv_id, call_id, name, turn, level, n_results, errors,
       CASE WHEN orphan THEN 'orphan' WHEN n_results = 0 THEN 'no_result' WHEN errors <> '' THEN 'invalid' ELSE 'ok' END AS status,
       sha256('{' || arguments || '"id":"' || call_id || '"' || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result) END || '}') AS canonical_sha256
FROM linked
""")
def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the transcripts derived from all conversations: order, status, schema errors and digest of the canonical JSON."""
    messages = tool_calls.tool_transcript(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_tool_calls(messages, tool_calls.SCHEMAS)
    return linked.select("conv_id", "call_id", "name", "turn", "level", "n_results", F.array_join("errors", ",").alias("errors"), "status", F.sha2("canonical", 256).alias("canonical_sha256"))


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans counted and digested, and all spans with those that the model adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find_personal_data(docs, personal_data.train_span_model(docs))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.joined_spans(base), 256).alias("base_sha256"), personal_data.joined_spans(F.col("spans")).alias("spans"))


@query("op12_fill_in_middle", r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed
), cuts AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), pieces AS (
  SELECT *, substr(text, 1, i) AS prefix, substr(text, i + 1, j - i) AS middle, substr(text, j + 1) AS suffix FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and form of every document, with digests of the output and of the text rebuilt from it."""
    made = infilling.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def _nearest_sql(books: str, out: str) -> str:
    """The nearest entry of every part: its number and squared distance."""
    return f"""{out} AS (
  SELECT row_id, part, arg_min(entry, distance * 64 + entry) AS entry, min(distance) AS distance FROM (
    SELECT c.row_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS distance FROM cells c JOIN {books} b ON c.part = b.part AND c.i = b.i GROUP BY c.row_id, c.part, b.entry) GROUP BY row_id, part)"""


def _average_sql(near: str, books: str, out: str) -> str:
    """Every used entry replaced by the floor of the mean of its parts."""
    return f"""{out} AS (
  SELECT b.part, b.entry, b.i, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT c.part, n.entry, c.i, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x FROM cells c JOIN {near} n ON c.row_id = n.row_id AND c.part = n.part GROUP BY c.part, n.entry, c.i) m
  ON b.part = m.part AND b.entry = m.entry AND b.i = m.i)"""


@query("op13_vector_codes", f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT row_id, (k - 1) // (len(v) // 16) AS part, (k - 1) % (len(v) // 16) AS i, v[k] AS x FROM (SELECT row_id, v, unnest(range(1, len(v) + 1)) AS k FROM kept)
), books0 AS (
  SELECT part, row_id - 1 AS entry, i, x FROM cells WHERE row_id <= 64
), {_nearest_sql("books0", "near0")}, {_average_sql("near0", "books0", "books1")}, {_nearest_sql("books1", "near1")}, {_average_sql("near1", "books1", "books2")}, {_nearest_sql("books2", "near2")},
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, sum(n.distance)::BIGINT AS error FROM near2 n JOIN kept k USING (row_id) GROUP BY k.row_id, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       sha256((SELECT string_agg(x::VARCHAR, ',' ORDER BY part, entry, i) FROM books2)) AS codebooks_sha256
FROM coded
""")
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every whole vector, its error, its label's error and the digest of the codebooks."""
    codes, codebooks = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_digest(codebooks)).alias("codebooks_sha256"))
