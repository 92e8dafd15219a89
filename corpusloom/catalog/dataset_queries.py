"""Queries over whole datasets: build, enrich, write, read, summarize."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.catalog import sql as S
from corpusloom.catalog.corpus import code_files, files_cte, q
from corpusloom.catalog.registry import query
from corpusloom.catalog.scalar_queries import _CODE, documents
from corpusloom.catalog.select_queries import _RANKED, _with_profile
from corpusloom.functions.chat import to_messages
from corpusloom.functions.text import line_count
from corpusloom.operators.enrich import enrich_instructions
from corpusloom.operators.files import select_files, with_language
from corpusloom.operators.registry import DEFAULT_REGISTRY, ExtractorRegistry
from corpusloom.operators.select import best_examples, dedup_first, quality_filter, with_priority
from corpusloom.operators.summary import dataset_summary
from corpusloom.operators.units import extract_examples
from corpusloom.plans.dataset import DatasetConfig, build_dataset, training_text
from corpusloom.schemas import METADATA
from corpusloom.sources import codefiles, jsonl
from corpusloom.sources.staging import fresh_path

CAPPED = 1200
_FIRST_FILES = DatasetConfig(profile_files=K.PROFILE_FILES)
_JS_FUNCTIONS = ExtractorRegistry(
    extensions=DEFAULT_REGISTRY.extensions,
    kinds=tuple(k for k in DEFAULT_REGISTRY.kinds if k.kind == "javascript_function"),
)
_JS_KINDS = ExtractorRegistry(
    extensions=DEFAULT_REGISTRY.extensions,
    kinds=tuple(k for k in DEFAULT_REGISTRY.kinds if k.kind.startswith("javascript_")),
)
_METADATA_COLUMNS = [f.name for f in METADATA.fields if f.name not in (
    "style_focus", "llm_generated_prompt", "original_instruction")]
_METADATA_SQL = ("type, name, 'src/' || file AS file, language, lines, complexity, has_docstring, "
                 "arg_count, method_count, naming_style, doc_style, priority")


def _flat(dataset):
    return dataset.select(
        "example_id", "repo", "rank", F.col("messages")[1]["content"].alias("user"),
        F.col("messages")[2]["content"].alias("assistant"),
        *[F.col(f"metadata.{c}").alias(c) for c in _METADATA_COLUMNS],
    )


# --- the smallest whole pipeline: JavaScript functions --------------------------
def _chain(units: str, k: int | None = None) -> str:
    """CTEs from `units`: deduplicated, filtered, flagged, ranked -> `final`."""
    return f"""
hashed AS (SELECT *, row_number() OVER (PARTITION BY repo, {S.code_hash('code')}
  ORDER BY ext_rank, path, seq) AS copy FROM {units}),
good AS (SELECT *, {S.DERIVED_METADATA} FROM hashed
  WHERE copy = 1 AND {S.passes_quality('code', 'name')}),
flagged AS (SELECT *, {S.priority('has_docstring', 'naming_style')} AS priority FROM good),
final AS (SELECT * FROM (SELECT *, {_RANKED} AS rank FROM flagged){f' WHERE rank <= {k}' if k else ''})"""


_NO_PYTHON = ("NULL::VARCHAR AS doc, NULL::VARCHAR AS others, NULL::INTEGER AS args, "
              "NULL::INTEGER AS methods")


@query("js_dataset", f"""
WITH {files_cte('.js', '.ts')},
units AS (SELECT *, pos AS seq, {_NO_PYTHON} FROM ({S.kept_units('javascript_function')})),
{_chain('units')}
SELECT repo || '#' || path || '#' || seq AS example_id, repo, CAST(rank AS INTEGER) AS rank,
  {S.user_content(S.instruction(), S.context(q(K.DEFAULT_STYLE_CONTEXT)))} AS user,
  code AS assistant, {_METADATA_SQL}
FROM final""")
def js_dataset(spark, sf_dir):
    """Files -> functions -> dedup -> quality -> best -> messages, all native.

    Functions alone, with the default context, as its SQL says; `js_dataset_all_kinds` is the whole."""
    files = select_files(code_files(spark, sf_dir, ".js", ".ts"))
    unique = dedup_first(extract_examples(files, _JS_FUNCTIONS))
    best = best_examples(with_priority(quality_filter(unique)))
    context = F.concat("context_prefix", F.coalesce("context_suffix", F.lit(K.DEFAULT_STYLE_CONTEXT)))
    return _flat(best.select(
        F.concat_ws("#", "repo", "path", "seq").alias("example_id"), "repo", "rank",
        to_messages(F.col("instruction"), context, F.col("output")).alias("messages"), "metadata",
    ))


# --- the whole pipeline ----------------------------------------------------------
def _dataset_sql(select: str, k: int | None = None, all_files: bool = False) -> str:
    if k is None:
        return _with_profile("", all_files).rstrip() + f""",
{_chain('units')}
{select}"""
    return _with_profile("").rstrip() + f""",
capped AS (SELECT repo, path FROM (
  SELECT repo, path, coalesce(sum(n) OVER (PARTITION BY repo ORDER BY ext_rank, path
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT repo, ext_rank, path, count(*) AS n FROM units GROUP BY ALL)) WHERE before < {k}),
taken AS (SELECT units.* FROM units JOIN capped USING (repo, path)),
{_chain('taken', k)}
{select}"""


_STYLED_FINAL = f"""SELECT repo || '#' || path || '#' || seq AS example_id, repo,
  CAST(rank AS INTEGER) AS rank,
  {S.user_content(S.instruction(), S.context(f"coalesce(style_context, '{K.DEFAULT_STYLE_CONTEXT}')"))}
    AS user, code AS assistant, {_METADATA_SQL}
FROM final LEFT JOIN profile USING (repo)"""


@query("code_dataset", _dataset_sql(_STYLED_FINAL))
def code_dataset(spark, sf_dir):
    """The style of a repository is that of its first files, as its SQL says."""
    return _flat(build_dataset(code_files(spark, sf_dir), _FIRST_FILES))


@query("code_dataset_all_files", _dataset_sql(_STYLED_FINAL, all_files=True))
def code_dataset_all_files(spark, sf_dir):
    """The default: no cap, and the style of all files."""
    return _flat(build_dataset(code_files(spark, sf_dir)))


@query("js_dataset_all_kinds", _with_profile("", all_files=True).rstrip() + f""",
js AS (SELECT * FROM units WHERE language = 'javascript'),
{_chain('js')}
{_STYLED_FINAL}""")
def js_dataset_all_kinds(spark, sf_dir):
    """JavaScript functions, arrow functions and classes, each with its repository's style."""
    return _flat(build_dataset(code_files(spark, sf_dir), DatasetConfig(registry=_JS_KINDS)))


@query("code_dataset_capped", _dataset_sql(_STYLED_FINAL, CAPPED))
def code_dataset_capped(spark, sf_dir):
    """A cap on raw units and a limit of as many examples."""
    return _flat(build_dataset(code_files(spark, sf_dir), DatasetConfig(max_examples=CAPPED, profile_files=K.PROFILE_FILES)))


@query("training_text", _dataset_sql(f"""SELECT
  '<|im_start|>system' || {S.NL} || {q(K.SYSTEM_MESSAGE)} || '<|im_end|>' || {S.NL}
  || '<|im_start|>user' || {S.NL} || user || '<|im_end|>' || {S.NL}
  || '<|im_start|>assistant' || {S.NL} || assistant || '<|im_end|>' AS text
FROM ({_STYLED_FINAL})"""))
def training_text_query(spark, sf_dir):
    return training_text(build_dataset(code_files(spark, sf_dir), _FIRST_FILES))


@query("dataset_summary", _dataset_sql(f"""
SELECT CASE WHEN g = 1 THEN 'type' WHEN g = 2 THEN 'language' ELSE 'all' END AS dimension,
  coalesce(type, language, 'all') AS value, n, files, with_docstring, high_priority,
  generated_prompts, avg_lines
FROM (SELECT type, language, grouping(type, language) AS g, count(*) AS n,
  count(DISTINCT file) AS files, count(*) FILTER (WHERE has_docstring) AS with_docstring,
  count(*) FILTER (WHERE priority = 'high') AS high_priority,
  count(*) FILTER (WHERE FALSE) AS generated_prompts,
  sum({S.line_count('code')}) / count(*) AS avg_lines
FROM (SELECT * REPLACE ('src/' || file AS file) FROM final)
GROUP BY GROUPING SETS ((type), (language), ()))"""))
def dataset_summary_query(spark, sf_dir):
    return dataset_summary(build_dataset(code_files(spark, sf_dir)))


# --- enrichment --------------------------------------------------------------------
def _stub_model():
    """A pure stand-in for a model: its answers only depend on the request."""
    def infer(requests):
        import json

        answers = []
        for request in requests:
            n = len(json.loads(request)["prompt"])
            if n % 13 == 0:
                raise ValueError("no answer to this one")
            kinds = {0: None, 1: "{broken", 2: f"Prompt: write {n} characters"}
            answers.append(kinds.get(n % 4, json.dumps({"response": f'"Explain {n} letters!"'})))
        return answers

    return infer


_CODE_OR_BLANK = f"CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE {_CODE} END"
_GIVEN = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Write ' || source END"
_REQUEST_LENGTH = (
    f"({len(K.GENERATION_PROMPT_HEAD) + len(K.GENERATION_PROMPT_TAIL)} + length({S.clean_code('x')}))"
)


_ENRICHED = f"""
SELECT doc_id, coalesce(answer, nullif(given, ''), heuristic) AS instruction,
  CASE WHEN answer IS NOT NULL THEN 'model' WHEN nullif(given, '') IS NOT NULL THEN 'template'
    ELSE 'heuristic' END AS prompt_source,
  TRUE AS llm_generated_prompt, given AS original_instruction,
  CASE WHEN failed THEN 'ValueError' END AS prompt_error
FROM (SELECT doc_id, given, {S.strip('x')} <> '' AND n % 13 = 0 AS failed,
    CASE WHEN {S.strip('x')} = '' OR n % 13 = 0 THEN NULL WHEN n % 4 = 2 THEN 'write ' || n || ' characters.'
      WHEN n % 4 = 3 THEN 'Explain ' || n || ' letters!' END AS answer,
    CASE WHEN {S.strip('x')} = '' THEN 'Write some code.'
      WHEN contains(lower(x), 'class ') THEN 'Write a class with the necessary methods.'
      WHEN contains(lower(x), 'def ') THEN 'Create a function to handle the required functionality.'
      WHEN regexp_matches(lower(x), 'import |from ')
        THEN 'Write code with the necessary imports and implementation.'
      WHEN regexp_matches(lower(x), 'try:|except') THEN 'Write code with proper error handling.'
      ELSE 'Write the necessary code implementation.' END AS heuristic
  FROM (SELECT *, {_REQUEST_LENGTH} AS n
        FROM (SELECT doc_id, {_CODE_OR_BLANK} AS x, {_GIVEN} AS given FROM documents)))"""


def _enriched(spark, sf_dir, **options):
    nothing = F.lit(None)
    metadata = F.struct(*[nothing.cast(f.dataType).alias(f.name) for f in METADATA.fields])
    rows = documents(spark, sf_dir).select(
        "doc_id", F.expr(_CODE_OR_BLANK).alias("output"), F.expr(_GIVEN).alias("instruction"),
        metadata.alias("metadata"),
    )
    return enrich_instructions(rows, _stub_model(), **options).select(
        "doc_id", "instruction", "prompt_source", "prompt_error",
        "metadata.llm_generated_prompt", "metadata.original_instruction",
    )


@query("enrich_instruction", _ENRICHED)
def enrich_instruction(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query("enrich_concurrency", _ENRICHED)
def enrich_concurrency(spark, sf_dir):
    """Three calls in flight; the same rows."""
    return _enriched(spark, sf_dir, concurrency=3)


@query("enrich_interval", _ENRICHED)
def enrich_interval(spark, sf_dir):
    """One request at a time, with a pause between them; the same rows."""
    return _enriched(spark, sf_dir, concurrency=8, min_interval=0.001)


# --- sources and sinks ----------------------------------------------------------------
def _document_dataset(spark, sf_dir):
    """One record per document; every second one has a partial metadata."""
    values = {
        "type": F.lit("document"), "name": F.col("source"),
        "file": F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")),
        "language": F.col("lang"), "lines": line_count(F.col("text")),
        "naming_style": F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END"),
        "style_focus": F.lit(True),
    }
    metadata = F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields
    ])
    return documents(spark, sf_dir).select(
        "doc_id", F.col("doc_id").cast("string").alias("example_id"),
        to_messages(F.col("lang"), F.col("source"), F.col("text")).alias("messages"),
        metadata.alias("metadata"),
    )


@query("jsonl_roundtrip", f"""
SELECT CAST(doc_id AS VARCHAR) AS example_id, {q(K.SYSTEM_MESSAGE)} AS system,
  lang || {S.NL} || {S.NL} || 'Context: ' || source AS user, text AS assistant FROM documents""")
def jsonl_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "messages")
    jsonl.write_messages(_document_dataset(spark, sf_dir), path)
    m = F.col("messages")
    return jsonl.read_jsonl(spark, path).select(
        "example_id", m[0]["content"].alias("system"), m[1]["content"].alias("user"),
        m[2]["content"].alias("assistant"),
    )


@query("metadata_sink", f"""
SELECT CAST(doc_id AS VARCHAR) AS example_id, 'document' AS type, lang AS language,
  {S.line_count('text')} AS lines, CASE WHEN doc_id % 2 = 0 THEN lang END AS naming_style,
  NULL::VARCHAR AS priority FROM documents""")
def metadata_sink(spark, sf_dir):
    path = fresh_path(spark, "metadata")
    jsonl.write_metadata(_document_dataset(spark, sf_dir), path)
    return jsonl.read_metadata(spark, path).select(
        "example_id", "metadata.type", "metadata.language", "metadata.lines",
        "metadata.naming_style", "metadata.priority",
    )


@query("rejoin_metadata", f"""
SELECT CAST(doc_id AS VARCHAR) AS example_id, text AS assistant,
  source || '/d' || doc_id AS file FROM documents""")
def rejoin_metadata(spark, sf_dir):
    dataset = _document_dataset(spark, sf_dir)
    messages, metadata = fresh_path(spark, "messages"), fresh_path(spark, "metadata")
    jsonl.write_messages(dataset, messages)
    jsonl.write_metadata(dataset, metadata)
    joined = jsonl.rejoin_metadata(
        jsonl.read_jsonl(spark, messages), jsonl.read_metadata(spark, metadata)
    )
    return joined.select(
        "example_id", F.col("messages")[2]["content"].alias("assistant"), "metadata.file"
    )


@query("sample_sink", """
SELECT text AS assistant, source AS name FROM documents
ORDER BY length(text) DESC, doc_id LIMIT 10""")
def sample_sink(spark, sf_dir):
    path = fresh_path(spark, "sample")
    dataset = _document_dataset(spark, sf_dir)
    longest = F.length(F.col("messages")[2]["content"]).desc()
    jsonl.write_sample(dataset, path, [longest, F.col("doc_id")])
    record = "messages array<struct<role:string,content:string>>, metadata struct<name:string>"
    rows = spark.read.schema(record).option("multiLine", "true").json(path)
    return rows.select(
        F.col("messages")[2]["content"].alias("assistant"), "metadata.name"
    )


def _write_tree(files, root: str) -> int:
    """Write a table of files as a tree of files, in tasks; their number.  A file
    without content becomes a link that leads nowhere."""
    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if content is None:
                    os.symlink("nowhere", target)
                    continue
                with open(target, "wb") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def _tree(spark, files) -> str:
    root = codefiles.mounted_path(fresh_path(spark, "tree"))
    _write_tree(files, root)
    return root


def _go_files(spark, sf_dir, path):
    return code_files(spark, sf_dir, ".go").select(path.alias("path"), F.encode("content", "UTF-8").alias("content"))


@query("scan_code_files", f"""
WITH {files_cte('.go')}
SELECT repo, repo || '/_pkg/__' || name AS path, '__' || name AS name, ext,
  CAST(strlen(content) AS BIGINT) AS size, content FROM code_files""")
def scan_code_files(spark, sf_dir):
    """Go files with names that the built-in sources hide, as a real tree."""
    files = _go_files(spark, sf_dir, F.regexp_replace("path", "/src/", "/_pkg/__"))
    skipped = files.select(
        F.concat("path", F.lit(".txt")).alias("path"), "content"
    ).unionByName(files.select(F.regexp_replace("path", "_pkg", "vendor").alias("path"), "content"))
    root = _tree(spark, files.unionByName(skipped))
    codefiles.register(spark)
    tree = spark.read.format("codefiles").option("path", root).option("splits", "32").load()
    return tree.select("repo", "path", "name", "ext", "size", F.decode("content", "UTF-8").alias("content"))


@query("scan_own_extension", f"""
WITH {files_cte('.go')}
SELECT repo, repo || '/src/' || name || 'x' AS path, '.gox' AS ext, language, CAST(ext_rank AS INTEGER) AS ext_rank,
  CAST(strlen(content) AS BIGINT) AS size
FROM (SELECT *  REPLACE ('golike' AS language, {len(K.LANGUAGE_BY_EXTENSION)} AS ext_rank) FROM code_files)
WHERE strlen(content) > 150""")
def scan_own_extension(spark, sf_dir):
    """An extension of one's own, known to the scanner and to the language lookup; a filter on size that the scan applies."""
    plain = _go_files(spark, sf_dir, F.col("path"))
    root = _tree(spark, plain.unionByName(_go_files(spark, sf_dir, F.concat("path", F.lit("x")))))
    registry = DEFAULT_REGISTRY.with_extension(".gox", "golike")
    codefiles.register(spark, registry)
    tree = spark.read.format("codefiles").option("path", root).option("splits", "16").load()
    kept = with_language(tree.where("size > 150 AND ext = '.gox'"), registry)
    return kept.select("repo", "path", "ext", "language", "ext_rank", "size")


@query("scan_segment", f"""
WITH {files_cte('.go')}
SELECT repo || '/environment/' || name AS path FROM code_files
UNION ALL SELECT repo || '/cabinet/' || name FROM code_files""")
def scan_segment(spark, sf_dir):
    """Parts of paths compared as whole components: `env` and `bin` leave out neither `environment` nor `cabinet`."""
    files = _go_files(spark, sf_dir, F.col("path"))
    placed = [files.select(F.replace("path", F.lit("/src/"), F.lit(f"/{part}/")).alias("path"), "content")
              for part in ("environment", "cabinet", "env", "bin", "a/vendor/b")]
    root = _tree(spark, reduce(lambda a, b: a.unionByName(b), placed))
    codefiles.register(spark)
    tree = spark.read.format("codefiles").option("path", root).option("splits", "16").option("pathMatch", "segment").load()
    return tree.select("path")


@query("scan_errors", f"""
WITH {files_cte('.go')}
SELECT repo, path, name, CASE WHEN CAST(k AS INTEGER) % 5 <> 0 THEN CAST(strlen(content) AS BIGINT) END AS size,
  CASE WHEN CAST(k AS INTEGER) % 5 = 0 THEN 'FileNotFoundError' END AS error FROM code_files""")
def scan_errors(spark, sf_dir):
    """Files that cannot be read are rows with the error's name."""
    number = F.regexp_extract("path", r"(\d+)\.go$", 1).cast("int")
    files = _go_files(spark, sf_dir, F.col("path"))
    root = _tree(spark, files.withColumn("content", F.when(number % 5 != 0, F.col("content"))))
    codefiles.register(spark)
    tree = spark.read.format("codefiles").option("path", root).option("splits", "16").option("errors", "rows").load()
    return tree.select("repo", "path", "name", "size", "error")
