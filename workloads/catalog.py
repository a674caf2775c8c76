"""All registered queries with their DuckDB counterpart, where SQL can state one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scoreframe as sf
from workloads import sql as Q
from workloads import tables as D

Run = Callable[[SparkSession, str], DataFrame]

NATIVE = (
    "exact_match",
    "contains_answer",
    "set_f1",
    "jaccard_similarity",
    "word_count_similarity",
    "length_ratio",
    "weighted_match",
)
PYTHON = ("rouge_l", "bleu", "char_f1", "fuzzy_match", "json_validity")


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function as the query of its name."""

    def add(run: Run) -> Run:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            sf.ship(spark)
            return run(spark, folder)

        CATALOG[run.__name__] = Query(prepared, sql)
        return run

    return add


def rounded(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


# ---------------------------------------------------------------- metrics


def _metric_sql(pairs: str, name: str, value: str, keys: str = "sample_idx") -> str:
    return f"WITH {pairs} SELECT {keys}, round(({value})::DOUBLE, 6) AS {name} FROM pairs"


_STRIP_P, _STRIP_R = Q.strip("prediction"), Q.strip("reference")
_WORDS_P, _WORDS_R = f"len({Q.words('prediction')})", f"len({Q.words('reference')})"


def _item_set(column: str) -> str:
    parts = f"list_transform(string_split({column}, chr(10)), lambda x: {Q.strip('x')})"
    return f"list_distinct(list_filter({parts}, lambda x: x <> ''))"


def _word_set(column: str) -> str:
    return f"list_distinct({Q.words(f'lower({column})')})"


def _number(column: str) -> str:
    """Text a Python float() takes; of other digits the test data holds Arabic-Indic ones."""
    digits = r"[0-9]+(_[0-9]+)*"
    pattern = (
        rf"(?i)^[+-]?(({digits}\.?({digits})?|\.{digits})(e[+-]?{digits})?|inf|infinity|nan)$"
    )
    text = f"translate({Q.strip(column)}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
    return (
        f"CASE WHEN regexp_matches({text}, '{pattern}') "
        f"THEN TRY_CAST(replace({text}, '_', '') AS DOUBLE) END"
    )


_SET_F1 = f"""
  {Q.by_presence('len(a)', 'len(b)', '2.0 * len(list_intersect(a, b)) / (len(a) + len(b))')}
"""
_JACCARD = f"""
  {Q.by_presence('len(a)', 'len(b)',
                 'len(list_intersect(a, b))::DOUBLE / '
                 '(len(a) + len(b) - len(list_intersect(a, b)))')}
"""
_METRIC_VALUES = {
    "exact_match": f"({_STRIP_P} = {_STRIP_R})::INT",
    "contains_answer": f"contains({_STRIP_P}, {_STRIP_R})::INT",
    "set_f1": _SET_F1.replace("(a", f"({_item_set('prediction')}").replace(
        "b)", f"{_item_set('reference')})"
    ),
    "jaccard_similarity": _JACCARD.replace("(a", f"({_word_set('prediction')}").replace(
        "b)", f"{_word_set('reference')})"
    ),
    "word_count_similarity": Q.by_presence(
        _WORDS_P,
        _WORDS_R,
        f"1 - abs({_WORDS_P} - {_WORDS_R})::DOUBLE / greatest({_WORDS_P}, {_WORDS_R})",
    ),
    "length_ratio": Q.by_presence(
        "length(prediction)",
        "length(reference)",
        "least(length(prediction), length(reference))::DOUBLE "
        "/ greatest(length(prediction), length(reference))",
    ),
    "weighted_match": f"CASE WHEN lower({_STRIP_P}) = lower({_STRIP_R}) THEN 0.5 ELSE 0 END",
}


def _scored(pairs: DataFrame, *metrics, keys=("sample_idx",)) -> DataFrame:
    chosen = sf.metrics(metrics)
    return sf.score(pairs, chosen).select(*keys, *[rounded(m.name) for m in chosen])


@query(_metric_sql(Q.CONVERSATION_PAIRS, "exact_match", _METRIC_VALUES["exact_match"]))
def exact_match(spark, folder):
    return _scored(D.conversation_pairs(spark, folder), "exact_match")


@query(
    f"""WITH {Q.NUMERIC_PAIRS},
    numbers AS (SELECT sample_idx, {_number('prediction')} AS p, {_number('reference')} AS r
                FROM pairs)
    SELECT sample_idx, (p IS NOT NULL AND r IS NOT NULL AND p = r AND NOT isnan(p))::INT::DOUBLE
           AS exact_match_figure FROM numbers"""
)
def exact_match_figure(spark, folder):
    return _scored(D.numeric_pairs(spark, folder), "exact_match_figure")


@query(_metric_sql(Q.PASSAGE_PAIRS, "contains_answer", _METRIC_VALUES["contains_answer"]))
def contains_answer(spark, folder):
    return _scored(D.passage_pairs(spark, folder), "contains_answer")


@query(
    f"""WITH {Q.DOCUMENT_PAIRS},
    sets AS (SELECT sample_idx, {_item_set('prediction')} AS a, {_item_set('reference')} AS b
             FROM pairs)
    SELECT sample_idx, round(({_SET_F1})::DOUBLE, 6) AS set_f1 FROM sets"""
)
def set_f1(spark, folder):
    return _scored(D.document_pairs(spark, folder), "set_f1")


@query(
    f"""WITH {Q.CONVERSATION_PAIRS},
    cut AS (SELECT sample_idx, string_split(prediction, ', ') AS p, string_split(reference, ', ') AS r
            FROM pairs),
    sets AS (SELECT sample_idx,
               list_distinct(list_filter(list_transform(p, lambda x: {Q.strip('x')}),
                                         lambda x: x <> '')) AS a,
               list_distinct(list_filter(list_transform(r, lambda x: {Q.strip('x')}),
                                         lambda x: x <> '')) AS b
             FROM cut)
    SELECT sample_idx, round(({_SET_F1})::DOUBLE, 6) AS set_f1 FROM sets"""
)
def set_f1_delimiter(spark, folder):
    pairs = D.conversation_pairs(spark, folder)
    return _scored(pairs, sf.metric("set_f1", delimiter=", "))


def _lcs_sql(pairs: str, tokens_p: str, tokens_r: str, outer: str) -> str:
    """`outer` selects from `lcs` joined with the pairs by `id = sample_idx`."""
    return f"""WITH RECURSIVE {pairs},
    lists AS (SELECT sample_idx AS id, {tokens_p} AS a, {tokens_r} AS b FROM pairs),
    {Q.LCS}
    {outer}"""


def _characters(text: str) -> str:
    return f"list_filter(string_split({text}, ''), lambda c: c <> '')"


def _token_sorted(text: str) -> str:
    plain = rf"regexp_replace({text}, '[\x{{80}}-\x{{ff}}]', '', 'g')"
    spaced = rf"lower(regexp_replace({plain}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'))"
    return f"array_to_string(list_sort({Q.words(spaced)}), ' ')"


# The percentage of two character lists; halves go to the even neighbour.
_PERCENT = """CASE WHEN size_a = 0 AND size_b = 0 THEN 100
  WHEN size_a = 0 OR size_b = 0 THEN 0
  ELSE round_even(100.0::DOUBLE * (2 * common / (size_a + size_b)::DOUBLE), 0) END"""


@query(
    _lcs_sql(
        Q.PART_PAIRS,
        _characters(_token_sorted("prediction")),
        _characters(_token_sorted("reference")),
        f"SELECT id AS sample_idx, round(({_PERCENT}) / 100.0::DOUBLE, 6) AS char_f1 FROM lcs",
    )
)
def char_f1(spark, folder):
    pairs = sf.spread(D.part_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "char_f1")


@query(
    _lcs_sql(
        Q.PART_PAIRS,
        _characters(Q.strip("prediction")),
        _characters(Q.strip("reference")),
        f"""SELECT id AS sample_idx, round(
              CASE WHEN ({_PERCENT}) >= 70 THEN 1.0 ELSE ({_PERCENT}) / 100.0::DOUBLE END, 6)
            AS fuzzy_match FROM lcs""",
    )
)
def fuzzy_match(spark, folder):
    pairs = sf.spread(D.part_pairs(spark, folder), "sample_idx")
    return _scored(pairs, sf.metric("fuzzy_match", match_threshold=0.7))


@query()
def character_metrics(spark, folder):
    """Both character metrics on long texts, where a fold in SQL takes too long."""
    pairs = sf.spread(D.conversation_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "char_f1", "fuzzy_match")


def _bleu_tokens(text: str) -> str:
    text = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for escape, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{escape}', '{plain}')"
    text = f"(' ' || {text} || ' ')"
    for rule, spaced in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        text = f"regexp_replace({text}, '{rule}', '{spaced}', 'g')"
    return Q.words(text)


_BLEU = f"""
    tokens AS (
      SELECT sample_idx, {_bleu_tokens(_STRIP_P)} AS p, {_bleu_tokens(_STRIP_R)} AS r FROM pairs),
    sizes AS (SELECT unnest(range(1, 5)) AS n),
    got AS (
      SELECT sample_idx, n, gram, count(*) AS c FROM (
        SELECT sample_idx, n, unnest(list_transform(range(1, len(p) - n + 2),
                 lambda i: list_slice(p, i, i + n - 1))) AS gram FROM tokens, sizes)
      GROUP BY ALL),
    want AS (
      SELECT sample_idx, n, gram, count(*) AS c FROM (
        SELECT sample_idx, n, unnest(list_transform(range(1, len(r) - n + 2),
                 lambda i: list_slice(r, i, i + n - 1))) AS gram FROM tokens, sizes)
      GROUP BY ALL),
    matched AS (
      SELECT g.sample_idx, g.n, sum(least(g.c, coalesce(w.c, 0))) AS m, sum(g.c) AS total
      FROM got g LEFT JOIN want w
        ON g.sample_idx = w.sample_idx AND g.n = w.n AND g.gram = w.gram
      GROUP BY ALL),
    smooth AS (
      SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY sample_idx ORDER BY n) AS zeros
      FROM matched),
    logs AS (
      SELECT sample_idx, count(*) AS orders, max(m) AS best,
             sum(CASE WHEN m = 0 THEN -ln(pow(2, zeros) * total) ELSE ln(m / total) END) AS l
      FROM smooth GROUP BY sample_idx),
    bleu_scores AS (
  SELECT t.sample_idx, round(CASE WHEN l.orders = 4 AND l.best > 0
        THEN exp(least(0, 1 - len(r) / len(p)::DOUBLE) + l.l / 4) ELSE 0 END, 6)::DOUBLE AS bleu
      FROM tokens t LEFT JOIN logs l ON t.sample_idx = l.sample_idx)"""


@query(f"WITH {Q.CONVERSATION_PAIRS}, {_BLEU} SELECT sample_idx, bleu FROM bleu_scores")
def bleu(spark, folder):
    pairs = sf.spread(D.conversation_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "bleu")


@query(
    _lcs_sql(
        Q.CONVERSATION_PAIRS,
        Q.words("lower(prediction)"),
        Q.words("lower(reference)"),
        """SELECT id AS sample_idx, round(CASE WHEN common = 0 THEN 0
             ELSE 2.0::DOUBLE * common / (size_a + size_b) END, 6)::DOUBLE AS rouge_l FROM lcs""",
    )
)
def rouge_l(spark, folder):
    pairs = sf.spread(D.conversation_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "rouge_l")


@query()
def document_similarity(spark, folder):
    """All Python metrics over whole documents, whatever their length."""
    pairs = sf.spread(D.document_pairs(spark, folder), "sample_idx")
    return _scored(pairs, *PYTHON, keys=("dataset", "sample_idx"))


@query(
    f"""WITH {Q.DOCUMENT_PAIRS},
    sets AS (SELECT sample_idx, {_word_set('prediction')} AS a, {_word_set('reference')} AS b
             FROM pairs)
    SELECT sample_idx, round(({_JACCARD})::DOUBLE, 6) AS jaccard_similarity FROM sets"""
)
def jaccard_similarity(spark, folder):
    pairs = sf.spread(D.document_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "jaccard_similarity")


@query(
    _metric_sql(
        Q.DOCUMENT_PAIRS, "word_count_similarity", _METRIC_VALUES["word_count_similarity"]
    )
)
def word_count_similarity(spark, folder):
    pairs = sf.spread(D.document_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "word_count_similarity")


@query(_metric_sql(Q.CONVERSATION_PAIRS, "length_ratio", _METRIC_VALUES["length_ratio"]))
def length_ratio(spark, folder):
    return _scored(D.conversation_pairs(spark, folder), "length_ratio")


@query(_metric_sql(Q.CONVERSATION_PAIRS, "weighted_match", _METRIC_VALUES["weighted_match"]))
def weighted_match(spark, folder):
    return _scored(D.conversation_pairs(spark, folder), "weighted_match")


@query(
    _lcs_sql(
        Q.LISTED_PAIRS,
        _characters(_token_sorted("prediction")),
        _characters(_token_sorted("reference")),
        f"""SELECT id AS sample_idx, round(
              0.3 * ({_METRIC_VALUES['exact_match']}) + 0.4 * ({_PERCENT}) / 100.0
              + 0.3 * ({_METRIC_VALUES['set_f1']}), 6)::DOUBLE AS composite
            FROM lcs JOIN pairs ON id = sample_idx""",
    )
)
def composite(spark, folder):
    """Texts of several lines, so that exact match, characters and sets all differ."""
    pairs = sf.spread(D.listed_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "composite")


@query(
    f"""WITH {Q.JSON_PAIRS},
    keys AS (
      SELECT sample_idx,
        CASE WHEN json_valid(prediction) THEN
          CASE WHEN json_type(prediction) = 'OBJECT' THEN list_distinct(json_keys(prediction)) END
        END AS a,
        CASE WHEN json_valid(reference) THEN
          CASE WHEN json_type(reference) = 'OBJECT' THEN list_distinct(json_keys(reference)) END
        END AS b
      FROM pairs)
    SELECT sample_idx, round(CASE WHEN a IS NULL OR b IS NULL THEN 0
      WHEN len(b) = 0 THEN (len(a) = 0)::INT
      ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))
      END, 6)::DOUBLE AS json_validity FROM keys"""
)
def json_validity(spark, folder):
    pairs = sf.spread(D.json_pairs(spark, folder), "sample_idx")
    return _scored(pairs, "json_validity")


@query(
    f"""WITH {Q.CONVERSATION_PAIRS}
    SELECT sample_idx, (lower(prediction[1]) = lower(reference[1]))::INT::DOUBLE AS same_initial,
           round(CASE WHEN length(prediction) > 0
                 THEN length(replace(prediction, 'e', '')) / length(prediction)::DOUBLE
                 ELSE 0 END, 6) AS without_e,
           (length(prediction) >= length(reference))::INT::DOUBLE AS not_shorter
    FROM pairs"""
)
def registered_metrics(spark, folder):
    """Own metrics: a column builder, a Python function, and the latter called from SQL."""

    def same_initial(prediction, reference):
        first = [F.lower(F.left(text, F.lit(1))) for text in (prediction, reference)]
        return (first[0] == first[1]).cast("double")

    def without_e(prediction: str, reference: str) -> float:
        return len(prediction.replace("e", "")) / len(prediction) if prediction else 0.0

    def not_shorter(prediction: str, reference: str) -> float:
        return float(len(prediction) >= len(reference))

    own = [
        sf.register_metric("same_initial", same_initial, spark=spark),
        sf.register_metric("without_e", without_e, spark=spark, python=True),
    ]
    sf.register_metric("not_shorter", not_shorter, spark=spark, python=True)
    pairs = D.conversation_pairs(spark, folder)
    return sf.score(pairs, own).select(
        "sample_idx",
        "same_initial",
        rounded("without_e"),
        F.expr("not_shorter(prediction, reference)").alias("not_shorter"),
    )


# ---------------------------------------------------------------- datasets and prompts


def _stored_documents(spark: SparkSession, folder: str, documents: DataFrame) -> str:
    """Write one JSON file per dataset document; absent fields are left out."""
    path = sf.shared_path(spark, "documents")
    documents.select(
        "instruction", "output_length", "metrics", "few_shots", "samples"
    ).write.option("maxRecordsPerFile", 1).json(path)
    return path


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT instruction, output_length, array_to_string(metrics, ',') AS metrics,
           few_shot_total, sample_total FROM documents_made"""
)
def read_datasets(spark, folder):
    """Documents written as files, read back from the directory."""
    path = _stored_documents(spark, folder, D.dataset_documents(spark, folder))
    info = sf.dataset_info(sf.read_datasets(spark, path))
    return info.select(
        "instruction",
        "output_length",
        F.array_join("metrics", ",").alias("metrics"),
        F.col("few_shot_total").cast("long").alias("few_shot_total"),
        F.col("sample_total").cast("long").alias("sample_total"),
    )


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT d.instruction, n.sample_idx, n.input, n.reference
    FROM numbered n JOIN documents_made d ON n.dataset = d.dataset"""
)
def read_samples(spark, folder):
    """Samples of all files in a directory, in document order."""
    path = _stored_documents(spark, folder, D.dataset_documents(spark, folder))
    rows = sf.explode_samples(sf.read_datasets(spark, path), ["instruction"])
    return rows.select("instruction", "sample_idx", "input", "reference")


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT n.sample_idx, n.input, n.reference
    FROM numbered n JOIN documents_made d ON n.dataset = d.dataset"""
)
def read_sample_ranges(spark, folder):
    """The same samples, each file read by as many tasks as it has byte ranges."""
    path = _stored_documents(spark, folder, D.dataset_documents(spark, folder))
    return sf.read_sample_ranges(spark, path).select("sample_idx", "input", "reference")


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT number % 6 AS kind, count(*) AS found FROM documents_made
    WHERE number % 6 IN (0, 1) GROUP BY ALL"""
)
def discover_datasets(spark, folder):
    """Files of which some are broken, no object, or lack a required field."""
    body = F.to_json(F.struct("instruction", "metrics", "samples"))
    no_metrics = F.to_json(F.struct("instruction", "samples"))
    kind = F.col("number") % 6
    text = (
        F.when(kind == 1, F.replace(body, F.lit('"instruction":'), F.lit('"instruction":null,"x":')))
        .when(kind == 2, no_metrics)
        .when(kind == 3, F.concat(body, F.lit(" trailing")))
        .when(kind == 4, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 5, F.concat(F.lit("{"), body))
        .otherwise(body)
    )
    path = sf.shared_path(spark, "mixed")
    D.dataset_documents(spark, folder).select(kind.alias("kind"), text.alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).partitionBy("kind").text(path)
    found = sf.discover_datasets(spark, path, "*.txt")
    kind_of = F.regexp_extract("file_path", "kind=([0-9]+)", 1).cast("long")
    return found.groupBy(kind_of.alias("kind")).agg(F.count(F.lit(1)).alias("found"))


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT dataset, instruction, output_length, array_to_string(metrics, ',') AS metrics,
           few_shot_total, sample_total FROM documents_made"""
)
def dataset_info(spark, folder):
    info = sf.dataset_info(D.dataset_documents(spark, folder))
    return info.select(
        "dataset",
        "instruction",
        "output_length",
        F.array_join("metrics", ",").alias("metrics"),
        F.col("few_shot_total").cast("long").alias("few_shot_total"),
        F.col("sample_total").cast("long").alias("sample_total"),
    )


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT dataset, sample_idx, input, reference FROM numbered"""
)
def explode_samples(spark, folder):
    return sf.explode_samples(D.dataset_documents(spark, folder), [])


def _prompt_sql(shots: int) -> str:
    return f"""WITH {Q.DOCUMENT_SAMPLES},
    shots AS (
      SELECT n.dataset, string_agg(chr(10) || chr(10) || input || chr(10) || reference, ''
                                   ORDER BY sample_idx) AS text
      FROM numbered n JOIN documents_made d ON n.dataset = d.dataset
      WHERE sample_idx < {shots} AND few_shot_total >= {shots} GROUP BY ALL)
    SELECT n.dataset, n.sample_idx,
           d.instruction || coalesce(s.text, '') || chr(10) || chr(10) || n.input AS prompt
    FROM numbered n JOIN documents_made d ON n.dataset = d.dataset
    LEFT JOIN shots s ON n.dataset = s.dataset"""


@query(_prompt_sql(0))
def build_prompts_zero_shot(spark, folder):
    samples = sf.explode_samples(D.dataset_documents(spark, folder))
    return sf.build_prompts(samples).select("dataset", "sample_idx", "prompt")


@query(_prompt_sql(2))
def build_prompts(spark, folder):
    samples = sf.explode_samples(D.dataset_documents(spark, folder))
    return sf.build_prompts(samples, 2).select("dataset", "sample_idx", "prompt")


@query(_prompt_sql(1))
def build_prompts_joined(spark, folder):
    """Samples and dataset settings kept in two tables."""
    documents = D.dataset_documents(spark, folder)
    samples = sf.explode_samples(documents, [])
    return sf.build_prompts(samples, 1, documents).select("dataset", "sample_idx", "prompt")


@query(
    f"""WITH {Q.CONVERSATION_PAIRS},
    asked AS (SELECT *, sample_idx % 3 AS kind FROM pairs)
    SELECT dataset, sample_idx,
      CASE WHEN kind = 0 THEN {_METRIC_VALUES['exact_match']}::DOUBLE END AS exact_match,
      CASE WHEN kind <> 2 THEN round({_METRIC_VALUES['length_ratio']}, 6)::DOUBLE END
        AS length_ratio,
      CASE WHEN kind = 2 THEN round({_METRIC_VALUES['word_count_similarity']}, 6)::DOUBLE END
        AS word_count_similarity
    FROM asked"""
)
def select_metrics(spark, folder):
    """Each row is scored by the metrics it declares, the others stay NULL."""
    kind = F.col("sample_idx") % 3
    pairs = D.conversation_pairs(spark, folder).withColumn(
        "metrics",
        F.when(kind == 0, F.array(F.lit("exact_match"), F.lit("length_ratio")))
        .when(kind == 1, F.array(F.lit("length_ratio")))
        .otherwise(F.array(F.lit("word_count_similarity"))),
    )
    names = sf.declared_metrics(pairs)
    scored = sf.score(pairs, names, only_declared=True)
    return scored.select("dataset", "sample_idx", *[rounded(name) for name in names])


@query(
    f"""WITH {Q.SAMPLES}
    SELECT dataset, sample_idx,
      '{{"model":"echo","messages":[{{"role":"user","content":' || to_json(input) ||
      '}}],"temperature":0.2,"max_tokens":64,"seed":7,"stop":["END","###"],' ||
      '"response_format":{{"type":"json_object"}},"user":null}}' AS request
    FROM samples"""
)
def request_table(spark, folder):
    prompts = D.samples(spark, folder).withColumn("prompt", F.col("input"))
    asked = sf.request_table(
        prompts,
        D.MODEL,
        temperature=0.2,
        max_tokens=64,
        seed=7,
        stop=["END", "###"],
        messages="x",
        response_format={"type": "json_object"},
        user=None,
    )
    return asked.select("dataset", "sample_idx", "request")


@query(
    f"""WITH {Q.RAW_RESPONSES}
    SELECT event_id,
      CASE WHEN json_valid(raw)
           THEN coalesce(json_extract_string(raw, '$.choices[0].message.content'), '')
           ELSE '' END AS prediction,
      CASE WHEN json_valid(raw) THEN
        CASE WHEN coalesce(json_array_length(raw, '$.choices'), 0) = 0
               OR json_type(raw, '$.choices[0]') = 'NULL'
               OR json_type(raw, '$.choices[0].message') = 'NULL'
             THEN 'unexpected response' END
        ELSE 'unexpected response' END AS error
    FROM responses"""
)
def parse_responses(spark, folder):
    parsed = sf.parse_responses(D.raw_responses(spark, folder))
    return parsed.select("event_id", "prediction", "error")


@query(
    f"""WITH {Q.CONVERSATION_PAIRS}
    SELECT 'echo' AS model, dataset, sample_idx, input, reference,
           CASE WHEN failed THEN '' ELSE prediction END AS prediction FROM pairs
    UNION ALL
    SELECT 'copy', dataset, sample_idx, input, reference,
           CASE WHEN failed THEN '' ELSE reference END
    FROM pairs"""
)
def attach_predictions(spark, folder):
    joined = sf.attach_predictions(
        D.samples(spark, folder), D.predictions(spark, folder), [D.MODEL, "copy"]
    )
    return joined.select("model", "dataset", "sample_idx", "input", "reference", "prediction")


@query(
    f"""WITH {Q.SAMPLES}
    SELECT 'echo' AS model, dataset, sample_idx,
      CASE WHEN length(input) % 7 = 0 THEN '' ELSE replace(input, 'e', '3') END AS prediction,
      CASE WHEN length(input) % 7 = 0 THEN 'ValueError: no answer' END AS error,
      CASE WHEN length(input) % 7 = 0 THEN 3 ELSE 1 END AS attempts
    FROM samples"""
)
def generate(spark, folder):
    """A deterministic function in place of a model; it fails for some prompts."""

    def answer(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("no answer")
        return prompt.replace("e", "3")

    prompts = D.samples(spark, folder).withColumn("prompt", F.col("input"))
    return sf.generate(prompts, answer, D.MODEL, retries=2, delay=0.0).drop("seconds")


@query(
    f"""WITH {Q.SAMPLES},
    echoed AS (SELECT *, length(input) % 3 = 0 AS first_lost FROM samples),
    shouted AS (SELECT *, length(input) % 7 = 0 AS lost FROM samples)
    SELECT 'echo' AS fingerprint, dataset, sample_idx, 'e ' || input AS prediction,
           NULL AS error, CASE WHEN first_lost THEN 3 ELSE 1 END AS attempts FROM echoed
    UNION ALL
    SELECT 'shout', dataset, sample_idx, CASE WHEN lost THEN '' ELSE 's ' || input END,
           CASE WHEN lost THEN 'ValueError: no answer' END, CASE WHEN lost THEN 4 ELSE 1 END
    FROM shouted"""
)
def answer_ledger(spark, folder):
    """Two answer functions, each called twice; the outage of the first ends in between."""

    def make(tag, share):
        def answer(prompt: str) -> str:
            if share and len(prompt) % share == 0:
                raise ValueError("no answer")
            return f"{tag} {prompt}"

        return answer

    prompts = D.samples(spark, folder).withColumn("prompt", F.col("input"))
    path = sf.shared_path(spark, "ledger")

    def ask(name, answer):
        how = {"fingerprint": name, "retries": 1, "delay": 0.0}
        return sf.generate_to(spark, prompts, answer, D.MODEL, path, **how)

    ask("echo", make("e", 3))
    ask("shout", make("s", 7))
    found = ask("echo", make("e", 0)).unionByName(ask("shout", make("s", 7)))
    return found.select("fingerprint", "dataset", "sample_idx", "prediction", "error", "attempts")


@query(
    """SELECT d.doc_id AS sample_idx,
         coalesce(arg_min('item ' || b.item_id, b.item_id), 'none') AS prediction
       FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text)
       GROUP BY d.doc_id"""
)
def rule_predictions(spark, folder):
    """Benchmark passages as rules over whole documents."""
    prompts = sf.spread(D.document_prompts(spark, folder), "sample_idx")
    answered = sf.rule_predictions(prompts, D.benchmark_rules(spark, folder), "none")
    return answered.select("sample_idx", "prediction")


@query(
    """WITH lines AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
    asked AS (
      SELECT 'm1' AS model, o_orderkey AS sample_idx, o_orderkey AS k, 1 AS n FROM orders
      UNION ALL SELECT 'm2', o_orderkey, o_orderkey + 1, 1 FROM orders
      UNION ALL SELECT 'm2', o_orderkey, o_orderkey, 2 FROM orders)
    SELECT a.model, 'orders' AS dataset, a.sample_idx,
      coalesce(arg_min('line ' || l.n || ' of order ' || l.k, l.k * 16 + l.n), 'none') AS prediction
    FROM asked a LEFT JOIN lines l ON a.k = l.k AND a.n = l.n GROUP BY ALL"""
)
def rule_predictions_large(spark, folder):
    """A rule for every order line, over prompts of two models with the same sample keys."""
    answered = sf.rule_predictions(
        D.order_prompts(spark, folder), D.order_rules(spark, folder), "none"
    )
    return answered.select("model", "dataset", "sample_idx", "prediction")


@query(
    """SELECT doc_id AS sample_idx,
         CASE WHEN contains(text, 'license') THEN 'legal' WHEN contains(text, '@') THEN 'mail'
              WHEN contains(text, 'ein') THEN 'german' ELSE 'モックレスポンス' END AS prediction
       FROM documents"""
)
def rule_predictions_mapping(spark, folder):
    rules = {"license": "legal", "@": "mail", "ein": "german"}
    answered = sf.rule_predictions(D.document_prompts(spark, folder), rules)
    return answered.select("sample_idx", "prediction")


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES}
    SELECT dataset, 'echo' AS model,
      CASE number % 5 WHEN 1 THEN 'instruction is null' WHEN 2 THEN 'a sample lacks input or output'
        ELSE 'Unsupported metric: unheard_of' END AS error
    FROM documents_made WHERE number % 5 IN (1, 2, 3)"""
)
def failed_datasets(spark, folder):
    return sf.failed_datasets(D.faulty_documents(spark, folder), D.MODEL)


# ---------------------------------------------------------------- summaries

_SCORED_SQL = f"""WITH {Q.CONVERSATION_PAIRS},
scored AS (
  SELECT model, dataset, sample_idx, input, reference, prediction,
         {', '.join(f'({_METRIC_VALUES[n]})::DOUBLE AS {n}' for n in NATIVE)}
  FROM pairs
)"""


def _native_scores(spark: SparkSession, folder: str) -> DataFrame:
    return sf.score(D.conversation_pairs(spark, folder), NATIVE)


@query(
    f"""{_SCORED_SQL}
    SELECT model, dataset, count(*) AS num_samples, 0 AS few_shot_count,
      {', '.join(f'round(avg({n}), 6) AS {n}, round(stddev_pop({n}), 6) AS {n}_std' for n in NATIVE)}
    FROM scored GROUP BY ALL"""
)
def summarize(spark, folder):
    """Flagship: mean and deviation of all native metrics per model and dataset."""
    summary = sf.summarize(_native_scores(spark, folder), NATIVE)
    statistics = [name for n in NATIVE for name in (n, f"{n}_std")]
    return summary.select(
        "model", "dataset", "num_samples", "few_shot_count", *[rounded(s) for s in statistics]
    )


@query()
def evaluate_all_metrics(spark, folder):
    """Every metric in one pass over all pairs, then summarised."""
    pairs = D.conversation_pairs(spark, folder)
    names = [n for n in sf.list_metrics() if n in BUILT_IN]
    summary = sf.summarize(sf.score(sf.spread(pairs, "sample_idx"), names), names)
    return summary.select(
        "model", "dataset", "num_samples", *[rounded(n) for n in names]
    )


SQL_METRICS = (*NATIVE, "bleu", "exact_match_figure", "json_validity", "rouge_l")


def _json_keys(text: str) -> str:
    return (
        f"CASE WHEN json_valid({text}) THEN CASE WHEN json_type({text}) = 'OBJECT' "
        f"THEN list_distinct(json_keys({text})) END END"
    )


@query(
    _lcs_sql(
        Q.CONVERSATION_PAIRS,
        Q.words("lower(prediction)"),
        Q.words("lower(reference)"),
        f""",{_BLEU},
        numbers AS (
          SELECT sample_idx AS id, {_number('prediction')} AS p, {_number('reference')} AS r,
                 {_json_keys('prediction')} AS got, {_json_keys('reference')} AS want FROM pairs),
        scored AS (
          SELECT model, dataset, {', '.join(f'({_METRIC_VALUES[n]})::DOUBLE AS {n}' for n in NATIVE)},
            bleu, (p IS NOT NULL AND r IS NOT NULL AND p = r AND NOT isnan(p))::INT::DOUBLE
              AS exact_match_figure,
            CASE WHEN got IS NULL OR want IS NULL THEN 0
                 WHEN len(want) = 0 THEN (len(got) = 0)::INT
                 ELSE len(list_intersect(got, want))::DOUBLE
                      / (len(got) + len(want) - len(list_intersect(got, want))) END AS json_validity,
            CASE WHEN common = 0 THEN 0 ELSE 2.0::DOUBLE * common / (size_a + size_b) END AS rouge_l
          FROM pairs JOIN lcs ON pairs.sample_idx = lcs.id JOIN numbers ON pairs.sample_idx = numbers.id
            JOIN bleu_scores ON pairs.sample_idx = bleu_scores.sample_idx)
        SELECT model, dataset, count(*) AS num_samples,
          {', '.join(f'round(avg({n}), 5) AS {n}' for n in SQL_METRICS)}
        FROM scored GROUP BY ALL""",
    )
)
def evaluate_sql_metrics(spark, folder):
    """All metrics SQL can state, in one pass and summarised."""
    pairs = sf.spread(D.conversation_pairs(spark, folder), "sample_idx")
    summary = sf.summarize(sf.score(pairs, SQL_METRICS), SQL_METRICS)
    means = [F.round(n, 5).alias(n) for n in SQL_METRICS]
    return summary.select("model", "dataset", "num_samples", *means)


BUILT_IN = frozenset(sf.list_metrics())


@query(
    f"""{_SCORED_SQL}
    SELECT dataset, model, count(*) AS num_samples, 0 AS few_shot_count,
      {', '.join(f'round(avg({n}), 6) AS {n}' for n in NATIVE)}
    FROM scored GROUP BY ALL"""
)
def results_csv(spark, folder):
    """The flat report, written as CSV and read back."""
    summary = sf.summarize(_native_scores(spark, folder), NATIVE)
    report = sf.wide_summary(summary, NATIVE)
    path = sf.shared_path(spark, "report")
    sf.write_results_csv(report, path)
    stored = spark.read.schema(report.schema).csv(path, header=True, escape='"')
    return stored.select(
        "dataset", "model", "num_samples", "few_shot_count", *[rounded(n) for n in NATIVE]
    )


@query(
    f"""{_SCORED_SQL}
    SELECT model, dataset, count(*) AS num_samples, 3 AS few_shot_count, true AS timed, metric,
           round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std
    FROM (UNPIVOT scored ON {', '.join(NATIVE)} INTO NAME metric VALUE score)
    GROUP BY model, dataset, metric"""
)
def results_json(spark, folder):
    """Result documents per dataset, written as JSON and read back."""
    summary = sf.summarize(_native_scores(spark, folder), NATIVE, few_shot_count=3)
    results = sf.result_rows(summary, NATIVE, elapsed_time=1.5)
    path = sf.shared_path(spark, "results")
    sf.write_results_json(results, path, "first")
    stored = spark.read.schema(results.schema).json(f"{path}/run_id=first")
    return stored.select(
        "model",
        "dataset",
        "num_samples",
        "few_shot_count",
        (F.col("elapsed_time") > 0).alias("timed"),
        "deviations",
        F.explode("metrics").alias("metric", "mean"),
    ).select(
        "model",
        "dataset",
        "num_samples",
        "few_shot_count",
        "timed",
        "metric",
        rounded("mean"),
        F.round(F.col("deviations")[F.col("metric")], 6).alias("std"),
    )


@query(
    f"""{_SCORED_SQL}
    SELECT model, dataset, {', '.join(f'round(avg({n}), 6) AS {n}' for n in NATIVE)}
    FROM scored GROUP BY ALL"""
)
def wide_summary(spark, folder):
    """Means per metric column, pivoted from the long score table."""
    long = sf.long_scores(_native_scores(spark, folder), NATIVE)
    return sf.pivot_scores(long, NATIVE).select("model", "dataset", *[rounded(n) for n in NATIVE])


_LONG_SQL = f"""{_SCORED_SQL},
long AS (
  {' UNION ALL '.join(
      f"SELECT model, dataset, sample_idx, '{n}' AS metric, {n} AS score FROM scored"
      for n in NATIVE)}
)"""


@query(
    f"""{_LONG_SQL}
    SELECT model, dataset, sample_idx, metric, round(score, 6) AS score FROM long"""
)
def long_scores(spark, folder):
    long = sf.long_scores(_native_scores(spark, folder), NATIVE)
    return long.withColumn("score", F.round("score", 6))


@query(
    f"""{_LONG_SQL}
    SELECT model, (SELECT count(DISTINCT dataset) FROM long) AS num_datasets, dataset, metric,
           round(avg(score), 6) AS mean
    FROM long GROUP BY model, dataset, metric"""
)
def summary_document(spark, folder):
    """The nested document, unfolded again for comparison."""
    summary = sf.store(sf.summarize(_native_scores(spark, folder), NATIVE), "summary")
    document = sf.summary_document(summary, NATIVE, timestamp="now")
    path = sf.shared_path(spark, "document")
    sf.write_summary(document, path)
    stored = spark.read.schema(document.schema).json(path)
    datasets = stored.select("model", "num_datasets", F.explode("metrics").alias("dataset", "means"))
    return datasets.select(
        "model", "num_datasets", "dataset", F.explode("means").alias("metric", "mean")
    ).withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH {Q.DOCUMENT_PAIRS},
    scored AS (
      SELECT dataset, sample_idx, {_METRIC_VALUES['exact_match']}::DOUBLE AS exact_match,
             ({_METRIC_VALUES['length_ratio']})::DOUBLE AS length_ratio FROM pairs),
    long AS (UNPIVOT scored ON exact_match, length_ratio INTO NAME metric VALUE score)
    SELECT dataset, metric, part,
           array_to_string(list(printf('%.4f', score) ORDER BY sample_idx), ',') AS scores,
           round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std
    FROM (SELECT *, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std,
                 (row_number() OVER (PARTITION BY dataset, metric ORDER BY sample_idx) - 1) // 30 AS part
          FROM long WINDOW w AS (PARTITION BY dataset, metric))
    GROUP BY dataset, metric, part"""
)
def detailed_metrics(spark, folder):
    """A language has only some of the document numbers; its parts are full all the same."""
    names = ["exact_match", "length_ratio"]
    scored = sf.score(D.document_pairs(spark, folder), names).select("dataset", "sample_idx", *names)
    detail = sf.detailed_metrics(sf.store(scored, "scores"), names, part_size=30)
    shown = F.transform("scores", lambda s: F.format_string("%.4f", s))
    return detail.select(
        "dataset",
        "metric",
        "part",
        F.array_join(shown, ",").alias("scores"),
        rounded("mean"),
        rounded("std"),
    )


@query(
    f"""{_LONG_SQL}
    SELECT l.model, l.dataset, l.sample_idx, s.input, s.reference, s.prediction, l.metric,
           round(l.score, 6) AS score
    FROM long l JOIN scored s ON l.sample_idx = s.sample_idx AND l.dataset = s.dataset"""
)
def sample_scores(spark, folder):
    """Per-sample score maps, written as JSON, read back and unfolded."""
    scores = sf.sample_scores(_native_scores(spark, folder), NATIVE)
    path = sf.shared_path(spark, "samples")
    sf.write_results_json(scores, path, "first")
    stored = spark.read.schema(scores.schema).json(f"{path}/run_id=first")
    keys = ("model", "dataset", "sample_idx", "input", "reference", "prediction")
    return stored.select(*keys, F.explode("scores").alias("metric", "score")).withColumn(
        "score", F.round("score", 6)
    )


_ANSWERED = f"""{Q.DOCUMENT_SAMPLES},
pairs AS (
  SELECT n.dataset, n.sample_idx AS place, n.input, n.reference,
         d.instruction || chr(10) || chr(10) || input AS prediction,
         list_contains(d.metrics, 'contains_answer') AS odd,
         row_number() OVER (ORDER BY n.dataset, n.sample_idx) AS sample_idx
  FROM numbered n JOIN documents_made d ON n.dataset = d.dataset
)"""


def _answered_sql(outer: str) -> str:
    return _lcs_sql(
        _ANSWERED,
        Q.words("lower(prediction)"),
        Q.words("lower(reference)"),
        f""",scored AS (
          SELECT pairs.*,
            CASE WHEN odd THEN ({_METRIC_VALUES['contains_answer']})::DOUBLE END AS contains_answer,
            CASE WHEN NOT odd THEN ({_METRIC_VALUES['exact_match']})::DOUBLE END AS exact_match,
            CASE WHEN NOT odd THEN CASE WHEN common = 0 THEN 0
              ELSE 2.0::DOUBLE * common / (size_a + size_b) END END AS rouge_l,
            CASE WHEN odd THEN ({_METRIC_VALUES['word_count_similarity']})::DOUBLE END
              AS word_count_similarity
          FROM pairs JOIN lcs ON pairs.sample_idx = lcs.id)
        {outer}""",
    )


_ANSWERED_METRICS = ("contains_answer", "exact_match", "rouge_l", "word_count_similarity")


def _directory_run(spark: SparkSession, folder: str) -> sf.Run:
    path = _stored_documents(spark, folder, D.dataset_documents(spark, folder))
    return sf.evaluate(
        spark, path, D.MODEL, lambda prompt: prompt, sf.shared_path(spark, "run"), delay=0.0
    )


@query(
    _answered_sql(
        f"""SELECT count(*) AS num_samples, 0 AS few_shot_count, true AS timed,
          {', '.join(f'round(avg({n}), 6) AS {n}' for n in _ANSWERED_METRICS)}
        FROM scored GROUP BY dataset"""
    )
)
def evaluate_directory(spark, folder):
    """A whole run over dataset files: prompts, calls, scores and the report."""
    return _directory_run(spark, folder).report.select(
        "num_samples",
        "few_shot_count",
        (F.col("elapsed_time") > 0).alias("timed"),
        *[rounded(n) for n in _ANSWERED_METRICS],
    )


@query(
    _answered_sql(
        f"""SELECT place AS sample_idx, input, reference, prediction, metric, round(score, 10) AS score
        FROM (UNPIVOT scored ON {', '.join(_ANSWERED_METRICS)} INTO NAME metric VALUE score)"""
    )
)
def evaluate_samples(spark, folder):
    """The sample scores a run over dataset files has written, read back."""
    run = _directory_run(spark, folder)
    place, run_id = run.output.rsplit("/run_id=", 1)
    schema = (
        "sample_idx long, input string, reference string, prediction string, scores map<string,double>"
    )
    stored = spark.read.schema(schema).json(f"{place}/samples/run_id={run_id}")
    return stored.select(
        "sample_idx", "input", "reference", "prediction", F.explode("scores").alias("metric", "score")
    ).withColumn("score", F.round("score", 10))


@query(
    f"""WITH {Q.DOCUMENT_SAMPLES},
    answered AS (
      SELECT n.dataset, n.number, length(d.instruction) + 2 + length(n.input) AS size
      FROM numbered n JOIN documents_made d ON n.dataset = d.dataset)
    SELECT count(*) AS num_samples, round(avg(size), 6) AS picky, NULL AS error
    FROM answered WHERE number % 3 <> 0 GROUP BY dataset
    UNION ALL
    SELECT NULL, NULL, 'metric picky: LookupError: set ' || number
    FROM answered WHERE number % 3 = 0 GROUP BY dataset, number"""
)
def isolated_failures(spark, folder):
    """A metric that raises on some datasets: they are reported, the others are scored."""

    def picky(prediction: str, reference: str) -> float:
        number = int(prediction.split("。")[0].rsplit(" ", 1)[1])
        if number % 3 == 0:
            raise LookupError(f"set {number}")
        return len(prediction)

    chosen = sf.register_metric("picky", picky, python=True)
    path = _stored_documents(spark, folder, D.dataset_documents(spark, folder))
    place = sf.shared_path(spark, "run")
    run = sf.evaluate(spark, path, D.MODEL, lambda prompt: prompt, place, metrics=["exact_match", chosen])
    error = F.lit(None).cast("string").alias("error")
    scored = run.report.select("num_samples", rounded("picky"), error)
    none = F.lit(None)
    failed = run.failures.select(
        none.cast("long").alias("num_samples"), none.cast("double").alias("picky"), "error"
    )
    return scored.unionByName(failed)


# ---------------------------------------------------------------- keyed score tables

_STATE = (
    "model, dataset, sample_idx, metric, score, created_at, updated_at, is_builtin, is_active"
)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return sf.merge_scores(D.current_scores(spark, folder), D.score_changes(spark, folder))


@query(f"WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged")
def merge_scores(spark, folder):
    """However many changes there are: one full outer join."""
    current, changes = D.current_scores(spark, folder), D.score_changes(spark, folder)
    return sf.merge_scores(current, changes, small_bytes=0)


@query(f"WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged")
def merge_few_changes(spark, folder):
    """Changes that are sent to the tasks as long as they are few."""
    return _merged(spark, folder)


@query(
    f"""WITH {Q.SCORE_LOG}
    SELECT * REPLACE (is_active AND NOT EXISTS (
      SELECT 1 FROM changes c WHERE c.model = s.model AND c.dataset = s.dataset
        AND c.sample_idx = s.sample_idx AND c.metric = s.metric AND c.score > 100) AS is_active)
    FROM current_scores s"""
)
def retract(spark, folder):
    keys = D.score_changes(spark, folder).filter(F.col("score") > 100)
    return sf.retract(D.current_scores(spark, folder), keys)


@query(f"WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged WHERE is_active AND is_builtin")
def active_builtin(spark, folder):
    """Both origins asked for: builtin wins."""
    return sf.active(_merged(spark, folder), builtin_only=True, custom_only=True)


@query(f"WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged WHERE NOT is_builtin")
def active_custom(spark, folder):
    return sf.active(_merged(spark, folder), include_inactive=True, custom_only=True)


@query(
    f"""WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged
    WHERE is_active AND model = 'm1' AND dataset = 'u3' AND sample_idx = 30
      AND metric = 'click'"""
)
def lookup(spark, folder):
    key = {"model": "m1", "dataset": "u3", "sample_idx": 30, "metric": "click"}
    return sf.lookup(_merged(spark, folder), key)


def _stored_scores(spark: SparkSession, folder: str) -> sf.ScoreTable:
    """The score table as stored partitions, after the changes."""
    current, changes = D.current_scores(spark, folder), D.score_changes(spark, folder)
    table = sf.ScoreTable(spark, sf.shared_path(spark, "scores"), current.schema, buckets=16)
    table.write(current)
    table.merge(changes)
    return table


@query(f"WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged")
def merge_stored(spark, folder):
    """The state table written, merged partition by partition and read back."""
    return _stored_scores(spark, folder).rows()


@query(
    f"""WITH {Q.SCORE_LOG} SELECT {_STATE} FROM merged
    WHERE is_active AND model = 'm1' AND dataset = 'u3' AND sample_idx = 30
      AND metric = 'click'"""
)
def lookup_stored(spark, folder):
    key = {"model": "m1", "dataset": "u3", "sample_idx": 30, "metric": "click"}
    return _stored_scores(spark, folder).lookup(key)
